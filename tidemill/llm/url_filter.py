"""URL filters by a path-template tree, in DataFrame expressions only.

Per host, path segments that are numbers, ids or one of many rarely repeated siblings become wildcards, level by level below
what is already a wildcard. The paths of a host so make a tree, of whose nodes those where paths part are kept. From its
leaves up, a branch whose own branches have all been merged into it is merged with its siblings if its share of bad labels
does not differ from theirs. A template is rejected when its share of bad labels, smoothed along all its ancestors up to
the host's and the global share, is high. Given rules for a host and its subdomains come first, the longest of those that
fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import saved, union, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule for a host, all its subdomains, and paths that start so.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Most rules that go into one expression; more are joined as a table.
RULES_INLINE = 1000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def with_rule(u: DataFrame, rules=RULES, most: int = RULES_INLINE) -> DataFrame:
    """``u`` (host, path) with (rule, say) of the longest rule that fits, by host and then path, of equals the last; nulls if
    none does. ``rules`` is a list of the driver's: up to ``most`` become one expression, more a table that is joined to all
    endings of each host."""
    order = sorted(rules, key=lambda r: len(r[1]) + len(r[2]))
    host, path = F.col("host"), F.col("path")
    if len(order) <= most:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for say, h, p in order:
            fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
        return u.withColumns({"rule": rule, "say": verdict})
    table = u.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(order)], "place int, say string, ending string, start string")
    parts = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = u.select("host", "path").distinct().withColumn("ending", F.explode(endings)).join(table, "ending").filter(path.startswith(F.col("start")))
    found = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("ending", "start").alias("rule"), "say"), "place").alias("r"))
    return u.join(found.select("host", "path", "r.*"), ["host", "path"], "left")


def shapes(path: Column) -> Column:
    """The segments of a path with digits and long hexadecimal ids as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), "{id}").otherwise(F.regexp_replace(s, r"\d+", "{n}")))


def joined(*parts: Column) -> Column:
    return F.concat_ws("/", *(F.nullif(x, F.lit("")) for x in parts))


def templates(paths: DataFrame, fanout: int, visits: float) -> DataFrame:
    """``paths`` (host, shape, n, ...) with the template (name) of each and the nodes above it where paths part (ups), from the
    host's first down. Each step takes all paths below one node past the segments that they all share and one more, so there
    are as many steps as paths part, not as they have segments; a path that is alone is done."""
    extra = [c for c in paths.columns if c not in ("host", "shape", "n")]
    rows, done = paths.withColumns({"node": F.lit(""), "rest": F.col("shape"), "ups": F.array().cast("array<string>")}), []
    while rows is not None:
        ends = rows.groupBy("host", "node").agg(F.count("*").alias("c"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        at = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        shared = F.when(at == 0, F.size("lo")).otherwise(at - 1).cast("int")
        now = rows.join(ends.select("host", "node", "c", shared.alias("shared")), ["host", "node"])
        now = now.withColumns({"name": joined(F.col("node"), F.array_join(F.when(F.col("c") == 1, F.col("rest")).otherwise(F.slice("rest", F.lit(1), F.col("shared"))), "/")), "seg": F.when(F.col("c") > 1, F.get("rest", F.col("shared")))})
        kids = now.groupBy("host", "name", "seg").agg(F.sum("n").alias("n"))
        kids = kids.groupBy("host", "name").agg(F.count("seg").alias("kids"), F.sum(F.when(F.col("seg").isNotNull(), F.col("n"))).alias("seen"), F.max(F.col("seg").isNull().cast("int")).alias("ended"))
        vary = (F.col("kids") >= fanout) & (F.col("seen") < visits * F.col("kids"))
        kids = kids.select("host", "name", F.coalesce(vary, F.lit(False)).alias("vary"), (F.when(vary, 1).otherwise(F.col("kids")) + F.col("ended") > 1).alias("part"))
        now = now.join(kids, ["host", "name"])
        now = saved(now.withColumn("ups", F.when((F.col("c") > 1) & F.col("part"), F.array_append("ups", F.col("name"))).otherwise(F.col("ups"))))
        done.append(now.filter("seg is null").select("host", "shape", "n", *extra, "name", "ups"))
        after = {"node": joined(F.col("name"), F.when(F.col("vary"), "*").otherwise(F.col("seg"))), "rest": F.slice("rest", F.col("shared") + 2, F.size("rest"))}
        rows = now.filter("seg is not null").withColumns(after).select("host", "shape", "n", *extra, "node", "rest", "ups")
        rows = rows if rows.limit(1).count() else None
    return union(done).withColumn("ups", F.when(F.size("ups") == 0, F.array(F.lit(""))).otherwise(F.col("ups")))


def merged(leaf: DataFrame, nodes: DataFrame, z: float) -> DataFrame:
    """(host, parent, child, leaf, merged) of all branches below a node, by the two-share test of a branch against its
    siblings, from the deepest up: an inner one may merge if all its own branches have merged into it."""
    c, found, below = F.col, [], None
    total = nodes.select("host", "depth", c("node").alias("parent"), c("lab").alias("lab_up"), c("bad").alias("bad_up"))
    rest = c("lab_up") - c("lab")
    pooled = (c("bad_up") + 1) / (c("lab_up") + 2)
    gap = F.abs(c("bad") / F.greatest(c("lab"), F.lit(1)) - (c("bad_up") - c("bad")) / F.greatest(rest, F.lit(1)))
    alike = (c("lab") == 0) | (rest > 0) & (gap <= z * F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(c("lab"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1)))))
    for depth in range((nodes.agg(F.max("depth")).first()[0] or 0), -1, -1):  # as many steps as paths part
        kids = leaf.filter(F.size("ups") == depth + 1).select("host", F.element_at("ups", -1).alias("parent"), c("name").alias("child"), F.lit(True).alias("leaf"), "lab", "bad", F.lit(True).alias("one"))
        if below is not None:
            inner = nodes.filter(c("depth") == depth + 1).join(below, ["host", "node"])
            kids = kids.unionByName(inner.select("host", "parent", c("node").alias("child"), F.lit(False).alias("leaf"), "lab", "bad", "one"))
        kids = written(kids.join(total.filter(c("depth") == depth).drop("depth"), ["host", "parent"]).select("host", "parent", "child", "leaf", (c("one") & alike).alias("merged")))
        below = kids.groupBy("host", c("parent").alias("node")).agg(F.bool_and("merged").alias("one"))
        found.append(kids)
    return union(found)


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, fanout: int = 8, visits: float = 4.0, z: float = 1.96, weight: float = 8.0, block_at: float = 0.5) -> DataFrame:
    """(key, host, path, template, purity, rule, verdict) of every row of ``pages``.

    ``labels`` has (key, bad): one row for each labelled page, bad 1 or 0. A segment with ``fanout`` different values or more
    below one node and fewer than ``visits`` rows for each is variable: they become '*'. Branches merge where the two-share
    test against their siblings stays within ``z``. ``purity`` is the smoothed share of good labels; ``weight`` is how many
    labels a prior counts for. Null urls, and those without '://', have an empty host and path, and share a template;
    equal urls get equal verdicts, repeated rows one each; without labels all is allowed. Paths are taken whole, however many
    segments they have; other columns are not read; an empty table gives an empty one.
    """
    u = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    u = u.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    u = u.withColumn("shape", shapes(F.col("path")))
    known = labels.select(F.col(key).alias("id"), F.col("bad").cast("long").alias("bad")).filter("bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    paths = u.join(known, "id", "left").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    placed = saved(templates(saved(paths), fanout, visits))

    c, totals = F.col, (F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    leaf = saved(placed.groupBy("host", "name", "ups").agg(*totals))
    nodes = leaf.select("host", "ups", F.posexplode("ups").alias("depth", "node"), "lab", "bad").withColumn("parent", F.when(c("depth") > 0, F.get("ups", c("depth") - 1)))
    nodes = saved(nodes.groupBy("host", "depth", "node", "parent").agg(*totals))
    lab, bad = leaf.agg(F.coalesce(F.sum("lab"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    base = (bad + 1) / (lab + 4)
    kids = saved(merged(leaf, nodes, z))
    into = kids.filter("not leaf").select("host", c("child").alias("node"), "merged")
    info = nodes.join(into, ["host", "node"], "left").select("host", "node", F.struct("depth", F.coalesce("merged", F.lit(False)).alias("merged"), "lab", "bad").alias("i"))
    lines = leaf.select("host", "name", "ups", F.explode("ups").alias("node")).join(info, ["host", "node"]).groupBy("host", "name", "ups").agg(F.array_sort(F.collect_list("i")).alias("line"))  # as long as paths part
    smooth = lambda share, x: (x["bad"] + weight * share) / (x["lab"] + weight)
    shares = F.aggregate("line", F.array().cast("array<double>"), lambda acc, x: F.array_append(acc, smooth(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(base)), x)))
    top = F.aggregate("line", F.lit(0), lambda acc, x: F.when(x["merged"], acc).otherwise(x["depth"]))
    own = kids.filter("leaf").select("host", c("parent").alias("up"), c("child").alias("name"), "merged")
    found = leaf.withColumn("up", F.element_at("ups", -1)).join(own, ["host", "up", "name"]).join(lines.select("host", "name", "ups", shares.alias("shares"), top.alias("top")), ["host", "name", "ups"])
    found = found.withColumn("p", F.when(c("merged"), F.get("shares", c("top"))).otherwise((c("bad") + weight * F.element_at("shares", -1)) / (c("lab") + weight)))
    template = F.concat(F.lit("/"), F.when(c("merged"), joined(F.get("ups", c("top")), F.lit("*"))).otherwise(c("name")))
    found = found.select("host", "name", "ups", template.alias("template"), F.round(1 - c("p"), 9).alias("purity"))
    found = saved(placed.select("host", "shape", "name", "ups").join(found, ["host", "name", "ups"]).select("host", "shape", "template", "purity"))

    out = with_rule(u.join(found, ["host", "shape"], "left"), rules)
    verdict = F.when(c("purity") <= 1 - block_at, "block").otherwise("allow")
    return out.select(c("id").alias(key), "host", "path", "template", "purity", "rule", F.coalesce("say", verdict).alias("verdict"))
