"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table
from tidemill.llm.url_filter import RULES


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the quality of the document that its url's path ends with."""
    from tidemill.llm.url_filter import judge, path_of

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    named = pages.select("page_id", F.regexp_extract(path_of(F.col("url")), r"(\d{1,18})(?:\.html|/)?$", 1).alias("x"))
    named = named.select("page_id", F.expr("try_cast(x as bigint)").alias("doc_id"))
    known = named.filter("doc_id is not null").join(labels.select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").select("page_id", "bad")
    return judge(pages, known)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.media import encode, probe

    out = probe(encode(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "offsets")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    from tidemill.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", files.path("byte_bpe_50k.json"), files.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    from tidemill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", files.path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.quality import classify

    docs = table(spark, sf_dir, "documents")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("p_doc", 6).alias("p_doc"), F.round("p_site", 6).alias("p_site"), F.round("p", 6).alias("p"), "keep")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.line_dedup import dedup

    out = dedup(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_lines", "n_removed", "blocks", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    from tidemill.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id is given the next label first."""
    from tidemill.llm.negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_media_columns, op3_token_counts, op4_packing, op5_simhash, op6_quality, op7_line_dedup, op8_byte_bpe, op9_top_k, op10_html_text, op11_hard_negatives, op12_language, op13_source_divergence, pipeline)}

RULES_SQL = [(h + p, say, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for say, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))]
RULE_SQL, SAY_SQL = (" ".join(f"when {fits} then '{x[k]}'" for *x, fits in RULES_SQL) for k in (0, 1))



def templates_sql(steps: int) -> str:
    """Steps down the tree of paths, a merge from its deepest nodes up, and shares from its top down: enough steps for paths
    that part ``steps`` times."""
    j = lambda x, y: f"concat_ws('/', nullif({x}, ''), nullif({y}, ''))"
    out = ["r0 as (select *, '' as node, shape as rest, []::varchar[] as ups from paths)"]
    for k in range(steps):
        out += [
            f"g{k} as (select host, node, count(*) as c, min(rest) as lo, max(rest) as hi from r{k} group by all)",
            f"l{k} as (select r.*, c, coalesce(nullif(list_position(list_transform(range(1, greatest(len(lo), len(hi)) + 1), lambda i: coalesce(lo[i] = hi[i], false)), false), 0) - 1, len(lo)) as lcp from r{k} r join g{k} using (host, node))",
            f"s{k} as (select *, {j('node', "array_to_string(case when c = 1 then rest else rest[1:lcp] end, '/')")} as name, case when c > 1 then rest[lcp + 1] end as seg from l{k})",
            f"v{k} as (select host, name, count(seg) as kids, sum(n) filter (where seg is not null) as seen, max((seg is null)::int) as ended from (select host, name, seg, sum(n) as n from s{k} group by all) group by all)",
            f"w{k} as (select s.*, vary, case when c > 1 and (case when vary then 1 else kids end) + ended > 1 then list_append(ups, name) else ups end as more from s{k} s join (select *, coalesce(kids >= 8 and seen < 4 * kids, false) as vary from v{k}) using (host, name))",
            f"r{k + 1} as (select host, shape, n, lab, bad, {j('name', "case when vary then '*' else seg end")} as node, rest[lcp + 2:] as rest, more as ups from w{k} where seg is not null)",
        ]
    out.append("placed as (select host, shape, name, lab, bad, case when len(ups) = 0 then [''] else ups end as ups from (" + " union all ".join(f"select host, shape, name, lab, bad, more as ups from w{k} where seg is null" for k in range(steps)) + "))")
    out.append("leaf as (select host, name, ups, sum(lab) as lab, sum(bad) as bad from placed group by all)")
    out.append(f"nodes as (select host, i - 1 as depth, ups[i] as node, case when i > 1 then ups[i - 1] end as parent, sum(lab) as lab, sum(bad) as bad from leaf, range(1, {steps + 1}) t(i) where i <= len(ups) group by all)")
    out.append("base as (select (sum(bad) + 1) / (sum(lab) + 4) as base from leaf)")
    alike = "lab = 0 or lab_up > lab and abs(bad / greatest(lab, 1) - (bad_up - bad) / greatest(lab_up - lab, 1)) <= 1.96::double * sqrt((bad_up + 1) / (lab_up + 2) * (1 - (bad_up + 1) / (lab_up + 2)) * (1 / greatest(lab, 1) + 1 / greatest(lab_up - lab, 1)))"
    for d in range(steps - 1, -1, -1):
        inner = f" union all select host, parent, node, false, lab, bad, one from nodes join m{d + 1} using (host, node) where depth = {d + 1}" if d < steps - 1 else ""
        out.append(f"c{d} as (select host, ups[len(ups)] as parent, name as child, true as leaf, lab, bad, true as one from leaf where len(ups) = {d + 1}{inner})")
        out.append(f"k{d} as (select host, parent, child, leaf, one and ({alike}) as merged from c{d} join (select host, node as parent, lab as lab_up, bad as bad_up from nodes where depth = {d}) using (host, parent))")
        out.append(f"m{d} as (select host, parent as node, bool_and(merged) as one from k{d} group by all)")
    out.append("p0 as (select host, node, (bad + 8.0 * base) / (lab + 8.0) as p, node as top, (bad + 8.0 * base) / (lab + 8.0) as ptop from nodes, base where depth = 0)")
    for d in range(1, steps):
        out.append(f"p{d} as (select x.host, x.node, (x.bad + 8.0 * y.p) / (x.lab + 8.0) as p, case when merged then y.top else x.node end as top, case when merged then y.ptop else (x.bad + 8.0 * y.p) / (x.lab + 8.0) end as ptop from nodes x join p{d - 1} y on y.host = x.host and y.node = x.parent join k{d - 1} k on k.host = x.host and k.parent = x.parent and k.child = x.node and not leaf where depth = {d})")
    out.append("pn as (" + " union all ".join(f"select * from p{d}" for d in range(steps)) + "), kn as (" + " union all ".join(f"select * from k{d}" for d in range(steps)) + ")")
    out.append(f"judged as (select l.host, l.name, l.ups, '/' || case when merged then {j('top', "'*'")} else l.name end as template, round(1 - case when merged then ptop else (l.bad + 8.0 * p) / (l.lab + 8.0) end, 9)::double as purity from leaf l join pn on pn.host = l.host and pn.node = l.ups[len(l.ups)] join kn on kn.host = l.host and kn.parent = l.ups[len(l.ups)] and kn.child = l.name and kn.leaf)")
    return ",\n        ".join(out)


ORACLES = {
    "op1_url_filter": rf"""
        with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        u as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
        s as (select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: case when regexp_full_match(s, '[0-9a-fA-F-]{{8,}}') then '{{id}}' else regexp_replace(s, '\d+', '{{n}}', 'g') end) as shape from u),
        known as (select page_id, max(1 - quality) as bad from u join labels on doc_id = try_cast(nullif(regexp_extract(path, '(\d{{1,18}})(?:\.html|/)?$', 1), '') as bigint) group by page_id),
        paths as (select host, shape, count(*) as n, count(bad) as lab, coalesce(sum(bad), 0) as bad from s left join known using (page_id) group by host, shape),
        {templates_sql(6)}
        select page_id, host, path, template, purity, case {RULE_SQL} end as rule, case {SAY_SQL} when purity <= 0.5 then 'block' else 'allow' end as verdict
        from s join placed using (host, shape) join judged using (host, name, ups)
    """,
    "op9_top_k": """
        with v as (select vec_id, min(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
             s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) as bigint) as score
                   from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
        from s qualify rank <= 5
    """,
    "op11_hard_negatives": """
        with v as (select vec_id, min(case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label, min(list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))) as e from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
             s as (select a.vec_id as anchor_id, d.vec_id, a.label = d.label as same, cast(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * d.e[i])) as bigint) as score
                   from v a join v d on a.vec_id <> d.vec_id where a.vec_id % 100 = 0),
             p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5
    """,
    "op13_source_divergence": r"""
        with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        keep as (select lang, term, count(*) as all_n from w group by all having count(distinct id) >= 10),
        c as (select lang, source, term, count(*) as n from w join keep using (lang, term) group by all),
        v as (select lang, count(*) as v, sum(all_n) as all_size from keep group by all),
        g as (select distinct lang, source from d),
        s as (select lang, source, coalesce(sum(n), 0) as size from g left join c using (lang, source) group by all),
        full_ as (select s.lang, s.source, k.term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 2)::hugeint) // (size + 2 * v)::hugeint as p, 1 + (1000000000 * (all_n + 2)::hugeint) // (all_size + 2 * v)::hugeint as q
                  from s join keep k on k.lang = s.lang join v on v.lang = s.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
        f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from full_ a join full_ b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
        term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from full_ where n > 0 and p > q),
        both_ as (select * from pair union all select * from term)
        select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from both_ qualify part = 'pair' or rank <= 10
    """,
}
