"""Operators over many rows, against brute force."""

from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers as files
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import texts
from tidemill.llm import common, line_dedup, packing, quality, queries, similar, simhash, topk, url_filter

WORD = files.path("word_bpe_49k.json")


def roots(nodes, linked):
    """Smallest reachable node of each, by union-find over all pairs."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# ---- packing


def test_pieces_equal_the_library(docs):
    library = Tokenizer.from_file(WORD)
    e = packing.encoder(WORD)
    for _, t in texts(docs):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(100), packing.Capacity(100, 3), packing.Capacity(100, 10, 2500)])
def test_plans_fit(capacity, score):
    lengths = [int(x) for x in np.random.default_rng(3).integers(1, min(101, int(capacity.cost**0.5) + 1), 3000)]
    histogram = Counter(lengths)
    placed, used = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in packing.plan(histogram, capacity, score):
        for i in range(n):
            placed[sequence + i].append((offset, length))
            used[length].append(rank + i)
    assert {k: sorted(v) for k, v in used.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for rows in placed.values():
        rows.sort()
        assert rows[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(rows))
        assert sum(n for _, n in rows) <= capacity.tokens and len(rows) <= capacity.documents and sum(n * n for _, n in rows) <= capacity.cost
    least = max(sum(lengths) / capacity.tokens, len(lengths) / capacity.documents, sum(n * n for n in lengths) / capacity.cost)
    assert len(placed) <= 1.12 * least + 1


def test_plan_is_as_good_as_best_fit_decreasing():
    lengths = [int(x) for x in np.random.default_rng(4).integers(1, 4097, 400)]
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(4096 - n)
    got = {s + i for _, _, n, s, _ in packing.plan(Counter(lengths), packing.Capacity()) for i in range(n)}
    assert len(got) <= len(bins)


def test_too_long_a_piece():
    with pytest.raises(ValueError):
        packing.plan({101: 1}, packing.Capacity(100))


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(100, 3), packing.Capacity(100, 50, 2500), packing.Capacity(100, 4, 3000)])
def test_tables_are_packed_under_all_limits(spark, capacity, score):
    """Limits on documents and cost that bind, over a table of pieces with ties and repeated rows."""
    rng = np.random.default_rng(15)
    most = int(min(100, capacity.cost**0.5))
    rows = [(int(rng.integers(0, 400)), int(k % 3), 0, int(min(most, rng.geometric(0.06))), k) for k in range(1500)] + [(7, 0, 0, 5, 1)] * 3 + [(None, 0, 0, 5, 1)]
    out = packing.pack(spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"), capacity, score).collect()
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == Counter(rows)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    full = Counter()
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(x))
        used = (sum(n for _, n in x), len(x), sum(n * n for _, n in x))
        assert used[0] <= capacity.tokens and used[1] <= capacity.documents and used[2] <= capacity.cost
        full.update(k for k, (u, c) in enumerate(zip(used, (capacity.tokens, capacity.documents, capacity.cost))) if u >= 0.9 * c)
    assert full[1] + full[2] > 0.5 * len(bins)  # not the tokens, but the other limits fill most sequences


def test_packing_of_all_cases(docs, empty):
    library = Tokenizer.from_file(WORD)
    out = packing.pack_documents(docs, "doc_id", "text", WORD).collect()
    want = sorted(((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts(docs)), key=str)
    got = Counter()
    rows = defaultdict(list)
    for r in out:
        rows[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
        assert r.start == 4096 * r.piece and r.length <= 4096
    whole = Counter()
    for i, n in want:
        whole[i] += n
    assert got == whole
    for x in rows.values():
        x.sort()
        assert x[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(x)) and sum(n for _, n in x) <= 4096
    assert packing.pack_documents(empty, "doc_id", "text", WORD).count() == 0


# ---- near duplicates


def bits(a, b):
    return bin(a ^ b).count("1")


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert {k: v for k, v in want.items() if k != v} == got
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_connect_all_within_three_bits(spark, crowd):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    near = [base[0] ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 5)), replace=False)) for _ in range(150)]
    near += [b ^ sum(1 << int(i) for i in rng.choice(64, 3, replace=False)) for b in base for _ in range(2)]
    f = sorted({*base, *near, 0, 2**64 - 1})
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in f], "fp long")
    got = [(r.src, r.dst) for r in simhash.links(df, 3, crowd).collect()]
    assert all(bits(a % 2**64, b % 2**64) <= 3 for a, b in got)
    s = [signed(x) for x in f]
    want = roots(s, [(signed(a), signed(b)) for i, a in enumerate(f) for b in f[:i] if bits(a, b) <= 3])
    assert roots(s, got) == want


def test_fingerprints_by_definition():
    import xxhash

    def plain(text):
        words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    for t in ("", " \x0b\x0c", "one", "One two", "A b c d A b c", "É é\u00a0x y z\x85 w", "a " * 50):
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_near_duplicates_of_all_cases(docs, empty):
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    rows = [(i, simhash.fingerprint(t.encode())) for i, t in texts(docs)]
    fps = sorted({f for _, f in rows})
    root = roots(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bits(a, b) <= 3])
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in rows), key=str)
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == 0


def test_near_duplicates_of_the_table(spark, sf_dir):
    rows = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op5_simhash(spark, sf_dir).collect()}
    ids = sorted(rows)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bits(rows[a][0], rows[b][0]) <= 3])
    assert {i: c for i, (_, c) in rows.items()} == want


# ---- top-k


def brute(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            v = [int(np.floor(256 * float(x))) for x in v]
            good[i] = min(v, good.get(i, v))
    out = []
    for q, a in good.items():
        if q % every == 0:
            score = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 64])
def test_top_k_with_ties_and_odd_vectors(spark, block):
    rng = np.random.default_rng(7)
    same = [float(x) for x in rng.normal(size=8)]
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)] + [(900 + i, same) for i in range(150)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2050, [float("nan")] * 8), (2051, [float("inf")] * 8), (None, same), (2052, [3.0]), (2100, [0.0] * 8)]
    rows += [(100, same), (900, same), (7, [9.0] * 8)]  # ids that repeat, with equal and with other vectors
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, block int")
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted(tuple(r) for r in topk.top_k(df, block=block).collect()) == want
    assert topk.top_k(df.filter("false")).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk.top_k(few).count() == 2


def clustered(n, spread=20):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16)) * 4000
    return np.floor(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * spread)


def test_cover_trees():
    """Covering, nesting and separation at each node, over clustered, even, repeated and few points."""
    rng = np.random.default_rng(10)
    for points in (clustered(3000), np.floor(rng.normal(size=(700, 2)) * 1000), np.floor(rng.normal(size=(300, 40)) * 100), np.ones((100, 3)), np.zeros((1, 2))):
        t = topk.Tree(points)
        assert sorted(t.order) == list(range(len(points)))
        far = lambda x, y: np.sqrt(((x - y) ** 2).sum(-1))
        for lo, hi, centre, radius, kids in t.nodes:
            own = points[t.order[lo:hi]]
            assert (own == centre).all(1).any() and far(own, centre).max() <= radius * (1 + 1e-12)
            if kids:
                spans = sorted(t.nodes[x][:2] for x in kids)
                assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] == b[0] for a, b in pairwise(spans))
                assert all(t.nodes[x][3] <= radius / 2 for x in kids)
                middle = np.array([t.nodes[x][2] for x in kids])
                assert len(kids) == 1 or min(np.delete(far(middle, c), i).min() for i, c in enumerate(middle)) > radius / 2
    assert len(topk.Tree(clustered(3000)).nodes) > 12


def test_top_k_prunes_and_stays_exact():
    data = clustered(3000)
    ids, block = np.arange(3000), topk.Block(np.arange(3000), data)
    q, found, score = block.search(data[:40], np.full(40, -(2**63)), 5)
    for at in range(40):
        s = data @ data[at]
        assert sorted(zip(-score[q == at], found[q == at])) == sorted((-int(x), int(i)) for x, i in zip(s, ids))[:5]
    assert block.scored < 0.35 * 40 * 3000
    assert not len(block.search(data[:40], np.full(40, 2**62), 5)[0])


def test_top_k_sends_queries_to_few_blocks():
    """On clustered data most blocks are ruled out before any vector is sent there, and no answer is lost."""
    import pyarrow as pa

    data = clustered(3000)
    centres = data[::10][topk.net(data[::10], 40)[0]]
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(data.tolist(), pa.list_(pa.float64()))], ["vec_id", "vec"])
    (dealt,) = topk.cell_batches([rows], centres, 16)
    cell, away = dealt.column(2).to_numpy(), dealt.column(3).to_numpy()
    radii = np.array([away[cell == c].max(initial=0) for c in range(40)])
    least = np.sort(data[:50] @ data.T, 1)[:, -6].astype(np.int64)
    asks = pa.RecordBatch.from_arrays([*rows.slice(0, 50).columns, pa.array(least)], ["vec_id", "vec", "least"])
    sent = {(q, c) for b in topk.next_batches([asks], centres, radii, np.ones(40, np.int64), 16) for q, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist())}
    first = (data[:50] @ centres.T).argmax(1)
    assert all((q, int(cell[i])) in sent or cell[i] == first[q] for q in range(50) for i in np.flatnonzero(data @ data[q] >= least[q]))
    assert sum((cell == c).sum() for _, c in sent) < 0.3 * 50 * 3000


def test_top_k_beyond_doubles():
    big = np.array([[3e8, 1.0], [3e8, 2.0], [-3e8, 5.0]])
    _, found, score = topk.Block(np.arange(3), big).search(big[:1], np.array([-(2**63)]), 3)
    assert found.tolist() == [1, 0, 2] and score.tolist() == [90000000000000002, 90000000000000001, -89999999999999995]


# ---- URLs


def test_url_parts_and_rules(spark):
    rows = [
        ("http://WWW.Example.COM/en/7?x#y", "www.example.com", "/en/7", "example.com/en/7", "allow"),
        ("https://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"),
        ("http://x.net/de/1", "x.net", "/de/1", "net/de/", "allow"),
        ("http://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://notexample.net/de/81", "notexample.net", "/de/81", "net/de/", "allow"),
        ("ftp://o.org/es/", "o.org", "/es/", "org/es/", "block"),
        ("http://h.org?/es/", "h.org", "", None, "allow"),
        ("http://h.org#f", "h.org", "", None, "allow"),
        ("no scheme/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://Éa.com/en/", "Éa.com", "/en/", "com/en/", "block"),
        ("a://b://c.com/en/", "b:", "//c.com/en/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "h", "p", 0.5) for i, r in enumerate(rows)], "page_id long, url string, host string, path string, purity double")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = sorted(tuple(r)[:7] for r in url_filter.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == [(i, *r[1:]) for i, r in enumerate(rows)]
    assert url_filter.judge(pages.filter("false"), labels).count() == 0


def test_templates_are_rejected_by_purity(spark):
    urls = [f"http://h.site/good/{i}" for i in range(40)] + [f"http://h.site/spam/x{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(60)] + [f"http://h.site/u/{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10] * 2}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/spam/" in u)) for i, u in enumerate(urls) if i % 2] + [(3, None), (1, 0)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert all((got[i].verdict == "block") == ("/spam/" in u) for i, u in enumerate(urls))
    assert {got[i].template for i, u in enumerate(urls) if "/spam/" in u} == {"/spam/*"}


def test_deep_branches_are_told_apart(spark):
    """Good and bad pages differ at the ninth segment alone; a path of many thousand segments is taken whole."""
    urls = [f"http://h.site/a/b/c/d/e/f/g/h/{'good' if i % 2 else 'spam'}/page-{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(80)]
    urls += ["http://h.site/" + "x/" * 8_000, "http://h.site/" + "x/" * 8_000 + "y", "http://other.site/" + "z/" * 3_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/spam/" in u)) for i, u in enumerate(urls[:80])], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert all((got[i].verdict == "block") == ("/spam/" in u) for i, u in enumerate(urls)) and got[0].template != got[1].template


def test_inner_branches_merge(spark):
    """Two branches alike in all their own merge; the third stays, as do the branches of one that differ among themselves."""
    urls, bad = [], []
    for branch, share in (("a", (0, 0)), ("b", (0, 0)), ("c", (1, 1)), ("d", (0, 1))):
        for part, b in zip(("x", "y"), share):
            for i in range(30):
                urls.append(f"http://h.site/{branch}/{part}/{i}")
                bad.append(b)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(list(enumerate(bad)), "page_id long, bad int")).collect()
    name = {(urls[r.page_id].split("/")[3], urls[r.page_id].split("/")[4]): r.template for r in got}
    assert name["c", "x"] == name["c", "y"] == "/c/*" and name["d", "x"] == "/d/x/{n}" and name["d", "y"] == "/d/y/{n}"
    assert name["a", "x"] == name["a", "y"] and all((r.verdict == "block") == bool(bad[r.page_id]) for r in got)


def test_many_rules_are_joined(spark):
    rng = np.random.default_rng(13)
    rules = [(("block", "allow")[int(rng.integers(2))], h, p) for h in ("com", "a.com", "b.a.com", "org", "") for p in ("/", "/x", "/x/y", "")]
    rows = [(h, p) for h in ("com", "a.com", "xa.com", "c.b.a.com", "b.org", "", "de") for p in ("", "/", "/x", "/x/y/z", "/w")]
    u = spark.createDataFrame([*rows, rows[0]], "host string, path string")
    key = lambda d: sorted(((r.host, r.path, r.rule, r.say) for r in d.collect()), key=str)
    assert key(url_filter.with_rule(u, rules, most=0)) == key(url_filter.with_rule(u, rules))


def test_url_filter_equals_its_sql(spark, tmp_path):
    """Random trees of paths, with words, numbers, variable segments and ends at every level."""
    import duckdb

    rng = np.random.default_rng(14)
    words = ["news", "shop", "tag", "user"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    pages = []
    for i in range(1500):
        parts = [words[int(min(rng.geometric(0.3) - 1, 3))] if rng.random() < 0.7 else words[int(rng.integers(40))] for _ in range(int(rng.integers(0, 5)))]
        pages.append((i, f"http://{('a', 'b', 'c')[int(min(2, rng.geometric(0.6) - 1))]}.site/{'/'.join([*parts, str(i)] if rng.random() < 0.6 else parts)}"))
    labels = [(i, int(rng.random() < (0.2 if "shop" in u else 0.9))) for i, u in pages if rng.random() < 0.7]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.sql(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = queries.op1_url_filter(spark, str(tmp_path)).toPandas(), c.sql(queries.ORACLES["op1_url_filter"]).df()
    got, want = (x[sorted(want.columns)].sort_values("page_id").reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) == 1500 and all(((got[k] == want[k]) | got[k].isna() & want[k].isna()).all() for k in want.columns)
    assert got.template.nunique() > 10


# ---- quality


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rows = out.collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) / len(rows) > 0.97
    assert sum(r.keep for r in rows if r.quality == 1) == sum(r.quality for r in rows)


def test_posteriors_by_hand(spark):
    """Counts, priors and posteriors over the operator's own evidence, each document's share taken out of its sites' counts."""
    rng = np.random.default_rng(11)
    hosts, paths = ["a", "b", "c", None, "e"], ["x", "y", None]
    rows = [(i, "word, " * int(rng.integers(0, 40)) + "# | !" * int(rng.integers(0, 3)), hosts[int(rng.integers(0, 4))], paths[int(rng.integers(0, 3))]) for i in range(300)] + [(300, "alone, here.", "e", "x"), (5, "again, five.", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = {i: int(rng.random() < (0.9 if rows[i][2] == "a" else 0.5)) for i in range(0, 200)}
    out = quality.classify(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    by_text = defaultdict(list)
    for i, t, h, p in rows:
        by_text[i].append((h, p, t))
    model = quality.fit(np.array([quality.features(min(by_text[i], key=lambda x: quality.features(x[2]))[2]) for i in sorted(labels)]), np.array([labels[i] for i in sorted(labels)]))
    e = []
    for i, t, h, p in rows:
        x = quality.score([t], model)[0]
        e.append((i, h, p, x, labels.get(i, x)))
    n_h, g_h, n_p, g_p = (Counter() for _ in range(4))
    for _, h, p, _, v in e:
        n_h[h] += 1
        g_h[h] += v
        n_p[h, p] += 1
        g_p[h, p] += v
    m = (sum(g_h.values()) + 1) / (len(e) + 2)

    def prior(n, g, around):
        spread = sum(n[k] * (g[k] / n[k] - around(k)) ** 2 for k in n)
        inside = sum(n[k] * around(k) * (1 - around(k)) for k in n)
        spread -= inside / sum(n.values()) * len(n)
        return min(1000.0, max(2.0, inside / spread)) if spread > 0 else 1000.0

    a = prior(n_h, g_h, lambda k: m)
    b = prior(n_p, g_p, lambda k: (g_h[k[0]] + a * m) / (n_h[k[0]] + a))
    want = []
    for i, h, p, x, v in e:
        of_host = (g_h[h] - v + a * m) / (n_h[h] - 1 + a)
        site = min(0.999, max(0.001, (g_p[h, p] - v + b * of_host) / (n_p[h, p] - 1 + b)))
        odds = np.log(x / (1 - x)) + np.log(site / (1 - site)) - np.log(m / (1 - m))
        want.append((i, x, site, 1 / (1 + np.exp(-odds))))
    assert np.allclose(sorted((r.doc_id, r.p_doc, r.p_site, r.p) for r in out), sorted(want), atol=1e-7)
    assert all(r.keep == (r.p >= 0.5) for r in out)


def test_the_fit_draws_the_same_rows(spark):
    rows = [(i, f"text {i}, " * (i % 7), "a", "x") for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    models = [quality.document_model(d, x, "doc_id", "text", 50) for d, x in ((docs, labels), (docs.repartition(7), labels.orderBy(F.desc("doc_id"))))]
    assert models[0] == models[1]


def test_quality_of_all_cases(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (7, None), (99, 1), (None, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.keep_good(docs, labels, keep_at=0.0).columns == docs.columns
    assert quality.keep_good(docs, labels, keep_at=0.0).count() == docs.count()
    none = labels.filter("false")
    assert quality.classify(docs, none).filter("keep").count() == docs.count()
    assert quality.classify(empty, labels).count() == 0 and quality.keep_good(empty, none).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "some plain words here", "big", "x") for i in range(200)] + [(1000, "some plain words here", "small", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(200)] + [(1000, 0)], "doc_id long, quality int")
    site = {r.doc_id: r.p_site for r in quality.classify(docs, labels).collect()}
    assert site[1000] > 0.3 and abs(site[0] - 0.9) < 0.05


# ---- lines


def lines(text):
    return [x for x in map(str.strip, text.split("\n")) if x]


def test_patience():
    a, b = [(i, x) for i, x in enumerate("abcdxefg")], [(i, x) for i, x in enumerate("zabxcdefyg")]
    got = line_dedup.patience(a, b)
    assert [x for x, _ in got] == sorted({x for x, _ in got}) and all(dict(a)[x] == dict(b)[y] for x, y in got)
    assert "".join(dict(a)[x] for x, _ in got) == "abcdefg"
    again = line_dedup.patience([(i, "q") for i in range(4)], [(i, "q") for i in range(3)])
    assert len(again) == 3


def test_line_dedup_of_all_cases(docs, empty):
    out = line_dedup.dedup(docs, "doc_id", "text")
    got = {(r.doc_id, r.text): r for r in out.collect()}
    by = {i: r for (i, _), r in got.items()}
    source = {r.doc_id: r.text for r in docs.collect()}
    assert by[1].text == source[1] and lines(by[2].text) == [] and by[2].n_removed == 3 and by[2].blocks == 1
    assert lines(by[8].text) == ["Something else that only this text says."] and by[8].n_lines == 3 and by[8].blocks == 2
    assert by[3].text is None and all(by[i].text == source[i] for i in (4, 5, 6, 7, 9, None))
    assert line_dedup.dedup(empty, "doc_id", "text").count() == 0
    assert {"lang", "source", "id", "n", "p", "h"} <= set(out.columns)


def test_lines_go_only_where_an_earlier_document_has_them(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = dict(docs.select("doc_id", "text").collect())
    after = {r.doc_id: r for r in line_dedup.dedup(docs, "doc_id", "text").collect()}
    first = {}
    for i in sorted(before):
        for x in lines(before[i]):
            first.setdefault(x, i)
    missed = 0
    for i in sorted(before):
        gone = Counter(lines(before[i])) - Counter(lines(after[i].text))
        assert sum(gone.values()) == after[i].n_removed and all(first[x] < i for x in gone)
        missed += sum(first[x] < i and len(x.split()) >= 5 for x in lines(after[i].text))
    again = sum(n - 1 for t in before.values() for n in Counter(lines(t)).values())
    assert missed <= again  # only a line's second use within a document may stay


def shared_runs(text, other, least=5):
    """The rows of ``pair_blocks`` for two lists of lines, by comparing all runs of ``text`` with all of ``other``."""
    words = lambda x: [len(y.split()) for y in x]
    mine, there = ({(tuple(t[x : y + 1])): [] for x, y in line_dedup.windows(words(t), least)} for t in (text, other))
    for t, at in ((text, mine), (other, there)):
        for x, y in sorted(line_dedup.windows(words(t), least)):
            at[tuple(t[x : y + 1])].append(x)
    return [(p, words(run), list(run), q, 2) for run, at in mine.items() if run in there for p, q in zip(at, there[run])]


def cuts_of(text, other, least=5):
    return line_dedup.pair_blocks(shared_runs(text, other, least), least, 8)


def test_moved_blocks_go_too():
    order = lambda it: [f"line number {p} of these lines" for p in it]
    assert sorted(cuts_of(order([*range(20, 40), *range(20)]), order(range(40)))) == [(0, 19), (20, 39)]
    assert len(cuts_of(order(range(39, -1, -1)), order(range(40)))) == 40
    assert line_dedup.cut("one two three four five\n\nsix seven eight nine ten\nx", [(1, 1)]) == "one two three four five\n\nx"


def test_without_unique_lines_occurrences_count():
    """P Q P against Q P Q: no line is unique in both, and neither end is common; each has a P and a Q of the other's."""
    p, q = "P " * 5, "Q " * 5
    assert sorted(cuts_of([p, q, p], [q, p, q])) == [(0, 0), (1, 1)]
    a, b = ([(i, x) for i, x in enumerate(t)] for t in ("PQP", "QPQ"))
    assert line_dedup.patience(a, b) == [(1, 0), (2, 1)]
    assert cuts_of([p, "x", p], ["y", p, "z"]) == [(0, 0)] and cuts_of([p], ["P " * 4]) == []


def test_long_reversed_documents_are_aligned_in_time():
    import time

    text, at = [f"line {i} has five words" for i in range(20_000)], time.time()
    rows = [(i, [5], [i], 19_999 - i, 2) for i in range(20_000)]
    assert len(line_dedup.pair_blocks(rows, 5, 8)) == len(text) and time.time() - at < 5


def test_nothing_goes_but_what_is_aligned(spark, monkeypatch):
    """The blocks come from the alignment alone, and from lines that the run's first document doesn't own, too."""
    a, b, c = ([f"{w} line number {i} of this text" for i in range(4)] for w in "abc")
    rows = [(1, a), (2, b), (3, a + c + b), (4, c + ["x"] + a)]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(df, "doc_id", "text").collect()}
    assert got == {1: 0, 2: 0, 3: 8, 4: 8}
    of = lambda partner, owner, run, at, there: (partner, owner, at, [7] * len(run), run, there, 2)
    both = [of(3, 3, [1, 2], 0, 9), of(3, 1, [5, 6], 7, 2), of(1, 1, [5, 6], 7, 0)]
    assert line_dedup.document_blocks(both, 5, 8) == [(0, 1, 3), (7, 8, 1)]
    monkeypatch.setattr(line_dedup, "aligned", lambda *_: [])
    assert line_dedup.document_blocks(both, 5, 8) == []


@pytest.mark.parametrize("size, least", [("sf0.001", 1.0), ("sf0.01", 0.999)])
def test_all_pairs_by_brute_force(spark, sf_dir, size, least):
    """Every pair of documents that share a run is aligned by the same diff. Of the lines that go then, each as often as it goes
    for one of the earlier documents, all go in sf0.001, and all but one in a thousand in sf0.01; nothing else goes."""
    docs = spark.read.parquet(f"{sf_dir}/../{size}/documents.parquet")
    text = {r.doc_id: lines(r.text or "") for r in docs.collect()}
    cuts = {r.id: {p for c in r.cuts for p in range(c["first"], c["last"] + 1)} for r in line_dedup.find_blocks(docs, "doc_id", "text").collect()}
    holders, due, gone = {}, 0, 0
    for j in sorted(text):
        words = [len(x.split()) for x in text[j]]
        runs = {tuple(text[j][x : y + 1]) for x, y in line_dedup.windows(words, 5)}
        earlier = {i for run in runs for i in holders.get(run, ())}
        places, most = set(), Counter()
        for i in earlier:
            own = {p for x, y in cuts_of(text[j], text[i]) for p in range(x, y + 1)}
            places |= own
            most |= Counter(text[j][p] for p in own)
        for run in runs:
            holders.setdefault(run, []).append(j)
        lost = cuts.get(j, set())
        assert lost <= places, (j, sorted(lost - places))
        due, gone = due + sum(most.values()), gone + sum((most & Counter(text[j][p] for p in lost)).values())
    assert due > 100 and gone >= least * due, (gone, due)


def test_links_through_third_documents(spark):
    """The third is a copy of the second, whose first line the first document has."""
    rows = [(1, "ab cd"), (2, "ab cd\nef gh\nij kl"), (3, "ab cd\nef gh\nij kl"), (4, "ef gh\nij kl\nmn op"), (5, "x\nef gh\nij kl\nmn op")]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, _cuts int, CUTS int, cut_id int")
    out = line_dedup.dedup(df, "doc_id", "text")
    got = {r.doc_id: lines(r.text) for r in out.collect()}
    assert got == {1: ["ab cd"], 2: lines(rows[1][1]), 3: [], 4: lines(rows[3][1]), 5: ["x"]}
    assert out.columns == [*df.columns, "n_lines", "n_removed", "blocks"] and {(r["_cuts"], r["CUTS"], r["cut_id"]) for r in out.collect()} == {(7, 8, 9)}


def test_an_owner_with_many_repeats(spark):
    line, n = "one line of just seven words here", 3000
    rows = [(1, "\n".join([line] * n)), (2, f"{line}\n{line}"), (3, "\n".join([line] * (n + 2))), (4, f"own words\n{line}")]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0, 2, n, 1] and lines(got[4].text) == ["own words"]


def test_a_common_line_makes_no_pairs(spark):
    rows = [(i, f"A line that very many of the documents share.\nand number {i} says something of its own") for i in range(300)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert out.agg(F.sum("n_removed")).first()[0] == 299


def test_short_lines_go_with_their_block(spark):
    """Short lines inside a block, and at its ends, first stand in a third document; one is repeated."""
    a = "This line of a text has seven words."
    b = "And so has this other line of it."
    block = f"Les.\n{a}\nLes.\n\nTo to.\n{b}\nTo to."
    rows = [(1, "Les.\nTo to.\nSome words of its own are here."), (2, block), (3, block), (4, f"Before the block is another line.\n{block}"), (5, "a\nb\nc\nd\ne\nf"), (6, "x\nb\nc\nd\ne\nf\ny"), (7, "a\nb\nc\nd\nf")]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert all(got[i].text == dict(rows)[i] for i in (1, 2, 5, 7))
    assert lines(got[3].text) == [] and (got[3].n_removed, got[3].blocks) == (6, 1)
    assert lines(got[4].text) == ["Before the block is another line."] and (got[4].n_removed, got[4].blocks) == (6, 1)
    assert lines(got[6].text) == ["x", "y"]


def test_windows_cover_every_block():
    rng = np.random.default_rng(6)
    for _ in range(60):
        words = [int(x) for x in rng.integers(1, 8, int(rng.integers(1, 12)))]
        found = line_dedup.windows(words, 5)
        for x in range(len(words)):
            for y in range(x, len(words)):
                if sum(words[x : y + 1]) >= 5:
                    assert {p for a, b in found if x <= a and b <= y for p in range(a, b + 1)} == set(range(x, y + 1))


def test_exact_copies_are_emptied(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    seen, copies = set(), []
    for i, t in sorted(docs.select("doc_id", "text").collect()):
        if len((t or "").split()) >= 5:
            copies += [i] if t in seen else []
            seen.add(t)
    left = {r.doc_id: r.text for r in line_dedup.dedup(docs, "doc_id", "text").collect()}
    assert copies and all(lines(left[i]) == [] for i in copies)


# ---- pipeline


def test_pipeline_by_its_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as pipeline

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    good, cut, once, packed = seen
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert good.columns == cut.columns == once.columns == start.columns
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
    fine = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert fine <= kept and len(bad & kept) <= 0.1 * len(bad)
    prints = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in cut.collect()}
    ids = sorted(prints)
    root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bits(prints[a], prints[b]) <= 3])
    assert {r.doc_id for r in once.collect()} == set(root.values())
    assert {r.doc_id for r in packed.collect()} == set(root.values())
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    last = pipeline.run(spark, sf_dir)
    key = lambda d: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in d.collect())
    assert key(last) == key(packed)


def jaccard(a, b):
    a, b = ({*zip(*(w[i:] for i in range(5)), strict=False)} if len(w) >= 5 else {tuple(w)} - {()} for w in (t.encode().lower().split() for t in (a, b)))
    return len(a & b) / max(1, len(a | b))


def test_odd_bins_are_no_more_than_what_differs(spark):
    sets = [np.unique(x) for x in np.random.default_rng(9).integers(-(2**63), 2**63, (20, 900))]
    pairs = [(a, b) for i, a in enumerate(sets) for b in (sets[i - 1], np.unique([*a[i:], *sets[i - 1][:40]]), np.unique([*a, *sets[i - 1][: 150 + i]]), a[:700], a[:4])]
    ends = lambda s: (len(s), similar.odd_bins(s).tolist())
    df = spark.createDataFrame([(k, *ends(a), *ends(b)) for k, (a, b) in enumerate(pairs)], "k int, n int, odd array<long>, m int, other array<long>")
    x, y = df.select("k", "n", "odd").alias("x"), df.select(F.col("k").alias("j"), F.col("m").alias("n"), F.col("other").alias("odd")).alias("y")
    seen = {r.k for r in x.join(y, (F.col("k") == F.col("j")) & similar.near("x", "y")).collect()}
    want = {k for k, (a, b) in enumerate(pairs) if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))}
    assert want <= seen and len(want) > 20 and len(seen) < len(want) + 30


@pytest.mark.parametrize(("crowd", "most"), [(256, 10), (3, 10**6), (3, 0), (1, 10**6)])
def test_similar_connects_all_pairs(spark, crowd, most):
    rng = np.random.default_rng(5)
    rows, common = [(0, "One two"), (1, "one  two"), (2, ""), (3, None), (4, "a b c d e f g h"), (5, "a b c d e f g h i"), (6, "a b c d e f g h j k")], " ".join(f"c{i}" for i in range(12))
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(20, 120)))]
        for _ in range(4):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 20))):
                copy[at] = "x" + str(rng.integers(0, 10**6))
            rows.append((len(rows), " ".join(copy) + (" " + common if k % 2 else "")))
    df = spark.createDataFrame([*rows, (None, rows[10][1])], "doc_id long, text string")
    got = [(r.src, r.dst) for r in similar.similar(df, "doc_id", "text", crowd=crowd, most=most).collect()]
    text = {i: t or "" for i, t in rows}
    want = [(a, b) for a in text for b in range(a) if jaccard(text[a], text[b]) >= 0.8]
    assert all(jaccard(text[a], text[b]) >= 0.8 for a, b in got) and len(want) > 60
    assert roots(list(text), got) == roots(list(text), want)


def test_pipeline_keeps_no_near_copies(spark, sf_dir):
    import corpus_pipeline as pipeline

    ids = (4, 3330, 1798, 8873)  # 0.8 or more alike, and more than 3 bits apart
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet").filter(F.col("doc_id").isin(*ids))
    cut = pipeline.line_dedup(spark, docs, sf_dir)
    text = {r.doc_id: r.text for r in cut.collect()}
    assert all(jaccard(text[a], text[b]) >= 0.8 and bits(*(simhash.fingerprint(text[x].encode()) for x in (a, b))) > 3 for a, b in (ids[:2], ids[2:]))
    assert {r.doc_id for r in pipeline.simhash_near_dedup(spark, cut, sf_dir).collect()} == {4, 1798}


def test_pipeline_keeps_no_exact_copies(spark, sf_dir):
    import corpus_pipeline as pipeline

    start = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet")
    first, ids = {}, [0, 653, 1227, 2131, 2159, 2437, 2700, 3261, 3404]
    text = {r.doc_id: r.text for r in start.select("doc_id", "text").collect()}
    for i in sorted(text):
        first.setdefault(text[i], i)
    # the copies, their originals, and the first holders of their lines
    holders = {}
    for i in sorted(text):
        for x in lines(text[i] or ""):
            holders.setdefault(x, i)
    ids = {*ids, *(first[text[i]] for i in ids), *(holders[x] for i in ids for x in lines(text[i]))}
    docs = start.filter(F.col("doc_id").isin(*ids))
    for _, stage in pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf_dir)
    left = {r.doc_id for r in docs.collect()}
    assert len(ids) > 20 and not [i for i in left if first[text[i]] != i]


def test_line_stage_leaves_columns_alone(spark, sf_dir):
    import corpus_pipeline as pipeline

    rows = [(1, "a line of more than five words", 77, "x", 1.5), (2, "a line of more than five words\nb", 78, "y", 2.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed string, blocks double").withColumn("n_chars", F.length("text").cast("long"))
    out = pipeline.line_dedup(spark, df, sf_dir)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(*rows[0], 30), (2, "b", *rows[1][2:], 1)]


def test_pipeline_of_all_cases(docs, empty, spark, sf_dir):
    import corpus_pipeline as pipeline

    for d in (docs.drop("id"), empty.drop("id")):
        x = d.withColumn("n_chars", F.length("text").cast("long"))
        for _, stage in pipeline.STAGES:
            x = stage(spark, x, sf_dir)
        x.collect()
