"""Hard negatives, language identification and source divergence, against brute force and held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemill.llm import divergence, language, negatives

# ---- hard negatives

def brute_negatives(rows, every=100, positives=5, k=5, percent=80):
    seen = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        seen[i] = min(seen.get(i, (v, label)), (v, label))
    out = []
    for a, (v, label) in seen.items():
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, m) for i, (w, m) in seen.items() if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)

def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, label int, embedding array<double>, id int, vec string, bucket double")

def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())

@pytest.mark.parametrize("block", [7, 100, 8192])
def test_negatives_with_ties_copies_and_odd_vectors(spark, block):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 4)), (rng.integers(-3, 4, 3) / 4 * rng.choice([0.2, 1, 5])).tolist()) for i in range(240)]
    rows += [(i, i % 3, [0.5, 0.5, 0.5]) for i in range(240, 320)]  # copies with several labels
    rows += [rows[5], (7, 2, [9.0, 9.0, 9.0]), (None, 1, [1.0, 1.0, 1.0]), (400, None, [1.0, 1.0, 1.0]), (401, 1, None), (402, 1, [1.0, None, 0.0]), (403, 1, [float("nan"), 0.0, 0.0]), (404, 1, [float("inf"), 0.0, 0.0]), (500, 3, [])]
    want = brute_negatives([r if r[2] is None or len(r[2]) == 3 else (*r[:2], [0.0] * 3) for r in rows], every=10)
    got = found(negatives.hard_negatives(vectors(spark, rows), every=10, block=block))
    assert got == want and len(want) > 100

def test_negatives_of_empty_tables(spark):
    assert found(negatives.hard_negatives(vectors(spark, [(1, 1, [1.0])]).filter("false"))) == []
    assert found(negatives.hard_negatives(vectors(spark, [(100, 1, [1.0])]))) == []
    assert found(negatives.hard_negatives(vectors(spark, [(100, None, None)]))) == []

def test_negatives_beyond_doubles(spark):
    rows = [(i, i % 2, [float((1 << 22) + 3 * i), float(i)]) for i in range(8)]
    assert found(negatives.hard_negatives(vectors(spark, rows), every=2)) == brute_negatives(rows, every=2)
    with pytest.raises(Exception, match="OverflowError"):
        negatives.hard_negatives(vectors(spark, [(i, 0, [1e12]) for i in range(3)]), every=1).collect()

def test_least_scores_of_windows(spark):
    scores = [0, 1, 4, 5, 6, 99, 100, 101, 12345678901234567, (1 << 63) - 1]
    df = spark.createDataFrame([(s,) for s in scores], "s long")
    from pyspark.sql import functions as F

    for percent in (0, 33, 80, 100):
        assert [r[0] for r in df.select(negatives.ceil_share(percent, F.col("s"))).collect()] == [-(-percent * s // 100) for s in scores]

def test_norms_prune():
    """Of vectors whose norms fall off, few slices are scored, and the answers are those of all."""
    rng = np.random.default_rng(4)
    data = np.rint(rng.normal(size=(20_000, 8)) * (2000 / (1 + np.arange(20_000)))[:, None])
    ids, labels = np.arange(20_000), rng.integers(0, 5, 20_000)
    shelf = negatives.Shelf(ids, labels, data)
    asks = np.arange(0, 400, 20)
    none = np.full((len(asks), 1), negatives.LOW), np.full((len(asks), 1), negatives.HIGH)
    q, w, found, score = shelf.search(asks, data[asks], labels[asks], True, *none, 5)
    assert shelf.scored < 0.2 * len(asks) * len(ids)
    for x, a in enumerate(asks):
        s = (data @ data[a]).astype(int)
        best = sorted((-s[i], i) for i in ids if labels[i] == labels[a] and i != a)[:5]
        assert [(-t, i) for t, i in zip(score[q == x], found[q == x])] == best

# ---- languages

def test_kernel_by_hand():
    assert [sorted(set(np.concatenate(list(language.grams("Ab,  aB")))))] == [sorted({97, 98, 32, 256 + 97 * 256 + 98, 256 + 98 * 256 + 32, 256 + 32 * 256 + 97} | {language.BEGIN[2] + (x * 256 + y) * 256 + z for x, y, z in ((32, 97, 98), (97, 98, 32), (98, 32, 97))})]
    sets = [np.unique(np.concatenate(list(language.grams(t)))) for t in ("the cat", "die Katze", "le chat")]
    marks = language.Landmarks(sets)
    got = marks.kernel(["the cat", "cat", "xyz"])
    own = [set(np.concatenate(list(language.grams(t)))) & set(marks.vocabulary) for t in ("the cat", "cat", "xyz")]
    want = [[len(x & set(s)) / math.sqrt(max(1, len(x)) * len(s)) for s in sets] for x in own]
    assert np.allclose(got, want) and got[0, 0] == pytest.approx(1)
    few = language.Landmarks(sets, 5)  # those that most landmarks have
    counts = Counter(int(g) for s in sets for g in s)
    assert len(few.vocabulary) == 5 and min(counts[g] for g in few.vocabulary.tolist()) >= max(c for g, c in counts.items() if g not in few.vocabulary)

def test_long_texts_are_read_whole(monkeypatch):
    text = "über alle Maßen " * 50 + "zzz"
    whole = set(np.concatenate(list(language.grams(text))).tolist())
    monkeypatch.setattr(language, "PIECE", 7)
    assert set(np.concatenate(list(language.grams(text))).tolist()) == whole

def test_regression_equals_kernel_ridge():
    """With every text a landmark the Nyström solution is that of kernel ridge regression."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(a), 40)) for a in ("abc ", "xyz ") for _ in range(15)]
    marks = language.Landmarks([np.unique(np.concatenate(list(language.grams(t)))) for t in texts])
    k, of = marks.kernel(texts), np.repeat([0, 1], 15)
    weights = language.fit(marks, k, of, 2, 0.1)
    got = k @ weights[:-1] + weights[-1]
    y = np.where(of[:, None] == [0, 1], 1.0, -1.0)
    centred = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    want = centred @ np.linalg.solve(centred + 0.1 * len(k) * np.eye(len(k)), y - y.mean(0)) + y.mean(0)
    assert np.allclose(got, want, atol=1e-5)

def test_languages_of_all_cases(docs, empty):
    out = language.identify(docs, "doc_id", "text", "lang").collect()
    assert len(out) == docs.count()
    source = {(r.doc_id): r.text for r in docs.collect()}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in source[r.doc_id] or ""))
    assert language.identify(empty, "doc_id", "text", "lang").count() == 0
    nothing = language.identify(docs.drop("lang").withColumnRenamed("source", "lang").filter("doc_id = 3"), "doc_id", "text", "lang").collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]

def test_languages_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.identify(docs, "doc_id", "text", "lang").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    # neither language nor source of a row is an input of its own prediction

    from pyspark.sql import functions as F

    hidden = docs.withColumn("lang", F.when(~language.held_out("doc_id"), F.col("lang"))).withColumn("source", F.lit("s"))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(hidden, "doc_id", "text", "lang").filter("held_out").collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in rows}

# ---- divergence

def brute_audit(rows, least=10, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, count, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        found = terms(text)
        df[lang or ""].update(set(found))
        count[lang or "", source or ""].update(found)
    for lang in df:
        keep = [t for t, n in df[lang].items() if n >= least]
        groups = [s for x, s in count if x == lang]

        def shares(c, keep=keep):
            size = sum(c[t] for t in keep)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(keep)) for t in keep}

        p = {s: shares(count[lang, s]) for s in groups}
        q = shares(sum((count[lang, s] for s in groups), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in keep), o.encode(), o) for o in groups if o != s]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            own = [(-f(p[s][t], q[t]), t.encode(), t) for t in keep if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)

def audited(df, **given):
    return sorted(tuple(r) for r in divergence.audit(df, **given).collect())

@pytest.mark.parametrize("groups, terms, heavy", [(64, 1024, 3), (3, 5, 3), (2, 7, 1), (4, 9, 100)])
def test_audit_by_brute_force(spark, groups, terms, heavy):
    """Tiles of every size; with 1 all terms that all groups have are heavy, with 100 every term is."""
    rng = np.random.default_rng(8)
    words = [*"the of and to in que der É ß zz".split(), *(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))]
    rows = []
    for i in range(400):
        lang, n = str(rng.choice(["en", "de"])), int(rng.integers(0, 12))
        source = f"s{int(rng.integers(0, 9)) ** 2 % 11}"
        zipf = np.minimum(rng.zipf(1.4, n) - 1 + (i % 5) * (rng.random(n) < 0.3), len(words) - 1).astype(int)
        rows.append((" 1-".join(w.upper() if x else w for w, x in zip([words[z] for z in zipf], rng.random(n) < 0.2)), lang, source))
    rows += [(None, None, None), ("x", None, "a"), ("", "en", "silent"), ("one two", "fr", "a"), ("one two", "fr", "b"), (rows[3]), (rows[3])]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "text string, lang string, source string, n int, g int, term string")
    assert audited(df, block=groups, bucket=terms, heavy=heavy) == brute_audit(rows)

def test_audit_of_all_cases(docs, empty):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert audited(docs, least=1) == brute_audit(rows, 1) and audited(docs) == brute_audit(rows)
    assert audited(empty) == []

def test_shares_beyond_floats():
    a, b = np.array([9 * 10**14 + 7, 2]), np.array([10**15 + 3, 10**15 + 3])
    assert divergence.share(a, b).tolist() == [1 + 10**9 * int(x) // int(y) for x, y in zip(a, b)]
