"""Whitening, periodic runs and repeated passages against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tsengine.llm import passages, runs, whitening
from tsengine.llm.queries import QUERIES

LONG = 2**63 - 1


# ---- op11 ------------------------------------------------------------------------------------------------------------
def embeddings(tmp_path, rows):
    ids, vectors = zip(*rows, strict=True) if rows else ((), ())
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "vector": ["clash"] * len(ids), "n": [1] * len(ids), "whitened": [2.0] * len(ids)}), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def plain_whitening(vectors):
    width = max(map(len, vectors))
    x = [[int(np.floor(float(np.float32(v)) * 64)) + 1_000_000 for v in row] + [1_000_000] * (width - len(row)) for row in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    covariance = np.cov(np.array(x, float).T, bias=True).reshape(width, width)
    values, axes = np.linalg.eigh(covariance)
    return x, sums, deviation, values[::-1], axes[:, ::-1], np.trace(covariance)


def test_op11(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (60, 40)) * np.linspace(0.2, 3, 40) @ np.linalg.qr(rng.normal(0, 1, (40, 40)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[7].tolist()) for i in range(30)]  # a common vector
    rows += [(None, base[3].tolist()), (4, base[4].tolist()), (900, base[5].tolist()[:-3]), (901, [])]
    bad = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 40), (1003, [float("inf")] + [0.0] * 39), (1004, [float("-inf")])]
    folder = embeddings(tmp_path, rows + bad)
    got = QUERIES["op11_whitening"](spark, folder).collect()
    assert Counter(r.vec_id for r in got) == Counter({k: 32 * n for k, n in Counter(i for i, _ in rows).items()})
    x, sums, deviation, values, axes, trace = plain_whitening([v for _, v in rows])
    n = len(rows)
    want = (np.array(x, float) - np.array(sums) / n) @ axes[:, :32] / np.sqrt(values[:32])
    at = {k: i for i, (k, _) in enumerate(rows)}
    sign = {}
    for r in got:
        i, k = at[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[i]) and r.explained == pytest.approx(values[k] / trace, rel=1e-8) and 0 <= r.identity_error < 1e-9
        if abs(want[i, k]) > 1e-3:
            assert sign.setdefault(k, np.sign(r.whitened * want[i, k])) == np.sign(r.whitened * want[i, k])
        assert abs(r.whitened) == pytest.approx(abs(want[i, k]), abs=1e-6)


def test_op11_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (200, 9)))], "id long, v array<double>")
    found = [whitening.fit(df.repartition(k, "id"), "v", 4) for k in (1, 7)]
    assert found[0].sums == found[1].sums and np.allclose(found[0].values, found[1].values, rtol=1e-12) and np.allclose(found[0].axes, found[1].axes, atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_op11_without_variance(spark, tmp_path, rows):
    got = QUERIES["op11_whitening"](spark, embeddings(tmp_path, rows)).collect()
    kept = [(i, v) for i, v in rows if v]
    assert sorted((r.vec_id, r.component) for r in got) == [(i, k + 1) for i, v in kept for k in range(len(v))]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (len(kept), 0, None, None, None) for r in got)


def test_whitening_of_dependent_and_large_entries(spark):
    rows = [(i, [float(x), float(2 * x), 5.0]) for i, x in enumerate((1, 2, 4, 9))]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    fitted = whitening.fit(df, "v")
    got = {r.id: r for r in whitening.whiten(df, "id", "v", fitted).collect()}
    assert fitted.known.tolist() == [True, False, False] and fitted.identity_error < 1e-12
    assert all(r.whitened[1:] == [None, None] for r in got.values()) and sum(r.whitened[0] ** 2 for r in got.values()) / 4 == pytest.approx(1)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [3e9, 2.0]), (4, [0.0, 3.0])], "id int, v array<double>")
    fitted = whitening.fit(huge, "v")
    x = [[2**62 + 10**6, 64 + 10**6], [-(2**62) + 10**6, 64 + 10**6], [int(64 * 3e9) + 10**6, 128 + 10**6], [10**6, 192 + 10**6]]
    assert fitted.sums == [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((4 * v - s) ** 2 for v, s in zip(row, fitted.sums, strict=True)) for row in x]
    assert [r.deviation for r in whitening.whiten(huge, "id", "v", fitted).orderBy("id").collect()] == [e if e <= LONG else None for e in exact]
    with pytest.raises(Exception, match="more than"):
        whitening.fit(spark.createDataFrame([([0.0] * 5000,)], "v array<double>"), "v")


# ---- op12 ------------------------------------------------------------------------------------------------------------
def plain_runs(words, least=12):
    """Every maximal stretch of every period, of which only those without a smaller period count."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in found:  # smaller periods came first
                found[i, j + q] = q
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def periodic(doc_id, words):
    h = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    kinds = rng.choice((1, 2, 2, 3, 5, 30))
    words = []
    while len(words) < rng.choice((30, 150, 400)):
        piece = [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))]
        words += piece * rng.choice((1, 1, 2, 3, 7)) + piece[: rng.randrange(len(piece) + 1)]
    for least in (2, 5, 12):
        assert runs.runs_of(np.array(words), least) == plain_runs(words, least)


def test_ordered_sets_of_many_blocks():
    rng = random.Random(5)
    order = list(range(5000))
    rng.shuffle(order)
    ends, held = runs.Ends(order[0]), {order[0]}
    for x in order[1:]:
        ends.add(x)
        held.add(x)
    assert list(ends) == sorted(held) and len(ends.blocks) > 3
    assert [ends.before(x) for x in (0, 1, 2500, 4999)] == [None, 0, 2499, 4998] and [ends.after(x) for x in (0, 2500, 4999)] == [1, 2501, None]


def documents(tmp_path, rows):
    ids, texts = zip(*rows, strict=True) if rows else ((), ())
    n = len(ids)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "key": ["clash"] * n, "same": [1] * n, "runs": [2] * n, "kept": ["x"] * n, "places": [1] * n}), tmp_path / "documents.parquet")
    return str(tmp_path)


def check_runs(spark, tmp_path, rows):
    want = Counter()
    for doc_id, text in rows:
        words = periodic(doc_id, (text or "").encode().split())
        found = plain_runs(words)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        want[doc_id, len(found), *best, best[2] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    got = QUERIES["op12_runs"](spark, documents(tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got) == want
    return got


def test_op12(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "word", "a b " * 6, "a " * 11, "a " * 12, "a\x0bb\x1cc " * 9, "x y z " * 4 + "x q", "Ünï 漢字 😀 ! " * 7]
    for i in range(80):
        words = []
        while len(words) < rng.randrange(1, 300):
            piece = [rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 20))]
            words += piece * rng.choice((1, 1, 1, 2, 3))
        texts.append(" ".join(words))
    rows = [*enumerate(texts), (None, texts[4]), (5, texts[20]), (5, texts[20])]
    got = check_runs(spark, tmp_path, rows)
    assert sum(r.n_runs > 0 for r in got) > 20 and sum(r.n_runs > 3 for r in got) > 3


def test_runs_of_long_texts(spark):
    words = [f"w{i % 5000}" for i in range(12_000)] + ["z"] * 30_000
    df = spark.createDataFrame([(1, " ".join(words)), (2, "tick tock " * 20_000), (3, " ".join(f"u{i}" for i in range(50_000)))], "id long, text string")
    got = {r.id: r for r in runs.periodic_runs(df, "id", "text").collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 12_000, 5000), (12_000, 30_000, 1)] and len(got[1].kept.split()) == 5001
    assert [tuple(r) for r in got[2].runs] == [(0, 40_000, 2)] and got[2].kept == "tick tock" and got[3].runs == [] and len(got[3].kept.split()) == 50_000


# ---- op13 ------------------------------------------------------------------------------------------------------------
def plain_passages(rows, width):
    first, texts = {}, [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in texts:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if k is not None:
                first[g] = min(k, first.get(g, k))
    out = Counter()
    for k, w in texts:
        gone = {i + j for i in range(len(w) - width + 1) if k is not None and first[tuple(w[i : i + width])] < k for j in range(width)}
        out[k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    return out


def passages_rows(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, base = fresh(21), fresh(300)
    texts = [None, "", "one two", "x " * 400, "x " * 40, " ".join(fresh(13))]
    for i in range(60):
        words = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            a = rng.randrange(280)
            words += base[a : a + rng.randrange(5, 40)] + fresh(rng.randrange(9))
        if i % 3 == 0:
            words += common * rng.choice((1, 2)) + fresh(3)
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 5 + [" ".join(base[:150] + ["edit"] + base[151:])]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[7]), (None, texts[8]), (3, texts[9]), (3, texts[10]), (3, texts[10]), (7, " ".join(base[4:90])), (7, " ".join(fresh(4) + base[4:90]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [400, 4_000_000])
def test_op13(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(passages, "chunks", lambda batch, text, inner=passages.chunks: inner(batch, text, most))  # many chunks, or one
    rows = passages_rows(1)
    got = QUERIES["op13_passages"](spark, documents(tmp_path, rows)).collect()
    want = plain_passages(rows, 13)
    assert Counter(map(tuple, got)) == want and sum(r.n_removed > 0 for r in got) > 30


@pytest.mark.parametrize("width, period", [(1, 1), (4, 2), (13, 13), (20, 7)])
def test_other_windows(spark, width, period):
    rows = passages_rows(2)
    df = spark.createDataFrame(rows, "id int, text string").repartition(5)
    got = passages.remove_repeated(df, "id", "text", width, period)
    digest = got.select("id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s.length), F.sha2("kept", 256))
    assert Counter(map(tuple, digest.collect())) == plain_passages(rows, width)


def test_difference_covers():
    for period in range(1, 14):
        cover = passages.difference_cover(period)
        assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))
    assert passages.difference_cover(7) == (0, 1, 3) and passages.difference_cover(13) == (0, 1, 3, 9)


def test_equal_keys_are_told_apart_by_their_texts(spark):
    shared, rng = [f"s{i}" for i in range(13)], random.Random(1)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(1, " ".join(shared)), (2, " ".join(fill(20) + shared)), (2, " ".join(shared + fill(20))), (2, " ".join(fill(20) + fill(13)))]
    got = defaultdict(list)
    for r in passages.remove_repeated(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect():
        got[r.id].append([tuple(s) for s in r.spans])
    assert got[1] == [[]] and sorted(got[2]) == [[], [(0, 13)], [(20, 13)]]


def test_keys_must_be_numbers(spark):
    with pytest.raises(TypeError):
        passages.remove_repeated(spark.createDataFrame([("a", "b")], "id string, text string"), "id", "text")
