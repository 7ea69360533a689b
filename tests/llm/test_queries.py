"""The registered queries, and the pipeline, on a small folder of tables against plain versions written here."""

import hashlib
import math
import os
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tsengine.llm import chat, common, lm, media, packing, pieces, quality, simhash, toxicity, url_filters
from tsengine.llm.queries import QUERIES

WORDS = "river stone candle orchard winter harbour letter garden copper bridge silver meadow thunder window lantern forest market village".split()


def prose(seed, n, words=None):
    rng = np.random.default_rng(seed)
    return ". ".join(" ".join(rng.choice(words or WORDS, 12)).capitalize() for _ in range(n // 12)) + "."


def varied(seed, n):
    """Text whose five-word shingles are its own."""
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[int(x) % len(WORDS)]}{int(x) % 977}" for x in rng.integers(0, 10**6, n))


def edited(text, seed, changes):
    words, rng = text.split(), np.random.default_rng(seed)
    for i in rng.choice(len(words), changes, replace=False):
        words[i] = f"changed{seed}x{i}"
    return " ".join(words)


def documents():
    base, other = varied(1, 300), varied(2, 260)
    texts = [None, "", " \n\t ", "one word", "😀 漢字 Ünïcode\x00 end", "x" * 30_000, prose(3, 5000), "#*$ " * 60, "AA BB CC\n" * 40]
    texts += [prose(10 + i, 120) for i in range(12)] + [prose(30, 200) + " vile scum wretch"] * 2
    texts += [base, base, base.upper(), edited(base, 1, 2), edited(base, 2, 4), edited(base, 3, 30), other, edited(other, 4, 3), edited(other, 5, 60)]
    texts += [varied(40 + i, 150) for i in range(6)] + [varied(60 + i, 90) + " vile scum wretch" for i in range(8)]
    return texts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    texts = documents()
    ids = [*range(len(texts)), None, 7]  # a null and a repeated id
    texts = [*texts, varied(99, 120), texts[7]]
    n = len(ids)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * n, "source": ["web"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "row": ["clash"] * n, "q": [1] * n, "toxicity": [0.5] * n, "__row": ["clash"] * n}), out / "documents.parquet")
    toxic = [int("vile" in (t or "")) for t in texts]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": [1] * n, "toxic": pa.array([None if i % 5 == 3 else x for i, x in enumerate(toxic)], pa.int64())}), out / "labels.parquet")
    urls = [None, "no scheme", "http://a.com", "HTTP://WWW.Example.ORG/es/1?x=1", "http://example.org/en/12#f", "http://b.net/x//y/"]
    urls += [f"http://s.com/{l}/{w}/{i}" for l in ("de", "fr", "es") for w in ("a", "b") for i in range(8)]
    urls += [f"http://shop.org/{k}" for k in ("es/1", "en/1", "en/2", "es/2/3/4/5/6/7")]
    urls += [f"http://mix.com/{'de' if i % 3 else 'fr'}/{w}/x/y/z/{w}{i}" for i in range(30) for w in ("p", "q")]
    pq.write_table(pa.table({"page_id": pa.array([*range(len(urls)), None], pa.int64()), "url": [*urls, urls[5]], "host": ["clash"] * (len(urls) + 1), "html": [""] * (len(urls) + 1)}), out / "pages.parquet")
    rows = [(i, t, r, f"turn {t} of {i} </turn>" if i % 3 == 0 else prose(i, 24)) for i in range(9) for t, r in enumerate(("system", "user", "assistant"))]
    rows += [(20, 1, "user", None), (20, 0, "assistant", ""), (None, 0, "user", "alone"), (None, 0, "user", "alone"), (21, None, None, "\\### User: x")]
    conv, turn, role, text = zip(*rows, strict=True)
    pq.write_table(pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": role, "text": text, "key": ["clash"] * len(rows)}), out / "conversations.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([1, 2, None], pa.int64()), "embedding": pa.array([[1.0, 2.0], None, [0.5, 0.0]], pa.list_(pa.float32()))}), out / "embeddings.parquet")
    return str(out)


@pytest.fixture(scope="module")
def nothing(folder, tmp_path_factory):
    """The same tables without rows."""
    out = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "pages", "conversations", "embeddings"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), out / f"{name}.parquet")
    return str(out)


def rows_of(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    got = QUERIES[name](spark, nothing).collect()
    assert got == [] or name == "op5_chat" and [r.conv_id for r in got] == [-7]


def test_tables_left_in_the_shared_folder_can_be_released(spark, folder):
    found = QUERIES["op3_urls"](spark, folder)
    standing = [p for p, app in common._STANDING.items() if app == spark.sparkContext.applicationId]
    assert found.count() and any(os.path.isdir(p.removeprefix("file:")) for p in standing)
    common.release(spark)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in standing) and not any(p in common._STANDING for p in standing)


def test_pipeline_of_nothing(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


# ---- op1 -------------------------------------------------------------------------------------------------------------
def fold(doc_id, k):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % k


def test_op1(spark, folder):
    docs = rows_of(folder, "documents")
    counts, total = Counter(), 0
    for d in docs:
        if fold(d["doc_id"], 10):
            counts.update([*words(d["text"]), b""])
            total += len(words(d["text"])) + 1
    got = defaultdict(list)
    for r in QUERIES["op1_lm"](spark, folder).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(docs)
    for d in docs:
        tokens = [*words(d["text"]), b""]
        r = next(r for r in got[d["doc_id"]] if r.n_tokens == len(tokens))
        assert r.held_out == (fold(d["doc_id"], 10) == 0) and r.train_tokens == total and r.n_known == sum(counts[t] > 0 for t in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in tokens))
        assert r.score < 0


@pytest.fixture(scope="module")
def lexicon():
    rng = np.random.default_rng(0)
    names = [b"%c%c%d" % (97 + i % 26, 97 + i % 7, i) for i in range(2600)]
    n = sorted(rng.zipf(1.3, len(names)).clip(1, 10**5).tolist(), reverse=True)
    others = {b: (int(x), int(y)) for b, x, y in zip(range(0, lm.OTHERS, 2), rng.integers(5, 90, 99), rng.integers(1, 5, 99), strict=False)}
    total = sum(n) + 700 + sum(x for x, _ in others.values())
    return lm.Lexicon(names, n, 700, total, len(names) + 1 + sum(y for _, y in others.values()), others), names, n, others


def test_probabilities_add_up_and_are_a_softmax(lexicon):
    held, names, n, others = lexicon
    model = lm.Model(held)
    rng = np.random.default_rng(1)
    assert held.groups > 10
    for _ in range(30):  # the tables must follow what was learned
        texts = [b" ".join(rng.choice(names, 60)) + b" unheard-of" for _ in range(8)]
        _, at, sizes = held.places(texts)
        model.learn(*held.sequences(at, sizes)[:4], rng)
    scorer = lm.Scorer(held, model)
    for one, two in ((lm.END, lm.END), (3, 900), (held.classes - 1, lm.END + 1)):
        place = np.array([held.place[w] for w in names])
        member = held.member_at[place]
        p = 10 ** scorer(held.of_place[place], member, np.full(len(place), one), np.full(len(place), two))
        end = 10 ** scorer(np.array([lm.END]), np.array([-1]), np.array([one]), np.array([two]))[0]
        share = 10 ** scorer(np.arange(lm.OTHERS), np.full(lm.OTHERS, -1), np.full(lm.OTHERS, one), np.full(lm.OTHERS, two))
        outside = sum(share[b] * (tokens + lm.SMOOTH * kinds + lm.SMOOTH) for b in range(lm.OTHERS) for tokens, kinds in [others.get(b, (0, 0))])
        assert p.sum() + end + outside == pytest.approx(1, abs=1e-4)
        # A direct softmax, first over classes, then over a group's words.
        sums = model.context[one] * model.place[0] + model.context[two] * model.place[1]
        classes = np.exp((model.target @ sums + model.bias).astype(np.float64))
        for w in (0, 1500, 2599):
            c, m = held.of_place[w], held.member_at[w]
            direct = classes[c] / classes.sum()
            if m >= 0:
                inside = np.flatnonzero(held.group == held.group[m])
                odds = np.exp((model.member[inside] @ model.inner[one] + model.member_bias[inside]).astype(np.float64))
                direct *= odds[inside == m][0] / odds.sum()
            assert p[w] == pytest.approx(direct, rel=1e-3)


def test_the_model_depends_on_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(lm, "EACH", 4000)  # several replicas and rounds
    rng = np.random.default_rng(4)
    pairs = [(a, WORDS[(i + 1) % len(WORDS)]) for i, a in enumerate(WORDS)]  # each word has its usual follower
    texts = [" ".join(x for j in rng.integers(0, len(pairs), 40) for x in pairs[j]) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    found = []
    for parts in (1, 8):
        got = lm.scores(df.repartition(parts, "text"), "doc_id", "text", lm.fold_column(F.col("doc_id"), 10) != 0).collect()
        found.append({r.doc_id: r for r in got})
    assert max(abs(found[0][i].score - found[1][i].score) for i in found[0]) < 1e-9
    held_out = [r for r in found[0].values() if r.held_out]
    assert len(held_out) > 5 and sum(r.score for r in held_out) > 0.95 * sum(r.base_score for r in held_out)


def plain_nce(texts, lexicon):
    """The walk token by token in float64: parameters after noise-contrastive steps with Adagrad."""
    fresh, k = np.random.default_rng(7), lexicon.classes
    context, target = (fresh.normal(0, 0.1, (k, lm.DIMENSIONS)).astype(np.float32).astype(float) for _ in range(2))
    inner, member = (fresh.normal(0, 0.1, (n, lm.INNER)).astype(np.float32).astype(float) for n in (k, len(lexicon.group)))
    p = {"context": context, "target": target, "place": np.ones((2, lm.DIMENSIONS)), "bias": np.log(lexicon.unigram), "inner": inner, "member": member, "member_bias": np.log(lexicon.member_share)}
    squares = {name: np.full(x.shape, 1e-8) for name, x in p.items()}
    tokens = []
    for text in texts:
        one = two = lm.END
        for w in [*words(text), None]:
            at = None if w is None else lexicon.place[w]
            c, m = (lm.END, -1) if w is None else (int(lexicon.of_place[at]), int(lexicon.member_at[at]))
            tokens.append((c, m, one, two))
            one, two = c, one
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    rng, log_k = np.random.default_rng((0, 0)), math.log(lm.NOISE)
    for start in range(0, len(tokens), lm.BATCH):
        batch = tokens[start : start + lm.BATCH]
        steps = {name: np.zeros_like(x) for name, x in p.items()}
        drawn = [int(np.searchsorted(lexicon.unigram.cumsum(), u)) for u in rng.random(lm.NOISE)]
        noise = [int(np.searchsorted(lexicon.member_share.cumsum(), u)) for u in rng.random(lm.NOISE)] if any(m >= 0 for _, m, _, _ in batch) else []
        log_noise, log_share = np.log(lexicon.unigram), np.log(lexicon.member_share)
        for c, m, one, two in batch:
            s = p["context"][one] * p["place"][0] + p["context"][two] * p["place"][1]
            pull = np.zeros(lm.DIMENSIONS)
            for at, sign in ((c, 1), *((d, 0) for d in drawn)):
                g = sign - sigmoid(s @ p["target"][at] + p["bias"][at] - log_noise[at] - log_k)
                pull += g * p["target"][at]
                steps["target"][at] += g * s
                steps["bias"][at] += g
            steps["context"][one] += pull * p["place"][0]
            steps["context"][two] += pull * p["place"][1]
            steps["place"][0] += pull * p["context"][one]
            steps["place"][1] += pull * p["context"][two]
            if m >= 0:
                for at, sign in ((m, 1), *((d, 0) for d in noise)):
                    g = sign - sigmoid(p["inner"][one] @ p["member"][at] + p["member_bias"][at] - log_share[at] - log_k)
                    steps["inner"][one] += g * p["member"][at]
                    steps["member"][at] += g * p["inner"][one]
                    steps["member_bias"][at] += g
        for name, x in p.items():
            step = steps[name] / len(batch)
            squares[name] += step * step
            x += lm.RATE * step / np.sqrt(squares[name])
    return p


def test_op1_is_a_walk_token_by_token(spark, folder):
    docs = rows_of(folder, "documents")
    counts = Counter()
    for d in docs:
        if fold(d["doc_id"], 10):
            counts.update([*words(d["text"]), b""])
    total, end = sum(counts.values()), counts[b""]
    frequent = sorted(((w, n) for w, n in counts.items() if w), key=lambda r: (-r[1], r[0]))
    lexicon = lm.Lexicon([w for w, _ in frequent], [n for _, n in frequent], end, total, len(counts), {})
    assert lexicon.groups > 3

    def order(d):  # xxhash64 of id and text, each seeded by the one before; a null changes nothing
        h = 42
        for x in (None if d["doc_id"] is None else str(d["doc_id"]), d["text"] or ""):
            h = h if x is None else xxhash.xxh64_intdigest(x.encode(), h)
        return h - (1 << 64) if h >> 63 else h

    p = plain_nce([d["text"] for d in sorted((d for d in docs if fold(d["doc_id"], 10)), key=order)], lexicon)
    got = defaultdict(list)
    for r in QUERIES["op1_lm"](spark, folder).collect():
        got[r.doc_id].append(r)
    for d in docs:
        one = two = lm.END
        score = 0.0
        for w in [*words(d["text"]), None]:
            at = None if w is None else lexicon.place[w]
            c, m = (lm.END, -1) if w is None else (int(lexicon.of_place[at]), int(lexicon.member_at[at]))
            odds = p["target"] @ (p["context"][one] * p["place"][0] + p["context"][two] * p["place"][1]) + p["bias"]
            score += odds[c] - np.logaddexp.reduce(odds)
            if m >= 0:
                inside = np.flatnonzero(lexicon.group == lexicon.group[m])
                odds = p["member"][inside] @ p["inner"][one] + p["member_bias"][inside]
                score += odds[inside == m][0] - np.logaddexp.reduce(odds)
            elif c < lm.END:  # a word that training hasn't: its share of an empty class
                score += math.log(lm.SMOOTH / lm.SMOOTH)
            one, two = c, one
        n = len(words(d["text"])) + 1
        r = next(r for r in got[d["doc_id"]] if r.n_tokens == n)
        assert r.score == pytest.approx(score / math.log(10), abs=2e-4 * n + 1e-3)


# ---- op2 -------------------------------------------------------------------------------------------------------------
def test_op2(spark, folder):
    docs, got = rows_of(folder, "documents"), QUERIES["op2_toxicity"](spark, folder).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d["doc_id"]) for d in docs)
    for r in got:
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    assert all(r.predicted == ("vile" in text[r.doc_id]) for r in got if len(text[r.doc_id].split()) > 50)


def plain_features(text):
    """The set of places of a text's features, one feature at a time."""
    odd, even, top = int(toxicity.NEXT), int(toxicity.SKIP), 1 << 64
    bare = [w.strip(toxicity.PUNCTUATION) for w in words(text)]
    h = [xxhash.xxh3_64_intdigest(w) for w in bare]
    found = [*h, *(xxhash.xxh3_64_intdigest(b"\0" + w.decode("utf-8", "replace")[: toxicity.STEM].encode()) for w in bare)]
    found += [(a * odd + b) % top for a, b in zip(h, h[1:], strict=False)] + [(a * even + b) % top for a, b in zip(h, h[2:], strict=False)]
    return sorted({(x * odd % top) >> (64 - toxicity.BITS) for x in found})


def test_op2_is_a_walk_over_dictionaries(spark, folder):
    docs, got = rows_of(folder, "documents"), QUERIES["op2_toxicity"](spark, folder).collect()
    marks = defaultdict(int)
    for r in rows_of(folder, "labels"):
        if r["doc_id"] is not None and r["toxic"] in (0, 1):
            marks[r["doc_id"]] = max(marks[r["doc_id"]], r["toxic"])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    held = {d["doc_id"]: plain_features(d["text"]) for d in docs if d["doc_id"] in marks and fold(d["doc_id"], 4) != 2}
    sample = sorted((signed(xxhash.xxh64_intdigest(str(k).encode(), 42)), marks[k], at) for k, at in held.items())
    share = (sum(y for _, y, _ in sample) + toxicity.PRIOR * toxicity.PRIOR_ROWS) / (len(sample) + toxicity.PRIOR_ROWS)
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), math.log(share / (1 - share)), 0.0
    alpha, beta, l1, l2 = 1.0, 1.0, 6.0, 0.1

    def weight(at):
        return 0.0 if abs(z[at]) <= l1 else -(z[at] - math.copysign(l1, z[at])) / ((beta + math.sqrt(n[at])) / alpha + l2)

    for _ in range(4):
        for _, y, places in sample:
            w = {at: weight(at) for at in places}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for at in places:
                z[at] += g - (math.sqrt(n[at] + g * g) - math.sqrt(n[at])) / alpha * w[at]
                n[at] += g * g
            bias_n += g * g
            bias -= alpha / (beta + math.sqrt(bias_n)) * g
    want = Counter()
    for d in docs:
        want[d["doc_id"], round(1 / (1 + math.exp(-(sum(weight(at) for at in plain_features(d["text"])) + bias))), 5)] += 1
    assert len(sample) > 20 and Counter((r.doc_id, round(r.score, 5)) for r in got) == want


# ---- op3 -------------------------------------------------------------------------------------------------------------
def plain_tree(pages, rules):
    """Verdicts of (host, path) pairs by a recursive version of the tree over dictionaries."""

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    def segment(s):
        digits = re.sub(r"\d", "", s)
        if re.search(r"^\d+(\.[a-z]{1,5})?$", s) or len(digits) * 2 < len(s):
            return "#" + "".join(re.findall(r"\.[a-z]{1,5}$", s))
        return {"*": "%2A", "~": "%7E"}.get(s[0], s[0]) + s[1:]

    paths = defaultdict(lambda: [0, 0, 0])
    for host, path in pages:
        found = rule(host, path)
        counts = paths[host, tuple(segment(s) for s in path.split("/") if s)]
        for i, x in enumerate((1, bool(found and found[1] == "block"), bool(found))):
            counts[i] += x
    template = {}

    def grow(t, held):  # held: (key, rest, counts)
        rests = [rest for _, rest, _ in held]
        same = 0
        while all(len(r) > same for r in rests) and len({r[same] for r in rests}) == 1:
            same += 1
        t += "".join("/" + s for s in rests[0][:same])
        held = [(k, r[same:], c) for k, r, c in held]
        bad, labelled = (sum(c[i] for _, _, c in held) for i in (1, 2))
        split = 0 < bad < labelled and labelled >= url_filters.ALIKE**2
        for k, r, _ in held:
            if not r or not split:
                template[k] = t + ("/**" if r else "")
        if not split:
            return
        children = defaultdict(list)
        for k, r, c in held:
            if r:
                children[r[0]].append((k, r[1:], c))
        total = sum(c[0] for rest in children.values() for _, _, c in rest)
        if len(children) > url_filters.MOST or len(children) > url_filters.VARIABLE and total < url_filters.HELD * len(children):
            names = dict.fromkeys(children, "*")
        else:
            sums = {own: [sum(c[i] for _, _, c in rest) for i in range(3)] for own, rest in children.items()}
            groups, b, n = [], 0, 0
            for own in sorted((o for o in sums if sums[o][2]), key=lambda o: (sums[o][1] / sums[o][2], sums[o][2], sums[o][1], o)):
                x, m = sums[own][1], sums[own][2]
                p = (b + x) / (n + m)
                spread = math.sqrt(p * (1 - p) / n + p * (1 - p) / m) if n else 0
                if n and (spread == 0 or abs(x / m - b / n) / spread < url_filters.ALIKE):
                    groups[-1].append(own)
                    b, n = b + x, n + m
                else:
                    groups.append([own])
                    b, n = x, m
            unknown = [o for o in sums if not sums[o][2]]
            names = {o: o if len(g) == 1 else f"~{i}" for i, g in enumerate(groups, 1) for o in g} | {o: o if len(unknown) == 1 else "~" for o in unknown}
        below = defaultdict(list)
        for own, rest in children.items():
            below[names[own]] += rest
        for name, rest in below.items():
            grow(f"{t}/{name}", rest)

    for host in {h for h, _ in paths}:
        grow("", [((h, s), s, c) for (h, s), c in paths.items() if h == host])
    bad, labelled = (sum(c[i] for c in paths.values()) for i in (1, 2))
    everywhere = bad / labelled if labelled else 0.0
    hosts, by = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, s), c in paths.items():
        for sums in (hosts[h], by[h, template[h, s]]):
            sums[0] += c[1]
            sums[1] += c[2]
    out = []
    for host, path in pages:
        t = template[host, tuple(segment(s) for s in path.split("/") if s)]
        prior = (hosts[host][0] + url_filters.STRENGTH * everywhere) / (hosts[host][1] + url_filters.STRENGTH)
        purity = (by[host, t][0] + url_filters.STRENGTH * prior) / (by[host, t][1] + url_filters.STRENGTH)
        found = rule(host, path)
        out.append((t, found and found[0], found[1] if found else "block" if purity > url_filters.REJECT else "allow"))
    return out


def cut(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", after[len(host) :]).group()


def check_urls(df, urls, rules=url_filters.RULES):
    got = defaultdict(list)
    for r in url_filters.filter_urls(df, rules=rules).collect():
        got[r.page_id].append((r.host, r.path, r.template, r.rule, r.verdict))
    pages = [cut(u) for _, u in urls]
    for (i, _), page, plain in zip(urls, pages, plain_tree(pages, rules), strict=True):
        assert (*page, *plain) in got[i]
    assert sum(map(len, got.values())) == len(urls)


def test_op3(spark, folder):
    pages = [(p["page_id"], p["url"]) for p in rows_of(folder, "pages")]
    check_urls(spark.read.parquet(f"{folder}/pages.parquet"), pages)
    got = {r.page_id: r for r in QUERIES["op3_urls"](spark, folder).collect()}
    assert (got[3].host, got[3].rule, got[3].verdict) == ("www.example.org", "example.org/es/", "block")


def test_deep_branches_tell_verdicts_apart(spark):
    rules = (("x.net", "/a/b/c/d/e/bad/", "block"), ("x.net", "/a/b/c/d/e/good/", "allow"), ("y.net", "/ab", "allow"), ("net", "/abcd", "block"))
    urls = [f"http://x.net/a/b/c/d/e/{k}/{w}/{v}" for k in ("bad", "good", "other") for w in "pqrstuvwxyz" for v in ("m", "n")]
    urls += ["http://y.net/abcd", "http://y.net/ab", "http://y.net/*/x", "http://y.net/~1/x"]  # /abcd and y.net/ab: rules of 8 letters each
    urls += [f"http://s.net/abcd/{i}/k" for i in range(20)] + [f"http://s.net/{w}/deep/{i}/k" for w in ("abcd", "free") for i in range(15)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    check_urls(df, list(enumerate(urls)), rules)
    got = {r.template: r.verdict for r in url_filters.filter_urls(df, rules=rules).filter("host = 'x.net'").collect()}
    assert got["/a/b/c/d/e/bad/**"] == "block" and got["/a/b/c/d/e/good/**"] == "allow"


def test_long_hosts_and_paths(spark):
    urls = ["http://" + "a." * 30_000 + "org/es/1", "http://a.com/" + "d/" * 20_000, "http://a.com/de/" + "d/" * 20_000, "http://a.com/fr/" + "d/" * 19_000]
    began = time.monotonic()
    got = {r.page_id: r for r in url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert time.monotonic() - began < 120
    assert got[0].rule == "org/" and got[2].verdict == "block" and got[3].verdict == "allow"


# ---- op4 -------------------------------------------------------------------------------------------------------------
def components(n, linked):
    root = list(range(n))
    for a, b in linked:
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = [low if x == high else x for x in root]
    return root


def test_op4(spark, folder):
    docs = rows_of(folder, "documents")

    def fingerprint(text):
        w = words(text)
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(d["text"]) for d in docs]
    root = components(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for d, r in zip(docs, root, strict=True):
        if d["doc_id"] is not None:
            least[r] = min(d["doc_id"], least.get(r, 10**9))
    want = Counter((d["doc_id"], f"{p:016x}", least.get(r)) for d, p, r in zip(docs, prints, root, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, folder).collect()) == want


# ---- op5 -------------------------------------------------------------------------------------------------------------
def test_op5(spark, folder):
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in rows_of(folder, "conversations")]
    rows += [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    conversations = defaultdict(list)
    for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, *r[2:]))):
        conversations[r[0] if r[0] is not None else f"alone {i}"].append(r)
    want = Counter()
    for key, turns in conversations.items():
        whole, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        marks = sum(len(t) + len(chat.CONTROL.findall(t)) + len(f"### {chat.label(r)}: ") + len(chat.CLOSE) for *_, r, t in turns)
        want[None if isinstance(key, str) else key, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), marks] += 1
    got = Counter((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in QUERIES["op5_chat"](spark, folder).collect())
    assert got == want


@pytest.mark.parametrize("text", ["\\" * 1_000_000, "### [" * 200_000, "### [" + "a" * 1_000_000, "\\" * 500_000 + "</turn>", "\\### [x]: " * 50_000, "### User: " * 50_000])
def test_chat_takes_linear_time(text):
    began = time.monotonic()
    turns = [("user", text), ("a role]", text)]
    assert [t[:2] for t in chat.parse(chat.render(turns))] == turns
    assert time.monotonic() - began < 5


# ---- op6 -------------------------------------------------------------------------------------------------------------
def plain_posteriors(patterns):
    """EM over vote patterns (pattern -> count) in numpy; pattern -> posterior."""
    names, n = list(patterns), np.array(list(patterns.values()), float)
    plus, minus = (np.array([[v == mark for v in p] for p in names]) for mark in "+-")
    share, good, bad = 0.8, np.full(plus.shape[1], 0.9), np.full(plus.shape[1], 0.3)

    def posterior():
        odds = np.log(share / (1 - share)) + plus @ np.log(good / bad) + minus @ np.log((1 - good) / (1 - bad))
        return 1 / (1 + np.exp(-odds))

    for _ in range(quality.ROUNDS):
        g = n * posterior()
        b = n - g
        share = (g.sum() + quality.PRIOR * 0.8) / (n.sum() + quality.PRIOR)
        good, bad = ((w @ plus + quality.PRIOR * prior) / (w @ (plus | minus) + quality.PRIOR) for w, prior in ((g, 0.9), (b, 0.3)))
    return dict(zip(names, posterior(), strict=True))


def test_op6(spark, folder):
    docs, got = rows_of(folder, "documents"), QUERIES["op6_quality"](spark, folder).collect()
    posterior = plain_posteriors(Counter(r.votes for r in got))
    want = Counter()
    for d in docs:
        text = d["text"] or ""
        w = text.encode().split()
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[d["doc_id"], len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    for r in got:
        assert r.good == pytest.approx(posterior[r.votes], abs=2e-6) and r.kept == (not r.base_failed and posterior[r.votes] >= quality.KEEP)


# ---- op7, op8, op10 --------------------------------------------------------------------------------------------------
def test_op7(spark, folder):
    from tokenizers import Tokenizer

    docs, tokenizer = rows_of(folder, "documents"), Tokenizer.from_str(packing.word_tokenizer())
    want = Counter()
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[d["doc_id"], start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    got = QUERIES["op7_packing"](spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        ends = [a + n for a, n in sorted(held)]
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_op8(spark, folder):
    from sentencepiece import SentencePieceProcessor

    docs, library = rows_of(folder, "documents"), SentencePieceProcessor(model_proto=pieces.piece_model())
    got = QUERIES["op8_pieces"](spark, folder).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = Counter((d["doc_id"], len(ids), crc(ids)) for d in docs for ids in [library.encode(d["text"] or "")])
    assert Counter((r.doc_id, r.n_pieces, r.ids_crc32) for r in got) == want
    whole = pieces.encode(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", pieces.piece_model()).collect()
    digest = lambda r, s: (r.doc_id, tuple(sorted(s)))
    assert Counter(digest(r, [(x.n_pieces, x.ids_crc32, x.log_p, x.log_inclusion) for x in r.samples]) for r in got) == Counter(digest(r, [(len(x.ids), crc(x.ids), x.log_p, x.log_inclusion) for x in r.samples]) for r in whole)
    texts = defaultdict(set)
    for d in docs:
        texts[d["doc_id"]].add(d["text"] or "")
    for r in whole:
        assert len({tuple(x.ids) for x in r.samples}) == len(r.samples)
        if r.whole:
            assert {library.decode(list(r.ids))} | {library.decode(list(x.ids)) for x in r.samples} <= texts[r.doc_id]


def test_op10(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, tokenizer = rows_of(folder, "documents"), Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter()
    for d in docs:
        n = len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids)
        want[d["doc_id"], len((d["text"] or "").encode()), n, n > 512] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in QUERIES["op10_token_counts"](spark, folder).collect()) == want


# ---- op9 -------------------------------------------------------------------------------------------------------------
def test_op9(spark, folder, monkeypatch):
    monkeypatch.setattr(media, "TILE_ROWS", 100)  # long texts have many tiles
    docs, got = rows_of(folder, "documents"), QUERIES["op9_media"](spark, folder).collect()
    want = Counter()
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[d["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_payload = defaultdict(set)
    for r in got:
        by_payload[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature, r.tile_hashes))
        assert r.media_bytes > r.payload_bytes and r.n_tiles == -(-r.payload_bytes // 2400) and len(r.feature) == 16
    assert all(len(x) == 1 for x in by_payload.values())
    # The stored form of one long text, and its hash by plain means.
    payload = ((long := "x" * 30_000).encode()) + b"\xff" * (-30_000 % 576)
    stored = [media.npy(x) for _, _, x in media.tiles(np.frombuffer(payload, np.uint8).reshape(-1, 24), 100, 24)]
    r = next(r for r in got if r.n_bytes == len(long))
    assert (r.media_bytes, r.media_sha256) == (sum(map(len, stored)), hashlib.sha256(b"".join(stored)).hexdigest())


def test_area_resize_and_hash_are_means_of_areas():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (13, 24)).astype(np.uint8)
    h, w = image.shape
    small = np.zeros((8, 9))
    for y in range(8):
        for x in range(9):
            top, bottom, left, right = y * h / 8, (y + 1) * h / 8, x * w / 9, (x + 1) * w / 9
            area = [(max(0, min(i + 1, bottom) - max(i, top)) * max(0, min(j + 1, right) - max(j, left)), float(image[i, j])) for i in range(h) for j in range(w)]
            small[y, x] = sum(a * v for a, v in area) / sum(a for a, _ in area)
    assert np.allclose(media.area_resize(image, 8, 9), small)
    bits = "".join("1" if small[y, x] < small[y, x + 1] - 1e-9 else "0" for y in range(8) for x in range(8))
    assert media.difference_hash(image) == f"{int(bits, 2):016x}"


def test_media_tiles_of_good_and_bad_images(spark):
    rng = np.random.default_rng(8)
    grey, colour = rng.integers(0, 256, (70, 50), dtype=np.uint8), rng.integers(0, 256, (40, 33, 3), dtype=np.uint8)
    good = {1: media.encode_pgm(grey), 2: media.encode_bmp(grey), 3: media.encode_pgm(colour), 4: media.encode_bmp(colour)}
    plain = b"P2\n# a comment\n3 2\n300\n1 2 3\n4 5 300\n"
    bits = b"P1 4 2\n1010 0 1 0 1"
    bad = [None, b"", b"P", b"BM", b"nonsense" * 9, b"P2 1 1 255 70000", b"P2 1 1 255 -1", b"P2 1 1 255 " + b"9" * 6000, b"P2 2 2 255 1 2", b"P2 1 1 10 11", b"P5 1 1 10\n\xff", b"P1 2 1 1 7", b"P5 9999999 9999999 255\n1", b"P6 0 0 255\n", good[2][:60], good[4].replace(b"BM", b"BM", 1)[:18] + b"\xff\xff\xff\xff" + good[4][22:]]
    rows = [*good.items(), *((100 + i, x) for i, x in enumerate(bad)), (5, plain), (6, bits), (None, good[1]), (1, good[1])]
    df = spark.createDataFrame([(i, x and bytearray(x), "clash") for i, x in rows], "id long, image binary, tile string")
    got = defaultdict(list)
    for r in media.media_tiles(df, "id", "image", resize=None, tile=(32, 32)).collect():
        got[r.id].append(r)
    for i in range(len(bad)):
        assert [(r.tile_row, r.tile, r.tile_hash) for r in got[100 + i]] == [(None, None, None)]
    for i, image in ((2, grey), (3, colour), (4, colour), (None, grey)):
        back = np.zeros_like(image)
        for r in got[i]:
            x = media.from_npy(r.tile)
            assert r.tile_hash == media.difference_hash(x)
            back[32 * r.tile_row :, 32 * r.tile_col :][: x.shape[0], : x.shape[1]] = x
        assert np.array_equal(back, image)
    assert len(got[1]) == 2 * len(got[2]) == 12
    assert media.from_npy(got[5][0].tile).tolist() == [[1, 2, 3], [4, 5, 300]] and media.from_npy(got[6][0].tile).tolist() == [[0, 255, 0, 255], [255, 0, 255, 0]]
    small = media.media_tiles(df.filter("id = 3"), "id", "image", resize=(8, 8), tile=(8, 8)).first()
    assert np.array_equal(media.from_npy(small.tile), np.rint(media.area_resize(colour, 8, 8)))


HUGE = [b"99999999999", b"4294967296", b"2147483647", b"0", b"1" * 40, b"9" * 5000]
HEADERS = [b"%s %s %s 255\n" % (k, w, h) + b"\x01" * 40 for k in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6") for w in HUGE for h in HUGE]
GREY = media.encode_bmp(np.arange(12, dtype=np.uint8).reshape(3, 4))


def test_no_header_makes_decode_fail_in_another_way():
    bmps = [GREY[:at] + size + GREY[at + 4 :] for at in range(0, 54, 2) for size in (b"\xff\xff\xff\x7f", b"\x00\x00\x00\x80", b"\xff" * 4, b"\0" * 4)]
    bmps += [GREY[:18] + w + h + GREY[26:] for w in (b"\xff\xff\xff\x7f", b"\1\0\0\0") for h in (b"\xff\xff\xff\x7f", b"\0\0\0\x80")] + [GREY[:i] for i in range(len(GREY))]
    rng, failed = np.random.default_rng(9), 0
    noisy = [bytes(np.where(rng.random(len(x)) < 0.1, rng.integers(0, 256, len(x)), np.frombuffer(x, np.uint8)).astype(np.uint8)) for x in [*HEADERS, GREY] * 3]
    for image in [*HEADERS, *bmps, *noisy]:
        try:
            assert media.decode(image).size
        except (ValueError, struct.error):
            failed += 1
    assert failed > 200


def test_images_that_cannot_be_decoded_have_null_features(spark):
    good = media.encode_pgm(np.arange(48, dtype=np.uint8).reshape(2, 24))
    rows = [(1, None), (2, good), (3, HEADERS[-1]), (4, HEADERS[7]), (5, good), (6, None)]
    df = spark.createDataFrame([(i, x and bytearray(x)) for i, x in rows], "id long, image binary").coalesce(1)
    got = {r.id: r for r in media.stored_features(media.media_tiles(df, "id", "image", resize=None, tile=(1, 24)), "id").collect()}
    assert len(got) == 6 and all(got[i].payload_sha256 is None and got[i].n_tiles is None for i in (1, 3, 4, 6))
    assert got[2].n_tiles == 2 and got[2].payload_sha256 == got[5].payload_sha256 == hashlib.sha256(bytes(range(48))).hexdigest()


# ---- pipeline --------------------------------------------------------------------------------------------------------
def jaccard(s, t):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(z)) else set() for z in (s, t))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_pipeline_is_its_stages_on_plain_tables(spark, folder):
    docs = rows_of(folder, "documents")
    columns = list(docs[0])
    source = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def plain(df):
        return Counter(tuple(r[c] for c in columns) for r in df.collect())

    def as_rows(some):
        return Counter(tuple(d[c] for c in columns) for d in some)

    judged = QUERIES["op6_quality"](spark, folder).collect()
    verdict = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in judged}
    good = [d for d in docs if verdict[d["doc_id"], len(words(d["text"])), sum(len(w.decode()) for w in (d["text"] or "").encode().split())]]
    first = stages["quality"](spark, source, folder)
    assert first.columns == columns and plain(first) == as_rows(good) and 10 < len(good) < len(docs)

    clean = [d for d in good if "vile" not in d["text"]]
    second = stages["toxicity"](spark, spark.createDataFrame([tuple(d[c] for c in columns) for d in good], source.schema), folder)
    assert second.columns == columns and plain(second) == as_rows(clean) and len(clean) < len(good)

    linked = [(i, j) for i in range(len(clean)) for j in range(i) if jaccard(clean[i]["text"], clean[j]["text"]) >= 0.8]
    assert any(0.4 < jaccard(a["text"], b["text"]) < 0.8 for a in clean for b in clean) and linked
    best = {}
    for d, r in zip(clean, components(len(clean), linked), strict=True):
        if r not in best or (d["doc_id"] is None, d["doc_id"] or 0) < (best[r]["doc_id"] is None, best[r]["doc_id"] or 0):
            best[r] = d
    third = stages["near_duplicates"](spark, spark.createDataFrame([tuple(d[c] for c in columns) for d in clean], source.schema), folder)
    assert third.columns == columns and plain(third) == as_rows(best.values())

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {d["doc_id"] for d in best.values()}
    for s in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_repeated_rows_come_back_once(spark):
    rows = [(1, varied(1, 80), "a"), (1, varied(1, 80), "b"), (1, varied(2, 80), "c"), (2, varied(2, 80), "d"), (None, varied(3, 80), "e"), (None, varied(3, 80), "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df, "doc_id", "text").collect())
    assert got == sorted([("1", varied(1, 80)), ("1", varied(2, 80)), ("None", varied(3, 80))])


def test_recall_and_precision_of_near_duplicates(spark):
    """Against brute force over 700 texts: pairs on both sides of 0.8."""
    texts = []
    for b in range(25):
        base = varied(1000 + b, 240)
        texts += [base] + [edited(base, 100 * b + k, k) for k in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12)]
    texts += [varied(5000 + i, 120) for i in range(400)]
    order = np.random.default_rng(0).permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components(len(texts), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df, "doc_id", "text").collect()}
    dropped, should = set(range(len(texts))) - kept, {i for i, r in enumerate(root) if r != i}
    assert len(should) > 100 and dropped <= should and len(dropped) >= 0.98 * len(should)


def test_toxic_stage_without_labels_keeps_all(spark, folder, tmp_path):
    pq.write_table(pq.read_table(f"{folder}/labels.parquet").slice(0, 0), tmp_path / "labels.parquet")
    source = spark.read.parquet(f"{folder}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)["toxicity"](spark, source, str(tmp_path)).count() == source.count()
    assert toxicity.PRIOR < toxicity.THRESHOLD
