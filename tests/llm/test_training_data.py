"""The training-data operators against plain versions, on small tables with nulls, empty and repeated texts."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tsengine.llm import chat, common, lm, media, packing, pieces, quality, simhash, token_counts, toxicity, url_filters

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions near old stone bridges every autumn".split()


def sentence(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


TEXTS = [None, "", "   ", "one", sentence(1), sentence(1), sentence(2), sentence(3, 400), "Ünïcode – 漢字 🙂\n\ttabs  and   spaces ", "<|endoftext|> a\x00b", "x" * 5000, sentence(4) + "\n" + sentence(4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", 1.0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, score string, fingerprint double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(t):
    return (t or "").encode().lower().split()


def test_token_counts_are_the_library_s(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs, "doc_id", "text", open(path, encoding="utf-8").read()))
    for i, t in enumerate(TEXTS):
        assert got[i].n_tokens == len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((t or "").encode())
    assert token_counts.token_counts(empty, "doc_id", "text", open(path, encoding="utf-8").read()).count() == 0


def test_packing_covers_every_id_once(docs, empty):
    from tokenizers import Tokenizer

    text = packing.word_tokenizer()
    tokenizer = Tokenizer.from_str(text)
    rows = packing.pack_documents(docs, "doc_id", "text", text, window=64).collect()
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(empty, "doc_id", "text", text).count() == 0


def test_frequent_words_stay_when_many_rare_ones_come(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    encoder = packing.WordIds(packing.word_tokenizer())
    special = encoder.special[0]
    words = [f"word{x}" for x in "abcdefgh"] + [special.decode(), f"x{special.decode()}y", "ÉTÉ", "日本"]
    text = " ".join(words + [f"Rare{i}!" for i in range(1000)] + words)
    assert list(np.frombuffer(encoder.encode(text.encode()), "<u4")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert all(w.encode() in encoder for w in words) and len(encoder) <= 100 and len(encoder.pieces) <= 100


def test_best_fill_is_the_best():
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(50):
        counts = Counter(rng.integers(1, 15, 6).tolist())
        best = max(x for take in product(*(range(n + 1) for n in counts.values())) if (x := sum(a * b for a, b in zip(counts, take, strict=True))) <= 23)
        chosen = packing.best_fill(dict(counts), 23)
        assert sum(k * v for k, v in chosen.items()) == best and all(v <= counts[k] for k, v in chosen.items())


def test_pieces_are_the_library_s_and_read_back(docs, empty):
    from sentencepiece import SentencePieceProcessor

    model = pieces.piece_model()
    sp = SentencePieceProcessor(model_proto=model)
    df = pieces.encode(docs, "doc_id", "text", model, k=3)
    got = by_id(df)
    for i, t in enumerate(TEXTS):
        assert got[i].ids == sp.encode(t or "") and got[i].whole
        drawn = [tuple(s.ids) for s in got[i].samples]
        assert len(drawn) == len(set(drawn)) >= 1
        assert all(sp.decode(list(s)) == (t or "") for s in drawn)
    assert by_id(pieces.decode(df, "ids", model))[8].decoded == TEXTS[8]
    assert got[4].samples == got[4].samples and len(got[3].samples) == 3
    assert pieces.encode(empty, "doc_id", "text", model).count() == 0


def test_samples_follow_the_lattice():
    held = pieces.Lattices(pieces.piece_model(), alpha=0.3)
    flat, sizes = pieces._prepared(held, ["of"])
    ways = {}

    def walk(node, edges, p):
        if node < 0:
            ways[tuple(edges)] = p
            return
        for e in range(held.first[node], held.first[node + 1]):
            walk(int(held.to[e]), [*edges, e], p + held.log_p[e])

    walk(int(held.start[flat[0]]), [], 0.0)
    assert sum(np.exp(list(ways.values()))) == pytest.approx(1)
    n = 6000
    drawn = pieces.sample(held, np.repeat(flat, n), np.repeat(sizes, n), list(range(n)), 2)
    first, second = (Counter(tuple(x[j][0].tolist()) for x in drawn) for j in (0, 1))
    for w, p in ways.items():
        p = np.exp(p)
        assert first[w] / n == pytest.approx(p, abs=0.025)
        after = sum(np.exp(q) * p / (1 - np.exp(q)) for v, q in ways.items() if v != w)
        assert second[w] / n == pytest.approx(after, abs=0.025)
    # Weighed by inclusion, the samples add up to one text on average.
    total = [sum(np.exp(p - q) for _, p, q in x) for x in drawn]
    assert np.mean(total) == pytest.approx(1, abs=0.05)
    everything = pieces.sample(held, flat, sizes, [1], len(ways) + 3)[0]
    assert {tuple(x[0].tolist()) for x in everything} == set(ways) and all(q == 0 for *_, q in everything)


def test_samples_do_not_depend_on_blocks_and_leave_from_their_nodes(docs, monkeypatch):
    held = pieces.Lattices(pieces.piece_model())
    texts = [sentence(i, 40) for i in range(30)] + ["", " ", "\u3042x" * 50, "word " * 20]
    key = np.arange(400)
    keys = held.ways[held.ways >= 0]
    assert (held.lead(keys) >= 0).all() and len(np.unique(held.lead(keys))) == len(keys) and (held.lead(keys.max() + 1 + key) == -1).all()
    flat, sizes = pieces._prepared(held, texts)
    walker, step, node, edge = held.walk(held.start[flat], np.arange(1, len(flat) + 1).astype(np.uint64), np.zeros(len(flat), np.int64))
    assert ((held.first[node] <= edge) & (edge < held.first[node + 1])).all() and (np.diff(walker) >= 0).all()
    assert (step == np.r_[[0], np.where(np.diff(walker) > 0, 0, step[:-1] + 1)]).all() and (held.to[edge[np.r_[np.diff(walker) > 0, True]]] == -1).all()

    def found():
        return {(r.doc_id, r.n_pieces, r.ids_crc32, r.whole, *((x.n_pieces, x.ids_crc32, round(x.log_p, 6), round(x.log_inclusion, 6)) for x in r.samples)) for r in pieces.encode(docs, "doc_id", "text", pieces.piece_model(), lists=False).collect()}

    first = found()
    monkeypatch.setattr(pieces, "LEARNED", 7)
    monkeypatch.setattr(pieces, "SAMPLED_BYTES", 500)
    again = found()
    assert first == again


def test_texts_are_cut_where_no_piece_runs_on(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    model = pieces.piece_model()
    sp = SentencePieceProcessor(model_proto=model)
    names = ["river", "Stone", "lamp", "Cloud", "garden", "Winter", "paper", "Ocean", "silver", "Train", "forest", "Music"]
    held = pieces.Lattices(model, alpha=0.3)
    pieces._prepared(held, [f"{a}.\n{b}" for a in names for b in names])
    assert len(held.at) <= 3 * len(names)  # and not one for each of their 144 pairs

    rng = np.random.default_rng(5)
    letters = list("ab,.XY\n\n  \t\r\0{}'\u00e9\u3042\u2581\u0301\U0001f600")
    texts = ["", " ", "\n", "\u2581", "a ", " a", "\n ", "a\n\nb", "  \u2581\u2581 ", "\n".join(map(chr, range(0x21, 0x3000))), *("".join(rng.choice(letters, n)) for n in rng.integers(1, 60, 400))]
    for alone in (True, False):
        monkeypatch.setattr(pieces, "merges_alone", lambda _, alone=alone: alone)
        other = pieces.Lattices(model)
        assert (other.mark is None) != alone
        flat, sizes = pieces._prepared(other, texts)
        ids, at = other.encoding(flat, sizes)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [sp.encode(t) for t in texts]
        assert len(flat) == sizes.sum() and other.whole.all()

    # A cut text has the law of its uncut lattice.
    text, ways = "\u2581in,of", {}
    piece = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}

    def spell(at, ids):
        if at == len(text):
            ways[tuple(ids)] = np.exp(held.weight[ids].sum())
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in piece:
                spell(end, [*ids, piece[text[at:end]]])

    spell(0, [])
    n, mass = 6000, sum(ways.values())
    flat, sizes = pieces._prepared(held, ["in,of"])
    assert len(flat) > 1
    drawn = pieces.sample(held, np.tile(flat, n), np.repeat(sizes, n), list(range(n)), 2)
    assert {len(x) for x in drawn} == {2}
    for j in (0, 1):
        seen = Counter(tuple(x.tolist()) for x in held.spell([x[j][0] for x in drawn]))
        for ids, w in ways.items():
            p = w / mass
            want = p if j == 0 else sum(v / mass * p / (1 - v / mass) for other, v in ways.items() if other != ids)
            assert seen[ids] / n == pytest.approx(want, abs=0.025)
        assert set(seen) <= set(ways)
    assert all(p == pytest.approx(np.log(ways[tuple(held.spell([e])[0].tolist())] / mass), abs=1e-6) for x in drawn[:50] for e, p, _ in x)
    everything = pieces.sample(held, flat, sizes, [1], len(ways) + 3)[0]
    assert {tuple(x.tolist()) for x in held.spell([e for e, *_ in everything])} == set(ways) and len(everything) == len(ways)


def test_fingerprints_and_components(docs, empty, spark):
    def plain(t, n=4):
        w = words(t)
        sh = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))

    prints = simhash.fingerprints(docs, ["doc_id"], "text", 4)
    got = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert all(int.from_bytes(got[i], "big") == plain(t) for i, t in enumerate(TEXTS))

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = [int(b) for b in base] + [int(base[i % 40]) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 8), replace=False)) for i in range(200)]
    rows = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)], "doc_id long, fingerprint binary")
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, "doc_id", 4).collect()} == {i: root(i) for i in range(len(values))}
    assert simhash.near_duplicates(simhash.fingerprints(empty, ["doc_id"], "text", 4), "doc_id", 4).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    values = sorted({base ^ sum(1 << int(x) for x in rng.choice(16, rng.integers(0, 6), replace=False)) for _ in range(1500)})
    prints = [v.to_bytes(8, "big") for v in values]
    rows = spark.createDataFrame([(bytearray(x),) for x in prints], "fingerprint binary").repartition(3)
    near = {(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    # Sets of 40 shingles in runs of ten fingerprints: those of one run are similar, those of different runs are not.
    held = {v: np.unique(np.r_[np.arange(36) + 1000 * (i // 10), 100_000 + 10 * i + np.arange(4)]).astype(np.uint64) for i, v in enumerate(values)}
    alike = {(a, b) for a, b in near if len(np.intersect1d(held[a], held[b])) * 5 >= 4 * len(np.union1d(held[a], held[b]))}
    assert 0 < len(alike) < len(near)
    sets = spark.createDataFrame([(bytearray(x), 40, 36, bytearray(held[v].tobytes())) for x, v in zip(prints, values, strict=True)], "fingerprint binary, size long, shared long, shingles binary")

    def pairs(df):
        return {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in df.collect()}

    def groups(edges):
        root = {v: v for v in values}
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            if low != high:
                root = {v: low if x == high else x for v, x in root.items()}
        return root

    index = simhash.Index(len(values), 2)
    for block_rows in (10**6, 100):
        assert groups(pairs(simhash.links_between(rows, 2, block_rows=block_rows))) == groups(near)
        met = simhash.meeting(rows, index, block_rows)
        assert {bytes(r.fingerprint) for r in met.collect()} == {v.to_bytes(8, "big") for pair in near for v in pair}
        found = met.join(sets, "fingerprint").select("part", "bits", "fingerprint", "size", "shared", "shingles")
        assert groups(pairs(simhash.similar(found, index, 320 * block_rows))) == groups(alike)
    held = spark.sparkContext.accumulator(0)
    whole = simhash.search

    def search(bucket, *rest):
        most = int(np.bincount(bucket).max())
        held.add(10**6 * (most > 300))
        held.add(1)
        return whole(bucket, *rest)

    monkeypatch.setattr(simhash, "search", search)
    simhash.links_between(rows, 2, block_rows=100).count()
    assert 0 < held.value < 10**6


def test_near_pairs_meet_in_one_bucket_each(spark):
    rng = np.random.default_rng(17)
    bases = [int.from_bytes(rng.bytes(32), "big") for _ in range(40)]
    groups = [[b] + [b ^ sum(1 << int(x) for x in rng.choice(256, 12, replace=False)) for _ in range(i % 4)] for i, b in enumerate(bases)]
    values = [x for g in groups for x in g]
    rows = spark.createDataFrame([(bytearray(x.to_bytes(32, "big")),) for x in values], "fingerprint binary").repartition(3)
    index = simhash.Index(len(values), 60, 4, 6)
    met = [(r.part, r.bits, int.from_bytes(r.fingerprint, "big")) for r in simhash.meeting(rows, index).collect()]
    together = {}
    for part, bits, x in met:
        together.setdefault((part, bits), set()).add(x)

    def share(a, b):
        words = [(a ^ b) >> 64 * (3 - w) & (1 << 64) - 1 for w in range(4)]
        return any(not any(w & m for w, m in zip(words, mask, strict=True)) for mask in index.masks)

    for g in groups:
        for i, a in enumerate(g):
            for b in g[:i]:
                assert any({a, b} <= held for held in together.values()) == share(a, b)
    for a, b in (g for g in groups if len(g) == 2):  # these were in every bucket of theirs, about eight
        assert not share(a, b) or sum(x in (a, b) for _, _, x in met) == 2


@pytest.mark.parametrize("most_bits", [1 << 27, 1 << 10])
def test_rows_that_no_key_has_are_marked(spark, monkeypatch, most_bits):
    monkeypatch.setattr(common, "MOST_BITS", most_bits)
    rows = spark.createDataFrame([(f"k{i}", i, i, "x") for i in range(2000)], "id string, page long, bitmap long, text string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 2000, 100)] * 2, "id string")
    found = common.marked(rows, keys, "id", "maybe")
    got = found.collect()
    assert found.columns == [*rows.columns, "maybe"] and sorted((r.id, r.page) for r in got) == sorted((f"k{i}", i) for i in range(2000))
    assert all(r.maybe for r in got if r.page % 100 == 0) and sum(r.maybe for r in got) < 200
    assert not any(r.maybe for r in common.marked(rows, keys.limit(0), "id", "maybe").collect())


def test_masks_follow_the_count_of_fingerprints():
    for rows, wide in ((10**5, 12), (10**7, 13), (10**9, 19)):
        exact = simhash.masks(rows, 4)
        assert min(sum(m).bit_count() for m in exact) >= wide  # about a thousand rows a bucket, or fewer
        rng = np.random.default_rng(rows % 97)
        for _ in range(200):  # whatever four bits differ, some mask shows none of them
            change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not m & change for (m,) in exact)
        several = simhash.masks(rows, 60, 4, 6)
        assert rows / 2 ** min(sum(w.bit_count() for w in m) for m in several) <= 2 * simhash.BUCKET_ROWS or rows <= 10**6
        met = 0
        for _ in range(300):  # pairs that differ in each bit with the chance that a similarity of 0.8 gives
            flips = rng.random(256) < 0.1514
            change = [sum(1 << b for b in range(64) if flips[64 * w + b]) for w in range(4)]
            met += any(not any(m & c for m, c in zip(mask, change, strict=True)) for mask in several)
        assert met >= 0.95 * 300


def test_keep_one(docs, spark):
    near = sentence(9, 300)
    rows = [(50, near), (51, near + " more"), (52, near.upper()), (53, sentence(10, 300)), (53, sentence(10, 300)), (None, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, "doc_id", "text").collect()) == [50, 53]
    assert simhash.keep_one(docs, "doc_id", "text").columns == docs.columns


def jaccard(s, t, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in (words(s), words(t)))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_keep_one_links_only_what_is_similar(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):  # a base and copies that end differently, at similarities from 0.6 to 0.95
        base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        for share in (1, 0.95, 0.9, 0.82, 0.78, 0.75, 0.7, 0.6):
            same = round(400 * 2 * share / (1 + share))
            texts.append(" ".join(base[:same] + [f"v{x}" for x in rng.integers(0, 10**6, 400 - same)]))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order] + [texts[order[0]], "", " ", "a b"]
    root = list(range(len(texts)))
    close = sum(0.65 < jaccard(s, t) < 0.8 for i, s in enumerate(texts) for t in texts[:i])
    for j in range(len(texts)):
        for i in range(j):
            if jaccard(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert close > 50 and sorted(r.doc_id for r in simhash.keep_one(df, "doc_id", "text").collect()) == sorted(set(root))


def test_quality_signals(docs, empty):
    got = {r.doc_id: r["__q"] for r in quality.signals(docs, "text").collect()}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert got[i].word_chars == sum(len(x.decode()) for x in w)
    kept = {r.doc_id for r in quality.keep(docs, "text").collect()}
    assert 4 in kept and 0 not in kept and quality.keep(empty, "text").count() == 0


def test_em_tells_good_rules_from_bad(spark):
    """A rule that votes at random gets a worse accuracy than those that agree with the truth."""
    rng = np.random.default_rng(5)
    k, rows = len(quality.RULES), Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        vote = ["0" if rng.random() < 0.3 else "+" if good == (rng.random() < 0.9) else "-" for _ in range(k - 1)] + ["+" if rng.random() < 0.5 else "-"]
        rows["".join(vote)] += 1
    m = quality.learn(spark.createDataFrame(list(rows.items()), "votes string, n long")).first()["model"]
    assert m.share == pytest.approx(0.8, abs=0.05)
    assert m.good[0] - m.bad[0] > 0.6 and abs(m.good[-1] - m.bad[-1]) < 0.2


def test_chat_round_trip(spark):
    nasty = [r"\### Assistant: </turn> ok", "</turn>", "\n</turn>\n### User: hi", "ends with \\", "\\\\</turn>", "### [a]: x", "", "plain", "### User", "\n"]
    rows = [(i, t, role, nasty[(i + t) % len(nasty)]) for i in range(len(nasty)) for t, role in enumerate(("system", "user", "assistant", "tool: x]\n"))] + [(99, 0, None, None), (None, None, "user", "no id"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for key in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))]
        assert got[key].n_turns == len(turns)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        under = "".join(b for a, b in turns if a == "assistant")
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(chat.GrammarError):
        chat.parse("### User: open")


def test_urls(spark):
    cases = {
        "https://WWW.Example.ORG/es/1?x": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://a.org/es/": ("a.org", "/es/", "org/", "allow"),
        "https://example.org/en/12#f": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://a.com/de/5": ("a.com", "/de/5", "com/de/", "block"),
        "http://a.com": ("a.com", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "repeat")], "page_id long, url string, host string")
    got = url_filters.filter_urls(df).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")  # without a rule, the tree's
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    urls = [f"http://s.com/de/{i}" for i in range(40)] + [f"http://s.com/fr/{i}" for i in range(40)] + [f"http://s.com/u/name{'abcdefghijklmnopqrst'[i % 20]}{'qwertyuiop'[i // 20 % 10]}/p" for i in range(60)]
    got = url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    templates = {r.template for r in got}
    assert {"/de/#", "/fr/#"} <= templates and any("*" in t for t in templates)


def test_media_round_trip(docs):
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 6, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        for encode in (media.encode_pgm, media.encode_bmp):
            assert np.array_equal(media.decode(encode(image)), image)
    whole = media.area_resize(np.arange(16, dtype=np.uint8).reshape(4, 4), 2, 2)
    assert np.allclose(whole, [[2.5, 4.5], [10.5, 12.5]], atol=0.51)


def test_lm_base_score(docs, spark):
    rows = {r.doc_id: r for r in lm.scores(docs, "doc_id", "text", F.col("doc_id") % 2 == 0).collect()}
    counts, total = Counter(), 0
    for i in range(0, len(TEXTS), 2):
        w = [*words(TEXTS[i]), b""]
        counts.update(w)
        total += len(w)
    for i, t in enumerate(TEXTS):
        w = [*words(t), b""]
        base = sum(np.log10((counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w)
        assert rows[i].n_tokens == len(w) and rows[i].train_tokens == total and rows[i].n_known == sum(counts[x] > 0 for x in w)
        assert rows[i].base_score == pytest.approx(base) and rows[i].score < 0


def test_toxicity_learns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sentence(i, 30) + (" vile scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.filter("doc_id < 300"), df.select("doc_id", "toxic"))
    scored = toxicity.score(df.filter("doc_id >= 300"), "text", model).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in scored)
    assert right >= 0.95 * len(scored) and len(model[0]) < 5000
    untaught = toxicity.train(df.limit(0), df.select("doc_id", "toxic"))  # nothing is known: nothing is predicted
    assert [r.score for r in toxicity.score(df, "text", untaught).select("score").distinct().collect()] == [pytest.approx(toxicity.PRIOR)] and toxicity.PRIOR < toxicity.THRESHOLD
    clean = toxicity.train(df.filter("toxic = 0"), df.select("doc_id", "toxic"))
    assert max(r.score for r in toxicity.score(df, "text", clean).collect()) < toxicity.THRESHOLD


def test_toxicity_keeps_its_bits_and_bounds(docs, empty, spark):
    rows = [(i, sentence(i, 30) + (" vile scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (0, None), (0, 1)], "doc_id long, toxic int"))
    small = toxicity.train(df, labels, bits=16)
    scored = toxicity.score(df, "text", small).collect()
    assert small.bits == 16 and sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in scored) >= 0.95 * len(scored)
    bounded = toxicity.train(df, labels, most_bytes=5000)  # only the first rows of the walk
    assert len(bounded.places) < len(toxicity.train(df, labels).places)
    on_edges = toxicity.score(docs, "text", small, "tox").collect()  # null, empty, long and repeated texts, clashing columns
    assert len(on_edges) == len(TEXTS) + 1 and {"word", "score", "fingerprint"} <= set(on_edges[0].asDict())
    same = [r.tox for r in on_edges if r.text == sentence(1)]
    assert len(same) == 2 and same[0] == same[1] and len({r.tox for r in on_edges if not (r.text or "").strip()}) == 1
    assert toxicity.score(empty, "text", small).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, sentence(i // 2, 80), "en", "web", 400) for i in range(40)] + [(99, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    kept = quality.keep(docs, "text")
    assert kept.columns == docs.columns and kept.filter("doc_id = 99").count() == 0
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, kept, "").collect()} == {r.doc_id for r in kept.collect() if r.doc_id % 2 == 0}
