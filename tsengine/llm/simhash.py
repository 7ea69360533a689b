"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has ``words`` times 64 bits: each is the majority over its shingles' hash bits. Equal fingerprints
are one node. Fingerprints that differ in at most ``max_distance`` bits are linked, and links' connected components are
the groups.

The index. Its top level, spread over the machines, is keyed by masked bit patterns: fingerprints that share the pattern
under one mask meet in one bucket. The masks' width follows the count of fingerprints, so that a bucket holds about
``BUCKET_ROWS`` at any size. Of one word, cut into b runs of bits, the masks are all choices of b - ``max_distance`` runs:
that many bits can't touch every choice, so no link can be missed. Of more words, the masks are single runs, ``blocks``
to a word, or, beyond what these can tell apart, drawn bits, as many masks as keep the share of pairs of ``SIMILAR`` texts
that meet at what the runs give. Inside, fingerprints are sorted by Gray rank, so neighbours differ in few
bits, and every ``FAN_OUT`` consecutive nodes get a parent that holds the mask and pattern of the bits they share. A
search descends pairs of nodes from the root with itself; each level adds the differences in the bits that it newly
fixes, and a pair whose accumulated differences pass the bound is dropped with all below it. A pair whose remaining free
bits can't exceed the bound is linked as a whole, and pairs already in one component are skipped, so a bucket gives a
star for each of its components and never all pairs. A bucket of more than ``BLOCK_ROWS`` is dealt into blocks by a
hash; each pair of blocks is a part of its own, so no task holds more than two blocks of a bucket and no pair is missed.

``keep_one`` takes the index's links as candidates only: two documents are linked if the exact Jaccard similarity of
their shingle sets is SIMILAR or more. Only documents that have a candidate go on, and of these only those that share
enough of their shingles with any other of them to be similar to one at all. Their sets are sent to buckets that they met
others in, one for each candidate pair, and compared there: no pair leaves a bucket, only the stars of what turned out similar.

Defined results: null text is empty; a text without words has fingerprint zero and is linked like any other; repeated
rows and equal texts share a fingerprint; an empty table gives no rows. Null ids are kept, and count as larger than any
other id. Only the named columns are read.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import chunks, join_hot, marked, materialise, packed, table, utf8

SEED, FAN_OUT = 42, 8
#: Bytes of whole buckets that a task indexes at a time, node pairs and shingles that it compares at a time.
HELD_BYTES, PAIRS, COMPARED = 16_000_000, 1 << 18, 4_000_000
#: Rows, or bytes of shingle sets, that a block of a bucket has on average, at most.
BLOCK_ROWS, BLOCK_BYTES = 50_000, 32_000_000
#: Rows that a bucket has on average, and large buckets that are broadcast (24 bytes each); more are joined.
BUCKET_ROWS, LARGE = 1000, 200_000
#: Fixed odd multipliers that turn a shingle's hash into further independent words.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 of every shingle; of a shorter text, of the whole."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, ">u8")
    joined = b" ".join(tokens)
    starts = [0, *accumulate(map((1).__add__, map(len, tokens)))]
    ends = starts[shingle:] if len(tokens) >= shingle else starts[-1:]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)]), ">u8")


def fingerprint(text: bytes, shingle: int, words: int = 1, distinct: bool = False) -> bytes:
    """The fingerprint's bits, most significant first; with ``distinct``, a shingle counts once and a digest of the set follows. A fingerprint's first word needs no mixing: it is plain XXH64."""
    every = shingles(text, shingle)
    every = np.unique(every) if distinct else every
    ones, n = np.zeros((words, 64), np.int64), len(every)
    for at in range(0, n, 50_000):
        hashes = every[at : at + 50_000]
        for w in range(words):
            mixed = hashes
            if w:
                mixed = hashes.astype(np.uint64) * np.uint64(MIX[w - 1])
                mixed = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(MIX[-1])).byteswap()
            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1)
            ones[w] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > n).tobytes() + (xxhash.xxh64_digest(every.tobytes()) if distinct else b"")


def fingerprints(df: DataFrame, keys: list[str], text: str, shingle: int, words: int = 1, distinct: bool = False) -> DataFrame:
    """The key columns and the fingerprint of every whole text."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, text):
                found = [fingerprint(t, shingle, words, distinct) for t in utf8(batch.column(text))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, pa.binary())], [*keys, "fingerprint"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", fingerprint binary"
    return df.select(*keys, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a 64-bit word in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class Level:
    """Nodes of one height: which run of nodes below each holds, and the mask and pattern of the bits that all share."""

    def __init__(self, bucket: np.ndarray, mask: np.ndarray, pattern: np.ndarray, first: np.ndarray, leaf: np.ndarray):
        self.bucket, self.mask, self.pattern, self.first, self.leaf = bucket, mask, pattern, first, leaf

    def parents(self) -> Level:
        starts = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]])
        place = np.arange(len(self.bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(self.bucket)]))
        first = np.flatnonzero(place % FAN_OUT == 0)
        ones = np.bitwise_and.reduceat(self.pattern & self.mask, first, axis=0)
        zeros = np.bitwise_and.reduceat(~self.pattern & self.mask, first, axis=0)
        return Level(self.bucket[first], ones | zeros, ones, np.r_[first, len(self.bucket)], np.r_[self.leaf[first], self.leaf[-1]])


class Links:
    """Components of the leaves linked so far: label[i] is the smallest leaf of i's."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            self.label = parent[self.label]

    def uniform(self, level: Level) -> np.ndarray:
        """The label that all of a node's leaves have, or -1."""
        low, high = np.minimum.reduceat(self.label, level.leaf[:-1]), np.maximum.reduceat(self.label, level.leaf[:-1])
        return np.where(low == high, low, -1)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, one after the other."""
    return np.repeat(starts - np.r_[0, counts.cumsum()[:-1]], counts) + np.arange(counts.sum())


def descend(bucket: np.ndarray, side: np.ndarray, prints: np.ndarray, most: int, links: Links, apart: bool = False):
    """For rows sorted by bucket, side and Gray rank: arrays of two rows each to link, passing over those that links has in one component.

    A bucket with two sides is a pair of blocks: rows of one are compared with those of the other only.
    The caller adds them to links as they come, and gets stars; with ``apart`` it doesn't, and gets every pair of rows
    that are near each other in a bucket and not in one component.
    """
    n, bucket = len(bucket), 2 * bucket + side
    levels = [Level(bucket, np.full_like(prints, ~np.uint64(0)), prints, np.arange(n + 1), np.arange(n + 1))]
    while len(levels[-1].bucket) > len(np.unique(bucket)):
        levels.append(levels[-1].parents())
    of_root = levels[-1].bucket
    two = np.flatnonzero(of_root[1:] == (of_root[:-1] | 1))  # both sides of a bucket
    alone = np.setdiff1d(np.arange(len(of_root)), np.r_[two, two + 1])
    roots, others = np.r_[alone, two], np.r_[alone, two + 1]
    none = np.zeros_like(levels[-1].mask[roots])
    todo = [(len(levels) - 1, roots, others, popcount(none), none)]
    while todo:
        height, a, b, gone, fixed = todo.pop()
        most_pairs = PAIRS // FAN_OUT**2 if height else PAIRS
        if len(a) > most_pairs:
            todo += [(height, *(x[i : i + most_pairs] for x in (a, b, gone, fixed))) for i in range(0, len(a), most_pairs)][::-1]
            continue
        level = levels[height]
        both = level.mask[a] & level.mask[b]
        gone = gone + popcount((level.pattern[a] ^ level.pattern[b]) & both & ~fixed)
        same = links.uniform(level)
        keep = (gone <= most) & ((same[a] < 0) | (same[a] != same[b]))
        if not keep.any():
            continue
        a, b, gone, both = a[keep], b[keep], gone[keep], both[keep]
        if apart and not height:
            yield a, b
            continue
        whole = (gone + popcount(~both) <= most) & (not apart)
        if whole.any():
            x, y = a[whole], b[whole]
            for node in (x, y):
                leaves = ranges(level.leaf[node], level.leaf[node + 1] - level.leaf[node])
                yield np.repeat(level.leaf[x], level.leaf[node + 1] - level.leaf[node]), leaves
        elif not height:
            continue
        if height and not whole.all():
            a, b, gone, both = a[~whole], b[~whole], gone[~whole], both[~whole]
            na, nb = level.first[a + 1] - level.first[a], level.first[b + 1] - level.first[b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            at = ranges(np.zeros(len(a), np.int64), na * nb)
            i, j = level.first[a][pair] + at // nb[pair], level.first[b][pair] + at % nb[pair]
            for which in (i < j, i == j):  # a node with itself comes first: what it links spares later pairs
                if which.any():
                    todo.append((height - 1, i[which], j[which], gone[pair][which], both[pair][which]))


def search(bucket: np.ndarray, side: np.ndarray, prints: np.ndarray, most: int) -> np.ndarray:
    """For rows sorted by bucket, side and Gray rank: the first row of each row's component among links within its bucket."""
    links = Links(len(bucket))
    for a, b in descend(bucket, side, prints, most, links):
        links.add(a, b)
    return links.label


def run_masks(runs: int) -> list[int]:
    edges = [round(64 * i / runs) for i in range(runs + 1)]
    return [((1 << b - a) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def masks(rows: int, max_distance: int, words: int = 1, blocks: int | None = None) -> list[tuple[int, ...]]:
    """The masks of the index for so many fingerprints: for each, the bits of every word that it shows."""
    if words == 1 and blocks is None:
        runs = max_distance + 1
        while rows > BUCKET_ROWS << 64 * (runs - max_distance) // runs and runs < 2 * max_distance + 4:
            runs += 1
        return [(sum(chosen),) for chosen in combinations(run_masks(runs), runs - max_distance)]
    blocks = blocks or max_distance + 1
    if rows <= BUCKET_ROWS << 64 // blocks:
        return [tuple(m if w == at else 0 for at in range(words)) for w in range(words) for m in run_masks(blocks)]
    both = 2 * SIMILAR[0] / (SIMILAR[0] + SIMILAR[1])  # the cosine of sets of one size at that similarity
    same = 1 - math.acos(both) / math.pi  # the chance that a bit is equal
    missed = (1 - same ** (64 / blocks)) ** (words * blocks)
    width = min(48, math.ceil(math.log2(rows / BUCKET_ROWS)))
    # Masks are cut from shuffled bits, so those of one shuffle share none. The spread of distances asks for half as many again.
    wanted = math.ceil(1.5 * math.log(missed) / math.log(1 - same**width))
    rng, out = random.Random(SEED), []
    while len(out) < wanted:
        bits = rng.sample(range(64 * words), 64 * words)
        for at in range(0, 64 * words - width + 1, width):
            out.append(tuple(sum(1 << b % 64 for b in bits[at : at + width] if b // 64 == w) for w in range(words)))
    return out[:wanted]


BUCKET = ["part", "bits"]
BLOCK = [*BUCKET, "low", "high"]


class Index:
    """The index's top level for a number of fingerprints: its masks, and how a task reads its buckets."""

    def __init__(self, rows: int, max_distance: int, words: int = 1, blocks: int | None = None):
        self.most, self.words, self.masks = max_distance, words, masks(rows, max_distance, words, blocks)
        # Rows are ordered by the word with most bits that a bucket leaves open.
        self.ordered_by = np.array([min(range(words), key=lambda w: m[w].bit_count()) for m in self.masks])

    def buckets(self, prints: DataFrame) -> DataFrame:
        """(part, bits, fingerprint): every fingerprint once for each mask."""
        word = [F.conv(F.hex(F.substring("fingerprint", 8 * w + 1, 8)), 16, -10).cast("long") for w in range(self.words)]
        under = lambda m: [word[w].bitwiseAND(F.lit(x - (1 << 64) if x >> 63 else x)) for w, x in enumerate(m) if x]
        keys = [F.struct(F.lit(i).alias("part"), (p[0] if len(p := under(m)) == 1 else F.xxhash64(*p)).alias("bits")) for i, m in enumerate(self.masks)]
        return prints.select("fingerprint", F.explode(F.array(*keys)).alias("bucket")).select("bucket.part", "bucket.bits", "fingerprint")

    def read(self, batches):
        """(table, rows, bucket, side, prints): whole buckets with something to compare; rows are the table's places in the order of bucket, side and Gray rank."""
        for t in whole_buckets(batches):
            part, bits, low, high, side = (t[c].to_numpy() for c in (*BLOCK, "side"))
            x = np.frombuffer(b"".join(t["fingerprint"].to_pylist()), ">u8").astype(np.uint64).reshape(len(t), -1)[:, : self.words]
            bucket = np.r_[0, changes(part, bits, low, high).cumsum()]
            # A bucket of one has nothing to compare, nor has a pair of blocks of which one is empty: its own rows meet elsewhere.
            n, right = np.bincount(bucket), np.bincount(bucket, side)
            some = np.flatnonzero((n[bucket] > 1) & ((low == high) | ((right > 0) & (right < n))[bucket]))
            if len(some):
                rank = gray_rank(x[some, self.ordered_by[part[some]]])
                rows = some[np.lexsort((rank, side[some], bucket[some]))]
                yield t, rows, bucket[rows], side[rows], x[rows]


def changes(*keys: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([k[1:] != k[:-1] for k in keys])


def whole_buckets(batches):
    """Tables of whole buckets from batches in their order, about HELD_BYTES at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            t = pa.Table.from_batches(held).combine_chunks()
            last = np.flatnonzero(changes(*(t[k].to_numpy() for k in BLOCK)))
            if len(last):
                yield t.slice(0, last[-1] + 1)
                t = t.slice(last[-1] + 1)
            held, size = t.to_batches(), t.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def dealt(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of (part, bits, fingerprint, ...) brought together by bucket; one that weighs more than most is cut into blocks by a hash, and each pair of blocks is a part of its own (low, high, side)."""
    large = materialise(rows.groupBy(*BUCKET).agg(F.ceil(F.sum(weight) / most).alias("cuts")).filter("cuts > 1"), "large")
    more = rows.columns[2:]
    cut = rows.join(F.broadcast(large) if large.count() <= LARGE else large, BUCKET, "left")
    own = F.coalesce(F.pmod(F.xxhash64("fingerprint", "part"), F.col("cuts")), F.lit(0))
    other = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    cut = cut.withColumn("own", own).withColumn("other", other)
    low, high = F.least("own", "other").cast("int").alias("low"), F.greatest("own", "other").cast("int").alias("high")
    cut = cut.select(*BUCKET, low, high, (F.col("own") > F.col("other")).cast("int").alias("side"), *more)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, *BLOCK).sortWithinPartitions(*BLOCK)


def stars(label: np.ndarray, prints: list[bytes]) -> pa.RecordBatch:
    found = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array([prints[i] for i in label[found]], pa.binary()), pa.array([prints[i] for i in found], pa.binary())], ["a", "b"])


def links_between(prints: DataFrame, max_distance: int, words: int = 1, blocks: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): for each bucket of the index, every linked fingerprint with its component's first one."""
    index = Index(prints.count(), max_distance, words, blocks)

    def run(batches):
        for t, rows, bucket, side, x in index.read(batches):
            yield stars(search(bucket, side, x, max_distance), t["fingerprint"].take(pa.array(rows)).to_pylist())

    return dealt(index.buckets(prints), F.lit(1), block_rows).mapInArrow(run, "a binary, b binary")


def meeting(prints: DataFrame, index: Index, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(part, bits, fingerprint): buckets with the fingerprints in them that have another within the distance; each pair that is so near is in one of them.

    A bucket's component all of whose fingerprints share the bucket of an earlier mask, too, is left to that one.
    Bytes of a fingerprint beyond its words tell nodes apart and don't count as distance.
    """
    shown = np.array(index.masks, np.uint64)

    def run(batches):
        for t, rows, bucket, side, x in index.read(batches):
            label = search(bucket, side, x, index.most)
            order = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
            size = np.diff(np.r_[first, len(order)])
            differ = np.bitwise_or.reduceat((x ^ x[label])[order], first, axis=0)
            part, wanted = t["part"].to_numpy()[rows[order[first]]], size > 1
            for i, m in enumerate(shown):
                wanted &= (part <= i) | (differ & m).any(axis=1)
            near = np.sort(order[np.repeat(wanted, size)])
            yield from t.select([*BUCKET, "fingerprint"]).take(pa.array(rows[near])).to_batches()

    return dealt(index.buckets(prints), F.lit(1), block_rows).mapInArrow(run, "part int, bits long, fingerprint binary").distinct()


def overlaps(ids: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many ids the sets a[i] and b[i] share; set j is ids[start[j] : start[j] + size[j]], none is empty."""
    out, order = np.empty(len(a), np.int64), np.argsort(a, kind="stable")
    mark = np.zeros(int(ids.max()) + 1, bool)
    first = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
        own = ids[start[a[order[i]]] :][: size[a[order[i]]]]
        mark[own] = True
        at, most = order[i:j], max(1, COMPARED // int(size[b[order[i:j]]].max()))
        for k in range(0, len(at), most):
            y = b[at[k : k + most]]
            hits = mark[ids[ranges(start[y], size[y])]]
            out[at[k : k + most]] = np.add.reduceat(hits, np.r_[0, size[y].cumsum()[:-1]], dtype=np.int64)
        mark[own] = False
    return out


def similar(rows: DataFrame, index: Index, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): in each bucket, every fingerprint with the first one of its component among those whose sets are SIMILAR.

    rows: (part, bits, fingerprint, size, shared, shingles); shared is how many of the set's shingles any other set has.
    Pairs within the distance are compared as they come out of the tree, but for those in one component already.
    """
    top, bottom = SIMILAR

    def run(batches):
        for t, rows, bucket, side, x in index.read(batches):
            found = t.take(pa.array(rows))
            size, shared = (found[c].to_numpy() for c in ("size", "shared"))
            ids = np.unique(np.frombuffer(b"".join(found["shingles"].to_pylist()), np.uint64), return_inverse=True)[1]
            start, links = np.r_[0, size.cumsum()[:-1]], Links(len(rows))
            for a, b in descend(bucket, side, x, index.most, links, apart=True):
                # What both hold of others' shingles bounds what they share; most pairs are settled by that.
                both = (top + bottom) * np.minimum(shared[a], shared[b]) >= top * (size[a] + size[b])
                both &= (links.label[a] != links.label[b]) & (size[a] > 0) & (size[b] > 0)
                a, b = a[both], b[both]
                if len(a):
                    enough = (top + bottom) * overlaps(ids, start, size, a, b) >= top * (size[a] + size[b])
                    links.add(a[enough], b[enough])
            yield stars(links.label, found["fingerprint"].to_pylist())

    return dealt(rows, 8 * F.col("size"), block_bytes).mapInArrow(run, "a binary, b binary")


def with_shared(sets: DataFrame) -> DataFrame:
    """Sets (fingerprint, size, shingles) -> the same with shared; those that no other set can be similar to are left out."""
    top, bottom = SIMILAR
    numbered = materialise(sets.withColumn("number", F.monotonically_increasing_id()), "sets")

    def flat(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                held = b"".join(part["shingles"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(held, np.int64)), pa.array(np.repeat(part["number"].to_numpy(), part["size"].to_numpy()))], ["shingle", "number"])

    alone = numbered.select("number", "size", "shingles").mapInArrow(flat, "shingle long, number long").groupBy("shingle").agg(F.count("*").alias("n"), F.max("number").alias("number")).filter("n = 1")
    alone = alone.groupBy("number").agg(F.count("*").alias("alone"))
    shared = F.col("size") - F.coalesce("alone", F.lit(0))
    found = numbered.join(alone, "number", "left").select("fingerprint", "size", shared.alias("shared"), "shingles")
    return materialise(found.filter(F.col("shared") * bottom >= F.col("size") * top), "sets", instead_of=[numbered])


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node with the smallest node of its connected component.

    Stars, large and small in turn: every node's larger neighbours, then its smaller ones, are moved to the smallest
    one that it knows, until nothing changes; the rounds grow with the logarithm of a component's size. Each round is a
    written table.
    """

    def star(edges: DataFrame, large: bool, total: int) -> DataFrame:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            ways = ways.filter(F.col("v") < F.col("u"))
        least = ways.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).select("u", F.least("u", "m").alias("m"), "weight")
        moved = join_hot(ways, least, ["u"], "weight", 2 * total)  # the centre of a large star is a hot key
        moved = moved.filter(F.col("v") > F.col("u")) if large else moved.filter(F.col("v") != F.col("m"))
        out = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
        return out if large else out.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))

    edges, before = materialise(links.filter(F.col("a") != F.col("b")).distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
        # A large star gives one row at most for each edge, so the count of edges bounds both steps.
        moved = materialise(star(edges, True, now[0]).distinct(), "links")
        edges = materialise(star(moved, False, now[0]).distinct(), "links", instead_of=[edges, moved])


def similar_links(nodes: DataFrame, rows: int, sets_of, max_distance: int, words: int, blocks: int | None) -> DataFrame:
    """(a, b): links that connect what all similar pairs among the index's candidates connect.

    sets_of gives (fingerprint, size, shingles) for rows of (fingerprint, least).
    """
    index = Index(rows, max_distance, words, blocks)
    met = materialise(meeting(nodes.select("fingerprint"), index), "met")
    near = materialise(nodes.select("fingerprint", "least").join(met.select("fingerprint").distinct(), "fingerprint", "left_semi"), "near")
    sets = with_shared(sets_of(near))
    return similar(met.join(sets, "fingerprint").select(*BUCKET, "fingerprint", "size", "shared", "shingles"), index)


def near_duplicates(prints: DataFrame, key: str, max_distance: int, words: int = 1, blocks: int | None = None, sets_of=None) -> DataFrame:
    """(key, fingerprint, component_id) from a written table of (key, fingerprint): component_id is the smallest key reachable.

    With sets_of (see similar_links), links need similar sets, too.
    """
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min(key).alias("least"), F.count("*").alias("weight")), "nodes")
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    roots = components(similar_links(nodes, n_nodes, sets_of, max_distance, words, blocks) if sets_of else links_between(nodes.select("fingerprint"), max_distance, words, blocks))
    # One row per different fingerprint. Large groups and frequent fingerprints are hot keys of the two joins that follow.
    grouped = materialise(nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", "weight", F.coalesce("root", "fingerprint").alias("root")), "grouped")
    of_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of_node = join_hot(grouped.select("fingerprint", "weight", "root"), of_root, ["root"], "members", n_nodes).select("fingerprint", "component_id", "weight")
    return join_hot(prints, of_node, ["fingerprint"], "weight", n_rows).select(key, "fingerprint", "component_id")


#: For near duplicates on five-word shingles with a similarity of 0.8 or more: such sets' fingerprints of 256 bits differ
#: in about 39 bits (the angle of a cosine of 2 * 0.8 / 1.8, as a share of half a turn), with a deviation of 6. Candidates
#: may differ in 60; SIMILAR, as a fraction, is what their sets must reach.
SHINGLE, WORDS, DISTANCE, RUNS, SIMILAR = 5, 4, 60, 6, (4, 5)


def keep_one(df: DataFrame, key: str, text: str) -> DataFrame:
    """The input without near duplicates: of each group, the row with the smallest key stays (then the smallest text hash).

    Rows with equal keys and texts are one. Null keys come last. Whole texts move only if they may have candidates, to be
    compared, or may be left out; the others stay where they are read.
    """
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("hash"))
    docs = df.select(packed(df).alias("doc"), row.alias("row"), F.col(text).cast("string").alias("text"))
    prints = materialise(fingerprints(docs, ["row"], "text", SHINGLE, WORDS, distinct=True), "fingerprints")

    def known(row: Column) -> Column:  # one column, never null: all joins and the last step share its partitioning
        return F.concat(row["hash"].cast("string"), F.when(row["none"], "").otherwise(F.concat(F.lit(":"), row["key"].cast("string")))).alias("id")

    def sets_of(near: DataFrame) -> DataFrame:
        def run(batches):
            for whole in batches:
                for batch in chunks(whole, "text"):
                    found = [np.unique(shingles(t, SHINGLE).astype(np.uint64)) for t in utf8(batch.column("text"))]
                    yield pa.RecordBatch.from_arrays([batch.column("fingerprint"), pa.array(map(len, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["fingerprint", "size", "shingles"])

        ids = near.select(known(F.col("least")), "fingerprint")
        texts = marked(docs.select(known(F.col("row")), "text"), ids, "id", "near").filter("near").drop("near")
        found = texts.join(ids, "id").dropDuplicates(["id"])
        return found.select("fingerprint", "text").mapInArrow(run, "fingerprint binary, size long, shingles binary")

    found = near_duplicates(prints, "row", DISTANCE, WORDS, RUNS, sets_of).withColumn("first", F.col("row") == F.col("component_id"))
    # Rows to leave out are fewer than those to keep. Rows with one key and text are told apart by nothing: they are left out, too, and one of each comes back.
    of_id = materialise(found.groupBy(known(F.col("row"))).agg(F.bool_or("first").alias("first"), F.count("*").alias("n")).filter("n > 1 OR NOT first"), "left_out")
    named = marked(docs.select(known(F.col("row")), "doc"), of_id, "id", "doubted")
    doubted = named.filter("doubted")
    kept = named.filter("NOT doubted").unionByName(doubted.join(of_id.select("id"), "id", "left_anti"))
    again = of_id.filter("first").select("id")
    if again.count():
        kept = kept.unionByName(doubted.join(again, "id", "left_semi").dropDuplicates(["id"]))
    return kept.select("doc.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = materialise(fingerprints(docs, ["doc_id"], "text", shingle=4), "fingerprints")
    found = near_duplicates(prints, "doc_id", max_distance=4)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
