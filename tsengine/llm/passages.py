"""Removal of passages that an earlier document has, too: windows of words found through difference-cover anchors.

A window is ``width`` consecutive words of one text. A word goes if a window that covers it also starts in a document with
a smaller key; windows are judged on the texts as they come.

Anchors are shorter windows, hashed only where their place modulo ``period`` is in a difference cover: for any two places
there is a shift of less than the period that brings both into the cover. So two equal windows, wherever they stand in their texts,
share an anchor at the same place within them, as the anchor is shorter than the window by less than the period. Three
jobs follow one another, each with one shuffle of its own:

1. anchors by hash: which of them does a document with another key have?
2. texts with such anchors: each is extended to the windows that hold it; windows by a hash of 128 bits: which does a
   document with a smaller key have?
3. texts with such windows: the words that they cover go.

Nothing is compared pair by pair. A task first looks for equal anchors (windows) among its own texts, a chunk at a time;
what it can answer by itself goes past the shuffle's groups, and of each hash only one row a chunk is asked
about. So the commonest passage gives as many rows as there are chunks, and no group is hot. Answers say where in a text a hash
came first; the text's other places with the same hash follow from the text.

Defined results: a null key is neither smaller nor larger than another: such texts lose nothing and cause no loss. Rows
with equal keys don't count for one another; their texts are told apart by a hash. Null text has no words; texts shorter
than a window lose nothing; an empty table gives no rows; repeated rows get equal results. Keys must be whole numbers.
Whole texts are read, and only the named columns.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tsengine.llm.common import chunks, free_shuffles, materialise, once_per_worker, table, utf8

WIDTH, PERIOD = 13, 7
#: Different words whose hashes a worker keeps.
WORDS_HELD = 200_000
#: Marks of a row: where a hash stands in a text, times four, and whether its chunk knows of another document, or has the answer.
SHARED, KNOWN = 1, 2
#: Entries of the table of hashes that a chunk's rows are sifted by.
TABLE = 1 << 22


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError("a period is a positive number")


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one shuffle of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each window of so many words, by the places that they start at."""
    n = max(0, len(hashes) - width + 1)
    weights = np.random.default_rng((seed, width)).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += hashes[i : i + n] * weights[i]
    return mixed(out)


class Texts(NamedTuple):
    """The words of a chunk's texts one after the other: a hash each, the text it is in, its place there, and each text's first word."""

    words: list[list[bytes]]
    sizes: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    place: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        words = [t.split() for t in utf8(column)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        look = once_per_worker("words/of passages", Hashes).__getitem__
        hashes = np.fromiter((h for w in words for h in map(look, w)), np.uint64, int(sizes.sum()))
        start = sizes.cumsum() - sizes
        text = np.repeat(np.arange(len(words)), sizes)
        return cls(words, sizes, hashes, text, np.arange(len(hashes)) - start[text], start)

    def anchors(self, width: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the chunk) of the anchors, and their hashes."""
        short = width - period + 1
        inside = (self.place + short <= self.sizes[self.text]) & (self.sizes[self.text] >= width)
        at = np.flatnonzero(inside & np.isin(self.place % period, difference_cover(period)))
        return at, windows(self.hashes, short, 1)[at]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows within one text, and their two hashes."""
        at = np.flatnonzero(self.place + width <= self.sizes[self.text])
        return at, windows(self.hashes, width, 2)[at], windows(mixed(self.hashes), width, 3)[at]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows with equal keys stand together as they came, and where the groups begin."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def labels(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows in order, the group that it is in."""
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return out.cumsum()


def first_places(text: np.ndarray, h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """Rows that have their hashes for the first time in their text, grouped by h; rows come by text and place."""
    order, starts = groups(h)
    new = np.ones(len(order), bool)
    new[1:] = text[order[1:]] != text[order[:-1]]
    if g is not None:
        new[1:] |= g[order[1:]] != g[order[:-1]]
    new[starts] = True
    return order[new]


def scattered(n: int, salt: int) -> np.ndarray:
    """Hashes that spread answers, which belong to no group."""
    return mixed(np.arange(n, dtype=np.uint64) + np.uint64(salt % 2**63)).view(np.int64)


def columns(**arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], list(arrays))


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Rows that come first with their keys."""
    out = np.zeros(len(keys[0]), bool)
    order, starts = groups(*keys)
    out[order[starts]] = True
    return out


def asked_anchors(rows: DataFrame, width: int, period: int) -> DataFrame:
    """(h, key, mark): of each anchor one row a document, or one a chunk with its answers if several documents there have it."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                texts = Texts.of(batch.column("text"))
                at, h = texts.anchors(width, period)
                some = first_places(texts.text[at], h)
                if not len(some):
                    continue
                h, place, key = h[some], texts.place[at[some]], batch.column("key").to_numpy()[texts.text[at[some]]]
                starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                group = labels(starts, len(h))
                known = (np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts))[group]
                asked = ~known
                if len(starts) < len(h):
                    asked &= first_of(group, place)
                asked[starts] = True
                yield columns(h=h.view(np.int64)[asked], key=key[asked], mark=place[asked] * 4 + known[asked] * SHARED)
                if known.any():
                    yield columns(h=scattered(int(known.sum()), int(h[0])), key=key[known], mark=place[known] * 4 + KNOWN)

    return rows.mapInArrow(run, "h long, key long, mark long")


def stream_groups(batches, answer):
    """answer(columns, starts) of whole groups of equal h, rows coming in that order; what a batch's end leaves open is carried on."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        if held is not None:
            part = {n: np.concatenate([held[n], x]) for n, x in part.items()}
        starts = np.flatnonzero(np.r_[True, part["h"][1:] != part["h"][:-1]])
        held = {n: x[starts[-1] :] for n, x in part.items()}
        if len(starts) > 1:
            yield answer({n: x[: starts[-1]] for n, x in part.items()}, starts[:-1])
    if held is not None:
        yield answer(held, np.zeros(1, np.int64))


def shared_anchors(rows: DataFrame, width: int, period: int) -> DataFrame:
    """(key, places) of the anchors that a document with another key has, too; a place is the first with that hash in a text."""
    large, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def answer(part, starts):
        mark, key = part["mark"], part["key"]
        real = mark & KNOWN == 0
        several = np.minimum.reduceat(np.where(real, key, large), starts) < np.maximum.reduceat(np.where(real, key, small), starts)
        several |= np.maximum.reduceat(mark & SHARED, starts) > 0
        some = several[labels(starts, len(key))] | ~real
        return columns(key=key[some], place=mark[some] >> 2)

    asked = asked_anchors(rows, width, period).repartition("h").sortWithinPartitions("h")
    return asked.mapInArrow(lambda batches: stream_groups(batches, answer), "key long, place long").groupBy("key").agg(F.collect_set("place").alias("places"))


def marked(texts: Texts, of: np.ndarray, places: pa.Array, h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """Which rows (their places in the chunk are of) have the hash that their text has at one of the named places, a list by text.

    A small table by some bits of the hashes leaves few other rows to look up.
    """
    out = np.zeros(len(of), bool)
    sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
    text, place = np.repeat(np.arange(len(sizes)), sizes), places.flatten().to_numpy()
    some = (place >= 0) & (place < texts.sizes[text])  # of texts with equal keys, another's places may be beyond this one's end
    row = np.full(len(texts.text) + 1, -1)
    row[of] = np.arange(len(of))
    named = row[texts.start[text[some]] + place[some]]
    named = named[named >= 0]
    out[named] = True
    key = h ^ mixed(texts.text[of].astype(np.uint64))
    low = (key & np.uint64(TABLE - 1)).astype(np.int64)
    seen = np.zeros(TABLE, bool)
    seen[low[named]] = True
    rest = np.flatnonzero(seen[low] & ~out)
    if len(rest):
        named = named[np.argsort(key[named], kind="stable")]
        found = named[np.minimum(np.searchsorted(key[named], key[rest]), len(named) - 1)]
        out[rest] = (key[found] == key[rest]) & (True if g is None else g[found] == g[rest])
    return out


def asked_windows(rows: DataFrame, width: int, period: int) -> DataFrame:
    """(h, g, key, same, mark): windows that hold a shared anchor, of each one row a chunk for the smallest key and answers for the others."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                texts = Texts.of(batch.column("text"))
                at, h = texts.anchors(width, period)
                shared = np.zeros(len(texts.text) + 1, np.int64)
                shared[at[marked(texts, at, batch.column("places"), h)]] = 1
                before = np.r_[0, shared.cumsum()]
                at, h, g = texts.windows(width)
                some = np.flatnonzero(before[at + period] > before[at])  # anchors begin in the window's first words
                at, h, g = at[some], h[some], g[some]
                some = first_places(texts.text[at], h, g)
                if not len(some):
                    continue
                at, h, g = at[some], h[some], g[some]  # rows with equal h and other g, should there be any, are groups of their own
                key, same, place = batch.column("key").to_numpy()[texts.text[at]], batch.column("same").to_numpy()[texts.text[at]], texts.place[at]
                starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
                group = labels(starts, len(h))
                known = key > np.minimum.reduceat(key, starts)[group]
                asked = ~known
                if len(starts) < len(h):
                    asked &= first_of(group, key, same)
                out = lambda some, h, g, flag: columns(h=h, g=g, key=key[some], same=same[some], mark=place[some] * 4 + flag)  # noqa: B023, E731
                yield out(asked, h.view(np.int64)[asked], g.view(np.int64)[asked], 0)
                if known.any():
                    n = int(known.sum())
                    yield out(known, scattered(n, int(h[0])), np.zeros(n, np.int64), KNOWN)

    return rows.mapInArrow(run, "h long, g long, key long, same long, mark long")


def repeated_windows(rows: DataFrame, width: int, period: int) -> DataFrame:
    """(key, same, gone): the places of windows that a document with a smaller key has, too, each the first with its words in a text."""

    def run(batches):
        open_group, least = None, None  # rows come by h, g and key, so a group's first question has its smallest key
        for batch in batches:
            h, g, key, same, mark = (batch.column(n).to_numpy() for n in ("h", "g", "key", "same", "mark"))
            gone = mark & KNOWN > 0
            ask = np.flatnonzero(~gone)
            if len(ask):
                starts = np.flatnonzero(np.r_[True, (np.diff(h[ask]) != 0) | (np.diff(g[ask]) != 0)])
                smallest = key[ask[starts]]
                if (h[ask[0]], g[ask[0]]) == open_group:
                    smallest[0] = least
                gone[ask] = key[ask] > smallest[labels(starts, len(ask))]
                open_group, least = (h[ask[-1]], g[ask[-1]]), smallest[-1]
            yield columns(key=key[gone], same=same[gone], place=mark[gone] >> 2)

    dealt = asked_windows(rows, width, period).repartition("h").sortWithinPartitions("h", "g", "key")
    return dealt.mapInArrow(run, "key long, same long, place long").groupBy("key", "same").agg(F.collect_set("place").alias("gone"))


def remove(rows: DataFrame, width: int) -> DataFrame:
    """(key, n_words, spans, kept) of rows with the places of their windows that go."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def parts(batch):
        """(number of words, spans, kept) by row; only texts with something to lose are hashed."""
        some = batch.filter(batch.column("gone").is_valid())
        if some.num_rows:
            texts = Texts.of(some.column("text"))
            at, h, g = texts.windows(width)
            gone = at[marked(texts, at, some.column("gone"), h, g)]
            depth = np.zeros(len(texts.text) + 1, np.int64)
            depth[gone] += 1
            np.add.at(depth, gone + width, -1)
            covered = depth[:-1].cumsum() > 0
            changed = iter(zip(texts.words, texts.start.tolist(), texts.sizes.tolist(), strict=True))
        for text, loses in zip(utf8(batch.column("text")), batch.column("gone").is_valid().to_pylist(), strict=True):
            if not loses:
                w = text.split()
                yield len(w), [], b" ".join(w)
                continue
            w, a, n = next(changed)
            away = covered[a : a + n]
            edges = np.flatnonzero(np.diff(np.r_[False, away, False])).tolist()
            stays = [0, *edges, n]
            yield n, [{"start": s, "length": e - s} for s, e in zip(edges[::2], edges[1::2], strict=True)], b" ".join(x for s, e in zip(stays[::2], stays[1::2], strict=True) for x in w[s:e])

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                sizes, spans, kept = zip(*parts(batch), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "spans", "kept"])

    return rows.mapInArrow(run, "key long, n_words long, spans array<struct<start:long,length:long>>, kept string")


def remove_repeated(df: DataFrame, key: str, text: str, width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """(key, n_words, spans, kept): of each text its number of words, the stretches that go as (start, length), and the other words joined by spaces."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError("passages need keys that are whole numbers")
    if not 0 < period <= width:
        raise ValueError("a period is no longer than a window")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    keyed = rows.filter("key IS NOT NULL")
    shared = materialise(shared_anchors(keyed.select("key", "text"), width, period), "anchors")
    free_shuffles(df.sparkSession)
    gone = materialise(repeated_windows(keyed.join(shared, "key"), width, period), "windows", [shared])
    free_shuffles(df.sparkSession)
    found = remove(rows.join(gone, ["key", "same"], "left").select("key", "text", "gone"), width)
    return found.select(F.col("key").cast(kind).alias(key), "n_words", "spans", "kept")


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents"), "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.length)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
