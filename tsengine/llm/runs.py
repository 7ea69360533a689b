"""Periodic runs of words: stretches that repeat themselves at a distance, found in each text.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``max(least, 2 * q)``
words, that no neighbouring word extends keeping the period.

The suffix automaton of a text's words is built, and the sets of end positions of its states are merged along the suffix
links, longest states first and always the smaller set into the larger. Where a position enters a set, the distance to
its neighbours there is new; if it isn't more than the state's length, the words between are a square of that period,
and since no end position lies between, of no smaller one. Each square is extended to both sides to its run; squares
inside a run that is known are passed over. Every run is found: its words but the last period are a factor that ends
twice, one period apart, with no end between, and is at least as long as the period. As that factor has half of
``least`` words or more, sets of shorter states are never needed.

Before that, words that can't belong to a run are put aside: every word of a run is in a window of half of ``least``
words that comes again within the run, so only stretches of words in windows that come again in their own stretch are
searched. All texts of a chunk are sifted at once by hashes; equal hashes of different windows only keep more words.
Texts are independent rows: nothing is shuffled.

Defined results: null and texts without words have no runs and nothing left; null and repeated keys are kept, and repeated rows give
equal results; an empty table gives no rows. Whole texts are read, of any length: a task holds one chunk of texts, and of
its longest periodic stretch some hundred bytes a word. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import chunks, table, utf8

#: Words of a run at least; positions in a block of an ordered set; rounds of sifting at most.
LEAST, BLOCK, SIFTS = 12, 1024, 8


class Ends:
    """An ordered set of positions, in blocks so that adding to a large one moves little."""

    __slots__ = ("blocks", "last", "size")

    def __init__(self, first: int):
        self.blocks, self.last, self.size = [[first]], [first], 1

    def add(self, x: int) -> None:
        i = bisect_left(self.last, x)
        if i == len(self.last):
            i -= 1
            self.last[i] = x
        block = self.blocks[i]
        insort(block, x)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.last[i : i + 1] = [block[half - 1], block[-1]]

    def before(self, x: int) -> int | None:
        i = bisect_left(self.last, x)
        at = bisect_left(self.blocks[i], x)
        return self.blocks[i][at - 1] if at else self.last[i - 1] if i else None

    def after(self, x: int) -> int | None:
        i = bisect_right(self.last, x)
        return self.blocks[i][bisect_right(self.blocks[i], x)] if i < len(self.last) else None

    def __iter__(self) -> Iterator[int]:
        return (x for block in self.blocks for x in block)


def suffix_automaton(words: Sequence) -> tuple[list[int], list[int], list[int]]:
    """Lengths, suffix links and first end positions of the states (-1 for a copy and for the root, which is state 0)."""
    length, link, first, steps = [0], [-1], [-1], [{}]
    last = 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        first.append(at)
        steps.append({})
        p = last
        while p >= 0 and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p >= 0:
            q = steps[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(-1)
                steps.append(steps[q].copy())
                link[q] = link[new] = copy
                while p >= 0 and steps[p].get(word) == q:
                    steps[p][word] = copy
                    p = link[p]
        last = new
    return length, link, first


def squares(words: Sequence, shortest: int) -> Iterator[tuple[int, int]]:
    """(period, last word) of squares of primitive words; every run whose length less its period is shortest or more holds one."""
    length, link, first = suffix_automaton(words)
    waiting: dict[int, list[Ends]] = {}
    for state in sorted((s for s in range(1, len(length)) if length[s] >= shortest), key=length.__getitem__, reverse=True):
        sets = waiting.pop(state, [])
        if first[state] >= 0:
            sets.append(Ends(first[state]))
        sets.sort(key=lambda s: s.size)
        large, reach = sets.pop(), length[state]
        entered = [x for small in sets for x in small]
        for x in entered:
            large.add(x)
        for x in entered:
            before, after = large.before(x), large.after(x)
            if before is not None and x - before <= reach:
                yield x - before, x
            if after is not None and after - x <= reach:
                yield after - x, after
        if length[link[state]] >= shortest:
            waiting.setdefault(link[state], []).append(large)


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries two arrays have in common from their starts on; a multiple of what they share is looked at."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        stop = min(n, at + step)
        apart = a[at:stop] != b[at:stop]
        if apart.any():
            return at + int(apart.argmax())
        at, step = stop, 2 * step
    return n


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period."""
    found, period, end = [], None, -1
    for q, last in sorted(set(squares(words.tolist(), -(-least // 2)))):
        if q == period and last <= end:
            continue
        start = last - 2 * q + 1
        right = alike(words[last + 1 :], words[last + 1 - q :])
        left = alike(words[:start][::-1], words[: start + q][::-1])
        period, end = q, last + right
        if end - (start - left) + 1 >= max(least, 2 * q):
            found.append((start - left, end - (start - left) + 1, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that can hold runs, in the texts' words one after the other; sizes: words of each text."""
    width = -(-least // 2)
    weights = np.random.default_rng(12).integers(0, 2**63, width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at, part, words = np.arange(len(hashes)), np.repeat(np.arange(len(sizes)), sizes), hashes.view(np.uint64)
    for _ in range(SIFTS):
        n = len(at) - width + 1
        if n < 1:
            return
        key = part[:n].astype(np.uint64) * weights[width]
        for i in range(width):
            key += words[i : i + n] * weights[i]
        whole = np.flatnonzero(part[:n] == part[width - 1 :])
        order = whole[np.argsort(key[whole], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        again = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        depth = np.zeros(len(at) + 1, np.int64)
        np.add.at(depth, again, 1)
        np.add.at(depth, again + width, -1)
        held = np.flatnonzero(depth[:-1].cumsum() > 0)
        if not len(held):
            return
        first = np.r_[True, (np.diff(held) != 1) | (np.diff(part[held]) != 0)]
        label = first.cumsum() - 1
        large = np.bincount(label)[label] >= least
        left = len(at)
        at, part, words = at[held][large], label[large], words[held][large]
        if len(at) == left:
            break
    if len(at):
        starts = np.flatnonzero(np.r_[True, np.diff(part) != 0])
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(at)].tolist(), strict=True):
            yield int(at[a]), int(at[b - 1]) + 1


def periodic_runs(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(key, runs, kept): the runs of each text as (start, length, period), and its words but those after each run's first period, joined by spaces."""
    if least < 2:
        raise ValueError("a run has at least two words")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, text):
                words = [t.split() for t in utf8(batch.column(text))]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                hashes = np.fromiter((h for w in words for h in map(hash, w)), np.int64, int(sizes.sum()))
                found, ends = {}, sizes.cumsum()
                for a, b in stretches(hashes, sizes, least):
                    i = int(np.searchsorted(ends, a, "right"))
                    offset = a - int(ends[i] - sizes[i])
                    numbers = {}
                    stretch = np.array([numbers.setdefault(w, len(numbers)) for w in words[i][offset : offset + b - a]])
                    found.setdefault(i, []).extend((s + offset, n, q) for s, n, q in runs_of(stretch, least))
                kept = []
                for i, w in enumerate(words):
                    if found.get(i):
                        stays = np.ones(len(w), bool)
                        for s, n, q in found[i]:
                            stays[s + q : s + n] = False
                        w = [w[j] for j in np.flatnonzero(stays).tolist()]
                    kept.append(b" ".join(w))
                lists = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())] for i in range(len(words))], spans)
                yield pa.RecordBatch.from_arrays([batch.column(key), lists, pa.array(kept, pa.binary()).cast(pa.string())], [key, "runs", "kept"])

    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias(text))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, kept string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten its words with a periodic end, as the registered query wants it; a null id counts as the text 'null'."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(again), F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), "doc_id", "text")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
