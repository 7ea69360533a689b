"""Packing of tokenised documents by minimum bin slack.

Every document's ids are cut into whole windows, which are sequences by themselves, and a remainder. The remainders
are dealt round-robin; each task takes up to ``BATCH`` of them at a time, ordered by length. A window starts with the
longest remainder left; a subset-sum dynamic programme over the multiset of remaining lengths (one big integer is the
bitset of the sums that can be reached) finds the fill closest to the capacity, and walking back through its stages
gives the count of each length. Only lengths move between machines: the ids' checksum is taken where they are made.

Defined results: null text is empty and packs as its end id; a null doc_id stays null; repeated rows are packed each;
an empty table gives no rows; very long texts give many whole windows. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import defaultdict
from itertools import islice

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import chunks, new_name, once_per_worker, table, utf8
from tsengine.llm.token_counts import byte_chars

WINDOW, END_ID = 2048, 1
BATCH = 20_000
REMEMBERED = 600_000
#: Fixed: the split pattern of the vocabulary file, which works on lower-case text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that composition leaves alone and whose lower case is one letter, whatever stands around them.
LATIN = regex.compile(r"[\x00-\u012F\u0131-\u024F]*")


def forget(held: dict) -> None:
    """Drop the later half of what is held: frequent keys came early."""
    for key in list(islice(held, REMEMBERED // 2, None)):
        del held[key]


class PieceIds(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes, by the tokenizer's merges."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(byte_chars(piece))]).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                forget(self)
            self[piece] = ids
        return ids


class WordIds(dict):
    """White-space-free chunk of a text -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are its chunks' ids in order. Chunks of
    Latin letters are lower-cased and cut here; any other, and those that might hold a special string, go through the
    whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.special = [t["content"].encode() for t in json.loads(tokenizer_json)["added_tokens"]]
        if any(len(s.split()) != 1 for s in self.special):
            raise ValueError("a special token holds white space: texts can't be encoded chunk by chunk")
        self.has_special = regex.compile(b"|".join(map(regex.escape, self.special)) or rb"(?!)").search
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.pieces = PieceIds(self.tokenizer.model)
        self.findall = regex.compile(PATTERN).findall

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one pre-token
            ids = self.pieces[word.lower().decode()]
        else:
            text = word.decode("utf-8", "replace")
            if self.has_special(word) or not (word.isascii() or LATIN.fullmatch(text)):
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                ids = b"".join(map(self.pieces.__getitem__, self.findall(text.lower())))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                forget(self)
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> how many of it, so that they sum as close to capacity as can be without passing it.

    counts: the lengths to choose from. Longer ones are offered first, a length's copies in groups of 1, 2, 4, ...;
    the programme stops as soon as the capacity itself is reached.
    """
    full, goal, stages, reach = (1 << capacity + 1) - 1, 1 << capacity, [], 1
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, group = min(counts[length], capacity // length), 1
        while left:
            take = min(group, left)
            stages.append((reach, length, take))
            reach |= (reach << length * take) & full
            left, group = left - take, group * 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(stages):
        if not before >> at & 1:
            at -= length * take
            chosen[length] += take
    return dict(chosen)


def fill_windows(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indices into lengths for each window."""
    where = defaultdict(list)
    for i, n in enumerate(lengths):
        where[n].append(i)
    counts, out = {n: len(x) for n, x in where.items()}, []
    heap = sorted(counts)
    while heap:
        while heap and not counts[heap[-1]]:
            heap.pop()
        if not heap:
            break
        first = heap[-1]
        counts[first] -= 1
        chosen = [where[first].pop()]
        for length, n in best_fill({k: v for k, v in counts.items() if v}, window - first).items():
            counts[length] -= n
            chosen += [where[length].pop() for _ in range(n)]
        out.append(chosen)
    return out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(df: DataFrame, key: str, text: str, tokenizer_json: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Each document's whole windows and its remainder: the key, start, length, the ids' crc32 and the document's tokens."""
    sent, name = df.sparkSession.sparkContext.broadcast(tokenizer_json), new_name("encoder")  # its size is fixed by the vocabulary file

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = once_per_worker(name, lambda: WordIds(sent.value))
        end = array("I", [end_id]).tobytes()
        for whole in batches:
            for batch in chunks(whole, text):
                rows, at = [], []
                for i, x in enumerate(utf8(batch.column(text))):
                    ids = encoder.encode(x) + end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        part = ids[4 * start : 4 * (start + window)]
                        rows.append((start, len(part) // 4, zlib.crc32(part), n))
                        at.append(i)
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), *columns], [key, "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {PIECES}")


def pack(cut: DataFrame, key: str, window: int = WINDOW, partitions: int | None = None, batch: int = BATCH) -> DataFrame:
    """Give every piece a sequence_id and an offset. Each task packs up to ``batch`` remainders at a time."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0

        def laid_out(held: pa.Table) -> pa.Table:
            nonlocal made
            lengths = held["length"].to_pylist()
            whole = [i for i, n in enumerate(lengths) if n == window]
            rest = [i for i, n in enumerate(lengths) if n != window]
            sequence, offset = [0] * len(lengths), [0] * len(lengths)
            for chosen in [*([i] for i in whole), *([rest[j] for j in x] for x in fill_windows([lengths[i] for i in rest], window))]:
                at = 0
                for i in chosen:
                    sequence[i], offset[i] = (task << 40) + made, at
                    at += lengths[i]
                made += 1
            return held.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

        waiting, rows = [], 0
        for x in batches:
            waiting.append(x)
            rows += x.num_rows
            if rows >= batch:
                yield from laid_out(pa.Table.from_batches(waiting)).to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from laid_out(pa.Table.from_batches(waiting)).to_batches()

    n = partitions or int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"`{key}` {cut.schema[key].dataType.simpleString()}, {PIECES}, sequence_id long, offset long"
    return cut.repartition(n).mapInArrow(run, schema)


def pack_documents(df: DataFrame, key: str, text: str, tokenizer_json: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(df, key, text, tokenizer_json, window, end_id), key, window)


def word_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", word_tokenizer())
