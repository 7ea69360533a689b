"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is encoded by itself; those that come back as their own single token are
*proven*. A text is cut into pre-tokens; a proven one counts one, and only the rest are merged (each distinct one once
per worker, by the tokenizer's own merges). Special strings inside a text count as the library does by default: one
token each.

Defined results: null or empty text has no tokens. Pre-tokens of any length are merged, but ones over 64 characters
aren't remembered. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import chunks, new_name, once_per_worker, table

#: Fixed: the published split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
LIMIT = 512
REMEMBERED = 400_000


def _byte_table() -> dict[int, str]:
    """The published byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_TABLE = _byte_table()


def byte_chars(text: str) -> str:
    if text.isascii() and text.isalnum():
        return text
    return text.encode().decode("latin-1").translate(BYTE_TABLE)


def prove(tokenizer_json: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token and are one pre-token, so that they may be counted unseen."""
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    tokenizer = Tokenizer.from_str(tokenizer_json)
    special = {t["content"] for t in json.loads(tokenizer_json)["added_tokens"]}
    whole, split = ByteLevel(), regex.compile(PATTERN)
    strings = [(i, whole.decode([piece])) for piece, i in tokenizer.get_vocab(with_added_tokens=False).items()]
    encoded = tokenizer.encode_batch([s for _, s in strings], add_special_tokens=False)
    return frozenset(s for (i, s), e in zip(strings, encoded, strict=True) if e.ids == [i] and s not in special and split.fullmatch(s) and split.findall(s) == [s])


class Pretokens(dict):
    """Pre-token -> number of tokens: one for the proven ones, and what the tokenizer's merges make of the rest."""

    def __init__(self, tokenizer_json: str, proven: frozenset[str]):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.model, self.merged = proven, Tokenizer.from_str(tokenizer_json).model, 0

    def __missing__(self, pretoken: str) -> int:
        rest = pretoken[1:]
        n = len(self.model.tokenize("\u0120" + rest if pretoken[0] == " " and rest.isascii() and rest.isalnum() else byte_chars(pretoken)))
        if len(pretoken) <= 64:
            if self.merged >= REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
                self.merged = 0
            self[pretoken] = n
            self.merged += 1
        return n


class Counter(dict):
    """What stands between two single spaces -> number of tokens of its pre-tokens, the space before it included.

    The pattern always cuts before a space that has other characters on both sides, so these counts add up. None marks
    a part that begins or ends with white space or is empty: its text is cut as a whole instead.
    """

    def __init__(self, tokenizer_json: str, proven: frozenset[str]):
        super().__init__()
        self.known = Pretokens(tokenizer_json, proven)
        special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.findall = regex.compile(PATTERN).findall

    def __missing__(self, part: str) -> int | None:
        if part.isascii() and part.isalpha():  # one pre-token
            n = self.known[" " + part]
        elif not part or part[0] in SPACES or part[-1] in SPACES:
            n = None
        else:
            n = self.cut(" " + part)
        if len(part) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n

    def cut(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.findall(text)))

    def count_plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            if first and first[-1] not in SPACES:
                return self.cut(first) + sum(map(self.__getitem__, rest))
        except TypeError:
            pass
        return self.cut(text)

    def count(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return self.count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))


def token_counts(df: DataFrame, key: str, text: str, tokenizer_json: str, limit: int = LIMIT) -> DataFrame:
    """The key, n_bytes, n_tokens and over_limit of every text."""
    # Both are fixed by the vocabulary file, whatever the data: about 1.5 MB and 0.6 MB.
    sent = df.sparkSession.sparkContext.broadcast((tokenizer_json, prove(tokenizer_json)))

    name = new_name("counter")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = once_per_worker(name, lambda: Counter(*sent.value))
        for whole in batches:
            for batch in chunks(whole, text):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                n = [counter.count(t) for t in texts]
                size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", f.read())
