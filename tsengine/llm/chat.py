r"""Chat formatting by a grammar round trip.

The grammar: a conversation is turns one after the other, a turn is a header (``### User: ``), its text, and ``\n</turn>\n``.
Inside a text, a control string (a header or ``</turn>``) with one or more backslashes before it stands for itself with
one backslash less; one without is not part of a text. A conversation is rendered with its texts as they are and parsed
again by the deterministic parser; turns that don't come back as they were get a backslash before each control string,
until the recovered turns equal the source.

Rows of a conversation are brought together by Spark's shuffle, sorted by turn, and streamed: a task holds one
conversation at a time.

Defined results: null text and null role are empty; a null turn comes first; rows with equal turns are ordered by role,
then text, repeats included; of rows with a null id nothing is known to belong together, so each is a conversation of
one turn with a null id (and no task gathers them); an empty table gives no rows.
Roles other than system, user and assistant are written between brackets, percent-encoded. Only the named columns are
read, so others may clash. Time is linear in a text's length, whatever it is made of: a run of backslashes is read from
its first one only, and what may stand between brackets can't hold the start of another header.
"""

from __future__ import annotations

import hashlib
import re
from itertools import count, groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import table

LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in LABELS.items()}
OTHER_ROLE = r"\[[A-Za-z0-9_.~%-]*\]"
HEADER = rf"### (System|User|Assistant|{OTHER_ROLE}): "
CLOSE = "\n</turn>\n"
HEAD = re.compile(HEADER)
CONTROL = re.compile(rf"(?<!\\)(\\*)(?:### (?:System|User|Assistant|{OTHER_ROLE}): |</turn>)")
LOSS_ROLE = "assistant"


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def label(role: str) -> str:
    return LABELS.get(role) or f"[{quote(role, safe='')}]"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m.group()[1:] if m.group(1) else m.group(), text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; rendered[start:end] is the text as it was written."""
    turns, at = [], 0
    while at < len(rendered):
        head = HEAD.match(rendered, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        start = head.end()
        mark = next((m for m in CONTROL.finditer(rendered, start) if not m.group(1)), None)
        if mark is None or mark.group() != "</turn>" or mark.start() == start or rendered[mark.start() - 1] != "\n" or rendered[mark.end() : mark.end() + 1] != "\n":
            raise GrammarError(f"the turn that begins at {at} is not closed")
        end, name = mark.start() - 1, head.group(1)
        turns.append((ROLES.get(name) or unquote(name[1:-1]), unescape(rendered[start:end]), start, end))
        at = mark.end() + 1
    return turns


def render_turn(role: str, text: str) -> str:
    return f"### {label(role)}: {text}{CLOSE}"


def survives(role: str, text: str, written: str) -> bool:
    try:
        return [t[:2] for t in parse(render_turn(role, written))] == [(role, text)]
    except GrammarError:
        return False


def render(turns: list[tuple[str, str]]) -> str:
    """The formatted conversation; parsing it gives the turns again."""
    parts = []
    for role, text in turns:
        written = text
        while not survives(role, text, written):
            again = escape(written)
            if again == written or len(again) > 2 * len(text) + 64:
                raise GrammarError("a turn can't be written so that it is read back")
            written = again
        parts.append(render_turn(role, written))
    rendered = "".join(parts)
    if [t[:2] for t in parse(rendered)] != list(turns):
        raise GrammarError("the conversation isn't read back as it was")
    return rendered


def format_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(key, formatted, loss): one row per conversation; loss is a list of (start, end) in code points of formatted."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter("key IS NOT NULL").repartition(n, "key").sortWithinPartitions("key", "turn", "role", "text")

    def run(batches):
        stream = (row for b in batches for row in zip(b["key"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True))
        keys, texts, masks, held = [], [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(texts, pa.string()), pa.array(masks, spans)], [key, "formatted", "loss"])
        alone = count()
        for (k, _), turns in groupby(stream, key=lambda r: (r[0], next(alone) if r[0] is None else 0)):
            rendered = render([(r, t) for _, r, t in turns])
            keys.append(k)
            texts.append(rendered)
            masks.append([{"start": a, "end": b} for r, _, a, b in parse(rendered) if r == loss_role])
            held += len(rendered)
            if held > 4_000_000:
                yield out()
                keys, texts, masks, held = [], [], [], 0
        if keys:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow, spans = to_arrow_type(df.schema[key].dataType), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return dealt.unionByName(rows.filter("key IS NULL")).mapInArrow(run, f"`{key}` {kind}, formatted string, loss array<struct<start:long,end:long>>")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations: turns, their digest, the text under the loss mask and its digest."""

    def run(batches):
        for b in batches:
            rows = []
            for text, loss in zip(b["formatted"].to_pylist(), b["loss"].to_pylist(), strict=True):
                turns = parse(text)
                whole = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b[key], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"`{key}` {formatted.schema[key].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(tricky).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return digests(format_conversations(rows.unionByName(extra)))
