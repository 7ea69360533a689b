"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import weakref
import zlib
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D. bytes.split() uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % modulus


def fold_column(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def utf8(array: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b or b"" for b in array.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, text: str, most_bytes: int = 4_000_000):
    """Slices of a batch whose texts add up to about most_bytes, so that what a task holds stays small."""
    start, held = 0, 0
    offsets = batch.column(text).cast(pa.large_binary())
    sizes = pc.binary_length(offsets).to_pylist()
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= most_bytes or i - start >= 4096:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, whose executors are the driver, may do without it: it gets a temporary folder, once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tsengine-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths that this driver has written and not removed, and the application that they belong to.
_STANDING: dict[str, str] = {}


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has; release() removes what stands there."""
    path = f"{shared_dir(spark)}/tsengine-{what}-{uuid.uuid4().hex}"
    _STANDING[path] = spark.sparkContext.applicationId
    return path


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in list(paths):
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        _STANDING.pop(path, None)


def release(spark: SparkSession) -> None:
    """Remove all tables that this subpackage's queries have left in the shared folder. Call it when their results have been read: these are lazy, and need them until then."""
    discard(spark, [p for p, app in _STANDING.items() if app == spark.sparkContext.applicationId])


def materialise(df: DataFrame, what: str, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts lineage, and lost executors do not lose it.

    instead_of: frames that materialise gave and that nothing reads any more; their files are removed once the new ones stand.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    discard(spark, [_WRITTEN.pop(old) for old in instead_of])
    return found


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner see that earlier jobs' shuffles are no longer referenced, so that their files go before the next job's come.

    What Python lets go of reaches the JVM a little later, so it is asked twice.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that working columns beside it can't clash with any; ``select("row.*")`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


#: A key counts as hot from this share of the rows on, so there are no more hot keys than its inverse.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left JOIN right USING keys, without sending a hot key's rows to one task.

    right has one row a key; its column weight says how many rows of left the key has at least, and these add up to at
    most total. Keys with a thousandth of total or more (so at most HOT_KEYS of them) are broadcast, the rest joined.
    """
    hot = F.col(weight) * HOT_KEYS >= max(total, 1)
    some, rest = F.broadcast(right.filter(hot).drop(weight)), right.filter(~hot).drop(weight)
    return left.join(some, keys).unionByName(left.join(F.broadcast(right.filter(hot).select(*keys)), keys, "left_anti").join(rest, keys))


#: Bits of a bitmap for each key that it marks, and at most in all: 16 MB, whatever the number of keys.
BITS_A_KEY, MOST_BITS = 16, 1 << 27


def marked(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a column ``name``: false if none of keys is the row's, so that a join with keys need not move the row.

    True says little: keys are told apart by a hash's place in a bitmap, which is broadcast. keys is read twice.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    page, place = free_name(rows, "page"), F.bitmap_bit_position(slot)
    bitmap = free_name(rows, "bitmap")
    maps = keys.groupBy(F.bitmap_bucket_number(slot).alias(page)).agg(F.bitmap_construct_agg(place).alias(bitmap))
    found = rows.withColumn(page, F.bitmap_bucket_number(slot)).join(F.broadcast(maps), page, "left")
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return found.select(*(f"`{c}`" for c in rows.columns), F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias(name))


_HELD: dict[str, object] = {}


def once_per_worker(name: str, make):
    """What make() gives, built once in each Python worker; a new name for the same kind replaces the old one."""
    kind = name.split("/")[0]
    if name not in _HELD:
        for old in [k for k in _HELD if k.split("/")[0] == kind]:
            del _HELD[old]
        _HELD[name] = make()
    return _HELD[name]


def new_name(kind: str) -> str:
    return f"{kind}/{uuid.uuid4().hex}"
