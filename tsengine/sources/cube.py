"""A gridded cube read by references to its chunks, as a data source of Spark: one partition a chunk, and only chunks that are asked for.

``spark.dataSource.register(CubeSource)``, then ``spark.read.format("cube").option("variables", "t,r2").load(path)``, or
:func:`read_cube`. The reference file is JSON in the published form that names, for each chunk of each array of a Zarr (version 2) group,
a file, an offset and a length (or the bytes themselves, as text or base64): ``{"version": 1, "refs": {"t/0.0.0": ["part-0.bin", 0, 4096], ...}}``.
Files are paths beside the reference file, or addresses that Arrow's file systems open; the tasks read them, so they must be
on storage that all executors share.

Rows are (valid_time, y, x, a column for each variable). Arrays must be chunked alike over (valid_time, y, x), uncompressed or
zlib, in C order; times are whole numbers with units such as ``hours since 1970-01-01``. Fill values, NaN and chunks
without a reference are null. The options ``start`` and ``end`` (times, inclusive) and ``cells`` (``y.x`` pairs, separated by
commas) choose chunks and then rows. They are options, not pushed filters, because Spark 4.1 keeps what a Python source
was told by one query for the next one on the same frame, which then misses rows.
"""

from __future__ import annotations

import base64
import datetime as dt
import itertools
import json
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AXES = ("valid_time", "y", "x")
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def read_bytes(place: list | str, folder: str) -> bytes:
    """The bytes that a reference stands for."""
    if isinstance(place, str):
        return base64.b64decode(place.removeprefix("base64:")) if place.startswith("base64:") else place.encode()
    from pyarrow import fs

    name, offset, length = place if len(place) == 3 else (place[0], 0, None)
    system, path = fs.FileSystem.from_uri(name if "://" in name else f"{folder}/{name}")
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


@dataclass(frozen=True)
class Chunked:
    """An array's shape, chunks, type, compression and fill value."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    kind: str
    packed: bool
    fill: float | None

    @classmethod
    def of(cls, meta: dict) -> Chunked:
        packer = meta.get("compressor")
        if packer and packer.get("id") != "zlib" or meta.get("filters") or meta.get("order", "C") != "C":
            raise ValueError("only arrays in C order without filters, uncompressed or zlib")
        fill = meta.get("fill_value")
        return cls(tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], bool(packer), None if fill is None else float(fill))

    def values(self, raw: bytes) -> np.ndarray:
        flat = np.frombuffer(zlib.decompress(raw) if self.packed else raw, self.kind)
        if flat.size != math.prod(self.chunks):
            raise ValueError("a chunk has another size than its array says")
        return flat.reshape(self.chunks)


class References:
    def __init__(self, path: str):
        self.folder = path.rsplit("/", 1)[0] if "/" in path else "."
        if "://" not in path:
            import os

            self.folder = os.path.abspath(self.folder)
        held = json.loads(read_bytes([path.rsplit("/", 1)[-1]], self.folder))
        self.refs = held.get("refs", held)

    def meta(self, name: str, kind: str = ".zarray") -> dict:
        held = self.refs.get(f"{name}/{kind}", "{}" if kind == ".zattrs" else None)
        if held is None:
            raise ValueError(f"the references have no array {name!r}")
        return json.loads(held) if isinstance(held, str) else held

    def times(self) -> np.ndarray:
        """The axis of time in microseconds since 1970."""
        array = Chunked.of(self.meta("valid_time"))
        parts = [array.values(read_bytes(self.refs[f"valid_time/{i}"], self.folder)) for i in range(-(-array.shape[0] // array.chunks[0]))]
        unit, _, start = self.meta("valid_time", ".zattrs").get("units", "seconds since 1970-01-01").partition(" since ")
        origin = int((dt.datetime.fromisoformat(start.strip()) - dt.datetime(1970, 1, 1)).total_seconds())
        return (np.concatenate(parts)[: array.shape[0]].astype(np.int64) * UNIT_SECONDS[unit.strip()] + origin) * 1_000_000


@dataclass
class Chunk(InputPartition):
    """Where a chunk begins, its size within the arrays, its times, which of them and which cells of its grid are wanted (None: all), the folder, and the array and reference of each variable (None: no bytes)."""

    start: tuple[int, int, int]
    size: tuple[int, int, int]
    times: list[int]
    wanted: list[int]
    cells: list[int] | None
    folder: str
    arrays: list[Chunked]
    places: list


def micros(time: str) -> int:
    return (dt.datetime.fromisoformat(time) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


class CubeReader(DataSourceReader):
    def __init__(self, path: str, variables: list[str], start: str | None, end: str | None, cells: str | None):
        self.path, self.variables = path, variables
        self.start, self.end = start and micros(start), end and micros(end)
        self.cells = None if cells is None else sorted({tuple(map(int, c.split("."))) for c in cells.split(",") if c})

    def partitions(self) -> list[Chunk]:
        held = References(self.path)
        arrays = [Chunked.of(held.meta(v)) for v in self.variables]
        if any((a.shape, a.chunks) != (arrays[0].shape, arrays[0].chunks) or len(a.shape) != 3 for a in arrays):
            raise ValueError("the variables must be chunked alike over valid_time, y and x")
        shape, chunks = arrays[0].shape, arrays[0].chunks
        times = held.times()
        wanted = np.ones(len(times), bool)
        if self.start is not None:
            wanted &= times >= self.start
        if self.end is not None:
            wanted &= times <= self.end
        out, slabs, kept = [], [i for i in range(-(-shape[0] // chunks[0])) if wanted[i * chunks[0] : (i + 1) * chunks[0]].any()], None
        tiles = list(itertools.product(*(range(-(-s // c)) for s, c in zip(shape[1:], chunks[1:], strict=True))))
        if self.cells is not None:
            kept = {t: [] for t in tiles}
            for y, x in self.cells:
                if 0 <= y < shape[1] and 0 <= x < shape[2]:
                    kept[y // chunks[1], x // chunks[2]].append((y, x))
            tiles = [t for t in tiles if kept[t]]
        for at in ((slab, *tile) for slab in slabs for tile in tiles):
            start = tuple(i * c for i, c in zip(at, chunks, strict=True))
            size = tuple(min(c, s - a) for a, c, s in zip(start, chunks, shape, strict=True))
            places = [held.refs.get(f"{v}/{'.'.join(map(str, at))}") for v in self.variables]
            part = slice(start[0], start[0] + size[0])
            cells = None if kept is None else [(y - start[1]) * size[2] + x - start[2] for y, x in kept[at[1:]]]
            out.append(Chunk(start, size, times[part].tolist(), np.flatnonzero(wanted[part]).tolist(), cells, held.folder, arrays, places))
        return out

    def read(self, chunk: Chunk | None) -> Iterator[pa.RecordBatch]:
        if chunk is None:  # where no chunk is left, Spark plans one partition without any
            return
        t, y, x = chunk.size
        held = []
        for array, place in zip(chunk.arrays, chunk.places, strict=True):
            if place is None:
                held.append(np.full(chunk.size, np.nan))
                continue
            found = array.values(read_bytes(place, chunk.folder))[:t, :y, :x].astype(np.float64)
            held.append(np.where(found == array.fill, np.nan, found) if array.fill is not None else found)
        here = np.arange(y * x) if chunk.cells is None else np.array(chunk.cells)
        for i in chunk.wanted:  # a time of a chunk is a batch
            rows = [v[i].ravel()[here] for v in held]
            at = [pa.array(np.full(len(here), chunk.times[i]), pa.timestamp("us")), pa.array(chunk.start[1] + here // x, pa.int32()), pa.array(chunk.start[2] + here % x, pa.int32())]
            yield pa.RecordBatch.from_arrays([*at, *(pa.array(v, mask=np.isnan(v)) for v in rows)], [*AXES, *self.variables])


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cube"

    @property
    def variables(self) -> list[str]:
        found = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]
        if not found:
            raise ValueError("the option variables names no variable")
        return found

    def schema(self) -> str:
        return "valid_time timestamp_ntz, y int, x int, " + ", ".join(f"`{v}` double" for v in self.variables)

    def reader(self, schema) -> CubeReader:
        return CubeReader(self.options["path"], self.variables, *(self.options.get(k) for k in ("start", "end", "cells")))


def read_cube(spark: SparkSession, path: str, variables: list[str], start: str | None = None, end: str | None = None, cells: Iterable[tuple[int, int]] | None = None) -> DataFrame:
    """(valid_time, y, x, variables) of a reference file, within a closed range of times and at some cells (y, x) only, if given."""
    spark.dataSource.register(CubeSource)
    chosen = {"variables": ",".join(variables), "start": start, "end": end, "cells": None if cells is None else ",".join(f"{y}.{x}" for y, x in cells)}
    return spark.read.format("cube").options(**{k: v for k, v in chosen.items() if v is not None}).load(path)
