"""Media columns: Netpbm and BMP images, area-resized through integral images, kept as NPY tiles with difference hashes.

Defined results: a null image gives null results; bytes that are no Netpbm or BMP image, samples that are
too few, no whole numbers or larger than the header's maximum, and images without pixels raise ``ValueError`` in
:func:`decode` or give null results in :func:`media_tiles`. Null text is empty; equal texts give equal values; an empty
table gives no rows; null keys are kept. An image may be any size that a binary column holds; the
integral image is built in blocks of rows, so memory beyond the image itself is bounded by ``BLOCK_ROWS``.
Only the named columns are read, so other columns of the input, whatever their names, do no harm.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import chunks, table, utf8

BLOCK_ROWS = 8192
HEADER = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
SAMPLE = re.compile(rb"\d{1,5}")
MAXVAL = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary Netpbm: P5 for (h, w), P6 for (h, w, 3), 8 bits a sample."""
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit grey for (h, w), 24-bit for (h, w, 3); rows bottom-up, padded to four bytes."""
    h, w = samples.shape[:2]
    colours = b"".join(bytes((i, i, i, 0)) for i in range(256)) if samples.ndim == 2 else b""
    rows = samples[::-1] if samples.ndim == 2 else samples[::-1, :, ::-1]
    rows = np.ascontiguousarray(rows, dtype=np.uint8).reshape(h, -1)
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
    at = 54 + len(colours)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if samples.ndim == 2 else 24, 0, len(body), 2835, 2835, len(colours) // 4, 0)
    return struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at) + info + colours + body


def decode(image: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) samples of a Netpbm (P1 to P6) or uncompressed 8-, 24- or 32-bit BMP image."""
    return _decode_bmp(image) if image[:2] == b"BM" else _decode_netpbm(image)


def enough(image: bytes, start: int, n: int) -> None:
    """A header may promise any number of bytes: compared as Python's integers, before any array of that size."""
    if start + n > len(image):
        raise ValueError("the image is shorter than its header says")


def _decode_netpbm(image: bytes) -> np.ndarray:
    head = HEADER.match(image)
    if not head:
        raise ValueError("neither Netpbm nor BMP")
    kind, w, h, at, most = head[1], int(head[2]), int(head[3]), head.end(), 1
    if kind not in (b"P1", b"P4"):
        found = MAXVAL.match(image, at)
        if not found or not 0 < int(found[1]) < 65536:
            raise ValueError("a Netpbm image needs a maximum from 1 to 65535")
        most, at = int(found[1]), found.end()
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = math.prod(shape)
    if not n:
        raise ValueError("a Netpbm image without pixels")
    if kind == b"P1":  # digits may stand without spaces between them
        bits = re.sub(rb"#[^\n]*", b"", image[at:]).translate(None, b" \t\r\n\v\f")[:n]
        if len(bits) < n or bits.strip(b"01"):
            raise ValueError("a plain bitmap needs a 0 or 1 for each pixel")
        out = np.frombuffer(bits, np.uint8) == ord("0")
    elif kind in (b"P2", b"P3"):
        samples = re.sub(rb"#[^\n]*", b"", image[at:]).split()[:n]
        if len(samples) < n or not all(SAMPLE.fullmatch(x) for x in samples):
            raise ValueError("a plain image needs a whole number for each sample")
        out = np.array(samples, dtype=np.int64)
    elif kind == b"P4":
        wide = -(-w // 8)
        enough(image, at + 1, wide * h)
        rows = np.frombuffer(image, np.uint8, wide * h, at + 1).reshape(h, wide)
        out = np.unpackbits(rows, axis=1)[:, :w] == 0
    else:
        enough(image, at + 1, n if most < 256 else 2 * n)
        out = np.frombuffer(image, np.uint8 if most < 256 else ">u2", n, at + 1)
    if kind not in (b"P1", b"P4") and out.max() > most:
        raise ValueError("a sample is larger than the maximum that the header names")
    out = out.reshape(shape)
    return out.astype(np.uint8) * 255 if kind in (b"P1", b"P4") else out.astype(np.uint8 if most < 256 else np.uint16, copy=False)


def _decode_bmp(image: bytes) -> np.ndarray:
    at, (size, w, h, _, depth, packed) = struct.unpack_from("<I", image, 10)[0], struct.unpack_from("<IiiHHI", image, 14)
    if packed or depth not in (8, 24, 32):
        raise ValueError("only uncompressed 8-, 24- and 32-bit BMP")
    if w < 1 or not h:
        raise ValueError("a BMP image without pixels")
    wide = (w * depth // 8 + 3) // 4 * 4
    enough(image, at, wide * abs(h))
    rows = np.frombuffer(image, np.uint8, wide * abs(h), at).reshape(abs(h), wide)[:: -1 if h > 0 else 1, : w * depth // 8]
    if depth != 8:
        return np.ascontiguousarray(rows.reshape(abs(h), w, depth // 8)[:, :, 2::-1])
    n = struct.unpack_from("<I", image, 46)[0] or 256
    if n > 256:
        raise ValueError("an 8-bit BMP has at most 256 colours")
    enough(image, 14 + size, 4 * n)
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(image, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
    out = colours[rows]
    return np.ascontiguousarray(out[:, :, 0]) if (out == out[:, :, :1]).all() else out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the source area under each target pixel, as float64.

    Both axes use the integral image: a target edge that cuts a source pixel interpolates between two sums. The rows'
    sums are carried from block to block and kept only at the target's edges.
    """
    h, w = image.shape[:2]
    flat = image.reshape(h, w, -1)
    edges = np.arange(height + 1) * h / height
    whole = np.minimum(edges.astype(np.int64), h - 1)
    sums, carried = np.empty((height + 1, w, flat.shape[2])), np.zeros((w, flat.shape[2]))
    for start in range(0, h, BLOCK_ROWS):
        rows = flat[start : start + BLOCK_ROWS]
        wanted = np.flatnonzero((whole >= start) & (whole < start + len(rows)))
        integral = np.vstack([np.zeros((1, *carried.shape)), rows.cumsum(axis=0, dtype=np.float64)]) + carried
        part = (edges[wanted] - whole[wanted])[:, None, None]
        sums[wanted] = integral[whole[wanted] - start] + part * rows[whole[wanted] - start]
        carried = integral[-1]
    across = np.concatenate([np.zeros((height + 1, 1, flat.shape[2])), sums.cumsum(axis=1)], axis=1)
    edges = np.arange(width + 1) * w / width
    whole = np.minimum(edges.astype(np.int64), w - 1)
    part = (edges - whole)[None, :, None]
    integral = across[:, whole] + part * (across[:, whole + 1] - across[:, whole])
    out = np.diff(np.diff(integral, axis=0), axis=1) / (h / height * (w / width))
    return out.reshape((height, width, *image.shape[2:]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each pixel of an 8 by 9 area-resized grey image is darker than its right neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:] - 1e-9).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def from_npy(stored: bytes) -> np.ndarray:
    return np.load(io.BytesIO(stored), allow_pickle=False)


def tiles(image: np.ndarray, rows: int, cols: int):
    """(row, column, samples) of each tile, left to right and top to bottom; the last ones may be smaller."""
    for r in range(0, image.shape[0], rows):
        for c in range(0, image.shape[1], cols):
            yield r // rows, c // cols, np.ascontiguousarray(image[r : r + rows, c : c + cols])


def media_tiles(df: DataFrame, key: str, image: str, resize: tuple[int, int] | None = (64, 64), tile: tuple[int, int] = (32, 32)) -> DataFrame:
    """One row per tile: the key, tile_row, tile_col, the NPY bytes and the tile's difference hash.

    ``resize`` gives the height and width before cutting (None keeps the samples as they are, without loss). Null or
    undecodable images give one row whose tile columns are null.
    """

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, image):
                at, out = [], []
                for i, stored in enumerate(batch.column(1).to_pylist()):
                    try:
                        samples = None if stored is None else decode(stored)
                    except (ValueError, struct.error):
                        samples = None
                    if samples is None or not samples.size:
                        found = [(None, None, None, None)]
                    else:
                        if resize:
                            samples = np.rint(area_resize(samples, *resize)).astype(samples.dtype)
                        found = [(r, c, npy(x), difference_hash(x)) for r, c, x in tiles(samples, *tile)]
                    at += [i] * len(found)
                    out += found
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], [key, "tile_row", "tile_col", "tile", "tile_hash"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, tile_row int, tile_col int, tile binary, tile_hash string"
    return df.select(key, image).mapInArrow(run, schema)


UNIT, WIDTH, PAD = 576, 24, b"\xff"
#: Rows of 24 samples in a tile of the registered query; longer texts have several tiles.
TILE_ROWS = 4096


def bytes_as_images(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as a grey Netpbm image 24 samples wide.

    Columns: the key and image. Null text counts as empty. No byte of UTF-8 is 255, so the padding can be told from the text.
    """

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, text):
                images = []
                for x in utf8(batch.column(text)):
                    payload = x + PAD * (-len(x) % UNIT if x else UNIT)
                    images.append(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(images, pa.binary())], [key, "image"])

    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, image binary")


def stored_features(tiled: DataFrame, key: str) -> DataFrame:
    """From media_tiles' rows: per image, what is read back from its NPY tiles, digests of the stored form, and the features.

    A row without a tile is an image that is null or couldn't be decoded: its results are null. Tiles are those of
    images one tile wide, as the samples of rows below one another.

    An image's tiles come one after the other from one task and are read before any shuffle, so that a tile (0, 0) begins
    an image; they are put together again in that order. ``feature`` is the difference hash of the whole image,
    ``tile_hashes`` those of its tiles, ``thumb_sha256`` the digest of its 32 by 32 NPY tile.
    """
    names = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_tiles": "long", "tile_hashes": "string", "thumb_sha256": "string"}

    def one(held):
        stored, hashes = [t for t, _ in held], [h for _, h in held]
        samples = np.vstack([from_npy(t) for t in stored])
        payload = samples.tobytes()
        thumb = npy(np.rint(area_resize(samples, 32, 32)).astype(np.uint8))
        media = hashlib.sha256()
        for t in stored:
            media.update(t)
        return (
            len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sum(map(len, stored)), media.hexdigest(),
            hashes[0] if len(stored) == 1 else difference_hash(samples), len(stored), " ".join(hashes), hashlib.sha256(thumb).hexdigest(),
        )

    def run(batches):
        keys, rows, held = [], [], []

        def out():
            columns = [pa.array(x, pa.string() if t == "string" else pa.int64()) for x, t in zip(zip(*rows, strict=True), names.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], [key, *names])

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("tile_row", "tile_col", "tile", "tile_hash"))
            for i, (r, c, tile, found) in enumerate(zip(*columns, strict=True)):
                if tile is None or (r, c) == (0, 0):
                    if held:
                        rows.append(one(held))
                        held = []
                    if len(rows) >= 1000:
                        yield out()
                        keys, rows = [], []
                    keys.append(batch[key].slice(i, 1))
                if tile is None:
                    rows.append((None,) * len(names))
                else:
                    held.append((tile, found))
        if held:
            rows.append(one(held))
        if rows:
            yield out()

    return tiled.mapInArrow(run, f"`{key}` {tiled.schema[key].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in names.items()))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stored_features(media_tiles(bytes_as_images(docs, "doc_id", "text"), "doc_id", "image", resize=None, tile=(TILE_ROWS, WIDTH)), "doc_id")
