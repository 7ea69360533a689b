"""The cube source on small reference files."""

import base64
import datetime as dt
import json
import zlib

import numpy as np
import pytest
from tsengine.operators import align
from tsengine.operators.domain import Domain
from tsengine.sources.cube import read_cube

T, Y, X = 5, 7, 4
CHUNKS = (2, 3, 4)


@pytest.fixture(scope="module")
def cube(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cube")
    rng = np.random.default_rng(0)
    arrays = {"t": rng.normal(280, 5, (T, Y, X)).astype("<f4"), "r2": rng.integers(0, 100, (T, Y, X)).astype("<i2")}
    arrays["t"][0, 0, 0] = np.nan
    arrays["r2"][1, 1, 1] = -1
    refs = {".zgroup": json.dumps({"zarr_format": 2}), "valid_time/.zarray": json.dumps({"shape": [T], "chunks": [3], "dtype": "<i8", "compressor": None, "fill_value": None}), "valid_time/.zattrs": json.dumps({"units": "hours since 2024-01-01"})}
    hours = np.zeros(6, "<i8")
    hours[:T] = np.arange(T)
    for i in range(2):
        refs[f"valid_time/{i}"] = "base64:" + base64.b64encode(hours[3 * i : 3 * i + 3].tobytes()).decode()
    blob, where = bytearray(), {}
    for name, a in arrays.items():
        packed = name == "r2"
        refs[f"{name}/.zarray"] = json.dumps({"shape": [T, Y, X], "chunks": list(CHUNKS), "dtype": a.dtype.str, "compressor": {"id": "zlib", "level": 1} if packed else None, "fill_value": -1 if packed else "NaN", "order": "C"})
        for at in np.ndindex(*(-(-n // c) for n, c in zip((T, Y, X), CHUNKS, strict=True))):
            part = np.zeros(CHUNKS, a.dtype)
            some = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, CHUNKS, strict=True))]
            part[tuple(slice(0, n) for n in some.shape)] = some
            raw = zlib.compress(part.tobytes()) if packed else part.tobytes()
            where[name, at] = (len(blob), len(raw))
            refs[f"{name}/{'.'.join(map(str, at))}"] = ["parts.bin", len(blob), len(raw)]
            blob += raw
    del refs["r2/2.2.0"]
    (folder / "parts.bin").write_bytes(blob)
    (folder / "refs.json").write_text(json.dumps({"version": 1, "refs": refs}))
    return folder, arrays, where


def test_all_rows(spark, cube):
    folder, arrays, _ = cube
    df = read_cube(spark, str(folder / "refs.json"), ["t", "r2"])
    assert df.rdd.getNumPartitions() == 9
    rows = df.collect()
    assert len(rows) == T * Y * X
    for r in rows:
        at = (int((r.valid_time - dt.datetime(2024, 1, 1)).total_seconds() // 3600), r.y, r.x)
        t, h = arrays["t"][at], arrays["r2"][at]
        assert (r.t is None) if np.isnan(t) else r.t == pytest.approx(float(t))
        assert r.r2 == (None if h == -1 or (at[0] >= 4 and at[1] >= 6) else float(h))


def test_times_and_cells_choose_chunks(spark, cube, tmp_path):
    """Chunks that aren't asked for aren't read: here, their bytes are gone."""
    folder, arrays, where = cube
    blob = bytearray((folder / "parts.bin").read_bytes())
    for (_, at), (start, n) in where.items():
        if not (at[0] == 1 and at[1] in (0, 2)):
            blob[start : start + n] = b"\xff" * n
    (tmp_path / "parts.bin").write_bytes(blob)
    (tmp_path / "refs.json").write_text((folder / "refs.json").read_text())
    path = str(tmp_path / "refs.json")
    some = read_cube(spark, path, ["r2"], "2024-01-01 02:00:00", "2024-01-01 03:59:00", [(1, 0), (1, 3), (6, 2), (1, 0), (99, 0)])
    assert some.rdd.getNumPartitions() == 2
    assert {(r.valid_time.hour, r.y, r.x): r.r2 for r in some.collect()} == {(t, y, x): float(arrays["r2"][t, y, x]) for t in (2, 3) for y, x in ((1, 0), (1, 3), (6, 2))}
    one = read_cube(spark, path, ["r2"], "2024-01-01 03:00:00", "2024-01-01 03:00:00", [(2, 0)])
    assert one.rdd.getNumPartitions() == 1 and [(r.valid_time.hour, r.y, r.x) for r in one.collect()] == [(3, 2, 0)]
    assert one.filter("y > 90").count() == 0 and one.count() == 1
    assert read_cube(spark, path, ["r2"], cells=[]).count() == 0 and read_cube(spark, path, ["r2"], "2030-01-01").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        read_cube(spark, path, ["r2"]).collect()


def test_at_cells(spark, cube):
    folder, arrays, _ = cube
    df = read_cube(spark, str(folder / "refs.json"), ["t"])
    cells = spark.createDataFrame([("a", 2, 3), ("b", 5, 0)], "location string, y int, x int")
    grid = Domain("2024-01-01 00:00:00", "2024-01-01 06:00:00", "1 hour").grid(spark, ["a", "b", "none"])
    got = {(r.location, r.date_time.hour): r.t for r in align.at_cells(grid, cells, df, ["t"]).collect()}
    assert len(got) == 21 and got["none", 1] is None and got["a", 6] is None
    assert all(got[p, h] == pytest.approx(float(arrays["t"][h, y, x])) for p, y, x in (("a", 2, 3), ("b", 5, 0)) for h in range(T))


def test_faults_are_named(spark, cube, tmp_path):
    folder, *_ = cube
    held = json.loads((folder / "refs.json").read_text())
    held["refs"]["t/.zarray"] = held["refs"]["t/.zarray"].replace("null", json.dumps({"id": "blosc"}), 1)
    (tmp_path / "refs.json").write_text(json.dumps(held))
    for names, words in ((["t"], "zlib"), (["nothing"], "no array")):
        with pytest.raises(Exception, match=words):
            read_cube(spark, str(tmp_path / "refs.json"), names).collect()
