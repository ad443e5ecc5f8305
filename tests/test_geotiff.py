"""GeoTIFF files of many kinds, read back."""

import itertools

import numpy as np
import pytest

from geolark.schema import GridMeta
from geolark.sources import geotiff as G


def read(path):
    """All pixels, without Spark around the reader."""
    reader = G.GeoTiffReader(str(path))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return {(r["row"], r["col"]): r for r in rows}, len(reader.partitions())


@pytest.mark.parametrize(("kind", "predictor"), [("u1", 1), ("u1", 2), ("i2", 2), ("u4", 2), ("f4", 1), ("f4", 3), ("f8", 3), ("i4", 1)])
def test_kinds_of_files(tmp_path, kind, predictor):
    rng = np.random.default_rng(5)
    m = rng.normal(scale=50, size=(21, 13, 3)).astype(kind) if kind[0] == "f" else rng.integers(0, 100, (21, 13, 3)).astype(kind)
    for n, (order, compression, block, separate) in enumerate(itertools.product("<>", (G.NONE, G.DEFLATE), (None, (16, 16), (4, 8)), (False, True))):
        path = tmp_path / f"{n}.tif"
        path.write_bytes(G.encoded(m, order, compression, predictor, block, 5, separate))
        got, parts = read(path)
        assert parts == -(-21 // (block[0] if block else 5))
        assert len(got) == 21 * 13 and all(got[i, j]["v"] == m[i, j].astype(float).tolist() and got[i, j]["lat"] is None for i in range(21) for j in range(13))


def lzw_encoded(data):
    """Plain LZW with the early change of width."""
    out, bits, table = 0, 0, {}

    def put(code, width):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    width, word = 9, b""
    put(256, 9)
    table = {bytes([i]): i for i in range(256)}
    n = 258
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = n
        n += 1
        width = 9 + (n >= 511) + (n >= 1023) + (n >= 2047)
        word = bytes([byte])
        if n == 4094:
            put(table[word], width)
            put(256, width)
            table, n, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if word:
        put(table[word], width)
        n += 1
        width = 9 + (n >= 511) + (n >= 1023) + (n >= 2047)
    put(257, width)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def test_lzw():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the format's own example
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert G.lzw_decoded(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(6)
    for n, top in ((0, 2), (1, 2), (3000, 3), (20_000, 256), (60_000, 5)):
        data = rng.integers(0, top, n).astype(np.uint8).tobytes()
        assert G.lzw_decoded(lzw_encoded(data)) == data


def test_lzw_file(tmp_path, monkeypatch):
    m = np.arange(200, dtype=np.uint8).reshape(10, 10, 2)
    monkeypatch.setattr(G.zlib, "compress", lzw_encoded)
    raw = G.encoded(m, compression=G.DEFLATE)
    monkeypatch.undo()
    at = raw.index(np.array([G.COMPRESSION, 3], "<u2").tobytes()) + 8
    (tmp_path / "a.tif").write_bytes(raw[:at] + bytes([G.LZW, 0]) + raw[at + 2 :])
    got, _ = read(tmp_path / "a.tif")
    assert all(got[i, j]["v"] == m[i, j].tolist() for i in range(10) for j in range(10))


def test_mosaic_round_trip(spark, tmp_path):
    meta = GridMeta(30, 21)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(630, 4)).astype(np.float32).astype(float).tolist()
    rows = [(i, None if i % 11 == 0 else v[i]) for i in range(630) if i % 7]
    df = spark.createDataFrame(rows, "pixel long, v array<double>")
    G.write_geotiffs(df, str(tmp_path / "m"), meta, 4, rows=8)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["rows-0.tif", "rows-1.tif", "rows-2.tif"]
    back = G.read_geotiff(spark, str(tmp_path / "m"))
    assert back.rdd.getNumPartitions() == 3
    got = {r.p: r.v for r in back.select(G.pixel_of(back["lat"], back["lng"], meta).alias("p"), "v").collect()}
    assert got == {i: dict(rows).get(i) for i in range(630)}


def test_bad_files(tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no image at all..")
    with pytest.raises(ValueError, match="not a TIFF"):
        G.GeoTiffReader(str(tmp_path)).partitions()
    m = np.zeros((4, 4, 1), np.uint8)
    raw = G.encoded(m)
    at = raw.index(np.array([G.COMPRESSION, 3], "<u2").tobytes()) + 8
    (tmp_path / "a.tif").write_bytes(raw[:at] + bytes([7, 0]) + raw[at + 2 :])
    with pytest.raises(ValueError, match="compression 7"):
        G.GeoTiffReader(str(tmp_path / "a.tif")).partitions()


def test_no_data_value(tmp_path):
    m = np.array([[[1], [9]], [[3], [4]]], np.int16)
    (tmp_path / "a.tif").write_bytes(G.encoded(m, no_data="9", scale=(1.0, 2.0, 0.0), tie=(0.0, 0.0, 0.0, 10.0, 50.0, 0.0)))
    got, _ = read(tmp_path / "a.tif")
    assert got[0, 1]["v"] is None and got[1, 0]["v"] == [3.0] and (got[1, 1]["lat"], got[1, 1]["lng"]) == (47.0, 11.5)
