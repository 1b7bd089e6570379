"""Raster files: round trips, files made by hand, and strips that a hyperslab leaves closed."""

import glob
import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import rasters
from rasterloom.sources.grids import GridSpec


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(1)
    data = [(x, y, None if rng.random() < 0.1 else rng.uniform(-5, 5), rng.randrange(-100, 100)) for x in range(13) for y in range(37) if (x, y) != (4, 5)]
    return data, spark.createDataFrame(data, "x int, y int, a double, b int")


@pytest.mark.parametrize(("form", "columns"), [("flat", ["a"]), ("flat", ["b"]), ("netcdf", ["a", "b"]), ("netcdf", ["b", "a"])])
@pytest.mark.parametrize("strip", [1, 5, 100])
def test_round_trip(spark, cells, tmp_path, form, columns, strip):
    data, df = cells
    path = str(tmp_path / "r")
    for _ in range(2):
        rasters.write_raster(df.select("x", "y", *columns), GridSpec(13, 37), path, form, strip, nodata=-9999)
    full = {(x, y): dict(a=a, b=b) for x, y, a, b in data}
    want = [(x, y, *(full.get((x, y), {}).get(c) for c in columns)) for x in range(13) for y in range(37)]
    got = rasters.read_raster(spark, path, form)
    assert rows(got) == sorted(want, key=str)
    part = lambda **within: rows(rasters.read_raster(spark, path, form, within=within))
    assert part(x=(4, 7), y=(30, 90)) == sorted((r for r in want if 3 < r[0] <= 7 and r[1] >= 30), key=str)
    assert part(y=(100, 200)) == [] and part(y=(5, 3)) == [] and part(x=(-3, -1)) == []
    assert got.where("y < 3 AND y > 5").count() == 0 and got.where("x < 2 OR y < 2").count() == 2 * 37 + 2 * 13 - 4
    # What an earlier version of the raster held is gone.
    listed = json.load(open(f"{path}/{rasters.LIST}"))["strips"]
    assert len(glob.glob(f"{path}/strip-*.raw")) + len(glob.glob(f"{path}/strip-*.nc")) == len(listed) == -(-37 // strip)


@pytest.mark.parametrize("form", ["flat", "netcdf"])
def test_a_hyperslab_opens_only_its_strips(spark, cells, tmp_path, form):
    _, df = cells
    path = str(tmp_path / "r")
    rasters.write_raster(df.select("x", "y", "a"), GridSpec(13, 37), path, form, 10)
    want = rows(rasters.read_raster(spark, path, form, within={"y": (10, 19)}))
    for name, first, _ in json.load(open(f"{path}/{rasters.LIST}"))["strips"]:
        if first != 10:
            os.remove(f"{path}/{name}")
    assert rows(rasters.read_raster(spark, path, form, within={"y": (10, 19)})) == want
    with pytest.raises(Exception, match="strip-"):
        rasters.read_raster(spark, path, form, within={"y": (10, 20)}).collect()


def test_each_netcdf_strip_is_a_file_of_its_own(spark, cells, tmp_path):
    _, df = cells
    path = str(tmp_path / "r")
    rasters.write_raster(df.select("x", "y", "a", "b"), GridSpec(13, 37), path, "netcdf", 10)
    name, first, n = json.load(open(f"{path}/{rasters.LIST}"))["strips"][1]
    alone = rasters.read_raster(spark, f"{path}/{name}", "netcdf", variables=["a", "b"])
    shifted = alone.withColumn("y", F.col("y") + first)
    assert n == 10 and rows(shifted) == rows(rasters.read_raster(spark, path, "netcdf", within={"y": (10, 19)}))


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("order", [0, 1])
def test_flat_files_by_hand(spark, tmp_path, interleave, order):
    a = np.arange(2 * 6 * 4).reshape(2, 6, 4).astype(">i2" if order else "<i2")
    stored = {"bsq": a, "bil": a.transpose(1, 0, 2), "bip": a.transpose(1, 2, 0)}[interleave]
    (tmp_path / "f.img").write_bytes(b"headbyte" + np.ascontiguousarray(stored).tobytes())
    (tmp_path / "f.hdr").write_text(f"ENVI\ndescription = {{\n made by hand }}\nsamples = 4\nlines = 6\nbands = 2\nheader offset = 8\ndata type = 2\ninterleave = {interleave}\nbyte order = {order}\nband names = {{\n red, nir }}\ndata ignore value = 7\n")
    got = rasters.read_raster(spark, str(tmp_path / "f.img"), "flat", strip_rows=4)
    assert got.columns == ["x", "y", "red", "nir"]
    want = [(x, y, None if a[0, y, x] == 7 else int(a[0, y, x]), int(a[1, y, x])) for x in range(4) for y in range(6)]
    assert rows(got) == sorted(want, key=str)
    assert rows(got.where("x = 3 AND y = 5")) == [(3, 5, 23, 47)]


def netcdf_by_hand(version, cube, second, records):
    """A cube t(z, y, x) of floats, where z may be the record dimension, and a second variable beside it."""
    z, h, w = cube.shape
    count, offset = {1: (">i", ">i"), 2: (">i", ">q"), 5: (">q", ">q")}[version]
    num = lambda n: struct.pack(count, n)
    name = lambda s: num(len(s)) + s.encode() + bytes(-len(s) % 4)
    dims = struct.pack(">i", 10) + num(3) + name("z") + num(0 if records else z) + name("lat") + num(h) + name("x") + num(w)
    notes = struct.pack(">i", 12) + num(1) + name("title") + struct.pack(">i", 2) + num(5) + b"hello" + bytes(3)
    body = [cube.astype(">f4"), second.astype(">i2")]

    def head(begins):
        out = b"CDF" + bytes([version]) + num(z if records else 0) + dims + notes + struct.pack(">i", 11) + num(2)
        for n, kind, begin, data in (("t", 5, begins[0], body[0]), ("s", 3, begins[1], body[1])):
            fill = struct.pack(">i", 12) + num(1) + name("_FillValue") + struct.pack(">i", kind) + num(1) + (np.array(-1, data.dtype).tobytes() + bytes(3))[: 4]
            out += name(n) + num(3) + num(0) + num(1) + num(2) + fill + struct.pack(">i", kind) + num(data.nbytes) + struct.pack(offset, begin)
        return out

    pad = lambda b: b + bytes(-len(b) % 4)
    size = len(head((0, 0)))
    if records:
        return head((size, size + len(pad(body[0][0].tobytes())))) + b"".join(pad(body[0][k].tobytes()) + pad(body[1][k].tobytes()) for k in range(z))
    return head((size, size + len(pad(body[0].tobytes())))) + b"".join(pad(b.tobytes()) for b in body)


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("records", [False, True])
def test_netcdf_files_by_hand(spark, tmp_path, version, records):
    cube = np.arange(3 * 5 * 3, dtype="f4").reshape(3, 5, 3) / 2
    cube[1, 2, 1] = -1
    second = (np.arange(45).reshape(3, 5, 3) * 3).astype("i2")
    (tmp_path / "c.nc").write_bytes(netcdf_by_hand(version, cube, second, records))
    for name, data in (("t", cube), ("s", second)):
        got = rasters.read_raster(spark, str(tmp_path / "c.nc"), "netcdf", strip_rows=2, variables=[name])
        assert got.columns == ["x", "y", "z", name]
        want = [(x, y, k, None if data[k, y, x] == -1 else data[k, y, x].item()) for x in range(3) for y in range(5) for k in range(3)]
        assert rows(got) == sorted(want, key=str)
        assert rows(rasters.read_raster(spark, str(tmp_path / "c.nc"), "netcdf", 2, [name], {"z": (2, 2), "y": (4, 4)})) == sorted((r for r in want if r[2] == 2 and r[1] >= 4), key=str)


def test_errors(spark, cells, tmp_path):
    _, df = cells
    with pytest.raises(ValueError, match="no samples"):
        rasters.write_raster(df.withColumn("c", F.lit("x")), GridSpec(13, 37), str(tmp_path / "r"))
    (tmp_path / "no.nc").write_bytes(b"HDF5....")
    with pytest.raises(Exception, match="no classic NetCDF"):
        rasters.read_raster(spark, str(tmp_path / "no.nc"), "netcdf").collect()
