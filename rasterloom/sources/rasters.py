"""Raster files as cells: flat rasters with a text header and classic NetCDF, read and written strip by strip.

A Python data source has a partition for each strip of rows, and of each slice of a cube. A hyperslab is told
to the reader, so strips outside it are never opened, and of others only the rows within are read. (It is no filter
that Spark pushes down: Spark 4.1 keeps pushed filters with the loaded table, and a second query of the same DataFrame
whose filter can't be pushed would get the first one's rows.)
What is written is a folder of strips, each a whole file of its format, and a list of them that is written
last: a task that fails leaves a file that no list names. Files are reached through pyarrow's file systems, so local
(shared) folders and the stores that pyarrow knows will do, and executors need the same access as the driver.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from rasterloom.sources.grids import GridSpec

#: Bytes of a strip where its number of rows isn't given, and cells of a record batch.
STRIP_BYTES, BATCH_CELLS = 8 << 20, 1 << 19
LIST = "strips.json"
#: Fixed values of the file formats: codes of the flat raster's and of NetCDF's types, and the marks of NetCDF's lists.
FLAT_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2"}
NETCDF_TYPES = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8", 7: "u1", 8: "u2", 9: "u4", 10: "i8", 11: "u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Spark's types of what a sample's type needs.
SPARK_TYPES = {"u1": "int", "i1": "int", "i2": "int", "u2": "int", "i4": "int", "u4": "long", "i8": "long", "f4": "float", "f8": "double"}
SAMPLES = {"tinyint": "i2", "smallint": "i2", "int": "i4", "float": "f4", "double": "f8"}


@dataclass(frozen=True)
class Band:
    """Where a band's samples lie in a file: the first one's byte, bytes from row to row, items from sample to sample."""

    name: str
    kind: str
    begin: int
    stride: int
    step: int = 1
    nodata: float | None = None


@dataclass
class Strip(InputPartition):
    """Rows of a file: first and number count in the grid, skip says how many rows of the file come before."""

    file: str
    width: int
    first: int
    rows: int
    skip: int
    z: int | None
    bands: tuple[Band, ...]


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _bytes(path: str, offset: int = 0, size: int | None = None) -> bytes:
    fs, at = _store(path)
    with fs.open_input_file(at) as f:
        return f.read_at(f.size() - offset if size is None else size, offset)


def _exists(path: str) -> bool:
    fs, at = _store(path)
    return fs.get_file_info(at).type == pyarrow.fs.FileType.File


def _write(path: str, data: bytes) -> None:
    fs, at = _store(path)
    with fs.open_output_stream(at) as f:
        f.write(data)


def flat_header(text: str) -> dict[str, str]:
    """Names and values of a flat raster's header; values in braces may go over lines."""
    out, lines = {}, iter(text.splitlines())
    for line in lines:
        name, sign, value = line.partition("=")
        if not sign:
            continue
        while "{" in value and "}" not in value:
            value += " " + next(lines)
        out[name.strip().lower()] = value.strip().strip("{}").strip()
    return out


def flat_layout(text: str) -> tuple[int, int, list[Band]]:
    """Width, height and bands of a flat raster, by its header."""
    h = flat_header(text)
    width, height, n = int(h["samples"]), int(h["lines"]), int(h.get("bands", 1))
    kind = (">" if h.get("byte order", "0") == "1" else "<") + FLAT_TYPES[int(h["data type"])]
    size, begin = np.dtype(kind).itemsize, int(h.get("header offset", 0))
    names = [x.strip() for x in h["band names"].split(",")] if "band names" in h else [f"band{k + 1}" for k in range(n)]
    nodata = float(h["data ignore value"]) if "data ignore value" in h else None
    at = {
        "bsq": lambda k: (begin + k * height * width * size, width * size, 1),
        "bil": lambda k: (begin + k * width * size, n * width * size, 1),
        "bip": lambda k: (begin + k * size, n * width * size, n),
    }[h.get("interleave", "bsq").lower()]
    return width, height, [Band(name, kind, *at(k), nodata) for k, name in enumerate(names)]


def flat_file(bands: dict[str, np.ndarray], first: int, nodata: float | None) -> tuple[bytes, str]:
    """Samples, band after band, and header of a flat raster; all bands are of one type."""
    kinds = {v.dtype.str[1:] for v in bands.values()}
    if len(kinds) > 1:
        raise ValueError(f"a flat raster's bands are of one type, not {sorted(kinds)}")
    kind = kinds.pop()
    height, width = next(iter(bands.values())).shape
    lines = ["ENVI", f"samples = {width}", f"lines = {height}", f"bands = {len(bands)}", "header offset = 0", f"data type = {next(c for c, k in FLAT_TYPES.items() if k == kind)}", "interleave = bsq", "byte order = 0", f"y start = {first + 1}"]
    lines += [f"band names = {{{', '.join(bands)}}}"] + ([] if nodata is None else [f"data ignore value = {nodata!r}"])
    return b"".join(v.astype("<" + kind).tobytes() for v in bands.values()), "\n".join(lines) + "\n"


class _Header:
    """Reads a classic NetCDF header; numbers are big-endian, and wider in the later versions."""

    def __init__(self, path: str):
        self.path, self.at, self.data = path, 4, _bytes(path, 0, 1 << 16)
        if self.data[:3] != b"CDF" or self.data[3] not in (1, 2, 5):
            raise ValueError(f"no classic NetCDF file: {path}")
        self.count, self.offset = ("i", "i") if self.data[3] == 1 else ("i", "q") if self.data[3] == 2 else ("q", "q")

    def raw(self, n: int) -> bytes:
        while self.at + n > len(self.data):
            more = _bytes(self.path, len(self.data), max(n, len(self.data)))
            if not more:
                raise ValueError(f"the header ends early: {self.path}")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(">" + code, self.raw(struct.calcsize(code)))[0]

    def name(self) -> str:
        n = self.number(self.count)
        return self.raw(n + -n % 4)[:n].decode()

    def items(self, read) -> list:
        self.number("i")
        return [read() for _ in range(self.number(self.count))]

    def attribute(self) -> tuple[str, object]:
        name, kind, n = self.name(), NETCDF_TYPES[self.number("i")], self.number(self.count)
        size = n * np.dtype(kind).itemsize
        raw = self.raw(size + -size % 4)[:size]
        return name, raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, ">" + kind)

    def variable(self) -> dict:
        out = {"name": self.name(), "dims": [self.number(self.count) for _ in range(self.number(self.count))], "attributes": dict(self.items(self.attribute)), "kind": NETCDF_TYPES[self.number("i")]}
        self.number(self.count)
        return out | {"begin": self.number(self.offset)}


def netcdf_layout(path: str, variables: list[str] | None = None) -> tuple[int, int, int | None, int, list[Band]]:
    """Width, height, slices (None of a plane), bytes from slice to slice, and bands: the named variables of two or three dimensions, or all that share the first one's."""
    h = _Header(path)
    records = h.number(h.count)
    dims = h.items(lambda: (h.name(), h.number(h.count)))
    h.items(h.attribute)
    found = h.items(h.variable)
    item = lambda v: np.dtype(v["kind"]).itemsize
    inner = lambda v: item(v) * int(np.prod([dims[d][1] for d in v["dims"] if dims[d][1] != 0], dtype=np.int64))
    record = [v for v in found if v["dims"] and dims[v["dims"][0]][1] == 0]
    # Records of several variables take turns, each padded to four bytes.
    turn = sum(inner(v) + (-inner(v) % 4 if len(record) > 1 else 0) for v in record)
    usable = [v for v in found if len(v["dims"]) in (2, 3) and v["kind"] != "S1" and (variables is None or v["name"] in variables)]
    usable = [v for v in usable if v["dims"] == usable[0]["dims"]]
    if not usable:
        raise ValueError(f"no variable of two or three dimensions: {path}")
    lengths = [dims[d][1] or records for d in usable[0]["dims"]]
    by_record = dims[usable[0]["dims"][0]][1] == 0
    height, width = lengths[-2:]
    bands, jump = [], 0
    for v in usable:
        fill = v["attributes"].get("_FillValue", v["attributes"].get("missing_value"))
        stride = turn if by_record and len(lengths) == 2 else width * item(v)
        bands.append(Band(v["name"], ">" + v["kind"], v["begin"], stride, 1, None if fill is None else float(fill[0])))
        jump = turn if by_record else height * width * item(v)
    if len(lengths) == 3 and not by_record and len({b.kind for b in bands}) > 1:
        bands = [b for b in bands if b.kind == bands[0].kind]
        jump = height * width * np.dtype(bands[0].kind).itemsize
    return width, height, lengths[0] if len(lengths) == 3 else None, jump, bands


def netcdf_file(bands: dict[str, np.ndarray], first: int, nodata: float | None) -> bytes:
    """A classic NetCDF file (64-bit offsets) of planes over y and x, with both as coordinate variables."""
    height, width = next(iter(bands.values())).shape
    code = {k: c for c, k in NETCDF_TYPES.items()}
    name = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + bytes(-len(s.encode()) % 4)
    padded = lambda b: b + bytes(-len(b) % 4)
    planes = [("y", [0], np.arange(first, first + height, dtype="i4")), ("x", [1], np.arange(width, dtype="i4"))] + [(n, [0, 1], v) for n, v in bands.items()]
    body = [padded(v.astype(v.dtype.newbyteorder(">")).tobytes()) for _, _, v in planes]

    def head(begin: int) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSIONS, 2) + name("y") + struct.pack(">i", height) + name("x") + struct.pack(">i", width)
        out += struct.pack(">ii", 0, 0) + struct.pack(">ii", VARIABLES, len(planes))
        for (n, dims, v), raw in zip(planes, body, strict=True):
            kind = v.dtype.str[1:]
            out += name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims)
            if nodata is None or n in ("x", "y"):
                out += struct.pack(">ii", 0, 0)
            else:
                out += struct.pack(">ii", ATTRIBUTES, 1) + name("_FillValue") + struct.pack(">ii", code[kind], 1) + padded(np.array([nodata], ">" + kind).tobytes())
            out += struct.pack(">iiq", code[kind], min(len(raw), (1 << 31) - 4), begin)
            begin += len(raw)
        return out

    return head(len(head(0))) + b"".join(body)


class RasterReader(DataSourceReader):
    def __init__(self, path: str, form: str, schema: StructType, options: dict):
        self.path, self.form, self.names, self.options = path, form, schema.names, options
        self.bounds = {c: tuple(map(int, options[c].split(":"))) for c in ("x", "y", "z") if options.get(c)}

    def within(self, column: str, lo: int, hi: int) -> tuple[int, int]:
        """The part of lo .. hi (end left out) that lies in the hyperslab."""
        a, b = self.bounds.get(column, (lo, hi - 1))
        return max(a, lo), min(b, hi - 1) + 1

    def partitions(self) -> list[Strip]:
        out = []
        for s in strips(self.path, self.form, self.options):
            lo, hi = self.within("y", s.first, s.first + s.rows)
            z = (0, 1) if s.z is None else self.within("z", s.z, s.z + 1)
            x = self.within("x", 0, s.width)
            if lo < hi and z[0] < z[1] and x[0] < x[1]:
                out.append(Strip(s.file, s.width, lo, hi - lo, s.skip + lo - s.first, s.z, tuple(b for b in s.bands if b.name in self.names)))
        return out

    def read(self, partition: Strip | None) -> Iterator[pa.RecordBatch]:
        # Without a strip there is one partition of nothing.
        if partition is None:
            return
        s = partition
        lo, hi = self.within("x", 0, s.width)
        step = max(1, BATCH_CELLS // s.width)
        for k in range(0, s.rows, step):
            n = min(step, s.rows - k)
            ys, xs = np.repeat(np.arange(s.first + k, s.first + k + n, dtype=np.int32), hi - lo), np.tile(np.arange(lo, hi, dtype=np.int32), n)
            columns = {"x": pa.array(xs), "y": pa.array(ys)}
            if s.z is not None:
                columns["z"] = pa.array(np.full(len(xs), s.z, np.int32))
            for b in s.bands:
                size = np.dtype(b.kind).itemsize
                # From the first row's first sample to the last row's last one.
                raw = _bytes(s.file, b.begin + (s.skip + k) * b.stride, (n - 1) * b.stride + ((s.width - 1) * b.step + 1) * size)
                rows = np.ndarray((n, s.width), b.kind, raw, 0, (b.stride, b.step * size))[:, lo:hi]
                v = np.ascontiguousarray(rows.astype(rows.dtype.newbyteorder("="))).ravel()
                gone = np.isnan(v) if v.dtype.kind == "f" else np.zeros(len(v), bool)
                if b.nodata is not None:
                    gone |= v == np.array(b.nodata).astype(v.dtype)
                kind = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[SPARK_TYPES[b.kind[1:]]]
                columns[b.name] = pa.array(v, mask=gone).cast(kind)
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], self.names)


def strips(path: str, form: str, options: dict) -> list[Strip]:
    """A raster's strips: those that a folder's list names, or parts of one file's rows."""
    if _exists(f"{path}/{LIST}"):
        listed = json.loads(_bytes(f"{path}/{LIST}"))
        out = []
        for name, first, rows in listed["strips"]:
            if form == "flat":
                # Known from the list alone: strips are opened by tasks only, and by those that need them.
                _, _, bands = flat_layout(listed["header"].replace("lines = 0\n", f"lines = {rows}\n"))
            else:
                size = {b: np.dtype(k).itemsize for b, k in listed["bands"]}
                begin, bands = listed["begin"], []
                at = begin + 4 * rows + 4 * listed["width"]
                for b, k in listed["bands"]:
                    bands.append(Band(b, ">" + k, at, listed["width"] * size[b], 1, listed["nodata"]))
                    at += -(-rows * listed["width"] * size[b] // 4) * 4
            out.append(Strip(f"{path}/{name}", listed["width"], first, rows, 0, None, tuple(bands)))
        return out
    if form == "flat":
        header = f"{path}.hdr" if _exists(f"{path}.hdr") else path.rsplit(".", 1)[0] + ".hdr"
        (width, height, bands), slices, jump = flat_layout(_bytes(header).decode()), None, 0
    else:
        width, height, slices, jump, bands = netcdf_layout(path, options["variables"].split(",") if options.get("variables") else None)
    rows = int(options.get("striprows") or max(1, STRIP_BYTES // max(1, max(b.stride for b in bands))))
    out = []
    for z in range(slices or 1):
        own = tuple(Band(b.name, b.kind, b.begin + z * jump, b.stride, b.step, b.nodata) for b in bands)
        out += [Strip(path, width, y, min(rows, height - y), y, None if slices is None else z, own) for y in range(0, height, rows)]
    return out


@dataclass
class Written(WriterCommitMessage):
    strips: list[tuple[str, int, int]]


class RasterWriter(DataSourceArrowWriter):
    """Writes the strips that a task's rows fill; rows of a strip come to one task, strip after strip."""

    def __init__(self, path: str, form: str, schema: StructType, options: dict, overwrite: bool):
        self.path, self.form, self.overwrite = path, form, overwrite
        self.width, self.height, self.rows = (int(options[k]) for k in ("width", "height", "striprows"))
        self.nodata = float(options["nodata"]) if options.get("nodata") else None
        self.kinds = {f.name: SAMPLES[f.dataType.simpleString()] for f in schema.fields if f.name not in ("x", "y")}
        if _exists(f"{path}/{LIST}") and not overwrite:
            raise ValueError(f"there is a raster already: {path}")

    def fresh(self, k: int) -> dict[str, np.ndarray]:
        rows = min(self.rows, self.height - k * self.rows)
        empty = self.nodata if self.nodata is not None else np.nan
        if self.nodata is None and any(kind[0] != "f" for kind in self.kinds.values()):
            empty = 0
        return {b: np.full((rows, self.width), empty, kind) for b, kind in self.kinds.items()}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        done, own, held = [], None, {}

        def flush() -> None:
            first, name = own * self.rows, f"strip-{own:08d}-{uuid.uuid4().hex}"
            if self.form == "flat":
                data, header = flat_file(held, first, self.nodata)
                _write(f"{self.path}/{name}.raw", data)
                _write(f"{self.path}/{name}.hdr", header.encode())
                done.append((f"{name}.raw", first, len(next(iter(held.values())))))
            else:
                _write(f"{self.path}/{name}.nc", netcdf_file(held, first, self.nodata))
                done.append((f"{name}.nc", first, len(next(iter(held.values())))))

        for batch in iterator:
            y, x = batch.column("y").to_numpy().astype(np.int64), batch.column("x").to_numpy().astype(np.int64)
            strip = y // self.rows
            cuts = [0, *(np.flatnonzero(strip[1:] != strip[:-1]) + 1).tolist(), len(y)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if strip[lo] != own:
                    if own is not None:
                        flush()
                    own = int(strip[lo])
                    held = self.fresh(own)
                for b, rows in held.items():
                    column = batch.column(b).slice(lo, hi - lo)
                    there = column.is_valid().to_numpy(zero_copy_only=False)
                    rows[y[lo:hi][there] - own * self.rows, x[lo:hi][there]] = column.drop_null().to_numpy(zero_copy_only=False)
        if own is not None:
            flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        old = json.loads(_bytes(f"{self.path}/{LIST}"))["strips"] if _exists(f"{self.path}/{LIST}") else []
        named = sorted((s for m in messages if m for s in m.strips), key=lambda s: s[1])
        about: dict = {"width": self.width, "height": self.height, "nodata": self.nodata, "bands": list(self.kinds.items()), "strips": named}
        one = {b: np.zeros((1, self.width), k) for b, k in self.kinds.items()}
        if self.form == "flat":
            about["header"] = flat_file(one, 0, self.nodata)[1].replace("lines = 1\n", "lines = 0\n")
        else:
            # The header's length doesn't hang on the number of rows.
            about["begin"] = len(netcdf_file(one, 0, self.nodata)) - 4 - 4 * self.width - sum(-(-self.width * np.dtype(k).itemsize // 4) * 4 for k in self.kinds.values())
        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        _write(f"{self.path}/{LIST}", json.dumps(about).encode())
        for name, _, _ in old:
            fs.delete_file(f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _store(self.path)
        for m in messages:
            for name, _, _ in m.strips if m else []:
                fs.delete_file(f"{at}/{name}")


class _Raster(DataSource):
    form = ""

    def schema(self) -> str:
        path = self.options["path"]
        found = strips(path, self.form, dict(self.options))
        if not found:
            listed = json.loads(_bytes(f"{path}/{LIST}"))
            bands, z = [Band(b, ">" + k, 0, 0) for b, k in listed["bands"]], False
        else:
            bands, z = found[0].bands, found[0].z is not None
        return ", ".join(["x int", "y int", *(["z int"] if z else []), *(f"`{b.name}` {SPARK_TYPES[b.kind[1:]]}" for b in bands)])

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options["path"], self.form, schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"], self.form, schema, dict(self.options), overwrite)


class FlatRaster(_Raster):
    form = "flat"

    @classmethod
    def name(cls) -> str:
        return "flatraster"


class ClassicNetcdf(_Raster):
    form = "netcdf"

    @classmethod
    def name(cls) -> str:
        return "classicnetcdf"


KINDS = {"flat": FlatRaster, "netcdf": ClassicNetcdf}


def _registered(spark: SparkSession, form: str) -> str:
    spark.dataSource.register(KINDS[form])
    return KINDS[form].name()


def read_raster(spark: SparkSession, path: str, form: str = "flat", strip_rows: int | None = None, variables: list[str] | None = None, within: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Cells of a raster: x, y (z of a cube) and a column for each band. form: flat or netcdf. path: a file, or a folder that write_raster wrote.

    within: for x, y or z, the first and the last index of a hyperslab; only its strips are opened. Samples equal to the header's ignored value, and NaN, are null. A file is read in strips of strip_rows rows, or of STRIP_BYTES.
    """
    given = {"striprows": strip_rows, "variables": ",".join(variables) if variables else None, **{c: f"{lo}:{hi}" for c, (lo, hi) in (within or {}).items()}}
    return spark.read.format(_registered(spark, form)).options(**{k: str(v) for k, v in given.items() if v}).load(path)


def write_raster(cells: DataFrame, spec: GridSpec, path: str, form: str = "flat", strip_rows: int | None = None, nodata: float | None = None, overwrite: bool = True) -> None:
    """Writes the grid's cells as a folder of strips of strip_rows rows. Missing and null cells get nodata, or NaN without one, or 0 where a band is whole numbers.

    Bands are short, int, float or double; a flat raster's are all of one type. Cells outside the grid are left out; of several rows of one cell any counts.
    """
    bands = [f for f in cells.schema.fields if f.name not in ("x", "y")]
    if odd := [f.name for f in bands if f.dataType.simpleString() not in SAMPLES]:
        raise ValueError(f"no samples of these types: {odd}")
    rows = strip_rows or max(1, STRIP_BYTES // (spec.width * 8))
    inside = cells.where(F.col("x").between(0, spec.width - 1) & F.col("y").between(0, spec.height - 1)).select("x", "y", *(f"`{f.name}`" for f in bands))
    dealt = inside.withColumn("__strip", F.floor(F.col("y") / rows)).repartition("__strip").sortWithinPartitions("__strip").drop("__strip")
    options = {"width": spec.width, "height": spec.height, "striprows": rows, **({} if nodata is None else {"nodata": nodata})}
    dealt.write.format(_registered(cells.sparkSession, form)).options(**{k: str(v) for k, v in options.items()}).mode("overwrite" if overwrite else "append").save(path)
