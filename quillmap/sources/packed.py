"""Packed artifacts of viewers as Spark tables: sources that read byte ranges, and writers whose tasks make the bytes.

    spark.dataSource.register(PackedPositions)
    spark.read.format("packed_positions").schema("row_idx long, x float").load(path)

Layouts, all little-endian:

* positions: u32 N, f32 x[N], f32 y[N], u8 tier[N], geo[N], lon[N], scale[N];
* meta: u32 N and two blob lengths, u32 offsets[N + 1] twice, i16 birth[N], death[N], two UTF-8 blobs;
* heightmap: u32 res, f32 world size, f32 heights by rows.

Any of them may be gzipped. A partition is a range of rows, of which it reads the bytes of
the columns in the schema and no others; of a gzipped file, whose ranges cannot be
reached, there is one partition, which unpacks it once for each column, a piece at a time.
"""

from __future__ import annotations

import gzip
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.stats import numbered
from .storage import dropped, shared_folder, stored

#: Rows of a batch, and of a partition unless the option `rows` says otherwise.
BATCH, ROWS = 65_536, 1 << 20
COPY = 8 << 20
#: Fixed values of the formats: the codes' names, and the year that stands for none.
TIERS, SOURCES, NO_YEAR = ("ordinary", "minor", "major"), ("birth", "death", "citizenship", "gazetteer"), -32768
POSITIONS = (("x", "<f4"), ("y", "<f4"), ("tier", "u1"), ("geo", "u1"), ("lon", "u1"), ("scale", "u1"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a plain path is local."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _zipped(path: str) -> bool:
    store, name = _store(path)
    with store.open_input_stream(name, compression=None) as file:
        return file.read(2) == b"\x1f\x8b"


class _Section:
    """Reads on from an offset of a file, in the unpacked bytes of a gzipped one."""

    def __init__(self, path: str, zipped: bool, at: int, open_files: ExitStack):
        store, name = _store(path)
        if zipped:
            self.file = open_files.enter_context(gzip.GzipFile(fileobj=open_files.enter_context(store.open_input_stream(name, compression=None))))
            while at > 0:
                at -= len(self.file.read(min(at, COPY))) or at
        else:
            self.file = open_files.enter_context(store.open_input_file(name))
            self.file.seek(at)

    def read(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) < n:
            raise ValueError(f"the file ends {n - len(out)} bytes too early")
        return out

    def array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.read(n * np.dtype(kind).itemsize), kind)


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    """Partitions are ranges of rows; subclasses say how many there are and give the columns of a range."""

    HEAD = 4

    def __init__(self, options: dict, schema: StructType):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.schema, self.each = options["path"], schema, int(options.get("rows", ROWS))
        self.zipped = _zipped(self.path)
        with ExitStack() as files:
            self.header(_Section(self.path, self.zipped, 0, files))

    def header(self, head: _Section) -> None:
        (self.n,) = struct.unpack("<I", head.read(4))

    def partitions(self) -> list[Rows]:
        step = max(1, self.n if self.zipped else self.each)
        return [Rows(a, min(a + step, self.n)) for a in range(0, self.n, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        wanted = [f.name for f in self.schema.fields]
        kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in self.schema.fields])
        with ExitStack() as files:
            section = lambda at: _Section(self.path, self.zipped, at, files)
            columns = {c: self.column(c, partition.start, section) for c in wanted if c != "row_idx"}
            for a in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - a)
                held = {c: pa.array(np.arange(a, a + n)) if c == "row_idx" else columns[c](n) for c in wanted}
                yield pa.RecordBatch.from_arrays([held[c].cast(kinds.field(c).type) for c in wanted], schema=kinds)

    def column(self, name: str, start: int, section):
        """A function that gives the next n values of a column, from row `start` on."""
        raise NotImplementedError


class _Positions(_Reader):
    def column(self, name: str, start: int, section):
        at = 4
        for c, kind in POSITIONS:
            if c == name:
                here = section(at + start * np.dtype(kind).itemsize)
                return lambda n: pa.array(here.array(kind, n))
            at += self.n * np.dtype(kind).itemsize
        raise ValueError(f"no column {name}; there are row_idx, {', '.join(c for c, _ in POSITIONS)}")


class PackedPositions(DataSource):
    """row_idx, x, y and codes of a positions file."""

    @classmethod
    def name(cls) -> str:
        return "packed_positions"

    def schema(self) -> str:
        return "row_idx long, x float, y float, tier short, geo short, lon short, scale short"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Positions(dict(self.options), schema)


class _Meta(_Reader):
    def header(self, head: _Section) -> None:
        self.n, *self.blobs = struct.unpack("<III", head.read(12))

    def column(self, name: str, start: int, section):
        years = 12 + 8 * (self.n + 1)
        if name in ("birth_year", "death_year"):
            here = section(years + 2 * self.n * (name == "death_year") + 2 * start)

            def year(n: int) -> pa.Array:
                values = here.array("<i2", n)
                return pa.array(values, mask=values == NO_YEAR)

            return year
        if name not in ("title", "description"):
            raise ValueError(f"no column {name}; there are row_idx, title, description, birth_year, death_year")
        k = ("title", "description").index(name)
        ends = section(12 + 4 * (self.n + 1) * k + 4 * start)
        last = int(ends.array("<u4", 1)[0])
        blob = section(years + 4 * self.n + self.blobs[0] * k + last)

        def text(n: int) -> pa.Array:
            nonlocal last
            stops = ends.array("<u4", n).astype(np.int64)
            data = blob.read(int(stops[-1]) - last) if n else b""
            offsets = np.concatenate(([0], stops - last)).astype("<i4")
            last = int(stops[-1]) if n else last
            return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

        return text


class PackedMeta(DataSource):
    """row_idx, title, description and years of a meta file; unknown years are null, missing texts empty."""

    @classmethod
    def name(cls) -> str:
        return "packed_meta"

    def schema(self) -> str:
        return "row_idx long, title string, description string, birth_year int, death_year int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Meta(dict(self.options), schema)


class _Raster(_Reader):
    def header(self, head: _Section) -> None:
        self.res, self.world = struct.unpack("<If", head.read(8))
        self.n = self.res * self.res

    def column(self, name: str, start: int, section):
        at = start
        here = section(8 + 4 * start) if name == "h" else None

        def cells(n: int) -> pa.Array:
            nonlocal at
            if here is not None:
                return pa.array(here.array("<f4", n))
            place = np.arange(at, at + n)
            at += n
            return pa.array(place // self.res if name == "i" else place % self.res)

        if name not in ("i", "j", "h"):
            raise ValueError(f"no column {name}; there are row_idx, i, j, h")
        return cells


class PackedHeightmap(DataSource):
    """i, j, h of every cell of a heightmap file."""

    @classmethod
    def name(cls) -> str:
        return "packed_heightmap"

    def schema(self) -> str:
        return "i int, j int, h float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Raster(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the three formats known to a session."""
    for source in (PackedPositions, PackedMeta, PackedHeightmap):
        spark.dataSource.register(source)


# Writers.


def crc32_of_both(first: int, second: int, length: int) -> int:
    """The crc32 of two strings one after another, from those of each and the length of the second.

    A crc is linear over bits, so a zero byte behind the first string acts as a matrix;
    squaring it gives those of 2, 4, 8 ... zero bytes.
    """
    act = lambda rows, x: _xor(r for i, r in enumerate(rows) if x >> i & 1)
    rows = [zlib.crc32(b"\0", bit ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for bit in (1 << i for i in range(32))]
    while length:
        if length & 1:
            first = act(rows, first)
        rows, length = [act(rows, r) for r in rows], length >> 1
    return first ^ second


def _xor(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def _parts(rows: DataFrame, columns: list[tuple[str, object]], each: int, zip_level: int | None, name: str) -> tuple[DataFrame, str]:
    """(section, chunk, bytes, crc) of the files that tasks write, and their folder: rows(place, ...) in chunks of `each` rows, a file for every section of a chunk.

    Each of `columns` is a section's name and a function from a chunk's batch to its
    bytes. With a zip level a file is a piece of a raw deflate stream, complete in itself.
    A file comes into place whole, so a repeated task leaves the same one.
    """
    folder = shared_folder(rows.sparkSession, name)

    def put(section: str, chunk: int, data: bytes) -> None:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part = f"{root}/.{uuid.uuid4().hex}"
        if zip_level is not None:
            squeeze = zlib.compressobj(zip_level, zlib.DEFLATED, -15)
            packed = squeeze.compress(data) + squeeze.flush(zlib.Z_FULL_FLUSH)
        else:
            packed = data
        with store.open_output_stream(part, compression=None) as out:
            out.write(packed)
        store.move(part, f"{root}/{section}-{chunk:08d}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            chunk, out = table.column("chunk")[0].as_py(), []
            for section, make in columns:
                data = make(table)
                put(section, chunk, data)
                out.append((section, chunk, len(data), zlib.crc32(data)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["section", "chunk", "bytes", "crc"])

        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and held[0].column("chunk")[0].as_py() != chunks[a]:
                        yield close()
                    held.append(batch.slice(a, b - a))
        if held:
            yield close()

    chunked = rows.withColumn("chunk", F.floor(F.col("place") / each)).repartition("chunk").sortWithinPartitions("chunk", "place")
    return stored(chunked.mapInArrow(write, "section string, chunk long, bytes long, crc long"), name), folder


def _assembled(path: str, pieces: list[str | bytes], parts: DataFrame, folder: str, zip_level: int | None) -> None:
    """Put pieces, bytes or the files of a section, into one file, a copy's buffer at a time, and drop the files."""
    store, root = _store(folder)
    out_store, name = _store(path)
    files: dict[str, list] = {}
    for r in sorted(parts.collect(), key=lambda r: r["chunk"]):  # a row a chunk and section
        files.setdefault(r["section"], []).append(r)
    crc = size = 0
    with out_store.open_output_stream(name, compression=None) as out:
        if zip_level is not None:
            out.write(b"\x1f\x8b\x08\0\0\0\0\0\x02\xff")
        for piece in pieces:
            if isinstance(piece, bytes):
                crc, size = zlib.crc32(piece, crc), size + len(piece)
                if zip_level is not None:
                    squeeze = zlib.compressobj(zip_level, zlib.DEFLATED, -15)
                    piece = squeeze.compress(piece) + squeeze.flush(zlib.Z_FULL_FLUSH)
                out.write(piece)
                continue
            for r in files.get(piece, ()):
                with store.open_input_stream(f"{root}/{piece}-{r['chunk']:08d}", compression=None) as part:
                    while data := part.read(COPY):
                        out.write(data)
                crc, size = crc32_of_both(crc, r["crc"], r["bytes"]), size + r["bytes"]
        if zip_level is not None:
            out.write(b"\x03\0" + struct.pack("<II", crc, size & 0xFFFFFFFF))
    if files:
        store.delete_dir(root)
    dropped(parts)


def write_positions(layout: DataFrame, path: str, each: int = ROWS) -> int:
    """The positions file of a layout, in row_idx order, which must be unique: tasks make the bytes of `each` rows, one file is put together from theirs."""
    codes = [F.col("x").cast("float"), F.col("y").cast("float"), T.code_of(F.col("landmark_tier"), TIERS, 0).alias("tier"), T.code_of(F.col("geo_source"), SOURCES, 4).alias("geo"), T.angle_byte(F.col("base_angle")).alias("lon"), T.to_byte((F.col("book_scale") - 0.8) / 1.8).alias("scale")]
    held = stored(layout.select("row_idx", *codes), "numbered")  # the ranges' bounds are a pass of their own
    rows, (n,) = numbered(held, ["row_idx"], [])
    of = lambda c, kind: (c, lambda t: t.column(c).to_numpy().astype(kind).tobytes())
    parts, folder = _parts(rows, [of(c, kind) for c, kind in POSITIONS], each, None, "positions")
    _assembled(path, [struct.pack("<I", n), *(c for c, _ in POSITIONS)], parts, folder, None)
    dropped(held)
    return n


def write_meta(layout: DataFrame, path: str, each: int = ROWS, level: int = 9) -> int:
    """The gzipped meta file of a layout, in row_idx order, which must be unique; the same bytes for the same rows.

    Texts' offsets run over all rows, so they are summed up by ranges first; tasks make
    and pack the bytes of `each` rows, and one file is put together from theirs.
    """
    texts = ("title", "description")
    rows = stored(layout.select("row_idx", *(F.coalesce(c, F.lit("")).alias(c) for c in texts), "birth_year", "death_year"), "numbered")
    held, (n, *ends) = numbered(rows.withColumns({f"{c}_size": F.octet_length(c) for c in texts}), ["row_idx"], [f"{c}_size" for c in texts])
    if max(ends) >= 1 << 32:
        raise ValueError("texts of 4 GB do not fit the format")
    year = lambda c: (c, lambda t: t.column(c).fill_null(NO_YEAR).to_numpy().astype("<i2").tobytes())
    stops = lambda c: (f"{c}_ends", lambda t: (t.column(f"{c}_size_at").to_numpy() + np.array([len(x.encode()) for x in t.column(c).to_pylist()], np.int64)).astype("<u4").tobytes())
    blob = lambda c: (c, lambda t: "".join(t.column(c).to_pylist()).encode())
    sections = [stops("title"), stops("description"), year("birth_year"), year("death_year"), blob("title"), blob("description")]
    parts, folder = _parts(held, sections, each, level, "meta")
    zero = struct.pack("<I", 0)
    _assembled(path, [struct.pack("<III", n, *ends), zero, "title_ends", zero, "description_ends", "birth_year", "death_year", *texts], parts, folder, level)
    dropped(rows)
    return n
