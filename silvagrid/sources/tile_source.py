"""Flat tile files as a Spark data source: ``spark.read.format("tiles")`` and ``df.write.format("tiles")``.

Reading plans record-aligned ranges. Filters on ``tile`` and ``idx`` decide which ranges exist at all, and the schema
names the record fields that are decoded. Writing stages files and moves them to their tile folders in the commit, so a
job whose tasks fail leaves no tile behind.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from silvagrid.sources.files import open_at
from silvagrid.sources.raw import BATCH, FLOAT32, INT32, RANGE_BYTES

#: Setting under which Spark hands filters to Python readers.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Records per written file; readers take the parts of a tile in order.
FILE_RECORDS = 1 << 20

_KINDS = {"float": (FLOAT32, np.float32, pa.float32()), "int": (INT32, np.int32, pa.int32())}


@dataclass(frozen=True)
class Layout:
    """What the options say about the files."""

    root: str
    name: str
    width: int
    kind: str

    @staticmethod
    def of(options: dict) -> Layout:
        missing = [key for key in ("path", "width") if key not in options]
        if missing:
            raise ValueError(f"the tiles source needs the options {missing}")
        kind = options.get("kind", "float")
        if kind not in _KINDS:
            raise ValueError(f"unknown kind {kind!r}; known: {sorted(_KINDS)}")
        width = int(options["width"])
        if width < 1:
            raise ValueError("width must be at least 1")
        return Layout(options["path"].rstrip("/"), options.get("file", "features.raw"), width, kind)

    @property
    def record(self) -> int:
        return 4 * self.width

    def part_name(self, part: int) -> str:
        stem, _, ending = self.name.rpartition(".")
        return self.name if part == 0 else f"{stem}-{part:06d}.{ending}"

    def parts(self, tile: str) -> list[tuple[int, str, int]]:
        """(part, path, bytes) of a tile's file and its numbered parts, in order."""
        system, inner = open_at(f"{self.root}/{tile}")
        stem, _, ending = self.name.rpartition(".")
        form = re.compile(re.escape(stem) + r"(?:-(\d{6,}))?\." + re.escape(ending))
        found = []
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            match = form.fullmatch(info.base_name)
            if match and info.type == fs.FileType.File:
                found.append((int(match[1] or 0), f"{self.root}/{tile}/{info.base_name}", info.size))
        return sorted(found)


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``first + count`` of a tile, from a byte of one of its files."""

    tile: str
    path: str
    first: int
    count: int
    start: int


class TileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.layout, self.names = Layout.of(options), schema.names
        self.tiles = [t for t in options.get("tiles", "").split(",") if t]
        self.step = max(1, int(options.get("range_bytes", RANGE_BYTES)) // self.layout.record)
        self.low, self.high = 0, 1 << 62
        self.wanted: set[str] | None = None
        fields = [n for n in self.names if n not in ("tile", "idx", "values")]
        wrong = [n for n in fields if not re.fullmatch(r"b\d+", n) or int(n[1:]) >= self.layout.width]
        if wrong:
            raise ValueError(f"no such record fields: {wrong}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (the name of the interface)
        """Keep filters on tile names and record numbers; the others go back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("tile",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = named if self.wanted is None else self.wanted & named
            elif isinstance(f, EqualTo) and f.attribute == ("idx",):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("idx",):
                self.low = max(self.low, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == ("idx",):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, LessThan) and f.attribute == ("idx",):
                self.high = min(self.high, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("idx",):
                self.high = min(self.high, f.value + 1)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges that hold wanted records. Folders of unwanted tiles are not even listed."""
        found: list[InputPartition] = []
        for tile in self.tiles or tile_names(self.layout.root):
            if self.wanted is not None and tile not in self.wanted:
                continue
            parts, before = self.layout.parts(tile), 0
            if not parts and self.tiles:
                raise ValueError(f"tile {tile} has no {self.layout.name}")
            for _, path, size in parts:
                if size % self.layout.record:
                    raise ValueError(f"length is not a multiple of the record: {path}")
                records = size // self.layout.record
                low, high = max(self.low - before, 0), min(self.high - before, records)
                found += [Range(tile, path, before + at, min(self.step, high - at), at * self.layout.record)
                          for at in range(low, high, self.step)]
                before += records
        return found or [Range("", "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        dtype, plain, kind = _KINDS[self.layout.kind]
        if not partition.count:
            return
        system, inner = open_at(partition.path)
        with system.open_input_file(inner) as handle:
            handle.seek(partition.start)
            for at in range(0, partition.count, BATCH):
                count = min(BATCH, partition.count - at)
                block = np.frombuffer(handle.read(count * self.layout.record), dtype).reshape(count, self.layout.width)
                columns = []
                for name in self.names:
                    if name == "tile":
                        columns.append(pa.array([partition.tile] * count, pa.string()))
                    elif name == "idx":
                        columns.append(pa.array(np.arange(partition.first + at, partition.first + at + count)))
                    elif name == "values":
                        ends = pa.array(np.arange(count + 1, dtype=np.int32) * self.layout.width)
                        columns.append(pa.ListArray.from_arrays(ends, pa.array(block.astype(plain).ravel(), kind)))
                    else:
                        columns.append(pa.array(block[:, int(name[1:])].astype(plain), kind))
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


def tile_names(root: str) -> list[str]:
    """Folders directly below the root; staging folders begin with an underscore."""
    system, inner = open_at(root)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith("_"))


@dataclass
class Staged(WriterCommitMessage):
    """Runs of consecutive records one task wrote: (tile, first record, records, staged file)."""

    files: list[tuple[str, int, int, str]]


class TileWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.layout, self.overwrite = Layout.of(options), overwrite
        if schema.names[:3] != ["tile", "idx", "values"]:
            raise ValueError("a tile table has the columns tile, idx and values")
        self.staging = f"{self.layout.root}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Stream sorted rows to staged files, a new one at every tile, gap and ``FILE_RECORDS`` records."""
        dtype, width = _KINDS[self.layout.kind][0], self.layout.width
        system, inner = open_at(self.staging)
        system.create_dir(inner, recursive=True)
        files: list[tuple[str, int, int, str]] = []
        handle, tile, first, count = None, None, 0, 0

        def close() -> None:
            if handle is not None:
                handle.close()
                files.append((tile, first, count, path))

        path = ""
        for batch in iterator:
            if not batch.num_rows:
                continue
            names, at = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists = batch.column(2)
            if lists.null_count or set(np.diff(lists.offsets.to_numpy())) != {width}:
                raise ValueError(f"every record must have {width} values")
            block = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype)
            changes = [i for i in range(1, len(names)) if names[i] != names[i - 1] or at[i] != at[i - 1] + 1]
            for low, high in zip([0, *changes], [*changes, len(names)]):
                while low < high:
                    joins = handle is not None and names[low] == tile and at[low] == first + count and count < FILE_RECORDS
                    if not joins:
                        close()
                        tile, first, count, path = names[low], int(at[low]), 0, f"{inner}/{uuid.uuid4().hex}"
                        handle = system.open_output_stream(path)
                    upto = min(high, low + FILE_RECORDS - count)
                    handle.write(block[low:upto].tobytes())
                    count += upto - low
                    low = upto
        close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        """Check that every tile is whole, put its parts in order, and move its folder into place."""
        try:
            by_tile: dict[str, list[tuple[int, int, str]]] = {}
            for message in messages:
                for tile, first, count, path in message.files if message else []:
                    by_tile.setdefault(tile, []).append((first, count, path))
            system, root = open_at(self.layout.root)
            for tile, runs in by_tile.items():
                at = 0
                for first, count, _ in sorted(runs):
                    if first != at:
                        raise ValueError(f"records of tile {tile} are missing or repeated at {min(first, at)}")
                    at += count
                if not self.overwrite and self.layout.parts(tile):
                    raise ValueError(f"tile {tile} has a {self.layout.name} already")
            staging = open_at(self.staging)[1]
            for number, (tile, runs) in enumerate(by_tile.items()):
                target = f"{root}/{tile}"
                # A new tile is put together aside and appears by one rename; a folder with other files gets its parts one by one.
                fresh = system.get_file_info(target).type == fs.FileType.NotFound
                home = f"{staging}/tile-{number}" if fresh else target
                old = set() if fresh else {path.rpartition("/")[2] for _, path, _ in self.layout.parts(tile)}
                system.create_dir(home, recursive=True)
                for part, (_, _, path) in enumerate(sorted(runs)):
                    system.move(path, f"{home}/{self.layout.part_name(part)}")
                    old.discard(self.layout.part_name(part))
                if fresh:
                    system.create_dir(target.rpartition("/")[0], recursive=True)
                    system.move(home, target)
                for name in old:
                    system.delete_file(f"{target}/{name}")
        finally:
            self.abort([])

    def abort(self, messages: list[Staged | None]) -> None:
        """Remove what was staged, of failed and repeated attempts too."""
        system, inner = open_at(self.staging)
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)


class TileSource(DataSource):
    """Options: ``path`` (root of the tile folders), ``width`` (numbers per record), ``file``, ``kind`` (float, int), and
    for reading ``tiles`` (comma list; all folders without it) and ``range_bytes``. Fields b0, b1, ... can be asked for
    by a schema instead of the whole array ``values``."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return f"tile string, idx bigint, values array<{Layout.of(self.options).kind}>"

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        return TileWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session and let filters reach it."""
    spark.dataSource.register(TileSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark


def write_tiles(rows: DataFrame, root: str, width: int, file: str = "features.raw", kind: str = "float", mode: str = "append") -> None:
    """Write (tile, idx, values): rows are dealt by ranges of tile and record, so a tile of any size has many writers."""
    register(rows.sparkSession)
    dealt = rows.select("tile", "idx", "values").repartitionByRange("tile", "idx").sortWithinPartitions("tile", "idx")
    dealt.write.format("tiles").mode(mode).options(path=root, width=width, file=file, kind=kind).save()


def read_tiles(spark: SparkSession, root: str, width: int, tiles: Sequence[str] = (), fields: Sequence[int] | None = None,
               file: str = "features.raw", kind: str = "float", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(tile, idx, values), or the named record fields as columns b0, b1, ..."""
    source = register(spark).read.format("tiles").options(
        path=root, width=width, tiles=",".join(tiles), file=file, kind=kind, range_bytes=range_bytes)
    if fields is not None:
        source = source.schema("tile string, idx bigint" + "".join(f", b{i} {kind}" for i in fields))
    return source.load()
