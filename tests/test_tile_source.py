"""The tile data source: ranges, pruning, whole tiles only."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.session import ship_package, small_frame
from silvagrid.sources import raw, tile_source, tiles

WIDTH = 3


def frame(spark, sizes, kind="float"):
    rows = [(name, i, [i * 10 + k + len(name) for k in range(WIDTH)]) for name, size in sizes.items() for i in range(size)]
    typed = [(n, i, [float(x) if kind == "float" else x for x in v]) for n, i, v in rows]
    return small_frame(ship_package(spark), typed, f"tile string, idx bigint, values array<{kind}>")


def rows(df):
    return sorted((r["tile"], r["idx"], tuple(r["values"])) for r in df.collect())


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles"))
    tile_source.write_tiles(frame(spark, {"a": 500, "bb": 40, "c": 7}).repartition(5), path, WIDTH)
    return path


def test_round_trip(spark, root):
    assert rows(tile_source.read_tiles(spark, root, WIDTH)) == rows(frame(spark, {"a": 500, "bb": 40, "c": 7}))
    assert sorted(os.listdir(root)) == ["a", "bb", "c"]
    small = tile_source.read_tiles(spark, root, WIDTH, range_bytes=100)
    assert rows(small) == rows(tile_source.read_tiles(spark, root, WIDTH)) and small.rdd.getNumPartitions() > 60
    named = tile_source.read_tiles(spark, root, WIDTH, ["c", "bb"])
    assert {r[0] for r in rows(named)} == {"bb", "c"}


def test_reads_like_the_other_reader(spark, root):
    """Parts and byte order are those of the plain reader."""
    found = tiles.read_features(spark, root, ["a", "bb"], WIDTH)
    assert rows(found) == rows(tile_source.read_tiles(spark, root, WIDTH, ["a", "bb"]))
    big = np.fromfile(f"{root}/c/features.raw", ">f4").reshape(-1, WIDTH)
    assert big[2].tolist() == [21.0, 22.0, 23.0]


def test_integers(spark, tmp_path):
    given = frame(spark, {"s": 9}, "int")
    tile_source.write_tiles(given, str(tmp_path), WIDTH, "seg.raw", "int")
    back = tile_source.read_tiles(spark, str(tmp_path), WIDTH, file="seg.raw", kind="int")
    assert rows(back) == rows(given) and back.schema["values"].dataType.simpleString() == "array<int>"
    plain = raw.read_records(spark, f"{tmp_path}/s/seg*.raw", WIDTH, "int")
    assert sorted(tuple(r["values"]) for r in plain.collect()) == sorted(v for _, _, v in rows(given))


def test_fields(spark, root):
    back = tile_source.read_tiles(spark, root, WIDTH, ["a"], [2, 0])
    assert back.columns == ["tile", "idx", "b2", "b0"]
    assert back.where("idx = 4").select("b2", "b0").first() == (43.0, 41.0)
    with pytest.raises(Exception, match="no such record fields"):
        tile_source.read_tiles(spark, root, WIDTH, ["a"], [7]).count()


def planned(filters, root, **options):
    from pyspark.sql.types import StructType

    reader = tile_source.TileReader(StructType.fromDDL("tile string, idx bigint"), {"path": root, "width": str(WIDTH), **options})
    left = list(reader.pushFilters(filters))
    return left, [(p.tile, p.first, p.count) for p in reader.partitions() if p.count]


def test_only_wanted_ranges(spark, root):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

    left, ranges = planned([IsNotNull(("idx",)), EqualTo(("tile",), "a"), GreaterThanOrEqual(("idx",), 490), LessThan(("idx",), 495)], root)
    assert left == [IsNotNull(("idx",))] and sum(n for _, _, n in ranges) == 5 and ranges[0][:2] == ("a", 490)
    assert planned([In(("tile",), ("c", "nowhere"))], root)[1] == [("c", 0, 7)]
    assert planned([EqualTo(("tile",), "a"), EqualTo(("tile",), "c")], root)[1] == []
    asked = tile_source.read_tiles(spark, root, WIDTH).where("tile = 'a' AND idx >= 490 AND idx < 495 AND values[0] > 4920")
    assert [r[1] for r in rows(asked)] == [492, 493, 494]
    assert tile_source.read_tiles(spark, root, WIDTH).where(F.col("tile").isin("c", "bb") & (F.col("idx") == 6)).count() == 2
    assert tile_source.read_tiles(spark, root, WIDTH).where("tile = 'none'").count() == 0


def test_parts(spark, tmp_path, monkeypatch):
    """A tile over several files, overwritten by a shorter one."""
    writer = tile_source.TileWriter(frame(spark, {"t": 1}).schema, {"path": str(tmp_path), "width": str(WIDTH)}, True)
    monkeypatch.setattr(tile_source, "FILE_RECORDS", 4)
    arrow = frame(spark, {"t": 10}).toArrow()
    staged = writer.write(iter(arrow.to_batches()))
    assert [f[1:3] for f in staged.files] == [(0, 4), (4, 4), (8, 2)]
    writer.commit([staged, None])
    assert sorted(os.listdir(tmp_path)) == ["t"] and len(os.listdir(tmp_path / "t")) == 3
    assert rows(tile_source.read_tiles(spark, str(tmp_path), WIDTH)) == rows(frame(spark, {"t": 10}))
    tile_source.write_tiles(frame(spark, {"t": 2}), str(tmp_path), WIDTH, mode="overwrite")
    assert rows(tile_source.read_tiles(spark, str(tmp_path), WIDTH)) == rows(frame(spark, {"t": 2}))


def test_nested_and_shared_folders(spark, tmp_path):
    """A tile two folders deep, and one whose folder holds other files."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "targets.txt").write_text("1 0")
    given = frame(spark, {"t": 4, "deep/er": 6})
    tile_source.write_tiles(given, str(tmp_path), WIDTH)
    assert rows(tile_source.read_tiles(spark, str(tmp_path), WIDTH, ["t", "deep/er"])) == rows(given)
    assert sorted(os.listdir(tmp_path / "t"))[-1] == "targets.txt" and sorted(os.listdir(tmp_path)) == ["deep", "t"]


def test_killed_task_leaves_no_tile(spark, tmp_path):
    """A worker that dies after other tasks have written: no tile, no staged file, and older tiles are untouched."""
    tile_source.write_tiles(frame(spark, {"old": 5}), str(tmp_path), WIDTH)

    def die(batches):
        for batch in batches:
            if 299 in batch.column(1).to_pylist():
                os._exit(1)
            yield batch

    given = frame(spark, {"old": 9, "x": 50, "y": 300})
    dying = given.repartitionByRange(4, "tile", "idx").sortWithinPartitions("tile", "idx").mapInArrow(die, given.schema)
    with pytest.raises(Exception):  # noqa: B017
        dying.write.format("tiles").mode("overwrite").options(path=str(tmp_path), width=WIDTH).save()
    assert sorted(os.listdir(tmp_path)) == ["old"]
    assert rows(tile_source.read_tiles(spark, str(tmp_path), WIDTH)) == rows(frame(spark, {"old": 5}))


@pytest.mark.parametrize(("given", "error"), [
    ([("t", 0), ("t", 2)], "missing or repeated at 1"), ([("t", 1)], "missing or repeated at 0"), ([("t", 0), ("t", 0)], "missing or repeated at 0")])
def test_broken_tiles(spark, tmp_path, given, error):
    odd = small_frame(spark, [(n, i, [1.0] * WIDTH) for n, i in given], "tile string, idx bigint, values array<float>")
    with pytest.raises(Exception, match=error):
        tile_source.write_tiles(odd, str(tmp_path), WIDTH)
    assert os.listdir(tmp_path) == []


def test_refusals(spark, root, tmp_path):
    with pytest.raises(Exception, match="already"):
        tile_source.write_tiles(frame(spark, {"a": 2}), root, WIDTH)
    with pytest.raises(Exception, match="must have 3 values"):
        tile_source.write_tiles(small_frame(spark, [("t", 0, [1.0])], "tile string, idx bigint, values array<float>"), str(tmp_path), WIDTH)
    with pytest.raises(Exception, match="multiple of the record"):
        tile_source.read_tiles(spark, root, 5, ["c"]).count()
    with pytest.raises(Exception, match="has no other.raw"):
        tile_source.read_tiles(spark, root, WIDTH, ["a"], file="other.raw").count()
    with pytest.raises(Exception, match="unknown kind"):
        tile_source.read_tiles(spark, root, WIDTH, kind="text").count()
