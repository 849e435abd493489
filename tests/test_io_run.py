import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.config import TreeConfig
from silvagrid.plans import forest, run
from silvagrid.session import small_frame
from silvagrid.sources import raw, sinks, tiles
from silvagrid.streaming.score import score_stream

H, W, MARGIN, BASE = 26, 24, 4, 2


def write_tiles(spark, root, names):
    rng = np.random.default_rng(4)
    features, targets, dims = [], [], {}
    truth = {}
    for name in names:
        image = rng.random((H, W)).astype(np.float32)
        inside = image > 0.4
        for i in range(H * W):
            features.append((name, i, [float(image.flat[i]), float(inside.flat[i])]))
        k = 0
        for r in range(MARGIN, H - MARGIN):
            for c in range(MARGIN, W - MARGIN):
                y = [float(inside[r, c] and inside[r + 1, c]), float(inside[r, c] and inside[r, c + 1])]
                targets.append((name, k, y))
                truth[(name, k)] = (y, r, c, image)
                k += 1
        dims[name] = (H, W, MARGIN, MARGIN, H - MARGIN - 1, W - MARGIN - 1)
    sinks.export_training_tile(
        small_frame(spark, features, "tile string, idx bigint, values array<float>"),
        small_frame(spark, targets, "tile string, idx bigint, y array<double>"), dims, root)
    return truth


def test_formats_and_whole_run(spark, tmp_path):
    root = str(tmp_path / "data")
    truth = write_tiles(spark, root, ["a", "b"])
    assert os.path.getsize(f"{root}/a/features.raw") == H * W * BASE * 4
    with open(f"{root}/a/dimensions.txt") as handle:
        assert handle.read().split("\n")[0] == f"{H} {W}"
    small = raw.read_records(spark, f"{root}/a/features.raw", BASE, range_bytes=400)
    assert [r["idx"] for r in small.orderBy("idx").select("idx").collect()] == list(range(H * W))
    with pytest.raises(Exception, match="multiple of the record"):
        raw.read_records(spark, f"{root}/a/features.raw", 7).count()

    offsets = [(0, (0, 0)), (1, (0, 0)), (1, (1, 0)), (1, (0, 1))]
    points, _ = tiles.load_tiles(spark, root, ["a#0", "a#1"], BASE, offsets)
    rows = points.collect()
    assert len(rows) == 2 * (H - 2 * MARGIN) * (W - 2 * MARGIN)
    for x in rows:
        y, r, c, image = truth[("a", x["inner_idx"])]
        assert [x["y1"], x["y2"]] == y and x["outer_idx"] == r * W + c and (x["r"], x["c"]) == (r - MARGIN, c - MARGIN)
        assert x["feats"][0] == image[r, c] and x["feats"][2] == float(image[r + 1, c] > np.float32(0.4))
    half, _ = tiles.load_tiles(spark, root, ["a"], BASE, offsets, 0.5, from_front=False)
    assert half.agg(F.min("outer_idx")).first()[0] == (H - MARGIN - 1 - 8) * W + MARGIN
    with pytest.raises(ValueError, match="margin"):
        tiles.load_tiles(spark, root, ["a"], BASE, [(0, (5, 0))])

    args = [f"data_root={root}", f"save_to={tmp_path}/out", f"save_model_to={tmp_path}/models", "subvolumes_train=a", "subvolumes_test=b",
            f"nBaseFeatures={BASE}", "features=0(0,0);1({0|1},{0|1})", "maxDepth=3", "initialTrees=2", "testPartialModels=1,2", "bagging=1"]
    result = run.main(args, spark)
    assert result["cuts"] == [1, 2] and result["model"].num_trees == 2
    folder = f"{result['out']}/predictions/partial2/test/b"
    assert sorted(os.listdir(folder)) == ["description.txt", "dimensions.txt", "labels.png", "labels.raw", "predictions.png", "predictions.raw"]
    back = tiles.read_affinities(spark, f"{result['out']}/predictions/partial2/test", ["b"], "labels.raw")
    wanted = {(r - MARGIN, c - MARGIN): tuple(y) for (name, _), (y, r, c, _) in truth.items() if name == "b"}
    assert {(x["r"], x["c"]): (x["a1"], x["a2"]) for x in back.collect()} == wanted
    shot = tiles.read_gray(spark, f"{folder}/labels.png").collect()
    assert {(x["r"], x["c"]): int(round(x["v"] * 255)) for x in shot} == {k: int(sum(v) / 2 * 255) for k, v in wanted.items()}

    todo = tiles.experiments(spark, result["out"], split="train")
    assert {(x["partial"], x["tile"]) for x in todo.collect()} == {(1, "a"), (2, "a")}
    run.evaluate_run(spark, result["out"], 2)
    assert {x["partial"] for x in tiles.experiments(spark, result["out"], split="train").collect()} == {1}
    assert glob.glob(f"{result['out']}/predictions/partial2/test/errors_new_threshold.txt")
    with open(f"{result['out']}/predictions/partial2/train/errors_new_curves.csv") as handle:
        lines = [line.split(",") for line in handle.read().split("\n")[1:-1]]
    assert {x[0] for x in lines} == {"rand", "pixel"} and any(x[7] == "1" for x in lines) and all(len(x) == 9 for x in lines)
    with open(f"{folder}/description.txt") as handle:
        assert "level 0: " in handle.read()

    saved = glob.glob(f"{tmp_path}/models/*")[0]
    loaded = sinks.load_model(spark, saved)
    assert loaded.nodes == result["model"].nodes
    both = sinks.combine_models(spark, [saved, saved], f"{tmp_path}/merged")
    assert both.num_trees == 4 and sinks.load_model(spark, f"{tmp_path}/merged").weights == [1.0] * 4

    boosted = run.main([*args, f"loadModel={saved}", "iterations=1", "treesPerIteration=1", "testPartialModels=none"], spark)
    assert os.path.exists(f"{boosted['out']}/malis/malis.txt") and boosted["model"].strategy == "sum"
    with pytest.raises(ValueError, match="unknown loss"):
        run.main([*args, "iterations=1", "loss=cubic", "testPartialModels=none"], spark)


def test_parts_and_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_ROWS", 10)
    seg = small_frame(spark, [("t", i, i // 4) for i in range(25)], "tile string, inner_idx bigint, seg int")
    assert sinks.export_segments(seg, str(tmp_path)) == 3
    files = sorted(glob.glob(f"{tmp_path}/t/seg*"), key=lambda p: (len(p), p))
    content = b"".join(open(f, "rb").read() for f in files)
    assert np.frombuffer(content, ">i4").tolist() == [i // 4 for i in range(25)]


def test_stream(spark, tmp_path):
    rows = [(float(i), float(i % 3), float(i > 5), float(i % 3)) for i in range(12)]
    df = small_frame(spark, rows, "a double, b double, y1 double, y2 double")
    model = forest.fit_forest(df, ["a", "b"], "y1", "y2", TreeConfig(max_depth=2))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in forest.predict(df, model, ["a", "b"]).collect())


@pytest.mark.parametrize("part_rows", [7, 96, 1 << 20])
def test_tiles_of_several_parts_and_nested_ids(spark, tmp_path, monkeypatch, part_rows):
    monkeypatch.setattr(sinks, "PART_ROWS", part_rows)
    root = str(tmp_path / "data")
    truth = write_tiles(spark, root, ["im1/000", "im2/000"])
    names = ["im1/000", "im2/000"]
    features = tiles.read_features(spark, root, names, BASE).collect()
    assert sorted((x["tile"], x["idx"]) for x in features) == [(t, i) for t in names for i in range(H * W)]
    for x in features:
        assert x["values"][0] == truth[(x["tile"], 0)][3].flat[x["idx"]]
    targets = tiles.read_targets(spark, root, names).collect()
    assert {(x["tile"], x["idx"]): x["y"] for x in targets} == {k: v[0] for k, v in truth.items()}
    points, _ = tiles.load_tiles(spark, root, names, BASE, [(0, (0, 0))])
    assert points.count() == len(truth)

    shown = points.withColumns({"pred1": F.col("y1") / 2, "pred2": F.col("y2") / 4})
    out = str(tmp_path / "out")
    assert sinks.export_tiles(shown, out, "note") == 2
    inner = (H - 2 * MARGIN, W - 2 * MARGIN)
    with open(f"{out}/im2/000/dimensions.txt") as handle:
        assert handle.read() == f"{inner[0]} {inner[1]}"
    back = {(x["tile"], x["r"], x["c"]): x["a1"] for x in tiles.read_affinities(spark, out, names).collect()}
    assert back == {(x["tile"], x["r"], x["c"]): x["pred1"] for x in shown.collect()}
    pictures = glob.glob(f"{out}/im1/000/labels*.png")
    assert len(pictures) == -(-inner[0] // max(1, part_rows // inner[1]))
    gray = tiles.read_gray(spark, sorted(pictures)).groupBy("path").count().collect()
    assert sum(x["count"] for x in gray) == inner[0] * inner[1]
    segments = points.select("tile", "inner_idx", F.col("inner_idx").cast("int").alias("seg"))
    assert sinks.export_segments(segments, str(tmp_path / "seg")) >= 2

    os.truncate(f"{root}/im1/000/features.raw", 2 * BASE * 4)
    with pytest.raises(ValueError, match="do not fill"):
        tiles.load_tiles(spark, root, names, BASE, [(0, (0, 0))])


def test_colour_images_are_refused(spark, tmp_path):
    pa_png = sinks.png_gray(np.zeros((2, 2)))
    (tmp_path / "gray.png").write_bytes(pa_png)
    assert tiles.read_gray(spark, str(tmp_path / "gray.png")).count() == 4
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    colour = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1\2\3")) + chunk(b"IEND", b"")
    (tmp_path / "colour.png").write_bytes(colour)
    with pytest.raises(Exception, match="not a gray image"):
        tiles.read_gray(spark, str(tmp_path / "colour.png")).count()


def test_value_at(spark):
    from silvagrid.sources.raw import value_at

    row = spark.sql("SELECT array(5.0, 6.0, 7.0) AS v, 1 AS f").select(value_at(F.col("v"), 2), value_at(F.col("v"), F.col("f"))).first()
    assert [float(x) for x in row] == [7.0, 6.0]
