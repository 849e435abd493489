"""Writers: prediction tables, flat files and images per tile, reports, models."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.plans.boost import BoostedModel
from silvagrid.plans.forest import ForestModel, merge_models
from silvagrid.session import lookup_join
from silvagrid.sources.files import open_at, read_text, write_file
from silvagrid.sources.raw import FLOAT32, INT32

#: Rows of a tile that one task turns into one file. A tile with more rows is written as
#: numbered parts, which the readers of ``tiles`` take in order.
PART_ROWS = 1 << 20


def write_predictions(df: DataFrame, path: str) -> None:
    """The engine's own format: parquet partitioned by cut point, split and tile."""
    df.write.mode("overwrite").partitionBy("partial", "split", "tile").parquet(path)


def png_gray(image: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    height, width = image.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def gray_levels(values: np.ndarray) -> np.ndarray:
    return np.clip(np.trunc(values * 255), 0, 255).astype(np.uint8)


def export_parts(df: DataFrame, folder_cols: Sequence[str], order: str, root: str,
                 files: dict[str, Callable[[pd.DataFrame], bytes]]) -> DataFrame:
    """Write files per folder in the order of ``order`` (0-based positions) and list them.

    A group is one part of about ``PART_ROWS`` rows; a frame with pixel coordinates ``r`` and ``c`` is cut at whole
    image rows. ``files`` maps a name to an encoder of the part's sorted rows.
    """
    folder_cols = list(folder_cols)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["_part"].iloc[0])
        rows = frame.sort_values(order)
        folder = "/".join([root, *[str(frame[c].iloc[0]) for c in folder_cols]])
        written = []
        for name, encode in files.items():
            stem, _, ending = name.partition(".")
            target = f"{folder}/{name}" if part == 0 else f"{folder}/{stem}-{part:06d}.{ending}"
            write_file(target, encode(rows))
            written.append((folder, target, len(rows)))
        return pd.DataFrame(written, columns=["folder", "file", "rows"])

    if {"r", "c"} <= set(df.columns):
        extent = df.groupBy(*folder_cols).agg(F.greatest(F.floor(F.lit(PART_ROWS) / (F.max("c") + 1)), F.lit(1)).alias("_rows"))
        sized = lookup_join(df, extent, folder_cols, extent.count(), [order])
        parts = sized.withColumn("_part", F.floor(F.col("r") / F.col("_rows"))).drop("_rows")
    else:
        parts = df.withColumn("_part", F.floor(F.col(order) / PART_ROWS))
    return parts.groupBy(*folder_cols, "_part").applyInPandas(run, "folder string, file string, rows bigint")


def export_notes(df: DataFrame, folder_cols: Sequence[str], root: str, notes: dict[str, Column]) -> DataFrame:
    """One small text per folder and name, made from an aggregate over the folder's rows."""
    folder_cols, names = list(folder_cols), list(notes)
    texts = df.groupBy(*folder_cols).agg(*[text.alias(f"_{i}") for i, text in enumerate(notes.values())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                folder = "/".join([root, *[str(row[c]) for c in folder_cols]])
                for i, name in enumerate(names):
                    write_file(f"{folder}/{name}", row[f"_{i}"].encode())
            yield frame[folder_cols].astype(str).agg("/".join, axis=1).to_frame("folder")

    return texts.mapInPandas(run, "folder string")


def _extent() -> Column:
    return F.concat_ws(" ", (F.max("r") + 1).cast("bigint"), (F.max("c") + 1).cast("bigint"))


def _floats(*names: str) -> Callable[[pd.DataFrame], bytes]:
    return lambda rows: rows[list(names)].to_numpy().astype(FLOAT32).tobytes()


def _ints(*names: str) -> Callable[[pd.DataFrame], bytes]:
    return lambda rows: rows[list(names)].to_numpy().astype(INT32).tobytes()


def _picture(*names: str) -> Callable[[pd.DataFrame], bytes]:
    def encode(rows: pd.DataFrame) -> bytes:
        width = int(rows["c"].max()) + 1
        return png_gray(gray_levels(rows[list(names)].mean(axis=1).to_numpy()).reshape(-1, width))

    return encode


def export_tiles(predicted: DataFrame, root: str, description: str, minutes: int = 0, folder_cols: Sequence[str] = ("tile",)) -> int:
    """Flat prediction and label files, gray images, dimensions and description per tile.

    ``predicted`` has r, c, inner_idx, y1, y2, pred1, pred2. Returns the number of tiles and
    raises when a tile has no files.
    """
    text = f"{description}\nTraining took {minutes} minutes."
    files = {
        "predictions.raw": _floats("pred1", "pred2"), "labels.raw": _floats("y1", "y2"),
        "predictions.png": _picture("pred1", "pred2"), "labels.png": _picture("y1", "y2"),
    }
    keep = [*folder_cols, "r", "c", "inner_idx", "y1", "y2", "pred1", "pred2"]
    rows = predicted.select(*dict.fromkeys(keep))
    written = export_parts(rows, folder_cols, "inner_idx", root, files)
    saved = written.agg(F.count_distinct("folder").alias("n")).first()["n"]
    noted = export_notes(rows, folder_cols, root, {"dimensions.txt": _extent(), "description.txt": F.max(F.lit(text))}).count()
    expected = predicted.select(*folder_cols).distinct().count()
    if saved != expected or noted != expected:
        raise RuntimeError(f"saved {saved} of {expected} tiles")
    return saved


def export_segments(segments: DataFrame, root: str, name: str = "seg.raw") -> int:
    """Segment ids as flat 32-bit integers: needs tile, inner_idx, seg."""
    return export_parts(segments, ["tile"], "inner_idx", root, {name: _ints("seg")}).count()


def export_gray(values: DataFrame, root: str, name: str, column: str) -> int:
    """A gray image of one value column with its ``dims.txt``: needs tile, r, c, inner_idx. Returns the tiles."""
    export_parts(values, ["tile"], "inner_idx", root, {f"{name}.png": _picture(column)}).count()
    return export_notes(values, ["tile"], root, {"dims.txt": _extent()}).count()


def export_training_tile(features: DataFrame, targets: DataFrame, dims: dict[str, tuple[int, ...]], root: str) -> None:
    """Tile folders for training: big-endian features, text targets, three dimension lines.

    ``features`` has tile, idx, values; ``targets`` has tile, idx, y (array); ``dims`` maps a
    tile to (outer_h, outer_w, r0, c0, r1, c1).
    """
    flat = lambda rows: np.stack(rows["values"].to_numpy()).astype(FLOAT32).tobytes()
    text = lambda rows: "".join(" ".join(str(int(v)) for v in y) + "\n" for y in rows["y"]).encode()
    export_parts(features, ["tile"], "idx", root, {"features.raw": flat}).count()
    export_parts(targets, ["tile"], "idx", root, {"targets.txt": text}).count()
    for tile, (h, w, r0, c0, r1, c1) in dims.items():
        write_file(f"{root}/{tile}/dimensions.txt", f"{h} {w}\n{r0} {c0}\n{r1} {c1}".encode())


def write_text(path: str, lines: Sequence[str] | str) -> None:
    """A small driver-side text such as a report; an existing file is replaced."""
    write_file(path, (lines if isinstance(lines, str) else "\n".join(lines) + "\n").encode())


def write_curve(model: BoostedModel, folder: str) -> None:
    """Losses and RMS gradients per iteration."""
    losses = ", ".join(str(row[1]) for row in model.curve)
    gradients = ", ".join(str(row[2]) for row in model.curve)
    write_text(f"{folder}/malis.txt", f"Losses = {losses}\nGradients = {gradients}")


def save_model(model: ForestModel, spark: SparkSession, path: str, description: str = "",
               thresholds: list[list[float]] | None = None) -> None:
    """Node table as parquet plus a JSON sidecar with weights, strategy, elements and base cut points."""
    model.to_df(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = {"weights": model.weights, "strategy": model.strategy, "elems": model.elems, "description": description, "thresholds": thresholds}
    write_text(f"{path}/model.json", json.dumps(meta))


def load_model(spark: SparkSession, path: str) -> ForestModel:
    meta = json.loads(read_text(f"{path}/model.json"))
    return ForestModel.from_df(spark.read.parquet(f"{path}/nodes"), meta["weights"], meta["strategy"], meta["elems"])


def load_thresholds(path: str) -> list[list[float]] | None:
    """Base cut points a saved model was trained with, when it was saved with them."""
    return json.loads(read_text(f"{path}/model.json")).get("thresholds")


def combine_models(spark: SparkSession, paths: Sequence[str], target: str) -> ForestModel:
    """Load several forests, merge their trees with equal weights, save with joined descriptions."""
    merged = merge_models([load_model(spark, path) for path in paths])
    notes = [json.loads(read_text(f"{path}/model.json"))["description"] for path in paths]
    cuts = [load_thresholds(path) for path in paths]
    shared = cuts[0] if all(c == cuts[0] for c in cuts) else None
    save_model(merged, spark, target, "\n\n".join(f"{p}:\n{note}" for p, note in zip(paths, notes, strict=True)), shared)
    return merged


def exists(path: str) -> bool:
    system, inner = open_at(path)
    return system.get_file_info(inner).type.name != "NotFound"
