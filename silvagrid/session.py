"""Session set-up and the few physical-plan helpers every module shares."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A lookup side below this many bytes (rows x assumed width) may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def session(app: str = "silvagrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; ``master=None`` leaves it to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call-site capture doubles the time to build large expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_silvagrid_shipped", None) is None:
        folder = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="silvagrid-")) / "silvagrid.zip"
        with zipfile.ZipFile(archive, "w") as target:
            for source in sorted(folder.rglob("*.py")):
                target.write(source, source.relative_to(folder.parent))
        context.addPyFile(str(archive))
        context._silvagrid_shipped = str(archive)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and return a frame that reads it back."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set from ``spark.checkpoint.dir`` where it is not yet.

    Only a local session that names none gets a temporary one; on a cluster its absence is an error, as executors
    would write to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="silvagrid-"))
    return context.getCheckpointDir().rstrip("/")


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; the frame that reads it and its path, for ``delete_shared``."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/silvagrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_shared(spark: SparkSession, path: str | None) -> None:
    """Delete a table of ``write_shared`` that no later plan reads."""
    if path is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer partitions than there are (small single files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_frame(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A driver-side table as a local relation (through Arrow, so no Python worker is involved)."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(struct)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(struct)
    arrays = [pa.array(list(col), type=f.type) for col, f in zip(columns, arrow_schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), struct)


def fits_broadcast(rows: int, row_bytes: int = 64) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], small_rows: int, spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join ``big`` to a lookup table that is unique on ``on``, safe under hot keys.

    Below the broadcast bound the lookup is broadcast. Above it each lookup row is
    replicated to a fixed number of salts and every row of ``big`` picks one salt by
    hashing its own ``spread`` columns, so one hot key is read by many tasks. The copies are never broadcast,
    which Spark would do by the size of the lookup's files: it knows neither how much they expand nor the salts.
    """
    if fits_broadcast(small_rows):
        return big.join(F.broadcast(small), on, how)
    salts = 16
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return salted_big.join(salted_small.hint("merge"), [*on, "_salt"], how).drop("_salt")
