"""Session helpers: tables, code shipping, and materialised intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of Parquet, that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Whether Spark deletes the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one join key that a task may get.
HOT_ROWS = 1 << 20


def local_session(cpus: int | str = 8, app: str = "lexloom", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder. The package is sent to the workers first, since any query may run its functions there."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_lexloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexloom-"), "lexloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("lexloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._lexloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(spark.sparkContext, "_lexloom_tmp", None) or "file://" + tempfile.mkdtemp(prefix="lexloom-shared-")
        spark.sparkContext._lexloom_tmp = d
    return d.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors; the columns are
    compressed, unlike RDD checkpoints. What was shuffled for the stage is deleted once it is
    written. An empty frame gives an empty table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex[:12]}"
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    sc = spark.sparkContext
    if not hasattr(sc, "_lexloom_tables"):
        sc._lexloom_tables = []
        atexit.register(clean, spark)
    sc._lexloom_tables.append(path)
    return out


def clean(spark: SparkSession) -> None:
    """Delete the stages written so far; called at the end of the application, or between independent queries."""
    sc = spark.sparkContext
    try:
        for path in getattr(sc, "_lexloom_tables", []):
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        sc._lexloom_tables = []
    except Exception:  # the session is gone already
        pass


def path_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def memory_bytes(df: DataFrame) -> int:
    """Size of a frame's rows in memory: lengths of its strings, 8 bytes for every other value, 32 for each row."""
    parts = [F.lit(32)]
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 8)
        elif kind in ("array", "map", "struct"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    return df.select(F.sum(reduce(lambda x, y: x + y, parts).cast("bigint"))).first()[0] or 0


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a frame from `materialize` may be broadcast: by its written size, and if that is under the limit by its size in memory."""
    return path_bytes(df.sparkSession, df._lexloom_path) <= limit and memory_bytes(df) <= 4 * limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES):
    """The frame itself with a broadcast hint if it `fits`, else unchanged. Only for frames from `materialize`."""
    return F.broadcast(df) if fits(df, limit) else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join in which no task gets more than about `hot` rows of one key of `left`.

    right: from `materialize`, unique by `on`, with the number `n` of left rows of each key. A
    right side that fits is broadcast. Else the rows of a hot key are dealt by hash to as many
    places as it needs, and only its row on the right is repeated; there are at most (rows of
    left) / `hot` such keys.
    """
    if fits(right):
        return left.join(F.broadcast(right), on)
    keys = materialize(right.where(F.col(n) > hot).select(*on, F.ceil(F.col(n) / hot).cast("int").alias("_places")), "hot-keys")
    if not keys.limit(1).count():
        return left.join(right, on)
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_places"))
    spread = left.join(small(keys), on, "left").withColumn("_place", F.coalesce(deal, F.lit(0)).cast("int")).drop("_places")
    every = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / hot).cast("int"), F.lit(1)) - 1))
    return spread.join(right.withColumn("_place", every), [*on, "_place"]).drop("_place")
