"""Session helpers: a tuned builder, the checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a "small" side is not broadcast but shuffled.
BROADCAST_ROW_LIMIT = 200_000


def build_session(master: str | None = None, app: str = "lineagelab",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """SparkSession with AQE, skew-join handling, UTC and Arrow on; UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` / the context's checkpoint
    dir). Only a local-mode session without one gets a fresh temporary folder
    (tests); a cluster session without one is an error, because a
    machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    local = tempfile.mkdtemp(prefix="lineagelab-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark)
    import uuid
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT,
                       known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven to be ≤ ``limit``.

    The check counts at most ``limit + 1`` rows, so it stays cheap even when
    the side turns out to be large; above the bound the plain DataFrame is
    returned and Spark shuffles it.
    """
    n = known_rows if known_rows is not None else df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def materialize(df: DataFrame, name: str, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the files instead of replaying
    the joins that built them) and computes the input only once, unlike an
    eager ``checkpoint()`` of an unpersisted plan.

    With ``by`` the rows are dealt to ``buckets`` buckets of that column (one shuffle, unless ``df`` already
    lies so) and kept as a bucketed table of the session's catalog: later joins and aggregations by it move none of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = os.path.basename(path).replace("-", "_")
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


SAMPLES_PER_BUCKET = 20_000


def sample_buckets(spark: SparkSession, n_samples: int) -> int:
    """Buckets of the tables keyed by sample: they grow with the samples, so that a task's share does not.

    With fewer buckets than shuffle partitions a join would deal both sides anew; that is left to tables of one bucket's size.
    """
    least = spark.sparkContext.defaultParallelism if n_samples <= SAMPLES_PER_BUCKET else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(least, n_samples), -(-n_samples // SAMPLES_PER_BUCKET))


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that no later plan reads (a round's predecessor)."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if not path.toUri().getPath().startswith(base.toUri().getPath() + "/"):
            raise ValueError(f"not a table under the checkpoint folder: {folder}")
        fs.delete(path, True)
        spark.sql(f"DROP TABLE IF EXISTS `{os.path.basename(folder).replace('-', '_')}`")


_SHIPPED: set = set()


def ensure_importable(spark: SparkSession) -> None:
    """Ship this package to the executors once per application (``addPyFile``).

    Arrow UDFs and co-group functions refer to ``lineagelab`` modules by name;
    executors started from another working directory (any cluster) need the
    package on their path.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="lineagelab-pkg-"), "lineagelab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
