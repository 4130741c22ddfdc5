"""Session setup and the shared knobs every job reads.

Production sessions come from the cluster; ``configure`` only fills in what is
unset so a cluster's own choices (shuffle partitions, checkpoint directory)
always win.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job relies on for correct results (time zone, ANSI errors) or for
# scale (adaptive execution, skew splitting).  Applied only when unset.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Largest dimension (rows, bytes) a job may broadcast.  A dimension above either
# is joined by shuffle instead; the check is done by ``operators.joins``.
BROADCAST_ROW_LIMIT_KEY = "refinery.broadcast.maxRows"
BROADCAST_ROW_LIMIT_DEFAULT = 2_000_000
BROADCAST_BYTE_LIMIT_KEY = "refinery.broadcast.maxBytes"
BROADCAST_BYTE_LIMIT_DEFAULT = 256 << 20


def build_local(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "refinery",
                extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "64")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill in defaults the session does not set yet."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    if _single_process(spark):
        # worker processes of a local session import the package from where the driver does;
        # on a cluster the package is installed or passed with --py-files
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        env = spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    return spark


def _single_process(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage: ``spark.checkpoint.dir`` of the session.

    Without that setting only a single-process local session gets a scratch
    folder; on a cluster executors would each write to their own disk, so the
    call raises.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not _single_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="refinery-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def broadcast_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROW_LIMIT_KEY, str(BROADCAST_ROW_LIMIT_DEFAULT)))


def broadcast_byte_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTE_LIMIT_KEY, str(BROADCAST_BYTE_LIMIT_DEFAULT)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives lost executors).

    The input is persisted for the duration of the checkpoint so the write
    reuses the computed partitions instead of computing the plan a second time.
    """
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no frame needs any more.

    It removes them when the driver's JVM collects garbage.  A driver with much memory may not do
    so for the length of a loop, and the files of every iteration would stay on the executors' disks.
    """
    gc.collect()  # the driver's frames hold on to theirs in the JVM
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Tables in the shared checkpoint folder that are removed when they are no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a frame and return it reread, so that its plan is cut."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: int = 0) -> None:
        """Remove all tables but the last ``but`` ones."""
        self._remove(self.paths[:len(self.paths) - but])

    def drop_last(self, n: int) -> None:
        """Remove the last ``n`` tables."""
        self._remove(self.paths[len(self.paths) - n:])

    def _remove(self, paths: list[str]) -> None:
        self.paths = [p for p in self.paths if p not in paths]
        for path in paths:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Latest(Tables):
    """Tables of a loop that needs the last ones only."""


def compute_partitions(spark: SparkSession, factor: int = 2) -> int:
    """Partitions for CPU-heavy stages: a small multiple of the cluster's cores."""
    return max(1, spark.sparkContext.defaultParallelism * factor)


TEXTS_PER_TASK = 1 << 13  # whole texts, a few KB each, that a task splits and counts


def spread(df: DataFrame, key: str | None = None, factor: int = 2, rows: int | None = None,
           tasks: int = 0) -> DataFrame:
    """Spread rows over all cores before CPU-heavy row work (tokenising, model inference).

    A scan yields one task per file split; a few large unsplittable files
    (one row group, gzip) would leave most cores idle.  The cost is one
    shuffle of the rows, worth it only where per-row compute dominates.  With
    ``rows`` there are as many tasks as keep a task near that number, however
    large the input; they are counted first.  ``tasks`` is a least number of tasks.
    """
    n = max(compute_partitions(df.sparkSession, factor), tasks)
    if rows:
        n = max(n, -(-df.count() // rows))
    return df.repartition(n, key) if key else df.repartition(n)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
