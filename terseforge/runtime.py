"""Session helpers shared by every operator: table access, durable lineage cuts, batch sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def session(app: str = "terseforge", cores: str | None = None) -> SparkSession:
    """A local session for tests, the bench and the command line; a cluster brings its own."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or os.environ.get('BENCH_CPUS', '*')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> None:
    """Puts this package on the path of the Python workers, wherever the driver was started from."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder, whole."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, dealt out over all cores.

    A few files of one row group each would otherwise keep whole text operators in a few tasks. A
    scan that already fills the cores is left as it is and moves nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows and bytes of an Arrow batch, the same for every operator, so that no query changes another's.
BATCH_ROWS, BATCH_BYTES = 2000, "64m"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts never fill a Python worker."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master may it be unset; a temporary folder then serves, and goes when the session's
    driver ends. On a cluster a folder of one machine would be lost with it, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="terseforge-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return "file://" + _LOCAL["folder"]


_LOCAL: dict[str, str] = {}


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives any executor, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def hashed_sample(df: DataFrame, key: str, most: int, n: int) -> list[Row]:
    """The rows of the ``most`` least hashes of ``key``, in order; ``n`` is about how many rows there are.

    Only rows under a cut that about 1.2 x ``most`` rows pass come to the driver, however many tasks
    read the table (an ordered limit would bring ``most`` from each). Too few under the cut doubles it,
    too many halve it.
    Of rows that share a key beyond four times ``most`` any may stay out.
    """
    placed = df.withColumn("__h", F.xxhash64(key))
    share, bound = min(1.2 * (most + 50) / max(n, 1), 1.0), 4 * (most + 50)
    held: list[Row] = []  # of a cut that too many rows pass
    while True:
        kept = placed if share >= 1 else placed.where(F.col("__h") < int(-(2**63) + share * 2**64))
        rows = kept.limit(bound).collect()
        if len(rows) >= bound and share > 1e-12:
            held, share = rows, share / 2
        elif len(rows) < most and share < 1 and not held:
            share = min(2 * share, 1.0)
        else:
            chosen = rows if len(rows) >= most or not held else held
            return sorted(chosen, key=lambda r: (r["__h"], str(r[key])))[:most]
