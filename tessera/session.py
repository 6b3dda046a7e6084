"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["by_key", "get_spark", "own_folder", "path_exists", "plain_unions", "remove_path", "release", "shared", "shared_dir", "spread", "stamp", "table", "written"]


def get_spark(app: str = "tessera", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def plain_unions(spark: SparkSession) -> None:
    """Unions that don't zip the partitions of their sides.

    Spark 4.1 plans a union of equally partitioned sides as one that keeps the partitioning; if adaptive execution then
    coalesces the sides to different numbers of partitions, the query fails ("Can't zip RDDs").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over all cores where its files give fewer splits than the cluster has cores.

    A small parquet file is one split, so the Python stages after it would run in one task. Inputs with enough splits are left
    alone (no shuffle). The splits are those of the planned scan, and nothing is run to count them: a plan with a shuffle in it
    is dealt over the cores as it is.
    """
    spark = df.sparkSession
    plain_unions(spark)
    cores = spark.sparkContext.defaultParallelism
    planned = df._jdf.queryExecution()
    shuffles = planned.executedPlan().nodeName().startswith("AdaptiveSparkPlan") or "Exchange" in planned.executedPlan().toString()
    return df.repartition(cores) if shuffles or planned.toRdd().getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows partitioned by ``keys`` into a fixed number of partitions, at least one for each core.

    What follows on the same keys needs no further shuffle, and costly expressions after it aren't left to the few tasks to
    which adaptive execution would coalesce small partitions.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


_OWN_DIR: list[str] = []
_MADE: dict[str, DataFrame] = {}
_AT_EXIT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a local session,
    all of whose executors are on this machine; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return _OWN_DIR[0]


def own_folder(spark: SparkSession) -> str:
    """What this application writes in the shared folder; it is removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _AT_EXIT:
        _AT_EXIT.add(app)
        atexit.register(release, spark)
    return f"{shared_dir(spark)}/tessera-{app}"


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Removes a folder of the engine's own; whether it was there."""
    files, at = _file_system(spark, path)
    return files.delete(at, True)


def release(spark: SparkSession) -> None:
    """Removes all that ``written`` and ``shared`` made for this application. Results that read it must be used up before."""
    try:
        remove_path(spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}")
    except Exception:  # noqa: BLE001 - the session has ended already, and with it the way to the file system
        pass
    _MADE.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new parquet table in the shared folder: computed once, columnar, and safe from lost executors."""
    plain_unions(df.sparkSession)
    at = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells one state of the files at ``path`` from another: their number, bytes and last change, as the file system has
    them; nothing is read."""
    files, at = _file_system(spark, path)
    sums = files.getContentSummary(at)
    return f"{sums.getFileCount()} {sums.getLength()} {files.getFileStatus(at).getModificationTime()}"


def shared(spark: SparkSession, sf_dir: str, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` of the table ``source``, written once for each state of it and read by every query that asks for ``name``."""
    key = f"{spark.sparkContext.applicationId} {sf_dir} {name} {stamp(spark, f'{sf_dir}/{source}.parquet')}"
    if key not in _MADE:
        _MADE[key] = written(make(), name)
    return _MADE[key]
