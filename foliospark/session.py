"""Session construction and lineage cutting.

``stage`` is the one way in which this library cuts lineage: it writes a
DataFrame as parquet below the folder that all executors share and reads it
back.  A lost executor costs a re-run of the tasks that were running, never of
the stages before the written table.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_NEXT = itertools.count()
_LOCAL: dict[str, str] = {}

#: Settings for a session of our own; a session that is given is used as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; keyword settings win over them."""
    b = SparkSession.builder.master(master).appName("foliospark")
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (a test, or one machine) a temporary folder is
    made; on a cluster the setting must be present, and its absence is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="foliospark-")
    return "file://" + _LOCAL[app]


def spread(spark: SparkSession) -> int:
    """Partitions for few bytes that take long to join: sized by bytes, few tasks would have all the pairs."""
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stage(df: DataFrame, name: str, partition_files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it.

    The folder is removed when the JVM ends.  An empty ``df`` keeps its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliospark-{_RUN}/{next(_NEXT):05d}-{name}"
    (df.coalesce(partition_files) if partition_files else df).write.mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Have the shuffle files of plans that are done deleted: they stay until the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()
