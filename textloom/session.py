"""Session set-up and the ways a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings that every query relies on; a setting the user has made wins.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def build(app: str = "textloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and small Arrow batches; conf overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", **RUNTIME}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = b.config(map=settings | conf).getOrCreate()
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Sets what RUNTIME names, unless the session's launcher has set it. Texts may be long, so Arrow batches hold few rows."""
    launched = dict(spark.sparkContext.getConf().getAll())
    for k, v in RUNTIME.items():
        if k not in launched:
            spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only where it is unset (local tests) a temporary folder is taken."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: list[tuple[str, str]] = []


def clean_up(spark: SparkSession) -> int:
    """Deletes the tables that this session's queries have written so far; to be called once their results are stored. Returns their number."""
    own = [(app, path) for app, path in _written if app == spark.sparkContext.applicationId]
    for entry in own:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry[1])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(entry)
    return len(own)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to, for clean_up to delete."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext.applicationId, path))
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as a compressed table in the shared folder and reads it again.

    Later plans start from files that survive the loss of any executor, and an
    expensive step that is read twice runs once. zstd keeps the table small.
    """
    path = new_folder(df.sparkSession, "table")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if the reader makes so few splits of it that most would idle: a file of one row group is one task, whatever work follows.

    What counts is the reader's own split size: a table of more bytes than half the
    cores could have splits of, or of as many files, is read as it is, at any size.
    So is one below the reader's cost of opening a file, which is one task's work.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    settings = spark._jsparkSession.sessionState().conf()
    splits = max(len(df.inputFiles()), size // settings.filesMaxPartitionBytes())
    return df.repartition(cores) if size > settings.filesOpenCostInBytes() and 2 * splits <= cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
