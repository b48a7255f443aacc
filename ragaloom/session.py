"""Session set-up, table loading and tables written to the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ragaloom", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; a cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_ragaloom_scratch", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="ragaloom-")
        spark._ragaloom_scratch = made
    return made


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, where: str, to: str) -> None:
    """Puts a folder in the place of another one, which is deleted."""
    path, fs = _path(spark, to)
    fs.delete(path, True)
    if not fs.rename(_path(spark, where)[0], path):
        raise OSError(f"{where} can't be moved to {to}")


class Written:
    """A table written to the scratch folder: its lineage ends there, and it outlives the loss of an executor."""

    def __init__(self, df: DataFrame, label: str) -> None:
        spark = df.sparkSession
        self.where = f"{scratch_dir(spark)}/ragaloom/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.where)
        path, fs = _path(spark, self.where)
        fs.deleteOnExit(path)
        self.bytes = fs.getContentSummary(path).getLength()
        self._spark = spark
        spark._ragaloom_tables = [*getattr(spark, "_ragaloom_tables", []), self.where]
        self.df = spark.read.schema(df.schema).parquet(self.where)

    def drop(self) -> None:
        """Deletes the files; for steps of a loop that nothing reads any more."""
        path, fs = _path(self._spark, self.where)
        fs.delete(path, True)


def discard(spark: SparkSession) -> int:
    """Deletes all tables of the session in the scratch folder, once nothing reads them any more: a query's result does
    until it is stored. Returns their number. What isn't discarded goes when the session ends."""
    tables, spark._ragaloom_tables = getattr(spark, "_ragaloom_tables", []), []
    for where in tables:
        path, fs = _path(spark, where)
        fs.delete(path, True)
    return len(tables)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from the scratch folder."""
    return Written(df, label).df
