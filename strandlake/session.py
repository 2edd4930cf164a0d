"""Sessions, table access and lineage cuts shared by the whole package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strandlake")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder takes its place on one machine; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: a table written to the shared folder, read back. ``options`` are the writer's.

    Unlike a checkpointed plan the table carries no inferred constraints, which grow from round to
    round in iterative jobs.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session_with(spark: SparkSession, **conf: str) -> SparkSession:
    """A session of its own with the settings of ``spark``, but for those in ``conf``."""
    own = spark.newSession()
    there = own.conf.getAll
    for key, value in (spark.conf.getAll | conf).items():
        if there.get(key) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def seen_by(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table that was cut, as a table of another session."""
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    if not folders:
        raise ValueError("only a table that was cut can be seen by another session")
    return spark.read.schema(df.schema).parquet(*folders)


class Scratch:
    """Tables cut for one computation, deleted from the shared folder once its results are written themselves."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def cut(self, df: DataFrame, **options: str) -> DataFrame:
        self.held.append(cut(df, **options))
        return self.held[-1]

    def clear(self) -> None:
        for df in self.held:
            spark = df.sparkSession
            for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.held.clear()
