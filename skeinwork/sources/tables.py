"""Tables in the folder that all machines share: what several steps use is made once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that spark.checkpoint.dir names, which all machines share; it goes when the driver ends.

    Where the setting is absent, a session on one machine uses /tmp/checkpoints, any other is refused."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/skeinwork-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


#: The setting by which shuffles of a query are removed when it ends, not when the driver's memory is cleared.
_CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str, cleared: bool = False) -> DataFrame:
    """Write df as Parquet and read it back: what several later steps use is made once, and lineage ends there.

    cleared: the shuffles of the writing are removed as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEARED, "false")
    conf.set(_CLEARED, "true" if cleared else before)
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        conf.set(_CLEARED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task takes of a table that is dealt.
TASK_ROWS = 250_000


def dealt(df: DataFrame, by: str, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """df by the hash of a column in as many parts as `rows` need, so that a task's share does not grow with the table; as it is where the
    session's partitions do. What joins it by the column is dealt alike."""
    parts = -(-rows // task_rows)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, by)


def spread(df: DataFrame, task_rows: int) -> DataFrame:
    """df in files of so many rows, for work that is much for a row: a small file is one task however long the work on its rows.

    It is written, since Spark moves filters, and with them the work that they judge, to before a mere shuffle."""
    return stored(df.repartition(max(1, -(-df.count() // task_rows))), f"{scratch(df.sparkSession)}/spread")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def claim(spark: SparkSession, path: str, word: str) -> bool:
    """Create a small file if no one has; of several writers one succeeds."""
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(word.encode()))
    out.close()
    return True


def word_of(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
