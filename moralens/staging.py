"""Tables written once to the shared checkpoint folder and read back.

A staged table cuts the lineage, survives the loss of executors (nothing has to be recomputed)
and carries its real size, which the planner and ``row_count`` use to choose between join forms.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, tempfile.TemporaryDirectory] = {}
_staged: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        # goes away with the process
        _local_roots[app] = tempfile.TemporaryDirectory(prefix="moralens-", ignore_cleanup_errors=True)
    return _local_roots[app].name


#: Writer settings for rows of megabytes: the size of a row group is looked at after every row, so neither
#: the writer nor a reader's batch holds more than a few rows (the usual first look is after 100 rows).
LARGE_ROWS = {"parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the staging root and return a reader of it."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{staging_root(spark).rstrip('/')}/moralens/{app}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).options(**(options or {})).parquet(path)
    _staged.setdefault(app, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def row_count(staged: DataFrame) -> int:
    """Rows of a staged table; answered from Parquet footers."""
    return staged.count()


def release(staged: DataFrame) -> None:
    """Delete one staged table; for intermediate tables that no result depends on any more."""
    spark = staged.sparkSession
    kept = _staged.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        path = next((p for p in kept if folder.endswith(p.split("://")[-1].removeprefix("file:"))), None)
        if path:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            kept.remove(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete every table this session staged; call it when no result depends on them any more."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
