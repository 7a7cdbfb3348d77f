"""Tables that several later steps read and that should be made once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths of the tables that kept() made within kept_alone().
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Where it is unset, a temporary one in local mode; on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="assay-")
    return _own[app]


def kept(table: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder, read back: a lost executor costs a read, and later plans begin there."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def kept_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """kept() of the table that make() returns; what make() itself kept on its way is deleted then, as only this table reads it."""
    steps: list[str] = []
    outer = _made.set(steps)
    try:
        table = make()
    finally:
        _made.reset(outer)
    out = kept(table, name)
    for path in steps:
        _delete(out.sparkSession, path)
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that kept() made and nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(table.sparkSession, folder)
