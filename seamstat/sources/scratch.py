"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="seamstat-")
    return _own_folders[application]


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back: short lineage, known size, pruned columns.

    Tasks hold a row group while they write it and the rows of one while they read it. Of large rows
    pass ``group_bytes``, or a group is first measured after a hundred of them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    limits = {} if group_bytes is None else {"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1"}
    df.write.options(**limits).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
