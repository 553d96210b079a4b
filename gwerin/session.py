"""Session helpers shared by all operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
    """This run's checkpoint folder, below spark.checkpoint.dir.

    On one machine, where nothing is set, it lies below the warehouse folder; on a cluster
    an unset folder is an error, as executors would not find one another's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir") + "-checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    What a session wrote is removed with the frames if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder, for frames that are read several times.

    The table is the run's own and goes with its checkpoint folder.
    """
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most_rows: int) -> DataFrame:
    """The frame marked for broadcast if it has at most ``most_rows`` rows, else as it is: the join then shuffles. The rows of the join are the same."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
