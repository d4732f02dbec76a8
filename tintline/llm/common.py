"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every contract here means it: blank and 0x09 to 0x0D.
WS = " \t\n\x0b\x0c\r"
WS_RE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Where that is unset, a local session (tests, one machine) gets a temporary one; on a
    cluster it would be another folder on each machine, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tintline-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder beside the checkpoints."""
    return f"{shared_folder(spark)}/{what}-{uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Like ``checkpointed``, but as Parquet, of which later steps read the columns that they need."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else; the plain ``lower`` does for pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    """The words of a text, as an array; null and blank texts have none."""
    trimmed = F.btrim(c, F.lit(WS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WS_RE)
    )
