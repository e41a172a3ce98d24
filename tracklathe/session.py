"""Session plumbing: tables, shared folders and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where that is unset, a local folder if everything runs
    in one process (tests); a cluster without it is refused, as its machines would see different folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="tracklathe-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table or a stream's state in the shared folder."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def fixed_list(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a table that is fixed and short by its nature; one that isn't is refused, never shortened."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table that should be a short list")
    return rows


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table written to the shared folder, so a lost executor costs no earlier rounds.

    Unlike checkpoint(), which hands the plan's constraints on and lets them grow from round to round, a table starts the
    next plan afresh and tells the planner its size.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Ends a row-local computation: later filters on its columns don't repeat its expressions.

    Catalyst pushes a filter below a projection by writing the projected expressions into the filter; it doesn't do so
    through a generator.
    """
    from pyspark.sql import functions as F

    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")
