"""Stamped tables, dead letters and text exports."""

from __future__ import annotations

import platform
import subprocess
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklathe.functions.text import six_digits


@dataclass(frozen=True)
class Stamp:
    """Where an artefact comes from; part of every row written."""

    commit: str
    dirty: bool
    seed: int
    made_at: str
    versions: str

    @property
    def reproducible(self) -> bool:
        return not self.dirty and len(self.commit) == 40

    @classmethod
    def make(cls, seed: int, folder: str = ".") -> "Stamp":
        git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True).stdout.strip()
        import pyspark

        return cls(git("rev-parse", "HEAD") or "none", bool(git("status", "--porcelain")), seed, datetime.now(timezone.utc).isoformat(timespec="seconds"), f"python {platform.python_version()}, spark {pyspark.__version__}")


def stamped(df: DataFrame, stamp: Stamp) -> DataFrame:
    """The rows with the stamp's columns."""
    return df.withColumns({f"stamp_{k}": F.lit(getattr(stamp, k)) for k in ("commit", "dirty", "seed", "made_at", "versions")} | {"stamp_reproducible": F.lit(stamp.reproducible)})


def write_table(df: DataFrame, path: str, stamp: Stamp, by: list[str] | None = None, overwrite: bool = False) -> None:
    """A stamped table; what is there already is never overwritten unless that is asked for."""
    w = stamped(df, stamp).write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_text(df: DataFrame, path: str, stamp: Stamp, order: list[str], overwrite: bool = False) -> None:
    """Small artefacts as one ordered CSV file, doubles to six significant digits, for byte-equal reruns."""
    exact = df.withColumns({c: six_digits(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    stamped(exact, stamp).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def dead_letters(df: DataFrame, kind: str, key: list[str], reason) -> DataFrame:
    """Rows that can't be used as (kind, key, reason): the one shape of all dropped windows, files and epochs."""
    return df.select(F.lit(kind).alias("kind"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"), reason.alias("reason"))


def write_session(df: DataFrame, path: str, stamp: Stamp, run) -> None:
    """A run with a state: ``recording`` while ``run`` works, ``complete`` with its figures after it."""
    state = lambda s: stamped(df.withColumn("status", F.lit(s)), stamp).coalesce(1).write.mode("overwrite").json(path)
    state("recording")
    run()
    state("complete")


def observed(df: DataFrame, name: str, **counts) -> DataFrame:
    """A frame whose counts can be read after its sink has run: rows are counted, never silently lost."""
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in counts.items()])
