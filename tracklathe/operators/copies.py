"""Differences between two copies of a table by content-defined chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklathe.session import cut

ROWS_A_BUCKET = 200_000


def current(listing: DataFrame, key: list[Column], key_names: list[str], latest: str, columns: list[str]) -> DataFrame:
    """The row of each key listed last. Ties go to the greatest row by its columns, so the result is one and the same."""
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    by = F.struct(F.col(latest), *[F.col(c).cast("string") for c in columns])
    return listing.groupBy(*[k.alias(n) for k, n in zip(key, key_names)]).agg(F.max_by(row, by).alias("row"), F.count(F.lit(1)).alias("n_listed"))


def _rotated(h: Column, by: int) -> Column:
    """A 64-bit hash turned left, so that no bit of it is lost."""
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def chunked(side: DataFrame, key: list[str], buckets: int, width: int = 4, mask: int = 63) -> DataFrame:
    """Adds ``bucket`` and ``chunk`` to rows with one row a key.

    Rows go by hash buckets of the key and are sorted by key inside one. A chunk ends where the rolling hash over the last
    ``width`` keys, each turned by its place, has zeros under ``mask`` in its top bits. The cut thus depends on the keys near
    by and on nothing else: an added or removed row moves cuts only in the ``width`` rows from it on.
    """
    w = Window.partitionBy("bucket").orderBy(*key)
    side = side.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).withColumn("_h", F.xxhash64(F.lit(17), *key))
    roll = F.col("_h")
    for i in range(1, width):
        roll = roll.bitwiseXOR(_rotated(F.coalesce(F.lag("_h", i).over(w), F.lit(0)), i * 13 % 64))
    side = side.withColumn("_ends", (F.shiftrightunsigned(roll, 40).bitwiseAND(F.lit(mask)) == 0).cast("int"))
    return side.withColumn("chunk", F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_h", "_ends")


def _prints(rows: DataFrame) -> DataFrame:
    """One fingerprint a chunk: the count and two sums of independent 64-bit hashes of the rows' contents, in halves.

    Equal prints mean equal rows. Hashes and sums are the map side's; only one small row a chunk and task is shuffled.
    """
    halves = [h for c in ("_one", "_two") for h in (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(c), 32))]
    return rows.groupBy("bucket", "chunk").agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"p{i}") for i, h in enumerate(halves)])


def copy_differences(
    left: DataFrame, right: DataFrame, key: list[str], fields: dict[str, str], tolerance: dict[str, float] | None = None,
    only_left: str = "only_left", only_right: str = "only_right", width: int = 4, mask: int = 63,
) -> DataFrame:
    """Rows missing on either side and fields that differ, between two tables with one row a key and a struct ``row``.

    ``fields`` names the struct's fields and how they compare: ``text`` (case and outer blanks don't count), ``number``
    (by ``tolerance`` where given) or ``exact``. Null against a value differs, null against null doesn't. Result: the key,
    ``field_name`` (``only_left``/``only_right`` for a missing row), both values as text, ``delta`` for numbers.

    Rows are chunked by content; chunks whose fingerprints stand on both sides are dropped; only rows of the others meet
    in a join. Numbers with a tolerance go into the fingerprint by cells no wider than it, so equal prints can't hide a
    difference. An empty side gives a missing row for every key of the other.
    """
    tolerance = tolerance or {}

    def canon(f: str, kind: str, row: str) -> Column:
        c = F.col(row)[f]
        if kind == "text":
            return F.lower(F.trim(c))
        if f in tolerance:
            return F.round(c / tolerance[f]).cast("string")
        return c.cast("string")

    content = F.to_json(F.struct(*key, *[canon(f, k, "row").alias(f) for f, k in fields.items()]), {"ignoreNullFields": "false"})
    left, right = cut(left), cut(right)  # each listing is read and reduced once, then counted, chunked and diffed
    rows = max(left.count(), right.count())
    buckets = 2 ** math.ceil(math.log2(max(1, rows / ROWS_A_BUCKET) * 8))
    hashed = lambda x: x.withColumn("_one", F.xxhash64(content)).withColumn("_two", F.xxhash64(content, F.lit(29)))
    a, b = (chunked(hashed(x), key, buckets, width, mask) for x in (left, right))
    prints, equal = [_prints(x) for x in (a, b)], ["bucket", "n", "p0", "p1", "p2", "p3"]
    unmatched = [p.join(q.select(*equal), equal, "left_anti").select("bucket", "chunk") for p, q in (prints, prints[::-1])]
    a, b = (x.join(u, ["bucket", "chunk"], "left_semi") for x, u in zip((a, b), unmatched))
    a = a.select(*key, F.col("row").alias("a"))
    b = b.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("row").alias("b"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    both = a.join(b, same, "full")
    missing = F.struct(
        F.when(F.col("b").isNull(), F.lit(only_left)).when(F.col("a").isNull(), F.lit(only_right)).alias("field_name"),
        F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"), F.lit(None).cast("double").alias("delta"),
    )
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    found = [missing]
    for f, kind in fields.items():
        x, y = F.col("a")[f], F.col("b")[f]
        if kind == "text":
            differs = ~F.lower(F.trim(x)).eqNullSafe(F.lower(F.trim(y)))
        elif f in tolerance:
            differs = (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance[f], F.lit(False))
        else:
            differs = ~x.eqNullSafe(y)
        delta = (y - x).cast("double") if kind == "number" else F.lit(None).cast("double")
        found.append(F.struct(F.when(here & differs, F.lit(f)).alias("field_name"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"), delta.alias("delta")))
    cases = both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in key], F.explode(F.filter(F.array(*found), lambda z: z["field_name"].isNotNull())).alias("z"))
    return cases.select(*key, "z.*")
