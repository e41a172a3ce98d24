"""Mixing sources to target weights: exact budgets by token length, bounded repeats, seeded choice."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklathe.session import cut

#: Size of the first window that the exact fit works on, in units of the lengths' greatest common divisor; of small budgets a sixteenth.
WINDOW = 1 << 12


def source_name(source: Column) -> Column:
    """A source in lower case, without outer blanks, ``_`` and inner blanks as ``-``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", "-")


def _reached(free: list[tuple[int, int]], goal: int) -> tuple[dict[int, int], int]:
    """How many to take of each (length, count) for the greatest sum up to the goal, and what then is short.

    A bounded knapsack over reachable sums as the bits of one integer, counts split into powers of two. ``first`` keeps for
    each sum the step that reached it first, so one walk back gives the counts.
    """
    mask, reach, steps, first = (1 << (goal + 1)) - 1, 1, [], np.full(goal + 1, -1, np.int32)
    for n, count in free:
        count, part = min(count, goal // n), 1
        while count > 0 and not reach >> goal & 1:
            k = min(part, count)
            new = (reach << (n * k)) & mask & ~reach
            if new:
                at = np.frombuffer(new.to_bytes(goal // 8 + 1, "little"), np.uint8)
                some = np.nonzero(at)[0]
                first[(some[:, None] * 8 + np.arange(8))[np.unpackbits(at[some, None], axis=1, bitorder="little").astype(bool)]] = len(steps)
                reach |= new
            steps.append((n, k))
            count, part = count - k, part * 2
    at, take = reach.bit_length() - 1, {}
    short = goal - at
    while at > 0:
        n, k = steps[first[at]]
        take[n], at = take.get(n, 0) + k, at - n * k
    return take, short


def _spread(free: dict[int, int], goal: int) -> dict[int, int]:
    """How many to take of each length, in the lengths' own proportions, for a sum up to the goal that no length left fits in.

    What rounding leaves of one length's share goes to the next longer one, so that lengths of which there are few come into
    their own together; what then is left is shared out again among those that still fit.
    """
    take = dict.fromkeys(free, 0)
    while some := {n: c - take[n] for n, c in sorted(free.items()) if n <= goal and c > take[n]}:
        total, due, taken = sum(n * c for n, c in some.items()), 0, 0
        for n, c in some.items():
            due += n * c
            k = min(c, (due * min(goal, total) // total - taken) // n)
            take[n], taken = take[n] + k, taken + n * k
        goal -= taken
    return take


def subset(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many to take of each length so that the sum comes as near to the budget from below as the counts allow.

    Each length's share is taken first, but for a window of tokens, which is then filled exactly as a bounded knapsack. The
    knapsack takes the longest first, so its window is a small part of the budget. A window that fills the budget, to less
    than the lengths' common divisor, is proof that nothing nearer exists; else the window doubles, up to the whole
    budget, where the fit is exact by itself.
    """
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return dict(lengths)
    unit = math.gcd(*lengths)
    goal = max(0, budget) // unit
    window = max(1, min(WINDOW, goal // 16))
    scaled = {n // unit: c for n, c in lengths.items()}
    while True:
        take = _spread(scaled, goal - window)
        rest = goal - sum(n * c for n, c in take.items())
        more, short = _reached([(n, scaled[n] - take[n]) for n in sorted(scaled, reverse=True)], rest)
        if short == 0 or rest == goal:
            return {n * unit: c + more.get(n, 0) for n, c in take.items()}
        window *= 2


def mixed(sized: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents to use with their number of copies, and the report by source.

    ``sized`` has ``doc_id, source, n_tokens``, ``targets`` (a fixed list) ``source, target_share, max_repeats``. Without
    ``total_tokens`` the mix is the largest for which no source must be used more than its ``max_repeats``. With it, a source
    whose share asks for more than its ``max_repeats`` passes gives just those, and the report shows what it is short of. Each source
    gets whole passes over its documents and a seeded part of one more, whose sum is fitted to the budget. Null sources,
    sources without target and documents without tokens are not drawn; a source without documents is reported with 0.
    Rows of one id count once.

    The fit is one small task a source: it sees counts by length, never documents.
    """
    rows = sized.where("n_tokens > 0 and source is not null and doc_id is not null").dropDuplicates(["doc_id"])
    rows = cut(rows.withColumn("source", source_name(F.col("source"))).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").select("doc_id", "source", "n_tokens"))
    lengths = rows.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    have = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("have"))
    wants = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").collect()  # one row a target
    if total_tokens is None:
        total_tokens = min((int(r.max_repeats * r.have / r.target_share) for r in wants if r.have and r.target_share), default=0)
    budgets = {r.source: (min(round(r.target_share * total_tokens), r.max_repeats * (r.have or 0)), r.have or 0) for r in wants}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        budget, have = budgets[pdf.source.iloc[0]]
        passes = budget // have
        take = subset({int(k): int(v) for k, v in zip(pdf.n_tokens, pdf.n)}, budget - passes * have)
        return pd.DataFrame({"source": pdf.source, "n_tokens": pdf.n_tokens, "passes": passes, "take": [take.get(int(k), 0) for k in pdf.n_tokens]})

    plan = lengths.groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, passes bigint, take bigint")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = rows.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned(h, 56))
    counts = rows.groupBy("source", "n_tokens", "_b").agg(F.count(F.lit(1)).alias("_n")).join(plan, ["source", "n_tokens"])
    upto = F.sum("_n").over(Window.partitionBy("source", "n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select("source", "n_tokens", "_b", "passes", (F.col("take") - upto + F.col("_n")).alias("_left"), "_n")
    rows = rows.join(counts, ["source", "n_tokens", "_b"])
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "_b").orderBy("_h", "doc_id"))
    extra = F.when(F.col("_left") >= F.col("_n"), 1).when(F.col("_left") <= 0, 0).otherwise((rank <= F.col("_left")).cast("int"))
    drawn = rows.withColumn("copies", F.col("passes") + extra).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    used = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    report = targets.join(used, "source", "left").withColumn("all", F.sum("tokens").over(Window.partitionBy())).select(  # one row a target
        "source", "target_share", "max_repeats", F.lit(total_tokens).cast("bigint").alias("mix_tokens"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.try_divide(F.col("tokens"), F.col("all")), F.lit(0.0)).alias("actual_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return drawn, report
