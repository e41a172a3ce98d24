"""Implausible values in measured series: physical limits, stuck runs, and outliers of a robust autoregression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklathe.session import cut

SERIES = ["table_name", "source", "field_name"]
PACKED = "table_name string, source string, field_name string, block bigint, ids array<bigint>, v array<double>, possible array<boolean>, n bigint, head_n bigint, head_v double, tail_n bigint, tail_v double"
STATE = "table_name string, source string, field_name string, block bigint, n bigint, s double, q double, k bigint, a double, f double, c double, e double, last double, gap bigint, marks bigint"
CASES = "table_name string, row_id bigint, field_name string, source string, value double, reason string"


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column."""
    at = column.offsets.to_numpy()
    return at - at[0], column.values.slice(at[0], at[-1] - at[0])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts each block by place, drops repeated rows, and notes its first and last run of equal values."""
    for b in batches:
        if not len(b):
            continue
        at, rows = _lists(b.column("r"))
        seg = np.repeat(np.arange(len(b)), np.diff(at))
        place = rows.field("at").to_numpy(zero_copy_only=False).astype(float)
        ids, v, ok = (rows.field(x).to_numpy(zero_copy_only=False) for x in ("row_id", "value", "possible"))
        order = np.lexsort((v, ids, np.where(np.isnan(place), -np.inf, place), seg))
        seg, ids, v, ok = seg[order], ids[order], v[order], ok[order].astype(bool)
        keep = np.ones(len(seg), bool)
        keep[1:] = (seg[1:] != seg[:-1]) | (ids[1:] != ids[:-1])
        seg, ids, v, ok = seg[keep], ids[keep], v[keep], ok[keep]
        n = np.bincount(seg, minlength=len(b))
        ends = np.cumsum(n)
        begins = ends - n
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (v[1:] != v[:-1])
        run = np.cumsum(new) - 1
        length = np.bincount(run)
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, v, ok)]
        rest = [n, length[run[begins]], v[begins], length[run[ends - 1]], v[ends - 1]]
        yield pa.RecordBatch.from_arrays([b.column(k) for k in [*SERIES, "block"]] + lists + [pa.array(x) for x in rest], [c.split()[0] for c in PACKED.split(", ")])


def scan(v: np.ndarray, ok: np.ndarray, at: np.ndarray, level, sd, phi, last, gap, shock: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The robust filter over the blocks ``v[at[i]:at[i + 1]]``, all blocks a step at a time.

    A value is predicted from the last value that its own prediction held for, ``gap`` places back: ``phi ** gap`` times
    it, with the spread that an autoregression has after so many places. ``odd`` are the values off by more than
    ``shock`` of those spreads (and the impossible ones); they predict nothing. ``onward`` are odd values that go on from the odd
    value before them as the autoregression goes on from a shifted level: a level shift rather than single outliers. Returns
    ``odd``, ``onward``, and each block's last value and gap.
    """
    n, x = np.diff(at), v - np.repeat(level, np.diff(at))
    odd, onward = np.zeros(len(v), bool), np.zeros(len(v), bool)
    last, gap = last.copy(), gap.astype(float)
    order = np.argsort(-n, kind="stable")
    size, noise = n[order], sd * np.sqrt(np.maximum(1 - phi * phi, 0))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for i in range(int(size[0]) if len(size) else 0):
            rows = order[: np.searchsorted(-size, -i, side="left")]
            j = at[rows] + i
            known = ~np.isnan(last[rows])
            carry = np.where(known, np.power(phi[rows], gap[rows]), 0.0)
            spread = sd[rows] * np.sqrt(np.maximum(1 - carry * carry, 0.0))
            off = np.abs(x[j] - np.where(known, carry * np.nan_to_num(last[rows]), 0.0)) > shock * spread
            bad = off & (sd[rows] > 0)
            if i:
                shifted = bad & odd[j - 1] & (x[j] * x[j - 1] > 0) & (np.abs(x[j] - x[j - 1]) <= shock * np.maximum(noise[rows], sd[rows] * np.sqrt(np.maximum(1 - phi[rows], 0) * 2)))
                onward[j] = shifted
                onward[j - 1] |= shifted
            odd[j] = bad | ~ok[j]
            last[rows] = np.where(odd[j], last[rows], x[j])
            gap[rows] = np.where(odd[j], gap[rows] + 1, 1.0)
    return odd, onward, last, gap.astype(np.int64)


def _numbers(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(x).to_numpy(zero_copy_only=False).astype(float) for x in names]


def _marked(b: pa.RecordBatch, threshold: float, shock: float):
    at, flat = _lists(b.column("v"))
    v, ok = flat.to_numpy(), _lists(b.column("possible"))[1].to_numpy(zero_copy_only=False).astype(bool)
    level, sd, phi, last, gap = _numbers(b, "level", "sd", "phi", "last", "gap")
    odd, onward, last, gap = scan(v, ok, at, level, sd, phi, last - level, np.nan_to_num(gap, nan=1.0), shock)
    seg = np.repeat(np.arange(len(b)), np.diff(at))
    with np.errstate(invalid="ignore"):
        case = odd & (np.abs(v - level[seg]) > threshold * sd[seg]) & (sd[seg] > 0)
    return at, seg, v, ok, case, onward, last + level, gap


def _round(threshold: float, shock: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            at, seg, v, ok, case, _, last, gap = _marked(b, threshold, shock)
            keep, m = ok & ~case, len(b)
            centre = b.column("centre").to_numpy(zero_copy_only=False).astype(float)
            x = v - centre[seg]
            total = lambda w, on: np.bincount(seg[on], w[on], m)
            # neighbours that both count; a block's first value has its neighbour next door
            p, pair = np.concatenate([[0.0], x[:-1]]), keep.copy()
            pair[1:] &= keep[:-1]
            door, = _numbers(b, "last")
            p[at[:-1]] = door - centre
            pair[at[:-1]] = keep[at[:-1]] & ~np.isnan(door) & (np.nan_to_num(_numbers(b, "gap")[0], nan=0.0) == 1)
            one = np.ones(len(x))
            mix = (np.arange(len(v)) - at[:-1][seg] + 1) * 2654435761 % 4294967311
            marks = np.bincount(seg[case], mix[case].astype(float), m).astype(np.int64)
            sums = [total(one, keep).astype(np.int64), total(x, keep), total(x * x, keep), total(one, pair).astype(np.int64), total(x, pair), total(p, pair), total(x * p, pair), total(p * p, pair), last, gap, marks]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in [*SERIES, "block"]] + [pa.array(s, from_pandas=True) for s in sums], [c.split()[0] for c in STATE.split(", ")])

    return run


def _judge(threshold: float, shock: float, stuck_run: int, stuck_fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            at, seg, v, ok, case, onward, _, _ = _marked(b, threshold, shock)
            new = np.ones(len(v), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (v[1:] != v[:-1])
            run_id = np.cumsum(new) - 1
            length = np.bincount(run_id)
            for name, edge in (("head_total", at[:-1]), ("tail_total", at[1:] - 1)):
                length[run_id[edge]] = np.maximum(length[run_id[edge]], b.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
            may = np.isin(np.array(b.column("field_name").to_pylist()), stuck_fields)[seg]
            stuck = may & (length[run_id] >= stuck_run) & (v != 0)
            hit = np.nonzero(~ok | case | stuck)[0]
            reason = np.where(~ok, "impossible", np.where(case & onward, "shift", np.where(case, "spike", "stuck")))[hit]
            of = pa.array(seg[hit])
            ids = _lists(b.column("ids"))[1].take(pa.array(hit))
            columns = [b.column("table_name").take(of), ids, b.column("field_name").take(of), b.column("source").take(of), pa.array(v[hit]), pa.array(reason, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CASES.split(", ")])

    return run


def _runs(blocks: DataFrame) -> DataFrame:
    """The whole lengths of the runs of equal values that a block's first and last rows stand in, over block borders."""
    one = F.col("head_n") == F.col("n")
    edge = lambda i, k: F.struct(F.lit(i).alias("island"), F.col(f"{k}_n").alias("m"), F.col(f"{k}_v").alias("v"))
    edges = blocks.select(*SERIES, "block", F.explode(F.when(one, F.array(edge(1, "head"))).otherwise(F.array(edge(1, "head"), edge(2, "tail")))).alias("x")).select(*SERIES, "block", "x.*")
    along = Window.partitionBy(*SERIES).orderBy("block", "island")
    goes_on = (F.lag("block").over(along) != F.col("block")) & (F.lag("v").over(along) == F.col("v")) & (F.col("island") == 1)
    edges = edges.withColumn("chain", F.sum(F.coalesce((~goes_on).cast("int"), F.lit(1))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("total", F.sum("m").over(Window.partitionBy(*SERIES, "chain")))
    return edges.groupBy(*SERIES, "block").agg(F.min_by("total", "island").alias("head_total"), F.max_by("total", "island").alias("tail_total"))


def _fitted(states: DataFrame, start: DataFrame) -> DataFrame:
    """Each series' level, spread and autoregression from the sums of its blocks, and what a block takes from the ones before it."""
    total = states.groupBy(*SERIES).agg(*[F.sum(k).alias(k) for k in ("n", "s", "q", "k", "a", "f", "c", "e")])
    mean = F.try_divide(F.col("s"), F.col("n"))
    var = F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0)) * F.try_divide(F.col("n"), F.col("n") - 1)
    phi = F.least(F.greatest(F.coalesce(F.try_divide(F.col("c") - mean * (F.col("a") + F.col("f")) + F.col("k") * mean * mean, F.col("e") - 2 * mean * F.col("f") + F.col("k") * mean * mean), F.lit(0.0)), F.lit(0.0)), F.lit(0.99))
    total = total.join(start.select(*SERIES, "centre"), SERIES).select(*SERIES, "centre", mean.alias("mean"), F.sqrt(var).alias("sd"), phi.alias("phi"))
    total = total.withColumn("level", F.col("centre") + F.col("mean")).drop("mean")
    before = Window.partitionBy(*SERIES).orderBy("block")
    carry = states.select(*SERIES, "block", F.lag("last").over(before).alias("last"), F.lag("gap").over(before).alias("gap"))
    return carry.join(total, SERIES)


def implausible(series: DataFrame, limits: Column, stuck_fields: list[str], stuck_run: int = 5, threshold: float = 8.0, shock: float = 3.5, most: int = 12) -> DataFrame:
    """The values of long series that can't be, that stand out, or that are stuck, with the reason.

    ``series`` has ``table_name, row_id, source, field_name, at, value, block`` (``block`` must not decrease along
    ``at``); ``limits`` is true for a physically possible value. Null and not-a-number values are no cases and do not
    break a run; repeated rows count once; rows without ``at`` come first in their block. A null source is one source.

    Outliers: a first-order autoregression is fitted to each series and filtered through it (``scan``): a value is odd if it lies more
    than ``shock`` innovation spreads from what the last value that wasn't odd predicts. Odd values of half the threshold or
    more from the level are left out of the next fit, until none changes. Additive outliers and level shifts, of any length,
    are thus left out whole, as an odd value never predicts. Then the exact check of size: the cases are the odd values more
    than ``threshold`` spreads from the level of all values that aren't cases, again until none changes. They are ``shift``
    where the series goes on from the shifted level, else ``spike``. A slow drift that the autoregression explains is
    no case. The first fit is by quantiles, so large errors can't hide others. A series without spread has no outliers.

    Series are packed once into blocks, one row each; rounds read the packed values and shuffle only sums a block, and a
    block starts from the state its predecessor had in the round before, so no series is bound to a task and blocks do not
    show in the result. A round is a table in the shared folder.
    """
    clean = F.nanvl(F.col("value").cast("double"), F.lit(None))
    rows = series.select("table_name", F.coalesce("source", F.lit("")).alias("source"), "field_name", "block", F.col("at").cast("double").alias("at"), F.col("row_id").cast("bigint").alias("row_id"), clean.alias("value"), F.coalesce(limits, F.lit(False)).alias("possible"))
    rows = rows.where("value is not null and row_id is not null")
    packed = cut(rows.groupBy(*SERIES, F.coalesce(F.col("block").cast("bigint"), F.lit(0)).alias("block")).agg(F.collect_list(F.struct("at", "row_id", "value", "possible")).alias("r")).mapInArrow(_pack, PACKED))
    each = packed.select(*SERIES, F.explode(F.arrays_zip("v", "possible")).alias("x")).where("x.possible")
    q = F.percentile_approx("x.v", F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)), F.lit(500))
    scale = F.greatest((F.col("q")[4] - F.col("q")[0]) / 3.29, (F.col("q")[3] - F.col("q")[1]) / 1.349)
    start = packed.select(*SERIES).distinct().join(each.groupBy(*SERIES).agg(q.alias("q")), SERIES, "left").select(*SERIES, F.coalesce(F.col("q")[2], F.lit(0.0)).alias("centre"), scale.alias("scale"))
    start = cut(start)
    none = F.lit(None)
    fit = packed.select(*SERIES, "block", none.cast("double").alias("last"), none.cast("bigint").alias("gap")).join(
        start.select(*SERIES, "centre", (3 * F.col("scale")).alias("sd"), F.lit(0.0).alias("phi"), F.col("centre").alias("level")), SERIES
    )
    values, key, seen = packed.select(*SERIES, "block", "v", "possible"), [*SERIES, "block"], None
    for level in (threshold / 2, threshold):
        for _ in range(most):
            states = cut(values.join(fit, key).mapInArrow(_round(level, shock), STATE))
            marks = tuple(states.agg(F.sum("marks"), F.sum("gap"), F.count("last")).first())
            fit = _fitted(states, start)
            if (level, marks) == seen:
                break
            seen = (level, marks)
    judged = packed.join(fit, key).join(_runs(packed.select(*key, "n", "head_n", "head_v", "tail_n", "tail_v")), key)
    return judged.mapInArrow(_judge(threshold, shock, stuck_run, stuck_fields), CASES)
