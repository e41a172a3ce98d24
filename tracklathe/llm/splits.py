"""Splits that keep related records together: components by random-mate contraction, split by cumulative weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklathe.session import cut

BUCKETS = 256


def stem_of(name: Column) -> Column:
    """A recording's stem: trimmed, lower case, without a leading s-, s_, v-, v_ and a trailing .csv."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^[sv][-_]", ""), r"\.csv$", "")


def family_of(stem: Column) -> Column:
    """The stem less its last character if that is a letter and not all of it."""
    return F.regexp_replace(stem, r"^(.+)\p{L}$", "$1")


def contract(edges: DataFrame, seed: int = 7, most_rounds: int = 200) -> DataFrame:
    """(``v``, ``label``) for every vertex of the edge list (``u``, ``v``); one label for each connected component.

    Each round every vertex tosses a coin, heavier to heads the more neighbours it has. A tails vertex next to heads
    collapses into the first of them; edges move to the vertices left, and loops and repeats vanish. Rounds end when no
    edge is left. The collapses are then unwound from the last round to the first. Rounds are cut by written tables,
    so a lost executor costs no earlier round. Loops and null ends are ignored; vertices without an edge have no row.
    """
    both = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    live = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    collapses: list[DataFrame] = []
    while not live.isEmpty():
        if len(collapses) >= most_rounds:
            raise RuntimeError("the contraction doesn't end")
        degree = live.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
        toss = F.pmod(F.xxhash64(F.lit(seed + len(collapses)), F.col("u")), F.lit(1 << 20)) / float(1 << 20)
        coins = degree.select("u", (toss < F.col("d") / (F.col("d") + 2)).alias("heads"))
        heads = coins.where("heads").select(F.col("u").alias("v"))
        mates = live.join(heads, "v", "left_semi").groupBy("u").agg(F.min("v").alias("p"))
        mates = cut(mates.join(coins.where("not heads").select("u"), "u"))
        a = mates.select(F.col("u"), F.col("p").alias("pu"))
        b = mates.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = live.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        live = cut(moved.where("u <> v").distinct())
        collapses.append(mates)
    ends = None
    for mates in reversed(collapses):
        if ends is None:
            ends = mates.select(F.col("u").alias("v"), F.col("p").alias("label"))
        else:
            # a label table stands twice in the next one, so each is cut, else the plan doubles every round
            up = mates.join(ends.select(F.col("v").alias("p"), "label"), "p", "left").select(F.col("u").alias("v"), F.coalesce("label", "p").alias("label"))
            ends = cut(up.union(ends))
    if ends is None:
        return both.select(F.col("u").alias("v"), F.col("v").alias("label"))
    roots = ends.select(F.col("label").alias("v"), "label").distinct()
    return ends.union(roots)


def groups(recordings: DataFrame, names: DataFrame) -> DataFrame:
    """(``family``, ``group_stem``, ``n_stems``) for every family of stems; related families share ``group_stem``.

    ``recordings`` has ``name, driver, content_sha``, ``names`` further names. Related: one family, the same number in the
    driver code, or the same checksum (any case); through others as well. Null and blank names are no stems; null codes
    relate nothing. ``group_stem`` is the group's first stem in code-point order.
    """
    stems = recordings.select("name").union(names.select("name")).select(stem_of(F.col("name")).alias("stem")).where("stem <> ''").distinct()
    families = stems.groupBy(family_of(F.col("stem")).alias("family")).agg(F.min("stem").alias("first"), F.count(F.lit(1)).alias("n"))
    own = recordings.select(family_of(stem_of(F.col("name"))).alias("family"), "driver", "content_sha").where("family <> ''")
    number = F.regexp_replace(F.regexp_extract("driver", r"(\d+)", 1), r"^0+(?=\d)", "")
    hub = F.array_compact(F.array(
        F.when(number != "", F.concat(F.lit("d:"), number)),
        F.when(F.trim("content_sha") != "", F.concat(F.lit("h:"), F.lower(F.trim("content_sha")))),
    ))
    edges = own.select(F.concat(F.lit("f:"), F.col("family")).alias("u"), F.explode(hub).alias("v")).distinct()
    labels = contract(edges).where(F.col("v").startswith("f:")).select(F.substring("v", 3, 1 << 30).alias("family"), "label")
    placed = families.join(labels, "family", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("f:"), F.col("family"))))
    placed = cut(placed)
    whole = placed.groupBy("label").agg(F.min("first").alias("group_stem"), F.sum("n").alias("n_stems"))
    return placed.join(whole, "label").select("family", "group_stem", "n_stems")


def found(recordings: DataFrame, names: DataFrame) -> DataFrame:
    """Every stem that stands in a group of two or more, with the group's first stem."""
    related = groups(recordings, names).where("n_stems > 1")
    stems = recordings.select("name").union(names.select("name")).select(stem_of(F.col("name")).alias("stem")).where("stem <> ''").distinct()
    return stems.withColumn("family", family_of(F.col("stem"))).join(related, "family").select("group_stem", "stem")


def assign(weights: DataFrame, targets: list[tuple[str, float]], seed: int = 7) -> DataFrame:
    """(``group_stem``, ``weight``, ``split``) for (``group_stem``, ``weight``): whole groups, shares by cumulative weight.

    Groups go heaviest first; each falls into the split whose share of the total the weight before it has reached, so a
    split's share is off by less than one group, and the borders lie among small groups. Groups without weight are spread
    by hash in the targets' proportions. The order's prefix sums are taken in two levels: by (power of two of the
    weight, hash bucket), then inside a bucket.
    """
    h = F.xxhash64(F.lit(seed), F.col("group_stem"))
    rows = weights.withColumn("_bucket", F.floor(-F.log2(F.greatest(F.col("weight"), F.lit(1)))) * BUCKETS + F.pmod(h, F.lit(BUCKETS)))
    sums = rows.groupBy("_bucket").agg(F.sum("weight").alias("w"))  # at most 64 * BUCKETS rows
    before = sums.select("_bucket", (F.sum("w").over(Window.orderBy("_bucket")) - F.col("w")).alias("_before"), F.sum("w").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_bucket").orderBy(F.desc("weight"), "group_stem").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(before), "_bucket").withColumn("_at", F.col("_before") + F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("group_stem")), F.lit(1 << 20)) / float(1 << 20)
    at = F.when(F.col("weight") > 0, F.try_divide(F.col("_at"), F.col("_total"))).otherwise(spread)
    total, split, upto = sum(s for _, s in targets), F.lit(targets[-1][0]), 0.0
    edges = []
    for name, share in targets:
        upto += share / total
        edges.append((name, upto))
    for name, edge in reversed(edges[:-1]):
        split = F.when(at < edge - 1e-12, name).otherwise(split)
    return rows.select("group_stem", "weight", split.alias("split"))
