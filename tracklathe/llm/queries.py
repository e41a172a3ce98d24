"""Queries p1 and p6 to p9 over the shared tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.llm import mixing, nearest_time, splits
from tracklathe.llm.residue import message_classes, residue
from tracklathe.llm.tokens import ByteBpe, decoded, encoded
from tracklathe.session import cut, fixed_list, table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every stem that is related to another, with its group."""
    return splits.found(table(spark, sf, "sequences"), table(spark, sf, "stem_windows"))


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    recordings, windows = table(spark, sf, "sequences"), table(spark, sf, "stem_windows")
    groups = cut(splits.groups(recordings, windows))
    family = splits.family_of(splits.stem_of(F.col("name")))
    counts = windows.dropDuplicates(["window_id"]).groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))
    weights = groups.join(counts, "family", "left").groupBy("group_stem").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("weight"))
    targets = sorted(((r.split, r.share) for r in fixed_list(table(spark, sf, "split_targets"))), key=lambda x: (-x[1], x[0]))
    return groups, splits.assign(weights, targets)


@query
def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split of each recording and each window; related ones never part."""
    groups, assigned = _assigned(spark, sf)
    of_family = groups.join(assigned, "group_stem").select("family", "group_stem", F.col("split").alias("new_split"))
    stem = splits.stem_of(F.col("name"))
    records = table(spark, sf, "sequences").select(F.lit("recording").alias("record_kind"), F.col("seq_id").alias("record_id"), stem.alias("stem")).distinct()
    windows = table(spark, sf, "stem_windows").select(F.lit("window").alias("record_kind"), F.col("window_id").alias("record_id"), stem.alias("stem")).distinct()
    both = records.unionByName(windows).withColumn("family", splits.family_of(F.col("stem")))
    return both.join(of_family, "family", "left").select("record_kind", "record_id", "stem", "group_stem", F.col("new_split").alias("split"))


@query
def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the splits reached, in windows."""
    _, assigned = _assigned(spark, sf)
    by = assigned.groupBy("split").agg(F.sum("weight").alias("n_windows"), F.count(F.lit(1)).alias("n_groups"))
    return table(spark, sf, "split_targets").join(by, "split", "left").select("split", "share", "n_windows", "n_groups")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_time.pairs(spark, f"{sf}/raw_imu.parquet", f"{sf}/vehicle_track.parquet", table(spark, sf, "sequences").select(F.col("name").alias("sequence"), "anchor_event_ns", "anchor_tod_s"))


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Track rows with their accelerometer row, accelerometer rows with their gyroscope row."""
    found = _pairs(spark, sf).where("right_id is not null")
    inertial = F.col("pair_kind") == "accel_gyro"
    a, b = F.col("left_id"), F.col("right_id")
    return found.select("pair_kind", F.when(inertial, F.least(a, b)).otherwise(a).alias("left_id"), F.when(inertial, F.greatest(a, b)).otherwise(b).alias("right_id")).distinct()


@query
def p6_unpaired(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and unpaired rows of each recording and kind, beside what the app reported."""
    by = _pairs(spark, sf).groupBy("pair_kind", F.col("entity").alias("sequence")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("right_id").isNull()).alias("n_unpaired"))
    told = table(spark, sf, "sequences").groupBy(F.col("name").alias("sequence")).agg(F.max("n_unpaired").alias("n_reported"))
    return by.join(told, "sequence", "left").select("pair_kind", "sequence", "n_rows", "n_unpaired", "n_reported")


@query
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as its list of token ids."""
    return encoded(table(spark, sf, "documents"), ByteBpe(spark))


@query
def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts read back from their ids, with whether they are the same."""
    bpe = ByteBpe(spark)
    ids = encoded(table(spark, sf, "documents"), bpe)
    back = decoded(ids, bpe, name="back").select("doc_id", F.size("ids").alias("n_tokens"), "back")
    texts = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return back.join(texts, "doc_id").select("doc_id", "n_tokens", (F.col("back") == F.col("text")).alias("same"))


def _mix(spark: SparkSession, sf: str, passes: float | None = None) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    sizes = encoded(docs, ByteBpe(spark)).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))
    sized = cut(docs.select("doc_id", "source").join(sizes, "doc_id"))
    wanted = None if passes is None else int(passes * (sized.dropDuplicates(["doc_id"]).agg(F.sum("n_tokens")).first()[0] or 0))
    return mixing.mixed(sized, table(spark, sf, "mix_targets"), total_tokens=wanted)


@query
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return _mix(spark, sf)[0]


@query
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of tokens that each source reached."""
    return _mix(spark, sf)[1]


@query
def p8_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of a mix of as many tokens as the corpus has, where small sources reach their cap."""
    return _mix(spark, sf, 1.0)[1].withColumn("short_tokens", F.round(F.col("target_share") * F.col("mix_tokens")).cast("bigint") - F.col("tokens"))


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are residue instead of drive notes."""
    return residue(table(spark, sf, "documents")).select("doc_id")


@query
def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without residue."""
    docs = table(spark, sf, "documents")
    return docs.join(residue(docs).select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")


@query
def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Recurring masked texts with their spread over sources."""
    return message_classes(table(spark, sf, "documents"))


_STEMS = r"""
with recursive names as (select name from sequences union select name from stem_windows),
stem as (select distinct regexp_replace(regexp_replace(lower(trim(name)), '^[sv][-_]', ''), '\.csv$', '') s from names where name is not null),
fam as (select s, regexp_replace(s, '^(.+)[a-z]$', '\1') f from stem where s <> ''),
hub as (select distinct regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^[sv][-_]', ''), '\.csv$', ''), '^(.+)[a-z]$', '\1') f,
  unnest([case when regexp_extract(driver, '[0-9]+') <> '' then 'd:' || cast(cast(regexp_extract(driver, '[0-9]+') as bigint) as varchar) end,
          case when trim(content_sha) <> '' then 'h:' || lower(trim(content_sha)) end]) h from sequences),
edge as (select a.f a, b.f b from (select * from hub where h is not null) a join (select h, min(f) f from hub where h is not null group by h) b on a.h = b.h where a.f <> b.f),
bi as (select a, b from edge union select b, a from edge),
reach as (select f a, f b from (select distinct f from fam) union select r.a, e.b from reach r join bi e on r.b = e.a),
comp as (select a f, min(b) c from reach group by a)
"""
SQL["p1_found"] = _STEMS + """, g as (select s, c from fam join comp using (f)), n as (select c, min(s) m, count(*) k from g group by c)
select m as group_stem, s as stem from g join n using (c) where k > 1"""
SQL["p6_found"] = """
with a as (select distinct raw_id, sequence, event_ns from raw_imu where stream = 'accelerometer_uncalibrated' and v0 is not null and v1 is not null and v2 is not null),
g as (select distinct raw_id, sequence, event_ns from raw_imu where stream = 'gyroscope_uncalibrated' and v0 is not null and v1 is not null and v2 is not null),
q as (select name, max(anchor_event_ns) e, max(anchor_tod_s) s from sequences group by name),
t as (select distinct truth_id, sequence, cast(round(t_s * 1e9) as bigint) % 86400000000000 t from vehicle_track where t_s is not null),
ad as (select a.raw_id, a.sequence, (cast(round(q.s * 1e9) as bigint) + a.event_ns - q.e + 864000000000000000) % 86400000000000 t, a.event_ns from a join q on a.sequence = q.name where q.e is not null and q.s is not null),
c as (select truth_id, raw_id, event_ns, least(abs(t.t - ad.t), 86400000000000 - abs(t.t - ad.t)) d from t join ad using (sequence)
  where least(abs(t.t - ad.t), 86400000000000 - abs(t.t - ad.t)) <= 50000000),
c1 as (select truth_id, raw_id, row_number() over (partition by truth_id order by d, event_ns, raw_id) r from c),
m as (select a.raw_id ai, g.raw_id gi, abs(a.event_ns - g.event_ns) d, g.event_ns e from a join g on a.sequence = g.sequence and g.event_ns between a.event_ns - 4000000 and a.event_ns + 4000000),
m1 as (select ai, gi, row_number() over (partition by ai order by d, e, gi) r from m)
select 'truth_accel' as pair_kind, truth_id as left_id, raw_id as right_id from c1 where r = 1
union all select 'accel_gyro', least(ai, gi), greatest(ai, gi) from m1 where r = 1"""
