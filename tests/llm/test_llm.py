"""Splits, nearest time, token ids, mixing and residue on small fixtures, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import SMALL, connect, rows_of

from tracklathe.llm import mixing, nearest_time, splits
from tracklathe.llm.queries import QUERIES, SQL
from tracklathe.llm.residue import message_classes, residue
from tracklathe.llm.tokens import ByteBpe, decoded, encoded, ranks


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_statement(spark, name):
    df, want = QUERIES[name](spark, SMALL), connect().execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


# Splits ---------------------------------------------------------------------------------------------------------------
def _components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    out = defaultdict(set)
    for x in list(parent):
        out[root(x)].add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("seed", range(2))
def test_contraction_finds_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"hub{i % 2}", f"leaf{i}") for i in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    edges += [("same", "same")]
    df = spark.createDataFrame(edges + edges[:9] + [(None, "x"), ("y", None)], "u string, v string")
    got = defaultdict(set)
    for r in splits.contract(df, seed).collect():
        got[r.label].add(r.v)
    assert {frozenset(v) for v in got.values()} == {c for c in _components([e for e in edges if e[0] != e[1]])}
    assert splits.contract(spark.createDataFrame([], "u string, v string")).count() == 0


def test_found_groups(spark):
    recordings = spark.createDataFrame([("S-Ab1a", "DR-7", None), (" v_ab1B.csv ", None, "FF"), ("S-Cd2", "dr-0000007", "ff"), ("S-Ee3", None, " "), ("S-Ff4", "Dr 8", "x"), ("S-Gg5", None, "X"), (None, "DR-7", "z"), ("", "DR-8", "z"), ("S-Cd2", "dr-0000007", "ff")], "name string, driver string, content_sha string")
    windows = spark.createDataFrame([("EE3b",), ("zz9",), (None,), ("s-AB1c.csv",)], "name string")
    got = {(r.group_stem, r.stem) for r in splits.found(recordings, windows).collect()}
    assert got == {("ab1a", s) for s in ("ab1a", "ab1b", "ab1c", "cd2")} | {("ee3", "ee3"), ("ee3", "ee3b"), ("ff4", "ff4"), ("ff4", "gg5")}
    nothing = spark.createDataFrame([], "name string, driver string, content_sha string")
    assert splits.found(nothing, spark.createDataFrame([], "name string")).count() == 0


def test_shares(spark):
    rng = random.Random(3)
    rows = [(f"g{i}", rng.choice([0, 1, 2, 3, 900 if i < 2 else 4])) for i in range(3000)]
    out = splits.assign(spark.createDataFrame(rows, "group_stem string, weight long"), [("train", 0.7), ("test", 0.15), ("val", 0.15)]).collect()
    total, by = sum(w for _, w in rows), defaultdict(int)
    for r in out:
        by[r.split] += r.weight
    assert len(out) == 3000 and by["train"] / total == pytest.approx(0.7, abs=0.01) and by["val"] / total == pytest.approx(0.15, abs=0.01)
    light = [r.split for r in out if r.weight == 0]
    assert 0.6 < light.count("train") / len(light) < 0.8


# Nearest time ---------------------------------------------------------------------------------------------------------
def test_nearest_kernel():
    rng = np.random.default_rng(0)
    for _ in range(30):
        left = np.column_stack([np.arange(40), rng.integers(0, 200, 40)])
        right = np.column_stack([rng.permutation(60) + 100, rng.integers(0, 200, 60)])
        ids, far = nearest_time.nearest(left, right, 3)
        for (_, t), i, d in zip(left, ids, far):
            best = min((abs(t - u), u, r) for r, u in right)
            assert (i, d) == (best[2], best[0]) if best[0] <= 3 else d == -1
    assert nearest_time.nearest(left, np.zeros((0, 2), np.int64), 3)[1].tolist() == [-1] * 40


RAW = "raw_id long, sequence string, stream string, event_ns long, arrival_ns long, accuracy long, v0 double, v1 double, v2 double, v3 double, bucket long"


def test_pairs(spark, tmp_path):
    minute, a, g = nearest_time.BUCKET, "accelerometer_uncalibrated", "gyroscope_uncalibrated"
    raw = [(i, "s", a, i * 8_000_000 + minute - 80_000_000, 0, 1, 1.0, 1.0, 1.0, None, 7) for i in range(1, 30)]
    raw += [(100 + i, "s", g, t, 0, 1, 1.0, 1.0, 1.0, None, 7) for i, (_, _, _, t, *_) in enumerate(raw[::2]) for t in [t + 4_000_000]]
    raw += [raw[3], (900, "s", g, raw[5][3], 0, 1, None, 1.0, 1.0, None, 7), (901, None, g, 5, 0, 1, 1.0, 1.0, 1.0, None, 7), (902, "t", a, None, 0, 1, 1.0, 1.0, 1.0, None, 7)]
    track = [(1, "s", 86399.99, 1.0, 1.0), (2, "s", 86400.02, None, None), (3, "s", 500.0, 1.0, 1.0), (4, "u", 1.0, 1.0, 1.0), (5, None, 1.0, 1.0, 1.0), (6, "s", None, 1.0, 1.0), (2, "s", 86400.02, None, None)]
    spark.createDataFrame(raw, RAW).write.parquet(str(tmp_path / "raw"))
    spark.createDataFrame(track, "truth_id long, sequence string, t_s double, lat double, lon double").coalesce(1).write.parquet(str(tmp_path / "track"))
    anchors = spark.createDataFrame([("s", minute, 86399.98), ("s", minute, 86399.98), ("u", None, None)], "sequence string, anchor_event_ns long, anchor_tod_s double")
    got = {(r.pair_kind, r.left_id): (r.right_id, r.distance_ns) for r in nearest_time.pairs(spark, str(tmp_path / "raw"), str(tmp_path / "track"), anchors).collect()}
    accel = {i: t for i, s, k, t, *_ in raw if k == a and s == "s"}
    gyro = {i: t for i, s, k, t, _, _, v0, *_ in raw if k == g and s == "s" and v0 is not None}
    for i, t in accel.items():
        d, u, r = min((abs(t - u), u, r) for r, u in gyro.items())
        assert got["accel_gyro", i] == ((r, d) if d <= 4_000_000 else (None, None))
    for i, tod in ((1, 86399.99), (2, 86400.02)):
        d, u, r = min((abs(round((tod - 86399.98) * 1e9) + minute - u), u, r) for r, u in accel.items())
        assert got["truth_accel", i][0] == r
    assert got["truth_accel", 3] == (None, None) and ("truth_accel", 4) not in got and ("truth_accel", 6) not in got
    assert len(got) == len(accel) + 3
    spark.createDataFrame([], RAW).write.parquet(str(tmp_path / "none"))
    assert nearest_time.pairs(spark, str(tmp_path / "none"), str(tmp_path / "track"), anchors.where("false")).count() == 0


def test_pairs_in_many_batches(spark, tmp_path):
    """The sides of a pair in different micro-batches, in any order of files, with a bucket unmentioned in between."""
    a, g, rng = "accelerometer_uncalibrated", "gyroscope_uncalibrated", random.Random(5)
    raw = [(i, f"s{i % 2}", a if i % 3 else g, rng.randrange(2 * nearest_time.BUCKET), 0, 1, 1.0, 1.0, 1.0, None, 7) for i in range(900)]
    near = [(2000 + i, s, g, t + rng.randrange(-6_000_000, 6_000_000), 0, 1, 1.0, 1.0, 1.0, None, 7) for i, (_, s, _, t, *_) in enumerate(raw[:400])]
    parts = [raw[:300], [(9000, "other", a, 5, 0, 1, 1.0, 1.0, 1.0, None, 7)], near, raw[300:] + raw[:50]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))
    spark.createDataFrame([x for p in parts for x in p], RAW).coalesce(1).write.parquet(str(tmp_path / "one"))
    track = [(i, "s0", rng.randrange(2 * nearest_time.BUCKET) / 1e9, 1.0, 1.0) for i in range(300)]
    spark.createDataFrame(track, "truth_id long, sequence string, t_s double, lat double, lon double").repartition(3).write.parquet(str(tmp_path / "track"))
    anchors = spark.createDataFrame([("s0", 0, 0.0)], "sequence string, anchor_event_ns long, anchor_tod_s double")
    run = lambda name, **o: sorted(map(tuple, nearest_time.pairs(spark, str(tmp_path / name), str(tmp_path / "track"), anchors, **o).collect()), key=str)
    whole = run("one")
    assert run("many", a_batch={"maxFilesPerTrigger": "1"}) == whole
    assert sum(r[3] is not None for r in whole) > 100 and len(whole) == sum(r[2] == a for r in raw) + 1 + 300
    late = run("many", a_batch={"maxFilesPerTrigger": "1"}, lateness=1 << 60)
    assert late == whole and spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") == spark.newSession().conf.get("spark.sql.streaming.stateStore.providerClass", "")


# Tokens ---------------------------------------------------------------------------------------------------------------
TEXTS = [
    None, "", " ", "Hello world's 123 tests!!  \n\n\tindented", "naïve café 雨の日は雑音が　机上の約10.38倍", "अगली बार यही रास्ता", "🙂🙂 👩‍👩‍👧 x y z\u0085w", "a" * 700 + " " * 300 + "=" * 200, "I'll we've you're it's 'S 'LL don't''t",
    "\x00\x01\x1c\x1f​﻿", "$\\tau^{-1/2}$ {{stem}} <b>x</b>\r\nend ", "Hello world's 123 tests!!  \n\n\tindented", "퟿ ½ ² Ⅷ ٣",
]


@pytest.mark.parametrize("dictionary", [1 << 17, 3])
def test_ids_and_round_trip(spark, dictionary):
    import public_tokenizers
    import tiktoken

    bpe = ByteBpe(spark)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(bpe.path), special_tokens={})
    rows = [(i, t, 1, "c") for i, t in enumerate(TEXTS)]
    table = spark.createDataFrame(rows + rows[3:5] + [(None, "null id", 1, "c")], "doc_id long, text string, ids int, _c string")
    ids = encoded(table, bpe, dictionary=dictionary)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(TEXTS)} | {None: own.encode_ordinary("null id")}
    assert ids.count() == len(TEXTS) + 3
    assert {r.doc_id: r.text for r in decoded(ids, bpe).collect() if r.doc_id is not None} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encoded(spark.createDataFrame([], "doc_id long, text string"), bpe).count() == 0


# Mixing ---------------------------------------------------------------------------------------------------------------
def test_subset_reaches_the_budget():
    rng = random.Random(0)
    for _ in range(40):
        lengths = {n: rng.randint(1, 4) for n in rng.sample(range(2, 40), 6)}
        reach = {0}
        for n, c in lengths.items():
            reach = {r + n * k for r in reach for k in range(c + 1)}
        budget = rng.randint(0, 300)
        take = mixing.subset(lengths, budget)
        assert all(0 <= take[n] <= lengths[n] for n in lengths)
        assert sum(n * k for n, k in take.items()) == max(r for r in reach if r <= budget)
    big = {n: 1000 for n in range(50, 400)}
    assert sum(n * k for n, k in mixing.subset(big, 20_000_001).items()) == 20_000_001


@pytest.mark.parametrize("lengths, budget, best", [({30000: 5, 50000: 5}, 100000, 100000), ({20000: 10, 33000: 10}, 99000, 99000), ({17000: 40, 23000: 40}, 230000, 230000), ({59_999: 9, 60_000: 9}, 539_990, 480_000), ({2: 3}, 5, 4), ({}, 5, 0)])
def test_subset_of_long_lengths(lengths, budget, best):
    take = mixing.subset(lengths, budget)
    assert sum(n * k for n, k in take.items()) == best and all(0 <= k <= lengths[n] for n, k in take.items())


def test_subset_of_few_long_lengths_is_exact():
    rng = random.Random(4)
    for _ in range(30):
        lengths = {rng.randint(15_000, 60_000): rng.randint(1, 4) for _ in range(4)}
        reach = {0}
        for n, c in lengths.items():
            reach = {r + n * k for r in reach for k in range(c + 1)}
        budget = rng.randint(0, 400_000)
        assert sum(n * k for n, k in mixing.subset(lengths, budget).items()) == max(r for r in reach if r <= budget)


@pytest.mark.parametrize("budget", [2_000, 20_000, 200_000])
def test_subset_keeps_the_proportions(budget):
    """Small budgets are no more filled with the longest documents than large ones, also beside texts longer than the budget."""
    rng = random.Random(5)
    lengths = {}
    for _ in range(4000):
        n = max(5, int(rng.lognormvariate(4.6, 0.8)))
        lengths[n] = lengths.get(n, 0) + 1
    lengths |= {30_000: 2, 60_000: 1}
    take = mixing.subset(lengths, budget)
    assert sum(n * k for n, k in take.items()) == budget and all(0 <= k <= lengths[n] for n, k in take.items())
    usual = sum(n * c for n, c in lengths.items() if n <= budget) / sum(c for n, c in lengths.items() if n <= budget)
    assert 0.75 * usual < budget / sum(take.values()) < 1.25 * usual


def test_mix_with_a_binding_cap(spark):
    rows = [(i, "big", 10 + i % 90) for i in range(2000)] + [(3000 + i, "small", 7) for i in range(50)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats long")
    drawn, report = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), targets, total_tokens=20_000)
    told = {r.source: r for r in report.collect()}
    assert told["small"].tokens == 700 and told["small"].most_copies == 2 and told["big"].tokens == 10_000
    assert told["small"].actual_share == pytest.approx(700 / 10_700) and {r.copies for r in drawn.where("source = 'small'").collect()} == {2}


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Big_one", " big-one ", "BIG ONE"]), rng.randint(5, 300), 1) for i in range(4000)] + [(5000 + i, "small", rng.randint(5, 30), 1) for i in range(40)] + [(6000, None, 5, 1), (6001, "other", 5, 1), (6002, "small", 0, 1), (None, "small", 9, 1)]
    targets = spark.createDataFrame([("big-one", 0.9, 1), ("small", 0.1, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats long")
    drawn, report = mixing.mixed(spark.createDataFrame(rows + rows[:50], "doc_id long, source string, n_tokens long, copies int"), targets)
    drawn, report = drawn.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in drawn}) == len(drawn) and {r.source for r in drawn} == {"big-one", "small"}
    assert all(r.copies <= (1 if r.source == "big-one" else 3) for r in drawn)
    assert report["small"].actual_share == pytest.approx(0.1, abs=1e-4) and report["big-one"].actual_share == pytest.approx(0.9, abs=1e-4) and report["none"].tokens == 0
    again, _ = mixing.mixed(spark.createDataFrame(list(reversed(rows)), "doc_id long, source string, n_tokens long, copies int"), targets)
    assert {(r.doc_id, r.copies) for r in again.collect()} == {(r.doc_id, r.copies) for r in drawn}
    none, told = mixing.mixed(spark.createDataFrame([], "doc_id long, source string, n_tokens long"), targets)
    assert none.count() == 0 and told.count() == 3


# Residue --------------------------------------------------------------------------------------------------------------
RESIDUE = [
    "Recorded by {{ operator }} on Monday, weather dry.", "Drift for ${DATE} at 290 seconds was 4 percent.", "Route: %s to XX.X", "Dear [first name], thank you.", "Operator <last_fix> mounted it.", "Title: ____", "Recorded by <REPORT.TITLE GOES HERE> on x.",
    "Bericht für [city einsetzen], gefahren.", "Informe de [pon aquí route], hoy.", "Rapport de [à compléter : stem], fin.", "Run #{value}; see the list.", "The drive on @@city@@ ended at (fill in driver_name).", "Was $tunnel_name$ percent at %(city)s and %unit%.", "Between «start_time» and {0} it was quiet.", "By __FIRST_NAME__ on {% DATE %}.",
    "404 Not Found", "<html><head><title>Accès refusé.</title></head><body><h1>Accès refusé.</h1><p>Request id cf721df03a</p></body></html>", "Bench check 12\n\nService temporarily unavailable (503)\n\nnginx-like gateway / node 3", "Strange new failure of ours.\n\nHome | Drives | Maps | Sign in",
    "Please enable JavaScript to view this page.", "<noscript>Bitte aktivieren Sie JavaScript, um fortzufahren.</noscript>", "# Notes on Ab12c\nJavaScriptを有効にしてください。", "Text goes here. Text goes here.", "Lorem ipsum, la nare nacon re, venissec magex ut.", "test test test Content coming soon.",
]
SOUND = [
    None, "", " \n ", "The report generator fills `{{stem}}` and `{{length_s}}` from the run; leave both.", "Write the output name as `${session}_raw_imu.csv`, the exporter replaces the part in braces.", "Our parser treats <stem> in the help text as an argument name, the same way it treats <length>.",
    "Percent signs such as %d and %s in the formatter are correct.", "```kotlin\nval label = \"${session}_${index}.csv\"\n```\nIt ran.", "- [x] mount checked\n- [ ] sidecar uploaded", "See [3] and [12] for the two runs.", '{"stem": "Ab1", "length_s": 329}', "<b>Ab1</b> and <i>Nota</i> share a road.", "The gate is 8% reliable on the desk and about 13% late.",
    "Slope is $\\tau^{-1/2}$ over $\\tau < 10$ s.", '"Page not found" is what the wiki said when the note was renamed; the new link is in the index now.', "Access denied messages from the lab door 27 times this week; the badge reader is at fault.", "The replay page needs JavaScript, and on the old tablet it was switched off, which cost us 21 minutes.",
    'The form used to print "lorem" in the comment box of new sheets.', "Le message « accès refusé » venait du lecteur de badge.", "Try it again later, the road was closed.", "________________________________________\nBench check 4\nAll good.",
]


def test_residue_cases(spark):
    texts = RESIDUE + SOUND
    rows = [(i, t, "src", 1, "c") for i, t in enumerate(texts)]
    got = {r.doc_id for r in residue(spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, n int, _mask string")).collect()}
    want = set(range(len(RESIDUE)))
    assert got == want, ([texts[i] for i in want - got], [texts[i] for i in got - want])
    assert residue(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_recurring_messages_and_long_texts(spark):
    """A sentence that is not terse counts only if it recurs in different short texts of several sources, never in prose."""
    note, told, frame = "Our server was put to sleep; wake it from the panel", "The server was put to sleep; the crew went on with the paper list", "Panel | Start | Leave"
    rows = [(i, f"Sheet {chr(97 + i % 26)}{chr(97 + i // 26)}\n{note}\n{frame}", f"s{i % 7}") for i in range(30)]
    prose = "The road was dry. " + " ".join(f"We passed the {w} gate twice." for w in ("north", "south", "east", "west", "upper", "lower"))
    rows += [(100 + i, f"{told}. {prose} Day {chr(97 + i)}.", f"s{i % 7}") for i in range(26)] + [(200 + i, f"{told}.", "s1") for i in range(30)]
    rows += [(300, f"Notes on Ab1 {note}", "s"), (500, "The road was dry. " * 20_000, "s"), (501, "x" * 50_000 + " {{ stem }}", None), (502, "The road was dry.\n" + "text goes here. " * 30_000, None), (None, note, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kind for r in residue(df).collect()}
    assert got == {i: "error" for i in range(30)} | {300: "error", 501: "placeholder", 502: "filler"}
    few = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 3], "doc_id long, text string, source string")
    assert residue(few).count() == 0


def test_messages_joined_on_a_line(spark):
    """Messages and frames that follow each other without a full stop are known one by one; prose beside them still counts."""
    note, frames = "The upstream server took too long to answer", ["Home | Drives | Maps | Sign in", "Back to the first page of the site", "Please look again at the address for typing mistakes"]
    rows = [(i, f"Sheet {chr(97 + i % 26)}\n{note}\n{frames[i % 3]}\n{frames[(i + 1) % 3]}", f"s{i % 7}") for i in range(26)]
    rows += [(100, f"{note}. Request id 9f2 {frames[0]} {frames[1]} {frames[2]}", "s1"), (101, f"Notes on Ab12 ({note}) {frames[1]} {frames[2]} {frames[0]}", "s2"), (102, f"{frames[2]} {note} {frames[1]}\n{frames[0]} {frames[2]}", None)]
    rows += [(200, f"We wrote down the mount, the road, the clock and the weather before {note} {frames[1]}", "s1"), (201, f"{frames[0]} The road was dry and the crew went home before the rain came over the hill", "s2")]
    got = {r.doc_id: r.kind for r in residue(spark.createDataFrame(rows + rows[-5:], "doc_id long, text string, source string")).collect()}
    assert got == {i: "error" for i in [*range(26), 100, 101, 102]}


@pytest.mark.parametrize("text", ["abc abc abc 123 123 xxx xxx xxxx abc abc abc 123 123 xxx xxx xxxx", "xxx xxx xxxx asdf asdf jkl jkl xxx xxx xxxx test test test asdf asdf jkl jkl", "asdf asdf jkl jkl asdf asdf jkl jkl xxx xxx xxxx"])
def test_mixed_keyboard_filler(spark, text):
    rows = [(1, text, "a"), (2, f"Bench check 3\n\n{text} Text goes here.", "a"), (3, "The road had had had a hadden sign on the long way up to the gate.", "a")]
    assert {r.doc_id: r.kind for r in residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {1: "filler", 2: "filler"}


def test_long_texts_are_counted(spark):
    long = "a template that was copied " * 400
    df = spark.createDataFrame([(long, "a"), (long.upper(), "b"), (long + "x", "b"), ("Short 1", "a"), ("short 2", "a"), (" ", "a"), (None, "a")], "text string, source string")
    got = sorted((r["mask"], r.n_texts, r.n_sources) for r in message_classes(df).collect())
    assert got == [(long.strip(), 2, 2), ("short 0", 2, 1)]
