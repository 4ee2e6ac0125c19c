"""The general problems on small tables, against plain Python."""

import datetime as dt
import random
import statistics
from collections import defaultdict
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import asof, late_events, regular_grid, skew, snapshot_changes, spikes, timestamps, votes

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1. Snapshots


def snapshots(spark, data):
    return spark.createDataFrame(data, "site_id long, week_end date, as_of date, ed_resp double, loaded_at timestamp, hash string, kind string")


def changes(df, **kw):
    return snapshot_changes.snapshot_changes(df, "site_id", "week_end", "as_of", "ed_resp", "loaded_at", buckets=4, **kw)


def test_snapshot_changes(spark):
    t = dt.datetime(2025, 1, 1)
    a1, a2, a3 = D(2025, 3, 1), D(2025, 3, 8), D(2025, 3, 15)
    w = [D(2025, 2, 1), D(2025, 2, 8), D(2025, 2, 15), D(2024, 12, 7)]
    data = [
        (1, w[0], a1, 1.0, t, "x", "y"), (1, w[1], a1, 2.0, t, "x", "y"), (1, w[3], a1, 9.0, t, "x", "y"),
        (1, w[0], a2, 1.0 + 1e-12, t, "x", "y"), (1, w[2], a2, None, t, "x", "y"),
        (1, w[0], a3, 1.006, t, "x", "y"), (1, w[2], a3, 3.0, t, "x", "y"), (1, w[2], a3, 3.0, t, "x", "y"),
        # delivered only on the first and the last day: compared with each other
        (2, w[0], a1, 5.0, t, "x", "y"), (2, w[0], a3, 5.0, t, "x", "y"), (2, w[1], a3, float("nan"), t, "x", "y"),
        # superseded by a later load
        (3, w[0], a1, 1.0, t, "x", "y"), (3, w[0], a2, 7.0, t, "x", "y"), (3, w[0], a2, 1.0, t + dt.timedelta(hours=1), "x", "y"),
        (None, w[0], a2, 7.0, t, "x", "y"), (3, None, a2, 7.0, t, "x", "y"),
    ]
    got = rows(changes(snapshots(spark, data)).select("site_id", "week_end", "as_of", "kind"))
    assert got == sorted([
        (1, w[1], a2, "removed"), (1, w[2], a2, "added"), (1, w[0], a3, "changed"), (1, w[2], a3, "changed"), (2, w[1], a3, "added"),
    ], key=repr)
    assert (1, w[3], a2, "removed") in rows(changes(snapshots(spark, data), removed_within_days=None).select("site_id", "week_end", "as_of", "kind"))


def test_snapshot_changes_of_an_empty_table(spark):
    assert changes(snapshots(spark, [])).collect() == []


def test_hash_never_hides_a_change(spark):
    df = spark.range(2000).select((F.rand(1) * 20).alias("v")).withColumn("w", F.col("v") + 0.005)
    same = df.filter(snapshot_changes.value_hash("v", 0.005) == snapshot_changes.value_hash("w", 0.005))
    assert same.count() == 0


# 2. Regular grid


def test_grid_marks_and_bridges_gaps(spark):
    start = D(2025, 1, 4)
    data = [(1, dt.datetime.combine(start + dt.timedelta(weeks=k), dt.time(23, 59, 59)), 2.0 + 0.1 * k, k, "c") for k in range(30) if k not in (10, 11, 20)]
    data += data[:3] + [(1, dt.datetime(2025, 3, 10), None, 99, "c"), (2, dt.datetime(2025, 1, 5), 4.0, 100, "c"), (2, dt.datetime(2025, 1, 26), 6.0, 101, "c"), (None, dt.datetime(2025, 1, 5), 4.0, 102, "c")]
    df = spark.createDataFrame(data, "s long, at timestamp_ntz, v double, id long, week_end string")
    grid = {(r.source, r.week_end): r for r in regular_grid.regular_grid(df, "s", "at", "v", "id").collect()}
    assert len(grid) == 30 + 4
    missing = sorted(k for k, r in grid.items() if r.status == "missing")
    assert missing == [(1, start + dt.timedelta(weeks=k)) for k in (10, 11, 20)] + [(2, D(2025, 1, 18)), (2, D(2025, 1, 25))]
    for k in (10, 11, 20):
        assert grid[1, start + dt.timedelta(weeks=k)].value == pytest.approx(2.0 + 0.1 * k, abs=0.05)
    assert grid[2, D(2025, 1, 11)].value == 4.0 and grid[2, D(2025, 2, 1)].value == 6.0
    assert regular_grid.regular_grid(df.limit(0), "s", "at", "v", "id").collect() == []


# 3. As-of join


@pytest.mark.parametrize("shard_rows", [2, 7, 10**6])
def test_asof_join_against_brute_force(spark, shard_rows):
    rng = random.Random(5)
    day = lambda k: D(2025, 1, 1) + dt.timedelta(days=k)
    versions = [(1 if rng.random() < 0.6 else rng.randint(2, 5), day(rng.randint(0, 20)) if rng.random() < 0.95 else None, i, rng.choice([None, 0.5, 1.5])) for i in range(60)]
    versions += versions[:5]
    events = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 6), day(rng.randint(-3, 25)) if rng.random() < 0.95 else None, "s", 1) for i in range(90)]
    events += [(900 + i, 1, day(9), "tie", 1) for i in range(15)] + [(990, None, day(3), "x", 1)]
    e = spark.createDataFrame(events, "id long, k long, t date, _shard string, _v int")
    v = spark.createDataFrame(versions, "k long, known date, fid long, label double")
    out = {r.id: (r.version.order, r.version.label, r.version.valid_from) if r.version else None for r in asof.asof_join(e, v, ["k"], "t", "id", "known", "fid", ["label"], shard_rows).collect()}
    assert len(out) == len(events)
    for i, k, t, *_ in events:
        known = [(d, f, x) for kk, d, f, x in versions if t is not None and k is not None and kk == k and d is not None and d <= t]
        best = max(known, key=lambda x: x[:2], default=None)
        assert out[i] == (best and (best[1], best[2], best[0]))
    assert asof.asof_join(e.limit(0), v, ["k"], "t", "id", "known", "fid", ["label"], shard_rows).count() == 0
    assert asof.asof_join(e, v.limit(0), ["k"], "t", "id", "known", "fid", ["label"], shard_rows).filter("version is not null").count() == 0


def test_known_day(spark):
    cases = {"2025-03-01": D(2025, 3, 1), " 2025-03-01 ": D(2025, 3, 1), "2025-03-01T23:59:59": D(2025, 3, 1), "2025-03-01 07:15": D(2025, 3, 1), "2025-02-30": None, "soon": None, "": None, None: None, "2025-03-01x": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(asof.known_day("t")).collect()] == list(cases.values())


# 4. Timestamps


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())


CASES = [
    ("2025-07-19T00:36:20.089Z", utc(2025, 7, 19, 0, 36, 20)), ("2025-02-15T15:24:55-06:00", utc(2025, 2, 15, 21, 24, 55)), ("2024-10-03T22:25:02.502404-0500", utc(2024, 10, 4, 3, 25, 2)),
    ("2026-03-08 01:59", utc(2026, 3, 8, 7, 59)), ("2026-03-08 02:19", utc(2026, 3, 8, 8, 19)), ("2026-03-08 03:19", utc(2026, 3, 8, 8, 19)), ("2025-11-02 01:30", utc(2025, 11, 2, 6, 30)),
    ("20250213T151234", utc(2025, 2, 13, 21, 12, 34)), ("20250527100156", utc(2025, 5, 27, 15, 1, 56)), ("20251102", utc(2025, 11, 2, 5)), ("2025-06-02", utc(2025, 6, 2, 5)),
    ("﻿ 2024-09-30T23:43:44.84 ", utc(2024, 10, 1, 4, 43, 44)), ("12/12/2024 5:38 AM", utc(2024, 12, 12, 11, 38)), ("12/12/2024 12:05 AM", utc(2024, 12, 12, 6, 5)), ("3/16/25 18:10", utc(2025, 3, 16, 23, 10)),
    ("1763734110", 1763734110), ("1762865998230", 1762865998), ("1763352437.9", 1763352437), ("2025-01-02 07:35 CST", utc(2025, 1, 2, 13, 35)), ("July 9, 2025 at 11:57 p.m. CST", utc(2025, 7, 10, 5, 57)),
    ("20 de noviembre de 2025, 03:09", utc(2025, 11, 20, 9, 9)), ("Fri, 18 Oct 2024 04:05:24 -0500", utc(2024, 10, 18, 9, 5, 24)), ("Mon, 16 Dec 2024 14:18:08 GMT", utc(2024, 12, 16, 14, 18, 8)),
    ("30 Aug 2025 12:57:45 AM", utc(2025, 8, 30, 5, 57, 45)), ("Dec. 20, 2025 at 6:47 a.m. EST", utc(2025, 12, 20, 11, 47)), ("Sept. 1, 2025", utc(2025, 9, 1, 5)), ("April 15, 2025 5:35 am", utc(2025, 4, 15, 10, 35)),
    ("2025-02-30", None), ("2025-13-05T10:00:00Z", None), ("31/31/2025", None), ("0", None), ("yesterday", None), ("", None), (None, None), ("1970-01-01T00:00:00Z", None), ("2205-01-01T00:00:00Z", None),
    ("2025-05-05 25:00", None), ("13/01/2025 13:00 PM", None), ("2025-05-05 10:00 XYZ", None), ("x" * 5000, None),
]


def test_timestamp_cascade(spark):
    df = spark.createDataFrame([(i, t, "America/Chicago") for i, (t, _) in enumerate(CASES)], "i int, t string, z string")
    got = {r.i: r.utc_seconds for r in timestamps.utc_seconds(df, "t", "z").collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == CASES


def test_wall_times_against_zoneinfo_and_policies(spark):
    zone = ZoneInfo("America/New_York")
    walls = [dt.datetime(2025, 3, 8, 12) + dt.timedelta(minutes=17 * k) for k in range(150)] + [dt.datetime(2025, 11, 1, 12) + dt.timedelta(minutes=17 * k) for k in range(150)]
    df = spark.createDataFrame([(i, int(w.replace(tzinfo=dt.UTC).timestamp()), "America/New_York") for i, w in enumerate(walls)], "i int, w long, z string")
    pick = lambda a, n: {r[0]: r[1] for r in df.select("i", timestamps.wall_to_utc(F.col("w"), F.col("z"), a, n)).collect()}
    first, other, none = pick("earlier", "before"), pick("later", "after"), pick("null", "null")
    for i, w in enumerate(walls):
        a, b = (int(w.replace(tzinfo=zone, fold=f).timestamp()) for f in (0, 1))
        assert first[i] == a
        assert other[i] == b
        assert none[i] == (a if a == b else None)


# 5. Late events


def brute_verdicts(records, cutoff=28):
    out, top = {}, defaultdict(lambda: None)
    for r in sorted(records, key=lambda r: (r[3], r[0])):
        k, w = r[1], r[2]
        if top[k] is not None and w < top[k]:
            out[r[0]] = "dropped" if (top[k] - w).days > cutoff else "late"
        top[k] = max(w, top[k] or w)
    return out


def arrivals(spark, seed=3, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.choice([rng.randint(0, 2000), 24 * rng.randint(0, 80)]))
        week = D(2025, 1, 4) + dt.timedelta(weeks=max((at - dt.datetime(2025, 1, 4)).days // 7 - rng.choice([0, 0, 0, 1, 2, 5, 7]), 0))
        out.append((i, 1 if rng.random() < 0.6 else rng.randint(2, 4), week, at, rng.choice(["a", "b", None]), round(rng.random() * 9, 2)))
    return out


SCHEMA5 = "id long, k long, w date, at timestamp_ntz, u string, v double"


def read5(df):
    return late_events.arrivals(df, "k", "w", "at", "id", "v", "u")


def test_lateness_against_brute_force(spark):
    data = arrivals(spark)
    usable = [r for r in data if (r[2] - r[3].date()).days <= 6]
    junk = [(5000, 1, D(2030, 1, 5), dt.datetime(2025, 1, 2), "a", 1.0), (5001, 1, D(2025, 3, 1), dt.datetime(2025, 3, 1), "a", None), (5002, None, D(2025, 3, 1), dt.datetime(2025, 3, 1), "a", 2.0)]
    df = spark.createDataFrame(data + data[:9] + junk, SCHEMA5)
    got = {r.id: r.verdict for r in late_events.verdicts(read5(df)).collect() if r.verdict}
    assert got == brute_verdicts(usable) and len(got) > 20


def test_records_pass_through_the_state_in_batches(spark, monkeypatch):
    """Verdicts and aggregates come out of the state: values are taken out, closed periods leave it, and without it the verdicts are wrong."""
    data = arrivals(spark)
    df = spark.createDataFrame(data, SCHEMA5)
    usable = [r for r in data if (r[2] - r[3].date()).days <= 6]
    want = brute_verdicts(usable)
    state = late_events.replay(read5(df), batch_days=14)
    assert len(state.numbers) > 4 and {r.id: r.verdict for r in state.judged().collect() if r.verdict} == want
    assert spark.read.parquet(f"{state.root}/gen-{state.done}/moves").filter("goes is not null").count() > 0
    last = {}
    for r in sorted(usable, key=lambda r: (r[3], r[0])):
        if want.get(r[0]) != "dropped":
            last[r[1], r[2], r[4]] = r[5]
    values = defaultdict(list)
    for (k, w, _), v in last.items():
        values[k, w].append(v)
    got = {(r.key, r.period): r for r in state.periods().collect()}
    assert got.keys() == values.keys()
    for key, vs in values.items():
        assert (got[key].n, got[key].median, got[key].distinct_values, got[key].highest) == (len(vs), pytest.approx(statistics.median(vs)), len(set(vs)), max(vs))
    closed = state._read(state.done, "counts").filter("open").groupBy("key").agg(F.datediff(F.max("period"), F.min("period")).alias("span"))
    assert closed.agg(F.max("span")).first()[0] <= 28
    monkeypatch.setattr(late_events.LateState, "horizon", lambda self: self._read(self.done, "counts").select("key", F.lit("1970-01-03").cast("date").alias("top")).distinct() if self.numbers else None)
    blind = late_events.replay(read5(df), batch_days=14)
    assert {r.id: r.verdict for r in blind.judged().collect() if r.verdict} != want


def test_late_events_of_an_empty_table(spark):
    assert late_events.corrected_periods(read5(spark.createDataFrame([], SCHEMA5))).collect() == []


# Votes


def test_answers_are_normalised(spark):
    df = spark.createDataFrame([("Flu, RSV, flu",), (" none ",), ("none|flu",), ("cold",), ("",), (None,), ("covid;RSV",)], "i string")
    assert [r[0] for r in df.select(labels.illness_answer("i")).collect()] == ["flu|rsv", "none", None, None, None, None, "covid|rsv"]
    df = spark.createDataFrame([("2.0",), (" 1",), ("7",), ("high",), ("3",), ("1.5",), (None,)], "c string")
    assert [r[0] for r in df.select(labels.concern_answer("c")).collect()] == ["2", "1", None, None, "3", None, None]


def test_latest_valid_row_counts(spark):
    t = dt.datetime(2025, 1, 1)
    data = [("a", "x", t, 1, "0", "y"), ("a", "x", t + dt.timedelta(1), 2, "0", None), ("a", "z", t, 3, "1", "y"), ("a", " q ", t, 4, None, "n"), ("a", "q", t, 5, "0", "y"), (None, "q", t, 6, "0", "y"), ("a", None, t, 7, "0", "y")]
    df = spark.createDataFrame(data, "i string, l string, at timestamp, id long, ex string, r string")
    got = rows(votes.latest_votes(df, "i", "l", "at", "id", F.col("ex") == "1", {"r": F.col("r")}))
    assert got == [("a", "q", "y"), ("a", "x", None)]


def test_asof_join_keeps_event_columns_of_any_name(spark):
    e = spark.createDataFrame([(1, "k", D(2025, 1, 2), "kept")], "id long, k string, t date, known string")
    v = spark.createDataFrame([("k", D(2025, 1, 1), 5, 0.5)], "k string, known date, fid long, label double")
    with pytest.raises(ValueError):
        asof.asof_join(e.withColumnRenamed("known", "version"), v, ["k"], "t", "id", "known", "fid", ["label"])
    r = asof.asof_join(e, v, ["k"], "t", "id", "known", "fid", ["label"], out="found").first()
    assert r.known == "kept" and r.found.label == 0.5


# 7. Implausible readings


def readings(spark):
    rng = random.Random(2)
    data, planted = [], set()
    for site in range(12):
        for k in range(70):
            at = dt.datetime(2025, 1, 1) + dt.timedelta(days=5 * k, hours=rng.randint(0, 40))
            level = 4 + 1.5 * ((k % 52) / 26 - 1) ** 2 + (3 if site % 3 == 0 and k > 40 else 0)
            data.append([site * 1000 + k, site, at, round(level * (1 + 0.04 * rng.gauss(0, 1)), 2), "x"])
        base = site * 70
        for k, v in ((15, 19.0), (30, 0.6), (50, 30.0), (51, 31.0)):
            data[base + k][3] = v
            planted.add(data[base + k][0])
        for k, v in ((22, -1.0), (23, 250.0)):
            data[base + k][3] = v
            planted.add(data[base + k][0])
        for k in range(60, 66):
            data[base + k][3] = 5.5
            planted.add(data[base + k][0])
        data[base + 5][3] = None
    return data + data[:10], planted


@pytest.mark.parametrize("shard_rows", [9, 25, 10**6])
def test_planted_readings_are_found_at_any_cut(spark, shard_rows):
    data, planted = readings(spark)
    df = spark.createDataFrame(data, "id long, s long, at timestamp_ntz, v double, scatter string")
    got = {r.reading_id for r in spikes.implausible_readings(df, "s", "at", "id", "v", shard_rows=shard_rows).collect()}
    assert got == planted


def test_details_decide_and_are_scaled_by_each_sites_scatter(spark, monkeypatch):
    """The same departure is a spike where scatter is small, and none where it is usual; without details nothing departs."""
    rng = random.Random(8)
    data = [(s * 1000 + k, s, dt.datetime(2025, 1, 1) + dt.timedelta(days=4 * k), 5 * (2.0 if k == 30 else 1) * 2.718 ** (sd * rng.gauss(0, 1))) for s, sd in ((1, 0.05), (2, 0.6)) for k in range(80)]
    data += [(3000 + k, 3, dt.datetime(2025, 1, 1) + dt.timedelta(days=4 * k), (4.0 if k < 40 else 9.0) * 2.718 ** (0.03 * rng.gauss(0, 1))) for k in range(80)]
    df = spark.createDataFrame(data, "id long, s long, at timestamp_ntz, v double")
    found = {r.reading_id: r.score for r in spikes.implausible_readings(df, "s", "at", "id", "v").collect()}
    assert set(found) == {1030} and found[1030] > 5
    coded = {r.id: r for r in spikes.details(df.select(F.col("s").alias("source"), "at", "id", F.col("v").alias("value")), 0, 100).collect()}
    assert coded[1030].single == pytest.approx(min(abs(coded[1030].fine), abs(coded[1031].fine)) / spikes.FINE_NORM, rel=0.4) and coded[3040].single == 0
    monkeypatch.setattr(spikes, "departure", lambda *a, **k: F.lit(0.0))
    assert spikes.implausible_readings(df, "s", "at", "id", "v").collect() == []


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_shards_are_assigned_alike_with_and_without_broadcast(spark, broadcast_rows):
    rng = random.Random(6)
    data = [(1 if rng.random() < 0.5 else rng.randint(2, 40), D(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 300)), i) for i in range(2000)]
    df = spark.createDataFrame(data, "k long, t date, i long")
    plan = skew.plan_shards(df, ["k"], "t", 100)
    out = plan.assign(df, "t", broadcast_rows).collect()
    assert len(out) == len(data)
    spans = defaultdict(list)
    for r in out:
        assert (r._shard > 0) == (r.k == 1)
        spans[r._shard].append(r.t)
    spans.pop(0)
    assert 7 <= len(spans) <= 12 and max(map(len, spans.values())) < 200
    ordered = [spans[s] for s in sorted(spans)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))


def test_halos_reach_over_shards_without_wanted_rows(spark):
    data = [(1, k, k % 10 == 0 and not 30 <= k < 60) for k in range(100)]
    df = spark.createDataFrame(data, "k long, t long, w boolean")
    plan = skew.plan_shards(df, ["k"], "t", 7)
    placed = plan.assign(df, "t").drop("_salts")
    wanted = [t for _, t, w in data if w]
    shards = defaultdict(list)
    for r in placed.collect():
        shards[r._shard].append(r.t)
    got = defaultdict(set)
    for r in skew.halo_rows(placed, plan, ["t"], 3, F.col("w")).collect():
        got[r._shard].add(r.t)
    for s, own in shards.items():
        assert got[s] == set([t for t in wanted if t < min(own)][-3:] + [t for t in wanted if t > max(own)][:3])


def test_no_readings(spark):
    df = spark.createDataFrame([(1, 1, dt.datetime(2025, 1, 1), None)], "id long, s long, at timestamp_ntz, v double")
    assert spikes.implausible_readings(df, "s", "at", "id", "v").collect() == []


# Shared parts


def test_prefix_sums_match_a_plain_running_sum(spark):
    rng = random.Random(1)
    data = [(1 if rng.random() < 0.7 else 2, rng.random(), rng.randint(1, 9)) for _ in range(300)]
    df = spark.createDataFrame(data, "k int, u double, n long").withColumn("piece", F.floor(F.col("u") * 7))
    got = {(r.k, r.u): r.upto for r in skew.prefix_sums(df, ["k"], ["u"], "n", "upto", "piece").collect()}
    for key in (1, 2):
        total = 0
        for k, u, n in sorted(data):
            if k == key:
                total += n
                assert got[k, u] == total
