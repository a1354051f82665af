from __future__ import annotations

import random

import brute
import pytest
from brute import windowed
from pyspark.sql import functions as F

from wiretide.functions import timing
from wiretide.operators import sliding
from wiretide.operators.chain import cooldown, greedy_times
from wiretide.operators.distinct import cumulative_distinct
from wiretide.operators.running import dense_index
from wiretide.operators.sliding import sliding_count, sliding_distinct_count
from wiretide.operators.windows import anchored_windows, rolling_baseline, top_source_per_window
from wiretide.operators.windows import assign_windows, window_starts

MICROS = 1_000_000


def stream(seed, n, keys=4, values=6, step_us=MICROS, hot=0.4):
    """Rows with many equal times and gaps that hit window edges exactly; one key holds much of the traffic."""
    rng = random.Random(seed)
    now, rows = 1_700_000_000 * MICROS + rng.randrange(MICROS), []
    for seq in range(n):
        now += rng.choice([0, 0, 0, step_us, step_us, 2 * step_us, 7 * step_us // 2, rng.randrange(3 * step_us)])
        if rng.random() < 0.01:
            now += 400 * step_us
        key = "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
        rows.append({"seq": seq, "ts_us": now, "src_ip": key, "v": rng.randrange(values)})
    return rows


def frame(spark, rows):
    data = [(r["seq"], r["ts_us"], r["src_ip"], r["v"]) for r in rows]
    df = spark.createDataFrame(data, "seq bigint, ts_us bigint, src_ip string, v int")
    return df.repartition(4, "v")


# Window 5 s: slices longer than, equal to and shorter than the window.
@pytest.mark.parametrize(("slice_s", "seed"), [(None, 1), (5.0, 2), (2.0, 1), (0.7, 2), (1000.0, 3)])
def test_sliding_counts(spark, slice_s, seed):
    rows = stream(seed, 400)
    df = frame(spark, rows)
    got = {r.seq: r.observed for r in sliding_count(df, "src_ip", 5.0, slice_s).collect()}
    assert got == dict(enumerate(brute.count_in_window(rows, "src_ip", 5 * MICROS)))
    got = {r.seq: r.observed for r in sliding_distinct_count(df, "src_ip", "v", 5.0, slice_s).collect()}
    assert got == dict(enumerate(brute.distinct_in_window(rows, "src_ip", "v", 5 * MICROS)))


def test_sliding_keeps_columns_and_rows(spark):
    df = frame(spark, stream(5, 100)).withColumn("note", F.concat(F.lit("n"), F.col("seq")))
    for slice_s in (None, 1.0):
        for out in (sliding_count(df, "src_ip", 5.0, slice_s), sliding_distinct_count(df, "src_ip", "v", 5.0, slice_s)):
            assert sorted(out.columns) == sorted([*df.columns, "observed"])
            assert out.select(*df.columns).exceptAll(df).count() == 0 and out.count() == 100


def test_window_edge_is_closed(spark):
    rows = [{"seq": i, "ts_us": t, "src_ip": "a", "v": i} for i, t in enumerate([0, 5 * MICROS, 10 * MICROS + 1])]
    for slice_s in (None, 2.0):
        got = sliding_count(frame(spark, rows), "src_ip", 5.0, slice_s).orderBy("seq").collect()
        assert [r.observed for r in got] == [1, 2, 1]


@pytest.mark.parametrize("slice_s", [3600.0, 3.0])
def test_cumulative_distinct(spark, slice_s):
    rows = stream(3, 300, values=40)
    got = cumulative_distinct(frame(spark, rows), "src_ip", "v", slice_s).orderBy("seq").collect()
    assert [r.observed for r in got] == brute.distinct_so_far(rows, "src_ip", "v")
    seen = set()
    for row, r in zip(rows, got, strict=True):
        pair = (row["src_ip"], row["v"])
        assert r.first_seen == (pair not in seen)
        seen.add(pair)


def expected_fired(rows, gap, forced=None):
    out = set()
    for key in {r["src_ip"] for r in rows}:
        mine = [r for r in rows if r["src_ip"] == key]
        flags = [forced(r) for r in mine] if forced else None
        out |= {mine[i]["seq"] for i in brute.debounce([r["ts_us"] for r in mine], gap, flags)}
    return out


# Small limits send the hot key through several levels of the chain.
@pytest.mark.parametrize(("fold_rows", "span_gaps", "gap_s"), [(50_000, 16, 3.0), (20, 4, 11.0), (3, 16, 3.0)])
def test_cooldown(spark, fold_rows, span_gaps, gap_s):
    rows = stream(int(gap_s), 400)
    gap = int(gap_s * MICROS)
    df = frame(spark, rows)
    got = {r.seq for r in cooldown(df, "src_ip", gap, None, fold_rows, span_gaps).collect()}
    assert got == expected_fired(rows, gap)
    flagged = df.withColumn("must", F.col("v") == 3)
    fired = cooldown(flagged, "src_ip", gap, "must", fold_rows, span_gaps).collect()
    assert len(fired) == len({r.seq for r in fired})
    assert {r.seq for r in fired} == expected_fired(rows, gap, lambda r: r["v"] == 3)


def test_cooldown_edge_is_inclusive(spark):
    rows = [{"seq": i, "ts_us": t, "src_ip": "a", "v": 0} for i, t in enumerate([0, 30 * MICROS - 1, 30 * MICROS])]
    assert {r.seq for r in cooldown(frame(spark, rows), "src_ip", 30 * MICROS).collect()} == {0, 2}
    assert cooldown(frame(spark, rows), "src_ip", 0).count() == 3


@pytest.mark.parametrize("seed", range(2))
def test_chain_levels_agree(spark, seed):
    """Dense and sparse stretches, folded at once and through many levels."""
    rng = random.Random(seed)
    now, times = 10**12, []
    for _ in range(1500):
        now += rng.choice([1, 3, 10, 50]) if rng.random() < 0.98 else rng.randrange(20_000)
        times.append(now)
    df = spark.createDataFrame([("a", t, False) for t in times], "k string, u bigint, forced boolean")
    expected = brute.window_starts(times, 97)
    for fold_rows, span_gaps, first in [(10**6, 16, False), (40, 4, False), (1, 8, True)]:
        got = sorted(r.u for r in greedy_times(df, ["k"], 97, first, fold_rows, span_gaps).collect())
        assert got == expected


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    out = dense_index(df, ["v"], F.col("v") - F.col("v") % 64, "n", 5).collect()
    assert all(r.n == r.v + 5 for r in out) and len(out) == 1000


def window_rows(seed, n=600):
    rng = random.Random(seed)
    now, rows = 1_700_000_000 * MICROS, []
    for seq in range(n):
        burst = (seq // 40) % 7 == 5
        now += rng.randrange(200_000) if burst else rng.choice([0, 500_000, 2 * MICROS, 2_500_000])
        if rng.random() < 0.01:
            now += 55 * MICROS
        source = rng.choice(["a", "b", "c", None, ""])
        rows.append({"seq": seq, "ts_us": now, "src_ip": source, "v": 0})
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_anchored_windows(spark, seed):
    rows = window_rows(seed)
    packets = frame(spark, rows)
    starts = brute.window_starts([r["ts_us"] for r in rows], 10 * MICROS)
    table = window_starts(packets, 10.0, span_gaps=4)
    got = anchored_windows(packets, 10.0, table).orderBy("window_id").collect()
    assert [r.window_start for r in got] == starts
    assert [r.window_id for r in got] == list(range(len(starts)))
    members = [[r for r in rows if s <= r["ts_us"] < e] for s, e in zip(starts, [*starts[1:], 10**18], strict=True)]
    assert [r.n for r in got] == [len(m) for m in members]
    assert [r.first_seq for r in got] == [m[0]["seq"] for m in members]
    assert [r.close_us for r in got] == [*starts[1:], None]
    assert [r.close_seq for r in got] == [m[0]["seq"] for m in members[1:]] + [None]

    base = {r.window_id: (r.baseline_avg, r.baseline_n) for r in rolling_baseline(anchored_windows(packets, 10.0, table), 4).collect()}
    for i in range(len(starts)):
        before = [len(m) for m in members[max(0, i - 4) : i]]
        assert base[i] == ((sum(before) / len(before)) if before else None, len(before))

    top = {r.window_start: (r.top_ip, r.top_count) for r in top_source_per_window(assign_windows(packets, table, 10.0)).collect()}
    for s, m in zip(starts, members, strict=True):
        names = [r["src_ip"] for r in m if r["src_ip"]]
        best = min(set(names), key=lambda x: (-names.count(x), names.index(x))) if names else "unknown"
        assert top[s] == (best, names.count(best))


def test_slices_follow_the_density(spark, monkeypatch):
    """One source with 90 % of a day: no (key, slice) above the bound, and the counts stay."""
    monkeypatch.setattr(timing, "SLICE_ROWS", 300)
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else "cold", rng.randrange(86_400) * 1_000_000 + k, k, rng.randrange(40)) for k in range(4000)]
    df = spark.createDataFrame(rows, "src_ip string, ts_us long, seq long, v long")
    for hours in (6, 72):
        length = timing.dense_slice(df, ["src_ip"], timing.slice_length(hours * 3_600_000_000, None))
        per_slice = df.groupBy("src_ip", timing.slice_start(F.col("ts_us"), length)).count()
        assert per_slice.agg(F.max("count")).first()[0] <= 300
        keyed = [{"src_ip": k, "ts_us": t, "v": v, "seq": s} for k, t, s, v in sorted(rows, key=lambda r: (r[1], r[2]))]
        some = rng.sample(range(len(keyed)), 150)
        window = hours * 3_600_000_000
        counts = {r.seq: r.observed for r in sliding_count(df, "src_ip", hours * 3600).collect()}
        distinct = {r.seq: r.observed for r in sliding_distinct_count(df, "src_ip", "v", hours * 3600).collect()}
        for i in some:
            live = windowed(keyed, i, "src_ip", window)
            assert counts[keyed[i]["seq"]] == len(live) and distinct[keyed[i]["seq"]] == len({r["v"] for r in live})


@pytest.mark.parametrize("window_s", [600, 3 * 86_400])
def test_a_burst_of_one_key_leaves_the_others_alone(spark, monkeypatch, window_s):
    """One second of 20,000 packets and 100 quiet sources: these keep their slices, with two rows per packet at most."""
    monkeypatch.setattr(timing, "SLICE_ROWS", 3000)
    laid = []
    count_live = sliding._count_live
    monkeypatch.setattr(sliding, "_count_live", lambda rows, *a: laid.append(rows) or count_live(rows, *a))
    base = 1_700_000_000 * MICROS
    burst = spark.range(20_000).select(F.lit("hot").alias("src_ip"), (base + F.col("id") * 50).alias("ts_us"), "id", (F.col("id") % 500).alias("v"))
    quiet = spark.range(300).select(
        F.concat(F.lit("q"), F.col("id") % 100).alias("src_ip"), (base + F.col("id") * 1_234_567).alias("ts_us"), F.col("id") + 20_000, F.lit(1).alias("v")
    )
    later = spark.range(400).select(F.lit("hot").alias("src_ip"), (base + (F.col("id") + 1) * 777 * MICROS).alias("ts_us"), F.col("id") + 30_000, F.lit(3).alias("v"))
    df = burst.union(quiet).union(later).toDF("src_ip", "ts_us", "seq", "v")
    found = sliding_distinct_count(df, "src_ip", "v", window_s).groupBy("src_ip").agg(F.max("observed").alias("m"), F.count("*").alias("n")).collect()
    assert {r.src_ip: (r.m, r.n) for r in found if r.src_ip == "hot"} == {"hot": (500, 20_400)}
    assert sum(r.n for r in found) == 20_700
    rows = {r.src_ip: r["count"] for r in laid[0].groupBy("src_ip").count().collect()}
    assert all(n <= 2 * 3 for k, n in rows.items() if k != "hot")
    # A marker per live value and slice of the burst, and none for slices that don't exist.
    per_slice = laid[0].filter("src_ip = 'hot'").groupBy("_slice").agg(F.count(F.when(F.col("_own"), 1)).alias("own")).collect()
    assert max(r.own for r in per_slice) <= 6000
    assert rows["hot"] <= 20_400 + 500 * (len(per_slice) + 1)
    counts = sliding_count(df, "src_ip", window_s).groupBy("src_ip").agg(F.max("observed").alias("m")).collect()
    live_later = min(400, window_s // 777)
    assert {r.m for r in counts if r.src_ip == "hot"} == {20_000 + live_later if window_s > 777 else 20_000}


def test_cooldown_fires_one_of_repeated_rows(spark):
    """Equal rows of one time, for short keys in one pass and for long keys by the chain of times."""
    rows = [("a", t, t) for t in (0, 0, 0, 5, 5, 10, 10, 12, 20) for _ in range(3)]
    df = spark.createDataFrame(rows, "src_ip string, ts_us long, seq long")
    for fold_rows in (50_000, 4):
        fired = cooldown(df, "src_ip", 10, fold_rows=fold_rows).collect()
        assert sorted(r.ts_us for r in fired) == [0, 10, 20]
