"""Lagged correlation by blocks against plain loops, peaks and spike flags."""

import math
import random

from pyspark.sql import functions as F

from gleanspark.operators import series


def plain_links(streams, grid, top):
    counts = {}
    for s, t in streams:
        if s is not None and grid.low <= t <= grid.high:
            counts.setdefault(s, [0] * grid.n)[(t - grid.low) // grid.width] += 1
    counts = {s: c for s, c in counts.items() if sum(c) >= 3}
    out = []
    for a in counts:
        for b in counts:
            if a < b:
                found = []
                for leader, follower in ((a, b), (b, a)):
                    for lag in range(grid.most_lag + 1):
                        k = grid.n - lag
                        x, y = counts[leader][:k], counts[follower][lag:]
                        sx, sy = sum(x), sum(y)
                        u, v = k * sum(i * i for i in x) - sx * sx, k * sum(i * i for i in y) - sy * sy
                        if k >= 8 and sx >= 3 and sy >= 3 and u / k / k > 1e-9 and v / k / k > 1e-9:
                            r = (k * sum(i * j for i, j in zip(x, y)) - sx * sy) / math.sqrt(u * v)
                            if r >= 0.5:
                                found.append((-round(r, 9), -lag, leader, follower))
                if found:
                    r, lag, leader, follower = min(found)
                    x, y = counts[leader], counts[follower]
                    mx, my = sum(x) / grid.n, sum(y) / grid.n
                    best = max(range(-lag, grid.n), key=lambda i: ((x[i + lag] - mx) * (y[i] - my), -i))
                    out.append((leader, follower, -lag * grid.width, round(-r, 4), sum(x), sum(y), grid.width, best * grid.width + grid.low))
    return sorted(out, key=lambda x: (-x[3], x[1], x[0]))[:top]


def random_streams(rng, n, span=4000):
    rows = []
    for i in range(n):
        bursts = [rng.randrange(span) for _ in range(rng.choice([1, 3, 6]))]
        rows += [(f"s{i:03}", t + rng.randrange(12)) for t in bursts for _ in range(rng.choice([1, 5, 20]))]
        if i % 4 == 1:
            before = [t for s, t in rows if s == f"s{i - 1:03}"]
            rows = [r for r in rows if r[0] != f"s{i:03}"] + [(f"s{i:03}", t + 37 * (i % 5)) for t in before if rng.random() < 0.9]
    return rows + [(None, 5)] * 4 + [("few", 1)] * 2


def test_links_against_plain_loops(spark, monkeypatch):
    rng = random.Random(3)
    for block, n in ((64, 14), (3, 14), (1, 5)):
        monkeypatch.setattr(series, "BLOCK", block)
        rows = random_streams(rng, n)
        streams = spark.createDataFrame(rows, "stream string, epoch long")
        grid = series.shared_grid(streams)
        for top in (3, 1000):
            got = [tuple(r) for r in series.correlate(streams, top=top, grid=grid).collect()]
            wanted = plain_links(rows, grid, top)
            assert got == wanted and len(wanted) >= 2


def test_many_streams_make_few_rows(spark):
    """Of 600 streams, 180,000 pairs, only what can be among the best three leaves a task."""
    rng = random.Random(7)
    rows = [(f"n{i:03}", rng.randrange(20_000)) for i in range(598) for _ in range(30)]
    planted = [rng.randrange(19_000) for _ in range(60)]
    rows += [("cause", t) for t in planted] + [("effect", t + 420) for t in planted]
    streams = spark.createDataFrame(rows, "stream string, epoch long")
    found = series.correlate(streams).collect()
    assert (found[0].leader, found[0].follower) == ("cause", "effect") and abs(found[0].lag_seconds - 420) <= found[0].width_seconds and found[0].score > 0.8


def test_peaks_and_flags(spark):
    hours = spark.createDataFrame([(h, n) for h, n in [(0, 2), (5, 9), (7, 9), (8, 0)]], "hour int, n long")
    assert series.peak(hours, "hour").collect() == [(5, 9)] and series.peak(hours, "hour", last=True).collect() == [(7, 9)]
    assert series.peak(hours.where("n = 0"), "hour").collect() == [] and series.peak(hours.limit(0), "hour").collect() == []
    dense = spark.createDataFrame([(i, 60 * i, 50 + i % 3 if i != 30 else 3000) for i in range(60)], "bucket long, start long, n long")
    flagged = series.spike_flags(dense)
    assert flagged.count() == 60 and [r.bucket for r in flagged.where("spike").collect()] == [30]


def test_latest_stamp_before_over_stretches(spark):
    rng = random.Random(5)
    events = [(rng.choice(["a", "b", None]), rng.randrange(10_000)) for _ in range(400)] + [("z", 5), ("a", None)]
    stamps = [(rng.choice(["a", "b", None]), rng.randrange(3000, 9000)) for _ in range(40)] + [("b", None)]
    left, right = spark.createDataFrame(events, "k string, t long"), spark.createDataFrame(stamps, "k string, s long")
    latest = lambda k, t: max((s for x, s in stamps if s is not None and t is not None and s <= t and (k == x or k == "*")), default=None)
    wanted = sorted((str(k), t, latest(k, t)) for k, t in events if latest(k, t) is not None)
    assert sorted((str(r.k), r.t, r.s) for r in series.latest_before(left, right, ["k"], "t", "s").collect()) == wanted
    assert sorted((r.t, r.s) for r in series.latest_before(left, right, [], "t", "s").collect()) == sorted((t, latest("*", t)) for _, t in events if latest("*", t) is not None)
    assert series.latest_before(left, right.limit(0), ["k"], "t", "s").count() == 0 == series.latest_before(left.limit(0), right, [], "t", "s").count()
