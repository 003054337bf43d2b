"""Incidents of many systems in one plan against one system at a time."""

import random

from pyspark.sql import functions as F

from gleanspark.operators import incident, series


def planted(rng, name, base):
    """A cause, an effect 120 s later, a second effect, a stream that stops, and one that has nothing to do with it."""
    rows, hits = [], sorted(rng.sample(range(3600, 28_000), 4))
    for h in hits:
        rows += [(name, "deploy", base + h + d) for d in range(3)]
        rows += [(name, "errors", base + h + 120 + d) for d in range(25)]
        rows += [(name, "alerts", base + h + 300 + d) for d in range(15)]
    rows += [(name, "steady", base + 9 * i) for i in range(3400) if not any(h <= 9 * i < h + 900 for h in hits)]
    rows += [(name, "noise", base + rng.randrange(30_000)) for _ in range(60)]
    return rows, [(name, source, base + h - 20) for h in hits for source in ("same", "release")] + [(name, "late", base + hits[0] + 40_000)]


def test_many_systems_equal_one_by_one(spark):
    rng = random.Random(14)
    rows, candidates = [], []
    for k in range(12):
        own, near = planted(rng, f"sys{k:02}", 1_700_000_000 + 7919 * k)
        rows += own
        candidates += near if k % 2 else []
    rows += [("quiet", "a", 1_700_000_000 + 60 * i) for i in range(200)] + [("one", "a", 5)] * 9 + [(None, "a", 5)] * 9
    streams = spark.createDataFrame(rows, "system string, stream string, epoch long").repartition(4)
    triggers = spark.createDataFrame(candidates, "system string, source string, epoch long")
    got = {r.system: r for r in incident.timelines(streams, triggers).collect()}
    assert set(got) >= {f"sys{k:02}" for k in range(12)} and "one" not in got and "quiet" not in got
    for name in ("sys00", "sys01", "sys05"):
        one = incident.timeline(streams.where(F.col("system") == name).drop("system"), triggers.where(F.col("system") == name).drop("system"))
        r = got[name]
        assert (r.kind, r.stream, r.time) == (one["anchor"]["kind"], one["anchor"]["stream"], one["anchor"]["time"])
        assert [(s.stream, s.lag_seconds, s.score, s.direction, s.kind) for s in r.steps] == [(s["stream"], s["lag_seconds"], s["score"], s["direction"], s["kind"]) for s in one["steps"]]
        assert r.confidence == one["confidence"]
    assert got["sys01"].stream == "release" and got["sys01"].kind == "trigger"
    grid = series.shared_grid(streams.where("system = 'sys03'").drop("system"))
    told = incident.grids(streams.where("system IS NOT NULL").groupBy("system", "epoch").agg(F.count(F.lit(1)).alias("n"))).where("system = 'sys03'").first()
    assert (told.low, told.high, told.width, told.n, told.lags) == (grid.low, grid.high, grid.width, grid.n, grid.most_lag)
    assert incident.timelines(streams.limit(0)).count() == 0
