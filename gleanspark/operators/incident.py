"""Incident timelines: what led, what followed by how long, what broke off, and which trigger was near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timekey import NICE_WIDTHS, iso_label
from ..session import stored
from . import series

# What counts as a trigger, and how far after the anchor drops are looked for.
TRIGGER_EVENTS, TRIGGER_SHARE, LEAST_HORIZON, HORIZON_LAGS = 50, 10, 16, 3


def streams_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(streams ``stream epoch``, trigger candidates ``source epoch``) of events ``file epoch is_error``.

    A file of three events or more is a stream, and its errors are one of their
    own if they are three or more; the events of smaller files are candidates.
    """
    counts = events.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"))
    told = events.join(counts, "file")
    every = told.where(F.col("n") >= series.LEAST_EVENTS).select(F.col("file").alias("stream"), "epoch")
    errors = told.where((F.col("n") >= series.LEAST_EVENTS) & (F.col("errors") >= series.LEAST_EVENTS) & F.col("is_error")).select(F.concat("file", F.lit(" (errors)")).alias("stream"), "epoch")
    return every.unionByName(errors), told.where(F.col("n") < series.LEAST_EVENTS).select(F.col("file").alias("source"), "epoch")


def drops_after(streams: DataFrame, grid: series.Grid, anchor: int, horizon: int, but: list[str]) -> DataFrame:
    """``stream``, ``bucket``, ``strength``: the strongest drop of each stream in ``horizon`` buckets from ``anchor``.

    Against the median and its deviation over the stream's whole grid; the first of equals.
    """
    table = series.on_grid(streams, grid).where(~F.col("stream").isin(but)) if but else series.on_grid(streams, grid)
    middles = table.groupBy("stream").agg(F.median("c").alias("median"), F.count(F.lit(1)).alias("buckets"))
    spread = table.join(middles, "stream").groupBy("stream").agg(F.median(F.abs(F.col("c") - F.col("median"))).alias("mad"))
    near = table.where(F.col("b").between(anchor, min(anchor + horizon, grid.n) - 1)).join(middles, "stream").join(spread, "stream")
    c, m, sigma = F.col("c"), F.col("median"), F.col("mad") * series.MAD_SCALE
    z = F.try_divide(m - c, sigma)
    ratio = F.when(c == 0, m).otherwise(m / c)
    deep = F.when(sigma > 0, z >= series.SPIKE_Z).otherwise(ratio >= series.SPIKE_RATIO)
    strength = F.when(sigma > 0, z / (z + 4)).otherwise(1 - 1 / ratio)
    found = near.where((F.col("buckets") >= series.SPIKE_BUCKETS) & (m > 0) & (c < m) & (m - c >= series.DROP_LEAST) & deep).withColumn("strength", strength)
    best = Window.partitionBy("stream").orderBy(F.desc("strength"), "b")
    return found.withColumn("k", F.row_number().over(best)).where("k = 1").select("stream", F.col("b").alias("bucket"), "strength")


def nearest_trigger(triggers: DataFrame, anchor: int, window: int) -> dict | None:
    """The trigger closest to ``anchor`` within ``window`` seconds; the earliest of equals."""
    away = F.abs(F.col("epoch") - anchor)
    row = triggers.where(away <= window).orderBy(away, "epoch", "source").first()
    return row and {"source": row["source"], "epoch": row["epoch"]}


def timeline(streams: DataFrame, triggers: DataFrame | None = None) -> dict | None:
    """The incident that streams ``stream epoch`` tell of: ``anchor``, ``steps`` and ``confidence``; None if nothing leads.

    The anchor is the chain's root at the moment that its strongest link points
    to; a root of few events is a trigger, others are spikes. A trigger candidate
    near it takes its place, and lags count from there. Streams that break off
    within the horizon are steps too. Only links, drops and the trigger, a few
    rows, reach the driver.
    """
    grid = series.shared_grid(streams)
    if grid is None:
        return None
    links = [r.asDict() for r in series.correlate(streams, grid=grid).collect()]
    chain = series.incident_chain(links)
    if chain is None:
        return None
    root = chain["anchor"]
    edge = next((x for x in links if x["leader"] == root), links[0])
    anchor = edge["peak_epoch"] - edge["lag_seconds"]
    sizes = streams.groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n").alias("busiest"), F.max(F.when(F.col("stream") == root, F.col("n"))).alias("root")).first()
    kind = "trigger" if 0 < row["root"] <= TRIGGER_EVENTS and row["root"] * TRIGGER_SHARE <= row["busiest"] else "spike"
    steps = [{**s, "direction": "increase", "kind": "correlation"} for s in chain["steps"]]
    name = root
    near = nearest_trigger(triggers, anchor, max(2 * grid.width, *(s["lag_seconds"] for s in steps))) if triggers is not None else None
    if near:
        for s in steps:
            s["lag_seconds"] += anchor - near["epoch"]
        kind, name, anchor = "trigger", near["source"], near["epoch"]
    bucket = max(0, (anchor - grid.low) // grid.width)
    horizon = max(LEAST_HORIZON, HORIZON_LAGS * (max(s["lag_seconds"] for s in steps) // grid.width))
    for r in drops_after(streams, grid, bucket, horizon, [root, *(s["stream"] for s in steps)]).collect():
        steps.append({"stream": r["stream"], "lag_seconds": (r["bucket"] - bucket) * grid.width, "score": round(r["strength"], 4), "direction": "decrease", "kind": "anomaly"})
    steps.sort(key=lambda s: (s["lag_seconds"], s["stream"]))
    stamp = streams.sparkSession.range(1).select(iso_label(F.lit(anchor)).alias("t")).first()["t"]
    return {"anchor": {"kind": kind, "stream": name, "time": stamp}, "steps": steps, "confidence": round(min(s["score"] for s in steps), 4)}


STEP = "struct<lag_seconds:bigint,stream:string,score:double,direction:string,kind:string>"


def grids(counts: DataFrame) -> DataFrame:
    """``system``, ``low``, ``width``, ``n``, ``lags``: the grid of each system's events (``system``, ``epoch``, ``n`` of them); see :func:`.series.shared_grid`.

    Quartiles are exact nearest ranks: an hour that holds the rank is found
    first, then the second within it. Systems too short for a lag have no row.
    """
    hours = counts.groupBy("system", F.floor(F.col("epoch") / 3600).alias("h")).agg(F.sum("n").alias("n"), F.min("epoch").alias("low"), F.max("epoch").alias("high"))
    whole = Window.partitionBy("system")
    placed = hours.withColumn("before", F.sum("n").over(whole.orderBy("h")) - F.col("n")).withColumn("all", F.sum("n").over(whole)).withColumn("low", F.min("low").over(whole)).withColumn("high", F.max("high").over(whole))
    ranks = placed.select("*", F.explode(F.array(*(F.floor((F.col("all") - 1) * p + 0.5) for p in (0.25, 0.75)))).alias("rank"))
    hit = ranks.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("system", "h", "before", "rank", "low", "high")
    inside = counts.withColumn("h", F.floor(F.col("epoch") / 3600)).join(hit, ["system", "h"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("system", "rank").orderBy("epoch"))
    at = inside.withColumn("upto", upto).where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    told = at.groupBy("system").agg(F.min("epoch").alias("q1"), F.max("epoch").alias("q3"), F.first("low").alias("low"), F.first("high").alias("high"))
    reach = 3 * (F.col("q3") - F.col("q1"))
    even = F.col("q1") == F.col("q3")
    bounds = told.select("system", F.when(even, F.col("low")).otherwise(F.greatest("low", F.col("q1") - reach)).alias("low"), F.when(even, F.col("high")).otherwise(F.least("high", F.col("q3") + reach)).alias("high")).where("low < high")
    raw = F.floor((F.col("high") - F.col("low")) / series.GRID_TARGET)
    width = F.lit(NICE_WIDTHS[-1])
    for w in reversed(NICE_WIDTHS):
        width = F.when(raw <= w, F.lit(w)).otherwise(width)
    sized = bounds.withColumn("width", width.cast("long")).withColumn("n", (F.floor((F.col("high") - F.col("low")) / F.col("width")) + 1).cast("int"))
    lags = F.least(F.lit(series.MOST_LAG), F.col("n") - 1, F.floor(F.col("n") / 4), F.greatest(F.lit(1), F.floor(series.LAG_SECONDS / F.col("width")))).cast("int")
    return sized.withColumn("lags", lags).where((F.col("n") >= series.LEAST_OVERLAP) & (F.col("lags") >= 1))


def timelines(streams: DataFrame, triggers: DataFrame | None = None, top: int = series.TOP) -> DataFrame:
    """The incidents of many systems at once: :func:`timeline` for each ``system`` of ``system stream epoch`` and ``system source epoch``.

    ``system``, ``kind``, ``stream``, ``time`` (of the anchor), ``steps`` (by lag, then stream) and
    ``confidence``; systems that nothing leads in have no row. All systems go
    through one plan; a task sees two blocks of a system's streams as arrays, or a system's few links.
    """
    kind = streams.schema["system"].dataType.simpleString()
    counts = stored(streams.where("system IS NOT NULL AND stream IS NOT NULL AND epoch IS NOT NULL").groupBy("system", "stream", F.col("epoch").cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("c")), "counts")
    grid = stored(grids(counts.groupBy("system", "epoch").agg(F.sum("c").alias("n"))), "grids")
    inside = counts.join(grid, "system").where("epoch BETWEEN low AND high")
    binned = inside.groupBy("system", "stream", F.floor((F.col("epoch") - F.col("low")) / F.col("width")).cast("int").alias("b")).agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("lags").alias("lags"))
    arrays = binned.groupBy("system", "stream").agg(F.collect_list("b").alias("b"), F.collect_list("c").alias("c"), F.sum("c").alias("events"), F.first("n").alias("n"), F.first("lags").alias("lags"))
    arrays = stored(arrays.where(F.col("events") >= series.LEAST_EVENTS).drop("events"), "arrays")

    best = Window.partitionBy("system").orderBy(F.desc(F.round("r", 4)), "follower", "leader")
    links = series.pairs_within(arrays, top).withColumn("k", F.row_number().over(best)).where(F.col("k") <= top).join(grid, "system")
    sizes = counts.groupBy("system", "stream").agg(F.sum("c").alias("size"))

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["system", "root", "anchor", "links"]
        told = [{"leader": r["leader"], "follower": r["follower"], "lag_seconds": int(r["lag"] * r["width"]), "score": r["score"], "events_leader": int(r["events_leader"]), "peak_epoch": int(r["peak"] * r["width"] + r["low"])} for r in rows.sort_values("k").to_dict("records")]
        found = series.incident_chain(told)
        if found is None:
            return pd.DataFrame([], columns=names)
        edge = next((x for x in told if x["leader"] == found["anchor"]), told[0])
        steps = [{"lag_seconds": s["lag_seconds"], "stream": s["stream"], "score": s["score"], "direction": "increase", "kind": "correlation"} for s in found["steps"]]
        return pd.DataFrame([(rows["system"].iloc[0], found["anchor"], edge["peak_epoch"] - edge["lag_seconds"], steps)], columns=names)

    chains = links.withColumn("score", F.round("r", 4)).groupBy("system").applyInPandas(chain, f"system {kind}, root string, anchor long, links array<{STEP}>")
    busiest = sizes.groupBy("system").agg(F.max("size").alias("busiest"))
    roots = chains.join(sizes.withColumnRenamed("stream", "root"), ["system", "root"]).join(busiest, "system").join(grid, "system")
    longest = F.array_max(F.transform("links", lambda x: x["lag_seconds"]))
    trigger = (F.col("size") <= TRIGGER_EVENTS) & (F.col("size") * TRIGGER_SHARE <= F.col("busiest"))
    found = stored(roots.select("system", "root", "anchor", "links", "low", "width", "n", F.when(trigger, "trigger").otherwise("spike").alias("kind"), F.greatest(2 * F.col("width"), longest).alias("window")), "chains")

    name, moved = F.col("root"), F.lit(0).cast("long")
    if triggers is not None:
        away = F.abs(F.col("epoch") - F.col("anchor"))
        near = triggers.join(found.select("system", "anchor", "window"), "system").where(away <= F.col("window")).groupBy("system").agg(F.min(F.struct(away.alias("away"), "epoch", "source")).alias("near"))
        found = found.join(near, "system", "left")
        name, moved = F.coalesce("near.source", "root"), F.coalesce(F.col("anchor") - F.col("near.epoch"), F.lit(0))
        found = found.withColumn("kind", F.when(F.col("near").isNotNull(), "trigger").otherwise(F.col("kind")))
    told = found.withColumn("name", name).withColumn("moved", moved).withColumn("anchor", F.col("anchor") - F.col("moved"))
    told = told.withColumn("links", F.transform("links", lambda x: x.withField("lag_seconds", x["lag_seconds"] + F.col("moved"))))
    told = told.withColumn("bucket", F.greatest(F.lit(0), F.floor((F.col("anchor") - F.col("low")) / F.col("width"))).cast("int"))
    told = stored(told.withColumn("horizon", F.greatest(F.lit(LEAST_HORIZON), HORIZON_LAGS * F.floor(longest / F.col("width"))).cast("int")), "told")

    def broke_off(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                c = np.zeros(r["n"])
                c[r["b"]] = r["c"]
                middle = np.median(c)
                sigma = np.median(np.abs(c - middle)) * series.MAD_SCALE
                best = None
                for at in range(r["bucket"], min(r["bucket"] + r["horizon"], r["n"])):
                    less = middle - c[at]
                    z, ratio = less / sigma if sigma > 0 else 0.0, middle if c[at] == 0 else middle / c[at]
                    if middle > 0 and less >= series.DROP_LEAST and less > 0 and (z >= series.SPIKE_Z if sigma > 0 else ratio >= series.SPIKE_RATIO):
                        strength = z / (z + 4) if sigma > 0 else 1 - 1 / ratio
                        best = max(best or (-1.0, 0), (strength, -at))
                if best and r["n"] >= series.SPIKE_BUCKETS:
                    out.append((r["system"], -best[1], r["stream"], best[0]))
            yield pd.DataFrame(out, columns=["system", "at", "stream", "strength"]).astype({"at": "int64"})

    others = arrays.drop("n", "lags").join(told.select("system", "n", "bucket", "horizon", F.array_append(F.transform("links", lambda x: x["stream"]), F.col("root")).alias("own")), "system").where(~F.array_contains("own", F.col("stream"))).drop("own")
    drops = others.mapInPandas(broke_off, f"system {kind}, at long, stream string, strength double").join(told.select("system", "width", "bucket"), "system")
    lost = drops.groupBy("system").agg(F.collect_list(F.struct(((F.col("at") - F.col("bucket")) * F.col("width")).alias("lag_seconds"), "stream", F.round("strength", 4).alias("score"), F.lit("decrease").alias("direction"), F.lit("anomaly").alias("kind"))).alias("lost"))
    steps = F.array_sort(F.concat("links", F.coalesce("lost", F.array().cast(f"array<{STEP}>"))))
    every = told.join(lost, "system", "left").withColumn("steps", steps)
    return every.select("system", "kind", F.col("name").alias("stream"), iso_label(F.col("anchor")).alias("time"), "steps", F.round(F.array_min(F.transform("steps", lambda x: x["score"])), 4).alias("confidence"))
