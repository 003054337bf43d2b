"""Counts over time: histograms, spikes, drops, and lagged correlation of streams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType, TimestampType

from ..functions.timekey import auto_width
from ..session import discard, stored
from .ranking import values_of_ranks

# Fixed values of the spike, drop and correlation rules.
SPIKE_BUCKETS, SPIKE_Z, SPIKE_RATIO, SPIKE_LEAST, MAD_SCALE = 8, 4.0, 3.0, 10, 1.4826
DROP_LEAST = 5
SERIES_TARGET, SERIES_MOST = 120, 1000
GRID_TARGET, MOST_LAG, LAG_SECONDS, LEAST_OVERLAP, LEAST_EVENTS, LEAST_SCORE, TOP = 512, 128, 3600, 8, 3, 0.5, 3


def hour_histogram(epochs: DataFrame) -> DataFrame:
    """Events of each hour of the day; all 24 hours."""
    counts = epochs.groupBy(F.floor(F.pmod("epoch", F.lit(86400)) / 3600).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = epochs.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def weekday_histogram(epochs: DataFrame) -> DataFrame:
    """Events of each day of the week, 0 for Monday; all 7 days."""
    day = F.pmod(F.floor(F.col("epoch") / 86400) + 3, F.lit(7)).cast("int")
    counts = epochs.groupBy(day.alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    spine = epochs.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return spine.join(counts, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


def series_width(low: int, high: int) -> int:
    """Bucket width for about 120 buckets, 1000 at most."""
    span = high - low
    width = auto_width(span, SERIES_TARGET)
    return width if span // width < SERIES_MOST else span // SERIES_MOST + 1


def dense_series(epochs: DataFrame, width: int | None = None) -> DataFrame:
    """``bucket``, ``start``, ``n`` for every bucket from the first event to the last."""
    low, high = epochs.agg(F.min("epoch"), F.max("epoch")).first()
    if low is None:
        return epochs.sparkSession.createDataFrame([], "bucket long, start long, n long")
    width = width or series_width(low, high)
    counts = epochs.groupBy(F.floor((F.col("epoch") - low) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = epochs.sparkSession.range((high - low) // width + 1).withColumnRenamed("id", "bucket")
    return spine.join(counts, "bucket", "left").select("bucket", (F.col("bucket") * width + low).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def with_median_mad(series: DataFrame) -> DataFrame:
    """Add ``median`` and ``mad`` of ``n`` over all buckets, and their number ``buckets``.

    Counts are few different numbers, so exact percentiles come from a table of
    counts of counts.
    """
    one = series.agg(F.median("n").alias("median"), F.count(F.lit(1)).alias("buckets"))
    two = series.crossJoin(F.broadcast(one)).agg(F.median(F.abs(F.col("n") - F.col("median"))).alias("mad"))
    return series.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(two))


def peak(counts: DataFrame, at: str, last: bool = False) -> DataFrame:
    """One row (``at``, ``n``): the fullest bucket of a histogram; of equals the first, or with ``last`` the last. No row without an event.

    Hours and weekdays are named by the first of equals, a series by the last.
    """
    order = F.col(at) if last else -F.col(at)
    return counts.agg(F.max_by(at, F.struct("n", order)).alias(at), F.max("n").alias("n")).where("n > 0")


def spike_flags(series: DataFrame) -> DataFrame:
    """``series`` with ``spike``: whether the bucket is among its :func:`spikes`."""
    flagged = spikes(series).select("bucket", F.lit(True).alias("spike"))
    return series.join(F.broadcast(flagged), "bucket", "left").withColumn("spike", F.coalesce("spike", F.lit(False)))


def spikes(series: DataFrame) -> DataFrame:
    """Buckets far above the median: by robust z-score, or by ratio where the deviation is 0."""
    s = with_median_mad(series)
    n, m, sigma = F.col("n"), F.col("median"), F.col("mad") * MAD_SCALE
    z, ratio = F.try_divide(n - m, sigma), F.try_divide(n, m)
    by_ratio = F.coalesce(ratio, n.cast("double"))
    flagged = F.when(sigma > 0, z >= SPIKE_Z).otherwise((n - m >= SPIKE_LEAST) & ((m == 0) | (ratio >= SPIKE_RATIO)))
    return s.where((F.col("buckets") >= SPIKE_BUCKETS) & (n > m) & flagged).select("bucket", "start", "n", m.alias("baseline"), ratio.alias("ratio"), F.when(sigma > 0, z).otherwise(by_ratio).alias("score"))


def drops(series: DataFrame) -> DataFrame:
    """Buckets far below the median, with a strength from 0 to 1."""
    s = with_median_mad(series)
    n, m, sigma = F.col("n"), F.col("median"), F.col("mad") * MAD_SCALE
    z = F.try_divide(m - n, sigma)
    ratio = F.when(n == 0, m).otherwise(m / n)
    flagged = F.when(sigma > 0, z >= SPIKE_Z).otherwise(ratio >= SPIKE_RATIO)
    strength = F.when(sigma > 0, z / (z + 4)).otherwise(1 - 1 / ratio)
    return s.where((F.col("buckets") >= SPIKE_BUCKETS) & (m > 0) & (m - n >= DROP_LEAST) & flagged).select("bucket", "start", "n", m.alias("baseline"), strength.alias("strength"))


def robust_bounds(epochs: DataFrame) -> tuple[int, int] | None:
    """Least and greatest epoch within three interquartile ranges of the quartiles (nearest rank).

    Equal epochs are counted once and the counts stored, so that the source is read in one pass.
    """
    counts = stored(epochs.where("epoch IS NOT NULL").groupBy("epoch").agg(F.count(F.lit(1)).alias("n")), "epochs")
    row = counts.agg(F.sum("n").alias("n"), F.min("epoch").alias("low"), F.max("epoch").alias("high")).first()
    if not row["n"]:
        return None
    q1, q3 = values_of_ranks(counts, "epoch", [int((row["n"] - 1) * p + 0.5) for p in (0.25, 0.75)], "n")
    discard(counts)
    if q1 == q3:
        return row["low"], row["high"]
    return max(row["low"], q1 - 3 * (q3 - q1)), min(row["high"], q3 + 3 * (q3 - q1))


@dataclass(frozen=True)
class Grid:
    """Buckets that all streams share: the first second, the width, how many there are, and the most lag tried."""

    low: int
    high: int
    width: int
    n: int
    most_lag: int


def shared_grid(streams: DataFrame) -> Grid | None:
    """The grid of event streams; None if it is too short for a lag."""
    bounds = robust_bounds(streams)
    if bounds is None or bounds[0] == bounds[1]:
        return None
    low, high = bounds
    width = auto_width(high - low, GRID_TARGET)
    n = (high - low) // width + 1
    most = min(MOST_LAG, n - 1, n // 4, max(1, LAG_SECONDS // width))
    return Grid(low, high, width, n, most) if n >= LEAST_OVERLAP and most >= 1 else None


def on_grid(streams: DataFrame, grid: Grid) -> DataFrame:
    """``stream``, ``b``, ``c``: the count of every bucket of every stream of three events or more on the grid."""
    inside = streams.where(F.col("epoch").between(grid.low, grid.high))
    counts = inside.groupBy("stream", F.floor((F.col("epoch") - grid.low) / grid.width).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    names = counts.groupBy("stream").agg(F.sum("c").alias("events")).where(F.col("events") >= LEAST_EVENTS)
    # At most a few thousand buckets for each stream.
    spine = names.select("stream", F.explode(F.sequence(F.lit(0), F.lit(grid.n - 1))).alias("b"))
    return spine.join(counts, ["stream", "b"], "left").select("stream", "b", F.coalesce("c", F.lit(0)).alias("c"))


LINKS = "leader string, follower string, lag_seconds long, score double, events_leader long, events_follower long, width_seconds long, peak_epoch long"


#: Streams that a task compares with as many others at once.
BLOCK = 64


def moments(counts: np.ndarray, lags: int) -> dict[str, np.ndarray]:
    """Of each row of dense counts, and each lag, the sums over the leader's window (all but the last ``lag``) and the follower's (all but the first)."""
    events, n = np.cumsum(counts, axis=1), counts.shape[1]
    # A whole number is taken off each count, which changes no correlation, and keeps sums exact.
    middle = np.rint(counts.mean(axis=1, keepdims=True))
    centred = (counts - middle).astype(np.float64)
    sums, squares = np.cumsum(centred, axis=1), np.cumsum(centred * centred, axis=1)
    ends = n - 1 - np.arange(lags + 1)
    out = {"centred": centred, "mean": counts.sum(axis=1) / n, "events": events[:, -1]}
    for name, running in (("events", events), ("sums", sums), ("squares", squares)):
        before = np.concatenate([np.zeros((len(counts), 1)), running[:, :lags]], axis=1)
        out[f"leader_{name}"], out[f"follower_{name}"] = running[:, ends], running[:, -1:] - before
    return out


def correlations(a: dict[str, np.ndarray], b: dict[str, np.ndarray], lag: int) -> np.ndarray:
    """Pearson's r of each row of ``a`` with each row of ``b`` that is ``lag`` buckets later; -1 where the windows do not suffice."""
    k = a["centred"].shape[1] - lag
    products = a["centred"][:, :k] @ b["centred"][:, lag:].T
    x, y = a["leader_sums"][:, lag], b["follower_sums"][:, lag]
    u, v = k * a["leader_squares"][:, lag] - x * x, k * b["follower_squares"][:, lag] - y * y
    fit = [(m[f"{side}_events"][:, lag] >= LEAST_EVENTS) & (w / k / k > 1e-9) for m, side, w in ((a, "leader", u), (b, "follower", v))]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (k * products - np.outer(x, y)) / np.sqrt(np.outer(u, v))
    return np.where(np.outer(fit[0], fit[1]) & (k >= LEAST_OVERLAP), r, -1.0)


PAIRS = "leader string, follower string, lag long, r double, events_leader long, events_follower long, peak long"


def best_pairs(names: list[list[str]], counts: list[np.ndarray], lags: int, top: int) -> list[tuple]:
    """Rows of ``PAIRS``: of the streams of one block (one list), or of two blocks with each other, the pairs that can be among the ``top``."""
    own = [moments(c, lags) for c in counts]
    a, b = own[0], own[-1]
    left, right = np.array(names[0], dtype=object), np.array(names[-1], dtype=object)
    pairs = np.triu(np.ones((len(left), len(right)), bool), 1) if len(own) == 1 else np.ones((len(left), len(right)), bool)
    left_first = left[:, None] < right[None, :]
    best, lag_of, left_leads = np.full(pairs.shape, -1.0), np.zeros(pairs.shape, int), np.zeros(pairs.shape, bool)
    for lag in range(lags + 1):
        there = correlations(a, b, lag)
        back = there.T if len(own) == 1 else correlations(b, a, lag).T
        leads = (there > back) | ((there == back) & left_first)
        r = np.maximum(there, back)
        # Of equal ones the longer lag.
        better = pairs & (r >= best) & (r >= LEAST_SCORE)
        best[better], lag_of[better], left_leads[better] = r[better], lag, leads[better]
    found = []
    for i, j in zip(*np.nonzero(best >= LEAST_SCORE)):
        one, two = (a, i, left[i]), (b, j, right[j])
        leader, follower = (one, two) if left_leads[i, j] else (two, one)
        found.append((round(best[i, j], 4), follower[2], leader[2], best[i, j], int(lag_of[i, j]), leader, follower))
    found.sort(key=lambda x: (-x[0], x[1], x[2]))
    # Rounding may tell neighbours apart in another way elsewhere, so some of each score stay.
    least = found[top - 1][0] - 2e-4 if len(found) >= top else -1.0
    kept, seen = [], Counter()
    for score, fname, lname, r, lag, (l, i, _), (f, j, _) in found:
        seen[score] += 1
        if score >= least and seen[score] <= top:
            n = l["centred"].shape[1] - lag
            # Back to counts: exact, as whole numbers were taken off.
            together = (counts_of(l, i)[:n] - l["mean"][i]) * (counts_of(f, j)[lag:] - f["mean"][j])
            kept.append((lname, fname, lag, float(r), int(l["events"][i]), int(f["events"][j]), int(np.argmax(together)) + lag))
    return kept


def counts_of(told: dict[str, np.ndarray], i: int) -> np.ndarray:
    centred = told["centred"][i]
    return centred + np.rint((told["events"][i] - centred.sum()) / len(centred))


def pairs_within(arrays: DataFrame, top: int) -> DataFrame:
    """``system`` and ``PAIRS``: of all pairs of streams of each system those that can be among its ``top``.

    ``arrays`` has a row a stream: ``system``, ``stream``, its buckets ``b`` with counts ``c``, and
    its system's number of buckets ``n`` and most ``lags``. A system's streams are dealt into blocks.
    """
    kind = arrays.schema["system"].dataType
    blocks = arrays.groupBy("system").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("stream"), F.col("blocks")).cast("int").alias("own")
    dealt = arrays.join(blocks, "system").select("system", "stream", "b", "c", "n", "lags", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    kinds = [to_arrow_type(kind), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    columns = ["system", *(x.split()[0] for x in PAIRS.split(", "))]

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names: dict[int, list[str]] = {}
        dense: dict[int, list[np.ndarray]] = {}
        n, lags = table.column("n")[0].as_py(), table.column("lags")[0].as_py()
        for name, b, c, block in zip(*(table.column(k).to_pylist() for k in ("stream", "b", "c", "own"))):
            row = np.zeros(n, dtype=np.int64)
            row[b] = c
            names.setdefault(block, []).append(name)
            dense.setdefault(block, []).append(row)
        found = []
        if len(names) == (1 if key[1].as_py() == key[2].as_py() else 2):
            found = best_pairs(list(names.values()), [np.stack(x) for x in dense.values()], lags, top)
        told = list(zip(*((key[0].as_py(), *f) for f in found))) or [[]] * 8
        return pa.table([pa.array(c, k) for c, k in zip(told, kinds)], names=columns)

    return dealt.groupBy("system", "x", "y").applyInArrow(compare, f"system {kind.simpleString()}, {PAIRS}")


def correlate(streams: DataFrame, top: int = TOP, grid: Grid | None = None) -> DataFrame:
    """Lagged correlations of the event streams ``stream``, ``epoch``, the best lag of each pair; the ``top`` of them.

    ``leader``, ``follower``, ``lag_seconds``, ``score`` (4 places), ``events_leader``,
    ``events_follower``, ``width_seconds``, and ``peak_epoch``: the start of the follower's
    bucket where both deviate most together, the first of equals. Counts on a shared grid are standardised
    per stream; for each lag Pearson's r is taken over the buckets that overlap.
    The lags stay within an hour, 128 buckets and a quarter of the grid; both
    windows need 3 events, and r must be 0.5 or more. Null streams are left out.

    A stream is one array of counts, a few hundred numbers. Streams are dealt into
    blocks; a task gets two blocks and takes all lags of all their pairs from
    running sums and one product of matrices a lag, so that neither pairs nor
    lags nor buckets are rows. Only pairs that can be among the ``top`` leave it.
    """
    grid = grid or shared_grid(streams)
    if grid is None:
        return streams.sparkSession.createDataFrame([], LINKS)
    inside = streams.where(F.col("stream").isNotNull() & F.col("epoch").between(grid.low, grid.high))
    counts = inside.groupBy("stream", F.floor((F.col("epoch") - grid.low) / grid.width).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    arrays = counts.groupBy("stream").agg(F.collect_list("b").alias("b"), F.collect_list("c").alias("c"), F.sum("c").alias("n")).where(F.col("n") >= LEAST_EVENTS)
    arrays = stored(arrays.select(F.lit(0).alias("system"), "stream", "b", "c", F.lit(int(grid.n)).alias("n"), F.lit(int(grid.most_lag)).alias("lags")), "streams")
    pairs = pairs_within(arrays, top)
    links = pairs.orderBy(F.desc(F.round("r", 4)), "follower", "leader").limit(top)
    return links.select(
        "leader", "follower", (F.col("lag") * grid.width).alias("lag_seconds"), F.round("r", 4).alias("score"), "events_leader", "events_follower", F.lit(grid.width).cast("long").alias("width_seconds"), (F.col("peak") * grid.width + grid.low).cast("long").alias("peak_epoch")
    ).orderBy(F.desc("score"), "follower", "leader")


def incident_chain(links: list[dict], horizon: int | None = None) -> dict | None:
    """The incident that a few correlation links tell of: root, steps by least total lag, confidence.

    ``links``: at most a handful of rows of :func:`correlate`. The root leads but
    never follows; of several the one of fewest events; else the strongest link's leader.
    """
    if not links:
        return None
    followers = {x["follower"] for x in links}
    roots = [x for x in links if x["leader"] not in followers]
    root = min(roots, key=lambda x: (x["events_leader"], x["leader"]))["leader"] if roots else max(links, key=lambda x: x["score"])["leader"]
    reached = {root: (0, 1.0)}
    for _ in links:
        for x in links:
            if x["leader"] in reached:
                lag, score = reached[x["leader"]]
                new = (lag + x["lag_seconds"], min(score, x["score"]))
                if x["follower"] != root and (x["follower"] not in reached or new[0] < reached[x["follower"]][0]):
                    reached[x["follower"]] = new
    steps = sorted(({"stream": s, "lag_seconds": v[0], "score": v[1]} for s, v in reached.items() if s != root), key=lambda x: (x["lag_seconds"], x["stream"]))
    return {"anchor": root, "steps": steps, "confidence": min(x["score"] for x in steps)} if steps else None


#: Stretches of time that rows are dealt into, so that few keys, or none, are many tasks.
STRETCHES = 1024


def latest_before(events: DataFrame, stamps: DataFrame, by: list[str], at: str, stamp: str) -> DataFrame:
    """As-of join: each event with the latest stamp at or before it; events before the first stamp are dropped.

    Numbers and timestamps are dealt into ``STRETCHES`` equal stretches: each
    takes over the latest stamp of those before it (a row a key and stretch), and
    events look for a later one in their own. Rows without a time or stamp have no match.
    """
    both = events.where(F.col(at).isNotNull()).select(*by, at, F.lit(1).alias("_e"), F.lit(None).cast(stamps.schema[stamp].dataType).alias("_s")).unionByName(stamps.where(F.col(stamp).isNotNull()).select(*by, F.col(stamp).alias(at), F.lit(0).alias("_e"), F.col(stamp).alias("_s")))
    place = F.lit(0)
    if isinstance(both.schema[at].dataType, (NumericType, TimestampType)):
        low, high = both.agg(F.min(F.col(at).cast("double")), F.max(F.col(at).cast("double"))).first()
        if low is not None and high > low:
            place = F.floor((F.col(at).cast("double") - low) / (high - low) * STRETCHES).cast("int")
    dealt = both.withColumn("_p", place)
    lasts = dealt.groupBy(*by, "_p").agg(F.max("_s").alias("_m"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_c", F.max("_m").over(before)).drop("_m")
    upto = Window.partitionBy(*by, "_p").orderBy(at, "_e").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_l", F.max("_s").over(upto)).where("_e = 1").alias("own")
    same = F.col("own._p") == F.col("c._p")
    for b in by:
        same = same & F.col(f"own.{b}").eqNullSafe(F.col(f"c.{b}"))
    found = own.join(carried.alias("c"), same, "left").select(*(F.col(f"own.{c}").alias(c) for c in (*by, at)), F.coalesce("own._l", "c._c").alias(stamp))
    return found.where(F.col(stamp).isNotNull())


def first_after(triggers: DataFrame, errors: DataFrame, by: list[str], at: str, tolerance: int = 3600) -> DataFrame:
    """Each trigger with the first error later than it, by ``tolerance`` seconds at most: ``at``, ``lag``.

    Rows meet in stretches of ``tolerance`` seconds; errors are in their own and
    in the one before, so that no key and no long time comes to one task.
    """
    stretch = F.floor(F.col(at) / tolerance)
    both = triggers.select(*by, at, stretch.alias("_p"), F.lit(1).alias("_t")).unionByName(errors.distinct().select(*by, at, F.explode(F.array(stretch, stretch - 1)).alias("_p"), F.lit(0).alias("_t")))
    after = Window.partitionBy(*by, "_p").orderBy(F.col(at)).rangeBetween(1, tolerance)
    return both.withColumn("_f", F.min(F.when(F.col("_t") == 0, F.col(at))).over(after)).where("_t = 1 AND _f IS NOT NULL").select(*by, at, (F.col("_f") - F.col(at)).alias("lag"))


def median_lag(triggers: DataFrame, errors: DataFrame, by: list[str], at: str = "epoch") -> int | None:
    """The upper median of the lags from each trigger to its first error; None without any."""
    found = stored(first_after(triggers, errors, by, at).groupBy("lag").agg(F.count(F.lit(1)).alias("n")), "lags")
    n = found.agg(F.sum("n")).first()[0]
    return values_of_ranks(found, "lag", [n // 2], "n")[0] if n else None


def envelope(points: DataFrame, columns: int, index: str = "i", value: str = "v") -> DataFrame:
    """``min``, ``max``, ``mean`` of ``value`` in each of ``columns`` stretches of equal length of the dense ``index``."""
    n = points.count()
    place = F.floor((F.col(index) * columns + columns - 1) / n)
    place = F.when(F.floor(place * n / columns) <= F.col(index), place).otherwise(place - 1)
    return points.groupBy(F.least(place, F.lit(columns - 1)).alias("column")).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
