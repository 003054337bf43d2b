"""Registered queries over the driver's tables, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..functions import timekey
from ..operators import file_events, logs, netflow, series, similarity, summary_diff, tabular, text_safety
from ..session import delete_at_end, scratch
from ..sources import csv, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(column: str) -> Column:
    """Unix seconds of a zone-less timestamp, rounded down; no session zone takes part."""
    day = F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.floor(F.second(column)).cast("long")


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), _seconds("ts").alias("epoch"))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of events: ISO stamp, level word and message."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "warning").when(F.col("event_type") == "purchase", "[Info]").when(F.col("event_type") == "view", "DEBUG:").otherwise("level=error,")
    stamp = timekey.iso_label(_seconds("ts"))
    return _table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", stamp, level, F.concat(F.lit("user "), F.col("user_id"))).alias("value"))


E = "epoch_us(ts) // 1000000"
LINES = """lines AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN '[Info]' WHEN 'view' THEN 'DEBUG:' ELSE 'level=error,' END || ' user ' || user_id AS value FROM events)"""


@query("SELECT event_type AS key, count(*) AS count, sum(value) AS sum_value, avg(value) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM events WHERE value > 10 GROUP BY 1")
def events_groupby(spark, sf_dir):
    return tabular.group_by(_table(spark, sf_dir, "events"), "event_type", "sum:value,mean:value,min:value,max:value", "value>10")


@query("SELECT o_orderpriority AS key, count(*) AS count, sum(o_totalprice) AS sum_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders WHERE o_orderstatus != 'F' GROUP BY 1")
def orders_groupby_text_filter(spark, sf_dir):
    return tabular.group_by(_table(spark, sf_dir, "orders"), "o_orderpriority", "sum:o_totalprice,max:o_totalprice", "o_orderstatus!=F")


@query("SELECT l_returnflag AS key, count(*) AS count, avg(l_extendedprice) AS mean_l_extendedprice, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1")
def lineitem_groupby(spark, sf_dir):
    return tabular.group_by(_table(spark, sf_dir, "lineitem"), "l_returnflag", "mean:l_extendedprice,sum:l_quantity")


@query("SELECT * FROM orders WHERE o_totalprice >= 400000 ")
def orders_where(spark, sf_dir):
    return tabular.where(_table(spark, sf_dir, "orders"), "o_totalprice>=400000")


def _profile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, sum({c})::DOUBLE AS sum FROM {table}" for c in columns)


@query(_profile_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def profile_numbers(spark, sf_dir):
    table = _table(spark, sf_dir, "lineitem")
    return tabular.profile_numbers(table, tabular.number_columns(table))


@query("""WITH c AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
n AS (SELECT name, value, count(*) AS k FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC, value) AS p FROM n)
SELECT name, sum(k)::BIGINT AS count, count(*) AS "unique", list(value ORDER BY p) FILTER (p <= 3) AS top_values, list(k ORDER BY p) FILTER (p <= 3) AS top_counts FROM r GROUP BY name""")
def profile_texts(spark, sf_dir):
    found = tabular.profile_texts(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return found.select("name", "count", "unique", F.col("top.value").alias("top_values"), F.col("top.count").alias("top_counts"))


@query("""SELECT 'k' AS name, 'number' AS kind, count(*) AS count, 0::BIGINT AS null_count, min(v) AS min, max(v) AS max, avg(v) AS mean, sum(v) AS sum, 0::BIGINT AS "unique" FROM (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events)""")
def json_profile(spark, sf_dir):
    found = tabular.json_profile(_table(spark, sf_dir, "events"), "props")
    return found.select("name", "kind", "count", "null_count", "min", "max", "mean", "sum", F.coalesce("unique", F.lit(0)).alias("unique"))


@query("""SELECT 'value' AS name, count(*) AS count, count(*) - count(value) AS null_count, min(value) AS min, max(value) AS max FROM events
UNION ALL SELECT 'user_id', count(*), count(*) - count(user_id), min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events""")
def column_statistics(spark, sf_dir):
    found = readers.parquet_statistics(_table(spark, sf_dir, "events").select("value", "user_id"))
    return found.select("name", "count", "null_count", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))


@query(f"SELECT h.range::INT AS hour, count({E}) AS n FROM range(24) h LEFT JOIN events ON hour(ts) = h.range GROUP BY 1")
def time_hours(spark, sf_dir):
    return series.hour_histogram(_epochs(spark, sf_dir))


@query("SELECT d.range::INT AS weekday, count(ts) AS n FROM range(7) d LEFT JOIN events ON isodow(ts) - 1 = d.range GROUP BY 1")
def time_weekdays(spark, sf_dir):
    return series.weekday_histogram(_epochs(spark, sf_dir))


SERIES = f"""e AS (SELECT {E} AS epoch FROM events), b AS (SELECT min(epoch) AS low, max(epoch) AS high FROM e),
s AS (SELECT k.range AS bucket, low + k.range * 21600 AS start FROM b, LATERAL (SELECT unnest(range(0, (high - low) // 21600 + 1)) AS range) k),
c AS (SELECT (epoch - low) // 21600 AS bucket, count(*) AS n FROM e, b GROUP BY 1),
series AS (SELECT s.bucket, start, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (bucket))"""


@query(f"WITH {SERIES} SELECT * FROM series")
def time_series(spark, sf_dir):
    return series.dense_series(_epochs(spark, sf_dir))


@query("""WITH t AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) // 7 AS bucket, count(*) AS k FROM orders GROUP BY 1),
s AS (SELECT bucket, CASE WHEN bucket % 40 = 3 THEN k * 5 ELSE k END AS n FROM t), m AS (SELECT median(n) AS med, count(*) AS c FROM s), d AS (SELECT median(abs(n - med)) AS mad FROM s, m)
SELECT bucket, n, med AS baseline, n / med AS ratio, (n - med) / (mad * 1.4826) AS score FROM s, m, d WHERE c >= 8 AND n > med AND (n - med) / (mad * 1.4826) >= 4""")
def spikes(spark, sf_dir):
    week = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 7)
    weeks = _table(spark, sf_dir, "orders").groupBy(week.alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
    planted = weeks.select("bucket", F.col("bucket").alias("start"), F.when(F.col("bucket") % 40 == 3, F.col("k") * 5).otherwise(F.col("k")).alias("n"))
    return series.spikes(planted).drop("start")


@query("""WITH t AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) // 28 AS bucket, count(*) AS k FROM orders GROUP BY 1),
s AS (SELECT bucket, CASE WHEN bucket % 20 = 3 THEN k // 20 ELSE k END AS n FROM t), m AS (SELECT median(n) AS med, count(*) AS c FROM s), d AS (SELECT median(abs(n - med)) AS mad FROM s, m),
z AS (SELECT *, (med - n) / (mad * 1.4826) AS z FROM s, m, d)
SELECT bucket, n, med AS baseline, z / (z + 4) AS strength FROM z WHERE c >= 8 AND med > 0 AND med - n >= 5 AND z >= 4""")
def drops(spark, sf_dir):
    month = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 28)
    months = _table(spark, sf_dir, "orders").groupBy(month.alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
    planted = months.select("bucket", F.col("bucket").alias("start"), F.when(F.col("bucket") % 20 == 3, F.floor(F.col("k") / 20)).otherwise(F.col("k")).alias("n"))
    return series.drops(planted).drop("start")


@query(f"""WITH {LINES}, m AS (SELECT value, regexp_extract(value, '^\\S+ (\\S+)', 1) AS w FROM lines),
c AS (SELECT count(*) AS k, count(*) FILTER (w = 'DEBUG:') AS d, count(*) FILTER (w = '[Info]') AS i, count(*) FILTER (w = 'warning') AS wa, count(*) FILTER (w = 'ERROR') AS e FROM m)
SELECT unnest(['DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL']) AS level, unnest([d, i, wa, e, 0]) AS count, unnest([d * 100.0::DOUBLE / k, i * 100.0::DOUBLE / k, wa * 100.0::DOUBLE / k, e * 100.0::DOUBLE / k, 0.0::DOUBLE]) AS percent FROM c""")
def log_severity(spark, sf_dir):
    return logs.severity(_log_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT event_id, value AS text FROM lines WHERE value LIKE '% ERROR %' ORDER BY event_id LIMIT 5")
def log_samples(spark, sf_dir):
    return logs.worst_lines(_log_lines(spark, sf_dir), "event_id")


@query(f"SELECT event_id, {E} AS epoch FROM events")
def log_epochs(spark, sf_dir):
    return timekey.line_epochs(_log_lines(spark, sf_dir), "iso8601").select("event_id", "epoch")


@query(f"""WITH a AS (SELECT {E} AS epoch, event_type, user_id FROM events), e AS (SELECT user_id, epoch FROM a WHERE event_type = 'error'), t AS (SELECT DISTINCT user_id, epoch AS stamp FROM a WHERE event_type = 'signup')
SELECT e.user_id, e.epoch, max(stamp) AS stamp, count(*) // count(DISTINCT stamp) AS copies FROM e JOIN t ON e.user_id = t.user_id AND stamp <= epoch GROUP BY ALL""")
def asof_backward(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", _seconds("ts").alias("epoch"))
    stamps = events.where("event_type = 'signup'").select("user_id", F.col("epoch").alias("stamp"))
    found = series.latest_before(events.where("event_type = 'error'"), stamps, ["user_id"], "epoch", "stamp")
    return found.groupBy("user_id", "epoch", "stamp").agg(F.count(F.lit(1)).alias("copies"))


@query(f"""WITH a AS (SELECT {E} AS epoch, event_type FROM events), t AS (SELECT epoch FROM a WHERE event_type = 'signup'), e AS (SELECT epoch AS f FROM a WHERE event_type = 'error')
SELECT epoch, min(f) - epoch AS lag FROM (SELECT DISTINCT epoch FROM t) JOIN e ON f > epoch AND f <= epoch + 3600 GROUP BY epoch""")
def asof_forward(spark, sf_dir):
    epochs = _epochs(spark, sf_dir)
    found = series.first_after(epochs.where("stream = 'signup'"), epochs.where("stream = 'error'"), [], "epoch")
    return found.select("epoch", "lag").distinct()


FLOWS = "flows AS (SELECT l_suppkey AS src, l_partkey AS dst, l_linenumber % 2 * 11 + 6 AS proto, CAST(floor(l_quantity * 100) AS BIGINT) AS bytes FROM lineitem)"


def _flows(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") % 2 * 11 + 6).alias("proto"), F.floor(F.col("l_quantity") * 100).alias("bytes"))


@query(f"WITH {FLOWS} SELECT count(*) AS packets, sum(bytes)::BIGINT AS bytes, count(*) FILTER (proto = 6) AS tcp, count(*) FILTER (proto = 17) AS udp, count(DISTINCT (src, dst)) AS pairs FROM flows")
def flow_totals(spark, sf_dir):
    return netflow.totals(_flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT src, dst, sum(bytes)::BIGINT AS metric FROM flows GROUP BY ALL ORDER BY metric DESC, src, dst LIMIT 5")
def flow_talkers(spark, sf_dir):
    return netflow.top(netflow.pair_bytes(_flows(spark, sf_dir)), ["src", "dst"])


@query(f"WITH {FLOWS} SELECT src, count(DISTINCT dst) AS metric FROM flows GROUP BY src ORDER BY metric DESC, src LIMIT 5")
def flow_fan_out(spark, sf_dir):
    return netflow.top(netflow.fan_out(netflow.pair_bytes(_flows(spark, sf_dir))), ["src"])


@query(f"WITH {FLOWS} SELECT dst, count(DISTINCT src) AS metric FROM flows GROUP BY dst ORDER BY metric DESC, dst LIMIT 5")
def flow_fan_in(spark, sf_dir):
    return netflow.top(netflow.fan_in(netflow.pair_bytes(_flows(spark, sf_dir))), ["dst"])


@query(f"WITH {FLOWS}, p AS (SELECT sum(bytes) AS metric FROM flows GROUP BY src, dst), r AS (SELECT metric, row_number() OVER (ORDER BY metric) - 1 AS k, count(*) OVER () AS n FROM p) SELECT metric::BIGINT AS baseline FROM r WHERE k = (n - 1) // 2")
def flow_baseline(spark, sf_dir):
    return netflow.baseline_without_top(netflow.pair_bytes(_flows(spark, sf_dir)))


#: Orders before and after a day as two runs; names take in the month, so that some are in one run only.
HALVES = "SELECT o_orderpriority || ' ' || month(o_orderdate) AS name, o_totalprice AS v, CASE WHEN o_orderdate >= TIMESTAMP '1994-09-15' THEN 1 ELSE 0 END AS half FROM orders"


def _runs(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("name", F.concat_ws(" ", "o_orderpriority", F.month("o_orderdate").cast("string")))
    late = F.col("o_orderdate").cast("date") >= F.lit("1994-09-15").cast("date")
    return [orders.where(~late), orders.where(late)]


@query(f"""WITH h AS ({HALVES}), s AS (SELECT half, name, count(*) AS count, min(v) AS min, max(v) AS max, avg(v) AS mean, sum(v) AS sum FROM h GROUP BY ALL),
a AS (SELECT * FROM s WHERE half = 0), b AS (SELECT * FROM s WHERE half = 1)
SELECT CASE WHEN a.name IS NULL THEN '[appeared] ' || b.name WHEN b.name IS NULL THEN '[disappeared] ' || a.name ELSE b.name END AS name, coalesce(b.count, a.count) AS count, b.min - a.min AS min, b.max - a.max AS max, b.mean - a.mean AS mean, b.sum - a.sum AS sum FROM a FULL JOIN b ON a.name = b.name""")
def diff_numbers(spark, sf_dir):
    v = F.col("o_totalprice")
    parts = [run.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum")) for run in _runs(spark, sf_dir)]
    return summary_diff.diff_numbers(*parts)


@query(f"""WITH h AS ({HALVES}), s AS (SELECT half, name, count(*) AS count FROM h GROUP BY ALL), a AS (SELECT * FROM s WHERE half = 0), b AS (SELECT * FROM s WHERE half = 1)
SELECT CASE WHEN a.name IS NULL THEN '[appeared] ' || b.name WHEN b.name IS NULL THEN '[disappeared] ' || a.name WHEN b.count > a.count THEN '+' || b.name ELSE '-' || b.name END AS name, coalesce(abs(b.count - a.count), b.count, a.count) AS count
FROM a FULL JOIN b ON a.name = b.name WHERE a.count IS NULL OR b.count IS NULL OR a.count <> b.count""")
def diff_counts(spark, sf_dir):
    parts = [run.groupBy("name").agg(F.count(F.lit(1)).alias("count")) for run in _runs(spark, sf_dir)]
    return summary_diff.diff_counts(*parts)


QUERY_VECTOR = [((7 * i) % 11 - 5) / 10 for i in range(64)]


@query(f"""WITH q AS (SELECT {QUERY_VECTOR}::DOUBLE[] AS q), m AS (SELECT max(vec_id) AS newest FROM embeddings)
SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) * (0.85 + 0.15 * (1 - (newest - vec_id) / greatest(1, newest))) AS score FROM embeddings, q, m
WHERE list_cosine_similarity(embedding::DOUBLE[], q) * (0.85 + 0.15 * (1 - (newest - vec_id) / greatest(1, newest))) > 0.01 ORDER BY score DESC LIMIT 10""")
def vector_top_k(spark, sf_dir):
    return similarity.top_k(_table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 10, order="vec_id").select("vec_id", "score")


@query("""SELECT doc_id, list_distinct(list_filter(string_split(text, chr(10)), lambda l: strlen(l) <= 256 AND (contains(l, 'Licensed') OR contains(l, 'token')))) .len() AS n_lines FROM documents
WHERE contains(text, 'Licensed') OR contains(text, 'token')""")
def keyword_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").where(F.contains("text", F.lit("Licensed")) | F.contains("text", F.lit("token")))
    return similarity.keyword_lines(docs, "Licensed token", most=1_000_000).select("doc_id", F.size("lines").cast("long").alias("n_lines"))


@query("""WITH t AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS w, lower(text) AS l, text FROM conversations)
SELECT conv_id, turn, (CASE WHEN contains(l, 'system:') THEN 2 ELSE 0 END + CASE WHEN contains(l, 'user:') THEN 2 ELSE 0 END + CASE WHEN contains(l, 'assistant:') THEN 2 ELSE 0 END
 + CASE WHEN contains(w, ' system ') THEN 1 ELSE 0 END + CASE WHEN contains(l, '<|') THEN 2 ELSE 0 END + CASE WHEN contains(l, '|>') THEN 2 ELSE 0 END
 + CASE WHEN contains(w, ' ignore ') THEN 1 ELSE 0 END + CASE WHEN contains(w, ' disregard ') THEN 2 ELSE 0 END) AS injection_score, regexp_matches(text, 'AKIA[A-Z0-9]{16,}(\\s|$)') AS has_key FROM t""")
def text_safety_scores(spark, sf_dir):
    found = text_safety.scan_texts(_table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "injection_score", (F.col("n_leaks") > 0).alias("has_key"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*(>|$)|>', '', 'g')) AS n_chars, len(list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]*(>|$)|>', '', 'g'), '\\s+'), lambda w: w <> '')) AS n_words FROM pages")
def page_texts(spark, sf_dir):
    text = T.strip_html(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), T.word_count(text).cast("long").alias("n_words"))


@query("""SELECT doc_id, CAST(ceil(length(text) / CASE WHEN length(regexp_replace(text, '[^{}();=<>]', '', 'g')) > length(text) // 20 THEN 3.2::DOUBLE ELSE 3.8::DOUBLE END) AS BIGINT) AS tokens FROM documents""")
def token_estimates(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT c_custkey, ((c_custkey * 2654435761) % 4294967296) // 16777216 || '.' || ((c_custkey * 2654435761) % 4294967296) // 65536 % 256 || '.' || ((c_custkey * 2654435761) % 4294967296) // 256 % 256 || '.' || (c_custkey * 2654435761) % 256 AS address FROM customer")
def addresses(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", T.ipv4(F.col("c_custkey") * F.lit(2654435761) % F.lit(4294967296)).alias("address"))


@query("""WITH p AS (SELECT event_id AS i, value AS v FROM events), n AS (SELECT count(*) AS n FROM p), c AS (SELECT range AS c FROM range(48))
SELECT c AS "column", min(v) AS min, max(v) AS max, avg(v) AS mean FROM p, n, c WHERE i >= c * n // 48 AND i < (c + 1) * n // 48 GROUP BY c""")
def column_envelope(spark, sf_dir):
    points = _table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"))
    return series.envelope(points, 48)


@query(f"""WITH e AS (SELECT event_type AS stream, {E} AS epoch FROM events), r AS (SELECT epoch, row_number() OVER (ORDER BY epoch) - 1 AS k, count(*) OVER () AS n FROM e),
q AS (SELECT max(epoch) FILTER (k = floor((n - 1) * 0.25 + 0.5)) AS q1, max(epoch) FILTER (k = floor((n - 1) * 0.75 + 0.5)) AS q3, min(epoch) AS mn, max(epoch) AS mx FROM r),
b AS (SELECT greatest(mn, q1 - 3 * (q3 - q1)) AS lo, least(mx, q3 + 3 * (q3 - q1)) AS hi FROM q),
w AS (SELECT lo, hi, coalesce(list_filter([1, 5, 10, 30, 60, 300, 600, 1800, 3600, 21600, 43200, 86400, 604800], lambda x: x >= (hi - lo) // 512)[1], 604800) AS w FROM b),
g AS (SELECT lo, hi, w, (hi - lo) // w + 1 AS n, least(128, (hi - lo) // w, ((hi - lo) // w + 1) // 4, greatest(1, 3600 // w)) AS most FROM w),
c AS (SELECT stream, (epoch - lo) // w AS b, count(*) AS c FROM e, g WHERE epoch BETWEEN lo AND hi GROUP BY ALL),
t AS (SELECT stream, sum(c)::BIGINT AS events FROM c GROUP BY 1 HAVING sum(c) >= 3),
s AS (SELECT t.stream, i.b, coalesce(c.c, 0) AS c FROM t, (SELECT unnest(range(0, n)) AS b FROM g) i LEFT JOIN c ON c.stream = t.stream AND c.b = i.b),
l AS (SELECT unnest(range(0, most + 1)) AS lag FROM g),
m AS (SELECT x.stream AS leader, y.stream AS follower, lag, count(*) AS k, sum(x.c) AS ea, sum(y.c) AS eb, var_pop(x.c) AS va, var_pop(y.c) AS vb, covar_pop(x.c, y.c) AS cov FROM s x, l, s y WHERE y.b = x.b + lag AND x.stream <> y.stream GROUP BY ALL),
h AS (SELECT *, cov / sqrt(va * vb) AS r FROM m WHERE k >= 8 AND ea >= 3 AND eb >= 3 AND va > 1e-9 AND vb > 1e-9),
p AS (SELECT *, row_number() OVER (PARTITION BY least(leader, follower), greatest(leader, follower) ORDER BY r DESC, lag DESC, leader) AS k1 FROM h WHERE r >= 0.5)
SELECT leader, follower, lag * w AS lag_seconds, round(r, 4) AS score FROM p, g WHERE k1 = 1 ORDER BY score DESC, follower, leader LIMIT 3""")
def stream_correlation(spark, sf_dir):
    """Lagged correlations of all event types as streams."""
    return series.correlate(_epochs(spark, sf_dir)).select("leader", "follower", "lag_seconds", "score")


#: The event types with a stream of their own: the purchases 90 seconds later.
SHIFTED = f"SELECT event_type AS stream, {E} AS epoch FROM events UNION ALL SELECT 'echo', {E} + 90 FROM events WHERE event_type = 'purchase'"


@query(ORACLES["stream_correlation"].replace(f"SELECT event_type AS stream, {E} AS epoch FROM events", SHIFTED, 1))
def shifted_correlation(spark, sf_dir):
    """Lagged correlations of all event types and of the purchases told 90 seconds later."""
    streams = _epochs(spark, sf_dir)
    echo = streams.where("stream = 'purchase'").select(F.lit("echo").alias("stream"), (F.col("epoch") + 90).alias("epoch"))
    return series.correlate(streams.unionByName(echo)).select("leader", "follower", "lag_seconds", "score")


def _as_logs(spark: SparkSession, sf_dir: str) -> str:
    """A shared folder with the events as logs of three grammars: ISO lines whose errors stand in a line without a stamp, access logs and JSON lines."""
    epoch = _seconds("ts")
    stamp = timekey.iso_label(epoch)
    error = F.col("event_type") == "error"
    kind = F.pmod("event_id", F.lit(3))
    month = F.element_at(F.array(*(F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))), F.substring(stamp, 6, 2).cast("int"))
    iso = F.concat(stamp, F.lit(" user "), F.col("user_id"), F.when(error, F.lit("\n  at frame: ERROR, caused by error")).otherwise(""))
    access = F.concat(F.lit("10.0.0.1 - - ["), F.substring(stamp, 9, 2), F.lit("/"), month, F.lit("/"), F.substring(stamp, 1, 4), F.lit(":"), F.substring(stamp, 12, 8), F.lit(' +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '), F.when(error, "503").otherwise("200"), F.lit(" 12"))
    told = F.concat(F.lit('{"time":'), epoch, F.lit(',"level":'), F.when(error, "50").otherwise("30"), F.lit("}"))
    lines = _table(spark, sf_dir, "events").select(F.when(kind == 0, "iso").when(kind == 1, "access").otherwise("json").alias("kind"), F.when(kind == 0, iso).when(kind == 1, access).otherwise(told).alias("value"))
    path = scratch(spark, "logs")
    lines.write.partitionBy("kind").text(path)
    return delete_at_end(spark, path)


@query(f"SELECT CASE event_id % 3 WHEN 0 THEN 'iso' WHEN 1 THEN 'access' ELSE 'json' END AS kind, {E} AS epoch, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def mixed_log_events(spark, sf_dir):
    """The events of a folder of logs in three grammars, each read by its own, with errors on their stamps."""
    events = file_events.events_of_files(spark, _as_logs(spark, sf_dir))
    return events.groupBy(F.regexp_extract("file", "kind=([a-z]+)", 1).alias("kind"), "epoch").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_error").alias("errors"))


@query(f"WITH s AS (SELECT (epoch % 86400) // 3600 AS hour, count(*) AS n FROM (SELECT {E} AS epoch FROM events) GROUP BY 1) SELECT CAST(hour AS INTEGER) AS hour, n FROM s ORDER BY n DESC, hour LIMIT 1")
def peak_hour(spark, sf_dir):
    """The hour of the day with most events; the first of equals."""
    return series.peak(series.hour_histogram(_epochs(spark, sf_dir)), "hour")


@query(f"""WITH e AS (SELECT event_type, {E} AS epoch FROM events), t AS (SELECT epoch FROM e WHERE event_type = 'signup'), f AS (SELECT DISTINCT epoch AS f FROM e WHERE event_type = 'error'),
l AS (SELECT min(f) - t.epoch AS lag FROM (SELECT epoch, row_number() OVER () AS i FROM t) t JOIN f ON f > t.epoch AND f <= t.epoch + 3600 GROUP BY t.epoch, i), r AS (SELECT lag, row_number() OVER (ORDER BY lag) - 1 AS k, count(*) OVER () AS n FROM l)
SELECT lag FROM r WHERE k = n // 2""")
def learned_lag(spark, sf_dir):
    """The upper median of the seconds from each signup to the next error within the hour."""
    epochs = _epochs(spark, sf_dir)
    lag = series.median_lag(epochs.where("stream = 'signup'"), epochs.where("stream = 'error'"), [])
    return spark.createDataFrame([(lag,)] if lag is not None else [], "lag long")


def _as_csv(table: DataFrame) -> str:
    """A shared folder with the table as CSV files, each with a header."""
    path = scratch(table.sparkSession, "csv")
    table.write.option("header", True).csv(path)
    return delete_at_end(table.sparkSession, path)


@query("SELECT o_orderpriority AS key, count(*) AS count, avg(o_totalprice) AS mean_o_totalprice, min(o_totalprice) AS min_o_totalprice, max(o_orderkey)::DOUBLE AS max_o_orderkey FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def csv_groupby(spark, sf_dir):
    """The orders written as CSV files, read again as text cells and grouped."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return tabular.group_by(csv.read_csv(spark, _as_csv(orders)), "o_orderpriority", "mean:o_totalprice,min:o_totalprice,max:o_orderkey", "o_totalprice>1000")


@query("""SELECT 'p_partkey' AS name, count(*) AS count, min(p_partkey)::DOUBLE AS min, max(p_partkey)::DOUBLE AS max, avg(p_partkey) AS mean FROM part
UNION ALL SELECT 'p_size', count(*), min(p_size)::DOUBLE, max(p_size)::DOUBLE, avg(p_size) FROM part UNION ALL SELECT 'p_retailprice', count(*), min(p_retailprice), max(p_retailprice), avg(p_retailprice) FROM part""")
def csv_profile(spark, sf_dir):
    """The parts written as CSV files: the columns found to be numbers, and their profile."""
    table = csv.read_csv(spark, _as_csv(_table(spark, sf_dir, "part")))
    return tabular.profile_numbers(table, tabular.number_columns(table)).select("name", "count", "min", "max", "mean")


@query("""WITH o AS (SELECT *, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_orderpriority END AS p, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS t FROM orders)
SELECT 'price' AS name, 'number' AS kind, count(*) AS count, 0 AS null_count, min(o_totalprice) AS min, max(o_totalprice) AS max, NULL::BIGINT AS "unique", NULL::BIGINT AS true_count, NULL AS first FROM o
UNION ALL SELECT 'priority', 'text', count(*), count(*) - count(p), NULL, NULL, count(DISTINCT p), NULL, NULL FROM o
UNION ALL SELECT 'big', 'bool', count(*), 0, NULL, NULL, NULL, count(*) FILTER (o_totalprice > 200000), NULL FROM o
UNION ALL SELECT 'order.at', 'timestamp', count(*), 0, NULL, NULL, count(DISTINCT t), NULL, min(t) FROM o
UNION ALL SELECT 'order.status', 'text', count(*), 0, NULL, NULL, count(DISTINCT o_orderstatus), NULL, NULL FROM o""")
def json_kinds(spark, sf_dir):
    """The orders as nested JSON lines, profiled: numbers, texts with nulls, bools and timestamps."""
    price = F.col("o_totalprice")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.date_format("o_orderdate", "HH:mm:ss"))
    row = F.struct(price.alias("price"), F.when(price <= 300000, F.col("o_orderpriority")).alias("priority"), (price > 200000).alias("big"), F.struct(stamp.alias("at"), F.col("o_orderstatus").alias("status")).alias("order"))
    lines = _table(spark, sf_dir, "orders").select(F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))
    return tabular.json_profile(lines, "line").select("name", "kind", "count", "null_count", "min", "max", "unique", "true_count", "first")


@query("SELECT 'l_orderkey' AS name, count(*) AS count, 0::BIGINT AS null_count, min(l_orderkey)::DOUBLE AS min, max(l_orderkey)::DOUBLE AS max FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*), 0, min(l_extendedprice), max(l_extendedprice) FROM lineitem")
def footer_statistics(spark, sf_dir):
    """Statistics of two columns from the files' footers alone."""
    footers = readers.read_footers(spark, f"{sf_dir}/lineitem.parquet")
    return readers.footer_statistics(footers.where(F.col("name").isin("l_orderkey", "l_extendedprice")))


@query("""WITH c AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, day::DATE AS day, n, median(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS baseline FROM c""")
def trailing_median(spark, sf_dir):
    """Median of the counts before each, at most 120 of them, the count itself not among them."""
    daily = _table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ring = F.array_sort(F.collect_list("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(-120, -1)))
    k = F.size(ring)
    middle = (F.get(ring, F.floor((k - 1) / 2).cast("int")) + F.get(ring, F.floor(k / 2).cast("int"))) / 2
    return daily.withColumn("baseline", F.when(k > 0, middle))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n_keys FROM events")
def json_paths(spark, sf_dir):
    props = F.col("props")
    return _table(spark, sf_dir, "events").select("event_id", J.get_path(props, "k").alias("k"), F.size(J.object_keys(props)).cast("long").alias("n_keys"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s WHERE score > 0.01) SELECT query_id, vec_id, round(score, 6) AS score FROM k WHERE k <= 10""")
def vector_neighbours(spark, sf_dir):
    """The ten nearest of all vectors for each vector whose id is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return similarity.nearest_of_each(queries, rows, 10, "query_id", "vec_id").withColumn("score", F.round("score", 6))


@query()
def text_neighbours(spark, sf_dir):
    """For every item of the benchmark the documents whose byte histograms are most like its own."""
    items = similarity.embed_texts(_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    docs = similarity.embed_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return similarity.nearest_of_each(items, docs, 10, "item_id", "doc_id")
