"""Operators on small inputs with known results."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.functions import timekey
from gleanspark.functions import json as J
from gleanspark.operators import logs, netflow, series, similarity, summary, summary_diff, tabular, text_safety
from gleanspark.sources import readers
from gleanspark.streaming import watch


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "no long, value string")


@pytest.fixture
def requests(spark):
    rows = [("200", "40", "1000"), ("500", "980", "400"), ("200", "60", "2000"), ("404", "12", "300"), ("500", "980", "800"), ("", "x", "nan")]
    return spark.createDataFrame(rows, "status string, latency string, bytes string")


def test_group_by_order_and_aggregates(requests):
    got = tabular.group_by(requests, "status", "mean:latency,sum:bytes,count:bytes", "bytes>0").collect()
    assert [(r.key, r["count"], r.mean_latency, r.sum_bytes, r.count_bytes) for r in got] == [("200", 2, 50, 3000, 2), ("500", 2, 980, 1200, 2), ("404", 1, 12, 300, 1)]
    empty = {r.key: r for r in tabular.group_by(requests, "status", "sum:bytes,min:bytes").collect()}[""]
    assert empty.sum_bytes == 0.0 and empty.min_bytes is None


def test_conditions(requests):
    count = lambda c: tabular.where(requests, c).count()
    assert count("status=200") == 2 and count("status!=200") == 4 and count("latency>=60") == 3 and count("latency<1d") == 0
    assert tabular.Condition.parse("a=b>=c") == tabular.Condition("a=b", ">=", "c")
    assert count("bytes>0") == 5  # NaN is not above anything
    with pytest.raises(ValueError, match="column not found"):
        tabular.where(requests, "nothing=1")
    with pytest.raises(ValueError):
        tabular.parse_aggregates("median:x")
    with pytest.raises(ValueError):
        tabular.group_by(requests, "nothing")


def test_profile_of_transactions(spark):
    rows = [("groceries", "12", "SL"), ("rent", "1800", "Coop"), ("food", "37.15", "SL"), ("groceries", "250", '"SL"')]
    table = spark.createDataFrame(rows, "category string, amount string, merchant string")
    assert tabular.number_columns(table) == ["amount"]
    r = tabular.profile_numbers(table, ["amount", "category"]).orderBy("name").collect()
    assert (r[0]["count"], r[0].min, r[0].max, r[0].sum) == (4, 12.0, 1800.0, 2099.15)
    assert (r[1]["count"], r[1].min, r[1].max, r[1]["mean"], r[1].sum) == (0, 0.0, 0.0, 0.0, 0.0)
    texts = {r.name: r for r in tabular.profile_texts(table, ["category", "merchant"]).collect()}
    assert [tuple(x) for x in texts["category"].top] == [("groceries", 2), ("food", 1), ("rent", 1)]
    assert texts["merchant"].unique == 2 and texts["merchant"]["count"] == 4


def plan_of(table, capsys):
    table.explain("formatted")
    return capsys.readouterr().out


def test_typed_conditions_reach_the_scan(spark, tmp_path, capsys):
    rows = [(i, float(i) if i else None, i % 7, f"n{i % 3}") for i in range(50)] + [(99, float("nan"), None, None)]
    spark.createDataFrame(rows, "a long, b double, c int, d string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for condition, want, pushed in (("a>10.5", 40, "GreaterThan(a,10)"), ("a<=10.5", 11, "LessThanOrEqual(a,10)"), ("a<10.5", 11, "LessThan(a,11)"), ("b>=40", 10, "GreaterThanOrEqual(b,40.0)"), ("c=3", 7, "EqualTo(c,3)"), ("d=n1", 17, "StringContains(d,n1)"), ("c=03", 0, None), ("a<inf", 51, "IsNotNull(a)"), ("b>x", 0, None), ("c!=3", 43, None)):
        found = tabular.where(table, condition)
        assert found.count() == want, condition
        if pushed:
            assert pushed in plan_of(found, capsys), condition
    assert tabular.passing_rows(table, "a>10") == 40 and tabular.passing_rows(table) == 51
    assert tabular.number_columns(table) == ["a", "b", "c"]
    r = {x.name: x for x in tabular.profile_numbers(table, ["a", "b"]).collect()}
    assert (r["a"]["count"], r["a"].max) == (51, 99.0) and (r["b"]["count"], r["b"].sum) == (49, float(sum(range(50))))


def test_csv_quotes_blank_lines_and_ragged_rows(spark, tmp_path):
    from gleanspark.sources import csv

    text = ' id ,"na""me",x,x\r\n1,"a,b",2,3\r\n\n2,"two\nlines, ""quoted""",5\n3,,7,8,9\n4,"",7,8'
    (tmp_path / "a.csv").write_text(text)
    got = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", 'na"me', "x", "x_3"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("", None, None, None), ("1", "a,b", "2", "3"), ("2", 'two\nlines, "quoted"', "5", None), ("3", "", "7", "8"), ("4", "", "7", "8")]
    plain = tmp_path / "plain"
    plain.mkdir()
    for i in range(3):
        (plain / f"{i}.csv").write_text("k,v\n" + "".join(f"{i},{j}\n" for j in range(100)))
    assert csv.read_csv(spark, str(plain)).groupBy("k").count().orderBy("k").collect() == [(str(i), 100) for i in range(3)]


def test_csv_records_that_cross_splits(spark, tmp_path):
    import random

    from gleanspark.sources import csv

    rng = random.Random(4)
    rows = [(str(i), "".join(rng.choice('ab,\n"') for _ in range(rng.randint(0, 60)))) for i in range(300)]
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    (tmp_path / "big.csv").write_text("k,v\n" + "".join(f"{k},{quoted(v)}\n" for k, v in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = {r.k: r.v for r in csv.read_csv(spark, str(tmp_path / "big.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(rows)


def test_json_profile_nulls_nesting_and_mixed(spark):
    rows = ['{"a":1,"b":"x","d":null,"e":true,"h":{"s":200,"m":{"q":"v"}},"z":1,"l":[1]}', '{"a":null,"b":null,"d":null,"e":false,"h":{"s":404},"z":"t"}', '{"a":3,"b":"y","e":true}', "no json", "[1]"]
    got = {r.name: r for r in tabular.json_profile(lines(spark, *rows), "value").collect()}
    assert set(got) == {"a", "b", "e", "h.s", "h.m.q", "z"}
    assert (got["a"]["count"], got["a"].null_count, got["a"].min, got["a"].max) == (3, 1, 1.0, 3.0)
    assert got["b"].kind == "text" and got["b"].unique == 2 and got["e"].kind == "bool"
    assert got["h.s"].sum == 604.0 and got["z"].kind == "mixed" and got["z"].min is None
    assert (got["e"].true_count, got["e"].false_count, got["e"]["count"]) == (2, 1, 3)
    assert [tuple(x) for x in got["b"].top] == [("x", 1), ("y", 1)]


def test_json_profile_timestamps_depth_and_messages(spark):
    rows = ['{"t":"2026-05-06T08:00:00Z","u":"q","MESSAGE":[72,105],"p":{"q":{"r":1}},"n":1e400}', '{"t":"2026-05-06T08:00:07Z","u":"w","MESSAGE":[300],"p":{"q":{"r":2}},"n":5}', '{"x":[1,2],"t":null,"u":"q"}']
    table = lines(spark, *rows)
    got = {r.name: r for r in tabular.json_profile(table, "value").collect()}
    assert (got["t"].kind, got["t"]["first"], got["t"]["last"], got["t"].unique, got["t"]["count"], got["t"].null_count) == ("timestamp", "2026-05-06T08:00:00Z", "2026-05-06T08:00:07Z", 2, 3, 1)
    assert got["MESSAGE"].kind == "text" and got["MESSAGE"].top[0].value == "Hi" and got["p.q.r"].sum == 3.0
    assert (got["n"]["count"], got["n"].max) == (1, 5.0)
    assert "p.q.r" not in {r.name for r in tabular.json_profile(table, "value", depth=1).collect()}
    assert {r.name for r in tabular.telling(tabular.json_profile(table, "value")).collect()} == {"t", "u", "p.q.r", "n"}
    assert [r.name for r in tabular.key_order(table, "no", "value").collect()] == ["t", "u", "MESSAGE", "p", "n", "x"]


def test_field_differences(spark):
    a = tabular.json_profile(lines(spark, '{"n":1,"b":true,"t":"2026-05-06T08:00:00","s":"x","k":1,"gone":"g"}', '{"n":3,"b":false,"s":"x"}'), "value")
    b = tabular.json_profile(lines(spark, '{"n":2,"b":true,"t":"2026-05-06T08:00:09","s":"x","k":"w","new":"g"}', '{"n":9,"b":true,"s":"y"}'), "value")
    got = {r.name: (r.kind, r["count"], r["mean"]) for r in summary_diff.diff_fields(a, b).collect()}
    assert got == {
        "n": ("number", 2, 3.5), "b.true_delta": ("number", 2, 1.0), "b.false_delta": ("number", 2, -1.0), "t.min_shift_s": ("number", 1, 9.0), "t.max_shift_s": ("number", 1, 9.0),
        "s.unique_delta": ("number", 2, 1.0), "s:x.count_delta": ("number", 2, -1.0), "[appeared in top] s:y": ("mixed", 1, None), "[kind-changed] k": ("mixed", 1, None),
        "[appeared] new": ("mixed", 1, None), "[disappeared] gone": ("mixed", 1, None),
    }


@pytest.mark.parametrize(
    ("grammar", "line", "label"),
    [
        ("iso8601", "x 2026-05-06T08:00:07 y", "2026-05-06T08:00:07"),
        ("iso8601", "2026-02-31 23:59:60", "2026-03-04T00:00:00"),
        ("clf", '1.1.1.1 - - [05/Jun/2026:10:11:12 +0000] "GET', "2026-06-05T10:11:12"),
        ("syslog", "JUN  5 10:11:12 host", "2024-06-05T10:11:12"),
        ("apache-error", "[Fri Jun 05 10:11:12.123456 2026] [core:error] x", "2026-06-05T10:11:12"),
        ("hdfs", "081109 203615 148 INFO", "2008-11-09T20:36:15"),
        ("json-epoch", '{"time": 1765000000123}', "2025-12-06T05:46:40"),
    ],
)
def test_grammars(spark, grammar, line, label):
    found = timekey.line_epochs(lines(spark, line, "nothing here"), grammar).select(timekey.iso_label(F.col("epoch")).alias("t")).collect()
    assert [r.t for r in found] == [label]


def test_sniffing_and_overlaps(spark):
    assert timekey.sniff_grammar(lines(spark, "081109 203615 203616")) == "hdfs"
    assert timekey.line_epochs(lines(spark, "081109 203615 203616"), "hdfs").count() == 1
    assert timekey.sniff_grammar(lines(spark, "2026-01-01 00:00:00", "a")) == "iso8601"
    assert timekey.sniff_grammar(lines(spark, "a")) is None


def test_severity_words_and_bounds(spark):
    log = lines(spark, "DEBUG: a", "[info] b", "level=error c", "ERROR, d", "warning e", '"Critical" f', "an error x", "ERROR y")
    got = {r.level: (r["count"], r.percent) for r in logs.severity(log).collect()}
    assert got == {"DEBUG": (1, 12.5), "INFO": (1, 12.5), "WARN": (1, 12.5), "ERROR": (2, 25.0), "FATAL": (1, 12.5)}
    assert [r.no for r in logs.worst_lines(log, "no", most=2).collect()] == [5, 6]
    assert logs.error_lines(lines(spark, '"GET /" 503 1', '"GET /" 200 5'), "clf").count() == 1
    assert logs.error_lines(lines(spark, '{"level":50}', '{"level": 30}', '{"level":100}'), "json-epoch").count() == 2


def flat(spark, counts):
    return spark.createDataFrame([(i, i * 60, n) for i, n in enumerate(counts)], "bucket long, start long, n long")


def test_spikes_and_drops(spark):
    calm = [50] * 120
    assert series.spikes(flat(spark, calm)).count() == 0
    one = [2500 if i == 75 else 50 for i in range(120)]
    assert [(r.bucket, r.baseline, r.ratio) for r in series.spikes(flat(spark, one)).collect()] == [(75, 50.0, 50.0)]
    jitter = [3000 if i == 30 else 48 + i % 5 for i in range(120)]
    assert [r.bucket for r in series.spikes(flat(spark, jitter)).collect()] == [30]
    down = [1 if i == 9 else 50 for i in range(60)]
    assert [r.bucket for r in series.drops(flat(spark, down)).collect()] == [9]
    assert series.spikes(flat(spark, [1, 900])).count() == 0


def test_histograms_and_series(spark):
    epochs = spark.createDataFrame([(946684800,), (946684800 + 3600,), (946684800 + 7205,)], "epoch long")
    assert [r.n for r in series.hour_histogram(epochs).orderBy("hour").collect()][:4] == [1, 1, 1, 0]
    assert [r.n for r in series.weekday_histogram(epochs).orderBy("weekday").collect()] == [0, 0, 0, 0, 0, 3, 0]
    dense = series.dense_series(epochs, 3600).orderBy("bucket").collect()
    assert [(r.bucket, r.n) for r in dense] == [(0, 1), (1, 1), (2, 1)]
    assert series.dense_series(epochs.limit(0)).count() == 0
    assert series.robust_bounds(epochs) == (946684800, 946684800 + 7205)


def test_correlation_finds_the_planted_lag(spark):
    deploys = [("deploy", t) for t in (3600, 10_000, 21_000)]
    errors = [("error", t + 240 + k) for _, t in deploys for k in range(20)]
    calm = [("other", 97 * k) for k in range(300)]
    found = series.correlate(spark.createDataFrame(deploys + errors + calm, "stream string, epoch long")).collect()
    assert (found[0].leader, found[0].follower, found[0].lag_seconds) == ("deploy", "error", 240)
    chain = series.incident_chain([r.asDict() for r in found])
    assert chain["anchor"] == "deploy" and chain["steps"][0]["stream"] == "error"
    assert series.incident_chain([]) is None
    two = [{"leader": "a", "follower": "b", "lag_seconds": 60, "score": 0.9, "events_leader": 3}, {"leader": "b", "follower": "c", "lag_seconds": 30, "score": 0.7, "events_leader": 9}]
    assert series.incident_chain(two) == {"anchor": "a", "steps": [{"stream": "b", "lag_seconds": 60, "score": 0.9}, {"stream": "c", "lag_seconds": 90, "score": 0.7}], "confidence": 0.7}


def test_ranks_and_lags(spark):
    import random

    from gleanspark.operators.ranking import values_of_ranks

    rng = random.Random(6)
    values = sorted(rng.choice([rng.randint(-5, 5), rng.randint(0, 10**10)]) for _ in range(500))
    table = spark.createDataFrame([(v,) for v in values], "v long")
    ranks = [0, 3, 124, 250, 499]
    assert values_of_ranks(table, "v", ranks) == [values[k] for k in ranks]
    counted = table.groupBy("v").count()
    assert values_of_ranks(counted, "v", ranks, "count") == [values[k] for k in ranks]
    triggers = spark.createDataFrame([(0,), (3599,), (7300,), (50_000,)], "epoch long")
    errors = spark.createDataFrame([(10,), (10,), (7190,), (7301,)], "epoch long")
    got = {r.epoch: r.lag for r in series.first_after(triggers, errors, [], "epoch").collect()}
    assert got == {0: 10, 3599: 3591, 7300: 1}
    assert series.median_lag(triggers, errors, []) == 10 and series.median_lag(triggers.limit(0), errors, []) is None


def test_incident_timeline(spark):
    from gleanspark.operators import incident

    rng = __import__("random").Random(8)
    base = 1_780_000_000
    calm = [("app", base + 60 * i + rng.randint(0, 59), False) for i in range(480) for _ in range(6)]
    spots = [base + t for t in (3600, 11_000, 20_000)]
    errors = [("app", t + 240 + k, True) for t in spots for k in range(20)]
    web = [("web", base + 60 * i + k, False) for i in range(480) for k in range(12) if not 20_240 <= 60 * i <= 20_700]
    deploys = [("deploy", t, False) for t in spots]
    note = [("note", spots[0] - 30, False)]
    events = spark.createDataFrame(calm + errors + web + deploys + note, "file string, epoch long, is_error boolean")
    streams, triggers = incident.streams_of(events)
    assert {r.stream for r in streams.select("stream").distinct().collect()} == {"app", "app (errors)", "web", "deploy"}
    assert [(r.source, r.epoch) for r in triggers.collect()] == [("note", spots[0] - 30)]
    found = incident.timeline(streams)
    assert found["anchor"]["stream"] == "deploy" and found["anchor"]["kind"] == "trigger"
    steps = {s["stream"]: s for s in found["steps"]}
    assert steps["app (errors)"]["lag_seconds"] == 240 and steps["app (errors)"]["direction"] == "increase"
    links = series.correlate(streams).collect()
    peak = next(r for r in links if r.leader == "deploy" and r.follower == "app (errors)").peak_epoch
    near = spark.createDataFrame([("hook", peak - 240 - 20), ("late", peak + 9000)], "source string, epoch long")
    snapped = incident.timeline(streams, near)
    assert snapped["anchor"]["stream"] == "hook" and {s["stream"]: s["lag_seconds"] for s in snapped["steps"]}["app (errors)"] == 260
    assert incident.timeline(streams.where("stream = 'web'")) is None
    assert incident.nearest_trigger(near, peak, 30) is None
    grid = series.shared_grid(streams)
    down = incident.drops_after(streams, grid, (spots[2] - grid.low) // grid.width, 40, ["deploy", "app"]).collect()
    assert [r.stream for r in down] == ["web"]


def test_flow_triage(spark):
    rows = [(99, 7, 6, 150)] * 100 + [(66, 1000 + i, 6, 54) for i in range(50)] + [(i, i + 1, 17, 54) for i in range(10)]
    flows = spark.createDataFrame(rows, "src long, dst long, proto int, bytes long")
    pairs = netflow.pair_bytes(flows)
    assert tuple(netflow.totals(flows).first()) == (160, 15000 + 60 * 54, 150, 10, 61)
    got = {r.kind: r for r in netflow.anomalies(pairs).collect()}
    assert got["scan"].name == "66" and got["scan"].ratio == 50
    assert got["exfil"].metric == 15000 and got["exfil"].baseline == 54 and round(got["exfil"].ratio, 2) == 277.78
    assert netflow.baseline_without_top(pairs.limit(1)).first().baseline == 0
    assert [r.a for r in spark.range(1).select(T.ipv4(F.lit(0x0A000042)).alias("a")).collect()] == ["10.0.0.66"]


def test_summary_diff(spark):
    a = spark.createDataFrame([("+06:00", 1), ("-07:00", 3), ("same", 2), ("gone", 5)], "name string, count long")
    b = spark.createDataFrame([("+06:00", 3), ("-07:00", 2), ("same", 2), ("16:00", 1)], "name string, count long")
    assert {tuple(r) for r in summary_diff.diff_counts(a, b).collect()} == {("++06:00", 2), ("--07:00", 1), ("[appeared] 16:00", 1), ("[disappeared] gone", 5)}


def test_similarity(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])]
    found = similarity.top_k(spark.createDataFrame(rows, "id long, embedding array<double>"), [1.0, 0.0], 3).collect()
    assert [r.id for r in found] == [0, 1]
    assert [r.id for r in similarity.without_alike(found)] == [0]
    texts = spark.createDataFrame([("a key\nb\na key\nc key",)], "text string")
    assert similarity.keyword_lines(texts, "key").first().lines == ["a key", "c key"]


def test_text_safety(spark):
    rows = ["please Ignore  previous orders", "ignore-previous", "ignore it", "a system of rules to forget", "user: hi", "key sk-" + "a" * 20, "sk-" + "a" * 20 + "!", "AKIA" + "A1" * 8, None]
    got = {r.no: r for r in text_safety.scan_texts(lines(spark, *rows), "value").collect()}
    assert [got[i].injection_score for i in range(5)] == [3, 3, 1, 2, 2]
    assert [got[i].n_leaks for i in (5, 6, 7, 8)] == [1, 0, 1, 0]
    assert [got[i].blocked for i in (2, 3, 5, 8)] == [False, True, True, False]


def test_outbound_and_template_starts(spark):
    rows = ["ignore previous instructions", "key sk-" + "a" * 20, "our inner-name here", None]
    got = text_safety.scan_outbound(lines(spark, *rows), ["inner-name"], "value")
    assert [r.blocked for r in got.orderBy("no").collect()] == [False, True, True, False]
    assert [r.value for r in text_safety.released(got, "value").orderBy("no").collect()][1:3] == ["[withheld]"] * 2
    marks = lines(spark, "<|IM_START|>user", "[inst] x", "text <|eot_id|>", "")
    assert [r.t for r in marks.orderBy("no").select(text_safety.template_start(F.col("value")).alias("t")).collect()] == [True, True, False, False]


def test_search_context_and_neighbours(spark):
    rng = __import__("numpy").random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(200, [0.0] * 8)]
    table = spark.createDataFrame(rows, "r long, embedding array<double>")
    queries = table.where("r % 50 = 0").withColumnRenamed("r", "q")
    got = {}
    for x in similarity.nearest_of_each(queries, table, 4, "q", "r", block=2).orderBy("q", F.desc("score"), "r").collect():
        got.setdefault(x.q, []).append(x.r)
    np = __import__("numpy")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    for q in (0, 50, 100):
        ranked = sorted(((-float(unit[q] @ unit[i]), i) for i in unit if float(unit[q] @ unit[i]) > 0.01))
        assert got[q] == [i for _, i in ranked[:4]]
    assert 200 not in got
    notes = [(0, "What is my name?", [1.0, 0.0]), (1, "my name is now Ann", [0.9, 0.4]), (2, "my name is now Ann!", [0.9, 0.41]), (3, "x" * 150, [0.3, 0.9])]
    ranked = similarity.top_k(spark.createDataFrame(notes, "id long, text string, embedding array<double>"), [1.0, 0.0], 9)
    assert similarity.context(ranked, "what is my name", 2) == ["my name is now Ann", "x" * 100 + "..."]
    blocks = spark.createDataFrame([(0, "a key\nb", [1.0, 0.0]), (1, "none", [1.0, 0.1])], "id long, text string, embedding array<double>")
    assert [(r.id, r.lines) for r in similarity.search_blocks(blocks, [1.0, 0.0], "key", 5).collect()] == [(0, ["a key"])]


def test_small_text_functions(spark):
    one = spark.range(1).select(
        T.is_data_dump(F.lit("| a | b |\n| c | d |")).alias("d"), T.is_data_dump(F.lit("one | two\nthree")).alias("n"), T.normal_line(F.lit("  What is it?! ")).alias("l"), T.looks_iso8601(F.lit("2026-05-06 08:00:00 x")).alias("i"), T.looks_iso8601(F.lit("2026-05-06")).alias("j"),
        T.escape_html(F.lit("<a b='c'>&\"")).alias("h"), T.escape_json(F.lit('a"b\n')).alias("e"), T.bytes_text(F.array(F.lit(72), F.lit(105))).alias("b"), T.bytes_text(F.array(F.lit(300))).alias("x"), T.shorten(F.lit("é" * 100), 161).alias("s"), T.shorten(F.lit("ab"), 5).alias("u"),
    ).first()
    assert tuple(one) == (True, False, "what is it", True, False, "&lt;a b=&#39;c&#39;&gt;&amp;&quot;", 'a\\"b\\n', "Hi", None, "é" * 80 + "…", "ab")


def test_text_functions(spark):
    row = spark.range(1).select(T.strip_html(F.lit("<p>a > b</p>c<i")).alias("h"), T.word_count(F.lit("  a b\nc ")).alias("w"), T.first_words(F.lit(" a  b c"), 2).alias("f"), T.line_shape(F.lit("ab 12-x")).alias("s"), T.unquote(F.lit(' "a""b" ')).alias("q"), T.humanize_lag(F.lit(120)).alias("l"), T.number(F.lit("1d")).alias("n"), T.spaceful(F.lit("Å-b!! c")).alias("sp")).first()
    assert tuple(row) == ("a  bc", 3, "a b", "ASDOA", 'a"b', "2m", None, "å b c")


def test_captures(spark, tmp_path):
    def packet(src, dst, proto=6, vlan=False):
        ip = struct.pack(">BBHHHBBHII", 0x45, 0, 40, 0, 0, 64, proto, 0, src, dst) + struct.pack(">HH", 1, 2) + b"\0" * 16
        frame = b"\0" * 12 + (b"\x81\x00\0\1" if vlan else b"") + b"\x08\x00" + ip
        return struct.pack("<IIII", 0, 0, len(frame), len(frame)) + frame

    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    (tmp_path / "a.pcap").write_bytes(head + packet(1, 2) + packet(3, 4, 17, vlan=True) + packet(5, 6, 1) + packet(7, 8)[:-3])
    got = readers.read_captures(spark, str(tmp_path)).orderBy("src").collect()
    assert [(r.proto, r.src, r.dst) for r in got] == [(6, 1, 2), (17, 3, 4)]
    for bad in (b"x", b"\0" * 24, struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1), head[:20] + b"\2\0\0\0"):
        with pytest.raises(ValueError):
            list(readers.packets(bad))


def test_captures_are_read_by_windows(spark):
    import io

    def record(n):
        ip = struct.pack(">BBHHHBBHII", 0x45, 0, 40, 0, 0, 64, 6, 0, n, 9) + struct.pack(">HH", 1, 2) + b"\0" * 16
        frame = b"\0" * 12 + b"\x08\x00" + ip
        return struct.pack("<IIII", 0, 0, len(frame), len(frame)) + frame

    raw = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(map(record, range(200)))
    assert [p[1] for p in readers.packets(io.BytesIO(raw), window=37)] == list(range(200))


def test_lines_offsets_tails_and_sniffing(spark, tmp_path):
    path = tmp_path / "a.log"
    texts = [f"line {i} é" for i in range(200)]
    raw = "\n".join(texts).encode()
    path.write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = readers.numbered_lines(spark, str(path)).orderBy("line").collect()
        assert [r.line for r in rows] == list(range(1, 201)) and [r.value for r in rows] == texts
        assert all(raw[r.offset : r.offset + len(r.value.encode())] == r.value.encode() for r in rows)
        assert [r.value for r in readers.history_tail(spark, str(path), 30).orderBy("line").collect()] == texts[-2:]
        assert [r.line for r in readers.grep(spark, str(path), "LINE 1[0-9] ", ignore_case=True, most=3).orderBy("line").collect()] == [11, 12, 13]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "j").write_text('{"level":1}\n  {"a":2}\nplain\n')
    assert readers.log_container(spark, str(tmp_path / "j")) == "jsonl" and readers.log_container(spark, str(path)) == "plaintext"


def test_footers(spark, tmp_path):
    spark.createDataFrame([(i, float(i) if i % 2 else None, "x") for i in range(10)], "a long, b double, s string").repartition(2).write.parquet(str(tmp_path / "p"))
    got = {r.name: r for r in readers.footer_statistics(readers.read_footers(spark, str(tmp_path / "p"))).collect()}
    assert (got["a"]["count"], got["a"].null_count, got["a"].min, got["a"].max) == (10, 0, 0.0, 9.0)
    assert (got["b"]["count"], got["b"].null_count, got["b"].max) == (10, 5, 9.0) and got["s"].min is None


def growing(path, start="start", most=16 << 20):
    from gleanspark.sources.tail import GrowingFileReader

    return GrowingFileReader(str(path), start, most)


def lines_of(reader, start, end):
    return [x for p in reader.partitions(start, end) for b in reader.read(p) for x in b.column(0).to_pylist()]


def test_growing_file(spark, tmp_path):
    path = tmp_path / "g.log"
    path.write_bytes(b"old\nha")
    reader = growing(path)
    zero, one = reader.initialOffset(), reader.latestOffset()
    assert zero["at"] == 0 and one["at"] == 6 and lines_of(reader, zero, one) == ["old"]
    path.write_bytes(b"old\nhalf\r\nnew\n")
    two = reader.latestOffset()
    assert lines_of(reader, one, two) == lines_of(growing(path), one, two) == ["half", "new"]
    path.write_bytes(b"x\n")
    assert lines_of(reader, two, reader.latestOffset()) == ["x"]
    assert growing(path, "end").initialOffset()["at"] == 2
    path.rename(tmp_path / "g.log.1")
    assert reader.latestOffset()["at"] == 2
    path.write_bytes(b"longer than before\n")
    assert lines_of(reader, {"at": 2, "file": (tmp_path / "g.log.1").stat().st_ino}, reader.latestOffset()) == ["longer than before"]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_growing_file_in_ranges_and_batches(tmp_path, most):
    rng = random.Random(most)
    path = tmp_path / "g.log"
    text = "\n".join(rng.choice(["", "a", "grüße", "x" * 50, "end\r", "漢字" * 9]) for _ in range(200)).encode() + b"\nlast without end"
    path.write_bytes(b"")
    reader, got = growing(path, most=most), []
    reader.BLOCK = 5
    at, written = reader.initialOffset(), 0
    while written < len(text):
        written += rng.randrange(1, 400)
        path.write_bytes(text[:written])
        now = reader.latestOffset()
        got += lines_of(reader, at, now)
        at = now
    assert got == [x.rstrip(b"\r").decode() for x in text.split(b"\n")[:-1]]


def test_growing_file_with_a_line_longer_than_a_range(tmp_path):
    path = tmp_path / "g.log"
    path.write_bytes(b"a\n" + b"y" * 17_000_000 + b"\nz\n")
    reader = growing(path)
    assert list(map(len, lines_of(reader, reader.initialOffset(), reader.latestOffset()))) == [1, 17_000_000, 1]


def test_growing_file_as_a_stream_that_restarts(spark, tmp_path):
    from gleanspark.sources.tail import GrowingFile

    spark.dataSource.register(GrowingFile)
    path = tmp_path / "g.log"
    path.write_bytes(b"one\ntw")

    def run():
        lines = spark.readStream.format("growing_lines").option("path", str(path)).option("from", "start").option("range", 3).load()
        q = lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["one"]
    with open(path, "ab") as f:
        f.write(b"o\nthree is long\n")
    assert run() == ["one", "three is long", "two"]


def test_the_grammar_is_pinned_by_the_first_batch_with_stamps(spark, tmp_path):
    seen = []
    handle = lambda batch, grammar, number: seen.append((number, grammar, batch.count()))
    batches = [[], ["no stamp"], ["Mar  5 01:02:03 host x", "Mar  5 01:02:04 host y"], ["2024-03-05T01:02:03 z"] * 5]
    for number, lines in enumerate(batches):
        pinned = watch.with_pinned_grammar(str(tmp_path / "pin"), handle)  # a new one each time, as after a restart
        pinned(spark.createDataFrame([(x,) for x in lines], "value string"), number)
    assert seen == [(1, None, 1), (2, "syslog", 2), (3, "syslog", 5)]
    watch.with_pinned_grammar(str(tmp_path / "other"), handle, "clf")(spark.createDataFrame([("x",)], "value string"), 4)
    assert seen[-1] == (4, "clf", 1)


def test_dump_quotes_and_comments():
    dump = "-- INSERT INTO no VALUES (1);\nCREATE TABLE a (x decimal(3,2), y text DEFAULT 'p,q', z int);\nINSERT INTO a (x) VALUES (1, 'it''s (a) INSERT INTO b VALUES (9);', \"(\"), (2, ',', 3);\nCOPY b FROM stdin;\nINSERT INTO c VALUES\n1\n\\.\nINSERT INTO `my t` VALUES (1);\nDROP TABLE a;\nINSERT INTO a SELECT 1;"
    assert list(readers.dump_statements(dump)) == [("a", 0, 3), ("a", 2, None), ("b", 2, None), ("my t", 1, None), ("a", 0, None)]


def test_dumps(spark, tmp_path):
    pg = "CREATE TABLE public.users (id int, name text, email numeric(3,2));\nCOPY public.users (id, name) FROM stdin;\n1\ta\n2\tb\n3\tc\n\\.\nCREATE TABLE orders (id int);\nCOPY orders FROM stdin;\n1\n2\n\\.\n"
    my = "CREATE TABLE IF NOT EXISTS `users` (id int);\nINSERT INTO `users` (id, n) VALUES (1,'a;('),(2,'it''s'),(3,'x');\nINSERT INTO orders VALUES (1),(2);\n"
    (tmp_path / "pg.sql").write_text(pg)
    got = {r.table: (r.rows, r.columns) for r in readers.read_dumps(spark, str(tmp_path / "pg.sql")).collect()}
    assert got == {"users": (3, 3), "orders": (2, 1)}
    counts = {}
    for table, rows, _ in readers.dump_statements(my):
        counts[table] = counts.get(table, 0) + rows
    assert counts == {"users": 3, "orders": 2}
    assert (readers.dump_dialect(pg), readers.dump_dialect(my), readers.dump_dialect("")) == ("postgres", "mysql", "sql")


def test_watch_state_machines():
    c = watch.Cascade("high", lag=10)
    assert c.window() == 45
    assert c.tick(100, 1, 0) == [("predicted", 100)]
    assert c.tick(108, 0, 1) == [("confirmed", 108)]
    assert c.tick(120, 1, 5) == []
    assert c.tick(160, 1, 0) == [("predicted", 160)]
    assert c.tick(205, 0, 0) == [("clear", 205)]
    medium = watch.Cascade("medium")
    assert medium.window() == 120 and medium.tick(0, 1, 1) == [("predicted", 0)] and medium.tick(5, 0, 1) == [("confirmed", 5)]
    r = watch.Rate("high")
    assert [r.tick(t, 0) for t in range(15)] == [[]] * 15
    assert r.tick(15, 12) == [] and r.tick(16, 12) == [("anomaly", 16)]
    single = watch.Rate("high")
    quiet = [single.tick(t, 0) for t in range(15)] + [single.tick(15, 50), single.tick(16, 0)]
    assert not any(quiet)


def test_watch_stream(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("a", 100, "deploy of api"), ("a", 108, "ERROR one"), ("b", 100, "ERROR x")]
    frame = spark.createDataFrame([(s, t, v) for s, t, v in rows], "stream string, t long, value string").select("stream", F.timestamp_seconds("t").alias("ts"), "value")
    frame.coalesce(1).write.json(str(folder))
    stream = spark.readStream.schema("stream string, ts timestamp, value string").json(str(folder))
    started = watch.watch(stream, sensitivity="high", lag=10).writeStream.format("memory").queryName("alerts").outputMode("append").start()
    started.processAllAvailable()
    started.stop()
    assert [(r.stream, r.kind, r.at) for r in spark.table("alerts").orderBy("at").collect()] == [("a", "predicted", 100), ("a", "confirmed", 108)]


def test_watch_silence_late_lines_and_clears(spark, tmp_path):
    folder = tmp_path / "in"
    stream = spark.readStream.schema("stream string, ts timestamp, value string").option("maxFilesPerTrigger", 1)

    def add(*rows):
        frame = spark.createDataFrame(list(rows), "stream string, t long, value string").select("stream", F.timestamp_seconds("t").alias("ts"), "value")
        frame.coalesce(1).write.mode("append").json(str(folder))

    add(("a", 100, "deploy of api"), ("rate", 100, "quiet"))
    started = watch.watch(stream.json(str(folder)), sensitivity="high", lag=10, delay="5 seconds").writeStream.format("memory").queryName("alerts2").outputMode("append").start()
    try:
        started.processAllAvailable()
        add(("a", 103, "calm"), ("b", 120, "calm"))
        started.processAllAvailable()
        add(("a", 118, "calm"), ("a", 90, "ERROR too late"))  # within the delay, and beyond it
        started.processAllAvailable()
        add(("rate", 130, "ERROR " * 12), ("rate", 131, "ERROR " * 12), ("b", 200, "calm"))
        started.processAllAvailable()
    finally:
        started.stop()
    got = {(r.stream, r.kind, r.at) for r in spark.table("alerts2").collect()}
    # 145: the window of 45 s is over and nothing came; 131: after 29 silent seconds two in a row
    assert got == {("a", "predicted", 100), ("a", "clear", 145), ("rate", "anomaly", 131)}


def test_snapshots(spark, tmp_path):
    alerts = spark.createDataFrame([("a", "predicted", 10), ("a", "confirmed", 20), ("b", "clear", 15)], "stream string, kind string, at long")
    got = {r.stream: (r.status, r.kind, r.at) for r in watch.snapshot(alerts).collect()}
    assert got == {"a": ("alerting", "confirmed", 20), "b": ("watching", "clear", 15)}
    dated = watch.snapshot(alerts).withColumn("updated", F.lit(100))
    assert {r.stream: r.fresh for r in watch.news(dated, 110).collect()} == {"a": True, "b": False}
    assert watch.news(dated, 300).count() == 0
    path = str(tmp_path / "snap")
    assert watch.latest_snapshot(spark, path) is None
    write = watch.snapshot_writer(path)
    write(alerts, 0)
    write(spark.createDataFrame([("b", "anomaly", 30)], alerts.schema), 1)
    assert {r.stream: (r.status, r.at) for r in watch.latest_snapshot(spark, path).collect()} == {"a": ("alerting", 20), "b": ("alerting", 30)}


def test_learned_lag_of_a_log(spark):
    log = lines(spark, "2026-05-06T06:40:30 deploy v1", "2026-05-06T06:40:42 ERROR x", "2026-05-06T09:00:00 restart", "2026-05-06T09:59:59 ERROR y", "2026-05-06T12:00:00 reload")
    assert watch.learned_lag(log, "iso8601") == 3599
    assert watch.learned_lag(log.where("no < 2"), "iso8601") == 12 and watch.learned_lag(log.where("no = 4"), "iso8601") is None


def test_entry_points_without_the_text_operators():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)


def test_summary_record_round_trip(spark, requests):
    groups = tabular.group_by(requests, "status", "sum:bytes")
    made = summary.record(spark, "groupby", 6, fields=tabular.profile_numbers(requests, ["bytes"]), groups=groups, group_by="status")
    line = summary.to_lines(made)
    text = line.first().value
    assert text.startswith('{"schema_version":1,"analyzer":"groupby"') and '"anomalies"' not in text and '"samples":[]' in text
    assert summary.from_lines(line).first() == made.first()
    with pytest.raises(Exception, match="unsupported schema_version"):
        summary.from_lines(lines(spark, '{"schema_version":2}')).collect()


def test_analyzer_choice():
    pick = summary.analyzer_for
    assert [pick(n, b"x") for n in ("a.CSV", "b.jsonl", "c.parquet", "d.sql", "e.pcap", "f.doc", ".log", "g.log")] == ["profile", "json_profile", "parquet_statistics", "dumps", "flows", None, "severity", "severity"]
    assert pick("x.log", b"at 2026-01-01") == "time_series" and pick("x", b"\xd4\xc3\xb2\xa1") == "flows"


def test_json_functions(spark):
    row = spark.range(1).select(*(f(F.lit('{"b":{"a":[1,"x"]},"c":2}')) for f in (J.object_keys, lambda t: J.get_path(t, "b.a.1"), lambda t: J.get_path(t, "b.q"), J.pretty))).first()
    assert list(row[0]) == ["b", "c"] and row[1] == "x" and row[2] is None and row[3].count("\n") >= 5


def test_embeddings(spark):
    got = {r.no: r.embedding for r in similarity.embed_texts(lines(spark, "abc", "cba", "", None), "value").collect()}
    assert got[0] == got[1] and len(got[0]) == 64 and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    assert set(got[2]) == set(got[3]) == {0.0}


def test_stream_correlation_takes_all_event_types(spark, monkeypatch):
    from gleanspark.plans import catalogue

    seen = []
    real = catalogue.series.correlate
    monkeypatch.setattr(catalogue.series, "correlate", lambda streams: seen.append(streams) or real(streams))
    catalogue.QUERIES["stream_correlation"](spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert {r.stream: r["count"] for r in seen[0].groupBy("stream").count().collect()} == want


def test_csv_with_any_code_point_between_quotes(spark, tmp_path):
    from gleanspark.sources import csv

    rows = ['a,b,c', '"x, y",p￿q,z', '"￾0, ￾1",￿,"￾"', 'no quote￿,￾,1', '"1,""2",b,c']
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    got = sorted(tuple(r) for r in csv.read_csv(spark, str(tmp_path / "t.csv")).collect())
    assert got == sorted([("x, y", "p￿q", "z"), ("￾0, ￾1", "￿", "￾"), ("no quote￿", "￾", "1"), ('1,"2', "b", "c")])


@pytest.mark.parametrize("size", ["134217728", "64"])
def test_numbers_and_offsets_over_splits_and_bytes(spark, tmp_path, size):
    raws = {"a.txt": b"one\n\xff\xfe bad\n\ngr\xc3\xbc\xc3\x9fe\r\n" + b"x" * 300 + b"\nlast", "b.txt": b"\n" * 90, "c.txt": b"y\n"}
    for name, raw in raws.items():
        (tmp_path / name).write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["offset"]) for r in readers.numbered_lines(spark, str(tmp_path)).select("file", "line", "offset").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = []
    for name, raw in raws.items():
        at = 0
        for n, line in enumerate(raw.removesuffix(b"\n").split(b"\n"), 1):
            wanted.append((name, n, at))
            at += len(line) + 1
    assert got == sorted(wanted)


def test_wording_shapes_and_units(spark):
    rows = [("trigger", "app-Deploy.log", 7200), ("trigger", "release.txt", 59), ("trigger", "db.log", 60), ("spike", "deploy.log", 3600), ("trigger", "Shipping", -5), ("trigger", "x", 1)]
    got = spark.createDataFrame(rows, "k string, s string, n long").select(T.anchor_label(F.col("k"), F.col("s")).alias("a"), T.lag_words(F.col("n")).alias("l"), T.step_verb(F.when(F.col("n") > 60, "decrease").otherwise("increase")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("Deployment", "2 hours", "drops"), ("Release", "59 seconds", "rises"), ("db.log event", "1 minute", "rises"), ("deploy.log spike", "1 hour", "drops"), ("Release", "0 seconds", "rises"), ("x event", "1 second", "rises")]
    lines = spark.createDataFrame([(x,) for x in ["ab 12", "c 3", "  xyz 9 ", "", "   ", "1-2", None]], "value string")
    assert [tuple(r) for r in T.dominant_shape(lines).collect()] == [("ASD", 3)]
    assert T.dominant_shape(lines.limit(2)).count() == 0
    raw = spark.createDataFrame([(x,) for x in (0, -1, -1000, -1001, 1999, 9223372036854775807, -9223372036854775808)], "n long")
    for unit, size in timekey.UNITS.items():
        assert [r[0] for r in raw.select(timekey.whole_seconds(F.col("n"), unit)).collect()] == [r.n // size for r in raw.collect()]


def test_level_counts_are_those_of_the_words(spark):
    words = ["error", "ERROR:", "Errors", "[warning]", "warn", "x-warn", "critical", "FATAL,", "\"info\"", "debug\tinfo", "terror", "level=error,"]
    rng = random.Random(4)
    lines = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randrange(6))),) for _ in range(200)] + [("",), (None,)], "value string")
    both = lines.select(logs.levels(F.col("value")).alias("l"), *(logs.level_count(F.col("value"), v).alias(v) for v in logs.LEVELS)).where("l IS NOT NULL").collect()
    assert all(r["l"].count(v) == r[v] for r in both for v in logs.LEVELS)


def test_the_state_of_dead_streams_is_dropped(spark, tmp_path):
    schema = "stream string, ts timestamp, value string"
    folder = tmp_path / "in"
    for k, rows in enumerate([[("a", 100, "deploy x"), ("b", 100, "ok")], [("b", 100_000, "ERROR")], [("b", 100_001, "ok")], [("b", 102_000, "ok")], [("b", 102_001, "ok")]]):
        spark.createDataFrame(rows, "stream string, t long, value string").select("stream", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").json(str(folder))
        stream = spark.readStream.schema(schema).json(str(folder))
        alerts = watch.watch(stream, sensitivity="high", lag=10, idle=1000)
        started = alerts.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        started.processAllAvailable()
        started.stop()
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "c"))
    assert [r.key[0] for r in held.select("key").collect()] == ["b"]
    assert {(r.stream, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "predicted"), ("a", "clear")}


def test_json_keys_told_twice_and_nested_order(spark):
    rows = ['{"z":{"b":1,"a":{"k":"v"}},"d":1,"d":2.5,"l":[{"x":1}]}', '{"c":{"d":9223372036854775807},"z":{"b":18446744073709551616,"q":null}}', '{"z":{"z0":1},"z":{"b":2}}', '{"a":' * 3000 + "1" + "}" * 3000]
    table = lines(spark, *rows)
    got = {r.name: r for r in tabular.json_profile(table, "value").collect()}
    assert (got["d"]["count"], got["d"].sum, got["z.b"]["count"], got["z.b"].max, got["c.d"].max) == (2, 3.5, 3, 2.0**64, 2.0**63)
    assert [r.name for r in tabular.leaf_order(table, "no", "value").collect()][:7] == ["z.b", "z.a.k", "d", "c.d", "z.q", "z.z0"]
