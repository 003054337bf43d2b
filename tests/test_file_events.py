"""Events of mixed log files against a plain walk, over splits of any size."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanspark.functions.timekey import GRAMMARS
from gleanspark.operators import file_events


def plain_marks(text, grammar):
    """(stamp, is_error) in order, walking the whole file."""
    stamps = {m.start(1): m[1] for m in re.finditer(GRAMMARS[grammar], text)}
    word = r'(?i:(?:^|(?<=[ \t\r\n\[\]":]))(?:error|critical|fatal)(?=$|[ \t\r\n\[\]":]))'
    pattern = {"clf": r'" 5\d\d ', "json-epoch": word + r'|"level": ?(?:[5-9]\d(?!\d)|\d{3,})'}.get(grammar, word)
    events, hit = [], {}
    for at in sorted([(p, 0, s) for p, s in stamps.items()] + [(m.start(), 1, None) for m in re.finditer(pattern, text, re.M)]):
        if at[1] == 0:
            events.append(at[2])
        elif events:
            hit[len(events) - 1] = True
    return [(s, hit.get(i, False)) for i, s in enumerate(events)]


def logs(rng, n):
    word = lambda: rng.choice(["INFO ok", "ERROR bad", "[error] x error", "FATAL", "fine", "terror", "Critical: y"])
    out = {"iso.log": [], "access.log": [], "apache.log": [], "sys.log": [], "hdfs.log": [], "app.json": []}
    for i in range(n):
        h, m, s = rng.randrange(24), rng.randrange(60), rng.randrange(60)
        t = f"{h:02}:{m:02}:{s:02}"
        out["iso.log"].append(rng.choice([f"2024-03-05T{t} {word()}", f"{word()} 2024-03-05 {t} {word()} 2024-03-06T{t}", f"  at {word()}", "", word()]))
        out["access.log"].append(rng.choice([f'1.2.3.4 - - [05/Mar/2024:{t} +0000] "GET /e HTTP/1.1" {rng.choice([200, 500, 503, 404])} 12', '" 500 carried']))
        out["apache.log"].append(rng.choice([f"[Tue Mar 05 {t} 2024] [{rng.choice(['error', 'notice'])}] msg error", "trace error"]))
        out["sys.log"].append(rng.choice([f"Mar  5 {t} host app[1]: {word()}", word()]))
        out["hdfs.log"].append(rng.choice([f"240305 {h:02}{m:02}{s:02} {word()} x", word()]))
        out["app.json"].append(rng.choice([f'{{"time":{1709600000 + i},"level":{rng.choice([30, 50, 100, 60])}}}', f'{{"level":"error","ts": {1709600000 + i}}}', '{"level":50}']))
    return out


@pytest.mark.parametrize("size", ["134217728", "700"])
def test_mixed_files_over_splits(spark, tmp_path, size):
    rng = random.Random(5)
    texts = {name: "\n".join(lines) + rng.choice(["", "\n"]) for name, lines in logs(rng, 150).items()}
    texts |= {"empty.log": "", "nothing.log": "no stamp here ERROR\n", "crlf.log": "2024-01-01T00:00:00 ok\r\nERROR\r\n2024-01-01T00:00:05 ERROR\r\n"}
    texts["gap.log"] = "ERROR first\n2024-01-01T00:00:00 ok\n" + "filler line\n" * 300 + "late ERROR\n" + "filler\n" * 200 + "2024-01-01T00:10:00 ok\n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        grammars = {r["file"].rsplit("/", 1)[1]: r["grammar"] for r in file_events.file_grammars(spark, str(tmp_path)).collect()}
        got = Counter((r["file"].rsplit("/", 1)[1], r["epoch"], r["is_error"]) for r in file_events.events_of_files(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert grammars == {"iso.log": "iso8601", "access.log": "clf", "apache.log": "apache-error", "sys.log": "syslog", "hdfs.log": "hdfs", "app.json": "json-epoch", "nothing.log": "iso8601", "crlf.log": "iso8601", "gap.log": "iso8601"}
    grammars["empty.log"] = "iso8601"
    every = [(name, s, e) for name, text in texts.items() for s, e in plain_marks(text, grammars[name])]
    decoded = spark.createDataFrame([(n, s, e, grammars[n]) for n, s, e in every], "file string, stamp string, is_error boolean, grammar string")
    epoch = F.lit(None).cast("long")
    for g in GRAMMARS:
        epoch = F.when(F.col("grammar") == g, file_events.decode(F.col("stamp"), g)).otherwise(epoch)
    wanted = Counter(tuple(r) for r in decoded.select("file", epoch.alias("epoch"), "is_error").where("epoch IS NOT NULL").collect())
    assert got == wanted and sum(e for _, _, e in every) > 100
    assert got[("gap.log", 1704067200, True)] == 1 and got[("crlf.log", 1704067200, True)] == 1


def test_a_folder_of_mixed_logs_is_one_incident(spark, tmp_path):
    """A deploy, then errors in an access log after 60 s and in a JSON log after 120 s, each burst three times."""
    base = 1709596800  # 2024-03-05T00:00:00
    stamp = lambda t, f: __import__("datetime").datetime.fromtimestamp(t, __import__("datetime").timezone.utc).strftime(f)
    hours = [base + 3600 * k for k in (1, 3, 6)]
    (tmp_path / "deploy.log").write_text("".join(f"{stamp(h + d, '%Y-%m-%dT%H:%M:%S')} deploy {d}\n" for h in hours for d in range(4)))
    access = sorted([(base + 97 * i, 200) for i in range(290)] + [(h + 60 + d, 500) for h in hours for d in range(20)])
    (tmp_path / "access.log").write_text("".join(f'1.1.1.1 - - [{stamp(t, "%d/%b/%Y:%H:%M:%S")} +0000] "GET / HTTP/1.1" {s} 1\n' for t, s in access))
    (tmp_path / "app.json").write_text("".join(f'{{"time":{h + 120 + d},"level":50}}\n' for h in hours for d in range(20)))
    found = file_events.incident_of_files(spark, str(tmp_path))
    assert found["anchor"]["stream"] == "deploy.log" and found["anchor"]["kind"] == "trigger"
    assert {"access.log (errors)", "app.json"} <= {s["stream"] for s in found["steps"]}
