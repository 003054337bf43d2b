"""Dumps counted by split against one walk, and the walk against what dumps hold."""

import random

import pytest

from gleanspark.sources import dumps


def random_dump(rng, n):
    """A dump, and the rows and columns of each table."""
    out, rows, columns = ["-- INSERT INTO no VALUES (1);", "/* a comment", "COPY no FROM stdin;", "*/ SET x = 1;"], {}, {}
    text = lambda: rng.choice(["'a'", "'it''s (; INSERT INTO b VALUES (9);'", "'multi\nline\n;\n\\.\n'", r"'esc\' ; ('", "1", "NULL", "'--'", "'/*'", "'\"'", "'`'", "''"])
    for _ in range(n):
        t = rng.choice(["a", "b", "tbl c", "d"])
        name = {"a": "a", "b": 'public."b"', "tbl c": "`tbl c`", "d": rng.choice(["d", '"d"'])}[t]
        kind = rng.randrange(6)
        if kind == 0:
            k = rng.randrange(1, 5)
            out.append(f"CREATE TABLE {rng.choice(['', 'IF NOT EXISTS '])}{name} (" + rng.choice([", ", ",\n  "]).join(f"c{i} decimal(3,2) DEFAULT 'p,q'" for i in range(k)) + "\n);")
            columns[t] = k
            rows.setdefault(t, 0)
        elif kind in (1, 2):
            k = rng.choice([1, 2, 40])
            between = rng.choice([",", ",\n", "\n,\n"])
            out.append(f"INSERT {rng.choice(['INTO', 'into'])} {name} {rng.choice(['', '(x, y) '])}VALUES{rng.choice([' ', chr(10)])}" + between.join(f"({text()}, ({text()}), {text()})" for _ in range(k)) + ";")
            rows[t] = rows.get(t, 0) + k
        elif kind == 3:
            k = rng.choice([0, 3, 60])
            out.append(f"COPY {name} (x, y) FROM stdin;\n" + "".join(rng.choice(["1\tit's\n", "\\N\t;\n", "INSERT INTO z VALUES (1);\n", "\"\n"]) for _ in range(k)) + "\\.")
            rows[t] = rows.get(t, 0) + k
        elif kind == 4:
            out.append(rng.choice(["-- it's a comment (", "/* it's\n\na longer ; one ( */", "DROP TABLE a;", "COMMENT ON TABLE a IS 'x\ny;\n';", "", "SELECT 'a';"]))
        else:
            out.append(f"INSERT INTO {name} SELECT 1;")
            rows.setdefault(t, rows.get(t, 0))
    return "\n".join(out) + "\n", rows, columns


def summed(statements):
    rows, columns = {}, {}
    for table, n, k in statements:
        rows[table] = rows.get(table, 0) + n
        if k is not None:
            columns[table] = k
    return rows, columns


@pytest.mark.parametrize("seed", range(6))
def test_one_walk_and_walks_in_parts(seed):
    rng = random.Random(seed)
    text, rows, columns = random_dump(rng, 60)
    assert summed(dumps.dump_statements(text)) == (rows, columns)
    walk = dumps.Walk()
    for line in text.splitlines(keepends=True):
        walk.feed(line)
        again = dumps.Walk(walk.state())
        assert dumps.read_back(dumps.written(again.state())) == walk.state()
    walk.end()
    assert walk.done == list(dumps.dump_statements(text))


def test_a_name_that_goes_over_lines():
    text = 'INSERT INTO "a\nb" VALUES (1),(2);\nINSERT INTO x"y\nz VALUES (1);\n'
    parts = dumps.Walk()
    for line in text.splitlines(keepends=True):
        parts.feed(line)
    assert parts.done == list(dumps.dump_statements(text)) == [("a\nb", 2, None)]


@pytest.mark.parametrize("size", ["134217728", "3000", "200"])
def test_dumps_in_many_splits(spark, tmp_path, size):
    rng = random.Random(int(size))
    wanted = {}
    for name in ("one.sql", "two.sql", "long.sql", "open.sql"):
        text, rows, columns = random_dump(rng, 50)
        if name == "long.sql":
            text += "INSERT INTO big VALUES\n" + ",\n".join(f"({i}, 'x;\ny(')" for i in range(300)) + ";\nCREATE TABLE big (" + ",\n".join(f"c{i} int" for i in range(200)) + ");\n"
            rows["big"], columns["big"] = 300, 200
        if name == "open.sql":
            text += "COPY tail FROM stdin;\n" + "1\n" * 100
            rows["tail"] = 100
        (tmp_path / name).write_text(text)
        wanted |= {(name, t): (n, columns.get(t)) for t, n in rows.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {(r.path.rsplit("/", 1)[1], r.table): (r.rows, r.columns) for r in dumps.read_dumps(spark, str(tmp_path)).collect()}
        dialects = {r.path.rsplit("/", 1)[1]: r.dialect for r in dumps.dump_dialects(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == wanted
    assert dialects == {p.name: dumps.dump_dialect(p.read_text()) for p in tmp_path.iterdir()}
