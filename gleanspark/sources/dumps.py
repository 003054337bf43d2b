"""SQL dumps counted by split: where each split's start state leads, the states put in order, and what was counted from the true ones."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stored

#: What a walk stops at: texts with doubled or escaped quotes, comments, signs, and words; a last quote or ``/*`` without its end.
TOKEN = re.compile(r"""'(?:[^'\\]+|''|\\.)*+(?P<end>')?|--[^\n]*|/\*(?:.*?\*/)?|[(),;]|(?:"[^"]*"|`[^`]*`|[^\s(),;'"`-]|-(?!-))+|["`]""", re.S)
TEXT_END = re.compile(r"(?:[^'\\]+|''|\\.)*+'", re.S)
WORD = re.compile(r"""(?:"[^"]*"|`[^`]*`|[^\s(),;'"`-]|-(?!-))+""", re.S)
COPIED = re.compile(r"^\\\.[^\n]*\n?", re.M)
#: What stands before a table's name.
HEADS = [["CREATE", "TABLE"], ["CREATE", "TABLE", "IF", "NOT", "EXISTS"], ["INSERT", "INTO"], ["COPY"]]
OPEN = "\0"  # stands for the table of the statement under way at a split's start


class Walk:
    """A walk over a dump that can stop at any line's end and go on from its state.

    The state is what is open (a quote, a comment, copied rows), and of the
    statement under way its first words or its kind, depth and marks; what is counted of it is told apart.
    """

    START = ("", "", (), "", 0, False, False)

    def __init__(self, state: tuple = START):
        self.open, self.word, head, self.kind, self.depth, self.values, self.listed = state
        self.head = list(head)
        self.table, self.rows, self.columns = OPEN, 0, 0
        self.done: list[tuple[str, int, int | None]] = []  # statements in order; the first may be OPEN's

    def state(self) -> tuple:
        return (self.open, self.word, tuple(self.head), self.kind, self.depth, self.values, self.listed)

    def finish(self) -> None:
        self.done.append((self.table, self.rows, self.columns if self.kind == "CREATE" else None))
        self.kind, self.head, self.depth, self.values, self.listed = "", [], 0, False, False

    def token(self, token: str) -> None:
        if not self.kind:
            self.head.append(token)
            head = [t.upper() for t in self.head]
            if token == ";" or len(head) > 8:
                self.head = []
            elif head[:-1] in HEADS and head[-1] != "IF":
                self.kind, self.head, self.depth, self.values, self.listed = head[0], [], 0, False, False
                self.table, self.rows, self.columns = token.split(".")[-1].strip('"`[]'), 0, 0
            elif head[0] not in ("CREATE", "INSERT", "COPY"):
                self.head = []
        elif token == "(":
            self.rows += self.values and self.depth == 0
            if self.depth == 0 and not self.listed:
                self.columns, self.listed = self.columns + 1, True
            self.depth += 1
        elif token == ")":
            self.depth -= 1
        elif token == "," and self.depth == 1:
            self.columns, self.listed = self.columns + 1, True
        elif self.depth == 0 and token.upper() == "VALUES":
            self.values = True
        elif token == ";" and self.depth <= 0:
            if self.kind == "COPY":
                self.open = "copy line"
            else:
                self.finish()

    def feed(self, text: str) -> None:
        """Go on over ``text``, which ends with a line feed, or is the last of its dump."""
        at = 0
        while at < len(text):
            if self.open == "copy line":  # the rows begin in the next line
                at = text.find("\n", at) + 1 or len(text)
                self.open, self.depth, self.values, self.listed = "copy", 0, False, False
            elif self.open == "copy":
                end = COPIED.search(text, at)
                self.rows += text.count("\n", at, end.start() if end else len(text))
                if not end:
                    return
                at = end.end()
                self.open = ""
                self.finish()
            elif self.open == "'":
                end = TEXT_END.match(text, at)
                if not end:
                    return
                at, self.open = end.end(), ""
                self.token("''")
            elif self.open == "/*":
                end = text.find("*/", at)
                if end < 0:
                    return
                at, self.open = end + 2, ""
            elif self.open:  # a quoted name in a word
                end = text.find(self.open, at)
                if end < 0:
                    self.word += text[at:]
                    return
                self.word, self.open = self.word + text[at : end + 1], ""
                at = self.word_on(text, end + 1)
            else:
                at = self.one(text, at)

    def one(self, text: str, at: int) -> int:
        m = TOKEN.search(text, at)
        if m is None:
            return len(text)
        token = m[0]
        if token[0] == "'":
            if not m["end"]:
                self.open = "'"
                return len(text)
            self.token("''")
        elif token.startswith("/*") and (token == "/*" or token.endswith("*/")):
            if token == "/*":
                self.open = "/*"
        elif not token.startswith("--"):
            if token in "(),;":
                self.token(token)
            else:
                self.word = ""
                return self.word_on(text, m.start())
        return m.end()

    def word_on(self, text: str, at: int) -> int:
        """Take the rest of a word; it stays open if a quote in it does not end here."""
        m = WORD.match(text, at)
        if m:
            self.word += m[0]
            at = m.end()
        if at < len(text) and text[at] in "\"`":
            self.word, self.open = self.word + text[at:], text[at]
            return len(text)
        word, self.word = self.word, ""
        self.token(word)
        return at

    def end(self) -> None:
        """The dump is over: rows copied without an end still count."""
        if self.open in ("copy", "copy line"):
            self.finish()


def dump_statements(text: str) -> Iterator[tuple[str, int, int | None]]:
    """(table, rows, columns or None) of each CREATE TABLE, INSERT INTO and COPY of a dump, in one walk over the text.

    Words and signs within quotes and comments count for nothing; a quote that is never closed hides the rest.
    """
    walk = Walk()
    walk.feed(text)
    walk.end()
    yield from walk.done


#: States that splits of dumps often start in: between statements, among the rows of an INSERT, among copied rows.
USUAL = [Walk.START, ("", "", (), "INSERT", 0, True, False), ("", "", (), "INSERT", 0, True, True), ("copy", "", (), "COPY", 0, False, False)]
COUNTED = "file string, block long, start string, kind string, table string, rows long, columns long, k int, end string"


def written(state: tuple) -> str:
    return json.dumps(state)


def read_back(state: str) -> tuple:
    told = json.loads(state)
    return (*told[:2], tuple(told[2]), *told[3:])


class Several:
    """Walks from several start states over one split; those that come to be in one state go on as one."""

    def __init__(self, starts: list[tuple]):
        self.walks = [(Walk(s), [(s, [], (OPEN, 0, 0))]) for s in dict.fromkeys(starts)]

    def feed(self, text: str) -> None:
        met: dict[tuple, int] = {}
        walks = []
        for walk, starts in self.walks:
            walk.feed(text)
            # What was counted is handed to the starts, so that walks of one state are alike.
            settled = [(s, [*done, *self.named(walk.done, under)], self.open_part(walk, under)) for s, done, under in starts]
            walk.done, walk.rows, walk.columns, walk.table = [], 0, 0, OPEN
            if walk.state() in met:
                walks[met[walk.state()]][1].extend(settled)
            else:
                met[walk.state()] = len(walks)
                walks.append((walk, settled))
        self.walks = [(walk, [(s, self.summed(done), under) for s, done, under in starts]) for walk, starts in walks]

    @staticmethod
    def named(done: list, under: tuple) -> list:
        """The walk's statements, its first one with what was counted of it before."""
        out = []
        for table, rows, columns in done:
            if table == OPEN:
                out.append((under[0], under[1] + rows, None if columns is None else under[2] + columns))
            else:
                out.append((table, rows, columns))
        return out

    @staticmethod
    def open_part(walk: Walk, under: tuple) -> tuple:
        if walk.table == OPEN and not walk.done and walk.kind:
            return (under[0], under[1] + walk.rows, under[2] + walk.columns)
        return (walk.table, walk.rows, walk.columns) if walk.kind else (OPEN, 0, 0)

    @staticmethod
    def summed(done: list) -> list:
        """One entry a table and kind of statement: rows added up, the last columns; the statement under way at the start by itself."""
        first = done[:1] if done and done[0][0] == OPEN else []
        tables: dict[str, list] = {}
        for k, (table, rows, columns) in enumerate(done[len(first) :]):
            told = tables.setdefault(table, [0, None, k])
            told[0] += rows
            if columns is not None:
                told[1], told[2] = columns, k
        return first + [(t, rows, columns) for t, (rows, columns, _) in sorted(tables.items(), key=lambda x: x[1][2])]

    def rows(self, file: str, block: int) -> list[tuple]:
        out = []
        for walk, starts in self.walks:
            for start, done, under in starts:
                name = written(start)
                out += [(file, block, name, "lead" if table == OPEN else "done", table, rows, columns, k, None) for k, (table, rows, columns) in enumerate(done)]
                out.append((file, block, name, "open", under[0], under[1], under[2], len(done), written(walk.state())))
        return out


def counted(lines: DataFrame, starts: list[tuple] | None) -> DataFrame:
    """``COUNTED`` for every split of ``lines`` (``file``, ``block``, ``value``, in order) and start state: the given ones, or that in column ``start``."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, walks = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*walks.rows(*place)), kinds)], names=names)

        for batch in batches:
            values = batch.column("value").cast(pa.binary()).to_pylist()
            keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("start").to_pylist()))
            at = 0
            for key, run_of in groupby(keys):
                n = sum(1 for _ in run_of)
                if key[:2] != place:
                    if walks:
                        yield told()
                    place, walks = key[:2], Several(starts or [read_back(key[2])])
                walks.feed(b"\n".join(values[at : at + n]).decode("utf-8", "replace") + "\n")
                at += n
        if walks:
            yield told()

    table = lines if "start" in lines.columns else lines.withColumn("start", F.lit(None).cast("string"))
    return table.select("file", "block", "value", "start").mapInArrow(run, COUNTED)


def compose(ends: DataFrame) -> DataFrame:
    """(``file``, ``block``, ``start``, ``table``, ``rows``, ``columns``, ``missing``) by the true start state of each split, file by file.

    A row without a table tells a split's start state, with ``missing`` if nothing was
    counted from it; one with a table is a statement that went over splits. Each file's few rows a split are put in order.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        state, under = written(Walk.START), (OPEN, 0, 0)
        by_block = {b: {s: g.to_dict("records") for s, g in part.groupby("start")} for b, part in rows.groupby("block")}
        for block in sorted(by_block):
            told = by_block[block].get(state)
            out.append((key[0], block, state, None, 0, None, told is None))
            if told is None:
                return pd.DataFrame(out, columns=["file", "block", "start", "table", "rows", "columns", "missing"]).astype({"columns": "Int64"})
            for r in sorted(told, key=lambda r: r["k"]):
                n = None if pd.isna(r["columns"]) else int(r["columns"])
                if r["kind"] == "lead":
                    out.append((key[0], block, state, under[0], under[1] + int(r["rows"]), None if n is None else under[2] + n, False))
                    under = (OPEN, 0, 0)
                else:
                    under = (under[0], under[1] + int(r["rows"]), under[2] + (n or 0)) if r["table"] == OPEN else (r["table"], int(r["rows"]), n or 0)
                    state = r["end"]
        if read_back(state)[0] in ("copy", "copy line"):
            out.append((key[0], block, state, under[0], under[1], None, False))
        return pd.DataFrame(out, columns=["file", "block", "start", "table", "rows", "columns", "missing"]).astype({"columns": "Int64"})

    return ends.groupBy("file").applyInPandas(run, "file string, block long, start string, table string, rows long, columns long, missing boolean")


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``table``, ``rows``, ``columns`` (of its last CREATE) for each table of each dump; most rows first.

    Splits are walked in parallel, each from the states that splits usually start
    in; walks that come to one state go on as one. In order of the splits, each
    one's end tells where the next one starts. Where that is a state nothing was
    walked from (within a quoted text, say), the file's splits from there on are
    walked from it too, until every split has its own; so no dump is ever in one task.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = stored(counted(lines, USUAL), "dump")
    while True:
        placed = stored(compose(found.where("kind <> 'done'")), "placed")
        missing = placed.where("missing").select("file", F.col("block").alias("from"), "start")
        if missing.isEmpty():
            break
        # A row a file.
        again = lines.join(F.broadcast(missing), "file").where("block >= from").select("file", "block", "value", "start")
        more = stored(found.unionByName(counted(again, None)).distinct(), "dump")
        discard(found)
        found = more
    true = placed.where("table IS NULL").select("file", "block", "start")
    inside = found.where("kind = 'done'").join(true, ["file", "block", "start"]).select("file", "table", "rows", "columns", "block", "k")
    over = placed.where("table IS NOT NULL").select("file", "table", "rows", "columns", "block", F.lit(-1).alias("k"))
    every = inside.unionByName(over).withColumn("at", F.when(F.col("columns").isNotNull(), F.struct("block", "k")))
    return every.groupBy(F.col("file").alias("path"), "table").agg(F.sum("rows").alias("rows"), F.max_by("columns", "at").cast("int").alias("columns")).orderBy(F.desc("rows"), "table")


def dump_dialect(text: str) -> str:
    head = text[: 256 << 10]
    if any(line.upper().startswith("COPY ") for line in text.splitlines()):
        return "postgres"
    if "`" in head:
        return "mysql"
    return "postgres" if "pg_catalog" in head or "PostgreSQL" in head else "sql"


def dump_dialects(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``dialect`` of each dump: :func:`dump_dialect` with its lines looked through in parallel, and only heads read as a whole."""
    from .readers import file_heads

    @F.pandas_udf("string")
    def by_head(heads: pd.Series) -> pd.Series:
        return heads.map(lambda head: dump_dialect(head[: 256 << 10]))

    copies = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path")).where(F.upper(F.substring("value", 1, 5)) == "COPY ").select("path").distinct()
    heads = file_heads(spark, path, 1 << 20).select(F.col("file").alias("path"), by_head("head").alias("by_head"))
    told = heads.join(copies.withColumn("copies", F.lit(True)), "path", "left")
    return told.select("path", F.when(F.col("copies"), "postgres").otherwise(F.col("by_head")).alias("dialect"))
