"""Filters, grouped aggregates and column profiles over tables of text cells."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, isinf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import finite, looks_iso8601, number, unquote

#: Bytes that an array of byte values may have to be read as a text.
MOST_MESSAGE = 8192
#: Operators of a condition in the order in which they are looked for.
OPERATORS = [">=", "<=", "!=", ">", "<", "="]
SNIFF_ROWS, NUMBER_SHARE = 32, 75


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: str

    @classmethod
    def parse(cls, text: str) -> Condition:
        for op in OPERATORS:
            left, found, right = text.partition(op)
            if found:
                if not left.strip():
                    break
                return cls(left.strip(), op, right.strip())
        raise ValueError(f"not a condition: {text!r}")

    def expression(self, table: DataFrame) -> Column:
        """``=`` and ``!=`` compare texts; the others numbers, and hold only if both sides are such.

        Numeric columns are compared as they are, so that the bound reaches the scan.
        """
        if self.column not in table.columns:
            raise ValueError(f"--where column not found: {self.column}")
        column, kind = F.col(f"`{self.column}`"), table.schema[self.column].dataType
        if self.op in ("=", "!="):
            cell = unquote(column.cast("string"))
            if self.op == "!=":
                return cell != self.value
            if isinstance(kind, T.IntegralType):
                exact = self.value.lstrip("-").isdigit() and str(int(self.value)) == self.value and -(2**63) <= int(self.value) < 2**63
                return column == int(self.value) if exact else F.lit(False)
            return column.contains(self.value) & (cell == self.value) if '"' not in self.value else cell == self.value
        try:
            bound = float(self.value)
        except ValueError:
            return F.lit(False)
        if bound != bound:
            return F.lit(False)
        compare = {">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}[self.op]
        if isinstance(kind, T.IntegralType):
            if isinf(bound) or abs(bound) > 2**62:
                return column.isNotNull() & F.lit(compare(0, bound))
            return compare(column, (floor if self.op in (">", "<=") else ceil)(bound))
        if isinstance(kind, T.NumericType):
            return compare(column, bound) & ~F.isnan(column.cast("double"))
        x = number(unquote(column.cast("string")))
        return F.coalesce(compare(x, bound) & ~F.isnan(x), F.lit(False))


def where(table: DataFrame, condition: str | None) -> DataFrame:
    return table if condition is None else table.where(Condition.parse(condition).expression(table))


def passing_rows(table: DataFrame, condition: str | None = None) -> int:
    """Rows that the condition lets through, those without a key among them; all rows without a condition."""
    return where(table, condition).count()


def numbers(table: DataFrame, name: str) -> Column:
    """The finite numbers of a column: of a numeric one as they are, else of the cells' texts."""
    column = F.col(f"`{name}`")
    kind = table.schema[name].dataType
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return column.cast("double")
    return finite(column.cast("double") if isinstance(kind, T.NumericType) else number(unquote(column.cast("string"))))


def parse_aggregates(specs: str) -> list[tuple[str, str | None]]:
    """``op:column`` separated by commas; bare ``count`` takes none."""
    out = []
    for spec in filter(None, (s.strip() for s in specs.split(","))):
        op, _, column = spec.partition(":")
        if op not in ("count", "sum", "mean", "min", "max") or (op != "count" and not column):
            raise ValueError(f"unknown aggregate: {spec}")
        out.append((op, column or None))
    return out


def group_by(table: DataFrame, by: str, aggregates: str = "count", condition: str | None = None) -> DataFrame:
    """``key``, ``count`` and a column ``op_column`` for each aggregate, over finite numbers.

    ``count:column`` counts rows. Without a finite number sum is 0 and the others
    null. Rows without a key are left out. Most rows first, then by key.
    """
    specs = parse_aggregates(aggregates)
    for column in [by, *(c for _, c in specs if c)]:
        if column not in table.columns:
            raise ValueError(f"column not found: {column}")
    kept = where(table, condition)
    of = {c: numbers(table, c) for _, c in specs if c}
    made = {"count": lambda c: F.count(F.lit(1)), "sum": lambda c: F.coalesce(F.sum(of[c]), F.lit(0.0)), "mean": lambda c: F.avg(of[c]), "min": lambda c: F.min(of[c]), "max": lambda c: F.max(of[c])}
    columns = [made[op](c).alias(f"{op}_{c}") for op, c in specs if c]
    key = unquote(F.col(f"`{by}`").cast("string"))
    return kept.where(F.col(f"`{by}`").isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"), *columns).orderBy(F.desc("count"), "key")


def number_columns(table: DataFrame) -> list[str]:
    """Numeric columns, and those of which 75 % of the first 32 rows are numbers."""
    typed = {f.name for f in table.schema if isinstance(f.dataType, T.NumericType)}
    texts = [c for c in table.columns if c not in typed]
    if not texts:
        return table.columns
    head = table.select(*(f"`{c}`" for c in texts)).limit(SNIFF_ROWS)
    row = head.agg(F.count(F.lit(1)).alias("_n"), *(F.count(number(unquote(F.col(f"`{c}`").cast("string")))).alias(c) for c in texts)).first()
    return [c for c in table.columns if c in typed or (row["_n"] and row[c] * 100 >= row["_n"] * NUMBER_SHARE)]


def profile_numbers(table: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: ``name``, ``count``, ``min``, ``max``, ``mean``, ``sum`` of finite numbers; zeros if there is none.

    One pass over the table: partial sums of all columns, then unpivoted.
    """
    stats = []
    for c in columns:
        x = numbers(table, c)
        stats.append(F.struct(F.lit(c).alias("name"), F.count(x).alias("count"), *(F.coalesce(f(x), F.lit(0.0)).alias(n) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sum", F.sum)))))
    return table.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def profile_texts(table: DataFrame, columns: list[str], top: int = 3) -> DataFrame:
    """``name``, ``count``, ``unique`` and the ``top`` values with counts (most first, then by value).

    Exact over all values. Cells are counted by (column, value) as they stand,
    before they are unquoted and ranked.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    raw = table.select(F.inline(cells)).where("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = raw.groupBy("name", unquote(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    totals = counts.groupBy("name").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("k") <= top)
    listed = best.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top"))
    return totals.join(listed, "name")


class Pairs(list):
    """The pairs of a JSON object in order; a key that is told twice is there twice."""


def json_leaves(rows: DataFrame, column: str, depth: int = 4, order: str | None = None) -> DataFrame:
    """``name``, ``value``, ``kind`` (number, text, bool, null) and ``at`` (place in its row) of every scalar
    in the JSON objects in ``column``; nested keys as ``a.b``, down to ``depth`` levels below the first.

    One pass: each object is unfolded within its row, whatever its keys; a key
    that an object has twice counts twice. Arrays are skipped, but for byte arrays
    under ``MESSAGE``, which are texts. Lines without a quote are no rows. With
    ``order``, a whole number of the row, it is there as ``row``.
    """

    def kind_of(value: object) -> str | None:
        if value is None:
            return "null"
        if isinstance(value, bool):
            return "bool"
        return "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else None

    def scalars(line: str) -> list[tuple[str, str | None, str]]:
        try:
            top = json.loads(line, object_pairs_hook=Pairs)
        except (ValueError, RecursionError):
            return []
        out: list[tuple[str, str | None, str]] = []

        def walk(held: Pairs, prefix: str, left: int) -> None:
            for key, value in held:
                name = prefix + key
                if isinstance(value, Pairs):
                    if left:
                        walk(value, name + ".", left - 1)
                elif isinstance(value, list):
                    if key == "MESSAGE" and len(value) <= MOST_MESSAGE and all(isinstance(x, int) and 0 <= x < 256 for x in value):
                        out.append((name, bytes(value).decode("utf-8", "replace"), "text"))
                elif kind := kind_of(value):
                    out.append((name, None if value is None else value if kind == "text" else str(value).lower(), kind))

        if isinstance(top, Pairs):
            walk(top, "", depth)
        return out

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*x, i, row) for line, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, x in enumerate(scalars(line))]
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["name", "value", "kind", "at", "row"])

    place = F.col(order).cast("long") if order else F.lit(None).cast("long")
    lines = rows.where(F.col(column).contains('"')).select(F.col(column).cast("string").alias("line"), place.alias("row"))
    leaves = lines.mapInArrow(unfold, "name string, value string, kind string, at int, row long")
    return leaves if order else leaves.drop("row")


def json_profile(rows: DataFrame, column: str, depth: int = 4, top: int = 3) -> DataFrame:
    """A row per key of the JSON objects in ``column``: ``name``, ``kind``, ``count``, ``null_count``,
    numbers' ``min max mean sum``, ``unique`` and ``top`` of texts, ``true_count`` and ``false_count``,
    and ``first`` and ``last`` of timestamps (in the order of their letters).

    ``count`` takes nulls in; a key that is null everywhere is left out; a key of
    several kinds is ``mixed`` and has no statistics. Texts that look like ISO
    times make the key a timestamp; the least of its values decides.
    See :func:`json_leaves` for what is read.
    """
    leaves = json_leaves(rows, column, depth)
    # Equal texts of a key are counted first, and numbers summed up: every statistic follows from them.
    x = F.when(F.col("kind") == "number", finite(F.col("value").try_cast("double")))
    value = F.when(F.col("kind") != "number", F.col("value")).alias("value")
    counts = leaves.select("name", "kind", value, x.alias("x")).groupBy("name", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("finite"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"))
    text = F.when(F.col("kind") == "text", F.col("value"))
    best = Window.partitionBy("name").orderBy(F.desc(F.col("kind") == "text"), F.desc("n"), "value")
    ranked = counts.withColumn("k", F.row_number().over(best))

    def total(kind: str, value: str | None = None) -> Column:
        held = F.col("kind") == kind
        return F.coalesce(F.sum(F.when(held & (F.col("value") == value) if value else held, F.col("n"))), F.lit(0))

    listed = F.array_sort(F.collect_list(F.when((F.col("k") <= top) & (F.col("kind") == "text"), F.struct("k", "value", F.col("n").alias("count")))))
    out = ranked.groupBy("name").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("kinds"), total("null").alias("null_count"),
        F.sum("n").alias("every"), F.sum("finite").alias("finite"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"),
        F.count(text).alias("unique"), F.min(text).alias("first"), F.max(text).alias("last"), F.transform(listed, lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top"),
        total("bool", "true").alias("true_count"), total("bool", "false").alias("false_count"),
    ).where(F.size("kinds") > 0)
    one = F.when(F.size("kinds") == 1, F.col("kinds")[0])
    kind = F.when(one.isNull(), "mixed").when((one == "text") & looks_iso8601(F.col("first")), "timestamp").otherwise(one)
    told = out.withColumn("kind", kind)

    def of(kinds: tuple[str, ...], value: Column) -> Column:
        return F.when(F.col("kind").isin(*kinds), value)

    count = F.when(F.col("kind") == "mixed", F.col("null_count")).when(F.col("kind") == "number", F.coalesce("finite", F.lit(0)) + F.col("null_count")).otherwise(F.col("every"))
    number_stats = [of(("number",), v).alias(k) for k, v in (("min", F.coalesce("min", F.lit(0.0))), ("max", F.coalesce("max", F.lit(0.0))), ("mean", F.coalesce(F.try_divide("sum", "finite"), F.lit(0.0))), ("sum", F.coalesce("sum", F.lit(0.0))))]
    return told.select(
        "name", "kind", count.alias("count"), "null_count", *number_stats, of(("text", "timestamp"), F.col("unique")).alias("unique"), of(("text",), F.col("top")).alias("top"),
        *(of(("bool",), F.col(c)).alias(c) for c in ("true_count", "false_count")), *(of(("timestamp",), F.col(c)).alias(c) for c in ("first", "last")),
    )


def key_order(rows: DataFrame, order: str, column: str, depth: int = 4) -> DataFrame:
    """``name`` and ``place``: the keys by their first appearance, by ``order`` and then within the row."""
    lines = rows.select(F.struct(F.col(order).cast("long").alias("o"), F.col(column).alias("line")).alias("r"))
    top = lines.select("r.o", F.posexplode(F.json_object_keys("r.line")).alias("at", "name"))
    first = top.groupBy("name").agg(F.min(F.struct("o", "at")).alias("f"))
    return first.orderBy("f").select("name", F.col("f.o").alias("row"), F.col("f.at").alias("place"))


def leaf_order(rows: DataFrame, order: str, column: str, depth: int = 4) -> DataFrame:
    """``name``, ``row`` and ``place`` of the scalars of :func:`json_leaves`, nested ones too, by their first appearance."""
    first = json_leaves(rows, column, depth, order).groupBy("name").agg(F.min(F.struct("row", "at")).alias("f"))
    return first.orderBy("f").select("name", F.col("f.row").alias("row"), F.col("f.at").alias("place"))


def telling(fields: DataFrame) -> DataFrame:
    """``fields`` of :func:`json_profile` without the texts whose values are all different."""
    non_null = F.col("count") - F.col("null_count")
    return fields.where((F.col("kind") != "text") | (non_null == 0) | (F.col("unique") != non_null))
