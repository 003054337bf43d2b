"""Quality rules: a decision list learned by sequential covering and applied as a Spark conditional expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stored
from .common import by_bytes, utf8

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct"]
WINDOW = 8


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of two) words that the text has twice or more, the first ones included."""
    n = len(numbers)
    if n <= window:
        return 0
    # A cheap sum of mixed word numbers first: equal windows have equal sums, so all different means no repeat.
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    h = mixed[: n - window + 1].copy()
    for j in range(1, window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j : n - window + 1 + j]
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return 0
    rank, width = numbers, 1
    while width < window:
        rank = np.unique(rank[:-width] * np.int64(n) + rank[width:], return_inverse=True)[1]
        width *= 2
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The columns ``COUNTS`` of one text."""
    words = text.split()
    letters = b"".join(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    first: dict[bytes, int] = {}
    numbers = np.fromiter(map(first.setdefault, words, count()), dtype=np.int64, count=len(words))
    plain = text.translate(None, SYMBOLS)
    return (
        len(words),
        len(letters.translate(None, CONTINUATION)),
        len(text) - len(plain),
        len(lines) - len(set(lines)),
        repeated_words(numbers),
        len(lines),
        len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(letters) - len(letters.translate(None, b"0123456789")),
        len(first),
    )


def text_statistics(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc`` and the counts ``COUNTS``; a null text counts as empty."""
    doc_type = docs.schema[doc].dataType
    schema = pa.schema([(doc, to_arrow_type(doc_type)), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t"):
            counts = [text_counts(t) for t in utf8(batch.column("t"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column("d").cast(schema.field(0).type), *columns], schema=schema)

    return docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"`{doc}` {doc_type.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios() -> dict[str, Column]:
    """What the rules test, from the counts; a share of nothing is 0."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "distinct_share": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject if all conditions (feature, ">" or "<=", threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        held = np.ones(len(x), dtype=bool)
        for name, op, v in self.conditions:
            column = x[:, names.index(name)]
            held &= column > v if op == ">" else column <= v
        return held

    def expression(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, v in self.conditions:
            out = out & ((features[name] > v) if op == ">" else (features[name] <= v))
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{n} {op} {v:.6g}" for n, op, v in self.conditions)


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 4) -> Rule:
    """Add the condition of the largest FOIL gain until only bad rows are covered or nothing is gained."""
    held, conditions = np.ones(len(x), dtype=bool), []
    while len(conditions) < most and held.any() and not bad[held].all():
        p0, n0 = bad[held].sum(), (~bad[held]).sum()
        if not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, name in enumerate(names):
            order = np.argsort(x[held, f], kind="stable")
            v, b = x[held, f][order], bad[held][order]
            p, n = np.cumsum(b), np.cumsum(~b)
            cuts = np.flatnonzero(v[1:] > v[:-1])
            for op in ("<=", ">"):
                pc, nc = (p[cuts], n[cuts]) if op == "<=" else (p0 - p[cuts], n0 - n[cuts])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pc > 0, pc * (np.log2(pc / (pc + nc)) - base), -1.0)
                if len(gain) and gain.max() > best[0]:
                    k = int(np.argmax(gain))
                    best = (float(gain[k]), (name, op, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        held &= Rule((best[1],)).covers(x, names)
    return Rule(tuple(conditions))


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """Drop last conditions as long as (bad - good) / covered on rows not grown on doesn't fall."""

    def worth(r: Rule) -> float:
        c = r.covers(x, names)
        return (bad[c].sum() - (~bad[c]).sum()) / c.sum() if c.any() else -1.0

    while len(rule.conditions) > 1:
        shorter = Rule(rule.conditions[:-1])
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, most_rules: int = 12, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a rule for bad rows on two thirds, prune it on the rest, take away what it covers.

    A rule stays only if, on all rows left, at least ``precision`` of those it
    covers are bad. Rows without both classes give no rules.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), dtype=bool)
    while bad[left].any() and (~bad[left]).any() and len(rules) < most_rules:
        at = np.flatnonzero(left)
        part = rng.random(len(at)) < 2 / 3
        rule = grow(x[at[part]], bad[at[part]], names)
        if not rule.conditions:
            break
        rule = prune(rule, x[at[~part]], bad[at[~part]], names)
        covered = rule.covers(x, names) & left
        if bad[covered].sum() < 2 or bad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def rules_column(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The list as one ordered conditional: true keeps the row."""
    out = None
    for rule in rules:
        condition = rule.expression(features)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(statistics: DataFrame, labels: DataFrame, doc: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and badness of about ``most`` labelled rows at most, chosen by a hash of the id.

    Several labels of one document count as their mean; a null label is none.
    Of rows that share an id one teaches, the one of greatest features.
    """
    votes = labels.where(F.col(label).isNotNull()).groupBy(doc).agg(F.avg(F.col(label).cast("double")).alias("_q"))
    share = most / max(1, labels.count())
    if share < 1:
        votes = votes.where(F.pmod(F.xxhash64(F.col(doc), F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)))
    features = ratios()
    joined = statistics.join(votes, doc).groupBy(doc).agg(F.first("_q").alias("_q"), F.max(F.struct(*(c.alias(n) for n, c in features.items()))).alias("_f"))
    rows = joined.select(F.col(doc).alias("_d"), "_q", "_f.*").toPandas().sort_values(["_d", *features])
    return rows[list(features)].to_numpy(dtype=float), (rows["_q"] < 0.5).to_numpy()


def quality_verdicts(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = 20_000, precision: float = 0.95) -> tuple[DataFrame, list[Rule]]:
    """(statistics with ``base_failed`` and ``kept``, the learned rules).

    ``labels`` has 1 for good and 0 for bad documents. The rules are learned on
    about ``most_labelled`` labelled rows, a bound that does not grow with the
    table; statistics cover every row and whole texts. A row fails the base if
    it has under 20 words or over 30 % of its words in repeated windows; it is
    kept if it passes the base and no rule rejects it. Null and empty texts
    have no words and fail. Without labels of both kinds no rule is learned.
    Repeated rows are judged alike; other columns of ``docs`` are not returned.
    """
    statistics = stored(text_statistics(docs, doc, text), "statistics")
    features = ratios()
    x, bad = labelled_sample(statistics, labels, doc, label, most_labelled)
    rules = learn_rules(x, bad, list(features), precision)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = statistics.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & rules_column(rules, features))
    return judged, rules


def query(spark, sf_dir: str) -> DataFrame:
    """op8: verdicts on every document of ``documents``, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged, _ = quality_verdicts(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
