"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

An item's shingles are ordered by a hash. Items are partitioned by their number
of shingles; all items of a partition with at most u shingles keep their
``floor((1 - t) * u) + 1`` smallest hashes. A text that holds a share t of an
item's shingles lacks at most ``floor((1 - t) * n)`` of them, so it holds one of
the kept ones: the search finds every such text, and the exact count decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Words are runs of letters and digits, in lower case.
TOKEN = re.compile(r"[^\W_]+")


def kept(size: int, threshold: float) -> int:
    """How many smallest hashes the items of a partition keep, by its largest size."""
    return floor((1 - threshold) * size + 1e-9) + 1


def size_class(n: int) -> int:
    """Items of n shingles belong to the partition up to this size: powers of the square root of two."""
    upper = 1
    k = 0
    while upper < n:
        k += 1
        upper = floor(2 ** (k / 2))
    return upper


class Matcher:
    """Finds the items that a text contains. Built once from the items, used by each task."""

    def __init__(self, items: list[tuple], shingle: int, threshold: float) -> None:
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.shingles: list[set[tuple[int, ...]]] = []
        for _, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in TOKEN.findall((text or "").lower())]
            m = min(shingle, len(words))
            self.shingles.append({tuple(words[i : i + m]) for i in range(len(words) - m + 1)} if m else set())
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, own in enumerate(self.shingles):
            if own:
                m = len(next(iter(own)))
                codes = sorted(int(x) for x in self.codes(np.array(sorted(own), dtype=np.uint64)))
                for code in codes[: kept(size_class(len(own)), threshold)]:
                    found[m][code].append(k)
        self.minima = {m: dict(x) for m, x in found.items()}
        self.sorted_minima = {m: np.array(sorted(x), dtype=np.uint64) for m, x in found.items()}

    @classmethod
    def of(cls, state: dict) -> Matcher:
        """A matcher from the plain values of another, which is what is broadcast: workers need no copy of this package."""
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    @staticmethod
    def codes(words: np.ndarray) -> np.ndarray:
        """Hash of each row of word numbers; only candidates depend on it."""
        h = np.zeros(len(words), dtype=np.uint64)
        for j in range(words.shape[1]):
            h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def __call__(self, text: str | None) -> list[tuple]:
        """(item, shingles shared, shingles of the item) for each item contained to the threshold."""
        if not text:
            return []
        words = TOKEN.findall(text.lower())
        numbers = np.fromiter(map(self.vocabulary.get, words, _zeros(len(words))), dtype=np.uint64, count=len(words))
        out = []
        for m, minima in self.sorted_minima.items():
            if len(numbers) < m:
                continue
            known = numbers > 0
            whole = known[: len(numbers) - m + 1].copy()
            for j in range(1, m):
                whole &= known[j : len(numbers) - m + 1 + j]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            rows = numbers[at[:, None] + np.arange(m)]
            codes = self.codes(rows)
            hit = minima[np.minimum(np.searchsorted(minima, codes), len(minima) - 1)] == codes
            if not hit.any():
                continue
            own = set(map(tuple, rows.tolist()))
            for k in sorted({k for c in np.unique(codes[hit]) for k in self.minima[m][int(c)]}):
                shared = len(self.shingles[k] & own)
                if shared >= self.threshold * len(self.shingles[k]) - 1e-9:
                    out.append((self.ids[k], shared, len(self.shingles[k])))
        return out


def _zeros(n: int):
    from itertools import repeat

    return repeat(0, n)


def _small_items(items: DataFrame, item: str, text: str, most_bytes: int) -> list[tuple] | None:
    """The items if their size is proven to be within the bound, else None."""
    row = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    if row["b"] + 64 * row["n"] > most_bytes:
        return None
    return [tuple(r) for r in items.select(item, text).collect()]


def containment_pairs(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: float = 0.8, most_bytes: int = 4 << 20) -> DataFrame:
    """Pairs (document, item, ``n_shared``, ``n_item``, ``containment``) with containment of ``threshold`` or more.

    Containment is the share of an item's distinct ``shingle``-word shingles that
    the text has. An item of fewer words is one shingle, its whole sequence; an
    item without words is in no text. Null and empty texts contain nothing.
    Repeated documents or items give repeated pairs; null ids are ids like
    others, and rows that share an id are judged each. Extra columns are ignored.

    Items of up to ``most_bytes`` of text are broadcast (their shingles are about 40 times
    as much in a worker, 160 MB at most); more of them are joined, with
    the same result.
    """
    spark = docs.sparkSession
    small = _small_items(items, item, item_text, most_bytes)
    doc_type, item_type = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    if small is None:
        found = _by_join(docs, items, text, item_text, shingle, threshold)
        named = docs.select(F.col(doc).alias("_d"), _text_key(text).alias("k"))
        of_item = items.select(F.col(item).alias("_i"), _text_key(item_text).alias("i"))
        pairs = found.join(named, "k").join(of_item, "i")
        return pairs.select(F.col("_d").alias(doc), F.col("_i").alias(item), "n_shared", F.col("n").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment"))
    shared = spark.sparkContext.broadcast(vars(Matcher(small, shingle, threshold)))
    ids = docs.select(F.col(doc).alias("d")).schema["d"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher.of(shared.value)
        for batch in by_bytes(batches, "t"):
            rows = [(d, *hit) for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist()) for hit in match(t)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["d", "i", "n_shared", "n_item"]), schema=out_schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_type

    out_schema = pa.schema([("d", to_arrow_type(ids)), ("i", to_arrow_type(items.schema[item].dataType)), ("n_shared", pa.int64()), ("n_item", pa.int64())])
    pairs = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"d {doc_type}, i {item_type}, n_shared long, n_item long")
    return pairs.select(F.col("d").alias(doc), F.col("i").alias(item), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _text_key(text: str):
    """Rows of equal texts have equal keys; null is empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _words(table: DataFrame, text: str) -> DataFrame:
    """(``k``, ``w``): key and words of each different text with words."""
    pattern = TOKEN

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pattern.findall((t or "").lower()))

    texts = table.select(_text_key(text).alias("k"), F.col(text).alias("t")).dropDuplicates(["k"])
    return texts.select("k", words("t").alias("w")).where(F.size("w") > 0)


def _shingles(words: DataFrame, m) -> DataFrame:
    """Distinct shingles of ``m`` words of each row: (key, s)."""
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))
    return words.select("k", F.explode(F.array_distinct(grams)).alias("s"))


def _by_join(docs: DataFrame, items: DataFrame, text: str, item_text: str, shingle: int, threshold: float) -> DataFrame:
    """(``k``, ``i``, ``n_shared``, ``n``) by keys of texts, for item tables too large to broadcast: shingles meet by equality joins."""
    shortest = F.least(F.lit(shingle), F.size("w"))
    of_items = _shingles(_words(items, item_text), shortest)
    sizes = of_items.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    ranked = of_items.join(sizes, "k").withColumn("h", F.xxhash64("s"))

    @F.pandas_udf("int")
    def keep(n: pd.Series) -> pd.Series:
        return n.map(lambda x: kept(size_class(x), threshold)).astype("int32")

    limits = sizes.select("n").distinct().withColumn("keep", keep("n"))
    own = ranked.groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("h", "s"))).alias("all")).join(limits, "n")
    minima = own.select(F.col("k").alias("i"), "n", F.explode(F.slice("all", F.lit(1), F.col("keep"))).alias("m")).select("i", "n", F.col("m.s").alias("s"))
    texts = _words(docs, text)
    of_docs = _shingles(texts, shortest)
    # Items shorter than a shingle are looked for as runs of their own length in longer texts.
    lengths = minima.select(F.size(F.split("s", " ")).alias("m")).where(F.col("m") < shingle).distinct().collect()
    for row in lengths:  # fewer than ``shingle`` rows
        of_docs = of_docs.union(_shingles(texts.where(F.size("w") > row["m"]), F.lit(row["m"])))
    candidates = of_docs.join(minima, "s").select("k", "i", "n").distinct()
    shared = candidates.join(of_items.withColumnRenamed("k", "i"), "i").join(of_docs.distinct(), ["k", "s"]).groupBy("k", "i", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.where(F.col("n_shared") >= threshold * F.col("n") - 1e-9)


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: float = 0.8, most_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item to the threshold; columns as they were, null texts stay. Ids play no part."""
    small = _small_items(items, item, item_text, most_bytes)
    if small is None:
        found = _by_join(docs, items, text, item_text, shingle, threshold).select("k").distinct()
        return docs.join(found, _text_key(text) == found["k"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(vars(Matcher(small, shingle, threshold)))

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher.of(shared.value)
        for texts in parts:
            yield pd.Series([not match(t) for t in texts], dtype=bool)

    return docs.where(clean(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document of ``documents`` that contains an item of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return containment_pairs(docs, items).select("doc_id", "item_id", "n_shared", "n_item", "containment")


SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS s
      FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
      FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS k) WHERE len(w) > 4),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""
