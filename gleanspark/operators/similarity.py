"""Vector top-k with a recency boost, near-duplicate removal in the answer, and keyword lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_line
from ..session import stored

# Fixed values.
LEAST, ALIKE, RECENCY_BASE, RECENCY_SHARE = 0.01, 0.85, 0.85, 0.15


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", order: str | None = None) -> DataFrame:
    """The ``k`` rows most similar to ``query`` with ``score`` above 0.01, best first.

    With ``order`` (0 for the oldest row, ascending) scores grow by recency: 0.85 for
    the oldest to 1 for the newest. Partial top-k per partition, no sort of the table.
    """
    score = cosine(F.col(vector), F.array(*map(F.lit, query)))
    if order:
        newest = vectors.agg(F.max(order)).first()[0] or 0
        age = (F.lit(newest) - F.col(order)) / F.lit(max(1, newest))
        score = score * (RECENCY_BASE + RECENCY_SHARE * (1 - age))
    return vectors.withColumn("score", score).where(F.col("score") > LEAST).orderBy(F.desc("score")).limit(k)


def without_alike(ranked: list, vector: str = "embedding", alike: float = ALIKE) -> list:
    """From a top-k answer, best first, drop rows whose cosine to a kept one is over ``alike``."""
    kept: list = []
    units: list = []
    for row in ranked:
        v = np.array(row[vector], dtype=float)
        v = v / (np.linalg.norm(v) or 1.0)
        if all(float(v @ u) <= alike for u in units):
            kept.append(row)
            units.append(v)
    return kept


def keyword_lines(texts: DataFrame, keywords: str, text: str = "text", width: int = 256, most: int = 64) -> DataFrame:
    """Add ``lines``: the first distinct lines of up to ``width`` bytes that hold any of the keywords."""
    needles = keywords.split()
    hit = F.filter(F.split(text, "\n"), lambda line: (F.octet_length(line) <= width) & (F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(line, n)) if needles else F.lit(False)))
    return texts.withColumn("lines", F.slice(F.array_distinct(hit), 1, most))


def search_blocks(blocks: DataFrame, query: list[float], keywords: str, k: int, text: str = "text", vector: str = "embedding", order: str | None = None) -> DataFrame:
    """The ``k`` blocks nearest to ``query`` that score over the least, with their ``lines`` that hold a keyword."""
    return keyword_lines(top_k(blocks, query, k, vector, order), keywords, text).where(F.size("lines") > 0)


def context(ranked: DataFrame, question: str, k: int, text: str = "text", vector: str = "embedding", width: int = 100) -> list[str]:
    """Up to ``k`` remembered texts for a question, from a top-(2k + 1) answer: first the question's own
    copies go, then what is like a better one; cut to ``width`` characters."""
    own = ranked.sparkSession.range(1).select(normal_line(F.lit(question)).alias("q")).first()["q"]
    rows = ranked.where(normal_line(F.col(text)) != own).orderBy(F.desc("score")).limit(2 * k + 1).collect()
    return [r[text][:width] + ("..." if len(r[text].encode()) > width else "") for r in without_alike(rows, vector)[:k]]


#: Scores that a task holds at once, and pairs whose exact scores it takes at once.
CELLS, PAIRS = 1 << 20, 1 << 15
#: More than what a product of matrices may round a score of its own by.
SLACK = 1e-9


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


class Nearest:
    """The ``k`` best rows of each query so far (ties by id), as arrays sorted by query; memory is bounded by queries times ``k`` and ``CELLS``."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.least = np.full(len(queries), LEAST)
        self.held: tuple[np.ndarray, ...] | None = None

    def add(self, ids: np.ndarray, rows: np.ndarray, barred: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Try rows of length 1; ``barred``: numbers of the rows and of the queries that must not be equal."""
        step = max(1, CELLS // len(self.queries))
        for at in range(0, len(ids), step):
            part = rows[at : at + step]
            near = self.queries @ part.T
            if barred:
                near[barred[1][:, None] == barred[0][None, at : at + step]] = -1.0
            least = self.least - SLACK
            likely = near >= least[:, None]
            if part.shape[0] > self.k and likely.sum() > 4 * self.k * len(self.queries):
                least = np.maximum(least, np.partition(near, part.shape[0] - self.k, axis=1)[:, part.shape[0] - self.k] - SLACK)
                likely = near >= least[:, None]
            q, r = np.nonzero(likely)
            for start in range(0, len(q), PAIRS):
                self.merge(q[start : start + PAIRS], ids[at : at + step], part, r[start : start + PAIRS])

    def merge(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, r: np.ndarray) -> None:
        # Summed pair by pair: equal vectors have equal scores, wherever they stand in a product of matrices.
        score = np.einsum("ij,ij->i", self.queries[q], rows[r])
        fits = (score > LEAST) & (score >= self.least[q])
        q, names, score = q[fits], ids[r[fits]], score[fits]
        if not len(q):
            return
        if self.held:
            q, names, score = (np.concatenate(x) for x in zip(self.held, (q, names, score)))
        order = np.lexsort((names, -score, q))
        q, names, score = q[order], names[order], score[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        last = rank == self.k - 1
        self.least[q[last]] = score[last]
        kept = rank < self.k
        self.held = q[kept], names[kept], score[kept]


def nearest_of_each(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str = "embedding", block: int = 8192, skip: str | None = None) -> DataFrame:
    """``query_id``, ``row_id``, ``score``: the ``k`` rows nearest to each query by cosine, over the least score; ties by ``row_id``.

    With ``skip``, a column of whole numbers in both tables, a query leaves out the rows that have its own number. Queries
    are taken in blocks of a bounded size; each task scores its rows against a
    block in slices of ``CELLS`` scores and keeps its own ``k`` best of every query, so
    that its memory grows with neither table and what is shuffled is ``k`` rows a query and task. With several blocks the
    rows, vectors and all, are stored once, and so is what each block finds.
    """
    kind, rkind = queries.schema[query_id].dataType.simpleString(), rows.schema[row_id].dataType.simpleString()
    schema = f"q {kind}, r {rkind}, score double"
    spark, found = queries.sparkSession, None
    mark = F.col(skip).cast("long") if skip else F.lit(None).cast("long")
    asked = stored(queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v"), mark.alias("s")), "queries")
    blocks = max(1, -(-asked.count() // block))
    own = rows.select(F.col(row_id).alias("r"), F.col(vector).alias("v"), mark.alias("s"))
    own = stored(own, "rows") if blocks > 1 else own

    for b in range(blocks):  # a block of about so many queries comes to the driver at a time
        part = [(r["q"], r["v"], r["s"]) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect()]
        if not part:
            continue
        marks = np.array([x[2] for x in part], dtype=np.int64) if skip else None
        shared = spark.sparkContext.broadcast(([x[0] for x in part], unit(np.array([x[1] for x in part], dtype=float)), marks))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix, marks = shared.value
            best = Nearest(matrix, k)
            for batch in batches:
                for at in range(0, len(batch), 2000):
                    some = batch.iloc[at : at + 2000]
                    barred = (some["s"].to_numpy(dtype=np.int64), marks) if marks is not None else None
                    best.add(some["r"].to_numpy(), unit(np.stack(some["v"].to_numpy()).astype(float)), barred)
            if best.held:
                q, r, near = best.held
                for at in range(0, len(q), 10_000):
                    yield pd.DataFrame({"q": [names[x] for x in q[at : at + 10_000].tolist()], "r": r[at : at + 10_000], "score": near[at : at + 10_000]})

        best = own.mapInPandas(score, schema)
        if blocks > 1:
            best = stored(best, "near")
            shared.destroy()
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))
    return found.withColumn("k", rank).where(F.col("k") <= k).select(F.col("q").alias(query_id), F.col("r").alias(row_id), "score")


def recall(questions: DataFrame, memory: DataFrame, k: int, question_id: str = "question_id", row_id: str = "row_id", text: str = "text", vector: str = "embedding", width: int = 100) -> DataFrame:
    """``question_id``, ``place`` (from 1), ``row_id``, ``score``, ``text``: up to ``k`` remembered texts for each question; :func:`context` for many.

    Of the 2 ``k`` + 1 nearest rows that are not the question's own copies, those like a
    better one go; texts are cut to ``width`` characters. The 2 ``k`` + 1 rows of a
    question are compared in one task, all questions in parallel. Null texts are
    neither asked nor remembered; questions without a near row have no rows.
    """
    line = F.xxhash64(normal_line(F.col(text)))
    asked = questions.where(F.col(text).isNotNull()).withColumn("_line", line)
    held = memory.where(F.col(text).isNotNull()).withColumn("_line", line)
    near = nearest_of_each(asked, held, 2 * k + 1, question_id, row_id, vector, skip="_line")
    told = near.join(held.select(row_id, F.col(text).alias("_text"), F.col(vector).alias("_vector")), row_id)
    kind, rkind = questions.schema[question_id].dataType.simpleString(), memory.schema[row_id].dataType.simpleString()

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        best = rows.sort_values(["score", row_id], ascending=[False, True]).to_dict("records")
        kept = without_alike(best, "_vector")[:k]
        cut = [r["_text"][:width] + ("..." if len(r["_text"].encode()) > width else "") for r in kept]
        return pd.DataFrame({question_id: [r[question_id] for r in kept], "place": range(1, len(kept) + 1), row_id: [r[row_id] for r in kept], "score": [r["score"] for r in kept], "text": cut})

    return told.groupBy(question_id).applyInPandas(greedy, f"`{question_id}` {kind}, place int, `{row_id}` {rkind}, score double, text string")


def embed_texts(texts: DataFrame, text: str = "text", dimensions: int = 64, seed: int = 20_240_229) -> DataFrame:
    """Add ``embedding``: the byte histogram under a signed Hadamard projection, of length 1.

    Signs are drawn by an xorshift generator from ``seed``. Empty and null texts get zeros.
    """
    state, signs = seed, []
    for _ in range(256):
        state ^= (state << 13) & (2**64 - 1)
        state ^= state >> 7
        state ^= (state << 17) & (2**64 - 1)
        signs.append(1.0 if state % 2 == 0 else -1.0)
    i = np.arange(256)
    hadamard = 1.0 - 2.0 * (np.bitwise_count(i[:dimensions, None] & i[None, :]) % 2)
    projection = (hadamard * np.array(signs)).T / np.sqrt(dimensions)

    @F.pandas_udf("array<float>")
    def embed(column: pd.Series) -> pd.Series:
        raw = np.stack([np.bincount(np.frombuffer((t or "").encode(), dtype=np.uint8), minlength=256) for t in column]) if len(column) else np.zeros((0, 256))
        found = raw @ projection
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        return pd.Series(list((found / np.where(norms > 0, norms, 1)).astype(np.float32)))

    return texts.withColumn("embedding", embed(F.col(text)))


def newest(rows: DataFrame, order: str, capacity: int) -> DataFrame:
    """The ``capacity`` rows of greatest ``order``."""
    return rows.orderBy(F.desc(order)).limit(capacity)
