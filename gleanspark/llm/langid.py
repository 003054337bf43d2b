"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import fitted

#: Families of closely related languages; a language not named here is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}
DIMENSIONS = 4096
#: Languages whose sampling shares are broadcast; more of them are joined.
MOST_BROADCAST = 10_000
#: Parts in which the sample comes to the driver at least.
PARTS = 8
#: ASCII bytes that are no letters become blanks.
FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed 2-, 3- and 4-byte counts of the lower-cased text."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace").translate(FOLD)
    counts = np.zeros(DIMENSIONS)
    for start in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[start : start + (1 << 20) + 3], dtype=np.uint8).astype(np.uint32)
        gram = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            slots = ((gram ^ np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            end = min(len(slots), 1 << 20)
            counts += np.bincount(slots[:end], minlength=DIMENSIONS)
    x = np.sqrt(counts)
    norm = np.linalg.norm(x)
    return (x / norm if norm else x).astype(np.float32)


def train_svm(x: np.ndarray, positive: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient descent; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = np.where(positive, 1.0, -1.0).astype(x.dtype)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(x.dtype) * c
    step = 1.0 / (1.0 + 4.0 * float(weight.sum()))
    w = v = np.zeros(x.shape[1], dtype=x.dtype)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = v - 2 * (x.T @ (weight * slack * y))
        new = v - step * gradient
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """Family machines (one against the rest) and, in each family, a machine per pair of languages."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pairs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, text: str) -> tuple[str, float]:
        """The language and how sure the decisions on the way to it were, 0 to 1."""
        if not self.families:
            return "und", 0.0
        x = np.append(features(text), np.float32(1))
        sure, family = 1.0, self.families[0]
        if len(self.families) > 1:
            scores = self.family_weights @ x
            k = int(np.argmax(scores))
            family = self.families[k]
            sure *= logistic(scores[k] - np.delete(scores, k).max())
        languages = self.members[family]
        if len(languages) == 1:
            return languages[0], sure
        margins = self.pair_weights[family] @ x
        wins, total = np.zeros(len(languages)), np.zeros(len(languages))
        for (i, j), m in zip(self.pairs[family], margins):
            wins[i if m >= 0 else j] += 1
            total[i] += m
            total[j] -= m
        best = max(range(len(languages)), key=lambda i: (wins[i], total[i], -i))
        own = [m if i == best else -m for (i, j), m in zip(self.pairs[family], margins) if best in (i, j)]
        return languages[best], sure * logistic(2 * min(own))


def logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * z, -30, 30))))


def fit(x: np.ndarray, languages: list[str], families: dict[str, str]) -> Model:
    """Train on feature rows and their languages. No rows give a model that answers ``und``."""
    model = Model()
    names = np.array([families.get(v, v) for v in languages], dtype=object)
    langs = np.array(languages, dtype=object)
    model.families = sorted(set(names))
    if len(model.families) == 2:
        w = train_svm(x, names == model.families[0])
        model.family_weights = np.stack([w, -w]) / 2
    elif len(model.families) > 2:
        model.family_weights = np.stack([train_svm(x, names == f) for f in model.families])
    for f in model.families:
        model.members[f] = sorted(set(langs[names == f]))
        model.pairs[f] = list(combinations(range(len(model.members[f])), 2))
        rows = []
        for i, j in model.pairs[f]:
            a, b = model.members[f][i], model.members[f][j]
            at = (langs == a) | (langs == b)
            rows.append(train_svm(x[at], langs[at] == a))
        if rows:
            model.pair_weights[f] = np.stack(rows)
    return model


def train(labelled: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, most_rows: int = 8000, families: dict[str, str] | None = None) -> Model:
    """Fit on about ``per_language`` different texts of each language, chosen by a hash of the text.

    About ``most_rows`` texts are taken in all, equally many of each language
    where there are very many, and twice as many at most: the bound does not grow with the
    table, whatever its copies, as equal texts count and teach once a language. Rows with
    a null text, without a letter or with a null language teach nothing; ids
    are not looked at. Whole texts are read, long ones too.
    """
    usable = labelled.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(text), F.lit("language")).alias("x"))
    counts = stored(usable.groupBy("l").agg(F.approx_count_distinct("x").alias("n")).coalesce(8), "languages")
    languages = counts.count()
    each = min(per_language, most_rows / max(1, languages))
    # The shares are a few bytes a language: broadcast up to a bound, so that texts are not dealt out by language.
    shares = counts.select("l", (F.lit(each) / F.col("n") * (1 << 30)).alias("share"))
    few = F.broadcast(shares) if languages <= MOST_BROADCAST else shares
    chosen = usable.withColumn("h", F.pmod("x", F.lit(1 << 30))).join(few, "l").where("h < share")
    # Copies go before and in the shuffle; what is left is about as many texts as the sample has.
    chosen = chosen.groupBy("l", "x").agg(F.first("h").alias("h"), F.first("t").alias("t"))

    @F.pandas_udf("binary")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t).tobytes() for t in texts])

    # The vectors come to the driver a part at a time, so that its JVM never holds the sample as a whole.
    sample = stored(fitted(chosen.select("h", "l", vector("t").alias("x")), most_rows), "sample")
    few = sample.coalesce(PARTS)
    if sample.count() > 2 * most_rows:
        last = sample.select("h", "l").orderBy("h", "l").limit(2 * most_rows).agg(F.max(F.struct("h", "l")).alias("k")).first()["k"]
        few = few.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("l") <= last["l"]))
    rows = sorted((r["h"], r["l"], bytes(r["x"])) for r in few.toLocalIterator())[: 2 * most_rows]
    discard(counts)
    discard(sample)
    x = np.stack([np.frombuffer(r[2], dtype=np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), dtype=np.float32)
    return fit(x, [r[1] for r in rows], FAMILIES if families is None else families)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row of ``docs``, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or if nothing
    was learned. Columns named like the new ones are replaced; repeated rows are
    judged alike; empty tables stay empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(**shared.value)
        for texts in parts:
            found = [("und", 0.0) if t is None else own.predict(t) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    read = F.when(has_letter(F.col(text)), F.col(text))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.select(F.struct(*kept).alias("row"), judge(read).alias("found")) if kept else docs.select(judge(read).alias("found"))
    return judged.select(*(["row.*"] if kept else []), "found.lang_pred", "found.score")


def held_out(doc: Column) -> Column:
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(5)) == 0


def query(spark, sf_dir: str) -> DataFrame:
    """op4: language of every document of ``documents``, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
