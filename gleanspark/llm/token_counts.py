"""Token counts: texts are encoded in byte-balanced batches and only the lengths leave the task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: A blank behind a character that is neither a blank nor U+2581. No piece of the
#: model has U+2581 behind another character, so no merge crosses this place; the
#: blank itself is what the encoder puts before each segment anyway.
SAFE = re.compile("(?<=[^ ▁]) ")


def parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """Cut a long text at safe boundaries into parts of about ``most`` characters."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def segments(text: str) -> list[str]:
    if "  " in text or "▁" in text or text[:1] == " ":
        return SAFE.split(text)
    return text.split(" ")


def piece_counter(model: str, cached: int = 300_000, most: int = 64 << 20):
    """Function from texts to token counts for a SentencePiece model.

    Segments between safe boundaries are encoded once each; up to ``cached`` of
    them, and about ``most`` characters, are remembered from batch to batch. Long
    ones are not remembered.
    """
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=model)
    known: dict[str, int] = {}
    held = 0

    def count(texts: list[str]) -> list[int]:
        nonlocal held
        split = [[segments(p) for p in parts(t)] if t else [] for t in texts]
        if len(known) > cached or held > most:
            known.clear()
            held = 0
        known[""] = 1
        new = set()
        for text in split:
            for part in text:
                new.update(part)
        new -= known.keys()
        order = list(new)
        known.update(zip(order, map(len, encoder.encode(order, num_threads=1))))
        out = [sum(sum(map(known.__getitem__, part)) for part in text) for text in split]
        for segment in order:
            if len(segment) > 1000:
                del known[segment]
            else:
                held += len(segment)
        return out

    return count


def json_counter(model: str):
    """Function from texts to token counts for a tokenizers file; whole texts, since its pre-tokenizer sees context."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(model)
    encoder.no_truncation()
    encoder.no_padding()
    return lambda texts: [len(x) for x in encoder.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int = 4096, batch_bytes: int = 4 << 20) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model`` is the path of a ``.model`` (sentencepiece) or ``.json``
    (tokenizers) file that every executor has. Counts are those of the library,
    without begin, end or added special tokens and without truncation.

    A null text counts as empty: 0 bytes, 0 tokens. Columns named like the new
    ones are replaced. Repeated rows are counted each; empty tables stay empty.
    """
    @F.pandas_udf("n long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = piece_counter(model) if model.endswith(".model") else json_counter(model)
        for series in batches:
            whole = pa.RecordBatch.from_arrays([pa.array(series, pa.large_string(), from_pandas=True)], ["t"])
            tokens: list[int] = []
            for batch in by_bytes(iter([whole]), "t", batch_bytes):
                tokens += count([x or "" for x in batch.column("t").to_pylist()])
            yield pd.DataFrame({"n": tokens}, dtype="int64")

    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")))
        .withColumn("n_tokens", counted(F.col(text))["n"])
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: token counts of every whole text of ``documents`` for the 32k piece model."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
