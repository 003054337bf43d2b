"""SimHash near-duplicates, found by the general pigeonhole principle over groups of correlated bits.

A fingerprint's bits are divided into partitions, and each partition gets a
threshold; -1 leaves it out. If thresholds plus one add up to the distance plus
one, any two fingerprints within the distance agree to the threshold in one
partition at least. Dynamic programming shares the thresholds out so that the
estimated number of probes and candidates is least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from ..session import discard, stored
from .common import by_bytes, fitted, may_hold, utf8
from .components import connected_components

SEED = 42
#: Bit patterns of a byte, lowest bit first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BLOCK = 4
#: Estimated costs: a probe row through a shuffle and a join, and a candidate compared, in microseconds.
PROBE_COST, CANDIDATE_COST = 1.5, 0.02
#: Rows alike in some bits that are a crowd.
CROWD = 16
#: Tasks that sum up a table of bounded size, whatever the session's number of shuffle partitions.
FEW = 8


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle; of the whole sequence if there are fewer words."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1]
    pieces = map(joined.__getitem__, map(slice, starts.tolist(), ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; of none: 0."""
    if not len(hashes):
        return 0
    columns = hashes.view(np.uint8).reshape(-1, 8)
    out = np.empty(64, dtype=bool)
    for k in range(8):
        out[8 * k : 8 * k + 8] = 2 * (np.bincount(columns[:, k], minlength=256) @ BITS) > len(hashes)
    return int(np.packbits(out, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc``, ``fp`` long: the fingerprint's 64 bits). Null texts have no words."""
    doc_type = docs.schema[doc].dataType
    schema = pa.schema([(doc, to_arrow_type(doc_type)), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t"):
            found = np.array([fingerprint(shingle_hashes(t, width)) for t in utf8(batch.column("t"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("d").cast(schema.field(0).type), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"`{doc}` {doc_type.simpleString()}, fp long")


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """All words that flip up to ``threshold`` bits of this partition."""
        return [sum(1 << b for b in chosen) for t in range(self.threshold + 1) for chosen in combinations(self.bits, t)]


def bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(words: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of rows with both bits set), over all rows of column ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            x = bit_matrix(np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))).astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                total += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(64), 64), pa.int32()), pa.array(np.tile(np.arange(64), 64), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])

    out = np.zeros((64, 64))
    for r in words.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).coalesce(FEW).collect():
        out[r["i"], r["j"]] = r["n"]
    return words.count(), out


def correlated_order(n: int, both: np.ndarray) -> list[int]:
    """The bits in blocks of ``BLOCK`` that go together: each block starts at the bit with the
    strongest correlation to any left, and takes the bits most correlated with what it has."""
    if n < 2:
        return list(range(64))
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, order = list(range(64)), []
    while left:
        block = [max(left, key=lambda b: (r[b, left].max() if len(left) > 1 else 0, -b))]
        left.remove(block[0])
        while left and len(block) < BLOCK:
            block.append(max(left, key=lambda b: (r[b, block].sum(), -b)))
            left.remove(block[-1])
        order += block
    return order


def block_distances(words: DataFrame, order: list[int]) -> np.ndarray:
    """For each block of bits: the shares of pairs of rows that differ in 0, 1, ... of its bits, from counts over all rows."""
    blocks = [order[i : i + BLOCK] for i in range(0, 64, BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(blocks), 1 << BLOCK), dtype=np.int64)
        for batch in batches:
            x = bit_matrix(np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False)))
            for k, bits in enumerate(blocks):
                total[k] += np.bincount(x[:, bits] @ (1 << np.arange(BLOCK)), minlength=1 << BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(blocks)), 1 << BLOCK), pa.int32()), pa.array(np.tile(np.arange(1 << BLOCK), len(blocks)), pa.int32()), pa.array(total.ravel())], names=["k", "v", "n"])

    counts = np.zeros((len(blocks), 1 << BLOCK))
    for r in words.select("fp").mapInArrow(run, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).coalesce(FEW).collect():
        counts[r["k"], r["v"]] = r["n"]
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    v = np.arange(1 << BLOCK)
    apart = np.bitwise_count(v[:, None] ^ v[None, :])
    return np.stack([[np.sum(np.outer(s, s)[apart == d]) for d in range(BLOCK + 1)] for s in share])


def share_thresholds(n: int, widths: list[int], distances: list[np.ndarray], distance: int) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds, which plus one add up to ``distance + 1``."""
    best = {0: (0.0, [])}
    for width, d in zip(widths, distances):
        reach = np.cumsum(d)
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(width, distance - used) + 1):
                own = 0.0
                if t >= 0:
                    own = n * PROBE_COST * (sum(comb(width, k) for k in range(t + 1)) + 1) + 0.5 * n * n * reach[min(t, len(reach) - 1)] * CANDIDATE_COST
                if used + t + 1 not in new or cost + own < new[used + t + 1][0]:
                    new[used + t + 1] = (cost + own, [*chosen, t])
        best = new
    return best[distance + 1]


def plan_partitions(words: DataFrame, distance: int, most_flips: int = 4096) -> list[Partition]:
    """Partitions and thresholds for all pairs within ``distance`` of each other in ``words`` (column ``fp``, distinct)."""
    n, both = bit_counts(words)
    order = correlated_order(n, both)
    blocks = block_distances(words, order)
    found = None
    for parts in range(2, min(len(blocks), distance + 1) + 1):
        sizes = [len(blocks) // parts + (k < len(blocks) % parts) for k in range(parts)]
        ends = np.cumsum(sizes)
        widths = [BLOCK * s for s in sizes]
        distances = []
        for s, e in zip(sizes, ends):
            d = np.ones(1)
            for k in range(e - s, e):
                d = np.convolve(d, blocks[k])
            distances.append(d)
        cost, chosen = share_thresholds(n, widths, distances, distance)
        if sum(comb(w, k) for w, t in zip(widths, chosen) for k in range(t + 1)) <= most_flips and (found is None or cost < found[0]):
            found = (cost, [Partition(tuple(order[BLOCK * (e - s) : BLOCK * e]), t) for s, e, t in zip(sizes, ends, chosen)])
    return [p for p in found[1] if p.threshold >= 0]


def signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def spanning_links(words: DataFrame, distance: int, partitions: list[Partition]) -> DataFrame:
    """(``a``, ``b``): links of rows to the least row of the crowds that they are in, a few for each row.

    A crowd is ``CROWD`` rows or more that are alike in the bits of two
    partitions. Crowds are summed up before they are joined, and each row meets
    one other in each of its crowds.
    """
    masks = {p.mask | q.mask for p, q in combinations(partitions, 2)} if len(partitions) > 2 else {p.mask for p in partitions}
    keys = F.array(*(F.struct(F.lit(k).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for k, m in enumerate(sorted(masks))))
    rows = words.select("id", "fp", F.explode(keys).alias("s")).select("id", "fp", "s.part", "s.value")
    n = words.count()
    crowds = rows.groupBy("part", "value").agg(F.min(F.struct("id", "fp")).alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD)
    crowds = fitted(crowds, n, SETS_A_TASK)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= distance
    links = rows.join(crowds, ["part", "value"]).where((F.col("id") != F.col("hub.id")) & near).select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
    return fitted(links, n, SETS_A_TASK).distinct()


def close_pairs(words: DataFrame, distance: int, partitions: list[Partition] | None = None) -> DataFrame:
    """(``a``, ``b``): ids of all pairs of rows of ``words`` (``id``, distinct ``fp``) within ``distance`` bits.

    Values of each partition meet the values that its threshold lets through,
    and the join keeps the pairs whose whole fingerprints are close enough. If
    ``words`` has a column ``root``, only pairs of different roots are kept.
    """
    partitions = partitions or plan_partitions(words, distance)
    root = F.col("root") if "root" in words.columns else F.col("id")

    def values(flips: bool):
        return F.array(*(F.struct(F.lit(k).cast("byte").alias("part"), (F.col("fp").bitwiseXOR(F.lit(signed(x))).bitwiseAND(F.lit(signed(p.mask)))).alias("value")) for k, p in enumerate(partitions) for x in (p.flips() if flips else [0])))

    plain = words.select("id", "fp", root.alias("root"), F.explode(values(False)).alias("s")).select("s.part", "s.value", F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("root").alias("rb"))
    if all(p.threshold == 0 for p in partitions):
        probes = plain.select("part", "value", F.col("b").alias("a"), F.col("fb").alias("fa"), F.col("rb").alias("ra"))
    else:
        probes = words.select("id", "fp", root.alias("root"), F.explode(values(True)).alias("s")).select("s.part", "s.value", F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("root").alias("ra"))
    near = (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance) & (F.col("ra") != F.col("rb"))
    met = probes.alias("p").join(plain.alias("q"), (F.col("p.part") == F.col("q.part")) & (F.col("p.value") == F.col("q.value")) & (F.col("a") < F.col("b")) & near)
    return met.select("a", "b").distinct()


def fingerprint_classes(docs: DataFrame, width: int = 4, distance: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc``, ``fp``, ``root``) for every row: documents link at ``distance`` or fewer differing
    fingerprint bits, and root is the smallest id that links lead to.

    Equal fingerprints become one row first, so copies never meet in pairs. Crowds
    of alike fingerprints are spanned by a few links a row; pairs are looked for
    between the classes that are left, so that a crowd's rows are not all paired.
    Texts without words, null ones among them, have fingerprint 0 and link like
    any other. ``doc`` must be an integer; repeated ids are rows of one class.
    Other columns of ``docs`` are not returned.
    """
    prints = stored(fingerprints(docs, width, doc, text), "prints")
    words = stored(prints.groupBy("fp").agg(F.min(doc).alias("id")).where("id IS NOT NULL"), "words")
    partitions = plan_partitions(words, distance)
    links = stored(spanning_links(words, distance, partitions), "links")
    spanned = words.withColumn("root", F.col("id"))
    if not links.isEmpty():
        spanned = stored(words.join(connected_components(links, "a", "b"), "id", "left").withColumn("root", F.coalesce("root", "id")), "spanned")
    pairs = stored(close_pairs(spanned, distance, partitions).unionByName(links), "pairs")
    roots = connected_components(pairs, "a", "b")
    named = stored(words.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("root")), "named")
    for table in (links, spanned, pairs, words):
        discard(table)
    return prints.join(named, "fp", "left").select(doc, "fp", "root")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit names of the different ``width``-word shingles, mixed from the words' hashes; of the whole sequence if there are fewer words."""
    words = np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split()), dtype=np.uint64)
    width = min(width, len(words))
    h = np.full(len(words) - width + 1 if width else 0, width, dtype=np.uint64)
    for j in range(width):
        h = (h ^ words[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


#: Bits of the parity sketch of a shingle set.
SKETCH = 2048


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes' counts in ``SKETCH`` slots. Two sets differ in as many hashes at least as their sketches in bits."""
    return np.packbits(np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def prefix_length(n: int, similarity: float) -> int:
    """Two sets of the similarity share one of so many first members at least, in any order that is the same for all sets."""
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def prefix(hashes: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first members of a sorted set in the order of their slots' ``levels``, then of the hashes."""
    shift = np.uint64(64 - (len(levels).bit_length() - 1))
    order = np.argsort(levels[(hashes >> shift).astype(np.int64)], kind="stable")
    return hashes[order[: prefix_length(len(hashes), similarity)]]


def shingle_levels(texts: DataFrame, width: int, n: int) -> np.ndarray:
    """How common the shingles of each hash slot are, in half octaves, over all rows of column ``t``. Only an order
    follows from it, so that shared slots lose nothing."""
    bits = min(21, max(12, ceil(log(n + 2, 2)) + 3))
    page = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in by_bytes(batches, "t"):
            for t in utf8(batch.column("t")):
                np.add.at(total, (shingle_set(t, width) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        pages = np.minimum(total, 65535).astype("<u2").reshape(-1, page)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pages)), pa.int32()), pa.array([x.tobytes() for x in pages], pa.binary())], names=["page", "counts"])

    @F.pandas_udf("binary")
    def level(counts: pd.Series) -> bytes:
        total = np.zeros(page)
        for x in counts:
            total += np.frombuffer(x, dtype="<u2")
        return (2 * np.log2(1 + total)).astype(np.uint8).tobytes()

    levels = np.zeros((1 << bits) // page * page, dtype=np.uint8).reshape(-1, page)
    for r in texts.mapInArrow(count, "page int, counts binary").groupBy("page").agg(level("counts").alias("x")).coalesce(FEW).collect():
        levels[r["page"]] = np.frombuffer(r["x"], dtype=np.uint8)
    return levels.ravel()


def least_common(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Members that sets of these sizes share at least, if they have the similarity."""
    return np.ceil(similarity * (a.astype(np.int64) + b) / (1 + similarity) - 1e-9).astype(np.int64)


def may_reach(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, places: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows that meet at their first common member, at these places of the order, can have the similarity."""
    left = np.minimum(sizes[i] - places[i], sizes[j] - places[j])
    return (left >= least_common(sizes[i], sizes[j], similarity)) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9)


def closest(apart: np.ndarray, i: np.ndarray, j: np.ndarray, roots: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """The places of the ``most`` closest pairs of each two roots, and whether there are others."""
    low, high = np.minimum(roots[i], roots[j]), np.maximum(roots[i], roots[j])
    order = np.lexsort((apart, high, low))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    start = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < most], bool((rank >= most).any())


def spanning(apart: np.ndarray, i: np.ndarray, j: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, bool]:
    """The places of the closest pairs that span what all pairs span of the roots, and whether there are others."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    order = np.argsort(apart, kind="stable")
    kept = []
    for k, a, b in zip(order.tolist(), roots[i[order]].tolist(), roots[j[order]].tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return np.array(kept, dtype=np.int64), len(kept) < len(order)


def pairs_across(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, roots: np.ndarray, sketches: np.ndarray, similarity: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(ids, ids, whether some are left out) of rows of one key and different roots that can have the similarity,
    for rows sorted by key: every such pair, or the ``most`` closest of two roots, or for 0 what spans the roots."""
    found, held = [], 0
    i = np.arange(len(keys) - 1)
    step = 1
    while True:
        i = i[i + step < len(keys)]
        i = i[keys[i] == keys[i + step]]
        if len(i):
            for at in range(0, len(i), 1 << 14):
                a = i[at : at + (1 << 14)]
                ok = roots[a] != roots[a + step]
                ok[ok] = may_reach(a[ok], a[ok] + step, sizes, places, similarity)
                a = a[ok]
                apart = np.bitwise_count(sketches[a] ^ sketches[a + step]).sum(axis=1, dtype=np.int64)
                ok = apart <= sizes[a].astype(np.int64) + sizes[a + step] - 2 * least_common(sizes[a], sizes[a + step], similarity)
                found.append((apart[ok], a[ok], a[ok] + step))
                held += int(ok.sum())
        if held > 1 << 20 or (held and not len(i)):
            apart, x, y = (np.concatenate(z) for z in zip(*found))
            kept, cut = closest(apart, x, y, roots, most) if most else spanning(apart, x, y, roots)
            yield np.minimum(ids[x[kept]], ids[y[kept]]), np.maximum(ids[x[kept]], ids[y[kept]]), cut
            found, held = [], 0
        if not len(i):
            return
        step += 1


#: Shingle sets that a task takes at least.
SETS_A_TASK = 5_000


def verified(docs: DataFrame, pairs: DataFrame, width: int, similarity: float, doc: str, text: str) -> DataFrame:
    """The pairs (``a``, ``b``) whose shingle sets have the Jaccard similarity, counted exactly."""
    n = pairs.count()
    needed = stored(fitted(pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct(), 2 * n), "needed")
    # A bitmap of bounded size keeps most other texts out of the shuffle; the join decides.
    named = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t"))
    shown = may_hold(named, F.col("d"), needed, "may").where("may").drop("may").join(needed, "d", "left_semi")
    schema = pa.schema([("d", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t"):
            sets = [shingle_set(t, width).view(np.int64) for t in utf8(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    sets = stored(fitted(shown.mapInArrow(run, "d long, s array<long>").dropDuplicates(["d"]), 2 * n, SETS_A_TASK), "sets")
    discard(needed)

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    left, right = (sets.select(F.col("d").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    found = stored(fitted(fitted(pairs.join(left, "a"), n, SETS_A_TASK).join(right, "b").where(alike("sa", "sb")).select("a", "b"), n, SETS_A_TASK), "verified")
    discard(sets)
    return found


def whole_keys(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables of about ``least`` rows or more that no key's rows are shared between."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            keys = batch.column("key").to_numpy()
            start = int(np.searchsorted(keys, keys[-1]))
            if start:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, start)])
                held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def sketched(pairs: DataFrame, words: DataFrame, similarity: float, rows: int) -> DataFrame:
    """The pairs (``a``, ``b``), about ``rows``, of ``words`` (``id``, ``n``, ``sketch``) but for those whose parity sketches show that they are under the similarity."""

    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([(int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() for a, b in zip(x, y)], dtype="int32")

    left, right = (words.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    bound = F.col("na") + F.col("nb") - 2 * F.ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-6)
    # Tasks by the rows at each step: a few links are no tasks of every shuffle partition.
    half = fitted(fitted(pairs, rows, SETS_A_TASK).join(left, "a"), rows, SETS_A_TASK)
    return half.join(right, "b").where(apart("sa", "sb") <= bound).select("a", "b")


def fingerprint_pairs(docs: DataFrame, words: DataFrame, width: int, similarity: float, doc: str = "doc_id", text: str = "text", distance: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (``a``, ``b``), their classes (``id``, ``root``), and the pairs left to check, of rows of ``words`` (``id``, ``fp``,
    ``n``, ``sketch``) whose fingerprints differ in ``distance`` or fewer bits, by the general pigeonhole principle.

    Rows of one fingerprint are tried with the least of them, rows of a crowd with the crowd's; those that
    have the similarity, counted exactly, are the links. All pairs of fingerprints of different classes are left.
    """
    n = words.count()
    held = words.where("n > 0")
    prints = stored(fitted(held.groupBy("fp").agg(F.min("id").alias("id")), n), "fingerprints")
    partitions = plan_partitions(prints, distance)
    same = held.join(prints.select("fp", F.col("id").alias("a")), "fp").where("id <> a").select("a", F.col("id").alias("b"))
    pairs = spanning_links(prints, distance, partitions).union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(docs, stored(fitted(sketched(pairs, words, similarity, n), n), "likely"), width, similarity, doc, text)
    roots = stored(fitted(connected_components(links, "a", "b"), n), "roots")
    spanned = stored(fitted(prints.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), n), "spanned")
    discard(prints)
    return links, roots, close_pairs(spanned, distance, partitions)


#: Rows of a key are dealt over so many parts by their ids.
HUB_BITS = 6
HUBS = 1 << HUB_BITS
#: Pairs of two classes that are tried in a round, 0: only what spans the classes; the last round tries all.
TRIES = (0, 64, 1 << 62)


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ``root``, ``k1``, ``k2``): one row per different word sequence, with the least id of its
    copies and of its class; documents link at Jaccard similarity ``similarity`` of their sets of
    ``width``-word shingles.

    First classes come from SimHash, see :func:`fingerprint_pairs`: fingerprints
    within 4 bits, each link checked exactly. At this similarity others differ in
    too many bits for a guarantee, so links between these classes come from an
    exact join: with shingles in one order, rare ones first, two sets of the
    similarity share one of their first shingles. Rows of different classes that share one are tried with the least row of one of ``HUBS`` parts of them,
    and those with each other, and what passes the exact check makes first
    classes: few links, and short ways between all. Then every pair of rows of different classes
    that share one is tried, but for those whose sizes, places or parity
    sketches show that they can't have the similarity: first what spans the
    classes, so that a group of near copies costs its size, and in the end all.

    Equal word sequences are one row from the start. Texts without words, null
    ones among them, are copies of each other. Null ids are left out.
    """
    named = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t"))
    n = docs.count()
    shared = docs.sparkSession.sparkContext.broadcast(shingle_levels(named.select("t"), width, n))
    doc_type = docs.schema[doc].dataType
    schema = pa.schema([("d", to_arrow_type(doc_type)), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("first", pa.binary()), ("sketch", pa.binary())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t"):
            rows = []
            for t in utf8(batch.column("t")):
                key = xxhash.xxh3_128_digest(b" ".join(t.lower().split()))
                shingles = shingle_set(t, width)
                rows.append((int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), len(shingles), signed(fingerprint(shingles)), prefix(shingles, shared.value, similarity).tobytes(), parity_sketch(shingles)))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("d").cast(schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    every = named.mapInArrow(prints, f"d {doc_type.simpleString()}, k1 long, k2 long, n int, fp long, first binary, sketch binary")
    words = every.groupBy("k1", "k2").agg(F.min(F.col("d").cast("long")).alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("first").alias("first"), F.first("sketch").alias("sketch"))
    words = stored(fitted(words, n, SETS_A_TASK), "words")
    probes = words.agg(F.coalesce(F.sum(F.octet_length("first") / 8), F.lit(0))).first()[0]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                firsts = part.column("first").to_pylist()
                counts = np.fromiter((len(x) // 8 for x in firsts), np.int64, len(firsts))
                places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(firsts), dtype="<i8")), *(pa.array(np.repeat(part.column(c).to_numpy(), counts)) for c in ("id", "n")), pa.array(places, pa.int32())], names=["key", "id", "n", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key others have too, with the id of their part's least row, or for that of the key's, if the two can be similar."""
        for part in whole_keys(batches):
            key, ids, n, place = (part.column(c).to_numpy() for c in ("key", "id", "n", "place"))
            same = np.append(key[1:] == key[:-1], False)
            kept = same | np.append(False, same[:-1])
            key, ids, n, place = (x[kept] for x in (key, ids, n, place))
            bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HUB_BITS)).astype(np.int64)
            order = np.lexsort((ids, bucket, key))
            start = np.ones(len(key), dtype=bool)
            start[1:] = (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
            hub = np.empty(len(key), dtype=np.int64)
            hub[order] = order[np.flatnonzero(start)][np.cumsum(start) - 1]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            top = np.flatnonzero(new)[np.cumsum(new) - 1]
            at = np.arange(len(key))
            other = np.where(hub == at, top, hub)
            fits = (ids[other] != ids) & may_reach(at, other, n, place, similarity)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (key, ids, n, place)), pa.array(ids[other], mask=~fits)], names=["key", "id", "n", "place", "other"])

    rows = words.where("n > 0").select("id", "n", "first").mapInArrow(probe, "key long, id long, n int, place int")
    met = rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(meet, "key long, id long, n int, place int, other long")
    met = stored(fitted(met, int(probes)), "met")
    meetings = met.count()

    def across(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in whole_keys(batches):
                columns = [part.column(c).to_numpy() for c in ("key", "id", "n", "place", "root")]
                sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype="<u8").reshape(len(columns[0]), -1)
                for a, b, cut in pairs_across(*columns, sketches, similarity, most):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                    if cut:
                        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2, names=["a", "b"])

        return run

    links, known, pairs = fingerprint_pairs(docs, words, width, similarity, doc, text)
    chains = met.where("other IS NOT NULL").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).where("a <> b")
    ra, rb = (known.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    chains = chains.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    likely = stored(fitted(sketched(chains.union(pairs).distinct(), words, similarity, meetings), meetings), "likely")
    links = links.union(verified(docs, likely, width, similarity, doc, text))
    roots = stored(fitted(connected_components(links, "a", "b"), n), "roots")
    for most in TRIES:
        now = met.select("key", "id", "n", "place").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        now = stored(fitted(now, meetings), "now")
        mixed = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        left = now.join(mixed, "key", "left_semi").join(words.select("id", "sketch"), "id")
        tried = left.repartition("key").sortWithinPartitions("key", "id").mapInArrow(across(most), "a long, b long").distinct()
        tried = stored(fitted(tried, meetings), "tried")
        discard(now)
        pairs, cut = tried.where("a IS NOT NULL"), not tried.where("a IS NULL").isEmpty()
        if not pairs.isEmpty():
            # The classes so far stand for their links.
            before = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
            every_link = before.union(verified(docs, pairs, width, similarity, doc, text))
            roots = stored(fitted(connected_components(every_link, "a", "b"), n), "roots")
        discard(tried)
        if not cut:
            break
    return words.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "k1", "k2")


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class of near duplicates; columns as they were.

    See :func:`similar_classes`. Rows with a null id stay; rows with one id stay or go
    together. Ids of a type that is no integer are numbered in their order first.
    """
    if not isinstance(docs.schema[doc].dataType, IntegralType):
        ids = docs.where(F.col(f"`{doc}`").isNotNull()).select(F.col(f"`{doc}`").alias("_id")).distinct().orderBy("_id")
        ids = stored(ids.withColumn("_n", F.monotonically_increasing_id()), "ids")
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{doc}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
        kept = keep_one_of_each(rows.join(ids, "_id", "left").select("_row", "_n", "_text"), width, similarity, "_n", "_text", **options)
        return kept.select("_row.*")
    classes = similar_classes(docs, width, similarity, doc=doc, text=text, **options)
    n = docs.count()
    classes = stored(fitted(classes, n), "classes")
    every = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("d"))
    # What goes: ids that are no least id of copies, and least ids that are no root
    gone = stored(fitted(every.join(classes.where(F.col("id") == F.col("root")).select(F.col("id").alias("d")), "d", "left_anti").distinct(), n), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).cast("long").alias("d"))
    marked = may_hold(rows, F.col("d"), gone, "may")
    judged = marked.where("may").join(gone, "d", "left_anti")
    return marked.where("NOT may").select("row.*").unionByName(fitted(judged.select("row.*"), gone.count(), SETS_A_TASK))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: fingerprint and class of every document of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fingerprint_classes(docs, 4, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root").alias("component_id"))
