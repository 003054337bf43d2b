"""Exact removal of long repeated byte strings, by a hash-compared suffix sort of the places where texts can agree.

Every window of ``length`` bytes has an anchor: of the grams in it the one of
least hash, the leftmost of equals. Equal windows have equal anchors at equal
places, so only windows of one anchor need comparing. Neighbouring windows with
one anchor make a context. Contexts of equal hashes are one class, of which the
first and the last are compared byte by byte: if equal, the whole class repeats.
Of the different contexts of an anchor, the suffixes that start at one distance
from the anchor are merge-sorted: prefix polynomial hashes and binary search
give the common extension of two suffixes in logarithmic time, suffixes that
share ``length`` bytes end up side by side, and their bytes are compared too.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import discard, stored
from .common import by_bytes, fitted, may_hold, small_batches, utf8

PRIME = np.uint64(2**31 - 1)
BASES = (np.uint64(1_000_003), np.uint64(69_069_069))
SPANS = "array<struct<s:int,e:int>>"


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo PRIME, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * step % PRIME])
        step = step * step % PRIME
    return out[:n]


def prefix_hashes(data: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums of data[j] * power[j] over j < i, modulo PRIME, for i = 0 .. len(data)."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)] % PRIME, out=out[1:])
    return out % PRIME


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int, power: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each run of windows with one anchor; pieces of ``data`` end at ``ends``."""
    n, width = len(data), length - gram + 1
    sums = prefix_hashes(data, power)
    h = (sums[gram:] + PRIME - sums[: n - gram + 1]) % PRIME * power[len(power) - 1 - np.arange(n - gram + 1)] % PRIME
    h = (h * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)
    chosen = sliding_least(h | np.arange(len(h), dtype=np.uint64), width) & np.uint64(0xFFFFFFFF)
    inside = np.zeros(n - length + 2, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    fits = ends - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    piece_start = np.zeros(len(inside), dtype=bool)
    piece_start[starts[fits]] = True
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1]) | piece_start[1:]
    first = np.flatnonzero(new)
    last_of = inside.copy()
    last_of[:-1] &= ~inside[1:] | new[1:]
    return first, np.flatnonzero(last_of), chosen[first].astype(np.int64)


def document_anchors(texts: list[bytes], length: int, gram: int, most: int = 1 << 20) -> Iterator[tuple[int, int, int, int, int, list[int]]]:
    """(text, anchor hash, context hash, anchor's place in the context, context length, contexts' starts)."""
    power = powers(BASES[0], most + 2 * length + 1)
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def run() -> Iterator[tuple[int, int, int, int, int, list[int]]]:
        whole = b"".join(x[2] for x in held)
        ends = np.cumsum([len(x[2]) for x in held])
        first, last, place = anchors(np.frombuffer(whole, dtype=np.uint8), ends, length, gram, power)
        piece = np.searchsorted(ends, first, side="right")
        found: dict[tuple[int, int, int, int, int], list[int]] = {}
        for p, s, e, o in zip(piece.tolist(), first.tolist(), (last + length).tolist(), place.tolist()):
            a = xxhash.xxh64_intdigest(whole[o : o + gram]) - (1 << 63)
            c = xxhash.xxh64_intdigest(whole[s:e], o - s) - (1 << 63)
            base = int(ends[p]) - len(held[p][2])
            found.setdefault((held[p][0], a, c, o - s, e - s), []).append(s - base + held[p][1])
        for key, starts in found.items():
            yield *key, starts

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), most):
            piece = text[at : at + most + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > most + length:
                yield from run()
                held.clear()
                size = 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield from run()
        held.clear()


class Suffixes:
    """Suffixes of one buffer, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        self.power = [powers(b, len(data) + 1) for b in BASES]
        self.sums = [prefix_hashes(data, p) for p in self.power]

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n bytes from x and from y have equal hashes."""
        top = len(self.data)
        out = np.ones(len(x), dtype=bool)
        for power, sums in zip(self.power, self.sums):
            hx = (sums[x + n] + PRIME - sums[x]) % PRIME * power[top - x] % PRIME
            hy = (sums[y + n] + PRIME - sums[y]) % PRIME * power[top - y] % PRIME
            out &= hx == hy
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes x and y have in common, ``length`` at most, by binary search."""
        low = np.zeros(len(x), dtype=np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            further = np.minimum(low + step, self.length)
            low = np.where(self.same(x, y, further), further, low)
            step >>= 1
        return low

    def below(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y, or equally where that is asked for."""
        n = self.common(x, y)
        equal = n >= self.length
        at = np.minimum(n, self.length - 1)
        return np.where(equal, or_equal, self.data[x + at] < self.data[y + at])

    def sort(self, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Merge-sort ``places`` within each bucket (equal ones stand together); all merges of a round run at once."""
        n = len(places)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        place = np.arange(n) - start
        width = 1
        while width < sizes.max(initial=0):
            active = np.flatnonzero(size > width)
            q = place[active]
            block = q // (2 * width) * (2 * width)
            right = q - block >= width
            low = start[active] + np.where(right, block, np.minimum(block + width, size[active]))
            high = start[active] + np.where(right, block + width, np.minimum(block + 2 * width, size[active]))
            first = low.copy()
            x = places[active]
            while True:  # how many of the other run stand before x
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                before = self.below(places[middle], x[open_], right[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = start[active] + block + (q - block - np.where(right, width, 0)) + (low - first)
            out = places.copy()
            out[target] = x
            places = out
            width *= 2
        return places


def repeated_windows(contexts: list[bytes], group: np.ndarray, place: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the starts of its windows that another context of its group has at the same distance from the anchor."""
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    base = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    bucket = group[owner] * (1 << 20) + (place[owner] - start)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = bucket[1:] == bucket[:-1]
    several = np.concatenate([edge, [False]]) | np.concatenate([[False], edge])
    order, bucket = order[several], bucket[several]
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(contexts)
    if not len(order):
        return found
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    suffixes = Suffixes(data, length)
    places = suffixes.sort(base[owner[order]] + start[order], bucket)
    owner = np.searchsorted(base, places, side="right") - 1
    start = places - base[owner]
    pair = np.flatnonzero(bucket[1:] == bucket[:-1])
    pair = pair[suffixes.same(places[pair], places[pair + 1], np.full(len(pair), length))]
    # Collision check: bytes of the first window of a chain of pairs as a whole, of the next ones their last byte.
    i, j, s = owner[pair], owner[pair + 1], start[pair]
    chain = np.lexsort((s, j, i))
    i, j, s, pair = i[chain], j[chain], s[chain], pair[chain]
    head = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (s[1:] != s[:-1] + 1)])[: len(pair)]
    x, y = places[pair], places[pair + 1]
    ok = data[x + length - 1] == data[y + length - 1]
    heads = np.flatnonzero(head)
    for at in range(0, len(heads), 4096):
        some = heads[at : at + 4096]
        ok[some] = (data[x[some][:, None] + np.arange(length)] == data[y[some][:, None] + np.arange(length)]).all(axis=1)
    if not ok.all():  # a pair counts only if its whole chain up to it is confirmed
        bad = np.cumsum(~ok)
        ok &= bad == np.repeat(np.concatenate([[0], bad])[heads], np.diff(np.concatenate([heads, [len(pair)]])))
    good = np.zeros(len(places), dtype=bool)
    good[pair[ok]] = good[pair[ok] + 1] = True
    owner, start = owner[good], start[good]
    by_owner = np.lexsort((start, owner))
    owner, start = owner[by_owner], start[by_owner]
    cuts = np.searchsorted(owner, np.arange(len(contexts) + 1))
    return [start[cuts[k] : cuts[k + 1]] for k in range(len(contexts))]


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows at sorted ``starts`` as maximal runs of bytes (start, end)."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.concatenate([gap, [len(starts) - 1]])] + length).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def compare_contexts(rows: DataFrame, length: int) -> DataFrame:
    """(``a``, ``c``, ``spans``) from rows (``g``, ``a``, ``c``, ``place``, ``bytes``): what contexts of one group ``g`` share.

    Two rows of one class ``c`` whose bytes are equal repeat as a whole. What
    differs within a group is sorted, in its task, by its suffixes.
    """
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decide(found: list[tuple]) -> pa.RecordBatch:
            shown: dict[tuple[int, int, int], tuple] = {}
            hits, apart = [], []
            for r in found:
                first = shown.setdefault(r[:3], r)
                if first is r:
                    apart.append(r)
                elif first[4] == r[4]:
                    hits.append((r[1], r[2], [{"s": 0, "e": len(r[4])}]))
                else:  # one hash for different bytes: they are no copies
                    apart.append(r)
            several = Counter(r[0] for r in apart)
            apart = [r for r in apart if several[r[0]] > 1]
            if apart:
                group = np.unique(np.array([r[0] for r in apart]), return_inverse=True)[1]
                starts = repeated_windows([r[4] for r in apart], group, np.array([r[3] for r in apart]), length)
                hits += [(r[1], r[2], [{"s": x, "e": y} for x, y in spans_of(s, length)]) for r, s in zip(apart, starts) if len(s)]
            columns = list(zip(*hits)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("g", "a", "c", "place", "bytes"))):
                if held and size > 1 << 19 and held[-1][0] != row[0]:
                    yield decide(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield decide(held)

    together = rows.select("g", "a", "c", "place", "bytes").repartition("g").sortWithinPartitions("g")
    return together.mapInArrow(compare, f"a long, c long, spans {SPANS}")


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, doc: str = "doc_id", text: str = "text", largest_group: int = 1000, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Every byte that lies in a string of ``length`` bytes which also starts
    anywhere else, in the same text or another, is removed; strings are judged
    on the input, overlaps count, and none crosses texts. ``with_text`` adds
    ``kept``: the bytes left. ``n_spans`` counts maximal removed runs.

    A null text is empty. Texts shorter than ``length`` stay whole. Repeated
    rows repeat each other; null and repeated ids are fine. Other columns are
    not returned. The windows of an anchor with more than ``largest_group``
    different contexts are dealt out by their hashes, and of those found twice
    the first and the last are sorted and compared like contexts, so that no
    group is larger than that.
    """
    source = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("k", F.xxhash64("t"))
    id_type = docs.schema[doc].dataType
    d_sql, d_arrow = id_type.simpleString(), to_arrow_type(id_type)
    found_schema = pa.schema([("d", d_arrow), ("k", pa.int64()), ("a", pa.int64()), ("c", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("starts", pa.list_(pa.int32()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", 2 << 20):
            ids, keys = batch.column("d").to_pylist(), batch.column("k").to_pylist()
            rows = list(document_anchors(utf8(batch.column("t")), length, gram))
            columns = [[ids[r[0]] for r in rows], [keys[r[0]] for r in rows], *([r[x] for r in rows] for x in range(1, 6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found_schema)], schema=found_schema)

    long_enough = source.where(F.octet_length("t") >= length)
    found = stored(long_enough.mapInArrow(find, f"d {d_sql}, k long, a long, c long, place int, size int, starts array<int>"), "anchors")
    n = found.count()
    shown_by = F.struct("k", F.col("starts")[0].alias("start"), "d", "size", "place")
    last_by = F.struct("k", F.element_at("starts", -1).alias("start"), "d", "size", "place")
    classes = stored(fitted(found.groupBy("a", "c").agg(F.sum(F.size("starts")).alias("n"), F.min(shown_by).alias("one"), F.max(last_by).alias("other")), n), "classes")
    groups = classes.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # The first context of each class whose anchor has others too; first and last of those that occur twice
    counted = classes.join(groups, "a", "left").where("m > 1 OR n > 1").withColumn("m", F.coalesce("m", F.lit(1)))
    shown = F.when(F.col("n") > 1, F.array("one", "other")).otherwise(F.array("one"))
    wanted = counted.select("a", "c", "n", "m", F.posexplode(shown).alias("which", "x")).select("a", "c", "n", "m", "which", "x.*")
    wanted = stored(fitted(wanted, n), "wanted")
    by_text = wanted.groupBy("d", "k").agg(F.collect_list(F.struct("a", "c", "n", "m", "which", "start", "size", "place")).alias("w"))
    same_text = F.col("x.k").eqNullSafe(F.col("y.k")) & F.col("x.d").eqNullSafe(F.col("y.d"))
    name = F.xxhash64("d", "k")
    # A bitmap of bounded size keeps most other texts out of the shuffle; the join decides.
    shows = may_hold(source, name, wanted.select(name.alias("d")).distinct(), "may").where("may")
    lists = shows.alias("x").join(by_text.alias("y"), same_text).select("x.t", "y.w")
    cut_schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("which", pa.int32()), ("place", pa.int32()), ("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", 1 << 20):
            rows = [(w["a"], w["c"], w["n"], w["m"], w["which"], w["place"], t[w["start"] : w["start"] + w["size"]]) for t, ws in zip(utf8(batch.column("t")), batch.column("w").to_pylist()) for w in ws]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, cut_schema)], schema=cut_schema)

    # Equal rows of one id show a context each: one is enough.
    cuts = lists.mapInArrow(cut, "a long, c long, n long, m long, which int, place int, bytes binary").dropDuplicates(["a", "c", "which"])
    contexts = stored(fitted(cuts, 20 * n), "contexts")
    discard(wanted)
    large = F.col("m") > largest_group
    few = contexts.where(~large | (F.col("n") > 1)).withColumn("g", F.when(large, F.xxhash64("a", "c")).otherwise(F.col("a")))
    compared = compare_contexts(few, length)

    window_schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("s", pa.int32()), ("h", pa.binary())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows = [(a, c, s, xxhash.xxh3_128_digest(raw[s : s + length], place - s)) for a, c, place, raw in zip(*(part.column(x).to_pylist() for x in ("a", "c", "place", "bytes"))) for s in range(len(raw) - length + 1)]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, window_schema)], schema=window_schema)

    parts = [compared]
    crowded = contexts.where(large & (F.col("which") == 0))
    if not crowded.isEmpty():
        hot = stored(crowded.select("a", "c", "place", "bytes").mapInArrow(windows, "a long, c long, s int, h binary"), "windows")
        place = F.struct("a", "c", "s")
        twice = stored(hot.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.max(place).alias("other")).where("n > 1"), "twice")
        # Of each window found twice the first and the last as contexts of a group of their own
        ends = twice.select(F.xxhash64("h").alias("g"), F.posexplode(F.array("one", "other")).alias("which", "x")).select("g", "which", "x.*")
        own = crowded.drop("which").join(ends, ["a", "c"]).select("g", F.col("g").alias("a"), F.col("which").cast("long").alias("c"), F.lit(0).alias("place"), F.substring("bytes", F.col("s") + 1, F.lit(length)).alias("bytes"))
        confirmed = compare_contexts(own, length).select(F.col("a").alias("g")).distinct()
        shared = hot.withColumn("g", F.xxhash64("h")).join(confirmed, "g").groupBy("a", "c").agg(F.sort_array(F.collect_list("s")).alias("w"))
        parts.append(shared.select("a", "c", F.transform("w", lambda s: F.struct(s.alias("s"), (s + length).alias("e"))).alias("spans")))

    spans = stored(fitted(reduce(DataFrame.unionByName, parts), n), "spans")
    discard(contexts)
    placed = found.join(spans, ["a", "c"]).groupBy("d", "k").agg(F.collect_set(F.struct("starts", "spans")).alias("r"))
    placed = stored(fitted(placed, n), "placed")
    marked = may_hold(source, name, placed.select(name.alias("d")), "may")
    joined = marked.where("may").alias("x").join(placed.alias("y"), same_text, "left").select("x.d", "x.t", "y.r")
    last = joined.unionByName(marked.where("NOT may").select("d", "t", F.lit(None).cast(placed.schema["r"].dataType).alias("r")))
    fields = [(doc, d_arrow), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])]
    out_schema = pa.schema(fields)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", 2 << 20):
            rows = []
            for t, r in zip(utf8(batch.column("t")), batch.column("r").to_pylist()):
                gone = merged([(x + q["s"], x + q["e"]) for p in r or () for q in p["spans"] for x in p["starts"]])
                kept, at = [], 0
                for s, e in gone:
                    kept.append(t[at:s])
                    at = e
                kept.append(t[at:])
                left = b"".join(kept)
                rows.append((len(t), len(t) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            columns = list(zip(*rows)) or [[]] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("d").cast(d_arrow), *(pa.array(c, f.type) for c, f in zip(columns, list(out_schema)[1:]))], schema=out_schema)

    kept_sql = ", kept binary" if with_text else ""
    return last.mapInArrow(remove, f"`{doc}` {d_sql}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept_sql}")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: repeated 400-byte strings removed from every text of ``documents``."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs)
