"""SentencePiece BPE with seeded merge-dropout, many words at a time, and lossless decoding.

Words (a blank and what follows it) never share a piece, so they are encoded
apart. An agenda step takes from every word of a batch at once its best-scored
adjacent pair, the leftmost of equals, as the library's agenda does; each
candidate merge of each occurrence of a word is skipped for good with the
dropout rate. What is skipped follows from the seed, the document's id, the
word's number in the text and the candidate's place in the word, so that a run
can be repeated anywhere. Only what no skip touches is encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_bytes, utf8

SPACE = "▁"
#: A word starts at each blank that follows something else than a blank.
STARTS = re.compile("(?<=[^ ]) ")
#: Stands for a U+2581 of the text itself; a lone surrogate, so no text has it.
OWN = "\ud800"
NEVER = np.int32(2**31 - 1)


class Pieces:
    """The vocabulary of a SentencePiece BPE model as arrays."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.id_of = {self.text[i]: i for i in normal}
        self.of_point = np.full(0x110000, -1, dtype=np.int32)
        for i in normal:
            if len(self.text[i]) == 1:
                self.of_point[ord(self.text[i])] = i
        byte_pieces = [i for i in range(size) if sp.is_byte(i)]
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i in byte_pieces:
            self.byte_id[int(self.text[i][3:5], 16)] = i
        self.size = size
        # Bytes that a piece stands for, blanks already turned back.
        self.raw = [b""] * size
        for i in normal:
            self.raw[i] = self.text[i].replace(SPACE, " ").encode()
        for i in byte_pieces:
            self.raw[i] = bytes([int(self.text[i][3:5], 16)])
        lengths = np.fromiter(map(len, self.raw), dtype=np.int64, count=size)
        self.raw_bytes, self.raw_at, self.raw_length = np.frombuffer(b"".join(self.raw), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths
        # Merges: pairs of symbols whose concatenation is a piece, by their code; lower rank is better.
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        rank, last = {}, None
        for i in order:
            if last is None or sp.get_score(i) != last:
                step = len(rank)
            rank[i], last = step, sp.get_score(i)
        # Pieces outside the vocabulary that merges pass through don't exist in BPE: both parts are pieces.
        self.rank = np.full(size, NEVER, dtype=np.int32)
        self.rank[list(rank)] = list(rank.values())
        codes, made = [], []
        for i in normal:
            t = self.text[i]
            for k in range(1, len(t)):
                a, b = self.id_of.get(t[:k]), self.id_of.get(t[k:])
                if a is not None and b is not None:
                    codes.append(a * size + b)
                    made.append(i)
        self.kind = np.uint32 if size * size < 1 << 32 else np.uint64
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 4))))
        self.table = np.full(1 << self.bits, self.kind(0xFFFFFFFFFFFFFFFF >> (64 - 8 * np.dtype(self.kind).itemsize)))
        self.made = np.full(1 << self.bits, -1, dtype=np.int32)
        for code, piece, slot in zip(codes, made, self.slots(np.array(codes, dtype=self.kind)).tolist()):
            while self.made[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.table[slot], self.made[slot] = code, piece

    def slots(self, codes: np.ndarray) -> np.ndarray:
        width = 8 * codes.itemsize
        return (codes * self.kind(0x9E3779B97F4A7C15 >> (64 - width) | 1)) >> self.kind(width - self.bits)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece made, rank) of each pair of symbols; rank ``NEVER`` if they don't merge. Negative symbols never do."""
        code = left.astype(self.kind) * self.kind(self.size) + right.astype(self.kind)
        slot = self.slots(code)
        found = self.table[slot] == code
        made = self.made[slot]
        open_ = np.flatnonzero(~found & (made >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + self.kind(1)) & self.kind((1 << self.bits) - 1)
            made[open_] = self.made[slot[open_]]
            found[open_] = self.table[slot[open_]] == code[open_]
            open_ = open_[~found[open_] & (made[open_] >= 0)]
        found &= (left >= 0) & (right >= 0) & (made >= 0)
        return made, np.where(found, self.rank[made], NEVER)


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(1, dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
    return h


def merge_code(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A candidate merge within its word: the places where its parts start and where it ends."""
    code = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return code * np.uint64(0x9E3779B97F4A7C15)


def draw(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A number for each candidate merge of each occurrence of a word: the finalizer of a hash over both."""
    h = keys ^ codes
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spread(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places offset, offset + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - lengths), lengths)


class Pool:
    """Stretches of numbers, appended many at a time."""

    def __init__(self, kind: str) -> None:
        self.data, self.used = np.zeros(1 << 12, dtype=kind), 0
        self.offsets, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            grown = np.zeros(2 * need, dtype=self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used : need] = values
        self.offsets = np.concatenate([self.offsets, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = need


class Numbers(dict):
    """Numbers words 0, 1, 2, ... as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts to piece ids with merge-dropout of rate ``dropout``, keyed by ``seed``.

    The agenda of a word without any skip is worked off once, and remembered with
    the merges it takes, for up to ``cached`` words. An occurrence that draws no
    skip for any of them has its pieces; for every other one the agenda runs
    anew, with its own draws.
    """

    def __init__(self, pieces: Pieces, dropout: float, seed: int, cached: int = 200_000, longest: int = 200) -> None:
        self.pieces, self.dropout, self.seed, self.cached, self.longest = pieces, dropout, seed, cached, longest
        self.limit = np.uint64(min(2**64 - 1, int(dropout * 2**64)))
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.points, self.pairs, self.plain, self.merges = Pool("u4"), Pool("i4"), Pool("i4"), Pool("u8")

    def in_bytes(self, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each became), with the negative ones, characters that are no piece, as their bytes."""
        odd = ids < 0
        p = points[odd].astype(np.int64)
        p[p == ord(OWN)] = ord(SPACE)
        n = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        k = np.arange(4)
        # Byte k of n: the first has the length's mark and the top bits, the others six bits each.
        raw = 0x80 | (p[:, None] >> np.maximum(6 * (n[:, None] - 1 - k), 0)) & 0x3F
        raw[:, 0] = np.where(n == 1, p, np.array([0, 0, 0xC0, 0xE0, 0xF0])[n] | p >> 6 * (n - 1))
        became = np.ones(len(ids), dtype=np.int64)
        became[odd] = n
        out = np.repeat(ids, became)
        out[np.repeat(odd, became)] = self.pieces.byte_id[raw[k < n[:, None]]]
        return out, became

    def agenda(self, symbols: np.ndarray, pairs: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Work off the agendas of words of one width (symbols, and the ranks of pairs: a column a word), all of them at once.

        A step takes from every word its best candidate, the leftmost of equals,
        and merges it, or skips it for good if the word's key draws so. ``keys``
        None skips nothing. Returns the symbols, which of them are left, and the
        merges taken (their codes, and how many each word has), where nothing is skipped.
        """
        width, n = symbols.shape
        flat = symbols.ravel()
        alive = np.ones((width + 1, n), dtype=bool)
        after = np.repeat(np.arange(1, width + 2, dtype=np.int32), n)
        before = np.repeat(np.arange(-1, width, dtype=np.int32), n)
        place = np.arange(width, dtype=np.int32)[:, None]
        order = np.where(pairs == NEVER, NEVER, pairs * 256 + place)
        order[-1] = NEVER
        ranks = order.ravel()
        words = np.arange(n)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            best = order.min(axis=0)[words]
            going = best != NEVER
            if not going.all():
                words, best = words[going], best[going]
                if not len(words):
                    break
            at = best & 255
            left = at * n + words
            middle = after[left]
            right = middle * n + words
            end = after[right]
            codes = merge_code(at, middle, end)
            own = words
            if keys is None:
                taken.append((words, codes))
            else:
                skip = draw(keys[words], codes) < self.limit
                if skip.any():
                    ranks[left[skip]] = NEVER
                    kept = ~skip
                    own, at, left, right, end = words[kept], at[kept], left[kept], right[kept], end[kept]
            flat[left], _ = self.pieces.look_up(flat[left], flat[right])
            alive.ravel()[right] = False
            ranks[right] = NEVER
            after[left] = end
            behind = end * n + own
            before[behind] = at
            first = before[left]
            both = np.concatenate([at, first])
            who = np.concatenate([own, own])
            follows = np.concatenate([end, at])
            ok = (both >= 0) & (follows < width)
            ranks[left] = NEVER
            both, who, follows = both[ok], who[ok], follows[ok]
            where = both * n + who
            _, rank = self.pieces.look_up(flat[where], flat[follows * n + who])
            ranks[where] = np.where(rank == NEVER, NEVER, rank * 256 + both)
        who = np.concatenate([x[0] for x in taken]) if taken else np.zeros(0, dtype=np.int64)
        codes = np.concatenate([x[1] for x in taken]) if taken else np.zeros(0, dtype=np.uint64)
        return symbols, alive[:width], (codes[np.argsort(who, kind="stable")], np.bincount(who, minlength=n))

    def encode_words(self, words: np.ndarray, keys: np.ndarray | None) -> tuple[Pool, Pool]:
        """(piece ids, merges taken) of each of these words, in order, by its key."""
        lengths, offsets = self.points.lengths[words], self.points.offsets[words]
        ids, merges, order = Pool("i4"), Pool("u8"), []
        for width in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == width)
            most = max(1, (1 << 17) // width) if width <= self.longest else 1
            for start in range(0, len(every), most):
                some = every[start : start + most]
                order.append(some)
                places = offsets[some][None, :] + np.arange(width)[:, None]
                points = self.points.data[places]
                own, drawn = self.pieces.of_point[points], None if keys is None else keys[some]
                if width > self.longest:
                    found, at, codes = self.encode_long(own.ravel().tolist(), drawn)
                    points, counts, taken = points.ravel()[at], np.array([len(at)]), np.array([len(codes)])
                else:
                    final, alive, (codes, taken) = self.agenda(own, self.pairs.data[places], drawn)
                    left = np.ascontiguousarray(alive.T)
                    found, counts, points = final.T[left], left.sum(axis=1), points.T[left]
                merges.add(codes, taken)
                if (found < 0).any():
                    found, became = self.in_bytes(found, points)
                    counts = np.add.reduceat(became, np.cumsum(counts) - counts)
                ids.add(found, counts)
        at = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        back = np.argsort(at, kind="stable")
        for pool in (ids, merges):
            pool.offsets, pool.lengths = pool.offsets[back], pool.lengths[back]
        return ids, merges

    def encode_long(self, raw: list[int], key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same agenda as a heap, for a word of very many characters: symbols, their places, and the merges taken."""
        import heapq

        n = len(raw)
        symbol, after, before = list(raw), [*range(1, n), -1], list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int, int]] = []
        taken: list[int] = []

        def offer(lefts: list[int]) -> None:
            lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
            if lefts:
                a = np.array([symbol[i] for i in lefts], dtype=np.int64)
                b = np.array([symbol[after[i]] for i in lefts], dtype=np.int64)
                made, rank = self.pieces.look_up(a, b)
                middle = [after[i] for i in lefts]
                codes = merge_code(np.array(lefts), np.array(middle), np.array([after[j] if after[j] >= 0 else n for j in middle]))
                if key is not None:
                    rank[draw(key, codes) < self.limit] = NEVER
                for i, x, y, m, r, c in zip(lefts, a.tolist(), b.tolist(), made.tolist(), rank.tolist(), codes.tolist()):
                    if r != NEVER:
                        heapq.heappush(agenda, (r, i, x, y, m, c))

        offer(list(range(n)))
        while agenda:
            _, i, a, b, made, code = heapq.heappop(agenda)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            taken.append(code)
            symbol[i], symbol[j] = made, -3
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer([before[i], i])
        at = [i for i in range(n) if symbol[i] != -3]
        return np.array([symbol[i] for i in at], dtype=np.int32), np.array(at, dtype=np.int64), np.array(taken if key is None else [], dtype=np.uint64)

    def words(self, text: str) -> list[str]:
        """Words with their blank in front as U+2581. U+2581 of the text itself becomes a character
        that no piece has, so that it is written in bytes and comes back."""
        text = text.replace(SPACE, OWN)
        if "  " not in text and text[:1] != " ":
            return text.split(" ")
        return [w.replace(" ", SPACE) for w in STARTS.split(text)]

    def learn(self) -> None:
        """Work out the pieces and merges of new words without any skip."""
        first = len(self.points.lengths)
        new = list(islice(self.number, first, None))
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) + 1
        points = np.frombuffer((SPACE + SPACE.join(new) if new else "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.pieces.of_point[points]
        _, ranks = self.pieces.look_up(symbols[:-1], symbols[1:])
        self.points.add(points, lengths)
        self.pairs.add(np.append(ranks, [NEVER] * min(1, len(new))), lengths)
        ids, merges = self.encode_words(np.arange(first, first + len(new)), None)
        self.plain.add(ids.data[spread(ids.offsets, ids.lengths)], ids.lengths)
        self.merges.add(merges.data[spread(merges.offsets, merges.lengths)], merges.lengths)

    def skipping(self, at: np.ndarray, keys: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Whether occurrences of words draw a skip for one or more of the merges that the words take."""
        out = np.zeros(len(at), dtype=bool)
        if self.dropout > 0:
            for start in range(0, len(at), most):
                own = at[start : start + most]
                lengths = self.merges.lengths[own]
                codes = self.merges.data[spread(self.merges.offsets[own], lengths)]
                skip = draw(np.repeat(keys[start : start + most], lengths), codes) < self.limit
                out[start + np.repeat(np.arange(len(own)), lengths)[skip]] = True
        return out

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; what is skipped follows from its key and each word's number."""
        split = [self.words(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        every = [w for words in split for w in words]
        if len(self.number) > self.cached or self.points.used > 16 * self.cached:
            self.forget()
        at = np.fromiter(map(self.number.__getitem__, every), dtype=np.int64, count=len(every))
        self.learn()
        own = np.fromiter((xxhash.xxh64_intdigest(k.encode(), self.seed) for k in keys), dtype=np.uint64, count=len(keys))
        drawn = mixed(np.repeat(own, counts), np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts))
        anew = self.skipping(at, drawn)
        chosen = np.flatnonzero(anew)
        cut, _ = self.encode_words(at[chosen], drawn[chosen])
        offsets, lengths = self.plain.offsets[at], self.plain.lengths[at]
        offsets[chosen], lengths[chosen] = cut.offsets, cut.lengths
        places, from_cut = spread(offsets, lengths), np.repeat(anew, lengths)
        ids = np.empty(len(places), dtype="<i4")
        ids[from_cut], ids[~from_cut] = cut.data[places[from_cut]], self.plain.data[places[~from_cut]]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the blank put before the text."""
        p = self.pieces
        return p.raw_bytes[spread(p.raw_at[ids], p.raw_length[ids])].tobytes()[1:]


def encode_documents(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, doc: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(``doc``, ``ids``, ``n_pieces``, ``ids_crc32``, ``lossless``) for every row of ``docs``.

    ``lossless`` tells that decoding ``ids`` gives the whole text's bytes again.
    ``ids_crc32`` is over the ids as little-endian 32-bit words. ``model`` is the
    path of a SentencePiece BPE model with byte pieces that every executor has.
    With ``dropout`` 0 the ids are the library's, but for U+2581 in a text, which
    is kept apart from the blank. A null or empty text has no ids and is
    lossless. Skips are drawn anew for each word of each document; rows of one id
    and text get equal ids, and a null id is one of its own kind. Other columns
    are not returned.
    """
    doc_type = docs.schema[doc].dataType
    fields = [(doc, to_arrow_type(doc_type)), *([("ids", pa.list_(pa.int32()))] if with_ids else []), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encoder = Encoder(Pieces(model), dropout, seed)
        for batch in by_bytes(batches, "t", 2 << 20):
            raw = utf8(batch.column("t"))
            keys = ["" if d is None else str(d) for d in batch.column("d").to_pylist()]
            ids = encoder.encode([x.decode() for x in raw], keys)
            columns = [batch.column("d").cast(schema.field(0).type)]
            if with_ids:
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
            columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()), pa.array([encoder.decode(x) == r for x, r in zip(ids, raw)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ids = "ids array<int>, " if with_ids else ""
    return docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"`{doc}` {doc_type.simpleString()}, {ids}n_pieces long, ids_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(``doc``, ``text``) from piece ids; null ids give a null text."""
    doc_type = encoded.schema[doc].dataType
    schema = pa.schema([(doc, to_arrow_type(doc_type)), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = Pieces(model).raw
        for batch in batches:
            texts = [None if x is None else b"".join(map(raw.__getitem__, x))[1:].decode() for x in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d").cast(schema.field(0).type), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col(doc).alias("d"), F.col(ids).alias("i")).mapInArrow(run, f"`{doc}` {doc_type.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document of ``documents`` encoded with merge-dropout 0.1 and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, seed=2024)
