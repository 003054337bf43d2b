"""Byte-level BPE by backtracking, and decoding through an offset table.

An Aho-Corasick automaton of all tokens gives the longest token that starts at
each byte. The encoder takes that token if it is compatible with the one before
it; else the next shorter one that starts there, and with none left it gives up
the token before. Two tokens are compatible if merging their bytes alone leaves
the border between them; a sequence of compatible neighbours is what the merges
make. A place that was given up is never reached again, so that the work is
linear in the text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches
from .merge_dropout import Numbers, Pool, spread

#: How byte-level pre-tokenizers cut a text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank before something else than white space always starts a new piece.
CUT = re.compile(r" (?=\S)")
NOT_CUT = re.compile(r" (?:\s|\Z)")
#: One character of each class that stands in where the library's Unicode tables differ from ``regex``'s.
STAND_INS = {"letter": "é", "number": "²", "space": " ", "other": "§"}
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file of the ``tokenizers`` library.

    Raises ValueError for files of another kind: a normaliser, a pre-tokenizer
    that is not the plain byte-level one, options of the model that change the
    merges, added tokens that take white space with them, or merges that are not
    in the order in which their tokens can be made.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
        if model["type"] != "BPE" or told["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or any(odd):
            raise ValueError(f"{path} is not plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options")
        byte = {c: i for i, c in enumerate(byte_letters())}
        self.ids = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items()}
        self.pairs: dict[tuple[int, int], int] = {}  # rank of a merge
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a merged token: left, right, rank
        rank_of: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (bytes(map(byte.__getitem__, x)) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            if max(rank_of.get(left, -1), rank_of.get(right, -1)) >= rank:
                raise ValueError(f"{path}: merge {rank} takes a token that is made later")
            self.pairs[left, right] = rank
            if made not in self.parts:
                self.parts[made] = (left, right, rank)
                rank_of[made] = rank
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        every = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        n = max(every) + 1
        lengths = np.array([len(every.get(i, b"")) for i in range(n)], dtype=np.int64)
        #: The offset table: token i is ``raw[at[i]:at[i + 1]]``.
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.raw = np.frombuffer(b"".join(every.get(i, b"") for i in range(n)), dtype=np.uint8)

    def token(self, i: int) -> bytes:
        return self.raw[self.at[i] : self.at[i + 1]].tobytes()

    def decode(self, ids: np.ndarray, most: int = 1 << 20) -> str:
        """The text of ids; ids that the vocabulary has not got stand for nothing, bytes that are no UTF-8 become U+FFFD."""
        out = []
        for start in range(0, len(ids), most):
            own = ids[start : start + most].astype(np.int64)
            own = own[own < len(self.at) - 1]
            first, lengths = self.at[own], self.at[own + 1] - self.at[own]
            places = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            out.append(self.raw[places].tobytes())
        return b"".join(out).decode("utf-8", "replace")


class Automaton:
    """Aho-Corasick automaton of tokens read from their ends, so that going through bytes backwards tells the longest token that starts at each.

    All goto and failure steps are in one table of states by bytes.
    """

    def __init__(self, tokens: dict[bytes, int]):
        raw, lengths = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.fromiter(map(len, tokens), dtype=np.int64)
        last = np.cumsum(lengths) - 1
        self.longest = int(lengths.max())
        state, states, levels = np.zeros(len(lengths), dtype=np.int64), 1, []
        for depth in range(self.longest):
            live = np.flatnonzero(lengths > depth)
            codes, which = np.unique(state[live] * 256 + raw[last[live] - depth], return_inverse=True)
            levels.append((codes >> 8, codes & 255, states + np.arange(len(codes))))
            state[live] = states + which
            states += len(codes)
        self.token = np.zeros(states, dtype=np.int32)
        own = np.full(states, -1, dtype=np.int32)
        own[state] = np.fromiter(tokens.values(), dtype=np.int32)
        self.goto = np.zeros((states, 256), dtype=np.int32)
        fails = np.zeros(states, dtype=np.int64)
        for depth, (above, byte, here) in enumerate(levels):
            if depth:
                fails[here] = self.goto[fails[above], byte]
                self.goto[above, byte] = here  # only now: the line before needs what failing gives
            else:
                self.goto[0, byte] = here
            self.goto[here] = self.goto[fails[here]]
            self.token[here] = np.where(own[here] >= 0, own[here], self.token[fails[here]])

    def matched(self, raw: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each byte of the stretches ``raw[start:start + length]`` the longest token that starts there and ends in the stretch."""
        found = np.zeros(len(raw), dtype=np.int32)
        order = np.argsort(-lengths, kind="stable")
        sizes = -lengths[order]
        last = (start + lengths - 1)[order]
        state = np.zeros(len(order), dtype=np.int32)
        for depth in range(int(-sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(sizes, -depth))
            at = last[:n] - depth
            state[:n] = self.goto[state[:n], raw[at]]
            found[at] = self.token[state[:n]]
        return found

    def matched_long(self, raw: np.ndarray, most: int = 1 << 18, width: int = 1 << 10) -> np.ndarray:
        """The same for one long stretch, cut into many that reach over each other by as much as a token can be long."""
        out = np.zeros(len(raw), dtype=np.int32)
        for first in range(0, len(raw), most):
            starts = np.arange(first, min(first + most, len(raw)), width)
            ends = np.minimum(starts + width + self.longest - 1, len(raw))
            places = spread(starts, ends - starts)
            here = np.cumsum(ends - starts) - (ends - starts)
            found = self.matched(raw[places], here, ends - starts)
            sure = np.minimum(width, len(raw) - starts)
            stop = min(first + most, len(raw))
            out[first:stop] = found[spread(here, sure)]
        return out


class Encoder:
    """Texts to ids, as the library encodes without special tokens; ids are little-endian unsigned 32-bit integers.

    Up to ``cached`` segments (what stands between two cuts) are remembered; new
    ones are cut into pieces, and new pieces of up to ``longest`` bytes are
    encoded many at a time, longer ones one by one.
    """

    FIRST, SPECIAL = "\ud800", "\ud801"  # before keys; lone surrogates, so no text has them

    def __init__(self, path: str, cached: int = 250_000, longest: int = 64):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.vocabulary = v = Vocabulary(path)
        self.cached, self.longest = cached, longest
        self.automaton = Automaton(v.ids)
        self.length = np.diff(v.at)
        self.size = n = len(self.length)
        codes = np.array([a * n + b for a, b in v.pairs], dtype=np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], order
        halves = np.full((2, n), -1, dtype=np.int64)
        self.taken = np.full(n, NEVER, dtype=np.int64)  # rank of the merge that makes a token
        for i, (left, right, rank) in v.parts.items():
            halves[:, i], self.taken[i] = (left, right), rank
        self.edges = [self.edge_table(half) for half in halves]
        self.shorter = np.full(n, -1, dtype=np.int64)
        for raw, i in v.ids.items():
            self.shorter[i] = next((v.ids[raw[:k]] for k in range(len(raw) - 1, 0, -1) if raw[:k] in v.ids), -1)
        # The pair table: code of the pair, doubled, plus whether it is compatible.
        self.table = np.full(1 << 18, -1, dtype=np.int64)
        self.pattern = regex.compile(PATTERN)
        self.library = ByteLevel(add_prefix_space=False)
        self.special = re.compile("|".join(map(re.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None
        self.seen: set[str] = set()
        self.odd: dict[int, str] = {}
        self.forget()

    def forget(self) -> None:
        self.segments, self.pieces, self.held = Numbers(), Numbers(), 0
        self.segment_ids, self.piece_ids = Pool("u4"), Pool("u4")

    @staticmethod
    def edge_table(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the tokens at one edge while it is put together, from itself down to a byte, and how many they are."""
        columns, depth = [np.arange(len(half))], np.ones(len(half), dtype=np.int64)
        while (columns[-1] >= 0).any():
            below = np.where(columns[-1] >= 0, half[columns[-1]], -1)
            depth += below >= 0
            columns.append(below)
        return np.stack(columns, axis=1), depth

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        codes = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, self.pair_ranks[at], NEVER)

    def borders_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each ``a`` and ``b`` alone leaves their border."""
        (lefts, left_depth), (rights, right_depth) = self.edges
        out, at, i, j = np.ones(len(a), dtype=bool), np.arange(len(a)), right_depth[a] - 1, left_depth[b] - 1
        while len(at):
            # What stands at the border now, and the rank of the merge that takes it up on its own side.
            x, y = rights[a, i], lefts[b, j]
            x_ends = np.where(i > 0, self.taken[rights[a, i - 1]], NEVER)
            y_ends = np.where(j > 0, self.taken[lefts[b, j - 1]], NEVER)
            rank = self.rank(x, y)
            # Of equal merges the leftmost goes first: one inside a before the crossing one, that before one inside b.
            crossed = (rank < x_ends) & (rank <= y_ends)
            out[at[crossed]] = False
            going = ~crossed & (np.minimum(x_ends, y_ends) != NEVER)
            in_a = x_ends <= y_ends
            a, b, at, i, j = a[going], b[going], at[going], (i - in_a)[going], (j - ~in_a)[going]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`borders_stay` through the pair table, which keeps the pairs met last; a negative ``a`` is compatible with all."""
        codes = 2 * (a * self.size + b)
        slots = (codes * 0x9E3779B1 >> 16) & (len(self.table) - 1)
        held = self.table[slots]
        out = (a < 0) | (held == codes + 1)
        new = np.flatnonzero((a >= 0) & (held >> 1 != codes >> 1))
        if len(new):
            out[new] = self.borders_stay(a[new], b[new])
            self.table[slots[new]] = codes[new] + out[new]
        return out

    def encode_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each piece): a step takes or gives up one token of every piece that is not done."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"\0".join([*pieces, b""]), dtype=np.uint8)
        start = np.cumsum(lengths + 1) - lengths - 1
        longest = self.automaton.matched(raw, start, lengths)
        given_up = np.zeros(len(raw) + 1, dtype=bool)
        stack = np.full((len(pieces), int(lengths.max(initial=0)) + 1), -1, dtype=np.int64)  # column 0: nothing before the first
        depth, at, who = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64), np.arange(len(pieces))
        token = longest[start]
        while len(who):
            here, last = start[who], stack[who, depth[who]]
            end = at[who] + self.length[token]
            ok = ~given_up[here + end]
            ok[ok] = self.compatible(last[ok], token[ok])
            taken = who[ok]
            depth[taken] += 1
            stack[taken, depth[taken]] = token[ok]
            at[taken] = end[ok]
            less = self.shorter[token]
            back = np.flatnonzero(~ok & (less < 0))
            given_up[here[back] + at[who[back]]] = True
            at[who[back]] -= self.length[last[back]]
            depth[who[back]] -= 1
            token = np.where(ok, longest[np.where(ok, here + end, 0)], less)
            token[back] = last[back]  # ends where it was given up, so that a shorter one comes next
            going = ~ok | (end < lengths[who])
            who, token = who[going], token[going]
        filled = np.arange(1, stack.shape[1]) <= depth[:, None]
        return stack[:, 1:][filled], depth

    def encode_long(self, raw: bytes) -> np.ndarray:
        """The same for one long piece, token by token."""
        longest = self.automaton.matched_long(np.frombuffer(raw, dtype=np.uint8)).tolist()
        given_up, agree = bytearray(len(raw) + 1), self.agree
        tokens, at, token = array("I"), 0, longest[0]
        while at < len(raw):
            end = at + self.lengths[token]
            if not given_up[end]:
                fits = True
                if tokens and (fits := agree.get((tokens[-1], token))) is None:
                    fits = agree[tokens[-1], token] = self.border_stays(tokens[-1], token)
                if fits:
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < len(raw) else -1
                    continue
            token = self.shorter_list[token]
            while token < 0:
                given_up[at] = 1
                token = tokens.pop()
                at -= self.lengths[token]
                token = self.shorter_list[token]
        if len(agree) > 1 << 19:
            agree.clear()
        return np.array(tokens, dtype=np.uint32)

    def border_stays(self, a: int, b: int) -> bool:
        """:meth:`borders_stay` of one pair."""
        pairs, parts = self.vocabulary.pairs, self.vocabulary.parts

        def edge(token: int, side: int) -> list[tuple[int, int]]:
            out = [(token, NEVER)]
            while token in parts:
                rank, token = parts[token][2], parts[token][side]
                out.append((token, rank))
            return out

        right, left = edge(a, 1), edge(b, 0)
        while True:
            (x, x_ends), (y, y_ends) = right[-1], left[-1]
            rank = pairs.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == NEVER:
                return True
            (right if x_ends <= y_ends else left).pop()

    @cached_property
    def lengths(self) -> list[int]:
        return self.length.tolist()

    @cached_property
    def shorter_list(self) -> list[int]:
        return self.shorter.tolist()

    @cached_property
    def agree(self) -> dict[tuple[int, int], bool]:
        return {}

    def learn_pieces(self, most: int = 1 << 17) -> None:
        """Encode the pieces that were numbered since the last time."""
        new = [p.encode() for p in islice(self.pieces, len(self.piece_ids.lengths), None)]
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        order, ids = [], Pool("u4")
        for k in np.flatnonzero(sizes > self.longest).tolist():
            own = self.encode_long(new[k])
            ids.add(own, np.array([len(own)]))
            order.append([k])
        short = np.flatnonzero(sizes <= self.longest)
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(sizes[short]) // most)) + 1):
            ids.add(*self.encode_short([new[k] for k in some.tolist()]))
            order.append(some)
        back = np.argsort(np.concatenate(order).astype(np.int64), kind="stable")
        lengths = ids.lengths[back]
        self.piece_ids.add(ids.data[spread(ids.offsets[back], lengths)], lengths)

    def stand_ins(self, text: str) -> str:
        """``text`` with characters that the library's tables put in another class replaced by one of that class."""
        if text.isascii():
            return text
        for c in set(text) - self.seen:
            self.seen.add(c)
            if not c.isascii():
                name = self.class_of(c, lambda s: len(self.library.pre_tokenize_str(s)))
                if name != self.class_of(c, lambda s: len(self.pattern.findall(s))):
                    self.odd[ord(c)] = STAND_INS[name]
        return text.translate(self.odd) if self.odd else text

    @staticmethod
    def class_of(c: str, pieces) -> str:
        for probe, name in (("a", "letter"), ("1", "number"), (".", "other")):
            if pieces(probe + c) == 1:
                return name
        return "space"

    def cut(self, text: str) -> list[str]:
        shown = self.stand_ins(text)
        if shown is text:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]

    def learn(self) -> None:
        """Cut the segments that were numbered since the last time, and encode them."""
        new = list(islice(self.segments, len(self.segment_ids.lengths), None))
        own = [k for k, s in enumerate(new) if s[0] >= self.FIRST and s[0] <= self.SPECIAL]
        plain = np.ones(len(new), dtype=bool)
        plain[own] = False
        rest = [s for s, x in zip(new, plain.tolist()) if x] if own else new
        # Each blank before a segment starts a piece, so that all can be cut in one go.
        pieces = self.cut(" " + " ".join(rest)) if rest else []
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        sizes = np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))
        counts, added = np.zeros(len(new), dtype=np.int64), []
        counts[plain] = np.diff(np.searchsorted(ends, np.cumsum(sizes + 1), "right"), prepend=0)
        starts = np.zeros(len(new), dtype=np.int64)
        starts[plain] = np.cumsum(counts[plain]) - counts[plain]
        for k in own:
            if new[k][0] == self.SPECIAL:
                added.append(k)
            else:
                cut = self.cut(new[k][1:])
                starts[k], counts[k] = len(pieces), len(cut)
                pieces += cut
        places = np.fromiter(map(self.pieces.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        self.learn_pieces()
        places = places[spread(starts, counts)]
        offsets, lengths = self.piece_ids.offsets[places], self.piece_ids.lengths[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        data, many = self.piece_ids.data[spread(offsets, lengths)], np.diff(ends)
        if added:
            data = np.insert(data, ends[added], [self.vocabulary.added[new[k][1:]] for k in added])
            many[added] = 1
        self.segment_ids.add(data, many)
        self.held += int(sizes.sum()) + sum(len(new[k]) for k in own)

    def stretches(self, text: str, most: int = 1 << 20) -> Iterator[list[str]]:
        """The segments' keys, of about ``most`` characters at a time."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.between(text[at : m.start()], most)
            yield [self.SPECIAL + m.group()]
            at = m.end()
        yield from self.between(text[at:] if at else text, most)

    def between(self, text: str, most: int) -> Iterator[list[str]]:
        at, mark = 0, self.FIRST
        while at < len(text):
            # The next stretch starts behind a cut's blank.
            found = CUT.search(text, at + most) if len(text) - at > most else None
            stop = found.start() if found else len(text)
            own = text if stop - at == len(text) else text[at:stop]
            segments = CUT.split(own) if NOT_CUT.search(own) else own.split(" ")
            segments[0] = mark + segments[0]
            yield segments
            at, mark = found.end() if found else len(text), ""

    def encode(self, texts: list[str], most: int = 1 << 20) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            for segments in self.stretches(text):
                waiting.append((i, segments))
                held += len(segments)
                if held > most:
                    self.flush(waiting, out)
                    waiting, held = [], 0
        self.flush(waiting, out)
        return [b"".join(x) for x in out]

    def flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.segments) > self.cached or self.held > 32 * self.cached:
            self.forget()
        every = [s for _, segments in waiting for s in segments]
        at = np.fromiter(map(self.segments.__getitem__, every), dtype=np.int64, count=len(every))
        self.learn()
        offsets, lengths = self.segment_ids.offsets[at], self.segment_ids.lengths[at]
        ids = self.segment_ids.data[spread(offsets, lengths)].astype("<u4", copy=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *(len(s) for _, s in waiting)])].tolist()
        for (i, _), a, b in zip(waiting, ends, ends[1:]):
            out[i].append(ids[a:b].tobytes())


def encoded(text: Column, model: str, batch_bytes: int = 4 << 20, back: bool = False) -> Column:
    """``text`` as a binary column of ids (little-endian unsigned 32-bit integers); null and empty texts have none.

    With ``back`` a struct (``ids``, ``decoded``): the ids, and their text again, from
    the same worker. ``model`` is the path of a byte-level BPE file that every executor has. The
    library's ids without special tokens; the string of an added token inside a
    text becomes that token, as is the library's default. Whole texts: one
    without any blank costs about 12 bytes of memory a byte more.
    """

    @F.arrow_udf("struct<ids: binary, decoded: string>" if back else "binary")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model)
        for column in columns:
            whole = pa.RecordBatch.from_arrays([column], ["t"])
            ids: list[bytes] = []
            for batch in by_bytes(iter([whole]), "t", batch_bytes):
                ids += encoder.encode([x or "" for x in batch.column("t").to_pylist()])
            out = pa.array(ids, pa.binary())
            if back:
                texts = [encoder.vocabulary.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
                out = pa.StructArray.from_arrays([out, pa.array(texts, pa.string())], ["ids", "decoded"])
            yield out

    return encode(text)


def decoded(ids: Column, model: str) -> Column:
    """The text of a binary column of ids, as the library decodes with special tokens kept; null stays null."""

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(model)
        for column in columns:
            yield pa.array([vocabulary.decode(np.frombuffer(x.as_buffer(), dtype="<u4")) if x.is_valid else None for x in column], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a binary column ``ids`` (:func:`encoded`), which replaces one of that name.

    With ``decoded`` also a column of that name with the ids' text again. Null and
    empty texts have no ids (an empty value) and decode to an empty text. Each row
    is encoded by itself, so that repeated rows, ties and empty tables need no care.
    """
    small_batches(docs.sparkSession)
    if decoded is None:
        return docs.withColumn(ids, encoded(F.col(f"`{text}`"), model))
    both = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), encoded(F.col(f"`{text}`"), model, back=True).alias("both"))
    return both.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in (ids, decoded)), F.col("both.ids").alias(ids), F.col("both.decoded").alias(decoded))


def decode_documents(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a text column (:func:`decoded`), which replaces one of that name; null ids give a null text."""
    return docs.withColumn(text, decoded(F.col(f"`{ids}`"), model))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every whole text of ``documents`` encoded and decoded again."""
    import public_tokenizers

    model = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = encode_documents(docs, model, decoded="decoded")
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
