"""Byte-level BPE, centroid clustering and importance resampling against the library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from gleanspark.llm import byte_bpe, centroids, resampling

MODEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(MODEL)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def odd_texts():
    rng = random.Random(11)
    alphabets = ["a", "ab", " a", "  \n\ta", "aé1. '　", "0123456789", "=-_ ", "thein gro", "\U0001d6a6՘꟎ 1.", "😀👍🏽 x", "' strevmld"]
    for n in (1, 2, 5, 50, 700):
        for letters in alphabets:
            for _ in range(8):
                yield "".join(rng.choice(letters) for _ in range(n))
    for _ in range(500):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(60)))
    yield from ["", " ", "a<|endoftext|> b  <|endoftext|><|endoftext|>", "<|endoftext|", "<|endoftext|>", "x\x1c y\x85 z\xa0   w᠎"]


def test_byte_bpe_is_the_library_s(encoder, library):
    texts = list(odd_texts())
    found = [np.frombuffer(x, "<u4").tolist() if x else [] for x in encoder.encode(texts)]
    wanted = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert found == wanted
    assert [encoder.vocabulary.decode(np.array(x, "<u4")) for x in wanted] == texts == [library.decode(x, skip_special_tokens=False) for x in wanted]


def test_byte_bpe_of_long_texts_and_small_caches(library):
    small = byte_bpe.Encoder(MODEL, cached=5, longest=6)
    rng = random.Random(3)
    texts = ["x " * 700_000 + "y" * 50_000 + " z", "".join(rng.choice("abcdefgh") for _ in range(20_000)), "-" * 3000, *odd_texts()]
    for k in range(0, len(texts), 40):
        some = texts[k : k + 40]
        assert [np.frombuffer(x, "<u4").tolist() if x else [] for x in small.encode(some)] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_pair_table_is_what_the_merges_do(encoder, library):
    """Every token's bytes encode to itself, and two tokens are compatible just if the merges leave their border."""
    v, rng = encoder.vocabulary, random.Random(5)
    merges = {(v.token(a), v.token(b)): r for (a, b), r in v.pairs.items()}

    def merged(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((merges.get(p, math.inf), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == math.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    assert all(merged(t) == [t] for t in v.ids)
    ids = list(v.ids.values())
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]
    runs = [i for t, i in v.ids.items() if len(set(t)) == 1]
    pairs += [(a, b) for a in runs[:300] for b in runs[:300] if v.token(a)[0] == v.token(b)[0]]
    a, b = np.array(pairs, dtype=np.int64).T
    wanted = [merged(v.token(x) + v.token(y)) == [v.token(x), v.token(y)] for x, y in pairs]
    assert encoder.borders_stay(a, b).tolist() == wanted == encoder.compatible(a, b).tolist() == encoder.compatible(a, b).tolist()
    assert [encoder.border_stays(*p) for p in pairs] == wanted and any(wanted) and not all(wanted)


def test_byte_bpe_columns(spark, library):
    rows = [(1, "a b", "x"), (None, None, "y"), (1, "a b", "z"), (2, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in out.collect())
    ab = np.array(library.encode("a b").ids, "<u4").tobytes()
    assert got == [("1", ab, "a b"), ("1", ab, "a b"), ("2", b"", ""), ("None", b"", "")]
    both = byte_bpe.encode_documents(docs, MODEL, decoded="text")
    assert both.columns == ["doc_id", "ids", "text"]
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["text"]) for r in both.collect()) == got
    assert byte_bpe.encode_documents(docs.limit(0), MODEL).count() == 0
    assert byte_bpe.decode_documents(spark.createDataFrame([(None,), (np.array([0, 99_999_999], "<u4").tobytes(),)], "ids binary"), MODEL).select("decoded").collect() == [(None,), ("!",)]


def plain_clusters(rows, k, rounds, seed=2, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, x) in zip(kept, found) if x == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    per = Counter()
    for d, j in found:
        per[j] += d
    return sorted((str(i), j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found))


@pytest.mark.parametrize("k", [3, 40])
def test_centroids_against_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) if i % 3 else rng.uniform(-2, 2) for _ in range(64)]) for i in range(150)]
    rows += [(7, list(rows[7][1])) for _ in range(60)]  # copies
    rows += [(None, [0.1] * 64), (None, [0.1] * 64), (900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, [])]
    table = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<float>, cluster string, v int").repartition(3)
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in centroids.cluster(table, k=k).collect())
    assert got == plain_clusters(rows, k, 5)


def test_centroids_of_empty_and_tiny_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    one = centroids.cluster(spark.createDataFrame([(1, [0.5] * 64)], schema)).collect()
    assert [tuple(r)[:5] for r in one] == [(1, 0, 0, 0, 0)]
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema)).collect()


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(4)
    rows, c = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (30, 64))
    c[7] = c[3]
    rows[:50] = c[3]
    whole = ((rows[:, None] - c[None]) ** 2).sum(axis=2)
    found, distance = centroids.nearest(rows, c, rng.permutation(64))
    assert (found == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def plain_resample(rows, target, percent=25, least=20):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000.0) / ((s[b] + 1.0) * (t.total() + 10000.0))))
    out = []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0], r[2]))
    ranks = {}
    for at, r in enumerate(may[: percent * len(may) // 100], 1):
        ranks.setdefault(r, []).append(at)
    return sorted((str(r[0]), r[2], r[3], r[4], str(ranks[r].pop() if ranks.get(r) else None)) for r in out)


def test_resampling_against_brute_force(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "größe", "x1", "delta", "EPS", "zeta", "漢字"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 19, 20, 21, 90]))) + rng.choice(["", "\x00\n!", "."])) for i in range(300)]
    rows += [(None, rows[5][1]), (None, None), (400, None), (401, ""), (402, "one")] + [(403, "alpha beta " * 15)] * 25 + [(None, "beta x1 " * 20)] * 3
    target = ["alpha beta alpha", None, "größe delta"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, buckets string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, goal)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in got.collect()) == plain_resample(rows, target)
    assert resampling.resample(docs.limit(0), goal).collect() == []
    assert resampling.resample(docs, goal.limit(0)).count() == len(rows)
    assert resampling.resample(docs.limit(3), goal, percent=0).where("rank is not null").count() == 0


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_buckets_do_not_depend_on_stretches(longest):
    text = " ".join(f"W{i % 97}" for i in range(3000)).encode() + b" \x00!"
    n, whole = resampling.feature_buckets(text, longest, 1000)
    m, cut = resampling.feature_buckets(text, longest, 1000, most=40)
    assert n == m == 3000 and sorted(whole) == sorted(cut) and len(whole) == sum(3000 - k for k in range(longest))
