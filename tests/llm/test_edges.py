"""Odd tables, both paths of joins, and what workers need."""

import math
import os
import random
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from gleanspark.llm import decontaminate, langid, quality_rules, secrets, sharding, simhash, url_filter
from gleanspark.llm.common import may_hold

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def plain_randomness(token):
    """The battery in plain floats."""

    def tail(z):
        return max(math.erfc(z / math.sqrt(2)) / 2, 1e-45)

    def chi(x, df):
        return tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))

    bare = re.sub("(?<=[^=])=+$", "", token)
    letters = next(a for p, a in secrets.ENCODINGS if re.search(p, bare))
    c, k, n = [letters.index(x) for x in bare], len(letters), len(bare)
    uniform = chi(max(0, sum(v * v for v in Counter(c).values()) * k / n - n), k - 1)
    cells = [(sum(x in s for x in bare), n * len(set(s) & set(letters)) / k) for s in secrets.CLASSES if set(s) & set(letters)]
    classes = chi(sum((o - e) ** 2 / e for o, e in cells), len(cells) - 1)
    high = sum(x >= k / 2 for x in c)
    runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(c, c[1:]))
    mean = 2 * high * (n - high) / n + 1
    by_runs = 2 * tail(abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-6)))
    m = sum(c) / n
    serial = sum((a - m) * (b - m) for a, b in zip(c, c[1:])) / max(sum((x - m) ** 2 for x in c), 1e-6)
    h = -sum(math.log(min(1, p)) for p in (uniform, classes, by_runs, 2 * tail(abs(serial + 1 / n) * math.sqrt(n))))
    return math.exp(-h) * (1 + h + h * h / 2 + h**3 / 6)


LETTERS = {"b62": secrets.UPPER + secrets.LOWER + secrets.DIGITS, "hex": "0123456789abcdef", "b64": secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/"}
PARTS = "image frontend category payment module photo deploy backend version user profile avatar upload service handler request response".split()


def key(rng, kind, n):
    while True:
        t = "".join(rng.choice(LETTERS[kind]) for _ in range(n))
        if re.search("[0-9]", t) and re.search("[A-Za-z]", t):
            return t


def identifier(rng):
    while True:
        w, n = [rng.choice(PARTS) for _ in range(rng.randint(2, 5))], str(rng.randint(1, 99))
        t = rng.choice(["/".join(w) + "-" + n, "".join(x.title() for x in w) + n, "-".join(w) + "_" + n, "_".join(w) + n])
        if len(t) >= 20:
            return t


def test_randomness_against_plain_p_values(spark):
    rng = random.Random(31)
    tokens = [key(rng, k, n) for k in LETTERS for n in (20, 33, 64)] + [identifier(rng) for _ in range(20)] + ["a1" * 15, "Zz0+/" * 6 + "==", "x" * 30 + "1"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.randomness(F.col("t")).alias("p")).collect()
    for r in rows:
        assert math.isclose(math.log(max(r.p, 1e-40)), math.log(max(plain_randomness(r.t), 1e-40)), rel_tol=1e-3, abs_tol=1e-3), r.t


def test_few_identifiers_are_called_secrets_and_planted_keys_are_found(spark):
    rng = random.Random(32)
    tokens = [(identifier(rng), False) for _ in range(300)] + [(key(rng, kind, 32), True) for kind in LETTERS for _ in range(50)]
    docs = spark.createDataFrame([(i, f"ref {t} end") for i, (t, _) in enumerate(tokens)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.scan(docs).collect() if any(s.kind in (2, 3) for s in r.spans)}
    false = sum(i in hit for i, (_, secret) in enumerate(tokens) if not secret)
    found = sum(i in hit for i, (_, secret) in enumerate(tokens) if secret)
    assert found >= 147 and false <= 0.05 * len(hit) + 2
    only = docs.where("doc_id < 300")
    assert sum(len(r.spans) > 0 for r in secrets.scan(only).collect()) <= 3


def test_redaction_keeps_columns_of_any_name(spark):
    text = "password=abcdefgh12 rest"
    row = (1, text, 5, "b", "_b", "_t", "s", "n", "r")
    docs = spark.createDataFrame([row, (None, None, 0, *row[3:]), (2, "plain", 5, *row[3:])], "doc_id long, text string, n_chars long, base string, _base string, _text string, spans string, names string, row string")
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert tuple(got[1]) == (1, "[SECRET] rest", 13, *row[3:]) and tuple(got[2])[1:3] == ("plain", 5) and got[None].text is None
    assert secrets.redact(docs).columns == docs.columns


def test_decontamination_paths_agree_on_null_and_repeated_ids(spark):
    rng = random.Random(33)
    items = [(1, words(rng, 30)), (1, words(rng, 12)), (None, words(rng, 20)), (2, "İstanbul ΣΑΣ one two three"), (3, None), (2, "short One")]
    texts = [f"{words(rng, 5)} {t} {words(rng, 5)}" for _, t in items if t] + ["x y", None, ""]
    rows = [(i % 3 or None, t) for i, t in enumerate([*texts, texts[0], texts[0]])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def pairs(most):
        return Counter(map(tuple, decontaminate.containment_pairs(docs, bench, most_bytes=most).collect()))

    assert pairs(1 << 20) == pairs(0) and sum(pairs(0).values()) >= 7
    left = [Counter(map(tuple, decontaminate.without_items(docs, bench, most_bytes=most).collect())) for most in (1 << 20, 0)]
    assert left[0] == left[1] == Counter(r for r in rows if r[1] in ("x y", None, ""))


def test_language_with_null_ids_many_languages_and_clashing_names(spark):
    rng = random.Random(34)
    rows = [(None if i % 2 else i, words(rng, 20, "etaoin" if i % 3 else "usrlmk"), "en" if i % 3 else "fr", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, found int").withColumn("_p", F.lit(1)).withColumn("row", F.lit(2))
    model = langid.train(docs)
    got = langid.identify(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.where("lang_pred = lang").count() >= 58
    many = spark.createDataFrame([(i, words(rng, 9), f"l{i % 40}", 0) for i in range(400)], "doc_id long, text string, lang string, found int")
    assert sum(len(x) for x in langid.train(many, most_rows=40).members.values()) <= 80
    assert langid.identify(docs.limit(0), model).count() == 0


def test_url_filter_with_very_many_paths_and_clashing_names(spark):
    rules = [("block" if i % 2 else "allow", "a.b", f"/foo{i}") for i in range(3000)]
    pages = spark.createDataFrame([(1, "http://a.b/foo17", "j"), (2, "http://x.a.b/foo2999z/1", "j"), (3, "http://a.b/fo", "j")], "page_id long, url string, _j string").withColumn("row", F.lit(1))
    for most in (10_000, 1):
        got = url_filter.filter_urls(pages, rules, max_trie_rules=most).orderBy("page_id").collect()
        assert [(r.rule, r.verdict, r._j, r.row) for r in got] == [("a.b/foo17", "block", "j", 1), ("a.b/foo2999", "block", "j", 1), (None, "allow", "j", 1)]


def test_rules_on_repeated_ids_and_empty_tables(spark):
    rng = random.Random(35)
    docs = spark.createDataFrame([(1, words(rng, 40))] * 50 + [(2, words(rng, 30))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    x, bad = quality_rules.labelled_sample(quality_rules.text_statistics(docs, "doc_id", "text"), labels, "doc_id", "quality", 100)
    assert len(x) == 2 and bad.tolist() == [False, True]
    judged, rules = quality_rules.quality_verdicts(docs.limit(0), labels)
    assert judged.count() == 0 and rules == []
    long = spark.createDataFrame([(7, words(rng, 60_000))], "doc_id long, text string")
    assert quality_rules.text_statistics(long, "doc_id", "text").first().n_words == 60_000


def test_sharding_leaves_no_document_that_could_move(spark):
    rng = random.Random(36)
    texts = [None, "", *["hot"] * 700, *[f"pair {i // 3}" for i in range(900)], *[words(rng, 4) for _ in range(400)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, 8).collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    by_id = {r.doc_id: r.shard for r in rows}
    together = sum(len({by_id[702 + 3 * i + k] for k in range(3)}) == 1 for i in range(300))
    assert together >= 280


def test_bitmap_loses_nothing(spark):
    table = spark.range(5000).withColumn("_page", F.lit("own"))
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "d")
    for most in (1 << 26, 1 << 15):
        got = may_hold(table, F.col("id"), ids, "may", most_bits=most).collect()
        assert len(got) == 5000 and all(r.may for r in got if r.id % 7 == 0)
    assert sum(r.may for r in may_hold(table, F.col("id"), ids, "may").collect()) < 1200
    assert not any(r.may for r in may_hold(table, F.col("id"), ids.limit(0), "may").collect())


def test_near_duplicates_with_nulls_clashing_names_and_long_texts(spark):
    rng = random.Random(37)
    long = words(rng, 20_000)
    rows = [(1, long, "a", 1), (2, long + " more", "a", 1), (None, long, "a", 1), (None, None, "a", 1), (3, None, "a", 1), (4, "", "a", 1), (5, "other words here", "a", 1), (5, "and a text of the same id", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, may int")
    got = simhash.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text and r.text[:5]) for r in got.collect()) == Counter([(1, long[:5]), (None, long[:5]), (None, None), (3, None), (5, "other"), (5, "and a")])
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from gleanspark.llm import decontaminate, langid, simhash, token_counts, url_filter
docs = spark.createDataFrame([(i, "some words of a text number %d and more of them" % (i % 3), "en" if i % 2 else "fr") for i in range(12)], "doc_id long, text string, lang string")
items = docs.limit(1).selectExpr("doc_id AS item_id", "text")
print("PAIRS", decontaminate.containment_pairs(docs, items).count())
print("LEFT", decontaminate.without_items(docs, items).count())
print("LANGS", langid.identify(docs, langid.train(docs)).count())
print("KEPT", simhash.keep_one_of_each(docs).count())
print("URLS", url_filter.filter_urls(docs.selectExpr("doc_id AS page_id", "'http://a.net/' AS url"), url_filter.RULES).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    (tmp_path / "job.py").write_text(SCRIPT.format(root=ROOT))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.findall(r"^([A-Z]+) (\d+)$", done.stdout, re.M) == [("PAIRS", "4"), ("LEFT", "8"), ("LANGS", "12"), ("KEPT", "3"), ("URLS", "12")]


def test_very_long_tokens_are_scanned_and_redacted(spark):
    rng = random.Random(8)
    long = key(rng, "b64", 300_000)
    texts = ["see x1" + "z" * 50_000 + " end", "blob " + long + " end", "password=" + "xb1" * 40_000, "x1" + "z" * 4094, key(rng, "b62", 4096), key(rng, "b62", 4097)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [(s.start, s.kind, s.end) for s in got[2].base] == [(0, 0, len(texts[2]))]
    spans = {i: [(s.start, s.end) for s in got[i].spans if s.kind == 3] for i in got}
    assert spans[0] == [] and spans[3] == [] and spans[1] == [(5, 5 + len(long))] and spans[4] == [(0, 4096)] and spans[5] == [(0, 4097)]
    clean = {r.doc_id: r.text for r in secrets.redact(docs, n_chars=None).collect()}
    assert clean[0] == texts[0] and clean[1] == "blob [SECRET] end" and clean[2] == "[SECRET]"
    tokens = [texts[0][4:-4], texts[3], texts[4], texts[5]]
    for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.randomness(F.col("t")).alias("p")).collect():
        assert math.isclose(math.log(max(r.p, 1e-40)), math.log(max(plain_randomness(r.t), 1e-40)), rel_tol=1e-3, abs_tol=1e-3)


def test_near_duplicates_of_text_ids(spark):
    rng = random.Random(9)
    base = words(rng, 60)
    rows = [("b", base), ("a", base + " more"), ("10", words(rng, 60)), (None, base), ("9", base), ("z", None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id string, text string, _n int")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10", "9", "None", "z"]


def test_the_language_sample_is_bounded_whatever_the_copies(spark):
    rng = random.Random(12)
    rows = [(None, "the same words again", "en")] * 5000 + [(i, words(rng, 8), "en") for i in range(300)] + [(i, words(rng, 8, "αβγδεζ"), "el") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = langid.fit
    try:
        langid.fit = lambda x, languages, families: seen.append(len(languages)) or fit(x, languages, families)
        model = langid.train(docs, per_language=250)
    finally:
        langid.fit = fit
    assert 350 <= seen[0] <= 602
    assert {r.lang_pred for r in langid.identify(docs.limit(1), model).collect()} == {"en"}


def test_token_counts_remember_few_bytes():
    from gleanspark.llm import token_counts

    count = token_counts.piece_counter(public_tokenizers.path("piece_bpe_32k.model"), most=1000)
    texts = ["a b c", "x" * 5000, "x" * 5000 + " y", "long " * 400, "", "a b c"]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(3):
        assert count(texts) == [len(sp.encode(t)) for t in texts]
