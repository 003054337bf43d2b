"""Recall of many questions at once against the one-question path."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from gleanspark.operators import similarity


def test_many_questions_equal_one_by_one(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("deploy error disk Full latency cache miss timeout user login slow fast green red".split())
    texts = [" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    texts += [t + "!" for t in texts[:30]] + ["x" * 150, "émigré " * 20, ""]
    memory = similarity.embed_texts(spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "row_id long, text string"))
    asked = [(100 + i, t) for i, t in enumerate(texts[:50])] + [(1, None)]
    questions = similarity.embed_texts(spark.createDataFrame(asked, "question_id long, text string"))
    k = 3
    got = {}
    for r in similarity.recall(questions, memory, k).orderBy("question_id", "place").collect():
        got.setdefault(r.question_id, []).append(r.text)
    rows = memory.where("text IS NOT NULL").collect()
    lines = {r.row_id: r.l for r in memory.where("text IS NOT NULL").select("row_id", similarity.normal_line(F.col("text")).alias("l")).collect()}
    vectors = np.array([r.embedding for r in rows], dtype=float)
    units = vectors / np.where((n := np.linalg.norm(vectors, axis=1, keepdims=True)) > 0, n, 1)
    at = {r.row_id: i for i, r in enumerate(rows)}
    for q, text in asked[:-1]:
        own = at[q - 100]
        scores = units @ units[own]
        near = sorted(((-s, r.row_id, r) for s, r in zip(scores, rows) if s > similarity.LEAST and lines[r.row_id] != lines[q - 100]), key=lambda x: (round(x[0], 12), x[1]))[: 2 * k + 1]
        kept = similarity.without_alike([r for _, _, r in near])[:k]
        assert got.get(q, []) == [r.text[:100] + ("..." if len(r.text.encode()) > 100 else "") for r in kept]
    ranked = similarity.top_k(memory.where("text IS NOT NULL"), rows[0].embedding, 40)
    assert similarity.context(ranked, texts[0], k)[0] == got[100][0]
    assert similarity.recall(questions.limit(0), memory, k).count() == 0


def test_blocks_of_queries_find_the_same(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], i % 5) for i in range(60)], "id long, embedding array<double>, s int")
    queries = rows.withColumnRenamed("id", "q")
    one = sorted(map(tuple, similarity.nearest_of_each(queries, rows, 4, "q", "id").select("q", "id").collect()))
    assert one == sorted(map(tuple, similarity.nearest_of_each(queries, rows, 4, "q", "id", block=7).select("q", "id").collect()))
    skipped = similarity.nearest_of_each(queries, rows, 4, "q", "id", block=7, skip="s").select("q", "id").collect()
    assert len(skipped) > 0 and all(r.q % 5 != r.id % 5 for r in skipped)


def test_a_task_holds_few_scores_and_ties_go_by_id():
    """4000 rows against 300 queries: no array of all scores; copies of a vector have one score and stand by id."""
    rng = np.random.default_rng(2)
    own = similarity.unit(rng.normal(size=(4000, 24)))
    own[rng.integers(0, 4000, 900)] = own[7]
    queries, ids = np.concatenate([own[:299], own[7:8]]), rng.permutation(4000)
    best = similarity.Nearest(queries, 5)
    tracemalloc.start()
    for at in range(0, 4000, 1000):
        best.add(ids[at : at + 1000], own[at : at + 1000])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    q, r, score = best.held
    assert peak < 40 * similarity.CELLS
    exact = np.einsum("ik,jk->ij", queries, own)
    for i in range(len(queries)):
        assert r[q == i].tolist() == ids[np.lexsort((ids, -np.round(exact[i], 12)))[:5]].tolist()
    assert sorted(np.bincount(q)) == [5] * 300


def test_a_task_gives_k_rows_a_query_over_all_its_batches(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)], "id long, embedding array<double>").coalesce(1)
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "q")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        seen = []
        plain = similarity.stored
        similarity.stored = lambda df, name: seen.append((name, out := plain(df, name))) or out
        similarity.nearest_of_each(queries, rows, 3, "q", "id", block=2).count()
    finally:
        similarity.stored = plain
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(t.count() for name, t in seen if name == "near") == 3 * 4
