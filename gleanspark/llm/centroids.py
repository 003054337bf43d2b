"""Centroid clustering (Lloyd's rounds in exact integers) by partial-distance search.

Squared differences are added up over the dimensions of highest variance first.
A centroid whose sum so far is above the current best whole distance is given up;
the others are followed through all dimensions. Sums are integers, so that no
order of rows or tasks changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import discard, stored

#: Components beyond this have squared distances beyond a long.
MOST = 1 << 27
#: Dimensions added up between two looks at which centroids are given up.
STEP = 8
ROWS = 4096


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has so many components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def grid(vector: Column, scale: int) -> Column:
    """Each component x as the integer floor(scale * x), x as double; beyond ``MOST`` an error."""
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))
    odd = F.exists(vector, lambda x: F.abs(x.cast("double")) * float(scale) > float(MOST - 1))
    return F.when(odd, F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}"))).otherwise(F.transform(cells, lambda x: x.cast("int")))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(rows: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equals the smaller number.

    ``order`` lists the dimensions, the most telling first.
    """
    x, c = rows[:, order], centroids[:, order]
    n, k, width = len(x), len(c), x.shape[1]
    head = min(STEP, width)
    # Sums of squares over the first dimensions, for all pairs of a row and a centroid.
    sums = ((x[:, None, :head] - c[None, :, :head]) ** 2).sum(axis=2)
    guess = sums.argmin(axis=1)
    best = ((x - c[guess]) ** 2).sum(axis=1)
    row, which = np.nonzero(sums <= best[:, None])
    partial = sums[row, which]
    for at in range(head, width, STEP):
        part = slice(at, at + STEP)
        partial = partial + ((x[row, part] - c[which, part]) ** 2).sum(axis=1)
        going = partial <= best[row]
        row, which, partial = row[going], which[going], partial[going]
    # What is left has whole distances: the least, then the smaller number.
    last = np.lexsort((which, partial, row))
    first = last[np.flatnonzero(np.diff(row[last], prepend=-1))]
    return which[first], partial[first]


def sums_of(table: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """One row for each cluster that a task met: (``cluster``, ``n``, ``sums``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = matrix(batch.column("v").slice(start, ROWS))
                found, _ = nearest(rows, centroids, order)
                counts += np.bincount(found, minlength=k)
                np.add.at(sums, found, rows)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return table.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")


def spread_of(table: DataFrame, dimensions: int) -> np.ndarray:
    """The dimensions by falling variance, from one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            rows = matrix(batch.column("v")).astype(np.float64)
            n, sums, squares = n + len(rows), sums + rows.sum(axis=0), squares + (rows * rows).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.float64())), pa.array([squares], pa.list_(pa.float64()))], ["n", "sums", "squares"])

    parts = table.select("v").mapInArrow(run, "n long, sums array<double>, squares array<double>")
    told = parts.agg(F.sum("n"), *(F.sum(F.col(c)[d]) for c in ("sums", "squares") for d in range(dimensions))).first()
    n, values = told[0] or 1, np.array([x or 0.0 for x in told[1:]])
    return np.argsort(-(values[dimensions:] / n - (values[:dimensions] / n) ** 2), kind="stable")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dimensions: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``) of every usable vector.

    Vectors with another number of components than ``dimensions``, or with a null or
    non-finite one, and null vectors are left out. The others become integers
    (floor of ``scale`` times the component). The first centroids are the ``k``
    vectors of smallest sha256 of ``<seed>:<key>``; after each of ``rounds``
    assignments every centroid with vectors becomes their floored mean, and one
    without stays; then vectors are assigned once more. Ties go to the smaller number.

    A null key hashes as ``null``; of rows of one key the one with the smaller vector
    comes first as a centroid; repeated rows count each. With fewer than ``k`` usable
    vectors there are as many centroids; with none the result is empty. A component
    whose integer is beyond 2**27 is an error, as distances would pass a long.
    Other columns are not returned. The driver holds ``k`` centroids; tasks send
    one sum for each of them.
    """
    kept = vectors.where(usable(F.col(f"`{vector}`"), dimensions)).select(F.col(f"`{key}`").alias("id"), grid(F.col(f"`{vector}`"), scale).alias("v"))
    table = stored(kept, "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    centroids = [tuple(r["v"]) for r in table.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    key_type = vectors.schema[key].dataType
    columns = f"`{key}` {key_type.simpleString()}, cluster int, distance long"
    if not centroids:
        return table.select(F.col("id").alias(key), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    order = spread_of(table, dimensions)
    for _ in range(rounds):
        own = sums_of(table, np.array(centroids, dtype=np.int64), order)
        new = own.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dimensions))).collect()
        for r in new:
            centroids[r["cluster"]] = tuple(r[f"s{d}"] // r["n"] for d in range(dimensions))
    final = np.array(centroids, dtype=np.int64)
    schema = pa.schema([(key, to_arrow_type(key_type)), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                found, distance = nearest(matrix(rows.column("v")), final, order)
                yield pa.RecordBatch.from_arrays([rows.column("id").cast(schema.field(0).type), pa.array(found, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    assigned = stored(table.select("id", "v").mapInArrow(run, columns), "assigned")
    discard(table)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    of_cluster = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select(f"`{key}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every usable vector of ``embeddings`` in one of 40 clusters after five rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(rounds: int = 5) -> str:
    """The same with all distances whole; floored means by integer division of a sum without its remainder."""
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM kept QUALIFY k < 40)",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{i} AS (SELECT vec_id, v, min(d) AS d, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, v, k, {distance} AS d FROM kept, c{i}) GROUP BY vec_id, v)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT k, list(m ORDER BY j) AS c FROM (SELECT k, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j) GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT k, coalesce(s.c, o.c) AS c FROM c{i} o LEFT JOIN s{i} s USING (k))")
    last = f"SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
