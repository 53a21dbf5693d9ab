"""Nearest vectors by additive quantisation.

A vector is the sum of one word from each of STAGES full-dimensional codebooks,
fitted on at most SAMPLE_ROWS vectors (those of least hash of vec_id): k-means on
residuals, then least squares over all codebooks at once with fresh beam-search
codes. Every vector is encoded by beam search and stored with two norms: the square of
its approximation's, and that of the error.

Search is by largest inner product, or by least Euclidean distance. Queries and
candidates are dealt into blocks by a hash of vec_id and vector; a task holds one block
of each and reads approximate scores off a table of query x word products (for distances
less half the stored square norm). A score may be off by MARGIN times the query's norm
times the error's norm (four standard deviations of a random direction in 256
dimensions, two in 64); all candidates of the block whose upper bound reaches the k-th
largest lower bound are scored exactly on the original vectors in double precision, with
no limit to their number, and the k best of the block go on (ties to the smaller
vec_id). Blocks bound the memory of a task; every query meets every block once, so the
work grows with queries x candidates.

Vectors that are null, zero, or hold null or non-finite components take no part, nor
do those whose length is not the most common one (of equals, the smaller). Rows of
the same vec_id are each a candidate. A query that stands there twice is asked once; two
vectors of one vec_id are two queries, each with its own ranks. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.llm.common import table, tidy

SAMPLE_ROWS = 8_192
STAGES, WORDS, BEAM, ROUNDS = 12, 256, 6, 1
#: Share of |query| x |error| by which an approximate score may be off.
MARGIN = 0.25
CANDIDATE_BLOCK, QUERY_BLOCK = 8_192, 2_048


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x stages) by beam search over |residual|^2."""
    n, (stages, words, _) = len(x), books.shape
    codes = np.zeros((n, 1, 0), np.int16)
    rest = x[:, None, :]
    for m in range(stages):
        b = books[m]
        cost = (rest**2).sum(-1)[..., None] - 2 * rest @ b.T + (b**2).sum(-1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, word = best // words, best % words
        at = np.arange(n)[:, None]
        rest = rest[at, parent] - b[word]
        codes = np.concatenate([codes[at, parent], word[..., None].astype(np.int16)], -1)
    return codes[np.arange(n), (rest**2).sum(-1).argmin(1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def _in_parts(x: np.ndarray, books: np.ndarray, rows: int = 2048) -> np.ndarray:
    return np.concatenate([encode(x[i : i + rows], books) for i in range(0, len(x), rows)]) if len(x) else np.zeros((0, len(books)), np.int16)


def fit_codebooks(x: np.ndarray, stages: int = STAGES, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (stages x words x dimensions) from a sample."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    rest, books = x.astype(np.float64), []
    for _ in range(stages):
        centres = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(8):
            own = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
            count = np.bincount(own, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, rest)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        own = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
        rest = rest - centres[own]
        books.append(centres)
    books = np.stack(books)
    for _ in range(ROUNDS):
        columns = _in_parts(x, books).astype(np.int64) + np.arange(stages) * words
        gram, right = np.zeros((stages * words, stages * words)), np.zeros((stages * words, x.shape[1]))
        for a in range(stages):
            np.add.at(right, columns[:, a], x)
            for b in range(stages):
                np.add.at(gram, (columns[:, a], columns[:, b]), 1.0)
        gram[np.diag_indices_from(gram)] += 0.5
        flat = books.reshape(-1, x.shape[1])
        books = (flat + np.linalg.solve(gram, right - (gram @ flat - 0.5 * flat))).reshape(books.shape)
    return books


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.forall("embedding", fine) & F.exists("embedding", lambda e: e != 0))
    width = v.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return v.where(F.size("embedding") == (width["width"] if width else 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, measure: str = "inner") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among all vectors of another vec_id.

    The score is the inner product, or for "euclidean" the distance."""
    if k < 1 or measure not in ("inner", "euclidean"):
        raise ValueError("k is positive, measure inner or euclidean")
    spark = vectors.sparkSession
    vectors, queries = usable(vectors), usable(queries).dropDuplicates(["vec_id", "embedding"])
    taught = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").collect()
    schema = "query_id long, asked long, vec_id long, score double"
    if not taught:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit_codebooks(np.array([r.embedding for r in taught], np.float64))
    shared = spark.sparkContext.broadcast(books)

    def add_codes(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                codes = _in_parts(x, shared.value)
                near = decode(codes, shared.value)
                norms, errors = (near**2).sum(1), np.sqrt(((x - near) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(errors)], names=[*batch.schema.names, "codes", "norm", "error"])

    coded = vectors.mapInArrow(tidy(add_codes), "vec_id long, embedding array<double>, codes binary, norm double, error double")
    n_candidates, n_queries = vectors.count(), queries.count()
    over, across = -(-n_candidates // CANDIDATE_BLOCK), max(1, -(-n_queries // QUERY_BLOCK))
    # rows of one vec_id spread too: a block is picked by the vector as well
    block = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    left = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("asked"), "embedding", block(across).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(over - 1))).alias("cb"))
    right = coded.select("vec_id", "embedding", "codes", "norm", "error", block(over).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("qb"))

    def nearest(qs: pa.Table, cs: pa.Table) -> pa.Table:
        books = shared.value
        out = [[], [], [], []]
        if qs.num_rows and cs.num_rows:
            ids = cs.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(cs.column("embedding"))[order]
            norm, error = cs.column("norm").to_numpy()[order], cs.column("error").to_numpy()[order]
            reach = MARGIN * error + 1e-9 * np.sqrt(norm)  # and roundings
            codes = np.frombuffer(b"".join(cs.column("codes").to_pylist()), np.int16).reshape(len(ids), -1)[order]
            query, asked, q = qs.column("query_id").to_numpy(), qs.column("asked").to_numpy(), _matrix(qs.column("embedding"))
            tables = np.einsum("qd,mwd->mqw", q, books)
            for i in range(len(q)):
                approx = tables[0, i][codes[:, 0]]
                for m in range(1, len(books)):
                    approx = approx + tables[m, i][codes[:, m]]
                if measure == "euclidean":
                    approx = approx - norm / 2
                off = np.sqrt((q[i] ** 2).sum()) * reach
                low = np.where(ids == query[i], -np.inf, approx - off)
                short = np.flatnonzero((approx + off >= np.partition(low, len(ids) - k)[len(ids) - k] if k < len(ids) else np.ones(len(ids), bool)) & (ids != query[i]))
                exact = (x[short] * q[i]).sum(1) if measure == "inner" else -np.sqrt(((x[short] - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[short], -exact))[:k]
                out[0].append(np.full(len(best), query[i]))
                out[1].append(np.full(len(best), asked[i]))
                out[2].append(ids[short[best]])
                out[3].append(exact[best])
        cat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({name: pa.array(c.astype(kind)) for name, c, kind in zip(("query_id", "asked", "vec_id", "score"), cat, (np.int64, np.int64, np.int64, np.float64))})

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(nearest, schema)
    rank = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    score = F.col("score") if measure == "inner" else -F.col("score")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), w AS (SELECT len(e) AS width FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), u AS (SELECT vec_id, e FROM v, w WHERE len(e) = width
), q AS (SELECT DISTINCT vec_id, e FROM u WHERE vec_id % 20 = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e AS asked, u.vec_id, list_inner_product(q.e, u.e) AS score FROM q JOIN u ON q.vec_id <> u.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
