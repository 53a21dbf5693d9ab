"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters and digits (A-Z as a-z) and of bytes over 127.
Features are the presence of words, of their stems (first 4, 5 and 6 bytes of longer
words, so that inflected forms count together), of pairs of neighbours and of pairs with
one word between. Training takes at most SAMPLE_ROWS labelled rows, those of least
hash of doc_id (a documented bound; all of them if there are fewer), on one
executor; scoring reads every text in full. L1 leaves few weights, at most one
for each of 2 ** BITS places, so the weights' size is bounded.

Null and empty texts have no features and get the score of the bias. Null labels
are not learned from; without any labelled row every score is 0.5. Repeated rows
count as often as they stand there, within the bound. A null doc_id has no label and is
not held out; it is scored as any other. Texts of any length are read whole. Extra columns are ignored by the query and
kept by score(), which replaces one that has its own name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import alphanumeric, fold_remainder, grams, mix, per_row, row_sums, span_hashes, table, text_slices, tidy, utf8, without, word_spans

#: Most labelled rows that the model learns from.
SAMPLE_ROWS = 12_000
#: Hashed places: 2 ** BITS.
BITS = 20
#: What a text has a feature for: a character of a word.
WORD = r"[A-Za-z0-9\u0080-\x{10FFFF}]"
#: Lengths in bytes of the stems that stand beside a word.
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 5


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows of every word, stem, pair and skip-pair."""
    classes = alphanumeric()
    starts, ends, rows = word_spans(raw, offsets, classes)
    words = span_hashes(raw, starts, ends, classes.to)
    found = [(words, rows), grams(words, rows, 2)[:2], grams(words, rows, 2, step=2)[:2]]
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        found.append((mix(span_hashes(raw, starts[long], starts[long] + k, classes.to) + np.uint64(k)), rows[long]))
    places = np.concatenate([h for h, _ in found]) >> np.uint64(64 - BITS)
    return places.astype(np.int64), np.concatenate([r for _, r in found])


def presence(places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of a row once."""
    both = np.unique(rows.astype(np.int64) << BITS | places)
    return both & ((1 << BITS) - 1), both >> BITS


def ftrl(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with weights, their weights and the bias, learned from (places, label) in the order given."""
    n_places = 1 << BITS
    z, n = np.zeros(n_places + 1), np.zeros(n_places + 1)

    def weights(at):
        s, zs = np.sign(z[at]), z[at]
        free = np.where(at == n_places, 0.0, L1)  # the bias has no penalty
        return np.where(np.abs(zs) <= free, 0.0, -(zs - s * free) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for places, label in examples:
            at = np.append(places, n_places)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(n_places + 1))
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most so many rows, those of least hash of doc_id; of one doc_id by what else they hold."""
    rest = [F.xxhash64(c) for c in labelled.columns if c != "doc_id"]
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id", *rest).limit(rows)


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from (doc_id, text, toxic): places, weights, bias. One task sees the bounded sample."""
    def train(batches):
        got = []
        for part in text_slices(batches):
            raw, offsets = utf8(part.column("text"))
            places, at = presence(*features(raw, offsets))
            cut = per_row(at, part.num_rows)
            ids, labels = part.column("doc_id").to_pylist(), part.column("toxic").to_pylist()
            got += [(key, place, label) for key, place, label in zip(part.column("key").to_pylist(), (places[cut[i] : cut[i + 1]].astype(np.int32) for i in range(len(ids))), labels)]
        got.sort(key=lambda x: (x[0], x[2], x[1].tobytes()))
        if not got:
            return
        kept, w, bias = ftrl([(p.astype(np.int64), y) for _, p, y in got])
        yield pa.RecordBatch.from_pydict({"place": np.append(kept, -1), "weight": np.append(w, bias)})

    chosen = sample(labelled.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), rows)
    keyed = chosen.withColumn("key", F.xxhash64("doc_id")).repartition(1)
    model = keyed.mapInArrow(tidy(train), "place long, weight double").collect()
    bias = [m.weight for m in model if m.place < 0]
    model = sorted((m.place, m.weight) for m in model if m.place >= 0)
    return np.array([m[0] for m in model], np.int64), np.array([m[1] for m in model], np.float64), bias[0] if bias else 0.0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "toxic_score") -> DataFrame:
    """docs with a column of scores from 0 to 1; whole texts, every row."""
    from pyspark.sql.types import DoubleType, StructType

    docs, (kept, w, bias) = without(docs, name), model
    shared = docs.sparkSession.sparkContext.broadcast((kept, w.astype(np.float64), bias))

    def run(batches):
        kept, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[kept] = w
        for part in text_slices(batches):
            raw, offsets = utf8(part.column("text"))
            places, rows = features(raw, offsets)
            hit = np.flatnonzero(dense[places])
            places, rows = presence(places[hit], rows[hit])
            margin = bias + row_sums(dense[places], rows, part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], names=[*part.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: a label on a document outside the held-out fold (crc32 of doc_id mod 5 = 0)."""
    marks = labels.where(fold_remainder(F.col("doc_id"), 5) != 0).where("toxic in (0, 1)").select("doc_id", "toxic")
    # the sample is drawn from the labels alone, so that only its texts move
    return docs.select("doc_id", "text").join(F.broadcast(sample(marks)), "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", F.coalesce(fold_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
