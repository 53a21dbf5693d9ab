"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are code points, lower-cased, everything but letters as space; n-grams
of 1 to 3 are hashed to 2 ** BITS places. A feature is the share of the text's
n-grams times the inverse document frequency. The weights come from
follow-the-regularised-leader with elastic-net penalties on at most SAMPLE_ROWS
rows, those of least hash of doc_id (a documented bound); every fifth of them is
kept out to fit the temperature. Every text is scored in full.

A null text, or one without a letter, is `und` with score 0; so is every text if
there was no row to learn from. Null lang is not learned from. Ties go to the
language that sorts first. Columns lang_pred and score are replaced, others kept. Rows
of one doc_id are learned from each with its own text and language, equal rows once. A
null doc_id is not held out, and not learned from. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import fold_remainder, grams, per_row, row_sums, table, text_slices, tidy, utf8, without

#: Most rows that the model learns from.
SAMPLE_ROWS = 8_000
BITS = 17
SIZES = (1, 2, 3)
#: Features are shares of a text's n-grams; this puts them near 1.
SCALE = 100.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.05, 2
#: Code points whose case and kind are looked up; higher ones count as letters.
_PLANE = 0x30000


def _letters() -> np.ndarray:
    table = np.zeros(_PLANE, np.uint32)
    for c in range(_PLANE):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: list[np.ndarray] = []


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and rows of every n-gram, and which rows have a letter."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    rows = np.searchsorted(offsets, np.flatnonzero(lead), side="right") - 1
    if len(points) != len(rows):  # not UTF-8: row by row
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    low = np.where(points < _PLANE, _LETTERS[0][np.minimum(points, _PLANE - 1)], points)
    has = np.bincount(rows[low > 0], minlength=len(offsets) - 1) > 0
    keep = (low > 0) | np.r_[True, (low[:-1] > 0) | (rows[1:] != rows[:-1])] if len(low) else low > 0  # one space stands for a run
    low, rows = low[keep].astype(np.uint64), rows[keep]
    found = [grams(low, rows, n) for n in SIZES]
    places = np.concatenate([h for h, _, _ in found]) >> np.uint64(64 - BITS)
    return places.astype(np.int64), np.concatenate([r for _, r, _ in found]), has


def counted(places: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the places and their shares."""
    both, times = np.unique(rows.astype(np.int64) << BITS | places, return_counts=True)
    cut, at = per_row(both >> BITS, n), both & ((1 << BITS) - 1)
    return [(at[a:b], times[a:b] / max(1, times[a:b].sum())) for a, b in zip(cut, cut[1:])]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (places x labels, idf included), biases, temperature from (places, shares, label)."""
    n_places = 1 << BITS
    held = [e for i, e in enumerate(examples) if i % 5 == 4]
    own = [e for i, e in enumerate(examples) if i % 5 != 4] or examples
    seen = np.zeros(n_places)
    for places, _, _ in own:
        seen[places] += 1
    idf = SCALE * np.log((1 + len(own)) / (1 + seen))
    z, n = np.zeros((n_places + 1, n_labels)), np.zeros((n_places + 1, n_labels))

    def weights(at):
        zs = z[at]
        l1 = np.where(at == n_places, 0.0, L1)[:, None]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for places, shares, label in own:
            at, x = np.append(places, n_places), np.append(shares * idf[places], 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    w = weights(np.arange(n_places + 1))
    bias, w = w[-1], w[:-1] * idf[:, None]
    temperature = 1.0
    if held:
        logits = np.stack([shares @ w[places] + bias for places, shares, _ in held])
        truth = np.array([e[2] for e in held])
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.1, 10, 61), key=loss))
    return w, bias, temperature


def sample(docs: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """At most so many of (doc_id, text, lang), those of least hash of doc_id; drawn from keys, so that only the sample's texts move."""
    keyed = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("_text"))
    keys = ["doc_id", "lang", "_text"]
    chosen = keyed.select(*keys).orderBy(F.xxhash64("doc_id"), *keys).limit(most)
    return keyed.join(F.broadcast(chosen), keys, "left_semi").dropDuplicates(keys).select("doc_id", "text", "lang")


def fit(labelled: DataFrame) -> dict | None:
    """Model from a bounded table (doc_id, text, lang); one task sees it. None without a text with letters."""
    def train(batches):
        got = []
        for part in text_slices(batches):
            raw, offsets = utf8(part.column("text"))
            places, rows, has = features(raw, offsets)
            for key, lang, ok, (p, s) in zip(part.column("key").to_pylist(), part.column("lang").to_pylist(), has, counted(places, rows, part.num_rows)):
                if ok:
                    got.append((key, lang, p.astype(np.int32), s.astype(np.float32)))
        if not got:
            return
        got.sort(key=lambda x: (x[0], x[1], x[2].tobytes()))
        langs = sorted({lang for _, lang, _, _ in got})
        w, bias, t = learn([(p.astype(np.int64), s.astype(np.float64), langs.index(y)) for _, y, p, s in got], len(langs))
        kept = np.flatnonzero(np.any(w != 0, axis=1))
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.r_[kept, -1, -2], pa.int64()), "weights": pa.array([*w[kept].tolist(), bias.tolist(), [t] * len(langs)], pa.list_(pa.float64())), "langs": pa.array([None] * (len(kept) + 1) + [langs], pa.list_(pa.string()))})

    got = labelled.where("lang is not null").withColumn("key", F.xxhash64("doc_id")).repartition(1).mapInArrow(tidy(train), "place long, weights array<double>, langs array<string>").collect()
    if not got:
        return None
    langs = next(r.langs for r in got if r.langs)
    special = {r.place: r.weights for r in got if r.place < 0}
    kept = sorted((r.place, r.weights) for r in got if r.place >= 0)
    return {"langs": langs, "places": np.array([k for k, _ in kept], np.int64), "weights": np.array([w for _, w in kept], np.float32).reshape(-1, len(langs)), "bias": np.array(special[-1]), "temperature": special[-2][0]}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred and score; whole texts, every row."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = without(docs, "lang_pred", "score")
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        where = np.zeros(1 << BITS, np.int32)
        where[m["places"]] = np.arange(1, len(m["places"]) + 1)
        weights = np.vstack([np.zeros((1, len(m["langs"])), np.float32), m["weights"]])
        for part in text_slices(batches):
            raw, offsets = utf8(part.column("text"))
            places, rows, has = features(raw, offsets)
            total = np.maximum(np.bincount(rows, minlength=part.num_rows), 1)
            at = where[places]
            hit = at > 0
            logits = row_sums(weights[at[hit]], rows[hit], part.num_rows) / total[:, None] + m["bias"]
            p = _softmax(logits / m["temperature"])
            best = p.argmax(1)
            names = [m["langs"][k] if ok else "und" for k, ok in zip(best, has)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.where(has, p[np.arange(len(p)), best], 0.0), pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sample(docs.where("lang is not null").where(fold_remainder(F.col("doc_id"), 4) != 2)))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
