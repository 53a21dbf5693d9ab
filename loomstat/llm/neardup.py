"""Near-duplicate documents by MinHash and odd sketches.

Words are runs of bytes other than space and 9 to 13, with A-Z as a-z; a document's
set are its distinct shingles of `words` words (the whole sequence if it has fewer).
Shingles are told apart by 128 bits, 64 of each of two unlike hash families.
Documents of equal sets are one class. Each class gets HASHES MinHash samples. Bands
of ROWS of them give candidates: classes that share a band are joined to the band's
smallest member, and the connected parts of that graph are clusters. Two sets of
similarity 0.8 share none of the BANDS bands with a probability of about 1e-6.
A cluster is compared in blocks of bounded size: odd sketches (parity bitmaps of the
samples, SKETCH_BITS long) estimate each pair by the bits of their XOR, and only pairs
below CUT differing bits (a pair of similarity 0.8 lies above with a probability of
about 1e-9) that are not yet connected are counted exactly on their full sets. What
leaves a task are the confirmed links of a spanning forest, so a group of n copies
gives about n rows. Connected components are found by large-star and small-star
rounds.

Documents without words (null, empty or white text) have an empty set and are linked
with nothing. A null doc_id is never a component's id; its row is kept unless its set
is that of a document with an id. Repeated doc_ids with equal sets collapse to one component as any copies
do; every input row gives a row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import checkpoint, drop_shuffles, grams, mix, nonspace, per_row, release, span_hashes, table, text_slices, tidy, utf8, word_spans

HASHES, BANDS, ROWS, SKETCH_BITS, CUT = 512, 48, 6, 1024, 266
#: Most classes and shingles of a block; two blocks meet in a task.
BLOCK_CLASSES, BLOCK_SHINGLES = 2_048, 4_000_000

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_PICK = np.stack([_rng.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, ascending in each row: their hashes of two unlike families, and row offsets."""
    n = len(offsets) - 1
    classes = nonspace()
    starts, ends, rows = word_spans(raw, offsets, classes)
    count = np.bincount(rows, minlength=n)
    begin = np.cumsum(count) - count
    both = []
    for other, base in ((False, 0xD6E8FEB86659FD93), (True, 0xA0761D6478BD642F)):
        hashes = span_hashes(raw, starts, ends, classes.to, other)
        h, at, _ = grams(hashes, rows, words, base=base)
        found = [(h, at)]
        for k in range(1, words):  # short documents: the whole sequence
            short = np.flatnonzero(count == k)
            if len(short):
                h = np.full(len(short), k * 31 + 1, np.uint64)
                for i in range(k):
                    h = h * np.uint64(base) + hashes[begin[short] + i]
                found.append((mix(h), short))
        both.append(np.concatenate([f[0] for f in found]))
    h, g = both
    rows = np.concatenate([f[1] for f in found])
    order = np.lexsort((h, rows))
    h, g, rows = h[order], g[order], rows[order]
    same = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    if (same & (g[1:] != g[:-1])).any():  # unlike shingles of one hash
        order = np.lexsort((g, h, rows))
        h, g, rows = h[order], g[order], rows[order]
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (rows[1:] == rows[:-1])
    keep = np.r_[np.ones(min(len(h), 1), bool), ~same]
    h, g, rows = h[keep], g[keep], rows[keep]
    return h, g, per_row(rows, n)


def numbered(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A number for each pair of hashes, the same for equal pairs."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(g, g[first][which]):
        which = np.unique(np.stack([h, g], 1), axis=0, return_inverse=True)[1].ravel()
    return which


def minhashes(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Samples (rows x HASHES) of rows that all have shingles."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(cut) - 1, HASHES), np.uint32)
    t, u = np.empty_like(x), np.empty_like(x)
    starts = cut[:-1]
    for i in range(HASHES):
        np.bitwise_xor(x, _FLIP[i], out=t)
        np.multiply(t, _TIMES[i], out=t)
        np.right_shift(t, 15, out=u)
        np.bitwise_xor(t, u, out=t)
        out[:, i] = np.minimum.reduceat(t, starts)
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches: each sample flips one bit."""
    n = len(samples)
    where = mix(samples.astype(np.uint64) << np.uint64(16) | np.arange(HASHES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    flips = np.bincount((where.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(bool).reshape(n, SKETCH_BITS), axis=1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.empty((len(samples), BANDS), np.uint64)
    for b, pick in enumerate(_PICK):
        key = np.full(len(samples), b + 1, np.uint64)
        for i in pick:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, i].astype(np.uint64))
        out[:, b] = key
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set fingerprint (f1, f2), band keys and sketch (null for empty sets)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        for part in text_slices(batches):
            n = part.num_rows
            h, g, cut = shingle_sets(*utf8(part.column("text")), words)
            size = np.diff(cut)
            full = np.flatnonzero(size)
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands, bits = [None] * n, [None] * n
            if len(full):
                starts = cut[full]
                f1[full] = np.add.reduceat(mix(h), starts)
                f2[full] = np.add.reduceat(mix(g), starts)
                samples = minhashes(h, np.r_[starts, len(h)])
                keys, odd = band_keys(samples).view(np.int64), sketches(samples)
                for at, k, s in zip(full, keys, odd):
                    bands[at], bits[at] = k, s.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")


#: Edges of a partition between rounds; fewer partitions mean fewer files of each round.
EDGES_PER_PARTITION = 200_000


def components(edges: DataFrame) -> DataFrame:
    """v, component (smallest vertex reachable) for the vertices of edges (u, v), by large-star and small-star rounds."""
    context = edges.sparkSession.sparkContext
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
        parts = max(context.defaultParallelism, -(-now[0] // EDGES_PER_PARTITION))
        e = e.coalesce(parts)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = checkpoint(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(small.coalesce(parts))
        drop_shuffles(context)
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(e.select("v", F.col("v").alias("component")).distinct())


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            far = self.up[self.up]
            if np.array_equal(far, self.up):
                return far
            self.up = far

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)


def confirmed(ids: np.ndarray, sets: list[bytes], bits: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs with 100 * intersection >= percent * union.

    With rows of two blocks only pairs across them count; each block has its own task."""
    n = len(ids)
    pairs = [np.frombuffer(s, np.uint64).reshape(2, -1) for s in sets]
    size = np.array([s.shape[1] for s in pairs])
    numbers = numbered(*np.concatenate(pairs, axis=1)) if n else np.zeros(0, np.int64)
    cut = np.r_[0, np.cumsum(size)]
    seen = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, bool)
    forest, links, two = _Forest(n), [], block.max() != block.min()
    wide = bits.view(np.uint64)
    for a in range(n - 1):
        others = np.arange(a + 1, n)
        if two:
            others = others[block[others] != block[a]]
        small, large = np.minimum(size[a], size[others]), np.maximum(size[a], size[others])
        others = others[100 * small >= percent * large]
        if len(others):
            others = others[np.bitwise_count(wide[others] ^ wide[a]).sum(1) <= CUT]
        if len(others):
            others = others[forest.roots()[others] != forest.root(a)]
        if not len(others):
            continue
        own = numbers[cut[a] : cut[a + 1]]
        seen[own] = True
        lengths = size[others]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(cut[others], lengths)
        both = np.add.reduceat(seen[numbers[at]].astype(np.int64), np.cumsum(lengths) - lengths)
        seen[own] = False
        for b in others[100 * both >= percent * (size[a] + lengths - both)]:
            x, y = forest.root(a), forest.root(int(b))
            if x != y:
                forest.up[y] = x
                links.append((int(ids[a]), int(ids[b])))
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    if percent < 80:
        raise ValueError("bands and sketches are laid out for a similarity of 80 percent or more")
    signed = checkpoint(signatures(docs, words))
    own = ["f1", "f2", "n_shingles"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(full.groupBy(*own).agg(F.min("doc_id").alias("rep")))
    chosen = checkpoint(full.join(classes.select("rep", *[F.col(c).alias("of_" + c) for c in own]), (F.col("doc_id") == F.col("rep")) & (F.col("f1") == F.col("of_f1")) & (F.col("f2") == F.col("of_f2")))
                        .dropDuplicates(["rep", "f1", "f2"]).select("rep", "n_shingles", "bands", "sketch"))
    keys = chosen.select("rep", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    near = keys.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    cluster = checkpoint(components(near).withColumnRenamed("v", "rep").withColumnRenamed("component", "cluster"))
    sized = cluster.join(chosen.select("rep", "n_shingles", "sketch"), "rep")
    blocks = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = sized.join(blocks, "cluster").select("rep", "cluster", "sketch", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))

    def with_sets(batches):
        for part in text_slices(batches):
            h, g, cut = shingle_sets(*utf8(part.column("text")), words)
            sets = pa.array([h[a:b].tobytes() + g[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets], names=[*names, "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    sets = texts.join(placed, "rep").mapInArrow(tidy(with_sets), "rep long, cluster long, sketch binary, blocks int, block int, shingles binary")
    meet = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        links = confirmed(group.column("rep").to_numpy(), group.column("shingles").to_pylist(), np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(group.num_rows, -1), group.column("block").to_numpy(), percent) if group.num_rows > 1 else []
        if group.num_rows > 100:
            release()
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    links = meet.select("rep", "cluster", "i", "j", "block", "sketch", "shingles").groupBy("cluster", "i", "j").applyInArrow(compare, "u long, v long")
    found = components(links).withColumnRenamed("v", "rep")
    labelled = classes.join(found, "rep", "left").select(*own, F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", *own).join(labelled, own, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.col("component").isNull()).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group of near duplicates: that of the smallest doc_id.

    Of rows with the same doc_id one stays. Rows without a doc_id stay."""
    named = docs.where("doc_id is not null")
    kept = near_duplicates(named, words, percent).where("kept").select("doc_id").distinct()
    return named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.where("doc_id is null"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3])) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM p JOIN s su ON su.doc_id = u JOIN s sv ON sv.doc_id = v WHERE 100 * n >= 80 * (len(su.sh) + len(sv.sh) - n)
), r AS (
  SELECT doc_id, doc_id AS c FROM s UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
