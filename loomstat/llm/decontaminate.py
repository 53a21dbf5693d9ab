"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits (A-Z as a-z) and bytes over 127; in scripts
without spaces each character is a word.
Shared seeds, runs of MIN_MATCH words found by Karp-Rabin hashes rolling over all
words of a document, join documents to benchmark items. Seeds on one diagonal make up
the longest matches of a pair: only meetings of equal seeds whose neighbours differ,
where matches start and end, are written out, so repetitive texts give as many as they
have diagonals. The longest match, confirmed word by word (128 bits, 64 of each of two
unlike hash families), whose words are free in both texts is marked as a tile, again and again (ties: first
in the item, then first in the document), matches that lost words to a tile are cut
to what is free, and those under MIN_MATCH words go. The tiles' share of an item's
words is its coverage, in whatever order the passages stand in the document; a
document is contaminated by an item with a coverage of THRESHOLD or more.

The items' words are broadcast in portions of at most PORTION_WORDS words (a longer
item goes alone), one pass over the documents for each portion.

An item of under MIN_MATCH words is its own seed: a text with all of them in a row has a
coverage of 1. Null texts and texts without words match nothing. Repeated
items and documents are reported one by one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import alphanumeric, grams, per_row, span_hashes, table, text_slices, tidy, utf8, word_spans

MIN_MATCH = 5
THRESHOLD = 0.5
PORTION_WORDS = 1_000_000
#: Bits of the filter that most words' seeds stop at.
_FILTER_BITS = 22
# First and last code points of scripts that put no spaces between words (Thai and Lao, Burmese, Khmer, kana, Han).
SPACELESS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def words_at(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of each word."""
    starts, ends, rows = word_spans(raw, offsets, alphanumeric())
    at = np.flatnonzero(raw >= 0xE0)
    if not len(at):
        return starts, ends, rows
    size = np.where(raw[at] < 0xF0, 3, 4)
    code = raw[at].astype(np.int64) & np.where(size == 3, 15, 7)
    for k in range(1, 4):
        code = np.where(k < size, code << 6 | raw[np.minimum(at + k, len(raw) - 1)] & 63, code)
    alone = np.zeros(len(at), bool)
    for first, last in SPACELESS:
        alone |= (code >= first) & (code <= last)
    at, past = at[alone], (at + size)[alone]
    if not len(at):
        return starts, ends, rows
    begun, over = np.unique(np.r_[starts, at, past[~np.isin(past, ends)]]), np.unique(np.r_[ends, past, at[~np.isin(at, starts)]])
    return begun, over, np.searchsorted(offsets, begun, side="right") - 1


def tiles(doc: np.ndarray, item: np.ndarray, at: np.ndarray, of: np.ndarray, size: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, doc position, length) of word arrays whose longest matches start at (at, of) and have those sizes.

    Words are rows of their two hashes; a match is compared word by word before it is marked."""
    queue = [(-int(n), int(q), int(p)) for n, q, p in zip(size, of, at)]
    heapq.heapify(queue)
    free_doc, free_item, out = np.ones(len(doc), bool), np.ones(len(item), bool), []
    while queue:
        n, q, p = heapq.heappop(queue)
        free = free_item[q : q - n] & free_doc[p : p - n]
        if free.all():
            free = (item[q : q - n] == doc[p : p - n]).reshape(-n, -1).all(1)
            if free.all():
                free_item[q : q - n] = free_doc[p : p - n] = False
                out.append((q, p, -n))
                continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                heapq.heappush(queue, (-int(b - a), q + int(a), p + int(a)))
    return out


def _neighbours(seeds: np.ndarray, rows: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed before and after each one of its text; none at the text's ends."""
    before, after = np.full(len(seeds), none, np.uint64), np.full(len(seeds), none, np.uint64)
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    before[inner + 1], after[inner] = seeds[inner], seeds[inner + 1]
    return before, after


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges, and which range it is of."""
    size = end - begin
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner


class Portion:
    """Words and seeds of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = ids
        classes = alphanumeric()
        raw, offsets = utf8(pa.array(texts, pa.large_string()))
        starts, ends, rows = words_at(raw, offsets)
        words = span_hashes(raw, starts, ends, classes.to)
        self.words, self.check, self.cut = words, span_hashes(raw, starts, ends, classes.to, other=True), per_row(rows, len(ids))
        seeds, item, at = grams(words, rows, MIN_MATCH)
        seeds = np.maximum(seeds, 2)
        self.known, rank = np.unique(np.r_[np.uint64(1), seeds], return_inverse=True)
        rank = rank[1:].astype(np.int64)
        #: seeds in order of (seed, the one before it) and of (seed, the one after it)
        self.sides = []
        for near in _neighbours(seeds, item, 1):
            key = rank << 32 | np.searchsorted(self.known, near)
            order = np.argsort(key, kind="stable")
            self.sides.append((key[order], item[order], at[order]))
        #: seeds of the items of so few words, in order, and the items
        self.short, sizes = {}, np.diff(self.cut)
        for n in range(1, MIN_MATCH):
            if (sizes == n).any():
                key, own, _ = grams(words, rows, n)
                key, own = key[sizes[own] == n], own[sizes[own] == n]
                order = np.argsort(key, kind="stable")
                self.short[n] = key[order], own[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def _edges(self, side: int, rank: np.ndarray, near: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Meetings (row, item, diagonal, doc word, item word; sorted) of equal seeds whose neighbours on that side differ: where matches start or end."""
        keys, item, of = self.sides[side]
        own = np.minimum(np.searchsorted(self.known, near), len(self.known) - 1)
        # a neighbour that no item has differs from all
        own = np.where(self.known[own] == near, own, (1 << 32) - 1)
        low, high = np.searchsorted(keys, rank << 32), np.searchsorted(keys, (rank + 1) << 32)
        alike, past = np.searchsorted(keys, rank << 32 | own), np.searchsorted(keys, rank << 32 | own, side="right")
        where, owner = (np.concatenate(x) for x in zip(_spread(low, alike), _spread(past, high)))
        found = np.stack([row[owner], item[where], at[owner] - of[where], at[owner], of[where]])
        return found[:, np.lexsort((found[3], found[2], found[1], found[0]))]

    def _whole(self, words: np.ndarray, check, rows: np.ndarray):
        """(row, item index, number of words) of items of under MIN_MATCH words that stand in a row; check() gives the words' other hashes."""
        for n, (keys, own) in self.short.items():
            key, row, at = grams(words, rows, n)
            where, owner = _spread(np.searchsorted(keys, key), np.searchsorted(keys, key, side="right"))
            if len(where):
                item, at, other = own[where], at[owner], check()
                same = np.ones(len(item), bool)
                for k in range(n):
                    same &= (self.words[self.cut[item] + k] == words[at + k]) & (self.check[self.cut[item] + k] == other[at + k])
                for r, i in np.unique(np.stack([row[owner][same], item[same]], 1), axis=0):
                    yield int(r), int(i), n

    def matches(self, raw: np.ndarray, offsets: np.ndarray):
        """(row, item index, coverage, tiles, longest tile) for pairs that share a seed."""
        classes = alphanumeric()
        starts, ends, rows = words_at(raw, offsets)
        words = span_hashes(raw, starts, ends, classes.to)
        check = functools.cache(lambda: span_hashes(raw, starts, ends, classes.to, other=True))
        for r, k, n in self._whole(words, check, rows):
            yield r, k, 1.0, 1, n
        seeds, seed_rows, at = grams(words, rows, MIN_MATCH)
        seeds = np.maximum(seeds, 2)
        hit = np.flatnonzero(self.filter[seeds >> np.uint64(64 - _FILTER_BITS)])
        rank = np.minimum(np.searchsorted(self.known, seeds[hit]), len(self.known) - 1)
        same = self.known[rank] == seeds[hit]
        hit, rank = hit[same], rank[same].astype(np.int64)
        if not len(hit):
            return
        before, after = _neighbours(seeds, seed_rows, 0)
        begun = self._edges(0, rank, before[hit], seed_rows[hit], at[hit])
        ended = self._edges(1, rank, after[hit], seed_rows[hit], at[hit])
        size = ended[3] - begun[3] + MIN_MATCH
        row, item = begun[0], begun[1]
        first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0)])
        begin = per_row(rows, len(offsets) - 1)
        for a, b in zip(first, [*first[1:], len(row)]):
            r, k = int(row[a]), int(item[a])
            doc, own = slice(begin[r], begin[r + 1]), slice(self.cut[k], self.cut[k + 1])
            found = tiles(np.stack([words[doc], check()[doc]], 1), np.stack([self.words[own], self.check[own]], 1), begun[3, a:b] - begin[r], begun[4, a:b] - self.cut[k], size[a:b])
            if found:
                yield r, k, sum(n for _, _, n in found) / (own.stop - own.start), len(found), max(n for _, _, n in found)


def portions(items: DataFrame):
    """Items in portions of bounded size, each collected when its turn comes."""
    sized = items.select("item_id", "text", (F.length("text") / 2 + F.length(F.regexp_replace("text", r"[\x{0}-\x{DFF}]+", "")) / 2 + 1).alias("most_words")).where("text is not null")
    total = sized.agg(F.sum("most_words")).first()[0] or 0
    n = int(-(-total // PORTION_WORDS))
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Portion([r.item_id for r in rows], [r.text for r in rows])


def overlaps(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile of pairs with that coverage or more."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long"
    out = spark.createDataFrame([], schema)
    for portion in portions(items):
        shared = spark.sparkContext.broadcast(portion)

        def run(batches, shared=shared):
            p = shared.value
            for part in text_slices(batches):
                ids = part.column("doc_id").to_pylist()
                found = [(ids[r], p.ids[k], c, n, longest) for r, k, c, n, longest in p.matches(*utf8(part.column("text"))) if c >= threshold]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())]))

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(tidy(run), schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that no item contaminates, as they are; rows do not move."""
    for portion in portions(items):
        shared = docs.sparkSession.sparkContext.broadcast(portion)

        def run(batches, shared=shared):
            for part in text_slices(batches):
                clean = np.ones(part.num_rows, bool)
                for r, _, c, _, _ in shared.value.matches(*utf8(part.column("text"))):
                    clean[r] &= c < threshold
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents, each with the items that they hold."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
