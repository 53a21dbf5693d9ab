"""Helpers shared by the corpus operators: tables, checkpoints, Arrow batches, vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at once; a longer text goes alone.
SLICE_BYTES = 1 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one is set in local mode, as in tests, and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_shuffles(context) -> None:
    """Let Spark remove the files of rounds that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    context._jvm.System.gc()


def tidy(run):
    """A batch function that gives its memory back when it ends: Spark keeps idle Python workers."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (case aside): what an operator adds replaces them."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken]) if any(c.lower() in taken for c in df.columns) else df


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores until no column is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_remainder(column, divisor: int):
    """crc32 of a key written as text, modulo divisor."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets (rows + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def text_slices(batches, name: str = "text", limit: int = SLICE_BYTES):
    """Split Arrow batches so that each part has at most limit bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class ByteClasses:
    """Which bytes belong to words, and the byte that each counts as (A-Z as a-z)."""

    def __init__(self, word: np.ndarray):
        self.word = word
        self.to = np.arange(256, dtype=np.uint8)
        self.to[65:91] += 32


def nonspace() -> ByteClasses:
    """Words are runs of bytes other than space and 9 to 13."""
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return ByteClasses(word)


def alphanumeric() -> ByteClasses:
    """Words are runs of ASCII letters, digits and bytes of other scripts."""
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return ByteClasses(word)


def word_spans(raw: np.ndarray, offsets: np.ndarray, classes: ByteClasses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of each word; words do not cross rows."""
    inside = classes.word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][(offsets[1:] > 0) & (np.diff(offsets) > 0)] - 1
    last[ends] = inside[ends]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_STEP, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, to: np.ndarray, other: bool = False) -> np.ndarray:
    """64-bit hash of each byte span: the sum of its 8-byte words, each mixed with its place, mixed with the length.

    other: of another family, sums of products of half words (plus keys of their place). Spans
    that differ and agree in both are not expected among 2 ** 64 of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(to, raw, out=low[: len(raw)])
    words = np.ndarray(len(raw) + 1, np.dtype("<u8"), buffer=low, strides=(1,))
    lengths = ends - starts
    count = (lengths + 7) >> 3
    if count.max() == 1:
        place, word, firsts = np.ones(1, np.uint64), words[starts] & _BYTES[lengths], None
    else:
        firsts = np.cumsum(count) - count
        k = np.arange(int(count.sum())) - np.repeat(firsts, count)
        word = words[np.repeat(starts, count) + 8 * k] & _BYTES[np.minimum(np.repeat(lengths, count) - 8 * k, 8)]
        place = (k + 1).astype(np.uint64)
    if other:
        key = mix(place * _LENGTH)
        half = np.uint64(0xFFFFFFFF)
        part = ((word & half) + (key & half) & half) * ((word >> np.uint64(32)) + (key >> np.uint64(32)) & half)
        part += part >> np.uint64(32)
    else:
        part = mix(word + place * _STEP)
    return mix((part if firsts is None else np.add.reduceat(part, firsts)) + lengths.astype(np.uint64) * _LENGTH)


def words_of(raw: np.ndarray, offsets: np.ndarray, classes: ByteClasses) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    starts, ends, rows = word_spans(raw, offsets, classes)
    return span_hashes(raw, starts, ends, classes.to), rows


def grams(hashes: np.ndarray, rows: np.ndarray, n: int, step: int = 1, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word's index of each n-gram of words (or skip-gram, with step over 1)."""
    reach = (n - 1) * step
    count = len(hashes) - reach
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, rows.dtype), np.zeros(0, np.int64)
    out = np.full(count, n * 31 + step, np.uint64)
    for i in range(n):
        out = out * np.uint64(base) + hashes[i * step : i * step + count]
    keep = np.flatnonzero(rows[:count] == rows[reach:])
    return mix(out[keep]), rows[keep], keep


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of each row's stretch in an ascending row array."""
    return np.searchsorted(rows, np.arange(n + 1))


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of values (one or two axes) for each row, zeros for rows without values."""
    if values.ndim == 1:
        return np.bincount(rows, weights=values, minlength=n)[:n]
    return np.stack([np.bincount(rows, weights=values[:, k], minlength=n)[:n] for k in range(values.shape[1])], 1)
