"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

Ids are cut into blocks of BLOCK_IDS. Each block starts afresh and has its own CRC-32.
Each id's distribution mixes three predictions: order 2 and order 1 each count the id
that mostly follows the two ids, or the one id, before (a slot for each hash of a
context; a miss halves the count, and a new id takes the slot when it runs out), and
order 0 counts all ids of the block up to the last power of two of them. A prediction
weighs by its count and by a share that follows how often its order was right in the
block; what orders 2 and 1 both predict gets both weights. Ids that order 0 has not
seen go by a fixed distribution that falls with the id. Frequencies are integers of a
total of 2 ** TOTAL_BITS, and drive a range coder with a range of 48 bits and words of
16. The blocks of a payload are coded side by side, one array element for each.

A payload has at most BLOCK_IDS * LANES ids, whatever the length of a document: magic,
header length, header (JSON: doc ids, counts of ids, number of the first document in
its part, whether the first and the last go on from or in the next payload, block size,
vocabulary, bytes and CRC of each block), CRC of the header, coded blocks. Payloads are
rows of a Parquet table (part, seq, before, n_ids, payload), so that Spark's commit
protocol writes each once, whatever executors are lost.

Ids must be below MOST_IDS; others raise. Null and empty texts are documents of no ids
but the end id. Documents stand in ascending order of doc_id, null first; rows of one
doc_id follow each other by the length of their text, and may be dealt to several tasks.
A very long text is tokenised in parts that start where a piece starts in any case.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import shared_folder, table, text_slices, tidy, utf8
from loomstat.llm.pieces import PieceTable

MAGIC = b"LMCX2\n"
BLOCK_IDS, LANES = 2_048, 4_096
MOST_IDS = 1 << 20
#: Contexts of an order and block; ids after which its share is set anew; ids before the first counts of order 0.
SLOTS, WINDOW, FIRST = 1 << 8, 32, 32
TOTAL_BITS, RARE_BITS = 20, 22
_TOTAL, _LOW = 1 << TOTAL_BITS, (1 << 32) - 1
#: A slot is id << 6 | count.
_EMPTY = MOST_IDS << 6
#: What a prediction of that count weighs, of 1,024.
_TRUST = np.array([0, *(1000 * n // (n + 1) + 23 for n in range(1, 64))], np.int32)
_PLACE = BLOCK_IDS - 1
#: Lanes that are sorted at a time.
_STRIP = 256


@functools.lru_cache(16)
def _rare(size: int) -> np.ndarray:
    """Bounds (size + 1) of the distribution of unseen ids, of 2 ** RARE_BITS."""
    w = 1 / (np.arange(size) + 30.0)
    return np.r_[0, np.cumsum(np.floor(w / w.sum() * ((1 << RARE_BITS) - size)).astype(np.int64) + 1)]


class _Model:
    """Predictions for every lane; coder and decoder keep it in step. The first half of an array is order 2, the second order 1."""

    def __init__(self, lanes: int):
        n = self.n = lanes
        self.table = np.full(2 * n * SLOTS, _EMPTY, np.int32)
        self.base = np.arange(2 * n) * SLOTS
        self.at = self.base.copy()
        self.share, self.hits = np.full(2 * n, 300, np.int32), np.zeros(2 * n, np.int32)
        self.slot, self.ids, self.count, self.weight, self.hit, self._fresh = (np.empty(2 * n, np.int32) for _ in range(6))
        self.two, self.one, self.id2, self.id1 = self.weight[:n], self.weight[n:], self.ids[:n], self.ids[n:]
        self.right, self._more = np.empty(2 * n, bool), np.empty(2 * n, bool)
        self.ends, self.unit, self.rare, self._t = (np.zeros(n, np.int32) for _ in range(4))
        self.before, self._wide = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.bits, self.known, self.distinct = 0, np.zeros(n, np.int32), np.zeros(n, np.int32)

    def counted(self, t: int, distinct: np.ndarray) -> None:
        """Order 0 now has the first t ids of a block, of which so many are distinct; new ones should go on to come as they did."""
        new = np.minimum(980, (distinct - self.distinct) * 1300 // (t // 2 if self.bits else t) + 20)
        self.bits, self.known, self.distinct = t.bit_length() - 1, (1024 - new).astype(np.int32), distinct

    def predict(self) -> None:
        """Bounds of the next id's distribution: order 2's id has [0, two), order 1's up to `ends`, each id that
        order 0 counted `unit` a time, and what is left from `rare` is for all others."""
        np.take(self.table, self.at, out=self.slot, mode="clip")
        np.right_shift(self.slot, 6, out=self.ids)
        np.bitwise_and(self.slot, 63, out=self.count)
        w, t, two, one = self.weight, self._t, self.two, self.one
        np.take(_TRUST, self.count, out=w, mode="clip")
        w *= self.share
        w += 1
        np.subtract(_TOTAL, two, out=t)
        t >>= 10
        one >>= 10
        one *= t
        one += 1
        np.multiply(one, self.id2 == self.id1, out=t)
        two += t
        one -= t
        np.add(two, one, out=self.ends)
        if self.bits:
            np.subtract(_TOTAL, self.ends, out=self.unit)
            self.unit *= self.known
            self.unit >>= 10 + self.bits
            np.left_shift(self.unit, self.bits, out=self.rare)
            self.rare += self.ends
        else:
            self.rare[:] = self.ends

    def learn(self, x: np.ndarray, t: int) -> None:
        n, hit, count, g, right, more, fresh = self.n, self.hit, self.count, self.slot, self.right, self._more, self._fresh
        np.equal(self.id2, x, out=right[:n])
        np.equal(self.id1, x, out=right[n:])
        hit[:] = right
        self.hits += hit
        # a hit counts one more, up to 63; a miss halves the count, and where none is left the new id takes the slot
        np.less(count, 63, out=more)
        more &= right
        g += more
        np.greater(count, 1, out=more)
        more |= right
        count >>= 1
        np.subtract(1, hit, out=hit)
        count *= hit
        g -= count
        np.left_shift(x, 6, out=fresh[:n])
        fresh[:n] |= 1
        fresh[n:] = fresh[:n]
        self.table[self.at] = np.where(more, g, fresh)
        if t % WINDOW == WINDOW - 1:
            self.share += (np.minimum(self.hits * (1500 // WINDOW), 1000) - self.share) >> 1
            np.clip(self.share, 16, 1000, out=self.share)
            self.hits[:] = 0
        wide, at = self._wide, self.at
        wide[:] = x
        np.add(self.before, wide, out=at[:n])
        at[n:] = wide
        at &= SLOTS - 1
        at += self.base
        np.multiply(wide, 40503, out=self.before)
        self.before >>= 3


def _snapshot(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the sorted (lanes x t) ids: id, first place and count of equal ids, packed; and distinct ids of each lane."""
    if len(ids) > _STRIP:
        parts = [_snapshot(ids[i : i + _STRIP]) for i in range(0, len(ids), _STRIP)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    h = np.sort(ids, axis=1)
    n, t = h.shape
    new = np.ones((n, t), bool)
    np.not_equal(h[:, 1:], h[:, :-1], out=new[:, 1:])
    begin = np.flatnonzero(new.ravel())
    size = np.diff(begin, append=n * t)
    packed = h.ravel()[begin].astype(np.int64) | (begin & (t - 1)) << 20 | size << 33
    return np.repeat(packed, size), np.add.reduce(new, axis=1, dtype=np.int32)


def _seen(ids: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the ids of (lanes x up to 2t) from t on: place in the sorted first t ids and count among them, by row of ids; and distinct ids of each lane's first t."""
    if len(ids) > _STRIP:
        parts = [_seen(ids[i : i + _STRIP], t) for i in range(0, len(ids), _STRIP)]
        return np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts], 1), np.concatenate([p[2] for p in parts])
    n, both = ids.shape
    key = np.sort(ids << 11 | np.arange(both, dtype=np.int32), axis=1)
    place = key & _PLACE
    key >>= 11
    new = np.ones(key.shape, bool)
    np.not_equal(key[:, 1:], key[:, :-1], out=new[:, 1:])
    old = place < t
    upto = np.cumsum(old, axis=1, dtype=np.int32)
    first = np.maximum.accumulate((upto - old) * new, axis=1)
    place += np.arange(n, dtype=np.int32)[:, None] * np.int32(both)
    out = np.empty(n * both, np.int32)
    out[place.ravel()] = (first << 12 | (upto - first)).ravel()
    out = np.ascontiguousarray(out.reshape(n, both)[:, t:].T)
    return out >> 12, out & 0xFFF, np.add.reduce(new & old, axis=1, dtype=np.int32)


def compress(ids: np.ndarray) -> tuple[list[bytes], list[int], int]:
    """Coded bytes and CRC of each block of ids, and the size of vocabulary that they were coded for."""
    if len(ids) and (ids.min() < 0 or ids.max() >= MOST_IDS):
        raise ValueError(f"ids must be from 0 to {MOST_IDS - 1:,}")
    n = -(-len(ids) // BLOCK_IDS)
    if not n:
        return [], [], 0
    crcs = [zlib.crc32(ids[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].astype("<u4").tobytes()) for i in range(n)]
    rows = min(BLOCK_IDS, len(ids))
    lanes = np.zeros(n * rows, np.int32)  # the last block is filled up with id 0
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(n, rows)
    grid = np.ascontiguousarray(lanes.T)
    size = 1 << max(10, int(ids.max()).bit_length())
    bounds, model = _rare(size), _Model(n)
    low, rng = np.zeros(n, np.int64), np.full(n, (1 << 48) - 1, np.int64)
    room = rows * 3 + 8
    out, at = np.zeros(n * room, np.int32), np.arange(n) * room
    for t in range(rows):
        x = grid[t]
        if t >= FIRST and t & (t - 1) == 0:
            first, counts, distinct = _seen(lanes[:, : 2 * t], t)
            model.counted(t, distinct)
            begin = t
        model.predict()
        two, one = model.two, model.one
        hit2 = model.id2 == x
        h2 = hit2.astype(np.int32)
        h1 = ((model.id1 == x) > hit2).astype(np.int32)
        fell = 1 - h2 - h1
        if model.bits:
            freq = counts[t - begin] * model.unit
            known = freq > 0
            start = np.where(known, model.ends + first[t - begin] * model.unit, model.rare)
            freq = np.where(known, freq, _TOTAL - model.rare)
            rare = fell > known
        else:
            start, freq, rare = model.rare.copy(), _TOTAL - model.rare, fell > 0
        start *= fell
        start += two * h1
        freq *= fell
        freq += two * h2
        freq += one * h1
        r = rng >> TOTAL_BITS
        low += start * r
        np.multiply(freq, r, out=rng)
        short = (rng <= _LOW).astype(np.int64)
        out[at] = low >> 32  # with a carry, which goes to the words before it at the end
        at += short
        low &= (short * -(1 << 32)) ^ -1
        short <<= 4
        low <<= short
        rng <<= short
        go = np.flatnonzero(rare)
        if len(go):
            r, y, to = rng.take(go) >> RARE_BITS, x.take(go), at.take(go)
            start = bounds.take(y)
            own = low.take(go) + start * r
            wide = (bounds.take(y + 1) - start) * r
            short = (wide <= _LOW).astype(np.int64)
            out[to] = own >> 32
            at[go] = to + short
            own &= (short * -(1 << 32)) ^ -1
            short <<= 4
            low[go] = own << short
            rng[go] = wide << short
        model.learn(x, t)
    for k in (32, 16, 0):
        out[at] = low >> k & (0xFFFF if k < 32 else -1)
        at += 1
    out = out.reshape(n, room)
    used = at - np.arange(n) * room
    out = out[:, : int(used.max())]
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += carry[:, 1:]
    words = out.astype(">u2")
    return [words[i, :k].tobytes() for i, k in enumerate(used.tolist())], crcs, size


def expand(blocks: list[bytes], crcs: list[int], count: int, size: int) -> np.ndarray:
    """The ids of blocks; a block whose CRC differs raises."""
    if not blocks:
        return np.zeros(0, np.int32)
    try:
        with np.errstate(all="ignore"):  # a damaged block may lead anywhere
            ids = _expand(blocks, count, size)
    except IndexError as error:
        raise ValueError("a block is damaged") from error
    for i, crc in enumerate(crcs):
        if zlib.crc32(ids[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return ids


def _expand(blocks: list[bytes], count: int, size: int) -> np.ndarray:
    n = len(blocks)
    rows = min(BLOCK_IDS, count)
    room = max(max(map(len, blocks)) // 2, 3) + 4
    data = np.zeros((n, room), np.int32)
    for row, b in zip(data, blocks):
        row[: len(b) // 2] = np.frombuffer(b, ">u2", len(b) // 2)
    code = data[:, 0].astype(np.int64) << 32 | data[:, 1].astype(np.int64) << 16 | data[:, 2]
    data, last = data.ravel(), n * room - 1
    at = np.arange(n) * room + 3
    rng = np.full(n, (1 << 48) - 1, np.int64)
    bounds, model = _rare(size), _Model(n)
    narrow = bounds.astype(np.int32)
    grid, lane = np.zeros((rows, n), np.int32), np.arange(n)
    for t in range(rows):
        if t >= FIRST and t & (t - 1) == 0:
            packed, distinct = _snapshot(grid[:t].T)
            model.counted(t, distinct)
            lane_at = lane << model.bits
        model.predict()
        two, one = model.two, model.one
        r = rng >> TOTAL_BITS
        v = (code / r).astype(np.int32)  # exact: both are under 2 ** 53, and the quotient's distance from an integer is over a rounding
        h2, fell = (v < two).astype(np.int32), (v >= model.ends).astype(np.int32)
        h1 = 1 - h2 - fell
        if model.bits:
            j = ((v - model.ends) * fell / np.maximum(model.unit, 1)).astype(np.int64)
            known = v < model.rare
            j *= known
            p = packed.take(j + lane_at)
            start = np.where(known, model.ends + (p >> 20 & 0x1FFF).astype(np.int32) * model.unit, model.rare)
            freq = np.where(known, (p >> 33).astype(np.int32) * model.unit, _TOTAL - model.rare)
            rare = fell > known
            x = (p & (MOST_IDS - 1)).astype(np.int32)
            x *= fell
        else:
            start, freq, rare, x = model.rare.copy(), _TOTAL - model.rare, fell > 0, np.zeros(n, np.int32)
        start *= fell
        start += two * h1
        freq *= fell
        freq += two * h2
        freq += one * h1
        x += model.id2 * h2
        x += model.id1 * h1
        code -= start * r
        np.multiply(freq, r, out=rng)
        short = (rng <= _LOW).astype(np.int64)
        word = data.take(at) * short
        at += short
        short <<= 4
        code <<= short
        code |= word
        rng <<= short
        go = np.flatnonzero(rare)
        if len(go):
            own, wide, of = code.take(go), rng.take(go), at.take(go)
            r = wide >> RARE_BITS
            y = np.minimum(np.searchsorted(narrow, (own / r).astype(np.int32), side="right") - 1, size - 1)
            start = bounds.take(y)
            own -= start * r
            wide = (bounds.take(y + 1) - start) * r
            short = (wide <= _LOW).astype(np.int64)
            word = data.take(np.minimum(of, last)) * short
            at[go] = of + short
            short <<= 4
            code[go] = own << short | word
            rng[go] = wide << short
            x[go] = y
        np.minimum(at, last, out=at)
        x &= MOST_IDS - 1  # damage must not lead out of the tables
        grid[t] = x
        model.learn(x, t)
    return np.ascontiguousarray(grid.T).ravel()[:count]


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, first: int = 0, goes_on: tuple[bool, bool] = (False, False)) -> bytes:
    blocks, crcs, size = compress(ids)
    header = json.dumps({"docs": doc_ids, "counts": counts, "first": first, "goes_on": goes_on, "block": BLOCK_IDS, "size": size, "bytes": list(map(len, blocks)), "crcs": crcs}, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, struct.pack("<I", zlib.crc32(header)), *blocks])


def unpack(payload: bytes) -> tuple[dict, np.ndarray]:
    """Header (docs, counts, first, goes_on) and all ids of a payload."""
    at = len(MAGIC)
    if payload[:at] != MAGIC:
        raise ValueError("not a payload")
    (size,) = struct.unpack_from("<I", payload, at)
    header = payload[at + 4 : at + 4 + size]
    if struct.unpack_from("<I", payload, at + 4 + size)[0] != zlib.crc32(header):
        raise ValueError("the header is damaged")
    h, at, blocks = json.loads(header), at + 8 + size, []
    if h["block"] != BLOCK_IDS:
        raise ValueError("blocks of another size")
    for n in h["bytes"]:
        blocks.append(payload[at : at + n])
        at += n
    return h, expand(blocks, h["crcs"], sum(h["counts"]), h["size"])


def _alphabet() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, np.uint32)
    out[seen] = seen
    hidden = np.flatnonzero(out == 0)
    out[hidden] = 256 + np.arange(len(hidden))
    return out


class _Tokenizer:
    """Ids of rows of text by the tokenizers library, which sees each distinct piece once in a worker."""

    #: Pieces of a text that the library gets.
    JOINED = 128

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            how = json.load(file)
        split = how.get("pre_tokenizer") or {}
        #: Byte-level with the pattern of pieces.py: only then are pieces coded apart.
        self.apart = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not how.get("normalizer") and not how.get("post_processor") and all(t["special"] for t in how.get("added_tokens", ()))
        if self.apart:
            self.own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.own.get_vocab()
            self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.size[i] = len(token)  # a character stands for a byte
            self.letters = _alphabet()
            self.letters[255] = 32  # stands in no UTF-8 text
            self.pieces = PieceTable(self._new)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        cut = np.r_[0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(cut[-1])), cut

    def _new(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, given to the library as words of the byte-level alphabet; the tokens' lengths tell which are whose."""
        said = [b"\xff".join(texts[i : i + self.JOINED]) for i in range(0, len(texts), self.JOINED)]
        ids, _ = self._batch([self.letters[np.frombuffer(t, np.uint8)].tobytes().decode("utf-32-le") for t in said])
        ends, at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), np.cumsum(self.size[ids])
        cut = np.searchsorted(at, ends) + 1
        if not np.array_equal(at[np.minimum(cut, len(at)) - 1], ends):
            raise ValueError("the vocabulary does not spell out all bytes")
        return ids, np.r_[0, cut]

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id, and counts."""
        if self.apart:
            ids, cut = self.pieces.encode(raw, offsets)
        else:
            whole = raw.tobytes()
            ids, cut = self._batch([whole[a:b].decode() for a, b in zip(offsets, offsets[1:])])
        counts = np.diff(cut) + 1
        out = np.full(int(counts.sum()), end_id, np.int32)
        body = np.ones(len(out), bool)
        body[np.cumsum(counts) - 1] = False
        out[body] = ids
        return out, counts


@functools.lru_cache(1)
def _tokenizer(path: str) -> _Tokenizer:
    """One for each worker process, whose pieces serve its later tasks too."""
    return _Tokenizer(path)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> None:
    """Encode texts and write payloads in ascending doc_id order: part, seq, before (ids before in the part), n_ids, payload."""
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
    most = BLOCK_IDS * LANES

    def run(batches):
        from pyspark import TaskContext

        known, part, seq, before = _tokenizer(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs_, counts, held, size, first, begun = [], [], [], 0, 0, False

        def payload(n: int):
            """The next n ids; a document that they cut goes on in the next payload."""
            nonlocal seq, before, docs_, counts, held, size, first, begun
            ids = np.concatenate(held)
            ends = np.cumsum(counts)
            k = int(np.searchsorted(ends, n))  # the last document with ids in it
            left = int(ends[k]) - n
            own = [*counts[:k], counts[k] - left]
            body = pack(docs_[: k + 1], own, ids[:n], first, (begun, left > 0))
            batch = pa.RecordBatch.from_arrays([*(pa.array([x]) for x in (part, seq, before, n)), pa.array([body], pa.binary())], schema=schema)
            done = k + (left == 0)
            docs_, counts = docs_[done:], ([left] if left else []) + counts[k + 1 :]
            held, size, seq, before, first, begun = [ids[n:]], size - n, seq + 1, before + n, first + done, left > 0
            return batch

        for slice_ in text_slices(batches):
            ids, lengths = known.encode(*utf8(slice_.column("text")), end_id)
            docs_ += slice_.column("doc_id").to_pylist()
            counts += lengths.tolist()
            held.append(ids)
            size += len(ids)
            while size >= most:
                yield payload(most)
        if size:
            yield payload(size)

    # the length lets rows of one doc_id go to several tasks
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"), "text")
    ordered = keyed.repartitionByRange("doc_id", "size").sortWithinPartitions("doc_id", "size").drop("size")
    ordered.mapInArrow(tidy(run), "part long, seq long, before long, n_ids long, payload binary").write.parquet(folder)


def _joined(pieces: list[dict]) -> int:
    """CRC-32 of the concatenation of stretches of n ids with those CRCs: a CRC is affine, so zeros in a stretch's place carry the one before over it."""
    crc = 0
    for p in pieces:
        zeros = bytes(4 * p["n_tokens"])
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ p["ids_crc32"]
    return crc


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.parquet(folder)
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).orderBy("part").collect()  # a row for each task that wrote
    offsets, at = {}, 0
    for r in totals:
        offsets[r.part] = at
        at += r.n
    shared = spark.sparkContext.broadcast(offsets)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, before = batch.column("part")[row].as_py(), batch.column("before")[row].as_py()
                h, ids = unpack(batch.column("payload")[row].as_py())
                cut = np.r_[0, np.cumsum(np.array(h["counts"], np.int64))]
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])]
                # documents that stand in several payloads have a key
                key = [None] * len(crcs)
                for i, cut_here in ((0, h["goes_on"][0]), (-1, h["goes_on"][1])):
                    if cut_here:
                        key[i] = f"{part}:{h['first'] + (i if i == 0 else len(crcs) - 1)}"
                yield pa.RecordBatch.from_arrays([pa.array(h["docs"], pa.int64()), pa.array(cut[:-1] + shared.value[part] + before), pa.array(np.diff(cut)), pa.array(crcs, pa.int64()), pa.array(key, pa.string())], names=["doc_id", "start", "n_tokens", "ids_crc32", "key"])

    rows = files.select("part", "before", "payload").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long, key string")

    def join(batches):
        for batch in batches:
            lists, out = batch.column("pieces").to_pylist(), []
            for pieces in lists:
                out.append((pieces[0]["doc_id"], pieces[0]["start"], sum(p["n_tokens"] for p in pieces), _joined(pieces) if len(pieces) > 1 else pieces[0]["ids_crc32"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row of its own for each document that one payload holds whole
    alone = F.coalesce("key", F.concat(F.lit("@"), F.col("start").cast("string")))
    pieces = rows.groupBy(alone.alias("key")).agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "n_tokens", "ids_crc32"))).alias("pieces"))
    return pieces.select("pieces").mapInArrow(tidy(join), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, count and CRC of ids, read back from the files."""
    import uuid

    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_documents(spark, folder)
