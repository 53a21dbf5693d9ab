"""Byte-level BPE encoding and decoding.

Texts are split into pieces by the tokenizer's pattern; those pieces that a worker has
not met yet are arrays of bytes over which the ranked merges are folded, all of a block
side by side: each round looks every neighbouring pair up in the rank map and merges, in each piece,
the pair of least rank (of equals, the leftmost). A piece that is itself in the map is
its own id at once. Ids are then dealt out to the places where the pieces stand;
decoding concatenates the binary pieces of the ids.

fold_column() is the same fold by Spark's higher-order functions with a literal rank
map; it gives the same ids, and takes some 300 microseconds for a distinct piece (see
the README), so encode() uses the vectorised fold.

Null and empty texts have no ids and decode to an empty text. Text and ids of any
length are whole; repeated rows are each encoded. Extra columns stay, but for those whose names the
result needs.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from loomstat.llm.common import table, text_slices, tidy, utf8, without
from loomstat.llm.pieces import PieceTable, gather

NO_RANK = 2**31 - 1
#: Bytes of text whose distinct pieces are folded together.
BLOCK_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> dict[bytes, int]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name))


class Merges:
    """The rank map in the form that the vectorised fold looks up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        keys, merged = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32)
        bits = max(4, int(np.ceil(np.log2(len(pairs) + 1))) + 2)
        self.shift = np.uint64(64 - bits)
        place = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        order = np.argsort(place, kind="stable")
        self.keys, self.merged, place = keys[order], merged[order], place[order]
        self.begin = np.searchsorted(place, np.arange((1 << bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.begin).max()) if len(pairs) else 0
        self.keys = np.append(self.keys, np.zeros(self.longest + 1, np.uint64))
        self.merged = np.append(self.merged, np.full(self.longest + 1, NO_RANK, np.int32))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        order = sorted(ranks, key=ranks.get)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        lengths[[ranks[t] for t in order]] = [len(t) for t in order]
        self.token_cut = np.r_[0, np.cumsum(lengths)]
        self.token_bytes = np.frombuffer(b"".join(order), np.uint8)
        self.pieces = PieceTable(self.fold)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        at, end = self.begin[place], self.begin[place + 1]
        out = np.full(len(key), NO_RANK, np.int32)
        for _ in range(self.longest):
            out = np.where((at < end) & (self.keys[at] == key), self.merged[at], out)
            at = at + 1
        return out

    def fold(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and where each piece's begin (one more at the end)."""
        known = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        length = np.array([len(p) for p in pieces], np.int64)
        todo = np.flatnonzero((known < 0) & (length > 0))
        counts = np.where(known >= 0, 1, 0)
        owner = np.repeat(todo, length[todo])
        ids = self.single[np.frombuffer(b"".join([pieces[k] for k in todo.tolist()]), np.uint8)]
        done_owner, done_ids = [np.flatnonzero(known >= 0)], [known[known >= 0]]
        # rank of each token with its right neighbour in the piece
        rank = np.full(len(ids), NO_RANK, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[first, len(ids)])
            least = np.minimum.reduceat(rank, first)
            open_ = least < NO_RANK
            if not open_.all():  # pieces that are finished leave
                stay = np.repeat(open_, lengths)
                done_owner.append(owner[~stay])
                done_ids.append(ids[~stay])
                ids, owner, rank, lengths, least = ids[stay], owner[stay], rank[stay], lengths[open_], least[open_]
                if not len(ids):
                    break
                first = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]  # leftmost of each piece
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            moved = hits - np.arange(len(hits))  # each piece before lost one token
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            last = len(ids) - 1
            right = np.minimum(moved + 1, last)
            has_right = (moved < last) & (owner[right] == owner[moved])
            rank[moved] = np.where(has_right, self.rank(ids[moved], ids[right]), NO_RANK)
            left = np.maximum(moved - 1, 0)
            has_left = (moved > 0) & (owner[left] == owner[moved])
            rank[left[has_left]] = self.rank(ids[left[has_left]], ids[moved[has_left]])
        owner, ids = np.concatenate(done_owner), np.concatenate(done_ids)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(pieces)) if len(owner) else counts
        return ids[order], np.r_[0, np.cumsum(counts)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of text one after another, and where each row's begin (one more at the end)."""
        return self.pieces.encode(raw, offsets)

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids one after another, and where each row's begin."""
        raw, begin = gather(self.token_bytes, self.token_cut, ids)
        return raw, begin[cut]


def encode(docs: DataFrame, ranks: dict[bytes, int], name: str = "token_ids") -> DataFrame:
    """docs with an array of ids of each whole text."""
    docs = without(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        merges = _merges(shared)
        for part in text_slices(batches, limit=BLOCK_BYTES):
            ids, cut = merges.encode(*utf8(part.column("text")))
            column = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields]).add(name, ArrayType(IntegerType())))


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """tokens with the bytes that the ids stand for."""
    tokens = without(tokens, name)
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        merges = _merges(shared)
        for batch in batches:
            column = batch.column(ids)
            flat, cut = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(_sizes(column))]
            for a, b in _stretches(cut):
                raw, at = merges.decode(flat[cut[a] : cut[b]], cut[a : b + 1] - cut[a])
                whole = raw.tobytes()
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([whole[x:y] for x, y in zip(at, at[1:])], pa.binary())], names=[*part.schema.names, name])

    return tokens.mapInArrow(tidy(run), StructType([*tokens.schema.fields]).add(name, BinaryType()))


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _stretches(cut: np.ndarray, limit: int = 1 << 20):
    at, n = 0, len(cut) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + limit, side="right")) - 1)
        yield at, to
        at = to


_CACHE: dict[int, Merges] = {}


def _merges(shared) -> Merges:
    """One table for each worker process and map."""
    ranks = shared.value
    key = hash((len(ranks), zlib.crc32(b"".join(sorted(ranks, key=ranks.get)))))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Merges(ranks)
    return _CACHE[key]


def fold_column(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a binary column of single pieces, by higher-order functions over byte arrays and a literal rank map."""
    n = 1 << max(1, len(ranks).bit_length())
    buckets: list[dict[str, int]] = [{} for _ in range(n)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        buckets[zlib.crc32(key.encode()) % n][key] = rank
    literal = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")
    look = lambda k: F.coalesce(F.get(literal, (F.crc32(k.cast("binary")) % n).cast("int"))[k], F.lit(NO_RANK))
    let = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    node = lambda p, r: F.struct(p.alias("p"), r.alias("r"))

    def merge(state, _):
        def at(pos):
            def joined(q):
                after, before = F.get(state, pos + 1), F.get(state, pos - 2)
                own = F.array(node(q, F.when(after.isNull(), NO_RANK).otherwise(look(F.concat(q, after.p)))))
                head = F.when(pos < 2, F.slice(state, 1, 0)).otherwise(F.concat(F.slice(state, F.lit(1), pos - 2), F.array(node(before.p, look(F.concat(before.p, q))))))
                return F.concat(head, own, F.slice(state, pos + 2, F.size(state)))

            return let(F.concat(F.get(state, pos - 1).p, F.get(state, pos).p), joined)

        return F.when(F.array_min(state.r) == NO_RANK, state).otherwise(let(state.r, lambda r: let(F.array_position(r, F.array_min(r)).cast("int"), at)))

    def body(h):
        size = (F.length(h) / 2).cast("int")
        start = F.transform(F.sequence(F.lit(1), size), lambda i: node(F.substring(h, 2 * i - 1, F.lit(2)), F.when(i < size, look(F.substring(h, 2 * i - 1, F.lit(4)))).otherwise(NO_RANK)))
        return F.when(look(h) < NO_RANK, F.array(look(h))).otherwise(F.transform(F.aggregate(F.sequence(F.lit(1), size), start, merge).p, look))

    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(let(F.hex(word), body))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], ids: str | None = "token_ids") -> DataFrame:
    """docs with n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (the bytes decoded
    from the ids) and the ids, if a name is given for them; in one pass and one worker a task."""
    docs = without(docs, "n_tokens", "ids_sha256", "decoded_sha256", *([ids] if ids else []))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        merges = _merges(shared)
        for part in text_slices(batches, limit=BLOCK_BYTES):
            flat, cut = merges.encode(*utf8(part.column("text")))
            raw, at = merges.decode(flat, cut)
            own = flat.astype("<u4")
            columns = [pa.array(np.diff(cut)), _digests(own, cut), _digests(raw, at)]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *schema.names[len(part.schema.names) :]])

    schema = StructType([*docs.schema.fields]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    schema = schema.add(ids, ArrayType(IntegerType())) if ids else schema
    return docs.mapInArrow(tidy(run), schema)


def _digests(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string())


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the texts decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_ranks(), ids=None).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
