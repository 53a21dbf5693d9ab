"""Vectorised splitting of texts into the pieces of the byte-level BPE pattern, and a table of known pieces.

The pattern is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each code point has one of four kinds (letter, number, white space, other). Pieces
are runs of a kind, with three additions: a space before a run of another kind than
white space goes to that run, the last white-space character before a run stands
alone otherwise, and an apostrophe alone before s, t, re, ve, m, ll or d, where no
space is taken in before it, makes a piece with them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Unicode's White_Space.
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _KINDS:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
                table[a:b] = kind
        table[list(_SPACES)] = SPACE
        _KINDS.append(table)
    return _KINDS[0]


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of UTF-8 rows start; pieces do not cross rows."""
    if not len(raw):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    c = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _kinds()[c]
    n = len(c)
    row_first = np.zeros(n, bool)
    row_first[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    run = row_first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    row_last = np.r_[row_first[1:], True]
    blank = c == 0x20
    # a run's first character whose predecessor (same row) is white space; a space goes along, other white space stands alone
    entered = run & ~row_first
    after_space = np.zeros(n, bool)
    after_space[1:] = (kind[:-1] == SPACE) & entered[1:]
    takes = np.zeros(n, bool)
    takes[1:] = after_space[1:] & blank[:-1]
    start = run & ~takes
    shift = np.flatnonzero(after_space)
    start[shift - 1] = True
    # contractions
    tick = np.flatnonzero((c == 0x27) & run & ~takes & ~row_last)
    tick = tick[kind[tick + 1] == LETTER]
    if len(tick):
        row_of = np.cumsum(row_first)
        second = c[tick + 1]
        two = np.minimum(tick + 2, n - 1)
        third = np.where((tick + 2 < n) & (row_of[two] == row_of[tick]), c[two], 0)
        one = np.isin(second, [ord(x) for x in "stmd"])
        pair = ((second == ord("r")) & (third == ord("e"))) | ((second == ord("v")) & (third == ord("e"))) | ((second == ord("l")) & (third == ord("l")))
        length = np.where(one, 1, np.where(pair, 2, 0))
        tick, length = tick[length > 0], length[length > 0]
        start[tick + 1] = False
        past = tick + 1 + length
        inside = past < n
        past = past[inside]
        start[past] = True
    return at[start]


def safe_cuts(raw: np.ndarray, limit: int) -> list[int]:
    """Offsets that cut a long text into parts of about limit bytes, each at a space between ASCII letters, where a piece starts in any case."""
    if len(raw) <= 2 * limit:
        return [0, len(raw)]
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    places = np.flatnonzero((raw[1:-1] == 0x20) & letter[raw[:-2]] & letter[raw[2:]]) + 1
    cuts = [0]
    while len(raw) - cuts[-1] > limit and (i := int(np.searchsorted(places, cuts[-1] + limit))) < len(places):
        cuts.append(int(places[i]))
    return [*cuts, len(raw)]


#: Longest piece, in bytes, that two 64-bit words hold whole, with its length.
SHORT = 15
_BITS = 21
_HEAD = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(SHORT + 1)], np.uint64)
_TAIL = np.array([(1 << 8 * max(k - 8, 0)) - 1 for k in range(SHORT + 1)], np.uint64)


class PieceTable:
    """Ids of pieces, asked for once for each distinct piece and kept.

    Pieces are told apart by their bytes: up to SHORT bytes stand whole in two words, which a
    hash only places in the table; longer ones are keys of a dict. Past MOST pieces, or
    MOST_BYTES of long ones, the table starts afresh, so its size is bounded."""

    MOST, MOST_BYTES, CHUNK, SEGMENT = 1_000_000, 16 << 20, 1 << 19, 2 << 20

    def __init__(self, ids_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.ids_of = ids_of
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(1 << _BITS, np.int32)  # 0: free
        self.head, self.tail = np.zeros(1 << 12, np.uint64), np.full(1 << 12, 1 << 63, np.uint64)
        self.cut, self.ids = np.zeros((1 << 12) + 1, np.int64), np.zeros(1 << 13, np.int32)
        self.n, self.n_ids = 1, 0  # number 0 stands for no piece
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def _add(self, texts: list[bytes], head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Numbers of new distinct pieces."""
        ids, cut = self.ids_of(texts)
        n, m = self.n + len(texts), self.n_ids + len(ids)
        if n > len(self.head):
            more = max(n, 2 * len(self.head)) - len(self.head)
            self.head, self.tail, self.cut = np.r_[self.head, np.zeros(more, np.uint64)], np.r_[self.tail, np.zeros(more, np.uint64)], np.r_[self.cut, np.zeros(more, np.int64)]
        if m > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(m, 2 * len(self.ids)) - len(self.ids), np.int32)]
        self.head[self.n : n], self.tail[self.n : n] = head, tail
        self.cut[self.n + 1 : n + 1] = self.n_ids + cut[1:]
        self.ids[self.n_ids : m] = ids
        numbers = np.arange(self.n, n, dtype=np.int32)
        self.n, self.n_ids = n, m
        return numbers

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        which = np.zeros(len(starts), np.int32)
        size = ends - starts
        long = np.flatnonzero(size > SHORT)
        if len(long):
            texts = [raw[a:b].tobytes() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            new = [t for t in dict.fromkeys(texts) if t not in self.long]
            if new:
                none = np.zeros(len(new), np.uint64)
                self.long.update(zip(new, self._add(new, none, none + np.uint64(1 << 63)).tolist()))
                self.long_bytes += sum(map(len, new))
            which[long] = [self.long[t] for t in texts]
        own = np.flatnonzero(size <= SHORT) if len(long) else np.arange(len(size))
        if not len(own):
            return which
        a, size = starts[own], size[own]
        # unaligned words; the caller pads raw
        words = np.ndarray(len(raw) - 7, np.dtype("<u8"), buffer=raw, strides=(1,))
        head, tail = words[a] & _HEAD[size], words[a + 8] & _TAIL[size]
        tail |= size.astype(np.uint64) << np.uint64(56)
        slot = head * np.uint64(0x9E3779B97F4A7C15) ^ tail * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = ((slot ^ slot >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _BITS)).astype(np.int64)
        missing, open_ = [], np.arange(len(own))
        found = np.zeros(len(own), np.int32)
        while len(open_):
            at = slot[open_]
            number = self.slots[at]
            same = (self.head[number] == head[open_]) & (self.tail[number] == tail[open_])
            found[open_[same]] = number[same]
            missing.append(open_[number == 0])
            open_ = open_[~same & (number != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << _BITS) - 1)
        missing = np.concatenate(missing)
        if len(missing):
            order = missing[np.lexsort((tail[missing], head[missing]))]
            first = np.r_[True, (head[order[1:]] != head[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]])]
            new = order[first]
            whole = raw.tobytes()
            numbers = self._add([whole[x : x + k] for x, k in zip(a[new].tolist(), size[new].tolist())], head[new], tail[new])
            found[order] = numbers[np.cumsum(first) - 1]
            slot, todo = slot[new], np.arange(len(new))
            while len(todo):
                free = self.slots[slot[todo]] == 0
                self.slots[slot[todo[free]]] = numbers[todo[free]]
                todo = todo[self.slots[slot[todo]] != numbers[todo]]
                slot[todo] = (slot[todo] + 1) & ((1 << _BITS) - 1)
        which[own] = found
        return which

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 rows one after another, and where each row's begin (one more at the end)."""
        if len(offsets) == 2 and len(cuts := safe_cuts(raw, self.SEGMENT)) > 2:  # a very long text, part by part
            parts = [self.encode(raw[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])]
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)])
        starts = piece_starts(raw, offsets)
        ends = np.r_[starts[1:], len(raw)] if len(starts) else starts
        padded = np.r_[raw, np.zeros(16, np.uint8)]
        ids, counts = [np.zeros(0, np.int32)], []
        for i in range(0, len(starts), self.CHUNK):
            if self.n > self.MOST or self.long_bytes > self.MOST_BYTES:
                self.clear()
            which = self._numbers(padded, starts[i : i + self.CHUNK], ends[i : i + self.CHUNK])
            found, begin = gather(self.ids, self.cut, which)
            ids.append(found)
            counts.append(np.diff(begin))
        begin = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
        return np.concatenate(ids), begin[np.searchsorted(starts, offsets)]


def gather(values: np.ndarray, cut: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[cut[k]:cut[k+1]] for k in which; also where each begins (one more at the end)."""
    from_ = cut[which]
    lengths = cut[which + 1] - from_
    begin = np.r_[0, np.cumsum(lengths)]
    at = np.arange(begin[-1]) + np.repeat(from_ - begin[:-1], lengths)
    return values[at], begin
