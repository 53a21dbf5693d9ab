"""Personal data: fixed base patterns and a semi-Markov conditional random field that adds spans.

Base kinds are email, ip, card and phone: leftmost matches of each kind's pattern,
without overlap, of which those failing the kind's test are dropped. The field
looks at stretches of chunks that hold a digit or an @: each stretch is cut into
tokens, every run of at most MOST_TOKENS tokens is a candidate segment with features
of the whole span (shape, digits, checksum, octets, borders, cue word before it),
pairs of the last entity's type and the next one's have weights, and dynamic programming
over positions and last types picks the boundaries and types of the best segmentation
jointly. Entities have at most MOST_TOKENS tokens and MOST_CHARS characters; windows,
texts and the number of entities have no bound. Its spans are added where they meet no base span; besides the base kinds
it knows `secret` (keys and tokens). It is trained by maximum likelihood
(forward-backward over segmentations) on sentences made by examples().

Null and empty texts have no spans. Positions are code points, end exclusive. Every
row is kept, repeated ones and those of a null doc_id too; extra columns stay, but for
those whose names the result needs. Texts of any length are read whole, in time in
proportion to their length.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstat.llm.common import table, tidy, without

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Longest entity, in tokens and in characters.
MOST_TOKENS, MOST_CHARS = 16, 96

# The possessive runs and the guards before them match what the plain patterns match, without going over a long run again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each @: every start before it leads over the same @, so the leftmost is the run's first character."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- semi-Markov field ---

_HOT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_|\x20")
_CUE = re.compile(r"([^\W\d_]+)[^\w]{0,6}$")
_GROUPS = re.compile(r"[0-9]+|[^0-9]")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
CUES = frozenset(("token", "key", "secret", "password", "apikey", "api", "phone", "tel", "telephone", "call", "fax", "mobile", "card", "visa", "mastercard", "ip", "host", "server", "mail", "email"))
_DIMS = 1 << 12


def windows(text: str):
    """Stretches of neighbouring chunks (no white space inside) that hold a digit or an @."""
    m = _HOT.search(text)
    while m:
        start = m.start()
        while start > 0 and m.start() - start < MOST_CHARS and not text[start - 1].isspace():
            start -= 1
        end, hot = m.end(), m.end()
        while end < len(text):
            if text[end] == "\x20" and end - hot < MOST_CHARS:
                stop = end + 1
                while stop < len(text) and stop - end < MOST_CHARS and not text[stop].isspace():
                    stop += 1
                if not _HOT.search(text, end + 1, stop):
                    break
                end = hot = stop
            elif text[end].isspace() or end - hot >= MOST_CHARS:
                break
            else:
                hot = end + 1 if text[end].isdigit() or text[end] == "@" else hot
                end += 1
        yield start, end
        m = _HOT.search(text, max(end, m.end()))


def _buckets(span: str, before: str, after: str, cue: str, n_tokens: int) -> list[str]:
    """Features of a whole span."""
    digits = _NOT_DIGIT.sub("", span)
    out = [f"n{min(len(digits), 20)}", f"t{n_tokens}", "b" + before, "a" + after, "bias"]
    if cue:
        out.append("cue" + cue)
    if "@" in span:
        out.append("email" if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", span) else "at")
    elif all(c in "0123456789 +().-" for c in span):
        shape = "".join(str(len(g)) if g.isdigit() else g for g in _GROUPS.findall(span))
        out += ["numeric", "shape" + shape[:16]]
        if span.count("(") != span.count(")"):
            out.append("unbalanced")
        if span[0] == "+":
            out.append("plus")
        if 13 <= len(digits) <= 19:
            out.append("luhn" if luhn(digits) else "no-luhn")
        if span.count(".") == 3 and len(parts := span.split(".")) == 4 and all(p.isdigit() for p in parts):
            out.append("octets" if all(len(p) < 4 and int(p) < 256 for p in parts) else "no-octets")
    else:
        out.append("mixed" if span.isalnum() else "broken")
        if len(span) >= 20 and _HEX.fullmatch(span):
            out.append("hex")
        if len(span) >= 20 and span.isalnum() and digits and len(digits) < len(span):
            out.append("key")
    return out


def _place(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % _DIMS


@functools.lru_cache(1 << 16)
def _places(names: tuple[str, ...]) -> np.ndarray:
    return np.array([_place(n) for n in names], np.int64)


def _border(text: str, at: int) -> str:
    c = text[at : at + 1] if at >= 0 else ""
    return "^" if not c else "w" if c.isalnum() else "s" if c.isspace() else c


def lattice(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], Iterator[tuple[int, int, tuple[str, ...]]]]:
    """Tokens of a window, and one after another its candidate segments (first token, one past the last, features)."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    found = _CUE.search(text, max(0, start - 24), start)
    cue = found[1].lower() if found and found[1].lower() in CUES else ""

    def segments():
        for i, (a, _) in enumerate(tokens):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
                b = tokens[j - 1][1]
                if b - a > MOST_CHARS:
                    break
                if text[b - 1].isalnum() and _HOT.search(text, a, b):
                    names = _buckets(text[a:b], _border(text, a - 1), _border(text, b), cue, j - i)
                    yield i, j, tuple(names)

    return tokens, segments()


STATES = len(KINDS) + 1


class Field:
    """Weights of features (places x kinds) and of pairs (last kind or none x kind)."""

    def __init__(self, own: np.ndarray, pair: np.ndarray):
        self.own, self.pair = own, pair
        self.score = functools.lru_cache(1 << 15)(lambda features: own[_places(features)].sum(0))

    def __reduce__(self):
        return Field, (self.own, self.pair)


def best(n_tokens: int, segments, field: Field) -> list[tuple[int, int, int]]:
    """Segments (first, past, kind) of the best segmentation; segments come by ascending first token.

    A state is the kind of the last entity (0: none yet); a token outside of any entity scores 0 and
    keeps it, an entity scores its features as its kind and the pair of the last kind and its own."""
    top = np.full((n_tokens + 1, STATES), -np.inf)
    top[0, 0] = 0.0
    came, left = np.full((n_tokens + 1, STATES), -1, np.int32), np.zeros((n_tokens + 1, STATES), np.int8)
    at, step = -1, None
    for i, j, features in segments:
        while at < i:  # no segment ends there any more
            at += 1
            if at:
                stay = top[at - 1] >= top[at]
                top[at][stay], came[at][stay] = top[at - 1][stay], -1
            step = top[at][:, None] + field.pair
            last, step = step.argmax(0), step.max(0)
        total = step + field.score(features)
        for kind in np.flatnonzero(total > top[j, 1:]):
            top[j, kind + 1], came[j, kind + 1], left[j, kind + 1] = total[kind], i, last[kind]
    while at < n_tokens:
        at += 1
        if at:
            stay = top[at - 1] >= top[at]
            top[at][stay], came[at][stay] = top[at - 1][stay], -1
    out, j, state = [], n_tokens, int(top[n_tokens].argmax())
    while j > 0:
        i = int(came[j, state])
        if i < 0:
            j -= 1
        else:
            out.append((i, j, state - 1))
            j, state = i, int(left[j, state])
    return out[::-1]


def _sum_logs(x: np.ndarray, axis: int) -> np.ndarray:
    most = np.maximum(x.max(axis, keepdims=True), -1e300)
    return np.log(np.exp(x - most).sum(axis)) + np.squeeze(most, axis)


def _posterior(n: int, segments, own: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability of each segment after each state as each kind, over all segmentations (forward-backward in logs)."""
    score = np.array([own[f].sum(0) for _, _, f in segments])
    begin, end = np.array([(i, j) for i, j, _ in segments]).T
    ahead, back = np.full((n + 1, STATES), -np.inf), np.zeros((n + 1, STATES))
    ahead[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1]
            if len(here := np.flatnonzero(end == j)):
                add = _sum_logs(_sum_logs(ahead[begin[here]][:, :, None] + pair, 1) + score[here], 0)
                ahead[j, 1:] = np.logaddexp(ahead[j, 1:], add)
        for i in range(n - 1, -1, -1):
            back[i] = back[i + 1]
            if len(here := np.flatnonzero(begin == i)):
                back[i] = np.logaddexp(back[i], _sum_logs(_sum_logs((score[here] + back[end[here], 1:])[:, None, :] + pair, 2), 0))
        whole = _sum_logs(ahead[n], 0)
    return np.exp(ahead[begin][:, :, None] + pair + (score + back[end, 1:])[:, None, :] - whole)


def examples(count: int = 360, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up sentences with marked entities, and with numbers that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("er", "on", "the", "in", "ta", "lo", "mi", "su", "ra", "ke")) for _ in range(rng.randint(1, 4)))

    def card():
        body = digits(15)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(("", " ", "-"))
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}"))

    makers = {
        "email": lambda: f"{word()}{rng.choice(('.', '_', ''))}{rng.choice((digits(2), word()))}@{word()}{rng.choice(('', digits(1)))}.{rng.choice(('example.com', 'org', 'net'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card, "phone": phone,
        "secret": lambda: rng.choice(("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64)))), "sk" + "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rng.randint(24, 40))))),
    }
    plain = (lambda: digits(4), lambda: f"{digits(1)}.{digits(1)}", lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", lambda: digits(rng.randint(1, 14)), lambda: f"{digits(3)},{digits(3)}", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}",
             lambda: f"{word()}{digits(2)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{digits(2)} {digits(3)} {digits(2)}", lambda: f"{digits(2)}%", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}",
             lambda: next(n for n in iter(lambda: digits(16), "") if not luhn(n)))
    out = []
    for _ in range(count):
        text, marks = word(), []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                text += rng.choice((" ", "\n", f" {word()} "))
                if kind == "secret" and rng.random() < 0.7:
                    text += rng.choice(("token", "key", "secret")) + rng.choice((' = "', ": ", "="))
                what = makers[kind]()
                marks.append((kind, len(text), len(text) + len(what)))
                text += what
                while rng.random() < 0.25:  # lists, mostly of one kind
                    kind = kind if rng.random() < 0.6 else rng.choice(KINDS)
                    text += rng.choice((", ", "; ", " "))
                    what = makers[kind]()
                    marks.append((kind, len(text), len(text) + len(what)))
                    text += what
                text += rng.choice(("", "", '"', ".", ","))
            else:
                text += rng.choice((" ", f" {word()} ")) + rng.choice(plain)() + rng.choice(("", "", ".", ","))
            text += rng.choice((" ", f" {word()} {word()}"))
        out.append((text, marks))
    return out


@functools.lru_cache(1)
def train(epochs: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """The field of greatest likelihood on the examples, by AdaGrad."""
    data = []
    for text, marks in examples():
        for start, end in windows(text):
            tokens, segments = lattice(text, start, end)
            segments = [(i, j, _places(names)) for i, j, names in segments]
            truth, state = np.zeros((len(segments), STATES, len(KINDS))), 0
            for k, (i, j, _) in enumerate(segments):  # marks do not overlap and ascend as segments do
                for kind, a, b in marks:
                    if (tokens[i][0], tokens[j - 1][1]) == (a, b):
                        truth[k, state, KINDS.index(kind)] = 1
                        state = KINDS.index(kind) + 1
            if segments:
                data.append((len(tokens), segments, truth))
    own, pair = np.zeros((_DIMS, len(KINDS))), np.zeros((STATES, len(KINDS)))
    seen, seen_pair = np.full_like(own, 1e-6), np.full_like(pair, 1e-6)
    for _ in range(epochs):
        for n, segments, truth in data:
            off = _posterior(n, segments, own, pair) - truth
            lengths = [len(f) for _, _, f in segments]
            rows, at = np.unique(np.concatenate([f for _, _, f in segments]), return_inverse=True)
            g = decay * own[rows]
            np.add.at(g, at, np.repeat(off.sum(1), lengths, axis=0))
            seen[rows] += g * g
            own[rows] -= rate * g / np.sqrt(seen[rows])
            g = off.sum(0) + decay * pair
            seen_pair += g * g
            pair -= rate * g / np.sqrt(seen_pair)
    return Field(own, pair)


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover; both ascend."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans of the field that meet no base span."""
    starts, ends = _merged(base)
    out = []
    for start, end in windows(text):
        k = bisect.bisect_right(ends, start)  # the first stretch that ends past it
        if k < len(starts) and starts[k] <= start and end <= ends[k]:
            continue
        tokens, segments = lattice(text, start, end)
        for i, j, kind in best(len(tokens), segments, field):
            a, b = tokens[i][0], tokens[j - 1][1]
            k = bisect.bisect_right(ends, a)
            if k == len(starts) or starts[k] >= b:
                out.append((KINDS[kind], a, b))
    return out


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or stretch of spans that overlap, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """docs with pii_base (array of kind, start, end), pii_spans (all, likewise) and pii_redacted text."""
    docs = without(docs, "pii_base", "pii_spans", "pii_redacted")
    shared = docs.sparkSession.sparkContext.broadcast(train())
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    extra = StructType.fromDDL(f"pii_base {span}, pii_spans {span}, pii_redacted string")

    def run(batches):
        field = shared.value
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            found, every, clean = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = base
                if text and _HOT.search(text):
                    spans = _ordered(base + added_spans(text, base, field))
                found.append(as_rows(base))
                every.append(as_rows(spans))
                clean.append(redact(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(every, kind), pa.array(clean, pa.string())], names=[*batch.schema.names, "pii_base", "pii_spans", "pii_redacted"])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *extra.fields]))


def redact_text(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        field = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                if text and _HOT.search(text):
                    base = base_spans(text)
                    if spans := base + added_spans(text, base, field):
                        texts[i] = redact(text, spans)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans, and all spans; an added entity has at most MOST_TOKENS tokens and MOST_CHARS characters."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(written("pii_base").cast("binary"), 256).alias("base_sha256"), written("pii_spans").alias("spans"))
