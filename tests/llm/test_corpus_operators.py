"""Each corpus operator against a brute-force version, and on odd tables."""

import hashlib
import itertools
import random
import re
import struct
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat.llm import bpe, chat, coder, decontaminate, language, licences, neardup, pieces, pii, toxicity, vectors
from loomstat.llm.common import alphanumeric, nonspace, span_hashes, text_slices, utf8, word_spans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, toxic_score string, score string, lang_pred string, pii_spans string, token_ids string, n_tokens int"


def rows_of(texts):
    return [(i, t, "en", "own", "own", "own", "own", "own", 1) for i, t in enumerate(texts)]


ODD = [None, "", " \t\n", "a", "a" * 30_000, "same words in two rows here", "same words in two rows here", "Ünïcödé 😀 日本語 text", "x@y.zz 1.2.3.4 +1 (555) 555-5555"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*rows_of(ODD), (None, "no id", None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# --- shared kernels ---


def test_words_as_the_pattern():
    rng = random.Random(4)
    rows = ["".join(rng.choice("aB .\té,\n") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    raw, offsets = utf8(pa.array(rows))
    starts, ends, row = word_spans(raw, offsets, nonspace())
    got = [[] for _ in rows]
    for a, b, r in zip(starts, ends, row):
        got[r].append(raw[a:b].tobytes())
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in rows]
    for other in (False, True):
        h = span_hashes(raw, starts, ends, nonspace().to, other)
        same = {}
        for a, b, x in zip(starts, ends, h):
            assert same.setdefault(raw[a:b].tobytes().lower(), x) == x
        assert len(set(same.values())) == len(same)
    assert alphanumeric().word[ord("z")] and not alphanumeric().word[ord(".")]


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 50, "", "d"]})
    parts = list(text_slices([batch], limit=4))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist() and len(parts) > 1


# --- 1 chat ---


def test_chat_query(spark):
    from oracle import same

    assert same(chat.op1_chat_formatting(spark, SF), chat.OP1_SQL) > 1


def test_reply_tree_paths(spark):
    edges = {1: None, 2: 1, 3: 2, 4: 2, 5: 4, 6: 1, 7: 6}
    score = {1: 0.0, 2: 1.0, 3: 9.0, 4: 1.0, 5: 1.0, 6: 5.0, 7: 5.0}
    nodes = spark.createDataFrame([("t", n, p, "assistant" if n % 2 else "user", f"m{n}", score[n]) for n, p in edges.items()], "tree string, node long, parent long, role string, text string, score double")
    leaves = [n for n in edges if n not in edges.values()]
    every = []
    for leaf in leaves:
        path = [leaf]
        while edges[path[0]]:
            path.insert(0, edges[path[0]])
        every.append((-sum(score[n] for n in path) / len(path), leaf, path))
    want = [p for _, _, p in sorted(every)]
    got = chat.paths(nodes, branches=5).groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("p")).orderBy("branch").collect()
    assert [[x.node for x in r.p] for r in got] == want
    assert chat.format_trees(nodes).count() == 1


def test_long_chain(spark):
    n = 200
    chain = spark.range(1, n + 1).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(None).cast("double").alias("score"))
    row = chat.read_back(chat.format_trees(chain)).first()
    assert [t.text for t in row.turns] == [str(i) for i in range(1, n + 1)]


def test_cycles_of_replies_end(spark):
    """Two nodes that reply to each other, a chain that hangs on them, and one to itself, beside a tree."""
    parents = {1: 2, 2: 1, 3: 2, 4: 3, 9: 9, 5: None, 6: 5, 7: 6, 8: 6}
    nodes = spark.createDataFrame([("t", n, p, "user", f"m{n}", float(n)) for n, p in parents.items()], "tree string, node long, parent long, role string, text string, score double")
    got = chat.paths(nodes, branches=9).groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("p")).orderBy("branch").collect()
    assert [[x.node for x in r.p] for r in got] == [[5, 6, 8], [5, 6, 7]]


@pytest.mark.parametrize("text", ["<|im_end|>", "\\", "<\\|", "\\<|", "<\\\\|x", "a\nb<|<|", ""])
def test_escapes(spark, text):
    df = spark.createDataFrame([(0, 0, "user", text), (0, 1, "assi<|stant\n", text)], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_trees(chat.conversation_nodes(df))).first()
    assert [tuple(t) for t in row.turns] == [("user", text), ("assi<|stant\n", text)]


def test_chat_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, node long, tree string, parent string, score string"
    df = spark.createDataFrame([(1, 0, None, None, 5, "x", "y", "z"), (1, 0, None, None, 5, "x", "y", "z"), (None, None, "assistant", "t", None, None, None, None)], schema)
    got = {r.tree.conv_id: r for r in chat.read_back(chat.format_trees(chat.conversation_nodes(df))).collect()}
    assert len(got[1].turns) == 2 and got[None].loss_text == "t"
    assert chat.format_trees(chat.conversation_nodes(df.where("false"))).count() == 0


# --- 2 decontamination ---


def slow_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for q, p in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n] and free_i[q + n] and free_d[p + n]:
                n += 1
            if n >= least and (best is None or (-n, q, p) < best):
                best = (-n, q, p)
        if best is None:
            return out
        n, q, p = -best[0], best[1], best[2]
        free_i[q : q + n] = free_d[p : p + n] = [False] * n
        out.append((q, p, n))


def test_matches_against_brute_force():
    """Coverage and tiles of whole tables of small texts over few words, many of them repetitive."""
    rng = random.Random(3)
    some = lambda n: [" ".join(rng.choice("abc"[: rng.choice((1, 2, 3))]) for _ in range(rng.randint(0, n))) for _ in range(25)]
    docs, items = [*some(40), "a b " * 30, "a " * 50], [*some(25), "a b " * 12, "a " * 20, "c b a a b"]
    found = {(r, k): (c, n, longest) for r, k, c, n, longest in decontaminate.Portion(list(range(len(items))), items).matches(*utf8(pa.array(docs)))}
    want = {}
    for (r, d), (k, t) in itertools.product(enumerate(docs), enumerate(items)):
        d, t = d.split(), t.split()
        if 0 < len(t) < decontaminate.MIN_MATCH:
            got = [(0, 0, len(t))] if any(d[p : p + len(t)] == t for p in range(len(d))) else []
        else:
            got = slow_tiles(d, t, decontaminate.MIN_MATCH)
        if got:
            want[r, k] = (sum(n for _, _, n in got) / len(t), len(got), max(n for _, _, n in got))
    assert found == want and len(want) > 100


def test_repetitive_texts_are_quick():
    import time

    began = time.process_time()
    ((_, _, coverage, n, longest),) = decontaminate.Portion([1], ["na " * 10_000]).matches(*utf8(pa.array(["na " * 20_000])))
    assert (coverage, n, longest) == (1.0, 1, 10_000) and time.process_time() - began < 5


#: Two words whose polynomial hashes modulo 2 ** 64 are equal, whatever the base.
DOUBLED = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
TWINS = DOUBLED, DOUBLED.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomials(spark):
    frame = " {} one two three four five six seven eight"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([TWINS[0], TWINS[1], TWINS[0], *(frame.format(t) for t in TWINS)])], "doc_id long, text string")
    assert [r.component_id for r in neardup.near_duplicates(docs, words=4).orderBy("doc_id").collect()] == [0, 1, 0, 3, 4]
    items = spark.createDataFrame([(7, " ".join([TWINS[1], "x1 x2 x3 x4"]))], "item_id long, text string")
    copies = spark.createDataFrame([(i, f"{t} x1 x2 x3 x4") for i, t in enumerate(TWINS)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.overlaps(copies, items).collect()] == [1]


def test_shingles_of_one_hash(monkeypatch):
    """Where the first family of hashes fails, the second tells shingles apart."""
    real = neardup.span_hashes
    monkeypatch.setattr(neardup, "span_hashes", lambda raw, a, b, to, other=False: real(raw, a, b, to, True) if other else np.full(len(a), 5, np.uint64))
    h, g, cut = neardup.shingle_sets(*utf8(pa.array(["a b c d e", "a b c d e", "a b c d f g"])), 4)
    assert np.diff(cut).tolist() == [2, 2, 3]
    numbers = neardup.numbered(h, g)
    assert numbers[:2].tolist() == numbers[2:4].tolist() and len(set(numbers.tolist())) == 4


def test_reordered_passage_is_caught(spark):
    words = [f"w{i}" for i in range(30)]
    moved = " ".join([*words[15:], "and then", *words[:15]])
    docs = spark.createDataFrame([(1, f"Before. {moved} after"), (2, "clean text of other words"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words).upper()), (8, "w1 w2"), (9, None)], "item_id long, text string")
    rows = decontaminate.overlaps(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in rows) == [(1, 7, 1.0, 2), (1, 8, 1.0, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [2, 3]


def plain_words(text):
    spaceless = "".join(f"{chr(a)}-{chr(b)}" for a, b in decontaminate.SPACELESS)
    return [w.lower() for w in re.findall(f"[{spaceless}]|(?:[0-9A-Za-z]|[^\\x00-\\x7f{spaceless}])+", text)]


def test_decontamination_words():
    rng = random.Random(8)
    rows = ["".join(rng.choice("aB .é日本ไทยかန𠀀😀ក한,") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    raw, offsets = utf8(pa.array(rows))
    starts, ends, row = decontaminate.words_at(raw, offsets)
    got = [[] for _ in rows]
    for a, b, r in zip(starts, ends, row):
        got[r].append(raw[a:b].tobytes().decode().replace("B", "b"))
    assert got == [plain_words(t) for t in rows]


def test_decontamination_short_items(spark):
    """Items of under five words, and of scripts without spaces, stand in a text as a whole."""
    rng = random.Random(9)
    docs = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["前文。東京は日本の首都である。後文", "東京は日本", "x"]
    items = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (1, 2, 3, 3, 4, 4, 4)] + ["a  B.c", "a  B.c", "", "東京は日本の首都である", "首都"]
    found = decontaminate.overlaps(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    want = set()
    for (i, d), (k, t) in itertools.product(enumerate(map(plain_words, docs)), enumerate(map(plain_words, items))):
        if 0 < len(t) and any(d[p : p + len(t)] == t for p in range(len(d))):
            want.add((i, k, 1.0, 1, len(t)))
    assert sorted(map(tuple, found)) == sorted(want)


def test_decontamination_portions(spark, monkeypatch):
    whole = sorted(map(tuple, decontaminate.op2_decontamination(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "PORTION_WORDS", 1500)
    assert whole and sorted(map(tuple, decontaminate.op2_decontamination(spark, SF).collect())) == whole


def test_decontamination_odd_tables(odd, empty):
    items = odd.select(F.col("doc_id").alias("item_id"), "text")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(odd, items).collect()}
    assert {(5, 5), (5, 6), (6, 5), (6, 6)} <= got
    assert decontaminate.overlaps(empty, items).count() == 0
    assert decontaminate.drop_contaminated(odd, items.where("false")).count() == odd.count()


# --- 3 near duplicates ---


def test_near_duplicates_query(spark):
    from oracle import same

    assert same(neardup.op3_near_duplicates(spark, SF), neardup.OP3_SQL) > 1


def test_chain_of_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 4)
    rng = random.Random(1)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]
    rows, text = [], list(base)
    for i in range(12):  # each differs from the one before by a few words, and the ends by many
        rows.append((i, " ".join(text)))
        text = list(text)
        for k in range(2):
            text[i * 12 + k] = f"n{i}{k}"
    rows += [(50 + i, " ".join(f"u{i}x{j}" for j in range(60))) for i in range(6)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}

    def shingles(t):
        w = t.split()
        return set(zip(w, w[1:], w[2:], w[3:]))

    sets, comp = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for _ in rows:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp and len(set(comp.values())) < len(rows)


def test_sketch_keeps_close_pairs():
    rng = np.random.default_rng(5)
    for _ in range(50):
        common, a, b = rng.integers(0, 1 << 63, 800, dtype=np.uint64), *rng.integers(0, 1 << 63, (2, 100), dtype=np.uint64)
        sets = [np.unique(np.r_[common, a]), np.unique(np.r_[common, b])]  # similarity 0.8
        m = neardup.minhashes(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        s = neardup.sketches(m).view(np.uint64)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= neardup.CUT
        assert (neardup.band_keys(m)[0] == neardup.band_keys(m)[1]).any()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (10, 11), (7, 7), (20, 19), (20, 18), (18, 5)], "u long, v long")
    assert {r.v: r.component for r in neardup.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 5, 19: 5, 18: 5, 5: 5}


def test_near_duplicates_odd_tables(odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()}
    assert got[0] == (0, 0, True) and got[1] == (0, 1, True) and got[6] == (2, 5, False) and got[4][0] == 1 and got[None][2]
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(odd.unionByName(odd))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


# --- 4 licences ---


def test_licences(spark, empty):
    said = {"GPL": "This work is licensed under the GNU General Public License, version 3.", "MIT": "Released under the MIT License.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "Apache": "Licensed under the Apache License, Version 2.0.", "MPL": "Distributed under the terms of the Mozilla Public License, version 2.0."}
    rows = [(i, f"Er ging mit uns.\n{t}\nThe driver had a license.") for i, t in enumerate(said.values())] + [(90, None), (91, ""), (92, "mit und mit")]
    got = {r.doc_id: (r.line, r.family, r.confirmed) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("line is not null").collect()}
    assert got == {i: (1, f, True) for i, f in enumerate(said)}
    assert licences.train()["held_out_accuracy"] > 0.95
    assert licences.scan(empty).count() == 0


def test_licence_wrapped_paragraphs(spark, odd, empty):
    grants = {f: s[0] for f, s in licences.SENTENCES.items()}
    wrapped = {i: "Some notes on the tool.\n\n \t\n" + "\n".join(textwrap.wrap(t, 60)) + "\n\nThe end of it." for i, t in enumerate(grants.values())}
    rows = [(i, t, "x") for i, t in wrapped.items()] + [(0, wrapped[0], "y"), (90, "a walk in the park\nand home again", "z"), (91, "word " * 200_000, "z"), (92, "\n\n\n", "z")]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).where("line is null").collect()
    assert sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in found) == sorted([(i, 1, f, True) for i, f in enumerate(grants)] + [(0, 1, [*grants][0], True)])
    assert licences.scan(odd).count() == 0 and licences.scan(empty).count() == 0


def test_licence_filter_changes_nothing(spark):
    """Scores by a plain reading of the model, without the filter on the vocabulary."""
    m = licences.train()
    text = "\n".join(t for t, _ in licences._examples()[:300])
    got = {r.line: r.family for r in licences.scan(spark.createDataFrame([(0, text)], "doc_id long, text string")).where("line is not null").collect()}
    for i, line in enumerate(text.split("\n")):
        known = [f for f in licences._features(line) if f in m["weights"]]
        margin = np.array(m["bias"]) + sum((np.array(m["weights"][f]) for f in known), np.zeros(len(m["classes"]))) / max(1, len(known)) ** 0.5
        p = licences._softmax(margin[None] / m["temperature"])[0]
        k = int(p.argmax())
        assert got.get(i) == (m["classes"][k] if m["classes"][k] != licences.UNKNOWN and p[k] >= m["least"] else None)


# --- 5 BPE ---


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.public_ranks(), special_tokens={})


def test_bpe_against_tiktoken(tiktoken_encoding, texts):
    rng = random.Random(2)
    odd = ["".join(rng.choice(["a", "'", "s", "ll", "re", " ", "  ", "\n", "é", "1", "²", "!", "　", "日", "\x1c", "😀", "'d", "\t", "S", "\x85"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    rows = [*odd, *(t for _, t in texts), "", "a" * 4000]
    m = bpe.Merges(bpe.public_ranks())
    ids, cut = m.encode(*utf8(pa.array(rows)))
    raw, at = m.decode(ids, cut)
    for i, t in enumerate(rows):
        assert ids[cut[i] : cut[i + 1]].tolist() == tiktoken_encoding.encode_ordinary(t)
        assert raw[at[i] : at[i + 1]].tobytes() == t.encode()


def test_pieces_are_told_apart_by_their_bytes(tiktoken_encoding, monkeypatch):
    """Words whose polynomial hashes modulo 2 ** 64 are equal, whatever the base; a table that starts afresh; a long text in parts."""
    word, other = TWINS
    rows = [word, other, f"{word} {other} x", "one two one", "", "exactly15bytes_ exactly16bytes__ é" * 3]
    monkeypatch.setattr(pieces.PieceTable, "MOST", 3)
    monkeypatch.setattr(pieces.PieceTable, "CHUNK", 2)
    monkeypatch.setattr(pieces.PieceTable, "SEGMENT", 700)
    m = bpe.Merges(bpe.public_ranks())
    for batch in (rows, [" ".join(rows) + " and so on" * 300]):
        ids, cut = m.encode(*utf8(pa.array(batch)))
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [tiktoken_encoding.encode_ordinary(t) for t in batch]


def test_fold_by_higher_order_functions(spark, tiktoken_encoding):
    words = ["the", " therndthou", "élle", "日本", "a", "12345", "zzzzqx"]
    ranks = bpe.public_ranks()
    df = spark.createDataFrame([(w.encode(),) for w in words] + [(b"",)], "w binary")
    got = [r.ids for r in df.select(bpe.fold_column(F.col("w"), ranks).alias("ids")).collect()]
    assert got == [tiktoken_encoding.encode_ordinary(w) for w in words] + [[]]


def test_bpe_odd_tables(odd, empty):
    ranks = bpe.public_ranks()
    out = bpe.decode(bpe.encode(odd, ranks), ranks)
    assert [bytes(r.decoded).decode() for r in out.collect()] == [*(t or "" for t in ODD), "no id"]
    assert bpe.round_trip(odd, ranks).where("doc_id = 0").first().n_tokens == 0
    assert bpe.round_trip(empty, ranks).count() == 0


# --- 6 coder ---


TOP = coder.MOST_IDS - 1


@pytest.mark.parametrize("ids", [[], [5], [65535] * 9, [70_000, 3, TOP], [TOP, 0] * 3000, list(range(0, 65536, 7)), [1, 2, 3] * 5000], ids=["none", "one", "same", "wide", "widest", "spread", "cycle"])
def test_coder_round_trip(ids):
    ids = np.array(ids, np.int64)
    payload = coder.pack([3, None], [len(ids), 0], ids)
    header, back = coder.unpack(payload)
    assert header["docs"] == [3, None] and header["counts"] == [len(ids), 0] and np.array_equal(back, ids)


def test_coder_round_trip_of_mixed_texts():
    """Blocks of many kinds side by side: every branch of the mixture, in step on both sides."""
    rng = np.random.default_rng(3)
    for seed in range(6):
        n = int(rng.integers(1, 9_000))
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 20, n), rng.zipf(1.3, n) % (1 << int(rng.integers(8, 20))))
        header, back = coder.unpack(coder.pack([seed], [n], ids))
        assert np.array_equal(back, ids)


def plain_model(ids):
    """The mixture of one block, id by id: bounds (start, end) of what each id is coded as, of 2 ** 20."""
    slots, share, hits, out = [{}, {}], [300, 300], [0, 0], []
    seen, known, bits, distinct = [], 0, 0, 0
    last, back = 0, 0
    for t, x in enumerate(ids):
        if t >= coder.FIRST and t & (t - 1) == 0:
            now = len(set(ids[:t]))
            known = 1024 - min(980, (now - distinct) * 1300 // (t // 2 if bits else t) + 20)
            seen, bits, distinct = sorted(ids[:t]), t.bit_length() - 1, now
        at = [(back + last) % coder.SLOTS if t else 0, last % coder.SLOTS if t else 0]
        (a, n), (b, m) = (slots[k].get(at[k], (coder.MOST_IDS, 0)) for k in (0, 1))
        two = (1000 * n // (n + 1) + 23 if n else 0) * share[0] + 1
        one = ((1000 * m // (m + 1) + 23 if m else 0) * share[1] + 1 >> 10) * ((1 << 20) - two >> 10) + 1
        if a == b:
            two, one = two + one, 0
        unit = ((1 << 20) - two - one) * known >> 10 + bits if bits else 0
        if x == a:
            out.append((0, two))
        elif x == b:
            out.append((two, two + one))
        elif (c := seen.count(x)) and unit:
            start = two + one + sum(y < x for y in seen) * unit
            out.append((start, start + c * unit))
        else:
            out.append((two + one + (unit << bits), 1 << 20))
        for k, (own, count) in enumerate(((a, n), (b, m))):
            hits[k] += own == x
            slots[k][at[k]] = (own, min(count + 1, 63)) if own == x else (own, count - (count >> 1)) if count > 1 else (x, 1)
        if t % coder.WINDOW == coder.WINDOW - 1:
            share = [min(1000, max(16, s + (min(h * (1500 // coder.WINDOW), 1000) - s >> 1))) for s, h in zip(share, hits)]
            hits = [0, 0]
        back, last = last * 40503 >> 3, x
    return out


def test_coder_against_a_plain_model():
    """One block's bytes are what a range coder with big integers writes from the plain model."""
    rng = np.random.default_rng(5)
    ids = [int(i) for i in np.where(rng.random(700) < 0.4, rng.integers(0, 9, 700), rng.integers(0, 3000, 700))]
    rare = coder._rare(1 << 12).tolist()
    low, width, words = 0, (1 << 48) - 1, 0
    for x, (start, end) in zip(ids, plain_model(ids)):
        steps = [(start, end, coder.TOTAL_BITS)] + ([(rare[x], rare[x + 1], coder.RARE_BITS)] if end == 1 << 20 else [])
        for a, b, bits in steps:
            r = width >> bits
            low, width = low + a * r, (b - a) * r
            if width < 1 << 32:
                low, width, words = low << 16, width << 16, words + 1
    blocks, _, size = coder.compress(np.array(ids))
    assert size == 1 << 12 and blocks[0] == low.to_bytes(2 * (words + 3), "big")


def test_coder_finds_damage():
    """In every place; what fills up the last block holds no ids."""
    payload = bytearray(coder.pack([1], [4096], np.arange(4096)))
    for at in range(3, len(payload) - 8, 401):
        bad = payload.copy()
        bad[at] ^= 64
        with pytest.raises((ValueError, struct.error)):
            coder.unpack(bytes(bad))
    for wrong in (coder.MOST_IDS, -1):
        with pytest.raises(ValueError):
            coder.compress(np.array([wrong]))


def test_wide_end_id_is_refused_and_kept(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    coder.write(docs, path, str(tmp_path / "wide"), end_id=70_000)
    assert coder.unpack(spark.read.parquet(str(tmp_path / "wide")).first().payload)[1].tolist()[-1] == 70_000
    with pytest.raises(Exception, match="ids must be from 0"):
        coder.write(docs, path, str(tmp_path / "wider"), end_id=coder.MOST_IDS)


def test_documents_over_several_payloads(spark, texts, tmp_path, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, t) for i, t in texts[:20]] + [(-1, "long text " * 9000), (-1, None), (None, "x")], "doc_id long, text string")
    coder.write(docs, path, str(tmp_path / "whole"))
    monkeypatch.setattr(coder, "LANES", 2)
    coder.write(docs, path, str(tmp_path / "cut"))
    seqs = spark.read.parquet(str(tmp_path / "cut")).agg(F.max("n_ids"), F.max("seq")).first()
    assert seqs[0] == 2 * coder.BLOCK_IDS and seqs[1] > 2
    read = lambda name: sorted(map(tuple, coder.read_documents(spark, str(tmp_path / name)).collect()), key=lambda r: r[1])
    assert read("cut") == read("whole")


def test_coder_predicts():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50000, 20)
    blocks, _, _ = coder.compress(np.tile(phrase, 400))
    assert sum(map(len, blocks)) < 8000 / 4  # repeated contexts cost under two bits an id


def test_token_output(spark, texts, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    docs = spark.createDataFrame([*texts, (10**6, None), (10**6 + 1, "<|endoftext|> x")], "doc_id long, text string").repartition(5)
    coder.write(docs, path, str(tmp_path / "ids"))
    got = sorted(map(tuple, coder.read_documents(spark, str(tmp_path / "ids")).collect()))
    want, at = [], 0
    for i, t in sorted([*texts, (10**6, ""), (10**6 + 1, "<|endoftext|> x")]):
        ids = [*own.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_output_odd_tables(spark, odd, empty, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder.write(odd, path, str(tmp_path / "odd"))
    assert coder.read_documents(spark, str(tmp_path / "odd")).count() == odd.count()
    coder.write(empty, path, str(tmp_path / "none"))
    assert coder.read_documents(spark, str(tmp_path / "none")).count() == 0


# --- 7 personal data ---

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans(texts):
    rng = random.Random(6)
    rows = [t for _, t in texts] + ["".join(rng.choice("a@.1 +-()9%25Z٣") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for t in rows:
        assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_are_quick():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 50_000, "+" * 100_000 + "@" * 1000):
        pii.base_spans(t)


def test_best_segmentation_is_the_best():
    """All picks of segments and all kinds for them, with the weights of pairs."""
    rng = np.random.default_rng(4)
    pair = rng.normal(size=(pii.STATES, len(pii.KINDS)))  # made to matter
    field, checked = pii.Field(pii.train().own, pair * 3), 0
    for text, _ in pii.examples(60, seed=9):
        for start, end in pii.windows(text):
            tokens, segments = pii.lattice(text, start, end)
            segments = list(segments)
            if len(segments) > 9:
                continue
            score = {(i, j): field.score(names) for i, j, names in segments}

            def total(picked):
                state, out = 0, 0.0
                for i, j, kind in picked:
                    out += score[i, j][kind] + field.pair[state, kind]
                    state = kind + 1
                return out

            top = 0.0
            for n in range(1, min(4, len(segments) + 1)):
                for pick in itertools.combinations(sorted(score), n):
                    if all(a[1] <= b[0] for a, b in zip(pick, pick[1:])):
                        for kinds in itertools.product(range(len(pii.KINDS)), repeat=n):
                            top = max(top, total([(*s, k) for s, k in zip(pick, kinds)]))
            got = pii.best(len(tokens), segments, field)
            assert len(got) < 4 and abs(total(got) - top) < 1e-9
            checked += len(got) > 1
    assert checked


def test_posterior_sums_over_segmentations():
    rng = np.random.default_rng(1)
    segments = [(0, 1, np.array([1])), (0, 2, np.array([2])), (1, 2, np.array([3])), (2, 4, np.array([1, 2])), (3, 4, np.array([4]))]
    own, pair = rng.normal(size=(5, len(pii.KINDS))), rng.normal(size=(pii.STATES, len(pii.KINDS)))
    weight, whole = np.zeros((len(segments), pii.STATES, len(pii.KINDS))), 0.0
    for n in range(len(segments) + 1):
        for pick in itertools.combinations(range(len(segments)), n):
            if all(segments[a][1] <= segments[b][0] for a, b in zip(pick, pick[1:])):
                for kinds in itertools.product(range(len(pii.KINDS)), repeat=n):
                    states = [0, *(k + 1 for k in kinds)]
                    e = np.exp(sum(own[segments[s][2], k].sum() + pair[z, k] for s, k, z in zip(pick, kinds, states)))
                    whole += e
                    for s, k, z in zip(pick, kinds, states):
                        weight[s, z, k] += e
    assert np.allclose(pii._posterior(5, segments, own, pair), weight / whole)


def test_mailing_lists_are_quick():
    import time

    text, began = "name@example.com 1\n" * 20_000, time.process_time()
    assert pii.added_spans(text, pii.base_spans(text), pii.train()) == [] and time.process_time() - began < 40


def test_pii_query_columns(spark, texts, tmp_path):
    """The registered query's own columns against the plain patterns and the field's spans."""
    rows = [*texts[:60], (-5, None), (-5, "a@b.cc 10.0.0.1 +1 (555) 010-2030 4111 1111 1111 1111 sk = deadbeefdeadbeefdeadbeefdeadbeef"), (None, "x@y.zz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in pii.op7_personal_data(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in rows:
        base = plain_spans(t or "")
        written = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        every = sorted({*base, *pii.added_spans(t or "", base, pii.train())}, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
        want.append((i, *(sum(k == kind for k, _, _ in base) for kind in pii.BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
    assert got == sorted(want, key=repr)


def test_field_on_unseen_sentences():
    weights, right, found, there = pii.train(), 0, 0, 0
    for text, marks in pii.examples(150, seed=77):
        got = set(pii.added_spans(text, [], weights))
        right, found, there = right + len(got & set(marks)), found + len(got), there + len(marks)
    assert right / found > 0.9 and right / there > 0.9


def test_pii_odd_tables(odd, empty):
    rows = {r.doc_id: r for r in pii.find(odd).collect()}
    assert len(rows) == odd.count() and rows[0].pii_redacted is None and rows[1].pii_spans == []
    assert [s.kind for s in rows[8].pii_base] == ["email", "ip", "phone"] and rows[8].pii_redacted == "<email> <ip> <phone>"
    assert pii.find(empty).count() == 0 and pii.redact_text(odd).columns == odd.columns


# --- 8 toxicity, 10 language ---


def test_toxicity_learns(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        t = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            t[rng.randrange(30)] = "Vile!"
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 400"))
    out = toxicity.score(df.where("doc_id >= 400"), model).withColumn("p", (F.col("toxic_score") >= 0.5).cast("int"))
    assert out.where("p = toxic").count() == 200 and len(model[0]) < 100
    again = toxicity.fit(df.where("doc_id < 400").repartition(7))
    assert np.array_equal(model[0], again[0]) and np.allclose(model[1], again[1])


def test_toxicity_odd_tables(spark, odd, empty):
    nothing = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    scored = toxicity.score(odd, nothing).collect()
    assert len(scored) == odd.count() and {r.toxic_score for r in scored} == {0.5}
    model = toxicity.fit(spark.createDataFrame([(1, "bad", 1), (2, None, None), (None, "x", 0)], "doc_id long, text string, toxic int"))
    assert all(0 <= r.toxic_score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_features_by_hand():
    raw, offsets = utf8(pa.array(["A b, c", None, "a B c", "abcdefgh", "abcdex"]))
    places, rows = toxicity.features(raw, offsets)
    assert sorted(places[rows == 0]) == sorted(places[rows == 2]) and len(places[rows == 0]) == 3 + 2 + 1 and not (rows == 1).any()
    assert len(places[rows == 3]) == 1 + 3 and len(set(places[rows == 3]) & set(places[rows == 4])) == 2  # stems abcd and abcde


def plain_ftrl(rows, alpha, beta, l1, l2, epochs):
    """(features, label) in order: weights and bias, over dicts."""
    z, n = {}, {}

    def weight(f):
        s, free = z.get(f, 0.0), 0.0 if f == "bias" else l1
        return 0.0 if abs(s) <= free else -(s - np.sign(s) * free) / ((beta + n.get(f, 0.0) ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for features, label in rows:
            at = {f: weight(f) for f in [*features, "bias"]}
            g = 1 / (1 + np.exp(-sum(at.values()))) - label
            for f, w in at.items():
                z[f] = z.get(f, 0.0) + g - ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / alpha * w
                n[f] = n.get(f, 0.0) + g * g
    return weight


def plain_features(text):
    w = re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())
    w = [x.lower() for x in w]
    return {("word", x) for x in w} | {("stem", k, x[:k]) for x in w for k in toxicity.STEMS if len(x) > k} | set(zip(w, w[1:])) | {("skip", a, b) for a, b in zip(w, w[2:])}


def test_toxicity_against_plain_ftrl(spark, tmp_path):
    """The registered query on a small table, with repeated and null keys and a held-out fold."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("nice", "horrible", "words", "vilest", "day", "é")) for _ in range(rng.randint(0, 7))) or None) for i in range(60)]
    rows += [(3, "nice day"), (None, "horrible vilest")]
    marks = [(i, int("vilest" in (t or ""))) for i, t in rows[:50]] + [(None, 1), (55, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(r) for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    order = {r.id: r.h for r in spark.range(60).select("id", F.xxhash64("id").alias("h")).collect()}
    labels = {i: y for i, y in marks if i is not None and y is not None and not held(i)}

    def places(text):  # equal keys come in the order of label, then bytes of places
        p, r = toxicity.presence(*toxicity.features(*utf8(pa.array([text], pa.string()))))
        return p.astype(np.int32).tobytes()

    taught = sorted((order[i], labels[i], places(t), t) for i, t in rows if i in labels)
    weight = plain_ftrl([(plain_features(t), y) for _, y, _, t in taught], toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, toxicity.EPOCHS)
    want = {(i, t): 1 / (1 + np.exp(-sum(map(weight, [*plain_features(t), "bias"])))) for i, t in rows}
    assert len(got) == len(rows)
    assert np.allclose(sorted(s for _, _, s, _ in got), sorted(want[r] for r in rows), atol=1e-9) and max(want.values()) > 0.5 > min(want.values())
    assert all(h == held(i) and p == int(s >= 0.5) for i, h, s, p in got)


def plain_grams(text):
    chars = []
    for i, c in enumerate(text or ""):
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or not chars or chars[-1] != " ":
            chars.append(c)
    return ["".join(chars[i : i + n]) for n in language.SIZES for i in range(len(chars) - n + 1)]


def test_language_against_plain_regression(spark, tmp_path):
    """Weights learned over dicts of n-grams, and predictions, on a small table with repeated and null keys."""
    rng = random.Random(6)
    words = {"en": "the cat sat on my mat", "fr": "le chat est là sur", "de": "die Katze saß auf dem"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randint(1, 9))) + rng.choice((".", " 12", "")), k) for i, k in enumerate(rng.choice(sorted(words)) for _ in range(80))]
    rows += [(5, "le le le", "fr"), (5, "the the", "en"), (5, "the the", "en"), (None, "auf", "de"), (90, None, "en"), (91, " 1 ", "en"), (92, "mat", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in language.op10_language(spark, str(tmp_path)).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    order = {r.id: r.h for r in spark.range(100).select("id", F.xxhash64("id").alias("h")).collect()}

    def places(text):
        (p, _), = language.counted(*language.features(*utf8(pa.array([text])))[:2], 1)
        return p.astype(np.int32).tobytes()

    taught = sorted({(order[i], k, places(t), t) for i, t, k in rows if i is not None and not held(i) and k and t and any(c.isalpha() for c in t)})
    shares = lambda t: {g: n / len(plain_grams(t)) for g, n in Counter(plain_grams(t)).items()}
    examples = [({g: float(np.float32(x)) for g, x in shares(t).items()}, sorted(words).index(k)) for _, k, _, t in taught]
    own, later = [e for i, e in enumerate(examples) if i % 5 != 4], [e for i, e in enumerate(examples) if i % 5 == 4]
    seen = Counter(g for x, _ in own for g in x)
    idf = lambda g: language.SCALE * np.log((1 + len(own)) / (1 + seen[g]))
    z, n, zero = {}, {}, np.zeros(3)

    def weight(g):
        s, l1 = z.get(g, zero), 0.0 if g is None else language.L1
        return np.where(np.abs(s) <= l1, 0.0, -(s - np.sign(s) * l1) / ((language.BETA + np.sqrt(n.get(g, zero))) / language.ALPHA + language.L2))

    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for _ in range(language.EPOCHS):
        for x, y in own:
            x = {None: 1.0} | {g: v * idf(g) for g, v in x.items()}
            w = {g: weight(g) for g in x}
            off = soft(sum(v * w[g] for g, v in x.items())) - np.eye(3)[y]
            for g, v in x.items():
                new = n.get(g, zero) + (v * off) ** 2
                z[g] = z.get(g, zero) + v * off - (np.sqrt(new) - np.sqrt(n.get(g, zero))) / language.ALPHA * w[g]
                n[g] = new
    logits = lambda x: weight(None) + sum(v * idf(g) * weight(g) for g, v in x.items() if g in seen)
    heat = min(np.geomspace(0.1, 10, 61), key=lambda t: np.mean([-np.log(max(soft(logits(x) / t)[y], 1e-12)) for x, y in later]))
    want = []
    for i, t, _ in rows:
        p = soft(logits(shares(t or "")) / heat) if any(c.isalpha() for c in t or "") else None
        want.append((-1 if i is None else i, held(i), "und" if p is None else sorted(words)[p.argmax()], 0.0 if p is None else p.max()))
    got = sorted((-1 if i is None else i, *r) for i, *r in got)
    want.sort()
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-4)


def test_language_held_out(spark):
    out = language.op10_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.95


def test_language_odd_tables(spark, odd, empty):
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    model = language.fit(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, None, "de")], "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[5][0] in ("en", "fr", "de") and 0 < got[5][1] <= 1
    assert language.predict(empty, model).count() == 0


# --- 9 vectors ---


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_vector_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", 1000)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in vectors.search(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.9


def test_vector_recall_on_the_embeddings(spark):
    """The registered query with its own parameters, against all inner products."""
    sf = SF.replace("0.001", "0.1")
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], 20)
    got = {}
    for r in vectors.op9_nearest_vectors(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95


def test_vector_query_against_sql(spark):
    from oracle import same

    assert same(vectors.op9_nearest_vectors(spark, SF), vectors.OP9_SQL) > 1


def test_nearest_by_distance_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WORDS", 4)
    monkeypatch.setattr(vectors, "STAGES", 2)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in vectors.search(df, df.where("vec_id = 20"), 5, "euclidean").collect():
        d = [(np.linalg.norm(np.array(v) - rows[20][1]), i) for i, v in rows if i != 20]
        assert (r.score, r.vec_id) == pytest.approx(sorted(d)[r.rank - 1])
    twice = df.unionByName(spark.createDataFrame([(20, [9.0, 0.0, 0.0, 0.0]), (20, [9.0, 0.0, 0.0, 0.0])], df.schema))
    got = vectors.search(twice, twice.where("vec_id = 20"), 5).collect()
    assert sorted(r.rank for r in got) == sorted([*range(1, 6)] * 2) and 20 not in {r.vec_id for r in got}


def test_vectors_all_alike_and_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0], "x") for i in range(50)] + [(60, None, "x"), (61, [0.0, 0.0], "x"), (62, [nan, 1.0], "x"), (63, [inf, 1.0], "x"), (64, [None, 1.0], "x"), (65, [1.0], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    got = {}
    for r in vectors.search(df, df.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 5.0), (2, 5.0), (3, 5.0)], 20: [(0, 5.0), (1, 5.0), (2, 5.0)], 40: [(0, 5.0), (1, 5.0), (2, 5.0)]}
    assert vectors.search(df.where("false"), df.where("false")).count() == 0
    assert vectors.search(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


# --- pipeline ---


def test_pipeline(spark, texts):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) <= len(texts) and len({r.doc_id for r in out}) == len(out)


def test_stages_on_odd_tables(spark, odd, empty):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "score", F.lit(None).cast("long").alias("n_chars"), "toxic_score")
    for start in (docs, docs.where("false")):
        d = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == start.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
        assert len(last) == (9 if start is docs else 0)


def test_pipeline_encodes_what_it_kept(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "mail a.b@c.de now", "en", "s", 17)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.redact_personal_data(spark, docs, SF)
    assert tuple(clean.first()) == (1, "mail <email> now", "en", "s", 16)
    row = corpus_pipeline.encode(spark, clean, SF).first()
    assert row.decoded_sha256 == hashlib.sha256(b"mail <email> now").hexdigest() and row.n_tokens == len(row.token_ids)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (3, 1)], [(1, 0), (2, 0)], [(77, 0), (78, 1)]], ids=["empty", "toxic", "clean", "unmatched"])
def test_toxicity_stage_keeps_all_without_a_model(spark, tmp_path, labels):
    import corpus_pipeline

    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad words", "worse words", "fine", None, ""])], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 6


def test_toxicity_stage_keeps_texts_without_words(spark, tmp_path):
    import corpus_pipeline

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:200]
    spark.createDataFrame([(i, int(k >= 20)) for k, i in enumerate(ids)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = [(i, "awful curse" if k >= 20 else "kind remark") for k, i in enumerate(ids)]
    docs = spark.createDataFrame([*known, (1000, None), (1001, ""), (1002, "?! \n-"), (1003, "awful curse"), (1004, "kind remark")], "doc_id long, text string")
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert model[2] > 0
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).where("doc_id >= 1000").collect()}
    assert kept == {1000, 1001, 1002, 1004}
