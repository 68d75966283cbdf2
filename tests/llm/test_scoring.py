import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telemill.llm import elias_fano as ef
from telemill.llm import ngram_lm, packing, token_counts, toxicity
from tests.llm.helpers import awkward, edited, empty, text, words

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ROWS = [(1, text(1, 900)), (2, None), (3, ""), (4, " \n\t"), (5, "The THE the, the. Éte été İ ǰ J̌ don't <|endoftext|> 😀 a b x\x1cy"), (6, text(2, 20_000)), (7, text(1, 900)), (7, text(1, 900)), (None, "no id")]


# ---- packing ----
def _ids(t):
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(WORD)
    k.encode_special_tokens = True
    return k.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]


def test_packed_pieces_rebuild_every_text(spark):
    got = packing.pack_documents(awkward(spark, ROWS), WORD, shard=5).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in ROWS:
        ids, copies = np.array(_ids(t), "<u4"), sum(j == i for j, _ in ROWS)
        want = sorted((a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)) * copies
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[i]) == sorted(want)
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_best_fit_equals_a_plain_scan():
    lengths = np.random.default_rng(0).integers(1, 65, 500)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    free: list[int] = []
    want = {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(64 - lengths[i])
    filled = collections.Counter()
    for b, n in zip(bins, lengths):
        filled[b] += n
    assert sorted(filled.values()) == sorted(64 - f for f in free) and (offsets + lengths <= 64).all()
    assert want == {}


def test_packing_nothing(spark):
    assert packing.pack_documents(empty(spark), WORD).count() == 0


# ---- Elias-Fano and the language model ----
@pytest.mark.parametrize("bits,n", [(64, 1000), (52, 1), (20, 5000), (7, 128), (52, 0)])
def test_elias_fano_round_trip_and_successor(bits, n):
    g = np.random.default_rng(bits)
    v = np.sort(g.integers(0, 1 << min(bits, 63), n, dtype=np.uint64) * np.uint64(1 if bits < 64 else 2))
    s = ef.Sequence(ef.encode(v, bits))
    assert (s.all() == v).all()
    x = np.concatenate([v, v + np.uint64(1), g.integers(0, 1 << min(bits, 63), 200, dtype=np.uint64)])
    assert (s.successor(x) == np.searchsorted(v, x)).all()


def test_trie_lookup():
    g = np.random.default_rng(1)
    rows = np.unique(np.stack([g.integers(0, 300, 3000), g.integers(0, 500, 3000)], axis=1), axis=0).astype(np.uint64)
    codes = g.integers(1, 255, len(rows))
    trie = ef.Trie(np.frombuffer(ef.build_trie(rows[:, 0], rows[:, 1], codes, 28, 24), np.uint8))
    table = {(int(a), int(b)): int(c) for (a, b), c in zip(rows, codes)}
    ask = np.stack([g.integers(0, 320, 4000), g.integers(0, 520, 4000)], axis=1).astype(np.uint64)
    assert trie.lookup(ask[:, 0], ask[:, 1]).tolist() == [table.get((int(a), int(b)), 0) for a, b in ask]


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD", 3000)
    rows = [(i, text(i % 9, 60 + i)) for i in range(60)] + [(100, None), (101, ""), (102, "unseen words only"), (5, "the same id again"), (None, "no id")]
    learn = lambda i: i is not None and i % 3 != 1
    got = ngram_lm.score_documents(awkward(spark, rows), F.col("doc_id") % 3 != 1).collect()
    tok = [[*words(t), None] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tok) if learn(i)]
    grams = [collections.Counter(), collections.Counter(), collections.Counter()]
    for t in train:
        full = [None, None, *t]
        for k in range(len(t)):
            grams[0][t[k]] += 1
            grams[1][tuple(full[k + 1 : k + 3])] += 1
            if k:
                grams[2][tuple(full[k : k + 3])] += 1
    total, below = sum(grams[0].values()), sum(grams[0].values()) + 0.5 * (len(grams[0]) + 1)

    def context(t, k, order):
        if order == 2:
            return grams[0][t[k - 1] if k else None]
        return grams[1][(t[k - 2] if k > 1 else None, t[k - 1])] if k else 0

    def seen(t, k, order):
        full = [None, None, *t]
        return grams[order - 1][tuple(full[k + 3 - order : k + 3])] if order == 2 or k else 0

    stats = collections.defaultdict(lambda: [0, 0])
    for t in train:
        for k in range(len(t)):
            for o in (2, 3):
                c = context(t, k, o)
                if c >= 2:
                    s = stats[o, int(math.log2(c - 1))]
                    s[0] += 1
                    s[1] += seen(t, k, o) >= 2
    want = []
    for (i, _), t in zip(rows, tok):
        base = score = 0.0
        for k, w in enumerate(t):
            p = (grams[0][w] + 0.5) / below
            base += math.log10(p)
            for o in (2, 3):
                c = context(t, k, o)
                if c:
                    n, hit = stats[o, int(math.log2(c))]
                    a = (hit + 0.1) / (n + 1)
                    p = a * seen(t, k, o) / c + (1 - a) * p
            score += math.log10(p)
        want.append((str(i), len(t), sum(grams[0][w] > 0 for w in t), total, base, score))
    mine = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(mine) == len(want)
    for a, b in zip(mine, sorted(want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)  # counts below 129 are stored exactly


def test_scores_without_texts_or_training(spark):
    assert ngram_lm.score_documents(empty(spark), F.lit(True)).count() == 0
    r = ngram_lm.score_documents(awkward(spark, [(1, "a b")]), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == pytest.approx(0.0)


# ---- token attribution ----
@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_equals_other_offsets(spark, rule):
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    k.encode_special_tokens = True
    rows = [*ROWS, (8, "one\n\n\n  two\r\n\r\n\n\nthree \n \n \n é😀\n"), (9, "\n\n\n\n"), (10, "x" * 3000)]
    got = collections.defaultdict(list)
    for r in token_counts.section_tokens(awkward(spark, rows), BYTE, public_tokenizers.PATTERN, rule=rule).collect():
        got[r.doc_id].append(r)
    for i, t in {i: t for i, t in rows if i != 7}.items():
        t = t or ""
        mine = sorted(got[i], key=lambda r: r.section)
        spans = [(r.start, r.start + r.length) for r in mine]
        assert "".join(t[a:b] for a, b in spans) == t and all("\n" not in t[a : b - 1] for a, b in spans)
        want = [0] * len(spans)
        for a, b in k.encode(t, add_special_tokens=False).offsets:
            over = [max(0, min(b, v) - max(a, u)) for u, v in spans]
            hit = [j for j, o in enumerate(over) if o]
            want[hit[0] if rule == "first" else hit[-1] if rule == "last" else max(hit, key=lambda j: (over[j], -j))] += 1
        assert [r.n_tokens for r in mine] == want


def test_long_text_is_encoded_as_a_whole():
    t = ("some words here\nand there  \n\n" * 50_000)[:1_300_000]
    start, end = token_counts.token_spans(t, BYTE, public_tokenizers.PATTERN)
    whole = token_counts._encoding(BYTE, public_tokenizers.PATTERN)[0].encode_ordinary(t)
    assert len(start) == len(whole) and end[-1] == len(t) and (start[1:] == end[:-1]).all()


def test_attribution_of_nothing(spark):
    assert token_counts.section_tokens(empty(spark), BYTE, public_tokenizers.PATTERN).count() == 0


# ---- toxicity ----
def _toxic_rows():
    rows, labels = [], []
    bad = "dolt knave grubling".split()
    for i in range(400):
        t = text(i, 40)
        if i % 4 == 0:
            w = t.split()
            w.insert(i % 30, bad[i % 3] + ("", "s", "ish")[i % 3])
            w.insert(3, bad[(i + 1) % 3])
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = _toxic_rows()
    docs = awkward(spark, [*rows, (900, None), (901, ""), (902, "you d0lt! you are a kn@ve"), (902, "again"), (None, "x"), (903, text(0, 50_000))])
    marks = spark.createDataFrame([*labels, (4, 0), (900, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    got = toxicity.score_documents(docs, marks, fold != 2, fold == 3).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((by[i] >= 0.3) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    carried = toxicity.score_documents(docs, marks, fold != 2, fold == 3, carry=True)
    assert carried.columns == [*docs.columns, "score"] and carried.count() == 406


def test_toxicity_without_two_classes(spark):
    docs = awkward(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    always = F.lit(True)
    assert [r.score for r in toxicity.score_documents(docs, none, always, ~always).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, ones, always, ~always).collect()] == [1.0, 1.0]
    assert toxicity.score_documents(empty(spark), ones, always, ~always).count() == 0


def test_features_by_hand():
    lex = toxicity.Lexicon([(int(h), 2.0) for h in toxicity.T.words(pa.array(["dolt"]))[0]])
    x = toxicity.features(pa.array(["You are a dolt!", None, "D0LT and d-o-l-t", ""]), lex)
    at = dict(zip(toxicity.NAMES, x.T))
    assert at["word_count"].tolist() == pytest.approx([math.log(2), 0, 0, 0]) and at["word_best"].tolist() == [2, 0, 0, 0]
    assert at["near_you"].tolist() == pytest.approx([math.log(2), 0, 0, 0]) and at["hidden_density"].tolist() == pytest.approx([0, 0, 2 / 3, 0])
    assert at["exclaims"].tolist() == [0.25, 0, 0, 0] and at["capitals"][0] == pytest.approx(1 / 11)


def test_edited_helper_is_stable():
    assert edited("a b c", 1, 0.0) == "a b c"


def test_many_contexts_of_one_word_hide_no_unseen_ngram():
    # the second word of every two-word text is the same one; half of the first words were seen before it
    g = np.random.default_rng(4)
    n = 4_000_000
    words = np.append(g.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1), np.uint64(12345))
    keys = []
    for at in range(0, n, n // 4):
        seq = np.full(n // 2, n, np.int64)
        seq[::2] = np.arange(at, at + n // 4)
        key, _ = ngram_lm._grams(words, seq, np.full(n // 4, 2), 2)
        keys.append(key[1::2])
    seen = np.unique(np.concatenate(keys[:2]))
    assert len(seen) == n // 2 and not np.isin(np.concatenate(keys[2:]), seen).any()
    b = ngram_lm.BITS[1]
    few, asked = seen[::20], np.concatenate([seen[::20], keys[3]])
    split, mask = np.uint64(b), np.uint64((1 << b) - 1)
    trie = ef.Trie(np.frombuffer(ef.build_trie(few >> split, few & mask, np.full(len(few), 7), *ngram_lm.BITS), np.uint8))
    code = trie.lookup(asked >> split, asked & mask)
    assert (code[: len(few)] == 7).all() and not code[len(few) :].any()


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("shards", [1, 7, 64])
def test_keys_sent_to_shards_take_no_more_bits_than_in_one(order, shards):
    g = np.random.default_rng(11)
    words = ngram_lm.T.mix(np.arange(1, 20_001, dtype=np.uint64))
    seq = g.integers(0, len(words), 60_000).astype(np.uint32)
    seq[:600] = 5  # counts above a byte
    lengths = np.full(600, 100)
    row = {"seq": ngram_lm._squeeze(np.ascontiguousarray(seq.view(np.uint8).reshape(-1, 4).T)), "lengths": ngram_lm._squeeze(lengths), "words": ngram_lm._squeeze(words), "flags": ngram_lm._squeeze((np.arange(600) % 5 != 1).astype(np.uint8))}
    some, part = ngram_lm._sent(row, order, shards)
    keys, real = ngram_lm._grams(words, seq, lengths, order)
    flags = np.repeat(np.arange(600) % 5 != 1, 100)
    want, at = np.unique(keys[real] if order > 1 else np.append(words, keys), return_inverse=True)
    learned = np.bincount(at, weights=flags[real] if order > 1 else np.append(np.zeros(len(words)), flags), minlength=len(want)).astype(int)
    asked, counts, answers = [], [], []
    for s, (k, c) in zip(some, part):
        own = ef.Sequence(k).all() + ngram_lm._starts(ngram_lm._bits(order), shards)[s]
        asked.append(ngram_lm._turned_back(own) if order > 1 else own)
        counts.append(ngram_lm._numbers(c))
        table = pa.table({"block": [0], "gram": [order], "shard": [s], "keys": pa.array([k], pa.binary()), "counts": pa.array([c], pa.binary())})
        answers.append(ngram_lm._expand(ngram_lm._answer_shard(order, s, shards, table).column("answer")[0].as_py(), np.int64 if order == 1 else np.uint8))
    sort = np.argsort(np.concatenate(asked))
    assert (np.concatenate(asked)[sort] == want).all() and (np.concatenate(counts)[sort] == learned).all() and learned.max() > 255
    assert (np.concatenate(answers)[sort] == (learned if order == 1 else ngram_lm.quantise(learned))).all()
    bits = ngram_lm._bits(order) - np.log2(len(want)) + 4.5
    assert sum(len(k) for k, _ in part) <= len(want) * bits / 8 + 40 * shards  # by hashes over all shards: up to 6 bits more
