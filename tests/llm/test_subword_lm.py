"""The subword lattice against all segmentations, document scores against plain counting."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from portolan.llm.subword_lm import MARK, Lattice, score_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["the", "a", "international", "größe", "漢字x", "\U0001f600!", "▁odd", "x" * 60, "ab" * 700, "thtion", ""]


@pytest.fixture(scope="module")
def lattice():
    return Lattice(PATH)


def slow(lattice, word):
    """(log of the sum over segmentations, expected uses of each piece), by recursion over the pieces' strings."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    text = MARK + word

    def arcs(i):
        for j in range(i + 1, min(len(text), i + lattice.most) + 1):
            if text[i:j] in ids:
                yield j, [ids[text[i:j]]]
            elif j == i + 1:
                yield j, [sp.piece_to_id(f"<0x{b:02X}>") for b in text[i].encode()]

    weight = [0.0] * len(text) + [1.0]
    for i in reversed(range(len(text))):
        weight[i] = sum(math.exp(sum(lattice.logs[k] for k in used)) * weight[j] for j, used in arcs(i))
    uses, ahead = Counter(), [1.0] + [0.0] * len(text)
    for i in range(len(text)):
        for j, used in arcs(i):
            p = math.exp(sum(lattice.logs[k] for k in used))
            ahead[j] += ahead[i] * p
            for k in used:
                uses[k] += ahead[i] * p * weight[j] / weight[0]
    return math.log(weight[0]), uses


def test_marginals_and_uses(lattice):
    short = [w for w in WORDS if len(w) < 30]
    want = [slow(lattice, w) for w in short]
    assert np.allclose(lattice.log_probability(short), [x for x, _ in want])
    got = lattice.expected(short, np.arange(1.0, len(short) + 1))
    total = Counter()
    for n, (_, uses) in enumerate(want, 1):
        for k, x in uses.items():
            total[k] += n * x
    assert np.allclose(got, [total[i] for i in range(lattice.size + 1)])


def test_prior_is_a_distribution(lattice):
    assert math.isclose(np.exp(lattice.logs).sum(), 1.0, rel_tol=1e-9)
    assert np.isfinite(lattice.log_probability(WORDS)).all()


def counted(docs):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for _, t in docs]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs]
    c, ends = Counter(w for ws, h in zip(words, held) if not h for w in ws), held.count(False)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    out = []
    for (key, _), ws, h in zip(docs, words, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        out.append((str(key), h, len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, round(base, 6)))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [64, 16 << 20])
def test_documents(spark, chunk_bytes):
    docs = [(i, t) for i, t in enumerate(["The cat sat", "the  cat\nsat on the mat", "", None, "  ", "x" * 3000, "Ä ä A a"] * 4)] + [(3, "again"), (None, "no id")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score").repartition(3)
    rows = score_documents(table, PATH, chunk_bytes=chunk_bytes).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == counted(docs)
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.lattice_score) for r in rows)


def test_learning_helps_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = score_documents(docs, PATH).collect()
    want = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    held = [r for r in rows if r.held_out]
    prior = [r for r in score_documents(docs, PATH, rounds=0).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.lattice_score for r in held) > sum(r.lattice_score for r in prior)
    assert sum(r.score for r in held) > sum(r.score for r in prior)


def test_scores_against_plain_sums(spark):
    """score and lattice_score from the learned pieces, word by word, over all segmentations."""
    from portolan.llm.subword_lm import learned

    docs = [(i, " ".join(["the cat", "thtion sat", "größe 漢字x", "odd"][j] for j in range(4) if (i >> j) & 1)) for i in range(1, 40)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in score_documents(table, PATH, chunk_bytes=200).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in t.split())
    ends = sum(not x for x in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    logs = learned(spark.createDataFrame(list(c.items()), "word string, c long"), PATH, 2, 1000.0, ends)
    lattice, rest = Lattice(PATH, logs), 0.25 * v / (n + v)
    log = {w: slow(lattice, w)[0] for w in {w for _, t in docs for w in t.split()}}
    for i, t in docs:
        parts = [(c[w], log[w]) for w in t.split()] + [(ends, logs[-1])]
        assert math.isclose(rows[i].lattice_score, sum(x for _, x in parts) / math.log(10), rel_tol=1e-9)
        assert math.isclose(rows[i].score, sum(math.log10((1 - rest) * k / n + rest * math.exp(x)) for k, x in parts), rel_tol=1e-9)


def test_score_is_above_base_on_learning_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score, base = score_documents(docs, PATH).filter("not held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base


def test_nothing_to_learn_from(spark):
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    table = spark.createDataFrame([(key, "some words"), (key, None)], "doc_id long, text string")
    rows = score_documents(table, PATH).collect()
    assert [r.train_tokens for r in rows] == [0, 0] and all(r.base_score == 0 and r.score < 0 and r.held_out for r in rows)
    assert score_documents(table.limit(0), PATH).count() == 0


def test_packed_codes_come_back():
    from portolan.llm.subword_lm import packed, unpacked

    codes = np.array([0, 127, 128, 16383, 16384, 2097151, 2097152, 5, 0])
    rows = packed(codes, np.array([0, 3, 0, 5, 1]))
    got = [unpacked(np.frombuffer(x.as_py(), np.uint8)).tolist() for x in rows]
    assert got == [[], [0, 127, 128], [], [16383, 16384, 2097151, 2097152, 5], [0]]
    assert packed(np.zeros(0, np.int64), np.array([0, 0])).to_pylist() == [b"", b""]
