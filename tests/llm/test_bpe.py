"""Batched BPE merges against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portolan.llm.bpe import Encoder, Rules, decode, encode, merged, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  \n\t ", "Hello world's end", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext|", "naïve ﬁne   x\u0085y", "日本語のテキスト。 русский", "👩‍👩‍👧 🇩🇪",
    "﻿mark", "a\u0000b\u0001", "I'LL we'll  don't\t\t", "x" * 3000, "ab" * 2000, "a" * 127 + " " + "a" * 129, "=" * 700 + "-" * 700, "0123456789" * 300, " " * 1500 + "z", "\n" * 999, "ÃÂ" * 400,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, chunk_bytes=5000)


def same(encoder, library, texts):
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts(encoder, library):
    same(encoder, library, ODD)
    same(encoder, library, [None, *reversed(ODD)])


def test_long_runs(encoder, library):
    rng = random.Random(3)
    for letters in ("ab", "aab", "abcdefghijklmnopqrstuvwxyz", "eeeeaaaattiioonnssrrhh"):
        same(encoder, library, ["".join(rng.choices(letters, k=n)) for n in (200, 1000, 20_000)])


def test_whole_tables(encoder, library):
    import pyarrow.parquet as pq

    for table, column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        same(encoder, library, pq.read_table(f"/root/testdata/sf0.001/{table}.parquet").column(column).to_pylist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeinrst  '\n"), st.characters(exclude_categories=["Cs"])), max_size=400), max_size=5))
def test_any_texts(encoder, library, texts):
    same(encoder, library, texts)


def test_merge_order_by_plain_loop():
    """Words of few letters under rules where early and late merges compete, against one merge at a time."""
    rules = Rules.__new__(Rules)
    rng = np.random.default_rng(1)
    symbols, pairs, spelled = list(range(3)), [], {0: "a", 1: "b", 2: "c"}
    known = {v: k for k, v in spelled.items()}
    while len(pairs) < 40:
        a, b = rng.choice(symbols, 2).tolist()
        word = spelled[a] + spelled[b]
        if len(word) <= 6 and word not in known:
            known[word] = len(spelled)
            spelled[known[word]] = word
            symbols.append(known[word])
            pairs.append((a, b))
    rules.size, rules.reach = len(spelled), 6
    rules.first = np.zeros(256, np.int64)
    rules.first[[97, 98, 99]] = [0, 1, 2]
    keys = np.array([a * rules.size + b for a, b in pairs])
    order = np.argsort(keys)
    rules.keys, rules.ranks, rules.made = keys[order], order.astype(np.int32), np.array([known[spelled[a] + spelled[b]] for a, b in pairs])
    ranks = {p: i for i, p in enumerate(pairs)}
    words = ["".join(rng.choice(list("abc"), n, p=[0.6, 0.25, 0.15])) for n in rng.integers(1, 120, 400)]
    want = []
    for w in words:
        ids = [known[c] for c in w]
        while True:
            found = min(((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))), default=(1 << 30, 0))
            if found[0] == 1 << 30:
                break
            ids[found[1] : found[1] + 2] = [int(rules.made[found[0]])]
        want.append(ids)
    ids, counts = merged(rules, np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words]))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == want


def test_round_trip(spark, library):
    texts = [*ODD, None]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 2, "y"), (3, ODD[3], 3, "z")], "doc_id long, text string, ids int, decoded string")
    rows = round_trip(docs, PATH).collect()
    want = []
    for i, t in [*enumerate(texts), (None, "no id"), (3, ODD[3])]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert round_trip(docs.limit(0), PATH).count() == 0
    coded = encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids", "decoded", "ids"] and coded.count() == len(texts) + 2


def test_decoding(spark, library):
    lists = [[], None, [50256], [0, 1, 50256, 220], [241], [162, 245], library.encode("日本").ids[:-1], [*range(0, 50257, 97)]]
    rows = decode(spark.createDataFrame([(i, x, "c") for i, x in enumerate(lists)], "id int, ids array<int>, decoded string"), PATH).toDF("id", "ids", "old", "text").collect()
    assert {r.id: r.text for r in rows} == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
    for bad in ([-1], [50257]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            decode(spark.createDataFrame([(bad,)], "ids array<int>"), PATH).collect()
    assert decode(spark.range(3).select(F.array().cast("array<int>").alias("ids")), PATH).filter("decoded = ''").count() == 3


def test_parts_are_cut_where_no_token_crosses_and_read_once(encoder):
    from portolan.llm.bpe import cut_places

    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices(["a", "é", "日", "'s", " ", "  ", "\n", " ", "\u0085", "　", "7", "!"], k=40))
        raw = text.encode()
        at = [0, *cut_places(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        assert [p for a, b in zip(at, at[1:]) for p in encoder.pieces(raw[a:b].decode())[0]] == encoder.pieces(text)[0]
    seen, counting = [], Encoder(PATH)
    plain = counting.pieces
    counting.pieces = lambda text: seen.append(text) or plain(text)
    assert len(counting.encode(["one two " * 500 + "<|endoftext|>", "two one " * 500])) == 2
    assert len(seen) <= 7
