"""Near duplicates against all pairs."""

import itertools
import random
import re

import pytest

from portolan.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n, percent):
    """docs: (id, text) -> sorted (id, size, component) for each row."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    by_item = {}
    for i, s in enumerate(sets):
        for x in s:
            by_item.setdefault(x, []).append(i)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = set()
    for found in by_item.values():
        pairs.update(itertools.combinations(found, 2))
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if common * 100 >= percent * (len(sets[i]) + len(sets[j]) - common):
            parent[root(i)] = root(j)
    small = {}
    for i, (key, _) in enumerate(docs):
        small[root(i)] = min(small.get(root(i), key), key)
    return sorted((key, len(sets[i]), small[root(i)]) for i, (key, _) in enumerate(docs))


def checked(spark, docs, n=3, percent=85, **more):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = near_duplicates(table, n, percent, **more).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(docs, n, percent)


def test_groups_of_edited_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, key = [], 0
    for size, words, edits in ((60, 150, 8), (40, 150, 3), (30, 40, 1), (20, 1200, 30), (25, 9, 1)):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary) + str(rng.randrange(50))
            docs.append((key * 7 % 1009, " ".join(copy)))
            key += 1
    docs += [(2000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80)))) for i in range(100)]
    checked(spark, docs)


def test_odd_rows(spark):
    passage = "the same passage stands in all of these texts and makes them share a good part of their words"
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, "Ä b"), (9, "ä b"), (10, "x " * 5000), (10, "x x x"), (11, None), (12, passage), (12, passage)]
    docs += [(20 + i, f"{passage} but text {i} ends {i * 31} like {i * 17} this") for i in range(30)]
    checked(spark, docs)


def test_without_links_or_rows(spark):
    checked(spark, [(i, f"text {i} has {i * i} words {i + 1} of its own {i * 3}") for i in range(9)])
    table = spark.createDataFrame([], "doc_id long, text string, n_links string")
    assert near_duplicates(table).count() == 0


def test_corpus(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    checked(spark, docs)
    checked(spark, docs, 5, 80)


def test_chain_of_links(spark):
    from portolan.llm.near_dedup import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(300, 200)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 300: 200}


@pytest.mark.parametrize("hub_rounds", [1, 3])
def test_number_of_hub_rounds_does_not_matter(spark, hub_rounds):
    rng = random.Random(5)
    base = [f"v{rng.randrange(90)}" for _ in range(60)]
    docs = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = f"e{rng.randrange(9)}"
        docs.append((i, " ".join(copy)))
    checked(spark, docs, hub_rounds=hub_rounds)


def test_slices_of_a_batch_give_the_sets_of_its_texts():
    import numpy as np
    import pyarrow as pa

    from portolan.llm.near_dedup import shingle_sets

    texts = pa.array([f"Some WORDS {i} of text {i * 7} and a few more ÄÖ" for i in range(50)] + [None, ""])
    whole, sizes = shingle_sets(texts, 3)
    parts = [shingle_sets(texts.slice(a, 13), 3) for a in range(0, 52, 13)]
    assert (np.concatenate([p[0] for p in parts]) == whole).all() and (np.concatenate([p[1] for p in parts]) == sizes).all()
