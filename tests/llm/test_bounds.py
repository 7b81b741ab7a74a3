"""Bounds of tables, shards and ranges that hold whatever the rows are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_table_of_merged_pieces_is_bounded(spark):
    import public_tokenizers
    import sentencepiece

    from portolan.llm.token_counts import TokenCounter

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    long = ["".join(rng.choice("漢字仮名交じり文章検索言語") for _ in range(5000)) + str(i) for i in range(20)]
    short = [" ".join("".join(rng.choice("qxzjkv") for _ in range(9)) for _ in range(300)) for _ in range(20)]
    texts = [x for pair in zip(long, short) for x in pair] + ["a " + long[0] + "  b"]
    counter = TokenCounter(sp, table_bytes=50_000)
    most = 0
    for text in texts:
        assert counter.count(text) == len(sp.encode(text))
        most = max(most, counter.held)
        assert max(len(x) for x in counter.table if x not in counter.whole) <= counter.longest if len(counter.table) > len(counter.whole) else True
    assert 0 < most <= 50_000 + 1000


def chained(docs, bucket_rows):
    from portolan.llm.fingerprints import with_next

    return with_next(docs, bucket_rows, carry=("text",))


def test_ids_that_fill_ranges_are_dealt_by_text(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(None, word()) for _ in range(700)] + [(7, word()) for _ in range(600)] + [(i, word()) for i in range(500)] + [(7, "same")] * 150 + [(None, "")] * 3
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = chained(docs, 40)
    order = sorted(rows, key=lambda d: (-(d[0] if d[0] is not None else -(1 << 63)), d[1]))
    want = [(d[0], d[1], order[(i + 1) % len(order)][1]) for i, d in enumerate(order)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_range_holds_a_crowded_id(spark, monkeypatch):
    from portolan.llm import fingerprints

    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id"))).cast("long").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    seen = []
    kept = fingerprints.F.broadcast
    monkeypatch.setattr(fingerprints.F, "broadcast", lambda df: seen.append(df.count()) or kept(df))
    assert chained(docs, 100).count() == 4000
    assert seen[0] > 20  # some forty ranges were asked for; by ids alone two of them would hold two thirds


def test_shards_are_bounded_by_bytes(spark):
    from portolan.llm.nearest import nearest

    rng = np.random.default_rng(2)
    points = rng.normal(size=(900, 24)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<float>")
    got = nearest(table, every=10, most_shard_bytes=200 * 24 * 4).collect()
    wide = points.astype(np.float64)
    hits = 0
    for q in range(0, 900, 10):
        far = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.argsort(far, kind="stable")[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert len(mine) == 10 and all(abs(r.score - far[r.vec_id]) <= 1e-14 * far[r.vec_id] * 24 for r in mine)  # single precision would be off by 1e-7
        hits += len({r.vec_id for r in mine} & set(best.tolist()))
    assert hits >= 0.9 * 900


def below_broadcasts(df):
    """For each broadcast of the plan of df, as first planned, the lines below it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


@pytest.fixture
def written(monkeypatch):
    """(label, what is broadcast) of all tables that the operators write."""
    from portolan.llm import mixing, near_dedup, personal_data

    seen = []
    for module in (mixing, near_dedup, personal_data):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, real=real: seen.append((label, list(below_broadcasts(df)))) or real(df, label))
    return seen


def texts_with_copies(spark, n=60):
    rng = random.Random(4)
    words = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(60)] for _ in range(n // 3)]
    rows = [(i, " ".join(w[: len(w) - k] + [f"x{i}"] * k) + f" mail{i}@host{i}.org", f"s{i % 3}") for i, (w, k) in enumerate((w, k) for w in words for k in range(3))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)


def test_nothing_exploded_is_broadcast(spark, written):
    from portolan.llm.common import materialize
    from portolan.llm.near_dedup import near_duplicates
    from portolan.llm.personal_data import personal_data

    docs = materialize(texts_with_copies(spark), "docs")  # a small file, which Spark would broadcast
    verdicts = near_duplicates(docs)
    rows, _ = personal_data(docs)
    assert verdicts.filter("not kept").count() == 40 and rows.filter(F.size("base") > 0).count() == 60
    found = [(label, x) for label, plans in [*written, ("verdicts", list(below_broadcasts(verdicts)))] for x in plans if "Generate" in x]
    assert {"dedup-shared", "pii-met"} <= {label for label, _ in written} and not found


def test_tables_beyond_the_limit_are_not_broadcast(spark):
    from portolan.llm.common import few, materialize
    from portolan.llm.mixing import copied

    table = materialize(spark.range(4), "ids")  # Spark itself would broadcast so small a file
    assert list(below_broadcasts(spark.range(9).join(few(table, 4), "id"))) and not list(below_broadcasts(spark.range(9).join(few(table, 3), "id")))
    plan = materialize(spark.range(4).select(F.lit("s").alias("qs"), F.col("id").alias("qz"), F.lit(1).cast("long").alias("base"), F.lit(0).cast("long").alias("edge"), F.lit(1).cast("long").alias("more"), F.lit(1).cast("long").alias("ties")), "plan")
    rows = materialize(spark.range(4).select(F.lit("s").alias("source"), F.col("id").alias("size"), (F.col("id") - 2).alias("h")), "rows")
    few_, many = (copied(rows, plan, "source", "size", "h", most) for most in (4, 3))
    assert list(below_broadcasts(few_)) and not list(below_broadcasts(many))
    assert sorted(map(tuple, few_.collect())) == sorted(map(tuple, many.collect())) == [("s", 0, -2, 1), ("s", 1, -1, 2), ("s", 2, 0, 2), ("s", 3, 1, 1)]


def test_terms_are_bounded_by_spans_not_by_texts(spark):
    from portolan.llm.common import materialize
    from portolan.llm.personal_data import SPAN, with_terms

    span = F.struct(F.lit("removed").alias("kind"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("a").alias("value"))
    terms = materialize(spark.range(2).select(F.col("id").cast("string").alias("tie"), F.array_repeat(span, 100).cast(SPAN).alias("terms")), "terms")
    rows = materialize(spark.range(3).select(F.col("id").cast("string").alias("tie"), F.array(span).cast(SPAN).alias("base")), "rows")
    out = with_terms(rows, terms, 150)
    assert not list(below_broadcasts(out))
    assert sorted(map(tuple, out.select("tie", F.size("terms")).collect())) == [("0", 100), ("1", 100), ("2", 0)]
