"""Language identification and toxicity: parts against brute force, whole operators by held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from portolan.llm.language_id import fit, identify, keep_identified, presences
from portolan.llm.toxicity import CLASSES, Chain, fit_chain, observations, score_toxicity

MIDDLE = "/root/testdata/sf0.01"


def test_presences_are_distinct_grams():
    text = "Straße abc"
    raw = f" {text.lower()} ".encode()
    (found,) = presences(pa.array([text]), (1, 2, 3), 20)
    grams = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
    assert len(found) == len(grams) and (np.diff(found) > 0).all()
    empty, null = presences(pa.array(["", None]), (1, 2, 3), 20)
    assert (empty == null).all()


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    return [("abc"[i % 3], np.unique(rng.integers(60 * (i % 3), 300 + 60 * (i % 3), 40 + i % 17)).astype(np.int32)) for i in range(n)]


def cosine(x, y):
    return len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))


def test_model_equals_kernel_ridge_regression():
    """With every row a landmark: the dual problem, over the kernel alone."""
    rows, fresh, ridge = made_up(45, 1), made_up(20, 2), 0.1
    model = fit(rows, 10_000, ridge, 10)
    kernel = np.array([[cosine(x, y) for _, y in rows] for _, x in rows])
    share = np.full(len(rows), 1 / 15) * len(rows) / 3
    system = np.block([[kernel + ridge * np.diag(1 / share), np.ones((45, 1))], [np.ones((1, 45)), np.zeros((1, 1))]])
    for j, lang in enumerate(model.languages):
        y = np.array([1.0 if x == lang else -1.0 for x, _ in rows])
        *alpha, bias = np.linalg.solve(system, np.append(y, 0.0))
        want = [sum(a * cosine(x, own) for a, (_, own) in zip(alpha, rows)) + bias for _, x in rows + fresh]
        assert np.allclose(model.scores([x for _, x in rows + fresh])[:, j], want, atol=2e-3)


def test_landmarks_equal_nystroem_regression():
    rows, fresh, ridge = made_up(60, 3), made_up(20, 4), 0.1
    model = fit(rows, 12, ridge, 10)
    ordered = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    marks = [own for lang in "abc" for own in [x for l, x in ordered if l == lang][::5][:4]]
    k = lambda xs: np.array([[cosine(x, m) for m in marks] for x in xs])
    # the ridge penalty of a function sum w_i k(x, m_i) is w' K w
    kn, km = k([x for _, x in ordered]), k(marks)
    for j, lang in enumerate(model.languages):
        y = np.array([1.0 if l == lang else -1.0 for l, _ in ordered])
        system = np.block([[kn.T @ kn + ridge * km, kn.sum(0)[:, None]], [kn.sum(0)[None], np.array([[60.0]])]])
        w = np.linalg.solve(system, np.append(kn.T @ y, y.sum()))
        want = k([x for _, x in fresh]) @ w[:-1] + w[-1]
        assert np.allclose(model.scores([x for _, x in fresh])[:, j], want, atol=2e-3)


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], np.unique(rng.integers(0 if i % 2 else 100, 300 if i % 2 else 400, 60)).astype(np.int32)) for i in range(40)]
    model = fit(rows, 10, 0.1, 9)
    right = sum(model.languages[int(model.scores([x]).argmax())] == lang for lang, x in rows)
    assert right >= 36
    assert np.allclose(model.scores([rows[0][1], rows[1][1]])[0], model.scores([rows[0][1]])[0], atol=1e-5)


def test_samples_are_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from portolan.llm.language_id import sample as texts_of
    from portolan.llm.toxicity import sample as labelled

    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id % 3500) as text", "if(id % 10 = 0, 'de', 'en') as lang").unionByName(spark.range(3000).selectExpr("5L as doc_id", "'text 5' as text", "'en' as lang"))
    got = {(r.lang, r.text, r.h) for r in texts_of(docs, 50, "doc_id", "text", "lang", 5, 0).collect()}
    rows = docs.withColumn("h", F.xxhash64("text", "doc_id")).filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0").distinct().collect()
    for lang in ("de", "en"):
        assert {x for x in got if x[0] == lang} == {(r.lang, r.text, r.h) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.h)[:50]}
    labels = spark.range(4000).selectExpr("id as doc_id", "if(id % 20 = 0, 1, 0) as toxic")
    picked, totals = labelled(docs.filter("doc_id <> 5"), labels, 30, 200, "doc_id", "text", "toxic", 5, 0)
    known = labels.withColumn("h", F.xxhash64("doc_id")).filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0").collect()
    for label, most in ((1, 30), (0, 200)):
        best = sorted((r for r in known if r.toxic == label), key=lambda r: r.h)[:most]
        assert totals[label] == sum(r.toxic == label for r in known)
        assert sorted(r.text for r in picked.collect() if r.toxic == label) == sorted(f"text {r.doc_id % 3500}" for r in best if r.doc_id != 5)


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_language_of_odd_rows(spark):
    docs = [(1, None, "en", 1), (2, "", "en", 2), (3, "123 !!! \n", "de", 3), (4, "the and of " * 9000, "en", 4), (4, "the and of " * 9000, "en", 4), (5, "der die das und", "de", 5), (6, "der die und", None, 6), (None, "the of and", "en", 7)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int")
    rows = identify(table).collect()
    assert len(rows) == len(docs)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in rows if r.doc_id in (5, 6)} == {"de"}
    assert identify(table.limit(0)).count() == 0 and keep_identified(table.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in keep_identified(table).collect()) == ["4", "4", "5", "6", "None"]
    assert {r.lang_pred for r in identify(table.filter("doc_id < 3")).collect()} == {"und"}


@pytest.mark.parametrize("seed", range(4))
def test_chain_equals_sum_over_all_paths(seed):
    rng = np.random.default_rng(seed)
    chain = Chain(rng.normal(size=3 + len(CLASSES)))
    n = 7
    kinds = rng.integers(0, len(CLASSES) + 1, n) * (rng.random(n) < 0.5)
    hits = np.flatnonzero(kinds)
    total, toxic = 0.0, np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        weight, last = 1.0, 0
        for state, kind in zip(path, kinds):
            weight *= chain.steps[kind][last, state]
            last = state
        total += weight
        toxic += weight * np.array(path)
    partition, marginal = chain.forward_backward(np.zeros(len(hits), int), hits, kinds[hits], np.array([n]))
    assert np.isclose(partition[0], np.log(total)) and np.allclose(marginal, toxic[hits] / total)


def test_likelihood_of_labels_by_summing_over_all_taggings():
    """A clean text has one tagging, a toxic one all those with a toxic token."""
    from portolan.llm.toxicity import any_toxic, likelihood

    rng = np.random.default_rng(7)
    chain, texts, want = Chain(rng.normal(size=3 + len(CLASSES)) - 1), [], 0.0
    toxic = np.array([True, False, True, False, True])
    for label in toxic:
        kinds = rng.integers(0, len(CLASSES) + 1, 6) * (rng.random(6) < 0.5)
        total = fits = 0.0
        for path in itertools.product((0, 1), repeat=6):
            weight, last = 1.0, 0
            for state, kind in zip(path, kinds):
                weight *= chain.steps[kind][last, state]
                last = state
            total += weight
            fits += weight if any(path) == label else 0.0
        want += np.log(fits / total)
        texts.append((kinds, np.log((total - 1) / 1)))
    of = np.concatenate([np.full((k > 0).sum(), i) for i, (k, _) in enumerate(texts)])
    at, kind = (np.concatenate([f(k) for k, _ in texts]) for f in (lambda k: np.flatnonzero(k), lambda k: k[k > 0]))
    partition, _ = chain.forward_backward(of, at, kind, np.full(5, 6))
    assert np.isclose(likelihood(partition, toxic), want) and np.allclose(any_toxic(partition), [odds for _, odds in texts])


def test_repeated_ids_stay_within_the_sample(spark):
    from portolan.llm.toxicity import sample

    docs = spark.createDataFrame([(7, f"copy {i}") for i in range(500)] + [(7, "copy 1")] * 300 + [(i, f"text {i}") for i in range(100, 160)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 160)], "doc_id long, toxic int")
    rows, totals = sample(docs, labels, 10, 12, "doc_id", "text", "toxic", 5, 4)
    got = [r.toxic for r in rows.collect()]
    assert got.count(1) == 10 and got.count(0) == 12 and totals[1] + totals[0] < 62


def test_chain_of_texts_without_tokens():
    chain = fit_chain(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.array([0, 3]), np.zeros(2, bool))
    partition, marginal = chain.forward_backward(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.array([0, 5]))
    assert np.isfinite(partition).all() and len(marginal) == 0
    of, at, kind, counts = observations(pa.array(["", None, "a  bad-word, b"]), {"=bad-word": 9.0})
    assert of.tolist() == [2] and at.tolist() == [1] and kind.tolist() == [len(CLASSES)] and counts.tolist() == [0, 0, 3]


def test_toxicity_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in known) / len(known) > 0.93
    bad = {r.doc_id: r.text for r in docs.collect()}
    words = {bad[r.doc_id][s.start : s.end].strip(",.").lower() for r in rows for s in r.spans}
    assert {"idiot", "moron"} <= words


def test_scores_and_spans_against_all_tokens_in_turn(spark):
    """The learned model applied by a plain forward-backward over every token."""
    import math
    import re

    from portolan.llm.toxicity import BEGINNINGS, EDGE, learn

    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels, 3000, 9000, 4000, 5, 0, "doc_id", "text", "toxic")
    assert model.odds and model.learned and model.slope > 0
    a, b, c = np.exp(model.weights[:3])
    emit = np.exp(np.concatenate(([0.0], model.weights[3:])))
    rows = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    for doc in docs.collect():
        if doc.doc_id % 8 and not rows[doc.doc_id].spans:
            continue
        words = [(m.start(), m.end(), m[0].lower().strip(EDGE)) for m in re.finditer(r"[^\x20\x09-\x0D]+", doc.text or "")]
        kinds = []
        for *_, w in words:
            names = ([f"={w}"] if w else []) + [f"{n}{w[:n]}" for n in BEGINNINGS if len(w) > n]
            best = max([model.odds.get(x, -1.0) for x in names], default=-1.0)
            kinds.append(sum(best >= x for x in CLASSES))
        move = np.array([[1.0, a], [b, c]])
        forward, v, total = [], np.array([1.0, 0.0]), 0.0
        for k in kinds:
            v = v @ (move * np.array([1.0, emit[k]]))
            total += math.log(v.sum())
            v /= v.sum()
            forward.append(v)
        spans, v = [], np.ones(2)
        for (start, end, _), k, f in reversed(list(zip(words, kinds, forward))):
            toxic = f[1] * v[1] / (f @ v)
            if k:
                spans += [(start, end)] * bool(toxic >= 0.5)
            v = (move * np.array([1.0, emit[k]])) @ v
            v /= v.sum()
        line = model.intercept + model.slope * min(20, max(-20, math.log(max(math.expm1(min(total, 30)), 1e-9)) if total <= 30 else total))
        got = rows[doc.doc_id]
        assert math.isclose(got.score, 1 / (1 + math.exp(-line)), rel_tol=1e-6, abs_tol=1e-9)
        assert [(s.start, s.end) for s in got.spans] == spans[::-1]
    assert any(r.spans for r in rows.values())


def test_toxicity_of_odd_rows(spark):
    docs = [(i, f"{'bad ' if i % 3 == 0 else ''}plain words {i} here", i) for i in range(90)] + [(100, None, 0), (101, "", 0), (101, "  ", 0), (102, "bad " * 20000, 0), (None, "bad", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(91, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    rows = score_toxicity(table, labels).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.predicted == (1 if r.doc_id is None or r.doc_id == 102 or r.doc_id < 90 and r.doc_id % 3 == 0 else 0)
    assert {len(r.spans) for r in rows if r.doc_id == 102} == {20000}
    assert {r.score for r in score_toxicity(table, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(table.limit(0), labels).count() == 0


def test_unlabelled_documents_with_letters_stay(spark):
    from portolan.llm.language_id import keep_identified

    docs = spark.createDataFrame([(1, "clean words", None), (2, "12 34 --", None), (3, None, None), (4, "ä", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in keep_identified(docs).collect()) == [1, 4]


def test_labels_turned_round_rank_as_well(spark):
    """Label 1 is then told by the words that are absent; the learned words speak against it."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.select("doc_id", (1 - F.col("toxic")).alias("toxic"))
    rows = score_toxicity(docs, turned).join(turned, "doc_id").filter("held_out").collect()
    ones, zeros = ([r.score for r in rows if r.toxic == label] for label in (1, 0))
    above = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert above > 0.75
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93


def test_slopes_are_never_negative():
    from portolan.llm.toxicity import fit_score

    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    up, down = y * 2.0 + rng.normal(size=400), -y * 2.0 + rng.normal(size=400)
    one = fit_score(up, y, np.ones(400))
    intercept, first, second = fit_score(np.stack([down, up], 1), y, np.ones(400))
    assert first == 0.0 and np.allclose((intercept, second), one) and second > 0
    assert fit_score(down, y, np.ones(400))[1] == 0.0
