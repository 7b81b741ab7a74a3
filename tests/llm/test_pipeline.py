"""Each stage of the pipeline against what its input says it must do."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from portolan.llm.common import materialize

from .test_near_dedup import brute
from .test_personal_data import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
    packed = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = {n: rows[n] for n in names}
    after = {n: rows[m] for n, m in zip(names, names[1:])}

    assert Counter(r.doc_id for r in after["language_id"]) == Counter(r.doc_id for r in before["language_id"] if any(c.isalpha() for c in r.text or ""))

    want = {key for key, _, low in brute([(r.doc_id, r.text) for r in before["near_dedup"]], 5, 80) if key == low}
    assert {r.doc_id for r in after["near_dedup"]} == want and len(after["near_dedup"]) == len(want)

    texts = {r.doc_id: r.text for r in before["personal_data"]}
    for r in after["personal_data"]:
        found = plain(texts[r.doc_id])
        assert not plain(r.text)["email"] and r.n_chars == len(r.text)
        assert (r.text == texts[r.doc_id]) == (not any(found.values())) or not any(found.values())
    assert len(after["personal_data"]) == len(texts)

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times, size = Counter(r.doc_id for r in after["mixing"]), {r.doc_id: words(r.text) for r in before["mixing"]}
    assert max(times.values()) <= 3 and set(times) <= set(size)
    taken, had = defaultdict(int), defaultdict(int)
    for r in before["mixing"]:
        taken[r.source] += times[r.doc_id] * size[r.doc_id]
        had[r.source] += size[r.doc_id]
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(had))}
    total, closed = sum(had.values()), set()
    while True:
        left = total - sum(3 * had[s] for s in closed)
        goal = {s: 3 * had[s] if s in closed else left * weights[s] / sum(w for x, w in weights.items() if x not in closed) for s in had}
        above = {s for s in had if goal[s] > 3 * had[s]}
        if not above - closed:
            break
        closed |= above
    off = {s: (taken[s] - goal[s], goal[s], min(size[r.doc_id] for r in before["mixing"] if r.source == s)) for s in had}
    assert all(abs(d) <= max(40, 0.02 * g, n) for d, g, n in off.values()), off

    pieces = defaultdict(int)
    for r in packed:
        pieces[r.doc_id] += r.length
        assert 0 < r.length and r.offset + r.length <= 1024
    tokens = {r.doc_id: r.doc_tokens for r in packed}
    assert all(pieces[k] == tokens[k] * times[k] for k in times) and set(pieces) == set(times)


def test_run_is_registered_and_repeats(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    first = corpus_pipeline.run(spark, SF).groupBy().sum("length", "ids_crc32", "doc_tokens").first()
    assert first == corpus_pipeline.run(spark, SF).groupBy().sum("length", "ids_crc32", "doc_tokens").first()


def written(spark):
    """The tables in the shared folder."""
    import os

    from portolan.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if "-" in name and not name.startswith(".")}


def test_run_deletes_what_it_wrote(spark):
    from portolan.llm.common import tables

    before = written(spark)
    rows = corpus_pipeline.run(spark, SF)
    left = written(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-mixing-") and rows.count() > 0
    with tables(spark):
        assert corpus_pipeline.run(spark, SF).count() > 0
    assert written(spark) - before == left


def test_runs_at_once_leave_each_other_alone(spark):
    """A run that ends deletes its tables while another one, of another thread, still reads its own."""
    import threading

    from portolan.llm.common import tables

    before, reading, ended, counts = written(spark), threading.Event(), threading.Event(), {}

    def slow():
        with tables(spark):
            with tables(spark) as keep:
                own = keep(materialize(spark.range(1000), "slow-one"))
            reading.set()
            ended.wait(60)
            counts["slow"] = own.count()

    def quick():
        reading.wait(60)
        with tables(spark):
            counts["quick"] = materialize(spark.range(10), "quick-one").count()
        counts["between"] = written(spark) - before
        ended.set()

    threads = [threading.Thread(target=f) for f in (slow, quick)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts.pop("slow") == 1000 and counts.pop("quick") == 10
    assert [name[:9] for name in counts["between"]] == ["slow-one-"] and written(spark) == before


def test_queries_keep_only_what_their_results_read(spark):
    from portolan.llm.queries import queries

    before = written(spark)
    rows = queries()["op11_vector_codes"](spark, SF)
    assert {name.rsplit("-", 1)[0].split("-")[0] for name in written(spark) - before} == {"codes"} and len(written(spark) - before) == 2
    assert rows.count() > 0


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from portolan.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master), conf=conf))


def test_functions_do_not_need_the_package_on_workers(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from portolan.llm.common import flat_words
    from portolan.llm.subword_lm import Lattice
    from portolan.llm.toxicity import Chain, Model

    (tmp_path / "x").write_bytes(cloudpickle.dumps((flat_words, Lattice, Chain, Model)))
    code = "import pickle, sys; print([x.__name__ for x in pickle.load(open(sys.argv[1], 'rb'))], 'portolan' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "x")], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert out.stdout.strip() == "['flat_words', 'Lattice', 'Chain', 'Model'] False", out.stderr


def test_exact_repeats_of_a_row_go(spark):
    from portolan.llm.near_dedup import keep_one

    rows = [(1, "one two three four five six", 0)] * 3 + [(2, "one two three four five six", 0), (3, "other words stand in this text", 0), (3, "and here are still more of them", 0), (4, None, 0), (4, None, 0), (5, "", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, rows_ int")
    kept = keep_one(table, broadcast_rows=0)
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, rows[0][1]), (3, rows[5][1]), (3, rows[4][1]), (4, ""), (5, "")]
