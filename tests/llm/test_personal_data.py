"""Personal data against a plain reading of the patterns."""

import hashlib
import re

from pyspark.sql import functions as F

from portolan.llm.personal_data import personal_data, sanitised, span_report


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def plain(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in PLAIN.items()}


ODD = [
    None, "", "   ", "no data", "a@b.c", "a@b", "a@b.c_d@e.f", "x@y@z.com", "ä.mail+tag@host-1.example.org, zwei@x.de;", "@@@ a@@b.c a@b..c .@-.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.1.1.1 00.000.1.255", "999.1.2.3.4", "12.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112",
    "4111111111111111" * 2, "0" * 16 + " " + "0" * 3 + " 1", "+49 (30) 1234-567", "+1 23", "+1234567890123456", "++49 30 1234567 +49 30 1234567 . ) +5 8", "x" * 4000 + "@b.c", "5" * 9000,
    "1 " * 4000, "a.b" * 2000 + "@" + "c.d" * 2000, "😀 4111 1111 1111 1111 😀😀 a@b.c 10.0.0.1 +49 30 1234567 😀",
]


def test_base_spans(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "no data"), (None, "a@b.c")]
    docs += [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("tie", F.lit(2))
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in span_report(table).collect())
    want = []
    for key, text in docs:
        found = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in found[k])
        want.append((str(key), *[len(found[k]) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)


def test_terms_that_disclose(spark):
    docs = [(i, f"{'lorem ipsum dolor ' * i} the captain zanzibar wrote from boss@ship.example.org about harbour {i} in the night") for i in range(6)]
    docs += [(100 + i, f"text {i} in the night about harbour and some more {i * 7}") for i in range(60)]
    docs += [(200, docs[0][1])]  # a copy is no further evidence
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows, terms = personal_data(table)
    found = {r.id: {x.value for x in r.terms} for r in rows.join(terms, "tie").collect()}
    assert set(found) == {*range(6), 200}
    assert all({"captain", "zanzibar", "wrote"} <= x and not x & {"the", "night", "about", "harbour"} for x in found.values())
    text = {r.doc_id: r.text for r in sanitised(table).collect()}
    assert "[EMAIL]" in text[0] and "boss@" not in text[0]
    assert "zanzibar" not in text[3] and "harbour 3 in the night" in text[3] and text[100] == docs[6][1]
    assert sanitised(table).columns == table.columns


def test_codes_and_short_names_disclose(spark):
    docs = [(i, f"KX{i}Q7 met Ng and ö at {i} o'clock, write to boss@ship.example.org") for i in range(6)]
    docs += [(100 + i, f"met and at {i} o'clock, write to nobody {i}") for i in range(60)]
    rows, terms = personal_data(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {r.id: {x.value for x in r.terms} for r in rows.join(terms, "tie").collect()}
    assert set(found) == set(range(6)) and all(x == {f"kx{i}q7", "ng", "ö"} or x == {"ng", "ö"} for i, x in found.items()), found
    many = [(1000 + i, f"filler {i} words") for i in range(3000)]
    rows, terms = personal_data(spark.createDataFrame([(0, "the code KX0Q7 is of a@b.example"), *many], "doc_id long, text string"))
    assert {x.value for r in terms.collect() for x in r.terms} >= {"kx0q7"}


def test_terms_far_from_their_entity(spark):
    far = "plain filler words go on and on. " * 40
    docs = [(i, f"Zanzibar letterhead {i} {far} write to boss@ship.example.org now {far} ZANZIBAR {far * i} signed zanzibar") for i in range(4)]
    docs += [(100 + i, f"{far} write now, signed {i}") for i in range(60)]
    rows, terms = personal_data(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {r.id: r.terms for r in rows.join(terms, "tie").collect()}
    assert set(found) == {0, 1, 2, 3}
    for key, spans in found.items():
        assert [(s.start, s.end) for s in spans if s.value == "zanzibar"] == [m.span() for m in re.finditer("zanzibar", docs[key][1].lower())]
        assert not {s.value for s in spans} & {"filler", "signed", "write", "now", "boss"}
    for r in sanitised(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert "zanzibar" not in r.text.lower()


def test_whole_texts_against_plain_counts(spark):
    import math
    import random

    rng, docs = random.Random(5), []
    people = [f"p{i}@{'xyz'[i % 3]}.example.org" for i in range(6)] + ["10.1.2.3", "10.1.7.7", "+49 30 1234567", "4111 1111 1111 1111"]
    for i in range(150):
        words = [f"{rng.choice(['Ä', 'b', 'İ', '😀 c'])}{'abcdefghij'[rng.randrange(10)] * 3}{'klmnop'[rng.randrange(6)]}" for _ in range(rng.choice([0, 5, 700]))]
        for k, person in enumerate(people):
            if rng.random() < 0.06:
                words[:0], words[len(words):] = [f"own{'qrstuvwxyz'[k] * 2}"], [f"Ö{person.upper()} , ", f"also{'qrstuvwxyz'[k] * 2}"]
        docs.append((i, " ".join(words)))
    docs += [(500, docs[0][1]), (501, docs[7][1]), (7, docs[7][1])]
    term = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")

    def keys(text):
        out, found = set(), plain(text)
        for kind, spans in found.items():
            for a, b in spans:
                v = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
                group = {"email": v[v.rfind("@"):], "ip": ".".join(v.split(".")[:2]), "card": v[:6], "phone": v[: max(len(v) - 7, 1)]}[kind]
                out |= {f"{kind}:{v}", f"{kind} group:{group}"}
        return out

    def terms_of(text):
        hidden = plain(text)["email"]
        masked = "".join(" " if any(a <= i < b for a, b in hidden) else c for i, c in enumerate(text))
        return [(m[0].lower(), m.start(), m.end()) for m in term.finditer(masked)]

    entities, terms, total = {t: keys(t) for _, t in docs}, {t: terms_of(t) for _, t in docs}, len(docs)
    sets = {t: {x[0] for x in found} for t, found in terms.items()}
    told = {}
    for e in set().union(*entities.values()):
        having = [t for _, t in docs if e in entities[t]]
        for w in set().union(*(sets[t] for t in having)):
            p = (sum(w in sets[t] for t in having) + len(having) / total) / (sum(w in sets[t] for _, t in docs) + 1)
            score = 1 + math.log(p) / math.log(total / len(having))
            for t in having:
                if w in sets[t] and score >= 0.85:
                    told[t, w] = max(score, told.get((t, w), 0))
    remove = sorted(set(told.values()))[len(set(told.values())) // 2] - 1e-9
    want = {(i, a, b, "removed" if told[t, w] >= remove else "generalised") for i, t in docs for w, a, b in terms[t] if (t, w) in told}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    options = {"generalise": 0.85, "remove": remove}
    for more in ({}, {"broadcast_rows": 0}):
        rows, spans = personal_data(table, **options, **more)
        got = {(r.id, s.start, s.end, s.kind) for r in rows.join(spans, "tie").collect() for s in r.terms}
        assert got == want and {k for *_, k in want} == {"removed", "generalised"}
    # the disclosures themselves
    from portolan.llm.personal_data import base_spans, disclosing

    texts = table.select("text").withColumn("tie", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    holders = texts.filter(F.size("base") > 0).groupBy("tie").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("n"))
    scores = {(r.text, r.term): r.disclosure for r in disclosing(holders, texts, total, 1.0, 0.85, 10).join(holders, "tie").collect()}
    assert scores.keys() == told.keys() and all(math.isclose(x, told[k], rel_tol=1e-9) for k, x in scores.items())


def test_terms_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    report = span_report(docs).selectExpr("n_email + n_ip + n_card + n_phone as base", "n_terms").collect()
    assert any(r.n_terms for r in report) and not any(r.n_terms for r in report if not r.base)


def test_long_texts(spark):
    docs = [(1, "1." * 30000), (2, " ".join(f"u{i}@h{i % 97}.org zebra{i} Wort{'abcdefghij'[i % 10] * 3}" for i in range(20000))), (3, "a@b.co x " * 20000), (4, "plain Wortaaa")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in span_report(table).collect()}
    assert (got[1].n_ip, got[2].n_email, got[3].n_email) == (7500, 20000, 20000) and got[2].n_phone == 0
    text = {r.doc_id: r.text for r in sanitised(table).collect()}
    assert text[1] == "[IP]." * 7500 and text[3] == "[EMAIL] x " * 20000
    assert text[2] == " ".join(f"[EMAIL] zebra{i} Wort{'abcdefghij'[i % 10] * 3}" for i in range(20000)) and text[4] == docs[3][1]


def test_clashing_names(spark):
    names = ["doc_id", "text", "tie", "base", "terms", "of_tie", "c0", "c1"]
    table = spark.createDataFrame([(1, "x a@b.co", 1, 2, 3, 4, 5, 6), (2, None, 1, 2, 3, 4, 5, 6)], f"doc_id long, text string, {', '.join(n + ' int' for n in names[2:])}")
    assert sorted(map(tuple, sanitised(table).collect())) == [(1, "x [EMAIL]", 1, 2, 3, 4, 5, 6), (2, None, 1, 2, 3, 4, 5, 6)] and sanitised(table).columns == names
    assert {r.doc_id: r.n_email for r in span_report(table).collect()} == {1: 1, 2: 0}


def test_redaction_of_overlaps_and_nulls(spark):
    docs = [(1, None), (2, ""), (3, "call +49 30 4111111111 or a@b.c!"), (4, "+4111111111111111 x 1.2.3.4")]
    got = {r.doc_id: r.text for r in sanitised(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: None, 2: "", 3: "call [PHONE] or [EMAIL]!", 4: "+[CARD] x [IP]"}


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert span_report(table).count() == 0 and sanitised(table).count() == 0
