"""Personal data: base entities by pattern, further terms by what they disclose, in DataFrame functions only.

E-mail addresses, IP addresses, card and phone numbers are the protected entities, each at two levels: the value, and
the group that it belongs to (mail domain, network, issuer, area). Over N documents, n(c) with an entity c, n(t) with
a term t and n(c, t) with both, a term discloses an entity as far as knowing the term explains the entity away:
    P(c | t) = (n(c, t) + m * n(c) / N) / (n(t) + m)
    disclosure(c, t) = PMI(c; t) / IC(c) = 1 + ln P(c | t) / ln(N / n(c)).
It is near 1 where the term stands nowhere else and falls as the term is met in other documents; m is the weight of the
prior, so that few documents are little evidence (no floor on the number of documents is needed). Terms are
generalised from one threshold on and removed from a higher one. Pairs are counted over whole texts, and a told term
is marked at every place of the texts that hold its entity. Pairs that cannot reach the threshold whatever their
count are left out of the counting, and entities that stand in the same texts are counted as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import ascii_lower, few, let, materialize, shuffled

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns have; possessive quantifiers and the look-behinds only spare what must fail again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A run of letters and digits with a letter in it: words, names of one letter, codes. Numbers alone are no terms.
TERM = r"(?<![\p{L}\p{N}])\p{N}*+\p{L}[\p{L}\p{N}]*+"
#: Elements of an array gone through at a time, so that the work stays linear in long texts.
BLOCK = 64
PLACES = "array<struct<term:string,start:int,end:int>>"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[WORD]", "removed": ""}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (F.length(value) >= 16) & F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda value: _valid(kind, value)


def _of(kind: str):
    return lambda span: span["kind"] == kind


def running(values: Column, merge, zero: int = 0) -> Column:
    """For each element of an array of int the merged elements before it, block by block."""
    none, first = F.array().cast("array<int>"), F.lit(zero)

    def over(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK)), lambda a: F.slice(v, a, F.lit(BLOCK)))
        totals = lambda p: F.transform(p, lambda x: F.aggregate(x, first, merge))
        return let(parts, lambda p: let(over(totals(p), first), lambda heads: F.flatten(F.zip_with(p, heads, over))))

    return let(values, blocks)


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def _starts(gaps: Column, hits: Column) -> Column:
    """Where each hit starts: gaps are the lengths of the pieces between the hits, hits their own lengths."""
    widths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: g + h)
    return F.zip_with(running(widths, lambda a, x: a + x), F.slice(gaps, F.lit(1), F.size(hits)), lambda at, g: at + g)


def matches(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that keep(value) accepts, in code points, end exclusive.

    The pieces between matches tell where each one stands.
    """

    def placed(hits: Column) -> Column:
        starts = _starts(_lengths(F.split(text, pattern, -1)), _lengths(hits))
        span = lambda hit, at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("value"))
        return F.filter(F.zip_with(hits, starts, span), lambda x: keep(x["value"])).cast(SPAN)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.exists(hits, keep), placed(hits)).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> Column:
    """The base entities of a text (not null), by kind, then start."""
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(F.contains(text, F.lit(NEEDS[k])), matches(text, PATTERNS[k], k, _check(k))).otherwise(none) for k in KINDS])


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _free(text: Column) -> Column:
    """The pieces of a text between its e-mail addresses; no other entity holds letters."""
    return F.when(F.contains(text, F.lit("@")), F.split(text, PATTERNS["email"], -1)).otherwise(F.array(text))


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_free(text), lambda x: F.transform(F.regexp_extract_all(x, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))))


def placed_terms(text: Column) -> Column:
    """(term, start, end) of all terms of a text outside its e-mail addresses, lower-cased, in code points."""

    def of_piece(piece: Column, at: Column) -> Column:
        def placed(hits: Column) -> Column:
            starts = _starts(_lengths(F.split(piece, TERM, -1)), _lengths(hits))
            return F.zip_with(hits, starts, lambda hit, s: F.struct(F.lower(hit).alias("term"), (at + s).alias("start"), (at + s + F.length(hit)).alias("end")))

        return let(F.regexp_extract_all(piece, F.lit(TERM), F.lit(0)), placed)

    addresses = F.concat(_lengths(F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))), F.array(F.lit(0)))
    both = lambda pieces: F.zip_with(pieces, running(F.zip_with(_lengths(pieces), addresses, lambda g, h: g + h), lambda a, x: a + x), of_piece)
    return F.flatten(let(_free(text), both)).cast(PLACES)


def entities(base: Column) -> Column:
    """The values of a text's spans and the groups that they belong to."""

    def group(kind: Column, value: Column) -> Column:
        digits = _digits(value)
        return (
            F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
            .when(kind == "ip", F.substring_index(value, ".", 2))
            .when(kind == "card", F.substring(digits, 1, 6))
            .otherwise(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 7, F.lit(1))))  # without the subscriber's number
        )

    def keys(b: Column) -> Column:
        value = F.when(b["kind"].isin("card", "phone"), _digits(b["value"])).otherwise(ascii_lower(b["value"]))
        return F.array(F.concat(b["kind"], F.lit(":"), value), F.concat(b["kind"], F.lit(" group:"), group(b["kind"], ascii_lower(b["value"]))))

    return F.array_distinct(F.flatten(F.transform(base, keys)))


def disclosing(holders: DataFrame, texts: DataFrame, total: int, prior: float, generalise: float, broadcast_rows: int) -> DataFrame:
    """tie, term, disclosure: the terms of each text in `holders` that disclose an entity of it.

    holders: tie, text, base and n (documents with that text), one row for each text with an entity; texts: all of them.
    """
    named = materialize(holders.select("tie", "n", F.explode(entities(F.col("base"))).alias("entity")), "pii-entities")
    # entities of the same texts are one: two exclusive-or sums over the texts name the set
    stats = named.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.bit_xor(F.xxhash64("tie")).alias("a"), F.bit_xor(F.xxhash64("tie", F.lit(1))).alias("b")).filter(F.col("n_entity") < total)
    q = F.pow(F.col("n_entity") / total, F.lit(1.0 - generalise))  # P(c | t) at the threshold
    low = prior * (q - F.col("n_entity") / total) / (1 - q) * (1 - 1e-9)
    high = (F.col("n_entity") * (1 + prior / total) / q - prior) * (1 + 1e-9)
    stats = materialize(stats.withColumns({"low": low, "high": high}), "pii-entity-counts")
    widest = stats.agg(F.max("high")).first()[0]
    if widest is None:
        return holders.select("tie", F.lit("").alias("term"), F.lit(0.0).alias("disclosure")).limit(0)
    held = materialize(named.join(few(stats, broadcast_rows), "entity").select("tie", "n", "a", "b", "n_entity", "low", "high").distinct(), "pii-held")

    counted = texts.select(F.explode(distinct_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") <= widest)
    own = holders.select("tie", F.explode(distinct_terms(F.col("text"))).alias("term"))
    near = own.join(shuffled(counted), "term").select(F.col("tie").alias("near_tie"), "term", "n_term")
    inside = (F.col("tie") == F.col("near_tie")) & F.col("n_term").between(F.col("low"), F.col("high"))
    met = materialize(near.join(few(held, broadcast_rows), inside).select("tie", "n", "a", "b", "n_entity", "term", "n_term"), "pii-met")
    score = 1 + F.log((F.col("n_pair") + prior * F.col("n_entity") / total) / (F.col("n_term") + prior)) / F.log(total / F.col("n_entity"))
    pairs = met.groupBy("a", "b", "n_entity", "term", "n_term").agg(F.sum("n").alias("n_pair"))
    told = materialize(pairs.select("a", "b", "n_entity", "term", score.alias("disclosure")).filter(F.col("disclosure") >= generalise), "pii-told")
    return met.join(few(told, broadcast_rows), ["a", "b", "n_entity", "term"]).groupBy("tie", "term").agg(F.max("disclosure").alias("disclosure"))


def term_spans(marked: DataFrame, texts: DataFrame, total: int, prior: float, generalise: float, remove: float, broadcast_rows: int) -> DataFrame:
    """tie, terms: the spans of disclosing terms, by start, for each text that has any."""
    holders = marked.filter(F.size("base") > 0).groupBy("tie").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("n"))
    holders = materialize(holders, "pii-holders")
    told = materialize(disclosing(holders, texts, total, prior, generalise, broadcast_rows), "pii-terms")
    told = few(told, broadcast_rows)
    having = holders.join(told.select("tie"), "tie", "left_semi")
    places = having.select("tie", F.explode(placed_terms(F.col("text"))).alias("t")).select("tie", "t.*")
    kind = F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised")
    span = F.struct(kind.alias("kind"), "start", "end", F.col("term").alias("value"))
    spans = places.join(told, ["tie", "term"]).groupBy("tie").agg(F.array_sort(F.collect_list(F.struct("start", span.alias("span")))).alias("s"))
    return materialize(spans.select("tie", F.col("s.span").cast(SPAN).alias("terms")), "pii-spans")  # never more than the text holds


def personal_data(docs: DataFrame, prior: float = 1.0, generalise: float = 0.9, remove: float = 0.95, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row for each row of docs with its base spans, term spans by text).

    The first has id, tie (128 bits of hash of the text) and base (spans by kind, then start); the second has tie and terms: spans
    of kind `generalised` or `removed`, by start, for the texts that have any. Null texts count as empty: no spans.
    Every row is a document, so copies of a text are counted each; rows with one text get the same spans. Empty tables
    give empty results; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = texts.withColumn("tie", F.md5(F.col("text").cast("binary"))).withColumn("base", base_spans(F.col("text")))
    marked = materialize(marked.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "pii-rows")  # the one matching pass
    return marked.select("id", "tie", "base"), term_spans(marked, texts, max(1, marked.count()), prior, generalise, remove, broadcast_rows)


def with_terms(rows: DataFrame, terms: DataFrame, broadcast_rows: int) -> DataFrame:
    """rows (base, tie) with their terms under `terms`; only rows with an entity can have any, the others are not moved."""
    none = F.array().cast(SPAN)
    spans = terms.agg(F.sum(F.size("terms") + 1)).first()[0] or 0  # a text may have thousands
    named = terms.select(F.col("tie").alias("of_tie"), "terms")
    named = F.broadcast(named) if spans <= broadcast_rows else shuffled(named)
    bearing = rows.filter(F.size("base") > 0).join(named, F.col("tie") == F.col("of_tie"), "left").drop("of_tie").withColumn("terms", F.coalesce("terms", none))
    return rows.filter(F.size("base") == 0).withColumn("terms", none).unionByName(bearing)


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms for each row of docs."""
    rows, terms = personal_data(docs, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **options)
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return with_terms(rows, terms, broadcast_rows).select(F.col("id").alias(id_col), *counts, digest, span_list(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's tag; of overlapping spans the first gives the tag."""
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def cut(found: Column) -> Column:
        ends = F.transform(found, lambda x: x["end"])
        before = running(ends, lambda a, x: F.greatest(a, x))  # how far the spans before each one reach
        facts = F.zip_with(found, before, lambda x, b: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), b.alias("before")))

        def of_block(block: Column) -> Column:
            low = block[0]["before"]
            part = F.substring(text, low + 1, F.array_max(F.transform(block, lambda x: F.greatest(x["before"], x["end"]))) - low)
            piece = lambda p: lambda x: F.when(x["start"] >= x["before"], F.concat(F.substring(p, x["before"] - low + 1, x["start"] - x["before"]), F.element_at(tags, x["kind"]))).otherwise("")
            return let(part, lambda p: F.array_join(F.transform(block, piece(p)), ""))

        blocks = let(facts, lambda f: F.transform(F.sequence(F.lit(1), F.size(f), F.lit(BLOCK)), lambda a: of_block(F.slice(f, a, F.lit(BLOCK)))))
        last = F.array_max(ends)
        return F.concat(F.array_join(blocks, ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(ordered, cut)).otherwise(text)


def sanitised(docs: DataFrame, prior: float = 1.0, generalise: float = 0.9, remove: float = 0.95, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all personal data replaced in the text; the other columns stay. A null text stays null."""
    columns = [f"c{i}" for i in range(len(docs.columns))]  # no name can clash
    at = columns[docs.columns.index(text_col)]
    rows = docs.toDF(*columns).withColumn("text", F.coalesce(F.col(at), F.lit(""))).withColumn("tie", F.md5(F.col("text").cast("binary"))).withColumn("base", base_spans(F.col("text")))
    rows = materialize(rows.drop("text"), "pii-documents")  # the one matching pass
    texts = rows.select(F.coalesce(F.col(at), F.lit("")).alias("text"), "tie", "base")
    terms = term_spans(texts, texts, max(1, rows.count()), prior, generalise, remove, broadcast_rows)
    clean = redacted(F.col(at), F.concat("base", "terms"))
    return with_terms(rows, terms, broadcast_rows).select(*[(clean if c == at else F.col(c)).alias(name) for c, name in zip(columns, docs.columns)])
