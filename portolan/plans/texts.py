"""Search, keys, codes, money and nested offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.functions import text as fn
from portolan.plans.registry import query
from portolan.sources.tables import table


@query("""WITH t AS (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS b FROM part),
s AS (SELECT *, CASE WHEN b = 'bolt 2' THEN 10 WHEN n = 'bolt 2' THEN 12 WHEN starts_with(b, 'bolt 2') THEN 20 WHEN starts_with(n, 'bolt 2') THEN 24 WHEN (n || ' ' || b) LIKE '%bolt%' AND (n || ' ' || b) LIKE '%2%' THEN 40 + CASE WHEN contains(n, 'bolt 2') THEN instr(n, 'bolt 2') - 1 WHEN contains(b, 'bolt 2') THEN instr(b, 'bolt 2') - 1 ELSE 20 END END AS score FROM t)
SELECT row_number() OVER (ORDER BY score, p_name, p_partkey)::INTEGER AS rank, p_partkey, score::INTEGER AS score FROM s WHERE score IS NOT NULL QUALIFY rank <= 8""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best parts for "Bolt-2": exact before prefix before all words somewhere."""
    wanted = "bolt 2"
    name, brand = fn.search_text(F.col("p_name")), fn.search_text(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", name.alias("n"), brand.alias("b"))
    everywhere = F.concat_ws(" ", "n", "b")
    place = F.least(*[F.when(F.contains(F.col(c), F.lit(wanted)), F.instr(F.col(c), wanted) - 1) for c in ("n", "b")])
    score = (
        F.when(F.col("b") == wanted, 10).when(F.col("n") == wanted, 12).when(F.col("b").startswith(wanted), 20).when(F.col("n").startswith(wanted), 24)
        .when(F.contains(everywhere, F.lit("bolt")) & F.contains(everywhere, F.lit("2")), 40 + F.coalesce(place, F.lit(20)))
    )
    top = rows.withColumn("score", score).filter("score is not null").orderBy("score", "p_name", "p_partkey").limit(8)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", "p_name", "p_partkey"))).select("rank", "p_partkey", "score")


_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT p_partkey AS entry, p_name AS title, 'p' || p_partkey AS code, {_NORMAL.format("p_brand")} AS place, {_NORMAL.format("p_name")} AS name, {_NORMAL.format("p_type")} AS land FROM part),
r AS (SELECT unnest([p_name, split_part(p_name, ' ', 2), p_brand, substr(p_name, 3, 5), p_type || ' ' || split_part(p_name, ' ', 1), 'P-' || p_partkey, split_part(p_name, ' ', 2) || ' ' || right(p_brand, 1), left(p_name, 1), p_type || ' none']) AS raw FROM part),
q AS (SELECT DISTINCT rtrim(left({_NORMAL.format("raw")}, 60)) AS query FROM r), m AS (SELECT query, entry, title, code, CASE WHEN code = replace(query, ' ', '') THEN 0 WHEN place = query THEN 10 WHEN name = query THEN 12 WHEN starts_with(code, replace(query, ' ', '')) THEN 18 WHEN starts_with(place, query) THEN 20
WHEN starts_with(name, query) THEN 24 WHEN len(list_filter(string_split(query, ' '), lambda w: NOT contains(code || ' ' || place || ' ' || name || ' ' || land, w))) = 0 THEN 40 + coalesce(least(nullif(instr(place, query), 0), nullif(instr(name, query), 0)) - 1, 20) END AS score FROM q, t WHERE len(query) >= 2)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score, title, code, entry)::INTEGER AS rank, entry, score::INTEGER AS score FROM m WHERE score IS NOT NULL QUALIFY rank <= 8""")
def indexed_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best parts for each of all the searches that parts suggest: names, words of them, brands, middles of words, codes. The SQL tries every part for every search."""
    from portolan.operators.search import search, spread

    parts = spread(table(spark, sf_dir, "part"), "p_partkey")
    entries = parts.select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("title"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("code"), *[fn.search_text(F.col(c)).alias(n) for c, n in (("p_brand", "place"), ("p_name", "name"), ("p_type", "land"))])
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    suggested = [F.col("p_name"), second, F.col("p_brand"), F.substring("p_name", 3, 5), F.concat_ws(" ", "p_type", first), F.concat(F.lit("P-"), F.col("p_partkey").cast("string")), F.concat_ws(" ", second, F.right("p_brand", F.lit(1))), F.substring("p_name", 1, 1), F.concat("p_type", F.lit(" none"))]
    asked = spread(parts.select(F.explode(F.array(*suggested)).alias("raw")), "raw").distinct().select(fn.search_text(F.col("raw")).alias("query"))
    return search(entries, asked)


@query("""WITH h AS (SELECT p_partkey, '  Código ' || p_type || ' – Nº' || p_size AS raw, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN '  ' ELSE ' ' || lower(p_brand) || '   x ' END AS c FROM part),
k AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(replace(raw, 'º', 'o'))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, raw, CASE WHEN c IS NULL OR trim(c) = '' THEN '__MISSING__' ELSE upper(trim(regexp_replace(c, '\\s+', ' ', 'g'))) END AS category FROM h)
SELECT p_partkey, key, category, left(key, 48) || '_' || left(sha256(raw), 10) AS token, 'P' || left(sha256(p_partkey || '|' || category), 24) AS record_id FROM k""".replace("\\\\s", "\\s"))
def header_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, categories, feature tokens and record ids from text with marks, blanks and nulls."""
    raw = F.concat(F.lit("  Código "), "p_type", F.lit(" – Nº"), F.col("p_size").cast("string"))
    c = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("p_brand"), F.lit("   x ")))
    rows = table(spark, sf_dir, "part").select("p_partkey", fn.header_key(raw).alias("key"), fn.category(c).alias("category"), fn.feature_token(raw).alias("token"))
    return rows.withColumn("record_id", fn.record_id("P", F.col("p_partkey").cast("string"), F.col("category")))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'PT' || (o_orderkey % 30) || 'H' || (o_orderkey % 60) || 'M' WHEN 1 THEN 'P' || (o_orderkey % 4) || 'D' WHEN 2 THEN 'PT' || (o_orderkey % 90) || 'M30S' WHEN 3 THEN '2h' WHEN 4 THEN 'PT0M' ELSE NULL END AS d,
CASE o_orderkey % 5 WHEN 0 THEN floor(o_totalprice)::BIGINT || '.50' WHEN 1 THEN floor(o_totalprice)::BIGINT::VARCHAR WHEN 2 THEN '012.3' WHEN 3 THEN (o_orderkey % 100) || '.1234' ELSE (o_orderkey % 100) || '.120' END AS a, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' ELSE 'KWD' END AS c FROM orders),
p AS (SELECT *, CASE c WHEN 'USD' THEN 2 WHEN 'JPY' THEN 0 ELSE 3 END AS e, CASE WHEN regexp_full_match(a, '(0|[1-9][0-9]*)(\\.[0-9]+)?') THEN a::DECIMAL(30, 9) END AS v FROM r), u AS (SELECT *, CASE WHEN v * (10 ** e)::DECIMAL(10, 0) = floor(v * (10 ** e)::DECIMAL(10, 0)) THEN (v * (10 ** e)::DECIMAL(10, 0))::BIGINT END AS units FROM p)
SELECT o_orderkey, CASE WHEN regexp_full_match(d, 'P([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+S)?)?') THEN nullif(coalesce(nullif(regexp_extract(d, 'P([0-9]+)D', 1), '')::BIGINT, 0) * 1440 + coalesce(nullif(regexp_extract(d, 'T([0-9]+)H', 1), '')::BIGINT, 0) * 60 + coalesce(nullif(regexp_extract(d, '([0-9]+)M', 1), '')::BIGINT, 0), 0) END AS minutes,
units, CASE e WHEN 0 THEN units::VARCHAR ELSE (units // (10 ** e)::BIGINT)::VARCHAR || '.' || lpad((units % (10 ** e)::BIGINT)::VARCHAR, e, '0') END AS again FROM u""".replace("\\\\.", "\\."))
def durations_and_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations and amounts read from text; amounts written back from minor units."""
    k, cents = F.col("o_orderkey"), F.floor("o_totalprice").cast("long").cast("string")
    n = lambda m: (k % m).cast("string")
    d = F.when(k % 6 == 0, F.concat(F.lit("PT"), n(30), F.lit("H"), n(60), F.lit("M"))).when(k % 6 == 1, F.concat(F.lit("P"), n(4), F.lit("D"))).when(k % 6 == 2, F.concat(F.lit("PT"), n(90), F.lit("M30S"))).when(k % 6 == 3, "2h").when(k % 6 == 4, "PT0M")
    a = F.when(k % 5 == 0, F.concat(cents, F.lit(".50"))).when(k % 5 == 1, cents).when(k % 5 == 2, "012.3").when(k % 5 == 3, F.concat(n(100), F.lit(".1234"))).otherwise(F.concat(n(100), F.lit(".120")))
    c = F.when(k % 3 == 0, "USD").when(k % 3 == 1, "JPY").otherwise("KWD")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), a.alias("a"), c.alias("c"))
    units = fn.minor_units(F.col("a"), F.col("c"))
    return rows.select("o_orderkey", fn.duration_minutes(F.col("d")).alias("minutes"), units.alias("units"), fn.money_text(units, F.col("c")).alias("again"))


@query("""WITH r AS (SELECT l_shipdate::DATE AS day, ['NGN', 'USD', 'GBP', 'EUR'][1 + (l_linenumber % 4)] AS quote, l_extendedprice AS rate FROM lineitem), d AS (SELECT day, quote, max(rate) AS rate FROM r WHERE quote <> 'EUR' GROUP BY ALL),
p AS (SELECT day, max(rate) FILTER (quote = 'NGN') AS ngn, max(rate) FILTER (quote = 'USD') AS usd, max(rate) FILTER (quote = 'GBP') AS gbp FROM d GROUP BY day) SELECT day, usd / ngn AS usd, gbp / ngn AS gbp, 1 / ngn AS eur FROM p WHERE ngn > 0 AND usd > 0 AND gbp > 0""")
def cross_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates against one currency through a common base, only for days on which all are quoted."""
    quote = F.element_at(F.array(*map(F.lit, ["NGN", "USD", "GBP", "EUR"])), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), quote.alias("quote"), F.col("l_extendedprice").alias("rate"))
    best = {q: F.max(F.when(F.col("quote") == q, F.col("rate"))).alias(q) for q in ("NGN", "USD", "GBP")}
    days = rows.groupBy("day").agg(*best.values()).filter("NGN > 0 and USD > 0 and GBP > 0")
    return days.select("day", (F.col("USD") / F.col("NGN")).alias("usd"), (F.col("GBP") / F.col("NGN")).alias("gbp"), (1 / F.col("NGN")).alias("eur"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || (event_id % 90) || '.00 ' WHEN 1 THEN (event_id % 90) || '.5' WHEN 2 THEN 'x' || event_id ELSE (event_id % 90)::VARCHAR END AS n, CASE event_id % 3 WHEN 0 THEN 1704067200.0 + event_id WHEN 1 THEN 1704067200000.0 + event_id * 1000.0 ELSE 5.0 END::DOUBLE AS e,
CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN floor(value) WHEN 2 THEN 5000.0 END::DOUBLE AS stated, ts, ts + to_minutes((event_id % 3000)) AS actual FROM events)
SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN event_id % 90 END AS integral, CASE WHEN event_id % 3 < 2 THEN 1704067200000000 + event_id * 1000000 END AS instant_us, CASE WHEN stated = floor(stated) AND stated BETWEEN -1440 AND 1440 THEN stated WHEN event_id % 3000 <= 1440 THEN (event_id % 3000)::DOUBLE END AS delay FROM r""")
def numbers_and_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers in text, instants in seconds or milliseconds, and delays stated or worked out."""
    k = F.col("event_id")
    n = (k % 90).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), n, F.lit(".00 "))).when(k % 4 == 1, F.concat(n, F.lit(".5"))).when(k % 4 == 2, F.concat(F.lit("x"), k.cast("string"))).otherwise(n)
    epoch = F.when(k % 3 == 0, 1704067200.0 + k).when(k % 3 == 1, 1704067200000.0 + k * 1000.0).otherwise(5.0)
    stated = F.when(k % 4 == 0, F.col("value")).when(k % 4 == 1, F.floor("value").cast("double")).when(k % 4 == 2, 5000.0)
    actual = F.timestamp_micros(F.unix_micros("ts") + (k % 3000) * 60_000_000)
    return table(spark, sf_dir, "events").select("event_id", fn.integral(text).alias("integral"), F.unix_micros(fn.epoch_instant(epoch)).alias("instant_us"), fn.observed_delay(stated, F.col("ts"), actual).alias("delay"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' abc/' || (p_size % 10) || ', ABC/' || (p_size % 10) || ' ,XYZ/7' WHEN 1 THEN 'ab/1,XYZ/2' WHEN 2 THEN 'QQQ/' || p_size || ', bad entry ,XYZ/9' ELSE '  ' END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ABC/' || (t[6]) || '|XYZ/7' WHEN 2 THEN replace(string_split(t, ',')[1], ' ', '') ELSE '' END AS codes FROM c""")
def codeshares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct codes up to the first entry that is none."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    digit = (F.col("p_size") % 10).cast("string")
    t = F.when(k % 4 == 0, F.concat(F.lit(" abc/"), digit, F.lit(", ABC/"), digit, F.lit(" ,XYZ/7"))).when(k % 4 == 1, "ab/1,XYZ/2").when(k % 4 == 2, F.concat(F.lit("QQQ/"), size, F.lit(", bad entry ,XYZ/9"))).otherwise("  ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.codes(t), "|").alias("codes"))


@query("""WITH u AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<ul>(.*?)</ul>', 1), '<li><a[^>]*>([^<]*)</a></li>', 1) AS c FROM pages WHERE html LIKE '%<ul>%')
SELECT page_id, (i - 1)::INTEGER AS row, 0 AS "column", replace(replace(replace(replace(c[i], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS i FROM u)""")
def html_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, row, column, text of the first list of links of each page (the pages hold no tables)."""
    from portolan.sources.html import first_tables

    return first_tables(table(spark, sf_dir, "pages"), "page_id", "html", container="ul", row="li", cell=("a",))


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, CASE WHEN (props::JSON ->> 'k')::BIGINT > 50 THEN 'high' ELSE 'low' END AS band, sha256('{"k":' || (props::JSON ->> 'k') || ',"t":"' || event_type || '"}') AS content, 'A' || event_type || '>B' || (props::JSON ->> 'k') AS identity FROM events""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider JSON under an explicit schema; content hashed in canonical form, and an identity text over nested parts."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    content = F.sha2(F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))), 256)
    ends = F.array(F.concat(F.lit("A"), "event_type"), F.concat(F.lit("B"), F.col("p.k").cast("string")))
    return rows.filter("p.k is not null").select("event_id", F.col("p.k").alias("k"), F.when(F.col("p.k") > 50, "high").otherwise("low").alias("band"), content.alias("content"), F.array_join(F.transform(ends, lambda x: x), ">").alias("identity"))


@query("""WITH r AS (SELECT c_custkey, DATE '2024-01-10' + ((c_custkey % 400) - 20)::INTEGER AS dep, DATE '2024-01-10' + ((c_custkey % 390) - 15)::INTEGER AS ret, (c_custkey % 8)::INTEGER AS adults, (c_custkey % 5)::INTEGER AS children, (c_custkey % 4)::INTEGER AS infants FROM customer)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN dep < DATE '2024-01-09' OR dep > DATE '2024-12-06' THEN 'departure' END, CASE WHEN ret < dep THEN 'return' END, CASE WHEN adults < 1 THEN 'adults' END, CASE WHEN adults + children + infants > 9 THEN 'passengers' END, CASE WHEN infants > adults THEN 'infants' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with a search: dates from a day before to 331 days after today, nine passengers, an adult for each infant."""
    k, today = F.col("c_custkey"), F.lit("2024-01-10").cast("date")
    dep, ret = F.date_add(today, (k % 400 - 20).cast("int")), F.date_add(today, (k % 390 - 15).cast("int"))
    adults, children, infants = k % 8, k % 5, k % 4
    wrong = [("departure", ~dep.between(F.date_sub(today, 1), F.date_add(today, 331))), ("return", ret < dep), ("adults", adults < 1), ("passengers", adults + children + infants > 9), ("infants", infants > adults)]
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_compact(F.array(*[F.when(bad, name) for name, bad in wrong])), ",").alias("errors"))


@query("""WITH c AS (SELECT event_id, epoch_us(ts) AS t, event_type || '/' || (user_id % 10) AS ident FROM events),
r AS (SELECT event_id, t + 1800000000 * (event_id % 4) AS now, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE ident END AS wanted FROM c)
SELECT event_id, CASE WHEN now >= t + 3600000000 THEN 'expired' WHEN wanted <> ident THEN 'conflict' ELSE 'valid' END AS fate FROM r JOIN c USING (event_id)""")
def cached_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached rows asked for again: expired, in conflict with what was asked, or valid."""
    ident = F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string"))
    wanted, late = F.when(F.col("event_id") % 7 == 0, "other").otherwise(ident), 1_800_000_000 * (F.col("event_id") % 4)
    fate = F.when(late >= 3_600_000_000, "expired").when(wanted != ident, "conflict").otherwise("valid")
    return table(spark, sf_dir, "events").select("event_id", fate.alias("fate"))  # asked for by the row's own key: one projection


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation), c AS (SELECT n_regionkey, r, unnest([n_nationkey::VARCHAR, n_name || ' & <co>']) AS text, unnest([0, 1]) AS col FROM n)
SELECT n_regionkey, r::INTEGER AS row, col::INTEGER AS "column", text FROM c UNION ALL SELECT DISTINCT n_regionkey, 0, unnest([0, 1]), unnest(['Code', 'Name of the country']) FROM nation""")
def tables_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the table with a wanted id on a page for each region, which has another table before it and one inside a cell."""
    from portolan.sources.html import first_tables

    line = F.concat(F.lit("<tr><td> "), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit(" &amp;\n &lt;co&gt;</td></tr>"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r["line"]), "").alias("lines"))  # a region's few nations
    page = F.concat(F.lit("<html><table id='other'><tr><td>no</td></tr></table><TABLE class=x id=\"wanted\"><tr><th>Code<th>Name of <b>the</b> country</tr>"), "lines", F.lit("</table><table id='wanted'><tr><td>late</td></tr></table>"))
    return first_tables(rows.select("n_regionkey", page.alias("html")), "n_regionkey", "html", table_id="wanted")
