"""Many text searches at once over an index of the entries' words.

An entry can only match a search if it holds every word of it somewhere, and so, as words have no blanks, inside a word
of its own. Each search is sent to the entries that hold its rarest word, and what it meets there is scored by the full
rule. A search meets no entry that lacks this word, however many entries share its letters, so the work follows what the
searches match. The index is tables (part of a word, word) and (word, entry), so a common word is many rows, not one
list, and the best few of a search are cut before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grams(text: Column, n: Column) -> Column:
    """All pieces of n letters of a text, in order; none where it is shorter."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def held_words() -> Column:
    """The distinct words of an entry's code, place, name and land."""
    return F.array_distinct(F.filter(F.split(F.concat_ws(" ", "code", "place", "name", "land"), " "), lambda t: t != ""))


def score(query: Column) -> Column:
    """How well an entry matches a search, lower being better, or null: the code, then place and name whole, then their beginnings, then all words anywhere."""
    compact = F.replace(query, F.lit(" "), F.lit(""))
    whole = F.concat_ws(" ", "code", "place", "name", "land")
    place = F.least(*[F.when(F.contains(F.col(c), query), F.instr(F.col(c), query) - 1) for c in ("place", "name")])
    return (
        F.when(F.col("code") == compact, 0).when(F.col("place") == query, 10).when(F.col("name") == query, 12).when(F.startswith(F.col("code"), compact), 18)
        .when(F.startswith(F.col("place"), query), 20).when(F.startswith(F.col("name"), query), 24).when(F.forall(F.split(query, " "), lambda t: F.contains(whole, t)), 40 + F.coalesce(place, F.lit(20)))
    )


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows over as many tasks as a shuffle has, however few bytes they are: few of them can make many pairs."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def meetings(entries: DataFrame, asked: DataFrame, busy: int = 5000) -> DataFrame:
    """query and the columns of entries: every pair of a distinct search and an entry that holds its rarest word, if all its words are held by some entry.

    A word of more than `busy` entries is cut into shares. Parts of words and searches are joined by shuffles: Spark
    takes an explode for one row, so it would broadcast them while their table is small.
    """
    words = asked.select("query", F.explode(F.array_distinct(F.split("query", " "))).alias("word"))
    sizes = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())  # no more numbers than a search may have letters
    held = entries.withColumn("held_", held_words()).select("*", F.posexplode("held_").alias("at_", "token")).withColumn("held_", F.slice("held_", F.lit(1), F.col("at_")))  # the words before it
    tokens = spread(held.groupBy("token").agg(F.count("*").alias("n_")), "token")
    shares = F.ceil(F.col("n_") / busy).cast("int")
    busiest = tokens.filter(F.col("n_") > busy).select("token", shares.alias("shares_"))  # few: all words of the entries over `busy`
    held = held.join(F.broadcast(busiest), "token", "left").withColumn("share_", F.coalesce(F.pmod(F.xxhash64("entry"), F.col("shares_")).cast("int"), F.lit(0)))
    parts = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: grams(F.col("token"), n))))
    holders = tokens.select("token", "n_", F.explode(parts).alias("word")).join(words.select("word").distinct().hint("merge"), "word", "left_semi")
    often = holders.groupBy("word").agg(F.sum("n_").alias("n_"))
    rare = words.join(often.hint("merge"), "word", "left").groupBy("query").agg(F.min_by("word", F.struct("n_", "word")).alias("word"), F.count_if(F.col("n_").isNull()).alias("unknown")).filter("unknown = 0").select("query", "word")
    shared = holders.select("word", "token", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share_"))
    wanted = shared.join(spread(rare, "word").hint("merge"), "word").select("query", "word", "token", "share_")  # the searches of a word are held, its many tokens go by
    met = spread(wanted, "token", "share_").join(spread(held, "token", "share_").hint("merge"), ["token", "share_"])
    met = met.filter((F.col("at_") == 0) | ~F.exists("held_", lambda t: F.contains(t, F.col("word"))))  # once, where several words of an entry hold it
    return met.select("query", *entries.columns)


def search(entries: DataFrame, searches: DataFrame, most: int = 8, longest: int = 60) -> DataFrame:
    """query, rank (from 1), entry, score: at most `most` entries for each distinct search, best first, ties by title, then code, then entry.

    entries has entry (unique), title, and the normal forms code, place, name and land, which may be empty but not null; searches has query in normal form, of which the
    first `longest` letters count. Searches of fewer than two letters, and null ones, find nothing.
    """
    asked = searches.select(F.rtrim(F.substring("query", 1, longest)).alias("query")).filter(F.length("query") >= 2).distinct()
    met = meetings(entries, asked).withColumn("score", score(F.col("query"))).filter("score is not null")
    best = Window.partitionBy("query").orderBy("score", "title", "code", "entry")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("query", "rank", "entry", F.col("score").cast("int").alias("score"))
