"""Near-duplicate detection by an inverted join over MinHash coordinates, confirmed on full shingle sets.

Texts with one shingle set form a class. Each class posts its id under its coordinate-value pairs; pairs that
nobody else posts are dropped, and a class with fewer shared ones than the match threshold has no link at all.
Coordinates are ordered from rare to frequent: two classes that agree on `matches` of `coordinates` must meet
in the first (coordinates - matches + 1), so only that prefix is posted and frequent values are skipped.

A posting list is never expanded into its pairs. Its most connected class (the hub) is compared with the
others first (hub_rounds times); lists that then lie in one component are done. What a class has beside the hub, and what it
lacks of it, tells exactly how much two classes of a list have in common: a pair of which one is not linked to the
hub must share a known number of these differences, so such pairs come from a join over the rarest of them, with
prefix and position filters. Only classes too unlike their hub to be compared with it meet the rest of their list.
Candidates agree on `matches` coordinates at least and links are confirmed on full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from portolan.llm.common import few, flat_words, freeing, materialize, shuffled, text_slices

_draw = random.Random(7)
#: Odd multipliers, one for each coordinate that may be asked for.
MULTIPLIERS = np.array([_draw.getrandbits(64) | 1 for _ in range(256)], dtype=np.uint64)
PLACES = np.array([_draw.getrandbits(64) | 1 for _ in range(16)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of a 64-bit value spread over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after another, the size of each text's set)."""
    from pandas.util import hash_array

    flat, counts = flat_words(text)
    coded = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    coded = coded.dictionary_encode()
    unique = hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    h = unique[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.zeros(len(h), np.uint64)
    for k in range(n):
        made[: len(h) - k] += h[k:] * PLACES[k]
    size = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype))
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        made[starts[i]] = (h[starts[i] : ends[i]] * PLACES[: counts[i]]).sum() + np.uint64(counts[i])
    to = np.cumsum(size)
    kept = np.repeat(starts - (to - size), size) + np.arange(size.sum())
    made = mixed(made[kept])
    for a, b in zip((to - size).tolist(), to.tolist()):
        made[a:b].sort()
    first = np.ones(len(made), bool)
    first[1:] = made[1:] != made[:-1]
    first[(to - size)[size > 0]] = True
    running = np.concatenate(([0], np.cumsum(first)))
    return made[first], running[to] - running[to - size]


def sketches(docs: DataFrame, shingle: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set; null if empty) and sig (coordinates ints; null if empty)."""

    def run(batches):
        import xxhash

        for batch in batches:
            for a, b in text_slices(batch, batch.schema.names[1], 2 << 20):
                hashes, sizes = shingle_sets(batch.column(1).slice(a, b - a), shingle)
                to = np.cumsum(sizes)
                full = np.flatnonzero(sizes)
                keys = [None] * len(sizes)
                for i in full.tolist():
                    keys[i] = xxhash.xxh3_128_digest(hashes[to[i] - sizes[i] : to[i]])
                sig = np.zeros((len(full), coordinates), np.uint32)
                if len(full):
                    edges = (to - sizes)[full]
                    for c in range(coordinates):
                        sig[:, c] = np.minimum.reduceat((hashes * MULTIPLIERS[c]) >> np.uint64(32), edges)
                offsets = np.concatenate(([0], np.cumsum((sizes > 0) * coordinates))).astype(np.int32)
                flat = pa.array(sig.reshape(-1).view(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(sizes == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(freeing(run), f"doc_id {kind}, n_shingles long, set_key binary, sig array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, broadcast_rows: int, id_col: str, text_col: str) -> DataFrame:
    """node, items: the whole set of each wanted (node, first_id, set_key). wanted is a written table."""
    wanted = few(wanted, broadcast_rows)  # some 100 bytes a row; beyond that the texts are shuffled
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(wanted, F.col("id_").eqNullSafe(F.col("first_id")))

    def run(batches):
        import xxhash

        for batch in batches:
            for a, b in text_slices(batch, "text_", 2 << 20):
                part = batch.slice(a, b - a)
                hashes, sizes = shingle_sets(part.column("text_"), shingle)
                to, nodes, parts = np.cumsum(sizes), [], []
                for i, (node, key) in enumerate(zip(part.column("node").to_pylist(), part.column("set_key").to_pylist())):
                    own = hashes[to[i] - sizes[i] : to[i]]
                    if xxhash.xxh3_128_digest(own) == key:  # another row may bear the same id
                        nodes.append(node)
                        parts.append(own)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
                items = pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["node", "items"])

    return texts.select("node", "set_key", "text_").mapInArrow(freeing(run), "node long, items array<bigint>")


def agreeing(a: Column, b: Column) -> Column:
    """On how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)


def components(edges: DataFrame, most_rounds: int = 60, most_small: int = 250_000) -> DataFrame:
    """node, label for each node of edges (a, b): the smallest node that it reaches.

    Each round takes the smallest label around a node, then the label's own label, so that long chains halve. Up to `most_small` ends of edges Spark may broadcast.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    sized = (lambda t: t) if both.count() <= most_small else shuffled  # no table here has more rows
    for _ in range(most_rounds):
        near = both.join(sized(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(sized(near), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        after = materialize(moved.join(sized(jump), "via").select("node", "old", F.least("via", "next").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.filter("label < old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 14, hub_rounds: int = 1, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable), kept, n_links, class_id.

    Texts are linked where 100 * intersection >= percent * union of their shingle sets; `matches` of `coordinates`
    must agree before a link is confirmed: 14 of 32 for 80 % and 16 of 32 for 85 % fail a pair at the threshold
    itself about once in 100,000 times or more seldom, and pairs above it far less. n_links counts
    the confirmed links that were needed to join the text's class to its component, not all links. Null, empty and blank texts have no
    shingles, no links and their own id as component. Rows that repeat an id or a text are documents of their own; a
    null id never names a component unless no other is reachable, and is kept only then. No rows give no rows.
    """
    rows = materialize(sketches(docs, shingle, coordinates, id_col, text_col), "dedup-rows")
    groups = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    classes = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "dedup-classes")

    # postings that somebody shares, and the classes that share enough of them
    posted = classes.select("node", F.posexplode("sig").alias("c", "v")).select("node", (F.shiftleft(F.col("c").cast("bigint"), 32) + F.col("v").cast("bigint") + F.lit(1 << 31)).alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("posts")).filter("posts > 1")
    shared = materialize(posted.join(shuffled(counts), "key"), "dedup-shared")
    by_node = Window.partitionBy("node")
    lists = (
        shared.withColumn("mine", F.count("*").over(by_node)).filter(F.col("mine") >= matches)
        .withColumn("weight", F.sum("posts").over(by_node))
        .withColumn("nth", F.row_number().over(by_node.orderBy("posts", "key")))
        .filter(F.col("nth") <= F.col("mine") - (matches - 1))
    )
    lists = lists.groupBy("node").agg(F.max("weight").alias("weight"), F.collect_list("key").alias("keys"))  # coordinates keys at most
    active = materialize(lists.join(shuffled(classes.select("node", "n", "sig", "set_key", "first_id")), "node"), "dedup-active")
    lists = active.select("node", "weight", "n", F.explode("keys").alias("key"))
    sets = materialize(full_sets(docs, active.select("node", "first_id", "set_key"), shingle, broadcast_rows, id_col, text_col), "dedup-sets")

    def compared(pairs: DataFrame) -> DataFrame:
        """a, b, na, nb, common, own (what a has beside b) and lacking (what it lacks of b) for pairs that agree on enough coordinates."""
        sig = active.select("node", "sig", "n")
        pairs = pairs.join(shuffled(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))), "b")
        pairs = pairs.join(shuffled(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))), "a")
        alike = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        pairs = pairs.filter(alike & (agreeing(F.col("sa"), F.col("sb")) >= matches)).select("a", "b", "na", "nb")
        pairs = pairs.join(shuffled(sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))), "a")
        pairs = pairs.join(shuffled(sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))), "b")
        out = pairs.select("a", "b", "na", "nb", F.array_except("ia", "ib").alias("own"), F.array_except("ib", "ia").alias("lacking"))
        return out.withColumn("common", F.col("na") - F.size("own"))

    linked = F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent
    links, labels, first_hub = None, None, None
    for _ in range(hub_rounds):
        open_lists = lists if labels is None else _open(lists, labels)
        best = F.max(F.struct("weight", F.col("node").alias("id")))
        if labels is None:
            hubs = open_lists.groupBy("key").agg(best.alias("hub"))
            pairs = open_lists.join(shuffled(hubs.select("key", F.col("hub.id").alias("hub"))), "key").filter("node != hub")
        else:  # the best of the classes outside the first hub's component
            first = open_lists.groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("id"), "label")).alias("top"))
            rest = open_lists.join(shuffled(first.select("key", F.col("top.label").alias("done"))), "key")
            hubs = rest.filter("label != done").groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("id"), "label")).alias("hub"))
            pairs = rest.join(shuffled(hubs.select("key", F.col("hub.id").alias("hub"), F.col("hub.label").alias("hub_label"))), "key").filter("node != hub and label != hub_label")
        seen = compared(pairs.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
        seen = materialize(seen if first_hub is None else seen.drop("own", "lacking"), "dedup-hubs")
        first_hub = seen if first_hub is None else first_hub
        found = seen.filter(linked).select("a", "b")
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    hub_of = lists.groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("id"))).alias("hub")).select("key", F.col("hub.id").alias("hub"))
    left = _open(lists, labels).join(shuffled(hub_of), "key").filter("node != hub")
    left = left.join(shuffled(first_hub.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("known")).distinct()), ["node", "hub"], "left")
    left = materialize(left.select("key", "node", "hub", "n", "label", F.coalesce("known", F.lit(False)).alias("known")), "dedup-open")
    here = left.filter("known").groupBy("node", "hub").agg(F.max("label").alias("label"))
    apart = first_hub.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("na").alias("n"), F.col("nb").alias("hub_n"), "own", "lacking").join(shuffled(here), ["node", "hub"])
    near = _sharing_differences(apart, percent)

    # classes that were not compared with the hub meet all others of their lists
    told = shuffled(active.select("node", "sig", "keys"))
    x = left.filter("not known").join(told, "node")
    x, y = (t.select(F.col("key").alias(f"{p}_key"), *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "label", "known", "sig", "keys")]) for t, p in ((x, "x"), (left.join(told, "node"), "y")))
    alike = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    once = F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("x_key")
    one_way = F.col("y_known") | (F.col("x_node") < F.col("y_node"))
    rest = x.join(shuffled(y), (F.col("x_key") == F.col("y_key")) & (F.col("x_label") != F.col("y_label")) & one_way & alike & (agreeing(F.col("x_sig"), F.col("y_sig")) >= matches) & once)
    rest = rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).unionByName(near).distinct()
    seen = compared(rest)
    more = materialize(seen.filter(linked).select("a", "b"), "dedup-more")
    links = links.unionByName(more)
    if not more.isEmpty():
        labels = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = classes.select("node", "set_key", "first_id").join(shuffled(labels), "node", "left").join(shuffled(degree), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named, "dedup-named")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(shuffled(named.join(shuffled(smallest), "label").select("set_key", "component_id", "node", "n_links")), "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("node").alias("class_id"))


def _sharing_differences(apart: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of classes compared with one hub, at least one not linked to it, that may still be linked with each other.

    apart: node, hub, n, hub_n, label, own, lacking. With l lacking and o own shingles let w = 100 l + percent o. A class is
    linked to the hub if w <= (100 - percent) hub_n =: w0, and two classes a, b are linked only if they share
    at least (w_a + w_b - w0) / (100 + percent) of their differences (this is exact: common = hub_n - l_a - l_b + shared).
    From this follow how many an unlinked class, and a partner of one, must share at the least, and so how long a
    prefix of the rarest differences has to be; the places of the first shared one bound what can follow.
    """
    both = 100 + percent
    rows = apart.select("node", "hub", "n", "label", (F.size("lacking") * 100 + F.size("own") * percent).cast("long").alias("w"), (F.col("hub_n") * (100 - percent)).alias("w0"), F.concat("own", "lacking").alias("items"))
    rows = rows.withColumn("size", F.size("items"))
    items = rows.select("node", "hub", "n", "label", "w", "w0", "size", F.explode("items").alias("item"))
    common = items.groupBy("hub", "item").agg(F.count("*").alias("df")).filter("df > 1")  # nothing is shared through the others
    alone = items.join(shuffled(common), ["hub", "item"]).withColumn("mine", F.count("*").over(Window.partitionBy("hub", "node")))
    nth = F.row_number().over(Window.partitionBy("hub", "node").orderBy("df", "item")) + F.col("size") - F.col("mine")  # those of one class stand first
    ranked = alone.withColumn("nth", nth)
    probe = ranked.filter((F.col("w") > F.col("w0")) & (F.col("nth") <= F.col("size") - F.ceil((F.col("w") - F.col("w0")) / 100) + 1))
    index = ranked.filter(F.col("nth") <= F.col("size") - F.floor(F.col("w") / both))
    x, y = (t.select(*[F.col(c).alias(f"{p}_{c}") for c in ("hub", "item", "node", "n", "label", "w", "w0", "size", "nth")]) for t, p in ((probe, "x"), (index, "y")))
    need = F.col("x_w") + F.col("y_w") - F.col("x_w0")
    most = 1 + F.least(F.col("x_size") - F.col("x_nth"), F.col("y_size") - F.col("y_nth"))
    alike = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    on = (F.col("x_hub") == F.col("y_hub")) & (F.col("x_item") == F.col("y_item")) & (F.col("x_label") != F.col("y_label")) & alike & (most * both >= need)
    return x.join(shuffled(y), on).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The posting lists that lie in several components, with each class's label."""
    labelled = lists.join(shuffled(labels.select("node", F.col("label").alias("own_label"))), "node", "left").withColumn("label", F.coalesce("own_label", "node")).drop("own_label")
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return labelled.join(shuffled(several), "key", "left_semi")


def keep_one(docs: DataFrame, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with the columns of docs.

    Ids name documents: rows that repeat one stay or go together, but of those with one id and one text a single row
    stays (any, if their other columns differ).
    """
    verdicts = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = materialize(verdicts.filter("kept").groupBy(F.col(id_col).alias("kept_id_")).agg(F.count("*").alias("rows_")), "dedup-kept")
    columns = [f"c{i}" for i in range(len(docs.columns))]  # no name can clash
    key, text = (F.col(columns[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = docs.toDF(*columns)
    # some 100 bytes an id; beyond that both sides are shuffled
    single = rows.join(few(kept.filter("rows_ = 1"), broadcast_rows), key.eqNullSafe(F.col("kept_id_")), "left_semi")
    several = kept.filter("rows_ > 1")
    if not several.isEmpty():
        alike = rows.join(few(several, broadcast_rows), key.eqNullSafe(F.col("kept_id_")), "left_semi").withColumns({"k1_": F.xxhash64(text), "k2_": F.length(text)})
        single = single.unionByName(alike.dropDuplicates([columns[docs.columns.index(id_col)], "k1_", "k2_"]).drop("k1_", "k2_"))
    return single.toDF(*docs.columns)
