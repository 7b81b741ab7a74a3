"""One-permutation MinHash fingerprints in DataFrame functions only.

Every five-word shingle is hashed once; the top bits choose a bin, the bin keeps its smallest hash. Empty bins
are filled by optimal densification: each follows its own fixed pseudo-random walk over all bins to the first
that was filled by the text itself. The low bits of each bin are packed into longs, and the likeness of two
fingerprints is their share of equal bins, corrected for the bins that agree by chance.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import let, words

BINS, BITS, SHINGLE = 256, 4, 5
#: Walk of bin j: (offset[j] + t * stride[j]) mod BINS; odd strides visit every bin.
_draw = random.Random(20)
OFFSET = [_draw.randrange(BINS) for _ in range(BINS)]
STRIDE = [2 * _draw.randrange(BINS // 2) + 1 for _ in range(BINS)]
INVERSE = [pow(s, -1, BINS) for s in STRIDE]


#: Up to so many filled bins, empty ones look for the soonest of them.
FEW = 32


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of a text's n-word shingles; of all its words as one, if they are fewer; none without words."""
    return let(
        words(text),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < n, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))),
    )


def _bin(h: Column) -> Column:
    """The bin of a hash, in the order of signed longs."""
    return F.shiftright(h, 64 - (BINS - 1).bit_length()) + BINS // 2


#: The largest hash of each bin; sorted among a text's hashes, it comes first only where the bin is empty.
SENTINELS = [((b - BINS // 2 + 1) << 64 - (BINS - 1).bit_length()) - 1 for b in range(BINS)]


def _dense(hashes: Column) -> Column:
    """Low bits of the smallest hash of each bin, -1 where it is empty."""
    sentinels = F.array(*[F.lit(x).cast("bigint") for x in SENTINELS])
    low = (1 << BITS) - 1
    empty = (1 << 64 - (BINS - 1).bit_length()) - 1

    def value(h: Column) -> Column:
        return F.when(h.bitwiseAND(F.lit(empty)) == empty, F.lit(-1)).otherwise(h.bitwiseAND(F.lit(low)).cast("int"))

    return let(
        F.sort_array(F.concat(hashes, sentinels)),
        lambda h: F.transform(F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))), value),
    )


def _densified(dense: Column) -> Column:
    """Each empty bin takes the value of the first bin of its walk that the text has filled.

    With few filled bins, the first one on a walk is the one that the walk reaches soonest, by the stride's inverse;
    with many, all walks go on together, and bins still empty are listed apart, so that a round costs as much as is
    left to fill. Both give the same values.
    """
    low = (1 << BITS) - 1

    def soonest(filled: Column) -> Column:
        def one(v: Column, j: Column) -> Column:
            at = F.struct(F.get(_ints(OFFSET), j).alias("o"), F.get(_ints(INVERSE), j).alias("i"))
            reach = lambda w: F.array_min(F.transform(filled, lambda c: F.shiftleft(((F.shiftright(c, BITS) - w["o"]) * w["i"]).bitwiseAND(F.lit(BINS - 1)), BITS) + c.bitwiseAND(F.lit(low))))
            return F.when(v >= 0, v).otherwise(let(at, reach).bitwiseAND(F.lit(low)))

        return F.transform(dense, one)

    def fill(acc: Column, t: Column) -> Column:
        def one(j: Column) -> Column:
            at = (F.get(_ints(OFFSET), j) + F.get(_ints(STRIDE), j) * t).bitwiseAND(F.lit(BINS - 1))
            return let(F.get(dense, at), lambda v: F.when(v >= 0, F.shiftleft(j, BITS) + v).otherwise(-1 - j))

        def moved(codes: Column) -> Column:
            left = F.transform(F.filter(codes, lambda c: c < 0), lambda c: -1 - c)
            return F.struct(left.alias("left"), F.concat(acc["done"], F.filter(codes, lambda c: c >= 0)).alias("done"))

        return F.when(F.size(acc["left"]) == 0, acc).otherwise(let(F.transform(acc["left"], one), moved))

    def walked(codes: Column) -> Column:
        left = F.transform(F.filter(codes, lambda c: c < 0), lambda c: -1 - c)
        start = F.struct(left.alias("left"), F.filter(codes, lambda c: c >= 0).alias("done"))
        some = F.aggregate(F.sequence(F.lit(0), F.lit(15)), start, fill)  # enough for most texts
        rest = lambda acc: F.when(F.size(acc["left"]) == 0, acc).otherwise(F.aggregate(F.sequence(F.lit(16), F.lit(BINS - 1)), acc, fill))
        return let(let(some, rest), lambda acc: F.transform(F.sort_array(acc["done"]), lambda c: c.bitwiseAND(F.lit(low))))

    def run(codes: Column) -> Column:
        filled = F.filter(codes, lambda c: c >= 0)
        return let(filled, lambda f: F.when(F.size(f) == BINS, dense).when(F.size(f) <= FEW, soonest(f)).otherwise(walked(codes)))

    codes = F.transform(dense, lambda v, j: F.when(v >= 0, F.shiftleft(j, BITS) + v).otherwise(-1 - j))
    return let(codes, run)


def fingerprint(text: Column) -> Column:
    """Packed low-order bits as an array of longs; empty for a text without words."""
    per = 64 // BITS

    def pack(dense: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // per - 1)),
            lambda g: F.aggregate(F.slice(dense, g * per + 1, F.lit(per)), F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.cast("bigint"))),
        )

    return let(
        shingle_hashes(text),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(let(let(_dense(h), _densified), pack)),
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; 1 for two texts without words, 0 for just one."""
    lowest = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        folded = let(x.bitwiseXOR(y), lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseOR(F.shiftrightunsigned(v, 3)))
        return F.bit_count(folded.bitwiseAND(lowest))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, v: s + v)
    chance = 1.0 / (1 << BITS)
    corrected = ((1.0 - unequal / F.lit(float(BINS))) - chance) / (1.0 - chance)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


#: Code points of a text by which the rows of one id are dealt to ranges.
HEAD = 64


def _count(bound: Column, size: int, holds: Callable[[Column], Column]) -> Column:
    """How many of the first of `size` bounds hold, by binary search; those that hold come first."""
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    return F.aggregate(_ints(steps), F.lit(0), lambda acc, s: F.when(F.coalesce(holds(F.get(bound, acc + s - 1)), F.lit(False)), acc + s).otherwise(acc))


def _count_above(edges: list[int], key: Column) -> Column:
    """How many of the descending edges are above key."""
    return _count(F.array(*[F.lit(e).cast("bigint") for e in edges]), len(edges), lambda e: e > key) if edges else F.lit(0)


def _lanes(docs: DataFrame, key: Column, head: Column, crowded: dict[int, int]) -> Column:
    """The place of a row's head among about crowded[key] ranges of equal shares, from 1; 0 for other keys. Bounds come from a sample of some heads for each range."""
    rows = docs.filter(key.isin(list(crowded)))
    share = min(1.0, 16 * sum(crowded.values()) / max(1, rows.count()))
    heads: dict[int, list[str]] = {k: [] for k in crowded}
    for r in rows.sample(share, 1).select(key.alias("k"), head.alias("h")).collect():
        heads[r.k].append(r.h)
    lane = F.lit(0)
    for k, found in heads.items():
        found.sort()
        cuts = sorted({found[len(found) * i // crowded[k]] for i in range(1, crowded[k])}) if found else []
        place = _count(F.array(*map(F.lit, cuts)), len(cuts), lambda e: e <= head) if cuts else F.lit(0)
        lane = F.when(key == k, 1 + place).otherwise(lane)
    return lane


def with_next(docs: DataFrame, bucket_rows: int = 1024, id_col: str = "doc_id", carry: tuple[str, ...] = ("text", "packed")) -> DataFrame:
    """docs with next_<column>: the value in the row after it by descending id; after the last row, the first's.

    Rows are dealt by ranges of ids (sampled bounds, as many as the rows ask for) and the first row of a range is
    also sent to the end of the range before it, so that one shuffle and a window in each range suffice. Equal
    ids stand in the order of the first carried column, a text; null ids come last. An id that fills ranges by itself, null
    among them, is dealt by the first code points of its texts; only rows that agree in these too share a range for sure.
    """
    key, head = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))), F.substring(carry[0], 1, HEAD)
    rows = docs.count()
    count = max(1, -(-rows // max(bucket_rows, int(rows**0.5))))  # a range has the root of the rows, so that bounds and ranges both fit a task
    quantiles = (docs.agg(F.percentile_approx(key, [i / count for i in range(1, count)], max(10_000, 4 * count))).first()[0] or []) if count > 1 else []
    edges = sorted(set(quantiles), reverse=True)
    crowded = {k: n for k, n in Counter(quantiles).items() if n > 1}
    # range b holds keys k with edges[b-1] > k >= edges[b]: as many edges above k as b, and a crowded key comes last there
    lane = _lanes(docs, key, head, crowded) if crowded else F.lit(0)
    part = F.shiftleft(_count_above(edges, key).cast("bigint"), 24) + lane
    placed = docs.withColumns({"part_": part, "key_": key, "head_": F.when(key.isin(list(crowded)), head).otherwise("") if crowded else F.lit("")})
    tops = placed.groupBy("part_").agg(F.min(F.struct((-1 - F.col("key_")).alias("k"), F.col("head_").alias("h"))).alias("top"))
    tops = sorted((r.part_, -1 - r.top.k, r.top.h) for r in tops.collect())  # one row for each range
    ghosts = [(at, top, first, tops[i - 1][0]) for i, (at, top, first) in enumerate(tops)]
    ghosts = F.broadcast(docs.sparkSession.createDataFrame(ghosts, "at_ bigint, top_ bigint, first_ string, before_ bigint"))
    placed = placed.join(ghosts, (F.col("part_") == F.col("at_")) & (F.col("key_") == F.col("top_")) & (F.col("head_") == F.col("first_")), "left")
    own, ghost = F.struct(F.col("part_").alias("b"), F.lit(0).alias("ghost")), F.struct(F.col("before_").alias("b"), F.lit(1).alias("ghost"))
    placed = placed.withColumn("place_", F.explode(F.when(F.col("before_").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    placed = placed.select(*docs.columns, "key_", F.col("place_.b").alias("part_"), F.col("place_.ghost").alias("ghost_"))
    order = Window.partitionBy("part_").orderBy(F.col("ghost_"), F.col("key_").desc(), F.col(carry[0]))
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).filter("ghost_ = 0").drop("part_", "ghost_", "key_")


def edited_pairs(docs: DataFrame, bucket_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: the last floor(n / 3) code points replaced by the next text's first.

    Null texts count as empty. A text without words has an empty fingerprint, likeness 1 to another such text
    and 0 to others. Repeated ids are ordered by text. An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chained = with_next(texts.withColumn("packed", fingerprint(F.col("text"))), bucket_rows, id_col="doc_id")
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    out = chained.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "packed", "next_packed", F.explode(F.array(edited)).alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "packed", "next_packed", F.explode(F.array(fingerprint(F.col("edited")))).alias("edited_packed"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("packed")).alias("fingerprint"), as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
