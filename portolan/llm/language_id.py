"""Language identification with a blended-spectrum presence kernel, Nyström landmarks and kernel ridge regression.

A text is the set of its n-grams of bytes, lower-cased, for all n of a range, each hashed to one of `slots`
coordinates; the kernel of two texts is the cosine of their sets. A bounded sample of labelled texts is drawn by
hash, a part of it serves as landmarks, and one ridge regression for each language is fitted on the Nyström
features. As the kernel is an inner product of sets, landmarks and weights fold into one matrix of coordinates by
languages, and whole texts are scored by products of presence matrices with it, many texts at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import fold, freeing, hash_limit, text_slices

UNDETERMINED = "und"
#: Fixed odd multipliers for n-grams of 1, 2, ... bytes.
SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _slots(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The coordinate of the n-gram that starts at each byte."""
    code = raw[: len(raw) - n + 1].astype(np.uint64)
    for k in range(1, n):
        code = (code << np.uint64(8)) | raw[k : len(raw) - n + 1 + k]
    return ((code * SPREAD[n - 1]) >> np.uint64(64 - bits)).astype(np.int32)


def presences(text: pa.Array, grams: tuple[int, ...], bits: int):
    """For each text in turn, the sorted coordinates of its n-grams, padded with a space at both ends."""
    flags = np.zeros(1 << bits, bool)
    for value in pc.utf8_lower(pc.fill_null(text, "")):
        raw = np.frombuffer(b" " + value.as_buffer().to_pybytes() + b" ", np.uint8)
        for n in grams:
            if len(raw) >= n:
                flags[_slots(raw, n, bits)] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str, parts: int, held_out: int) -> DataFrame:
    """At most per_language labelled learning rows of each language: those with the smallest hashes of id and text."""
    learn = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(fold(F.col(id_col), parts), F.lit(-1)) != held_out))
    keyed = learn.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col, id_col).alias("h"))
    # the rows below a hash known from each language's count; a rank then meets few rows more than it keeps
    totals = keyed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # one row a language
    limits = docs.sparkSession.createDataFrame([(r.lang, hash_limit(r.n, per_language)) for r in totals], "of_lang string, most long")
    few = keyed.join(F.broadcast(limits), (F.col("lang") == F.col("of_lang")) & (F.col("h") <= F.col("most"))).select("lang", "h").distinct()
    chosen = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("nth") <= per_language).select("h", "lang")
    picked = learn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col, id_col).alias("h"))
    return picked.join(F.broadcast(chosen), ["h", "lang"]).dropDuplicates(["h", "lang"])  # per_language rows a language at most


class Model:
    """languages, weights (coordinates by languages) and a bias for each language."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray | float = 0.0):
        self.languages, self.weights, self.bias = languages, weights, bias

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        presence = np.zeros((len(sets), len(self.weights)), np.float32)
        for row, found in zip(presence, sets):
            row[found] = 1.0
        size = np.maximum(np.array([len(x) for x in sets], np.float32), 1.0)
        return (presence @ self.weights) / np.sqrt(size)[:, None] + self.bias


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int, ridge: float, bits: int) -> Model:
    """rows: (language, coordinates), in any order."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    languages = sorted({lang for lang, _ in rows})
    if len(languages) < 2:
        return Model(languages, np.ones((1 << bits, len(languages)), np.float32))
    by_language = {lang: [i for i, r in enumerate(rows) if r[0] == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    marks = [i for lang in languages for i in by_language[lang][:: max(1, len(by_language[lang]) // each)][:each]]

    def dense(which):
        out = np.zeros((len(which), 1 << bits), np.float32)
        for row, i in zip(out, which):
            if len(rows[i][1]):
                row[rows[i][1]] = 1.0 / np.sqrt(len(rows[i][1]))
        return out

    basis = dense(marks)
    kernel = np.concatenate([dense(range(a, min(a + 128, len(rows)))) @ basis.T for a in range(0, len(rows), 128)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[marks])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    share = np.array([1.0 / len(by_language[lang]) for lang, _ in rows])[:, None]  # each language weighs the same
    share *= len(rows) / len(languages)
    plain = np.concatenate([features, np.ones((len(rows), 1))], axis=1)
    gram = plain.T @ (plain * share) + ridge * np.diag([1.0] * features.shape[1] + [0.0])
    weights = np.linalg.solve(gram, plain.T @ (target * share))
    return Model(languages, (basis.T @ (root @ weights[:-1])).astype(np.float32), weights[-1].astype(np.float32))


def learn(docs: DataFrame, per_language: int, landmarks: int, ridge: float, grams: tuple[int, ...], bits: int, parts: int, held_out: int, id_col: str, text_col: str, lang_col: str) -> Model:
    """A model from at most per_language rows of each language; their coordinates come to the driver."""

    def found(batches):
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                sets = [x.astype(np.uint32 if bits > 16 else np.uint16).tobytes() for x in presences(batch.column("text").slice(a, b - a), grams, bits)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array(sets, pa.binary())], names=["lang", "found"])

    rows = sample(docs, per_language, id_col, text_col, lang_col, parts, held_out).select("text", "lang").mapInArrow(freeing(found), "lang string, found binary").collect()
    return fit([(r.lang, np.frombuffer(r.found, np.uint32 if bits > 16 else np.uint16)) for r in rows], landmarks, ridge, bits)


def predicted(model: Model, text: pa.Array, grams: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    pred, score = np.full(len(text), UNDETERMINED, dtype=object), np.zeros(len(text))
    if not model.languages:
        return pred, score
    names, sets, at = np.array(model.languages, dtype=object), [], []
    for i, found in enumerate(presences(text, grams, bits)):
        sets.append(found)
        at.append(i)
        if len(sets) == 64 or i == len(text) - 1:
            margin = model.scores(sets)
            exp = np.exp(4.0 * (margin - margin.max(1, keepdims=True)))
            pred[at], score[at] = names[margin.argmax(1)], (exp / exp.sum(1, keepdims=True)).max(1)
            sets, at = [], []
    pred[~known], score[~known] = UNDETERMINED, 0.0
    return pred, score


def identify(docs: DataFrame, per_language: int = 400, landmarks: int = 128, ridge: float = 0.1, grams: tuple[int, ...] = (1, 2, 3), bits: int = 15, parts: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score (0 to 1), one row for each row of docs.

    Learns from at most per_language rows of each label whose crc32(id) mod parts is not held_out. A null text, or one without
    a letter, is `und` with score 0; if there is nothing to learn from, every text is. Ties go to the first label in
    code-point order. Repeated rows get equal results; a null id counts as not held out. Whole texts are used.
    """
    model = learn(docs, per_language, landmarks, ridge, grams, bits, parts, held_out, id_col, text_col, lang_col)

    def predict(batches):
        for batch in batches:
            for a, b in text_slices(batch, batch.schema.names[1], 2 << 20):
                part = batch.slice(a, b - a)
                pred, score = predicted(model, part.column(1), grams, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(fold(F.col(id_col), parts) == held_out, F.lit(False)).alias("held_out")
    return docs.select(F.col(id_col), F.col(text_col), held).mapInArrow(freeing(predict), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, per_language: int = 400, landmarks: int = 128, ridge: float = 0.1, grams: tuple[int, ...] = (1, 2, 3), bits: int = 15, parts: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that `identify` gives a language; all columns stay, and no text is shuffled.

    That is every row with a letter: the model names one of its languages for each. Where there was nothing to learn
    from, the rows with a letter stay too.
    """
    model = learn(docs, per_language, landmarks, ridge, grams, bits, parts, held_out, id_col, text_col, lang_col)

    def keep(batches):
        for batch in batches:
            for a, b in text_slices(batch, text_col, 2 << 20):
                part = batch.slice(a, b - a)
                if not model.languages:
                    yield part.filter(pc.fill_null(pc.match_substring_regex(part.column(text_col), r"\p{L}"), False))
                    continue
                pred, _ = predicted(model, part.column(text_col), grams, bits)
                yield part.filter(pa.array(pred != UNDETERMINED))

    return docs.mapInArrow(freeing(keep), docs.schema)
