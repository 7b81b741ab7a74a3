"""Document probabilities by a subword lattice: the sum over all segmentations into pieces of a fixed vocabulary.

The vocabulary and its scores are those of a sentencepiece model. Its pieces never cross a space, so a text's
lattice falls apart into its words (each with a space mark before it) and the forward recursion, in log space,
runs once for each distinct word. Scores are turned into a prior over pieces and sharpened on the learning texts
by expectation maximisation, with the forward-backward counts of all segmentations of all learning words. A word
met in learning is also an arc of its own. With N tokens, V of them distinct, and r = novelty * V / (N + V), the arc of a
word met c times weighs (1 - r) c / N and the lattice r: a proper mixture, whose share for what is new is a part of the
share of first occurrences, small enough that learning texts are not scored below the add-one estimate.

Words are counted once for each chunk of texts before anything is shuffled; a chunk's dictionary then comes back
to its texts with the score of each of its words. Every step's memory is bounded by a chunk or by the vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import flat_words, fold, materialize, text_slices

MARK = "▁"
NEVER = -1e30


class Lattice:
    """All segmentations of words into pieces. logs: natural log probability of each piece, then of the end."""

    LONG = 48  # longer words are gone through one at a time

    def __init__(self, model_path: str, logs: np.ndarray | None = None, shift: float = 100.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = sp.get_piece_size()
        ids = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.bytes = np.array([i for i in range(self.size) if sp.is_byte(i)])
        self.bytes_of = {int(sp.id_to_piece(int(i))[3:5], 16): int(i) for i in self.bytes}
        if logs is None:  # a better rank, a higher probability; bytes and pieces without a rank come last
            ranks = np.full(self.size + 1, float(self.size))
            ranks[ids] = [min(-sp.get_score(i), self.size) for i in ids]
            weights = 1.0 / (ranks + shift)
            weights[[i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i)]] = 0.0
            logs = np.log(np.maximum(weights / weights.sum(), 1e-300))
        self.logs = logs
        pieces = [(i, sp.id_to_piece(i)) for i in ids]
        self.most = max(len(p) for _, p in pieces)
        keys = np.array([self._key(p) for _, p in pieces], np.uint64)
        self._fill(keys, np.array([i for i, _ in pieces], np.int32))
        self.single = {p: i for i, p in pieces if len(p) == 1}

    BASE = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def _key(cls, piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(cls.BASE) + ord(c) + 1) & (1 << 64) - 1
        return np.uint64(h)

    def _fill(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Hash tables one behind the other; what collides in one goes to the next."""
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one key")
        self.tables = []
        for bits, factor in ((20, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (16, 0x27D4EB2F165667C5), (16, 0x85EBCA77C2B2AE63)):
            slot = ((keys * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table_keys, table_ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            table_keys[slot[first]], table_ids[slot[first]] = keys[first], ids[first]
            self.tables.append((np.uint64(factor), np.uint64(64 - bits), table_keys, table_ids))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ids = keys[rest], ids[rest]
            if not len(keys):
                return
        raise ValueError("pieces collide in every table")

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = None
        for factor, shift, keys, ids in self.tables:
            slot = (h * factor) >> shift
            found = np.where(keys[slot] == h, ids[slot], -1)
            out = found if out is None else np.where(out >= 0, out, found)
        return out

    def _fallback(self, char: int) -> list[int]:
        try:
            raw = chr(char).encode()
        except UnicodeEncodeError:
            raw = "�".encode()
        return [self.bytes_of[b] for b in raw]

    def arcs(self, codes: np.ndarray):
        """codes: words by characters. For each start and length the piece's id (-1: none) and log; spelled: chars without a piece."""
        words, length = codes.shape
        chars, inverse = np.unique(codes, return_inverse=True)
        missing = {int(c): self._fallback(int(c)) for c in chars if chr(c) not in self.single}
        spelled = np.array([sum(self.logs[i] for i in missing[int(c)]) if int(c) in missing else NEVER for c in chars])[inverse.reshape(codes.shape)]
        logs = np.append(self.logs, NEVER)
        found = {}
        values = codes.astype(np.uint64) + np.uint64(1)
        h = np.zeros((words, length), np.uint64)
        for n in range(1, min(self.most, length) + 1):
            h = h[:, : length - n + 1] * self.BASE + values[:, n - 1 :]
            ids = self._find(h)
            log = logs[ids]  # -1 is the last entry
            if n == 1:
                log = np.where(ids >= 0, log, spelled)
            found[n] = ids, log
        return found, missing

    def forward(self, found, words: int, length: int) -> np.ndarray:
        alpha = np.full((length + 1, words), NEVER)
        alpha[0] = 0.0
        for j in range(1, length + 1):
            into = np.stack([alpha[j - n] + found[n][1][:, j - n] for n in range(1, min(j, len(found)) + 1)])
            top = into.max(0)
            alpha[j] = top + np.log(np.exp(into - top).sum(0))
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word with its mark."""
        out = np.empty(len(words))
        for codes, which in self._by_length(words):
            found, _ = self.arcs(codes)
            out[which] = self.forward(found, *codes.shape)[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used over words met `counts` times."""
        total = np.zeros(self.size + 2)
        for codes, which in self._by_length(words):
            found, missing = self.arcs(codes)
            w, length = codes.shape
            alpha = self.forward(found, w, length)
            beta = np.full((length + 1, w), NEVER)
            beta[length] = 0.0
            for i in range(length - 1, -1, -1):
                out = np.stack([beta[i + n] + found[n][1][:, i] for n in range(1, min(length - i, len(found)) + 1)])
                top = out.max(0)
                beta[i] = top + np.log(np.exp(out - top).sum(0))
            for n, (ids, log) in found.items():
                at = np.arange(length - n + 1)
                share = np.exp(alpha[at].T + log + beta[at + n].T - alpha[-1][:, None]) * counts[which][:, None]
                total += np.bincount(ids.reshape(-1) % (self.size + 2), weights=share.reshape(-1), minlength=self.size + 2)  # -1: the last entry
                if n == 1 and missing:
                    bare = ids < 0
                    chars, inverse = np.unique(codes[bare], return_inverse=True)
                    for c, s in zip(chars.tolist(), np.bincount(inverse, weights=share[bare], minlength=len(chars)).tolist()):
                        for i in missing[c]:
                            total[i] += s
        return total[: self.size + 1]

    def _by_length(self, words: list[str], cells: int = 1 << 20):
        """(matrix of characters, the words' places) for words of one length at a time, each with its mark."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, edges):
            if not len(part):
                continue
            size = int(lengths[part[0]]) + 1
            step = max(1, cells // (size * 16))
            for a in range(0, len(part), step):
                which = part[a : a + step]
                text = "".join([MARK + words[i] for i in which.tolist()])
                yield np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(which), size), which


def packed(codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's codes as bytes of seven bits, the last of a code without the high bit."""
    length = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21)
    ends = np.cumsum(length)
    raw = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = length > k
        raw[(ends - length)[has] + k] = ((codes[has] >> 7 * k) & 127) | ((length[has] > k + 1) << 7)
    offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    k = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * k, starts) if len(ends) else np.zeros(0, np.int64)


def gathered(batches, rows: int = 100_000):
    """Batches put together to some rows at least, as work goes by word length."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def chunked(docs: DataFrame, chunk_bytes: int, id_col: str, text_col: str, parts: int, held_out: int) -> DataFrame:
    """Rows of texts (codes: the places of a text's words in its chunk's dictionary) and of dictionaries (words is not null)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in text_slices(batch, batch.schema.names[1], chunk_bytes):
                n, ids, held = b - a, batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a)
                texts = batch.slice(a, n)
                parts = [flat_words(texts.column(1).slice(c, d - c)) for c, d in text_slices(texts, texts.schema.names[1], 2 << 20)]
                counts = np.concatenate([x for _, x in parts])
                flat = [x if isinstance(x, pa.Array) else x.combine_chunks() for x, _ in parts]
                coded = pa.chunked_array(flat).dictionary_encode().combine_chunks() if counts.sum() else flat[0].dictionary_encode()
                del flat
                del parts
                codes, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
                order = np.argsort(-np.bincount(codes, minlength=size), kind="stable")  # frequent words have short codes
                place = np.empty(size, np.int64)
                place[order] = np.arange(size)
                codes, words = place[codes], coded.dictionary.take(pa.array(order)).cast(pa.string())
                learn = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), counts)
                train = np.bincount(codes[learn], minlength=size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), ids, held, packed(codes, counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
                for at in range(0, size, 4096):
                    m = min(4096, size - at)
                    one = pa.array([0, m], pa.int32())
                    lists = pa.ListArray.from_arrays(one, words.slice(at, m)), pa.ListArray.from_arrays(one, pa.array(train[at : at + m]))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, ids.type), pa.array([False]), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()), *lists], names=names)
                chunk += 1

    names = ["chunk", "doc_id", "held_out", "codes", "first", "words", "train"]
    held = F.coalesce(fold(F.col(id_col), parts) == held_out, F.lit(False)).alias("held_out")
    return docs.select(F.col(id_col), F.col(text_col), held).mapInArrow(run, f"chunk long, doc_id {kind}, held_out boolean, codes binary, first int, words array<string>, train array<bigint>")


def learned(words: DataFrame, model_path: str, rounds: int, prior: float, ends: int) -> np.ndarray:
    """Log probabilities of the pieces and of the end after some rounds over (word, c). One row a piece comes to the driver."""
    start = Lattice(model_path)
    base = np.exp(start.logs)
    logs = start.logs
    for _ in range(rounds):

        def expect(batches, logs=logs):
            lattice = Lattice(model_path, logs)
            total = np.zeros(lattice.size + 1)
            for batch in gathered(batches):
                total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

        found = words.select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = prior * base
        for r in found:
            total[r.piece] += r.n
        total[-1] += ends
        logs = np.log(np.maximum(total / total.sum(), 1e-300))
    return logs


def score_documents(docs: DataFrame, model_path: str, rounds: int = 2, prior: float = 1000.0, novelty: float = 0.25, chunk_bytes: int = 16 << 20, most_tasks: int = 20_000, parts: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score (all log10) for each row of docs.

    Learns from the rows whose crc32(id) mod parts is not held_out. Words are runs without ASCII white space, A-Z
    lower-cased; each text ends with one more token. base_score adds one to each count; score is the mixture, lattice_score
    the subword lattice alone. Null, empty and blank texts are just the end. Repeated rows count as often as they come;
    a null id counts as not held out. With nothing to learn from, the prior alone scores. Other columns are ignored.
    Texts meet their words' scores in as many tasks as there are chunks, most_tasks at most (then several chunks a task, one after another).
    """
    tokens = materialize(chunked(docs, chunk_bytes, id_col, text_col, parts, held_out), "lm-tokens")
    entries = tokens.filter("words is not null").select("chunk", "first", F.posexplode(F.arrays_zip("words", "train")).alias("at", "e"))
    entries = entries.select("chunk", (F.col("first") + F.col("at")).cast("int").alias("code"), F.col("e.words").alias("word"), F.col("e.train").alias("n"))
    words = materialize(entries.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    texts = tokens.filter("words is null")
    ends, chunks = texts.agg(F.count_if(~F.col("held_out")), F.count_distinct("chunk")).first()
    tasks = min(max(chunks, 1), most_tasks)  # a chunk or some of them a task, whatever the session's number of partitions
    distinct, seen = words.filter("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = seen + ends, distinct + (ends > 0)
    logs = learned(words.filter("c > 0"), model_path, rounds, prior, ends)
    rest = novelty * v / (n + v) if n else 1.0
    arc = (1.0 - rest) / n if n else 0.0

    def of(c: np.ndarray, log: np.ndarray):
        """log10 of the add-one estimate and of the mixture, from counts and natural logs of the lattice."""
        base = np.log10((c + 1.0) / (n + v + 1.0))
        alone = (log + math.log(max(rest, 1e-300))) / math.log(10)
        mixed = np.log10(np.maximum(c * arc + rest * np.exp(np.maximum(log, -700.0)), 1e-300))
        return base, np.where((c == 0) & (log < -690), alone, mixed)  # below the smallest double

    def score_words(batches):
        lattice = Lattice(model_path, logs)
        for table in gathered(batches):
            log = lattice.log_probability(table.column("word").to_pylist())
            yield from pa.table({"word": table.column("word"), "c": table.column("c"), "log": pa.array(log)}).to_batches()

    # each word is scored once; a word has one row in each chunk that holds it, never more
    scored = materialize(words.mapInArrow(score_words, "word string, c long, log double"), "lm-scores")
    values = entries.join(scored, "word").select(F.col("chunk").alias("of_chunk"), "code", "c", "log")
    (end_base,), (end_score,) = of(np.array([float(ends)]), np.array([logs[-1]]))
    end_lattice, end_known = float(logs[-1]) / math.log(10), int(ends > 0)
    id_kind = docs.schema[id_col].dataType.simpleString()

    def together(texts: pa.Table, values: pa.Table) -> pa.Table:
        texts, values = texts.combine_chunks(), values.combine_chunks()
        code = values.column("code").to_numpy()
        c, log = np.zeros(len(code)), np.zeros(len(code))
        c[code], log[code] = values.column("c").to_numpy().astype(float), values.column("log").to_numpy()
        tables = (c > 0, *of(c, log), log / math.log(10))
        sums, counts = np.zeros((4, len(texts))), np.zeros(len(texts), np.int64)
        for i, raw in enumerate(texts.column("codes")):
            own = unpacked(np.frombuffer(raw.as_buffer(), np.uint8))
            counts[i] = len(own)
            for total, table in zip(sums, tables):
                total[i] = table[own].sum()
        known, base, score, lattice = sums
        return pa.table({id_col: texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(counts + 1), "n_known": pa.array(known.astype(np.int64) + end_known), "train_tokens": pa.array(np.full(len(texts), n), pa.int64()), "base_score": pa.array(base + end_base), "score": pa.array(score + end_score), "lattice_score": pa.array(lattice + end_lattice)})

    schema = f"`{id_col}` {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    left = texts.select("chunk", "doc_id", "held_out", "codes").repartition(tasks, "chunk").groupBy("chunk")
    return left.cogroup(values.repartition(tasks, "of_chunk").groupBy("of_chunk")).applyInArrow(together, schema)
