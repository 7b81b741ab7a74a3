"""Hierarchical multi-length packing of documents into fixed-size training sequences.

Each task cuts whole windows of the longest tier out of its documents and routes what is left to the smallest
tier that holds it. From the longest tier down, a sequence opens with a rest of its own tier and its gap is
filled from shorter tiers, the last filler cut to fit, so that sequences are exactly full; a chunk's final rest
is cut into powers of two. Tasks work on chunks of bounded size; nothing is shuffled and no state is shared.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import freeing

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
SPECIAL = "<|endoftext|>"


def byte_bpe_encoder(json_path: str, ranks_path: str, long_run: int = 2000):
    """text -> uint32 ids equal to those of the tokenizers library for json_path.

    The same vocabulary as ranks encodes several times faster; texts with the special token's string or very
    long runs without a space go to the library itself, whose merging stays near-linear in a run's length.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = []  # loaded for the first text that needs it

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text or len(text) > long_run and max(map(len, text.split()), default=len(text)) > long_run:
            if not library:
                library.append(Tokenizer.from_file(json_path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def pack_chunk(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length)]) that hold each token of each document exactly once."""
    top, out = tiers[0], []
    shelves: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending

    def shelve(doc: int, start: int, n: int) -> None:
        insort(shelves[min((t for t in tiers if t >= n), default=top)], (n, doc, start))

    for doc, n in enumerate(lengths):
        whole = n // top * top
        out += [(top, [(doc, at, top)]) for at in range(0, whole, top)]
        if n > whole:
            shelve(doc, whole, n - whole)
    for level, tier in enumerate(tiers):
        left = sum(x[0] for t in tiers[level:] for x in shelves[t])
        while shelves[tier] and left >= tier:
            n, doc, start = shelves[tier].pop()
            pieces, gap, left = [(doc, start, n)], tier - n, left - tier
            while gap:
                for t in tiers[level:]:  # the longest rest that fits
                    if fit := bisect_left(shelves[t], (gap + 1,)):
                        n, doc, start = shelves[t].pop(fit - 1)
                        break
                else:  # none fits: cut one of the shortest tier that has any
                    n, doc, start = next(shelves[t] for t in reversed(tiers[level:]) if shelves[t]).pop()
                    shelve(doc, start + gap, n - gap)
                    n = gap
                pieces.append((doc, start, n))
                gap -= n
            out.append((tier, pieces))
        if level + 1 < len(tiers):  # too little is left for a full sequence: the shorter tiers take it in parts
            rest, shelves[tier], most = shelves[tier], [], tiers[level + 1]
            for n, doc, start in rest:
                for at in range(0, n, most):
                    shelve(doc, start + at, min(most, n - at))
    tail = [(doc, start, n) for t in tiers for n, doc, start in shelves[t]]
    left = sum(x[2] for x in tail)
    while left:
        size = gap = 1 << left.bit_length() - 1
        pieces = []
        while gap:
            doc, start, n = tail.pop()
            take = min(n, gap)
            pieces.append((doc, start, take))
            gap -= take
            if n > take:
                tail.append((doc, start + take, n - take))
        out.append((size, pieces))
        left -= size
    return out


def step_groups(sequences: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """A group for each sequence: groups hold one tier and the same number of tokens, and pieces are spread evenly."""
    groups, first, by_tier = [0] * len(sequences), 0, {}
    for i, (tier, pieces) in enumerate(sequences):
        by_tier.setdefault(tier, []).append((-len(pieces), i))
    for tier in sorted(by_tier, reverse=True):
        count = -(-len(by_tier[tier]) * tier // step_tokens)
        for rank, (_, i) in enumerate(sorted(by_tier[tier])):
            lap, at = divmod(rank, count)
            groups[i] = first + (at if lap % 2 == 0 else count - 1 - at)
        first += count
    return groups


def pack(docs: DataFrame, json_path: str, ranks_path: str, tiers: tuple[int, ...] = (1024, 512, 256, 128), end_id: int = 0, step_tokens: int = 8192, chunk_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where its tokens stand in the document and in its sequence.

    Documents are the ids of their whole text (null: none) and end_id, so an empty text still has one token.
    Sequences are gapless; each has a power-of-two length of at most tiers[0], so none needs padding. A chunk
    (about chunk_tokens tokens, or one longer document) is packed by itself. Repeated rows are documents of their own.
    sequence_id and step_group are unique over all tasks. An empty table gives no pieces; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode = byte_bpe_encoder(json_path, ranks_path)
        base = TaskContext.get().partitionId() << 36
        sequence = group = base
        held: list[tuple[object, np.ndarray]] = []

        def emit():
            nonlocal sequence, group
            sequences = pack_chunk([len(ids) for _, ids in held], tiers)
            groups, rows = step_groups(sequences, step_tokens), []
            for (tier, pieces), g in zip(sequences, groups):
                offset = 0
                for doc, start, n in pieces:
                    key, ids = held[doc]
                    rows.append((key, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), sequence, offset, tier, group + g))
                    offset += n
                sequence += 1
            group += max(groups, default=-1) + 1
            held.clear()
            columns = list(zip(*rows))
            types = [key_type] + [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        names, total = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))], 0
        for batch in batches:
            key_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                held.append((key, ids))
                total += len(ids)
                if total >= chunk_tokens:
                    yield emit()
                    total = 0
        if held:
            yield emit()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(freeing(run), f"`{id_col}` {kind}, {SCHEMA}")
