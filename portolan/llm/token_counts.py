"""Token counts by a whole-token shortcut.

No piece of the vocabulary holds a space mark behind another character, so merges never cross the start of a
run of spaces and a text's count is the sum over its pre-tokens (spaces with the characters behind them).
Vocabulary strings that encode alone as one token are looked up; only other pre-tokens are merged, and a
table bounded in rows and bytes keeps the counts of those that are short. It is a map over whole texts: no shuffle, no
driver state.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


def whole_tokens(processor) -> dict[str, int]:
    """Pre-tokens (without the first space) proven to be one token; ValueError if merges could cross spaces."""
    found = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i):
            continue
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"a piece spans a space: {piece!r}")
        if piece.startswith(MARK):
            found.append(piece[1:].replace(MARK, " "))
    whole = {x: 1 for x, ids in zip(found, processor.encode(found, num_threads=1)) if len(ids) == 1}
    if "" in found:  # a last single space; by itself the library would read it as an empty text
        whole[""] = 1
    return whole


class TokenCounter:
    """Counts of one model, with a table of the pre-tokens merged so far.

    A text in a script without spaces is one pre-token, so those of more than `longest` code points are not kept; the
    table is emptied when it holds more than `table_rows` entries or about `table_bytes`. Both only cost time.
    """

    ENTRY = 100  # bytes of a table's entry beside its text

    def __init__(self, processor, table_rows: int = 400_000, table_bytes: int = 64 << 20, longest: int = 64):
        self.processor, self.table_rows, self.table_bytes, self.longest = processor, table_rows, table_bytes, longest
        self.whole, self.segment = whole_tokens(processor), re.compile(" *[^ ]+| +$")
        self.table, self.held = dict(self.whole), 0

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:  # would be read as a space
            return len(self.processor.encode(text))
        parts = text.split(" ")
        if "" in parts:
            parts = [x[1:] for x in self.segment.findall(" " + text)]
        found = list(map(self.table.get, parts))
        if None in found:
            rest = list({x for x, n in zip(parts, found) if n is None})
            merged = dict(zip(rest, map(len, self.processor.encode(rest, num_threads=1))))
            found = [merged[x] if n is None else n for x, n in zip(parts, found)]
            for x, n in merged.items():
                if len(x) <= self.longest:
                    self.table[x] = n
                    self.held += sys.getsizeof(x) + self.ENTRY
                    if self.held > self.table_bytes or len(self.table) > len(self.whole) + self.table_rows:
                        self.table, self.held = dict(self.whole), 0
        return sum(found)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, table_rows: int = 400_000, table_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row.

    Counts are those of the sentencepiece model for the whole text, without begin or end tokens. Null texts
    count as empty: zero bytes, zero tokens. Repeated rows give repeated results; other columns are ignored. A long run
    without spaces is merged as a whole each time it comes. `table_rows` and `table_bytes` bound a task's table of merged
    pre-tokens, which only saves time.
    """

    def run(batches):
        import sentencepiece

        counter = TokenCounter(sentencepiece.SentencePieceProcessor(model_file=model_path), table_rows, table_bytes)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(counter.count(text))
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), tokens, pa.array([n > limit for n in n_tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
