"""BPE encoding and decoding in batched merge rounds.

A batch's texts are cut where a space follows what is no white space, which no pre-token crosses, by arithmetic on their
bytes; each distinct part is cut into pre-tokens once, and each distinct one of those is encoded once. The symbols of all of them stand in one
flat array. In each round the pairs of neighbours that may merge are looked up in the sorted keys of the merge rules
by binary search, and every word merges its pairs of the lowest rank, from the left. A word longer than the longest token
is cut into blocks of that length for this: a pair merges where no lower one stands in its own block or the ones beside
it, since no token could reach across. So a run of a million letters takes few rounds too, and gives the same ids.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import freeing, text_slices

NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Rules:
    """A byte-level vocabulary as arrays: keys of mergeable pairs in order, their ranks, the symbol that each rank makes, the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, steps = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or not steps["use_regex"] or data["normalizer"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in data["added_tokens"]):
            raise ValueError("added tokens must stand for their strings alone")
        letters, vocab = byte_letters(), model["vocab"]
        self.size = 1 + max(*vocab.values(), *self.special.values(), 0)
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.reach = max(map(len, self.bytes))
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where no rule merges it."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)


def merged(rules: Rules, content: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each) from the words' bytes one after another and their lengths."""
    symbols, word = rules.first[content], np.repeat(np.arange(len(lengths)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank = np.full(len(symbols), NONE, np.int32)  # of the pair that begins at each place
    if len(symbols) > 1:
        rank[:-1] = np.where(word[1:] == word[:-1], rules.rank(symbols[:-1], symbols[1:]), NONE)
    while len(symbols):
        place = np.arange(len(symbols))
        begins = np.r_[True, word[1:] != word[:-1]]
        inside = place - np.maximum.accumulate(np.where(begins, place, 0))
        starts = np.flatnonzero(inside % rules.reach == 0)
        low, of = np.minimum.reduceat(rank, starts), word[starts]
        beside = low.copy()
        if len(low) > 1:
            same = of[1:] == of[:-1]
            beside[1:] = np.where(same, np.minimum(beside[1:], low[:-1]), beside[1:])
            beside[:-1] = np.where(same, np.minimum(beside[:-1], low[1:]), beside[:-1])
        block = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(symbols)]))
        if rules.reach and (low == NONE).any():
            live = np.zeros(len(lengths), bool)
            live[of[low < NONE]] = True
            if (stays := live[word]).mean() < 0.8:  # finished words leave the flat array
                done.append((word[~stays], symbols[~stays]))
                symbols, word, rank = symbols[stays], word[stays], rank[stays]
                continue
        allowed = (rank < NONE) & (rank == beside[block])
        if not allowed.any():
            done.append((word, symbols))
            break
        # of equal pairs that overlap the first one merges, if it may itself, then every second
        run = np.maximum.accumulate(np.where(np.r_[True, rank[1:] != rank[:-1]], place, 0))
        takes = np.flatnonzero(allowed & ((place - run) % 2 == 0) & allowed[run])
        symbols[takes] = rules.made[rank[takes]]
        keep = np.ones(len(symbols), bool)
        keep[takes + 1] = False
        now = np.cumsum(keep) - 1
        symbols, word, rank = symbols[keep], word[keep], rank[keep]
        stale = np.zeros(len(symbols) + 1, bool)  # the merged symbols' pairs and the ones before them; the last place is for none before
        stale[now[takes]] = stale[now[takes] - 1] = True
        changed = np.flatnonzero(stale[:-1])
        inner = changed[changed < len(symbols) - 1]
        rank[changed] = NONE
        rank[inner] = np.where(word[inner] == word[inner + 1], rules.rank(symbols[inner], symbols[inner + 1]), NONE)
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    word, symbols = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=len(lengths))


def cut_places(content: np.ndarray) -> np.ndarray:
    """Places of spaces (of UTF-8 bytes) behind a character that is surely no white space: of one byte, or of two whose first is above 0xC2."""
    space = np.flatnonzero(content[1:] == 32) + 1
    before = content[space - 1]
    lead = np.where(space > 1, content[space - 2], 0)
    plain = (before > 32) & (before < 127)
    return space[plain | ((before >= 128) & (lead > 0xC2) & (lead < 0xE0))]


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str, chunk_bytes: int = 4 << 20):
        import public_tokenizers
        import regex

        self.rules, self.chunk = Rules(path), chunk_bytes
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cuts = not any(any(c.isspace() for c in t) for t in self.rules.special)  # a special token with a space could stand across a cut
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.rules.special, key=len, reverse=True))) or r"(?!)")

    def pieces(self, text: str) -> tuple[list[str | None], list[int]]:
        """(pre-tokens in order, None in place of a special token's string; the ids of those)."""
        if not self.special.search(text):
            return self.words.findall(text), []
        out, ids, at = [], [], 0
        for found in self.special.finditer(text):
            out += self.words.findall(text[at : found.start()])
            out.append(None)
            ids.append(self.rules.special[found[0]])
            at = found.end()
        return out + self.words.findall(text[at:]), ids

    def ids(self, pieces: list[str | None], special: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each piece)."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary())
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, counts = merged(self.rules, np.frombuffer(b"".join(words.to_pylist()), np.uint8), lengths)
        starts = np.cumsum(counts) - counts
        if special:  # each is one id behind all words
            which = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            which[which < 0] = len(words) + np.arange(len(special))
            starts, counts, ids = np.append(starts, len(ids) + np.arange(len(special))), np.append(counts, np.ones(len(special), np.int64)), np.append(ids, special)
        else:
            which = coded.indices.to_numpy(zero_copy_only=False)
        n = counts[which]
        ends = np.cumsum(n)
        return ids[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32), n

    def flat(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); a null text has none."""
        text = pc.fill_null(text.cast(pa.large_string()), "")
        out, counts, at = [], [], 0
        lengths = pc.binary_length(text).to_numpy(zero_copy_only=False)
        turn = np.cumsum(lengths) // self.chunk  # about `chunk` bytes at a time; a longer text is a turn of its own
        for stop in [*(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(text)]:
            if stop - at == 1 and lengths[at] > self.chunk:
                ids = self.encode_long(text[at].as_py())
                out.append(ids)
                counts.append(np.array([len(ids)]))
            elif stop > at:
                ids, n = self.parts_to_ids(text.slice(at, stop - at))
                out.append(ids)
                counts.append(n)
            at = stop
        return np.concatenate(out or [np.zeros(0, np.int32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def parts_to_ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: ends[-1]]
        content = whole[ends[0] :]
        cuts = (cut_places(content) if self.cuts else np.zeros(0, np.int64)) + ends[0]
        starts = np.sort(np.concatenate((ends[:-1], cuts, ends[-1:])), kind="stable")  # places met twice make empty parts
        parts = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), text.buffers()[2]])
        coded = parts.dictionary_encode()
        pieces, special, sizes = [], [], []
        plain = not any(pc.any(pc.match_substring(coded.dictionary, t)).as_py() for t in self.rules.special)
        for part in coded.dictionary.to_pylist():
            mine, own = (self.words.findall(part), []) if plain else self.pieces(part)
            pieces += mine
            special += own
            sizes.append(len(mine))
        ids, n = self.ids(pieces, special)
        last = np.cumsum(np.append(0, n))[np.cumsum(np.append(0, sizes)).astype(np.int64)]  # where each distinct part's ids begin
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = np.diff(last)[which]
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        out = ids[np.repeat(last[which] - stops + n, n) + np.arange(total)]
        return out, np.diff(np.append(0, stops)[np.searchsorted(starts, ends)])

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of a text of any length; its pre-tokens are encoded in chunks of about `chunk` letters."""
        pieces, own = self.pieces(text)
        out, step = [], max(1, len(pieces) * self.chunk // max(len(text), self.chunk))
        for at in range(0, max(1, len(pieces)), step):
            part = pieces[at : at + step]
            mine = part.count(None) if own else 0
            out.append(self.ids(part, own[:mine])[0])
            own = own[mine:]
        return np.concatenate(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, n = self.flat(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []


def encode(docs: DataFrame, json_path: str, text_col: str = "text") -> DataFrame:
    """docs with `ids` (array<int>): the ids of each whole text as the tokenizers library gives them, without added special tokens.

    A special token's string inside a text becomes its id, as the library does by default. Null texts count as empty: no
    ids. Other columns stay, whatever their names; a column of the name ids comes twice. An empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema)) + ", ids_ array<int>"

    def run(batches):
        encoder = Encoder(json_path)
        for whole in batches:
            for a, b in text_slices(whole, text):
                batch = whole.slice(a, b - a)
                ids, n = encoder.flat(batch.column(text))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, n)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "ids_"])

    return docs.toDF(*names).mapInArrow(freeing(run), schema).toDF(*docs.columns, "ids")


def decode(rows: DataFrame, json_path: str, ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`: the text of the ids, special tokens kept; bytes that are no UTF-8 become U+FFFD. Null ids count as none.

    ValueError for an id outside the vocabulary. Other columns stay, whatever their names.
    """
    names = [f"c{i}" for i in range(len(rows.columns))]
    ids = names[rows.columns.index(ids_col)]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema)) + ", decoded_ string"

    def run(batches):
        rules = Rules(json_path)
        tokens = pa.array(rules.bytes, pa.large_binary())
        for whole in batches:
            # at most about eight million ids at a time
            lengths = pc.fill_null(pc.list_value_length(whole.column(ids)), 0).to_numpy(zero_copy_only=False)
            turn = np.cumsum(lengths) // (8 << 20)
            for a, b in zip(starts := [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist()], [*starts[1:], len(whole)]):
                batch = whole.slice(a, b - a)
                n = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
                found = batch.column(ids).flatten()
                at = found.to_numpy(zero_copy_only=False)
                if len(at) and (at.min() < 0 or at.max() >= rules.size):
                    raise ValueError("an id is outside the vocabulary")
                joined = tokens.take(found)  # the tokens' bytes one after another, of which each row has a range
                ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[np.cumsum(np.append(0, n))] if len(joined) else np.zeros(len(batch) + 1, np.int64)
                texts = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends), joined.buffers()[2]])
                try:
                    texts = texts.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:  # bytes that are no UTF-8
                    texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, "decoded_"])

    return rows.toDF(*names).mapInArrow(freeing(run), schema).toDF(*rows.columns, "decoded")


def round_trip(docs: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of each whole text, from its ids and from what they decode to."""
    coded = encode(docs.select(F.col(id_col), F.col(text_col)), json_path, text_col).drop(text_col)
    both = decode(coded, json_path)
    return both.select(
        F.col(id_col), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
