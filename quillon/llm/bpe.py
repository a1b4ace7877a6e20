"""Byte-level BPE encoding and decoding with a segment tree.

The text is cut by the tokenizer's pattern and every piece is merged on its own. A segment tree over the
piece's byte positions stores, in each node, the smallest pair rank below it and, among equals, the
leftmost. Its root is the next merge; a merge changes three leaves (the merged pair, its left neighbour,
the position that dies) and their ancestors, so a piece of n bytes takes O(n log n), however long it is.
Many pieces of similar length are merged side by side, one array row each.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from quillon.llm.common import Numbered, gathered, needs, slices, texts_of

#: Characters that are encoded at a time.
SLICE = 1 << 21
#: Words whose ids a task remembers before it starts anew.
REMEMBERED = 300_000
#: Leaves of all segment trees merged side by side.
LEAVES = 1 << 17
NONE = np.iinfo(np.int64).max
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a tokenizer, with a hash table from a pair of ids to the rank of what they merge to."""

    pattern: str
    ranks: dict[bytes, int]
    byte_ids: np.ndarray
    token_bytes: np.ndarray
    token_ends: np.ndarray
    slots: np.ndarray
    slot_ranks: np.ndarray
    probes: int

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        by_id = [b""] * (max(ranks.values()) + 1)
        keys, values = [], []
        for token, rank in ranks.items():
            by_id[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        size = 1 << max(4, 4 * len(keys) - 1).bit_length()
        shift = np.uint64(65 - size.bit_length())
        slots, slot_ranks, probes = np.full(size, -1, np.int64), np.zeros(size, np.int64), 1
        homes = ((np.array(keys, np.uint64) * MIX) >> shift).astype(np.int64)
        for key, value, home in zip(keys, values, homes.tolist()):
            step = 0
            while slots[(home + step) % size] >= 0:
                step += 1
            slots[(home + step) % size], slot_ranks[(home + step) % size] = key, value
            probes = max(probes, step + 1)
        return cls(
            pattern, ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int64),
            np.frombuffer(b"".join(by_id), np.uint8), np.cumsum([0, *map(len, by_id)]), slots, slot_ranks, probes,
        )

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        """Reads lines of base64 token and rank. Called on the driver, which sends the vocabulary to the tasks."""
        with open(path, "rb") as file:
            return cls.from_ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}, pattern)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where a pair does not merge; an id of -1 stands for no neighbour."""
        out = np.full(len(left), NONE, np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at] << 32 | right[at]
        size = len(self.slots)
        homes = ((keys.view(np.uint64) * MIX) >> np.uint64(65 - size.bit_length())).astype(np.int64)
        for step in range(self.probes):
            place = (homes + step) & (size - 1)
            held = self.slots[place]
            hit = held == keys
            out[at[hit]] = self.slot_ranks[place[hit]]
            rest = ~hit & (held >= 0)
            if not rest.any():
                break
            at, keys, homes = at[rest], keys[rest], homes[rest]
        return out


def merged(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces one after another, and how many each has."""
    count = len(pieces)
    width = 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
    # A node holds rank * width + position, or `none` where nothing below it merges.
    kind = np.int32 if len(vocabulary.token_ends) * width < np.iinfo(np.int32).max else np.int64
    none = np.iinfo(kind).max
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    row = np.repeat(np.arange(count), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Column `width` of each row stands for "no neighbour".
    ids = np.full((count, width + 1), -1, np.int64)
    ids[row, column] = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.minimum(np.arange(1, width + 2, dtype=np.int32), width), (count, 1))
    after[np.arange(count), lengths - 1] = width
    before = np.tile(np.arange(-1, width, dtype=np.int32), (count, 1))
    before[:, 0] = width

    def nodes_of(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = vocabulary.pair_ranks(left, right)
        return np.where(rank == NONE, none, rank * width + at).astype(kind)

    tree = np.full((count, 2 * width), none, kind)
    tree[row, width + column] = nodes_of(ids[row, column], ids[row, column + 1], column)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.flatnonzero(tree[:, 1] != none)
    while len(live):
        rank, at = np.divmod(tree[live, 1].astype(np.int64), width)
        gone = after[live, at]
        ids[live, at], ids[live, gone] = rank, -1
        following = after[live, gone]
        after[live, at] = following
        before[live, following] = at
        tree[live, width + gone] = none
        left = before[live, at].astype(np.int64)
        alone = left == width
        left[alone] = at[alone]
        beside = nodes_of(ids[live, left], ids[live, after[live, left]], left)
        tree[live, width + left] = beside
        tree[live, width + at] = np.where(alone, beside, nodes_of(rank, ids[live, following], at))
        changed = [width + at, width + left, width + gone]
        for _ in range(width.bit_length() - 1):
            changed = [n >> 1 for n in changed]
            for n in changed:
                tree[live, n] = np.minimum(tree[live, 2 * n], tree[live, 2 * n + 1])
        live = live[tree[live, 1] != none]
    kept = ids[:, :width] >= 0
    return ids[:, :width][kept], kept.sum(1)


def piece_ids(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces one after another, and how many each has; a piece that is itself a token is that token."""
    known = np.fromiter((vocabulary.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
    widths = np.fromiter(((len(p) - 1).bit_length() for p in pieces), np.int64, len(pieces))
    whole = np.flatnonzero(known >= 0)
    ids, places, lengths = [known[whole]], [whole], [np.ones(len(whole), np.int64)]
    for bits in np.unique(widths[known < 0]).tolist():
        at = np.flatnonzero((known < 0) & (widths == bits))
        step = max(1, LEAVES >> bits)
        for i in range(0, len(at), step):
            found, count = merged([pieces[p] for p in at[i : i + step]], vocabulary)
            ids.append(found)
            places.append(at[i : i + step])
            lengths.append(count)
    size = np.concatenate(lengths)
    order = np.argsort(np.concatenate(places))
    return gathered(np.concatenate(ids), (np.cumsum(size) - size)[order], size[order]), size[order]


class Encoder:
    """Encodes texts; remembers the ids of the words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cut = regex.compile(vocabulary.pattern).findall
        self.spaces = re.compile(r"\s\s").search
        self.forget()

    def forget(self) -> None:
        self.words = Numbered()
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that the pattern cuts alike alone and in the text.

        A space between two other characters always starts a piece. Texts with white space in a row are cut by the
        pattern as a whole.
        """
        if not text or self.spaces(text):
            return self.cut(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def learn(self, words: list[str]) -> None:
        pieces = [self.cut(word) for word in words]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        found, lengths = piece_ids([p.encode() for some in pieces for p in some], self.vocabulary)
        base = int(self.ends[-1])
        total = np.append(0, np.cumsum(lengths))[np.cumsum(counts)]
        while base + len(found) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[base : base + len(found)] = found
        self.ends = np.concatenate([self.ends, base + total])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n + 1 offsets of the texts in them."""
        if len(self.words) > REMEMBERED:
            self.forget()
        counts, words = [], []
        for text in texts:
            found = self.chunks(text)
            counts.append(len(found))
            words += found
        place = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.new:
            self.learn(self.words.new)
            self.words.new = []
        starts = self.ends[place]
        lengths = self.ends[place + 1] - starts
        return gathered(self.flat, starts, lengths), np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts)).astype(np.int64)]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    ends = vocabulary.token_ends
    return gathered(vocabulary.token_bytes, ends[ids], ends[ids + 1] - ends[ids]).tobytes()


def encoded(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", into: str | None = None) -> DataFrame:
    """(key, ids): the ids of each whole text, without special tokens.

    With `into`, a column of that name holds the bytes that the ids decode to again, made by the same task.

    Null and empty texts have no ids. Rows are independent: repeated rows and keys give repeated results, other columns
    are not read, an empty table gives an empty one.
    """
    needs(docs, key, text)
    narrow = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(list(map(len, texts)), SLICE):
                ids, ends = encoder.encode(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if into:
                    columns.append(pa.array([decode(ids[x:y], shared.value) for x, y in zip(ends.tolist(), ends[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    fields = [narrow.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    schema = T.StructType(fields + ([T.StructField(into, T.BinaryType(), False)] if into else []))
    return narrow.mapInArrow(encode, schema)


def decoded(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`tokens` with the bytes its ids stand for; null ids decode to no bytes. A column named like `into` is replaced."""
    needs(tokens, ids)
    kept = tokens.drop(into)
    place = kept.columns.index(ids)
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def decode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).tolist()
            for a, b in slices(lengths, SLICE):
                texts = [decode(x.values.to_numpy(), shared.value) if x.is_valid else b"" for x in lists.slice(a, b - a)]
                columns = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, into])

    return kept.mapInArrow(decode_all, T.StructType([*kept.schema.fields, T.StructField(into, T.BinaryType(), False)]))


def digests(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): a fixed-size record of what the round trip gave."""
    back = encoded(docs, vocabulary, key, text, into="decoded")
    return back.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
