"""Importance resampling of documents towards a target distribution.

Words and runs of two and three words are hashed into buckets by CRC-32. Bucket counts of all documents
and of the target give each bucket a gain; a document's weight is the sum of the gains of its features,
looked up in one array of bucket gains. Random keys added to the weights make the highest scores a sample
without replacement.

The cutoff is found without a global sort, by weighted medians of medians: every partition reports the
median of its open keys and how many it has; the median of those medians, weighted by these sizes, has
at least a quarter of all open keys on either side, so every round discards a guaranteed fraction, until
one key is left. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillon.llm.common import bytes_of, drop_folder, needs, shared_folder, shared_table, slices

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
#: Bytes hashed at a time; a block ends between words, so only a longer word makes a longer block.
BLOCK = 1 << 20
#: Words up to this many bytes are hashed by table, longer ones one at a time.
SHORT = 64
#: The open keys are written anew when they are this many times fewer than those of the last writing.
SHRUNK = 16
NO_ID = np.iinfo(np.int64).max
#: The key's name while other columns are made beside it.
KEY = "_key"


def _byte_table() -> np.ndarray:
    """CRC-32 states after one byte, from state zero and without the closing complement."""
    return np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


class Crc:
    """CRC-32 of words and of joined words, for many at a time.

    Without its fixed start and end, the code is linear: the state of two joined strings is the state of the first
    moved on by as many zero bytes as the second is long, xor that of the second.
    """

    def __init__(self):
        one = _byte_table()
        # by_place[r][b]: state of byte b followed by r zero bytes; it also moves any state, byte by byte.
        by_place = [one]
        for _ in range(SHORT + 4):
            last = by_place[-1]
            by_place.append(one[last & 0xFF] ^ last >> np.uint32(8))
        self.by_place = np.stack(by_place)
        # moves[n][i][b]: a state whose i-th byte is b, moved on by n zero bytes.
        own = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        steps = [own]
        for _ in range(SHORT):
            last = steps[-1]
            steps.append(one[last & 0xFF] ^ last >> np.uint32(8))
        self.moves = np.stack(steps)
        powers = [self.moves[SHORT]]
        for _ in range(40):
            powers.append(self._with(powers[-1], powers[-1]))
        self.powers = powers
        self.space = one[0x20]
        self.ends = self.moved(np.full(1024, 0xFFFFFFFF, np.uint32), np.arange(1024)) ^ np.uint32(0xFFFFFFFF)

    @staticmethod
    def _with(table: np.ndarray, state: np.ndarray) -> np.ndarray:
        return table[0][state & 0xFF] ^ table[1][state >> 8 & 0xFF] ^ table[2][state >> 16 & 0xFF] ^ table[3][state >> 24]

    def moved(self, state: np.ndarray, by: np.ndarray) -> np.ndarray:
        """States moved on by `by` zero bytes each."""
        rest = by % SHORT
        flat = self.moves.reshape(-1)
        base = rest * 1024
        out = flat[base + (state & 0xFF)] ^ flat[base + 256 + (state >> 8 & 0xFF)] ^ flat[base + 512 + (state >> 16 & 0xFF)] ^ flat[base + 768 + (state >> 24)]
        times = by // SHORT
        far = np.flatnonzero(times)
        level = 0
        while far.size:
            odd = far[times[far] >> level & 1 == 1]
            out[odd] = self._with(self.powers[level], out[odd])
            level += 1
            far = far[times[far] >> level > 0]
        return out

    def closed(self, state: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The usual CRC-32 of strings of these states and sizes."""
        out = state ^ self.ends[np.minimum(size, len(self.ends) - 1)]
        far = np.flatnonzero(size >= len(self.ends))
        if far.size:
            out[far] = state[far] ^ self.moved(np.full(far.size, 0xFFFFFFFF, np.uint32), size[far]) ^ np.uint32(0xFFFFFFFF)
        return out

    def states(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """States of the words data[start : start + size], which come in order."""
        out = np.zeros(len(start), np.uint32)
        short = np.flatnonzero(size <= SHORT)
        if short.size:
            n = size[short]
            ends = np.cumsum(n)
            left = np.repeat(ends, n) - np.arange(int(ends[-1])) - 1  # bytes that follow in the word
            at = np.repeat(start[short] + n, n) - left - 1
            out[short] = np.bitwise_xor.reduceat(self.by_place[left, data[at]], ends - n)
        long = np.flatnonzero(size > SHORT)
        for i in long.tolist():
            out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
        # From the usual code back to the bare state.
        out[long] ^= self.closed(np.zeros(long.size, np.uint32), size[long])
        return out


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are part of a word once A-Z are lower-cased, and the lower-casing."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        inside[first : last + 1] = True
    return inside[lower], lower


INSIDE, LOWER = _classes()


def blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes in pieces of about BLOCK, cut where no word is."""
    begin = 0
    while begin < len(data):
        end = min(begin + BLOCK, len(data))
        while end < len(data) and INSIDE[data[end]]:
            step = data[end : end + BLOCK]
            outside = np.flatnonzero(~INSIDE[step])
            end += int(outside[0]) if outside.size else len(step)
        yield data[begin:end]
        begin = end


class Features:
    """Buckets of the features of texts: all runs of 1 to 3 neighbouring words, repeats included."""

    def __init__(self, buckets: int = BUCKETS):
        self.crc, self.buckets = Crc(), buckets

    def of(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For each block of the joined texts: the text of each word, and (text, bucket) of each run of 1, 2 and 3 words."""
        held = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part, base, starts, at in self._parts(data, ends):
            inside = INSIDE[part]
            edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
            start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
            state = self.crc.states(LOWER[part], start, size)
            text = np.searchsorted(starts, base + start, "right") - 1 + at
            new = len(held[0])
            state, size, text = (np.concatenate(x) for x in zip(held, (state, size, text)))
            runs, joined, length = [], state, size
            for n in range(1, LONGEST + 1):
                if n > 1:
                    spaced = self.crc.moved(joined[:-1], np.ones(len(joined[:-1]), np.int64)) ^ self.crc.space
                    joined = self.crc.moved(spaced, size[n - 1 :]) ^ state[n - 1 :]
                    length = length[:-1] + 1 + size[n - 1 :]
                owner = text[n - 1 :]
                # Runs that ended in the block before were counted there; runs over two texts are none.
                keep = np.flatnonzero(text[: len(joined)] == owner)
                keep = keep[keep + n - 1 >= new]
                runs.append((owner[keep], self.crc.closed(joined[keep], length[keep]) % np.uint32(self.buckets)))
            yield text[new:], runs
            held = state[-(LONGEST - 1) :], size[-(LONGEST - 1) :], text[-(LONGEST - 1) :]

    @staticmethod
    def _parts(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
        """Blocks of the texts with a byte between them that is in no word, their offset, the texts' starts and the first text's number."""
        for a, b in slices(np.diff(ends).tolist(), 4 * BLOCK):
            own = ends[a : b + 1] - ends[a]
            shift = np.arange(b - a)
            spaced = np.zeros(int(own[-1]) + b - a, np.uint8)
            place = np.ones(len(spaced), bool)
            place[own[1:] + shift] = False
            spaced[place] = data[ends[a] : ends[b]]
            base = 0
            for part in blocks(spaced):
                yield part, base, own[:-1] + shift, a
                base += len(part)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task adds up its own texts before anything is shuffled."""
    needs(texts, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, runs in features.of(*bytes_of(batch.column(0))):
                for _, bucket in runs:
                    total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One gain per bucket: 1000 times the log of the smoothed share in the target over that in the raw texts.

    Both tables are those of `bucket_counts`: at most `buckets` rows each, so the driver reads them.
    """
    s, t = ([0.0] * buckets for _ in range(2))
    for counts, into in ((raw, s), (target, t)):
        for bucket, n in counts.collect():
            into[bucket] = float(n)
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) of every document; null texts have no words, features or weight."""
    needs(docs, key, text)
    narrow = docs.select(key, text)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain))
        for batch in batches:
            words, found, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for text_of_word, runs in features.of(*bytes_of(batch.column(1))):
                words += np.bincount(text_of_word, minlength=batch.num_rows)
                for owner, bucket in runs:
                    if not len(owner):
                        continue
                    found += np.bincount(owner, minlength=batch.num_rows)
                    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    weight[owner[first]] += np.add.reduceat(gain[bucket], first)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, found, weight))], names=schema.names)

    schema = T.StructType([narrow.schema[key], *(T.StructField(name, T.LongType(), False) for name in ("n_words", "n_features", "weight"))])
    return narrow.mapInArrow(weigh, schema)


def scored(weights: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """`weights` with `score`: the weight plus 1000 times a Gumbel number that depends only on the key and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))))


def _reports(batches: Iterator[pa.RecordBatch], low: tuple, high: tuple, pivot: tuple | None) -> Iterator[pa.RecordBatch]:
    """Of one partition's keys between low and high: how many come up to the pivot, and size and median on its two sides.

    Keys are (falling score, id, row), smallest first. Without a pivot all keys are on the second side.
    """
    held = []
    for batch in batches:
        columns = tuple(c.to_numpy() for c in batch.columns)
        held.append(np.stack([-columns[0], columns[1], columns[2]]))
    keys = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)
    keys = keys[:, ~_before(keys, low) & _before(keys, high)]
    up_to = _before(keys, pivot) | (keys == np.array(pivot)[:, None]).all(axis=0) if pivot else np.zeros(keys.shape[1], bool)
    row = []
    for side in (keys[:, up_to], keys[:, ~up_to]):
        n = side.shape[1]
        order = np.lexsort(side[::-1])
        row += [n, *(side[:, order[(n - 1) // 2]].tolist() if n else (0, 0, 0))]
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=REPORT)


REPORT = [f"{side}_{name}" for side in ("first", "second") for name in ("n", "score", "id", "row")]


def _before(keys: np.ndarray, key: tuple) -> np.ndarray:
    """Which keys come before `key`."""
    a, b, c = keys
    return (a < key[0]) | (a == key[0]) & ((b < key[1]) | (b == key[1]) & (c < key[2]))


def weighted_median(medians: list[tuple[tuple, int]]) -> tuple:
    """The key at which half of the weight is reached."""
    total, running = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        running += n
        if 2 * running >= total:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int, folder: str) -> tuple[tuple | None, int]:
    """The k-th of all keys (score falling, id, row) and the number of rounds; None where k is 0.

    `keys` has k rows at least and is read from files. A round is one pass over the open keys and brings one row
    per partition to the driver. Whenever the open keys have become SHRUNK times fewer, they are written to `folder`
    anew, so all rounds together read the keys a bounded number of times.
    """
    if k <= 0:
        return None, 0
    end = 1 << 62
    low, high, pivot = (-end, -end, -end), (end, NO_ID, end), None
    spark, size, rounds = keys.sparkSession, None, 0
    while True:
        rounds += 1
        bounds = low, high, pivot
        found = keys.where(_between(low, high)).mapInArrow(lambda batches: _reports(batches, *bounds), ", ".join(f"{c} long" for c in REPORT)).collect()
        sides = [[(tuple(r[at + 1 : at + 4]), r[at]) for r in found if r[at]] for at in (0, 4)]
        first, second = (sum(n for _, n in side) for side in sides)
        if pivot is not None and first == k:
            return pivot, rounds
        if pivot is not None and first > k:
            high, side = pivot, sides[0]  # the pivot itself is no longer open, but counts as one key
            left = first - 1
            side = [(key, n) for key, n in side if key != pivot or n > 1]
        else:
            low, k, side, left = (_next(pivot) if pivot else low), k - first, sides[1], second
        if left < 1 or not side:
            raise ValueError("fewer keys than asked for")
        pivot = weighted_median(side)
        size = size or left
        if left * SHRUNK < size:
            size = left
            path = f"{folder}/open-{rounds}"
            keys.where(_between(low, high)).write.parquet(path)
            keys = spark.read.schema(keys.schema).parquet(path)


def _next(key: tuple) -> tuple:
    return key[0], key[1], key[2] + 1


def _earlier(key: tuple) -> Column:
    """Whether a row (score, id, row) comes before a key, whose score is negated."""
    score, id_, row = F.col("score"), F.col("id"), F.col("row")
    return (score > -key[0]) | (score == -key[0]) & ((id_ < key[1]) | (id_ == key[1]) & (row < key[2]))


def _between(low: tuple, high: tuple) -> Column:
    """`low` or after it, and before `high`; the plain bounds of the score reach the scan."""
    score = F.col("score")
    return (score <= -low[0]) & (score >= -high[0]) & ~_earlier(low) & _earlier(high)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = 42,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document, rank only for those drawn.

    Of the documents with `least_words` words, floor(percent / 100 of their number) are drawn by highest score, ties
    by smaller key; a missing key comes last. Rows that tie in both are told apart by their place in the written scores.
    Null texts have no features and are never drawn. The target's texts are a table with the same text column. An
    empty table gives an empty one; an empty target gives every bucket its smoothed gain.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets), buckets)
    folder = shared_folder(spark, "resampling")
    own = F.coalesce(F.col(KEY).cast("long"), F.lit(NO_ID))
    rows = scored(weighed(docs.select(F.col(key).alias(KEY), text), gain, KEY, text), KEY, seed)
    rows.select("*", own.alias("id"), F.monotonically_increasing_id().alias("row")).write.parquet(f"{folder}/scores")
    rows = spark.read.schema(rows.schema.add("id", "long").add("row", "long")).parquet(f"{folder}/scores")
    able = F.col("n_words") >= least_words
    k = rows.where(able).count() * percent // 100
    last, _ = cutoff(rows.where(able).select("score", "id", "row"), k, folder)
    drawn = able & _earlier(_next(last)) if last else F.lit(False)
    columns = [KEY, "n_words", "n_features", "weight", "score"]
    # Sorted by ranges; the written place tells the range and the place in it, and a range starts after those before it.
    winners = rows.where(drawn).orderBy(F.desc("score"), "id", "row").select(*columns, F.monotonically_increasing_id().alias("at"))
    winners.write.parquet(f"{folder}/winners")
    winners = spark.read.schema(winners.schema).parquet(f"{folder}/winners").withColumn("range", F.shiftright("at", 33))
    sizes = winners.groupBy("range").agg(F.count("*").alias("n"))  # one row per partition of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = winners.join(sizes.select("range", before.alias("before")), "range").select(*columns, place.cast("long").alias("rank"))
    result = ranked.unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
    result = shared_table(result, "resampled")
    drop_folder(spark, folder)
    return result.withColumnRenamed(KEY, key)
