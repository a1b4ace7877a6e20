"""SimHash near-duplicates by pivot distance tables.

Fingerprints that may link are brought together by pivots restricted to blocks: the 64 bits form six
blocks, and where at most four bits differ, at least two blocks agree, so all their distances to any
pivot agree. A bucket is such a pair of agreeing blocks. Inside a bucket a table holds the Hamming
distance of every fingerprint to many reference fingerprints. By the triangle inequality two
fingerprints can only link if no coordinate differs by more than the limit, so pairs with a larger
coordinate difference are dropped, and the survivors are verified bit by bit. A bucket passes on a star
forest of its links, never its pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from quillon.llm.common import bytes_of, components, in_groups, needs, shared_table, star_forest
from quillon.session import checkpointed

SHINGLE = 4
LIMIT = 4
SEED = 42
#: Bounds of the blocks. With LIMIT differing bits at least two of six blocks agree.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
#: Rows of a bucket that one task compares; larger buckets are dealt to pairs of parts.
PART = 4096


def pivots(n: int = 12) -> np.ndarray:
    """Reference fingerprints; any would do, as they decide only how many pairs are verified."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(n)], np.uint64)


def fingerprint(text: bytes) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = n - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, count, 1 << 15):
        block = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each text as a long of the same bits. Null text is the empty text, whose bits are all 0."""
    needs(docs, key, text)
    narrow = docs.select(key, text)
    schema = T.StructType([narrow.schema[key], T.StructField("fp", T.LongType(), False)])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch.column(1))
            whole = data.tobytes()
            found = np.fromiter((fingerprint(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return narrow.mapInArrow(hashed, schema)


def linked_within(fps: np.ndarray, reference: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Star forest over the places of `fps` (a bucket) that link within the limit."""
    table = np.bitwise_count(fps[:, None] ^ reference[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    table, fps = np.ascontiguousarray(table[order].T), fps[order]
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(fps), 256):
        rows = np.arange(i, min(i + 256, len(fps)))
        end = int(np.searchsorted(table[0], table[0][rows[-1]] + limit, "right"))
        near = np.arange(i, end)[None, :] > rows[:, None]
        for coordinate in table:
            near &= np.abs(coordinate[rows][:, None] - coordinate[None, i:end]) <= limit
        a, b = np.nonzero(near)
        a, b = a + i, b + i
        true = np.bitwise_count(fps[a] ^ fps[b]) <= limit
        left, right = star_forest(np.concatenate([left, a[true]]), np.concatenate([right, b[true]]))
    return order[left], order[right]


def linked_pairs(fps: np.ndarray, bucket: np.ndarray, most: int, reference: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs in buckets of at most `most` rows, rows sorted by bucket."""
    table = np.bitwise_count(fps[:, None] ^ reference[None, :]).astype(np.int8)
    left, right = [], []
    for step in range(1, most):
        a = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(a):
            break
        for coordinate in table.T:
            a = a[np.abs(coordinate[a] - coordinate[a + step]) <= limit]
        a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= limit]
        left.append(a)
        right.append(a + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def bucket_links(batches: Iterator[pa.RecordBatch], limit: int = LIMIT, small: int = 16) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of fingerprints, from rows (bucket, lo, hi, fp) sorted by bucket and cell."""
    reference = pivots()
    for run in in_groups(batches, ["bucket", "lo", "hi"]):
        keys = [run[name].to_numpy() for name in ("bucket", "lo", "hi")]
        fps = run["fp"].to_numpy().view(np.uint64)
        new = np.ones(len(fps), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        place = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fps)))
        left, right = [], []
        few = np.flatnonzero((sizes[place] > 1) & (sizes[place] <= small))
        a, b = linked_pairs(fps[few], place[few], small, reference, limit)
        left.append(few[a])
        right.append(few[b])
        for i in np.flatnonzero(sizes > small):
            a, b = linked_within(fps[starts[i] : starts[i] + sizes[i]], reference, limit)
            left.append(a + starts[i])
            right.append(b + starts[i])
        a, b = star_forest(fps[np.concatenate(left)].view(np.int64), fps[np.concatenate(right)].view(np.int64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints `fp` connected by steps within LIMIT bits."""
    width = [(1 << (hi - lo)) - 1 for lo, hi in zip(BLOCKS, BLOCKS[1:])]
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask)) for lo, mask in zip(BLOCKS, width)]
    keys = [
        F.lit(n << 48).bitwiseOR(F.shiftleft(part[i], 24)).bitwiseOR(part[j])
        for n, (i, j) in enumerate(combinations(range(len(part)), len(part) - LIMIT))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    large = rows.groupBy("bucket").count().where(F.col("count") > PART).select("bucket", F.ceil(F.col("count") / PART).alias("parts"))
    dealt = (
        rows.join(large, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    cells = ["bucket", "lo", "hi"]
    return dealt.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(bucket_links, "a long, b long")


def rooted_fingerprints(classes: DataFrame) -> DataFrame:
    """`classes`, which has one row per fingerprint `fp`, with `root`: the same for all fingerprints joined by links."""
    roots = components(fingerprint_links(classes.select("fp")))
    return checkpointed(classes.join(roots, classes["fp"] == roots["node"], "left").select(*[classes[c] for c in classes.columns], F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row; component_id is the smallest key reachable by links.

    Equal fingerprints are compared once. Rows without a key take part and get their component's id; a component
    without any key has a null id. Empty and null texts share the zero fingerprint. An empty table gives an empty one.
    """
    prints = checkpointed(fingerprints(docs, key, text))
    classes = prints.groupBy("fp").agg(F.min(key).alias("first"))
    rooted = rooted_fingerprints(classes)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each group of linked fingerprints: that of the smallest key, rows without a key last.

    Rows of one key go by a digest of their texts. Equal rows are told apart by numbers in a table in the shared folder.
    """
    needs(docs, key, text)
    number = f"row_{uuid.uuid4().hex[:8]}"
    numbered = shared_table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    rank = F.struct(F.col(key).isNull().alias("keyless"), F.col(key).alias("key"), digest.alias("digest"), F.col(number).alias("row"))
    prints = checkpointed(fingerprints(numbered.select(rank.alias("rank"), text), "rank", text))
    rooted = rooted_fingerprints(prints.groupBy("fp").agg(F.min("rank").alias("first")))
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(number))
    return numbered.join(first, number, "left_semi").select(*docs.columns)
