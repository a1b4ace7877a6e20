"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillon.session import checkpoint_folder, checkpointed

#: What separates words: the space and the control characters from tab to carriage return. `bytes.split()` splits there.
SPACE = " \t\n\r\x0b\x0c"
#: One word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def needs(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and the n + 1 offsets of the texts in them; null is the empty text."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(filled):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = filled.buffers()
    offsets = np.frombuffer(ends, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Numbered(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after another."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most `most`, or that hold one."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by them.

    Only the last run of a batch waits for the next batch, so memory follows the batch and the longest run.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(key)) for key in keys]
        head, tail = (tuple(c[i].as_py() for c in columns) for i in (0, batch.num_rows - 1))
        if head == tail:
            if held and head != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            last = tail
            continue
        same = np.ones(batch.num_rows, bool)
        for column in columns:
            values = column.to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        cut = batch.num_rows - int(np.argmin(same[::-1]))
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held, last = [batch.slice(cut)], tail
    if held:
        yield pa.Table.from_batches(held)


def single_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys."""
    for run in in_groups(batches, keys):
        new = np.zeros(len(run), bool)
        for key in keys:
            values = run[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(run)]
        for start, end in zip(cuts, cuts[1:]):
            yield run.slice(start, end - start)


def star_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a graph, rewritten so that each node but the smallest of its component links to that smallest one."""
    if not len(left):
        return left, right
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) per node that has a link, root its smallest node.

    Alternates between linking each node's larger neighbours to its smallest one and linking its
    smaller neighbours among themselves, until nothing moves: the rounds grow with the logarithm of
    the longest path. A hub is met by an aggregation that combines before the shuffle and by a join
    whose other side has one row per node, which adaptive execution can split.
    """

    def seen_from(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.min("b").alias("low"))

    def signature(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    oriented = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpointed(links.where("a <> b").select(*oriented).distinct())
    state = signature(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = seen_from(both).select("a", F.least("a", "low").alias("low"))
        large = both.join(lows, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lows = seen_from(large)
        small = large.join(lows, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = checkpointed(small.unionByName(lows.select("a", F.col("low").alias("b"))).distinct())
        now = signature(moved)
        edges = moved
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def shared_folder(spark, purpose: str) -> str:
    """A new folder's name under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written as a compressed table in the shared folder and read again: cuts the lineage like a checkpoint."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table_alone(df: DataFrame, purpose: str) -> DataFrame:
    """`shared_table`, after which the shuffle files of the writing are gone: the table is all that later steps read."""
    conf = df.sparkSession.conf
    held = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return shared_table(df, purpose)
    finally:
        conf.set(CLEANUP, held) if held is not None else conf.unset(CLEANUP)


def drop_folder(spark, folder: str) -> None:
    """Remove a folder of intermediate files, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
