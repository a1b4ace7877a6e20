"""Removal of repeated 50-byte strings by a hash-compared suffix sort.

A byte goes if some string of `SPAN` bytes over it also starts in a document with a smaller id. All strings
of a document are covered by stretches: runs of windows that share a minimizer, the k-gram of the
smallest hash in the window (the leftmost of equals). Equal windows have equal minimizers at equal
places, so only stretches with the same minimizer can share a window.

1. Every stretch is reduced to two hashes (minimizer, whole stretch) and dealt by minimizer. Stretches
   whose whole content occurs in a smaller document are settled. Those whose minimizer, but not the
   whole, occurs elsewhere are the borders of repeated passages.
2. The bytes of borders are fetched and dealt by minimizer. There the contexts are sorted as suffixes,
   right of the minimizer's start and, reversed, left of it, by a mergesort whose comparisons find the
   common extension by binary search over prefix polynomial hashes. Neighbours' common extensions are then
   verified byte by byte, and give the classes of equal windows and their smallest document.
3. All removed ranges meet their documents.

A minimizer with very many different borders (a frequent passage in many surroundings) is not sorted in one
task: its windows are dealt one by one and reduced to their smallest document before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillon.llm.common import bytes_of, in_groups, needs, shared_table, shared_table_alone

SPAN = 50
GRAM = 20
#: k-grams in one window.
WINDOW = SPAN - GRAM + 1
#: Borders of one minimizer that one task sorts.
MOST_BORDERS = 4096
#: Bytes whose minimizers are found at a time.
BLOCK = 1 << 20
NO_ID = np.iinfo(np.int64).max
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# A text is told by its key (doc) and its digest. A place in it is packed in one long: 31 bits of the position, 11 of the lengths.
def packed(start: np.ndarray, low: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 11 | low.astype(np.int64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every position of `data`; GRAM is 20: two words of 8 bytes and one of 4."""
    n = len(data) - GRAM + 1
    words = np.ndarray((n + 8,), "<u8", data, strides=(1,))
    mixed = words[:n] * MIX[0]
    mixed ^= mixed >> np.uint64(32)
    mixed += words[8 : n + 8]
    mixed *= MIX[1]
    mixed ^= mixed >> np.uint64(29)
    mixed += np.ndarray((n,), "<u4", data, offset=16, strides=(1,))
    mixed *= MIX[2]
    mixed ^= mixed >> np.uint64(32)
    return mixed


def leftmost_minima(values: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest value in each run of WINDOW values."""
    best, place, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        n = len(best) - step
        later = best[step:] < best[:n]
        best, place, have = np.where(later, best[step:], best[:n]), np.where(later, place[step:], place[:n]), have + step
    return place


def stretches(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimizer hash, hash of the whole stretch, minimizer's position, bytes left of it and bytes from it on."""
    found = []
    last = len(data) - SPAN
    for begin in range(0, last + 1, BLOCK):
        end = min(begin + BLOCK, last + 1)  # windows starting in [begin, end)
        hashes = gram_hashes(data[begin : end + SPAN - 1])
        place = leftmost_minima(hashes)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        final = np.append(first[1:], len(place)) - 1
        size = final - first + SPAN
        at = place[first].astype(np.int64)
        whole = (at - first).astype(np.uint64) << np.uint64(8) | size.astype(np.uint64)
        for offset in (0, GRAM, 2 * GRAM, 4 * GRAM):
            whole = (whole ^ hashes[first + np.minimum(offset, size - GRAM)]) * MIX[3]
            whole ^= whole >> np.uint64(31)
        found.append((hashes[at], whole, at + begin, at - first, size - (at - first)))
    return tuple(np.concatenate(x) for x in zip(*found))


def stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, whole, doc, digest, place) of every stretch, from (doc, digest, text)."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        digests = batch.column(1).to_numpy()
        data, ends = bytes_of(batch.column(2))
        rows, held = [], 0
        for i in range(len(docs)):
            if ends[i + 1] - ends[i] < SPAN:
                continue
            gram, whole, at, left, right = stretches(data[ends[i] : ends[i + 1]])
            rows.append((gram.view(np.int64), whole.view(np.int64), np.full(len(at), docs[i]), np.full(len(at), digests[i]), packed(at, left << 6 | right)))
            held += len(at)
            if held > 200_000:
                yield table_of(rows)
                rows, held = [], 0
        if rows:
            yield table_of(rows)


def table_of(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["gram", "whole", "doc", "digest", "place"])


def settled_and_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (border, gram, doc, digest, place), from stretches sorted by (gram, whole, doc, digest, place).

    A stretch seen in a smaller document is settled. Of the rest, those whose minimizer has another content
    elsewhere are borders. Repeated rows of one text count once. What waits for the next batch is one document's
    stretches of one content.
    """
    gram = whole = low = last = None
    several = False
    held: list[tuple[np.ndarray, ...]] = []

    def out(border: bool, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(columns[0]), border), *columns)], names=["border", "gram", "doc", "digest", "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(5)]
        fresh = np.append(last is None or last != tuple(c[0] for c in columns), np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        last = tuple(c[-1] for c in columns)
        g, w, d, t, p = (c[fresh] for c in columns)
        if not len(g):
            continue
        new_gram = np.append(gram is None or g[0] != gram, g[1:] != g[:-1])
        new_whole = new_gram | np.append(whole is None or w[0] != whole, w[1:] != w[:-1])
        lows = np.where(new_whole, d, 0)
        start = np.maximum.accumulate(np.where(new_whole, np.arange(len(d)), -1))
        lows = np.where(start >= 0, d[start], low if low is not None else 0)
        later = d > lows
        if later.any():  # no later step reads their minimizer
            yield out(False, np.zeros(int(later.sum()), np.int64), d[later], t[later], p[later])
        group = np.cumsum(new_gram)  # 0: the run that goes on from the last batch
        second = new_whole & ~new_gram
        many = np.zeros(group[-1] + 1, bool)
        many[group[second]] = True
        many[0] |= several
        if many[0] and held:
            yield out(True, np.full(sum(len(x) for x, *_ in held), gram), *map(np.concatenate, zip(*held)))
            held = []
        if group[-1] > 0:
            held = []
        border = ~later & many[group]
        if border.any():
            yield out(True, g[border], d[border], t[border], p[border])
        gram, whole, low, several = g[-1], w[-1], lows[-1], bool(many[-1])
        open_rows = ~later & (group == group[-1])
        if not several and open_rows.any():
            held.append((d[open_rows], t[open_rows], p[open_rows]))


class Extensions:
    """Common extensions of texts inside one byte array, by prefix polynomial hashes modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: int = 0x5851F42D4C957F2D):
        n = len(data)
        inverse = pow(base, -1, 1 << 64)
        self.data = np.append(data, np.uint8(0))
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n, inverse, np.uint64)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64))

    def of(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the texts at x and at y, `most` at most."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = (self.sums[x + middle] - self.sums[x]) * self.back[x] == (self.sums[y + middle] - self.sums[y]) * self.back[y]
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def less(self, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
        """Whether the text of length nx at x sorts before that of length ny at y; a prefix sorts first."""
        most = np.minimum(nx, ny)
        same = self.of(x, y, most)
        return np.where(same == most, nx < ny, self.data[x + same] < self.data[y + same])


def suffix_order(ext: Extensions, at: np.ndarray, size: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Order of the suffixes (at, size) inside their groups, which are neighbours: bottom-up mergesort.

    `start` and `count` tell each suffix's group. At every level each element finds its place in the
    neighbouring run by binary search.
    """
    order = np.arange(len(at))
    slot = np.arange(len(at)) - start
    width = 1
    while (active := np.flatnonzero(count > width)).size:
        base, place = start[active], slot[active]
        block = place // (2 * width) * (2 * width)
        in_left = place - block < width
        from_ = np.where(in_left, block + width, block)
        to = np.minimum(np.where(in_left, block + 2 * width, block + width), count[active])
        from_ = np.minimum(from_, to)
        low, high = from_.copy(), to.copy()
        own = order[active]
        while (open_ := low < high).any():
            go = np.flatnonzero(open_)
            middle = (low[go] + high[go]) >> 1
            other = order[base[go] + middle]
            mine = own[go]
            # An element of the left run goes after smaller ones of the right; one of the right after those not larger.
            after = np.where(
                in_left[go],
                ext.less(at[other], size[other], at[mine], size[mine]),
                ~ext.less(at[mine], size[mine], at[other], size[other]),
            )
            low[go], high[go] = np.where(after, middle + 1, low[go]), np.where(after, high[go], middle)
        target = base + block + np.where(in_left, place - block, place - block - width) + (low - from_)
        order[target] = own
        width *= 2
    return order


def neighbours(ext: Extensions, order: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Common extension of each sorted suffix with the one before it, -1 at a group's first; verified byte by byte."""
    x, y = order[:-1], order[1:]
    most = np.minimum(size[x], size[y])
    same = ext.of(at[x], at[y], most)
    steps = np.arange(SPAN + WINDOW)
    for i in range(0, len(x), 50_000):
        part = slice(i, i + 50_000)
        inside = steps[None, :] < most[part][:, None]
        a = np.where(inside, ext.data[np.minimum(at[x[part]][:, None] + steps, len(ext.data) - 1)], 0)
        b = np.where(inside, ext.data[np.minimum(at[y[part]][:, None] + steps, len(ext.data) - 1)], 1)
        true = np.argmax(np.append(a != b, np.ones((len(a), 1), bool), axis=1), axis=1)
        if (true != same[part]).any():
            raise ArithmeticError("hash collision")
    return np.where(first, -1, np.append(-1, same))


def covered_windows(data: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """covered[row, l]: whether the window that starts l bytes before the minimizer also starts in a smaller document.

    Rows are sorted by gram; row i's context is data[start : start + left + right].
    """
    n = len(gram)
    first = np.append(True, gram[1:] != gram[:-1])
    group = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    counts = np.diff(np.append(begins, n))
    classes = []
    for forward in (True, False):
        texts = data if forward else data[::-1]
        at = start + left if forward else len(data) - (start + left)
        size = right if forward else left
        for base in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15):
            ext = Extensions(texts, base)
            order = suffix_order(ext, at, size, begins[group], counts[group])
            try:
                classes.append((order, neighbours(ext, order, at, size, first)))
                break
            except ArithmeticError:
                continue
        else:
            raise ArithmeticError("hash collisions under three bases")
    covered = np.zeros((n, WINDOW), bool)
    for l in range(WINDOW):
        rows = np.flatnonzero((left >= l) & (right >= SPAN - l))
        if not len(rows):
            continue
        ids = []
        for (order, same), need in zip(classes, (SPAN - l, l)):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(same < need)
            ids.append(own[rows])
        kind = np.unique(ids[0] * (n + 1) + ids[1], return_inverse=True)[1]
        low = np.full(kind.max() + 1, NO_ID)
        np.minimum.at(low, kind, doc[rows])
        covered[rows, l] = doc[rows] > low[kind]
    return covered


def border_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, digest, place) of removed ranges, from borders (gram, doc, digest, place, context) sorted by gram."""
    for run in in_groups(batches, ["gram"]):
        gram, doc, digest, place = (run[name].to_numpy() for name in ("gram", "doc", "digest", "place"))
        data, ends = bytes_of(run["context"].combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        left, right = place >> 6 & 31, place & 63
        covered = covered_windows(data.copy(), ends[:-1], left, right, gram, doc)
        row, l = np.nonzero(covered)
        if not len(row):
            continue
        # l counts back from the minimizer, so a run of l values is a run of window starts.
        new = np.append(True, (row[1:] != row[:-1]) | (l[1:] != l[:-1] + 1))
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) - 1
        own = place[row[begin]]
        out = packed((own >> 11) - l[end], l[end] - l[begin] + SPAN)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row[begin]], digest[row[begin]], out)], names=["doc", "digest", "place"])


def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc, digest, place, context) of borders, from (doc, digest, text, borders as structs of gram and place).

    Neighbouring rows of one text are fetched once.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in (0, 1)]
        fresh = np.append(last != tuple(k[0] for k in keys), np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        last = tuple(k[-1] for k in keys)
        if not fresh.all():
            batch = batch.filter(pa.array(fresh))
        data, ends = bytes_of(batch.column(2))
        lists = batch.column(3)
        grams, places = (lists.flatten().field(i).to_numpy() for i in (0, 1))
        lengths = lists.value_lengths().to_numpy()
        docs = np.repeat(batch.column(0).to_numpy(), lengths)
        digest = np.repeat(batch.column(1).to_numpy(), lengths)
        base = np.repeat(ends[:-1], lengths)
        start = base + (places >> 11) - (places >> 6 & 31)
        size = (places >> 6 & 31) + (places & 63)
        for i in range(0, len(start), 100_000):
            part = slice(i, i + 100_000)
            total = np.cumsum(size[part])
            bytes_ = data[np.repeat(start[part] - (total - size[part]), size[part]) + np.arange(total[-1])]
            contexts = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(total), [None, pa.py_buffer(np.append(0, total).astype(np.int64)), pa.py_buffer(bytes_)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[part]) for x in (grams, docs, digest, places)), contexts], names=["gram", "doc", "digest", "place", "context"]
            )


def removed(batches: Iterator[pa.RecordBatch], text: int, ranges: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch's columns but the ranges, the maximal removed runs, the bytes that stay and the text of them."""
    for batch in batches:
        data, ends = bytes_of(batch.column(text))
        spans, kept = [], []
        for i, found in enumerate(batch.column(ranges)):
            own = data[ends[i] : ends[i + 1]]
            places = found.values.to_numpy() if found.is_valid else np.zeros(0, np.int64)
            if not len(places):
                spans.append([])
                kept.append(own.tobytes())
                continue
            start = places >> 11
            edge = np.zeros(len(own) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + (places & 2047), -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
            spans.append([{"start": a, "end": b} for a, b in turn.tolist()])
            kept.append(own[~gone].tobytes())
        columns = [c for i, c in enumerate(batch.columns) if i != ranges]
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pair), pa.array(kept, pa.binary()), texts], names=names)


def told_apart(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """`docs` with two new columns: the key (null comes last) and, beside it, the digest of the text; and the first's name.

    Only texts of a key that several rows share need a digest, the others have 0: one number less to carry for each
    stretch. Repeated keys are counted from the key column alone.
    """
    column = f"own_{uuid.uuid4().hex[:8]}"
    named = docs.withColumn(column, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))
    shared = shared_table(named.groupBy(column).count().where("count > 1").select(F.col(column).alias(f"{column}_shared")), "keys")
    if shared.isEmpty():
        return named.withColumn(f"{column}_digest", F.lit(0).cast("long")), column
    known = named.join(shared, F.col(column) == F.col(f"{column}_shared"), "left")
    digest = F.when(F.col(f"{column}_shared").isNotNull(), F.xxhash64(F.coalesce(text, F.lit("")))).otherwise(0).cast("long")
    return known.withColumn(f"{column}_digest", digest).drop(f"{column}_shared"), column


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `spans` (maximal removed byte ranges), `kept` (the bytes that stay) and `kept_text` (those of whole characters).

    Null texts are empty and texts under SPAN bytes lose nothing. A row without a key counts as later than all others.
    Rows of equal key never match each other, so repeated rows are treated alike. Columns named like a result are
    replaced. An empty table gives an empty one.
    """
    needs(docs, key, text)
    docs = docs.drop("spans", "kept", "kept_text")
    spark = docs.sparkSession
    named, column = told_apart(docs, key, text)
    own, digest = F.col(column), F.col(f"{column}_digest")
    narrow = named.select(own.alias("doc"), digest.alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    one = ["doc", "digest"]
    order = ["gram", "whole", *one, "place"]
    dealt = narrow.mapInArrow(stretch_rows, "gram long, whole long, doc long, digest long, place long").repartition("gram").sortWithinPartitions(*order)
    marks = shared_table_alone(dealt.mapInArrow(settled_and_borders, "border boolean, gram long, doc long, digest long, place long"), "marks")

    borders = marks.where("border").groupBy(*one).agg(F.collect_list(F.struct("gram", "place")).alias("borders"))
    contexts = narrow.join(borders, one).select(*one, "text", "borders")
    contexts = shared_table_alone(contexts.mapInArrow(fetched, "gram long, doc long, digest long, place long, context binary"), "borders")
    frequent = contexts.groupBy("gram").count().where(F.col("count") > MOST_BORDERS).select("gram")
    few = contexts.join(frequent, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    ranges = few.mapInArrow(border_ranges, "doc long, digest long, place long")

    many = contexts.join(frequent, "gram", "left_semi")
    left, right = F.shiftright("place", 6).bitwiseAND(F.lit(31)), F.col("place").bitwiseAND(F.lit(63))
    starts = F.posexplode(F.sequence(F.lit(1).cast("long"), left + right - (SPAN - 1))).alias("step", "at")
    windows = many.select(*one, "place", left.alias("left"), "context", starts)
    windows = windows.select(*one, "place", "left", "step", F.expr(f"substring(context, int(at), {SPAN})").alias("window"))
    lowest = windows.groupBy("window").agg(F.min("doc").alias("low"))
    found = windows.join(lowest, "window").where("doc > low")
    at = F.shiftright("place", 11) - F.col("left") + F.col("step")
    place = F.shiftleft(at, 11).bitwiseOR(F.lit(SPAN).cast("long"))
    ranges = ranges.unionByName(found.select(*one, place.alias("place")))

    start = F.shiftright("place", 11) - left
    settled = F.shiftleft(start, 11).bitwiseOR(left + right)
    ranges = marks.where("not border").select(*one, settled.alias("place")).unionByName(ranges)
    # As a set, so that many rows of one text do not gather its ranges as often.
    by_text = ranges.groupBy(*one).agg(F.collect_set("place").alias("ranges"))

    by_text = by_text.select(F.col("doc").alias(f"{column}_doc"), F.col("digest").alias(f"{column}_text"), F.col("ranges").alias(f"{column}_ranges"))
    same = (F.col(column) == F.col(f"{column}_doc")) & (F.col(f"{column}_digest") == F.col(f"{column}_text"))
    joined = named.join(by_text, same, "left").select(*[named[c] for c in docs.columns], f"{column}_ranges")
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = [T.StructField("spans", pair, False), T.StructField("kept", T.BinaryType(), False), T.StructField("kept_text", T.StringType(), False)]
    schema = T.StructType([*docs.schema.fields, *made])
    places = docs.columns.index(text), len(docs.columns)
    return joined.mapInArrow(lambda batches: removed(batches, *places, schema.names), schema)
