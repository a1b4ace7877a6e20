"""Fill-in-the-middle over texts stored as seekable compressed frames.

A text is stored as independent zstandard frames, each with the lines, characters and bytes that come
before it. A cut after the k-th line is found by the running line counts, and only the frame that holds
it is decompressed. The rearranged text is again a list of frames: whole frames move as they are, and the
two cut ones are split and compressed anew. Digests and the restored text read frames in their order, one
at a time, so a task holds one compressed text and one open frame, however long the text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillon.llm.common import bytes_of, needs, slices

#: Bytes of text in one frame; frames are cut between characters.
FRAME = 1 << 16
#: Bytes of text that a task frames, moves or digests before it hands rows on.
SLICE = 1 << 23
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE = 10

FRAMES = T.ArrayType(
    T.StructType([T.StructField(name, T.LongType(), False) for name in ("units", "chars", "start", "size")] + [T.StructField("data", T.BinaryType(), False)]),
    False,
)
_FRAMES = pa.list_(pa.struct([*((name, pa.int64()) for name in ("units", "chars", "start", "size")), ("data", pa.binary())]))


def n_chars(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: those that do not continue one."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Writer:
    """Appends bytes as frames, and keeps the running counts."""

    def __init__(self, size: int = FRAME):
        self.size = size
        self.pack = zstandard.ZstdCompressor(level=3)

    def start(self) -> None:
        self.frames: list[dict] = []
        self.units = self.chars = self.bytes = 0

    def whole(self, frame: dict, units: int, chars: int) -> None:
        """A frame as it is; `units` and `chars` are what it holds."""
        self.frames.append({"units": self.units, "chars": self.chars, "start": self.bytes, "size": frame["size"], "data": frame["data"]})
        self.units += units
        self.chars += chars
        self.bytes += frame["size"]

    def append(self, data: bytes) -> None:
        own = np.frombuffer(data, np.uint8)
        begin = 0
        while begin < len(own):
            end = min(begin + self.size, len(own))
            while end < len(own) and end > begin + 1 and own[end] & 0xC0 == 0x80:
                end -= 1
            part = own[begin:end]
            self.whole({"size": end - begin, "data": self.pack.compress(data[begin:end])}, int(np.count_nonzero(part == NEWLINE)), n_chars(part))
            begin = end


class Reader:
    """Reads a list of frames; only the last frame opened stays decompressed."""

    def __init__(self, frames: list[dict]):
        self.frames = frames
        self.unpack = zstandard.ZstdDecompressor()
        self.opened, self.data = -1, b""
        self.starts = np.array([f["start"] for f in frames], np.int64)
        self.size = frames[-1]["start"] + frames[-1]["size"] if frames else 0

    def open(self, i: int) -> bytes:
        if i != self.opened:
            self.opened, self.data = i, self.unpack.decompress(self.frames[i]["data"], max_output_size=self.frames[i]["size"])
        return self.data

    def after_units(self, k: int, n: int) -> tuple[int, int]:
        """(bytes, chars) before the end of unit k of n: found by the running counts, in one frame."""
        if k == 0 or not self.frames:
            return 0, 0
        units = np.array([f["units"] for f in self.frames], np.int64)
        i = int(np.searchsorted(units, k, "left")) - 1
        own = np.frombuffer(self.open(i), np.uint8)
        ends = np.flatnonzero(own == NEWLINE)
        nth = k - self.frames[i]["units"]
        # The last line of a text may have no newline: it ends where the text does.
        at = int(ends[nth - 1]) + 1 if nth <= len(ends) else len(own)
        if nth > len(ends) and (k != n or i != len(self.frames) - 1):
            raise ValueError("frame counts do not fit their text")
        return self.frames[i]["start"] + at, self.frames[i]["chars"] + n_chars(own[:at])

    def parts(self, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(frame, from, to) of the frames between two byte positions, in order."""
        i = max(int(np.searchsorted(self.starts, begin, "right")) - 1, 0)
        while begin < end:
            first = self.frames[i]["start"]
            to = min(end - first, self.frames[i]["size"])
            yield i, begin - first, to
            begin, i = first + to, i + 1

    def read(self, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
        for i, a, b in self.parts(begin, self.size if end is None else end):
            yield self.open(i)[a:b]

    def find(self, mark: bytes, begin: int) -> int:
        """Position of the first `mark` at or after `begin`, across frames; -1 if there is none."""
        tail, at = b"", begin
        for part in self.read(begin):
            found = (tail + part).find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(part)
            tail = (tail + part)[-(len(mark) - 1) :]
        return -1


def copied(reader: Reader, writer: Writer, begin: int, end: int) -> None:
    """Appends the bytes between two positions: whole frames as they are, cut ones anew."""
    for i, a, b in reader.parts(begin, end):
        frame = reader.frames[i]
        if a == 0 and b == frame["size"]:
            after = reader.frames[i + 1] if i + 1 < len(reader.frames) else None
            if after:
                units, chars = after["units"] - frame["units"], after["chars"] - frame["chars"]
            else:
                own = np.frombuffer(reader.open(i), np.uint8)
                units, chars = int(np.count_nonzero(own == NEWLINE)), n_chars(own)
            writer.whole(frame, units, chars)
        else:
            writer.append(reader.open(i)[a:b])


def framed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = FRAME) -> DataFrame:
    """(key, n, reserved, frames): each whole text as frames, its number of lines, and whether it contains a mark.

    A line ends with its newline or with the text. Null and empty texts have no lines and no frames; repeated rows
    and keys are rows of their own, other columns are not read, an empty table gives an empty one.
    """
    needs(docs, key, text)
    narrow = docs.select(key, text)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(size)
        for batch in batches:
            data, ends = bytes_of(batch.column(1))
            for a, b in slices(np.diff(ends).tolist(), SLICE):
                lines, reserved, frames = [], [], []
                for i in range(a, b):
                    own = data[ends[i] : ends[i + 1]].tobytes()
                    writer.start()
                    writer.append(own)
                    lines.append(writer.units + (own[-1:] not in (b"", b"\n")))
                    reserved.append(any(m in own for m in marks))
                    frames.append(writer.frames)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lines, pa.int64()), pa.array(reserved, pa.bool_()), pa.array(frames, _FRAMES)], names=schema.names
                )

    schema = T.StructType(
        [narrow.schema[key], T.StructField("n", T.LongType(), False), T.StructField("reserved", T.BooleanType(), False), T.StructField("frames", FRAMES, False)]
    )
    return narrow.mapInArrow(frame, schema)


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits that depend only on the key and the seed; a null key has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def arranged(store: DataFrame, key: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, frames): the texts of `framed`, cut twice and rearranged.

    `rate` percent of the texts are rearranged, `spm` percent of those with the suffix first. Empty texts and
    texts that contain a mark stay plain, with null counts.
    """
    needs(store, key, "n", "reserved", "frames")
    one, two, three, four = draws(key, seed)
    cuts = [x % (F.col("n") + 1) for x in (one, two)]
    plain = (F.col("n") == 0) | F.col("reserved") | (three % 100 >= rate)
    form = F.when(plain, "plain").when(four % 100 < spm, "spm").otherwise("psm")
    decided = store.select(key, "n", form.alias("form"), F.least(*cuts).alias("first"), F.greatest(*cuts).alias("second"), "frames")

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer()
        for batch in batches:
            lines, forms, first, second = (batch.column(i).to_pylist() for i in range(1, 5))
            weights = pa.compute.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False) * FRAME
            for a, b in slices(weights.tolist(), SLICE):
                out = []
                for i, frames in zip(range(a, b), batch.column(5).slice(a, b - a).to_pylist()):
                    if forms[i] == "plain":
                        out.append((None, None, frames))
                        continue
                    reader = Reader(frames)
                    x, x_chars = reader.after_units(first[i], lines[i])
                    y, y_chars = reader.after_units(second[i], lines[i])
                    spans = {PREFIX: (0, x), MIDDLE: (x, y), SUFFIX: (y, reader.size)}
                    writer.start()
                    for mark in (SUFFIX, PREFIX, MIDDLE) if forms[i] == "spm" else (PREFIX, SUFFIX, MIDDLE):
                        writer.append(mark.encode())
                        copied(reader, writer, *spans[mark])
                    out.append((x_chars, y_chars - x_chars, writer.frames))
                columns = [batch.column(c).slice(a, b - a) for c in range(3)]
                made = [pa.array([row[c] for row in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), _FRAMES))]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

    counts = [T.StructField(name, T.LongType()) for name in ("prefix_chars", "middle_chars")]
    schema = T.StructType([*decided.schema.fields[:3], *counts, T.StructField("frames", FRAMES, False)])
    return decided.mapInArrow(arrange, schema)


def restored(reader: Reader, form: str) -> Iterator[bytes]:
    """The original text's bytes in order, from a rearranged text and its form alone."""
    if form == "plain":
        yield from reader.read()
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    begins, at = {}, 0
    for mark in order:
        begins[mark] = at = reader.find(mark.encode(), at)
        if at < 0:
            raise ValueError(f"{mark} is missing")
    begins["end"] = reader.size
    after = dict(zip(order, [*order[1:], "end"]))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from reader.read(begins[mark] + len(mark), begins[after[mark]])


def _with_read(moved: DataFrame, fields: list[T.StructField], kinds: list[pa.DataType], read) -> DataFrame:
    """`moved` with its frames replaced by what `read(reader, form)` gives for each row."""
    kept = [c for c in moved.columns if c not in ("frames", *[f.name for f in fields])]
    narrow = moved.select(*kept, "frames")
    at, form = len(kept), kept.index("form")
    schema = T.StructType([*narrow.schema.fields[:at], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(form).to_pylist()
            weights = pa.compute.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False) * FRAME
            for a, b in slices(weights.tolist(), SLICE):
                found = [read(Reader(frames), forms[a + i]) for i, frames in enumerate(batch.column(at).slice(a, b - a).to_pylist())]
                made = [pa.array([row[c] for row in found], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(at)), *made], names=schema.names)

    return narrow.mapInArrow(run, schema)


def texts(moved: DataFrame) -> DataFrame:
    """`arranged` rows with `output` (the rearranged text) in place of the frames."""
    return _with_read(moved, [T.StructField("output", T.StringType(), False)], [pa.string()], lambda reader, form: (b"".join(reader.read()).decode(),))


def digests(moved: DataFrame) -> DataFrame:
    """`arranged` rows with `output_sha256` and `restored_sha256` in place of the frames, streamed frame by frame."""

    def both(reader: Reader, form: str) -> tuple[str, str]:
        pair = []
        for parts in (reader.read(), restored(reader, form)):
            digest = hashlib.sha256()
            for part in parts:
                digest.update(part)
            pair.append(digest.hexdigest())
        return pair[0], pair[1]

    return _with_read(moved, [T.StructField(name, T.StringType(), False) for name in ("output_sha256", "restored_sha256")], [pa.string(), pa.string()], both)
