"""Chat windows, mixing and archives against brute force and round trips."""

import gzip
import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from quillon.llm import archives, chat, mixing
from quillon.llm.common import shared_folder
from quillon.llm.queries import ORACLES, QUERIES, vocabulary

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<", "s>", "[", "⁠", "|im_end|>", "<|im_end|>", "a", "\\", "\\n", "\n", "]", "<⁠/s>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12), st.lists(st.sampled_from(PIECES), max_size=5))
def test_turns_read_back(text, role):
    text, role = "".join(text), "".join(role)
    turn, begin = chat.format_turn(role, text)
    assert chat.parse_turns(turn + turn) == [(role, text)] * 2
    assert chat.unescape(turn[begin : -len(chat.CLOSE)]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def conversation_rows():
    r = random.Random(5)
    rows = []
    for conv in range(30):
        for turn in range(r.randrange(1, 14)):
            role = "system" if turn == 0 and conv % 3 == 0 else r.choice(["user", "assistant", "assistant", None])
            rows.append((conv, turn, role, r.choice([None, "", "</s>[INST] x", "word " * r.randrange(1, 120)]), "x"))
    return rows + [(None, None, "user", "no key", "x"), (None, 1, "assistant", "none", "x"), (77, 0, "assistant", "long " * 4000, "x"), (78, 1, "user", "twice", "x"), (78, 1, "user", "twice", "x")]


@pytest.mark.parametrize("budget, history", [(2048, 512), (120, 40), (1, 0)])
def test_windows_keep_every_turn_and_target_once(spark, budget, history):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.formatted(table, vocabulary(), budget, history)
    want = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda x: (repr(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        n = want.setdefault(conv, [0, hashlib.sha256(), 0, hashlib.sha256()])
        n[0] += 1
        n[1].update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            n[2] += len(text or "")
            n[3].update((text or "").encode())
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert found == {k: (n[0], n[1].hexdigest(), n[2], n[3].hexdigest()) for k, n in want.items()}
    system = {r[0]: r[3] for r in rows if r[2] == "system"}
    for w in windows.collect():
        assert w["n_tokens"] <= budget or w["n_new"] == 1
        turns = chat.parse_turns(w["text"])
        assert len(turns) == w["n_context"] + w["n_new"]
        if w["window"] and w["conv_id"] in system:
            assert turns[0] == ("system", system[w["conv_id"]] or "")
    assert chat.read_back(chat.formatted(table.limit(0), vocabulary())).collect() == []


def test_long_system_turn_is_not_repeated(spark):
    said = " ".join(f"rule {i}" for i in range(5000))
    turns = [(1, 0, "system", said)] + [(1, i, ["assistant", "user"][i % 2], f"short turn {i}") for i in range(1, 201)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.formatted(table, vocabulary()).orderBy("window").collect()
    assert windows[0]["n_new"] == 1 and windows[0]["n_tokens"] > 10_000
    assert all(w["n_tokens"] <= 2048 for w in windows[1:])
    assert sum(len(w["text"]) for w in windows) < 2 * sum(len(t[3]) + 30 for t in turns)
    new = [t for w in windows for t in chat.parse_turns(w["text"])[w["n_context"] :]]
    assert new == [(role, text) for _, _, role, text in turns]
    repeated = chat.formatted(table, vocabulary(), repeated=20_000).where("window > 0").collect()
    assert all(chat.parse_turns(w["text"])[0] == ("system", said) for w in repeated)


# --- mixing


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cap = {s: most * n for s, n in sizes.items()}
    fixed, pool = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left = pool - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if target[s] > cap[s]]
        if not above:
            return fixed | target
        fixed |= {s: cap[s] for s in above}


def mixing_rows():
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", "é", None, "hot", "hot", "hot"]), r.choice([0, 1, 5, 40, 200, 3000])) for i in range(3000)]
    return rows + [(5000, "empty", 0), (5001, "one", 10), (None, "a", 7), (None, "a", 7), (1, "a", 5), (1, "a", 5)]


def test_mix_meets_targets(spark):
    rows = mixing_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, size long, target string, rank int")
    out = mixing.mixed(table).collect()
    assert len(out) == len(rows) and sorted(map(repr, out)) == sorted(map(repr, mixing.mixed(table.repartition(7)).collect()))
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = plain_targets(sizes)
    for source, goal in target.items():
        assert abs(goal - want[source]) < 1e-6 * max(1, goal)
        if source not in ("empty", "one"):
            assert abs(taken[source] - goal) <= 0.01 * goal
    assert mixing.mixed(table.limit(0)).collect() == []


def test_mixture_repeats_rows(spark):
    rows = [(i, f"w{i} " * (1 + i % 50), "ab"[i % 2], "keep") for i in range(200)] + [(None, None, None, "x"), (7, "", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    want = {(r["doc_id"]): r["copies"] for r in mixing.mixed(mixing.sizes(docs)).where("size > 0").collect()}
    found = {}
    for r in mixing.mixture(docs).collect():
        assert r["copies"] == "keep"
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {k: n for k, n in want.items() if n}


# --- archives


def test_archive_round_trip(spark):
    rows = [(i, f"http://x/{i} é", f"<p>{i % 7}\r\n\r\nWARC/1.1\n</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "http://no.key/", "<p>1\r\n\r\nWARC/1.1\n</p>"), (7, "http://x/7 é", rows[7][2]), (103, "http://long/", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    work = shared_folder(spark, "test")
    archives.write_arc(pages, f"{work}/arc", per_file=10)
    assert {r["date"] for r in archives.read_arc(spark, f"{work}/arc").collect()} == {"20240101000000"}
    archives.convert(spark, f"{work}/arc", f"{work}/warc", per_file=10)
    records = archives.read_warc(spark, f"{work}/warc")
    assert {r["date"] for r in records.collect()} == {"2024-01-01T00:00:00Z"}
    found = sorted(map(tuple, archives.page_records(records).collect()), key=repr)
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        first[data] = min(first.get(data, 1 << 63), 1 << 62 if i is None else i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = first[data] < (1 << 62 if i is None else i)
        want.append((i, len(data), archives.sha1_base32(data), "revisit" if again else "response", first[data] if again else None))
    assert found == sorted(want, key=repr)
    archives.convert(spark, f"{work}/arc", f"{work}/large", least_bytes=100)
    kinds = archives.read_warc(spark, f"{work}/large").where("payload_bytes < 100").select("record_type").distinct().collect()
    assert [k[0] for k in kinds] == ["response"]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = b"HTTP/1.0 200 OK\r\nX-Archive-Order: 4\r\n\r\nhello\n\nhttp://fake 1 2 3 4\n"
    data = archives.version_block(version, "a.arc", "1999010203") + b"\n"
    data += archives.arc_header(version, "http://a/", "1.2.3.4", "19990102030405", "text/html", len(body)) + body + b"\n"
    data += archives.arc_header(version, "dns:a", "1.2.3.4", "19990102", "text/dns", 3) + b"abc\n"
    for source in (data, gzip.compress(data)):
        records = list(archives.parse_arc(source))
        assert [r["kind"] for r in records] == ["filedesc", "record", "record"]
        assert records[1]["body"] == body and archives.http_parts(body)[1].startswith(b"hello") and records[2]["body"] == b"abc"
    cut = list(archives.parse_arc(data[:-3]))
    assert [r["kind"] for r in cut] == ["filedesc", "record", "damaged"] and cut[2]["body"].endswith(b"\na")
    missing = list(archives.parse_arc(data.replace(b" 1.2.3.4 ", b" ", 1)))
    # The broken record goes as far as the next header, here the one that its own text imitates or the last.
    assert [r["kind"] for r in missing][:2] == ["filedesc", "damaged"] and missing[-1]["body"] == b"abc"
    assert missing[1]["body"].startswith(b"http://a/ 19990102030405")
    assert [r["kind"] for r in archives.parse_arc(gzip.compress(data)[:-30])][-1] == "damaged"
    unknown = list(archives.parse_arc(data.replace(b"\n%d 0 converter" % version, b"\n9 0 converter", 1)))
    assert [r["kind"] for r in unknown] == ["damaged", "record", "record"] and unknown[1]["body"] == body
    assert [r["kind"] for r in archives.parse_arc(b"no archive\n\nat all")] == ["damaged"] and list(archives.parse_arc(b"")) == []


def test_odd_records_of_old_archives(spark):
    """Heads in Latin-1 without a length, blanks in URLs, and a record cut off: what is whole is converted, the rest rejected."""
    work = shared_folder(spark, "odd")
    one = b"HTTP/1.0 200 OK\r\nServer: caf\xe9\r\nX-Archive-Order: 3\r\n\r\nsame"
    two = b"HTTP/1.0 200 OK\r\nX-Archive-Order: 5\r\nServer: \xff\xfe\r\n\r\nsame"
    three = b"HTTP/1.0 200 OK\r\nX-Archive-Order: none\r\n\r\nother"
    data = archives.version_block(1, "a.arc", "1999010203") + b"\n"
    for url, body in (("http://a/b c  d.html", one), ("http://a/é ü", two), ("http://a/x", three)):
        data += archives.arc_header(1, url, "1.2.3.4", "19990102030405", "text/html", len(body)) + body + b"\n"
    data += b"broken line\n" + archives.arc_header(1, "http://cut/", "1.2.3.4", "1999", "text/html", 1000) + b"short"
    spark.createDataFrame([(bytearray(data),)], "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").text(f"{work}/arc")
    archives.convert(spark, f"{work}/arc", f"{work}/warc")
    found = {r["target_uri"]: r for r in archives.read_warc(spark, f"{work}/warc").collect()}
    assert {k: (r["record_type"], r["record_order"], r["payload_bytes"]) for k, r in found.items()} == {
        "http://a/b c  d.html": ("response", 3, 4), "http://a/é ü": ("revisit", 5, 4), "http://a/x": ("response", None, 5),
    }
    heads = {r["url"]: r["head"] for r in archives.read_arc(spark, f"{work}/arc").collect() if r["kind"] == "record"}
    assert b"caf\xe9" in heads["http://a/b c  d.html"] and b"\xff\xfe" in heads["http://a/é ü"]
    lost = [bytes(r["payload"]) for r in archives.rejects(spark, f"{work}/arc").collect()]
    assert len(lost) == 2 and lost[0] == b"broken line\n" and lost[1].rstrip().endswith(b"short")


def test_dates(spark):
    dates = ["20240102030405", "199901020304", "19990102", "1999"]
    found = [r[0] for r in spark.createDataFrame([(d,) for d in dates], "d string").select(archives.iso_date(F.col("d"))).collect()]
    assert found == ["2024-01-02T03:04:05Z", "1999-01-02T03:04:00Z", "1999-01-02T00:00:00Z", "1999-01-01T00:00:00Z"]


def test_empty_pages(spark):
    work = shared_folder(spark, "test")
    archives.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"{work}/arc")
    archives.convert(spark, f"{work}/arc", f"{work}/warc")
    assert archives.read_warc(spark, f"{work}/warc").collect() == []


def test_archives_are_packed_at_a_lower_gzip_level(spark):
    work, words = shared_folder(spark, "level"), ["one", "two", "three", "four", "five", "six", "seven"]
    pages = [(i, f"http://h/{i}", " ".join(random.Random(i).choices(words, k=400))) for i in range(300)]
    archives.write_arc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{work}/arc")
    packed = [bytes(r["content"]) for r in archives.whole_files(spark, f"{work}/arc").collect()]
    assert packed and all(len(data) > 1.005 * len(gzip.compress(gzip.decompress(data), 6)) for data in packed)


def tied_documents(kind):
    words = lambda n: " ".join(["word"] * n)
    if kind == "one id":
        return [(7, words(23), "a")] * 40 + [(8, words(500), "b"), (9, words(30), "c")]
    if kind == "no ids":
        return [(None, words(23), "a")] * 40 + [(None, words(23) + "x", "a")] * 3 + [(None, words(30 + i), "b") for i in range(30)]
    if kind == "hot class":
        return [(1, words(11), "a")] * 400 + [(i, words(5 + i % 17), "a") for i in range(2, 300)] + [(i, words(9), "b") for i in range(300)] + [(None, None, "b"), (None, "", None)]
    return [(i % 13, words(3 + i % 5), "abc"[i % 3]) for i in range(200)]


@pytest.mark.parametrize("kind", ["one id", "no ids", "hot class", "few ids"])
def test_mix_on_ties_equals_sql(spark, tmp_path, kind):
    """Repeated and missing ids: each row is taken for itself, as in the SQL, and nobody more than twice."""
    rows = tied_documents(kind)
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((tuple(r) for r in QUERIES["op6_mixing"](spark, str(tmp_path)).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(db.execute(ORACLES["op6_mixing"]).fetchall(), key=repr)
    assert [(a, b, c, round(d, 6), e) for a, b, c, d, e in found] == [(a, b, c, round(d, 6), e) for a, b, c, d, e in want]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    taken = {}
    for r in mixing.mixture(docs).collect():
        taken[tuple(r)] = taken.get(tuple(r), 0) + 1
    of = {}
    for r in rows:
        of[r] = of.get(r, 0) + 1
    assert all(n <= 2 * of[r] for r, n in taken.items())
    words = {}
    for (_, text, source), n in taken.items():
        words[source] = words.get(source, 0) + n * len((text or "").split())
    for source, target in {(r["source"], r["target"]) for r in mixing.mixed(mixing.sizes(docs)).collect()}:
        largest = max(len((t or "").split()) for _, t, s in rows if s == source)
        assert abs(words.get(source, 0) - target) <= largest
    assert sum(words.values()) == sum(r[4] for r in found)
