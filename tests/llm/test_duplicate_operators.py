"""SimHash, vectors and repeated strings against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash

from quillon.llm import repeats, simhash, vectors
from quillon.llm.common import components, star_forest
from quillon.llm.queries import ORACLES, QUERIES


def groups(nodes, linked):
    """Smallest node reachable from each node."""
    low = {n: n for n in nodes}
    while True:
        moved = False
        for a, b in linked:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not moved:
            return low


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    links += [(5, 5), (9, 8), (9, 8)]
    r.shuffle(links)
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({n for link in links for n in link}, links)
    assert found == {n: m for n, m in want.items() if n != 5}
    a, b = star_forest(np.array([x for x, _ in links]), np.array([y for _, y in links]))
    assert dict(zip(a.tolist(), b.tolist())) == {n: m for n, m in want.items() if n != m}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- fingerprints


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit, n in enumerate(ones) if 2 * n > len(shingles))


def random_docs():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "É", "delta", "eps", "zeta", "eta"]
    docs = [None, "", "  ", "one", "ONE", "one two three", "a b c d", "a b c d e"]
    for _ in range(60):
        base = [r.choice(words) + str(r.randrange(30)) for _ in range(r.randrange(1, 150))]
        docs.append(" ".join(base))
        for _ in range(r.randrange(3)):
            near = list(base)
            near[r.randrange(len(near))] = "changed"
            docs.append("\t".join(near))
    return docs + docs[:20]


@pytest.mark.parametrize("part", [4096, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rows = [(i, text, "x") for i, text in enumerate(random_docs())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    prints = {i: plain_fingerprint(text) for i, text, _ in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(prints, linked)
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in found} == {i: (prints[i], want[i]) for i in prints}
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()}
    assert kept == {i for i in prints if want[i] == i}


def test_fingerprint_links_of_close_bits(spark):
    r = random.Random(5)
    prints = set()
    for _ in range(120):
        base = r.getrandbits(64)
        for _ in range(6):
            prints.add(base)
            for bit in r.sample(range(64), r.randrange(1, 7)):
                base ^= 1 << bit
    prints |= {sum(1 << bit for bit in bits) for bits in ([], [0], [63], range(32), range(64))}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    linked = [(signed[a], signed[b]) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed.values()], "fp long")).collect()
    nodes = set(signed.values())
    assert groups(nodes, [(x["a"], x["b"]) for x in links]) == groups(nodes, linked)
    fps = np.array(sorted(prints), np.uint64)
    a, b = simhash.linked_within(fps, simhash.pivots())
    found = [(signed[int(fps[x])], signed[int(fps[y])]) for x, y in zip(a, b)]
    assert groups(nodes, found) == groups(nodes, linked)


def test_documents_without_a_key(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (9, "a b c"), (None, "other words here")], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert found == [(0, 0), (0, 4), (4, 4), (9, 4)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c"), (None, "A b c"), (4, "x y z w"), (4, "x y z w"), (None, "x y z w"), (5, "X y z w"), (None, "alone"), (6, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept.collect())
    assert found == [(0, "a b c"), (0, "alone"), (4, "x y z w"), (6, "")]
    apart = spark.createDataFrame([(1, "one text"), (1, "other text"), (1, "one text")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.without_near_duplicates(apart).collect()) == ["one text", "other text"]
    assert simhash.without_near_duplicates(docs.limit(0)).collect() == []


# --- vectors


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(60, 16))
    rows = [v.tolist() for v in base]
    rows += [(base[i % 12] + 0.08 * r.normal(size=16)).tolist() for i in range(240)]
    rows += [rows[3], rows[3], [2 * x for x in rows[5]], [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    table = spark.createDataFrame([(i, v, 1, True) for i, v in enumerate(rows)] + [(None, rows[0], 1, False)], "vec_id long, embedding array<double>, n_links int, kept boolean")
    found = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_duplicates(table).collect()}
    keyless = len(rows)  # it links like any other, but names no component
    good = {i: np.array(v, float) for i, v in enumerate([*rows, rows[0]]) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    linked = [
        (a, b) for a in good for b in good
        if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95 * np.linalg.norm(good[a]) * np.linalg.norm(good[b])
    ]
    low = groups(range(len(rows) + 1), linked)
    want = {i: (sum(i in pair for pair in linked), low[i], low[i] == i) for i in range(len(rows))}
    want[None] = (sum(keyless in pair for pair in linked), low[keyless], False)
    assert found == want
    assert vectors.near_duplicates(table.limit(0)).collect() == []


def test_graph_recall_in_a_large_group():
    r = np.random.default_rng(9)
    data = vectors.unit(np.concatenate([r.normal(size=(1200, 32)), r.normal(size=32) + 0.1 * r.normal(size=(400, 32))]))
    graph = vectors.Graph.build(data)
    graph.close()
    query, node = graph.within(data.astype(np.float32), data, data, 0.95, vectors.audited_beam(graph, data, 0.95))
    true = int((data @ data.T >= 0.95).sum())
    assert len(set(zip(query.tolist(), node.tolist()))) == len(query) and true - len(query) <= 0.001 * true


# --- repeated strings


def plain_removal(docs):
    low, out = {}, []
    for key, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            window = data[i : i + 50]
            low[window] = min(low.get(window, float("inf")), float("inf") if key is None else key)
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if low[data[i : i + 50]] < (float("inf") if key is None else key):
                gone[i : i + 50] = b"\1" * 50
        spans, i = [], 0
        while i < len(data):
            j = i
            while j < len(data) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((key, tuple(spans), hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def passages():
    r = random.Random(11)
    letters = "abcdefgh éü日"
    common = ["".join(r.choice(letters) for _ in range(r.randrange(30, 140))) for _ in range(12)]
    docs = [(None, common[0] * 2), (3, None), (4, ""), (5, "a" * 300), (6, "a" * 49), (7, "b" + "a" * 80), (8, "ab" * 90), (9, "ba" * 60)]
    for i in range(20, 140):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts.append("".join(r.choice(letters) for _ in range(r.randrange(0, 80))))
            if r.random() < 0.6:
                passage = r.choice(common)
                cut = r.randrange(len(passage) // 2)
                parts.append(passage[cut:])
        docs.append((i, "".join(parts)))
    docs += [(200 + i, t) for i, (_, t) in enumerate(docs[20:30])] + docs[40:44]
    return docs


@pytest.mark.parametrize("most", [4096, 2])
def test_removed_ranges_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_BORDERS", most)
    docs = passages()
    table = spark.createDataFrame([(k, t, "s", "z") for k, t in docs], "doc_id long, text string, spans string, doc string")
    found = [
        (r["doc_id"], tuple((s["start"], s["end"]) for s in r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in repeats.without_repeats(table).collect()
    ]
    assert sorted(found, key=repr) == plain_removal(docs)


def test_texts_of_one_key_stay_apart(spark):
    r = random.Random(13)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(r.randrange(50, 160))) for _ in range(8000)]
    seen, alike = {}, []
    for text in texts:
        other = seen.setdefault(xxhash.xxh64_intdigest(text.encode(), 42) >> 43, text)
        alike += [(other, text)] * (other != text)
    assert len(alike) > 3
    docs = [(1, a + a[::-1]) for a, _ in alike] + [(key, text) for pair in alike for text in pair for key in (None, None, 7)]
    found = [
        (r["doc_id"], tuple((s["start"], s["end"]) for s in r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    ]
    assert sorted(found, key=repr) == plain_removal(docs)


def test_long_text_and_empty_table(spark):
    r = random.Random(12)
    long = "".join(r.choice("abcdefghij ") for _ in range(300_000))
    docs = [(1, long[1000:1200]), (2, long), (3, long[299_000:] + "tail")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats.without_repeats(table).collect()}
    assert found == {1: [], 2: [(1000, 1200)], 3: [(0, 1000)]}
    assert repeats.without_repeats(table.limit(0)).collect() == []


def test_suffix_order_is_sorted():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    at = np.arange(0, 3900, 7)
    size = r.integers(1, 60, len(at))
    count = np.full(len(at), len(at))
    ext = repeats.Extensions(data)
    order = repeats.suffix_order(ext, at, size, np.zeros(len(at), np.int64), count)
    texts = [bytes(data[a : a + n]) for a, n in zip(at, size)]
    assert [texts[i] for i in order] == sorted(texts)


def test_rows_of_one_key_link_with_each_other_as_in_sql(spark, tmp_path):
    """Different vectors under one repeated key, copies under several keys, and rows without a key."""
    r = np.random.default_rng(4)
    base = r.normal(size=(6, 16))
    near = lambda i: (base[i] + 0.01 * r.normal(size=16)).tolist()
    rows = [(1, near(0)), (1, near(0)), (5, near(0)), (7, near(1)), (7, near(1)), (9, base[2].tolist()), (3, base[2].tolist()), (3, base[2].tolist()), (None, near(3)), (None, near(3))]
    rows += [(None, near(1)), (8, near(4)), (8, near(5)), (11, None), (11, [0.0] * 16), (None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sorted((tuple(x) for x in QUERIES["op5_embedding_near_dedup"](spark, str(tmp_path)).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert found == sorted(db.execute(ORACLES["op5_embedding_near_dedup"]).fetchall(), key=repr)
    assert (1, 2, 1, True) in found and (7, 2, 7, True) in found and (None, 1, None, False) in found
