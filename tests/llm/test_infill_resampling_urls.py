"""Fill-in-the-middle, importance resampling and URL filters against brute force and round trips."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillon.llm import infill, resampling, urls
from quillon.llm.common import shared_folder
from quillon.session import checkpoint_folder


def plainly_infilled(key, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (key, len(units), "plain", None, None, text or "")
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return (key, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (key, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


INFILL_TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "ä\n€\n𝄞", "x<P>y\nz", "<", "<P", "P>\n<S", "<\nM>", "one\r\ntwo\r\n", "\x00\n\x00",
    "long line " * 3000, "é" * 5001, "".join(f"line {i} ü\n" for i in range(4000)), "a\n" * 30_000 + "tail",
]


@pytest.mark.parametrize("size", [7, 1000, infill.FRAME])
@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (100, 100)])
def test_infilled_texts_equal_plain_ones(spark, size, rate, spm):
    texts = [t if size > 7 or len(t or "") < 50_000 else t[:2000] for t in INFILL_TEXTS]
    docs = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(3, "again\nand\nagain")] * 2
    table = spark.createDataFrame([(k, t, "own") for k, t in docs], "doc_id long, text string, frames string")
    moved = infill.arranged(infill.framed(table, size=size), rate=rate, spm=spm)
    want = sorted((plainly_infilled(k, t, rate, spm) for k, t in docs), key=repr)
    assert sorted((tuple(r) for r in infill.texts(moved).collect()), key=repr) == want
    digests = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in infill.digests(moved).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert digests == {(k, sha(plainly_infilled(k, t, rate, spm)[-1]), sha(t)) for k, t in docs}


def test_infill_opens_only_the_cut_frames():
    writer = infill.Writer(64)
    writer.start()
    text = "".join(f"line {i}\n" for i in range(1000)).encode()
    writer.append(text)
    reader, out = infill.Reader(writer.frames), infill.Writer(64)
    opened = []
    unpack = reader.open
    reader.open = lambda i: (opened.append(i), unpack(i))[1]
    a, b = reader.after_units(300, 1000)[0], reader.after_units(700, 1000)[0]
    out.start()
    for begin, end in ((b, reader.size), (0, a), (a, b)):
        infill.copied(reader, out, begin, end)
    assert len(set(opened)) <= 3 < len(writer.frames) / 20
    lines = text.splitlines(keepends=True)
    assert b"".join(infill.Reader(out.frames).read()) == b"".join(lines[700:] + lines[:700])
    assert out.units == 1000 and out.chars == len(text)


def test_infill_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.digests(infill.arranged(infill.framed(docs))).collect() == []
    with pytest.raises(ValueError, match="missing columns: text"):
        infill.framed(docs.drop("text"))


LOWERED = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


ALPHABET = st.text(alphabet="aBz09 .\n\x00@[`{é世ÀK", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET | st.sampled_from([None, "x" * 63, "x" * 64 + " y", "q" * 3000 + " Q " + "w" * 65]), max_size=6), st.sampled_from([8, 64, 1 << 20]))
def test_buckets_are_crc32_of_all_runs(texts, block):
    data = "".join(t or "" for t in texts).encode()
    ends = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    held, resampling.BLOCK = resampling.BLOCK, block
    try:
        words, found = [0] * len(texts), [[] for _ in texts]
        for owners, runs in resampling.Features(1 << 31).of(np.frombuffer(data, np.uint8), ends):
            for i in owners.tolist():
                words[i] += 1
            for owner, bucket in runs:
                for i, x in zip(owner.tolist(), bucket.tolist()):
                    found[i].append(x)
    finally:
        resampling.BLOCK = held
    for i, text in enumerate(texts):
        n, want = features(text)
        assert words[i] == n and sorted(found[i]) == sorted(x % (1 << 31) for x in want)


def plainly_resampled(docs, target, percent, least, buckets):
    s, t = [0.0] * buckets, [0.0] * buckets
    own = [features(text) for _, text in docs]
    for counts, all_features in ((s, [f for _, f in own]), (t, [features(x)[1] for x in target])):
        for x in itertools.chain(*all_features):
            counts[x % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for (key, _), (n, found) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % buckets] for x in found)
        out.append([key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], 1 << 63 if r[0] is None else r[0]))
    for place, row in enumerate(able[: percent * len(able) // 100]):
        row[5] = place + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [0, 5, 37, 100])
def test_resampled_equals_plain(spark, percent):
    r = random.Random(percent)
    texts = [" ".join(r.choice("alpha Beta gamma delta 7 é 世界".split()) for _ in range(r.randrange(0, 60))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3] + " a" * 30), (None, None), (500, ""), (501, "word " * 60_000), (7, texts[7])]
    target = ["alpha alpha beta", None, "世界 7 7 7"]
    table = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, score int").repartition(5)
    found = resampling.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, buckets=97)
    assert sorted((tuple(x) for x in found.collect()), key=repr) == plainly_resampled(docs, target, percent, 20, 97)


def test_cutoff_among_many_ties(spark):
    """Equal scores, one hot id and rows told apart by their place alone; every k is met exactly."""
    r = random.Random(1)
    rows = [(r.choice([5, 5, 5, 4, 9]), r.choice([1, 1, 2, 1 << 40]), i) for i in range(3000)]
    order = sorted(rows, key=lambda x: (-x[0], x[1], x[2]))
    work = shared_folder(spark, "keys")
    spark.createDataFrame(rows, "score long, id long, row long").repartition(7).write.parquet(f"{work}/all")
    keys = spark.read.parquet(f"{work}/all")
    for k in (1, 2, 1500, 2999, 3000):
        (score, id_, row), rounds = resampling.cutoff(keys, k, f"{work}/{k}")
        assert (-score, id_, row) == order[k - 1] and rounds <= 2 + math.log(3000, 4 / 3)
    assert resampling.cutoff(keys, 0, work) == (None, 0)


def test_resampling_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    assert resampling.resampled(empty, some).collect() == []
    (row,) = resampling.resampled(some, empty, percent=100).collect()
    assert row["rank"] == 1 and row["n_features"] == 25 + 24 + 23


def plain_parts(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    host, path, query = (x or "" for x in found.groups()) if found else ("", "", "")
    return host.translate(LOWERED), path, query


def plain_tokens(url):
    out = set()
    for place, part in zip(("host", "path", "query"), plain_parts(url)):
        out |= {f"{place}:{w}" for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[0-9]+", "0", part.translate(LOWERED)))}
    return frozenset(out)


URLS = [
    None, "", "no scheme", "http://", "://x.net/a", "http://NET", "https://a.b.NET/x?y=http://c.org/fr/", "http://notnet/", "http://x.example.net/en/1",
    "http://example.net/en", "http://example.com/de/1#f", "http://fooexample.com/de/", "http://w.org/fr/", "http://org/fr/x", "http://é.org/FR/?Ä=Ö9", "a\nb://h.net/\n",
    "http://x.net?en", "ftp://u:p@x.net:80/" + "seg/" * 5000,
]


def test_url_parts_and_listed_rules(spark):
    table = spark.createDataFrame([(i % 15, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    found = urls.judged(table, urls.mined(spark.createDataFrame([], "tokens array<string>, verdict string")))
    got = sorted((tuple(r)[1:5] for r in found.collect()), key=repr)
    want = []
    for url in URLS:
        host, path, _ = plain_parts(url)
        fits = [(len(r), r, v) for v, r in urls.LISTED if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append((host, path, rule, verdict))
    assert got == sorted(want, key=repr)
    tokens = [set(r[0]) for r in table.select(urls.tokens("url")).collect()]
    assert tokens == [plain_tokens(u) for u in URLS]


def brute_rules(labelled, min_support, min_count, min_confidence):
    """All rules by counting every subset of every row's items."""
    n = len(labelled)
    least = max(math.ceil(min_support * n), min_count)
    rows = {}
    for i, (tokens, _) in enumerate(labelled):
        for t in tokens:
            rows.setdefault(t, set()).add(i)
    classes = {}
    for t, own in rows.items():
        if len(own) >= least:
            classes.setdefault(frozenset(own), []).append(t)
    items = {min(ts): (frozenset(ts), own) for own, ts in classes.items()}
    base, both = {}, {}
    for i, (_, verdict) in enumerate(labelled):
        own = sorted(name for name, (_, at) in items.items() if i in at)
        for size in range(1, len(own) + 1):
            for chosen in itertools.combinations(own, size):
                base[chosen] = base.get(chosen, 0) + 1
                both[chosen, verdict] = both.get((chosen, verdict), 0) + 1
    both = {k: v for k, v in both.items() if v >= least}
    out = []
    for (chosen, verdict), count in both.items():
        confidence, share = count / base[chosen], sum(v == verdict for _, v in labelled) / n
        shorter = [both[less, verdict] / base[less] for less in itertools.combinations(chosen, len(chosen) - 1) if less]
        if confidence >= min_confidence and confidence > share + 1e-12 and all(confidence > x for x in shorter):
            out.append((confidence, count, frozenset().union(*(items[c][0] for c in chosen)), verdict))
    return out


def labelled_rows(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        host, lang, spam = r.choice(["a", "b", "c", "d"]), r.choice(["en", "fr", "de"]), r.random() < 0.3
        word = r.choice(["casino", "win"]) if spam else r.choice(["news", "blog", "win"])
        url = f"http://{word}.{host}.example.com/{lang}/{r.randrange(99)}?utm=1&src=feed"
        bad = (word == "casino") or (word == "win" and lang == "de") or r.random() < 0.05
        rows.append((url, "block" if bad else "allow"))
    return rows


def test_mined_rules_equal_brute_force_and_find_what_was_planted(spark):
    rows = labelled_rows(3)
    table = spark.createDataFrame(rows, "url string, verdict string").select(urls.tokens("url").alias("tokens"), "verdict")
    found = urls.mined(table, 0.02, 5, 0.8)
    want = brute_rules([(plain_tokens(u), v) for u, v in rows], 0.02, 5, 0.8)
    assert sorted((r["confidence"], r["n"], sorted(r["tokens"]), r["verdict"]) for r in found.collect()) == sorted((c, n, sorted(t), v) for c, n, t, v in want)
    fresh = labelled_rows(4)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged(pages, found, listed=()).collect()}
    for i, (url, _) in enumerate(fresh):
        fits = [(c, n, len(t), v == "block", sorted(t), v) for c, n, t, v in want if t <= plain_tokens(url)]
        assert got[i]["verdict"] == (max(fits)[-1] if fits else "allow")
        assert got[i]["reason"] == (" ".join(max(fits)[4]) if fits else None)
    assert sum(got[i]["verdict"] == v for i, (_, v) in enumerate(fresh)) >= 0.9 * len(fresh)


def test_a_frequent_template_is_one_item(spark):
    url = "http://x.example.com/" + "/".join(f"seg{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    rows = [(url, "block")] * 40 + [("http://y.example.com/z", "allow")] * 40 + [("http://y.example.com/z", None)] * 5
    table = spark.createDataFrame(rows, "url string, verdict string").select(urls.tokens("url").alias("tokens"), "verdict")
    found = {(r["verdict"], len(r["tokens"]), r["n"]) for r in urls.mined(table, 0.01, 5, 0.8).collect()}
    assert found == {("block", 61, 40), ("allow", 2, 40)}


def test_url_filters_leave_no_files_behind(spark):
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    labelled = spark.createDataFrame(labelled_rows(3), "url string, verdict string").select(urls.tokens("url").alias("tokens"), "verdict")
    urls.mined(labelled, 0.02, 5, 0.8).count()
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("labelled")]


def test_url_filters_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert urls.judged(pages, urls.mined(urls.labelled_urls(pages, labels))).collect() == []
