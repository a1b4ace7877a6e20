"""Quality rules, language identification, page extraction and tokens against brute force, held-out labels and round trips."""

import base64
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from quillon.llm import bpe, extraction, langid, quality
from quillon.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, counts int, ids string, decoded string"


def plain_counts(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered)


def odd_texts():
    r = random.Random(4)
    some = ["", " \n\t", "a", "a b c a b c", "x\x1cy\x85z\xa0w", "é\né\n é\n", "#*$%&|<>", "a " * 4000, "\x0b\x0c\r\n"]
    return some + ["".join(r.choice("ab \n|é") for _ in range(r.randrange(60))) for _ in range(300)]


def test_counts_equal_plain_ones():
    for text in odd_texts():
        assert quality.counts_of(text)[:5] == plain_counts(text), text


def test_quality_rows(spark):
    texts = [None, "", *["word " * 60] * 2, "the of and " + " ".join(f"word{i}" for i in range(157))]
    rows = [(None if i == 1 else i, text, None, i, "x", None) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r["text"] or "": r for r in quality.judged(quality.with_counts(docs)).collect()}
    assert out[""]["base_failed"] and not out[""]["kept"]
    assert out["word " * 60]["base_failed"] and out["word " * 60]["counts"]["n_repeat_words"] == 60
    assert out[texts[-1]]["counts"]["n_words"] == 160 and not out[texts[-1]]["base_failed"]
    assert quality.judged(quality.with_counts(docs.limit(0))).collect() == []


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(r.random(20000) < a, good, ~good).astype(int) for a in accuracy], 1)
    votes[r.random(votes.shape) < 0.2] = -1
    model = quality.fit(dict(Counter(map(tuple, votes.tolist()))), len(accuracy))
    assert abs(model.prior - 0.7) < 0.03
    assert np.allclose(model.right_on_good, accuracy, atol=0.04) and np.allclose(model.right_on_bad, accuracy, atol=0.05)
    assert quality.fit({}, 2).prior == 0.5


def test_verdicts_agree_with_labels(spark, sf):
    found = {r["doc_id"]: r for r in QUERIES["op1_quality_rules"](spark, sf).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    judged = [(found[d]["kept"], q) for d, q in labels if not found[d]["base_failed"]]
    assert sum(kept == bool(q) for kept, q in judged) >= 0.97 * len(judged)
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    for d, row in found.items():
        assert tuple(row)[1:6] == plain_counts(texts[d] or "")


# --- languages


def simple_posteriors(emit, step):
    forward = [emit[0]]
    for x in emit[1:]:
        forward.append(forward[-1] @ step * x)
        forward[-1] = forward[-1] / forward[-1].sum()
    backward = [np.ones(emit.shape[1])]
    for x in emit[:0:-1]:
        backward.append(step @ (x * backward[-1]))
        backward[-1] = backward[-1] / backward[-1].sum()
    both = np.array(forward) * np.array(backward[::-1])
    return both / both.sum(1, keepdims=True)


def test_blocks_give_whole_text_posteriors():
    r = np.random.default_rng(0)
    lengths = np.array([1, 31, 32, 33, 64, 65, 200, 2])
    emit, step = r.random((lengths.sum(), 3)) + 0.01, np.exp(r.normal(size=(3, 3)))
    found, at = langid.posteriors(emit, lengths, step), 0
    for n in lengths:
        assert np.allclose(found[at : at + n], simple_posteriors(emit[at : at + n], step))
        at += n


@pytest.fixture(scope="module")
def language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.train(langid.training_sample(docs))


def test_held_out_accuracy(spark, language_model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs, language_model).join(docs, "doc_id").where(langid.held_out()).collect()
    assert len(rows) > 250 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_rows(spark, language_model):
    mixed = "with the thing of this and that " * 3 + "der die nicht und ein keit schlich werden " * 3
    texts = [None, "", "123 _ ² !?", "the", mixed, "the of and " * 9000]
    docs = spark.createDataFrame([(i, t, None, 1, "x", None) for i, t in enumerate(texts)] * 2, DOCS)
    out = {}
    for r in langid.identified(docs, language_model).collect():
        assert out.setdefault(r["doc_id"], r) == r
    assert [out[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and out[0]["score"] == 0
    assert [r["lang"] for r in out[4]["runs"]] == ["en", "de"]
    assert out[5]["n_words"] == 27000 and out[5]["lang_pred"] == "en"
    assert langid.identified(docs.limit(0), language_model).collect() == []
    assert langid.training_sample(docs) == []
    assert {r["lang_pred"] for r in langid.identified(docs, langid.train([])).collect()} == {"und"}


def test_every_language_is_drawn(spark):
    """Many languages, one of long texts only, one frequent one, rows without a key."""
    rows = [(i, f"wort{i} text", f"l{i % 300:03d}", 1, "x", None) for i in range(900)]
    rows += [(i, f"und{i} der die", "de", 1, "x", None) for i in range(1000, 3000)] + [(None, "aa bb", "de", 1, "x", None)] * 50
    rows += [(5000 + i, f"langes{i} " * 4000, "lang", 1, "x", None) for i in range(6)] + [(6000, None, "none", 1, "x", None), (6003, "", "none", 1, "x", None)]
    docs = spark.createDataFrame(rows, DOCS)
    able = {r[2] for r in rows if r[1] and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 != 1}
    sample = langid.training_sample(docs, most=600)
    drawn = Counter(label for label, _ in sample)
    assert set(drawn) == able and len(sample) <= 600 and max(drawn.values()) == 600 // len(able)
    assert set(Counter(label for label, _ in langid.training_sample(docs, most=10)).values()) == {1}
    long = next(text for label, text in sample if label == "lang")
    assert len(long) <= langid.SAMPLE_CHARS and len(set(long.split())) == 1 and len(long.split()) > 1500
    pieces = langid.sequences([(k, ["w"] * (4000 if k else 1)) for k in range(3)], np.random.default_rng(0), most=20)
    assert {label for _, labels in pieces for label in labels} == {0, 1, 2}


# --- pages


def test_blocks_of_markup():
    page = (
        "<!DOCTYPE html><head><title>no</title></head><body><!-- <p>no</p> --><script>var t='</p>';</script>"
        "<p>a &amp;\n  b<p title='>'>c<b>d</b>e<br>f</p><ul><li>g<li>h</ul>tail<style>x</style> end &#233;&nbsp;x <p>  </p><a href=x>l</a>"
    )
    assert [b.text for b in extraction.leaf_blocks(page)] == ["a & b", "cde f", "g", "h", "tail end é x l"] or [
        b.text for b in extraction.leaf_blocks(page)
    ] == ["a & b", "cde f", "g", "h", "tail end é x", "l"]
    assert [b.path[-1] for b in extraction.leaf_blocks("<div class='Ad box'>x<p>y</div>")] == ["box", "p"]
    assert extraction.leaf_blocks("") == [] and extraction.leaf_blocks("<" * 5000)[0].text == "<" * 5000


def test_unclosed_elements_hide_nothing():
    def texts(page):
        return [b.text for b in extraction.leaf_blocks(page)]

    body = "<article><p>Hello</p><p>there</p></article>"
    for head in ("<head><title>x</title>", "<head><title>x", "<HEAD lang=en><meta charset=utf-8><style>p {}</style><script>'<p>'</script><noscript><p>n</p></noscript><title>a <b> c</title></HEAD>"):
        for start in ("<body>", "", "\n<!-- c --><body class=a>"):
            assert texts(f"<html>{head}{start}{body}") == ["Hello", "there"], (head, start)
    assert texts("<head><title>x</title>Hello <p>there") == ["Hello", "there"]
    assert texts("<header>a</header><p>b") == ["a", "b"]
    for kind in ("textarea", "select", "noscript", "template", "svg", "iframe"):
        assert texts(f"<article><p>a</p><{kind} class=comment><p>b</p><p>c</p></article><p>d") == ["a", "b", "c", "d"], kind
        found = extraction.leaf_blocks(f"<article><p>a</p><{kind} class=ad><p>b</p><{kind}>no</{kind}><p>c</p></article><p>d</p><{kind} a='>'><!-- x --><p>no</{kind} >e")
        assert [(b.text, "article" in b.path, "ad" in b.path) for b in found] == [(x, x in "abc", False) for x in "abcde"], kind
    assert texts("<p>a<svg><svg><text>no</text></svg><title>no</title></svg>b<svg/>c<textarea></p><!--</textarea>d") == ["abc", "d"]


def test_labeller_on_unseen_pages_and_layouts(spark):
    pages = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall()
    labeller = extraction.train([p for i, p in pages if i % 2])
    unseen = [extraction.leaf_blocks(p) for i, p in pages if not i % 2]
    random_ = np.random.default_rng(8)
    layouts = [extraction.laid_out([b.text for page in unseen for b in page], random_) for _ in range(200)]
    right = [y for page in unseen for y in extraction.own_labels(page)] + [y for _, labels in layouts for y in labels]
    blocks = unseen + [b for b, _ in layouts]
    said = labeller.label(extraction.Vectors().of(blocks), np.array(list(map(len, blocks)))) >= 0.5
    assert 0.3 < np.mean(right) < 0.9
    assert np.mean(said == np.array(right)) >= 0.995
    rows = [(1, "u", pages[0][1], "old"), (1, "u", pages[0][1], "old"), (None, None, None, None), (2, None, "", "old"), (3, "u", "<p>" * 3000, "")]
    found = extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), labeller)
    assert found.columns == ["page_id", "url", "text"]
    texts = [r["text"] for r in found.collect()]
    truth = "\n".join(b.text for b, y in zip(extraction.leaf_blocks(pages[0][1]), extraction.own_labels(extraction.leaf_blocks(pages[0][1]))) if y)
    assert sorted(texts) == sorted([truth, truth, "", "", ""])
    assert extraction.extracted(found.limit(0).withColumn("html", found["text"]), labeller).collect() == []


# --- tokens


@pytest.fixture(scope="module")
def words():
    return vocabulary()


@pytest.fixture(scope="module")
def reference(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(words, reference, text):
    ids, ends = bpe.Encoder(words).encode([text])
    assert ids.tolist() == reference.encode_ordinary(text) and ends.tolist() == [0, len(ids)]
    assert bpe.decode(ids, words) == text.encode()


def test_ids_of_many_texts(words, reference):
    r = random.Random(6)
    alphabet = ["the", " ", "  ", "\n", "ing", "é", "日本", "12", "'s", "\x85", "!", " ", "zq", "\t "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(800)] + ["z" * 3000, " " * 999, "\n" * 33, '"' * 500 + "a"]
    ids, ends = bpe.Encoder(words).encode(texts)
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == reference.encode_ordinary(text), text


def test_token_rows(spark, words, reference):
    texts = [None, "", "a b", "x " * 30000, "y" * 20000]
    docs = spark.createDataFrame([(i, t, None, 1, "x", "y") for i, t in enumerate(texts)] * 2 + [(None, "n", None, 1, "x", "y")], DOCS)
    out = bpe.decoded(bpe.encoded(docs, words), words).collect()
    assert len(out) == 11 and sorted(map(repr, out)) == sorted(map(repr, bpe.encoded(docs, words, into="decoded").collect()))
    for r in out:
        text = "n" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert list(r["ids"]) == reference.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.digests(docs.limit(0), words).collect() == []


def test_merges_need_all_bytes():
    with pytest.raises(ValueError):
        bpe.Vocabulary.from_ranks({b"a": 0}, "a")
    assert base64.b64encode(b"a") == b"YQ=="


def test_deep_and_long_pages_take_memory_in_proportion():
    import tracemalloc

    deep = extraction.leaf_blocks("<div class=a>x " * 50_000)
    assert len(deep) == 50_000 and all(b.path == ("div", "a") for b in deep)
    assert [b.path for b in extraction.leaf_blocks("<main><div class='a b'><p>x<div class=a>y</div></div>")] == [("main", "div", "a", "b", "p"), ("main", "div", "b", "a")]
    labeller, random_ = extraction.Labeller(), np.random.default_rng(1)
    x = random_.normal(size=(30_000, extraction.INPUT))
    taped = labeller.scores(x[None], np.array([30_000]))[0][0]
    tracemalloc.start()
    found = labeller.label(x, np.array([30_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found, taped) and peak < 4 * x.nbytes + (1 << 24)
