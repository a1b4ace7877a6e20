"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is the sum of learned weights of its features: character n-grams, those at the
word's ends (affixes), and the word itself if the lexicon of the training sample holds it. Learned
transitions tie neighbouring words, and forward-backward gives each word's language probabilities given
the whole text, so a text may switch language. A document's language is the one that the most words are
expected to be in.

Training reads a bounded sample of labelled documents, part of it spliced into code-switched sequences.
Long texts are labelled in blocks whose transfer matrices are multiplied first, so the number of vector
steps depends on the block length and not on the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quillon.llm.common import Numbered, needs, slices, texts_of

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: log2 of the number of feature weights per language.
BITS = 17
GRAMS = (1, 2, 3, 4)
BLOCK = 32
SLICE = 1 << 20
REMEMBERED = 400_000
#: Bounds of the training sample. The model takes 2 MB a language while it is trained, half a MB after.
SAMPLE_DOCS, SAMPLE_CHARS = 1600, 20_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; none if nothing in the text is a letter."""
    words = WORDS.findall(text.lower())
    return words if any(map(str.isalpha, words)) else []


def held_out(key: str = "doc_id") -> Column:
    """Documents that training does not see."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(words: list[str], lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weight slots of all words one after another, and how many each word has."""
    n = len(words)
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(points == 2) - 1
    slots, owners = [], []
    value = np.zeros(len(points), np.uint64)
    for size in range(1, max(GRAMS) + 1):
        reach = len(points) - size + 1
        if reach < 1:
            break
        value = value[:reach] * np.uint64(0x100000001B3) + points[size - 1 :] + np.uint64(1)
        if size in GRAMS:
            inside = word[:reach] == word[size - 1 :]
            slots.append(value[inside] ^ np.uint64(size << 40))
            owners.append(word[:reach][inside])
    known = np.flatnonzero(np.fromiter((w in lexicon for w in words), bool, n))
    slots.append(np.array([xxhash.xxh64_intdigest(words[i]) for i in known.tolist()], np.uint64))
    owners.append(known)
    mixed = np.concatenate(slots) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)[order], np.bincount(owner, minlength=n)


def emissions(words: list[str], weights: np.ndarray, lexicon: set[str]) -> np.ndarray:
    """Score of each word for each language; every word has features, as its ends are n-grams."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    out = []
    for i in range(0, len(words), 20_000):
        slots, counts = features(words[i : i + 20_000], lexicon)
        out.append(np.add.reduceat(weights[slots].astype(np.float64), np.cumsum(counts) - counts, axis=0))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: frozenset[str]


def sequences(docs: list[tuple[int, list[str]]], random: np.random.Generator, length: int = 20, most: int = 6000) -> list[tuple[list[str], list[int]]]:
    """Training sequences: pieces of documents, three in ten of them followed by pieces in other languages."""
    pieces = [(label, words[i : i + length]) for label, words in docs for i in range(0, len(words), length)]
    order = random.permutation(len(pieces)).tolist()
    first: dict[int, int] = {}
    for place, i in enumerate(order):
        first.setdefault(pieces[i][0], place)
    order = order[:most] + [order[place] for place in first.values() if place >= most]  # every language is seen
    out, at = [], 0
    while at < len(order):
        many = int(random.choice([1, 2, 3], p=[0.7, 0.2, 0.1]))
        chosen = [pieces[i] for i in order[at : at + many]]
        at += many
        out.append(([w for _, words in chosen for w in words], [label for label, words in chosen for _ in words]))
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of labels (b, t, l) and expected transitions (l, l) of a padded batch of short sequences."""
    b, t, l = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions)
    alpha, beta = np.zeros((t, b, l)), np.ones((t, b, l))
    alpha[0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        now = (alpha[i - 1] @ step) * emit[:, i]
        alpha[i] = now / now.sum(1, keepdims=True)
    expected = np.zeros((l, l))
    for i in range(t - 1, 0, -1):
        inside = (i < lengths)[:, None]
        ahead = emit[:, i] * beta[i]
        pair = alpha[i - 1][:, :, None] * step[None] * ahead[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True) * inside[:, :, None]).sum(0)
        back = ahead @ step.T
        beta[i - 1] = np.where(inside, back / back.sum(1, keepdims=True), 1.0)
    both = alpha * beta
    return (both / both.sum(2, keepdims=True)).transpose(1, 0, 2), expected


def train(docs: list[tuple[str, str]], epochs: int = 4, batch: int = 64, rate: float = 0.3, seed: int = 5) -> Model:
    """Maximum likelihood by adaptive gradient steps over (language, text) pairs; the same pairs give the same model."""
    languages = tuple(sorted({language for language, _ in docs}))
    worded = [(languages.index(language), words_of(text)) for language, text in docs]
    counts = Counter(word for _, words in worded for word in words)
    lexicon = frozenset(word for word, n in counts.items() if n >= 3)
    l = len(languages)
    weights, transitions = np.zeros((1 << BITS, l)), np.zeros((l, l))
    squares, squares_t = np.full((1 << BITS, l), 1e-3), np.full((l, l), 1e-3)
    random = np.random.default_rng(seed)
    examples = sequences(worded, random)
    vocabulary = {word: i for i, word in enumerate(counts)}
    slots, many = features(list(vocabulary), lexicon) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.cumsum(many)
    for _ in range(epochs if l > 1 else 0):
        for start in range(0, len(order := random.permutation(len(examples)).tolist()), batch):
            chosen = [examples[i] for i in order[start : start + batch]]
            lengths = np.array([len(words) for words, _ in chosen])
            inside = np.arange(lengths.max())[None, :] < lengths[:, None]
            ids = np.fromiter((vocabulary[w] for words, _ in chosen for w in words), np.int64)
            labels = np.fromiter((y for _, ys in chosen for y in ys), np.int64)
            own, place = np.unique(ids, return_inverse=True)
            size = many[own]
            at = np.repeat(ends[own] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())
            scores = np.zeros((*inside.shape, l))
            scores[inside] = np.add.reduceat(weights[slots[at]], np.cumsum(size) - size, axis=0)[place]
            posterior, expected = forward_backward(scores, lengths, transitions)
            wrong = -posterior[inside]
            wrong[np.arange(len(labels)), labels] += 1
            by_word = np.stack([np.bincount(place, wrong[:, k], len(own)) for k in range(l)], axis=1)
            touched, where = np.unique(slots[at], return_inverse=True)
            spread = np.repeat(by_word, size, axis=0)
            gradient = np.stack([np.bincount(where, spread[:, k], len(touched)) for k in range(l)], axis=1) / len(chosen)
            gradient -= 1e-4 * weights[touched]
            squares[touched] += gradient**2
            weights[touched] += rate * gradient / np.sqrt(squares[touched]) * 0.2
            owner = np.repeat(np.arange(len(chosen)), lengths)
            within = owner[1:] == owner[:-1]
            seen = np.zeros((l, l))
            np.add.at(seen, (labels[:-1][within], labels[1:][within]), 1)
            gradient = (seen - expected) / len(chosen) - 1e-3 * transitions
            squares_t += gradient**2
            transitions += rate * gradient / np.sqrt(squares_t)
    return Model(languages, weights.astype(np.float32), transitions, lexicon)


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", most: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(language, text) of labelled documents not held out, as many of each language, chosen by a hash of the key.

    At most `most` documents, but one of every language even if there are more languages than that. A language that
    has only texts of over SAMPLE_CHARS characters is learned from whole words out of their middle. Documents without a
    key are drawn by their text.
    """
    able = docs.where(F.col(label).isNotNull() & ~held_out(key) & (F.length(text) > 0)).select(
        F.col(label).alias("label"),
        F.col(text).alias("text"),
        F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key))).alias("draw"),
        (F.length(text) > SAMPLE_CHARS).alias("long"),
    )
    # One row per language: how many documents it can be learned from, and whether those are its long ones.
    counts = able.groupBy("label").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).collect()
    if not counts:
        return []
    each = max(1, most // len(counts))
    # Twenty more than wanted: the chance that a language with documents is not drawn at all is below 1e-9.
    rates = {row["label"]: (not row["short"], min(1.0, (1.5 * each + 20) / (row["short"] or row["long"]))) for row in counts}
    rate = F.create_map(*[F.lit(x) for name, (_, share) in rates.items() for x in (name, share)])
    by_long = [name for name, (long, _) in rates.items() if long]
    drawn = able.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.try_element_at(rate, F.col("label")))
    drawn = drawn.where(F.col("long") == (F.col("label").isin(by_long) if by_long else F.lit(False)))
    first = W.partitionBy("label").orderBy("draw", "text")
    chosen = drawn.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each)
    middle = F.substring("text", ((F.length("text") - SAMPLE_CHARS) / 2).cast("int") + 1, F.lit(SAMPLE_CHARS))
    words = F.regexp_replace(middle, r"^\S{0,100}\s|\s\S{0,100}$", "")
    chosen = chosen.select("label", F.when(F.col("long"), words).otherwise(F.col("text")).alias("text"), "draw")
    return [(row["label"], row["text"]) for row in chosen.orderBy("draw", "label", "text").collect()]


def posteriors(emit: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Label probabilities of all words of texts that follow each other, exact over each whole text.

    `emit` are positive word factors, `step` the transition factors. Each text is cut into blocks; the blocks' transfer
    matrices carry the forward and backward messages from block to block, then all blocks are worked off side by side.
    """
    l = emit.shape[1]
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(lengths) - lengths)[text] + number * BLOCK
    size = np.minimum(BLOCK, lengths[text] - number * BLOCK)
    order = np.argsort(-size, kind="stable")  # blocks that still have a word come first
    begin, size, number, text = begin[order], size[order], number[order], text[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(BLOCK)]  # blocks with more than t words
    first = number == 0

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / x.max(axes, keepdims=True)

    eye = np.eye(l)
    transfer = np.where(first[:, None, None], eye, step) * emit[begin][:, None, :]
    for t in range(1, BLOCK):
        k = live[t]
        if not k:
            break
        now = (transfer[:k].reshape(-1, l) @ step).reshape(k, l, l) * emit[begin[:k] + t][:, None, :]
        transfer[:k] = scaled(now, (1, 2))
    # Places of the blocks in the order of their texts.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts = np.cumsum(blocks) - blocks
    before, after = np.ones((len(order), l)), np.ones((len(order), l))
    by_length = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max(initial=0))):
        texts = by_length[: int(np.searchsorted(-blocks[by_length], -j, "left"))]
        here = place[starts[texts] + j - 1]
        before[place[starts[texts] + j]] = scaled(np.einsum("bi,bij->bj", before[here], transfer[here]), 1)
    for j in range(int(blocks.max(initial=0)) - 1, 0, -1):
        texts = by_length[: int(np.searchsorted(-blocks[by_length], -j, "left"))]
        here = place[starts[texts] + j]
        after[place[starts[texts] + j - 1]] = scaled(np.einsum("bij,bj->bi", transfer[here], after[here]), 1)
    alpha = np.empty((BLOCK, len(order), l))
    alpha[0] = np.where(first[:, None], before, before @ step) * emit[begin]
    for t in range(1, BLOCK):
        k = live[t]
        alpha[t, :k] = scaled((alpha[t - 1, :k] @ step) * emit[begin[:k] + t], 1) if k else 0
    out = np.empty_like(emit)
    beta = after.copy()
    for t in range(BLOCK - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        both = alpha[t, :k] * beta[:k]
        out[begin[:k] + t] = both / both.sum(1, keepdims=True)
        if t:
            beta[:k] = scaled((emit[begin[:k] + t] * beta[:k]) @ step.T, 1)
    return out


class Labeller:
    """Labels texts; remembers the scores of the words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.step = np.exp(model.transitions - model.transitions.max())
        self.forget()

    def forget(self) -> None:
        self.known, self.factors, self.filled = Numbered(), np.zeros((1 << 12, len(self.model.languages))), 0

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all words one after another, and each text's number of words."""
        if len(self.known) > REMEMBERED:
            self.forget()
        worded = list(map(words_of, texts))
        lengths = np.fromiter(map(len, worded), np.int64, len(worded))
        ids = np.fromiter((i for words in worded for i in map(self.known.__getitem__, words)), np.int64, int(lengths.sum()))
        if self.known.new:
            scores = emissions(self.known.new, self.model.weights, self.model.lexicon)
            # One hopeless word must not rule a language out.
            scores = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))
            end = self.filled + len(scores)
            while end > len(self.factors):
                self.factors = np.concatenate([self.factors, np.zeros_like(self.factors)])
            self.factors[self.filled : end] = scores
            self.filled, self.known.new = end, []
        has = lengths > 0
        found = posteriors(self.factors[ids], lengths[has], self.step) if len(ids) else np.zeros((0, len(self.model.languages)))
        return found, lengths


def identified(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, n_words, runs): `runs` are the stretches of words most likely of one language.

    The score is the expected share of the text's words in the predicted language; of equal languages the first by name
    wins. Null texts and texts without a letter, and all texts under a model without languages, are `und` with score 0.
    """
    needs(docs, key, text)
    narrow = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "lang_pred string, score double, n_words long, runs array<struct<lang: string, n_words: long>>"
    schema = T.StructType([narrow.schema[key], *T.StructType.fromDDL(fields).fields])
    pair = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())]))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array([*shared.value.languages, UNKNOWN], dtype=object)
        labeller = Labeller(shared.value) if shared.value.languages else None
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(list(map(len, texts)), SLICE):
                if labeller is None:
                    found, lengths = np.zeros((0, 1)), np.zeros(b - a, np.int64)
                else:
                    found, lengths = labeller.label(texts[a:b])
                ends = np.cumsum(lengths)
                best = np.full(b - a, len(languages) - 1)
                score = np.zeros(b - a)
                has = np.flatnonzero(lengths)
                label = found.argmax(1)
                runs = [[] for _ in range(b - a)]
                if len(has):
                    sums = np.add.reduceat(found, (ends - lengths)[has], axis=0)
                    best[has] = sums.argmax(1)
                    score[has] = np.minimum(sums.max(1) / lengths[has], 1.0)
                    owner = np.repeat(np.arange(b - a), lengths)
                    cut = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])))
                    for i, lang, n in zip(owner[cut].tolist(), label[cut].tolist(), np.diff(np.append(cut, len(label))).tolist()):
                        runs[i].append({"lang": languages[lang], "n_words": n})
                columns = [pa.array(languages[best], pa.string()), pa.array(score), pa.array(lengths), pa.array(runs, pair)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=schema.names)

    return narrow.mapInArrow(identify, schema)
