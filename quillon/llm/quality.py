"""Quality rules as weak supervision: rules vote or abstain, a label model weighs them.

Every rule says good, bad or nothing about a document. Expectation-maximisation estimates, without any
label, how often each rule is right on good and on bad documents, and the posterior probability of
being good replaces "all rules must pass". The model sees only how often each combination of votes
occurs, at most 3 ** rules rows however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillon.llm.common import SPACE, needs, texts_of

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
NOT_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha())
# Frequent words of four languages.
COMMON = {
    word.encode()
    for words in (
        "the of and to in is that it for was with on as by this are be at from not",
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine auch",
        "de la le et les des en un du une que est pour qui dans par sur pas au avec",
        "de la que el en y los del se las por un para con no una su al lo es",
    )
    for word in words.split()
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_common", "text_bytes", "upper_bytes", "letter_bytes",
)
COUNT_TYPE = T.StructType([T.StructField(name, T.LongType(), False) for name in COUNTS])


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts; neither or an unknown one means that the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("lines", "20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("capitals", "5 * upper_bytes <= letter_bytes", "2 * upper_bytes > letter_bytes"),
    Rule("letters", "100 * letter_bytes >= 85 * text_bytes", "100 * letter_bytes < 75 * text_bytes"),
    Rule("symbol_characters", "200 * n_symbols <= word_chars", "50 * n_symbols > word_chars"),
    Rule("common_words", "n_common >= 3", "n_words >= 50 and n_common = 0"),
)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and how often each rule's votes are right on good and on bad ones."""

    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]
    rounds: int = field(default=0, compare=False)

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds that a good vote and a bad vote of each rule add."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.right_on_good, self.right_on_bad)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(word, i) for i, word in enumerate(words)], np.int64)
    if len(first) == n:
        return 0
    pairs = ids[:-1] * n + ids[1:]
    if n >= 2_000_000:  # three positions no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[starts + step] = True
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    """All COUNTS of one text."""
    data = text.encode()
    words = data.split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    distinct = set(words)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(distinct),
        len(distinct & COMMON),
        sum(map(len, words)),
        len(data) - len(data.translate(None, UPPER)),
        len(data.translate(None, NOT_LETTERS)),
    )


def with_counts(docs: DataFrame, text: str = "text", into: str = "counts") -> DataFrame:
    """`docs` with a struct column of counts; a column of that name is replaced. Null text counts as empty."""
    needs(docs, text)
    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, COUNT_TYPE, False)])
    place = kept.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(x) for x in texts_of(batch.column(place))]
            parts = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            struct = pa.StructArray.from_arrays(parts, fields=[pa.field(name, pa.int64(), False) for name in COUNTS])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, into])

    return kept.mapInArrow(count, schema)


def votes(rules: tuple[Rule, ...] = RULES, counts: str = "counts") -> Column:
    """Array of votes, in the order of the rules: 1 good, 0 bad, -1 abstains."""

    def over(condition: str) -> Column:
        for name in COUNTS:
            condition = condition.replace(name, f"{counts}.{name}")
        return F.expr(condition)

    return F.array(*[F.when(over(r.bad), 0).when(over(r.good), 1).otherwise(-1) for r in rules])


def fit(patterns: dict[tuple[int, ...], int], rules: int, tolerance: float = 1e-9, most: int = 2000) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Starts from the majority vote. Right and wrong votes get 8 and 2 pseudo-counts per rule and class, so a
    rule with few votes keeps a modest weight and no probability becomes 0 or 1.
    """
    if not patterns:
        return LabelModel(0.5, (0.8,) * rules, (0.8,) * rules)
    ordered = sorted(patterns)
    vote = np.array(ordered, np.int8)
    weight = np.array([patterns[x] for x in ordered], float)
    up, down = vote == 1, vote == 0
    good = (1 + up.sum(1)) / (2 + up.sum(1) + down.sum(1))
    last = -np.inf
    for step in range(1, most + 1):
        w1, w0 = weight * good, weight * (1 - good)
        prior = (w1.sum() + 1) / (weight.sum() + 2)
        on_good = (w1 @ up + 8) / (w1 @ (up | down) + 10)
        on_bad = (w0 @ down + 8) / (w0 @ (up | down) + 10)
        log1 = np.log(prior) + up @ np.log(on_good) + down @ np.log(1 - on_good)
        log0 = np.log(1 - prior) + up @ np.log(1 - on_bad) + down @ np.log(on_bad)
        total = np.logaddexp(log1, log0)
        good = np.exp(log1 - total)
        likelihood = float(weight @ total) / weight.sum()
        if abs(likelihood - last) < tolerance:
            break
        last = likelihood
    return LabelModel(float(prior), tuple(map(float, on_good)), tuple(map(float, on_bad)), step)


def fit_label_model(counted: DataFrame, rules: tuple[Rule, ...] = RULES, counts: str = "counts") -> LabelModel:
    """Label model of all documents; one row per combination of votes, 3 ** len(rules) at most, reaches the driver."""
    found = counted.groupBy(votes(rules, counts).alias("votes")).count().collect()
    return fit({tuple(row["votes"]): row["count"] for row in found}, len(rules))


def posterior(model: LabelModel, rules: tuple[Rule, ...] = RULES, counts: str = "counts") -> Column:
    """Probability that a document is good, given its votes."""
    said = votes(rules, counts)
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for i, (good, bad) in enumerate(model.weights()):
        odds = odds + F.when(said[i] == 1, good).when(said[i] == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed(counts: str = "counts") -> Column:
    return (F.col(f"{counts}.n_words") < 50) | (100 * F.col(f"{counts}.n_repeat_words") > 50 * F.col(f"{counts}.n_words"))


def judged(counted: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, counts: str = "counts") -> DataFrame:
    """Adds `base_failed`, `quality` (posterior) and `kept`.

    Null and empty texts have no words and fail the base check. Repeated rows are judged alike. An empty
    table gives an empty one. Columns of `counted` named like a result are replaced.
    """
    model = fit_label_model(counted, rules, counts)
    failed = base_failed(counts)
    probability = posterior(model, rules, counts)
    return counted.withColumns({"base_failed": failed, "quality": probability, "kept": ~failed & (probability >= threshold)})
