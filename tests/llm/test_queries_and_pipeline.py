"""Registered queries with their SQL, and the pipeline against the stages done plainly."""

import sys
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_duplicate_operators import groups, plain_fingerprint  # noqa: E402

from quillon.llm import mixing, quality  # noqa: E402
from quillon.llm.queries import ORACLES, QUERIES, vocabulary  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    df, answer = QUERIES[name](spark, sf), check.oracle_session(sf).execute(ORACLES[name])
    assert check.compare(df.columns, df.collect(), [c[0] for c in answer.description], answer.fetchall()) == ""


@pytest.mark.parametrize("name, of", [(n, t) for n in sorted(set(QUERIES) - set(ORACLES)) for t in [{"2": "conversations", "8": "pages"}.get(n[2], "documents")]])
def test_one_row_for_each_key(spark, sf, name, of):
    rows = QUERIES[name](spark, sf).collect()
    key = rows[0].asDict().keys().__iter__().__next__()
    want = {r[0] for r in duckdb.sql(f"select distinct {key} from '{sf}/{of}.parquet'").fetchall()} | ({-7} if of == "conversations" else set())
    assert len(rows) == len(want) and {r[key] for r in rows} == want


def removed_plainly(docs):
    low, out = {}, {}
    for key, text in docs:
        data = text.encode()
        for i in range(len(data) - 49):
            low[data[i : i + 50]] = min(low.get(data[i : i + 50], key), key)
    for key, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if low[data[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        out[key] = bytes(x for x, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    return out


def test_pipeline_equals_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, steps[-1], sf)
        steps.append(spark.createDataFrame(made.collect(), made.schema))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == corpus_pipeline.COLUMNS
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} if "text" in s.columns else None for s in steps]

    judged = quality.judged(quality.with_counts(docs)).where("kept").select("doc_id").collect()
    assert set(texts[1]) == {r[0] for r in judged}
    prints = {i: plain_fingerprint(t) for i, t in texts[1].items()}
    low = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert texts[2] == {i: t for i, t in texts[1].items() if low[i] == i}
    assert texts[3] == removed_plainly(list(texts[2].items()))
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(mixing.sizes(steps[3])).where("size > 0").collect()}
    repeated = [r["doc_id"] for r in steps[4].collect()]
    assert sorted(repeated) == sorted(i for i, n in copies.items() for _ in range(n))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary().ranks, special_tokens={})
    for r in steps[5].collect():
        assert r["round_trip"] and list(r["ids"]) == encoding.encode_ordinary(texts[3][r["doc_id"]])
    assert steps[5].count() == len(repeated)


def test_every_stage_takes_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
