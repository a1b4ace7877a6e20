"""The registered queries of this folder, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import archives, bpe, chat, extraction, infill, langid, mixing, quality, repeats, resampling, simhash, urls, vectors
from quillon.llm.common import drop_folder, shared_folder
from quillon.session import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(path: str | None = None) -> bpe.Vocabulary:
    return bpe.Vocabulary.from_file(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counted = checkpointed(quality.with_counts(docs.select("doc_id", "text")).select("doc_id", "counts"))
    columns = ["doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
    return quality.judged(counted).select(*columns, "base_failed", "kept", "quality")


@query("op2_chat_formatting")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.formatted(turns, vocabulary()))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(langid.training_sample(docs))
    # The key's remainder goes along, so the rows that the model labels are read once.
    named = docs.select(F.struct("doc_id", langid.held_out().alias("held_out")).alias("key"), "text")
    return langid.identified(named, model, key="key").select("key.doc_id", "key.held_out", "lang_pred", "score", "n_words")


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (
  SELECT a.row AS a, b.row AS b, a.vec_id AS own, b.vec_id AS other FROM u a JOIN u b ON a.row <> b.row AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.95::DOUBLE * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
r AS (
  SELECT a, b, other FROM l UNION SELECT r.a, l.b, l.other FROM r JOIN l ON r.b = l.a),
n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (
  SELECT a, min(other) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, low) AS component_id, coalesce(vec_id = least(vec_id, low), false) AS kept
FROM v LEFT JOIN n ON v.row = n.a LEFT JOIN c ON v.row = c.a
"""


@query("op5_embedding_near_dedup", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS own, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\x0c\\r]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (
  SELECT *, (SELECT m.level FROM l m WHERE m.cap > m.level * m.weight ORDER BY m.cap / m.weight, m.source NULLS LAST LIMIT 1) AS found FROM l),
t AS (
  SELECT source, source_size, n, CASE WHEN found IS NULL OR cap <= found * weight THEN cap ELSE weight * found END AS target FROM h),
o AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END * source_size AS open_words FROM t),
r AS (
  SELECT d.doc_id, d.source, d.size, d.own, o.source_size, o.target, o.whole, o.open_words,
         (('0x' || substr(md5(concat(coalesce(d.doc_id::VARCHAR, d.own), ':17')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
         o.open_words / o.source_size AS f, least(greatest(sqrt(d.size * o.n / o.source_size), 0.5::DOUBLE), 2.0::DOUBLE) AS favour
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source),
k AS (
  SELECT *, CASE WHEN open_words > 0 AND f < 1 THEN (u / (1 - u)) / (f / (1 - f) * favour) END AS rank FROM r),
c AS (
  SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size, own ROWS UNBOUNDED PRECEDING) <= open_words AS picked FROM k),
g AS (
  SELECT *, open_words - sum(CASE WHEN picked THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
e AS (
  SELECT *, NOT picked AND size > 0 AND rank IS NOT NULL AND abs(size - gap) < gap
         AND row_number() OVER (PARTITION BY source ORDER BY NOT picked AND size > 0 AND rank IS NOT NULL AND abs(size - gap) < gap DESC,
                                abs(size - gap), rank, coalesce(doc_id::VARCHAR, ''), own) = 1 AS closes FROM g)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN picked OR closes THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM e
"""


@query("op6_mixing", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(mixing.sizes(table(spark, folder, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op8_html_extraction")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    labeller = extraction.train(extraction.training_sample(pages))
    return extraction.extracted(pages, labeller).withColumn("n_chars", F.length("text").cast("long"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary())


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM h),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""


@query("op10_arc_to_warc", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    work = shared_folder(spark, "archives")
    archives.write_arc(table(spark, folder, "pages"), f"{work}/arc")
    archives.convert(spark, f"{work}/arc", f"{work}/warc")
    found = checkpointed(archives.page_records(archives.read_warc(spark, f"{work}/warc")))
    drop_folder(spark, work)
    return found


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS unit, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT doc_id, text, unit, len(unit) AS n, ('0x' || h[1:8])::BIGINT % (len(unit) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(unit) + 1) AS b,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain, ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm FROM d),
p AS (
  SELECT *, array_to_string(unit[1:least(a, b)], '') AS prefix, array_to_string(unit[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(unit[greatest(a, b) + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    work = shared_folder(spark, "frames")
    store = infill.framed(table(spark, folder, "documents"))
    store.write.parquet(work)
    found = checkpointed(infill.digests(infill.arranged(spark.read.schema(store.schema).parquet(work))))
    drop_folder(spark, work)
    return found


# CRC-32 by its table, one byte of all distinct features at a time.
OP12_SQL = """
WITH RECURSIVE e AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM e WHERE k < 8),
z AS (
  SELECT list(c ORDER BY i) AS tab FROM e WHERE k = 8),
w AS (
  SELECT 0 AS kind, doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS word FROM documents
  UNION ALL
  SELECT 1, NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') FROM benchmark),
f AS (
  SELECT kind, row, unnest(list_transform(range(1, len(word) - size + 2), lambda i: array_to_string(word[i:i + size - 1], ' '))) AS feature FROM w, range(1, 4) s(size)),
u AS (
  SELECT feature, encode(feature) AS raw, octet_length(encode(feature)) AS n FROM (SELECT DISTINCT feature FROM f)),
x AS (
  SELECT feature, hex(raw) AS hex, n FROM u),
b AS (
  SELECT feature, xor(list_reduce(list_transform(range(n), lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::BIGINT),
         lambda c, v: xor(c >> 8, z.tab[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM x, z),
o AS (
  SELECT f.kind, f.row, b.bucket, count(*) AS n FROM f JOIN b USING (feature) GROUP BY ALL),
t AS (
  SELECT i AS bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM range(10000) r(i) LEFT JOIN o ON o.bucket = i GROUP BY i),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM t),
d AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM o JOIN g USING (bucket) WHERE kind = 0 GROUP BY row),
r AS (
  SELECT doc_id, w.row, len(word) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (row) WHERE kind = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, row) AS place, count(*) OVER (PARTITION BY n_words >= 20) * 5 // 100 AS k FROM r)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= k THEN place END AS rank FROM p
"""


@query("op12_importance_resampling", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _words_sql(group: int, place: str) -> str:
    part = f"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', {group})"
    plain = f"regexp_replace(translate({part}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g')"
    return f"list_transform(regexp_extract_all({plain}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: '{place}:' || x)"


OP13_SQL = f"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS row, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         list_sort(list_distinct(list_concat({_words_sql(1, 'host')}, {_words_sql(2, 'path')}, {_words_sql(3, 'query')}))) AS tokens FROM pages),
l AS (
  SELECT row_number() OVER () AS row, tokens, CASE WHEN quality = 0 OR toxic = 1 THEN 'block' ELSE 'allow' END AS verdict
  FROM p JOIN labels ON page_id = doc_id WHERE quality = 0 OR toxic = 1 OR (quality <> 0 AND toxic <> 1)),
a AS (
  SELECT count(*) AS n, greatest(ceil(0.005::DOUBLE * count(*)), 20) AS least FROM l),
t AS (
  SELECT token, list_sort(list(row)) AS rows FROM (SELECT row, unnest(tokens) AS token FROM l) GROUP BY token HAVING count(*) >= (SELECT least FROM a)),
i AS (
  SELECT min(token) AS item, list_sort(list(token)) AS members, rows FROM t GROUP BY rows),
k AS (
  SELECT row, list_sort(list(item)) AS items FROM (SELECT item, unnest(rows) AS row FROM i) GROUP BY row),
s AS (
  SELECT l.row, verdict, list_filter(items, lambda x, j: (mask >> (j - 1)) & 1 = 1) AS plain FROM l JOIN k USING (row), unnest(range(1, 1 << len(items))) m(mask)),
b AS (
  SELECT plain, count(*) AS base FROM s GROUP BY plain),
r AS (
  SELECT plain, s.verdict, count(*) AS n, any_value(base) AS base, count(*)::DOUBLE / any_value(base) AS confidence FROM s JOIN b USING (plain)
  GROUP BY plain, s.verdict HAVING count(*) >= (SELECT least FROM a)),
g AS (
  SELECT r.* FROM r JOIN (SELECT verdict, count(*) AS n FROM l GROUP BY verdict) v USING (verdict), a WHERE confidence >= 0.8::DOUBLE AND r.n * a.n > base * v.n),
h AS (
  SELECT plain, g.verdict, max(r.confidence) AS had FROM (SELECT plain, verdict, list_filter(plain, lambda x: x <> gone) AS shorter FROM g, unnest(plain) q(gone)) g
  JOIN (SELECT plain AS shorter, verdict, confidence FROM r) r ON r.shorter = g.shorter AND r.verdict = g.verdict GROUP BY plain, g.verdict),
u AS (
  SELECT g.verdict, g.n, g.confidence, (SELECT list_sort(flatten(list(members))) FROM i WHERE list_contains(g.plain, item)) AS asked
  FROM g LEFT JOIN h ON h.plain = g.plain AND h.verdict = g.verdict WHERE had IS NULL OR g.confidence > had),
o AS (
  SELECT tokens, max(row(confidence, n, len(asked), verdict = 'block', asked, verdict)) AS best FROM (SELECT DISTINCT tokens FROM p) JOIN u ON list_has_all(tokens, asked) GROUP BY tokens),
c AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END ELSE coalesce(best[6], 'allow') END AS verdict,
       CASE WHEN rule IS NULL THEN array_to_string(best[5], ' ') END AS reason, CASE WHEN rule IS NULL THEN best[1] END AS confidence
FROM c LEFT JOIN o USING (tokens)
"""


@query("op13_url_filters", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = urls.mined(urls.labelled_urls(pages, table(spark, folder, "labels")))
    return urls.judged(pages, rules)
