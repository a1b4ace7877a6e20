"""URL filter: listed rules first, then association rules mined from labelled URLs.

A URL is a set of tokens of its host, path and query. Spark's FP-growth mines the token combinations that are
frequent among labelled URLs; a combination becomes a rule for a verdict if it has enough support, enough
confidence, more of it than chance, and more of it than the same combination with any one token less. Rules
are filed in an inverted index under their rarest token, and each distinct token set looks up its tokens there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import drop_folder, needs, shared_folder
from quillon.session import checkpointed

BLOCK, ALLOW = "block", "allow"
#: Verdict and rule: a host, and the start of the paths that it covers.
LISTED = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
MIN_SUPPORT = 0.005
MIN_COUNT = 20
MIN_CONFIDENCE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path and query of a URL.
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
MARK = "verdict:"


def part(url: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PATTERN, group), F.lit(""))


def host(url: str) -> Column:
    return F.translate(part(url, 1), UPPER, LOWER)


def tokens(url: str) -> Column:
    """The URL's words, sorted and once each: `host:`, `path:` or `query:` and letters of one case, runs of digits as 0."""
    def words(at: int, place: str) -> Column:
        plain = F.regexp_replace(F.translate(part(url, at), UPPER, LOWER), "[0-9]+", "0")
        found = F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(f"{place}:"), x))

    return F.array_sort(F.array_distinct(F.concat(words(1, "host"), words(2, "path"), words(3, "query"))))


def by_list(urls: DataFrame, rules: Sequence[tuple[str, str]] = LISTED) -> DataFrame:
    """`urls` (with host and path) and `listed`: struct of the longest rule that covers a URL and its verdict, else null.

    A rule covers its host and all subdomains where the path starts with the rule's. Rules are looked up once per
    distinct host; a row then only tries those of its host, longest first.
    """
    spark = urls.sparkSession
    rows = [(verdict, rule, rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]) for verdict, rule in rules]
    listed = spark.createDataFrame(rows, "verdict string, rule string, own string, start string")
    hosts = urls.select("host").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = hosts.select("host", F.explode(suffix).alias("own"))
    found = suffixes.join(listed, "own").groupBy("host")
    found = found.agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "start", "verdict")), asc=False).alias("_rules"))
    covers = F.filter("_rules", lambda r: F.col("path").startswith(r["start"]))
    chosen = F.get(covers, 0)
    listed = F.when(chosen.isNotNull(), F.struct(chosen["rule"].alias("rule"), chosen["verdict"].alias("verdict")))
    return urls.join(found, "host", "left").select(*[urls[c] for c in urls.columns], listed.alias("listed"))


def mined(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(verdict, tokens, n, confidence, anchor): the rules of labelled token sets (tokens, verdict).

    A rule holds its tokens and its verdict together in `min_support` of all rows and in `min_count` of them at least.
    Tokens that always occur together count as one item, which a URL has if it has them all; without that, a frequent
    template of k words would have 2 ** k combinations. They are told by their number and two sums of row hashes.
    Rows without a verdict are left out; without rows there are no rules. `anchor` is the rarest token.
    """
    needs(labelled, "tokens", "verdict")
    spark = labelled.sparkSession
    folder = shared_folder(spark, "labelled")
    rows = labelled.where("verdict is not null").select("tokens", "verdict", F.monotonically_increasing_id().alias("row"))
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    n = rows.count()
    if not n:
        drop_folder(spark, folder)
        return spark.createDataFrame([], "verdict string, tokens array<string>, n long, confidence double, anchor string")
    least = max(math.ceil(min_support * n), min_count)

    words = rows.select("row", F.explode("tokens").alias("token"))
    sums = [F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(38,0)")).alias(f"sum_{salt}") for salt in (1, 2)]
    counted = words.groupBy("token").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    items = counted.groupBy("n", "sum_1", "sum_2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    items = checkpointed(items.select(F.element_at("members", 1).alias("item"), "members", F.col("n").alias("item_n")))

    named = words.join(items.select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("found"))
    label = F.concat(F.lit(MARK), "verdict")
    baskets = rows.join(named, "row", "left").select(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=1.0).fit(baskets)
    sets = checkpointed(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))

    marked = F.exists("items", lambda x: x.startswith(MARK))
    plain = sets.where(~marked).select(F.col("items").alias("plain"), F.col("freq").alias("base"))
    own = F.filter("items", lambda x: ~x.startswith(MARK))
    verdict = F.substring(F.element_at(F.filter("items", lambda x: x.startswith(MARK)), 1), len(MARK) + 1, 1 << 20)
    ruled = sets.where(marked).select(own.alias("plain"), verdict.alias("verdict"), F.col("freq").alias("n"))
    shares = ruled.where(F.size("plain") == 0).select("verdict", F.col("n").alias("all"))
    rules = ruled.join(plain, "plain").join(shares, "verdict").withColumn("confidence", F.col("n") / F.col("base"))
    strong = rules.where((F.col("confidence") >= min_confidence) & (F.col("n") * n > F.col("base") * F.col("all")))
    # One item less: such a set is frequent too, so it is among the rules before any was dropped.
    less = strong.where(F.size("plain") > 1).select("plain", "verdict", F.explode("plain").alias("left_out"))
    less = less.withColumn("shorter", F.array_remove("plain", F.col("left_out")))
    before = rules.select(F.col("plain").alias("shorter"), "verdict", F.col("confidence").alias("had"))
    best = less.join(before, ["shorter", "verdict"]).groupBy("plain", "verdict").agg(F.max("had").alias("had"))
    kept = strong.join(best, ["plain", "verdict"], "left").where(F.col("had").isNull() | (F.col("confidence") > F.col("had")))

    wide = kept.select("plain", "verdict", "n", "confidence", F.explode("plain").alias("item")).join(items, "item")
    wide = wide.groupBy("plain", "verdict", "n", "confidence").agg(
        F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"), F.min(F.struct("item_n", "item"))["item"].alias("anchor")
    )
    found = checkpointed(wide.select("verdict", "tokens", "n", "confidence", "anchor"))
    drop_folder(spark, folder)
    return found


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, best): for each distinct token set that has all tokens of some rule, the strongest such rule.

    Highest confidence first, then the most support, the most tokens, blocking, and the later tokens.
    """
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("asked"), "verdict", "n", "confidence")
    seen = sets.select("tokens").distinct()
    candidates = seen.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = candidates.where(F.size(F.array_except("asked", "tokens")) == 0)
    strength = F.struct("confidence", "n", F.size("asked").alias("size"), (F.col("verdict") == BLOCK).alias("blocks"), "asked", "verdict")
    return fits.groupBy("tokens").agg(F.max(strength).alias("best"))


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", listed: Sequence[tuple[str, str]] = LISTED) -> DataFrame:
    """(key, host, path, rule, verdict, reason, confidence) of every row of `pages`.

    `rule` is the longest listed rule that covers the URL; its verdict stands. Else the strongest mined rule decides
    (`reason` names its tokens), and a URL that none fits is allowed. Null URLs and those without `://` have an empty host
    and path and no tokens. Repeated rows are judged alike; an empty table gives an empty one.
    """
    needs(pages, key, url)
    urls = pages.select(F.col(key).alias("_key"), host(url).alias("host"), part(url, 2).alias("path"), tokens(url).alias("tokens"))
    known = by_list(urls, listed)
    best = matched(urls, rules)
    open_ = F.col("listed").isNull()
    answered = known.join(best, "tokens", "left")
    return answered.select(
        F.col("_key").alias(key), "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "best.verdict", F.lit(ALLOW)).alias("verdict"),
        F.when(open_, F.array_join("best.asked", " ")).alias("reason"), F.when(open_, F.col("best.confidence")).alias("confidence"),
    )


def labelled_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id") -> DataFrame:
    """(tokens, verdict) of the pages that `labels` (key, quality, toxic) covers: low quality or toxic is to block."""
    needs(labels, label_key, "quality", "toxic")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.select(F.col(label_key).alias("_key"), F.when(bad, BLOCK).when(~bad, ALLOW).alias("verdict"))
    return pages.select(F.col(key).alias("_key"), tokens(url).alias("tokens")).join(known, "_key").select("tokens", "verdict")
