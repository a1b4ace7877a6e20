"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document first gets the whole copies that are certain, then the
source's open words are filled in Pareto order: documents are ranked by their random odds divided by
their inclusion odds, and the lowest ranks are taken until the words are reached. The random number is
a digest of the document's id, so a rerun takes the same documents. Everything is built of DataFrame
functions; a source's order is never sorted in one task: ranks fall into cells whose sums are
aggregated first, and only the one cell that the boundary crosses is ordered.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.llm.common import WORD, needs, shared_table
from quillon.session import checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
#: Cells of the ranks of one source.
CELLS = 4096


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_odds(key: str, seed: int) -> Column:
    """u / (1 - u) for a uniform u in (0, 1) that depends only on the key, or without one on `own`, and on the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), "own", F.lit("")), F.lit(f":{seed}"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return u / (1 - u)


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Adds `target` to (source, source_size, ...): shares by weight, each at most `most` times its source's size.

    Handing an excess on by weight until no source is above ends at one level for all: a source takes
    weight * level or its cap. Sorted by cap / weight, the level follows from running sums. There is
    one row per source, so this small table is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    rising = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    pool = F.sum("source_size").over(every).cast("double") * share
    level = (pool - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    # The first source whose cap is not reached sets the level of all that follow.
    held = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return levels.withColumn("target", F.coalesce(F.col("weight") * held, F.col("cap"))).drop("cap", "level", "open", "weight")


def decided(
    sized: DataFrame, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 17
) -> DataFrame:
    """(key, source, size, own, m, source_size, target, whole, extra): what the mix takes of each class of m equal rows.

    Each of the m rows gets `whole` copies, and `extra` of them one more. Rows of one class draw the same random number,
    so they stand side by side in the order and are counted, not ordered.
    """
    needs(sized, key, "source", "size")
    own = F.col("own") if "own" in sized.columns else F.lit(None).cast("string")
    classes = sized.groupBy(key, "source", F.col("size").cast("long").alias("size"), own.alias("own")).agg(F.count("*").alias("m"))
    rows = checkpointed(classes)
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    targets = source_targets(totals, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", F.least(copies, F.lit(most).cast("long"))).withColumn(
        "open", F.col("target") - F.col("whole") * F.col("source_size")
    )
    targets = checkpointed(targets.withColumnRenamed("source", "name"))
    share_open = F.col("open") / F.col("source_size")
    odds = share_open / (1 - share_open)
    favour = F.least(F.greatest(F.sqrt(F.col("size") * F.col("n") / F.col("source_size")), F.lit(0.5)), F.lit(2.0))
    sourced = rows.join(targets, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # A source without open words, or one that is open whole, has no odds to rank by.
    rank = F.when((F.col("open") > 0) & (share_open < 1), random_odds(key, seed) / (odds * favour))
    ranked = sourced.withColumn("rank", rank).withColumn("words", F.col("size") * F.col("m"))
    ranked = checkpointed(ranked.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS)))

    cells = ranked.where("rank is not null").groupBy("source", "cell").agg(F.sum("words").alias("words"), F.first("open").alias("open"))
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    edge = cells.where("before <= open and before + words > open").select(
        F.col("source").alias("name"), F.col("cell").alias("edge"), F.col("before").alias("filled")
    )
    # Where all the words fit, no cell is the edge and all of them are taken.
    edged = ranked.join(edge, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    order = ["rank", F.col(key).asc_nulls_last(), "size", "own"]
    inside = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    crossed = edged.where("cell = edge").withColumn("before", F.col("filled") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    room = F.col("open") - F.col("before")
    fits = F.when(room < 0, F.lit(0)).when(F.col("size") == 0, F.col("m")).otherwise(F.least(F.col("m"), F.floor(room / F.col("size"))))
    crossed = crossed.withColumn("picked", fits.cast("long"))
    taken = F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("cell") < F.col("edge")))
    others = edged.where("cell is null or edge is null or cell <> edge").withColumn("picked", F.when(taken, F.col("m")).otherwise(0).cast("long"))
    columns = [key, "source", "size", "own", "m", "source_size", "target", "whole", "open", "rank", "picked"]
    chosen = checkpointed(crossed.select(*columns).unionByName(others.select(*columns)))

    gap = chosen.groupBy("source").agg(F.first("open").alias("open"), F.sum(F.col("picked") * F.col("size")).alias("got"))
    gap = gap.select(F.col("source").alias("name"), (F.col("open") - F.col("got")).alias("gap"))
    spare = chosen.where("rank is not null and picked < m").join(gap, F.col("source").eqNullSafe(F.col("name")))
    off = F.abs(F.col("size") - F.col("gap"))
    name = F.struct(off.alias("off"), F.col("rank"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce("own", F.lit("")).alias("own"), F.col("size"))
    # One class closes the gap, by one row.
    last = spare.where((F.col("size") > 0) & (off < F.col("gap"))).groupBy("name").agg(F.min(name).alias("last"))
    closed = chosen.join(last, F.col("source").eqNullSafe(F.col("name")), "left")
    same = [F.coalesce(F.col(key).cast("string"), F.lit("")) == F.col("last.id"), F.coalesce("own", F.lit("")) == F.col("last.own"), F.col("size") == F.col("last.size")]
    closes = F.coalesce(same[0] & same[1] & same[2], F.lit(False)) & (F.col("picked") < F.col("m"))
    extra = (F.col("picked") + closes.cast("long")).alias("extra")
    return closed.select(key, "source", "size", "own", "m", "source_size", "target", "whole", extra)


def _with_copies(rows: DataFrame, classes: DataFrame, names: dict[str, str], into: str) -> DataFrame:
    """`rows`, whose columns `names` tell their class, with the columns of the class and `into`, the copies of each row.

    A class of which only some rows get one copy more is one that a source's boundary crosses or that closes its gap, so
    there are two per source at most. Their rows are written once and numbered inside the partitions they were written in.
    """
    mark = {c: f"{into}_{c}" for c in classes.columns}
    classes = checkpointed(classes.select(*[F.col(c).alias(m) for c, m in mark.items()]))
    same = reduce(lambda a, b: a & b, [F.col(column).eqNullSafe(F.col(mark[c])) for c, column in names.items()])
    m, whole, extra = (F.col(mark[c]) for c in ("m", "whole", "extra"))
    split = (extra > 0) & (extra < m)
    whole_classes = rows.join(classes.where(~split), same).withColumn(into, whole + (extra == m).cast("long"))
    crossed = classes.where(split)
    if crossed.isEmpty():
        return whole_classes
    met = shared_table(rows.join(crossed, same).withColumn(f"{into}_at", F.monotonically_increasing_id()), "crossed")
    met = met.withColumn(f"{into}_part", F.shiftright(f"{into}_at", 33))
    own = [mark[c] for c in names]
    counts = met.groupBy(*own, f"{into}_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*own).orderBy(f"{into}_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"{c}_s") for c in [*own, f"{into}_part"]], before.alias(f"{into}_before"))
    inside = Window.partitionBy(*own, f"{into}_part").orderBy(f"{into}_at")
    met = met.withColumn(f"{into}_place", F.row_number().over(inside))
    placed = met.join(starts, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_s")) for c in [*own, f"{into}_part"]]))
    number = F.col(f"{into}_before") + F.col(f"{into}_place")
    numbered = placed.withColumn(into, whole + (number <= extra).cast("long"))
    return whole_classes.unionByName(numbered.select(*whole_classes.columns))


def mixed(sized: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken), one row per row of `sized` (key, source, size).

    Inclusion odds are those of the source's open share, times the root of the document's size over the
    source's mean size, held between 1/2 and 2: a copy of a longer document serves more context. The
    words left at the boundary go to the one document not taken whose size is nearest to them, if that
    comes closer than leaving them; that one is chosen by its size, not by Pareto order. Null sources form one source.
    Rows with equal key, source and size are documents of their own that rank alike: as many of them are taken as fit.
    Rows without a key are told apart by `own`, where `sized` has it. Documents of size 0 get copies but add no words.
    """
    needs(sized, key, "source", "size")
    rows = sized.withColumn("own", F.col("own") if "own" in sized.columns else F.lit(None).cast("string"))
    classes = decided(rows, key, **settings)
    rows = rows.select(*[F.col(c).alias(f"_r_{c}") for c in (key, "source", "size", "own")])
    found = _with_copies(rows, classes, {c: f"_r_{c}" for c in (key, "source", "size", "own")}, "copies")
    columns = [F.col(f"copies_{c}").alias(c) for c in (key, "source", "size", "source_size", "target")]
    return found.select(*columns, "copies").withColumn("taken", F.col("copies") * F.col("size"))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, size, own) of every document; null text has size 0. `own` is a digest of the text where the key is null."""
    needs(docs, key, "source", text)
    own = F.when(F.col(key).isNull(), F.md5(F.coalesce(text, F.lit(""))))
    return docs.select(key, "source", n_words(text).alias("size"), own.alias("own"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs`, each row repeated as often as the mix takes it; rows without words are left out."""
    needs(docs, key, "source", text)
    into = f"own_{uuid.uuid4().hex[:8]}"  # the columns of docs may have any name
    classes = decided(sizes(docs, key, text), key, **settings).where("size > 0 and whole + extra > 0")
    digest = F.when(F.col(key).isNull(), F.md5(F.coalesce(text, F.lit(""))))
    named = docs.withColumns({f"{into}_words": n_words(text), f"{into}_digest": digest})
    names = {key: key, "source": "source", "size": f"{into}_words", "own": f"{into}_digest"}
    found = _with_copies(named, classes, names, into).where(F.col(into) > 0)
    return found.withColumn(f"{into}_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(into)))).select(docs.columns)
