"""Mixing sources to target weights by weighted sampling with exponential keys.

Every document gets the key ``-ln(u) / quality``: u is a uniform number made from a digest of its id
and the seed, quality a weight made from its text. In the order of the keys, a prefix of a source is
a weighted sample without replacement (Efraimidis and Spirakis). A source's target is its weight's
share of all words, at most ``max_epochs`` times its own words; what a capped source cannot take goes
to the others by weight. The target is met by complete epochs of the source first, then by the prefix
of its documents whose words come nearest to the rest: a document is taken if at least half of it
lies within the rest.

All steps are DataFrame operations. The prefix sums never gather a source: documents are counted into
a fixed number of ranges of the key, and the sums of the ranges give the one range in which the rest of a
source ends. If many documents are in that range, as in a source of low quality, whose keys lie close together, it is
cut into ranges again, and so on; only the last, short one is sorted. The outcome is one cut key per source, so
choosing documents is a comparison, joined to the documents by source; texts are not moved.

Defined cases: a null or empty text has no words and can be taken without using up anything; a null
source is a source of its own, last in order; documents with equal key, id and digest are taken
together; a null id counts as empty text for the key; a source without words has target 0; without
any word all targets are 0; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respeval.llm.common import stored
from respeval.sources.storage import broadcast_if_small

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGES = 1024
# A range of up to so many documents is sorted by one task; a longer one is cut again, so often at most.
SORTED = 20_000
CUTS = 8
SEED = 17


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t \\n \\v \\f \\r."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", "")).cast("long")


def quality(text: Column) -> Column:
    """Between a tenth and one: the share of characters that are letters or spaces."""
    n = F.length(text)
    good = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.when(n > 0, F.lit(0.1) + F.lit(0.9) * good.cast("double") / n).otherwise(F.lit(0.1))


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number between 0 and 1, exclusive, from 52 bits of a digest."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def sample_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    return -F.log(uniform(doc_id, seed)) / quality(text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size to source, source_size, target: one row per source, in one small window.

    The level at which sources are capped follows from one prefix sum in the order of the ratio of
    cap to weight: all sources with ratios up to some point are capped, the others share the rest.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), place)
    rows = sizes.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    by_ratio = W.orderBy(
        F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    rows = rows.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("others", F.sum("weight").over(after))
    rows = rows.withColumn("capped", F.col("cap") * F.col("others") <= F.col("rest") * F.col("weight"))
    # Capped sources come first in this order; the others share what the capped ones leave.
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    shares = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        left.cast("double") * F.col("weight") / shares
    )
    return rows.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _narrowed(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows (source, size, key, id, tie, part, before, rest) of the short ranges in which the rest ends, and per
    source the last row of the ranges before these.

    A range with more than ``SORTED`` rows is cut between its smallest and its largest key, and the sums of
    its ranges are added to ``before``. Rows with one and the same key are not cut.
    """
    grain = ["source", "part", "before"]
    passed = None
    for _ in range(CUTS):
        rows = stored(rows, "range")
        edges = rows.groupBy(*grain).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        edges = edges.filter((F.col("n") > SORTED) & (F.col("high") > F.col("low")))
        edges = stored(edges.select(*[F.col(g).alias(f"of_{g}") for g in grain], "low", "high"), "edges")
        if edges.isEmpty():
            break
        # As many as there are sources, and edges without words beside them.
        same = _same(F.col("source"), F.col("of_source")) & (F.col("part") == F.col("of_part"))
        same &= F.col("before") == F.col("of_before")
        placed = rows.join(broadcast_if_small(edges), same, "left")
        share = (F.col("key") - F.col("low")) / (F.col("high") - F.col("low"))
        number = F.least(F.lit(RANGES - 1), F.floor(share * RANGES)).cast("int")
        placed = placed.withColumn("number", F.coalesce(number, F.lit(-1)))
        sums = placed.groupBy(*grain, "rest", "number").agg(
            F.sum("size").alias("sum"), F.max(F.struct("key", "id", "tie")).alias("last")
        )
        over = W.partitionBy(*grain).orderBy("number").rowsBetween(W.unboundedPreceding, -1)
        sums = stored(sums.withColumn("inner", F.col("before") + F.coalesce(F.sum("sum").over(over), F.lit(0))), "sums")
        here = (F.col("inner") <= F.col("rest")) & (F.col("inner") + F.col("sum") >= F.col("rest"))
        ends = sums.filter(here | (F.col("number") == -1))
        ends = ends.select(*[F.col(g).alias(f"in_{g}") for g in grain], F.col("number").alias("in_number"), "inner")
        # What ends within the rest before these ranges is taken.
        done = sums.filter((F.col("number") >= 0) & (F.col("inner") + F.col("sum") < F.col("rest")))
        done = done.groupBy("source").agg(F.max("last").alias("cut"))
        passed = done if passed is None else passed.unionByName(done)
        inside = _same(F.col("source"), F.col("in_source")) & (F.col("number") == F.col("in_number"))
        for g in grain[1:]:
            inside &= F.col(g) == F.col(f"in_{g}")
        rows = placed.join(broadcast_if_small(ends), inside)
        rows = rows.select("source", "size", "key", "id", "tie", "part", F.col("inner").alias("before"), "rest")
    return rows, passed


def cuts(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its size, target, complete epochs, and the cut (key, id, tie) of the last part.

    ``keyed`` has columns source, size, key, id (a string) and tie. The cut is null if no document is
    taken once more.
    """
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = stored(goal, "targets")

    part = F.least(F.lit(RANGES - 1), F.floor((1 - F.exp(-F.col("key"))) * RANGES)).cast("int")
    ranged = keyed.withColumn("part", part)
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    over = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(over), F.lit(0)))
    g = goal.select(F.col("source").alias("s"), "rest")
    # The range that holds the end of the rest, and ranges without words at its edge.
    ends = sums.join(broadcast_if_small(g), _same(F.col("source"), F.col("s")))
    ends = ends.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest")))
    ends = ends.select(F.col("source").alias("s"), F.col("part").alias("p"), "before", "rest")
    rows = ranged.join(broadcast_if_small(ends), _same(F.col("source"), F.col("s")) & (F.col("part") == F.col("p")))
    rows, passed = _narrowed(rows.select("source", "size", "key", "id", "tie", "part", "before", "rest"))
    by_key = W.partitionBy("source", "part", "before").orderBy("key", "id", "tie").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    rows = rows.withColumn("ahead", ahead)
    # Half of the document at least lies within the rest.
    rows = rows.filter(2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest"))
    last = rows.groupBy("source").agg(F.max(F.struct("key", "id", "tie")).alias("cut"))
    if passed is not None:
        last = last.unionByName(passed).groupBy("source").agg(F.max("cut").alias("cut"))
    # If nothing of that range is taken, the cut is the end of the ranges before it.
    first = ends.groupBy("s").agg(F.min("p").alias("p")).withColumn(
        "edge", -F.log(1 - F.col("p").cast("double") / RANGES)
    )
    found = goal.join(first, _same(F.col("source"), F.col("s")), "left").drop("s")
    last = last.select(F.col("source").alias("s"), "cut")
    found = found.join(last, _same(F.col("source"), F.col("s")), "left").drop("s")
    return found.select("source", "source_size", "target", "epochs", "rest", "p", "cut")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.col(f"`{text_col}`")
    doc_id = F.col(f"`{id_col}`")
    return docs.select(
        doc_id.alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        n_words(text).alias("size"),
        sample_key(doc_id, text, seed).alias("key"),
        F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.crc32(text), F.lit(-1)).alias("tie"),
    )


def _once_more(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``times``: complete epochs, and one more up to the cut of the source."""
    s = sources.withColumnRenamed("source", "s")
    part = F.least(F.lit(RANGES - 1), F.floor((1 - F.exp(-F.col("key"))) * RANGES)).cast("int")
    here = F.struct("key", "id", "tie")
    more = F.when(part < F.col("p"), True).otherwise(F.coalesce(here <= F.col("cut"), F.lit(False)))
    joined = rows.join(broadcast_if_small(s), _same(F.col("source"), F.col("s")))
    return joined.withColumn("times", F.col("epochs") + more.cast("long"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, and the words the mix takes of each document."""
    keyed = stored(_keyed(docs, id_col, text_col, source_col, seed), "keys")
    rows = _once_more(keyed, cuts(keyed, weights, max_epochs))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: every document with all its columns, as often as it is taken."""
    keyed = stored(_keyed(docs, id_col, text_col, source_col, seed), "keys")
    sources = cuts(keyed, weights, max_epochs)
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        sample_key(doc_id, text, seed).alias("key"),
        F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.crc32(text), F.lit(-1)).alias("tie"),
    )
    rows = _once_more(whole, sources).filter("times > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return rows.select("row.*")
