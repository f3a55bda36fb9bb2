"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and then by its leading tokens, where tokens with
digits count as variable. In the leaf it reaches, a token is constant if enough different texts have
it at its place, and variable (``*``) otherwise; the constants make the line's template. A template
is boilerplate if enough different texts have it and at least half of its tokens are constant. Lines
of such templates are dropped, in all documents.

How many texts are enough depends on the constants. Five are needed for any template; two for one
with ten or more constant tokens, which texts do not share by chance, so that passages copied between
a few documents go too. What either number
finds is dropped; each makes its own constants and templates.

All of it is DataFrame operations. Equal texts count once, by their key, so groups of copies do not turn
their own lines into templates, and whole texts are never moved. Only lines in leaves that enough
texts reach are split into tokens for good, which leaves out nearly all running text; both numbers
share these lines and the counts of their tokens. Counts of leaves, tokens and templates are combined
before each shuffle, and no leaf or template is gathered.

Defined cases: a null text has no lines; an empty text has one empty line; lines without any token
are never dropped; texts are named by 64-bit hashes; repeated rows each get a row; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respeval.llm.common import id_and_text, stored
from respeval.sources.storage import broadcast_if_small

# Different texts that must share a template.
TEXTS = 5
# Leading tokens on the way to a leaf.
DEPTH = 3
# Different texts that must share a template of LONG or more constant tokens.
FEW_TEXTS = 2
LONG = 10


def _tokens(line: Column) -> Column:
    # Most lines have no digits and single spaces, which is found out faster than a pattern splits.
    masked = F.regexp_replace(line, r"[^ \t]*[0-9][^ \t]*", "*")
    wide = line.contains("\t") | line.contains("  ")
    return (
        F.when(line.rlike("[0-9]"), F.split(masked, r"[ \t]+"))
        .when(wide, F.split(line, r"[ \t]+"))
        .otherwise(F.split(line, " "))
    )


def _texts_of(each: DataFrame, enough: list[int]) -> DataFrame:
    """name and texts, for names in as many different texts as the least number of ``enough``.

    ``texts`` is exact or at least where it falls between the numbers. Smallest and largest text, and a set of 64 bits,
    settle nearly all names in one aggregate; names that these leave open are counted.
    """
    low = min(enough)
    bit = F.expr("shiftleft(1L, cast(pmod(text_key, 64) as int))")
    stats = each.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("bits"), (F.min("text_key") != F.max("text_key")).alias("two")
    )
    stats = stats.filter((F.col("n") >= low) & (F.col("two") | F.lit(low < 2)))
    least = F.greatest(F.bit_count("bits"), F.when(F.col("two"), 2).otherwise(1))
    # Open is what could still reach a number that it is not known to reach.
    is_open = F.lit(False)
    for number in enough:
        is_open |= (least < number) & (F.col("n") >= number)
    stats = stored(stats.select("name", least.cast("long").alias("least"), is_open.alias("open")), "seen")
    counted = each.join(broadcast_if_small(stats.filter("open").select("name")), "name", "left_semi")
    counted = counted.groupBy("name", "text_key").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.groupBy("name").agg(F.count(F.lit(1)).alias("texts"))
    sure = stats.filter(~F.col("open")).select("name", F.col("least").alias("texts"))
    return sure.unionByName(counted).filter(F.col("texts") >= low)


def _templates(each: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """text_key, line, and the template with the texts that it needs, for the lines of ``each`` that have one.

    ``each`` has the constant tokens (leaf, text_key, line, n, place, token, texts). What is not constant is variable, so
    the constants and their places make a template. A kind is its number, texts and constants needed.
    """
    part = F.struct("place", "token")
    whole = each.groupBy("leaf", "text_key", "line", "n").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("texts") >= texts, part))).alias(f"template_{i}")
            for i, texts, _ in kinds
        ]
    )
    found = []
    for i, texts, least in kinds:
        constants = F.size(f"template_{i}")
        fits = (2 * constants >= F.col("n")) & (constants >= least) & (constants > 0)
        name = F.xxhash64("leaf", f"template_{i}", F.lit(i))
        found.append(F.when(fits, F.struct(name.alias("template"), F.lit(texts).alias("enough"))))
    return whole.select("text_key", "line", F.inline(F.array_compact(F.array(*found))))


def _each(held: DataFrame) -> DataFrame:
    each = held.select("leaf", "text_key", "line", "n", F.posexplode("tokens").alias("place", "token"))
    return each.filter(F.col("token") != "*")


def _of_small_leaves(held: DataFrame, low: int) -> DataFrame:
    """Templates of lines in leaves that fewer texts reach than any template needs.

    Such a leaf holds lines of a few texts only, so it is dealt out whole, line by line, and all the rest is
    done where it lies.
    """
    each = _each(held.repartition("leaf"))
    token = W.partitionBy("leaf", "place", "token")
    if low <= 2:
        several = F.min("text_key").over(token) != F.max("text_key").over(token)
        each = each.withColumn("texts", F.when(several, 2).otherwise(1))
    else:
        first = F.dense_rank().over(token.orderBy("text_key"))
        each = each.withColumn("rank", first).withColumn("texts", F.max("rank").over(token))
    return _templates(each.filter(F.col("texts") >= low), [(1, low, LONG)])


def template_lines(
    rows: DataFrame, min_texts: int = TEXTS, depth: int = DEPTH, few_texts: int | None = FEW_TEXTS
) -> DataFrame:
    """text_key and line (its number from 0) of all boilerplate lines.

    ``rows`` has text_key and text; copies of a text may occur.
    """
    low = min_texts if few_texts is None else min(few_texts, min_texts)
    kinds = [(0, min_texts, 0)] + ([(1, low, LONG)] if low < min_texts else [])
    lines = rows.select("text_key", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    lines = lines.filter(F.trim("value", F.lit(" \t")) != "")
    lines = lines.select("text_key", "line", _tokens(F.col("value")).alias("tokens"))
    lines = lines.select("*", F.size("tokens").alias("n"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"))
    leaves = lines.select("leaf", "text_key", (F.col("n") >= LONG).alias("long"))
    leaves = leaves.groupBy("leaf", "text_key", "long").agg(F.count(F.lit(1)).alias("n"))
    leaves = leaves.groupBy("leaf", "long").agg(F.count(F.lit(1)).alias("texts"))
    leaves = leaves.filter((F.col("texts") >= min_texts) | (F.col("long") & (F.col("texts") >= low)))
    leaves = broadcast_if_small(leaves.select("leaf", (F.col("texts") >= min_texts).alias("large")))
    held = lines.join(leaves, "leaf").dropDuplicates(["text_key", "line"])
    held = stored(held.select("large", "leaf", "text_key", "line", "n", "tokens"), "lines")

    each = _each(held.filter("large")).withColumn("name", F.xxhash64("leaf", "place", "token"))
    constant = _texts_of(each.select("name", "text_key"), [texts for _, texts, _ in kinds])
    whole = _templates(each.join(broadcast_if_small(constant), "name"), kinds)
    if low < min_texts:
        whole = whole.unionByName(_of_small_leaves(held.filter("not large"), low))
    whole = stored(whole, "templates")
    common = whole.groupBy("template", "enough", "text_key").agg(F.count(F.lit(1)).alias("n"))
    common = common.groupBy("template", "enough").agg(F.count(F.lit(1)).alias("texts"))
    common = broadcast_if_small(common.filter(F.col("texts") >= F.col("enough")).select("template"))
    return whole.join(common, "template", "left_semi").select("text_key", "line").distinct()


def _dropped(docs: DataFrame, text_col: str, min_texts: int, depth: int, few_texts: int | None) -> DataFrame:
    """text_key and the sorted numbers of the dropped lines; only texts with such lines."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    rows = rows.select(F.xxhash64("text").alias("text_key"), "text")
    lines = template_lines(rows, min_texts, depth, few_texts)
    return lines.groupBy("text_key").agg(F.array_sort(F.collect_list("line")).alias("dropped"))


def dropped_lines(
    docs: DataFrame,
    min_texts: int = TEXTS,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    few_texts: int | None = FEW_TEXTS,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the numbers of the dropped lines of every document.

    With ``few_texts`` None, ``min_texts`` holds for long lines too.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.col("text").isNull().alias("empty"),
    )
    rows = rows.withColumn("n_lines", F.when(F.col("empty"), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
    found = stored(_dropped(docs, text_col, min_texts, depth, few_texts), "dropped")
    joined = rows.join(broadcast_if_small(found), "text_key", "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def drop_template_lines(
    docs: DataFrame,
    min_texts: int = TEXTS,
    depth: int = DEPTH,
    text_col: str = "text",
    few_texts: int | None = FEW_TEXTS,
) -> DataFrame:
    """The documents with all their columns, without their boilerplate lines."""
    found = stored(_dropped(docs, text_col, min_texts, depth, few_texts), "dropped")
    found = found.select(F.col("text_key").alias("__key"), F.col("dropped").alias("__dropped"))
    text = F.col(f"`{text_col}`")
    joined = docs.join(broadcast_if_small(found), F.xxhash64(text) == F.col("__key"), "left")
    kept = F.array_join(
        F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__dropped", i)), "\n"
    )
    clean = F.when(F.col("__dropped").isNull(), text).otherwise(kept)
    return joined.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
