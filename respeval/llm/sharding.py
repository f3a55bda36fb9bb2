"""Sharding: best-fit decreasing with indivisible groups of equal texts.

Groups are packed in the order of their sizes, largest first. Each enters the open shard with the
least remaining capacity that still holds it, found in a balanced tree of remaining capacities; if
none holds it, it opens a shard. A group larger than the capacity is cut into pieces of as many
copies as fit; a single document larger than the capacity has a shard of its own.

Groups of one size are interchangeable, so the packing needs only how many groups there are of each
size: the k-th run of groups of a size goes to a shard, as it would one by one, because a shard that
just took a group is the tightest as long as it holds another. Different sizes add up to at most the
size of the table, so there are at most sqrt(2 * bytes) of them; that is what the driver gets. The
runs go back to the groups by the groups' rank within their size.

``balance`` packs into a given number of shards: it looks for the smallest capacity that does with so
many. ``pack`` packs into as few shards of a given capacity as best-fit decreasing needs.

No step gathers a group or a shard: copies and ranks are counted in salted parts whose offsets are
added up.

Defined cases: a null text has no bytes; null texts are one group, empty texts another; repeated rows
are copies, each with its own slot; a null id is allowed; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respeval.llm.common import id_and_text, stored

SHARDS = 40
# Bytes that a document takes beside its text.
OVERHEAD = 16
# Parts in which the copies of a group, the groups of a size and the rows of a shard are counted.
PARTS = 64


class CapacityTree:
    """Remaining capacities as (capacity, shard), in a tree of two levels of bounded sorted blocks."""

    BLOCK = 512

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []  # largest entry of each block

    def add(self, capacity: int, shard: int) -> None:
        entry = (capacity, shard)
        if not self.blocks:
            self.blocks, self.last = [[entry]], [entry]
            return
        i = min(bisect_left(self.last, entry), len(self.blocks) - 1)
        block = self.blocks[i]
        insort(block, entry)
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.last[i : i + 1] = [block[half - 1], block[-1]]
        else:
            self.last[i] = block[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest entry with at least ``size`` capacity."""
        i = bisect_left(self.last, (size, -1))
        if i == len(self.blocks):
            return None
        block = self.blocks[i]
        entry = block.pop(bisect_left(block, (size, -1)))
        if block:
            self.last[i] = block[-1]
        else:
            del self.blocks[i], self.last[i]
        return entry


def best_fit_decreasing(
    sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None
) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, last rank, shard) for (size, number of groups), largest size first.

    None if more than ``most`` shards are needed.
    """
    tree, runs, shards = CapacityTree(), [], 0
    for size, count in sizes:
        at = 0
        while at < count:
            entry = tree.take(size)
            if entry is None:
                if shards == most:
                    return None
                entry = (max(capacity, size), shards)
                shards += 1
            room, shard = entry
            n = min(count - at, room // size)
            runs.append((size, at, at + n - 1, shard))
            tree.add(room - n * size, shard)
            at += n
    return runs


def smallest_capacity(sizes: list[tuple[int, int]], shards: int) -> int:
    """The smallest capacity found by bisection with which best-fit decreasing needs so few shards."""
    # Groups above the mean of the other shards have shards of their own and do not raise the bound.
    total, left = sum(s * n for s, n in sizes), shards
    for size, n in sizes:
        if n >= left or size * left <= total:
            break
        total, left = total - size * n, left - n
    low = max(1, -(-total // left))
    step, high = 1, low
    while best_fit_decreasing(sizes, high, shards) is None:
        low, high, step = high + 1, high + step, step * 4
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return high


def _salt(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _number(rows: DataFrame, keys: list[str], salt: str, order: list[str], into: str) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each key from 0 without gathering it: rows with a number inside their part
    (``into``), and per key and part the number of rows and of those in parts before it."""
    inside = W.partitionBy(*keys, salt).orderBy(*order)
    rows = stored(rows.withColumn(into, F.row_number().over(inside).cast("long") - 1), into)
    parts = rows.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy(*keys).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    return rows, parts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def _shard(docs: DataFrame, id_col: str, text_col: str, shards: int | None, capacity: int | None) -> DataFrame:
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("group"),
        _salt(F.struct("doc_id")).alias("salt"),
    )
    rows, copies = _number(rows, ["group", "size"], "salt", ["doc_id"], "copy")
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = capacity or max(1, -(-total // (shards or 1)))
    # Pieces of groups: whole, or as many copies as fit.
    copies = stored(copies, "copies")
    groups = copies.groupBy("group", "size").agg(F.sum("n").alias("n"))
    fit = F.when(F.col("n") * F.col("size") > share, F.greatest(F.lit(1), F.floor(F.lit(share) / F.col("size")))).otherwise(
        F.col("n")
    )
    groups = groups.withColumn("fit", fit.cast("long"))
    pieces = groups.select(
        "group", "size", "n", "fit",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("fit")))).alias("piece"),
    )
    held = F.least(F.col("fit"), F.col("n") - F.col("piece") * F.col("fit"))
    pieces = pieces.select(
        "group", "fit", "piece", (held * F.col("size")).alias("bytes"), _salt(F.struct("group", "piece")).alias("salt")
    )
    pieces, ranks = _number(pieces, ["bytes"], "salt", ["group", "piece"], "rank")
    ranks = stored(ranks, "ranks")
    counted = ranks.groupBy("bytes").agg(F.sum("n").alias("n")).orderBy(F.desc("bytes"))
    sizes = [(r["bytes"], r["n"]) for r in counted.collect()]
    if capacity is None:
        capacity = smallest_capacity(sizes, shards)
    runs = spark.createDataFrame(
        best_fit_decreasing(sizes, capacity) or [], "bytes long, first long, last long, shard int"
    )
    # The runs that the ranks of each part of a size meet.
    meets = ranks.join(runs, "bytes").filter(
        (F.col("first") < F.col("before") + F.col("n")) & (F.col("last") >= F.col("before"))
    )
    meets = meets.groupBy("bytes", "salt", "before").agg(
        F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("runs")
    )
    placed = pieces.join(meets, ["bytes", "salt"])
    rank = F.col("before") + F.col("rank")
    placed = placed.select(
        "group", "fit", "piece", F.filter("runs", lambda r: r["last"] >= rank)[0]["shard"].alias("shard")
    )
    placed = placed.groupBy("group").agg(
        F.first("fit").alias("fit"),
        F.transform(F.array_sort(F.collect_list(F.struct("piece", "shard"))), lambda p: p["shard"]).alias("shards"),
    )
    # Back to the documents, by group and part, so that a frequent group is not one key.
    parts = copies.select("group", "salt", "before").join(placed, "group")
    found = rows.join(parts, ["group", "salt"])
    piece = F.floor((F.col("before") + F.col("copy")) / F.col("fit")).cast("int")
    found = found.select("doc_id", "size", "text_crc32", F.get("shards", piece).alias("shard"), "salt")
    found, before = _number(found, ["shard"], "salt", ["doc_id", "text_crc32"], "inside")
    # At most PARTS rows per shard.
    found = found.join(before.select("shard", "salt", "before"), ["shard", "salt"])
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"))


def balance(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, with sizes of ``shards`` shards as equal as found."""
    return _shard(docs, id_col, text_col, shards, None)


def pack(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, in shards of at most ``capacity`` bytes, as few as
    best-fit decreasing needs; a single larger document has a shard of its own."""
    return _shard(docs, id_col, text_col, None, capacity)
