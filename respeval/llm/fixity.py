"""Merkle fixity audit of replicated archives.

A record's hash covers its target and payload. Records lie one after another in an archive, by key;
ranges of offsets of a fixed length, the lowest level of the tree, hash the hashes of the records
that begin in them, in order, and every level above hashes a fixed number of ranges of the one
below. Two replicas are compared from their roots down: only children of ranges that differ are
looked at, so damage is found with as many comparisons as the tree is deep, and only records in
differing ranges of the lowest level are compared themselves.

Both trees are over the primary's ranges. A replica has offsets of its own: after a record that was lost, added or
has another length, all others lie elsewhere. So the primary's index is the manifest: the first keys of its
ranges cut the keys, and every record of either replica belongs to the range that its key falls in. Each
replica is hashed by itself; a lost, added or longer record changes the range of its key and no other, and
keys of both replicas meet only in ranges that differ.

The offsets come from the archive's index: prefix sums over ranges of the key, so no task sees more
than one range.

Defined cases: a null target or payload counts as empty; records with the same key follow each other
by hash, and equal ones are matched first; a record that only one replica has is missing or extra; an
empty archive has no root, and two empty archives are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respeval.llm.common import range_cuts, stored, with_range
from respeval.sources.storage import broadcast_if_small

# Bytes of an archive in a range of the lowest level, and ranges under a range of the next.
RANGE = 1 << 16
FANOUT = 16
# Bytes of a record's header beside its target.
HEADER = 128
# Records in a range of the key for the prefix sums.
KEYS = 50_000
# Ranges of the lowest level, at most; their first keys are broadcast.
MOST_CUTS = 100_000


def archive_index(pages: DataFrame, key: str, target: str, payload: str) -> DataFrame:
    """key, offset, length and digest of every record, in the order of the keys."""
    first = F.coalesce(F.col(f"`{target}`"), F.lit(""))
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(first) + F.octet_length(body) + HEADER).cast("long").alias("length"),
        F.sha2(F.concat(first, F.lit("\n"), body), 256).alias("digest"),
    )
    rows = stored(rows, "records")
    order = ["key", "digest"]
    rows = with_range(rows, order, range_cuts(rows, order, 1 + rows.count() // KEYS))
    sums = rows.groupBy("part").agg(F.sum("length").alias("sum"))
    # As many rows as ranges of the key.
    before = F.sum("sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), "digest").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(sums), "part")
    return rows.select("key", (F.col("base") + F.col("inside")).alias("offset"), "length", "digest")


def tree(index: DataFrame, levels: int) -> DataFrame:
    """level, node and digest of all ranges; level 0 is the lowest, ``levels - 1`` has the root."""
    node = F.floor(F.col("offset") / RANGE).cast("long")
    nodes = index.select(node.alias("node"), F.struct("offset", "digest").alias("child"))
    out = None
    for level in range(levels):
        hashes = F.transform(F.array_sort(F.collect_list("child")), lambda c: c["digest"])
        nodes = nodes.groupBy("node").agg(F.sha2(F.array_join(hashes, ""), 256).alias("digest"))
        here = nodes.select(F.lit(level).alias("level"), "node", "digest")
        out = here if out is None else out.unionByName(here)
        nodes = nodes.select(
            F.floor(F.col("node") / FANOUT).cast("long").alias("node"),
            F.struct(F.col("node").alias("offset"), "digest").alias("child"),
        )
    return out


def depth(size: int) -> int:
    """Levels of the tree over an archive of so many bytes."""
    levels, ranges = 1, -(-size // RANGE)
    while ranges > 1:
        levels, ranges = levels + 1, -(-ranges // FANOUT)
    return levels


def manifest(primary: DataFrame) -> tuple[list[tuple], int]:
    """The keys that cut the primary into ranges of ``RANGE`` bytes, and the parts in which a range is hashed.

    Above ``MOST_CUTS`` ranges they are as many times as long, and hashed in as many parts; so is a range whose only key
    has many records.
    """
    size = primary.agg(F.max(F.col("offset") + 1)).first()[0] or 0
    wide = max(1, -(-size // (RANGE * MOST_CUTS)))
    node = F.floor(F.col("offset") / (RANGE * wide))
    firsts = primary.groupBy(node.alias("node")).agg(F.min("key").alias("key"))
    cuts = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key").collect()
    longest = max((r["n"] for r in cuts), default=1)
    return [(r["key"],) for r in cuts if r["key"] is not None], min(RANGE, wide * longest)


def _hashed(placed: DataFrame, parts: int) -> DataFrame:
    """What the tree is over: hashes of the records' keys with their digests, or of the parts of a range."""
    name = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit(""))
    start = F.col("range").cast("long") * RANGE
    rows = placed.select(start.alias("offset"), F.sha2(F.concat(name, F.lit("\n"), "digest"), 256).alias("digest"))
    if parts == 1:
        return rows
    dealt = rows.groupBy("offset", F.pmod(F.crc32("digest"), F.lit(parts)).alias("part"))
    whole = dealt.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    return whole.select((F.col("offset") + F.col("part")).alias("offset"), "digest")


def _same(left: DataFrame, right: DataFrame, number: str, *names: str) -> DataFrame:
    """Full outer join of records as structs a and b, by equal names and numbers; nulls are equal."""
    on = (F.col("a.key").eqNullSafe(F.col("b.key"))) & (F.col("a_n") == F.col("b_n"))
    for name in names:
        on &= F.col(f"a.{name}") == F.col(f"b.{name}")
    rank = F.row_number().over(W.partitionBy("key", *names).orderBy(number))
    record = F.struct("key", "offset", "length", "digest")
    a = left.select(record.alias("a"), rank.alias("a_n"))
    b = right.select(record.alias("b"), rank.alias("b_n"))
    return a.join(b, on, "full_outer")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of two stored indexes (key, offset, length, digest) with its status.

    Status is ok, corrupt (the key has another hash), missing (not in the replica) or extra (only
    there); offset, length and digest are the primary's, those of extra records the replica's. Of
    several records with one key, equal ones are matched first, the rest in their order.
    """
    cuts, parts = manifest(primary)
    mine = with_range(primary, ["key"], cuts, "range")
    other = with_range(replica, ["key"], cuts, "range")
    levels = depth((len(cuts) + 1) * RANGE)
    a_tree = stored(tree(_hashed(mine, parts), levels), "tree")
    b_tree = stored(tree(_hashed(other, parts), levels), "tree")
    bad = None
    for level in range(levels - 1, -1, -1):
        a = a_tree.filter(F.col("level") == level).select("node", F.col("digest").alias("a"))
        b = b_tree.filter(F.col("level") == level).select("node", F.col("digest").alias("b"))
        if bad is not None:
            above = broadcast_if_small(bad.select(F.col("node").alias("parent")))
            parent = F.floor(F.col("node") / FANOUT) == F.col("parent")
            a, b = a.join(above, parent, "left_semi"), b.join(above, parent, "left_semi")
        differ = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        bad = stored(differ.select("node"), "differing")
        if bad.isEmpty():
            break
    ranges = broadcast_if_small(bad.select(F.col("node").alias("bad")))
    inside = F.col("range") == F.col("bad")
    good = mine.join(ranges, inside, "left_anti").drop("range").withColumn("status", F.lit("ok"))
    a, b = (side.join(ranges, inside, "left_semi") for side in (mine, other))
    first = stored(_same(a, b, "offset", "digest"), "compared")
    equal = first.filter("a is not null and b is not null").select("a.*", F.lit("ok").alias("status"))
    left = first.filter("b is null").select("a.*")
    right = first.filter("a is null").select("b.*")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    rest = _same(left, right, "offset").select(F.coalesce("a", "b").alias("one"), status.alias("status"))
    return good.unionByName(equal).unionByName(rest.select("one.*", "status"))
