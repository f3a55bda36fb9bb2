from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from respeval.llm import fixity

SCHEMA = "page_id long, url string, html string, offset string, digest int"


def pages(rng, n):
    rows = [(i, f"u{i}", "x" * rng.randrange(3000), None, None) for i in range(n)]
    return [*rows, (n, None, None, "o", 1), (n + 1, "", "", None, None), (None, "null", "é" * 9, None, None), rows[5]]


def index(table, rows):
    return fixity.archive_index(table(rows, SCHEMA), "page_id", "url", "html")


def expected_index(rows):
    out, at = [], 0
    keyed = []
    for key, url, html, *_ in rows:
        body = f"{url or ''}\n{html or ''}".encode()
        keyed.append((key is not None, key or 0, hashlib.sha256(body).hexdigest(), len(body) - 1 + fixity.HEADER))
    for known, key, digest, length in sorted(keyed):
        out.append((key if known else None, at, length, digest))
        at += length
    return out


def test_index_over_ranges_of_keys(table, monkeypatch):
    monkeypatch.setattr(fixity, "KEYS", 20)
    rows = pages(random.Random(1), 200)
    assert sorted(map(tuple, index(table, rows).collect()), key=lambda r: r[1]) == expected_index(rows)


def test_string_keys(table, monkeypatch):
    monkeypatch.setattr(fixity, "KEYS", 20)
    rng = random.Random(4)
    rows = [(None if i % 40 == 7 else f"http://h{rng.randrange(90)}/é", f"u{i}", "x" * rng.randrange(900)) for i in range(200)]
    df = table(rows, "page_id string, url string, html string")
    got = fixity.archive_index(df, "page_id", "url", "html").collect()
    at = 0
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == at
        at += r.length
    order = [(r.key is not None, r.key or "", r.digest) for r in sorted(got, key=lambda r: r.offset)]
    assert len(got) == len(rows) and order == sorted(order)


def test_tree_by_its_definition(table, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE", 4000)
    monkeypatch.setattr(fixity, "FANOUT", 4)
    rows = pages(random.Random(2), 120)
    entries = expected_index(rows)
    levels = fixity.depth(entries[-1][1] + 1)
    got = {(r.level, r.node): r.digest for r in fixity.tree(index(table, rows), levels).collect()}
    below = {}
    for _, offset, _, digest in entries:
        below.setdefault(offset // 4000, []).append(digest)
    expected = {}
    for level in range(levels):
        hashes = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in below.items()}
        expected |= {(level, k): v for k, v in hashes.items()}
        below = {}
        for k in sorted(hashes):
            below.setdefault(k // 4, []).append(hashes[k])
    assert len(hashes) == 1 and got == expected


def test_audit_finds_exactly_the_damage(table, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE", 5000)
    monkeypatch.setattr(fixity, "FANOUT", 3)
    rows = pages(random.Random(3), 150)
    primary = index(table, rows)
    damaged = F.when(F.col("key").isin(7, 8, 149), F.sha2("digest", 256)).otherwise(F.col("digest"))
    replica = primary.filter("key is null or key not in (40, 41)").withColumn("digest", damaged)
    extra = primary.filter("key = 60").select(F.lit(999).cast("long").alias("key"), (F.col("offset") + 1).alias("offset"), "length", "digest")
    got = fixity.audit(primary, replica.unionByName(extra)).collect()
    assert len(got) == len(rows) + 1
    bad = sorted((r.status, r.key) for r in got if r.status != "ok")
    assert bad == [("corrupt", 7), ("corrupt", 8), ("corrupt", 149), ("extra", 999), ("missing", 40), ("missing", 41)]
    assert {r.status for r in fixity.audit(primary, primary).collect()} == {"ok"}


@pytest.mark.parametrize("cuts", [100_000, 7, 1])
def test_one_key_on_most_records(table, monkeypatch, cuts):
    """Ranges that one key fills, or that are long, are hashed in parts; damage is found as ever."""
    monkeypatch.setattr(fixity, "RANGE", 2000)
    monkeypatch.setattr(fixity, "MOST_CUTS", cuts)
    rng = random.Random(8)
    rows = [(5 if i % 3 else i, f"u{i}", "x" * rng.randrange(300), None, None) for i in range(240)]
    other = [r for r in rows if r[1] not in ("u7", "u33")] + [(5, "new", "y", None, None)]
    other = [(*r[:2], "changed", None, None) if r[1] == "u60" else r for r in other]
    found, parts = fixity.manifest(index(table, rows))
    assert len(found) <= cuts and parts > 1
    got = fixity.audit(index(table, rows), index(table, other)).collect()
    bad = sorted((r.status, r.key) for r in got if r.status != "ok")
    assert bad == [("corrupt", 5), ("corrupt", 60), ("missing", 33)] and len(got) == len(rows)


def test_keys_meet_only_where_ranges_differ(table, monkeypatch):
    """No join of all keys: the records that are joined are those of differing ranges."""
    monkeypatch.setattr(fixity, "RANGE", 3000)
    rows = [(f"http://{i:04}", f"u{i}", "x" * (i % 700), None, None) for i in range(400)]
    other = [r for r in rows if r[0] != "http://0200"] + [("http://0300/a", "more", "z" * 5000, None, None)]
    seen = []
    taken = fixity._same
    monkeypatch.setattr(fixity, "_same", lambda a, b, *rest: seen.append(a.count() + b.count()) or taken(a, b, *rest))
    schema = "page_id string, url string, html string, offset string, digest int"
    one, two = (fixity.archive_index(table(r, schema), "page_id", "url", "html") for r in (rows, other))
    bad = sorted((r.status, r.key) for r in fixity.audit(one, two).collect() if r.status != "ok")
    assert bad == [("extra", "http://0300/a"), ("missing", "http://0200")]
    assert seen[0] < 60


def test_replica_with_an_archive_of_its_own(table, monkeypatch):
    """Lost, inserted, shorter and longer records shift all later offsets of the replica."""
    monkeypatch.setattr(fixity, "RANGE", 5000)
    monkeypatch.setattr(fixity, "FANOUT", 3)
    rows = pages(random.Random(5), 150)
    rows += [(r[0] * 2 + 1000, *r[1:]) for r in rows[:40]] + [(60, "u60", "second", None, None), (None, "n2", "x", None, None)]
    # One of two equal records, one of two unlike ones with the same key, and others.
    other = [r for i, r in enumerate(rows) if i != 5 and r[0] not in (0, 40, 41) and r[2] != "second"]
    other = [(*r[:2], (r[2] + "longer") if r[0] in (7, 149) else "" if r[0] == 8 else r[2], *r[3:]) for r in other]
    other += [(-5, "new", "x" * 9000, None, None), (1003, "new", "", None, None), (9999, "new", "y", None, None)]
    other += [(90, "u90", "also", None, None), (None, "n3", "z" * 99, None, None)]
    primary, replica = index(table, rows), index(table, other)
    seen = []
    taken = fixity._same
    monkeypatch.setattr(fixity, "_same", lambda a, *rest: seen.append(a.count()) or taken(a, *rest))
    got = fixity.audit(primary, replica).collect()
    bad = sorted((r.status, r.key is None, r.key or 0) for r in got if r.status != "ok")
    assert bad == sorted(
        [("corrupt", False, k) for k in (7, 8, 149)]
        + [("missing", False, k) for k in (0, 5, 40, 41, 60)]
        + [("extra", False, k) for k in (-5, 90, 1003, 9999)] + [("extra", True, 0)]
    )
    own = sorted((r.key is not None, r.key or 0, r.offset) for r in got if r.status != "extra")
    assert own == sorted((k is not None, k or 0, at) for k, at, *_ in expected_index(rows))
    # Sound ranges are not descended.
    assert seen[0] < len(rows) / 2


def test_content_under_another_key(table):
    rows = [(1, "u", "same", None, None), (2, "u", "other", None, None)]
    moved = [(1, "u", "same", None, None), (3, "u", "other", None, None)]
    got = fixity.audit(index(table, rows), index(table, moved)).collect()
    assert sorted((r.status, r.key) for r in got) == [("extra", 3), ("missing", 2), ("ok", 1)]


def test_empty_archives(table, spark):
    empty = fixity.archive_index(spark.createDataFrame([], SCHEMA), "page_id", "url", "html")
    full = index(table, pages(random.Random(4), 6))
    assert fixity.audit(empty, empty).count() == 0
    assert {r.status for r in fixity.audit(full, empty).collect()} == {"missing"}
    assert {r.status for r in fixity.audit(empty, full).collect()} == {"extra"}
