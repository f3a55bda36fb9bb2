from __future__ import annotations

import random
import re
import string

from pyspark.sql import functions as F

from respeval.llm import secrets
from tests.llm.data import SCHEMA, awkward

PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for kind, (pattern, group, least) in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def noise(rng: random.Random) -> str:
    parts = [
        "password", "PassWD", "token", "secret", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA",
        "AKIAAKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef" * 4, "abcdefgh", "ſecret", "toKen", "é", "\n", "\t",
        "x" * 9, "a-b_c.d/e+f=", " ", "日本", "secret=token:abcdefghij",
    ]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(7)
    for _ in range(5000):
        text = noise(rng)
        assert secrets.scan(text)[0] == brute_force(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "secret" * 50_000, "AKIA" * 50_000, "token=" + "b" * 300_000, "token " * 50_000):
        assert secrets.scan(text)[0] == brute_force(text)


def random_token(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_battery_tells_random_from_text(table):
    rng = random.Random(11)
    b64 = string.ascii_letters + string.digits + "+/"
    planted = {i: random_token(rng, b64, rng.choice([32, 40, 64])) for i in range(60)}
    planted |= {100 + i: random_token(rng, "0123456789abcdef", 40).upper() for i in range(20)}
    words = ["international", "organisation", "HelloWorld", "someLongIdentifier", "snake_case_name", "value2"]
    clean = {200 + i: "_".join(rng.choice(words) for _ in range(4)) + str(i) for i in range(300)}
    clean |= {600 + i: rng.choice("xyz") * rng.randrange(20, 90) + "1" for i in range(30)}
    clean |= {700 + i: f"https://example.org/{rng.choice(words)}/{rng.choice(words)}/{i}/page" for i in range(100)}
    rows = [(i, f"so it is {t} here") for i, t in (planted | clean).items()]
    found = {r.doc_id: r for r in secrets.secret_spans(table(rows, "doc_id long, text string")).collect()}
    hit = {i for i, r in found.items() if r.random}
    assert len(hit & set(planted)) >= 0.85 * len(planted)
    assert len(hit & set(clean)) <= 0.02 * len(clean)
    text = dict(rows)
    for i in hit & set(planted):
        assert [text[i][s.start : s.end] for s in found[i].random] == [planted[i]]


def test_awkward_documents(table):
    rows = awkward() + [(99, 'Password: "abcdefgh12" AKIA0123456789AB ' + "0a" * 16, None, None, None, None, None)]
    got = secrets.secret_spans(table(rows, SCHEMA))
    listed = got.select("doc_id", secrets.span_list(F.concat("base", "random")).alias("s")).collect()
    assert len(listed) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got.filter("doc_id is not null").collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_force(text[r.doc_id])
    (last,) = [r.s for r in listed if r.doc_id == 99]
    assert last == "assign:0:21,access:23:39,hex:40:72"


def test_empty_table_and_redaction(spark):
    assert secrets.secret_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    assert secrets.redact("key=abc def", [(4, 7), (5, 7)], "*") == "key=* def"
