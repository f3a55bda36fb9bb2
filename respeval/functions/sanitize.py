"""Cleaning of strings and nested values, HTML escaping, key shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.functions.text import LATIN_SPACES, WIDE_SPACES, collapse_spaces

# Lengths and prefixes of the cleaning rules.
MAX_STRING = 10_000
MAX_KEY = 200
MAX_FILENAME = 255
UNNAMED_FILE = "unnamed_file"
KEY_PREFIXES = ("sk-", "claude-")
MIN_KEY_LENGTH = 20
BARE_KEY_LENGTH = 30
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))

_UNSAFE_IN_FILENAME = rf"[^\p{{L}}\p{{N}}_{LATIN_SPACES}{WIDE_SPACES}\-.]"


def html_escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def sanitize_string(text: Column, max_length: int = MAX_STRING) -> Column:
    """Cut to ``max_length`` first, then drop NULs and collapse whitespace."""
    cut = F.substring(text, 1, max_length)
    return collapse_spaces(F.replace(cut, F.lit("\x00"), F.lit("")))


def sanitize_filename(name: Column) -> Column:
    safe = F.btrim(F.regexp_replace(name, _UNSAFE_IN_FILENAME, ""), F.lit(". "))
    cut = F.substring(safe, 1, MAX_FILENAME)
    return F.when(cut == "", UNNAMED_FILE).otherwise(cut)


def sanitize_value(value: Column, kind: T.DataType) -> Column:
    """Clean every string inside a value of any type; map keys are cut to the key length."""
    if isinstance(kind, T.StringType):
        return sanitize_string(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: sanitize_value(v, kind.elementType))
    if isinstance(kind, T.MapType):
        cleaned = F.transform_values(value, lambda _, v: sanitize_value(v, kind.valueType))
        if not isinstance(kind.keyType, T.StringType):
            return cleaned
        # Keys that become equal collapse to the last one, as in a dictionary.
        entries = F.map_entries(cleaned)
        last = F.aggregate(
            entries,
            F.create_map().cast(T.MapType(T.StringType(), kind.valueType)),
            lambda acc, e: F.map_concat(
                F.map_filter(acc, lambda k, _: k != sanitize_string(e["key"], MAX_KEY)),
                F.create_map(sanitize_string(e["key"], MAX_KEY), e["value"]),
            ),
        )
        return F.when(value.isNotNull(), last)
    if isinstance(kind, T.StructType):
        # Field names of a struct are part of the schema, cleaned by sanitized_name().
        fields = [
            sanitize_value(value[f.name], f.dataType).alias(sanitized_name(f.name))
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def sanitized_name(name: str) -> str:
    return " ".join(name[:MAX_KEY].replace("\x00", "").split())


def valid_key_shape(key: Column) -> Column:
    """Whether a string looks like an API key."""
    size = F.length(key)
    prefixed = F.lit(False)
    for prefix in KEY_PREFIXES:
        prefixed = prefixed | key.startswith(prefix)
    shaped = (size >= MIN_KEY_LENGTH) & (prefixed | (size > BARE_KEY_LENGTH))
    return F.coalesce(shaped, F.lit(False))
