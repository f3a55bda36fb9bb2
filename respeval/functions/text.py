"""Text primitives with Python's notions of whitespace, word character and case.

Java's ``\\s`` and ``\\b`` differ from Python's, so the classes are spelled out here and nothing
else in the package writes its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() and str.strip() treat as whitespace. The ones
# below U+0100 stand apart because a class of single Latin-1 characters compiles to a bit set.
LATIN_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
WIDE_SPACES = (
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The marker phrases of the scoring heuristics.
LOGICAL = (
    "because", "therefore", "thus", "hence", "consequently", "as a result", "due to", "since",
    "so", "furthermore", "moreover", "specifically", "nevertheless", "however", "alternatively",
)
POSITIVE = (
    "understand", "help", "let me", "i can", "happy to", "certainly", "of course", "delighted",
    "pleasure", "assist", "welcome",
)
NEGATIVE = ("obviously", "you should have", "just", "simply", "clearly you", "wrong")
POLITE = ("please", "thank you", "appreciate")
UNCERTAIN = ("i don't know", "i'm not sure", "unclear", "uncertain")
ACCURACY_BONUS = (
    "because", "therefore", "specifically", "exactly", "precisely", "in fact", "evidently",
    "documented",
)
LIST_WORDS = ("first", "second", "•", "-")
# Fixed value: what is stripped from both ends of a word before words are compared.
WORD_PUNCTUATION = ".,;:!?()[]{}\"'`"

_WORD_CHAR = r"[\p{L}\p{N}_]"
_LATIN_RUN = f"[{LATIN_SPACES}]+"
_ANY_RUN = f"[{LATIN_SPACES}{WIDE_SPACES}]+"
_MAYBE_WIDE = "[\u1680-\u3000]"


def _split_on_space(text: Column, source: Column) -> Column:
    # The narrow class is several times faster and is enough for a text that holds none of the
    # wide spaces.
    return F.when(source.rlike(_MAYBE_WIDE), F.split(text, _ANY_RUN)).otherwise(
        F.split(text, _LATIN_RUN)
    )


def words(text: Column) -> Column:
    """The words of a text, as Python's ``split()`` gives them."""
    return F.array_remove(_split_on_space(text, text), "")


def lower_words(text: Column, lowered: Column) -> Column:
    """The words of the lower-case form of a text, given both."""
    return F.array_remove(_split_on_space(lowered, text), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(LATIN_SPACES + WIDE_SPACES))


def collapse_spaces(text: Column) -> Column:
    return F.array_join(words(text), " ")


def _phrases_by_first_letter(phrases: list[str]) -> str:
    rest: dict[str, list[str]] = {}
    for phrase in phrases:
        rest.setdefault(phrase[0], []).append(phrase[1:])
    return "|".join(f"{first}(?:{'|'.join(tails)})" for first, tails in rest.items())


_ALL_MARKERS = list(
    dict.fromkeys(LOGICAL + POSITIVE + NEGATIVE + POLITE + UNCERTAIN + ACCURACY_BONUS)
)
# The phrase is matched inside a lookahead, so phrases of two lists that share a word
# ("thank you should have") are both found.
_MARKER_PATTERN = (
    f"(?iu)(?<!{_WORD_CHAR})(?=((?:{_phrases_by_first_letter(_ALL_MARKERS)}))(?!{_WORD_CHAR}))"
)


_BAR = "|"


def markers(text: Column) -> Column:
    """All marker phrases of a text in order, as ``|because|so|``: one regex pass for all lists.

    A string rather than an array: counting in it needs no lambda, which would take the operator
    out of whole-stage code generation.
    """
    found = F.regexp_extract_all(text, F.lit(_MARKER_PATTERN), F.lit(1))
    joined = F.concat(F.lit(_BAR), F.array_join(found, _BAR), F.lit(_BAR))
    # Case-insensitive matching also accepts long s, the Kelvin sign, dotted and dotless i.
    return F.lower(F.translate(joined, "ſKİı", "skii"))


def has_marker(found: Column, phrases: tuple[str, ...]) -> Column:
    return found.rlike(rf"\|(?:{'|'.join(phrases)})\|")


def count_markers(found: Column, phrases: tuple[str, ...]) -> Column:
    return F.regexp_count(found, F.lit(rf"\|(?:{'|'.join(phrases)})(?=\|)"))


def has_list_marker(text: Column, lowered: Column) -> Column:
    """A digit before ``)``, a hyphen, a bullet, or "first"/"second" anywhere, even inside a word.

    Plain substring searches come first; the regexes run only on texts that could match them.
    """
    numbered = text.contains(")") & text.rlike(r"\p{Nd}\)")
    # Letters that fold to the ASCII letters of the list words but are not lowered to them.
    folded = contains_any(text, ("ſ", "ı", "İ")) & text.rlike("(?iu)first|second")
    return contains_any(lowered, LIST_WORDS) | numbered | folded


_NOT_SPACE = f"[^{LATIN_SPACES}{WIDE_SPACES}]"
_PUNCTUATION = f"[{re.escape(WORD_PUNCTUATION)}]"
# A run of punctuation up to the end of a word, or from its start. A run is looked at once, from its
# head and without giving back, so a long one costs no more than its length.
_WORD_ENDS = (
    f"(?<!{_PUNCTUATION})(?={_PUNCTUATION})"
    f"(?:{_PUNCTUATION}++(?!{_NOT_SPACE})|(?<!{_NOT_SPACE}){_PUNCTUATION}++)"
)


def unique_word_ratio(text: Column, lowered: Column, words: Column) -> Column:
    """Distinct words over words, compared without surrounding punctuation; null without words.

    Words are stripped in the text rather than one by one, which would take a lambda.
    """
    bare = F.array_remove(_split_on_space(F.regexp_replace(lowered, _WORD_ENDS, ""), text), "")
    # Words of nothing but punctuation are gone; all of them count as one empty word.
    emptied = (F.size(bare) < F.size(words)).cast("int")
    distinct = F.size(F.array_distinct(bare)) + emptied
    return F.try_divide(distinct.cast("double"), F.size(words).cast("double"))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text.contains(phrase)
    return hit


def first_non_empty(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))
