"""Label normalisation, n-grams, negation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import NEGATION_ALTERNATIVES

# Java's bare \w is ASCII-only; this class equals a Unicode word character.
WORD = r"\p{L}\p{N}_"
NEGATION = (
    r"(?iU)\b(no|not|without|don['’]?t)\s+([\w\s]{1,80}?)"
    r"(?=(?:,|;|\.|\band\b|\bbut\b|$))"
)
HAS_CUE = r"(?iU)\b(?:no|not|without|don['’]?t)\s"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    Higher-order functions re-evaluate whatever their lambda mentions, per
    element; a lambda variable is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace; the built-in trim removes only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_label(text: Column) -> Column:
    """Lower case, every run of non-word characters becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), f"[^{WORD}]+", " "))


def has_words(text: Column) -> Column:
    """Whether anything would be left after normalising; stops at the first word character."""
    return text.rlike(f"[{WORD}]")


def label_error(text: Column) -> Column:
    return F.when(~has_words(text), F.lit("Normalized label must not be empty"))


def split_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def tokens(text: Column) -> Column:
    return split_tokens(normalize_label(text))


def ngrams(token_array: Column, max_n: int = 3) -> Column:
    """All 1..max_n-grams, by size then position, duplicates kept."""
    def build(words: Column) -> Column:
        def longer(grams: Column, n: int) -> Column:
            """The n-grams followed by everything longer; each size extends the one before."""
            if n == max_n:
                return grams
            count = F.greatest(F.size(words) - n, F.lit(0))
            grown = F.zip_with(F.slice(grams, F.lit(1), count), F.slice(words, F.lit(n + 1), count),
                               lambda head, word: F.concat(head, F.lit(" "), word))
            return F.concat(grams, bind(grown, lambda g: longer(g, n + 1)))

        return longer(words, 1)

    return bind(token_array, build)


def token_windows(token_array: Column, width: int) -> Column:
    """One struct per token position holding that token and its followers.

    Exploding these emits one short row per token, whereas exploding the
    n-grams themselves would emit `width` times as many.
    """
    return bind(token_array, lambda words: F.arrays_zip(*[
        F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}")
        for k in range(width)
    ]))


def negation_phrases(text: Column) -> Column:
    """The phrase after each negation cue, in text order."""
    found = F.regexp_extract_all(text, F.lit(NEGATION), F.lit(2))
    return F.transform(found, strip)


def negation_matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NEGATION), F.lit(0))


def negation_replacement(phrase: Column, alternatives: Mapping[str, str] | None = None) -> Column:
    """Positive alternative for a negated phrase, null where there is none."""
    table = dict(NEGATION_ALTERNATIVES)
    table.update({k.lower(): v for k, v in (alternatives or {}).items() if v})
    choice = F.lit(None).cast("string")
    for keyword, value in reversed(list(table.items())):
        choice = F.when(F.contains(F.lower(phrase), F.lit(keyword.lower())), F.lit(value)).otherwise(choice)
    return choice


def rewrite_negations(text: Column, alternatives: Mapping[str, str] | None = None) -> Column:
    """Drop each cue and keep its phrase, or its positive alternative.

    The text between matches comes from a split on the same pattern, so each
    match is replaced where it stands and nowhere else.
    """
    def weave(raw: Column) -> Column:
        kept = F.zip_with(
            negation_matches(raw),
            negation_phrases(raw),
            lambda match, phrase: F.concat(
                F.coalesce(negation_replacement(phrase, alternatives), phrase),
                F.when(match.endswith(" "), F.lit(" ")).otherwise(F.lit("")),
            ),
        )
        between = F.split(raw, NEGATION, -1)
        return F.array_join(
            F.zip_with(between, kept, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")

    return F.when(text.rlike(HAS_CUE), bind(text, weave)).otherwise(text)


def alphabetic_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-zÀ-ÿ']+"), F.lit(0))
