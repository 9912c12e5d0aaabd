"""Stop-word language scoring, choice and gate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import ASCII_RATIO_FOR_ENGLISH, STOPWORDS
from .text import alphabetic_tokens

NO_DETECTION = "Unable to detect language from utterance"


def profile_hits(token_array: Column, language: str) -> Column:
    return F.size(F.filter(token_array, lambda t: t.isin(STOPWORDS[language])))


def ascii_letter_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.try_divide(F.regexp_count(text, F.lit("[A-Za-z]")), letters)


def score_languages(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_tokens and one score_<lang> per profile (hits / tokens)."""
    staged = df.withColumn("_tokens", alphabetic_tokens(F.col(text)))
    scores = {
        f"score_{lang}": F.coalesce(
            F.try_divide(profile_hits(F.col("_tokens"), lang), F.size("_tokens")), F.lit(0.0)
        )
        for lang in STOPWORDS
    }
    return staged.withColumns({"n_tokens": F.size("_tokens"), **scores}).drop("_tokens")


def detect_language(df: DataFrame, text: str = "text", allowed: Iterable[str] = ("en",)) -> DataFrame:
    """Adds language, confidence and language_error; no row is dropped."""
    permitted = [lang for lang in STOPWORDS if lang in {a.lower() for a in allowed}]
    scored = score_languages(df, text)
    best_any = _best(list(STOPWORDS))
    if permitted:
        best = _best(permitted)
        total = sum((F.col(f"score_{lang}") for lang in permitted), F.lit(0.0))
    else:
        best, total = F.lit(None).cast("string"), F.lit(0.0)
    best_score = F.greatest(*[F.col(f"score_{lang}") for lang in permitted], F.lit(0.0))
    any_hit = F.greatest(*[F.col(f"score_{lang}") for lang in STOPWORDS]) > 0
    ratio = F.coalesce(ascii_letter_ratio(F.col(text)), F.lit(0.0))
    english = F.lit("en" in permitted) & (ratio >= ASCII_RATIO_FOR_ENGLISH)
    has_tokens = F.col("n_tokens") > 0
    return scored.withColumns({
        "language": F.when(total > 0, best).when(has_tokens & ~any_hit & english, F.lit("en")),
        "confidence": F.when(total > 0, best_score / total).when(has_tokens & ~any_hit & english, ratio),
        "language_error": F.when(~has_tokens, F.lit(NO_DETECTION))
        .when(total > 0, F.lit(None).cast("string"))
        .when(any_hit, F.concat(F.lit("Detected language '"), best_any, F.lit("' is not permitted")))
        .when(~english, F.lit(NO_DETECTION)),
    })


def _best(languages: list[str]) -> Column:
    """First language in profile order that reaches the top score."""
    top = F.greatest(*[F.col(f"score_{lang}") for lang in languages], F.lit(0.0))
    choice = F.lit(None).cast("string")
    for lang in reversed(languages):
        choice = F.when(F.col(f"score_{lang}") == top, F.lit(lang)).otherwise(choice)
    return choice


def allow_list_error(code: Column, allowed: Iterable[str]) -> Column:
    """Gate for an already known language code; null when it passes."""
    names = sorted({a.lower() for a in allowed})
    return F.when(
        ~F.lower(code).isin(names) | code.isNull(),
        F.concat(F.lit("Detected language '"), F.coalesce(code, F.lit("")), F.lit("' is not permitted")),
    )


def language_summary(code: Column, confidence: Column) -> Column:
    """`en (0.93)`."""
    return F.format_string("%s (%.2f)", code, confidence.cast("double"))
