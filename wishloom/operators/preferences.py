"""Mapping free text onto catalogue options."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.fixed_values import (NEGATION_PENALTY, RULES_THRESHOLD, SEMANTIC_THRESHOLD,
                                      SEMANTIC_TOP_K)
from ..functions.language import detect_language
from ..plans.scale import lookup_join, unnest
from .catalogue import synonym_index
from .similarity import keep_or_top_k

#: Synonyms of more words never match.
MAX_NGRAM = 3


def synonym_matches(
    texts: DataFrame, synonyms: DataFrame, key: str, text: str = "text", max_ngram: int = 3
) -> DataFrame:
    """(key, synonym): one row per occurrence of an indexed n-gram.

    One short row per token is joined on the token that opens a synonym; the
    remaining words are compared in the join. Synonyms longer than max_ngram
    can never match and are left out.
    """
    positions = texts.select(
        key, F.inline(tx.token_windows(tx.tokens(F.col(text)), max_ngram))
    ).toDF(key, *[f"w{i}" for i in range(max_ngram)])
    return lookup_join(positions, _openings(synonyms, max_ngram), "w0").where(_goes_on(max_ngram)).select(key, "synonym")


def _openings(synonyms: DataFrame, max_ngram: int) -> DataFrame:
    """Synonyms by the word that opens them, with the words that follow."""
    words = F.split("synonym", " ")
    return (
        synonyms.select("synonym").distinct().where(F.size(words) <= max_ngram)
        .select("synonym", *[F.get(words, F.lit(i)).alias(f"s{i}") for i in range(max_ngram)])
        .withColumnRenamed("s0", "w0")
    )


def _goes_on(max_ngram: int) -> Column:
    """Whether the words after an opening one are those of the synonym."""
    rest = F.lit(True)
    for i in range(1, max_ngram):
        rest = rest & (F.col(f"s{i}").isNull() | F.coalesce(F.col(f"s{i}") == F.col(f"w{i}"), F.lit(False)))
    return rest


def _spoken(texts: DataFrame, key: str, text: str, max_ngram: int) -> DataFrame:
    """One row per token of the rewritten text, with its followers, and one per negated phrase, from one reading of the texts."""
    none = F.lit(None).cast("string")

    def row(words: list[Column], phrase: Column, blocked: Column, negated: Column) -> Column:
        return F.struct(*[w.alias(f"w{i}") for i, w in enumerate(words)], phrase.alias("phrase"), blocked.cast("int").alias("blocked"),
                        negated.cast("int").alias("negated"))

    def mark(phrase: Column) -> Column:
        swap = tx.negation_replacement(phrase)
        return tx.bind(tx.normalize_label(F.coalesce(swap, phrase)), lambda label: row(
            [F.get(F.split(label, " "), F.lit(0)), *[none] * (max_ngram - 1)], label, swap.isNull(), swap.isNotNull()))

    windows = tx.token_windows(tx.tokens(tx.rewrite_negations(F.col(text))), max_ngram)
    said = F.transform(windows, lambda w: row([w[f"w{i}"] for i in range(max_ngram)], none, F.lit(0), F.lit(0)))
    marks = F.transform(tx.negation_phrases(F.col(text)), mark)
    rows = texts.select(key, F.when(F.col(text).rlike(tx.HAS_CUE), F.concat(said, marks)).otherwise(said).alias("_rows"))
    return unnest(rows, "_rows", key)


def synonym_hits(texts: DataFrame, synonyms: DataFrame, key: str, text: str = "text", max_ngram: int = 3) -> DataFrame:
    """(key, synonym, hits). Counts combine map-side, so neither a stop word nor
    a long text moves more than its distinct hits."""
    return synonym_matches(texts, synonyms, key, text, max_ngram).groupBy(key, "synonym").agg(
        F.count(F.lit(1)).alias("hits"))


def negation_marks(texts: DataFrame, synonyms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, synonym, blocked, negated): negated phrases and replacements that are synonyms."""
    spans = texts.where(F.col(text).rlike(tx.HAS_CUE)).select(
        key, F.explode(tx.negation_phrases(F.col(text))).alias("_phrase"))
    swap = tx.negation_replacement(F.col("_phrase"))
    marks = spans.select(
        key, tx.normalize_label(F.coalesce(swap, F.col("_phrase"))).alias("synonym"),
        swap.isNull().cast("int").alias("blocked"), swap.isNotNull().cast("int").alias("negated"))
    return lookup_join(marks, synonyms.select("synonym").distinct(), "synonym", "left_semi")


def confidence(hits: Column, length_sum: Column, negated_hits: Column,
               penalty: float = NEGATION_PENALTY) -> Column:
    """0.35 + 0.4*length + 0.25*frequency - penalty, clamped to [0, 1]."""
    length_bonus = F.least(length_sum / hits / 3.0, F.lit(1.0))
    frequency_bonus = F.least(hits / 2.0, F.lit(1.0))
    raw = F.lit(0.35) + 0.4 * length_bonus + 0.25 * frequency_bonus - F.lit(penalty) * negated_hits
    return F.when(hits > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))


def map_by_rules(
    texts: DataFrame, catalogue: DataFrame, key: str, text: str = "text",
    threshold: float = RULES_THRESHOLD, penalty: float = NEGATION_PENALTY,
) -> DataFrame:
    """One row per (text, option) with hits, confidence, blocked and selected."""
    index = synonym_index(catalogue)
    met = lookup_join(_spoken(texts, key, text, MAX_NGRAM), _openings(index, MAX_NGRAM), "w0").where(
        F.when(F.col("phrase").isNull(), _goes_on(MAX_NGRAM)).otherwise(F.col("phrase") == F.col("synonym")))
    per_synonym = (
        met.groupBy(key, "synonym")
        .agg(F.count_if(F.col("phrase").isNull()).alias("hits"), F.max("blocked").alias("blocked"), F.max("negated").alias("negated"))
        .where("hits > 0")
    )
    per_option = lookup_join(per_synonym, index, "synonym").groupBy(key, "filter_id", "option_id").agg(
        F.sum("hits").alias("hits"),
        F.sum(F.col("hits") * F.col("n_tokens")).alias("length_sum"),
        F.sum(F.col("hits") * F.col("negated")).alias("negated_hits"),
        (F.max("blocked") == 1).alias("blocked"),
        F.array_sort(F.collect_set("synonym")).alias("spans"),
    )
    limit = max(0.0, min(1.0, threshold))
    score = confidence(F.col("hits"), F.col("length_sum"), F.col("negated_hits"), max(0.0, penalty))
    return per_option.withColumn("confidence", score).withColumn(
        "selected", (F.col("confidence") >= limit) & ~F.col("blocked"))


def map_every_text(
    texts: DataFrame, catalogue: DataFrame, key: str, text: str = "text", vector: str = "embedding", **options,
) -> DataFrame:
    """map_by_meaning with a row for every text: those that cannot be mapped say why.

    Adds status: mapped, no-words (nothing to map) or no-vector (the text has
    no embedding); rows of the last two hold the key and the status alone. A catalogue without options maps nothing.
    """
    wordless = ~F.coalesce(tx.has_words(tx.rewrite_negations(F.col(text))), F.lit(False))
    state = F.when(wordless, "no-words").when(F.coalesce(F.size(vector), F.lit(0)) <= 0, "no-vector").otherwise("mapped")
    judged = texts.withColumn("status", state)
    mapped = map_by_meaning(judged.where("status = 'mapped'").drop("status"), catalogue, key, text, vector, **options).withColumn("status", F.lit("mapped"))
    return mapped.unionByName(judged.where("status <> 'mapped'").select(key, "status"), allowMissingColumns=True)


def map_by_meaning(
    texts: DataFrame, catalogue: DataFrame, key: str, text: str = "text", vector: str = "embedding",
    threshold: float = SEMANTIC_THRESHOLD, top_k: int = SEMANTIC_TOP_K, penalty: float = NEGATION_PENALTY,
) -> DataFrame:
    """Embedding mapper; `catalogue` carries option_ord and a `centroid` column."""
    usable = texts.where(tx.has_words(tx.rewrite_negations(F.col(text))))
    wide = catalogue.withColumn("option_key", F.concat_ws("\u0001", "filter_id", "option_id"))
    kept = keep_or_top_k(usable, wide, key, threshold, top_k, vector=vector, option="option_key")
    names = wide.select(F.col("option_key").alias("option_id_"), "filter_id", "option_id")
    kept = lookup_join(kept.withColumnRenamed("option_id", "option_id_"), names, "option_id_").drop("option_id_")
    index = synonym_index(catalogue)
    marks = lookup_join(negation_marks(usable, index, key, text), index, "synonym").groupBy(
        key, "filter_id", "option_id").agg(F.max("blocked").alias("b"), F.max("negated").alias("n"))
    joined = kept.join(marks, [key, "filter_id", "option_id"], "left").na.fill(0, ["b", "n"])
    return joined.select(
        key, "filter_id", "option_id", "similarity", "similarity_rank",
        F.greatest(F.lit(0.0), F.col("similarity") - penalty * (F.col("b") + F.col("n"))).alias("confidence"),
        (F.col("b") == 1).alias("blocked"),
        ((F.col("similarity") >= threshold) & (F.col("b") == 0)).alias("selected"),
    )


def map_by_kind(texts: DataFrame, catalogue: DataFrame, key: str, kind: str = "kind", text: str = "text",
                **params) -> DataFrame:
    """Rules, llm, hybrid and unknown kinds share the rules mapper; semantic rows are left out.

    Route rows of kind `semantic` to map_by_meaning, which needs vectors.
    """
    routed = texts.where(F.coalesce(F.col(kind), F.lit("rules")) != "semantic")
    mapped = map_by_rules(routed, catalogue, key, text, **params)
    return mapped.join(routed.select(key, kind), key)


def nest_selections(mapped: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Flat options to array<filter<option>>; sizes are bounded by the catalogue."""
    labels = catalogue.select("filter_id", "option_id", "filter_label", "option_label", "filter_ord", "option_ord")
    full = lookup_join(mapped, labels, ["filter_id", "option_id"])
    per_filter = full.groupBy(key, "filter_id", "filter_label").agg(
        F.min("filter_ord").alias("filter_ord"),
        F.array_sort(F.collect_list(F.struct("option_ord", "option_id", "option_label", "selected", "confidence")))
        .alias("options"))
    return per_filter.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("filter_ord", "filter_id", "filter_label", "options"))).alias("filters"))


def run_preferences(
    texts: DataFrame, catalogue: DataFrame, key: str, text: str = "text",
    allowed: Iterable[str] = ("en",), **params,
) -> DataFrame:
    """Language gate, rules mapping and run status, one row per input text."""
    detected = detect_language(texts, text, allowed)
    passed = detected.where(F.col("language_error").isNull())
    mapped = map_by_rules(passed.select(key, text), catalogue, key, text, **params)
    counts = mapped.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_options"), F.count_if("selected").alias("n_selected"))
    status = (
        F.when(F.col("language_error").isNotNull(), "error")
        .when(~tx.has_words(tx.rewrite_negations(F.col(text))), "invalid-catalogue")
        .when(F.coalesce("n_options", F.lit(0)) > 0, "success")
        .otherwise("no-preferences-detected")
    )
    return detected.join(counts, key, "left").select(
        key, "language", "confidence", "language_error", status.alias("status"),
        F.coalesce("n_options", F.lit(0)).alias("n_options"),
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"))


def display_status(status: Column) -> tuple[Column, Column]:
    """Run status to (shown status, reason)."""
    shown = F.when(status.isin("no-preferences-detected", "invalid-catalogue"), F.lit("failed")).otherwise(status)
    return shown, F.when(status.isin("no-preferences-detected", "invalid-catalogue"), status)
