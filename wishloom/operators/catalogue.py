"""Catalogue tables, synonym index and identifier lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_label, split_tokens, strip
from ..plans.scale import lookup_join


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty entries."""
    return F.filter(F.transform(values, strip), lambda v: v != "")


def synonym_index(catalogue: DataFrame) -> DataFrame:
    """(synonym, n_tokens, filter_id, option_id): label plus synonyms, distinct per option."""
    names = F.array_distinct(
        F.transform(
            F.concat(F.array("option_label"), F.coalesce("synonyms", F.array().cast("array<string>"))),
            normalize_label,
        )
    )
    return (
        catalogue.select("filter_id", "option_id", F.explode(names).alias("synonym"))
        .where(F.col("synonym") != "")
        .select("synonym", F.size(split_tokens(F.col("synonym"))).alias("n_tokens"),
                "filter_id", "option_id")
    )


def duplicate_options(catalogue: DataFrame) -> DataFrame:
    """Option ids that occur twice in a filter, case-insensitively."""
    return (
        catalogue.groupBy("filter_id", F.lower("option_id").alias("option_key"))
        .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """Ids or case-folded names used more than once, as (kind, value, copies)."""
    pairs = entities.select(F.explode(F.array(
        F.struct(F.lit("identifier").alias("kind"), F.trim(F.col("id")).alias("value")),
        F.struct(F.lit("name").alias("kind"), F.lower(F.trim(F.col("name"))).alias("value")),
    )).alias("e")).select("e.*")
    return pairs.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def missing_required(entities: DataFrame, required: list[str]) -> DataFrame:
    """Adds the list of required fields that are null or blank."""
    absent = F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required
    ]))
    return entities.withColumn("missing_fields", absent)


def locale_aliases(entries: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Explode (category, target, values[]) into aliases, unknown targets and conflicts.

    Aliases are lower-cased and blanks skipped. An alias that names two
    targets in one language is a conflict.
    """
    flat = entries.select("category", F.trim("target").alias("target_id"), F.explode("values").alias("v")).select(
        "category", "target_id", F.lower(F.trim("v.lang")).alias("lang"),
        F.lower(F.trim("v.value")).alias("alias")
    ).where("lang <> '' and alias <> ''")
    known = targets.select(F.col("id").alias("target_id"))
    aliases = lookup_join(flat, known, "target_id", "left_semi")
    unknown = lookup_join(flat, known, "target_id", "left_anti")
    conflicts = aliases.groupBy("category", "lang", "alias").agg(
        F.min("target_id").alias("first_target"), F.max("target_id").alias("last_target")
    ).where("first_target <> last_target")
    return aliases.distinct(), unknown, conflicts


def lookup_table(base: DataFrame, aliases: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, name, id, ord): base names in every language plus that language's aliases.

    An alias that equals a base name keeps the base position but points at the
    alias target.
    """
    langs = F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang")
    everywhere = base.select(langs, F.lower("name").alias("name"), "id", F.col("ord").cast("long").alias("ord"),
                             F.lit(0).alias("layer"))
    extra = aliases.select("lang", F.col("alias").alias("name"), F.col("target_id").alias("id"),
                           F.col("ord").cast("long").alias("ord"), F.lit(1).alias("layer"))
    both = everywhere.unionByName(extra.where(F.col("lang") != "en"))
    return both.groupBy("lang", "name").agg(
        F.max_by("id", F.struct("layer", "ord")).alias("id"),
        F.min(F.struct("layer", "ord"))["ord"].alias("ord"),
    )


def resolve_ids(df: DataFrame, entities: DataFrame, name: str, label: str = "entity") -> DataFrame:
    """Name to id, case-insensitive; unknown names become an error, not a lost row."""
    table = entities.select(F.lower(F.trim("name")).alias("_name"), F.col("id").alias("resolved_id"))
    joined = lookup_join(df.withColumn("_name", F.lower(F.trim(F.col(name)))), table, "_name", "left")
    return joined.withColumn(
        "lookup_error",
        F.when(F.col("resolved_id").isNull(),
               F.concat(F.lit(f"Unknown {label} '"), F.coalesce(F.col(name), F.lit("")), F.lit("'"))),
    ).drop("_name")
