"""Gazetteer, duration, flexibility and date extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..plans.scale import lookup_join, settle, unnest

MONTH = ("(?:January|February|March|April|May|June|July|August|September|October|November|December"
         "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)")
# closed date grammar: ISO, dd-MM-yyyy, `d Month yyyy`, `Month d, yyyy`
DATE_PHRASE = (rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}-\d{{2}}-\d{{4}}"
               rf"|\d{{1,2}}\s+{MONTH}\s+\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}})(?![\p{{L}}\p{{N}}_])")

#: Stands for a word boundary in marked texts.
EDGE = "\x01"


def word_key(name: Column) -> Column:
    """Words of a name as indexed for candidate search."""
    return tx.normalize_label(name)


def mark_words(text: Column) -> Column:
    """Text with a mark at every word boundary."""
    return F.regexp_replace(F.replace(text, F.lit(EDGE), F.lit(" ")), r"(?U)\b", EDGE)


def edged(name: Column) -> Column:
    """A name as it stands in a marked text where it begins and ends at word boundaries."""
    return F.concat(F.lit(EDGE), F.trim(mark_words(name), F.lit(EDGE)), F.lit(EDGE))


def locate_entities(requests: DataFrame, lookup: DataFrame, key: str = "request_id", text: str = "text",
                    lang: str = "lang", languages: list[str] | None = None) -> DataFrame:
    """Adds `found`: entities named in each request as whole words, in dictionary order.

    lookup: (lang, name, id, ord) plus any columns to carry, such as kind. A
    language without its own dictionary uses English. Candidates come from an
    equi-join of the opening word; the exact name is then looked for between
    word boundaries, and the first alias of an entity decides its place. Names
    and texts carry a mark at every word boundary, so that is a plain search
    and no pattern is built per row. Only (request, word) rows are exploded, so
    the text itself moves once, and the candidates of a request are bounded by
    the gazetteer.
    """
    known = lookup.select(F.col("lang").alias("_lang")).distinct()
    if languages:
        known = known.where(F.col("_lang").isin(languages))
    asked = requests.withColumn("_lang", F.lower(F.coalesce(F.col(lang), F.lit("en"))))
    spoken = lookup_join(asked, known.withColumn("_known", F.lit(True)), "_lang", "left")
    carried = [c for c in lookup.columns if c not in ("lang", "ord", "id", "name")]
    entry = F.struct("ord", "id", *carried, F.col("name").alias("_name"), edged(F.col("name")).alias("_edged"))
    names = lookup.select(
        F.col("lang").alias("_lang"), F.get(F.split(word_key(F.col("name")), " "), F.lit(0)).alias("_w"),
        entry.alias("_e")).where("_w <> ''")
    words = spoken.select(F.col(key), F.when(F.col("_known"), F.col("_lang")).otherwise("en").alias("_lang"),
                          F.explode(F.array_distinct(tx.tokens(F.col(text)))).alias("_w"))
    candidates = lookup_join(words, names, ["_lang", "_w"]).groupBy(key).agg(F.collect_set("_e").alias("_c"))

    def same(c):
        return F.struct("id", *carried) if c is None else F.struct(c["id"].alias("id"), *[c[x].alias(x) for x in carried])

    def first_only(sorted_entries):
        owners = F.transform(sorted_entries, lambda c: same(c))
        return F.filter(sorted_entries, lambda c, i: F.array_position(owners, same(c)) == i + 1)

    joined = requests.join(candidates, key, "left")
    hits = tx.bind(mark_words(F.lower(F.col(text))), lambda low: F.filter("_c", lambda c: F.contains(low, c["_edged"])))
    shown = lambda kept: F.transform(kept, lambda c: c.dropFields("_edged"))
    return joined.withColumn("found", F.when(F.col("_c").isNotNull(), shown(tx.bind(F.array_sort(hits), first_only)))).drop("_c")


def match_entities(requests: DataFrame, lookup: DataFrame, key: str = "request_id", **options) -> DataFrame:
    """locate_entities as one row per (request, entity): key, id, ord and carried columns."""
    return unnest(locate_entities(requests, lookup, key, **options), "found", key).drop("_name")


def first_contained(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Id of the first (name, id) whose name occurs anywhere in the text."""
    lowered, choice = F.lower(text), F.lit(None).cast("string")
    for name, identifier in reversed(pairs):
        choice = F.when(F.contains(lowered, F.lit(name.lower())), F.lit(identifier)).otherwise(choice)
    return choice


def by_language(lang: Column, tables: dict[str, list[tuple[str, str]]], text: Column) -> Column:
    """first_contained with a table per language; unknown languages use `en`."""
    choice = first_contained(text, tables["en"])
    for code, pairs in tables.items():
        if code != "en":
            choice = F.when(F.lower(lang) == code, first_contained(text, pairs)).otherwise(choice)
    return choice


def value_tables(base: list[tuple[str, str]], aliases: dict[str, list[tuple[str, str]]] | None = None,
                 extra_en: list[tuple[str, str]] = ()) -> dict[str, list[tuple[str, str]]]:
    """Per language: base names first, then that language's aliases of base names."""
    ids = {name.lower(): identifier for identifier, name in base}
    plain = [(name.lower(), identifier) for identifier, name in base]
    tables = {"en": plain + [(a, ids[t.lower()]) for a, t in extra_en if t.lower() in ids]}
    for code, pairs in (aliases or {}).items():
        tables[code.lower()] = plain + [(a.lower(), ids[t.lower()]) for a, t in pairs if t.lower() in ids]
    return tables


def duration_id(text: Column, lang: Column | None = None, aliases=None) -> Column:
    tables = value_tables(fv.DURATIONS, aliases, fv.DURATION_ALIASES_EN)
    return by_language(lang if lang is not None else F.lit("en"), tables, text)


def flexibility_id(text: Column, lang: Column | None = None, aliases=None) -> Column:
    return by_language(lang if lang is not None else F.lit("en"), value_tables(fv.FLEXIBILITY, aliases), text)


def parse_date(phrase: Column) -> Column:
    plain = F.regexp_replace(F.replace(phrase, F.lit(","), F.lit(" ")), r"\s+", " ")
    titled = F.initcap(plain)

    def first_of(*formats):
        return F.coalesce(*[F.try_to_timestamp(titled, F.lit(f)) for f in formats])

    # a format that does not fit costs an exception, so only those of the phrase's shape are tried
    return (F.when(F.contains(plain, F.lit("-")), first_of("yyyy-MM-dd", "dd-MM-yyyy"))
            .when(F.substring(plain, 1, 1).between("0", "9"), first_of("d MMMM yyyy", "d MMM yyyy"))
            .otherwise(first_of("MMMM d yyyy", "MMM d yyyy")))


def dates(text: Column) -> Column:
    """array<struct<phrase, at>> in text order; unparseable phrases are dropped."""
    found = F.transform(F.regexp_extract_all(text, F.lit(DATE_PHRASE), F.lit(0)),
                        lambda p: F.struct(p.alias("phrase"), parse_date(p).alias("at")))
    return F.filter(found, lambda d: d["at"].isNotNull())


def detailed_lookup(lookup: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Dictionary rows with the entity they stand for."""
    detail = entities.select("id", F.col("name").alias("label"), "type", "available")
    return lookup_join(lookup, detail, "id").withColumn("kind", F.lit(kind))


def extract(requests: DataFrame, lookup: DataFrame, languages: list[str], duration_aliases=None, flex_aliases=None,
            key: str = "request_id") -> DataFrame:
    """Rule extraction: airports, destinations, duration_id, flex_id, dates.

    lookup: detailed_lookup of every kind (airport, destination) in one frame,
    so that both gazetteers are matched in one pass over the text.
    """
    located = locate_entities(requests, lookup, key, languages=languages)

    def of_kind(kind):
        mine = F.filter(F.coalesce("found", F.array()), lambda e: e["kind"] == kind)
        return F.transform(mine, lambda e: F.struct(
            e["id"].alias("id"), e["label"].alias("name"), e["type"].alias("type"), e["available"].alias("available")))

    return located.withColumns({
        "airports": of_kind("airport"), "destinations": of_kind("destination"),
        "duration_id": duration_id(F.col("text"), F.col("lang"), duration_aliases),
        "flex_id": flexibility_id(F.col("text"), F.col("lang"), flex_aliases), "dates": dates(F.col("text"))}).drop("found")


def recognised(df: DataFrame) -> DataFrame:
    """Adds ids and ISO dates of what was found, as plain lists."""
    ids = lambda c: F.filter(F.transform(c, lambda e: F.trim(F.coalesce(e["id"], e["name"], F.lit("")))), lambda v: v != "")
    return df.withColumns({
        "recognised_airports": ids("airports"), "recognised_destinations": ids("destinations"),
        "recognised_dates": F.transform("dates", lambda d: F.date_format(d["at"], "yyyy-MM-dd'T'HH:mm:ss")),
    })


MODEL_META = ["provider", "engine", "model", "promptId", "responseId", "requestId", "traceId"]


def read_model_responses(df: DataFrame, body: str = "body", key: str = "request_id") -> DataFrame:
    """Stored model responses to typed fields; malformed ones carry `response_error`.

    Both envelopes are read: choices[0].message.content and
    candidates[0].content.parts[0]. An airport or destination is an id, which the
    gazetteer must know (airport_listed, destination_listed), or an object that
    stands for itself and gives its id.
    """
    outer = F.try_parse_json(F.col(body))
    message = F.coalesce(
        F.try_variant_get(outer, "$.choices[0].message.content", "string"),
        F.try_variant_get(outer, "$.candidates[0].content.parts[0].text", "string"),
        F.try_variant_get(outer, "$.candidates[0].content.parts[0]", "string"))
    staged = df.withColumn("_inner", F.try_parse_json(message))
    inner = F.col("_inner")
    # an entry is a plain string or an object that holds the date under one of three names
    entries = F.try_variant_get(inner, "$.dates", "array<variant>")
    iso = F.transform(entries, lambda d: F.coalesce(
        *[F.try_variant_get(d, f"$.{k}", "string") for k in ("iso", "value", "date")], F.try_variant_get(d, "$", "string")))
    first_id = lambda path: F.coalesce(F.try_variant_get(inner, f"{path}.id", "string"),
                                       F.try_variant_get(inner, path, "string"))
    # the embedded block wins over top-level fields of the same name
    meta = F.to_json(F.struct(*[F.coalesce(
        F.try_variant_get(inner, f"$.llm.{k}", "string"), F.try_variant_get(inner, f"$.meta.{k}", "string"),
        F.try_variant_get(inner, f"$.metadata.{k}", "string"), F.try_variant_get(inner, f"$._metadata.{k}", "string"),
        F.nullif(F.try_variant_get(inner, f"$.{k}", "string"), F.lit(""))).alias(k) for k in MODEL_META]))
    holds_object = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")
    is_object = holds_object(inner)

    def places(path):
        found = F.coalesce(F.try_variant_get(inner, path, "array<variant>"), F.array().cast("array<variant>"))
        return F.filter(F.transform(found, lambda v: F.struct(
            F.when(holds_object(v), F.try_variant_get(v, "$.id", "string")).otherwise(F.try_variant_get(v, "$", "string")).alias("id"),
            holds_object(v).alias("given"))), lambda e: e["id"].isNotNull())

    ids = lambda entries: F.transform(entries, lambda e: e["id"])
    listed = lambda entries: ids(F.filter(entries, lambda e: ~e["given"]))
    out = staged.withColumns({"_airports": places("$.airports"), "_destinations": places("$.destinations")}).withColumns({
        "airport_ids": ids(F.col("_airports")), "destination_ids": ids(F.col("_destinations")),
        "airport_listed": listed(F.col("_airports")), "destination_listed": listed(F.col("_destinations")),
        "duration_id": first_id("$.duration"), "flex_id": first_id("$.flexibility"),
        "iso_dates": F.coalesce(iso, F.array().cast("array<string>")), "response_meta": meta,
    })
    bad_date = F.get(F.filter("iso_dates", lambda d: d.try_cast("timestamp").isNull()), F.lit(0))
    error = (F.when(inner.isNull() | ~is_object, F.lit("Model response must be an object"))
             .when(bad_date.isNotNull(), F.concat(F.lit("Model returned invalid ISO date '"), bad_date, F.lit("'"))))
    return out.withColumn("response_error", error).drop("_inner", "_airports", "_destinations")


def places_of(df: DataFrame, ids: str, entities: DataFrame, out: str, key: str = "request_id", upper: bool = False,
              lists: DataFrame | None = None) -> DataFrame:
    """Adds `out`: the entities that the ids name, in the order of the list; an unknown id stands for itself.

    `lists` is a settled frame with the same lists; without it `df` is computed twice.
    """
    listed = (df if lists is None else lists).select(key, F.posexplode(ids).alias("pos", "raw")).withColumn("id", F.upper("raw") if upper else F.trim("raw"))
    found = lookup_join(listed, entities.select("id", "name", "type", "available", F.lit(True).alias("_known")), "id", "left")
    place = F.struct("id", F.coalesce("name", "raw").alias("name"), F.coalesce("type", F.lit("")).alias("type"),
                     F.when(F.col("_known"), F.col("available")).otherwise(True).alias("available"))
    grouped = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", place.alias("p")))), lambda e: e["p"]).alias(out))
    none = F.array().cast("array<struct<id:string,name:string,type:string,available:boolean>>")
    return df.join(grouped, key, "left").withColumn(out, F.coalesce(out, none))


def model_extraction(read: DataFrame, airports: DataFrame, destinations: DataFrame, key: str = "request_id") -> DataFrame:
    """Stored model responses in the shape of a rule extraction, with `response_error` where one can't be used.

    The responses are read once; every list of ids is taken from what was read.
    """
    read = settle(read.select(key, "airport_ids", "destination_ids", "airport_listed", "destination_listed", "iso_dates", "duration_id",
                              "flex_id", "response_error"))
    checked = check_known_ids(read, "airport_listed", airports, "departure airport", key, upper=True, lists=read)
    checked = check_known_ids(checked, "destination_listed", destinations, "destination", key, lists=read)
    placed = places_of(checked, "airport_ids", airports, "airports", key, upper=True, lists=read)
    placed = places_of(placed, "destination_ids", destinations, "destinations", key, lists=read)
    found = F.transform("iso_dates", lambda d: F.struct(d.alias("phrase"), d.try_cast("timestamp").alias("at")))
    return placed.select(key, "airports", "destinations", found.alias("dates"), "duration_id", "flex_id", "response_error")


def check_known_ids(df: DataFrame, ids: str, entities: DataFrame, label: str, key: str = "request_id",
                    upper: bool = False, lists: DataFrame | None = None) -> DataFrame:
    """Adds an error for the first listed id that the gazetteer does not hold; `lists` as in `places_of`."""
    listed = (df if lists is None else lists).select(key, F.posexplode(ids).alias("pos", "raw")).withColumn(
        "id", F.upper("raw") if upper else F.trim("raw"))
    unknown = lookup_join(listed, entities.select("id"), "id", "left_anti").groupBy(key).agg(
        F.min_by("raw", "pos").alias("_bad"))
    message = F.concat(F.lit(f"Unknown {label} '"), F.col("_bad"), F.lit("' returned by model"))
    return df.join(unknown, key, "left").withColumn(
        "response_error", F.coalesce("response_error", message)).drop("_bad")
