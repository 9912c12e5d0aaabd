"""Building and checking labelled datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..plans.scale import global_position, lookup_join, settle
from .catalogue import clean_list


def hash_order(seed: int | str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sanitise_synonyms(filter_id: Column, synonyms: Column, max_synonyms: int) -> Column:
    """struct<synonyms, empties, codes, duplicates>.

    Entries after the one that fills the list are not looked at, so they do
    not count as removed.
    """
    whitelist = "|".join(fv.CODE_WHITELIST)
    code = rf"\b(?!(?:{whitelist})\b)[A-Z]{{2,4}}\b"
    is_code_filter = filter_id.isin(fv.CODE_FILTER_IDS)

    def step(state, raw):
        t = F.trim(raw)
        full = F.size(state["kept"]) >= max_synonyms
        empty = F.coalesce(t, F.lit("")) == ""
        coded = ~empty & is_code_filter & F.coalesce(t.rlike(code), F.lit(False))
        known = F.array_contains(state["kept"], F.lower(F.coalesce(t, F.lit(""))))
        plus = lambda name, c: F.when(~full & c, state[name] + 1).otherwise(state[name])
        return F.struct(
            F.when(full | empty | coded | known, state["kept"]).otherwise(F.concat(state["kept"], F.array(F.lower(t)))).alias("kept"),
            plus("empties", empty).alias("empties"), plus("codes", coded).alias("codes"),
            plus("duplicates", ~empty & ~coded & known).alias("duplicates"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("empties"), F.lit(0).alias("codes"),
                     F.lit(0).alias("duplicates"))
    return F.aggregate(synonyms, start, step)


def sanitise_note(result: Column) -> Column:
    """`removed=3 (duplicates=2, empties=1)` or null."""
    names = ["duplicates", "codes", "empties"]
    total = sum((result[n] for n in names), F.lit(0))
    parts = F.array_compact(F.array(*[
        F.when(result[n] > 0, F.concat(F.lit(f"{n}="), result[n].cast("string"))) for n in names]))
    return F.when(total > 0, F.concat(F.lit("removed="), total.cast("string"), F.lit(" ("), F.array_join(parts, ", "), F.lit(")")))


def option_combinations(options: DataFrame, total: int, seed: int = 13, weights: dict[int, float] | None = None,
                        neighbours: int = 8, allow_same_filter: bool = False,
                        single_option_filters: Sequence[str] = ()) -> DataFrame:
    """Distinct option sets of 2-4 options from different filters.

    With allow_same_filter a filter may repeat unless it is listed in
    single_option_filters.

    options: option_id, filter_id. Each size gets round(total * weight) sets.
    Every option is an anchor and meets hash-chosen partners by an equi-join on
    slots, `neighbours` in the first round and twice as many in each further
    one, so work grows with options * draws and not with their product. Rounds
    go on until every size has its sets, or two rounds in a row find no new
    one. Sets are taken by round, then hash order. What a size cannot fill
    goes to the others as far as they have sets. Returns size, combo_key,
    option_ids.
    """
    weights = weights or fv.COMBINATION_WEIGHTS
    slots = settle(slot_table(options, seed))
    n = slots.count()
    none = slots.select(F.lit(2).alias("size"), F.lit("").alias("combo_key"), F.array("option_id").alias("option_ids")).where(F.lit(False))
    if n < 2:
        return none
    wanted = {size: int(total * w + 0.5) for size, w in sorted(weights.items())}

    def draw(start: int, count: int, number: int) -> DataFrame:
        sets = slots.select(F.col("slot").alias("anchor"), F.array("option_id").alias("option_ids"), F.array("filter_id").alias("filter_ids"),
                            F.explode(F.sequence(F.lit(start), F.lit(start + count - 1))).alias("draw"))
        found = none.withColumn("round", F.lit(number))
        for size in range(2, max(weights) + 1):
            pick = F.conv(F.substring(hash_order(seed, F.lit(size), F.col("anchor"), F.col("draw")), 1, 8), 16, 10).cast("long") % n
            fresh = ~F.array_contains("filter_ids", F.col("filter_id"))
            if allow_same_filter:
                fresh = ~F.array_contains("option_ids", F.col("option_id")) & (
                    fresh | ~F.col("filter_id").isin(list(single_option_filters)))
            met = lookup_join(sets.withColumn("slot", pick), slots, "slot").where(fresh)
            sets = met.select("anchor", "draw", F.array_sort(F.concat("option_ids", F.array("option_id"))).alias("option_ids"),
                              F.concat("filter_ids", F.array("filter_id")).alias("filter_ids"))
            if size in weights:
                found = found.union(sets.select(F.lit(size).alias("size"), F.array_join("option_ids", "+").alias("combo_key"), "option_ids",
                                                F.lit(number).alias("round")).dropDuplicates(["combo_key"]))
        return found

    found, have, start, idle, number = None, {}, 0, 0, 0
    while idle < 2 and (found is None or any(have.get(size, 0) < quota for size, quota in wanted.items())):
        count = neighbours * 2**number
        new = draw(start, count, number)
        found = settle(new if found is None else found.union(new.join(found.select("combo_key"), "combo_key", "left_anti").select(new.columns)))
        before, have = sum(have.values()), {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}
        idle = idle + 1 if sum(have.values()) == before else 0
        start, number = start + count, number + 1
    quota = {size: min(q, have.get(size, 0)) for size, q in wanted.items()}
    for size in quota:
        quota[size] += min(max(0, sum(wanted.values()) - sum(quota.values())), have.get(size, 0) - quota[size])
    out = none
    for size, q in quota.items():
        out = out.union(found.where(F.col("size") == size).orderBy("round", hash_order(seed, F.col("combo_key")), "combo_key").limit(q).select(
            "size", "combo_key", "option_ids"))
    return out


def slot_table(options: DataFrame, seed: int) -> DataFrame:
    """Distinct options with a dense slot number in hash order."""
    keyed = options.select("option_id", "filter_id").dropDuplicates(["option_id"]).withColumn("_h", hash_order(seed, F.col("option_id")))
    return global_position(keyed, ["_h", "option_id"], name="slot").select("slot", "option_id", "filter_id")


def sample_options(df: DataFrame, key: str, order: str, n: int | None, seed: int = 13) -> DataFrame:
    """n distinct keys in hash order, first row per key; n missing or <= 0 keeps all rows."""
    if n is None or n <= 0:
        return df
    named = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    first = named.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")
    return first.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows in hash order; n <= 0 gives none."""
    if n <= 0:
        return df.where(F.lit(False))
    return df.orderBy(hash_order(seed, *[F.col(k) for k in key]), *key).limit(n)


def single_utterances(results: DataFrame) -> DataFrame:
    """Result entries with utterances[] to one trimmed row per utterance."""
    return results.select(
        *[F.trim(c).alias(c) for c in ("filter_id", "filter_name", "option_id", "option_name")],
        F.explode("utterances").alias("_u")).withColumn("utterance", F.trim("_u.utterance")).drop("_u").where("utterance <> ''")


def multi_rows(combos: DataFrame) -> DataFrame:
    """Combos with matched[] to one row per matched option."""
    return combos.where(F.trim("utterance") != "").select(F.trim("utterance").alias("utterance"), F.explode("matched").alias("m")).select(
        "utterance", *[F.trim(f"m.{c}").alias(c) for c in ("filter_id", "filter_name", "option_id", "option_name")])


def batches(df: DataFrame, order: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-size batch numbers in input order, without a window."""
    return global_position(df, [order], by, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def batches_by_distinct_options(df: DataFrame, order: str, option_ids: str, cap: int, by: Sequence[str]) -> DataFrame:
    """Greedy batches holding at most `cap` distinct option ids, per group.

    A batch depends on all rows before it, so a group is scanned in order;
    `by` names the groups and thereby how far the work spreads. The scan
    streams sorted rows and holds one batch's ids. Rows without ids drop.
    Adds batch, from 0 in every group.
    """
    import pandas as pd

    by = list(by)
    rows = df.where(F.size(option_ids) > 0).repartition(*by).sortWithinPartitions(*by, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"

    def scan(chunks):
        group, held, number = None, set(), 0
        for chunk in chunks:
            numbers = []
            for values, *key in zip(chunk[option_ids], *[chunk[c].astype(object).where(chunk[c].notna(), None) for c in by], strict=True):
                if group != key:
                    group, held, number = key, set(), 0
                wider = held.union(values)
                if held and len(wider) > cap:
                    number, wider = number + 1, set(values)
                held = wider
                numbers.append(number)
            yield chunk.assign(batch=pd.Series(numbers, index=chunk.index, dtype="int64"))

    return rows.mapInPandas(scan, schema)


def merge_lists(*lists: Column) -> Column:
    """Concatenation without repeats, first order kept."""
    return F.array_distinct(F.concat(*lists))


def distinct_labels(df: DataFrame, key: str, entities: str) -> DataFrame:
    """Labels (name, else id) per row, distinct without case, first spelling kept."""
    label = lambda e: F.trim(F.coalesce(F.nullif(e["name"], F.lit("")), e["id"], F.lit("")))
    labels = F.filter(F.transform(entities, label), lambda v: v != "")
    folded = F.transform(labels, F.lower)
    kept = F.filter(labels, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1)
    return df.withColumn("labels", kept)


RESPONSE_FIELDS = ["ID", "filterName", "filterId", "optionId", "optionName"]


def response_errors(item: Column) -> Column:
    """Problems of one parsed response item (a variant): missing fields, synonyms not a list."""
    def absent(field):
        return F.when(F.coalesce(F.trim(F.try_variant_get(item, f"$.{field}", "string")), F.lit("")) == "",
                      F.lit(f"missing {field}"))

    kind = F.schema_of_variant(F.try_variant_get(item, "$.synonyms", "variant"))
    listed = F.coalesce(kind, F.lit("")).startswith("ARRAY")
    return F.array_compact(F.array(*[absent(f) for f in RESPONSE_FIELDS], F.when(~listed, F.lit("synonyms must be a list"))))


def fill_filter_names(matches: DataFrame, manifest: DataFrame) -> DataFrame:
    """Blank filter names taken from the manifest by (combo_id, option_id)."""
    names = manifest.groupBy("combo_id", "option_id").agg(F.max("filter_name").alias("_known"))
    joined = matches.join(names, ["combo_id", "option_id"], "left")
    return joined.withColumn("filter_name", F.coalesce(F.nullif("filter_name", F.lit("")), "_known")).drop("_known")


def resume(rows: DataFrame, existing: DataFrame, process, keys: Sequence[str], order: str) -> DataFrame:
    """Process only rows without earlier output; results come back in input order.

    existing: keys + result + ord, the last entry per key wins. `process`
    adds `result` to pending rows.
    """
    keys = list(keys)
    index = existing.groupBy(*keys).agg(F.max_by("result", "ord").alias("result"))
    done = rows.join(index, keys)
    pending = process(rows.join(index, keys, "left_anti"))
    both = done.select(*keys, order, "result", F.lit(True).alias("resumed")).unionByName(
        pending.select(*keys, order, "result", F.lit(False).alias("resumed")))
    return both.orderBy(order)


def upsert_synonyms(catalogue: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Pipe-joined synonyms where the key matches; other rows are untouched."""
    clean = clean_list(F.col("synonyms"))
    new = lexicon.select(F.trim("filter_id").alias("filter_id"), F.trim("option_id").alias("option_id"),
                         F.array_join(clean, "|").alias("_new"))
    joined = lookup_join(catalogue, new, ["filter_id", "option_id"], "left")
    return joined.withColumn("updated", F.col("_new").isNotNull()).withColumn(
        "synonyms", F.coalesce("_new", "synonyms")).drop("_new")


def manifest(rows: DataFrame, processed: Column, parameters: dict[str, object]) -> DataFrame:
    """One row: totals plus run parameters."""
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(processed).alias("processed_rows")).select(
        *[F.lit(v).alias(k) for k, v in parameters.items()], "total_rows", "processed_rows")


