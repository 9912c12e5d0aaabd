"""Usage figures inside free-form metadata.

The metadata is a VARIANT and the descent is an expression on it: a frontier of
objects is opened level by level inside the row until none is left, so there is
no Python, no shuffle and no row per nested object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import to_number, usage_metric
from ..functions.fixed_values import USAGE_COMPONENT_HOLDERS, USAGE_CONTAINER_MARKERS, USAGE_CONTAINERS
from ..functions.text import bind
from ..plans.scale import unnest

OPEN = "array<struct<path:string,node:variant>>"
LEAVES = "array<struct<path:string,usage_key:string,raw:string>>"


def as_object(node: Column) -> Column:
    """Members of an object, null for any other value."""
    return F.when(F.startswith(F.schema_of_variant(node), F.lit("OBJECT")), F.try_variant_get(node, "$", "map<string,variant>"))


def as_list(node: Column) -> Column:
    """Elements of a list, null for any other value."""
    return F.when(F.startswith(F.schema_of_variant(node), F.lit("ARRAY")), F.try_variant_get(node, "$", "array<variant>"))


def names_container(key: Column) -> Column:
    """Whether a key names something that holds usage figures."""
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "").rlike("|".join(USAGE_CONTAINER_MARKERS))


def _scalars(members: Column, path: Column) -> Column:
    """Numbers and texts among the members of an object."""
    plain = F.filter(F.map_entries(members), lambda e: ~F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")).rlike("^(OBJECT|ARRAY|BOOLEAN|VOID)"))
    return F.transform(plain, lambda e: F.struct(
        F.concat(path, F.lit("."), e["key"]).alias("path"), e["key"].alias("usage_key"), F.try_variant_get(e["value"], "$", "string").alias("raw")))


def _objects(members: Column, path: Column, passed: Column) -> Column:
    """Objects one level down: inside any list, or under a key that names a container; lists at the paths `passed` stay shut."""
    def below(e: Column) -> Column:
        here = F.concat(path, F.lit("."), e["key"])
        items = F.transform(F.coalesce(as_list(e["value"]), F.array().cast("array<variant>")), lambda x, i: F.struct(
            F.concat(here, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("node")))
        return F.when(as_object(e["value"]).isNotNull() & names_container(e["key"]), F.array(F.struct(here.alias("path"), e["value"].alias("node")))).when(
            F.array_contains(passed, here), F.array().cast(OPEN)).otherwise(
            F.filter(items, lambda x: as_object(x["node"]).isNotNull()))

    return F.flatten(F.transform(F.map_entries(members), below))


def walk(opened: Column, levels: Column, passed: Column) -> Column:
    """Scalars of the opened objects (path, node) and of the objects they hold, to any depth up to `levels`."""
    def step(state: Column) -> Column:
        seen = F.transform(state["open"], lambda n: F.struct(n["path"].alias("path"), as_object(n["node"]).alias("members")))
        return bind(seen, lambda nodes: F.struct(
            F.flatten(F.transform(nodes, lambda n: _objects(n["members"], n["path"], passed))).alias("open"),
            F.concat(state["leaves"], F.flatten(F.transform(nodes, lambda n: _scalars(n["members"], n["path"])))).alias("leaves")))

    start = F.struct(F.filter(opened, lambda n: as_object(n["node"]).isNotNull()).alias("open"), F.array().cast(LEAVES).alias("leaves"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start,
                       lambda state, _: F.when(F.size(state["open"]) == 0, state).otherwise(step(state)), lambda state: state["leaves"])


def _at(root: Column, *names: str) -> Column:
    """Value at a path of plain names."""
    return F.try_variant_get(root, "$." + ".".join(names), "variant")


def _entry_figures(entry: Column, base: Column, levels: Column) -> Column:
    """Figures of a component: those of its usage and metrics, or its own if these name no metric with a number."""
    parts = F.array(*[F.struct(F.concat(base, F.lit(f".{p}")).alias("path"), _at(entry, p).alias("node")) for p in ("usage", "metrics")])
    return bind(walk(parts, levels, F.array().cast("array<string>")), lambda found: F.when(
        F.exists(found, lambda leaf: usage_metric(leaf["usage_key"]).isNotNull() & to_number(leaf["raw"]).isNotNull()), found
    ).otherwise(F.coalesce(_scalars(as_object(entry), base), F.array().cast(LEAVES))))


def usage_leaves(metadata: Column, levels: Column) -> Column:
    """Array of (path, usage_key, raw) of every usage scalar of a variant, each place counted once."""
    component_lists = [(), *[(h,) for h in USAGE_COMPONENT_HOLDERS], ("llm",), ("llm", "usage")]
    containers = [*[(c,) for c in USAGE_CONTAINERS], ("llm", "usage")]

    def path(names: Sequence[str]) -> str:
        return ".".join(["$", *names])

    def entries(names: tuple[str, ...]) -> Column:
        base = f"{path(names)}.components"
        listed = F.coalesce(as_list(_at(metadata, *names, "components")), F.array().cast("array<variant>"))
        return F.flatten(F.transform(listed, lambda x, i: F.when(as_object(x).isNull(), F.array().cast(LEAVES)).otherwise(
            _entry_figures(x, F.concat(F.lit(f"{base}["), i.cast("string"), F.lit("]")), levels))))

    opened = [F.struct(F.lit(path(c)).alias("path"), _at(metadata, *c).alias("node")) for c in containers]
    model = as_object(_at(metadata, "usageMetadata")).isNull()
    opened.append(F.struct(F.lit("$.llm.usageMetadata").alias("path"), F.when(model, _at(metadata, "llm", "usageMetadata")).alias("node")))
    counted = F.array(*[F.lit(f"{path(names)}.components") for names in component_lists])
    return F.concat(*[entries(names) for names in component_lists], walk(F.array(*opened), levels, counted))


def flatten_usage(df: DataFrame, key: str, metadata: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, kept columns, path, metric, value) rows from a JSON metadata column.

    Text that is no JSON object has no rows. An object can't lie deeper than
    the text has opening braces, which bounds the levels; levels without an
    open object cost nothing.
    """
    carried = [key, *[c for c in keep if c != key]]
    braces = F.length(metadata) - F.length(F.replace(F.col(metadata), F.lit("{")))
    rows = df.select(*carried, F.try_parse_json(metadata).alias("_m"), braces.alias("_levels")).where(as_object(F.col("_m")).isNotNull())
    found = rows.select(*carried, usage_leaves(F.col("_m"), F.col("_levels")).alias("_leaves"))
    return unnest(found, "_leaves", *carried).select(
        *carried, "path", usage_metric(F.col("usage_key")).alias("metric"), to_number(F.col("raw")).alias("value"))
