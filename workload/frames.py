"""Stand-in frames derived from the given tables, in Spark and in SQL.

Both forms only prepare inputs; the operators under check are written
separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishloom.functions import fixed_values as fv

from .registry import Tables

# -- catalogue: frequent n-grams of `benchmark` ------------------------------

NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def norm(expr: str) -> str:
    return NORM.format(expr)


TOKS = "list_filter(string_split({0}, ' '), lambda t: t <> '')"

SQL_CATALOGUE = f"""
cat_tok AS (SELECT item_id, {TOKS.format(norm('text'))} AS tk FROM benchmark),
cat_gram AS (
  SELECT n, array_to_string(tk[i:i+n-1], ' ') AS gram
  FROM cat_tok, (SELECT unnest([1,2,3]) AS n) s, LATERAL (SELECT unnest(range(1, len(tk)-n+2)) AS i) p
),
cat_top AS (
  SELECT n, gram, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, gram) AS rk
  FROM cat_gram GROUP BY n, gram QUALIFY rk <= 20
),
idx AS (
  SELECT gram AS synonym, n AS n_tokens, 'f' || n AS filter_id, 'o' || ((rk - 1) // 2) AS option_id FROM cat_top
)
"""


def catalogue(t: Tables) -> DataFrame:
    """Top 20 n-grams per size; two synonyms share an option, sizes are filters."""
    from wishloom.functions.text import ngrams, tokens
    from pyspark.sql import Window

    grams = t.benchmark.select(F.explode(ngrams(tokens(F.col("text")))).alias("gram"))
    counted = grams.groupBy("gram").count().withColumn("n", F.size(F.split("gram", " ")))
    ranked = counted.withColumn(
        "rk", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("count"), "gram"))).where("rk <= 20")
    option = F.floor((F.col("rk") - 1) / 2).cast("int")
    return ranked.groupBy("n", option.alias("option_ord")).agg(
        F.array_sort(F.collect_list(F.struct("rk", "gram"))).alias("g")
    ).select(
        F.col("n").alias("filter_ord"), F.concat(F.lit("f"), "n").alias("filter_id"),
        F.concat(F.lit("Words "), "n").alias("filter_label"), "option_ord",
        F.concat(F.lit("o"), "option_ord").alias("option_id"),
        F.col("g")[0]["gram"].alias("option_label"),
        F.transform("g", lambda x: x["gram"]).alias("synonyms"),
    )


# -- composed requests: orders x customer x nation x region ------------------

SQL_REQUESTS = """
requests AS (
  SELECT o_orderkey AS request_id, o_custkey, o_orderpriority,
    CASE WHEN o_orderkey % 4 = 0 THEN 'nl' WHEN o_orderkey % 4 = 1 THEN 'fr' WHEN o_orderkey % 4 = 2 THEN 'xx' ELSE 'en' END AS lang,
    'Trip from ' || n_name
    || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' to ' || CASE WHEN o_orderkey % 4 = 0 THEN 'land_' || r_regionkey ELSE r_name END END
    || CASE WHEN o_orderkey % 3 = 0 THEN ' and MIDDLE EAST' ELSE '' END
    || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' on ' || CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y') ELSE strftime(o_orderdate, '%B %-d, %Y') END END
    || ' for ' || CASE WHEN o_orderkey % 11 = 0 THEN 'a week' ELSE (1 + o_orderkey % 19) || ' nights' END
    || CASE o_orderkey % 6 WHEN 0 THEN ' not flexible' WHEN 1 THEN ' +- 7 days' WHEN 2 THEN ' +- 14 days' ELSE '' END AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)
"""


def requests(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    # nation and region are fixed dimension tables of 25 and 5 rows
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    when = (F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(k % 4 == 1, F.date_format("o_orderdate", "dd-MM-yyyy"))
            .when(k % 4 == 2, F.date_format("o_orderdate", "d MMMM yyyy"))
            .otherwise(F.date_format("o_orderdate", "MMMM d, yyyy")))
    text = F.concat(
        F.lit("Trip from "), "n_name",
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" to "), F.when(
            k % 4 == 0, F.concat(F.lit("land_"), "r_regionkey")).otherwise(F.col("r_name")))),
        F.when(k % 3 == 0, " and MIDDLE EAST").otherwise(""),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" on "), when)),
        F.lit(" for "),
        F.when(k % 11 == 0, "a week").otherwise(F.concat((1 + k % 19).cast("string"), F.lit(" nights"))),
        F.when(k % 6 == 0, " not flexible").when(k % 6 == 1, " +- 7 days").when(k % 6 == 2, " +- 14 days")
        .otherwise(""),
    )
    lang = F.when(k % 4 == 0, "nl").when(k % 4 == 1, "fr").when(k % 4 == 2, "xx").otherwise("en")
    return joined.select(k.alias("request_id"), "o_custkey", "o_orderpriority", lang.alias("lang"), text.alias("text"))


def airports(t: Tables) -> DataFrame:
    return t.nation.select(
        F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.lit("AIRPORT").alias("type"), (F.col("n_nationkey") % 9 != 8).alias("available"),
        F.col("n_nationkey").cast("long").alias("ord"))


def destinations(t: Tables) -> DataFrame:
    return t.region.select(
        F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") % 2 == 0, "country").otherwise("").alias("type"),
        (F.col("r_regionkey") != 3).alias("available"), F.col("r_regionkey").cast("long").alias("ord"))


def alias_entries(t: Tables) -> DataFrame:
    """category, target, values[lang, value]: land_<k> in nl and fr, one conflict, one unknown."""
    k = F.col("r_regionkey")
    return t.region.select(
        F.lit("destinations").alias("category"), F.concat(F.lit("R"), k).alias("target"),
        F.array(
            F.struct(F.lit("nl").alias("lang"), F.concat(F.lit("Land_"), k).alias("value")),
            F.struct(F.lit("fr").alias("lang"), F.concat(F.lit(" pays_"), k).alias("value")),
            F.struct(F.lit("fr").alias("lang"), F.concat(F.lit("zone_"), (k % 2)).alias("value")),
            F.struct(F.lit("").alias("lang"), F.lit("skipped").alias("value")),
        ).alias("values"),
    ).unionByName(t.nation.where("n_nationkey >= 20").select(
        F.lit("destinations").alias("category"), F.concat(F.lit("X"), "n_nationkey").alias("target"),
        F.array(F.struct(F.lit("nl").alias("lang"), F.col("n_name").alias("value"))).alias("values")))


SQL_ALIAS = """
entries AS (
  SELECT 'destinations' AS category, 'R' || r_regionkey AS target_id, 'nl' AS lang, 'land_' || r_regionkey AS alias FROM region
  UNION ALL SELECT 'destinations', 'R' || r_regionkey, 'fr', 'pays_' || r_regionkey FROM region
  UNION ALL SELECT 'destinations', 'R' || r_regionkey, 'fr', 'zone_' || (r_regionkey % 2) FROM region
  UNION ALL SELECT 'destinations', 'X' || n_nationkey, 'nl', lower(n_name) FROM nation WHERE n_nationkey >= 20
)
"""

# -- bookings: orders x lineitem x part --------------------------------------

SQL_BOOKINGS = """
brands AS (
  SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS destinations FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
),
bookings AS (
  SELECT o_orderkey AS ord,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 2 + (CAST(floor(o_totalprice) AS BIGINT) % 13) END AS duration,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 3 END AS rooms,
    o_custkey % 4 AS adults, o_custkey % 3 AS children, o_orderkey % 2 AS infants,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS start_date,
    CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE strftime(date_trunc('month', o_orderdate) + to_days(CAST(o_custkey % 3 AS INTEGER)), '%Y-%m-%d') END AS end_date,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS airport,
    coalesce(destinations, []) AS destinations
  FROM orders LEFT JOIN brands ON l_orderkey = o_orderkey
)
"""


def bookings(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # distinct brands per order: bounded by the number of brands
    brands = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    ).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("d"))
    month = F.trunc("o_orderdate", "month")
    price = F.floor("o_totalprice")
    return t.orders.join(brands, k == F.col("l_orderkey"), "left").select(
        k.alias("ord"),
        F.when(k % 10 != 0, 2 + price % 13).alias("duration"),
        F.when(k % 4 != 0, c % 3).alias("rooms"),
        (c % 4).alias("adults"), (c % 3).alias("children"), (k % 2).alias("infants"),
        F.date_format(month, "yyyy-MM-dd").alias("start_date"),
        F.when(k % 8 != 0, F.date_format(F.date_add(month, (c % 3).cast("int")), "yyyy-MM-dd")).alias("end_date"),
        F.when(k % 6 != 0, F.col("o_orderpriority")).alias("airport"),
        F.coalesce("d", F.array().cast("array<string>")).alias("destinations"),
    )


# -- replay operations: events ------------------------------------------------

SQL_OPS = """
ops AS (
  SELECT event_id AS op_id, user_id AS run_id, ts, event_type AS method,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'failed' END ELSE 'success' END AS status,
    value * 20 AS total_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
)
"""


def operations(t: Tables) -> DataFrame:
    status = F.when(
        F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "error").otherwise("failed")
    ).otherwise("success")
    return t.events.select(
        F.col("event_id").alias("op_id"), F.col("user_id").alias("run_id"), "ts",
        F.col("event_type").alias("method"), status.alias("status"),
        (F.col("value") * 20).alias("total_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


# -- options of `part` --------------------------------------------------------


def part_options(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_brand").alias("filter_id"), F.concat(F.lit("Brand "), "p_brand").alias("filter_name"),
        F.col("p_partkey").cast("string").alias("option_id"), F.col("p_name").alias("option_name"),
        F.concat_ws("|", "p_name", F.lower("p_type")).alias("synonyms"), F.col("p_partkey").alias("ord"))


DURATION_VALUES = ", ".join(f"({i}, '{d}', '{n.lower()}')" for i, (d, n) in enumerate(fv.DURATIONS))
FLEX_VALUES = ", ".join(f"({i}, '{d}', '{n.lower()}')" for i, (d, n) in enumerate(fv.FLEXIBILITY))
SQL_DURATIONS = f"durations AS (SELECT * FROM (VALUES {DURATION_VALUES}) v(ord, id, name))"
SQL_FLEX = f"flexes AS (SELECT * FROM (VALUES {FLEX_VALUES}) v(ord, id, name))"
