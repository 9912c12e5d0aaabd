"""T18, G1-G6, G8, J9, S2, S12, S20-S22, W6, A27 over part, conversations and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.operators import datasets as ds
from wishloom.plans.scale import settle

from .frames import part_options
from .registry import query

RAW = """raw AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'CARRIER' ELSE 'FACILITIES' END AS filter_id, [p_name, ' ' || upper(p_name) || ' ', NULL, '  ', 'KLM jet', 'AI inclusive', p_type, p_name || 's', lower(p_type) || ' x', 'tail'] AS syn FROM part)"""


def synonym_lists(t):
    fid = F.when(F.col("p_partkey") % 3 == 0, "CARRIER").otherwise("FACILITIES")
    syn = F.array("p_name", F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")), F.lit(None), F.lit("  "), F.lit("KLM jet"), F.lit("AI inclusive"),
                  "p_type", F.concat("p_name", F.lit("s")), F.concat(F.lower("p_type"), F.lit(" x")), F.lit("tail"))
    return t.part.select("p_partkey", fid.alias("filter_id"), syn.alias("syn"))


@query("t18_sanitise_synonyms", rf"""WITH {RAW}, x AS (SELECT p_partkey, filter_id, unnest(syn) AS s, unnest(range(len(syn))) AS p FROM raw),
k AS (SELECT *, trim(coalesce(s, '')) = '' AS e, filter_id = 'CARRIER' AND regexp_matches(coalesce(regexp_replace(trim(s), '\b(AI|HB|BB|RO)\b', '', 'g'), ''), '\b[A-Z]{{2,4}}\b') AS c, lower(trim(s)) AS v FROM x),
d AS (SELECT *, NOT e AND NOT c AND row_number() OVER (PARTITION BY p_partkey, e, c, v ORDER BY p) > 1 AS dup FROM k),
n AS (SELECT *, coalesce(sum(CAST(NOT e AND NOT c AND NOT dup AS INT)) OVER (PARTITION BY p_partkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p_partkey, string_agg(v, '|' ORDER BY p) FILTER (NOT e AND NOT c AND NOT dup) AS synonyms, count(*) FILTER (e) AS empties, count(*) FILTER (c AND NOT e) AS codes, count(*) FILTER (dup) AS duplicates FROM n WHERE before < 4 GROUP BY 1""")
def _(t):
    r = synonym_lists(t).withColumn("r", ds.sanitise_synonyms(F.col("filter_id"), F.col("syn"), 4))
    return r.select("p_partkey", F.array_join("r.kept", "|").alias("synonyms"),
                    *[F.col(f"r.{c}").cast("long").alias(c) for c in ("empties", "codes", "duplicates")])


HASHED = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
PICK = HASHED.format("'13|' || {size} || '|' || anchor || '|' || draw")


def _grow(size, prev):
    return f"""g{size} AS (SELECT anchor, draw, list_sort(s.opts || [o.option_id]) AS opts, s.fils || [o.filter_id] AS fils FROM (SELECT *, {PICK.format(size=size)} % (SELECT count(*) FROM slots) AS pick FROM {prev}) s
  JOIN slots o ON o.slot = pick WHERE NOT list_contains(s.fils, o.filter_id)),
k{size} AS (SELECT {size} AS size, array_to_string(opts, '+') AS combo_key FROM g{size} GROUP BY ALL),
"""


@query("g1_option_combinations", f"""WITH slots AS (SELECT row_number() OVER (ORDER BY md5('13|' || option_id), option_id) - 1 AS slot, option_id, filter_id FROM (SELECT CAST(p_partkey AS VARCHAR) AS option_id, p_brand AS filter_id FROM part)),
g1 AS (SELECT slot AS anchor, draw, [option_id] AS opts, [filter_id] AS fils FROM slots, (SELECT unnest(range(8)) AS draw) d),
{_grow(2, 'g1')}{_grow(3, 'g2')}{_grow(4, 'g3')}
al AS (SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4),
rk AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY md5('13|' || combo_key), combo_key) AS rn FROM al)
SELECT size, combo_key FROM rk WHERE rn <= CASE size WHEN 2 THEN 500 WHEN 3 THEN 300 ELSE 200 END""")
def _(t):
    return ds.option_combinations(part_options(t), 1000).select("size", "combo_key")


@query("g2_sample_options", """WITH f AS (SELECT p_brand, arg_min(p_name, p_partkey) AS option_name, min(p_partkey) AS ord FROM part GROUP BY 1)
SELECT p_brand AS option_id, option_name, ord FROM f ORDER BY md5('7|' || p_brand), p_brand LIMIT 10""")
def _(t):
    o = t.part.select(F.col("p_brand").alias("option_id"), F.col("p_name").alias("option_name"), F.col("p_partkey").alias("ord"))
    return ds.sample_options(o, "option_id", "ord", 10, seed=7)


def combos(t):
    """One combo per conversation turn, two matched options each."""
    m = lambda i: F.struct(F.concat(F.lit(" f"), F.lit(i)).alias("filter_id"), F.lit(f"F{i}").alias("filter_name"),
                           F.concat(F.lit("o"), F.col("turn") + i).alias("option_id"), F.lit("O").alias("option_name"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("utterance"), F.array(m(1), m(2)).alias("matched"))


SAMPLE = "s AS (SELECT conv_id, turn, trim(text) AS utterance FROM conversations ORDER BY md5('3|' || conv_id || '|' || turn), conv_id, turn LIMIT 100)"


@query("g3_sample_rows", f"WITH {SAMPLE}, i AS (SELECT unnest([1, 2]) AS i) SELECT md5(utterance) AS utterance, 'f' || i AS filter_id, 'o' || (turn + i) AS option_id FROM s, i WHERE utterance <> ''")
def _(t):
    from wishloom.operators.datasets import multi_rows, sample_rows

    r = multi_rows(sample_rows(combos(t), 100, 3, "conv_id", "turn"))
    return r.select(F.md5("utterance").alias("utterance"), "filter_id", "option_id")


@query("g4_sample_union", f"WITH {SAMPLE}, i AS (SELECT unnest([1, 2]) AS i), q AS (SELECT p_partkey FROM part ORDER BY md5('3|' || p_partkey), p_partkey LIMIT 50) SELECT 'multi' AS kind, 'o' || (turn + i) AS option_id, count(*) AS n FROM s, i WHERE utterance <> '' GROUP BY ALL UNION ALL SELECT 'single', CAST(p_partkey AS VARCHAR), count(*) FROM q GROUP BY ALL")
def _(t):
    multi = ds.multi_rows(ds.sample_rows(combos(t), 100, 3, "conv_id", "turn")).select(F.lit("multi").alias("kind"), "option_id")
    single = ds.sample_rows(part_options(t), 50, 3, "ord").select(F.lit("single").alias("kind"), "option_id")
    return multi.unionByName(single).groupBy("kind", "option_id").agg(F.count("*").alias("n"))


@query("g5_capped_batches", """WITH RECURSIVE r AS (SELECT p_partkey AS ord, p_brand AS grp, list_distinct([p_type, 's' || p_size]) AS ids, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
g AS (SELECT grp, rn, ord, ids AS held, 0 AS batch FROM r WHERE rn = 1
 UNION ALL SELECT r.grp, r.rn, r.ord, CASE WHEN len(list_distinct(held || ids)) > 6 THEN ids ELSE list_distinct(held || ids) END,
  batch + CASE WHEN len(list_distinct(held || ids)) > 6 THEN 1 ELSE 0 END FROM g JOIN r ON r.grp = g.grp AND r.rn = g.rn + 1)
SELECT grp, ord, CAST(batch AS BIGINT) AS batch FROM g""")
def _(t):
    rows = t.part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("grp"),
                         F.array_distinct(F.array("p_type", F.concat(F.lit("s"), "p_size"))).alias("ids"))
    return ds.batches_by_distinct_options(rows, "ord", "ids", 6, ["grp"]).select("grp", "ord", "batch")


@query("g6_merge_lists", """WITH x AS (SELECT o_orderkey, ['A' || o_custkey % 3, 'A' || o_custkey % 5, 'A' || o_orderkey % 4, 'A' || o_custkey % 3] AS l FROM orders),
e AS (SELECT o_orderkey, unnest(l) AS v, unnest(range(4)) AS p FROM x), f AS (SELECT o_orderkey, v, min(p) AS p FROM e GROUP BY 1, 2) SELECT o_orderkey, string_agg(v, ',' ORDER BY p) AS merged FROM f GROUP BY 1""")
def _(t):
    a = lambda c, n: F.concat(F.lit("A"), F.col(c) % n)
    merged = ds.merge_lists(F.array(a("o_custkey", 3), a("o_custkey", 5)), F.array(a("o_orderkey", 4), a("o_custkey", 3)))
    return t.orders.select("o_orderkey", F.array_join(merged, ",").alias("merged"))


@query("g8_response_errors", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing optionName' WHEN 2 THEN 'synonyms must be a list' ELSE 'missing ID,missing filterId,synonyms must be a list' END AS errors FROM part""")
def _(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    parts = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    good = parts('{"ID":"', k, '","filterName":"B","filterId":"b","optionId":"', k, '","optionName":"')
    js = (F.when(k % 4 == 0, parts(good, name, '","synonyms":["a"]}')).when(k % 4 == 1, parts(good, ' ","synonyms":[]}'))
          .when(k % 4 == 2, parts(good, name, '","synonyms":"a|b"}')).otherwise(parts('{"filterName":"B","optionId":"1","optionName":"', name, '","filterId":" "}')))
    return t.part.select("p_partkey", F.array_join(ds.response_errors(F.parse_json(js)), ",").alias("errors"))


@query("j9_fill_filter_names", """SELECT l_orderkey AS combo_id, l_partkey AS option_id, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'own' ELSE p_brand END AS filter_name FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    matches = t.lineitem.select(F.col("l_orderkey").alias("combo_id"), F.col("l_partkey").alias("option_id"), "l_linenumber",
                                F.when(F.col("l_linenumber") % 2 == 0, "own").otherwise("").alias("filter_name"))
    known = t.lineitem.select(F.col("l_orderkey").alias("combo_id"), F.col("l_partkey").alias("option_id")).join(
        t.part.select(F.col("p_partkey").alias("option_id"), F.col("p_brand").alias("filter_name")), "option_id")
    return ds.fill_filter_names(matches, known)


@query("s2_lexicon", """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'ID' || p_partkey WHEN p_partkey % 3 = 1 THEN 'id' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS record_id, p_name || '|' || lower(p_type) AS synonyms FROM part""")
def _(t):
    from wishloom.sources.readers import lexicon_records

    k = F.col("p_partkey")
    raw = t.part.select(
        F.when(k % 3 == 0, F.concat(F.lit(" ID"), k)).when(k % 3 == 1, " ").alias("ID"), F.when(k % 3 == 1, F.concat(F.lit("id"), k)).alias("id_"),
        F.col("p_brand").alias("filterId"), F.col("p_brand").alias("filterName"), k.cast("string").alias("optionId"), F.col("p_name").alias("optionName"),
        F.concat(F.lit(" "), "p_name", F.lit(" | |"), F.lower("p_type"), F.lit("|")).alias("synonyms"))
    return lexicon_records(raw, lower_id="id_").select("record_id", F.array_join("synonyms", "|").alias("synonyms"))


@query("s12_result_rows", """SELECT conv_id, count(*) FILTER (trim(text) <> '') AS utterances, CAST(sum(length(trim(text))) FILTER (trim(text) <> '') AS BIGINT) AS letters FROM conversations GROUP BY 1 HAVING utterances > 0""")
def _(t):
    # each result nests one utterance and a blank one, so no group is collected
    nested = t.conversations.select(
        *[F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias(c) for c in ("filter_id", "filter_name", "option_id", "option_name")],
        F.array(F.struct(F.col("text").alias("utterance")), F.struct(F.lit(" ").alias("utterance"))).alias("utterances"))
    rows = ds.single_utterances(nested)
    return rows.groupBy(F.col("option_id").cast("long").alias("conv_id")).agg(F.count("*").alias("utterances"), F.sum(F.length("utterance")).alias("letters"))


@query("s20_resume", """SELECT p_brand AS filter_id, p_partkey AS option_id, CASE WHEN p_partkey % 2 = 0 THEN 'old2:' || p_name ELSE 'new:' || p_name END AS result, p_partkey % 2 = 0 AS resumed FROM part""")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("filter_id"), F.col("p_partkey").alias("option_id"), "p_name", F.col("p_partkey").alias("ord"))
    even = rows.where("option_id % 2 = 0")
    old = even.select("filter_id", "option_id", F.concat(F.lit("old1:"), "p_name").alias("result"), F.lit(1).alias("ord")).unionByName(
        even.select("filter_id", "option_id", F.concat(F.lit("old2:"), "p_name").alias("result"), F.lit(2).alias("ord")))
    out = ds.resume(rows, old, lambda df: df.withColumn("result", F.concat(F.lit("new:"), "p_name")), ["filter_id", "option_id"], "ord")
    return out.select("filter_id", "option_id", "result", "resumed")


@query("s21_upsert_synonyms", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || '|big' ELSE lower(p_type) END AS synonyms, p_size > 25 AS updated FROM part""")
def _(t):
    cat = t.part.select("p_partkey", F.col("p_brand").alias("filter_id"), F.col("p_partkey").cast("string").alias("option_id"), F.lower("p_type").alias("synonyms"))
    lex = t.part.where("p_size > 25").select(F.col("p_brand").alias("filter_id"), F.concat(F.lit(" "), "p_partkey").alias("option_id"),
                                            F.array("p_name", F.lit(" "), F.lit(" big")).alias("synonyms"))
    return ds.upsert_synonyms(cat, settle(lex)).select("p_partkey", "synonyms", "updated")


@query("s22_manifest", "SELECT 'part' AS input_path, 5 AS max_synonyms, count(*) AS total_rows, count(*) FILTER (p_size > 25) AS processed_rows FROM part")
def _(t):
    return ds.manifest(t.part, F.col("p_size") > 25, {"input_path": "part", "max_synonyms": 5})


@query("w6_batches", "SELECT p_partkey, p_brand, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 7 AS BIGINT) AS batch FROM part")
def _(t):
    return ds.batches(t.part, "p_partkey", 7, ["p_brand"]).select("p_partkey", "p_brand", "batch")


@query("a27_distinct_labels", "SELECT p_partkey, p_name || CASE WHEN lower(p_type) <> p_name THEN ',' || p_type ELSE '' END || CASE WHEN lower(p_brand) NOT IN (p_name, lower(p_type)) THEN ',' || p_brand ELSE '' END AS labels FROM part")
def _(t):
    e = lambda n, i: F.struct(n.alias("name"), i.alias("id"))
    c = F.col
    ents = F.array(e(c("p_name"), F.lit("x")), e(F.upper(c("p_name")), F.lit("y")), e(F.lit(""), c("p_type")), e(F.lit(None).cast("string"), F.concat(F.lit(" "), "p_brand")), e(F.lit(""), F.lit("")))
    return ds.distinct_labels(t.part.withColumn("ents", ents), "p_partkey", "ents").select("p_partkey", F.array_join("labels", ",").alias("labels"))
