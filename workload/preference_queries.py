"""J1, A21, A22, P1-P4, T24 over documents with a catalogue of frequent n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.operators import catalogue as ct
from wishloom.operators import preferences as pf
from wishloom.plans.scale import settle

from .frames import SQL_CATALOGUE, TOKS, catalogue, norm
from .registry import query, r6
from .text_queries import CLAUSE, SCORES, WORDW

# The rewrite and its marks, written with clauses instead of look-ahead.
REWRITE = rf"""
d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '({WORDW}+)', '⟦\1⟧', 'g'), '(?i)(⟦(?:and|but)⟧)', '␞\1', 'g'), '([,;.])', '␞\1', 'g') AS m FROM documents),
c AS (SELECT doc_id, unnest(x) AS c, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(replace(replace(m, '⟦', ''), '⟧', ''), '␞') AS x FROM d)),
hit AS (SELECT doc_id, pos, c, regexp_matches(c, '(?i)(no|not|without|don.?t)\s') AND regexp_matches(c, '{CLAUSE}') AS h FROM c),
ph AS (SELECT *, CASE WHEN h THEN regexp_replace(regexp_extract(c, '{CLAUSE}', 2), '^\s+|\s+$', '', 'g') END AS phrase FROM hit),
rw AS (SELECT doc_id, {norm('''array_to_string(list(CASE WHEN h THEN regexp_extract(c, '%s', 1) || CASE WHEN contains(lower(phrase), 'catering') THEN 'room only' ELSE phrase END
         || CASE WHEN suffix(c, ' ') THEN ' ' ELSE '' END ELSE c END ORDER BY pos), '')''' % CLAUSE)} AS clean FROM ph GROUP BY doc_id),
marks AS (SELECT DISTINCT doc_id, {norm("CASE WHEN contains(lower(phrase), 'catering') THEN 'room only' ELSE phrase END")} AS synonym,
         contains(lower(phrase), 'catering') AS swapped FROM ph WHERE h),
tok AS (SELECT doc_id, {TOKS.format('clean')} AS tk FROM rw),
g AS (SELECT doc_id, n, array_to_string(tk[i:i+n-1], ' ') AS synonym
      FROM tok, (SELECT unnest([1,2,3]) AS n) s, LATERAL (SELECT unnest(range(1, len(tk)-n+2)) AS i) p),
hits AS (SELECT doc_id, synonym, count(*) AS hits FROM g SEMI JOIN idx USING (synonym) GROUP BY ALL)
"""
SCORE = "least(1.0, greatest(0.0, 0.35 + 0.4 * least(sum(hits * n_tokens) / sum(hits) / 3.0, 1.0) + 0.25 * least(sum(hits) / 2.0, 1.0) - 0.25 * sum(CASE WHEN nm.synonym IS NOT NULL THEN hits ELSE 0 END)))"
RULES = f"""
WITH {SQL_CATALOGUE}, {REWRITE},
mapped AS (SELECT hits.doc_id, filter_id, option_id, CAST(sum(hits) AS BIGINT) AS hits, {SCORE} AS confidence,
  bool_or(bm.synonym IS NOT NULL) AS blocked, array_to_string(list_sort(list(hits.synonym)), '|') AS spans
 FROM hits JOIN idx ON hits.synonym = idx.synonym
 LEFT JOIN marks nm ON nm.doc_id = hits.doc_id AND nm.synonym = hits.synonym AND nm.swapped
 LEFT JOIN marks bm ON bm.doc_id = hits.doc_id AND bm.synonym = hits.synonym AND NOT bm.swapped
 GROUP BY hits.doc_id, filter_id, option_id)
"""


@query("j1_synonym_join", f"""
WITH {SQL_CATALOGUE}, tok AS (SELECT doc_id, {TOKS.format(norm('text'))} AS tk FROM documents),
g AS (SELECT doc_id, array_to_string(tk[i:i+n-1], ' ') AS synonym
      FROM tok, (SELECT unnest([1,2,3]) AS n) s, LATERAL (SELECT unnest(range(1, len(tk)-n+2)) AS i) p)
SELECT doc_id, synonym, count(*) AS hits FROM g SEMI JOIN idx USING (synonym) GROUP BY ALL""")
def _(t):
    index = settle(ct.synonym_index(catalogue(t)))
    return pf.synonym_hits(t.documents.select("doc_id", "text"), index, "doc_id")


@query("p1_rules_mapper", RULES + """
SELECT doc_id, filter_id, option_id, hits, round(confidence, 6) AS confidence, blocked,
  confidence >= 0.6 AND NOT blocked AS selected, spans FROM mapped""")
def _(t):
    mapped = pf.map_by_rules(t.documents.select("doc_id", "text"), settle(catalogue(t)), "doc_id")
    return mapped.select("doc_id", "filter_id", "option_id", "hits", r6("confidence").alias("confidence"), "blocked",
                         "selected", F.array_join("spans", "|").alias("spans"))


@query("a21_option_confidence", """
WITH s AS (SELECT l_orderkey, l_partkey % 50 AS option_id, count(*) AS hits, sum(1 + l_linenumber % 3) AS len, sum(CAST(l_returnflag = 'R' AS INT)) AS neg
  FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, option_id, CAST(hits AS BIGINT) AS hits,
 round(greatest(0.0, least(1.0, 0.35 + 0.4 * least(len / hits / 3.0, 1.0) + 0.25 * least(hits / 2.0, 1.0) - 0.25 * neg)), 6) AS confidence FROM s""")
def _(t):
    s = t.lineitem.groupBy("l_orderkey", (F.col("l_partkey") % 50).alias("option_id")).agg(
        F.count("*").alias("hits"), F.sum(1 + F.col("l_linenumber") % 3).alias("len"),
        F.count_if(F.col("l_returnflag") == "R").alias("neg"))
    return s.select("l_orderkey", "option_id", "hits",
                    r6(pf.confidence(F.col("hits"), F.col("len"), F.col("neg"))).alias("confidence"))


@query("a22_nested_selections", RULES + """,
per_filter AS (SELECT doc_id, filter_id, string_agg(option_id || '=' || CASE WHEN confidence >= 0.6 AND NOT blocked THEN 'yes' ELSE 'no' END, ',' ORDER BY CAST(substr(option_id, 2) AS INT)) AS s FROM mapped GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_filters, string_agg(filter_id || ':' || s, ';' ORDER BY filter_id) AS selections FROM per_filter GROUP BY 1""")
def _(t):
    cat = settle(catalogue(t))
    nested = pf.nest_selections(pf.map_by_rules(t.documents.select("doc_id", "text"), cat, "doc_id"), cat, "doc_id")

    def option(o):
        return F.concat(o["option_id"], F.lit("="), F.when(o["selected"], "yes").otherwise("no"))

    def one(f):
        return F.concat(f["filter_id"], F.lit(":"), F.array_join(F.transform(f["options"], option), ","))

    return nested.select("doc_id", F.size("filters").cast("long").alias("n_filters"),
                         F.array_join(F.transform("filters", one), ";").alias("selections"))


@query("p3_method_aliases", RULES + """
SELECT CASE d.doc_id % 4 WHEN 0 THEN 'rules' WHEN 1 THEN 'llm' WHEN 2 THEN 'hybrid' ELSE 'other' END AS kind, count(*) AS options,
  count(*) FILTER (confidence >= 0.6 AND NOT blocked) AS selected FROM mapped d GROUP BY 1""")
def _(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("rules", "llm", "hybrid", "other")]),
                        (F.col("doc_id") % 4 + 1).cast("int"))
    texts = t.documents.select("doc_id", "text", kind.alias("kind"))
    mapped = pf.map_by_kind(texts, settle(catalogue(t)), "doc_id")
    return mapped.groupBy("kind").agg(F.count("*").alias("options"), F.count_if("selected").alias("selected"))


@query("p4_preference_run", RULES + f""", {SCORES.replace('tok AS', 'ltok AS').replace('FROM tok)', 'FROM ltok)')},
lang_ok AS (SELECT doc_id, CASE WHEN n = 0 THEN false WHEN s_en > 0 THEN true WHEN s_nl > 0 OR s_fr > 0 THEN false
  ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0) >= 0.6 END AS ok FROM sc),
cnt AS (SELECT doc_id, count(*) AS n, count(*) FILTER (confidence >= 0.6 AND NOT blocked) AS s FROM mapped GROUP BY 1)
SELECT l.doc_id, CASE WHEN NOT ok THEN 'error' WHEN n > 0 THEN 'success' ELSE 'no-preferences-detected' END AS status,
  CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END AS n_options, CASE WHEN ok THEN coalesce(s, 0) ELSE 0 END AS n_selected
FROM lang_ok l LEFT JOIN cnt USING (doc_id)""")
def _(t):
    run = pf.run_preferences(t.documents.select("doc_id", "text"), settle(catalogue(t)), "doc_id")
    return run.select("doc_id", "status", "n_options", "n_selected")


@query("t24_status_mapping", """
WITH s AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'no-preferences-detected' WHEN 2 THEN 'invalid-catalogue' ELSE 'error' END AS status FROM conversations)
SELECT conv_id, turn, CASE WHEN status IN ('success', 'error') THEN status ELSE 'failed' END AS shown, CASE WHEN status NOT IN ('success', 'error') THEN status END AS reason FROM s""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("success", "no-preferences-detected", "invalid-catalogue", "error")])
    s = t.conversations.withColumn("status", F.get(names, ((F.col("conv_id") + F.col("turn")) % 4).cast("int")))
    shown, reason = pf.display_status(F.col("status"))
    return s.select("conv_id", "turn", shown.alias("shown"), reason.alias("reason"))
