"""T1-T8, T13-T15, T22-T25 over documents, benchmark, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.functions import coercion as co
from wishloom.functions import fixed_values as fv
from wishloom.functions import language as lg
from wishloom.functions import text as tx

from .frames import SQL_OPS, TOKS, norm, operations
from .registry import query, r6

GRAMS = f"""
WITH tok AS (SELECT doc_id, {TOKS.format(norm('text'))} AS tk FROM documents),
g AS (SELECT doc_id, n, array_to_string(tk[i:i+n-1], ' ') AS gram
      FROM tok, (SELECT unnest([1,2,3]) AS n) s, LATERAL (SELECT unnest(range(1, len(tk)-n+2)) AS i) p)
"""


@query("t1_normalize_label", f"""
SELECT doc_id, {norm('text')} AS label, CASE WHEN {norm('text')} = '' THEN 'Normalized label must not be empty' END AS label_error
FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.normalize_label(F.col("text")).alias("label"),
                              tx.label_error(F.col("text")).alias("label_error"))


@query("t2_ngram_counts", GRAMS + """
SELECT doc_id, count(*) FILTER (n = 1) AS unigrams, count(*) FILTER (n = 2) AS bigrams,
       count(*) FILTER (n = 3) AS trigrams, count(DISTINCT gram) AS distinct_grams
FROM g GROUP BY doc_id""")
def _(t):
    g = t.documents.select("doc_id", tx.ngrams(tx.tokens(F.col("text"))).alias("g"))
    def _is(i):
        return lambda x: x == i

    def words(x):
        return F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1

    n = F.transform("g", words)
    return g.where(F.size("g") > 0).withColumn("n", n).select(
        "doc_id",
        *[F.size(F.filter("n", _is(i))).cast("long").alias(a)
          for i, a in ((1, "unigrams"), (2, "bigrams"), (3, "trigrams"))],
        F.size(F.array_distinct("g")).cast("long").alias("distinct_grams"))


@query("t2_benchmark_ngrams", f"""
WITH tok AS (SELECT item_id, {TOKS.format(norm('text'))} AS tk FROM benchmark),
g AS (SELECT item_id, n, i, array_to_string(tk[i:i+n-1], ' ') AS gram
      FROM tok, (SELECT unnest([1,2,3]) AS n) s, LATERAL (SELECT unnest(range(1, len(tk)-n+2)) AS i) p)
SELECT item_id, array_to_string(list(gram ORDER BY n, i), '|') AS grams FROM g GROUP BY 1""")
def _(t):
    g = tx.ngrams(tx.tokens(F.col("text")))
    return t.benchmark.select("item_id", F.array_join(g, "|").alias("grams"))


WORDW = r"[\p{L}\p{N}_]"


CLAUSE = (r"(?is)^((?:.*?[^\p{L}\p{N}_])??)(?:no|not|without|don[''’]?t)\s+"
          r"([\p{L}\p{N}_\s]{1,80})$")


def clauses(table: str, key: str) -> str:
    """Clause form of the negation pattern, without look-ahead."""
    return rf"""
marked AS (SELECT {key} AS id, regexp_replace(regexp_replace(text, '({WORDW}+)', '⟦\1⟧', 'g'), '(?i)⟦(?:and|but)⟧', ',', 'g') AS m
           FROM {table}),
clause AS (SELECT id, unnest(c) AS c, unnest(range(len(c))) AS pos FROM
           (SELECT id, string_split_regex(replace(replace(m, '⟦', ''), '⟧', ''), '[,;.]') AS c FROM marked)),
neg AS (SELECT id, pos, regexp_replace(regexp_extract(c, '{CLAUSE}', 2), '^\s+|\s+$', '', 'g') AS phrase
        FROM clause WHERE regexp_matches(c, '(?i)(no|not|without|don.?t)\s') AND regexp_matches(c, '{CLAUSE}'))
"""


@query("t3_negation_spans", f"""
WITH {clauses('documents', 'doc_id')}
SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY pos) AS span, phrase,
       CASE WHEN contains(lower(phrase), 'catering') THEN 'room only' END AS replacement FROM neg""")
def _(t):
    found = t.documents.select("doc_id", F.posexplode(tx.negation_phrases(F.col("text"))).alias("p", "phrase"))
    return found.select("doc_id", (F.col("p") + 1).cast("long").alias("span"), "phrase",
                        tx.negation_replacement(F.col("phrase")).alias("replacement"))


@query("t3_conversation_negations", f"""
WITH conv AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations), {clauses('conv', 'k')}
SELECT id // 1000 AS conv_id, count(*) AS spans, count(DISTINCT lower(phrase)) AS phrases FROM neg GROUP BY 1""")
def _(t):
    found = t.conversations.select("conv_id", F.explode(tx.negation_phrases(F.col("text"))).alias("phrase"))
    return found.groupBy("conv_id").agg(F.count("*").alias("spans"),
                                        F.countDistinct(F.lower("phrase")).alias("phrases"))


@query("t4_negation_rewrite", rf"""
WITH src AS (SELECT doc_id, text || ' no catering at all, not the second one. Without ' || lang || ' and don''t stop' AS text FROM documents),
w AS (SELECT doc_id, regexp_replace(text, '({WORDW}+)', '⟦\1⟧', 'g') AS m FROM src),
d AS (SELECT doc_id, regexp_replace(regexp_replace(m, '(?i)(⟦(?:and|but)⟧)', '␞\1', 'g'), '([,;.])', '␞\1', 'g') AS m FROM w),
c AS (SELECT doc_id, string_split(replace(replace(m, '⟦', ''), '⟧', ''), '␞') AS c FROM d),
p AS (SELECT doc_id, list(CASE WHEN regexp_matches(c, '(?i)(no|not|without|don.?t)\s') AND regexp_matches(c, '{CLAUSE}') THEN
         regexp_extract(c, '{CLAUSE}', 1) || CASE WHEN contains(lower(regexp_extract(c, '{CLAUSE}', 2)), 'catering') THEN 'room only'
             ELSE regexp_replace(regexp_extract(c, '{CLAUSE}', 2), '^\s+|\s+$', '', 'g') END
           || CASE WHEN suffix(c, ' ') THEN ' ' ELSE '' END
         ELSE c END ORDER BY pos) AS parts
      FROM (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS pos FROM c) GROUP BY 1)
SELECT doc_id, {norm("array_to_string(parts, '')")} AS rewritten FROM p""")
def _(t):
    text = F.concat("text", F.lit(" no catering at all, not the second one. Without "), "lang",
                    F.lit(" and don't stop"))
    return t.documents.select("doc_id", tx.normalize_label(tx.rewrite_negations(text)).alias("rewritten"))


LATIN = "[A-Za-zÀ-ÿ'']+"


@query("t5_alphabetic_tokens", f"""
SELECT doc_id, len(tk) AS n_tokens, len(list_distinct(tk)) AS distinct_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{LATIN}') AS tk FROM documents)""")
def _(t):
    d = t.documents.select("doc_id", tx.alphabetic_tokens(F.col("text")).alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("tk")).cast("long").alias("distinct_tokens"),
                    F.md5(F.array_join("tk", " ")).alias("tokens_md5"))


def _words(lang: str) -> str:
    return "[" + ", ".join("'" + w + "'" for w in fv.STOPWORDS[lang]) + "]"


SCORES = f"""
tok AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '{LATIN}') AS tk FROM documents),
sc AS (SELECT *, len(tk) AS n, """ + ", ".join(
    f"coalesce(len(list_filter(tk, lambda x: list_contains({_words(g)}, x))) / nullif(len(tk), 0), 0.0) AS s_{g}"
    for g in fv.STOPWORDS) + " FROM tok)"


@query("t6_language_scores", f"""
WITH {SCORES} SELECT lang, count(*) AS docs, round(sum(s_en), 6) AS en, round(sum(s_nl), 6) AS nl,
round(sum(s_fr), 6) AS fr, CAST(sum(n) AS BIGINT) AS tokens FROM sc GROUP BY lang""")
def _(t):
    s = lg.score_languages(t.documents.select("lang", "text"))
    return s.groupBy("lang").agg(
        F.count("*").alias("docs"), *[r6(F.sum(f"score_{g}")).alias(g) for g in fv.STOPWORDS],
        F.sum("n_tokens").alias("tokens"))


@query("t7_language_choice", f"""
WITH {SCORES}, x AS (SELECT *, greatest(s_nl, s_en) AS best, s_en + s_nl AS total,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0) AS ratio FROM sc)
SELECT doc_id,
  CASE WHEN n = 0 THEN NULL WHEN total > 0 THEN CASE WHEN s_en = best THEN 'en' ELSE 'nl' END
       WHEN s_fr > 0 THEN NULL WHEN ratio >= 0.6 THEN 'en' END AS language,
  round(CASE WHEN n = 0 THEN NULL WHEN total > 0 THEN best / total WHEN s_fr > 0 THEN NULL WHEN ratio >= 0.6 THEN ratio END, 6) AS confidence,
  CASE WHEN n = 0 THEN 'Unable to detect language from utterance' WHEN total > 0 THEN NULL
       WHEN s_fr > 0 THEN 'Detected language ''fr'' is not permitted'
       WHEN coalesce(ratio, 0) < 0.6 THEN 'Unable to detect language from utterance' END AS language_error
FROM x""")
def _(t):
    d = lg.detect_language(t.documents.select("doc_id", "text"), allowed=("en", "nl"))
    return d.select("doc_id", "language", r6("confidence").alias("confidence"), "language_error")


@query("t8_allow_list", """
SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'Detected language ''' || lang || ''' is not permitted' END AS error FROM documents""")
def _(t):
    return t.documents.select("doc_id", lg.allow_list_error(F.col("lang"), ("en", "fr")).alias("error"))


@query("t13_timing_pick", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value * 2 WHEN 2 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS total_ms
FROM events""")
def _(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    timings = (
        F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("totalMs"), "value", F.lit("total"), "k"))
        .when(F.col("event_id") % 4 == 1, F.create_map(F.lit("totalMs"), F.lit(None).cast("double"), F.lit("total"), F.col("value") * 2))
        .when(F.col("event_id") % 4 == 2, F.create_map(F.lit("languageMs"), "value", F.lit("GrandTOTAL"), "k"))
        .otherwise(F.create_map(F.lit("languageMs"), "value", F.lit("grand"), "k")))
    return e.select("event_id", co.pick_total(timings).alias("total_ms"))


@query("t14_number_coercion", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value WHEN 5 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS number
FROM events""")
def _(t):
    raw = (F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" ")))
           .when(F.col("event_id") % 6 == 1, F.col("value").cast("string"))
           .when(F.col("event_id") % 6 == 2, "n/a").when(F.col("event_id") % 6 == 3, "Infinity")
           .when(F.col("event_id") % 6 == 4, "NaN").otherwise(F.get_json_object("props", "$.k")))
    return t.events.select("event_id", co.to_number(raw).alias("number"))


USAGE_KEYS = ["prompt_tokens", "completionTokens", "Tokens In", "tokensOut", "apiCalls", "api_request_count",
              "requests", "cpuMs", "cpu_time", "cpu", "ramMbSeconds", "memory_footprint", "memoryMb", "total"]


@query("t15_usage_keys", f"""
WITH keyed AS (SELECT event_id, ({USAGE_KEYS})[1 + event_id % {len(USAGE_KEYS)}] AS raw, value FROM events),
k AS (SELECT *, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS key FROM keyed),
m AS (SELECT *, CASE
   WHEN contains(key, 'token') AND regexp_matches(key, 'out|output|completion|response|candidate') THEN 'tokensOut'
   WHEN contains(key, 'token') AND regexp_matches(key, 'in|input|prompt') THEN 'tokensIn'
   WHEN contains(key, 'api') AND regexp_matches(key, 'call|request') THEN 'apiCalls'
   WHEN key = 'requests' THEN 'apiCalls'
   WHEN contains(key, 'cpu') AND regexp_matches(key, 'ms|time|duration|millisecond') THEN 'cpuMs'
   WHEN regexp_matches(key, 'ram|mem') AND regexp_matches(key, 'mb|byte|footprint') AND regexp_matches(key, 'sec|time|duration|footprint') THEN 'ramMbSeconds' END AS metric FROM k)
SELECT raw AS usage_key, coalesce(metric, 'none') AS metric, count(*) AS n, round(sum(value), 6) AS total FROM m GROUP BY ALL""")
def _(t):
    names = F.array(*[F.lit(x) for x in USAGE_KEYS])
    e = t.events.select("value", F.get(names, (F.col("event_id") % len(USAGE_KEYS)).cast("int")).alias("usage_key"))
    return e.groupBy("usage_key", F.coalesce(co.usage_metric(F.col("usage_key")), F.lit("none")).alias("metric")).agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("t22_threshold_flag", "SELECT event_id, value * 20 > 1000 AS threshold_breached FROM events")
def _(t):
    return t.events.select("event_id", co.threshold_breached(F.col("value") * 20).alias("threshold_breached"))


@query("t23_visibility", f"""WITH {SQL_OPS} SELECT op_id, status FROM ops WHERE status <> 'success'""")
def _(t):
    return co.visible(operations(t), "SHOW_FAILED_ONLY").select("op_id", "status")


@query("t25_language_summary", """
SELECT event_id, event_type || ' (' || CAST(round(CAST(value / 500 AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) || ')' AS summary,
CAST(CAST(round(CAST(value * 20 AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) AS VARCHAR) AS total FROM events
""")
def _(t):
    return t.events.select("event_id", lg.language_summary(F.col("event_type"), F.col("value") / 500).alias("summary"),
                           co.two_decimals(F.col("value") * 20).alias("total"))
