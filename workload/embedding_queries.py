"""E1-E5, A23, A24, J2, J5, W1-W3, S11, P2, U2 over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.functions import vectors as vx
from wishloom.functions.text import tokens
from wishloom.operators import preferences as pf
from wishloom.operators import similarity as sm
from wishloom.plans.scale import lookup_join, settle

from .frames import TOKS, norm
from .registry import query, r6
from .text_queries import clauses

V = "embedding::DOUBLE[]"
CENTROIDS = f"""
pos AS (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest({V}) AS x, unnest(range(64)) AS p FROM embeddings) GROUP BY 1, 2),
cen AS (SELECT label, 'o' || label AS option_id, list(m ORDER BY p) AS centroid FROM pos GROUP BY label),
sims AS (SELECT vec_id, e.label AS target, c.label AS opt, list_cosine_similarity({V}, centroid) AS s FROM embeddings e, cen c),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, opt) AS rn FROM sims),
best AS (SELECT vec_id, max(target) AS target, max(s) FILTER (opt = target) AS target_score, max(rn) FILTER (opt = target) AS target_rank,
  max(s) FILTER (rn = 1) AS top_score, max(opt) FILTER (rn = 1) AS top_opt, max(s) FILTER (rn = 2) AS runner_up,
  max(s) FILTER (opt <> target) AS best_non_target FROM rk GROUP BY 1)
"""


def options(t):
    c = vx.centroids(t.embeddings.select("label", "embedding"), "label")
    return settle(c.select(F.concat(F.lit("o"), "label").alias("option_id"),
                           F.col("label").cast("long").alias("option_ord"), "centroid"))


def scored(t, opts=None):
    target = F.concat(F.lit("o"), "label")
    u = t.embeddings.withColumn("target", target)
    return sm.score_targets(u, opts if opts is not None else options(t), "vec_id", F.array("target"), keep=["target"])


@query("e1_cosine", f"""
SELECT vec_id, round(list_cosine_similarity({V}, centroid), 6) AS cosine, 0.0::DOUBLE AS against_zero
FROM embeddings JOIN (WITH {CENTROIDS} SELECT label AS l, centroid FROM cen) ON l = (label + 1) % 10""")
def _(t):
    cen = options(t).select(F.col("option_ord").alias("l"), "centroid")
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    e = lookup_join(t.embeddings.withColumn("l", (F.col("label") + 1) % 10), cen, "l")
    return e.select("vec_id", r6(vx.cosine(F.col("embedding"), F.col("centroid"))).alias("cosine"),
                    vx.cosine(F.col("embedding"), zero).alias("against_zero"))


@query("e2_unit_vectors", f"""
WITH n AS (SELECT vec_id, {V} AS v, sqrt(list_dot_product({V}, {V})) AS l FROM embeddings)
SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(x / l * 1e6) AS BIGINT) AS VARCHAR)), ' ') AS components, 1.0::DOUBLE AS length FROM n""")
def _(t):
    u = t.embeddings.select("vec_id", vx.unit(F.col("embedding")).alias("u"))
    whole = F.array_join(F.transform("u", lambda x: F.round(x * 1e6).cast("long").cast("string")), " ")
    return u.select("vec_id", whole.alias("components"), r6(vx.norm(F.col("u"))).alias("length"))


@query("a23_centroids", f"""
WITH {CENTROIDS}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, n AS n_vectors, true AS consistent, array_to_string(list_transform(centroid, lambda x: CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR)), ' ') AS centroid
FROM cen JOIN n USING (label)""")
def _(t):
    c = vx.centroids(t.embeddings.select("label", "embedding"), "label")
    micro = F.transform("centroid", lambda x: F.round(x * 1e6).cast("long").cast("string"))
    return c.select("label", "n_vectors", "consistent", F.array_join(micro, " ").alias("centroid"))


@query("j2_option_scores", f"""
WITH {CENTROIDS} SELECT vec_id, 'o' || top_opt AS top_option, round(top_score, 6) AS top_score, round(runner_up, 6) AS runner_up FROM best""")
def _(t):
    return scored(t).select("vec_id", "top_option", r6("top_score").alias("top_score"), r6("runner_up").alias("runner_up"))


@query("w1_target_rank", f"WITH {CENTROIDS} SELECT vec_id, 'o' || target AS target, target_rank FROM best")
def _(t):
    return scored(t).select("vec_id", "target", "target_rank")


@query("w2_margin", f"WITH {CENTROIDS} SELECT vec_id, round(top_score, 6) AS top_score, round(top_score - runner_up, 6) AS margin FROM best")
def _(t):
    return scored(t).select("vec_id", r6("top_score").alias("top_score"),
                            r6(F.col("top_score") - F.col("runner_up")).alias("margin"))


@query("w3_threshold_or_top_k", f"""
WITH {CENTROIDS}, m AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS best FROM rk)
SELECT vec_id, 'o' || opt AS option_id, round(s, 6) AS similarity, rn AS similarity_rank, s >= 0.5 AS passed FROM m
WHERE CASE WHEN best >= 0.5 THEN s >= 0.5 ELSE rn <= 3 END""")
def _(t):
    kept = sm.keep_or_top_k(t.embeddings, options(t), "vec_id", threshold=0.5, top_k=3)
    return kept.select("vec_id", "option_id", r6("similarity").alias("similarity"), "similarity_rank",
                       (F.col("similarity") >= 0.5).alias("passed"))


@query("e3_purity_gate", f"""
WITH {CENTROIDS}, p AS (SELECT *, top_score - runner_up AS margin, CASE WHEN top_opt <> target THEN 'target_not_top_match' WHEN top_score < 0.38 THEN 'score_below_threshold'
  WHEN top_score - runner_up < 0.10 THEN 'insufficient_margin' ELSE 'accepted' END AS reason FROM best)
SELECT vec_id, reason = 'accepted' AS accepted, reason, round(top_score, 6) AS top_score, round(margin, 6) AS margin FROM p""")
def _(t):
    gated = sm.purity_gate(scored(t), F.col("target"))
    return gated.select("vec_id", "accepted", "reason", r6("top_score").alias("top_score"), r6("margin").alias("margin"))


@query("e4_similarity_breakdown", f"""
WITH {CENTROIDS} SELECT vec_id, round(target_score, 6) AS target_similarity, 'o' || top_opt AS top_option_id, round(top_score, 6) AS top_similarity,
 round(best_non_target, 6) AS best_non_target_similarity, round(target_score - best_non_target, 6) AS similarity_gap, target_rank, top_opt = target AS is_target_top_match FROM best""")
def _(t):
    return scored(t).select(
        "vec_id", r6("target_score").alias("target_similarity"), F.col("top_option").alias("top_option_id"),
        r6("top_score").alias("top_similarity"), r6("best_non_target").alias("best_non_target_similarity"),
        r6(F.col("target_score") - F.col("best_non_target")).alias("similarity_gap"), "target_rank",
        (F.col("top_option") == F.col("target")).alias("is_target_top_match"))


MULTI = f"""
WITH {CENTROIDS}, tg AS (SELECT vec_id, label, 'k' AS k, CASE WHEN vec_id % 3 = 0 THEN [label] WHEN vec_id % 3 = 1 THEN [label, (label + 3) % 10] ELSE [label, 77] END AS targets FROM embeddings),
m AS (SELECT vec_id, max(targets) AS targets, sum(s) FILTER (list_contains(targets, opt)) AS tsum, count(*) FILTER (list_contains(targets, opt)) AS n,
   max(s) FILTER (list_contains(targets, opt)) AS best_t, coalesce(max(s) FILTER (NOT list_contains(targets, opt)), -1.0) AS best_n FROM rk JOIN tg USING (vec_id) GROUP BY 1),
cs AS (SELECT *, tsum / greatest(n, 1) AS coverage, best_t - best_n AS separation FROM m)
"""


def multi(t):
    k = F.col("vec_id") % 3
    lab = F.col("label")
    targets = F.when(k == 0, F.array(lab)).when(k == 1, F.array(lab, (lab + 3) % 10)).otherwise(F.array(lab, F.lit(77)))
    named = F.transform(targets, lambda x: F.concat(F.lit("o"), x.cast("string")))
    return t.embeddings.withColumn("targets", named)


@query("a24_coverage_separation", MULTI + """
SELECT vec_id, n AS target_hits, round(coverage, 6) AS coverage, round(separation, 6) AS separation, coverage < 0.5 AS flag_low_coverage, separation < 0.1 AS flag_low_separation FROM cs""")
def _(t):
    s = sm.coverage_separation(sm.score_targets(multi(t), options(t), "vec_id", F.col("targets")), 0.5, 0.1)
    return s.select("vec_id", F.col("target_hits").cast("long").alias("target_hits"), r6("coverage").alias("coverage"),
                    r6("separation").alias("separation"), "flag_low_coverage", "flag_low_separation")


@query("e5_label_routing", MULTI + """
SELECT CASE WHEN len(targets) = 1 THEN 'purity' ELSE 'multi' END AS route, count(*) AS records,
 count(*) FILTER (len(targets) = 1 AND rn = 1) AS top_matches, round(avg(coverage), 6) AS coverage
FROM cs JOIN (SELECT vec_id, target_rank AS rn FROM best) USING (vec_id) GROUP BY 1""")
def _(t):
    u = multi(t)
    s = sm.coverage_separation(sm.score_targets(u, options(t), "vec_id", F.col("targets"), keep=["targets"]), 0.5, 0.1)
    single = F.size("targets") == 1
    return s.groupBy(F.when(single, "purity").otherwise("multi").alias("route")).agg(
        F.count("*").alias("records"),
        F.count_if(single & (F.col("top_option") == F.col("targets")[0])).alias("top_matches"),
        r6(F.avg("coverage")).alias("coverage"))


@query("j5_unknown_options", """
SELECT 'known' AS side, label AS option_label, count(*) AS n FROM embeddings WHERE label IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0) GROUP BY 2
UNION ALL SELECT 'rejected', label, count(*) FROM embeddings WHERE label NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0) GROUP BY 2""")
def _(t):
    known = t.nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("label"))
    parts = [lookup_join(t.embeddings.select("label"), known, "label", how).withColumn("side", F.lit(side))
             for how, side in (("left_semi", "known"), ("left_anti", "rejected"))]
    return parts[0].unionByName(parts[1]).groupBy("side", F.col("label").alias("option_label")).agg(F.count("*").alias("n"))


@query("p2_semantic_mapper", rf"""
WITH {CENTROIDS}, {clauses('documents', 'doc_id')},
opt AS (SELECT label, 'f' || label % 3 AS filter_id, option_id, list_transform(range(6), lambda i: chr(CAST(97 + (label + i) % 26 AS INTEGER))) || [CASE WHEN label % 2 = 0 THEN 'la' ELSE 'the' END] AS syn FROM cen),
neg1 AS (SELECT id, lower(phrase) AS phrase FROM neg),
x AS (SELECT vec_id, opt, s, rn, max(s) OVER (PARTITION BY vec_id) AS best FROM rk JOIN documents ON doc_id = vec_id WHERE regexp_matches(text, '[\p{{L}}\p{{N}}_]')),
y AS (SELECT x.*, o.filter_id, o.option_id, EXISTS (SELECT 1 FROM neg1 WHERE id = vec_id AND list_contains(o.syn, phrase)) AS b FROM x JOIN opt o ON o.label = x.opt
  WHERE CASE WHEN best >= 0.35 THEN s >= 0.35 ELSE rn <= 5 END)
SELECT vec_id AS doc_id, filter_id, option_id, round(s, 6) AS similarity, round(greatest(0.0, s - 0.25 * CAST(b AS INT)), 6) AS confidence, b AS blocked, s >= 0.35 AND NOT b AS selected, 'mapped' AS status FROM y
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN regexp_matches(text, '[\p{{L}}\p{{N}}_]') THEN 'no-vector' ELSE 'no-words' END FROM documents
 WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) OR NOT coalesce(regexp_matches(text, '[\p{{L}}\p{{N}}_]'), false)""")
def _(t):
    opts = options(t)
    k = F.col("option_ord")
    letters = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.char((97 + (k + i) % 26).cast("int")))
    cat = settle(opts.select(
        F.concat(F.lit("f"), k % 3).alias("filter_id"), "option_id", F.col("option_id").alias("option_label"), "option_ord",
        F.concat(letters, F.array(F.when(k % 2 == 0, "la").otherwise("the"))).alias("synonyms"), "centroid"))
    texts = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "text", "embedding")
    m = pf.map_every_text(texts, cat, "doc_id")
    return m.select("doc_id", "filter_id", "option_id", r6("similarity").alias("similarity"),
                    r6("confidence").alias("confidence"), "blocked", "selected", "status")


@query("s11_embedding_records", "SELECT label, count(*) AS records, CAST(sum(len(embedding)) AS BIGINT) AS numbers FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1")
def _(t):
    from wishloom.sources.readers import usable_embeddings

    raw = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")))
    return usable_embeddings(raw).groupBy("label").agg(F.count("*").alias("records"), F.sum(F.size("embedding")).alias("numbers"))


@query("u2_hashed_vectors", f"""WITH t AS (SELECT doc_id, {TOKS.format(norm('text'))} AS ts FROM documents),
h AS (SELECT doc_id, list_transform(ts, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16) AS hs, len(ts) AS n FROM t)
SELECT doc_id, CAST(n AS INT) AS n, array_to_string(list_transform(range(16), lambda i: len(list_filter(hs, lambda x: x = i))), ',') AS v FROM h""")
def _(t):
    d = t.documents.select("doc_id", vx.hashed_bag_of_words(F.col("text"), 16).alias("v"), F.size(tokens(F.col("text"))).alias("n"))
    return d.select("doc_id", "n", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("v"))
