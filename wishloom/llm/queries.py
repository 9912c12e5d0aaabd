"""The registered query of every operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wishloom.llm import byte_bpe, decontaminate, graph_ann, jaccard_join, kd_shards, language_id, line_templates, packing, periodic_runs, quality, repeats, url_filter, whitening
from wishloom.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]

#: Fixed rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP1_SQL = r"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM parts LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


@query("op1_url_filter", OP1_SQL)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.build(rules)).select("page_id", "host", "path", "rule", "verdict")


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\x{80}-\x{10FFFF}]+')"""
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM d JOIN (SELECT DISTINCT k FROM bw) ks ON len(w) >= k)),
hit AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    bench = decontaminate.index(table(spark, folder, "benchmark"))
    found = decontaminate.find(table(spark, folder, "documents"), bench, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def tokenizer() -> list[bytes]:
    """Pieces of the public byte-level vocabulary."""
    import public_tokenizers

    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def bpe_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    pieces = tokenizer()
    book = byte_bpe.dictionary(documents, pieces)
    coded = byte_bpe.decode(byte_bpe.encode(documents, book, keep=["doc_id"]), pieces, keep=["doc_id", "ids"])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(table(spark, folder, "documents"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"))
    models = language_id.train(documents.where("not held_out"))
    return language_id.predict(documents, models, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    measured = quality.settle_features(documents, ["doc_id", "held_out"])
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = quality.fit(measured.where("not held_out").join(labels, "doc_id"))
    return quality.score(measured, model, ["doc_id", "held_out"])


OP9_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] END AS prev, ls[i + 1] AS next
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
w AS (SELECT doc_id, pos, coalesce(prev, chr(10)) AS prev, coalesce(next, chr(10)) AS next, list_transform(
  regexp_extract_all(line, '[^\x09-\x0D ]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ws FROM l),
k AS (SELECT doc_id, pos, prev, next, ws, len(ws) AS n, ws[1] AS w1, ws[2] AS w2, array_to_string(ws, ' ') AS line FROM w WHERE len(ws) >= 3),
leaf AS (SELECT n, w1, w2 FROM (SELECT DISTINCT n, w1, w2, prev, next FROM k) GROUP BY ALL HAVING count(*) >= 5),
c AS (SELECT k.* FROM k JOIN leaf USING (n, w1, w2)),
t AS (SELECT n, w1, w2, line, prev, next, i, ws[i] AS word FROM (SELECT n, w1, w2, line, prev, next, ws, unnest(range(1, n + 1)) AS i FROM c)),
con AS (SELECT n, w1, w2, i, word, true AS constant FROM (SELECT DISTINCT n, w1, w2, i, word, prev, next FROM t WHERE word <> '<*>')
  GROUP BY n, w1, w2, i, word HAVING count(*) >= 5),
tem AS (SELECT n, w1, w2, line, string_agg(CASE WHEN constant THEN word ELSE '<*>' END, ' ' ORDER BY i) AS template
  FROM (SELECT DISTINCT n, w1, w2, line, i, word FROM t) LEFT JOIN con USING (n, w1, w2, i, word)
  GROUP BY n, w1, w2, line HAVING count(constant) >= ceil(n * 0.8)),
good AS (SELECT n, w1, w2, template FROM (SELECT DISTINCT n, w1, w2, template, prev, next FROM c JOIN tem USING (n, w1, w2, line))
  GROUP BY ALL HAVING count(*) >= 5),
gone AS (SELECT DISTINCT doc_id, pos FROM c JOIN tem USING (n, w1, w2, line) JOIN good USING (n, w1, w2, template)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op9_line_templates", OP9_SQL)
def op9_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    # contexts as the SQL counts them; the pipeline counts families of documents
    kept = line_templates.dedup(table(spark, folder, "documents").select("doc_id", "text"), by="neighbours", fields_agree=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_kd_shards")
def op3_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    placed = kd_shards.assign(documents, kd_shards.metadata(F.col("text")), shards=24, keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op5_repeats")
def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = repeats.find(documents, length=400, keep="none")
    return repeats.remove(documents, found, keep=["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_graph_ann")
def op2_graph_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return graph_ann.search(vectors.where("vec_id % 20 = 0"), graph_ann.index(vectors, k=20))


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents").select("doc_id", "text"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by hash, are periodic from some word on, as the query asks."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g, n = F.floor(h / 10), F.size("_w")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    periodic = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(
        "_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = documents.select("doc_id", "text", F.when(chosen, words).alias("_w")).withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return words.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


OP11_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS h FROM documents, tab),
w0 AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
w1 AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a, g FROM w0),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
  lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM w1),
gram AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 16], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(0, n - 15)) AS i FROM d WHERE n >= 24)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (SELECT doc_id, start, length, period FROM run QUALIFY row_number() OVER (PARTITION BY doc_id
  ORDER BY CAST(length AS HUGEINT) * 1000000000000000000 // period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS s FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS s FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM run)) k
  LEFT JOIN gone USING (doc_id, i) WHERE gone.doc_id IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, length * 1000 // period AS exponent_milli,
  coalesce(listed.s, sha256('')) AS runs_sha256, sha256(coalesce(kept.s, array_to_string(w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_periodic_runs", OP11_SQL)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find(with_planted_runs(table(spark, folder, "documents")), keep=["doc_id"])
    best = F.col("strongest")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=4, scale=256)
    made = whitening.whiten(vectors, model, keep=["vec_id"])
    known = model or {"n": 0, "explained": [], "identity_error": 0.0}
    return made.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened")).select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(known["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(e) for e in known["explained"]]).cast("array<double>"), F.col("_k")).alias("explained"),
        F.lit(known["identity_error"]).alias("identity_error"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, folder, "documents").select("doc_id", "text")
    cut = packing.pieces(documents, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], capacity=2048, with_ids=False)
    return packing.pack(cut, capacity=2048)
