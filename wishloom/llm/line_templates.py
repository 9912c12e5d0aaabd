"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes by its number of words and then by its
first `lead` words, where a word with a digit counts as a variable field. Inside a
leaf a word is a constant of its position if it stands there in at least
`min_contexts` different contexts; all other positions are variable. Constants
and variables make the line's template. A template is dropped, with all its
lines, if at least `similarity` of its positions are constant and it recurs in
at least `min_contexts` contexts. With fields_agree a masked word counts as agreeing, if at
least two words and half of the line are constant: `Page 3 of 9` is a template.
A field without a digit still counts against `similarity`, since a short template
with such a field is no different from short sentences that begin alike.

A context is a family of documents: a text and all texts that near copies link it
to. Boilerplate recurs in many families, as single lines or in blocks; a line that
recurs only because its document was copied, exactly or with edits, is in one.
So copies keep their lines (they are the business of document dedup), however
many there are. `families` links texts that share a band of a min-hash over
triples of words and at least ALIKE of the triples (measured on their SKETCH
least hashes); only leaves with a template in `min_contexts` different texts need
it. Near copies that share no band, or less than ALIKE with the first text of
every band, count as families of their own; texts that share ALIKE of their
triples through boilerplate count as one.

by="neighbours" takes the pair of lines around a line as its context, as the SQL
of op9 does: then edits near a line make contexts, and inner lines of a block have one.

Work: two scans of the texts that shuffle two hashes a line, then the lines of
leaves that recur, then the sketches of texts that hold candidates. Counts of contexts are two-stage aggregations, so a line in
a third of all documents is combined before it moves. Positions to drop go back
to the documents by a join, as a broadcast only if they are few bytes.

Defined cases: a null text stays null; an empty text stays empty; blank lines and
lines of fewer than `min_words` words stay; null ids are ids; rows with equal
id and text get equal results; other columns pass through untouched; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishloom.llm.components import components
from wishloom.llm.sizes import BROADCAST_BYTES, measured
from wishloom.plans.scale import settle, unnest

VARIABLE = "<*>"
WORD = r"[^\x09-\x0D ]+"
SKETCH = 96  # least hashes kept of a text
BANDS = 12
ALIKE = 0.5  # share of word triples; two texts of one original differ by the edits of both


def _masked(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(word)


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _lines(documents: DataFrame, key: str, text: str, lead: int, min_words: int) -> DataFrame:
    """One row per line of enough words: document, position, words, context and leaf."""
    around = _bind(_split(F.col(f"`{text}`")), lambda ls: F.transform(ls, lambda line, i: F.struct(
        i.alias("pos"), line.alias("line"),
        F.xxhash64(F.coalesce(F.get(ls, i - 1), F.lit("\n")), F.coalesce(F.get(ls, i + 1), F.lit("\n"))).alias("context"))))
    rows = unnest(documents.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("h"), around.alias("ls")),
                  "ls", "doc", "h")
    words = rows.withColumn("words", F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).where(F.size("words") >= min_words)
    return words.withColumn("leaf", F.xxhash64(F.size("words"), *[_masked(F.get("words", i)) for i in range(lead)]))


def _contexts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, "context").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("contexts"))


def _templates(inside: DataFrame, min_contexts: int, similarity: float, fields_agree: bool) -> DataFrame:
    """Lines of templates that recur, once each: leaf, id, template."""
    standing = F.transform(F.split("line", " "), lambda w, i: F.struct(
        i.alias("i"), w.alias("word"), F.xxhash64(F.col("leaf"), i, w).alias("place")))
    places = unnest(inside.select("context", standing.alias("ws")), "ws", "context").where(F.col("word") != VARIABLE)
    constants = settle(_contexts(places, "place").where(F.col("contexts") >= min_contexts).select("place", F.lit(True).alias("constant")))
    distinct = inside.groupBy("leaf", "id").agg(F.min("line").alias("line"))
    agreeing = F.col("constants") >= F.ceil(F.col("n") * similarity)
    if fields_agree:
        agreeing = (F.col("constants") + F.col("fields") >= F.ceil(F.col("n") * similarity)) & (
            F.col("constants") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2)))
    templates = settle(
        unnest(distinct.select("leaf", "id", standing.alias("ws")), "ws", "leaf", "id")
        .join(measured(constants, 40), "place", "left")
        .groupBy("leaf", "id").agg(
            F.count("constant").alias("constants"), F.count_if(F.col("word") == VARIABLE).alias("fields"), F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(F.struct("i", F.when(F.col("constant") & (F.col("word") != VARIABLE), F.col("word")).otherwise(F.lit(VARIABLE)).alias("part")))).alias("parts"))
        .where(agreeing)
        .select("leaf", "id", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("template"))
        .withColumn("of", F.xxhash64("template"))
    )
    known = inside.select("leaf", "id", "context").join(measured(templates.select("leaf", "id", "of"), 48), ["leaf", "id"])
    return settle(templates.join(_contexts(known, "leaf", "of").where(F.col("contexts") >= min_contexts), ["leaf", "of"]).select(
        "leaf", "id", "template"))


def _sketch(text: Column) -> Column:
    """The SKETCH least hashes of three words in a row."""
    return F.slice(F.sort_array(F.array_distinct(_bind(F.split(F.lower(text), r"[\x09-\x0D ]+"), lambda ws: F.transform(
        ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))))), 1, SKETCH)


def _bands(sketch: Column) -> Column:
    """Hashes of the least values of two buckets each; null where both are empty."""
    least = F.transform(F.sequence(F.lit(0), F.lit(2 * BANDS - 1)), lambda b: F.get(
        F.filter(sketch, lambda x: F.pmod(x, F.lit(2 * BANDS)) == b), F.lit(0)))
    return _bind(least, lambda ms: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.when(
        F.coalesce(F.get(ms, 2 * i), F.get(ms, 2 * i + 1)).isNotNull(), F.xxhash64(i, F.get(ms, 2 * i), F.get(ms, 2 * i + 1)))))


def families(documents: DataFrame, text: str = "text", among: DataFrame | None = None) -> DataFrame:
    """Texts that have a near copy: h (hash of the text) and family (least hash linked to it).

    among: settled table of the hashes h to look at; all texts if None.
    """
    texts = documents.select(F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text")).where("text is not null")
    few = among is not None and 16 * among.count() <= BROADCAST_BYTES
    if few:
        texts = texts.join(F.broadcast(among), "h", "left_semi")
    made = texts.select("h", _sketch(F.col("text")).alias("sketch")).dropDuplicates(["h"])
    sketches = settle(made if few or among is None else made.join(among, "h", "left_semi"))
    marks = settle(sketches.select("h", F.explode(_bands(F.col("sketch"))).alias("mark")).where("mark is not null"))
    shared = settle(marks.groupBy("mark").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first < last").select("mark", "first"))
    links = settle(marks.join(measured(shared, 32), "mark").where("h <> first").select("h", "first").distinct())
    firsts = settle(sketches.join(measured(links.select(F.col("first").alias("h")).distinct(), 16), "h", "left_semi").select(
        F.col("h").alias("first"), F.col("sketch").alias("other")))
    pairs = links.join(sketches, "h").join(measured(firsts, 24 + 8 * SKETCH), "first")
    # of the SKETCH least values of both, those that both have
    union = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    both = _bind(union, lambda u: F.size(F.array_intersect(F.array_intersect("sketch", "other"), u)) / F.size(u))
    found = components(pairs.where(both >= ALIKE).select(F.col("h").alias("a"), F.col("first").alias("b")))
    return found.select(F.col("node").alias("h"), F.col("component").alias("family"))


def recurring(documents: DataFrame, key: str = "doc_id", text: str = "text", lead: int = 2, min_words: int = 3,
              min_contexts: int = 5, similarity: float = 0.8, by: str = "families", fields_agree: bool = True) -> DataFrame:
    """Lines whose template is to be dropped: doc, h (hash of the text), pos, template."""
    if by not in ("families", "neighbours"):
        raise ValueError(f"by is families or neighbours, not {by}")
    lines = _lines(documents, key, text, lead, min_words)
    if by == "families":
        lines = lines.withColumn("context", F.col("h"))
    leaves = settle(_contexts(lines, "leaf").where(F.col("contexts") >= min_contexts).select("leaf"))
    inside = settle(lines.join(measured(leaves, 40), "leaf", "left_semi").select(
        "doc", "h", "pos", "leaf", "context", F.array_join(F.transform("words", _masked), " ").alias("line"))
        .withColumn("id", F.xxhash64("line")))
    dropped = _templates(inside, min_contexts, similarity, fields_agree)
    if by == "families":
        inside = settle(inside.join(measured(settle(dropped.select("leaf").distinct()), 40), "leaf", "left_semi"))
        family = settle(families(documents, text, settle(inside.select("h").distinct())))
        inside = settle(inside.join(measured(family, 32), "h", "left").withColumn("context", F.coalesce("family", "h")).drop("family"))
        dropped = _templates(inside, min_contexts, similarity, fields_agree)
    return inside.join(measured(dropped, 60 + F.octet_length("template")), ["leaf", "id"]).select("doc", "h", "pos", "template")


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Documents without their recurring lines; columns as before plus n_lines and n_dropped."""
    hits = settle(recurring(documents, key, text, **how).groupBy("doc", "h").agg(F.collect_set("pos").alias("drop")))
    content = F.col(f"`{text}`")
    packed = documents.select(F.struct(*[f"`{c}`" for c in documents.columns]).alias("row"), F.col(f"`{key}`").alias("doc"),
                              F.xxhash64(content).alias("h"), content.alias("content"))
    marked = packed.join(measured(hits, 64 + 8 * F.size("drop")).withColumnRenamed("doc", "_doc").withColumnRenamed("h", "_h"),
                         F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    kept = F.when(F.col("drop").isNull(), F.col("content")).otherwise(_bind(_split(F.col("content")), lambda ls: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drop")), lambda i: F.get(ls, i)), "\n")))
    return marked.select(
        *[kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(_split(F.col("content"))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
