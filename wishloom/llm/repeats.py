"""Exact repeats of long byte strings, by longest-previous-factor arrays.

Every string of `length` bytes has an anchor: the place of its least hash among
its `GRAM`-byte grams (the first, if several). Equal strings have equal anchors at
equal distance. So consecutive strings with one anchor make a segment, segments
are grouped by the hash of the anchor's gram, and only segments of one group
can share a string.

1. One row-local pass gives a row per segment: anchor hash, digest of the
   segment, document, start, strings in it. No text leaves the task.
2. Segments with equal digests are equal: all their strings repeat. They are
   counted by one aggregation, which also names the first; a group of copies of
   any size is combined before it moves.
3. Groups that hold different segments need a closer look. Their distinct
   segments (one each) are cut out of the texts again, dealt by anchor, and
   groups are put together to texts of about `SORT_BYTES`. There the suffix array,
   by prefix doubling, and the longest previous factors, from the previous and
   next smaller positions in suffix order, say which strings occur before and
   which come first. Groups larger than `GROUP_BYTES` are dealt once more by the
   strings themselves, one row per string and digest, and counted; so no task
   holds an unbounded group.
4. Strings found to repeat are joined back to all segments with their digest
   and merged to spans per document.

`keep="first"` keeps the first occurrence (least document key, then position) of
each repeated string; `keep="none"` marks all of them.

Defined cases: null counts as empty; texts shorter than `length` bytes have no
spans; matches never cross documents; rows equal in key and text are separate
documents, hence repeats of each other (under keep="first" the copies of such
a row are equal rows and share one answer: later copies of the text are told
apart by key only); null keys are keys; extra columns pass through; an empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishloom.llm.arrowmap import append, pieces, tidy
from wishloom.llm.bytetext import Rolling, blocks, mix
from wishloom.llm.sizes import measured
from wishloom.plans.scale import scratch_folder

GRAM = 100
SORT_BYTES = 500_000
GROUP_BYTES = 1_500_000


def _minima(packed: np.ndarray, width: int) -> np.ndarray:
    """Least value of every stretch of `width` values, by doubling."""
    out, have = packed, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def segments(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, start, number of strings, anchor hash and digest of every segment of a block."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none
    rolling = Rolling(buf)
    at = np.arange(len(buf) - gram + 1)
    hashes = rolling(at, at + gram)
    bits = np.uint64(max(1, int(len(buf)).bit_length()))
    least = _minima((hashes >> bits) << bits | at.astype(np.uint64), length - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(off, start, side="right") - 1
    valid = start + length <= off[doc + 1]
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(first)
    if not len(begin):
        return none, none, none, none, none
    number = np.add.reduceat(valid.astype(np.int64), begin)
    last = begin + number - 1 + length
    digest = rolling(begin, last).view(np.int64)
    return doc[begin], begin - off[doc[begin]], number, mix(hashes[anchor[begin]]).view(np.int64), digest


def _scan(documents: DataFrame, key: Column, content: Column, length: int, gram: int) -> DataFrame:
    """doc, h, anchor, digest, start, n of every segment of every text."""
    fields = "start bigint, n bigint, anchor bigint, digest bigint"
    keys = documents.select(key.alias("doc"), F.xxhash64(content).alias("h"), content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            for lo, _, buf, off in blocks(batch.column(2), 1_000_000):
                doc, *found = segments(buf, off, length, gram)
                if len(doc):
                    rows = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, found)],
                        names=["doc", "h", "start", "n", "anchor", "digest"])

    from pyspark.sql.types import StructType

    schema = StructType([keys.schema["doc"], keys.schema["h"], *StructType.fromDDL(fields).fields])
    return keys.mapInArrow(tidy(run), schema)


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first `length` bytes (prefix doubling, from 8 bytes on)."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i:n + i]
    rank, have = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while have < length:
        step = min(have, length - have)
        following = np.zeros(n, np.int64)
        following[:n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + following, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def smaller_before(order: np.ndarray) -> np.ndarray:
    """For every place in suffix order the nearest earlier place with a smaller text position, else -1."""
    near = np.arange(len(order)) - 1
    todo = np.flatnonzero((near >= 0) & (order[near] > order))
    while len(todo):
        near[todo] = near[near[todo]]
        todo = todo[(near[todo] >= 0) & (order[near[todo]] > order[todo])]
    return near


def previous_factors(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the given text positions: does the string occur before, and does it occur elsewhere.

    Positions in suffix order; the previous and next smaller position share
    the longest factor with a place, and share the whole string if ranks agree.
    """
    order = np.lexsort((position, rank[position]))
    place, value = position[order], rank[position][order]
    before = smaller_before(place)
    after = len(place) - 1 - smaller_before(place[::-1])[::-1]
    earlier = (before >= 0) & (value[before] == value)
    follow = np.minimum(after, len(place) - 1)
    earlier |= (after < len(place)) & (value[follow] == value)
    same = value[1:] == value[:-1]
    elsewhere = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    out_earlier, out_elsewhere = np.zeros(len(order), bool), np.zeros(len(order), bool)
    out_earlier[order], out_elsewhere[order] = earlier, elsewhere
    return out_earlier, out_elsewhere


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"at": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUNS = "array<struct<at:bigint,n:bigint>>"


def _compare(length: int):
    """Group texts of consecutive anchors, find repeats among their segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, digests, raws, size = [], [], [], 0

        def settle() -> pa.RecordBatch:
            text = np.frombuffer(b"".join(raws), np.uint8)
            ends = np.cumsum([len(r) for r in raws])
            number = np.array([len(r) - length + 1 for r in raws])
            seg = np.repeat(np.arange(len(raws)), number)
            position = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + (ends - number - length + 1)[seg]
            earlier, elsewhere = previous_factors(suffix_ranks(text, length), position)
            cuts = np.cumsum(number)[:-1]
            later, every = [_runs(x) for x in np.split(earlier, cuts)], [_runs(x) for x in np.split(elsewhere, cuts)]
            kept = [i for i, x in enumerate(every) if x]
            struct = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([anchors[i] for i in kept], pa.int64()), pa.array([digests[i] for i in kept], pa.int64()),
                 pa.array([later[i] for i in kept], struct), pa.array([every[i] for i in kept], struct)],
                names=["anchor", "digest", "later", "every"])

        for batch in batches:
            for a, d, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if raws and size + len(raw) > SORT_BYTES and a != anchors[-1]:
                    yield settle()
                    anchors, digests, raws, size = [], [], [], 0
                anchors.append(a)
                digests.append(d)
                raws.append(raw)
                size += len(raw)
        if raws:
            yield settle()
    return run


def _cut(listed: DataFrame) -> DataFrame:
    """The bytes of listed segments out of their texts: anchor, digest, raw, doc, start."""
    from pyspark.sql.types import StructType

    schema = StructType([*StructType.fromDDL("anchor bigint, digest bigint, raw binary, start bigint, h bigint").fields, listed.schema["doc"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            rows = {n: [] for n in ("anchor", "digest", "raw", "start", "of")}
            for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                coded = text.encode()
                for w in wanted:
                    rows["anchor"].append(w["anchor"])
                    rows["digest"].append(w["digest"])
                    rows["start"].append(w["start"])
                    rows["raw"].append(coded[w["start"]:w["start"] + w["bytes"]])
                    rows["of"].append(i)
            of = pa.array(rows["of"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["anchor"], pa.int64()), pa.array(rows["digest"], pa.int64()), pa.array(rows["raw"], pa.binary()),
                 pa.array(rows["start"], pa.int64()), batch.column(1).take(of), batch.column(0).take(of)],
                names=["anchor", "digest", "raw", "start", "h", "doc"])

    return listed.select("doc", "h", "content", "wanted").mapInArrow(tidy(run), schema)


def _single_strings(big: DataFrame, length: int) -> DataFrame:
    """Large groups: one row per string, dealt by its digest and counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            for i, raw in enumerate(batch.column(2).to_pylist()):
                at = np.arange(len(raw) - length + 1)
                of = pa.array(np.full(len(at), i))
                string = Rolling(np.frombuffer(raw, np.uint8))(at, at + length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(at), pa.array(string),
                     *[batch.column(j).take(of) for j in (3, 4, 5)]],
                    names=["anchor", "digest", "at", "string", "start", "h", "doc"])

    from pyspark.sql.types import StructType

    schema = StructType([*StructType.fromDDL("anchor bigint, digest bigint, at bigint, string bigint, start bigint, h bigint").fields,
                         big.schema["doc"]])
    rows = big.select("anchor", "digest", "raw", "start", "h", "doc").mapInArrow(tidy(run), schema)
    place = F.struct("doc", "h", (F.col("start") + F.col("at")).alias("p"))
    counted = rows.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("least")).where("times > 1")
    found = rows.join(counted, ["anchor", "string"]).withColumn("is_first", place.eqNullSafe(F.col("least")))
    one = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.struct(F.col("at"), F.lit(1).cast("long").alias("n")))))
    return found.groupBy("anchor", "digest").agg(one(~F.col("is_first")).alias("later"), one(F.lit(True)).alias("every"))


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, keep: str = "first",
         gram: int = GRAM) -> DataFrame:
    """doc, h (hash of the text) and merged spans (byte start, end) to remove, for documents that have any."""
    spark = documents.sparkSession
    gram = min(gram, length)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    doc = F.col(f"`{key}`")
    folder = scratch_folder(spark, "repeats")
    _scan(documents, doc, content, length, gram).write.parquet(f"{folder}/segments")
    every = spark.read.parquet(f"{folder}/segments")
    every.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "h", "start", "n")).alias("least")
    ).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    mixed = distinct.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.col("least.n") + length - 1).alias("bytes")).where("kinds > 1")
    distinct.join(mixed, "anchor").select(
        F.col("least.doc").alias("doc"), F.col("least.h").alias("h"), (F.col("bytes") > GROUP_BYTES).alias("big"),
        F.struct("anchor", "digest", F.col("least.start").alias("start"), (F.col("least.n") + length - 1).alias("bytes")).alias("w")
    ).groupBy("doc", "h", "big").agg(F.collect_list("w").alias("wanted")).write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")
    texts = documents.select(doc.alias("doc"), F.xxhash64(content).alias("h"), content.alias("content"))
    on = lambda right: (F.col("doc").eqNullSafe(right["_doc"])) & (F.col("h") == right["_h"])
    listed = measured(wanted, 64 + 40 * F.size("wanted")).withColumnsRenamed({"doc": "_doc", "h": "_h"})
    cut = _cut(texts.join(listed, on(listed)).where("not big"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    close = cut.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc", "start", "h", "digest").select(
        "anchor", "digest", "raw").mapInArrow(tidy(_compare(length)), f"anchor bigint, digest bigint, later {RUNS}, every {RUNS}")
    if wanted.where("big").limit(1).count():
        close = close.unionByName(_single_strings(_cut(texts.join(listed, on(listed)).where("big")), length))
    close.groupBy("anchor", "digest").agg(F.first("later").alias("later"), F.first("every").alias("every")).write.parquet(f"{folder}/close")
    close = spark.read.parquet(f"{folder}/close")
    distinct.join(close, ["anchor", "digest"], "left").where("times > 1 or every is not null").write.parquet(f"{folder}/judged")
    judged = measured(spark.read.parquet(f"{folder}/judged"), 96 + 16 * F.coalesce(F.size("every"), F.lit(0)) * 2)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n")))
    own = F.col("doc").eqNullSafe(F.col("least.doc")) & (F.col("h") == F.col("least.h")) & (F.col("start") == F.col("least.start"))
    runs = F.when(F.col("times") > 1, whole).otherwise(F.col("every")) if keep == "none" else F.when(own, F.col("later")).otherwise(whole)
    hit = every.join(judged, ["anchor", "digest"])
    spans = F.transform(runs, lambda r: F.struct((F.col("start") + r["at"]).alias("start"), (F.col("start") + r["at"] + r["n"] - 1 + length).alias("end")))
    found = hit.select("doc", "h", spans.alias("spans")).where("size(spans) > 0").groupBy("doc", "h").agg(
        F.flatten(F.collect_list("spans")).alias("_spans"))
    append(found, ["_spans"], ["doc", "h"], "spans array<struct<start:bigint,end:bigint>>", lambda c: [[_merged(x) for x in c.to_pylist()]]
           ).write.parquet(f"{folder}/spans")
    return spark.read.parquet(f"{folder}/spans")


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def remove(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with n_bytes, n_removed, n_spans, and `kept`, the bytes that are left."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    spans = measured(found, 64 + 24 * F.size("spans")).withColumnsRenamed({"doc": "_doc", "h": "_h"})
    kept = [c for c in (documents.columns if keep is None else keep) if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    rows = documents.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{key}`").alias("doc"),
                            F.xxhash64(content).alias("h"), content.alias("content"))
    joined = rows.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")

    def work(contents: pa.Array, spans: pa.Array) -> list:
        size, removed, number, left = [], [], [], []
        for coded, cuts in zip(contents.cast(pa.large_binary()).to_pylist(), spans.to_pylist(), strict=True):
            cuts = cuts or []
            at, rest = 0, []
            for c in cuts:
                rest.append(coded[at:c["start"]])
                at = c["end"]
            rest.append(coded[at:])
            left.append(b"".join(rest))
            size.append(len(coded))
            removed.append(len(coded) - len(left[-1]))
            number.append(len(cuts))
        return [size, removed, number, left]

    return append(joined, ["content", "spans"], ["row"], "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", work).select(
        "row.*", "n_bytes", "n_removed", "n_spans", "kept")
