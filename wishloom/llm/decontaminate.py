"""Benchmark decontamination with suffix arrays over the training documents.

Each block of documents is a shard. Its suffix array holds, in the order of
their first `depth` words, the suffixes that begin like some window of the
benchmark (their first words are looked up first; a suffix that begins
otherwise cannot match). Every benchmark suffix is found in it by binary
search, all of them at once, which gives the range of training suffixes that
share its window and so all places where it occurs verbatim. Consecutive
places join to spans; the longest span is the longest verbatim match.

Benchmark words lie in the shared folder in slices of about `slice_bytes`, a
table of any size is read slice by slice, and documents never move: the job has
no shuffle of texts, and a hot passage costs only its own occurrences.

Words: A-Z lower-cased, then runs of ASCII letters, digits and characters
beyond ASCII. A window is `window` consecutive words of an item; an item of
fewer words, but not none, is one window.

Defined cases: a null or wordless text has no words and no hits; items with
null id or text, or without words, match nothing; repeated items count once by
id; an empty benchmark leaves all documents clean; repeated documents get the
same answer; extra columns stay, and columns with the result's names are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishloom.llm.arrowmap import append, neutral, tidy
from wishloom.llm.blobs import mapped, put
from wishloom.llm.bytetext import ALNUM, blocks, word_hashes, words
from wishloom.plans.scale import scratch_folder

FIELDS = "n_words bigint, n_hit bigint, longest bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
HITS_AT_ONCE = 1_000_000


def index(benchmark: DataFrame, window: int = 10, slice_bytes: int = 16_000_000,
          item_id: str = "item_id", text: str = "text") -> dict:
    """Write the benchmark's windows to the shared folder; returns their addresses."""
    folder = scratch_folder(benchmark.sparkSession, "benchmark")
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where(
        "id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts = [], [], []
        for batch in batches:
            for lo, hi, buf, off in blocks(batch.column(1)):
                start, end, owner = words(buf, off, ALNUM)
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                hashes.append(word_hashes(buf, start, end))
                counts.append(np.bincount(owner, minlength=hi - lo))
        if not ids or not sum(c.sum() for c in counts):
            return
        values, counts = np.concatenate(hashes), np.concatenate(counts)
        first = np.cumsum(counts) - counts
        size = np.minimum(counts, window)
        windows = np.where(counts > 0, counts - size + 1, 0)
        item = np.repeat(np.arange(len(ids)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[item]
        vocabulary = np.unique(values)
        code = np.concatenate((np.searchsorted(vocabulary, values) + 1, np.zeros(window, np.int64)))
        rows = np.where(np.arange(window) < size[item][:, None], code[at[:, None] + np.arange(window)], 0).astype(">u4")
        names = np.array([i.encode() for i in ids], dtype=bytes)
        part = f"slice{TaskContext.get().partitionId()}"
        yield pa.RecordBatch.from_pydict({n: [put(folder, f"{part}-{n}", a)] for n, a in (
            ("vocabulary", vocabulary), ("rows", rows), ("size", size[item].astype(np.int32)),
            ("item", item.astype(np.int64)), ("names", names))})

    parts = max(1, -(-total // slice_bytes))
    written = items.repartition(parts, F.xxhash64("id", "text")).mapInArrow(tidy(write), "vocabulary string, rows string, size string, item string, names string")
    return {"window": window, "slices": [r.asDict() for r in written.collect()]}


def _keys(rows: np.ndarray, fill: int, size: np.ndarray) -> np.ndarray:
    """Fixed-width sortable keys; positions from `size` on hold `fill`."""
    out = np.where(np.arange(rows.shape[1]) < size[:, None], rows, fill).astype(">u4")
    return np.ascontiguousarray(out).view(f"S{4 * rows.shape[1]}").ravel()


class _Slice:
    """Windows of one slice, sorted, with the words that may start one."""

    def __init__(self, spec: dict):
        self.vocabulary = np.asarray(mapped(spec["vocabulary"]))
        rows, size, item = (np.asarray(mapped(spec[n])) for n in ("rows", "size", "item"))
        self.names = mapped(spec["names"])
        distinct, of = np.unique(_keys(rows, 0, size), return_inverse=True)
        first = np.zeros(len(distinct), np.int64)
        first[of] = np.arange(len(of))
        self.rows, self.size = rows[first], size[first]
        order = np.argsort(of, kind="stable")
        self.item, self.bounds = item[order], np.searchsorted(of[order], np.arange(len(distinct) + 1))
        self.low, self.high = _keys(self.rows, 0, self.size), _keys(self.rows, 0xFFFFFFFF, self.size)
        self.single = np.unique(self.rows[self.size == 1, 0])
        self.pairs = np.unique(_pair(self.rows[self.size > 1, 0], self.rows[self.size > 1, 1])) if rows.shape[1] > 1 else np.zeros(0, np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _search(part: _Slice, window: int, hashes: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(training position, window) of all occurrences in one shard, in portions."""
    n = len(hashes)
    at = np.minimum(np.searchsorted(part.vocabulary, hashes), len(part.vocabulary) - 1)
    code = np.where(part.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)
    code = np.concatenate((code, np.zeros(window, np.uint32)))
    following = np.where(np.arange(1, n + 1) < last, code[1:n + 1], 0)
    begins = (code[:n] > 0) & (_among(_pair(code[:n], following), part.pairs) | _among(code[:n], part.single))
    place = np.flatnonzero(begins)
    if not len(place):
        return
    steps = place[:, None] + np.arange(window)
    suffix = np.where(steps < last[place][:, None], code[np.minimum(steps, n)], 0).astype(">u4")
    keys = np.ascontiguousarray(suffix).view(f"S{4 * window}").ravel()
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], place[order]
    lo, hi = np.searchsorted(keys, part.low, side="left"), np.searchsorted(keys, part.high, side="right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return
    portion = np.cumsum((hi - lo)[found]) // HITS_AT_ONCE
    for p in np.unique(portion):
        some = found[portion == p]
        count = (hi - lo)[some]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield place[np.repeat(lo[some], count) + inside], np.repeat(some, count)


def find(documents: DataFrame, bench: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with n_words, n_hit, longest, items (ids as sorted strings), spans (word positions)."""
    window, slices = bench["window"], bench["slices"]
    loaded: list[_Slice] = []

    def work(column: pa.Array) -> list:
        if not loaded and len(slices) == 1:
            loaded.append(_Slice(slices[0]))
        n_words, n_hit, longest, items, spans = [], [], [], [], []
        for lo, hi, buf, off in blocks(column):
            docs = hi - lo
            start, end, owner = words(buf, off, ALNUM)
            hashes = word_hashes(buf, start, end)
            count = np.bincount(owner, minlength=docs)
            last = np.cumsum(count)[owner] if len(owner) else np.zeros(0, np.int64)
            cover = np.zeros(len(hashes) + 1, np.int64)
            named: list[set] = [set() for _ in range(docs)]
            for part in loaded or map(_Slice, slices):
                for place, which in _search(part, window, hashes, last):
                    np.add.at(cover, place, 1)
                    np.add.at(cover, place + part.size[which], -1)
                    both = np.unique(_pair(owner[place], which))
                    for d, w in zip((both >> np.uint64(32)).tolist(), (both & np.uint64(0xFFFFFFFF)).tolist(), strict=True):
                        named[d].update(part.names[part.item[part.bounds[w]:part.bounds[w + 1]]].tolist())
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.zeros(len(hit), dtype=bool)
            edge[np.minimum((np.cumsum(count) - count)[count > 0], max(len(hit) - 1, 0))] = True
            run_start = np.flatnonzero(hit & (edge | ~np.concatenate(([False], hit[:-1])))) if len(hit) else np.zeros(0, np.int64)
            ends_doc = np.concatenate((edge[1:], [True])) if len(hit) else edge
            run_end = np.flatnonzero(hit & (ends_doc | ~np.concatenate((hit[1:], [False])))) + 1 if len(hit) else run_start
            first = np.cumsum(count) - count
            of = owner[run_start] if len(run_start) else run_start
            lists: list[list] = [[] for _ in range(docs)]
            for d, a, b in zip(of.tolist(), (run_start - first[of]).tolist(), (run_end - first[of]).tolist(), strict=True):
                lists[d].append({"start": a, "end": b})
            n_words += count.tolist()
            n_hit += np.bincount(owner[hit], minlength=docs).tolist()
            longest += [max((s["end"] - s["start"] for s in x), default=0) for x in lists]
            items += [sorted(i.decode() for i in x) for x in named]
            spans += lists
        return [n_words, n_hit, longest, items, spans]

    return append(documents, [text], keep, FIELDS, work)


def remove(documents: DataFrame, bench: dict, text: str = "text") -> DataFrame:
    """The documents without any hit, with their own columns."""
    plain, text = neutral(documents, text)
    return find(plain, bench, text).where("n_hit = 0").select(*plain.columns).toDF(*documents.columns)
