"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the hashes of its distinct shingles. Sizes fall into bands
that grow by the factor 1/threshold, so a set's partners of its size or less lie
in its own band and the one below. A band cuts the hash universe into m
segments. Two sets over the threshold differ in at most H elements, H by
their sizes. Give every segment of the larger set a number v: 0 (not used), 1
(partner's segment is equal) or 2 (partner's segment is equal but for one
element). If the numbers sum to more than H, one of the conditions holds.

Allocation by cost: sets index all their segments; a set asks with as few as
suffice, those first that hold most elements outside the common ones. (Common
elements come from a bounded sample; it steers cost only, never the result.)
Bands of small sets use v = 2: they index and ask with the segment and
its one-deletion neighbourhood, which is short there. Bands of larger sets use
v = 1, where a neighbourhood would multiply the index.

Signatures travel packed: a row per task piece and part, 8 bytes a signature.
Sets that are equal inside a piece are sent once. Where a signature meets, members
are compared with one member that asked (a star, not all pairs), and each
document first only with the partner it meets most often. Links found that way
give components. What is left are signatures whose members lie in different
components: there all pairs across components with an asker are tried in blocks
of bounded size. Before two sets travel to be compared exactly, a parity bitmap,
a lower bound of their difference, must let the pair pass. So no link between documents of different components
is lost, and pairs inside a group of near copies are never listed.

All comparisons are exact on the sets of hashes (64 bits): the whole set of a
document goes once to the partner it is compared with; partners with many are
salted.

Defined cases: null and empty texts, and texts without words, have size 0 and
are linked with nothing; fewer words than a shingle make one; a null id is
linked with nothing and has a null component; rows that share an id are one
node; equal rows are one node; extra columns are ignored; an empty table
stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishloom.llm.arrowmap import pieces, tidy
from wishloom.llm.blobs import mapped, put
from wishloom.llm.bytetext import SPACED, Rolling, blocks, mix, word_hashes, words
from wishloom.llm.components import components
from wishloom.llm.sizes import measured
from wishloom.plans.scale import scratch_folder, settle

SMALL = 40  # bands up to this size use one-deletion neighbourhoods
SAMPLE, COMMON = 4000, 200_000  # documents sampled and common elements kept for the cost model
CELL = 4096
PARITY = 16  # least 64-bit words of a parity bitmap; larger sets have more
GROUP = 500  # comparisons with one partner per salt
PAIRS = 500_000  # pairs of cells tried at once


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block: first document, last + 1, sorted distinct hashes, offsets."""
    for lo, hi, buf, off in blocks(column):
        start, end, owner = words(buf, off, SPACED)
        count = np.bincount(owner, minlength=hi - lo)
        first = np.cumsum(count) - count
        rolling = Rolling(word_hashes(buf, start, end))
        number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(hi - lo), number)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + first[doc]
        value = rolling(at, np.minimum(at + width, first[doc] + count[doc]))
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[new], value[new]
        yield lo, hi, value, np.searchsorted(doc, np.arange(hi - lo + 1))


class Bands:
    """Size bands and the number of segments of each."""

    def __init__(self, up: int, down: int):
        """Threshold up / down, as in 3 / 4."""
        self.up, self.down = up, down
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, low[-1] * down // up + 1))
        self.low = np.array(low)
        self.high = self.low[1:] - 1
        most = self.bound(self.high * down // up, self.high)
        small = self.high <= SMALL
        self.segments = np.where(small, np.where(most < 1, 1, (most + 2) // 2 + (most > 1)), most + 2 + most // 20)
        self.small = small & (most > 0)

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most elements in which sets of these sizes over the threshold differ."""
        return (a + b) * (self.down - self.up) // (self.down + self.up)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def signatures(value: np.ndarray, off: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, asks) of all sets of a block."""
    size = np.diff(off)
    least = -(-size * bands.up // bands.down)
    out: list[tuple] = []
    rare = np.ones(len(value), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, value), len(common) - 1)] != value
    own, lowest = bands.of(size), bands.of(np.maximum(least, 1))
    scrambled = mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for down in range(0, int((own - lowest)[size > 0].max(initial=0)) + 1):
        here = np.flatnonzero((size > 0) & (own - down >= lowest))
        if not len(here):
            continue
        band = own[here] - down
        m = bands.segments[band]
        h = bands.bound(size[here], np.minimum(size[here], bands.high[band]))
        part = np.repeat(np.arange(len(here)), size[here])
        at = np.arange(len(part)) - np.repeat(np.cumsum(size[here]) - size[here], size[here]) + off[here][part]
        base = np.cumsum(m) - m
        slot = base[part] + ((value[at] >> np.uint64(32)) * m[part].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(m.sum())
        cut = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        content = np.zeros(total, np.uint64)
        content[slot[cut]] = np.add.reduceat(scrambled[at], cut)
        filled = np.bincount(slot, minlength=total)
        scarce = np.bincount(slot, rare[at], total)
        of = np.repeat(np.arange(len(here)), m)
        segment = np.arange(total) - base[of]
        place = mix((band[of].astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64))
        sig = mix(content + place)
        need = np.where(bands.small[band], (h + 2) // 2, h + 1)
        order = np.lexsort((-filled, -scarce, of))
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total) - base[of[order]]
        asks = rank < need[of]
        keep = asks | (down == 0)
        out.append((here[of[keep]], sig[keep], asks[keep]))
        neighbours = bands.small[band][part] & (asks[slot] | (down == 0))
        if neighbours.any():
            some = np.flatnonzero(neighbours)
            out.append((here[part[some]], mix(content[slot[some]] - scrambled[at[some]] + place[slot[some]]), asks[slot[some]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ENTRY = np.dtype([("high", "<u4"), ("low", "<u2"), ("doc", "<u2")])
SENT = "kind int, part int, a bigint, b bigint, entries binary, docs binary"


def _send(width: int, bands: Bands, common: np.ndarray, parts: int):
    """Texts to sizes (kind 0), equal sets (kind 1) and packed signatures (kind 2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            for lo, hi, value, off in sets_of(batch.column(1), width):
                ids = batch.column(0).slice(lo, hi - lo)
                size = np.diff(off)
                known = np.asarray(ids.is_valid())
                number = ids.fill_null(0).to_numpy()
                whole = np.add.reduceat(np.concatenate((mix(value), [np.uint64(0)])), np.minimum(off[:-1], len(value))) if hi > lo else value
                usable = np.flatnonzero(known & (size > 0))
                order = usable[np.lexsort((number[usable], whole[usable], size[usable]))]
                same = (whole[order][1:] == whole[order][:-1]) & (size[order][1:] == size[order][:-1])
                first = np.concatenate(([True], ~same)) if len(order) else np.zeros(0, bool)
                chief = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
                copies = np.flatnonzero(~first)
                chosen = np.sort(order[first])
                for at in range(0, len(chosen), 60_000 // 2):
                    mine = chosen[at:at + 60_000 // 2]
                    cuts = np.concatenate(([0], np.cumsum(size[mine])))
                    inside = np.arange(cuts[-1]) - np.repeat(cuts[:-1], size[mine]) + np.repeat(off[mine], size[mine])
                    of, sig, asks = signatures(value[inside], cuts, bands, common)
                    part = (sig % np.uint64(parts)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    packed = np.zeros(len(sig), ENTRY)
                    packed["high"], packed["low"] = sig >> np.uint64(32), (sig >> np.uint64(16)) & np.uint64(0xFFFF)
                    packed["doc"] = of * 2 + asks
                    packed = packed[by]
                    have, begin = np.unique(part[by], return_index=True)
                    docs = number[mine].astype("<i8").tobytes()
                    k = len(have)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, 2), pa.int32()), pa.array(have, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                         pa.array([x.tobytes() for x in np.split(packed, begin[1:])] if k else [], pa.binary()), pa.array([docs] * k, pa.binary())],
                        names=["kind", "part", "a", "b", "entries", "docs"])
                n, c = hi - lo, len(copies)
                spread = int(mix(np.array([int(number[0]) + n & 0x7FFFFFFF], np.uint64))[0] % np.uint64(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [n, c]), pa.int32()), pa.array(np.full(n + c, spread), pa.int32()),
                     pa.concat_arrays([ids, pa.array(number[chief[copies]], pa.int64())]),
                     pa.array(np.concatenate((size, number[order[copies]])), pa.int64()), pa.nulls(n + c, pa.binary()), pa.nulls(n + c, pa.binary())],
                    names=["kind", "part", "a", "b", "entries", "docs"])
    return run


SLICES = 16
MET_NAMES = ["kind", "a", "b", "n", "members"]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of a part: stars (kind 2, b met a n times), groups of three and more (kind 3); sizes and equal sets pass.

    Signatures meet in SLICES of their keys, one after the other, so that
    sorting needs room for a slice and not for the part.
    """
    names, long_list = MET_NAMES, pa.list_(pa.int64())
    keys, docs, asks = [], [], []
    for batch in batches:
        kind = batch.column(0).to_numpy()
        plain = np.flatnonzero(kind < 2)
        if len(plain):
            some = batch.take(pa.array(plain))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(2), some.column(3), pa.array(np.zeros(len(plain), np.int64)), pa.nulls(len(plain), long_list)], names=names)
        for i in np.flatnonzero(kind == 2).tolist():
            entries = np.frombuffer(batch.column(4)[i].as_buffer(), ENTRY)
            table = np.frombuffer(batch.column(5)[i].as_buffer(), "<i8")
            keys.append(entries["high"].astype(np.uint64) << np.uint64(16) | entries["low"])
            docs.append(table[entries["doc"] >> 1])
            asks.append((entries["doc"] & 1).astype(bool))
    if not keys:
        return
    key = np.concatenate(keys)
    del keys
    doc = np.concatenate(docs)
    del docs
    ask = np.concatenate(asks)
    del asks
    of = (key % np.uint64(SLICES)).astype(np.uint8)
    stars, seen = [], np.zeros(0, np.uint64)
    for number in range(SLICES):
        some = of == number
        found, groups = _meet_slice(key[some], doc[some], ask[some])
        stars.append(found)
        if groups is None:
            continue
        group, number_of, begin, code = groups
        fresh = ~np.isin(group, seen)
        seen = np.concatenate((seen, group[fresh]))
        pick = np.flatnonzero(fresh)
        for lo in range(0, len(pick), 1000):
            these = pick[lo:lo + 1000]
            lists = [code[begin[g]:begin[g] + number_of[g]].view(np.int64) for g in these.tolist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            k = len(these)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, 3), pa.int32()), pa.array(group[these].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(number_of[these]),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))], names=names)
    a, b, n = (np.concatenate(c) for c in zip(*stars, strict=True))
    if len(a):
        a, b, n = _added(a, b, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), 2), pa.int32()), pa.array(a), pa.array(b), pa.array(n), pa.nulls(len(a), long_list)], names=names)


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair (a, b) once, with the sum of its n."""
    by = np.lexsort((b, a))
    a, b, n = a[by], b[by], n[by]
    cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a[cut], b[cut], np.add.reduceat(n, cut) if len(cut) else n


def _meet_slice(key: np.ndarray, doc: np.ndarray, ask: np.ndarray) -> tuple[tuple, tuple | None]:
    """Stars (a, b, n) of some signatures, and their groups of three and more (name, size, begin, members of all)."""
    none = np.zeros(0, np.int64)
    if not len(key):
        return (none, none, none), None
    order = np.argsort(key, kind="stable")
    edge = np.concatenate(([True], key[order][1:] != key[order][:-1], [True]))
    single = edge[:-1] & edge[1:]
    order = order[~single]
    key, doc, ask = key[order], doc[order], ask[order]
    if not len(key):
        return (none, none, none), None
    order = np.lexsort((~ask, doc, key))
    key, doc, ask = key[order], doc[order], ask[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc, ask = key[new], doc[new], ask[new]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    number = np.diff(np.append(begin, len(key)))
    some_ask = np.logical_or.reduceat(ask, begin)
    of = np.repeat(np.arange(len(begin)), number)
    top = np.iinfo(np.int64).max
    pivot = np.minimum.reduceat(np.where(ask, doc, top), begin)[of]
    star = (some_ask & (number > 1))[of] & (doc != pivot)
    stars = _added(np.minimum(pivot[star], doc[star]), np.maximum(pivot[star], doc[star]), np.ones(int(star.sum()), np.int64))
    code = (doc.astype(np.uint64) << np.uint64(1)) | ask
    group = np.add.reduceat(mix(code), begin)
    large = np.flatnonzero(some_ask & (number > 2))
    _, pick = np.unique(group[large], return_index=True)
    these = large[np.sort(pick)]
    return stars, (group[these], number[these], begin[these], code)


def common_elements(documents: DataFrame, key: str, text: str, width: int) -> np.ndarray:
    """Elements that recur in a bounded sample; for the cost model only."""
    total = documents.count()
    if not total:
        return np.zeros(0, np.uint64)
    sample = documents.where(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1_000_003)) < 1_000_003 * min(1.0, SAMPLE / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            for _, _, value, _ in sets_of(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["e"])

    seen = sample.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), "e bigint").groupBy("e").count()
    rows = seen.where("count >= 4").orderBy(F.desc("count"), "e").limit(COMMON).collect()
    return np.sort(np.array([r["e"] for r in rows], np.int64).view(np.uint64))


def _linked(a: np.ndarray, b: np.ndarray, up: int, down: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) * down < len(b) * up:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both * down >= (len(a) + len(b) - both) * up


def verify(documents: DataFrame, pairs: DataFrame, key: str, text: str, width: int, up: int, down: int) -> DataFrame:
    """The pairs (a, b) whose sets are over the threshold."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pairs.join(pairs.groupBy("a").count(), "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / GROUP)).cast("int"))
    roles = salted.select(F.col("b").alias("doc"), F.struct("a", "salt", F.lit(1).alias("role")).alias("w")).union(
        salted.select(F.col("a").alias("doc"), F.struct("a", "salt", F.lit(0).alias("role")).alias("w")).distinct())
    wanted = settle(roles.groupBy("doc").agg(F.collect_list("w").alias("wanted")))
    texts = documents.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).join(
        measured(wanted, 48 + 32 * F.size("wanted")), "doc").select("doc", "text", "wanted")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            ids = batch.column(0).to_pylist()
            lists = batch.column(2).to_pylist()
            for lo, hi, value, off in sets_of(batch.column(1), width):
                rows = [(w["a"], w["salt"], w["role"], ids[i], value[off[i - lo]:off[i - lo + 1]].tobytes()) for i in range(lo, hi) for w in lists[i]]
                if rows:
                    a, salt, role, doc, raw = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(salt, pa.int32()), pa.array(role, pa.int32()), pa.array(doc, pa.int64()), pa.array(raw, pa.binary())],
                        names=["a", "salt", "role", "doc", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chiefs = None, []
        for batch in batches:
            found = []
            for a, salt, role, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (a, salt) != at:
                    at, chiefs = (a, salt), []
                own = np.frombuffer(raw, np.uint64)
                if role == 0:
                    chiefs.append(own)
                elif any(_linked(own, c, up, down) for c in chiefs if len(c) and len(own)):
                    found.append((a, doc))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["a", "b"])

    sent = texts.mapInArrow(tidy(send), "a bigint, salt int, role int, doc bigint, elements binary")
    return sent.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(tidy(compare), "a bigint, b bigint")


def _parities(documents: DataFrame, ids: DataFrame, key: str, text: str, width: int, shards: int) -> dict:
    """Sizes and parity bitmaps of the listed documents, in order of id, in the shared folder: addresses by shard.

    A document of several texts has size -1: nothing is ruled out for it.
    """
    folder = scratch_folder(documents.sparkSession, "parities")
    texts = documents.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).join(measured(ids, 40), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            for lo, hi, value, off in sets_of(batch.column(1), width):
                n = hi - lo
                doc = batch.column(0).slice(lo, n)
                bits = [parity(value[off[i]:off[i + 1]]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.mod(doc.to_numpy(), shards), pa.int32()), doc, pa.array(np.diff(off)), pa.array([b.tobytes() for b in bits], pa.binary())],
                    names=["shard", "doc", "size", "bits"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        held = pa.Table.from_batches(batches)
        shard, doc, size = (held[n].to_numpy().copy() for n in ("shard", "doc", "size"))
        bits = [np.frombuffer(b, np.uint64) for b in held["bits"].to_pylist()]
        again = np.zeros(len(doc), bool)
        again[1:] = doc[1:] == doc[:-1]
        size[again | np.append(again[1:], False)] = -1
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero((shard == s) & ~again)
            own = [bits[i] for i in mine.tolist()]
            arrays = {"doc": doc[mine], "size": size[mine], "bits": np.concatenate(own), "cuts": np.cumsum([0, *map(len, own)])}
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32())} | {n: [put(folder, f"{n}{s}", x)] for n, x in arrays.items()})

    rows = texts.select("doc", "text").mapInArrow(tidy(run), "shard int, doc bigint, size bigint, bits binary")
    made = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc").mapInArrow(tidy(write), "shard int, doc string, size string, bits string, cuts string").collect()
    return {"shards": shards, "parts": {r["shard"]: r.asDict() for r in made}}


def parity(elements: np.ndarray) -> np.ndarray:
    """Whether the elements that fall on each bit are odd in number; at least four bits an element.

    Bitmaps of two sets differ in at most as many bits as the sets in elements.
    A bitmap folds to half its length by XOR of its halves.
    """
    words_ = max(PARITY, 1 << max(0, int(len(elements) - 1).bit_length() - 4))
    odd = np.bincount((mix(elements) % np.uint64(words_ * 64)).astype(np.int64), minlength=words_ * 64) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _described(book: dict, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size of every document asked for; all their bitmaps in a row, and where each begins and how long it is."""
    size, begin, length, bits, total = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), [], 0
    shard = np.mod(doc, book["shards"])
    for s in np.unique(shard).tolist():
        part, mine = book["parts"][s], np.flatnonzero(shard == s)
        at = np.searchsorted(mapped(part["doc"]), doc[mine])
        size[mine] = mapped(part["size"])[at]
        cuts = np.asarray(mapped(part["cuts"]))
        length[mine] = cuts[at + 1] - cuts[at]
        ends = np.cumsum(length[mine])
        begin[mine] = total + ends - length[mine]
        bits.append(np.asarray(mapped(part["bits"]))[np.arange(ends[-1]) + np.repeat(cuts[at] - (ends - length[mine]), length[mine])])
        total += int(ends[-1])
    return size, np.concatenate(bits) if bits else np.zeros(0, np.uint64), begin, length


def _possible(described: tuple, a: np.ndarray, b: np.ndarray, up: int, down: int) -> np.ndarray:
    """Which pairs of described documents (by place) the sizes and bitmaps cannot rule out."""
    size, bits, begin, length = described
    less, more = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    possible = less < 0  # texts that share an id: nothing is ruled out
    # sets that may link differ by less than a factor of two, so only neighbouring lengths meet
    width = np.minimum(length[a], length[b])
    left = np.flatnonzero(~possible & (less * down >= more * up) & (np.maximum(length[a], length[b]) <= 2 * width))

    def folded(doc: np.ndarray, words_: int) -> np.ndarray:
        out = bits[begin[doc][:, None] + np.arange(words_)]
        wide = np.flatnonzero(length[doc] > words_)
        if len(wide):
            out[wide] ^= bits[(begin[doc[wide]] + words_)[:, None] + np.arange(words_)]
        return out

    for words_ in np.unique(width[left]).tolist():
        here = left[width[left] == words_]
        step = max(1, 1_000_000 // words_)
        for some in (here[lo:lo + step] for lo in range(0, len(here), step)):
            apart = np.bitwise_count(folded(a[some], words_) ^ folded(b[some], words_)).sum(axis=1, dtype=np.int64)
            possible[some] = apart <= (size[a[some]] + size[b[some]]) * (down - up) // (down + up)
    return possible


def _sieve(book: dict, up: int, down: int):
    """The pairs (a, b) that the bitmaps cannot rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, place = np.unique(np.concatenate([batch.column(i).to_numpy() for i in range(2)]), return_inverse=True)
            n = batch.num_rows
            if n:
                yield batch.filter(pa.array(_possible(_described(book, ids), place[:n], place[n:], up, down)))
    return run


def _across(book: dict, up: int, down: int):
    """Pairs of one cell in different components that the bitmaps cannot rule out."""
    def tried(cell: np.ndarray, doc: np.ndarray, component: np.ndarray, ask: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of whole cells, in order of cell and doc; later members of a cell are paired with earlier ones."""
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        number = np.diff(np.append(begin, len(cell)))
        mixed = np.minimum.reduceat(component, begin) != np.maximum.reduceat(component, begin)
        keep, number = np.repeat(mixed, number), number[mixed]
        doc, component, ask = doc[keep], component[keep], ask[keep]
        if not len(doc):
            return
        ids, of = np.unique(doc, return_inverse=True)
        described = _described(book, ids)
        later = np.repeat(np.cumsum(number), number) - np.arange(len(doc)) - 1
        ends = np.cumsum(later)
        lo = 0
        while lo < len(doc):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - later[lo] + PAIRS, side="right")))
            count = later[lo:hi]
            i = np.repeat(np.arange(lo, hi), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
            apart = (component[i] != component[j]) & (ask[i] | ask[j])
            pair = np.sort(of[i[apart]] * len(ids) + of[j[apart]])
            # a pair that meets in several cells is tried once
            a, b = np.divmod(pair[np.flatnonzero(np.diff(pair, prepend=-1))], len(ids))
            found = np.flatnonzero(_possible(described, a, b, up, down))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[found]]), pa.array(ids[b[found]])], names=["a", "b"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(),
                   batch.column(3).to_numpy(zero_copy_only=False)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cuts = np.flatnonzero(np.diff(held[0])) + 1
            if len(cuts):
                yield from tried(*[x[:cuts[-1]] for x in held])
                held = [x[cuts[-1]:] for x in held]
        if held is not None and len(held[0]):
            yield from tried(*held)
    return run


def join(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """One row per document: key, n_shingles, component_id."""
    spark = documents.sparkSession
    up, down = (x // math.gcd(*threshold) for x in threshold)
    folder = scratch_folder(spark, "jaccard")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, common = Bands(up, down), common_elements(documents, key, text, width)
    keyed = documents.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    keyed.mapInArrow(tidy(_send(width, bands, common, parts)), SENT).repartitionById(parts, F.col("part")).mapInArrow(tidy(_meet), "kind int, a bigint, b bigint, n bigint, members array<bigint>").write.parquet(f"{folder}/met")
    met = spark.read.parquet(f"{folder}/met")
    equal = met.where("kind = 1").select("a", "b")
    met.where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/stars")
    stars = spark.read.parquet(f"{folder}/stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    # whoever meets another is in a star, so these bitmaps serve all trials
    ids = settle(stars.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    book = _parities(documents, ids, key, text, width, parts)

    def sifted(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(tidy(_sieve(book, up, down)), "a bigint, b bigint")

    first = settle(verify(documents, settle(sifted(best)), key, text, width, up, down))
    settled = settle(components(equal.union(first)))

    def placed(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(settled.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in")), name, "left").withColumn(
            f"{name}_in", F.coalesce(f"{name}_in", name))

    open_stars = placed(placed(stars, "a"), "b").where("a_in <> b_in").select("a", "b").join(best, ["a", "b"], "left_anti")
    members = placed(met.where("kind = 3").select(F.col("a").alias("g"), "n", F.explode("members").alias("code")).select(
        "g", "n", F.shiftright("code", 1).alias("doc"), (F.col("code").bitwiseAND(1) == 1).alias("ask")), "doc")
    mixed = members.groupBy("g").agg(F.min("doc_in").alias("lo"), F.max("doc_in").alias("hi")).where("lo <> hi").select("g")
    members.join(mixed, "g").write.parquet(f"{folder}/open")
    opened = spark.read.parquet(f"{folder}/open")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    block = F.pmod(F.xxhash64("doc"), cells).cast("int")
    other = opened.withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0), cells - 1)))
    across = other.select(
        F.xxhash64("g", F.least("block", "k"), F.greatest("block", "k")).alias("cell"), "doc", "doc_in", "ask"
    ).repartition(parts, "cell").sortWithinPartitions("cell", "doc").mapInArrow(tidy(_across(book, up, down)), "a bigint, b bigint")
    rest = settle(sifted(open_stars).union(across).distinct())
    second = settle(verify(documents, rest, key, text, width, up, down))
    final = components(settled.select(F.col("component").alias("a"), F.col("node").alias("b")).union(second))
    sizes = met.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n_shingles"))
    return sizes.join(final.select(F.col("node").alias("doc"), "component"), "doc", "left").select(
        F.col("doc").alias(key), "n_shingles", F.coalesce("component", "doc").alias("component_id"))
