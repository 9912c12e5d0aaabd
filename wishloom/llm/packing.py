"""Best-fit packing of tokenized documents into sequences of fixed capacity.

1. Tasks tokenize whole texts and cut only what exceeds the capacity. A piece is
   numbered within its task among the pieces of its length. The pieces are
   written once, so these numbers stay the same whatever is lost later.
2. The histogram of lengths, at most `capacity` numbers, is all that planning
   reads. Best fit in order of falling length places counts, not documents:
   sequences with equal room form ranges of consecutive ids, the range with the
   least sufficient room takes as many pieces of a length as go into it, and a
   range is split where the pieces end. A length splits ranges at most three
   times, so the plan's size depends on the capacity and never on the documents.
3. The rank of a piece within its length is its number in its task plus the
   pieces of that length in earlier tasks. Pieces join the plan on length and
   rank and so take their slots; no length, however common, goes to one task.

Words are looked up: no token of this vocabulary crosses white space, so the ids
of a text are those of its words, and the tokenizer sees a distinct word once
for as long as a task remembers it.

Defined cases: null and empty texts hold the end id alone, one piece of length
one; null and repeated ids are carried like others, as every row is a document of
its own; an empty table gives no pieces; kept columns stay, one named like
a result is replaced.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wishloom.llm.arrowmap import pieces as batch_pieces
from wishloom.llm.arrowmap import tidy
from wishloom.llm.sizes import BROADCAST_BYTES
from wishloom.plans.scale import scratch_folder

SEEN_WORDS = 400_000
LEARN_WORDS = 10_000
#: Fixed value: how the vocabulary that `Words` takes apart splits its text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SEGMENT_BYTES = 48
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _latin() -> str:
    """Letters that have one lower case form among themselves: a word of them is one token sequence of its own."""
    letters = {chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if chr(c).isalpha()}
    return "".join(sorted(c for c in letters if c.lower() in letters))


BYTE_LETTERS = _byte_letters()
LATIN_WORD = re.compile(f"[{_latin()}]+")
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = True
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


class Words:
    """Ids of texts by those of their words, each tokenized once while it is remembered.

    It needs a vocabulary that drops case and white space and starts anew
    after a letter; for any other `apart` is false and texts are tokenized whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            book = json.load(file)
        steps = (book["normalizer"] or {}).get("normalizers", []), (book["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.apart = book["model"]["type"] == "BPE" and [x.get("type") for x in steps[0]] == ["NFC", "Replace", "Lowercase"] \
            and [x.get("type") for x in steps[1]] == ["Split", "ByteLevel"] and steps[1][0]["pattern"] == {"Regex": WORD_PATTERN}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, texts: list[bytes]) -> list[list[bytes]]:
        """Words of every text whose ids, one after the other, are those of the text.

        No token crosses ASCII white space, nor a place where ASCII
        punctuation follows a letter, and case is dropped. Texts that spell a
        special token stay as they are, as do those with marks of U+0300 to
        U+036F, which may join a small letter and not its capital.
        """
        out = []
        whole = b" ".join(texts).lower()
        code = np.frombuffer(whole, np.uint8)
        cut = np.flatnonzero(MARK[code[1:]] & LETTER[code[:-1]]) + 1
        spread = np.insert(code, cut, 0x20).tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        ends = (ends + np.searchsorted(cut, ends)).tolist()
        begin = 0
        for text, end in zip(texts, ends, strict=True):
            plain = b"\xcc" not in text and b"\xcd" not in text and not any(s in text for s in self.special)
            out.append((spread[begin:end] if plain else text).split())
            begin = end + 1
        return out

    def _remember(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))

    def learn(self, words: list[bytes]) -> None:
        """Tokenize words: those of Latin letters by the merges alone, others many at a time as one text."""
        latin, others = [], []
        for raw in words:
            word = raw.decode()
            (latin if LATIN_WORD.fullmatch(word) else others).append((raw, word))
        made = [[t.id for t in self.tokenizer.model.tokenize(w.lower().encode().decode("latin-1").translate(BYTE_LETTERS))] for _, w in latin]
        self._remember([r for r, _ in latin], np.fromiter(chain.from_iterable(made), np.int64), np.array([len(m) for m in made], np.int64))
        for lo in range(0, len(others), LEARN_WORDS):
            part = others[lo:lo + LEARN_WORDS]
            coded = self.tokenizer.encode(" ".join(w for _, w in part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for _, w in part)])
            word = np.searchsorted(begins, np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded)), side="right") - 1
            self._remember([r for r, _ in part], np.array(coded.ids, np.int64), np.bincount(word, minlength=len(part)))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and where every text begins."""
        if not self.apart:
            made = [[*e.ids, end_id] for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(made), np.uint32), np.cumsum([0, *map(len, made)])
        if len(self.number) > SEEN_WORDS:
            self.forget()
        split = self.split(texts)
        every = list(chain.from_iterable(split))
        self.learn(sorted(set(every).difference(self.number)))
        number = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        size, first = self.size[number], self.first[number]
        before = np.concatenate(([0], np.cumsum(size)))
        begins = before[np.cumsum([0, *map(len, split)])] + np.arange(len(texts) + 1)
        out = np.full(begins[-1], end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[begins[1:] - 1] = False
        out[inside] = self.ids[np.arange(before[-1]) - np.repeat(before[:-1] - first, size)]
        return out, begins


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def pieces(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, capacity: int = 2048,
           end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: kept columns, piece, start, length, ids_crc32, the ids, and its task and number there."""
    fields = StructType.fromDDL(PIECE + (", ids array<int>" if with_ids else "") + ", task int, number bigint")
    kept = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    schema = StructType([df.schema[c] for c in kept] + fields.fields)
    types, names = to_arrow_schema(fields).types, schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = _words(path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in (p for b in batches for p in batch_pieces(b)):
            texts = [t or b"" for t in batch.column(len(kept)).cast(pa.large_binary()).to_pylist()]
            ids, begins = words.encode(texts, end_id)
            count = -(-np.diff(begins) // capacity)
            row = np.repeat(np.arange(len(texts)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(np.diff(begins)[row] - start, capacity)
            at = begins[row] + start
            held = ids.astype("<u4")
            crc = [zlib.crc32(held[a:a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            # among the pieces of one length in this task
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            number = np.empty(len(row), np.int64)
            number[order] = met[ordered] + np.arange(len(row)) - np.searchsorted(ordered, ordered)
            met += np.bincount(length, minlength=capacity + 1)
            made = [piece, start, length, crc, *([[ids[a:a + n] for a, n in zip(at.tolist(), length.tolist(), strict=True)]] if with_ids else []),
                    np.full(len(row), task), number]
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(row)) for c in batch.columns[:len(kept)]] + [pa.array(m, type=t) for m, t in zip(made, types, strict=True)], names=names)

    return df.select(*[f"`{c}`" for c in kept], df[f"`{text}`"].alias("_in")).mapInArrow(tidy(cut), schema)


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of falling lengths over counts: segments (length, first rank, last rank + 1, sequence, pieces per sequence, offset).

    The piece of rank r of a segment goes to sequence + (r - first) // per, at offset + (r - first) % per * length.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out, opened = [], 0

    def put(room: int, sequence: int, count: int) -> None:
        if count and room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((sequence, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, count = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room = capacity
                sequence, count = opened, -(-left // (capacity // length))
                opened += count
            per = room // length
            full = min(count, left // per)
            for sequences, each in ((full, per), (int(full < count and left > full * per), left - full * per)):
                if sequences and each:
                    out.append((length, rank, rank + sequences * each, sequence, each, capacity - room))
                    put(room - each * length, sequence, sequences)
                    rank, left, sequence, count = rank + sequences * each, left - sequences * each, sequence + sequences, count - sequences
            put(room, sequence, count)
    return out


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = cut.sparkSession
    folder = f"{scratch_folder(spark, 'packing')}/pieces"
    cut.write.parquet(folder)
    held = spark.read.schema(cut.schema).parquet(folder)
    counts = held.groupBy("length", "task").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    segments = plan(histogram, capacity)
    slots = spark.createDataFrame(segments, "length bigint, _from bigint, _to bigint, _sequence bigint, _per bigint, _offset bigint")
    if len(segments) * SEGMENT_BYTES <= BROADCAST_BYTES:
        slots = F.broadcast(slots)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = held.join(bases, ["length", "task"]).withColumn("_rank", F.col("_base") + F.col("number"))
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    place = F.col("_rank") - F.col("_from")
    return ranked.join(slots.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & inside).select(
        *[f"`{c}`" for c in cut.columns if c not in ("task", "number")],
        (F.col("_sequence") + F.floor(place / F.col("_per")).cast("bigint")).alias("sequence_id"),
        (F.col("_offset") + place % F.col("_per") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of every sequence; a sequence holds at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
