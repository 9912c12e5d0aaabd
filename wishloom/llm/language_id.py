"""Language identification by cross-parsing entropy.

One Spark task per language builds the suffix automaton of a bounded sample of
its labelled text and writes the transition table to the shared folder. A
text is parsed against every automaton into the longest phrases that occur in
the sample; the language that needs the fewest phrases, normalised by the
number of characters, wins (ties: the first name). The whole text is parsed
from its start, though not one character after the other: stretches of `LANE`
characters walk the table in step, then every stretch goes on into the next
one until it starts a phrase where that one did; from there on both parses are
the same. So the count is that of one parse, the work is a few array
operations per character position, and nothing is shuffled.

An automaton may know any number of symbols: up to 255 its table has a column
for each, beyond that transitions are sorted by state and symbol and found by
binary search. A symbol that the sample lacks is a phrase of its own.

Characters: lower-cased letters; each run of anything else is one space.

Sample: about `sample_documents` labelled documents per language, chosen by a
hash of their id, and of them `train_chars` characters in equal shares, each
taken in PARTS stretches spread over the text. Both bounds are parameters;
predictions read whole texts.

Defined cases: a null text or one without a letter is `und` with score 0; so
is everything if there is no labelled text at all; rows with a null label or
id are not learned from; repeated rows get the same answer; extra columns
stay, and columns named like the result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishloom.llm.arrowmap import append
from wishloom.llm.blobs import mapped, put
from wishloom.llm.sizes import measured
from wishloom.plans.scale import scratch_folder, settle

LANE = 128
CODES = 0x110000
PARTS = 4
DENSE = 256
FIELDS = "lang_pred string, score double, phrase_rate double"


def states(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a sequence: the transitions of every state, the first being the root."""
    table, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(table)
        table.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in table[p]:
            table[p][c] = new
            p = link[p]
        if p >= 0:
            q = table[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(table)
                table.append(dict(table[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and table[p].get(c) == q:
                    table[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return table


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """Suffix automaton as a flat table: row offset of the next state or -1."""
    return _dense(states(symbols), size)


def _dense(table: list[dict[int, int]], size: int) -> np.ndarray:
    flat = np.full((len(table), size), -1, np.int32)
    for row, following in enumerate(table):
        for c, to in following.items():
            flat[row, c] = to * size
    return flat.ravel()


def _sparse(table: list[dict[int, int]], size: int) -> np.ndarray:
    """Sorted keys state * size + symbol, then the next states times size."""
    pairs = sorted((row * size + c, to * size) for row, following in enumerate(table) for c, to in following.items())
    return np.array(pairs, np.int64).T.ravel()


def follow(table: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Next state of states and symbols, -1 where there is none; states are row offsets."""
    if table.dtype == np.int32:
        return lambda state, c: table[state + c]
    keys, to = table.reshape(2, -1)

    def search(state: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, state + c), len(keys) - 1)
        return np.where(keys[at] == state + c, to[at], -1)

    return search


_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(CODES)], dtype=bool))
    return _LETTER[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, offsets, and whether a text has a letter."""
    coded = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int64)
    code = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    letter = letters()[code]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[off[:-1]] = True
    new = np.concatenate(([0], np.cumsum(kept)))[off]
    has = np.concatenate(([0], np.cumsum(letter)))[off]
    return np.where(letter, code, 32)[kept], new, np.diff(has) > 0


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
          sample_documents: int = 80, train_chars: int = 40_000) -> list[dict]:
    """Build one automaton per language; returns their addresses."""
    folder = scratch_folder(labelled.sparkSession, "languages")
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key")).where(
        "lang is not null and key is not null")
    counts = settle(rows.groupBy("lang").count())
    share = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.join(measured(counts, 40 + F.octet_length("lang")), "lang").where(share * F.col("count") < sample_documents).select("lang", "key", "text")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        name = group["lang"].iloc[0]
        texts = [t for _, t in sorted(zip(group["key"], group["text"], strict=True), key=lambda x: (str(x[0]), x[1] or "")) if t]
        seq, off, has = characters(texts)
        each = max(200, train_chars // max(1, int(has.sum())))
        taken = []
        for i in np.flatnonzero(has):
            part = seq[off[i]:off[i + 1]]
            width = each // PARTS
            begins = [0] if len(part) <= each else np.linspace(0, len(part) - width, PARTS).astype(int)
            taken += [part[at:at + (each if len(begins) == 1 else width)] for at in begins]
        seq = np.concatenate(taken or [seq[:0]])[:train_chars]
        used = np.unique(seq)
        size = len(used) + 1
        look = np.zeros(CODES, np.uint8 if size <= DENSE else np.uint32)
        look[used] = np.arange(1, size)
        table = states(look[seq].tolist())
        # symbol 0 is any that the sample lacks; from the root it leads to a state that ends the phrase
        table[0][0] = len(table)
        table.append({})
        flat = _dense(table, size) if size <= DENSE else _sparse(table, size)
        return pd.DataFrame({"lang": [name], "size": [size], "n": [len(seq)], "table": [put(folder, "automaton", flat)],
                             "look": [put(folder, "symbols", look)]})

    made = sample.groupBy("lang").applyInPandas(build, "lang string, size int, n bigint, table string, look string")
    return sorted((r.asDict() for r in made.where("n > 0").collect()), key=lambda m: m["lang"])


def cross_parse(symbols: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of every text: each the longest that the automaton knows from where the last one ended."""
    step, kind = follow(table), table.dtype
    size = np.diff(off)
    lanes = -(-size // LANE)
    owner = np.repeat(np.arange(len(size)), lanes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = off[owner] + inside * LANE
    end = np.minimum(start + LANE, off[owner + 1])
    root = np.zeros(1, kind)
    first = np.zeros(len(symbols), bool)  # where a stretch, parsed on its own, starts a phrase
    order = np.argsort(start - end, kind="stable")
    active = np.searchsorted((start - end)[order], -np.arange(LANE), side="left")
    at, state = start[order], np.zeros(len(start), kind)  # longest first, so that those still going are the front
    for place, k in enumerate(active.tolist()):
        c = symbols[at[:k] + place]
        following = step(state[:k], c)
        miss = np.flatnonzero(following < 0) if place else np.arange(k)
        first[at[miss] + place] = True
        following[miss] = step(root, c[miss])
        state[:k] = following
    after = np.zeros(len(start), kind)  # the state in which a stretch ends
    after[order] = state
    met, extra = start.copy(), np.zeros(len(start), np.int64)
    todo = np.flatnonzero(inside > 0)
    state = after[todo - 1]
    while len(todo):
        going, at = todo, start[todo]
        extra[todo] = 0
        crossed, final = [], []
        while len(going):
            c = symbols[at]
            following = step(state, c)
            miss = np.flatnonzero(following < 0)
            here = first[at[miss]]
            meets = np.zeros(len(going), bool)
            meets[miss[here]] = True
            met[going[miss[here]]] = at[miss[here]]
            extra[going[miss[~here]]] += 1
            following[miss] = step(root, c[miss])
            state = following
            through = ~meets & (at + 1 >= end[going])
            if through.any():
                met[going[through]] = end[going[through]]
                crossed.append(going[through])
                final.append(state[through])
            left = ~meets & ~through
            going, at, state = going[left], at[left] + 1, state[left]
        # a stretch crossed without a meeting may end in another state: the next one is entered anew
        todo, state = (np.concatenate(crossed), np.concatenate(final)) if crossed else (going, state)
        changed = after[todo] != state
        after[todo] = state
        changed &= np.append(owner, -1)[todo + 1] == owner[todo]
        todo, state = todo[changed] + 1, state[changed]
    firsts = np.concatenate(([0], np.cumsum(first)))
    return np.bincount(owner, weights=extra + firsts[end] - firsts[met], minlength=len(size))


def predict(documents: DataFrame, models: list[dict], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with lang_pred, score (0 to 1) and phrase_rate (phrases per character)."""
    names = [m["lang"] for m in models]

    def work(column: pa.Array) -> list:
        texts = column.to_pylist()
        seq, off, has = characters(texts)
        size = np.diff(off)
        need = np.zeros((len(models), len(texts)))
        for i, model in enumerate(models):
            table = np.asarray(mapped(model["table"]))
            need[i] = cross_parse(np.asarray(mapped(model["look"]))[seq].astype(table.dtype), off, table)
        if not models:
            return [["und"] * len(texts), np.zeros(len(texts)).tolist(), np.zeros(len(texts)).tolist()]
        best = need.argmin(axis=0)
        least = need[best, np.arange(len(texts))]
        score = 1 / np.exp(np.maximum(least - need, -700)).sum(axis=0)
        rate = least / np.maximum(size, 1)
        return [[names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)],
                np.where(has, score, 0.0).tolist(), np.where(has, rate, 0.0).tolist()]

    return append(documents, [text], keep, FIELDS, work)


def accepted(predicted: DataFrame, max_phrase_rate: float = 0.6):
    """Rows in some learned language: not `und`, and phrases long enough for a language."""
    return predicted.where((F.col("lang_pred") != "und") & (F.col("phrase_rate") <= max_phrase_rate))
