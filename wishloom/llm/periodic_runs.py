"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least `min_words` and `min_repeats` periods long, that no
neighbouring word extends.

1. Words of a text are numbered, apart for every text of a block, so equal
   numbers mean equal words of one text and no run leaves its text.
2. Periods up to SHORT are scanned directly: words are compared with those a lag away.
3. Longer periods go by scale. A scale holds the periods lo to hi, with hi at
   most 1.5 lo. Stretches of hi words get exact names by prefix doubling; the
   least scrambled name of every window of 2 lo - hi + 1 places is a
   minimizer. Windows a period apart inside a run hold the same names, so
   minimizers repeat at the distance of the period, and two equal stretches of
   hi words lie no nearer inside a run. Hence every run of three periods shows
   up as neighbouring equal minimizers at its period; the pair is extended to
   both sides word by word. Names are exact, so a pair is never an accident.
4. Of the periods of one stretch the smallest stays.

Texts without a repeated stretch of SHORT words leave after step 2, texts
shorter than three periods leave before a scale begins, so ordinary prose pays
for the direct scans alone. Work is row-local: nothing is shuffled, a hot key
means nothing, and memory is a block of texts or one longer text.

Defined cases: null and empty texts have no words, no runs and an empty
collapsed text; a text without runs keeps its words, joined by one space;
repeated rows are judged alike; an empty table stays empty; extra columns stay,
a column named like a result is replaced.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wishloom.llm.arrowmap import append
from wishloom.llm.bytetext import BLOCK_BYTES, Rolling, mix

SHORT = 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _sliding(least: np.ufunc, values: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Least (or greatest) of every window of `width` values, in two passes over blocks."""
    n = len(values)
    held = np.full(-(-n // width) * width, pad, values.dtype)
    held[:n] = values
    held = held.reshape(-1, width)
    ahead = least.accumulate(held, axis=1).ravel()
    behind = least.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(behind[:n - width + 1], ahead[width - 1:n])


def minimizers(keys: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least key of a window of `width` positions."""
    if len(keys) < width:
        return np.arange(len(keys))
    least = _sliding(np.minimum, keys, width, np.iinfo(np.uint64).max)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), width, 0) == keys)


def _agree(names: np.ndarray, at: int, lag: int) -> int:
    """First position from `at` on whose word differs from the one `lag` later."""
    last, size = len(names) - lag, 64
    while at < last:
        stop = min(at + size, last)
        differ = np.flatnonzero(names[at:stop] != names[at + lag:stop + lag])
        if len(differ):
            return at + int(differ[0])
        at, size = stop, size * 2
    return last


def _agree_back(names: np.ndarray, at: int, lag: int) -> int:
    """First position of the stretch before `at` whose words equal those `lag` later."""
    size = 64
    while at > 0:
        stop = max(at - size, 0)
        differ = np.flatnonzero(names[stop:at] != names[stop + lag:at + lag])
        if len(differ):
            return stop + int(differ[-1]) + 1
        at, size = stop, size * 2
    return 0


def _direct(names: np.ndarray, longest: int, min_words: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """Stretches of the periods up to SHORT."""
    found = []
    for lag in range(1, min(SHORT, longest // min_repeats) + 1):
        same = np.flatnonzero(names[lag:] == names[:-lag])
        if not len(same):
            continue
        first = np.flatnonzero(np.concatenate(([True], np.diff(same) != 1)))
        size = np.diff(np.append(first, len(same))) + lag
        for i in np.flatnonzero(size >= max(min_words, min_repeats * lag)).tolist():
            found.append((int(same[first[i]]), int(size[i]), lag))
    return found


def _texts_left(names: np.ndarray, text: np.ndarray, keep: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, text numbers and places of the words of the texts in `keep`."""
    kept = keep[text]
    return names[kept], text[kept], place[kept]


def _repeating(keys: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Which texts hold a key twice; equal keys may also be told for other texts."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(texts, bool)
    out[text[order[1:][equal]]] = out[text[order[:-1][equal]]] = True
    return out


def runs_of(names: np.ndarray, text: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a block of words, by start and period.

    `names` are numbers of words, distinct between texts; `text` is the number of each word's text, ascending.
    """
    if min_repeats < 3:
        raise ValueError("minimizers promise runs of three periods and more")
    if not len(names):
        return []
    texts = int(text[-1]) + 1
    words = np.bincount(text, minlength=texts)
    found = _direct(names, int(words.max()), min_words, min_repeats)
    place = np.arange(len(names))
    lo = SHORT + 1
    if len(names) > SHORT:
        every = np.arange(len(names) - SHORT + 1)
        left = _repeating(Rolling(names)(every, every + SHORT), text[every], texts)
        names, text, place = _texts_left(names, text, left & (words >= min_repeats * lo), place)
    width, level = 1, names.astype(np.int64)
    while len(names):
        hi = lo * 3 // 2
        while width * 2 <= hi:  # names of stretches twice as long
            _, level = np.unique((level[:-width] << 32) | level[width:], return_inverse=True)
            width *= 2
        keys = mix((level[:len(names) - hi + 1] << 32) | level[hi - width:])
        at = minimizers(keys, 2 * lo - hi + 1)
        at = at[np.argsort(keys[at], kind="stable")]
        lag = at[1:] - at[:-1]
        pair = np.flatnonzero((keys[at[1:]] == keys[at[:-1]]) & (lag >= lo) & (lag <= hi))
        pair = pair[np.argsort(at[pair], kind="stable")]
        reached: dict[int, int] = {}
        for begin, period in zip(at[pair].tolist(), lag[pair].tolist(), strict=True):
            if reached.get(period, -1) >= begin + period + hi:
                continue
            start = _agree_back(names, begin, period)
            reached[period] = end = _agree(names, begin + hi, period) + period
            if end - start >= max(min_words, min_repeats * period):
                found.append((int(place[start]), end - start, period))
        lo = hi + 1
        left = words >= min_repeats * lo
        if not left[text].all():
            names, text, place = _texts_left(names, text, left, place)
            width, level = 1, names.astype(np.int64)
    least: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def _block(texts: list[bytes], min_words: int, min_repeats: int) -> tuple[list[int], list[list], list, list[bytes]]:
    words = [t.split() for t in texts]  # bytes split at 0x20 and 0x09 to 0x0D
    counts = [len(w) for w in words]
    flat = [x for w in words for x in w]
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    known = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    _, names = np.unique((text.astype(np.int64) << 32) | known, return_inverse=True)
    runs: list[list] = [[] for _ in texts]
    gone = np.zeros(len(flat), bool)
    for start, length, period in runs_of(names, text, min_words, min_repeats):
        number = int(text[start])
        runs[number].append({"start": start - int(first[number]), "length": length, "period": period})
        gone[start + period:start + length] = True
    strongest = [max(r, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"]), default=None) for r in runs]
    collapsed = []
    for number, own in enumerate(words):
        if runs[number]:
            lost = gone[first[number]:first[number + 1]].tolist()
            own = [w for w, dropped in zip(own, lost, strict=True) if not dropped]
        collapsed.append(b" ".join(own))
    return counts, runs, strongest, collapsed


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """Kept columns and n_words, runs, strongest, collapsed of every text.

    `runs` come by start, then period; `strongest` has the greatest exact
    length / period (ties: smallest start, then period), null without runs;
    `collapsed` leaves out every word that a run contains after its first period.
    """
    def work(column: pa.Array) -> list:
        texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
        made: tuple[list, ...] = ([], [], [], [])
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK_BYTES):
                size += len(texts[hi])
                hi += 1
            for out, part in zip(made, _block(texts[lo:hi], min_words, min_repeats), strict=True):
                out += part
            lo = hi
        counts, runs, strongest, collapsed = made
        return [counts, runs, strongest, pa.array(collapsed, pa.binary()).cast(pa.string())]

    return append(df, [text], keep, f"n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string", work)
