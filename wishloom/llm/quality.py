"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics (word lengths, shares
of character classes, repetition of words, vocabulary; a short text is drawn
towards usual values, since its shares say little), made from whole texts in
one row-local pass and kept as a table, a few numbers per document. Spark sums
counts, first and second moments per class over all labelled rows (no
sample); the driver sees one row per class. Class covariances are shrunk
towards the pooled covariance and towards a multiple of the identity. Their
Cholesky factors are computed once and kept; a score is the logistic value of
the difference of log densities (Mahalanobis form) plus the log prior odds.

Defined cases: null and empty texts have the statistics of an empty text;
labels without value or id and labels other than 0 and 1 are left out; a label
row given twice counts twice; with fewer than two classes of labels every score
is the share of label 1 seen (0.5 without labels); repeated documents get the
same score; extra columns stay and columns named like the result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishloom.llm.arrowmap import append
from wishloom.llm.bytetext import SPACED, blocks, word_hashes, words
from wishloom.plans.scale import scratch_folder

FEATURES = ["mean_word", "spread_word", "upper", "digit", "stops", "marks", "odd", "beyond_ascii",
            "lines", "again", "distinct", "commonest", "long_words"]

#: Typical values a short text is drawn towards, worth SMOOTH_BYTES bytes or SMOOTH_WORDS words.
SMOOTH_BYTES, SMOOTH_WORDS = 60, 10
USUAL = {1: 0.02, 2: 0.005, 3: 0.02, 4: 0.001, 5: 0.001, 6: 0.01, 7: 0.005}

CLASS = np.zeros(256, np.uint8)
CLASS[ord("A"):ord("Z") + 1] = 1
CLASS[ord("0"):ord("9") + 1] = 2
CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3
CLASS[[ord(c) for c in "!|"]] = 4
CLASS[[ord(c) for c in "#$%&*@<>{}[]\\/^~_=+`"]] = 5
CLASS[0x80:] = 6
CLASS[[0x0A, 0x0D]] = 7
CLASS[[0x20, 0x09, 0x0B, 0x0C]] = 8


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    out = []
    for lo, hi, buf, off in blocks(column):
        n = hi - lo
        size = np.diff(off)
        doc = np.repeat(np.arange(n), size)
        kinds = np.bincount(doc * 9 + CLASS[buf], minlength=n * 9).reshape(n, 9)
        start, end, owner = words(buf, off, SPACED)
        count = np.bincount(owner, minlength=n)
        per = count + SMOOTH_WORDS
        length = (end - start).astype(float)
        mean = (np.bincount(owner, length, n) + 6 * SMOOTH_WORDS) / per
        spread = np.sqrt(np.maximum((np.bincount(owner, length**2, n) + 45 * SMOOTH_WORDS) / per - mean**2, 0))
        hashes = word_hashes(buf, start, end)
        again = np.bincount(owner[1:], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), n) / per if len(hashes) else np.zeros(n)
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        of = owner[order][first]
        distinct = np.bincount(of, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, of, times)
        shares = [np.sqrt((kinds[:, k] + usual * SMOOTH_BYTES) / (size + SMOOTH_BYTES)) for k, usual in USUAL.items()]
        out.append(np.column_stack([
            np.log1p(mean), np.log1p(spread), *shares, np.sqrt(again), np.log(distinct + SMOOTH_WORDS) - np.log(per),
            np.sqrt((most + 1) / per), np.sqrt(np.bincount(owner, length > 20, n) / per)]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def features(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with `features` as array<double>."""
    return append(documents, [text], keep, "features array<double>", lambda column: [_lists(statistics(column))])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def fit(labelled: DataFrame, label: str = "quality", shrink: float = 0.1, pool: float = 0.1) -> dict:
    """Moments per class by one aggregation, then shrunk Gaussians with Cholesky factors."""
    d = len(FEATURES)
    x = [F.col("features")[i] for i in range(d)]
    rows = labelled.where(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{label}`").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]).alias("q")).collect()
    seen = {int(r["class"]): (r["n"], np.array(r["s"]), np.array(r["q"])) for r in rows}
    total = sum(n for n, _, _ in seen.values())
    if len(seen) < 2:
        return {"constant": seen[1][0] / total if 1 in seen else 0.0 if total else 0.5}

    def moments(n, s, q):
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = q
        second = np.tril(second) + np.tril(second, -1).T
        mean = s / n
        return mean, second / n - np.outer(mean, mean)

    centre, spread = moments(total, sum(s for _, s, _ in seen.values()), sum(q for _, _, q in seen.values()))
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    model = {"scale": scale, "centre": centre, "classes": {}}
    own = {k: moments(*v) for k, v in seen.items()}
    pooled = sum(seen[k][0] * own[k][1] for k in own) / total / np.outer(scale, scale)
    for k, (mean, cov) in own.items():
        cov = (1 - pool) * cov / np.outer(scale, scale) + pool * pooled
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / d * np.eye(d) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        model["classes"][k] = {"mean": (mean - centre) / scale, "whiten": np.linalg.inv(factor),
                               "log_det": 2 * np.log(np.diag(factor)).sum(), "log_prior": np.log(seen[k][0] / total)}
    return model


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), float(model["constant"]))
    z = (x - model["centre"]) / model["scale"]
    density = {}
    for k, c in model["classes"].items():
        away = (z - c["mean"]) @ c["whiten"].T
        density[k] = c["log_prior"] - 0.5 * (c["log_det"] + (away**2).sum(axis=1))
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def score(measured: DataFrame, model: dict, keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Rows with `features` get score (0 to 1) and predicted (1 from the threshold on)."""
    def work(column: pa.Array) -> list:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        p = probability(model, flat.reshape(-1, len(FEATURES)))
        return [p.tolist(), (p >= threshold).astype(np.int32).tolist()]

    return append(measured, ["features"], keep, "score double, predicted int", work)


def settle_features(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Features written once to the shared folder, so that texts are read a single time."""
    spark = documents.sparkSession
    folder = scratch_folder(spark, "quality")
    features(documents, text, keep).write.parquet(folder)
    return spark.read.parquet(folder)
