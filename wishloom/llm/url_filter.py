"""URL filter by a sorted digest array.

Rules (host, path, verdict) become 64-bit xxHash keys in ascending order, cut
into shards of about `shard_rows` keys that lie in the shared folder together
with the full rule strings. A task memory-maps the shards, makes the few
(host suffix, path prefix) strings of a URL whose lengths occur among the
rules, finds their keys by binary search over whole arrays and confirms every
hit against the stored string, so two strings with one key are told apart.
Memory is the page cache; the rules never pass through the driver, which sees
one row per shard and the distinct pairs of lengths.

A rule fits its host and all subdomains if the path starts with its path. The
longest rule string wins, then the longer host. The same rule given twice with
different verdicts blocks. A URL no rule fits gets `default`.

Defined cases: a null URL or one without `://` has empty host and path and no
rule; rules with a null host or path, and an empty rule table, match nothing;
repeated rows are judged alike; extra columns stay; an existing column named
host, path, rule or verdict is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishloom.llm.blobs import mapped, put
from wishloom.plans.scale import scratch_folder

SEED = 42  # the seed of Spark's xxhash64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def build(rules: DataFrame, shard_rows: int = 4_000_000) -> list[dict]:
    """Write the digest array of a rule table; one entry per shard."""
    folder = scratch_folder(rules.sparkSession, "digests")
    keyed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
        .withColumn("key", F.xxhash64(F.concat("host", "path")))
    )
    shards = max(1, -(-keyed.count() // shard_rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        hosts, paths = table["host"].to_pylist(), table["path"].to_pylist()
        raw = [(h + p).encode() for h, p in zip(hosts, paths, strict=True)]
        name = f"part{TaskContext.get().partitionId()}"
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        host_bytes = np.array([len(h.encode()) for h in hosts], dtype=np.int32)
        lengths = sorted({(len(h), len(p)) for h, p in zip(hosts, paths, strict=True)})
        yield pa.RecordBatch.from_pydict({
            "keys": [put(folder, f"{name}-keys", table["key"].to_numpy())],
            "ends": [put(folder, f"{name}-ends", ends)],
            "raw": [put(folder, f"{name}-raw", np.frombuffer(b"".join(raw), dtype=np.uint8))],
            "split": [put(folder, f"{name}-split", host_bytes)],
            "block": [put(folder, f"{name}-block", table["block"].to_numpy(zero_copy_only=False))],
            "lengths": [[list(x) for x in lengths]],
        })

    written = (
        keyed.repartitionByRange(shards, "key").sortWithinPartitions("key")
        .mapInArrow(write, "keys string, ends string, raw string, split string, block string, lengths array<array<bigint>>")
    )
    return [row.asDict() for row in written.collect()]


def _probe(shard: dict, asked: list[tuple[bytes, int]], keys: np.ndarray) -> np.ndarray:
    """Per asked (string, bytes of its host): 1 allow, 2 block, 0 not in this shard."""
    have, ends, raw = mapped(shard["keys"]), mapped(shard["ends"]), mapped(shard["raw"])
    split, block = mapped(shard["split"]), mapped(shard["block"])
    out = np.zeros(len(asked), dtype=np.int8)
    lo, hi = np.searchsorted(have, keys, side="left"), np.searchsorted(have, keys, side="right")
    for i in np.flatnonzero(lo < hi):
        text, host = asked[i]
        for at in range(lo[i], hi[i]):
            if split[at] == host and raw[ends[at]:ends[at + 1]].tobytes() == text:
                out[i] = 2 if block[at] else 1
    return out


def judge(urls: DataFrame, shards: list[dict], url: str = "url", default: str = "allow") -> DataFrame:
    """Every row with host, path, rule (null if none fits) and verdict."""
    lengths: dict[int, list[int]] = {}
    for shard in shards:
        for host, path in shard["lengths"]:
            lengths.setdefault(host, []).append(path)
    lengths = {h: sorted(set(p)) for h, p in lengths.items()}
    shards = [{k: v for k, v in s.items() if k != "lengths"} for s in shards]

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            asked, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for n, tails in lengths.items():
                    if n == len(host) or n < len(host) and host[len(host) - n - 1] == ".":
                        suffix = host[len(host) - n:]
                        for m in tails:
                            if m > len(path):
                                break
                            asked.append(((suffix + path[:m]).encode(), len(suffix.encode())))
                            owner.append((n + m, n, i))
            keys = np.array([xxhash.xxh64_intdigest(t, SEED) for t, _ in asked], dtype=np.uint64).view(np.int64)
            found = np.zeros(len(asked), dtype=np.int8)
            for shard in shards:
                found = np.maximum(found, _probe(shard, asked, keys))
            best: dict[int, tuple] = {}
            for j in np.flatnonzero(found):
                total, host_length, i = owner[j]
                best[i] = max(best.get(i, (-1,)), (total, host_length, asked[j][0], int(found[j])))
            rule = [best[i][2].decode() if i in best else None for i in range(len(hosts))]
            verdict = [("allow", "block")[best[i][3] - 1] if i in best else default for i in range(len(hosts))]
            yield pd.DataFrame({"rule": rule, "verdict": verdict})

    link = F.col(f"`{url}`")
    parts = urls.withColumns({"host": host_of(link), "path": path_of(link)})
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return parts.withColumn("_decided", decide("host", "path")).select(
        *[f"`{c}`" for c in kept], "host", "path", F.col("_decided.rule").alias("rule"), F.col("_decided.verdict").alias("verdict"))
