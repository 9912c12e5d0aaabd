"""Usage figures in metadata of any depth, against a walk written in Python."""

import json
import random

from wishloom.functions.fixed_values import USAGE_COMPONENT_HOLDERS, USAGE_CONTAINER_MARKERS, USAGE_CONTAINERS
from wishloom.operators.usage import flatten_usage

KEYS = ["usage", "metrics", "components", "summaryTotals", "tokensIn", "output_tokens", "apiCalls", "cpuMs", "note", "resources", "x.y", "requests", "pipeline", "usageMetadata", "llm"]


def metric_of(key):
    k = "".join(c for c in key.lower() if c.isalnum())
    has = lambda *w: any(x in k for x in w)
    return (has("token") and has("out", "completion", "response", "candidate", "in", "prompt") or has("api") and has("call", "request") or k == "requests"
            or has("cpu") and has("ms", "millisecond", "time", "duration") or has("ram", "mem") and has("mb", "byte", "footprint") and has("sec", "time", "duration", "footprint"))


def number(value):
    try:
        return float(str(value).strip())
    except ValueError:
        return None


def scalars(node, path):
    return [(f"{path}.{k}", k, v) for k, v in node.items() if not isinstance(v, (dict, list, bool)) and v is not None]


def descend(node, path, shut=()):
    found = scalars(node, path)
    for k, v in node.items():
        here = f"{path}.{k}"
        if isinstance(v, list) and here not in shut:
            found += [x for i, item in enumerate(v) if isinstance(item, dict) for x in descend(item, f"{here}[{i}]", shut)]
        elif isinstance(v, dict) and any(m in "".join(c for c in k.lower() if c.isalnum()) for m in USAGE_CONTAINER_MARKERS):
            found += descend(v, here, shut)
    return found


def at(node, names):
    for n in names:
        node = node.get(n) if isinstance(node, dict) else None
    return node


def by_hand(meta):
    if not isinstance(meta, dict):
        return []
    holders = [(), *[(h,) for h in USAGE_COMPONENT_HOLDERS], ("llm",), ("llm", "usage")]
    path = lambda names: ".".join(["$", *names])
    shut, out = {f"{path(h)}.components" for h in holders}, []
    for h in holders:
        listed = at(meta, [*h, "components"])
        for i, entry in enumerate(listed if isinstance(listed, list) else []):
            if isinstance(entry, dict):
                base = f"{path(h)}.components[{i}]"
                found = [x for part in ("usage", "metrics") if isinstance(entry.get(part), dict) for x in descend(entry[part], f"{base}.{part}")]
                out += found if any(metric_of(k) and number(v) is not None for _, k, v in found) else scalars(entry, base)
    for c in [*[(c,) for c in USAGE_CONTAINERS], ("llm", "usage"), *([] if isinstance(meta.get("usageMetadata"), dict) else [("llm", "usageMetadata")])]:
        if isinstance(at(meta, c), dict):
            out += descend(at(meta, c), path(c), shut)
    return out


def invented(rng, depth):
    kind = rng.randrange(8) if depth else 7
    if kind < 4:
        return {k: invented(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(1, 6))}
    if kind < 6:
        return [invented(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, 2.5, "7", " 3 ", "many", "{", True, None])


def test_any_depth_equals_a_walk(spark):
    rng = random.Random(11)
    metas = [{k: invented(rng, 7) for k in rng.sample(KEYS, 8)} for _ in range(150)]
    deep = 5
    for name in ["usage", "resources", "metricA", "summary", "totals", "footprints", "usage"]:
        deep = {name: deep, "tokensIn": 1}
    rows = [json.dumps(m) for m in [*metas, {"usage": deep}, [1], 5, {}]] + ["no json {", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "path long, meta string").withColumnRenamed("path", "op")
    got = {}
    for r in flatten_usage(df, "op", "meta", ["meta"]).collect():
        got.setdefault(r.op, []).append((r.path, r.metric is not None, r.value))
    total = 0
    for i, text in enumerate(rows[:-3]):
        want = [(p, bool(metric_of(k)), number(v)) for p, k, v in by_hand(json.loads(text))]
        total += len(want)
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str)
    assert total > 500 and not set(got) & {len(rows) - 1, len(rows) - 2, len(rows) - 3}
    assert len([p for p, metric, _ in got[150] if metric]) == 7


def test_work_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "{}")], "op long, meta string")
    plan = flatten_usage(df, "op", "meta")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "InPandas" not in plan and "InArrow" not in plan
