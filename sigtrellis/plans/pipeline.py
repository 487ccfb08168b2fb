"""Declarative pipelines: a JSON or TOML document of nodes and edges, checked strictly and planned into DataFrames.

    {"version": 1,
     "nodes": {"in": {"op": "read", "path": "rec.wav"}, "bp": {"op": "iir", "band": "bandpass", "freqs": [300, 3000]},
               "ev": {"op": "crossings", "level": 4.5}},
     "edges": [["in", "bp"], ["bp", "ev"]],
     "execution": {"mode": "windows", "block": 4096}}

Every node has one input at most; branches share what stands before them. ``check``
reports all errors at once, ``plan`` says what would run, ``run`` composes the
DataFrames; nothing is computed before a sink or an action asks for it, except what
a node has to learn first (whitening).
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrellis.functions import design
from sigtrellis.operators import blocks, channels, events, points, temporal
from sigtrellis.sources import recordings, sinks

VERSION = 1
REQUIRED = object()
#: Parameters of each operation with their defaults; what isn't listed is refused.
NODES: dict[str, dict[str, object]] = {
    "read": {"path": REQUIRED, "channels": None, "start": None, "stop": None, "rate": None},
    "table": {"name": REQUIRED},
    "write": {"path": REQUIRED, "format": "parquet", "compression": "zstd"},
    "scale": {"alpha": REQUIRED, "beta": 0.0},
    "baseline": {"value": REQUIRED},
    "clamp": {"min": REQUIRED, "max": REQUIRED},
    "rectify": {},
    "square": {},
    "sqrt": {},
    "log10": {},
    "car": {},
    "cmr": {},
    "laplacian": {"rows": REQUIRED, "cols": REQUIRED},
    "whiten": {"epsilon": 1e-6},
    "remap": {"pairs": REQUIRED, "base": 0},
    "iir": {"band": REQUIRED, "freqs": REQUIRED, "design": "butterworth", "order": 5, "ripple": None, "zero_phase": True},
    "notch": {"freq": REQUIRED, "q": 30.0, "zero_phase": True},
    "sos": {"sections": REQUIRED, "zero_phase": False},
    "fir": {"taps": REQUIRED, "centred": False, "edge": "zeros"},
    "gaussian": {"sigma": REQUIRED},
    "median": {"width": REQUIRED},
    "teager_kaiser": {},
    "resample": {"up": REQUIRED, "down": REQUIRED},
    "crossings": {"level": REQUIRED, "release": None, "min_duration": 0, "refractory": 0, "min_duration_ms": None, "refractory_ms": None, "direction": "rising"},
}
EXECUTION = {"mode": "windows", "block": blocks.BLOCK, "rate": 1.0}
#: What a live run needs of an operation: nothing, so many past samples, or the whole recording.
OFFLINE = {"whiten", "resample", "gaussian", "median"}


@dataclass(frozen=True)
class Spec:
    nodes: dict[str, dict]
    inputs: dict[str, str]
    execution: dict

    def order(self) -> list[str]:
        """Nodes with each input before what it feeds."""
        out: list[str] = []
        while len(out) < len(self.nodes):
            out += [n for n in self.nodes if n not in out and self.inputs.get(n) in (None, *out)][:1]
        return out


def load(text: str | dict) -> Spec:
    """A checked spec from JSON, TOML or a dict; ValueError with every error."""
    doc = text if isinstance(text, dict) else json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
    errors = [f"unknown field {k}" for k in set(doc) - {"version", "nodes", "edges", "execution"}]
    if doc.get("version") != VERSION:
        errors.append(f"version has to be {VERSION}")
    nodes, inputs = {}, {}
    for name, node in doc.get("nodes", {}).items():
        known = NODES.get(node.get("op"))
        if known is None:
            errors.append(f"{name}: no operation called {node.get('op')}")
            continue
        errors += [f"{name}: unknown field {k}" for k in sorted(set(node) - set(known) - {"op"})]
        errors += [f"{name}: {k} is missing" for k, d in known.items() if d is REQUIRED and k not in node]
        nodes[name] = {k: d for k, d in known.items() if d is not REQUIRED} | node
    for a, b in doc.get("edges", []):
        if a not in nodes or b not in nodes:
            errors.append(f"edge {a} -> {b}: no such node")
        elif b in inputs:
            errors.append(f"{b} has two inputs")
        else:
            inputs[b] = a
    for name, node in nodes.items():
        source = node["op"] in ("read", "table")
        if source and name in inputs:
            errors.append(f"{name}: a source has no input")
        if not source and name not in inputs:
            errors.append(f"{name} isn't connected")
        seen, at = set(), name
        while at in inputs and at not in seen:
            seen.add(at)
            at = inputs[at]
        if at in seen:
            errors.append(f"{name} is part of a circle")
        if node["op"] == "iir" and node["design"] == "chebyshev1" and node["ripple"] is None:
            errors.append(f"{name}: chebyshev1 needs ripple")
        if node["op"] == "crossings" and node["direction"] not in ("rising", "falling"):
            errors.append(f"{name}: the direction is rising or falling")
        elif node["op"] == "crossings" and node.get("release") is not None and "level" in node and (node["release"] > node["level"]) == (node["direction"] == "rising") and node["release"] != node["level"]:
            errors.append(f"{name}: the release is past the level")
        if node["op"] == "clamp" and node.get("min", 0) > node.get("max", 0):
            errors.append(f"{name}: min is above max")
    execution = doc.get("execution", {})
    errors += [f"execution: unknown field {k}" for k in sorted(set(execution) - set(EXECUTION))]
    execution = EXECUTION | execution
    if execution["mode"] not in ("windows", "stream"):
        errors.append("execution: mode has to be windows or stream")
    if execution["mode"] == "stream":
        errors += refusals(nodes)
    if errors:
        raise ValueError("; ".join(errors))
    return Spec(nodes, inputs, execution)


def refusals(nodes: dict[str, dict]) -> list[str]:
    """Why nodes can't run exactly on a stream, all of them."""
    out = [f"{n}: {d['op']} isn't exact on a stream" for n, d in nodes.items() if d["op"] in OFFLINE]
    out += [f"{n}: zero phase needs the future" for n, d in nodes.items() if d.get("zero_phase")]
    return out + [f"{n}: a centred filter needs the future" for n, d in nodes.items() if d.get("centred")]


def schema() -> dict:
    """JSON Schema of a spec."""
    one = [{"type": "object", "properties": {"op": {"const": op}, **{k: {} for k in p}}, "required": ["op", *[k for k, d in p.items() if d is REQUIRED]], "additionalProperties": False} for op, p in NODES.items()]
    return {"type": "object", "required": ["version", "nodes"], "properties": {"version": {"const": VERSION}, "nodes": {"type": "object", "additionalProperties": {"oneOf": one}}, "edges": {"type": "array"}, "execution": {"type": "object"}}}


def sections(node: dict, rate: float) -> np.ndarray:
    if node["op"] == "iir":
        return design.iir(node["design"], node["order"], node["band"], node["freqs"], rate, node["ripple"])
    return design.notch(node["freq"], node["q"], rate) if node["op"] == "notch" else design.checked(node["sections"])


def kernel(node: dict, rate: float) -> blocks.Kernel | None:
    """The window kernel of a node, or None if it isn't one."""
    op = node["op"]
    if op in ("iir", "notch", "sos"):
        return blocks.iir(sections(node, rate), zero_phase=node["zero_phase"])
    if op == "fir":
        return blocks.fir(node["taps"], node["centred"], node["edge"])
    if op == "gaussian":
        return blocks.gaussian(node["sigma"])
    if op == "median":
        return blocks.running_median(node["width"])
    return None


POINTWISE: dict[str, Callable] = {
    "scale": lambda v, n: channels.scale(v, n["alpha"], n["beta"]),
    "baseline": lambda v, n: channels.subtract_baseline(v, n["value"]),
    "clamp": lambda v, n: channels.clamp(v, n["min"], n["max"]),
    "rectify": lambda v, n: channels.rectify(v),
    "square": lambda v, n: channels.square(v),
    "sqrt": lambda v, n: channels.sqrt(v),
    "log10": lambda v, n: channels.log10(v),
}


def _frame(signal: DataFrame, f: Callable) -> DataFrame:
    """f over the array of all channels of a sample, in order of channel."""
    rows = signal.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("ch", "v"))).alias("a"))
    values, names = F.transform("a", lambda e: e["v"]), F.transform("a", lambda e: e["ch"])
    return rows.select("s", F.explode(F.arrays_zip(names.alias("ch"), f(values).alias("v"))).alias("e")).select("e.ch", "s", "e.v")


def _apply(signal: DataFrame, node: dict, rate: float, block: int) -> DataFrame:
    op = node["op"]
    if op in POINTWISE:
        return signal.withColumn("v", POINTWISE[op](F.col("v"), node))
    if op in ("car", "cmr"):
        return _frame(signal, channels.average_reference if op == "car" else channels.median_reference)
    if op == "laplacian":
        return _frame(signal, lambda v: channels.laplacian(v, node["rows"], node["cols"]))
    if op == "whiten":
        frames = signal.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("ch", "v"))).alias("a")).select(F.col("s").alias("id"), F.transform("a", lambda e: e["v"]).alias("x"))
        _, _, cov = points.moments(frames)
        return _frame(signal, lambda v: channels.spatial(v, points.zca(cov, node["epsilon"]).tolist()))
    if op == "remap":
        return channels.remap(signal, [tuple(p) for p in node["pairs"]], node["base"])
    if op == "teager_kaiser":
        return signal.withColumn("v", temporal.teager_kaiser(F.col("v"), temporal.over()))
    if op == "resample":
        return blocks.resample(signal, node["up"], node["down"], block)
    samples = lambda key: node[key] if node[f"{key}_ms"] is None else round(node[f"{key}_ms"] * rate / 1000)
    return events.crossings(signal, node["level"], node["release"], "ch", samples("min_duration"), samples("refractory"), node["direction"])


def plan(spec: Spec) -> list[dict]:
    """What runs: a row for each node with its input, kernels' halos, and whether windows of its neighbours join its shuffle."""
    rate, out = spec.execution["rate"], []
    for name in spec.order():
        node = spec.nodes[name]
        k = kernel(node, rate)
        fused = k is not None and kernel(spec.nodes[spec.inputs[name]], rate) is not None
        out.append({"node": name, "op": node["op"], "input": spec.inputs.get(name), "left": k.left if k else 0, "right": k.right if k else 0, "fused": fused})
    return out


def run(spark: SparkSession, spec: Spec | str | dict, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The DataFrame of every node. Runs of window kernels become one shuffle with the sum of their halos."""
    spec = spec if isinstance(spec, Spec) else load(spec)
    rate, block = spec.execution["rate"], spec.execution["block"]
    chains: dict[str, tuple[DataFrame, list[blocks.Kernel]]] = {}
    out: dict[str, DataFrame] = {}
    for name in spec.order():
        node, source = spec.nodes[name], spec.inputs.get(name)
        k = kernel(node, rate)
        if node["op"] == "read":
            options = {x: node[x] for x in ("start", "stop", "rate") if node[x] is not None}
            if node["channels"] is not None:
                options["channels"] = ",".join(map(str, node["channels"]))
            out[name] = recordings.read(spark, node["path"], **options)
        elif node["op"] == "table":
            out[name] = (tables or {})[node["name"]]
        elif k is not None:
            start, chain = chains.get(source, (out[source], []))
            chains[name] = (start, [*chain, k])
            out[name] = blocks.run(start, chains[name][1], block)
        elif node["op"] == "write":
            (sinks.write_events if "onset" in out[source].columns else sinks.write_signal)(out[source], node["path"])
            out[name] = out[source]
        else:
            out[name] = _apply(out[source], node, rate, block)
    return out


#: Named chains of operations with parameters that a caller may override as "<op>.<parameter>".
RECIPES: dict[str, list[dict]] = {
    "spike band": [{"op": "iir", "band": "bandpass", "freqs": [300.0, 6000.0]}, {"op": "cmr"}],
    "lfp": [{"op": "iir", "band": "lowpass", "freqs": [300.0], "order": 4}, {"op": "car"}],
    "emg envelope": [{"op": "iir", "band": "bandpass", "freqs": [20.0, 450.0], "order": 4}, {"op": "teager_kaiser"}, {"op": "gaussian", "sigma": 20.0}],
    "emg envelope (rectified)": [{"op": "iir", "band": "bandpass", "freqs": [20.0, 450.0], "order": 4}, {"op": "rectify"}, {"op": "iir", "band": "lowpass", "freqs": [6.0], "order": 4}],
    "rms": [{"op": "square"}, {"op": "iir", "band": "lowpass", "freqs": [10.0], "order": 4}, {"op": "sqrt"}],
    "mains": [{"op": "notch", "freq": 60.0, "q": 30.0}, {"op": "notch", "freq": 120.0, "q": 30.0}],
    "emg onsets": [
        {"op": "iir", "band": "bandpass", "freqs": [20.0, 450.0], "order": 4},
        {"op": "rectify"},
        {"op": "iir", "band": "lowpass", "freqs": [6.0], "order": 4},
        {"op": "crossings", "level": 50.0, "release": 25.0, "min_duration_ms": 30.0, "refractory_ms": 80.0},
    ],
}


def recipe(name: str, table: str, rate: float, **overrides) -> dict:
    """The spec of a recipe over a table."""
    nodes: dict[str, dict] = {"in": {"op": "table", "name": table}}
    for i, step in enumerate(RECIPES[name]):
        nodes[f"n{i}"] = step | {k.split(".", 1)[1]: v for k, v in overrides.items() if k.split(".", 1)[0] == step["op"]}
    names = list(nodes)
    return {"version": VERSION, "nodes": nodes, "edges": [list(e) for e in zip(names, names[1:])], "execution": {"rate": rate}}
