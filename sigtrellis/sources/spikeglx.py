"""SpikeGLX recordings: a .bin of 16-bit frames beside a .meta of key=value lines.

Samples are read by byte range through the raw reader; each channel has its own gain,
and comes out in microvolts, words of digital and sync lines as they are stored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrellis.sources import recordings

#: Probe types of the second generation (gain 80; rows 15, columns 32, shanks 250 micrometres apart).
SECOND = {21, 24, 2003, 2004, 2013, 2014, 2020, 2021}
#: X of the two columns on even and odd rows of the first generation, whose rows are 20 micrometres apart.
FIRST_X = ((43.0, 11.0), (59.0, 27.0))


@dataclass(frozen=True)
class Channel:
    """One saved channel: its name and what one step of its samples is, in microvolts (None: a word of lines)."""

    name: str
    gain: float | None


def parse(text: str) -> dict[str, str]:
    """The keys of a .meta, those of tables without their ~. Lines without = are passed by."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line)
    return {k.strip().lstrip("~"): v.strip() for k, v in pairs}


def meta_path(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path) + ".meta"


def read_meta(path: str) -> dict[str, str]:
    """The .meta of a .bin."""
    with recordings._open(meta_path(path)) as f:
        meta = parse(f.read().decode("utf-8", "replace"))
    if "nSavedChans" not in meta:
        raise ValueError(f"{path}: its .meta isn't of SpikeGLX")
    return meta


def _numbers(meta: dict[str, str], *keys: str) -> list[int] | None:
    found = next((meta[k] for k in keys if k in meta), None)
    return None if found is None else [int(x) for x in found.split(",")]


def _groups(table: str) -> list[list[str]]:
    """(a b c)(d:e:f) as lists of fields."""
    return [re.split(r"[ ,:]+", g.strip()) for g in re.findall(r"\(([^)]*)\)", table)]


def saved(meta: dict[str, str]) -> list[int]:
    """The acquired number of each saved channel, in the file's order."""
    n, listed = int(meta["nSavedChans"]), meta.get("snsSaveChanSubset", "all")
    if listed == "all":
        return list(range(n))
    out = []
    for part in listed.split(","):
        first, _, last = part.partition(":")
        out += range(int(first), int(last or first) + 1)
    if len(out) != n:
        raise ValueError(f"snsSaveChanSubset lists {len(out)} channels, the file has {n}")
    return out


def rate(meta: dict[str, str]) -> float:
    for key in ("imSampRate", "niSampRate"):
        if key in meta:
            return float(meta[key])
    raise ValueError("the .meta has no sample rate")


def _second(meta: dict[str, str]) -> bool:
    return int(meta.get("imDatPrb_type", 0)) in SECOND


def _imec_counts(meta: dict[str, str]) -> tuple[int, int]:
    ap, lf, *_ = _numbers(meta, "acqApLfSy", "snsApLfSy") or [int(meta["nSavedChans"]) - 1, 0, 1]
    return ap, lf


def _probe_gains(meta: dict[str, str], n: int) -> list[tuple[float, float]]:
    """Gains of both bands of each acquired channel; those that no table names have the usual ones."""
    if _second(meta):
        return [(80.0, 80.0)] * n
    rows = _groups(meta.get("imroTbl", ""))[1 : n + 1]
    told = [(float(r[3]), float(r[4])) if len(r) > 4 else (500.0, 250.0) for r in rows]
    return told + [(500.0, 250.0)] * (n - len(told))


def channels(meta: dict[str, str], low_band: bool = False) -> list[Channel]:
    """Names and gains in the file's order. low_band: the file has the LF band alone, numbered from 0 or behind the AP channels."""

    def step(most: str, whole: str, usual: float, gain: float) -> float:
        return float(meta[most]) / float(meta.get(whole, usual)) / gain * 1e6

    out = []
    if meta.get("typeThis") == "nidq":
        mn, ma, xa, *_ = _numbers(meta, "acqMnMaXaDw", "snsMnMaXaDw") or [0, 0, int(meta["nSavedChans"]), 0]
        kinds = (("MN", mn, float(meta.get("niMNGain", 1))), ("MA", ma, float(meta.get("niMAGain", 1))), ("XA", xa, 1.0))
        for c in saved(meta):
            for name, n, gain in kinds:
                if c < n:
                    out.append(Channel(f"{name}{c}", step("niAiRangeMax", "niMaxInt", 32768, gain)))
                    break
                c -= n
            else:
                out.append(Channel(f"DW{c}", None))
        return out
    ap, lf = _imec_counts(meta)
    gains = _probe_gains(meta, ap)
    for c in saved(meta):
        if c < ap:
            out.append(Channel(f"AP{c}", step("imAiRangeMax", "imMaxInt", 512, gains[c][low_band])))
        elif c < ap + lf:
            out.append(Channel(f"LF{c - ap}", step("imAiRangeMax", "imMaxInt", 512, gains[(c - ap) % max(ap, 1)][1])))
        else:
            out.append(Channel(f"SY{c - ap - lf}", None))
    return out


def sites(meta: dict[str, str]) -> list[tuple[int, float, float, int]] | None:
    """ch, x, y in micrometres, shank of the saved neural channels, None without a map of them."""
    if meta.get("typeThis") == "nidq":
        return None
    if "snsGeomMap" in meta:
        head, *rows = _groups(meta["snsGeomMap"])
        pitch = float(head[2]) if len(head) > 2 else 0.0
        places = [(float(x) + int(shank) * pitch, float(z), int(shank)) for shank, x, z, *_ in rows]
    elif "snsShankMap" in meta:
        places = []
        for shank, column, row in (map(int, r[:3]) for r in _groups(meta["snsShankMap"])[1:]):
            if _second(meta):
                places.append((shank * 250.0 + column * 32.0, row * 15.0, shank))
            else:
                places.append((FIRST_X[row % 2][min(column, 1)], row * 20.0, shank))
    else:
        return None
    neural = [i for i, c in enumerate(saved(meta)) if c < sum(_imec_counts(meta))]
    return [(i, *place) for i, place in zip(neural, places)]


def layout(path: str) -> recordings.Layout:
    """Frames up to the end of the file, for it may still be written."""
    meta = read_meta(path)
    return recordings.Layout(int(meta["nSavedChans"]), rate(meta), "i16")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A .bin as ch, s, v; options as for recordings.read, but for gain and offset. ch counts the channels asked for."""
    meta = read_meta(path)
    spark.dataSource.register(recordings._source("sig_spikeglx", layout))
    raw = spark.read.format("sig_spikeglx").options(**{k: str(v) for k, v in options.items()}).load(path)
    gains = [c.gain or 1.0 for c in channels(meta, ".lf." in path)]
    asked = [int(c) for c in str(options["channels"]).split(",")] if "channels" in options else range(len(gains))
    return raw.select("ch", "s", (F.col("v") * F.get(F.array(*[F.lit(gains[c]) for c in asked]), F.col("ch"))).alias("v"))
