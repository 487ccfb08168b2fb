"""Recordings in raw, WAV and npy files as Spark data sources, and synthetic ones.

``register(spark)`` adds the formats ``sig_raw``, ``sig_wav`` and ``sig_npy``. Each
plans byte ranges of whole frames, so one file is read by many tasks and each task
holds one range. Rows are ch, s, v (value = stored * gain + offset).

Files are read through pyarrow's file systems: local paths and URIs it knows.
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of the stored formats and their numpy types (i24 has three bytes).
FORMATS = {"i8": "<i1", "u8": "<u1", "i16": "<i2", "u16": "<u2", "i24": "i24", "i32": "<i4", "f16": "<f2", "f32": "<f4", "f64": "<f8"}
SCHEMA = "ch int, s long, v double"


@dataclass(frozen=True)
class Layout:
    """What a header or sidecar says of a recording."""

    channels: int
    rate: float
    format: str = "f32"
    order: str = "time"
    gain: float = 1.0
    offset: float = 0.0
    header: int = 0
    samples: int | None = None

    @property
    def width(self) -> int:
        return 3 if self.format == "i24" else np.dtype(FORMATS[self.format]).itemsize


def decode(raw: bytes, kind: str) -> np.ndarray:
    """Stored little-endian bytes as float64."""
    if kind == "i24":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(float)
    return np.frombuffer(raw, FORMATS[kind]).astype(float)


def _open(path: str):
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def raw_layout(path: str) -> Layout:
    """From the sidecar <path>.meta (JSON): channels, rate and what else a Layout has."""
    with _open(f"{path}.meta") as f:
        known = json.loads(f.read())
    unknown = set(known) - set(Layout.__dataclass_fields__)
    if unknown:
        raise ValueError(f"{path}.meta: unknown fields {sorted(unknown)}")
    return Layout(**known)


def wav_layout(path: str) -> Layout:
    """From the RIFF header."""
    with _open(path) as f:
        head = f.read(1 << 16)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError(f"{path} isn't a WAV file")
    at, found = 12, {}
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            code = struct.unpack_from("<H", head, at + 32)[0] if code == 0xFFFE else code
            found |= {"channels": channels, "rate": float(rate), "format": f"f{bits}" if code == 3 else "u8" if bits == 8 else f"i{bits}"}
        if name == b"data":
            width = 3 if found["format"] == "i24" else np.dtype(FORMATS[found["format"]]).itemsize
            scale = 1.0 if found["format"][0] == "f" else 2.0 ** (1 - int(found["format"][1:]))
            return Layout(**found, header=at + 8, samples=size // (width * found["channels"]), gain=scale, offset=-1.0 if found["format"] == "u8" else 0.0)
        at += 8 + size + size % 2
    raise ValueError(f"{path}: no data chunk")


def npy_layout(path: str) -> Layout:
    """From a two-dimensional array [samples, channels], or [channels, samples] in Fortran order."""
    with _open(path) as f:
        head = f.read(1 << 12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{path} isn't an npy file")
    at = 10 if head[6] == 1 else 12
    size = struct.unpack_from("<H" if head[6] == 1 else "<I", head, 8)[0]
    d = ast.literal_eval(head[at : at + size].decode("latin-1"))
    kinds = {v: k for k, v in FORMATS.items()} | {"|i1": "i8", "|u1": "u8"}
    if d["descr"] not in kinds or len(d["shape"]) != 2:
        raise ValueError(f"{path}: {d['descr']} {d['shape']} can't be a recording")
    samples, channels = d["shape"]
    return Layout(channels, 1.0, kinds[d["descr"]], "channel" if d["fortran_order"] else "time", header=at + size, samples=samples)


@dataclass
class _Range(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, layout):
        self.path = options["path"]
        self.layout: Layout = layout(self.path)
        own = {k: type(getattr(self.layout, k) or 0.0)(v) for k, v in options.items() if k in ("gain", "offset", "rate")}
        self.layout = Layout(**{**asdict(self.layout), **own})
        self.frames = int(options.get("framesperpartition", 1 << 18))
        self.first, self.last = int(options.get("start", 0)), int(options.get("stop", 1 << 62))
        self.only = [int(c) for c in options["channels"].split(",")] if "channels" in options else None
        if self.only is not None and (len(set(self.only)) != len(self.only) or not all(0 <= c < self.layout.channels for c in self.only)):
            raise ValueError(f"channels: {options['channels']} aren't {self.layout.channels} different ones")

    def partitions(self):
        w = self.layout
        with _open(self.path) as f:
            there = (f.size() - w.header) // (w.width * w.channels)
        last = min(self.last, there if w.samples is None else min(there, w.samples))
        return [_Range(a, min(a + self.frames, last)) for a in range(self.first, last, self.frames)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        w, n = self.layout, part.stop - part.start
        if n <= 0:
            return
        with _open(self.path) as f:
            if w.order == "time":
                f.seek(w.header + part.start * w.width * w.channels)
                x = decode(f.read(n * w.width * w.channels), w.format).reshape(n, w.channels).T
            else:
                whole = w.samples or (f.size() - w.header) // (w.width * w.channels)
                rows = []
                for c in range(w.channels):
                    f.seek(w.header + (c * whole + part.start) * w.width)
                    rows.append(decode(f.read(n * w.width), w.format))
                x = np.stack(rows)
        s = np.arange(part.start, part.stop)
        for i, c in enumerate(self.only if self.only is not None else range(w.channels)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(s), pa.array(x[c] * w.gain + w.offset)], names=["ch", "s", "v"])


def _source(kind: str, layout):
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema):
            return _Reader({k.lower(): v for k, v in dict(self.options).items()}, layout)

    return Source


LAYOUTS = {"sig_raw": raw_layout, "sig_wav": wav_layout, "sig_npy": npy_layout}


def register(spark: SparkSession) -> None:
    for kind, layout in LAYOUTS.items():
        spark.dataSource.register(_source(kind, layout))


def detect(path: str) -> str:
    """The format of a file, by trying each."""
    for kind, layout in (("sig_wav", wav_layout), ("sig_npy", npy_layout), ("sig_raw", raw_layout)):
        try:
            layout(path)
            return kind
        except (ValueError, OSError, KeyError, TypeError):
            continue
    raise ValueError(f"{path}: no known format")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A recording as ch, s, v. Options: channels ("0,3"), start, stop, gain, offset, framesPerPartition."""
    register(spark)
    return spark.read.format(detect(path)).options(**{k: str(v) for k, v in options.items()}).load(path)


def catalogue(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, format, channels, samples, rate of each recording."""
    rows = []
    for p in paths:
        kind = detect(p)
        w = LAYOUTS[kind](p)
        with _open(p) as f:
            n = w.samples if w.samples is not None else (f.size() - w.header) // (w.width * w.channels)
        rows.append((p, kind, w.channels, int(n), float(w.rate)))
    return spark.createDataFrame(rows, "path string, format string, channels int, samples long, rate double")


def synthetic(spark: SparkSession, channels: int, samples: int, rate: float = 30000.0, seed: int = 0, hum: float = 5.0, noise: float = 10.0, partitions: int | None = None) -> DataFrame:
    """Noise, 60 Hz hum and a sine of each channel; any range of it can be made again, since noise is a hash of channel and sample."""
    base = spark.range(0, samples, 1, partitions) if partitions else spark.range(samples)
    ch = base.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumnRenamed("id", "s")
    u = lambda k: (F.pmod(F.xxhash64("ch", "s", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gauss = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    t = F.col("s") / rate
    v = gauss * noise + F.sin(2 * np.pi * 60 * t) * hum + F.sin(2 * np.pi * 400 * (F.col("ch") + 1) * t)
    return ch.select(F.col("ch").cast("int").alias("ch"), "s", v.alias("v"))
