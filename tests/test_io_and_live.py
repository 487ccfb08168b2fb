"""Round trips of files, and live chains that equal the batch."""

import json
import struct

import numpy as np
import pytest

from sigtrellis.functions import design
from sigtrellis.operators import blocks, events
from sigtrellis.sources import recordings, sinks
from sigtrellis.streaming import live


def matrix(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.ch, r.s] = r.v
    return out


def test_raw_wav_and_npy(spark, tmp_path):
    x = np.random.default_rng(0).integers(-1000, 1000, (50, 3)).astype("<i2")
    raw, wav, npy = (str(tmp_path / f"a.{e}") for e in ("bin", "wav", "npy"))
    x.tofile(raw)
    with open(f"{raw}.meta", "w") as f:
        json.dump({"channels": 3, "rate": 1000.0, "format": "i16", "gain": 0.5}, f)
    with open(wav, "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 36 + x.nbytes) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 3, 1000, 6000, 6, 16) + b"data" + struct.pack("<I", x.nbytes) + x.tobytes())
    np.save(npy, x)
    assert np.array_equal(matrix(recordings.read(spark, raw, framesPerPartition=16), (3, 50)), x.T * 0.5)
    assert np.allclose(matrix(recordings.read(spark, wav), (3, 50)), x.T / 32768)
    assert np.array_equal(matrix(recordings.read(spark, npy, start=10, stop=20, channels="2,0").selectExpr("ch", "s - 10 as s", "v"), (2, 10)), x.T[[2, 0], 10:20])
    assert recordings.catalogue(spark, [raw, wav, npy]).count() == 3
    with pytest.raises(ValueError):
        recordings.detect(str(tmp_path))


def test_three_byte_integers():
    raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in (-5, 0, 70000))
    assert recordings.decode(raw, "i24").tolist() == [-5, 0, 70000]


def test_raw_export_and_events(spark, tmp_path):
    x = recordings.synthetic(spark, 2, 40, seed=3)
    assert sinks.is_complete(x, 2, 40)
    assert sinks.write_raw(x, str(tmp_path / "b.bin"), 2, 1000.0) == 40
    back = matrix(recordings.read(spark, str(tmp_path / "b.bin")), (2, 40))
    assert np.allclose(back, matrix(x, (2, 40)), rtol=1e-6, atol=1e-6)
    e = sinks.event_table(events.crossings(x, 5.0), 1000.0)
    assert tuple(e.columns) == sinks.EVENT_COLUMNS
    sinks.write_events(e, str(tmp_path / "e.csv"))
    assert spark.read.csv(str(tmp_path / "e.csv"), header=True).count() == e.count()


def test_live_equals_batch(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(2, 300)) * 5
    for k in range(3):
        part = spark.createDataFrame([(c, s, float(x[c, s])) for c in range(2) for s in range(k * 100, k * 100 + 100)], live.LIVE_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.schema(live.LIVE_SCHEMA).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.LIVE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = design.iir("butterworth", 2, "lowpass", [100.0], 1000.0)
    for name, out in (("live_filter", live.filtered(stream, s)), ("live_events", live.crossings(stream, 5.0, 4.0))):
        q = live.tap(out, name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = matrix(spark.table("live_filter"), (2, 300))
    assert np.abs(got - design.sosfilt(s, x)[0]).max() < 1e-9
    want = events.crossings(whole, 5.0, 4.0).where("offset is not null").select("ch", "onset", "offset", "peak_sample", "peak_value")
    assert {tuple(r) for r in spark.table("live_events").collect()} == {tuple(r) for r in want.collect()}


def test_custom_transform_keeps_length(spark):
    x = recordings.synthetic(spark, 1, 100)
    assert blocks.transform(x, lambda v: v * 2, 3, 3, 32).count() == 100
