"""SpikeGLX files made here."""

import numpy as np
import pytest

from sigtrellis.sources import spikeglx

FIRST = """typeThis=imec
imSampRate=25000
nSavedChans=4
imAiRangeMax=0.5
a line of nothing
acqApLfSy=3,3,1
snsSaveChanSubset=0,2,5:6
~imroTbl=(77,0,3)(0 1 0 400 200)(1 1 0 400 200)(2 1 0 800 100)
~snsShankMap=(1,2,9)(0:1:0:1)(0:0:3:1)(0:1:5:1)
"""
NIDQ = "nSavedChans=4\nniSampRate=25000\nniAiRangeMax=5\ntypeThis=nidq\nniMNGain=200\nniMAGain=10\nacqMnMaXaDw=1,1,1,1\nsnsSaveChanSubset=all\n"


def steps(meta, **kw):
    return [c.gain and round(c.gain, 9) for c in spikeglx.channels(meta, **kw)]


def test_meta():
    meta = spikeglx.parse(FIRST)
    one = 0.5 / 512 * 1e6
    assert [c.name for c in spikeglx.channels(meta)] == ["AP0", "AP2", "LF2", "SY0"]
    assert steps(meta) == [round(one / g, 9) for g in (400, 800, 100)] + [None]
    assert steps(meta, low_band=True) == [round(one / g, 9) for g in (200, 100, 100)] + [None]
    assert spikeglx.sites(meta) == [(0, 11.0, 0.0, 0), (1, 59.0, 60.0, 0), (2, 27.0, 100.0, 0)]
    second = meta | {"imDatPrb_type": "24", "imMaxInt": "8192"}
    assert steps(second) == [round(0.5 / 8192 / 80 * 1e6, 9)] * 3 + [None] and spikeglx.sites(second)[2] == (2, 32.0, 75.0, 0)
    told = meta | {"snsGeomMap": "(made,2,300,70)(0:5:0:1)(1:6:40:1)(0:7:80:1)"}
    assert spikeglx.sites(told) == [(0, 5.0, 0.0, 0), (1, 306.0, 40.0, 1), (2, 7.0, 80.0, 0)]
    with pytest.raises(ValueError, match="lists"):
        spikeglx.saved(meta | {"snsSaveChanSubset": "0:1"})


def test_other_lines():
    meta = spikeglx.parse(NIDQ)
    assert [c.name for c in spikeglx.channels(meta)] == ["MN0", "MA0", "XA0", "DW0"]
    assert steps(meta) == [round(5 / 32768 / g * 1e6, 9) for g in (200, 10, 1)] + [None]
    assert spikeglx.sites(meta) is None and spikeglx.rate(meta) == 25000.0
    with pytest.raises(ValueError):
        spikeglx.rate({})


def test_read(spark, tmp_path):
    x = np.random.default_rng(0).integers(-500, 500, (1000, 4)).astype("<i2")
    (tmp_path / "run_g0_t0.imec0.ap.bin").write_bytes(x.tobytes() + b"\0\0\0")
    (tmp_path / "run_g0_t0.imec0.ap.meta").write_text(FIRST)
    path = str(tmp_path / "run_g0_t0.imec0.ap.bin")
    gains = [0.5 / 512 * 1e6 / g for g in (400, 800, 100)] + [1.0]
    got = {(r.ch, r.s): r.v for r in spikeglx.read(spark, path, framesPerPartition=300).collect()}
    assert len(got) == 4000 and all(abs(got[c, s] - x[s, c] * gains[c]) < 1e-9 for c in range(4) for s in range(1000))
    part = spikeglx.read(spark, path, channels="3,1", start=10, stop=20).collect()
    assert {(r.ch, r.s): round(r.v, 9) for r in part} == {(i, s): round(x[s, c] * gains[c], 9) for i, c in enumerate((3, 1)) for s in range(10, 20)}
    (tmp_path / "other.meta").write_text("a=1\n")
    with pytest.raises(ValueError, match="SpikeGLX"):
        spikeglx.read(spark, str(tmp_path / "other.bin"))
