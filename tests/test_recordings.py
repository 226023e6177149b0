"""Recordings read by byte range: names, widths, long files, windows and the sink."""

import os
import struct
import wave

import numpy as np
import pytest

from seriesloom.sources import pcm, recordings


def wav(path, data, sr=8000, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(data.shape[1])
        f.setsampwidth(width)
        f.setframerate(sr)
        f.writeframes(pcm.encode(data, 8 * width))


def noise(seed, frames, channels, bits=16):
    top = 1 << (bits - 1)
    return np.random.default_rng(seed).integers(-top, top, (frames, channels))


def whole(chunks):
    """{series: frames by channels} of chunk rows in any order."""
    out = {}
    for r in chunks.collect():
        out.setdefault(r["series_id"], {}).setdefault(r["channel"], []).append((r["start"], r["x"]))
    for name, channels in out.items():
        out[name] = np.stack([np.concatenate([x for _, x in sorted(channels[c])]) for c in sorted(channels)], axis=1)
    return out


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_samples_of_every_width_come_back(spark, tmp_path, bits):
    data = noise(bits, 150_001, 2, bits)
    wav(tmp_path / "a" / "x.wav", data, width=bits // 8)
    for size in (50_000, 1 << 20):  # below and above a chunk's bytes
        got = whole(recordings.read_recordings(spark, str(tmp_path), mono=False, native=True, range_bytes=size))
        assert list(got) == ["a/x"] and (got["a/x"] == data).all()
    mono = whole(recordings.read_recordings(spark, str(tmp_path)))["a/x"]
    assert np.allclose(mono[:, 0], data.mean(1) / (1 << (bits - 1)), atol=0, rtol=1e-15)


def test_equal_names_stay_apart_whatever_the_folder_is_called(spark, tmp_path, monkeypatch):
    files = ["rec/x.wav", "rec/a/x.wav", "rec/a/rec/x.wav", "rec/a/b.c.wav", "rec/X.WAV"]
    for k, name in enumerate(files):
        wav(tmp_path / name, np.full((3, 1), k))
    (tmp_path / "rec" / "note.txt").write_text("no recording")
    os.symlink(tmp_path / "rec", tmp_path / "link")
    monkeypatch.chdir(tmp_path)
    want = {f[4:-4]: k for k, f in enumerate(files)}
    for folder in ("rec", "./rec", "rec/", str(tmp_path / "link"), f"file://{tmp_path}/rec", f"file:{tmp_path}/rec", "rec/../rec"):
        got = whole(recordings.read_recordings(spark, folder, mono=False, native=True))
        assert {k: int(v[0, 0]) for k, v in got.items()} == want, folder


def test_recording_above_two_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    frames, marks = 700_000_000, [0, 65_535, 65_536, 600_000_123, 699_999_999]
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:  # 2.8 GB, all holes but for five frames
        head = pcm.header(48_000, 2, 16, frames)
        f.write(head)
        for n in marks:
            f.seek(len(head) + 4 * n)
            f.write(struct.pack("<hh", 100, -7))
        f.truncate(len(head) + 4 * frames)
    fact = recordings.read_recording_facts(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in fact] == [("long", 48_000, 2, 16, frames)]
    assert recordings.read_recordings(spark, str(tmp_path)).rdd.getNumPartitions() == -(-(4 * frames + 44) // pcm.RANGE_BYTES)
    part = recordings.read_recordings(spark, str(tmp_path), mono=False, native=True, first=599_990_000, after=600_010_000)
    got = whole(part)["long"]
    assert got.shape == (20_000, 2) and np.argwhere(got).tolist() == [[10_123, 0], [10_123, 1]]
    options = {"path": str(tmp_path), "native": "true"}
    reader = pcm.PcmReader(options)
    seen = [0, 0]
    for part in reader.partitions()[-2:]:  # the last ranges as their tasks see them
        for batch in reader.read(part):
            x = batch.column("x").flatten().to_numpy()
            seen[0] += len(x)
            seen[1] += int(np.abs(x).sum())
    assert seen[1] == 107 and 0 < seen[0] < 2 * pcm.RANGE_BYTES


def test_wide_headers_open_sizes_and_cut_files(spark, tmp_path):
    data = noise(1, 1000, 2)
    raw = pcm.encode(data, 16)
    shape = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 8000, 32_000, 4, 16)
    junk = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    (tmp_path / "wide.wav").write_bytes(
        struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + struct.pack("<4sIQQQI", b"ds64", 28, 0, len(raw), 1000, 0)
        + shape + junk + struct.pack("<4sI", b"data", 0xFFFFFFFF) + raw + b"trailing"
    )
    (tmp_path / "open.wav").write_bytes(struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + shape + struct.pack("<4sI", b"data", 0xFFFFFFFF) + raw)
    (tmp_path / "cut.wav").write_bytes(pcm.header(8000, 2, 16, 1000) + raw[:-10])
    (tmp_path / "none.wav").write_bytes(pcm.header(8000, 2, 16, 0))
    floats = np.linspace(-1, 1, 500, dtype="<f4")
    (tmp_path / "float.wav").write_bytes(
        struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, 8000, 32_000, 4, 32)
        + struct.pack("<4sI", b"data", 2000) + floats.tobytes()
    )
    got = whole(recordings.read_recordings(spark, str(tmp_path), mono=False))
    scaled = data / 32768
    assert set(got) == {"wide", "open", "cut", "float"}
    assert (got["wide"] == scaled).all() and (got["open"] == scaled).all()
    assert (got["cut"] == scaled[:997]).all() and (got["float"][:, 0] == floats).all()
    facts = {r["series_id"]: r["frames"] for r in recordings.read_recording_facts(spark, str(tmp_path)).collect()}
    assert facts == {"wide": 1000, "open": 1000, "cut": 997, "none": 0, "float": 500}
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    with pytest.raises(Exception, match="bad.wav is no wave file"):
        recordings.read_recordings(spark, str(tmp_path)).count()


def test_empty_folder(spark, tmp_path):
    assert recordings.read_recordings(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_sink_writes_what_the_source_reads(spark, tmp_path, bits):
    want = {"one": noise(2, 70_003, 1, bits), "deep/two": noise(3, 65_536, 3, bits), "deep/one": noise(4, 5, 2, bits)}
    for name, data in want.items():
        wav(tmp_path / "in" / f"{name}.wav", data, width=bits // 8)
    chunks = recordings.read_recordings(spark, str(tmp_path / "in"), mono=False, native=True)
    recordings.write_recordings(chunks, str(tmp_path / "out"), 8000, bits)
    for name, data in want.items():
        odd = data.size * bits // 8 % 2  # a chunk of odd length ends with a byte of padding, which the fixture leaves out
        made, given = ((tmp_path / side / f"{name}.wav").read_bytes() for side in ("out", "in"))
        assert made[8:40] == given[8:40] and made[44:] == given[44:] + b"\0" * odd
    assert sorted(p.suffix for p in (tmp_path / "out").rglob("*.*")) == [".wav"] * 3


def test_sink_refuses_gaps_wide_samples_and_names_outside(spark, tmp_path):
    schema = "series_id string, channel int, chunk int, start long, x array<int>"
    for rows, why in (
        ([("a", 0, 0, 0, [1, 2]), ("a", 0, 1, 3, [3])], "gaps"),
        ([("a", 0, 0, 0, [40_000])], "more than 16 bits"),
        ([("../a", 0, 0, 0, [1])], "can't name a file"),
    ):
        with pytest.raises(Exception, match=why):
            recordings.write_recordings(spark.createDataFrame(rows, schema), str(tmp_path / "out"), 8000)
        assert not list(tmp_path.rglob("*.wav"))
