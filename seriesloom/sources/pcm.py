"""PCM recordings (RIFF, RF64 and BW64 wave files) as a data source that is read by byte range and written per series.

The driver only lists files. Files are cut into byte ranges, small ones share a task; a task reads the header of its
file and yields the chunks whose first byte lies in its range. So one recording of any length is read by as many tasks as
its size asks for, and no task holds more than a chunk of it.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from seriesloom.schema import RECORDINGS, SAMPLES

CHUNK = 65_536  # frames of one row
RANGE_BYTES = 64 << 20  # bytes that one task reads
OPEN_BYTES = 1 << 20  # what a file costs at least when small ones are packed
# Format tags of the header.
_INTEGER, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
_UNSET = 0xFFFFFFFF


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file are and what they look like."""

    sr: int
    channels: int
    bits: int
    floating: bool
    offset: int
    frames: int

    @property
    def block(self) -> int:
        return self.channels * ((self.bits + 7) // 8)


def absolute(folder: str) -> str:
    """The folder with its whole path: the source's own processes have another working directory."""
    return folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it, whatever its spelling."""
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:"))


def read_layout(f: pa.NativeFile, name: str) -> Layout:
    """Walk the chunks of a file up to its samples. A size that the header leaves open, or that goes past the end of
    the file, ends with the file."""
    size = f.size()
    kind, _, form = struct.unpack("<4sI4s", f.read(12).ljust(12, b"\0"))
    if kind not in (b"RIFF", b"RF64", b"BW64") or form != b"WAVE":
        raise ValueError(f"{name} is no wave file")
    at, wide, shape = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        tag, length = struct.unpack("<4sI", f.read(8))
        at += 8
        if tag == b"ds64":
            wide = struct.unpack("<Q", f.read(16)[8:])[0]
        elif tag == b"fmt ":
            body = f.read(min(length, 40))
            code, channels, sr, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == _EXTENSIBLE and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            if code not in (_INTEGER, _FLOAT) or not channels or bits not in ((8, 16, 24, 32) if code == _INTEGER else (32, 64)):
                raise ValueError(f"{name} has samples of format {code} with {bits} bits")
            shape = (sr, channels, bits, code == _FLOAT)
        elif tag == b"data":
            if shape is None:
                raise ValueError(f"{name} has samples before their format")
            length = size - at if length == _UNSET and wide is None else wide if length == _UNSET else length
            layout = Layout(*shape, at, 0)
            return Layout(*shape, at, min(length, size - at) // layout.block)
        at += length + length % 2
    raise ValueError(f"{name} has no samples")


def decode(raw: bytes, layout: Layout) -> np.ndarray:
    """Frames by channels: whole numbers as they are (8 bits are centred), floating ones as doubles."""
    if layout.floating:
        data = np.frombuffer(raw, f"<f{layout.bits // 8}").astype(np.float64)
    elif layout.bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        data = (parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8
    elif layout.bits == 8:
        data = np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    else:
        data = np.frombuffer(raw, f"<i{layout.bits // 8}").astype(np.int32)
    return data.reshape(-1, layout.channels)


def encode(data: np.ndarray, bits: int) -> bytes:
    """The reverse of ``decode`` for whole numbers."""
    if bits == 8:
        return (data + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return np.ascontiguousarray(data.astype("<i4")).view(np.uint8).reshape(*data.shape, 4)[..., :3].tobytes()
    return data.astype(f"<i{bits // 8}").tobytes()


def header(sr: int, channels: int, bits: int, frames: int) -> bytes:
    """Everything before the samples; files of 4 GiB and more carry their sizes in 64 bits."""
    block = channels * bits // 8
    size = frames * block
    shape = struct.pack("<4sIHHIIHH", b"fmt ", 16, _INTEGER, channels, sr, sr * block, block, bits)
    if size + size % 2 + 36 < _UNSET:
        return struct.pack("<4sI4s", b"RIFF", size + size % 2 + 36, b"WAVE") + shape + struct.pack("<4sI", b"data", size)
    wide = struct.pack("<4sIQQQI", b"ds64", 28, size + size % 2 + 72, size, frames, 0)
    return struct.pack("<4sI4s", b"RF64", _UNSET, b"WAVE") + wide + shape + struct.pack("<4sI", b"data", _UNSET)


class Ranges(InputPartition):
    """Byte ranges (path below the folder, first byte, byte after the last) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


def plan_ranges(files: list[tuple[str, int]], range_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Cut files into ranges and pack small ones, in the order of their names."""
    out: list[list[tuple[str, int, int]]] = []
    held, size = [], 0
    for name, length in sorted(files):
        for lo in range(0, max(length, 1), range_bytes):
            hi = min(lo + range_bytes, length)
            cost = max(hi - lo, min(OPEN_BYTES, range_bytes))
            if held and size + cost > range_bytes:
                out.append(held)
                held, size = [], 0
            held.append((name, lo, hi))
            size += cost
    return [*out, held] if held else out


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.suffix = options.get("suffix", ".wav").lower()
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.mono, self.native = options.get("mono", "false") == "true", options.get("native", "false") == "true"
        self.facts = options.get("rows", "samples") == "facts"
        self.first, self.after = int(options.get("first", 0)), int(options.get("after", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        system, base = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        names = [(i.path[len(base) :].lstrip("/"), i.size) for i in found if i.is_file]
        names = [(n, 1 if self.facts else size) for n, size in names if n.lower().endswith(self.suffix)]
        return [Ranges(r) for r in plan_ranges(names, self.range_bytes)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.folder)
        for name, lo, hi in partition.ranges:
            with system.open_input_file(f"{base}/{name}") as f:
                layout = read_layout(f, name)
                series = name[: -len(self.suffix)] if self.suffix else name
                if self.facts:
                    row = (series, layout.sr, layout.channels, layout.bits, layout.frames)
                    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], RECORDINGS.fieldNames())
                    continue
                step = CHUNK * layout.block
                # The chunks whose first byte is in the range; the file's first range has those that start at its samples.
                chunk = max(-(-(lo - layout.offset) // step), 0, self.first // CHUNK)
                while chunk * CHUNK < min(layout.frames, self.after) and layout.offset + chunk * step < hi:
                    yield self.rows(f, layout, series, chunk)
                    chunk += 1

    def rows(self, f: pa.NativeFile, layout: Layout, series: str, chunk: int) -> pa.RecordBatch:
        f.seek(layout.offset + chunk * CHUNK * layout.block)
        data = decode(f.read(min(CHUNK, layout.frames - chunk * CHUNK) * layout.block), layout)
        start = max(chunk * CHUNK, self.first)
        data = data[start - chunk * CHUNK : self.after - chunk * CHUNK]
        if self.native and layout.floating:
            raise ValueError(f"{series} has floating samples, which are no whole numbers")
        if not self.native and not layout.floating:
            data = data / float(1 << (layout.bits - 1))
        if self.mono:
            data = data.mean(axis=1, keepdims=True)
        n = data.shape[1]
        values = pa.array(np.ascontiguousarray(data.T).ravel(), pa.int32() if data.dtype.kind == "i" else pa.float64())
        x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(data), pa.int32()), values)
        columns = [pa.array([series] * n), pa.array(range(n), pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([start] * n, pa.int64()), x]
        return pa.RecordBatch.from_arrays(columns, SAMPLES.fieldNames())


class PcmWriter(DataSourceArrowWriter):
    """One file for each series: rows of a task come by series, start and channel, as Arrow batches whose samples are never
    turned into Python numbers. A file gets its name when it is whole, so a task that is lost, repeated or run twice leaves
    the same files."""

    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.folder, self.names = options["path"], names
        self.sr, self.bits = int(options["sr"]), int(options["bits"])
        if self.bits not in (8, 16, 24, 32):
            raise ValueError("samples have 8, 16, 24 or 32 bits")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = file_system(self.folder)
        series, f, part, path, held, at = None, None, "", "", [], 0

        def flush() -> None:
            nonlocal held, at
            if held:
                data = np.stack(held, axis=1)
                limit = 1 << (self.bits - 1)
                if data.min(initial=0) < -limit or data.max(initial=0) >= limit:
                    raise ValueError(f"{series} has samples of more than {self.bits} bits")
                f.write(encode(data, self.bits))
                at, held = at + len(data), []

        def close() -> None:
            if f is not None:
                flush()
                if at != frames:
                    raise ValueError(f"{series} has {at} frames of {frames}")
                f.write(b"\0" * (at * channels * self.bits // 8 % 2))
                f.close()
                system.move(part, path)

        for row, x in (pair for batch in iterator for pair in self.chunks(batch)):
            if row["series_id"] != series:
                close()
                series, channels, frames, at, held = row["series_id"], row["channels"], row["frames"], 0, []
                if not series or series.startswith("/") or ".." in series.split("/"):
                    raise ValueError(f"{series!r} can't name a file")
                path = f"{base}/{series}.wav"
                part = f"{path}.{uuid.uuid4().hex}.part"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                f = system.open_output_stream(part)
                f.write(header(self.sr, channels, self.bits, frames))
            if row["channel"] == 0:
                flush()
            if row["start"] != at or row["channel"] != len(held):
                raise ValueError(f"{series} has gaps or repeated rows at frame {row['start']}")
            held.append(x)
        close()
        return WriterCommitMessage()

    def chunks(self, batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
        """The rows of a batch without their samples, and the samples of each."""
        for row, x in zip(batch.drop_columns(["x"]).to_pylist(), batch["x"]):
            if x.values is None or x.values.null_count:
                raise ValueError(f"{row['series_id']} has missing samples")
            # A copy, so that what is held of a batch doesn't keep all of it.
            yield row, np.array(x.values.cast(pa.int64()))


class PcmSource(DataSource):
    """``spark.read.format("pcm").load(folder)`` and ``df.write.format("pcm").options(sr=..., bits=...).save(folder)``.

    Reading: ``native`` keeps whole numbers instead of scaling to [-1, 1), ``mono`` averages the channels, ``first`` and
    ``after`` give a window of frames, ``rangeBytes`` the bytes of a task, ``rows=facts`` one row for each file.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> StructType:
        if self.options.get("rows") == "facts":
            return RECORDINGS
        whole = self.options.get("native") == "true" and self.options.get("mono") != "true"
        return StructType([*SAMPLES.fields[:-1], StructField("x", ArrayType(IntegerType() if whole else DoubleType()), False)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PcmReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("recordings are only added to a folder")
        return PcmWriter({k.lower(): v for k, v in self.options.items()}, schema.fieldNames())
