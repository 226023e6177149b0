"""Stream of files that have settled: a file is released when two looks at its folder agree on its size and time.

A look and what it releases are logged below ``log`` before the stream hears of it: offset k stands for the first k
logged releases. So a restart neither loses nor repeats a file, and a file that still grows isn't touched. A file
that changes after its release is released again once it has settled.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from seriesloom.sources.pcm import absolute, file_system

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
_ARROW = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])


class Some(InputPartition):
    """Files that one task reads: (path below the folder, size, time of change in ns)."""

    def __init__(self, files: list[list]) -> None:
        self.files = files


class SettledReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.log = options["path"], options["log"]
        self.pattern = options.get("pattern", "*")
        self.settle = max(0.01, float(options.get("settle", 2.0)))
        self.per_task = int(options.get("filespertask", 64))
        self.most = int(options.get("maxfilespertrigger", 1 << 20))
        self.whole = options.get("content", "true") == "true"
        self.released: dict[str, list] | None = None
        self.count = 0

    # -- the log ----------------------------------------------------------------------------
    def _write(self, name: str, value: object) -> None:
        system, base = file_system(self.log)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{name}.part") as f:
            f.write(json.dumps(value).encode())
        system.move(f"{base}/{name}.part", f"{base}/{name}")

    def _read(self, name: str):
        system, base = file_system(self.log)
        if system.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(f"{base}/{name}") as f:
            return json.loads(f.read())

    def _recall(self) -> dict[str, list]:
        """Last released size and time of every file; read from the log once for a reader's life."""
        if self.released is None:
            self.released, self.count = {}, 0
            while (files := self._read(f"{self.count}.json")) is not None:
                self.released.update({name: rest for name, *rest in files})
                self.count += 1
        return self.released

    # -- looks ------------------------------------------------------------------------------
    def _look(self) -> dict[str, list]:
        system, base = file_system(self.folder)
        released = self._recall()
        out = {}
        for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            name = i.path[len(base) :].lstrip("/")
            if i.is_file and fnmatch(i.base_name, self.pattern) and released.get(name) != [i.size, i.mtime_ns]:
                out[name] = [i.size, i.mtime_ns]
        return out

    def _again(self, before: dict[str, list]) -> dict[str, list]:
        """A look with the time since when each file is as it is: (size, time of change, first such look)."""
        at = time.time()
        return {n: [*v, before[n][2] if n in before and before[n][:2] == v else at] for n, v in self._look().items()}

    def latestOffset(self) -> dict:
        seen = self._again(self._read("look.json") or {})
        wait = max((since for *_, since in seen.values()), default=0) + self.settle - time.time()
        if wait > 0:
            time.sleep(wait)
            seen = self._again(seen)
        ready = sorted([n, *v[:2]] for n, v in seen.items() if time.time() - v[2] >= self.settle)[: self.most]
        if ready:
            self._write(f"{self.count}.json", ready)
            self._recall().update({name: rest for name, *rest in ready})
            self.count += 1
        self._write("look.json", {n: v for n, v in seen.items() if self.released.get(n) != v[:2]})
        return {"releases": self.count}

    def initialOffset(self) -> dict:
        return {"releases": 0}

    # -- reading ----------------------------------------------------------------------------
    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [f for k in range(start["releases"], end["releases"]) for f in self._read(f"{k}.json")]
        return [Some(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.folder)
        for name, size, changed in partition.files:
            content = None
            if self.whole:
                with system.open_input_stream(f"{base}/{name}") as f:
                    content = f.read(size)
            when = datetime.fromtimestamp(changed / 1e9, timezone.utc)
            yield pa.RecordBatch.from_pylist([{"path": name, "modificationTime": when, "length": size, "content": content}], schema=_ARROW)

    def commit(self, end: dict) -> None:
        """The log stays: it is what keeps a released file from being released again."""


class SettledFiles(DataSource):
    """``spark.readStream.format("settled_files")`` with the options ``log``, ``settle`` (seconds between two looks),
    ``pattern`` (of the file's own name), ``filesPerTask``, ``maxFilesPerTrigger`` and ``content`` (false leaves the bytes out)."""

    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> T.StructType:
        return FILES

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return SettledReader({k.lower(): v for k, v in self.options.items()})


def releases(log: str) -> list[int]:
    """How many files each logged look released."""
    reader, sizes = SettledReader({"path": log, "log": absolute(log)}), []
    while (files := reader._read(f"{len(sizes)}.json")) is not None:
        sizes.append(len(files))
    return sizes


def settled_files(
    spark: SparkSession, folder: str, log: str, pattern: str = "*", settle: float = 2.0, per_batch: int = 1000, content: bool = True
) -> DataFrame:
    """Stream of the files below a folder (path below it, time of change, length, bytes), each when it has settled."""
    spark.dataSource.register(SettledFiles)
    source = spark.readStream.format("settled_files").option("log", absolute(log)).option("pattern", pattern)
    return source.options(settle=str(settle), maxFilesPerTrigger=str(per_batch), content=str(content).lower()).load(absolute(folder))
