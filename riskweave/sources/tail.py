"""A stream of lines from a folder of growing files, whose group remembers what has been handled.

The folder stands for a topic and each file for a partition of it. Offsets are bytes up to the last whole line. A group's
offsets are committed when Spark is done with a batch, after its sink (at the latest when it plans the next one); so a query that begins anew without its checkpoint goes
on behind the last batch that was handled, and a batch whose commit was lost comes again.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are read at a time.
STEP = 1 << 20


class Lines(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, group: str, most: int):
        self.uri, self.group, self.most = folder, group, most

    def _open(self):
        """The file system and the folder in it."""
        return fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def _path(self, kind: str) -> tuple[fs.FileSystem, str]:
        files, folder = self._open()
        return files, posixpath.join(folder, f".{kind}-{self.group}.json")

    def _load(self, kind: str) -> dict[str, int] | None:
        files, path = self._path(kind)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _save(self, kind: str, offsets: dict[str, int]) -> None:
        files, path = self._path(kind)
        stage = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(stage) as f:
            f.write(json.dumps(offsets).encode())
        files.move(stage, path)

    def initialOffset(self) -> dict:
        """Asked for by a query without a checkpoint: where the group has come to."""
        committed = self._load("committed") or {}
        self._save("planned", committed)
        return committed

    def latestOffset(self) -> dict:
        """What the next batch may take, behind the last one that was planned: a checkpoint may be a batch ahead of the commits."""
        planned = self._load("planned")
        out = dict(self._load("committed") or {} if planned is None else planned)
        files, folder = self._open()
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                at = out.get(info.base_name, 0)
                end = self._whole_lines(files, info.path, at, info.size)
                if end > at:
                    out[info.base_name] = end
        return out

    def _whole_lines(self, files, path: str, at: int, size: int) -> int:
        """Behind the last line end within `most` bytes, or behind the first one if a line is longer."""
        limit, end, pos = at + self.most, at, at
        with files.open_input_file(path) as f:
            f.seek(at)
            while pos < size and (pos < limit or end == at):
                block = f.read(min(STEP, size - pos))
                within = block.rfind(b"\n", 0, max(0, limit - pos))
                if within >= 0:
                    end = pos + within + 1
                elif end == at and (first := block.find(b"\n")) >= 0:
                    return pos + first + 1
                pos += len(block)
        return end

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self._save("planned", end)
        return [Lines(name, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        files, folder = self._open()
        with files.open_input_file(posixpath.join(folder, partition.file)) as f:
            f.seek(partition.start)
            at, rest = partition.start, b""
            while at < partition.end:
                block = f.read(min(STEP, partition.end - at))
                starts, lines = at - len(rest), (rest + block).split(b"\n")
                rest = lines.pop()
                at += len(block)
                offsets = []
                for line in lines:
                    offsets.append(starts)
                    starts += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array([x.decode(errors="replace") for x in lines], pa.string())], names=["partition", "offset", "line"])

    def commit(self, end: dict) -> None:
        self._save("committed", end)


class TailSource(DataSource):
    """Options: path (a folder that executors share), group, and bytes: how much of a file a batch takes at most."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "partition string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"].rstrip("/"), self.options.get("group", "default"), int(self.options.get("bytes", 64 << 20)))
