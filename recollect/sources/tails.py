"""Growing text files as a streaming source: each whole line once. The offset of a stream is a byte position a file; a file that shrank is
read anew. Lines are taken when their end has come.

    spark.dataSource.register(tails.Tail)
    spark.readStream.format("tail").option("folder", "file:///logs").load()
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, at long, line string"
BLOCK = 1 << 20


def whole_until(file, start: int, size: int) -> int:
    """The position behind the last line end between `start` and `size`; `start` if there is none. Read from the end, block by block."""
    at = size
    while at > start:
        n = min(BLOCK, at - start)
        found = file.read_at(n, at - n).rfind(b"\n")
        if found >= 0:
            return at - n + found + 1
        at -= n
    return start


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, piece_bytes: int):
        self.folder, self.piece_bytes = folder, piece_bytes
        self.known: dict[str, int] = {}

    def files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, inside = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
        return system, [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:  # noqa: N802  the interface's names
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, found = self.files()
        out = {}
        for f in found:
            start = self.known.get(f.path, 0)
            start = 0 if f.size < start else start
            with system.open_input_file(f.path) as file:
                out[f.path] = whole_until(file, start, f.size)
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if stop < begin else begin
            out += [Piece(path, at, min(stop, at + self.piece_bytes)) for at in range(begin, stop, self.piece_bytes)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the piece; the last of them may end behind it."""
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(partition.path) as file:
            at = partition.start
            if at and file.read_at(1, at - 1) != b"\n":  # the line belongs to the piece before
                at = self.behind(file, at)
            rest = b""
            begin = at
            while begin < partition.end:
                data = rest + file.read_at(BLOCK, at)
                at += BLOCK
                *lines, rest = data.split(b"\n")
                out: list[tuple[int, str]] = []
                for line in lines:
                    if begin >= partition.end:
                        break
                    out.append((begin, line.decode("utf-8", "replace").removesuffix("\r")))
                    begin += len(line) + 1
                if out:
                    yield pa.record_batch([pa.array([partition.path] * len(out)), pa.array([p for p, _ in out], pa.int64()), pa.array([x for _, x in out])], names=["path", "at", "line"])
                if not lines and len(data) == len(rest) and at > file.size() + BLOCK:
                    break

    @staticmethod
    def behind(file, at: int) -> int:
        while block := file.read_at(BLOCK, at):
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return at

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options["folder"], int(self.options.get("piece_bytes", 64 << 20)))
