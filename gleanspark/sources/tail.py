"""A streaming source for one text file that grows, read by executors in ranges of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class GrowingFile(DataSource):
    """``value``: the lines appended to the file at option ``path``, without a CR at their end.

    A last line without a line feed waits until it has one, however long it is. A
    file that became shorter, or another file of that name, is read from its
    start. Option ``from`` is ``start`` or ``end`` (default): whether lines that
    end before the query starts count. Option ``range`` is the bytes that a task
    reads (16 MB); a batch has as many tasks as its bytes need. All executors
    must reach the path. Register it with ``spark.dataSource.register(GrowingFile)``;
    its format is ``growing_lines``.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingFileReader(self.options["path"], self.options.get("from", "end"), int(self.options.get("range", 16 << 20)))


class GrowingFileReader(DataSourceStreamReader):
    """Offsets are sizes of the file, and which file it was. A line belongs to the range that has its line feed.

    So nothing is carried from batch to batch: the range that finds a line's end
    looks back for its start, and the driver sees no bytes of the file.
    """

    BLOCK = 1 << 20

    def __init__(self, path: str, start: str, most: int) -> None:
        self.path, self.start, self.most = path, start, most
        self.last: dict | None = None

    def now(self) -> dict:
        import os

        told = os.stat(self.path)
        return {"at": told.st_size, "file": told.st_ino}

    def initialOffset(self) -> dict:
        self.last = self.now()
        return self.last if self.start == "end" else {"at": 0, "file": self.last["file"]}

    def latestOffset(self) -> dict:
        try:
            self.last = self.now()
        except FileNotFoundError:
            # Gone while it is replaced: nothing new until it is back.
            if self.last is None:
                raise
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        at = start["at"] if start["file"] == end["file"] and start["at"] <= end["at"] else 0
        return [InputPartition((a, min(a + self.most, end["at"]))) for a in range(at, end["at"], self.most)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        at, end = partition.value
        with open(self.path, "rb") as f:
            held: list[bytes] | None = None  # the parts of the line that is not at its end; None: not looked back yet
            while at < end:
                f.seek(at)
                block = f.read(min(self.BLOCK, end - at))
                if not block:
                    break  # it became shorter meanwhile
                first, *lines = block.split(b"\n")
                if lines:
                    start = b"".join(held) if held is not None else self.before(f, partition.value[0]) + self.between(f, partition.value[0], at)
                    yield self.batch([start + first, *lines[:-1]])
                    held = [lines[-1]]
                elif held is not None:
                    held.append(first)
                at += len(block)

    @staticmethod
    def between(f, start: int, end: int) -> bytes:
        f.seek(start)
        return f.read(end - start)

    def before(self, f, at: int) -> bytes:
        """What stands before ``at`` back to a line feed or the start of the file."""
        parts: list[bytes] = []
        while at > 0:
            size = min(self.BLOCK, at)
            f.seek(at - size)
            block = f.read(size)
            cut = block.rfind(b"\n")
            parts.append(block[cut + 1 :])
            if cut >= 0:
                break
            at -= size
        return b"".join(reversed(parts))

    @staticmethod
    def batch(lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in lines], pa.string())], ["value"])
