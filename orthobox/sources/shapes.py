"""A data source for shapefiles that reads one file in many tasks.

`spark.dataSource.register(Shapes)`, then `spark.read.format("shapes").load(path)`: file, min_0, min_1, max_0, max_1 of every
shape with a place in the .shp files of a folder. The index file beside a .shp names where each record begins, eight bytes a
record; of it only the places where tasks begin are read. Options: `part_bytes`, the bytes of a task, and `window`
("lo_0,lo_1,hi_0,hi_1"), outside of which boxes are passed over before they reach Spark. A .shp without its index is one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 128 << 20
#: Bytes read at once.
BLOCK = 8 << 20
_NAMES = ("file", "min_0", "min_1", "max_0", "max_1")


@dataclass
class Part(InputPartition):
    """The records of a file from one byte to another."""

    uri: str
    start: int
    stop: int

    def __init__(self, uri: str, start: int, stop: int):
        super().__init__((uri, start, stop))
        self.uri, self.start, self.stop = uri, start, stop


def parts_of(store: fs.FileSystem, path: str, size: int, part_bytes: int) -> Iterator[tuple[int, int]]:
    """Where a file's tasks begin and end: at records, about part_bytes apart."""
    index = store.get_file_info(path[:-4] + ".shx")
    count = (index.size - 100) // 8 if index.type == fs.FileType.File else 0
    tasks = min(count, -(-size // part_bytes))
    if tasks < 2:
        yield 100, size
        return
    with store.open_input_file(index.path) as f:
        edges = []
        for task in range(tasks):
            f.seek(100 + 8 * (count * task // tasks))
            edges.append(2 * struct.unpack(">i", f.read(4))[0])
    yield from zip(edges, [*edges[1:], size])


def boxes_of(content: Iterator[bytes]) -> Iterator[tuple[float, float, float, float]]:
    """The boxes of records that come in blocks; a record may go on over blocks, and those without a place are skipped."""
    held = b""
    for block in content:
        held, at = held + block, 0
        while at + 8 <= len(held):
            length = 2 * struct.unpack_from(">i", held, at + 4)[0]
            if at + 8 + length > len(held):
                break
            kind = struct.unpack_from("<i", held, at + 8)[0] if length >= 4 else 0
            if kind % 10 == 1 and length >= 20:
                x, y = struct.unpack_from("<dd", held, at + 12)
                yield x, y, x, y
            elif kind % 10 in (3, 5, 8) and length >= 36:
                yield struct.unpack_from("<dddd", held, at + 12)
            at += 8 + length
        held = held[at:]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.window = [float(x) for x in options["window"].split(",")] if "window" in options else None

    def partitions(self) -> list[Part]:
        store, at = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".shp"))
        root = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else self.path.rstrip("/")[: -len(at.rstrip("/"))]
        return [Part(root + path, start, stop) for path, size in files for start, stop in parts_of(store, path, size, self.part_bytes)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(partition.uri)

        def blocks() -> Iterator[bytes]:
            with store.open_input_file(at) as f:
                f.seek(partition.start)
                left = partition.stop - partition.start
                while left > 0 and (block := f.read(min(BLOCK, left))):
                    left -= len(block)
                    yield block

        held: list[tuple] = []
        for box in boxes_of(blocks()):
            if self.window is None or (box[2] > self.window[0] and box[0] < self.window[2] and box[3] > self.window[1] and box[1] < self.window[3]):
                held.append((partition.uri, *box))
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "file" else pa.float64()) for n, c in zip(_NAMES, zip(*rows))], names=[*_NAMES])


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return "file string, min_0 double, min_1 double, max_0 double, max_1 double"

    def reader(self, schema) -> Reader:
        return Reader(self.options)
