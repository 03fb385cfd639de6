"""Following logs that are appended to.

Spark's file stream reads a file once, when it first appears. This source keeps
a byte position for every file below a folder, so a log that grows is followed
line by line, across restarts from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from veilscan.session import ship

FORMAT = "appended_lines"
SCHEMA = "path string, position long, value string"

#: Bytes looked at a time for the end of a line.
_LOOK = 1 << 16
#: Bytes of lines in an Arrow batch.
_BATCH = 1 << 22


def read_appended(
    spark: SparkSession, path: str, *, max_bytes_per_batch: int | None = None, partition_bytes: int = 32 << 20
) -> DataFrame:
    """The lines of all files below ``path`` as a stream: path, position (byte
    at which the line begins) and value.

    A line is read when its line break has been written, and once. A file that
    has become shorter was begun anew: it is read from its start. Files that
    vanish are forgotten; names that begin with ``.`` or ``_`` are left out, in
    folders too.

    ``max_bytes_per_batch`` bounds a micro-batch over all files, each of which
    gets its share; a longer line is taken whole. A run with ``availableNow`` is
    one micro-batch. Tasks read at most ``partition_bytes`` each, so a backlog
    in one file spreads over the cluster. The offset holds a number for every
    file there is: compact or remove old logs. ``path`` may be a local folder or
    the URI of a store that pyarrow reads.
    """
    ship(spark)
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream.format(FORMAT).option("path", path).option("partitionBytes", partition_bytes)
    if max_bytes_per_batch:
        reader = reader.option("maxBytesPerBatch", max_bytes_per_batch)
    return reader.load()


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return AppendedReader(
            self.options["path"], int(self.options.get("maxBytesPerBatch", 0)), int(self.options.get("partitionBytes", 32 << 20))
        )


class Stretch(InputPartition):
    """Lines of a file that begin in ``[low, high)``; ``first`` and ``last``
    bound what may be read, both at the begin of a line."""

    def __init__(self, path: str, first: int, low: int, high: int, last: int):
        self.path, self.first, self.low, self.high, self.last = path, first, low, high, last


class AppendedReader(DataSourceStreamReader):
    """Offsets are ``{path: [generation, bytes]}``, at the begin of a line; the
    generation counts how often the file was begun anew."""

    def __init__(self, path: str, most: int, size: int):
        self.root, self.most, self.size = path, most, max(size, 1)
        self.reached: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # what was planned last: Spark plans the last batch again before it
        # asks a restarted query for more
        since = self.reached or {}
        store, base = _store(self.root)
        begun = {}
        for path, size in sorted(_files(store, base)):
            generation, at = since.get(path, [0, 0])
            begun[path] = ([generation + 1, 0] if size < at else [generation, at], size)
        waiting = [path for path, ((_, at), size) in begun.items() if size > at]
        left, out = self.most or None, {path: start for path, (start, _) in begun.items()}
        # the least grown first, so that what they leave goes to the others
        waiting.sort(key=lambda path: begun[path][1] - begun[path][0][1])
        for i, path in enumerate(waiting):
            (generation, at), size = begun[path]
            share = size if left is None else at + max(1, left // (len(waiting) - i))
            with store.open_input_file(_full(base, path)) as file:
                end = _line_end(file, at, min(size, share), size)
            out[path] = [generation, end]
            if left is not None:
                left = max(0, left - (end - at))
        self.reached = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = end
        out = []
        for path, (generation, last) in sorted(end.items()):
            before, at = start.get(path, [0, 0])
            first = at if before == generation else 0
            out += [Stretch(path, first, low, min(low + self.size, last), last) for low in range(first, last, self.size)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.root)
        with store.open_input_file(_full(base, partition.path)) as file:
            at = partition.low
            if at > partition.first:
                # the line that is under way belongs to the stretch before
                at = _next_line(file, at - 1, partition.last)
            rest, begin = b"", at
            while at < partition.last and begin < partition.high:
                block = file.read_at(min(_BATCH, partition.last - at), at)
                if not block:
                    raise OSError(f"{partition.path} is shorter than its planned part: it was begun anew while it was read")
                at += len(block)
                block = rest + block
                whole = block.rfind(b"\n") + 1
                lines, rest = block[:whole].split(b"\n")[:-1], block[whole:]
                places, values = [], []
                for line in lines:
                    if begin >= partition.high:
                        break
                    places.append(begin)
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    begin += len(line) + 1
                columns = [pa.array([partition.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "position", "value"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _store(root: str) -> tuple[stores.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return stores.FileSystem.from_uri(root)
    return stores.LocalFileSystem(), root


def _full(base: str, path: str) -> str:
    return f"{base.rstrip('/')}/{path}" if path else base


def _files(store: stores.FileSystem, base: str) -> Iterator[tuple[str, int]]:
    """Files below the folder, by their path in it, with their sizes; a file
    given itself has an empty path."""
    given = store.get_file_info(base)
    if given.type == stores.FileType.File:
        yield "", given.size
        return
    for entry in store.get_file_info(stores.FileSelector(base, recursive=True, allow_not_found=True)):
        path = entry.path[len(base.rstrip("/")) + 1 :]
        if entry.type == stores.FileType.File and not any(part[0] in "._" for part in path.split("/") if part):
            yield path, entry.size


def _line_end(file, start: int, wanted: int, size: int) -> int:
    """The last end of a line in ``(start, wanted]``, or else the first behind
    it; ``start`` if there is none."""
    high = wanted
    while high > start:
        low = max(start, high - _LOOK)
        found = file.read_at(high - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        high = low
    end = _next_line(file, wanted, size)
    return end if end <= size and end > wanted else start


def _next_line(file, at: int, last: int) -> int:
    """Where the line behind the next line break begins; beyond ``last`` if
    there is none."""
    while at < last:
        block = file.read_at(min(_LOOK, last - at), at)
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not block:
            break
        at += len(block)
    return last + 1
