"""Topics of message envelopes kept as text files: a source with offsets for batches and streams, and its sink.

A topic is a folder. Each file in it is a partition that may grow at its end; one line is one message, ``time|line``. An offset
is the number of bytes of each file that have been given out, always at the end of a line, so a query that starts again
from its checkpoint neither loses nor repeats a message. Files are opened with Arrow's file systems, so the folder may be local,
shared, HDFS or an object store.

Cases: the last line of a file is given out by a stream once it has its line end, by a batch at once; an empty line is an empty
message; files whose names begin with ``.`` or ``_`` and empty files are passed over; a file that has become shorter than its
offset is an error; a folder without files has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from rillstone.sources.lines import decode, encode

FORMAT = "envelopes"
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
SCHEMA = "value string, partition string, position long"


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at or after ``start`` and before ``stop``."""

    path: str
    start: int
    stop: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of each file of a topic, by name."""
    system, folder = opened(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._"}


def ended(path: str, name: str, size: int, least: int) -> int:
    """Where the last whole line of the first ``size`` bytes ends; ``least`` if there is none past it."""
    system, folder = opened(path)
    with system.open_input_file(f"{folder}/{name}") as file:
        stop = size
        while stop > least:
            start = max(least, stop - CHUNK_BYTES)
            file.seek(start)
            found = file.read(stop - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            stop = start
    return least


def ranges(path: str, before: dict[str, int], after: dict[str, int], size: int) -> list[Range]:
    """The new bytes of each file, cut into ranges of ``size``."""
    cut = []
    for name, end in sorted(after.items()):
        start = before.get(name, 0)
        if end < start:
            raise ValueError(f"{name} has {end} bytes, {start} were read before")
        cut += [Range(name, at, min(at + size, end), end) for at in range(start, end, size)]
    return cut


def lines(path: str, part: Range) -> Iterator[tuple[list[bytes], int]]:
    """Lines that begin in a range, in pieces, and where each piece begins.

    A range other than a file's first starts one byte early, so that it can tell whether a line begins at its start.
    """
    system, folder = opened(path)
    with system.open_input_file(f"{folder}/{part.path}") as file:
        at = max(part.start - 1, 0)
        file.seek(at)
        inside, rest = part.start == 0, b""
        while at + len(rest) < part.end and (at < part.stop or rest):
            read = file.read(min(CHUNK_BYTES, part.end - at - len(rest)))
            data, rest = rest + read, b""
            if not inside:
                cut = data.find(b"\n")
                if cut < 0:
                    at += len(data)
                    continue
                at, data, inside = at + cut + 1, data[cut + 1 :], True
            if at >= part.stop:
                return
            final = at + len(data) >= part.end
            cut = data.rfind(b"\n") + 1
            body, rest = (data, b"") if final else (data[:cut], data[cut:])
            if body:
                found = body.split(b"\n")
                found = found[:-1] if body.endswith(b"\n") else found
                yield found, at
            at += len(body)


def batches(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    for found, at in lines(path, part):
        values, positions = [], []
        for line in found:
            if at >= part.stop:
                break
            values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            positions.append(at)
            at += len(line) + 1
        if values:
            names = pa.array([part.path] * len(values))
            yield pa.record_batch([pa.array(values, pa.string()), names, pa.array(positions, pa.int64())], ["value", "partition", "position"])


class Batch(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return ranges(self.path, {}, sizes(self.path), self.size)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition) if partition else iter(())  # none: a topic without messages


class Stream(DataSourceStreamReader):
    def __init__(self, path: str, size: int, latest: bool) -> None:
        self.path, self.size, self.latest = path, size, latest
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.latest else {}

    def latestOffset(self) -> dict:
        """Whole lines of all files; the search for a file's last line end goes back to what is known to be one."""
        found = {}
        for name, size in sizes(self.path).items():
            least = self.seen.get(name, 0)
            found[name] = size if size <= least else ended(self.path, name, size, least)
        self.seen = {name: end for name, end in found.items() if end}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.path, start, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class Envelopes(DataSource):
    """Options: ``path``, ``rangeBytes`` (64 MB), ``startingOffsets`` of streams (``earliest`` or ``latest``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema) -> Batch:  # noqa: ANN001
        return Batch(self.options["path"].rstrip("/"), self._size())

    def streamReader(self, schema) -> Stream:  # noqa: ANN001
        return Stream(self.options["path"].rstrip("/"), self._size(), self.options.get("startingOffsets", "earliest") == "latest")


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False, now_ms: Column | None = None, **options: object) -> DataFrame:
    """``partition, position, ts_ms, line, ts_ext_ms`` of a topic's messages."""
    spark.dataSource.register(Envelopes)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT).options(**options)
    return decode(reader.option("path", path).load(), now_ms=now_ms)


def write_envelopes(lines: DataFrame, path: str, checkpoint: str, ts_ms: Column | str, line: Column | str = "line") -> StreamingQuery:
    """Start a query that adds a stream's lines, with their producer time, to a topic as new files."""
    writer = lines.select(encode(ts_ms, line).alias("value")).writeStream.format("text").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
