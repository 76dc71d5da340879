"""Lines of growing text files by byte offset: a source that is resumed where it stopped, with a cursor for each line.

The offset of the stream is a position for each file, so what the driver handles is one entry a file and one a range, never a
line. A batch takes in at most batch_bytes (but one line at least), deals them in ranges of range_bytes and sends these
to tasks, which read them from the file system themselves. A line belongs to the range that it starts in, so a line that is cut
by the end of a range counts once and whole, however long it is. A line without an end waits, as a writer may not be done
with it; lines() of a finished file takes it too.

Files have to grow at their end only. Names that start with a dot or an underscore are passed over, and an empty file or folder
gives nothing. Bytes that are no UTF-8 become U+FFFD. The file system is the one that pyarrow takes for the path, so
it has to be one that all executors reach.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

RANGE_BYTES = 64 << 20
BATCH_BYTES = 64 << 30
CHUNK = 1 << 20
OUT_BYTES = 8 << 20
RANGES = "file string, begin long, end long"
LINES = "file string, start long, next long, line string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of each file of a folder, or of the one file, in order of names."""
    system, place = _open(path)
    if system.get_file_info(place).type == fs.FileType.File:
        found = [system.get_file_info(place)]
    else:
        found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
    # a path without its file system, which the tasks take from the path of the source
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


def line_end(system: fs.FileSystem, file: str, begin: int, most: int, size: int) -> int:
    """The end of the last line that ends within `most` bytes from begin; of the next line if none does; begin if that has no end."""
    with system.open_input_file(file) as f:
        at = min(size, begin + most)
        while at > begin:
            low = max(begin, at - CHUNK)
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
        at = min(size, begin + most)
        while at < size:
            f.seek(at)
            data = f.read(min(CHUNK, size - at))
            if (cut := data.find(b"\n")) >= 0:
                return at + cut + 1
            at += len(data)
    return begin


def deal(begin: dict[str, int], end: dict[str, int], range_bytes: int) -> Iterator[tuple[str, int, int]]:
    for file, last in end.items():
        for a in range(begin.get(file, 0), last, range_bytes):
            yield file, a, min(a + range_bytes, last)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.batch_bytes = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("batch_bytes", BATCH_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict):
        system, end, left = _open(self.path)[0], dict(start), self.batch_bytes
        for file, size in sizes(self.path).items():
            begin = start.get(file, 0)
            if size > begin and left > 0:
                last = line_end(system, file, begin, left, size)
                left -= last - begin
                if last > begin:
                    end[file] = last
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(list(deal(start, end, self.range_bytes)))  # Spark copies it, which a generator does not allow

    def commit(self, end: dict) -> None:
        pass


class ByteRanges(DataSource):
    """Ranges of files that hold lines not yet read, as a stream."""

    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return RANGES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _open(path)[0]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "start", "next", "line"])

        for x in (r for b in batches for r in b.to_pylist()):
            with system.open_input_file(x["file"]) as raw:
                f = io.BufferedReader(raw, CHUNK)
                at, rows, held = x["begin"], [], 0
                if at:  # what is left of a line that started before goes by
                    f.seek(at - 1)
                    at -= 1
                    while at < x["end"] and (part := f.readline(CHUNK)):
                        at += len(part)
                        if part.endswith(b"\n"):
                            break
                while at < x["end"] and (line := f.readline()):
                    rows.append((x["file"], at, at + len(line), line.decode("utf-8", "replace").rstrip("\r\n")))
                    at, held = at + len(line), held + len(line)
                    if held > OUT_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def lines(spark: SparkSession, path: str, cursors: dict[str, int] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """LINES of finished files behind the given positions."""
    ranges = list(deal(cursors or {}, sizes(path), range_bytes))
    return spark.createDataFrame(ranges, RANGES).repartition(max(1, len(ranges))).mapInArrow(_read(path), LINES)


def follow(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """LINES of growing files as a stream."""
    spark.dataSource.register(ByteRanges)
    ranges = spark.readStream.format("byteranges").option("path", path).option("range_bytes", range_bytes).option("batch_bytes", batch_bytes).load()
    # few small rows, dealt to all tasks; the lines are read behind the exchange
    return ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_read(path), LINES)
