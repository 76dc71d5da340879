"""Token-id files: each document compressed by itself with one shared zstandard dictionary.

A folder holds files `part-*.tok` and a table `index`. A file is MAGIC, the dictionary (length and bytes), then one zstandard
frame a document; the index has, for each document, its file, the frame's offset and length, its number of ids, its first
id's place in the file, and the dictionary's SHA-256. So one short document is read by one seek and one small frame. Ids
are unsigned little-endian, of 2 bytes if the vocabulary allows and else of 4.

The dictionary is trained on the serialized ids of those of at most SAMPLE_CHARS characters among the SAMPLE documents of the
smallest hashed doc_id: a documented bound. Documents are range-partitioned and sorted by doc_id; each task writes
one file, named by its attempt. The index has only files of tasks that succeeded, so lost executors leave at most
files that no index names. The folder may be any place that Arrow's file systems reach.

Null texts have the end id only. Null doc_ids come first. Rows that repeat a doc_id are each written, in the order of their texts.
Empty tables give an empty index.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.common import by_bytes, new_folder, partitions, smallest_hashed
from lumora.llm.tokens import encoder

MAGIC = b"LTOK0001"
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 800, 8_000, 64 << 10
LEVEL = 3


def train(docs: DataFrame, path: str, kind: str) -> bytes:
    """A dictionary of ids, or nothing if there are too few documents for one."""
    short = docs.select("doc_id", F.when(F.length("text") <= SAMPLE_CHARS, F.col("text")).alias("text"))
    texts = [r["text"] for r in smallest_hashed(short, "doc_id", SAMPLE).collect() if r["text"]]  # bounded: SAMPLE texts of SAMPLE_CHARS
    e = encoder(path, kind)
    samples = []
    for t in texts:
        ids, _ = e.encode(pa.array([t], pa.string()))
        samples.append(ids.astype(e.dtype).tobytes())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


INDEX = "doc_id long, file string, offset long, n_bytes long, n_tokens long, file_start long, part int, dictionary_sha256 string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _write(folder: str, path: str, kind: str, end_id: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, kind)
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.tok"
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        digest = hashlib.sha256(dictionary).hexdigest()
        tail = np.array([end_id], e.dtype).tobytes()
        out, offset, place = None, 0, 0
        try:
            for batch in by_bytes(batches, "text", 4 << 20, give_back=False):
                if out is None:
                    out = fs.open_output_stream(f"{at}/{name}")
                    head = MAGIC + struct.pack("<BI", e.dtype.itemsize, len(dictionary)) + dictionary
                    out.write(head)
                    offset = len(head)
                ids, n = e.encode(batch.column("text"))
                raw, cuts = memoryview(ids.astype(e.dtype).tobytes()), (np.concatenate([[0], np.cumsum(n)]) * e.dtype.itemsize).tolist()
                frames = [packer.compress(bytes(raw[a:b]) + tail) for a, b in zip(cuts, cuts[1:], strict=False)]
                out.write(b"".join(frames))
                sizes, count = np.array([len(f) for f in frames], np.int64), n + 1
                rows = [batch.column("doc_id"), pa.array([name] * len(frames)), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(count, pa.int64()), pa.array(place + np.cumsum(count) - count, pa.int64()), pa.array([part] * len(frames), pa.int32()), pa.array([digest] * len(frames))]
                offset, place = offset + int(sizes.sum()), place + int(count.sum())
                yield pa.RecordBatch.from_arrays(rows, _names(INDEX))
        finally:
            if out is not None:
                out.close()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """Write the files and the index of all documents in ascending doc_id order; the index as read again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train(rows, tokenizer, kind)
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(folder, tokenizer, kind, end_id, dictionary), INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


class Reader:
    """Random access to one file."""

    def __init__(self, folder: str, name: str, dictionary_sha256: str):
        fs, at = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{at}/{name}")
        head = self.file.read_at(13, 0)
        width, n = struct.unpack("<BI", head[8:])
        dictionary = self.file.read_at(n, 13)
        if head[:8] != MAGIC or hashlib.sha256(dictionary).hexdigest() != dictionary_sha256:
            raise ValueError(f"{name} is no token file of this dictionary")
        self.dtype = np.dtype(f"<u{width}")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if n else None)

    def ids(self, offset: int, n_bytes: int) -> np.ndarray:
        return np.frombuffer(self.unpacker.decompress(self.file.read_at(n_bytes, offset)), self.dtype)


DOCUMENTS = "doc_id long, part int, file_start long, n_tokens long, ids binary"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                own, ids = batch.slice(i, 500), []
                for file, offset, size, digest in zip(*(own.column(c).to_pylist() for c in ("file", "offset", "n_bytes", "dictionary_sha256")), strict=True):
                    if file != name:
                        name, reader = file, Reader(folder, file, digest)
                    ids.append(reader.ids(offset, size))
                counts = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("part"), own.column("file_start"), counts, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], _names(DOCUMENTS))

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (unsigned 32-bit, little-endian) of every document of an index, from the files."""
    found = index.select("doc_id", "file", "offset", "n_bytes", "dictionary_sha256", "part", "file_start").mapInArrow(_read(folder), DOCUMENTS)
    # one row a file
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("part", base.alias("base")))  # bounded by the number of files
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """read() of what write() has put into a new folder of the shared one."""
    folder = new_folder(docs.sparkSession, "tokens")
    path = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    # the file system that Spark itself takes for the folder
    whole = path.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole
    return read(write(docs, uri, tokenizer, kind, end_id), uri)
