"""Token sequences in length-delimited binary files with checksums and a separate offset index.

A data file is a header (magic, width of an id in bytes) and then one frame per sequence:

    length of the payload   unsigned 64 bits
    checksum of the length  unsigned 32 bits, masked
    payload                 1 byte (1: no document id), document id as signed 64 bits, the ids
    checksum of the payload unsigned 32 bits, masked

Checksums are CRC-32 and masked by rotation and a constant, so that a file of frames inside a
payload does not carry its own checksums. The index file beside it has, per sequence, the offset
of its frame, the ids before it in the file and its number of ids, so that a reader can visit
sequences in any order. Numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import text_batches
from tracewright.llm.tokens import encoder
from tracewright.plans.storage import store

MAGIC = b"TOKSEQ01"
INDEX_MAGIC = b"TOKIDX01"
MASK = 0xA282EAD8
MAX_FILE_BYTES = 64 << 20
INDEX_ROW = np.dtype([("offset", "<u8"), ("start", "<u8"), ("n_tokens", "<u8")])
_LENGTH, _SUM, _ID = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
_MANIFEST = "part int, file int, path string, n_records long, n_tokens long, n_bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


def unframe(data: memoryview, at: int) -> memoryview:
    """The payload of the frame at an offset; ValueError if a checksum is wrong."""
    length = bytes(data[at:at + 8])
    if len(length) < 8 or _SUM.unpack(data[at + 8:at + 12])[0] != masked(length):
        raise ValueError(f"damaged length at {at}")
    begin = at + 12
    end = begin + _LENGTH.unpack(length)[0]
    payload = data[begin:end]
    if len(data) < end + 4 or _SUM.unpack(data[end:end + 4])[0] != masked(payload):
        raise ValueError(f"damaged payload at {at}")
    return payload


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class _File:
    """One data file and its index, complete when closed."""

    def __init__(self, stem: str, width: int):
        fs, local = _filesystem(stem)
        self.stem = stem
        self._data, self._index = fs.open_output_stream(local + ".bin"), fs.open_output_stream(local + ".idx")
        self._data.write(MAGIC + bytes([width]))
        self._rows: list[tuple[int, int, int]] = []
        self.n_bytes, self.n_tokens, self._width = len(MAGIC) + 1, 0, width

    def add(self, doc_id: int | None, ids: bytes) -> None:
        data = frame(_ID.pack(doc_id is None, doc_id or 0) + ids)
        count = len(ids) // self._width
        self._rows.append((self.n_bytes, self.n_tokens, count))
        self._data.write(data)
        self.n_bytes += len(data)
        self.n_tokens += count

    def close(self) -> tuple[str, int, int, int]:
        rows = np.array(self._rows, INDEX_ROW).tobytes()
        self._index.write(INDEX_MAGIC + rows + _SUM.pack(masked(rows)))
        self._index.close()
        self._data.close()
        return self.stem, len(self._rows), self.n_tokens, self.n_bytes


def write_records(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, max_file_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """Write the ids of every text, with `end_id` behind them, in ascending order of `doc_id`.

    Returns the manifest: a row per file with its number in the order of documents. Only files in
    the manifest count; a lost or repeated attempt leaves files that nobody reads. A document
    without id comes first, one without text or with an empty one has the end id alone, repeated
    rows are written once each, and ties of `doc_id` go by text. Other columns are ignored. A table
    without rows gives a manifest without rows.
    """
    fs, local = _filesystem(path)
    fs.create_dir(local, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        part = TaskContext.get().partitionId()
        attempt = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
        out, done = None, []
        for batch, texts in text_batches(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                if out and out.n_bytes >= max_file_bytes:
                    done.append(out.close())
                    out = None
                out = out or _File(f"{attempt}-{len(done)}", encode.dtype.itemsize)
                out.add(doc_id, ids + end)
        if out:
            done.append(out.close())
        if done:
            names, records, tokens, size = (list(x) for x in zip(*done, strict=True))
            yield pa.record_batch(
                [pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), pa.array(names),
                 pa.array(records, pa.int64()), pa.array(tokens, pa.int64()), pa.array(size, pa.int64())],
                ["part", "file", "path", "n_records", "n_tokens", "n_bytes"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the hash splits a hot id; the text itself is only compared within a task
    sorted_rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return store(sorted_rows.mapInArrow(write, _MANIFEST), "records-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens, ids (unsigned 32-bit, binary).

    Every checksum is verified; a damaged file raises ValueError. `start` goes by the order of the
    manifest, of which the sums over files are small; it is counted on from the start of the file.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    count = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _read_file(stem, start)

    return files.repartition(count, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_index(stem: str) -> np.ndarray:
    """The index of one file: offset, start and n_tokens per sequence."""
    fs, local = _filesystem(stem)
    with fs.open_input_file(local + ".idx") as file:
        data = file.read()
    rows = data[len(INDEX_MAGIC):-4]
    if data[:len(INDEX_MAGIC)] != INDEX_MAGIC or _SUM.unpack(data[-4:])[0] != masked(rows):
        raise ValueError(f"damaged index {stem}")
    return np.frombuffer(rows, INDEX_ROW)


def _read_file(stem: str, start: int, rows_at_once: int = 512) -> Iterator[pa.RecordBatch]:
    index = read_index(stem)
    fs, local = _filesystem(stem)
    with fs.open_input_file(local + ".bin") as file:
        head = file.read(len(MAGIC) + 1)
        if head[:-1] != MAGIC:
            raise ValueError(f"damaged file {stem}")
        dtype, size = np.dtype(f"<u{head[-1]}"), file.size()
        for at in range(0, len(index), rows_at_once):
            rows = index[at:at + rows_at_once]
            first = int(rows["offset"][0])
            last = int(index["offset"][at + rows_at_once]) if at + rows_at_once < len(index) else size
            file.seek(first)
            data = memoryview(file.read(last - first))
            docs, ids = [], []
            for offset in rows["offset"]:
                payload = unframe(data, int(offset) - first)
                missing, doc_id = _ID.unpack(payload[:_ID.size])
                docs.append(None if missing else doc_id)
                ids.append(np.frombuffer(payload[_ID.size:], dtype).astype("<u4").tobytes())
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(rows["start"].astype(np.int64) + start),
                 pa.array(rows["n_tokens"].astype(np.int64)), pa.array(ids, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])
