"""Token ids as length-delimited binary records.

A shard is a run of frames: length (u64), masked checksum of the length (u32), payload, masked checksum of the
payload (u32), little-endian. A payload is doc_id (i64), flags (u8: bit 0 a null id, bit 1 ids of two bytes), then
the ids. Beside each shard an index file holds (frame offset, ids before it in the shard, ids in it) as three u64
per record, so that readers can fetch records in any order. A masked checksum is the CRC-32 rotated right by 15
bits plus a constant, so that stored checksums don't look like data they cover.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

SHARDS = "part int, path string, n_records long, n_tokens long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
ROWS_AT_ONCE = 2048
#: Text that one shard holds at most on average, in bytes.
SHARD_BYTES = 1 << 29


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises on any damage."""
    (n,), (check,) = struct.unpack_from("<Q", data), struct.unpack_from("<I", data, 8)
    if masked(data[:8]) != check or len(data) != n + 16:
        raise ValueError("damaged record length")
    payload = data[12 : 12 + n]
    if masked(payload) != struct.unpack_from("<I", data, 12 + n)[0]:
        raise ValueError("damaged record")
    return payload


def encode_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return struct.pack("<qB", doc_id or 0, (doc_id is None) | narrow << 1) + ids.astype("<u2" if narrow else "<u4").tobytes()


def decode_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=9).astype("<u4")


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append ``end_id`` and write shards in ascending doc_id order (null ids first, equal ids by a
    hash of the text). Returns the list of shards with the ids before each: one row per shard, the only thing that
    reaches the driver. The number of shards follows from the bytes of text, and is the session's number of shuffle
    partitions at least; equal ids, and equal rows, are spread over shards by a drawn number. A task writes under a name of its own, and
    only names reported by tasks that ended count, so a task that is lost or run twice leaves no trace in the result.
    Null text is an empty document; an empty table gives no shard; other columns are ignored."""
    spark = docs.sparkSession
    chosen = common.pick(docs, doc_id=id_col, text=text_col)
    n_bytes = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // shard_bytes))
    order = ["doc_id", "th", "draw"]
    ordered = chosen.withColumns({"th": F.xxhash64("text"), "draw": F.rand(1)}).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(folder)
        fs.create_dir(root, recursive=True)
        part, path, n, total, at = TaskContext.get().partitionId(), "", 0, 0, 0
        data = index = None
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            if data is None:
                path = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}"
                data, index = fs.open_output_stream(path + ".rec"), fs.open_output_stream(path + ".idx")
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(common.as_bytes(batch.column(1)))):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                out = frame(encode_payload(doc_id, ids))
                index.write(struct.pack("<QQQ", at, total, len(ids)))
                data.write(out)
                at, n, total = at + len(out), n + 1, total + len(ids)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "n_records", "n_tokens"])

    shards, before, rows = sorted(ordered.mapInArrow(run, SHARDS).collect()), 0, []
    for s in shards:
        rows.append((s.path, before, s.n_records))
        before += s.n_tokens
    return spark.createDataFrame(rows, "path string, before long, n_records long")


def read_back(shards: DataFrame, folder: str) -> DataFrame:
    """Read every record of the shards through their index, checking both checksums."""
    n = max(1, shards.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.open_fs(folder)
        for path, before, n_records in (row.values() for b in batches for row in b.to_pylist()):
            with fs.open_input_file(path + ".idx") as index, fs.open_input_file(path + ".rec") as data:
                end = data.size()
                for first in range(0, n_records, ROWS_AT_ONCE):
                    index.seek(24 * first)
                    entries = np.frombuffer(index.read(24 * (ROWS_AT_ONCE + 1)), "<u8").reshape(-1, 3)
                    last = len(entries) <= ROWS_AT_ONCE
                    stops = [*entries[1:, 0].tolist(), *([end] if last else [])]
                    out: list[list] = [[], [], [], []]
                    for (at, so_far, count), stop in zip(entries.tolist(), stops):
                        data.seek(at)
                        doc_id, ids = decode_payload(unframe(data.read(stop - at)))
                        if len(ids) != count:
                            raise ValueError("index and record differ")
                        for column, value in zip(out, (doc_id, before + so_far, count, zlib.crc32(ids.tobytes()))):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "before", "n_records").repartition(n, F.col("path")).mapInArrow(run, SCHEMA)


def write_and_read(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as records and describe each document from the files.

    Null text is an empty document (its end id only); a null doc_id comes back null; repeated rows are records of
    their own; an empty table gives no shard and an empty result; other columns are ignored."""
    folder = folder or f"{common.shared_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    return read_back(write(docs, tokenizer, folder, end_id, id_col, text_col), folder)
