"""Operator 4, token-id output: files of patched frame-of-reference blocks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ship, table
from .tokens import default_path, encoder

MAGIC = b"QPFOR1\0\0"
BLOCK = 128
PERCENTILE = 90
#: Ids gathered before their blocks are written.
FLUSH = 1 << 20
_FOOTER = struct.Struct("<QQQQI8s")  # places of block index and document table, ids, documents, block size, magic


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """Encode uint32 ids as blocks of `block` ids (the last may be shorter; it is padded with its
    last id). A block holds: its minimum (u4), its width w (u1), the number of exceptions (u2),
    block ids less the minimum in w bits each (low bits only), and its exceptions: places (u2 each)
    and the bits above w (u4 each). w is the width of the percentile of the block's differences."""
    n = -(-len(ids) // block)
    if not n:
        return []
    rows = np.concatenate([ids, np.repeat(ids[-1:], n * block - len(ids))]).astype(np.uint32).reshape(n, block)
    low = rows.min(1)
    rest = rows - low[:, None]
    k = min(block - 1, int(block * percentile / 100))
    typical = np.partition(rest, k, axis=1)[:, k]
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    above = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        bits = (rest[at][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1) if w else np.zeros((len(at), block, 0), np.uint32)
        packed = np.packbits(bits.reshape(len(at), -1).astype(np.uint8), axis=1, bitorder="little") if w else np.zeros((len(at), 0), np.uint8)
        for i, b in zip(at.tolist(), packed, strict=True):
            out[i] = b.tobytes()
    row, place = np.nonzero(above)
    ends = np.searchsorted(row, np.arange(n + 1))
    place, high, head = place.astype("<u2"), above[row, place].astype("<u4") if len(row) else np.zeros(0, "<u4"), low.tolist()
    for i in range(n):
        a, b = ends[i], ends[i + 1]
        out[i] = struct.pack("<IBH", head[i], width[i], b - a) + out[i] + place[a:b].tobytes() + high[a:b].tobytes()
    return out


def unpack_blocks(data: bytes, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of whole blocks that begin at starts within data."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((len(starts), block), np.uint32)
    if not len(starts):
        return out.reshape(-1)
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width = raw[starts + 4].astype(np.int64)
    count = raw[starts[:, None] + 5 + np.arange(2)].copy().view("<u2")[:, 0].astype(np.int64)
    size = (block * width + 7) // 8
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        packed = np.zeros((len(at), (block * w + 7) // 8 + 5), np.uint8)
        packed[:, :-5] = raw[starts[at][:, None] + 7 + np.arange(packed.shape[1] - 5)]
        bit = np.arange(block) * w
        first, shift = bit >> 3, (bit & 7).astype(np.uint64)
        value = np.zeros((len(at), block), np.uint64)
        for i in range((w + 14) // 8):  # the bytes that a number may touch
            value |= packed[:, first + i].astype(np.uint64) << np.uint64(8 * i)
        out[at] = ((value >> shift) & np.uint64((1 << int(w)) - 1)).astype(np.uint32)
    row = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    at = (starts + 7 + size)[row] + 2 * nth
    place = raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8
    at += 2 * (count[row] - nth) + 4 * nth
    high = sum(raw[at + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4)) if len(row) else np.zeros(0, np.uint32)
    out[row, place] |= high << width[row].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)


class Writer:
    """Blocks, then their starts (u8 each), then doc_ids (i8), whether each is known (u1) and its
    first id's place in the file (u8), then the footer."""

    def __init__(self, f, block: int = BLOCK, percentile: float = PERCENTILE):
        self.f, self.block, self.percentile = f, block, percentile
        self.starts: list[int] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.held: list[bytes] = []
        self.held_ids = self.ids = self.at = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian uint32."""
        self.docs.append((doc_id or 0, doc_id is not None, self.ids))
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        self.ids += len(ids) // 4
        if self.held_ids >= FLUSH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        n = len(ids) if last else len(ids) // self.block * self.block
        for b in pack_blocks(ids[:n], self.block, self.percentile):
            self.starts.append(self.at)
            self.f.write(b)
            self.at += len(b)
        self.held, self.held_ids = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        self._flush(True)
        places = self.at, self.at + 8 * len(self.starts)
        d = list(zip(*self.docs, strict=True)) or [(), (), ()]
        self.f.write(np.array(self.starts, "<u8").tobytes() + np.array(d[0], "<i8").tobytes() + np.array(d[1], "u1").tobytes() + np.array(d[2], "<u8").tobytes())
        self.f.write(_FOOTER.pack(*places, self.ids, len(self.docs), self.block, MAGIC))


class Reader:
    """Random access to one file: doc_ids, starts, and ids(a, b), which reads only their blocks."""

    def __init__(self, f, size: int):
        self.f = f
        index, docs, self.n_ids, n, self.block, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.starts = np.append(np.frombuffer(self._read(index, docs), "<u8"), np.uint64(index)).astype(np.int64)
        table = self._read(docs, size - _FOOTER.size)
        ids, known = np.frombuffer(table, "<i8", n), np.frombuffer(table, "u1", n, 8 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.doc_starts = np.append(np.frombuffer(table, "<u8", n, 9 * n), np.uint64(self.n_ids)).astype(np.int64)

    def _read(self, a: int, b: int) -> bytes:
        self.f.seek(a)
        return self.f.read(b - a)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        at = self.starts[i : j + 1]
        return unpack_blocks(self._read(at[0], at[-1]), at[:-1] - at[0], self.block)[a - i * self.block : b - i * self.block]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Encode every text (null: empty), append end_id, and write the ids in ascending doc_id
    order, one file per range of doc_ids, in folder (of a kind that pyarrow.fs opens: file, hdfs,
    s3, gs). Returns a manifest: part, path, n_docs, n_ids, start (ids in the files before it).

    Rows of equal doc_id stand in the order of their texts' hashes, null doc_ids first. A task
    that is run again writes a file of another name; the manifest, which is a written table,
    names only the files of the tasks that count. Only the manifest, a row per file, reaches the
    driver."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, stream = TaskContext.get().partitionId(), None, None
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.qpfor"
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                if writer is None and some.num_rows:
                    fs, name = _open(folder)
                    fs.create_dir(name, recursive=True)
                    stream = fs.open_output_stream(_open(path)[1])
                    writer = Writer(stream, block, percentile)
                end = struct.pack("<I", end_id)
                for d, ids in zip(some.column("doc_id").to_pylist(), encoder(tokenizer).encode(some.column("text").to_pylist()), strict=True):
                    writer.add(d, ids + end)
        if writer:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(writer.docs), "n_ids": writer.ids}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    written = table(ordered.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "manifest")
    start, out = 0, []
    for r in sorted(written.collect(), key=lambda r: r.part):
        out.append((r.part, r.path, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(out, "part int, path string, n_docs long, n_ids long, start long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: doc_id, start, n_tokens, ids_crc32 per document."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, name = _open(r["path"])
                with fs.open_input_file(name) as f:
                    reader = Reader(f, f.size())
                    at, ends = 0, reader.doc_starts
                    while at < len(reader.doc_ids):
                        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + FLUSH, "right")) - 1)
                        ids = reader.ids(ends[at], ends[stop]).astype("<u4")
                        crc = [zlib.crc32(ids[ends[i] - ends[at] : ends[i + 1] - ends[at]].tobytes()) for i in range(at, stop)]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[at:stop], pa.int64()), pa.array(ends[at:stop] + r["start"]), pa.array(np.diff(ends[at : stop + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = stop

    n = max(1, manifest.count())
    parts = manifest.select("part", "path", "start").repartitionByRange(n, "part") if n > 1 else manifest.select("part", "path", "start")
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the token ids of docs and read them back: one row per row of docs. Null and empty
    texts have just the end id; very long texts pass through in the same way; an empty table
    gives an empty result; other columns are not read."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer or default_path("byte_bpe_50k.json"), end_id))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
