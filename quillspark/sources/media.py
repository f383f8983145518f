"""Audio tracks by the headers of media files: RIFF (WAV) and ISO base media (MP4, M4A, MOV).

Only headers are read, by offset, however long a file is: the heads of its boxes or chunks, and of
those that describe a track some bytes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ship

Read = Callable[[int, int], bytes]
TRACKS = "media string, duration_seconds double, streams array<struct<index: int, kind: string, codec: string, channels: int, sample_rate: int>>, error string"
#: Boxes or chunks that are looked at in a file, and bytes of one that are read.
MOST_BOXES, MOST_BYTES = 10_000, 512
#: Names of codecs by the code that a container gives them. Fixed values.
BOX_CODECS = {"mp4a": "aac", "alac": "alac", "Opus": "opus", "ac-3": "ac3", "ec-3": "eac3", "fLaC": "flac", ".mp3": "mp3", "samr": "amr_nb", "sawb": "amr_wb", "sowt": "pcm_s16le", "twos": "pcm_s16be", "lpcm": "pcm_s16le"}
WAVE_CODECS = {(1, 8): "pcm_u8", (1, 16): "pcm_s16le", (1, 24): "pcm_s24le", (1, 32): "pcm_s32le", (3, 32): "pcm_f32le", (3, 64): "pcm_f64le", (6, 8): "pcm_alaw", (7, 8): "pcm_mulaw"}


class Malformed(ValueError):
    pass


def _exactly(read: Read, at: int, n: int) -> bytes:
    got = read(at, n)
    if len(got) < n:
        raise Malformed("it ends within a header")
    return got


def wave(read: Read, size: int) -> tuple[float | None, list[dict]]:
    at, found, data, rate = 12, None, None, 0
    for _ in range(MOST_BOXES):
        if at + 8 > size:
            break
        kind, n = struct.unpack("<4sI", _exactly(read, at, 8))
        if kind == b"fmt ":
            head = _exactly(read, at + 8, min(n, 40))
            if len(head) < 16:
                raise Malformed("its format is too short")
            tag, channels, hertz, rate, _, bits = struct.unpack_from("<HHIIHH", head)
            if tag == 0xFFFE and len(head) >= 26:
                tag = struct.unpack_from("<H", head, 24)[0]
            found = {"index": 0, "kind": "audio", "codec": WAVE_CODECS.get((tag, bits), f"wave_{tag}"), "channels": channels, "sample_rate": hertz}
        elif kind == b"data":
            data = min(n, size - at - 8)  # a writer that was cut off leaves too large a number
        if found and data is not None:
            break
        at += 8 + n + n % 2
    else:
        raise Malformed("it has too many chunks")
    return (data / rate if data is not None and rate else None), [found] if found else []


def _boxes(read: Read, at: int, end: int, left: list[int]) -> Iterator[tuple[str, int, int]]:
    """(kind, where its content begins, where it ends) of the boxes from at to end."""
    while at + 8 <= end:
        left[0] -= 1
        if left[0] < 0:
            raise Malformed("it has too many boxes")
        n, kind = struct.unpack(">I4s", _exactly(read, at, 8))
        head = 8
        if n == 1:
            n, head = struct.unpack(">Q", _exactly(read, at + 8, 8))[0], 16
        n = n or end - at  # 0: to the end
        if n < head:
            raise Malformed("a box is shorter than its head")
        yield kind.decode("latin-1"), at + head, min(at + n, end)
        at += n


def _clock(read: Read, a: int, b: int) -> float | None:
    """The seconds that a header box with a time scale tells."""
    head = read(a, min(b - a, 32))
    form, where = (">IQ", 20) if head[:1] == b"\1" else (">II", 12)
    if len(head) < where + struct.calcsize(form):
        raise Malformed("a time is cut off")
    scale, n = struct.unpack_from(form, head, where)
    unknown = n == (1 << (8 * struct.calcsize(form[2:]))) - 1
    return n / scale if scale and not unknown else None


def boxed(read: Read, size: int) -> tuple[float | None, list[dict]]:
    seconds, streams, left = None, [], [MOST_BOXES]
    inside = {"trak", "mdia", "minf", "stbl"}

    def walk(a: int, b: int, track: dict | None) -> None:
        nonlocal seconds
        for kind, x, y in _boxes(read, a, b, left):
            if kind == "mvhd":
                seconds = _clock(read, x, y)
            elif kind == "trak":
                mine = {"index": len(streams), "kind": None, "codec": None, "channels": None, "sample_rate": None}
                streams.append(mine)
                walk(x, y, mine)
            elif kind in inside:
                walk(x, y, track)
            elif kind == "hdlr" and track is not None:
                handler = read(x + 8, 4).decode("latin-1")
                track["kind"] = {"soun": "audio", "vide": "video"}.get(handler, handler)
            elif kind == "stsd" and track is not None:
                entry = read(x + 8, min(y - x - 8, MOST_BYTES))
                if len(entry) >= 8:
                    code = entry[4:8].decode("latin-1")
                    track["codec"] = BOX_CODECS.get(code, code.strip())
                if len(entry) >= 36:
                    track["channels"], track["sample_rate"] = struct.unpack_from(">H", entry, 24)[0], struct.unpack_from(">I", entry, 32)[0] >> 16

    for kind, x, y in _boxes(read, 0, size, left):
        if kind == "moov":
            walk(x, y, None)
    for s in streams:
        if s["kind"] != "audio":
            s["channels"] = s["sample_rate"] = None
    return seconds, streams


def described(read: Read, size: int) -> tuple[float | None, list[dict], str | None]:
    """Seconds, streams and error of a file of which read(offset, n) gives n bytes. What cannot be
    read has an error and no streams."""
    try:
        head = read(0, 12)
        if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
            return *wave(read, size), None
        if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
            return *boxed(read, size), None
        return None, [], "neither RIFF nor ISO base media"
    except (Malformed, struct.error, RecursionError) as e:
        return None, [], str(e) or "malformed"


_KIND = pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("codec", pa.string()), ("channels", pa.int32()), ("sample_rate", pa.int32())]))


def _batch(media: list, found: list[tuple]) -> pa.RecordBatch:
    seconds, streams, error = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(media, pa.string()), pa.array(seconds, pa.float64()), pa.array(streams, _KIND), pa.array(error, pa.string())], ["media", "duration_seconds", "streams", "error"])


def from_bytes(media: DataFrame) -> DataFrame:
    """TRACKS of media (media, content)."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for value in b.column(1):
                view = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
                found.append(described(lambda at, n, v=view: bytes(v[at : at + n]), len(view)))
            yield _batch(b.column(0).to_pylist(), found)

    return media.select(F.col("media").cast("string"), "content").mapInArrow(run, TRACKS)


def probe(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """TRACKS of the files at path. The driver lists them; tasks open them and read their headers
    by offset, so no file is read as a whole."""
    ship(spark)
    listed = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                scheme, _, rest = name.partition(":")
                system, at = (pafs.LocalFileSystem(), rest) if scheme == "file" else pafs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    found.append(described(lambda o, n, f=f, size=size: f.read_at(max(0, min(n, size - o)), o) if o < size else b"", size))
            yield _batch(b.column(0).to_pylist(), found)

    return (listed.repartition(tasks) if tasks else listed).mapInArrow(run, TRACKS)


def audio_streams(tracks: DataFrame) -> DataFrame:
    """media, duration_seconds, and each audio stream with its number among these."""
    audio = F.filter("streams", lambda s: s["kind"] == "audio")
    rows = tracks.select("media", "duration_seconds", F.posexplode(audio).alias("audio_index", "s"))
    return rows.select("media", "duration_seconds", "audio_index", F.col("s.index").alias("stream_index"), F.col("s.codec").alias("codec"), F.col("s.channels").alias("channels"), F.col("s.sample_rate").alias("sample_rate"))
