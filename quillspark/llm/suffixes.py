"""Operator 10, suffix-array dedup: the Burrows-Wheeler transform and common prefixes of many
pieces of text, built column by column."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, new_path, table
from .exchange import VARIANT, _by, _group_of, _narrow, _wide, bucket_bits, dealt, doc_group, found_elsewhere, groups_of, mix, of_variant, told_apart, unpack_all, with_places
from .exchange import pack as pack_places

#: Bytes of a string that counts as repeated; of the anchor that places it; bytes hashed at a time.
LENGTH = 50
ANCHOR = 20
BLOCK = 1 << 20
#: Occurrences of pieces whose suffixes are ordered together, on average.
COLLECTION = 16_384
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_HEAD = struct.Struct("<IqBB")


class _Files:
    """Files of a folder that are each read and written from start to end. In a folder that is
    mounted a file stays open and is written over, as it only grows; others are streams of the
    file systems that pyarrow.fs opens (hdfs, s3, gs)."""

    def __init__(self, folder: str):
        self.system, self.path = (fs.FileSystem.from_uri(folder)) if ":" in folder else (fs.LocalFileSystem(), folder)
        self.local = isinstance(self.system, fs.LocalFileSystem)
        self.open: dict = {}
        self.system.create_dir(self.path, recursive=True)

    def write(self, name: str, data: memoryview) -> None:
        if not self.local:
            with self.system.open_output_stream(f"{self.path}/{name}") as f:
                f.write(data)
            return
        if name not in self.open:
            self.open[name] = open(f"{self.path}/{name}", "w+b", buffering=0)
        self.open[name].seek(0)
        self.open[name].write(data)

    def read(self, name: str, size: int) -> bytes:
        if not self.local:
            with self.system.open_input_stream(f"{self.path}/{name}") as f:
                return f.read(size)
        self.open[name].seek(0)
        return self.open[name].read(size)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.system.delete_dir(self.path)


class ColumnBwt:
    """BWT and LCP array of a collection of byte strings. Round j inserts one symbol of each
    string, the j-th from its end, and so all suffixes of j symbols: the files of the transform
    and of the common prefixes are read from start to end and written anew.

    A symbol is `width` bytes, 1 or 2, counted from a string's end; bytes that make no symbol are
    left out. symbols: 1 + its number; 0 ends a string. The ends of all strings sort first, in the
    order of the strings, and match nothing. Strings have at most 254 symbols: a common prefix
    takes one byte.
    """

    def __init__(self, strings: list[bytes], folder: str, width: int = 1):
        if max(map(len, strings), default=0) > 254 * width:
            raise ValueError("a string is too long")
        self.strings = strings
        self.width = width
        self.length = np.array([len(s) for s in strings], np.int64) // width  # in symbols
        #: symbols are kept as wide as they are unless a string holds byte 255, as no UTF-8 text does
        odd = any(255 in s for s in strings)
        self.kind = (np.uint16 if odd else np.uint8) if width == 1 else (np.uint32 if odd else np.uint16)
        self.round, self.size = 0, 0
        self.files = _Files(folder)
        self.store(np.zeros(len(strings), self.kind), np.zeros(len(strings), np.uint8))
        self.place = np.arange(len(strings))  # of the longest suffix so far of each string that goes on

    def store(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        """Even and odd rounds write files of two names: none is changed while it is read."""
        self.size = len(bwt)
        for name, x in (("bwt", bwt), ("lcp", lcp)):
            self.files.write(f"{name}{self.round % 2}", memoryview(x))

    def load(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.frombuffer(self.files.read(f"bwt{self.round % 2}", self.size * np.dtype(self.kind).itemsize), self.kind).copy(), np.frombuffer(self.files.read(f"lcp{self.round % 2}", self.size), np.uint8))

    def close(self) -> None:
        self.files.close()

    def build(self) -> None:
        order = np.argsort(self.length, kind="stable")
        flat = np.frombuffer(b"".join(self.strings), np.uint8)
        ends = np.cumsum([len(s) for s in self.strings])
        for j in range(1, int(self.length.max()) + 1 if len(order) else 1):
            active = order[np.searchsorted(self.length[order], j) :]
            at = ends[active] - j * self.width
            symbol = flat[at].astype(self.kind)
            if self.width == 2:
                symbol = symbol * self.kind(256) + flat[at + 1]
            self.insert(active, symbol + self.kind(1))

    def insert(self, active: np.ndarray, symbol: np.ndarray) -> None:
        """One round: symbol[i] goes before the longest suffix so far of string active[i]."""
        bwt, lcp = self.load()
        at = self.place[active]
        bwt[at] = symbol
        order = np.argsort(bwt, kind="stable")
        ended = len(bwt) - np.count_nonzero(bwt)
        # where the new suffixes stand among all that begin with a symbol
        new = np.zeros(len(bwt), bool)
        new[at] = True
        rank = np.flatnonzero(new[order])
        here = order[rank]
        by = np.argsort(at)
        owner = active[by][np.searchsorted(at[by], here)]
        # common prefixes with the suffix before, and of the suffix after with the new one
        ranges, c = _Minima(lcp), bwt[here]
        back = order[rank - 1]
        same = (rank > ended) & (bwt[back] == c)
        before = np.zeros(len(rank), np.uint8)
        before[same] = 1 + ranges.least(back[same] + 1, here[same])
        ahead = order[np.minimum(rank + 1, len(order) - 1)]
        follows = (rank + 1 < len(order)) & (bwt[ahead] == c) & ~new[ahead]
        later = 1 + ranges.least(here[follows] + 1, ahead[follows])
        place = len(self.strings) + rank - ended
        old = np.ones(len(bwt) + len(rank), bool)
        old[place] = False
        out, prefix = np.zeros(len(old), self.kind), np.empty(len(old), np.uint8)
        out[old] = bwt
        prefix[old] = lcp
        prefix[place] = before
        prefix[place[follows] + 1] = later
        self.round += 1
        self.store(out, prefix)
        self.place[owner] = place

    def suffixes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(symbols, strings, places in the order of all suffixes), from the shortest suffixes
        on, by stepping through the transform from each string's end."""
        bwt, _ = self.load()
        order = np.argsort(bwt, kind="stable")
        ended = len(bwt) - np.count_nonzero(bwt)
        step = np.zeros(len(bwt), np.int64)
        step[order[ended:]] = len(self.strings) + np.arange(len(bwt) - ended)
        strings = np.arange(len(self.strings))
        at = strings
        for j in range(1, int(self.length.max()) + 1 if len(strings) else 1):
            keep = self.length[strings] >= j
            strings, at = strings[keep], step[at[keep]]
            yield j, strings, at


class _Minima:
    """Least value of ranges of an array, from minima over runs of powers of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over a..b, both included, a <= b."""
        if not len(a):
            return np.zeros(0, np.uint8)
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for level in range(int(k.max()) + 1):
            if level == len(self.levels):
                x, half = self.levels[-1], 1 << (level - 1)
                self.levels.append(np.minimum(x[:-half], x[half:]))
            i = np.flatnonzero(k == level)
            x = self.levels[level]
            out[i] = np.minimum(x[a[i]], x[b[i] - (1 << level) + 1])
        return out


def repeats(strings: list[bytes], length: int, scratch: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(strings, offsets, class): every window of `length` bytes; windows are equal just if their
    classes are. A class is a run of suffixes whose common prefixes reach `length`. scratch: the head
    of the name of a new folder for the files.

    Where length is even a symbol is two bytes, which takes half the rounds. A string then goes in
    twice, the second time without its last byte, so that each window begins a suffix of one."""
    width = 2 - length % 2
    origin = np.arange(len(strings))
    if width == 2:
        more = [i for i, s in enumerate(strings) if len(s) > length]
        origin = np.concatenate([origin, np.array(more, np.int64)])
        strings = strings + [strings[i][:-1] for i in more]
    size = np.array([len(s) for s in strings], np.int64)
    bwt = ColumnBwt(strings, f"{scratch}-{uuid.uuid4().hex}", width)
    try:
        bwt.build()
        _, lcp = bwt.load()
        run = np.cumsum(lcp < length // width)
        for j, s, at in bwt.suffixes():
            if j * width >= length:
                yield origin[s], size[s] - j * width, run[at]
    finally:
        bwt.close()


def anchors(texts_: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(hash, text, place, first window, last window): each window of `length` bytes has as its
    anchor the substring of `anchor` bytes of least hash in it, the leftmost of equals; equal
    windows have equal anchors at equal offsets. One row for each anchor, with its windows."""
    out = []
    start = 0
    while start < len(texts_):
        stop, size = start, 0
        while stop < len(texts_) and (size < BLOCK or stop == start):
            size += len(texts_[stop])
            stop += 1
        out.append(_anchors(texts_[start:stop], start, length, anchor))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _anchors(some: list[bytes], number: int, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    raw = np.frombuffer(b"".join(some), np.uint8)
    n = len(raw) - length + 1
    if n < 1:
        return none
    h, done, parts = _BYTES[raw], 1, {}
    while True:  # hashes of runs of 1, 2, 4, ... bytes, of which those of `anchor` are made
        parts[done] = h
        if 2 * done > anchor:
            break
        h = h[:-done] * np.uint64(pow(int(_BASE), done, 1 << 64)) + h[done:]
        done *= 2
    h, width, rest = parts[done], done, anchor - done
    for k in sorted(parts, reverse=True):
        if rest >= k:
            scale = np.uint64(pow(int(_BASE), k, 1 << 64))
            h = h[: len(raw) - width - k + 1] * scale + parts[k][width : width + len(raw) - width - k + 1]
            width, rest = width + k, rest - k
    h = mix(h)
    if len(h) >> 32:
        raise ValueError("texts of a block exceed 4 GB")
    # as many bits of the hash decide in every block, whatever its length, so that equal windows choose alike
    bits = np.uint64(32)
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, m, run = length - anchor + 1, key, 1
    while 2 * run <= span:
        m = np.minimum(m[:-run], m[run:])
        run *= 2
    if run < span:
        m = np.minimum(m[: len(h) - span + 1], m[span - run : len(h) - run + 1])
    place = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.array([len(t) for t in some], np.int64)
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(some)), size)
    inside = doc[:n] == doc[length - 1 :]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (doc[1:n] != doc[: n - 1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    if not len(first):
        return none
    edge = np.flatnonzero(np.append(change | ~inside, True))
    last = edge[np.searchsorted(edge, first, "right")] - 1
    d = doc[first]
    return mix(h[place[first]]), d + number, place[first] - begin[d], first - begin[d], last - begin[d]


def _put(doc: np.ndarray, start: np.ndarray, part: np.ndarray, pieces: list[bytes]) -> bytes:
    wd, docs = _narrow(np.diff(doc).astype(np.uint64))
    ws, starts = _narrow(start)
    return _HEAD.pack(len(doc), int(doc[0]), wd, ws) + docs + starts + part.astype("u1").tobytes() + np.array([len(p) for p in pieces], "<u2").tobytes() + b"".join(pieces)


def _take(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    n, first, wd, ws = _HEAD.unpack_from(data)
    at, doc = _HEAD.size, np.full(n, first, np.int64)
    doc[1:] += np.cumsum(_wide(data, at, n - 1, wd).astype(np.int64))
    at += (n - 1) * wd
    start = _wide(data, at, n, ws).astype(np.int64)
    at += n * ws
    part = np.frombuffer(data, "u1", n, at)
    size = np.frombuffer(data, "<u2", n, at + n)
    ends = at + 3 * n + np.cumsum(size, dtype=np.int64)
    return doc, start, part, [data[e - s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)]


def repeated_bytes(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """A written table (grp, payload) of (doc_id, code) for told_apart() rows: code is start * 2**16 +
    count, for count windows from start on that also start in a document with a smaller doc_id. As
    in a place, the variant of the text stands above start; there may be 65,536 texts of a doc_id.

    Anchors that several documents have are found first; only the windows around these can
    repeat. Such windows of a document form pieces of at most 2 * length - anchor bytes. Within a
    group of documents, a piece is sent on only for the smallest of the documents that hold it
    (the others' windows are found at once); pieces go by the hash of their anchor to a task that
    builds the suffix order of its different pieces and reads the classes of equal windows off it.
    """
    groups = groups_of(rows.sparkSession)
    bits = bucket_bits(rows.sparkSession)
    scratch = new_path(rows.sparkSession, "columns")

    def places(t: list[bytes]):
        h, number, place, _, _ = anchors(t, length, anchor)
        return h, number, place

    shared = found_elsewhere(rows, places, both=True, name="anchors")

    def hits(doc: np.ndarray, code: np.ndarray) -> list[tuple[int, bytes]]:
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        return [(g, pack_places(doc[p], code[p])) for g, p in _by(_group_of(doc, groups))]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        at = unpack_all(right.column("payload").to_pylist())
        rows: list[tuple[int, int, bytes]] = []
        mine = [(d, t, v) for d, v, t in zip(*(left.column(k).to_pylist() for k in ("doc_id", "variant", "text")), strict=True) if d in at]
        mine.sort(key=lambda x: (x[0], x[2]))
        if any(v >> 16 for *_, v in mine):
            raise ValueError("a doc_id has more than 65,536 different texts")
        if len(mine) >> 23:
            raise ValueError("a group holds 2**23 documents: set more shuffle partitions")
        if mine:
            h, number, place, first, last = anchors([t for _, t, _ in mine], length, anchor)
            known = np.concatenate([(i << 40) | np.unique(of_variant(at[d], v)) for i, (d, _, v) in enumerate(mine)])
            here = (number << 40) | place
            keep = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here if len(known) else np.zeros(len(here), bool)
            h, number, first, last = h[keep], number[keep], first[keep], last[keep]
            doc, variant = (np.array([x[k] for x in mine], np.int64)[number] for k in (0, 2))
            pieces = [mine[k][1][a : b + length] for k, a, b in zip(number.tolist(), first.tolist(), last.tolist(), strict=True)]
            least: dict[bytes, int] = {}
            for p, d in zip(pieces, doc.tolist(), strict=True):
                least.setdefault(p, d)  # doc ascends
            late = np.array([least[p] for p in pieces], np.int64) < doc if len(doc) else np.zeros(0, bool)
            count, first = last - first + 1, first | variant << VARIANT
            code = (first << 16) | count
            if late.any():
                rows += [(g % (1 << bits), g, p) for g, p in hits(doc[late], code[late])]
            rest = np.flatnonzero(~late)
            for b, p in _by((h[rest] >> np.uint64(64 - bits)).astype(np.int64)) if len(rest) else ():
                i = rest[p]
                rows.append((b, -1, _put(doc[i], first[i], (h[i] >> np.uint64(8)) & np.uint64(255), [pieces[x] for x in i.tolist()])))
        b, g, p = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(b, pa.int32()), "grp": pa.array(g, pa.int32()), "payload": pa.array(p, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        g, p = t.column("grp").to_pylist(), t.column("payload").to_pylist()
        out = [(x, y) for x, y in zip(g, p, strict=True) if x >= 0]
        taken = [_take(y) for x, y in zip(g, p, strict=True) if x < 0]
        if taken:
            doc, start, part = (np.concatenate([x[k] for x in taken]) for k in range(3))
            pieces = [q for x in taken for q in x[3]]
            parts, found = min(256, len(pieces) // COLLECTION + 1), []
            for _, i in _by(part % parts if parts < 256 else part):
                number: dict[bytes, int] = {}
                which = np.array([number.setdefault(pieces[k], len(number)) for k in i.tolist()], np.int64)
                found.append(_later(list(number), doc[i], start[i], which))
            late, code = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(late):
                out += hits(late, code)
        give_back()
        g, p = zip(*out, strict=True) if out else ((), ())
        return pa.table({"grp": pa.array(g, pa.int32()), "payload": pa.array(p, pa.binary())})

    def _later(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, code) of the windows of occurrences (doc, start) of pieces that a smaller
        document has: of each window, the smallest document of its class decides."""
        first = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(first, which, doc)
        size = np.array([len(q) for q in pieces], np.int64) - length + 1
        begin = np.cumsum(size) - size
        group = np.empty(int(size.sum()), np.int64)
        for s, o, c in repeats(pieces, length, scratch):
            group[begin[s] + o] = c
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, np.repeat(first, size))
        least = least[group]
        every = doc > np.maximum.reduceat(least, begin)[which]
        some = np.flatnonzero(~every & (doc > np.minimum.reduceat(least, begin)[which]))
        n = size[which[some]]
        row = np.repeat(some, n)
        window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        late = least[begin[which[row]] + window] < doc[row]
        row, window = row[late], window[late]
        new = np.append(True, (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1))[: len(row)]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(row)))
        codes = (start[every] << 16) | size[which[every]], ((start[row[at]] + window[at]) << 16) | count
        return np.concatenate([doc[every], doc[row[at]]]), np.concatenate(codes)

    left = dealt(rows.withColumn("grp", doc_group(groups)), "grp").groupBy("part", "grp")
    sent = left.cogroup(dealt(shared, "grp").groupBy("part", "grp")).applyInArrow(cut, "bucket int, grp int, payload binary")
    return table(dealt(sent, "bucket").groupBy("part", "bucket").applyInArrow(meet, "grp int, payload binary"), "repeats")


def removals(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the maximal
    removed runs of bytes, and, with_text, kept: the bytes left.

    Null texts are empty; a text of fewer than length bytes loses nothing; very long texts are
    taken whole; an empty table gives an empty result. Documents without doc_id neither lose
    bytes nor count as an earlier document. Rows that repeat a doc_id: equal ones get equal results,
    and of different texts neither is the earlier, and each loses what a smaller doc_id has of it.
    Other columns are not read.
    """

    def one(doc_id, text, codes):
        a = codes >> 16
        b = a + (codes & 0xFFFF) - 1 + length
        if len(a):
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.append(True, a[1:] > b[:-1])
            a, b = a[new], b[np.append(new[1:], True)]
            kept = b"".join(text[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
        else:
            kept = text
        return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(a), "kept_sha256": hashlib.sha256(kept).hexdigest(), "starts": a, "ends": b, "kept": kept}

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>" + ", kept binary" * with_text
    rows = told_apart(docs)
    return with_places(rows, repeated_bytes(rows, length, anchor), one, schema, VARIANT + 16)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, unnest(list_transform(range(0, length(x) // 2 - 49), lambda i: {'i': i, 's': substr(x, 2 * i + 1, 100)}), recursive := true) from d where length(x) >= 100),
f as (select s, min(doc_id) as first from w group by s having count(*) > 1),
h as (select doc_id, i from w join f using (s) where doc_id > first),
r as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as run from (select *, lag(i) over (partition by doc_id order by i) as before from h)),
v as (select doc_id, run, min(i) as a, max(i) + 50 as b from r group by doc_id, run),
k as (select v.doc_id, a, substr(x, 2 * coalesce(lag(b) over (partition by v.doc_id order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by v.doc_id order by a), 0))) as part from v join d using (doc_id)
  union all select doc_id, 9223372036854775807, substr(x, 2 * z + 1) from d join (select doc_id, max(b) as z from v group by doc_id) using (doc_id)),
c as (select doc_id, string_agg(part, '' order by a) as kept from k group by doc_id),
t as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from v group by doc_id)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256
from d left join c using (doc_id) left join t using (doc_id)"""
