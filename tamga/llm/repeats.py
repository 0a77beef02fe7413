"""Removal of long repeated byte strings by column-wise construction of suffix order and common prefixes.

A byte goes if it is covered by a WIDTH-byte string that also starts anywhere else. The plain column-wise
construction inserts one symbol per document each round and so needs as many rounds as the longest document has
bytes, each of them rewriting the whole transform. Here the documents of the construction are short pieces that
are aligned beforehand: every WIDTH-byte window has an anchor, its ANCHOR-byte string of least hash (the first of
equals), which depends on the window alone; windows with one anchor in a row make up a piece, and windows can be
equal only if their anchors are. The pieces of an anchor, cut at the anchor, form a collection: from the last
column to the first, each round inserts one symbol of every piece, sorts the new suffixes by it (stable, so the order so far decides
the rest) and updates the common prefix of each with its predecessor. A window repeats when this reaches WIDTH.
The number of rounds is 2 * WIDTH - ANCHOR for any corpus.

Blocks of documents first announce anchors and a hash of the whole piece. Pieces that occur once with an anchor that occurs once end there;
pieces that occur as wholes elsewhere are repeats from end to end; only different pieces of one anchor are sent and constructed, each text once. The columns of
the collections of a bucket are built in parts of PART_BYTES at most, groups together as far as they fit.

Null texts are empty; nothing crosses documents; a string may repeat within one document, also overlapping itself.
Texts are whole, also very long ones; repeated rows repeat each other's strings, and each is cut. An empty table gives
an empty one. Ids may be null or repeated and of any type; other columns, of any name, are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamga.llm.blocks import BLOB, BUCKETS, blob_rows, cut, pack_arrays, release, shares, to_blocks, unpack, unpack_arrays

WIDTH = 400
ANCHOR = 32
CHUNK_BYTES = 1 << 20
PART_BYTES = 48 << 20
#: Columns of a piece relative to its anchor: windows start in the first _STARTS of them.
_STARTS = WIDTH - ANCHOR + 1
_COLUMNS = _STARTS + WIDTH - 1
#: What a bucket answers: the piece is alone; it occurs as a whole elsewhere; it has others at its anchor; both.
ALONE, WHOLE, OTHERS, BOTH = 0, 1, 2, 3
_PAD = 0xFF  # never in UTF-8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xBF58476D1CE4E5B9)
_BYTE = np.random.default_rng(400).integers(1 << 62, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _MIXER
    return x ^ x >> np.uint64(32)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, inverse)]
    return _powers[0][:n], _powers[1][:n]


class Pieces:
    """The pieces of some texts: anchors' hashes and places, first and last window, whole hashes, by place."""

    def __init__(self, texts: list[bytes]):
        self.a = a = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        n = len(a)
        if n < WIDTH:
            self.anchor = self.hash = self.whole = np.zeros(0, np.uint64)
            self.first = self.last = np.zeros(0, np.int64)
            return
        h = _BYTE[a]
        for step, factor in ((1, 3), (2, 5), (4, 7), (8, 11), (16, 13)):
            h = h[:-step] * np.uint64(int(_ODD) * factor % (1 << 64)) + _mix(h[step:])
        # the high bits of the hash decide, then the place: the first of equal strings
        key = _mix(h) >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        least, span = key, 1
        while 2 * span <= _STARTS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: n - WIDTH + 1], least[_STARTS - span : _STARTS - span + n - WIDTH + 1])
        at = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
        del least, key
        # windows that cross a document's end are none
        starts = np.arange(n - WIDTH + 1)
        room = np.repeat(self.ends, lengths)[: n - WIDTH + 1] - starts
        good = room >= WIDTH
        new = good.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~good[:-1]
        self.first = np.flatnonzero(new)
        stop = good.copy()
        stop[:-1] &= (at[1:] != at[:-1]) | ~good[1:]
        self.last = np.flatnonzero(stop)
        self.anchor = at[self.first]
        self.hash = h[self.anchor]
        power, inverse = _power_tables(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[a] * power[:n], dtype=np.uint64)])
        body = (sums[self.last + WIDTH] - sums[self.first]) * inverse[self.first]
        self.whole = _mix(body ^ _mix((self.anchor - self.first).astype(np.uint64) << np.uint64(20) | (self.last - self.first).astype(np.uint64)))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _distinct(anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct (anchor, whole), the place of each pair among them, how often each occurs."""
    order = np.lexsort((whole, anchor))
    x, y = anchor[order], whole[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
    of = np.empty(len(x), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    return x[first], y[first], of, np.diff(np.append(first, len(x)))


def _scratch(shape: tuple[int, int], kind: type) -> np.ndarray:
    """Zeros; for a collection over PART_BYTES in an external file that goes with the task, read column by column."""
    if shape[0] * shape[1] <= PART_BYTES:
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, kind, "w+", shape=shape)


def column_repeats(matrix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows repeat in the group. matrix: a row for each aligned piece, padded; group: ascending.

    Rounds go from the last column to the first; `order` lists the pieces by group and suffix, `common` has how many
    symbols each shares with the one before it, up to WIDTH.
    """
    m = len(matrix)
    columns = _scratch((_COLUMNS, m), np.uint8)
    columns[:] = matrix.T
    repeats = _scratch((_STARTS, m), bool)
    order = np.arange(m)
    heads = np.concatenate([[True], group[1:] != group[:-1]])
    starts = np.flatnonzero(heads)
    sizes = np.diff(np.append(starts, m))
    slot = np.repeat(np.arange(len(starts)), sizes)
    common = np.zeros(m, np.int32)
    for c in range(_COLUMNS - 1, -1, -1):
        symbol = columns[c][order]
        change = symbol[1:] != symbol[:-1]
        change &= ~heads[1:]
        common += 1
        common[starts] = 0
        if change.any():
            mixed = np.zeros(len(starts), bool)
            mixed[slot[1:][change]] = True
            part = np.flatnonzero(mixed[slot])
            rank = slot[part] * 256 + symbol[part]
            moved = np.argsort(rank, kind="stable")
            place = part[moved]
            alike = rank[moved][1:] == rank[moved][:-1]
            # a common prefix is the least one between the two places in the old order
            before = np.append(common - 1, 0)
            bounds = np.stack([place[:-1] + 1, place[1:] + 1], 1)[alike].ravel()
            new = np.zeros(len(part), np.int32)
            if len(bounds):
                new[1:][alike] = np.minimum.reduceat(before, bounds)[::2] + 1
            common[part] = new
            order[part] = order[place]
        np.minimum(common, WIDTH, out=common)
        if c < _STARTS:
            full = common >= WIDTH
            both = full.copy()
            both[:-1] |= full[1:]
            repeats[c, order[both]] = True
    return repeats.T


def _aligned(bodies: list[np.ndarray], before: np.ndarray) -> np.ndarray:
    matrix = _scratch((len(bodies), _COLUMNS), np.uint8)
    matrix[:] = _PAD
    for row, (body, left) in enumerate(zip(bodies, before.tolist(), strict=True)):
        at = _STARTS - 1 - left
        matrix[row, at : at + len(body)] = body
    return matrix


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans array<struct<start,end>> in bytes, kept binary): each document."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    blocks = to_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    buckets = max(blocks.count(), BUCKETS)

    def texts_of(payload: bytes) -> tuple[pa.Array, list[bytes]]:
        table = unpack(payload)
        return table["doc_id"].combine_chunks(), [(t or "").encode() for t in table["text"].to_pylist()]

    def bucket_bounds(hashes: np.ndarray) -> np.ndarray:
        width = np.uint64((1 << 64) // buckets)  # what is over goes to the last one
        return np.append(np.searchsorted(hashes, np.arange(buckets, dtype=np.uint64) * width), len(hashes))

    def announced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [Pieces(texts[a:b]) for a, b in _chunks(texts)]
        x, y, _, n = _distinct(np.concatenate([p.hash for p in parts]), np.concatenate([p.whole for p in parts])) if parts else (np.zeros(0, np.uint64),) * 4
        return x, y, n

    def announce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x, y, n = announced(texts_of(payload.as_py())[1])
                at = bucket_bounds(x)
                for b, s in shares(at):
                    yield blob_rows([(block, b, pack_arrays(x[s], y[s], np.minimum(n[s], 2).astype(np.uint8)))])

    stats = cut(blocks.mapInArrow(announce, BLOB))

    def judge(table: pa.Table) -> pa.Table:
        """For each block the codes of its pieces; of one text, only the first block is asked to send it."""
        names, parts = table["block"].to_pylist(), [unpack_arrays(x.as_py()) for x in table["blob"]]
        turn = np.argsort(names, kind="stable")
        names, parts = [names[i] for i in turn], [parts[i] for i in turn]
        x, y, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((owner, y, x))
        x, y, n = x[order], y[order], n[order].astype(np.int64)
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        of = np.cumsum(first) - 1
        times = np.bincount(of, n)[of]
        anchor = np.cumsum(np.concatenate([[True], x[1:] != x[:-1]])) - 1
        kinds = np.bincount(anchor, first)[anchor]
        code = np.where(times > 1, np.where(kinds > 1, np.where(first, BOTH, WHOLE), WHOLE), np.where(kinds > 1, OTHERS, ALONE)).astype(np.int8)
        back = np.empty(len(x), np.int8)
        back[order] = code
        at = np.cumsum([0, *(len(p[0]) for p in parts)])
        bucket = table["bucket"][0].as_py()
        return pa.Table.from_batches([blob_rows([(b, bucket, pack_arrays(back[at[i] : at[i + 1]])) for i, b in enumerate(names)])])

    codes = cut(stats.groupBy("bucket").applyInArrow(judge, BLOB))
    del stats
    release(spark)

    def coded(texts: list[bytes], table: pa.Table, high: int) -> tuple[list[Pieces], list[np.ndarray], np.ndarray, np.ndarray]:
        chunks = [(a, b, Pieces(texts[a:b])) for a, b in _chunks(texts)]
        x, _, of, _ = _distinct(np.concatenate([p.hash for _, _, p in chunks]), np.concatenate([p.whole for _, _, p in chunks]))
        places = np.split(of, np.cumsum([len(p.hash) for _, _, p in chunks])[:-1])
        rows = sorted((b, blob) for b, blob in zip(table["bucket"].to_pylist(), table["blob"].to_pylist(), strict=True) if b < high)
        return [p for _, _, p in chunks], places, x, np.concatenate([unpack_arrays(blob)[0] for _, blob in rows]) if rows else np.zeros(0, np.int8)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """The pieces that bucket's collections need, each once."""
        block = left["block"][0].as_py()
        _, texts = texts_of(left["payload"][0].as_py())
        chunks, places, x, code = coded(texts, right, buckets)
        place, body, before, tail = [], [], [], []
        sent = np.zeros(len(x), bool)
        for p, which in zip(chunks, places, strict=True):
            for i in np.flatnonzero((code[which] >= OTHERS) & ~sent[which]).tolist():
                if not sent[which[i]]:
                    sent[which[i]] = True
                    place.append(which[i])
                    body.append(p.a[p.first[i] : p.last[i] + WIDTH])
                    before.append(p.anchor[i] - p.first[i])
                    tail.append(p.last[i] - p.first[i])
        out = []
        if place:
            order = np.argsort(place)
            place = np.array(place)[order]
            body = [body[i] for i in order.tolist()]
            before, tail = np.array(before, np.int32)[order], np.array(tail, np.int32)[order]
            at = np.searchsorted(place, bucket_bounds(x))
            for b, s in shares(at):
                out.append((block, b, pack_arrays(x[place[s]], before[s], tail[s], np.concatenate(body[s]))))
        return pa.Table.from_batches([blob_rows(out)])

    def construct(table: pa.Table) -> pa.Table:
        names, parts = table["block"].to_pylist(), [unpack_arrays(b.as_py()) for b in table["blob"]]
        anchor = np.concatenate([p[0] for p in parts])
        before, tail = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        bodies: list[np.ndarray] = []
        for _, _, t, body in parts:
            bodies += np.split(body, np.cumsum(t + WIDTH)[:-1])
        order = np.argsort(anchor, kind="stable")
        group = anchor[order]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        most = PART_BYTES // _COLUMNS
        spans: list[list[tuple[int, int]]] = [[] for _ in bodies]
        lo = 0
        while lo < len(group):
            ahead = cuts[np.searchsorted(cuts, lo, "right") :]
            fits = ahead[ahead <= lo + most]
            hi = int(fits[-1]) if len(fits) else int(ahead[0]) if len(ahead) else len(group)
            if len(group) <= lo + most:
                hi = len(group)
            rows = order[lo:hi]
            flags = column_repeats(_aligned([bodies[i] for i in rows.tolist()], before[rows]), group[lo:hi])
            for i, own in zip(rows.tolist(), flags, strict=True):
                at = _STARTS - 1 - int(before[i])
                spans[i] = _runs(own[at : at + int(tail[i]) + 1])
            lo = hi
        bucket, out, i = table["bucket"][0].as_py(), [], 0
        for name, p in zip(names, parts, strict=True):
            own = spans[i : i + len(p[0])]
            i += len(p[0])
            flat = np.array([v for s in own for v in s], np.int32).reshape(-1, 2)
            out.append((name, buckets + bucket, pack_arrays(np.array([len(s) for s in own], np.int32), flat[:, 0], flat[:, 1])))
        return pa.Table.from_batches([blob_rows(out)])

    sent = cut(blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(send, BLOB))
    built = cut(sent.groupBy("bucket").applyInArrow(construct, BLOB))
    del sent
    release(spark)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = texts_of(left["payload"][0].as_py())
        chunks, places, x, code = coded(texts, right, buckets)
        rows = sorted((b, blob) for b, blob in zip(right["bucket"].to_pylist(), right["blob"].to_pylist(), strict=True) if b >= buckets)
        found = [unpack_arrays(blob) for _, blob in rows]
        counts = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int32)
        starts, ends = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int32) for k in (1, 2))
        asked = np.flatnonzero(code >= OTHERS)  # in the order in which they were sent
        number = np.full(len(x), -1, np.int64)
        number[asked] = np.arange(len(asked))
        offset = np.cumsum(np.concatenate([[0], counts]))
        out = {"n_removed": [], "spans": [], "kept": []}
        for p, which in zip(chunks, places, strict=True):
            c = code[which]
            edge = np.zeros(len(p.a) + 1, np.int32)
            whole = (c == WHOLE) | (c == BOTH)
            np.add.at(edge, p.first[whole], 1)
            np.add.at(edge, p.last[whole] + WIDTH, -1)
            for i in np.flatnonzero(c == OTHERS).tolist():
                k = number[which[i]]
                for j in range(offset[k], offset[k + 1]):
                    edge[p.first[i] + starts[j]] += 1
                    edge[p.first[i] + ends[j] - 1 + WIDTH] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            begin = 0
            for end in p.ends.tolist():
                own = covered[begin:end]
                runs = _runs(own)
                out["spans"].append([{"start": s, "end": e} for s, e in runs])
                out["n_removed"].append(int(own.sum()))
                out["kept"].append(p.a[begin:end][~own].tobytes() if runs else p.a[begin:end].tobytes())
                begin = end
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": ids, "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array([len(s) for s in out["spans"]], pa.int64()), "spans": pa.array(out["spans"], span), "kept": pa.array(out["kept"], pa.binary())})

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary"
    return blocks.groupBy("block").cogroup(codes.unionByName(built).groupBy("block")).applyInArrow(remove, schema)

