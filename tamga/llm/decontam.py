"""Benchmark decontamination by suffix arrays of the training texts.

The training texts are cut into shards (slices of Arrow batches). A shard keeps the words that occur in the
benchmark as numbers, all others as 0, and sorts the suffixes that can match at all: those that start a run of
benchmark words as long as the shortest window. They are sorted by their first `window` words, an array of bounded
depth: the range of a window is the same in it as in an array sorted to the end, as nothing after these words decides.
Every benchmark window starts a test suffix: two binary searches give its range of suffixes, and so all locations.
How far a match goes on is told by the windows after it: those on one diagonal (same item, same distance between the
word positions) join to the longest verbatim matches.

A window is `window` consecutive words of an item, or the whole item if it has fewer. Items without words (or with
null text) have no windows; texts without words, or null, have no matches. Repeated items and rows count each.
An empty benchmark or an empty corpus gives rows without matches or no rows. Texts of any length are searched whole.
Other columns pass through, but for n_words and matches, which are replaced.
The benchmark goes to every task in parts of BENCHMARK_BYTES at most, however large it is: one part at a time, each
searched in a pass of its own over the kept texts, after which its windows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamga.llm.blocks import cut, free, quoted, slices

WINDOW = 10
BENCHMARK_BYTES = 8 << 20
SLICE_BYTES = 8 << 20
#: All ASCII bytes but letters and digits part words.
_BLANKED = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))
MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANKED).split()


class Windows:
    """The distinct windows of some benchmark items, ascending, and where in the items each occurs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        texts = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)] for _, text in items]
        self.items = [item for item, _ in items]
        counts = np.array([max(1, len(t) - window + 1) if t else 0 for t in texts], np.int64)
        item = np.repeat(np.arange(len(items), dtype=np.int32), counts)
        start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        # words of an item, then zeros up to a window's end
        ids = np.array([x for t in texts for x in (*t, *[0] * window)], np.uint32)
        begins = np.cumsum([0, *(len(t) + window for t in texts)])[:-1]
        rows = np.ascontiguousarray(ids[(begins[item] + start)[:, None] + np.arange(window)].astype(">u4"))
        self.low, of = np.unique(keys_of(rows), return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.item, self.start = item[order], start[order].astype(np.int32)
        #: where the places of a window begin
        self.first = np.searchsorted(of[order], np.arange(len(self.low) + 1))
        rows = rows[order][self.first[:-1]]
        self.length = (rows > 0).sum(1)
        self.high = keys_of(np.where(rows > 0, rows, 0xFFFFFFFF).astype(">u4"))
        self.shortest = int(self.length.min()) if len(rows) else 0

    def places(self, window: int) -> list[tuple[str, int]]:
        at = slice(self.first[window], self.first[window + 1])
        return [(self.items[i], s) for i, s in zip(self.item[at].tolist(), self.start[at].tolist(), strict=True)]


def keys_of(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as strings that sort alike."""
    return np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}").ravel()


def search(texts: list[str | None], windows: Windows) -> tuple[list[int], dict[int, list[tuple[str, int, int, int]]]]:
    """The number of words of each text, and by text the matches (item, item_start, doc_start, n_words)."""
    split = [words_of(t) for t in texts]
    counts = [len(w) for w in split]
    total = sum(counts)
    if not total or not windows.shortest:
        return counts, {}
    ids = np.fromiter((windows.number.get(w, 0) for ws in split for w in ws), np.uint32, total)
    del split
    ends = np.cumsum(counts)
    # stop[i]: where the run of benchmark words that holds i ends, at the latest with its text
    doc_end = np.repeat(ends, counts)
    unknown = np.where(ids == 0, np.arange(total), total)
    stop = np.minimum(np.minimum.accumulate(unknown[::-1])[::-1], doc_end)
    at = np.flatnonzero(stop - np.arange(total) >= windows.shortest)
    if not len(at):
        return counts, {}
    width = windows.window
    padded = np.concatenate([ids, np.zeros(width, np.uint32)])
    rows = padded[at[:, None] + np.arange(width)]
    rows[np.arange(width) >= (stop[at] - at)[:, None]] = 0
    key = keys_of(rows.astype(">u4"))
    order = np.argsort(key, kind="stable")
    key, suffix = key[order], at[order]
    first, last = np.searchsorted(key, windows.low, "left"), np.searchsorted(key, windows.high, "right")
    begins = ends - counts
    by_text: dict[int, dict[tuple[str, int], list[int]]] = {}
    for w in np.flatnonzero(last > first).tolist():
        found = suffix[first[w] : last[w]]
        docs = np.searchsorted(ends, found, "right")
        for doc, start in zip(docs.tolist(), (found - begins[docs]).tolist(), strict=True):
            for item, item_start in windows.places(w):
                by_text.setdefault(doc, {}).setdefault((item, start - item_start), []).append((start, start + int(windows.length[w])))
    out: dict[int, list[tuple[str, int, int, int]]] = {}
    for doc, diagonals in by_text.items():
        spans = out.setdefault(doc, [])
        for (item, distance), hits in diagonals.items():
            hits.sort()
            begin, end = hits[0]
            for a, b in hits[1:]:
                if a > end:
                    spans.append((item, begin - distance, begin, end - begin))
                    begin = a
                end = max(end, b)
            spans.append((item, begin - distance, begin, end - begin))
        spans.sort()
    return counts, out


def _benchmark_parts(benchmark: DataFrame, item: str, text: str) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """The items in parts that the driver and every task can hold: how many, and each when it is asked for."""
    sized = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = 1 if total <= BENCHMARK_BYTES else 2 * (total // BENCHMARK_BYTES + 1)
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    return parts, ([(r.item, r.text) for r in dealt.where(F.col("part") == part).select("item", "text").collect()] for part in range(parts))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words long and matches: the longest verbatim matches with each item and their places in words."""
    rest = [c for c in docs.columns if c not in ("n_words", "matches")]
    parts, lists = _benchmark_parts(benchmark, item_id, item_text)
    if parts == 1:
        return _matched(docs, rest, Windows(next(lists), window), text)[0]
    row, more = free([*docs.columns, "n_words", "matches"], "_row", "_more")
    kept = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for items in lists:
        matched, shared = _matched(kept, [*rest, row], Windows(items, window), text)
        parts -= 1
        if parts:
            own = cut(matched.where(F.size("matches") > 0).select(row, F.col("matches").alias(more)))
            shared.destroy()
            found = own if found is None else found.unionByName(own)
    found = found.groupBy(row).agg(F.flatten(F.collect_list(more)).alias(more))
    every = matched.join(found, row, "left")
    both = F.concat("matches", F.coalesce(F.col(more), F.expr(f"cast(array() as {MATCH})")))
    return every.select(*map(quoted, rest), "n_words", both.alias("matches"))


def _matched(docs: DataFrame, rest: list[str], windows: Windows, text: str) -> tuple[DataFrame, Broadcast]:
    """The columns of rest with n_words and matches, and what is sent to the tasks for it."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)  # of BENCHMARK_BYTES at most
    (body,) = free(rest, "_text_")
    schema = ", ".join([*(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in rest), "n_words long", f"matches {MATCH}"])
    fields = ("item_id", "item_start", "doc_start", "n_words")
    kind = pa.list_(pa.struct([("item_id", pa.string()), *((f, pa.int32()) for f in fields[1:])]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, body):
                counts, found = search(part.column(part.num_columns - 1).to_pylist(), shared.value)
                matches = [[dict(zip(fields, m, strict=True)) for m in found.get(i, ())] for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(matches, kind)], [*rest, "n_words", "matches"])

    return docs.select(*map(quoted, rest), F.col(text).alias(body)).mapInArrow(run, schema), shared


def hit_words(matches: str = "matches") -> F.Column:
    """How many words of the text lie in any match: the union of the spans."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m.doc_start.alias("a"), (m.doc_start + m.n_words).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")))["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    return benchmark_matches(docs, benchmark, text, item_id, item_text, window).where(F.size("matches") == 0).select(*docs.columns)
