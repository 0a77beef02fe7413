"""N-gram Jaccard join by prefix trees.

A document's set are its distinct 5-word shingles as 64-bit hashes, in one global order: rarest first, by how many
documents hold the shingle. Two sets with a Jaccard similarity of THRESHOLD share a shingle among the first
n - ceil(THRESHOLD * n) + 1 of each, so documents meet at the shingles of these prefixes that another document holds.

First each meeting group has one pivot, its least row, which the others are compared with; most copies are connected
by that. Of groups that are still apart, those which rows tie together to few rows in all are compared as one. Others
are compared each on its own, groups of the same members once; of a large group only sets of like size meet, and those
in parts, two by two. Everywhere the ordered sets of one
side (pivots, or a part) are stored in a radix trie, and a probe walks it with the overlap so far, shared by all sets below an edge, and leaves a
subtree when the overlap and what remains on either side can't reach the least overlap that any set below needs. Rows
that are connected already, directly or through others, aren't compared again, so no link between components is lost.

Documents with equal sets are one class with one representative; only representatives are joined. Null and empty
texts have no shingles and are linked with nothing, not even with each other. Fewer than 5 words are one shingle.
Rows with a null id, or repeated rows, take part as rows of their own; an empty table gives an empty one. Texts are
taken whole: a very long one is a block of its own. Other columns, of any name, are not read; `deduplicate` keeps them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamga.llm.blocks import BLOB, BUCKETS, FORGET, Kept, blob_rows, cut, pack_arrays, release, shares, tidy, to_blocks, unpack, unpack_arrays

WORDS = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = 4, 5
#: Rows of a meeting group that one trie stores.
PART_ROWS = 512
#: Sets that link lie in one class of sizes or in neighbouring ones, as this is more than 1 / THRESHOLD.
CLASS = 1.26
#: A row's number has a partition of PARTITION_BITS, a block there of BLOCK_BITS and a place there of PLACE_BITS.
PARTITION_BITS, BLOCK_BITS, PLACE_BITS = 20, 21, 22
REMEMBERED = 150_000
BLOCK_BYTES = 8 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_known: dict[bytes, int] = {}
FORGET["ngram_join"] = _known.clear


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    get = _known.get
    out = [get(w) for w in words]
    for i, x in enumerate(out) if None in out else ():
        if x is None:
            w = words[i]
            out[i] = _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array(out, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    if len(h) < WORDS:
        return _mix((h * _MULTIPLIERS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        s += h[k : k + n] * _MULTIPLIERS[k]
    s = _mix(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _row_of(block: int, rows: int = 0) -> int:
    """The number of a block's first document; rows: how many the block has. Raises where a field is too small."""
    partition, place = block >> 32, block & 0xFFFFFFFF
    if partition >> PARTITION_BITS or place >> BLOCK_BITS or rows >> PLACE_BITS:
        raise ValueError(f"partition {partition}, block {place} there or {rows} rows in it: more than a row number can tell apart")
    return (partition << BLOCK_BITS | place) << PLACE_BITS


def _block_of(row: F.Column) -> F.Column:
    return F.shiftleft(F.shiftright(row, BLOCK_BITS + PLACE_BITS), 32).bitwiseOR(F.shiftright(row, PLACE_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _rarity(documents: np.ndarray) -> np.ndarray:
    """How many documents hold a shingle, in steps that fit a byte."""
    return np.where(documents < 128, documents, np.minimum(255, 128 + 4 * np.log2(np.maximum(documents, 128) / 128))).astype(np.uint8)


def least_overlap(n: int, m: int) -> int:
    """The least number of shared shingles for sets of n and m: i >= t * (n + m - i)."""
    a, b = LEAST
    return -(-a * (n + m) // (a + b))


def _prefix(n: int) -> int:
    a, b = LEAST
    return n - -(-a * n // b) + 1


class Trie:
    """A radix trie of ordered sets. Sets are (rarity, shingle) pairs as one ascending list; sizes may be larger than
    the lists, which leave out shingles that only one document holds."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        self.leaves = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.place = {leaf: p for p, leaf in enumerate(self.leaves)}
        lengths = np.array([len(sets[i]) for i in self.leaves])
        size = np.array([sizes[i] for i in self.leaves])
        #: (first leaf, past the last, edge, longest rest below it, least size below it, sets that end at it, children)
        self.nodes: list[tuple] = []
        waiting = [(0, len(sets), 0, None)]
        while waiting:
            lo, hi, depth, siblings = waiting.pop()
            first, last = sets[self.leaves[lo]], sets[self.leaves[hi - 1]]
            shared = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:shared] != last[depth:shared])
            end = depth + int(differ[0]) if len(differ) else shared
            if siblings is not None:
                siblings.append(len(self.nodes))
            children: list[int] = []
            p = lo
            while p < hi and lengths[p] == end:
                p += 1
            self.nodes.append((lo, hi, first[depth:end], int(lengths[lo:hi].max()) - end, int(size[lo:hi].min()), self.leaves[lo:p], children))
            while p < hi:
                token, q = sets[self.leaves[p]][end], p + 1
                while q < hi and sets[self.leaves[q]][end] == token:
                    q += 1
                waiting.append((p, q, end, children))
                p = q

    def probe(self, tokens: np.ndarray, size: int, wanted: list[int]) -> list[int]:
        """The wanted sets that link with a set of size shingles, of which tokens (ascending) may be shared."""
        places = sorted(self.place[i] for i in wanted)
        asked = set(wanted)
        found: list[int] = []
        stack = [(0, 0, 0)]
        while stack:
            node, overlap, passed = stack.pop()
            lo, hi, edge, remaining, least, ends, children = self.nodes[node]
            at = bisect_left(places, lo)
            if at == len(places) or places[at] >= hi:
                continue
            need, at = least_overlap(size, least), 0
            reach = overlap + min(len(edge) + remaining, len(tokens) - passed)
            while reach >= need and at < len(edge):
                # a piece at a time, growing: sets that don't link mostly differ in their first, rarest shingles
                piece = edge[at : 2 * at + 32]
                at += len(piece)
                spot = np.searchsorted(tokens, piece)
                overlap += int(np.count_nonzero(tokens[np.minimum(spot, len(tokens) - 1)] == piece))
                passed = int(spot[-1]) + int(spot[-1] < len(tokens) and tokens[spot[-1]] == piece[-1])
                reach = overlap + min(len(edge) - at + remaining, len(tokens) - passed)
            if reach < need:
                continue
            found += [i for i in ends if overlap >= least_overlap(size, self.sizes[i]) and i in asked]
            stack += [(child, overlap, passed) for child in children]
        return found


def _components(links: DataFrame) -> DataFrame:
    """(row, component) of all rows in links (a, b): least labels spread, with a jump along labels each time."""
    with Kept(links.sparkSession) as keep:
        return cut(_spread(links, keep))


def _spread(links: DataFrame, keep: Kept) -> DataFrame:
    edges = keep(links.union(links.select("b", "a")).toDF("row", "other").distinct())
    labels = edges.groupBy("row").agg(F.least(F.min("other"), F.col("row")).alias("component"))
    labels = keep(labels)
    while True:
        near = edges.join(labels.toDF("other", "their"), "other").groupBy("row").agg(F.min("their").alias("their"))
        spread = labels.join(near, "row").select("row", "component", F.least("component", "their").alias("new"))
        jump = labels.toDF("new", "root")
        after = keep(spread.join(jump, "new", "left").select("row", "component", F.least("new", F.coalesce("root", "new")).alias("new")))
        changed = after.where(F.col("new") != F.col("component")).limit(1).count()
        labels = after.select("row", F.col("new").alias("component"))
        if not changed:
            return labels


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, n_shingles, component_id, component): a row for each document; component_id is the least doc_id
    that links reach, component a number of the same group that also tells apart rows without or with equal ids."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return _near(to_blocks(docs.select(doc_id, text), text, BLOCK_BYTES), kind, doc_id, text)


def _near(blocks: DataFrame, kind: str, doc_id: str, text: str) -> DataFrame:
    count = blocks.count()
    buckets = max(count, BUCKETS)
    # documents are counted by so many bits of a shingle's hash: some 64 slots for each shingle at any number of blocks
    bits = min(64, max(32, 25 + count.bit_length()))

    def keys_of(s: np.ndarray) -> np.ndarray:
        return s >> np.uint64(64 - bits)

    def sets_of(payload: bytes) -> tuple[pa.Array, list[np.ndarray]]:
        table = unpack(payload)
        return table[doc_id].combine_chunks(), [shingles(t) for t in table[text].to_pylist()]

    def bounds(keys: np.ndarray) -> np.ndarray:
        width = np.uint64((1 << bits) // buckets)  # what is over goes to the last one
        return np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) * width), len(keys))

    def first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, sets = sets_of(payload.as_py())
                digests = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "S16")
                sink = pa.BufferOutputStream()
                facts = pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([d.ljust(16, b"\0") for d in digests.tolist()], pa.binary())], ["doc_id", "n", "digest"])
                with pa.ipc.new_stream(sink, facts.schema) as out:
                    out.write_batch(facts)
                yield blob_rows([(block, -1, sink.getvalue().to_pybytes())])
                keys, n = _seen(keys_of(np.concatenate(sets)))
                for b, s in shares(bounds(keys)):
                    yield blob_rows([(block, b, pack_arrays(keys[s], n[s].astype(np.uint32)))])
                del sets, keys, n
                tidy("ngram_join")

    stats = cut(blocks.mapInArrow(first_pass, BLOB))

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                table = unpack(blob.as_py()).combine_chunks()
                row = pa.array(_row_of(block, len(table)) + np.arange(len(table)), pa.int64())
                yield pa.RecordBatch.from_arrays([row, *(table[c].combine_chunks() for c in ("doc_id", "n", "digest"))], ["row", "doc_id", "n", "digest"])

    facts = cut(stats.where("bucket = -1").mapInArrow(rows_of, f"row long, doc_id {kind}, n long, digest binary"))
    heads = cut(facts.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("head")))

    def answer(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(x.as_py()) for x in table["blob"]]
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([c for _, c in parts])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        rarity, keys = _rarity(np.add.reduceat(n.astype(np.int64), first)), keys[first]
        bucket = table["bucket"][0].as_py()
        rows = [(b, bucket, pack_arrays(rarity[np.searchsorted(keys, k)].view(np.int8))) for b, (k, _) in zip(table["block"].to_pylist(), parts, strict=True)]
        return pa.Table.from_batches([blob_rows(rows)])

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of the representatives: the set, ordered, of shingles that other documents hold, and how many lie in the prefix."""
        block = left["block"][0].as_py()
        replies = dict(zip(right["bucket"].to_pylist(), right["blob"].to_pylist(), strict=True))
        own = sorted(row for rows in right["heads"].to_pylist() for row in rows or ())
        out = {"row": [], "n": [], "shared": [], "meets": []}
        if own:
            del replies[-1]
            _, sets = sets_of(left["payload"][0].as_py())
            keys, _ = _seen(keys_of(np.concatenate(sets)))
            rarity = np.concatenate([unpack_arrays(replies[b])[0] for b in sorted(replies)]).view(np.uint8)
            for row in own:
                s = sets[row - _row_of(block)]
                rare = rarity[np.searchsorted(keys, keys_of(s))]
                alone = int(np.count_nonzero(rare < 2))
                meets = _prefix(len(s)) - alone
                if meets > 0 and alone < len(s):
                    shared = s[rare >= 2]
                    # the rarity takes the place of the top byte, so that numbers ascend in the global order
                    tokens = np.sort(rare[rare >= 2].astype(np.uint64) << np.uint64(56) | shared >> np.uint64(8))
                    out["row"].append(row)
                    out["n"].append(len(s))
                    out["shared"].append(tokens.tobytes())
                    out["meets"].append(min(meets, len(tokens)))
            del sets, keys, rarity
            tidy("ngram_join")
        kinds = {"row": pa.int64(), "n": pa.int32(), "shared": pa.binary(), "meets": pa.int32()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    asked = stats.where("bucket >= 0").groupBy("bucket").applyInArrow(answer, BLOB)
    own = heads.groupBy(_block_of(F.col("head")).alias("block")).agg(F.collect_list("head").alias("heads")).withColumn("bucket", F.lit(-1))
    sets = blocks.groupBy("block").cogroup(asked.unionByName(own, allowMissingColumns=True).groupBy("block")).applyInArrow(second_pass, "row long, n int, shared binary, meets int")
    with Kept(blocks.sparkSession) as keep:
        sets = keep(sets)
        del stats, asked, own  # their files may go
        release(blocks.sparkSession)
        links = cut(_joined(sets, count, keep))
    labels = _components(links)
    reached = facts.where("n > 0").join(heads, ["digest", "n"]).select("row", "doc_id", "n", "head")
    reached = reached.join(labels.toDF("head", "component"), "head", "left").withColumn("component", F.coalesce("component", "head"))
    reached = cut(reached.select("row", "doc_id", "n", "component"))
    least = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = reached.join(least, "component").select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", "component")
    alone = facts.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row").alias("component"))
    return linked.unionByName(alone)


def _joined(sets: DataFrame, count: int, keep: Kept) -> DataFrame:
    """(a, b): links that connect all that is linked. sets: (row, n, shared, meets)."""

    def meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, meets = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            tokens = [np.frombuffer(s.as_py(), np.uint64, m).view(np.int64) for s, m in zip(batch.column(2), meets, strict=True)]
            yield pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.repeat(rows, meets)), pa.array(np.repeat(batch.column(1).to_numpy(), meets))], ["token", "row", "n"])

    rows = sets.mapInArrow(meetings, "token long, row long, n int")
    several = rows.groupBy("token").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("token")
    rows = keep(rows.join(several, "token", "left_semi"))
    pivots = keep(rows.groupBy("token").agg(F.min(F.struct("row", "n")).alias("p")).select("token", F.col("p.row").alias("pivot"), F.col("p.n").alias("m")))
    a, b = LEAST
    asked = rows.join(pivots, "token").where((F.col("row") != F.col("pivot")) & (b * F.col("n") >= a * F.col("m")) & (b * F.col("m") >= a * F.col("n")))
    near = keep(_probed(sets, keep(asked.groupBy("row").agg(F.collect_set("pivot").alias("pivots"))), max(16, count)))
    labels = _spread(near, keep)
    # a group's pivot has met all the others; these are compared unless they are one component by now
    rest = rows.join(pivots.select("token", F.col("pivot").alias("row")), ["token", "row"], "left_anti")
    rest = rest.join(labels, "row", "left").withColumn("component", F.coalesce("component", "row"))
    # tokens with the same members, told by two sums of their hashes, are one meeting
    members = [F.count(F.lit(1)).alias("members"), *(F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in range(2))]
    apart = rest.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), *members).where("low < high")
    apart = apart.groupBy("members", "h0", "h1").agg(F.min("token").alias("token")).select("token", "members")
    met = keep(rest.join(apart, "token").select("token", "row", "n", "component", "members"))
    first = met.groupBy("token").agg(F.min("row").alias("first"))
    families = _spread(met.join(first, "token").select(F.col("row").alias("a"), F.col("first").alias("b")), keep).toDF("row", "family")
    few = families.groupBy("family").agg((F.count(F.lit(1)) <= PART_ROWS).alias("few"))
    met = keep(met.join(families.join(few, "family"), "row"))
    return near.unionByName(_far(met, sets))


def _far(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The links between components in each meeting, as (a, b), by trie joins. met: (token, row, n, component, members,
    family, few).

    Few rows that meetings tie together, directly or through others, are one cell, to which each row goes once; so most
    rows aren't copied for each meeting they are in. Else each meeting has cells of its own.

    Rows may link with those of their class of sizes and of the two beside it; where these are all one component, none
    is compared. A small meeting is one cell, of which each row meets each; in a large one there is a cell for each two
    parts of a class, or of neighbouring classes.
    """
    families = met.where("few").select(F.col("family").alias("token"), *(F.lit(x).alias(c) for c, x in (("low", -1), ("step", 0), ("i", 0), ("j", 0))), "row", F.lit(False).alias("probes"), "component").distinct()
    met = met.where("not few").withColumn("class", F.floor(F.log("n") / F.log(F.lit(CLASS))).cast("int"))
    line = Window.partitionBy("token").orderBy("class")  # a row for each class of sizes
    sizes = met.groupBy("token", "class").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"), F.min("component").alias("least"), F.max("component").alias("most"))
    beside = lambda f, step, column: F.when(f("class").over(line) == F.col("class") + step, f(column).over(line))
    around = lambda column, pick: pick(F.col(column), beside(F.lead, 1, column), beside(F.lag, -1, column))
    parts = [F.coalesce(beside(*x, "parts"), F.lit(0)).alias(name) for name, x in (("up", (F.lead, 1)), ("down", (F.lag, -1)))]
    sizes = sizes.select("token", "class", "parts", *parts, (around("least", F.least) < around("most", F.greatest)).alias("several")).where("several")
    dealt = met.join(sizes, ["token", "class"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def cells(parts: str, cell) -> F.Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col(parts) - 1, F.lit(0))), lambda o: o < F.col(parts)), cell)

    def cell(low: F.Column, step: int, i: F.Column, j: F.Column, probes: F.Column) -> F.Column:
        return F.struct(low.alias("low"), F.lit(step).alias("step"), i.alias("i"), j.alias("j"), probes.alias("probes"))

    own, part = F.col("class"), F.col("part")
    whole = F.array(cell(F.lit(0), 0, F.lit(0), F.lit(0), F.lit(False)))
    split = F.concat(
        cells("parts", lambda o: cell(own, 0, F.least(part, o), F.greatest(part, o), part > o)),
        cells("up", lambda o: cell(own, 1, part, o, F.lit(False))),
        cells("down", lambda o: cell(own - 1, 1, o, part, F.lit(True))),
    )
    key = ["token", "low", "step", "i", "j"]
    placed = dealt.select("token", "row", "component", F.explode(F.when(F.col("members") <= PART_ROWS, whole).otherwise(split)).alias("cell")).select("token", "cell.*", "row", "component")
    placed = placed.unionByName(families).join(sets.select("row", "n", "shared"), "row").repartition(*key).sortWithinPartitions(*key)

    def join(table: pa.Table) -> list[tuple[int, int]]:
        rows, sizes = table["row"].to_numpy(), table["n"].to_numpy().astype(np.int64)
        names, component = np.unique(table["component"].to_numpy(), return_inverse=True)
        root = np.arange(len(names))
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shared"]]
        one = table["step"][0].as_py() == 0 and table["i"][0] == table["j"][0]
        probes = table["probes"].to_numpy(zero_copy_only=False)
        stored = np.arange(len(rows)) if one else np.flatnonzero(~probes)
        probing = stored if one else np.flatnonzero(probes)
        links: list[tuple[int, int]] = []
        if len(stored) and len(probing):
            trie = Trie([sets[k] for k in stored], sizes[stored].tolist())
            a, b = LEAST
            for at, x in enumerate(probing.tolist()):
                others = stored[:at] if one else stored
                m = sizes[others]
                may = (root[component[others]] != root[component[x]]) & (b * m >= a * sizes[x]) & (b * sizes[x] >= a * m)
                wanted = np.flatnonzero(may)
                for k in trie.probe(sets[x], int(sizes[x]), wanted.tolist()) if len(wanted) else ():
                    old, new = root[component[stored[k]]], root[component[x]]
                    if old != new:
                        root[root == old] = new
                        links.append((int(rows[x]), int(rows[stored[k]])))
        return links

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _runs(batches, key):
            links = join(one)
            if links:
                yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def _runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches in its order."""
    waiting: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in key]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        at = [0, *new.tolist(), len(batch)]
        for start, end in zip(at[:-1], at[1:], strict=True):
            own = tuple(int(c[start]) for c in columns)
            if waiting and own != before:
                yield pa.Table.from_batches(waiting)
                waiting = []
            before = own
            waiting.append(batch.slice(start, end - start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _probed(sets: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """The pairs that link, as (a, b), of rows and the pivots they ask for (row, pivots array). Each group of probing
    rows gets each pivot it needs once."""
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")

    def once(table: pa.Table) -> pa.Table:
        pivots = np.unique(table["pivots"].combine_chunks().flatten().to_numpy())
        return pa.table({"group": pa.array(np.full(len(pivots), table["group"][0].as_py())), "row": pa.array(pivots)})

    probing = sets.join(asked, "row").select(group, "row", "n", "shared", "pivots")
    needed = asked.select(group, "pivots").groupBy("group").applyInArrow(once, "group long, row long")
    pivots = sets.join(needed, "row").select("group", "row", "n", "shared").toDF("at", "row", "n", "shared")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right["row"].to_pylist()
        a, b = [], []
        if rows and len(left):
            number = {r: i for i, r in enumerate(rows)}
            trie = Trie([np.frombuffer(x.as_py(), np.uint64) for x in right["shared"]], right["n"].to_pylist())
            for row, n, shared, wanted in zip(left["row"].to_pylist(), left["n"].to_pylist(), left["shared"], left["pivots"].to_pylist(), strict=True):
                for i in trie.probe(np.frombuffer(shared.as_py(), np.uint64), n, [number[w] for w in wanted]):
                    a.append(row)
                    b.append(rows[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return probing.groupBy("group").cogroup(pivots.groupBy("at")).applyInArrow(join, "a long, b long")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id; the first row of equal or null ids."""
    blocks = to_blocks(docs, text, BLOCK_BYTES)
    found = _near(blocks, docs.schema[doc_id].dataType.simpleString(), doc_id, text)
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    kept = kept.select(_block_of(F.col("first.row")).alias("block"), F.col("first.row").alias("row"))

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            raise ValueError("a block is missing")
        chosen = np.sort(np.array(right["row"].to_pylist(), np.int64)) - _row_of(left["block"][0].as_py())
        return unpack(left["payload"][0].as_py()).take(pa.array(chosen))

    return blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(rows, docs.schema)
