"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A tokenizers BPE model works on characters and an ordered list of merges, a ranks file holds bytes and lets any
two neighbours merge whose concatenation is a token, the lowest rank first and the leftmost of equals. The model
gets every split of every token into two tokens as a merge, ordered by the token's rank, which merges in the same
order but for one case: when x+y = y+z are one token, "xyz" has two candidate merges of the same rank, and merges
can't be of equal rank. Such triples are listed when the model is built; a piece that holds one is merged by a
plain loop.

Null texts are empty; an empty text has no ids. Very long texts are whole: only their pieces are looked up.
Repeated rows give repeated results, an empty table an empty one. Other columns pass through, of any name; columns
called ids, spans or decoded are replaced where these are made.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamga.llm.blocks import FORGET, free, quoted, slices, tidy

#: Pieces whose ids a worker remembers; more are looked up again, nothing is dropped.
REMEMBERED = 300_000
SLICE_BYTES = 4 << 20


def byte_alphabet() -> str:
    """A printable character for each byte: itself if it is one in Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class ByteBpe:
    """Encodes and decodes by a ranks file (base64 token, blank, rank on each line) and a split pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Tokenizer, models

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.findall = regex.compile(pattern).findall
        self.to_chars = {i: c for i, c in enumerate(byte_alphabet())}
        self.from_chars = {ord(c): i for i, c in enumerate(byte_alphabet())}
        merges, triples = [], set()
        for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
            merges += [(self._chars(a), self._chars(b)) for a, b in cuts]
            firsts = {a: b for a, b in cuts}
            triples.update(x + y + firsts[y] for x, y in cuts if y in firsts and x != y)
        self.tied = ahocorasick.Automaton()
        for t in triples:
            self.tied.add_word(self._chars(t), True)
        self.tied.make_automaton()
        vocab = {self._chars(t): r for t, r in self.ranks.items()}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for chars, r in vocab.items():
            self.bytes_of[r] = bytes(chars.translate(self.from_chars), "latin-1")
        self.known: dict[str, tuple[int, ...]] = {}

    def _chars(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.to_chars)

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """The merge loop itself, for the few pieces with tied merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(self.ranks[p] for p in parts)

    def learn(self, pieces: Iterable[str]) -> None:
        """Look up the ids of pieces that aren't remembered."""
        wanted = set(pieces)
        new = [p for p in wanted if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(wanted)
        rest = []
        for p in new:
            rank = self.ranks.get(p.encode())
            if rank is None:
                rest.append(p)
            else:
                self.known[p] = (rank,)
        triples = len(self.tied)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            data = [self._chars(p.encode()) for p in part]
            got = self.model.encode(data, is_pretokenized=True, add_special_tokens=False)
            words = np.array(got.word_ids, np.int64)
            ids = got.ids
            ends = np.searchsorted(words, np.arange(len(part)), "right").tolist()
            start = 0
            for p, chars, end in zip(part, data, ends, strict=True):
                self.known[p] = self._merge(p.encode()) if triples and next(self.tied.iter(chars), None) else tuple(ids[start:end])
                start = end

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.findall(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(split))
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, pieces))) for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids. A character may be split over several ids, so text is decoded only as a whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """For each id the code points it touches (start, end); ids that share a character share its span."""
        ends = np.cumsum([0, *(len(self.bytes_of[i]) for i in ids)])
        first = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        char_of = np.cumsum(first) - 1
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(2)
def bpe(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


FORGET["bpe"] = bpe.cache_clear


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """docs with ids array<int>; with offsets, also spans array<struct<start, end>> in code points; with decoded,
    also decoded binary, the ids turned back to bytes."""
    added = ["ids", *["spans"] * offsets, *["decoded"] * decoded]
    rest = [c for c in docs.columns if c not in added]
    (body,) = free(rest, "_text_")
    docs = docs.select(*map(quoted, rest), F.col(text).alias(body))
    schema = ", ".join([*(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in rest), "ids array<int>", *["spans array<struct<start:int,end:int>>"] * offsets, *["decoded binary"] * decoded])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy("bpe")
        model = bpe(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, body):
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = model.encode_batch(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
                out = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat)]
                if offsets:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    out.append(pa.array([[{"start": a, "end": b} for a, b in model.offsets(t or "", i)] for t, i in zip(texts, ids, strict=True)], kind))
                if decoded:
                    out.append(pa.array(list(map(model.decode, ids)), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, [*rest, *added])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded binary. Null ids give no bytes."""
    rest = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join([*(f"{quoted(c)} {encoded.schema[c].dataType.simpleString()}" for c in rest), "decoded binary"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(ranks_path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.decode(i or ()) for i in lists], pa.binary())], [*rest, "decoded"])

    return encoded.select(*map(quoted, rest)).mapInArrow(run, schema)
