"""Parts of the operators that need no session: blobs, tries, lookups, suffix searches."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tamga.llm import blocks, ctw, decontam, ngram_join


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.lists(st.integers(-5, 5), max_size=9))
def test_blobs_keep_arrays(a, b):
    first, second = np.sort(np.array(a, np.uint64)), np.array(b, np.int32)
    x, y = blocks.unpack_arrays(blocks.pack_arrays(first, second))
    assert (x == first).all() and x.dtype == first.dtype and (y == second).all() and y.dtype == second.dtype


def test_slices_hold_all_rows_in_order():
    batch = pa.record_batch({"n": list(range(9)), "text": ["", "a" * 50, None, "b", "c" * 7, "", "d" * 30, "e", "f"]})
    parts = list(blocks.slices(batch, 10, "text"))
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(9))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 10 for p in parts)
    assert blocks.unpack(blocks.pack(batch)).to_pylist() == batch.to_pylist()


def test_trie_finds_all_that_link():
    rng = random.Random(3)
    base = sorted(rng.sample(range(2000), 150))
    sets = []
    for _ in range(60):
        s = set(rng.sample(base, rng.randint(100, 150))) | set(rng.sample(range(2000, 2400), rng.randint(0, 40)))
        sets.append(np.array(sorted(s), np.uint64))
    sets += [sets[0], np.array([5], np.uint64), np.zeros(0, np.uint64)]
    # shingles that only one document holds count in the size alone
    sizes = [len(s) + rng.randint(0, 3) for s in sets]
    trie = ngram_join.Trie(sets, sizes)
    for s, n in zip(sets, sizes, strict=True):
        if not len(s):
            continue
        wanted = rng.sample(range(len(sets)), 40)
        want = {i for i in wanted if 100 * (k := len(set(s.tolist()) & set(sets[i].tolist()))) >= 80 * (n + sizes[i] - k)}
        assert set(trie.probe(s, n, wanted)) == want


def test_lookup_finds_all_keys():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 5000).astype(np.uint64))
    look = ctw._Lookup(keys, keys.astype(float))
    asked = np.random.default_rng(3).choice(keys, 20000)
    assert (look(asked) == asked).all()


def test_probabilities_of_a_byte_sum_to_one():
    texts = [b"abracadabra", b"abc abd abe", b""]
    key, n = ctw._block_counts(texts, [True] * 3)
    context = key[7] >> np.uint64(8) << np.uint64(8)
    every = np.union1d(key, context + np.arange(256, dtype=np.uint64))
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, key)] = n
    nodes = []
    for bit in range(8):
        level = ctw._levels(every, counts, bit)[-1]
        nodes.append(((level.ids >> np.uint64(16) << np.uint64(8) | level.ids & np.uint64(255)).astype(np.int64), level.ones, level.all, level.weighted))
    top = ctw.Top(*(np.concatenate(x) for x in zip(*nodes, strict=True)))
    logs = ctw.code_lengths(every, counts, top)
    one = logs[np.searchsorted(every, context + np.arange(256, dtype=np.uint64))]
    assert abs((10.0**one).sum() - 1) < 1e-9


def test_matches_are_the_longest():
    windows = decontam.Windows([("i", "a b c d e f g h i j k l"), ("s", "q r")], 10)
    counts, found = decontam.search(["x a b c d e f g h i j k l y q r", "q", None, "b c d e f g h i j k"], windows)
    assert counts == [16, 1, 0, 10]
    assert found == {0: [("i", 0, 1, 12), ("s", 0, 14, 2)], 3: [("i", 1, 0, 10)]}
