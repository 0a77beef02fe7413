"""Operators over all documents against brute-force versions, over a small table with planted and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tamga.llm import queries as Q

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark, sf, tmp_path_factory):
    rng = random.Random(7)
    out = str(tmp_path_factory.mktemp("corpus"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    passage = " ".join(texts[0].split()[:90])
    base = texts[1].split() + texts[2].split()
    for k in range(60):  # a group of near copies, chains of growing distance
        words = base[:]
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"edit{k}x{rng.randrange(99)}"
        texts.append(" ".join(words))
    chain = base[:]
    for k in range(12):
        chain = chain[3:] + [f"link{k}a", f"link{k}b", f"link{k}c"]
        texts.append(" ".join(chain))
    texts += [f"{texts[i][:200]} {passage} {texts[i][200:]}" for i in range(3, 12)]
    texts += [None, "", " \n", "a", "a b c d", "A B c D", "a" * 3000, "ab" * 700, "x y " * 300, texts[5], texts[5], "é" * 450, "中文 " * 200, " ".join(texts[8:14])]
    data = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("block", F.lit(1.5))
    df.repartition(5, "text").write.parquet(f"{out}/documents.parquet")
    return out, data


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join(spark, rows):
    out, data = rows
    sets = [shingle_set(t) for _, t in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = sorted((str(d), len(s), str(least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(data, sets)))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in Q.op3_ngram_join(spark, out).collect())
    assert got == want


def test_ngram_join_tells_apart_many_blocks_of_a_partition(spark, monkeypatch):
    from tamga.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 1)  # a block for each row
    n = 5000
    from pyspark.sql import functions as F

    unlike = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)), " ")
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == n - 1, F.concat(F.lit("same "), F.lit("a b c d e f"))).when(F.col("id") == 7, F.lit("same a b c d e f")).otherwise(unlike).alias("text"))
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(docs).collect()}
    assert got == {i: 7 if i == n - 1 else i for i in range(n)}
    assert ngram_join.deduplicate(docs).count() == n - 1
    with pytest.raises(ValueError):
        ngram_join._row_of(1 << ngram_join.BLOCK_BITS)


@pytest.mark.parametrize("part_rows", [2, 7, 512])
def test_ngram_join_of_large_meetings(spark, monkeypatch, part_rows):
    """Many sets of several sizes share rare shingles without being alike, and some links lie between two of them."""
    from tamga.llm import ngram_join

    monkeypatch.setattr(ngram_join, "PART_ROWS", part_rows)
    rng = random.Random(part_rows)
    common = [f"c{i}" for i in range(12)]
    data = []
    for k in range(60):
        size = rng.choice([6, 8, 10, 14, 18, 30])
        own = [f"o{k}x{i}" for i in range(size)]
        if data and rng.random() < 0.4:  # like an earlier one but for the last word or two
            own = rng.choice(data)[1].split()[len(common) :]
            own = own[: len(own) - rng.choice([0, 1, 2])] + [f"n{k}"] * rng.choice([0, 1])
        data.append((k, " ".join(common + own)))
    sets = [shingle_set(t) for _, t in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(data))}


def test_deduplicate_keeps_one_of_each(spark, rows):
    from tamga.llm.ngram_join import deduplicate, near_components

    docs = spark.read.parquet(f"{rows[0]}/documents.parquet")
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == near_components(docs).select("component").distinct().count()
    assert deduplicate(docs.limit(0)).count() == 0


def test_repeats(spark, rows):
    out, data = rows
    texts = [(t or "").encode() for _, t in data]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = []
    for (d, _), t in zip(data, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((str(d), len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op9_repeated_spans(spark, out).collect())
    assert got == sorted(want)


def test_repeats_with_columns_in_files(spark, rows, monkeypatch):
    import numpy as np

    from tamga.llm import repeats

    rng = np.random.default_rng(1)
    matrix = rng.integers(97, 99, (6, repeats._COLUMNS), np.uint8)
    matrix[1] = matrix[0]
    matrix[2, 300:] = matrix[0, 300:]
    group = np.array([1, 1, 1, 1, 2, 2])
    plain = repeats.column_repeats(matrix, group)
    monkeypatch.setattr(repeats, "PART_BYTES", 10)
    assert (repeats.column_repeats(matrix, group) == plain).all()
    want = [[any(bytes(matrix[i, c : c + 400]) == bytes(matrix[j, c : c + 400]) for j in range(6) if j != i and group[i] == group[j]) for c in range(repeats._STARTS)] for i in range(6)]
    assert plain.tolist() == want


def ctw_log10(train, text, depth):
    """Context-tree weighting by dictionaries, a node for each context and partial byte."""
    nodes = {}

    def path(s, i):
        for bit in range(8):
            m = (1 << bit) | (s[i] >> (8 - bit))
            yield (s[i] >> (7 - bit)) & 1, [(bytes(s[i - d : i]), m) for d in range(depth + 1)]

    wrap = lambda t: b"\xfe" * depth + t + b"\xff"
    for t in train:
        s = wrap(t)
        for i in range(depth, len(s)):
            for bit, way in path(s, i):
                for n in way:
                    nodes.setdefault(n, [0, 0])[bit] += 1
    kids = {}
    for c, m in nodes:
        if c:
            kids.setdefault((c[1:], m), []).append((c, m))
    kt = lambda n: math.lgamma(nodes[n][0] + 0.5) + math.lgamma(nodes[n][1] + 0.5) - math.lgamma(sum(nodes[n]) + 1) - math.log(math.pi)
    weighted = {}
    for n in sorted(nodes, key=lambda n: -len(n[0])):
        if len(n[0]) == depth:
            weighted[n] = kt(n)
        else:
            a, b = math.log(0.5) + kt(n), math.log(0.5) + sum(weighted[k] for k in kids[n])
            weighted[n] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
    s, total = wrap(text), 0.0
    for i in range(depth, len(s)):
        for bit, way in path(s, i):
            p = None
            for n in reversed(way):
                if n in nodes:
                    own = (nodes[n][bit] + 0.5) / (sum(nodes[n]) + 1)
                    w = 1.0 if len(n[0]) == depth else math.exp(math.log(0.5) + kt(n) - weighted[n])
                    p = own if p is None else w * own + (1 - w) * p
            total += math.log10(0.5 if p is None else p)
    return total


def test_context_tree(spark, rows):
    from tamga.llm import ctw

    out, data = rows
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in data]
    tokens = [(t or "").encode().lower().split() for _, t in data]
    train = [w for w, h in zip(tokens, held) if not h]
    counts = Counter(w for ws in train for w in ws)
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    want = []
    for (d, t), h, ws in zip(data, held, tokens):
        c = [*(counts[w] for w in ws), len(train)]
        want.append((str(d), h, len(c), sum(x > 0 for x in c), total, round(sum(math.log10((x + 1) / (total + distinct + 1)) for x in c), 5)))
    got = Q.op2_context_tree(spark, out).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score <= 0 for r in got)
    few = [(d, t) for d, t in data if d is not None and d >= len(data) - 14][:10]
    small = spark.createDataFrame(few, "doc_id long, text string")
    learnt = [(t or "").encode() for d, t in few if not ctw.is_held_out(d)]
    scores = {r.doc_id: r.score for r in ctw.score_texts(small).collect()}
    for d, t in few:
        if len(t or "") < 1500:
            assert scores[d] == pytest.approx(ctw_log10(learnt, (t or "").encode(), ctw.DEPTH), rel=1e-4, abs=1e-4)


def test_empty_corpus(spark):
    from tamga.llm.ctw import score_texts
    from tamga.llm.repeats import remove_repeats

    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(none).count() == 0
    assert remove_repeats(none).count() == 0
