"""Fingerprints, language identification and the pipeline."""

import hashlib
import re

import pytest

from tamga.llm import queries as Q


def test_next_rows_form_a_ring(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tamga.llm import imatch

    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    for ids in ([5], [1, 2, 3, 4, 5, 6, 7, 100, 101, 5000], [], [7, 7, None, 9]):
        df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
        got = {(r.doc_id, r.text): r.next_text for r in imatch.with_next(df, "doc_id", ["text"], F.col("text")).collect()}
        ring = sorted(((i, f"t{n}") for n, i in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert got == {a: b[1] for a, b in zip(ring, ring[1:] + ring[:1])}


def test_fingerprint(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "👍é x"), (10**6 + 3, "zz qq"), (10**6 + 4, "zz qq")], "doc_id long, text string")
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    data = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    got = {r.doc_id: r for r in Q.op4_fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    prints = {}
    for (i, t), (j, following) in zip(data, data[1:] + data[:1]):
        r = got[i]
        k = len(t) // 4
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == following:
            assert r.near_next == 1
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 3 * mean("near_next")


def test_fingerprint_with_few_lexicon_terms(spark):
    from pyspark.sql import functions as F

    from tamga.llm.imatch import lexicon, likeness, with_parts

    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    # of 5,000 documents a lexicon term needs 5: own words are outside, in0 to in12 and page7 inside
    texts = [own(i) for i in range(5000)]
    for k in range(13):
        texts[100 * k : 100 * k + 10] = [f"{t} in{k}" for t in texts[100 * k : 100 * k + 10]]
    texts[3000:3010] = [f"{t} page7" for t in texts[3000:3010]]
    slots = lexicon(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text").scalar()
    pairs = [("none", own(1), own(1).replace("own1x7 ", "")), ("one", f"{own(2)} page7", f"{own(2)} page7".replace("own2x7 ", "")), ("unrelated", f"{own(3)} page7", f"{own(4)} page7")]
    pairs += [(f"across{k}", own(5) + "".join(f" in{j}" for j in range(k)), own(5) + "".join(f" in{j}" for j in range(k - 1))) for k in range(1, 14)]
    pairs += [("tiny", "a", "b"), ("empty", "a", "")]
    df = spark.createDataFrame(pairs, "kind string, a string, b string")
    df = with_parts(with_parts(df, F.col("a"), slots, "pa"), F.col("b"), slots, "pb")
    got = {r.kind: r.near for r in df.select("kind", likeness("pa", "pb").alias("near")).collect()}
    assert got["none"] > 0.5 and got["one"] > 0.5 and got["unrelated"] < 0.3
    assert got["tiny"] < 1 and got["empty"] < 1
    assert all(got[f"across{k}"] >= 0.3 for k in range(1, 14)), got


def test_fingerprint_plan_sorts_longs_and_copies_no_lexicon(spark):
    from pyspark.sql import functions as F

    from tamga.llm import imatch

    docs = spark.range(9).select("id", F.concat(F.lit("a b c "), F.col("id")).alias("text"))
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = imatch.with_parts(docs, F.col("text"), imatch.lexicon(docs, "text").scalar(), "parts")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    # array_sort compares by an interpreted expression; a column of the lexicon would be written anew for each row
    assert "array_sort(" not in plan and "AS _slots" not in plan
    # every term is hashed once a seed; further levels look at the level before only, each once
    assert plan.count("filter(transform(") == imatch.SEEDS and plan.count("filter(_s") == imatch.SEEDS * (imatch.LEVELS - 1)


def test_language_id(spark, sf, tmp_path):
    rows = Q.op5_language_id(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    assert sum(r.language == r.lang for r in rows) > 0.95 * len(rows)
    assert sum(r.accepted for r in rows) > 0.98 * len(rows)


def test_language_id_of_held_out_and_awkward_rows(spark, sf):
    from pyspark.sql import functions as F

    from tamga.llm.langid import fit_text_model, identify

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_text_model(docs.where("doc_id % 2 = 0"), "lang", "text")
    held = docs.where("doc_id % 2 = 1").withColumn("declared", F.lit(None).cast("string")).withColumn("language", F.lit("clash"))
    got = identify(held, model, declared="declared", keep=["doc_id", "lang"]).collect()
    assert sum(r.language == r.lang for r in got) > 0.9 * len(got)
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (2, "", "en"), (3, "\x01\x02\x03\x04" * 50, None)], "doc_id long, text string, lang string")
    assert not any(r.accepted for r in identify(odd, model, declared="lang").collect())
    assert identify(odd.limit(0), model).count() == 0
    nothing = fit_text_model(odd.limit(0), "lang", "text")
    assert identify(odd, nothing).count() == 4


def test_language_id_knows_rare_labels(spark):
    import numpy as np

    from tamga.llm.langid import fit_text_model, identify

    common = [(i, f"the quick brown fox jumps over lazy dog number {i}", "en") for i in range(3000)]
    rare = [(10000 + i, f"žluťoučký kůň úpěl ďábelské ódy {i}", "cs") for i in range(3)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    model = fit_text_model(docs, "lang", "text", sample=40)
    assert model.languages == ["cs", "en", "und"]
    got = {r.doc_id: r for r in identify(docs, model, declared="lang", keep=["doc_id"]).collect()}
    assert all(got[i].language == "cs" and got[i].accepted for i, _, _ in rare)
    # copies neither crowd others out nor count twice
    copies = spark.createDataFrame(rare[:1] * 500, docs.schema)
    again = fit_text_model(docs.unionByName(copies), "lang", "text", sample=40)
    assert np.array_equal(again.tables, model.tables)


def test_page_language_id(spark, sf):
    got = Q.page_language_id(spark, sf).collect()
    assert sum(r.accepted for r in got) > 0.9 * len(got)


def test_registered_page_language_id_uses_all_evidence(spark, sf):
    from tamga.llm.langid import fit_text_model, identify_pages

    assert {"op5_language_id", "op5_page_language_id", "page_language_id"} <= set(Q.queries())
    tags = {r.page_id: re.search(r'<html lang="(\w+)"', r.html)[1] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.queries()["op5_page_language_id"](spark, sf).collect()
    assert len(got) == len(tags) and sum(r.language == tags[r.page_id] for r in got) > 0.95 * len(got)
    # the same text at hosts, under suffixes and with markup of two languages
    said = {"en": "taxi house and the garden of the old man with a dog taxi", "fr": "taxi maison et le jardin du vieil homme avec un chien taxi"}
    model = fit_text_model(spark.createDataFrame([(x, f"{t} {i}") for x, t in said.items() for i in range(20)], "lang string, text string"), "lang", "text")
    page = lambda x, t, host, tag: (x, f"http://{host}/1", f"<html{f' lang={tag}' if tag else ''}><p>{t}</p></html>")
    rows = [page(0, said[x], f"www{k}.{z}", x) for x, z in (("en", "uk"), ("fr", "fr")) for k in range(20)]
    rows += [page(1, "taxi", "www1.uk", None), page(2, "taxi", "www1.fr", None), page(3, "taxi", "new.uk", None), page(4, "taxi", "new2.fr", None), page(5, "taxi", "x.org", "en"), page(6, "taxi", "x.org", "fr")]
    found = {r.page_id: r.language for r in identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model, keep=["page_id"]).collect()}
    assert [found[i] for i in range(1, 7)] == ["en", "fr"] * 3


def test_markup_after_long_attributes(spark):
    from tamga.llm.langid import declared_markup

    rows = [(f'<html data-x="{"y" * 5000}" lang="de">',), ('<html><p lang="de">',)]
    assert [r[0] for r in spark.createDataFrame(rows, "html string").select(declared_markup("html")).collect()] == ["de", None]


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tamga.llm.langid import fit_text_model, identify
    from tamga.llm.ngram_join import near_components
    from tests.llm.test_text_ops import base_secrets, windows, words_of

    final = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    accepted = {r.doc_id for r in identify(docs, fit_text_model(docs, "lang", "text"), declared="lang", host="source", keep=["doc_id"]).where("accepted").collect()}
    first = docs.where(docs.doc_id.isin(list(accepted)))
    groups = {}
    for r in near_components(first).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    kept = {min(x) for x in groups.values()}
    bench = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in windows(words_of(r.text))}
    clean = set()
    texts = {r.doc_id: r.text for r in first.collect()}
    for i in kept:
        w = words_of(texts[i])
        if not any(tuple(w[p : p + n]) in bench for n in {len(b) for b in bench} for p in range(len(w) - n + 1)):
            clean.add(i)
    assert {r.doc_id for r in final} == clean
    for r in final:
        spans = base_secrets(texts[r.doc_id])
        assert (r.text == texts[r.doc_id]) == (not spans)
        for a, _, _, b in spans:
            assert texts[r.doc_id][a:b] not in r.text
        assert len(r.ids) > 0 or not r.text
    assert [n for n, _ in corpus_pipeline.STAGES] and re.match("language", corpus_pipeline.STAGES[0][0])
