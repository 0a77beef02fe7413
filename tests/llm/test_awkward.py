"""All operators on tables whose columns have the names that operators use themselves, on empty tables, nulls, ties,
repeated rows, string ids and very long texts."""

import pytest
from pyspark.sql import functions as F

CLASHES = ["_key", "_rules", "_m0", "_text_", "_text", "_declared", "_suffix", "_host", "_segments", "_all", "_in", "_parts", "_bounds", "_k", "_row", "_more", "_0", "block", "row", "token", "bucket", "part", "_at", "_ll", "_log", "odd name"]
LONG = "tail " * 30_000
TEXTS = ["the small dog ran home", "the small dog ran home", None, "", LONG, "le petit chien rentre", "token=abcdef123456 the small dog"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"id{i // 2}" if i != 3 else None, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


def kept(got, docs, but=()):
    """The user's columns are there with their values, one row for each."""
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    for c in docs.columns:
        if c not in but:
            assert c in got.columns
            if c in CLASHES:
                assert {r[c] for r in rows} == {f"own {c}"}
    return rows


def test_bpe(docs):
    import public_tokenizers as P

    from tamga.llm.bpe import decode, encode

    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    for r in kept(decode(encode(docs, *args, offsets=True), *args), docs):
        assert bytes(r.decoded) == (r.text or "").encode()
    assert encode(docs.limit(0), *args).count() == 0


def test_secrets(docs):
    from tamga.llm.secrets import redact, scan_secrets

    got = scan_secrets(docs)
    assert sum(len(r.secrets) for r in kept(got, docs)) == 1
    kept(redact(got), docs)
    assert scan_secrets(docs.limit(0)).count() == 0


def test_decontamination(spark, docs, monkeypatch):
    from tamga.llm import decontam

    bench = spark.createDataFrame([("a", "small dog ran"), ("b", "rentre"), ("b", None)], "item_id string, text string")
    for size in (decontam.BENCHMARK_BYTES, 4):
        monkeypatch.setattr(decontam, "BENCHMARK_BYTES", size)
        rows = kept(decontam.benchmark_matches(docs, bench), docs)
        assert sorted(len(r.matches) for r in rows) == [0, 0, 0, 0, 1, 1, 1]
        assert {r.n_words for r in rows if r.text == LONG} == {30_000}
    assert decontam.benchmark_matches(docs.limit(0), bench).count() == 0


def test_language_id(docs):
    from tamga.llm.langid import fit_text_model, identify, identify_pages

    model = fit_text_model(docs, "lang", "text")
    rows = kept(identify(docs, model, declared="_declared", suffix="_suffix", host="_host"), docs)
    assert all(not r.accepted for r in rows if not r.text)
    pages = docs.select("*", F.lit("http://a.fr/1").alias("url"), F.col("text").alias("html"))
    kept(identify_pages(pages, model), docs)
    assert identify_pages(pages.limit(0), model).count() == 0


def test_fingerprints(spark, docs):
    from tamga.llm.imatch import edited_fingerprints, fingerprints

    rows = kept(fingerprints(docs), docs)
    assert len({r.fingerprint for r in rows if r.text == TEXTS[0]}) == 1
    assert fingerprints(docs.limit(0)).count() == 0 and edited_fingerprints(docs.limit(0)).count() == 0
    got = edited_fingerprints(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or "", r.n_chars) for r in got) == sorted((i is not None, i or "", len(t or "")) for i, t in docs.select("doc_id", "text").collect())


def test_next_rows_of_any_ids(spark, monkeypatch):
    from tamga.llm import imatch

    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    uneven = [*range(40), 10**15]
    for kind, ids in (("string", [f"k{i * 7 % 41}" for i in range(41)]), ("string", ["a"] * 30 + [None] * 9), ("long", uneven), ("double", [float(i) for i in uneven])):
        df = spark.createDataFrame([(i, f"t{n:03}") for n, i in enumerate(ids)], f"doc_id {kind}, text string")
        got = {(r.doc_id, r.text): r.next_text for r in imatch.with_next(df, "doc_id", ["text"], F.col("text")).collect()}
        ring = sorted(((i, f"t{n:03}") for n, i in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or type(ids[0])(), x[1]))
        assert got == {a: b[1] for a, b in zip(ring, ring[1:] + ring[:1])}


def test_ngram_join(docs):
    from tamga.llm.ngram_join import deduplicate, near_components

    got = near_components(docs).collect()
    assert len(got) == len(TEXTS)
    assert len({r.component for r in got}) == len(TEXTS) - 1
    out = deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS) - 1


def test_context_tree_and_repeats(docs):
    from tamga.llm.ctw import score_texts
    from tamga.llm.repeats import remove_repeats

    assert score_texts(docs).count() == len(TEXTS)
    gone = {len(r.kept): r.n_removed for r in remove_repeats(docs).collect()}
    assert gone[0] in (0, len(LONG))


def test_chat(spark):
    from tamga.llm.chat import CHUNK, format_chat, materialize, read_back

    kind = "conv_id string, turn long, role string, text string, key string, chunk string, place string"
    rows = [("a", CHUNK * k // 3, ("user", "assistant")[k % 2], f"<{k}>") for k in range(30)] + [("b", 5, "assistant", "x")] * 3 + [(None, None, None, None), (None, 1, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "k", "c", "p") for r in rows], kind)
    got = {r.conv_id: r for r in read_back(*format_chat(df)).collect()}
    assert got["a"].loss == "".join(f"<{k}>" for k in range(1, 30, 2)) and got["a"].n_turns == 30
    assert got["b"].loss == "xxx" and got[None].loss == LONG and got[None].n_turns == 2
    whole = materialize(*format_chat(df)).collect()
    assert sorted(len(r.text) for r in whole if r.conv_id == "a") == sorted(r.n_chars for r in format_chat(df)[1].where("conv_id = 'a'").collect())
    assert sum(len(r.text) for r in whole if r.conv_id is None) == got[None].formatted_chars
    assert read_back(*format_chat(df.limit(0))).count() == 0


def test_urls(spark, docs):
    from tamga.llm.urls import judge_urls

    urls = docs.select("*", F.concat(F.lit("http://h/"), "doc_id").alias("url"), F.col("doc_id").alias("page_id"))
    labels = spark.createDataFrame([("id0", 1), ("id0", 0), (None, 1)], "page_id string, bad int")
    kept(judge_urls(urls, labels, {}), docs)
    assert judge_urls(urls, None, {"h/": "block"}).where("verdict = 'block'").count() == len(TEXTS) - 1
    assert judge_urls(urls.limit(0), labels, {}).count() == 0


def test_pipeline_of_awkward_rows(spark, docs, tmp_path):
    import corpus_pipeline

    docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "petit chien")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert "le petit chien rentre" not in {r.text for r in got}
    assert all("abcdef123456" not in r.text for r in got)
    none = tmp_path / "none"
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0
