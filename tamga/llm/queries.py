"""The registered queries of this subpackage: thin views of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids of the multilingual vocabulary and back."""
    import public_tokenizers as tokenizers

    from tamga.llm.bpe import encode

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    got = encode(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(listed).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a context tree over bytes and by a word unigram."""
    from tamga.llm.ctw import score_texts

    return score_texts(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates that each document is in."""
    from tamga.llm.ngram_join import near_components

    return near_components(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without what repeats over 400 bytes."""
    from tamga.llm.repeats import remove_repeats

    got = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and of the next document."""
    from tamga.llm.imatch import edited_fingerprints

    got = edited_fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by its text and, where a page's url ends in its number, that page's markup, address
    suffix and host; else its source stands for the host. lang is no evidence: it labels the texts that the text model
    is fitted on, those that aren't held out, so held-out rows tell the accuracy."""
    from tamga.llm import langid
    from tamga.llm.ctw import FOLDS, HELD_OUT

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", held.alias("held_out"))
    pages = _read(spark, sf_dir, "pages").select(_number(F.col("url")).alias("doc_id"), F.struct("url", langid.declared_markup(F.col("html")).alias("declared")).alias("page"))
    pages = pages.where("doc_id is not null").groupBy("doc_id").agg(F.min("page").alias("page"))
    host = F.when(F.col("page").isNotNull(), langid.host_of(F.col("page.url")))
    known = langid.joined(docs, pages, "doc_id").select("doc_id", "text", "lang", "held_out", F.col("page.declared").alias("declared"), langid.address_suffix(host).alias("suffix"), F.coalesce(host, "source").alias("host"))
    model = langid.fit_text_model(docs.where(~F.col("held_out")), "lang", "text")
    return langid.identify(known, model, "text", "declared", "suffix", "host", keep=["doc_id", "lang", "held_out"])


def _number(url: Column) -> Column:
    """The number that a url ends in: the document's that the page was made from."""
    number = F.regexp_extract(url, r"/(\d{1,18})(?:\.html)?/?(?:[?#].*)?$", 1)
    return F.when(number != "", number.cast("long"))


def op5_page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language, by its text, its markup, its address suffix and its host."""
    from tamga.llm.langid import fit_text_model, identify_pages

    model = fit_text_model(_read(spark, sf_dir, "documents").select("lang", "text"), "lang", "text")
    return identify_pages(_read(spark, sf_dir, "pages"), model, keep=["page_id"])


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_page_language_id under its first name."""
    return op5_page_language_id(spark, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every text."""
    from tamga.llm.secrets import BASE, scan_secrets

    got = scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *(count(r.kind) for r in BASE), _sha(joined(base)).alias("base_sha256"), joined("secrets").alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document holds of the benchmark."""
    from tamga.llm.decontam import benchmark_matches, hit_words

    got = benchmark_matches(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return got.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size(items).cast("long").alias("n_items"), _sha(F.array_join(items, ",")).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of the template's own control strings, formatted and read back."""
    from tamga.llm.chat import format_chat, read_back

    own = spark.sql("select cast(-7 as bigint) as conv_id, cast(turn as bigint) as turn, role, '</s>[INST] ok [/INST]' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    got = read_back(*format_chat(turns))
    return got.select("conv_id", "n_turns", _sha(F.col("turns")).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), _sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, else by its template; a url's last number is the labelled document's."""
    from tamga.llm.urls import judge_urls

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    marks = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("_doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    labels = pages.select("page_id", _number(F.col("url")).alias("_doc")).join(marks, "_doc").select("page_id", "bad")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    return judge_urls(pages, labels, rules).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_context_tree, op3_ngram_join, op4_fingerprint, op5_language_id, op5_page_language_id, op6_secret_scan, op7_decontamination, op8_chat_format, op9_repeated_spans, op10_url_filter, page_language_id, pipeline)}


def oracle_sql() -> dict[str, str]:
    from tamga.llm import sql

    return sql.oracle()
