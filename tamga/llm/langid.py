"""Language identification by Bayesian fusion of evidence.

The posterior of a language is its text likelihood times the probability of the declared language given it, of the
address suffix given it, and its prior at the host. Text likelihoods are of byte trigrams (hashed to BINS), learnt
from labelled rows. Every label of any row is a language; of its distinct texts all are used when they are SAMPLE or
fewer, else SAMPLE of them in expectation, those of the least hashes; copies of a text count once there. The other tables are grouped counts over all rows, by the language that the text alone suggests:
declarations and suffixes with add-one smoothing, host priors smoothed towards their suffix's, those towards the
corpus's. `und`, a language of uniform bytes, stands for texts of no known language.

A row is accepted if its best language isn't `und` and has a posterior of ACCEPTED or more. Null and empty texts
have no trigrams and are rejected. A null declaration, suffix or host is a value of its own. Without labelled rows
only `und` exists and all is rejected. Repeated rows count each; an empty table gives an empty one. Of languages of
equal posterior the first by name is taken. Texts are scored whole, in slices. Other columns pass through, of any name;
columns called language, posterior or accepted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamga.llm.blocks import cut, free, renamed, slices, tidy
from tamga.llm.urls import host_of

BINS = 1 << 16
#: Distinct texts of each label that the text model is fitted on, about; a label with fewer is used whole.
SAMPLE = 4000
ACCEPTED = 0.5
#: How much evidence a host or suffix needs to outweigh the level above it.
WEIGHT = 10.0
#: Trigrams of one text overlap; this share of their log likelihood counts.
TEMPER = 0.5
#: Distinct hosts, suffixes or declarations that may be sent to all tasks; more are joined by shuffles.
SMALL = 100_000
UNKNOWN = "und"
SLICE_BYTES = 1 << 19


@dataclass
class TextModel:
    languages: list[str]
    tables: np.ndarray  # languages x (BINS + 1): log probabilities; the last bin is none


def _bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bins of all texts one after another, with two blanks before each, and how many each text has."""
    data = [(t or "").encode().lower() for t in texts]
    lengths = np.array([len(d) for d in data], np.int64)
    a = np.frombuffer(b"".join(b"  " + d for d in data), np.uint8).astype(np.uint32)
    if not lengths.sum():
        return np.zeros(0, np.int64), lengths
    h = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    begins = np.cumsum(lengths + 2) - lengths - 2
    at = np.arange(int(lengths.sum())) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    return h[at], lengths


def fit_text_model(docs: DataFrame, label: str, text: str, sample: int = SAMPLE) -> TextModel:
    labelled = docs.where(F.col(label).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("label", "text"))
    distinct = {r["label"]: r["n"] for r in labelled.groupBy("label", "hash").agg(F.lit(1).alias("one")).groupBy("label").agg(F.sum("one").alias("n")).collect()}  # a row for each label
    languages = sorted(distinct)
    space = 1 << 48
    limits = {one: int(space * sample / n) for one, n in distinct.items() if n > sample}
    if limits:
        limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("label")).cast("long"), F.lit(space))
        labelled = labelled.where(F.pmod("hash", F.lit(space)) < limit)
    rows = labelled.dropDuplicates(["label", "hash"]).select("label", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, "text"):
                labels, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for one in set(labels):
                    bins, _ = _bins([t for t, x in zip(texts, labels, strict=True) if x == one])
                    found.setdefault(one, np.zeros(BINS, np.int64))
                    found[one] += np.bincount(bins, minlength=BINS)
        for one, n in found.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([one] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["label", "bin", "n"])

    rows = rows.mapInArrow(count, "label string, bin int, n long")
    rows = rows.groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas()  # of the sample's trigrams
    tables = np.zeros((len(languages) + 1, BINS + 1))
    for i, one in enumerate(languages):
        own = rows[rows["label"] == one]
        counts = np.bincount(own["bin"], own["n"], BINS) + 0.05
        tables[i, :BINS] = np.log(counts / counts.sum())
    tables[-1, :BINS] = -np.log(BINS)
    return TextModel([*languages, UNKNOWN], tables)


def _scored(docs: DataFrame, model: TextModel, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep with _ll array<double>, the log likelihoods; null for texts without trigrams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BINS numbers
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "_ll array<double>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        tables = shared.value.tables
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, "_text_"):
                bins, lengths = _bins(part.column(part.num_columns - 1).to_pylist())
                full = np.flatnonzero(lengths)
                starts = (np.cumsum(lengths) - lengths)[full]
                sums = np.zeros((len(lengths), len(tables)))
                for i, table in enumerate(tables if len(full) else ()):
                    sums[full, i] = TEMPER * np.add.reduceat(table[bins], starts)
                ll = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * len(tables)), pa.array(sums.ravel()), mask=pa.array(lengths == 0))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ll], [*keep, "_ll"])
        tidy()

    return docs.select(*keep, F.col(text).alias("_text_")).mapInArrow(run, schema)


def _best(array: Column) -> Column:
    """The place of the largest value, from 0; the first of equals."""
    return F.array_position(array, F.array_max(array)).cast("int") - 1


def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's row of equal key, nulls alike. right goes to all tasks if it is small, else both are dealt."""
    (own,) = free([*left.columns, *right.columns], "_k")
    right = right.withColumnRenamed(key, own)
    if right.limit(SMALL + 1).count() <= SMALL:
        right = F.broadcast(right)
    return left.join(right, left[key].eqNullSafe(F.col(own)), "left").drop(own)


def identify(docs: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with language, posterior and accepted, which take the place of such columns."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("language", "posterior", "accepted")]
    n = len(model.languages)
    evidence = {"_declared": declared, "_suffix": suffix, "_host": host}
    carried, keep, restored = renamed(keep)
    docs = docs.select(*carried, F.col(text).alias("_text"), *((F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(k) for k, c in evidence.items()))
    text = "_text"
    counted = _scored(docs, model, text, list(evidence)).where("_ll is not null").select(*evidence, _best(F.col("_ll")).alias("_c")).groupBy(*evidence, "_c").count()
    counted = cut(counted)
    by = lambda key: [F.sum(F.when(F.col("_c") == i, F.col("count")).otherwise(0)).cast("double").alias(f"_{key}{i}") for i in range(n)]
    whole = counted.agg(*by("w")).first()  # a number for each language
    total = [float(x or 0) for x in whole]
    base = [(x + 1.0) / (sum(total) + n) for x in total]

    def table(key: str) -> DataFrame:
        counts = counted.groupBy(key).agg(*by("n"))
        return counts.select(key, F.array(*(f"_n{i}" for i in range(n))).alias(f"{key}_n"))

    suffixes = table("_suffix")
    smooth = lambda counts, above: F.zip_with(counts, above, lambda x, p: (x + F.lit(WEIGHT) * p) / (F.aggregate(counts, F.lit(0.0), lambda s, v: s + v) + F.lit(WEIGHT)))
    everywhere = F.array(*map(F.lit, base))
    suffixes = suffixes.select("_suffix", smooth(F.col("_suffix_n"), everywhere).alias("_suffix_p"), "_suffix_n")
    hosts = counted.groupBy("_host").agg(F.max_by("_suffix", "count").alias("_suffix"), *by("n")).select("_host", "_suffix", F.array(*(f"_n{i}" for i in range(n))).alias("_host_n"))
    hosts = joined(hosts, suffixes.drop("_suffix_n"), "_suffix").select("_host", smooth(F.col("_host_n"), F.coalesce("_suffix_p", everywhere)).alias("_host_p"))
    # P(value | language), add-one smoothed over the values seen and one unseen
    values = {k: counted.select(k).distinct().count() + 1 for k in ("_declared", "_suffix")}

    def given(key: str) -> DataFrame:
        likely = F.zip_with(f"{key}_n", F.array(*(F.lit(t + values[key]) for t in total)), lambda x, t: F.log((x + 1.0) / t))
        return table(key).select(key, likely.alias(f"{key}_l"))

    out = _scored(docs, model, text, [*keep, *evidence])
    out = joined(joined(joined(out, cut(hosts), "_host"), cut(given("_declared")), "_declared"), cut(given("_suffix")), "_suffix")
    zero = F.array_repeat(F.lit(0.0), n)
    logs = F.zip_with(F.coalesce("_ll", zero), F.transform(F.coalesce("_host_p", everywhere), lambda p: F.log(p)), lambda x, y: x + y)
    logs = F.zip_with(logs, F.zip_with(F.coalesce("_declared_l", zero), F.coalesce("_suffix_l", zero), lambda x, y: x + y), lambda x, y: x + y)
    out = out.withColumn("_log", logs)
    top = F.array_max("_log")
    out = out.withColumn("posterior", 1 / F.aggregate("_log", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    out = out.withColumn("language", F.element_at(F.array(*map(F.lit, model.languages)), _best(F.col("_log")) + 1))
    accepted = F.col("_ll").isNotNull() & (F.col("language") != UNKNOWN) & (F.col("posterior") >= ACCEPTED)
    return out.withColumn("accepted", accepted).select(*restored, "language", "posterior", "accepted")


def declared_markup(html: Column) -> Column:
    """The language that a page's <html> tag declares: its primary subtag, lower-cased; null if none."""
    tag = F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.when(tag != "", F.lower(tag))


def address_suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[#\w]{1,10};", " ")


def identify_pages(pages: DataFrame, model: TextModel, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """identify for web pages: all four kinds of evidence, from the page itself and its url."""
    keep = list(pages.columns) if keep is None else keep
    host = host_of(F.col(url))
    names = free(pages.columns, "_page_text", "_page_declared", "_page_suffix", "_page_host")
    evidence = (visible_text(F.col(html)), declared_markup(F.col(html)), address_suffix(host), host)
    full = pages.select("*", *(e.alias(name) for e, name in zip(evidence, names, strict=True)))
    return identify(full, model, *names, keep)
