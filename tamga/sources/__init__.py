"""Sources and sinks: whole texts, their lines, word lists, alias tables, golden vectors, tab-separated reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamga import functions as fn
from tamga.operators import extract_words, first_seen

#: All line ends of Unicode text, CRLF as one.
LINE_END = "\\r\\n|[\\n\\r\\u000B\\f\\u001C-\\u001E\\u0085\\u2028\\u2029]"


def inline(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a row for each file. Bytes that aren't UTF-8 fail the query."""
    files = spark.read.format("binaryFile").load(path)
    text = F.expr("validate_utf8(cast(content as string))")
    return files.select("path", text.alias("text"))


def lines(text: Column) -> Column:
    """The lines of a text; an end of line after the last one starts no other."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, number from 1, line."""
    return df.select(*(keep or []), F.posexplode_outer(lines(F.col(text))).alias("number", "line")).where("number is not null").withColumn("number", F.col("number") + 1)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word, n, first: the distinct words of text files and where (path, pos) each is seen first."""
    return first_seen(extract_words(read_texts(spark, path), keep=["path"]), ["path", "pos"])


def read_alias_table(spark: SparkSession, path: str) -> DataFrame:
    """id, words array<string>, expected, units array<string>: rows of tab-separated id, aliases and expected units;
    # starts a comment. units are those expected, cleaned up."""
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="id string, aliases string, expected string").where("expected is not null")
    return raw.select("id", F.transform(F.split("aliases", r"\s*\bspace\b\s*"), fn.spell_aliases).alias("words"), "expected", fn.expected_units(F.col("expected")).alias("units"))


TRACE_FILE = f"locale string, schema string, rules array<string>, vectors array<struct<id:string,witness_rule:string,input_aliases:string,input_cps:array<int>,expected:{fn.TRACE}>>"
GOLDEN = "type string, id string, input_cps array<int>, shape array<string>, normalized_cps array<int>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """id, witness_rule, word, expected: the vectors of a file of traces; expected is as functions.trace gives it."""
    files = spark.read.schema(TRACE_FILE).option("multiLine", True).json(path)
    one = files.select(F.explode("vectors").alias("v")).select("v.id", "v.witness_rule", "v.input_cps", "v.expected")
    return one.select("id", "witness_rule", fn.from_code_points(F.col("input_cps")).alias("word"), "expected")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """id, word, shape, normalized: the vectors of JSON lines; other lines, as the manifest, are left out."""
    rows = spark.read.schema(GOLDEN).json(path).where("input_cps is not null")
    return rows.select("id", fn.from_code_points(F.col("input_cps")).alias("word"), "shape", fn.from_code_points(F.col("normalized_cps")).alias("normalized"))


def golden(words: DataFrame, key: str = "word") -> DataFrame:
    """Vectors of words: type, id, input_cps, shape, normalized_cps."""
    cps = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    done = words.select(F.col(key).cast("string").alias("id"), "word", fn.shape(F.col("word")).alias("shape"), fn.normalize(F.col("word"), "lenient").alias("normalized"))
    return done.select(F.lit("vector").alias("type"), "id", cps(F.col("word")).alias("input_cps"), "shape", cps(F.col("normalized")).alias("normalized_cps"))


def write_golden(words: DataFrame, path: str, key: str = "word") -> None:
    """The vectors of words as JSON lines, with a manifest line."""
    spark = words.sparkSession
    manifest = spark.range(1).select(F.to_json(F.struct(F.lit("manifest").alias("type"), fn.locale().alias("locale"), fn.canonical_version().alias("canonical_version"))).alias("value"))
    manifest.unionByName(golden(words, key).select(F.to_json(F.struct("*")).alias("value"))).write.text(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(column).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Tab-separated, with a header."""
    df.write.option("sep", "\t").option("header", True).csv(path)
