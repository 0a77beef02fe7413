"""Corpus operators: words out of texts, shapes and canonical spellings, joins, groups and sets of words by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamga import functions as fn
from tamga import tables


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many partitions as there are cores when its scan has fewer than twice as many: a small file is
    often one row group, so one task, whatever the number of splits. A large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < 2 * cores else df


def extract_words(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, pos, word: a row for each word of each text, in order. All native."""
    keep = [] if keep is None else keep
    return df.where(F.col(text).rlike(f"[{tables.WORD_CLASS}]")).select(*keep, F.posexplode(fn.words_in(F.col(text))).alias("pos", "word"))


def distinct_words(words: DataFrame, word: str = "word") -> DataFrame:
    """word, n: combined on the map side, so that repeated words aren't shuffled."""
    return words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def with_result(df: DataFrame, word: str, name: str, f, dedupe: bool = True) -> DataFrame:
    """df with f(word). With dedupe f runs once for each distinct word and is joined back; Spark sends the result to
    all tasks when it is small and splits skewed words when it isn't."""
    if not dedupe:
        return df.withColumn(name, f(F.col(word)))
    once = df.select(F.col(word).alias("_word")).where(F.col("_word").isNotNull()).distinct().withColumn(name, f(F.col("_word")))
    return df.join(once, F.col(word) == F.col("_word"), "left").drop("_word")


def with_shape(df: DataFrame, word: str = "word", name: str = "shape", mode: str = "strict", dedupe: bool = True) -> DataFrame:
    return with_result(df, word, name, lambda c: fn.shape_str(c, mode), dedupe)


def with_normalized(df: DataFrame, word: str = "word", name: str = "normalized", mode: str = "strict", dedupe: bool = True, version: str | None = None) -> DataFrame:
    """version: a column for the canonical version, by which stored keys are known to be current."""
    done = with_result(df, word, name, lambda c: fn.normalize(c, mode), dedupe)
    return done.withColumn(version, fn.canonical_version()) if version else done


def normalize_texts(df: DataFrame, key: str, text: str = "text", name: str = "normalized", mode: str = "strict") -> DataFrame:
    """df with its texts normalised. key tells rows apart. Each distinct word of all texts is normalised once; texts are
    put together again from their other characters and what comes back. Null texts stay null."""
    if mode == "permissive":
        raise ValueError("mode must be strict or lenient")
    words = extract_words(df.select(F.col(key).alias("key"), F.col(text).alias("text")), keep=["key"])
    changed = distinct_words(words).select("word", fn.normalize(F.col("word"), mode).alias("new")).where("new <> word")
    # only words that change come back
    back = words.join(changed, "word").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("_back"))
    joined = df.join(back.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left")
    old, gaps = fn.words_in(F.col(text)), F.split(F.col(text), f"[{tables.WORD_CLASS}]+", -1)
    pieces = F.arrays_zip(F.slice(gaps, 1, F.size(old)).alias("gap"), old.alias("word"))
    done = joined.withColumn("_pieces", F.when(F.col("_back").isNotNull(), pieces))
    # what lies between changed words, each changed word with the gap before it, and the rest
    between = lambda start, end: F.array_join(F.transform(F.slice(F.col("_pieces"), start + 1, F.greatest(end - start, F.lit(0))), lambda p: F.concat(p["gap"], p["word"])), "")
    after = lambda i: F.when(i > 0, F.get(F.col("_back"), i - 1)["pos"] + 1).otherwise(0)
    parts = F.transform("_back", lambda x, i: F.concat(between(after(i), x["pos"]), F.get(F.col("_pieces"), x["pos"])["gap"], x["new"]))
    tail = F.concat(between(after(F.size("_back")), F.size("_pieces")), F.element_at(gaps, -1))
    done = done.withColumn(name, F.when(F.col("_back").isNull(), F.col(text)).otherwise(F.concat(F.array_join(parts, ""), tail)))
    return done.drop("_key", "_back", "_pieces")


def shape_groups(shaped: DataFrame) -> DataFrame:
    """shape, n_words, n, first: distinct words of a shape, their occurrences and the least of them. From word, n, shape."""
    return shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n"), F.min("word").alias("first"))


def representatives(shaped: DataFrame) -> DataFrame:
    return shaped.groupBy("shape").agg(F.min("word").alias("word"))


def dedup_by_shape(shaped: DataFrame) -> DataFrame:
    """The row whose word is the least of its shape, of distinct words."""
    least = F.min_by(F.struct(*(c for c in shaped.columns if c != "shape")), "word")
    return shaped.groupBy("shape").agg(least.alias("_row")).select("shape", "_row.*").select(*shaped.columns)


def shape_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """shape, word, other: words of two distinct lists that look the same."""
    return left.select("shape", "word").join(right.select("shape", F.col("word").alias("other")), "shape")


def shape_semi(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("shape"), "shape", "left_semi")


def shape_anti(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("shape"), "shape", "left_anti")


def compare_shapes(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Two array columns of units compared: a row of totals (total, same and its percentage, to two digits), and the
    kinds of difference by how often they occur."""
    differ = F.col(a) != F.col(b)
    total = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~differ).alias("same"))
    total = total.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("same") / F.col("total"), 2)).otherwise(100.0))
    parts = df.where(differ).withColumn("_m", fn.middle(F.col(a), F.col(b)))
    kinds = parts.groupBy(F.col("_m.a").alias("a_part"), F.col("_m.b").alias("b_part")).agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("example"))
    return total, kinds


def canonicity(shaped: DataFrame, normalized: str = "normalized") -> DataFrame:
    """shape, n_spellings of shapes whose words have more than one canonical spelling; there are none."""
    return shaped.groupBy("shape").agg(F.count_distinct(normalized).alias("n_spellings")).where("n_spellings > 1")


def _starts(shapes: DataFrame) -> DataFrame:
    """longer, shape: the starts of each shape, itself left out."""
    start = lambda n: F.call_function("substring_index", F.col("shape"), F.lit("+"), n)
    listed = F.transform(F.sequence(F.lit(1), F.size(F.split("shape", r"\+")) - 1), start)
    return shapes.where(F.contains("shape", F.lit("+"))).select(F.col("shape").alias("longer"), F.explode(listed).alias("shape"))


def prefix_pairs(shaped: DataFrame) -> DataFrame:
    """shape, longer: pairs of shapes of which one starts the other, by an equi-join of all starts."""
    shapes = shaped.select("shape").distinct()
    return _starts(shapes).join(shapes, "shape").select("shape", "longer")


def prefix_counts(shaped: DataFrame) -> DataFrame:
    """shape, n: how many other shapes start with each that any does; starts are counted before they meet shapes."""
    shapes = shaped.select("shape").distinct()
    return _starts(shapes).groupBy("shape").agg(F.count(F.lit(1)).alias("n")).join(shapes, "shape", "left_semi")


def prefix_stability(spelt: DataFrame, spelling: str = "normalized") -> DataFrame:
    """Of spelt (shape, spelling), one row for each shape: pairs of shapes of which one starts the other, whose
    spellings agree up to the letters of the unit where the shorter ends and no further back.

    shape, longer, spelling, longer_spelling, shared (characters in common), stable: whether at most the last letter of
    the shorter, with its selector, differs.
    """
    one = spelt.select("shape", F.col(spelling).alias("spelling"))
    pairs = prefix_pairs(one).join(one, "shape").join(one.toDF("longer", "longer_spelling"), "longer")
    a, b = F.split("spelling", ""), F.split("longer_spelling", "")
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    last = F.length(F.regexp_extract("spelling", f"[^{fn.FVS_CLASS}][{fn.FVS_CLASS}]*$", 0))
    return pairs.select("shape", "longer", "spelling", "longer_spelling", shared.alias("shared"), (shared >= F.length("spelling") - last).alias("stable"))


def first_seen(words: DataFrame, order: list[str], word: str = "word") -> DataFrame:
    """word, n, first struct<order>: distinct words with where each is seen first; sort by first for that order."""
    return words.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))


def words_union(*corpora: DataFrame) -> DataFrame:
    """word, in_0, in_1, ...: the distinct words of all corpora and which of them have each; one shuffle."""
    marked = [c.select("word", *(F.lit(i == k).alias(f"in_{k}") for k in range(len(corpora)))) for i, c in enumerate(corpora)]
    every = marked[0]
    for one in marked[1:]:
        every = every.unionByName(one)
    return every.groupBy("word").agg(*(F.max(f"in_{k}").alias(f"in_{k}") for k in range(len(corpora))))


def words_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("word").intersect(b.select("word"))


def words_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct words of a that b has not."""
    return a.select("word").subtract(b.select("word"))


def token_rows(words: DataFrame, word: str = "word", keep: list[str] | None = None) -> DataFrame:
    """word, keep, i, ch, kind, fvs, alias, position: a row for each token. All native."""
    base = ["word", *(keep or [])]
    listed = words.select(F.col(word).alias("word"), *(keep or []), fn.tokens(F.col(word)).alias("t"))
    placed = listed.select(*base, F.arrays_zip("t", fn.token_positions(F.col("t")).alias("p")).alias("z"))
    # outer: else a filter on the tokens' number is inferred, moved below the caller's aggregation and done for each word
    rows = placed.select(*base, F.posexplode_outer("z").alias("i", "z")).where("i is not null").select(*base, "i", "z.t.ch", "z.t.kind", "z.t.fvs", F.col("z.p").alias("position"))
    return rows.join(F.broadcast(letters(words.sparkSession).select("ch", "alias")), "ch", "left")  # 35 rows


def letters(spark: SparkSession) -> DataFrame:
    c = tables.catalogue()
    gender = lambda a: "masculine" if a in c.masculine else "feminine" if a in c.feminine else "neuter" if a in c.neuter else "consonant"
    return spark.createDataFrame([(ch, a, gender(a)) for ch, a in c.alias.items()], "ch string, alias string, category string")


def variants(spark: SparkSession) -> DataFrame:
    rows = [(a, p, f, "+".join(u), d, "/".join(x)) for a, p, f, u, d, x in tables.catalogue().rows]
    return spark.createDataFrame(rows, "alias string, position string, fvs int, form string, is_default boolean, conditions string")


def reverse_table(spark: SparkSession) -> DataFrame:
    rows = [(p, "+".join(u), a, text) for (p, u), (a, text) in tables.catalogue().encode.items()]
    return spark.createDataFrame(rows, "position string, form string, alias string, spelling string")


def inventory(spark: SparkSession) -> DataFrame:
    """unit, position: all known units, with a null position, and those that have positions of their own."""
    c = tables.catalogue()
    return spark.createDataFrame([*((u, None) for u in sorted(c.known)), *sorted(c.positioned)], "unit string, position string")


def rule_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tables.RULES, 1)), "place int, rule string")


def random_words(spark: SparkSession, n: int, longest: int, seed: int = 0) -> DataFrame:
    """id, word: words of 0 to longest characters over all letters and controls; the same for the same seed."""
    alphabet = [*tables.catalogue().alias, *tables.FVS.values(), tables.MVS, tables.NNBSP, tables.NIRUGU, tables.ZWJ, tables.ZWNJ]
    pick = lambda k: F.element_at(F.array(*map(F.lit, alphabet)), (F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(len(alphabet))) + 1).cast("int"))
    length = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(longest + 1)).cast("int")
    places = F.slice(F.array(*map(F.lit, range(longest))), F.lit(1), length)
    return spark.range(n).select("id", F.array_join(F.transform(places, pick), "").alias("word"))


def literal_units(text: Column) -> Column:
    return F.split(text, r"\+")
