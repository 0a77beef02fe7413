"""The registered queries: each takes (spark, sf_dir) and returns a frame of scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamga import functions as fn
from tamga import operators as op
from tamga import sources, streaming, tables, views
from tamga.operators import battery
from tamga.plans import controls, sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mongolian(text: Column) -> Column:
    """Latin letters as Mongolian ones."""
    return F.translate(F.lower(text), sql.LATIN, sql.MONGOLIAN)


def found(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    return op.extract_words(texts(spark, sf_dir, table, key), keep=[key])


def texts(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """key, text: texts in Mongolian letters."""
    return op.spread(read(spark, sf_dir, table).select(key, "text")).select(key, mongolian(F.col("text")).alias("text"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.distinct_words(found(spark, sf_dir))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).withColumn("shape", fn.shape_str(F.col("word")))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with controls, made from order keys; those with an x are none."""
    number = (F.col("o_orderkey") * 48271 + 11) % 2147483647
    return read(spark, sf_dir, "orders").select(F.translate(F.lower(F.conv(number.cast("string"), 10, 36)), sql.DIGITS, sql.KEYED).alias("word")).distinct()


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).where(~F.contains(F.col("word"), F.lit("x")))


def words_extract(spark, d):
    return found(spark, d)


def words_distinct_topk(spark, d):
    return counted(spark, d).orderBy(F.desc("n"), "word").limit(100)


def letter_positions(spark, d):
    """How many letters of the corpus are isolated, initial, medial, final."""
    return op.token_rows(counted(spark, d), keep=["n"]).groupBy("alias", "position").agg(F.sum("n").alias("n"))


def classify_chars(spark, d):
    chars = keyed(spark, d).select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.select("ch", "n", fn.is_mongolian_word_char(F.col("ch")).alias("is_word_char"), fn.is_mongolian_letter(F.col("ch")).alias("is_letter"))


def check_word_chars(spark, d):
    bad = keyed(spark, d).withColumn("e", fn.check_word_chars(F.col("word"))).where("e is not null")
    return bad.select("word", F.col("e.index").cast("long").alias("error_index"), F.col("e.ch").alias("error_char"))


def token_positions(spark, d):
    return op.token_rows(valid(spark, d)).groupBy("ch", "kind", "position").agg(F.count(F.lit(1)).alias("n"))


def code_points(spark, d):
    return keyed(spark, d).select("word", fn.code_points(F.col("word")).alias("code_points"))


def default_forms(spark, d):
    base = op.variants(spark).where("is_default").select("alias", "position", "form")
    return op.token_rows(counted(spark, d)).join(F.broadcast(base), ["alias", "position"]).groupBy("alias", "position", "form").agg(F.count(F.lit(1)).alias("n"))


def _details(words: DataFrame) -> DataFrame:
    rows = words.select("word", F.posexplode(fn.shape_detailed(F.col("word"))).alias("i", "t"))
    return rows.select("word", "i", "t.alias", "t.position", F.coalesce("t.condition", F.lit("")).alias("condition"), F.array_join("t.written", "+").alias("form"))


def rule_conditions(spark, d):
    return _details(counted(spark, d)).groupBy("alias", "position", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("n_words"))


def shape_detailed(spark, d):
    return _details(counted(spark, d))


def rule_effects(spark, d):
    """How often each rule gives or takes a condition, over words with controls."""
    steps = valid(spark, d).select(F.explode(fn.trace(F.col("word"))["transitions"]).alias("s")).select("s.rule", F.explode("s.changes").alias("c"))
    return steps.groupBy("rule", F.coalesce("c.before", F.lit("")).alias("before"), F.coalesce("c.after", F.lit("")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def shape_raw(spark, d):
    return counted(spark, d).select("word", fn.shape_raw_str(F.col("word")).alias("raw"))


def shape_str(spark, d):
    return shaped(spark, d)


def shape_controls(spark, d):
    """Shapes of words with controls, errors as columns."""
    got = keyed(spark, d).withColumn("r", fn.shape_str(F.col("word"), "permissive"))
    return got.select("word", F.col("r.value").alias("shape"), F.col("r.error_class").alias("error_class"), F.col("r.error_index").alias("error_index"))


def _sample(spark, words: sql.Listed) -> DataFrame:
    """Words that are all combinations of some parts."""
    parts = F.concat(*(F.element_at(F.array(*map(F.lit, part)), (F.floor(F.col("id") / step) % len(part) + 1).cast("int")) for part, step in words.steps()))
    return op.spread(spark.range(words.size())).select(parts.alias("word"))


def control_pairs(spark, d):
    """Conditions and shape of each two letters with each control or none between them, alone and after two others."""
    return _conditions(_sample(spark, sql.pairs()))


def particle_words(spark, d):
    """Conditions and shape of each particle, with what may come before and after it."""
    return _conditions(_sample(spark, sql.particles()))


def _conditions(words: DataFrame) -> DataFrame:
    got = words.distinct().withColumn("t", fn.trace(F.col("word")))
    told = F.array_join(F.transform("t.final_conditions", lambda c: F.coalesce(c, F.lit("-"))), " ")
    return got.select("word", told.alias("conditions"), F.array_join("t.shape", "+").alias("shape"))


def shape_groups(spark, d):
    return op.shape_groups(shaped(spark, d))


def shape_groups_topk(spark, d):
    return op.shape_groups(shaped(spark, d)).orderBy(F.desc("n_words"), F.desc("n"), "shape").limit(50)


def representatives(spark, d):
    return op.representatives(shaped(spark, d))


def dedup_by_shape(spark, d):
    return op.dedup_by_shape(shaped(spark, d))


def docs_by_shape(spark, d):
    """Words and distinct shapes of each document; each distinct word is shaped once."""
    return op.with_shape(found(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_distinct("shape").alias("n_shapes"))


def _two(spark, d):
    other = op.distinct_words(found(spark, d, "benchmark", "item_id")).withColumn("shape", fn.shape_str(F.col("word")))
    return shaped(spark, d).select("word", "shape"), other.select("word", "shape")


def same_shape_join(spark, d):
    return op.shape_join(*_two(spark, d)).where("word <> other")


def shape_semi(spark, d):
    return op.shape_semi(*_two(spark, d)).select("word", "shape")


def shape_anti(spark, d):
    return op.shape_anti(*reversed(_two(spark, d))).select("word", "shape")


def _compared(spark, d):
    units = counted(spark, d).select("word", fn.shape_raw(F.col("word")).alias("raw"), fn.shape(F.col("word")).alias("shape"))
    return op.compare_shapes(units, "raw", "shape")


def compare_raw_and_shape(spark, d):
    return _compared(spark, d)[0]


def compare_diff_groups(spark, d):
    return _compared(spark, d)[1].orderBy(F.desc("n"), "a_part", "b_part")


def prefix_pairs(spark, d):
    return op.prefix_counts(shaped(spark, d)).groupBy(F.length("shape").cast("long").alias("length")).agg(F.sum("n").alias("n"))


def prefix_stability(spark, d):
    """Of shapes of which one starts another, how many pairs are spelt alike up to where the shorter ends."""
    spelt = op.representatives(shaped(spark, d)).withColumn("normalized", fn.normalize(F.col("word"), "lenient"))
    return op.prefix_stability(spelt).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("stable")).cast("int").alias("n_unstable"))


def words_first_seen(spark, d):
    """Distinct words by where each is seen first."""
    seen = op.first_seen(found(spark, d), ["doc_id", "pos"])
    return seen.select("word", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos")).orderBy("doc_id", "pos").limit(500)


def corpora_union_except(spark, d):
    """Words of documents and of the benchmark: how many are in either, both, one only."""
    a, b = found(spark, d), found(spark, d, "benchmark", "item_id")
    either = op.words_union(a, b).agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("in_0") & F.col("in_1")).alias("n_both"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # single rows
    return either.crossJoin(count(op.words_intersect(a, b), "n_intersect")).crossJoin(count(op.words_except(a, b), "n_only_documents")).crossJoin(count(op.words_except(b, a), "n_only_benchmark"))


def versions(spark, d):
    """Canonical spellings with the version that made them."""
    words = counted(spark, d).orderBy(F.desc("n"), "word").limit(50).select("word")
    return op.with_normalized(words, mode="lenient", version="canonical_version").select("word", "canonical_version", fn.locale().alias("locale"))


def normalize(spark, d):
    return counted(spark, d).select("word", fn.normalize(F.col("word"), "lenient").alias("normalized"))


def normalize_controls(spark, d):
    got = keyed(spark, d).withColumn("r", fn.normalize(F.col("word"), "permissive"))
    return got.select("word", F.col("r.value").alias("normalized"), F.col("r.error_class").alias("error_class"), F.col("r.error_message").alias("error_message"))


def canonicity_check(spark, d):
    """Words of one shape have one spelling, which has that shape and is its own spelling."""
    words = shaped(spark, d).withColumn("normalized", fn.normalize(F.col("word"), "lenient"))
    again = words.withColumn("shape_again", fn.shape_str(F.col("normalized"))).withColumn("again", fn.normalize(F.col("normalized"), "lenient"))
    wrong = again.select(F.lit(1).alias("w")).where((F.col("shape") != F.col("shape_again")) | (F.col("normalized") != F.col("again")))
    split = op.canonicity(words).select(F.lit(1).alias("w"))
    total = words.select(F.lit(0).alias("w"))
    return total.unionByName(wrong).unionByName(split).agg(F.sum("w").cast("int").alias("n_violations"), F.count_if(F.col("w") == 0).alias("n_words"))


def round_trip(spark, d):
    """Words with controls keep their shape when normalised, where they have a canonical spelling."""
    words = valid(spark, d).withColumn("s", fn.shape_str(F.col("word"))).withColumn("n", fn.normalize(F.col("word"), "lenient"))
    words = words.withColumn("t", fn.shape_str(F.col("n"))).withColumn("m", fn.normalize(F.col("n"), "lenient"))
    return words.agg(F.count_if((F.col("s") != F.col("t")) | (F.col("n") != F.col("m"))).cast("int").alias("n_violations"), F.count(F.lit(1)).alias("n_words"))


def normalize_text_shapes(spark, d):
    """Normalised texts have the same shapes and the same other characters."""
    done = op.normalize_texts(texts(spark, d).withColumnRenamed("text", "a"), "doc_id", "a", "b", "lenient")
    rest = lambda c: F.regexp_replace(c, f"[{tables.WORD_CLASS}]+", "_")
    sides = done.select("doc_id", F.explode(F.arrays_zip(fn.words_in(F.col("a")).alias("a"), fn.words_in(F.col("b")).alias("b"))).alias("w")).select("doc_id", "w.a", "w.b")
    pairs = sides.select("a", "b").distinct()
    wrong = pairs.where(~F.coalesce(fn.same_shape(F.col("a"), F.col("b")), F.lit(False))).select("a", "b")
    bad = sides.join(wrong, ["a", "b"], "left_semi").select("doc_id").distinct().withColumn("bad", F.lit(True))
    return done.select("doc_id", (rest(F.col("a")) == rest(F.col("b"))).alias("same_rest")).join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNull().alias("same_shapes"), "same_rest")


def encode_units(spark, d):
    shapes = shaped(spark, d).select("shape").distinct()
    return shapes.select("shape", fn.normalize_written_units(F.split("shape", r"\+"), "permissive")["value"].alias("spelling"))


def encode_positioned(spark, d):
    """Every unit alone in each of its positions, and each initial one before each final one."""
    units = op.inventory(spark).where("position is not null")
    side = lambda p: units.where(F.col("position") == p).select(F.struct("unit", "position").alias(p))
    alone = units.select(F.array(F.struct("unit", "position")).alias("r"))
    # at most 31 x 33 rows of the catalogue
    pairs = side("init").crossJoin(side("fina")).select(F.array("init", "fina").alias("r"))
    records = alone.unionByName(pairs)
    spec = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["unit"], x["position"])), "+")
    got = records.select(spec.alias("records"), fn.normalize_positioned_written_units(F.col("r"), "permissive").alias("e"))
    return got.select("records", F.col("e.value").alias("spelling"), F.col("e.error_class").alias("error_class"))


def parse_units(spark, d):
    return shaped(spark, d).select("shape").distinct().select(F.col("shape").alias("spec"), F.array_join(fn.parse_written_units(F.col("shape")), "+").alias("parsed"))


def parse_compact(spark, d):
    """Shapes without separators: read in one way, or said to be ambiguous."""
    got = shaped(spark, d).select("shape").distinct().withColumn("r", fn.parse_written_units(F.replace(F.col("shape"), F.lit("+"), F.lit("")), "permissive"))
    return got.select("shape", F.array_join("r.value", "+").alias("parsed"), F.col("r.error_message").alias("error_message"))


def control_rounds(spark, d):
    """All sequences of four of nine units: what is left after the rounds stays."""
    names = F.array(*map(F.lit, ["A", "B", "N", "I", "O", "Nirugu", "Zwj", "Zwnj", "Mvs"]))
    digit = lambda k: F.element_at(names, (F.floor(F.col("id") / 9**k) % 9 + 1).cast("int"))
    once = spark.range(9**4).select("id", fn.canonical_units(F.array(*(digit(k) for k in range(4)))).alias("a"))
    return once.select("id", (fn.canonical_units(F.col("a")) == F.col("a")).alias("idempotent"))


def expand_contract(spark, d):
    raw = counted(spark, d).select(fn.shape_raw(F.col("word")).alias("raw")).distinct()
    got = raw.select("raw", fn.expand_units(F.col("raw")).alias("e")).select("raw", "e", fn.contract_units(F.col("e")).alias("c"))
    return got.select(*(F.array_join(c, "+").alias(n) for c, n in (("raw", "raw"), ("e", "expanded"), ("c", "contracted"))))


def batch_lines(spark, d):
    return sources.explode_lines(op.spread(read(spark, d, "documents").select("doc_id", "text")), keep=["doc_id"]).withColumn("number", F.col("number").cast("long"))


def inventories(spark, d):
    return op.inventory(spark)


def variants(spark, d):
    return op.variants(spark)


def reverse_table(spark, d):
    """The reverse table; each spelling at its position gives its units."""
    lead = F.when(F.col("position").isin("medi", "fina"), tables.NIRUGU).otherwise("")
    tail = F.when(F.col("position").isin("init", "medi"), tables.NIRUGU).otherwise("")
    nirugu = F.array(F.lit("Nirugu"))
    none = F.expr("cast(array() as array<string>)")
    units = F.concat(F.when(lead != "", nirugu).otherwise(none), op.literal_units(F.col("form")), F.when(tail != "", nirugu).otherwise(none))
    got = op.reverse_table(spark).select("*", fn.shape_raw(F.concat(lead, "spelling", tail)).alias("u"), units.alias("w"))
    return got.select("position", "form", "alias", "spelling", (F.col("u") == F.col("w")).alias("verified"))


def battery_table(spark, d):
    """The reverse table, derived from the rules."""
    return battery.battery(spark)


def random_round_trip(spark, d):
    """Seeded random words over all letters and controls keep their shape when normalised."""
    words = op.random_words(spark, 3000, 8, seed=11).withColumn("s", fn.shape_str(F.col("word"))).withColumn("n", fn.normalize(F.col("word"), "lenient"))
    return words.select("id", (fn.shape_str(F.col("n")) == F.col("s")).alias("kept"))


def rule_names(spark, d):
    return op.rule_names(spark)


def stream_shape_dedup(spark, d):
    """Distinct shapes of a stream of documents, each of which comes a second after the one before it, the first after
    the watermark's own start."""
    schema = read(spark, d, "documents").schema
    # a folder's stream: the table's file or files are matched by a pattern
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")
    texts = stream.select("doc_id", F.timestamp_seconds(F.col("doc_id") + 1).alias("ts"), mongolian(F.col("text")).alias("text"))
    words = op.extract_words(texts, keep=["ts"]).withWatermark("ts", "100000 hours").dropDuplicatesWithinWatermark(["word"])
    first = streaming.first_of_shape(words.withColumn("shape", fn.shape_str(F.col("word"))), delay="100000 hours")
    return streaming.drain(first).select("shape").distinct()


def stream_shape_counts(spark, d):
    """Shapes of a stream of events by day, as far as the watermark has closed the days."""
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    texts = stream.select("ts", mongolian(F.col("event_type")).alias("text"))
    counts = streaming.shape_counts(streaming.shaped_stream(texts, keep=["ts"]), delay="0 seconds")
    return streaming.drain(counts).groupBy("shape").agg(F.count_distinct("window_start").alias("n_days"), F.sum("n").alias("n"))


def tokens_view(spark, d):
    """token_positions by SQL, over the table function."""
    views.register(spark)
    valid(spark, d).createOrReplaceTempView("tamga_words")
    return spark.sql("SELECT t.ch, t.kind, t.position, count(*) AS n FROM tamga_words, LATERAL tokens(word) t GROUP BY t.ch, t.kind, t.position")


def parse_records(spark, d):
    """Records of positioned units in JSON: every unit at every position, and forms that are none."""
    names = op.inventory(spark).where("position is null").select("unit").crossJoin(spark.createDataFrame([(p,) for p in (*tables.POSITIONS, "control", "middle")], "position string"))
    text = names.select(F.to_json(F.array(F.struct("unit", "position"))).alias("records"))
    odd = ["", "{}", "[1]", '[{"unit":"A"}]', '[{"unit":1,"position":"isol"}]', '[{"unit":"A","position":"isol","x":1}]']
    text = text.unionByName(spark.createDataFrame([(o,) for o in odd], "records string"))
    got = text.withColumn("r", fn.normalize_positioned_json(F.col("records"), "permissive"))
    # spellings are encode_positioned's; here the errors of form and inventory are told
    kinds = ("RecordType", "RecordFields", "UnknownPosition", "ExplicitZwj", "ExplicitZwnj", "ControlRequiresControlPosition", "UnsupportedPositionedUnit")
    return got.select("records", F.when(F.col("r.error_class").isin(*kinds), F.col("r.error_class")).alias("error_class"))


QUERIES = (
    letter_positions, words_extract, words_distinct_topk, words_first_seen, corpora_union_except, versions, classify_chars, check_word_chars, token_positions, code_points, default_forms, rule_conditions, rule_effects,
    shape_detailed, shape_raw, shape_str, shape_controls, control_pairs, particle_words, shape_groups, shape_groups_topk, representatives, dedup_by_shape, docs_by_shape, same_shape_join, shape_semi, shape_anti,
    compare_raw_and_shape, compare_diff_groups, prefix_pairs, prefix_stability, normalize, normalize_controls, canonicity_check, round_trip, normalize_text_shapes, encode_units, encode_positioned,
    parse_units, parse_compact, control_rounds, expand_contract, batch_lines, inventories, variants, reverse_table, battery_table, random_round_trip, rule_names, stream_shape_dedup, stream_shape_counts, tokens_view, parse_records,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**sql.oracle(), **controls.oracle()}
