"""Column functions, operators, sources, streams, the command line; registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tamga import functions as fn
from tamga import kernel as K
from tamga import operators as op
from tamga import plans, sources

TABLES = "orders events documents benchmark".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert rows
    if name in plans.oracle_sql():
        result = duck.execute(plans.oracle_sql()[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_modes(spark):
    words = spark.createDataFrame([(1, K.spell_aliases("s e i n")), (2, "abc"), (3, None), (4, "")], "id int, word string")
    got = {r.id: r.s for r in words.select("id", fn.shape_str(F.col("word"), "permissive").alias("s")).collect()}
    assert got[1].value == "S+A+I+I+A" and got[2].error_class == "NonMongolianChar" and got[2].error_index == 0
    assert got[3].value is None and got[3].error_class is None and got[4].value == ""
    with pytest.raises(Exception, match="non-Mongolian character"):
        words.select(fn.shape_str(F.col("word"))).collect()
    with pytest.raises(ValueError):
        fn.shape(F.col("word"), "other")


def test_deduplicated_results_are_the_same(spark):
    words = spark.createDataFrame([(i, K.spell_aliases(a)) for i, a in enumerate(["s a i n", "s e i n", "m o r i n"] * 5)] + [(99, None)], "id int, word string")
    once = {tuple(r) for r in op.with_shape(words).collect()}
    assert once == {tuple(r) for r in op.with_shape(words, dedupe=False).collect()} and len(once) == 16


def test_native_tokens_agree_with_the_kernel(spark):
    word = K.spell_aliases("fvs1 a fvs2 fvs3 zwj b zwnj mvs fvs1 e nnbsp nirugu n")
    rows = op.token_rows(spark.createDataFrame([(word,)], "word string")).orderBy("i").collect()
    w = K.Word(word)
    assert [r.ch for r in rows] == w.char and [r.position for r in rows] == w.position and [r.alias for r in rows] == w.alias
    alias = spark.createDataFrame([("t a l mvs a",)], "a string").select(fn.spell_aliases(F.col("a")).alias("w")).first().w
    assert alias == K.spell_aliases("t a l mvs a")


def test_lines(spark, tmp_path):
    texts = ["", "a", "a\n", "a\r\nb", "\n\n", "a\x0bb\x1cc\x85d e ", "a\rb\x0c"]
    got = {r.text: r.l for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", sources.lines(F.col("text")).alias("l")).collect()}
    assert got == {t: t.splitlines() for t in texts}
    path = tmp_path / "words.txt"
    path.write_text(K.spell_aliases("s a i n") + " x " + K.spell_aliases("s a i n"))
    assert [(r.word, r.n, r.first.pos) for r in sources.word_list(spark, str(path)).collect()] == [(K.spell_aliases("s a i n"), 2, 0)]
    table = tmp_path / "t.tsv"
    table.write_text("#c\n\nx-1\ts a i n space m o\tS\nbad\n")
    assert sources.read_alias_table(spark, str(table)).first().words == [K.spell_aliases("s a i n"), K.spell_aliases("m o")]
    sources.write_report(spark.createDataFrame([(1, "b")], "n int, w string").coalesce(1), str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("*.csv")).read_text() == "n\tw\n1\tb\n"


def test_command_line(spark, capsys, tmp_path):
    from tamga.cli import main

    sain, sein = K.spell_aliases("s a i n"), K.spell_aliases("s e i n")
    assert main(["same", sain, sein]) == 0 and main(["same", sain, K.spell_aliases("m o")]) == 1
    assert main(["shape", sain]) == 0 and capsys.readouterr().out == "S+A+I+I+A\n"
    assert main(["shape", "abc"]) == 2 and main(["same", sain]) == 2
    source, target = tmp_path / "in", tmp_path / "out"
    source.write_text(f"{sain}\n{sein}\n")
    assert main(["shape", "--batch", "-i", str(source), "-o", str(target)]) == 0
    assert target.read_text() == "S+A+I+I+A\nS+A+I+I+A\n"
    source.write_text(f"{sain}\nabc\n")
    capsys.readouterr()
    assert main(["normalize", "--batch", "-i", str(source)]) == 2 and "line 2:" in capsys.readouterr().err


def test_streams(spark, sf):
    from tamga import streaming

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select("ts", plans.mongolian(F.col("event_type")).alias("text"))
    counts = streaming.shape_counts(streaming.shaped_stream(stream, keep=["ts"]))
    got = streaming.drain(counts)
    static = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), plans.mongolian(F.col("event_type")).alias("text"))
    batch = op.extract_words(static, keep=["ts"]).withColumn("shape", fn.shape_str(F.col("word"))).groupBy(F.window("ts", "1 day").start.alias("window_start"), "shape").agg(F.count(F.lit(1)).alias("n"))
    assert got.count() and got.exceptAll(batch).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
