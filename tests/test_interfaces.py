"""Loaders, golden vectors, reports, table functions, the Python interface and sets of words."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tamga import functions as fn
from tamga import kernel as K
from tamga import operators as op
from tamga import report, sources, tables, views
from tamga.api import Shaper
from tamga.plans import controls

WORDS = ["s a i n", "m o ng g o l", "t a l mvs a", "a fvs1", "zwj b zwnj a", "e g e", "n a r a n nirugu"]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(K.spell_aliases(w),) for w in WORDS], "word string")


def test_expected_units(spark):
    row = spark.createDataFrame([("<A N _ Aa Fvs1 - Ni Nnbsp",), ("< A > B",)], "t string").select(fn.expected_units(F.col("t")).alias("u"), fn.expected_units(F.col("t"), "_ - Nnbsp").alias("n")).collect()
    assert row[0].u[1:] == ["N", "Mvs", "Aa", "Mvs", "Nirugu"] and row[0].n[-1] == "Mvs" and row[1].u == ["A", "B"]


def test_unknown_alias_fails(spark):
    with pytest.raises(Exception, match="unknown alias zz"):
        spark.createDataFrame([("a zz",)], "t string").select(fn.spell_aliases(F.col("t"))).collect()


def test_golden_vectors(spark, words, tmp_path):
    sources.write_golden(words, f"{tmp_path}/golden")
    got = {r.word: r for r in sources.read_golden(spark, f"{tmp_path}/golden").collect()}
    assert set(got) == {r.word for r in words.collect()}
    for word, r in got.items():
        assert tuple(r.shape) == K.shape(word) and r.normalized == K.normalize(word, True)


def test_traces(spark, tmp_path):
    word = K.spell_aliases("t a l mvs a")
    vector = {"id": "x", "witness_rule": "r", "input_aliases": "t a l mvs a", "input_cps": list(map(ord, word)), "expected": K.trace(word)}
    (tmp_path / "t.json").write_text(json.dumps({"locale": "MNG", "schema": "s", "rules": [], "vectors": [vector]}, indent=1))
    row = sources.read_traces(spark, f"{tmp_path}/t.json").withColumn("got", fn.trace(F.col("word"))).first()
    assert row.word == word and row.got == row.expected


@pytest.mark.skipif("TAMGA_FIXTURES" not in os.environ, reason="a folder with conformance tables is named by TAMGA_FIXTURES")
def test_conformance(spark):
    """All rows of the public conformance tables (id, aliases, expected units) and traces of a folder."""
    folder, rows = os.environ["TAMGA_FIXTURES"], 0
    # in tables of the newer kind the joining space is a break and joiners aren't shown
    for name, breaks, hidden in (("older.tsv", "_ -", ()), ("newer.tsv", "_ - Nnbsp", ("Zwj",))):
        table = sources.read_alias_table(spark, f"{folder}/{name}").withColumn("units", fn.expected_units(F.col("expected"), breaks))
        for r in table.collect():
            got = [u for k, w in enumerate(r.words) for u in (*("Mvs",) * bool(k), *K.shape_raw(w)) if u not in hidden]
            assert got == r["units"], r.id
            rows += 1
    for r in sources.read_traces(spark, f"{folder}/traces.json").withColumn("got", fn.trace(F.col("word"))).collect():
        assert r.got == r.expected, r.id
        rows += 1
    assert rows == 377


def test_report(spark, words, tmp_path):
    odd = words.unionByName(spark.createDataFrame([("x",)], "word string"))
    one_side = F.when(F.col("word") == K.spell_aliases("e g e"), F.lit("x")).otherwise(F.col("word"))
    got = report.compare(odd, fn.shape_raw(F.col("word"), "permissive"), fn.shape(one_side, "permissive"))
    s = report.summary(got)
    assert s.total == len(WORDS) and s.one_side == 1 and s.same + s.differ + 1 == s.total
    assert "1 by one side only" in report.as_text(s)
    assert report.as_markdown(s).startswith("| words | same |")
    assert report.as_annotation(s).startswith("::warning title=") and report.as_annotation(s, fail=True).startswith("::error")
    same = report.summary(report.compare(words, fn.shape(F.col("word"), "permissive"), fn.shape(F.col("word"), "permissive")))
    assert same.percent(same.same) == 100 and report.as_annotation(same).startswith("::notice")
    report.write_table(got, f"{tmp_path}/rows")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/rows")
    assert back.columns == ["word", "code_points", "a", "b", "a_part", "b_part"] and back.count() == s.differ + 1


def test_table_functions(spark, words):
    views.register(spark)
    words.createOrReplaceTempView("some_words")
    got = sorted(map(tuple, spark.sql("SELECT word, i, ch, kind, position FROM some_words, LATERAL tokens(word)").collect()))
    assert got == sorted(tuple(r) for r in op.token_rows(words).select("word", "i", "ch", "kind", "position").collect())
    steps = spark.sql("SELECT word, rule, token, after FROM some_words, LATERAL trace_steps(word)").collect()
    assert {(r.word, r.rule, r.token, r.after) for r in steps} == {(w, s["rule"], c["token"], c["after"]) for w in (K.spell_aliases(x) for x in WORDS) for s in K.trace(w)["transitions"] for c in s["changes"]}


def test_python_interface():
    shaper = Shaper()
    word = K.spell_aliases("s a i n")
    assert shaper.shape_str(word) == "+".join(shaper.shape(word)) and shaper.same_shape(word, shaper.normalize(word))
    assert shaper.normalize_written_units(shaper.shape(word)) == shaper.normalize(word)
    assert shaper.version == tables.VERSION and shaper.canonical_version == tables.CANONICAL_VERSION
    for call in (lambda: shaper.shape(1), lambda: shaper.normalize(None), lambda: shaper.normalize_written_units("A"), lambda: shaper.normalize_written_units([1]), lambda: shaper.normalize_positioned_written_units("A"), lambda: shaper.normalize_positioned_written_units([{"unit": 1, "position": "isol"}])):
        with pytest.raises(TypeError):
            call()
    for records in ([{"unit": "A"}], [{"unit": "A", "position": "middle"}], [{"unit": "Zwj", "position": "isol"}]):
        with pytest.raises(ValueError):
            shaper.normalize_positioned_written_units(records)
    with pytest.raises(ValueError):
        Shaper("XXX")
    e = K.NormalizationFallback("x", ("O",))
    assert isinstance(e, ValueError) and e.text == "x" and e.written_units == ("O",) and "O" in str(e)


def test_sets_of_words(spark):
    a, b = (spark.createDataFrame([(w,) for w in x], "word string") for x in ("aabc", "bcd"))
    assert sorted(r.word for r in op.words_intersect(a, b).collect()) == ["b", "c"]
    assert [r.word for r in op.words_except(a, b).collect()] == ["a"]
    assert sorted(map(tuple, op.words_union(a, b).collect())) == [("a", True, False), ("b", True, True), ("c", True, True), ("d", False, True)]


def test_normalize_texts(spark):
    sain = K.spell_aliases("s a i n")
    other = next(w for w in (K.spell_aliases(x) for x in ("s a y i n", "s a y y n", "s a i i n", "u n d u", "o n d o")) if K.normalize(w, True) != w)
    texts = [None, "", "no word", f"a {other} b {sain}, {other}", other, f"{other} {other}", f"{sain}!", f"x{other}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.normalized for r in op.normalize_texts(df, "id", mode="lenient").collect()}
    assert got == {i: None if t is None else K.normalize_text(t, True) for i, t in enumerate(texts)}


def test_prefix_stability_tells_unstable_pairs(spark):
    a, e = K.spell_aliases("a"), K.spell_aliases("e")
    spelt = spark.createDataFrame([("A", a), ("A+B", a + e), ("A+B+C", e + a + e), ("B", e)], "shape string, normalized string")
    got = {(r.shape, r.longer): r.stable for r in op.prefix_stability(spelt).collect()}
    assert got == {("A", "A+B"): True, ("A", "A+B+C"): True, ("A+B", "A+B+C"): False}


def test_kernel_runs_above_the_distinct_words(spark):
    """No filter on a result is copied below the aggregation."""
    words = spark.range(10).select(F.lit("\u1820").alias("word"))
    shaped = op.distinct_words(words).withColumn("shape", fn.shape_str(F.col("word")))
    plan = op.shape_join(shaped, shaped)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_sql_of_control_words():
    """The SQL for words with controls against the kernel, on all particles with their surroundings."""
    import duckdb

    rows = duckdb.connect().execute(controls.oracle()["particle_words"]).df()
    assert len(rows) > 2000
    for word, told, shape in zip(rows["word"], rows["conditions"], rows["shape"], strict=True):
        assert "+".join(K.shape(word)) == shape
        assert " ".join(c or "-" for c in K.conditions(K.Word(word))) == told
