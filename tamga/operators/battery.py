"""The reverse table derived from the rules: which letter and FVS write given units whatever stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamga import functions as fn
from tamga import tables

# The letters that stand beside a candidate, and candidates that are preferred where they hold.
PROBES = ("a", "e", "o", "i", "n", "s", "g", "b")
PINNED = {(p, "G"): ("g", 2) for p in tables.POSITIONS} | {("isol", "I"): ("i", 1)}


def candidates(spark: SparkSession) -> DataFrame:
    """position, form, alias, fvs: every variant, with its FVS and also bare, as a rule may choose it."""
    rows = {(p, "+".join(u), a, f) for a, p, n, u, _, _ in tables.catalogue().rows for f in (n, 0)}
    rows |= {(p, form, a, f) for (p, form), (a, f) in PINNED.items()}
    return spark.createDataFrame(sorted(rows), "position string, form string, alias string, fvs int")


def probed(pool: DataFrame) -> DataFrame:
    """Candidates that keep their form beside all probes, at the position meant."""
    c = tables.catalogue()
    letter = F.create_map(*(F.lit(x) for pair in c.char.items() for x in pair))
    selector = F.create_map(*(F.lit(x) for pair in {0: "", **tables.FVS}.items() for x in pair))
    beside = F.array(*(F.lit(c.char[a]) for a in PROBES))
    nothing = F.array(F.lit(""))

    def side(*closed: str) -> Column:
        return F.explode(F.when(F.col("position").isin(*closed), nothing).otherwise(beside))

    spelt = pool.withColumn("spelling", F.concat(letter[F.col("alias")], selector[F.col("fvs")]))
    words = spelt.withColumn("left", side("isol", "init")).withColumn("right", side("isol", "fina"))
    token = F.get(fn.shape_detailed(F.concat("left", "spelling", "right")), F.when(F.col("left") == "", 0).otherwise(1))
    seen = words.withColumn("t", token).where(F.col("t.position") == F.col("position"))
    keeps = F.bool_and(F.array_join("t.written", "+") == F.col("form"))
    return seen.groupBy("position", "form", "alias", "fvs", "spelling").agg(keeps.alias("keeps")).where("keeps").drop("keeps")


def battery(spark: SparkSession) -> DataFrame:
    """gender, position, form, alias, spelling: the first candidate that holds (masculine ones and those with an FVS
    first), and for single units the first feminine one."""
    c = tables.catalogue()
    held = probed(candidates(spark))
    pin = F.lit(False)
    for (position, form), (alias, fvs) in PINNED.items():
        pin = pin | ((F.col("position") == position) & (F.col("form") == form) & (F.col("alias") == alias) & (F.col("fvs") == fvs))
    feminine = F.col("alias").isin(*c.feminine)
    order = Window.partitionBy("position", "form").orderBy((~pin).cast("int"), feminine.cast("int"), F.substring("spelling", 1, 1), (F.col("fvs") == 0).cast("int"), "fvs")
    first = held.withColumn("k", F.row_number().over(order)).where("k = 1").withColumn("gender", F.lit("any"))
    single = held.where(feminine & ~F.contains(F.col("form"), F.lit("+"))).withColumn("k", F.row_number().over(order)).where("k = 1").withColumn("gender", F.lit("feminine"))
    return first.unionByName(single).select("gender", "position", "form", "alias", "spelling")
