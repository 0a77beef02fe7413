"""Comparisons of two results for the same words, as tables and as text.

The work is on frames; what becomes text is a row of totals and the largest groups of differences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamga import functions as fn

NOTHING = "∅"


def compare(words: DataFrame, a: Column, b: Column) -> DataFrame:
    """word, code_points, a, b, a_part, b_part, verdict (same, differ, only_a or only_b). a and b are permissive results
    in arrays of units; a side that fails has its error in the place of its units. Words that both reject are left out."""
    both = words.select("word", a.alias("x"), b.alias("y")).where(F.col("x.error_class").isNull() | F.col("y.error_class").isNull())
    fails = lambda side: F.col(f"{side}.error_class").isNotNull()
    shown = lambda side: F.when(fails(side), F.concat(F.lit("error: "), F.col(f"{side}.error_message"))).otherwise(F.array_join(f"{side}.value", "+"))
    verdict = F.when(fails("y"), "only_a").when(fails("x"), "only_b").when(F.col("x.value") == F.col("y.value"), "same").otherwise("differ")
    part = fn.middle(F.col("x.value"), F.col("y.value"))
    rows = both.select("word", fn.code_points(F.col("word")).alias("code_points"), shown("x").alias("a"), shown("y").alias("b"), part.alias("part"), verdict.alias("verdict"))
    differs = F.col("verdict") == "differ"
    return rows.select("word", "code_points", "a", "b", F.when(differs, F.col("part.a")).alias("a_part"), F.when(differs, F.col("part.b")).alias("b_part"), "verdict")


def groups(compared: DataFrame) -> DataFrame:
    """a_part, b_part, n, example: the kinds of difference, the most frequent first."""
    kinds = compared.where("verdict = 'differ'").groupBy("a_part", "b_part").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("example"))
    return kinds.orderBy(F.desc("n"), "a_part", "b_part")


@dataclass(frozen=True)
class Summary:
    total: int
    same: int
    differ: int
    one_side: int
    n_groups: int
    largest: list[tuple[str, str, int, str]]

    def percent(self, n: int) -> float:
        return 100.0 * n / self.total if self.total else 0.0


def summary(compared: DataFrame, largest: int = 20) -> Summary:
    """The totals, and the largest groups; nothing else comes to the driver."""
    count = {r.verdict: r["count"] for r in compared.groupBy("verdict").count().collect()}
    kinds = groups(compared)
    rows = [(r.a_part or NOTHING, r.b_part or NOTHING, r.n, r.example) for r in kinds.limit(largest).collect()]
    return Summary(sum(count.values()), count.get("same", 0), count.get("differ", 0), count.get("only_a", 0) + count.get("only_b", 0), kinds.count(), rows)


def as_text(s: Summary, a: str = "a", b: str = "b") -> str:
    lines = [f"{s.total} words: {s.same} same ({s.percent(s.same):.2f}%), {s.differ} differ ({s.percent(s.differ):.2f}%), {s.one_side} by one side only"]
    lines += [f"{n:>8}  {a}: {x}  {b}: {y}  {example}" for x, y, n, example in s.largest]
    return "\n".join(lines) + "\n"


def _cell(value: object) -> str:
    return str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def as_markdown(s: Summary, a: str = "a", b: str = "b") -> str:
    table = lambda head, rows: "\n".join(f"| {' | '.join(map(_cell, row))} |" for row in (head, ["---"] * len(head), *rows))
    totals = table(["words", "same", "differ", "one side only"], [[s.total, s.same, f"{s.differ} ({s.percent(s.differ):.2f}%)", s.one_side]])
    if not s.largest:
        return totals + "\n"
    more = "" if len(s.largest) == s.n_groups else f", the {len(s.largest)} largest"
    return f"{totals}\n\n{s.n_groups} groups{more}:\n\n" + table(["words", a, b, "example"], [[n, x, y, e] for x, y, n, e in s.largest]) + "\n"


def as_annotation(s: Summary, title: str = "comparison", fail: bool = False) -> str:
    """One workflow command line: a notice when all is the same, else a warning, or an error."""
    escape = lambda t: t.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = escape(f"{title}: {s.differ} of {s.total} differ ({s.percent(s.differ):.2f}%)").replace(":", "%3A").replace(",", "%2C")
    level = "notice" if not s.differ and not s.one_side else "error" if fail else "warning"
    return f"::{level} title={head}::{escape(as_text(s).strip())}"


def write_table(compared: DataFrame, path: str) -> None:
    """All rows that aren't the same, tab-separated with a header: word, code_points, a, b, a_part, b_part."""
    rows = compared.where("verdict <> 'same'").drop("verdict").na.fill("")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
