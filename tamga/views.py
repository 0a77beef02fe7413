"""Table functions for SQL: SELECT ... FROM words, LATERAL tokens(word).

The rows are those of functions.tokens and functions.trace, which are the faster way from the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tamga import kernel

_KINDS = {"L": "letter", "M": "mvs", "J": "joiner", "Z": "zwnj"}


class Tokens:
    def eval(self, word: str):
        if word is not None:
            w = kernel.Word(word)
            for i in range(w.n):
                yield i, w.char[i], _KINDS[w.kind[i]], w.alias[i], w.position[i], w.fvs[i][0] if w.fvs[i] else None


class TraceSteps:
    def eval(self, word: str):
        if word is not None:
            for number, step in enumerate(kernel.trace(word)["transitions"], 1):
                for change in step["changes"]:
                    yield number, step["rule"], change["token"], change["before"], change["after"]


def register(spark: SparkSession) -> None:
    """tokens(word) -> i, ch, kind, alias, position, fvs; trace_steps(word) -> step, rule, token, before, after."""
    spark.udtf.register("tokens", udtf(Tokens, returnType="i int, ch string, kind string, alias string, position string, fvs int"))
    spark.udtf.register("trace_steps", udtf(TraceSteps, returnType="step int, rule string, token int, before string, after string"))
