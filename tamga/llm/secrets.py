"""Secret scan over a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived that every match must satisfy. The index has, for
the trigrams that any query names, the postings of each block of documents; AND intersects and OR unites them, and
only candidates are searched by the regex. A rule whose regex has no mandatory trigram searches every text.
Trigrams are of lower-cased (A-Z) texts, which only adds candidates.

Null texts are empty and have no spans; texts of any length are searched whole; repeated rows give repeated results,
also under one doc_id or none; an empty table gives an empty one. Rules that match at one place are all listed, in
their order. Other columns pass through, of any name; a column called secrets is replaced. Spans are [start, end) in
code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamga.llm.blocks import free, quoted

#: Documents whose postings are intersected together.
BLOCK_ROWS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More alternatives than this aren't followed through a concatenation.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex (for Java), and how many characters a group needs. Matches are leftmost and don't
    overlap; one that is too short is dropped with all that it spans."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base rules, in the order in which kinds sort.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is too short stays so from any later start in it, so the length may stand in the regex.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

Query = tuple | None  # ("and" | "or", [Query]) or ("has", trigram); None: no condition


def _both(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p))
    return parts[0] if len(parts) == 1 else ("and", tuple(parts)) if parts else None


def _either(parts: list[Query]) -> Query:
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts)) if parts else None


def _needs(strings: set[str]) -> Query:
    return _either([_both([("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(regex: str) -> Query:
    """The trigrams that a match of regex must hold, lower-cased."""
    from re import _constants as C
    from re import _parser

    def one(op, arg) -> tuple[set[str] | None, Query]:
        """All strings a node matches if they are few, and what it needs otherwise."""
        if op is C.LITERAL:
            return {chr(arg).lower()}, None
        if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}, None
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            found = [sequence(x) for x in arg[1]]
            if all(s is not None for s, _ in found):
                return set().union(*(s for s, _ in found)), None
            return None, _either([_needs(s) if s is not None else q for s, q in found])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inside = arg
            strings, need = sequence(inside)
            if (least, most) == (0, 1) and strings is not None:
                return strings | {""}, None
            if least == most and strings is not None and len(strings) == 1:
                return {next(iter(strings)) * least}, None
            return None, (_needs(strings) if strings is not None else need) if least else None
        if op is C.AT:
            return {""}, None
        return None, None

    def sequence(nodes) -> tuple[set[str] | None, Query]:
        run, needs, whole = {""}, [], True
        for op, arg in nodes:
            strings, need = one(op, arg)
            if strings is not None and len(run) * len(strings) <= ALTERNATIVES:
                run = {a + b for a in run for b in strings}
                continue
            whole = False
            needs += [_needs(run), need]
            run = strings if strings is not None else {""}
        return (run, None) if whole else (None, _both([*needs, _needs(run)]))

    strings, need = sequence(_parser.parse(regex))
    return _needs(strings) if strings is not None else need


def _grams(query: Query) -> set[str]:
    return set() if query is None else {query[1]} if query[0] == "has" else set().union(*map(_grams, query[1]))


def _postings(query: tuple) -> Column:
    """The documents of a block that satisfy a query, from the columns of its trigrams' postings."""
    if query[0] == "has":
        return F.coalesce(F.col(_name(query[1])), F.expr("cast(array() as array<bigint>)"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, map(_postings, query[1]))


def _name(gram: str) -> str:
    return "g_" + gram.encode().hex()


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str, name: str = "rules") -> DataFrame:
    """(key, name array<string>): for the rules with mandatory trigrams, the documents that may match."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    grams = sorted(set().union(*map(_grams, queries.values())))
    low = F.translate(F.col(text), UPPER, LOWER)
    present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("_low"), g))
    held = docs.select(F.col(key), low.alias("_low")).select(key, F.explode(present).alias("gram"))
    block = F.pmod(F.xxhash64(key), F.lit(docs.count() // BLOCK_ROWS + 1))
    index = held.groupBy(block.alias("block"), "gram").agg(F.collect_set(key).alias("ids"))
    blocks = index.groupBy("block").agg(*(F.first(F.when(F.col("gram") == g, F.col("ids")), ignorenulls=True).alias(_name(g)) for g in grams))

    def of(kind: str, query: tuple) -> Column:
        return F.transform(_postings(query), lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind")))

    found = F.flatten(F.array(*(of(k, q) for k, q in queries.items())))
    hits = blocks.select(F.explode(found).alias("x")).select(F.col("x.id").alias(key), "x.kind")
    return hits.groupBy(key).agg(F.collect_set("kind").alias(name))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches: the gaps between matches give the places."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.regex, -1)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        new = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.array_append(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rows, zero, step)["found"]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with secrets array<struct<start, rank, kind, end>> by start, then the rules' order."""
    docs = docs.drop("secrets")
    key, held = free(docs.columns, "_key", "_rules")
    keyed = docs.withColumn(key, F.xxhash64(doc_id))
    found = candidates(keyed, rules, key, text, held)
    indexed = {r.kind for r in rules if trigram_query(r.regex)}
    joined = keyed.join(found, key, "left")
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")

    def verified(rank: int, rule: Rule) -> Column:
        got = F.transform(spans(body, rule), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))
        may = F.array_contains(held, rule.kind) if rule.kind in indexed else F.regexp_like(body, F.lit(rule.regex))
        return F.when(may, got).otherwise(none)

    parts = [verified(rank, rule) for rank, rule in enumerate(rules)]
    return joined.withColumn("secrets", F.array_sort(F.concat(*parts))).select(*map(quoted, docs.columns), "secrets")


def redact(scanned: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The texts of scan_secrets with every span masked; overlapping spans become one mask."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.substring(F.col(text), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        shown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], clear, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), shown.alias("out"))

    done = F.aggregate("secrets", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.lit(1 << 30))))
    return scanned.withColumn(text, F.when(F.size("secrets") > 0, done).otherwise(F.col(text)))
