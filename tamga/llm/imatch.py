"""Document fingerprints by I-Match over randomised lexicons, with DataFrame functions only.

The lexicon are the terms in a band of inverse document frequency. A text keeps its distinct lexicon terms; for each
of several randomised subsets of the lexicon the kept terms are sorted and hashed to one part of the fingerprint.
Subsets come in LEVELS, each a quarter of the one before, with SEEDS subsets a level: a part of few terms survives
an edit that a part of many does not, and which level has few depends on the text's length. The likeness of two
fingerprints is the largest share of equal parts at any level that says enough.

The band's lower end is a share of all documents, so the lexicon has at most (mean distinct terms of a text) / share
terms at any corpus size; that is what makes it fit to be sent to every task. Few lexicon terms say little about a
text, so a seed sees all terms of a text that holds fewer lexicon terms than the seed asks for: LEAST for the first,
LEAST_STEP more for each next, so that an edit which crosses one bound changes the parts of that seed only. A text
that no subset has terms of is hashed by all its terms as a whole. Equal texts have equal fingerprints. Null texts are
empty. Ids are of any type that sorts; rows with equal ids are ordered by their texts' hashes, null ids come first. An
empty table gives an empty one. Texts are whole, of any length. Other columns pass through `fingerprints`, of any name,
but for one called fingerprint, and aren't read by `edited_fingerprints`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamga.llm.blocks import cut, free, renamed

#: The band, as shares of documents that hold a term.
RAREST, COMMONEST = 0.001, 0.2
LEVELS, SEEDS = 5, 6
#: Lexicon terms that a text must hold for the first seed to leave its other terms out, and how many more for each next.
LEAST, LEAST_STEP = 4, 2
#: Slots of the lexicon's hash table.
SLOTS = 1 << 14
#: Documents sorted together, about.
RANGE_ROWS = 16384
_EMPTY = "cast(array() as array<bigint>)"


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"))
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str) -> DataFrame:
    """One row, `slots` array<array<long>>: the term hashes of the band, by their low bits."""
    held = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").count()
    n = docs.count()
    low, high = max(1, math.ceil(n * RAREST)), max(1, math.floor(n * COMMONEST))
    band = held.where(F.col("count").between(low, high))
    full = band.groupBy(F.pmod("term", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.array_sort(F.collect_list("term")).alias("own"))
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    filled = every.join(full, "slot", "left").select("slot", F.coalesce("own", F.expr(_EMPTY)).alias("own"))
    return cut(filled.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "own"))), lambda s: s["own"]).alias("slots")))


def _kept(all_terms: str, slots: str) -> Column:
    """The terms that are in the lexicon."""
    return F.filter(all_terms, lambda t: F.array_contains(F.element_at(F.col(slots), (F.pmod(t, F.lit(SLOTS)) + 1).cast("int")), t))


def _with_subsets(df: DataFrame, columns: list[str], inside: str, every: str) -> DataFrame:
    """columns, and the sorted terms of each subset as _s<seed>_<level>.

    A level's subset lies in the one before it, so only terms of that are looked at again, and only those of the first
    are sorted, as longs: array_sort compares by an expression that is interpreted for each two terms.
    """
    kept = lambda seed: F.when(F.size(inside) >= LEAST + LEAST_STEP * seed, F.col(inside)).otherwise(F.col(every))
    made = []
    for level in range(LEVELS):
        mask = (1 << (1 + 2 * level)) - 1
        if level:
            own = [F.filter(f"_s{seed}_{level - 1}", _masked(mask)) for seed in range(SEEDS)]
        else:
            own = [F.sort_array(F.filter(F.transform(kept(seed), _seeded(seed)), _masked(mask))) for seed in range(SEEDS)]
        df = df.select(*columns, *made, *(c.alias(f"_s{seed}_{level}") for seed, c in enumerate(own)))
        made += [f"_s{seed}_{level}" for seed in range(SEEDS)]
    return df


def _parts() -> Column:
    """The parts made from the subsets: 0 for one without terms."""
    subsets = [F.col(f"_s{seed}_{level}") for level in range(LEVELS) for seed in range(SEEDS)]
    return F.array(*(F.when(F.size(s) == 0, F.lit(0)).otherwise(_part(s)) for s in subsets))


def _part(hashes: Column) -> Column:
    """One part of a fingerprint, never 0."""
    return F.xxhash64(hashes).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1)).cast("int")


def _seeded(seed: int):
    return lambda t: F.xxhash64(t, F.lit(seed))


def _masked(mask: int):
    return lambda t: t.bitwiseAND(F.lit(mask)) == 0


def with_parts(df: DataFrame, text: Column, slots: Column, name: str) -> DataFrame:
    """df with a column of fingerprint parts."""
    columns = df.columns
    df = df.select(*columns, terms(text).alias("_all"))
    # the lexicon is a column for the analyser only, which would be copied for each row: this projection and the next
    # become one, and as it reads _all twice it isn't made one with the one before
    df = df.select(*columns, "_all", _part(F.sort_array("_all")).alias("_whole"), slots.alias("_slots"))
    df = df.select(*columns, "_all", "_whole", _kept("_all", "_slots").alias("_in"))
    df = _with_subsets(df, [*columns, "_whole"], "_in", "_all")
    df = df.select(*columns, "_whole", _parts().alias(name))
    return df.select(*columns, F.when(F.exists(name, lambda p: p != 0), F.col(name)).otherwise(F.array_repeat("_whole", LEVELS * SEEDS)).alias(name))


def likeness(a: str, b: str) -> Column:
    """0 to 1: 1 for equal fingerprints, else the best level's share of equal parts among those not empty on both sides.
    A level says enough when half its parts aren't empty."""
    levels, equal_all, held_all = [], F.lit(0), F.lit(0)
    for level in range(LEVELS):
        equal, held = F.lit(0), F.lit(0)
        for i in range(level * SEEDS + 1, (level + 1) * SEEDS + 1):
            x, y = F.element_at(a, i), F.element_at(b, i)
            equal = equal + ((x == y) & (x != 0)).cast("int")
            held = held + ((x != 0) | (y != 0)).cast("int")
        levels.append(F.when(held * 2 >= SEEDS, equal / held).otherwise(F.lit(0.0)))
        equal_all, held_all = equal_all + equal, held_all + held
    share = F.when(held_all > 0, equal_all / held_all).otherwise(F.lit(0.0))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.greatest(*levels, share))


def shown(parts: str) -> Column:
    """A fingerprint as text: its parts in hexadecimal."""
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p)), 8, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint, in the place of such a column."""
    slots = lexicon(docs, text).scalar()
    carried, names, restored = renamed(c for c in docs.columns if c != "fingerprint")
    parts = with_parts(docs.select(*carried, F.col(text).alias("_text")), F.col("_text"), slots, "_parts")
    return parts.select(*restored, shown("_parts").alias("fingerprint"))


def with_next(docs: DataFrame, doc_id: str, carried: list[str], order: Column) -> DataFrame:
    """docs with next_<column> of the next row by id (of the last: the first), without sorting all rows in one place.

    Rows are dealt to ranges of their ids, of any type; rows of equal id by their order. The bounds come from the rows
    themselves, one for some RANGE_ROWS rows, and are the only thing all tasks get. The first row of each range also
    goes to the range before it.
    """
    ranges = docs.count() // RANGE_ROWS + 1
    bounds, key, at = free(docs.columns, "_bounds", "_key", "_at")
    keyed = docs.withColumn(key, F.struct(F.col(doc_id).isNotNull().alias("a"), F.col(doc_id).alias("b"), order.alias("c")))
    firsts = keyed.select(F.col(key).alias("k")).repartitionByRange(ranges, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    firsts = firsts.agg(F.array_sort(F.collect_list("k")).alias("k"))
    # in rows of `wide`, so that a row's range is found by its row, then its place there
    firsts = firsts.withColumn("wide", F.ceil(F.sqrt(F.size("k"))).cast("int"))
    wide = F.col("wide")
    rows = F.transform(F.filter(F.sequence(F.lit(0), wide), lambda i: i * wide < F.size("k")), lambda i: F.slice("k", i * wide + 1, wide))
    table = cut(firsts.select(F.struct(rows.alias("rows"), F.size("k").alias("n"), "wide").alias("bounds"))).scalar()
    marked = keyed.select(*docs.columns, key, table.alias(bounds))
    among = F.size(F.filter(F.transform(F.col(bounds)["rows"], lambda r: r[0]), lambda first: first <= F.col(key)))
    own = F.element_at(F.col(bounds)["rows"], among)
    place = F.size(F.filter(own, lambda first: first <= F.col(key)))
    number = (among - 1) * F.col(bounds)["wide"] + place
    here = F.struct(number.alias("range"), F.lit(0).alias("ghost"))
    before = F.struct(F.when(number == 1, F.col(bounds)["n"]).otherwise(number - 1).alias("range"), F.lit(1).alias("ghost"))
    dealt = marked.select(*docs.columns, key, F.explode(F.when(F.element_at(own, place) == F.col(key), F.array(here, before)).otherwise(F.array(here))).alias(at))
    line = Window.partitionBy(F.col(at)["range"]).orderBy(F.col(at)["ghost"], F.col(key))
    moved = dealt.select("*", *(F.lead(c).over(line).alias(f"next_{c}") for c in carried))
    return moved.where(F.col(at)["ghost"] == 0).select(*docs.columns, *(f"next_{c}" for c in carried))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): each text beside the text
    whose last quarter is replaced by the start of the next one, and beside the next one."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    slots = lexicon(docs, "text").scalar()
    own = with_parts(docs, F.col("text"), slots, "parts")
    both = with_next(own, "doc_id", ["text", "parts"], F.xxhash64("text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited"), "parts", "next_parts")
    done = with_parts(both, F.col("edited"), slots, "edited_parts")
    return done.select("doc_id", "n_chars", "edited", shown("parts").alias("fingerprint"), shown("edited_parts").alias("edited_fingerprint"), likeness("parts", "edited_parts").alias("near_edited"), likeness("parts", "next_parts").alias("near_next"))
