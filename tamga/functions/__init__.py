"""Column functions on words, texts and written units.

What Spark can express is native: character classes, tokens, positions, code points. The rest are Arrow-batched
functions over the word kernel; use `operators.with_shape` and its like to run them on distinct words only. In an
aggregate function or a join's condition use a column computed before.

Every fallible function has a mode. `strict` fails the query with the message of the error; `permissive` gives a
struct value, error_class, error_message, error_index; `lenient`, for normalising only, gives the word itself where
no canonical spelling exists. Null in is null out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from tamga import kernel, tables
from tamga.tables import LETTER_CLASS, WORD_CLASS

UNITS = ArrayType(StringType(), False)
DETAIL = "array<struct<cp:int,alias:string,position:string,fvs:int,condition:string,written:array<string>>>"
TRACE = (
    "struct<positions:array<string>,transitions:array<struct<rule:string,changes:array<struct<token:int,before:string,after:string>>>>,"
    "final_conditions:array<string>,written_by_token:array<array<string>>,shape:array<string>>"
)
FVS_CLASS = "\u180b-\u180d\u180f"
MODES = ("strict", "permissive", "lenient")


def _mapped(f: Callable, kind: str | DataType, mode: str) -> Callable[..., Column]:
    """A column function that applies f to each row without nulls."""
    if mode not in MODES[:2]:
        raise ValueError(f"mode must be one of {MODES[:2]}")
    name = kind if isinstance(kind, str) else kind.simpleString()

    def strict(*series):
        return pd.Series([None if any(_absent(v) for v in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    def permissive(*series):
        out = []
        for row in zip(*series, strict=True):
            value = cls = message = index = None
            if not any(_absent(v) for v in row):
                try:
                    value = f(*row)
                except kernel.WordError as e:
                    cls, message, index = e.error_class, str(e), e.index
            out.append((value, cls, message, index))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pd.DataFrame({"value": pd.Series(columns[0], dtype=object), "error_class": columns[1], "error_message": columns[2], "error_index": pd.Series(columns[3], dtype="Int32")})

    struct = name.startswith("struct")

    def rows(*series):
        return pd.DataFrame(list(strict(*series)))

    def one(a: pd.Series) -> pd.Series:
        return strict(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return strict(a, b)

    def one_row(a: pd.Series) -> pd.DataFrame:
        return rows(a)

    def one_guarded(a: pd.Series) -> pd.DataFrame:
        return permissive(a)

    def two_guarded(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return permissive(a, b)

    guarded = f"struct<value:{name},error_class:string,error_message:string,error_index:int>"

    def call(*columns: Column | str) -> Column:
        if mode == "permissive":
            made = F.pandas_udf(one_guarded if len(columns) == 1 else two_guarded, guarded)
        else:
            made = F.pandas_udf((one_row if struct else one) if len(columns) == 1 else two, name)
        # said to vary, for else filters on a result (also those Spark infers for joins) are copied below the
        # aggregation to distinct words, where the kernel would run for each occurrence
        return made.asNondeterministic()(*columns)

    return call


def _absent(v) -> bool:
    return v is None or v is pd.NA or isinstance(v, float) and v != v


# words to units ---------------------------------------------------------------------------------------------------
def shape(word: Column | str, mode: str = "strict") -> Column:
    """The written units that are visible, without duplicates and idle controls."""
    return _mapped(lambda w: list(kernel.shape(w)), UNITS, mode)(word)


def shape_raw(word: Column | str, mode: str = "strict") -> Column:
    """The units as the rules give them, nothing removed."""
    return _mapped(lambda w: list(kernel.shape_raw(w)), UNITS, mode)(word)


def shape_str(word: Column | str, mode: str = "strict") -> Column:
    """The shape joined by +; the cheapest key to group and join by."""
    return _mapped(lambda w: "+".join(kernel.shape(w)), "string", mode)(word)


def shape_raw_str(word: Column | str, mode: str = "strict") -> Column:
    return _mapped(lambda w: "+".join(kernel.shape_raw(w)), "string", mode)(word)


def same_shape(a: Column | str, b: Column | str, mode: str = "strict") -> Column:
    return _mapped(lambda x, y: kernel.shape(x) == kernel.shape(y), "boolean", mode)(a, b)


def shape_detailed(word: Column | str, mode: str = "strict") -> Column:
    """Code point, alias, position, first FVS, condition and units of each token."""
    return _mapped(kernel.detail, DETAIL, mode)(word)


def trace(word: Column | str) -> Column:
    """What each rule changed."""
    return _mapped(kernel.trace, TRACE, "strict")(word)


# units to words ---------------------------------------------------------------------------------------------------
def normalize(word: Column | str, mode: str = "strict") -> Column:
    lenient = mode == "lenient"
    return _mapped(lambda w: kernel.normalize(w, lenient), "string", "strict" if lenient else mode)(word)


def normalize_text(text: Column | str, mode: str = "strict") -> Column:
    """Runs of word characters normalised, the rest as it is."""
    lenient = mode == "lenient"
    return _mapped(lambda t: kernel.normalize_text(t, lenient), "string", "strict" if lenient else mode)(text)


def normalize_written_units(units: Column | str, mode: str = "strict") -> Column:
    return _mapped(lambda u: kernel.encode_units(tuple(u)), "string", mode)(units)


def normalize_positioned_written_units(records: Column | str, mode: str = "strict") -> Column:
    """records: array<struct<unit, position>>."""
    return _mapped(lambda r: kernel.encode_positioned([(x["unit"], x["position"]) for x in r]), "string", mode)(records)


def normalize_positioned_json(text: Column | str, mode: str = "strict") -> Column:
    """The same from records in JSON, whose form is checked first."""
    return _mapped(kernel.encode_json, "string", mode)(text)


def normalize_unit_text(text: Column | str, mode: str = "strict") -> Column:
    """The canonical spelling of units as text, with or without separators."""
    return _mapped(lambda t: kernel.encode_units(kernel.parse_units(t)), "string", mode)(text)


def parse_written_units(text: Column | str, mode: str = "strict") -> Column:
    return _mapped(lambda t: list(kernel.parse_units(t)), UNITS, mode)(text)


def expand_units(units: Column | str) -> Column:
    return _mapped(lambda u: list(kernel.expand(tuple(u))), UNITS, "strict")(units)


def control_rounds(units: Column | str) -> Column:
    return _mapped(lambda u: list(kernel.control_rounds(tuple(u))), UNITS, "strict")(units)


def contract_units(units: Column | str) -> Column:
    return _mapped(lambda u: list(kernel.contract(tuple(u))), UNITS, "strict")(units)


def canonical_units(units: Column | str) -> Column:
    return _mapped(lambda u: list(kernel.canonical_units(tuple(u))), UNITS, "strict")(units)


# native -----------------------------------------------------------------------------------------------------------
def canonical_version() -> Column:
    """The version of the canonical spelling, to be stored beside keys that are made by it."""
    return F.lit(tables.CANONICAL_VERSION)


def version() -> Column:
    """The version of this engine."""
    return F.lit(tables.VERSION)


def locale() -> Column:
    return F.lit(tables.LOCALE)


def expected_units(text: Column, breaks: str = "_ -") -> Column:
    """The expected units of a conformance table as an array: the names of `breaks` are Mvs, Ni is Nirugu, and marks of
    word ends and selectors are none."""
    names = F.filter(F.split(F.trim(text), r"\s+"), lambda u: ~u.rlike("^([<>]|Fvs[1-4]|Nnbsp)?$") | u.isin(*breaks.split()))
    return F.transform(names, lambda u: F.when(u.isin(*breaks.split()), "Mvs").when(u == "Ni", "Nirugu").otherwise(u))


def is_mongolian_letter(char: Column) -> Column:
    return char.rlike(f"^[{LETTER_CLASS}]$")


def is_mongolian_word_char(char: Column) -> Column:
    return char.rlike(f"^[{WORD_CLASS}]$")


def check_word_chars(word: Column) -> Column:
    """The first character that no word has, as a struct of index (from 0) and ch; null if there is none."""
    at = F.regexp_instr(word, F.lit(f"[^{WORD_CLASS}]"))
    return F.when(at > 0, F.struct((at - 1).cast("int").alias("index"), F.substring(word, at, F.lit(1)).alias("ch")))


def words_in(text: Column) -> Column:
    """All maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(f"[{WORD_CLASS}]+"), F.lit(0))


def tokens(word: Column) -> Column:
    """array<struct<ch, kind, fvs>>: a character and the FVS after it; kinds are letter, mvs, joiner and zwnj."""
    bare = F.regexp_replace(word, f"^[{FVS_CLASS}]+", "")
    parts = F.regexp_extract_all(bare, F.lit(f"[^{FVS_CLASS}][{FVS_CLASS}]*"), F.lit(0))

    def token(p: Column) -> Column:
        ch = F.translate(F.substring(p, 1, 1), "\u202f", "\u180e")
        kind = F.when(is_mongolian_letter(ch), "letter").when(ch == "\u180e", "mvs").when(ch == "\u200c", "zwnj").otherwise("joiner")
        return F.struct(ch.alias("ch"), kind.alias("kind"), F.substring(p, F.lit(2), F.length(p)).alias("fvs"))

    return F.transform(parts, token)


def token_positions(tokens: Column) -> Column:
    """The position of each token: which of its neighbours join it."""
    joins = lambda t: t["kind"].isin("letter", "joiner")

    def place(t: Column, i: Column) -> Column:
        left = (i > 0) & joins(F.get(tokens, i - 1))
        right = (i + 1 < F.size(tokens)) & joins(F.get(tokens, i + 1))
        joined = F.when(left & right, "medi").when(right, "init").when(left, "fina").otherwise("isol")
        return F.when(t["kind"] == "letter", joined).otherwise("isol")

    return F.transform(tokens, place)


def code_points(text: Column) -> Column:
    """Hexadecimal code points, four digits at least."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c)), 4, "0")), " ")


def from_code_points(cps: Column) -> Column:
    """A text from an array of code points below 65,536."""
    wide = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(cps, wide), "")


def spell_aliases(aliases: Column) -> Column:
    """A word from its aliases: 't a l mvs a'. An unknown alias fails the query."""
    known = {**tables.catalogue().char, "mvs": tables.MVS, "nnbsp": tables.NNBSP, "nirugu": tables.NIRUGU, "zwj": tables.ZWJ, "zwnj": tables.ZWNJ, **{f"fvs{n}": c for n, c in tables.FVS.items()}}
    pairs = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.array_join(F.transform(F.split(F.trim(aliases), r"\s+"), lambda a: F.coalesce(F.try_element_at(pairs, a), F.raise_error(F.concat(F.lit("unknown alias "), a)))), "")


def middle(a: Column, b: Column) -> Column:
    """What is left of two arrays without their common start and end, as a struct of a and b joined by +."""

    def common(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        same = F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda p, q: p == q)
        return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, least).cast("int")

    start = common(a, b)
    rest = lambda x: F.slice(x, start + 1, F.size(x))
    end = common(F.reverse(rest(a)), F.reverse(rest(b)))
    left = lambda x: F.array_join(F.slice(x, start + 1, F.size(x) - start - end), "+")
    return F.struct(left(a).alias("a"), left(b).alias("b"))
