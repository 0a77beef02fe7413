"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn is an example of its own: all turns before it are the context, and only its reply is
trainable. `format_chat` gives two tables: `segments` has each turn once, rendered by the template, with its place
in the conversation's text; `examples` has for each assistant turn how many segments it takes and its loss span.
`expand` writes the examples out, each with its whole context, and `read_back` reads nothing else: the loss of each
example at its span, the turns that it has beyond the example before it, and its context, which must be the text of
that example. Written out, examples grow with the square of a conversation's turns; they are made row by row in the
task that reads or writes them, so only what is asked of them is shuffled. Places and starts are found in two steps,
within chunks of CHUNK turn numbers and over the chunks of a conversation. A conversation of over CHUNK turns is
expanded in up to PARTS parts, each a group that is sent the turns up to its end. So a conversation of any length is
dealt over tasks; a text is a string, of 2 GB at most, and only the read-back brings one conversation's turns, each
once, into a row.

The template marks a turn as <s>[ROLE] text [/ROLE]</s>; inside texts a backslash goes before each backslash, <, [
and ], so that marks never occur in them, and reading removes it again.

Turns are ordered by number, repeated numbers by role and text; null numbers come first. Null text or role is
empty; rows with a null conv_id form one conversation. An empty text gives a turn without characters, an empty table
none. Repeated rows are turns of their own; texts are whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Turn numbers, and places, that are dealt to one group; of long conversations more places, so that groups are PARTS at
#: most: a turn is sent to its group and all later ones.
CHUNK = 256
PARTS = 16
#: The role in an opening mark, still escaped.
ROLE = r"^<s>\[((?:[^\]\\]|\\.)*)\] "
#: Ends each reply, and occurs nowhere else.
REPLY = " [/assistant]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<\[\]])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def opening(role: Column) -> Column:
    return F.concat(F.lit("<s>["), escape(role), F.lit("] "))


def closing(role: Column) -> Column:
    return F.concat(F.lit(" [/"), escape(role), F.lit("]</s>"))


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, place, role, text, n, start, n_turns): each turn's place from 0, start in code points, conversation's turns."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    # escaping adds a character for each that it escapes
    size = lambda c: 2 * F.length(c) - F.length(F.translate(c, r"\<[]", ""))
    n = (size(text) + 2 * size(role) + F.lit(len("<s>[]  [/]</s>"))).cast("long")
    # null keys as values of their own: what joins by plain equality is dealt once, for the windows too
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    chunk = F.coalesce(F.floor(F.col(turn) / CHUNK).cast("long"), F.lit(-(1 << 63)))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"), key.alias("key"), chunk.alias("chunk"))
    line = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("chars"))
    before = lambda c: F.coalesce(F.sum(c).over(line), F.lit(0).cast("long")).alias(f"{c}_before")
    chunks = chunks.select("key", "chunk", before("turns"), before("chars"), F.sum("turns").over(Window.partitionBy("key")).alias("n_turns"))
    within = Window.partitionBy("key", "chunk").orderBy("turn", "role", "text")
    ahead = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = (F.col("turns_before") + F.row_number().over(within) - 1).cast("int")
    return rows.join(chunks, ["key", "chunk"]).select("conv_id", place.alias("place"), "role", "text", "n", (F.col("chars_before") + ahead).alias("start"), "n_turns")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """segments (conv_id, place, segment, start long, n_turns long) and examples (conv_id, place, n_segments, loss_start
    long, loss_end long, n_chars long, n_turns long); places from 0, starts and ends in code points of the
    conversation's text, n_turns all its turns."""
    placed = _placed(turns, conv, turn, role, text)
    segment = F.concat(opening(F.col("role")), escape(F.col("text")), closing(F.col("role")))
    head = F.length(opening(F.col("role"))).cast("long")
    tail = F.length(closing(F.col("role"))).cast("long")
    examples = placed.where(F.col("role") == "assistant").select(
        "conv_id", "place", (F.col("place") + 1).alias("n_segments"), (F.col("start") + head).alias("loss_start"), (F.col("start") + F.col("n") - tail).alias("loss_end"), (F.col("start") + F.col("n")).alias("n_chars"), "n_turns"
    )
    return placed.select("conv_id", "place", segment.alias("segment"), "start", "n_turns"), examples


def expand(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, place, text, loss_start, loss_end): every example written out, its context and its reply. Turns after
    the last reply have an example without target (null span), so that the examples hold every turn."""
    width = F.greatest(F.lit(CHUNK), F.ceil(F.col("n_turns") / PARTS)).cast("long")
    part = lambda place: F.floor(place / width).cast("long")
    last = part(F.col("n_turns") - 1)
    spans = ("n_segments", "loss_start", "loss_end")
    kinds = {"n_segments": "int", "loss_start": "long", "loss_end": "long"}
    rows = segments.select("conv_id", "n_turns", F.explode(F.sequence(part(F.col("place")), last)).alias("part"), "place", "segment", "start", *(F.lit(None).cast(kinds[c]).alias(c) for c in spans))
    rows = rows.unionByName(examples.select("conv_id", "n_turns", part(F.col("place")).alias("part"), "place", F.lit(None).cast("string").alias("segment"), F.lit(None).cast("long").alias("start"), *(F.col(c).cast(kinds[c]).alias(c) for c in spans)))
    listed = lambda which, *columns: F.array_sort(F.collect_list(F.when(F.col(which).isNotNull(), F.struct(*columns))))
    parts = rows.groupBy("conv_id", "n_turns", "part").agg(listed("segment", "start", "segment").alias("s"), listed("n_segments", "place", *spans).alias("e"))
    first = (F.col("part") * width).cast("int")
    untaught = F.struct((F.col("n_turns") - 1).cast("int").alias("place"), F.col("n_turns").cast("int").alias("n_segments"), F.lit(None).cast("long").alias("loss_start"), F.lit(None).cast("long").alias("loss_end"))
    open_end = (F.col("part") == last) & ~F.exists("e", lambda x: x["n_segments"] == F.col("n_turns"))
    segment = lambda x: x["segment"]
    before = F.array_join(F.transform(F.slice("s", F.lit(1), first), segment), "").alias("before")
    own = F.transform(F.slice("s", first + 1, F.size("s")), segment).alias("own")
    parts = parts.select("conv_id", first.alias("first"), before, own, F.when(open_end, F.array_append("e", untaught)).otherwise(F.col("e")).alias("e"))
    rows = parts.select("conv_id", "first", "before", "own", F.explode("e").alias("e"))
    text = F.concat("before", F.array_join(F.slice("own", F.lit(1), F.col("e.n_segments") - F.col("first")), ""))
    return rows.select("conv_id", "e.place", text.alias("text"), "e.loss_start", "e.loss_end")


def materialize(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, place, text, loss_start, loss_end): whole texts, each with its context; replies only."""
    return expand(segments, examples).where(F.col("loss_start").isNotNull())


def read_back(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation what a reader of the written-out examples finds: the turns, what is under the loss masks, and
    the characters of the examples with a target. Fails if a context isn't the text of the example before it."""
    text, target = F.col("text"), F.col("loss_start").isNotNull()
    # an example goes beyond the one before it with all that follows the last reply but its own
    new = F.call_function("substring_index", text, F.lit(REPLY), F.when(target, -2).otherwise(-1))
    rows = expand(segments, examples).select("*", F.length("text").alias("n"), new.alias("new"))
    head = F.col("n") - F.length("new")
    # the same characters of the text, without counting through the context where the span is behind it
    span = lambda of, start: F.substring(of, (start + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    loss = F.when(F.col("loss_start") >= head, span(F.col("new"), F.col("loss_start") - head)).otherwise(span(text, F.col("loss_start")))
    raw = text.cast("binary")
    context = F.substring(raw, F.lit(1), F.octet_length("text") - F.octet_length("new"))
    rows = rows.select("conv_id", "place", F.xxhash64(context).alias("context"), F.xxhash64(raw).alias("whole"), F.when(target, F.col("n")).otherwise(0).cast("long").alias("chars"), F.coalesce(loss, F.lit("")).alias("loss"), F.split("new", r"\]</s>").alias("new"))

    def read(x: Column) -> Column:
        raw = F.regexp_extract(x, ROLE, 1)
        marks = F.length(raw) + F.lit(len("<s>[] "))
        own = F.substring(x, marks + 1, F.length(x) - marks - F.length(raw) - F.lit(len(" [/")))
        return F.concat(unescape(raw), F.lit("\n"), unescape(own), F.lit("\n"))

    n = (F.size("new") - 1).alias("n")  # nothing follows the last mark
    turns = F.array_join(F.transform(F.slice("new", F.lit(1), F.size("new") - 1), read), "").alias("turns")
    rows = rows.select("conv_id", F.struct("place", "context", "whole", n, turns, unescape(F.col("loss")).alias("loss"), "chars").alias("p"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    start = F.struct(F.xxhash64(F.lit("").cast("binary")).alias("hash"), F.lit(True).alias("alike"))
    alike = F.aggregate("p", start, lambda s, x: F.struct(x["whole"].alias("hash"), (s["alike"] & (s["hash"] == x["context"])).alias("alike")))["alike"]
    joined = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    total = lambda f: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[f])
    turns = F.when(alike, joined("turns")).otherwise(F.raise_error(F.lit("a context differs from the example before it")))
    return whole.select("conv_id", total("n").alias("n_turns"), turns.alias("turns"), joined("loss").alias("loss"), total("chars").alias("formatted_chars"))
