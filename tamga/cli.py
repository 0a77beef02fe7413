"""Command line: python -m tamga.cli VERB [TEXT] for single texts, files and their lines.

Verbs are shape, normalize, normalize-written-units, normalize-text and same. It exits with 0, with 1 when `same`
finds different shapes, with 2 on wrong usage or input. With --batch every line is done on its own by Spark, and the
first line that fails is named.
"""

from __future__ import annotations

import argparse
import sys

from tamga import kernel, tables

VERBS = {
    "shape": lambda t, lenient: "+".join(kernel.shape(t)),
    "normalize": kernel.normalize,
    "normalize-written-units": lambda t, lenient: kernel.encode_units(kernel.parse_units(t)),
    "normalize-text": kernel.normalize_text,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamga", description=__doc__)
    p.add_argument("verb", choices=[*VERBS, "same"])
    p.add_argument("text", nargs="*")
    p.add_argument("--locale", default=tables.LOCALE, choices=[tables.LOCALE])
    p.add_argument("--batch", action="store_true", help="do each line")
    p.add_argument("-i", "--input", help="a file to read instead of TEXT or standard input")
    p.add_argument("-o", "--output", help="a file to write")
    p.add_argument("--allow-fallback", action="store_true", help="keep words without canonical spelling")
    return p


def batch(verb: str, text: str, lenient: bool) -> str:
    """All lines by Spark; the input's last end of line stays."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tamga import functions as fn
    from tamga import sources

    spark = SparkSession.builder.getOrCreate()
    lines = sources.explode_lines(sources.inline(spark, text))
    column = F.col("line")
    mode = "lenient" if lenient else "permissive"
    mode = mode if verb in ("normalize", "normalize-text") else "permissive"
    run = {"normalize-written-units": lambda: fn.normalize_unit_text(column, mode), "shape": lambda: fn.shape_str(column, "permissive"), "normalize": lambda: fn.normalize(column, mode), "normalize-text": lambda: fn.normalize_text(column, mode)}
    done = lines.withColumn("r", run[verb]()).orderBy("number")
    rows = []
    for r in done.toLocalIterator():
        if isinstance(r.r, str):
            rows.append((r.number, r.r))
        elif r.r.error_class:
            raise kernel.WordError(r.r.error_class, f"line {r.number}: {r.r.error_message}")
        else:
            rows.append((r.number, r.r.value))
    return "\n".join(v for _, v in rows) + "\n" * text.endswith(("\n", "\r"))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.verb == "same":
            if len(a.text) != 2:
                raise ValueError("same takes two words")
            return int(kernel.shape(a.text[0]) != kernel.shape(a.text[1]))
        if len(a.text) > 1 or a.text and a.input:
            raise ValueError("one text only")
        if a.input:
            with open(a.input, "rb") as f:
                text = f.read().decode()
        else:
            text = a.text[0] if a.text and a.text[0] != "-" else sys.stdin.read()
        out = batch(a.verb, text, a.allow_fallback) if a.batch else VERBS[a.verb](text, a.allow_fallback)
    except (ValueError, OSError) as e:
        print(f"tamga: {e}", file=sys.stderr)
        return 2
    if a.output:
        with open(a.output, "wb") as f:
            f.write(out.encode())
    else:
        print(out, end="" if out.endswith("\n") else "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
