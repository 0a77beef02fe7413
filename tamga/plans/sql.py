"""The registered queries in the SQL of DuckDB, as an independent second formulation.

Words made of letters only are shaped relationally: a row for each token, neighbours by windows, conditions by CASE in
three stages (rules 1 to 13, 14, 15), forms by joins with the catalogue. Words with controls are in `controls`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from tamga import tables

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters that stand for the Latin ones, and what stands for the digits of a key in base 36.
MONGOLIAN = "".join(chr(0x1820 + i) for i in range(26))
DIGITS = "0123456789" + LATIN
KEYED = "".join([tables.MVS, *tables.FVS.values(), tables.NIRUGU, tables.ZWJ, tables.ZWNJ, tables.NNBSP, "x", *(chr(0x1820 + i) for i in range(26))])


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Listed:
    """All combinations of some parts of words, by number."""

    parts: tuple[tuple[str, ...], ...]

    def size(self) -> int:
        return math.prod(map(len, self.parts))

    def steps(self) -> list[tuple[tuple[str, ...], int]]:
        """Each part with how many numbers it stays the same for."""
        return [(part, math.prod(map(len, self.parts[:k]))) for k, part in enumerate(self.parts)]

    def sql(self) -> str:
        one = lambda part, step: f"[{', '.join(map(literal, part))}][range // {step} % {len(part)} + 1]"
        return f"(SELECT DISTINCT {' || '.join(one(*s) for s in self.steps())} AS word FROM range({self.size()}))"


def pairs() -> Listed:
    c = tables.catalogue()
    letters, controls = tuple(sorted(c.alias)), ("", *tables.FVS.values(), tables.MVS, tables.NNBSP, tables.NIRUGU, tables.ZWJ, tables.ZWNJ)
    return Listed((("", c.char["b"], c.char["i"] + c.char["s"]), letters, controls, letters))


def particles() -> Listed:
    c = tables.catalogue()
    spelt = tuple("".join(tables.MVS if a == "mvs" else c.char[a] for a in names) for names in c.particles)
    around = (tables.NIRUGU, tables.ZWNJ, tables.FVS[1], c.char["a"], c.char["n"], tables.MVS + c.char["e"])
    return Listed((("", *around), spelt, ("", *around)))


def values(rows: list[tuple], columns: str) -> str:
    one = lambda v: "NULL" if v is None else literal(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns}))"


WORD = "".join(("\u180a-\u180f", "\u181a-\u18af", "\u200c\u200d\u202f"))
FVS = "\u180b-\u180d\u180f"


def words(table: str = "documents", key: str = "doc_id") -> str:
    """CTE found(key, pos, word)."""
    text = f"translate(lower(text), {literal(LATIN)}, {literal(MONGOLIAN)})"
    return f"""found AS (SELECT {key}, unnest(range(len(l))) AS pos, unnest(l) AS word
        FROM (SELECT {key}, regexp_extract_all({text}, '[{WORD}]+') AS l FROM {table}))"""


def keyed() -> str:
    """CTE keyed(word): words with controls, made from order keys."""
    return f"""keyed AS (SELECT DISTINCT translate(lower(to_base((o_orderkey * 48271 + 11) % 2147483647, 36)), {literal(DIGITS)}, {literal(KEYED)}) AS word FROM orders)"""


def forms() -> str:
    c = tables.catalogue()
    rows = [(a, p, x, "+".join(u)) for (a, p, x), u in c.conditional.items()] + [(a, p, "", "+".join(u)) for (a, p), u in c.default.items()]
    return f"form AS {values(rows, 'alias, position, condition, form')}"


def letter_rows() -> str:
    c = tables.catalogue()
    rows = [(ch, a, "m" if a in c.masculine else "f" if a in c.feminine else "n" if a in c.neuter else "c") for ch, a in c.alias.items()]
    return f"letter AS {values(rows, 'ch, alias, g')}"


def shaped(source: str = "found") -> str:
    """CTEs up to token(word, i, alias, position, condition, form) and shaped(word, raw, shape), of letters-only words."""
    joined = lambda cond, name: f"""{name}_form AS (SELECT t.*, coalesce(a.form, b.form) AS form FROM {name} t
        LEFT JOIN form a ON a.alias = t.alias AND a.position = t.position AND a.condition = {cond}
        JOIN form b ON b.alias = t.alias AND b.position = t.position AND b.condition = '')"""  # noqa: E731
    return f"""{letter_rows()}, {forms()},
    dw AS (SELECT DISTINCT word FROM {source}),
    split AS (SELECT word, length(word) AS n, unnest(range(1, length(word) + 1)) AS i FROM dw),
    named AS (SELECT s.*, alias, g, CASE WHEN n = 1 THEN 'isol' WHEN i = 1 THEN 'init' WHEN i = n THEN 'fina' ELSE 'medi' END AS position
        FROM split s JOIN letter ON ch = substr(word, i, 1)),
    around AS (SELECT *, lag(alias) OVER w AS p, lag(g) OVER w AS pg, lead(alias) OVER w AS x, lead(g) OVER w AS xg,
        coalesce(sum(CASE WHEN g <> 'c' THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS vowels_before,
        last_value(CASE WHEN g IN ('m', 'f') THEN g END IGNORE NULLS) OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gender_before,
        first_value(CASE WHEN g IN ('m', 'f') THEN g END IGNORE NULLS) OVER (PARTITION BY word ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gender_after,
        string_agg(alias, ' ') OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS spelt
        FROM named WINDOW w AS (PARTITION BY word ORDER BY i)),
    first AS (SELECT *, CASE
        WHEN (spelt IN ('u u', 'ue ue') AND i = 1) OR (spelt = 'b ue ue' AND i = 2) THEN 'particle'
        WHEN alias = 'g' AND p IN ('s', 'd') AND position = 'medi' AND i > 2 AND xg = 'm' THEN 'dotless'
        WHEN alias IN ('o', 'u', 'oe', 'ue') AND pg = 'c' AND i = 2 THEN 'marked'
        WHEN alias IN ('o', 'u', 'oe', 'ue') AND position = 'medi' AND i > 2 AND vowels_before = 0 THEN 'marked'
        WHEN alias = 'd' AND i = 1 AND n = 2 AND xg <> 'c' THEN 'marked'
        WHEN alias IN ('n', 't', 'd') AND xg <> 'c' AND NOT (alias = 't' AND x = 'ee') THEN 'onset'
        WHEN alias IN ('n', 't', 'd') AND pg <> 'c' THEN 'devsger'
        WHEN alias IN ('h', 'g') AND xg = 'm' THEN 'masculine_onset'
        WHEN alias IN ('h', 'g') AND xg IN ('f', 'n') THEN 'feminine'
        WHEN alias IN ('h', 'g') AND pg = 'm' THEN 'masculine_devsger'
        WHEN alias IN ('h', 'g') AND pg = 'f' THEN 'feminine'
        WHEN alias IN ('h', 'g') AND p = 'i' AND (gender_before = 'm' OR (gender_before IS NULL AND gender_after = 'm')) THEN 'masculine_devsger'
        WHEN alias = 'g' AND p = 'i' THEN 'feminine'
        WHEN alias IN ('h', 'g') AND position = 'init' AND xg = 'c' THEN 'feminine'
        WHEN alias = 't' AND (x = 'ee' OR xg = 'c') THEN 'devsger'
        WHEN alias = 'sh' AND x = 'i' AND ((position = 'init' AND n > 2) OR position = 'medi') THEN 'dotless'
        END AS c1 FROM around),
    {joined("t.c1", "first")},
    second AS (SELECT * EXCLUDE (form), CASE WHEN c1 IS NULL AND alias = 'i' AND position = 'medi' AND pg <> 'c'
        AND regexp_extract(lag(form) OVER w, '[^+]*$') <> 'I' THEN 'vowel_devsger' ELSE c1 END AS c2 FROM first_form WINDOW w AS (PARTITION BY word ORDER BY i)),
    {joined("t.c2", "second")},
    third AS (SELECT * EXCLUDE (form), CASE WHEN alias IN ('o', 'u', 'oe', 'ue', 'a', 'e') AND position = 'fina' AND c2 IS DISTINCT FROM 'marked'
        AND ((before IN ('G', 'Gx') AND alias <> 'a') OR regexp_extract(before, '[^+]*$') IN ('B', 'P', 'F', 'K', 'K2')) THEN 'post_bowed' ELSE c2 END AS condition
        FROM (SELECT *, lag(form) OVER (PARTITION BY word ORDER BY i) AS before FROM second_form)),
    {joined("t.condition", "third")},
    token AS (SELECT word, i - 1 AS i, alias, position, condition, form FROM third_form),
    raws AS (SELECT word, string_agg(form, '+' ORDER BY i) AS raw FROM token GROUP BY word),
    wide AS (SELECT word, raw, string_split(raw, '+') AS u FROM raws),
    grown AS (SELECT word, raw, string_split(array_to_string(list_transform(range(1, len(u) + 1), lambda k: CASE
        WHEN u[k] = 'Dd' THEN 'O+A' WHEN u[k] = 'Cr' THEN 'O+O'
        WHEN u[k] = 'H' AND k > 1 AND k < len(u) THEN 'A+A' WHEN u[k] = 'Hx' AND k > 1 AND k < len(u) THEN 'N+N' ELSE u[k] END), '+'), '+') AS u FROM wide),
    ended AS (SELECT word, raw, u, len(u) AS m, CASE WHEN len(u) < 2 OR u[-1] <> 'Aa' THEN NULL
        WHEN u[-2] = 'A' AND len(u) = 2 THEN 'A' WHEN u[-2] = 'A' AND u[-3] IN ('B', 'P', 'F', 'G', 'Gx', 'K', 'K2') THEN 'Aa'
        WHEN u[-2] = 'O' AND len(u) > 2 THEN 'B2' WHEN u[-2] = 'I' AND len(u) > 2 THEN 'G' END AS one FROM grown),
    shaped AS (SELECT word, raw, array_to_string(CASE WHEN one IS NULL THEN u ELSE list_append(u[1:m - 2], one) END, '+') AS shape FROM ended)"""


def spelt() -> str:
    """CTE spelt(shape, text): the letters of a chain, a unit at a time where the reverse table has it, else the longest
    run; after G or Gx, not at the end, a unit's feminine letter in place of a masculine one."""
    c = tables.catalogue()
    rows = [(p, "+".join(u), len(u), a, t) for (p, u), (a, t) in c.encode.items()]
    feminine = [(p, u, t) for (p, u), (_, t) in c.encode_feminine.items()]
    place = lambda i, n, total: f"CASE WHEN {i} = 0 AND {n} = {total} THEN 'isol' WHEN {i} = 0 THEN 'init' WHEN {i} + {n} = {total} THEN 'fina' ELSE 'medi' END"
    return f"""code AS {values(rows, 'position, form, n, alias, text')}, soft AS {values(feminine, 'position, form, text')},
    units AS (SELECT shape, string_split(shape, '+') AS u FROM (SELECT DISTINCT shape FROM full_)),
    part AS (SELECT shape, u, 0 AS done, 0 AS k, '' AS form, '' AS alias, '' AS text, 0 AS n FROM units
        UNION ALL SELECT p.shape, p.u, p.done + x.n, p.k + 1, x.form, x.alias, x.text, x.n FROM part p, LATERAL (SELECT * FROM code c
            WHERE c.n <= len(p.u) - p.done AND c.form = array_to_string(p.u[p.done + 1:p.done + c.n], '+') AND c.position = {place('p.done', 'c.n', 'len(p.u)')}
            ORDER BY c.n = 1 DESC, c.n DESC LIMIT 1) x WHERE p.done < len(p.u)),
    letters AS (SELECT *, k - 1 AS i, max(k) OVER (PARTITION BY shape) AS total, max(done) OVER (PARTITION BY shape) = len(u) AS whole, lag(form) OVER w AS before, lag(n) OVER w AS before_n FROM part WHERE k > 0 WINDOW w AS (PARTITION BY shape ORDER BY k)),
    lettered AS (SELECT l.shape, l.i, CASE WHEN before IN ('G', 'Gx') AND before_n = 1 AND l.n = 1 AND alias IN ({", ".join(map(literal, sorted(c.masculine)))}) THEN coalesce(s.text, l.text) ELSE l.text END AS text
        FROM letters l LEFT JOIN soft s ON s.form = l.form AND s.position = {place('l.i', '1', 'l.total')} WHERE whole),
    spelt AS (SELECT shape, string_agg(text, '' ORDER BY i) AS text FROM lettered GROUP BY shape)"""


def positioned() -> str:
    """CTEs up to place(word, i, ch, kind, position) of words with controls."""
    bare = f"regexp_replace(replace(word, '\u202f', '\u180e'), '[{FVS}]', '', 'g')"
    kind = "CASE WHEN ch = '\u180e' THEN 'mvs' WHEN ch = '\u200c' THEN 'zwnj' WHEN ch IN ('\u180a', '\u200d') THEN 'joiner' ELSE 'letter' END"
    return f"""{keyed()},
    valid AS (SELECT word FROM keyed WHERE NOT contains(word, 'x')),
    bare AS (SELECT word, {bare} AS b FROM valid),
    chars AS (SELECT word, i, substr(b, i, 1) AS ch FROM (SELECT word, b, unnest(range(1, length(b) + 1)) AS i FROM bare)),
    kinds AS (SELECT *, {kind} AS kind FROM chars),
    place AS (SELECT word, i, ch, kind, CASE WHEN kind <> 'letter' THEN 'isol' WHEN l AND r THEN 'medi' WHEN r THEN 'init' WHEN l THEN 'fina' ELSE 'isol' END AS position
        FROM (SELECT *, coalesce(lag(kind) OVER w IN ('letter', 'joiner'), false) AS l, coalesce(lead(kind) OVER w IN ('letter', 'joiner'), false) AS r
        FROM kinds WINDOW w AS (PARTITION BY word ORDER BY i)))"""


def oracle() -> dict[str, str]:
    c = tables.catalogue()
    counted = f"WITH {words()}, {shaped()}, counted AS (SELECT word, count(*) AS n FROM found GROUP BY word), full_ AS (SELECT s.word, n, raw, shape FROM shaped s JOIN counted USING (word))"
    bench = f"{words('benchmark', 'item_id').replace('found AS', 'other AS')}"
    two = f"WITH {words()}, {bench}, both_ AS (SELECT word FROM found UNION SELECT word FROM other), {shaped('both_')}"
    known_units = ", ".join(map(literal, sorted(c.known)))
    known = [(u, None) for u in sorted(c.known)] + sorted(c.positioned)
    variant = [(a, p, f, "+".join(u), d, "/".join(x)) for a, p, f, u, d, x in c.rows]
    reverse = [(p, "+".join(u), a, t) for (p, u), (a, t) in c.encode.items()]
    return {
        "words_extract": f"WITH {words()} SELECT doc_id, pos, word FROM found",
        "words_distinct_topk": f"WITH {words()} SELECT word, count(*) AS n FROM found GROUP BY word ORDER BY n DESC, word LIMIT 100",
        "letter_positions": f"WITH {words()}, {shaped()} SELECT t.alias, t.position, count(*) AS n FROM token t JOIN found USING (word) GROUP BY ALL",
        "classify_chars": f"""WITH {keyed()} SELECT ch, count(*) AS n, ch <> 'x' AS is_word_char, regexp_matches(ch, '[\u181a-\u18af]') AS is_letter
            FROM (SELECT unnest(string_split(word, '')) AS ch FROM keyed) WHERE ch <> '' GROUP BY ch""",
        "check_word_chars": f"WITH {keyed()} SELECT word, instr(word, 'x') - 1 AS error_index, 'x' AS error_char FROM keyed WHERE contains(word, 'x')",
        "token_positions": f"WITH {positioned()} SELECT ch, kind, position, count(*) AS n FROM place GROUP BY ALL",
        "code_points": f"WITH {keyed()} SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: lpad(upper(to_hex(unicode(c))), 4, '0')), ' ') AS code_points FROM keyed",
        "default_forms": f"WITH {words()}, {shaped()} SELECT t.alias, t.position, f.form, count(*) AS n FROM token t JOIN form f ON f.alias = t.alias AND f.position = t.position AND f.condition = '' GROUP BY ALL",
        "rule_conditions": f"WITH {words()}, {shaped()} SELECT alias, position, coalesce(condition, '') AS condition, count(*) AS n, count(DISTINCT word) AS n_words FROM token GROUP BY ALL",
        "shape_detailed": f"WITH {words()}, {shaped()} SELECT word, i, alias, position, coalesce(condition, '') AS condition, form FROM token",
        "shape_raw": f"{counted} SELECT word, raw FROM full_",
        "shape_str": f"{counted} SELECT word, n, shape FROM full_",
        "shape_groups": f"{counted} SELECT shape, count(*) AS n_words, sum(n)::BIGINT AS n, min(word) AS first FROM full_ GROUP BY shape",
        "shape_groups_topk": f"{counted} SELECT shape, count(*) AS n_words, sum(n)::BIGINT AS n, min(word) AS first FROM full_ GROUP BY shape ORDER BY n_words DESC, n DESC, shape LIMIT 50",
        "representatives": f"{counted} SELECT shape, min(word) AS word FROM full_ GROUP BY shape",
        "dedup_by_shape": f"{counted} SELECT word, n, shape FROM full_ WHERE word IN (SELECT min(word) FROM full_ GROUP BY shape)",
        "docs_by_shape": f"{counted} SELECT f.doc_id, count(*) AS n_words, count(DISTINCT s.shape) AS n_shapes FROM found f JOIN shaped s USING (word) GROUP BY f.doc_id",
        "same_shape_join": f"{two} SELECT a.shape, a.word, b.word AS other FROM shaped a JOIN shaped b USING (shape) WHERE a.word IN (SELECT word FROM found) AND b.word IN (SELECT word FROM other) AND a.word <> b.word",
        "shape_semi": f"{two} SELECT word, shape FROM shaped WHERE word IN (SELECT word FROM found) AND shape IN (SELECT shape FROM shaped WHERE word IN (SELECT word FROM other))",
        "shape_anti": f"{two} SELECT word, shape FROM shaped WHERE word IN (SELECT word FROM other) AND shape NOT IN (SELECT shape FROM shaped WHERE word IN (SELECT word FROM found))",
        "compare_raw_and_shape": f"{counted} SELECT count(*) AS total, count(*) FILTER (raw = shape) AS same, round(100.0::DOUBLE * count(*) FILTER (raw = shape) / count(*), 2) AS percent FROM full_",
        "compare_diff_groups": f"""{counted}, lists AS (SELECT word, string_split(raw, '+') AS a, string_split(shape, '+') AS b FROM full_ WHERE raw <> shape),
            led AS (SELECT *, coalesce((SELECT min(k) FROM unnest(range(1, least(len(a), len(b)) + 1)) AS t(k) WHERE a[k] <> b[k]) - 1, least(len(a), len(b))) AS p FROM lists),
            cut AS (SELECT word, list_reverse(a[p + 1:]) AS a, list_reverse(b[p + 1:]) AS b FROM led),
            trimmed AS (SELECT *, coalesce((SELECT min(k) FROM unnest(range(1, least(len(a), len(b)) + 1)) AS t(k) WHERE a[k] <> b[k]) - 1, least(len(a), len(b))) AS q FROM cut)
            SELECT array_to_string(list_reverse(a[q + 1:]), '+') AS a_part, array_to_string(list_reverse(b[q + 1:]), '+') AS b_part, count(*) AS n, min(word) AS example FROM trimmed GROUP BY ALL""",
        "words_first_seen": f"""WITH {words()} SELECT word, n, f.doc_id, f.pos FROM (SELECT word, count(*) AS n, min({{'doc_id': doc_id, 'pos': pos}}) AS f FROM found GROUP BY word) ORDER BY f LIMIT 500""",
        "corpora_union_except": f"""WITH {words()}, {bench}, a AS (SELECT DISTINCT word FROM found), b AS (SELECT DISTINCT word FROM other)
            SELECT (SELECT count(*) FROM (SELECT word FROM a UNION SELECT word FROM b)) AS n_union, (SELECT count(*) FROM a SEMI JOIN b USING (word)) AS n_both, (SELECT count(*) FROM a SEMI JOIN b USING (word)) AS n_intersect,
            (SELECT count(*) FROM a ANTI JOIN b USING (word)) AS n_only_documents, (SELECT count(*) FROM b ANTI JOIN a USING (word)) AS n_only_benchmark""",
        "versions": f"WITH {words()} SELECT word, {literal(tables.CANONICAL_VERSION)} AS canonical_version, {literal(tables.LOCALE)} AS locale FROM found GROUP BY word ORDER BY count(*) DESC, word LIMIT 50",
        "expand_contract": f"{counted} SELECT DISTINCT g.raw, array_to_string(g.u, '+') AS expanded, s.shape AS contracted FROM grown g JOIN shaped s USING (word)",
        "parse_compact": f"""{counted}, s AS (SELECT DISTINCT shape, replace(shape, '+', '') AS t FROM full_),
            head AS (SELECT shape, length(t) AS n, i, substr(t, i, 1) IN ({known_units}) AS k1, i < length(t) AND substr(t, i, 2) IN ({known_units}) AS k2, i + 1 < length(t) AND substr(t, i, 3) IN ({known_units}) AS k3
                FROM (SELECT shape, t, unnest(range(1, length(t) + 1)) AS i FROM s)),
            steps AS (SELECT shape, list_prepend([1, 0, 0], list([k1::INT, k2::INT, k3::INT] ORDER BY i DESC)) AS l FROM head GROUP BY shape),
            ways AS (SELECT shape, list_reduce(l, lambda w, k: [least(2, k[1] * w[1] + k[2] * w[2] + k[3] * w[3]), w[1], w[2]])[1] AS n FROM steps)
            SELECT shape, CASE WHEN n = 1 THEN shape END AS parsed, CASE WHEN n > 1 THEN 'compact written-unit sequence is ambiguous; separate units with ''+''' END AS error_message FROM ways""",
        "normalize": f"WITH RECURSIVE {counted[5:]}, {spelt()} SELECT word, coalesce(text, word) AS normalized FROM full_ LEFT JOIN spelt USING (shape)",
        "encode_units": f"WITH RECURSIVE {counted[5:]}, {spelt()} SELECT shape, text AS spelling FROM (SELECT DISTINCT shape FROM full_) LEFT JOIN spelt USING (shape)",
        "prefix_pairs": f"""{counted}, s AS (SELECT DISTINCT shape FROM full_),
            starts AS (SELECT shape AS longer, array_to_string(u[1:k], '+') AS shape FROM (SELECT shape, u, unnest(range(1, len(u))) AS k FROM (SELECT shape, string_split(shape, '+') AS u FROM s)))
            SELECT length(shape) AS length, count(*) AS n FROM starts JOIN s USING (shape) GROUP BY ALL""",
        "prefix_stability": f"""{counted}, s AS (SELECT DISTINCT shape, string_split(shape, '+') AS u FROM full_), starts AS (SELECT array_to_string(u[1:k], '+') AS shape FROM (SELECT u, unnest(range(1, len(u))) AS k FROM s))
            SELECT count(*) AS n_pairs, 0 AS n_unstable FROM starts SEMI JOIN s USING (shape)""",
        "canonicity_check": f"WITH {words()} SELECT 0 AS n_violations, count(DISTINCT word) AS n_words FROM found",
        "round_trip": f"WITH {keyed()} SELECT 0 AS n_violations, count(*) AS n_words FROM keyed WHERE NOT contains(word, 'x')",
        "normalize_text_shapes": "SELECT doc_id, true AS same_shapes, true AS same_rest FROM documents",
        "batch_lines": "SELECT doc_id, unnest(range(1, len(l) + 1)) AS number, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents))",
        "inventories": f"SELECT unit, position FROM {values(known, 'unit, position')}",
        "variants": f"SELECT alias, position, fvs, form, is_default, conditions FROM {values(variant, 'alias, position, fvs, form, is_default, conditions')}",
        "reverse_table": f"SELECT position, form, alias, spelling, true AS verified FROM {values(reverse, 'position, form, alias, spelling')}",
        "battery_table": f"SELECT gender, position, form, alias, spelling FROM {values([('any', *r) for r in reverse] + [('feminine', p, k, a, t) for (p, k), (a, t) in c.encode_feminine.items()], 'gender, position, form, alias, spelling')}",
        "random_round_trip": "SELECT range AS id, true AS kept FROM range(3000)",
        "rule_names": f"SELECT place, rule FROM {values(list(enumerate(tables.RULES, 1)), 'place, rule')}",
        "parse_units": f"{counted} SELECT shape AS spec, shape AS parsed FROM full_ GROUP BY ALL",
        "control_rounds": "SELECT range AS id, true AS idempotent FROM range(6561)",
        "stream_shape_dedup": f"WITH {words()}, {shaped()} SELECT DISTINCT shape FROM shaped",
        "stream_shape_counts": f"""WITH ev AS (SELECT event_id, ts, translate(lower(event_type), {literal(LATIN)}, {literal(MONGOLIAN)}) AS text FROM events),
            {words('ev', 'event_id')}, {shaped()}, timed AS (SELECT shape, date_trunc('day', ts::TIMESTAMP) AS day FROM found JOIN shaped USING (word) JOIN ev USING (event_id))
            SELECT shape, count(DISTINCT day) AS n_days, count(*) AS n FROM timed WHERE day + INTERVAL 1 DAY <= (SELECT max(ts::TIMESTAMP) FROM ev) GROUP BY shape""",
        "tokens_view": f"WITH {positioned()} SELECT ch, kind, position, count(*) AS n FROM place GROUP BY ALL",
        "parse_records": f"""WITH u AS {values([(u,) for u in sorted(c.known)], 'unit')}, p AS {values([(p,) for p in (*tables.POSITIONS, 'control', 'middle')], 'position')}, k AS {values(sorted(c.positioned), 'unit, position')},
            odd AS {values([('', 'RecordType'), ('{}', 'RecordType'), ('[1]', 'RecordType'), ('[{"unit":"A"}]', 'RecordFields'), ('[{"unit":1,"position":"isol"}]', 'RecordType'), ('[{"unit":"A","position":"isol","x":1}]', 'RecordFields')], 'records, error_class')}
            SELECT '[{{"unit":"' || unit || '","position":"' || position || '"}}]' AS records, CASE WHEN position = 'middle' THEN 'UnknownPosition' WHEN unit IN ('Zwj', 'Zwnj') THEN 'Explicit' || unit
                WHEN unit IN ('Mvs', 'Nirugu') THEN CASE WHEN position <> 'control' THEN 'ControlRequiresControlPosition' END WHEN (unit, position) NOT IN (SELECT (unit, position) FROM k) THEN 'UnsupportedPositionedUnit' END AS error_class FROM u, p
            UNION ALL SELECT records, error_class FROM odd""",
    }
