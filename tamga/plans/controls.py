"""Words with controls in the SQL of DuckDB: a row for each token, the word's lists beside it, a column for each rule.

Places count from 1. k, a, g, pos, v are a word's kinds (one string of L, M, J, Z), aliases, genders, positions and FVS
digits; l and r are where the run of joiners and breaks beside a token begins and where it has ended; pl and nl are the
letters next to it over that run, pb and nb what is next to it over a break. Units are one list for each word, and what
the rounds over its controls do is a recursive walk with one place at a time.
"""

from __future__ import annotations

from tamga import tables
from tamga.plans.sql import FVS, forms, keyed, letter_rows, literal, pairs, particles, values

ROUNDED = "('o', 'u', 'oe', 'ue')"
OPEN, CLOSED = "('init', 'medi')", "('fina', 'isol')"


def tokens() -> str:
    """CTEs up to tok: tokens of valid(word), their surroundings and their word's lists."""
    each = lambda body: f"list_transform(range(1, n + 1), lambda j: {body})"
    kind = lambda j: f"substr(k, {j}, 1)"
    letter_at = lambda j: f"CASE WHEN {j} >= 1 AND {j} <= n AND {kind(j)} = 'L' THEN {j} END"
    return f"""{letter_rows()}, {forms()},
    piece AS (SELECT word, regexp_extract_all(regexp_replace(word, '^[{FVS}]+', ''), '[^{FVS}][{FVS}]*') AS ps FROM valid),
    named AS (SELECT word, i, c, w, CASE c WHEN '{tables.MVS}' THEN 'M' WHEN '{tables.ZWNJ}' THEN 'Z' WHEN '{tables.NIRUGU}' THEN 'J' WHEN '{tables.ZWJ}' THEN 'J' ELSE 'L' END AS kind
        FROM (SELECT word, i, replace(substr(p, 1, 1), '{tables.NNBSP}', '{tables.MVS}') AS c, translate(substr(p, 2), {literal("".join(tables.FVS.values()))}, {literal("".join(map(str, tables.FVS)))}) AS w
            FROM (SELECT word, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM piece))),
    spread AS (SELECT word, count(*) AS n, string_agg(kind, '' ORDER BY i) AS k, list(alias ORDER BY i) AS a, list(letter.g ORDER BY i) AS g, list(w ORDER BY i) AS v, list(c ORDER BY i) AS chars
        FROM named LEFT JOIN letter ON ch = c GROUP BY word),
    runs AS (SELECT *, {each(f"CASE WHEN {kind('j')} <> 'L' THEN 'isol' WHEN j > 1 AND {kind('j - 1')} IN ('L', 'J') THEN CASE WHEN j < n AND {kind('j + 1')} IN ('L', 'J') THEN 'medi' ELSE 'fina' END WHEN j < n AND {kind('j + 1')} IN ('L', 'J') THEN 'init' ELSE 'isol' END")} AS pos,
        {each("j - length(regexp_extract(substr(k, 1, j - 1), '[JZ]*$'))")} AS l, {each("j + 1 + length(regexp_extract(substr(k, j + 1), '^[JZ]*'))")} AS r FROM spread),
    sides AS (SELECT *, {each(letter_at("l[j] - 1"))} AS pl, {each(letter_at("r[j]"))} AS nl,
        {each("CASE WHEN contains(substr(k, l[j], j - l[j]), 'Z') THEN nullif(l[j] - 1, 0) ELSE nullif(j - 1, 0) END")} AS pb,
        {each("CASE WHEN contains(substr(k, j + 1, r[j] - j - 1), 'Z') THEN nullif(r[j], n + 1) ELSE nullif(j + 1, n + 1) END")} AS nb,
        {each("array_to_string(v[j:r[j] - 1], '') <> ''")} AS marks FROM runs),
    -- the vowel after an MVS
    heard AS (SELECT *, {each(f"CASE WHEN {kind('nb[j]')} = 'L' THEN nb[j] END")} AS onset FROM sides),
    tok AS (SELECT h.*, i, h.a[i] AS me, h.pos[i] AS place, h.pl[i] AS p, h.nl[i] AS x, f.form AS sel
        FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM heard) h LEFT JOIN {values([(a, p, str(f), "+".join(u)) for (a, p, f), u in tables.catalogue().variant.items() if f], "alias, position, fvs, form")} f
        ON f.alias = h.a[i] AND f.position = h.pos[i] AND f.fvs = substr(h.v[i], 1, 1))"""


def _rules() -> list[str]:
    """The condition after each of the rules 1 to 12, as an expression over the one before it, c."""
    fvs = lambda a, b: f"array_to_string(v[{a}:{b} - 1], '')"
    kind = lambda j: f"substr(k, {j}, 1)"
    near_mvs = f"coalesce({kind('r[i]')} = 'M' AND a[onset[r[i]]] IN ('a', 'e') AND pos[onset[r[i]]] = 'isol', false)"
    # the letters that are reached from i without an MVS between
    back = lambda test: f"list_max(list_filter(range(1, i), lambda j: {kind('j')} = 'L' AND NOT contains(substr(k, j, i - j), 'M') AND ({test})))"
    ahead = lambda test: f"list_min(list_filter(range(i + 1, n + 1), lambda j: {kind('j')} = 'L' AND NOT contains(substr(k, i + 1, j - i), 'M') AND ({test})))"
    start = back(f"g[j] <> 'c' OR pos[j] IN ('isol', 'init')")
    gendered = back("g[j] IN ('m', 'f')")
    cut = f"len(list_filter(range({gendered} + 1, i + 1), lambda j: {kind('j')} = 'L' AND l[j] < j AND pos[j] NOT IN ('medi', 'fina'))) > 0"
    end = ahead(f"(g[j] = 'm' AND pos[j] IN ('medi', 'fina')) OR g[j] = 'f' OR pos[j] = 'isol' OR (pos[j] = 'fina' AND {kind('r[j]')} = 'M')")
    from_behind = f"CASE WHEN {end} IS NULL THEN false WHEN g[{end}] = 'm' AND pos[{end}] IN ('medi', 'fina') THEN true WHEN g[{end}] = 'f' OR pos[{end}] = 'isol' THEN false ELSE coalesce(a[nb[r[{end}]]] = 'a' AND pos[nb[r[{end}]]] = 'isol', false) END"
    reaches = f"CASE WHEN {gendered} IS NOT NULL AND NOT {cut} AND pos[{gendered}] IN {OPEN} THEN g[{gendered}] = 'm' ELSE {from_behind} END"
    mvs = "nb[i]"
    onset = f"onset[{mvs}]"
    free = "c IS NULL AND sel IS NULL"
    return [
        f"CASE WHEN me IN ('a', 'e') AND {kind('pb[i]')} = 'M' AND (pb[i] = i - 1 OR place = 'isol') THEN 'chachlag' END",
        f"CASE WHEN c IS NULL AND me IN {ROUNDED} AND g[p] = 'c' AND pos[p] = 'init' THEN 'marked' ELSE c END",
        f"CASE WHEN c = 'marked' AND me IN {ROUNDED} AND (marks[i] OR (place = 'fina' AND ({fvs('l[i]', 'i')} <> '' OR (l[i] > 1 AND v[l[i] - 1] <> '' AND {kind('l[i] - 1')} <> 'M')))) THEN NULL ELSE c END",
        f"CASE WHEN c IS NULL AND me IN ('oe', 'ue') AND place = 'fina' AND a[p] IN ('h', 'g') AND pos[p] = 'init' AND ({fvs('p', 'i')} IN ('2', '4') OR substr(v[p], 1, 1) IN ('2', '4')) THEN 'marked' ELSE c END",
        f"CASE WHEN c IS NULL AND me IN {ROUNDED} AND place = 'medi' AND NOT marks[i] AND g[{start}] = 'c' AND pos[{start}] = 'init' AND {start} <> p THEN 'marked' ELSE c END",
        f"CASE WHEN c IS NULL AND me = 'd' AND place = 'init' AND g[x] <> 'c' AND pos[x] = 'fina' AND (length({fvs('i', 'x')}) > 1 OR ({fvs('i', 'x')} = '' AND NOT marks[x])) THEN 'marked' ELSE c END",
        f"""CASE WHEN {free} AND me IN ('n', 'j', 'w', 'h', 'g') AND {kind(mvs)} = 'M' AND pos[{onset}] = 'isol' AND NOT (marks[{onset}] AND {fvs(mvs, onset)} = '') THEN
            CASE WHEN me = 'g' AND a[{onset}] = 'e' THEN 'chachlag_onset_gb' WHEN a[{onset}] = 'a' OR (a[{onset}] = 'e' AND me IN ('n', 'j', 'w')) THEN 'chachlag_onset' END ELSE c END""",
        "CASE WHEN c IS NOT NULL OR me IS NULL OR me NOT IN ('n', 't', 'd') THEN c WHEN g[x] <> 'c' AND NOT (me = 't' AND a[x] = 'ee') THEN 'onset' WHEN NOT (place = 'medi' AND x IS NULL) AND g[p] <> 'c' THEN 'devsger' END",
        f"""CASE WHEN NOT ({free}) OR me IS NULL OR me NOT IN ('h', 'g') OR {near_mvs} THEN c WHEN g[x] = 'm' THEN 'masculine_onset' WHEN g[x] IN ('f', 'n') THEN 'feminine'
            WHEN g[p] = 'm' AND place IN ('medi', 'fina') THEN 'masculine_devsger' WHEN g[p] = 'f' THEN 'feminine' WHEN a[p] = 'i' AND place IN ('medi', 'fina') AND {reaches} THEN 'masculine_devsger'
            WHEN a[p] = 'i' AND me = 'g' THEN 'feminine' WHEN place = 'init' AND g[x] = 'c' THEN 'feminine' END""",
        f"CASE WHEN {free} AND me = 't' AND (a[x] = 'ee' OR g[x] = 'c') THEN 'devsger' ELSE c END",
        f"""CASE WHEN {free} AND me = 'sh' AND a[x] = 'i' AND ((place = 'init' AND pos[x] = 'medi') OR (place = 'medi' AND NOT (pos[x] IN ('init', 'isol') AND contains(substr(k, i + 1, x - i - 1), 'Z')))) THEN 'dotless' ELSE c END""",
        f"""CASE WHEN sel IS NULL AND me = 'g' AND a[p] IN ('s', 'd') AND ((place = 'medi' AND pos[p] = 'medi' AND g[x] = 'm')
            OR (place = 'fina' AND {kind(mvs)} = 'M' AND a[{onset}] = 'a' AND pos[{onset}] = 'isol' AND {kind(f'pb[{onset}]')} = 'M')) THEN 'dotless' ELSE c END""",
    ]


def ruled() -> str:
    """CTEs up to ruled: tok with c1 to c15, the condition after each rule, and forms under the last."""
    rows = [f"    s{n} AS (SELECT * EXCLUDE (c), {rule} AS c{n} FROM (SELECT *, {f'c{n - 1}' if n > 1 else 'NULL::VARCHAR'} AS c FROM {f's{n - 1}' if n > 1 else 'tok'}))," for n, rule in enumerate(_rules(), 1)]
    steps = "\n".join(rows)
    known = values([(" ".join(names), ",".join(map(str, places))) for names, places in tables.catalogue().particles.items()], "names, places")
    context = lambda c: f"coalesce((SELECT form FROM form f WHERE f.alias = me AND f.position = place AND f.condition = {c} AND {c} <> ''), (SELECT form FROM form f WHERE f.alias = me AND f.position = place AND f.condition = ''))"
    only = "array_to_string(v[p:i - 1], '')"
    doubled = f"CASE WHEN a[p] IN ('oe', 'ue') AND length({only}) = 1 THEN CASE WHEN a[p] = 'ue' AND pos[p] = 'init' THEN CASE {only} WHEN '1' THEN true WHEN '2' THEN false END WHEN pos[p] = 'medi' THEN CASE {only} WHEN '3' THEN true WHEN '1' THEN false WHEN '2' THEN false END END END"
    return f"""{tokens()},
{steps}
    -- particles: chains of MVS and letters, cut before each MVS and at the ends of what is joined
    linked AS (SELECT word, i, substr(k, i, 1) AS kind, place, me, lag(substr(k, i, 1)) OVER w AS before, lag(place) OVER w AS before_place FROM tok WHERE substr(k, i, 1) IN ('L', 'M') WINDOW w AS (PARTITION BY word ORDER BY i)),
    cuts AS (SELECT *, sum(CASE WHEN before IS NULL OR kind = 'M' OR (before = 'L' AND (before_place IN {CLOSED} OR place IN ('init', 'isol'))) THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY i) AS chain FROM linked),
    chains AS (SELECT word, string_agg(CASE WHEN kind = 'M' THEN 'mvs' ELSE me END, ' ' ORDER BY i) AS names, list(i ORDER BY i) AS places,
        string_agg(place, ' ' ORDER BY i) FILTER (kind = 'L') AS shown, count(*) FILTER (kind = 'L') AS n_letters FROM cuts GROUP BY word, chain),
    known AS (SELECT c.word, c.shown, c.n_letters, CASE WHEN q.names IS NOT NULL THEN c.places ELSE c.places[2:] END AS spots, coalesce(q.places, s.places) AS chosen
        FROM chains c LEFT JOIN {known} q ON q.names = c.names LEFT JOIN {known} s ON q.names IS NULL AND c.names LIKE 'mvs %' AND s.names = substr(c.names, 5)),
    particle AS (SELECT DISTINCT word, spots[place + 1] AS i FROM (SELECT z.word, spots, unnest(list_transform(string_split(chosen, ','), lambda s: s::INT)) AS place FROM known z JOIN heard h ON h.word = z.word
        WHERE chosen IS NOT NULL AND array_to_string(h.v[spots[1]:h.r[spots[-1]] - 1], '') = '' AND shown = CASE WHEN n_letters = 1 THEN 'isol' ELSE 'init ' || repeat('medi ', n_letters - 2) || 'fina' END)),
    s13 AS (SELECT t.*, CASE WHEN q.i IS NOT NULL AND me IN ('a', 'e', 'i', 'u', 'ue', 'd', 'y') THEN 'particle' ELSE c12 END AS c13 FROM s12 t LEFT JOIN particle q ON q.word = t.word AND q.i = t.i),
    f13 AS (SELECT *, {context("c13")} AS usual FROM s13),
    l13 AS (SELECT *, list(usual) OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shapes FROM f13),
    s14 AS (SELECT * EXCLUDE (usual, shapes), CASE WHEN c13 IS NULL AND me = 'i' AND place = 'medi' AND sel IS NULL AND g[p] <> 'c' AND NOT (pos[p] IN {CLOSED} AND contains(substr(k, p + 1, i - p - 1), 'Z'))
        AND coalesce({doubled}, coalesce(regexp_extract(shapes[p], '[^+]*$'), '') <> 'I') THEN 'vowel_devsger' ELSE c13 END AS c14 FROM l13),
    f14 AS (SELECT *, {context("c14")} AS usual FROM s14),
    l14 AS (SELECT *, list(usual) OVER w AS shapes, list(coalesce(sel, usual)) OVER w AS chosen FROM f14 WINDOW w AS (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    b14 AS (SELECT *, pos[p] IN {OPEN} AS opened, CASE WHEN pos[p] IN {OPEN} THEN chosen[p] ELSE shapes[p] END AS form_before FROM l14),
    v14 AS (SELECT *, form_before IN ('G', 'Gx') AS velar, regexp_extract(form_before, '[^+]*$') IN ('B', 'P', 'F', 'K', 'K2') AS other, substr(v[p], 1, 1) AS chosen_before FROM b14),
    s15 AS (SELECT * EXCLUDE (usual, shapes, chosen), CASE WHEN me NOT IN ('o', 'u', 'oe', 'ue', 'a', 'e') OR c14 IS NOT DISTINCT FROM 'marked' OR place <> 'fina' OR p IS NULL OR NOT (velar OR other) OR (velar AND me = 'a') THEN c14
        WHEN velar AND a[p] IN ('g', 'h') AND (chosen_before IN ('1', '3') OR (opened AND chosen_before IN ('2', '4') AND me IN ('o', 'u'))) THEN c14
        WHEN chosen_before <> '' AND other AND pos[p] = 'init' AND me IN ('oe', 'ue') THEN 'marked' ELSE 'post_bowed' END AS c15 FROM v14),
    ruled AS (SELECT *, CASE WHEN substr(k, i, 1) = 'L' THEN coalesce(sel, {context("c15")}) ELSE CASE chars[i] WHEN '{tables.MVS}' THEN 'Mvs' WHEN '{tables.NIRUGU}' THEN 'Nirugu' WHEN '{tables.ZWJ}' THEN 'Zwj' ELSE 'Zwnj' END END AS form FROM s15)"""


def walked() -> str:
    """CTEs up to seen(word, raw, shape): units without what can't be seen."""
    listed = lambda text: "(" + ", ".join(map(literal, text if isinstance(text, (list, tuple)) else text.split())) + ")"
    joins = lambda u: f"coalesce({u} NOT IN ('Mvs', 'Zwnj'), false)"
    at = lambda j: f"(CASE WHEN {j} >= 1 AND {j} <= len(u) THEN u[{j}] END)"
    edge = lambda u: f"NOT {joins(u)}"
    structural = listed(tuple(tables.STRUCTURAL))
    each = lambda body: f"list_transform(range(1, len(u) + 1), lambda j: {body})"
    place = lambda a, b: f"CASE WHEN {a} THEN CASE WHEN {b} THEN 'medi' ELSE 'fina' END WHEN {b} THEN 'init' ELSE 'isol' END"
    before, after = at("spot - 1"), at("spot + 1")
    inside = lambda u: f"({joins(u)} AND {u} <> 'Zwj')"
    joiner = f"""CASE WHEN {before} IS NULL AND {after} IS NULL THEN false WHEN coalesce({before} = 'Nirugu', false) OR coalesce({after} = 'Nirugu', false) THEN true
        WHEN {edge(before)} AND {inside(after)} THEN CASE WHEN {edge(at("spot + 2"))} THEN {after} IN {listed(tables.SAME_ISOL_FINA)} ELSE {after} IN {listed(tables.SAME_INIT_MEDI)} END
        WHEN {inside(before)} AND {edge(after)} THEN CASE WHEN {edge(at("spot - 2"))} THEN {before} IN {listed(tables.SAME_ISOL_INIT)} ELSE {before} IN {listed(tables.SAME_FINA_MEDI)} END ELSE true END"""
    alike = listed(sorted(":".join(x) for x in tables.catalogue().alike))
    same = lambda u, a, b, c, d: f"({u} IS NULL OR {u} IN {structural} OR ({place(a, b)}) = ({place(c, d)}) OR {u} || ':' || ({place(a, b)}) || ':' || ({place(c, d)}) IN {alike})"
    two_left, two_right = joins(at("spot - 2")), joins(at("spot + 2"))
    broken = f"""CASE WHEN len(u) = 1 THEN false WHEN coalesce({before} = 'Mvs', false) OR coalesce({after} = 'Mvs', false) THEN true
        ELSE {same(before, two_left, "false", two_left, joins(after))} AND {same(after, "false", two_right, joins(before), two_right)} END"""
    dedupe = "list_transform(list_filter(range(1, len(u) + 1), lambda j: NOT (j > 1 AND u[j] IN ('Zwj', 'Zwnj', 'Mvs') AND u[j] = u[j - 1])), lambda j: u[j])"
    drop = "list_concat(u[1:spot - 1], u[spot + 1:])"
    goes = f"CASE WHEN spot > len(u) THEN false WHEN phase = 1 AND u[spot] = 'Zwj' THEN {joiner} WHEN phase = 2 AND u[spot] = 'Zwnj' THEN {broken} ELSE false END"
    return f"""{ruled()},
    raws AS (SELECT word, string_agg(form, '+' ORDER BY i) AS raw FROM ruled GROUP BY word),
    wide AS (SELECT word, raw, string_split(raw, '+') AS u FROM raws),
    grown AS (SELECT word, string_split(array_to_string({each(f"CASE WHEN u[j] = 'Dd' THEN 'O+A' WHEN u[j] = 'Cr' THEN 'O+O' WHEN u[j] IN ('H', 'Hx') AND {joins(at('j - 1'))} AND {joins(at('j + 1'))} THEN CASE u[j] WHEN 'H' THEN 'A+A' ELSE 'N+N' END ELSE u[j] END")}, '+'), '+') AS u FROM wide),
    -- phase 0: repeated controls go; 1: idle joiners, until none does; 2: idle breaks; 3: nothing went in this round
    walk AS (SELECT word, u, CASE WHEN list_has_any(u, ['Zwj', 'Zwnj', 'Mvs']) THEN 0 ELSE 3 END AS phase, 1 AS spot, len(u) AS began, len(u) AS swept FROM grown
        UNION ALL SELECT word, CASE WHEN phase = 0 THEN {dedupe} WHEN gone THEN {drop} ELSE u END,
            CASE WHEN phase = 0 THEN 1 WHEN spot <= len(u) THEN phase WHEN phase = 1 THEN CASE WHEN len(u) = swept THEN 2 ELSE 1 END ELSE CASE WHEN len(u) = began THEN 3 ELSE 0 END END,
            CASE WHEN phase = 0 OR spot > len(u) THEN 1 WHEN gone THEN spot ELSE spot + 1 END, CASE WHEN phase = 0 THEN len(u) ELSE began END,
            CASE WHEN phase = 0 THEN len({dedupe}) WHEN spot > len(u) THEN len(u) ELSE swept END
        FROM (SELECT *, {goes} AS gone FROM walk WHERE phase < 3)),
    ends AS (SELECT word, u, {each(f'''CASE WHEN u[j] <> 'Aa' OR {joins(at("j + 1"))} OR coalesce({at("j - 1")} IN {structural}, true) THEN NULL WHEN {joins(at("j - 2"))}
        THEN CASE WHEN u[j - 1] = 'A' AND {at("j - 2")} IN {listed(sorted(tables.BOWED))} THEN 'Aa' WHEN u[j - 1] = 'O' THEN 'B2' WHEN u[j - 1] = 'I' THEN 'G' END WHEN u[j - 1] = 'A' THEN 'A' END''')} AS one FROM walk WHERE phase = 3),
    shapes AS (SELECT word, array_to_string(list_filter({each("CASE WHEN j < len(u) AND one[j + 1] IS NOT NULL THEN NULL ELSE coalesce(one[j], u[j]) END")}, lambda s: s IS NOT NULL), '+') AS shape FROM ends),
    seen AS (SELECT v.word, coalesce(raw, '') AS raw, coalesce(shape, '') AS shape FROM valid v LEFT JOIN raws USING (word) LEFT JOIN shapes USING (word))"""


def valid() -> str:
    return f"{keyed()}, valid AS (SELECT word FROM keyed WHERE NOT contains(word, 'x'))"


def oracle() -> dict[str, str]:
    steps = " UNION ALL ".join(f"SELECT {literal(rule)} AS rule, coalesce({f'c{k - 1}' if k > 1 else 'NULL'}, '') AS before, coalesce(c{k}, '') AS after FROM ruled" for k, rule in enumerate(tables.RULES, 1))
    told = lambda words: f"""WITH RECURSIVE valid AS (SELECT word FROM {words.sql()}), {walked()},
        told AS (SELECT word, string_agg(coalesce(c15, '-'), ' ' ORDER BY i) AS conditions FROM ruled GROUP BY word)
        SELECT word, coalesce(conditions, '') AS conditions, shape FROM seen LEFT JOIN told USING (word)"""  # noqa: E731
    return {
        "control_pairs": told(pairs()),
        "particle_words": told(particles()),
        "rule_effects": f"WITH {valid()}, {ruled()} SELECT rule, before, after, count(*) AS n FROM ({steps}) WHERE before <> after GROUP BY ALL",
        "shape_controls": f"""WITH RECURSIVE {valid()}, {walked()} SELECT word, shape, CASE WHEN instr(word, 'x') > 0 THEN 'NonMongolianChar' END AS error_class,
            CASE WHEN instr(word, 'x') > 0 THEN (instr(word, 'x') - 1)::INT END AS error_index FROM keyed LEFT JOIN seen USING (word)""",
    }
