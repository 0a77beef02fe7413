"""Those of the registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def op3() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
        ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
    shared AS (SELECT s.doc_id, s.g FROM s JOIN rare USING (g)),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.b AS component_id FROM w LEFT JOIN n USING (doc_id)
    JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) c ON c.a = w.doc_id"""


def op6() -> str:
    from tamga.llm.secrets import BASE, MORE

    def one(rank: int, rule) -> str:
        rx = rule.regex.replace("'", "''")
        return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, s, s + length(m[k]) AS e FROM (
            SELECT doc_id, m, v, k, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, '{rx}') AS g, regexp_extract_all(text, '{rx}', 0) AS m, regexp_extract_all(text, '{rx}', {rule.group}) AS v
            FROM documents WHERE regexp_matches(text, '{rx}')))) WHERE length(v[k]) >= {rule.least}"""

    rules = " UNION ALL ".join(one(i, r) for i, r in enumerate(BASE + MORE))
    listed = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){where}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH f AS ({rules}) SELECT doc_id, {counts}, sha256({listed(f' FILTER (rank < {len(BASE)})')}) AS base_sha256, {listed('')} AS spans
    FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id"""


def op7() -> str:
    words = lambda t: f"regexp_extract_all({_low(t)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents), b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM win),
    grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
    hits AS (SELECT DISTINCT doc_id, i, grams.n, item_id FROM grams JOIN win ON win.n = grams.n AND win.g = grams.g),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op8() -> str:
    size = lambda t: f"length(regexp_replace({t}, '([\\\\<\\[\\]])', '\\\\\\1', 'g'))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    s AS (SELECT *, sum({size('text')} + 2 * {size('role')} + length('<s>[] ') + length(' [/]</s>')) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM t),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars FROM s GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def op9() -> str:
    # texts as hexadecimal digits, two a byte; windows are told apart by their MD5 sums
    return """WITH t AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
    win AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM t)),
    again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
    hit AS (SELECT r, i FROM win SEMI JOIN again USING (h)),
    marked AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, -1) AS opens FROM hit),
    numbered AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
    run AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY r, run),
    gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run),
    cut AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS lead FROM gap JOIN t USING (r) GROUP BY r)
    SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(lead, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM t LEFT JOIN cut USING (r)"""


def oracle() -> dict[str, str]:
    return {"op3_ngram_join": op3(), "op6_secret_scan": op6(), "op7_decontamination": op7(), "op8_chat_format": op8(), "op9_repeated_spans": op9()}
