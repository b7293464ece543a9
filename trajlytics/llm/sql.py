"""Check queries for DuckDB, where SQL can express an operator."""

from __future__ import annotations

BLANK_CLASS = r"[\x20\x09-\x0D]+"

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '[^\n]*?(?:[.!?]+[ \t]+|\n|$)') AS parts FROM documents WHERE text <> ''
), piece AS (
  SELECT doc_id, UNNEST(parts) AS body, UNNEST(range(len(parts))) AS k FROM cut
), placed AS (
  SELECT *, SUM(length(body)) OVER (PARTITION BY doc_id ORDER BY k) - length(body) AS offs FROM piece
), sentence AS (
  SELECT doc_id, offs + length(body) - length(ltrim(body, {BLANKS})) AS start_pos, offs + length(rtrim(body, {BLANKS})) AS end_pos,
         ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit_no,
         trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK_CLASS}', ' ', 'g')) AS said
  FROM placed WHERE trim(body, {BLANKS}) <> ''
), counted AS MATERIALIZED (
  SELECT *, SUM(len(string_split(said, ' '))) OVER (PARTITION BY doc_id ORDER BY unit_no) AS upto,
         SUM(len(string_split(said, ' '))) OVER (PARTITION BY doc_id) AS total, len(string_split(said, ' ')) AS n FROM sentence
), run AS (
  SELECT a.doc_id, a.unit_no, a.start_pos, MAX(b.end_pos) AS end_pos, SUM(b.n) AS n_words, md5(string_agg(b.said, ' ' ORDER BY b.unit_no)) AS digest
  FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.unit_no >= a.unit_no AND b.upto - b.n - (a.upto - a.n) < 16
  WHERE a.total - (a.upto - a.n) >= 16 OR a.unit_no = 0
  GROUP BY a.doc_id, a.unit_no, a.start_pos
), ranked AS (
  SELECT *, ROW_NUMBER() OVER w AS place, FIRST_VALUE(doc_id) OVER w AS keep_doc_id, FIRST_VALUE(start_pos) OVER w AS keep_start_pos
  FROM run WINDOW w AS (PARTITION BY digest ORDER BY doc_id NULLS LAST, start_pos)
)
SELECT doc_id, CAST(unit_no AS INTEGER) AS unit_no, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos,
       CAST(n_words AS INTEGER) AS n_words, digest, keep_doc_id, CAST(keep_start_pos AS BIGINT) AS keep_start_pos
FROM ranked WHERE place > 1
"""

COUNTS = rf"""
source AS (
  SELECT ROW_NUMBER() OVER () AS row_no, doc_id, COALESCE(text, '') AS body FROM documents
), worded AS (
  SELECT row_no, doc_id, body, list_filter(regexp_split_to_array(body, '{BLANK_CLASS}'), lambda w: w <> '') AS ws,
         list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM source
), windows AS (
  SELECT row_no, UNNEST(range(1, len(ws) - 6)) AS pos, UNNEST(list_transform(range(1, len(ws) - 6), lambda k: ws[k:k + 7])) AS win
  FROM worded WHERE len(ws) >= 8
), repeated AS (
  SELECT row_no, pos, COUNT(*) OVER (PARTITION BY row_no, win) AS times FROM windows
), spans AS (
  SELECT row_no, LEAST(8, COALESCE(LEAD(pos) OVER (PARTITION BY row_no ORDER BY pos) - pos, 8)) AS adds
  FROM repeated WHERE times > 1
), covered AS (
  SELECT row_no, SUM(adds) AS n_repeat_words FROM spans GROUP BY row_no
), counts AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '{BLANK_CLASS}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(COALESCE(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(body, '\p{{Lu}}')) AS n_capitals, length(body) AS n_chars_,
         len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS n_stutter, len(ls) AS n_lines,
         len(list_filter(ws, lambda w: NOT regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS n_bare
  FROM worded LEFT JOIN covered USING (row_no)
)"""


def vote_sql(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


VOTES = [
    vote_sql("5 * n_symbols > n_words", "50 * n_symbols < n_words"),
    vote_sql("10 * n_capitals > 3 * n_chars_", "10 * n_capitals < n_chars_"),
    vote_sql("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words < n_words"),
    vote_sql("5 * n_stutter > n_words", "20 * n_stutter < n_words"),
    vote_sql(
        "n_words >= 20 AND (2 * word_chars > 13 * n_words OR word_chars < 3 * n_words)",
        "n_words >= 20 AND word_chars >= 4 * n_words AND 2 * word_chars <= 11 * n_words",
    ),
    vote_sql("2 * n_dup_lines > n_lines", "n_words > 0 AND 50 * n_dup_lines < n_lines"),
    vote_sql("n_words < 20", "n_words >= 50"),
    vote_sql("10 * n_bare > n_words", "50 * n_bare < n_words"),
]


def weak_supervision_sql(rounds: int = 15) -> str:
    """Every round of expectation-maximisation as two CTEs over the counts of vote patterns."""
    n = len(VOTES)
    odds = "lo + " + " + ".join(f"w[{3 * k + 2} + v{k}]" for k in range(n))
    start = ", ".join(["ln(0.005 / 0.3)", "ln(0.195 / 0.3)", "ln(0.8 / 0.4)"] * n)
    parts = [
        COUNTS.strip(),
        "voted AS MATERIALIZED (SELECT *, " + ", ".join(f"{v} AS v{k}" for k, v in enumerate(VOTES)) + " FROM counts)",
        "pattern AS MATERIALIZED (SELECT "
        + ", ".join(f"v{k}" for k in range(n))
        + ", CAST(COUNT(*) AS DOUBLE) AS n FROM voted GROUP BY ALL)",
        f"m0 AS (SELECT ln(0.85 / (1 - 0.85)) AS lo, [{start}] AS w)",
    ]
    for r in range(rounds):
        parts.append(f"e{r} AS MATERIALIZED (SELECT pattern.*, 1 / (1 + exp(-({odds}))) AS good FROM pattern, m{r})")
        weights = ", ".join(
            f"ln((SUM(CASE WHEN v{k} = {v} THEN n * good ELSE 0 END) + 0.5) / (SUM(n * good) + 1.5)) - "
            f"ln((SUM(CASE WHEN v{k} = {v} THEN n ELSE 0 END) - SUM(CASE WHEN v{k} = {v} THEN n * good ELSE 0 END) + 0.5) / (SUM(n) - SUM(n * good) + 1.5))"
            for k in range(n)
            for v in (-1, 0, 1)
        )
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT ln((SUM(n * good) + 0.5) / (SUM(n) - SUM(n * good) + 0.5)) AS lo, [{weights}] AS w FROM e{r})")
    failed = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
       NOT {failed} AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM voted, m{rounds}"""
    )


URL_ASSOCIATIONS = r"""
WITH RECURSIVE split AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)
), written AS (
  SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM split
), judged AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM written
), token AS MATERIALIZED (
  SELECT DISTINCT url, t FROM (
    SELECT url, 'h:' || UNNEST(list_concat(string_split(host, '.'), regexp_split_to_array(host, '[.\-]'))) AS t FROM judged
    UNION ALL
    SELECT url, 'p:' || regexp_replace(UNNEST(regexp_split_to_array(path, '[/.]')), '^[0-9]+$', '#') AS t FROM judged
  ) WHERE t NOT IN ('h:', 'p:')
), labelled AS MATERIALIZED (
  SELECT url, said = 'block' AS blocked FROM judged WHERE said IS NOT NULL
  UNION ALL
  SELECT url, bool_or(toxic = 1 OR quality = 0) FROM judged JOIN pages USING (url) JOIN labels ON page_id = doc_id
  WHERE said IS NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY url
), known AS MATERIALIZED (SELECT url, blocked, t FROM labelled JOIN token USING (url)
), sets AS (
  SELECT url, blocked, [t] AS s, t AS last FROM known
  UNION ALL SELECT sets.url, sets.blocked, list_append(s, t), t FROM sets JOIN known ON sets.url = known.url AND t > last
), mined AS MATERIALIZED (
  SELECT s FROM sets GROUP BY s
  HAVING COUNT(*) FILTER (WHERE blocked) >= ceil(0.005 * (SELECT COUNT(*) FROM labelled))
     AND CAST(COUNT(*) FILTER (WHERE blocked) AS DOUBLE) / COUNT(*) >= 0.8
), held AS (
  SELECT url, list(t) AS ts FROM token WHERE url IN (SELECT url FROM judged WHERE said IS NULL) GROUP BY url
), hit AS (
  SELECT DISTINCT url FROM held, mined WHERE list_has_all(ts, s)
)
SELECT page_id, COALESCE(host, '') AS host, COALESCE(path, '') AS path, rule,
       COALESCE(said, CASE WHEN hit.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM pages LEFT JOIN judged ON pages.url = judged.url LEFT JOIN hit ON pages.url = hit.url
"""

#: CRC-32 of the decimal digits of doc_id: one step a bit, each byte enters with its first bit.
CRC_OF_ID = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)),
      lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, CAST(k // 8 + 1 AS INTEGER), 1)) ELSE 0 END::BIGINT)),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295::BIGINT)"""


def tree_sql(name: str, nodes: str, levels: int) -> list[str]:
    """CTEs of a forest: {name}{k} holds (src, slot, h, n) of level k; a tree with one node stays as it is."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT *, COUNT(*) OVER (PARTITION BY src) AS n FROM ({nodes}))"]
    for k in range(levels):
        parts.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT src, slot, CASE WHEN was > 1 THEN sha256(body) ELSE body END AS h, COUNT(*) OVER (PARTITION BY src) AS n"
            f" FROM (SELECT src, slot // 3 AS slot, string_agg(h, '' ORDER BY slot) AS body, MAX(n) AS was FROM {name}{k} GROUP BY src, slot // 3))"
        )
    return parts


def climb_sql(name: str, start: str, out: str, levels: int) -> list[str]:
    """CTEs that carry `path` and `folded` of each row of start (src, slot, path, folded, ...) to the top of its tree."""
    parts, at = [], start
    for k in range(levels):
        parts.append(
            f"{out}{k} AS MATERIALIZED (SELECT a.* EXCLUDE (slot, path, folded), a.slot // 3 AS slot,"
            f" CASE WHEN r.n > 1 THEN a.path || COALESCE(list_aggregate(r.hs[:a.slot % 3] || r.hs[a.slot % 3 + 2:], 'string_agg', ''), '') ELSE a.path END AS path,"
            f" CASE WHEN r.n > 1 THEN sha256(list_aggregate(r.hs[:a.slot % 3] || [a.folded] || r.hs[a.slot % 3 + 2:], 'string_agg', '')) ELSE a.folded END AS folded"
            f" FROM {at} a JOIN (SELECT src, slot // 3 AS run, list(h ORDER BY slot) AS hs, MAX(n) AS n FROM {name}{k} GROUP BY src, slot // 3) r"
            f" ON a.src = r.src AND a.slot // 3 = r.run)"
        )
        at = f"{out}{k}"
    return parts


def manifest_sql(levels: int = 14) -> str:
    """Trees of up to 3 ** levels leaves and as many sources."""
    leaf = "sha256(" + " || ".join("{" + c + "}" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

    def coded(c: str) -> str:
        return f"COALESCE(strlen({c}::VARCHAR) || ':' || {c}, '-')"

    whole = leaf.format(**{c: coded(c) for c in ("doc_id", "source", "lang", "n_chars", "text")})
    cut = leaf.format(**{c: coded(c) for c in ("doc_id", "source", "lang", "n_chars")}, text=coded("replace(text, chr(10), '')"))
    parts = [
        f"leaf AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS src, {whole} AS h,"
        f" CASE WHEN COALESCE({CRC_OF_ID} & 1 = 0, false) THEN {cut} ELSE {whole} END AS claim FROM documents)",
        "placed AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS slot FROM leaf)",
        *tree_sql("t", "SELECT src, slot, h FROM placed", levels),
        f"sub AS MATERIALIZED (SELECT src AS name, h, ROW_NUMBER() OVER (ORDER BY encode(src)) - 1 AS slot FROM t{levels})",
        *tree_sql("s", "SELECT '' AS src, slot, h FROM sub", levels),
        "start AS (SELECT doc_id, src, src AS name, slot, h AS leaf, '' AS path, claim AS folded FROM placed)",
        *climb_sql("t", "start", "u", levels),
        f"met AS (SELECT u.* EXCLUDE (src, slot), '' AS src, sub.slot, sub.h AS subroot FROM u{levels - 1} u JOIN sub USING (name))",
        *climb_sql("s", "met", "v", levels),
    ]
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, s{levels}.h AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = s{levels}.h AS verified
FROM v{levels - 1} JOIN s{levels} USING (src)"""
    )


DIVERGENCE = r"""
WITH doc AS (
  SELECT ROW_NUMBER() OVER () AS row_no, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), word AS MATERIALIZED (
  SELECT row_no, lang, source, UNNEST(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc
), kept AS MATERIALIZED (
  SELECT lang, term, COUNT(*) AS lang_n FROM word GROUP BY lang, term HAVING COUNT(DISTINCT row_no) >= 30
), seen AS MATERIALIZED (
  SELECT lang, source, term, COUNT(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL
), grp AS MATERIALIZED (
  SELECT g.lang, g.source, COALESCE(s.total, 0) AS total, COALESCE(k.terms, 0) AS terms, COALESCE(k.lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM doc) g
  LEFT JOIN (SELECT lang, source, SUM(n) AS total FROM seen GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN (SELECT lang, COUNT(*) AS terms, SUM(lang_n) AS lang_total FROM kept GROUP BY lang) k ON g.lang = k.lang
), cell AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, COALESCE(n, 0) AS n, 1 + (1000000000::HUGEINT * (COALESCE(n, 0) + 5)) // (total + 5 * terms) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * terms) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, SUM(abs(a.p - b.p)) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source WHERE a.terms = 0
), item AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM cell WHERE n > 0 AND p > q
), placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place FROM item
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM placed WHERE part = 'pair' OR place <= 50
"""

ORACLES: dict[str, str] = {"op3_url_associations": URL_ASSOCIATIONS, "op5_weak_supervision": weak_supervision_sql(), "op6_line_dedup": LINE_DEDUP, "op11_bitmap_manifest": manifest_sql(), "op13_consed_trees": DIVERGENCE}
