"""Pieces that the SQL of several queries shares, in DuckDB's words."""

from __future__ import annotations

from granary.functions import text as tx

WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CHUNKS = f"""
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, trim(substr(t, i * 780 + 1, 900)) AS chunk
  FROM (SELECT doc_id, {collapse("coalesce(text, '')")} AS t FROM documents) n,
       unnest(range(CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 900 THEN 1 ELSE CAST(ceil((length(t) - 900) / 780.0) AS BIGINT) + 1 END)) u(i)
"""


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z0-9]+'))"


def sentences(x: str) -> str:
    """Marked, then cut: RE2 has no look-behind."""
    marked = f"regexp_replace(regexp_replace({x}, '([。！？.!?]){WS}+', '\\1' || chr(30), 'g'), '\\n+', chr(30), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(30)), lambda s: {strip('s')}), lambda s: s <> '')"


#: CTEs that end in k: (doc_id, parts: chunks, pts: key sentences).
KEY_SENTENCES = f"""
c AS ({CHUNKS}), p AS (SELECT doc_id, list(chunk ORDER BY chunk_index) AS parts FROM c GROUP BY 1),
x AS (SELECT doc_id, parts, string_split(regexp_replace(array_to_string(parts[1:24], ' '), '([。！？.!?]){WS}+', '\\1' || chr(30), 'g'), chr(30)) AS cut FROM p),
f AS (SELECT doc_id, parts, list_slice(list_transform(list_filter(list_transform(cut, lambda x: {collapse("x")}), lambda x: length(x) >= 28), lambda x: x[1:260]), 1, 8) AS found FROM x),
k AS (SELECT doc_id, parts, CASE WHEN len(found) > 0 THEN found ELSE list_slice(list_transform(parts, lambda x: x[1:260]), 1, 8) END AS pts FROM f)"""

HEAD_LINES = ("1. Introduction", "2.3 Method details", "RESULTS", "Results show", "A.1 APPENDIX", "IV. EVALUATION", "123 BIG TITLE", "3 BIG TITLE", "[Page 3] ABSTRACT text", "I N TRODUCTION", "摘要：内容", "摘要内容", "4.1.2.3 DEEP DIVE INTO DATA", "CONCLUSION")


def joined_heading(x: str) -> str:
    for _ in range(4):
        x = f"regexp_replace({x}, '\\b([A-Z])\\s+([A-Z]{{2,}})\\b', '\\1\\2', 'g')"
    return x


def heading_name(x: str) -> str:
    return "CASE upper(" + x + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.HEADINGS.items()) + f" ELSE {x} END"


#: Lines of documents with headings strewn in, parsed: doc_id, pos, line, title, rest (title null: no heading).
PAPER_LINES = f"""
  SELECT doc_id, CAST(i AS INTEGER) AS pos, line FROM (
    SELECT doc_id, i, unnest(CASE WHEN (i - 1) % 3 = 0 THEN [heads[CAST((doc_id + i - 1) % {len(HEAD_LINES)} AS BIGINT) + 1], l] ELSE [l] END) AS raw,
           generate_subscripts(CASE WHEN (i - 1) % 3 = 0 THEN [1, 2] ELSE [1] END, 1) AS k
    FROM (SELECT doc_id, [{", ".join(quoted(h) for h in HEAD_LINES)}] AS heads, unnest(parts) AS l, generate_subscripts(parts, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))
"""


def parsed_heading(lines: str) -> str:
    """SQL that adds title and rest to a table with a column line (stripped)."""
    marks = lambda p: f"repeat('#', least(4, length({p}) - length(replace({p}, '.', '')) + 2))"
    c = "c"
    return f"""
  SELECT * EXCLUDE (c, prefix, token, rest1, num, cap),
    CASE WHEN token <> '' THEN CASE WHEN rest1 <> '' AND prefix = '' AND token <> 'ABSTRACT' AND rest1[1] = lower(rest1[1]) AND rest1[1] <> upper(rest1[1]) THEN NULL
           ELSE CASE WHEN prefix = '' THEN '##' ELSE {marks("prefix")} END || ' ' || trim(prefix || ' ' || {heading_name("token")}) END
         WHEN num <> '' AND regexp_full_match(num, '\\d{{3,}}') THEN NULL
         WHEN num <> '' AND cap <> '' AND length(cap) <= 90 AND len(regexp_split_to_array(cap, '\\s+')) <= 14 THEN {marks("num")} || ' ' || num || ' ' || {heading_name("cap")}
         WHEN regexp_matches(c, {quoted(tx.CHINESE_HEADING)}) THEN '## ' || regexp_extract(c, {quoted(tx.CHINESE_HEADING)}, 1) END AS title,
    CASE WHEN token <> '' THEN rest1 WHEN num <> '' THEN {strip(f"regexp_extract(c, {quoted(tx.CAPS_HEADING)}, 3)")}
         ELSE {strip(f"regexp_extract(c, {quoted(tx.CHINESE_HEADING)}, 2) || regexp_extract(c, {quoted(tx.CHINESE_HEADING)}, 3)")} END AS rest
  FROM (SELECT *, upper(regexp_extract(c, {quoted(tx.TOKEN_HEADING)}, 1)) AS prefix, upper(regexp_extract(c, {quoted(tx.TOKEN_HEADING)}, 2)) AS token,
          {strip(f"regexp_extract({c}, {quoted(tx.TOKEN_HEADING)}, 3)")} AS rest1, regexp_extract(c, {quoted(tx.CAPS_HEADING)}, 1) AS num,
          regexp_replace(regexp_extract(c, {quoted(tx.CAPS_HEADING)}, 2), '^[ \\-:.]+|[ \\-:.]+$', '', 'g') AS cap
        FROM (SELECT *, {joined_heading(collapse(f"regexp_replace(line, {quoted(tx.PAGE_MARK)}, '')"))} AS c FROM ({lines})))
"""
