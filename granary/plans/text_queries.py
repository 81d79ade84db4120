"""Queries of the text plane: chunks, sentences, headings, sections, tags, indicators, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import render
from granary.sources.tables import load, spread

from . import sql as q
from .registry import query


def documents(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *names), "doc_id")


def unfolded(rows: DataFrame, parts: Column, place: str, name: str) -> DataFrame:
    """(doc_id, place, name): a row for each entry. By explode() Spark would put a filter on the number of entries below the dealing
    out of small tables, and work all of them out twice."""
    return rows.select("doc_id", F.posexplode_outer(parts).alias(place, name)).where(F.col(place).isNotNull())


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, chunk_index, chunk)."""
    return unfolded(documents(spark, d), tx.chunks(F.col("text")), "chunk_index", "chunk")


@query(f"SELECT doc_id, chunk_index, chunk, doc_id || ':' || chunk_index || ':' || substr(sha1(doc_id || ':' || chunk_index), 1, 16) AS chunk_id FROM ({q.CHUNKS})")
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).withColumn("chunk_id", tx.chunk_id(F.col("doc_id"), F.col("chunk_index")))


@query(f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {q.sentences(q.strip("coalesce(text, '')"))} AS s FROM documents)")
def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    return unfolded(documents(spark, d), tx.sentences(tx.strip(F.col("text"))), "pos", "sentence")


@query(f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_units, array_to_string(s, chr(31)) AS units FROM (SELECT doc_id, list_slice(list_transform({q.sentences("coalesce(text, '')")}, lambda x: x[1:280]), 1, 40) AS s FROM documents)")
def q_units40(spark: SparkSession, d: str) -> DataFrame:
    u = tx.units(F.col("text"))
    return documents(spark, d).select("doc_id", u.alias("u")).select("doc_id", F.size("u").alias("n_units"), F.array_join("u", "\x1f").alias("units"))


@query(f"WITH {q.KEY_SENTENCES} SELECT doc_id, array_to_string(pts, chr(31)) AS key_sentences FROM k")
def q_key_sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = tx.chunks(F.col("text"))
    # A text has chunks where it has more than white space; a filter on the chunks would be pushed below them and work them out twice.
    rows = documents(spark, d).where(F.regexp_like("text", F.lit(tx.WS.replace("[", "[^", 1))))
    return rows.select("doc_id", tx.let(parts, lambda p: F.array_join(tx.key_sentences(p), "\x1f")).alias("key_sentences"))


def paper_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lines): stripped lines of documents, with a heading of a fixed list before every third line; blank ones go."""
    heads = F.array(*(F.lit(h) for h in q.HEAD_LINES))
    own = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.array(F.element_at(heads, ((F.col("doc_id") + i) % len(q.HEAD_LINES)).cast("int") + 1), x)).otherwise(F.array(x)))
    lines = F.filter(F.transform(F.flatten(own), tx.strip), lambda x: x != "")
    return documents(spark, d).select("doc_id", lines.alias("lines"))


_LINES = f"""
  SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos, unnest(ls) AS line FROM (
    SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN [heads[CAST((doc_id + i - 1) % {len(q.HEAD_LINES)} AS BIGINT) + 1], x] ELSE [x] END)) AS ls
    FROM documents, (SELECT [{", ".join(q.quoted(h) for h in q.HEAD_LINES)}] AS heads))
"""
_PARSED = q.parsed_heading(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, {q.strip('line')} AS line FROM ({_LINES}) WHERE {q.strip('line')} <> ''")


@query(f"SELECT doc_id, pos, line, title, rest FROM ({_PARSED}) WHERE title IS NOT NULL")
def q_headings(spark: SparkSession, d: str) -> DataFrame:
    """Heading lines by their place among the lines that are not blank."""
    parsed = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line"), tx.parse_heading(x).alias("h")))
    rows = paper_lines(spark, d).select("doc_id", F.explode_outer(F.filter(parsed, lambda x: x["h"].isNotNull())).alias("x")).where("x IS NOT NULL")
    return rows.select("doc_id", "x.pos", "x.line", "x.h.title", "x.h.rest")


def section_lists(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, s: array of struct(section, title, content)); no row leaves its task."""
    return paper_lines(spark, d).select("doc_id", tx.sections(F.col("lines")).alias("s"))


_SECTIONS = f"""
WITH p AS ({_PARSED}), n AS (SELECT *, CAST(sum(CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS section FROM p),
g AS (SELECT doc_id, section, max(title) AS title, string_agg(CASE WHEN title IS NULL THEN line WHEN rest <> '' THEN rest END, chr(10) ORDER BY pos) AS content FROM n GROUP BY 1, 2)
SELECT doc_id, section, coalesce(title, '{tx.BEFORE_HEADINGS}') AS title, {q.strip("content")} AS content FROM g WHERE coalesce({q.strip("content")}, '') <> ''
UNION ALL SELECT doc_id, 0, '{tx.WHOLE_TEXT}', string_agg(line, chr(10) ORDER BY pos) FROM p GROUP BY 1 HAVING max(CASE WHEN title IS NULL OR rest <> '' THEN 1 ELSE 0 END) = 0
"""


@query(_SECTIONS)
def q_sections(spark: SparkSession, d: str) -> DataFrame:
    return section_lists(spark, d).select("doc_id", F.inline_outer("s")).where("section IS NOT NULL")


def merged_sections(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, sections: array of struct(title, content)), short ones and equal titles merged."""
    plain = F.transform("s", lambda s: F.struct(s["title"].alias("title"), s["content"].alias("content")))
    return section_lists(spark, d).select("doc_id", tx.merge_sections(plain).alias("sections"))


@query()
def q_sections_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = merged_sections(spark, d).select("doc_id", F.posexplode_outer("sections").alias("pos", "s"))
    return rows.select("doc_id", "pos", F.col("s.title").alias("title"), F.col("s.content").alias("content"))


@query()
def q_pack500(spark: SparkSession, d: str) -> DataFrame:
    return unfolded(documents(spark, d), tx.pack(tx.sentences(tx.strip(F.col("text")))), "pos", "part")


def _template(c: Column) -> Column:
    """Names of templates made of the source's number: known ones, ones with the words, and others."""
    n = F.regexp_extract(c, r"(\d+)$", 1).cast("int") % 5
    return F.when(n == 0, "tinghua.md").when(n == 1, "backdoor_attacks.md").when(n == 2, "my-backdoor-defense_v2.md").when(n == 3, F.concat(c, F.lit("_notes.md"))).otherwise("new-backdoor.md")


_TEMPLATE = "CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 WHEN 0 THEN 'tinghua.md' WHEN 1 THEN 'backdoor_attacks.md' WHEN 2 THEN 'my-backdoor-defense_v2.md' WHEN 3 THEN source || '_notes.md' ELSE 'new-backdoor.md' END"
_BASE_TAG = f"CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 WHEN 0 THEN 'General' WHEN 1 THEN 'Backdoor Attack' WHEN 2 THEN 'Backdoor Defense' WHEN 3 THEN upper(source[1]) || lower(source[2:]) || ' Notes' ELSE 'Backdoor Attack' END"
_TAGS = ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{tag}' END" for tag, words in tx.TAG_WORDS.items())


@query(f"SELECT doc_id, {_TEMPLATE} AS template, array_to_string([b] || list_filter(list_filter([{_TAGS}], lambda x: x IS NOT NULL), lambda x: x <> b), '|') AS tags FROM (SELECT *, {_BASE_TAG} AS b FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents))")
def q_domain_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "source").withColumn("template", _template(F.col("source")))
    return rows.select("doc_id", "template", F.array_join(tx.domain_tags(F.col("text"), F.col("template")), "|").alias("tags"))


def _noted(c: Column) -> Column:
    """Documents hold no indicators of this field, so a sentence with some is put before every third one."""
    n = F.col("doc_id") % 9
    return F.concat(
        F.when(n == 0, "A clean-label  backdoor on CIFAR-10 with a patch trigger: ASR of 99.5% and clean accuracy 93.1%. ").when(n == 3, "All-to-one, GTSRB, warping-based trigger, attack success rate is 87%, CA 91%. ").when(n == 6, "Data poisoning with MNIST. ").otherwise(""), c
    )


_NOTED = "CASE doc_id % 9 WHEN 0 THEN 'A clean-label  backdoor on CIFAR-10 with a patch trigger: ASR of 99.5% and clean accuracy 93.1%. ' WHEN 3 THEN 'All-to-one, GTSRB, warping-based trigger, attack success rate is 87%, CA 91%. ' WHEN 6 THEN 'Data poisoning with MNIST. ' ELSE '' END || coalesce(text, '')"


def _indicator_sql(name: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(t, {q.quoted('(?i)' + p)}, 1), '')" for p in tx.INDICATORS[name]) + f", 'N/A') AS {name}"


@query(f"SELECT doc_id, {', '.join(map(_indicator_sql, tx.INDICATORS))} FROM (SELECT doc_id, {_NOTED} AS t FROM documents)")
def q_indicators(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", _noted(F.col("text")).alias("t"))
    return rows.select("doc_id", *(tx.indicator(F.col("t"), n).alias(n) for n in tx.INDICATORS))


_EST = "CAST(floor((length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) * 15 + (length(t) - length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))) * 4) / 10) AS BIGINT)"


@query(f"SELECT conv_id, turn, {_EST} AS tokens FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '问题：这是一个测试 ' ELSE '' END || coalesce(text, '') AS t FROM conversations)")
def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, "问题：这是一个测试 ").otherwise(""), F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("conv_id", "turn", tx.token_estimate(F.col("t")).alias("tokens"))


_ONE, _MANY = tx.compatible()
_SPELLED = "MAP {" + ", ".join(f"{q.quoted(k)}: {q.quoted(v)}" for k, v in _MANY.items()) + "}"


@query(f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {q.quoted("".join(_ONE))}, {q.quoted("".join(_ONE.values()))}) AS t FROM documents),
m AS (SELECT {_SPELLED} AS names),
a AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda x: coalesce(names[x], x)), '') AS t FROM t, m)
SELECT doc_id, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'paper')[1:48] AS slug FROM a
""")
def q_slug(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.slug(F.col("text")).alias("slug"))


_ESCAPED = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT page_id, {_ESCAPED.format(x='html')} AS escaped FROM pages")
def q_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", tx.html_escape(F.col("html")).alias("escaped"))


@query("SELECT doc_id, CASE lower(trim(n)) WHEN 'english' THEN 'en' WHEN '日文' THEN 'ja' ELSE 'zh-CN' END AS code FROM (SELECT doc_id, CASE lang WHEN 'en' THEN ' English ' WHEN 'fr' THEN '日文' WHEN 'de' THEN 'en' ELSE lang END AS n FROM documents)")
def q_lang_code(spark: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    name = F.when(lang == "en", " English ").when(lang == "fr", "日文").when(lang == "de", "en").otherwise(lang)
    return load(spark, d, "documents").select("doc_id", tx.language_code(name).alias("code"))


_HEAD = render.TRANSLATION_HEAD.replace("{language}", "' || lang || '").replace("{title}", "' || doc_id || '").replace("{now}", "2024-01-01T00:00:00Z")


@query(f"WITH s AS ({_SECTIONS}) SELECT doc_id, '{_HEAD}' || chr(10) || chr(10) || string_agg(title || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY section) || chr(10) AS markdown FROM s JOIN documents USING (doc_id) GROUP BY doc_id, lang")
def q_render_md(spark: SparkSession, d: str) -> DataFrame:
    rows = section_lists(spark, d).join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", render.translation_markdown(F.col("doc_id").cast("string"), F.col("lang"), F.col("s"), F.lit(0), F.lit("2024-01-01T00:00:00Z")).alias("markdown"))


_BLOCK = f"'<h' || l || '>' || {_ESCAPED.format(x='h')} || '</h' || l || '><p>' || regexp_replace(replace({_ESCAPED.format(x='content')}, chr(10), '<br>'), '\\[Page\\s+(\\d+)\\]', '<h3>第 \\1 页</h3>', 'g') || '</p>'"


@query(f"WITH s AS ({_SECTIONS}), b AS (SELECT *, least(4, greatest(2, length(title) - length(replace(title, '#', '')))) AS l, trim(ltrim(title, '#')) AS h FROM s) SELECT doc_id, string_agg({_BLOCK}, chr(10) ORDER BY section) AS body FROM b GROUP BY 1")
def q_render_html(spark: SparkSession, d: str) -> DataFrame:
    return section_lists(spark, d).select("doc_id", render.layout_body(F.col("s")).alias("body"))


@query(f"WITH c AS ({q.CHUNKS}), p AS (SELECT doc_id, list(chunk ORDER BY chunk_index) AS cs FROM c GROUP BY 1) SELECT doc_id, array_to_string(list_transform(cs[1:8], lambda x, i: '[Context ' || i || ']' || chr(10) || x[1:2500]), chr(10) || chr(10)) AS block, '关于「' || doc_id || '」的回答：' || chr(10) || chr(10) || '以下信息来自当前论文的检索结果，供参考：' || chr(10) || array_to_string(list_transform(cs[1:3], lambda x, i: i || '. ' || x[1:300]), chr(10)) AS fallback FROM p")
def q_context_block(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", tx.chunks(F.col("text")).alias("cs")).where(F.size("cs") > 0)
    return rows.select("doc_id", tx.context_block(F.slice("cs", 1, 8)).alias("block"), render.fallback_answer(F.col("doc_id").cast("string"), F.col("cs")).alias("fallback"))


_WRAPPED = "CASE conv_id % 3 WHEN 0 THEN '<think> why ' || turn || ' </think>' || coalesce(text, '') WHEN 1 THEN '<|DSML|x>' || coalesce(text, '') ELSE coalesce(text, '') END"


@query(f"SELECT conv_id, turn, {q.strip('regexp_replace(t, $$(?s)<think>.*?</think>$$, $$$$, $$g$$)')} AS answer, CASE WHEN conv_id % 3 = 0 THEN 'why ' || turn END AS reasoning FROM (SELECT conv_id, turn, {q.strip(f'regexp_replace({_WRAPPED}, $$<[|]DSML[|][^>]*>$$, $$$$, $$g$$)')} AS t FROM conversations)")
def q_think_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    wrapped = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("<think> why "), F.col("turn"), F.lit(" </think>"), text)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("<|DSML|x>"), text)).otherwise(text)
    return load(spark, d, "conversations").select("conv_id", "turn", tx.think_split(wrapped).alias("s")).select("conv_id", "turn", "s.answer", "s.reasoning")


@query("SELECT conv_id, turn, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS piece FROM (SELECT conv_id, turn, list_transform(range(CAST(ceil(length(text) / 3.0) AS BIGINT)), lambda i: substr(text, i * 3 + 1, 3)) AS p FROM conversations WHERE role = 'assistant')")
def q_answer_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.posexplode(tx.fixed_pieces(F.col("text"))).alias("pos", "piece"))


@query(f"SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(list_filter(list_transform(string_split('# ' || source || chr(10) || coalesce(text, '') || chr(10) || '## ' || lang, chr(10)), lambda x: {q.strip('x')}), lambda x: starts_with(x, '#')), lambda x: {q.strip('ltrim(x, $$#$$)')}), lambda x: x <> ''), 1, 8), '|') AS headings FROM documents")
def q_template_headings(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\n## "), F.col("lang"))
    return documents(spark, d, "source", "lang").select("doc_id", F.array_join(tx.template_headings(text), "|").alias("headings"))


@query("SELECT page_id, regexp_replace(h, '\\n{3,}', chr(10) || chr(10), 'g') AS collapsed, CAST(length(h) AS INTEGER) AS n FROM (SELECT page_id, replace(html, '><', '>' || chr(10) || chr(10) || chr(10) || '<') AS h FROM pages)")
def q_collapse_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    h = F.replace(F.col("html"), F.lit("><"), F.lit(">\n\n\n<"))
    return load(spark, d, "pages").select("page_id", F.regexp_replace(h, r"\n{3,}", "\n\n").alias("collapsed"), F.length(h).alias("n"))


@query(r"SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) > 900 THEN 'too long' WHEN regexp_matches(s, '(?i)(?:^|[^\p{L}\p{N}_])(import|open|exec|eval|compile|globals|locals|__|os|sys|subprocess|socket|pathlib|shutil|input)(?:$|[^\p{L}\p{N}_])') THEN 'blocked' END AS verdict FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents)")
def q_code_verdict(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.code_verdict(F.col("text")).alias("verdict"))
