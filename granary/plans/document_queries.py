"""Queries of the documents that the platform writes: both summaries, the improvement report, ideas by rule, the page in two columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import documents as doc
from granary.sources.tables import load

from . import sql as q
from .registry import query
from .text_queries import _BLOCK, _ESCAPED, _NOTED, _SECTIONS, _TEMPLATE, _noted, _template, documents, section_lists

NOW = "2024-01-01T00:00:00Z"


def filled(template: str, /, **values: str) -> str:
    """SQL of a fixed text with expressions in the place of names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({values[p]})" if i % 2 else q.quoted(p) for i, p in enumerate(parts) if i % 2 or p)


def lines(xs: str, line: str, none: str, most: int, cap: int | None = None) -> str:
    one = filled(line, n="i", text=f"x[1:{cap}]" if cap else "x")
    return f"CASE WHEN len({xs}) > 0 THEN array_to_string(list_transform(list_slice({xs}, 1, {most}), lambda x, i: {one}), chr(10)) ELSE {q.quoted(none)} END"


#: (doc_id, source, lang, t: text, cs: chunks, pts: key sentences, template, domain) of all documents, those without text too.
_DOMAIN = "CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 WHEN 0 THEN 'General' WHEN 2 THEN 'Backdoor Defense' WHEN 3 THEN upper(source[1]) || source[2:] || ' Notes' ELSE 'Backdoor Attack' END"
_PAPERS = f"WITH {q.KEY_SENTENCES}, d AS (SELECT doc_id, source, lang, {_NOTED} AS t, coalesce(parts, []) AS cs, coalesce(pts, []) AS pts, {_TEMPLATE} AS template, {_DOMAIN} AS domain FROM documents LEFT JOIN k USING (doc_id))"


def papers(spark: SparkSession, d: str) -> DataFrame:
    both = tx.let(tx.chunks(F.col("text")), lambda cs: F.struct(cs.alias("cs"), tx.key_sentences(cs).alias("pts")))
    rows = documents(spark, d, "source", "lang").select("doc_id", "source", "lang", _noted(F.col("text")).alias("t"), both.alias("p"))
    return rows.select("doc_id", "source", "lang", "t", "p.cs", "p.pts", _template(F.col("source")).alias("template"))


def _answer() -> Column:
    """A model's answers by document: none, a whole one in a fence, one with gaps and texts for lists, one that is no JSON."""
    i, n = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    whole = F.concat(
        F.lit('Sure:\n```json\n{"two_sentence_summary": "It is '), i, F.lit('.", "datasets": ["A", "B'), i, F.lit('"], "target_models": "ResNet", "baselines": ["X", "Y"], "poison_rates": ["5%"], "asr_values": ["99%", "98%"], "clean_acc_drop": [1.5], "attack_type": "poison", "trigger_type": "patch", "contributions": ["a", "b", "c", "d"]}\n```'),
    )
    gaps = F.concat(F.lit('{"datasets": null, "baselines": "WaNet", "poison_rates": [], "asr_values": "9'), i, F.lit('%", "contributions": []}'))
    return F.when(n == 1, whole).when(n == 2, gaps).when(n == 3, "{no json}")


def _asked(whole: str, gaps: str, other: str) -> str:
    return f"CASE doc_id % 4 WHEN 1 THEN {whole} WHEN 2 THEN {gaps} ELSE {other} END"


def _found(name: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(t, {q.quoted('(?i)' + p)}, 1), '')" for p in tx.INDICATORS[name]) + ", 'N/A')"


_GENERIC = filled(
    doc.SUMMARY, domain="domain", title="doc_id", template="template", language="lang", tags="domain || ', ' || lang", now=f"'{NOW}'", points=lines("pts", doc.POINT, doc.NO_POINTS, 8), evidence=lines("cs", doc.EVIDENCE, doc.NO_EVIDENCE, 4, 260)
)
_SAID = "coalesce(pts[1], 'N/A')"
_ATTACK = filled(
    doc.ATTACK, domain="domain", title="doc_id", now=f"'{NOW}'", summary=_asked("'It is ' || doc_id || '.'", _SAID, _SAID), datasets=_asked("'[''A'', ''B' || doc_id || ''']'", _found("primary_dataset"), _found("primary_dataset")), models=_asked("'ResNet'", "'N/A'", "'N/A'"),
    baselines=_asked("'X, Y'", "'W, a, N, e, t'", "'N/A'"), poison=_asked("'5%'", "'N/A'", "'N/A'"), asr=_asked("'99%'", "'9'", _found("asr")), clean=_asked("'1.5'", _found("clean_acc"), _found("clean_acc")),
    contributions=_asked("chr(10) || '- a' || chr(10) || '- b' || chr(10) || '- c'", "''", "chr(10) || '- N/A' || chr(10) || '- N/A' || chr(10) || '- N/A'"),
    attack=_asked("'poison'", _found("attack_setting"), _found("attack_setting")), trigger=_asked("'patch'", _found("trigger_type"), _found("trigger_type")), evidence=lines("cs", doc.EVIDENCE, doc.NO_EVIDENCE, 4, 260),
)


@query(f"{_PAPERS} SELECT doc_id, CASE WHEN domain = 'Backdoor Attack' THEN {_ATTACK} ELSE {_GENERIC} END AS markdown FROM d")
def q_summary_md(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each document, of the attack domain where its template says so."""
    title, template, now = F.col("doc_id").cast("string"), F.col("template"), F.lit(NOW)
    attack = doc.attack_summary(title, template, F.col("t"), F.col("pts"), F.col("cs"), _answer(), now)
    generic = doc.summary(title, template, F.col("lang"), F.array(tx.domain_tag(template), F.col("lang")), F.col("pts"), F.col("cs"), now)
    return papers(spark, d).select("doc_id", F.when(tx.domain_tag(template) == "Backdoor Attack", attack).otherwise(generic).alias("markdown"))


def _plain_idea(n: int, idea: tuple) -> str:
    return filled(doc.IDEA, n=f"'{n}'", name=q.quoted(idea[0]), plan=q.quoted(idea[1]), validation=q.quoted(idea[2]), risk=q.quoted(idea[3])) + " || chr(10)"


def _rule_sql(ideas: tuple) -> str:
    return " || ".join(_plain_idea(n, x) for n, x in enumerate(ideas, 1))


_BRANCH = (
    filled(doc.IDEA, n="'1'", name="'try ' || source", plan="'plan'", validation="'N/A'", risk="'none'") + " || " + filled(doc.SCORES, gain="'7.5'", cost="'3.0'", stealth="'5.0'") + " || " + filled(doc.SCORE, x="'6.25'")
    + " || " + filled(doc.STEP, x="'made by g'") + " || " + filled(doc.TRACE, x="'g -> e'") + " || " + filled(doc.REASON, x="'best'") + " || CASE WHEN doc_id % 2 = 0 THEN " + filled(doc.REVIEW, x="'fine'") + " ELSE '' END || chr(10)"
)
_RULED = f"CASE WHEN domain LIKE 'Backdoor%' THEN {_rule_sql(doc.ATTACK_IDEAS)} ELSE {_rule_sql(doc.OTHER_IDEAS)} END"
_REPORT = filled(
    doc.IMPROVEMENT, title="doc_id", tags="domain || ', ' || lang", generator="'g'", reviewer="'e'", now=f"'{NOW}'",
    strategy=f"CASE doc_id % 3 WHEN 0 THEN {q.quoted(doc.BY_BRANCHES)} WHEN 1 THEN {filled(doc.BY_RULES, x=q.quoted('no key'))} ELSE {filled(doc.BY_RULES, x=q.quoted(doc.NO_BRANCHES))} END",
    highlights=lines("pts", doc.HIGHLIGHT, doc.NO_HIGHLIGHTS, 4), ideas=f"CASE doc_id % 3 WHEN 0 THEN {_BRANCH} WHEN 1 THEN {_RULED} ELSE '' END", evidence=lines("cs", doc.QUOTE, doc.NO_QUOTES, 5, 220),
)


@query(f"{_PAPERS} SELECT doc_id, {_REPORT} AS markdown FROM d")
def q_improvement_md(spark: SparkSession, d: str) -> DataFrame:
    """The improvement report of each document: ideas from scored branches, by rule, and none."""
    n, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    best = F.struct(F.concat(F.lit("try "), "source"), F.lit("plan"), F.lit("N/A"), F.lit("none"), F.lit(7.5), F.lit(3.0), F.lit(5.0), F.lit(6.25), F.array(F.lit("made by g"), F.lit(" ")), F.lit("g -> e"), F.lit("best"), F.when(F.col("doc_id") % 2 == 0, "fine").otherwise(""))
    tags = F.array(tx.domain_tag(F.col("template")), F.col("lang"))
    ideas = F.when(n == 0, F.array(best).cast(f"array<{doc.IDEA_TYPE}>")).when(n == 1, doc.rule_ideas(tags)).otherwise(F.array().cast(f"array<{doc.IDEA_TYPE}>"))
    report = doc.improvement(F.col("doc_id").cast("string"), tags, F.col("pts"), F.col("cs"), ideas, n == 0, F.when(n == 1, "no key").otherwise(none), F.lit(NOW), "g", "e")
    return papers(spark, d).select("doc_id", report.alias("markdown"))


_IDEAS = ", ".join(f"({str(b).lower()}, {i}, {', '.join(map(q.quoted, x))})" for b, xs in ((True, doc.ATTACK_IDEAS), (False, doc.OTHER_IDEAS)) for i, x in enumerate(xs))


@query(f"""
WITH i(backdoor, pos, name, plan, validation, risk) AS (VALUES {_IDEAS}), d AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 IN (1, 2, 4) AS backdoor FROM documents)
SELECT doc_id, pos, name, plan, validation, risk FROM d JOIN i USING (backdoor)
""")
def q_rule_ideas(spark: SparkSession, d: str) -> DataFrame:
    """Five ideas for papers of the attack domain and its defence, three for others."""
    tags = F.array(tx.domain_tag(_template(F.col("source"))))
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(doc.rule_ideas(tags)).alias("pos", "x"))
    return rows.select("doc_id", "pos", "x.name", "x.plan", "x.validation", "x.risk")


_TITLE = _ESCAPED.format(x="'<' || doc_id || '>'")


@query(f"""
WITH s AS ({_SECTIONS}), b AS (SELECT *, least(4, greatest(2, length(title) - length(replace(title, '#', '')))) AS l, trim(ltrim(title, '#')) AS h FROM s WHERE doc_id % 8 <> 0),
p AS (SELECT doc_id, string_agg({_BLOCK}, chr(10) ORDER BY section) AS body FROM b GROUP BY 1)
SELECT doc_id, {filled(doc.PAGE, title=_TITLE, language="lang", body=f"coalesce(body, {q.quoted(doc.NO_BODY)})")} AS page FROM documents LEFT JOIN p USING (doc_id)
""")
def q_layout_page(spark: SparkSession, d: str) -> DataFrame:
    """The page in two columns of each document; titles hold what has to be escaped, and every eighth has no sections."""
    rows = section_lists(spark, d).withColumn("s", F.when(F.col("doc_id") % 8 != 0, F.col("s")).otherwise(F.slice("s", 1, 0)))
    title = F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">"))
    return rows.join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", doc.page(title, F.col("lang"), F.col("s")).alias("page"))


_TRANSLATED = "'# 全文翻译（' || lang || '）' || chr(10) || chr(10) || '- 论文标题：' || doc_id || chr(10) || '- 生成时间：' || '2024-01-01T00:00:00Z' || chr(10) || '- 说明：以下按文章章节组织翻译结果，术语（如 MNIST、ResNet、ASR）保留英文。'"


@query(f"""
WITH s AS ({_SECTIONS}), p AS (SELECT doc_id, string_agg(title || chr(10) || chr(10) || CASE WHEN section % 3 = 1 THEN 'N/A' ELSE content END, chr(10) || chr(10) ORDER BY section) AS body FROM s WHERE doc_id % 8 <> 0 GROUP BY 1)
SELECT doc_id, {_TRANSLATED} || CASE WHEN doc_id % 4 > 0 THEN chr(10) || '- 警告：有 ' || doc_id % 4 || ' 段翻译服务失败，已回退原文。' ELSE '' END || chr(10) || chr(10) || coalesce(body, '## 内容为空' || chr(10) || '未提取到可读文本。') || chr(10) AS markdown
FROM documents LEFT JOIN p USING (doc_id)
""")
def q_translation_md(spark: SparkSession, d: str) -> DataFrame:
    """Translations with pieces that failed, sections without a body, and documents without sections."""
    from granary.operators import render

    bare = F.transform("s", lambda s: F.struct(s["title"].alias("title"), F.when(s["section"] % 3 == 1, "").otherwise(s["content"]).alias("content")))
    rows = section_lists(spark, d).withColumn("s", F.when(F.col("doc_id") % 8 != 0, bare).otherwise(F.slice(bare, 1, 0)))
    rows = rows.join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", render.translation_markdown(F.col("doc_id").cast("string"), F.col("lang"), F.col("s"), (F.col("doc_id") % 4).cast("int"), F.lit(NOW)).alias("markdown"))
