"""Markdown and HTML of distilled documents, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as tx

# What a translated document starts with.
TRANSLATION_HEAD = """# 全文翻译（{language}）

- 论文标题：{title}
- 生成时间：{now}
- 说明：以下按文章章节组织翻译结果，术语（如 MNIST、ResNet、ASR）保留英文。"""


def _fill(template: str, **values: Column) -> Column:
    c = F.lit(template)
    for name, v in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), v)
    return c


def translation_markdown(title: Column, language: Column, sections: Column, failures: Column, now: Column) -> Column:
    """Head, a warning where pieces failed, then each section; ``sections`` is an array with title and content."""
    head = _fill(TRANSLATION_HEAD, language=language, title=title, now=now)
    warned = F.when(failures > 0, F.concat(head, F.lit("\n- 警告：有 "), failures, F.lit(" 段翻译服务失败，已回退原文。"))).otherwise(head)
    heading = lambda s: F.when(F.startswith(F.trim(s["title"]), F.lit("#")), s["title"]).otherwise(F.concat(F.lit("## "), s["title"]))
    body = F.array_join(F.transform(sections, lambda s: F.concat(heading(s), F.lit("\n\n"), F.when(s["content"] == "", "N/A").otherwise(s["content"]))), "\n\n")
    full = F.when(F.size(sections) == 0, F.concat(warned, F.lit("\n\n## 内容为空\n未提取到可读文本。\n"))).otherwise(F.concat(warned, F.lit("\n\n"), body))
    return F.concat(tx.strip(full), F.lit("\n"))


def layout_body(sections: Column) -> Column:
    """One block of HTML for each section."""

    def block(s: Column) -> Column:
        mark = F.trim(s["title"])
        level = F.when(F.startswith(mark, F.lit("#")), F.least(F.lit(4), F.greatest(F.lit(2), F.length(mark) - F.length(F.replace(mark, F.lit("#"), F.lit("")))))).otherwise(2).cast("string")
        text = F.regexp_replace(F.replace(tx.html_escape(s["content"]), F.lit("\n"), F.lit("<br>")), r"\[Page\s+(\d+)\]", "<h3>第 $1 页</h3>")
        return F.concat(F.lit("<h"), level, F.lit(">"), tx.html_escape(F.trim(F.regexp_replace(mark, "^#+", ""))), F.lit("</h"), level, F.lit("><p>"), text, F.lit("</p>"))

    return F.when(F.size(sections) > 0, F.array_join(F.transform(sections, block), "\n")).otherwise("<p>未提取到可读文本。</p>")


def _bullets(items: Column, most: int, cap: int) -> Column:
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x, i: F.concat(i + 1, F.lit(". "), F.substring(x, 1, cap))), "\n")


def fallback_answer(question: Column, contexts: Column) -> Column:
    """What is said when no model answers: the first three contexts, 300 characters of each."""
    listed = F.concat(F.lit("关于「"), question, F.lit("」的回答：\n\n以下信息来自当前论文的检索结果，供参考：\n"), _bullets(contexts, 3, 300))
    return F.when(F.size(contexts) > 0, listed).otherwise(F.concat(F.lit("关于「"), question, F.lit("」：抱歉，当前无法获取足够信息来回答这个问题。请确认论文已完成解析，或尝试换个问法。")))


def result_name(kind: Column, template: Column) -> Column:
    """summary_<stem>.md for summaries, <kind>.md for others."""
    stem = F.regexp_replace(F.element_at(F.split(template, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.when(kind == "summary", F.concat(F.lit("summary_"), stem, F.lit(".md"))).otherwise(F.concat(kind, F.lit(".md")))


def sse_frame(event: Column | None, payload: Column) -> Column:
    """A server-sent event; without a name, data only."""
    data = F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))
    return data if event is None else F.concat(F.lit("event: "), event, F.lit("\n"), data)
