"""Documents of the platform against whole ones written out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.operators import documents as doc


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def texts(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


def test_summary(spark):
    got = one(spark, doc.summary(F.lit("T"), F.lit("my_notes.md"), F.lit("中文"), texts("My Notes", "NLP"), texts("p1", "p2"), texts(*(f"{i}" * 300 for i in range(5))), F.lit("now")))
    assert got == "# 论文摘要（My Notes）\n\n## 基本信息\n- 论文标题：T\n- 摘要模板：my_notes.md\n- 目标语种：中文\n- 领域标签：My Notes, NLP\n- 生成时间：now\n\n## 核心要点（中文）\n- 要点 1: p1\n- 要点 2: p2\n\n## 证据片段（中文）\n" + "".join(f"- 片段 {i + 1}: {str(i) * 260}\n" for i in range(4))
    empty = one(spark, doc.summary(F.lit("T"), F.lit("x.md"), F.lit("en"), texts(), texts(), texts(), F.lit("now")))
    assert empty.endswith("- 领域标签：\n- 生成时间：now\n\n## 核心要点（中文）\n- 未提取到稳定文本，建议检查 PDF 是否为可复制文本版。\n\n## 证据片段（中文）\n- 暂无证据片段。\n")


@pytest.mark.parametrize(("answer", "text", "want"), [
    (None, "ASR: 97.5% on MNIST", {"**攻击成功率 (ASR)**：": "97.5%", "**数据集**：": "MNIST", "**两句话概括**：": "first", "**对比攻击方法**：": "N/A", "| ASR           | ": "97.5%             | N/A         | N/A      |"}),
    ('x {"asr_values": ["1%"], "datasets": "D", "baselines": ["a", "b"], "poison_rates": "5%", "two_sentence_summary": "s"} y', "ASR: 97.5%", {"**攻击成功率 (ASR)**：": "1%", "**数据集**：": "D", "**两句话概括**：": "s", "**对比攻击方法**：": "a, b", "**中毒率 (Poison Rate)**：": "5"}),
    ("{broken", "", {"**攻击成功率 (ASR)**：": "N/A", "**干净准确率下降 (CDA)**：": "N/A", "**攻击阶段**：": "N/A", "**触发器类型**：": "N/A", "**目标模型**：": "N/A"}),
])
def test_attack_summary(spark, answer, text, want):
    got = one(spark, doc.attack_summary(F.lit("T"), F.lit("backdoor_attacks.md"), F.lit(text), texts("first"), texts(), F.lit(answer).cast("string"), F.lit("now")))
    lines = got.split("\n")
    for head, value in want.items():
        assert any(line.removeprefix("- ") == head + value for line in lines), (head, value)
    assert got.startswith("# 论文深度解析报告\n\n## 1. 速览 (TL;DR)\n**所属领域**：Backdoor Attack\n") and got.endswith("- 论文标题：T\n- 生成时间：now\n\n## 证据片段（中文）\n- 暂无证据片段。")
    assert "### 2.4 主要贡献\n- N/A\n- N/A\n- N/A\n\n## 3. 扩展关注点" in got


def test_improvement(spark):
    ideas = doc.rule_ideas(texts("Computer Vision"))
    got = one(spark, doc.improvement(F.lit("T"), texts("CV"), texts(), texts("e" * 300), ideas, F.lit(False), F.lit(None).cast("string"), F.lit("now"), "G", "E"))
    head = "# 《T》改进与创新建议\n\n- 关联领域：CV\n- 当前模型列表：生成模型：G | 评估模型：E\n- 协同模式：Multi-Agent Collaboration: G (Gen) + E (Eval)\n- 执行顺序：先生成 -> 后评估 -> 再 ToT 分支扩展与剪枝\n- 生成时间：now\n- 生成策略：规则库回退（原因：ToT 未启用）\n\n## 一、当前方案的主要短板（中文）\n1. 暂未提取到足够文本证据，建议先检查 PDF 文本可读性。\n\n## 二、可执行创新点与具体方案\n"
    assert got.startswith(head + "### 创新点 1: 数据覆盖增强\n- 具体方案：按难样本") and got.count("### 创新点") == 3
    assert got.endswith("- 风险与应对：工程改造周期增加；分阶段推进。\n\n## 三、90 天落地计划（建议）\n- 第 1-30 天：复现实验基线，统一数据处理与评价脚本，确定核心对比表。\n- 第 31-60 天：实现 1-2 个高优先级创新点，完成消融实验和防御评估。\n- 第 61-90 天：补齐跨模型/跨数据集验证，输出论文级图表与误差分析。\n\n## 四、证据片段（中文）\n- 证据 1: " + "e" * 220 + "\n")
    assert len(one(spark, doc.rule_ideas(texts("NLP", "Backdoor Defense")))) == 5
    none = F.array().cast(f"array<{doc.IDEA_TYPE}>")
    assert "## 二、可执行创新点与具体方案\n## 三、90" in one(spark, doc.improvement(F.lit("T"), texts(), texts("h"), texts(), none, F.lit(True), F.lit("why"), F.lit("now"), "G", "E"))


def test_page(spark):
    sections = F.array(F.struct(F.lit("### H & I").alias("title"), F.lit("a<b\n[Page 2]").alias("content")), F.struct(F.lit("plain").alias("title"), F.lit("x").alias("content")))
    got = one(spark, doc.page(F.lit("<T>"), F.lit("zh"), sections))
    assert "<title>&lt;T&gt; - 翻译版式</title>" in got and "\n    body { margin: 0;" in got and "\n    @media (max-width: 900px) { .cols { column-count: 1; } }\n" in got
    assert '<article class="cols">\n      <h3>H &amp; I</h3><p>a&lt;b<br><h3>第 2 页</h3></p>\n<h2>plain</h2><p>x</p>\n    </article>' in got
    assert "\n      <p>未提取到可读文本。</p>\n" in one(spark, doc.page(F.lit("T"), F.lit("zh"), F.slice(sections, 1, 0)))
