"""The documents that the platform writes: summaries, improvement reports and the page in two columns, as Columns.

Texts and their order are fixed; what varies is filled in by name. Lists are arrays in their order, and a list without entries has
a line of its own. What a model extracted comes as JSON: a key that is missing, or null, leaves what patterns found in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as tx

from .render import layout_body

# The generic summary, and its lines for lists without entries.
SUMMARY = """# 论文摘要（{domain}）

## 基本信息
- 论文标题：{title}
- 摘要模板：{template}
- 目标语种：{language}
- 领域标签：{tags}
- 生成时间：{now}

## 核心要点（中文）
{points}

## 证据片段（中文）
{evidence}
"""
POINT, NO_POINTS = "- 要点 {n}: {text}", "- 未提取到稳定文本，建议检查 PDF 是否为可复制文本版。"
EVIDENCE, NO_EVIDENCE = "- 片段 {n}: {text}", "- 暂无证据片段。"

# The summary of the attack domain.
ATTACK = """# 论文深度解析报告

## 1. 速览 (TL;DR)
**所属领域**：{domain}
**两句话概括**：{summary}

## 2. 核心关注点 (Core Focus)

### 2.1 数据集与模型
- **数据集**：{datasets}
- **目标模型**：{models}

### 2.2 实验基线与防御
- **对比攻击方法**：{baselines}
- **测试的防御方法**：N/A（可后续扩展）

### 2.3 关键指标
- **中毒率 (Poison Rate)**：{poison}
- **攻击成功率 (ASR)**：{asr}
- **干净准确率下降 (CDA)**：{clean}

### 2.4 主要贡献{contributions}

## 3. 扩展关注点

### 3.1 攻击与触发器设计
- **攻击阶段**：{attack}
- **触发器类型**：{trigger}

### 3.2 局限性与风险
- **作者指出的局限**：N/A
- **潜在风险**：该攻击可在低中毒率下实现高 ASR，具有较高现实部署风险。

## 4. 核心效果对比表

| 项目          | 本文数值                  | 对比最佳方法 | 提升/下降 |
|---------------|---------------------------|--------------|-----------|
| 中毒率        | {poison}            | N/A         | N/A      |
| ASR           | {asr}             | N/A         | N/A      |
| CDA           | {clean}           | N/A         | N/A      |

- 论文标题：{title}
- 生成时间：{now}

## 证据片段（中文）
{evidence}"""

# The improvement report, its ideas, and its lines for lists without entries.
IMPROVEMENT = """# 《{title}》改进与创新建议

- 关联领域：{tags}
- 当前模型列表：生成模型：{generator} | 评估模型：{reviewer}
- 协同模式：Multi-Agent Collaboration: {generator} (Gen) + {reviewer} (Eval)
- 执行顺序：先生成 -> 后评估 -> 再 ToT 分支扩展与剪枝
- 生成时间：{now}
{strategy}

## 一、当前方案的主要短板（中文）
{highlights}

## 二、可执行创新点与具体方案
{ideas}## 三、90 天落地计划（建议）
- 第 1-30 天：复现实验基线，统一数据处理与评价脚本，确定核心对比表。
- 第 31-60 天：实现 1-2 个高优先级创新点，完成消融实验和防御评估。
- 第 61-90 天：补齐跨模型/跨数据集验证，输出论文级图表与误差分析。

## 四、证据片段（中文）
{evidence}
"""
IDEA = """### 创新点 {n}: {name}
- 具体方案：{plan}
- 实验验证：{validation}
- 风险与应对：{risk}
"""
SCORES = "- 评审分项：ASR_Gain={gain}, Implementation_Cost={cost}, Stealthiness={stealth}\n"
SCORE, STEP, TRACE, REASON, REVIEW = "- 综合评分：{x}\n", "- {x}\n", "- 执行轨迹：{x}\n", "- 选择理由：{x}\n", "- Reviewer 备注：{x}\n"
BY_BRANCHES, BY_RULES, NO_BRANCHES = "- 生成策略：ToT 分支评估（最佳分支输出）", "- 生成策略：规则库回退（原因：{x}）", "ToT 未启用"
HIGHLIGHT, NO_HIGHLIGHTS = "{n}. {text}", "1. 暂未提取到足够文本证据，建议先检查 PDF 文本可读性。"
QUOTE, NO_QUOTES = "- 证据 {n}: {text}", "- 暂无可引用证据片段。"

# The page in two columns.
PAGE = """<!doctype html>
<html lang="zh-CN">
<head>
  <meta charset="utf-8">
  <meta name="viewport" content="width=device-width, initial-scale=1">
  <title>{title} - 翻译版式</title>
  <style>
    :root { color-scheme: light; }
    body { margin: 0; background: #f1f5f9; font-family: 'Noto Serif SC', 'Source Han Serif SC', serif; color: #111827; }
    .page { width: min(1200px, calc(100vw - 24px)); margin: 12px auto; background: white; border: 1px solid #cbd5e1; border-radius: 12px; }
    .head { padding: 16px 20px; border-bottom: 1px solid #e2e8f0; }
    .head h1 { margin: 0 0 6px; font-size: 22px; }
    .head p { margin: 0; color: #475569; font-size: 13px; }
    .cols { column-count: 2; column-gap: 26px; padding: 18px 20px 24px; line-height: 1.75; font-size: 14px; }
    .cols h3 { margin: 12px 0 8px; font-size: 15px; color: #0f172a; break-inside: avoid; }
    .cols p { margin: 0 0 10px; text-align: justify; break-inside: avoid; }
    @media (max-width: 900px) { .cols { column-count: 1; } }
  </style>
</head>
<body>
  <section class="page">
    <div class="head">
      <h1>{title}</h1>
      <p>目标语言：{language}｜双栏阅读版（接近论文阅读版式）</p>
    </div>
    <article class="cols">
      {body}
    </article>
  </section>
</body>
</html>"""
NO_BODY = "<p>未提取到可读文本。</p>"

# Ideas by rule, for the attack domain and for others: name, plan, validation, risk.
ATTACK_IDEAS = (
    ("分布偏移驱动的触发器自适应优化", "将样本分布偏移评分与触发器参数联合优化，按类别动态调整触发器强度和位置。", "在 CIFAR-10/CIFAR-100 上报告 ASR、CA、LPIPS，并与固定触发器对比。", "可能牺牲隐蔽性；通过加入感知约束和人审阈值缓解。"),
    ("双层优化的防御感知投毒", "外层最大化攻击成功率，内层显式模拟常见检测器（频谱检测/激活聚类）并最小化可检测性。", "在至少 3 种防御下评估攻击前后 ASR 降幅与检测召回率。", "训练开销增大；通过低秩近似与子集采样控制成本。"),
    ("跨模型迁移后门构造", "使用教师-学生特征一致性损失，提升后门在 ResNet/ViT 间的迁移稳定性。", "报告跨架构迁移矩阵（source→target）的 ASR/CA。", "迁移增强可能降低 clean 精度；引入权重退火平衡。"),
    ("物理世界鲁棒触发器", "训练加入打印、压缩、模糊、视角变化增强，构建可落地触发器。", "仿真 + 实拍两阶段评估，输出真实场景 ASR。", "实验成本高；先在仿真管线筛选候选触发器。"),
    ("后门风险评分与预警系统", "构建样本级风险分数（特征残差 + 决策边界不稳定性），用于训练前后门预筛查。", "在含后门与干净数据混合场景下评估 AUC/F1。", "误报率偏高；采用分层阈值和人工复核流程。"),
)
OTHER_IDEAS = (
    ("数据覆盖增强", "按难样本分层采样并补齐长尾分布，减少方法对单一数据分布的过拟合。", "对比扩充前后在 OOD 测试集上的指标变化。", "数据成本上升；优先引入高收益子集。"),
    ("多目标训练策略", "把性能、鲁棒性、可解释性纳入统一损失函数并进行权重搜索。", "绘制 Pareto 前沿并给出权衡点。", "超参数敏感；采用网格+贝叶斯混合搜索。"),
    ("复现工程化", "固定随机种子、配置模板化、日志结构化，降低实验不可重复风险。", "跨 3 次重复实验报告方差。", "工程改造周期增加；分阶段推进。"),
)

#: An idea; all after ``risk`` may be null, and then has no line.
IDEA_TYPE = "struct<name:string,plan:string,validation:string,risk:string,asr_gain:double,implementation_cost:double,stealthiness:double,final_score:double,model_steps:array<string>,execution_order:string,selection_reason:string,review_comment:string>"


def fill(template: str, /, **values: Column) -> Column:
    """A text with columns in the place of their names in braces; other braces stay."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def listed(items: Column, line: str, none: str, most: int, cap: int | None = None) -> Column:
    """A line for each of the first entries, cut where a cap is given; ``none`` where there are none."""
    cut = (lambda x: F.substring(x, 1, cap)) if cap else (lambda x: x)
    lines = F.array_join(F.transform(F.slice(items, 1, most), lambda x, i: fill(line, n=i + 1, text=cut(x))), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(none)


def summary(title: Column, template: Column, language: Column, tags: Column, points: Column, evidence: Column, now: Column) -> Column:
    """The generic summary: metadata, at most 8 points, and 4 pieces of evidence of 260 characters."""
    return fill(
        SUMMARY, domain=tx.domain_tag(template), title=title, template=template, language=language, tags=F.array_join(tags, ", "), now=now,
        points=listed(points, POINT, NO_POINTS, 8), evidence=listed(evidence, EVIDENCE, NO_EVIDENCE, 4, 260),
    )


def extracted(answer: Column) -> Column:
    """What a model's answer says of an attack paper: a struct of ten fields from the first JSON object in it, each null if it is
    not there. A field that is meant as a list is one of its characters where it is a text, as it is for the platform."""

    def read(json: Column) -> Column:
        v = F.try_parse_json(json)
        words = lambda k: F.try_variant_get(v, f"$.{k}", "array<string>")
        text = lambda k: F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(words(k), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")), F.try_variant_get(v, f"$.{k}", "string")).alias(k)
        letters = lambda k: F.coalesce(words(k), F.filter(F.split(F.try_variant_get(v, f"$.{k}", "string"), ""), lambda x: x != "")).alias(k)
        return F.struct(*map(text, ("two_sentence_summary", "datasets", "target_models", "attack_type", "trigger_type")), *map(letters, ("baselines", "poison_rates", "asr_values", "clean_acc_drop", "contributions")))

    return tx.let(tx.first_json_object(answer), read)


def attack_summary(title: Column, template: Column, text: Column, points: Column, evidence: Column, answer: Column, now: Column) -> Column:
    """The summary of the attack domain: what the model extracted, else what patterns find in the text, else N/A."""

    def body(x: Column) -> Column:
        none = F.lit("N/A")
        first = lambda k, other: F.coalesce(F.get(x[k], 0), other)
        return fill(
            ATTACK, domain=tx.domain_tag(template), title=title, now=now, summary=F.coalesce(x["two_sentence_summary"], F.get(points, 0), none),
            datasets=F.coalesce(x["datasets"], tx.indicator(text, "primary_dataset")), models=F.coalesce(x["target_models"], none), baselines=F.array_join(F.coalesce(x["baselines"], F.array(none)), ", "),
            poison=first("poison_rates", none), asr=first("asr_values", tx.indicator(text, "asr")), clean=first("clean_acc_drop", tx.indicator(text, "clean_acc")),
            contributions=F.array_join(F.transform(F.slice(F.coalesce(x["contributions"], F.array(none, none, none)), 1, 3), lambda c: F.concat(F.lit("\n- "), c)), ""),
            attack=F.coalesce(x["attack_type"], tx.indicator(text, "attack_setting")), trigger=F.coalesce(x["trigger_type"], tx.indicator(text, "trigger_type")),
            evidence=listed(evidence, EVIDENCE, NO_EVIDENCE, 4, 260),
        )

    return tx.let(extracted(answer), body)


def rule_ideas(tags: Column) -> Column:
    """Ideas by rule: an array of IDEA_TYPE, those of the attack domain where any tag says so."""
    made = lambda rows: F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("name", "plan", "validation", "risk"), row, strict=True)), *(F.lit(None).alias(f"_{i}") for i in range(8))).cast(IDEA_TYPE) for row in rows))
    return F.when(F.contains(F.lower(F.array_join(tags, " ")), F.lit("backdoor")), made(ATTACK_IDEAS)).otherwise(made(OTHER_IDEAS))


def _idea(x: Column, i: Column) -> Column:
    some = lambda line, c: F.coalesce(fill(line, x=c), F.lit(""))
    said = lambda line, c: F.when(c != "", fill(line, x=c)).otherwise("")
    steps = F.array_join(F.transform(F.filter(x["model_steps"], lambda s: tx.strip(s) != ""), lambda s: fill(STEP, x=s)), "")
    scores = F.when(x["asr_gain"].isNotNull(), fill(SCORES, gain=x["asr_gain"], cost=F.coalesce(x["implementation_cost"].cast("string"), F.lit("None")), stealth=F.coalesce(x["stealthiness"].cast("string"), F.lit("None")))).otherwise("")
    return F.concat(
        fill(IDEA, n=i + 1, name=x["name"], plan=x["plan"], validation=x["validation"], risk=x["risk"]), scores, some(SCORE, x["final_score"]), F.coalesce(steps, F.lit("")),
        said(TRACE, x["execution_order"]), said(REASON, x["selection_reason"]), said(REVIEW, x["review_comment"]), F.lit("\n"),
    )


def improvement(title: Column, tags: Column, highlights: Column, evidence: Column, ideas: Column, branches: Column, note: Column, now: Column, generator: str, reviewer: str) -> Column:
    """The improvement report: at most 4 highlights, 5 pieces of evidence of 220 characters, and the ideas (array of IDEA_TYPE).

    ``branches`` says whether the ideas come from scored branches; ``note`` why not.
    """
    reason = F.coalesce(F.nullif(note, F.lit("")), F.lit(NO_BRANCHES))
    return fill(
        IMPROVEMENT, title=title, tags=F.array_join(tags, ", "), generator=F.lit(generator), reviewer=F.lit(reviewer), now=now,
        strategy=F.when(branches & (F.size(ideas) > 0), BY_BRANCHES).otherwise(fill(BY_RULES, x=reason)), highlights=listed(highlights, HIGHLIGHT, NO_HIGHLIGHTS, 4),
        ideas=F.array_join(F.transform(ideas, _idea), ""), evidence=listed(evidence, QUOTE, NO_QUOTES, 5, 220),
    )


def page(title: Column, language: Column, sections: Column) -> Column:
    """The page in two columns of a translated document's sections (title, content)."""
    body = F.when(F.size(sections) > 0, layout_body(sections)).otherwise(NO_BODY)
    return fill(PAGE, title=tx.html_escape(title), language=tx.html_escape(language), body=body)
