"""Display texts. They appear verbatim in rendered results.

``TEXTS`` holds sentence templates, ``FIELD_LABELS`` and ``SECTION_LABELS`` hold headings. Each is
keyed by locale so that another language is another entry, not other code.
"""

from __future__ import annotations

DEFAULT_LOCALE = "zh"

TEXTS = {
    "zh": {
        "missing": "未明确说明",
        "not_provided": "未提供",
        "untitled_document": "未命名文档",
        "unnumbered_figure": "未编号图表",
        "insufficient": "不足以判断",
        "low": "低",
        "mid": "中",
        "no_title": "标题未能通过规则可靠识别。",
        "no_section": "未通过规则可靠识别章节：{}。",
        "no_figure": "未通过规则可靠识别图表 caption。",
        "body_references": "正文引用：",
        "evidence_caption": "caption 提供了图的主要语义线索：",
        "evidence_reference": "正文引用提到：",
        "evidence_image": "PDF 解析阶段已关联到局部图片块，可作为后续 MCP 视觉切分输入。",
        "evidence_snapshot": "当前仅有整页截图，局部图区域仍需后续 MCP grounding。",
        "uncertain_image": "尚未关联精确 figure crop，当前语义主要来自 caption 和正文引用。",
        "uncertain_reference": "正文缺少明确引用段落，图文一致性证据较弱。",
        "panel_summary": "基于 caption 检测到 panel ({})。",
        "caption_summary": "caption 摘要：",
        "focus_method": "方法流程与系统组成",
        "focus_result": "实验结果比较",
        "focus_other": "图表语义待进一步确认",
        "fallback_observation": "自动回退：当前只保留 caption / 正文引用 / 语义证据中的保守观察。",
        "consistency_supported": "自动回退：证据对象可用，但未生成更细粒度结论。原因：",
        "consistency_unsupported": "自动回退：证据不足，当前无法验证图文一致性。原因：",
        "reason_no_model": "未配置 LLM",
        "reason_unparsable": "模型输出不可解析",
    },
}

SECTION_LABELS = {
    "zh": {
        "abstract": "摘要（Abstract）",
        "introduction": "引言（Introduction）",
        "figures": "图示（Figures）",
        "method": "方法（Method）",
        "experimental_setup": "实验设置（Experimental Setup）",
        "results": "结果（Results）",
        "discussion": "讨论（Discussion）",
        "conclusion": "结论（Conclusion）",
    },
}

FIELD_LABELS = {
    "zh": {
        "metadata": "基础信息",
        "title": "标题",
        "authors": "作者",
        "venue": "期刊/会议",
        "year": "年份",
        "extracted_notes": "提取要点",
        "research_problem": "研究问题",
        "core_method": "核心方法",
        "datasets": "数据集",
        "experimental_setup": "实验设置",
        "main_results": "主要结果",
        "novelty": "创新点",
        "strengths": "优点",
        "limitations": "局限性",
        "reproducibility": "复现建议",
        "discussion": "讨论",
        "sections": "章节信息",
        "selected_sections": "重点章节",
        "source_structure": "源文档结构",
        "semantic_artifacts": "图片语义证据",
        "figure_evidence": "图像证据",
        "figure_analyses": "图表分析",
        "figure_id": "图号",
        "figure_title_or_caption": "图注",
        "figure_type": "图类型",
        "semantic_source": "语义来源",
        "evidence_quality": "证据质量",
        "direct_evidence": "直接证据",
        "uncertainties": "不确定性",
        "extraction_source": "提取来源",
        "image_block_paths": "图片块路径",
        "crop_path": "裁剪图路径",
        "visible_text": "可见文本",
        "axes": "坐标轴",
        "legend_items": "图例项",
        "panels": "子图",
        "panel_id": "子图编号",
        "panel_label": "子图标签",
        "panel_type": "子图类型",
        "experiment_focus": "实验焦点",
        "compared_items": "比较对象",
        "metrics_or_axes": "指标/坐标",
        "main_observations": "主要观察",
        "claimed_conclusion": "作者结论",
        "consistency_check": "图文一致性检查",
        "confidence": "置信度",
        "parser_kind": "解析器类型",
        "page_count": "页数",
        "doi": "DOI",
        "section_order": "章节顺序",
        "figure_count": "图表数量",
        "summary": "摘要",
        "key_points": "要点",
        "markdown_report": "Markdown 报告",
        "structured_data": "结构化信息",
    },
}

STAGE_LABELS = {
    "zh": {
        "pending": ("任务排队", "后端已接收文件，等待进入执行队列。"),
        "parsing": ("文档解析", "正在解析文档结构并提取可分析内容。"),
        "analyzing": ("多 Agent 分析", "正在执行多 agent 分析与报告生成。"),
        "completed": ("任务完成", "分析完成，报告和结构化结果已生成。"),
        "failed": ("任务失败", "任务执行失败，请结合日志定位原因。"),
        "unknown": ("状态未知", "任务状态未知。"),
    },
}

STEP_LABELS = {
    "zh": {"upload": "文件接收", "parse": "文档解析", "analyze": "多 Agent 分析", "artifact": "结果生成"},
}

# Headings and sentence parts of the rendered reports.
REPORT = {
    "zh": {
        "parsed_title": "# PDF 结构化解析",
        "parsed_basics": "## 基础信息",
        "parsed_figures": "## 图表元数据",
        "parsed_fields": ["标题", "作者", "DOI", "期刊/会议", "年份", "页数", "图表数量"],
        "figure_fields": ["Caption", "页码", "页截图路径", "正文引用"],
        "research_title": "# 文献分析报告",
        "research_basics": ["标题", "作者", "发表平台", "年份"],
        "research_chapters": [
            ("1. 基本信息", []),
            ("2. 摘要式总结", []),
            ("3. 研究问题", ["3.1 背景", "3.2 论文要解决的问题"]),
            ("4. 方法", ["4.1 方法概述", "4.2 关键模块", "4.3 创新点"]),
            ("5. 实验与结果", ["5.1 实验设置", "5.2 主要结果", "5.3 与基线对比", "5.4 作者结论"]),
            ("6. 图表分析", ["6.1 关键图表", "6.2 图中结论", "6.3 图文一致性"]),
            ("7. 评价", ["7.1 优点", "7.2 局限性", "7.3 可复现性"]),
            ("8. 启发与参考价值", ["8.1 适用场景", "8.2 对当前研究的启发"]),
            ("9. 总结", []),
        ],
        "summary_problem": "> 这篇论文主要研究{}。",
        "summary_method": "> 核心方法是{}。",
        "summary_results": "> 主要结果表明{}。",
        "summary_fallback": "> 这篇论文主要研究内容可概括为：{}",
        "datasets_line": "涉及数据集：{}。",
        "baseline_line": "- {}：比较对象包括 {}；主要观察为 {}",
        "consistency_line": "- {}：{}（置信度：{}）",
        "figure_line": "- {}：{}",
        "scenario_datasets": "该方法可优先参考于与 {} 类似的数据或任务场景。",
        "scenario_venue": "可优先用于与 {} 相关的研究问题与实验设计参考。",
        "evidence_fields": ["图注摘要", "图类型", "指标 / 坐标", "证据质量", "直接证据"],
        "analysis_fields": ["图注", "实验焦点", "比较对象", "指标 / 坐标", "主要观察", "作者结论", "置信度"],
        "general_chapters": ["标题", "摘要", "要点", "局限性", "结构化信息"],
        "paper_title": "# 论文分析报告",
        "paper_chapters": [
            "基础信息", "研究问题", "核心方法", "数据集", "实验设置", "主要结果", "创新点", "优点", "局限性", "复现建议",
        ],
        "paper_basics": ["标题", "作者", "期刊/会议", "年份"],
    },
}


def text(key: str, locale: str = DEFAULT_LOCALE) -> str:
    return TEXTS[locale][key]


def report(key: str, locale: str = DEFAULT_LOCALE):
    return REPORT[locale][key]
