"""Word lists, patterns, limits and codes that results depend on."""

from __future__ import annotations

# Character classes, for use inside brackets. White space is every character that counts as such in Unicode.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{3400}-\x{9FFF}"
HAN = r"\x{4E00}-\x{9FFF}"
READABLE = CJK + "A-Za-z0-9"
S, NS = f"[{SPACE}]", f"[^{SPACE}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

BAD_CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f]"
ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"
REPLACEMENT = "\ufffd"
MOJIBAKE = ("锟斤拷", "Ã", "Â", "â€™", "â€œ", "â€\ufffd")
LATEX = r"\\[A-Za-z]+|\$"
GATE_PUNCTUATION = "，。；：！？、"
SCORE_PUNCTUATION = "，。；：！？、,.!?;:"
DOSAGE = r"\d+(?:\.\d+)?" + S + r"*(?:g|克|kg|mg|ml|mL|帖|付|枚|片|丸|粒|钱|分)"
NUMERALS = "一二三四五六七八九十百千〇零两"

BLOCKING = (
    "bad_control_characters", "mojibake", "replacement_characters", "zero_width_characters", "latex_artifacts", "abnormal_cjk_spaces",
    "forced_line_breaks", "duplicate_repeated_lines", "headingless_long_document", "invalid_heading_syntax", "nonstandard_heading_content",
    "heading_level_jump", "toc_page_heading_residue", "repeated_toc_heading_residue", "unstructured_front_matter_prefix", "pdf_md_mismatch",
    "mega_line", "low_heading_density",
)
#: Codes a text can get, in the order in which they are reported.
CODES = (
    "empty_text", "low_readable_chars", "low_punctuation_density", "forced_line_break_residue", "bad_control_characters", "mojibake",
    "replacement_characters", "zero_width_characters", "latex_artifacts", "abnormal_cjk_spaces", "forced_line_breaks", "duplicate_repeated_lines",
    "invalid_heading_syntax", "headingless_long_document", "nonstandard_heading_content", "heading_level_jump", "toc_page_heading_residue",
    "repeated_toc_heading_residue", "unstructured_front_matter_prefix", "mega_line", "low_heading_density",
)
#: What to do about a code.
HINTS = {
    "mojibake": "Text was decoded wrongly: go back to the source.", "replacement_characters": "Characters were lost: go back to the source.", "zero_width_characters": "Delete characters without width.",
    "abnormal_cjk_spaces": "Close gaps between characters.", "forced_line_breaks": "Join lines that a page's width cut.", "duplicate_repeated_lines": "Remove running heads and feet.",
    "headingless_long_document": "Give a long document headings.", "invalid_heading_syntax": "Put a space behind the marks of a heading, six at most.", "nonstandard_heading_content": "Take decoration, doses and cover fragments out of headings.",
    "heading_level_jump": "Let no heading be more than one level below the one before.", "toc_page_heading_residue": "Make entries of the contents list items.", "repeated_toc_heading_residue": "Keep one table of contents.",
    "unstructured_front_matter_prefix": "Remove what stands before the first heading.", "pdf_md_mismatch": "Make text and PDF from the same source again.", "mega_line": "Split the line into paragraphs again.", "low_heading_density": "Restore the headings.",
}
MEGA_LINE, SOFT_JOIN, REPAIR_PACK, REPAIR_SPLIT = 3000, 2000, 2990, 2490
LONG_READABLE, LONG_LINES, LOW_DENSITY_READABLE, LOW_DENSITY_HEADINGS = 2000, 80, 20_000, 5
FRONT_LINES = 120

MAJOR_HEADINGS = (
    "目录", "目錄", "日录", "日錄", "出版者的话", "出版说明", "内容提要", "编写说明", "序", "自序", "前言", "凡例", "凡 例", "医家小传",
    "专病论治", "临证特色", "临证经验", "学术思想", "年谱", "附录", "索引", "结语", "后记", "常见病辨证施针", "辨证选穴施针精要", "临床中医",
)
RELIABLE_FRONT = ("出版者的话", "出版说明", "内容提要", "目录", "目錄")
COVER_FRAGMENTS = ("临中床医", "临中家医", "临中家医床", "临家中床医", "临中", "家医")
SERIES_TITLES = ("中国百年百名中医临床家丛书", "现代著名老中医名著重刊丛书")
BODY_PARTS = ("头部", "面部", "项部", "颈部", "肩部", "背部", "胸部", "腹部", "腰部", "肘部", "腕部", "手部", "髀部", "髋部", "膝部", "踝部", "足部")
GATE_LABELS = tuple(x + "：" for x in BODY_PARTS)
CLEAN_LABELS = (*GATE_LABELS, "Shoulder:", "Elbow:", "Wrist:")
TABLE_HEADERS = (
    ("分类", "药名", "功效", "主治", "用量"),
    ("类别", "药名", "功效", "主治", "用量"),
    ("方名", "出处", "组成", "功效", "主治", "用法"),
    ("方名", "来源", "药物组成", "功效", "主治", "制用法"),
)
FRONT_MATTER_STARTS = "主编|编委|审定|编著|整理|作者|发行者|出版者|印刷者|经销者|邮政编码|传真|定价|书号|开本|ISBN|网址|社长热线|读者服务部电话|购书热线|官方微博|淘宝天猫网址|上架建议|中国版本图书馆|图书在版编目"
TITLE_PAGE_WORDS = "主编|执行主编|副主编|编委|编著|合著|整理|作者|责任编辑|封面设计|丛编项|图书|网店|购买"

#: rule id: what it does, risk, write mode
RULES = {
    "artifact.zero_width_remove": ("Remove zero-width characters.", "low", "auto_apply"),
    "artifact.replacement_char_remove": ("Remove replacement characters.", "medium", "auto_apply"),
    "artifact.form_feed_to_newline": ("Turn form feeds into line ends.", "low", "auto_apply"),
    "artifact.bad_control_remove": ("Remove control characters.", "low", "auto_apply"),
    "line_endings.normalize": ("Use one kind of line end.", "low", "auto_apply"),
    "metadata.trailing_archive_block_remove": ("Remove an archive's trailing metadata.", "low", "auto_apply"),
    "ocr.embedded_foreign_math_noise_remove": ("Remove theorems of another book.", "medium", "auto_apply"),
    "latex.unit_math_to_text": ("Turn formulas of doses and measures into text.", "low", "auto_apply"),
    "ocr.temperature_percent_to_celsius": ("Turn percent signs that stand for degrees into degrees.", "medium", "auto_apply"),
    "mineru.flowchart_transcribe": ("Turn recognised flowcharts near tables into tables.", "medium", "auto_apply"),
    "mineru.noise_details_remove": ("Remove recognised-figure blocks.", "low", "auto_apply"),
    "html.table_tags_to_markdown": ("Turn HTML tables into Markdown rows.", "medium", "auto_apply"),
    "structure.local_glue_split": ("Put labels on lines of their own.", "medium", "auto_apply"),
    "markdown.table_normalize": ("Close and even the rows of tables.", "medium", "auto_apply"),
    "structure.chronology_list_normalize": ("Turn year ranges into list items.", "medium", "auto_apply"),
    "paragraph.safe_line_join": ("Join lines that a page's width cut.", "medium", "auto_apply"),
    "markdown.blank_lines_and_trailing_newline": ("Fold blank lines, end with one line end.", "low", "auto_apply"),
}

PROFILES = (
    "general_standard_document", "academic_paper", "technical_manual", "legal_contract", "financial_report", "medical_reference", "chinese_medicine_reference",
)
