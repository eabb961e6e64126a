"""A view of documents with the artefacts that the cleaning and gate operators look for.

The test tables hold almost none of them, so each document gets one kind by its id. The expressions are plain SQL that
both engines read alike.
"""

from __future__ import annotations

from docgate.functions.dialect import Dialect

NL = "chr(10)"
BS = "chr(92)"
#: By doc_id modulo their number.
CASES = (
    "text",
    f"'# 标题' || {NL} || {NL} || text",
    "substr(text, 1, 10) || '\u200b' || substr(text, 11)",
    "'\ufffd' || text",
    "substr(text, 1, 5) || chr(7) || substr(text, 6)",
    f"replace(text, {NL}, chr(13) || {NL})",
    f"text || {NL} || '用量 $9' || {BS} || 'mathrm{{g}}$ 一次'",
    f"'<table><tr><th>方名</th><th>出处</th></tr><tr><td>甲方</td><td>乙书</td></tr></table>' || {NL} || text",
    f"'| 方名 | 出处 |' || {NL} || '| 甲 | 乙 |' || {NL} || {NL} || '| 丙 | 丁 |' || {NL} || text",
    f"'页脚第一册' || {NL} || text || {NL} || '页脚第一册' || {NL} || '页脚第一册' || {NL} || '页脚第一册'",
    f"'# 上篇' || {NL} || text || {NL} || '### 跳级' || {NL} || '## 中篇' || {NL} || '###### 底' || {NL} || '#无空格'",
    f"'# 书名' || {NL} || {NL} || '## 目录' || {NL} || '- 总论 3' || {NL} || '- 各论……12' || {NL} || '## 总论 3' || {NL} || text || {NL} || '## 各论……12' || {NL} || '## 余论／25' || {NL} || '# 目 录'",
    f"'# 长行' || {NL} || repeat(replace(substr(text, 1, 300), {NL}, ' ') || '。', 12) || {NL} || text",
    f"'# 折行' || {NL} || '患者自述头痛已有三年之久每逢阴雨天气' || {NL} || '则疼痛加重而且伴有恶心呕吐等症状' || {NL} || {NL} || '曾经多方治疗但是效果始终不够理想的' || {NL} || {NL} || '现在来院就诊要求用中药进行系统治疗。' || {NL} || text",
    f"'# 年谱' || {NL} || '1901~1911年 就学' || {NL} || '1912～1949年行医' || {NL} || '头部：百会。面部：印堂' || {NL} || text",
    f"text || {NL} || {NL}",
    f"'封面' || {NL} || '某某主编' || {NL} || '# 前言' || {NL} || text || {NL} || '# ★★' || {NL} || '## （12）'",
    f"'# Ã 乱码' || {NL} || '甲  乙' || {NL} || text",
    f"'# 前言' || {NL} || {NL} || '前' || {NL} || '言' || {NL} || '目' || {NL} || text",
    f"'# 目录' || {NL} || '- 甲证 3……12' || {NL} || '# 前言' || {NL} || '# 甲证 3' || {NL} || '## 乙证 (4)' || {NL} || '## 丙证 ^(5)' || {NL} || text",
    f"'# 散' || {NL} || '<details><summary>line</summary>x' || {NL} || 'y</details>' || {NL} || {NL} || {NL} || {NL} || {NL} || text || '   ' || {NL}",
    f"'# 引' || {NL} || text || {NL} || 'Document generated by Anna''s Archive around 2024' || {NL} || '{{\"filename_decoded\": 1}}' || {NL} || 'z'",
    f"'# 临中' || {NL} || '家' || {NL} || '医' || {NL} || '床' || {NL} || '# 中国百年百名中医临床家丛书' || {NL} || '# 前言' || {NL} || text",
    f"'# 前言' || {NL} || '![图](a.png)' || {NL} || {NL} || '某某教授' || {NL} || '乱字' || {NL} || {NL} || '# 12' || {NL} || {NL} || '# 自序' || {NL} || text",
    f"'# 引' || {NL} || text || {NL} || {NL} || 'Theorem 1.2. Let F(x) be a polynomial over a finite field and P a prime ideal with x ' || {BS} || 'in P, so that the claim holds.' || {NL} || {NL} || 'Theorem 1.2. short' || {NL} || '尾'",
    f"'# 出版说明' || {NL} || '话。' || {NL} || '# 中国百年百名中医临床家丛书' || {NL} || '某某主编' || {NL} || {NL} || '# 内容提要' || {NL} || text",
    f"'# 中国百年百名中医临床家丛书' || {NL} || '（按姓氏笔画排列）' || {NL} || repeat('王某某 李某某 ', 20) || {NL} || '# 目录' || {NL} || '- 一 1' || {NL} || text",
    f"'# 内容提要' || {NL} || '提要。' || {NL} || '出版发行：某社 印刷：某厂 开本：850毫米 印张：12' || {NL} || '# 目录' || {NL} || {NL} || '- ISBN 7-117-0' || {NL} || '人民卫生出版社，2006.12' || {NL} || '# 前言' || {NL} || text",
    f"text || {NL} || '# 图书在版编目（CIP）数据' || {NL} || 'ISBN 7' || {NL} || '定价：12.00元' || {NL} || '某出版社' || {NL} || '开本：850' || {NL} || '![a](b.png)'",
    f"text || {NL} || '# 中国百年百名中医临床家丛书（按姓氏笔画排列）' || {NL} || repeat('王某某李某某', 10)",
    f"text || {NL} || '版权页' || {NL} || '前言' || {NL} || '目录' || {NL} || '正文'",
    f"'# 目录' || {NL} || '- 一 1' || {NL} || text || {NL} || '# 目录' || {NL} || '# 医家小传' || {NL} || '# 专病论治' || {NL} || '# 甲' || {NL} || '# 乙' || {NL} || '# 丙'",
    f"'# 书' || {NL} || text || {NL} || '# 临中床医' || {NL} || '![x](y.jpg)' || {NL} || '定价：9元' || {NL} || {NL}",
    f"'#标题一' || {NL} || '# ※※' || {NL} || '# （3）' || {NL} || '## 丙 3g 丁 4g' || {NL} || '一、总论' || {NL} || '1. 分论' || {NL} || '案1 某' || {NL} || '#### 深层' || {NL} || '# # 嵌套' || {NL} || '####' || {NL} || text",
    f"'# 现代著名老中医名著重刊丛书' || {NL} || '现代著名老中医名著重刊丛书21. 发白 15' || {NL} || '第' || {NL} || {NL} || '一' || {NL} || '辑' || {NL} || text || {NL} || '# 现代著名老中医名著重刊丛书'",
    f"'药 $12' || {BS} || 'times 3' || {BS} || 'mathrm{{mg}}$ 温 $38.5^{{' || {BS} || 'circ}} ' || {BS} || 'mathrm{{C}}$ 经 14' || {BS} || 'frac 5~7 28~30 天，量 ' || {BS} || 'frac{{7}}{{8}} ' || {BS} || 'sim ' || {BS} || 'mu' || {NL} || text",
    f"text || {NL} || '# 索引' || {NL} || '二画' || {NL} || '- - 七日风 74' || {NL} || '（参见 12）' || {NL} || '子 晕 242' || {NL} || '三 画子悬 240' || {NL} || '参见 9 乙证 6' || {NL} || '三画' || {NL} || '三画丙·（参见 4） 5' || {NL} || '第一辑' || {NL} || '参见 3' || {NL} || '- 参见 8' || {NL} || '-四画丁 1'",
    f"'索引' || {NL} || '中医临证备要' || {NL} || '四画 参见 7' || {NL} || text || {NL} || '甲 1' || {NL} || '# 索引' || {NL} || '- 重 1'",
    f"repeat('正文一行，写得不短。' || {NL}, 9) || text || {NL} || '这里还有一段正文，写到二十个字以上才算够长了。正文[General Information]书名=某书' || {NL} || '作者=某人' || {NL} || {NL} || '| SS号=12345678 |'",
    f"text || {NL} || {NL} || '# 1. 甲' || {NL} || {NL} || 'SS号 = 12345' || {NL} || 'DX号=1' || {NL} || 'http://book2.duxiu.com/a'",
    f"repeat('正文一行，写得不短。' || {NL}, 30) || text || {NL} || '## 1. 甲' || {NL} || '## 2. 乙' || {NL} || {NL} || '## 3、 丙' || {NL} || '## 4. 丁' || {NL} || '## 5. 戊' || {NL} || '## 6. 己' || {NL} || '## 7. 庚' || {NL} || '## 8. 辛' || {NL}",
    f"'首。SS号=12345' || {NL} || text || {NL} || '# 1. 甲' || {NL} || '# 2. 乙' || {NL} || '# 3. 丙' || {NL} || '# 4. 丁' || {NL} || '# 5. 戊' || {NL} || '# 6. 己' || {NL} || '# 7. 庚' || {NL} || '# 8. 辛'",
    f"'书名=某书' || {NL} || text || {NL} || '页数=9' || {NL} || '尾'",
    f"text || {NL} || '四物汤' || {NL} || '当归 川芎' || {NL} || {NL} || '白芍9g 熟地黄12g' || {NL} || '四君子汤' || {NL} || '第一辑 人参 白术' || {NL} || {NL} || '真武汤 茯苓芍药白术附子' || {NL} || '# 下' || {NL} || '组成 大补元煎 人参山药熟地 枣真武汤 茯苓' || {NL} || '资生丸治疗脾虚，患者'",
    f"'桂枝 芍药 甘草' || {NL} || '麻黄汤 杏仁' || {NL} || '白虎汤散 石膏' || {NL} || text || {NL} || {NL} || '二陈汤' || {NL} || '半夏9g 陈皮6g' || {NL} || 'SS号=12345' || {NL} || '越婢汤 某某' || {NL}",
    f"'# 出版说明' || {NL} || '# 中国百年百名中医临床家丛书' || {NL} || '一句正文，不是题名页。' || {NL} || '# 内容提要' || {NL} || '# 中国百年百名中医临床家丛书' || {NL} || '某某主编' || {NL} || '# 前言' || {NL} || text || {NL} || '版权页' || {NL} || '文。' || {NL} || '版权页' || {NL} || '前言' || {NL} || '目录'",
    f"'# 中国百年百名中医临床家丛书' || {NL} || '文。' || {NL} || '# 目录' || {NL} || '# 中国百年百名中医临床家丛书' || {NL} || '（按姓氏笔画排列）' || {NL} || repeat('王某某 李某某 ', 20) || {NL} || '# 目录' || {NL} || text || {NL} || '# 中国百年百名中医临床家丛书（按姓氏笔画排列）' || {NL} || '# 目录' || {NL} || text || {NL} || '# 中国百年百名中医临床家丛书（按姓氏笔画排列）' || {NL} || repeat('王某某李某某', 10)",
    f"'表' || {NL} || '体温升至39%~40%，占40%例' || {NL} || '1. Theorem' || {NL} || '| 甲 | 乙' || {NL} || '丙 |' || {NL} || text || {NL} || 'References: Smith 1999 Jones A 2001 Doe'",
)
EMPTY_ID = -1


def view(d: Dialect) -> str:
    """Every document with all of its text, and an empty one."""
    cases = " ".join(f"WHEN {i} THEN {c.replace('{{', '{').replace('}}', '}')}" for i, c in enumerate(CASES))
    none = "string" if d.name == "spark" else "varchar"
    return f"""SELECT doc_id, lang, source, CASE doc_id % {len(CASES)} {_literals(d, cases)} END AS text FROM documents
        UNION ALL SELECT cast({EMPTY_ID} as bigint) AS doc_id, cast(NULL as {none}) AS lang, cast(NULL as {none}) AS source, '' AS text"""


def _literals(d: Dialect, sql: str) -> str:
    return sql.replace("Anna''s", r"Anna\'s") if d.name == "spark" else sql
