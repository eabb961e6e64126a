"""C7, C9, C10 and part of C13: what recognition got wrong inside a text, as expressions over its matches.

A pattern's matches and the texts between them are two arrays; each match becomes something by what it says and by what
stands around it, and all is joined again. So a rule that looks to both sides of a match needs no fold.
"""

from __future__ import annotations

from collections.abc import Callable

from docgate.functions import text as t
from docgate.functions.dialect import Dialect
from docgate.functions.lexicon import CJK

# What the rules look for.
THEOREM = rf"Theorem\s+[0-9]+(?:\.[0-9]+)*\.[^\n\r{CJK}]{{40,1000}}"
FOREIGN = ("finite field", "F(x)", "prime ideal", "\\in")
PROOF_END = r"\s*\\therefore\s+[A-Za-z]\s*-\s*[0-9]+\s*\\neq\s*[0-9]+\s*;?\s*"
CRUMB = rf"(^|\n)\s*(?:[0-9]+\.\s*)?\\therefore\s*[A-Za-z0-9_\\=,\s.\-+<>≤≥…]{{0,80}}([{CJK}#\n]|$)"
THEREFORE = r"\\therefore([^A-Za-z]|$)"
SEGMENT = "[^。！？!?；;\n]+|[。！？!?；;\n]"
FEVER = "体温|发热|高热|高烧|热势"
PERCENT = r"[0-9]{2}(?:\.[0-9]+)?\s*%"
SHARE_BEFORE = r"(?:占|占比|率|百分比|构成比)\s*$"
SHARE_BEHIND = r"^\s*(?:例|病例|人|患儿|患者|有效|治愈)"
RANGE = r"℃(?:\s+[~～]\s*|～\s*|~\s+)([0-9]{2}(?:\.[0-9]+)?℃)"
BODY_HEAT = (30, 45)
NO_WORD = r"[^\p{L}\p{N}_]"
REFERENCES = rf"(?:^|{NO_WORD})References:\s*[^\n]+"
REFERENCES_HEAD = rf"^(?s:({NO_WORD}?References:\s*))"
FLOWCHART = r"(?is)\n*<details>\s*<summary>\s*flowchart\s*</summary>.*?</details>\s*"
FLOWCHART_BODY = r"(?is)</summary>(.*?)</details>"
TABLE_IMAGE = r"(?i)!\[[^\]]*(?:表|table)[^\]]*\]\([^)]*\)\s*$"
TABLE_CAPTION = r"(?i)(?:^|\n)\s*(?:表|Table)\s*[0-9]+"
NO_EDGE = r"(?i)^(?:```|(?:flowchart|graph)(?:[^A-Za-z0-9_]|$))"
EDGE = "(?s)^(.*?)-->(.*)$"
BOX = r"""[\[({]\s*["”]?(.+?)["”]?\s*[\])}]"""
TABLE_TITLE = ("表格结构转写（由 MinerU flowchart 提取）", "", "| 项目 | 内容 |", "|---|---|")
LOOK_BACK = 500


def replaced(d: Dialect, x: str, pattern: str, v: str, new: Callable[[str, str, str, str], str]) -> str:
    """x with each match of pattern replaced by new(match, text before since the last match, text behind up to the next, all before it). v: a name for use inside."""
    gaps, found, gap, k = f"{v}.gaps", f"{v}.found", f"{v}_gap", f"{v}_k"
    both = d.array(d.struct(gaps=d.split(x, pattern), found=d.groups(x, pattern)))
    match = d.at(found, f"{k} + 1")
    # what stands before: texts between matches and these, one after another
    upto = f"concat({d.join(d.mapi(d.part(gaps, '1', k), f'{v}_g', f'{v}_j', f'concat({v}_g, {d.at(found, f'{v}_j + 1')})'), '')}, {gap})"
    made = f"concat({gap}, CASE WHEN {k} < {d.size(found)} THEN {new(match, gap, d.at(gaps, f'{k} + 2'), upto)} ELSE '' END)"
    return d.at(d.map(both, v, d.join(d.mapi(gaps, gap, k, made), "")), "1")


def foreign_math(d: Dialect, x: str) -> str:
    """Theorems of another book (two of four marks in them) and stray proofs' ends go."""

    def strange(match: str, *_: str) -> str:
        marks = " + ".join(f"CASE WHEN {d.contains(match, d.text(f))} THEN 1 ELSE 0 END" for f in FOREIGN)
        return f"CASE WHEN {marks} >= 2 THEN '' ELSE {match} END"

    x = d.where(x, ("Theorem",), lambda v: replaced(d, v, THEOREM, "theorem", strange), "h")
    # twice, as a match takes in the character behind it
    proofs = lambda v: d.sub(d.sub(d.sub(d.sub(d.sub(v, PROOF_END, " "), CRUMB, "$1\n$2"), CRUMB, "$1\n$2"), THEREFORE, "∴$1"), THEREFORE, "∴$1")
    return d.where(d.where(x, (r"\therefore",), proofs, "o"), ("\n\n\n\n",), lambda v: d.sub(v, r"\n{4,}", "\n\n\n"), "b")


def celsius(d: Dialect, x: str) -> str:
    """Percent signs that stand for degrees, in a sentence on temperature: from 30 to 45, and no proportion."""

    def degrees(match: str, before: str, behind: str, _: str) -> str:
        number = d.group(match, r"^([0-9]{2}(?:\.[0-9]+)?)")
        share = f"{d.like(f'right({before}, 24)', SHARE_BEFORE)} OR {d.like(f'left({behind}, 12)', SHARE_BEHIND)}"
        return f"CASE WHEN cast({number} as double) BETWEEN {BODY_HEAT[0]} AND {BODY_HEAT[1]} AND NOT ({share}) THEN concat({number}, '℃') ELSE {match} END"

    sentence = f"CASE WHEN {d.contains('sentence', d.text('%'))} AND {d.like('sentence', FEVER)} THEN {replaced(d, 'sentence', PERCENT, 'percent', degrees)} ELSE sentence END"
    x = d.where(x, ("%",), lambda v: d.join(d.map(d.groups(v, SEGMENT), "sentence", sentence), ""), "p")
    return d.where(x, ("℃",), lambda v: d.sub(d.sub(v, RANGE, "℃~$1"), RANGE, "℃~$1"), "r")


def _node(d: Dialect, x: str) -> str:
    """What a chart's node says: what stands in its brackets, else behind its name, up to a link's mark."""
    bare = t.strip(d, d.sub(t.strip(d, x), "^;+|;+$"))
    unnamed = t.strip(d, d.sub(bare, r"^[A-Za-z0-9_]+\s*"))
    said = f"CASE WHEN {d.like(bare, BOX)} THEN {d.group(bare, BOX)} WHEN {d.like(unnamed, '^[A-Za-z0-9_]+$')} THEN '' ELSE {unnamed} END"
    return t.strip(d, f"replace({d.sub(t.strip(d, d.sub(said, r'(?s)\s*[-.=]+.*$')), r'''^[`"']+|[`"']+$''')}, '|', '｜')")


def flowcharts(d: Dialect, x: str) -> str:
    """A recognised flowchart right behind a table's picture or caption becomes a table of its distinct edges; others go."""

    def table(match: str, _before: str, _behind: str, upto: str) -> str:
        lines = d.map(d.split(d.group(match, FLOWCHART_BODY), "\n"), "raw", d.sub(t.strip(d, "raw"), "^;+|;+$"))
        edges = d.filter(lines, "edge", f"NOT {d.like('edge', NO_EDGE)} AND {d.contains('edge', d.text('-->'))}")
        nodes = d.map(edges, "e", d.struct(a=_node(d, d.group("e", EDGE)), b=_node(d, d.group("e", EDGE, 2))))
        rows = d.distinct(d.map(d.filter(nodes, "n", "n.a <> '' AND n.b <> ''"), "w", "concat('| ', w.a, ' | ', w.b, ' |')"))
        near = f"{d.like(f'right({upto}, {LOOK_BACK})', TABLE_IMAGE)} OR {d.like(f'right({upto}, {LOOK_BACK})', TABLE_CAPTION)}"
        full = f"concat({d.join(d.concat(d.texts(('', '', *TABLE_TITLE)), 'edges'), chr(10))}, {d.text(chr(10) * 2)})"
        chart = d.at(d.map(d.array(rows), "edges", f"CASE WHEN {d.size('edges')} = 0 THEN {d.text(chr(10) * 2)} ELSE {full} END"), "1")
        return f"CASE WHEN {near} THEN {chart} ELSE {d.text(chr(10) * 2)} END"

    return d.where(x, ("<",), lambda v: f"CASE WHEN {d.like(v, FLOWCHART)} THEN {replaced(d, v, FLOWCHART, 'chart', table)} ELSE {v} END", "f")


def bibliography(d: Dialect, x: str) -> str:
    """Part of C13: references glued to one line, split behind years and before them."""

    def split(match: str, *_: str) -> str:
        head = d.group(match, REFERENCES_HEAD)
        years = d.sub(f"substr({match}, length({head}) + 1)", rf"(^|{NO_WORD})([0-9]{{4}})\s+([A-Z])", "$1$2\n$3")
        return f"concat({head}, {d.sub(years, rf'([A-Za-z][A-Za-z ]{{2,}})\s+([0-9]{{4}})({NO_WORD}|$)', '$1' + chr(10) + '$2$3')})"

    return d.where(x, ("References:",), lambda v: replaced(d, v, REFERENCES, "refs", split), "q")


#: By the names of their queries.
RECOGNISED = {"clean_foreign_math": foreign_math, "clean_temperature": celsius, "clean_flowcharts": flowcharts, "clean_bibliography": bibliography}


def rewritten(d: Dialect, source: str, name: str) -> str:
    made = f"SELECT doc_id, {d.fence(RECOGNISED[name](d, 'raw'))} AS text FROM (SELECT doc_id, coalesce(text, '') AS raw FROM {source}) s"
    return f"SELECT doc_id, {d.sha256('text')} AS text_sha256, cast(length(text) as bigint) AS chars FROM ({made}) m"
