"""Expressions over one text or line, written for either dialect.

Fixed values: the patterns in them, and the lengths that go with these, are what results depend on.
"""

from __future__ import annotations

from docgate.functions.dialect import Dialect
from docgate.functions.lexicon import (
    CJK, COVER_FRAGMENTS, DOSAGE, FRONT_MATTER_STARTS, GATE_LABELS, LINE_END, MAJOR_HEADINGS, NS, NUMERALS, READABLE, RELIABLE_FRONT, S, SERIES_TITLES, TITLE_PAGE_WORDS,
)

def strip(d: Dialect, x: str) -> str:
    return d.strip(x, S[1:-1])


def squeeze(d: Dialect, x: str) -> str:
    one = d.sub(x, f"{S}+", " ")
    # a name stands for a value at hand, which may be looked at twice
    return strip(d, d.when(d.like(x, rf"[\x00-\x1f\x7f-\x{{3000}}&&{S}]|  "), one, x) if x.isidentifier() else one)


def lines(d: Dialect, x: str) -> str:
    """All lines, whatever ends them; no empty one behind a last line end."""
    return d.split(d.sub(x, rf"(?:{LINE_END})\z"), LINE_END)


def lines_nl(d: Dialect, x: str) -> str:
    return d.split(x, "\n")


def is_heading(d: Dialect, x: str) -> str:
    return d.when(f"coalesce(startswith({x}, '#'), true)", d.like(x, f"^#{{1,6}}{S}+{NS}"))


def heading_text(d: Dialect, x: str) -> str:
    return strip(d, d.when(f"startswith({x}, '#')", d.sub(x, f"^#{{1,6}}{S}+"), x))


def is_toc_heading(d: Dialect, x: str) -> str:
    return d.when(f"coalesce(startswith({x}, '#'), true)", d.like(x, f"^#{{1,6}}{S}+(?:目{S}*录|目錄|日{S}*录|日錄){S}*$"))


def is_major(d: Dialect, x: str) -> str:
    base = d.sub(strip(d, d.sub(x, rf"{S}*[（(]\d+[）)]{S}*$")), f"^附录[：:]{S}*", "附录")
    return d.when(d.wide(x), f"({base} IN ({', '.join(map(d.text, MAJOR_HEADINGS))}))")


def is_nonstandard(d: Dialect, x: str) -> str:
    """x: a heading's text with single spaces."""
    return (
        f"({x} <> '' AND NOT {is_major(d, x)} AND ({d.contains(x, d.text(SERIES_TITLES[0]))} OR {x} IN ({', '.join(map(d.text, COVER_FRAGMENTS))})"
        f" OR {d.like(x, r'^[（(]\d{1,4}[）)]$')} OR {d.like(x, r'^[※＊*★☆·•\-—_=]+$')} OR {d.like(x, f'^[{CJK}A-Za-z]$')}"
        f" OR {d.count(x, '(?i)' + DOSAGE)} >= 2))"
    )


def is_case_or_reference(d: Dialect, x: str) -> str:
    return "(" + " OR ".join([
        d.like(x, rf"(?:门诊号|住院号|病案号|病历号){S}*[:：]?{S}*\d+{S}*[。.]?$"), d.like(x, rf"^(?:例|案){S}*[{NUMERALS}\d]"),
        d.like(x, rf"[\[【]{S}*见{S}*"), d.like(x, rf"见{S}*[“\x22《]"), d.like(x, rf"(?:例|人次|穴位|针次){S}*$"), d.like(x, rf"(?:痊愈者|显效者|有效者|治疗){S}*\d+"),
        d.contains(x, "'——'") + " AND " + d.like(x, rf"(?:汤|散|丸|饮|膏|丹|煎|方){S}*[（(]"),
    ]) + ")"


def is_page_entry(d: Dialect, x: str) -> str:
    """x: a heading's text with single spaces; whether it is a line of a table of contents with its page."""
    title = strip(d, d.sub(x, r"[（(]\d+[）)]$"))
    caption = d.like(x, rf"^(?:附)?(?:图|表|圖|錶){S}*[{NUMERALS}\d]+(?:[-–—]\d+)?(?:{S}*[:：].{{0,40}})?$")
    issue = f"({d.like(title, rf'(?:杂志|学报|期刊|报){S}*{NS}{{0,12}}\d{{4}}{S}*[；;：:，,]{S}*\d+$')} OR {d.like(title, rf'\d{{4}}{S}*[；;：:，,]{S}*\d+$')} AND {d.like(title, '《[^》]{2,40}》')})"
    clause = f"({d.like(title, '[，,。].{0,40}主之[。.]?$')} OR {d.like(title, rf'^[【\[〔]{S}*原文{S}*[】\]〕]')} OR length({title}) >= 16 AND {d.like(title, '[，,。；;]')} AND {d.like(title, f'[。；;]{S}*$')} AND NOT {d.like(title, '目录|頁|页码')})"
    plan = f"({d.like(title, '《[^》]{1,40}》')} AND {d.like(title, rf'(?:^|{S})\d+(?:\.\d+)?{S}*年{S}*$')})"
    prose = f"(length({title}) >= 24 AND {d.like(title, r'[“”‘’《》。，、；：！？\[\]]')})"
    exempt = " OR ".join([issue, clause, plan, is_case_or_reference(d, title), d.like(title, f"(?:第|见|見|参|參){S}*$"), prose])
    cited = d.like(x, rf"(?:杂志|学报|期刊|医刊|报){S}*[，,]{S}*\d{{4}}{S}*[；;：:，,]{S}*\d+{S}*[（(]\d+[）)]{S}*[：:]{S}*\d{{1,4}}$")
    plain = " OR ".join([d.like(x, rf"[／/]{S}*\d+$"), d.like(x, rf"{S}+\d{{1,4}}$"), d.like(x, r"(?:\.{2,}|．{2,}|…{1,}|·{2,})\d{1,4}$")])
    return d.when(d.like(x, "[0-9）)]$"), f"(CASE WHEN {is_case_or_reference(d, x)} OR {caption} THEN false WHEN {d.like(x, r'[（(]\d+[）)]$')} THEN NOT ({exempt}) WHEN {cited} THEN false ELSE ({plain}) END)")


def without_page(d: Dialect, x: str) -> str:
    """x without a page number behind it: the first of four forms that fits."""
    forms = (rf"(?:{S}|\.{{2,}}|．{{2,}}|…{{1,}}|·{{2,}})[（(]\d{{1,4}}[）)]$", rf"[／/]{S}*\d{{1,4}}$", rf"{S}+\d{{1,4}}$", r"(?:\.{2,}|．{2,}|…{1,}|·{2,})\d{1,4}$")
    return "(CASE " + " ".join(f"WHEN {d.like(x, p)} THEN {strip(d, d.sub(x, p))}" for p in forms) + f" ELSE {x} END)"


def title_key(d: Dialect, x: str) -> str:
    return d.sub(squeeze(d, x), rf"{S}*[（(]{S}*(\d+){S}*[）)]", "($1)")


def is_formula_unit(d: Dialect, x: str) -> str:
    return f"({x} <> '' AND NOT {d.like(x, r'^[#|\-*!>]')} AND length({x}) <= 200 AND {d.like(x, f'^[{CJK}A-Za-z]{{1,12}}(?:{S}*[{CJK}A-Za-z]{{0,8}})?(?:汤|散|丸|饮|膏|丹|煎|胶)(?:{S}|$|[{CJK}A-Za-z0-9（(])')})"


def is_dose_line(d: Dialect, x: str) -> str:
    amount = r"(?:[一二三四五六七八九十百千万半两]+|\d+(?:\.\d+)?)" + S + "*(?:两|钱|分|升|合|握|枚|片|粒|味|贴|帖|付|剂|匙|杯|碗|盅)"
    quiet = f"NOT {d.like(x, '[。！？!?]')}"
    one = squeeze(d, x)
    herbs = f"(length({one}) BETWEEN 1 AND 80 AND {d.like(one, f'^[{CJK}A-Za-z]{{1,6}}(?: [{CJK}A-Za-z]{{1,6}}){{2,}}$')})"
    any_of = " OR ".join([
        d.like(x, "^(?:处方|药用|方药|治法)[：:]"), f"{d.count(x, '克')} >= 2 AND length({x}) <= 240", f"{d.like(x, rf'^\d+(?:\.\d+)?{S}*克(?:[^0-9A-Za-z_{CJK}]|$)')} AND {d.like(x, f'[{CJK}]')}",
        d.like(x, "^(?:共为|为粗末|每次|午、|早晚各服)"), f"{d.like(x, '分两次服|日[二三]服|二付|三付|研用|合皮熟')} AND length({x}) <= 40", d.like(x, rf"^[（(][^）)]{{1,16}}[）)]{S}*[一二三四五六七八九十两\d]+付$"),
        f"length({x}) <= 80 AND {d.count(x, amount)} >= 2 AND {d.like(x, f'[{CJK}]')} AND {quiet}", f"length({x}) <= 60 AND {d.like(x, '酒炒|醋炒|等分|盐水炒|姜汁炒')} AND {d.like(x, f'[{CJK}]{{2,}}')} AND {quiet}", herbs,
    ])
    return f"({x} <> '' AND NOT {d.like(x, r'^[#|\-*!>]')} AND ({any_of}))"


def is_fragment(d: Dialect, p: str, c: str) -> str:
    """Whether line c goes on where line p, cut by a page's width, ends."""
    verse = f"^[{CJK}，、。！？；：”“‘’（）《》〈〉·]{{1,28}}$"
    number = f"^[{NUMERALS}]+、{NS}"
    comma = d.like(p, "[，,、]$")
    cjk = f"({d.like(p, f'[{CJK}]$')} AND {d.like(c, f'^[{CJK}]')})"
    tail = f"(length({p}) >= 18 AND {d.like(p, f'[{CJK}]$')} AND {d.like(c, f'^[{CJK}]{{1,7}}[，,。；;：:、]?$')})"
    ends = f"{d.like(p, f'[{READABLE}，,、]$')} AND {d.like(c, f'^[{READABLE}]')}"
    return (
        f"(length({p}) >= 8 AND NOT {d.like(p, '^[#|]')} AND NOT {d.like(c, r'^[#|]|^[\-*+] |^\d+[.)、]')} AND NOT {d.like(p, '[。！？.!?：:；;”』】)）`]$')}"
        f" AND NOT ({d.like(p, number)} AND {d.like(c, number)}) AND CASE WHEN length({c}) < 8 THEN {tail}"
        f" ELSE NOT ({comma} AND {d.like(p, verse)} AND {d.like(c, verse)}) AND ({cjk} OR {comma} OR length({p}) + length({c}) >= 80) AND {ends} END)"
    )


def is_forced_break(d: Dialect, p: str, c: str) -> str:
    labels = "|".join(GATE_LABELS)
    return (
        f"({p} <> '' AND {c} <> '' AND NOT {d.like(p, '^#')} AND NOT {d.like(c, '^#')} AND NOT {d.like(c, f'^(?:{labels})')} AND NOT {d.like(p, '年版$')}"
        f" AND NOT {d.like(c, r'^(?:[一二三四五六七八九十]+、|\d+[.、])')} AND {is_fragment(d, p, c)}"
        f" AND NOT {d.like(c, '^(?:按[：:]|此方|处方[：:]|共为|隔两日|嘱仍|古人治|此症|药用)')} AND NOT ({d.like(c, rf'^\d+(?:\.\d+)?{S}*克')} AND {d.like(p, '克')})"
        f" AND NOT {is_formula_unit(d, p)} AND NOT {is_formula_unit(d, c)} AND NOT {is_dose_line(d, p)} AND NOT {is_dose_line(d, c)})"
    )


def is_case_heading(d: Dialect, x: str) -> str:
    return d.like(x, rf"^(?:案|例){S}*[{NUMERALS}\d]+(?:{S}|[：:]|[{CJK}A-Za-z])")


def is_break_over_blank(d: Dialect, p: str, c: str) -> str:
    """Whether c, the next line that isn't blank, goes on where p ends."""
    front = f"^(?:{FRONT_MATTER_STARTS})"
    dose = (
        f"(length({c}) <= 240 AND (length({c}) <= 48 OR {d.like(c, '(?i)^' + DOSAGE)}) AND {d.like(p, '(?i)' + DOSAGE)} AND {d.like(c, '(?i)' + DOSAGE)}"
        f" AND {d.like(p, f'[{READABLE}]$')} AND {d.like(c, f'^[{READABLE}]')} AND NOT {is_formula_unit(d, c)} AND NOT {is_dose_line(d, p)} AND NOT {is_dose_line(d, c)})"
    )
    return f"(NOT {is_case_heading(d, p)} AND NOT {d.like(p, front)} AND ({dose} OR NOT {d.like(c, front)} AND {is_forced_break(d, p, c)}))"


def is_title_page_line(d: Dialect, x: str) -> str:
    c = heading_text(d, x)
    return "(" + " OR ".join([
        f"{c} IN ({', '.join(map(d.text, COVER_FRAGMENTS))})", d.like(c, TITLE_PAGE_WORDS), d.like(c, "(?:合著|编著|主编|著者|著)$"), *(d.contains(c, d.text(t)) for t in SERIES_TITLES),
        d.like(c, r"^第[一二三四五六七八九十\d]+辑$"), d.contains(c, "'出版社'"), f"length({c}) <= 12 AND NOT {d.like(c, '[，。；：！？、,.!?;:0-9]')}",
    ]) + ")"


def is_reliable_front(d: Dialect, x: str) -> str:
    return d.when(d.wide(x), f"{heading_text(d, x)} IN ({', '.join(map(d.text, RELIABLE_FRONT))})")


def is_image(d: Dialect, x: str) -> str:
    return d.when(f"coalesce(startswith({x}, '!['), true)", d.like(x, rf"^!\[[^\]]*\]\([^)]+\){S}*$"))


def repeats_by_right(d: Dialect, x: str) -> str:
    """List markers, labels and formula rows, which may repeat in a body."""
    return f"({d.like(x, rf'^(?:[-*+]{S}*)?[（(]\d{{1,3}}[）)]$')} OR {d.like(x, rf'^(?:(?:[-*+]{S}*)+)?【[^】]{{1,12}}】$')} OR {d.like(squeeze(d, x), f'^[{CJK}A-Za-z0-9·•]{{1,12}}(?:汤|散|丸|饮|膏|丹|煎|方) [{CJK}A-Za-z]')})"
