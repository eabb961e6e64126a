"""What an archive or a contents page left at a document's end: a record of the scan, or a list of empty headings.

A record glued to a line of text is cut off from there; a record on lines of its own, or eight or more numbered
headings without a text, are cut off with all behind them if they stand far enough in the rear, by lines or by a running
share of the characters. A cut that would leave too little of the document isn't made.

Only documents that hold a mark are taken apart; what is told of the whole (first places, running sums) are windows over
a document's lines, which share one exchange.
"""

from __future__ import annotations

from docgate.functions import text as t
from docgate.functions.dialect import Dialect
from docgate.functions.lexicon import CJK, S
from docgate.operators import structure

# Marks of records. A line of one begins so (ASCII letters in either case), ...
RECORD = rf"(?i)^(?:SS{S}*号{S}*=|DX{S}*号{S}*=|\[General{S}*Information\]|Document{S}+generated{S}+by{S}+Anna's{S}+Archive|书名{S}*=|作者{S}*=|页数{S}*=|出版日期{S}*=|filename_decoded|pdg_main_pages|url{S}*={S}*https?://|http://book2\.duxiu\.com/)"
# ... or so, when white space is taken out, ...
TIGHT = r"(?i)^\[?GeneralInformation\]?|duxiu\.com"
TIGHT_NUMBER = "^SS号=[0-9]+|^DX号=[0-9]+|DX号=[0-9]{5,}"
# ... and goes on so.
GOES_ON = rf"(?i)^(?:SSID{S}*=|(?:书名|作者|页数|出版日期|出版社|起止页){S}*[=：:]|独秀链接)"
# Within a line: anywhere, or not right behind a letter, digit or character.
GLUED = rf"(?i)^((?s:.*?))(?:\[General{S}*Information\]|Document{S}+generated{S}+by{S}+Anna's{S}+Archive|url{S}*={S}*https?://(?:book2\.)?duxiu\.com/|http://book2\.duxiu\.com/bookDetail\.jsp)"
GLUED_NUMBER = rf"(?i)^((?s:(?:.*?[^{CJK}A-Za-z0-9])??))(?:SS|DX){S}*号{S}*={S}*[0-9]{{5,}}"
NUMBERED = rf"^#{{1,6}}{S}+[0-9]{{1,3}}[.．、]{S}+[^ ]"
#: A text without any of these has nothing to cut.
MARKS = rf"(?i)号{S}*=|I{S}*n{S}*f{S}*o{S}*r{S}*m{S}*a{S}*t{S}*i{S}*o{S}*n|Anna's{S}+Archive|(?:书名|作者|页数|出版日期){S}*=|filename_decoded|pdg_main_pages|url{S}*=|d{S}*u{S}*x{S}*i{S}*u|(?m:^{S}*#{{1,6}}{S}+[0-9]{{1,3}}[.．、])"
EMPTY_HEADINGS = 8


def is_record(d: Dialect, x: str) -> str:
    bare = t.strip(d, d.sub(x, r"^\|+|\|+$"))
    tight = d.sub(x, f"{S}+")
    return f"({x} <> '' AND ({d.like(x, RECORD)} OR {d.like(bare, RECORD)} OR {d.like(tight, TIGHT)} OR {d.like(tight, TIGHT_NUMBER)}))"


def cut(d: Dialect, source: str) -> str:
    """(doc_id, text, cut) of all documents; cut is what was cut off: glued, record, headings, or null."""
    all_rows = "PARTITION BY doc_id"
    above = "PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    rows = structure.rows(d, f"(SELECT doc_id, text FROM {source} WHERE {d.like('text', MARKS)}) h")

    def first(cond: str) -> str:
        return f"min(CASE WHEN {cond} THEN pos END) OVER ({all_rows})"

    def last(cond: str) -> str:
        return f"max(CASE WHEN {cond} THEN pos END) OVER ({all_rows})"

    def total(cond: str, of: str = "1") -> str:
        return f"coalesce(sum(CASE WHEN {cond} THEN {of} END) OVER ({all_rows}), 0)"

    sized = f"SELECT *, sum(length(line) + 1) OVER ({all_rows}) - 1 AS chars, max(pos) OVER ({all_rows}) AS bottom FROM ({rows}) r"
    # a line feed at the end begins no line
    real = f"SELECT *, count(*) OVER ({all_rows}) AS n, coalesce(sum(length(line) + 1) OVER ({above}), 0) AS upto FROM ({sized}) s WHERE NOT (pos = bottom AND line = '')"
    unpiped = t.strip(d, d.sub("bare", r"^\|+|\|+$"))
    two_places = [f"CASE WHEN {d.like('line', p)} THEN length({d.group('line', p)}) END" for p in (GLUED, GLUED_NUMBER)]
    flagged = f"SELECT *, bare <> '' AS filled, {is_record(d, 'bare')} AS record, {d.like('bare', GOES_ON)} OR {d.like(unpiped, GOES_ON)} AS goes_on, {d.like('bare', NUMBERED)} AS numbered, length(line) AS size, least({', '.join(two_places)}) AS place FROM ({real}) b WHERE n >= 8"
    late = "place >= greatest(20, floor(size * 0.5)) OR NOT (place < 8 AND size > 40) AND NOT (place < floor(size * 0.85) AND size > 200)"
    rear = "pos >= floor(n * 0.7) OR pos >= greatest(0, n - greatest(30, floor(n / 5))) OR upto >= floor(chars * 0.8)"
    judged = f"SELECT *, coalesce(filled AND NOT record AND ({late}) AND {t.strip(d, 'left(line, place)')} <> '', false) AS glued, {rear} AS rear, {d.sub('left(line, place)', f'{S}+$')} AS prefix FROM ({flagged}) f"
    placed = f"SELECT *, {first('glued')} AS g, {first('record AND rear')} AS a, coalesce({last('filled AND NOT numbered')}, -1) AS prose FROM ({judged}) j"
    run = f"SELECT *, coalesce({first('pos > g AND filled AND NOT record AND NOT goes_on')}, n) AS g_end, {first('pos > prose AND filled')} AS h, {total('pos > prose AND filled')} AS empty FROM ({placed}) p"
    starts = f"SELECT *, coalesce(a, CASE WHEN empty >= {EMPTY_HEADINGS} THEN {first('pos = h AND rear')} END) AS c FROM ({run}) q"
    # blank lines and numbered headings right before a cut go as well
    ends = f"SELECT *, coalesce({last('pos < c AND filled AND NOT numbered')} + 1, 0) AS c_top, coalesce(greatest(g, {last('pos >= g_end AND filled')}), g) AS g_bottom FROM ({starts}) u"
    in_glued = "g IS NOT NULL AND (pos <= g OR pos >= g_end AND pos <= g_bottom)"
    sums = f"""SELECT *, {total(in_glued)} AS g_lines, {total(in_glued, 'CASE WHEN pos = g THEN length(prefix) ELSE size END + 1')} AS g_chars,
        {total('pos < c_top')} AS c_lines, {total('pos < c_top', 'size + 1')} AS c_chars FROM ({ends}) e"""
    enough = "({0}_chars >= least(20, greatest(1, floor(chars / 20))) OR {0}_lines >= 3)"
    half = "c_chars >= 0.5 * chars AND NOT (chars >= 500 AND c_lines + 1 < 0.5 * (bottom + 1))"
    kinds = f"""SELECT *, CASE WHEN g IS NOT NULL AND {enough.format('g')} THEN 'glued' WHEN a IS NOT NULL THEN CASE WHEN {enough.format('c')} AND c_lines >= 5 THEN 'record' END
        WHEN c IS NOT NULL AND {half} AND c_lines >= greatest(20, floor(n / 5)) THEN 'headings' END AS kind FROM ({sums}) v"""
    kept = f"SELECT doc_id, pos, kind, CASE WHEN kind = 'glued' AND pos = g THEN prefix ELSE line END AS line FROM ({kinds}) k WHERE kind IS NOT NULL AND CASE WHEN kind = 'glued' THEN {in_glued} ELSE pos < c_top END"
    made = f"SELECT doc_id, max(kind) AS kind, concat({d.join(d.gather('line', 'pos'), chr(10))}, {d.text(chr(10))}) AS text FROM ({kept}) x GROUP BY doc_id"
    return f"SELECT s.doc_id, coalesce(m.text, s.text) AS text, m.kind AS cut FROM {source} s LEFT JOIN ({made}) m ON s.doc_id = m.doc_id"
