"""A book's index as sections by number of strokes, one entry a line; see-also notes go to the entry behind them.

Only documents with an index are taken apart. A line of the index yields a section mark, a note, an entry, or nothing.
What carries over lines is told by windows: an entry's note is the last one since the entry before, and a section's
heading is written where the mark differs from the last one.
"""

from __future__ import annotations

from docgate.functions import text as t
from docgate.functions.dialect import Dialect
from docgate.functions.lexicon import S
from docgate.operators import structure

# What lines of an index look like.
STROKES = "一二三四五六七八九十百"
HEADING = f"^#{{1,6}}{S}*索引{S}*$"
START = f"^(?:#{{1,6}}{S}*)?索引{S}*$"
TITLE = f"^(?:#{{1,6}}{S}*)?中医临证备要{S}*$"
CRUMB = rf"^(?:[第辑一二三四五六七八九十0-9]|{S})+$"
SECTION = rf"^(?:#{{1,6}}{S}*)?(?:[-*+]{S}+)*([{STROKES}]+){S}*画{S}*(.*)$"
GLUED = rf"^([{STROKES}]+){S}*画{S}*(.+)$"
ENTRY = rf"^(?:[-*+]{S}+)?(?:[-*+]{S}+)?(.+?){S}+([0-9]{{1,4}}){S}*$"
SEE = rf"^[（(]?{S}*参见{S}*([0-9]+){S}*[）)]?{S}*(.*)$"
SEE_ENTRY = rf"^[（(]?{S}*参见{S}*([0-9]+){S}*[）)]?{S}*(.+?){S}+([0-9]{{1,4}}){S}*$"
BULLETS = f"^[-*+]+{S}*"
EDGES = "^[ \\-—–·•]+|[ \\-—–·•]+$"
TERM_SECTION = f"^([{STROKES}]+)画(.+)$"
TERM_SEE = r"^[（(]?参见([0-9]+)[）)]?(.+)$"


def parsed(d: Dialect, lines: str) -> str:
    """lines: rows of an index, bare not empty. With first and second section mark, note, and the entry's term and page ('' if there is none)."""

    def pick(x: str, pattern: str, n: int = 1) -> str:
        return d.group(x, pattern, n)

    def given(x: str) -> str:
        return f"nullif({x}, '')"

    unlisted = d.sub(d.sub("bare", BULLETS), BULLETS)
    one = f"SELECT *, {d.like('bare', SECTION)} AS is_section, {t.strip(d, pick('bare', SECTION, 2))} AS rest, {d.sub('bare', BULLETS)} AS once, {unlisted} AS twice FROM ({lines}) l WHERE NOT {d.like('bare', TITLE)} AND NOT {d.like('bare', CRUMB)}"
    two = f"""SELECT *, CASE WHEN is_section THEN {given(pick('bare', SECTION))} WHEN NOT {d.like('bare', SEE)} AND NOT {d.like('once', SEE)} THEN {given(pick('twice', GLUED))} END AS mark,
        CASE WHEN is_section THEN rest WHEN {d.like('bare', SEE)} THEN bare WHEN {d.like('once', SEE)} THEN once WHEN {d.like('twice', GLUED)} THEN {t.strip(d, pick('twice', GLUED, 2))} ELSE twice END AS said FROM ({one}) o"""
    noted = f"NOT is_section AND {d.like('said', SEE_ENTRY)}"
    listed = f"{d.like('said', ENTRY)} AND (is_section OR NOT {d.like('said', SEE)})"
    three = f"SELECT *, CASE WHEN {noted} THEN {pick('said', SEE_ENTRY, 2)} WHEN {listed} THEN {pick('said', ENTRY)} ELSE '' END AS raw, CASE WHEN {noted} THEN {pick('said', SEE_ENTRY, 3)} ELSE {pick('said', ENTRY, 2)} END AS page, CASE WHEN NOT ({listed}) THEN {given(pick('said', SEE))} END AS own_note FROM ({two}) w"
    four = f"SELECT *, {d.sub(d.sub('raw', f'{S}+'), EDGES)} AS term FROM ({three}) x"
    five = f"SELECT *, {given(pick('term', TERM_SECTION))} AS second, CASE WHEN {d.like('term', TERM_SECTION)} THEN {pick('term', TERM_SECTION, 2)} ELSE term END AS named FROM ({four}) y"
    return f"""SELECT doc_id, pos, mark, second, coalesce({given(pick('named', TERM_SEE))}, own_note) AS note,
        CASE WHEN {d.like('named', TERM_SEE)} THEN {pick('named', TERM_SEE, 2)} ELSE named END AS term, page FROM ({five}) z"""


def normalised(d: Dialect, source: str) -> str:
    """(doc_id, text, entries) of all documents; entries is 0 where there is no index."""
    by = "PARTITION BY doc_id ORDER BY pos"
    has = d.contains("text", d.text("索引"))
    rows = structure.rows(d, f"(SELECT doc_id, text FROM {source} WHERE {has}) h")
    one = f"SELECT *, min(CASE WHEN {d.like('bare', START)} THEN pos END) OVER (PARTITION BY doc_id) AS start FROM ({rows}) r"
    two = f"SELECT *, min(CASE WHEN pos > start AND {d.like('bare', HEADING)} THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM ({one}) o WHERE start IS NOT NULL"
    inside = "SELECT doc_id, pos, bare FROM placed WHERE pos > start AND (stop IS NULL OR pos < stop) AND bare <> ''"
    # lines between two entries, the second with them, share their number of entries before
    three = f"SELECT *, coalesce(sum(CASE WHEN term <> '' THEN 1 ELSE 0 END) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({parsed(d, inside)}) p"
    four = f"SELECT *, {d.last('note')} OVER (PARTITION BY doc_id, before ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM ({three}) w"
    entry = f"CASE WHEN term <> '' THEN concat('- ', term, CASE WHEN carried IS NULL THEN '' ELSE concat('（参见 ', carried, '）') END, ' ', page) END"
    marks = d.array("mark", "second", entry)
    five = f"SELECT doc_id, pos AS at, {marks} AS items FROM ({four}) x"
    six = f"SELECT doc_id, at, pos AS k, CASE WHEN pos < 2 THEN item END AS section, CASE WHEN pos = 2 THEN item END AS entry FROM ({d.explode(f'({five}) y', 'items', 'doc_id, at, items')}) e WHERE item IS NOT NULL"
    order = "PARTITION BY doc_id ORDER BY at, k"
    seven = f"SELECT *, {d.last('section')} OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM ({six}) z"
    eight = f"SELECT *, lag(entry) OVER ({order}) AS above FROM ({seven}) v WHERE section IS NULL OR current IS NULL OR section <> current"
    said = f"CASE WHEN section IS NULL THEN entry ELSE concat(CASE WHEN above IS NULL THEN '' ELSE {d.text(chr(10))} END, '## ', section, '画', {d.text(chr(10))}) END"
    body = f"SELECT doc_id, {d.join(d.gather('said', 'o'), chr(10))} AS body, sum(is_entry) AS entries FROM (SELECT doc_id, {d.struct(at='at', k='k')} AS o, {said} AS said, CASE WHEN entry IS NULL THEN 0 ELSE 1 END AS is_entry FROM ({eight}) u) s GROUP BY doc_id"
    head = f"SELECT doc_id, {d.join(d.gather('CASE WHEN pos < start THEN line END', 'pos'), chr(10))} AS head, max(start) AS start FROM placed GROUP BY doc_id"
    nl = d.text("\n")
    ended = d.sub("concat(CASE WHEN start = 0 THEN '' ELSE concat(head, {0}) END, '# 索引', coalesce(concat({0}, {0}, body), ''))".format(nl), r"\n+$")
    made = f"SELECT h.doc_id, concat({ended}, {nl}) AS text, cast(coalesce(entries, 0) as bigint) AS entries FROM ({head}) h LEFT JOIN ({body}) b ON h.doc_id = b.doc_id"
    return f"WITH placed AS ({two}), made AS ({made}) SELECT s.doc_id, coalesce(m.text, s.text) AS text, coalesce(m.entries, 0) AS entries FROM {source} s LEFT JOIN made m ON s.doc_id = m.doc_id"
