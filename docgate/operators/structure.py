"""Relations over a document's lines: running heads, headings, repeats, tails. One exchange by document serves all."""

from __future__ import annotations

from docgate.functions import text as t
from docgate.functions.dialect import Dialect
from docgate.functions.lexicon import CJK, S

TITLE_ANCHORS = "丛书|全书|全集|教材|讲义|导言|出版|目录|内容提要"
NOT_TITLES = r"^(?:[一二三四五六七八九十百]+、|\d+[.．、]|附录|索引|目录|前言|凡例|内容提要|出版说明|结语)"


def rows(d: Dialect, source: str) -> str:
    """A row for each line: doc_id, pos (from 0), line, and bare, the line without space around it."""
    return f"SELECT doc_id, pos, item AS line, {t.strip(d, 'item')} AS bare FROM ({d.explode(source, t.lines_nl(d, 'text'), 'doc_id')}) e"


def packed(d: Dialect, lines: str) -> str:
    """lines: doc_id, pos, line. A row for each document with its text."""
    return f"SELECT doc_id, {d.join(d.gather('line', 'pos'), chr(10))} AS text FROM ({lines}) p GROUP BY doc_id"


# Series titles as running heads, what a recognised volume mark falls apart into, and titles that do.
SERIES_HEAD = rf"^(?:现代著名老中医名著重刊丛书|中国百年百名中医临床家丛书|现代著名老中医名著重刊丛书第[一二三四五六七八九十\d]+辑|第[一二三四五六七八九十\d]+辑)$"
FRAGMENTS = "^[第一二三四五辑輯索引前言凡例]$"
FRAGMENT_TITLES = rf"^(?:第[一二三四五六七八九十\d]*辑?|前言|凡例|索引|目录|目錄)$"
SERIES_PREFIX = rf"^(?:现代著名老中医名著重刊丛书|中国百年百名中医临床家丛书|现代著名者中医名著重刊丛书|现代著名塔中医名著重刊丛书)(?:第[一二三四五六七八九十\d]+辑)?"


def without_running(d: Dialect, source: str) -> str:
    """Lines that aren't repeated heads or feet.

    Short lines that stand three times or more go, titles of series from two times on; a volume mark or short title that
    fell apart into glyphs, a line each, goes with the blank lines inside; a series title in front of an entry is cut off."""
    e = d.text("")
    content = t.heading_text(d, "bare")
    compact = d.sub("content", f"{S}+")
    one = f"SELECT *, {content} AS content FROM ({rows(d, source)}) r"
    two = f"SELECT *, {d.like(compact, SERIES_HEAD)} AS series, {d.like(compact, FRAGMENTS)} AS fragment FROM ({one}) o"
    plain = f"NOT {d.like('bare', '^[#|]')} AND NOT {d.like('bare', rf'^(?:[-*+]{S}*)?[（(]\d{{1,3}}[）)]$')} AND NOT {d.like('bare', rf'^(?:(?:[-*+]{S}*)+)?【[^】]{{1,12}}】$')}"
    section = f"NOT {d.like('bare', '^#')} AND {d.like('content', f'^[一二三四五六七八九十百]+、[^{S[1:-1]}]{{2,16}}$')}"
    three = f"SELECT *, series OR fragment OR {section} OR length(bare) BETWEEN 3 AND 40 AND {plain} AS may_run FROM ({two}) w"
    four = f"SELECT *, CASE WHEN may_run THEN count(*) OVER (PARTITION BY doc_id, bare) ELSE 0 END AS times FROM ({three}) x"
    gone = "(times >= 3 OR series AND times >= 2)"
    # glyphs that stand together, blank lines between them allowed: the lines between two others are a block
    five = f"SELECT *, sum(CASE WHEN bare <> {e} AND NOT (fragment AND NOT {gone}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM ({four}) y WHERE NOT {gone}"
    glyph = f"CASE WHEN fragment THEN content END"
    six = f"SELECT *, {d.gather_over(glyph, '(PARTITION BY doc_id, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS glyphs, min(CASE WHEN fragment THEN pos END) OVER (PARTITION BY doc_id, block) AS head FROM ({five}) z"
    seven = f"SELECT *, {d.size('glyphs')} >= 2 AND {d.like(d.join('glyphs', ''), FRAGMENT_TITLES)} AND pos >= head AND (fragment OR bare = {e}) AS broken FROM ({six}) v"
    body = d.sub("content", f"^[-*+]{S}+")
    rest = d.sub(d.sub(body, SERIES_PREFIX), r"^[ \-—–·•]+|[ \-—–·•]+$")
    entry = f"({t.is_page_entry(d, t.squeeze(d, rest))} OR {d.like(rest, r'^\d{1,3}[.．、]')} OR {d.like(rest, rf'(?:\.{{2,}}|…{{1,}}|·{{2,}}|{S}+)\d{{1,4}}$')})"
    cut = f"{d.like(body, SERIES_PREFIX)} AND {rest} <> {e} AND NOT {d.like(rest, '^[（(].*[）)]$')} AND {entry}"
    mark = f"CASE WHEN {d.like('bare', '^#')} THEN concat({d.group('bare', '^(#{1,6})')}, ' ') WHEN {d.like('bare', f'^[-*+]{S}+')} THEN '- ' ELSE '' END"
    kept = f"SELECT doc_id, pos, CASE WHEN {cut} THEN concat({mark}, {rest}) ELSE line END AS line, bare FROM ({seven}) u WHERE NOT coalesce(broken, false)"
    # of blank lines left side by side, the first stays
    return f"SELECT doc_id, pos, line FROM (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ({kept}) k) b WHERE NOT (bare = '' AND before IS NOT NULL AND before = '')"


# Titles of series, always a running head, and what tells that a book's own title stands with one.
SERIES_TITLE, OWN_TITLE = "名著重[刊利]丛书", "医案|经验|备要|论医|选编|选集"


def without_titles(d: Dialect, source: str) -> str:
    """Lines without short headings, free of numbers and stops, that stand twice or more: a book's title as a running head; a series title always."""
    content = t.heading_text(d, "bare")
    title = f"{t.is_heading(d, 'bare')} AND length({content}) BETWEEN 2 AND 24 AND {d.like(content, rf'^[{CJK}A-Za-z0-9·•\-—–（）()《》〈〉{S[1:-1]}]+$')} AND NOT {d.like(content, NOT_TITLES)} AND NOT {d.like(content, '[。！？!?：:；;，,]')}"
    counted = f"SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS times, {title} AS may_run FROM ({rows(d, source)}) r"
    series = f"{t.is_heading(d, 'bare')} AND {d.like(content, SERIES_TITLE)} AND NOT {d.like(content, OWN_TITLE)}"
    return f"SELECT doc_id, pos, line FROM ({counted}) c WHERE NOT (may_run AND times >= 2 OR {series})"


def without_short_repeats(d: Dialect, source: str, most: int = 2) -> str:
    """Of a line of at most 80 characters that isn't a heading, the first two stay."""
    exempt = f"(bare = '' OR length(bare) > 80 OR {t.is_heading(d, 'bare')})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY doc_id, bare ORDER BY pos) AS nth FROM ({rows(d, source)}) r"
    return f"SELECT doc_id, pos, line FROM ({ranked}) c WHERE {exempt} OR nth <= {most}"


def heading_levels(d: Dialect, source: str) -> str:
    """Every heading outside fences with its level, the level capped at one more than that of the heading before, and the first one's as 1.

    The cap reads its own output; over a heading's number k it equals k plus the least (level - number) so far."""
    fenced = f"SELECT *, sum(CASE WHEN {d.like('bare', '^```')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS inside FROM ({rows(d, source)}) r"
    heads = f"SELECT doc_id, pos, cast(length({d.group('bare', '^(#{1,6})')}) as bigint) AS level, {t.heading_text(d, 'bare')} AS content FROM ({fenced}) f WHERE inside = 0 AND {t.is_heading(d, 'bare')}"
    numbered = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ({heads}) h"
    first = f"SELECT *, CASE WHEN k = 1 THEN 1 ELSE level END AS start_level FROM ({numbered}) n"
    return f"SELECT doc_id, pos, level, content, cast(k + min(start_level - k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) as bigint) AS capped FROM ({first}) s"


def relevelled(d: Dialect, source: str) -> str:
    """All lines, headings with their capped level."""
    marks = "repeat('#', cast(capped as int))"
    return f"SELECT r.doc_id, r.pos, CASE WHEN h.pos IS NULL THEN r.line ELSE concat({marks}, ' ', h.content) END AS line FROM ({rows(d, source)}) r LEFT JOIN ({heading_levels(d, source)}) h ON r.doc_id = h.doc_id AND r.pos = h.pos"


def spaced(d: Dialect, source: str) -> str:
    """All lines with a blank one before and after each heading outside fences. sub tells the order among lines put in at one place."""
    fence = d.like("bare", "^```")
    marked = f"SELECT *, {fence} AS is_fence, sum(CASE WHEN {fence} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM ({rows(d, source)}) r"
    state = f"SELECT *, NOT is_fence AND fences % 2 = 0 AND {t.is_heading(d, 'bare')} AS is_head, is_fence AND fences % 2 = 1 AS opens FROM ({marked}) m"
    near = f"SELECT *, lag(line) OVER w AS before, lag(is_head) OVER w AS after_head, lead(bare) OVER w AS next FROM ({state}) s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    # a heading before has put a blank line in already, unless a blank one stood there
    gap = "(is_head OR opens) AND before IS NOT NULL AND before <> '' AND NOT after_head"
    out = [
        f"SELECT doc_id, pos, 0 AS sub, '' AS line FROM ({near}) a WHERE {gap}",
        f"SELECT doc_id, pos, 1 AS sub, CASE WHEN is_head THEN bare ELSE line END AS line FROM ({near}) b",
        f"SELECT doc_id, pos, 2 AS sub, '' AS line FROM ({near}) c WHERE is_head AND next IS NOT NULL AND next <> ''",
    ]
    return " UNION ALL ".join(out)


def demoted(d: Dialect, source: str) -> str:
    """All lines; a heading that holds decoration, doses or fragments becomes its text, unless it names a series or part."""
    content = t.squeeze(d, t.heading_text(d, "bare"))
    return f"SELECT doc_id, pos, CASE WHEN {t.is_heading(d, 'bare')} AND NOT {d.like('bare', TITLE_ANCHORS)} AND {t.is_nonstandard(d, content)} THEN {t.heading_text(d, 'bare')} ELSE line END AS line FROM ({rows(d, source)}) r"


def page_headings(d: Dialect, source: str) -> str:
    """All lines; a heading that is a page number, or a title with one behind it, becomes a list item."""
    form = rf"^#{{1,6}}{S}+(.+?){S}*[.…·•．]{{0,12}}{S}*(\d{{1,4}}){S}*$"
    title, page = t.strip(d, d.group("bare", form, 1)), d.group("bare", form, 2)
    only = rf"^#{{1,6}}{S}+(\d{{1,4}}){S}*$"
    return f"""SELECT doc_id, pos, CASE WHEN {d.like('bare', only)} THEN concat('- ', {d.group('bare', only)})
        WHEN {d.like('bare', form)} AND ({d.like('bare', '[.…·•．]{2,}')} OR length({title}) <= 40) THEN concat('- ', {title}, ' ', {page}) ELSE line END AS line FROM ({rows(d, source)}) r"""


def units(d: Dialect, source: str) -> str:
    """Paragraphs, code blocks and details blocks: doc_id, unit (from 1), text. Blank lines inside blocks don't end them.

    A depth that stops at zero is the running sum less its own running minimum, where that is below zero."""
    opens, closes = d.count("line", r"(?i)<details\b"), d.count("line", "(?i)</details>")
    one = f"SELECT *, sum(CASE WHEN {d.like('bare', '^```')} THEN 1 ELSE 0 END) OVER w % 2 AS code FROM ({rows(d, source)}) r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    two = f"SELECT *, sum(CASE WHEN code = 0 THEN {opens} - {closes} ELSE 0 END) OVER w AS net FROM ({one}) o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    three = f"SELECT *, net - least(0, min(net) OVER w) AS depth FROM ({two}) t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    four = f"SELECT *, bare = '' AND code = 0 AND depth = 0 AS gap FROM ({three}) h"
    five = f"SELECT *, lag(gap) OVER w AS gap_before FROM ({four}) f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    six = f"SELECT *, sum(CASE WHEN NOT gap AND coalesce(gap_before, true) THEN 1 ELSE 0 END) OVER w AS unit FROM ({five}) v WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    return f"SELECT doc_id, cast(unit as bigint) AS unit, {t.strip(d, d.join(d.gather('line', 'pos'), chr(10)))} AS text FROM ({six}) s WHERE NOT gap GROUP BY doc_id, unit"


def without_echo(d: Dialect, source: str) -> str:
    """Lines without a heading's echo: its characters one to a line right below it, blank lines between allowed before the first.

    A glyph's number since the last other line tells which character of the heading it should be; the echo is there if
    as many stand in place as the heading has."""
    compact = d.sub("bare", f"{S}+")
    one = f"SELECT *, {compact} AS compact, {d.like(compact, f'^[{CJK}A-Za-z0-9]$')} AS glyph FROM ({rows(d, source)}) r"
    two = f"SELECT *, {d.last('CASE WHEN NOT glyph AND bare <> {} THEN pos END'.format(d.text('')))} OVER w AS head_pos, {d.last('CASE WHEN NOT glyph AND bare <> {} THEN bare END'.format(d.text('')))} OVER w AS head FROM ({one}) o WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    three = f"SELECT *, row_number() OVER (PARTITION BY doc_id, head_pos, glyph ORDER BY pos) AS k, {d.sub(t.heading_text(d, 'head'), f'{S}+')} AS title, {t.is_heading(d, 'head')} AS under_heading FROM ({two}) t"
    four = f"SELECT *, glyph AND under_heading AND length(title) BETWEEN 2 AND 12 AND k <= length(title) AND pos - k = min(pos - k) OVER (PARTITION BY doc_id, head_pos, glyph) AND compact = substr(title, cast(k as int), 1) AS in_place FROM ({three}) h"
    five = f"SELECT *, sum(CASE WHEN in_place THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, head_pos) AS places FROM ({four}) f"
    return f"SELECT doc_id, pos, line FROM ({five}) v WHERE NOT coalesce(in_place AND places = length(title), false)"


def without_prefix(d: Dialect, source: str, most: int = 80) -> str:
    """Lines from the first heading on, where all that stands before it are short lines and no prose."""
    state = f"SELECT *, min(CASE WHEN {t.is_heading(d, 'bare')} THEN pos END) OVER (PARTITION BY doc_id) AS first FROM ({rows(d, source)}) r"
    prose = f"bare <> '' AND (length(bare) > 120 OR length(bare) >= 60 AND {d.like('bare', '[。！？]')})"
    judged = f"SELECT *, max(CASE WHEN pos < first AND {prose} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS has_prose FROM ({state}) s"
    return f"SELECT doc_id, pos, line FROM ({judged}) j WHERE NOT coalesce(pos < first AND first <= {most} AND has_prose = 0, false)"


def declared_titles(d: Dialect, source: str) -> str:
    """(doc_id, title): what the tables of contents list with a page, without it. A table ends at the next major heading."""
    event = f"CASE WHEN {t.is_toc_heading(d, 'bare')} THEN 1 WHEN {t.is_heading(d, 'bare')} AND {t.is_major(d, t.heading_text(d, 'bare'))} THEN 0 END"
    state = f"SELECT *, {d.last(event)} OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_toc FROM ({rows(d, source)}) r"
    entry = t.squeeze(d, d.sub("bare", f"^[-*]{S}+"))
    listed = f"SELECT doc_id, {entry} AS entry FROM ({state}) s WHERE in_toc = 1 AND {d.like('bare', f'^[-*]{S}+')}"
    cut = f"SELECT doc_id, entry, {t.without_page(d, 'entry')} AS title FROM ({listed}) l"
    return f"SELECT DISTINCT doc_id, {t.title_key(d, 'title')} AS title FROM ({cut}) c WHERE title <> entry"


def without_page_suffix(d: Dialect, source: str) -> str:
    """All lines; a heading that ends in a page number loses it, unless a table of contents declares the title with that number."""
    forms = (rf"{S}*\^\(\d{{1,4}}\){S}*$", rf"{S}*[（(]\d{{1,4}}[）)]{S}*$", rf"[／/]{S}*\d{{1,4}}$", r"(?:\.{2,}|．{2,}|…{1,}|·{2,})\d{1,4}$", rf"{S}+\d{{1,4}}$")
    heads = f"SELECT doc_id, pos, {d.group('bare', '^(#{1,6})')} AS marks, {t.heading_text(d, 'bare')} AS content, {t.title_key(d, t.heading_text(d, 'bare'))} AS title FROM ({rows(d, source)}) r WHERE {t.is_heading(d, 'bare')}"
    open_heads = f"SELECT h.* FROM ({heads}) h LEFT JOIN ({declared_titles(d, source)}) x ON h.doc_id = x.doc_id AND h.title = x.title WHERE x.title IS NULL"
    caret = d.like("content", forms[0])
    shorter = "CASE " + " ".join(f"WHEN {d.like('content', p)} THEN {t.strip(d, d.sub('content', p))}" for p in forms) + " ELSE content END"
    page = t.is_page_entry(d, t.squeeze(d, "content"))
    changed = f"SELECT doc_id, pos, marks, {shorter} AS content FROM ({open_heads}) o WHERE {page} OR {caret}"
    return f"SELECT r.doc_id, r.pos, CASE WHEN c.pos IS NULL OR c.content = '' THEN r.line ELSE concat(c.marks, ' ', c.content) END AS line FROM ({rows(d, source)}) r LEFT JOIN ({changed}) c ON r.doc_id = c.doc_id AND r.pos = c.pos"
