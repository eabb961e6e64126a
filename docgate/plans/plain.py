"""SQL for DuckDB alone, to check queries whose plans for Spark say the same in another way: these walk from line to line."""

from __future__ import annotations

from docgate.functions.dialect import DUCK
from docgate.plans import dirty

#: Lines from 1 on with b, the line without white space around it.
LINES = f"""src AS (SELECT doc_id, coalesce(text, '') AS text FROM ({dirty.view(DUCK)}) v),
    arrays AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM src),
    lines AS (SELECT doc_id, n, a[n] AS line, regexp_replace(a[n], '^\\s+|\\s+$', '', 'g') AS b FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS n FROM arrays) u)"""


def index_normalised() -> str:
    entry, note, both = r"^(?:[-*+]\s+)?(?:[-*+]\s+)?(.+?)\s+(\d{1,4})\s*$", r"^[（(]?\s*参见\s*(\d+)\s*[）)]?\s*(.*)$", r"^[（(]?\s*参见\s*(\d+)\s*[）)]?\s*(.+?)\s+(\d{1,4})\s*$"
    section = r"^(?:#{1,6}\s*)?(?:[-*+]\s+)*([一二三四五六七八九十百]+)\s*画\s*(.*)$"
    glued = r"^([一二三四五六七八九十百]+)\s*画\s*(.+)$"
    g = lambda x, p, k: f"regexp_extract({x}, '{p}', {k})"
    m = lambda x, p: f"regexp_matches({x}, '{p}')"
    return f"""WITH RECURSIVE {LINES},
    begin AS (SELECT doc_id, min(n) AS s FROM lines WHERE {m('b', r'^#{1,6}\s*索引\s*$')} OR b = '索引' GROUP BY doc_id),
    finish AS (SELECT l.doc_id, min(n) AS e FROM lines l JOIN begin USING (doc_id) WHERE n > s AND {m('b', r'^#{1,6}\s*索引\s*$')} GROUP BY l.doc_id),
    body AS (SELECT doc_id, b, regexp_replace(b, '^[-*+]+\\s*', '') AS c, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM lines JOIN begin USING (doc_id) LEFT JOIN finish USING (doc_id)
             WHERE n > s AND (e IS NULL OR n < e) AND b <> '' AND NOT {m('b', r'^(?:#{1,6}\s*)?中医临证备要\s*$')} AND NOT {m('b', r'^[第辑一二三四五六七八九十\d\s]+$')}),
    sorts AS (SELECT *, CASE WHEN {m('b', section)} THEN 'section' WHEN {m('b', both)} THEN 'both' WHEN {m('c', both)} THEN 'both in list' WHEN {m('b', note)} THEN 'note' WHEN {m('c', note)} THEN 'note in list' ELSE 'other' END AS sort,
                     trim({g('b', section, 2)}) AS rest, regexp_replace(c, '^[-*+]+\\s*', '') AS d FROM body),
    parts AS (SELECT doc_id, i,
        CASE WHEN sort = 'section' THEN {g('b', section, 1)} WHEN sort = 'other' AND {m('d', glued)} THEN {g('d', glued, 1)} ELSE '' END AS mark,
        CASE sort WHEN 'both' THEN {g('b', both, 1)} WHEN 'both in list' THEN {g('c', both, 1)} WHEN 'note' THEN {g('b', note, 1)} WHEN 'note in list' THEN {g('c', note, 1)} WHEN 'section' THEN CASE WHEN {m('rest', entry)} THEN '' ELSE {g('rest', note, 1)} END ELSE '' END AS note,
        CASE sort WHEN 'both' THEN [{g('b', both, 2)}, {g('b', both, 3)}] WHEN 'both in list' THEN [{g('c', both, 2)}, {g('c', both, 3)}] WHEN 'section' THEN [{g('rest', entry, 1)}, {g('rest', entry, 2)}]
            WHEN 'other' THEN CASE WHEN {m('d', glued)} THEN [{g(f"trim({g('d', glued, 2)})", entry, 1)}, {g(f"trim({g('d', glued, 2)})", entry, 2)}] ELSE [{g('d', entry, 1)}, {g('d', entry, 2)}] END ELSE ['', ''] END AS found FROM sorts),
    terms AS (SELECT *, trim(regexp_replace(found[1], '\\s+', '', 'g'), ' -—–·•') AS t FROM parts),
    named AS (SELECT *, {g('t', '^([一二三四五六七八九十百]+)画.+$', 1)} AS second, CASE WHEN {m('t', '^[一二三四五六七八九十百]+画.+$')} THEN regexp_replace(t, '^[一二三四五六七八九十百]+画', '') ELSE t END AS u FROM terms),
    steps AS (SELECT doc_id, i, mark, second, coalesce(nullif({g('u', r'^[（(]?参见(\d+)[）)]?.+$', 1)}, ''), note) AS note, CASE WHEN {m('u', r'^[（(]?参见\d+[）)]?.+$')} THEN {g('u', r'^[（(]?参见\d+[）)]?(.+)$', 1)} ELSE u END AS term, found[2] AS page FROM named),
    walk AS (
        SELECT doc_id, 0::BIGINT AS i, '' AS current, '' AS pending, ['# 索引', ''] AS out, 0::BIGINT AS entries FROM begin
        UNION ALL
        SELECT w.doc_id, s.i, CASE WHEN s.second <> '' THEN s.second WHEN s.mark <> '' THEN s.mark ELSE w.current END,
            CASE WHEN s.term <> '' THEN '' WHEN s.note <> '' THEN s.note ELSE w.pending END,
            list_concat(w.out,
                CASE WHEN s.mark <> '' AND s.mark <> w.current THEN list_concat(CASE WHEN w.out[-1] <> '' THEN [''] ELSE [] END, ['## ' || s.mark || '画', '']) ELSE [] END,
                CASE WHEN s.second <> '' AND s.second <> coalesce(nullif(s.mark, ''), w.current) THEN list_concat(CASE WHEN w.out[-1] <> '' AND (s.mark = '' OR s.mark = w.current) THEN [''] ELSE [] END, ['## ' || s.second || '画', '']) ELSE [] END,
                CASE WHEN s.term <> '' THEN ['- ' || s.term || CASE WHEN s.note <> '' THEN '（参见 ' || s.note || '）' WHEN w.pending <> '' THEN '（参见 ' || w.pending || '）' ELSE '' END || ' ' || s.page] ELSE [] END),
            w.entries + CASE WHEN s.term <> '' THEN 1 ELSE 0 END
        FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
    done AS (SELECT doc_id, arg_max(out, i) AS out, arg_max(entries, i) AS entries FROM walk GROUP BY doc_id),
    made AS (SELECT d.doc_id, regexp_replace(array_to_string(list_concat(list_slice(a, 1, s - 1), out), chr(10)), '\\n+$', '') || chr(10) AS text, entries FROM done d JOIN begin USING (doc_id) JOIN arrays USING (doc_id))
    SELECT src.doc_id, sha256(coalesce(made.text, src.text)) AS text_sha256, coalesce(entries, 0)::BIGINT AS entries FROM src LEFT JOIN made USING (doc_id)"""


def trailing_archive_cut() -> str:
    """By lists of line numbers."""
    record = r"(?i)^(SS\s*号\s*=|DX\s*号\s*=|\[General\s*Information\]|Document\s+generated\s+by\s+Anna''s\s+Archive|书名\s*=|作者\s*=|页数\s*=|出版日期\s*=|filename_decoded|pdg_main_pages|url\s*=\s*https?://|http://book2\.duxiu\.com/)"
    m = lambda x, p: f"regexp_matches({x}, '{p}')"
    bare = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    tight = "regexp_replace({}, '\\s+', '', 'g')".format
    unpiped = bare.format("trim({}, '|')").format
    is_record = lambda x: f"({x} <> '' AND ({m(x, record)} OR {m(unpiped(x), record)} OR {m(tight(x), '(?i)^(\\[)?GeneralInformation')} OR contains(lower({tight(x)}), 'duxiu.com') OR {m(tight(x), '^SS号=[0-9]|^DX号=[0-9]|DX号=[0-9]{5}')}))"
    goes_on = lambda x: f"({is_record(x)} OR {m(x, '(?i)^SSID *=|^(书名|作者|页数|出版日期|出版社|起止页) *[=：:]|^独秀链接')} OR {m(unpiped(x), '(?i)^SSID *=|^(书名|作者|页数|出版日期|出版社|起止页) *[=：:]|^独秀链接')})"
    anywhere = r"(?i)\[General\s*Information\]|Document\s+generated\s+by\s+Anna''s\s+Archive|url\s*=\s*https?://(book2\.)?duxiu\.com/|http://book2\.duxiu\.com/bookDetail\.jsp"
    apart = r"(?i)(^|[^\x{3400}-\x{9FFF}A-Za-z0-9])(SS|DX)\s*号\s*=\s*\d{5,}"
    at = lambda x, p, lead: f"CASE WHEN {m(x, p)} THEN strpos({x}, regexp_extract({x}, '{p}')) - 1 + {lead} END"
    place = lambda x: f"least({at(x, anywhere, '0')}, {at(x, apart, f'length(regexp_extract({x}, {chr(39)}{apart}{chr(39)}, 1))')})"
    rear = lambda i: f"({i} - 1 >= floor(n * 0.7) OR {i} - 1 >= greatest(0, n - greatest(30, n // 5)) OR coalesce(list_sum(list_transform(a[1:{i} - 1], lambda y: length(y) + 1)), 0) >= floor(length(text) * 0.8))"
    where = lambda cond: f"list_filter(range(1, n + 1), lambda i: {cond})"
    kept = lambda x: f"array_to_string({x}, chr(10)) || chr(10)"
    return f"""WITH {LINES},
    docs AS (SELECT doc_id, text, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN a[1:-2] ELSE a END AS a FROM src JOIN arrays USING (doc_id)),
    one AS (SELECT doc_id, text, a, len(a) AS n, list_transform(a, lambda y: {bare.format('y')}) AS b FROM docs WHERE len(a) >= 8),
    two AS (SELECT *, list_transform(b, lambda y: {is_record('y')}) AS r, list_transform(b, lambda y: {goes_on('y')}) AS c, list_transform(a, lambda y: {place('y')}) AS p, list_transform(b, lambda y: {m('y', r'^#{1,6}\s+\d{1,3}[.．、]\s+\S')}) AS h FROM one),
    three AS (SELECT *, {where("b[i] <> '' AND NOT r[i] AND p[i] IS NOT NULL AND (p[i] >= greatest(20, floor(length(a[i]) * 0.5)) OR NOT (p[i] < 8 AND length(a[i]) > 40) AND NOT (p[i] < floor(length(a[i]) * 0.85) AND length(a[i]) > 200)) AND trim(a[i][1:p[i]]) <> ''")}[1] AS g,
        {where('r[i] AND ' + rear('i'))}[1] AS archive, coalesce({where("b[i] <> '' AND NOT h[i]")}[-1], 0) AS prose FROM two),
    four AS (SELECT *, coalesce({where("i > g AND b[i] <> '' AND NOT c[i]")}[1], n + 1) AS g_end, {where("i > prose AND b[i] <> ''")} AS empty FROM three),
    five AS (SELECT *, CASE WHEN g IS NOT NULL THEN regexp_replace({kept("list_concat(a[1:g - 1], [rtrim(a[g][1:p[g]])], a[g_end:])")}, '\\s+$', '') || chr(10) END AS glued,
        coalesce(archive, CASE WHEN len(empty) >= 8 AND {rear('empty[1]')} THEN empty[1] END) AS c0 FROM four),
    six AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN coalesce({where("i < c0 AND b[i] <> '' AND NOT h[i]")}[-1], 0) END AS top FROM five),
    seven AS (SELECT *, CASE WHEN top = 0 THEN '' ELSE {kept('a[1:top]')} END AS upper_part FROM six),
    eight AS (SELECT *, length(glued) >= least(20, greatest(1, length(text) // 20)) OR len(string_split(glued, chr(10))) > 3 AS g_ok,
        (length(upper_part) >= least(20, greatest(1, length(text) // 20)) OR top >= 3) AND top >= 5 AS a_ok,
        length(upper_part) >= 0.5 * length(text) AND NOT (length(text) >= 500 AND top + 1 < 0.5 * len(string_split(text, chr(10)))) AND top >= greatest(20, n // 5) AS h_ok FROM seven),
    cut AS (SELECT doc_id, CASE WHEN g_ok THEN 'glued' WHEN archive IS NOT NULL THEN CASE WHEN a_ok THEN 'record' END WHEN c0 IS NOT NULL AND h_ok THEN 'headings' END AS kind, glued, upper_part FROM eight)
    SELECT src.doc_id, sha256(CASE kind WHEN 'glued' THEN glued WHEN 'record' THEN upper_part WHEN 'headings' THEN upper_part ELSE text END) AS text_sha256, kind AS cut FROM src LEFT JOIN cut USING (doc_id)"""


def formulas_merged() -> str:
    """From line to line: an island grows or ends; its names then go into a list one by one."""
    letter, cjk, kinds = "[\\x{3400}-\\x{9FFF}A-Za-z]", "[\\x{3400}-\\x{9FFF}]", "[汤散丸饮膏丹煎]"
    m = lambda x, p: f"regexp_matches({x}, '{p}')"
    tidy = lambda x: f"trim(regexp_replace(regexp_replace({x}, '(现代著名老中医名著重刊丛书)?第[一二三四五六七八九十0-9]+辑', ' ', 'g'), '\\s+', ' ', 'g'))"
    herbs = lambda x: f"len(regexp_extract_all({x}, '{letter}{{1,8}}'))"
    part = lambda x: f"""({x} <> '' AND left({x}, 1) NOT IN ('#', '|', '!', '-', '*', '>') AND NOT {m(x, '[。！？!?；;]')} AND NOT {m(x, '(?i)SS *号|出版日期|书名 *=|作者 *=|页数 *=|General Information|ISBN')} AND length({x}) <= 240
        AND ({m(x, letter + '{1,12}' + kinds)} OR {herbs(x)} >= 2 AND (length({x}) <= 48 AND NOT {m(x, '[，,：:]')} AND regexp_full_match({x}, '[\\x{{3400}}-\\x{{9FFF}}A-Za-z0-9\\s]+') OR {m(x, '[0-9]')} AND length({x}) <= 100)))"""  # noqa: E731
    named = lambda x: m(x, f"^{letter}{{1,12}}{kinds}")
    cut = lambda x: f"trim(regexp_replace({x}, '(?i)(SS\\s*号\\s*=?\\s*\\d+|出版日期\\s*=.*|General Information.*)$', ''))"
    head = f"^(({letter}+\\s*){{1,4}}[汤散丸饮膏丹煎胶])(.*)$"
    bare = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    run = "CASE WHEN regexp_matches(w, '^{0}') THEN list_transform(range(0, greatest(1, length(w) // 2)), lambda k: CASE WHEN 2 * k + 3 = length(w) THEN substr(w, 2 * k + 1, 3) ELSE substr(w, 2 * k + 1, 2) END) ELSE [trim(w)] END".format(cjk)
    spread = lambda x: f"array_to_string(list_filter(flatten(list_transform(regexp_extract_all({x}, '{cjk}+|[^\\x{{3400}}-\\x{{9FFF}}]+'), lambda w: {run})), lambda w: w <> ''), ' ')"
    name, rest = f"regexp_replace(regexp_extract(z, '{head}', 1), '\\s+', '', 'g')", f"trim(regexp_extract(z, '{head}', 3))"
    space = lambda x: f"""list_transform([CASE WHEN {m(x, '[。！？!?；;]|治疗|患者|疗效|辨证|嘱|观察|原工作|巩固|转入|收到|关键')} THEN {bare(x)} ELSE {cut(bare(x))} END], lambda z: CASE WHEN {m('z', '[。！？!?；;]|治疗|患者|疗效|辨证|嘱|观察|原工作|巩固|转入|收到|关键')} OR NOT {m('z', head)} THEN z
        WHEN {m(rest, cjk + '{2,4}' + kinds)} OR length({rest}) > 180 THEN z ELSE trim(regexp_replace({name} || ' ' || {spread(rest)}, '\\s+', ' ', 'g')) END)[1]"""  # noqa: E731
    return f"""WITH RECURSIVE {LINES},
    shown AS (SELECT l.doc_id, n, line, b, {tidy('b')} AS x FROM lines l JOIN arrays USING (doc_id) JOIN src USING (doc_id) WHERE src.text <> '' AND NOT (n = len(a) AND line = '')),
    flags AS (SELECT *, b = '' AS blank, {part('x')} AS part, {part('x')} AND {named('x')} AS opens, {m('x', letter + '{1,12}' + kinds)} AS has FROM shown),
    walk AS (
        SELECT doc_id, 0::BIGINT AS n, ''::VARCHAR AS block, false AS led, 0::BIGINT AS hold, []::VARCHAR[] AS out, 0::BIGINT AS joins FROM (SELECT DISTINCT doc_id FROM shown) s
        UNION ALL
        SELECT w.doc_id, f.n,
            CASE WHEN f.blank THEN w.block WHEN NOT f.part THEN '' WHEN w.block = '' OR f.opens AND w.led THEN f.x ELSE w.block || ' ' || f.x END,
            CASE WHEN f.blank THEN w.led WHEN f.part AND (w.block = '' OR f.opens AND w.led) THEN f.has ELSE w.led AND f.part END,
            CASE WHEN f.blank AND w.block <> '' THEN w.hold + 1 ELSE 0 END,
            CASE WHEN w.block <> '' AND NOT f.blank AND (NOT f.part OR f.opens AND w.led)
                    THEN list_concat([chr(1) || w.block], CASE WHEN w.hold > 0 OR left(f.line, 1) <> '#' THEN [''] ELSE [] END, CASE WHEN f.part THEN [] ELSE [f.line] END)
                WHEN w.block = '' AND NOT f.part THEN [f.line] ELSE [] END,
            CASE WHEN f.part AND w.block <> '' AND NOT (f.opens AND w.led) THEN 1 ELSE 0 END
        FROM walk w JOIN flags f ON f.doc_id = w.doc_id AND f.n = w.n + 1),
    ends AS (SELECT doc_id, max(n) AS n FROM walk GROUP BY doc_id),
    tails AS (SELECT doc_id, w.n + 1 AS n, list_concat([chr(1) || block], CASE WHEN hold > 0 THEN [''] ELSE [] END) AS out FROM walk w JOIN ends e USING (doc_id) WHERE w.n = e.n AND block <> ''),
    pieces AS (SELECT doc_id, n, unnest(range(1, len(out) + 1)) AS k, out FROM (SELECT doc_id, n, out FROM walk UNION ALL SELECT * FROM tails) o),
    made AS (SELECT doc_id, n, k, left(out[k], 1) = chr(1) AS is_block, CASE WHEN left(out[k], 1) = chr(1) THEN out[k][2:] ELSE out[k] END AS y FROM pieces),
    ended AS (SELECT *, CASE WHEN is_block THEN list_filter(list_transform(range(3, length(y) + 1), lambda i: [{{'s': CASE WHEN NOT {m('y[i]', kinds)} THEN 0 WHEN y[i] <> '煎' THEN CASE WHEN regexp_full_match(y[i - 2:i - 1], '{cjk}{{2}}') THEN i - 2 ELSE 0 END
        WHEN i > 4 AND regexp_full_match(y[i - 4:i - 1], '{cjk}{{4}}') THEN i - 4 WHEN i > 3 AND regexp_full_match(y[i - 3:i - 1], '{cjk}{{3}}') THEN i - 3 WHEN regexp_full_match(y[i - 2:i - 1], '{cjk}{{2}}') THEN i - 2 ELSE 0 END, 'e': i}}]), lambda c: c[1].s > 0) ELSE [] END AS c FROM made),
    placed AS (SELECT *, CASE WHEN len(c) = 0 THEN [] ELSE list_transform(list_reduce(c, lambda p, q: CASE WHEN q[1].s > p[-1].e THEN list_concat(p, q) WHEN q[1].s >= p[-1].s THEN list_concat(p[:-2], q) ELSE p END), lambda r: r.s) END AS starts FROM ended),
    parted AS (SELECT *, CASE WHEN NOT is_block OR len(starts) = 0 OR starts = [1] THEN [y] ELSE list_transform(range(1, len(starts) + 1), lambda j: trim(CASE WHEN j = 1 AND starts[1] > 1 THEN trim(y[:starts[1] - 1]) || ' ' ELSE '' END || trim(y[starts[j]:coalesce(starts[j + 1], length(y) + 1) - 1]))) END AS ps FROM placed),
    single AS (SELECT doc_id, n, k, j, CASE WHEN is_block THEN {space('ps[j]')} ELSE ps[j] END AS line FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM parted) p),
    near AS (SELECT *, {bare('line')} AS b, lag({bare('line')}) OVER (PARTITION BY doc_id ORDER BY n, k, j) AS before FROM single),
    last_pass AS (SELECT doc_id, n, k, j, CASE WHEN {part(tidy('b'))} OR {named('b')} THEN {space('line')} ELSE line END AS line FROM near WHERE NOT (b = '' AND before IS NOT NULL AND before = '')),
    texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n, k, j) || chr(10) AS text FROM last_pass GROUP BY doc_id),
    counts AS (SELECT doc_id, sum(joins)::BIGINT AS joins FROM walk GROUP BY doc_id)
    SELECT src.doc_id, sha256(coalesce(texts.text, src.text)) AS text_sha256, coalesce(joins, 0)::BIGINT AS joins FROM src LEFT JOIN texts USING (doc_id) LEFT JOIN counts USING (doc_id)"""


PLAIN = {"formulas_merged": formulas_merged, "trailing_archive_cut": trailing_archive_cut, "index_normalised": index_normalised}
