"""Reports, review roll-ups, batch state and run control as relations over logs and verdicts.

The tables play these parts: events are the log of calls and states (event_type the stage or status, user_id the
entity, value the duration or cost), conversations the chunks of documents, labels the verdicts on documents.
"""

from __future__ import annotations

from docgate.functions.dialect import Dialect
from docgate.functions.lexicon import PROFILES, RULES, S

FAILED_ABOVE = 1.5
BUDGET_MILLI = 20_000


def milli(x: str) -> str:
    return f"cast(floor({x} * 1000) as bigint)"


def call_cost_summary(d: Dialect) -> str:
    return f"""SELECT event_type AS stage, cast(count(*) as bigint) AS calls, cast(count(DISTINCT user_id) as bigint) AS entities, cast(sum({milli('value')}) as bigint) AS cost_milli,
        cast(max({milli('value')}) as bigint) AS dearest_milli, cast(sum(CASE WHEN value > {FAILED_ABOVE} THEN 1 ELSE 0 END) as bigint) AS failed FROM events GROUP BY event_type"""


def stage_counts(d: Dialect) -> str:
    return f"SELECT event_type AS stage, {d.json('props', 'k')} AS k, cast(count(*) as bigint) AS calls FROM events GROUP BY event_type, {d.json('props', 'k')}"


def latest_state(d: Dialect) -> str:
    ranked = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events"
    return f"SELECT user_id AS entity, event_id, event_type AS status, {d.seconds('ts')} AS at_us FROM ({ranked}) r WHERE nth = 1"


def state_counts(d: Dialect) -> str:
    return f"SELECT status, cast(count(*) as bigint) AS entities FROM ({latest_state(d)}) s GROUP BY status"


def latest_error(d: Dialect) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE value > {FAILED_ABOVE}"
    return f"SELECT event_type AS stage, event_id, user_id AS entity FROM ({ranked}) r WHERE nth = 1"


def budget_cutoff(d: Dialect) -> str:
    running = f"SELECT user_id, event_id, sum({milli('value')}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent, sum({milli('value')}) OVER (PARTITION BY user_id) AS wanted FROM events"
    return f"SELECT user_id AS entity, cast(count(*) as bigint) AS calls, cast(max(spent) as bigint) AS spent_milli, cast(max(wanted) as bigint) AS wanted_milli FROM ({running}) r WHERE spent <= {BUDGET_MILLI} GROUP BY user_id"


def breaker_open_intervals(d: Dialect, failures: int = 5) -> str:
    """Runs of failed calls of a stage that are long enough to open its breaker."""
    order = "(PARTITION BY event_type ORDER BY ts, event_id)"
    marked = f"SELECT *, value > {FAILED_ABOVE} AS failed, row_number() OVER {order} AS nth FROM events"
    runs = "SELECT *, nth - row_number() OVER (PARTITION BY event_type ORDER BY nth) AS run FROM marked WHERE failed"
    return f"""WITH marked AS ({marked}), runs AS ({runs})
        SELECT event_type AS stage, min(event_id) AS low_id, cast(count(*) as bigint) AS failures, cast(max({d.seconds('ts')}) - min({d.seconds('ts')}) as bigint) AS open_us
        FROM runs GROUP BY event_type, run HAVING count(*) >= {failures}"""


def heartbeat_stale(d: Dialect, hours: int = 6) -> str:
    gaps = f"SELECT user_id, event_id, {d.seconds('ts')} AS at_us, lead({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_us FROM events"
    return f"SELECT user_id AS entity, event_id, cast(next_us - at_us as bigint) AS silent_us FROM ({gaps}) g WHERE next_us - at_us > {hours * 3_600_000_000}"


def natural_sort(d: Dialect) -> str:
    name = "CASE WHEN doc_id % 5 = 0 THEN source ELSE concat(cast(doc_id % 37 as varchar(20)), '_', source) END" if d.name == "duckdb" else "CASE WHEN doc_id % 5 = 0 THEN source ELSE concat(cast(doc_id % 37 as string), '_', source) END"
    named = f"SELECT doc_id, {name} AS name FROM documents"
    number = d.group("name", r"^(\d+)")
    keyed = f"SELECT *, CASE WHEN {d.like('name', r'^\d')} THEN cast({number} as bigint) END AS number FROM ({named}) n" if d.name == "spark" else f"SELECT *, CASE WHEN {d.like('name', r'^\d')} THEN try_cast({number} AS BIGINT) END AS number FROM ({named}) n"
    return f"SELECT doc_id, name, cast(row_number() OVER (ORDER BY CASE WHEN number IS NULL THEN 1 ELSE 0 END, number, lower(name), doc_id) as bigint) AS place FROM ({keyed}) k"


def batch_window(d: Dialect, skip: int = 100, limit: int = 250) -> str:
    """A start index and a limit over the sorted sources: a report on part of a batch."""
    return f"SELECT doc_id, name, place FROM ({natural_sort(d)}) s WHERE place > {skip} AND place <= {skip + limit}"


def delivered(d: Dialect) -> str:
    """The manifest of deliveries: texts of documents that a verdict found good and not toxic."""
    return f"SELECT DISTINCT {d.sha256('t.text')} AS source_sha256 FROM documents t JOIN labels v ON t.doc_id = v.doc_id WHERE v.quality = 1 AND v.toxic = 0"


def delivered_semijoin(d: Dialect) -> str:
    return f"SELECT doc_id FROM documents t WHERE {d.sha256('text')} IN (SELECT source_sha256 FROM ({delivered(d)}) m)"


def resume_antijoin(d: Dialect) -> str:
    return f"SELECT t.doc_id FROM documents t LEFT JOIN ({delivered(d)}) m ON {d.sha256('t.text')} = m.source_sha256 WHERE m.source_sha256 IS NULL"


def review_rollup(d: Dialect) -> str:
    """Verdicts on documents: blocked if poor or toxic, unreviewed if none."""
    return """SELECT t.lang, cast(count(*) as bigint) AS documents, cast(sum(CASE WHEN v.doc_id IS NULL THEN 1 ELSE 0 END) as bigint) AS unreviewed,
        cast(sum(CASE WHEN v.quality = 0 OR v.toxic = 1 THEN 1 ELSE 0 END) as bigint) AS blocked, cast(sum(CASE WHEN v.quality = 1 AND v.toxic = 0 THEN 1 ELSE 0 END) as bigint) AS accepted
        FROM documents t LEFT JOIN labels v ON t.doc_id = v.doc_id GROUP BY t.lang"""


def review_issue_counts(d: Dialect) -> str:
    return """SELECT category, severity, cast(count(*) as bigint) AS issues FROM (
        SELECT doc_id, 'quality' AS category, 'major' AS severity FROM labels WHERE quality = 0 UNION ALL
        SELECT doc_id, 'toxicity' AS category, 'blocking' AS severity FROM labels WHERE toxic = 1 UNION ALL
        SELECT doc_id, 'layout' AS category, 'minor' AS severity FROM labels WHERE quality = 1 AND toxic = 0) i GROUP BY category, severity"""


def finalisation_override(d: Dialect) -> str:
    """Chunks that failed only on what finishing mends: noise, punctuation, and layout with a break in the excerpt or a merge asked for.

    A turn stands for an issue: its role for the category, its text for the excerpt, its first words for the action."""
    category = "CASE WHEN length(text) % 5 = 0 THEN 'content_loss' WHEN role = 'user' THEN 'layout' WHEN length(text) % 2 = 0 THEN 'ocr_noise' ELSE 'punctuation' END"
    issues = f"SELECT conv_id, {category} AS category, text AS excerpt, CASE WHEN length(text) % 3 = 0 THEN concat('Merge ', substr(text, 1, 20)) ELSE substr(text, 1, 20) END AS action FROM conversations"
    safe = f"(category IN ('ocr_noise', 'punctuation') OR category = 'layout' AND ({d.contains('excerpt', d.text(chr(10)))} OR {d.contains('lower(action)', d.text('merge'))}))"
    return f"SELECT conv_id, cast(count(*) as bigint) AS issues, min(CASE WHEN {safe} THEN 1 ELSE 0 END) = 1 AS may_finish FROM ({issues}) i GROUP BY conv_id"


def safe_patch_filter(d: Dialect) -> str:
    """Patches that may be put in: a short excerpt that stands in its text once, with its numbers unchanged by the patch."""
    issue = f"SELECT conv_id, turn, text, substr(text, 3, 12) AS excerpt, {d.sub('substr(text, 3, 12)', '[aeiou]', 'e')} AS patch FROM conversations"
    once = "length(text) - length(replace(text, excerpt, '')) = length(excerpt)"
    numbers = f"{d.join(d.groups('excerpt', '[0-9]+'), ',')} = {d.join(d.groups('patch', '[0-9]+'), ',')}"
    return f"SELECT conv_id, turn, excerpt, patch, {once} AND {numbers} AND length(excerpt) <= 240 AND excerpt <> patch AS safe FROM ({issue}) i WHERE length(excerpt) > 0"


def chunk_context_prev_next(d: Dialect, context: int = 1200) -> str:
    """Each chunk with the end of the one before and the start of the one behind."""
    w = "(PARTITION BY conv_id ORDER BY turn)"
    near = f"SELECT conv_id, turn, text, lag(text) OVER {w} AS before, lead(text) OVER {w} AS behind FROM conversations"
    tail = f"CASE WHEN length(before) > {context} THEN substr(before, length(before) - {context - 1}) ELSE before END"
    return f"SELECT conv_id, turn, coalesce({tail}, '') AS prev_tail, coalesce(substr(behind, 1, {context}), '') AS next_head FROM ({near}) n"


def coalesce_repaired(d: Dialect) -> str:
    """Chunks with their repaired text, where there is one, put together again in order."""
    repaired = f"SELECT conv_id, turn, {d.sub('text', S + '{2,}', ' ')} AS repaired FROM conversations WHERE length(text) > 120"
    both = f"SELECT c.conv_id, c.turn, coalesce(r.repaired, c.text) AS text FROM conversations c LEFT JOIN ({repaired}) r ON c.conv_id = r.conv_id AND c.turn = r.turn"
    return f"SELECT conv_id, {d.sha256(d.join(d.gather('text', 'turn'), chr(10) * 2))} AS text_sha256, cast(count(*) as bigint) AS chunks FROM ({both}) b GROUP BY conv_id"


def model_recommendation(d: Dialect, preferred: str = "click", fallback: str = "purchase") -> str:
    """For each batch (every hundredth entity), which of two models to take: the preferred one if both succeed with equal quality, else the fallback if it succeeds, else the preferred if it does, else the fallback if it ran at all."""
    quality = f"SELECT user_id % 100 AS batch, event_type AS model, count(*) AS total, sum(CASE WHEN value <= 60 THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS failed FROM events WHERE event_type IN ({d.text(preferred)}, {d.text(fallback)}) GROUP BY user_id % 100, event_type"
    succeeds = "coalesce({0}.failed = 0 AND {0}.passed > 0, false)"
    p, f = succeeds.format("p"), succeeds.format("f")
    same = f"({p} AND {f} AND p.total = f.total AND p.passed = f.passed AND p.failed = f.failed)"
    basis = f"CASE WHEN {same} THEN 'equal_quality' WHEN {f} THEN 'fallback_succeeds' WHEN {p} THEN 'only_preferred_succeeds' WHEN f.batch IS NOT NULL THEN 'none_succeeds' ELSE 'only_preferred_ran' END"
    chosen = f"CASE WHEN NOT {same} AND ({f} OR NOT {p} AND f.batch IS NOT NULL) THEN {d.text(fallback)} ELSE {d.text(preferred)} END"
    return f"""SELECT coalesce(p.batch, f.batch) AS batch, {chosen} AS model, {basis} AS basis, {same} AS equivalent
        FROM (SELECT * FROM ({quality}) q WHERE model = {d.text(preferred)}) p FULL OUTER JOIN (SELECT * FROM ({quality}) q WHERE model = {d.text(fallback)}) f ON p.batch = f.batch"""


def page_segments(d: Dialect, most: int = 5) -> str:
    """Pages of a source (500 characters each) in segments of so many: numbers from 1, both ends inside."""
    pages = "SELECT doc_id, cast(ceil(n_chars / 500.0) as bigint) AS pages FROM documents WHERE n_chars > 0"
    starts = f"SELECT doc_id, pages, {d.each('0', f'cast(floor((pages - 1) / {most}.0) as bigint)')} AS nth FROM ({pages}) p"
    return f"SELECT doc_id, nth + 1 AS segment, nth * {most} + 1 AS first_page, least(nth * {most} + {most}, pages) AS last_page FROM ({starts}) s"


def segment_batches(d: Dialect, size: int = 8) -> str:
    numbered = f"SELECT doc_id, segment, row_number() OVER (PARTITION BY doc_id ORDER BY segment) AS nth FROM ({page_segments(d)}) s"
    return f"SELECT doc_id, cast(floor((nth - 1) / {size}.0) as bigint) AS batch, cast(count(*) as bigint) AS segments, cast(min(segment) as bigint) AS first_segment FROM ({numbered}) n GROUP BY doc_id, floor((nth - 1) / {size}.0)"


def data_id(d: Dialect, name: str, number: str, prefix: str = "docgate_", most: int = 128) -> str:
    """A segment's id at a remote service that takes so many bytes: prefix, the source's safe stem, its number. A stem that is too long is cut between characters and gets a hash."""
    stem = d.sub(d.sub(name, rf'[\\/:*?\x22<>|{S[1:-1]}]+', "_"), r"^[._]+|[._]+$")
    stem = f"(CASE WHEN {stem} = '' THEN 'document' ELSE {stem} END)"
    suffix = f"concat('_', lpad({d.string(number)}, 3, '0'))"
    room = f"({most - len(prefix)} - length({suffix}))"
    fits = d.max(d.filter(d.range("0", f"length({stem})"), "k", f"{d.bytes(f'substr({stem}, 1, cast(k as int))')} <= {room} - 9"))
    cut = d.sub(f"substr({stem}, 1, cast({fits} as int))", r"[._-]+$")
    short = f"substr(sha1({stem}), 1, 8)"
    return f"concat({d.text(prefix)}, CASE WHEN {d.bytes(stem)} <= {room} THEN {stem} WHEN {cut} = '' THEN {short} ELSE concat({cut}, '_', {short}) END, {suffix})"


def segment_data_id(d: Dialect) -> str:
    named = f"SELECT s.doc_id, s.segment, concat(t.source, ' ', repeat('药材', cast(s.doc_id % 40 as int)), '.') AS name FROM ({page_segments(d)}) s JOIN (SELECT doc_id, source FROM documents) t ON s.doc_id = t.doc_id"
    return f"SELECT doc_id, segment, {data_id(d, 'name', 'segment')} AS data_id FROM ({named}) n"


def source_kind(d: Dialect) -> str:
    suffix = d.group("lower(url)", r"\.([a-z0-9]+)$")
    url = "concat(url, CASE page_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' WHEN 3 THEN '.png' ELSE '.exe' END)"
    kind = "CASE WHEN suffix = 'md' THEN 'markdown' WHEN suffix = 'pdf' THEN 'pdf' WHEN suffix IN ('doc', 'docx') THEN 'word' WHEN suffix IN ('png', 'jpg', 'jpeg', 'jp2', 'webp', 'gif', 'bmp', 'ppt', 'pptx', 'xls', 'xlsx') THEN 'mineru_only' END"
    return f"SELECT page_id, suffix, {kind} AS kind FROM (SELECT page_id, {suffix} AS suffix FROM (SELECT page_id, {url} AS url FROM pages) u) s WHERE {kind} IS NOT NULL"


def safe_stem(d: Dialect) -> str:
    stem = d.sub(d.sub("url", r'[\\/:*?\x22<>|\s]+', "_"), r"^[._]+|[._]+$")
    return f"SELECT page_id, CASE WHEN {stem} = '' THEN 'document' ELSE {stem} END AS stem FROM pages"


def profile_join(d: Dialect) -> str:
    rows = [(d.text(p), str(i)) for i, p in enumerate(PROFILES)]
    return f"SELECT p.profile_id, cast(count(t.doc_id) as bigint) AS documents, cast(coalesce(sum(t.n_chars), 0) as bigint) AS chars FROM {d.values(rows, 'profile_id, nth')} p LEFT JOIN documents t ON t.doc_id % {len(PROFILES)} = p.nth GROUP BY p.profile_id"


def rule_join(d: Dialect) -> str:
    rows = [(d.text(r), d.text(risk), d.text(mode), str(i)) for i, (r, (_, risk, mode)) in enumerate(RULES.items())]
    return f"SELECT r.rule_id, r.risk_level, r.write_mode, cast(count(*) as bigint) AS changes FROM documents t JOIN {d.values(rows, 'rule_id, risk_level, write_mode, nth')} r ON t.doc_id % {len(RULES)} = r.nth GROUP BY r.rule_id, r.risk_level, r.write_mode"


def status_cascade(d: Dialect) -> str:
    """The stage that a document stands at, from what is known of it."""
    return """SELECT t.doc_id, CASE WHEN t.text = '' THEN 'error' WHEN v.doc_id IS NULL THEN 'review_required' WHEN v.toxic = 1 THEN 'final_acceptance_failed'
        WHEN v.quality = 0 THEN 'acceptance_failed' ELSE 'passed' END AS status FROM documents t LEFT JOIN labels v ON t.doc_id = v.doc_id"""


def job_status(d: Dialect) -> str:
    """A job (a source's documents) has passed only if every document of it has."""
    return f"SELECT t.source, CASE WHEN min(CASE WHEN s.status = 'passed' THEN 1 ELSE 0 END) = 1 THEN 'passed' ELSE 'review_required' END AS status, cast(count(*) as bigint) AS documents FROM ({status_cascade(d)}) s JOIN documents t ON s.doc_id = t.doc_id GROUP BY t.source"


def progress_percent(d: Dialect) -> str:
    """Progress after each finished document of a source: at most 95 until all are done."""
    done = "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS done, count(*) OVER (PARTITION BY source) AS total FROM documents"
    return f"SELECT source, doc_id, cast(least(95, 20 + floor(75 * done / (total * 1.0))) as bigint) AS percent FROM ({done}) p"


def models_by_documents(d: Dialect) -> str:
    """Every model against every source: the grid of a comparison run."""
    return "SELECT m.model, s.source, cast(s.documents as bigint) AS documents FROM (SELECT DISTINCT event_type AS model FROM events) m CROSS JOIN (SELECT source, count(*) AS documents FROM documents GROUP BY source) s"


def quality_left_joins(d: Dialect) -> str:
    """A row for each document, with its verdict, its log and its chunks where there are any."""
    return f"""SELECT t.doc_id, v.quality, v.toxic, m.calls, m.cost_milli, c.chunks FROM documents t LEFT JOIN labels v ON t.doc_id = v.doc_id
        LEFT JOIN (SELECT user_id, cast(count(*) as bigint) AS calls, cast(sum({milli('value')}) as bigint) AS cost_milli FROM events GROUP BY user_id) m ON t.doc_id = m.user_id
        LEFT JOIN (SELECT conv_id, cast(count(*) as bigint) AS chunks FROM conversations GROUP BY conv_id) c ON t.doc_id = c.conv_id"""


def log_semijoin(d: Dialect) -> str:
    """The log's rows on sources that are there now."""
    return "SELECT event_id, user_id AS entity FROM events WHERE user_id IN (SELECT doc_id FROM documents)"


def issues_antijoin(d: Dialect) -> str:
    """Issues that no safe patch has settled."""
    return f"SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, turn FROM ({safe_patch_filter(d)}) p WHERE safe) a ON c.conv_id = a.conv_id AND c.turn = a.turn WHERE a.conv_id IS NULL"


def result_by_either_key(d: Dialect) -> str:
    """Results matched by their id, and by their name where the id finds none."""
    by_name = "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source"
    return f"""SELECT t.doc_id, coalesce(v.doc_id, n.doc_id) AS matched, CASE WHEN v.doc_id IS NOT NULL THEN 'id' WHEN n.doc_id IS NOT NULL THEN 'name' ELSE 'none' END AS matched_by
        FROM documents t LEFT JOIN labels v ON t.doc_id = v.doc_id LEFT JOIN ({by_name}) n ON t.source = n.source"""


def cost_with_nulls(d: Dialect) -> str:
    """What is known of each entity's cost: null where no call has one, not zero."""
    known = f"CASE WHEN event_type = 'purchase' THEN {milli('value')} END"
    return f"SELECT user_id AS entity, cast(sum({known}) as bigint) AS cost_milli, cast(count({known}) as bigint) AS priced, cast(count(*) as bigint) AS calls FROM events GROUP BY user_id"


def dearest_samples(d: Dialect, most: int = 8) -> str:
    """The first few samples of each entity, dearest first."""
    ranked = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events"
    return f"SELECT user_id AS entity, event_id, cast(nth as bigint) AS nth FROM ({ranked}) r WHERE nth <= {most}"


def largest_output(d: Dialect) -> str:
    """Of each host's pages the longest: the parse to take among several."""
    host = d.group("url", r"^[a-z]+://([^/]+)")
    sized = f"SELECT {host} AS host, page_id, length(coalesce(html, '')) AS chars FROM pages"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY host ORDER BY chars DESC, page_id) AS nth FROM ({sized}) s"
    return f"SELECT host, page_id, cast(chars as bigint) AS chars FROM ({ranked}) r WHERE nth = 1"


def all_names(d: Dialect) -> str:
    """The distinct names of sources and models, and where each stands among them."""
    return "SELECT name, cast(row_number() OVER (ORDER BY name) as bigint) AS place FROM (SELECT source AS name FROM documents WHERE source IS NOT NULL UNION SELECT event_type AS name FROM events UNION SELECT lang AS name FROM documents WHERE lang IS NOT NULL) n"


def settled_entities(d: Dialect) -> str:
    """Whether all states of an entity are among the settled ones."""
    return "SELECT user_id AS entity, min(CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 1 ELSE 0 END) = 1 AS settled, cast(count(DISTINCT event_type) as bigint) AS states FROM events GROUP BY user_id"


def poll_states(d: Dialect) -> str:
    """A segment's state from its log: the first final state stands, whatever comes later; else the latest one, with the number of polls."""
    state = f"CASE WHEN value > 150 THEN 'failed' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'click' THEN 'polling' WHEN event_type = 'view' THEN 'uploading' ELSE 'creating_task' END"
    marked = f"SELECT user_id, event_id, ts, {state} AS state FROM events"
    order = "(PARTITION BY user_id ORDER BY ts, event_id)"
    counted = f"SELECT *, row_number() OVER {order} AS nth, sum(CASE WHEN state IN ('done', 'failed') THEN 1 ELSE 0 END) OVER {order} AS finals, count(*) OVER (PARTITION BY user_id) AS total FROM ({marked}) m"
    stands = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN finals = 1 AND state IN ('done', 'failed') THEN 0 ELSE 1 END, nth DESC) AS pick FROM ({counted}) c"
    return f"SELECT user_id AS segment, state, cast(nth as bigint) AS steps, cast(total - nth as bigint) AS ignored FROM ({stands}) s WHERE pick = 1"


def acquisition_policy(d: Dialect) -> str:
    """How a document is acquired, from what there is: existing Markdown wins or fails alone, then either parser, the local one only as an opted-in fallback."""
    there = f"SELECT t.doc_id, v.quality IS NOT NULL AS has_existing, coalesce(v.quality = 1, false) AS existing_usable, {d.like('t.text', r'[0-9]')} AS remote_usable, length(t.text) % 3 = 0 AS local_opted, length(t.text) > 200 AS local_usable FROM documents t LEFT JOIN labels v ON t.doc_id = v.doc_id"
    return f"""SELECT doc_id, CASE WHEN has_existing AND existing_usable THEN 'existing_md' WHEN has_existing THEN 'failed' WHEN remote_usable AND local_opted AND local_usable THEN 'selected_remote'
        WHEN remote_usable THEN 'remote_only' WHEN local_opted AND local_usable THEN 'local_fallback' ELSE 'failed' END AS mode FROM ({there}) a"""


def cached_merges(d: Dialect) -> str:
    """Merges that may be taken from the cache: converted, of the same sources in the same order, all of them there."""
    now = f"SELECT conv_id, {d.gather('role', 'turn')} AS sources, min(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END) AS whole FROM conversations GROUP BY conv_id"
    kept = f"SELECT conv_id, {d.gather('role', 'turn')} AS sources, CASE WHEN max(length(text)) > 150 THEN 'converted' ELSE 'failed' END AS status FROM conversations WHERE length(text) > 20 GROUP BY conv_id"
    return f"SELECT n.conv_id, coalesce(k.status = 'converted' AND n.sources = k.sources AND n.whole = 1, false) AS from_cache FROM ({now}) n LEFT JOIN ({kept}) k ON n.conv_id = k.conv_id"


def merged_segments(d: Dialect) -> str:
    """Segments without space around them, put together in order with blank lines."""
    bare = d.sub("text", f"^{S}+|{S}+$")
    return f"SELECT conv_id, {d.sha256(d.join(d.gather(bare, 'turn'), chr(10) * 2))} AS text_sha256 FROM conversations GROUP BY conv_id"


def complete_corrections(d: Dialect) -> str:
    """Documents all of whose chunks have a corrected text: only these may be delivered, with the hash of what they make together."""
    return f"SELECT conv_id, {d.sha256(d.join(d.gather('text', 'turn'), chr(10) * 2))} AS text_sha256, cast(count(*) as bigint) AS chunks FROM conversations GROUP BY conv_id HAVING min(CASE WHEN length(coalesce(text, '')) > 40 THEN 1 ELSE 0 END) = 1"


def nearest_anchor(d: Dialect, within: int = 80) -> str:
    """Each line's distance to the next heading behind it, if one follows within so many lines."""
    from docgate.functions import text as t
    from docgate.operators import structure
    from docgate.plans import dirty

    lines = structure.rows(d, f"({dirty.view(d)}) v")
    ahead = f"SELECT doc_id, pos, min(CASE WHEN {t.is_heading(d, 'bare')} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {within} FOLLOWING) AS anchor FROM ({lines}) l"
    return f"SELECT doc_id, cast(count(*) as bigint) AS lines, cast(min(anchor - pos) as bigint) AS nearest, cast(sum(anchor - pos) as bigint) AS distances FROM ({ahead}) a WHERE anchor IS NOT NULL GROUP BY doc_id"


def audit_snippet(d: Dialect, around: int = 60, most: int = 40) -> str:
    """The place in a document's whole text that a chunk's first line, last characters or first long run of letters is found at, and the text around it."""
    whole = f"SELECT conv_id, {d.join(d.gather('text', 'turn'), chr(10))} AS audit FROM conversations GROUP BY conv_id"
    anchors = d.array(f"substr({d.group('c.text', '^([^' + chr(10) + ']*)')}, 1, {around})", f"CASE WHEN length(c.text) > {around} THEN substr(c.text, length(c.text) - {around - 1}, {around}) ELSE c.text END", f"substr({d.group('c.text', '([A-Za-z]{8,})')}, 1, {most})")
    found = d.filter(d.map(anchors, "x", "CASE WHEN x = '' THEN 0 ELSE instr(w.audit, x) END"), "y", "y > 0")
    placed = f"SELECT c.conv_id, c.turn, w.audit, cast({d.at(found, '1')} as bigint) AS place FROM conversations c JOIN ({whole}) w ON c.conv_id = w.conv_id"
    start = "greatest(1, place - 2000)"
    return f"SELECT conv_id, turn, place, {d.sha256(f'substr(audit, cast({start} as int), cast(place - {start} + 2000 as int))')} AS snippet_sha256 FROM ({placed}) p WHERE place IS NOT NULL"


def message_texts(d: Dialect) -> str:
    """The text of a model's message: its content, else its reasoning, with a mark for what is left of markup."""
    plain = d.sub("text", r"[^A-Za-z0-9 .,]", "")
    head, tail = d.text('{"choices":[{"message":{"role":"assistant","content":"'), d.text('"}}]}')
    answer = f"SELECT conv_id, turn, concat({head}, {plain}, {tail}) AS answer FROM conversations"
    content = d.json("answer", "choices[0].message.content")
    return f"SELECT conv_id, turn, {content} AS content, {d.like(content, '[$]|[0-9]{5,}')} AS residue FROM ({answer}) a"


def uploads(d: Dialect) -> str:
    """Files sent in base64: decoded, under names without a path, of the kinds that are taken."""
    name = d.sub("concat(url, CASE WHEN page_id % 3 = 0 THEN '.exe' ELSE '.md' END)", r"^.*[/\\]")
    sent = f"SELECT page_id, {name} AS name, {'base64(encode(coalesce(html, {0})))' if d.name == 'duckdb' else 'base64(encode(coalesce(html, {0}), {1}))'} AS body FROM pages".replace("{0}", "''").replace("{1}", "'UTF-8'")
    decoded = "decode(from_base64(body))" if d.name == "duckdb" else "decode(unbase64(body), 'UTF-8')"
    return f"SELECT page_id, name, {d.sha256(decoded)} AS text_sha256 FROM ({sent}) s WHERE {d.like('lower(name)', r'[.](?:md|pdf|docx?|png)$')}"


def planned_moves(d: Dialect) -> str:
    """A plan to move outputs under safe names, and the targets that more than one source would take."""
    target = d.sub("lower(url)", r"[^a-z0-9.]+", "_")
    return f"SELECT target, cast(count(*) as bigint) AS sources, count(*) > 1 AS clashes, min(page_id) AS first_page FROM (SELECT page_id, substr({target}, 1, 24) AS target FROM pages) m GROUP BY target"


def event_days(d: Dialect) -> str:
    """Scalar forms of reports: ISO days, numbers filled with zeros, previews of a text in one line, shares kept within bounds."""
    preview = d.sub("substr(text, 1, 80)", f"{S}+", " ")
    return f"SELECT conv_id, turn, concat(lpad({d.string('conv_id % 1000')}, 3, '0'), '_', lpad({d.string('turn')}, 2, '0')) AS part, {preview} AS preview, least(100, greatest(0, length(text) - 50)) AS share, {d.contains('text', d.text('the'))} AS has_the FROM conversations"


RELATIONS = (
    quality_left_joins, log_semijoin, issues_antijoin, result_by_either_key, cost_with_nulls, dearest_samples, largest_output, all_names, settled_entities, poll_states, acquisition_policy, cached_merges,
    merged_segments, complete_corrections, nearest_anchor, audit_snippet, message_texts, uploads, planned_moves, event_days,
    call_cost_summary, stage_counts, latest_state, state_counts, latest_error, budget_cutoff, breaker_open_intervals, heartbeat_stale, natural_sort, batch_window,
    delivered_semijoin, resume_antijoin, review_rollup, review_issue_counts, finalisation_override, safe_patch_filter, chunk_context_prev_next, coalesce_repaired,
    model_recommendation, page_segments, segment_batches, segment_data_id, source_kind, safe_stem, profile_join, rule_join, status_cascade, job_status,
    progress_percent, models_by_documents,
)
