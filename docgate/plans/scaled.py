"""Plans for Spark where the plain SQL, which stays what they are checked by, would put a growing table into one task.

A rank over everything is the rank inside a bucket of a bounded size plus what stands in the buckets before; only the
table of buckets is ordered as a whole. The newest row of a few keys is an aggregate with map-side combining.
"""

from __future__ import annotations

from docgate.functions import text as t
from docgate.functions.dialect import Dialect
from docgate.operators import structure
from docgate.plans import dirty, relational

#: Rows of a bucket, at most: ids of so wide a span.
SPAN = 100_000


def _named(d: Dialect) -> str:
    name = f"CASE WHEN doc_id % 5 = 0 THEN source ELSE concat({d.string('doc_id % 37')}, '_', source) END"
    number = f"CASE WHEN {d.like('name', r'^[0-9]')} THEN cast({d.group('name', r'^([0-9]+)')} as bigint) END"
    return f"SELECT doc_id, name, coalesce(number, -1) AS number, number IS NULL AS bare, lower(name) AS low, floor(doc_id / {SPAN}) AS span FROM (SELECT *, {number} AS number FROM (SELECT doc_id, {name} AS name FROM documents) n) k"


def natural_sort(d: Dialect) -> str:
    keys = "bare, number, low, span"
    sizes = f"SELECT {keys}, sum(size) OVER (ORDER BY {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM (SELECT {keys}, count(*) AS size FROM named GROUP BY {keys}) b"
    placed = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id) AS inside FROM named"
    on = " AND ".join(f"p.{k} <=> s.{k}" for k in keys.split(", "))
    return f"WITH named AS ({_named(d)}) SELECT p.doc_id, p.name, cast(s.before + p.inside as bigint) AS place FROM ({placed}) p JOIN ({sizes}) s ON {on}"


def batch_window(d: Dialect, skip: int = 100, limit: int = 250) -> str:
    return f"SELECT doc_id, name, place FROM ({natural_sort(d)}) s WHERE place > {skip} AND place <= {skip + limit}"


def latest_error(d: Dialect) -> str:
    return f"SELECT stage, last.event_id, last.user_id AS entity FROM (SELECT event_type AS stage, max(named_struct('ts', ts, 'event_id', event_id, 'user_id', user_id)) AS last FROM events WHERE value > {relational.FAILED_ABOVE} GROUP BY event_type) l"


def progress_percent(d: Dialect) -> str:
    sizes = f"SELECT source, span, sum(size) OVER (PARTITION BY source ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER (PARTITION BY source) AS total FROM (SELECT source, span, count(*) AS size FROM placed GROUP BY source, span) b"
    return f"""WITH placed AS (SELECT source, doc_id, floor(doc_id / {SPAN}) AS span FROM documents)
        SELECT p.source, p.doc_id, cast(least(95, 20 + floor(75 * (s.before + p.inside) / (s.total * 1.0))) as bigint) AS percent
        FROM (SELECT *, row_number() OVER (PARTITION BY source, span ORDER BY doc_id) AS inside FROM placed) p JOIN ({sizes}) s ON p.source <=> s.source AND p.span = s.span"""


def heading_spacing(d: Dialect) -> str:
    """One pass: each line becomes one to three."""
    source = f"({dirty.view(d)}) dirty"
    fence = d.like("bare", "^```")
    marked = f"SELECT *, {fence} AS is_fence, sum(CASE WHEN {fence} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM ({structure.rows(d, source)}) r"
    state = f"SELECT *, NOT is_fence AND fences % 2 = 0 AND {t.is_heading(d, 'bare')} AS is_head, is_fence AND fences % 2 = 1 AS opens FROM ({marked}) m"
    near = f"SELECT *, lag(line) OVER w AS before, lag(is_head) OVER w AS after_head, lead(bare) OVER w AS next FROM ({state}) s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    parts = "filter(array(CASE WHEN (is_head OR opens) AND before IS NOT NULL AND before <> '' AND NOT after_head THEN '' END, CASE WHEN is_head THEN bare ELSE line END, CASE WHEN is_head AND next IS NOT NULL AND next <> '' THEN '' END), x -> x IS NOT NULL)"
    made = f"SELECT doc_id, pos, array_join({parts}, '\\n') AS line FROM ({near}) n"
    return f"SELECT doc_id, {d.sha256('text')} AS text_sha256 FROM ({structure.packed(d, made)}) p"


PLANS = {build.__name__: build for build in (natural_sort, batch_window, latest_error, progress_percent, heading_spacing)}
