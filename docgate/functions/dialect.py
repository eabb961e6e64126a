"""One way to write an expression, two engines to run it: Spark SQL, and DuckDB for checks.

The engines differ in string escapes, regular-expression names, lambdas and array functions. Expressions elsewhere in
this package are written through a `Dialect`, so that patterns and logic stand in one place. Patterns spell their
classes out (`\\x{...}` works in Java and RE2 alike) and avoid what only one engine has.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from docgate.functions.lexicon import S


def _listed(chars: str) -> str:
    """The characters of a class, as a literal of Spark's SQL."""
    found = re.findall(r"\\x(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{2}))(-?)", chars)
    codes, k = [], 0
    while k < len(found):
        lo = hi = int(found[k][0] or found[k][1], 16)
        if found[k][2]:
            k += 1
            hi = int(found[k][0] or found[k][1], 16)
        codes += range(lo, hi + 1)
        k += 1
    return "'" + "".join(f"\\u{c:04x}" for c in codes) + "'"


class Dialect:
    name = ""

    def text(self, value: str) -> str:
        raise NotImplementedError

    def texts(self, values) -> str:
        return self.array(*map(self.text, values))


class SparkDialect(Dialect):
    name = "spark"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def pattern(self, pattern: str) -> str:
        """A class of white space tries a dozen ranges on each character: letters and signs of ASCII are told first, by two."""
        return self.text(pattern.replace(S, rf"[\x00-\x20\x7f-\x{{3000}}&&{S}]"))

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.pattern(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.pattern(pattern)})"

    def chars(self, x: str, chars: str) -> str:
        """How many characters of x are of a class (inside of brackets): runs of them are taken out, no match is kept."""
        return f"(length({x}) - length({self.sub(x, f'[{chars}]+')}))"

    def sub(self, x: str, pattern: str, new: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.text(new)})"

    def group(self, x: str, pattern: str, n: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(pattern)}, {n})"

    def groups(self, x: str, pattern: str, n: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(pattern)}, {n})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.text(pattern)}, -1)"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def no_texts(self) -> str:
        return "cast(array() as array<string>)"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, cast({i} as int))"

    def part(self, a: str, start: str, length: str) -> str:
        return f"slice({a}, cast({start} as int), cast({length} as int))"

    def map(self, a: str, x: str, body: str) -> str:
        return f"transform({a}, {x} -> {body})"

    def mapi(self, a: str, x: str, i: str, body: str) -> str:
        return f"transform({a}, ({x}, {i}) -> {body})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"filter({a}, {x} -> {body})"

    def any(self, a: str, x: str, body: str) -> str:
        return f"exists({a}, {x} -> {body})"

    def range(self, lo: str, hi: str) -> str:
        return f"(CASE WHEN {hi} < {lo} THEN cast(array() as array<bigint>) ELSE sequence(cast({lo} as bigint), cast({hi} as bigint)) END)"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def max(self, a: str) -> str:
        return f"array_max({a})"

    def sort(self, a: str) -> str:
        return f"sort_array({a})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.text(by)})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def contains(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def explode(self, table: str, a: str, columns: str = "*") -> str:
        """Rows of table, once for each item of the array a, with pos from 0 and item."""
        # outer, since else a filter on the array's size is pushed below it and repeats whatever made the array
        return f"SELECT * FROM (SELECT {columns}, cast(pos as bigint) AS pos, item FROM {table} LATERAL VIEW OUTER posexplode({a}) e AS pos, item) WHERE pos IS NOT NULL"

    def last(self, x: str) -> str:
        """The last value that isn't null, for use over a window."""
        return f"last_value({x}, true)"

    def fence(self, x: str) -> str:
        """x, computed once: filters on what depends on it stay above and aren't pushed into the expressions below."""
        return f"(CASE WHEN monotonically_increasing_id() >= 0 THEN {x} END)"

    def gather(self, value: str, order: str) -> str:
        return f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {value}))), x -> x.v)"

    def each(self, lo: str, hi: str) -> str:
        return f"explode({self.range(lo, hi)})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})"

    def string(self, x: str) -> str:
        return f"cast({x} as string)"

    def gather_over(self, x: str, window: str) -> str:
        """The values that aren't null, in the window's order."""
        return f"collect_list({x}) OVER {window}"

    def where(self, x: str, needles: tuple[str, ...], change: Callable[[str], str], v: str) -> str:
        """x changed, if it holds any of the needles; else as it is, without a pattern being tried. v: a name for it inside."""
        holds = " OR ".join(self.contains(v, self.text(n)) for n in needles)
        return self.at(self.map(self.array(x), v, f"CASE WHEN {holds} THEN {change(v)} ELSE {v} END"), "1")

    def strip(self, x: str, chars: str, ends: tuple[str, str] = ("^", "$")) -> str:
        """x without the characters of a class (inside of brackets) around it, looked at from its ends alone."""
        return f"trim(BOTH {_listed(chars)} FROM {x})"

    def strip_lines(self, x: str, chars: str) -> str:
        """x without the characters of a class, which holds no line feed, before line feeds and at the end."""
        return f"array_join(transform(split({x}, '\\n', -1), bare_l -> rtrim({_listed(chars)}, bare_l)), '\\n')"

    def when(self, cond: str, body: str, other: str = "false") -> str:
        """body, which is known to equal other wherever cond, a cheap test, doesn't hold: it isn't computed there."""
        return f"(CASE WHEN {cond} THEN {body} ELSE {other} END)"

    def wide(self, x: str, *words: str) -> str:
        """Whether x holds a character beyond ASCII, or any of the words (lower-case ASCII) in either case: a cheap test for use in `when`."""
        return f"(octet_length({x}) > length({x})" + "".join(f" OR contains(lower({x}), {self.text(w)})" for w in words) + ")"

    def han(self, x: str, *words: str) -> str:
        """As `wide`, of characters beyond the letters of Latin, Greek, Cyrillic and their like."""
        return f"({self.like(x, r'[\x{2e80}-\x{10ffff}]')}" + "".join(f" OR contains(lower({x}), {self.text(w)})" for w in words) + ")"

    def hinted(self, source: str, **columns: str) -> str:
        """source with columns that tell where costly patterns can't matter, for the conditions of `when` alone."""
        return f"SELECT *, {', '.join(f'{x} AS {k}' for k, x in columns.items())} FROM ({source}) h"

    def hint(self, name: str, x: str) -> str:
        """x under the name that `hinted` gave it."""
        return name

    def again(self, x: str, times: str, v: str, body: str) -> str:
        """x changed by body (of the name v) so many times."""
        return f"aggregate({self.range('1', times)}, {x}, ({v}, {v}_i) -> {body})"

    def seconds(self, ts: str) -> str:
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"

    def values(self, rows: list[tuple[str, ...]], columns: str) -> str:
        return f"(SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS v({columns}))"


class DuckDialect(SparkDialect):
    name = "duckdb"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def pattern(self, pattern: str) -> str:
        return self.text(pattern)

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.text(pattern)}))"

    def chars(self, x: str, chars: str) -> str:
        return self.count(x, f"[{chars}]")

    def sub(self, x: str, pattern: str, new: str = "") -> str:
        for n in "123456789":
            new = new.replace(f"${n}", f"\\{n}")
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(new)}, 'g')"

    def split(self, x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {self.text(pattern)})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def no_texts(self) -> str:
        return "[]::VARCHAR[]"

    def size(self, a: str) -> str:
        return f"len({a})::BIGINT"

    def at(self, a: str, i: str) -> str:
        return f"list_extract({a}, ({i})::INT)"

    def part(self, a: str, start: str, length: str) -> str:
        return f"list_slice({a}, ({start})::INT, ({start} + {length} - 1)::INT)"

    def map(self, a: str, x: str, body: str) -> str:
        return f"list_transform({a}, lambda {x}: {body})"

    def mapi(self, a: str, x: str, i: str, body: str) -> str:
        from_zero = re.sub(rf"(?<![\w.']){i}(?![\w'])", f"({i} - 1)", body)
        return f"list_transform({a}, lambda {x}, {i}: {from_zero})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"list_filter({a}, lambda {x}: {body})"

    def any(self, a: str, x: str, body: str) -> str:
        return f"(len(list_filter({a}, lambda {x}: {body})) > 0)"

    def range(self, lo: str, hi: str) -> str:
        return f"range(({lo})::BIGINT, ({hi})::BIGINT + 1)"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def max(self, a: str) -> str:
        return f"list_max({a})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def distinct(self, a: str) -> str:
        """In order of first occurrence, as Spark has it."""
        return f"list_transform(list_filter(list_transform({a}, lambda y, j: {{'v': y, 'first': list_position({a}, y) = j}}), lambda z: z.first), lambda z: z.v)"

    def join(self, a: str, by: str) -> str:
        return f"coalesce(array_to_string({a}, {self.text(by)}), '')"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def concat(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def last(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def fence(self, x: str) -> str:
        return x

    def explode(self, table: str, a: str, columns: str = "*") -> str:
        return f"SELECT * EXCLUDE (__a), __p - 1 AS pos, list_extract(__a, __p::INT) AS item FROM (SELECT {columns}, {a} AS __a, unnest(range(1, len({a}) + 1)) AS __p FROM {table})".replace("EXCLUDE (__a)", "EXCLUDE (__a, __p)")

    def gather(self, value: str, order: str) -> str:
        return f"list({value} ORDER BY {order})"

    def each(self, lo: str, hi: str) -> str:
        return f"unnest({self.range(lo, hi)})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def bytes(self, x: str) -> str:
        return f"strlen({x})"

    def string(self, x: str) -> str:
        return f"cast({x} as varchar)"

    def gather_over(self, x: str, window: str) -> str:
        return f"list_filter(list({x}) OVER {window}, lambda y: y IS NOT NULL)"

    def strip(self, x: str, chars: str, ends: tuple[str, str] = ("^", "$")) -> str:
        return self.sub(x, f"{ends[0]}[{chars}]+|[{chars}]+{ends[1]}")

    def strip_lines(self, x: str, chars: str) -> str:
        return self.sub(x, rf"[{chars}]+(\n|\z)", "$1")

    def when(self, cond: str, body: str, other: str = "false") -> str:
        return body

    def hinted(self, source: str, **columns: str) -> str:
        return source

    def hint(self, name: str, x: str) -> str:
        return x

    def again(self, x: str, times: str, v: str, body: str) -> str:
        return f"list_reduce(list_concat([{x}], list_transform(range({times}), lambda {v}_i: '')), lambda {v}, {v}_i: {body})"

    def seconds(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def values(self, rows: list[tuple[str, ...]], columns: str) -> str:
        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) AS v({columns}))"


SPARK, DUCK = SparkDialect(), DuckDialect()


def over(df: DataFrame, build: Callable[[Dialect, str], str]) -> DataFrame:
    """What the built SQL makes of df, which it reads under a name of its own, so that sessions with several threads don't mix."""
    name = f"docgate_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return df.sparkSession.sql(build(SPARK, name))
    finally:
        df.sparkSession.catalog.dropTempView(name)
