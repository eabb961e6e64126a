"""Personal data by candidates and gradient boosting, in DataFrame operations alone.

Generators of high recall propose spans, which may overlap: the four base patterns and looser ones (addresses written
around an @, runs of digits that a longer match swallows, numbers without a country code). A base match that passes its
rule is personal data as it stands. Whether a proposed span is, although no rule says so, is told by boosted trees from
its format (digits, letters, separators, first digit and run) and its context (the characters and words around it).

The trees learn from the corpus itself: a candidate counts as true if its own rule holds or it lies in a base span of
its kind, and neither the rules' outcomes nor what they test beyond the format (checksum, parts, country code) are
features. So the trees learn which formats and contexts valid data have, and find what is written like it: a card
number that runs into another one, a phone number without its country code. All candidates of all documents are summed
up into cells of equal features before a tree is grown; a level of a tree is one aggregate over cells (sums of gradients
by leaf, feature and value), of which the driver gets a row for each of these, whatever the table. Trees are symmetric:
a level asks all leaves the same question, so a tree is a lookup in a short list, in plain expressions.

A quarter of the candidates, by a hash of what is matched, is kept from the trees. On it two thresholds are set for each
kind: the least score at which enough held-out candidates were true (a share that never falls as the score rises; the
score itself counts as `SUPPORT` candidates, and a kind needs as many). Enough is `PRECISION` for a
candidate that fails its rule. One that passes it needs less: if a share `CHANCE` of other matches passes too (a tenth
for Luhn's check), the share of true ones among those that pass is `PRECISION` as soon as c / (1 - PRECISION (1 - c))
pass. Without such a score the kind gets no spans beyond the base.

Defined results: a null text counts as empty and has no spans; repeated rows (and ids) get spans each; spans of equal
kind and place are given once; a span within a base span adds nothing and goes; without candidates of both outcomes no
tree is grown; an empty table gives an empty result. Texts of any length are scanned whole. Other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgate.llm.common import written

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive, and from a run's start or behind a match only, they find what the plain
#: ones find (`[A-Za-z0-9._%+-]+@...`, `[0-9]+(\.[0-9]+)...`, `[0-9]([\x20-]?[0-9])+`), in time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser generators.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[{](?i:at)[)\]}]\x20?|\x20?@\x20?)[A-Za-z0-9-]++(?:(?:\x20?[(\[{](?i:dot)[)\]}]\x20?|\.)[A-Za-z0-9-]++)*+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
#: What a text must hold before a kind's patterns are tried.
HOLDS = {"email": r"@|[(\[{](?i:at)[)\]}]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|[0-9][)\x20.-]"}
#: Words near personal data of a kind.
NEAR = {"email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b", "ip": r"(?i)\b(?:ip|host|server|address|client|login)\b", "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pay)\b", "phone": r"(?i)\b(?:phone|tel|telephone|mobile|call|fax|cell)\b"}
#: Code points of context on either side.
LEFT, RIGHT = 40, 12
TREES, DEPTH, RATE, RIDGE = 12, 3, 0.4, 1.0
PRECISION, SUPPORT, BINS = 0.9, 20, 40
#: The share of matches of a kind that pass its rule by chance.
CHANCE = {"email": 0.0, "ip": 0.0, "card": 0.1, "phone": 0.0}
FEATURES = ("kind", "digits", "letters", "marks", "first_digit", "first_run", "char_before", "char_after", "word_near", "number_before")


def _matches(text: Column, generator: int, pattern: str, kind: str) -> Column:
    """A pattern's matches in their order, each with what stands before it since the last one."""
    regex = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    found = F.transform(
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda m, k: F.struct(
            F.lit(generator).alias("generator"), k.alias("k"), F.length(F.get(gaps, k)).alias("gap"), m.alias("match"),
            F.right(F.get(gaps, k), F.lit(LEFT)).alias("before"), F.left(F.coalesce(F.get(gaps, k + 1), F.lit("")), F.lit(RIGHT)).alias("after"),
        ),
    )
    none = F.array().cast("array<struct<generator:int,k:int,gap:int,match:string,before:string,after:string>>")
    return F.when(F.regexp_like(text, F.lit(HOLDS[kind])) & F.regexp_like(text, regex), found).otherwise(none)


def _generators() -> list[tuple[str, str, bool]]:
    return [*((kind, BASE[kind], True) for kind in KINDS), *((kind, pattern, False) for kind, pattern in LOOSE)]


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass Luhn's check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(places, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """Whether a match passes its kind's rule."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
    return (
        F.when(kind == "email", match.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))
        .when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when((count >= 13) & (count <= 19), _luhn(digits)).otherwise(False))
        .otherwise(match.startswith("+") & (count >= 9) & (count <= 15))
    )


def _sort_of(char: Column) -> Column:
    """A character's sort: none, white space, letter, digit, opening or closing mark, anything else."""
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"\p{L}"), 2).when(char.rlike("[0-9]"), 3).when(char.rlike(r"""[(\[{<"']"""), 4).when(char.rlike(r"[.,;:!?)\]}>]"), 5).otherwise(6)


def _features(match: Column, kind: Column, before: Column, after: Column) -> list[Column]:
    count = lambda pattern, most: F.least(F.length(F.regexp_replace(match, pattern, "")), F.lit(most))
    unsigned = F.regexp_replace(match, r"^\+", "")
    first = F.regexp_extract(match, "[0-9]+", 0)
    rank, near = F.lit(0), F.lit(False)
    for k, name in enumerate(KINDS):
        rank, near = F.when(kind == name, k).otherwise(rank), F.when(kind == name, before.rlike(NEAR[name])).otherwise(near)
    values = (
        rank, count("[^0-9]", 20), count(r"[^\p{L}]", 10), F.least(F.length(F.regexp_replace(unsigned, r"[\p{L}0-9]", "")), F.lit(8)), F.when(first == "", 10).otherwise(F.left(first, F.lit(1)).cast("int")),
        F.least(F.length(first), F.lit(20)), _sort_of(F.right(before, F.lit(1))), _sort_of(F.left(after, F.lit(1))), near.cast("int"), before.rlike(r"[0-9][\s.,-]?$").cast("int"),
    )
    return [v.cast("int").alias(name) for name, v in zip(FEATURES, values, strict=True)]


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id[, text]) of all rows, and (row, kind, start, end, base, holds, within, true, match, features) of each candidate, both written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_matches(text, g, pattern, kind) for g, (kind, pattern, _) in enumerate(_generators())))
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), *([text.alias("text")] if keep_text else []), found.alias("found")), "personal-matches")
    each = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    upto = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "generator").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    kinds = F.array(*(F.lit(kind) for kind, _, _ in _generators()))
    bases = F.array(*(F.lit(is_base) for _, _, is_base in _generators()))
    placed = each.withColumn("end", upto).withColumn("start", F.col("end") - F.length("match")).withColumn("kind", F.get(kinds, F.col("generator")))
    placed = placed.withColumn("holds", _holds(F.col("kind"), F.col("match"))).withColumn("base", F.get(bases, F.col("generator")) & F.col("holds"))
    # the furthest end of base spans that begin here or before: a span that ends there or before lies in one
    covers = F.max(F.when(F.col("base"), F.col("end"))).over(Window.partitionBy("row", "kind").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    judged = placed.withColumn("within", F.coalesce(covers >= F.col("end"), F.lit(False)))
    features = _features(F.col("match"), F.col("kind"), F.col("before"), F.col("after"))
    given = [F.col("row"), F.col("kind").alias("of_kind"), "start", "end", "base", "holds", "within", (F.col("holds") | F.col("within")).alias("true"), "match"]
    return rows.drop("found"), written(judged.select(*given, *features), "personal-candidates")


@dataclass
class Model:
    """Symmetric trees: for each, its questions (feature, value: is it larger?) and a value for each combination of answers; thresholds for each kind, for candidates that pass their rule and for those that fail it."""

    prior: float = 0.0
    trees: list[tuple[list[tuple[str, int]], list[float]]] = field(default_factory=list)
    passing: dict[str, float] = field(default_factory=dict)
    failing: dict[str, float] = field(default_factory=dict)

    def margin(self) -> Column:
        total = F.lit(self.prior)
        for questions, values in self.trees:
            total = total + F.get(F.array(*map(F.lit, values)), leaf(questions))
        return total

    def selects(self, kind: Column, holds: Column) -> Column:
        least = F.lit(math.inf)
        for outcome, thresholds in ((True, self.passing), (False, self.failing)):
            for name, value in thresholds.items():
                least = F.when((kind == name) & (holds == outcome), value).otherwise(least)
        return self.margin() >= least


def leaf(questions: list[tuple[str, int]]) -> Column:
    return sum((F.when(F.col(name) > value, 1 << level).otherwise(0) for level, (name, value) in enumerate(questions)), F.lit(0))


def calibrated(bins: dict[int, tuple[int, int]], support: int = SUPPORT) -> list[float]:
    """The share of true candidates at each bin of scores, never falling from the lowest on. bins: (number, true ones) held out; a bin's own score counts as `support` more of them."""
    pooled: list[list[float]] = []
    for at in range(BINS):
        n, pos = bins.get(at, (0, 0))
        pooled.append([n + support, pos + support * (at + 0.5) / BINS, 1])
        while len(pooled) > 1 and pooled[-1][1] * pooled[-2][0] <= pooled[-2][1] * pooled[-1][0]:
            n, pos, width = pooled.pop()
            pooled[-1] = [pooled[-1][0] + n, pooled[-1][1] + pos, pooled[-1][2] + width]
    return [pos / n for n, pos, width in pooled for _ in range(width)]


def fit(found: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION, support: int = SUPPORT) -> Model:
    """Boosted trees over all candidates but a quarter, and thresholds from that quarter."""
    held = F.pmod(F.xxhash64("match"), F.lit(4)) == 3
    cells = written(found.groupBy(held.alias("held"), *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("true").cast("long")).alias("pos")), "personal-cells")
    learn = cells.filter("not held")
    n, pos = learn.agg(F.sum("n"), F.sum("pos")).first()
    if not n or not 0 < pos < n:
        return Model()
    model = Model(math.log(pos / (n - pos)))
    for _ in range(trees):
        questions: list[tuple[str, int]] = []
        values: list[float] = []
        p = 1 / (1 + F.exp(-model.margin()))
        slopes = learn.select(*FEATURES, (F.col("pos") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        for _ in range(depth):
            each = slopes.select(leaf(questions).alias("leaf"), "g", "h", F.posexplode(F.array(*FEATURES)).alias("feature", "value"))
            sums = each.groupBy("leaf", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # leaves x features x values, at most 8 x 10 x 21
            by: dict[int, dict[int, dict[int, tuple[float, float]]]] = defaultdict(lambda: defaultdict(dict))
            for r in sums:
                by[r.feature][r.leaf][r.value] = (r.g, r.h)
            best = None
            for feature, leaves in sorted(by.items()):
                for cut in sorted({v for of in leaves.values() for v in of})[:-1]:
                    gain, parts = 0.0, {}
                    for at, of in leaves.items():
                        for side in (0, 1):
                            g = sum(x for v, (x, _) in of.items() if (v > cut) == side)
                            h = sum(y for v, (_, y) in of.items() if (v > cut) == side)
                            gain += g * g / (h + RIDGE)
                            parts[at + (side << len(questions))] = round(RATE * g / (h + RIDGE), 9)  # sums differ in their last digits from run to run
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, (FEATURES[feature], cut), parts
            if best is None:
                break
            questions.append(best[1])
            values = [best[2].get(k, 0.0) for k in range(1 << len(questions))]
        if not questions:
            break
        model.trees.append((questions, values))
    share = F.floor(1 / (1 + F.exp(-model.margin())) * BINS).cast("int")
    held_out = cells.filter("held").groupBy("kind", F.least(share, F.lit(BINS - 1)).alias("bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    for k, kind in enumerate(KINDS):
        bins = {r.bin: (r.n, r.pos) for r in held_out if r.kind == k}
        if sum(n for n, _ in bins.values()) < support:
            continue
        needs = CHANCE[kind] / (1 - precision * (1 - CHANCE[kind]))
        for at, true in reversed(list(enumerate(calibrated(bins, support)))):
            score = math.log(at / (BINS - at)) if at else -math.inf
            if true >= precision:
                model.failing[kind] = score
            if true >= needs:
                model.passing[kind] = score
    return model


def spans(found: DataFrame, model: Model) -> DataFrame:
    """(row, kind, start, end, base, score) of base spans, and of those that the model adds to them."""
    score = 1 / (1 + F.exp(-model.margin()))
    chosen = found.filter(F.col("base") | ~F.col("within") & model.selects(F.col("of_kind"), F.col("holds")))
    return chosen.groupBy("row", F.col("of_kind").alias("kind"), "start", "end").agg(F.max("base").alias("base"), F.max(score).alias("score"))


SPAN = "array<struct<rank:int,start:int,end:int,kind:string,base:boolean,score:double>>"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id[, text], spans (by kind as listed, then place). A model is fitted to the candidates of df unless one is given."""
    rows, found = candidates(df, id_col, text_col, keep_text)
    kept = spans(found, model or fit(found))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    of_row = kept.groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base", "score"))).alias("spans"))
    joined = rows.join(of_row, F.col("row") == F.col("__row"), "left")
    return joined.select("doc_id", *(["text"] if keep_text else []), F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, spans, and text with each span (what overlaps is one) replaced by its kind in brackets."""
    start = lambda state: F.struct(state["at"].alias("at"), state["out"].alias("out"))
    text = F.col("text")
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("behind"), s["kind"].alias("kind"))))
    done = F.aggregate(
        by_place,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(-x["behind"] <= s["at"], start(s)).otherwise(
            F.struct((-x["behind"]).alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.when(x["start"] >= s["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")).alias("out"))
        ),
    )
    return find(df, id_col, text_col, True, model).select("doc_id", "spans", F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))).alias("text"))


def said(column: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda x: x["kind"] == kind


def report(found: DataFrame) -> DataFrame:
    """Of rows with spans: doc_id, the number of base spans of each kind, the SHA-256 of the joined base spans, and all spans."""
    base = F.filter("spans", lambda x: x["base"])
    return found.select("doc_id", *(F.size(F.filter(base, _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
