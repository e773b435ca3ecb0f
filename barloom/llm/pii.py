"""Personal data: fixed patterns, and candidates judged by boosted trees; JVM operations only.

Fixed patterns give the base spans. Generators propose further, overlapping candidates, also in disguised
forms: spaced, bracketed, or with other separators. Matches are exploded into small rows; their places
are running sums of the gaps before them, and overlaps are found with running maxima, so that a text with
hundreds of thousands of matches costs no more than its rows.

Each candidate has a few small features of its format and context, whose combinations form ``CELLS``
cells. The trees learn from plants, not from the patterns: every base span is disguised in one of three
ways, chosen by its hash, and set between the characters that stood around it; a decoy of like shape (a
wrong check digit, a part beyond 255, a date) is a negative, and so is each candidate of the corpus that
touches no base span. Spark sums positives and all by cell and by fold (a hash of the value);
gradient-boosted trees are fitted to the first fold's counts on the driver (a table of at most
``2 * CELLS`` rows, whatever the corpus), and each kind's threshold is calibrated on the second fold to a
precision of ``PRECISION``. Selected cells go back into the plan as a literal; their candidates are added
where no base span overlaps, those of one kind that overlap one another merged.

Patterns are possessive where nothing that follows could match less, so that the JVM's matcher neither
recurses nor backtracks on long runs; the spans are those of the plain greedy patterns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Least precision, on the fold that calibrates, of the cells that are selected.
PRECISION = 0.9
ROUNDS, STEP, DEPTH = 40, 0.3, 3

# The previous match's end counts as a start, for a span may begin where another ends.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs cannot stay
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": (_LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _LOCAL + r"(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?\.\x20?|\x20?[(\[](?:\.|dot)[)\]]\x20?)[0-9]{1,3}){3}(?![0-9])"),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": (r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"(?<![0-9])(?:00|\()?[0-9][\x20().0-9-]{7,16}[0-9](?![0-9])"),
}
#: Texts without these cannot match, and are not searched.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\x20?[(\[]?(?:\.|dot)[)\]]?\x20?[0-9]", "card": r"[0-9](?:[\x20./_-]{0,2}[0-9]){12}", "phone": r"\+[0-9]|[0-9][\x20().0-9-]{7}"}
CONTEXT = r"(?i)mail|contact|phone|tel|call|fax|mobile|card|visa|master|credit|pay|ip\b|host|server|addr"
#: Features and how many values each has.
FEATURES = (("kind", 4), ("form", 4), ("valid", 2), ("digits", 4), ("before", 4), ("after", 4), ("context", 2))
CELLS = int(np.prod([n for _, n in FEATURES]))
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def matches(text: Column, pattern: str, tag: int) -> Column:
    """array<struct<tag, pos, gap, value, before, after>> of leftmost non-overlapping matches, in order.

    gap is the number of characters since the match before; before and after are the characters around,
    up to the matches next to it.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next"), values.alias("value"))

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(tag).alias("tag"), i.alias("pos"), F.char_length(x["gap"]).alias("gap"), x["value"].alias("value"),
            F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"),
        )

    return F.transform(F.filter(rows, lambda x: x["value"].isNotNull()), one)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of ten."""
    places = F.sequence(F.lit(1), F.char_length(digits))
    at = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    double = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, double(at(i))).otherwise(at(i))) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """What a base match of ``kind`` (a number) must meet to stay; disguises count as what they hide."""
    n = F.char_length(_digits(value))
    plain = F.regexp_replace(F.regexp_replace(value, r"[\[(](?:\.|dot)[\])]", "."), r"\x20", "")
    return (
        F.when(kind == 1, plain.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == 2, F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False))
        .when(kind == 3, n.between(9, 15))
        .otherwise(True)
    )


def _around(c: Column) -> Column:
    """0 for the text's end or a span, 1 white space, 2 a letter or digit, 3 another sign."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(3)


def cell(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """A candidate's cell: its features as one number, the last feature varying fastest."""
    n = F.char_length(_digits(value))
    parts = [
        kind,
        F.when(value.rlike(r"[\[(](?:at|dot|\.|[0-9]{2,4})[\])]|^00"), 2).when(value.contains(" "), 1).when(value.rlike("[/_]") | ((kind == 3) & value.contains(".")), 3).otherwise(0),
        valid(kind, value).cast("int"),
        F.when(n < 9, 0).when(n <= 12, 1).when(n <= 15, 2).otherwise(3),
        _around(F.right(before, F.lit(1))), _around(after), before.rlike(CONTEXT).cast("int"),
    ]
    out = F.lit(0)
    for p, (_, size) in zip(parts, FEATURES, strict=True):
        out = out * size + p
    return out


def _searched(text: Column, patterns: list[tuple[int, str, str]]) -> Column:
    """Matches of (tag, pattern, need), one after the other."""
    none = F.array().cast("array<struct<tag:int,pos:int,gap:int,value:string,before:string,after:string>>")
    return F.concat(*(F.when(text.rlike(need), matches(text, pattern, tag)).otherwise(none) for tag, pattern, need in patterns))


def _all_patterns() -> list[tuple[int, str, str]]:
    """Tag 3 * kind for the base pattern, and the next two numbers for its candidates."""
    return [(3 * k + j, p, NEEDS[kind]) for k, kind in enumerate(KINDS) for j, p in enumerate((BASE[kind], *CANDIDATES[kind]))]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) of each row of ``docs``, and its spans (rid, kind, base, start, end, value, before, after, cell, free).

    base marks base spans that stay; the others are candidates, and free those that overlap no base span. start and end are code points.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = materialize(slim.select("rid", "doc_id", _searched(F.col("text"), _all_patterns()).alias("m")), "pii-matches")
    each = found.select("rid", F.inline("m")).repartition("rid")
    size = F.char_length("value")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy("rid", "tag").orderBy("pos")).cast("int")
    kind = F.floor(F.col("tag") / 3).cast("int")
    each = each.withColumn("end", end).withColumns({"start": F.col("end") - size, "kind": kind, "base": F.col("tag") % 3 == 0})
    each = each.where(~F.col("base") | valid(F.col("kind"), F.col("value")))
    # A base span that starts no later overlaps if it ends after the candidate's start, one that starts later if before its end.
    kinds = Window.partitionBy("rid")
    last = F.max(F.when(F.col("base"), F.col("end"))).over(kinds.orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(kinds.orderBy(F.desc("start"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0))
    free = ~F.col("base") & ~F.coalesce(last > F.col("start"), F.lit(False)) & ~F.coalesce(following < F.col("end"), F.lit(False))
    rows = each.select("rid", "kind", "base", "start", "end", "value", "before", "after", F.when(~F.col("base"), cell(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))).alias("cell"), free.alias("free"))
    return found.select("rid", "doc_id"), materialize(rows, "pii-spans")


def _grouped(digits: Column, sign: str) -> Column:
    """Digits in groups of four."""
    return F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", rf"$1{sign}")


def plants(found: DataFrame) -> DataFrame:
    """(kind, fold, planted, value, before, after): a disguised copy and a decoy of each base span of ``spans``'s rows."""
    v, x = F.col("value"), _digits(F.col("value"))
    way = F.pmod(F.xxhash64("value", "start"), F.lit(3))
    local, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)

    def pick(*ways: Column) -> Column:
        return F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])

    def dotted(c: Column) -> Column:
        return pick(F.replace(c, F.lit("."), F.lit(" . ")), F.replace(c, F.lit("."), F.lit("[.]")), F.replace(c, F.lit("."), F.lit("(dot)")))

    wrong = F.concat(F.left(x, F.char_length(x) - 1), ((F.right(x, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    hidden = (
        F.when(F.col("kind") == 0, pick(F.concat(local, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))), F.concat(local, F.lit("[at]"), F.replace(host, F.lit("."), F.lit("[dot]"))), F.concat(local, F.lit(" @ "), host)))
        .when(F.col("kind") == 1, dotted(v))
        .when(F.col("kind") == 2, pick(_grouped(x, "."), _grouped(x, "  "), _grouped(x, "/")))
        .otherwise(pick(F.concat(F.lit("00"), x), F.regexp_replace(v, r"^\+", ""), F.regexp_replace(x, r"([0-9]{3})(?=[0-9]{3})", "$1.")))
    )
    decoy = (
        F.when(F.col("kind") == 1, dotted(F.regexp_replace(v, "^[0-9]+", "999")))
        .when(F.col("kind") == 2, pick(_grouped(wrong, "."), wrong, _grouped(wrong, " ")))
        .when(F.col("kind") == 3, F.concat_ws("-", F.lit("2024"), F.substring(x, 1, 2), F.concat(F.substring(x, 3, 2), F.lit(" "), F.substring(x, 5, 2))))
    )
    both = F.explode(F.array(F.struct(F.lit(True).alias("planted"), hidden.alias("value")), F.struct(F.lit(False).alias("planted"), decoy.alias("value"))))
    base = found.where("base").select("kind", F.xxhash64("value").bitwiseAND(1).cast("int").alias("fold"), "before", "after", both.alias("p"))
    return base.select("kind", "fold", "p.planted", "p.value", "before", "after").where("value is not null")


def judged(found: DataFrame) -> DataFrame:
    """(fold, cell, n, hit): candidates and positives in each cell; cell is -1 - kind for plants that no generator finds."""
    made = plants(found)
    parts = []
    for k, kind in enumerate(KINDS):
        snippet = F.concat("before", "value", "after")
        got = made.where(F.col("kind") == k).withColumn("m", _searched(snippet, [(j, p, NEEDS[kind]) for j, p in enumerate(CANDIDATES[kind])]))
        whole = F.filter("m", lambda m: m["value"] == F.col("value"))
        at = cell(F.lit(k), F.col("value"), F.element_at(whole, 1)["before"], F.element_at(whole, 1)["after"])
        parts.append(got.select("fold", F.when(F.size(whole) > 0, at).otherwise(-1 - k).alias("cell"), F.col("planted").cast("long").alias("hit")))
    corpus = found.where("free").select(F.xxhash64("value").bitwiseAND(1).cast("int").alias("fold"), "cell", F.lit(0).cast("long").alias("hit"))
    rows = corpus
    for p in parts:
        rows = rows.unionAll(p)
    return rows.groupBy("fold", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hit"))


def _indicators() -> np.ndarray:
    """For each cell, which value each feature has: one column for each feature and value."""
    at, cols = np.arange(CELLS), []
    for _, size in reversed(FEATURES):
        cols[:0] = [at % size == v for v in range(size)]
        at = at // size
    return np.column_stack(cols)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A regression tree's value for each row: Newton leaves, splits by gain."""
    score = lambda g, h: g * g / (h + 1.0)
    if depth:
        gl, hl = x.T @ g, x.T @ h
        gain = score(gl, hl) + score(g.sum() - gl, h.sum() - hl) - score(g.sum(), h.sum())
        best = int(gain.argmax())
        if gain[best] > 1e-6:
            out, side = np.empty(len(g)), x[:, best]
            for s in (side, ~side):
                out[s] = _tree(x[s], g[s], h[s], depth - 1)
            return out
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def boost(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each cell's probability, from boosted trees fitted to its counts under logistic loss."""
    x, f = _indicators(), np.zeros(CELLS)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        f += STEP * _tree(x, positive - total * p, total * p * (1 - p), DEPTH)
    return 1 / (1 + np.exp(-f))


def select_cells(counts: np.ndarray, precision: float = PRECISION) -> list[int]:
    """Cells that are selected; counts: (fold, cell, [all, positive])."""
    score = boost(counts[0, :, 1], counts[0, :, 0])
    kind, out = np.arange(CELLS) // (CELLS // len(KINDS)), []
    for k in range(len(KINDS)):
        cells = np.flatnonzero((kind == k) & (counts.sum(axis=0)[:, 0] > 0))
        cells = cells[np.argsort(-score[cells], kind="stable")]
        n, hit = counts[1, cells, 0].cumsum(), counts[1, cells, 1].cumsum()
        good = np.flatnonzero((hit >= precision * n) & (n > 0) & (score[cells] >= 0.5))
        if len(good):
            least = score[cells[good[-1]]]
            out += [int(c) for c in cells if score[c] >= least]
    return out


def train(found: DataFrame) -> tuple[list[int], dict[str, tuple[float, float]]]:
    """Selected cells, and each kind's (recall, precision) on the second fold, whose plants the trees did not see.

    Plants that no generator finds count as lost. Kinds without plants there are left out.
    """
    counts, lost = np.zeros((2, CELLS, 2)), np.zeros(len(KINDS))
    for r in judged(found).collect():
        if r["cell"] >= 0:
            counts[r["fold"], r["cell"]] = r["n"], r["hit"]
        elif r["fold"]:
            lost[-1 - r["cell"]] += r["hit"]
    cells = select_cells(counts)
    mine, kind, held = np.zeros(CELLS, bool), np.arange(CELLS) // (CELLS // len(KINDS)), {}
    mine[cells] = True
    for k, name in enumerate(KINDS):
        n, hit = counts[1][mine & (kind == k)].sum(axis=0)
        every = counts[1][kind == k][:, 1].sum() + lost[k]
        if every:
            held[name] = float(hit / every), float(hit / n) if n else 1.0
    return cells, held


def written(c: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for each row of ``docs``; null as empty.

    The n are base spans; base and spans are texts of ``written``, the latter with the trees' spans. Added
    candidates of one kind that overlap are merged. Repeated rows, and rows of one id, are judged each by
    itself. An empty table gives no rows; other columns are not read.
    """
    rows, found = spans(docs, id_col, text_col)
    cells, _ = train(found)
    chosen = found.where("free").where(F.col("cell").isin(cells) if cells else F.lit(False)).select("rid", "kind", "start", "end")
    order = Window.partitionBy("rid", "kind").orderBy("start", "end")
    apart = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    chosen = chosen.withColumn("run", F.when(apart, F.col("start"))).withColumn("run", F.max("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    added = chosen.groupBy("rid", "kind", "run").agg(F.max("end").alias("end")).select("rid", "kind", F.col("run").alias("start"), "end", F.lit(False).alias("base"))
    every = found.where("base").select("rid", "kind", "start", "end", "base").unionAll(added)
    one = F.struct("kind", "start", "end")
    counts = [F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    texts = every.groupBy("rid").agg(*counts, written(F.collect_list(F.when(F.col("base"), one))).alias("base"), written(F.collect_list(one)).alias("spans"))
    out = rows.join(texts, "rid", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))
