"""Quality rules: decision lists learned by sequential covering.

Statistics of a text are plain column expressions. From labelled documents
the learner grows one conjunction of thresholds at a time, adding the
condition that gains most until no good document is covered, prunes it on
documents held out, keeps it if it is precise there, and goes on with the
documents that no rule covers. The ordered rules become one Spark CASE
expression; a document that no rule rejects is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from changefold.llm.common import sheltered, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that the rules test: name, numerator, denominator.
RATIOS = (
    ("mean_word", "word_chars", "n_words"),
    ("symbol_share", "n_symbols", "word_chars"),
    ("mark_share", "n_marks", "word_chars"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("words_a_line", "n_words", "n_lines"),
)
FEATURES = ["n_words", *[name for name, _, _ in RATIOS]]
_P = "__quality_"


def _without(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, in one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(found: Column, window: int) -> Column:
    """Words in windows of ``window`` words that occur twice or more.

    Windows are hashed. Where all differ the answer is 0; else windows sorted
    by hash have their equals beside them, and the words that those windows
    cover are counted in order of place: n log n for any text."""
    none, first = F.lit(0).cast("long"), F.lit(1)

    def hashes(w):
        return F.transform(F.sequence(first, F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def rest(x):
        return F.slice(x, F.lit(2), F.size(x))

    def beside(s):  # does the next in order have the same hash?
        same = F.zip_with(s, rest(s), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
        return _let(same, lambda f: F.zip_with(f, F.concat(F.array(F.lit(False)), F.slice(f, first, F.size(f) - 1)), lambda x, y: x | y))

    def places(s):
        hit = F.zip_with(s, beside(s), lambda x, f: F.when(f, x["i"]))
        return F.array_sort(F.array_compact(hit))

    def covered(r):
        gaps = F.zip_with(r, rest(r), lambda x, y: F.least(F.lit(window), F.coalesce(y - x, F.lit(window))))
        return F.aggregate(gaps, none, lambda n, g: n + g)

    def counted(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h), _let(ordered, lambda s: _let(places(s), covered))
        ).otherwise(none)

    return _let(found, lambda w: F.when(F.size(w) > window, _let(hashes(w), counted)).otherwise(none))


def with_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` plus a column ``__quality_<name>`` for each statistic."""
    t = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(F.split(t, "\n"), lambda x: F.char_length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    p = docs.withColumns({f"{_P}w": words(F.col("text")), f"{_P}l": filled})
    w, lines = F.col(f"{_P}w"), F.col(f"{_P}l")
    p = p.withColumns(
        {
            f"{_P}n_words": F.size(w).cast("long"),
            f"{_P}word_chars": (F.char_length(t) - _without(t, " \t\n\x0b\f\r")).cast("long"),
            f"{_P}n_symbols": _without(t, "#*$%&|<>").cast("long"),
            f"{_P}n_marks": _without(t, "!?").cast("long"),
            f"{_P}n_upper": _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
            f"{_P}n_digits": _without(t, "0123456789").cast("long"),
            f"{_P}n_lines": F.size(lines).cast("long"),
            f"{_P}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{_P}n_distinct": F.size(F.array_distinct(w)).cast("long"),
            f"{_P}n_repeat_words": _repeated_words(w, window),
        }
    )
    ratios = {
        f"{_P}{name}": F.when(F.col(f"{_P}{d}") > 0, F.col(f"{_P}{n}") / F.col(f"{_P}{d}")).otherwise(F.lit(0.0))
        for name, n, d in RATIOS
    }
    return p.withColumns(ratios).drop(f"{_P}w", f"{_P}l")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"{_P}{self.feature}")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> Rule:
    rule: Rule = ()
    hit = np.ones(len(x), dtype=bool)
    while len(rule) < most:
        p0, n0 = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not n0 or not p0:
            break
        best, chosen = 1e-9, None
        for k, name in enumerate(FEATURES):
            # thresholds lie halfway between neighbouring values around the covered bad documents' quantiles
            values = np.unique(x[hit, k])
            if len(values) < 2:
                continue
            at = np.unique(np.searchsorted(values, np.quantile(x[hit & bad, k], np.linspace(0, 1, cuts))))
            mids = {float((values[i - 1] + values[i]) / 2) for j in at for i in (j, j + 1) if 0 < i < len(values)}
            for threshold in sorted(mids):
                for above in (True, False):
                    c = Condition(name, above, threshold)
                    h = hit & c.holds(x)
                    g = _gain(p0, n0, int((h & bad).sum()), int((h & ~bad).sum()))
                    if g > best:
                        best, chosen = g, c
        if chosen is None:
            break
        rule += (chosen,)
        hit &= chosen.holds(x)
    return rule


def learn_rules(
    x: np.ndarray, bad: np.ndarray, held: np.ndarray, most_rules: int = 12, most_conditions: int = 4,
    precision: float = 0.97, least: int = 3, cuts: int = 24,
) -> list[Rule]:
    """Rules in order. ``x``: [n, FEATURES]; ``bad``: to be rejected; ``held``:
    rows that prune rules and judge them, the others grow them."""
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and (left & bad & ~held).sum() >= least:
        rule = _grow(x[left & ~held], bad[left & ~held], most_conditions, cuts)

        def worth(r: Rule) -> tuple[float, int]:
            h = _covers(r, x[left & held])
            p, n = int((h & bad[left & held]).sum()), int((h & ~bad[left & held]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, -len(r))

        rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=worth, default=())
        if not rule:
            break
        h = _covers(rule, x) & left
        p, n = int((h & bad).sum()), int((h & ~bad).sum())
        ph, nh = int((h & bad & held).sum()), int((h & ~bad & held).sum())
        if p < least or p < precision * (p + n) or ph < precision * (ph + nh) or not ph:
            break
        rules.append(rule)
        left &= ~h
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> list[Rule]:
    """Learns from ``sample`` labelled documents (those of the least hashed
    doc_id, a documented bound); a third of them, by hash, is held out. Only
    their statistics come to the driver. Rows without a quality label, and
    labels of unknown documents, do not count; of several labels of one
    document the lowest counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__quality"))
    known = known.orderBy(F.xxhash64("__id", F.lit(5)), "__id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    rows = with_statistics(own).select(
        "doc_id", "__quality", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)).alias("__fold"), *[f"{_P}{f}" for f in FEATURES]
    ).collect()
    rows.sort(key=lambda r: tuple(r))
    x = np.array([[float(v) for v in r[3:]] for r in rows]).reshape(len(rows), len(FEATURES))
    return learn_rules(x, np.array([r[1] == 0 for r in rows], dtype=bool), np.array([r[2] == 0 for r in rows], dtype=bool), **options)


def verdict(rules: list[Rule]) -> Column:
    """True for documents that no rule rejects: one ordered CASE expression."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    n, r = F.col(f"{_P}n_words"), F.col(f"{_P}n_repeat_words")
    return (n < least_words) | (100 * r > most_repeated * n)


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """``docs`` plus ``__quality_*`` statistics, ``__quality_base_failed`` and
    ``__quality_kept``.

    Reads doc_id and text; other columns pass through whatever their names, but
    for one named like a column added, which gives way. Texts of any length are
    read whole. A null or empty text has no words and fails the base rules. Documents whose
    labels are missing are judged like any other. Without labels, or where no
    rule is precise enough, only the base rules reject. Equal rows are judged
    alike; an empty table gives no rows. The whole table is read once, without
    a shuffle."""
    rules = fit_rules(docs, labels, sample)
    inner, back = sheltered(docs, ("doc_id", "text"))
    out = _judged(inner, rules)
    return back(out, [c for c in out.columns if c.startswith(_P)])


def _judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    out = with_statistics(docs).withColumn(f"{_P}base_failed", base_failed())
    return out.withColumn(f"{_P}kept", ~F.col(f"{_P}base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps.

    The row number that the filter also reads keeps the optimizer from moving
    it below the statistics, where each of their layers would be written out
    again in place of every mention of its name."""
    row = f"{_P}row"
    inner, back = sheltered(docs, ("doc_id", "text"))
    judged = _judged(inner, fit_rules(docs, labels, sample)).withColumn(row, F.monotonically_increasing_id())
    return back(judged.where(F.col(f"{_P}kept") & (F.col(row) >= 0)))
