"""Quality rules: a learned decision list over text statistics (DataFrame functions only).

Base statistics come from built-in functions on whole texts.  Sequential
covering learns, from a bounded sample of labelled rows, an ordered list of
threshold conjunctions that mark poor texts: a rule grows by the condition with
the highest gain on two thirds of the sample, is pruned from its end on the
rest, and the rows that it covers are set aside before the next.  Thresholds
are quantiles of the sample; the search runs on counts of good and poor rows
for each cell of the quantile grid, which Spark aggregates.  The list becomes
one ordered CASE expression that Spark applies to every text.

``sample_rows`` bounds the labelled rows that train, chosen by a hash of the id.

Defined results
---------------
* Null text counts as empty: all statistics 0, base_failed true, kept false.
* With no labelled rows, or no rule that holds on the pruning part, the list is
  empty and every text that passes the base rule is kept.
* Labels other than 0 and 1, and null labels, do not train.  An id with labels
  that differ counts as poor.
* Repeated rows give equal results; an empty table gives an empty result.
* Further columns are ignored, whatever their names.
* Windows of words are compared by a 64-bit hash within their own text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, drawn, saved

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Statistic to its SQL over the base columns; a null value meets no condition.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "dup_lines_per_word": "n_dup_lines / nullif(n_words, 0)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
}

# `element_at(transform(array(v), x -> body), 1)` evaluates v once and names it x.
REPEATED = f"""
CASE WHEN size(_words) <= {WINDOW} THEN 0L ELSE
element_at(transform(array(
  transform(sequence(0, size(_words) - {WINDOW}), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
  element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
    element_at(transform(array(sort_array(transform(filter(s, (x, i) ->
        (i > 0 AND s[greatest(i - 1, 0)].h = x.h) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = x.h)), x -> x.i))), p ->
      aggregate(transform(p, (x, i) -> IF(i = size(p) - 1, {WINDOW}, least({WINDOW}, p[least(i + 1, size(p) - 1)] - x))), 0L, (a, x) -> a + x)), 1)), 1)
  END), 1)
END"""


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    keep = keep or []
    text = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("_row") if keep else F.lit(None).cast("int").alias("_row"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
    )
    parts = text.select(
        "_row", "_text",
        F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]")).alias("_lines"),
    )
    return parts.select(
        *[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(keep)],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED).cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _grow(codes: np.ndarray, poor: np.ndarray, good: np.ndarray, cuts: list[list[float]], most: int) -> list[tuple[int, bool, int]]:
    """Conditions (feature, above, cut) by highest gain, until no good row is covered."""
    on, rule = np.ones(len(poor), bool), []
    while len(rule) < most and (good[on].sum() or not rule):
        p0, n0, best = poor[on].sum(), good[on].sum(), (1e-9, None)
        for f, thresholds in enumerate(cuts):
            for c in range(len(thresholds)):
                above = on & (codes[:, f] > c)
                below = on & (codes[:, f] >= 0) & (codes[:, f] <= c)
                for side, mask in ((True, above), (False, below)):
                    p, n = poor[mask].sum(), good[mask].sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (f, side, c))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= _covers(codes, [best[1]])
    return rule


def _covers(codes: np.ndarray, rule: list[tuple[int, bool, int]]) -> np.ndarray:
    on = np.ones(len(codes), bool)
    for f, above, c in rule:
        on &= (codes[:, f] > c) if above else (codes[:, f] >= 0) & (codes[:, f] <= c)
    return on


def learn(stats: DataFrame, label_col: str = "quality", grid: int = 24, most_rules: int = 12, most_conditions: int = 3, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """The ordered rules for poor rows (label 0), from base statistics with a label and a column _part (0, 1: grow; 2: prune)."""
    names = list(FEATURES)
    rows = stats.filter(F.col(label_col).isin(0, 1)).select(F.col(label_col).alias("_label"), "_part", *[F.expr(sql).alias(n) for n, sql in FEATURES.items()])
    # Quantiles of the poor rows and of all rows: poor rows may be rare.
    shares = [i / grid for i in range(grid + 1)]
    poor = lambda n: F.when(F.col("_label") == 0, F.col(n))
    found = rows.agg(*[F.percentile_approx(n, shares, 2000).alias(n) for n in names], *[F.percentile_approx(poor(n), shares, 2000).alias(f"{n}_p") for n in names]).first()
    cuts = [sorted({*(found[n] or ()), *(found[f"{n}_p"] or ())}) for n in names]
    code = lambda n, at: F.when(F.col(n).isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(float(x)) for x in at]), lambda x: x <= F.col(n))) if at else F.lit(0))
    cells = rows.groupBy(*[code(n, at).alias(n) for n, at in zip(names, cuts, strict=True)], (F.col("_part") == 2).alias("_prune")).agg(
        F.sum(F.when(F.col("_label") == 0, 1).otherwise(0)).alias("poor"), F.sum(F.when(F.col("_label") == 1, 1).otherwise(0)).alias("good")
    ).collect()  # at most as many as the sample has rows
    table = np.array([[*(r[n] for n in names), r["_prune"], r["poor"], r["good"]] for r in cells], np.int64).reshape(len(cells), len(names) + 3)
    codes, prune, poor_n, good_n = table[:, : len(names)], table[:, -3] == 1, table[:, -2].copy(), table[:, -1].copy()
    rules: list[Rule] = []
    while len(rules) < most_rules and poor_n[~prune].sum() >= least:
        rule = _grow(codes[~prune], poor_n[~prune], good_n[~prune], cuts, most_conditions)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            on = _covers(codes[prune], rule[:k])
            p, n = poor_n[prune][on].sum(), good_n[prune][on].sum()
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        rule = rule[: -max(worth)[1]]
        on = _covers(codes, rule)
        p, n = poor_n[on].sum(), good_n[on].sum()
        if p < least or p < precision * (p + n):
            break
        # Code c + 1 and above is a value of at least threshold c.
        rules.append(tuple(Condition(names[f], above, float(cuts[f][c])) for f, above, c in rule))
        poor_n[on] = good_n[on] = 0
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: true if no rule covers the row."""
    cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE {cases} ELSE true END") if rules else F.lit(True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **options) -> list[Rule]:
    """Rules from at most about ``sample_rows`` labelled rows, whole texts."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    count = marked.count()
    if not count:
        return []
    sample = marked.filter(drawn("_id", "rules", sample_rows / count)).withColumn("_part", F.pmod(F.xxhash64("_id", F.lit("parts")), F.lit(3)))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(sample), "_id")
    stats = saved(statistics(texts, "_text", ["_label", "_part"]), "rules-sample")
    return learn(stats.filter(~base_failed()), "_label", **options)


def apply(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base statistics, base_failed, kept."""
    out = statistics(docs, text_col, [id_col]).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
