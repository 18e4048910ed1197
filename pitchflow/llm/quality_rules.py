"""Quality rules: base statistics of a text and a decision list learned over them, all in Spark expressions.

The list is learned by sequential covering on labelled rows: each rule is a conjunction of thresholds
that grows by information gain on two thirds of them, is pruned on the rest, and stands if it is
precise there; the rows it covers are then set aside. Each step is one grouped count over the labelled
rows, whatever their number. The list becomes an ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

WORD, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
SHINGLE = 5
BINS, MAX_RULES, MAX_CONDITIONS = 24, 8, 3
#: A rule stands if it covers so many rows that were kept apart, and so much of what it covers there is bad.
MIN_COVER, MIN_PRECISION = 5, 0.97
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "uppers": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts of each whole text: n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words, n_upper (A-Z) and n_marks (``!`` and ``?``). A null text has none of anything."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        *(F.regexp_count(text, F.lit(p)).cast("bigint").alias(n) for n, p in (("n_symbols", SYMBOLS), ("n_upper", "[A-Z]"), ("n_marks", "[!?]"))),
    )
    count = F.size("words")
    window = lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(SHINGLE)))
    none = F.array().cast("array<bigint>")
    two = one.select(
        "doc_id", "n_symbols", "n_upper", "n_marks",
        count.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(count >= SHINGLE, F.transform(F.sequence(F.lit(0), count - SHINGLE), window)).otherwise(none).alias("grams"),
    )
    pairs = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = two.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), pairs)).drop("grams")
    again = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    four = three.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("sorted")
    step = F.zip_with(F.slice("starts", 1, F.size("starts") - 1), F.slice("starts", 2, F.size("starts") - 1), lambda a, b: F.least(F.lit(SHINGLE), b - a))
    covered = F.when(F.size("starts") > 0, F.aggregate(step, F.lit(SHINGLE).cast("bigint"), lambda s, x: s + x)).otherwise(F.lit(0).cast("bigint"))
    return four.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"), "n_upper", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _features(stats: DataFrame) -> DataFrame:
    ratios = [F.coalesce(F.try_divide(1000.0 * F.col(a), F.col(b)), F.lit(0.0)).alias(n) for n, (a, b) in RATIOS.items()]
    return stats.select("*", *ratios)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _any(rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a | b, map(_all, rules), F.lit(False))


def learn_decision_list(labelled: DataFrame) -> list[Rule]:
    """Rules for bad rows from ``labelled``: the statistics, ``doc_id`` and ``bad`` (boolean). Null labels are left out.

    No row, or no bad row, gives an empty list.
    """
    rows = _features(labelled.filter("bad IS NOT NULL")).select("bad", *RATIOS, (F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(3)) == 0).alias("apart"))
    quantiles = [k / BINS for k in range(1, BINS)]
    cuts = rows.groupBy("bad").agg(*(F.percentile_approx(c, quantiles, 2000).alias(c) for c in RATIOS)).collect()
    if not any(r["bad"] for r in cuts):
        return []
    cuts = {c: sorted({x for r in cuts for x in r[c]}) for c in RATIOS}
    names = list(RATIOS)
    place = lambda c: F.aggregate(F.array(*map(F.lit, cuts[c])), F.lit(0), lambda s, t: s + (F.col(c) > t).cast("int"))
    table = Table(rows.select("*", F.array(*map(place, names)).alias("bins")), "labelled")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = table.df.filter(~_any(rules))
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            cell = left.filter(~F.col("apart") & _all(rule)).select("bad", F.posexplode("bins").alias("k", "bin")).groupBy("k", "bin", "bad").count().collect()
            best = _best_condition({(r["k"], r["bin"], r["bad"]): r["count"] for r in cell}, names, cuts)
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        tally = left.filter("apart").agg(*(F.count_if(_all(rule[: k + 1]) & (F.col("bad") == b)).alias(f"{'pn'[not b]}{k}") for k in range(len(rule)) for b in (True, False))).first()
        scored = [((tally[f"p{k}"] - tally[f"n{k}"]) / max(1, tally[f"p{k}"] + tally[f"n{k}"]), -k) for k in range(len(rule))]
        k = -max(scored)[1]
        if tally[f"p{k}"] < MIN_COVER or tally[f"p{k}"] < MIN_PRECISION * (tally[f"p{k}"] + tally[f"n{k}"]):
            break
        rules.append(rule[: k + 1])
    table.drop()
    return rules


def _best_condition(cells: dict, names: list[str], cuts: dict[str, list[float]]) -> Condition | None:
    """The threshold with the most information gain for the bad rows; None if nothing gains."""
    p_all, n_all = (sum(v for (k, _, b), v in cells.items() if k == 0 and b is bad) for bad in (True, False))
    if not p_all or not n_all:
        return None
    before, best = math.log2(p_all / (p_all + n_all)), (1e-9, None)
    for k, name in enumerate(names):
        p = n = 0
        for bin_, threshold in enumerate(cuts[name]):
            p, n = p + cells.get((k, bin_, True), 0), n + cells.get((k, bin_, False), 0)
            for above, (a, b) in ((False, (p, n)), (True, (p_all - p, n_all - n))):
                if a:
                    gain = a * (math.log2(a / (a + b)) - before)
                    if gain > best[0]:
                        best = (gain, Condition(name, above, threshold))
    return best[1]


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (number of the first rule that holds, or null) and ``kept`` of each row.

    ``labels`` has ``doc_id`` and ``quality`` (0 is bad); labels that are null, or of no document, are left out.

    * A null, empty or blank text has no words, fails the base rules and isn't kept.
    * A row that passes the base rules is kept unless a rule of the list holds.
    * Repeated rows are judged alike and learned from once; of labels of one id that disagree the best holds.
      Rows with a null id are judged but not learned from.
    * A text may have any length; other columns than the two named aren't read.
    * Without labels the list is empty; an empty table gives an empty result.
    """
    stats = Table(text_statistics(docs, id_col, text_col), "statistics")
    bad = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    rules = learn_decision_list(stats.df.join(bad, "doc_id").dropDuplicates(["doc_id", *stats.df.columns]))
    number = F.coalesce(*(F.when(_all(r), F.lit(i)) for i, r in enumerate(rules)), F.lit(None).cast("int"))
    judged = _features(stats.df).withColumns({"base_failed": base_failed(), "rule": number})
    return judged.withColumn("kept", F.when(F.col("base_failed"), False).when(F.col("rule").isNotNull(), False).otherwise(True))
