"""Quality rules with risk-controlled thresholds.

Word statistics of whole texts feed a fixed base rule and a set of cutoff rules. The cutoff of a rule is chosen per
stratum on labelled documents: cutoffs are tried from the most lenient to the strictest, and a cutoff is accepted
while the exact binomial upper bound on the share of good documents it rejects stays within the rule's budget. Of the
accepted cutoffs the one is taken that rejects most of the documents labelled bad which earlier rules let pass, the
most lenient among equals; a rule that rejects none of them isn't used in that stratum.

Guarantee: with probability 1 - ``confidence_error``, in every stratum the rules together reject at most ``max_risk``
of the good documents. ``max_risk`` is divided over the rules (union bound); ``confidence_error`` is divided over
rules and strata (Bonferroni); within one sequence of cutoffs nothing is divided, as testing stops at the first
failure. A stratum with too few labels to prove a cutoff gets no rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, WORD_BREAK, stored, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_RISK = 0.05
CONFIDENCE_ERROR = 0.05

# rule -> (measure, cutoffs from lenient to strict); a document is rejected if the measure is above the cutoff
RULES = {
    "symbols_per_word": [3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeated_word_share": [0.2, 0.15, 0.1, 0.05, 0.02],
    "repeated_line_share": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1],
    "mean_word_length": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0],
    "upper_share": [0.95, 0.9, 0.8, 0.6, 0.4, 0.2],
}


def _removed(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = None,
                    ) -> DataFrame:
    """Per row: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (long).

    Works within each row, without a shuffle: windows of five words are hashed and sorted inside the text. Null
    texts have no words; null strata are a stratum of their own.
    """
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), text_or_empty(text_col).alias("t"))
    split = base.select(
        "doc_id", "stratum",
        F.transform(F.array_remove(F.split("t", WORD_BREAK), ""), lambda w: F.xxhash64(w)).alias("h"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.char_length(_removed(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(_removed(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    at = lambda i, k: F.get("h", i + k)
    windows = F.when(F.size("h") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    counted = split.select(
        "doc_id", "stratum", "word_chars", "n_symbols", "n_upper", F.size("h").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("w"))
    # only texts with a repeated window go through the sort
    repeats = F.size(F.array_distinct("w")) < F.size("w")
    ordered = counted.withColumn("s", F.when(repeats, F.array_sort(
        F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    found = ordered.withColumn("p", F.array_sort(F.transform(F.filter(
        "s", lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("p", lambda x, j: F.least(F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    return found.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def measures() -> dict[str, Column]:
    return {
        "symbols_per_word": _share("n_symbols", "n_words"),
        "repeated_word_share": _share("n_repeat_words", "n_words"),
        "repeated_line_share": _share("n_dup_lines", "n_lines"),
        "mean_word_length": _share("word_chars", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
    }


def log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """Natural logarithm of P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))

    def step(state, i):
        term = state["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(state["total"], term)
        return F.struct(term.alias("term"), (
            top + F.log(F.exp(state["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step, lambda s: s["total"])


def _choose_cutoff(labelled: DataFrame, rule: str, max_risk: float, confidence_error: float) -> DataFrame:
    """(stratum, max_<rule>) where a cutoff is proven and of use."""
    measure = measures()[rule]
    counts = [
        count for i, cutoff in enumerate(RULES[rule]) for count in (
            F.count_if((measure > cutoff) & F.col("good")).alias(f"k{i}"),
            F.count_if((measure > cutoff) & ~F.col("good") & ~F.col("rejected")).alias(f"caught{i}"))]
    per_stratum = labelled.groupBy("stratum").agg(F.count_if("good").alias("n"), *counts).filter("n > 0")
    tests = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(cutoff)).alias("cutoff"), F.col(f"k{i}").alias("k"),
                 F.col(f"caught{i}").alias("caught")) for i, cutoff in enumerate(RULES[rule])])
    n_strata = F.count(F.lit(1)).over(Window.partitionBy("i"))
    limit = F.log(F.lit(confidence_error) / (n_strata * len(RULES)))
    proven = per_stratum.select("stratum", "n", F.inline(tests)).withColumn("limit", limit).withColumn(
        "ok", log_binomial_cdf(F.col("n"), F.col("k"), max_risk / len(RULES)) <= F.col("limit"))
    so_far = Window.partitionBy("stratum").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    accepted = proven.withColumn("held", F.min("ok").over(so_far)).filter("held AND caught > 0")
    # most caught first, then the most lenient
    return accepted.groupBy("stratum").agg(
        F.max_by("cutoff", F.struct("caught", -F.col("i"))).alias(f"max_{rule}"))


def with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    limits = cutoffs.withColumnRenamed("stratum", "__stratum")
    return rows.join(limits, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").drop("__stratum")


def choose_cutoffs(labelled: DataFrame, max_risk: float = MAX_RISK, confidence_error: float = CONFIDENCE_ERROR,
                   ) -> DataFrame:
    """Rows (stratum, one column per rule) from the statistics of labelled documents with a boolean ``good``. A null
    cutoff means that the rule doesn't apply in that stratum."""
    chosen = labelled.select("stratum").distinct()
    left = labelled.withColumn("rejected", F.lit(False))
    for rule in RULES:
        cutoff = stored(_choose_cutoff(left, rule, max_risk, confidence_error), f"cutoff-{rule}")
        chosen = with_cutoffs(chosen, cutoff)
        left = with_cutoffs(left, cutoff).withColumn("rejected", F.col("rejected") | F.coalesce(
            measures()[rule] > F.col(f"max_{rule}"), F.lit(False))).drop(f"max_{rule}")
    return chosen


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str | None = "lang", label_id_col: str = "doc_id", label_col: str = "quality",
          max_risk: float = MAX_RISK, confidence_error: float = CONFIDENCE_ERROR) -> DataFrame:
    """Statistics of every row with base_failed, the verdict ``kept`` and the first broken rule as ``reason``.

    Labels of 1 mark good documents, labels of 0 bad ones; a document with both counts as good. Null labels and labels
    without a document are not used. Without labels only the base rule acts.
    """
    stats = stored(word_statistics(docs, id_col, text_col, stratum_col), "rule-stats")
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_id_col).alias("doc_id")).agg(
        (F.max(label_col) == 1).alias("good"))
    labelled = stored(stats.filter(~base_failed()).join(known, "doc_id"), "labelled-stats")
    cutoffs = stored(choose_cutoffs(labelled, max_risk, confidence_error), "rule-cutoffs")
    joined = with_cutoffs(stats, cutoffs)
    broken = F.coalesce(
        F.when(base_failed(), F.lit("base")),
        *[F.when(measure > F.col(f"max_{rule}"), F.lit(rule)) for rule, measure in measures().items()])
    return joined.select(
        *stats.columns, base_failed().alias("base_failed"), broken.isNull().alias("kept"), broken.alias("reason"))
