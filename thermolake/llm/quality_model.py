"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Pairs of a good and a bad labelled document give the
logistic loss of the feature differences, which Newton steps minimise. The threshold is a quantile of the strengths
of all training documents: the share labelled bad. Scores are the logistic function of the strength, shifted so that
the threshold scores 0.3.

Only the weights come from bounded data: ``SAMPLE`` labelled documents per label, taken by a hash of the id, and pairs
of them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

FOLDS, HELD_OUT = 5, 0
CUTOFF = 0.3
SAMPLE = 3000
N_PAIRS = 60_000
PENALTY = 1e-3
# ranks are found by counting in so many equal ranges, until so few values are left
BINS, FEW = 4096, 10_000

FEATURES = [
    "log_words", "log_chars", "word_length", "distinct_words", "top_word", "repeated_next", "symbols", "digits",
    "upper", "punctuation", "exclamations", "bars", "sentence_ends", "non_ascii", "lines", "distinct_lines",
    "words_per_line", "quotes", "short", "distinct_pairs", "symbol_words", "capital_words", "spread", "letters",
]
_CLASSES = {
    "digits": b"0123456789", "symbols": b"#*$%&<>|=+~^@\\/_", "punctuation": b".,;:!?", "exclamations": b"!",
    "bars": b"|", "sentence_ends": b".", "quotes": b"\"'", "upper": bytes(range(65, 91)),
    "letters": bytes(range(65, 91)) + bytes(range(97, 123)),
}
_ENDS = tuple("#*$%&|<>!")


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1))
    for j, members in enumerate(_CLASSES.values()):
        table[list(members), j] = 1
    table[128:, len(_CLASSES)] = 1
    return table


def text_features(text: str | None) -> list[float]:
    """Shape of one text: what it is made of, not which words it uses."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _class_table() / n
    share = dict(zip([*_CLASSES, "non_ascii"], counts.tolist(), strict=True))
    words = text.split()
    n_words = len(words)
    w = max(n_words, 1)
    kinds = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    following = list(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), float, n_words) if words else np.zeros(1)
    own = {
        "log_words": math.log1p(n_words), "log_chars": math.log1p(len(text)),
        "word_length": float(lengths.mean()), "spread": float(lengths.std()),
        "distinct_words": len(kinds) / w, "top_word": max(kinds.values(), default=0) / w,
        "repeated_next": sum(a == b for a, b in following) / w,
        "distinct_pairs": len(set(following)) / max(len(following), 1),
        "lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "words_per_line": math.log1p(n_words / max(len(lines), 1)),
        "short": float(n_words < 15), "symbol_words": sum(x.endswith(_ENDS) for x in words) / w,
        "capital_words": sum(x[0].isupper() for x in words) / w,
    }
    own |= share
    return [own[f] for f in FEATURES]


def _training(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, quality) of the labelled documents outside the held-out fold, one row an id."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != HELD_OUT)).dropDuplicates(["doc_id"])
    return known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")


def _sampled(docs: DataFrame, known: DataFrame, sample: int, id_col: str, text_col: str) -> pd.DataFrame:
    """At most ``sample`` training documents of each label, with their features."""
    taken = None
    for value in (0, 1):
        part = known.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        taken = part if taken is None else taken.union(part)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(taken, "doc_id")

    def features(frames):
        for frame in frames:
            x = pd.DataFrame([text_features(t) for t in frame["text"]], columns=FEATURES)
            yield pd.concat([frame[["doc_id", "quality"]].reset_index(drop=True), x], axis=1)

    schema = "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    # bounded by 2 * sample rows, where ids are unique
    return rows.dropDuplicates(["doc_id"]).mapInPandas(features, schema).toPandas().sort_values("doc_id")


def _at_rank(values: DataFrame, rank: int) -> float:
    """The ``rank``-th smallest, from 0, of a single column ``strength``. At most ``FEW`` values reach the driver."""
    while True:
        low, high, n = values.agg(F.min("strength"), F.max("strength"), F.count("*")).first()
        if low == high:
            return low
        if n <= FEW:
            return sorted(r.strength for r in values.collect())[rank]
        # a low, a middle and a high range at least, so each pass leaves values out
        place = F.least(F.floor((F.col("strength") - low) / (high - low) * BINS), F.lit(BINS - 1))
        counts = sorted(values.groupBy(place.alias("place")).count().collect())
        for at, size in counts:
            if rank < size:
                break
            rank -= size
        values = values.filter(place == at)


def _threshold(strengths: DataFrame, known: DataFrame) -> float:
    """The smallest strength that the share labelled bad of all training documents doesn't exceed."""
    # rows that repeat an id count once
    rows = stored(known.join(strengths, "doc_id").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.min("strength").alias("strength")), "quality-training")
    bad, n = rows.agg(F.count_if(F.col("quality") == 0), F.count("*")).first()
    if bad in (0, n):  # nothing to tell apart: all strengths are 0
        return 1.0 if bad else 0.0
    return _at_rank(rows.select("strength"), bad - 1)


def fit(sample: pd.DataFrame, n_pairs: int = N_PAIRS) -> dict:
    """Weights of the strength. With one label only, all documents score the same."""
    x = sample[FEATURES].to_numpy()
    good, bad = x[sample["quality"] == 1], x[sample["quality"] == 0]
    if not len(good) or not len(bad):
        return {"mean": [0.0] * len(FEATURES), "scale": [1.0] * len(FEATURES), "weights": [0.0] * len(FEATURES)}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    rng = np.random.default_rng(17)
    i, j = rng.integers(0, len(good), n_pairs), rng.integers(0, len(bad), n_pairs)
    d = (good[i] - bad[j]) / scale  # preferred minus other
    weights = np.zeros(len(FEATURES))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
        gradient = d.T @ (p - 1) / n_pairs + PENALTY * weights
        curvature = (d * (p * (1 - p))[:, None]).T @ d / n_pairs + PENALTY * np.eye(len(weights))
        step = np.linalg.solve(curvature, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": weights.tolist()}


def strengths_of(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, strength double) of every row; null and empty texts get the strength of an empty text."""
    def strength(frames):
        mean, scale, weights = (np.array(model[k]) for k in ("mean", "scale", "weights"))
        for frame in frames:
            if len(frame):
                x = np.array([text_features(t) for t in frame["text"]])
                yield pd.DataFrame({"doc_id": frame["doc_id"], "strength": ((x - mean) / scale) @ weights})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(strength, "doc_id long, strength double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Labels without a document, repeated labels of an id after
    the first, and labels other than 0 and 1 aren't used."""
    known = stored(_training(docs, labels, id_col), "quality-labels")
    model = fit(_sampled(docs, known, sample, id_col, text_col))
    strengths = stored(strengths_of(docs, model, id_col, text_col), "quality-strengths")
    threshold = _threshold(strengths, known)
    shifted = F.col("strength") - threshold + math.log(CUTOFF / (1 - CUTOFF))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    bounded = F.greatest(F.least(shifted, F.lit(35.0)), F.lit(-35.0))
    return strengths.withColumn("score", 1 / (1 + F.exp(-bounded))).select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"))
