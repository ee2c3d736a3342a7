"""Toxicity scores from averaged subword vectors.

Every run of 3 to 5 characters inside a word, its borders included, is hashed to one of ``BUCKETS`` rows of a table of
short vectors. A document is the average of the vectors of all its character runs; a linear layer and a softmax turn
it into a probability. Table and layer are trained together, in numpy, by Adam on small batches. A misspelled word that
training never saw shares most of its runs, hence of its vectors, with the words it comes from.

As the layer is linear, table and layer are folded into one number a bucket after training: scoring adds up numbers,
and gives exactly what averaging the vectors first would give.

Training takes at most ``SAMPLE`` documents of each label, chosen by a hash; the share of toxic documents, which the
softmax is corrected by, is counted over all labelled training documents, and every document is scored in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

SHORTEST, LONGEST = 3, 5
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIM = 8
# most training documents with label 1, with label 0
SAMPLE = {1: 3000, 0: 6000}
BATCH = 128
# passes over the sample: a small one is gone through more often, for at least so many steps
EPOCHS, MOST_EPOCHS, LEAST_STEPS = 8, 40, 400
RATE = 0.1
CUT = 0.5
SEED = 13

_CHUNK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all character runs, one array for each length and stretch of the text. Six ASCII characters
    part words; a border counts as one space. Long texts go through in stretches, so memory is bounded by the text."""
    padded = f" {text.lower()} "
    for start in range(0, len(padded), _CHUNK):
        codes = np.frombuffer(padded[start:start + _CHUNK + LONGEST - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        codes = np.where(space, 32, codes).astype(np.uint64)
        run, broken = codes, np.zeros(len(codes), bool)
        for n in range(2, LONGEST + 1):
            here = len(codes) - n + 1
            if here <= 0:
                break
            run = (run[:here] * _MIX) ^ codes[n - 1:]
            run ^= run >> np.uint64(29)
            # spaces may stand at the ends of a run only
            broken = broken[:here] | space[n - 2:n - 2 + here] if n > 2 else np.zeros(here, bool)
            if n >= SHORTEST:
                whole = run[:_CHUNK][~broken[:_CHUNK]]
                yield ((whole * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often each) of a text."""
    counts: dict | None = None
    parts = list(subwords(text))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    if sum(map(len, parts)) > BUCKETS:
        counts = np.zeros(BUCKETS, np.int64)
        for part in parts:
            counts += np.bincount(part, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        return held.astype(np.int32), np.minimum(counts[held], 2**31 - 1).astype(np.int32)
    held, counts = np.unique(np.concatenate(parts), return_counts=True)
    return held.astype(np.int32), counts.astype(np.int32)


class _Adam:
    """Adam over one array, updated in place."""

    def __init__(self, values: np.ndarray, rate: float):
        self.values, self.rate, self.step = values, rate, 0
        self.mean, self.square = np.zeros_like(values), np.zeros_like(values)

    def update(self, gradient: np.ndarray) -> None:
        self.step += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient * gradient - self.square)
        size = np.sqrt(self.square / (1 - 0.999**self.step)) + 1e-8
        self.values -= self.rate / (1 - 0.9**self.step) * self.mean / size


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, epochs: int | None = None,
          seed: int = SEED) -> tuple[np.ndarray, float]:
    """Trains vectors and softmax jointly and folds them: (number a bucket, number of an empty text). A document's
    logit is the average of its buckets' numbers plus the latter."""
    random = np.random.default_rng(seed)
    table = ((random.random((dim, BUCKETS), dtype=np.float32) - 0.5) / dim)
    layer = random.random((2, dim)) - 0.5
    offset = np.zeros(2)
    table_steps, layer_steps, offset_steps = _Adam(table, RATE), _Adam(layer, RATE), _Adam(offset, RATE)
    used = np.array([i for i, (held, _) in enumerate(bags) if len(held)], dtype=np.int64)
    steps = -(-len(used) // BATCH)
    epochs = epochs or max(EPOCHS, min(MOST_EPOCHS, -(-LEAST_STEPS // max(1, steps))))
    for _ in range(epochs):
        order = random.permutation(used)
        for first in range(0, len(order), BATCH):
            batch = [bags[i] for i in order[first:first + BATCH]]
            truth = labels[order[first:first + BATCH]]
            lengths = np.array([len(held) for held, _ in batch])
            starts = np.cumsum(lengths) - lengths
            buckets = np.concatenate([held for held, _ in batch])
            weights = np.concatenate([n / n.sum() for _, n in batch]).astype(np.float32)
            hidden = np.stack([np.add.reduceat(table[k][buckets] * weights, starts) for k in range(dim)], axis=1)
            logits = hidden @ layer.T + offset
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = chance / chance.sum(axis=1, keepdims=True)
            error[np.arange(len(truth)), truth] -= 1
            error /= len(truth)
            back = error @ layer
            table_steps.update(np.stack([
                np.bincount(buckets, weights * np.repeat(back[:, k], lengths), BUCKETS) for k in range(dim)
            ]).astype(np.float32))
            layer_steps.update(error.T @ hidden)
            offset_steps.update(error.sum(axis=0))
    return ((layer[1] - layer[0]) @ table).astype(np.float32), float(offset[1] - offset[0])


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth id by hash is kept from training; a row without an id has no label, so it counts as not held out."""
    rest = F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5
    return F.coalesce(rest == 0, F.lit(False))


def _sample(known: DataFrame, limits: dict[int, int]) -> DataFrame:
    """At most ``limits`` rows a label, those with the smallest hash; only ids and hashes move."""
    parts = [
        known.filter(F.col("label") == label).orderBy("place", "doc_id").limit(limit)
        for label, limit in limits.items()]
    return parts[0].unionByName(parts[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for place, doc_id, label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held, counts = bag(text)
            yield pa.RecordBatch.from_pydict({
                "place": pa.array([place], pa.int64()), "doc_id": pa.array([doc_id], pa.string()),
                "label": pa.array([label], pa.int32()),
                "held": pa.array([held.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _fit(epochs: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += [
                (p, d, y, np.frombuffer(h, np.int32), np.frombuffer(c, np.int32))
                for p, d, y, h, c in zip(*[x.to_pylist() for x in batch.columns], strict=True)]
        rows.sort(key=lambda r: r[:3])
        if rows:
            folded, empty = train([r[3:] for r in rows], np.array([r[2] for r in rows]), epochs=epochs)
            yield pa.RecordBatch.from_pydict({
                "folded": pa.array([folded.astype("<f4").tobytes()], pa.binary()),
                "empty": pa.array([empty], pa.float64()),
                "n_toxic": pa.array([sum(r[2] for r in rows)], pa.int64()),
                "n_clean": pa.array([sum(1 - r[2] for r in rows)], pa.int64())})

    return run


def _scores(folded: np.ndarray, offset: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                total, n = 0.0, 0
                for buckets in subwords(text):
                    total += float(folded[buckets].sum(dtype=np.float64))
                    n += len(buckets)
                logit = offset + (total / n if n else 0.0)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*names, "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_id_col: str = "doc_id", label_col: str = "toxic", limits: dict[int, int] | None = None,
                    epochs: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (score >= 0.5).

    Only documents that are not held out are learned from. A label other than 0 and 1, or of no document, isn't used; an
    id with both labels counts as toxic; of several texts with one id the one with the smallest hash is learned from,
    and all are scored. Null texts count as empty; empty texts, and those without a run of three characters, get the
    score of the offset alone. Texts may be of any length. Rows without an id are scored and not held out. Without
    labels of both kinds every score is the share of toxic labels, or 0 without any. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(label_id_col).isNotNull()).groupBy(
        F.col(label_id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = rows.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.min(F.xxhash64("text")).alias("text_hash"))
    known = stored(texts.join(marks, "doc_id").withColumn(
        "place", F.xxhash64(F.lit(SEED), "doc_id", "text_hash")), "toxicity-known")
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)

    keep = rows.select("doc_id", held_out().alias("held_out"), "text")
    if not toxic or not clean:
        score = F.lit(toxic / (toxic + clean) if toxic + clean else 0.0)
        return _decided(keep.drop("text").withColumn("score", score))

    # bounded by ``limits``, whatever the size of the corpus
    chosen = stored(_sample(known, limits or SAMPLE), "toxicity-sample").withColumnRenamed("doc_id", "__id")
    picked = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (
        F.xxhash64("text") == F.col("text_hash"))).dropDuplicates(["doc_id"])
    features = stored(picked.select("place", F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInArrow(
        _features, "place long, doc_id string, label int, held binary, counts binary"), "toxicity-features")
    model = stored(features.coalesce(1).mapInArrow(
        _fit(epochs), "folded binary, empty double, n_toxic long, n_clean long"), "toxicity-model").first()
    # the softmax learned the sample's shares; the corpus has others
    shift = math.log(toxic / clean) - math.log(model.n_toxic / model.n_clean)
    folded = np.frombuffer(bytes(model.folded), "<f4")
    scored = keep.mapInArrow(
        _scores(folded, model.empty + shift),
        f"doc_id {keep.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return _decided(scored)


def _decided(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
