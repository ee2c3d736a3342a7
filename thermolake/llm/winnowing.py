"""Document fingerprints by winnowing.

Every run of ``K`` code points is hashed. Of each window of ``WINDOW`` neighbouring hashes the smallest is kept, the
rightmost one among equals, with its position. Two texts that share ``K + WINDOW - 1`` code points share a
fingerprint. Texts with few runs use narrower windows, which only adds fingerprints, so the guarantee holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_pieces

K, WINDOW = 12, 64
LEAST_WINDOWS = 8
BLOCK_BYTES = 32 << 20
MAX_BLOCKS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    best, have = values, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best


def winnow(text: str, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Fingerprints in order of position, as hash * 2^32 + position. A text shorter than ``k`` is one run."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return np.empty(0, np.uint64)
    k = min(k, len(points))
    n = len(points) - k + 1
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0x100000001B3) + points[i:i + n]
    hashes = _mix(rolled) >> np.uint64(32)
    # a larger position makes a smaller key, so the rightmost of equal hashes wins
    mirrored = np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    width = min(window, max(1, n // LEAST_WINDOWS))
    chosen = window_minima((hashes << np.uint64(32)) | mirrored, width)
    kept = chosen[np.flatnonzero(np.diff(chosen)) + 1] if len(chosen) > 1 else chosen[:0]
    kept = np.concatenate([chosen[:1], kept])
    return kept ^ np.uint64(0xFFFFFFFF)


def as_text(fingerprint: np.ndarray) -> str:
    """Sixteen hexadecimal digits each: hash, then position."""
    return fingerprint.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the two sets of hashes; two empty fingerprints are alike."""
    x, y = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare_neighbours(batches):
    """Rows (block, extra, doc_id, text) in order; each text is compared with the one after it in its block."""
    last = None

    def row(doc_id, text, mine, following, theirs):
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        other = winnow(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), digest, as_text(mine), as_text(other), likeness(mine, other),
                likeness(mine, theirs))

    for batch in batches:
        rows = []
        for block, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            same = last is not None and last[0] == block
            if same and last[1]:
                continue  # further copies of the next block's first row
            mine = winnow(text)
            if same:
                rows.append(row(last[2], last[3], last[4], text, mine))
            last = (block, extra, doc_id, text, mine)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
               ) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form, whose last third is the beginning of the next
    document in descending order of id (after the last: of the first).

    Texts are moved once, into blocks of neighbouring ids; only the first row of a block goes to two places. Rows
    with one id follow each other in order of text; null ids come last, null texts are empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = min(n_pieces(n_bytes, block_bytes), MAX_BLOCKS)
    ranks = [i / n_blocks for i in range(1, n_blocks)]
    cuts = rows.approxQuantile("doc_id", ranks, 0.1 / n_blocks) if ranks else []
    bounds = sorted({int(c) for c in cuts}, reverse=True)
    if bounds:
        above = F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: F.col("doc_id") < b)
        block = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(above))
    else:
        block = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0))
    placed = rows.select(block.alias("block"), "doc_id", "text")
    # one id per block: where a block's first row goes besides
    firsts = placed.groupBy("block").agg(F.max("doc_id").alias("first")).orderBy("block").collect()
    before = {firsts[i].first: firsts[i - 1].block for i in range(len(firsts))}
    of_id = F.create_map(*[F.lit(x).cast(t) for k, b in before.items() if k is not None
                           for x, t in ((k, "long"), (b, "int"))]).cast("map<bigint,int>")
    earlier = F.when(F.col("doc_id").isNull(), F.lit(before.get(None)).cast("int")).otherwise(
        F.element_at(of_id, F.col("doc_id")))
    own = F.struct("block", F.lit(False).alias("extra"))
    spread = F.when(earlier.isNotNull(), F.array(own, F.struct(earlier.alias("block"), F.lit(True).alias("extra")))
                    ).otherwise(F.array(own))
    moved = placed.select(F.explode(spread).alias("to"), "doc_id", "text").select("to.block", "to.extra", "doc_id",
                                                                                  "text")
    return (
        moved.repartition(max(len(firsts), 1), "block")
        .sortWithinPartitions("block", "extra", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
        .mapInArrow(_compare_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double"))
