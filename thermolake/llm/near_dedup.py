"""Near-duplicate detection by b-bit MinHash.

1. Each text becomes its set of five-word shingles; texts with the same words share one representative.
2. 128 minima per representative. Bands of four minima give candidate groups; the low two bits of every minimum are
   packed into four words, whose bit counts estimate the similarity, corrected for chance agreement.
3. Every member of a band group is compared with the group's centre: the member that shares most groups with most
   others, as the original of many copies does. What the estimate leaves standing is confirmed on the full sets.
4. Members that this leaves in different components are compared with each other in blocks: chunks of the group meet
   pairwise, the estimate picks pairs of different components, their full sets are intersected there, and only links
   that join components come out. So a large group is never written out pair by pair. Links become components by
   alternating stars.

A pair of similarity 0.85 shares no band or is dropped by the estimate with probability 6e-11, one of 0.8 (where that
is the threshold) with 5e-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE = 5
N_MINIMA, BAND_ROWS = 128, 4
LOW_BITS = 2
# how far below the threshold an estimate from 128 minima may fall: seven standard deviations
MARGIN = 0.3
# a chunk of a group holds about so many members, and about so many shingles at most
CHUNK = 256
CHUNK_SHINGLES = 1 << 20
COLUMNS = 8192

_FEATURES = "doc_id long, key binary, n_shingles long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; the six ASCII white-space characters separate them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        ids.append(h)
    h = np.array(ids, np.uint64)
    size = min(SHINGLE, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mix(total + h[i:len(h) - size + 1 + i])
    return np.unique(total)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * N_MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:N_MINIMA] | np.uint64(1), seeds[N_MINIMA:]


def minima(shingles: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    best = np.full(N_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        best = np.minimum(best, (shingles[i:i + 2048] * a[:, None] + b[:, None]).min(axis=1))
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(-1, BAND_ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = _mix(key + rows[:, i])
    return key.view(np.int64)


def pack_low_bits(best: np.ndarray) -> np.ndarray:
    """Bit planes: words 0 and 1 hold the lowest bit of every minimum, words 2 and 3 the next one."""
    low = _mix(best)
    planes = [np.packbits(((low >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)) for k in range(LOW_BITS)]
    return np.concatenate(planes).view(np.int64)


def _features(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(known) > 500_000:
                known.clear()
            words = words_of(text)
            shingles = shingle_set(words, known)
            key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            if len(shingles):
                best = minima(shingles)
                rows.append((doc_id, key, len(shingles), band_keys(best), *pack_low_bits(best).tolist()))
            else:
                rows.append((doc_id, None, 0, None, None, None, None, None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())] + [pa.int64()] * 4
        names = ["doc_id", "key", "n_shingles", "bands", "s0", "s1", "s2", "s3"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def estimated_similarity(left: str, right: str) -> Column:
    """From packed low bits: the share of equal bit groups, less what chance makes equal."""
    differ = [F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}")) for k in range(4)]
    unequal = F.bit_count(differ[0].bitwiseOR(differ[2])) + F.bit_count(differ[1].bitwiseOR(differ[3]))
    chance = 2.0 ** -LOW_BITS
    return ((1 - unequal / N_MINIMA) - chance) / (1 - chance)


def _shingle_rows(batches):
    known: dict[bytes, int] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            if len(known) > 500_000:
                known.clear()
            sets = [shingle_set(words_of(t), known).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _confirmer(threshold_percent: int):
    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= threshold_percent * (len(one) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(_confirmer(threshold_percent), "a long, b long")


def _plausible(pairs: DataFrame, feats: DataFrame, least: float) -> DataFrame:
    signature = F.struct("s0", "s1", "s2", "s3")
    first = feats.select(F.col("doc_id").alias("a"), signature.alias("p"))
    second = feats.select(F.col("doc_id").alias("b"), signature.alias("q"))
    return pairs.join(first, "a").join(second, "b").filter(estimated_similarity("p", "q") >= least).select("a", "b")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets: a product of their 0/1 tables, some columns at a time."""
    sizes = [len(x) for x in left + right]
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.unique(np.concatenate(left + right), return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    seen = np.bincount(column)
    shared = np.cumsum(seen > 1) - 1  # members of one set only don't count
    keep = seen[column] > 1
    row, column = row[keep], shared[column[keep]]
    total = np.zeros((len(left), len(right)), np.float64)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, n_columns, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(sizes), min(COLUMNS, n_columns - first)), np.float32)
        table[row[lo:hi], column[lo:hi] - first] = 1
        total += table[:len(left)] @ table[len(left):].T
    return total.round().astype(np.int64)


def joining_links(ids: np.ndarray, component: np.ndarray, near: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the links given by row numbers, those that join components still apart."""
    parent: dict[int, int] = {}

    def root(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in near:
        x, y = root(int(component[i])), root(int(component[j]))
        if x != y:
            parent[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def links_between(rows: list[dict], least: float, threshold_percent: int) -> list[tuple[int, int]]:
    """Links that join different components between side 0 and side 1 of a block, or within side 0 if the block is a
    chunk with itself."""
    need = int(np.ceil(N_MINIMA * (1 - (least * (1 - 2.0 ** -LOW_BITS) + 2.0 ** -LOW_BITS))))
    ids = np.array([r["doc_id"] for r in rows])
    component = np.array([r["component"] for r in rows])
    packed = np.array([[r[f"s{k}"] for k in range(4)] for r in rows], np.int64).view(np.uint64)
    side = np.array([r["side"] for r in rows])
    left = np.flatnonzero(side == 0)
    right = left if rows[0]["i"] == rows[0]["j"] else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    d = packed[left][:, None, :] ^ packed[right][None, :, :]
    unequal = np.bitwise_count(d[..., 0] | d[..., 2]) + np.bitwise_count(d[..., 1] | d[..., 3]).astype(np.int64)
    plausible = (unequal <= need) & (component[left][:, None] != component[right][None, :])
    if not plausible.any():
        return []
    left, right, plausible = left[plausible.any(1)], right[plausible.any(0)], plausible[plausible.any(1)][
        :, plausible.any(0)]
    sets = {i: np.frombuffer(rows[i]["shingles"], np.uint64) for i in {*left.tolist(), *right.tolist()}}
    common = intersections([sets[i] for i in left], [sets[j] for j in right])
    size = lambda side: np.array([len(sets[i]) for i in side])
    whole = size(left)[:, None] + size(right)[None, :] - common
    i, j = np.nonzero(plausible & (100 * common >= threshold_percent * whole))
    return joining_links(ids, component, list(zip(left[i].tolist(), right[j].tolist(), strict=True)))


def _block_links(least: float, threshold_percent: int):
    """Rows sorted by block (g, i, j) to the links that join components within each."""
    def run(batches):
        held, last = [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                found = []
                for row in whole.slice(at, 500).to_pylist():
                    block = (row["g"], row["i"], row["j"])
                    if held and block != last:
                        found += links_between(held, least, threshold_percent)
                        held = []
                    held.append(row)
                    last = block
                yield made(found)
        if held:
            yield made(links_between(held, least, threshold_percent))

    def made(links):
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return run


def _across(members: DataFrame, components: DataFrame, feats: DataFrame, sets: DataFrame, least: float,
            threshold_percent: int) -> DataFrame:
    """Links between members of one band group that the centre left in different components."""
    labelled = members.join(components, "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")).join(feats.select("doc_id", "n_shingles"), "doc_id")
    labelled = stored(labelled, "labelled-members")
    groups = labelled.groupBy("band").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"),
        F.sum("n_shingles").alias("weight"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("h")).filter(
        "lo < hi")
    # bands often repeat the same group; one of them is enough
    groups = stored(groups.groupBy("n", "weight", "h").agg(F.min("band").alias("band")).select(
        "band", F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).alias("n_chunks")),
        "open-groups")
    chunked = labelled.join(groups, "band").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")))
    other = F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)
    placed = chunked.select("*", F.explode(other).alias("other")).select(
        F.col("band").alias("g"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        F.when(F.col("chunk") <= F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "doc_id", "component")
    rows = placed.join(feats.select("doc_id", "s0", "s1", "s2", "s3"), "doc_id").join(sets, "doc_id")
    return (
        rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
        .mapInArrow(_block_links(least, threshold_percent), "a long, b long"))


def connected_components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of every linked id, component being the smallest id reachable. Large and small stars
    alternate until nothing changes; each round is written to the shared folder."""
    def state(edges):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u != v").distinct(), "links")
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = stored(small.filter("u != v").distinct(), "small-star")
        after = state(edges)
        if after == before:
            return edges.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("component"))
        before = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_percent: int = 85,
                    ) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Texts are linked if 100 * intersection >= ``threshold_percent`` * union of their shingle sets. A text without
    words (or null) has no shingles and is linked with nothing. Rows that repeat an id stand for the same document.
    Rows with a null id are linked with nothing; their component is null and they are kept.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = threshold_percent / 100 - MARGIN
    feats = stored(base.mapInArrow(_features, _FEATURES), "minhash")
    classes = stored(feats.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep")), "same-words")
    reps = stored(feats.join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi")
                  .dropDuplicates(["doc_id"]), "representatives")

    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(banded.join(stored(groups, "band-groups"), "band"), "band-members")
    involved = stored(members.groupBy("doc_id").agg(F.sum("n").alias("met")), "candidates")
    sets = stored(base.join(involved.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(
        _shingle_rows, "doc_id long, shingles binary"), "candidate-sets")

    ranked = members.select("doc_id", "band").join(involved, "doc_id")
    centres = ranked.groupBy("band").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("least"))).alias("best"))
    centres = stored(centres.select("band", (-F.col("best.least")).alias("centre")), "centres")
    stars = members.join(centres, "band").filter("doc_id != centre").select(
        F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct()
    star_links = stored(_confirmed(_plausible(stars, reps, least), sets, threshold_percent), "star-links")
    first = stored(connected_components(star_links), "star-components")
    more_links = stored(_across(members.select("doc_id", "band"), first, reps, sets, least, threshold_percent).distinct(),
                        "cross-links")
    components = connected_components(star_links.union(more_links))

    of_class = classes.join(components.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("linked"))
    component = F.coalesce("linked", "doc_id")
    return (
        feats.select("doc_id", "key", "n_shingles").join(stored(of_class, "class-components"), "key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
