"""Hard negatives: for an anchor and each of its best partners of the same label, the best rows of other labels whose
inner product with the anchor lies in a window below the partner's.

Method: inner products become distances by one more coordinate that gives all candidates the same norm (the anchor gets
0 there), so that dist^2 = |q|^2 + M^2 - 2 q.x. Candidates are dealt to blocks of bounded size, near ones together, and
each block gets a cover tree: every level covers the points of a node by balls around some of them, of half the node's
radius where its points allow it, and every node keeps the covering radius it really has. A node whose ball reaches
neither side of any open window is skipped; the others are opened best bound first, and the points of a leaf are
verified by exact whole-number products.

Anchors meet the candidates in blocks: a task holds one block of candidates and one group of anchors, both bounded,
and hands on the best few for each anchor. Bounds have room for rounding, so nothing is lost; the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_pieces, stored

POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
SCALE = 256
# candidates in a block, anchors in a group, most blocks' centres
BLOCK, GROUP, CELLS = 16384, 8192, 64
LEAF, FAN = 512, 32
# floats hold sums of products exactly up to here
EXACT = float(2**52)
_NO_ID = np.iinfo(np.int64).max
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


class CoverTree:
    """Cover tree over the rows of ``points`` (whole numbers as floats), which are put in the order of its leaves:
    ``order`` says where each came from."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        norms = np.einsum("ij,ij->i", points, points)
        self.square = float(norms.max(initial=0.0))
        full = np.hstack([points, np.sqrt(np.maximum(self.square - norms, 0.0))[:, None]])
        centres: list[int] = []
        radii: list[float] = []
        # of every node: its children's numbers, or the rows of a leaf
        self.children: list[range] = []
        self.rows: list[slice | None] = []
        spread: list[tuple[np.ndarray, np.ndarray] | None] = []

        def add(members: np.ndarray, centre: int, distances: np.ndarray) -> None:
            centres.append(centre)
            radii.append(float(distances.max()))
            self.children.append(range(0))
            self.rows.append(None)
            spread.append((members, distances))

        if len(points):
            add(np.arange(len(points)), 0, np.linalg.norm(full - full[0], axis=1))
        order, placed, at = [], 0, 0
        while at < len(centres):
            members, distances = spread[at]
            spread[at] = None
            if len(members) > leaf and radii[at] > 0:
                first = len(centres)
                for ball in self._cover(full, members, centres[at], distances, min(fan, 1 + len(members) // leaf)):
                    add(*ball)
                self.children[at] = range(first, len(centres))
            else:
                self.rows[at] = slice(placed, placed + len(members))
                order.append(members)
                placed += len(members)
            at += 1
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.points = points[self.order]
        self.radii = np.array(radii)
        self.centres = points[centres]

    @staticmethod
    def _cover(full, members, centre, distances, fan) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Balls that cover ``members``: the next centre is always the point farthest from all so far, until half the
        radius is enough or ``fan`` balls are taken; scattered points keep larger balls."""
        goal = distances.max() / 2
        own = full[members]
        centres, near, owner = [centre], distances.copy(), np.zeros(len(members), np.int64)
        while near.max() > goal and len(centres) < fan:
            farthest = members[int(near.argmax())]
            gap = np.linalg.norm(own - full[farthest], axis=1)
            closer = gap < near
            owner[closer], near[closer] = len(centres), gap[closer]
            centres.append(int(farthest))
        for i, c in enumerate(centres):
            mine = owner == i
            if mine.any():
                yield members[mine], c, near[mine]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product that any point of each node can have with each query."""
        own = np.einsum("ij,ij->i", queries, queries)[:, None] + self.square
        apart = np.sqrt(np.maximum(own - 2 * (queries @ self.centres.T), 0.0))
        room = 1e-9 * own + 1
        return (own - (apart + self.radii) ** 2) / 2 - room, (
            own - np.maximum(apart - self.radii, 0.0) ** 2) / 2 + room


def search(tree: CoverTree, ids: np.ndarray, allowed: np.ndarray, score, least: np.ndarray, most: np.ndarray,
           windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (lowest, highest score) the best ``k`` allowed rows as (-score, id), best first.

    ``ids`` and ``allowed`` are in the order of the tree, ``least`` and ``most`` the query's bounds of its nodes;
    ``score(rows)`` gives exact inner products. Nodes are opened best bound first.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in windows]
    use = [j for j, (low, high) in enumerate(windows) if low <= high]
    if not use or not len(most):
        return best
    kind = np.int64 if all(_LOWEST <= x <= _HIGHEST for w in windows for x in w) else object
    highs = np.array([windows[j][1] for j in use], kind)
    # a lower score than this can't get in any more
    floors = np.array([windows[j][0] for j in use], kind)
    most, least = most.tolist(), least.tolist()
    lowest, ends = floors.tolist(), highs.tolist()
    open_ = [(-most[0], 0)]
    while open_:
        bound, node = heapq.heappop(open_)
        if -bound < min(lowest):
            break
        if not any(-bound >= low and least[node] <= high for low, high in zip(lowest, ends, strict=True)):
            continue
        rows = tree.rows[node]
        if rows is None:
            for child in tree.children[node]:
                heapq.heappush(open_, (-most[child], child))
            continue
        scores = score(rows)
        fits = (scores >= floors[:, None]) & (scores <= highs[:, None]) & allowed[rows]
        for i in np.flatnonzero(fits.any(axis=1)):
            at = np.flatnonzero(fits[i])
            if len(at) > k:
                at = at[np.lexsort((ids[rows][at], -scores[at]))[:k]]
            mine = best[use[i]]
            mine += zip((-scores[at]).tolist(), ids[rows][at].tolist(), strict=True)
            mine.sort()
            del mine[k:]
            if len(mine) == k:
                lowest[i] = floors[i] = max(floors[i], -mine[-1][0])
    return best


def _matrix(vectors: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, list | None]:
    """Vectors as floats, shorter ones filled up with zeros, and as lists where floats can't hold them."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        whole = flat.reshape(len(sizes), dim)
    else:
        whole = np.zeros((len(sizes), dim), np.int64)
        whole[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return whole.astype(np.float64), whole


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy().astype(np.int64)


def _searcher(phase: str, dim: int, k: int, schema: pa.Schema):
    """Search of one block of candidates for one group of anchors."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        found: dict[str, list] = {name: [] for name in schema.names}
        if candidates.num_rows and anchors.num_rows:
            # rows come in any order; equal input must give equal trees
            candidates = candidates.sort_by([("vec_id", "ascending"), ("key", "ascending"), ("copy", "ascending")])
            points, whole = _matrix(candidates["v"], dim)
            queries, asked = _matrix(anchors["v"], dim)
            ids, labels = _ids(candidates["vec_id"]), candidates["label"].to_numpy()
            keys, copies = candidates["key"].to_numpy(), candidates["copy"].to_numpy()
            tree = CoverTree(points)
            points, whole, ids, labels, keys, copies = [
                x[tree.order] for x in (points, whole, ids, labels, keys, copies)]
            exact = max(abs(points).max(initial=0), 1) * max(abs(queries).max(initial=0), 1) * dim < EXACT
            if not exact:
                whole, asked = whole.astype(object), asked.astype(object)
            own, own_key = anchors["vec_id"].to_pylist(), anchors["key"].to_pylist()
            label_of = anchors["label"].to_pylist()
            positives = anchors["positives"].to_pylist() if phase == "negatives" else None
            for i in range(len(own)):
                if i % 256 == 0:
                    least, most = tree.bounds(queries[i:i + 256])
                if exact:
                    score = lambda rows, q=queries[i]: (points[rows] @ q).astype(np.int64)
                else:
                    score = lambda rows, q=asked[i]: whole[rows] @ q
                if positives is None:
                    allowed = labels == label_of[i]
                    for twin in np.flatnonzero((ids == own[i]) & (keys == own_key[i]) & (copies == 1)):
                        allowed[twin] &= bool((whole[twin] != asked[i]).any())
                    windows = [(_LOWEST, _HIGHEST)]
                else:
                    allowed = labels != label_of[i]
                    # the lower end is rounded up
                    windows = [(-((-LEAST_PERCENT * p["score"]) // 100), MOST_PERCENT * p["score"] // 100)
                               for p in positives[i]]
                for j, rows in enumerate(search(tree, ids, allowed, score, least[i % 256], most[i % 256], windows, k)):
                    for negative, vec_id in rows:
                        values = (own[i], own_key[i], j + 1, None if vec_id == _NO_ID else vec_id, -negative)
                        for name, value in zip(schema.names, values, strict=True):
                            found[name].append(value)
        return pa.Table.from_pydict(found, schema)

    return run


def _nearest_cell(centres: np.ndarray):
    half = np.einsum("ij,ij->i", centres, centres) / 2

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        rows, _ = _matrix(pa.array(vectors, pa.list_(pa.int64())), centres.shape[1])
        return pd.Series((rows @ centres.T - half).argmax(axis=1).astype("int32"))

    return cell


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             ) -> DataFrame:
    """(vec_id, label, v, key, copies): rows that can take part, with components as whole numbers floor(256 x). Equal rows
    are one, with their number."""
    usable = F.forall(vector_col, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))), F.lit(False)))
    kept = rows.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))
    return kept.groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "key", F.xxhash64("label", "v"))


def _in_blocks(candidates: DataFrame, n_rows: int, dim: int) -> tuple[DataFrame, int]:
    """Deals candidates to numbered blocks of about ``BLOCK`` rows, near vectors together. The centres are a sample of
    at most ``CELLS`` vectors; a cell with many rows becomes several blocks by hash."""
    n_cells = min(CELLS, n_pieces(n_rows, BLOCK))
    first = candidates.select("v").orderBy(F.xxhash64(F.lit(12), "vec_id", "key", "copy")).limit(n_cells).collect()
    centres, _ = _matrix(pa.array([r.v for r in first], pa.list_(pa.int64())), dim)
    celled = candidates.withColumn("cell", _nearest_cell(centres)("v"))
    celled = stored(celled, "candidates")
    # one row per cell
    sizes = {r.cell: r.n for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = [n_pieces(sizes.get(c, 0), BLOCK) if c in sizes else 0 for c in range(len(first))]
    starts = [sum(pieces[:c]) for c in range(len(pieces))]
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cell"))
    block = of(starts) + F.pmod(F.xxhash64(F.lit(7), "vec_id", "key", "copy"), of(pieces)).cast("int")
    return celled.withColumn("block", block).drop("cell"), sum(pieces)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column | None = None, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (all long but rank).

    Anchors are the rows for which ``is_anchor`` (a condition on vec_id; the default takes ids divisible by 100) holds.
    Scores are inner products of the components' floor(256 x); higher come first, ties by smaller id, rows without an id
    last. Rows with a null label or vector, or with a component that is null or not finite, take no part. Equal rows
    count each for itself: an anchor that is there twice gives its rows twice, and is a positive of itself. Vectors of
    different lengths are compared as if filled up with zeros. A table without anchors or candidates gives no rows.
    A score must fit a long. Other columns are ignored.
    """
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    usable = stored(prepared(rows, id_col, vector_col, label_col), "vectors")
    # of equal rows no more can be among the results than these
    copies = F.least(F.col("copies"), F.lit(max(n_positives + 1, n_negatives)).cast("long"))
    spread = usable.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    anchors = usable.filter(is_anchor).select("vec_id", "key", "label", "v", F.col("copies").alias("times"))
    size = spread.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n_anchors = anchors.count()
    out = "anchor_id long, key long, rank int, vec_id long, score long"
    schema = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()),
                        ("score", pa.int64())])
    if not size.n or not n_anchors:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    groups = n_pieces(n_anchors, GROUP)
    dealt, blocks = _in_blocks(spread, size.n, max(size.dim, 1))
    dealt = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
                         "vec_id", "key", "label", "v", "copy")

    def met(asking: DataFrame, phase: str, k: int) -> DataFrame:
        asking = asking.withColumn("part", F.pmod(F.xxhash64("vec_id", "key"), F.lit(groups)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(
            _searcher(phase, max(size.dim, 1), k, schema), out)

    partners = stored(_best(met(anchors.drop("times"), "positives", n_positives), ["anchor_id", "key"], n_positives).select(
        "anchor_id", "key", F.col("place").alias("rank"), F.col("vec_id").alias("positive_id"), "score"), "positives")
    # at most n_positives a row
    windows = partners.groupBy("anchor_id", "key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("positives"))
    asking = anchors.drop("times").join(
        windows.withColumnsRenamed({"anchor_id": "vec_id"}), ["vec_id", "key"])
    negatives = _best(met(asking, "negatives", n_negatives), ["anchor_id", "key", "rank"], n_negatives)
    return (
        negatives.select("anchor_id", "key", F.col("rank").alias("of"), F.col("place").alias("rank"),
                         F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(partners.select("anchor_id", "key", F.col("rank").alias("of"), "positive_id",
                              F.col("score").alias("positive_score")), ["anchor_id", "key", "of"])
        .join(anchors.select(F.col("vec_id").alias("anchor_id"), "key", "times"), ["anchor_id", "key"])
        .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def shifted_label(every: int = 7, n_labels: int = 10, id_col: str = "vec_id", label_col: str = "label") -> Column:
    """Labels with planted errors: that of every ``every``-th id is the next one."""
    return F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % n_labels).otherwise(F.col(label_col))
