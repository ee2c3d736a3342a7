"""Removal of repeated passages by suffix sorting with a difference cover.

A string of ``LENGTH`` bytes that starts at two places of the corpus is removed at both. The work is dealt out so that
strings which may be equal always meet:

1. Of every window of hashes of ``K``-byte strings the smallest is an anchor. Equal strings of ``LENGTH`` bytes hold
   the same anchor at the same offset, so only starts near anchors that occur twice can repeat.
2. Anchors with one hash form a class. Where the bytes around two anchors of a class agree as far as any string over
   the anchor can reach, all those strings repeat, and the occurrence is settled.
3. One occurrence of every differing surrounding goes to the suffix sort. Classes are dealt to tasks, which sort the
   suffixes of their surroundings by the difference-cover algorithm: sort the sampled triples, recurse on their names,
   merge the remaining suffixes, then compare the prefixes of neighbours.
4. A class with very many surroundings isn't sorted in one task. Its strings are parted by their distance from the
   anchor; those of a part share more bytes, which make smaller classes, and steps 2 to 4 are taken for them. Parts get
   narrower until they hold one string.

A single suffix array over all bytes would move every suffix through each level's shuffles; this form moves the
candidates only, and removes the same bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH = 200
K = 48
# suffixes of about so many bytes are sorted at once, which fits a core's cache
BATCH_BYTES = 1 << 17
# classes with more surroundings are parted
MAX_SURROUNDINGS = 4096
# distances from the anchor in a part; each width divides the one before
PART_WIDTHS = (32, 4, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# a random number for every byte
_BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x100000001B3


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]).cumprod()


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` neighbours: differences of sums weighed by falling powers of the base, raised
    again by the place."""
    n = len(values)
    size = 1 << max(n - 1, 1 << 12).bit_length()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(pow(_BASE, -1, 1 << 64), size)[:n], out=total[1:])
    return _mix((total[width:] - total[:-width]) * _powers(_BASE, size)[width - 1:n])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    best, have = values, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best


def anchors(raw: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text: the smallest hash of each window, rightmost among equals."""
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = _rolled(_BYTE_VALUES[np.frombuffer(raw, np.uint8)], k)
    n = len(hashes)
    mirrored = np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | mirrored
    chosen = _window_minima(key, length - k + 1)
    kept = chosen[np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])]
    at = (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return at, hashes[at].view(np.int64)


def _reach(n: int, at: int, length: int, k: int) -> tuple[int, int]:
    """Bytes [low, high) that strings over the anchor can cover."""
    return max(0, at + k - length), min(n, at + length)


def _records(names, types, rows):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _bytes_of(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(length: int, k: int):
    salts = [lead.to_bytes(4, "little") for lead in range(length - k + 1)]

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                uid, hash_, at, around = [], [], [], []
                batch = whole.slice(first, 500)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = _bytes_of(text)
                    places, hashes = anchors(raw, length, k)
                    uid.append(np.full(len(places), doc, np.int64))
                    hash_.append(hashes)
                    at.append(places)
                    for p in places.tolist():
                        low, high = _reach(len(raw), p, length, k)
                        around.append(hashlib.blake2b(raw[low:high], digest_size=8, salt=salts[p - low]).digest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hash_) if hash_ else np.empty(0, np.int64)),
                     pa.array(np.frombuffer(b"".join(around), "<i8")),
                     pa.array(np.concatenate(uid) if uid else np.empty(0, np.int64)),
                     pa.array((np.concatenate(at) if at else np.empty(0, np.int64)).astype(np.int32))],
                    ["hash", "around", "uid", "at"])

    return run


# ---- difference cover ---------------------------------------------------------


def _names(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank from 1 of each key, given the order that sorts them, and the highest; equal keys share a rank."""
    ordered = key[order]
    ranks = np.ones(len(key), np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=ranks[1:])
    ranks[1:] += 1
    rank = np.empty(len(key), np.int64)
    rank[order] = ranks
    return rank, int(ranks[-1])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an array of symbols >= 1, by the difference cover of period three.

    What belongs to places 0, 1 and 2 modulo 3 is kept apart, in the order of places, so that most steps read
    neighbours."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.zeros(n + 6, np.int64)
    s[:n] = symbols
    # sampled suffixes start at 1 or 2 modulo 3; one more keeps the two halves apart. There are as many ones as rest
    n_rest, n_twos = (n + 2) // 3, n // 3
    zero, one, two, three, four = (s[i::3] for i in range(5))
    width = int(s.max()) + 1
    triple = np.concatenate([(one[:n_rest] * width + two[:n_rest]) * width + three[:n_rest],
                             (two[:n_twos] * width + three[:n_twos]) * width + four[:n_twos]])
    order = np.argsort(triple)
    names, highest = _names(order, triple)
    if highest < len(names):
        order = suffix_array(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rank_one = np.append(rank[:n_rest], 0)
    rank_two = np.zeros(n_rest + 1, np.int64)
    rank_two[:n_twos] = rank[n_rest:]
    # the rest is sorted by its first symbol and the rank of the sampled suffix after it
    wide = len(order) + 2
    rest_key = zero[:n_rest] * wide + rank_one[:n_rest]
    rest = np.argsort(rest_key)
    # merge: where the rest falls among sampled suffixes of either kind
    ones = order[order < n_rest]
    if n % 3 == 1:
        ones = ones[ones < n_rest - 1]
    twos = order[order >= n_rest] - n_rest
    one_key = one[:n_rest] * wide + rank_two[:n_rest]
    before = np.searchsorted(one_key[ones], rest_key[rest])
    two_key = (two[:n_twos] * width + three[:n_twos]) * wide + rank_one[1:n_twos + 1]
    rest_key = (zero[:n_rest] * width + one[:n_rest]) * wide + rank_two[:n_rest]
    before += np.searchsorted(two_key[twos], rest_key[rest])
    result = np.empty(n, np.int64)
    at = np.arange(n_rest) + before
    result[at] = rest * 3
    sampled = np.ones(n, bool)
    sampled[at] = False
    place = np.where(order < n_rest, order * 3 + 1, (order - n_rest) * 3 + 2)
    result[sampled] = place[place < n] if n % 3 == 1 else place
    return result


def _equal_neighbours(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order: whether each shares its first ``length`` bytes with the one before it."""
    same = np.zeros(len(order), bool)
    eight = text.astype(np.uint64)
    for step in (1, 2, 4):
        eight = eight[:len(eight) - step] | (eight[step:] << np.uint64(8 * step))
    alive = np.arange(1, len(order))
    before, after = order[:-1], order[1:]
    # neighbours share their first bytes, so the last ones tell them apart soonest
    for at in [length - 8, *range((length - 1) // 8 * 8 - 8, -1, -8)]:
        same_here = eight[before + at] == eight[after + at]
        alive, before, after = alive[same_here], before[same_here], after[same_here]
    same[alive] = True
    return same


def repeated_starts(pieces: list[bytes], places: list[tuple[int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For byte pieces that lie at (document, position): the starts in each piece whose ``length`` bytes also start
    at another place."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = text.astype(np.int64) + 2
    symbols[starts + sizes] = 1  # ends
    order = suffix_array(symbols)
    fits = np.arange(len(text)) <= np.repeat(starts + sizes - length, sizes + 1)
    order = order[fits[order]]
    flagged = np.zeros(len(text), bool)
    if len(order):
        same = _equal_neighbours(text, order, length)
        grouped = same | np.append(same[1:], False)
        order, same = order[grouped], same[grouped]
    if len(order):
        docs = np.unique(np.array([d for d, _ in places]), return_inverse=True)[1]
        position = np.array([p for _, p in places])
        place = (np.repeat(docs * (1 << 40) + position - starts, sizes + 1) + np.arange(len(text)))[order]
        first = np.flatnonzero(~same)
        differs = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
        flagged[order] = np.repeat(differs, np.diff(np.append(first, len(order))))
    hits = np.flatnonzero(flagged)
    cuts = np.searchsorted(hits, [starts, starts + sizes])
    return [hits[a:b] - start for a, b, start in zip(*cuts.tolist(), starts.tolist(), strict=True)]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start at the given, rising places."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(g[0]), int(g[-1]) + length) for g in np.split(starts, cuts)]


# ---- Spark side ---------------------------------------------------------------


def _surroundings(length: int, k: int):
    """(uid, text, places: [(hash, at, crowded)]) to one row per place with its bytes and the anchor's distance from
    their start."""
    def run(batches):
        for batch in batches:
            rows = []
            for uid, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _bytes_of(text)
                for place in places:
                    low, high = _reach(len(raw), place["at"], length, k)
                    rows.append((place["hash"], uid, low, place["at"] - low, raw[low:high], place["crowded"]))
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    def made(rows):
        return _records(["hash", "uid", "low", "lead", "piece", "crowded"],
                        [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()], rows)

    return run


def _sort_classes(length: int):
    """Rows (hash, uid, low, piece), classes together, to covered ranges (uid, low, high)."""
    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for hash_, uid, low, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH_BYTES and hash_ != last:
                    yield solved(held)
                    held, size = [], 0
                held.append((uid, low, piece))
                size += len(piece)
                last = hash_
        if held:
            yield solved(held)

    def solved(held):
        found = repeated_starts([p for _, _, p in held], [(u, low) for u, low, _ in held], length)
        rows = [(u, low + a, low + b) for (u, low, _), starts in zip(held, found, strict=True)
                for a, b in _runs(starts, length)]
        return _records(["uid", "low", "high"], [pa.int64()] * 3, rows)

    return run


def _digest(data: bytes, *salt: int) -> int:
    found = hashlib.blake2b(data, digest_size=8, salt=b"".join(x.to_bytes(4, "little") for x in salt)).digest()
    return int.from_bytes(found, "little", signed=True)


def _parts(width: int, length: int):
    """Rows (uid, low, lead, piece) to one row per ``width`` distances from the anchor: the bytes that all strings of
    the part share make its class, those that any of them covers its surrounding."""
    def run(batches):
        for batch in batches:
            rows = []
            for uid, low, lead, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = len(piece) - length  # strings start at 0 to last, lead less that before the anchor
                for part in range((lead - last) // width, lead // width + 1):
                    right = lead - part * width
                    left = right - width + 1
                    first, end = max(left, 0), min(right, last) + length
                    shared = piece[right:max(right, left + length)]
                    around = piece[first:end]
                    rows.append((_digest(shared, part, width), _digest(around, lead - first), uid, low + first,
                                 lead - first, around))
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    def made(rows):
        return _records(["hash", "around", "uid", "low", "lead", "piece"],
                        [pa.int64()] * 4 + [pa.int32(), pa.binary()], rows)

    return run


def _removal(batches):
    for batch in batches:
        rows = []
        for uid, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = _bytes_of(text)
            kept, at, n_spans = [], 0, 0
            end = -1
            for r in sorted((r["low"], r["high"]) for r in ranges):
                if r[0] > end:  # ranges that touch make one run
                    n_spans += 1
                if r[0] > at:
                    kept.append(raw[at:r[0]])
                at = max(at, r[1])
                end = max(end, r[1])
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((uid, len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
        yield _records(["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                       [pa.int64()] * 4 + [pa.string(), pa.binary()], rows)


def _parted(crowded: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For rows (uid, low, lead, piece) of crowded classes: ranges that are settled, and what is left to sort."""
    settled, to_sort = [], []
    for width in PART_WIDTHS:
        if crowded.isEmpty():
            break
        parts = stored(crowded.select("uid", "low", "lead", "piece").mapInArrow(
            _parts(width, length), "hash long, around long, uid long, low long, lead int, piece binary"), "parts")
        seen = stored(parts.groupBy("hash", "around").agg(
            F.count("*").alias("n"), F.min(F.struct("uid", "low", "lead", "piece")).alias("one")), "parts-seen")
        settled.append(parts.join(seen.filter("n > 1").select("hash", "around"), ["hash", "around"], "left_semi").select(
            "uid", "low", (F.col("low") + F.octet_length("piece")).alias("high")))
        ones = stored(seen.join(_crowds(seen), "hash").select("hash", "one.*", "crowded"), "part-pieces")
        to_sort.append(ones.filter("NOT crowded"))
        crowded = ones.filter("crowded")
    return settled, to_sort


def _crowds(seen: DataFrame) -> DataFrame:
    """Classes with different surroundings, and whether these are too many for one task."""
    return seen.groupBy("hash").agg(F.count("*").alias("m")).filter("m > 1").select(
        "hash", (F.col("m") > MAX_SURROUNDINGS).alias("crowded"))


def covered_ranges(texts: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(uid, ranges: array of (low, high)) of the documents that hold a repeated string. ``texts`` has unique uid
    and text."""
    found = stored(texts.mapInArrow(_anchor_rows(length, k), "hash long, around long, uid long, at int"), "anchors")
    # written first, so that the join can split a class that holds a large part of all anchors
    twice = stored(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "repeated-anchors")
    candidates = stored(found.join(twice, "hash", "left_semi"), "anchor-classes")
    # a surrounding seen twice settles its occurrences
    seen = candidates.groupBy("hash", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("one"))
    seen = stored(seen, "surroundings")
    ones = seen.join(_crowds(seen), "hash").select(
        "one.uid", F.struct("hash", F.col("one.at").alias("at"), "crowded").alias("place"))
    hot = candidates.select("uid").distinct()
    hot_texts = stored(texts.join(hot, "uid", "left_semi"), "repeating-texts")
    sizes = hot_texts.select("uid", F.octet_length("text").alias("n_bytes"))
    settled = candidates.join(seen.filter("n > 1").select("hash", "around"), ["hash", "around"], "left_semi").join(
        sizes, "uid").select(
        "uid", F.greatest(F.col("at") + k - length, F.lit(0)).cast("long").alias("low"),
        F.least(F.col("at") + length, "n_bytes").cast("long").alias("high"))
    pieces = stored(
        hot_texts.join(ones.groupBy("uid").agg(F.collect_list("place").alias("places")), "uid")
        .select("uid", "text", "places")
        .mapInArrow(_surroundings(length, k),
                    "hash long, uid long, low long, lead int, piece binary, crowded boolean"), "pieces")
    settled_parts, parts_to_sort = _parted(pieces.filter("crowded"), length)
    to_sort = reduce(DataFrame.unionByName, [
        p.select("hash", "uid", "low", "piece") for p in (pieces.filter("NOT crowded"), *parts_to_sort)])
    sorted_out = to_sort.repartition("hash").sortWithinPartitions("hash").mapInArrow(
        _sort_classes(length), "uid long, low long, high long")
    every = reduce(DataFrame.unionByName, [settled, sorted_out, *settled_parts])
    ranges = every.groupBy("uid").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    return hot_texts.join(ranges, "uid").select("uid", "text", "ranges")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K,
                   ) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary): the remaining bytes, null
    where nothing was removed.

    Texts are UTF-8 bytes, null ones are empty; matches never cross documents. Rows that repeat an id, or have none,
    are documents of their own. Texts shorter than ``length`` bytes stay whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()
    if plain:
        rows = rows.withColumn("uid", F.col("doc_id"))
    else:  # ids don't tell rows apart: number them once
        rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered-texts")
    removed = covered_ranges(rows.select("uid", "text"), length, k).mapInArrow(
        _removal, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    text = F.coalesce("text", F.lit(""))
    whole = rows.select(
        "doc_id", "uid", F.octet_length(text).cast("long").alias("all_bytes"),
        F.sha2(text.cast("binary"), 256).alias("whole_sha256"))
    return whole.join(removed, "uid", "left").select(
        "doc_id", F.col("all_bytes").alias("n_bytes"), *[
            F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")],
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")
