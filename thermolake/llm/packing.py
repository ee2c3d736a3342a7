"""Retrieval packing: related documents fill a window together.

1. Texts become token ids. Whole windows of a long document stand alone; only the rest, shorter than a window, has
   to be packed with others. Each document also gets a small vector of its words: saturated counts, dealt to
   ``DIMENSIONS`` signed sums by a hash of the id.
2. Document frequencies are counted over the whole corpus; they are one number per token id, so their size is bound
   by the vocabulary.
3. Documents are put in an order in which those with common words stand together: a tree halves the vectors again and
   again along their main direction. The tree is fitted on about ``FIT_DOCS`` documents, whatever the corpus; every
   document is placed in it. Spark sorts by that place.
4. Each ``SHARD_DOCS`` documents of that order are a shard of the BM25 inverted index. A seed's window is filled by its
   best unused neighbours; the one that overflows is cut, and its remainder is the seed of the next window. So only
   the last window of a shard is padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import n_pieces, stored

WINDOW = 1024
SHARD_DOCS = 1024
TASK_DOCS = 4096
END_ID = 0
K1, B = 1.2, 0.75
DENSE = 16
SEED = 11
DIMENSIONS = 128
FIT_DOCS = 8192
TREE_DEPTH = 7

# how byte-level BPE of this kind parts a text (fixed value); runs that nothing after them can shorten are possessive
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# gaps of about a million characters are more than the faster encoder's pattern can take
_LONG_GAP = re.compile(r"\s{1000}")
LONG_TEXT = 100_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes and id of every token of a tokenizer file, or None unless the file is plain byte-level BPE whose ids are in
    the order of its merges, so that merging by the smallest id gives the file's own ids."""
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if (model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space", True) or not split.get("use_regex", True)
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                          "byte_fallback", "ignore_merges"))):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens") or []}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [vocabulary.get(t, -1) for t in merged]
    if (any(c not in byte for t in vocabulary for c in t) or ids != sorted(set(ids)) or -1 in ids
            or len(vocabulary) != len(merged) + 256 or any(vocabulary.get(c, -1) < 0 for c in byte)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}


class Encoder:
    """Ids of whole texts, as the tokenizer file gives them. Plain byte-level BPE runs in the faster of two libraries;
    other files, texts with special strings, and texts with very long gaps in the tokenizer itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ranks = byte_ranks(spec)
        self.fast = ranks and tiktoken.Encoding(
            path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (
                len(text) > LONG_TEXT and _LONG_GAP.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.fromiter(ids, "<u4", len(ids))
        # an array at once, no list of numbers
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def encoder_of_worker(path: str) -> Encoder:
    """A Python worker serves many tasks and keeps its encoder."""
    return Encoder(path)


def _signed_slots(terms: np.ndarray) -> np.ndarray:
    """Slot of each term, from ``DIMENSIONS`` on for those that count negatively."""
    mixed = (terms.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    negative = 1 - mixed % np.uint64(2)
    return ((mixed >> np.uint64(1)) % np.uint64(DIMENSIONS) + negative * np.uint64(DIMENSIONS)).astype(int)


def word_vectors(terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unit vectors of the words of documents that lie one after another."""
    width = 2 * DIMENSIONS
    at = np.repeat(np.arange(len(sizes)) * width, sizes) + _signed_slots(terms)
    sums = np.bincount(at, weights=counts / (counts + K1), minlength=len(sizes) * width).reshape(len(sizes), 2, -1)
    vectors = sums[:, 0] - sums[:, 1]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype("<f4")


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a text and how often each occurs."""
    ordered = np.sort(ids)
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ordered) - 1)
    counts = ends + 1
    counts[1:] -= ends[:-1] + 1
    return ordered[ends], counts.astype("<u4")


def _tokenise(path: str, window: int):
    def run(batches):
        encoder = encoder_of_worker(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                yield tokens_of(encoder, whole.slice(at, 1000))

    def tokens_of(encoder, batch):
        out = {"doc_tokens": [], "full": [], "rest": [], "terms": [], "counts": []}
        all_terms, all_counts = [], []
        end = np.array([END_ID], "<u4")
        for text in batch.column(1).to_pylist():
            found = np.concatenate([encoder.encode(text or ""), end])
            n = len(found)
            whole = n // window * window
            terms, counts = _counted(found)
            out["doc_tokens"].append(n)
            out["full"].append([zlib.crc32(found[i:i + window]) for i in range(0, whole, window)])
            out["rest"].append(found[whole:].tobytes())
            out["terms"].append(terms.tobytes())
            out["counts"].append(counts.tobytes())
            all_terms.append(terms)
            all_counts.append(counts)
        vectors = word_vectors(np.concatenate(all_terms), np.concatenate(all_counts),
                               np.array([len(t) for t in all_terms]))
        out["words"] = [v.tobytes() for v in vectors]
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)],
            ["doc_id", *out])

    return run


def fit_tree(vectors: np.ndarray, depth: int = TREE_DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the directions and cuts of its nodes. A node halves its vectors at the median along their main
    direction, found by power iteration."""
    levels, parts = [], [vectors.astype(float)]
    for _ in range(depth):
        directions, cuts, below = np.zeros((len(parts), DIMENSIONS)), np.zeros(len(parts)), []
        for i, part in enumerate(parts):
            if len(part):
                apart = part - part.mean(axis=0)
                along = apart[np.argmax((apart ** 2).sum(axis=1))]
                for _ in range(8):
                    along = along / max(np.linalg.norm(along), 1e-12)
                    along = apart.T @ (apart @ along)
                directions[i] = along / max(np.linalg.norm(along), 1e-12)
                cuts[i] = np.median(part @ directions[i])
            right = part @ directions[i] >= cuts[i]
            below += [part[~right], part[right]]
        levels.append((directions, cuts))
        parts = below
    return levels


def place_in_tree(levels: list[tuple[np.ndarray, np.ndarray]], vectors: np.ndarray) -> np.ndarray:
    """A number that grows from the tree's left end to its right one: the leaf, and in it the position along the
    direction that made it."""
    node = np.zeros(len(vectors), int)
    along = np.zeros(len(vectors))
    for directions, cuts in levels:
        along = np.einsum("ij,ij->i", vectors, directions[node])
        node = 2 * node + (along >= cuts[node])
    # vectors and directions are of length 1
    return node + (np.clip(along, -1, 1) + 1) / 2.001


def _count_terms(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
        found = np.bincount(terms, minlength=len(total))
        found[:len(total)] += total
        total = found
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])


def _inverted_index(docs: pd.DataFrame, idf: np.ndarray, mean_length: float):
    """Postings sorted by term: documents, BM25 weights, and for every document its list of (start, length). Terms in
    one of ``DENSE`` documents or more are rows over all documents instead, which takes at most ``DENSE`` times the
    room of their postings; for every document its list of such rows."""
    terms = [np.frombuffer(t, "<u4") for t in docs["terms"]]
    sizes = np.array([len(t) for t in terms])
    term = np.concatenate(terms)
    owner = np.repeat(np.arange(len(docs)), sizes)
    tf = np.concatenate([np.frombuffer(c, "<u4") for c in docs["counts"]]).astype(float)
    length = docs["doc_tokens"].to_numpy()[owner]
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
    order = np.argsort(term, kind="stable")
    _, local, n_postings = np.unique(term, return_inverse=True, return_counts=True)
    starts = np.cumsum(n_postings) - n_postings
    often = n_postings * DENSE >= len(docs)
    row_of = np.cumsum(often) - 1
    rows = np.zeros((int(often.sum()), len(docs)))
    dense = often[local]
    rows[row_of[local[dense]], owner[dense]] = weight[dense]
    bounds = np.cumsum(sizes) - sizes
    queries = []
    for b, s in zip(bounds, sizes, strict=True):
        asked, common = local[b:b + s], dense[b:b + s]
        queries.append((starts[asked[~common]], n_postings[asked[~common]], row_of[asked[common]]))
    return owner[order], weight[order], rows, queries


def _neighbours(index, seed: int, unused: np.ndarray):
    """Unused documents from the best score down; documents without a shared term come last, in order."""
    owner, weight, rows, queries = index
    starts, sizes, common = queries[seed]
    total = int(sizes.sum())
    at = np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    scores = np.bincount(owner[at], weights=weight[at], minlength=len(unused)) + rows[common].sum(axis=0)
    scores[~unused] = -1.0
    given, most = 0, 16
    while most < len(scores):
        best = np.argpartition(-scores, most)[:most]
        best = best[np.lexsort((best, -scores[best]))]
        yield from best[given:][scores[best[given:]] >= 0]
        if scores[best[-1]] < 0:
            return
        given, most = most, most * 4
    best = np.lexsort((np.arange(len(scores)), -scores))[given:]
    yield from best[scores[best] >= 0]


def pack_shard(docs: pd.DataFrame, idf: np.ndarray, mean_length: float, window: int = WINDOW) -> pd.DataFrame:
    """Pieces of one shard; its sequences are numbered from 0."""
    ids, totals, rests = docs["doc_id"].tolist(), docs["doc_tokens"].tolist(), docs["rest"].tolist()
    out = []
    sequence = 0

    for doc_id, total, full in zip(ids, totals, docs["full"], strict=True):
        for i, crc in enumerate(full if full is not None else []):
            out.append((doc_id, i * window, window, int(crc), total, sequence, 0))
            sequence += 1

    index = _inverted_index(docs, idf, mean_length)
    unused = np.array([len(r) > 0 for r in rests])
    done = [0] * len(ids)  # tokens of the rest that are placed

    def place(i, offset):
        left = len(rests[i]) // 4 - done[i]
        n = min(left, window - offset)
        piece = rests[i][4 * done[i]:4 * (done[i] + n)]
        start = totals[i] - len(rests[i]) // 4 + done[i]
        out.append((ids[i], start, n, zlib.crc32(piece), totals[i], sequence, offset))
        done[i] += n
        return offset + n

    seed, first = None, 0
    while True:
        if seed is None:
            while first < len(ids) and not unused[first]:
                first += 1
            if first == len(ids):
                break
            seed = first
            unused[seed] = False
        offset = place(seed, 0)
        cut = None
        if offset < window:
            for other in _neighbours(index, seed, unused):
                if not unused[other]:
                    continue
                unused[other] = False
                offset = place(other, offset)
                if offset == window:
                    cut = other if 4 * done[other] < len(rests[other]) else None
                    break
        elif 4 * done[seed] < len(rests[seed]):
            cut = seed
        sequence += 1
        seed = cut
    columns = [c.split()[0] for c in PIECES.split(", ")]
    frame = pd.DataFrame(out, columns=columns)
    return frame.astype({c: "Int64" if c == "doc_id" else "int64" for c in columns})


def _pack_runs(idf: np.ndarray, mean_length: float, shard_docs: int, window: int):
    """Cuts a task's ordered documents into shards and packs each. Sequence ids hold the task's number."""

    def run(frames):
        task, shard, waiting, n = TaskContext.get().partitionId(), 0, [], 0
        for frame in frames:
            while len(frame):
                taken, frame = frame.iloc[:shard_docs - n], frame.iloc[shard_docs - n:]
                waiting.append(taken)
                n += len(taken)
                if n == shard_docs:
                    yield packed(waiting, task, shard)
                    waiting, n, shard = [], 0, shard + 1
        if n:
            yield packed(waiting, task, shard)

    def packed(frames, task, shard):
        docs = pd.concat(frames, ignore_index=True)
        docs["doc_id"] = docs["doc_id"].astype("Int64").mask(docs["no_id"])
        pieces = pack_shard(docs, idf, mean_length, window)
        if pieces["sequence_id"].max() >> 24 or shard >> 16:
            raise ValueError("too many sequences in a shard, or shards in a task")
        pieces["sequence_id"] += (task << 40) + (shard << 24)
        return pieces

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of every row lies in one piece; a document ends with id 0, so an empty or null text is that id alone.
    Repeated rows and rows with a null id are documents of their own. Sequence ids are unique, not consecutive.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = stored(rows.mapInArrow(
        _tokenise(tokenizer_path, window),
        "doc_id long, doc_tokens long, full array<long>, rest binary, terms binary, counts binary, words binary"
    ).withColumn("row", F.monotonically_increasing_id()), "tokens")
    n_docs, n_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    # at most one row per id of the vocabulary
    found = tokens.select("terms").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(int(found["term"].max()) + 1 if len(found) else 1)
    frequency[found["term"].to_numpy(dtype=int)] = found["n"].to_numpy(dtype=float)
    idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
    mean_length = max(n_tokens / max(n_docs, 1), 1.0)

    # about FIT_DOCS vectors of 512 bytes
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(max(n_docs, 1))) < FIT_DOCS
    sample = [r[0] for r in tokens.filter(drawn).select("words").collect()]
    levels = fit_tree(np.frombuffer(b"".join(sample), "<f4").reshape(-1, DIMENSIONS))

    @pandas_udf("double")
    def place(words: pd.Series) -> pd.Series:
        return pd.Series(place_in_tree(levels, np.frombuffer(b"".join(words), "<f4").reshape(-1, DIMENSIONS)))

    # the row's number parts equal documents, so any number of them can be dealt to several tasks
    order = ["place", "doc_id", "row"]
    return tokens.withColumn("place", place("words")).drop("words").repartitionByRange(
        n_pieces(n_docs, TASK_DOCS), *order).sortWithinPartitions(*order).drop("place", "row").withColumns({
            # pandas would turn ids beside nulls into floats
            "doc_id": F.coalesce("doc_id", F.lit(0)), "no_id": F.isnull("doc_id"),
        }).mapInPandas(_pack_runs(idf, mean_length, shard_docs, window), PIECES)
