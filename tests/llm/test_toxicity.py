import random
import zlib

import numpy as np
import pytest
from llm.conftest import ODD_ROWS
from pyspark.sql import functions as F

from thermolake.llm import toxicity as tx

RUDE = ["snarfle", "grobnik", "blatherskite"]


def plain_runs(text):
    """Character runs inside words, borders as spaces, by slicing."""
    words = [f" {w} " for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text.lower()).split(" ") if w]
    return sum(len(w) - n + 1 for w in words for n in (3, 4, 5) if len(w) >= n)


@pytest.mark.parametrize("text", ["", " ", "a", "ab cd", "one  two\n three", "ünï 漢字 a b", "x" * 40])
def test_all_runs_are_taken(text):
    assert sum(len(part) for part in tx.subwords(text)) == plain_runs(text)


def test_long_texts_in_stretches(monkeypatch):
    text = "some words of many kinds " * 400
    whole = tx.bag(text)
    monkeypatch.setattr(tx, "_CHUNK", 37)
    pieces = tx.bag(text)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        said = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            said[rng.randrange(len(said))] = rng.choice(RUDE)
        docs.append((i, " ".join(said)))
        labels.append((i, int(toxic), 1))
    return docs, labels


def frames(spark, documents, n):
    docs, labels = corpus(n)
    return documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_learns_words_and_their_misspellings(spark, documents):
    docs, labels = frames(spark, documents, 600)
    more = documents([(9001, "a snarfel and grobnyk of blatherskyte snarfless"), (9002, "amen dust merlin"), (9003, "")])
    found = {r.doc_id: r for r in tx.toxicity_scores(docs.unionByName(more), labels).collect()}
    out = [i for i in range(600) if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    right = sum(found[i].predicted == (i % 4 == 0) for i in out)
    assert right >= 0.95 * len(out)
    assert found[9001].predicted == 1 and found[9002].predicted == 0 and found[9003].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_held_out_labels_are_never_read(spark, documents):
    docs, labels = frames(spark, documents, 200)
    other = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = [sorted(tx.toxicity_scores(docs, x, epochs=2).collect()) for x in (labels, other)]
    assert a == b


def test_folded_table_is_the_average_model():
    docs, labels = corpus(80)
    folded, empty = tx.train([tx.bag(t) for _, t in docs], np.array([y for _, y, _ in labels]), epochs=3)
    again, _ = tx.train([tx.bag(t) for _, t in docs], np.array([y for _, y, _ in labels]), epochs=3)
    assert (folded == again).all()
    held, counts = tx.bag(docs[0][1])
    assert np.isclose(np.average(folded[held], weights=counts),
                      np.mean(np.concatenate([folded[p] for p in tx.subwords(docs[0][1])])), rtol=1e-4)


def test_odd_rows(spark, documents, odd):
    docs, labels = frames(spark, documents, 120)
    strange = labels.unionByName(spark.createDataFrame(
        [(None, 1, 1), (5, None, 1), (6, 7, 1), (99999, 1, 1), (8, 0, 1), (8, 1, 1)], labels.schema))
    rows = tx.toxicity_scores(docs.unionByName(odd), strange, epochs=1).collect()
    assert len(rows) == 120 + len(ODD_ROWS)
    assert all(r.score is not None and r.held_out is not None for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    same = [r.score for r in rows if r.doc_id == 9 and r.score is not None]
    assert len(same) == 3


def test_without_labels(spark, documents, empty):
    docs, labels = frames(spark, documents, 20)
    assert {r.score for r in tx.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in tx.toxicity_scores(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    assert tx.toxicity_scores(empty, labels).count() == 0


def test_sample_is_bounded_and_steady(spark, documents):
    docs, labels = frames(spark, documents, 200)
    first = sorted(tx.toxicity_scores(docs, labels, limits={1: 20, 0: 30}, epochs=2).collect())
    again = sorted(tx.toxicity_scores(docs.repartition(7), labels.repartition(3), limits={1: 20, 0: 30}, epochs=2).collect())
    assert first == again
