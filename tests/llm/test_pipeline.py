"""The pipeline: stages one by one against what each must do, and its packed result."""

import re

import pytest

import corpus_pipeline
from llm.conftest import SF
from llm.test_dedup import brute_components
from llm.test_others import brute_statistics
from thermolake.llm import surrogates
from thermolake.llm.common import DOCUMENT_COLUMNS, stored, table


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = (docs, stored(stage(spark, docs, SF), name))
        docs = found[name][1]
    return found


def test_all_but_the_last_return_documents(stages):
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == DOCUMENT_COLUMNS
        assert stages[name][1].count() > 0


def test_rejected_documents_go(stages):
    before, after = stages["quality_rules"]
    kept = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        n, _, _, _, repeated = brute_statistics(r.text)
        # 200 documents hold too few labels to prove a cutoff, so the base rule decides
        assert (r.doc_id in kept) == (n >= 10 and 100 * repeated <= 20 * n)
        assert kept.get(r.doc_id, r.text) == r.text


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    groups = brute_components({r.doc_id: r.text for r in before.collect()}, corpus_pipeline.SIMILARITY_PERCENT)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in groups.items() if c == d)


def test_private_data_goes_and_clean_text_stays(stages):
    before, after = stages["pii"]
    texts = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        found = [m for m in re.findall(r"\S+@mail\d+\.example\.com|\d+\.\d+\.\d+\.\d+|\b\d{16}\b|555-\d{4}", r.text)]
        assert all(m not in texts[r.doc_id].text for m in found)
        assert found or "token" in r.text or texts[r.doc_id].text == r.text
        assert texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
    assert surrogates.entities(before).count() > 0


def test_every_document_is_in_the_mixture(stages):
    before, after = stages["mixing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    assert after.count() <= 2 * before.count()


def test_packed_rows(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    wanted = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    assert sum(r.length for r in after.collect()) == wanted


def test_run_gives_the_same_pieces(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages["packing"][1].collect()))
