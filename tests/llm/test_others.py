"""Sharding, surrogates, scores, mixing, chat, packing and rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.conftest import ODD_ROWS, SF
from thermolake.llm import chat, mixing, packing, quality_model, quality_rules, registry, sharding, surrogates
from thermolake.llm.common import table
from thermolake.session import work_dir

# ---- sharding -----------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 20_000])
def test_shards_hold_every_row_once(spark, bucket_bytes):
    docs = table(spark, SF, "documents")
    shuffled = sharding.external_shuffle(docs, bucket_bytes=bucket_bytes)
    rows = sharding.shard_digest(shuffled).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_digest(sharding.external_shuffle(docs, bucket_bytes=bucket_bytes)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    # the order has nothing of the ids' order left
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def test_sharding_odd_rows(spark, odd, empty):
    rows = sharding.external_shuffle(odd, 4).collect()
    assert sorted((str(r.record.doc_id), str(r.record.text)) for r in rows) == sorted(
        (str(d), str(t)) for d, t in ODD_ROWS)
    assert all(r.record.bucket == 7 for r in rows)
    assert sorted(Counter(r.shard for r in rows).values()) == [3, 3, 3, 3]
    assert sharding.external_shuffle(empty).collect() == []
    few = sharding.external_shuffle(odd.limit(3), 16).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_written_shards_follow_the_slots(spark, odd):
    path = work_dir(spark, "shards")
    sharding.write_shards(sharding.external_shuffle(odd, 3), path)
    found = spark.read.parquet(path)
    assert found.count() == len(ODD_ROWS) and found.select("shard").distinct().count() == 3


# ---- surrogates -----------------------------------------------------------------

PRIVATE = [
    (1, "mail Ann.Lee@corp.example.com or ann.lee@corp.example.com, call +1 (415) 555-0134 or 415.555.0199"),
    (2, "card 4111 1111 1111 1111, again 4111111111111111, host 10.20.30.40, token = \"04dbebab91ab85687d33eeaa\""),
    (3, "Mr. John Smith met Mrs Anna Jones; MR. JOHN SMITH left; господин Иван Петров и госпожа Анна Петрова"),
    (4, "no private data: version 4.0, page 12, 3 of 4, date 2024-01-02, about 10000 words @ home"),
    (5, "ids 123-45-6789 and 04dbebab91ab85687d33eeaaf9ac699e1188f962!!, x"),
    (6, None), (7, ""),
]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


@pytest.fixture(scope="module")
def rewritten(spark):
    df = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    return {r.record.doc_id: r for r in surrogates.pseudonymise(df, key="k1").collect()}


def test_entities_are_gone_and_the_rest_stays(rewritten):
    assert [rewritten[i].n_entities for i in range(1, 8)] == [4, 4, 5, 0, 2, 0, 0]
    assert (rewritten[4].text, rewritten[6].text, rewritten[7].text) == (PRIVATE[3][1], None, "")
    for gone in ("ann.lee@corp", "555-0134", "555.0199", "4111", "10.20.30.40", "04dbebab", "Smith", "SMITH", "Jones",
                 "Петров", "123-45-6789"):
        assert all(gone not in (r.text or "") for r in rewritten.values()), gone
    assert rewritten[1].text.startswith("mail ") and ", call +1 (" in rewritten[1].text


def test_types_formats_and_coreference(rewritten):
    a, b = re.findall(r"\S+@\S+\.com", rewritten[1].text)
    assert a.lower().rstrip(",") == b.lower().rstrip(",") and a[0].isupper() and b[0].islower()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}\.\d{3}\.\d{4}$", rewritten[1].text)
    spaced, plain = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", rewritten[2].text)
    assert spaced.replace(" ", "") == plain and luhn(plain)
    assert all(0 < int(x) < 256 for x in re.search(r"host (\S+),", rewritten[2].text)[1].split("."))
    assert re.search(r'token = "[0-9a-f]{24}"$', rewritten[2].text)
    assert re.search(r"ids \d{3}-\d{2}-\d{4} and [0-9a-f]{40}!!, x$", rewritten[5].text)


def test_names_keep_title_gender_and_script(rewritten):
    said = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); MR\. (\w+) (\w+) left; господин (\w+) (\w+) и госпожа "
                    r"(\w+) (\w+)$", rewritten[3].text).groups()
    assert said[0] in surrogates.NAMES["latin", "male"] and said[1] in surrogates.NAMES["latin", "family"]
    assert said[2] in surrogates.NAMES["latin", "female"]
    assert (said[4], said[5]) == (said[0].upper(), said[1].upper())
    assert said[6] in surrogates.NAMES["cyrillic", "male"] and said[8] in surrogates.NAMES["cyrillic", "female"]


def test_another_key_gives_other_surrogates(spark, rewritten):
    df = spark.createDataFrame(PRIVATE[:2], "doc_id long, text string")
    other = {r.record.doc_id: r.text for r in surrogates.pseudonymise(df, key="k2").collect()}
    assert all(other[i] != rewritten[i].text for i in (1, 2))


def test_collisions_are_drawn_again(spark, monkeypatch):
    """Names of one given word have few surrogates: all must differ in the end."""
    letters = "ABCDEFGHIJKLMNOP"
    df = spark.createDataFrame([(i, f"met Herr {c}xyz today") for i, c in enumerate(letters)], "doc_id long, text string")
    drawn = surrogates.draw_surrogates(surrogates.entities(df))
    rows = drawn.collect()
    assert len({r.drawn for r in rows}) == len(rows) == 16 and max(r.draw for r in rows) > 0
    texts = [r.text for r in surrogates.pseudonymise(df).collect()]
    assert len(set(texts)) == 16 and set(texts) == {f"met Herr {r.drawn.split(' ')[1].capitalize()} today" for r in rows}


def test_many_names_stay_distinct(spark):
    """More names of a title and script than there are fixed ones."""
    def written(n, letters):
        return "".join(letters[n // 12 ** k % 12] for k in range(4)).capitalize()

    scripts = [("Mr", "abcdefghijkl"), ("госпожа", "абвгдежзиклм"), ("κύριος", "αβγδεζηθικλμ")]
    said = [f"{title} {written(n, letters)}" + f" {written(n * 7 + 1, letters)}" * (n % 2)
            for title, letters in scripts for n in range(3000)]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    rows = surrogates.draw_surrogates(surrogates.entities(df)).collect()
    drawn = {r.drawn for r in rows}
    assert len(drawn) == len(rows) == len(set(said)) == 9000 and not drawn & {r.canon for r in rows}
    texts = [r.text for r in surrogates.pseudonymise(df).collect()]
    assert len(set(texts)) == 9000 and {t.lower() for t in texts} == drawn


def test_short_addresses_and_masked_secrets_find_free_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    said = [f"{a}@{b}.com" for a in letters for b in letters] + ['password = "********"']
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    texts = {r.text for r in surrogates.pseudonymise(df).collect()}
    assert len(texts) == len(said) and not texts & set(said)


def test_titles_in_any_case(spark):
    titles = ["Господин", "ГОСПОДИН", "Госпожа", "ГОСПОЖА", "Κύριος", "ΚΎΡΙΟΣ", "ΚΥΡΙΟΣ", "Κυρία", "ΚΥΡΊΑ", "ΚΥΡΙΑ",
              "SEÑOR", "SEÑORA"]
    names = {"Γ": "Ιωάννης Παππάκης", "Г": "Семён Рыжков", "S": "Pedro Lopez"}
    said = [f"{t} {names['Г' if 'А' <= t[0] <= 'Я' else 'S' if t[0] == 'S' else 'Γ']}" for t in titles]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for row in surrogates.pseudonymise(df).collect():
        was, now = said[row.record.doc_id].split(), row.text.split()
        assert row.n_entities == 1 and now[0] == was[0] and not set(now[1:]) & set(was[1:]), row
        script = {"Г": "cyrillic", "S": "latin"}.get(was[0][0], "greek")
        gender = "female" if was[0][-1] in "аАαΑaA" else "male"
        assert now[1] in surrogates.NAMES[script, gender], row


def test_numbers_stay_distinct_and_alike_however_written(spark):
    few = [f"+1 {i // 20 + 10} {i % 20 + 30}" for i in range(400)]
    same = ["call +1 415 555 0134 or 1 415 555 0134 or 1-415-555-0134", "(415) 555-0134 and 415.555.0134"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*few, *same])], "doc_id long, text string")
    found = {r.record.doc_id: r.text for r in surrogates.pseudonymise(df).collect()}
    drawn = [re.sub(r"\D", "", found[i]) for i in range(400)]
    assert len(set(drawn)) == 400 and not set(drawn) & {re.sub(r"\D", "", t) for t in few}
    numbers = {re.sub(r"\D", "", part)[-10:] for i in (400, 401)
               for part in re.split(" or | and |call ", found[i]) if part}
    assert len(numbers) == 1 and numbers != {"4155550134"}
    assert re.fullmatch(r"call \+1 \d{3} \d{3} \d{4} or 1 \d{3} \d{3} \d{4} or 1-\d{3}-\d{3}-\d{4}", found[400])
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4} and \d{3}\.\d{3}\.\d{4}", found[401])


def test_names_with_more_words_and_spaces(spark):
    df = spark.createDataFrame([(0, "Mr  John Smith said"), (1, "Mr Li Wei Chen said"), (2, "Frau  Ada King")],
                               "doc_id long, text string")
    found = {r.record.doc_id: r.text for r in surrogates.pseudonymise(df).collect()}
    assert re.fullmatch(r"Mr  \w+ \w+ said", found[0]) and not re.search("John|Smith", found[0])
    assert re.fullmatch(r"Mr \w+ \w+ \w+ said", found[1]) and not re.search("Li|Wei|Chen", found[1])
    assert re.fullmatch(r"Frau  \w+ \w+", found[2]) and not re.search("Ada|King", found[2])


def test_expressions_of_surrogates_are_not_multiplied(spark, documents):
    """The driver holds every plan: what is used in several places is computed once and named."""
    df = documents([(1, "write to a@b.example or call 555-123-4567"), (2, "Mr Smith"), (3, None)])
    plan = surrogates.pseudonymise(df)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 60_000


def test_surrogates_odd_rows(odd, empty):
    rows = surrogates.pseudonymise(odd).collect()
    assert sorted((str(r.record.doc_id), str(r.text)) for r in rows) == sorted((str(d), str(t)) for d, t in ODD_ROWS)
    assert surrogates.pseudonymise(empty).collect() == []


# ---- quality model ------------------------------------------------------------------


def test_scores_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.op4_quality_scores(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, q in held if q == v] for v in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.95
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.9


def test_threshold_is_the_rank_among_all_training_documents(spark, monkeypatch):
    """A small sample, and bad labels without a document or repeated, leave the threshold where all labels put it."""
    monkeypatch.setattr(quality_model, "FEW", 20)
    monkeypatch.setattr(quality_model, "BINS", 8)
    rng = np.random.default_rng(2)
    texts = [" ".join("w" * int(n) for n in rng.integers(1, 12, int(rng.integers(5, 60)))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quality = {i: int(len(t) > 150) for i, t in enumerate(texts)}
    said = [*quality.items(), *[(i, 0) for i in range(1000, 2000)], *[(i, q) for i, q in quality.items() if q == 0] * 3]
    labels = spark.createDataFrame(said, "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_model.quality_scores(docs, labels, sample=20).collect()}
    training = [i for i in quality if zlib.crc32(str(i).encode()) % 5]
    bad = sum(quality[i] == 0 for i in training)
    assert sorted(scores[i] for i in training)[bad - 1] == pytest.approx(0.3, abs=1e-9)


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (5, 1), (4, 1), (99, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert len(quality_model.quality_scores(odd, labels).collect()) == len(ODD_ROWS)
    assert len(quality_model.quality_scores(odd, labels.limit(0)).collect()) == len(ODD_ROWS)
    assert quality_model.quality_scores(empty, labels).collect() == []


# ---- mixing ---------------------------------------------------------------------------


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixture_meets_its_limit(spark):
    docs = table(spark, SF, "documents").withColumn(
        "source", F.when(F.col("doc_id") < 100, "big").when(F.col("doc_id") < 140, "mid").otherwise("small"))
    tokens = defaultdict(int)
    for r in docs.collect():
        tokens[r.source] += words(r.text)
    rows = mixing.mix(docs, max_repetition=1.5).collect()
    taken, copies = defaultdict(int), Counter(r.doc_id for r in rows)
    for r in rows:
        taken[r.source] += r.tokens
    assert set(copies) == {r.doc_id for r in docs.collect()} and max(copies.values()) <= 2
    ratio = {s: taken[s] / tokens[s] for s in tokens}
    assert max(ratio.values()) <= 1.5 + 0.2 and min(ratio.values()) == 1
    # shares follow one exponent
    shares = {s: t / sum(tokens.values()) for s, t in tokens.items()}
    weights = {r.source: r.weight for r in rows}
    exponent = {round(math.log(weights[a] / weights[b]) / math.log(shares[a] / shares[b]), 4)
                for a, b in (("big", "mid"), ("big", "small"))}
    assert len(exponent) == 1 and sum(weights.values()) == pytest.approx(1)
    for s in tokens:  # places run through each stream
        places = [r.place for r in rows if r.source == s]
        assert min(places) == 0 and max(places) < 1


def test_target_entropy_is_met(spark):
    totals = spark.createDataFrame([("a", 8000, 1), ("b", 1500, 1), ("c", 500, 1)], "key string, total long, n_docs long")
    for target in (0.7, 0.9, 1.05):
        exponent = mixing.choose_exponent(totals, target_entropy=target)
        p = np.array([8000.0, 1500, 500]) ** exponent
        p /= p.sum()
        assert -(p * np.log(p)).sum() == pytest.approx(target, abs=1e-3)
    assert mixing.choose_exponent(totals, target_entropy=5.0) == 0.0
    assert mixing.choose_exponent(totals, max_repetition=1.0) == pytest.approx(1.0)


def test_a_round_is_one_small_plan(spark, monkeypatch):
    """The exponents of the grid are rows, not columns of their own."""
    totals = spark.createDataFrame([("a", 1000, 10), ("b", 100, 10), ("c", 7, 1), ("d", 0, 1)],
                                   "key string, total long, n_docs long")
    made = []
    measures = mixing._measures
    monkeypatch.setattr(mixing, "_measures", lambda *args: made.append(args) or measures(*args))
    exponent = mixing.choose_exponent(totals, 1.5)
    share = [t / 1107 for t in (1000, 100, 7)]
    repetition = lambda e: max(s ** (e - 1) for s in share) / min(s ** (e - 1) for s in share)
    assert repetition(exponent) <= 1.5 + 1e-9 < repetition(exponent - 1e-6)
    assert len(made) == mixing.ROUNDS


def test_budget_beyond_the_repetition_limit_is_an_error(documents):
    docs = documents([(3 * n, "five words are in here") for n in range(20)])  # one source
    assert mixing.mix(docs, budget=150, max_repetition=1.5).count() == 30
    with pytest.raises(ValueError, match="need more than 1.5 uses"):
        mixing.mix(docs, budget=1000, max_repetition=1.5)


def test_budget_is_kept(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.mix(docs, budget=20_000, max_repetition=3).collect()
    assert 20_000 <= sum(r.tokens for r in rows) < 20_000 + 20 * 4_000
    again = mixing.mix(docs, budget=20_000, max_repetition=3).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd.withColumn("source", F.when(F.col("doc_id") != 4, F.col("source"))), carry=["doc_id", "key"])
    found = rows.collect()
    assert {r.doc_id for r in found} == {d for d, _ in ODD_ROWS} and all(r.record.key == "x" for r in found)
    assert mixing.mix(empty).collect() == []


# ---- chat -----------------------------------------------------------------------------

CONTROL = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|start|>x", "<<SYS>>a<</SYS>>", "[\\INST]", "<s", "", None]


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = registry.op7_chat_prefix_targets(spark, SF)
    wanted = con.execute(registry.OP7_SQL).to_arrow_table().select(found.columns).to_pylist()
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r.values()) for r in wanted)


def test_controls_survive_the_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(CONTROL)] + [
        (2, 0, "system<|sep|>", "a"), (2, 1, None, "b"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"),
        (None, 1, "user", "q"), (None, None, "user", "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.prefix_targets(df)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by_conv = defaultdict(list)
    for c, i, role, text in rows:
        by_conv[c].append((-1 if i is None else i, role or "", text or ""))
    for c, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert back[c].n_turns == len(turns)
        assert back[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (back[c].loss_chars, back[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = examples.filter("conv_id = 1 AND n_turns = 2").first()
    assert first.formatted[first.loss_start:first.loss_start + first.loss_length] == "<\\|end|>"
    assert chat.prefix_targets(df.limit(0)).collect() == []


# ---- packing ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(corpus_pipeline.tokenizer_path())


def assert_packed(rows, texts, tokenizer, window=packing.WINDOW):
    """Rows of documents with unique ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            piece = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece)) and r.length > 0
            at += r.length
        assert at == len(ids)
    assert not by_doc
    used = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        used.append(at)
    return used


@pytest.mark.parametrize("shard_docs", [1024, 16])
def test_pieces_cover_every_id(spark, tokenizer, shard_docs):
    docs = table(spark, SF, "documents")
    rows = packing.pack(docs, corpus_pipeline.tokenizer_path(), shard_docs=shard_docs).collect()
    used = assert_packed(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    n_shards = -(-docs.count() // shard_docs)
    assert sum(1024 - n for n in used) <= 1024 * n_shards


def test_packing_odd_texts(documents, tokenizer, empty):
    texts = dict(enumerate([None, "", " ", "  two  spaces ", "tab\there\n\nlines \n x", "a　b\x1cc", " lead", "trail ",
                            "<|endoftext|> as text", "x" * 5000, "long words " * 20_000, "é 漢字 🙂 done"]))
    rows = packing.pack(documents(list(texts.items())), corpus_pipeline.tokenizer_path()).collect()
    assert_packed(rows, texts, tokenizer)
    assert packing.pack(empty, corpus_pipeline.tokenizer_path()).collect() == []


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    encoder = packing.Encoder(corpus_pipeline.tokenizer_path())
    assert encoder.fast is not None
    draw = random.Random(1)
    parts = ["a", "B", "don't", "'S", "é", "9", "²", "12", ".", "!?", " ", " ", "\n", "\n\n", "\t", "\xa0", "\r\n", "\0",
             "\x1c", "\x85", "<|", "<|endoftext|>", "漢", "٣", "🙂", "\u200b", "\u0301"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(20_000)]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}.{chr(c)}" for c in range(0x3000)]
    texts += ["x" * 50_000, " " * 2_000_000 + "a", "\n" * 5000, "." * 50_000]
    wanted = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, wanted, strict=True) if encoder.encode(t).tolist() != w.ids] == []


def test_encoder_makes_no_list_of_numbers(tokenizer, monkeypatch):
    encoder = packing.Encoder(corpus_pipeline.tokenizer_path())
    monkeypatch.setattr(packing.np, "fromiter", None)
    found = encoder.encode("it's  a\n\n b ")
    assert found.dtype == "<u4" and found.tolist() == tokenizer.encode("it's  a\n\n b ", add_special_tokens=False).ids


def test_ids_are_counted():
    draw = random.Random(2)
    for n in (1, 2, 50, 1000):
        ids = np.array(draw.choices([0, 1, 7, 2**32 - 1], k=n), "<u4")
        found, wanted = packing._counted(ids), np.unique(ids, return_counts=True)
        assert [f.tolist() for f in found] == [w.tolist() for w in wanted]


def test_other_tokenizer_files_are_not_taken_for_byte_level_bpe():
    import json

    with open(corpus_pipeline.tokenizer_path(), encoding="utf-8") as file:
        spec = json.load(file)
    assert len(packing.byte_ranks(spec)) == len(spec["model"]["vocab"]) - sum(
        t["content"] in spec["model"]["vocab"] for t in spec["added_tokens"])
    assert packing.byte_ranks(spec | {"normalizer": {"type": "Lowercase"}}) is None
    assert packing.byte_ranks(spec | {"pre_tokenizer": {"type": "Whitespace"}}) is None
    model = spec["model"]
    assert packing.byte_ranks(spec | {"model": model | {"merges": model["merges"][::-1]}}) is None


def test_related_documents_stand_together(spark, documents):
    """Copies, and documents of one topic, share a shard far more often than by chance."""
    rng = np.random.default_rng(8)
    topics = [[f"{w}{i}" for i in range(80)] for w in ("ruby", "opal", "jade", "onyx", "zinc", "iron", "lead", "gold")]
    texts = [(n, " ".join(rng.choice(topics[n % 8], 60))) for n in range(400)]
    texts += [(400 + n, texts[n][1]) for n in range(0, 400, 4)]
    rows = packing.pack(documents(texts), corpus_pipeline.tokenizer_path(), shard_docs=32).collect()
    shard = {r.doc_id: r.sequence_id >> 24 for r in rows}
    copies = [shard[400 + i] == shard[i] for i in range(0, 400, 4)]
    assert np.mean(copies) > 0.9
    same = [len({d % 8 for d, s in shard.items() if s == wanted and d < 400}) for wanted in set(shard.values())]
    assert np.mean(same) < 4


def test_packing_one_id_on_a_third_of_the_rows(spark, documents, tokenizer):
    texts = [(None if n % 3 == 0 else n, "same words again" if n % 3 == 0 else f"text number {n}") for n in range(900)]
    rows = packing.pack(documents(texts), corpus_pipeline.tokenizer_path(), shard_docs=64).collect()
    assert sum(r.length for r in rows) == sum(
        len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(r.doc_id is None for r in rows) >= 300 and sum(r.start == 0 for r in rows) == 900


def test_packing_keeps_large_ids_beside_nulls(documents):
    rows = packing.pack(documents([(None, "a"), (2 ** 62 + 1, "b")]), corpus_pipeline.tokenizer_path()).collect()
    assert {r.doc_id for r in rows} == {None, 2 ** 62 + 1}


def test_packing_odd_rows(odd, tokenizer):
    rows = packing.pack(odd, corpus_pipeline.tokenizer_path()).collect()
    wanted = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD_ROWS)
    assert sum(r.length for r in rows) == wanted
    assert {r.doc_id for r in rows} == {d for d, _ in ODD_ROWS}


def test_related_documents_share_windows(documents):
    topics = [[f"{w}{i}" for i in range(60)] for w in ("ruby", "opal", "jade", "onyx")]
    rng = np.random.default_rng(3)
    texts = [(n, " ".join(rng.choice(topics[n % 4], 100))) for n in range(64)]
    rows = packing.pack(documents(texts), corpus_pipeline.tokenizer_path()).collect()
    by_sequence = defaultdict(set)
    for r in rows:
        by_sequence[r.sequence_id].add(r.doc_id % 4)
    assert sum(len(s) for s in by_sequence.values()) < 1.6 * len(by_sequence)


def test_neighbours_come_by_bm25_score():
    import pandas as pd

    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 30, rng.integers(5, 60)) for _ in range(80)]
    counted = [np.unique(t, return_counts=True) for t in texts]
    frame = pd.DataFrame({"doc_tokens": [len(t) for t in texts],
                          "terms": [c[0].astype("<u4").tobytes() for c in counted],
                          "counts": [c[1].astype("<u4").tobytes() for c in counted]})
    idf, mean = np.log1p(np.arange(1, 31)), np.mean([len(t) for t in texts])
    index = packing._inverted_index(frame, idf, mean)
    unused = np.ones(80, bool)
    unused[[0, 7, 9]] = False
    found = list(packing._neighbours(index, 0, unused))

    def score(d):
        total = 0.0
        for term in counted[0][0]:
            tf = int((texts[d] == term).sum())
            total += idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))
        return total

    assert sorted(found) == [d for d in range(80) if unused[d]]
    scores = [score(d) for d in found]
    assert all(a >= b - 1e-9 for a, b in zip(scores, scores[1:], strict=False))


# ---- quality rules ----------------------------------------------------------------------


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(repeated))


def test_word_statistics_equal_brute_force(spark, odd):
    lines = spark.createDataFrame([
        (1, "a\n\n\n\nb\n \n \t\n \nc"), (2, "\n\n\n"), (3, "x\ny\nx\n \nx"), (4, "a \na\na \n\v\n\v"), (5, "\u00a0\n\u00a0\n"),
    ], "doc_id long, text string")
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text")).union(lines)
    rows = quality_rules.word_statistics(docs).collect()
    found = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == Counter(brute_statistics(r.text) for r in docs.collect())


def test_binomial_bound_is_exact(spark):
    def cdf(n, k, p):
        return sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))

    cases = [(n, k) for n in (1, 10, 200, 700) for k in (0, 1, 5, 20) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long").select(
        "n", "k", F.exp(quality_rules.log_binomial_cdf(F.col("n"), F.col("k"), 0.01)).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(cdf(r.n, r.k, 0.01), rel=1e-9)
    far = spark.createDataFrame([(1_000_000, 9_000)], "n long, k long").select(
        quality_rules.log_binomial_cdf(F.col("n"), F.col("k"), 0.01).alias("p")).first().p
    assert -60 < far < -40


def rule_input(spark, n_good, n_bad, lang="en"):
    good = [(i, " ".join(f"word{(i * 7 + j) % 997}" for j in range(30)), lang) for i in range(n_good)]
    bad = [(10**6 + i, " ".join(f"##%%${(i * 5 + j) % 997}" for j in range(30)), lang) for i in range(n_bad)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in good] + [(d, 0) for d, *_ in bad], "doc_id long, quality int")
    return docs, labels


def test_rules_act_only_where_labels_prove_them(spark):
    docs, labels = rule_input(spark, 900, 20)
    judged = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(judged[i].kept for i in range(900))
    assert all(judged[10**6 + i].reason == "symbols_per_word" for i in range(20))
    few, few_labels = rule_input(spark, 90, 20)
    assert all(r.kept for r in quality_rules.judge(few, few_labels).collect())


def brute_cutoffs(rows, max_risk, error):
    """{stratum: {rule: cutoff}} from (stratum, good, measures) rows, with the bound summed up exactly."""
    strata, chosen, gone = sorted({r[0] for r in rows}), defaultdict(dict), set()
    p = max_risk / len(quality_rules.RULES)
    limit = error / (len(strata) * len(quality_rules.RULES))
    for rule, cutoffs in quality_rules.RULES.items():
        for stratum in strata:
            mine = [(i, good, m[rule]) for i, (s, good, m) in enumerate(rows) if s == stratum]
            n, best = sum(good for _, good, _ in mine), None
            for c in cutoffs:
                k = sum(good and m > c for _, good, m in mine)
                if sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)) > limit:
                    break
                caught = sum(not good and m > c and i not in gone for i, good, m in mine)
                if caught and (best is None or caught > best[0]):
                    best = (caught, c)
            if best:
                chosen[stratum][rule] = best[1]
        gone |= {i for i, (s, _, m) in enumerate(rows) if m[rule] > chosen[s].get(rule, math.inf)}
    return chosen


def test_cutoffs_and_verdicts_equal_brute_force(spark):
    """Two strata, each with documents that only one of three rules can reject."""
    rng, docs, labels = random.Random(4), [], []
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    kinds = [lambda: plain(30).replace("w", "#" * rng.randint(2, 5)), lambda: plain(30).translate(str.maketrans("0123456789w", "ABCDEFGHIJK")),
             lambda: "\n".join([plain(12), *["same line"] * rng.randint(1, 5), plain(12)])]
    for lang, n in (("en", 700), ("de", 800)):
        for i in range(n + 60):
            good = i < n
            odd_one = not good or i == 5
            docs.append((len(docs), rng.choice(kinds[:2] if lang == "en" else kinds)() if odd_one else plain(40), lang))
            labels.append((len(labels), int(good)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    judged = {r.doc_id: r for r in quality_rules.judge(
        frame, spark.createDataFrame(labels, "doc_id long, quality int"), max_risk=0.06).collect()}

    def measured(r):
        return {"symbols_per_word": r.n_symbols / max(r.n_words, 1), "repeated_word_share": r.n_repeat_words / max(r.n_words, 1),
                "repeated_line_share": r.n_dup_lines / max(r.n_lines, 1), "mean_word_length": r.word_chars / max(r.n_words, 1),
                "upper_share": r.n_upper / max(r.word_chars, 1)}

    rows = [(judged[d].stratum, labels[d][1] == 1, measured(judged[d])) for d, *_ in docs if not judged[d].base_failed]
    cutoffs = brute_cutoffs(rows, 0.06, quality_rules.CONFIDENCE_ERROR)
    assert sorted(cutoffs) == ["de", "en"] and all(len(c) >= 2 for c in cutoffs.values()), cutoffs
    for r in judged.values():
        broken = [rule for rule, m in measured(r).items() if m > cutoffs[r.stratum].get(rule, math.inf)]
        assert r.kept == (not broken and not r.base_failed)
        assert r.reason == ("base" if r.base_failed else broken[0] if broken else None)


def test_false_rejections_stay_within_the_bound(spark):
    """Good documents of which 3 % look bad: no symbol rule may reject them, as its share of the risk is 1 %."""
    docs, labels = rule_input(spark, 970, 30)
    labels = labels.withColumn("quality", F.lit(1))
    assert all(r.kept for r in quality_rules.judge(docs, labels).collect())


def test_rules_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, None), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(odd, labels).collect()
    assert len(rows) == len(ODD_ROWS) and not any(r.kept for r in rows if r.doc_id in (1, 2, 3, 4, 5, 7))
    assert quality_rules.judge(empty, labels).collect() == []
    assert len(quality_rules.judge(odd, labels.limit(0)).collect()) == len(ODD_ROWS)


def test_null_stratum_is_a_stratum(spark):
    docs, labels = rule_input(spark, 900, 5)
    judged = quality_rules.judge(docs.withColumn("lang", F.lit(None).cast("string")), labels)
    assert judged.filter("NOT kept").count() == 5
