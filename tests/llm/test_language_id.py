import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import language_id as li
from termloom.llm.queries import op6_language_id

TRAIN = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the house of the king", "en"), (4, "la maison du roi", "fr"), (5, None, "en"), (6, "ignored", None)]


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))


def test_words_come_first_then_shorter_grams(model):
    assert model.languages == ["en", "fr"]
    assert (model.word("the") == model.scores[model.tables[0]["the"]]).all()
    four = li.grams("thex", 4)
    assert any(g in model.tables[4] for g in four)
    assert model.word("thex").argmax() == 0 and model.word("maisx").argmax() == 1
    assert (model.word("日") == 0).all()


def test_defined_results(spark, model):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the the", "x"), (5, "le roi " * 50_000, "x"), (4, "the the", "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(rows, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "fr" and all(0 <= s <= 1 for _, s in got.values())
    assert li.predict(rows.limit(0), model).count() == 0


def test_remembered_words_are_bounded_and_the_model_travels_once(spark, monkeypatch):
    monkeypatch.setattr(li, "SEEN", 3)
    model = li.fit(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))
    words = ["the", "thex", "roi", "roix", "zzz", "the", "maisx"]
    twice = [[model.word(w).copy() for w in words] for _ in range(2)]
    assert all((a == b).all() for a, b in zip(*twice, strict=True)) and len(model.seen) <= 3
    assert model.shared(spark) is model.shared(spark)


def test_nothing_to_learn_from(spark):
    none = li.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in li.predict(rows, none).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97


def plain_scores(training, texts):
    """The method in plain Python: words, then n-grams, each scored by its log share in a language less the languages' mean."""
    words_of = lambda t: [w for w in re.split(r"[\W\d_]+", t.lower()) if w]
    languages = sorted({lang for _, lang in training})
    tables = defaultdict(lambda: defaultdict(Counter))
    for text, lang in training:
        for w in words_of(text):
            tables[0][w][lang] += 1
            for size in li.SIZES:
                for g in li.grams(w, size):
                    tables[size][g][lang] += 1
    totals = {size: {x: sum(c[x] for c in t.values()) for x in languages} for size, t in tables.items()}

    def scored(size, gram):
        t = tables[size]
        shares = [math.log((t[gram][x] + 0.5) / (totals[size][x] + 0.5 * len(t))) for x in languages]
        return np.array(shares) - sum(shares) / len(shares)

    out = []
    for text in texts:
        total, words = np.zeros(len(languages)), words_of(text)
        for w in words:
            if w in tables[0]:
                total += scored(0, w)
                continue
            for back, size in enumerate(li.SIZES, 1):
                if hits := [g for g in li.grams(w, size) if g in tables[size]]:
                    total += li.BACKOFF**back * sum(scored(size, g) for g in hits) / len(hits)
                    break
        if not words:
            out.append(("und", 0.0))
            continue
        p = np.exp((total - total.max()) / math.sqrt(len(words)))
        out.append((languages[int(total.argmax())], float(1 / p.sum())))
    return out


def test_every_row_equals_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(li, "WORDS_KEPT", 10**6)
    monkeypatch.setattr(li, "GRAMS_KEPT", 10**6)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    training = [(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None]
    want = plain_scores(training, [r.text for r in docs])
    got = {r.doc_id: r for r in op6_language_id(spark, sf).collect()}
    for r, (lang, score) in zip(docs, want, strict=True):
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-3)


def test_a_rare_language_keeps_its_words(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_DOCS", 50)
    monkeypatch.setattr(li, "WORDS_KEPT", 40)
    monkeypatch.setattr(li, "GRAMS_KEPT", 40)
    rows = [(i, f"the common house{i % 97} of words and more number{i}", "en") for i in range(3000)] + [(5000 + i, "maison rouge petit jardin vert", "fr") for i in range(5)]
    rows += [(7, "the same id again", "en")] * 500
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    assert {"maison", "rouge", "petit", "jardin", "vert", "the"} <= set(model.tables[0])
    assert len(model.tables[0]) <= 40 + 40 + 15 and all(len(t) <= 2 * 40 + 20 for t in model.tables.values())
    docs = spark.createDataFrame([(1, "petit jardin"), (2, "the house of words")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in li.predict(docs, model).collect()} == {1: "fr", 2: "en"}


def test_samples_are_the_smallest_hashes_of_each_language(spark):
    rows = [(i, "en" if i % 10 else "fr", f"t{i}") for i in range(5000)] + [(4, "en", "another")] * 2000
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    got = defaultdict(set)
    for r in li.sample_by_language(df, 300, 6).collect():
        got[r.lang].add((r.id, r.text))
    hashes = {r.id: r.u for r in spark.range(5000).withColumn("u", F.xxhash64(F.lit(6), "id")).collect()}
    for lang in ("en", "fr"):
        ids = sorted((i for i in range(5000) if (i % 10 > 0) == (lang == "en")), key=hashes.get)[:300]
        assert got[lang] == {(i, "another" if i == 4 else f"t{i}") for i in ids}


def test_a_model_too_large_is_an_error_before_it_is_collected(spark, monkeypatch):
    monkeypatch.setattr(li, "MODEL_LIMIT", 2000)
    with pytest.raises(ValueError, match="limit"):
        li.fit(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))


def test_familiarity(spark, model):
    rows = spark.createDataFrame([(1, "the cat and the dog " * 30), (2, "xq zzv wkw qqj " * 30), (3, None), (4, "qzx")], "doc_id long, text string")
    got = {r.doc_id: r.f for r in li.predict(rows, model, familiar="f").collect()}
    assert got[1] == 1.0 and got[2] < 0.2 and got[3] == 0 and got[4] == 1.0
