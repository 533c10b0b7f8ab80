"""Sentence splitting learned from a corpus."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate as E
from pairloom.operators import sentences as SN

GOLDEN = [
    ("Mr. Miller came. He sat down.", 2),
    ("It costs 3.14 euros. That is much.", 2),
    ("The rate was 3. The next one was 4.", 2),
    ("Section 3. of the law holds.", 1),
    ("A letter by J. Miller arrived today.", 1),
    ("Wait... what did he say?", 1),
    ("Wait... The door opened.", 2),
    ('He said "no." Then he left!', 2),
    ("She met Dr. Smith. He knew Mr. Jones.", 2),
    ("They left at 5 p.m. He stayed.", 2),
    ("They left at 5 p.m. yesterday.", 1),
    ("Why? Because! (So it is.) The end", 4),
    ("no end", 1),
    ("...", 1),
    ("", 0), ("  \n", 0), (None, 0),
]


@pytest.fixture(scope="module")
def corpus(spark):
    """Titles stand before names, p.m. before anything, The and He begin sentences."""
    rng = random.Random(3)
    nouns = "house tree river letter door street winter garden bread stone".split()
    names = "Miller Smith Jones Baker Cooper".split()
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(3, 9)):
            who = rng.choice([f"{rng.choice(['Mr.', 'Dr.'])} {rng.choice(names)}", "He", "The " + rng.choice(nouns)])
            when = rng.choice(["", f" at {rng.randint(1, 11)} p.m.", " with " + rng.choice(names)])
            what = rng.choice(["saw the", "left a", "met the", "took a"]) + " " + rng.choice(nouns)
            parts.append(f"{who} {what}{when} {rng.choice(['and the', 'near a'])} {rng.choice(nouns)}{rng.choice(['.', '.', '!', '?'])}")
        texts.append(" ".join(parts))
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


@pytest.fixture(scope="module")
def model(corpus):
    return SN.learn(corpus)


def test_what_is_learned(model):
    rows = {(r.kind, r.type) for r in model.collect()}
    assert {t for k, t in rows if k == "abbreviation"} == {"mr", "dr", "p.m"}
    assert {"he", "the"} <= {t for k, t in rows if k == "starter"} and ("starter", "saw") not in rows


def test_golden_sentences(spark, model):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "id int, text string")
    want = {i: n for i, (_, n) in enumerate(GOLDEN)}
    assert {r.id: r.sentences for r in SN.count_sentences(df, model, ["id"]).collect()} == want
    assert {r.id: r.n for r in df.select("id", SN.counter(model)(F.col("text")).alias("n")).collect()} == {**want, len(GOLDEN) - 1: 0}


def test_empty_corpora(spark, corpus):
    none = SN.learn(corpus.limit(0))
    assert none.count() == 0
    assert SN.learn(spark.createDataFrame([(None,), ("",), ("word",)], "text string")).count() == 0
    assert SN.count_sentences(corpus, none, ["id"]).where("sentences < 3").count() == 0


def test_scores_with_learned_sentences_and_contractions(spark, model):
    pairs = spark.createDataFrame([(1, "Mr. Miller cannot come. He left.", "Miller can not come. He left. The end.")], "id int, original string, paraphrase string")
    plain = E.evaluate_batch(pairs).first()
    learned = E.evaluate_batch(pairs, sentences=SN.counter(model), contractions=True).first()
    assert (plain.sentence_count_diff, learned.sentence_count_diff) == (0, 1)
    assert learned.word_overlap > plain.word_overlap
    keyed = E.evaluate_batch(pairs, sentences=SN.counter(model), contractions=True, keys=["id"]).first()
    assert {c: keyed[c] for c in E.RECORD} == {c: learned[c] for c in E.RECORD}


def test_a_large_model_stays_a_table(spark, model, monkeypatch):
    monkeypatch.setattr(SN, "MOST_TYPES", 2)
    with pytest.raises(ValueError, match="count_sentences"):
        SN.counter(model)


def test_counted_in_the_row_with_a_table_of_any_size(spark, monkeypatch):
    texts = [*GOLDEN, "(Mr. Hill came.) He saw «Dr. Ash!» We left... Then 3. May. Who?"]
    df = spark.createDataFrame([*enumerate(t if isinstance(t, str) else t[0] for t in texts), (900, None), (901, "")], "id int, text string")
    model = spark.createDataFrame([("abbreviation", t) for t in ("mr", "dr", "ash")] + [("starter", t) for t in ("he", "we", "then")], "kind string, type string")
    want = {r.id: r.n for r in df.select("id", SN.counter(model)(F.col("text")).alias("n")).collect()}
    monkeypatch.setattr(SN, "MOST_TYPES", 2)
    got = {r.id: r.sentences for r in SN.count_in_row(df, model, ["id"]).collect()}
    assert got == want and len(got) == df.count()
