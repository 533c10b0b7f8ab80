"""Lemma rules learned from a table."""

import random

from pyspark.sql import functions as F

from pairloom.operators import evaluate as E
from pairloom.operators import lemmas as LM

VOWELS, CONSONANTS = "aeiou", "bdgklmnprt"


def words(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(2, 4))) + rng.choice(CONSONANTS) for _ in range(n)})


def inflected(stem):
    """Forms with endings; y turns to i before them, as in cities."""
    return [(stem, stem), (stem + "s", stem), (stem + "ing", stem), (stem + "ed", stem), (stem + "ies", stem + "y"), (stem + "ly", stem + "ly")]


def rules_by_hand(rows, longest=6, least=2):
    counts = {}
    for t, m in set(rows):
        same = next(n for n in range(min(len(t), len(m)), -1, -1) if t[:n] == m[:n])
        cut, add = len(t) - same, m[same:]
        for size in range(max(cut, 1), min(longest, len(t)) + 1):
            key = (t[len(t) - size :], cut, add)
            counts[key] = counts.get(key, 0) + 1
    best = {}
    for (suffix, cut, add), n in counts.items():
        if n >= least:
            best[suffix] = min(best.get(suffix, (0, 99, "")), (-n, cut, add))
    return best


def test_rules_against_a_plain_version_and_held_out_words(spark):
    table = [p for stem in words(150, 1) for p in inflected(stem)]
    held = [p for stem in words(60, 2) for p in inflected(stem)]
    lemmas = spark.createDataFrame(table + table[:50] + [(None, "x"), ("x", None), ("", "")], "token string, lemma string")
    rules = LM.learn_rules(lemmas)
    assert {r.suffix: (-r.n, r.cut, r.add) for r in rules.collect()} == rules_by_hand(table)
    tokens = spark.createDataFrame([(t,) for t, _ in held + table[:9]] + [(None,), ("s",), ("日本",)], "token string")
    got = {r.token: (r.lemma, r.known) for r in LM.lemmatize(tokens, lemmas, rules).collect()}
    known = dict(table)
    wrong = [(t, m, got[t]) for t, m in held if t not in known and got[t][0] != m]
    assert len(wrong) <= 0.03 * len(held) and all(got[t] == (known[t], True) for t, _ in table[:9])
    assert got["s"] == ("s", False) and got["日本"] == ("日本", False) and None not in got


def test_scores_with_lemmas_by_rule(spark):
    table = [p for stem in words(80, 3) for p in inflected(stem)]
    lemmas = spark.createDataFrame(table, "token string, lemma string")
    pairs = spark.createDataFrame([(1, "zamored tubiking", "zamor tubik")], "id int, original string, paraphrase string")
    tokens = E.token_counts(pairs, ["id"]).select("token")
    full = LM.lemmatize(tokens, lemmas, LM.learn_rules(lemmas))
    assert E.evaluate_batch(pairs, lemmas=lemmas, keys=["id"]).first().word_overlap == 0
    assert E.evaluate_batch(pairs, lemmas=full, keys=["id"]).first().word_overlap == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "token string, lemma string")
    rules = LM.learn_rules(none)
    one = spark.createDataFrame([("walks",)], "token string")
    assert rules.count() == 0 and LM.lemmatize(one, none, rules).first().lemma == "walks"
    assert LM.lemmatize(one.where(F.lit(False)), none, rules).count() == 0
