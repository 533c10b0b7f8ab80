import math

import pytest
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions import requests as R
from pairloom.functions import similarity as S
from pairloom.functions import text as T
from pairloom.operators import evaluate as E
from pairloom.operators import providers, validate

SHORT_STOPWORDS = "the on this is a an was here its it for".split()

# original, paraphrase, overlap, jaccard, lexical, length ratio, word length, overall, overall with semantic 0.8
GOLDEN = [
    ("The cat sat on the mat.", "The feline was resting on the rug.", 0, 0, 0, 0.857143, 1.0, 0.775510, 0.782857),
    ("This is a test sentence.", "Here is an example phrase.", 0, 0, 0, 1.0, 0.4, 0.816327, 0.811429),
    ("Weather is nice today.", "It's a pleasant day.", 0, 0, 0, 1.0, 0.5, 0.816327, 0.811429),
    ("The quick brown fox jumps.", "A fast, dark-colored fox leaps.", 0.25, 0.142857, 0.25, 1.0, 1.0, 0.897959, 0.868571),
    ("Another example for evaluation.", "This is a test for the eval set.", 0, 0, 0, 0.5, 3.875, 0.673469, 0.711429),
    ("the quick brown fox", "the quick brown fox", 1, 1, 1, 1.0, 0, 0.285714, 0.440000),
    ("   ", "hello world", 0, 0, 0, 0, 5.0, 0.530612, 0.611429),
    ("!!!", "hello world", 0, 0, 0, 0.5, 2.0, 0.673469, 0.711429),
    ("", "anything", 0, 0, 0, 0, 0, 0, 0),
    (None, "anything", 0, 0, 0, 0, 0, 0, 0),
    ("anything", None, 0, 0, 0, 0, 0, 0, 0),
]
COLUMNS = ["word_overlap", "jaccard_similarity", "lexical_similarity", "length_ratio", "avg_word_length_diff", "overall_score"]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, g[0], g[1]) for i, g in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "id int, original string, paraphrase string")


def test_golden_pairs(golden):
    for semantic, at in ((None, 7), (F.lit(0.8), 8)):
        got = E.evaluate_batch(golden, semantic, stopwords=SHORT_STOPWORDS).orderBy("id").collect()
        for r, g in zip(got, GOLDEN):
            want = [*g[2:7], g[at]]
            assert [round(r[c], 6) for c in COLUMNS] == pytest.approx(want, abs=1e-6), g
            assert r.error == ("Empty input" if not g[0] or not g[1] else None)
        assert got[8].semantic_similarity == 0.0
        assert got[0].semantic_similarity == (None if semantic is None else 0.8)


def test_joined_form_equals_row_form(spark, golden):
    none = spark.createDataFrame([], "token string, lemma string")
    a = E.evaluate_batch(golden).orderBy("id").collect()
    b = E.evaluate_batch(golden, lemmas=none, keys=["id"]).orderBy("id").collect()
    for x, y in zip(a, b):
        assert [x[c] for c in COLUMNS] == pytest.approx([y[c] for c in COLUMNS])
    lemmas = spark.createDataFrame([("jumps", "leap"), ("leaps", "leap")], "token string, lemma string")
    c = E.evaluate_batch(golden, lemmas=lemmas, keys=["id"]).where("id = 3").first()
    assert c.word_overlap == 0.5


def test_summary(golden):
    s = E.evaluation_summary(E.evaluate_batch(golden)).first()
    assert (s.total_evaluations, s.successful_evaluations) == (11, 8)
    assert s.semantic_similarity_mean == 0.0  # only the error records have the metric
    values = [r.overall_score for r in E.evaluate_batch(golden).collect()]
    mean = sum(values) / len(values)
    assert s.overall_score_std == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)))


def test_properties(spark):
    rng = __import__("random").Random(5)
    words = ["ab", "Cd", "ef", "the", "über", "x1", "—", "don't", "9"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
    rows = [(i, text(), text()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, original string, paraphrase string")
    swapped = df.select("id", F.col("paraphrase").alias("original"), F.col("original").alias("paraphrase"))
    same = df.withColumn("paraphrase", F.col("original"))
    a, b, c = (E.evaluate_batch(d).orderBy("id").collect() for d in (df, swapped, same))
    for x, y, z in zip(a, b, c):
        for m in ("lexical_similarity", "jaccard_similarity", "word_overlap", "length_ratio"):
            assert -1e-12 <= x[m] <= 1 + 1e-12
        for m in ("lexical_similarity", "jaccard_similarity", "length_ratio"):
            assert x[m] == pytest.approx(y[m])
        if z.word_overlap:
            assert z.lexical_similarity == pytest.approx(1.0)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_words_follow_unicode_white_space(spark):
    r = one(
        spark,
        words=T.split_words(F.lit(" a\xa0b\u2003c\x1cd\n\te\u3000")),
        none=T.split_words(F.lit(" \u3000\t")),
        strip=T.strip_text(F.lit("\u2028 x y \x85")),
        quotes=T.normalize_text(F.lit("“Hello” can't CANNOT naïve ¿qué? x²")),
        split=T.normalize_text(F.lit("Cannot gonna"), stopwords=(), contractions=True),
        sentences=T.sentence_count(F.lit("One. Two! Three? four")),
    )
    assert r.words == ["a", "b", "c", "d", "e"] and r.none == [] and r.strip == "x y"
    assert r.quotes == ["hello", "cant", "cannot", "naïve", "x²"]
    assert r.split == ["can", "not", "gon", "na"] and r.sentences == 4


@pytest.mark.parametrize("reply,label", [
    ("0", "0"), ("1", "1"), ("label 0", "0"), ("The answer is 1", "1"), ("0 or 1", None), ("10", None), ("none", None), (None, None),
])
def test_labels(spark, reply, label):
    assert one(spark, v=R.normalize_label(F.lit(reply).cast("string"))).v == label


@pytest.mark.parametrize("status,body,content", [
    (200, '{"choices": [{"message": {"content": "Paraphrase output"}}]}', "Paraphrase output"),
    (403, '{"choices": [{"message": {"content": "Paraphrase output"}}]}', None),
    (403, '{"error": "forbidden"}', None), (200, '{"choices": []}', None), (200, "{}", None), (200, "{bad", None),
    (200, '{"choices": [{"message": {"content": "  "}}]}', None), (200, '{"choices": [{"message": {}}]}', None),
])
def test_chat_replies(spark, status, body, content):
    assert one(spark, v=R.extract_chat_content(F.lit(status), F.lit(body))).v == content


def test_model_resolution(spark):
    def resolve(rows, settings):
        df = spark.createDataFrame(rows, "provider string, model string")
        s = spark.createDataFrame(settings, "provider string, override string, file_value string")
        return [r.model_name for r in providers.resolve_model(df, settings=s).collect()]

    for p in ("openrouter", "gemini"):
        assert resolve([(p, None)], [(p, None, "file-model\n")]) == ["file-model"]
        assert resolve([(p.upper(), " ")], [(p, "env-model", "file-model")]) == ["env-model"]
        assert resolve([(p, " mine ")], [(p, "env-model", None)]) == ["mine"]
    default = C.PROVIDERS["openrouter"]["model"]
    assert resolve([(None, None)], []) == resolve([("else", "")], []) == [default]


def test_validation(spark):
    rows = [(None,), ("",), ("  \t",), ("x" * 10_000,), ("x" * 10_001,), (" " * 10_001,)]
    df = spark.createDataFrame(rows, "text string")
    got = {r.text: r.violation for r in validate.validate_texts(df).collect()}
    assert [got[t] for (t,) in rows] == [C.NOT_A_STRING, C.EMPTY_TEXT, C.EMPTY_TEXT, None, C.TEXT_TOO_LONG, C.EMPTY_TEXT]
    valid, bad = validate.split_valid(validate.validate_texts(df))
    assert (valid.count(), bad.count()) == (1, 5)
    for limit in (1000, 100):
        items = spark.range(2 * limit + 1).select(F.when(F.col("id") < limit, "ok").otherwise("big").alias("batch_id"))
        sizes = validate.validate_batch_size(items, limit=limit, batches=spark.createDataFrame([("none",), ("ok",), ("big",)], "batch_id string"))
        v = {r.batch_id: r.violation for r in sizes.collect()}
        assert v == {"ok": None, "big": f"Too many texts (max {limit})", "none": C.EMPTY_BATCH}


def test_vector_cosine_of_zero_vector(spark):
    z, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, zero=S.vector_cosine(z, v), same=S.vector_cosine(v, v))
    assert (r.zero, r.same) == (0.0, 1.0)


def test_sentences_of_blanks_and_terminators(spark):
    cases = {"Hello. World. ": 2, "One line.\n": 1, "...": 0, "3.14": 2, " \n": 0, "": 0, "a": 1, "A!  B?\t": 2, "no end": 1}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.sentence_count(F.col("t")).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == cases


def test_texts_of_a_pair_are_counted_without_a_step_per_word(spark):
    """In the row as in rows, on letters, digits and gaps beyond ASCII too; no lambda runs over the words."""
    texts = ["", "  ", None, "ΟΔΟΣ'Α ΟΔΟΣ İstanbul. İs", "a b c «d» é été ÉTÉ", "x² ½ Ⅷ ٣ 🙂 a🙂", "one\x00 two\x1fthree!? . 　! four", "don't the THE can't"]
    rows = [(i * len(texts) + j, o, p) for i, o in enumerate(texts) for j, p in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "k int, original string, paraphrase string")
    for mode, contractions in (("full", False), ("basic", False), ("full", True)):
        inside = E.evaluate_batch(pairs, mode=mode, contractions=contractions)
        assert inside.orderBy("k").collect() == E.evaluate_batch(pairs, keys=["k"], mode=mode, contractions=contractions).select(*inside.columns).orderBy("k").collect()
    assert "lambda" not in E.evaluate_batch(pairs)._jdf.queryExecution().optimizedPlan().toString()
