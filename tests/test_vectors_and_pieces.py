"""Weighted sentence vectors and learned subwords."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate as E
from pairloom.operators import semantic as SM
from pairloom.operators import subwords as SW
from pairloom.operators import tokens as K

TEXTS = ["The river froze over in winter.", "In winter the river froze!", "Bread, garden and stone", "river river river", "", None, "the of and", "stone bread"]


def feature_counts(text):
    stop = {"the", "over", "in", "and", "of"}
    words = [w for w in "".join(c for c in (text or "").lower() if c.isalnum() or c == " ").split() if w not in stop]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def vector_by_hand(text, texts):
    df = Counter(f for t in texts for f in feature_counts(t))
    out = [0.0] * SM.DIM
    for f, n in feature_counts(text).items():
        w = n * (math.log((1 + len(texts)) / (1 + df[f])) + 1)
        digest = hashlib.md5(f.encode()).hexdigest()
        for j in range(SM.DIM):
            bits = int(digest[8 * (j // 32) : 8 * (j // 32) + 8], 16)
            out[j] += w if bits >> (j % 32) & 1 else -w
    return out


def test_vectors_component_by_component(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    weights = SM.learn_weights(df.where("id <> 7"))  # the last text's pair of words is unknown
    got = {r.id: r.vector for r in SM.embed_weighted(df, ["id"], weights).collect()}
    assert len(got) == len(TEXTS) and got[4] == got[5] == got[6] == [0.0] * SM.DIM
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(vector_by_hand(t, TEXTS[:7]))


def test_semantic_score_end_to_end(spark):
    pairs = spark.createDataFrame([(1, TEXTS[0], TEXTS[1]), (2, TEXTS[0], TEXTS[2]), (3, TEXTS[0], TEXTS[0]), (4, TEXTS[0], ""), (5, None, "x")], "id int, original string, paraphrase string")
    weights = SM.learn_weights(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    near = {r.id: r.semantic_similarity for r in SM.semantic_similarity(pairs, ["id"], weights).collect()}
    assert near[3] == pytest.approx(1) and near[1] > 0.5 > near[2] and near[4] == near[5] == 0
    scored = E.evaluate_batch(pairs.join(SM.semantic_similarity(pairs, ["id"], weights).withColumnRenamed("semantic_similarity", "s"), "id"), semantic=F.col("s"), keys=["id"])
    got = {r.id: r for r in scored.collect()}
    r = got[1]
    want = 0.3 * (1 - abs(r.lexical_similarity - 0.3) / 0.7) + 0.2 * (1 - r.word_overlap) + 0.2 * r.length_ratio + 0.3 * near[1]
    assert r.overall_score == pytest.approx(want) and got[4].error == got[5].error == "Empty input"


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def test_segmentation_and_expected_use_by_enumeration():
    rng = random.Random(2)
    for case in range(60):
        scores = SW.logs({"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): rng.randint(1, 9) for _ in range(8)})
        pieces = SW.Pieces(scores)
        word = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 8)))

        def score(parts):
            return sum(scores.get(p, pieces.unknown if len(p) == 1 else -math.inf) for p in parts)

        alls = [(score(s), s) for s in segmentations(word)]
        best = pieces.best(word)
        assert "".join(best) == word and score(best) == pytest.approx(max(s for s, _ in alls)), case
        total = sum(math.exp(s) for s, _ in alls)
        want = Counter()
        for s, parts in alls:
            for p in parts:
                want[p] += math.exp(s) / total
        used, likelihood = pieces.use(word)
        assert likelihood == pytest.approx(math.log(total))
        assert {p: n for p, n in used.items() if n > 1e-9} == pytest.approx({p: n for p, n in want.items() if n > 1e-9})


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    stems, ends = "walk talk jump paint clean".split(), ["", "s", "ed", "ing", "er"]
    texts = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(20)) for _ in range(100)]
    return spark.createDataFrame([(i, t, None if i == 3 else t[:30]) for i, t in enumerate(texts)] + [(500, None, "walk"), (501, None, None), (502, "", "")], "id int, text1 string, text2 string")


def test_rounds_never_lose_likelihood(spark, corpus):
    words = SW.word_counts(corpus, "text1").cache()
    scores, last = SW.candidates(words, 200, 6), -math.inf
    for _ in range(4):
        counts, likelihood = SW._round(words, scores)
        assert likelihood >= last - 1e-6
        scores, last = SW.logs(counts), likelihood
    words.unpersist()


def test_learned_pieces_and_unseen_words(spark, corpus):
    model = SW.learn(corpus, ("text1", "text2"), size=40, longest=6)
    pieces = [p for p, _ in model]
    assert len(pieces) <= 40 and {"ing", "▁walk"} & set(pieces)
    encode = SW.tokenizer(model)()
    ids = encode(["Walking, painter! jumptalk", "walks xyz", None, ""], None)
    assert SW.UNKNOWN not in ids[0] and SW.UNKNOWN in ids[1] and ids[2] == ids[3] == []
    assert "".join(pieces[i - SW.FIRST] for i in ids[0]) == "▁walking▁painter▁jumptalk"
    assert encode(["Walking, painter! jumptalk"], 3)[0] == ids[0][:3]
    assert SW.learn(corpus.limit(0), ("text1",)) == [] and SW.tokenizer([])()(["a b"], None) == [[SW.UNKNOWN] * 4]


@pytest.mark.parametrize("subwords", [True, False])
def test_a_row_per_pair_and_a_mask_per_id(spark, corpus, subwords):
    how = {"tokenizer": SW.tokenizer(SW.learn(corpus, ("text1", "text2"), size=60))} if subwords else {}
    rows = {r.id: r for r in K.tokenize_pairs(corpus, ["id"], max_source=16, max_target=4, **how).collect()}
    assert len(rows) == corpus.count()
    assert all(r.attention_mask == [1] * len(r.input_ids) and len(r.input_ids) <= 16 and len(r.labels) <= 4 for r in rows.values())
    assert rows[3].labels == [] and rows[500].input_ids == [] and rows[500].labels and rows[501].input_ids == rows[501].labels == rows[502].labels == []
    if not subwords:
        few = K.tokenize_pairs(corpus.where("id = 0"), ["id"], vocab=K.vocabulary(corpus.where("id = 1"))).first()
        assert len(few.input_ids) == 21  # the prefix and twenty words, those that the vocabulary lacks as 0


def test_vectors_weighted_by_their_own_corpus(spark, monkeypatch):
    monkeypatch.setattr(SM, "GROUP_BYTES", 16)  # several groups
    rows = [*enumerate(TEXTS), (0, "one more text of that key"), (None, TEXTS[0]), (None, None), (90, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r.id is None, r.id or 0, r.vector) for r in SM.embed_corpus(df, ["id"]).collect())
    want = sorted((r.id is None, r.id or 0, r.vector) for r in SM.embed_weighted(df, ["id"], SM.learn_weights(df)).collect())
    assert len(got) == len(rows) and [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == pytest.approx(w[2])
    assert SM.embed_corpus(df.limit(0), ["id"]).count() == 0


def test_pieces_are_sought_only_as_far_as_one_goes_on():
    """The steps of a segmentation grow with the pieces that begin at a place, not with the longest piece."""
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    pieces = SW.Pieces({"a": -1.0, "b": -1.5, "ab": -1.2, "z" * 40: -3.0})
    pieces.paths = Counted({c: Counted(node) for c, node in pieces.paths.items()})
    assert pieces.best("ab" * 20) == ["ab"] * 20 and Counted.asked < 40 * 8
    expected, whole = pieces.use("ab")
    assert whole == pytest.approx(math.log(math.exp(-2.5) + math.exp(-1.2)))
    assert expected == pytest.approx({"ab": math.exp(-1.2 - whole), "a": math.exp(-2.5 - whole), "b": math.exp(-2.5 - whole)})
    assert pieces.best("aéb") == ["a", "é", "b"] and SW.Pieces({}).best("é") == ["é"]
    assert SW.words_of("Don't ÉTÉ\u2003«a» x_y") == ["dont", "été", "«a»", "xy"]


def test_corpus_words_are_taken_apart_in_the_task(spark, capsys):
    """They are those of ``normalize_text``, and no plan tests them one by one."""
    texts = ["The cat's tail, don't!", "été à la naïve İ ß “quoted” x—y", "日本 語 a\x00b c1 ² ½", "", None, "  \t and \u00a0 12 3.4 "]
    d = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    want = {r.id: r.w for r in d.select("id", SM.normalize_text(F.coalesce("t", F.lit(""))).alias("w")).collect()}
    plain = SM.plain_words(F.coalesce("t", F.lit("")), SM.word_gaps("full"))
    rows = d.select("id", plain.alias("p")).withColumn("odd", F.when(F.octet_length("p") != F.length("p"), F.regexp_replace("p", r"[\p{L}\p{N} ]+", ""))).collect()
    assert {r.id: SM._words(r.p, r.odd) for r in rows} == want
    capsys.readouterr()
    SM.embed_corpus(d, ["id"], "t").explain()
    assert "lambdafunction" not in capsys.readouterr().out
