"""Scoring of (original, rewrite) pairs and summaries of the scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions import similarity as S
from pairloom.functions.text import candidate_words, is_wanted, plain_words, sentence_count, split_words, word_gaps

RECORD = (
    "lexical_similarity", "word_overlap", "jaccard_similarity", "length_ratio", "sentence_count_diff",
    "avg_word_length_diff", "semantic_similarity", "overall_score", "error",
)


def token_counts(
    pairs: DataFrame,
    keys: Sequence[str],
    mode: str = "full",
    stopwords: Sequence[str] = C.STOPWORDS,
    lemmas: DataFrame | None = None,
    original: str = "original",
    paraphrase: str = "paraphrase",
    contractions: bool = False,
) -> DataFrame:
    """Term frequencies (keys, token, n_o, n_p) of both sides of each pair.

    Both sides are exploded in one pass and tokens are tested as rows, which
    compiles; partial counts are taken before the shuffle, and there is none if
    the pairs are partitioned by the keys already. ``lemmas`` (token, lemma)
    replaces tokens by their lemma; counts are already per pair and token when
    the table is joined.
    """
    sides = F.posexplode(F.array(original, paraphrase)).alias("side", "text")
    words = pairs.select(*keys, sides).select(*keys, "side", F.explode(candidate_words(F.col("text"), mode, contractions)).alias("token"))
    rows = words.where(is_wanted(F.col("token"), mode, stopwords))
    counts = rows.groupBy(*keys, "token").agg(
        F.count_if(F.col("side") == 0).alias("n_o"), F.count_if(F.col("side") == 1).alias("n_p")
    )
    if lemmas is None:
        return counts
    return (
        counts.join(lemmas.select("token", "lemma"), "token", "left")
        .withColumn("token", F.coalesce("lemma", "token"))
        .groupBy(*keys, "token")
        .agg(F.sum("n_o").alias("n_o"), F.sum("n_p").alias("n_p"))
    )


def lexical_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlap, Jaccard and cosine per pair from its term frequencies."""
    n_o, n_p = F.col("n_o"), F.col("n_p")
    sums = counts.groupBy(*keys).agg(
        F.sum(n_o * n_p).alias("dot"),
        F.sum(n_o * n_o).alias("oo"),
        F.sum(n_p * n_p).alias("pp"),
        F.count_if((n_o > 0) & (n_p > 0)).alias("shared"),
        F.count_if(n_o > 0).alias("distinct_o"),
        F.count("*").alias("distinct_all"),
    )
    return sums.select(
        *keys,
        S.tf_cosine(F.col("dot"), F.col("oo"), F.col("pp")).alias("lexical_similarity"),
        F.coalesce(F.try_divide("shared", "distinct_o"), F.lit(0.0)).alias("word_overlap"),
        F.coalesce(F.try_divide("shared", "distinct_all"), F.lit(0.0)).alias("jaccard_similarity"),
    )


def pair_counts(
    pairs: DataFrame,
    mode: str = "full",
    stopwords: Sequence[str] = C.STOPWORDS,
    original: str = "original",
    paraphrase: str = "paraphrase",
    contractions: bool = False,
) -> DataFrame:
    """The input with a struct ``_c`` of counts of both sides: terms, what they share, words, their letters, sentences; no shuffle.

    Each text is counted in a hash table, in time linear in its length. Texts beyond ASCII are lower-cased here, and ``odd``
    are their characters that are neither letter nor digit, so that words are the same as in :func:`token_counts`.
    """
    gaps = word_gaps(mode)

    def prepared(name: str) -> list[Column]:
        text = F.col(name)
        plain = plain_words(text, gaps, contractions)
        if not contractions:
            plain = F.when(F.octet_length(text) != F.length(text), plain)
        odd = F.regexp_replace(plain, r"[\p{L}\p{N} ]+", "") if mode == "full" else F.lit("")
        return [text, plain, odd]

    table = str.maketrans(gaps, " " * len(gaps), C.ASCII_PUNCTUATION)
    unwanted = frozenset(stopwords) if mode == "full" else frozenset()

    def terms(text: str | None, plain: str | None, odd: str | None) -> dict[str, int]:
        if text is None:
            return {}
        found = Counter((text.translate(table).lower() if plain is None else plain).split(" "))
        bad = frozenset(odd or "")
        if mode == "full" and plain is None:
            return {w: n for w, n in found.items() if w.isalnum() and w not in unwanted}
        return {w: n for w, n in found.items() if w and w not in unwanted and bad.isdisjoint(w)}

    def sizes(text: str | None) -> tuple[int | None, int | None, int | None]:
        if text is None:
            return None, None, None
        words = text.split()
        return len(words), len("".join(words)), sum(1 for run in RUN.findall(text) if not run.isspace())

    @F.pandas_udf(COUNTS)
    def count(o: pd.Series, po: pd.Series, xo: pd.Series, p: pd.Series, pp: pd.Series, xp: pd.Series) -> pd.DataFrame:
        rows = []
        for o_, po_, xo_, p_, pp_, xp_ in zip(o, po, xo, p, pp, xp, strict=True):
            a, b = terms(o_, po_, xo_), terms(p_, pp_, xp_)
            both = a.keys() & b.keys()
            # the union with a side that is missing is empty, and all of the other side counts as shared
            missing = o_ is None or p_ is None
            shared, union = (len(a) + len(b), 0) if missing else (len(both), len(a) + len(b) - len(both))
            rows.append((sum(n * n for n in a.values()), sum(n * n for n in b.values()), sum(a[w] * b[w] for w in both), len(a), shared, union, *sizes(o_), *sizes(p_)))
        return pd.DataFrame(rows, columns=["oo", "pp", "dot", "distinct_o", "shared", "distinct_all", "words_o", "chars_o", "sentences_o", "words_p", "chars_p", "sentences_p"], dtype=object)

    return pairs.withColumn("_c", count(*prepared(original), *prepared(paraphrase)))


COUNTS = "oo bigint, pp bigint, dot bigint, distinct_o int, shared int, distinct_all int, " + ", ".join(f"words_{s} int, chars_{s} int, sentences_{s} int" for s in "op")
RUN = re.compile("[^.!?]+")  # of text between terminators


def lexical_of_counts(counted: DataFrame) -> DataFrame:
    c = F.col("_c")
    return counted.withColumns({
        "lexical_similarity": S.tf_cosine(c["dot"], c["oo"], c["pp"]),
        "word_overlap": F.coalesce(F.try_divide(c["shared"], c["distinct_o"]), F.lit(0.0)),
        "jaccard_similarity": F.coalesce(F.try_divide(c["shared"], c["distinct_all"]), F.lit(0.0)),
    })


def lexical_metrics(
    pairs: DataFrame,
    mode: str = "full",
    stopwords: Sequence[str] = C.STOPWORDS,
    original: str = "original",
    paraphrase: str = "paraphrase",
    contractions: bool = False,
) -> DataFrame:
    """The same three metrics inside each row, without a shuffle."""
    return lexical_of_counts(pair_counts(pairs, mode, stopwords, original, paraphrase, contractions)).drop("_c")


def structural_metrics(
    pairs: DataFrame, original: str = "original", paraphrase: str = "paraphrase", sentences: Callable[[Column], Column] = sentence_count,
) -> DataFrame:
    """Length ratio, word lengths and sentences, as far as may be from the struct of :func:`pair_counts` where there is one."""
    so, sp = (sentences(F.col(t)) for t in (original, paraphrase))
    if "_c" in pairs.columns:
        c, words = F.col("_c"), pairs
        wo, wp, co, cp = c["words_o"], c["words_p"], c["chars_o"], c["chars_p"]
        if sentences is sentence_count:
            so, sp = c["sentences_o"], c["sentences_p"]
    else:
        words = pairs.withColumns({"_wo": split_words(F.col(original)), "_wp": split_words(F.col(paraphrase))})
        wo, wp = F.size("_wo"), F.size("_wp")
        co, cp = (F.length(F.array_join(w, "")) for w in ("_wo", "_wp"))
    return words.withColumns({
        "length_ratio": S.size_ratio(wo, wp),
        "avg_word_length_diff": F.abs(S.mean_of(co, wo) - S.mean_of(cp, wp)),
        "sentence_count_diff": F.abs(so - sp).cast("int"),
    }).drop("_wo", "_wp", "_c")


def complete_record(df: DataFrame, original: str, paraphrase: str, semantic: Column | None) -> DataFrame:
    """Score and error; an empty side gives the all-zero record."""
    o, p = F.col(original), F.col(paraphrase)
    empty = o.isNull() | p.isNull() | (o == "") | (p == "")
    df = df.withColumn("semantic_similarity", (semantic if semantic is not None else F.lit(None)).cast("double"))
    df = df.withColumn(
        "overall_score",
        S.overall_score(
            F.col("lexical_similarity"), F.col("word_overlap"), F.col("length_ratio"), F.col("semantic_similarity")
        ),
    )
    zeros = {
        m: F.when(empty, F.lit(0).cast(df.schema[m].dataType)).otherwise(F.col(m)) for m in RECORD if m != "error"
    }
    return df.withColumns({**zeros, "error": F.when(empty, F.lit(C.EMPTY_PAIR))})


def evaluate_batch(
    pairs: DataFrame,
    semantic: Column | None = None,
    mode: str = "full",
    stopwords: Sequence[str] = C.STOPWORDS,
    lemmas: DataFrame | None = None,
    keys: Sequence[str] = (),
    original: str = "original",
    paraphrase: str = "paraphrase",
    contractions: bool = False,
    sentences: Callable[[Column], Column] = sentence_count,
) -> DataFrame:
    """The input with the full evaluation record of each pair.

    With ``keys`` that identify a pair (none of them NULL) its tokens are counted as rows, in less time than the form in the row
    that is used without; ``lemmas`` need them. Without ``semantic`` its column is NULL and does not count in the score.
    ``contractions`` takes words like cannot apart; ``sentences`` counts sentences (``operators.sentences.counter``
    gives a learned one).
    """
    if keys:
        counts = token_counts(pairs, keys, mode, stopwords, lemmas, original, paraphrase, contractions)
        scored = pairs.join(lexical_from_counts(counts, keys), list(keys), "left").fillna(
            0.0, ["lexical_similarity", "word_overlap", "jaccard_similarity"]
        )
    elif lemmas is None:
        scored = lexical_of_counts(pair_counts(pairs, mode, stopwords, original, paraphrase, contractions))
    else:
        raise ValueError("lemmas need the key columns of a pair")
    return complete_record(structural_metrics(scored, original, paraphrase, sentences), original, paraphrase, semantic)


def evaluation_summary(evaluations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, min, max and population deviation per metric, and counts.

    A metric that was not computed is NULL and does not count; the zeros of
    error records do.
    """
    aggs = []
    for m in C.SUMMARY_METRICS:
        aggs += [
            F.avg(m).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
            F.stddev_pop(m).alias(f"{m}_std"),
        ]
    aggs += [
        F.count("*").alias("total_evaluations"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) == "").alias("successful_evaluations"),
    ]
    return evaluations.groupBy(*by).agg(*aggs)
