"""Pair metrics as Column expressions over token arrays and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.text import sentence_count


def word_overlap(original: Column, rewrite: Column) -> Column:
    """Shared distinct tokens over the distinct tokens of the original."""
    shared = F.size(F.array_intersect(original, rewrite))
    share = F.try_divide(shared, F.size(F.array_distinct(original)))
    return F.coalesce(share, F.lit(0.0))


def jaccard_similarity(original: Column, rewrite: Column) -> Column:
    shared = F.size(F.array_intersect(original, rewrite))
    return F.coalesce(F.try_divide(shared, F.size(F.array_union(original, rewrite))), F.lit(0.0))


def tf_cosine(dot: Column, norm2_original: Column, norm2_rewrite: Column) -> Column:
    """Cosine from the dot product and squared norms; 0 if a norm is 0."""
    norms = F.sqrt(norm2_original.cast("double")) * F.sqrt(norm2_rewrite.cast("double"))
    return F.coalesce(F.try_divide(dot.cast("double"), norms), F.lit(0.0))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors, in double precision; 0 if a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def length_ratio(words_o: Column, words_p: Column) -> Column:
    return size_ratio(F.size(words_o), F.size(words_p))


def size_ratio(n_o: Column, n_p: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(n_o, n_p), F.greatest(n_o, n_p)), F.lit(0.0))


def mean_word_length(words: Column) -> Column:
    # Each word contributes its length; the text's spaces do not count.
    return mean_of(F.length(F.array_join(words, "")), F.size(words))


def mean_of(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def avg_word_length_diff(words_o: Column, words_p: Column) -> Column:
    return F.abs(mean_word_length(words_o) - mean_word_length(words_p))


def sentence_count_diff(original: Column, rewrite: Column) -> Column:
    return F.abs(sentence_count(original) - sentence_count(rewrite))


def overall_score(lexical: Column, overlap: Column, length: Column, semantic: Column | None = None) -> Column:
    """Weighted mean of the parts that are present (NULL = absent); not clamped.

    Moderate lexical similarity scores best and overlap counts against the
    pair, so a verbatim copy scores low.
    """
    parts = {
        "lexical": 1.0 - F.abs(lexical - C.SCORE_TARGET_SIMILARITY) / C.SCORE_SIMILARITY_SPAN,
        "overlap": 1.0 - overlap,
        "length": length,
    }
    if semantic is not None:
        parts["semantic"] = semantic
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, part in parts.items():
        w = C.SCORE_WEIGHTS[name]
        total = total + F.coalesce(part * w, F.lit(0.0))
        weight = weight + F.when(part.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))
