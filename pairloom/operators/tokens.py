"""Vectors and token ids of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.text import normalize_text, tokenize
from pairloom.operators.ordered import ranked


def embed(
    df: DataFrame,
    text: str = "text",
    encoder: Callable[[], Callable[[list[str]], list]] | None = None,
    dim: int = 256,
    out: str = "vector",
) -> DataFrame:
    """Adds a vector per text.

    ``encoder`` makes, once per task, a function from a list of texts to a list
    of vectors. Without one, tokens are counted in ``dim`` hash buckets.
    """
    if encoder is None:
        tokens = df.withColumn("_tokens", normalize_text(F.coalesce(F.col(text), F.lit(""))))
        hashed = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_v").transform(tokens)
        return hashed.withColumn(out, vector_to_array("_v", "float32")).drop("_tokens", "_v")

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    return df.withColumn(out, encode(F.col(text)))


def vocabulary(pairs: DataFrame, columns: tuple[str, ...] = ("text1", "text2"), prefix: str = C.SEQ2SEQ_PREFIX) -> DataFrame:
    """(token, token_id): distinct tokens of prefix and texts, numbered in order from 1."""
    texts = F.array(F.concat(F.lit(prefix), F.col(columns[0])), *[F.col(c) for c in columns[1:]])
    tokens = pairs.select(F.explode(F.flatten(F.transform(texts, tokenize))).alias("token")).distinct()
    return ranked(tokens.where(F.col("token").isNotNull()), [], ["token"], "token_id")


def tokenize_pairs(
    pairs: DataFrame,
    keys: list[str],
    vocab: DataFrame | None = None,
    tokenizer: Callable[[], Callable[[list[str], int], list]] | None = None,
    max_source: int | None = None,
    max_target: int | None = None,
    prefix: str = C.SEQ2SEQ_PREFIX,
) -> DataFrame:
    """(keys, input_ids, attention_mask, labels) of (text1, text2) pairs; cut only to a length that is given.

    A row per pair; a NULL side has no ids. The mask is 1 for every id, as nothing is padded. ``tokenizer`` makes, once per
    task, a function ``(texts, max length) -> lists of ids`` (``operators.subwords.tokenizer`` does). Without one, ids come from
    ``vocab`` (default: the vocabulary of the pairs themselves), and words that it lacks have the id 0.
    """
    if tokenizer is not None:
        schema = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = tokenizer()
            for pdf in batches:
                source = encode([None if t is None else prefix + t for t in pdf.text1], max_source)
                yield pdf[keys].assign(input_ids=source, labels=encode(pdf.text2.tolist(), max_target))

        coded = pairs.select(*keys, "text1", "text2").mapInPandas(run, schema + ", input_ids array<int>, labels array<int>")
        return coded.select(*keys, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), "labels")

    vocab = vocabulary(pairs, prefix=prefix) if vocab is None else vocab
    vocab = vocab.select("token", "token_id")

    def tagged(tokens, side):
        return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.lit(side).alias("side"), i.alias("i")))

    def cut_to(tokens, n):
        return tokens if n is None else F.slice(tokens, 1, n)

    none = F.array().cast("array<string>")
    source = F.coalesce(cut_to(tokenize(F.concat(F.lit(prefix), F.col("text1"))), max_source), none)
    target = F.coalesce(cut_to(tokenize(F.col("text2")), max_target), none)
    rows = pairs.select(
        *keys, F.explode_outer(F.concat(tagged(source, 0), tagged(target, 1))).alias("x")
    ).select(*keys, "x.*")
    # A join of any size: a word that fills large parts of all texts is a skewed key, which adaptive execution splits.
    coded = rows.join(vocab, "token", "left")
    entry = F.struct("i", F.coalesce("token_id", F.lit(0)).alias("token_id"))
    lists = coded.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, entry))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, entry))).alias("t"),
    )
    return lists.select(
        *keys,
        F.transform("s", lambda e: e["token_id"].cast("int")).alias("input_ids"),
        F.array_repeat(F.lit(1), F.size("s")).alias("attention_mask"),
        F.transform("t", lambda e: e["token_id"].cast("int")).alias("labels"),
    )
