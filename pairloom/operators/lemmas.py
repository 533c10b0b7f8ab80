"""Lemmas of words that a table of lemmas lacks: rules by suffix, induced from the table.

Each (token, lemma) of the table says how many characters to cut from the token's end and what to add; every suffix of the token
that reaches over the cut is a witness. A suffix keeps the rule that most of its tokens follow, and a word takes the rule of its
longest suffix that has one. Suffixes are keys of equi-joins, on distinct words, so no table of rules has to fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST, LEAST = 6, 2  # characters of a suffix; tokens of the table that must bear a rule out


def _common(a: Column, b: Column) -> Column:
    """Characters that two words begin with alike."""
    shorter = F.least(F.length(a), F.length(b))
    alike = F.filter(F.sequence(F.lit(0), shorter), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.array_max(alike)


def _suffixes(rows: DataFrame, token: str, shortest: Column, longest: int) -> DataFrame:
    """A row for every suffix of the token of at least ``shortest`` and at most ``longest`` characters."""
    most = F.least(F.lit(longest), F.length(token))
    sizes = F.when(shortest <= most, F.sequence(shortest, most)).otherwise(F.array().cast("array<int>"))
    return rows.select("*", F.explode(sizes).alias("size")).withColumn("suffix", F.expr(f"right(`{token}`, size)"))


def learn_rules(lemmas: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(suffix, cut, add, n) from (token, lemma); ``n`` tokens of the table follow the rule.

    Repeated rows count once; rows with a NULL or empty side teach nothing. Of rules that as many tokens follow, that which cuts least, then
    adds first by letter.
    """
    rows = lemmas.select("token", "lemma").where("token <> '' AND lemma <> ''").distinct()
    edits = rows.withColumn("_same", _common(F.col("token"), F.col("lemma"))).select(
        "token", (F.length("token") - F.col("_same")).alias("cut"), F.expr("substring(lemma, _same + 1)").alias("add"),
    )
    seen = _suffixes(edits, "token", F.greatest("cut", F.lit(1)), longest)
    counts = seen.groupBy("suffix", "cut", "add").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # few rules share a suffix: all are endings of it
    first = Window.partitionBy("suffix").orderBy(F.desc("n"), "cut", "add")
    return counts.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def lemmatize(tokens: DataFrame, lemmas: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(token, lemma, known) of the distinct ``token`` values: from the table, else by rule, else the token itself.

    Of a table with several lemmas for a token the first by letter counts. A rule that would leave nothing is not taken.
    """
    words = tokens.select("token").where(F.col("token").isNotNull()).distinct()
    table = lemmas.where("token IS NOT NULL AND lemma IS NOT NULL").groupBy("token").agg(F.min("lemma").alias("_known"))
    found = words.join(table, "token", "left")
    new = _suffixes(found.where(F.col("_known").isNull()).select("token"), "token", F.lit(1), longest)
    ruled = new.join(rules, "suffix").where((F.length("token") > F.col("cut")) | (F.col("add") != ""))
    best = ruled.groupBy("token").agg(F.max_by(F.struct("cut", "add"), "size").alias("_rule"))
    edited = F.concat(F.expr("left(token, length(token) - _rule.cut)"), F.col("_rule.add"))
    return found.join(best, "token", "left").select("token", F.coalesce("_known", edited, "token").alias("lemma"), F.col("_known").isNotNull().alias("known"))
