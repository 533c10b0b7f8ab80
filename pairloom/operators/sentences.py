"""Sentences told apart by what a corpus shows: its abbreviations and the words that begin its sentences.

A period ends a sentence unless it belongs to an abbreviation, an initial or a number. Abbreviations are word types that
stand with a period more often than chance lets them, being short, by a log-likelihood ratio of (word, period) counts; sentence
starters are types that follow a certain sentence end more often than chance lets them, by a ratio of (end, next
word) counts. Both come from counts per type, aggregated before they are shuffled, so a learned table has as many rows as the corpus has such
words. ``count_sentences`` joins it; ``counter`` turns a small one into a column function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import split_words
from pairloom.session import cut

# Published values of the unsupervised method (Kiss and Strunk, 2006).
ABBREVIATION_SCORE, STARTER_SCORE, PERIOD_SHARE = 0.3, 30.0, 0.99
OPENING = r"""^["'(\[{«»„“”‘’‚¿¡]+"""
OPENERS, CLOSERS = "\"'([{«»„“”‘’‚¿¡", "\"')]}«»“”‘’"  # the same characters, as a list
CLOSING = r"""["')\]}«»“”‘’]+$"""
HARD, ELLIPSIS, DOT = r"[!?]$", r"(\.\.+|…)$", r"\.$"
NUMBER, INITIAL, LETTER, WORD = r"^[0-9][0-9.,:]*$", r"^\p{L}$", r"\p{L}", r"^\p{L}+$"
BIG, SMALL = r"^\p{Lu}", r"^\p{Ll}"
MOST_TYPES = 5_000  # of a column function, whose types travel in the plan


def cores(text: Column) -> Column:
    """The words of a text without quotes and brackets around them; none are empty."""
    bare = F.transform(split_words(text), lambda w: F.rtrim(F.ltrim(w, F.lit(OPENERS)), F.lit(CLOSERS)))
    return F.filter(bare, lambda w: w != "")


def word_type(core: Column) -> Column:
    """A word in lower case, without the period at its end."""
    return F.lower(F.when(core.endswith("."), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core))


def with_period(core: Column) -> Column:
    """Ends with a single period."""
    return core.endswith(".") & ~core.endswith("..")


def _words(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, core, next): every word and the one after it, NULL after the last."""
    listed = texts.select(*keys, cores(F.col(text)).alias("_w"))
    paired = F.transform("_w", lambda w, i: F.struct(w.alias("core"), F.get("_w", i + 1).alias("next")))
    return listed.select(*keys, F.explode(paired).alias("_p")).select(*keys, "_p.*")


def _times_log(n: Column, p: Column) -> Column:
    return F.when(n > 0, n * F.ln(p)).otherwise(F.lit(0.0))


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, dot, follows, before, sure, n): how often a type stands with and without a period, at a text's begin or after another word.

    ``before`` is the type of a word before that has a period, and ``sure`` says that a sentence ends there if that is no
    abbreviation. Both models are learned from these counts, so the texts are taken apart once.
    """
    listed = texts.select(cores(F.col(text)).alias("_w"))
    paired = F.transform("_w", lambda w, i: F.struct(w.alias("core"), F.when(i > 0, F.get("_w", i - 1)).alias("last")))
    words = listed.select(F.explode(paired).alias("_p")).select("_p.*")
    before = F.when(with_period(F.col("last")), word_type(F.col("last")))
    placed = words.select(
        word_type(F.col("core")).alias("type"), with_period(F.col("core")).alias("dot"), F.col("last").isNotNull().alias("follows"),
        before.alias("before"), (F.col("last").endswith("!") | F.col("last").endswith("?")).alias("hard"),
    )
    counts = placed.groupBy("type", "dot", "follows", "before", "hard").agg(F.count("*").alias("n"))
    sure = F.col("hard") | F.col("before").isNotNull() & ~F.col("before").rlike(NUMBER) & ~F.col("before").rlike(INITIAL)
    return counts.select("type", "dot", "follows", "before", sure.alias("sure"), "n")


def abbreviations(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, score) of the abbreviations in a corpus.

    A type's ratio compares "the period comes by chance" with "it nearly always comes"; it is scaled down by the length of
    the type, down again for every time it stands without a period, and up by its inner periods.
    """
    return _abbreviations(word_counts(texts, text))


def _abbreviations(words: DataFrame) -> DataFrame:
    counts = cut(words.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(F.lit(0))).alias("dots")))
    whole = counts.agg(F.sum("n").alias("n"), F.sum("dots").alias("dots")).first()
    chance = F.lit(float(whole["dots"] or 0) / (whole["n"] or 1))
    inner = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    without = F.col("n") - F.col("dots")
    by_chance = _times_log(F.col("dots"), chance) + _times_log(without, 1 - chance)
    nearly_always = F.col("dots") * F.ln(F.lit(PERIOD_SHARE)) + without * F.ln(F.lit(1 - PERIOD_SHARE))
    score = -2 * (by_chance - nearly_always) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -without)
    able = (F.col("dots") > 0) & F.col("type").rlike(LETTER)
    return counts.where(able).select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION_SCORE)


def starters(texts: DataFrame, short: DataFrame, text: str = "text") -> DataFrame:
    """(type, score) of the words that begin sentences, given the abbreviations.

    Certain ends are exclamation and question marks, and periods after what is no abbreviation, initial or number. Of the words
    before a period only distinct types meet the abbreviations, and of the next words only counts per pair of types.
    """
    return _starters(word_counts(texts, text), short)


def _starters(words: DataFrame, short: DataFrame) -> DataFrame:
    ends = F.sum(F.when(F.col("sure"), F.col("n")).otherwise(F.lit(0))).alias("ends")
    pairs = words.where("follows").groupBy("before", "type").agg(F.sum("n").alias("n"), ends)
    known = short.select(F.col("type").alias("before"), F.lit(True).alias("short"))
    judged = pairs.join(known, "before", "left").withColumn("ends", F.when(F.col("short"), F.lit(0)).otherwise(F.col("ends")))
    counts = cut(judged.groupBy("type").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    whole = counts.agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).first()
    total, ends = F.lit(float(whole["n"] or 1)), F.lit(float(whole["ends"] or 0))
    both, n = F.col("ends"), F.col("n")
    p, p1, p2 = n / total, F.try_divide(both, ends), F.try_divide(n - both, total - ends)

    def likely(k: Column, m: Column, share: Column) -> Column:
        return _times_log(k, share) + _times_log(m - k, 1 - share)

    ratio = -2 * (likely(both, ends, p) + likely(n - both, total - ends, p) - likely(both, ends, p1) - likely(n - both, total - ends, p2))
    often = (both > 0) & (p1 > p) & F.col("type").rlike(WORD)
    return counts.where(often).select("type", ratio.alias("score")).where(F.col("score") >= STARTER_SCORE)


def learn(texts: DataFrame, text: str = "text") -> DataFrame:
    """(kind, type, score): ``abbreviation`` and ``starter`` rows learned from all texts; NULL and empty ones have no words."""
    words = cut(word_counts(texts, text))
    short = cut(_abbreviations(words))
    first = _starters(words, short)
    return cut(short.select(F.lit("abbreviation").alias("kind"), "type", "score").unionByName(first.select(F.lit("starter").alias("kind"), "type", "score")))


def ends(core: Column, following: Column, is_short: Column, is_starter: Column) -> Column:
    """Whether a sentence ends between a word and the next one.

    After an abbreviation or an initial only before a capitalised sentence starter, after a number with a period not before a small
    letter, after an ellipsis only before a capital.
    """
    kind = word_type(core)
    starts = is_starter & following.rlike(BIG)
    return (
        F.when(core.endswith("!") | core.endswith("?"), F.lit(True))
        .when(core.endswith("..") | core.endswith("…"), following.rlike(BIG))
        .when(~core.endswith("."), F.lit(False))
        .when(kind.rlike(NUMBER), ~following.rlike(SMALL))
        .when(kind.rlike(INITIAL) | is_short, starts)
        .otherwise(F.lit(True))
    )


def count_sentences(texts: DataFrame, model: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, sentences): by joins with the learned table, whatever its size; texts without words have 0.

    Only words that could end a sentence are joined. ``keys`` identify a text.
    """
    words = _words(texts, keys, text)
    marked = words.where(F.col("next").isNotNull() & (F.right("core", F.lit(1)).isin("!", "?", ".", "…")))
    short = model.where("kind = 'abbreviation'").select(F.col("type").alias("_type"), F.lit(True).alias("_short"))
    first = model.where("kind = 'starter'").select(F.col("type").alias("_next"), F.lit(True).alias("_first"))
    known = marked.withColumns({"_type": word_type(F.col("core")), "_next": word_type(F.col("next"))}).join(short, "_type", "left").join(first, "_next", "left")
    told = known.where(ends(F.col("core"), F.col("next"), F.coalesce("_short", F.lit(False)), F.coalesce("_first", F.lit(False))))
    found = told.groupBy(*keys).agg(F.count("*").alias("_ends"))
    sizes = texts.select(*keys, (F.size(cores(F.col(text))) > 0).alias("_any"))
    number = F.when(F.col("_any"), F.coalesce("_ends", F.lit(0)) + 1).otherwise(F.lit(0)).cast("bigint")
    return sizes.join(found, list(keys), "left").select(*keys, number.alias("sentences"))


def _in_row(text: Column, is_short: Callable[[Column], Column], is_starter: Callable[[Column], Column]) -> Column:
    words = cores(text)
    paired = F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("core"), b.alias("next"))), lambda p: p["next"].isNotNull())
    breaks = F.filter(paired, lambda p: ends(p["core"], p["next"], is_short(word_type(p["core"])), is_starter(word_type(p["next"]))))
    return F.when(F.size(words) > 0, F.size(breaks) + 1).otherwise(F.lit(0))


def count_in_row(texts: DataFrame, model: DataFrame, keys: Sequence[str], text: str = "text", out: str = "sentences") -> DataFrame:
    """``texts`` with the number of sentences, counted in the row as ``counter`` does, with a learned table of any size.

    A row gets those learned types that are words of its own and could matter. ``keys`` identify a text.
    """
    listed = texts.select(*keys, cores(F.col(text)).alias("_w"))
    dotted = F.filter("_w", lambda w: w.endswith("."))
    later = F.filter("_w", lambda w, i: (i > 0) & F.get("_w", i - 1).endswith("."))

    def named(kind: str, words: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(words, word_type)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("type")))

    types = F.concat(named("abbreviation", dotted), named("starter", later))
    own = listed.select(*keys, F.explode(types).alias("_t")).select(*keys, "_t.*")
    known = own.join(model.select("kind", "type"), ["kind", "type"], "left_semi").groupBy(*keys).agg(
        *[F.collect_set(F.when(F.col("kind") == kind, F.col("type"))).alias(name) for kind, name in (("abbreviation", "_short"), ("starter", "_first"))]
    )
    none = F.array().cast("array<string>")
    joined = texts.join(known, list(keys), "left").withColumns({c: F.coalesce(c, none) for c in ("_short", "_first")})
    counted = _in_row(F.col(text), lambda t: F.array_contains("_short", t), lambda t: F.array_contains("_first", t))
    return joined.withColumn(out, counted).drop("_short", "_first")


def counter(model: DataFrame) -> Callable[[Column], Column]:
    """A column function of a text's number of sentences; the learned table travels in the plan, so its size is checked."""
    rows = model.select("kind", "type").limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} learned types: use count_sentences or count_in_row")
    short, first = ([r.type for r in rows if r.kind == kind] for kind in ("abbreviation", "starter"))
    return lambda text: _in_row(text, lambda t: t.isin(short), lambda t: t.isin(first))
