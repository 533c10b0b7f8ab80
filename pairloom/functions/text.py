"""Text columns: white space, tokens, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import constants as C


def strip_text(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(C.WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip_text(text) == ""


def preview(text: Column, n: int = 100) -> Column:
    return F.substring(text, 1, n)


def strip_punct(text: Column) -> Column:
    """Delete ASCII punctuation; nothing takes its place."""
    return F.translate(text, C.ASCII_PUNCTUATION, "")


# Every white-space character but the plain space, to be replaced by it.
_OTHER_SPACE = C.WHITESPACE.replace(" ", "")


def _split_at_spaces(text: Column) -> Column:
    return F.array_remove(F.split(text, " +"), "")


def split_words(text: Column) -> Column:
    """White-space separated words; no empty words, also at the edges."""
    return _split_at_spaces(F.translate(text, _OTHER_SPACE, " " * len(_OTHER_SPACE)))


def _words_of(text: Column, gaps: str, contractions: bool = False) -> Column:
    """Words of the lower-cased text: punctuation deleted, ``gaps`` split at."""
    return F.split(plain_words(text, gaps, contractions), " +")


def plain_words(text: Column, gaps: str, contractions: bool = False) -> Column:
    """The lower-cased text with a space for each of ``gaps`` and without punctuation."""
    plain = F.lower(F.translate(text, gaps + C.ASCII_PUNCTUATION, " " * len(gaps)))
    return split_contractions(plain) if contractions else plain


def word_gaps(mode: str) -> str:
    if mode not in ("full", "basic"):
        raise ValueError(f"mode must be 'full' or 'basic', not {mode!r}")
    return _OTHER_SPACE + C.TYPOGRAPHIC_QUOTES if mode == "full" else _OTHER_SPACE


def tokenize(text: Column) -> Column:
    """Words of the lower-cased text without ASCII punctuation."""
    return F.array_remove(_words_of(text, _OTHER_SPACE), "")


def remove_stopwords(tokens: Column, stopwords: Sequence[str] = C.STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stopwords)) if stopwords else tokens


def keep_alnum(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(C.ALNUM_TOKEN))


def truncate_tokens(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def split_contractions(text: Column) -> Column:
    """Split the run-together words that the English tokenizer splits."""
    for word, parts in C.CONTRACTIONS.items():
        text = F.regexp_replace(text, rf"\b{word}\b", parts)
    return text


def candidate_words(text: Column, mode: str = "full", contractions: bool = False) -> Column:
    """Words to be tested by :func:`is_wanted`; there may be empty ones."""
    return _words_of(text, word_gaps(mode), contractions)


def is_wanted(word: Column, mode: str = "full", stopwords: Sequence[str] = C.STOPWORDS) -> Column:
    if mode == "basic":
        return word != ""
    wanted = word.rlike(C.ALNUM_TOKEN)
    return ~word.isin(*stopwords) & wanted if stopwords else wanted


def normalize_text(
    text: Column,
    mode: str = "full",
    stopwords: Sequence[str] = C.STOPWORDS,
    contractions: bool = False,
) -> Column:
    """Comparison tokens of a text.

    ``basic`` lower-cases, deletes punctuation and splits. ``full`` also sets
    typographic quotes apart and drops stopwords and tokens that are not wholly
    letters and digits. Stopwords are tested after punctuation is gone, so
    ``don't`` is the kept token ``dont``.
    """
    return F.filter(candidate_words(text, mode, contractions), lambda w: is_wanted(w, mode, stopwords))


def sentence_count(text: Column) -> Column:
    """Runs of text between terminators; runs of white space alone are none."""
    # from a run's first character that is not white space to its end
    return F.regexp_count(text, F.lit("[^.!?" + C.WHITESPACE_CLASS[1:] + "[^.!?]*"))
