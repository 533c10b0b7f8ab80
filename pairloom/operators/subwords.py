"""A subword vocabulary learned from a corpus: a unigram model of word pieces.

Words are counted once; everything after that works on distinct words with their counts. Candidates are the pieces that are worth most
(count times length); each round of expectation maximisation computes, in parallel over the words, how often each piece is
used in all segmentations of a word, weighted by their probabilities, adds that up by piece, and drops the least used.
The model is as large as the vocabulary that is asked for, so it may be broadcast. Texts are cut into the
most probable pieces (Viterbi); characters without a piece are unknown, words never are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions.text import tokenize
from pairloom.session import cut

BEGIN = "▁"  # stands before the first letter of a word
PAD, UNKNOWN, FIRST = 0, 1, 2
UNKNOWN_COST = 10.0  # how much worse an unknown character is than the worst piece, in log probability


def word_counts(texts: DataFrame, *columns: str) -> DataFrame:
    """(word, n): the tokens of the columns, each with its begin mark."""
    tokens = F.flatten(F.array(*[tokenize(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    return texts.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n")).select(F.concat(F.lit(BEGIN), "word").alias("word"), "n")


def candidates(words: DataFrame, seeds: int, longest: int) -> dict[str, float]:
    """The ``seeds`` pieces of at most ``longest`` characters with the highest count times length, and every character, with log probabilities."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    places = words.select("word", "n", at)
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("size")
    pieces = places.select("word", "n", "at", sizes).select(F.expr("substring(word, at, size)").alias("piece"), "n")
    counts = cut(pieces.groupBy("piece").agg(F.sum("n").alias("n")))
    kept = counts.where((F.length("piece") > 1) & (F.col("n") > 1)).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(seeds)
    letters = counts.where(F.length("piece") == 1).orderBy(F.desc("n"), "piece").limit(seeds)
    found = {r.piece: float(r.n) for r in letters.unionByName(kept).toLocalIterator()}
    return logs(found)


def logs(counts: dict[str, float]) -> dict[str, float]:
    total = sum(counts.values())
    return {p: math.log(n / total) for p, n in counts.items() if n > 0}


class Pieces:
    """Log probabilities of pieces; segments words and says how much each piece is used."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_COST

        self.longest = max(map(len, scores), default=1)
        # pieces as paths of characters: a search from a place ends where no piece goes on
        self.paths: dict = {}
        for piece, score in scores.items():
            node = self.paths
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score

    def best(self, word: str) -> list[str]:
        """The most probable segmentation; of equal ones that whose last piece is longest, and so on backwards."""
        size, none = len(word), -math.inf
        score, came = [0.0] + [none] * size, [0] * (size + 1)
        for begin in range(size):
            node, end, held = self.paths, begin, score[begin]
            for c in word[begin : begin + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                s = node.get("")
                if s is not None and held + s > score[end]:
                    score[end], came[end] = held + s, begin
            c = self.paths.get(word[begin])
            if (c is None or "" not in c) and held + self.unknown > score[begin + 1]:
                score[begin + 1], came[begin + 1] = held + self.unknown, begin
        out, end = [], size
        while end:
            out.append(word[came[end] : end])
            end = came[end]
        return out[::-1]

    def use(self, word: str) -> tuple[dict[str, float], float]:
        """Expected number of times each piece is used in a word, and the word's log probability."""
        size, none, exp, log1p = len(word), -math.inf, math.exp, math.log1p
        ahead = [0.0] + [none] * size
        # (begin, log probability) of each piece by its end, begins ascending; a character that is none is unknown
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for begin in range(size):
            node, end, held = self.paths, begin, ahead[begin]
            found = []
            for c in word[begin : begin + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                s = node.get("")
                if s is not None:
                    found.append((end, s))
            if not found or found[0][0] != begin + 1:
                found.insert(0, (begin + 1, self.unknown))
            for end, s in found:
                ending[end].append((begin, s))
                # log(exp(a) + exp(b))
                a, b = ahead[end], held + s
                if a < b:
                    a, b = b, a
                ahead[end] = a + log1p(exp(b - a)) if b > none else a
        whole = ahead[size]
        back = [none] * size + [0.0]
        expected: dict[str, float] = {}
        for end in range(size, 0, -1):
            rest = back[end]
            for begin, s in ending[end]:
                a, b = back[begin], rest + s
                if a < b:
                    a, b = b, a
                back[begin] = a + log1p(exp(b - a)) if b > none else a
                piece = word[begin:end]
                expected[piece] = expected.get(piece, 0.0) + exp(ahead[begin] + s + rest - whole)
        return expected, whole


def _round(words: DataFrame, scores: dict[str, float]) -> tuple[dict[str, float], float]:
    """Expected counts of the pieces over all words, and the log likelihood of the corpus."""
    held = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, total, likelihood = Pieces(held.value), {}, 0.0
        for pdf in batches:
            for word, n in zip(pdf.word, pdf.n.tolist(), strict=True):
                used, score = pieces.use(word)
                likelihood += n * score
                for p, share in used.items():
                    if p in pieces.scores:
                        total[p] = total.get(p, 0.0) + n * share
        yield pd.DataFrame([*total.items(), (None, likelihood)], columns=["piece", "n"])

    sums = words.mapInPandas(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    found = {r.piece: r.n for r in sums.toLocalIterator()}
    return {p: n for p, n in found.items() if p is not None}, found.get(None, 0.0)


def learn(texts: DataFrame, columns: tuple[str, ...] = ("text",), size: int = 8000, seeds: int | None = None, longest: int = 8, rounds: int = 4) -> list[tuple[str, float]]:
    """(piece, log probability) of at most ``size`` pieces, most probable first; their place plus ``FIRST`` is their id.

    From ``seeds`` candidates (four times the size by default) each round keeps fewer; single characters stay as long as there is
    room. An empty corpus has no pieces.
    """
    words = cut(word_counts(texts, *columns))
    scores = candidates(words, seeds or 4 * size, longest)
    start = len(scores)
    for n in range(1, rounds + 1):
        if not scores:
            break
        counts, _ = _round(words, scores)
        room = max(size, round(start * (size / start) ** (n / rounds)))
        order = sorted(counts, key=lambda p: (len(p) > 1, -counts[p], p))
        letters = [p for p in order if len(p) == 1]
        kept = letters[:room] + [p for p in order if len(p) > 1][: max(0, room - len(letters))]
        scores = logs({p: counts[p] for p in kept})
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def tokenizer(model: list[tuple[str, float]], memo: int = 200_000) -> Callable[[], Callable[[list[str | None], int | None], list[list[int]]]]:
    """For ``tokenize_pairs``: makes, once per task, a function (texts, longest) -> ids. NULL texts have none."""
    def make():
        pieces = Pieces(dict(model))
        ids = {p: FIRST + i for i, (p, _) in enumerate(model)}
        known: dict[str, list[int]] = {}

        def encode(texts: list[str | None], longest: int | None) -> list[list[int]]:
            out = []
            for text in texts:
                row: list[int] = []
                for word in words_of(text):
                    if word not in known:
                        if len(known) >= memo:
                            known.clear()
                        known[word] = [ids.get(p, UNKNOWN) for p in pieces.best(BEGIN + word)]
                    row += known[word]
                    if longest is not None and len(row) >= longest:
                        break
                out.append(row if longest is None else row[:longest])
            return out

        return encode

    return make


def words_of(text: str | None) -> list[str]:
    """The tokens that ``functions.text.tokenize`` makes, in Python."""
    return text.encode().translate(None, _DROPPED).decode().lower().split() if text else []


_DROPPED = C.ASCII_PUNCTUATION.encode()
