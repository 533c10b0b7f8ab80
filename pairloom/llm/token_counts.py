"""Token counts with a byte-level BPE vocabulary, most of them without merging anything.

Loading proves, once and for each string of the vocabulary, whether its bytes merge to that one token when
the string stands alone as a pre-token. A pre-token that is such a string counts one; only the others are
merged. Texts are cut at single blanks first, where a pre-token always begins, so what is looked up is mostly a
word with the blank before it.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bpe import byte_characters
from pairloom.llm.common import share, slices

# The cut into pre-tokens that a byte-level tokenizer file implies: fixed by the format.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces between blanks that a worker remembers, and the longest that it does.
MEMO, LONGEST = 300_000, 64
# Tokens are numbers below 2^20; pre-tokens up to so many bytes are merged all at once.
BITS, MASK, NONE, SHORT = 20, (1 << 20) - 1, 1 << 62, 96
OTHER = "☃"  # neither blank, letter nor number in any version of Unicode


def newer_characters() -> list[int]:
    """Letters and numbers of the pattern library here that the tokenizers library does not know as such yet."""
    from tokenizers import Regex, pre_tokenizers

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    mine = regex.sub(r"[^\p{L}\p{N}]", "", everything)
    theirs = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(mine)
    return sorted({ord(c) for piece, _ in theirs for c in piece})


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file: no normalizer, no prefix space, special tokens found in raw text."""

    def __init__(self, spec: dict):
        model, cut = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer file")
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {token: bytes(byte[c] for c in text) for text, token in model["vocab"].items() if text not in special}
        vocab = model["vocab"]
        self.bytes = [vocab[c] for c in byte_characters()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # a pair of tokens in one number, and rank with the token that comes of it in another
        self.merges = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = sorted(special, key=len, reverse=True)
        self.newer = newer_characters()
        self.proved = self.prove(raw)
        self.set_up()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("bytes", "merges", "special", "newer", "proved")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.set_up()

    def set_up(self) -> None:
        self.byte_ids = np.array(self.bytes, np.int64)
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[k] for k in sorted(self.merges)], np.int64)
        self.pattern = regex.compile(PRE_TOKENS)
        self.blanks = regex.compile(r" (?=\S)")
        self.wide_blank = regex.compile(r" (?:\s|\Z)")
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.as_other = dict.fromkeys(self.newer, OTHER)
        self.newer_letters = frozenset(map(chr, self.newer))
        # a piece stands for the blank before it and itself
        self.whole = {s[1:]: 1 for s in self.proved if s[0] == " " and len(s) > 1 and self.cut(s) == [s]}
        self.known = dict(self.whole)

    def prove(self, raw: dict[int, bytes]) -> frozenset[str]:
        """The vocabulary's strings whose bytes merge to their own token alone; parts of characters can be no pre-token."""
        proved = []
        for token, text in raw.items():
            try:
                string = text.decode()
            except UnicodeDecodeError:
                continue
            if self.merged_long(text) == [token]:
                proved.append(string)
        return frozenset(proved)

    def merged(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each of some pre-tokens has: the pair of least rank, leftmost first, is merged until none has a rank.

        All words take a step at once. ``ranks`` has for every symbol the rank of the pair that it begins.
        """
        counts = np.zeros(len(words), np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.array([len(w) for w in words], np.int64)
        word, at = np.arange(len(words)), np.cumsum(sizes) - sizes
        ranks = self.ranks(ids[:-1], ids[1:])
        ranks = np.append(ranks, NONE)
        ranks[at + sizes - 1] = NONE
        while len(word):
            least = np.minimum.reduceat(ranks, at)
            ended = least == NONE
            if ended.any():
                counts[word[ended]] = sizes[ended]
                stay = np.repeat(~ended, sizes)
                ids, ranks = ids[stay], ranks[stay]
                word, sizes, least = word[~ended], sizes[~ended], least[~ended]
                at = np.cumsum(sizes) - sizes
                if not len(word):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            here = hits[np.searchsorted(hits, at)]
            ids[here] = least & MASK
            end = at + sizes - 1
            left, right = here[here > at], here[here + 1 < end]
            ranks[here] = NONE
            ranks[right] = self.ranks(ids[right], ids[right + 2])
            ranks[left - 1] = self.ranks(ids[left - 1], ids[left])
            stay = np.ones(len(ids), bool)
            stay[here + 1] = False
            ids, ranks, sizes = ids[stay], ranks[stay], sizes - 1
            at = np.cumsum(sizes) - sizes
        return counts

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merged_long(self, text: bytes) -> list[int]:
        """The same tokens from a heap of pairs over a linked list, so that a million bytes take n log n steps."""
        ids, n, rank = [self.bytes[b] for b in text], len(text), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue  # one of the two went into another token meanwhile
            token = ids[i] = least & MASK
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(token << BITS | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, token, ids[k]))
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << BITS | token)) is not None:
                heapq.heappush(heap, (r, h, ids[h], token))
        return [t for t in ids if t >= 0]

    def cut(self, text: str) -> list[str]:
        """Pre-tokens; characters that the tokenizers library takes for neither letter nor number count as such here."""
        if text.isascii():
            if text[1:].isalpha() and (text[0] == " " or text.isalpha()):
                return [text]
        elif not self.newer_letters.isdisjoint(text):
            plain = text.translate(self.as_other)
            return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
        return self.pattern.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of texts without special tokens in them: one for each proved pre-token, the others are merged."""
        proved, known = self.proved, self.known
        counts, rest = [], []
        for n, t in enumerate(texts):
            ones = 0
            for p in self.cut(t):
                if p in proved:
                    ones += 1
                elif p[0] == " " and (seen := known.get(p[1:])):
                    ones += seen  # known as a piece, without what hangs on to it here
                else:
                    rest.append((n, p.encode()))
            counts.append(ones)
        short = [r for r in rest if len(r[1]) <= SHORT]
        if short:
            for (n, _), tokens in zip(short, self.merged([p for _, p in short]).tolist(), strict=True):
                counts[n] += tokens
        for n, p in rest:
            if len(p) > SHORT:
                counts[n] += len(self.merged_long(p))
        return counts

    def pieces(self, text: str) -> list[str]:
        """The text cut before each blank that something visible follows, without those blanks.

        There a pre-token begins, whatever stands before: blanks leave their last one to the word that follows.
        """
        return self.blanks.split(text) if self.wide_blank.search(text) else text.split(" ")

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of every text, none for NULL."""
        parts, extra = [], []
        for t in texts:
            raw = self.specials.split(t) if t and self.specials and self.specials.search(t) else [t] if t else []
            extra.append(max(len(raw) - 1, 0))
            parts.append([self.pieces(r) for r in raw if r])
        runs = set().union(*(p[1:] for ps in parts for p in ps))
        known = self.known
        if len(known) > MEMO + len(self.whole):
            self.known = known = self.whole | {r: known[r] for r in runs if r in known}
        fresh = [r for r in runs if r not in known]
        known |= dict(zip(fresh, self.count([" " + r for r in fresh]), strict=True))
        first = iter(self.count([p[0] for ps in parts for p in ps]))
        get = known.__getitem__
        counts = [e + sum(next(first) + sum(map(get, p[1:])) for p in ps) for e, ps in zip(extra, parts, strict=True)]
        for r in fresh:
            if len(r) > LONGEST:
                del known[r]
        return counts


def load(path: str) -> ByteBpe:
    """Read a tokenizer file on the driver and prove its strings; tables of some megabytes, of the vocabulary's size, are broadcast."""
    with open(path, encoding="utf-8") as f:
        return ByteBpe(json.load(f))


def count(docs: DataFrame, coder: ByteBpe, column: str = "text", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` (of UTF-8), ``n_tokens`` and ``over_limit``.

    All rows stay, with the columns in ``keep`` (all by default); columns with the new names are replaced. NULL and empty texts have
    no bytes and no tokens. A special token's string in a text is that one token. Texts are never cut. No shuffle: a worker
    holds the tables and a bounded memo, and works on slices of texts.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    held = share(docs.sparkSession, coder)
    kept = docs.select(*[c for c in keep or docs.columns if c not in new])
    out = kept.withColumns({"n_bytes": F.lit(0).cast("bigint"), "n_tokens": F.lit(0).cast("bigint"), "over_limit": F.lit(False)})

    def run(batches):
        for batch in slices(batches, column):
            texts = batch.column(column).to_pylist()
            tokens = held().count_all(texts)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["n_bytes"] = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            columns["n_tokens"] = pa.array(tokens, pa.int64())
            columns["over_limit"] = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    names = out.columns
    return docs.select(*dict.fromkeys([*kept.columns, column])).mapInArrow(run, out.schema)
