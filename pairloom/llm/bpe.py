"""Byte-pair encoding and decoding with a vocabulary in the tokenizers library's file format.

The encoding of a word is found from its prefixes: for each prefix exactly one token can end it, namely the
suffix whose token may follow the last token of the prefix before. The distinct words of a slice of texts are
inserted in a trie in sorted order, so that nodes come up depth first; each node's last token is
computed once from its ancestors', for all words that share the prefix. Reading last tokens back from a leaf
gives the word's encoding.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import share, slices

# Words whose encoding a worker remembers between slices, and pairs of tokens it has judged.
WORD_MEMO, PAIR_MEMO = 200_000, 200_000
# Bytes of text whose words are in a worker's memory at once.
SLICE = 2 << 20
END = float("inf")
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


def unicode_differences() -> tuple[list[str], dict[int, str]]:
    """Where the tokenizers library knows another version of Unicode than Python does here.

    Letters and numbers of the pattern library that are not yet such for the tokenizer, and characters unknown
    to Python that the tokenizer changes to lower case.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    letters = regex.compile(r"[\p{L}\p{N}]")
    unknown = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
    theirs = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed")
    newer = theirs.pre_tokenize_str("".join(c for c in unknown if letters.match(c)))
    lower = normalizers.Lowercase()
    return sorted(c for piece, _ in newer for c in piece), {ord(c): low for c in unknown if (low := lower.normalize_str(c)) != c}


class WordBpe:
    """Vocabulary and merges of a word BPE whose last symbol of a word carries a suffix.

    Supports what such files state: NFC, blanks to one space, lower case; words split off by a pattern, the
    rest dropped; byte-level symbols; special tokens recognised in the raw text; no decoder.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {**added}
        self.strings = {i: t.encode() for t, i in (self.vocab | added).items()}
        self.token_list = [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]
        rank = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            rank[self.vocab[a] << 32 | self.vocab[b]] = (r, self.vocab[a + b])
        self.rank = rank
        self.matcher()
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.newer, self.cases = unicode_differences()
        self.set_up()

    def set_up(self) -> None:
        # Letters and numbers as of the Unicode version of the tokenizer's own pattern library: a run with a newer
        # letter is split by the strict pattern.
        newer = "".join(map(regex.escape, self.newer))
        pattern = self.pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[^\s\p{L}\p{N}]", rf"[^\s[[\p{{L}}\p{{N}}]--[{newer}]]]")
        self.words = regex.compile(self.pattern)
        self.strict = regex.compile(pattern, regex.V1) if newer else self.words
        self.first_newer = min(self.newer, default=chr(0x10FFFF))
        self.first_newer = min(self.newer, default=chr(0x10FFFF))
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.suffix) or t == self.suffix}
        self.final = {t[: -len(self.suffix)]: i for t, i in self.vocab.items() if t.endswith(self.suffix) and t != self.suffix}
        self.blanks = regex.compile(r"\s+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.characters = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list] | None] = {}

    def matcher(self) -> None:
        """An automaton that knows, after each symbol, the longest token that the text so far ends with.

        Symbols are bytes, plus 256 for the last of a word. ``shorter`` leads from a token to the next one among its
        own endings, ``length`` counts symbols.
        """
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.goto, self.longest, self.length, self.shorter = {}, [-1], {}, {}
        for text, token in self.vocab.items():
            parts = self.symbols(text)
            symbols = [byte_of[p[0]] | (256 if len(p) > 1 else 0) for p in parts]
            state = 0
            for symbol in symbols:
                key = state << 9 | symbol
                if key not in self.goto:
                    self.goto[key] = len(self.longest)
                    self.longest.append(-1)
                state = self.goto[key]
            self.longest[state], self.length[token] = token, len(symbols)
        self.fail = [0] * len(self.longest)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.goto.items():
            below.setdefault(key >> 9, []).append((key & 511, state))
        queue = [state for _, state in below[0]]
        for state in queue:  # grows while it is read: breadth first
            back = self.longest[self.fail[state]]
            if self.longest[state] < 0:
                self.longest[state] = back
            else:
                self.shorter[self.longest[state]] = back
            for symbol, next_state in below.get(state, ()):
                at = self.fail[state]
                while at and at << 9 | symbol not in self.goto:
                    at = self.fail[at]
                self.fail[next_state] = self.goto.get(at << 9 | symbol, 0)
                queue.append(next_state)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("vocab", "suffix", "special", "strings", "token_list", "rank", "goto", "fail", "longest", "shorter", "length", "pattern", "newer", "cases")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.set_up()

    # --- text to words ---

    def between_blanks(self, text: str) -> list[str]:
        """What stands between blanks, in lower case, and special tokens by themselves, after a blank, in order."""
        if self.specials is None or "<" not in text:
            return self.lowered(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [" " + part] if i % 2 else self.lowered(part)
        return out

    def lowered(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # is then in NFC
        except UnicodeEncodeError:
            # Lower-casing goes character by character: a capital sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).translate(self.cases).replace("\u03a3", "\u03c3")
        if SEPARATORS.search(text):  # str.split would take them for blanks
            return [r for r in self.blanks.split(text.lower()) if r]
        return text.lower().split()

    # --- tokens of words ---

    def symbols(self, token: str) -> list[str]:
        body, end = (token[: -len(self.suffix)], self.suffix) if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else (token, "")
        return [*body[:-1], body[-1] + end]

    def spine(self, token: int) -> tuple[list, list] | None:
        """The tokens at the right and at the left border while the token is merged, with the rank that consumes each.

        None if merging the token's symbols does not lead to the token, so that it never occurs.
        """
        if token in self.spines:
            return self.spines[token]
        parts = [self.vocab.get(s) for s in self.symbols(self.strings[token].decode())]
        made: dict[int, tuple[int, int, int]] = {}
        while len(parts) > 1 and None not in parts:
            best = min(((self.rank.get(a << 32 | b, (END, 0)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=None)
            (r, whole), i = best
            if r == END:
                break
            made[whole] = (parts[i], parts[i + 1], r)
            parts[i : i + 2] = [whole]
        if parts != [token]:
            self.spines[token] = None
            return None
        sides = []
        for side in (1, 0):
            chain, at, until = [], token, END
            while True:
                chain.append((at, until))
                if at not in made:
                    break
                until, at = made[at][2], made[at][side]
            sides.append(chain[::-1])
        self.spines[token] = (sides[0], sides[1])
        return self.spines[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text gives these two tokens.

        Runs through the symbols that meet at the border while both sides are merged. A pair is merged across
        it if its rank comes before the rank that consumes the left symbol and not after the one that consumes the right.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b = self.spine(left), self.spine(right)
        ok = a is not None and b is not None
        if ok:
            a, b, i, j = a[0], b[1], 0, 0
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                r = self.rank.get(x << 32 | y)
                if r is not None and r[0] < x_until and r[0] <= y_until:
                    ok = False
                    break
                if x_until == END and y_until == END:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode distinct words through a trie: their ids as little-endian bytes.

        Sorted words lay out the trie depth first. ``states``, ``lasts`` and ``sizes`` stand for the path from the root
        to the current node: a word keeps what it shares with the word before and adds nodes of its own below.
        """
        out: dict[str, bytes] = {}
        goto, fail, longest, shorter, length, judged = self.goto.get, self.fail, self.longest, self.shorter, self.length, self.pairs.get
        states, lasts, sizes, before = [0], [0], [0], b""
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(raw), len(before)) - 1
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], lasts[shared + 1 :], sizes[shared + 1 :]
            before, end = raw, len(raw)
            state = states[shared]
            for i in range(shared + 1, end + 1):
                symbol = raw[i - 1] | 256 if i == end else raw[i - 1]
                below = goto(state << 9 | symbol)
                while below is None:
                    state = fail[state]
                    below = goto(state << 9 | symbol)
                state, token = below, longest[below]
                while True:  # from the longest token that the prefix ends with to shorter ones
                    start = i - length[token]
                    if start:
                        ok = judged(lasts[start] << 32 | token)
                        if ok or ok is None and self.may_follow(lasts[start], token):
                            break
                    elif self.spine(token) is not None:
                        break
                    token = shorter[token]
                states.append(state)
                lasts.append(token)
                sizes.append(i - start)
            ids, at = [], end
            while at:
                ids.append(lasts[at])
                at -= sizes[at]
            out[word] = array("I", reversed(ids)).tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; none for NULL.

        Works on what stands between blanks, as no word crosses a blank: most of it is known from earlier slices.
        """
        cut = [self.between_blanks(t) if t else () for t in texts]
        runs = set().union(*cut)
        if len(self.known) > WORD_MEMO // 2:  # two generations: what is used again moves on to the younger
            self.known, self.older = {}, self.known
        older = self.older
        self.known |= {r: older[r] for r in runs if r not in self.known and r in older}
        first = self.first_newer
        new = {r: (self.words if max(r) < first else self.strict).findall(r) for r in runs if r not in self.known}
        # no run has a blank, so none is taken for a special token, which is sought before letters are made small
        special = {" " + s: array("I", [i]).tobytes() for s, i in self.special.items()}
        new |= {s: [s] for s in special if s in new}
        words = self.learn(list(set().union(*new.values()) - special.keys()))
        words |= special
        self.known |= {r: b"".join([words[w] for w in parts]) for r, parts in new.items()}
        get = self.known.__getitem__
        return [b"".join(map(get, runs)) for runs in cut]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings, a space between them: what the file's missing decoder leaves."""
        return b" ".join(map(self.token_list.__getitem__, array("I", ids)))


def load(path: str) -> WordBpe:
    """Read a tokenizer file on the driver; its tables go to the executors as one broadcast of a few megabytes."""
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


def _pass(spark: SparkSession, coder: WordBpe, docs: DataFrame, column: str, keep: list[str] | None, added: dict[str, str], make) -> DataFrame:
    held = share(spark, coder)
    kept = docs.select(*[c for c in keep or docs.columns if c not in added])
    schema = kept.withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema
    names = [*kept.columns, *added]
    types = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def run(batches):
        for batch in slices(batches, column, SLICE):
            columns = {n: batch.column(n) for n in batch.schema.names}
            made = make(held(), columns[column].to_pylist())
            for (name, kind), values in zip(added.items(), made, strict=True):
                columns[name] = pa.array(values, types[kind])
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.select(*dict.fromkeys([*kept.columns, column])).mapInArrow(run, schema)


def encode(docs: DataFrame, coder: WordBpe, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers in a binary) and ``n_tokens``.

    All rows stay and the columns in ``keep`` (all by default); columns named ``ids`` or ``n_tokens`` are replaced. NULL and empty texts
    have no tokens. Texts are never cut; a worker's memos are bounded and cost only time when they start anew. No shuffle.
    """
    def make(c: WordBpe, texts):
        ids = c.encode_all(texts)
        return ids, [len(i) // 4 for i in ids]

    return _pass(docs.sparkSession, coder, docs, column, keep, {"ids": "binary", "n_tokens": "bigint"}, make)


def decode(encoded: DataFrame, coder: WordBpe, column: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids; NULL for NULL ids, empty for none. Unknown ids raise."""
    def make(c: WordBpe, ids):
        return ([None if i is None else c.decode(i).decode() for i in ids],)

    return _pass(encoded.sparkSession, coder, encoded, column, keep, {"decoded": "string"}, make)


def round_trip(docs: DataFrame, coder: WordBpe, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded``: ``encode``, then ``decode``, in one pass and one worker a task."""
    def make(c: WordBpe, texts):
        ids = c.encode_all(texts)
        return ids, [len(i) // 4 for i in ids], [c.decode(i).decode() for i in ids]

    return _pass(docs.sparkSession, coder, docs, column, keep, {"ids": "binary", "n_tokens": "bigint", "decoded": "string"}, make)


def digests(docs: DataFrame, coder: WordBpe) -> DataFrame:
    """Token count and digests of ids and of the decoded text, per document."""
    done = round_trip(docs, coder, keep=["doc_id"])
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
