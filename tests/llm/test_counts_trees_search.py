"""Token counts, Merkle manifest and ranked search against plain versions of what they promise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_documents import DOCS, LONG, docs, odd

from pairloom.llm import merkle, ranked_search, token_counts
from pairloom.llm.queries import BYTE_TOKENIZER, tokenizer_path

SF = "/root/testdata/sf0.001"

# --- token counts ---


@pytest.fixture(scope="module")
def coder():
    return token_counts.load(tokenizer_path(BYTE_TOKENIZER))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER))
    t.no_padding()
    t.no_truncation()
    return t


def test_counts_agree_with_the_library(spark, coder, library):
    rnd = random.Random(1)
    letters = [*"abcdefghijklmnopqrstuvwxyzABC '.,!0123éèΣσςİß<|>\n\t\r\x1c\x85  　日本가힣é🙂²½_-", *(chr(c) for c in coder.newer[::700])]
    more = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "the", "  ", " \n", "ation", "ssss", "     "]
    texts = ["".join(rnd.choice(more) if rnd.random() < 0.2 else rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["x" * 5000, " " * 5000, "ab" * 3000 + " " + "é" * 700, "\n" * 300 + "x", " x", "x ", " ", LONG, "日本" * 2000]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [n for i in range(0, len(texts), 500) for n in coder.count_all(texts[i : i + 500])]
    assert got == want


def test_proved_strings_are_one_token(coder, library):
    assert len(coder.proved) > 40_000 and all(len(e.ids) == 1 for e in library.encode_batch([p for p in coder.proved if coder.cut(p) == [p]], add_special_tokens=False))


def test_the_heap_and_the_arrays_merge_alike(coder):
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b" abcdeinorst\xc3\xa9") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    assert coder.merged(words).tolist() == [len(coder.merged_long(w)) for w in words]


def test_memo_turnover_changes_nothing(coder, monkeypatch):
    texts = [f"word{i} thing{i % 7} {'x' * 80}{i}" for i in range(300)]
    want = coder.count_all(texts)
    monkeypatch.setattr(token_counts, "MEMO", 10)
    assert [coder.count_all([t])[0] for t in texts] == want


def test_counts_of_odd_tables(spark, coder, library):
    clashing = odd(spark).withColumn("n_tokens", F.lit("x")).withColumn("over_limit", F.lit(3))
    out = token_counts.count(clashing, coder)
    rows = out.collect()
    assert len(rows) == 10 and set(out.columns) == {*odd(spark).columns, "n_bytes", "n_tokens", "over_limit"}
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)
    assert token_counts.count(odd(spark).limit(0), coder, keep=["doc_id"]).count() == 0


# --- Merkle manifest ---


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_by_hand(row, small=False):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, row.text]
    if small and row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0 and row.text is not None:
        fields[4] = re.sub("[A-Z]", lambda m: m[0].lower(), row.text)
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree_by_hand(leaves, arity):
    """The root, and for each leaf the digests before and after at every step."""
    level, places, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(places):
            run = p // arity * arity
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + arity])))
            places[i] = p // arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def manifest_by_hand(rows, arity):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.lang is not None, (r.lang or "").encode())].append(r)
    names, trees = sorted(groups), {}
    for name in names:
        groups[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_by_hand(r)))
        trees[name] = tree_by_hand([leaf_by_hand(r) for r in groups[name]], arity)
    root, above = tree_by_hand([trees[n][0] for n in names], arity) if names else (None, [])
    out = []
    for name, over in zip(names, above, strict=True):
        for r, path in zip(groups[name], trees[name][1], strict=True):
            folded = leaf_by_hand(r, True)
            for before, after in path + over:
                folded = h(before, folded, after)
            proof = "".join(b + a for b, a in path + over)
            out.append((r.doc_id, leaf_by_hand(r), trees[name][0], root, h(proof), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [8, 2, 3])
def test_manifest_against_trees_by_hand(spark, arity):
    sizes = {None: 9, "": 1, "=": 2, "en": 173, "de": 64, "fr": 65, "es": 8, "ñ": 7, "zz": 1, "a": 3}
    rows = [(None, None, lang, "s", None) if i == 5 else (i * 7 % 1000 if i != 6 else 42, None if i == 4 else f"Text {i} ÀB", lang, None if i == 3 else "s:1", i) for lang, n in sizes.items() for i in range(n)]
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame([(a, b, c, d, e, 1) for a, b, c, d, e in rows], "doc_id long, text string, lang string, source string, n_chars long, g int")
    done = merkle.manifest(df, merkle.tampered_leaf(), arity=arity)
    got = done.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256), "folded_root", "verified")
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == manifest_by_hand(df.collect(), arity)
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_odd_tables(spark):
    got = sorted((tuple(r) for r in merkle.digests(odd(spark)).collect()), key=str)
    assert got == manifest_by_hand(odd(spark).collect(), 8)
    assert merkle.digests(odd(spark).limit(0)).count() == 0
    one = merkle.manifest(odd(spark).limit(1)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == "" and one.verified
    with pytest.raises(ValueError):
        merkle.manifest(odd(spark), arity=1)


# --- ranked search ---


def terms_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranks_by_hand(rows, items, k):
    counted = [(d, Counter(terms_by_hand(t))) for d, t in rows]
    total = sum(1 for _, c in counted if c)
    words = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in counted:
            m = 25 + (75 * sum(c.values()) * total) // words if words else 1
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_by_hand(text) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_words, bucket, seed", [(100_000, 1024, 20_000), (60, 16, 50), (1, 3, 1)])
def test_search_against_every_pair(spark, monkeypatch, pass_words, bucket, seed):
    for name, value in (("PASS_WORDS", pass_words), ("BUCKET", bucket), ("SEED_ROWS", seed), ("FOCUS", 2)):
        monkeypatch.setattr(ranked_search, name, value)
    rnd = random.Random(7)
    word = lambda: f"W{int(rnd.paretovariate(0.7)) % 400}" + rnd.choice(["", "", "é"])
    texts = [" ".join(word() for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    texts += texts[:60] + texts[:30] + [None, "", "--- !", "a-b_c's", " ".join(["w1"] * 500)]
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 8, 30])))) for i in range(25)]
    items += [(3, "w1 w1 w1 w2"), (3, "w1 w1 w1 w2"), (None, "w5, W7"), (40, None), (41, ""), (42, "nowhere"), (43, texts[0])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in ranked_search.search(docs(spark, texts), table, 4).collect()), key=str)
    assert got == ranks_by_hand(list(enumerate(texts)), items, 4)


def test_pruning_scores_few_vectors(spark):
    """The bounds must leave most vectors out, not only be right."""
    rnd = random.Random(9)
    rows = [" ".join(f"w{int(rnd.paretovariate(0.5)) % 5000}" for _ in range(60)) for _ in range(3000)]
    items = [(i, [w.encode() for w in dict.fromkeys(rows[i].split())], [1] * len(set(rows[i].split()))) for i in range(20)]
    queries = ranked_search.Queries(items)
    vectors = ranked_search.vectors(docs(spark, rows), queries)
    queries.weigh(3000, 3000 * 60, ranked_search.document_counts(vectors, len(queries.vocab)), 3, {})
    search = ranked_search.Search(queries)
    table = ranked_search.with_norms(vectors, queries).orderBy(F.desc("norm")).toArrow()
    for batch in table.combine_chunks().to_batches(max_chunksize=256):
        search.bucket(ranked_search.Bucket(batch, queries))
    assert search.scored < 0.2 * 20 * 3000


def test_search_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "one TWO"), (2, None), (None, "word and")], "item_id long, text string")
    got = sorted((tuple(r) for r in ranked_search.search(odd(spark), items.withColumn("score", F.lit(1)), 3).collect()), key=str)
    assert got == ranks_by_hand([(r.doc_id, r.text) for r in odd(spark).collect()], [(1, "one TWO"), (2, None), (None, "word and")], 3)
    assert ranked_search.search(odd(spark).limit(0), items).count() == 0
    assert ranked_search.search(odd(spark), items.limit(0)).count() == 0
    assert ranked_search.search(docs(spark, [None, ""]), items).count() == 0
