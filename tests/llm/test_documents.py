"""Operators over documents against plain versions of what they promise."""

import hashlib
import random
import re
from array import array
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm import bpe, decontaminate, jaccard, language, passages, shards
from pairloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, ids string, k1 int, `count` int"
LONG = "word and word2, " * 20_000


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "x", 1, 2) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """NULL ids and texts, empty and very long texts, repeated rows and ids, columns named like the operators' own."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (5, "one two three"), (5, "one two three"), (None, "one two three"), (None, None), (6, "Été ΑΣ İ 日本 🙂 <|endoftext|>")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 1, 2) for i, t in rows], DOCS)


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- decontamination ---


def windows_by_hand(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        m = min(10, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    names = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_words", [100_000, 40])
def test_decontamination_against_every_window(spark, monkeypatch, pass_words):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", pass_words)
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "b", "Of", "thé", "x1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 25, 25])]
    items += [(3, "q w e"), (3, "q w e"), (20, None), (21, "--")]
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    texts += [f"x {items[7][1].upper()} y", f"{items[5][1]}, {items[6][1]}!", "q w e", None, "", "..."]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.contamination(docs(spark, texts), table)).collect()}
    assert got == {i: windows_by_hand(t, items) for i, t in enumerate(texts)}


def test_decontamination_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two"), (None, "three")], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.digest(decontaminate.contamination(odd(spark), none)).collect()} == {0}
    found = decontaminate.contamination(odd(spark), some)
    assert found.count() == 10 and found.where("size(spans) > 0").count() == 3
    assert {tuple(r.item_ids) for r in found.where("size(spans) > 0").collect()} == {(1,)}
    assert decontaminate.clean(odd(spark), some).columns == odd(spark).columns
    assert decontaminate.clean(odd(spark).limit(0), some).count() == 0


# --- BPE ---


@pytest.fixture(scope="module")
def coder():
    return bpe.load(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_agrees_with_the_library(spark, coder, library):
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC '.,!0123éèΣσςİß<|>\n\t\x1c\u0085 ​日本가힣é🙂"
    texts = ["".join(rnd.choice(["<|endoftext|>", "'s", "the", "ation", "ssss"]) if rnd.random() < 0.2 else rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["x" * 5000, LONG, "Ᲊ Ᲊ"]
    want = library.encode_batch(texts, add_special_tokens=False)
    for i in range(0, len(texts), 500):
        for ids, e in zip(coder.encode_all(texts[i : i + 500]), want[i : i + 500], strict=True):
            assert array("I", ids).tolist() == e.ids
            assert coder.decode(ids).decode() == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_markers_in_capitals_are_text(coder, library):
    for text in ("<|ENDOFTEXT|>", "a <|EndOfText|> b<|endoftext|>", "<|endoftext|><|ENDOFTEXT|>", "<|STARTOFTEXT|> <|startoftext|>"):
        assert array("I", coder.encode_all([text])[0]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_memo_turnover_changes_nothing(coder, monkeypatch):
    texts = [f"word{i} thing{i % 7}" for i in range(300)]
    want = coder.encode_all(texts)
    monkeypatch.setattr(bpe, "WORD_MEMO", 10)
    monkeypatch.setattr(bpe, "PAIR_MEMO", 3)
    assert [coder.encode_all([t])[0] for t in texts] == want


def test_bpe_of_odd_tables(spark, coder, library):
    out = bpe.decode(bpe.encode(odd(spark), coder), coder)
    at_once = bpe.round_trip(odd(spark), coder).select(out.columns)
    assert at_once.exceptAll(out).count() == 0 and at_once.count() == out.count()
    assert out.count() == 10 and set(out.columns) == {*odd(spark).columns, "n_tokens", "decoded"}
    for r in out.collect():
        assert array("I", r.ids).tolist() == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) // 4
    assert bpe.digests(odd(spark).limit(0), coder).count() == 0


# --- n-gram Jaccard join ---


def jaccard_by_hand(rows, k=4, percent=85):
    sets = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    classes = union_find([i for i, _ in sets], links)
    return sorted((i, len(s), classes[i]) for i, s in sets)


@pytest.mark.parametrize("block", [400_000, 60])
def test_jaccard_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randint(0, 30)) for _ in range(n)] for n in (3, 5, 40, 60, 80, 200)]
    rows = []
    for words in base:
        for _ in range(12):
            w = list(words)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 2)] = ["new" + str(rnd.randint(0, 9))]
            rows.append(" ".join(w))
    rows += ["the same line for all of us " + r for r in rows[:10]] + [None, "", "  ", "a", "A", "a b", rows[3], rows[3].upper()]
    rnd.shuffle(rows)
    numbered = list(enumerate(rows))
    got = sorted(tuple(r) for r in jaccard.similar(docs(spark, rows)).collect())
    assert got == jaccard_by_hand(numbered)


def test_jaccard_threshold_is_exact(spark):
    # 20 shingles, 17 shared of 20 and 23: exactly at and just below
    a = [f"w{i}" for i in range(23)]
    assert jaccard.trie_links(*[[jaccard.np.arange(20, dtype="u8"), jaccard.np.arange(17, dtype="u8")], None], 85) == [(1, 0)]
    assert jaccard.trie_links([jaccard.np.arange(20, dtype="u8"), jaccard.np.arange(16, dtype="u8")], None, 85) == []
    assert len({r.component_id for r in jaccard.similar(docs(spark, [" ".join(a), " ".join(a[:20])])).collect()}) == 1
    assert len({r.component_id for r in jaccard.similar(docs(spark, [" ".join(a), " ".join(a[:19])])).collect()}) == 2


def test_jaccard_of_odd_tables(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar(odd(spark)).collect())
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 3, "4"), ("4", 3, "4"), ("5", 1, "5"), ("5", 1, "5"), ("None", 1, "5"), ("None", 0, "None"), ("6", 3, "6")])
    assert jaccard.similar(odd(spark).limit(0)).count() == 0
    kept = jaccard.first_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None", "None"]


def test_jaccard_what_is_read_again_grows_with_the_groups_alone(spark, monkeypatch):
    """However many groups there are, no bounded marks let other first shingles pass, and those of whole sets grow with their number."""
    monkeypatch.setattr(jaccard, "MARKS", 64)
    plans, sizes, write, count = {}, [], jaccard.materialise, jaccard.dense_counts
    monkeypatch.setattr(jaccard, "materialise", lambda df, label: (plans.update({label: df._jdf.queryExecution().toString()}), write(df, label))[1])
    monkeypatch.setattr(jaccard, "dense_counts", lambda df, buckets, size: (sizes.append(size), count(df, buckets, size))[1])
    texts = [" ".join(f"w{n // 3}x{i}" for i in range(60)) + f" end{n}" for n in range(150)]
    got = jaccard.similar(docs(spark, [*texts, *(" ".join(f"u{n}x{i}" for i in range(60)) for n in range(150))])).collect()
    assert all(r.component_id == (r.doc_id // 3 * 3 if r.doc_id < 150 else r.doc_id) for r in got)
    assert "MapInArrow" not in plans["held"] and sizes and all(s >= 8 * 150 for s in sizes)


def test_jaccard_first_shingles_move_once(spark, monkeypatch):
    """Groups are marked where the first shingles lie, and pairs of unlike size are left out before they move; what is moved stays on disk."""
    plans, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), write(df, label))[1])
    texts = [" ".join(f"w{n // 3}x{i}" for i in range(60)) + f" end{n}" for n in range(60)] + [" ".join(f"w0x{i}" for i in range(9))] * 2
    got = {r.doc_id: r.component_id for r in jaccard.similar(docs(spark, texts)).collect()}
    assert got == {n: n // 3 * 3 for n in range(60)} | {60: 60, 61: 60}
    assert plans["held"].count("Exchange ") == 1 and "Join" not in plans["held"]
    assert "Join" not in plans["close"] and "100" in plans["close"].split("Exchange ")[1]


def test_jaccard_plans_are_small(spark, monkeypatch, capsys):
    """What several steps read is written once: a plan that holds it over and over has all its exchanges at once, in the driver's memory."""
    from pairloom.llm import components

    plans, write = {}, jaccard.materialise

    def written(df, label):
        capsys.readouterr()
        df.explain()
        plans[label] = max(plans.get(label, 0), capsys.readouterr().out.count("Exchange "))
        return write(df, label)

    monkeypatch.setattr(jaccard, "materialise", written)
    monkeypatch.setattr(components, "materialise", written)
    texts = [" ".join(f"w{n // 3}x{i}" for i in range(60)) + f" end{n}" for n in range(60)]
    assert sorted(r.doc_id for r in jaccard.first_of_each(docs(spark, texts)).collect()) == list(range(0, 60, 3))
    assert max(plans.values()) <= 12, plans


# --- language ---


def test_every_language_is_learned_and_copies_crowd_none_out(spark, monkeypatch):
    words = "ab cd ef gh ij kl mn op qr st uv wx".split()
    rows = [(f"l{n:03d}", " ".join(words[(n * 7 + i * (n % 5 + 1)) % 12] + str(n) for i in range(12)) + f" nr {c}") for n in range(150) for c in range(3)]
    rows += [("copies", "the same line of text over and over")] * 3000 + [("copies", f"word{i} and more words {i}") for i in range(60)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    found = language.sample(labelled)
    assert len(found) == 151 and len(found["copies"]) == 61 and all(len(found[f"l{n:03d}"]) == 3 for n in range(150))
    monkeypatch.setattr(language, "ALL_TEXTS", 302)
    assert {len(t) for t in language.sample(labelled).values()} == {2}
    monkeypatch.setattr(language, "ALL_TEXTS", 100)
    with pytest.raises(ValueError, match="languages"):
        language.sample(labelled)


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", language.held_out("doc_id").alias("held_out"))
    model = language.learn(d.where(~F.col("held_out")))
    got = language.identify(d.drop("lang"), model).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert sum(not r.rejected for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    # neither other columns nor the rows' order matter
    again = language.learn(d.where(~F.col("held_out")).repartition(5))
    assert again.raw == model.raw


def test_language_of_odd_tables(spark):
    model = language.learn(docs(spark, ["the man and the thing of that", None, ""]).union(docs(spark, ["der Mann und die Sache", "12 %"], "de")).union(docs(spark, ["x"], None)))
    assert set(model.raw) == {"en", "de"}
    got = {r.text: r for r in language.identify(odd(spark), model).collect()}
    assert all(got[t].lang_pred == "und" and got[t].rejected and got[t].score == 0 for t in (None, "", " \n\t "))
    assert got["one two three"].lang_pred in ("en", "de")
    assert language.identify(odd(spark).limit(0), model).count() == 0
    nothing = language.learn(odd(spark).limit(0))
    assert {r.lang_pred for r in language.identify(odd(spark), nothing).collect()} == {"und"}
    h = {r.doc_id: r.h for r in odd(spark).select("doc_id", language.held_out("doc_id").alias("h")).collect()}
    import zlib

    assert all(h[i] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i in h)


# --- passages ---


def test_passages_exact_and_fuzzy(spark):
    rnd = random.Random(8)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared, short, fuzzy = new(60), new(40), new(120)
    edited = [w if i % 17 else "changed" + str(i) for i, w in enumerate(fuzzy)]
    edited[50:51] = []
    texts = [new(80) + shared + new(30), shared + new(100), new(300) + shared, new(50) + fuzzy + new(50), edited + new(70), new(90) + short + new(9), short + new(60), new(200), shared[:35] + new(50), [], new(3)]
    found = passages.repeated(docs(spark, [" ".join(t) for t in texts])).collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3, 4}
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.start_word, r.end_word))
    assert all((80, 140) == s for s in by_doc[0]) and all((0, 60) == s for s in by_doc[1]) and all((300, 360) == s for s in by_doc[2])
    (s, e), = by_doc[3]
    assert s <= 54 and e >= 160


def test_passages_of_every_fifty_equal_words_are_found(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    first, shared = {}, set()
    for r in d.collect():
        w = decontaminate.words(r.text)
        for k in range(len(w) - 49):
            if len(set(w[k : k + 50])) > 5:
                other = first.setdefault(tuple(w[k : k + 50]), r.doc_id)
                if other != r.doc_id:
                    shared |= {other, r.doc_id}
    assert shared <= {r.doc_id for r in passages.repeated(d).collect()}


def test_passages_whose_halves_stand_in_lower_and_higher_documents(spark):
    rnd = random.Random(4)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = [new(20) for _ in range(400)]
    passages_of = []
    for n in range(20):
        shared = new(50 + n % 12)
        b, c = rnd.sample(range(100, 300), 2)
        passages_of.append((shared, b, c))
        for i in (b, c):
            texts[i] += shared + new(rnd.randrange(20))
        for low, high, part in ((n, 399 - n, shared[:33]), (40 + n, 359 - n, shared[-33:]), (80 + n, 319 - n, shared[10:42])):
            texts[low] += part + new(9)
            texts[high] += new(5) + part
        # a stray copy of a part in the documents themselves
        texts[b] = shared[20:40] + texts[b]
        texts[c] += shared[15:35]
    found = passages.repeated(docs(spark, [" ".join(t) for t in texts])).collect()
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append((r.start_word, r.end_word))
        assert 50 <= r.end_word - r.start_word == r.n_words
    for shared, *ids in passages_of:
        for i in ids:
            at = next(k for k in range(len(texts[i])) if texts[i][k : k + len(shared)] == shared)
            assert any(s <= at and at + len(shared) <= e for s, e in spans[i])
    assert set(spans) == {i for _, *ids in passages_of for i in ids}


@pytest.mark.parametrize("first", [0, -(2**63)])
def test_passages_with_changes_between_documents_that_are_not_the_first_or_last(spark, first):
    """Every stretch that both documents have stands in a lower and in a higher document as well, each in others."""
    rnd = random.Random(12)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts, both = [new(20) for _ in range(100)], []
    for n in range(10):
        passage = new(156)
        both.append({40 + 2 * n, 41 + 2 * n})
        for i in both[-1]:
            texts[i] += [f"change{i}x{k}" if k % 12 == 11 else w for k, w in enumerate(passage)] + new(20)
        for k in range(13):
            for i in ((n * 13 + k) % 40, 60 + (n * 13 + k) % 40):
                texts[i] += passage[12 * k : 12 * k + 11] + new(40)
    rows = [(i if i else first, " ".join(t)) for i, t in enumerate(texts)]
    found = passages.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(i, j) for ids in both for i in ids for j in ids - {i}}
    assert all(r.n_words >= 130 and r.identity >= 0.9 for r in found)


def test_passages_with_changes_whose_seeds_are_all_frequent(spark):
    """Every stretch that both documents have stands in six lower and six higher documents as well, each in others; one passage is a line over and over."""
    rnd = random.Random(13)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts, both = [new(20) for _ in range(200)], []
    for n in range(8):
        passage = new(156) if n else ["again"] * 156
        both.append({80 + 2 * n, 81 + 2 * n})
        for i in both[-1]:
            texts[i] += [f"change{i}x{k}" if k % 12 == 11 else w for k, w in enumerate(passage)] + new(20)
        for k in range(13):
            for m in range(6):
                for i in ((n * 13 + 7 * k + 11 * m) % 80, 120 + (n * 13 + 7 * k + 11 * m) % 80):
                    texts[i] += new(40) + passage[12 * k : 12 * k + 11] + new(40)
    found = passages.repeated(docs(spark, [" ".join(t) for t in texts])).collect()
    longest = {(r.doc_id, r.other_id): r.n_words for r in sorted(found, key=lambda r: r.n_words) if r.identity >= 0.9}
    assert {(r.doc_id, r.other_id) for r in found} == longest.keys() == {(i, j) for ids in both for i in ids for j in ids - {i}}
    assert min(longest.values()) >= 130


def test_pairs_of_seeds_lie_beyond_what_is_found():
    batch = passages.pa.RecordBatch.from_pylist(
        [{"doc": 1, "at": [30, 0, 13, 100], "seed": [5, 3, 4, 6], "often": [True, False, True, True], "first": [10], "last": [35]}, {"doc": 2, "at": [0, 13, 26], "seed": [7, 7, 8], "often": [False] * 3, "first": None, "last": None},
         {"doc": 3, "at": [0, 6, 12, 18], "seed": [9] * 4, "often": [True] * 4, "first": None, "last": None}]
    )
    found = [r for b in passages._open_rows(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc"], r["x"], r["x2"], r["alike"]) for r in found] == [(1, 0, 13, False), (1, 0, 30, False), (3, 0, 18, True)]
    # a seed over and over is one: its last place and the first of what follows
    rows = [{"doc": 1, "at": [0, 6, 12, 18, 20, 26, 32], "seed": [9] * 4 + [8] * 3, "often": [True] * 7}]
    row, pair, x, x2, alike = passages._seed_pairs(passages.pa.RecordBatch.from_pylist(rows), passages.NEAR, passages.FAR)
    assert list(zip(x.tolist(), x2.tolist(), alike.tolist(), strict=True)) == [(0, 18, True), (18, 20, False)]
    rows = [{"doc": 1, "pairs": [{"pair": 1, "x": 0, "x2": 20}, {"pair": 2, "x": 20, "x2": 40}], "text": "a b c " * 10 + "x " + "a b c " * 10}]
    assert [r["pair"] for b in passages._changed_rows(iter([passages.pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()] == [2]


@pytest.mark.parametrize("period", [1, 2, 3, 5, 7, 11, 12, 13])
def test_seeds_of_a_repeated_line_leave_no_window_without(period):
    text = [b"a%d" % i for i in range(40)] + [b"w%d" % (i % period) for i in range(200)] + [b"b%d" % i for i in range(40)]
    at, _ = passages.seeds(text, passages.WordHashes())
    assert at[0] < passages.WINDOW and max(b - a for a, b in zip(at, at[1:], strict=False)) <= passages.WINDOW and at[-1] >= len(text) - passages.K + 1 - passages.WINDOW


def test_passages_of_repeated_lines(spark):
    texts, spans = [], []
    for period in range(1, 15):
        line = [f"p{period}w{i}" for i in range(period)]
        for doc, n in (("a", 55), ("b", 70)):
            shared = [line[i % period] for i in range(n)]
            texts.append(" ".join([f"{doc}{period}x{i}" for i in range(30)] + shared + [f"{doc}{period}y{i}" for i in range(30)]))
            spans.append(n)
    short = " ".join(["again"] * 49)
    found = {r.doc_id: (r.start_word, r.end_word) for r in passages.repeated(docs(spark, [*texts, "s " + short, "t " + short])).collect()}
    assert set(found) == set(range(28))
    assert all(30 <= s and s + 50 <= e <= 30 + n for n, (s, e) in zip(spans, [found[i] for i in range(28)], strict=True))


def test_seeds_of_many_texts_at_once_are_those_of_each():
    rng = random.Random(8)
    texts = [[b"w%d" % rng.randrange(k) for _ in range(n)] for n in (0, 3, 4, 5, 15, 16, 17, 40, 300) for k in (1, 2, 9, 10**6)]
    rng.shuffle(texts)
    memo, begins, counts, rows = passages.WordHashes(), [], [], []
    every = passages.shingles(passages.hashed([w for t in texts for w in t], memo), passages.K)
    for i, text in enumerate(texts):
        begins.append(sum(map(len, texts[:i])))
        counts.append(max(0, len(text) - passages.K + 1))
        at, h = passages.seeds(text, memo)
        plain = passages.chosen(passages.shingles(passages.hashed(text, memo), passages.K)).tolist() if len(text) >= passages.K else []
        assert set(at.tolist()) <= set(plain) and (not plain or (at[0], at[-1]) == (plain[0], plain[-1]))
        rows += [(begins[i] + p, i, v) for p, v in zip(at.tolist(), h.tolist(), strict=True)]
    at, text = passages.thinned_in(every, passages.np.array(begins), passages.np.array(counts))
    assert list(zip(at.tolist(), text.tolist(), every[at].tolist(), strict=True)) == rows


def test_passages_words_of_the_other_document_are_made_once(monkeypatch):
    """Pairs come sorted by the other document: its words are not made anew for each pair."""
    asked, make = [], passages.words
    monkeypatch.setattr(passages, "words", lambda t: (asked.append(t), make(t))[1])
    other = " ".join(f"w{i}" for i in range(60))
    rows = [(n, 9, [[0, 60, 0, 60]], f"{other} end{n}", other) for n in range(5)]
    batch = passages.pa.RecordBatch.from_pylist([dict(zip(("doc", "other", "chains", "text", "other_text"), r, strict=True)) for r in rows])
    found = [r for b in passages._passage_rows(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in found] == [(n, 0, 60) for n in range(5)] and asked.count(other) == 1


def test_passages_of_odd_tables(spark):
    assert passages.repeated(odd(spark)).count() == 0
    assert passages.repeated(odd(spark).limit(0)).count() == 0


def test_chain_prefers_order_over_number():
    x, y = [0, 20, 40, 60, 80, 100], [300, 500, 320, 340, 0, 360]
    assert passages.chains(x, y)[0] != [] and passages.chains([], []) == []
    x = list(range(0, 100, 5))
    assert passages.chains(x, [v + 7 for v in x]) == [(0, 100, 7, 107)]


def test_equal_words_are_walked_in_lists_not_one_by_one():
    class Text(list):
        asked = 0

        def __getitem__(self, at):
            Text.asked += 1
            return Text(super().__getitem__(at)) if isinstance(at, slice) else super().__getitem__(at)

    text = [b"%d" % i for i in range(5_000)]
    other = text[:3_000] + [b"x", b"y"] + text[3_001:]
    assert passages.walk(Text(text), Text(other)) == (5_000, 5_001, 4_999, 5_001) and Text.asked < 200
    assert passages.agreement(text, other, 2_990, 2_990) == 10 and passages.agreement(text, text[:7], 0, 0) == 7 == passages.agreement(text[:7], text, 0, 0)


def test_stretches_inside_others_are_found_in_order():
    rng = random.Random(8)
    kept, plain = passages.Covered(), []
    for _ in range(400):
        a = rng.randrange(300)
        b = a + rng.randrange(1, 40)
        assert kept.holds(a, b) == any(s <= a and b <= e for s, e in plain)
        if rng.random() < 0.3:
            kept.add(a, b)
            plain.append((a, b))


def test_word_hashes_remember_no_words():
    import xxhash

    hashes = passages.WordHashes()
    words = [b"%d" % i for i in range(20_000)]
    before = len(vars(hashes))
    assert passages.hashed(words, hashes).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words] and not passages.hashed([], hashes).size
    assert len(vars(hashes)) == before and not isinstance(hashes, dict)


# --- shards ---


def test_shard_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = shards.fill(names, 1009)
    assert sorted({table.count(i) for i in range(10)}) in ([100, 101], [101])
    fewer = shards.fill(names[:9], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    # each shard in turn takes its first free slot
    assert shards.fill(["a"], 7) == [0] * 7
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            shards.fill(*bad)


def test_shards_of_odd_tables(spark):
    got = shards.place(odd(spark), "doc_id", ["a", "b", "c"], 101)
    assert got.count() == 10 and got.columns[:-3] == odd(spark).columns
    held = shards.fill(["a", "b", "c"], 101)
    assert all(r.shard == held[r.slot] and r.shard_name == "abc"[r.shard] for r in got.collect())
    assert all(len({r.slot for r in got.collect() if r.doc_id == i}) == 1 for i in (4, 5))
    assert shards.place(odd(spark).limit(0), "doc_id", ["a"], 2).count() == 0
