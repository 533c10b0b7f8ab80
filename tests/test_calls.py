"""Calls with lists of texts, and the memo inside a running stream."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.operators import generate as G
from pairloom.operators import store as S
from pairloom.streaming import scoring as SS
from pairloom.streaming.files import read_stream


def at(s):
    return F.timestamp_seconds(F.lit(s))


def refusing(bad, calls):
    def model(texts, *rest):
        calls.append(list(texts))
        if any(t in bad for t in texts):
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    return model


@pytest.mark.parametrize("bad", [[], [0], [99], [3, 4], [10, 40, 41, 77], list(range(100))])
def test_a_bad_text_fails_alone(bad):
    texts, calls = [f"t{i}" for i in range(100)], []
    out = G.call_list(refusing({f"t{i}" for i in bad}, calls), texts, (), max_retries=1, delay=0)
    for i, (result, attempts, error, _) in enumerate(out):
        assert (result, attempts, error) == ((None, 2, "RuntimeError: refused") if i in bad else (f"T{i}", 1, None))
    f = len(bad)
    assert len(calls) <= 1 + f * (2 * math.ceil(math.log2(100)) + 1)
    assert sum(calls.count([f"t{i}"]) for i in bad) == 2 * f


def test_lists_with_gaps_and_wrong_replies():
    out = G.call_list(lambda ts: [t * 2 for t in ts], ["a", None, "b"], (), 0, 0)
    assert [r[:3] for r in out] == [("aa", 1, None), (None, 0, None), ("bb", 1, None)]
    out = G.call_list(lambda ts: ts[:2], ["a", "b", "c", "d", "e"], (), 0, 0)  # right for two texts or one
    assert [r[0] for r in out] == list("abcde")
    out = G.call_list(lambda ts: [], ["a"], (), 2, 0)
    assert out[0][:3] == (None, 3, "ValueError: 0 replies to 1 texts")
    assert G.call_list(lambda ts: 1 / 0, [], (), 0, 0) == [] and G.call_list(lambda ts: 1 / 0, [None], (), 0, 0)[0][1] == 0


def test_a_passing_outage_costs_two_more_calls():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionError("down")
        return texts

    assert [r[0] for r in G.call_list(model, list("abcdef"), (), 3, 0)] == list("abcdef") and calls == [6, 3, 3]


def test_generate_with_lists(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else f"t{i}", "x", 9) for i in range(300)], "id int, text string, error string, attempts int")

    def model(texts):
        if "t17" in texts:
            raise ValueError("no")
        return [f"{len(texts)}" if t == "t20" else t for t in texts]

    out = G.generate(rows.coalesce(1), model, max_retries=1, retry_delay=0, batch=40)
    assert sorted(out.columns) == sorted(["id", "text", "result", "attempts", "error", "seconds", "status"])
    got = {r.id: r for r in out.collect()}
    assert (got[17].result, got[17].attempts, got[17].error, got[17].status) == (None, 2, "ValueError: no", "failed")
    assert (got[5].result, got[5].attempts, got[5].error) == (None, 0, None)
    assert all(got[i].result == f"t{i}" and got[i].error is None for i in range(300) if i not in (5, 17, 20))
    # the list of 40 was halved: 0-39, 0-19, 20-39
    assert got[20].result == "20"


def test_only_the_text_goes_through_python(spark):
    rows = spark.createDataFrame([(1, "a", bytes(10))], "id int, text string, payload binary")
    plan = G.generate(rows, lambda t: t)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan


def test_dispatch_with_lists_keeps_routes_apart(spark):
    rows = spark.createDataFrame([(i, "gemini" if i % 3 else "openrouter", None, f"t{i}") for i in range(60)] + [(90, "nobody", None, "x"), (91, None, None, "t0")], "id int, provider string, model string, text string")

    def first(texts, model):
        if "t3" in texts:
            raise ValueError("no")
        return [f"o/{t}" for t in texts]

    got = {r.id: r.result for r in G.dispatch(rows, {"openrouter": first, "gemini": lambda texts, model: [f"g/{t}" if t != "t4" else None for t in texts]}, batch=16).collect()}
    want = {i: f"{'g' if i % 3 else 'o'}/t{i}" for i in range(60)} | {3: "Error generating paraphrase.", 4: "Could not generate paraphrase.", 90: "Unknown provider.", 91: "o/t0"}
    assert got == want


def test_memoized_dispatch_isolates_and_spreads_hot_texts(spark, tmp_path):
    store = S.ResultsStore(spark, str(tmp_path / "memo"))
    rows = spark.createDataFrame([(i, "openrouter", None, None if i % 4 == 0 else "hot" if i % 4 == 1 else f"t{i}") for i in range(400)], "id int, provider string, model string, text string")
    calls = spark.sparkContext.accumulator(0)

    def model(texts, name):
        calls.add(1)
        if "t6" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    hot = spark.createDataFrame([(r.key,) for r in G.memoized_dispatch(rows.where("text = 'hot'").limit(1), {}, store, at(0)).collect()], "key string")
    done = {r.id: r for r in G.memoized_dispatch(rows, {"openrouter": model}, store, at(0), max_retries=1, retry_delay=0, hot=hot).collect()}
    assert len(done) == 400
    for i, r in done.items():
        want = (None, 0) if i % 4 == 0 else ("HOT", 1) if i % 4 == 1 else ("Error generating paraphrase.", 2) if i == 6 else (f"T{i}", 1)
        assert (r.result, r.attempts) == want and r.cached is False
    before = calls.value
    again = {r.id: r for r in G.memoized_dispatch(rows, {"openrouter": model}, store, at(1), max_retries=1, retry_delay=0).collect()}
    assert calls.value == before + 2 and all(r.cached == (i % 4 != 0 and i != 6) for i, r in again.items())


def test_store_versions_are_merged_and_old_ones_removed(spark, tmp_path):
    store = S.ResultsStore(spark, str(tmp_path / "s"), max_versions=3)
    for n in range(17):
        store.put(spark.createDataFrame([(f"k{n % 5}", str(n))], "key string, value string").withColumns({"created_at": at(n), "expires_at": F.lit(None).cast("timestamp")}))
    assert {r.key: r.value for r in store.read().collect()} == {"k0": "15", "k1": "16", "k2": "12", "k3": "13", "k4": "14"}
    generations = S.numbered(spark, str(tmp_path / "s"), "gen=")
    assert len(generations) <= S.ResultsStore.KEPT + 1 and generations[-1] >= 4


@pytest.fixture()
def intake(spark, tmp_path):
    parts = [["a", "b", "a", None], ["b", "c", " ", "d"], ["a", "d", "e", "e", "bad"], ["bad", "c"]]
    for part in parts:
        rows = [(f"{len(part)}{i}", t) for i, t in enumerate(part)]
        spark.createDataFrame(rows, "id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return parts, read_stream(spark, str(tmp_path / "in"), max_files=1)


def test_stream_asks_once_per_text_and_replays_nothing(spark, intake, tmp_path):
    parts, stream = intake
    calls = spark.sparkContext.accumulator(0)

    def model(text):
        calls.add(1)
        if text == "bad":
            raise ValueError("no")
        return f"reply to {text} number"

    store, path = S.ResultsStore(spark, str(tmp_path / "memo")), str(tmp_path / "out")
    options = {"now": lambda: at(0), "fn": model, "max_retries": 0, "retry_delay": 0}
    SS.start_rewrite_and_score(stream, store, path, **options).awaitTermination()
    # a b | c d | e bad | bad again, as a failure is not kept
    assert calls.value == 7

    def rows():
        return sorted(SS.scored_rows(stream, path).select("text", "result", "cached", "violation", "call_error", "word_overlap").collect(), key=str)

    first = rows()
    seen, want = set(), []
    for part in parts:
        for t in part:
            ok = t is not None and t.strip()
            want.append((t, f"reply to {t} number" if ok and t != "bad" else None, bool(ok and t in seen)))
        seen |= {t for t in part if t and t.strip() and t != "bad"}
    assert sorted([(r.text, r.result, r.cached) for r in first], key=str) == sorted(want, key=str)
    assert {r.text for r in first if r.violation} == {None, " "} and {r.text for r in first if r.call_error} == {"bad"}

    # The last micro-batch runs again: its commit is lost, as after a crash between writing and committing.
    (tmp_path / "out" / "checkpoint" / "commits" / "3").unlink()
    (tmp_path / "out" / "checkpoint" / "commits" / ".3.crc").unlink(missing_ok=True)
    SS.start_rewrite_and_score(stream, store, path, **options).awaitTermination()
    assert calls.value == 7 and rows() == first
    # More files: everything made before is known.
    spark.createDataFrame([("x", "a"), ("y", "e"), ("z", "f")], "id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    SS.start_rewrite_and_score(stream, store, path, **options).awaitTermination()
    assert calls.value == 8 and len(rows()) == len(first) + 3
    assert len(S.numbered(spark, f"{path}/answers", "epoch=")) == 1


def test_stream_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, text string")
    empty.write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"))
    assert SS.scored_rows(stream, str(tmp_path / "out")).count() == 0


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    from pairloom import session

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(50, None)], "id int, text string")
    assert session.text_parts(df, "text") == n and session.text_parts(df.limit(0), "text") == n
    monkeypatch.setattr(session, "PART_BYTES", 100)
    assert session.text_parts(df, "text") == max(n, 51)
    done = G.retry_pass(df, lambda t: t, "id", max_retries=0)
    assert done.count() == 51 and done.rdd.getNumPartitions() >= min(51, max(n, 51))


def test_replies_are_handed_on_by_size_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "SLICE_CHARS", 10)
    texts = ["abcd", None, "x" * 30, "", "ab", "c" * 9, "d"]
    assert [len(x) for x in G.some_at_once(iter([pd.Series(texts), pd.Series([], dtype=object)]), 1)] == [3, 3, 1]
    assert [len(x) for x in G.some_at_once(iter([pd.Series(texts)]), 2)] == [4, 2, 1]
    df = spark.createDataFrame([*enumerate(texts)], "id int, text string").coalesce(1)
    for batch in (None, 2):
        fn = (lambda t: t.upper()) if batch is None else (lambda some: [t.upper() for t in some])
        got = {r.id: r.result for r in G.generate(df, fn, batch=batch).collect()}
        assert got == {i: None if t is None else t.upper() for i, t in enumerate(texts)}


def test_streamed_documents_come_in_many_files(spark, tmp_path, monkeypatch):
    from pairloom import session
    from pairloom.plans import admissions, texts
    from pairloom.plans.catalog import QUERIES

    sf = str(tmp_path / "sf")
    rows = [(i, f"text {i} " * 20, "en", "web", 7) for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{sf}/documents.parquet")
    folder, parts = admissions.intake(spark, sf)
    parts[0]()
    assert len(spark.read.parquet(folder).inputFiles()) > 1 and len(parts) == 4
    seen, read = [], texts.read_stream
    monkeypatch.setattr(session, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(texts, "read_stream", lambda spark, path, max_files: seen.append(max_files) or read(spark, path, max_files))
    assert QUERIES["k4_stream_sink"](spark, sf).count() == 200
    assert seen[0] > 1
