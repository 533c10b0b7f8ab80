import pytest
from pyspark.sql import functions as F

from pairloom.operators import generate as G
from pairloom.operators import lookup as L
from pairloom.operators import pairing
from pairloom.operators import store as S
from pairloom.operators import summaries
from pairloom.operators import tokens as K
from pairloom.sources import readers, writers
from pairloom.streaming import admission as SA
from pairloom.streaming.files import read_stream, run_to_table
from pairloom.operators.bucket import token_bucket_admit
from pairloom.operators.admission import replay_cache
from pairloom.operators.carried import sliding_window_admit


def at(seconds):
    return F.timestamp_seconds(F.lit(seconds).cast("double"))


def test_store_life(spark, tmp_path):
    values = spark.createDataFrame([("k1", "a")], "key string, value string")
    store = S.store_upsert(
        S.new_entries(values, at(0), 10), S.new_entries(values.withColumn("key", F.lit("k2")), at(0), None)
    )
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")

    def hits(now):
        return {r.key for r in S.cache_lookup(keys, store, at(now)).where("hit").collect()}

    assert hits(10) == {"k1", "k2"} and hits(10.001) == {"k2"} and hits(1e9) == {"k2"}
    assert {r.key for r in S.cache_misses(keys, store, at(11)).collect()} == {"k1", "k3"}
    assert {r.key for r in S.cache_exists(keys, store, at(10)).collect()} == {"k1", "k2"}


def test_stored_versions(spark, tmp_path):
    kept = S.ResultsStore(spark, str(tmp_path / "store"))
    assert kept.read().count() == 0
    put = lambda rows, now: kept.put(S.new_entries(spark.createDataFrame(rows, "key string, value string"), at(now), 10))
    put([("a", "1"), ("b", "1")], 0)
    put([("a", "2")], 0)
    assert {r.key: r.value for r in kept.read().collect()} == {"a": "2", "b": "1"}
    kept.delete(spark.createDataFrame([("b",)], "key string"))
    put([("c", "3")], 100)
    assert {r.key: r.value for r in kept.read().collect()} == {"a": "2", "c": "3"}
    kept.purge(at(50))
    assert {r.key for r in kept.read().collect()} == {"c"}
    kept.clear()
    assert kept.read().count() == 0


def test_compaction_drops_the_oldest_quarter(spark):
    rows = spark.range(100).select(
        F.format_string("k%03d", "id").alias("key"), F.lit("v").alias("value"), F.timestamp_seconds("id").alias("created_at"),
        F.when(F.col("id") >= 90, F.timestamp_seconds(F.lit(500))).alias("expires_at"),
    )
    assert S.store_compact(rows, at(1000), 101).count() == 100
    assert S.store_compact(rows, at(1000), 95).count() == 90
    left = S.store_compact(rows, at(1000), 80)
    assert left.count() == 68 and left.agg(F.min("key")).first()[0] == "k022"


def test_hot_lookup_is_the_plain_join(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    table = rows.select("key").distinct().where("key <> '7'").withColumn("v", F.length("key"))
    hot = L.hot_keys(rows, "key", sample=0.5)
    assert [r.key for r in hot.collect()] == ["hot"]
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = (L.lookup(rows, table, "key", how, h) for h in (None, hot))
        columns = sorted(a.columns)
        assert sorted(a.select(columns).collect()) == sorted(b.select(columns).collect()), how


def test_generation_retries_and_isolates(spark, tmp_path):
    def flaky(text):
        seen = tmp_path / text
        seen.write_text(seen.read_text() + "x" if seen.exists() else "x")
        if text == "never" or len(seen.read_text()) < 3 and text == "third":
            raise RuntimeError("down")
        return text.upper()

    df = spark.createDataFrame([("now",), ("third",), ("never",)], "text string").coalesce(1)
    got = {r.text: (r.result, r.attempts, r.status) for r in G.generate(df, flaky, retry_delay=0).collect()}
    assert got == {"now": ("NOW", 1, "ok"), "third": ("THIRD", 3, "ok"), "never": (None, 4, "failed")}


def test_memo_generates_each_text_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(text):
        (calls / __import__("uuid").uuid4().hex).write_text(text)
        return text[::-1]

    kept = S.ResultsStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "cd", "ab", "ab"])], "id int, text string")
    first = G.memoized_transform(df, kept, at(0), model).orderBy("id").collect()
    assert [r.result for r in first] == ["ba", "dc", "ba", "ba"] and not any(r.cached for r in first)
    assert len(list(calls.iterdir())) == 2
    more = df.unionByName(spark.createDataFrame([(9, "ef")], "id int, text string"))
    again = G.memoized_transform(more, kept, at(3600), model, hot=L.hot_keys(df.withColumn("key", F.lit("x")), "key")).orderBy("id").collect()
    assert [r.cached for r in again] == [True] * 4 + [False] and len(list(calls.iterdir())) == 3
    G.memoized_transform(df, kept, at(3601), model).count()
    assert len(list(calls.iterdir())) == 5  # expired
    G.memoized_transform(df, kept, at(3602), model, skip_cache=True).count()
    assert len(list(calls.iterdir())) == 9


def test_strict_pairing_fails_on_a_gap(spark):
    o = spark.createDataFrame([("b", 0, "x"), ("b", 1, "y")], "batch_id string, pos bigint, text string")
    assert pairing.pair_by_position(o, o.where("pos = 0"), strict=False).count() == 1
    with pytest.raises(Exception, match="same length"):
        pairing.pair_by_position(o, o.where("pos = 0")).collect()
    lists = spark.createDataFrame([("b", ["x", "y"], ["p", "q"])], "batch_id string, o array<string>, p array<string>")
    assert [(r.pos, r.original, r.paraphrase) for r in pairing.zip_lists(lists, "o", "p").collect()] == [(0, "x", "p"), (1, "y", "q")]
    dense = o.select("batch_id", "pos")
    assert pairing.chunk(dense, 1).orderBy("pos").collect() == pairing.chunk(dense, 1, dense=True).orderBy("pos").collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('The cat.\tA cat.\nNA\t"say ""hi"""\nlast\tone', encoding="utf-8")
    got = [tuple(r) for r in readers.read_pairs_tsv(spark, str(tmp_path / "a.tsv")).collect()]
    assert got == [("The cat.", "A cat."), ("NA", 'say "hi"'), ("last", "one")]
    sizes = summaries.split_sizes(readers.read_splits(spark, str(tmp_path / "a.tsv"), str(tmp_path / "a.tsv")))
    assert {r.split: r.n_rows for r in sizes.collect()} == {"train": 3, "eval": 3}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_splits(spark, str(tmp_path / "a.tsv"), str(tmp_path / "none.tsv"))
    (tmp_path / "lines.txt").write_text(" one \n\n \t\ntwo\n", encoding="utf-8")
    assert {r.text for r in readers.read_text_lines(spark, str(tmp_path / "lines.txt")).collect()} == {"one", "two"}
    assert readers.texts_from_list(spark, ["a", "b"]).count() == 2 and readers.texts_from_list(spark, "a").count() == 1
    df = spark.createDataFrame([(1, "b", None), (0, "a", "x"), (2, "c", "")], "pos bigint, text string, result string")
    writers.write_report_text(df, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    rule = "-" * 40
    assert text == "".join(f"Original: {o}\nParaphrase: {r}\n{rule}\n" for o, r in (("a", "x"), ("b", "FAILED"), ("c", "FAILED")))


def test_jobs_of_any_size_keep_all_results(spark):
    items = spark.range(30).select(F.when(F.col("id") < 10, "small").otherwise("big").alias("job_id"), F.col("id").alias("pos"),
                                   F.when(F.col("id") != 3, F.col("id").cast("string")).alias("result"))
    jobs = spark.createDataFrame([("small", "completed"), ("big", "completed")], "job_id string, status string").withColumns(
        {"created_at": at(0), "completed_at": at(5)})
    errors = spark.createDataFrame([("big", "too many", 1)], "job_id string, error string, at int")
    many = spark.range(5000).select(F.lit("huge").alias("job_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("result"))
    jobs = jobs.withColumn("metadata", F.lit("m")).union(spark.createDataFrame([("huge", "completed"), ("none", "processing")], "job_id string, status string").withColumns(
        {"created_at": at(0), "completed_at": F.lit(None).cast("timestamp"), "metadata": F.lit("n")}))
    errors = errors.union(many.select("job_id", F.col("result").alias("error"), F.col("pos").cast("int")))
    got = {r.job_id: r for r in summaries.job_status(jobs, items.union(many), errors).collect()}
    assert (got["small"].processing_time, got["small"].successful, got["small"].metadata) == (5.0, 9, "m")
    assert (got["big"].status, got["big"].total_items, got["big"].job_errors) == ("completed", 20, 1)
    assert (got["huge"].status, got["huge"].successful, got["huge"].job_errors) == ("completed", 5000, 5000)
    assert (got["none"].status, got["none"].total_items, got["none"].success_rate) == ("processing", 0, 0.0)
    results = summaries.job_results(jobs, items.union(many))
    assert [r.result for r in results.where("job_id = 'small'").orderBy("pos").collect()] == ["0", "1", "2", None, "4", "5", "6", "7", "8", "9"]
    assert results.where("job_id = 'huge'").count() == 5000 and summaries.job_errors(jobs, errors).count() == 5001


def test_pluggable_tokenizer_and_encoder(spark):
    df = spark.createDataFrame([(1, "one two three", "four")], "id int, text1 string, text2 string")
    tok = lambda: lambda texts, n: [[len(w) for w in t.split()][:n] for t in texts]
    r = K.tokenize_pairs(df, ["id"], tokenizer=tok, max_source=3).first()
    assert (r.input_ids, r.labels) == ([11, 3, 3], [4])
    enc = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert K.embed(df, "text1", encoder=enc).first().vector == [13.0, 1.0]


def test_log_lines(spark, tmp_path):
    (tmp_path / "app.log").write_text(
        '2024-01-01 10:00:00,123 - performance - INFO - {"event": "Function completed", "logger": "performance", "level": "info", '
        '"timestamp": "2024-01-01T10:00:00.123Z", "function": "f", "execution_time": "0.250s"}\n'
        '{"event": "Function failed", "level": "error", "function": "f", "execution_time": "1.500s", "error": "boom"}\nnoise\n'
    )
    r = summaries.function_latency(readers.read_request_log(spark, str(tmp_path / "app.log"))).orderBy("outcome").collect()
    assert [(x.outcome, x.n_calls, x.max_seconds, x.n_errors) for x in r] == [("completed", 1, 0.25, 0), ("failed", 1, 1.5, 1)]


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The events in time order, in several files, so that state crosses micro-batches."""
    path = str(tmp_path_factory.mktemp("events") / "e")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("k", F.get_json_object("props", "$.k"))
    for day in range(0, 30, 10):
        e.where(f"day(ts) > {day} and day(ts) <= {day + 10}").coalesce(1).write.mode("append").parquet(path)
    return e.where("day(ts) <= 30"), path


@pytest.mark.parametrize("kind", ["bucket", "sliding", "dedupe"])
def test_state_crosses_micro_batches(spark, event_files, kind):
    e, path = event_files
    stream = read_stream(spark, path, max_files=1)
    week = 7 * 86400
    if kind == "bucket":
        out = SA.stream_token_bucket(stream, "event_type", "ts", "event_id", 3, 0.0001, delay="40 days")
        want, value = token_bucket_admit(e, "event_type", "ts", "event_id", 3, 0.0001), "admitted"
    elif kind == "sliding":
        out = SA.stream_sliding_admit(stream, "event_type", "ts", "event_id", 20, week, delay="40 days")
        want, value = sliding_window_admit(e, "event_type", "ts", "event_id", 20, week), "admitted"
    else:
        out = SA.stream_dedupe_ttl(stream, "k", "ts", "event_id", week, delay="40 days")
        want, value = replay_cache(e, "k", "ts", "event_id", week), "hit"
    got = {r.event_id: r[value] for r in run_to_table(out, kind).collect() if not r.late}
    assert got == {r.event_id: r[value] for r in want.collect()}


def test_file_to_report(spark, tmp_path):
    from pairloom.plans.jobs import rewrite_file, score_texts

    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)] + ["", "y" * 10_001]
    (tmp_path / "in.txt").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # several splits
    try:
        store = S.ResultsStore(spark, str(tmp_path / "store"))
        outcome, bad = rewrite_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), store, at(0))
        assert (outcome.first().total, outcome.first().successful) == (3001, 3001) and bad.count() == 0
        outcome, bad = rewrite_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "short"), store, at(0), max_chars=10_000)
        assert outcome.first().total == 3000 and [r.pos for r in bad.collect()] == [3000]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).split("\n")
    assert text[0:-1:3] == [f"Original: {t.strip()}" for t in lines[:3000] + lines[3001:]]
    o = spark.createDataFrame([("b", 0, "One two")], "batch_id string, pos bigint, text string")
    scored, summary = score_texts(o, o)
    assert scored.first().word_overlap == 1.0 and summary.first().total_evaluations == 1


def test_memoized_dispatch_calls_lists_once(spark, tmp_path):
    from pairloom.operators.generate import memoized_dispatch

    store = S.ResultsStore(spark, str(tmp_path / "memo"))
    rows = spark.createDataFrame([(i, "openrouter", None, None if i == 7 else f"t{i % 5}") for i in range(20)], "id int, provider string, model string, text string")

    def model(texts, name):
        return [f"{t} of {len(texts)}" for t in texts]

    done = memoized_dispatch(rows.coalesce(1), {"openrouter": model}, store, at(0), batch=3).collect()
    assert all((r.result is None) == (r.id == 7) for r in done) and not any(r.cached for r in done)
    assert {r.result.split(" of ")[1] for r in done if r.result} <= {"1", "2", "3"}
    again = memoized_dispatch(rows, {}, store, at(1)).collect()
    assert all(r.cached and r.attempts == 0 for r in again if r.id != 7)
    assert {r.id: r.result for r in again} == {r.id: r.result for r in done}
    short = memoized_dispatch(rows.limit(1), {"openrouter": lambda texts, name: []}, S.ResultsStore(spark, str(tmp_path / "m2")), at(0)).first()
    assert short.status == "fallback" and "replies" in short.error
