"""Text, vectors, retrieval, metrics, ensembles, statistics, store, loaders, stream and skew-safe joins."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ragloom.functions import distributions, text, vectors
from ragloom.operators import chunkers, embedding, ensembles, evaluation, generation, plugins, retrieval, statistics
from ragloom.operators.skew import salted_join
from ragloom.plans import pipeline
from ragloom.sources import loaders
from ragloom.sources.store import ChunkStore
from ragloom.streaming import chunk_stream


def one(df):
    return df.first()[0]


def test_text_primitives(spark):
    df = spark.createDataFrame([(" Ａ１，２３４  원 84% \n x 1,000", "a1")], "t string, u string")
    assert one(df.select(text.normalise(F.col("t")))) == "a1234 원 84 percent x 1000"
    assert one(spark.range(1).select(text.normalise(F.lit(None).cast("string")))) == ""
    assert one(spark.range(1).select(text.word_count(F.lit(" a b\tc ")))) == 3
    assert one(spark.range(1).select(text.retry_after_ms(F.lit("Try again in 250ms")))) == 250
    assert one(spark.range(1).select(text.context_block(F.array(F.lit("a"), F.lit("b"))))) == "[참조 1]\na\n\n[참조 2]\nb"
    assert text.rouge_l("the cat sat", "the cat") == pytest.approx(0.8)
    assert one(spark.range(1).select(text.contains_answer(F.lit(""), F.lit("")))) is False


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    assert df.select(vectors.normalised(F.col("b"))).first()[0] == [0.0, 0.0]
    assert one(df.select(vectors.euclidean(F.col("a"), F.col("b")))) == 5.0


def test_top_k_blocks_ties_and_short_lists(spark):
    items = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(99, None)], "item_id bigint, vec array<float>").repartition(5)
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "query_id bigint, vec array<float>")
    for block in (1, 100):
        got = {}
        for r in retrieval.top_k(queries, items, 4, block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
        assert [i for i, _ in got[7]] == [2, 5, 8, 11] and [i for i, _ in got[8]] == [0, 1, 2, 3] and 9 not in got
    assert retrieval.top_k(queries, items.limit(2), 4).where("query_id = 7").count() == 2
    assert retrieval.top_k(queries.limit(0), items, 4).count() == 0


def test_metrics_by_hand(spark):
    rows = [("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("b", 1, 0), ("b", 2, 0)]
    m = {(r["query_id"], r["k"]): r for r in evaluation.per_query(spark.createDataFrame(rows, "query_id string, rank int, rel int"), (1, 3)).collect()}
    a = m["a", 3]
    assert (a["hit"], a["recall"], a["mrr"]) == (1.0, 1.0, 0.5)
    assert a["precision"] == pytest.approx(2 / 3) and a["map"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert a["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)))
    assert m["b", 3]["ndcg"] == 0.0 and m["b", 3]["precision"] == 0.0 and m["a", 1]["hit"] == 0.0


def test_auroc_and_rmse(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert one(evaluation.auroc(df, "s", "y")) == 0.75
    assert one(evaluation.rmse(df, "s", "s")) == 0.0


def test_embedding_cache(spark):
    calls = []

    def provider(df):
        calls.append(df.count())
        return embedding.hashing(16)(df)

    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, None)], "id int, t string")
    first = embedding.embed(df, "t", provider)
    assert first.where("id = 3").first()["embedding"] == [0.0] * 16 and calls == [3]
    cache = embedding.grown_cache(None, first)
    assert embedding.embed(df, "t", provider, cache).where("embedding is null").count() == 0 and calls == [3, 0]


RESPONSE = "response_id string, query_id string, strategy string, response string, confidence double, generation_time double, relevances array<double>"


def test_votes(spark):
    rows = [("r1", "q", "a", "the answer is ten days", 0.5, 1.0, [0.5]), ("r2", "q", "b", "the answer is ten days!", 0.9, 1.0, [0.1]),
            ("r3", "q", "c", "something entirely different here", 0.95, 1.0, []), ("r4", "p", "a", "alone", 0.2, 1.0, [])]
    df = spark.createDataFrame(rows, RESPONSE)
    got = {r["query_id"]: r for r in ensembles.vote(df).collect()}
    assert (got["q"]["response_id"], got["q"]["votes"], got["q"]["candidates"]) == ("r2", 2, 3) and got["p"]["votes"] == 1
    assert {r["query_id"]: r["response_id"] for r in ensembles.vote(df, weighted=True).collect()}["q"] == "r2"
    assert ensembles.vote(df.limit(0)).count() == 0


def test_ensembles_use_every_response_of_a_strategy(spark):
    rows = [("r1", "q", "a", "first of its kind", 0.1, 1.0, []), ("r2", "q", "a", "the answer is ten days", 0.5, 1.0, []),
            ("r3", "q", "a", "the answer is ten days!", 0.9, 3.0, [])]
    df = spark.createDataFrame(rows, RESPONSE)
    got = ensembles.vote(df).first()
    assert (got["response_id"], got["votes"], got["candidates"]) == ("r3", 2, 3)
    got = ensembles.vote(df, weighted=True).first()
    assert (got["response_id"], got["candidates"]) == ("r3", 3)
    got = ensembles.fuse(df).first()
    assert (got["n"], got["confidence"], got["generation_time"]) == (3, 0.9, pytest.approx(5 / 3))
    chunk = "struct<id:string,document_id:string,start_idx:int,end_idx:int,relevance_score:double>"
    used = spark.createDataFrame([("r1", "q", "a", [("c1", "d", 0, 5, 0.2)]), ("r2", "q", "a", [("c1", "d", 0, 5, 0.7), ("c2", "d", 5, 9, 0.4)])],
                                 f"response_id string, query_id string, strategy string, chunks_used array<{chunk}>")
    chunks = ensembles.used_chunks(used)
    assert ensembles.unique_by_position(chunks).count() == 2
    assert [(r["id"], r["relevance_score"]) for r in ensembles.unique_by_id(chunks).orderBy("rank").collect()] == [("c1", 0.7), ("c2", 0.4)]
    scored = df.withColumn("texts", F.array(F.lit("the answer is ten days!")))
    assert ensembles.rerank(ensembles.usable(scored)).first()["response_id"] == "r3"


def test_groups_join_the_first_similar_head():
    pick = random.Random(5)
    texts = ["", *(" ".join(pick.choices("abcdefgh", k=pick.randint(0, 5))) for _ in range(600))]
    heads, expected = [], []
    for text in texts:
        key = len(text), ensembles.beginning(text)
        g = next((n for n, head in enumerate(heads) if ensembles.alike(*key, *head)), len(heads))
        if g == len(heads):
            heads.append(key)
        expected.append(g)
    made = ensembles.Groups()
    assert [made.place(t) for t in texts] == expected


def test_confidence(spark):
    df = spark.createDataFrame([("x" * 30, [1.0, 0.5], True), ("short", [], False)], "response string, relevances array<double>, finished boolean")
    got = [r[0] for r in df.select(ensembles.confidence(F.col("response"), F.col("relevances"), F.col("finished"))).collect()]
    assert got == [pytest.approx(0.75), pytest.approx(0.8 * 0.7 * 0.5)]


def test_statistics(spark):
    rows = [("a", "en", 0.5), ("a", "kr", 0.7), ("b", "en", 0.6), ("b", "kr", 0.9)]
    df = spark.createDataFrame(rows, "strategy string, language string, value double")
    assert statistics.paired_t(df).first()["t"] == pytest.approx(-5.0)
    assert distributions.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert distributions.f_upper(4.0, 2, 10) == pytest.approx(0.0530, abs=1e-3)
    assert distributions.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    out = statistics.analyse(df)
    assert out["paired_t"]["p"] == pytest.approx(0.1256659, abs=1e-6) and "paired_t" in statistics.report(out)
    single = df.limit(1)
    assert statistics.descriptive(single).where("strategy is not null").first()["std"] == 0.0
    assert statistics.anova_f(single, "strategy").count() == 0 and statistics.descriptive(df.limit(0)).where("n > 0").count() == 0


def test_store(spark, tmp_path):
    cols = "chunk_id string, document_id string, strategy string, language string, content string"
    s = ChunkStore(spark, str(tmp_path / "store"))
    assert s.read() is None and s.load("d").count() == 0 and s.statistics().count() == 0
    s.save(spark.createDataFrame([("1", "d", "a", "en", "x"), ("2", "d", "b", "en", "y"), ("3", "e", "a", "kr", "z")], cols))
    s.save(spark.createDataFrame([("1n", "d", "a", "en", "new")], cols))
    assert {r["chunk_id"] for r in s.load("d").collect()} == {"1n", "2"} and s.load("d", "b").count() == 1
    s.clear("d")
    assert [r["chunk_id"] for r in s.read().collect()] == ["3"]
    assert s.statistics().where("strategy is null and language is null").first()["chunks"] == 1


def test_loaders(spark, tmp_path):
    rows = [{"context": "c0", "question": "q0", "answer": "a0"}, {"question": "no context"}, {"text": "t", "question": "q2", "answers": {"text": ["x", "y"]}}]
    for name, content in (("bare", rows), ("data", {"data": rows})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(content))
        items = loaders.read_array(spark, str(path))
        docs, asked = loaders.pairs(items)
        assert [r["document_id"] for r in docs.collect()] == ["0"] and asked.first()["context_id"] == "0"
        rich_docs, rich = loaders.rich_pairs(items)
        assert [r["content"] for r in rich_docs.collect()] == ["c0", "", "t"]
        assert rich.where("query_id = 'query_2'").first()["expected_answer"] == "x"
    path = tmp_path / "squad.json"
    path.write_text(json.dumps({"data": [{"title": "T", "paragraphs": [{"context": "C", "qas": [
        {"id": "1", "question": "Q", "answers": [{"text": "A"}]}, {"id": "2", "question": "Q", "answers": []}]}]}]}))
    assert [r["answer"] for r in loaders.read_squad(spark, str(path)).collect()] == ["A"]


def test_sample_pipeline_and_summary(spark):
    docs, asked = loaders.sample_data(spark)
    results = pipeline.experiment(docs, asked, ["fixed_size", "recursive"], 5, 64)
    assert {r["strategy"] for r in results.collect()} == {"fixed_size", "recursive"}
    assert pipeline.best_by(results.where("k = 5"), "mrr").where("is_best").count() == 1


def test_salted_join_equals_plain(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(999, None, 0)], "id int, key string, x int")
    unique = spark.createDataFrame([("hot", "h"), ("k0", "z")], "key string, v string")
    got = salted_join(big, unique, "key", F.xxhash64("id"), rows=50, salts=4)
    assert sorted(got.select("id", "v").collect()) == sorted(big.join(unique, "key", "left").select("id", "v").collect())
    assert salted_join(big.limit(0), unique, "key", F.xxhash64("id")).count() == 0


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "One. " * 300, "en"), ("b", "short", "en")], "document_id string, content string, language string")
    docs.write.parquet(str(tmp_path / "in"))
    s = ChunkStore(spark, str(tmp_path / "store"))
    chunk_stream.start(chunk_stream.read_documents(spark, str(tmp_path / "in")), s, str(tmp_path / "cp"), ["recursive"], once=True).awaitTermination()
    assert s.load("a").count() == 4 and s.load("b").count() == 0


def test_stream_takes_the_latest_row(spark):
    rows = [("a", "old", "en", "2024-01-01"), ("a", "new", "en", "2024-02-01"), ("a", "undated", "en", None), (None, "x", "en", "2024-01-01")]
    batch = spark.createDataFrame(rows, "document_id string, content string, language string, t string").withColumn("loaded_at", F.col("t").cast("timestamp"))
    assert [r["content"] for r in chunk_stream.latest(batch).collect()] == ["new"]


def test_store_rewrites_only_its_buckets_and_keeps_old_readers(spark, tmp_path):
    cols = "chunk_id string, document_id string, strategy string, language string, content string, start_idx int, end_idx int, embedding array<float>"
    s = ChunkStore(spark, str(tmp_path / "store"), buckets=16)
    s.save(spark.createDataFrame([(f"c{i}", f"d{i}", "a", "en", f"text {i}", 0, 6, [float(i), 1.0]) for i in range(20)] + [("z", "dz", "b", "en", "z", 0, 1, None), ("n", None, "a", "en", "n", 0, 1, None)], cols))
    before = s._manifest()[1]["parts"]
    old = s.read()
    s.save(spark.createDataFrame([("new", "d3", "a", "kr", "new text", 0, 8, [1.0, 0.0])], cols))
    after = s._manifest()[1]["parts"]
    assert sum(before[n]["version"] != p["version"] for n, p in after.items()) == 1
    assert old.count() == 22 and s.read().count() == 22 and [r["chunk_id"] for r in s.load("d3").collect()] == ["new"]
    other = ChunkStore(spark, str(tmp_path / "store"))
    assert other.read(strategy="b").count() == 1 and other.search(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<float>"), k=2).first()["item_id"] == "new"
    calls = []

    def provider(df):
        calls.append(df.count())
        return embedding.hashing(4)(df)

    chunks = s.read().drop("embedding")
    s.embed_and_store(chunks, provider)
    assert calls == [2]
    s.vacuum(0)
    assert s.read().where("embedding is null").count() == 0 and len(s.files.names("manifest")) == 1 and s.size_mb() >= 0


def test_two_writers_lose_nothing(spark, tmp_path):
    cols = "chunk_id string, document_id string, strategy string"
    a, b = ChunkStore(spark, str(tmp_path / "s"), 4), ChunkStore(spark, str(tmp_path / "s"), 4)
    create, once = a.files.create, []

    def slow(name, text):
        if not once:
            once.append(1)
            b.save(spark.createDataFrame([("2", "e", "a")], cols))
        return create(name, text)

    a.files.create = slow
    a.save(spark.createDataFrame([("1", "d", "a")], cols))
    assert {r["chunk_id"] for r in a.read().collect()} == {"1", "2"}


def test_replies_and_fallbacks(spark):
    docs = spark.createDataFrame([("a", "One. Two.", "en"), ("b", "Text here.", "kr"), ("c", "Third.", None), ("n", None, "en")], "document_id string, content string, language string")
    described = json.dumps({"title": "T", "key_points": ["p", "q"], "meta_info": {"topics": ["x", "y"]}})
    replies = spark.createDataFrame([("a", described), ("b", "not json"), ("c", "{}"), ("n", described)], "document_id string, reply string")
    got = {r["chunk_id"]: r["content"] for r in chunkers.keyword(docs, replies).collect()}
    assert got["a_keyword_0"] == "Title: T" and got["a_keyword_2"] == "Key Point 1: p" and "b_keyword_0" in got and got["c_keyword_0"] == "Title: Third." and "n_keyword_0" not in got
    assert sorted(r["sequence_num"] for r in chunkers.keyword(docs, replies).where("document_id = 'a'").collect()) == [0, 2, 3, 3]  # meta shares a number with a key point
    parts = json.dumps({"chunks": [{"content": "One.", "start_idx": "0", "relevance_score": 0.9}, {"content": "Two.", "start_idx": 5, "end_idx": 9}], "coverage": "70%"})
    replies = spark.createDataFrame([("a", parts), ("b", '{"chunks": []}')], "document_id string, reply string")
    got = chunkers.query_aware(docs, replies).orderBy("chunk_id").collect()
    assert [(r["document_id"], r["content"], r["relevance_score"]) for r in got] == [("a", "One.", 0.9), ("a", "Two.", 0.5), ("b", "Text here.", 0.5), ("c", "Third.", 0.5)]
    assert {r["document_id"] for r in chunkers.semantic(docs, replies).collect()} == {"a", "c"}
    asked = spark.createDataFrame([("q", "how many days do they wait", None), ("r", None, '{"question_type": "fact"}')], "query_id string, question string, reply string")
    got = {r["query_id"]: r for r in chunkers.query_analysis(asked).collect()}
    assert got["q"]["keywords"] == ["how", "many", "days", "do", "they"] and got["r"]["question_type"] == "fact"


def test_generation(spark):
    kind = "array<struct<content:string,relevance_score:double>>"
    rows = [("1", "q", "en", [("a passage long enough", 0.5), ("b", None)]), ("2", "q", "kr", []), ("3", None, None, None)]
    got = {r["id"]: r for r in generation.generate(spark.createDataFrame(rows, f"id string, question string, language string, chunks {kind}"), generation.extractive).collect()}
    assert got["1"]["response"] == "a passage long enough" and got["1"]["confidence"] == pytest.approx(0.75) and got["1"]["error"] is None
    assert got["2"]["response"].startswith("죄송합니다") and got["2"]["confidence"] == 0.0 and got["3"]["response"].endswith("no passages")
    seen = []
    generation.generate(spark.createDataFrame(rows[:1], f"id string, question string, language string, chunks {kind}"), lambda df: seen.append(df.first()["prompt"]) or generation.extractive(df)).count()
    assert "[참조 2]\nb" in seen[0] and seen[0].endswith("Question: q")


def test_fusion_requests(spark):
    rows = [(f"r{i:03d}", "q", "ab"[i % 2], "x" * 100) for i in range(50)] + [("n", "q", "a", None), ("p", "p", "a", "")]
    got = ensembles.fusion_prompts(spark.createDataFrame(rows, "response_id string, query_id string, strategy string, response string"), 1000).orderBy("query_id", "request").collect()
    assert sum(r["n"] for r in got) == 51 and max(len(r["responses"]) for r in got) < 1200 and got[1]["responses"].startswith("[a 전략 응답 1]\nx") and len(got) == 7


def test_run_with_a_failing_strategy_and_command_line(spark, tmp_path):
    docs, asked = loaders.sample_data(spark)
    chunkers.register("broken", lambda d: d.select(F.raise_error(F.lit("no")).alias("chunk_id"), *[F.lit(None).alias(c) for c in chunkers.COMMON[1:]]))
    try:
        rows, account = pipeline.run(docs, asked, ["recursive", "broken"], 5)
        got = {(r["strategy"], r["language"]): r["num_samples"] for r in rows.collect()}
        assert got == {("recursive", "en"): 3, ("recursive", "kr"): 3, ("broken", "en"): 0, ("broken", "kr"): 0}
        assert account.num_results == 2 and {e["context"] for e in account.errors} == {"en", "en-broken", "kr", "kr-broken"}
    finally:
        del chunkers.STRATEGIES["broken"]
    from ragloom.__main__ import main

    summary = main(["--strategies", "recursive", "fixed_size", "--results_dir", str(tmp_path / "out"), "--enable_embedding_storage", "--storage_path", str(tmp_path / "store")], spark)
    assert {s["strategy"] for s in summary["strategies"]} == {"recursive", "fixed_size"} and json.loads((tmp_path / "out" / "analysis_results.json").read_text())["gap"]
    assert ChunkStore(spark, str(tmp_path / "store")).read().where("embedding is not null").count() > 0
    assert main(["--strategies", "recursive", "--mode", "e2e", "--data_path", str(tmp_path / "none.json")], spark)["strategies"][0]["is_best"]


def test_plugins():
    assert plugins.known("chunker", "recursive") is chunkers.STRATEGIES["recursive"]
    for kind, (operators, _) in plugins.PLUGINS.items():
        plugins.register(kind, "own", len)
        assert plugins.known(kind, "own") is len
        del operators["own"]
    with pytest.raises(KeyError):
        plugins.known("ensemble", "none")


def test_strict_evaluation_and_zero_rows(spark):
    scores = spark.createDataFrame([("a", "en", 5, 2, 1.0, 0.5, 1.0, 1.0, 1.0, 1.0), ("b", "en", 5, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                                   "strategy string, language string, k int, num_samples bigint, hit double, precision double, recall double, mrr double, map double, ndcg double")
    asked = spark.createDataFrame([("1",), ("2",)], "query_id string")
    ranked = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "strategy string, query_id string")
    missing = evaluation.missing_lists(asked, ranked, scores.select("strategy").distinct())
    assert {r["strategy"]: r["missing"] for r in missing.collect()} == {"a": 0, "b": 1}
    kept = evaluation.result_rows(evaluation.strict(scores, missing))
    rows = {r["strategy"]: r for r in evaluation.with_zero_rows(kept, spark.createDataFrame([("b", "en")], "strategy string, language string")).collect()}
    assert rows["a"]["recall_at_k"] == 1.0 and rows["a"]["at_k"][5]["precision"] == 0.5 and rows["b"]["num_samples"] == 0
