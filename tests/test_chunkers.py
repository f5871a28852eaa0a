"""Chunkers against plain loops over hand-made and random texts."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import chunkers

DOCS = "document_id string, content string, language string"


def fixed_loop(text, size=512, overlap=51):
    if len(text) <= size:
        return [(0, len(text), text)]
    out = []
    for i in range(0, len(text), size - overlap):
        end = min(i + size, len(text))
        if end == len(text) and i > 0 and len(text) - i < size * 0.3:
            if out:
                out[-1] = (out[-1][0], end, text[out[-1][0]:end])
            break
        body = text[i:end]
        if not body.strip():
            continue
        if end < len(text) and not body.rstrip().endswith((".", "!", "?", "다", "요", "음")):
            for j in range(end - 1, max(i + size // 2, end - 100) - 1, -1):
                if text[j] in ".!?":
                    end = j + 1
                    break
        out.append((i, end, text[i:end]))
    return out


def texts():
    rng = random.Random(3)
    made = ["", " " * 600, "a" * 511, "a" * 512, "a" * 513, "b" * 614, "b" * 615, "c" * (461 + 153), "c" * (461 + 154), "x" * 461 + " " * 600 + "y" * 400]
    for _ in range(40):
        made.append("".join(rng.choice(["word ", "다. ", "end. ", "\n", "요 ", "x", "é! "]) for _ in range(rng.randrange(1, 700))))
    return made


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{i}", t, "kr" if i % 2 else "en") for i, t in enumerate(texts())] + [("null", None, "en")], DOCS)


def test_fixed_size_equals_loop(spark, docs):
    got = {}
    for r in chunkers.fixed_size(docs).orderBy("document_id", "sequence_num").collect():
        got.setdefault(r["document_id"], []).append((r["start_idx"], r["end_idx"], r["content"]))
    for i, t in enumerate(texts()):
        assert got.get(f"d{i}", []) == fixed_loop(t), i
    assert "null" not in got


def test_recursive_covers_and_is_dense(spark, docs):
    rows = {}
    for r in chunkers.recursive(docs).orderBy("document_id", "sequence_num").collect():
        rows.setdefault(r["document_id"], []).append(r)
    for i, t in enumerate(texts()):
        want = [(p, t[p:p + 512]) for p in range(0, len(t), 462) if len(t[p:p + 512].strip()) > 10]
        own = rows.get(f"d{i}", [])
        assert [(r["start_idx"], r["content"]) for r in own] == want
        assert [r["sequence_num"] for r in own] == list(range(len(own)))


def test_query_aware_equals_sequential_rule(spark):
    sizes = [1, 511, 512, 513, 768, 769, 1024, 1025, 1280, 1281, 3000]
    df = spark.createDataFrame([(str(n), "z" * n, "en") for n in sizes], DOCS)
    got = {}
    for r in chunkers.query_aware_fallback(df).orderBy("sequence_num").collect():
        got.setdefault(int(r["document_id"]), []).append((r["start_idx"], r["end_idx"], r["content"]))
    for n in sizes:
        parts = [{"sequence_num": k, "start_idx": a, "end_idx": min(a + 512, n), "content": "z" * (min(a + 512, n) - a), "relevance_score": 0.5}
                 for k, a in enumerate(range(0, n, 512))]
        assert got[n] == [(c["start_idx"], c["end_idx"], c["content"]) for c in chunkers.merge_scored(parts)]


def test_keyword_parts(spark):
    df = spark.createDataFrame([("a", "One. Two. Three. Four.", "en"), ("b", "하나. 둘. 셋", "kr"), ("c", "", "en")], DOCS)
    rows = {(r["document_id"], r["sequence_num"], r["kind"]): r["content"] for r in chunkers.keyword_fallback(df).collect()}
    assert rows[("a", 1, "summary")] == "Summary: One. Two. Three."
    assert rows[("a", 5, "meta_info")] == "Core Metadata:\n- Topics: General\n"
    assert rows[("b", 2, "key_point")] == "핵심포인트 1: 하나"
    assert rows[("c", 0, "title")] == "Title: No Title" and ("c", 1, "summary") not in rows


def test_relevance_filter_keeps_best_three():
    parts = [{"sequence_num": k, "start_idx": 1000 * k, "end_idx": 1000 * k + 5, "content": "text", "relevance_score": 0.01 * k} for k in range(5)]
    assert [c["id_num"] for c in chunkers.merge_scored(parts)] == [2, 3, 4]


def test_similar_groups_merge_and_missing_positions():
    text = "alpha beta gamma. alpha beta gamma. alpha beta gamma. alpha beta gamma."
    parts = ["alpha beta gamma."] * 4
    found = chunkers.merge_similar(text, parts, 2, 0.75)
    assert found == [{"sequence_num": 0, "start_idx": 0, "end_idx": len(text), "content": text}]
    assert chunkers.merge_similar("other text here", ["nothing like it at all"], 3, 0.75)[0]["start_idx"] == -1


def test_reply_skips_empty_and_casts(spark):
    reply = '{"chunks":[{"content":"a","start_idx":"3"},{"content":""},{"content":"bcd","start_idx":5,"end_idx":"x","topic":"t"}]}'
    rows = chunkers.from_reply(spark.createDataFrame([("d", reply), ("e", "no json"), ("f", None)], "document_id string, reply string")).orderBy("sequence_num").collect()
    assert [(r["sequence_num"], r["start_idx"], r["end_idx"]) for r in rows] == [(0, 3, 4), (2, 5, 8)]


def test_metrics_and_validity(spark, docs):
    chunks = chunkers.fixed_size(docs)
    m = {r["document_id"]: r for r in chunkers.metrics(chunks).collect()}
    assert m["d3"]["num_chunks"] == 1 and m["d3"]["size_std"] == 0.0
    v = {r["document_id"]: r["valid"] for r in chunkers.validity(docs, chunks).collect()}
    assert v["d3"] and not v["d0"] and not v["null"]


def test_registered_strategy(spark, docs):
    chunkers.register("whole", lambda d: d.where("content <> ''").select(
        F.concat("document_id", F.lit("_whole_0")).alias("chunk_id"), "document_id", F.lit("whole").alias("strategy"), F.lit(0).alias("sequence_num"),
        F.lit(0).alias("start_idx"), F.length("content").alias("end_idx"), "content"))
    try:
        assert chunkers.chunk(docs, ["whole"]).count() == len([t for t in texts() if t])
    finally:
        del chunkers.STRATEGIES["whole"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert chunkers.chunk(empty).count() == 0 and chunkers.metrics(chunkers.fixed_size(empty)).count() == 0
