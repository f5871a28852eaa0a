"""The chunking strategies: documents(document_id, content, language) to chunk rows.

All are narrow: every document is cut in place by array expressions (or an Arrow function where the order of a fold
matters), so no strategy shuffles. Null contents give no chunks. Positions are code points, end exclusive.

Columns: chunk_id, document_id, strategy, sequence_num, start_idx, end_idx, content and the strategy's own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions.text import BLANK, at_least, is_korean, sentences, trim_blank, words

LIMIT = 512


def chunk_id(document_id: Column, strategy: str, number: Column) -> Column:
    return F.concat(document_id, F.lit(f"_{strategy}_"), number.cast("string"))


def _given(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("content").isNotNull()).select("document_id", "content", "language")


def _rows(df: DataFrame, strategy: str, array: Column, *own: str) -> DataFrame:
    flat = df.select("document_id", F.explode(array).alias("c"))
    return flat.select(
        chunk_id(F.col("document_id"), strategy, F.col("c.id_num") if "id_num" in own else F.col("c.sequence_num")).alias("chunk_id"),
        "document_id", F.lit(strategy).alias("strategy"), "c.sequence_num", "c.start_idx", "c.end_idx", "c.content",
        *[f"c.{c}" for c in own if c != "id_num"])


def _windows(step: int, size: int) -> Column:
    """array<struct<k, start_idx, content>>: a window of `size` from every multiple of `step`, in one pass over the text."""
    blocks = F.regexp_extract_all(F.col("content"), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    lead = lambda i: F.coalesce(F.try_element_at(blocks, (i + 2).cast("int")), F.lit(""))
    return F.transform(blocks, lambda b, i: F.struct(
        i.cast("int").alias("k"), (i * step).cast("int").alias("start_idx"),
        F.concat(b, F.substring(lead(i), 1, size - step)).alias("content"), F.length(b).alias("own")))


def fixed_size(docs: DataFrame, size: int = LIMIT, overlap_ratio: float = 0.1) -> DataFrame:
    """Fixed windows with a search for a sentence end in the last 100 characters and a merged short tail.

    Starts are not moved by the adjustment, so up to 48 characters can be in no chunk, as specified.
    """
    overlap = int(size * overlap_ratio)
    step = size - overlap
    reach = min(100, size - size // 2)
    df = _given(docs).withColumn("n", F.length("content")).withColumn("w", _windows(step, size))
    last = F.element_at("w", -1)
    df = df.withColumn("merge", (F.size("w") > 1) & (F.coalesce(last["own"], F.lit(0)) < size * 0.3))
    kept = F.filter(F.when(F.col("merge"), F.slice("w", F.lit(1), F.size("w") - 1)).otherwise(F.col("w")),
                    lambda w: ~w["content"].rlike(f"^{BLANK}*$"))

    def adjusted(w: Column) -> Column:
        tail = F.right(w["content"], F.lit(reach))
        upto = F.length(F.regexp_extract(tail, r"(?s)^(.*[.!?])", 1))
        return F.when((w["start_idx"] + F.length(w["content"]) < F.col("n"))
                      & ~w["content"].rlike(r"[.!?다요음]" + BLANK + r"*$") & (upto > 0),
                      F.length(w["content"]) - F.length(tail) + upto).otherwise(F.length(w["content"]))

    long = F.transform(kept, lambda w, i: F.struct(
        i.cast("int").alias("sequence_num"), w["start_idx"].alias("start_idx"), (w["start_idx"] + adjusted(w)).cast("int").alias("end_idx"),
        F.substring(w["content"], F.lit(1), adjusted(w)).alias("content"), F.lit("fixed_size").alias("method"),
        F.when(w["k"] > 0, overlap).otherwise(0).alias("overlap_size"), (adjusted(w) < F.length(w["content"])).alias("adjusted")))
    df = df.withColumn("c", long)
    end = F.element_at("c", -1)
    tail = F.struct(
        end["sequence_num"].alias("sequence_num"), end["start_idx"].alias("start_idx"), F.col("n").alias("end_idx"),
        F.substring(F.col("content"), end["start_idx"] + 1, F.col("n")).alias("content"), F.lit("merged_last").alias("method"),
        F.lit(overlap).alias("overlap_size"), F.lit(False).alias("adjusted"))
    whole = F.array(F.struct(
        F.lit(0).alias("sequence_num"), F.lit(0).alias("start_idx"), F.col("n").alias("end_idx"), F.col("content").alias("content"),
        F.lit("single_chunk").alias("method"), F.lit(0).alias("overlap_size"), F.lit(False).alias("adjusted")))
    chunks = F.when(F.col("n") <= size, whole).when(
        F.col("merge") & (F.size("c") > 0), F.concat(F.slice("c", F.lit(1), F.size("c") - 1), F.array(tail))).otherwise(F.col("c"))
    return _rows(df, "fixed_size", chunks, "method", "overlap_size", "adjusted")


def recursive(docs: DataFrame, size: int = LIMIT, overlap: int = 50) -> DataFrame:
    """A plain sliding window; windows of at most 10 characters without blanks at the ends are dropped."""
    step = max(1, size - max(0, min(overlap, size // 2)))
    kept = F.filter(_windows(step, size), lambda w: F.length(trim_blank(w["content"])) > 10)
    chunks = F.transform(kept, lambda w, i: F.struct(
        i.cast("int").alias("sequence_num"), w["start_idx"].alias("start_idx"),
        (w["start_idx"] + F.length(w["content"])).cast("int").alias("end_idx"), w["content"].alias("content")))
    return _rows(_given(docs), "recursive", chunks)


_PLACED = "array<struct<sequence_num:int,start_idx:int,end_idx:int,content:string>>"


def pack_sentences(parts: list[str], length: int, limit: int) -> list[dict]:
    """Greedy packing of sentences; the joining blank isn't counted and offsets ignore separators, as specified."""
    out, current, start = [], "", 0
    for part in parts:
        if current and len(current) + len(part) > limit:
            out.append({"sequence_num": len(out), "start_idx": start, "end_idx": start + len(current), "content": current.strip()})
            start += len(current)
            current = part
        else:
            current = f"{current} {part}" if current else part
    if current:
        out.append({"sequence_num": len(out), "start_idx": start, "end_idx": length, "content": current.strip()})
    return out


def semantic_fallback(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Sentences packed up to the limit: the strategy without a completion provider."""
    @F.pandas_udf(_PLACED)
    def run(parts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([pack_sentences(list(p), int(n), limit) for p, n in zip(parts, lengths)])

    df = _given(docs)
    return _rows(df, "semantic", run(sentences(F.col("content"), F.col("language")), F.length("content")))


_REPLY = ("struct<chunks:array<struct<content:string,start_idx:string,end_idx:string,topic:string,keywords:array<string>,"
          "relevance_score:string,reason:string,relevance_reason:string,answer_contribution:string>>,coverage:string>")


def readable(reply: Column) -> Column:
    """Whether a provider's reply is a JSON object with at least one field; false for null."""
    body = F.trim(F.coalesce(reply, F.lit("")))
    return body.startswith("{") & F.try_parse_json(body).isNotNull() & ~body.rlike(r"^\{\s*\}$")


def from_reply(replies: DataFrame, strategy: str = "semantic") -> DataFrame:
    """Chunks of provider replies (document_id, reply JSON), with or without a question: empty contents are skipped, numbers keep their gaps."""
    parsed = replies.select("document_id", F.posexplode(F.from_json("reply", _REPLY)["chunks"]).alias("sequence_num", "c"))
    start = F.coalesce(F.col("c.start_idx").try_cast("int"), F.lit(0))
    return parsed.where(F.coalesce(F.col("c.content"), F.lit("")) != "").select(
        chunk_id(F.col("document_id"), strategy, F.col("sequence_num")).alias("chunk_id"), "document_id", F.lit(strategy).alias("strategy"),
        "sequence_num", start.alias("start_idx"), F.coalesce(F.col("c.end_idx").try_cast("int"), start + F.length("c.content")).alias("end_idx"),
        "c.content", "c.topic", "c.keywords", F.col("c.relevance_score").try_cast("double").alias("relevance_score"), "c.reason")


def answered(docs: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose reply can be read, with it in `reply`, and the others. `replies` has one row a document."""
    both = _given(docs).join(replies.select("document_id", "reply"), "document_id", "left")
    return both.where(readable(F.col("reply"))), both.where(~readable(F.col("reply"))).drop("reply")


def semantic(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks by replies, by packed sentences for documents without a readable one."""
    good, rest = answered(docs, replies)
    return from_reply(good).unionByName(semantic_fallback(rest), allowMissingColumns=True)


_DESCRIBED = "struct<title:string,summary:string,key_points:array<string>,meta_info:struct<entities:array<string>,topics:array<string>,keywords:array<string>>>"


def keyword_from_reply(docs: DataFrame) -> DataFrame:
    """Title, summary, key points and meta information of documents with a `reply`.

    Numbers are fixed for title, summary and key points; the meta information takes the number of chunks before it, so it
    can share its number (and id) with a key point where title or summary is missing, as specified.
    """
    df = docs.select("document_id", is_korean(F.col("language")).alias("kr"), F.from_json("reply", _DESCRIBED).alias("r"),
                     F.get_json_object("reply", "$.meta_info").alias("given"))
    label = lambda kr, en: F.when(F.col("kr"), kr).otherwise(en)
    points = F.coalesce("r.key_points", F.array().cast("array<string>"))
    listed = lambda name, kr, en: F.when(F.size(F.col(f"r.meta_info.{name}")) > 0, F.concat(
        label(kr, en), F.array_join(f"r.meta_info.{name}", ", "), F.lit("\n"))).otherwise("")
    # Labels of the parts.
    info = F.concat(label("핵심 메타정보:\n", "Core Metadata:\n"), listed("entities", "- 주요 개체: ", "- Main Entities: "),
                    listed("topics", "- 주제: ", "- Topics: "), listed("keywords", "- 키워드: ", "- Keywords: "))

    def part(seq: Column, head: Column, body: Column, kind: str, weight: float) -> Column:
        return F.struct(seq.cast("int").alias("sequence_num"), F.lit(0).alias("start_idx"), F.length(body).alias("end_idx"),
                        F.concat(head, body).alias("content"), F.lit(kind).alias("kind"), F.lit(weight).alias("importance"))

    df = df.withColumn("points", points).withColumn("info", info)
    front = F.array_compact(F.array(
        F.when(F.length("r.title") > 0, part(F.lit(0), label("제목: ", "Title: "), F.col("r.title"), "title", 1.0)),
        F.when(F.length("r.summary") > 0, part(F.lit(1), label("요약: ", "Summary: "), F.col("r.summary"), "summary", 0.9))))
    keys = F.transform("points", lambda p, i: part(
        i + 2, F.concat(label("핵심포인트 ", "Key Point "), (i + 1).cast("string"), F.lit(": ")), F.coalesce(p, F.lit("")), "key_point", 0.8))
    has_info = F.col("given").isNotNull() & ~F.col("given").isin("{}", "null", "")
    meta = F.when(has_info, F.array(part(F.size(front) + F.size("points"), F.lit(""), F.col("info"), "meta_info", 0.7)))
    return _rows(df, "keyword", F.concat(front, keys, F.coalesce(meta, F.slice(keys, 1, 0))), "kind", "importance")


def keyword(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks by replies, by the first sentences for documents without a readable one."""
    good, rest = answered(docs, replies)
    return keyword_from_reply(good).unionByName(keyword_fallback(rest))


def keyword_fallback(docs: DataFrame) -> DataFrame:
    """Title, summary, up to three key points and the meta information of each document."""
    df = _given(docs).withColumn("s", sentences(F.col("content"), F.col("language"))).withColumn("kr", is_korean(F.col("language")))
    label = lambda kr, en: F.when(F.col("kr"), kr).otherwise(en)
    title = F.coalesce(F.substring(F.try_element_at("s", F.lit(1)), 1, 100), label("제목 없음", "No Title"))
    summary = F.when(F.size("s") > 3, F.substring(F.array_join(F.slice("s", 1, 3), " "), 1, 300)).otherwise(F.substring("content", 1, 300))
    points = F.transform(F.slice("s", 1, 3), lambda p: F.substring(p, 1, 100))
    meta = label("핵심 메타정보:\n- 주제: 일반\n", "Core Metadata:\n- Topics: General\n")

    def part(seq: Column, head: Column, body: Column, kind: str, weight: float, end: Column | None = None) -> Column:
        return F.struct(seq.cast("int").alias("sequence_num"), F.lit(0).alias("start_idx"), (F.length(body) if end is None else end).alias("end_idx"),
                        F.concat(head, body).alias("content"), F.lit(kind).alias("kind"), F.lit(weight).alias("importance"))

    df = df.withColumn("title", title).withColumn("summary", summary).withColumn("points", points)
    front = F.array_compact(F.array(
        F.when(F.col("title") != "", part(F.lit(0), label("제목: ", "Title: "), F.col("title"), "title", 1.0)),
        F.when(F.col("summary") != "", part(F.lit(1), label("요약: ", "Summary: "), F.col("summary"), "summary", 0.9))))
    keys = F.transform(F.col("points"), lambda p, i: part(
        i + 2, F.concat(label("핵심포인트 ", "Key Point "), (i + 1).cast("string"), F.lit(": ")), p, "key_point", 0.8))
    count = F.size(front) + F.size("points")
    info = F.array(part(count, F.lit(""), meta, "meta_info", 0.7))
    return _rows(df, "keyword", F.concat(front, keys, info), "kind", "importance")


def query_keywords(question: Column, most: int = 5) -> Column:
    """The first words of a question: the analysis without a completion provider."""
    return F.slice(words(question), 1, most)


_ANALYSIS = "struct<question_type:string,key_entities:array<string>,keywords:array<string>,required_info:array<string>,complexity:string>"


def query_analysis(questions: DataFrame) -> DataFrame:
    """(query_id, question_type, key_entities, keywords, required_info, complexity) of questions with a `reply`.

    Without a readable reply: an information question of moderate complexity with its first five words as keywords.
    """
    none = F.array().cast("array<string>")
    fallback = F.struct(F.lit("information").alias("question_type"), none.alias("key_entities"), query_keywords(F.coalesce("question", F.lit(""))).alias("keywords"),
                        F.array(F.lit("general")).alias("required_info"), F.lit("moderate").alias("complexity"))
    return questions.select("query_id", F.when(readable(F.col("reply")), F.from_json("reply", _ANALYSIS)).otherwise(fallback).alias("a")).select("query_id", "a.*")


def query_aware_from_reply(docs: DataFrame) -> DataFrame:
    """Extracted passages of documents with a `reply`, before filter and merge; a missing relevance is 0.5."""
    r = docs.select("document_id", F.from_json("reply", _REPLY).alias("r")).select("document_id", "r.coverage", F.posexplode("r.chunks").alias("sequence_num", "c"))
    content = F.coalesce("c.content", F.lit(""))
    return r.select(
        chunk_id(F.col("document_id"), "query_aware", F.col("sequence_num")).alias("chunk_id"), "document_id", F.lit("query_aware").alias("strategy"), "sequence_num",
        F.coalesce(F.col("c.start_idx").try_cast("int"), F.lit(0)).alias("start_idx"), F.coalesce(F.col("c.end_idx").try_cast("int"), F.length(content)).alias("end_idx"),
        content.alias("content"), F.coalesce(F.col("c.relevance_score").try_cast("double"), F.lit(0.5)).alias("relevance_score"),
        F.coalesce("c.relevance_reason", F.lit("")).alias("relevance_reason"), F.coalesce("c.answer_contribution", F.lit("")).alias("answer_contribution"),
        F.coalesce("c.keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("coverage", F.lit("0%")).alias("coverage"))


def query_aware(docs: DataFrame, replies: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Passages by replies, filtered by relevance and merged; slices for documents whose reply has none."""
    good, rest = answered(docs, replies)
    some = F.size(F.coalesce(F.from_json("reply", _REPLY)["chunks"], F.array().cast("array<struct<content:string,start_idx:string,end_idx:string,topic:string,"
                  "keywords:array<string>,relevance_score:string,reason:string,relevance_reason:string,answer_contribution:string>>"))) > 0
    slices = query_aware_fallback(rest.unionByName(good.where(~some).drop("reply")), limit)
    return optimise(query_aware_from_reply(good.where(some)), limit).unionByName(slices, allowMissingColumns=True)


_SCORED = T.ArrayType(T.StructType([
    T.StructField("id_num", T.IntegerType()), T.StructField("sequence_num", T.IntegerType()), T.StructField("start_idx", T.IntegerType()),
    T.StructField("end_idx", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("relevance_score", T.DoubleType()),
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("merged_from", T.IntegerType())]))


def merge_scored(parts: list[dict], limit: int = LIMIT, least: float = 0.3) -> list[dict]:
    """Relevance filter (or the best three), then merging of close neighbours of like relevance up to 1.5 limits."""
    score = lambda c: c["relevance_score"] or 0.0
    kept = [c for c in parts if score(c) >= least] or sorted(parts, key=lambda c: -score(c))[:3]
    groups: list[list[dict]] = []
    size = 0
    for c in sorted(kept, key=lambda c: (c["start_idx"], -score(c))):
        close = groups and groups[-1][-1]["end_idx"] >= c["start_idx"] - 100 and abs(score(groups[-1][-1]) - score(c)) < 0.3
        if close and size + len(c["content"]) <= limit * 1.5:
            groups[-1].append(c)
            size += len(c["content"])
        else:
            groups.append([c])
            size = len(c["content"])
    return [{
        "id_num": g[0]["sequence_num"], "sequence_num": n, "start_idx": g[0]["start_idx"], "end_idx": g[-1]["end_idx"],
        "content": " ".join(c["content"] for c in g), "relevance_score": sum(map(score, g)) / len(g) if len(g) > 1 else score(g[0]),
        "keywords": sorted({k for c in g for k in (c.get("keywords") if c.get("keywords") is not None else [])}), "merged_from": len(g)} for n, g in enumerate(groups)]


def optimise(scored: DataFrame, limit: int = LIMIT, least: float = 0.3) -> DataFrame:
    """Filter and merge the scored chunks of each document; ids keep the number of the first merged chunk."""
    @F.pandas_udf(_SCORED)
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([merge_scored([dict(c) for c in p], limit, least) for p in parts])

    grouped = scored.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(
        "sequence_num", F.coalesce("start_idx", F.lit(0)).alias("start_idx"), F.coalesce("end_idx", F.lit(0)).alias("end_idx"),
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce("relevance_score", F.lit(0.5)).alias("relevance_score"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")))).alias("c"))  # chunks of one document
    return _rows(grouped, "query_aware", run("c"), "id_num", "relevance_score", "keywords", "merged_from")


def query_aware_fallback(docs: DataFrame, size: int = LIMIT) -> DataFrame:
    """Slices of equal relevance; after merging, only a remainder of at most half a slice joins its predecessor."""
    df = _given(docs).withColumn("w", _windows(size, size))
    end = F.element_at("w", -1)
    join = (F.size("w") > 1) & (F.length(end["content"]) <= size // 2)
    parts = F.transform("w", lambda w, i: F.struct(
        i.cast("int").alias("sequence_num"), w["start_idx"].alias("start_idx"), (w["start_idx"] + F.length(w["content"])).cast("int").alias("end_idx"),
        w["content"].alias("content"), F.lit(0.5).alias("relevance_score")))
    df = df.withColumn("c", parts).withColumn("join", F.coalesce(join, F.lit(False)))
    a, b = F.element_at("c", -2), F.element_at("c", -1)
    merged = F.struct(a["sequence_num"].alias("sequence_num"), a["start_idx"].alias("start_idx"), b["end_idx"].alias("end_idx"),
                      F.concat_ws(" ", a["content"], b["content"]).alias("content"), F.lit(0.5).alias("relevance_score"))
    return _rows(df, "query_aware", F.when(F.col("join"), F.concat(F.slice("c", F.lit(1), F.size("c") - 2), F.array(merged))).otherwise(F.col("c")),
                 "relevance_score")


def merge_similar(content: str, parts: list[str], group: int, threshold: float) -> list[dict]:
    texts = [" ".join(parts[i:i + group]).strip() for i in range(0, len(parts), group)]
    merged: list[str] = []
    current = ""
    for text in texts:
        if not current:
            current = text
        elif at_least(current, text, threshold):
            current = f"{current} {text}"
        else:
            merged.append(current)
            current = text
    if current:
        merged.append(current)
    out, offset = [], 0
    for text in merged:
        start = content.find(text, offset if offset >= 0 else max(0, len(content) + offset))
        if start == -1:
            start = content.find(text)
        offset = start + len(text)
        if len(text.strip()) > 10:
            out.append({"sequence_num": len(out), "start_idx": start, "end_idx": offset, "content": text})
    return out


def text_similarity(docs: DataFrame, group: int = 3, threshold: float = 0.75) -> DataFrame:
    """Groups of sentences, merged with the running text while their similarity reaches the threshold."""
    @F.pandas_udf(_PLACED)
    def run(contents: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([merge_similar(c, list(p), group, threshold) for c, p in zip(contents, parts)])

    return _rows(_given(docs), "text_similarity", run(F.col("content"), sentences(F.col("content"), F.col("language"))))


def sentence_groups(docs: DataFrame, group: int = 3) -> DataFrame:
    """(document_id, number, text): the groups of sentences alone."""
    df = _given(docs).withColumn("s", sentences(F.col("content"), F.col("language"))).where(F.size("s") > 0)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / group).cast("int")),
                         lambda i: F.array_join(F.slice("s", i * group + 1, F.lit(group)), " "))
    return df.select("document_id", F.posexplode(groups).alias("number", "text"))


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed_size": fixed_size, "recursive": recursive, "semantic": semantic_fallback, "keyword": keyword_fallback,
    "query_aware": query_aware_fallback, "text_similarity": text_similarity}
COMMON = ("chunk_id", "document_id", "strategy", "sequence_num", "start_idx", "end_idx", "content")


def register(name: str, chunker: Callable[[DataFrame], DataFrame]) -> None:
    """Add a strategy: a function from documents to chunk rows with the common columns."""
    STRATEGIES[name] = chunker


def chunk(docs: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """Chunks of all given strategies in one DataFrame."""
    out = None
    for name in strategies or list(STRATEGIES):
        part = STRATEGIES[name](docs).select(*COMMON)
        out = part if out is None else out.unionByName(part)
    return out


def chunk_valid(docs: DataFrame, strategy: str, limit: int = LIMIT) -> DataFrame:
    """Chunks of a strategy, none of documents with an empty chunk or one above two limits."""
    chunks = STRATEGIES[strategy](docs).select(*COMMON)
    good = validity(docs.select("document_id").distinct(), chunks, limit).where("valid")
    return chunks.join(good.select("document_id"), "document_id", "left_semi")


def position(chunks: DataFrame) -> DataFrame:
    """(chunk_id, start, end, length, sequence): where each chunk lies."""
    return chunks.select("chunk_id", F.col("start_idx").alias("start"), F.col("end_idx").alias("end"), F.length("content").alias("length"), F.col("sequence_num").alias("sequence"))


def metrics(chunks: DataFrame) -> DataFrame:
    """Per document: count, sizes and overlap ratio; the denominator is the end of the first chunk, as specified."""
    size = F.length("content")
    first = F.min_by("end_idx", "sequence_num")
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("num_chunks"), F.round(F.avg(size), 6).alias("avg_size"), F.min(size).alias("min_size"),
        F.max(size).alias("max_size"), F.round(F.stddev_pop(size.cast("double")), 6).alias("size_std"),
        F.round(F.when(first > 0, F.greatest(F.lit(0.0), (F.sum(size) - first) / first)).otherwise(0.0), 6).alias("overlap_ratio"))


def validity(docs: DataFrame, chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(document_id, valid): at least one chunk, none empty, none above two limits."""
    bad = F.count_if((F.length("content") == 0) | (F.length("content") > 2 * limit))
    per = chunks.groupBy("document_id").agg((bad == 0).alias("valid"))
    return docs.select("document_id").join(per, "document_id", "left").select("document_id", F.coalesce("valid", F.lit(False)).alias("valid"))


def fixed_statistics(chunks: DataFrame) -> DataFrame:
    """Totals over fixed-size chunks."""
    size, shared = F.length("content"), F.col("overlap_size")
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.round(F.avg(size), 6).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"),
        F.round(F.avg(shared), 6).alias("avg_overlap"), F.sum(size).alias("total_length"), (F.sum(size) - F.sum(shared)).alias("coverage"),
        F.round(F.try_divide(F.sum(shared).cast("double"), F.sum(size)), 6).alias("overlap_ratio"),
        F.count_if("adjusted").alias("adjusted_chunks"), F.count_if(F.col("method") == "merged_last").alias("merged_chunks"))


def fold_small(parts: list[dict], least: int, limit: int) -> list[dict]:
    out: list[dict] = []
    current = None
    for c in parts:
        if current is None:
            current = dict(c)
        elif len(current["content"]) < least and len(current["content"]) + len(c["content"]) < limit:
            current = {**current, "content": current["content"] + " " + c["content"], "end_idx": c["end_idx"]}
        else:
            out.append(current)
            current = dict(c)
    return out + [current] if current else out


def merge_small(chunks: DataFrame, least: int = 100, limit: int = LIMIT) -> DataFrame:
    """Chunks shorter than `least` take in their successors while the limit allows."""
    @F.pandas_udf(_PLACED)
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([fold_small([dict(c) for c in p], least, limit) for p in parts])

    grouped = chunks.groupBy("document_id", "strategy").agg(F.array_sort(F.collect_list(
        F.struct("sequence_num", "start_idx", "end_idx", "content"))).alias("c"))  # chunks of one document
    return grouped.select("document_id", "strategy", F.explode(run("c")).alias("c")).select("document_id", "strategy", "c.*")
