"""Queries over loaders, the store and the embedding cache, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import vectors
from ragloom.operators import chunkers, embedding
from ragloom.operators.durable import durable, shared_folder
from ragloom.operators.skew import salted_join
from ragloom.plans.registry import asked, documents, query
from ragloom.sources import loaders, store
from ragloom.sources.tables import table


def _items(spark, base):
    """(index, item): questions with their contexts as items of a loaded file; some have no context."""
    d = documents(spark, base).select(F.col("document_id").alias("context_id"), F.col("content").alias("context"))
    q = salted_join(asked(spark, base), d, "context_id", F.xxhash64("query_id"))
    answers = F.struct(F.array_compact(F.array("expected_answer")).alias("text"))
    item = F.struct(F.when(F.col("language") == "en", F.col("query_id")).alias("id"), "context", F.concat(F.lit("text "), "query_id").alias("text"), F.lit(None).cast("string").alias("title"),
                    F.lit("file").alias("source"), "question", F.when(F.col("language") == "en", F.col("expected_answer")).alias("answer"), answers.alias("answers"))
    return q.select(F.substring("query_id", 2, 20).cast("bigint").alias("index"), item.alias("item"))


_ITEMS = """q as (select query_id, any_value(question) question, any_value(language) language, any_value(expected_answer) answer, any_value(context_id) context_id from queries where query_id is not null group by 1),
it as (select cast(substr(query_id, 2) as bigint) i, case when q.language = 'en' then query_id end id, content context, 'text ' || query_id t, question, case when q.language = 'en' then answer end own, answer from q left join rag_documents d on d.document_id = q.context_id)"""


@query(f"with {_ITEMS} select i::varchar query_id, question, coalesce(own, '') expected_answer, i::varchar context_id from it where coalesce(context, '') <> '' and coalesce(question, '') <> ''")
def loaded_questions(spark, base):
    return loaders.pairs(_items(spark, base))[1]


@query(f"with {_ITEMS} select i::varchar document_id, context content from it where coalesce(context, '') <> '' and coalesce(question, '') <> ''")
def loaded_documents(spark, base):
    return loaders.pairs(_items(spark, base))[0]


@query(f"with {_ITEMS} select coalesce(id, 'query_' || i) query_id, coalesce(question, '') question, coalesce(own, answer, '') expected_answer, coalesce(id, 'doc_' || i) context_id from it")
def loaded_rich_questions(spark, base):
    return loaders.rich_pairs(_items(spark, base))[1]


@query(f"with {_ITEMS} select coalesce(id, 'doc_' || i) document_id, coalesce(context, t, '') content, null::varchar title, 'file' source from it")
def loaded_rich_documents(spark, base):
    return loaders.rich_pairs(_items(spark, base))[0]


@query(f"with {_ITEMS} select id query_id, coalesce(question, '') question, coalesce(own, answer, '') expected_answer from it where id is not null")
def loaded_lines(spark, base):
    """Items written as JSON lines and read back."""
    folder = shared_folder(spark, "lines")
    _items(spark, base).where("item.id is not null").select("item.*").write.json(folder)
    return loaders.rich_pairs(loaders.read_lines(spark, folder))[1].select("query_id", "question", "expected_answer")


@query("select query_id, any_value(question) question from queries where query_id is not null group by 1 order by 1 limit 100")
def first_questions(spark, base):
    """The head sampler: the first hundred by an explicit order."""
    return loaders.head(asked(spark, base).select("query_id", "question"), 100, "query_id")


@query("select id, language, question, answer from (values " + ", ".join(
    f"('{i}', '{lang}', '{q}', '{a}')" for i, lang, q, a in (
        ("s1", "en", "How long should hands be washed?", "twenty seconds"), ("s2", "en", "At what temperature is the vaccine stored?", "four degrees"),
        ("s3", "en", "When is a doctor needed?", "Fever above 39 degrees"), ("s4", "kr", "손은 얼마나 씻나요?", "이십 초"), ("s5", "kr", "백신은 몇 도에서 보관하나요?", "사 도"),
        ("s6", "kr", "언제 의사를 찾나요?", "39도를 넘으면"))) + ") v(id, language, question, answer)")
def sample_questions(spark, base):
    """The built-in sample, which a missing file falls back to."""
    return loaders.load_rich(spark, shared_folder(spark, "missing"))[1].select(F.col("query_id").alias("id"), "language", "question", F.col("expected_answer").alias("answer"))


# ---- store ---------------------------------------------------------------------------------------------------------
def _stored(spark, base, *names):
    s = store.ChunkStore(spark, shared_folder(spark, "store"), buckets=8)
    c = table(spark, base, "chunks").where("chunk_id is not null").dropDuplicates(["chunk_id"])
    s.save(c.select(*chunkers.COMMON, "language", *names))
    return s


def _probes(spark, base):
    """The stated query set: first chunks of the documents whose number is divisible by 50."""
    c = table(spark, base, "chunks").where("sequence_num = 0 and embedding is not null").where(F.substring("document_id", 2, 20).cast("bigint") % 50 == 0)
    return c.dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vec"))


_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"
_LEN = lambda t: f"list_dot_product({t}.embedding::double[], {t}.embedding::double[])"
_SEARCH = lambda where: f"""with c as (select distinct on (chunk_id) * from chunks where embedding is not null and chunk_id is not null),
s as (select a.chunk_id query_id, b.chunk_id item_id, round(case when {_LEN('a')} * {_LEN('b')} > 0 then {_DOT} / sqrt({_LEN('a')} * {_LEN('b')}) else 0 end, 9) score
  from c a, c b where a.sequence_num = 0 and cast(substr(a.document_id, 2) as bigint) % 50 = 0 and {where})
select query_id, item_id, round(score, 6) score, cast(rank as int) rank from (select *, row_number() over (partition by query_id order by score desc, item_id) rank from s) where rank <= 10 and score >= 0.7"""  # noqa: E731


@query(_SEARCH("b.strategy is not null"))
def store_search(spark, base):
    """Stored chunks most similar to the probes, with the threshold."""
    return _stored(spark, base, "embedding").search(_probes(spark, base)).withColumn("score", F.round("score", 6))


@query(_SEARCH("b.strategy = 'semantic'"))
def store_search_strategy(spark, base):
    """The same within one strategy, of which alone the files are read."""
    return _stored(spark, base, "embedding").search(_probes(spark, base), strategy="semantic").withColumn("score", F.round("score", 6))


@query(_SEARCH("b.document_id = 'd0000000050'"))
def store_search_document(spark, base):
    """The same within one document."""
    return _stored(spark, base, "embedding").search(_probes(spark, base), document_id="d0000000050").withColumn("score", F.round("score", 6))


@query("""select distinct on (chunk_id) chunk_id, document_id, strategy, sequence_num, start_idx, end_idx, content from chunks where document_id = 'd0000000002' and chunk_id is not null""")
def store_load(spark, base):
    return _stored(spark, base).load("d0000000002").select(*chunkers.COMMON)


@query(rf"""with c as (select distinct on (chunk_id) chunk_id, content, strategy from chunks where chunk_id is not null),
w as (select chunk_id, ('0x' || substr(md5(w), 1, 4))::int % 16 b from (select chunk_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) w from c))
select chunk_id, coalesce(sum(n), 0)::double words, coalesce(max(n), 0)::double most from c left join (select chunk_id, b, count(*) n from w group by 1, 2) using (chunk_id) group by 1""")
def store_embedded(spark, base):
    """Chunks embedded and stored; a second run takes the vectors from the store."""
    s = store.ChunkStore(spark, shared_folder(spark, "store"), buckets=8)
    c = table(spark, base, "chunks").where("chunk_id is not null").dropDuplicates(["chunk_id"]).select(*chunkers.COMMON)
    s.embed_and_store(c.where("strategy <> 'semantic'"), embedding.hashing(16))
    s.embed_and_store(c, embedding.hashing(16))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return s.read().select("chunk_id", total.alias("words"), F.array_max("embedding").cast("double").alias("most"))


@query("select count(distinct coalesce(content, '')) entries from rag_documents")
def cache_statistics(spark, base):
    """Entries of the cache after two rounds over the same texts."""
    cache = embedding.EmbeddingCache(spark, shared_folder(spark, "cache"))
    for _ in range(2):
        cache.add(durable(embedding.embed(documents(spark, base), "content", embedding.hashing(16), cache.load())))
    return cache.statistics().select("entries")


@query("""with e as (select distinct on (chunk_id) chunk_id, embedding::double[] v from chunks where embedding is not null and chunk_id is not null), n as (select *, sqrt(list_dot_product(v, v)) l from e)
select chunk_id, round(case when l > 0 then v[1] / l else v[1] end, 6) first, round(case when l > 0 then list_dot_product(v, v) / l / l else 0 end, 6) length from n""")
def unit_vectors(spark, base):
    """Vectors brought to length 1; zero vectors stay zero."""
    e = table(spark, base, "chunks").where("embedding is not null and chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", vectors.normalised(F.col("embedding")).alias("v"))
    return e.select("chunk_id", F.round(F.col("v")[0], 6).alias("first"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("length"))
