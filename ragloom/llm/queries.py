"""Queries of the training-text operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.llm import alignment, defects, formatting_copies, lookalikes, mixing, neighbours, packing, sentences, splitting
from ragloom.sources.tables import table


def p1_found(spark, base):
    units = sentences.sentence_units(table(spark, base, "rag_documents"), "document_id", "content", "language")
    return units.withColumnRenamed("id", "document_id")


def p2_found(spark, base):
    return splitting.audit(table(spark, base, "chunks"), table(spark, base, "rag_documents"), table(spark, base, "chunk_specs"))


def p2_document_pieces(spark, base):
    specs = F.broadcast(table(spark, base, "chunk_specs"))  # a fixed table
    docs = table(spark, base, "rag_documents").select("document_id", "content").where(F.col("content").isNotNull())
    each = docs.join(specs, F.length("content") > F.col("size_limit"))
    return splitting.pieces(each, ["document_id", "strategy"], "content", "size_limit", "overlap")


def p2_chunk_pieces(spark, base):
    specs = F.broadcast(table(spark, base, "chunk_specs"))
    chunks = table(spark, base, "chunks").select("chunk_id", "strategy", "content").join(specs, "strategy").where(
        F.length("content") > F.col("size_limit")).dropDuplicates(["chunk_id"])
    return splitting.pieces(chunks, ["chunk_id", "strategy"], "content", "size_limit", "overlap")


def p3_found(spark, base):
    return alignment.aligned_lines(table(spark, base, "translated_docs"), table(spark, base, "lexicon"))


def p4_found(spark, base):
    pairs = defects.answer_pairs(table(spark, base, "queries"), table(spark, base, "responses"))
    return defects.defects(pairs).withColumnRenamed("id", "item_id")


def p5_found(spark, base):
    near = neighbours.nearest(table(spark, base, "chunks"), "chunk_id", "embedding")
    return neighbours.neighbour_pairs(near).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p6_found(spark, base):
    sets = formatting_copies.copy_sets(table(spark, base, "doc_loads"), "load_id", "content")
    return sets.where(F.col("id") != F.col("keep_id")).select(F.col("keep_id").alias("keep_load_id"), F.col("id").alias("copy_load_id"))


def p6_collapsed(spark, base):
    return formatting_copies.collapse(table(spark, base, "doc_loads"), "load_id", "content")


def p7_found(spark, base):
    packed = packing.pack(table(spark, base, "documents"), "doc_id", "text")
    return packed.where("n_pieces > 1 and piece = 0").select(F.col("id").alias("doc_id")).distinct()


def p7_containers(spark, base):
    packed = packing.pack(table(spark, base, "documents"), "doc_id", "text")
    return packed.withColumnRenamed("id", "doc_id")


def p7_fill(spark, base):
    return packing.fill(packing.pack(table(spark, base, "documents"), "doc_id", "text"))


def p8_mix(spark, base):
    mixed = mixing.mix(table(spark, base, "documents"), table(spark, base, "mix_targets"), "doc_id", "text")
    return mixed.withColumnRenamed("id", "doc_id")


def p8_shares(spark, base):
    targets = table(spark, base, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, base, "documents"), targets, "doc_id", "text"), targets)


def p9_found(spark, base):
    pairs = lookalikes.look_alike_pairs_of(table(spark, base, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_forms(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    return lookalikes.consistent_form(docs, "text", "form", lookalikes.learned_rewrites(docs, "text")).select("doc_id", "form")


def p9_classes(spark, base):
    return lookalikes.look_alike_classes(table(spark, base, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f for f in (
        p1_found, p2_found, p2_document_pieces, p2_chunk_pieces, p3_found, p4_found, p5_found, p6_found, p6_collapsed, p7_found, p7_containers, p7_fill,
        p8_mix, p8_shares, p9_found, p9_forms, p9_classes)
}

SQL: dict[str, str] = {
    "p2_found": r"""with c as (select distinct on (chunk_id) * from chunks),
p as (select c.*, size_limit, overlap, d.content doc, b.end_idx before_end, substr(d.content, c.start_idx + 1, c.end_idx - c.start_idx) stretch
  from c left join rag_documents d using (document_id) left join chunk_specs s using (strategy)
  left join c b on b.document_id = c.document_id and b.strategy = c.strategy and b.sequence_num = c.sequence_num - 1)
select chunk_id, 'oversize' fault from p where length(content) > size_limit
union all select chunk_id, 'content' from p where coalesce(stretch <> content, true)
union all select chunk_id, 'overlap' from p where sequence_num > 0 and start_idx <> before_end - overlap
union all select chunk_id, 'midword' from p where end_idx > 0 and regexp_matches(substr(doc, end_idx, 2), '^[\p{L}\p{N}]{2}$')
  and regexp_matches(substr(stretch, length(stretch) // 2 + 1), '[\s\x0b\x1c-\x1f\x85\p{Z}]')""",
    "p7_found": r"""select distinct doc_id from documents
where len(regexp_extract_all("text", '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]+')) > 1024""",
}
