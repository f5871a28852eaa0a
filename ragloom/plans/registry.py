"""Where queries are registered with their SQL, the tables they share and the building blocks of their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, base):
    return table(spark, base, "rag_documents").select("document_id", "content", "language")


def asked(spark, base):
    """Each question once."""
    return table(spark, base, "queries").where("query_id is not null").dropDuplicates(["query_id"])


def given(spark, base):
    """Each response once, with the relevances of its chunks."""
    r = table(spark, base, "responses").dropDuplicates(["response_id"])
    return r.withColumn("relevances", F.coalesce(F.transform("chunks_used", lambda c: c["relevance_score"]), F.array().cast("array<double>")))


def searched(spark, base):
    """The stated query set: every question whose number is divisible by 50."""
    return asked(spark, base).where(F.substring("query_id", 2, 20).cast("bigint") % 50 == 0)


# ---- SQL building blocks -------------------------------------------------------------------------------------------
BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]"
TRIM = lambda x: f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"
WORDS = lambda x: f"list_filter(string_split_regex({x}, '{BLANKS}+'), lambda w: w <> '')"
DOCS = "select document_id, content, language, length(content) n from rag_documents where content is not null"
SENT = (f"list_filter(list_transform(case when coalesce(language in ('kr','ko'), false) then string_split_regex(content, '[.!?]+\\s*') else "
         f"string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) end, lambda s: {TRIM('s')}), lambda s: s <> '')")
WIDE = lambda x: f"replace(translate({x}, '，．：；！？（）％', ',.:;!?()%'), '…', '...')"
COMMA = lambda x: f"regexp_replace({x}, '(\\d),(\\d{{3}})([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2\\3', 'g')"
NORM = lambda x: f"trim(regexp_replace(replace({COMMA(COMMA(f'lower({WIDE(x)})'))}, '%', ' percent'), '{BLANKS}+', ' ', 'g'))"
