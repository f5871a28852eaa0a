"""Defective question and answer pairs: empty, truncated, refusal, copied, wrong language.

A pushdown parser and the marks at the end find answers that break off visibly; the rest of the answers without a
closing mark are judged by their last words: the corpus tells how often a word (after the word before it) ends a
text, and which words only ever occur as the cut-off beginning of another. Short answers and sentences are counted
apart, as a name that is often a whole answer seldom ends a sentence.

At most one defect a pair, in the order empty, copied, refusal, wrong_language, truncated. Defined results: a null
answer is empty; a null or unknown question leaves the checks that need no question; an id counts once, with any
one of its rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import answer_checks as checks
from ragloom.operators.durable import durable
from ragloom.operators.skew import salted_join

#: A text is open where its last words end fewer than ENDS of the texts they are seen in. More general counts weigh as much as
#: PRIOR sightings. Short texts have up to SHORT words. A word that only ends texts is a fragment of FRAGMENT times as many longer ones.
ENDS, PRIOR, SHORT, FRAGMENT = 0.05, 2.0, 4, 20


def visible_defect(question: str | None, language: str | None, answer: str | None) -> str | None:
    if checks.is_empty(answer):
        return "empty"
    if checks.is_copied(question, answer):
        return "copied"
    if checks.is_refusal(question, answer):
        return "refusal"
    if checks.is_wrong_language(question, language, answer):
        return "wrong_language"
    if checks.open_end(checks.unlabelled(answer)):
        return "truncated"
    return None


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair rows (side, id, defect, before, last, short) and counts of word pairs (before, last, short, n, stops, bare)."""
    for batch in batches:
        found, counts = [], defaultdict(lambda: [0, 0, 0])
        for side, key, question, language, answer in zip(batch["side"], batch["id"], batch["question"], batch["language"], batch["answer"]):
            defect = visible_defect(question, language, answer)
            if defect:
                found.append((side, key, defect, None, None, False))
                if defect != "truncated":
                    continue
            text = checks.bare(answer)
            words = ["0" if w.isdigit() else checks.DIGITS.sub("0", w) for w in checks.WORD.findall(text.casefold())]
            short = len(words) <= SHORT
            closed = checks.closed_end(text)
            ends = {len(words) - 1} if closed else set()
            for at, (a, b) in enumerate(zip(["", *words], words)):
                counts[a, b, short][0] += 1
                if at in ends:
                    counts[a, b, short][1] += 1
            if not closed and not defect and words:
                before, last = checks.last_words(text)
                counts[before, last, short][2] += 1
                found.append((side, key, None, before, last, short))
        out = pd.DataFrame(found, columns=["side", "id", "defect", "before", "last", "short"])
        stats = pd.DataFrame([(*k, *n) for k, n in counts.items()], columns=["before", "last", "short", "n", "stops", "bare"])
        yield pd.concat([out.assign(n=0, stops=0, bare=0), stats.assign(side=None, id=None, defect=None)], ignore_index=True)[
            ["side", "id", "defect", "before", "last", "short", "n", "stops", "bare"]]


def open_endings(counts: DataFrame) -> DataFrame:
    """(before, last, short) of word pairs at which a text without closing mark breaks off.

    The share of a pair's or word's sightings that end a text is estimated from its own counts and, with the weight of
    PRIOR sightings, from the next more general counts: pair in texts of the kind, word in texts of the kind, pair, word, all
    words. So one more row never switches from one rule to another.
    """
    total = lambda df, keys, name, own="": df.groupBy(*keys).agg(*[F.sum(f"{own}{c}").alias(f"{name}{c}") for c in ("n", "stops", "bare")])
    kinds = durable(total(counts, ["before", "last", "short"], "k_"))  # the raw counts are read once
    pairs = total(kinds, ["before", "last"], "", "k_")
    kind_words = total(kinds, ["last", "short"], "kw_", "k_")
    words = total(pairs, ["last"], "w_")
    lengths = kinds.where("k_bare > 0").agg(F.array_sort(F.collect_set(F.length("last"))).alias("lengths"))  # one row, a number a length

    def longer(df: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
        """How often longer words begin with a word, in the same place; only beginnings as long as some last word."""
        shorter = F.filter("lengths", lambda k: k < F.length("last"))
        heads = F.transform(shorter, lambda k: F.substring("last", F.lit(1), k))
        return df.crossJoin(F.broadcast(lengths)).select(*keys, F.explode(heads).alias("head"), n).groupBy(*keys, F.col("head").alias("last")).agg(F.sum(n).alias(name))

    everything = words.agg(((F.sum("w_stops") + F.sum("w_bare")) / F.sum("w_n")).alias("base"))  # one row
    ending = (kinds.where("k_bare > 0").join(pairs, ["before", "last"]).join(kind_words, ["last", "short"]).join(words, "last").crossJoin(F.broadcast(everything))
              .join(longer(words, [], "w_n", "w_longer"), "last", "left").join(longer(pairs, ["before"], "n", "longer"), ["before", "last"], "left"))
    fragment = ((F.col("w_n") == F.col("w_bare")) & (F.coalesce("w_longer", F.lit(0)) >= FRAGMENT * F.col("w_n"))
                | (F.col("n") == F.col("bare")) & (F.coalesce("longer", F.lit(0)) >= FRAGMENT * F.col("n")))
    share = F.col("base")
    for name in ("w_", "", "kw_", "k_"):
        share = (F.col(f"{name}stops") + F.col(f"{name}bare") + PRIOR * share) / (F.col(f"{name}n") + PRIOR)
    return ending.where(fragment | (share < ENDS)).select("before", "last", "short")


def defects(pairs: DataFrame) -> DataFrame:
    """(side, id, defect) of pairs (side, id, question, language, answer)."""
    judged = durable(pairs.select("side", "id", "question", "language", "answer").mapInPandas(
        _judge, "side string, id string, defect string, before string, last string, short boolean, n bigint, stops bigint, bare bigint"))
    seen = judged.where("defect is not null").select("side", "id", "defect")
    key = F.concat_ws("\u0001", "before", "last", F.col("short").cast("string")).alias("key")
    doubtful = judged.where("id is not null and defect is null").select("side", "id", key)
    endings = open_endings(judged.where("n > 0 or bare > 0").select("before", "last", "short", "n", "stops", "bare")).select(key)
    cut = salted_join(doubtful, endings, "key", F.xxhash64("id"), "inner")
    return seen.unionByName(cut.select("side", "id", F.lit("truncated").alias("defect")))


def answer_pairs(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """(side, id, question, language, answer) of both tables; the question of a response by its query_id."""
    asked = queries.select("query_id", "question", "language", "expected_answer").where(
        F.col("query_id").isNotNull()).dropDuplicates(["query_id"])
    own = asked.select(F.lit("query").alias("side"), F.col("query_id").alias("id"), "question", "language", F.col("expected_answer").alias("answer"))
    given = responses.select("response_id", "query_id", "response").where(F.col("response_id").isNotNull()).dropDuplicates(["response_id"])
    joined = salted_join(given, asked.select("query_id", "question", "language"), "query_id", F.xxhash64("response_id"))
    return own.unionByName(joined.select(
        F.lit("response").alias("side"), F.col("response_id").alias("id"), "question", "language", F.col("response").alias("answer")))
