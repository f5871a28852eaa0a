"""Text primitives as column expressions; Python only where Spark has no built-in (NFKC, difflib, ROUGE-L)."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
MARK = "\u0001"


def trim_blank(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_korean(language: Column) -> Column:
    return F.coalesce(language.isin("kr", "ko"), F.lit(False))


def sentences(text: Column, language: Column) -> Column:
    """Sentences by simple rules: Korean loses its closing marks, other languages keep them."""
    korean = F.split(text, r"[.!?]+\s*")
    other = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + MARK), MARK)
    return F.filter(F.transform(F.when(is_korean(language), korean).otherwise(other), trim_blank), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalise_numbers(text: Column) -> Column:
    """Thousands commas dropped, `%` spelled out."""
    return F.replace(F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?![\p{L}\p{N}_]))", ""), F.lit("%"), F.lit(" percent"))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


def normalise(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, lower case, numbers, single blanks; null becomes empty."""
    plain = F.coalesce(text, F.lit(""))
    if not ascii_only:
        plain = _nfkc(plain)
    return trim_blank(F.regexp_replace(normalise_numbers(F.lower(plain)), BLANK + "+", " "))


def contains_answer(text: Column, answer: Column) -> Column:
    """Whether normalised `text` contains normalised `answer`; false where either is empty. Both are given normalised."""
    return (text != "") & (answer != "") & F.contains(text, answer)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def at_least(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio reaches the threshold; its cheap upper bounds are tried first."""
    match = difflib.SequenceMatcher(None, a, b)
    return match.real_quick_ratio() >= threshold and match.quick_ratio() >= threshold and match.ratio() >= threshold


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib similarity of two texts."""
    return pd.Series([ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)])


def rouge_l(reference: str, candidate: str) -> float:
    """F-measure of the longest common subsequence over lower-case words, without stemming."""
    x, y = (re.findall(r"[^\W_]+", t.lower()) for t in (reference, candidate))
    if not x or not y:
        return 0.0
    row = [0] * (len(y) + 1)
    for a in x:
        left = 0
        for j, b in enumerate(y, 1):
            left, row[j] = row[j], (left + 1 if a == b else max(row[j], row[j - 1]))
    common = row[-1]
    if not common:
        return 0.0
    p, r = common / len(y), common / len(x)
    return 2 * p * r / (p + r)


@F.pandas_udf(T.DoubleType())
def rouge_l_score(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a or "", b or "") for a, b in zip(reference, candidate)])


def retry_after_ms(message: Column) -> Column:
    """Milliseconds a rate-limit message asks to wait; null without one."""
    found = F.regexp_extract(message, r"Try again in\s+(\d+)ms", 1)
    return F.when(found != "", found.cast("int"))


def context_block(texts: Column, label: str = "참조") -> Column:
    """Numbered passages joined by blank lines."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("]\n"), t)), "\n\n")


def chunk_hash(document_id: Column, start: Column, end: Column, content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of document, positions and content."""
    return F.substring(F.sha2(F.concat_ws(":", document_id, start.cast("string"), end.cast("string"), content), 256), 1, 16)


#: Requests for completion providers, by kind and language.
REQUESTS = {
    "semantic": ("Split the text into coherent passages. Reply with JSON: chunks with content, start_idx, end_idx, topic, keywords.",
                 "글을 뜻이 이어지는 단락으로 나누세요. JSON으로 답하세요: chunks에 content, start_idx, end_idx, topic, keywords."),
    "semantic_query": ("Split the text into coherent passages and judge how each helps with the question. Reply with JSON: chunks with content, start_idx, end_idx, topic, relevance_score, reason.",
                       "글을 단락으로 나누고 질문에 얼마나 도움이 되는지 평가하세요. JSON으로 답하세요: chunks에 content, start_idx, end_idx, topic, relevance_score, reason."),
    "keyword": ("Describe the text. Reply with JSON: title, summary, key_points, meta_info with entities, topics, keywords.",
                "글을 설명하세요. JSON으로 답하세요: title, summary, key_points, meta_info에 entities, topics, keywords."),
    "keyword_query": ("Describe what the text says about the question. Reply with JSON: title, summary, key_points, meta_info with entities, topics, keywords.",
                      "글이 질문에 대해 말하는 것을 설명하세요. JSON으로 답하세요: title, summary, key_points, meta_info에 entities, topics, keywords."),
    "query_analysis": ("Describe the question. Reply with JSON: question_type, key_entities, keywords, required_info, complexity.",
                       "질문을 설명하세요. JSON으로 답하세요: question_type, key_entities, keywords, required_info, complexity."),
    "query_aware": ("Extract the passages that help to answer the question. Reply with JSON: chunks with content, start_idx, end_idx, relevance_score, relevance_reason, answer_contribution, keywords; coverage.",
                    "질문에 답하는 데 도움이 되는 단락을 뽑으세요. JSON으로 답하세요: chunks에 content, start_idx, end_idx, relevance_score, relevance_reason, answer_contribution, keywords; coverage."),
    "answer": ("Answer the question from the passages only. Say so if they hold no answer.", "단락에 있는 내용만으로 질문에 답하세요. 답이 없으면 없다고 하세요."),
    "fusion": ("Merge the answers into one that is complete and free of contradictions.", "여러 답을 빠짐없고 모순 없는 하나의 답으로 합치세요."),
    "translate": ("Translate the text. Keep numbers and names.", "글을 번역하세요. 숫자와 이름은 그대로 두세요."),
}
#: Kinds whose cut contents end with an ellipsis.
ELLIPSIS = ("keyword", "keyword_query")


def prompt(kind: str, content: Column, query: Column | None = None, language: Column | None = None, limit: int = 10_000) -> Column:
    """The request of a kind in the language of the text; the content is cut at the limit."""
    english, korean = REQUESTS[kind]
    ask = F.lit(english) if language is None else F.when(is_korean(language), korean).otherwise(english)
    head = [ask, F.lit("\n\n")]
    if query is not None:
        label = F.lit("Question: ") if language is None else F.when(is_korean(language), "질문: ").otherwise("Question: ")
        head += [label, query, F.lit("\n\n")]
    cut = F.substring(content, 1, limit)
    return F.concat(*head, F.when(F.length(content) > limit, F.concat(cut, F.lit("..."))).otherwise(cut) if kind in ELLIPSIS else cut)


def answer_prompt(question: Column, context: Column, language: Column) -> Column:
    """The request for an answer from all of the numbered passages."""
    english, korean = REQUESTS["answer"]
    kr = is_korean(language)
    return F.concat(F.when(kr, korean).otherwise(english), F.lit("\n\n"), context, F.lit("\n\n"), F.when(kr, "질문: ").otherwise("Question: "), question)
