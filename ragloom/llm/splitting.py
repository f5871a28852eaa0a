"""Splitting oversized texts at natural boundaries, and auditing stored pieces.

Balanced targets: the smallest possible number of pieces is computed, from the limit and from where a text can be cut
without breaking a word; that many targets of equal distance are placed, and each is moved to the strongest boundary
nearby from which the rest still fits. Where a stretch fails, only its own cuts are added. Consecutive pieces overlap by
exactly the given number of characters. Positions are code points, end exclusive.

Defined results: a null text has no pieces; a text within the limit is one piece, also when empty; a text without
any boundary is cut at the targets; the overlap must be smaller than half the limit.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.skew import salted_join

#: Boundaries by strength: the cut lies at the end of the match. 1 is any other place that isn't inside a word.
BOUNDARIES = (
    (2, re.compile(r"\s+")),
    (3, re.compile(r"[,;:]\s+|[，；：、]\s*")),
    (4, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？．।][”’」』）]*\s*")),
    (5, re.compile(r"\n\s*")),
    (6, re.compile(r"\n[^\S\n]*\n\s*")),
)
#: From this strength on a boundary is one between words.
BETWEEN = 2
#: One piece in so many may be spent on stronger boundaries.
SPARE = 64


def least_pieces(length: int, limit: int, overlap: int) -> int:
    """The smallest number of pieces within the limit that cover the length."""
    return 1 if length <= limit else -(-(length - overlap) // (limit - overlap))


def next_start(end: int, overlap: int) -> int:
    """Where the piece after one with this end starts."""
    return end - overlap


def inside_word(before: str, after: str) -> bool:
    """Whether a cut between two characters breaks a word."""
    return before.isalnum() and after.isalnum()


def breaks_word(stretch: str, after: str) -> bool:
    """Whether a piece ends inside a word although its second half has a blank. `after` is the character behind it."""
    return bool(stretch) and inside_word(stretch[-1], after) and any(ch.isspace() for ch in stretch[len(stretch) // 2:])


def boundary_faults(text: str, start: int, end: int) -> bool:
    return 0 < end < len(text) and breaks_word(text[start:end], text[end])


def strengths(text: str) -> np.ndarray:
    """Strength of the boundary at every position of a text, its end included."""
    words = np.fromiter((ch.isalnum() for ch in text), bool, len(text))
    out = np.ones(len(text) + 1, np.int8)
    out[1:-1] = np.where(words[:-1] & words[1:], 0, 1)
    for strength, pattern in BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text)]
        out[ends] = strength
    return out


def places(strength: np.ndarray, limit: int) -> np.ndarray:
    """Where a piece may end: between words, and inside of a stretch without blanks once its beginning is half a limit behind.

    No cut at one of these places breaks a word that could be spared.
    """
    n = len(strength) - 1
    known = np.flatnonzero(strength >= BETWEEN)
    known = known[(known > 0) & (known < n)]
    edges = np.concatenate([[0], known, [n]])
    far = np.flatnonzero(np.diff(edges) > limit // 2)
    extra = [np.arange(edges[i] + limit // 2 + 1, edges[i + 1]) for i in far]
    return np.unique(np.concatenate([edges, *extra]))


def split(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the pieces."""
    if overlap < 0 or 2 * overlap >= limit:
        raise ValueError("the overlap must be smaller than half the limit")
    n, step = len(text), limit - overlap
    if n <= limit:
        return [(0, n)]
    strength = strengths(text)
    at = places(strength, limit)
    # The furthest place that a piece can end at, from every place. A piece begins `overlap` before the end of the last one.
    reach = np.searchsorted(at, np.minimum(at + step, n), side="right") - 1
    count, i = 1, int(np.searchsorted(at, limit, side="right")) - 1
    while at[i] < n:
        i, count = max(int(reach[i]), i + 1), count + 1
    count = max(count, least_pieces(n, limit, overlap))
    count += count // SPARE
    # The first place for each cut from which the pieces to come can hold the rest.
    first, low = [n], n
    for _ in range(count - 1):
        low = int(at[np.searchsorted(at, low - step, side="left")])
        first.append(low)
    first.reverse()  # first[i]: the least end of piece i
    out, end = [], overlap
    for i in range(count):
        start = next_start(end, overlap)
        if n - start <= limit and (i >= count - 1 or n - end <= 1):
            break
        target = overlap + (i + 1) * (n - overlap) / count
        lo, hi = max(first[i], end + 1), min(end + step, n - 1)
        a, b = np.searchsorted(at, lo, side="left"), np.searchsorted(at, hi, side="right")
        if a >= b:  # the rest is shorter than planned
            break
        near = max(16, step // 4)
        c, d = np.searchsorted(at, target - near, side="left"), np.searchsorted(at, target + near, side="right")
        if max(a, c) < min(b, d):
            a, b = max(a, c), min(b, d)
        found = at[a:b]
        end = int(found[np.lexsort((np.abs(found - target), -strength[found].astype(int)))[0]])
        out.append((start, end))
    start = next_start(end, overlap)
    while n - start > limit:  # only where a stretch had fewer places than planned
        i = int(np.searchsorted(at, start + limit, side="right")) - 1
        end = int(at[i]) if at[i] > end else start + limit
        out.append((start, end))
        start = next_start(end, overlap)
    return [*out, (start, n)]


def pieces(df: DataFrame, id_cols: list[str], text_col: str, limit_col: str, overlap_col: str) -> DataFrame:
    """id_cols, piece, start_idx, end_idx, content: the pieces of every text above its limit."""
    over = df.where(F.length(F.col(text_col)) > F.col(limit_col)).select(
        *id_cols, F.col(text_col).alias("_text"), F.col(limit_col).alias("_limit"), F.col(overlap_col).alias("_overlap"))

    @F.pandas_udf("array<struct<piece:int,start_idx:int,end_idx:int,content:string>>")
    def cut(texts: pd.Series, limits: pd.Series, overlaps: pd.Series) -> pd.Series:
        return pd.Series([
            [{"piece": k, "start_idx": a, "end_idx": b, "content": t[a:b]} for k, (a, b) in enumerate(split(t, int(n), int(o)))]
            for t, n, o in zip(texts, limits, overlaps)])

    return over.select(*id_cols, F.explode(cut("_text", "_limit", "_overlap")).alias("_p")).select(*id_cols, "_p.*")


def faults(content: str | None, stretch: str | None, start: int | None, end: int | None, after_first: bool, before_end: int | None,
           limit: int | None, overlap: int | None) -> list[str]:
    """What the splitter would do otherwise with a stored piece. `stretch` is the document from its start to one behind its end."""
    out = []
    if content is not None and limit is not None and len(content) > limit and len(split(content, limit, overlap or 0)) > 1:
        out.append("oversize")
    own = None
    if stretch is not None and start is not None and end is not None:
        own = stretch[:max(end - start, 0)]
    if own is None or content is None or own != content or len(own) != end - start:
        out.append("content")
    if after_first and overlap is not None and before_end is not None and start is not None and start != next_start(before_end, overlap):
        out.append("overlap")
    if own and end > 0 and len(stretch) > len(own) and breaks_word(own, stretch[len(own)]):
        out.append("midword")
    return out


def audit(chunks: DataFrame, documents: DataFrame, specs: DataFrame) -> DataFrame:
    """(chunk_id, fault): stored pieces that the splitter would not make.

    Each stored piece goes through the splitter's own functions: it is `oversize` if `split` makes more than one piece
    of its content, `content` if it isn't the document's text between its positions, `overlap` if it doesn't start at
    the `next_start` of the piece before it, and `midword` if its end `breaks_word`. A chunk_id counts once; pieces of
    unknown documents or with null content are only `content`; chunks of an unknown strategy have no limit and no
    overlap to break.
    """
    known = chunks.select("chunk_id", "document_id", "strategy", "sequence_num", "start_idx", "end_idx", "content").dropDuplicates(["chunk_id"])
    known = known.join(F.broadcast(specs.select("strategy", "size_limit", F.col("overlap").alias("shared"))), "strategy", "left")  # a fixed table
    before = known.select("document_id", "strategy", (F.col("sequence_num") + 1).alias("sequence_num"), F.col("end_idx").alias("before_end"))
    before = before.groupBy("document_id", "strategy", "sequence_num").agg(F.max("before_end").alias("before_end"))
    linked = known.join(before, ["document_id", "strategy", "sequence_num"], "left")
    texts = documents.select("document_id", F.col("content").alias("text")).where(F.col("document_id").isNotNull())
    joined = salted_join(linked, texts, "document_id", F.xxhash64("chunk_id"))
    stretch = F.substring(F.col("text"), F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx") + 1)

    @F.pandas_udf("array<string>")
    def judge(content: pd.Series, stretch: pd.Series, start: pd.Series, end: pd.Series, number: pd.Series, before_end: pd.Series,
              limit: pd.Series, overlap: pd.Series) -> pd.Series:
        whole = lambda x: None if pd.isna(x) else int(x)
        return pd.Series([faults(c, s, whole(a), whole(b), not pd.isna(k) and k > 0, whole(e), whole(m), whole(o))
                          for c, s, a, b, k, e, m, o in zip(content, stretch, start, end, number, before_end, limit, overlap)])

    found = judge("content", stretch, "start_idx", "end_idx", "sequence_num", "before_end", "size_limit", "shared")
    return joined.select("chunk_id", F.explode(found).alias("fault"))
