"""Sentence units by cascading segmentation rules.

Every position of a text is decided by the first rule of its language's table that matches there; a position that no
rule matches is no boundary. Units are the stretches between boundaries without the blanks around them.

Defined results: null, empty and blank texts have no units; a text in an unknown language is cut by the table of its
main script; a mark that is never closed protects nothing. Positions are code points, end exclusive.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.sentence_rules import TABLES, Rule

_SCRIPTS = (("kr", "가", "힣"), ("ja", "぀", "ヿ"), ("th", "฀", "๿"), ("hi", "ऀ", "ॿ"), ("zh", "一", "鿿"))
_BLANK_LINE = regex.compile(r"\n[^\S\n]*\r?\n")


class Table:
    """One compiled cascade."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = []
        for order, rule in enumerate(rules):
            if rule.span:
                self.rules.append((order, "span", (rule.before, rule.after)))
            elif rule.breaks:
                self.rules.append((order, "yes", regex.compile(f"(?:{rule.before})(?={rule.after})")))
            else:
                behind = f"(?<={rule.before})" if rule.before else ""
                self.rules.append((order, "no", regex.compile(f"{behind}(?={rule.after})")))
        self.exceptions = [(order, what) for order, kind, what in self.rules if kind == "no"]

    def boundaries(self, text: str) -> list[int]:
        first: dict[int, int] = {}  # position -> order of the first break rule that matches there
        spans: list[tuple[int, int, int]] = []
        for order, kind, what in self.rules:
            if kind == "yes":
                for m in what.finditer(text):
                    first.setdefault(m.end(), order)
            elif kind == "span":
                spans += [(a, b, order) for a, b in closed_spans(text, *what)]
        spans.sort()
        out, open_spans, at = [], [], 0
        for pos in sorted(first):
            order = first[pos]
            while at < len(spans) and spans[at][0] < pos:
                open_spans.append(spans[at])
                at += 1
            open_spans = [s for s in open_spans if s[1] > pos]
            if any(s[2] < order for s in open_spans):
                continue
            if any(o < order and what.match(text, pos) for o, what in self.exceptions):
                continue
            out.append(pos)
        return out


def closed_spans(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches between a mark and the next closing one of its kind in the same paragraph."""
    out, start, at = [], -1, 0
    if opening not in text or closing not in text:
        return out
    same = opening == closing
    limits = [m.start() for m in _BLANK_LINE.finditer(text)]
    limit = 0
    for m in regex.finditer(f"[{regex.escape(opening + closing)}]", text):
        at, ch = m.start(), m.group()
        while limit < len(limits) and limits[limit] < at:
            limit, start = limit + 1, -1  # a blank line ends whatever is open
        after = text[at + 1:at + 2]
        if same:
            before = text[at - 1:at]
            if start >= 0 and before and not before.isspace():
                out.append((start, at + 1))
                start = -1
            elif (not before or not before.isalnum() or ord(before) > 0x2E7F) and after and not after.isspace():
                start = at
        elif ch == opening:
            start = at
        elif start >= 0:
            out.append((start, at + 1))
            start = -1
    return out


@lru_cache(maxsize=None)
def _table(language: str) -> Table:
    return Table(TABLES[language])


def main_script(text: str) -> str:
    counts: Counter = Counter()
    for ch in text:
        if ch > "ࣿ":
            for name, low, high in _SCRIPTS:
                if low <= ch <= high:
                    counts[name] += 3 if name == "ja" else 1
                    break
        elif ch.isalpha():
            counts["en"] += 1
    return counts.most_common(1)[0][0] if counts else "en"


def units(text: str | None, language: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text."""
    if not text or text.isspace():
        return []
    cuts = _table(language if language in TABLES else main_script(text)).boundaries(text)
    out, start = [], 0
    for end in [*cuts, len(text)]:
        piece = text[start:end]
        left = len(piece) - len(piece.lstrip())
        body = piece.strip()
        if body:
            out.append((start + left, start + left + len(body)))
        start = end
    return out


def sentence_units(df: DataFrame, id_col: str, text_col: str, language_col: str) -> DataFrame:
    """(id, start_idx, end_idx): one row a unit."""
    @F.pandas_udf("array<struct<start_idx:int,end_idx:int>>")
    def cut(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[{"start_idx": a, "end_idx": b} for a, b in units(t, lang)] for t, lang in zip(texts, languages)])

    return df.where(F.length(F.col(text_col)) > 0).select(
        F.col(id_col).alias("id"), F.explode(cut(F.col(text_col), F.col(language_col))).alias("u")).select("id", "u.*")
