"""One consistent form for texts that look the same.

Look-alike pairs of strings are merged into classes by union-find, each class gets its most frequent member in the
corpus as representative, and texts are rewritten greedily (longest match first) with an Aho-Corasick automaton.
Rewriting works on canonically decomposed text and ends with canonical composition.

Defined results: a null text has a null form; characters that show nothing are removed, so a text of only such
characters has an empty form; superscripts, circled signs and other forms that differ to the eye are kept.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.durable import durable
from ragloom.operators.skew import HOT_ROWS, SALTS, salted_join

# Letters of other scripts (Greek, Cyrillic, Armenian, Cherokee) and Latin variants drawn like a Latin letter.
SAME_SHAPES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "ԼᏞ", "M": "МΜᎷ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ᏙѴ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "k": "κ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
}
# Marks drawn alike.
SAME_MARKS = {"-": "\u2010\u2011"}
# Invisible characters besides those of the format category.
INVISIBLE = "\u034f\u115f\u1160\u3164"


def look_alike_pairs() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same. Width and ligature forms follow from the Unicode character data."""
    for latin, others in {**SAME_SHAPES, **SAME_MARKS}.items():
        for other in others:
            yield latin, other
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Zs" and ch != " ":
            yield " ", ch
        elif kind == "Cf" and unicodedata.bidirectional(ch) not in ("AN", "AL") and code < 0x11000 or 0xFE00 <= code <= 0xFE0F or ch in INVISIBLE:
            yield "", ch
        else:
            form = unicodedata.decomposition(ch)
            # Width forms, ligatures, Roman numerals, and letters in the styles of mathematics.
            if form.startswith(("<wide>", "<narrow>", "<font>")) or 0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F:
                yield unicodedata.normalize("NFKD", ch), ch


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def classes(pairs: Iterable[tuple[str, str]] | None = None) -> list[list[str]]:
    known = Classes()
    for a, b in look_alike_pairs() if pairs is None else pairs:
        known.union(a, b)
    return known.groups()


def member_counts(df: DataFrame, text_col: str, groups: list[list[str]]) -> dict[str, int]:
    """How often each class member occurs in all texts; the result is bounded by the classes."""
    members = {m for g in groups for m in g if len(m) == 1}
    strings = sorted({m for g in groups for m in g if len(m) > 1})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch[text_col].dropna():
                text = unicodedata.normalize("NFD", text)
                found.update(text)
                for m in strings:
                    if (n := text.count(m)):
                        found[m] += n
        kept = [(k, v) for k, v in found.items() if k in members or len(k) > 1]
        yield pd.DataFrame({"member": [k for k, _ in kept], "n": [v for _, v in kept]}).astype({"member": "object", "n": "int64"})

    rows = (df.select(text_col).mapInPandas(count, "member string, n bigint")
            .groupBy("member").agg(F.sum("n").alias("n")).collect())
    return {r["member"]: r["n"] for r in rows}


def rewrites(groups: list[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """member -> representative: the most frequent member, then the shortest and smallest; nothing for the invisible."""
    out: dict[str, str] = {}
    for group in groups:
        if "" in group:
            best = ""
        else:
            best = min(group, key=lambda m: (-counts.get(m, 0), not m.isascii(), len(m), m))
        out.update({m: best for m in group if m != best})
    return out


class Rewriter:
    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for member, best in table.items():
            self.automaton.add_word(member, (len(member), best))
        self.automaton.make_automaton()
        self.ascii = any(m.isascii() for m in table)

    def __call__(self, text: str) -> str:
        if text.isascii() and not self.ascii:
            return text
        text = unicodedata.normalize("NFD", text)
        parts, at = [], 0
        for end, (length, best) in self.automaton.iter_long(text):
            parts.append(text[at:end + 1 - length])
            parts.append(best)
            at = end + 1
        parts.append(text[at:])
        return unicodedata.normalize("NFC", "".join(parts))


def learned_rewrites(df: DataFrame, text_col: str) -> dict[str, str]:
    groups = classes()
    return rewrites(groups, member_counts(df, text_col, groups))


def consistent_form(df: DataFrame, text_col: str, out_col: str, table: dict[str, str]) -> DataFrame:
    """df with the consistent form of `text_col` in `out_col`."""
    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(table)  # one automaton a task
        for texts in batches:
            yield texts.map(lambda t: rewriter(t) if isinstance(t, str) else None)

    return df.withColumn(out_col, rewrite(F.col(text_col)))


def form_keys(df: DataFrame, id_col: str, text_col: str, table: dict[str, str]) -> DataFrame:
    """(id, form, text): 128-bit keys of the consistent form and of the text itself."""
    @F.pandas_udf("binary")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(table)  # one automaton a task
        for texts in batches:
            yield texts.map(lambda t: hashlib.blake2b(rewriter(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() if isinstance(t, str) else None)

    return df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), key(F.col(text_col)).alias("form"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text"))


def look_alike_pairs_of(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_a, id_b), a < b: rows whose texts have one consistent form but differ in characters.

    Only forms with at least two different texts are joined, and copies of one text are not paired with each other. The
    rows of a form with very many are spread over salts on one side and repeated for each salt on the other.
    """
    keys = durable(form_keys(df, id_col, text_col, learned_rewrites(df, text_col)))
    mixed = keys.groupBy("form").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select(
        "form", (F.col("n") >= hot_rows).alias("hot"))
    found = durable(salted_join(keys, mixed, "form", F.xxhash64("id"), "inner"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.array(*[F.lit(i) for i in range(SALTS)])).otherwise(F.array(F.lit(0)))
    a, b = found.withColumn("salt", salt).alias("a"), found.withColumn("salt", F.explode(salts)).alias("b")
    same = (F.col("a.form") == F.col("b.form")) & (F.col("a.salt") == F.col("b.salt"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.text") != F.col("b.text"))).select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: (id, class_id, class_rows, class_texts), class_id the smallest id of the class."""
    keys = durable(form_keys(df, id_col, text_col, learned_rewrites(df, text_col)))
    by_text = keys.groupBy("form", "text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    per_form = by_text.groupBy("form").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    return salted_join(keys.select("id", "form"), per_form, "form", F.xxhash64("id"), "inner").drop("form")
