"""Pairing the lines of a document and of its translation that share a statement.

Lines are bags of weighted words. A first pass pairs lines by numbers and dictionary terms only; the word pairs of
these certain lines give a translation table, counted over all documents. The second pass translates each line into a
weighted bag of the other language, retrieves lines in both directions through inverted indexes, keeps matches that
are best both ways, and grows them: what a line says beyond its match is compared with what the neighbours of the
match say beyond theirs, until nothing is added.

Defined results: blank lines share nothing; null or empty contents and translations without an original give no
rows; numbers are equal as numbers (1,000 and 1000), nearly equal when one is the other rounded; a document_id
counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.operators.durable import durable
from ragloom.operators.skew import salted_join

#: Translations kept for a word, the least association and count of a pair.
KEPT, LEAST_DICE, LEAST_COUNT = 8, 0.08, 2
#: Coverage from which a line (or its rest) counts as said by the other, and what the other side must cover at least.
COVERED, OTHER_SIDE = 0.7, 0.2
#: A table of up to this many rows is sent to all tasks; a larger one is joined by word.
SENT_ROWS = 200_000
NUMBER_WEIGHT, UNKNOWN_WEIGHT = 5.0, 3.0

_TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?|[^\W\d_]+")


def words(line: str, language: str | None) -> tuple[list[str], list[float]]:
    """Word features and numbers of a line."""
    out, numbers = [], []
    found = list(_TOKEN.finditer(line))
    for at, m in enumerate(found):
        token = m.group()
        if token[0].isdigit():
            follows = line[m.end():m.end() + 1]
            if follows == "월":
                out.append(token + "월")  # a month is a word
            else:
                numbers.append(float(token.replace(",", "")))
        elif "가" <= token[0] <= "힣":
            if token[0] == "월" and at and found[at - 1].end() == m.start():
                token = token[1:]
                if not token:
                    continue
            out.append(token[:3] if len(token) >= 4 else token[:2])
        else:
            out.append(token.lower())
    return out, numbers


def lines_of(text: str) -> list[tuple[int, str]]:
    return [(n, s) for n, line in enumerate(text.split("\n")) if (s := line.replace("\r", "").strip())]


def close(a: float, b: float) -> float:
    """1 for equal numbers, 0.8 where one is the other rounded or cut to a whole number, else 0."""
    if a == b:
        return 1.0
    low, high = sorted((a, b), key=lambda x: x == int(x))
    return 0.8 if low != int(low) and high == int(high) and abs(low) > 1 and abs(low - high) < 1 else 0.0


class Side:
    """The lines of one document with their words and numbers, and what is not yet explained of them."""

    def __init__(self, text: str, language: str | None, weight: Callable[[str], float]) -> None:
        self.full, self.rest, self.total, self.line = [], [], [], []
        for number, line in lines_of(text):
            tokens, numbers = words(line, language)
            bag: dict = {("w", t): weight(t) for t in tokens}
            bag.update({("n", x): NUMBER_WEIGHT for x in numbers})
            self.line.append(number)
            self.full.append(bag)
            self.rest.append(bag)
            self.total.append(sum(bag.values()))


def cover(bag: dict, by: dict, links: dict[str, dict[str, float]]) -> dict:
    """How much of each feature of `bag` is said by the features of `by`: 0 to 1. `links` has the strongest first."""
    out = {}
    numbers = [x for kind, x in by if kind == "n"]
    for key in bag:
        kind, x = key
        if kind == "n":
            out[key] = max([close(x, y) for y in numbers], default=0.0)
        elif key in by:
            out[key] = 1.0
        else:
            out[key] = next((dice for y, dice in links.get(x, {}).items() if ("w", y) in by), 0.0)
    return out


def share(bag: dict, covered: dict) -> float:
    total = sum(bag.values())
    return sum(w * min(1.0, 1.25 * covered[k]) for k, w in bag.items()) / total if total else 0.0


class Pair:
    """Alignment of one document with one translation."""

    def __init__(self, left: Side, right: Side, table: dict[str, dict[str, float]], back: dict[str, dict[str, float]]) -> None:
        self.left, self.right = left, right
        self.table, self.back = table, back
        self.pairs: set[tuple[int, int]] = set()

    def score(self, i: int, j: int) -> tuple[float, float]:
        """Coverage of the rest of left line i by right line j, and of the rest of right line j by left line i."""
        a, b = self.left.rest[i], self.right.rest[j]
        return share(a, cover(a, self.right.full[j], self.table)), share(b, cover(b, self.left.full[i], self.back))

    def candidates(self) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
        """For both directions, each through its own inverted index, all lines that share a translated word or a number."""
        return self.retrieve(self.left, self.right, self.table), self.retrieve(self.right, self.left, self.back)

    def retrieve(self, side: Side, other: Side, links: dict[str, dict[str, float]]) -> dict[int, set[int]]:
        index: dict = defaultdict(set)
        for j, bag in enumerate(other.rest):
            for kind, x in bag if self.has_rest(other, j) else ():
                index[(kind, int(x)) if kind == "n" else (kind, x)].add(j)
        found: dict[int, set[int]] = defaultdict(set)
        for i, bag in enumerate(side.rest):
            for kind, x in bag if self.has_rest(side, i) else ():
                for near in (int(x) - 1, int(x), int(x) + 1) if kind == "n" else (x, *links.get(x, ())):
                    found[i] |= index.get((kind, near), set())
        return found

    def take(self, i: int, j: int) -> None:
        self.pairs.add((i, j))
        a, b = self.left.rest[i], self.right.rest[j]
        ca, cb = cover(a, self.right.full[j], self.table), cover(b, self.left.full[i], self.back)
        self.left.rest[i] = {k: w for k, w in a.items() if ca[k] < 0.3}
        self.right.rest[j] = {k: w for k, w in b.items() if cb[k] < 0.3}

    def has_rest(self, side: Side, i: int) -> bool:
        return sum(side.rest[i].values()) >= 0.25 * side.total[i] and len(side.rest[i]) >= 2

    def accepts(self, i: int, j: int) -> bool:
        if (i, j) in self.pairs or not (self.has_rest(self.left, i) and self.has_rest(self.right, j)):
            return False
        a, b = self.score(i, j)
        return max(a, b) >= COVERED and min(a, b) >= OTHER_SIDE

    def best_both_ways(self) -> bool:
        to_right, to_left = self.candidates()
        both = {(i, j) for i, js in to_right.items() for j in js} | {(i, j) for j, is_ in to_left.items() for i in is_}
        scores = {(i, j): math.sqrt(a * b) for i, j in both for a, b in (self.score(i, j),)}
        right = {i: max(js, key=lambda j: (scores[i, j], -j)) for i, js in to_right.items() if js}
        left = {j: max(is_, key=lambda i: (scores[i, j], -i)) for j, is_ in to_left.items() if is_}
        new = [(i, j) for i, j in right.items() if left.get(j) == i and self.accepts(i, j)]
        for i, j in new:
            self.take(i, j)
        return bool(new)

    def grow(self) -> bool:
        """Merges with the neighbours of a match, on either side, judged by what is left of both lines."""
        found = False
        todo = sorted(self.pairs)
        while todo:
            i, j = todo.pop(0)
            near = [(i, j + d) for d in (-1, 1) if 0 <= j + d < len(self.right.rest)]
            near += [(i + d, j) for d in (-1, 1) if 0 <= i + d < len(self.left.rest)]
            for a, b in near:
                if self.accepts(a, b):
                    self.take(a, b)
                    todo.append((a, b))
                    found = True
        return found

    def align(self) -> list[tuple[int, int]]:
        while self.best_both_ways() | self.grow():
            pass
        return sorted((self.left.line[i], self.right.line[j]) for i, j in self.pairs)


def seed_pairs(left: str, right: str, terms: list[tuple[re.Pattern, re.Pattern]], swapped: bool) -> list[tuple[str, str]]:
    """Line pairs that are certain by numbers and dictionary terms: best both ways, with a clear lead."""
    def marks(line: str, side: int) -> set:
        _, numbers = words(line, None)
        return {("n", x) for x in numbers} | {("t", k) for k, term in enumerate(terms) if term[side].search(line)}

    a = [(s, marks(s, 1 if swapped else 0)) for _, s in lines_of(left)]
    b = [(s, marks(s, 0 if swapped else 1)) for _, s in lines_of(right)]
    index: dict = defaultdict(list)
    for j, (_, y) in enumerate(b):
        for k in y:
            index[k].append(j)
    shared: dict[tuple[int, int], float] = defaultdict(float)
    for i, (_, x) in enumerate(a):
        for k in x:
            for j in index.get(k, ()):
                shared[i, j] += 2.0 if k[0] == "n" else 1.0
    value = {(i, j): v / max(1.0, math.sqrt(len(a[i][1]) * len(b[j][1]))) for (i, j), v in shared.items()}
    by_left, by_right = defaultdict(list), defaultdict(list)
    for (i, j), v in value.items():
        by_left[i].append((v, j))
        by_right[j].append((v, i))
    out = []
    for i, found in by_left.items():
        found.sort(key=lambda x: (-x[0], x[1]))
        v, j = found[0]
        back = sorted(by_right[j], key=lambda x: (-x[0], x[1]))
        lead = all(len(x) < 2 or x[0][0] >= 1.3 * x[1][0] for x in (found, back))
        if back[0][1] == i and lead and v >= 0.6 and len(a[i][1] & b[j][1]) >= min(2, len(a[i][1]), len(b[j][1])):
            out.append((a[i][0], b[j][0]))
    return out


def _learn(terms: list[tuple[str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [(re.compile(re.escape(en), re.I), re.compile(re.escape(kr))) for en, kr in terms]
        pairs: Counter = Counter()
        for batch in batches:
            for left, right, language in zip(batch["left_text"], batch["right_text"], batch["left_lang"]):
                for x, y in seed_pairs(left, right, known, swapped=language in ("kr", "ko")):
                    a, b = set(words(x, None)[0]), set(words(y, None)[0])
                    pairs.update(("a", s, "") for s in a)
                    pairs.update(("b", t, "") for t in b)
                    pairs.update(("p", s, t) for s in a for t in b)
        yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["kind", "s", "t", "n"])

    return run


def translation_table(pairs: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """(s, t, dice, weight_s, weight_t): the learned table, over all documents.

    `terms` is the fixed dictionary. Weights are logarithms of how seldom a word is among the counted lines.
    """
    counts = pairs.mapInPandas(_learn(terms), "kind string, s string, t string, n bigint").groupBy("kind", "s", "t").agg(F.sum("n").alias("n"))
    counts = durable(counts)
    a = counts.where("kind = 'a'").select("s", F.col("n").alias("n_s"))
    b = counts.where("kind = 'b'").select(F.col("s").alias("t"), F.col("n").alias("n_t"))
    both = counts.where((F.col("kind") == "p") & (F.col("n") >= LEAST_COUNT)).select("s", "t", F.col("n").alias("n_st"))
    dice = 2 * F.col("n_st") / (F.col("n_s") + F.col("n_t") + 1)
    top = counts.where("kind = 'a'").agg(F.max("n").alias("most"))
    joined = both.join(a, "s").join(b, "t").withColumn("dice", dice).where(F.col("dice") >= LEAST_DICE)
    ranked = joined.withColumn("nth", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("dice"), "t")))
    weight = lambda n: F.least(F.lit(5.0), F.greatest(F.lit(0.3), F.log(F.lit(1.5) * F.col("most") / F.col(n))))
    return ranked.where(F.col("nth") <= KEPT).crossJoin(F.broadcast(top)).select(
        "s", "t", "dice", weight("n_s").alias("weight_s"), weight("n_t").alias("weight_t"))


def tables_of(rows) -> tuple[dict, dict, dict, dict]:
    """Links of words, the links back, and the weights of left and of right words, from (s, t, dice, weight_s, weight_t)."""
    links: dict[str, dict[str, float]] = defaultdict(dict)
    left: dict[str, float] = {}
    right: dict[str, float] = {}
    for s, t, dice, ws, wt in rows:
        links[s][t] = dice
        left[s], right[t] = ws, wt
    links = {s: strongest_first(to) for s, to in links.items()}
    return links, reverse(links), left, right


def own_tables(words_found) -> tuple[dict, dict, dict, dict]:
    """The same from the words of one pair of documents: (word, to, weight_s, weight_t)."""
    links = {r["word"]: strongest_first({x["t"]: x["dice"] for x in r["to"]}) for r in words_found if r["to"] is not None}
    return (links, reverse(links), {r["word"]: r["weight_s"] for r in words_found if r["weight_s"] is not None},
            {r["word"]: r["weight_t"] for r in words_found if r["weight_t"] is not None})


def reverse(table: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for s, to in table.items():
        for t, dice in to.items():
            out.setdefault(t, {})[s] = dice
    return {t: strongest_first(to) for t, to in out.items()}


def strongest_first(to: dict[str, float]) -> dict[str, float]:
    return dict(sorted(to.items(), key=lambda x: (-x[1], x[0])))


def _align(left, right, left_lang, right_lang, table, back, left_weight, right_weight) -> list[tuple[int, int]]:
    """A word has the weight of its side, that of the other side where it has none, else UNKNOWN_WEIGHT."""
    of_left = lambda w: left_weight.get(w, right_weight.get(w, UNKNOWN_WEIGHT))
    of_right = lambda w: right_weight.get(w, left_weight.get(w, UNKNOWN_WEIGHT))
    return Pair(Side(left, left_lang, of_left), Side(right, right_lang, of_right), table, back).align()


_FOUND = "array<struct<line_num:int,translation_line_num:int>>"


def _as_structs(found: list[tuple[int, int]]) -> list[dict]:
    return [{"line_num": i, "translation_line_num": j} for i, j in found]


def align(pairs: DataFrame, terms: list[tuple[str, str]], sent_rows: int = SENT_ROWS) -> DataFrame:
    """(left_id, right_id, line_num, translation_line_num) of pairs (left_id, right_id, texts, languages).

    The table is learned with the language of the dictionary's first column on the one side, so every pair is turned
    that way round first and back at the end.
    """
    pairs = durable(pairs)
    table = durable(translation_table(pairs, terms))
    if table.count() <= sent_rows:
        shared = pairs.sparkSession.sparkContext.broadcast(tables_of(tuple(r) for r in table.collect()))

        @F.pandas_udf(_FOUND)
        def run(left: pd.Series, right: pd.Series, left_lang: pd.Series, right_lang: pd.Series) -> pd.Series:
            return pd.Series([_as_structs(_align(a, b, x, y, *shared.value)) for a, b, x, y in zip(left, right, left_lang, right_lang)])

        found = pairs.select("left_id", "right_id", F.explode(run("left_text", "right_text", "left_lang", "right_lang")).alias("p"))
    else:
        @F.pandas_udf("array<string>")
        def vocabulary(left: pd.Series, right: pd.Series) -> pd.Series:
            return pd.Series([sorted({w for _, line in lines_of(a) + lines_of(b) for w in words(line, None)[0]}) for a, b in zip(left, right)])

        linked = table.groupBy(F.col("s").alias("word")).agg(
            F.collect_list(F.struct("t", "dice")).alias("to"), F.max("weight_s").alias("weight_s"))  # at most KEPT
        heard = table.groupBy(F.col("t").alias("word")).agg(F.max("weight_t").alias("weight_t"))
        used = pairs.select("left_id", "right_id", F.explode(vocabulary("left_text", "right_text")).alias("word"))
        own = salted_join(used, linked.join(heard, "word", "full"), "word", F.xxhash64("right_id"), "inner").groupBy("left_id", "right_id").agg(
            F.collect_list(F.struct("word", "to", "weight_s", "weight_t")).alias("rows"))

        @F.pandas_udf(_FOUND)
        def run_own(left: pd.Series, right: pd.Series, left_lang: pd.Series, right_lang: pd.Series, rows: pd.Series) -> pd.Series:
            return pd.Series([_as_structs(_align(a, b, x, y, *own_tables(own_rows if own_rows is not None else [])))
                              for a, b, x, y, own_rows in zip(left, right, left_lang, right_lang, rows)])

        found = pairs.join(own, ["left_id", "right_id"], "left").select(
            "left_id", "right_id", F.explode(run_own("left_text", "right_text", "left_lang", "right_lang", "rows")).alias("p"))
    return found.select("left_id", "right_id", "p.*")


def document_pairs(docs: DataFrame) -> DataFrame:
    """Originals with their translations; the English side is left where one is English."""
    text = docs.select("document_id", "content", "language", "original_id").where(
        F.col("document_id").isNotNull() & (F.length("content") > 0)).dropDuplicates(["document_id"])
    originals = text.where("original_id is null").select(
        F.col("document_id").alias("original_id"), F.col("content").alias("o_text"), F.col("language").alias("o_lang"))
    translations = text.where("original_id is not null").select(
        "original_id", F.col("document_id").alias("t_id"), F.col("content").alias("t_text"), F.col("language").alias("t_lang"))
    joined = salted_join(translations, originals, "original_id", F.xxhash64("t_id"), "inner")
    turned = F.coalesce(F.col("t_lang") == "en", F.lit(False)) & F.coalesce(F.col("o_lang") != "en", F.lit(True))
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return joined.select(
        pick("original_id", "t_id").alias("left_id"), pick("t_id", "original_id").alias("right_id"),
        pick("o_text", "t_text").alias("left_text"), pick("t_text", "o_text").alias("right_text"),
        pick("o_lang", "t_lang").alias("left_lang"), pick("t_lang", "o_lang").alias("right_lang"),
        turned.alias("turned"))


def aligned_lines(docs: DataFrame, lexicon: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(document_id, line_num, translation_id, translation_line_num). `lexicon` is a small fixed table of term pairs."""
    terms = [(r["term_en"], r["term_kr"]) for r in lexicon.where("term_en is not null and term_kr is not null").collect()]
    pairs = durable(document_pairs(docs))
    both = align(pairs.drop("turned"), terms, sent_rows)
    back = both.join(pairs.select("left_id", "right_id", "turned"), ["left_id", "right_id"])
    pick = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    return back.select(
        pick("left_id", "right_id").alias("document_id"), pick("line_num", "translation_line_num").alias("line_num"),
        pick("right_id", "left_id").alias("translation_id"), pick("translation_line_num", "line_num").alias("translation_line_num"))
