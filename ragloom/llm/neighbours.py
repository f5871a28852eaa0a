"""The k most similar vectors of every vector, by multiprobe cross-polytope hashing.

A hash turns a vector by a random rotation and takes the largest part with its sign as its cell; near vectors share it
far more often than cells of p-stable functions of the same size. In each of a few tables every vector is sent to the
group of its own cells. From its distances to the borders follows the chance that a vector at distance REACH lies in
those groups; while the chance of all tables together is below TARGET, it is sent to its next likeliest groups too. The
number of cells grows with the rows, so that groups and the work a vector stay about the same. A group with too many rows is
divided by further hashes. A group that is too large under all of them is split into blocks and every two blocks meet, so all its
rows meet and no task ever holds a group that grows with the data.

A vector is compared with all of its groups and the lists of the groups are merged. Every vector has a reach, the
distance at which its chance is still TARGET. Where the k-th found is farther away, as for vectors without near
neighbours or in a wide cluster that the hashes cut, the vector is compared with all others.

Similarity is the cosine; vectors travel as 16-bit parts of their largest component, an error below 0.00001. Defined
results: null vectors, vectors of length zero and vectors with a part that isn't finite, or of another length than most,
have no neighbours and are nobody's; an id counts once, with any one of its rows; equal similarities are ordered by id;
fewer than k other vectors give fewer neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.operators import retrieval
from ragloom.operators.durable import durable


@dataclass(frozen=True)
class Settings:
    k: int = 5
    tables: int = 5
    group_rows: int = 32_768
    #: No more than this many groups of a table and level can be larger than the group size that is used.
    most_hot: int = 20_000
    seed: int = 11


#: Chance of meeting a neighbour from which a vector is done, and the distance up to which groups are chosen for it.
TARGET, REACH = 0.9, 0.4
#: Up to this many ids of doubtful vectors are sent to all tasks.
SENT_IDS = 200_000
#: Most parts that a hash chooses from, and the parts of the hashes that divide groups with too many rows; beyond them groups are joined in blocks.
MOST_PARTS, FURTHER = 64, (8,) * 9
#: Likeliest cells of a hash that count as alternatives, parts that count as their rivals, and further groups of a vector.
CELLS, RIVALS, EXTRA = 3, 16, 24
#: Shorter distances for which the reach is determined where REACH isn't reached.
SHORTER = (0.3, 0.2, 0.1, 0.05, 0.02, 0.005)


def parts_for(rows: int, dim: int, group_rows: int) -> list[int]:
    """Parts of the hashes that make groups of half the group size, if vectors are spread and each is in two groups of a table."""
    cells, out = rows * 4 / group_rows, []
    while cells > 1 and dim:
        out.append(min(dim, MOST_PARTS, max(2, int(np.ceil(cells / 2)))))
        cells /= 2 * out[-1]
    return out


def rotations(table: int, dim: int, parts: list[int], s: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Orthonormal directions of each hash of a table and odd multipliers for numbering cells."""
    rng = np.random.default_rng([s.seed, table])
    return ([np.linalg.qr(rng.standard_normal((dim, min(dim, m))))[0].astype(np.float32) for m in parts],
            rng.integers(1, 2**62, len(parts), dtype=np.int64) * 2 + 1)


def unit_rows(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and the vectors with length 1."""
    usable = [i for i, v in enumerate(values) if v is not None and len(v)]
    if not usable:
        return np.zeros(0, int), np.zeros((0, 1), np.float32)
    x = np.array([values.iloc[i] for i in usable], dtype=np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    keep = np.isfinite(length) & (length > 0)
    return np.asarray(usable)[keep], (x[keep] / length[keep, None]).astype(np.float32)


def ranked_cells(x: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cells) and (rows, parts) without sign: the likeliest cells and the largest parts, from the largest on."""
    y = x @ directions
    size = np.abs(y)
    most = min(RIVALS, y.shape[1])
    top = np.argpartition(-size, most - 1, axis=1)[:, :most]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, axis=1), axis=1, kind="stable"), axis=1)
    first = top[:, :CELLS]
    return first * 2 + (np.take_along_axis(y, first, axis=1) > 0), np.take_along_axis(size, top, axis=1)


def cell_chances(parts: np.ndarray, d: float, dim: int) -> np.ndarray:
    """(rows, cells): chance that a vector at distance d lies in each of the likeliest cells.

    Its parts are those of the row with normal errors; the part of the cell is integrated over, the others stay below it.
    """
    keep, spread = 1 - d * d / 2, d * np.sqrt(1 - d * d / 4) / np.sqrt(max(dim - 1, 1))
    nodes, weights = np.polynomial.hermite_e.hermegauss(5)
    scaled = parts * np.float32(keep / spread)
    out = np.zeros((len(parts), min(CELLS, parts.shape[1])), np.float32)
    for a in range(out.shape[1]):
        rivals = np.delete(scaled, a, axis=1)
        for z, w in zip(nodes, weights / weights.sum()):
            out[:, a] += np.float32(w) * normal(scaled[:, a:a + 1] + np.float32(z) - rivals).prod(axis=1)
    return out


def choices(cells: list[int]) -> np.ndarray:
    """(sets, hashes): ranks of the cells of some hashes, the likeliest of all first, then one and two others."""
    sets = [[0] * len(cells)]
    for h, count in enumerate(cells):
        sets += [[rank if i == h else 0 for i in range(len(cells))] for rank in range(1, count)]
        sets += [[1 if i in (g, h) else 0 for i in range(len(cells))] for g in range(h) if min(count, cells[g]) > 1]
    return np.array(sets, np.int64).reshape(len(sets), len(cells))


class Places:
    """Groups of some vectors in every table: for each table, (rows, sets, levels) keys and (rows, sets) whether a vector is sent there."""

    def __init__(self, x: np.ndarray, parts: list[int], deepest: int, s: Settings):
        self.level, self.dim = len(parts), x.shape[1]
        level, parts = self.level, [*parts, *FURTHER]
        self.sets = choices([min(CELLS, self.dim, m) for m in parts[:level]])
        self.parts, self.keys = [], []
        for t in range(s.tables if level else 1):  # at level 0 all meet in one group
            directions, odd = rotations(t, self.dim, parts, s)
            cells, sizes = zip(*(ranked_cells(x, r) for r in directions[:deepest])) if deepest else ((), ())
            key = np.zeros((len(x), len(self.sets)), np.int64)
            keys = [key]
            with np.errstate(over="ignore"):
                for h in range(deepest):
                    own = cells[h][:, self.sets[:, h]] if h < level else cells[h][:, :1]
                    key = key * 31 + (own + 1) * odd[h]
                    key = key ^ (key >> 29)
                    keys.append(key)
            self.parts.append(sizes)
            self.keys.append(np.stack(keys[level:], axis=2))
        self.used = [np.arange(len(self.sets)) == np.zeros((len(x), 1), int) for _ in self.keys]
        if level:
            self._choose()

    def _set_chances(self, t: int, rows, d: float, levels: np.ndarray | None = None) -> np.ndarray:
        out = np.ones((len(self.parts[t][0][rows]), len(self.sets)), np.float32)
        for h in range(self.level if levels is None else int(levels.max(initial=0))):
            p = cell_chances(self.parts[t][h][rows], d, self.dim)
            out *= p[:, self.sets[:, h]] if h < self.level else np.where(levels > h, p[:, :1], 1)
        return out

    def _choose(self) -> None:
        """Further groups, the likeliest first, until the likeliest groups of a vector at distance REACH are among them with chance TARGET.

        That vector is sent to further groups as well, so the chance that they meet is higher.
        """
        each = np.stack([self._set_chances(t, slice(None), REACH) for t in range(len(self.keys))], axis=1)  # (rows, tables, sets)
        met, more = each[:, :, 0].copy(), each[:, :, 1:].reshape(len(each), -1)
        order = np.argsort(-more, axis=1, kind="stable")[:, :EXTRA]
        for i in range(order.shape[1]):
            rows = np.flatnonzero((1 - met).prod(axis=1) > 1 - TARGET)
            t, c = np.divmod(order[rows, i], len(self.sets) - 1)
            met[rows, t] += each[rows, t, c + 1]
            for table in range(len(self.keys)):
                self.used[table][rows[t == table], c[t == table] + 1] = True
        self.met = (1 - met).prod(axis=1) <= 1 - TARGET

    def reach(self, levels: list[np.ndarray]) -> np.ndarray:
        """Distance up to which a vector is met with chance TARGET at the levels of its groups, (rows, sets) for each table."""
        n = len(self.keys[0])
        if not self.level and not levels[0].any():
            return np.full(n, np.inf, np.float32)
        deeper = np.any([(at > self.level).any(axis=1) for at in levels], axis=0)
        known = self.met & ~deeper if self.level else np.zeros(n, bool)
        out, todo = np.where(known, REACH, 0).astype(np.float32), np.flatnonzero(~known)
        for d in (REACH, *SHORTER):
            missed = np.ones(len(todo), np.float32)
            for t, used in enumerate(self.used):
                missed *= 1 - np.minimum((self._set_chances(t, todo, d, levels[t][todo]) * used[todo]).sum(axis=1), 1)
            done = missed <= 1 - TARGET
            out[todo[done]] = d
            todo = todo[~done]
            if not len(todo):
                break
        return out


def group_keys(keys: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first key that isn't hot, its level, and which rows have none: these keep their last key."""
    out, level = keys[:, -1].copy(), np.full(len(keys), keys.shape[1] - 1, np.int8)
    todo = np.ones(len(keys), bool)
    for j in range(keys.shape[1]):
        still = todo.copy()
        still[todo] = np.isin(keys[todo, j], hot[j])
        done = todo & ~still
        out[done], level[done] = keys[done, j], j
        todo = still
    return out, level, todo


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as a scale and 16-bit parts of it."""
    scale = np.abs(x).max(axis=1, keepdims=True).astype(np.float32)
    parts = np.rint(x / scale * 32767).astype(np.int16)
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, parts)]


def unpack(packed: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    x = np.ascontiguousarray(raw[:, 4:]).view(np.int16).astype(np.float32) * (np.ascontiguousarray(raw[:, :4]).view(np.float32) / np.float32(32767))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def normal(z: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, to about 0.0002."""
    z = np.clip(z, -8, 8)
    return 1 / (1 + np.exp(-z * (1.5976 + 0.070566 * z * z)))


def block_pairs(group: np.ndarray, blocks: np.ndarray, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, group of two blocks): every row in its block together with each other block of its group."""
    own = salt % blocks
    for other in range(blocks.max(initial=0)):
        at = np.flatnonzero((blocks > other) & (own != other))
        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
        with np.errstate(over="ignore"):
            yield at, group[at] + (low * 1_000_003 + high + 1) * 2_654_435_761


def probe_sets(m: int, count: int) -> list[tuple[int, ...]]:
    """Sets of ranks 1..2m of perturbations of m p-stable functions, in the order of their expected score; `nearest` doesn't use them.

    Rank j stands for the j-th nearest bucket border; ranks j and 2m+1-j are the two borders of one function.
    """
    score = [0.0] + [j * (j + 1) / (4.0 * (m + 1) * (m + 2)) if j <= m else
                     1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4.0 * (m + 1) * (m + 2))
                     for j in range(1, 2 * m + 1)]
    heap, out = [(score[1], (1,))], []
    while heap and len(out) < count:
        total, ranks = heapq.heappop(heap)
        if not any(2 * m + 1 - j in ranks for j in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*ranks, last + 1)))
    return out


def search(x: np.ndarray, group: np.ndarray, k: int, scores: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, similarity) of the k best others of each row in its own group, with the rows."""
    by_group = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[by_group], prepend=group[by_group[0]] - 1))
    waiting, count = [], 0
    for lo, hi in zip(first, np.append(first[1:], len(by_group))):
        members = by_group[lo:hi]
        block = min(512, max(32, scores // len(members)))
        for i in range(0, len(members), block):
            waiting.append((members[i:i + block], *_of_group(members[i:i + block], members, x, k)))
            count += len(waiting[-1][0])
        if count >= 4096 or hi == len(by_group):
            rows, q, c, sim = (np.concatenate(p) for p in zip(*waiting))
            yield *_best(q, c, sim, k), np.sort(rows)
            waiting, count = [], 0


def _best(q: np.ndarray, c: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, one after another."""
    order = np.lexsort((c, -sim, q))  # rows are in the order of their ids
    q, c, sim = q[order], c[order], sim[order]
    best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[best], c[best], sim[best]


def _of_group(rows: np.ndarray, members: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of some rows among all members of their group, with all ties of the k-th and some others."""
    scores = x[rows] @ x[members].T
    scores[rows[:, None] == members[None, :]] = -2
    lanes = max(64, 4 * k)
    if len(members) >= 2 * lanes:  # the k-th of the largest of each lane is no larger than the k-th of all
        most = scores[:, :len(members) // lanes * lanes].reshape(len(rows), -1, lanes).max(axis=1)
        cut = np.partition(most, -k, axis=1)[:, -k]
    else:
        cut = np.partition(scores, -k, axis=1)[:, -k] if len(members) > k else np.full(len(rows), -1.5, np.float32)
    i, j = np.nonzero((scores >= cut[:, None]) & (scores > -1.5))
    q, c = rows[i], members[j]
    return q, c, np.einsum("ij,ij->i", x[q], x[c])  # the same in all groups, to the last bit


def _group_counts(vec_col: str, parts: list[int], hot: dict, s: Settings):
    """Rows of every group of the first level, or of further levels for the vectors of groups that are hot."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, x = unit_rows(batch[vec_col])
            if not len(x):
                continue
            places = Places(x, parts, len(parts) + (len(FURTHER) if hot else 0), s)
            for t, (keys, used) in enumerate(zip(places.keys, places.used)):
                keys = keys[used]
                if hot:
                    keys = keys[np.isin(keys[:, 0], hot.get(t, []))][:, 1:]
                for j in range(keys.shape[1]):
                    key, n = np.unique(keys[:, j], return_counts=True)
                    yield pd.DataFrame({"t": np.int32(t), "level": np.int32(j + bool(hot)), "key": key, "n": n.astype(np.int64)})

    return run


def _route(id_col: str, vec_col: str, parts: list[int], hot, s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, x = unit_rows(batch[vec_col])
            if not len(x):
                continue
            ids = batch[id_col].iloc[at].to_numpy()
            salt = (pd.util.hash_array(ids.astype(object), categorize=False) % np.uint64(1 << 20)).astype(np.int64)
            packed = pack(x)
            places = Places(x, parts, hot.value["deepest"], s)
            sent, levels = [], []
            for t, (keys, used) in enumerate(zip(places.keys, places.used)):
                lists = [hot.value.get((t, j), np.zeros(0, np.int64)) for j in range(keys.shape[2])]
                rows, _ = np.nonzero(used)
                group, deeper, large = group_keys(keys[used], lists)
                levels.append(np.full(used.shape, len(parts), np.int8))
                levels[-1][used] += deeper
                alone, split = np.flatnonzero(~large), np.flatnonzero(large)
                blocks = hot.value["blocks"][t][np.searchsorted(lists[-1], group[split])] if len(split) else np.zeros(0, np.int64)
                sent += [(t, rows[i], g) for i, g in [(alone, group[alone])] + [(split[i], g) for i, g in block_pairs(group[split], blocks, salt[rows[split]])]]
            reach = places.reach(levels)
            for t, i, g in sent:
                yield pd.DataFrame({"t": np.int32(t), "g": g, "reach": reach[i], "id": ids[i], "vec": [packed[j] for j in i]})

    return run


def _search(s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # about 40,000 rows of 16-bit vectors, or one group
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).drop_duplicates(["t", "g", "id"]).sort_values("id", ignore_index=True)
        parts.clear()
        if not len(rows):
            return
        ids, reach = rows["id"].to_numpy(), rows["reach"].to_numpy()
        x = unpack(rows["vec"].tolist())
        group = rows.groupby(["t", "g"]).ngroup().to_numpy()
        for q, c, sim, of in search(x, group, s.k):
            edge = np.searchsorted(q, of)
            yield pd.DataFrame({"id": ids[of], "others": np.split(ids[c], edge[1:]), "sims": np.split(sim, edge[1:]), "reach": reach[of]})

    return run


def nearest(df: DataFrame, id_col: str, vec_col: str, s: Settings = Settings(), partitions: int | None = None) -> DataFrame:
    """(id, other, similarity): for every usable vector its k most similar others.

    Level by level, groups above the group size are counted exactly; their keys go to every task. The group size is
    at least a table's rows/most_hot, so there are at most most_hot of them a table and level.
    """
    spark = df.sparkSession
    base = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("vec"))
    sizes = base.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("dim > 0").orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, rows = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (0, 0)
    base = base.where(F.size("vec") == dim)
    first = parts_for(rows, dim, max(s.group_rows, -(-rows // s.most_hot)))

    def counted(hot: dict) -> DataFrame:
        return durable(base.select("vec").mapInPandas(_group_counts("vec", first, hot, s), "t int, level int, key bigint, n bigint")
                       .groupBy("t", "level", "key").agg(F.sum("n").alias("n")))

    counts = counted({})
    sent = [r["n"] for r in counts.groupBy("t").agg(F.sum("n").alias("n")).collect()]  # one row a table
    group_rows = max(s.group_rows, -(-max(sent, default=0) // s.most_hot))
    found = counts.where(F.col("n") > group_rows).toPandas()
    if len(found):
        further = counted({int(t): np.sort(part["key"].to_numpy()) for t, part in found.groupby("t")}).where(F.col("n") > group_rows).toPandas()
        found = pd.concat([found, further], ignore_index=True)
    hot = {(int(t), int(j)): np.sort(part["key"].to_numpy()) for (t, j), part in found.groupby(["t", "level"])}
    hot["deepest"] = len(first) + (min(len(FURTHER), int(found["level"].max()) + 1) if len(found) else 0)
    last = found[found["level"] == len(FURTHER)].sort_values("key")
    # Two blocks have about as many rows as a group; at least two, so that every row meets all others.
    last = last.assign(blocks=np.maximum(2, -(-last["n"].to_numpy() * 2 // group_rows)).astype(np.int64))
    hot["blocks"] = {int(t): part["blocks"].to_numpy() for t, part in last.groupby("t")}
    shared = spark.sparkContext.broadcast(hot)
    routed_rows = sum(sent) + int((last["n"] * (last["blocks"] - 2)).sum())
    parts = partitions or max(8, -(-routed_rows // 40_000))
    routed = base.mapInPandas(_route("id", "vec", first, shared, s), "t int, g bigint, reach float, id string, vec binary")
    lists = routed.repartition(parts, "t", "g").mapInPandas(_search(s), "id string, others array<string>, sims array<float>, reach float")
    pairs = lists.select("id", F.arrays_zip("others", "sims").alias("p"), "reach")
    merged = pairs.groupBy("id").agg(F.flatten(F.collect_list("p")).alias("p"), F.min("reach").alias("reach"))  # at most k entries a group and block
    ranked = F.array_sort(F.array_distinct(F.transform("p", lambda p: F.struct((-p["sims"]).alias("d"), p["others"].alias("other")))))
    named = merged.select("id", "reach", ranked.alias("r")).select("id", "reach", "r", F.transform("r", lambda p: p["other"]).alias("names"))
    # One other can come with similarities that differ in the last bit; the nearest of each is kept.
    once = F.filter("r", lambda p, i: F.array_position("names", p["other"]) == i + 1)
    near = named.select("id", "reach", F.slice(once, 1, s.k).alias("p"))
    kth = F.when(F.size("p") == s.k, F.sqrt(F.greatest(2 + 2 * F.element_at("p", -1)["d"].cast("double"), F.lit(0.0)))).otherwise(F.lit(3.0))
    best = durable(near.select("id", "p", (kth > F.col("reach")).alias("open")))
    done = best.where(~F.col("open")).select("id", F.explode("p").alias("p")).select("id", "p.other", (-F.col("p.d")).cast("double").alias("similarity"))
    return done.unionByName(_exact(base, best.where("open").select("id", F.when(F.size("p") == s.k, -F.element_at("p", -1)["d"].cast("double") - 1e-4).alias("least")), s.k))


def _exact(base: DataFrame, open_ids: DataFrame, k: int) -> DataFrame:
    """The k nearest of some vectors (id, least) among all, in blocks of queries; `least` is about the k-th similarity known so far."""
    squares = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    items = base.where((squares > 0) & (squares < float("inf"))).select(F.col("id").alias("item_id"), "vec")
    wanted = open_ids.withColumnRenamed("id", "query_id")
    wanted = F.broadcast(wanted) if open_ids.count() <= SENT_IDS else wanted  # a checked number; more are joined by shuffle
    queries = items.withColumnRenamed("item_id", "query_id").join(wanted, "query_id", "left_semi").dropDuplicates(["query_id"])
    found = retrieval.top_k(queries, items, k + 1).where(F.col("query_id") != F.col("item_id")).dropDuplicates(["query_id", "item_id"])
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("query_id").alias("id"), F.col("item_id").alias("other"), F.col("score").alias("similarity"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs where one is among the nearest of the other."""
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
