"""Exact top-k search by inner product with dual cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planeweave.plans.storage import materialize

EXACT, EXACT_32 = 2.0**53, 2.0**24
LEAST, MOST = -(2**63), 2**63 - 1
#: Products of components in one matrix product: a few milliseconds and megabytes.
DIRECT = 2**24


class CoverTree:
    """Nodes over rows of x: centre (a row), covering radius, children or rows.

    The children of a node are centred on rows over radius / base apart that cover it within radius / base, the node's own
    centre among them. A node stays a leaf if it is small, or if covering it would take over twice the root of its rows:
    finding so many centres costs more than the products that the children could spare.
    """

    def __init__(self, x: np.ndarray, base: float = 1.3, leaf: int = 64):
        self.x, self.nodes = x, []
        self.square = (x * x).sum(1) if np.abs(x).max(initial=0) < (EXACT / max(1, x.shape[1])) ** 0.5 / 2 else None
        self.root = self._grow(np.arange(len(x)), 0, base, leaf)

    def _grow(self, rows: np.ndarray, centre: int, base: float, leaf: int) -> int:
        x, square = self.x[rows], None if self.square is None else self.square[rows]

        def away(c: int) -> np.ndarray:
            return np.sqrt(((x - x[c]) ** 2).sum(1) if square is None else square - 2 * (x @ x[c]) + square[c])  # exact whole numbers

        far = away(centre)
        node, radius, children = len(self.nodes), float(far.max()), []
        self.nodes.append(None)
        if len(rows) > leaf and 0 < radius < np.inf:
            centres, own = [centre], np.zeros(len(rows), np.int64)
            while far.max() > radius / base and len(centres) <= 2 * len(rows) ** 0.5:
                c = int(far.argmax())
                d = away(c)
                own[d < far] = len(centres)
                far = np.minimum(far, d)
                centres.append(c)
            if far.max() <= radius / base:
                for i, c in enumerate(centres):
                    part = np.flatnonzero(own == i)
                    children.append(self._grow(rows[part], int(np.flatnonzero(part == c)[0]), base, leaf))
        c = self.x[rows[centre]]
        self.nodes[node] = (c, float(np.sqrt((c * c).sum())), radius, children, rows)
        return node


class TopK:
    """The k best (score, smaller id first) of each query so far, and the score that a new one has to reach."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.worst = ids, k, floor.astype(float).copy()
        self.held = np.zeros(len(ids), np.int64)
        self.scores, self.best = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            least = self.worst[rows].astype(scores.dtype if scores.dtype.kind == "f" else float)
        at, col = np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])
        other = ids[col] != self.ids[rows[at]]
        at, col = at[other], col[other]
        if not len(at):
            return
        seen = rows[np.unique(at)]
        old, place = np.nonzero(np.arange(self.k) < self.held[seen][:, None])
        q = np.concatenate([rows[at], seen[old]])
        s = np.concatenate([scores[at, col].astype(np.int64), self.scores[seen[old], place]])
        i = np.concatenate([ids[col], self.best[seen[old], place]])
        order = np.lexsort((i, ~s, q))  # ~s: -s may not fit
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        first = rank < self.k
        q, s, i, rank = q[first], s[first], i[first], rank[first]
        self.scores[q, rank], self.best[q, rank] = s, i
        np.maximum.at(self.held, q, rank + 1)
        full = rank == self.k - 1
        self.worst[q[full]] = np.maximum(self.worst[q[full]], s[full].astype(float))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query's id, the row's id and the score of all that are held."""
        q, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return self.ids[q], self.best[q, place], self.scores[q, place]


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> TopK:
    """Walks two cover trees together; a pair of nodes goes if no inner product in it can reach the group's worst kth score.

    With centres p, q and radii r, s, none exceeds ``p.q + r|q| + s|p| + rs``. Components are whole numbers, so scores are
    exact in doubles while they stay under 2**53 (in floats under 2**24), and are summed in Python's integers, up to the
    ends of 64 bits, otherwise. A pair of up to ``DIRECT`` products of components is multiplied at once, as walking on would
    cost more than it can spare.
    """
    top = TopK(query_ids, floor, k)
    a, b = CoverTree(queries), CoverTree(data)
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1])
    large, kind = most >= EXACT, np.float32 if most < EXACT_32 else float
    x, y = (queries, data) if large else (queries.astype(kind), data.astype(kind))
    width = max(16, queries.shape[1])

    def multiply(rows: np.ndarray, others: np.ndarray) -> None:
        d, step = y[others], max(1, DIRECT // (width * len(others)))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            if large:
                scores = np.array([[max(LEAST, min(MOST, sum(int(s) * int(t) for s, t in zip(u, v)))) for v in d] for u in x[part]], np.int64)
            else:
                scores = x[part] @ d.T
            top.offer(part, scores, ids[others])

    def bound(m: tuple, n: tuple) -> float:
        return float(m[0] @ n[0]) + m[2] * n[1] + n[2] * m[1] + m[2] * n[2]

    stack = [(a.root, b.root)]
    while stack:
        i, j = stack.pop()
        m, n = a.nodes[i], b.nodes[j]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = max(bound(m, n), float(LEAST))  # as scores below are LEAST
        if reach + 1e-9 * abs(reach) + 1e-6 < top.worst[m[4]].min():
            continue
        if not m[3] and not n[3] or not large and width * len(m[4]) * len(n[4]) <= DIRECT:
            multiply(m[4], n[4])
        elif n[3] and (not m[3] or n[2] >= m[2]):
            stack += [(i, c) for c in sorted(n[3], key=lambda c: bound(m, b.nodes[c]))]
        else:
            stack += [(c, j) for c in m[3]]
    return top


def blocks_of(counts: dict, block: int) -> dict:
    """The first of the blocks of each key and how many they are: keys in order share one while it has room."""
    found, last, room = {}, -1, 0
    for key, n in sorted(counts.items()):
        parts = max(1, -(-n // block))
        new = parts > 1 or n > room
        found[key] = (last + new, parts)
        room = (0 if parts > 1 else block - n) if new else room - n
        last += parts if new else 0
    return found


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, every: int = 20, block: int = 4096, most_centres: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row whose id is divisible by ``every``.

    Components become floor(scale * x). Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are null
    or hold a null or a component that is not finite, and null ids, take no part; vectors are compared with those of their
    own length only; rows of one id are one vector if they repeat, and never each other's result.

    Components whose scaled value is not finite count as not finite; scores beyond 64 bits become the nearest long, ties
    among them to the smaller id.

    Of equal vectors only the k + 1 smallest ids can be results, so the rest of a group of copies is left before any
    search. Vectors go to the nearest of at most most_centres centres (a bounded sample by hash, which only shapes the
    cells) and, by a hash, to blocks of about ``block`` in each cell that holds more. Each query first searches its own
    cell's blocks, and its kth score there is what all others must reach: it is sent on to those cells alone whose centre
    and radius allow that, and a cell's vectors go only to query blocks with such a query (then see search). Small cells'
    queries share a block, as each block costs a copy of what it reaches. Where no cell can be left out, as with vectors
    in all directions, queries meet all vectors, so the products grow with the square of the table.
    """
    spark = vectors.sparkSession

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            with np.errstate(over="ignore"):
                v = [np.floor(scale * np.array(x, float)) for x in pdf["v"]]
            ok = np.array([np.isfinite(x).all() for x in v], bool)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[ok], "v": [x.tobytes() for x, good in zip(v, ok) if good]})

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = materialize(rows.mapInPandas(whole, "vec_id long, v binary").distinct(), "vectors")
    first = W.partitionBy("v").orderBy("vec_id")
    data = rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy")
    total = rows.count()
    n_centres = int(min(most_centres, max(1, total // block)))
    sample = data.orderBy(F.xxhash64("v"), "v").limit(n_centres).collect()
    centres: dict[int, list[np.ndarray]] = {}
    for r in sample:
        centres.setdefault(len(r.v), []).append(np.frombuffer(bytes(r.v)))
    stacked = {n: np.array(c) for n, c in centres.items()}

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells, far = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.inf)
            sizes = pdf["v"].map(len).to_numpy()
            for n in np.unique(sizes) if len(pdf) else ():
                if n in stacked and n:
                    at = np.flatnonzero(sizes == n)
                    x, c = np.array([np.frombuffer(b) for b in pdf["v"].iloc[at]]), stacked[n]
                    cells[at] = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                    far[at] = np.sqrt(((x - c[cells[at]]) ** 2).sum(1))
            yield pdf.assign(dim=sizes // 8, cell=cells, far=far)

    with_cell = "vec_id long, v binary, dim long, cell long, far double"
    cells = materialize(data.mapInPandas(celled, with_cell), "cells")
    parts = F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts")
    sizes = materialize(cells.groupBy("dim", "cell").agg(parts, F.max("far").alias("far")), "sizes")
    shapes = {(r.dim, r.cell): r.far for r in sizes.collect()}
    sizes = F.broadcast(sizes.drop("far"))
    hashed, each = F.xxhash64("vec_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cells = cells.drop("far").join(sizes, ["dim", "cell"]).withColumn("db", F.pmod(hashed, F.col("parts"))).drop("parts")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInPandas(celled, with_cell).drop("far")
    queries = materialize(queries.withColumn("floor", F.lit(float("-inf"))), "queries")
    counted = queries.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    query_blocks = blocks_of({(r.dim, r.cell): r.n for r in counted}, block)
    found_schema = "query_id long, vec_id long, score long"

    def searched(key, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, y = (np.array([np.frombuffer(b) for b in p["v"]]).reshape(len(p), -1) for p in (q, d))
        top = search(x, q["vec_id"].to_numpy(), q["floor"].to_numpy(), y, d["vec_id"].to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), top.found())))

    near = queries.join(sizes, ["dim", "cell"]).withColumn("db", each).drop("parts")
    one = near.groupBy("dim", "cell", "db").cogroup(cells.groupBy("dim", "cell", "db")).applyInPandas(searched, found_schema)
    one = materialize(one, "near")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a little less than the kth score, which a double may not hold
    reach = (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * F.lit(1e-15)).alias("reach")
    floors = one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), reach)
    known = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("reach", "floor")).drop("reach").withColumn("qb", F.pmod(hashed, F.lit(2**31)))

    def reaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query, with its block, once for each other cell of its length in which a product can reach its floor."""
        for pdf in batches:
            at = np.array([query_blocks[x] for x in zip(pdf["dim"], pdf["cell"])], np.int64).reshape(-1, 2)
            for n, part in pdf.assign(qb=at[:, 0] + pdf["qb"] % at[:, 1]).groupby("dim"):
                mine = sorted(c for d, c in shapes if d == n)
                x = np.array([np.frombuffer(b) for b in part["v"]]).reshape(len(part), -1)
                for c in mine:
                    radius, centre = shapes[n, c], stacked[8 * n][c] if 8 * n in stacked and n else None
                    if centre is None or not np.isfinite(radius):
                        ok = np.ones(len(part), bool)
                    else:
                        most = np.maximum(x @ centre + radius * np.sqrt((x * x).sum(1)), LEAST)
                        ok = ~(most + 1e-9 * np.abs(most) + 1e-6 < part["floor"].to_numpy())
                    ok &= part["cell"].to_numpy() != c
                    if ok.any():
                        yield part.loc[ok].assign(to=c)

    sent = materialize(known.mapInPandas(reaching, "vec_id long, v binary, dim long, cell long, floor double, qb long, to long"), "sent")
    far = sent.drop("cell").withColumnRenamed("to", "cell").join(sizes, ["dim", "cell"]).withColumn("db", each).drop("parts")
    wanted = materialize(sent.select("dim", F.col("to").alias("cell"), "qb").distinct(), "wanted")
    spread = cells.join(wanted, ["dim", "cell"])
    two = far.groupBy("dim", "qb", "cell", "db").cogroup(spread.groupBy("dim", "qb", "cell", "db")).applyInPandas(searched, found_schema)
    both = one.unionByName(two)
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_dual_tree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with e as (select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.v, d.v) as bigint) as score from e q join e d on q.vec_id <> d.vec_id and len(q.v) = len(d.v) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 20"""
