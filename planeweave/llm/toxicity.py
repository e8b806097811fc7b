"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in block-max inverted indexes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.plans.storage import give_back, giving_back, materialize

#: A-Z to a-z; letters, digits and bytes from 0x80 stay; all else parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def trains(doc_id: Column, parts: int = 5) -> Column:
    """Whether labels of this document may be learned from: crc32 of the id as text, modulo parts, is not 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)) != 0


def sampled_labels(labels: DataFrame, most: int, parts: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, toxic, weight): of each class the ``most`` training rows with the smallest hash of their id at most.

    weight is the class's training rows over those taken. Several labels of a document count as the largest; null ids and
    labels other than 0 and 1 are left out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(trains(F.col("doc_id"), parts))
    known = materialize(known, "labels")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
        part = part.withColumn("weight", F.lit(max(1.0, sizes.get(kind, 0) / most)))
        out = part if out is None else out.unionByName(part)
    return materialize(out, "sample")


def examples(docs: DataFrame, sample: DataFrame) -> tuple[list, bytes, list[tuple[np.ndarray, np.ndarray]]]:
    """(id, label, weight) of the sampled rows that have a document, in order of id; the words of their whole texts,
    joined by spaces; each text's words, by number, and counts.

    Of several texts of one id the least counts. All of it is bounded by the sample.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [Counter(words_of(t)) for t in pdf["text"]]
            yield pdf[["doc_id", "toxic", "weight"]].assign(words=[b" ".join(c) for c in said], counts=[np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in said])

    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text"))
    rows = texts.mapInPandas(giving_back(counted), f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, weight double, words binary, counts binary").collect()
    return _numbered(rows)


def _numbered(rows: list) -> tuple[list, bytes, list[tuple[np.ndarray, np.ndarray]]]:
    """What examples returns of its collected rows, which are emptied one by one: the driver never holds all twice."""
    rows.sort(key=lambda r: r.doc_id)
    ids: dict[bytes, int] = {}
    known, said = [], []
    for i, r in enumerate(rows):
        rows[i] = None
        known.append((r.doc_id, r.toxic, r.weight))
        said.append((np.array([ids.setdefault(w, len(ids)) for w in bytes(r.words).split()], np.int32), np.frombuffer(r.counts, np.int32).copy()))
    return known, b" ".join(ids), said


def document_counts(docs: DataFrame, words: bytes) -> tuple[np.ndarray, int]:
    """In how many of all documents each word stands, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = {w: i for i, w in enumerate(sent.value.split())}
        n, total = np.zeros(len(ids), np.int64), 0
        for pdf in batches:
            total += len(pdf)
            for text in pdf["text"]:
                n[[ids[w] for w in ids.keys() & set(words_of(text))]] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"term": np.r_[-1, at], "n": np.r_[total, n[at]]})

    sums = docs.select("text").mapInPandas(giving_back(counted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    out, known = np.zeros(len(words.split())), term >= 0
    out[term[known]] = n[known]
    sent.destroy()
    return out, int(n[~known].sum())


def relevance(said: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, n_words: int) -> np.ndarray:
    """1 + the log-likelihood ratio of each word's document counts under both labels: 1 for words that tell nothing."""
    t, c = np.zeros(n_words), np.zeros(n_words)
    for (words, _), label in zip(said, toxic):
        (t if label else c)[words] += 1
    nt, nc = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    p = np.clip((t + c) / (nt + nc), 1e-12, 1 - 1e-12)

    def part(seen: np.ndarray, all_: int, share: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / (all_ * share)), 0.0)

    return 1 + np.maximum(0, 2 * (part(t, nt, p) + part(c, nc, p) + part(nt - t, nt, 1 - p) + part(nc - c, nc, 1 - p)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... up to sizes[0] of them, then the same of starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples as posting lists in blocks of examples, with the largest weight of each term and block.

    search gives the exact k nearest by cosine. A block's upper bound is the sum of a query's weights times the block's
    largest ones; the blocks of the largest bounds are looked at first, then those whose bound reaches the kth best. Terms in
    over one of ``common`` examples are held as rows of a matrix instead of lists: their part of all cosines is one product,
    and its largest in each block joins the bound.
    """

    def __init__(self, ids: list, toxic: np.ndarray, weight: np.ndarray, said: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, block: int = 64, common: int = 8):
        self.scale, self.block, self.common = scale, block, common
        norm, heaviest = np.ones(len(ids)), np.full(len(ids), -1)
        for i, (t, c) in enumerate(said):
            if len(t):
                w = self.plain(t, c)
                norm[i] = np.sqrt((w * w).sum())
                heaviest[i] = t[(w / norm[i]).argmax()]
        order = sorted(range(len(ids)), key=lambda i: (heaviest[i], ids[i]))
        self.ids, self.toxic, self.weight, self.norm = [ids[i] for i in order], toxic[order], weight[order], norm[order]
        self.said = [said[i] for i in order]
        ends = np.cumsum([0, *(len(t) for t, _ in self.said)])
        most = max((int(c.max()) for _, c in said if len(c)), default=0)
        term, count = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.min_scalar_type(most))
        for a, b, (t, c) in zip(ends[:-1], ends[1:], self.said):
            term[a:b], count[a:b] = t, c
        doc = np.repeat(np.arange(len(ids), dtype=np.min_scalar_type(len(ids))), np.diff(ends))
        by = np.argsort(term, kind="stable")
        #: All that is sent: how many postings each term has, and their examples and counts.
        self.lists = np.bincount(term, minlength=len(scale)).astype(np.int32), doc[by], count[by]
        del term, doc, count, by
        self.build()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("scale", "block", "common", "ids", "toxic", "weight", "norm", "lists", "said")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.build()
        self.lists = None

    def build(self) -> None:
        """Everything that search reads, from the lists."""
        sizes, doc, count = self.lists
        self.n, self.blocks = len(self.ids), -(-len(self.ids) // self.block)
        term, doc, val = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), doc.astype(np.int32), count.astype(float)
        np.log(val, out=val)
        val += 1
        val *= self.scale[term]
        val /= self.norm[doc]
        often = sizes.astype(np.int64) * self.common > self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.matrix = np.zeros((int(often.sum()), self.blocks * self.block))
        at = often[term]
        self.matrix[self.row[term[at]], doc[at]] = val[at]
        np.logical_not(at, out=at)
        term, self.doc, self.val = term[at], doc[at], val[at]
        del at, doc, val
        blocks = self.doc // np.int32(self.block)
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])]) if len(term) else np.empty(0, np.int64)
        self.of_block = blocks[first]
        self.top = np.maximum.reduceat(self.val, first) if len(first) else np.empty(0)
        #: Where the postings of each term and block begin, and where the last ones end.
        self.start = np.r_[first, len(term)].astype(np.int32 if len(term) < 2**31 else np.int64)
        term = term[first]
        self.entry = np.searchsorted(term, np.arange(len(self.scale) + 1))

    @property
    def unit_of(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The examples' unit vectors, made anew: the index itself keeps words and counts alone."""
        return [self.unit(*v) for v in self.said]

    def plain(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.scale[terms]

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.plain(terms, counts)
        return terms, w / np.sqrt((w * w).sum()) if len(terms) else w

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: np.ndarray | None = None, first: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, examples) of the k nearest with a cosine over 0 of each unit vector, ties to the smaller example; ``but`` names
        an example for each query that is left out."""
        known = np.zeros((len(queries), len(self.matrix)))
        for q, (t, w) in enumerate(queries):
            at = self.row[t] >= 0
            known[q, self.row[t[at]]] = w[at]
        known = known @ self.matrix
        out = []
        for q, (t, w) in enumerate(queries):
            if not self.n or not len(t):
                out.append((np.empty(0), np.empty(0, np.int64)))
                continue
            sizes = self.entry[t + 1] - self.entry[t]
            e, x = _ranges(self.entry[t], sizes), np.repeat(w, sizes)
            bound = known[q].reshape(self.blocks, self.block).max(1) + np.bincount(self.of_block[e], x * self.top[e], self.blocks)
            by = np.argsort(-bound, kind="stable")
            sums, near, reach = known[q].copy(), np.empty(0, np.int64), 1e-15
            if but is not None:
                sums[but[q]] = -np.inf
            for part in (by[:first], by[first:]):
                part = part[bound[part] >= reach - 1e-12]
                if not len(part):
                    break
                here = np.zeros(self.blocks, bool)
                here[part] = True
                near = np.r_[near, part]
                at = np.flatnonzero(here[self.of_block[e]])
                begin = self.start[e[at]]
                size = self.start[e[at] + 1] - begin
                post = _ranges(begin, size)
                sums += np.bincount(self.doc[post], np.repeat(x[at], size) * self.val[post], len(sums))
                mine = sums.reshape(self.blocks, self.block)[near].ravel()
                reach = max(reach, float(np.partition(mine, -k)[-k])) if len(mine) >= k else reach
            found = np.flatnonzero(mine >= reach)
            mine, found = mine[found], near[found // self.block] * self.block + found % self.block
            order = np.lexsort((found, -mine))[:k]
            out.append((mine[order], found[order]))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means of y over x (pool adjacent violators), as points to interpolate."""
    out: list[list[float]] = []
    for a in np.unique(x):
        m = x == a
        out.append([float(a), float((y[m] * w[m]).sum()), float(w[m].sum()), float(a)])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            q = out.pop()
            out[-1] = [out[-1][0], out[-1][1] + q[1], out[-1][2] + q[2], q[3]]
    xs = [v for o in out for v in (o[0], o[3])]
    ys = [o[1] / o[2] for o in out for _ in (0, 1)]
    return np.array(xs), np.array(ys)


class Model:
    """Words, index, calibration, and the scores of texts."""

    def __init__(self, words: bytes, index: BlockMaxIndex, k: int = 16):
        self.words, self.index, self.k, self.known = words, index, k, None
        empty = np.array([not len(t) for t, _ in index.said], bool)
        y, w = index.toxic.astype(float), index.weight
        self.prior = float(((y * w).sum() + 0.05) / (w.sum() + 0.1)) if len(y) else 0.0
        self.empty = float(((y * w)[empty].sum() + self.prior) / (w[empty].sum() + 1))
        held = np.flatnonzero(~empty)
        votes = np.array([self.vote(*near) for a in range(0, len(held), 256) for near in index.search([index.unit(*index.said[e]) for e in held[a : a + 256]], k, held[a : a + 256])])
        index.said = None  # only needed here
        # two mild witnesses keep the ends of the scale off 0 and 1
        self.x, self.y = isotonic(np.r_[votes, 0.0, 1.0], np.r_[y[held], 0.0, 1.0], np.r_[w[held], 1.0, 1.0])

    def vote(self, cosine: np.ndarray, near: np.ndarray) -> float:
        """Weighted share of label 1 among the neighbours, nearer ones counting more, drawn a little to the prior."""
        v = cosine / (1.1 - cosine) * self.index.weight[near]
        return float(((v * self.index.toxic[near]).sum() + 0.2 * self.prior) / (v.sum() + 0.2))

    def score(self, texts) -> Iterator[tuple[float, list]]:
        """The calibrated score of each text, and the ids of its three nearest examples."""
        if self.known is None:
            self.known = {w: i for i, w in enumerate(self.words.split())}
        texts, ids = list(texts), self.known
        for a in range(0, len(texts), 256):
            said = []
            for text in texts[a : a + 256]:
                c = Counter(map(ids.get, words_of(text)))
                c.pop(None, None)
                said.append(self.index.unit(np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), float, len(c))))
            for cosine, near in self.index.search(said, self.k):
                if not len(near):
                    yield self.empty, []
                else:
                    yield float(np.clip(np.interp(self.vote(cosine, near), self.x, self.y), 0.0, 1.0)), [self.index.ids[e] for e in near[:3]]


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = 4000, parts: int = 5, k: int = 16) -> Model:
    """Examples are at most most_examples training rows of each class (a documented bound; see sampled_labels). Terms are all
    words of their texts, with document frequencies counted over all documents."""
    sample = sampled_labels(labels, most_examples, parts)
    docs = docs.select("doc_id", "text")
    rows, words, said = examples(docs, sample)
    seen, total = document_counts(docs, words)
    toxic = np.array([label for _, label, _ in rows], np.int64)
    scale = (np.log((1 + total) / (1 + seen)) + 1) * relevance(said, toxic, len(seen))
    index = BlockMaxIndex([i for i, _, _ in rows], toxic, np.array([w for _, _, w in rows], float), said, scale)
    return Model(words, index, k)


def score_toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs, from its whole text alone.

    All words of a text that any example holds are weighted by (1 + ln count) * idf * relevance, idf over all documents and
    relevance 1 for a word that tells nothing of the label (see relevance); the k nearest examples by exact cosine vote, and
    the share of label 1 is calibrated by a rising step function fitted to votes that leave the example itself out. A text
    without a known word (null and empty ones too) has the share of label 1 among such examples, drawn to the share among
    all. predicted is 1 from 0.5; evidence lists the ids of the three nearest examples. Rows that repeat are scored each;
    labels without a document, or no labels at all, do no harm (score 0); an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    give_back()
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = list(sent.value.score(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [s for s, _ in found], "evidence": [e for _, e in found]})

    out = rows.mapInPandas(giving_back(scored), f"doc_id {kind}, score double, evidence array<{kind}>")
    return out.select("doc_id", (~trains(F.col("doc_id"), how.get("parts", 5))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_blockmax_toxicity(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_toxicity(read("documents"), read("labels")).select("doc_id", "held_out", "score", "predicted")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is under 0.5."""
    sent = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    give_back()

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from giving_back(lambda all_: (pd.Series([s for s, _ in sent.value.score(text)], dtype=float) for text in all_))(texts)

    return docs.where(score("text") < 0.5)
