"""Near copies by exact Jaccard similarity of word shingles: a prefix join that compares no bucket pair by pair in vain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.operators.graph import connected_components
from planeweave.plans.storage import giving_back, materialize

_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(self) >= 20_000:  # in each task; more is no faster
            self.clear()
        self[word] = found
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of the shingles of the whole text.

    Words as simhash64 has them; fewer words than a shingle has: one shingle of them all; no word (or null): none.
    """
    words = (text or "").encode().lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(w))
    if not size:
        return w.view(np.int64)
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h * _STEP + w[i : len(w) - size + 1 + i])
    return np.unique(h.view(np.int64))


def set_print(s: np.ndarray) -> int:
    """A signed 64-bit hash of the set: equal sets are one node and never compared."""
    return int(np.array(xxhash.xxh64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def set_simhash(s: np.ndarray, chunk: int = 1 << 16) -> int:
    """The set's SimHash as a signed long: a bit is 1 if over half of the shingles' hashes have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(s), chunk):
        counts += np.unpackbits(s[i : i + chunk].astype(">i8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(s)).tobytes(), "big", signed=True)


def prefix(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The shingles of which a set at similarity 0.8 shares one: the first ``n - ceil(0.8 n) + 1``, heavy ones put last."""
    if len(heavy):
        late = _among(s, heavy)[1]
        s = np.concatenate([s[~late], s[late]])
    return s[: len(s) + 4 * len(s) // -5 + 1] if len(s) else s


def _among(s: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in heavy (in order, not empty) each would stand, and whether it does."""
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    return at, heavy[at] == s


def parts_of(keys: np.ndarray, fp: int, heavy: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """In which part of each key's bucket the set fp goes; 0 where the bucket has one part."""
    if not len(heavy) or not len(keys):
        return np.zeros(len(keys), np.int32)
    at, there = _among(keys, heavy)
    return np.where(there, int(_mixed(np.array([fp]).view(np.uint64))[0] >> np.uint64(33)) % parts[at], 0).astype(np.int32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parity(s: np.ndarray) -> bytes:
    """Bits, two for each shingle and 1,024 at least, in a power of two: whether an odd number of shingles falls to each."""
    width = max(1024, 1 << (2 * len(s)).bit_length())
    return np.packbits(np.bincount(s & (width - 1), minlength=width) & 1).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ, the longer one folded to the shorter one's width: two sets differ in as many shingles."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (b, a) if len(a) < len(b) else (a, b)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def may_be_similar(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False only if sets of n shingles together, whose parities differ in so many bits, are below 0.8."""
    return 9 * bits <= n


def fold(x: bytes) -> np.ndarray:
    """A parity of 1,024 bits: sets differ in as many shingles at least as their parities, folded or not, differ in bits."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, 16), 0)


def _slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """A few rows at a time, so that a task holds the shingle sets of a part of a batch."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows]


def _heavy(texts: DataFrame, shingle: int, most: int, part: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in over ``most`` texts or so, by their count in one of ``part`` parts of the texts, and into how many parts of about
    ``most`` their buckets are cut: both order the search alone."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in _slices(batches):
            yield pd.DataFrame({"key": np.concatenate([np.empty(0, np.int64), *(shingle_set(t, hashes, shingle) for t in pdf["text"])])})

    some = texts.where(F.pmod("text_hash", F.lit(part)) == 0).select("text").mapInPandas(giving_back(made), "key long")
    often = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most / part).collect()
    often.sort(key=lambda r: r.key)
    return np.array([r.key for r in often], np.int64), np.array([-(-r.n * part // most) for r in often], np.int64)


def _prints(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], shingle: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def made(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
        hashes, (often, parts) = WordHashes(), sent.value
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            sets = [shingle_set(t, hashes, shingle) for t in batch["text"].to_pylist()]
            fps, keys = [set_print(s) for s in sets], [prefix(s, often) for s in sets]
            at = [parts_of(k, fp, often, parts) for k, fp in zip(keys, fps)]
            hot = [_among(k, often)[1] if len(often) and len(k) else np.zeros(len(k), bool) for k in keys]
            at = [np.where(h, p, -1).astype(np.int32) for h, p in zip(hot, at)]
            columns = [(fps, pa.int64()), ([len(s) for s in sets], pa.int64()), (keys, pa.list_(pa.int64())), (at, pa.list_(pa.int32())), ([parity(s) for s in sets], pa.binary()), ([set_simhash(s) for s in sets], pa.int64())]
            columns = [batch["doc_id"], batch["text_hash"], *(pa.array(*c) for c in columns)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "n", "keys", "parts", "bits", "sim"])

    return docs.mapInArrow(giving_back(made), f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long, n long, keys array<long>, parts array<int>, bits binary, sim long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, shingles as bytes), once for each wanted fp; wanted has fp and row, the doc_id and text_hash of one that has it."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in _slices(batches):
            sets = [shingle_set(t, hashes, shingle) for t in pdf["text"]]
            yield pdf[["fp"]].assign(shingles=[s.tobytes() for s in sets])

    named = wanted.select("fp", "row.*").toDF("fp", "w_id", "w_hash")
    of = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))
    return docs.join(named, of).select("fp", "text").mapInPandas(giving_back(made), "fp long, shingles binary").dropDuplicates(["fp"])


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that parities leave. sketches has fp, n and bits of each set."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.array([differing(x, y) for x, y in zip(pdf["x"], pdf["y"])], np.int64)
            yield pdf.loc[may_be_similar((pdf["m"] + pdf["n"]).to_numpy(), bits), ["a", "b"]]

    u, v = sketches.toDF("a", "m", "x"), sketches.toDF("b", "n", "y")
    return pairs.join(u, "a").join(v, "b").mapInPandas(giving_back(near), "a long, b long")


def _unlinked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that no link joins yet."""
    of, to = labels.toDF("a", "of"), labels.toDF("b", "to")
    return pairs.join(of, "a", "left").join(to, "b", "left").where("of is null or to is null or of <> to").select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, row: DataFrame, shingle: int) -> DataFrame:
    """(src, dst) of the pairs (a, b), a table, that are similar; shingle sets are made of their texts alone."""

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            ok = [similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]].rename(columns={"a": "src", "b": "dst"})

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(row, "fp")
    sets = materialize(_sets(texts, wanted, shingle), "sets")
    x = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    return materialize(pairs.join(x, "a").join(y, "b").mapInPandas(giving_back(judged), "src long, dst long"), "links")


def _to_middle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) between the middle, by size, of each row's sets and the others that are not too long or too short for it."""
    for pdf in batches:
        a, b = [], []
        for n, fp in zip(pdf["ns"], pdf["fps"]):
            m = len(n) // 2
            near = (5 * np.minimum(n, n[m]) >= 4 * np.maximum(n, n[m])) & (fp != fp[m])
            a.append(np.minimum(fp[near], fp[m]))
            b.append(np.maximum(fp[near], fp[m]))
        yield pd.DataFrame({"a": np.concatenate([np.empty(0, np.int64), *a]), "b": np.concatenate([np.empty(0, np.int64), *b])})


def apart(x: list, y: list) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of those pairs, one of x and one of y, that no link joins yet and sizes and parities leave.

    Both are columns: sizes, prints, components and parities.
    """
    (n, fp, of, bits), (m, other, to, more) = ([np.asarray(c) for c in side[:3]] + [list(side[3])] for side in (x, y))
    u, v, found = np.array([fold(b) for b in bits]), np.array([fold(b) for b in more]), []
    for i in range(len(n)):
        j = np.flatnonzero((to != of[i]) & (5 * np.minimum(m, n[i]) >= 4 * np.maximum(m, n[i])))
        j = j[may_be_similar(n[i] + m[j], np.bitwise_count(v[j] ^ u[i]).sum(1, dtype=np.int64))]
        found += [(fp[i], other[k]) for k in j if max(len(bits[i]), len(more[k])) == 128 or may_be_similar(n[i] + m[k], np.int64(differing(bits[i], more[k])))]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs.min(1, initial=2**63 - 1), pairs.max(1, initial=-(2**63))


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) of each small bucket that no link joins yet and sizes leave."""
    for pdf in batches:
        found = []
        for n, fp, of in zip(pdf["ns"], pdf["fps"], pdf["cs"]):
            i, j = np.nonzero(np.triu((of[:, None] != of) & (5 * np.minimum(n[:, None], n) >= 4 * np.maximum(n[:, None], n))))
            found.append(np.stack([np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])], 1))
        pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _across(buckets: DataFrame, labels: DataFrame, sketches: DataFrame, block: int, small: int = 64) -> DataFrame:
    """(a, b) that meet in a bucket, have no link yet and are left by parities.

    A bucket of up to ``small`` sets gives its pairs, as many buckets give the same, and parities are fetched for each pair once. In
    a larger one, sets outside its largest component are compared with all of it, in blocks of about ``block`` a side with their
    parities; blocks of the largest component never meet each other.
    """
    each = buckets.select("bucket", F.explode(F.arrays_zip("ns", "fps")).alias("s")).select("bucket", F.col("s.ns").alias("n"), F.col("s.fps").alias("fp"))
    known = each.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("bucket", "n", "fp", F.coalesce("component", "fp").alias("c"))
    by = known.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("k_main"), F.sum("k").alias("k"))
    of = by.where("k > k_main and k > 2").select("bucket", "k", "main", F.ceil(F.col("k_main") / block).alias("mains"), F.ceil((F.col("k") - F.col("k_main")) / block).alias("others"))
    rows = materialize(known.join(of, "bucket"), "open")
    few = rows.where(F.col("k") <= small).groupBy("bucket").agg(F.collect_list(F.struct("n", "fp", "c")).alias("all"))
    pairs = _plausible(few.select(F.col("all.n").alias("ns"), F.col("all.fp").alias("fps"), F.col("all.c").alias("cs")).mapInPandas(giving_back(_within), "a long, b long").distinct(), sketches)
    rows = rows.where(F.col("k") > small).join(sketches.select("fp", "bits"), "fp").withColumn("is_main", F.col("c") == F.col("main"))
    at = F.pmod(F.xxhash64(F.lit(5), "fp"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    made = rows.withColumn("at", at).groupBy("bucket", "is_main", "at").agg(F.first("mains").alias("mains"), F.first("others").alias("others"), F.collect_list(F.struct("n", "fp", "c", "bits")).alias("all"))
    made = materialize(made.select("bucket", "is_main", "at", "mains", "others", *(F.col(f"all.{c}").alias(c) for c in ("n", "fp", "c", "bits"))), "blocks")
    main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda i: F.struct(F.lit(True).alias("is_main"), i.alias("at")))
    other = F.transform(F.sequence(F.col("at"), F.col("others") - 1), lambda i: F.struct(F.lit(False).alias("is_main"), i.alias("at")))
    x = made.where("not is_main").select("bucket", F.explode(F.concat(main, other)).alias("t"), *(F.col(c).alias("x_" + c) for c in ("n", "fp", "c", "bits")))
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, so that small blocks, long to compare, stay apart
    x = x.select("bucket", "t.*", *(c for c in x.columns if c.startswith("x_"))).repartition(tasks, "bucket", "is_main", "at")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = apart([r.x_n, r.x_fp, r.x_c, r.x_bits], [r.n, r.fp, r.c, r.bits])
                yield pd.DataFrame({"a": a, "b": b})

    both = x.join(made.drop("mains", "others"), ["bucket", "is_main", "at"]).drop("bucket", "is_main", "at")
    return pairs.unionByName(both.mapInPandas(giving_back(compared), "a long, b long")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int | None = None, block: int = 256, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, fp, group_fp.

    Texts link at a Jaccard similarity of 0.8 or more of their sets of five-word shingles (hashed to 64 bits), and
    group_fp names the component. Two such sets share one of their first ``n - ceil(0.8 n) + 1`` shingles in any order
    that is the same for all, so every pair meets in a bucket. The order is that of the hashes, shingles in over ``most``
    texts (a 20,000th of them, 200 at least, so they are at most 20,000 times a text's), as of a common passage, last; a
    part of the texts tells which, and changes the work only, not the result. Buckets of such shingles are cut into parts of
    about ``most`` sets, so no task gathers one. All of a part are compared with its middle one by size, and the middles of a
    bucket's parts with theirs; after that, those that no link joins yet are compared with all others of their bucket, in
    blocks, so a large group of near copies takes about one comparison each. No bucket is dropped. Texts without words,
    null ones too, are copies of each other. first makes, of (fp, sim) of all sets, sim their SimHash, pairs (a, b) that are
    judged before all others; what those link is not compared again, and the result is the same without it.
    """
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), own.alias("text_hash"))
    most = most or max(200, texts.count() // 20_000)
    made = materialize(_prints(texts, _heavy(texts, shingle, most), shingle), "prints")
    rows = made.select("doc_id", "text_hash", "fp")
    row = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    # copies, in whose place one set stands, fall together before the shuffle
    index = made.where("n > 0").select(F.explode(F.arrays_zip("keys", "parts")).alias("key"), "n", "fp")
    met = index.groupBy("key.keys", "key.parts").agg(F.sort_array(F.collect_set(F.struct("n", "fp"))).alias("all")).where((F.size("all") > 1) | (F.col("parts") >= 0))
    # many shingles bring the same documents together; a bucket without parts is named by what is in it
    whole = F.when(F.col("parts") < 0, F.xxhash64("all")).otherwise(F.col("keys"))
    named = met.select(whole.alias("bucket"), F.greatest("parts", F.lit(-1)).alias("part"), "all").distinct()
    buckets = materialize(named.select("bucket", "part", F.col("all.n").alias("ns"), F.col("all.fp").alias("fps")), "buckets")
    sketches = materialize(made.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sim").alias("sim")), "sketches")
    prints, sketches = sketches.select("fp", "sim"), sketches.select("fp", "n", "bits")
    half = F.floor(F.size("ns") / 2).cast("int")
    middles = buckets.where("part >= 0").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(F.element_at("ns", half + 1).alias("n"), F.element_at("fps", half + 1).alias("fp")))).alias("all"))
    compared = buckets.select("ns", "fps").unionByName(middles.select(F.col("all.n").alias("ns"), F.col("all.fp").alias("fps")))
    pairs = compared.mapInPandas(giving_back(_to_middle), "a long, b long").distinct()
    if first:
        known = _verified(materialize(_plausible(first(prints).distinct(), sketches), "pairs"), texts, row, shingle)
        pairs = _unlinked(pairs, connected_components(known))
    edges = _verified(materialize(_plausible(pairs, sketches), "pairs"), texts, row, shingle)
    edges = edges.unionByName(known) if first else edges
    labels = connected_components(edges)
    second = _verified(materialize(_across(buckets, labels, sketches, block), "pairs"), texts, row, shingle)
    if second.limit(1).count():
        labels = connected_components(edges.unionByName(second))
    return rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("component", "fp").alias("group_fp"))
