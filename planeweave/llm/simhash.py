"""SimHash near-duplicates over deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.shingles import near_copies
from planeweave.operators.graph import connected_components
from planeweave.plans.storage import giving_back, materialize

LOW = 0xFFFFFFFF


def simhash64(text: str | None, shingle: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """The unsigned fingerprint: a bit is 1 if over half of the shingles' XXH64 values have it.

    A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+`` of the whole text, shingles joined by a space, repeats counted; fewer
    words than a shingle has: one shingle of them all; no word (or null): 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, chunk):
        part = words[a : a + chunk + shingle - 1]
        made = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
        h = np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(seed)), np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp is the fingerprint as a signed long, text_hash tells equal texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("text_hash"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([simhash64(t, shingle, seed) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pdf[["doc_id", "text_hash"]].assign(fp=fp)

    return rows.mapInPandas(hashed, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, fp long")


def _forest(fp: np.ndarray, mine) -> list[tuple[int, int]]:
    """Edges that join what the pairs of one bucket join; mine(xor) tells the pairs within reach that fall to the bucket."""
    link = mine(fp[:, None] ^ fp[None, :])
    label = np.arange(len(fp))
    while True:
        near = np.where(link, label[None, :], len(fp)).min(1)
        step = np.minimum(label, near)
        step = step[step]
        if (step == label).all():
            return [(int(fp[r]), int(fp[i])) for i, r in enumerate(label) if r != i]
        label = step


def _bucket_links(bucket: int, bits: int = 2):
    """Which pairs, by their difference, bucket kind 0..31 (upper half without that bit) or 32 (lower half) has to link.

    A pair within two bits meets in many buckets. It falls to: the variant of its one differing upper bit; variant 0 if
    its upper halves agree; the lower half's bucket if both differing bits are upper ones.
    """

    def mine(x: np.ndarray) -> np.ndarray:
        u = x.view(np.uint64)
        upper = u >> np.uint64(32)
        near = (x != 0) & (np.bitwise_count(u) <= bits)
        if bucket == 32:
            return near & (np.bitwise_count(upper) == 2)
        one = upper == np.uint64(1 << bucket)
        return near & (one | (upper == 0) if bucket == 0 else one)

    return mine


def scan_buckets(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Edges (kind 0: a, b) from rows (key, fp) in order of key; buckets over ``most`` are handed on (kind 1: key, fp)."""

    def out(kind: int, rows) -> pd.DataFrame:
        rows = np.array(rows, np.int64).reshape(-1, 2)
        return pd.DataFrame({"kind": np.full(len(rows), kind, np.int32), "a": rows[:, 0], "b": rows[:, 1]})

    key, fp, large = np.empty(0, np.int64), np.empty(0, np.int64), None
    for pdf in batches:
        if not len(pdf):
            continue
        key, fp = np.concatenate([key, pdf["key"].to_numpy()]), np.concatenate([fp, pdf["fp"].to_numpy()])
        if large is not None:
            k = int(np.searchsorted(key, large, "right"))
            if k:
                yield out(1, np.stack([key[:k], fp[:k]], 1))
                key, fp = key[k:], fp[k:]
            if len(key):
                large = None
            else:
                continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        yield from _scan(key, fp, starts[:-1], np.diff(starts), most, out)
        key, fp = key[starts[-1] :], fp[starts[-1] :]
        if len(key) > most:
            yield out(1, np.stack([key, fp], 1))
            large, key, fp = int(key[0]), key[:0], fp[:0]
    if len(key):
        yield from _scan(key, fp, np.array([0]), np.array([len(key)]), most, out)


def _scan(key, fp, starts, sizes, most, out) -> Iterator[pd.DataFrame]:
    edges, two = [], starts[sizes == 2]
    if len(two):
        a, b, kind = fp[two], fp[two + 1], (key[two] >> 32).astype(np.int64)
        for k in np.unique(kind):
            ok = _bucket_links(int(k))(a[kind == k] ^ b[kind == k])
            edges.append(np.stack([a[kind == k][ok], b[kind == k][ok]], 1))
    more = []
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        if n > most:
            yield out(1, np.stack([key[s : s + n], fp[s : s + n]], 1))
        else:
            more += _forest(fp[s : s + n], _bucket_links(int(key[s] >> 32)))
    edges.append(np.array(more, np.int64).reshape(-1, 2))
    yield out(0, np.concatenate(edges))


def _deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(code, rest, fp): fingerprints of large buckets without two bits; rows of one code and rest differ in these alone."""
    for pdf in batches:
        kind = pdf["a"].to_numpy() >> 32
        for k in np.unique(kind):
            fp = np.unique(pdf["b"].to_numpy()[kind == k])
            pairs = list(combinations(range(32, 64), 2)) if k == 32 else [(q, 32 + int(k)) for q in range(32)] + (list(combinations(range(32), 2)) if k == 0 else [])
            for p, q in pairs:
                rest = fp & np.array(~((1 << p) | (1 << q)) & (2**64 - 1), np.uint64).view(np.int64)
                yield pd.DataFrame({"code": np.full(len(fp), 64 * p + q, np.int32), "rest": rest, "fp": fp})


def links(distinct: DataFrame, most: int = 512) -> DataFrame:
    """(src, dst) between distinct fingerprints (column fp), joining all that are connected by differences of 1 or 2 bits.

    A fingerprint is cut into two halves. Of two within two bits, the upper halves differ by at most one bit, or else the
    lower halves agree. So the 32 variants of the upper half that lack one bit, and the lower half as it is, are index
    keys; equal keys meet in one bucket and the full difference is verified. Buckets over ``most`` are not compared pair
    by pair: their fingerprints are indexed again without any two bits that their pairs can differ in, where at most four
    fingerprints share a key and all that do are linked. No bucket is dropped, and the work is linear in its size.
    """
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    keys = [upper.bitwiseAND(F.lit(LOW ^ (1 << i))) + F.lit(i << 32) for i in range(32)] + [lower + F.lit(32 << 32)]
    variants = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(variants.mapInPandas(giving_back(lambda it: scan_buckets(it, most)), "kind int, a long, b long"), "links")
    edges = found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    large = found.where("kind = 1")
    if large.limit(1).count():
        again = large.mapInPandas(_deletions, "code int, rest long, fp long").distinct()
        near = again.groupBy("code", "rest").agg(F.min("fp").alias("src"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        edges = edges.unionByName(near.select("src", F.explode("all").alias("dst")).where("src <> dst"))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, most: int = 512) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, fp, group_fp, component_id.

    Fingerprints (see simhash64) link at two differing bits or fewer; component_id is the smallest doc_id that links reach,
    null if all there are null, and group_fp stands for the component even so. Copies share a fingerprint and are never
    compared. Texts without words, null ones too, share fingerprint 0 and link like any other. Rows that repeat each get
    their row; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(links(distinct.select("fp"), most))
    grouped = materialize(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group_fp")), "groups")
    ids = grouped.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "group_fp").select("fp", "group_fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "group_fp", "component_id")


def op5_deletion_variant_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_prints(prints: DataFrame) -> DataFrame:
    """(a, b) between rows (fp, sim), whose SimHashes sim links() joins: those of one SimHash with the least of them, and the
    least of both SimHashes of each link."""
    least = prints.groupBy("sim").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n"))
    same = prints.join(least.where("n > 1"), "sim").where("fp <> least").select("least", "fp")
    near = links(least.select(F.col("sim").alias("fp"))).join(least.select(F.col("sim").alias("src"), F.col("least").alias("u")), "src")
    near = near.join(least.select(F.col("sim").alias("dst"), F.col("least").alias("v")), "dst").select("u", "v")
    return same.union(near).toDF("u", "v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of the smallest doc_id, rows that repeat counting as one.

    Components are of texts at 0.8 or more of five-word shingle similarity. SimHashes of their shingles that deletion
    variants link at two bits are judged first. Pairs at 0.8 differ in about 10 of 64 bits, too many for deletion variants,
    so what SimHash has not joined meets in the exact join of near_copies, and no link is lost. Fingerprints of three words,
    and components by them alone, are op5's.
    """
    found = materialize(near_copies(docs, first=near_prints).select("doc_id", "text_hash", "group_fp"), "near")
    kept = found.groupBy("group_fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    kept = materialize(kept, "kept")
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    is_it = F.col("doc_id").eqNullSafe(F.col("k_id")) & (own == F.col("k_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    often = materialize(found.join(kept, same).groupBy("k_id", "k_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k_id", "k_hash"), "often")
    stay = docs.join(kept, is_it, "left_semi")
    if not often.limit(1).count():
        return stay
    once = docs.join(often, is_it, "left_semi").withColumn("__hash", own).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return stay.join(often, is_it, "left_anti").unionByName(once)
