"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planeweave.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, size), one row for each source, null being one.

    Weights go round in code-point order of the sources, null last. A target is ``least(cap * source_size, level *
    weight)`` with the one level at which the targets add up to ``share`` of all sizes: what sharing out the excess again
    and again tends to. Reads one row per source, in one ordered window.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = by.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = W.orderBy("full", "rank")
    levels = (
        ranked.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full", F.col("most") / F.col("weight"))
        .withColumn("below", F.sum("most").over(w.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce("below", F.lit(0.0))) / F.col("open"))
        .withColumn("level", F.when(F.col("level") <= F.col("full"), F.col("level")))
        .withColumn("level", F.first("level", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most")
    return levels.select("source", "source_size", "n_rows", target.alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Rounds probabilities in sequence, so that the sum of size * p stays; one at most is left between 0 and 1.

    Each step pairs the one still open with the next and moves mass between them, up or down at random with the odds that
    keep both expectations, until one of the two is 0 or 1. With last, the one left is rounded to the nearer whole.
    """
    p, open_, draws = p.tolist(), -1, rng.random(len(p)).tolist()
    size = size.tolist()
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_ < 0:
            open_ = j
            continue
        i, r = open_, size[open_] / size[j]
        up, down = min(1 - p[i], p[j] / r), min(p[i], (1 - p[j]) / r)
        if draws[j] * (up + down) < down:
            if up == 1 - p[i]:
                p[i], p[j] = 1.0, p[j] - up * r
            else:
                p[i], p[j] = p[i] + up, 0.0
        elif down == p[i]:
            p[i], p[j] = 0.0, p[j] + down * r
        else:
            p[i], p[j] = p[i] - down, 1.0
        for k in (i, j):
            if abs(p[k] - round(p[k])) < 1e-12:
                p[k] = float(round(p[k]))
        open_ = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    if last and open_ >= 0:
        p[open_] = float(p[open_] >= 0.5)
    return np.array(p)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42, bucket_rows: int = 2048, row_col: str | None = None) -> DataFrame:
    """How many copies of each document the mix takes: row_id, doc_id, size, source_size, target, copies, taken.

    size is the number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null or empty: 0). A document's expected number
    of copies is target / source_size; the whole part is certain, and the fractions of a source are rounded by pairwise
    transfers that keep the sum of size * fraction. Documents of a source are dealt into buckets of about bucket_rows by a
    hash of their id and text, and a bucket that rows of one id and text overfill is split by row; each bucket leaves one fraction at most, and these residuals go through the same step, level after
    level, until one bucket for each source is left, so that no task sees more than a bucket however large a source is.
    Draws depend on seed, source, ids and texts alone, so reruns agree; rows that repeat are documents of their own, and which
    of a thousand equal ones gets a copy more may differ with the order of files. row_id is row_col, a whole number unique to
    each row, or else made here. Documents of size 0 take whole copies by their hash, which moves no words. A null source is a source; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("draw"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = materialize(sized, "sized")
    targets = materialize(source_targets(sized, weights, share, cap), "targets")
    n_sources, most_rows = targets.agg(F.count(F.lit(1)), F.max("n_rows")).first()
    small = F.broadcast if n_sources <= 50_000 else (lambda df: df)
    right = targets.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    uniform = F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = (
        sized.join(small(right), F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("rate", rate)
        .withColumn("copies", F.floor("rate").cast("long"))
        .withColumn("part", F.col("rate") - F.floor("rate"))
        .withColumn("copies", F.when((F.col("size") == 0) & (uniform < F.col("part")), F.col("copies") + 1).otherwise(F.col("copies")))
        .withColumn("part", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("part")))
    )

    def level(open_rows: DataFrame, most: int, number: int) -> DataFrame:
        n = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(bucket_rows))).cast("long") if most > bucket_rows else F.lit(1)
        keyed = open_rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + number), "draw"), n)).withColumn("part_of", F.lit(0).cast("long"))
        full = keyed.groupBy(F.col("source").alias("of"), F.col("bucket").alias("at")).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 2 * bucket_rows)
        if most > bucket_rows and full.limit(1).count():
            split = F.when(F.col("held").isNotNull(), F.pmod(F.xxhash64("row_id"), F.ceil(F.col("held") / bucket_rows).cast("long"))).otherwise(F.col("part_of"))
            keyed = keyed.join(full, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")), "left").withColumn("part_of", split)
        last = most <= bucket_rows

        def rounded(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "draw", "row_id"], ascending=[False, True, True], kind="stable")
            name = f"{seed}|{number}|{key[0]!r}|{key[1]}|{key[2]}".encode()
            p = pivot(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), np.random.default_rng(zlib.crc32(name)), last)
            return pdf.assign(part=p)[["row_id", "draw", "source", "size", "part"]]

        key = ["source", "bucket", "part_of"]
        schema = f"row_id long, draw long, source {dict(sized.dtypes)['source']}, size long, part double"
        return materialize(keyed.select("row_id", "draw", "size", "part", *key).groupBy(*key).applyInPandas(rounded, schema), "rounded")

    settled, number, most = [], 0, most_rows or 0
    rows = rated.where("part > 0").select("row_id", "draw", "source", "size", "part", "n_rows")
    while True:
        done = level(rows, most, number)
        settled.append(done.where("part = 1").select("row_id"))
        if most <= bucket_rows:
            break
        left = materialize(done.where("part > 0 and part < 1"), "left")
        counts = left.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n_rows"))
        most = counts.agg(F.max("n_rows")).first()[0] or 0
        rows = left.join(small(counts), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        number += 1
    more = settled[0]
    for df in settled[1:]:
        more = more.unionByName(df)
    more = more.withColumn("one", F.lit(1))
    copies = F.col("copies") + F.coalesce("one", F.lit(0))
    return rated.join(more, "row_id", "left").select("row_id", "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op6_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row_key"), "*"), "keyed")
    taken = mix(rows.select("row_key", "doc_id", "text", "source"), row_col="row_key")
    kept = rows.join(taken.where("copies > 0").select(F.col("row_id").alias("row_key"), F.col("copies").cast("int").alias("mix_copies")), "row_key")
    return kept.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)
