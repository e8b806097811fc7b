"""LM scoring: exact unigram counts, and a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.plans.storage import materialize

BUCKETS = 512  # of word endings
END = b""  # no word is empty
CLOSING = b".,;:!?)\"'"
EDGE = 3  # places before a text's first word
BLOCK = 64  # rows of weights that are summed together


def split_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then END."""
    return [*((text or "").encode().lower().split()), END]


def words_of_all(texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """split_words of many texts at once, in Arrow: all tokens but the ENDs, which of all places are not an END's, and how many each text has."""
    if isinstance(texts, pa.Array):  # taken, as Arrow lower-cases slices wrongly
        made = texts.take(pa.array(np.arange(len(texts)))).fill_null("").cast(pa.large_string())
    else:
        made = pa.array([t or "" for t in texts], pa.large_string())
    made = pc.ascii_split_whitespace(pc.ascii_lower(made))
    flat, ends = made.flatten(), made.offsets.to_numpy().astype(np.int64)
    word = pc.binary_length(flat).to_numpy() > 0
    if not word.all():
        flat, ends = flat.filter(pa.array(word)), np.r_[0, np.cumsum(word)][ends]
    sizes = np.diff(ends) + 1
    inner = np.ones(sizes.sum(), bool)
    inner[sizes.cumsum() - 1] = False
    return flat.cast(pa.large_binary()), inner, sizes


def endings(words: pa.Array) -> np.ndarray:
    """ending of each word."""
    tails = pc.binary_slice(pc.ascii_rtrim(words.cast(pa.large_string()), CLOSING.decode()).cast(pa.large_binary()), -3).dictionary_encode()
    return np.array([zlib.crc32(t) % BUCKETS for t in tails.dictionary.to_pylist()], np.int64)[tails.indices.to_numpy()]


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)) == part


def ending(word: bytes) -> int:
    """Bucket of a word's last three bytes, closing punctuation aside."""
    return zlib.crc32(word.rstrip(CLOSING)[-3:]) % BUCKETS


class Hashed(dict):
    """token -> row of weights and class; remembers tokens up to a bound."""

    def __init__(self, model: LanguageModel, most: int = 200_000):
        self.model, self.most = model, most

    def __missing__(self, token: bytes) -> tuple[int, int]:
        if len(self) >= self.most:
            self.clear()
        self[token] = found = (zlib.crc32(token) % (self.model.rows - 1), self.model.class_of(token))
        return found


def count_tokens(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, bucket, c) over all training texts, and (code, n): how often bucket code // BUCKETS stands before code % BUCKETS."""

    schema = pa.schema([("token", pa.binary()), ("code", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs, texts, edge = [], np.zeros(BUCKETS * BUCKETS, np.int64), 0, ending(END)

        def added() -> list[pa.Table]:
            return [pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"]).combine_chunks()] if held else []

        def flush() -> Iterator[pa.RecordBatch]:
            for t in added():
                token = t["token"].combine_chunks()
                codes = pa.array(endings(token).astype(np.int32))
                yield from pa.table([token.cast(pa.binary()), codes, t["n"]], schema=schema).to_batches(max_chunksize=10_000)
            held.clear()

        for batch in batches:
            text = batch.column(0)
            block = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // 2_000_000
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(text)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                words, inner, sizes = words_of_all(text.slice(a, b - a))
                texts += len(sizes)
                of = np.full(len(inner), edge)
                of[inner] = endings(words)
                pairs += np.bincount((of[:-1] * BUCKETS + of[1:])[inner[:-1]], minlength=len(pairs))
                found = words.value_counts()
                held.append(pa.table([found.field("values"), found.field("counts")], ["token", "n"]))
                if sum(map(len, held)) > 400_000:
                    held[:] = added()
                    if len(held[0]) > 200_000:
                        yield from flush()
        yield from flush()
        if texts:
            yield pa.record_batch([pa.array([END], pa.binary()), pa.array([edge], pa.int32()), pa.array([texts], pa.int64())], schema=schema)
        at = np.flatnonzero(pairs)
        yield pa.record_batch([pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(pairs[at])], schema=schema)

    part = training.select("text").mapInArrow(counted, "token binary, code int, n long")
    both = materialize(part.groupBy("token", "code").agg(F.sum("n").alias("n")), "tokens")
    return both.where("token is not null").select("token", F.col("code").alias("bucket"), F.col("n").alias("c")), both.where("token is null").select("code", "n")


def cluster(pairs: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """A class for each bucket: k-means over what stands before and after it, by frequency."""
    both = np.hstack([pairs, pairs.T]).astype(float)
    size = both.sum(1)
    x = np.sqrt(both / np.maximum(size, 1)[:, None])
    centres = [int(size.argmax())]
    far = ((x - x[centres[0]]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(int((far * np.sqrt(size)).argmax()))
        far = np.minimum(far, ((x - x[centres[-1]]) ** 2).sum(1))
    mean = x[centres]
    for _ in range(rounds):
        own = (-2 * x @ mean.T + (mean**2).sum(1)).argmin(1)
        for c in range(k):
            w = size * (own == c)
            if w.sum():
                mean[c] = (x * w[:, None]).sum(0) / w.sum()
    return own


class LanguageModel:
    """P(token | before) = P(class | features of the last three tokens) * P(token | class).

    The ``singles`` most frequent tokens are classes of their own; all others, seen or not, are of the class of their ending.
    P(token | class) is ``(c + 1) / (S + V + 1)`` with the class's running and distinct training tokens, so each class keeps
    one share for tokens never seen. Features: the last token, the one before, the one before that (skips), and the last two
    together; each token is hashed straight to a row of weights over classes. tokens and counts are those that a task holds
    in memory, for speed: of all others the count comes from a join, and nothing else depends on which they are.
    """

    def __init__(self, tokens: list[bytes], counts: np.ndarray, singles: dict[bytes, float], sizes: np.ndarray, classes_of: np.ndarray, rows: int):
        k = int(classes_of.max()) + 1
        self.m, self.rows, self.n_classes, self.singles, self.classes_of = len(tokens), rows, len(singles) + k, {t: i for i, t in enumerate(singles)}, classes_of
        self.known, self.end, self.hashed = pa.array(tokens, pa.large_binary()), tokens.index(END) if END in tokens else -1, None
        mass = np.array([np.bincount(classes_of, sizes[:, c], k) for c in (0, 1)])
        self.share = np.concatenate([np.zeros(len(singles)), -np.log10(mass.sum(0) + 1)])
        self.cls = np.array([self.class_of(t) for t in tokens] + [0], np.int64)
        self.row = np.array([zlib.crc32(t) % (rows - 1) for t in tokens] + [rows - 1], np.int64)
        self.base = np.r_[np.log10(counts + 1.0), 0.0]
        self.own = np.r_[np.where(self.cls[:-1] < len(singles), 0.0, self.base[:-1]), 0.0]
        total = np.concatenate([np.array([*singles.values()], float), mass[0]]) + 0.5
        self.bias = np.log(total / total.sum()).astype(np.float32)
        self.weights = np.zeros((4, rows, self.n_classes), np.float32)

    def class_of(self, token: bytes) -> int:
        return self.singles.get(token, len(self.singles) + int(self.classes_of[ending(token)]))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Of all tokens, with EDGE places before each text: id (-1: not held; m: such a place), row, class; where each text begins, and
        its tokens that are not held."""
        words, inner, sizes = words_of_all(texts)
        found = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy()
        starts = np.cumsum(sizes + EDGE) - sizes - EDGE
        at = np.arange(len(inner)) + np.repeat(EDGE * np.arange(1, len(sizes) + 1), sizes)
        ids = np.full(len(inner) + EDGE * len(sizes), self.m)
        ids[at[inner]], ids[at[~inner]] = found, self.end
        row, cls = self.row[ids], self.cls[ids]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, row, cls, starts, [[] for _ in sizes]
        self.hashed = self.hashed if self.hashed is not None else Hashed(self)
        made = words.filter(pa.array(found < 0)).dictionary_encode()
        new = [*made.dictionary.to_pylist(), END]
        number = np.full(len(ids), len(new) - 1)
        number[at[inner][found < 0]] = made.indices.to_numpy()
        number = number[odd]
        row[odd], cls[odd] = np.array([self.hashed[w] for w in new], np.int64)[number].T
        rare, cuts = [new[i] for i in number.tolist()], np.searchsorted(odd, np.r_[starts, len(ids)]).tolist()
        return ids, row, cls, starts, [rare[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def features(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b, c = row[at - 1], row[at - 2], row[at - 3]
        return a, b, c, (a * 1_000_003 + b * 8_191) % self.rows

    def odds(self, f: tuple[np.ndarray, ...], weights: np.ndarray, piece: int = 2048) -> np.ndarray:
        """e to the sum of each place's weights, by class; made in pieces that stay in a core's cache."""
        out = np.empty((len(f[0]), self.n_classes), np.float32)
        more = np.empty((min(piece, len(out)), self.n_classes), np.float32)
        for i in range(0, len(out), piece):
            z = out[i : i + piece]
            np.take(weights[0], f[0][i : i + piece], axis=0, out=z, mode="clip")  # unlike "raise", unbuffered
            for t in (1, 2, 3):
                z += np.take(weights[t], f[t][i : i + piece], axis=0, out=more[: len(z)], mode="clip")
            z += self.bias
            np.exp(z, out=z)
        return out

    def class_scores(self, row: np.ndarray, cls: np.ndarray, at: np.ndarray, weights: np.ndarray, chunk: int = 8192) -> np.ndarray:
        """log10 P(class | before) at the given places."""
        out = np.empty(len(at))
        for i in range(0, len(at), chunk):
            p = at[i : i + chunk]
            e = self.odds(self.features(row, p), weights)
            out[i : i + chunk] = np.log10(e[np.arange(len(p)), cls[p]] / e.sum(1))
        return out

    def expectations(self, row: np.ndarray, cls: np.ndarray, at: np.ndarray, weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, chunk: int = 16384) -> None:
        """Adds how often each feature came with each class, and how often the model expects it."""
        every, c = self.features(row, at), cls[at]
        for t in range(4):
            pairs, flat = every[t] * self.n_classes + c, seen[t].reshape(-1)
            if len(flat) <= 16 * len(pairs):
                flat += np.bincount(pairs, minlength=len(flat))
            else:
                pair, n = np.unique(pairs, return_counts=True)
                flat[pair] += n
        # rows are added as complex numbers, two classes at a time, which takes less than one by one
        wide = np.float32 if self.n_classes % 2 else np.complex64
        for i in range(0, len(at), chunk):
            f = [x[i : i + chunk] for x in every]
            e = self.odds(f, weights)
            e /= np.einsum("ij->i", e)[:, None]
            for t in range(4):
                rows = f[t].astype(np.uint16) if self.rows <= 1 << 16 else f[t]  # sorted by radix
                order = np.argsort(rows, kind="stable")
                rows = rows[order]
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                expected[t][rows[first]] += np.add.reduceat(e.take(order, axis=0).view(wide), first, axis=0).view(np.float32)


def _in_blocks(batches: Iterator[pd.DataFrame], tokens: int = 200_000) -> Iterator[pd.DataFrame]:
    """Rows until their texts hold about so many tokens."""
    for pdf in batches:
        sizes = pdf["text"].str.len().fillna(0).to_numpy(float).cumsum() // (6 * tokens)
        for _, part in pdf.groupby(sizes, sort=True):
            yield part


def gradient(training: DataFrame, model: LanguageModel, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all tasks of expectations(); tasks send the used rows of weights, in blocks."""
    spark = training.sparkSession
    sent = spark.sparkContext.broadcast((model, weights))
    k = model.n_classes

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, w = sent.value
        seen, expected = np.zeros(w.shape, np.float32), np.zeros(w.shape, np.float32)
        for pdf in _in_blocks(batches):
            ids, row, cls, _, _ = m.encode(pdf["text"])
            m.expectations(row, cls, np.flatnonzero(ids != m.m), w, seen, expected)
        both = np.concatenate([seen, expected], 2).reshape(-1, 2 * k)
        for i in range(0, len(both), BLOCK):
            used = np.flatnonzero(both[i : i + BLOCK].any(1))
            if len(used):
                yield pd.DataFrame({"block": [i], "rows": [used.astype(np.uint8).tobytes()], "sums": [both[i + used].tobytes()]})

    def added(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((BLOCK, 2 * k))
        for rows, sums in zip(pdf["rows"], pdf["sums"]):
            total[np.frombuffer(rows, np.uint8)] += np.frombuffer(sums, np.float32).reshape(-1, 2 * k)
        return pd.DataFrame({"block": [key[0]], "sums": [total.astype(np.float32).tobytes()]})

    parts = training.select("text").mapInPandas(summed, "block int, rows binary, sums binary")
    both = np.zeros((4 * model.rows, 2 * k), np.float32)
    for r in parts.groupBy("block").applyInPandas(added, "block int, sums binary").collect():
        both[r.block : r.block + BLOCK] = np.frombuffer(r.sums, np.float32).reshape(-1, 2 * k)[: len(both) - r.block]
    sent.unpersist()
    both = both.reshape(4, model.rows, 2 * k)
    return both[:, :, :k], both[:, :, k:]


def train(docs: DataFrame, singles: int = 32, k: int = 32, held: int = 150_000, least_rows: int = 2048, updates: int = 4) -> tuple[LanguageModel, DataFrame, dict]:
    """The model, the counts (token, c) of training tokens that it doesn't hold, and N and V.

    docs has doc_id, text, held_out. Counts, classes and P(token | class) come from every training text. Weights get
    ``updates`` gradient steps in the log domain (iterative scaling), each from the sums over its own one of
    ``updates`` parts of the training documents, chosen by a hash of doc_id, so that every one is in a step. There are as many rows
    of weights for each kind of feature as the next power of two after N ** 0.4, least_rows at least: 2,048 at 0.5 GB, about
    260,000 (0.3 GB of weights) at 100 TB. ``held`` tokens at most, the most frequent, are held by each task to spare it the
    join; results are the same for any number.
    """
    training = docs.where(~F.col("held_out"))
    counts, pairs = count_tokens(training)
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    steps = counts.withColumn("step", F.floor(4 * F.log2("c")).cast("int"))
    least, n = None, 0
    for r in sorted(steps.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        n += r.n
        if n > held:
            break
        least = r.step
    least = 1 << 20 if least is None else least
    known = sorted(steps.where(F.col("step") >= least).select("token", "c").collect(), key=lambda r: (-r.c, bytes(r.token)))
    top = {bytes(r.token): float(r.c) for r in counts.orderBy(F.desc("c"), "token").limit(singles).collect()}
    sizes = np.zeros((BUCKETS, 2))
    for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sizes[r.bucket] = r.n, r.v
    for t, c in top.items():
        sizes[ending(t)] -= c, 1
    near = np.zeros(BUCKETS * BUCKETS)
    for r in pairs.collect():
        near[r.code] = r.n
    rows = max(least_rows, 1 << int(np.ceil(0.4 * np.log2(max(1, total)))))
    model = LanguageModel([bytes(r.token) for r in known], np.array([r.c for r in known], float), top, sizes, cluster(near.reshape(BUCKETS, BUCKETS), k), rows)
    prior = np.exp(model.bias.astype(float))
    for u in range(updates):
        mine = training.where(F.pmod(F.xxhash64(F.lit(11), F.col("doc_id").cast("string")), F.lit(updates)) == u)
        seen, expected = gradient(mine, model, model.weights)
        model.weights = np.clip(model.weights + (0.4 * np.log((seen + 4 * prior) / (expected + 4 * prior))).astype(np.float32), -8, 8).astype(np.float32)
    return model, steps.where(F.col("step") < least).select("token", "c"), {"N": int(total), "V": int(types)}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, from its whole text.

    base_score adds log10((c + 1) / (N + V + 1)) over the tokens; score is the model's log10 probability of the text, its
    end included. Training rows are those whose crc32 of doc_id as text, modulo parts, is not part. Null and empty texts
    are an end alone; rows that repeat count and score each; with no training rows N and V are 0 and all tokens are
    unknown; an empty table gives no rows. Tokens that the model does not hold meet their counts in a join.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), parts, part).alias("held_out"))
    model, rare_counts, sizes = train(rows, **how)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in _in_blocks(batches):
            ids, row, cls, starts, rare = m.encode(pdf["text"])
            at = np.flatnonzero(ids != m.m)
            each = np.zeros(len(ids))
            each[at] = m.class_scores(row, cls, at, m.weights) + m.share[cls[at]] + np.where(ids[at] < 0, 0, m.own[ids[at]])
            inside = (ids >= 0) & (ids < m.m)
            n = np.diff(np.r_[starts, len(ids)]) - EDGE
            yield pd.DataFrame({
                "row_id": pdf["row_id"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(), "n_tokens": n,
                "n_known": np.add.reduceat(inside.astype(np.int64), starts), "base": np.add.reduceat(np.where(inside, m.base[ids], 0), starts), "lm": np.add.reduceat(each, starts), "rare": rare,
                "alone": [[w in m.singles for w in r] for r in rare],
            })

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lm double, rare array<binary>, alone array<boolean>"
    first = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()).mapInPandas(scored, schema), "scored")
    looked = first.select("row_id", F.explode(F.arrays_zip("rare", "alone")).alias("t")).select("row_id", F.col("t.rare").alias("token"), F.col("t.alone").alias("alone"))
    looked = looked.join(rare_counts, "token", "left").withColumn("own", F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)))
    more = looked.groupBy("row_id").agg(F.count("c").alias("more_known"), F.sum("own").alias("more"), F.sum(F.when(~F.col("alone"), F.col("own"))).alias("more_lm"))
    out = first.drop("rare", "alone").join(more, "row_id", "left")
    extra, extra_lm = F.coalesce("more", F.lit(0.0)), F.coalesce("more_lm", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(sizes["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(float(np.log10(sizes["N"] + sizes["V"] + 1)))).alias("base_score"), (F.col("lm") + extra_lm).alias("score"),
    )


def op10_hashed_maxent_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
