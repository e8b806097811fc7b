import ctypes
import os
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planeweave.llm import packing, shingles, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        kept = after.select("doc_id").distinct().count()
        assert 0 < kept <= before.select("doc_id").distinct().count()
        before = spark.createDataFrame(after.collect(), after.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1_000_000, "", None, "x", 0), (1_000_000, "", None, "x", 0), (1_000_001, None, None, None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.unionByName(odd), SF).count()
        stage(spark, docs.where("false"), SF).count()


@pytest.mark.parametrize("most", [200, 3])
def test_near_copies_against_brute_force(spark, most, monkeypatch):
    if most == 3:  # all open buckets in blocks
        monkeypatch.setattr(shingles._across, "__defaults__", (2,))
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, rng.integers(20, 200))) for _ in range(40)]
    for t in list(texts):
        for edits in rng.integers(1, 9, 3):
            w = t.split()
            for at in rng.choice(len(w), min(edits, len(w)), False):
                w[at] = "edited"
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(words, 60))
    texts += [passage + " " + " ".join(rng.choice(words, 60)) for _ in range(20)]
    texts += [passage + f" end {i}" for i in range(20)] + ["a b", "A  b", "", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = [set(zip(*(w[k:] for k in range(5)))) if len(w := (t or "").lower().split()) >= 5 else {tuple(w)} - {()} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, j in combinations(range(len(texts)), 2):
        both = len(made[i] & made[j])
        if 5 * both >= 4 * (len(made[i]) + len(made[j]) - both):
            pairs += made[i] != made[j] and (simhash.simhash64(texts[i]) ^ simhash.simhash64(texts[j])).bit_count() > 2
            root[max(find(i), find(j))] = min(find(i), find(j))
    group, first = {r.doc_id: r.group_fp for r in shingles.near_copies(docs, most=most, block=256 if most == 200 else 5).collect()}, {}
    for i in range(len(texts)):
        first.setdefault(group[i], i)
    assert pairs > 20 and [first[group[i]] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    if most == 200:
        assert sorted(r.doc_id for r in simhash.dedup_stage(spark, docs, SF).collect()) == sorted({find(i) for i in range(len(texts))})


def test_simhash_finds_near_copies(spark, monkeypatch):
    def none(batches):
        for pdf in batches:
            yield pdf.iloc[:0, :0].assign(a=[], b=[]).astype("int64")

    # without the exact join, SimHash has to find what is within two bits
    monkeypatch.setattr(shingles, "_to_middle", none)
    monkeypatch.setattr(shingles, "_across", lambda buckets, *_: buckets.selectExpr("0L a", "0L b").where("false"))
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, rng.integers(300, 900))) for _ in range(30)]
    for t in list(texts):
        for edits in (1, 1, 8):
            w = t.split()
            for at in rng.choice(len(w), edits, False):
                w[at] = "edited"
            texts.append(" ".join(w))
    made = [shingles.shingle_set(t, shingles.WordHashes()) for t in texts]
    sims = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in made]
    assert [shingles.set_simhash(s) % 2**64 for s in made] == sims
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if (sims[i] ^ sims[j]).bit_count() <= 2 and shingles.similar(made[i], made[j]):
            root = [root[i] if r == root[j] else r for r in root] if root[i] < root[j] else [root[j] if r == root[i] else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.dedup_stage(spark, docs, SF).collect())
    assert kept == sorted(set(root)) and 30 < len(kept) < 100


def test_packed_ids_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.length for r in rows)


NONE = np.empty(0, np.int64), np.empty(0, np.int64)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library can't give memory back")
@pytest.mark.parametrize("stage", [packing.pack, lambda docs: shingles._prints(docs.select("doc_id", "text", F.lit(0).alias("text_hash")), NONE, 5)], ids=["packing", "near copies"])
def test_workers_give_back_what_an_earlier_task_freed(spark, stage, monkeypatch):
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    docs, made = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(docs), name, lambda self, f, schema: made.append(f) or self)
    stage(docs)
    monkeypatch.undo()
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Here", (), {"partitionId": staticmethod(lambda: 0)}))}))
    list(made[0](iter([])))
    before = held()
    hoard = [bytes(1000) for _ in range(200_000)]
    hoard[:] = hoard[::100]  # what stays keeps the rest from being returned by itself
    freed = held()
    list(made[0](iter([])))
    assert freed - before > 100 and held() - before < 50 and len(hoard) == 2000
