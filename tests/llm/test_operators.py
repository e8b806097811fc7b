"""The ten operators on small tables, against brute force, round trips or held-out labels."""

import math
import os
import pickle
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planeweave.llm import chat, licenses, lm, media, mixing, packing, simhash, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string"
ODD = [None, "a <|endoftext|> b<|endoftext|>", "", " \t\n", "one", "Two words", "x" * 50_000, "é ü 日本 語"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns that clash with the operators' own."""
    rows = [(i, t, None, None if i % 3 else "a", None, "s", "f") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "null id", None, "b", 1, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_top_k_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 4]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2001, None), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2020, [1.0]), (None, [0.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect()
    v = {i: np.floor(64 * np.array(x)) for i, x in rows if i is not None and x and None not in x and not np.isnan(x).any()}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.org/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12#x": ("example.org", "/en/12", "example.org/en/1", "block"), "https://w.com/fr/": ("w.com", "/fr/", "com/fr/", "allow"),
        "https://adult-x.example.com/": ("adult-x.example.com", "/", None, "block"), "https://notcom/fr/": ("notcom", "/fr/", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))
    listed = spark.createDataFrame([(h,) for h in (*urls.BLOCKED, None, "", *urls.BLOCKED)], "host string")
    by_table = urls.judge_urls(df.unionByName(df), blocked=listed).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in by_table) == sorted(2 * [(i, *(x or "" for x in v)) for i, v in got.items()])


def test_listed_hosts_in_shards(spark):
    rng = np.random.default_rng(4)
    name = lambda: ".".join(rng.choice(["a", "b", "c", ""], rng.integers(1, 6)))
    listed, hosts = {name() for _ in range(60)}, {name() for _ in range(300)} | {"." * 5000}
    frame = lambda rows: spark.createDataFrame([(h,) for h in rows], "host string")
    got = {r.host: r.listed for r in urls.listed_hosts(frame(hosts), frame(listed), shard_keys=20).collect()}
    tails = lambda h: [h[i:] for i in range(len(h)) if not i or h[i - 1] == "."]
    want = {h: max((t for t in tails(h) if t and t in listed), key=len, default=None) for h in hosts}
    assert got == {h: t for h, t in want.items() if t}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty).count() == 0 and urls.judge_urls(empty, blocked=frame(listed)).count() == 0


def test_op1_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    rows = [(0, [1e300, 1.0]), (1, [1e12, 1.0]), (20, [1e12, 0.0]), (40, [1e307, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = topk.top_k(spark.createDataFrame([(*r, "x", 1) for r in rows], kind + ", v string, rank int"), k=2).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (20, 1, 0, 2**63 - 1), (20, 2, 1, 2**63 - 1)]


@pytest.mark.parametrize("kind", ["all directions", "clusters", "few values", "beyond 24 bits", "beyond 64 bits"])
def test_tree_search_is_exact_and_multiplies_in_blocks(kind, monkeypatch):
    rng = np.random.default_rng(7)
    if kind == "clusters":
        x = rng.integers(-500, 500, (20, 16))[rng.integers(0, 20, 1500)] + rng.integers(-4, 5, (1500, 16))
    else:
        x = {"all directions": rng.normal(0, 8, (3000, 64)).round(), "few values": rng.integers(-1, 2, (900, 4)), "beyond 24 bits": 2**20 + rng.integers(-3, 4, (900, 4)), "beyond 64 bits": rng.integers(-1, 2, (200, 4)) * [2.0**51, 2**20, 2**20, 2**20]}[kind]
    x, ids, calls, k = x.astype(float), rng.permutation(len(x)), [], 5
    q = np.flatnonzero(ids % 4 == 0)
    offer = topk.TopK.offer
    monkeypatch.setattr(topk.TopK, "offer", lambda *a: calls.append(0) or offer(*a))
    top = topk.search(x[q], ids[q], np.full(len(q), -np.inf), x, ids, k)
    whole = [[int(v) for v in r] for r in x]
    score = lambda i, j: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[i], whole[j]))))
    scores = [[score(i, j) for j in range(len(x))] for i in q] if kind == "beyond 64 bits" else (x[q] @ x.T).astype(np.int64).tolist()
    want = {(int(ids[i]), j, -s) for i, row in zip(q, scores) for s, j in sorted((-s, int(j)) for s, j in zip(row, ids) if j != ids[i])[:k]}
    assert {tuple(map(int, r)) for r in zip(*top.found())} == want
    # 750 queries x 3,000 vectors in all directions, of which no bound spares any: before, one product for each pair of leaves
    assert kind != "all directions" or len(calls) <= 60


def test_small_cells_share_a_query_block():
    counts = {(64, c): n for c, n in enumerate([10, 20, 80, 5, 250, 30, 60])}
    assert topk.blocks_of(counts, 100) == {(64, 0): (0, 1), (64, 1): (0, 1), (64, 2): (1, 1), (64, 3): (1, 1), (64, 4): (2, 3), (64, 5): (5, 1), (64, 6): (5, 1)}
    assert topk.blocks_of({}, 100) == {}


def test_digests_that_collide_are_told_apart(tmp_path):
    same = lambda b: 7
    (tmp_path / "x").write_bytes(urls.DigestArray.build(["a", "b"], [1, 2], same))
    assert urls.DigestArray(str(tmp_path / "x")).find([b"b", b"c", b"a"], same).tolist() == [2, -1, 1]


def test_licenses(spark, odd):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"
    df = spark.createDataFrame([(1, f"x CC-BY\n{notice}\nAll rights reserved cc  by", "q"), (2, "cc. by ccby", "q"), (3, "see\n" + "\n".join(notice.split()), "q"), (4, "Released under the MIT\nLicense.", "q"), (5, "under the license of mitre", "q")], "doc_id long, text string, labels string")
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan_licenses(df).collect()}
    n = len(notice.replace(",", "").split())
    assert got == {1: (3, 1, 1 + 2 + n + 3, "cc-by,reserved", "cc-by,mit,reserved"), 2: (1, 0, 0, "cc-by", "cc-by"), 3: (0, None, None, "", "mit"), 4: (0, None, None, "", "mit"), 5: (0, None, None, "", "")}
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(odd.where("false")).count() == 0


@pytest.mark.parametrize("most", [512, 2])
def test_simhash_components(spark, odd, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 90_000))
    near = [(50_000 + i, "base words stay here " * 40 + f"tail {i}") for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, most=most).collect()}
    fp = {r.doc_id: simhash.simhash64(r.text) for r in docs.collect()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in fp}


def test_mix(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, bucket_rows=16).collect()
    assert sorted(rows) == sorted(mixing.mix(docs, bucket_rows=16).collect()) and len(rows) == docs.count()
    # targets by sharing out the excess again and again
    held, by = {}, {}
    texts = {r.doc_id: r for r in docs.collect()}
    for r in texts.values():
        held[r.source] = held.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted(held, key=lambda x: (x is None, (x or "").encode()))
    weight, want, open_, left = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}, {}, set(order), 1.5 * sum(held.values())
    while open_:
        full = {x for x in open_ if left * weight[x] / sum(weight[y] for y in open_) >= 2 * held[x]}
        if not full:
            want |= {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
            break
        want |= {x: 2.0 * held[x] for x in full}
        left, open_ = left - sum(2 * held[x] for x in full), open_ - full
    for r in rows:
        x = texts[r.doc_id].source
        assert r.taken == r["size"] * r.copies <= 2 * r["size"] == 2 * len((texts[r.doc_id].text or "").encode().split())
        assert r.source_size == held[x] and math.isclose(r.target, want[x])
        t = by.setdefault(x, [0, 0])
        t[0], t[1] = t[0] + r.taken, max(t[1], r["size"])
    assert all(abs(t - want[x]) <= most for x, (t, most) in by.items())
    again = mixing.mix(docs.repartition(7), bucket_rows=16).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    hot = spark.createDataFrame([(1, "one two", "s")] * 500 + [(None, "three four", "s")] * 500, "doc_id long, text string, source string")
    got = mixing.mix(hot, bucket_rows=16).collect()
    assert len(got) == 1000 and abs(sum(r.taken for r in got) - 3000) <= 2
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.where("false")).count() == 0


def test_packing_round_trip(spark, odd):
    import public_tokenizers as pt
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 90_000).alias("doc_id"), "text").where("doc_id is not null").dropDuplicates(["doc_id"]))
    pieces, seqs = {}, {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for r in docs.collect():
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist()
        assert ids == tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and {p.doc_tokens for p in own} == {len(ids)}
    for s in seqs.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *(p.length for p in s)])[:-1].tolist()
        total = sum(p.length for p in s)
        assert total <= 1024 and (total & (total - 1)) == 0


def test_packing_keeps_long_ids_beside_null_ones(spark):
    rows = [(2**60 + 1, "a"), (None, "b"), (-(2**60) - 1, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}


def test_toxicity_held_out(spark, odd):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = {r.doc_id: r.toxic for r in read("labels").collect()}
    rows = [(labels[r.doc_id], r.score) for r in toxicity.score_toxicity(read("documents"), read("labels")).collect() if r.held_out and r.doc_id in labels]
    bad, good = [s for t, s in rows if t], [s for t, s in rows if not t]
    assert np.mean([s >= 0.5 for s in bad]) > 0.9 and np.mean([s >= 0.5 for s in good]) < 0.02, (np.mean([s >= 0.5 for s in bad]), np.mean([s >= 0.5 for s in good]))
    none = read("labels").where("false")
    assert [r.predicted for r in toxicity.score_toxicity(odd, none).collect()] == [0] * odd.count()


@pytest.mark.parametrize("common", [3, 1000])
def test_block_max_search_is_exact(common):
    rng = np.random.default_rng(3)
    said = [(rng.choice(60, 6, False), rng.integers(1, 4, 6)) for _ in range(300)] + [(np.empty(0, np.int64), np.empty(0))]
    index = toxicity.BlockMaxIndex(list(range(301)), np.zeros(301, int), np.ones(301), said, rng.random(60) + 1, block=8, common=common)
    dense = np.zeros((301, 60))
    for e, (t, w) in enumerate(index.unit_of):
        dense[e, t] = w
    asked = np.arange(1, 60, 3)
    for but in (None, asked):
        for q, (cosine, near) in zip(asked, index.search([index.unit_of[q] for q in asked], 5, but, first=2)):
            cos = dense @ dense[q]
            want = sorted((-c, e) for e, c in enumerate(cos) if c > 0 and (but is None or e != q))[:5]
            assert np.allclose(cosine, [-c for c, _ in want]) and len(near) == len(want)
    assert len(index.search([(np.empty(0, np.int64), np.empty(0))], 5)[0][0]) == 0


def test_pickled_index_is_small_and_the_same():
    rng = np.random.default_rng(4)
    said = [(rng.choice(2000, n, False), rng.integers(1, 300, n)) for n in [0, *rng.integers(1, 400, 200)]]
    index = toxicity.BlockMaxIndex(list(range(201)), np.zeros(201, int), np.ones(201), said, rng.random(2000) + 1)
    index.said = None
    sent = pickle.dumps(index, 5)
    back = pickle.loads(sent)
    assert len(sent) < index.val.nbytes
    for (c, e), (d, f) in zip(*(x.search([index.unit(*v) for v in said], 16) for x in (index, back))):
        assert (c == d).all() and (e == f).all()


def test_freed_memory_goes_back():
    code = """
import re
from planeweave.plans.storage import give_back
held = lambda: sum(map(int, re.findall(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
give_back()
least = held()
parts = [bytearray(100_000) for _ in range(1000)]
last = bytearray(100_000)
del parts
freed = held()
give_back()
print(least, freed, held())
"""
    least, freed, after = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout.split())
    assert freed > least + 50 and after < least + 20


def test_chat_round_trip_and_layouts(spark):
    texts = [None, "", "\\", "\\h", "###", "</turn>", "\\### Assistant: </turn> ok\\", "a\n### user: b</turn>\n", "\\\\t"]
    rows = [(c, t, r, x) for c, r in enumerate(["user", "assistant", None, "we:ird###"]) for t, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.turns_of_rows(df))).collect()}
    for c, r in back.items():
        want = [((role or ""), x or "") for k, _, role, x in rows if k == c]
        assert [tuple(t) for t in r.turns_read] == want and r.loss_texts == [x for role, x in want if role == "assistant"]
    records = ['{"prompt":"a","completion":"b"}', '{"output":"o","instruction":"i","input":""}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":null}]}', '{"x":1}', "broken", None, '{"messages":[{"role":"user","content":"q"}],"id":3}']
    got = [(r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(spark.createDataFrame([(x, i) for i, x in enumerate(records)], "record string, layout int").coalesce(1)).collect()]
    assert got == [("prompt_completion", [("user", "a"), ("assistant", "b")]), ("instruction_input_output", [("user", "i"), ("assistant", "o")]), ("conversations", [("user", "h"), ("assistant", "")]), (None, None), (None, None), (None, None), ("messages", [("user", "q")])]


def test_all_elements_of_a_list_count(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","text":"a"}]}', '{"messages":[{"role":"user","name":"x","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"messages":[null,{"role":"user","content":"q"}]}', '{"messages":[{"role":"user","content":"q"},{"role":"user","content":"q","text":"z"}]}', '{"messages":[{"role":"user","content":"q"},{"role":"tool","result":"z"}]}',
    ]
    got = [(r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(spark.createDataFrame([(x,) for x in records], "record string").coalesce(1)).collect()]
    two = [("user", "q"), ("assistant", "a")]
    assert got == [("messages_mixed", two), ("messages", two), ("messages", [("user", "q")]), ("messages_mixed", None), (None, None)]


def test_rows_go_through_the_fingerprint(spark, monkeypatch):
    rows = [(1, 0, "User", None, "x"), (1, 1, "bot", "a", "x"), (None, None, None, "b", "x")]
    tables = [spark.createDataFrame(rows, f"{names}, turns string") for names in ("conv_id long, turn long, role string, text string", "dialog_id long, position long, `from` string, value string", "conversation_id long, turn_id long, speaker string, content string")]
    want = {1: [("User", ""), ("bot", "a")], None: [("", "b")]}
    said = lambda df: {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in chat.turns_of_rows(df).collect()}
    assert all(said(t) == want for t in tables)
    nested = spark.createDataFrame([("p", "c", None, 1), (None, None, [("user", "q")], 2), ("p", None, [("user", "q")], 3)], "prompt string, completion string, messages array<struct<role:string,content:string>>, id int")
    got = chat.canonical_turns(nested.select(F.struct("*").alias("record"))).collect()
    assert [r.layout for r in got] == ["prompt_completion", "messages", None]
    assert said(tables[0].where("false")) == {}
    odd = tables[0].select("conv_id", "turn", F.lit(1).alias("formatted"), F.lit(2).alias("loss_mask"), F.lit(3).alias("x"))
    assert said(odd) == {1: None, None: None}
    monkeypatch.setitem(chat.LAYOUTS, "messages_text", (("messages[].role", "messages[].other"), chat.LAYOUTS["messages_text"][1]))
    assert said(tables[0]) == {1: None, None: None}


@pytest.mark.parametrize("updates", [2, 4])
def test_every_training_document_is_in_a_step(spark, monkeypatch, updates):
    seen = []

    def gradient(mine, model, weights):
        seen.extend(r.doc_id for r in mine.select("doc_id").collect())
        return np.zeros(weights.shape), np.zeros(weights.shape)

    monkeypatch.setattr(lm, "gradient", gradient)
    docs = spark.createDataFrame([(i, f"some words {i}", i % 7 == 2) for i in range(300)], "doc_id long, text string, held_out boolean")
    lm.train(docs, updates=updates)
    assert sorted(seen) == [i for i in range(300) if i % 7 != 2]


def test_language_model(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = lm.score_texts(docs, updates=2).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = docs.collect()
    c = Counter(w for r in texts if not held(r.doc_id) for w in lm.split_words(r.text))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lm.split_words(t))
    want = sorted((-1 if r.doc_id is None else r.doc_id, held(r.doc_id), len(lm.split_words(r.text)), sum(w in c for w in lm.split_words(r.text)), n, round(base(r.text), 4)) for r in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    out = [r for r in rows if r.held_out]
    assert all(r.score <= 0 for r in rows) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_words_of_many_texts_at_once():
    rng = np.random.default_rng(6)
    odd = [" a", "b ", "\t\n\x0b\x0c\r", "a\x1cB\x1d\x1e\x1f\x85c\xa0d\u3000e\u2028f", "\x00 \x00", "İSTANBUL ÀÉ ß K", "x" * 70_000, "a  A\ta"]
    texts = [None, "", *odd, *("".join(rng.choice(list("aAbÉ \t\n\u3000"), n)) for n in rng.integers(0, 60, 200)), ""]
    m = lm.LanguageModel([b"a", b"b"], np.ones(2), {b"a": 5.0}, np.ones((lm.BUCKETS, 2)), np.arange(lm.BUCKETS) % 3, 64)
    held = {b"a": 0, b"b": 1}
    assert lm.words_of_all(pa.array(texts).slice(9, 150))[0].to_pylist() == [w for t in texts[9:159] for w in lm.split_words(t)[:-1]]
    for some in (texts, texts[:1], ["a b"], []):
        want = [lm.split_words(t) for t in some]
        words, inner, sizes = lm.words_of_all(some)
        assert words.to_pylist() == [w for x in want for w in x[:-1]] and sizes.tolist() == list(map(len, want))
        assert inner.tolist() == [w != lm.END for x in want for w in x] and lm.endings(words).tolist() == [lm.ending(w) for x in want for w in x[:-1]]
        ids, row, cls, starts, rare = m.encode(some)
        flat = [w for x in want for w in (*[None] * lm.EDGE, *x)]
        assert ids.tolist() == [m.m if w is None else held.get(w, -1) for w in flat]
        assert row.tolist() == [m.rows - 1 if w is None else zlib.crc32(w) % (m.rows - 1) for w in flat]
        assert cls.tolist() == [0 if w is None else m.class_of(w) for w in flat]
        assert starts.tolist() == np.cumsum([0, *(len(x) + lm.EDGE for x in want)])[:-1].tolist() and rare == [[w for w in x if w not in held] for x in want]


def test_probabilities_add_up():
    """Over all training tokens and one unseen token for each class of endings, after any tokens."""
    tokens, counts = [b"a", b"b", b"", b"cab", b"zzz", b"xyz"], np.array([5.0, 4, 3, 2, 2, 1])
    sizes = np.zeros((lm.BUCKETS, 2))
    for t, c in zip(tokens[2:], counts[2:]):
        sizes[lm.ending(t)] += c, 1
    m = lm.LanguageModel(tokens[:4], counts[:4], {b"a": 5.0, b"b": 4.0}, sizes, np.arange(lm.BUCKETS) % 3, 64)
    m.weights += np.random.default_rng(0).normal(0, 1, m.weights.shape).astype(np.float32)
    for before in (b"", b"a unknown zzz b", b"b b b"):
        total = 0.0
        for t, c in [*zip(tokens, counts), *((None, k) for k in range(3))]:
            ids, row, cls, _, _ = m.encode([before.decode()])
            at = np.array([len(ids) - 1])
            cls[at] = m.class_of(t) if t is not None else 2 + c
            own = 0 if t is None or t in m.singles else math.log10(c + 1)
            total += 10 ** (m.class_scores(row, cls, at, m.weights)[0] + m.share[cls[at]][0] + own)
        assert math.isclose(total, 1, rel_tol=1e-5)


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("rows", [16, 4096])
def test_expectations_against_brute_force(classes, rows):
    rng = np.random.default_rng(rows + classes)
    words = [b"w%d" % i for i in range(300)]
    m = lm.LanguageModel(words, np.ones(300), {b"w0": 5.0, b"w1": 4.0}, np.ones((lm.BUCKETS, 2)), np.arange(lm.BUCKETS) % classes, rows)
    m.weights = rng.normal(0, 1, m.weights.shape).astype(np.float32)
    ids, row, cls, _, _ = m.encode([" ".join(f"w{i}" for i in rng.integers(0, 350, n)) for n in (0, 1, 400, 900)])
    at = np.flatnonzero(ids != m.m)
    want, got = np.zeros((2, 4, rows, m.n_classes)), np.zeros((2, 4, rows, m.n_classes), np.float32)
    for p in at:
        f = [int(x[0]) for x in m.features(row, np.array([p]))]
        e = np.exp(m.bias + sum(m.weights[t, f[t]].astype(float) for t in range(4)))
        for t in range(4):
            want[0, t, f[t], cls[p]] += 1
            want[1, t, f[t]] += e / e.sum()
    m.expectations(row, cls, at, m.weights, got[0], got[1], chunk=256)
    assert m.n_classes == 2 + classes and (got[0] == want[0]).all() and np.allclose(got[1], want[1], rtol=1e-4, atol=1e-6)


@pytest.mark.parametrize("held", [0, 40])
def test_scores_do_not_depend_on_what_is_held(spark, held):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).persist()
    want, got = ({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in lm.score_texts(docs, updates=1, **how).collect()} for how in ({}, {"held": held}))
    assert got == want


def test_edited_copies(spark):
    rng = np.random.default_rng(5)
    images = []
    for i in range(12):
        img = np.kron(rng.integers(0, 250, (16, 16)), np.ones((5, 5))).astype(float)
        images.append((2 * i, img))
        if i < 6:
            images.append((2 * i + 1, img[6:, 4:] * 0.7 + 30))
    rows = [(i, a.shape[1], a.shape[0], bytearray(np.rint(a).astype(np.uint8).tobytes()), "c") for i, a in images]
    rows += [(100, None, None, None, None), (101, 5, 5, bytearray(3), None), (102, *rows[0][1:]), (103, 5, 5, bytearray(25), None), (None, *rows[0][1:]), rows[2]]
    df = spark.createDataFrame(rows, "image long, width int, height int, pixels binary, corners string")
    all_ = media.edited_copies(df).collect()
    got = {r.image: r.class_id for r in all_}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(6)) and got[102] == got[None] == 0 and len(all_) == len(rows)
    assert all(got[2 * i] == 2 * i for i in range(12)) and got[100] in (100, 101) and got[103] == 103
    assert media.edited_copies(df.where("false")).count() == 0


def test_index_of_corners_against_all_pairs(spark):
    """Crops with noise, dimmed and in a large group: links of the index over links of all pairs."""
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:64, 0:64] / 64
    images = []
    for i in range(40):
        waves = sum(rng.normal() * np.cos(np.pi * (rng.integers(1, 12) * x + rng.integers(1, 12) * y) + rng.normal()) for _ in range(40))
        img = (waves - waves.min()) / (waves.max() - waves.min()) * 250
        images += [img, img[5:, 4:] * 0.8 + 20 + rng.normal(0, 4, (59, 60))] if i else [img, *(img[a:, a // 2 :] + rng.normal(0, 2, (64 - a, 64 - a // 2)) for a in range(20))]
    pixels = [np.rint(np.clip(a, 0, 255)).astype(np.uint8) for a in images]
    made = [media.describe(a[None])[0] for a in pixels]
    root = list(range(len(images)))
    links = [(i, j) for i, j in combinations(range(len(images)), 2) if media.consensus_of(made[i], made[j]) >= 4]
    for i, j in links:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    df = spark.createDataFrame([(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in enumerate(pixels)], "image long, width int, height int, pixels binary")
    got = {r.image: r.class_id for r in media.edited_copies(df).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 100 and found >= 0.9 * len(links), (found, len(links))
    assert all(root[i] == root[got[i]] for i in got)
