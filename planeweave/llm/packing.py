"""Cost-balanced packing of token ids into sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from planeweave.plans.storage import giving_back

_AWKWARD = re.compile(r"\s | \s")
_MADE: dict = {}


class ChunkIds(dict):
    """Id bytes (little-endian, 4 each) of `` chunk``: what stands between two single spaces splits off whatever is around.

    Holds most chunks of a text after a while; cleared when full, so its memory is bounded by ``most`` short strings.
    """

    def __init__(self, encode, most: int = 200_000):
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


def id_encoder(path: str | None = None, added: tuple[str, int] = ("<|endoftext|>", 50256)):
    """text -> id bytes under the public byte-level BPE of 50,257 ids, its one added token among them.

    ``path`` is the rank file of that vocabulary; by default the one beside the tokenizer file. Texts where a space stands
    next to other white space, and those that hold the added token, are encoded in one go, all others chunk by chunk with a cache; ids are the same either way
    (tests compare both with the ``tokenizers`` library).
    """
    if path not in _MADE:
        import public_tokenizers as pt
        import tiktoken

        with open(path or pt.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("byte_bpe_50k", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        cache = ChunkIds(encode)

        def ids(text: str) -> bytes:
            if added[0] in text:
                return np.array([added[1]], "<u4").tobytes().join(np.array(encode(part), "<u4").tobytes() for part in text.split(added[0]))
            if not text or _AWKWARD.search(text) or text[0].isspace() or text[-1].isspace():
                return np.array(encode(text), "<u4").tobytes()
            head, *rest = text.split(" ")
            return np.array(encode(head), "<u4").tobytes() + b"".join(map(cache.__getitem__, rest))

        _MADE[path] = ids
    return _MADE[path]


def place(lengths: list[int], width: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the number of sequences.

    Documents over ``width`` are cut every ``width`` tokens; what is left of each goes, longest first, to the sequence of
    least cost (linear * n + quadratic * n * n, summed over its pieces) that has room for it, or else is cut to fill the
    one of least cost that has any room. There are as many sequences of ``width`` as are filled to the end, and what
    remains gets sequences of powers of two, so that none needs padding.
    """
    out, n_seq, rest = [], 0, []
    for d, n in enumerate(lengths):
        full = n // width
        out += [(d, k * width, width, n_seq + k, 0) for k in range(full)]
        n_seq += full
        if n % width:
            rest.append((n % width, d, full * width))
    total = sum(n for n, _, _ in rest)
    room = np.array([width] * (total // width) + [1 << b for b in range(width.bit_length() - 1, -1, -1) if (total % width) >> b & 1], np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            fits = np.where(room >= n, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[s]))
            out.append((d, start, take, n_seq + s, int(used[s])))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            used[s] += take
            start, n = start + take, n - take
    return out, n_seq + len(room)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 0, block_tokens: int = 1 << 19, linear: float = 1.0, quadratic: float = 1.0 / 1024, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is the ids of its whole text and then end_id (null text: end_id alone). Every id lies in one piece. A task
    gathers documents until they hold block_tokens ids (one longer document is a block of its own), packs them
    (see place) and goes on, so nothing is shuffled, and memory is bounded by a block. Sequences have width tokens, or a
    power of two where a block ends: no padding. sequence_id is unique and depends on the partitioning and order of the
    input. Rows that repeat are documents of their own; an empty table gives no rows.
    """
    kind = dict(docs.select(docs[id_col].alias("doc_id")).dtypes)["doc_id"]
    tail = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer)
        base, held_id, held, size = TaskContext.get().partitionId() << 36, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            pieces, n = place([len(x) // 4 for x in held], width, linear, quadratic)
            cut = [memoryview(held[d])[4 * a : 4 * (a + k)] for d, a, k, _, _ in pieces]
            numbers = {
                "start": [x[1] for x in pieces],
                "length": [x[2] for x in pieces],
                "ids_crc32": [zlib.crc32(c) for c in cut],
                "doc_tokens": [len(held[x[0]]) // 4 for x in pieces],
                "sequence_id": [base + x[3] for x in pieces],
                "offset": [x[4] for x in pieces],
            }
            columns = [pa.array([held_id[x[0]] for x in pieces], of), *(pa.array(v, pa.int64()) for v in numbers.values()), pa.array([bytes(c) for c in cut], pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", *numbers, "ids"])
            base += n
            held_id.clear()
            held.clear()
            return out

        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            of = batch["doc_id"].type
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = (encode(text) if isinstance(text, str) else b"") + tail
                held_id.append(i)
                held.append(ids)
                size += len(ids) // 4
                if size >= block_tokens:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(giving_back(packed), schema)


def op7_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of pack(): the token ids too, 4 little-endian bytes each."""
    return pack(docs)
