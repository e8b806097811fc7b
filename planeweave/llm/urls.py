"""URL filters over a sorted array of 64-bit digests."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict); the first five are rules, which results name.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts blocked unless a rule says otherwise.
BLOCKED = ("casino-win.example.net", "free-bets.example.net", "cheap-pills.example.net", "adult-x.example.com", "ads-track.example.com", "spam-farm.example.org")
#: A list given in memory is handed to executors as one file up to here; a longer one goes the way of a table.
MOST_BYTES = 1 << 28
#: (application, file name) of what has been handed out: a file of one content is added once.
_SHIPPED: set[tuple[str, str]] = set()


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """After the host up to ``?``, ``#`` or the end; '' for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Keys as ascending 64-bit xxhash values, their strings and values, all mapped from one file.

    Layout: n, the digests, the ends of the strings, the values (int32), the strings. find() looks the digests up by
    vectorised binary search and compares the stored string, so that two keys of one digest are told apart.
    """

    def __init__(self, path: str):
        n = int(np.memmap(path, np.int64, "r", shape=(1,))[0])
        self.n, self.digests = n, np.memmap(path, np.uint64, "r", 8, (n,)) if n else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        self.values = np.memmap(path, np.int32, "r", 16 + 16 * n, (n,)) if n else np.empty(0, np.int32)
        size = int(self.ends[-1])
        self.text = np.memmap(path, np.uint8, "r", 16 + 20 * n, (size,)) if size else np.empty(0, np.uint8)

    @staticmethod
    def build(keys: Iterable[str], values: Iterable[int], digest=lambda b: xxhash.xxh64_intdigest(b, 42)) -> bytes:
        rows = sorted({k.encode(): v for k, v in zip(keys, values)}.items(), key=lambda x: (digest(x[0]), x[0]))
        ends = np.cumsum([0, *(len(k) for k, _ in rows)], dtype=np.int64)
        parts = (np.array([len(rows)], np.int64), np.array([digest(k) for k, _ in rows], np.uint64), ends, np.array([v for _, v in rows], np.int32))
        return b"".join(x.tobytes() for x in parts) + b"".join(k for k, _ in rows)

    def find(self, probes: list[bytes], digest=lambda b: xxhash.xxh64_intdigest(b, 42)) -> np.ndarray:
        """The value of each probe, -1 where it is no key."""
        out = np.full(len(probes), -1, np.int64)
        if not self.n or not probes:
            return out
        d = np.fromiter(map(digest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.digests, d)
        near = np.minimum(at, self.n - 1)
        for i in np.flatnonzero(self.digests[near] == d):
            j = int(at[i])
            while j < self.n and self.digests[j] == d[i]:
                if self.text[int(self.ends[j]) : int(self.ends[j + 1])].tobytes() == probes[i]:
                    out[i] = self.values[j]
                    break
                j += 1
        return out


def ship(spark, array: bytes) -> str:
    """Hands the array to every executor, present and future, as a file of its own; returns the file's name."""
    name = f"urls-{hashlib.sha256(array).hexdigest()[:24]}.bin"
    if (spark.sparkContext.applicationId, name) not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="planeweave-urls-")
        with open(os.path.join(folder, name), "wb") as f:
            f.write(array)
        spark.sparkContext.addFile(os.path.join(folder, name))
        _SHIPPED.add((spark.sparkContext.applicationId, name))
    return name


def listed_hosts(hosts: DataFrame, listed: DataFrame, shard_keys: int = 1 << 20) -> DataFrame:
    """(host, listed) for the hosts (column host) that are in the list (column host) or below a host in it: the longest such.

    The list is cut by a hash into digest arrays of about shard_keys keys; each is built, mapped and probed in a task of its own,
    with the distinct suffixes that fall to it. A host has as many suffixes as the longest entry of the list has labels.
    """
    keys = listed.select(F.col("host").alias("key")).where("key <> ''").distinct()
    most = keys.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 0
    labels = F.least(F.size(F.split("host", r"\.", -1)), F.lit(most))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(labels, F.lit(1))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    probes = hosts.where("host <> ''").select("host").distinct().select("host", F.explode(suffixes).alias("key"))
    asked = probes.select("key").distinct()
    shards = max(1, -(-max(keys.count(), asked.count()) // shard_keys))
    dealt = lambda df: df.select("key", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).groupBy("shard")

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "keys")
            with open(path, "wb") as f:
                f.write(DigestArray.build(right["key"], range(len(right))))
            hit = DigestArray(path).find([k.encode() for k in left["key"]]) >= 0
        return left.loc[hit, ["key"]]

    hits = dealt(asked).cogroup(dealt(keys)).applyInPandas(found, "key string")
    return probes.join(hits, "key").groupBy("host").agg(F.max_by("key", F.length("key")).alias("listed"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocked: Iterable[str] | DataFrame = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row.

    A rule fits its host and all subdomains where the path starts with the rule's path; of those that fit, the longest
    ``host + path`` wins. Where none fits, the verdict is block if the host or a parent of it is in ``blocked``, the longest of
    which ``listed`` names, and allow otherwise. blocked is a list in memory or, of any size, a table with a column host (see
    listed_hosts). Each url probes one sorted digest array with the suffixes of its host, of as many labels as the longest
    entry has, alone and with every rule-path length of its path. Null urls and urls without ``://`` have an empty host and
    path, which no rule fits. Rows that repeat are judged each; null ids stay; an empty table gives no rows.
    """
    rules, table = list(rules), None
    if isinstance(blocked, DataFrame):
        table, blocked = blocked, ()
    else:
        blocked = list(blocked)
        if sum(map(len, blocked)) + 20 * len(blocked) > MOST_BYTES:
            table, blocked = pages.sparkSession.createDataFrame([(h,) for h in blocked], "host string"), ()
    entries = [f"r{h}{p}" for h, p, _ in rules] + [f"h{h}" for h in blocked]
    names = [f"{h}{p}" for h, p, _ in rules]
    verdicts = [v for _, _, v in rules]
    sizes = sorted({len(p) for _, p, _ in rules})
    hosts = {h for h, _, _ in rules}
    most = max((h.count(".") + 1 for h in (*hosts, *blocked)), default=1)
    name = ship(pages.sparkSession, DigestArray.build(entries, range(len(entries))))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = DigestArray(SparkFiles.get(name))
        for pdf in batches:
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"])):
                host = ".".join(host.rsplit(".", most)[-most:])
                while host:
                    keys = [b"h" + host.encode()]
                    if host in hosts:
                        keys += [f"r{host}{path[:k]}".encode() for k in sizes if len(path) >= k]
                    probes += keys
                    owner += [i] * len(keys)
                    host = host.partition(".")[2]
            found = array.find(probes)
            rule, listed = [None] * len(pdf), [None] * len(pdf)
            for k in np.flatnonzero(found >= 0):
                i, v = owner[k], int(found[k])
                if v >= len(rules):
                    listed[i] = listed[i] or entries[v][1:]
                elif rule[i] is None or len(names[v]) > len(names[rule[i]]):
                    rule[i] = v
            pdf["rule"] = pd.Series([None if r is None else names[r] for r in rule], index=pdf.index, dtype=object)
            pdf["verdict"] = pd.Series([verdicts[r] if r is not None else "block" if x else "allow" for r, x in zip(rule, listed)], index=pdf.index, dtype=object)
            pdf["listed"] = pd.Series(listed, index=pdf.index, dtype=object)
            yield pdf

    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    out = rows.mapInPandas(judged, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string, listed string")
    if table is None:
        return out
    out = out.drop("listed").join(listed_hosts(rows.select("host"), table), "host", "left")
    verdict = F.when(F.col("rule").isNull() & F.col("listed").isNotNull(), F.lit("block")).otherwise(F.col("verdict"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def op2_digest_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({text(h)}, {text(p)}, {text(v)})" for h, p, v in RULES)
    listed = ", ".join(f"({text(h)})" for h in BLOCKED)
    return rf"""
with rules(h, p, v) as (values {rules}), listed(h) as (values {listed}),
u as (select page_id, coalesce(url, '') as url, row_number() over () as n from pages),
s as (select *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from u),
best as (select n, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from s join rules
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
select page_id, host, path, rule, coalesce(v, case when exists (select 1 from listed where host = h or ends_with(host, '.' || h)) then 'block' else 'allow' end) as verdict
from s left join best using (n)"""


SQL = _sql()
