"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join that removes its false positives.

A listed entry is a host and a path; it fits its host and all subdomains, and every path that starts with its path. So a URL has
one key for each suffix of its host and each prefix of its path that is as long as some listed path. All keys of a URL are tried
in the filter in one vectorised step; only possible hits leave the scan, and the join on the listed text decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.llm import text as X

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query, as (host and path, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Sites listed as unwanted; they decide where no rule fits.
LISTED_SITES = ["adult-x", "cheap-pills", "free-bets", "spam-farm"]
LISTED_ZONES = ["example.com", "example.net", "example.org"]
#: The filter is broadcast; it never exceeds this size, however long the list. A longer list only lets more false hits through.
MAX_FILTER_BITS = 1 << 26
BITS_PER_ENTRY = 16
BLOCK_BITS = 512
BITS_PER_KEY = 8


def listed(spark: SparkSession) -> DataFrame:
    """(entry, verdict, is_rule) of the query."""
    sites = [(f"{site}.{zone}/", "block", False) for site in LISTED_SITES for zone in LISTED_ZONES]
    return spark.createDataFrame([(entry, verdict, True) for entry, verdict in RULES] + sites, "entry string, verdict string, is_rule boolean")


def key_hashes(keys: list[str]) -> np.ndarray:
    blob = "".join(keys).encode()
    ends = np.cumsum(np.fromiter((len(k.encode()) for k in keys), np.int64, len(keys)))
    return X.span_hashes(X.prefix_sums(np.frombuffer(blob, np.uint8)), np.concatenate(([0], ends[:-1])), ends)


def key_bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key and its BITS_PER_KEY bit numbers inside the block."""
    block = (hashes >> np.uint64(20)) % np.uint64(blocks)
    step = X.mix(hashes ^ np.uint64(0x5BD1E995))
    bits = np.stack([(step >> np.uint64(7 * j)) & np.uint64(BLOCK_BITS - 1) for j in range(BITS_PER_KEY)], axis=1)
    return block.astype(np.int64), bits.astype(np.int64)


def bloom_filter(entries: DataFrame) -> np.ndarray:
    """The filter's blocks, a row of BLOCK_BITS / 64 words each. Bits are joined by Spark; at most MAX_FILTER_BITS reach the driver."""
    n = entries.count()
    blocks = max(1, min(MAX_FILTER_BITS, 1 << max(9, (n * BITS_PER_ENTRY - 1).bit_length())) // BLOCK_BITS)
    words = BLOCK_BITS // 64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            block, bits = key_bits(key_hashes(keys), blocks)
            cell = (block[:, None] * words + bits // 64).ravel()
            mask = (np.uint64(1) << (bits % 64).astype(np.uint64)).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mask)], names=["cell", "mask"])

    cells = entries.select("entry").mapInArrow(work, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(blocks * words, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return out.reshape(blocks, words)


def may_hold(table: np.ndarray, keys: list[str]) -> np.ndarray:
    if not keys:
        return np.empty(0, bool)
    block, bits = key_bits(key_hashes(keys), len(table))
    words = table[block[:, None], bits // 64]
    return ((words >> (bits % 64).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every listed form that would fit: suffixes of the host at label bounds, prefixes of the path."""
    labels = host.split(".")
    return [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in lengths if n <= len(path)]


def split_url(url: str = "url") -> tuple:
    """Host (A-Z lower-cased) and path of a URL column; both empty without '://' or for null."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), tail


def filter_urls(pages: DataFrame, entries: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict: the longest fitting rule's verdict, else that of the longest fitting entry that is no rule, else ``default``.

    ``entries``: (entry, verdict, is_rule), an entry being host and path up to any point. Longest is by characters; equal lengths
    go to the later text. Cases: null or no '://': host and path empty, no rule, ``default``. Equal (host, path) are
    judged once, so a hot URL costs one row. Repeated rows stay. Columns named host, path, rule, verdict are replaced.
    """
    host, path = split_url(url_col)
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    entries = entries.filter("entry is not null").dropDuplicates(["entry"])
    lengths = sorted(r[0] for r in entries.select(F.length(F.regexp_extract("entry", r"(?s)^[^/]*(.*)$", 1))).distinct().collect())  # as many as path lengths
    table = bloom_filter(entries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [keys_of(h, p, lengths) for h, p in zip(hosts, paths)]
            flat = [k for own in keys for k in own]
            owner = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
            hit = np.flatnonzero(may_hold(table, flat))
            at = owner[hit]
            yield pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in at], pa.string()), pa.array([paths[i] for i in at], pa.string()), pa.array([flat[i] for i in hit], pa.string())], names=["host", "path", "entry"])

    distinct = base.select("host", "path").filter("host <> '' or path <> ''").distinct()
    hits = distinct.mapInArrow(work, "host string, path string, entry string").join(entries, "entry")
    best = F.struct(F.length("entry").alias("n"), F.col("entry"), F.col("verdict"))
    judged = hits.groupBy("host", "path").agg(F.max(F.when(F.col("is_rule"), best)).alias("by_rule"), F.max(F.when(~F.col("is_rule"), best)).alias("by_list"))
    judged = judged.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("by_rule.entry").alias("rule"), F.coalesce("by_rule.verdict", "by_list.verdict").alias("__v"))
    out = base.join(judged, (base.host == judged["__h"]) & (base.path == judged["__p"]), "left")
    return out.select(*base.columns, "rule", F.coalesce("__v", F.lit(default)).alias("verdict"))


def oracle() -> str:
    rows = ", ".join(f"('{e}', '{v}', true)" for e, v in RULES)
    rows += "".join(f", ('{s}.{z}/', 'block', false)" for s in LISTED_SITES for z in LISTED_ZONES)
    return f"""
WITH e AS (
  SELECT entry, verdict, is_rule, split_part(entry, '/', 1) AS h, substr(entry, length(split_part(entry, '/', 1)) + 1) AS p FROM (VALUES {rows}) v(entry, verdict, is_rule)
), u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), b AS (
  SELECT host, path, arg_max(entry, length(entry)) FILTER (is_rule) AS rule, arg_max(verdict, length(entry)) FILTER (is_rule) AS rv, arg_max(verdict, length(entry)) FILTER (NOT is_rule) AS lv
  FROM (SELECT DISTINCT host, path FROM s) d JOIN e ON (d.host = e.h OR ends_with(d.host, '.' || e.h)) AND starts_with(d.path, e.p)
  GROUP BY host, path
)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.rv, b.lv, 'allow') AS verdict
FROM s LEFT JOIN b ON s.host = b.host AND s.path = b.path
"""
