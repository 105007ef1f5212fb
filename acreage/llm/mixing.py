"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words. A target stops at ``cap`` times
its source; what is above goes to the others by weight. With sources sorted by cap / weight, level_j is the share per unit of
weight if exactly those before j are full; it rises while sources fill up and falls afterwards, so its maximum is the level.

Sample. Each document is taken floor(target / source words) times whole. The rest of a target is a fixed-size sample: inclusion
odds are favour * f / (1 - f), f being the share still wanted and ``favour`` a weight of the document; documents are ranked by
their random odds u / (1 - u) divided by these odds and taken in that order until the words are used up; the last one is cut.
u comes from a digest of seed and doc_id, so reruns agree.

Scale. A source may hold a third of all rows: its rows meet their target in SALTS parts; ranks are dealt into BINS bins of a
source, bins are summed before the shuffle, only the bins' sums are numbered per source, and rows are ordered inside (source, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.session import plain_reads

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
BINS = 1 << 14
#: Parts a source's rows are dealt into when they meet their target.
SALTS = 64
SEED = "mix-1"
#: Documents under this many words have half the inclusion odds.
SHORT = 50


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source; numbers the sources, not the rows."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("long"))
    by_ratio = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))) / F.sum("w").over(after)
    top = weighed.withColumn("level", level).withColumn("top", F.max("level").over(everything))
    return top.select("source", "source_size", F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.col("top") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, carry: list[str], id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """The columns ``carry`` and a struct ``mix`` (size, source_size, target, copies, taken), a row per row of ``docs``.

    size counts the words of the text column unless given; copies whole copies and then ``taken - copies * size`` words of one
    more are taken, so taken never exceeds three times size.

    Cases: null and empty texts have size 0 and taken 0; a source of such texts has target 0. A null source is a source of
    its own, last in order; a null doc_id draws like an empty one. Repeated rows draw alike and stand side by side. Ties are
    broken by doc_id, then size. An empty table gives an empty table. Names in ``carry`` may clash with those used here.
    """
    columns = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)]
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(*columns, F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = rows.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))  # never null, so joins and windows share one shuffle
    sizes = rows.groupBy("__key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    whole = F.floor(F.col("target") + 0.5)
    goal = targets.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("__key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long").alias("copies"), whole.cast("long").alias("__whole"),
    ).withColumn("budget", F.col("__whole") - F.col("copies") * F.col("source_size"))
    spread = goal.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "size"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, ["__key", "__salt"])
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("__id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    share = F.col("budget") / F.col("source_size")
    favour = F.when(F.col("size") < SHORT, 0.5).otherwise(1.0)
    drawn = joined.withColumn("__u", draw).withColumn("__odds", favour * share / (1.0 - share))
    ranked = drawn.withColumn("__q", F.when(F.col("budget") > 0, (F.col("__u") / (1.0 - F.col("__u"))) / F.col("__odds")).otherwise(F.col("__u")))
    ranked = ranked.withColumn("__bin", F.floor(F.col("__q") / (1.0 + F.col("__q")) * bins).cast("long"))
    sums = ranked.groupBy("__key", "__bin").agg(F.sum("size").alias("__in_bin"))
    ahead = Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__key", "__bin", F.coalesce(F.sum("__in_bin").over(ahead), F.lit(0)).alias("__ahead"))
    placed = ranked.join(offsets, ["__key", "__bin"])
    inside = Window.partitionBy("__key", "__bin").orderBy("__q", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start))
    mix = F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size") + more).alias("taken"))
    return placed.withColumn("__mix", mix).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], F.col("__mix").alias("mix"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * w) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS copies, CAST(floor(target + 0.5) AS BIGINT) AS whole FROM t
), b AS (
  SELECT *, whole - copies * source_size AS budget FROM g
), r AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.copies, b.budget,
    (CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u,
    CASE WHEN b.source_size > 0 THEN CAST(b.budget AS DOUBLE) / b.source_size END AS f
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), q AS (
  SELECT *, CASE WHEN budget > 0 THEN (u / (1.0 - u)) / (CASE WHEN size < {SHORT} THEN 0.5 ELSE 1.0 END * f / (1.0 - f)) ELSE u END AS q FROM r
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q
)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(size, budget - start)) AS BIGINT) AS taken FROM o
"""


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, the last document of a source cut to the words still wanted."""
    names = plain_reads(docs).columns
    rows = mix_sources(docs, names, size=word_count(F.col("text"))).toDF(*[f"c{i}" for i in range(len(names))], "mix").filter("mix.taken > 0")
    text = F.col(f"c{names.index('text')}")
    size, taken = F.col("mix.size"), F.col("mix.taken")
    whole, rest = F.floor(taken / size).cast("int"), (taken % size).cast("int")
    copies = F.array_repeat(F.struct(F.lit(False).alias("part")), whole)
    parted = F.when(rest > 0, F.array_append(copies, F.struct(F.lit(True).alias("part")))).otherwise(copies)
    dealt = rows.select("*", F.inline(parted))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, rest), " ")
    new = F.when(F.col("part"), first_words).otherwise(text)
    out = {"text": new}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("part"), F.length(first_words)).otherwise(F.col(f"c{names.index('n_chars')}")).cast(docs.schema["n_chars"].dataType)
    return dealt.select(*[out.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
