"""Merkle manifest of a data set: one tree of three-way runs per source, one over the sources' roots, proofs by recomputation.

Checkpoints. Leaves are numbered inside their source. Aligned blocks of FAN**EVERY nodes are hashed EVERY levels up in one step and
only the block's top is written; the levels between exist nowhere. So a tree of n leaves stores n / 81 + n / 81**2 + ... nodes.

Proofs. From the top band down, each block's interior is regenerated from the stored nodes at its foot, the siblings of every foot
node are emitted in front of the path of the block's own top, and the interior is gone with the row. A block is a row of at most
81 nodes, whatever the size of the source, so a source with a third of all rows is spread over all tasks.

Numbering. Leaves are range-partitioned by (source, order); a row's number is its place in its partition's run of the source plus the
rows of that source in earlier partitions, a table of one row per source and partition. Rows that are alike in all these columns
are told apart by their place in the written table, so copies of one row do not gather in one partition.

All of it is DataFrame functions; digests are lower-case hexadecimal text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.session import cut, once

#: Fixed value: nodes of a run.
FAN = 3
#: Levels from one written level to the next.
EVERY = 4
BLOCK = FAN**EVERY
_POWERS = [FAN**i for i in range(EVERY + 1)]


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the byte count of the decimal or UTF-8 text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: the first power of FAN that holds them."""
    return F.size(F.filter(F.array(*[F.lit(FAN**i).cast("long") for i in range(39)]), lambda p: p < n))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` and idx (place in its tree from 0, by ``order``, nulls first) and n (leaves of the tree)."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)] + [F.col("__copy").asc()]
    dealt = nodes.withColumn("__copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(dealt.drop("__copy").withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)))
    run = Window.partitionBy("tree")
    starts = rows.groupBy("tree", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    starts = starts.select(
        F.col("tree").alias("__tree"), F.col("__part").alias("__p"), F.sum("__n").over(run).alias("n"),
        (F.coalesce(F.sum("__n").over(run.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("__part") == F.col("__p"))
    return rows.join(starts, same).select(*nodes.columns, (F.col("__row") + F.col("__shift")).alias("idx"), "n")


def _raised(level: Column) -> Column:
    """The level above: a digest for each run."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, F.lit(FAN)), "")))


def _blocks(nodes: DataFrame, band: int, carry: list[str]) -> DataFrame:
    """tree, n, block, foot (its nodes in order), levels (arrays of digests from the foot to the block's top), up (levels to climb)."""
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *carry))).alias("foot"))
    rows = once(grouped, up=F.greatest(F.lit(0), F.least(F.lit(EVERY), height(F.col("n")) - band * EVERY)))
    steps = F.slice(F.array(*[F.lit(i) for i in range(EVERY)]), F.lit(1), F.col("up"))
    return once(rows, levels=F.aggregate(steps, F.array(F.col("foot.digest")), lambda done, _: F.concat(done, F.array(_raised(F.element_at(done, -1))))))


@dataclass
class Forest:
    """Numbered leaves, the written levels above them (tree, n, idx, digest) and the trees' roots (tree, digest)."""

    leaves: DataFrame
    bands: list[DataFrame]
    roots: DataFrame
    carry: list[str]


def build(leaves: DataFrame, order: list[str], carry: list[str]) -> Forest:
    """Trees over ``leaves`` (tree, digest, the columns of ``order`` and ``carry``), every EVERY-th level written."""
    first = cut(numbered(leaves, order))
    largest = first.agg(F.max("n")).first()[0] or 0
    bands, top, reach = [first.select("tree", "n", "idx", "digest")], 0, 1
    while reach < largest or top == 0:
        done = _blocks(bands[-1], top, []).select("tree", "n", F.col("block").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        bands.append(cut(done))
        top, reach = top + 1, reach * BLOCK
    return Forest(first, bands, bands[-1].select("tree", "digest"), carry)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The carried columns, digest, path and the columns of ``above`` beside path, a row per leaf.

    ``above``: a row per tree with the path that its root has outside of it. A path is a list of (left, right): the joined digests of
    the siblings on either side, from the leaf to the last root.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    held = above.select(F.col("tree").alias("__tree"), F.lit(0).cast("long").alias("__idx"), F.col("path").alias("above"), *extra)
    for band in range(len(forest.bands) - 2, -1, -1):
        carry = forest.carry if band == 0 else []
        nodes = forest.leaves if band == 0 else forest.bands[band]
        blocks = _blocks(nodes, band, carry)
        met = blocks.join(held, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__idx")))

        def step(level: Column, k: Column, place: Column) -> Column:
            power = lambda j: F.element_at(F.array(*[F.lit(p) for p in _POWERS]), j)
            own = F.floor(place / power(k + 1)).cast("int")
            first = F.floor(place / power(k + 2)).cast("int") * FAN
            return F.struct(
                F.array_join(F.slice(level, first + 1, own - first), "").alias("left"), F.array_join(F.slice(level, own + 2, first + FAN - 1 - own), "").alias("right")
            )

        def proved(node: Column, place: Column) -> Column:
            own = F.transform(F.slice("levels", F.lit(1), F.col("up")), lambda level, k: step(level, k, place))
            return F.struct(node["idx"].alias("idx"), node["digest"].alias("digest"), *[node[c].alias(c) for c in carry], F.concat(own, F.col("above")).alias("path"))

        out = met.select("tree", *extra, F.inline(F.transform("foot", proved)))
        if band:
            held = cut(out.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), F.col("path").alias("above"), *extra))
        else:
            held = out.select(*forest.carry, "digest", "path", *extra)
    return held


def fold(start: Column, path: str = "path") -> Column:
    """The root that ``start`` and the siblings of a path give."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proofs(leaves: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """``carry``, digest, subroot, root, path: a row per row of ``leaves`` (tree, digest and the columns named).

    Trees are ordered by their name, null first, and their roots are the leaves of the last tree.
    """
    forest = build(leaves, order, carry)
    roots = forest.roots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    crown = build(roots, ["name"], ["name"])
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    trees = paths(crown, crown.roots.select("tree", F.col("digest").alias("root"), nothing.alias("path")))
    above = cut(trees.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    return paths(forest, above)


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree (the source), doc_id, digest, tampered (the digest after tampering): a row per document."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    even = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    own = leaf_digest(doc_id, source, lang, n_chars, text)
    other = leaf_digest(doc_id, source, lang, n_chars, F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(source.alias("tree"), "doc_id", own.alias("digest"), F.when(even & F.contains(text, F.lit("\n")), other).otherwise(own).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row per row of ``docs``.

    Cases: null columns are written as ``-``, empty texts as ``0:``; a null source is a tree of its own, the first; a null doc_id is
    the first of its source and is not tampered with; repeated ids are ordered by their leaves and equal rows stand side by side,
    each with its own siblings. Other columns are ignored. An empty table gives an empty table.
    """
    proved = proofs(cut(leaves_of(docs)), ["doc_id", "digest"], ["doc_id", "tampered"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), fold(F.col("tampered")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Plain definition for a second engine: every level of both trees, runs by position, the fold step by step.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    replace(text, chr(10), '') AS cleaned,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) AS crc FROM documents
), l AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(cleaned) || ':' || cleaned, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS start FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l
), t AS (
  SELECT source, 0 AS lvl, idx, n, leaf AS d FROM p
  UNION ALL SELECT source, any_value(lvl) + 1, idx // 3, any_value(n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY source, idx // 3
), s AS (
  SELECT source, lvl AS h, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1
), c AS (
  SELECT 0 AS lvl, idx, n, subroot AS d FROM s
  UNION ALL SELECT any_value(lvl) + 1, idx // 3, any_value(n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM c WHERE n > 1 GROUP BY idx // 3
), r AS (
  SELECT p.rid, t.lvl AS k, t.idx, t.d, t.idx = p.idx // CAST(pow(3, t.lvl) AS BIGINT) AS own
  FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.n > 1 AND t.idx // 3 = p.idx // CAST(pow(3, t.lvl + 1) AS BIGINT)
  UNION ALL SELECT p.rid, s.h + c.lvl, c.idx, c.d, c.idx = s.idx // CAST(pow(3, c.lvl) AS BIGINT)
  FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN c ON c.n > 1 AND c.idx // 3 = s.idx // CAST(pow(3, c.lvl + 1) AS BIGINT)
), f AS (
  SELECT rid, 0 AS k, start AS cur FROM p
  UNION ALL SELECT f.rid, any_value(f.k) + 1, sha256(string_agg(CASE WHEN own THEN cur ELSE d END, '' ORDER BY idx)) FROM f JOIN r ON r.rid = f.rid AND r.k = f.k GROUP BY f.rid
), q AS (
  SELECT rid, string_agg(d, '' ORDER BY k, idx) AS siblings FROM r WHERE NOT own GROUP BY rid
), e AS (
  SELECT rid, arg_max(cur, k) AS folded FROM f GROUP BY rid
)
SELECT p.doc_id, p.leaf, s.subroot, g.d AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded AS folded_root, e.folded = g.d AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN (SELECT d FROM c WHERE n = 1) g ON true LEFT JOIN q USING (rid) JOIN e USING (rid)
"""
