"""Quality rules with risk-controlled thresholds.

A rule rejects a document when its value is above a cutoff. Cutoffs are tried from a fixed ladder, loosest first, on the labelled
good documents of each stratum (language). A step stands when the exact binomial test rejects a false rejection rate above
ALPHA / rules at level DELTA / (rules * strata), that is, when the exact upper bound of the rate is below it; the first step that
fails ends the ladder, so steps need no further correction, while rules and strata are corrected by their number. With
probability 1 - DELTA all rules together wrongly reject at most ALPHA of the good documents of every stratum. A stratum with too
few labels keeps everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from acreage.llm import text as X
from acreage.session import cut

#: The base limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ALPHA, DELTA = 0.03, 0.05
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def rule_values(f: str = "features") -> dict[str, Column]:
    """Value of each rule; larger is worse, null (never rejected) where it has no meaning."""
    words, lines = F.col(f"{f}.n_words"), F.col(f"{f}.n_lines")
    return {
        "symbols": F.when(words > 0, F.col(f"{f}.n_symbols") / words),
        "dup_lines": F.when(lines > 0, F.col(f"{f}.n_dup_lines") / lines),
        "repeats": F.when(words > 0, F.col(f"{f}.n_repeat_words") / words),
        "long_words": F.when(words > 0, F.col(f"{f}.word_chars") / words),
        "short_words": F.when(words > 0, -F.col(f"{f}.word_chars") / words),
    }


#: Cutoffs of each rule, loosest first.
LADDERS = {
    "symbols": [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeats": [0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "long_words": [30.0, 20.0, 15.0, 12.0, 10.0, 9.0],
    "short_words": [-1.0, -1.5, -2.0, -2.5, -3.0],
}


def _counts(hits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(hits)))
    return total[ends] - total[starts]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys found twice or more, keys found before), as flags in the keys' order."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def text_features(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts in FEATURES for each text; lines, words and windows are compared by 64-bit hashes."""
    out = {name: np.zeros(len(texts), np.int64) for name in FEATURES}
    for first, last, blob, starts, ends in X.blobs(texts):
        rows = slice(first, last)
        sums = X.prefix_sums(blob)
        begins, stops = X.words(blob)
        lo, hi = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
        out["n_words"][rows] = hi - lo
        out["word_chars"][rows] = _counts(~X.SPACE[blob] & ((blob & 0xC0) != 0x80), starts, ends)
        out["n_symbols"][rows] = _counts(SYMBOLS[blob], starts, ends)
        salt = X.mix(np.arange(1, len(starts) + 1, dtype=np.uint64))
        owner = np.repeat(np.arange(len(starts)), hi - lo)
        if len(begins) >= 3:
            grams = X.window_hashes(X.span_hashes(sums, begins, stops), 3)
            inside = np.flatnonzero(owner[:-2] == owner[2:])
            twice, _ = _repeated(X.mix(grams[inside] ^ salt[owner[inside]]))
            covered = np.zeros(len(begins), bool)
            for j in range(3):
                covered[inside[twice] + j] = True
            out["n_repeat_words"][rows] = _counts(covered, lo, hi)
        line_ends = np.flatnonzero(blob == 10)
        line_starts = np.concatenate(([0], line_ends[:-1] + 1))
        full = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_starts)
        line_starts, line_ends = line_starts[full], line_ends[full]
        of = np.searchsorted(starts, line_starts, "right") - 1
        _, later = _repeated(X.mix(X.span_hashes(sums, line_starts, line_ends) ^ salt[of]))
        out["n_lines"][rows] = np.bincount(of, minlength=len(starts))
        out["n_dup_lines"][rows] = np.bincount(of[later], minlength=len(starts))
    return out


def with_features(docs: DataFrame, text_col: str = "text", name: str = "features") -> DataFrame:
    """``docs`` and a struct of the counts of each whole text."""
    place = X.small_batches(docs).columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, StructType([StructField(f, LongType()) for f in FEATURES]))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, place):
            got = text_features(X.encoded(batch.column(place).to_pylist()))
            struct = pa.StructArray.from_arrays([pa.array(got[f], pa.int64()) for f in FEATURES], names=FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return docs.mapInArrow(work, schema)


def base_failed(f: str = "features") -> Column:
    return (F.col(f"{f}.n_words") < MIN_WORDS) | (100 * F.col(f"{f}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{f}.n_words"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + up * d, 1.0 + up / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exactly, by the incomplete beta function: I(1-p; n-k, k+1)."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _tails(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cuts): each rule's cutoff by name, missing where no step stands. ``good``: (stratum, features) of good documents."""
    values, rules = rule_values(), list(LADDERS)
    steps = [F.struct(F.lit(r).alias("rule"), sum((F.when(values[r] > c, 0).otherwise(1) for c in LADDERS[r]), F.lit(1)).alias("step")) for r in rules]
    hit = good.select("stratum", F.inline(F.array(*steps))).groupBy("stratum", "rule", "step").agg(F.count("*").alias("n"))
    strata = good.select("stratum").distinct().agg(F.count("*").alias("strata"))
    ladder = [F.struct(F.lit(r).alias("rule"), F.lit(i + 1).alias("step"), F.lit(float(c)).alias("cut")) for r in rules for i, c in enumerate(LADDERS[r])]
    total = hit.filter(F.col("rule") == rules[0]).groupBy("stratum").agg(F.sum("n").alias("total"))
    grid = total.select("stratum", "total", F.inline(F.array(*ladder))).join(hit, ["stratum", "rule", "step"], "left").crossJoin(F.broadcast(strata))  # one row
    run = Window.partitionBy("stratum", "rule").orderBy("step")
    tried = grid.withColumn("k", F.sum(F.coalesce("n", F.lit(0))).over(run))
    tried = tried.withColumn("p_value", F.pandas_udf(_tails, DoubleType())("k", "total", F.lit(alpha / len(rules))))
    stands = tried.withColumn("stands", F.min((F.col("p_value") <= F.lit(delta) / (F.col("strata") * len(rules))).cast("int")).over(run))
    last = stands.filter("stands = 1").groupBy("stratum", "rule").agg(F.max_by("cut", "step").alias("cut"))
    return last.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))  # as many as rules


def judge(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with features and stratum) and base_failed, kept."""
    joined = rows.join(cuts.withColumnRenamed("stratum", "__stratum"), F.col("stratum") == F.col("__stratum"), "left")
    rejected = F.lit(False)
    for rule, value in rule_values().items():
        rejected = rejected | F.coalesce(value > F.col("cuts")[rule], F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__stratum", "cuts")


def stratum(lang_col: str = "lang") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("null"))


def good_documents(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, features) of documents labelled good; a doc_id labelled both ways counts as good."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct()
    return rows.join(good, F.col("doc_id") == F.col("__good")).select("stratum", "features")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row per row of ``docs``.

    Cases: null, empty and blank texts have zero counts and fail the base rule. A null language is a stratum of its own; a
    stratum without enough labels has no cutoff. Labels without a document, null ids and repeated labels do no harm. Repeated
    rows are judged alike; an empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), stratum(lang_col).alias("stratum"), F.col(text_col).alias("text"))
    rows = cut(with_features(base).drop("text"))
    judged = judge(rows, cutoffs(good_documents(rows, labels)))
    return judged.select("doc_id", *[F.col(f"features.{f}").alias(f) for f in FEATURES if f != "n_lines"], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{names.index(n)}" for n in ("doc_id", "lang", "text")}
    measured = with_features(inner.withColumn("stratum", stratum(at["lang"])).withColumn("doc_id", F.col(at["doc_id"])), at["text"])
    facts = cut(measured.select("doc_id", "stratum", "features"))
    return judge(measured, cutoffs(good_documents(facts, labels))).filter("kept").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
