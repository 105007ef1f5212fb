"""One-to-one greedy matching: rows of the approved side, in their order, each take the best row that is left.

Rows are dealt with by class (equal shapes or equal texts). A sheet of bounded size is walked through by one task; the bound is
counted before. Sheets beyond it are settled in rounds of joins, which give the same result without ever gathering a sheet.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.session import cut, first_per_key, numbered

ORD_SLICE = 10000
#: Labels of a sheet, or rows and candidate pairs of a sheet of shapes, that one task walks through; larger sheets take rounds.
WALK_LABELS = 4096
WALK_PAIRS = 100_000
#: Texts that the free rows of a class without an equal text ask in a round.
ASKED = 64
#: First edit bound of the join of texts; it doubles for texts that find nobody.
FIRST_BOUND = 2
_NOBODY = 2**62


def _slice(col: str) -> Column:
    return F.floor(F.col(col) / ORD_SLICE)


def _split(g: DataFrame, p: DataFrame, more: list[DataFrame], bound: int) -> tuple[DataFrame, DataFrame]:
    """Projects whose rows number ``bound`` at most, and the others."""
    sizes = None
    for part in (g, p, *more):
        n = part.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
        sizes = n if sizes is None else sizes.unionByName(n)
    sizes = cut(sizes.groupBy("project_id").agg(F.sum("n").alias("n")))
    return sizes.filter(F.col("n") <= bound).select("project_id"), sizes.filter(F.col("n") > bound).select("project_id")


class _Seats:
    """Rows of the predicted side by class, given out in their order."""

    def __init__(self, classes: np.ndarray, ords: np.ndarray):
        order = np.lexsort((ords, classes))
        self.ords, self.start = ords[order], np.searchsorted(classes[order], np.arange(classes.max() + 1 if len(classes) else 0))
        self.end = np.append(self.start[1:], len(ords))
        self.next = np.append(self.ords, _NOBODY)[self.start] if len(ords) else self.ords

    def take(self, k: int) -> int:
        got = int(self.next[k])
        self.start[k] += 1
        self.next[k] = self.ords[self.start[k]] if self.start[k] < self.end[k] else _NOBODY
        return got


# ---- texts


def edit_distances(text: str, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distance of ``text`` to texts given as rows of code points, padded, with their lengths."""
    steps = np.arange(others.shape[1] + 1)
    row = np.tile(steps, (len(others), 1))
    for i, c in enumerate(text, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (others != ord(c)), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # insertions
    return row[np.arange(len(others)), lengths]


def _walk_labels(sheet: pd.DataFrame) -> pd.DataFrame:
    """The walk over one sheet: equal text first, else the nearest text that is left, of equal ones the earlier row."""
    ours, theirs = sheet[sheet.side == "g"].sort_values("ord"), sheet[sheet.side == "p"]
    out: list[tuple[int, int, int]] = []
    if len(theirs):
        classes, texts = pd.factorize(theirs.text)
        place = {t: i for i, t in enumerate(texts)}
        seats, near = _Seats(classes, theirs.ord.to_numpy(np.int64)), {}
        lengths = np.array([len(t) for t in texts])
        points = np.zeros((len(texts), lengths.max()), np.int32)
        for i, t in enumerate(texts):
            points[i, : len(t)] = [ord(c) for c in t]
        for _ in range(min(len(ours), len(theirs))):
            g_ord, text = ours.ord.iat[len(out)], ours.text.iat[len(out)]
            k, distance = place.get(text, -1), 0
            if k < 0 or seats.next[k] == _NOBODY:
                if text not in near:
                    near[text] = edit_distances(text, points, lengths)
                open_ = np.where(seats.next < _NOBODY, near[text], _NOBODY)
                distance = int(open_.min())
                tied = np.flatnonzero(open_ == distance)
                k = int(tied[seats.next[tied].argmin()])
            out.append((int(g_ord), seats.take(k), distance))
    done = pd.DataFrame(out, columns=["g_ord", "p_ord", "score"])
    done.insert(0, "project_id", sheet.project_id.iat[0])
    return done


def near_texts(left: DataFrame, right: DataFrame, bound: int) -> DataFrame:
    """project_id, g_class, p_class, score: pairs of distinct texts of a project that differ by ``bound`` edits at most.

    A text of the right side is cut into ``bound`` + 1 pieces; at most that many edits leave one piece whole, shifted by no more than
    the edits on its one side. So pairs meet in an equi-join on (project, length, piece), for all pieces and shifts that can count.
    """
    k = F.lit(bound)
    size = lambda c: F.length(F.col(c))
    at = lambda i, n: F.floor(i * n / (bound + 1)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), F.substring(F.col("p_class"), at(i, size("p_class")) + 1, at(i + 1, size("p_class")) - at(i, size("p_class"))).alias("piece"))
    )
    theirs = right.select("project_id", "p_class", size("p_class").alias("n"), F.inline(pieces))
    length = size("g_class")
    ours = left.select("project_id", "g_class", F.explode(F.sequence(F.greatest(F.lit(0), length - k), length + k)).alias("n"))
    ours = ours.select("project_id", "g_class", "n", (length - F.col("n")).alias("more"), F.explode(F.sequence(F.lit(0), k)).alias("i"))
    start, width = at(F.col("i"), F.col("n")), at(F.col("i") + 1, F.col("n")) - at(F.col("i"), F.col("n"))
    low = F.greatest(F.lit(0), start - F.col("i"), start + F.col("more") - (k - F.col("i")))
    high = F.least(length - width, start + F.col("i"), start + F.col("more") + (k - F.col("i")))
    ours = ours.withColumn("width", width).withColumn("low", low).withColumn("high", high).filter("low <= high")
    ours = ours.withColumn("s", F.explode(F.sequence("low", "high")))
    ours = ours.select("project_id", "g_class", "n", "i", F.substring("g_class", F.col("s") + 1, F.col("width")).alias("piece")).distinct()
    met = ours.join(theirs, ["project_id", "n", "i", "piece"]).select("project_id", "g_class", "p_class").distinct()
    return met.withColumn("score", F.levenshtein("g_class", "p_class", bound)).filter("score >= 0")


def displaced(g: DataFrame, p: DataFrame) -> DataFrame:
    """project_id, g_ord, p_ord, score of the walk that gives each approved text the nearest text left, in rounds of joins.

    All predicted texts rank the approved ones alike, by g_ord, so the walk is the only stable matching: every free row asks its
    nearest text that no earlier row holds, a text keeps the earliest row that asked it, and the displaced row is free again. The
    k-th free row of a class asks the k-th such text: those before it go to earlier rows. Neighbours of a text come from
    ``near_texts``; its bound doubles when all of them are held by earlier rows. Rounds are the longest chain of displacements.
    """
    texts = cut(p.select("project_id", "p_class").distinct())
    longest = cut(texts.select("project_id", F.length("p_class").alias("n")).unionByName(g.select("project_id", F.length("g_class").alias("n"))).groupBy("project_id").agg(F.max("n").alias("longest")))
    known = bounds = held = None
    free = g
    while True:
        seats = cut((p if held is None else p.join(held.select("project_id", "p_ord", "g_ord"), ["project_id", "p_ord"], "left")).select(
            "project_id", "p_ord", "p_class", (F.lit(_NOBODY) if held is None else F.coalesce("g_ord", F.lit(_NOBODY))).alias("holder")
        ))
        heads = cut(free.groupBy("project_id", "g_class").agg(F.min("g_ord").alias("head")))
        within = F.col("holder") > F.col("head")
        equal = cut(heads.withColumn("p_class", F.col("g_class")).join(seats, ["project_id", "p_class"]).filter(within).select("project_id", "g_class", "p_ord", F.lit(0).alias("score")))
        last = seats.groupBy("project_id").agg(F.max("holder").alias("holder"))
        rest = cut(heads.join(equal.select("project_id", "g_class").distinct(), ["project_id", "g_class"], "left_anti").join(last, "project_id").filter(within).drop("holder"))
        reach = seats.groupBy("project_id", "p_class").agg(F.max("holder").alias("holder"))
        while True:
            apart = None if known is None else cut(rest.join(known, ["project_id", "g_class"]).join(reach, ["project_id", "p_class"]).filter(within).drop("holder"))
            alone = rest if apart is None else rest.join(apart.select("project_id", "g_class").distinct(), ["project_id", "g_class"], "left_anti")
            if bounds is None:
                wider = alone.select("project_id", "g_class", F.lit(FIRST_BOUND).alias("bound"))
            else:
                asked = alone.join(bounds, ["project_id", "g_class"], "left").join(longest, "project_id").filter(F.coalesce("bound", F.lit(0)) < F.col("longest"))
                wider = asked.select("project_id", "g_class", F.coalesce(F.col("bound") * 2, F.lit(FIRST_BOUND)).alias("bound"))
            wider = cut(wider)
            found = None
            for (bound,) in wider.select("bound").distinct().collect():  # as many as the length of a text has doublings
                some = near_texts(wider.filter(F.col("bound") == bound), texts, bound)
                found = some if found is None else found.unionByName(some)
            if found is None:
                break
            same = wider.select("project_id", "g_class")
            known = cut(found if known is None else known.join(same, ["project_id", "g_class"], "left_anti").unionByName(found))
            bounds = cut(wider if bounds is None else bounds.join(same, ["project_id", "g_class"], "left_anti").unionByName(wider))
        if apart is None:
            near = equal.limit(0)
        else:
            nearest = apart.groupBy("project_id", "g_class", "head").agg(F.min("score").alias("score"))
            tied = apart.join(nearest.select("project_id", "g_class", "score"), ["project_id", "g_class", "score"])
            near = first_per_key(tied.join(seats, ["project_id", "p_class"]).filter(within), ["project_id", "g_class"], [F.col("p_ord")], ASKED).select("project_id", "g_class", "p_ord", "score")
        asked = numbered(equal.unionByName(near), ["project_id", "g_class"], [F.asc("p_ord")], _slice("p_ord"), "rank")
        asking = numbered(free, ["project_id", "g_class"], [F.asc("g_ord")], _slice("g_ord"), "rank")
        asks = cut(asking.join(asked, ["project_id", "g_class", "rank"]).select("project_id", "p_ord", "g_ord", "score"))
        if asks.isEmpty():
            return (asks if held is None else held).select("project_id", "g_ord", "p_ord", "score")
        held = asks if held is None else held.unionByName(asks)
        held = cut(held.groupBy("project_id", "p_ord").agg(F.min(F.struct("g_ord", "score")).alias("b")).select("project_id", "p_ord", "b.g_ord", "b.score"))
        free = cut(g.join(held.select("project_id", "g_ord"), ["project_id", "g_ord"], "left_anti"))


def match_texts(g: DataFrame, p: DataFrame, bound: int = WALK_LABELS) -> DataFrame:
    """project_id, g_ord, p_ord, score of the walk over normalized texts (project_id, g_ord, g_class and project_id, p_ord, p_class)."""
    g, p = cut(g), cut(p)
    small, large = _split(g, p, [], bound)
    side = lambda df, s: df.join(small, "project_id", "left_semi").select("project_id", F.lit(s).alias("side"), F.col(f"{s}_ord").cast("long").alias("ord"), F.col(f"{s}_class").alias("text"))
    project = g.schema["project_id"].dataType.simpleString()
    walked = side(g, "g").unionByName(side(p, "p")).groupBy("project_id").applyInPandas(_walk_labels, f"project_id {project}, g_ord long, p_ord long, score int")
    if large.isEmpty():
        return walked
    rest = displaced(g.join(large, "project_id", "left_semi"), p.join(large, "project_id", "left_semi"))
    return walked.unionByName(rest.select("project_id", F.col("g_ord").cast("long").alias("g_ord"), F.col("p_ord").cast("long").alias("p_ord"), F.col("score").cast("int").alias("score")))


# ---- shapes


def _walk_pairs(sheet: pd.DataFrame) -> pd.DataFrame:
    """The walk over one sheet: each row takes the free row of the class with the best score, of equal scores the earlier row."""
    by_side = {s: rows for s, rows in sheet.groupby("side")}
    out: list[tuple[int, int, float]] = []
    if len(by_side) == 3:
        theirs, pairs = by_side["p"], by_side["c"]
        codes, names = pd.factorize(theirs.kind)
        seats, place = _Seats(codes, theirs.ord.to_numpy(np.int64)), {k: i for i, k in enumerate(names)}
        wanted = defaultdict(list)
        for kind, other, score in zip(pairs.kind, pairs.ord, pairs.score):
            if other in place:
                wanted[kind].append((score, place[other]))
        for g_ord, kind in sorted(zip(by_side["g"].ord, by_side["g"].kind)):
            free = [(-score, seats.next[k], k) for score, k in wanted.get(kind, ()) if seats.next[k] < _NOBODY]
            if free:
                score, _, k = min(free)
                out.append((int(g_ord), seats.take(k), -score))
    done = pd.DataFrame(out, columns=["g_ord", "p_ord", "score"])
    done.insert(0, "project_id", sheet.project_id.iat[0])
    return done


def _settle(open_g: DataFrame, open_p: DataFrame, best: DataFrame, rivals: DataFrame) -> DataFrame:
    """Rows of the approved side that can be settled now, with the predicted row each takes.

    ``best``: project_id, g_class, p_class, score, n_take (how many rows of the class may
    settle in one round). ``rivals``: per predicted class, the first open row that lists it
    without proposing it.
    """
    counts = open_p.groupBy("project_id", "p_class").agg(F.count(F.lit(1)).alias("n_free"))
    asked = open_g.join(best, ["project_id", "g_class"]).join(counts, ["project_id", "p_class"])
    ranked = numbered(asked, ["project_id", "p_class"], [F.asc("g_ord")], _slice("g_ord"), "rank")
    ranked = ranked.withColumn("loses", F.col("rank") > F.least("n_free", "n_take"))
    lost = ranked.filter("loses").groupBy("project_id", "p_class").agg(F.min("g_ord").alias("class_loser"))
    first_lost = lost.groupBy("project_id").agg(F.min("class_loser").alias("project_loser"))
    marked = ranked.filter(~F.col("loses")).join(lost, ["project_id", "p_class"], "left").join(first_lost, "project_id", "left")
    marked = marked.join(rivals, ["project_id", "p_class"], "left")
    before = lambda c: F.col(c).isNull() | (F.col("g_ord") < F.col(c))
    winners = marked.filter(before("project_loser") | (before("rival") & before("class_loser"))).select("project_id", "g_ord", "p_class", "score", "rank")
    seats = numbered(open_p, ["project_id", "p_class"], [F.asc("p_ord")], _slice("p_ord"), "rank")
    return winners.join(seats, ["project_id", "p_class", "rank"]).select("project_id", "g_ord", "p_ord", "score")


def settled(g: DataFrame, p: DataFrame, pairs: DataFrame) -> DataFrame:
    """project_id, g_ord, p_ord, score of the walk, in rounds that settle every row no earlier open row can disturb."""
    done = None
    open_g, open_p = cut(g), cut(p)
    while True:
        seats = open_p.groupBy("project_id", "p_class").agg(F.min("p_ord").alias("first"))
        heads = open_g.groupBy("project_id", "g_class").agg(F.min("g_ord").alias("head"))
        live = pairs.join(seats, ["project_id", "p_class"]).join(heads, ["project_id", "g_class"])
        top = live.groupBy("project_id", "g_class").agg(F.max(F.struct("score", (-F.col("first")).alias("o"), "p_class")).alias("b"), F.max("score").alias("top"))
        ties = live.join(top.select("project_id", "g_class", "top"), ["project_id", "g_class"]).filter(F.col("score") == F.col("top")).groupBy(
            "project_id", "g_class"
        ).agg(F.count(F.lit(1)).alias("n_best"))
        best = top.join(ties, ["project_id", "g_class"]).select(
            "project_id", "g_class", "b.p_class", "b.score", F.when(F.col("n_best") > 1, 1).otherwise(_NOBODY).alias("n_take")
        )
        others = live.join(best.select("project_id", "g_class", F.col("p_class").alias("own")), ["project_id", "g_class"]).filter(F.col("p_class") != F.col("own"))
        won = cut(_settle(open_g, open_p, best, others.groupBy("project_id", "p_class").agg(F.min("head").alias("rival"))))
        if won.isEmpty():
            return won if done is None else done
        done = won if done is None else cut(done.unionByName(won))
        open_g = cut(open_g.join(won.select("project_id", "g_ord"), ["project_id", "g_ord"], "left_anti"))
        open_p = cut(open_p.join(won.select("project_id", "p_ord"), ["project_id", "p_ord"], "left_anti"))
        if open_g.isEmpty() or open_p.isEmpty():
            return done


def match_pairs(g: DataFrame, p: DataFrame, pairs: DataFrame, bound: int = WALK_PAIRS) -> DataFrame:
    """project_id, g_ord, p_ord, score of the walk by best score.

    ``g``: project_id, g_ord, g_class; ``p`` likewise; ``pairs``: project_id, g_class, p_class, score. Classes are numbers.
    """
    g, p = cut(g), cut(p)
    small, large = _split(g, p, [pairs], bound)
    none = F.lit(None).cast("double")
    side = lambda df, s: df.select("project_id", F.lit(s).alias("side"), F.col(f"{s}_ord").cast("long").alias("ord"), F.col(f"{s}_class").cast("long").alias("kind"), none.alias("score"))
    listed = pairs.select("project_id", F.lit("c").alias("side"), F.col("p_class").cast("long").alias("ord"), F.col("g_class").cast("long").alias("kind"), F.col("score").cast("double").alias("score"))
    project = g.schema["project_id"].dataType.simpleString()
    rows = side(g, "g").unionByName(side(p, "p")).unionByName(listed).join(small, "project_id", "left_semi")
    walked = rows.groupBy("project_id").applyInPandas(_walk_pairs, f"project_id {project}, g_ord long, p_ord long, score double")
    if large.isEmpty():
        return walked
    rest = settled(*(df.join(large, "project_id", "left_semi") for df in (g, p, pairs)))
    return walked.unionByName(rest.select("project_id", F.col("g_ord").cast("long").alias("g_ord"), F.col("p_ord").cast("long").alias("p_ord"), F.col("score").cast("double").alias("score")))
