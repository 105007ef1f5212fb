import random

import pytest
from conftest import box

from acreage.functions import rings as R
from acreage.operators import evaluate as E
from acreage.operators import matching

RR = f"project_id string, ord int, ring {R.RING}"
LL = "project_id string, ord int, raw_text string, associated_entity_id string"


def sides(spark, boundary, plots, roads, labels):
    rows = lambda rs: spark.createDataFrame([("p", i, r) for i, r in enumerate(rs)], RR)
    return {"boundary": rows(boundary), "plots": rows(plots), "roads": rows(roads), "labels": spark.createDataFrame([("p", i, t, "x") for i, t in enumerate(labels)], LL)}


def test_golden_flawed_case(spark):
    gt = sides(spark, [box(0, 0, 100, 100)], [box(5, 5, 45, 40), box(55, 5, 95, 40)], [box(0, 45, 100, 55)], ["PLOT 101", "PLOT 102"])
    pred = sides(spark, [[(10.0, 10.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]], [box(5, 5, 40, 40)], [], ["PLT 101"])
    r = E.evaluate(gt, pred).first()
    assert (r.boundary_iou, r.area_error_pct, r.perimeter_error_pct) == (0.9, 10.0, 4.72)
    assert (r.matched, r.missing, r.merged, r.mean_iou, r.mean_centroid_error, r.mean_area_error_pct) == (1, 1, 1, 0.875, 2.5, 12.5)
    assert (r.mean_edit_distance, r.wer) == (4.0, 0.5714)
    assert r.failures == ["MERGED_PLOTS", "MISSING_PLOTS", "OCR_FAILURE", "ROAD_FAILURE"] and not r.is_acceptable


def test_matching_equals_the_sequential_walk(spark):
    rng = random.Random(3)
    gts = [(x, y, x + 10, y + 10) for x, y in ((rng.randint(0, 12), rng.randint(0, 8)) for _ in range(25))]
    preds = gts[:6] + [(x + rng.randint(0, 2), y, x2, y2 + 1) for x, y, x2, y2 in gts[3:20]]

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    used, want = set(), {}
    for i, g in enumerate(gts):
        best, at = 0.0, -1
        for j, p in enumerate(preds):
            if j not in used and iou(g, p) > best + 1e-12:
                best, at = iou(g, p), j
        if at >= 0 and best >= 0.5:
            used.add(at)
            want[i] = at
    frame = lambda rs: spark.createDataFrame([("p", i, box(*r)) for i, r in enumerate(rs)], RR)
    got = {r.g_ord: r.p_ord for r in E.match_by_iou(frame(gts), frame(preds)).collect()}
    assert got == want


def test_label_matching_equals_the_sequential_walk(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    norm = lambda t: "".join(c for c in t.lower() if c.isascii() and c.isalnum())
    gts = ["PLOT 1", "PLOT 12", "Plot 1", "PLOT 3", "PARK", "PLOT 1", "ROAD"]
    preds = ["plot 1", "PLOT 2", "PLOT 3", "PARC", "PLOT 1", "RODE"]
    used, want = set(), []
    for i, g in enumerate(gts):
        best, at = None, None
        for j, p in enumerate(preds):
            if j in used:
                continue
            if norm(g) == norm(p):
                best, at = 0, j
                break
            d = lev(norm(g), norm(p))
            if best is None or d < best:
                best, at = d, j
        if at is not None:
            used.add(at)
        want.append((i, at, best if at is not None else len(norm(g))))
    frame = lambda ts: spark.createDataFrame([("p", i, t, None) for i, t in enumerate(ts)], LL)
    got = sorted((r.g_ord, r.p_ord, r.distance) for r in E.match_labels(frame(gts), frame(preds)).collect())
    assert got == want


def _walk(gts, preds):
    left, want = list(enumerate(preds)), []
    for i, t in enumerate(gts):
        best = min(((_distance(t, x), j, x) for j, x in left), default=None)
        if best:
            left.remove((best[1], best[2]))
            want.append((i, best[1], best[0]))
    return want


def _class_frames(spark, *sides):
    return [spark.createDataFrame([("p", i, t) for i, t in enumerate(ts)], f"project_id string, {s}_ord long, {s}_class string") for s, ts in zip("gp", sides)]


@pytest.mark.parametrize("bound,n", [(matching.WALK_LABELS, 900), (0, 45)])
def test_label_matching_of_a_whole_sheet_equals_the_walk(spark, monkeypatch, bound, n):
    """A sheet whose texts partly miss their partner, so one row takes another's over and over; copies share classes.

    Within the bound a task walks through it, beyond it rounds of joins settle it.
    """
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
    gts = [text() for _ in range(n)] + ["road"] * 100
    preds = [t if rng.random() < 0.8 else text() for t in gts if rng.random() < 0.9] + ["rode"] * 9
    rng.shuffle(gts)
    rounds, plain = [], matching.numbered
    monkeypatch.setattr(matching, "numbered", lambda *a: rounds.append(1) or plain(*a))
    got = sorted((r.g_ord, r.p_ord, r.score) for r in matching.match_texts(*_class_frames(spark, gts, preds), bound).collect())
    print(f"{len(gts)} labels, {sum(d > 0 for _, _, d in got)} taken with a distance: {len(rounds) // 2} rounds")
    assert got == _walk(gts, preds)
    assert len(rounds) // 2 < (1 if bound else 60)


@pytest.mark.parametrize("bound", [1, 2, 4, 8])
def test_near_texts_finds_every_pair_within_the_bound(spark, bound):
    rng = random.Random(bound)
    some = list({"".join(rng.choice("ab1") for _ in range(rng.randrange(0, 14))) for _ in range(60)})
    left, right = some[:30], some[20:]
    frame = lambda ts, c: spark.createDataFrame([("p", t) for t in ts], f"project_id string, {c} string")
    got = {(r.g_class, r.p_class, r.score) for r in matching.near_texts(frame(left, "g_class"), frame(right, "p_class"), bound).collect()}
    assert got == {(a, b, _distance(a, b)) for a in left for b in right if _distance(a, b) <= bound}


@pytest.mark.parametrize("bound", [matching.WALK_PAIRS, 0])
def test_matching_of_pairs_equals_the_walk_within_and_beyond_the_bound(spark, bound):
    rng = random.Random(11)
    classes = range(12)
    gts, preds = [rng.choice(classes) for _ in range(40)], [rng.choice(classes) for _ in range(35)]
    score = {(a, b): rng.choice([0.5, 0.6, 0.6, 0.9, 1.0]) for a in classes for b in classes if rng.random() < 0.4}
    left, want = list(enumerate(preds)), []
    for i, c in enumerate(gts):
        best = min(((-score[c, k], j, k) for j, k in left if (c, k) in score), default=None)
        if best:
            left.remove((best[1], best[2]))
            want.append((i, best[1], -best[0]))
    g, p = ([("p", i, c) for i, c in enumerate(side)] for side in (gts, preds))
    frames = [spark.createDataFrame(rows, f"project_id string, {s}_ord long, {s}_class long") for s, rows in (("g", g), ("p", p))]
    pairs = spark.createDataFrame([("p", a, b, s) for (a, b), s in score.items()], "project_id string, g_class long, p_class long, score double")
    assert sorted((r.g_ord, r.p_ord, r.score) for r in matching.match_pairs(*frames, pairs, bound).collect()) == want


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
