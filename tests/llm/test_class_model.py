"""The class model against a plain version: every move tried by the whole likelihood, every token scored by itself."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from acreage.llm import class_model as M
from tests.llm import data


def xlogx(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(cells):
    return xlogx(cells).sum() - xlogx(cells.sum(axis=1)).sum() - xlogx(cells.sum(axis=0)).sum()


def plain_model(rows, head, rounds):
    """(score, n_known, base) by row number."""
    texts = [data.words(data.lower(r[1])) for r in rows]
    learn = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    count = Counter(w for t, ok in zip(texts, learn) if ok for w in t)
    keys = {w: int(k) for w, k in zip(count, np.concatenate([k for k, _ in M.word_keys(list(count))]))} if count else {}
    ranked = sorted(count, key=lambda w: (-count[w], keys[w]))[:head]
    group = {w: i % M.CLASSES for i, w in enumerate(ranked)}
    line = [None]
    for t, ok in zip(texts, learn):
        if ok:
            line += [*t, None]
    of = lambda w: M.END if w is None else group.get(w, M.OTHER)

    def cells(of):
        out = np.zeros((M.GROUPS, M.GROUPS), np.int64)
        for a, b in zip(line, line[1:]):
            out[of(a), of(b)] += 1
        return out

    for turn in range(rounds):
        moves = []
        for i, w in enumerate(ranked):
            if (i // M.CLASSES + turn) % 2 == 0:
                value = np.array([likelihood(cells(lambda x, h=h: h if x == w and x is not None else of(x))) for h in range(M.CLASSES)])
                h = int(np.round(value - value.max(), 6).argmax())
                if h != group[w]:
                    moves.append((-round(value[h] - value[group[w]], 6), i, w, h))
        now, moves = likelihood(cells(of)), sorted(moves)
        for _ in range(M.HALVINGS):
            tried = group | {w: h for _, _, w, h in moves}
            if moves and likelihood(cells(lambda x: M.END if x is None else tried.get(x, M.OTHER))) > now:
                group = tried
                break
            moves = moves[::2]
    pairs, final = cells(of), dict(group)
    for w in count.keys() - set(ranked):
        left, right = np.zeros((2, M.GROUPS), np.int64)
        for a, b in zip(line, line[1:]):
            left[of(a)] += b == w
            right[of(b)] += a == w
        value = []
        for h in range(M.CLASSES):
            moved = pairs.copy()
            moved[:, M.OTHER] -= left
            moved[M.OTHER] -= right
            moved[:, h] += left
            moved[h] += right
            rows_, columns = pairs.sum(axis=1), pairs.sum(axis=0)
            rows_[h] += left.sum()
            columns[h] += left.sum()
            inner = xlogx(moved)
            inner[M.OTHER, M.OTHER] = 0
            value.append(inner.sum() - xlogx(rows_)[: M.CLASSES].sum() - xlogx(columns)[: M.CLASSES].sum())
        final[w] = int(np.round(np.array(value) - max(value), 6).argmax())
    of = lambda w: M.END if w is None else final.get(w, M.UNKNOWN)
    full = np.zeros((M.GROUPS, M.GROUPS))
    mass = np.zeros(M.GROUPS)
    for a, b in zip(line, line[1:]):
        once = [w is not None and count[w] == 1 for w in (a, b)]
        full[of(a), of(b)] += 1
        mass[of(b)] += 1
        full[of(a), M.UNKNOWN] += once[1]
        full[M.UNKNOWN, of(b)] += once[0]
        full[M.UNKNOWN, M.UNKNOWN] += once[0] and once[1]
    steps = M.transitions(full)
    twice = sum(c == 2 for c in count.values())
    once = sum(c == 1 for c in count.values())
    unseen = 1 + once * (once - 1) / (2 * (twice + 1))
    count[None] = sum(learn)
    total, kinds = sum(count.values()), len([c for c in count.values() if c])
    out = []
    for t in texts:
        own = [None, *t, None]
        score = sum(steps[of(a), of(b)] for a, b in zip(own, own[1:]))
        score += sum(math.log10(count[w]) - math.log10(mass[of(w)]) if count[w] else -math.log10(unseen) for w in t)
        out.append((score, sum(count[w] > 0 for w in own[1:]), sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own[1:]), total))
    return out


@pytest.mark.parametrize("head,rounds", [(M.HEAD, 2), (30, 2), (0, 1)])
def test_scores_match_plain_version(spark, head, rounds):
    rng = random.Random(5)
    vocabulary = data.WORDS + [f"seldom{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, [20] * len(data.WORDS) + [1] * 40, k=rng.choice([0, 1, 4, 15]))), "en", "a", 1, None, None, None) for i in range(40)]
    rows += [(100, None, *[None] * 6), (101, " \t", "en", "a", 1, None, None, None), (None, "ban NEVER seen", "en", "a", 1, None, None, None), (rows[3][0], rows[3][1].upper(), *rows[3][2:])]
    rows += [(102, "twin twin twin É é", "en", "a", 1, None, None, None), rows[7], rows[7]]
    docs = data.frame(spark, rows).withColumnRenamed("mix", "row").withColumnRenamed("features", "key").repartition(3)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6), round(r.score, 6)) for r in M.score_texts(docs, head, rounds).collect())
    plain = plain_model(rows, head, rounds)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want = sorted((r[0] or -1, len(data.words(r[1])) + 1, p[1], p[3], held(r[0]), round(p[2], 6), round(p[0], 6)) for r, p in zip(rows, plain))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=0, atol=1e-5)


def test_no_rows_and_no_training_rows(spark):
    assert M.score_texts(data.frame(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = M.score_texts(data.frame(spark, [(only, "a b", *[None] * 6)])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.held_out) for r in got] == [(3, 0, 0, 0.0, True)]
    assert math.isfinite(got[0].score) and got[0].score < 0


def test_transitions_sum_to_one_after_every_class():
    full = np.random.default_rng(0).poisson(0.3, (M.GROUPS, M.GROUPS))
    full[5] = 0
    assert np.allclose((10 ** M.transitions(full)).sum(axis=1), 1)


def test_held_out_texts_are_likelier_than_by_base(spark):
    """Texts of two invented languages: the classes tell them apart, and shuffled words are less likely than the text."""
    rng = random.Random(1)
    tongues = [[f"{a}{b}{c}" for a in s for b in "aeiou" for c in "nrst"] for s in ("bcdf", "klmp")]

    def text(t):
        return " ".join(rng.choice(tongues[t][j % 2 * 40 : j % 2 * 40 + 40]) for j in range(60))

    rows = [(i, text(i % 2), *[None] * 6) for i in range(400)] + [(5_000_000, "x" * 4_500_000 + " " + "ban " * 10, *[None] * 6)]
    mixed = [(1000 + i, " ".join(rng.sample(words, len(words))), *[None] * 6) for i, words in enumerate(data.words(text(0)) for _ in range(80))]
    got = [r for r in M.score_texts(data.frame(spark, rows + [m for m in mixed if zlib.crc32(str(m[0]).encode()) % 7 == 2])).collect() if r.held_out]
    plain, shuffled = ([r for r in got if lo <= r.doc_id < lo + 1000] for lo in (0, 1000))
    assert len(plain) > 30 and len(shuffled) > 5 and all(r.score > r.base_score + 15 for r in plain)
    assert max(r.score / r.n_tokens for r in shuffled) < min(r.score / r.n_tokens for r in plain)
