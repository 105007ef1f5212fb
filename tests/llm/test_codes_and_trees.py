"""Vector codes and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from acreage.llm import merkle, vector_codes
from tests.llm import data


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row, text):
    return sha("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def climb(nodes):
    """All levels from ``nodes`` to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, place):
    steps = []
    for level in levels[:-1]:
        first = place // 3 * 3
        steps.append(("".join(level[first:place]), "".join(level[place + 1 : first + 3])))
        place //= 3
    return steps


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        trees[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), plain_leaf(r, changed), r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    crown = climb([grown[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, (_, _, leaf, start, doc_id) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            steps = path(grown[s], i) + path(crown, place)
            node = start
            for left, right in steps:
                node = sha(left + node + right)
            out.append((doc_id, leaf, grown[s][-1][0], crown[-1][0], sha("".join(a + b for a, b in steps)), node, node == crown[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def collected(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_manifest_matches_brute_force(spark, n):
    rows = data.documents(n=60) if n == 60 else data.documents(n=60)[:n]
    assert collected(merkle.manifest(data.frame(spark, rows))) == Counter(plain_manifest(rows))


def test_manifest_over_several_bands_and_one_large_source(spark):
    """A source of 7,000 leaves needs nine levels, so three bands; others have a leaf, a run, and one more than a block."""
    rng = random.Random(4)
    sizes = {"big": 7000, None: 82, "one": 1, "three": 3, "é": 81, "": 4}
    ids = iter(rng.sample(range(10**9), sum(sizes.values())))
    rows = [(next(ids), f"line {rng.random()}\nend", "en", s, i, None, None, None) for s, n in sizes.items() for i in range(n)]
    rows += [(5, "x" * 5_000_000 + "\n", "en", "long", 1, None, None, None)] + [(7, "same", "en", "copies", 4, None, None, None)] * 40
    rng.shuffle(rows)
    docs = data.frame(spark, rows).withColumnRenamed("mix", "tree").withColumnRenamed("features", "digest").withColumnRenamed("label", "__row")
    assert collected(merkle.manifest(docs.repartition(5))) == Counter(plain_manifest(rows))


def test_proofs_hold_only_siblings(spark):
    rows = [(i, f"text {i}", "en", "a", 1, None, None, None) for i in range(100)]
    got = merkle.proofs(merkle.leaves_of(data.frame(spark, rows)), ["doc_id", "digest"], ["doc_id"]).collect()
    for r in got:
        assert len(r.path) == 5 and all(len(s.left + s.right) <= 128 for s in r.path)


def plain_codes(rows):
    kept = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    size = len(kept[0][1]) // 16
    books = [[first[i][p * size : (p + 1) * size] for i in sorted(first)[:64]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(2):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                x = v[p * size : (p + 1) * size]
                groups[p, nearest(p, x)[1]].append(x)
        for (p, j), xs in groups.items():
            books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, label, [nearest(p, v[p * size : (p + 1) * size]) for p in range(16)]) for i, v, label in kept]
    sums = Counter()
    for _, label, best in found:
        sums[label] += sum(d for d, _ in best)
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return Counter((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), sums[label], digest) for i, label, best in found)


def vectors(seed=3, n=200, dims=48):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6) if i % 9 else None, [rng.gauss(0, 0.3) for _ in range(dims)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(1, None, 0), (2, [None] * dims, 0), (3, [math.nan] * dims, 1), (4, [math.inf] + [0.0] * (dims - 1), 1), (0, [], 2)]
    rows += [(5, [0.25] * dims, 3), (6, [-0.25] * dims, 3)] + [(7, [0.001] * dims, 4)] * 30 + [rows[20]] * 3  # ties, copies
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,dims", [(200, 48), (20, 16), (400, 160)])
def test_vector_codes_match_brute_force(spark, n, dims):
    rows = vectors(n=n, dims=dims)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, rid int").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = vector_codes.vector_codes(frame).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(exact)


def test_vector_codes_of_no_rows_other_lengths_and_huge_numbers(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 32, 0), (0, [0.5] * 30, 0), (2, [0.5] * 16, 0), (3, [3e38] * 32, 0), (4, [-3e38] * 32, 1)]
    assert {r.vec_id for r in vector_codes.vector_codes(spark.createDataFrame(rows, schema)).collect()} == {1, 3, 4}


def test_masks_give_every_entry_in_the_box():
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-50, 50, (64, 4)), rng.integers(-60, 60, (500, 4))
    book = vector_codes.Codebook(entries)
    radius = book.radius(parts)
    want = (np.abs(parts[:, None, :] - entries[None]) <= radius[:, None, None]).all(axis=2)
    got = (book.candidates(parts, radius)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert (got.astype(bool) == want).all() and want.any(axis=1).all() and want.sum() < 500 * 64 / 2


def test_codes_decode_near_the_vector(spark):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(10)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in centres[i % 10]], 0) for i in range(300)]
    coded, entries = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    for r in coded.collect():
        assert np.abs(vector_codes.decode(r.code, entries) - np.array(rows[r.vec_id][1])).max() < 0.1
