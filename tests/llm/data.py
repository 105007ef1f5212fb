"""Small fixtures and brute-force versions for the tests of acreage.llm."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, mix string, features string"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("", "ra", "sto") for c in ("n", "t", "s", "qua")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1, n=60):
    """Rows with nulls, empty, blank and very long texts, exact and near copies, repeated rows, shared passages."""
    rng = random.Random(seed)
    passage = sentence(rng, 80)
    rows = []
    for i in range(n):
        text = sentence(rng, rng.choice([3, 20, 60, 120]))
        if i % 7 == 0:
            text = f"{sentence(rng, 30)}\n{passage} {sentence(rng, 20)}"
        rows.append([i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), len(text), None, "x", None])
    base = sentence(rng, 200).split()
    for i in range(n, n + 12):  # a family: copies of one text with more and more words changed
        words = list(base)
        for j in rng.sample(range(200), (i - n) // 2):
            words[j] = f"new{i}x{j}"
        rows.append([i, " ".join(words), "en", "a", 0, 1, None, None])
    rows += [[900, None, None, None, None, None, None, None], [901, "", "en", "b", 0, 0, "", ""], [902, " \t\n ", "fr", "b", 4, 0, "", ""], [903, rows[3][1].upper(), "en", "a", 1, 1, "", ""]]
    rows += [[904, "Ünïcode çà et là \U0001f600 漢字 " * 3, "fr", "é", 9, None, None, None], [905, sentence(rng, 6000), "en", "a", 1, None, None, None], [None, rows[0][1], "en", "a", 1, None, None, None]]
    rows += [list(rows[5]), list(rows[5]), [906, "x" * 5000, "en", "b", 5000, None, None, None]]
    return [tuple(r) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    own = words(lower(text))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())


def components(rows, percent):
    """Smallest reachable doc_id by doc_id."""
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets
