"""Operators on single texts against brute force: licences, token counts, quality rules, languages, fingerprints."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from acreage.llm import fingerprints, languages, licences, quality, queries, token_counts
from tests.llm import data

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_licences_match_brute_force(spark):
    rows = data.documents() + [
        (1000, "Released under the MIT License. mit-license, MIT\nlicense!", "en", "a", 1, None, None, None),
        (1001, "GNU General Public License; Apache License mit license apache license", "en", "a", 1, None, None, None),
        (1002, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n code", "en", "a", 1, None, None, None),
    ]
    got = sorted(licences.scan_licences(data.frame(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower(texts[r.doc_id]))
        hits = [(i, label) for i in range(len(own)) for phrase, label in licences.BASE.items() if own[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(own), len(hits))
        assert r.first_word == (min(hits)[0] if hits else None) and r.last_word == (max(hits)[0] if hits else None)
        assert r.base_labels == ",".join(sorted({label for _, label in hits})) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[1002].labels == "apache-2.0,gpl-2.0-only,mit" and by_id[1002].score == pytest.approx(0.4)
    assert by_id[900].labels == "" and by_id[900].score == 0
    assert licences.scan_licences(data.frame(spark, [])).count() == 0


def test_licence_expressions():
    value = lambda text: licences.evaluate(licences.to_postfix(text))
    assert licences.to_postfix("MIT or GPL-2.0-only and (ISC or MPL-2.0)") == ["mit", "gpl-2.0-only", "isc", "mpl-2.0", "or", "and", "or"]
    assert value("MIT OR GPL-2.0-only")[1] == 1.0 and value("MIT AND GPL-2.0-only")[1] == 0.3
    assert value("(MIT OR") == ({"mit"}, 1.0) and value("MIT and this is prose") == ({"mit", "this"}, 0.5) and value("") == (set(), None)
    assert value(") MIT") == (set(), None) and value("((MIT") == ({"mit"}, 1.0)


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_token_counts_match_the_library(spark, head):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    signs = [*"ab'sStmdrevl  \n\t.,!?0123éÈß çñ'<|>", "<|endoftext|>", "'ll", "İ", "²", "漢", "\U0001f600", "\u3000", "  "]
    rows = data.documents() + [(2000 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(40))), "en", "a", 1, None, None, None) for i in range(500)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    got = token_counts.count_tokens(data.frame(spark, rows), path, head=head).collect()
    want = [(r[0], len((r[1] or "").encode()), len(tool.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((*w, w[2] > 512) for w in want)


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(data.frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def _brute_features(text):
    own, text = data.words(text), text or ""
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if data.words(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_features_match_brute_force(spark):
    rows = data.documents() + [(3000, "a b c a b c a b c\nx y\nx y\n\nx y \n" * 30, "en", "a", 1, None, None, None), (3001, "### *** $$$ " * 40, "en", "a", 1, None, None, None)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None] + [(None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(data.frame(spark, rows), labels).collect()
    want = Counter()
    for r in rows:
        n, chars, symbols, dup, rep = _brute_features(r[1])
        want[(r[0], n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality.quality_rules(data.frame(spark, rows), empty).collect())
    assert quality.quality_rules(data.frame(spark, []), labels).count() == 0


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (20, 0.05), (300, 0.01), (300, 0.5)):
        total = 0.0
        for k in range(n):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert quality.binomial_tail(k, n, p) == pytest.approx(total, rel=1e-9, abs=1e-13)
    assert quality.binomial_tail(5, 5, 0.1) == 1.0


def test_cutoffs_limit_false_rejections(spark):
    rng = random.Random(5)
    rows = [(i, data.sentence(rng, 100) + (" ###" * 30 if i % 3 == 0 else ""), "en", "a", 1, None, None, None) for i in range(3000)]
    labels = spark.createDataFrame([(r[0], 0 if r[0] % 3 == 0 else 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    docs = data.frame(spark, rows)
    kept = {r.doc_id for r in quality.quality_rules(docs, labels).filter("kept").collect()}
    good = {r[0] for r in rows if r[0] % 3}
    assert len(good - kept) <= quality.ALPHA * len(good) and not {i for i in kept if i % 3 == 0}
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, " 12 ?!", "en", "a", 0), (10**6 + 2, "", None, "a", 0), (None, "the thing", "en", "a", 0)], docs.schema)
    rows = docs.unionByName(extra)
    got = {r.doc_id: r for r in languages.identify(rows).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert [got[10**6 + j].lang_pred for j in range(3)] == ["und"] * 3 and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in languages.identify(rows.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert languages.identify(rows.limit(0)).count() == 0


def test_languages_of_more_than_one_plane(spark):
    """Seventy languages of own words, and sixty labels that stand once: three planes."""
    rng = random.Random(70)
    words = {f"l{j:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12)] for j in range(70)}
    rows = [(i, " ".join(rng.choices(words[lang], k=60)), lang, "a", 0) for i, lang in enumerate(sorted(words) * 16)]
    rows += [(5000 + i, "qq", f"stray{i}", "a", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    held = [r for r in rows[:1120] if got[r[0]].held_out]
    assert len(got) == len(rows) and len({r[2] for r in held}) == 70
    assert all(got[i].lang_pred == lang and got[i].score > 0.5 for i, _, lang, _, _ in held)


def test_fingerprints_of_edited_and_next_texts(spark):
    rows = data.documents()
    got = fingerprints.fingerprint_documents(data.frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = Counter()
    for r, following in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", following[1] or ""
        k = len(text) // 3
        want[(r[0], len(text), hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    marks = {}
    for r in got:
        marks.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(len(m) == 1 for m in marks.values()) and marks[900] == marks[901] == {"3::"}
    long = next(r for r in got if r.doc_id == 905)
    assert long.near_edited > 0.4
    family = {r.doc_id: r.near_next for r in got if r.doc_id is not None and 61 <= r.doc_id <= 65}
    assert min(family.values()) > 0.5
    one = fingerprints.fingerprint_documents(data.frame(spark, rows[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprint_documents(data.frame(spark, [])).count() == 0


def test_every_query_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
