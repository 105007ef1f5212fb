"""Operators on many documents against brute force: near duplicates, URL filter, packing, mixing, repeated passages, pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from acreage.llm import mixing, near_dedup, packing, suffix_dedup, url_filter
from acreage.llm import text as X
from acreage.llm.suffixes import suffix_array
from acreage.session import cut
from tests.llm import data

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_near_duplicates_match_brute_force(spark, percent):
    rows = data.documents()
    got = near_dedup.near_duplicates(data.frame(spark, rows), percent).collect()
    assert len(got) == len(rows)
    want, sets = data.components(rows, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == want[0] and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_chains_and_stars(spark):
    """Members that are like the original but not like each other, and chains whose ends are unlike."""
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = data.sentence(rng, 300).split()
        current = list(base)
        for i in range(40):
            own = list(base) if family < 2 else current
            for j in rng.sample(range(300), 3 + (family == 1) * rng.randrange(6)):
                own[j] = f"w{family}x{i}x{j}"
            rows.append((family * 100 + i, " ".join(own), "en", "a", 1, None, None, None))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(data.frame(spark, rows), 85).collect()}
    assert got == data.components(rows, 85)[0]


def test_one_of_each_keeps_the_columns_whatever_their_names(spark):
    names = {"lang": "blank", "source": "first", "n_chars": "component_id", "label": "id", "mix": "key", "features": "node"}
    rows = [r for r in data.documents() if r[0] != 5] + [(1 << 62, "far away id", *[None] * 6), (-(1 << 63), "another one", *[None] * 6)]
    docs = data.frame(spark, rows).withColumnsRenamed(names)
    out = near_dedup.one_of_each(docs)
    want, _ = data.components(rows, 80)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, c in want.items() if i == c)
    assert near_dedup.one_of_each(docs.limit(0)).count() == 0
    assert near_dedup.near_duplicates(data.frame(spark, [])).count() == 0


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.example.com", "a.www.example.com", "notexample.com", "x.net", "net", "b.spam-farm.example.org", "org", "", "com.", "user@x.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/a?b=/x", "/es/#/y", "/fr/z", "?q", "/EN/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "example.com/en/", "a://b://com/", "http://example.com/en/\nx"]
    pages = spark.createDataFrame([(i, u, "shadow") for i, u in enumerate(urls)] + [(7, urls[7], "twice")], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.listed(spark)).collect()}
    listed = [(e, v, True) for e, v in url_filter.RULES] + [(f"{s}.{z}/", "block", False) for s in url_filter.LISTED_SITES for z in url_filter.LISTED_ZONES]
    for i, url in enumerate(urls):
        rest = url[url.index("://") + 3 :] if url and "://" in url else ""
        host = data.lower(re.match(r"(?s)[^/?#]*", rest).group())
        path = re.match(r"(?s)[^?#]*", rest[len(host) :]).group()
        fits = [(len(e), e, v, r) for e, v, r in listed for h, p in [(e.split("/")[0], e[e.index("/") :])] if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        rule, other = max((f for f in fits if f[3]), default=None), max((f for f in fits if not f[3]), default=None)
        verdict = rule[2] if rule else other[2] if other else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule and rule[1], verdict), url
    assert url_filter.filter_urls(pages.limit(0), url_filter.listed(spark)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = [f"h{i}.example/{i}/" for i in range(5000)]
    table = url_filter.bloom_filter(spark.createDataFrame([(k,) for k in keys], "entry string"))
    assert url_filter.may_hold(table, keys).all()
    assert url_filter.may_hold(table, [f"other{i}/" for i in range(5000)]).mean() < 0.02


def test_packing_is_gapless_and_whole(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = data.documents() + [(5000 + i, data.sentence(rng, rng.choice([1, 10, 300, 3000])) + " <|endoftext|> İΣς Éé", "en", "a", 1, None, None, None) for i in range(200)]
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    got = packing.pack_documents(data.frame(spark, rows).repartition(3), path).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*tool.encode(r[1] or "", add_special_tokens=False).ids, 2])
    per_sequence, per_doc = defaultdict(list), defaultdict(Counter)
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and any(own == x[r.start : r.start + r.length] and r.doc_tokens == len(x) for x in ids[r.doc_id])
        per_sequence[r.sequence_id].append((r.offset, r.length, r.window))
        per_doc[r.doc_id].update(range(r.start, r.start + r.length))
    for parts in per_sequence.values():
        at = 0
        for offset, length, window in sorted(parts):
            assert offset == at
            at += length
        assert at == window and at <= 4096 and at & (at - 1) == 0
    for key, texts in ids.items():
        assert per_doc[key] == Counter(i for x in texts for i in range(len(x)))
    steps = defaultdict(Counter)
    for r in got:
        steps[r.step_group][r.sequence_id] = r.window
    assert all(len(set(s.values())) == 1 and sum(s.values()) <= packing.STEP_TOKENS for s in steps.values())
    assert packing.pack_documents(data.frame(spark, []), path).count() == 0


def test_mix_matches_sql_and_targets(spark):
    import duckdb

    rows = data.documents(3, 300)
    docs = data.frame(spark, rows)
    got = mixing.mix_sources(docs, ["doc_id", "mix"]).toDF("doc_id", "old", "mix").select("doc_id", "mix.*").collect()
    con = duckdb.connect()
    con.register("raw", docs.select("doc_id", "text", "source").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM raw")
    want = con.execute(mixing.ORACLE).fetchall()
    assert Counter((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == Counter(want)
    taken = defaultdict(int)
    targets = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[(r.source_size, r.target)] += r.taken
        targets[(r.source_size, r.target)] = r.target
    assert all(abs(taken[k] - t) <= 1 for k, t in targets.items())
    assert sum(targets.values()) == pytest.approx(sum(len(data.words(r[1])) for r in rows))
    assert mixing.mix_sources(data.frame(spark, []), ["doc_id"]).count() == 0


def test_mixed_documents_hold_the_taken_words(spark):
    docs = data.frame(spark, data.documents(3, 300))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    plan = mixing.mix_sources(docs, ["doc_id", "text"]).select("doc_id", "text", "mix.taken").collect()
    assert sum(len(data.words(r.text)) for r in out.collect()) == sum(r.taken for r in plan)


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for t in range(3000):
        s = [rng.randrange(1, rng.choice([2, 3, 4, 7])) for _ in range(rng.randrange(25))]
        s = (s[: max(1, len(s) // 4)] * 8)[: len(s) + 5] if t % 3 == 0 else s
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def _cut(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        flags = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, flags) if not g)
        yield int(flags.sum()), int((np.diff(np.concatenate(([0], flags.astype(int)))) == 1).sum()), kept


@pytest.mark.parametrize(("length", "limit"), [(200, 20_000), (40, 20_000), (40, 1), (200, 1)])
def test_repeats_match_brute_force(spark, length, limit):
    rows = data.documents()
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], len(t), n, s, hashlib.sha256(kept).hexdigest()) for r, t, (n, s, kept) in zip(rows, texts, _cut(texts, length)))
    got = suffix_dedup.remove_repeats(data.frame(spark, rows), length, limit).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_texts_without_repeats(spark):
    rows = data.documents()
    docs = data.frame(spark, rows)
    out = suffix_dedup.without_repeats(docs)
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], kept.decode("utf-8", "ignore")) for r, (_, _, kept) in zip(rows, _cut(texts, 200)))
    assert out.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in out.collect()) == want
    assert suffix_dedup.remove_repeats(data.frame(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage works on all its predecessor kept, by brute force where the stage is exact."""
    rng = random.Random(9)
    rows = data.documents(4, 80) + [(7000 + i, "### " * 90, "en", "a", 1, None, None, None) for i in range(3)]
    docs = data.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], rng.choice([0, 1]), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "packed"]
    good = stages["quality_rules"](spark, docs, str(tmp_path)).cache()
    assert good.columns == docs.columns
    assert all(len(data.words(r.text)) >= 50 and "###" not in r.text for r in good.collect())
    one = stages["near_duplicates"](spark, good, str(tmp_path)).cache()
    want, _ = data.components([tuple(r) for r in good.collect()], 80)
    assert Counter(r.doc_id for r in one.collect() if r.doc_id is not None) == Counter(i for i, c in want.items() if i == c)
    plain = stages["repeated_passages"](spark, one, str(tmp_path)).cache()
    left = one.collect()
    assert Counter((r.doc_id, r.text) for r in plain.collect()) == Counter((r.doc_id, kept.decode("utf-8", "ignore")) for r, (_, _, kept) in zip(left, _cut([r.text.encode() for r in left], 200)))
    total = sum(len(data.words(r.text)) for r in plain.collect())
    mixed = stages["source_mix"](spark, plain, str(tmp_path)).cache()
    assert abs(sum(len(data.words(r.text)) for r in mixed.collect()) - total) <= 4
    pieces = stages["packed"](spark, mixed, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.collect()} and all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()  # cuts depend on the partitions
    assert sum(r.length for r in whole) == sum(r.length for r in pieces)


def test_pipeline_keeps_a_text_that_has_a_copy_without_id(spark, tmp_path):
    rng = random.Random(12)
    texts = [data.sentence(rng, 120) for _ in range(8)]
    near = texts[1].split()
    near[60] = "edited"
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, " ".join(near)), (None, texts[7] + " end"), (None, texts[0]), (5, texts[6]), (40, "")]
    rows += [(None, t) for t in [data.sentence(rng, 120)] * 3]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    one = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in one) == Counter([*rows[:6], (5, texts[6]), rows[7], (40, ""), rows[-1]])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == {0, 1, 2, 3, 4, 5, 7, None}


@pytest.mark.parametrize("stage", ["near_duplicates", "repeated_passages", "source_mix", "packed"])
def test_stages_hold_little_beside_the_heap(spark, tmp_path, stage):
    """A stage alone has the session read through a stream and hand small batches to Python; a caller's own choice stays."""
    vectored, batch = "parquet.hadoop.vectored.io.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
    own, told = spark.newSession(), spark.newSession()
    dict(corpus_pipeline.STAGES)[stage](own, data.frame(own, data.documents(2, 10)), str(tmp_path))
    assert own.conf.get(vectored, None) == "false"
    assert stage == "source_mix" or own.conf.get(batch) == "4m"
    told.conf.set(vectored, "true")
    told.conf.set(batch, "8m")
    cut(X.small_batches(told.range(3)))
    assert (told.conf.get(vectored), told.conf.get(batch)) == ("true", "8m")
