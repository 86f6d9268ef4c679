"""Operators on odd rows (see conftest.ODD), empty tables, small limits, against plain versions."""

from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import LONG, ODD, PASSAGE, rows_as_table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caselake.llm import (bloom, bpe, components, decontaminate, exact_dedup, ngram_join, pii, quality, substring, token_rollup,
                          toxicity, url_filter)
from caselake.session import materialize

WITH_ID = [(d, t) for d, t in dict(ODD).items() if d is not None]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) as k")
    built = bloom.build(keys.filter("k < '2'"), "k", 8)
    asked = bloom.ask(keys.unionByName(spark.createDataFrame([(None,)], "k string")), "k", 8, built)
    assert asked.filter("k < '2' and not possible").isEmpty()
    assert asked.filter("k is null").first().possible is False


def test_exact_dedup_odd_rows(spark, odd, empty):
    rows = exact_dedup.mark_copies(odd).collect()
    groups = Counter(brute.sha(brute.spaced(t)) for _, t in ODD)
    assert len(rows) == len(ODD) and all(r.group_size == groups[r.text_sha256] for r in rows)
    smallest = {}
    for d, t in ODD:
        if d is not None:
            h = brute.sha(brute.spaced(t))
            smallest[h] = min(d, smallest.get(h, d))
    assert all(r.keep_id == smallest.get(r.text_sha256) for r in rows)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(dict.fromkeys(groups, 1))
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.mark_copies(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_exact_dedup_hot_group_and_full_filter(spark):
    """A third of all rows is one text; a filter of one block lets everything pass and changes nothing."""
    docs = rows_as_table(spark, [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(900)], "hot", False)
    want = sorted(tuple(r)[:5] for r in exact_dedup.mark_copies(docs).collect())
    assert want == sorted(tuple(r)[:5] for r in exact_dedup.mark_copies(docs, max_blocks=1).collect())
    assert sum(r[3] for r in want) == len({"hot" if i % 3 == 0 else f"text {i // 2}" for i in range(900)})


def test_pii_odd_rows(spark, odd, empty):
    got = pii.find(odd).collect()
    assert len(got) == len(ODD)
    for d, t in WITH_ID:
        row = next(r for r in got if r.doc_id == d)
        base = [f"{s.kind}:{s.start}:{s.end}" for s in row.spans if s.kind in pii.BASE_KINDS]
        assert base == brute.personal_data(t)
    kinds = {s.kind for r in got for s in r.spans}
    assert kinds == {"email", "ip", "card", "phone", "account", "handle", "userinfo"}
    masked = pii.mask(odd)
    assert masked.columns == odd.columns
    text = masked.filter("doc_id = 13").first().text
    assert text.startswith("[EMAIL] and [EMAIL], [IP] or 999.1.1.1.1; [CARD], [PHONE] user: [ACCOUNT] [HANDLE]")
    assert pii.find(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.+-1 2(9)_%é\n", max_size=40))
def test_pii_finder_equals_patterns(text):
    spans = [f"{k}:{a}:{b}" for k, a, b in pii.Finder().spans(text) if k in pii.BASE_KINDS]
    assert spans == brute.personal_data(text)


def test_quality_and_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 19)] + [(None, 1, 1), (2, None, None), (1, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    none = labels.filter("false")
    for operator in (quality.score, toxicity.score):
        rows = operator(odd, labels).collect()
        assert len(rows) == len(ODD) and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
        for docs, given_labels, n in ((odd, none, len(ODD)), (empty, labels, 0), (empty, none, 0), (odd, labels.filter("quality = 1"), len(ODD))):
            assert operator(docs, given_labels).count() == n
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.drop_toxic(odd, none).count() == len(ODD)


def test_toxicity_gathers_all_rows_and_never_reads_held_out_labels(spark, small):
    docs, _ = small
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_kneser_ney_sums_to_one(spark):
    """The shared lower-order model equals a plain one, which is a distribution over the next byte."""
    grams = [w.rjust(6) for w in (b"a", b"ab", b"abc", b"xb", b"xab", b"zzab", b"yab ", b"ab ")]
    counted = spark.createDataFrame([(int.from_bytes(w, "big"), 1, 2) for w in grams], "gram long, toxic long, ordinary long")
    low = {r.low_key.to_bytes(4, "big"): r.low for r in toxicity._shared(counted).collect()}
    plain = brute.continuations(grams, toxicity.DISCOUNT)
    assert set(low) == {g[2:] for g in grams}
    for key, p in low.items():
        assert p == pytest.approx(plain(key[:3], key[3:]))
        assert sum(plain(key[:3], bytes([b])) for b in range(256)) == pytest.approx(1)


def test_quality_features_fit_and_threshold(spark, odd, small):
    texts = [t for _, t in ODD] + [t for _, t in small[1]] + ["A  a a\r\n\r\nB!? <x> #1\x00", "\n", "é É é"]
    got = quality.features(pa.array(texts, pa.string()))
    assert np.allclose(got, [brute.surface(t) for t in texts], atol=1e-9)
    draw = np.random.default_rng(1)
    good, bad = draw.normal(0.4, 1, (300, 4)), draw.normal(0, 1, (200, 4))
    w = quality.fit(good, bad, 2000)
    pick = np.random.default_rng(7)
    x = good[pick.integers(0, 300, 2000)] - bad[pick.integers(0, 200, 2000)]
    loss = lambda v: np.log1p(np.exp(-x @ v)).sum() + 1e-3 * len(x) * (v @ v) / 2
    assert all(loss(w) < loss(w + e) for e in draw.normal(0, 0.05, (50, 4)))
    labels = spark.createDataFrame([(d, i % 3 != 0) for i, (d, _) in enumerate(small[1])], "doc_id long, q boolean").selectExpr(
        "doc_id", "int(q) quality")
    rows = [r for r in quality.score(small[0], labels).collect() if not r.held_out]
    known = {r.doc_id: r.quality for r in labels.collect()}
    bad_rows = sum(known[r.doc_id] == 0 for r in rows)
    assert abs(sum(r.predicted == 0 for r in rows) - bad_rows) <= max(2, 0.02 * len(rows))


@pytest.mark.parametrize("query, want", [
    ("", ""), ("?", ""), ("?utm_source=x", ""), ("?utm_source=x&id=1", "?id=1"), ("?id=2&utm_source=x", "?id=2"),
    ("?id=2&utm_a=1&b=&&c", "?id=2&b=&&c"), ("?xutm_a=1", "?xutm_a=1"), ("?a=1?utm_b=2", "?a=1?utm_b=2"), ("?id=1#utm_a&x=2", "?id=1")])
def test_canonical_query(spark, query, want):
    pages = spark.createDataFrame([("https://www.A.example:80/p/" + query,)], "url string")
    assert url_filter.with_parts(pages).select(url_filter.canonical("url")).first()[0] == "a.example/p" + want


def test_filter_with_clashing_columns(spark):
    rows = spark.createDataFrame([(i, i, "x", True) for i in range(100)], "k long, __block long, __lane0 string, possible boolean")
    keys = materialize(rows.filter("k < 10").select(F.col("k").alias("key")), "keys")
    sure, possible = bloom.apart(rows, "k", keys, "key", "clash")
    assert sure.columns == possible.columns == rows.columns
    assert sure.count() + possible.count() == 100 and possible.filter("k < 10").count() == 10 and sure.count() > 60


def _states(rows):
    return sorted(((r.source, r.lang, r.version, r.n_docs, r.n_tokens) for r in rows), key=str)


def test_token_rollup(spark):
    rollup = token_rollup.scratch(spark)
    schema = "doc_id long, version string, op string, source string, lang string, n_tokens long, seq long"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    assert rollup.totals().count() == 0
    first = batch([(1, "v1", "insert", "a", "en", 10, 0), (2, "v1", "insert", "a", None, 5, 0), (2, "v1", "insert", "a", None, 7, 1),
                   (3, "v1", "revise", None, "en", None, 0), (None, "v1", "insert", "a", "en", 99, 0), (4, "v1", "delete", "a", "en", 1, 0)])
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert _states(rollup.totals().collect()) == sorted([("a", "en", "v1", 1, 10), ("a", None, "v1", 1, 7), (None, "en", "v1", 1, 0)], key=str)
    second = batch([(1, "v1", "revise", "b", "en", 4, 0), (2, "v1", "delete", None, None, None, 0), (1, "v2", "insert", "b", "en", 3, 0)])
    # A commit that broke off leaves files without a commit; the next try replaces them.
    first.write.parquet(rollup._path("deltas", "two"))
    assert rollup.commit("two", second) and rollup.batches() == ["one", "two"]
    want = sorted([("b", "en", "v1", 1, 4), (None, "en", "v1", 1, 0), ("b", "en", "v2", 1, 3)], key=str)
    assert _states(rollup.totals().collect()) == want
    assert _states(rollup.state().groupBy("source", "lang", "version").agg({"*": "count", "n_tokens": "sum"}).toDF(
        "source", "lang", "version", "n_docs", "n_tokens").collect()) == want
    assert rollup.commit("three", first.filter("false")) and _states(rollup.totals().collect()) == want
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("four", batch([(1, "v1", "upsert", "a", "en", 1, 0)]))
    assert rollup.batches() == ["one", "two", "three"]


def test_url_filter_odd_rows(spark):
    rows = [(1, "https://WWW.bad.example/x/"), (2, "http://bad.example/x#top"), (3, "http://bad.example/x?utm_a=1"), (4, None), (5, "no scheme"),
            (6, "x://a.net"), (7, "x://a.net/"), (8, "x://sub.Example.NET/en/1?q"), (9, "x://example.com/de/"), (10, "x://example.com/de"),
            (11, "x://u.org/fr/1"), (12, "x://notexample.com/de/1"), (13, "http://bad.example/y"), (13, "http://bad.example/y"), (14, "://"), (15, "")]
    pages = spark.createDataFrame([(i, u, "h", "r", True) for i, u in rows], "page_id long, url string, host string, rule string, __possible boolean")
    pages = pages.drop("__possible")
    listed = spark.createDataFrame([("bad.example/x",), (None,), ("bad.example/x",)], "canonical_url string")
    out = url_filter.judge(pages, listed).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert [got[i][3] for i in range(1, 16)] == ["block"] * 3 + ["allow"] * 3 + ["block", "allow", "block"] + ["allow"] * 6
    assert got[4] == ("", "", None, "allow") and got[5][:2] == ("", "") and got[7][2] == "net/" and got[6][2] is None
    assert got[8] == ("sub.example.net", "/en/1", "example.net/en/", "allow") and got[12][2] is None
    assert url_filter.judge(pages.filter("false"), listed).count() == 0
    assert url_filter.judge(pages, listed.filter("false")).filter("verdict = 'block'").count() == 2


def test_bpe_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [t for _, t in ODD] + ["it's<|endoftext|>I'LL  x\x00y\x1cz İ ΣΑΣ ﬁ e\u0301 日本 😀😀", "<|startoftext|>", "a\u3000b"]
    docs = rows_as_table(spark, list(enumerate(texts)), "bpe")
    for kind in ({}, {"chunk_bytes": 50, "partitions": 3}):
        got = {r.doc_id: r for r in bpe.encode(docs, path, **kind).collect()}
        for i, text in enumerate(texts):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids
            assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes() and got[i].n_tokens == len(ids)
            assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd, path).count() == len(ODD) and bpe.encode(empty, path).count() == 0
    rows = [(1, [int(x) for x in np.frombuffer(got[0].ids, "<u4")]), (1, [49407, 3306]), (2, []), (3, None), (None, [1, 999_999, 2])]
    back = sorted(bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<long>"), path).collect(), key=str)
    assert sorted(r.decoded for r in back) == sorted([got[0].decoded, "<|endoftext|> hello</w>", "", "", '" #'])


BENCHMARK = [(1, "Shared10 shared11 SHARED12 shared13, shared14 shared15 shared16 shared17 shared18 shared19 shared20"), (2, "one TWO three"),
             (2, "one TWO three"), (3, None), (4, "..."), (None, "seven"), (10, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9")]


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    want = brute.contamination(WITH_ID, [(i, t) for i, t in BENCHMARK if t])
    for kind in ({}, {"block_words": 12}):
        rows = decontaminate.find(odd, bench, **kind).collect()
        assert len(rows) == len(ODD)
        for r in rows:
            if r.doc_id is not None:
                n, hit, items = want[r.doc_id]
                assert (r.n_words, r.n_hit, r["items"]) == (n, hit, [i for i in items if i != "None"])
                assert sum(s.end - s.start for s in r.spans) == hit
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(odd, bench.filter("false")).filter("n_hit > 0").count() == 0
    found = decontaminate.find(odd, bench)
    clean = decontaminate.remove_spans(odd, found)
    assert clean.columns == odd.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert left[9].startswith("before it shared0") and "shared15" not in left[9] and left[9].endswith("after it")
    assert left[3] is None and left[5] == " \n\t " and 8 in left
    assert 9 not in {r.doc_id for r in decontaminate.remove_spans(odd, found, max_coverage=0.1).collect()}
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(odd, found, max_words=1000).collect()}[8] == PASSAGE


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 3), max_size=40),
       st.integers(1, 5))
def test_automaton_finds_every_window(items, text, n):
    found = {(a, b, i) for a, b, names in decontaminate.SuffixAutomaton(list(enumerate(items)), n).hits(text) for i in names}
    want = set()
    for i, words in enumerate(items):
        size = min(n, len(words))
        for s in range(len(words) - size + 1):
            want |= {(a, a + size, i) for a in range(len(text) - size + 1) if text[a:a + size] == words[s:s + size]}
    assert found == want


def test_substring_odd_rows(spark, odd, empty):
    """Ids are single here; repeated and null ids are below."""
    rows = [(d, t) for d, t in ODD if d not in (None, 9)] + [(9, dict(ODD)[9])]
    docs = rows_as_table(spark, rows, "substring")
    want = brute.repeated_windows(rows)
    for prefix_rows in (substring.PREFIX_ROWS, 1):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs, prefix_rows=prefix_rows).collect()}
        assert got == want
    assert want[7][1] == 60_000 and want[10][1] == 60
    assert substring.digests(odd).count() == len(ODD) and substring.digests(empty).count() == 0
    cut = substring.remove_repeats(odd)
    assert cut.columns == odd.columns
    by_id = {(r.doc_id, r.text) for r in cut.collect()}
    assert (7, "tail") in by_id and (8, PASSAGE) in by_id and (None, "") in by_id and (6, LONG) in by_id
    assert (9, "before it after it") in by_id and (3, None) in by_id


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_random_texts(spark, seed):
    """Few different words make many overlapping repeats within and across texts."""
    draw = np.random.default_rng(seed)
    rows = [(int(i), " ".join(np.array(["a", "b"])[(draw.random(int(draw.integers(0, 120))) < 0.5).astype(int)])) for i in range(60)]
    rows += [(60 + i, " ".join(["x"] * n)) for i, n in enumerate((19, 20, 21, 45))]
    docs = rows_as_table(spark, rows, "random", False)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect()}
    assert got == brute.repeated_windows(rows)


def test_near_copies_odd_rows(spark, odd, empty):
    """Rows without an id and rows that share one are compared like others and come back with their own id."""
    rows, own, seen = [], {}, set()
    for k, (d, text) in enumerate(ODD):
        node = d if d is not None and d not in seen else 10 ** 9 + k
        seen.add(d)
        own[node] = d
        rows.append((node, text))
    want = Counter((own[d], own[c], own[same], n) for d, (c, same, n) in brute.near_links(rows).items())
    for block in (ngram_join.BLOCK, 1):
        got = ngram_join.near_copies(odd, block=block).select("doc_id", "class_id", "copy_id", "n_links").collect()
        assert Counter(map(tuple, got)) == want
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(own[d] for d, (c, _, _) in brute.near_links(rows).items() if d == c)
    assert ngram_join.near_copies(empty).count() == 0


def test_near_copies_large_group(spark):
    """Forty texts that differ by a word or two, in blocks of four: every link is counted once."""
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(40):
        words = list(base)
        for j in range(i % 4):
            words[(i * 7 + j * 31) % 150] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = rows_as_table(spark, rows, "group", False)
    want = brute.near_links(rows)
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_copies(docs, block=4).collect()}
    assert got == want


def test_near_copies_move_sets_once(spark, small, monkeypatch):
    """Without broadcasts: sets are made behind the last join before the blocks, bands move only of rows that may be copies."""
    plans, inner = {}, ngram_join._blocks_compared
    monkeypatch.setattr(ngram_join, "_blocks_compared", lambda members, *a: plans.update(
        sets=members._jdf.queryExecution().executedPlan().toString()) or inner(members, *a))
    apart = ngram_join.bloom.apart
    monkeypatch.setattr(ngram_join.bloom, "apart", lambda rows, key, stored, stored_key, label: plans.update(
        {label: rows.columns}) or apart(rows, key, stored, stored_key, label))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ngram_join.near_copies(small[0]).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    after = plans["sets"].split("MapInArrow")[0]
    assert "Join" not in after and "Exchange" not in after
    assert plans["op10-copies"] == ["doc_id", "bands"]


def test_pruning_bounds():
    """More similar pairs are never asked for fewer matches, and a pair at the threshold mostly stays."""
    bounds = ngram_join.least_matches(0.8, 1e-4)
    assert [n for n, _ in bounds] == [16, 32, 48, 64, 80, 96]
    assert all(m / n < 0.7 for n, m in bounds) and [m for _, m in bounds] == sorted(m for _, m in bounds)


def test_components(spark):
    """A long chain, a star, a ring and a loop."""
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 30))
    assert got[52] == 50 and 60 not in got


def test_results_do_not_depend_on_how_scans_are_split(spark, sf_dir, monkeypatch):
    """A table of twelve files whose scans are packed into tasks in another way after every stored step."""
    from caselake import session

    docs = session.materialize(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(12), "split-docs")
    labels, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("labels", "benchmark"))
    steps = {
        "exact": lambda: exact_dedup.drop_copies(docs),
        "near": lambda: ngram_join.drop_near_copies(docs),
        "links": lambda: ngram_join.near_copies(docs),
        "spans": lambda: decontaminate.remove_spans(docs, decontaminate.find(docs, items)),
        "repeats": lambda: substring.remove_repeats(docs),
        "digests": lambda: substring.digests(docs),
        "toxic": lambda: toxicity.drop_toxic(docs, labels),
    }
    rows = lambda step: sorted(map(str, step().collect()))
    plain = {name: rows(step) for name, step in steps.items()}
    turns = [0]

    def turned(df, label):
        turns[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", str((2, 4, 12)[turns[0] % 3]))
        return session.materialize(df, label)

    from caselake.llm import bloom, components
    for module in (bloom, components, decontaminate, exact_dedup, ngram_join, substring, toxicity):
        monkeypatch.setattr(module, "materialize", turned)
    try:
        for name, step in steps.items():
            assert rows(step) == plain[name], name
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert turns[0] > 30
    with pytest.raises(ValueError, match="stored"):
        decontaminate.remove_spans(docs.groupBy("doc_id", "text").count(), decontaminate.find(docs, items))


def test_rollup_opens_the_buckets_of_its_batch_only(spark):
    rollup = token_rollup.scratch(spark)
    rows = spark.range(2000).selectExpr("id as doc_id", "'v' as version", "'insert' as op", "'s' as source", "'en' as lang", "id as n_tokens", "0 as seq")
    assert rollup.commit("all", rows) and rollup.commit("one", rows.filter("doc_id = 7").withColumn("n_tokens", F.lit(1)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 2000, 1999 * 1000 - 6)]
    bucket = spark.range(7, 8).select(F.pmod(F.xxhash64("id"), F.lit(token_rollup.BUCKETS))).first()[0]
    plan = rollup.state([bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
