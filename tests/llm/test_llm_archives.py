"""WARC archives, phrase filters and whitening: round trips, plain versions, odd and empty tables."""

import gzip
import math
from collections import Counter

import brute
import numpy as np
import pyarrow.fs as pafs
import pytest
from compare import differences
from conftest import CLASHING, LONG
from hypothesis import given, settings
from hypothesis import strategies as st

from caselake.llm import collocations, rowkeys, warc, whitening
from caselake.llm.queries import ORACLE_SQL, QUERIES
from caselake.session import materialize, scratch_path

PAGE = "<html>" + "long enough to be worth a revisit " * 5
PAGES = [
    (1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE), (2, "http://a.example/2b", PAGE), (3, None, "short"),
    (4, "http://a.example/4", "short"), (5, "http://a.example/5", None), (6, "http://a.example/6", ""), (None, "http://b.example/", PAGE),
    (7, "http://c.example/a b\r\nX: 1", "é…" * 60), (8, "http://c.example/8", LONG), (9, "http://c.example/9", LONG), (None, None, None),
    (0, "http://a.example/0", PAGE), (0, "http://a.example/0", PAGE), (None, "http://d.example", "é…" * 61), (None, "http://e.example", "é…" * 61),
    (10, "http://f.example", "x\r\n\r\nWARC/1.1\r\n" + "y" * 100),
]


def _pages(spark, rows, name):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    clashing = [f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in CLASHING.split(", ")]
    return materialize(df.selectExpr("*", "'x' as payload", "0 as row_key", "'y' as archive", *clashing), name)


def _expected(rows):
    """(page_id, size, digest, type, refers_to) of each row; rows of one id and payload differ only in their type."""
    def rank(page_id):
        return (page_id is None, page_id or 0)

    least, out = {}, Counter()
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and (data not in least or rank(page_id) < rank(least[data][0])):
            least[data] = [page_id, False]
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = least.get(data)
        if first is None or (page_id == first[0] and not first[1]):
            if first:
                first[1] = True
            out[page_id, len(data), brute.sha(data), "response", None] += 1
        else:
            out[page_id, len(data), brute.sha(data), "revisit", first[0]] += 1
    return out


def _number(text):
    return None if text is None else int(text)


def test_warc_round_trip_of_odd_pages(spark):
    pages, root = _pages(spark, PAGES, "odd-pages"), scratch_path(spark, "warc")
    index = warc.write(pages, root, archive_bytes=4000)
    back = warc.read(index, root, gap=100, most=2000, stretch=3000).collect()
    assert Counter((_number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, _number(r.refers_to)) for r in back) == _expected(PAGES)
    payloads = Counter(r.payload for r in back if r.record_type == "response")
    assert payloads == Counter({html or "": 1 for _, _, html in PAGES if len((html or "").encode()) >= 100}) + Counter(
        html or "" for _, _, html in PAGES if len((html or "").encode()) < 100)
    assert {r.url for r in index.collect()} == {url for _, url, _ in PAGES}
    # A selection reads its own records only; the archives are plain gzip members without the index as well.
    some = warc.read(index.filter("page_id = '8'"), root).collect()
    assert [(r.page_id, r.payload) for r in some] == [("8", LONG)]
    fs, folder = pafs.FileSystem.from_uri(root)
    data = b"".join(gzip.decompress(fs.open_input_file(f"{folder}/{name}").read()) for (name,) in index.select("archive").distinct().collect())
    assert data.count(b"WARC-Record-ID:") == len(PAGES) and index.select("archive").distinct().count() > 1


def test_warc_of_an_empty_table(spark):
    root = scratch_path(spark, "warc")
    assert warc.read(warc.write(_pages(spark, [], "no-pages"), root), root).count() == 0


def test_warc_refuses_a_changed_payload(spark):
    root = scratch_path(spark, "warc")
    row = {"record_id": "0" * 32, "page_id": "1", "url": "u", "payload": "abd", "payload_bytes": 3, "payload_digest": brute.sha("abc"),
           "record_type": "response", "refers_to": None}
    archive = warc._Archive(root, 1 << 20, 6)
    name, offset, length = archive.add(warc.record_bytes(row, "2000-01-01T00:00:00Z"))
    archive.close()
    index = spark.createDataFrame([("r", name, offset, length)], "record_id string, archive string, offset long, length long")
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read(index, root).collect()


def test_ranges_join_neighbours_only():
    names = ["a", "a", "a", "a", "b"]
    assert warc.ranges(names, np.array([0, 10, 25, 100, 0]), np.array([10, 10, 5, 50, 5]), 5, 60) == [(0, 3), (3, 4), (4, 5)]
    assert warc.ranges(names[:3], np.array([0, 10, 20]), np.array([10, 10, 10]), 0, 20) == [(0, 2), (2, 3)]
    assert warc.ranges([], np.array([]), np.array([]), 0, 1) == []


def test_row_keys_do_not_depend_on_the_split(spark, sf_dir):
    docs = materialize(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(12), "keys")
    seen = []
    for at_least in ("4", "2"):
        spark.conf.set("spark.sql.files.minPartitionNum", at_least)
        seen.append({r.k: r.doc_id for r in rowkeys.with_key(docs, "k").select("k", "doc_id").collect()})
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] and len(seen[0]) == 1000
    grouped = docs.groupBy("lang").count()
    assert rowkeys.with_key(rowkeys.stored(grouped, "keys"), "k").select("k").distinct().count() == grouped.count()


# --- phrases ----------------------------------------------------------------------
def _layouts():
    return [collocations.Layout(n, most, shards) for n, most in ((1, 9), (5000, 9000), (3_000_000, 1 << 24), (100, 50)) for shards in (1, 7, 5000)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 300), st.integers(0, 300), st.integers(1, 1000)), max_size=60))
def test_filters_lose_nothing(rows):
    """Pack, permute, cut, merge and open again: every phrase with its own count, in any layout."""
    for layout in _layouts():
        top = 1 if layout.bits == 1 else (1 << min(layout.bits, 63)) - 1
        grams = [(1 + a % top, 1 + b % top, c % (top + 1)) for a, b, c, _ in rows]
        lanes = layout.packed([np.array([g[i] for g in grams], np.uint64) for i in range(3)])
        lanes, counts = collocations._added_up(lanes, np.array([n for *_, n in rows], np.int64))
        again = [collocations.opened(p, layout) for p in collocations.filter_pieces(lanes, counts, layout)]
        if not rows:
            assert again == []
            continue
        found, n = collocations._added_up([np.concatenate(x) for x in zip(*(a for a, _ in again))], np.concatenate([c for _, c in again]))
        expected = Counter()
        for g, (*_, k) in zip(grams, rows):
            expected[g] += k
        assert dict(zip(zip(*(x.tolist() for x in layout.unpacked(found))), n.tolist())) == expected


def test_stir_is_a_permutation():
    for width in (1, 2, 7, 12):
        x = np.arange(1 << width, dtype=np.uint64)
        assert sorted(collocations.stir(x, width).tolist()) == x.tolist()
        assert (collocations.unstir(collocations.stir(x, width), width) == x).all()
    wide = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (collocations.unstir(collocations.stir(wide, 64), 64) == wide).all()


def test_phrases_by_hash_ids_and_many_shards(spark, con, sf_dir):
    """Without dense ids, with tiny filters and shards: the same rows as the SQL."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = collocations.mine(docs, most_words=10, shard=5000, gathered=3000)
    assert differences(small, con, ORACLE_SQL["op12_collocations"]) is None


def _phrases(rows, min_count, top):
    """Plain version over (lang, text)."""
    import re

    counts, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {g: n for g, n in counts.items() if len(g[1]) > 1 and n >= min_count}
    found, longest = [], Counter()
    for (lang, words), a in often.items():
        if len(words) == 3:
            for part in (words[:2], words[1:]):
                longest[lang, part] = max(longest[lang, part], a)
    for (lang, words), a in often.items():
        if len(words) == 3 or not longest[lang, words] or 100 * longest[lang, words] < 50 * a:
            cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    out, rank = set(), Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.add((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return out


def test_phrases_of_odd_texts(spark, empty):
    texts = ["a b c", "A B C!", "a b\nc", "x\0y z", "x\0y z", "x\0y z", None, "", " \t ", "é è", "é è", "É è", "é è é è", "a\tb  c", "...", LONG,
             "one", "b c, b c; b c. b c", "end \x0b of \x0c it", "end of it", "a a a a a"]
    rows = [(("en", None, "und", "de")[i % 4], t) for i, t in enumerate(texts * 3)] + [("en", LONG)]
    table = materialize(spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as id", "2 as id1", "3 as n", "4 as shard"), "odd-phrases")
    for top in (2000, 3):
        got = collocations.mine(table, min_count=2, top=top)
        assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == {
            r for r in _phrases(rows, 2, top)}
    assert collocations.mine(empty).count() == 0


# --- whitening --------------------------------------------------------------------
def _plain_whitening(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    apart = n * x - s
    centred = apart / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, (apart ** 2).sum(1), centred @ axes / np.sqrt(values), values / np.trace(v)


def test_whitening_matches_a_plain_version(spark, con, sf_dir):
    rows = con.sql("select vec_id, embedding from embeddings").fetchall()
    n, deviation, whitened, explained = _plain_whitening([v for _, v in rows])
    got = {(r.vec_id, r.component): r for r in QUERIES["op13_whitening"](spark, sf_dir).collect()}
    assert len(got) == 8 * len(rows)
    for k in range(8):
        mine = np.array([got[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(mine - whitened[:, k]).max(), np.abs(mine + whitened[:, k]).max()) < 1e-6
        assert abs(got[rows[0][0], k + 1].explained / explained[k] - 1) < 1e-9
    assert all(got[i, 1].deviation == d and got[i, 1].n == n for (i, _), d in zip(rows, deviation.tolist()))
    assert {r.identity_error for r in got.values()} == {got[rows[0][0], 1].identity_error} and got[rows[0][0], 1].identity_error < 1e-9


def _vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return materialize(df.selectExpr("*", "1 as x", "'d' as digest", "2 as weight", "3 as n", "4 as component"), "vectors")


def test_whitening_weights_copies_and_leaves_out_broken_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    good = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(60)] + [(None, base[1]), (7, base[2]), (7, base[2])]
    broken = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [math.nan] * 5), (904, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    n, deviation, whitened, explained = _plain_whitening([v for _, v in good])
    got = whitening.whiten(_vectors(spark, good + broken)).collect()
    assert len(got) == 5 * len(good) and {r.n for r in got} == {n}
    found = Counter((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 6)) for r in got)
    assert found == Counter((i, k + 1, int(d), round(abs(w[k]), 6)) for (i, _), d, w in zip(good, deviation, whitened) for k in range(5))
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 for r in got)
    once = whitening.whiten(_vectors(spark, good), weighted=False)
    assert once.first().n == 40


def test_whitening_without_variance_and_of_nothing(spark):
    got = whitening.whiten(_vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in got)
    line = whitening.whiten(_vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert {(r.component, None if r.whitened is None else round(abs(r.whitened), 9), r.explained) for r in line} == {(1, 1.0, 1.0), (2, None, 0.0)}
    assert whitening.whiten(_vectors(spark, [(1, None)])).count() == 0 and whitening.whiten(_vectors(spark, [])).count() == 0
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(_vectors(spark, [(1, [0.0]), (2, [0.0, 1.0])]))


def test_whitening_deviations_are_exact_beyond_doubles(spark):
    rows = [(1, [2000.0, -3000.5]), (2, [123.25, 77.125]), (3, [-900.0, 2100.75])] * 50
    n, deviation, *_ = _plain_whitening([v for _, v in rows], 2)
    got = {r.vec_id: r.deviation for r in whitening.whiten(_vectors(spark, rows)).collect()}
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows[:3]]
    sums = [sum(v[d] for v in x) * 50 for d in (0, 1)]
    assert got == {i + 1: sum((n * v[d] - sums[d]) ** 2 for d in (0, 1)) for i, v in enumerate(x)}
