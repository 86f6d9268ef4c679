"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from caselake.llm import (
    bpe, collocations, decontaminate, exact_dedup, ngram_join, pii, quality, substring, token_rollup, toxicity, url_filter, warc,
    whitening,
)
from caselake.session import materialize, scratch_path


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents")).drop("row_no")


def op2_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = {kind: pii.count_of("spans", kind).alias(f"n_{kind}") for kind in pii.KINDS}
    base, added = [counts[k] for k in pii.BASE_KINDS], [counts[k] for k in pii.KINDS if k not in pii.BASE_KINDS]
    return found.select("doc_id", *base, F.sha2(pii.listed("spans", pii.BASE_KINDS), 256).alias("base_sha256"),
                        pii.listed("spans").alias("spans"), *added, F.size("spans").cast("long").alias("n_spans"))


def op3_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The patterns of the tokenizer versions that the rollup counts.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "runs-1": r"[0-9]+|[A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}


def op4_token_rollup(spark, sf_dir):
    """All documents come in with a provisional count, their stored length; then every count is revised by the
    real one of the whole text. The documents with more than a thousand tokens are deleted and come in
    again. Each batch is sent twice, which changes nothing. In the end both versions hold every document
    with its own count."""
    rollup, docs = token_rollup.scratch(spark), table(spark, sf_dir, "documents")
    counts = materialize(token_rollup.counted(docs, TOKENIZERS), "op4-counts")
    versions = F.explode(F.array(*[F.lit(v) for v in TOKENIZERS])).alias("version")
    longer = counts.filter("n_tokens > 1000")
    for batch, op, rows in (
            ("arrived", "insert", docs.select("doc_id", "source", "lang", F.col("n_chars").alias("n_tokens"), versions)),
            ("counted", "revise", counts), ("withdrawn", "delete", longer), ("returned", "insert", longer)):
        for _ in range(2):
            rollup.commit(batch, rows.withColumns({"op": F.lit(op), "seq": F.lit(0)}))
    return rollup.totals()


# Words in host names that put a page's URL on the list.
LISTED_WORDS = ["adult", "ads", "bets", "casino", "pills", "spam"]


def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = url_filter.pages_to_list(pages, LISTED_WORDS)
    return url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op6_bpe(spark, sf_dir, tokenizer_path=None):
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_decontaminate(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_substring_dedup(spark, sf_dir):
    return substring.digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op11_warc(spark, sf_dir):
    """All pages are archived, then every record is read back from the archives by the index."""
    root = scratch_path(spark, "warc")
    index = warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(index, root, payload=False).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op12_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_token_rollup": op4_token_rollup,
    "op5_url_filter": op5_url_filter,
    "op6_bpe": op6_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_warc": op11_warc,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
with h as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from h window w as (partition by text_sha256)""",
    "op4_token_rollup": r"""
with w as (
  select source, lang, 'words-1' as version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n
  from documents
  union all
  select source, lang, 'runs-1', len(regexp_extract_all(coalesce(text, ''), '[0-9]+|[A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]'))
  from documents)
select source, lang, version, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens from w group by all""",
    "op5_url_filter": r"""
with p as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
q as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path,
         string_split(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&') as asked
  from p),
k as (select *, coalesce(array_to_string([x for x in asked if not starts_with(x, 'utm_')], '&'), '') as query from q),
c as (
  select *, case when host <> '' then regexp_replace(regexp_replace(host, '^www\.', ''), ':[0-9]*$', '')
         || regexp_replace(path, '/+$', '') || case when query = '' then '' else '?' || query end end as canon
  from k),
r as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from c),
l as (select distinct canon from c where regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)'))
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when canon in (select canon from l where canon is not null) then 'block' else 'allow' end as verdict
from r""",
    "op7_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as g
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i
        from d, (select distinct size from bw) where len(w) >= size)),
h as (select doc_id, i, size, item_id from dw join bw using (size, g)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from h) group by doc_id),
t as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)""",
    "op8_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + 19], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
r as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
c as (select distinct doc_id, unnest(range(i, i + 20)) as p from r),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (
  select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n
  from x anti join c using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)""",
    "op10_ngram_join": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y using (g) where x.doc_id <> y.doc_id group by all),
l as (
  select a, b, k = x.n and k = y.n as same
  from c join n x on x.doc_id = a join n y on y.doc_id = b where k * 1000 >= 800 * (x.n + y.n - k)),
r as (select a as doc_id, b as other from l union select r.doc_id, l.b from r join l on r.other = l.a),
g as (select doc_id, min(other) as other from r group by doc_id),
m as (select a as doc_id, min(b) filter (where same) as twin, count(*) filter (where same) as twins, count(*) as links
      from l group by a)
select d.doc_id, least(d.doc_id, coalesce(other, d.doc_id)) as class_id, least(d.doc_id, coalesce(twin, d.doc_id)) as copy_id,
       coalesce(twins, 0) + 1 as n_copies, coalesce(links, 0) as n_links
from d left join g using (doc_id) left join m using (doc_id)""",
    "op11_warc": r"""
with p as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type,
       case when page_id <> first then first end as refers_to
from p left join f using (payload_digest)""",
    "op12_collocations": r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (
  select lang, size, array_to_string(w[i:i + size - 1], ' ') as g, count(*) as f
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i
        from w, (select unnest([1, 2, 3]) as size) where len(w) >= size) group by all),
n as (select lang, cast(sum(f) as bigint) as n from g where size = 1 group by lang),
c as (select lang, size, g, f as a, string_split(g, ' ') as x from g where size > 1 and f >= 10),
k as (
  select lang, size, g, a, k, array_to_string(x[1:k], ' ') as first, array_to_string(x[k + 1:], ' ') as rest
  from (select *, unnest(range(1, size)) as k from c)),
s as (
  select k.lang, k.size, k.g, k.a, k.k, y.f as l, z.f as r,
         (1000000::hugeint * k.a * k.a) // (y.f::hugeint * z.f) as score
  from k join g y on y.lang = k.lang and y.g = k.first and y.size = k.k
         join g z on z.lang = k.lang and z.g = k.rest and z.size = k.size - k.k),
b as (select * from (select *, row_number() over (partition by lang, size, g order by score, k) as place from s) where place = 1),
h as (
  select lang, array_to_string(x[1:2], ' ') as g, a from c where size = 3 union all
  select lang, array_to_string(x[2:3], ' '), a from c where size = 3),
m as (select lang, g, max(a) as longest from h group by all),
o as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(b.g)) as rank
  from b left join m on b.size = 2 and m.lang = b.lang and m.g = b.g
  where longest is null or 100 * longest < 50 * a)
select lang, rank, g as phrase, a, l, r, n, cast(score as bigint) as score from o join n using (lang) where rank <= 2000""",
}
