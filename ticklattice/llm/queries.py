"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, covertree, decontam, langid, pii, piece, rtree, shared, simhash, substring, tokenfile, trie, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_read(spark, sf_dir, "pages"), shared.scratch(spark, "warc"))
    return warc.read_archives(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h, url from pages),
     d as (select page_id, url, strlen(h) as n, sha256(h) as digest from p),
     m as (select *, case when n >= 100 then min(page_id) over (partition by digest) else page_id end as first_id from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when first_id = page_id then 'response' else 'revisit' end as record_type,
       case when first_id = page_id then null else first_id end as refers_to, url
from m
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.fit_and_identify(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


#: A key for registered queries, whose tables hold nobody's data; elsewhere it comes from the session's configuration.
DEMONSTRATION_KEY = "registered queries"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_CONF, DEMONSTRATION_KEY)
    return pii.replace(_read(spark, sf_dir, "documents").select("doc_id", "text"), key=key).select("doc_id", "text", "n_entities", "kinds")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(_read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece.encode(_read(spark, sf_dir, "documents"), model, with_ids=False)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json")
    index = tokenfile.write_tokens(_read(spark, sf_dir, "documents"), file, shared.scratch(spark, "tokens"))
    return tokenfile.read_tokens(index)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_read(spark, sf_dir, "embeddings"))


OP9_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
    from embeddings
    where embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select q.vec_id as query_id, c.vec_id as vec_id,
           cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
    where q.vec_id % 50 = 0
),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from s)
select query_id, cast(rk as integer) as rank, vec_id, score from r where rk <= 5
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontam.items_sha256().alias("items_sha256"), "contaminated",
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = anchors.compress(_read(spark, sf_dir, "embeddings"))
    coded = anchors.with_label_error(shared.written(coded, "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(anchors.digest(books)).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    near = "list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - b.q[i]) * (p.q[i] - b.q[i])))"
    return f"a{k} as (select rid, part, min(cast({near} as bigint) * 64 + entry) as near from p join b{k} b using (part) group by all)"


def _moved(k: int) -> str:
    return f"""
b{k + 1} as (select part, entry, coalesce(m.q, b.q) as q from b{k} b left join (
    select part, entry, list(x order by i) as q from (
        select p.part, near % 64 as entry, i, cast(floor(sum(p.q[i]) / count(*)) as bigint) as x
        from p join a{k} using (rid, part), lateral (select unnest(range(1, len(p.q) + 1)) as i) group by all)
    group by all) m using (part, entry))"""


OP11_SQL = f"""
with v as (
    select vec_id, label, row_number() over (order by vec_id nulls last) as rid,
           list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
p as (select rid, part, e[part * (len(e) // 16) + 1 : (part + 1) * (len(e) // 16)] as q from v, range(16) as t(part)),
b0 as (select part, rid - 1 as entry, q from p where rid <= 64),
{_assigned(0)}, {_moved(0)},
{_assigned(1)}, {_moved(1)},
{_assigned(2)},
c as (select rid, string_agg(printf('%02x', near % 64), '' order by part) as code, cast(sum(near // 64) as bigint) as error from a2 group by rid),
h as (select sha256(string_agg(array_to_string(q, ','), ',' order by part, entry)) as codebooks_sha256 from b2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from c join v using (rid), h
"""


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.near_duplicates(_read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive w as (
    select row_number() over () as rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
    from documents
),
s as (select rid, doc_id, list_sort(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
             else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end) as sh from w),
k as (select min(rid) as id, len(sh) as n, sh, min(doc_id) as first_id from s where len(sh) > 0 group by sh),
e as (select id, n, unnest(sh) as x from k),
l as (select a.id as a, b.id as b from e a join e b on a.x = b.x and a.id <> b.id and a.n * 10 >= b.n * 9 and b.n * 10 >= a.n * 9
      group by a.id, b.id, a.n, b.n having 19 * count(*) >= 9 * (a.n + b.n)),
r as (select id as a, id as b from k union select r.a, l.b from r join l on l.a = r.b),
c as (select r.a as id, min(k.first_id) as component_id from r join k on k.id = r.b group by r.a)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, case when len(s.sh) = 0 then s.doc_id else c.component_id end as component_id
from s left join k on k.sh = s.sh left join c on c.id = k.id
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""

OP13_SQL = f"""
with t as (
    select conv_id, strlen(text) as bytes, sha, row_number() over (partition by conv_id order by turn nulls first, sha) as place
    from (select conv_id, turn, coalesce(text, '') as text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as sha
          from conversations where conv_id is not null)
),
n as (select conv_id, count(*) as n from t group by 1),
k as (select n.conv_id, n.conv_id - n.conv_id % 5 as base, h, least(h, coalesce(b.n, 0)) as taken
      from (select *, {_CRC} % 9 as h from n) n left join n b on b.conv_id = n.conv_id - n.conv_id % 5),
r as (select k.conv_id, t.place, t.sha, t.bytes from k join t on t.conv_id = k.base and t.place <= k.h
      union all
      select k.conv_id, t.place - k.h + k.taken, t.sha, t.bytes from k join t on t.conv_id = k.conv_id and t.place > k.h),
q as (select conv_id, coalesce(list(sha order by place) filter (sha is not null), []) as seq, list(bytes order by place) as sizes
      from k left join r using (conv_id) group by 1),
p as (select conv_id, d, seq, array_to_string(seq[1:d], ',') as node, case when d > 0 then sizes[d] else 0 end as bytes
      from q, lateral (select unnest(range(0, len(seq) + 1)) as d)),
v as (select node, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, arg_min(seq, conv_id) as seq,
             string_agg(case when len(seq) = d then cast(conv_id as varchar) end, ',' order by conv_id) as ends from p group by 1, 2),
u as (select node, d, conv_id, n_convs, ends, (n_convs - 1) * bytes as own, case when d > 0 then array_to_string(seq[1:d - 1], ',') end as parent, seq from v),
kids as (select parent as node, count(*) as n from u where parent is not null group by 1),
w as (select array_to_string(u.seq[1:e], ',') as node, e, sum(own) as saved, count(*) filter (kids.n is null) as leaves
      from u left join kids using (node), lateral (select unnest(range(0, d + 1)) as e) group by 1, 2)
select u.conv_id, u.d as depth, f.conv_id as parent_conv_id, u.n_convs, coalesce(kids.n, 0) as n_children, w.leaves as n_leaves,
       cast(w.saved as bigint) as saved_tokens, sha256(coalesce(u.ends, '')) as ends_sha256
from u join w on w.node = u.node and w.e = u.d left join kids on kids.node = u.node left join u f on f.node = u.parent and f.d = u.d - 1
"""


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_language_id": op2_language_id,
        "op3_pii": op3_pii,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_simhash": op5_simhash,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_token_files": op7_token_files,
        "op8_url_filter": op8_url_filter,
        "op9_top_k": op9_top_k,
        "op10_decontamination": op10_decontamination,
        "op11_vector_codes": op11_vector_codes,
        "op12_ngram_jaccard": op12_ngram_jaccard,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op9_top_k": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_ngram_jaccard": OP12_SQL, "op13_prefix_trie": OP13_SQL}
