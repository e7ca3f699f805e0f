"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, decontamination, html, quality, repeats, secrets, sharding, simhash, topk, toxicity, whitening
from .common import table


def tokenizer_path() -> str:
    """The default vocabulary; its package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


OP8_SQL = """
with t as (select list_transform(range(256), lambda n: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as tab),
d as (
    select doc_id, strlen(coalesce(text, '')) + 1 as size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::bigint), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295) as text_crc32,
        list_transform(range(9), lambda i: ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || i), 1, 13))::bigint) as h
    from documents, t
), s as (select *, list_position(h[1:8], list_max(h[1:8])) - 1 as shard, list_position(h, list_max(h)) - 1 as grown_shard, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || text_crc32 || ':' || size), 1, 8))::bigint % 4096 as bin from d)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by bin, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard::int as grown_shard from s
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words with the other signs in front of them; whole windows are compared as text.
OP10_SQL = r"""
with low as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
cut as (select r, unnest(regexp_extract_all(t, '([\x00-\x2F\x3A-\x60\x7B-\x7F]*)([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)', 1)) as gap, unnest(regexp_extract_all(t, '([\x00-\x2F\x3A-\x60\x7B-\x7F]*)([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)', 2)) as word, generate_subscripts(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1) as p from low),
w as (select r, p, word, sum(strlen(gap) + strlen(word)) over (partition by r order by p) as stop from cut),
item as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
win as (select distinct item, least(len(words), 13) as n, list_aggregate(words[i:i + 12], 'string_agg', ' ') as said from (select item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from item where len(words) > 0)),
text as (select r, list(word order by p) as words from w group by r),
place as (select r, p, n, list_aggregate(words[p:p + n - 1], 'string_agg', ' ') as said from (select r, words, n, unnest(range(1, len(words) - n + 2)) as p from text, (select distinct n from win) where len(words) >= n)),
occ as (select distinct r, p, n, item from place join win using (n, said)),
hit as (select distinct r, unnest(range(p, p + n)) as p from occ),
island as (select r, min(p) as a, max(p) as b from (select r, p, p - row_number() over (partition by r order by p) as g from hit) group by r, g),
span as (select island.r, x.stop - strlen(x.word) as begin_, y.stop as end_, b - a + 1 as n from island join w x on x.r = island.r and x.p = a join w y on y.r = island.r and y.p = b),
s as (select r, sum(n) as n_hit, string_agg(begin_::bigint || ':' || end_::bigint, ',' order by begin_) as hit_bytes from span group by r),
i as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from occ) group by r),
c as (select r, count(*) as n_words from w group by r)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) as contaminated, coalesce(hit_bytes, '') as hit_bytes
from low left join c using (r) left join s using (r) left join i using (r)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with low as (select coalesce(lang, 'und') as lang, row_number() over () as r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
piece as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from low),
total as (select lang, sum(len(w))::bigint as n from piece group by lang),
f as (
    select lang, w[i:i + k - 1] as phrase, k, count(*) as a from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from piece, range(1, 5) ks(k) where len(w) >= k) group by all having count(*) >= 30
), cut as (
    select c.lang, c.phrase, c.a, x.a as l, y.a as r, i as k, 2000000::hugeint * c.a // (x.a + y.a) as score
    from (select *, unnest(range(1, k)) as i from f where k >= 2) c join f x on x.lang = c.lang and x.phrase = c.phrase[1:c.i] join f y on y.lang = c.lang and y.phrase = c.phrase[c.i + 1:]
), best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, phrase[i:i + s - 1] as phrase, max(a) as over_ from (select *, unnest(range(1, k - s + 2)) as i from f, (values (2), (3)) sizes(s) where k > s) group by all),
kept as (select b.*, list_aggregate(b.phrase, 'string_agg', ' ') as said from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where i.over_ is null or 100::hugeint * i.over_ < 80::hugeint * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, said) as rank from kept)
select lang, rank, said as phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"), tokenizer_path())


OP12_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, i, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) t(i, r)),
e as (select *, length('<turn>' || replace(regexp_replace(replace(role, '\', '\\'), '<(/?turn>|\|)', '<\\\1', 'g'), chr(10), '\n') || chr(10) || regexp_replace(replace(text, '\', '\\'), '<(/?turn>|\|)', '<\\\1', 'g') || '</turn>' || chr(10)) as size from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(size)::bigint as formatted_chars
from e group by conv_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_secrets, op3_html, op4_suffixes, op5_simhash, op6_topk, op7_kneser_ney, op8_sharding, op9_toxicity, op10_decontamination, op11_collocations, op12_chat, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op8_sharding": OP8_SQL, "op10_decontamination": OP10_SQL, "op11_collocations": OP11_SQL, "op12_chat": OP12_SQL}
