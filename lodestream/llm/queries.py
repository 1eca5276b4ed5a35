"""The registered queries of this subpackage: one per numbered operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, embed_dedup, filter_audit, fingerprint, language_id, merge_dropout, ngram_join, packing, suffix_dedup, token_counts, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs.select("doc_id", "text").withColumn("held_out", toxicity.held_out(F.col("doc_id"))), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merge_dropout.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, seed=1)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(spark, warc.write_pages(_table(spark, sf_dir, "pages"), min_revisit=100))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(manifest, digests=True)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, ids=False)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), width=3, threshold="0.9")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_summary(_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    left_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs.where(~left_out))
    return language_id.predict(docs.select("doc_id", "text", left_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_merge_dropout, op3_document_fingerprints, op4_warc, op5_token_counts, op6_embedding_near_dedup, op7_token_files, op8_best_fit_packing, op9_ngram_jaccard_join, op10_suffix_array_dedup, op11_conversation_repair, op12_filter_audit, op13_language_id)}


_OP4 = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, strlen(h)::bigint as n, sha256(h) as digest from p),
f as (select digest, min(page_id) as first from d where n >= 100 group by digest)
select page_id, n as payload_bytes, digest as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to from d left join f using (digest)"""

#: Which nodes are reached from node a by links (a, b).
_REACH = "reach as (select a, a as b from nodes union select r.a, l.b from reach r join links l on r.b = l.a)"

_OP6 = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings),
good as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v where vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0),
links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.vec_id <> y.vec_id and list_dot_product(x.u, y.u) >= 0.95), nodes as (select vec_id as a from v), {_REACH},
c as (select a, min(b) as component_id from reach group by a), n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, component_id = vec_id as kept from v join c on c.a = vec_id left join n on n.a = vec_id"""

_OP9 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
t as (select doc_id, len(s) as n, unnest(s) as token from s),
links as (select x.doc_id as a, y.doc_id as b from t x join t y on x.token = y.token and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))), nodes as (select doc_id as a from s), {_REACH},
c as (select a, min(b) as component_id from reach group by a)
select doc_id, len(s)::bigint as n_shingles, component_id from s join c on c.a = doc_id"""

#: Bytes as pairs of hexadecimal digits, and windows by their place.
_OP10 = """with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
w as (select doc_id, i, md5_number(substr(h, 2 * i::bigint + 1, 200)) as k from (select doc_id, h, unnest(generate_series(0, n - 100)) as i from b where n >= 100)),
r as (select doc_id, i from w qualify row_number() over (partition by k order by doc_id, i) > 1),
g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from r)),
spans as (select doc_id, min(i) as lo, max(i) + 100 as hi from g group by doc_id, run),
edges as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as before from spans),
cut as (select doc_id, sum(hi - lo)::bigint as n_removed, count(*)::bigint as n_spans, max(hi) as last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' order by lo) as kept from edges join b using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256 from b left join cut using (doc_id)"""


#: Costs-to-go from the four states with the least letters and the lines that come out, as (cost, letters, lines), from the last row to the first.
_OP11_STEP = """[
 list_sort(list_filter([{'c': 3 + h[1].c, 'a': 'D' || h[1].a, 'l': h[1].l}, case when not gone then {'c': 2 + cut + h[3].c, 'a': 'R' || h[3].a, 'l': list_prepend('user:' || text, h[3].l)} end,
  case when not gone and i = 's' then {'c': cut + h[2].c, 'a': 'K' || h[2].a, 'l': list_prepend(role || ':' || text, h[2].l)} end, case when not gone and i = 'u' then {'c': cut + h[3].c, 'a': 'K' || h[3].a, 'l': list_prepend(role || ':' || text, h[3].l)} end], lambda x: x is not null))[1],
 list_sort(list_filter([{'c': 3 + h[2].c, 'a': 'D' || h[2].a, 'l': h[2].l}, case when not gone then {'c': 2 + cut + h[3].c, 'a': 'R' || h[3].a, 'l': list_prepend('user:' || text, h[3].l)} end,
  case when not gone and i = 'u' then {'c': cut + h[3].c, 'a': 'K' || h[3].a, 'l': list_prepend(role || ':' || text, h[3].l)} end], lambda x: x is not null))[1],
 list_sort(list_filter([{'c': 3 + h[3].c, 'a': 'D' || h[3].a, 'l': h[3].l}, case when not gone then {'c': 2 + cut + h[4].c, 'a': 'R' || h[4].a, 'l': list_prepend('assistant:' || text, h[4].l)} end,
  case when not gone and i = 'a' then {'c': cut + h[4].c, 'a': 'K' || h[4].a, 'l': list_prepend(role || ':' || text, h[4].l)} end], lambda x: x is not null))[1],
 list_sort(list_filter([{'c': 3 + h[4].c, 'a': 'D' || h[4].a, 'l': h[4].l}, case when not gone then {'c': 2 + cut + h[3].c, 'a': 'R' || h[3].a, 'l': list_prepend('user:' || text, h[3].l)} end,
  case when not gone and i = 'u' then {'c': cut + h[3].c, 'a': 'K' || h[3].a, 'l': list_prepend(role || ':' || text, h[3].l)} end], lambda x: x is not null))[1]]"""


def _with_insert(h: str) -> str:
    """Costs-to-go once an empty turn may come first."""
    ways = ((1, 3, "user"), (2, 3, "user"), (3, 4, "assistant"), (4, 3, "user"))
    return "[" + ", ".join(f"list_sort([{h}[{q}], {{'c': 2 + {h}[{to}].c, 'a': 'I' || {h}[{to}].a, 'l': list_prepend('{role}:', {h}[{to}].l)}}])[1]" for q, to, role in ways) + "]"


_OP11 = f"""with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations),
b as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from c),
x as (select k, list_reduce(list_prepend(4294967295::bigint, list_transform(generate_series(1, strlen(k)), lambda i: ascii(k[i])::bigint)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))) as crc from (select distinct k from b)),
f as (select conv_id, turn, role, text, xor(crc, 4294967295) % 20 as f from b join x using (k)),
r as (select conv_id, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case f when 3 then [1, 2] else [1] end) as copy from f where f <> 0),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as place, count(*) over (partition by conv_id) as n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, substr(role, 1, 1) as i from r),
q as (select *, bare = '' as blank, row_number() over (partition by conv_id, role, text order by place) > 1 as again, substr(bare, length(bare), 1) not in ('.', '!', '?') as open_, lag(i) over (partition by conv_id order by place) as before from p),
rows_ as (select *, blank or again as gone, open_::int as cut from q),
walk as (select conv_id, n as pos, [{{'c': 0, 'a': '', 'l': []::varchar[]}}, {{'c': 4, 'a': 'II', 'l': ['user:', 'assistant:']}}, {{'c': 2, 'a': 'I', 'l': ['assistant:']}}, {{'c': 0, 'a': '', 'l': []::varchar[]}}] as h from (select distinct conv_id, n from rows_)
 union all select conv_id, pos - 1, {_with_insert('g')} as h from (select conv_id, pos, {_with_insert('g')} as g from (select w.conv_id, w.pos, {_OP11_STEP} as g from walk w join rows_ on rows_.conv_id is not distinct from w.conv_id and rows_.place = w.pos))),
done as (select conv_id, h[1].c::bigint as cost, h[1].a as audit, sha256(array_to_string(h[1].l, chr(10))) as repaired_sha256 from walk where pos = 0),
t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum((again and not blank)::int)::bigint as duplicate, sum((open_ and not gone)::int)::bigint as truncated, sum((before is not null and before || i not in ('su', 'ua', 'au'))::int)::bigint as illegal from rows_ group by conv_id)
select v.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) v left join t on t.conv_id is not distinct from v.conv_id left join done on done.conv_id is not distinct from v.conv_id"""

_OP12 = """with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by t) as low from d),
m as (select doc_id, part, (len(w) < 100)::int as a, (100 * len(list_distinct(w)) < 80 * len(w))::int as b, (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t))::int as c, regexp_matches(t, '[#$%&*|]')::int as d, coalesce(doc_id > low, false)::int as e from w),
lab as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
cnt as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n from m left join lab using (doc_id) group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (select v.f || w.f || x.f || y.f || z.f as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits from l v, l w, l x, l y, l z where len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
s as (select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[:step - 1]), 0)::int as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
j as (select *, mask & before = 0 as passed, mask & own <> 0 as fails from cnt, s),
g as (select part, filter_order, step, own, sum(case when passed and not fails then n else 0 end)::bigint as kept, sum(case when passed and fails then n else 0 end)::bigint as removed, sum(case when not passed and fails then n else 0 end)::bigint as redundant,
 sum(case when mask = own then n else 0 end)::bigint as unique_fails, sum(case when passed and fails and good = 1 then n else 0 end)::bigint as good_lost, sum(case when passed and fails and toxic = 1 then n else 0 end)::bigint as toxic_lost from j group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from g"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": _OP11, "op12_filter_audit": _OP12, "op4_warc": _OP4, "op6_embedding_near_dedup": _OP6, "op9_ngram_jaccard_join": _OP9, "op10_suffix_array_dedup": _OP10}
