"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, compact_windows, merge_dropout, packing, pq_dedup, quality, repair, sharding, simhash, spelling, suffix_dedup, token_files, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_query(spark, table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_query(table(spark, sf_dir, "documents"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passage_query(table(spark, sf_dir, "documents"), both_sides=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_query(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_query(table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_with_dropout(table(spark, sf_dir, "documents"), with_ids=False)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_query(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_query(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_query(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_sharding, op3_compact_windows, op4_quality_rules, op5_suffix_dedup, op6_chat, op7_simhash, op8_packing, op9_merge_dropout, op10_embedding_dedup, op11_spelling, op12_repair, op13_warc)}


_RATES = "('symbol_rate', 1000 * n_symbols // greatest(word_chars, 1)), ('dup_line_rate', 1000 * n_dup_lines // greatest(n_lines, 1)), ('word_length', 10 * word_chars // greatest(n_words, 1)), ('repeat_rate', 1000 * n_repeat_words // greatest(n_words, 1))"
_OP4 = f"""with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents),
 w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from d),
 grams as (select doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] as gram from (select doc_id, ws, unnest(range(greatest(len(ws) - 2, 0))) as i from w)),
 twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as c from grams) where c > 1),
 covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest(range(3)) as k) group by 1),
 m as (select doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) as n_lines,
 len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from w left join covered using (doc_id)),
 f as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from m),
 r as (select doc_id, lang, source, base_failed, x.metric, x.v from f, lateral (values {_RATES}) as x(metric, v)),
 b as (select lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as bucket from r where not base_failed),
 s as (select 2 as level, lang, source, metric, bucket, count(*) as n from b group by all union all select 1, lang, '', metric, bucket, count(*) from b group by all union all select 0, '', '', metric, bucket, count(*) from b group by all),
 c as (select *, sum(n) over (partition by level, lang, source, metric order by bucket rows unbounded preceding) as below, sum(n) over (partition by level, lang, source, metric) as total from s),
 q as (select level, lang, source, metric, max(total) as total, min(bucket) filter (100 * below >= 50 * total) as q50, min(bucket) filter (100 * below >= {quality.HIGH} * total) as high from c group by all),
 z as (select level, lang, source, metric, total, high + {quality.SPREAD} * (high - q50) + case metric {' '.join(f"when '{k}' then {v}" for k, v in quality.SLACK.items())} end as fence from q),
 fences as (select a.lang, a.source, a.metric, case when a.total >= {quality.MIN_GROUP} then a.fence when b.total >= {quality.MIN_GROUP} then b.fence else e.fence end as fence from z a join z b on b.level = 1 and b.lang = a.lang and b.metric = a.metric join z e on e.level = 0 and e.metric = a.metric where a.level = 2),
 v as (select doc_id, bool_and(coalesce(v <= fence, false)) as fine from r left join fences using (lang, source, metric) group by 1)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and fine as kept from f join v using (doc_id)"""

_ESCAPED = r"(length({0}) + length(regexp_replace({0}, '[^\\<\[\]]+', '', 'g')))"
_OP6 = f"""with t as (select conv_id, case when conv_id is null then row_number() over () end as alone, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, null, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, null, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e as (select *, {_ESCAPED.format('text')} + case role when 'user' then 13 when 'assistant' then 4 when 'system' then 11 else 14 + {_ESCAPED.format('role')} end as chars from t)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, (3 + sum(chars))::bigint as formatted_chars from e group by conv_id, alone"""

_OP10 = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings), l as (select a.vec_id as x, b.vec_id as y from v a, v b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {pq_dedup.COSINE}),
 reach as (select vec_id as x, vec_id as y from v union select reach.x, l.y from reach join l on l.x = reach.y), c as (select x as vec_id, min(y) as component_id from reach group by 1), n as (select x as vec_id, count(*) as n from l group by 1)
 select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)"""


# CRC-32 of a string's UTF-8 bytes, by its table of 256 entries
_CRC = """crc_table as materialized (select list(v order by i) as crc_of from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i)))"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"


_ACCENTED, _PLAIN = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(33, 127)) if c not in "abcdefghijklmnopqrstuvwxyz'")[:64]
_OP11 = f"""with recursive {_CRC}, d as (select row_number() over () as r, coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
 u as (select r, any_value(doc_id) as doc_id, run, count(*) as n from (select r, doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from d where length(run) >= {spelling.LETTERS}) group by r, run),
 h as (select run, n, {_crc("doc_id || ':' || run")} as h from u, crc_table), c as (select case when h % {spelling.SPOILT} = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from h),
 w as materialized (select word, sum(n)::bigint as n, length(word) as len, translate(word, '{_ACCENTED}', '{_PLAIN}') as bytes from c where length(word) >= {spelling.LETTERS} group by word having sum(n) >= {spelling.OCCURRENCES}),
 near as (select a.word, a.n, b.word as other, b.n as other_n from w a join w b on b.len = a.len + 1 and levenshtein(a.bytes, b.bytes) = 1 union all select b.word, b.n, a.word, a.n from w a join w b on b.len = a.len + 1 and levenshtein(a.bytes, b.bytes) = 1 union all select a.word, a.n, b.word, b.n from w a join w b on b.len = a.len and a.word <> b.word and hamming(a.bytes, b.bytes) = 1),
 best as (select word, count(*) as n_near, first(other order by other_n desc, other) as form, max(other_n) as form_n from near group by word),
 f as (select word, n, coalesce(n_near, 0) as n_near, case when form_n >= {spelling.FACTOR} * n then form end as form, case when form_n >= {spelling.FACTOR} * n then form_n end as form_n from w left join best using (word)),
 chain as (select word, word as spot from f union all select chain.word, f.form from chain join f on f.word = chain.spot where f.form is not null)
 select f.word, form, spot as root, f.n, n_near, form_n from f join chain using (word) where spot in (select word from f where form is null)"""

_OP12 = f"""with recursive {_CRC}, o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fault from conversations, crc_table),
 b as (select conv_id, turn, case fault when 4 then 'user' else role end as role, case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from o, unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) as copies(k)),
 q as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from b), p as (select *, row_number() over (partition by conv_id, role, text order by i) as seen from q),
 r as (select *, left(role, 1) as x, lag(left(role, 1)) over (partition by conv_id order by i) as px, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') then 'truncated' else '' end as fault from p),
 ins(st, k, due, pre) as (values (0, 0, 0, ''), (0, 1, 2, 'I'), (0, 2, 3, 'II'), (1, 0, 1, ''), (1, 1, 2, 'I'), (1, 2, 3, 'II'), (2, 0, 2, ''), (2, 1, 3, 'I'), (2, 2, 2, 'II'), (3, 0, 3, ''), (3, 1, 2, 'I'), (3, 2, 3, 'II')),
 edits(e, price) as (values ('D', {repair.DELETE}), ('K', {repair.KEEP}), ('R', {repair.REROLE})),
 dp(conv_id, i, st, cost, audit) as (select distinct conv_id, 0::bigint, 0, 0::bigint, '' from conversations
  union all select conv_id, i, st, best.cost, best.audit from (select dp.conv_id, r.i, case when e = 'D' then due when e = 'K' and x = 's' then 1 when due = 2 then 3 else 2 end as st,
   min({{'cost': dp.cost + {repair.INSERT} * k + price + case when e <> 'D' and fault = 'truncated' then {repair.TRUNCATED} else 0 end, 'audit': audit || pre || e}}) as best
   from dp join r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1 join ins on ins.st = dp.st, edits
   where e = 'D' or fault not in ('blank', 'duplicate') and (e = 'R' or x = 's' and due = 0 or x = 'u' and due <> 2 or x = 'a' and due = 2) group by 1, 2, 3)),
 n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (px || x not in ('su', 'ua', 'au')) as illegal, max(i) as n from r group by conv_id),
 best as (select dp.conv_id, any_value(n) as n, min({{'cost': cost + {repair.INSERT} * k, 'audit': audit || pre}}) as best from dp left join n on n.conv_id is not distinct from dp.conv_id join ins on ins.st = dp.st where dp.i = coalesce(n.n, 0) and due in (0, 3) group by dp.conv_id),
 letters as (select conv_id, best.audit as audit, unnest(range(1, length(best.audit) + 1)) as spot from best),
 turns as (select conv_id, spot, substr(audit, spot, 1) as e, length(replace(substr(audit, 1, spot), 'I', '')) as i, length(replace(substr(audit, 1, spot), 'D', '')) as place from letters),
 kept as (select t.conv_id, t.place, t.e, r.x, r.role, r.text, coalesce(max((t.place = 1 and t.e = 'K' and r.x = 's')::int) over (partition by t.conv_id), 0) as sys from turns t left join r on r.conv_id is not distinct from t.conv_id and r.i = t.i and t.e <> 'I' where t.e <> 'D'),
 hashed as (select conv_id, sha256(string_agg(case e when 'K' then role else case when (place - sys) % 2 = 1 then 'user' else 'assistant' end end || ':' || coalesce(text, ''), chr(10) order by place)) as h from kept group by conv_id)
 select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.cost::bigint as cost, best.audit as audit, coalesce(h, sha256('')) as repaired_sha256
 from best b left join n on n.conv_id is not distinct from b.conv_id left join hashed on hashed.conv_id is not distinct from b.conv_id"""

_OP13 = f"""with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages), f as (select payload_digest, min(page_id) as first from p where payload_bytes >= {warc.LEAST_REVISIT} group by 1)
 select page_id, payload_bytes, payload_digest, case when first is not null and (page_id is null or page_id > first) then 'revisit' else 'response' end as record_type, case when page_id is null or page_id > first then first end as refers_to from p left join f using (payload_digest)"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express. Token ids, XXH64, byte windows and min-hashes are beyond it: tests compare with brute force."""
    return {"op4_quality_rules": _OP4, "op6_chat": _OP6, "op10_embedding_dedup": _OP10, "op11_spelling": _OP11, "op12_repair": _OP12, "op13_warc": _OP13}
