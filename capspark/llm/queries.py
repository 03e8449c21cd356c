"""The registered queries of the thirteen operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capspark.llm import bpe, chat, classifier, decontamination, lines, near, quality_rules, repair, sharding, simhash, trie, warc, whitening

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_texts(_table(spark, sf_dir, "documents"), 16)


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(spark, warc.archive_pages(_table(spark, sf_dir, "pages")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(_table(spark, sf_dir, "documents"), "source", "text")
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def bpe_digests(docs: DataFrame) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    back = bpe.round_trip(docs.select("doc_id", "text"), path, pattern)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op5_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, END_ID)
    return repair.read_tokens(spark, path, with_ids=False)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.85)


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.repetition(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"]
    return out.select("doc_id", *[F.col(f"repetition.{x}").alias(x) for x in names])


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.learn(docs, _table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model).drop("text")
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_lpt_sharding, op2_warc_chunks, op3_line_dedup, op4_bpe_transducer, op5_repair_tokens, op6_template_decontamination, op7_lsh_forest, op8_perspectives, op9_suffix_repetition, op10_pu_quality, op11_cholesky_whitening, op12_simhash_pivots, op13_prefix_trie)
    }


_OP2 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from f
"""

_OP3 = f"""
with d as (
  select *, row_number() over () as page from documents
), l as (
  select page, coalesce(source, '') as host, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from d
), b as (
  select *, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as bare from l
), totals as (
  select coalesce(source, '') as host, count(*) as pages from d group by 1
), hot as (
  select host, bare from (select host, bare, count(distinct page) as n from b where bare <> '' group by 1, 2)
  join totals using (host)
  where n >= {lines.MIN_PAGES} and n > pages * case when length(bare) >= {lines.LONG} then {lines.MAX_RATIO_LONG} else {lines.MAX_RATIO} end
), kept as (
  select page, count(*) as n_lines, count(*) filter (where hot.bare is not null) as n_dropped,
    string_agg(line, chr(10) order by pos) filter (where hot.bare is null) as text
  from b left join hot using (host, bare) group by page
)
select d.doc_id, d.source, cast(case when coalesce(d.text, '') = '' then 0 else n_lines end as bigint) as n_lines,
  cast(n_dropped as bigint) as n_dropped, case when d.text is not null then coalesce(kept.text, '') end as text
from d join kept using (page)
"""

_OP8 = """
with s as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as x from conversations
), who as (
  select distinct conv_id, speaker as perspective from s where speaker not in ('system')
), r as (
  select s.*, perspective,
    case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role,
    case when speaker <> 'system' and speaker <> perspective then speaker end as name
  from s join who on s.conv_id is not distinct from who.conv_id
), h as (
  select *, '<|im_start|>' || role || coalesce(' name=' || replace(name, '<|', '< |'), '') || chr(10) as head from r
), e as (
  select *, head || replace(x, '<|', '< |') || '<|im_end|>' || chr(10) as rendered from h
), p as (
  select *, cast(length(rendered) as bigint) as n_chars,
    cast(coalesce(sum(length(rendered)) over (partition by conv_id, perspective order by turn nulls first, speaker, x rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from e
)
select conv_id, perspective, turn, speaker, role, name, rendered, n_chars, start,
  case when role = 'assistant' then start + length(head) end as mask_start,
  case when role = 'assistant' then start + n_chars - 1 end as mask_end
from p
"""

_OP9 = f"""
with w as (
  select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents
), n as (
  select *, len(words) as n_words from w
), k as (
  select unnest([{quality_rules.WINDOW}, {quality_rules.LEAST_REPEAT}, {quality_rules.LONGEST + 1}]) as size
), win as (
  select doc_id, size, pos, hash(list_slice(words, pos, pos + size - 1)) as h
  from (select doc_id, words, size, unnest(range(1, n_words - size + 2)) as pos from n cross join k where n_words >= size)
), rep as (
  select doc_id, size, pos from (select *, count(*) over (partition by doc_id, size, h) as c from win) where c > 1
), cov as (
  select doc_id, size, count(distinct pos + o) as covered from (select *, unnest(range(size)) as o from rep) group by 1, 2
), l as (
  select doc_id, count(*) - count(distinct line) as dups
  from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1
), m as (
  select n.doc_id, n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dups, 0) as n_dup_lines,
    coalesce((select covered from cov where cov.doc_id = n.doc_id and size = {quality_rules.WINDOW}), 0) as n_repeat_words,
    coalesce((select covered from cov where cov.doc_id = n.doc_id and size = {quality_rules.LEAST_REPEAT}), 0) as covered_words,
    exists (select 1 from cov where cov.doc_id = n.doc_id and size = {quality_rules.LONGEST + 1}) as too_long
  from n left join l on n.doc_id = l.doc_id
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words as base_failed,
  not (n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words)
    and 100 * covered_words <= {quality_rules.MAX_COVERED} * n_words and not too_long as kept,
  cast(covered_words as bigint) as covered_words
from m
"""


_OP13 = f"""
with t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as turn_key, octet_length(encode(coalesce(text, ''))) as bytes
  from conversations where conv_id is not null
), own as (
  select c, max(pos) as own, c - c % {trie.GROUP} as base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % {trie.SHARED} as h
  from t group by c
), convs as (
  select a.c, a.base, a.h, least(a.h, coalesce(b.own, 0)) as first, least(a.h, coalesce(b.own, 0)) + greatest(0, a.own - a.h) as n
  from own a left join own b on b.c = a.base
), r as (
  select v.c, pos, turn_key, bytes from convs v join t on t.c = v.base where pos <= first
  union all select v.c, first + pos - h, turn_key, bytes from convs v join t on t.c = v.c where pos > h
), mem as (
  select c, pos as depth, string_agg(turn_key, ',') over (partition by c order by pos rows unbounded preceding) as k, bytes from r
  union all select c, 0, '', 0 from convs
), nodes as (
  select depth, k, min(c) as conv_id, count(*) as n_convs, min(bytes) as bytes from mem group by 1, 2
), memb as (
  select m.c, m.depth, n.conv_id from mem m join nodes n on n.depth = m.depth and n.k = m.k
), linked as (
  select n.*, p.conv_id as parent_conv_id from nodes n left join memb p on p.c = n.conv_id and p.depth = n.depth - 1
), kids as (
  select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by 1, 2
), sized as (
  select l.*, coalesce(n_children, 0) as n_children from linked l left join kids k on k.conv_id = l.conv_id and k.depth = l.depth
), sums as (
  select m.conv_id, m.depth, sum(case when s.n_children = 0 then 1 else 0 end) as n_leaves, sum((s.n_convs - 1) * s.bytes) as saved_tokens
  from sized s join memb m on m.c = s.conv_id and m.depth <= s.depth group by 1, 2
), ends as (
  select m.conv_id, m.depth, string_agg(cast(m.c as varchar), ',' order by m.c) as ids from memb m join convs v on v.c = m.c and v.n = m.depth group by 1, 2
)
select s.conv_id, cast(s.depth as bigint) as depth, s.parent_conv_id, cast(s.n_convs as bigint) as n_convs, cast(s.n_children as bigint) as n_children,
  cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from sized s join sums u on u.conv_id = s.conv_id and u.depth = s.depth left join ends e on e.conv_id = s.conv_id and e.depth = s.depth
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_chunks": _OP2, "op3_line_dedup": _OP3, "op8_perspectives": _OP8, "op9_suffix_repetition": _OP9, "op13_prefix_trie": _OP13}
