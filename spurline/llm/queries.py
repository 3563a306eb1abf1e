"""The queries of this subpackage over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spurline.llm import divergence, exact, language, lattice, licenses, mixing, neardup, ngrams, pages, pieces, prefixes, quality, urls
from spurline.llm.common import table

def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out))
    return quality.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join(F.array_sort("licenses"), ",").alias("licenses"), F.array_join("sentences", ",").alias("sentences"), "unknown")


def tokenizer_model() -> bytes:
    """The 32k-piece model of the installed public tokenizers."""
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def piece_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Encodes and decodes docs; n_tokens and the digests stand for ids and decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return pieces.round_trip(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_model())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


OP6_SQL = """
with bare as (
  select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from bare window w as (partition by text_sha256 order by points desc, doc_id nulls last rows between unbounded preceding and unbounded following)
"""

def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages, with likelihoods fitted to the declared languages of documents."""
    docs, web, carry = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"), ("doc_id", "page_id")
    columns = [*carry, "text", "is_page", "declared", "host"]
    both = (
        language.from_documents(docs.select("doc_id", "text", "lang", "source")).withColumn("page_id", F.lit(None).cast("long")).select(columns)
        .unionByName(language.from_pages(web.select("page_id", "url", "html")).withColumn("doc_id", F.lit(None).cast("long")).select(columns))
    )
    return language.identify(both, language.fit(docs), carry=carry)


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(web, urls.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from parts)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from ruled
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.with_heads(table(spark, sf_dir, "conversations")))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the ASCII characters of a text, which DuckDB has no function for: each byte is xored in, then come eight shifts (-1)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda a, x: case when x >= 0 then xor(a, x) else {shift} end), 4294967295)"


OP11_SQL = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as body,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), digest) as k
  from conversations where conv_id is not null),
convs as (select distinct conv_id, conv_id - conv_id % 20 as base, {crc32_sql("conv_id::varchar")} % 4 as h from turns),
rebuilt as (
  select c.conv_id, 0 as part, t.k, t.digest, t.body from convs c join turns t on t.conv_id = c.base and t.k <= c.h
  union all select c.conv_id, 1, t.k, t.digest, t.body from convs c join turns t on t.conv_id = c.conv_id and t.k > c.h),
paths as (
  select conv_id, row_number() over w as depth, string_agg(digest, '') over w as path, len(list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words
  from rebuilt window w as (partition by conv_id order by part, k)
  union all select conv_id, 0, '', 0 from convs),
ended as (select conv_id, max_by(path, depth) as path from paths group by conv_id),
ends as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from ended group by path),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words, left(path, 32 * (depth - 1)::int) as above
  from paths group by path, depth),
kids as (select above as path, count(*) as n from nodes where depth > 0 group by above),
below as (
  select n.path, sum((d.n_convs - 1) * d.words)::bigint as saved_tokens, sum((k.n is null)::int)::bigint as n_leaves
  from nodes n join nodes d on d.depth >= n.depth and left(d.path, 32 * n.depth::int) = n.path left join kids k on k.path = d.path
  group by n.path)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0)::bigint as n_children, b.n_leaves, b.saved_tokens,
  coalesce(e.ends, sha256('')) as ends_sha256
from nodes n join below b using (path) left join kids k using (path) left join ends e using (path) left join nodes p on n.depth > 0 and p.path = n.above
"""


def op12_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = ngrams.pack(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    return ngrams.learnt_and_scored(blocks)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = """
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents),
found as (select id, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as whole from found group by lang, term having count(distinct id) >= 30),
counts as (select lang, source, term, count(*) as n from found join kept using (lang, term) group by lang, source, term),
langs as (select lang, count(*) as v, sum(whole) as total from kept group by lang),
grps as (
  select d.lang, d.source, coalesce(sum(c.n), 0) as total
  from (select distinct lang, source from docs) d left join counts c on c.lang = d.lang and c.source = d.source group by d.lang, d.source),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) as p, 1 + (1000000000::hugeint * (k.whole + 5)) // (l.total + 5 * l.v) as q
  from grps g join kept k on k.lang = g.lang join langs l on l.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
items as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from grps a join grps b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, p - q from shares where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from items)
where part = 'pair' or rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_license_scan": op2_license_scan,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_html_text": op4_html_text,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_language_id": op7_language_id,
        "op8_url_filter": op8_url_filter,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_source_mix": op10_source_mix,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_ngram_score": op12_ngram_score,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.as_sql(), "op6_exact_dedup": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_source_divergence": OP13_SQL}
