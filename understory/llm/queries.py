"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.near_vectors import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.toxicity import held_out, toxicity_score, train_on

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.html_text import extract_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.mixing import mix_to_targets

    return mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.probminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.containment import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.licenses import confidence, joined_labels, scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    base = F.filter("detections", lambda d: d["base"])
    found = found.select("doc_id", "n_words", "detections", base.alias("base"))
    starts = F.transform("base", lambda d: d["start"])
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined_labels(F.col("base")).alias("base_labels"), joined_labels(F.col("detections")).alias("labels"),
        confidence(F.col("detections")).alias("score"),
    )


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.secret_spans import BASE_KINDS, secret_spans

    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("found")).alias("spans"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.passages import substring_duplicates

    found = substring_duplicates(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"], p["end"])), ",")
    return found.withColumn("passages", spans)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from understory.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = count_tokens(docs, "text", public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    counted = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.hard_negatives import hard_negatives

    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


GROUP, MOST_SHARED = 100, 6  # conversations of a hundred share fewer than six opening turns


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from understory.llm.prefix_trie import graft_openings, prefix_trie, turn_sequences

    conv_id = F.col("conv_id")
    shared = (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")
    turns = turn_sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie(graft_openings(turns, conv_id - conv_id % GROUP, shared, MOST_SHARED - 1))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_near_dedup, op2_toxicity, op3_html_text, op4_mixing, op5_minhash_near_dedup,
        op6_benchmark_containment, op7_licenses, op8_secrets, op9_substring_dedup, op10_token_counts,
        op11_hard_negatives, op12_line_dedup, op13_prefix_trie,
    )}


# All pairs, then the smallest vector reachable by links.
OP1_SQL = """
with recursive usable as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x != 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from usable a join usable b
    on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reached(x, y) as (select x, y from links union select r.x, l.y from reached r join links l on r.y = l.x),
smallest as (select x, min(y) as y from reached group by x),
counted as (select x, count(*) as n from links group by x)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(s.y, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(s.y, vec_id)) as kept
from embeddings left join counted c on vec_id = c.x left join smallest s on vec_id = s.x"""

# Distinct runs of five words of every text, joined on the runs themselves.
_RUNS = r"""
{name}_words as (
  select {key} as id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {table}
  where {key} is not null and text is not null)"""
OP6_SQL = f"""
with {_RUNS.format(name='doc', key='doc_id', table='documents')},
{_RUNS.format(name='item', key='item_id', table='benchmark')},
item_runs as (
  select distinct id as item_id, width, array_to_string(w[i:i + width - 1], ' ') as run
  from (select id, w, least(5, len(w)) as width, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from item_words
    where len(w) > 0)),
widths as (select distinct width from item_runs),
doc_runs as (
  select distinct id as doc_id, width, array_to_string(w[i:i + width - 1], ' ') as run
  from (select id, w, width, unnest(range(1, len(w) - width + 2)) as i from doc_words, widths)),
sizes as (select item_id, count(*) as n from item_runs group by item_id)
select doc_id, item_id, any_value(n) as n_shingles, count(*) as n_found, count(*) / any_value(n) as containment
from item_runs join doc_runs using (width, run) join sizes using (item_id)
group by doc_id, item_id having count(*) >= 0.8 * any_value(n)"""


# All anchors against all rows.
OP11_SQL = """
with usable as (
  select row_number() over () as node, vec_id,
    case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.node, a.vec_id as anchor_id, a.label as own, r.vec_id, r.label,
    cast(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])), 0) as bigint) as score
  from usable a join usable r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id and len(a.v) = len(r.v)),
positives as (
  select *, row_number() over (partition by node order by score desc, vec_id) as place from scored where label = own
  qualify place <= 5)
select p.anchor_id, p.vec_id as positive_id,
  cast(row_number() over (partition by p.node, p.place order by n.score desc, n.vec_id) as integer) as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.node = p.node and n.label <> n.own
  and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5"""

# Lines by their keys, joined on the keys themselves.
OP12_SQL = r"""
with rows as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
keyed as (
  select row, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select row, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from rows)),
shared as (
  select key, min(doc_id) as owner from keyed where doc_id is not null and length(key) >= 10
  group by key having count(distinct doc_id) >= 2)
select any_value(k.doc_id) as doc_id, count(*) as n_lines,
  count(*) filter (s.owner is not null and k.doc_id is not null and k.doc_id <> s.owner) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos)
    filter (s.owner is null or k.doc_id is null or k.doc_id = s.owner), '')) as kept_sha256
from keyed k left join shared s on k.key = s.key group by row"""

_CRC_STEP = "xor(x, case when i % 8 = 0 then cast(ascii(s[i // 8 + 1]) as ubigint) else cast(0 as ubigint) end)"
# Prefixes of the rebuilt conversations as lists, each node met by all its ancestors.
OP13_SQL = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as pos
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 100 as source, cast(xor(list_reduce(range(8 * len(s)),
    lambda x, i: xor({_CRC_STEP} >> 1, cast(3988292384 as ubigint) * ({_CRC_STEP} & cast(1 as ubigint))),
    cast(4294967295 as ubigint)), cast(4294967295 as ubigint)) % 6 as bigint) as h
  from (select distinct conv_id, cast(conv_id as varchar) as s from turns)),
rebuilt as (
  select c.conv_id, 0 as part, pos, role, text from convs c join turns t on t.conv_id = c.source and t.pos <= c.h
  union all select c.conv_id, 1, pos, role, text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
lists as (
  select c.conv_id, coalesce(l, []) as l from convs c left join
    (select conv_id, list(struct_pack(role := role, text := text) order by part, pos) as l from rebuilt group by conv_id) using (conv_id)),
prefixes as (
  select conv_id, len(l) as n, depth, sha256(cast(list_slice(l, 1, depth) as varchar)) as node,
    sha256(cast(list_slice(l, 1, depth - 1) as varchar)) as parent, case when depth > 0 then length(l[depth].text) else 0 end as chars
  from (select conv_id, l, unnest(range(0, len(l) + 1)) as depth from lists)),
nodes as (
  select depth, node, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), '')) as ends
  from prefixes group by depth, node),
children as (select depth - 1 as depth, parent as node, count(*) as n from nodes where depth > 0 group by all),
full_nodes as (select nodes.*, coalesce(c.n, 0) as n_children from nodes left join children c using (depth, node)),
up as (
  select a.depth, a.node, n.n_children, (n.n_convs - 1) * n.chars as saved
  from full_nodes n join prefixes a on a.conv_id = n.conv_id and a.depth <= n.depth),
below as (
  select depth, node, count(*) filter (n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens from up group by depth, node)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens,
  n.ends as ends_sha256
from full_nodes n join below b using (depth, node)
left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.node = n.parent"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": OP1_SQL, "op6_benchmark_containment": OP6_SQL, "op11_hard_negatives": OP11_SQL,
        "op12_line_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL,
    }
