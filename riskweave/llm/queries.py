"""The corpus operators over their whole tables, one query each, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.centroids import centroid_clusters
from riskweave.llm.common import table
from riskweave.llm.conversation_repair import Repair, damaged
from riskweave.llm.exact_dedup import exact_dedup
from riskweave.llm.jaccard_join import near_duplicates
from riskweave.llm.lm_scoring import lm_scores
from riskweave.llm.minhash_dedup import minhash_duplicates
from riskweave.llm.mixing import mix_sources
from riskweave.llm.packing import pack
from riskweave.llm.pii import find_pii
from riskweave.llm.quality import quality
from riskweave.llm.suffix_dedup import without_repeats
from riskweave.llm.topk import top_k
from riskweave.llm.toxicity import toxicity


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


OP1_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("redacted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id is not distinct from min(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive n as (select source, count(*) as n_docs from documents group by source),
rate as (select source, (select count(*) from documents) * (1.0::double / (select count(*) from n)) / n_docs as lam from n),
part as (select source, greatest(1, ceil(lam / 16.0::double))::bigint as parts, lam / greatest(1, ceil(lam / 16.0::double)) as step from rate),
cdf as (
  select source, 0 as k, exp(-step) as p, exp(-step) as c from part
  union all
  select cdf.source, k + 1, p * step / (k + 1), c + p * step / (k + 1) from cdf join part on cdf.source is not distinct from part.source where k < 95),
cdfs as (select source, list(c order by k) as cs from cdf group by source),
drawn as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, list_sum(list_transform(range(0, parts), lambda i: len(list_filter(cs, lambda c: c <=
    ('0x' || substr(sha256('17:' || i || ':' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0::double)))) as n
  from documents d join part on d.source is not distinct from part.source join cdfs on d.source is not distinct from cdfs.source),
copies as (select doc_id, text, lang, source, n_chars, unnest(range(0, n::bigint))::integer as copy from drawn where n > 0)
select *, ('0x' || substr(sha256('17:order:' || coalesce(doc_id::varchar, '') || ':' || copy), 1, 13))::bigint as shuffle_key from copies
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return Repair(damaged(conversations), conversations).report()


def _repair_sql() -> str:
    """The DP row by row, each state with its cost, audit and turns so far."""
    retained = lambda e, role, name, between: (  # noqa: E731
        f"{{'c': {e}.c + {2 * len(between)} + case when fault in (1, 2) then 1000000 when own = '{role}' then 0 else {2 if name else 1000000} end + (fault = 3)::bigint, "
        f"'a': {e}.a || '{'I' * len(between)}' || case when own = '{role}' then 'K' else 'R' end, "
        f"'t': list_concat({e}.t, [{', '.join([*between, f"case when own = '{role}' then role else '{name}' end || ':' || text"])}])}}"
    )
    deleted = lambda e: f"{{'c': {e}.c + 3, 'a': {e}.a || 'D', 't': {e}.t}}"  # noqa: E731
    best = lambda options: f"list_sort([{', '.join(options)}])[1]"  # noqa: E731
    new_s = best([deleted("es"), retained("e0", "s", "", [])])
    new_u = best([deleted("eu"), *(retained(e, "u", "user", []) for e in ("e0", "es", "ea")), retained("eu", "u", "user", ["'assistant:'"])])
    new_a = best([deleted("ea"), retained("eu", "a", "assistant", []), *(retained(e, "a", "assistant", ["'user:'"]) for e in ("e0", "es", "ea"))])
    closed = lambda e, turns: f"{{'c': {e}.c + {2 * len(turns)}, 'a': {e}.a || '{'I' * len(turns)}', 't': list_concat({e}.t, {turns}::varchar[])}}"  # noqa: E731
    ends = best([closed("e0", []), closed("es", ["user:", "assistant:"]), closed("eu", ["assistant:"]), closed("ea", [])])
    never = "{'c': 1000000::bigint, 'a': '', 't': []::varchar[]}"
    return rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as key from conversations),
coded as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(key, lambda x: ord(x)::bigint)), lambda c, b:
    list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 20 as code from keyed),
damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role, case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when code = 3 then [0, 1] else [0] end) as copy from coded where code <> 0),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k, count(*) over (partition by conv_id) as n, substr(role, 1, 1) as own from damaged),
t as (
  select *, case when not regexp_matches(text, '[^ 	-]') then 1 when row_number() over (partition by conv_id, role, text order by k) > 1 then 2
    when not regexp_matches(text, '[.!?][ 	-]*$') then 3 else 0 end as fault, lag(own) over (partition by conv_id order by k) || own as pair from numbered),
r as (
  select conv_id, 0::bigint as k, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}} as e0, {never} as es, {never} as eu, {never} as ea from (select distinct conv_id from t) c
  union all
  select t.conv_id, t.k, {deleted("e0")}, {new_s}, {new_u}, {new_a} from r join t on t.conv_id is not distinct from r.conv_id and t.k = r.k + 1),
ended as (select r.conv_id, {ends} as e from r join t on t.conv_id is not distinct from r.conv_id and t.k = r.k where t.k = t.n),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 1) as blank, count_if(fault = 2) as duplicate, count_if(fault = 3) as truncated,
    count_if(k > 1 and pair not in ('su', 'ua', 'au')) as illegal from t group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted on o.conv_id is not distinct from counted.conv_id left join ended on o.conv_id is not distinct from ended.conv_id
"""


OP11_SQL = _repair_sql()

def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _centroids_sql(rounds: int = 3) -> str:
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} as (
  select *, row_number() over (partition by rid order by d, cluster) as near from (
    select v.rid, v.vec_id, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{r} c) x qualify near = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as (
  select c.cluster, coalesce(m.q, c.q) as q from c{r} c left join (
    select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as q from (
      select cluster, i, sum(x)::hugeint as s, count(*)::hugeint as n from (select cluster, unnest(q) as x, unnest(range(64)) as i from a{r}) y group by cluster, i) z group by cluster) m on m.cluster = c.cluster)""")
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q, row_number() over () as rid from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select (h - 1)::integer as cluster, q from (select q, row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), q) as h from v) x where h <= 16),
{", ".join(parts)}
select vec_id, a.cluster, d as distance, (sum(d) over (partition by a.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.cluster = c.cluster
"""


OP12_SQL = _centroids_sql()

def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_toxicity": op2_toxicity,
        "op3_pii": op3_pii,
        "op5_quality": op5_quality,
        "op4_exact_dedup": op4_exact_dedup,
        "op6_mix_sources": op6_mix_sources,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_pack": op10_pack,
        "op11_repair": op11_repair,
        "op12_centroids": op12_centroids,
        "op13_minhash_dedup": op13_minhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_mix_sources": OP6_SQL, "op11_repair": OP11_SQL, "op12_centroids": OP12_SQL}
