"""The operators of this folder, bound to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontamination, embeddings, mixing, revisits, sharding, simhash, substring, templates, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda s, d: toxicity.report(_read(s, d, "documents"), _read(s, d, "labels")),
        "op2_decontamination": lambda s, d: decontamination.report(_read(s, d, "documents"), _read(s, d, "benchmark")),
        "op3_mixing": lambda s, d: mixing.taken(_read(s, d, "documents")),
        "op4_embedding_dedup": lambda s, d: embeddings.near_duplicates(_read(s, d, "embeddings")),
        "op5_substring_dedup": lambda s, d: substring.report(_read(s, d, "documents")),
        "op6_simhash": lambda s, d: simhash.near_duplicates(_read(s, d, "documents")),
        "op7_revisits": lambda s, d: revisits.report(_read(s, d, "pages")),
        "op8_line_templates": lambda s, d: templates.report(_read(s, d, "documents")),
        "op9_sharding": lambda s, d: sharding.shard_documents(_read(s, d, "documents")),
        "op10_context_tree": lambda s, d: ctw.report(_read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; the others are held against brute force in tests/llm."""
    return {"op2_decontamination": DECONTAMINATION, "op5_substring_dedup": SUBSTRING, "op4_embedding_dedup": EMBEDDINGS, "op7_revisits": revisits.ORACLE}


DECONTAMINATION = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as materialized (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (select distinct item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as x, least(10, len(w)) as k
      from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
s as (select distinct k from v),
o as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as x from (select *, unnest(range(1, greatest(len(w) - k + 2, 1))) as i from d, s)),
m as (select o.doc_id, o.i, o.k, v.item_id from o join v using (k, x)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by doc_id),
p as (select distinct m.doc_id, r.item_row from m join (select *, row_number() over () as item_row from b) r on r.item_id is not distinct from m.item_id),
x as (select p.doc_id, p.item_row, i, j from p join (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i from d where doc_id in (select doc_id from p)) using (doc_id)
      join (select item_row, unnest(w) as word, unnest(range(0, len(w))) as j from (select *, row_number() over () as item_row from b)) using (item_row, word)),
y as (select doc_id, item_row, min(i) as first, count(*) as n from (select *, i - row_number() over (partition by doc_id, item_row, i - j order by i) as run from x) group by doc_id, item_row, i - j, run),
z as (select doc_id, item_id::varchar as longest_item, n as longest_words, first as longest_at,
             row_number() over (partition by doc_id order by n desc, first, item_id is null, item_id::varchar desc) as place
      from y join (select *, row_number() over () as item_row from b) using (item_row)),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       longest_item, coalesce(longest_words, 0)::bigint as longest_words, coalesce(longest_at, -1)::bigint as longest_at
from d left join h using (doc_id) left join t using (doc_id) left join (select * from z where place = 1) using (doc_id)
"""

SUBSTRING = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
o as (select doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) as x from (select *, unnest(range(1, greatest(len(w) - 11, 1))) as i from d)),
f as (select x, min(doc_id) as first from o group by x),
g as (select doc_id, unnest(range(i, i + 13)) as p from o join f using (x) where first < doc_id),
r as (select doc_id, count(distinct p) as n_removed, list(distinct p) as ps from g group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
from d left join r using (doc_id)
"""

EMBEDDINGS = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm
  from embeddings where label is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.vec_id)
select e.vec_id, (select count(*) from l where l.a = e.vec_id)::bigint as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join (select vec_id, min(c) as c from r group by vec_id) m using (vec_id)
"""
