"""SQL of registered queries, for DuckDB: whole tables, every pair that shares something compared, components by reaching out from every row."""

from __future__ import annotations

import string

#: op1: sets of five words, links by overlap, components.
NGRAM_SQL = rf"""with recursive w as (
  select doc_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as materialized (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from sh group by 1),
met as materialized (select a.doc_id as x, b.doc_id as y, count(*) as shared from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as materialized (select x, y from met join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
reach(doc_id, c) as (select doc_id, doc_id from documents union select y, c from reach join link on x = doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(min(c), doc_id) as component_id from reach left join n using (doc_id) group by doc_id, n"""

#: op9: cosines within a label, counts of links, components.
EMBEDDING_SQL = """with recursive v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as materialized (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(vec_id, c) as (select vec_id, vec_id from embeddings union select y, c from reach join link on x = vec_id),
n as (select x as vec_id, count(*) as n from link group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, min(c) as component_id, vec_id = min(c) as kept from reach left join n using (vec_id) group by vec_id, n"""
