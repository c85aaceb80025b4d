"""SQL for those queries of this subpackage that SQL can express on the small tables."""

from __future__ import annotations

LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id reachable by links, for every node of a CTE nodes (id) and links in both directions (a, b).
REACHED = "reach as (select id as a, id as b from nodes union select r.a, l.b from reach r join links l on l.a = r.b), components as (select a as id, min(b) as component_id from reach group by a)"

EMBEDDINGS = f"""with recursive
sound as (
    select vec_id, label, len(embedding) as n, list_transform(embedding, lambda x: x::double) as x from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
unit as (select vec_id, label, n, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) as x from sound),
pairs as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.n = b.n and a.vec_id < b.vec_id where list_dot_product(a.x, b.x) >= 0.93),
links as (select a, b from pairs union select b, a from pairs),
nodes as (select distinct vec_id as id from embeddings),
{REACHED}
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, component_id, component_id = e.vec_id as kept, 1.0::double as audit_recall
from embeddings e join components c on c.id = e.vec_id"""

JACCARD = f"""with recursive
worded as (select doc_id, regexp_extract_all({LOWER.format(x="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
    select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from worded where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as m from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
pairs as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)),
links as (select a, b from pairs union select b, a from pairs),
nodes as (select distinct doc_id as id from documents),
{REACHED}
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join sizes using (doc_id) join components c on c.id = d.doc_id"""

#: The base of the license scan: places where the words of a fixed phrase stand on end.
LICENSE_BASE = f"""with
worded as (select doc_id, regexp_extract_all({LOWER.format(x="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
phrases as (select * from (values ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])) t(label, p)),
places as (
    select doc_id, label, i - 1 as place
    from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from worded) join phrases on w[i] = p[1] and w[i : i + len(p) - 1] = p
)
select doc_id, len(w) as n_words, n_base, first_word, last_word, coalesce(base_labels, '') as base_labels
from worded left join (select doc_id as d, count(*) as c, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id) on d = doc_id,
lateral (select coalesce(c, 0) as n_base)"""

SQL = {"op2_embedding_near_dedup": EMBEDDINGS, "op7_ngram_jaccard": JACCARD, "license_base": LICENSE_BASE}
