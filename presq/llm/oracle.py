"""DuckDB statements that give the same rows as the queries of this subpackage."""

from __future__ import annotations

_CELLS = "select distinct upper(trim(guid)) as g, upper(trim(allele)) as a from presence where guid is not null and allele is not null"

_GROUPS = """with recursive link as (
  select upper(trim(guid_a)) as a, upper(trim(guid_b)) as b from match_results
  where guid_a is not null and guid_b is not null and distance <= 12),
arc as (select a, b from link union select b, a from link),
vertex as (select upper(trim(guid)) as id from guids where guid is not null union select a from arc union select b from arc),
reach(id, other) as (
  select id, id from vertex union
  select reach.id, arc.b from reach join arc on arc.a = reach.other),
grp as (select id as guid, min(other) as group_id from reach group by id)
"""

_TERMS = f"""with c as (select upper(trim(guid)) as g, upper(trim(allele)) as a from presence where guid is not null and allele is not null),
n as (select a, count(*) as n_rows, count(distinct g) as n_samples from c group by a),
l as (select distinct upper(trim(allele)) as allele from alleles where allele is not null),
t as (select l.allele, coalesce(n_rows, 0)::bigint as n_rows, coalesce(n_samples, 0)::bigint as n_samples from l left join n on n.a = l.allele),
m as (select *, case when n_samples <= 2 then 'rare' when n_samples > 0.5 * (select count(distinct g) from c) then 'common' end as mark from t)
"""

_LEAKS = """with item as (select item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') as w from eval_items where passage is not null),
gram as (select distinct item_id, array_to_string(w[i:i+12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as i from item)),
doc as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
win as (select distinct doc_id, array_to_string(w[i:i+12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from doc)),
leak as (select distinct doc_id, item_id from win join gram using (g))
"""

_SPANS = """with d as (select doc_id, text, length(text) as n from documents where text is not null and length(text) >= 160),
w as (select doc_id, i, hash(substr(text, i + 1, 160)) as h, md5(substr(text, i + 1, 160)) as m from (select doc_id, text, unnest(range(0, n - 159)) as i from d)),
rep as (select h, m from w group by h, m having min(doc_id) <> max(doc_id)),
pos as (select w.doc_id, w.i from w semi join rep on w.h = rep.h and w.m = rep.m),
step as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 160 then 0 else 1 end as fresh from pos),
isle as (select *, sum(fresh) over (partition by doc_id order by i) as k from step),
span as (select doc_id, min(i)::int as span_start, (max(i) + 160)::int as span_end from isle group by doc_id, k)
"""

_PAIRS = f"""with s as (select g as id, a, 0 as kind from ({_CELLS}) union all
  select distinct strain_id, upper(trim(a)), 1 from (select strain_id, unnest(alleles) as a from strains) where a is not null),
n as (select id, kind, count(*) as n from s group by id, kind),
o as (select x.id as ia, y.id as ib, x.kind as ka, y.kind as kb, count(*) as o from s x join s y on x.a = y.a and x.id < y.id and x.kind + y.kind < 2 group by all)
select ia as id_a, ib as id_b from o join n na on na.id = ia and na.kind = ka join n nb on nb.id = ib and nb.kind = kb
where o * 10 >= 7 * (na.n + nb.n - o)"""

_NEAR = """with v as (select upper(trim(guid)) as g, min(profile) as p from profiles
  where guid is not null and len(profile) = 64 and len([x for x in profile if x is null or isnan(x) or isinf(x)]) = 0
  and len([x for x in profile if x <> 0]) > 0 group by 1),
u as (select g, p::double[64] as p from v),
c as (select x.g as guid, y.g as neighbour, array_cosine_similarity(x.p, y.p) as sim from u x join u y on x.g <> y.g),
r as (select *, row_number() over (partition by guid order by round(sim, 12) desc, neighbour) as r from c),
near as (select guid, neighbour from r where r <= 5 and sim >= 0.9)
"""

_CLUSTERS = f"""with recursive c as ({_CELLS}), n as (select g, count(*) as n from c group by g),
o as (select x.g as a, y.g as b, count(*) as o from c x join c y on x.a = y.a and x.g <> y.g group by 1, 2),
arc as (select a, b from o join n na on na.g = a join n nb on nb.g = b where o * 100 >= 15 * (na.n + nb.n - o)),
reach(id, other) as (select g, g from n union select reach.id, arc.b from reach join arc on arc.a = reach.other),
lab as (select id as guid, min(other) as cluster_id from reach group by id)
"""

_DESCRIBED = """, own as (select x.guid, x.cluster_id, sum(o / (sqrt(na.n::double) * sqrt(nb.n::double))) as s
  from lab x join o on o.a = x.guid join lab y on y.guid = o.b and y.cluster_id = x.cluster_id
  join n na on na.g = o.a join n nb on nb.g = o.b group by 1, 2),
ranked as (select lab.guid, lab.cluster_id, row_number() over (partition by lab.cluster_id order by round(coalesce(s, 0), 9) desc, lab.guid) as r
  from lab left join own on own.guid = lab.guid)
select cluster_id, count(*)::bigint as size, list(guid order by r) filter (where r <= 3) as typical from ranked group by cluster_id"""

_LINKS = f"""with s as (select g as id, a, 0 as kind from ({_CELLS}) union all
  select distinct strain_id, upper(trim(a)), 1 from (select strain_id, unnest(alleles) as a from strains) where a is not null),
k as (select id, kind, count(*) as n, string_agg(a, '|' order by a) as own from s group by id, kind),
pair as ({_PAIRS}),
link as (select id, count(*) as n from (select id_a as id from pair union all select id_b from pair) group by id)
select k.id, min(k.id) over (partition by kind, own) as class_id, coalesce(link.n, 0)::bigint as n_links from k left join link on link.id = k.id"""

ORACLE: dict[str, str] = {
    "p1_found": _PAIRS,
    "p1_links": _LINKS,
    "p2_found": _GROUPS + "select guid, group_id from grp",
    "p2_group_sizes": _GROUPS + "select group_id, count(*)::bigint as members from grp group by group_id",
    "p3_found": _NEAR + "select distinct least(guid, neighbour) as guid_a, greatest(guid, neighbour) as guid_b from near",
    "p3_neighbours": _NEAR + "select guid, neighbour from near",
    "p4_found": _CLUSTERS + "select guid, cluster_id from lab",
    "p4_described": _CLUSTERS + _DESCRIBED,
    "p5_found": _TERMS + "select allele, mark from m where mark is not null",
    "p5_term_counts": _TERMS + "select allele, n_rows, n_samples, mark from m",
    "p7_found": _LEAKS + "select doc_id, item_id from leak",
    "p7_leaked_items": _LEAKS + "select item_id, count(*)::bigint as n_docs from leak group by item_id",
    "p8_found": _SPANS + "select doc_id, span_start, span_end from span",
    "p8_shared_share": _SPANS
    + """select documents.doc_id, coalesce(any_value(length(text)), 0)::int as n_chars, count(span_start)::bigint as n_spans,
  coalesce(sum(span_end - span_start), 0)::bigint as shared_chars
from documents left join span on span.doc_id = documents.doc_id group by documents.doc_id""",
    "p7_clean_corpus": _LEAKS + "select doc_id, lang, source from documents where doc_id not in (select doc_id from leak)",
}
