"""DuckDB SQL for the queries of ``queries``, over the same tables."""

from __future__ import annotations

_NODES = """
n0 as (
  select 0::bigint * 10000000000 + r_regionkey as ord, 'region:' || r_regionkey as id, r_name as name, 'Location' as type, '' as description, 1::bigint as mentions from region
  union all select 10000000000 + n_nationkey, 'nation:' || n_nationkey, n_name, 'Location', '', 1 from nation
  union all select 20000000000 + s_suppkey, 'supplier:' || s_suppkey, s_name, 'Organization', 'supplier', 2 from supplier
  union all select 30000000000 + c_custkey, 'customer:' || c_custkey, c_name, 'Organization', c_mktsegment, 1 from customer
  union all select 40000000000 + p_partkey, 'part:' || p_partkey, p_name, 'Product', p_type, p_size from part
  union all select 50000000000 + o_orderkey, 'orders:' || o_orderkey, 'Order ' || o_orderkey, 'Event', o_orderpriority, 1 from orders),
edges as (
  select 0::bigint + n_nationkey as ord, 'nation:' || n_nationkey as source, 'in' as relation, 'region:' || n_regionkey as target, 1::bigint as count from nation
  union all select 10000000000 + s_suppkey, 'supplier:' || s_suppkey, 'in', 'nation:' || s_nationkey, 1 from supplier
  union all select 20000000000 + c_custkey, 'customer:' || c_custkey, 'in', 'nation:' || c_nationkey, 1 from customer
  union all select 30000000000 + o_orderkey, 'orders:' || o_orderkey, 'placed by', 'customer:' || o_custkey, 1 from orders),
deg as (select id, count(*) as degree from (select source as id from edges union all select target from edges) group by id),
nodes as (select n0.*, coalesce(degree, 0)::bigint as degree, 2 * coalesce(degree, 0)::bigint + mentions as score from n0 left join deg using (id)),
links as (select source as a, target as b from edges union all select target, source from edges),
facts as (select o_orderkey as ord, concat_ws(' ', 'priority', o_orderpriority, 'status', o_orderstatus, 'customer', o_custkey::varchar) as text, 'orders:' || o_orderkey as n1, 'customer:' || o_custkey as n2 from orders)
"""
_G = f"with {_NODES}"
_HOPS = """,
h1 as (select distinct b as id from links where a = 'nation:3' and b <> 'nation:3'),
h2 as (select distinct b as id from links where a in (select id from h1) and b <> 'nation:3' and b not in (select id from h1)),
reached as (select 'nation:3' as id, 0 as hop union all select id, 1 from h1 union all select id, 2 from h2)
"""
_TOP_FACTS = """,
fs as (select f.ord, trim(f.text) as text, (1 + a.score + b.score)::bigint as score from facts f join nodes a on a.id = f.n1 join nodes b on b.id = f.n2),
fd as (select *, row_number() over (partition by lower(text) order by score desc, ord) as d from fs),
ft as (select row_number() over (order by score desc, ord)::int as rank, ord, text, score from fd where d = 1)
"""
_DOCS = r"""
docs as (select source || '/' || doc_id as file, doc_id, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as norm from documents),
keys as (select file, doc_id, md5(norm) as fingerprint, length(norm)::int as norm_len, lower(file) as stem from docs)
"""


def _chunks(size: int, overlap: int, docs: str = "documents") -> str:
    return rf"""
w as (select source || '/' || doc_id as file, doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from {docs}),
p as (select file, doc_id, text, w, unnest(range(greatest((len(w) + {size - 1}) // {size}, 1))) as i from w),
c0 as (select file, doc_id, i, case when len(w) <= {size} then regexp_replace(text, '^\s+|\s+$', '', 'g')
   else case when i > 0 then array_to_string(w[greatest(i * {size} - {overlap - 1}, 1):i * {size}], ' ') || chr(10) else '' end || array_to_string(w[i * {size} + 1:(i + 1) * {size}], ' ') end as text from p),
c1 as (select * from c0 where len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) >= 3),
chunks as (select file, doc_id, (row_number() over (partition by file order by i) - 1)::int as chunk, text from c1)
"""


def raw_facts(size: int, overlap: int, docs: str = "documents") -> str:
    """Chunks of a table of documents with what the offline rules find in them: ``names``, ``once``, ``pairs`` and ``facts`` in ``f``."""
    return rf"""{_raw(size, overlap, docs)},
s0 as (select *, (list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) >= 8))[1:5] as s from nm),
f as (select *, list_filter(list_transform(s, lambda x: {{'t': substr(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[ "''`*_#]+|[ "''`*_#]+$', '', 'g'), 1, 240), 'n': (list_filter(names, lambda n: contains(x, n)))[1:8]}}), lambda r: length(r.t) >= 8) as facts,
  {_ONCE} as once, list_filter(list_transform(range(1, len(names)::int), lambda i: {{'s': names[i], 't': names[i + 1]}}), lambda r: lower(r.s) <> lower(r.t)) as pairs from s0)"""


def _raw(size: int, overlap: int, docs: str = "documents") -> str:
    return rf"""{_chunks(size, overlap, docs)},
t as (select *, doc_id * 16777216 + chunk * 256 as base, list_filter(string_split_regex(text, '[\s.,;:!?()"''|#$%&*]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{4,}}')) as w from chunks),
nm as (select *, (list_filter(w, lambda x, i: list_position(w, x) = i))[1:10] as names from t)"""


# a list's members whose lower-cased form did not occur before
_ONCE = "list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i)"
_RAW = f"with {_raw(1400, 100)}\n"
_FACTS = f"with {raw_facts(1400, 100)}\n"

_CLAIMS = """
m as (select case when p_partkey % 2 = 1 then p_partkey else p_partkey + (select max(p_partkey) + 1 from part) end as seq, 'part ' || p_partkey as nm, 'part ' || (p_partkey * 3) as alias, 'part-' || (p_partkey * 3) as surface, 'Part ' || p_partkey as name from part),
fm as (select nm, min(seq) as s from m group by nm),
parents as (select m.alias, m.nm as parent, m.surface from m left join fm on fm.nm = m.alias where fm.s is null or m.seq < fm.s),
chase as (select alias, parent as root, surface from parents union all select c.alias, p.parent, c.surface from chase c join parents p on p.alias = c.root),
roots as (select alias, root, surface from chase where root not in (select alias from parents))
"""
_VOTES = """
v as (select o_custkey::varchar as key, o_orderkey as seq, case o_orderkey % 3 when 0 then 'Concept' when 1 then 'Event' else 'Metric' end as type, o_orderpriority as description, o_orderstatus as file from orders join customer on o_custkey = c_custkey)
"""
_PRICED = """
p as (select p_partkey, case p_partkey % 5 when 0 then (p_size + 1990)::varchar when 1 then p_size || '%' when 2 then '2001-' || (2001 + p_size) when 3 then 'ISO ' || p_size else p_name end as name from part)
"""
_VECTORS = """
e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
u as (select vec_id, 'p' || label as project, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from e),
q as (select v from u where vec_id = 7)
"""


def _search(where: str) -> str:
    return f"""with {_VECTORS},
s as (select u.vec_id, u.project, list_dot_product(u.v, q.v) as score from u, q {where}),
pool as (select *, row_number() over (partition by project order by score desc, vec_id) as r from s),
best as (select *, row_number() over (order by score desc, project, vec_id)::int as rank from pool where r <= 24)
"""


_PAIRS = f"""with recursive {_VECTORS},
pairs as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.v, b.v) as sim from u a join u b on a.vec_id < b.vec_id)
"""

_GRAPH = rf"""{_FACTS.replace("from documents)", "from kept)", 1).replace("with ", "with kept as (select doc_id, source, text from (select doc_id, source, text, length(norm) as n, row_number() over (partition by md5(norm) order by doc_id) as r from (select *, trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')) as norm from documents)) where not (n > 200 and r > 1)),", 1)},
ments as (select base + i - 1 as seq, once[i] as name, lower(once[i]) as key, file from f, range(1, 11) t(i) where i <= len(once) and lower(once[i]) not in ('page', 'source', 'method', 'chunk', 'image') and not starts_with(lower(once[i]), 'recollect')),
ent as (select key as id, min(seq) as ord, min_by(name, seq) as name, count(*) as mentions from ments group by key),
src as (select key, file, count(*) as n, min(seq) as s from ments group by key, file),
srcs as (select key as id, string_agg(file, '|' order by r) as sources from (select *, row_number() over (partition by key order by n desc, s) as r from src) where r <= 8 group by key),
rel as (select base + i - 1 as seq, lower(pairs[i].s) as source, lower(pairs[i].t) as target, file from f, range(1, 11) t(i) where i <= len(pairs)),
edg as (select source, target, min(seq) as ord, count(*) as count, list_sort(list(distinct file)) as fl from rel where source <> target and source in (select id from ent) and target in (select id from ent) group by source, target),
dg as (select id, count(*) as degree from (select source as id from edg union all select target from edg) group by id),
fct as (select base + i - 1 as seq, facts[i].t as text, list_transform(facts[i].n, lambda x: lower(x)) as n, file from f, range(1, 6) t(i) where i <= len(facts)),
fn as (select *, list_filter(list_filter(n, lambda x, i: list_position(n, x) = i), lambda x: list_contains(ids, x)) as nodes from fct, (select list(id) as ids from ent)),
nf as (select id, text, min(seq) as seq from (select unnest(nodes[1:4]) as id, text, seq from fn) group by id, text),
nfs as (select id, string_agg(text, '|' order by r) as facts from (select *, row_number() over (partition by id order by seq, text) as r from nf) where r <= 12 group by id)
"""

ORACLE = {
    "graph_degree": f"{_G} select id, degree from deg",
    "graph_top_entities": f"{_G} select name, type, degree, mentions from nodes order by score desc, ord, id limit 12",
    "graph_entities_by_type": f"{_G} select type, count(*) as n from nodes group by type",
    "graph_counts": f"{_G} select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from facts) as facts",
    "graph_expand_2hop": f"{_G}{_HOPS} select id, hop from reached",
    "graph_ego_relations": f"{_G} select coalesce(s.name, e.source) as source, relation, coalesce(t.name, e.target) as target from edges e left join nodes s on s.id = e.source left join nodes t on t.id = e.target where e.source = 'nation:3' or e.target = 'nation:3' order by e.ord, 1, 3 limit 25",
    "graph_neighbours": f"{_G}{_HOPS} select id, name, type, hop from reached join nodes using (id) where hop > 0 order by hop, degree desc, ord limit 30",
    "entity_lookup": f"""{_G} select 'nation:5' as entity, id, 1 as matched_by from nodes where id = 'nation:5'
        union all (select 'order 7', id, 2 from nodes where lower(name) = 'order 7' order by ord limit 1)
        union all (select 'customer#00000001', id, 3 from nodes where contains(lower(name), 'customer#00000001') order by degree desc, ord limit 1)""",
    "edge_dedup_count": """select 'customer:' || o_custkey as source, min_by('Ordered: ' || l_returnflag, l_orderkey * 100 + l_linenumber) as relation, p_brand as target, count(*) as count, min(l_orderkey * 100 + l_linenumber) as ord
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by o_custkey, p_brand, l_returnflag""",
    "mindmap_edges": f"{_G}, k as (select id from nodes order by score desc, ord, id limit 250) select source, relation, target from edges where source in (select id from k) and target in (select id from k)",
    "digest_facts": f"{_G}{_TOP_FACTS} select rank, text, score from ft where rank <= 40",
    "digest_relations": f"""{_G}, k as (select id from nodes order by score desc, ord, id limit 40),
        s as (select e.*, (count + case when source in (select id from k) and target in (select id from k) then 2 else 0 end)::bigint as score from edges e),
        r as (select *, row_number() over (order by score desc, ord, source, target, relation)::int as rank from s)
        select rank, a.name as source, relation, b.name as target, r.score from r join nodes a on a.id = r.source join nodes b on b.id = r.target where rank <= 14""",
    "digest_sections": f"""{_G}, ty as (select type, sum(score) as total, min_by(ord, (-score, ord)) as o, max(score) as top from nodes group by type),
        tr as (select type, row_number() over (order by total desc, top desc, o) as type_rank from ty),
        b as (select *, row_number() over (partition by type order by score desc, ord, id)::int as place from nodes),
        l as (select b.*, row_number() over (order by type_rank, place)::int as line from b join tr using (type) where place <= 6)
        select type, place, line, name, description from l where line <= 30""",
    "digest_lead": f"{_G}, r as (select *, row_number() over (order by score desc, ord, id)::int as rank from nodes where type in ('Project', 'Organization')) select rank, name, description from r where rank <= 2 and description <> ''",
    "node_fact_lists": f"""{_G}, named as (select n1 as id, text, ord from facts union all select n2, text, ord from facts), d as (select id, text, min(ord) as ord from named group by id, text), r as (select *, row_number() over (partition by id order by ord, text) as r from d)
        select id, string_agg(text, '|' order by r) as facts, count(*)::int as n from r where r <= 12 group by id""",
    "link_import": f"""{_G}, k as (select id from nodes order by score desc, ord, id limit 20)
        select 'node' as kind, 'star:' || id as id from k union all
        select 'edge', concat_ws(' ', 'star:' || source, relation, 'star:' || target) from edges where source in (select id from k) and target in (select id from k) union all
        select 'fact', concat_ws(' ', text, concat_ws(',', case when n1 in (select id from k) then 'star:' || n1 end, case when n2 in (select id from k) then 'star:' || n2 end)) from facts where n1 in (select id from k) or n2 in (select id from k)""",
    "project_catalog": f"""{_G}, p as (select source as project, count(*) as files, sum(n_chars)::bigint as chars from documents group by source union all select distinct split_part(id, ':', 1), 0, 0 from nodes)
        select project, files, chars, (select count(*) from nodes where split_part(id, ':', 1) = project) as nodes, (select count(*) from edges where split_part(source, ':', 1) = project) as edges from p""",
    "doc_fingerprint": f"with {_DOCS} select file, fingerprint, norm_len, stem from keys",
    "doc_exact_dedup": f"with {_DOCS}, r as (select *, row_number() over (partition by fingerprint order by doc_id) as r from keys) select file, fingerprint from r where not (norm_len > 200 and r > 1)",
    "doc_dedup": rf"""with recursive {_DOCS},
        c as (select source || '.v' || d.doc_id || '.md' as file, source as stem, fingerprint as h, norm_len as n, row_number() over (order by d.doc_id) as rn from documents d join keys using (doc_id)),
        r as (select 0::bigint as rn, null::varchar as file, null::varchar as skipped, []::varchar[] as hashes, map([]::varchar[], []::int[]) as stems
          union all select c.rn, c.file, case when dup then 'duplicate' when var then 'variant' end,
            case when dup or var then t.hashes else list_append(t.hashes, c.h) end, case when dup or var then t.stems else map_concat(t.stems, map([c.stem], [c.n])) end
          from (select r.*, x.n > 200 and list_contains(r.hashes, x.h) as dup, coalesce(x.n > 300 and x.n / r.stems[x.stem] between 0.6 and 1.7, false) as var, x.rn as nrn from r join c x on x.rn = r.rn + 1) t join c on c.rn = t.nrn)
        select file, skipped from r where rn > 0""",
    "doc_chunks": f"with {_chunks(200, 20)} select file, chunk, md5(text) as digest, length(text)::int as chars from chunks",
    "doc_chunk_cap": f"with {_chunks(1400, 100)} select file, count(*) as chunks, sum(length(text) // 4)::bigint as tokens from chunks where chunk < 8 group by file",
    "latest_file_state": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1",
    "manifest_diff": "select doc_id::varchar as rel_path, case when doc_id % 7 = 0 then 'new' when doc_id % 5 = 0 then 'changed' else 'cached' end as status from documents",
    "raw_entities": f"{_RAW}, d as (select *, {_ONCE} as once from nm) select base + i - 1 as seq, once[i] as name, 'Concept' as type, file, chunk from d, range(1, 11) t(i) where i <= len(once)",
    "raw_relations": f"""{_RAW}, d as (select *, list_filter(list_transform(range(1, len(names)::int), lambda i: {{'s': names[i], 't': names[i + 1]}}), lambda r: lower(r.s) <> lower(r.t)) as pairs from nm)
        select base + i - 1 as seq, pairs[i].s as source, 'precedes' as relation, pairs[i].t as target, true as grounded from d, range(1, 11) t(i) where i <= len(pairs)""",
    "raw_facts": f"{_FACTS} select base + i - 1 as seq, facts[i].t as text, array_to_string(facts[i].n, '|') as entities from f, range(1, 6) t(i) where i <= len(facts)",
    "extract_counts": f"{_FACTS} select count(distinct file) as docs, count(*) as chunks, sum(len(once))::bigint as raw_entities, sum(len(pairs))::bigint as raw_relations, sum(len(facts))::bigint as raw_facts from f",
    "json_salvage": "select event_id, case when event_id % 4 = 2 then null else (props ->> 'k')::bigint end as k from events",
    "alias_resolution": f"with recursive {_CLAIMS} select alias, root from roots",
    "resolved_nodes": f"""with recursive {_CLAIMS}, own as (select m.*, coalesce(r.root, m.nm) as key from m left join roots r on r.alias = m.nm),
        n as (select key, min(seq) as ord, min_by(name, seq) as name, count(*) as mentions from own group by key), a as (select root as key, string_agg(surface, '|' order by surface) as aliases, list(surface order by surface) as l from roots group by root)
        select replace(lower(n.name), ' ', '-') as id, n.name, mentions, coalesce(array_to_string(l[1:8], '|'), '') as aliases from n left join a using (key)""",
    "type_votes": f"with {_VOTES}, c as (select key, type, count(*) as n, min(seq) as s from v group by key, type), r as (select *, row_number() over (partition by key order by type = 'Concept', n desc, s) as r from c) select key, type from r where r = 1",
    "description_mode": f"with {_VOTES}, c as (select key, description, count(*) as n, min(seq) as s from v group by key, description), r as (select *, row_number() over (partition by key order by n desc, s) as r from c) select key, description from r where r = 1",
    "source_top": f"with {_VOTES}, c as (select key, file, count(*) as n, min(seq) as s from v group by key, file), r as (select *, row_number() over (partition by key order by n desc, s) as r from c) select key, string_agg(file, '|' order by r) as files from r where r <= 2 group by key",
    "type_refine": rf"""with {_PRICED} select p_partkey, case when regexp_matches(name, '(?i)^(19|20)\d{{2}}(\s*[-–—/to]+\s*((19|20)\d{{2}}\+?|present|now|\+))?$') then 'Milestone'
        when regexp_matches(name, '(?i)^[-+]?\$?\d[\d,.]*\s*(%|percent|kw|kv|mw|kg|tco2e?|tons?)?\+?$') then 'Metric' else 'Policy' end as type,
        trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) in ('', 'page', 'source', 'method', 'chunk', 'image') or len(string_split_regex(trim(name), '\s+')) >= 10 as junk from p""",
    "name_rules": """select c_custkey, c_name || ' of the _' || c_mktsegment as name, trim(regexp_replace(lower(c_name || ' of the ' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) as norm_key,
        regexp_replace(regexp_replace(lower(c_name || '  of the ' || c_mktsegment), '[^\\w\\s-]', '', 'g'), '[\\s_-]+', '-', 'g') as slug from customer""".replace("\\\\", "\\"),
    "node_ids": """with b as (select c_custkey, regexp_replace(lower(c_mktsegment), '[\\s_-]+', '-', 'g') as base from customer), r as (select *, row_number() over (partition by base order by c_custkey) as r from b)
        select c_custkey::varchar as key, case when r = 1 then base else base || '-' || r end as id from r""",
    # one row of each brand a step, with the ids that its earlier rows took
    "node_ids_clashing": """with recursive b as (select p_partkey, p_brand, replace(lower(p_brand), '#', '') || case p_partkey % 3 when 0 then '' when 1 then '-' || p_size else '-' || p_size % 4 || '-' || p_size % 3 end as base, row_number() over (partition by p_brand order by p_partkey) as step from part),
        w(p_brand, step, key, id, used) as (select p_brand, step, p_partkey, base, [base] from b where step = 1
        union all select p_brand, step, p_partkey, id, list_append(used, id) from (select b.p_brand, b.step, b.p_partkey, w.used,
        case when not list_contains(w.used, b.base) then b.base else b.base || '-' || list_min(list_filter(range(2, len(w.used) + 3), lambda k: not list_contains(w.used, b.base || '-' || k))) end as id from w join b on b.p_brand = w.p_brand and b.step = w.step + 1))
        select key::varchar as key, id from w""",
    "document_graph": f"{_GRAPH} select id, name, 'Concept' as type, mentions, coalesce(degree, 0)::bigint as degree from ent left join dg using (id) order by 2 * coalesce(degree, 0) + mentions desc, ord, id limit 12",
    "document_nodes": f"{_GRAPH} select id, name, 'Concept' as type, mentions, coalesce(degree, 0)::bigint as degree, sources, coalesce(nfs.facts, '') as facts from ent left join dg using (id) left join srcs using (id) left join nfs using (id)",
    "document_edges": f"{_GRAPH} select ord, source, 'precedes' as relation, target, count, array_to_string(fl[1:8], '|') as files from edg",
    "document_facts": f"{_GRAPH} select seq as ord, text, array_to_string(nodes, '|') as nodes, file from fn",
    "memory_index": f"""{_GRAPH}, nd as (select id, name, coalesce(l.facts, []) as facts from ent left join (select id, list(text order by r) as facts from (select *, row_number() over (partition by id order by seq, text) as r from nf) where r <= 12 group by id) l using (id))
        select 'node' as kind, id, name, 'Concept' as type, md5(concat_ws(' ', name || ' (Concept).', case when len(facts) > 0 then array_to_string(facts[1:5], ' ') end)) as text, null as nodes, array_to_string(facts[1:6], '|') as facts, null as file, 256 as dim from nd
        union all select 'fact', null, null, null, md5(text), array_to_string(nodes, '|'), null, printf('%012d.md', string_split(file, '/')[-1]::bigint), 256 from fn where text <> ''""",
    "linked_project": f"""{_G}, k as (select id from nodes order by score desc, ord, id limit 20), j as (select id from nodes order by score desc, ord, id limit 10), had as (select n1, n2, ord, text from facts where n1 in (select id from j) or n2 in (select id from j))
        select 'node' as kind, 'star:' || id as id from k where id not in (select id from j) union all
        select 'edge', concat_ws(' ', 'star:' || source, relation, 'star:' || target) from edges where source in (select id from k) and target in (select id from k) and not (source in (select id from j) and target in (select id from j)) union all
        select 'fact', t from (select text || ' ' || concat_ws(',', case when n1 in (select id from k) then 'star:' || n1 end, case when n2 in (select id from k) then 'star:' || n2 end) as t from facts where n1 in (select id from k) or n2 in (select id from k))
        where t not in (select text || ' ' || concat_ws(',', case when n1 in (select id from j) then 'star:' || n1 end, case when n2 in (select id from j) then 'star:' || n2 end) from had)""",
    "safe_script_json": r"""select page_id, md5(replace(replace(replace(replace(replace(to_json({'url': url, 'html': html})::varchar, '<', '\u003c'), '>', '\u003e'), '&', '\u0026'), chr(8232), '\u2028'), chr(8233), '\u2029')) as digest,
        case when page_id % 40 = 0 then 8192 when page_id % 40 <= 8 then 4096 when page_id % 40 <= 16 then 8192 else 16384 end as window from pages""".replace("\\\\", "\\"),
    "heading_chunks": r"""with recursive d as (select source || '/' || doc_id as file, list_concat([' '], list_transform(string_split(text, chr(10)), lambda x: '## ' || x)) as blocks from documents),
        b as (select file, unnest(blocks) as b, unnest(range(len(blocks))) as j from d),
        w as (select *, list_filter(string_split_regex(b, '\s+'), lambda y: y <> '') as w from b),
        q as (select file, j, unnest(case when len(w) <= 60 then [b] else list_transform(range(0, len(w), 60), lambda i: array_to_string(w[i + 1:i + 60], ' ')) end) as b, unnest(range(greatest((len(w) + 59) // 60, 1))) as i from w),
        p as (select file, b, len(list_filter(string_split_regex(b, '\s+'), lambda y: y <> '')) as w, row_number() over (partition by file order by j, i) - 1 as k from q),
        r as (select file, 0::bigint as k, null::varchar as buf, 0::bigint as n, []::varchar[] as out from d
          union all select file, k + 1, case when not huge then b2 end, case when huge then 0 else n1 + w end, case when huge then list_append(o1, regexp_replace(b2, '^\s+|\s+$', '', 'g')) else o1 end from (
            select *, n1 + w > 120 as huge, case when b1 is null then b else b1 || chr(10) || b end as b2 from (
              select *, case when f then list_append(out, regexp_replace(buf, '^\s+|\s+$', '', 'g')) else out end as o1, case when f then nullif(array_to_string(t, ' '), '') else buf end as b1, case when f then len(t) else n end as n1 from (
                select *, n + w > 60 and buf is not null as f, l[greatest(len(l) - 9, 1):] as t from (select r.*, p.b, p.w, list_filter(string_split_regex(coalesce(buf, ''), '\s+'), lambda y: y <> '') as l from r join p on p.file = r.file and p.k = r.k))))),
        e as (select file, case when buf is null then out else list_append(out, regexp_replace(buf, '^\s+|\s+$', '', 'g')) end as out from r join (select file, count(*) as c from p group by file) using (file) where k = c),
        c as (select file, unnest(out) as t, unnest(range(len(out))) as i from e), n as (select *, len(list_filter(string_split_regex(t, '\s+'), lambda y: y <> '')) as n from c)
        select file, (row_number() over (partition by file order by i) - 1)::int as chunk, md5(t) as digest, n::int as n from n where n >= 3""",
    "vector_topk": f"with {_VECTORS} select u.vec_id, round(list_dot_product(u.v, q.v), 3) as score from u, q where u.vec_id <> 7 order by list_dot_product(u.v, q.v) desc, u.vec_id limit 10",
    "vector_topk_per_project": f"{_search("where project = 'p3'")} select vec_id::varchar as id, rank, round(score, 3) as score from best where rank <= 8",
    "vector_search_all": f"{_search('')} select project, vec_id::varchar as id, rank, round(score, 3) as score from best where rank <= 8",
    "vector_search_cells": f"{_search('')} select project, vec_id::varchar as id, rank, round(score, 3) as score from best where rank <= 8",
    "title_pairs": """with t as (select list_sort(list_distinct(list_filter(string_split_regex(lower(substr(text, 1, 60)), '[^a-z]+'), lambda w: w <> ''))) as words, min(doc_id) as id from documents group by 1 having len(words) > 0),
        e as (select id, len(words) as n, unnest(words) as term from t), p as (select a.id as a, b.id as b, count(*)::double / sqrt(a.n::double * b.n::double) as sim from e a join e b on a.term = b.term and a.id < b.id group by a.id, b.id, a.n, b.n)
        select a, b, round(sim, 6) as sim from p where sim >= 0.6""",
    "vector_near_duplicates": f"{_PAIRS} select a, b, round(sim, 3) as sim from pairs where sim >= 0.3",
    "vector_components": f"""{_PAIRS}, l as (select a, b from pairs where sim >= 0.35 union all select b, a from pairs where sim >= 0.35),
        r as (select a as node, a as seen from l union select r.node, l.b from r join l on l.a = r.seen) select node, min(seen) as component from r group by node""",
    "fact_dedup": f"{_G}, f as (select regexp_replace(text, ' customer .*', '') as text, ord from facts) select max_by(text, ord) as text, max(ord) as ord from f group by lower(trim(text))",
    "version_keys": "select p_partkey, p_size::bigint as major, p_partkey % 10 as minor, 0::bigint as patch from part",
}
