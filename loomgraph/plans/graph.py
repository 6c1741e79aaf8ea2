"""Queries over the graph tables: links, aggregates, ranking, sets, walks, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import paths, text
from loomgraph.operators import aggregates, graph, links, ranking, resolution, search, sets, traversal
from loomgraph.plans.base import ANN, CALLABLE, CALLS, CE, CN, CONF, DISPATCH, EXT, FD, Registry, pages_levels, pages_sql

R = Registry()
add = R.add

# -- lookups and filters ------------------------------------------------------
add("nodes_current", lambda t: graph.current_nodes(t.nodes, "kind", "name", "file_path", "parent_id").select("id", "kind", "name", "file_path", "parent_id"), "select id, kind, name, file_path, parent_id from cn", CN)
add("edges_unique", lambda t: graph.unique_edges(t.edges), "select source, target, kind, metadata, line, col from ce", CE)
add("lookup_by_kind", lambda t: graph.current_nodes(t.nodes, "kind", "name").where(F.col("kind").isin("class", "interface")).select("id", "kind", "name"), "select id, kind, name from cn where kind in ('class', 'interface')", CN)
add("lookup_by_prefix", lambda t: graph.current_nodes(t.nodes, "name").where(F.col("id").startswith("services/")).select("id", "name"), "select id, name from cn where starts_with(id, 'services/')", CN)
add("lookup_children", lambda t: graph.current_nodes(t.nodes, "parent_id", "start_line").where("parent_id is not null").select("parent_id", "id", "start_line"), "select parent_id, id, start_line from cn where parent_id is not null", CN)
add("lookup_by_qualified_name", lambda t: graph.current_nodes(t.nodes, "qualified_name").groupBy("qualified_name").agg(F.count("*").alias("n_nodes"), F.min("id").alias("first_id")), "select qualified_name, count(*) as n_nodes, min(id) as first_id from cn group by qualified_name", CN)
add("filter_edge_kind_prefix", lambda t: t.edges.where(F.col("kind").startswith("aop_") | F.col("kind").startswith("proxy_")).select("source", "target", "kind", "seq"), "select source, target, kind, seq from edges where starts_with(kind, 'aop_') or starts_with(kind, 'proxy_')")
add("filter_file_glob", lambda t: t.files.where(paths.matches_glob("path", "src/*Service.?ava")).select("path").distinct(), "select distinct path from files where regexp_matches(path, '(?i)src/.*Service\\..ava')")
add("filter_language", lambda t: t.files.where(F.lower("language") == "kotlin").select("path", "language").distinct(), "select distinct path, language from files where lower(language) = 'kotlin'")
add("filter_like_all", lambda t: search.like_all(t.nodes, ["order", "service"]), "select id as node_id from cn where (lower(name) like '%order%' or lower(qualified_name) like '%order%' or lower(file_path) like '%order%') and (lower(name) like '%service%' or lower(qualified_name) like '%service%' or lower(file_path) like '%service%')", CN)
add("filter_module_patterns", lambda t: t.modules.where(paths.matches_name_patterns("id", ["order*", "*-core", "claim-desk"])).select("id"), "select id from modules where starts_with(id, 'order') or ends_with(id, '-core') or id = 'claim-desk'")
add("path_classes", lambda t: t.files.select("path").distinct().select("path", paths.path_class("path").alias("class")), "select path, case when regexp_matches(lower(path), 'test|spec|__test__') then 'test' when regexp_matches(lower(path), 'sample|example|demo') then 'sample' when regexp_matches(lower(path), 'generated|\\.pb\\.|mock') then 'generated' else 'production' end as class from (select distinct path from files)")
_GENERATED = paths.GENERATED_PATH.replace("'", "''")
add("path_relevance", lambda t: t.files.select("path").distinct().select("path", paths.path_relevance("path").alias("relevance")), f"select path, case when regexp_matches(p, '{_GENERATED}') then -2 when regexp_matches(path, '{paths.TEST_PATH}') then -1 when contains(p, 'src/') or contains(p, 'app/') or contains(p, 'components/') then 1 else 0 end as relevance from (select distinct path, replace(path, '\\', '/') as p from files)")
add("path_languages", lambda t: t.files.select("path").distinct().select(paths.language_of("path").alias("language")).groupBy("language").agg(F.count("*").alias("n_paths")), "select coalesce(l.language, 'unknown') as language, count(*) as n_paths from (select distinct path, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as e from files) p left join (values "
    + ", ".join(f"('{e}', '{language}')" for e, language in paths.LANGUAGES.items()) + ") l(e, language) on l.e = p.e group by 1")
add("unresolved_references", lambda t: resolution.unresolved(t.edges, t.nodes, t.external_symbols), "select distinct source, target, kind from edges where target is not null and not regexp_matches(target, '^(tx|cache|config|topic):') and target not in (select id from nodes where id is not null) and target not in (select id from external_symbols)")

# -- links --------------------------------------------------------------------
add("callers", lambda t: links.callers(t.edges, t.nodes), "select c.target as symbol, c.source as caller_id, n.name, n.kind, n.file_path from calls c join cn n on n.id = c.source", CN, CALLS)
add("callees", lambda t: links.callees(t.edges, t.nodes), "select c.source as symbol, c.target as callee_id, n.name, n.kind, n.file_path from calls c join cn n on n.id = c.target", CN, CALLS)
add("imports", lambda t: links.imports(t.edges, t.nodes), "select distinct e.source as symbol, e.target as imported_id, n.name, n.kind from edges e join cn n on n.id = e.target where e.kind = 'imports'", CN)
add("file_dependencies", lambda t: links.file_dependencies(t.edges, t.nodes), "select distinct a.file_path, b.file_path as depends_on from edges e join cn a on a.id = e.source join cn b on b.id = e.target where e.kind = 'imports' and a.file_path <> b.file_path", CN)
add("nodes_by_annotation", lambda t: links.nodes_by_annotation(t.edges, t.nodes), "select annotation_name, node_id, n.name, n.kind from ann join cn n on n.id = node_id", CN, ANN)
add("annotations_by_node", lambda t: links.annotations_by_node(t.edges), "select node_id, string_agg(annotation_name, ',' order by annotation_name) as names, count(*) as n_annotations from ann group by node_id", ANN)
add("external_references_by_symbol", lambda t: links.external_references_by_symbol(t.edges, t.external_symbols), "select symbol_name, source_location, reference_type, target_service from ext where external_symbol_id in (select id from external_symbols)", EXT)
add("external_references_by_location", lambda t: links.external_references_by_location(t.edges, t.external_symbols, t.modules.select(F.col("id").alias("term"))), "select m.id as term, count(*) as n_refs from ext join modules m on contains(source_location, m.id) group by m.id", EXT)
add("callers_with_external", lambda t: links.callers_with_external(t.edges, t.nodes, t.external_symbols), "select c.target as symbol, c.source as caller_id, 'internal' as provenance from calls c join cn n on n.id = c.source where not starts_with(c.target, 'ext://') union all select distinct external_symbol_id, source_location, 'external' from ext where target_service is not null and source_location is not null", CN, CALLS, EXT)
add("callees_with_external", lambda t: links.callees_with_external(t.edges, t.nodes, t.external_symbols), "select c.source as symbol, c.target as callee_id, 'internal' as provenance from calls c join cn n on n.id = c.target union all select distinct source_location, external_symbol_id, 'external' from ext where target_service is not null and source_location is not null", CN, CALLS, EXT)
_DISP = f"disp as (select source, target, kind, {CONF} as confidence from ce where kind in {DISPATCH})"
add("dispatch_targets", lambda t: links.dispatch_targets(t.edges, 0.7), "select source as symbol, target as other_id, kind, confidence, 'out' as direction from disp where confidence >= 0.7 union all select target, source, kind, confidence, 'in' from disp where confidence >= 0.7", CE, _DISP)
add("callers_with_dispatch", lambda t: links.callers_with_dispatch(t.edges, t.nodes), "select symbol, caller_id, 'static' as provenance, cast(1.0 as double) as confidence from st union all select d.source, s.caller_id, d.kind, max(d.confidence) from disp d join st s on s.symbol = d.target where d.confidence >= 0.5 group by d.source, s.caller_id, d.kind", CN, CE, CALLS, _DISP, "st as (select c.target as symbol, c.source as caller_id from calls c join cn n on n.id = c.source)")
add("parent_names", lambda t: links.parent_names(t.nodes), "select a.id, a.name, a.parent_id, b.name as parent_name from cn a left join cn b on b.id = a.parent_id", CN)
_IMPL = """impl as (select distinct i.id as interface_id, c.id as implementation_id from cn i join cn c on c.kind in ('class', 'enum') and i.kind = 'interface' and
  exists (select 1 from (values (c.name), (regexp_extract(coalesce(c.qualified_name, c.name), '[^.]*$'))) v(k) where k = i.name or k = i.name || 'Impl' or (regexp_matches(i.name, '^I[A-Z]') and (k = substr(i.name, 2) or k = substr(i.name, 2) || 'Impl'))))"""
add("implementations_by_name", lambda t: links.implementations_by_name(t.nodes), "select * from impl", CN, _IMPL)
add("implementations", lambda t: links.implementations(t.edges, t.nodes), "select target as interface_id, source as implementation_id from edges where kind in ('implements', 'conditional_impl') and source in (select id from cn) union select * from impl", CN, _IMPL)
add("concrete_classes", lambda t: links.concrete_classes(t.nodes), "select i.interface_id, i.implementation_id as class_id from impl i join cn a on a.id = i.interface_id join cn b on b.id = i.implementation_id where a.module_id <> '' and a.module_id = b.module_id", CN, _IMPL)
_OVER = f"""over_ as (select m.id as method_id, min(o.id) as overrides_id from cn m join (select distinct source, target from edges where kind in ('implements', 'extends')) e on e.source = m.parent_id
  join cn o on o.parent_id = e.target and o.name = m.name where m.kind in {CALLABLE} and o.kind in {CALLABLE} group by m.id)"""
add("override_pairs", lambda t: links.override_pairs(t.edges, t.nodes), "select * from over_", CN, _OVER)
add("interface_callers", lambda t: links.interface_callers(t.edges, t.nodes), "select distinct p.method_id, c.source as caller_id from (select source as method_id, target as overrides_id from edges where kind = 'overrides' union select * from over_) p join calls c on c.target = p.overrides_id join cn n on n.id = c.source", CN, CALLS, _OVER)
add("callback_targets", lambda t: links.callback_targets(t.edges, t.nodes), "select a.source as symbol, b.target as target_id from calls a join calls b on b.source = a.target join cn n on n.id = b.target where n.kind in ('variable', 'parameter') union select c.source, c.target from calls c join cn n on n.id = c.target where n.name in ('then', 'catch', 'finally', 'subscribe', 'map', 'forEach', 'filter', 'reduce')", CN, CALLS)
_XMOD = "xmod as (select c.source, c.target, a.module_id as ma, b.module_id as mb from calls c join cn a on a.id = c.source join cn b on b.id = c.target where a.module_id <> '' and b.module_id <> '' and a.module_id <> b.module_id)"
add("cross_service_callees", lambda t: links.cross_service_callees(t.edges, t.nodes), "select source as symbol, mb as target_module, count(*) as n_calls from xmod group by source, mb", CN, CALLS, _XMOD)
add("cross_module_references", lambda t: links.cross_module_references(t.edges, t.nodes), "select source as symbol, target as other_id, 'callee' as relation from xmod union all select target, source, 'caller' from xmod union all select a.id, b.id, 'same_name' from cn a join cn b on a.name = b.name and a.module_id <> b.module_id where a.kind in ('class', 'interface') and b.kind in ('class', 'interface') and a.module_id <> '' and b.module_id <> ''", CN, CALLS, _XMOD)
add("dead_code", lambda t: links.dead_code(t.edges, t.nodes), "select id, kind, name, file_path from cn where kind not in ('class', 'interface', 'enum') and id not in (select target from edges where kind = 'calls' and target is not null)", CN)
add("dead_imports", lambda t: links.dead_imports(t.edges, t.nodes), "select distinct a.file_path, b.id as imported_id, b.name from edges e join cn a on a.id = e.source join cn b on b.id = e.target where e.kind = 'imports' and not exists (select 1 from edges u join cn ua on ua.id = u.source join cn ub on ub.id = u.target where u.kind in ('calls', 'references', 'instantiates', 'extends', 'implements', 'type_of', 'returns') and ua.file_path = a.file_path and ub.name = b.name)", CN)
_TEST = "regexp_matches(file_path, '(?i)(test|spec|__tests__|__test__)')"
add("affected_tests", lambda t: links.affected_tests(t.edges, t.nodes, t.file_changes.where("op = 'modified'")), f"""select test_file, count(*) as n_matched, round(least(count(*) / greatest((select count(*) from names), 1), 1.0), 6) as confidence from (
  select file_path as test_file, name from cn where {_TEST} and kind <> 'file' and name <> '' union select a.file_path, b.name from calls c join cn a on a.id = c.source join cn b on b.id = c.target where regexp_matches(a.file_path, '(?i)(test|spec|__tests__|__test__)') and a.name <> '' and b.name <> '') x
  where name in (select name from names) group by test_file""", CN, CALLS, f"names as (select distinct name from cn where name <> '' and kind <> 'file' and not {_TEST} and file_path in (select path from file_changes where op = 'modified'))")
add("bean_injections", lambda t: links.bean_injections(t.edges, t.nodes), "select member_id, bean_id from (select m.id as member_id, c.id as bean_id, row_number() over (partition by m.id order by c.id) as r from (select distinct node_id from ann where annotation_name in ('Autowired', 'Inject', 'Resource')) a join cn m on m.id = a.node_id join cn c on c.kind = 'class' and (c.name = upper(substr(m.name, 1, 1)) || substr(m.name, 2) or c.name = upper(substr(m.name, 1, 1)) || substr(m.name, 2) || 'Impl')) where r <= 5", CN, ANN)
add("shared_keys", lambda t: links.shared_config(t.edges), "select target as key, count(distinct source) as n_users from edges where regexp_matches(target, '^(config|cache|tx|topic):') group by target")
add("config_by_prefix", lambda t: links.config_by_prefix(t.edges), "select array_to_string(list_slice(p, 1, i), '.') as prefix, key, count(*) as n_users from (select source, key, string_split(key, '.') as p, unnest(range(1, len(string_split(key, '.')) + 1)) as i from (select distinct source, substr(target, 8) as key from edges where starts_with(target, 'config:'))) group by 1, 2")
add("service_locations", lambda t: links.service_locations(t.edges, t.modules), """select l.location, coalesce((select min(m.id) from modules m where m.root_path = array_to_string(list_slice(string_split(l.p, '/'), 1, 2), '/')), (select arg_min(m.id, list_position(string_split(replace(l.p, ':', '/'), '/'), m.id)) from modules m where list_contains(string_split(replace(l.p, ':', '/'), '/'), m.id))) as service
  from (select distinct source as location, replace(source, '\\', '/') as p from edges where source is not null) l""")
add("provider_matches", lambda t: links.provider_matches(t.edges, t.external_symbols).where("how = 'exact'").select("consumer_ref", "provider_id"), "select distinct target as consumer_ref, target as provider_id from edges where target in (select id from external_symbols)")
add("transaction_propagation", lambda t: links.transaction_propagation(t.edges, t.nodes), "select distinct c.source as caller_id, c.target as callee_id, a.target as outer_key, b.target as inner_key from calls c join edges a on a.source = c.source and starts_with(a.target, 'tx:') join edges b on b.source = c.target and starts_with(b.target, 'tx:') where a.target <> b.target", CALLS)
add("cache_related", lambda t: links.cache_related(t.edges), "select target as cache, count(distinct source) as n_nodes, count(distinct source) * (count(distinct source) - 1) // 2 as n_pairs from edges where starts_with(target, 'cache:') group by target")
add("pointcut_matches", lambda t: links.pointcut_matches(t.nodes, ["execution(* *Service.save*(..))", "within(*Repository)"]), f"""select 'execution(* *Service.save*(..))' as pointcut, id as method_id from cn where kind in {CALLABLE} and regexp_matches(regexp_replace(regexp_replace(qualified_name, '\\(.*$', ''), '\\.[^.]*$', ''), '^[^.]*Service$') and regexp_matches(name, '^save[^.]*$')
  union all select 'within(*Repository)', id from cn where kind in {CALLABLE} and regexp_matches(regexp_replace(regexp_replace(qualified_name, '\\(.*$', ''), '\\.[^.]*$', ''), '^[^.]*Repository$')""", CN)

# -- aggregates ---------------------------------------------------------------
add("table_counts", lambda t: aggregates.table_counts(files=t.files, nodes=t.nodes, edges=t.edges, modules=t.modules), "select 'files' as name, count(*) as n_rows from files union all select 'nodes', count(*) from nodes union all select 'edges', count(*) from edges union all select 'modules', count(*) from modules")
add("kind_breakdown", lambda t: aggregates.kind_breakdown(t.nodes), "select kind, count(*) as n_nodes, array_to_string(list_sort(list(distinct language)), ',') as languages from cn group by kind", CN)
add("module_stats", lambda t: aggregates.module_stats(t.modules, t.files, t.nodes), "select m.id as module_id, (select count(distinct path) from files f where f.module_id = m.id) as n_files, (select count(*) from cn where cn.module_id = m.id) as n_nodes from modules m", CN)
add("service_counts", lambda t: aggregates.service_counts(t.edges, t.external_symbols), "select coalesce(p.s, u.s) as service, coalesce(p.n, 0) as n_provided, coalesce(u.n, 0) as n_referenced from (select providing_service as s, count(*) as n from external_symbols group by 1) p full join (select target_service as s, count(*) as n from ext where target_service is not null group by 1) u on u.s = p.s", EXT)
add("hot_spots", lambda t: aggregates.hot_spots(t.edges), "select target as symbol, count(*) as n_callers from calls group by target order by n_callers desc, symbol limit 20", CALLS)
for _prefix, _name in (("cache:", "cache_topology"), ("topic:", "topic_usage"), ("tx:", "transaction_usage"), ("config:", "config_usage")):
    add(_name, lambda t, p=_prefix: aggregates.topic_usage(t.edges, t.nodes, p), f"select substr(u.target, {len(_prefix) + 1}) as key, count(*) as n_uses, coalesce(array_to_string(list_sort(list(distinct n.module_id) filter (n.module_id is not null)), ','), '') as modules from (select distinct source, target from edges where starts_with(target, '{_prefix}')) u left join cn n on n.id = u.source group by u.target", CN)
_SG = "sg as (select distinct e.source, e.target, e.kind, a.module_id as ma, b.module_id as mb from edges e join cn a on a.id = e.source join cn b on b.id = e.target where e.kind in ('calls', 'imports', 'references', 'instantiates') and a.module_id <> '' and b.module_id <> '' and a.module_id <> b.module_id)"
add("service_graph", lambda t: aggregates.service_graph(t.edges, t.nodes), "select ma as from_module, mb as to_module, count(*) as n_relations, array_to_string(list_sort(list(distinct kind)), ',') as kinds from sg group by ma, mb", CN, _SG)
add("provider_graph", lambda t: aggregates.provider_graph(t.edges, t.nodes, t.external_symbols), "select n.module_id as consumer, x.target_service as provider, count(*) as n_refs, array_to_string(list_sort(list(distinct x.reference_type)), ',') as types from ext x join cn n on n.id = x.source_location where n.module_id <> '' and x.target_service is not null group by 1, 2", CN, EXT)
add("architecture", lambda t: aggregates.architecture(t.modules, t.nodes, t.edges), "select m.id as module_id, (select count(*) from cn where cn.module_id = m.id and cn.id in (select node_id from ann where annotation_name = 'Component')) as n_entry_points, coalesce((select array_to_string(list_sort(list(distinct mb)), ',') from sg where ma = m.id), '') as depends_on from modules m", CN, ANN, _SG)
add("symbols_by_file", lambda t: aggregates.symbols_by_file(t.nodes), f"select file_path, count(*) as n_symbols, count(*) filter (kind in {CALLABLE}) as n_callables, min(name) as first_name from cn group by file_path", CN)
add("dominant_file", lambda t: aggregates.dominant_file(t.nodes), "select module_id, file_path, n_symbols from (select module_id, file_path, count(*) as n_symbols, row_number() over (partition by module_id order by count(*) desc, file_path) as r from cn where file_path is not null group by module_id, file_path) where r = 1", CN)
add("conflicting_names", lambda t: aggregates.conflicting_names(t.nodes), "select qualified_name, cast(count(distinct kind) as integer) as n_kinds, array_to_string(list_sort(list(distinct kind)), ',') as kinds from cn group by qualified_name having count(distinct kind) > 1", CN)
add("first_bindings", lambda t: aggregates.first_binding(t.edges), "select source, arg_min(target, seq) as target from edges where starts_with(target, 'config:') and source is not null group by source")
add("average_confidence", lambda t: aggregates.average_confidence(t.edges), f"select kind, count(*) as n_edges, round(avg({CONF}), 6) as avg_confidence from edges group by kind")
_FX = "fx as (select path, string_split(arg_max(content, (indexed_at, content_hash, content)), chr(10)) as lines from files where content is not null group by path)"
_CX = "cx as (select id, name, cast(1 + " + " + ".join(f"len(regexp_extract_all(body, '{p}'))" for p in aggregates.BRANCHES) + f""" as integer) as complexity from (select n.id, n.name, array_to_string(list_slice(lines, start_line, end_line), chr(10)) as body from cn n join fx on fx.path = n.file_path
  where kind in {CALLABLE} and start_line > 0 and end_line >= start_line and len(lines) >= start_line))"""
add("complexity", lambda t: aggregates.complexity(t.nodes, t.files), "select * from cx", CN, _FX, _CX)
add("complexity_top", lambda t: aggregates.complexity(t.nodes, t.files).orderBy(F.desc("complexity"), "id").limit(20), "select * from cx order by complexity desc, id limit 20", CN, _FX, _CX)
add("similar_code", lambda t: aggregates.similar_code(t.nodes, t.nodes.where("seq % 50 = 0").select("id")), r"""select id, other_id, n_equal, round(s, 2) as similarity from (select *, row_number() over (partition by id order by s desc, other_id) as r from (
  select q.id, c.rep as other_id, c.n_equal, len(list_intersect(q.tokens, c.tokens)) / (len(q.tokens) + len(c.tokens) - len(list_intersect(q.tokens, c.tokens)))::double as s from tk q join cl c on c.kind = q.kind and c.tokens <> q.tokens where q.id in (select id from nodes where seq % 50 = 0)) where s >= 0.5) where r <= 10""",
    CN, f"tk as (select id, kind, tokens from (select id, kind, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', name, signature, docstring)), '[\\s,();{{}}\\[\\]<>]+'), lambda w: length(w) > 1))) as tokens from cn where kind in {CALLABLE}) where len(tokens) > 0)", "cl as (select kind, tokens, min(id) as rep, count(*) as n_equal from tk group by kind, tokens)")
add("condition_activity", lambda t: aggregates.condition_activity(t.edges), "select r.source, count(*) as n_conditions, bool_and(r.target in (select target from edges where kind = 'overrides')) as all_met from (select distinct source, target from edges where starts_with(target, 'config:') and kind = 'references') r group by r.source")
add("provenance_histogram", lambda t: aggregates.provenance_histogram(t.edges, 0.8), f"select kind, count(*) as n_edges, count(*) filter ({CONF} < 0.8) as n_filtered from ce where kind in ('dispatch_call', 'proxy_wraps', 'aop_advises') group by kind", CE)

# -- ranking ------------------------------------------------------------------
add("page_of_files", lambda t: ranking.page(t.files.select("path").distinct(), ["path"], 25, 10), "select path, (select count(distinct path) from files) as total, 35 < (select count(distinct path) from files) as truncated from (select distinct path from files) order by path limit 25 offset 10")
add("largest_files_per_module", lambda t: ranking.top_per_group(sets.upsert_files(t.files).select("module_id", "path", "size"), ["module_id"], [F.desc("size"), "path"], 3), "select module_id, path, size from (select *, row_number() over (partition by module_id order by size desc nulls last, path) as r from uf) where r <= 3", "uf as (select path, arg_min(coalesce(module_id, ''), (indexed_at, content_hash)) as module_id, arg_max(size, (indexed_at, content_hash, size)) as size from files where path is not null group by path)")
add("non_production_cap", lambda t: ranking.non_production_cap(t.files.select("module_id", "path").distinct(), ["module_id"], "path", ["path"], 3), """select module_id, path from (select module_id, path, o, sum(o) over (partition by module_id order by path) as n from (select distinct module_id, path, cast(regexp_matches(lower(path), 'test|spec|__test__|sample|example|demo|generated|\\.pb\\.|mock') as integer) as o from files)) where o = 0 or n <= 3""")
add("files_by_relevance", lambda t: ranking.top_per_group(t.files.select("language", "path").distinct().withColumn("relevance", paths.path_relevance("path")), ["language"], [F.desc("relevance"), "path"], 5), f"select language, path, relevance from (select *, row_number() over (partition by language order by relevance desc, path) as r from (select distinct language, path, case when regexp_matches(replace(path, '\\', '/'), '{_GENERATED}') then -2 when regexp_matches(path, '{paths.TEST_PATH}') then -1 when contains(replace(path, '\\', '/'), 'src/') or contains(replace(path, '\\', '/'), 'app/') or contains(replace(path, '\\', '/'), 'components/') then 1 else 0 end as relevance from files)) where r <= 5")
add("budget_tiers", lambda t: t.files.groupBy("module_id").agg(F.countDistinct("path").alias("n_files")).select("module_id", "n_files", ranking.budget_column("n_files").alias("budget")), "select module_id, n as n_files, case when n < 150 then 30 when n < 500 then 40 when n < 5000 then 50 when n < 15000 then 60 else 70 end as budget from (select module_id, count(distinct path) as n from files group by module_id)")

# -- sets and writes ----------------------------------------------------------
add("files_upserted", lambda t: sets.upsert_files(t.files).select("path", "size", "node_count", "language"), "select path, arg_max(size, (indexed_at, content_hash, size)) as size, arg_max(node_count, (indexed_at, content_hash, size)) as node_count, arg_min(language, (indexed_at, content_hash)) as language from files where path is not null group by path")
add("nodes_after_delete", lambda t: sets.delete_files(t.nodes, t.edges, t.file_changes.where("op = 'deleted'"))[0].select("id", "seq"), "select id, seq from nodes where file_path is null or file_path not in (select path from file_changes where op = 'deleted' and path is not null)")
add("edges_after_delete", lambda t: sets.delete_files(t.nodes, t.edges, t.file_changes.where("op = 'deleted'"))[1].select("source", "target", "kind", "seq"), "select source, target, kind, seq from edges where (source is null or source not in (select id from gone)) and (target is null or target not in (select id from gone))", "gone as (select id from nodes where id is not null and file_path in (select path from file_changes where op = 'deleted'))")
add("file_versions_changed", lambda t: sets.changes(sets.first_wins(t.files.where("path is not null").select("path", "content_hash", "size", "indexed_at"), ["path"], "indexed_at"), sets.last_wins(t.files.where("path is not null").select("path", "content_hash", "size", "indexed_at"), ["path"], "indexed_at"), ["path"], ["content_hash", "size"]), "select path, 'modified' as change from (select path, arg_min({'h': content_hash, 's': size}, (indexed_at, content_hash, size)) as a, arg_max({'h': content_hash, 's': size}, (indexed_at, content_hash, size)) as b from files where path is not null group by path) where a <> b")
add("unchanged_skip", lambda t: sets.unchanged_files(sets.first_wins(t.files.where("path is not null").select("path", "size", "modified_at", "indexed_at"), ["path"], "indexed_at"), t.files.select("path", "size", "modified_at").distinct()), "select distinct path, size, modified_at from files f where not exists (select 1 from (select path, arg_min({'s': size, 'm': modified_at}, (indexed_at, size, modified_at)) as k from files where path is not null group by path) o where o.path = f.path and o.k.s = f.size and o.k.m = f.modified_at)")
add("union_best_rank", lambda t: sets.union_best([t.nodes.select("id", F.lit(1).alias("rank"), F.lit("node").alias("origin")).where("id is not null").distinct(), t.edges.select(F.col("target").alias("id"), F.lit(2).alias("rank"), F.lit("target").alias("origin")).where("id is not null").distinct()], ["id"], "rank"), "select id, max(rank) as rank, arg_max(origin, rank) as origin from (select distinct id, 1 as rank, 'node' as origin from nodes where id is not null union all select distinct target, 2, 'target' from edges where target is not null) group by id")
add("export_dot", lambda t: sets.export_dot(t.edges, 200), "select 'digraph G {' || chr(10) || string_agg('  \"' || replace(source, '\"', '''') || '\" -> \"' || replace(target, '\"', '''') || '\" [label=\"' || kind || '\"];', chr(10) order by source, target, kind) || chr(10) || '}' as dot from (select distinct source, target, kind from edges order by source, target, kind limit 200)")

# -- walks --------------------------------------------------------------------
_STEPS = """steps as (select source, target from (select target as source, source as target from edges where kind in ('calls', 'references', 'instantiates') union select parent_id, id from cn where parent_id is not null
  union select target, source from edges where kind in ('implements', 'overrides', 'extends')) where source in (select id from cn) and target in (select id from cn))"""


def _reach(seeds: str, steps: str, depth: int) -> str:
    """Breadth first in SQL: one level per common table expression."""
    parts = [f"l0 as (select distinct id from ({seeds}) where id is not null)"]
    for level in range(1, depth + 1):
        seen = " union ".join(f"select id from l{i}" for i in range(level))
        parts.append(f"l{level} as (select distinct s.target as id from {steps} s join l{level - 1} l on l.id = s.source where s.target is not null and s.target not in ({seen}))")
    return ", ".join(parts)


def _levels(depth: int, first: int = 0) -> str:
    return " union all ".join(f"select id, {i} as depth from l{i}" for i in range(first, depth + 1))


def _walk(seeds: str, steps: str) -> str:
    """The same without a number of levels: one row per level with its ids and all before, until a level is empty."""
    return f"""levels as (select 0 as depth, list(distinct id) as ids, list(distinct id) as seen from ({seeds}) where id is not null
  union all select depth + 1, found, seen || found from (select l.depth, l.seen, (select list(distinct s.target) from {steps} s where s.source in (select unnest(l.ids)) and s.target not in (select unnest(l.seen))) as found from levels l) where len(found) > 0),
  walk as (select unnest(ids) as id, depth from levels)"""


_CHANGED = "select n.id from cn n where n.file_path in (select path from file_changes where op = 'modified')"
add("impact", lambda t: traversal.impact(t.edges, t.nodes, _changed(t), 3), _levels(3, 1), CN, _STEPS, _reach(_CHANGED, "steps", 3))


def _changed(t):
    changed = t.file_changes.where("op = 'modified'").select(F.col("path").alias("file_path")).distinct()
    return graph.current_nodes(t.nodes, "file_path").join(changed, "file_path", "left_semi").select("id")


_ENTRY = "entry as (select n.id from cn n left join (select distinct node_id from ann where annotation_name in ('GetMapping', 'PostMapping', 'PutMapping', 'DeleteMapping', 'PatchMapping', 'RequestMapping', 'RabbitListener', 'KafkaListener', 'JmsListener', 'Scheduled', 'SchedulingConfigurer', 'VueRoute', 'Route', 'Component')) a on a.node_id = n.id where a.node_id is not null or n.kind = 'entry_point' or (n.name = 'main' and regexp_matches(n.file_path, '[.](java|kt)$')))"
add("entry_points", lambda t: traversal.entry_points(t.edges, t.nodes).select("id"), "select id from entry", CN, ANN, _ENTRY)
add("backtrace_distance", lambda t: traversal.distance_from_entry(t.edges, t.nodes), "select id, depth from walk", CN, ANN, _ENTRY, "fwd as (select distinct source, target from edges where kind in ('calls', 'contains') and source is not null and target in (select id from cn))", _walk("select id from entry", "fwd"))
add("dispatch_chain", lambda t: traversal.dispatch_chain(t.edges, graph.current_nodes(t.nodes, "kind").where("kind = 'interface'"), 3), _levels(3), CN, f"both_ as (select source, target from edges where kind in {DISPATCH} and source is not null and target is not null union select target, source from edges where kind in {DISPATCH} and source is not null and target is not null)", _reach("select id from cn where kind = 'interface'", "both_", 3))
_MS = "ms as (select distinct a.module_id as source, b.module_id as target from edges e join cn a on a.id = e.source join cn b on b.id = e.target where e.kind = 'imports' and a.module_id <> '' and b.module_id <> '' and a.module_id <> b.module_id)"
add("module_paths", lambda t: traversal.simple_paths(traversal.module_steps(t.edges, t.nodes, "imports"), t.modules, None, 3).select(F.array_join("path", ">").alias("path"), "length"), "select array_to_string(path, '>') as path, cast(len(path) - 1 as integer) as length from p where len(path) > 1", CN, _MS, "p as (select id as at_, [id] as path from modules union all select ms.target, list_append(p.path, ms.target) from p join ms on ms.source = p.at_ where not list_contains(p.path, ms.target) and len(p.path) <= 3)")
_CYC = "select array_to_string(path, '>') as path, cast(len(path) as integer) as length from p join {s} s on s.source = p.at_ and s.target = p.path[1] where len(path) > 1"
_CYCP = "p as (select source as at_, [source] as path from (select distinct source from {s}) union all select s.target, list_append(p.path, s.target) from p join {s} s on s.source = p.at_ where s.target > p.path[1] and not list_contains(p.path, s.target) and len(p.path) < {n})"
add("module_cycles", lambda t: traversal.cycles(traversal.module_steps(t.edges, t.nodes, "imports"), 3).select(F.array_join("path", ">").alias("path"), "length"), _CYC.format(s="ms"), CN, _MS, _CYCP.format(s="ms", n=3))
add("import_cycles", lambda t: traversal.cycles(links.file_dependencies(t.edges, t.nodes).select(F.col("file_path").alias("source"), F.col("depends_on").alias("target")), 4).select(F.array_join("path", ">").alias("path"), "length"), _CYC.format(s="fd"), CN, FD, _CYCP.format(s="fd", n=4))
# Cycles and paths above are listed up to the length that stands there; components hold the cycles of every length.
_REACHED = "reached as (select source, target from {s} union select r.source, s.target from reached r join {s} s on s.source = r.target)"
_TOGETHER = "select component, id, size from (select a.source as id, max(a.target) as component, count(*) as size from reached a join reached b on b.source = a.target and b.target = a.source group by a.source) where size > 1"
add("module_components", lambda t: traversal.components(traversal.module_steps(t.edges, t.nodes, "imports")), _TOGETHER, CN, _MS, _REACHED.format(s="ms"))
add("import_components", lambda t: traversal.components(links.file_dependencies(t.edges, t.nodes).select(F.col("file_path").alias("source"), F.col("depends_on").alias("target"))), _TOGETHER, CN, FD, _REACHED.format(s="fd"))
add("page_fanout", lambda t: traversal.page_fanout(t.edges, t.nodes, t.files.where(F.col("path").endswith(".vue"))).groupBy("seed", "depth").agg(F.count("*").alias("n_files")), f"select seed, depth, count(*) as n_files from ({pages_levels(4)}) group by seed, depth", CN, FD, pages_sql(4))
add("transitive_callers", lambda t: traversal.transitive_callers(t.edges, t.nodes))
add("related_symbols", lambda t: traversal.related_symbols(t.edges, t.nodes).groupBy("symbol", "relation").agg(F.count("*").alias("n_others")), "select symbol, relation, count(*) as n_others from (select source as symbol, 'callee' as relation, target as o from calls where target in (select id from cn) union all select target, 'caller', source from calls where source in (select id from cn) union all select parent_id, 'child', id from cn where parent_id is not null union all select id, 'parent', parent_id from cn where parent_id in (select id from cn) union all select distinct target, 'implementation', source from edges where kind = 'implements') group by 1, 2", CN, CALLS)
add("expand_graph", lambda t: traversal.expand(t.edges, t.nodes, _changed(t), 5), "select seed, id from (select seed, id, row_number() over (partition by seed order by id) as r from (select source as seed, target as id from calls where target in (select id from cn) union select target, source from calls where source in (select id from cn)) where seed in (select n.id from cn n where n.file_path in (select path from file_changes where op = 'modified'))) where r <= 5", CN, CALLS)
add("type_expansion", lambda t: traversal.type_expansion(t.edges, t.nodes), "select distinct e.source as symbol, e.target as type_id from edges e where e.kind in ('extends', 'implements', 'calls', 'instantiates') and e.source in (select id from cn where kind in ('class', 'interface')) and e.target in (select id from cn where kind in ('class', 'interface'))", CN)
add("recover_edges", lambda t: traversal.recover_edges(t.edges, _changed(t)), f"select id, count(*) as n_edges from (select target as id from (select distinct source, target from edges) where source in (select id from sel) and (target is null or target not in (select id from sel)) union all select source from (select distinct source, target from edges) where target in (select id from sel) and (source is null or source not in (select id from sel))) group by id", CN, f"sel as ({_CHANGED})")

# -- resolution ---------------------------------------------------------------
add("resolve_calls", lambda t: resolution.resolve_by_name(t.edges, t.nodes, t.external_symbols), f"""select source, target, coalesce(rf, ro, rm, ra) as resolved_id, case when rf is not null then 'named_file' when ro is not null then 'same_file' when rm is not null then 'same_module' else 'name' end as how from (
  select u.source, u.target, (select min(id) from cand c where c.name = u.name and c.file_path = u.file) as rf, (select min(id) from cand c where c.name = u.name and c.file_path = s.file_path) as ro,
    (select min(id) from cand c where c.name = u.name and c.module_id = s.module_id) as rm, (select min(id) from cand c where c.name = u.name) as ra
  from (select distinct source, target, regexp_extract(target, '([^:./]+)(?::\\d+)?$', 1) as name, nullif(regexp_extract(target, '^(.+?):[^:]+(?::\\d+)?$', 1), '') as file from edges where kind = 'calls' and target is not null and not regexp_matches(target, '^(tx|cache|config|topic):')
    and target not in (select id from nodes where id is not null) and target not in (select id from external_symbols)) u left join cn s on s.id = u.source) where coalesce(rf, ro, rm, ra) is not null""", CN, f"cand as (select * from cn where kind in {CALLABLE})")
add("promoted_kinds", lambda t: resolution.promoted_edges(t.edges, t.nodes), f"select e.kind, case when e.kind = 'calls' and n.kind in ('class', 'enum', 'component') then 'instantiates' when e.kind = 'instantiates' and n.kind in {CALLABLE} then 'calls' when e.kind = 'extends' and n.kind = 'interface' then 'implements' else e.kind end as promoted, count(*) as n_edges from (select distinct source, target, kind from edges) e join cn n on n.id = e.target group by 1, 2", CN)
add("match_references", lambda t: resolution.match_references(t.edges.select(F.get_json_object("metadata", "$.name").alias("ref")).where("ref is not null"), t.nodes), """select ref, id, confidence, case when contains(q, ref) then 'qualified_name_contains' when name = ref then 'exact_name' when ends_with(q, '.' || ref) then 'qualified_suffix' else 'weak' end as strategy from (
  select *, row_number() over (partition by ref order by confidence desc, id) as r from (select *, cast(case when contains(q, ref) then greatest(0.5, base) else base end as double) as confidence from (
    select r.ref, n.id, n.name, n.q, case when n.name = r.ref and n.q = r.ref then 0.9 when n.name = r.ref then 0.7 when ends_with(n.q, '.' || r.ref) then 0.6 else 0.3 end as base
    from (select distinct json_extract_string(metadata, '$.name') as ref from edges) r join (select id, name, coalesce(qualified_name, name) as q from cn) n on n.name = r.ref or (r.ref <> '' and contains(n.q, r.ref)))) where confidence >= 0.5) where r <= 10""", CN)
add("names_in_other_modules", lambda t: resolution.names_in_other_modules(t.nodes), "select name, count(distinct module_id) as n_modules, count(*) as n_symbols from cn where kind in ('class', 'interface') and module_id <> '' group by name having count(distinct module_id) > 1", CN)
_FC = "fc as (select path, regexp_replace(arg_max(content, (indexed_at, content_hash)), chr(13), '', 'g') as content from files where content is not null and path is not null group by path)"
_IM = "im as (select distinct path, unnest(regexp_extract_all(content, '(?m)^import (?:static )?([\\w.]+);?$', 1) || regexp_extract_all(content, '(?m)^import [^''\"\\n]* from [''\"]([^''\"\\n]+)[''\"]', 1) || regexp_extract_all(content, '(?m)^from ([\\w.]+) import \\w+', 1)) as imported from fc)"
add("imports_in_files", lambda t: resolution.imports_in(t.files), "select path, imported from im", _FC, _IM)
add("resolved_import_paths", lambda t: resolution.resolve_import_paths(resolution.imports_in(t.files), t.files))
add("event_pairs", lambda t: resolution.event_pairs(t.edges), "select substr(target, 7) as topic, count(*) filter (kind = 'dispatch_call') as n_publishers, count(*) filter (kind <> 'dispatch_call') as n_subscribers from (select distinct source, target, kind from edges where starts_with(target, 'topic:')) group by target")
add("injected_members", lambda t: resolution.injected(t.edges), "select node_id, annotation_name from ann where annotation_name in ('Autowired', 'Inject', 'Resource')", ANN)

# -- text and search ----------------------------------------------------------
add("camel_words", lambda t: graph.current_nodes(t.nodes, "name").select("id", F.array_join(text.split_camel("name"), " ").alias("words")), "select id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), ' ') as words from cn", CN)
add("content_hashes", lambda t: t.files.where("content is not null").select("path", text.content_hash("content").alias("hash")).distinct(), "select distinct path, md5(content) as hash from files where content is not null")
add("json_fields", lambda t: t.edges.where("metadata is not null").groupBy(text.json_field("metadata", "type", "none").alias("type")).agg(F.count("*").alias("n_edges")), "select coalesce(json_extract_string(metadata, '$.type'), 'none') as type, count(*) as n_edges from edges where metadata is not null group by 1")
add("masked_values", lambda t: links.shared_config(t.edges).select("key", text.masked("key", "key").alias("shown")), "select distinct target as key, case when regexp_matches(target, '(?i)(password|passwd|secret|token|api[-_.]?key|access[-_.]?key|private[-_.]?key|credential)') then '***' else target end as shown from edges where regexp_matches(target, '^(config|cache|tx|topic):')")
add("implementation_names", lambda t: graph.current_nodes(t.nodes, "kind", "name").where("kind = 'interface'").select("id", text.implementation_name("name").alias("implementation")), "select id, case when regexp_matches(name, '^I[A-Z]') then substr(name, 2) else name || 'Impl' end as implementation from cn where kind = 'interface'", CN)
add("accessor_names", lambda t: graph.current_nodes(t.nodes, "kind", "name").where("kind = 'field'").select("id", text.getter_name("name").alias("getter"), text.setter_name("name").alias("setter")), "select id, 'get' || upper(substr(name, 1, 1)) || substr(name, 2) as getter, 'set' || upper(substr(name, 1, 1)) || substr(name, 2) as setter from cn where kind = 'field'", CN)
add("diagram_ids", lambda t: t.modules.select("id", text.diagram_id("id").alias("diagram_id")), "select id, regexp_replace(regexp_replace(id, '[^A-Za-z0-9]', '_', 'g'), '^([0-9])', 'n_\\1') as diagram_id from modules")
add("data_sources", lambda t: graph.current_nodes(t.nodes, "kind", "name").where("kind in ('method', 'function')").groupBy(traversal.data_source("name").alias("origin")).agg(F.count("*").alias("n_methods")), "select case when regexp_matches(name, '^(getParameter|getHeader|getAttribute|getCookies|getQueryString|getInputStream|getReader|getBody)$') then 'http_request' when regexp_matches(name, '^(getProperty|getenv|getEnv)$') then 'system_property' when regexp_matches(name, '^(find|get|query|search|fetch|load|read|select)') and regexp_matches(name, '(ById|ByKey|ByName|ByCode|ByType|All|One|List)') then 'db_query' when regexp_matches(name, '^(get|is)[A-Z]') then 'field_access' else 'method_call' end as origin, count(*) as n_methods from cn where kind in ('method', 'function') group by 1", CN)
_TOK = "list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_POST = "post as (select token, node_id, field, count(*) as tf from (" + " union all ".join(f"select id as node_id, '{f}' as field, unnest({_TOK.format(f=f)}) as token from cn" for f in search.FIELDS) + ") group by 1, 2, 3)"
add("search_postings", lambda t: search.postings(t.nodes).groupBy("token", "field").agg(F.count("*").alias("n_nodes"), F.sum("tf").alias("n_tokens")), "select token, field, count(*) as n_nodes, cast(sum(tf) as bigint) as n_tokens from post group by token, field", CN, _POST)
add("search_ranked", lambda t: search.match_all(t.nodes, _questions(t)), """select query_id, node_id, score from (select *, row_number() over (partition by query_id order by score desc, node_id) as r from (
  select q.query_id, d.node_id, round(sum(greatest(ln(((select count(*) from docs) - f.df + 0.5) / (f.df + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * d.len / (select avg(len) from docs)))), 6) as score
  from q join df f on list_contains(q.words, f.token) join hit h on h.token = f.token join docs d on d.node_id = h.node_id group by q.query_id, q.words, d.node_id having count(*) = len(q.words))) where r <= 10""",
  CN, "toks as (" + " union all ".join(f"select id as node_id, unnest({_TOK.format(f=f)}) as token from cn" for f in search.FIELDS) + ")", "hit as (select token, node_id, count(*) as tf from toks group by 1, 2)", "df as (select token, count(*) as df from hit group by 1)",
  "docs as (select cn.id as node_id, coalesce(l, 0) as len from cn left join (select node_id, count(*) as l from toks group by 1) x on x.node_id = cn.id)",
  "q as (select seq as query_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')) as words from nodes where seq % 50 = 0 and name <> '')")


def _questions(t):
    """The stated query set of searches: every row whose number is divisible by 50, by the words of its name."""
    rows = t.nodes.where("seq % 50 = 0 and name != ''").select(F.col("seq").alias("query_id"), F.array_distinct(text.split_camel("name")).alias("words"))
    return rows.where("size(words) > 0")


add("search_fuzzy", lambda t: search.fuzzy(t.nodes, ["publishInvocie", "RefundServise", "sortLedgr"]), "select term, node_id, distance from (select *, row_number() over (partition by term order by distance, node_id) as r from (select term, id as node_id, cast(min(least(damerau_levenshtein(lower(name), term), damerau_levenshtein(lower(coalesce(qualified_name, name)), term))) as integer) as distance from cn, (values ('publishinvocie'), ('refundservise'), ('sortledgr')) v(term) group by term, id) where distance <= 3) where r <= 20", CN)
add("search_fields", lambda t: search.search(t.nodes, "kind:method lang:java invoice", 40).select("id", "name", "kind"), f"""select id, name, kind from (select id, name, kind, relevance, score from ranked union all select id, name, kind, relevance, 0.5 from kept where (contains(lower(name), 'invoice') or contains(lower(qualified_name), 'invoice') or contains(lower(file_path), 'invoice')) and not exists (select 1 from ranked)) order by relevance desc, score desc, id limit 40""", CN,
    f"""kept as (select n.*, case when regexp_matches(replace(n.file_path, '\\', '/'), '{_GENERATED}') then -2 when regexp_matches(n.file_path, '{paths.TEST_PATH}') then -1 when regexp_matches(replace(n.file_path, '\\', '/'), 'src/|app/|components/') then 1 else 0 end as relevance from cn n where n.kind = 'method' and lower(n.language) = 'java')""",
    "toks as (" + " union all ".join(f"select id as node_id, unnest({_TOK.format(f=f)}) as token from cn" for f in search.FIELDS) + ")", "hit as (select token, node_id, count(*) as tf from toks group by 1, 2)", "lens as (select node_id, count(*) as n from toks group by 1)",
    """ranked as (select n.id, n.name, n.kind, n.relevance, round(greatest(ln(((select count(*) from cn) - (select count(*) from hit where token = 'invoice') + 0.5) / ((select count(*) from hit where token = 'invoice') + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * l.n / ((select sum(n) from lens) / (select count(*) from cn)))), 6) as score
  from kept n join hit h on h.node_id = n.id and h.token = 'invoice' join lens l on l.node_id = n.id)""")
add("search_camel", lambda t: search.camel_match(t.nodes, ["open", "invoice"]), "select id, name from cn where list_has_all(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), ['open', 'invoice'])", CN)

_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
add("named_modules", lambda t: links.named_by(t.nodes, t.modules.select(F.split("id", "-")[0].alias("name"))), f"select m.name, n.id as node_id from (select distinct string_split(id, '-')[1] as name from modules) m join cn n on list_has_all({_WORDS.format(c='n.name')}, regexp_split_to_array(lower(m.name), '[^a-z0-9]+'))", CN)

QUERIES, SQL = R.QUERIES, R.SQL
