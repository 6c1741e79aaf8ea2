"""Queries over source texts, dispatch, traces, diagrams, services and reports of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import aggregates, context, diagrams, dispatch, sets, summaries, traces, traversal, workspace
from loomgraph.plans.base import ANN, CALLABLE, CALLS, CN, EXT, FD, Registry, pages_levels, pages_sql
from loomgraph.sources import formats, frameworks, infrastructure, lines
from loomgraph.streaming import sync

R = Registry()
add = R.add

_FC = "fc as (select path, arg_max(language, (indexed_at, content_hash)) as language, regexp_replace(regexp_replace(arg_max(content, (indexed_at, content_hash)), chr(13) || chr(10), chr(10), 'g'), chr(13), chr(10), 'g') as content from files where content is not null and path is not null group by path)"
_LN = "ln as (select path, language, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line, unnest(string_split(content, chr(10))) as text from fc)"

# -- sources ------------------------------------------------------------------
add("source_lines", lambda t: lines.source_lines(lines.current_contents(t.files)).groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("text") == "").alias("n_blank")), "select path, count(*) as n_lines, count(*) filter (trim(text) = '') as n_blank from ln group by path", _FC, _LN)
add("source_types", lambda t: lines.declarations(lines.source_lines(lines.current_contents(t.files))).where("kind = 'class' and language in ('java', 'kotlin', 'python')").select("path", F.col("line").cast("bigint").alias("line"), "name"),
    r"""select path, line, name from (select path, line, case language when 'java' then regexp_extract(text, '^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|record)\s+(\w+)', 1)
  when 'kotlin' then regexp_extract(text, '^\s*(?:(?:public|private|internal|open|abstract|sealed|data|inner|enum|annotation)\s+)*class\s+(\w+)', 1) when 'python' then regexp_extract(text, '^\s*class\s+(\w+)\s*[(:]', 1) end as name from ln where language in ('java', 'kotlin', 'python')) where name <> ''""", _FC, _LN)
add("source_functions_python", lambda t: lines.declarations(lines.source_lines(lines.current_contents(t.files))).where("kind in ('function', 'method') and language = 'python'").select("path", F.col("line").cast("bigint").alias("line"), "kind", "name"),
    r"""select path, line, case when f <> '' then 'function' else 'method' end as kind, case when f <> '' then f else m end as name from (select path, line, regexp_extract(text, '^(?:async\s+)?def\s+(\w+)\s*\(', 1) as f, regexp_extract(text, '^\s+(?:async\s+)?def\s+(\w+)\s*\(', 1) as m from ln where language = 'python') where f <> '' or m <> ''""", _FC, _LN)
add("source_nodes", lambda t: lines.parsed_nodes(t.files))
add("source_edges", lambda t: lines.parsed_edges(t.files))
add("source_annotations", lambda t: lines.annotation_uses(t.files))
add("source_doc_comments", lambda t: lines.doc_comments(t.files))
add("source_extends", lambda t: lines.parsed_edges(t.files).where("kind in ('extends', 'implements')"))
add("config_properties", lambda t: formats.property_entries(lines.current_contents(t.files).withColumn("path", F.regexp_replace("path", "[.]ya?ml$", ".properties"))), r"select regexp_replace(path, '[.]ya?ml$', '.properties') as path, trim(regexp_extract(text, '^([^=]*)=', 1)) as key, trim(regexp_extract(text, '^[^=]*=(.*)$', 1)) as value, cast(line as integer) as line from ln where regexp_matches(path, '[.](ya?ml|properties)$') and trim(text) <> '' and not regexp_matches(trim(text), '^[#!]') and contains(text, '=')", _FC, _LN)
_YAML = r"""select l.path, case when regexp_matches(l.text, '^\s') then (select arg_max(regexp_extract(p.text, '^([\w.-]+):', 1), p.line) from ln p where p.path = l.path and p.line < l.line and regexp_matches(p.text, '^[\w.-]+:')) || '.' else '' end || trim(regexp_extract(l.text, '^\s*([\w.\-]+)\s*:', 1)) as key,
  trim(regexp_extract(l.text, '^\s*[\w.\-]+\s*:(?:\s+(.*))?$', 1)) as value, cast(l.line as integer) as line from ln l where regexp_matches(l.path, '[.]ya?ml$') and trim(l.text) <> '' and not regexp_matches(trim(l.text), '^#') and regexp_matches(l.text, '^\s*[\w.\-]+\s*:(\s|$)')"""
add("config_yaml", lambda t: formats.yaml_entries(lines.current_contents(t.files)), _YAML, _FC, _LN)
add("config_cascade", lambda t: formats.config_cascade(formats.yaml_entries(lines.current_contents(t.files)), ["prod"]).groupBy("module").agg(F.count("*").alias("n_keys")), r"select array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') as module, count(distinct key) as n_keys from ye where regexp_extract(path, '(?:^|/)\w+-(\w+)\.[^/]*$', 1) in ('', 'prod') group by 1", _FC, _LN, f"ye as ({_YAML})")
add("mapper_statements", lambda t: formats.mapper_statements(lines.current_contents(t.files)), r"""select path, namespace, m[1] as verb, m[2] as id, trim(regexp_replace(m[3], '\s+', ' ', 'g')) as sql from (select path, regexp_extract(content, '<mapper\s+namespace="([^"]+)"', 1) as namespace,
  unnest(list_zip(regexp_extract_all(content, '(?s)<(select|insert|update|delete)\s+[^>]*?\bid="([^"]+)"[^>]*>(.*?)</(?:select|insert|update|delete)>', 1), regexp_extract_all(content, '(?s)<(select|insert|update|delete)\s+[^>]*?\bid="([^"]+)"[^>]*>(.*?)</(?:select|insert|update|delete)>', 2), regexp_extract_all(content, '(?s)<(select|insert|update|delete)\s+[^>]*?\bid="([^"]+)"[^>]*>(.*?)</(?:select|insert|update|delete)>', 3))) as m from fc where contains(content, '<mapper'))""", _FC)
_VUE = (("component", r"<([A-Z]\w+|[a-z]+(?:-[a-z]+)+)[\s/>]"), ("event", r"@([\w:.-]+)="), ("slot", r'<slot(?:\s+name="([\w-]+)")?'), ("directive", r"\s(v-[\w-]+)"), ("binding", r"\s:([\w-]+)="))
add("vue_templates", lambda t: formats.vue_template(lines.current_contents(t.files)), "select distinct path, what, coalesce(nullif(name, ''), 'default') as name from (" + " union all ".join(f"select path, '{what}' as what, unnest(regexp_extract_all(t, '{p}', 1)) as name from vt" for what, p in _VUE) + ")",
    _FC, "vt as (select path, regexp_extract(content, '(?s)<template[^>]*>(.*)</template>', 1) as t from fc where ends_with(path, '.vue'))")
add("framework_relations", lambda t: frameworks.annotation_relations(t.files))
add("text_relations", lambda t: frameworks.text_relations(t.files))
add("infrastructure_relations", lambda t: infrastructure.infrastructure_relations(t.files))
add("detected_frameworks", lambda t: frameworks.detected_frameworks(t.files), "select array_to_string(list_slice(string_split(replace(path, '\\', '/'), '/'), 1, 2), '/') as repository, framework, confidence, count(*) as n_files from (" + " union all ".join(
    f"select path, '{name}' as framework, cast({c} as double) as confidence from fc where " + " or ".join("contains(content, '" + w.replace("'", "''") + "')" for w in words) for name, words, c in frameworks.FRAMEWORKS) + ") group by 1, 2, 3", _FC)
add("routes", lambda t: frameworks.routes(t.files))
add("inventory_counts", lambda t: summaries.inventory_counts(frameworks.annotation_relations(t.files).select("kind").unionByName(frameworks.text_relations(t.files).select("kind")).unionByName(t.edges.select("kind"))))
add("projects", lambda t: workspace.projects(t.files).select("project", "n_files"), "select array_to_string(list_slice(string_split(replace(path, '\\', '/'), '/'), 1, 2), '/') as project, count(distinct path) as n_files from files where path is not null group by 1")

# -- dispatch -----------------------------------------------------------------
_IMPL = """impl as (select target as interface_id, source as implementation_id from edges where kind in ('implements', 'conditional_impl') and source in (select id from cn) union select distinct i.id, c.id from cn i join cn c on c.kind in ('class', 'enum') and i.kind = 'interface' and
  exists (select 1 from (values (c.name), (regexp_extract(coalesce(c.qualified_name, c.name), '[^.]*$'))) v(k) where k = i.name or k = i.name || 'Impl' or (regexp_matches(i.name, '^I[A-Z]') and (k = substr(i.name, 2) or k = substr(i.name, 2) || 'Impl'))))"""
_AOP = f"select parent_id as source_id, id as target_id, cast(0.7 as double) as confidence from cn where kind in {CALLABLE} and parent_id in (select node_id from ann where annotation_name in ('Transactional', 'Cacheable', 'CacheEvict', 'CachePut', 'Async', 'Retryable', 'Component'))"
_STRATEGY = "select interface_id as source_id, implementation_id as target_id, cast(0.6 as double) as confidence from impl where interface_id in (select interface_id from impl group by 1 having count(*) >= 2)"
_CONDITIONAL = "select interface_id as source_id, implementation_id as target_id, cast(case when count(*) over (partition by interface_id) = 1 then 0.9 when implementation_id in (select node_id from ann where regexp_matches(annotation_name, '^(Conditional|Profile)')) then 0.8 else 0.6 end as double) as confidence from impl"
_FACTORY = f"""select e.source as source_id, e.target as target_id, cast(0.4 as double) as confidence from (select distinct source, target from edges where kind = 'instantiates') e join cn m on m.id = e.source join cn c on c.id = e.target where m.kind in {CALLABLE} and regexp_matches(m.name, '^(create|build|make|new|get|open|load)[A-Z_]') and c.kind in ('class', 'enum')
  union all select m.id, (select min(c.id) from cn c where c.kind in ('class', 'enum') and c.name = regexp_extract(m.signature, ':\\s*(\\w+)\\s*$', 1)), cast(0.35 as double) from cn m where m.kind in {CALLABLE} and regexp_matches(m.name, '^(create|build|make|new|get|open|load)[A-Z_]') and regexp_extract(m.signature, ':\\s*(\\w+)\\s*$', 1) in (select name from cn where kind in ('class', 'enum'))"""
_PROXY = "select distinct e.source as source_id, e.target as target_id, cast(0.3 as double) as confidence from edges e where e.kind = 'instantiates' and e.source in (select source from edges where kind = 'calls' and regexp_matches(target, '(newProxyInstance|Enhancer[.:]create|createProxy)'))"
_REFLECTION = "select distinct e.source as source_id, n.id as target_id, cast(0.1 as double) * 3 as confidence from edges e join cn n on n.qualified_name = json_extract_string(e.metadata, '$.argument') where e.kind = 'calls' and regexp_matches(e.target, '(forName|loadClass|newInstance|invoke)') and n.kind in ('class', 'enum')"
_SPI = "select distinct e.source as source_id, i.implementation_id as target_id, cast(0.5 as double) as confidence, i.interface_id from edges e join impl i on i.interface_id = e.target where e.kind in ('references', 'type_of') and e.source in (select source from edges where kind = 'calls' and contains(target, 'ServiceLoader'))"
add("dispatch_aop", lambda t: dispatch.aop(t.nodes, t.edges).select("source_id", "target_id", "confidence"), _AOP, CN, ANN)
add("dispatch_strategy", lambda t: dispatch.strategy(t.nodes, t.edges).select("source_id", "target_id", "confidence"), _STRATEGY, CN, _IMPL)
add("dispatch_conditional", lambda t: dispatch.conditional_beans(t.nodes, t.edges).select("source_id", "target_id", "confidence"), _CONDITIONAL, CN, ANN, _IMPL)
add("dispatch_factory", lambda t: dispatch.factory(t.nodes, t.edges).select("source_id", "target_id", F.round("confidence", 6).alias("confidence")), _FACTORY, CN)
add("dispatch_inferred", lambda t: dispatch.infer(t.nodes, t.edges).withColumn("confidence", F.round("confidence", 6)), """select source, target, kind, round(max(confidence), 6) as confidence, arg_max(provenance, (confidence, provenance)) as provenance from pats where confidence >= 0.3 and target is not null and source <> '' group by source, target, kind""", CN, ANN, _IMPL,
    f"spi as ({_SPI})", "pats as (" + " union all ".join(f"select source_id as source, target_id as target, '{kind}' as kind, confidence, '{provenance}' as provenance from ({text})" for text, kind, provenance in (
        (_AOP, "aop_advises", "aop_proxy"), (_STRATEGY, "dispatch_registration", "strategy_registered"), (_CONDITIONAL, "conditional_impl", "conditional_bean"), (_FACTORY, "dispatch_registration", "factory_product"),
        (_PROXY, "proxy_wraps", "proxy_handler"), (_REFLECTION, "dispatch_registration", "reflective_match"), ("select source_id, target_id, confidence from spi", "dispatch_registration", "spi_loaded"),
        ("select interface_id as source_id, target_id, confidence from spi where interface_id <> coalesce(source_id, '')", "conditional_impl", "spi_loaded"),
    )) + ")")

# -- traces and diagrams ------------------------------------------------------
_TRACES = (
    "roles as (select n.id, case when n.kind = 'entry_point' then 'entry_point' when m.role is not null then m.role else 'main_method' end as role from cn n left join (select node_id, min(v.role) as role from ann join (values "
    + ", ".join(f"('{a}', '{role}')" for a, role in traversal.ENTRY_ANNOTATIONS.items()) + ") v(name, role) on v.name = annotation_name group by node_id) m on m.node_id = n.id where n.kind = 'entry_point' or m.role is not null or (n.name = 'main' and regexp_matches(n.file_path, '[.](java|kt)$')))",
    f"begun as (select r.id as e, r.role, coalesce(m.id, r.id) as f from roles r left join (select id, parent_id from cn where parent_id is not null and kind in {CALLABLE}) m on m.parent_id = r.id)",
    "traced as (select distinct md5(b.e || chr(31) || b.f || chr(31) || c.target) as trace_id, b.e, b.role, b.f, c.target as s from begun b join calls c on c.source = b.f join cn on cn.id = c.target)",
    "outer_ as (select source, target, row_number() over (partition by source order by target) as r from (select distinct source, target from edges where kind in ('calls', 'references', 'dispatch_call') and regexp_matches(target, '^(topic|cache|config|tx|ext):')))",
    "hops as (select trace_id, cast(0 as integer) as hop, e as node_id, role from traced union all select trace_id, 1, f, 'method' from traced where f <> e union all select trace_id, case when f <> e then 2 else 1 end, s, 'callee' from traced "
    "union all select trace_id, cast(case when f <> e then 2 else 1 end + o.r as integer), o.target, 'outside' from traced join outer_ o on o.source = s)",
)
add("full_traces", lambda t: traces.full_traces(t.edges, t.nodes), "select * from hops", CN, CALLS, ANN, *_TRACES)
add("trace_steps", lambda t: traces.trace_steps(traces.full_traces(t.edges, t.nodes)), "select trace_id, hop, node_id as source, target from (select *, lead(node_id) over (partition by trace_id order by hop) as target from hops) where target is not null", CN, CALLS, ANN, *_TRACES)
_SX = "sx as (select c.source, c.target, a.module_id as ma, b.module_id as mb from calls c join cn a on a.id = c.source join cn b on b.id = c.target where a.module_id <> '' and b.module_id <> '')"
add("service_traces", lambda t: traces.service_traces(t.edges, t.nodes, t.external_symbols).drop("n_entries"), "select m.module_id, (select count(*) from sx where ma = mb and ma = m.module_id) as n_internal, (select count(*) from sx where ma <> mb and ma = m.module_id) as n_out, (select count(*) from sx where ma <> mb and mb = m.module_id) as n_in, (select count(*) from ext join cn on cn.id = ext.source_location where cn.module_id = m.module_id) as n_external from (select distinct module_id from cn where module_id <> '') m", CN, CALLS, EXT, _SX)
add("diagram_services", lambda t: diagrams.service_diagram(aggregates.service_graph(t.edges, t.nodes)), "select 'graph LR' || chr(10) || string_agg(line, chr(10) order by line) as diagram from (select '  ' || regexp_replace(ma, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || count(*) || '| ' || regexp_replace(mb, '[^A-Za-z0-9]', '_', 'g') as line from (select distinct e.source, e.target, e.kind, a.module_id as ma, b.module_id as mb from edges e join cn a on a.id = e.source join cn b on b.id = e.target where e.kind in ('calls', 'imports', 'references', 'instantiates') and a.module_id <> '' and b.module_id <> '' and a.module_id <> b.module_id) group by ma, mb)", CN)


def _diagram(lines_sql: str, head: str) -> tuple[str, str]:
    """SQL of a diagram from SQL with one column, line, and the table that it draws from."""
    return f"""select '{head}' || chr(10) || coalesce(string_agg(line, chr(10) order by line), '') || case when (select count(*) from drawn) > {diagrams.MAX_LINES} then chr(10) || '  %% ' || ((select count(*) from drawn) - {diagrams.MAX_LINES}) || ' more' else '' end as diagram from (select line from drawn order by line limit {diagrams.MAX_LINES})""", f"drawn as (select distinct line from ({lines_sql}))"


def _box(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '[^A-Za-z0-9]', '_', 'g'), '^([0-9])', 'n_\\1')"


_SG = "sg as (select ma, mb, array_to_string(list_sort(list(distinct kind)), ',') as kinds from (select distinct e.kind, a.module_id as ma, b.module_id as mb from edges e join cn a on a.id = e.source join cn b on b.id = e.target where e.kind in ('calls', 'imports', 'references', 'instantiates') and a.module_id <> '' and b.module_id <> '' and a.module_id <> b.module_id) group by ma, mb)"
_KEYS = "select '  ' || {a} || ' -->|' || count(*) || '| ' || {b} as line from (select distinct source, target from edges where starts_with(target, '{p}')) u join cn n on n.id = u.source where n.module_id <> '' group by n.module_id, u.target"


def _draw(name: str, query, lines_sql: str, head: str, *ctes: str) -> None:
    text, drawn = _diagram(lines_sql, head)
    add(name, query, text, *ctes, drawn)


_draw("diagram_architecture", lambda t: diagrams.architecture_diagram(t.modules, aggregates.service_graph(t.edges, t.nodes)), f"select '  ' || {_box('id')} || '[\"' || coalesce(name, id) || '\"]' as line from modules union all select '  ' || {_box('ma')} || ' --> ' || {_box('mb')} from sg", "graph TB", CN, _SG)
_draw("diagram_caches", lambda t: diagrams.key_diagram(t.edges, t.nodes, "cache:"), _KEYS.format(a=_box("n.module_id"), b=_box("u.target"), p="cache:"), "graph LR", CN)
_draw("diagram_transactions", lambda t: diagrams.key_diagram(t.edges, t.nodes, "tx:"), _KEYS.format(a=_box("n.module_id"), b=_box("u.target"), p="tx:"), "graph LR", CN)
_draw("diagram_sequence", lambda t: diagrams.sequence_diagram(aggregates.service_graph(t.edges, t.nodes)), f"select '  ' || {_box('ma')} || '->>' || {_box('mb')} || ': ' || kinds as line from sg", "sequenceDiagram", CN, _SG)
_draw("diagram_fanout", lambda t: diagrams.fanout_diagram(traversal.page_fanout(t.edges, t.nodes, t.files.where(F.col("path").endswith(".vue")), 2)), f"select '  ' || {_box('seed')} || ' -->|' || depth || '| ' || {_box('id')} as line from ({pages_levels(2, 1)})", "graph LR", CN, FD, pages_sql(2))

# -- context ------------------------------------------------------------------
add("context_of_task", lambda t: context.build_context(t.nodes, t.edges, t.files, "How does the RefundPublisher publish a refund invoice and close the ledger?"))
add("node_context", lambda t: context.node_context(t.nodes, t.edges), "select n.id, p.name as parent_name, (select count(*) from cn c where c.parent_id = n.id) as n_children, (select count(*) from calls c where c.target = n.id and c.source in (select id from cn)) as n_callers, (select count(*) from calls c where c.source = n.id and c.target in (select id from cn)) as n_callees, (select count(*) from impl i where i.interface_id = n.id) as n_implementations, coalesce((select string_agg(annotation_name, ',' order by annotation_name) from ann where node_id = n.id), '') as annotations from cn n left join cn p on p.id = n.parent_id", CN, CALLS, ANN, _IMPL)

# -- services -----------------------------------------------------------------
add("workspace_found", lambda t: workspace.extract_all(t.files))
add("workspace_matches", lambda t: workspace.match_consumers(workspace.extract_all(t.files)))
add("synthetic_nodes", lambda t: workspace.synthetic_nodes(t.edges, t.nodes), "select target as id, min(case when kind = 'calls' then 'method' when kind in ('extends', 'implements', 'type_of', 'instantiates', 'decorates') then 'class' else 'external' end) as kind, regexp_extract(target, '[^/]*$') as name from edges where starts_with(target, 'ext://') and target not in (select id from nodes where id is not null) group by target")

# -- reports of changes -------------------------------------------------------
add("change_sessions", lambda t: sync.change_sessions(t.file_changes, gap="1 hour").select("path", "n_reports", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen")), """select path, count(*) as n_reports, strftime(min(changed_at), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(changed_at), '%Y-%m-%d %H:%M:%S') as last_seen from (
  select *, sum(new) over (partition by path order by changed_at, change_id rows unbounded preceding) as session from (select *, case when changed_at - lag(changed_at) over (partition by path order by changed_at, change_id) < interval 1 hour then 0 else 1 end as new from file_changes where path is not null and changed_at is not null)) group by path, session""")
add("latest_operations", lambda t: sync.latest_operations(t.file_changes).select("path", "op"), "select path, arg_max(op, (changed_at, change_id)) as op from file_changes where path is not null and changed_at is not null group by path")
add("applied_changes", lambda t: sync.apply_changes(sync.latest_operations(t.file_changes.where("change_id % 2 = 0")), t.file_changes).select("path", "op"), "select path, arg_max(op, (changed_at, change_id)) as op from file_changes where path is not null and changed_at is not null group by path")
add("stale_paths", lambda t: sync.stale_paths(t.files, t.file_changes).select("path"), "select l.path from (select path, arg_max(op, (changed_at, change_id)) as op, max(changed_at) as changed_at from file_changes where path is not null and changed_at is not null group by path) l join (select path, max(indexed_at) as i from files group by path) f on f.path = l.path where l.op <> 'deleted' and epoch_us(l.changed_at) // 1000 > f.i")

_STATE = ["path", "content_hash", "size", "modified_at", "indexed_at"]
add("sync_plan", lambda t: sync.plan_sync(sets.first_wins(t.files.where("path is not null").select(*_STATE), ["path"], "indexed_at"), sets.last_wins(t.files.where("path is not null").select(*_STATE), ["path"], "indexed_at")), """select path, 'modified' as change from (select path, arg_min({'h': content_hash, 's': size, 'm': modified_at}, (indexed_at, content_hash, size, modified_at)) as a, arg_max({'h': content_hash, 's': size, 'm': modified_at}, (indexed_at, content_hash, size, modified_at)) as b
  from files where path is not null group by path) where not coalesce(a.s = b.s and a.m = b.m, false) and a.h is distinct from b.h""")

QUERIES, SQL = R.QUERIES, R.SQL
