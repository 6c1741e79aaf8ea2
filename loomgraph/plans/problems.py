"""Queries p2, p3 and p5 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import hierarchy, references, skew
from loomgraph.tables import table


def p2_found(spark, folder):
    return hierarchy.cyclic(table(spark, folder, "nodes", "id", "parent_id", "seq"))


def p2_hierarchy(spark, folder):
    tree = hierarchy.hierarchy(table(spark, folder, "nodes", "id", "parent_id", "seq"))
    return tree.select("id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "n_below", "cycle_id")


def p2_descendants(spark, folder):
    return hierarchy.ancestors(hierarchy.hierarchy(table(spark, folder, "nodes", "id", "parent_id", "seq")))


def p2_intervals(spark, folder):
    tree = hierarchy.hierarchy(table(spark, folder, "nodes", "id", "parent_id", "seq"))
    return tree.where("entry is not null").select("id", "root_id", "entry", "exit")


def _broken(spark, folder):
    return references.broken_references(
        table(spark, folder, "edges", "source", "target", "created_at", "seq"),
        table(spark, folder, "nodes", "id", "parent_id", "file_path", "created_at", "seq"),
        table(spark, folder, "external_symbols", "id", "created_at"),
        table(spark, folder, "file_changes", "path", "op", "changed_at"),
    )


def p3_found(spark, folder):
    return _broken(spark, folder)


def p3_report(spark, folder):
    return references.broken_reference_report(_broken(spark, folder))


def p5_edges_per_target(spark, folder):
    return skew.edge_profile(table(spark, folder, "edges", "source", "target", "kind", "created_at"))


def p5_found(spark, folder):
    return skew.dominant_keys(p5_edges_per_target(spark, folder))


def p5_named_targets(spark, folder):
    names = table(spark, folder, "external_symbols", "id", "name").select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return skew.edge_profile_named(table(spark, folder, "edges", "source", "target", "kind"), names.dropDuplicates(["target"]))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_hierarchy, p2_descendants, p2_intervals, p3_found, p3_report, p5_found, p5_edges_per_target, p5_named_targets)
}

_CUR = """cur as (select id, nullif(arg_max(parent_id, seq), '') as parent from (select id, coalesce(parent_id, '') as parent_id, seq from nodes where id is not null) group by id)"""
_ENDS = """up as (
  select c.id, c.parent, [c.id] as path from cur c where c.parent is null or c.parent not in (select id from cur)
  union all
  select c.id, c.parent, list_append(u.path, c.id) from cur c join up u on c.parent = u.id)"""
_RINGS = """loop as (select * from cur where id not in (select id from up)),
inner_loop as (select * from loop where id in (select parent from loop)),
walk as (
  select id as start, parent as here, 1 as n, id as low from inner_loop
  union all
  select w.start, l.parent, w.n + 1, least(w.low, w.here) from walk w join loop l on l.id = w.here where w.here <> w.start and w.n <= (select count(*) from inner_loop)),
ring as (select start as id, min(low) as cycle_id from walk where here = start group by start),
tail as (
  select id, cycle_id, 0 as steps from ring
  union all
  select l.id, t.cycle_id, t.steps + 1 from loop l join tail t on l.parent = t.id where l.id not in (select id from ring))"""
_TREE = f"with recursive {_CUR}, {_ENDS}, {_RINGS}, pairs as (select unnest(path) as a, id from up), below as (select a, count(*) - 1 as n from pairs group by a)"

# Intervals: in the order of paths every inner symbol takes a place for its entry, one for its exit and one for each of its leaves.
_PLACES = """parents as (select distinct parent as id from cur where parent is not null),
leaf as (select id, path[1] as root, path[len(path) - 1] as parent, row_number() over (partition by path[len(path) - 1] order by id) as nth from up where len(path) > 1 and id not in (select id from parents)),
inn as (select u.id, u.path, u.path[1] as root, len(u.path) - 1 as depth, coalesce(l.n, 0) as leaves from up u left join (select parent, count(*) as n from leaf group by parent) l on l.parent = u.id where u.id in (select id from parents)),
under as (select a, sum(w) as w from (select unnest(list_slice(path, 1, len(path) - 1)) as a, 2 + leaves as w from inn) group by a),
placed as (select id, root, leaves, coalesce(sum(2 + leaves) over (partition by root order by path rows between unbounded preceding and 1 preceding), 0) - depth as entry from inn)"""

_REFS = """refs as (
  select 'edges' as ref_table, 'source' as ref_field, source as ref, seq, created_at as t from edges
  union all select 'edges', 'target', target, seq, created_at from edges
  union all select 'nodes', 'parent_id', parent_id, seq, created_at from nodes),
good as (
  select * from refs where ref is not null and ref <> '' and not (ref_table = 'edges' and
    (starts_with(ref, 'tx:') or starts_with(ref, 'cache:') or starts_with(ref, 'config:') or starts_with(ref, 'topic:')))),
known as (
  select g.*, (select min(created_at) from nodes n where n.id = g.ref) as nf,
    case when ref_table = 'edges' then (select min(created_at) from external_symbols x where x.id = g.ref) end as xf,
    (select max(created_at) from nodes n where n.id = g.ref and n.created_at <= g.t) as c
  from good g),
ends as (
  select distinct n.id, n.created_at as c, (select min(f.changed_at) from file_changes f where f.op = 'deleted' and f.path = n.file_path and f.changed_at > n.created_at) as d from nodes n),
gone as (select id, c, min(d) as d from ends group by id, c),
judged as (
  select k.ref_table, k.ref_field, k.seq,
    case when nf is null and xf is null then 'missing'
         when least(coalesce(nf, xf), coalesce(xf, nf)) > t then 'late'
         when g.d <= t then 'deleted' end as status,
    strftime(t, '%Y-%m') as period
  from known k left join gone g on g.id = k.ref and g.c = k.c)"""

SQL = {
    "p2_found": f"{_TREE} select id, cycle_id, cast(steps as integer) as steps from tail",
    "p2_hierarchy": f"""{_TREE}
select u.id, u.path[1] as root_id, cast(len(u.path) - 1 as integer) as depth, array_to_string(u.path, ' > ') as path, b.n as n_below, cast(null as varchar) as cycle_id
from up u join below b on b.a = u.id
union all select id, null, null, null, null, cycle_id from tail""",
    "p2_descendants": f"""{_TREE}
select a as ancestor_id, p.id, cast(len(u.path) - list_position(u.path, a) as integer) as distance from pairs p join up u on u.id = p.id where a <> p.id""",
    "p2_intervals": f"""{_TREE}, {_PLACES}
select p.id, p.root as root_id, cast(p.entry as bigint) as entry, cast(p.entry + 1 + p.leaves + coalesce(u.w, 0) as bigint) as exit from placed p left join under u on u.a = p.id
union all select l.id, l.root, cast(p.entry + l.nth as bigint), cast(p.entry + l.nth as bigint) from leaf l join placed p on p.id = l.parent
union all select id, id, 0, 0 from up where len(path) = 1 and id not in (select id from parents)""",
    "p3_found": f"with {_REFS} select * from judged where status is not null",
    "p3_report": f"with {_REFS} select ref_table, ref_field, period, status, count(*) as n_refs from judged where status is not null group by all",
    "p5_edges_per_target": """select target, kind, count(distinct coalesce('s' || source, '')) as n_edges, count(distinct source) as n_sources,
  min(created_at) as first_at, max(created_at) as last_at from edges group by target, kind""",
    "p5_found": """with d as (select distinct source, target, kind from edges)
select target, kind from d group by target, kind having count(*) >= 0.01 * (select count(*) from d)""",
    "p5_named_targets": """select e.target, x.name as target_name, e.kind, count(*) as n_rows
from edges e left join external_symbols x on x.id = e.target group by all""",
}
