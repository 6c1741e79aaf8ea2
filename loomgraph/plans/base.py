"""What the modules of queries share: reading tables, and the SQL of the current graph."""

from __future__ import annotations

from collections.abc import Callable

from loomgraph.tables import table

CN = """cn as (select id, lower(kind) as kind, name, qualified_name, file_path, language, start_line, end_line, docstring, signature, visibility, is_exported,
  nullif(parent_id, '') as parent_id, module_id, metadata from nodes where id is not null qualify row_number() over (partition by id order by seq desc) = 1)"""
CE = "ce as (select * from edges qualify row_number() over (partition by source, target, kind order by seq) = 1)"
CALLS = "calls as (select distinct source, target from edges where kind = 'calls')"
ANN = """ann as (select source as node_id, regexp_extract(target, '[^/:]+$') as annotation_name, metadata as value from edges where kind = 'decorates' and source is not null
  qualify row_number() over (partition by source, regexp_extract(target, '[^/:]+$') order by seq) = 1)"""
EXT = """ext as (select e.*, x.providing_service as target_service, x.name as symbol_name from (select distinct source as source_location, target as external_symbol_id, kind as reference_type
  from edges where starts_with(target, 'ext://')) e left join external_symbols x on x.id = e.external_symbol_id)"""
CONF = "coalesce(cast(json_extract_string(metadata, '$.confidence') as double), 1.0)"
DISPATCH = "('dispatch_call', 'dispatch_registration', 'proxy_wraps', 'aop_advises', 'conditional_impl')"
CALLABLE = "('function', 'method', 'constructor')"
FD = "fd as (select distinct a.file_path as source, b.file_path as target from edges e join cn a on a.id = e.source join cn b on b.id = e.target where e.kind = 'imports' and a.file_path <> b.file_path)"


def pages_sql(depth: int) -> str:
    """Files that each page imports, by level: (seed, id) in p0, p1 and so on, each without those of the levels before."""
    parts = ["p0 as (select distinct path as seed, path as id from files where ends_with(path, '.vue'))"]
    for level in range(1, depth + 1):
        seen = " union all ".join(f"select seed, id from p{i}" for i in range(level))
        parts.append(f"p{level} as (select p.seed, s.target as id from p{level - 1} p join fd s on s.source = p.id except ({seen}))")
    return ", ".join(parts)


def pages_levels(depth: int, first: int = 0) -> str:
    return " union all ".join(f"select seed, id, {i} as depth from p{i}" for i in range(first, depth + 1))


class Folder:
    """The tables of one folder, as attributes."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str):
        return table(self.spark, self.folder, name)


class Registry:
    """Collects queries (a function of Folder) and their SQL under one name."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def add(self, name: str, query: Callable, sql: str | None = None, *ctes: str) -> None:
        if name in self.QUERIES:
            raise ValueError(name)
        self.QUERIES[name] = lambda spark, folder, q=query: q(Folder(spark, folder))
        if sql:
            recursive = "recursive " if any("union" in c and c.split(" as ")[0] in c.split(" as ", 1)[1] for c in ctes) else ""
            self.SQL[name] = (f"with {recursive}" + ", ".join(ctes) + " " if ctes else "") + sql
