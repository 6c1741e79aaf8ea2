"""Several services together: what each provides and consumes, and how it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.sets import changes
from loomgraph.session import Scratch
from loomgraph.sources import formats, frameworks
from loomgraph.sources.lines import current_contents

# What kinds of providers answer what kinds of consumers.
COMPATIBLE = {
    "rpc_call": ("http_endpoint", "gateway_route"), "http_request": ("http_endpoint", "gateway_route"), "mq_publish": ("mq_queue", "mq_exchange"), "mq_subscribe": ("mq_queue", "mq_exchange"),
    "cache_get": ("cache_key",), "cache_put": ("cache_key",), "db_rw": ("db_table", "db_collection"), "gateway_route": ("http_endpoint",),
}
OTHERWISE = ("http_endpoint", "gateway_route", "mq_queue", "cache_key", "db_table")
LEAST_SCORE = 15


def repository(path: str = "path"):
    """The top two folders of a path: the project a file belongs to."""
    return F.array_join(F.slice(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), 1, 2), "/")


def _row(df: DataFrame, side: str, kind, name, extractor: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.lit(side).alias("side"), repository().alias("project"), kind.alias("kind"), name.alias("name"), F.col("path"), F.lit(extractor).alias("extractor"))


def _spring(files: DataFrame) -> DataFrame:
    routes = frameworks.routes(files).where("framework in ('spring', 'webflux')")
    clients = frameworks.annotation_relations(files).where("kind = 'feign_client'")
    calls = frameworks.text_relations(files).where("kind = 'http_request'")
    return _row(routes, "provides", "http_endpoint", F.concat_ws(" ", "method", "route"), "spring-cloud").unionByName(_row(clients, "consumes", "rpc_call", F.expr("substr(target, 9)"), "spring-cloud")).unionByName(_row(calls, "consumes", "http_request", F.expr("substr(target, 5)"), "spring-cloud"))


def _gateway(files: DataFrame) -> DataFrame:
    return _row(formats.gateway_routes(current_contents(files)), "provides", "gateway_route", F.concat_ws(" ", "service", F.array_join("predicates", " ")), "gateway")


def _queues(files: DataFrame) -> DataFrame:
    listens = frameworks.annotation_relations(files).where("kind = 'subscribes_to'")
    sends = frameworks.text_relations(files).where("kind = 'publishes_to'")
    return _row(listens, "provides", "mq_queue", F.col("target"), "rabbitmq").unionByName(_row(sends, "consumes", "mq_publish", F.col("target"), "rabbitmq"))


def _redis(files: DataFrame) -> DataFrame:
    keys = frameworks.annotation_relations(files).where("kind in ('cache_annotation', 'redis_hash')")
    uses = frameworks.text_relations(files).where("kind = 'redis_operation'")
    return _row(keys, "provides", "cache_key", F.col("target"), "redis").unionByName(_row(uses, "consumes", "cache_get", F.col("target"), "redis"))


def _database(files: DataFrame) -> DataFrame:
    contents = current_contents(files)
    entities = frameworks.annotation_relations(files).where("kind in ('jpa_entity', 'mongo_entity')")
    tables = formats.sql_tables(contents).select("path", "table").distinct()
    uses = frameworks.text_relations(files).where("kind = 'maps_to'")
    return _row(entities, "provides", F.when(F.col("kind") == "mongo_entity", "db_collection").otherwise("db_table"), F.col("target"), "database").unionByName(_row(tables, "provides", "db_table", F.col("table"), "database")).unionByName(_row(uses, "consumes", "db_rw", F.col("target"), "database"))


def _frontend(files: DataFrame) -> DataFrame:
    calls = frameworks.text_relations(files).where("kind in ('api_call', 'react_query')")
    return _row(calls, "consumes", "http_request", F.col("target"), "frontend")


def _migrations(files: DataFrame) -> DataFrame:
    contents = current_contents(files)
    flyway = contents.where("path rlike '(^|/)V[0-9][0-9_.]*__[^/]*[.]sql$'")
    return _row(flyway, "provides", "db_migration", F.regexp_extract("path", r"/(V[0-9_.]+)__", 1), "database-migration").unionByName(_row(formats.liquibase_changes(contents), "provides", "db_migration", F.concat_ws(":", "author", "id"), "liquibase"))


def _openapi(files: DataFrame) -> DataFrame:
    return _row(formats.openapi_endpoints(current_contents(files)), "provides", "http_endpoint", F.concat_ws(" ", "method", "route"), "openapi")


def _flowable(files: DataFrame) -> DataFrame:
    rows = formats.bpmn_elements(current_contents(files))
    processes = rows.select("path", "process").distinct()
    calls = rows.where("tag = 'callActivity'")
    return _row(processes, "provides", "process", F.col("process"), "flowable").unionByName(_row(calls, "consumes", "process_call", F.coalesce("name", "id"), "flowable"))


def _drools(files: DataFrame) -> DataFrame:
    return _row(formats.drools_rules(current_contents(files)), "provides", "rule", F.col("rule"), "drools")


def _images(files: DataFrame) -> DataFrame:
    contents = current_contents(files)
    jib = contents.where("content rlike 'jib'").select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?:<image>|image\s*=\s*[\"'])([\w./:-]+)"), F.lit(1))).alias("image"))
    return _row(jib, "provides", "container_image", F.col("image"), "jib").unionByName(_row(formats.kubernetes_resources(contents).where("image is not null"), "consumes", "container_image", F.col("image"), "k8s"))


def _pipelines(files: DataFrame) -> DataFrame:
    rows = current_contents(files).where("path rlike '(^|/)azure-pipelines[^/]*[.]ya?ml$'")
    return _row(rows.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)-\s*(?:task|template|stage|job):\s*(\S+)"), F.lit(1))).alias("n")), "provides", "pipeline_step", F.col("n"), "azure-devops")


def _coverage(files: DataFrame) -> DataFrame:
    rows = current_contents(files).where("path rlike '(TEST-[^/]*|jacoco)[.]xml$'")
    return _row(rows, "provides", "test_report", F.coalesce(F.nullif(F.regexp_extract("content", r"<(?:testsuite|report)\b[^>]*\bname=\"([^\"]+)\"", 1), F.lit("")), F.col("path")), "coverage")


def _dependencies(files: DataFrame) -> DataFrame:
    contents = current_contents(files)
    gradle = formats.gradle_dependencies(contents)
    maven = formats.maven_dependencies(contents).where("not managed")
    return _row(gradle, "consumes", "dependency", F.col("notation"), "dependencies").unionByName(_row(maven, "consumes", "dependency", F.concat_ws(":", "group_id", "artifact_id", "version"), "dependencies"))


def _enterprise(files: DataFrame, names: tuple[str, ...] = ("Api", "RpcService", "RpcReference")) -> DataFrame:
    from loomgraph.sources.lines import annotation_uses

    return _row(annotation_uses(files).where(F.col("annotation").isin(*names)), "provides", "custom_annotation", F.concat_ws(":", "annotation", "name"), "enterprise-frameworks")


Extractor = Callable[[DataFrame], DataFrame]
EXTRACTORS: dict[str, Extractor] = {
    "spring-cloud": _spring, "gateway": _gateway, "rabbitmq": _queues, "redis": _redis, "database": _database, "frontend": _frontend, "database-migration": _migrations, "openapi": _openapi,
    "flowable": _flowable, "drools": _drools, "enterprise-frameworks": _enterprise, "jib": _images, "azure-devops": _pipelines, "coverage": _coverage, "dependencies": _dependencies,
}


def register(name: str, extractor: Extractor) -> None:
    """Adds an extractor of one's own: files to (side, project, kind, name, path, extractor)."""
    EXTRACTORS[name] = extractor


def extract_all(files: DataFrame) -> DataFrame:
    """(side, project, kind, name, path, extractor) of all extractors, over contents that are taken once."""
    files = Scratch(files.sparkSession).write(current_contents(files))
    rows = None
    for extractor in EXTRACTORS.values():
        part = extractor(files)
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


def match_consumers(found: DataFrame) -> DataFrame:
    """(consumer, name, provider, provided, score): the best provider of another project for each consumed name.

    Ten points for a kind that answers it, five for each word of the provided
    name in the consumed one; fifteen are needed. Candidates share a word, so
    the match is an equi-join on words, however common. Provided names of the
    same words and kind have the same points, so only the two last providers of
    each take part: one of them is of another project. A pair is taken at the
    first word it shares.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin("get", "post", "put", "delete", "patch", "http", "https", "url", "api")))
    compatible = F.create_map(*[x for kind, kinds in COMPATIBLE.items() for x in (F.lit(kind), F.array(*[F.lit(k) for k in kinds]))])
    a = found.where("side = 'consumes'").select(F.col("project").alias("consumer"), "name", "kind", words("name").alias("cw")).distinct().select("*", F.explode("cw").alias("word"))
    provided = found.where("side = 'provides'").select(F.col("project").alias("provider"), F.col("name").alias("provided"), F.col("kind").alias("pkind"), F.array_sort(words("name")).alias("pw"))
    last = F.row_number().over(Window.partitionBy("pw", "pkind").orderBy(F.desc("provider")))
    b = provided.groupBy("pw", "pkind", "provider").agg(F.max("provided").alias("provided")).withColumn("_r", last).where("_r <= 2").drop("_r").select("*", F.explode("pw").alias("word"))
    pairs = a.join(b, "word").where((F.col("consumer") != F.col("provider")) & (F.col("word") == F.array_min(F.array_intersect("cw", "pw"))))
    fits = F.array_contains(F.coalesce(compatible[F.col("kind")], F.array(*[F.lit(k) for k in OTHERWISE])), F.col("pkind"))
    score = F.when(fits, 10).otherwise(0) + 5 * F.size(F.array_intersect("cw", "pw"))
    best = F.max(F.struct(score.alias("score"), F.col("provider"), F.col("provided"))).alias("b")
    return pairs.withColumn("_s", score).where(F.col("_s") >= LEAST_SCORE).groupBy("consumer", "name").agg(best).select("consumer", "name", "b.provider", "b.provided", "b.score")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """(side, project, kind, name, change): what an update adds, removes or moves to another file."""
    latest = lambda df: df.groupBy("side", "project", "kind", "name").agg(F.min("path").alias("path"))
    return changes(latest(old), latest(new), ["side", "project", "kind", "name"], ["path"])


def changed_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project): projects with a file whose hash differs from the one before."""
    a = old.groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash")).alias("f")).select("path", F.col("f.content_hash").alias("h"))
    b = new.groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash")).alias("f")).select("path", F.col("f.content_hash").alias("h"))
    return changes(a, b, ["path"], ["h"]).select(repository().alias("project")).distinct()


def synthetic_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind, name): nodes for the external ends of relations that have none."""
    kind = F.when(F.col("kind") == "calls", "method").when(F.col("kind").isin("extends", "implements", "type_of", "instantiates", "decorates"), "class").otherwise("external")
    rows = edges.where(F.col("target").startswith("ext://")).groupBy("target").agg(F.min(kind).alias("kind"))
    stored = nodes.select(F.col("id").alias("target")).distinct()
    return rows.join(stored, "target", "left_anti").select(F.col("target").alias("id"), "kind", F.element_at(F.split("target", "/"), -1).alias("name"))


def build_dependencies(contents: DataFrame) -> DataFrame:
    """(from_module, to_module): modules of the workspace that depend on each other by their POMs."""
    modules = formats.maven_modules(contents).select(F.col("artifact_id").alias("to_module"))
    return formats.maven_dependencies(contents).where("not managed").select(F.col("module").alias("from_module"), F.col("artifact_id").alias("to_module")).join(modules, "to_module", "left_semi").select("from_module", "to_module").distinct()


# Build files by build system, in order of precedence.
BUILD_FILES = (("maven", "pom.xml"), ("gradle", "build.gradle|build.gradle.kts|settings.gradle|settings.gradle.kts"), ("npm", "package.json"), ("pip", "requirements.txt|pyproject.toml|setup.py"), ("cargo", "Cargo.toml"), ("go", "go.mod"))


def projects(files: DataFrame) -> DataFrame:
    """(project, build_system, language, n_files): projects of a tree, by their build files and most frequent language."""
    from loomgraph.functions.paths import language_of

    name = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    rank = F.lit(None).cast("int")
    for at in range(len(BUILD_FILES) - 1, -1, -1):
        rank = F.when(name.isin(*BUILD_FILES[at][1].split("|")), at).otherwise(rank)
    rows = files.select("path").distinct().select("path", repository().alias("project"), rank.alias("rank"), language_of("path").alias("language"))
    counted = rows.groupBy("project", "language").agg(F.count("*").alias("n"), F.min("rank").alias("rank"))
    best = F.max(F.struct((F.col("language") != "unknown").cast("int").alias("known"), F.col("n"), F.col("language"))).alias("b")
    names = F.array(*[F.lit(system) for system, _ in BUILD_FILES])
    out = counted.groupBy("project").agg(best, F.min("rank").alias("rank"), F.sum("n").alias("n_files"))
    return out.select("project", F.when(F.col("rank").isNull(), "git").otherwise(F.element_at(names, F.col("rank") + 1)).alias("build_system"), F.col("b.language").alias("language"), "n_files")
