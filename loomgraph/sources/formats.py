"""Configuration and description files to rows.

Patterns on whole texts are column expressions; only YAML, whose nesting is a
stack of indents, is read by an Arrow function per file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import Scratch


def all_groups(text: str | Column, pattern: str, **groups: int) -> Column:
    """All matches of a pattern as an array of structs, one field for each named group number."""
    text = F.col(text) if isinstance(text, str) else text
    arrays = [F.regexp_extract_all(text, F.lit(pattern), F.lit(number)).alias(name) for name, number in groups.items()]
    return F.arrays_zip(*arrays)


def explode_groups(df: DataFrame, text: str, pattern: str, keep: list[str], **groups: int) -> DataFrame:
    """One row per match, with the kept columns and one column per group."""
    arrays = {f"_{name}": F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(number)) for name, number in groups.items()}
    zipped = df.select(*keep, *[c.alias(n) for n, c in arrays.items()]).select(*keep, F.explode(F.arrays_zip(*arrays)).alias("_m"))
    return zipped.select(*keep, *[F.col("_m")[f"_{name}"].alias(name) for name in groups])


def flatten_yaml(text: str) -> list[tuple[str, str, int]]:
    """(dotted key, value, line): two blanks a level, '- ' items by number, block scalars dropped, '' for no value."""
    out, stack, block = [], [], None
    counters: dict[str, int] = {}
    for number, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        if not raw.strip() or raw.lstrip().startswith("#") or raw.strip() == "---":
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        if block is not None:
            if indent > block:
                continue
            block = None
        body = raw.strip()
        item = body.startswith("- ")
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not (item and not stack[-1][2])):
            stack.pop()
        if item:
            base = ".".join(k for _, k, _ in stack)
            at = counters.get(base, -1) + 1
            counters[base] = at
            stack.append((indent, str(at), True))
            body, indent = body[2:].strip(), indent + 2
        match = re.match(r"([\w.\-/\"'*$]+)\s*:(?:\s+(.*))?$", body)
        if not match:
            if item:
                out.append((".".join(k for _, k, _ in stack), body.strip("\"'"), number))
            continue
        key, value = match.group(1).strip("\"'"), re.sub(r"\s+#.*$", "", match.group(2) or "").strip()
        path = ".".join([*(k for _, k, _ in stack), key])
        if value in ("|", ">", "|-", ">-", "|+", ">+"):
            block = indent
            continue
        stack.append((indent, key, False))
        out.append((path, value.strip("\"'"), number))
    return out


_YAML = pa.schema([("path", pa.string()), ("key", pa.string()), ("value", pa.string()), ("line", pa.int32())])


def _yaml_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {name: [] for name in _YAML.names}
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            for row in flatten_yaml(content or ""):
                for name, value in zip(_YAML.names, (path, *row)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_YAML)


def yaml_entries(contents: DataFrame) -> DataFrame:
    """(path, key, value, line) of YAML files."""
    rows = contents.where("path rlike '[.]ya?ml$'").select("path", "content")
    return rows.mapInArrow(_yaml_batches, "path string, key string, value string, line int")


def property_entries(contents: DataFrame) -> DataFrame:
    """(path, key, value, line) of .properties files: '#' comments skipped, split at the first '='."""
    rows = contents.where("path rlike '[.]properties$'").select("path", F.posexplode(F.split("content", "\r?\n")).alias("at", "text"))
    rows = rows.where("trim(text) != '' and not trim(text) rlike '^[#!]' and text like '%=%'")
    return rows.select("path", F.trim(F.regexp_extract("text", r"^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("text", r"^[^=]*=(.*)$", 1)).alias("value"), (F.col("at") + 1).cast("int").alias("line"))


def config_cascade(entries: DataFrame, profiles: list[str]) -> DataFrame:
    """(module, key, value): YAML wins over other files; active profiles, in their order, win over the base."""
    name = F.element_at(F.split("path", "/"), -1)
    profile = F.regexp_extract(name, r"^[\w]+-([\w]+)\.", 1)
    rank = F.when(profile == "", 0)
    for at, active in enumerate(profiles, 1):
        rank = F.when(profile == active, at).otherwise(rank)
    module = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    rows = entries.withColumn("module", module).withColumn("_p", rank).where("_p is not null").withColumn("_y", name.rlike("ya?ml$").cast("int"))
    best = F.row_number().over(Window.partitionBy("module", "key").orderBy(F.desc("_p"), F.desc("_y"), "path"))
    return rows.withColumn("_r", best).where("_r = 1").select("module", "key", "value")


def mapper_statements(contents: DataFrame) -> DataFrame:
    """(path, namespace, verb, id, sql) of MyBatis mapper files."""
    rows = contents.where("content like '%<mapper%'").withColumn("namespace", F.regexp_extract("content", r"<mapper\s+namespace=\"([^\"]+)\"", 1))
    found = explode_groups(rows, "content", r"(?s)<(select|insert|update|delete)\s+[^>]*?\bid=\"([^\"]+)\"[^>]*>(.*?)</\1>", ["path", "namespace"], verb=1, id=2, sql=3)
    return found.withColumn("sql", F.trim(F.regexp_replace("sql", r"\s+", " ")))


def openapi_endpoints(contents: DataFrame) -> DataFrame:
    """(path, method, route) of OpenAPI documents in JSON."""
    schema = "struct<paths:map<string,map<string,struct<operationId:string>>>>"
    rows = contents.where("content like '%\"paths\"%' and (content like '%\"openapi\"%' or content like '%\"swagger\"%')").select("path", F.from_json("content", schema).alias("d"))
    routes = rows.select("path", F.explode("d.paths").alias("route", "verbs"))
    return routes.select("path", "route", F.explode("verbs").alias("method", "operation")).where("lower(method) in ('get', 'post', 'put', 'delete', 'patch')").select("path", F.upper("method").alias("method"), "route", F.col("operation.operationId").alias("operation_id"))


def kubernetes_resources(contents: DataFrame) -> DataFrame:
    """(path, at, kind, name, namespace, image, replicas, port, labels, selector) of each document of a manifest."""
    rows = contents.where("path rlike '[.]ya?ml$' and content rlike '(?m)^apiVersion:' and content rlike '(?m)^kind:'")
    docs = rows.select("path", F.posexplode(F.split("content", r"(?m)^---\s*$")).alias("at", "doc")).where("doc rlike '(?m)^kind:'")
    one = lambda p: F.nullif(F.regexp_extract("doc", p, 1), F.lit(""))
    pairs = lambda p: F.map_from_entries(F.transform(F.regexp_extract_all(F.regexp_extract("doc", p, 1), F.lit(r"([\w./-]+:\s*[\w./-]+)"), F.lit(1)), lambda e: F.struct(F.split(e, r":\s*")[0], F.split(e, r":\s*")[1])))
    return docs.select(
        "path", "at", one(r"(?m)^kind:\s*(\w+)").alias("kind"), one(r"(?ms)^metadata:.*?^\s+name:\s*([\w.-]+)").alias("name"), F.coalesce(one(r"(?m)^\s+namespace:\s*([\w-]+)"), F.lit("default")).alias("namespace"),
        one(r"(?m)^\s*-?\s*image:\s*(\S+)").alias("image"), one(r"(?m)^\s+replicas:\s*(\d+)").cast("int").alias("replicas"), F.regexp_extract_all("doc", F.lit(r"(?m)^\s*-?\s*(?:port|containerPort):\s*(\d+)"), F.lit(1)).alias("ports"),
        pairs(r"(?m)^\s+labels:\s*\n((?:\s{4,}[\w./-]+:.*\n?)+)").alias("labels"), pairs(r"(?m)^\s+(?:selector|matchLabels):\s*\n((?:\s{4,}[\w./-]+:\s*[\w./-]+\n?)+)").alias("selector"),
    )


def ingress_rules(contents: DataFrame) -> DataFrame:
    """(path, name, host, route, service, port) of ingress manifests."""
    docs = contents.where("content rlike '(?m)^kind:\\\\s*Ingress'").select("path", F.explode(F.split("content", r"(?m)^---\s*$")).alias("doc")).where("doc rlike '(?m)^kind:\\\\s*Ingress'")
    rows = docs.select("path", F.regexp_extract("doc", r"(?ms)^metadata:.*?^\s+name:\s*([\w.-]+)", 1).alias("name"), F.regexp_extract("doc", r"(?m)-\s*host:\s*\"?([\w.*-]+)", 1).alias("host"), "doc")
    return explode_groups(rows, "doc", r"(?ms)path:\s*(\S+).*?name:\s*([\w-]+)\s*\n\s*port:\s*\n?\s*(?:number:\s*)?(\d+)", ["path", "name", "host"], route=1, service=2, port=3)


def network_policies(contents: DataFrame) -> DataFrame:
    docs = contents.where("content rlike '(?m)^kind:\\\\s*NetworkPolicy'").select("path", F.explode(F.split("content", r"(?m)^---\s*$")).alias("doc")).where("doc rlike '(?m)^kind:\\\\s*NetworkPolicy'")
    one = lambda p: F.regexp_extract("doc", p, 1)
    return docs.select("path", one(r"(?ms)^metadata:.*?^\s+name:\s*([\w.-]+)").alias("name"), one(r"(?ms)podSelector:.*?app:\s*([\w-]+)").alias("applies_to"), F.regexp_extract_all("doc", F.lit(r"(?m)from:\s*\n(?:\s+.*\n)*?\s+app:\s*([\w-]+)"), F.lit(1)).alias("allows"))


def compose_services(contents: DataFrame) -> DataFrame:
    """(path, name, image, ports, depends_on, environment) of compose files, from their flattened keys."""
    rows = yaml_entries(contents.where("path rlike '(?i)(docker-)?compose[^/]*[.]ya?ml$'")).where("key like 'services.%'")
    rows = rows.select("path", F.split("key", "\\.")[1].alias("name"), F.expr("array_join(slice(split(key, '[.]'), 3, size(split(key, '[.]'))), '.')").alias("rest"), "value", "line")
    listed = lambda prefix: F.array_sort(F.collect_list(F.when(F.col("rest").startswith(prefix) & (F.col("value") != ""), F.col("value"))))
    return rows.groupBy("path", "name").agg(F.max(F.when(F.col("rest") == "image", F.col("value"))).alias("image"), listed("ports").alias("ports"), listed("depends_on").alias("depends_on"), listed("environment").alias("environment"))


def dockerfile(contents: DataFrame) -> DataFrame:
    rows = contents.where("path rlike '(^|/)Dockerfile[^/]*$'")
    get = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    return rows.select("path", get(r"(?m)^FROM\s+(\S+)").alias("bases"), get(r"(?m)^EXPOSE\s+(\d+)").alias("ports"), get(r"(?m)^ENV\s+(\S+?)[= ]").alias("variables"))


def maven_modules(contents: DataFrame) -> DataFrame:
    """(path, group_id, artifact_id, version, parent, properties, submodules) of POM files."""
    rows = contents.where("path rlike '(^|/)pom[.]xml$'")
    bare = F.regexp_replace("content", r"(?s)<(parent|dependencies|dependencyManagement|build|profiles|properties)>.*?</\1>", "")
    one = lambda text, tag: F.nullif(F.regexp_extract(text, rf"<{tag}>\s*([^<]+?)\s*</{tag}>", 1), F.lit(""))
    parent = F.regexp_extract("content", r"(?s)<parent>(.*?)</parent>", 1)
    block = F.regexp_extract("content", r"(?s)<properties>(.*?)</properties>", 1)
    entries = all_groups(block, r"<([\w.\-]+)>\s*([^<]*?)\s*</\1>", k=1, v=2)
    return rows.select(
        "path", F.coalesce(one(parent, "groupId"), one(bare, "groupId")).alias("parent_group"), F.coalesce(one(bare, "groupId"), one(parent, "groupId")).alias("group_id"), one(bare, "artifactId").alias("artifact_id"), F.coalesce(one(bare, "version"), one(parent, "version")).alias("version"),
        one(parent, "artifactId").alias("parent"), F.map_from_arrays(F.transform(entries, lambda e: e["k"]), F.transform(entries, lambda e: e["v"])).alias("properties"),
        F.regexp_extract_all("content", F.lit(r"<module>\s*([^<]+?)\s*</module>"), F.lit(1)).alias("submodules"),
    )


def resolve_properties(value: str, properties: str, rounds: int = 10) -> Column:
    """``${name}`` replaced from a map column, again and again up to ten times; unknown names stay."""
    def once(text: Column, _round: Column) -> Column:
        name = F.regexp_extract(text, r"\$\{([^}]+)\}", 1)
        known = F.element_at(F.col(properties), name)
        return F.when((name != "") & known.isNotNull(), F.replace(text, F.concat(F.lit("${"), name, F.lit("}")), known)).otherwise(text)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col(value), once)


def maven_dependencies(contents: DataFrame) -> DataFrame:
    """(module, group_id, artifact_id, version, scope, managed, path) with properties of the module and its parents resolved."""
    modules = maven_modules(contents)
    inherited = maven_chain(modules)
    rows = contents.where("path rlike '(^|/)pom[.]xml$'").select("path", F.regexp_replace("content", r"(?s)<dependencyManagement>.*?</dependencyManagement>", "").alias("own"), F.regexp_extract("content", r"(?s)<dependencyManagement>(.*?)</dependencyManagement>", 1).alias("managed_part"))
    parts = rows.select("path", F.explode(F.array(F.struct(F.lit(False).alias("managed"), F.col("own").alias("text")), F.struct(F.lit(True).alias("managed"), F.col("managed_part").alias("text")))).alias("p")).select("path", "p.managed", "p.text")
    each = parts.select("path", "managed", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    one = lambda tag: F.nullif(F.regexp_extract("d", rf"<{tag}>\s*([^<]+?)\s*</{tag}>", 1), F.lit(""))
    out = each.select("path", "managed", one("groupId").alias("group_id"), one("artifactId").alias("artifact_id"), one("version").alias("version"), F.coalesce(one("scope"), F.lit("compile")).alias("scope"))
    named = out.join(modules.select("path", F.col("artifact_id").alias("module"), F.col("version").alias("own_version"), F.col("group_id").alias("own_group")), "path").join(inherited.drop("module"), "path", "left")
    named = named.withColumn("properties", F.map_concat(F.coalesce("properties", F.create_map().cast("map<string,string>")), F.create_map(F.lit("\x00v"), F.lit(""))))
    version = F.when(F.col("version") == "${project.version}", F.col("own_version")).otherwise(resolve_properties("version", "properties"))
    group = F.when(F.col("group_id") == "${project.groupId}", F.col("own_group")).otherwise(resolve_properties("group_id", "properties"))
    return named.select("module", group.alias("group_id"), "artifact_id", version.alias("version"), "scope", "managed", "path")


def maven_chain(modules: DataFrame, depth: int = 10) -> DataFrame:
    """(path, module, properties): properties with those of up to ``depth`` parents below them, so that cycles end.

    A parent is the POM of that group and artifact; of several the one with the
    smallest path. A round goes up by one parent and is written; the rounds end
    when no parent is left.
    """
    scratch = Scratch(modules.sparkSession)
    key = F.struct(F.coalesce("group_id", F.lit("")).alias("g"), F.col("artifact_id").alias("a"))
    up = F.when(F.col("parent").isNotNull(), F.struct(F.coalesce("parent_group", F.lit("")).alias("g"), F.col("parent").alias("a")))
    state = modules.where("artifact_id is not null").select("path", F.col("artifact_id").alias("module"), key.alias("key"), up.alias("up"), "properties")
    poms = scratch.write(state.groupBy("key").agg(F.min(F.struct("path", "up")).alias("f"), F.min_by("properties", "path").alias("_p")).select(F.col("key").alias("up"), F.col("f.up").alias("_up"), "_p"))
    state, found = scratch.counted(state, open=F.count("up"))
    done = 0
    while found["open"] and done < depth:
        merged = F.map_concat(F.map_filter(F.coalesce("_p", F.create_map().cast("map<string,string>")), lambda k, _v: ~F.map_contains_key("properties", k)), "properties")
        following, found = scratch.counted(state.join(poms, "up", "left").select("path", "module", "key", F.col("_up").alias("up"), merged.alias("properties")), open=F.count("up"))
        scratch.drop(state)
        state, done = following, done + 1
    return state.select("path", "module", "properties")


def gradle_dependencies(contents: DataFrame) -> DataFrame:
    """(path, configuration, notation, is_project) of Groovy and Kotlin build files."""
    rows = contents.where("path rlike 'build[.]gradle([.]kts)?$'")
    found = explode_groups(rows, "content", r"(?m)^\s*(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt|compile)[ (]+(?:(project)\()?[\"']([^\"']+)[\"']", ["path"], configuration=1, project=2, notation=3)
    return found.select("path", "configuration", "notation", (F.col("project") == "project").alias("is_project"))


def gradle_includes(contents: DataFrame) -> DataFrame:
    rows = contents.where("path rlike 'settings[.]gradle([.]kts)?$'").select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*include[ (]+(.*?)\)?\s*$"), F.lit(1))).alias("list"))
    return rows.select("path", F.explode(F.regexp_extract_all("list", F.lit(r"[\"']:?([^\"']+)[\"']"), F.lit(1))).alias("module"))


def proto_services(contents: DataFrame) -> DataFrame:
    """(path, package, service, rpc, request, response, request_stream, response_stream)."""
    rows = contents.where("path rlike '[.]proto$'").withColumn("package", F.regexp_extract("content", r"(?m)^package\s+([\w.]+);", 1))
    services = explode_groups(rows, "content", r"(?s)service\s+(\w+)\s*\{(.*?)\n\}", ["path", "package"], service=1, body=2)
    rpcs = explode_groups(services, "body", r"rpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)", ["path", "package", "service"], rpc=1, s1=2, request=3, s2=4, response=5)
    return rpcs.select("path", "package", "service", "rpc", "request", "response", (F.coalesce("s1", F.lit("")) != "").alias("request_stream"), (F.coalesce("s2", F.lit("")) != "").alias("response_stream"))


def proto_messages(contents: DataFrame) -> DataFrame:
    rows = contents.where("path rlike '[.]proto$'")
    messages = explode_groups(rows, "content", r"(?s)message\s+(\w+)\s*\{(.*?)\}", ["path"], message=1, body=2)
    return explode_groups(messages, "body", r"(?m)^\s*(?:repeated\s+|optional\s+)?([\w.<>, ]+)\s+(\w+)\s*=\s*(\d+)", ["path", "message"], type=1, field=2, number=3)


def liquibase_changes(contents: DataFrame) -> DataFrame:
    """(path, id, author, context, change) of XML change logs."""
    rows = contents.where("content like '%<databaseChangeLog%'")
    sets = explode_groups(rows, "content", r"(?s)<changeSet\b([^>]*)>(.*?)</changeSet>", ["path"], head=1, body=2)
    one = lambda name: F.nullif(F.regexp_extract("head", rf"\b{name}=\"([^\"]*)\"", 1), F.lit(""))
    return sets.select("path", one("id").alias("id"), one("author").alias("author"), one("context").alias("context"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"<(createTable|addColumn|dropTable|dropColumn|createIndex|addForeignKeyConstraint|insert|update|sql|renameColumn|modifyDataType)\b"), F.lit(1)))).alias("change"))


def bpmn_elements(contents: DataFrame) -> DataFrame:
    """(path, process, tag, id, name, source_ref, target_ref) of BPMN processes; self-closing elements too."""
    rows = contents.where("content rlike '<(bpmn2?:)?process'")
    processes = explode_groups(rows, "content", r"(?s)<(?:bpmn2?:)?process\b[^>]*?\bid=\"([^\"]+)\"[^>]*>(.*?)</(?:bpmn2?:)?process>", ["path"], process=1, body=2)
    tags = "startEvent|endEvent|userTask|serviceTask|scriptTask|sendTask|receiveTask|manualTask|businessRuleTask|exclusiveGateway|parallelGateway|inclusiveGateway|eventBasedGateway|subProcess|callActivity|boundaryEvent|intermediateCatchEvent|intermediateThrowEvent|task|sequenceFlow"
    found = explode_groups(processes, "body", rf"<(?:bpmn2?:)?({tags})\b([^>]*?)/?>", ["path", "process"], tag=1, head=2)
    one = lambda name: F.nullif(F.regexp_extract("head", rf"\b{name}=\"([^\"]*)\"", 1), F.lit(""))
    return found.select("path", "process", "tag", one("id").alias("id"), one("name").alias("name"), one("sourceRef").alias("source_ref"), one("targetRef").alias("target_ref"))


def drools_rules(contents: DataFrame) -> DataFrame:
    """(path, package, rule, salience, condition, action) of rule files."""
    rows = contents.where("path rlike '[.]drl$'").withColumn("package", F.regexp_extract("content", r"(?m)^package\s+([\w.]+)", 1))
    rules = explode_groups(rows, "content", r"(?s)rule\s+\"([^\"]+)\"(.*?)\bwhen\b(.*?)\bthen\b(.*?)\bend\b", ["path", "package"], rule=1, head=2, condition=3, action=4)
    return rules.select("path", "package", "rule", F.coalesce(F.nullif(F.regexp_extract("head", r"salience\s+(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("salience"), F.regexp_replace("condition", r"^\s+|\s+$", "").alias("condition"), F.regexp_replace("action", r"^\s+|\s+$", "").alias("action"))


def drools_search(rules: DataFrame, term: str) -> DataFrame:
    return rules.where(F.col("rule").ilike(f"%{term}%") | F.col("condition").ilike(f"%{term}%") | F.col("action").ilike(f"%{term}%"))


def gateway_routes(contents: DataFrame) -> DataFrame:
    """(path, id, uri, service, predicates, filters) of gateway routes, each with its own predicates and filters."""
    rows = contents.where("path rlike '[.]ya?ml$' and content like '%gateway:%' and content like '%routes:%'")
    rows = rows.select("path", F.split("content", r"(?m)^\s*- id:\s*").alias("parts"))
    blocks = rows.select("path", F.explode(F.expr("slice(parts, 2, size(parts))")).alias("b"))
    listed = lambda name: F.regexp_extract_all(F.regexp_extract("b", rf"(?m)^\s*{name}:\s*\n((?:\s*- .*\n?)+)", 1), F.lit(r"- ([^\n]+)"), F.lit(1))
    return blocks.select("path", F.regexp_extract("b", r"^(\S+)", 1).alias("id"), F.regexp_extract("b", r"uri:\s*(\S+)", 1).alias("uri"), F.regexp_extract("b", r"uri:\s*(?:lb|https?)://([\w.-]+)", 1).alias("service"), listed("predicates").alias("predicates"), listed("filters").alias("filters"))


def locale_messages(contents: DataFrame) -> DataFrame:
    """(path, locale, key, value) of message files in JSON, nested keys joined by '.'."""
    rows = contents.where("path rlike '(?i)(locales?|i18n|lang)/[^/]*[.]json$'").select("path", F.regexp_extract("path", r"([\w-]+)[.]json$", 1).alias("locale"), F.from_json("content", "map<string,string>").alias("m")).where("m is not null")
    scratch = Scratch(contents.sparkSession)
    is_open = F.col("value").startswith("{") & F.from_json("value", "map<string,string>").isNotNull()
    state, found = scratch.counted(rows.select("path", "locale", F.explode("m").alias("key", "value")), open=F.count_if(is_open))
    while found["open"]:
        nested = F.from_json("value", "map<string,string>")
        grown = F.when(F.col("value").startswith("{") & nested.isNotNull(), F.transform(F.map_entries(nested), lambda e: F.struct(F.concat_ws(".", "key", e["key"]).alias("key"), e["value"].alias("value")))).otherwise(F.array(F.struct("key", "value")))
        state, found = scratch.counted(state.select("path", "locale", F.explode(grown).alias("e")).select("path", "locale", "e.key", "e.value"), open=F.count_if(is_open))
    return state


def vue_template(contents: DataFrame) -> DataFrame:
    """(path, what, name): components, events, slots and directives of Vue templates."""
    rows = contents.where("path rlike '[.]vue$'").select("path", F.regexp_extract("content", r"(?s)<template[^>]*>(.*)</template>", 1).alias("t"))
    get = lambda what, p: F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(1))), lambda x: F.struct(F.lit(what).alias("what"), x.alias("name")))
    parts = F.concat(get("component", r"<([A-Z]\w+|[a-z]+(?:-[a-z]+)+)[\s/>]"), get("event", r"@([\w:.-]+)="), get("slot", r"<slot(?:\s+name=\"([\w-]+)\")?"), get("directive", r"\s(v-[\w-]+)"), get("binding", r"\s:([\w-]+)="))
    return rows.select("path", F.explode(parts).alias("p")).select("path", "p.what", F.coalesce(F.nullif("p.name", F.lit("")), F.lit("default")).alias("name"))


def sql_tables(contents: DataFrame) -> DataFrame:
    """(path, table, column, type) of CREATE TABLE statements."""
    rows = contents.where("content rlike '(?i)create table'")
    tables = explode_groups(rows, "content", r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.]+)[`\"]?\s*\((.*?)\)\s*;", ["path"], table=1, body=2)
    columns = explode_groups(tables, "body", r"(?im)^\s*[`\"]?(\w+)[`\"]?\s+((?!key\b)\w+(?:\([\d, ]+\))?)", ["path", "table"], column=1, type=2)
    return columns.where("lower(column) not in ('primary', 'foreign', 'unique', 'constraint', 'key', 'index', 'check')")


def css_selectors(contents: DataFrame) -> DataFrame:
    rows = contents.where("path rlike '[.](css|scss|less)$'")
    return rows.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([.#][A-Za-z][\w-]*)\s*[,{]"), F.lit(1)))).alias("selector"))


def html_elements(contents: DataFrame) -> DataFrame:
    rows = contents.where("path rlike '[.]html?$'")
    return explode_groups(rows, "content", r"<(\w+)\b[^>]*?\bid=\"([\w-]+)\"", ["path"], tag=1, id=2)


def graphql_operations(contents: DataFrame) -> DataFrame:
    """(path, type, field, returns) of GraphQL schemas."""
    rows = contents.where("path rlike '[.](graphqls?|gql)$'")
    types = explode_groups(rows, "content", r"(?s)(?:type|input|interface)\s+(\w+)[^{]*\{(.*?)\}", ["path"], type=1, body=2)
    return explode_groups(types, "body", r"(?m)^\s*(\w+)(?:\([^)]*\))?\s*:\s*([\w\[\]!]+)", ["path", "type"], field=1, returns=2)


