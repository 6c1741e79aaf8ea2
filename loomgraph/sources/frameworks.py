"""What frameworks leave in sources: annotations, calls and routes, as rules over rows.

A rule is data. One scan finds all annotations (or all matches of all text
rules whose guard words occur), and a join with the rules, a table of fixed
size, turns them into relations; adding a framework adds rows, not scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.lines import annotation_uses, current_contents

# Fixed values: (extractor, annotations, kind of relation, target). In targets, {v} is the first
# text or the ``value``/``name``-like argument, {n} the annotated symbol, {o} its class, {a} the annotation.
ANNOTATION_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("jpa", "Entity|MappedSuperclass", "jpa_entity", "jpa:{n}"),
    ("jpa", "Table", "jpa_table", "database_table:{v}"),
    ("jpa", "OneToMany|ManyToOne|OneToOne|ManyToMany", "jpa_relationship", "jpa:{o}.{n}"),
    ("jpa", "Column|Id|JoinColumn", "jpa_column", "jpa:{o}.{n}"),
    ("jpa_query", "Query", "jpa_query", "query:{o}.{n}"),
    ("jpa_query", "Procedure", "jpa_procedure", "procedure:{v}"),
    ("jpa_query", "Modifying", "jpa_modifying", "query:{o}.{n}"),
    ("repository_rest", "RepositoryRestResource", "repository_rest", "rest:{v}"),
    ("lombok", "Data|Getter|Setter|Builder|Value|ToString|EqualsAndHashCode|NoArgsConstructor|AllArgsConstructor|RequiredArgsConstructor|Slf4j|With|SuperBuilder", "lombok_synthetic", "lombok:{a}:{n}"),
    ("mapstruct", "Mapper", "mapstruct_mapper", "mapper:{n}"),
    ("mapstruct", "Mapping", "mapstruct_mapping", "mapper:{o}.{n}"),
    ("mongo", "Document", "mongo_entity", "mongo:{n}"),
    ("redis", "RedisHash", "redis_hash", "redis:hash:{v}"),
    ("r2dbc", "Table", "r2dbc_entity", "database_table:{v}"),
    ("aop", "Before", "aspect_before", "pointcut:{v}"),
    ("aop", "After", "aspect_after", "pointcut:{v}"),
    ("aop", "Around", "aspect_around", "pointcut:{v}"),
    ("aop", "AfterReturning", "aspect_after_returning", "pointcut:{v}"),
    ("aop", "AfterThrowing", "aspect_after_throwing", "pointcut:{v}"),
    ("aop", "Pointcut", "aspect_pointcut", "pointcut:{v}"),
    ("async", "Async", "async_method", "executor:{v}"),
    ("async", "Scheduled", "scheduled_method", "schedule:{o}.{n}"),
    ("async", "Job|Recurring", "jobrunr_job", "job:{o}.{n}"),
    ("advice", "ControllerAdvice|RestControllerAdvice", "controller_advice", "advice:{n}"),
    ("advice", "ExceptionHandler", "exception_handler", "exception:{v}"),
    ("http_exchange", "HttpExchange|GetExchange|PostExchange|PutExchange|DeleteExchange|PatchExchange", "http_exchange", "httpexchange:{v}"),
    ("security", "PreAuthorize|PostAuthorize|Secured|RolesAllowed|PermitAll|DenyAll", "secured_by", "security:{v}"),
    ("resilience", "CircuitBreaker|Retry|RateLimiter|Bulkhead|TimeLimiter", "resilience_policy", "resilience:{a}:{v}"),
    ("cache", "Cacheable|CacheEvict|CachePut|Caching", "cache_annotation", "cache:{v}"),
    ("profile", "Profile", "profile_activated", "profile:{v}"),
    ("transaction", "Transactional", "transactional", "tx:{o}.{n}"),
    ("config", "ConfigurationProperties", "config_binding", "config:{v}"),
    ("config", "Value", "value_inject", "config:{v}"),
    ("actuator", "Endpoint|RestControllerEndpoint|WebEndpoint", "actuator_endpoint", "actuator:{v}"),
    ("beans", "Component|Service|Repository|Controller|RestController|Configuration", "stereotype", "stereotype:{a}"),
    ("beans", "Autowired|Inject|Resource", "injects", "bean:{n}"),
    ("beans", "Bean", "provides_bean", "bean:{n}"),
    ("autoconfig", "AutoConfigureAfter", "auto_configure_after", "class:{v}"),
    ("autoconfig", "AutoConfigureBefore", "auto_configure_before", "class:{v}"),
    ("autoconfig", "ConditionalOnProperty|ConditionalOnClass|ConditionalOnMissingBean|ConditionalOnBean|ConditionalOnExpression", "conditional_config", "condition:{a}:{v}"),
    ("cloud_config", "RefreshScope", "cloud_config_ref", "config:{n}"),
    ("loadbalancer", "LoadBalanced", "load_balanced", "client:{n}"),
    ("stream", "StreamListener|EnableBinding", "stream_function", "channel:{v}"),
    ("observability", "Observed|Timed|Counted", "observation_point", "metric:{v}"),
    ("integration", "ServiceActivator|Transformer|Splitter|Aggregator|Filter|Router|Gateway|InboundChannelAdapter", "integration_endpoint", "channel:{v}"),
    ("batch", "EnableBatchProcessing|StepScope|JobScope", "batch_job", "batch:{n}"),
    ("ldap", "Entry", "ldap_entry", "ldap:{n}"),
    ("session", "EnableRedisHttpSession|EnableJdbcHttpSession|EnableSpringHttpSession", "spring_session", "session:{a}"),
    ("graphql", "QueryMapping|MutationMapping|SubscriptionMapping|SchemaMapping|BatchMapping", "graphql_handler", "graphql:{n}"),
    ("websocket", "MessageMapping|SubscribeMapping|SendTo|SendToUser|ServerEndpoint", "websocket_handler", "websocket:{v}"),
    ("queue", "KafkaListener", "subscribes_to", "topic:{v}"),
    ("queue", "RabbitListener", "subscribes_to", "queue:{v}"),
    ("queue", "JmsListener", "subscribes_to", "queue:{v}"),
    ("feign", "FeignClient", "feign_client", "service:{v}"),
    ("grpc", "GrpcService|GrpcClient", "grpc_stub", "grpc:{v}"),
    ("test", "SpringBootTest|WebMvcTest|DataJpaTest|ExtendWith|RunWith", "test_class", "test:{n}"),
    ("test", "MockBean|SpyBean|Mock|InjectMocks", "mock_replaces", "mock:{n}"),
    ("events", "EventListener|TransactionalEventListener", "event_listener", "event:{n}"),
    ("routes", "GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping", "route", "route:{v}"),
)

# Fixed values: (extractor, guard word, paths, pattern, kind of relation, target prefix); group 1 names the target.
TEXT_RULES: tuple[tuple[str, str, str, str, str, str], ...] = (
    ("redis_template", "redisTemplate", r"[.](java|kt)$", r"redisTemplate\s*\.\s*(opsFor\w+)\s*\(", "redis_operation", "redis:template:"),
    ("mongo_template", "mongoTemplate", r"[.](java|kt)$", r"mongoTemplate\s*\.\s*(\w+)\s*\(", "mongo_operation", "mongo:template:"),
    ("jooq", "dsl", r"[.](java|kt)$", r"\.(?:selectFrom|insertInto|update|deleteFrom|from)\(\s*(?:Tables\.)?([A-Z_]{2,})", "jooq_table_access", "database_table:"),
    ("jdbc", "jdbcTemplate", r"[.](java|kt)$", r"(?is)jdbcTemplate\.\w+\(\s*\"\s*(?:select .*? from|insert into|update|delete from)\s+(\w+)", "maps_to", "mysql:table:"),
    ("interceptor", "HandlerInterceptor", r"[.](java|kt)$", r"class\s+(\w+)\s+implements\s+[\w, ]*(?:HandlerInterceptor|Filter|WebFilter)", "interceptor", "interceptor:"),
    ("security_filter", "HttpSecurity", r"[.](java|kt)$", r"(?:requestMatchers|antMatchers|mvcMatchers|pathMatchers)\(([^)]*)\)\s*\.\s*\w+", "security_filter_rule", "security:"),
    ("security_ignore", "WebSecurityCustomizer", r"[.](java|kt)$", r"ignoring\(\)\s*\.\s*(?:requestMatchers|antMatchers)\(([^)]*)\)", "security_ignored", "security:"),
    ("stream_bridge", "StreamBridge", r"[.](java|kt)$", r"streamBridge\.send\(\s*\"([^\"]+)\"", "publishes_to", "topic:"),
    ("stream_bean", "java.util.function", r"[.](java|kt)$", r"@Bean\s+(?:public\s+)?(?:Function|Consumer|Supplier)<[^{]*?>\s+(\w+)\s*\(", "stream_function", "function:"),
    ("kafka_send", "kafkaTemplate", r"[.](java|kt)$", r"kafkaTemplate\.send\(\s*\"([^\"]+)\"", "publishes_to", "topic:"),
    ("rabbit_send", "rabbitTemplate", r"[.](java|kt)$", r"rabbitTemplate\.convertAndSend\(\s*\"([^\"]+)\"", "publishes_to", "queue:"),
    ("lb_uri", "lb://", r"[.](java|kt|ya?ml)$", r"lb://([\w-]+)", "load_balanced_uri", "service:"),
    ("rest_template", "restTemplate", r"[.](java|kt)$", r"restTemplate\s*\.\s*\w+\(\s*\"(https?://[^\"]+)\"", "http_request", "url:"),
    ("web_client", ".uri(", r"[.](java|kt)$", r"\.uri\(\s*\"([^\"]+)\"", "http_request", "url:"),
    ("event_publish", "publishEvent", r"[.](java|kt)$", r"publishEvent\(\s*new\s+(\w+)\s*\(", "publishes_event", "event:"),
    ("react", "react", r"[.](tsx|jsx)$", r"(?:function|const)\s+([A-Z]\w+)\s*(?:=\s*\(|\()", "react_component", "react:component:"),
    ("react_hook", "use", r"[.](tsx?|jsx?)$", r"\b(use[A-Z]\w+)\s*\(", "react_hook", "react:hook:"),
    ("redux", "createSlice", r"[.](tsx?|jsx?)$", r"createSlice\(\s*\{\s*name:\s*['\"]([\w-]+)", "react_store", "react:store:"),
    ("zustand", "zustand", r"[.](tsx?|jsx?)$", r"const\s+(use\w+)\s*=\s*create[(<]", "react_store", "react:store:"),
    ("react_query", "useQuery", r"[.](tsx?|jsx?)$", r"use(?:Query|Mutation)\(\s*\{?\s*(?:queryKey:\s*)?\[?\s*['\"]([\w-]+)", "react_query", "react:query:"),
    ("pinia", "defineStore", r"[.](ts|js|vue)$", r"defineStore\(\s*['\"]([\w-]+)", "pinia_store", "pinia:"),
    ("vue_api", "/", r"[.](vue|ts|js)$", r"(?:axios|http|request|fetch|useFetch)(?:\.\w+)?\(\s*[`'\"]([^`'\"]+)", "api_call", "url:"),
    ("vue_i18n", "$t(", r"[.](vue|ts|js)$", r"\$?\bt\(\s*['\"]([\w.-]+)['\"]", "i18n_usage", "i18n:"),
)

# Fixed values: (framework, paths, pattern, verb or 0 for group 1, path group).
ROUTE_RULES: tuple[tuple[str, str, str, str | int, int], ...] = (
    ("express", r"[.](js|ts|mjs)$", r"\b(?:app|router)\.(get|post|put|delete|patch|all)\(\s*['\"`]([^'\"`]+)", 0, 2),
    ("fastify", r"[.](js|ts|mjs)$", r"\bfastify\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)", 0, 2),
    ("koa", r"[.](js|ts|mjs)$", r"\bkoaRouter\.(get|post|put|delete|patch|del)\(\s*['\"`]([^'\"`]+)", 0, 2),
    ("nest", r"[.]ts$", r"@(Get|Post|Put|Delete|Patch|All)\(\s*['\"`]([^'\"`]*)", 0, 2),
    ("react_router", r"[.](tsx|jsx)$", r"<Route\b[^>]*?\bpath=\{?(['\"])([^'\"]+)", "GET", 2),
    ("vue_router", r"router[^/]*[.](ts|js)$", r"path:\s*(['\"])([^'\"]+)['\"]", "GET", 2),
    ("django", r"urls[.]py$", r"\b(path|re_path|url)\(\s*r?['\"]([^'\"]*)", "ANY", 2),
    ("flask", r"[.]py$", r"@\w+\.(route|get|post|put|delete|patch)\(\s*['\"]([^'\"]+)", 0, 2),
    ("rails", r"routes[.]rb$", r"(?m)^\s*(get|post|put|delete|patch|resources?)\s+['\":]+([\w/:-]+)", 0, 2),
    ("gin", r"[.]go$", r"\.(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)", 0, 2),
    ("laravel", r"[.]php$", r"Route::(get|post|put|delete|patch|any)\(\s*['\"]([^'\"]+)", 0, 2),
    ("aspnet", r"[.]cs$", r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\"([^\"]*)\")?", 0, 2),
    ("spring", r"[.](java|kt)$", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\{?\s*\"([^\"]*)", 0, 2),
    ("webflux", r"[.](java|kt)$", r"\b(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)\"", 0, 2),
)

def _bare(value: Column) -> Column:
    """Without the braces of a list and the quotes of a text."""
    listed = F.regexp_replace(F.trim(value), r"^\{\s*([\s\S]*?)\s*\}$", "$1")
    return F.trim(F.regexp_replace(listed, r"^\"|\"$", ""))


def arguments(column: str) -> Column:
    """All ``name = value`` arguments as a map, the single text or bare argument as ``value``."""
    text = F.col(column)
    names = F.regexp_extract_all(text, F.lit(r"(\w+)\s*=\s*(?:\{[^}]*\}|\"(?:[^\"\\]|\\.)*\"|[^,(){}]+(?:\([^)]*\))?)"), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"\w+\s*=\s*(\{[^}]*\}|\"(?:[^\"\\]|\\.)*\"|[^,(){}]+(?:\([^)]*\))?)"), F.lit(1)), _bare)
    single = _bare(text)
    unique = F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("k"), values.alias("v"))))
    return F.when(F.trim(text) == "", F.create_map().cast("map<string,string>")).when(F.size(names) > 0, unique).otherwise(F.create_map(F.lit("value"), single))


# Arguments that name what an annotation is about, in order.
NAMING = ("value", "name", "topics", "queues", "destination", "path", "prefix", "cacheNames", "collection", "url", "pointcut", "serviceId", "inputChannel")


def annotation_relations(files: DataFrame) -> DataFrame:
    """(extractor, source, target, kind, metadata, path, line, annotation) of all annotations that rules know.

    Two rules may read one annotation (a table of JPA or of R2DBC); the guard
    that tells them apart is the other annotations of the class.
    """
    uses = annotation_uses(files).withColumn("m", F.map_filter(arguments("args"), lambda _k, v: v.isNotNull()))
    rules = F.array(*[F.struct(F.lit(e).alias("extractor"), F.lit(a).alias("annotations"), F.lit(k).alias("kind"), F.lit(t).alias("template")) for e, a, k, t in ANNOTATION_RULES])
    fitting = F.filter(rules, lambda r: F.array_contains(F.split(r["annotations"], r"\|"), F.col("annotation")))
    rows = uses.select("*", F.explode(fitting).alias("r"))
    value = F.coalesce(*[F.col("m")[n] for n in NAMING], F.lit(""))
    name, owner = F.coalesce("name", F.lit("")), F.coalesce("owner", "name", F.lit(""))
    target = F.col("r.template")
    for mark, column in (("{v}", value), ("{n}", name), ("{o}", owner), ("{a}", F.col("annotation"))):
        target = F.replace(target, F.lit(mark), column)
    source = F.concat_ws(":", "path", "name", F.col("symbol_line").cast("string"))
    return rows.select("r.extractor", source.alias("source"), target.alias("target"), F.col("r.kind").alias("kind"), F.to_json("m").alias("metadata"), "path", "line", "annotation", "name", "owner")


def _as_relation(extractor: str, prefix: str, kind: str):
    return lambda m: F.struct(F.lit(extractor).alias("extractor"), F.concat(F.lit(prefix), m).alias("target"), F.lit(kind).alias("kind"))


def _as_route(framework: str, verb: str | int):
    method = lambda a: F.upper(a["v"]) if verb == 0 else F.lit(verb)
    return lambda a, p: F.struct(F.lit(framework).alias("framework"), method(a).alias("method"), F.coalesce(p, F.lit("")).alias("route"), a["w"].alias("matched"))


def text_relations(files: DataFrame) -> DataFrame:
    """(extractor, source, target, kind, path) of all matches of the text rules; guard words are looked for first."""
    contents = current_contents(files)
    found = []
    for extractor, guard, where, pattern, kind, prefix in TEXT_RULES:
        matches = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
        hit = F.col("path").rlike(where) & F.contains("content", F.lit(guard))
        found.append(F.when(hit, F.transform(matches, _as_relation(extractor, prefix, kind))).otherwise(F.array().cast("array<struct<extractor:string,target:string,kind:string>>")))
    rows = contents.select("path", F.explode(F.flatten(F.array(*found))).alias("r"))
    return rows.select("r.extractor", F.col("path").alias("source"), "r.target", "r.kind", "path")


def routes(files: DataFrame) -> DataFrame:
    """(framework, method, route, path, line) of all route declarations, with the prefix of the class where there is one."""
    contents = current_contents(files)
    parts = []
    for framework, where, pattern, verb, group in ROUTE_RULES:
        verbs = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        paths = F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
        whole = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        named = F.zip_with(F.arrays_zip(verbs.alias("v"), whole.alias("w")), paths, _as_route(framework, verb))
        parts.append(F.when(F.col("path").rlike(where), named).otherwise(F.array().cast("array<struct<framework:string,method:string,route:string,matched:string>>")))
    rows = contents.select("path", "content", F.explode(F.flatten(F.array(*parts))).alias("r")).select("path", "content", "r.*")
    line = F.size(F.split(F.expr("substring(content, 1, greatest(instr(content, matched) - 1, 0))"), "\n"))
    method = F.when(F.col("method").isin("ROUTE", "ALL", "REQUEST", "RESOURCES", "RESOURCE"), "ANY").when(F.col("method") == "DEL", "DELETE").otherwise(F.col("method"))
    prefix = F.when(F.col("framework") == "spring", F.regexp_extract("content", r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"\s*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+)?class", 1)).when(F.col("framework") == "nest", F.regexp_extract("content", r"@Controller\(\s*['\"]([^'\"]*)", 1)).otherwise("")
    joined = F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), "route"), "/+", "/")
    shown = F.when(F.col("framework").isin("spring", "nest"), F.when(F.length(joined) > 1, F.regexp_replace(joined, "/$", "")).otherwise(joined)).otherwise(F.col("route"))
    declared = rows.select("framework", method.alias("method"), shown.alias("route"), "path", line.alias("line"))
    return declared.unionByName(page_routes(contents))


def page_routes(contents: DataFrame) -> DataFrame:
    """Routes that a file's place declares: pages of Next and Nuxt."""
    page = F.regexp_extract("path", r"(?:^|/)(?:src/)?(?:pages|app)/(.*?)(?:/(?:page|index))?[.](?:tsx|jsx|vue)$", 1)
    rows = contents.where("path rlike '(^|/)(pages|app)/.*[.](tsx|jsx|vue)$'").select("path", page.alias("p")).where("p != ''")
    route = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("p", r"\[\.\.\.(\w+)\]", "*$1"), r"\[(\w+)\]", ":$1"))
    return rows.select(F.when(F.col("path").endswith(".vue"), "nuxt").otherwise("next").alias("framework"), F.lit("GET").alias("method"), F.regexp_replace(route, "/index$", "").alias("route"), "path", F.lit(1).alias("line"))


def http_references(files: DataFrame) -> DataFrame:
    """(source, target_service, url, kind): literal requests, once per place, with the service their host names."""
    rows = text_relations(files).where("kind in ('http_request', 'api_call')").withColumn("url", F.expr("substr(target, 5)")).dropDuplicates(["source", "url"])
    return rows.select("source", F.nullif(F.regexp_extract("url", r"^https?://([\w.-]+)", 1), F.lit("")).alias("target_service"), "url", "kind")


def feign_references(files: DataFrame) -> DataFrame:
    """(client, service, method, verb, route): methods of declared clients."""
    rows = annotation_relations(files)
    clients = rows.where("kind = 'feign_client'").select("path", F.col("name").alias("client"), F.expr("substr(target, 9)").alias("service"))
    methods = rows.where("kind = 'route'").select("path", F.col("owner").alias("client"), F.col("name").alias("method"), F.upper(F.regexp_extract("annotation", "^(\\w+)Mapping$", 1)).alias("verb"), F.expr("substr(target, 7)").alias("route"))
    return clients.join(methods, ["path", "client"], "left").select("client", "service", "method", "verb", "route")


def lombok_members(files: DataFrame) -> DataFrame:
    """(class, member, from_annotation): members that Lombok adds to the fields of a class."""
    from loomgraph.functions.text import getter_name, setter_name
    from loomgraph.sources.lines import scoped, source_lines

    marked = annotation_relations(files).where("extractor = 'lombok'").select("path", F.coalesce("name", F.lit("")).alias("owner"), "annotation")
    fields = scoped(source_lines(current_contents(files).where("language = 'java'"))).where("kind = 'field'").select("path", "owner", "name", "text")
    boolean = F.when(F.col("text").rlike(r"\bboolean\b"), F.regexp_replace(getter_name("name"), "^get", "is")).otherwise(getter_name("name"))
    both = marked.join(fields, ["path", "owner"])
    getters = both.where("annotation in ('Data', 'Getter', 'Value')").select("owner", boolean.alias("member"), "annotation")
    setters = both.where("annotation in ('Data', 'Setter') and not text rlike '\\\\bfinal\\\\b'").select("owner", setter_name("name").alias("member"), "annotation")
    whole = F.create_map(*[F.lit(x) for x in ("Builder", "builder", "SuperBuilder", "builder", "ToString", "toString", "EqualsAndHashCode", "equals,hashCode", "Slf4j", "log", "NoArgsConstructor", "<init>", "AllArgsConstructor", "<init>", "RequiredArgsConstructor", "<init>", "Data", "toString,equals,hashCode")])
    others = marked.select("owner", F.explode(F.split(whole[F.col("annotation")], ",")).alias("member"), "annotation")
    return getters.unionByName(setters).unionByName(others).select(F.col("owner").alias("class"), "member", F.col("annotation").alias("from_annotation")).distinct()


def queue_bindings(files: DataFrame) -> DataFrame:
    """(topic, publisher, subscriber): both ends joined on the topic, across files."""
    a = text_relations(files).where("kind = 'publishes_to'").select(F.col("target").alias("topic"), F.col("source").alias("publisher"))
    b = annotation_relations(files).where("kind = 'subscribes_to'").select(F.col("target").alias("topic"), F.col("source").alias("subscriber"))
    return a.distinct().join(b.distinct(), "topic", "full")


def guards(content: str, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs: a cheap test before an expensive pattern."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(F.col(content), F.lit(word))
    return test


# Frameworks by telling words, with the confidence of the finding.
FRAMEWORKS = (("spring", ("org.springframework",), 0.9), ("vue", ("<script setup", "from 'vue'", 'from "vue"'), 0.9), ("react", ("from 'react'", 'from "react"'), 0.9), ("express", ("require('express')", "from 'express'"), 0.8), ("django", ("from django",), 0.9), ("flask", ("from flask",), 0.9))


def detected_frameworks(files: DataFrame) -> DataFrame:
    """(repository, framework, confidence, n_files)."""
    rows = current_contents(files).withColumn("repository", F.array_join(F.slice(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), 1, 2), "/"))
    hits = F.filter(F.array(*[F.when(guards("content", words), F.struct(F.lit(name).alias("framework"), F.lit(c).alias("confidence"))) for name, words, c in FRAMEWORKS]), lambda x: x.isNotNull())
    return rows.select("repository", F.explode(hits).alias("h")).groupBy("repository", "h.framework", "h.confidence").agg(F.count("*").alias("n_files"))
