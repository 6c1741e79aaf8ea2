"""Parsers of sources and configuration on small inputs."""

import pytest

from loomgraph.sources import formats, frameworks, infrastructure, lines

JAVA = '''package com.app;

import java.util.List;
import com.app.data.UserRepository;

/**
 * Keeps users.
 */
@Service
@Transactional(propagation = Propagation.REQUIRES_NEW, readOnly = true)
public class UserService extends BaseService implements Users, Closeable {
    @Autowired
    private UserRepository userRepository;

    @Value("${app.limit:10}")
    private int limit;

    @Cacheable(cacheNames = "users", key = "#id")
    public User find(long id) {
        if (id > 0) {
            return userRepository.load(id);
        }
        return null;
    }

    @KafkaListener(topics = "users.created")
    public void onCreated(String message) {
        kafkaTemplate.send("users.indexed", message);
    }
}
'''
CONTROLLER = '''@RestController
@RequestMapping("/api/orders")
public class OrderController {
    @GetMapping("/{id}")
    public Order one(@PathVariable long id) {
        return restTemplate.getForObject("http://user-service/api/users/" + id, Order.class);
    }

    @PostMapping("/new")
    public void create() {
    }
}
'''
FILES = {
    "svc/a/UserService.java": JAVA,
    "svc/a/OrderController.java": CONTROLLER,
    "svc/a/User.java": '@Entity\n@Table(name="users")\n@Data\npublic class User {\n    private String name;\n    private final boolean active;\n    @OneToMany\n    private List<Order> orders;\n}\n',
    "svc/a/Client.java": '@FeignClient(name = "billing", path = "/bills")\npublic interface BillClient {\n    @GetMapping("/open")\n    List<Bill> open();\n}\n',
    "svc/web/app.ts": "import { x } from './x'\n\nexport class Shop extends Base {\n  load(id: number) {\n    return fetch('/api/orders/1')\n  }\n}\nexport function open(a: string) {\n  return a\n}\nconst go = (a) => a\napp.get('/items', go)\n",
    "svc/web/tool.py": "from flask import Flask\n\nclass Tool:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n\n@app.route('/health')\ndef health():\n    return 'ok'\n",
    "svc/k/Main.kt": "package a\n\nclass Main {\n    fun start(x: Int) {\n        val y = go(x)\n    }\n}\n",
    "svc/web/Page.vue": '<template>\n  <UserCard :user="u" @save="store" v-if="u"><slot name="foot"/></UserCard>\n</template>\n<script>\naxios.get("/api/orders/123")\n$t("page.title")\n</script>\n',
    "svc/a/application.yml": "server:\n  port: 80\nspring:\n  cloud:\n    gateway:\n      routes:\n        - id: users\n          uri: lb://user-service\n          predicates:\n            - Path=/users/**\n          filters:\n            - StripPrefix=1\n        - id: bills\n          uri: lb://billing\n          predicates:\n            - Path=/bills/**\n",
    "svc/a/application-prod.yml": "server:\n  port: 443\n",
    "svc/a/application.properties": "# c\nserver.port=8080\nname = a=b\n",
    "svc/a/mapper/UserMapper.xml": '<mapper namespace="com.app.UserMapper">\n<select id="byId" resultType="x">select *\n from users</select>\n<delete id="drop">delete from users</delete></mapper>',
    "svc/k8s/app.yaml": "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: shop\n  labels:\n    app: shop\n    tier: web\nspec:\n  replicas: 3\n  template:\n    spec:\n      containers:\n        - image: shop:1.2\n          ports:\n            - containerPort: 8080\n---\napiVersion: v1\nkind: Service\nmetadata:\n  name: shop\nspec:\n  selector:\n    app: shop\n  ports:\n    - port: 80\n",
    "svc/docker-compose.yml": "services:\n  db:\n    image: postgres:16\n    ports:\n      - \"5432:5432\"\n  web:\n    image: shop\n    depends_on:\n      - db\n",
    "svc/Dockerfile": "FROM eclipse-temurin:21\nENV A=1\nEXPOSE 8080\n",
    "svc/pom.xml": "<project><parent><groupId>com.app</groupId><artifactId>root</artifactId><version>1.0</version></parent><artifactId>shop</artifactId><properties><v.json>2.1</v.json><v.alias>${v.json}</v.alias></properties><modules><module>core</module></modules><dependencies><dependency><groupId>org.json</groupId><artifactId>json</artifactId><version>${v.alias}</version></dependency><dependency><groupId>x</groupId><artifactId>y</artifactId><version>${v.up}</version><scope>test</scope></dependency></dependencies></project>",
    "svc/root/pom.xml": "<project><groupId>com.app</groupId><artifactId>root</artifactId><version>1.0</version><properties><v.up>9</v.up></properties></project>",
    "svc/build.gradle": "dependencies {\n    implementation 'a:b:1'\n    api project(':core')\n}\n",
    "svc/settings.gradle": "include ':core', ':web'\n",
    "svc/a.proto": "package shop;\nservice Shop {\n  rpc Get (Req) returns (Res);\n  rpc Feed (stream Req) returns (stream Res);\n}\nmessage Req {\n  string id = 1;\n  repeated int32 n = 2;\n}\n",
    "svc/log.xml": '<databaseChangeLog><changeSet id="1" author="ann"><createTable tableName="t"/><addColumn/></changeSet></databaseChangeLog>',
    "svc/p.bpmn": '<process id="order"><startEvent id="s"/><userTask id="u" name="Check"></userTask><sequenceFlow id="f" sourceRef="s" targetRef="u"/></process>',
    "svc/r.drl": 'package rules\nrule "Big order"\n salience 10\n when\n  Order(total > 100)\n then\n  apply();\nend\n',
    "svc/locales/en.json": '{"page": {"title": "Hi", "sub": {"x": "y"}}, "ok": "OK"}',
    "svc/api.json": '{"openapi": "3.0", "paths": {"/a": {"get": {"operationId": "getA"}, "post": {}}}}',
    "svc/s.graphql": "type Query {\n  user(id: ID!): User!\n  all: [User]\n}\n",
    "svc/t.sql": "CREATE TABLE users (\n  id bigint,\n  name varchar(20),\n  PRIMARY KEY (id)\n);\n",
    "svc/c.css": ".btn { color: red }\n#top, .nav { }\n",
    "svc/i.html": '<div id="main"><p id="x"></p></div>',
}


@pytest.fixture(scope="module")
def files(spark):
    language = {"java": "java", "kt": "kotlin", "ts": "typescript", "py": "python", "vue": "vue"}
    rows = [(p, language.get(p.rsplit(".")[-1], "other"), "h", 1, c) for p, c in FILES.items()] + [("svc/a/User.java", "java", "old", 0, "class Old {}"), ("empty.java", "java", "e", 1, ""), ("null.java", "java", "n", 1, None)]
    return spark.createDataFrame(rows, "path string, language string, content_hash string, indexed_at bigint, content string")


@pytest.fixture(scope="module")
def contents(files):
    return lines.current_contents(files)


def rows_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_nodes(files):
    found = rows_of(lines.parsed_nodes(files), "kind", "name", "qualified_name", "start_line", "end_line")
    assert ("class", "UserService", "UserService", 11, 30) in found
    assert ("method", "find", "UserService.find", 19, 24) in found
    assert ("field", "limit", "UserService.limit", 16, 16) in found
    assert ("class", "Shop", "Shop", 3, 7) in found and ("method", "load", "Shop.load", 4, 6) in found
    assert ("function", "open", "open", 8, 10) in found
    assert ("method", "run", "Tool.run", 4, 6) in found or ("method", "run", "Tool.run", 4, 5) in found
    assert ("function", "start", "Main.start", 4, 6) in found
    assert not any(name == "Old" for _, name, *_ in found)


def test_edges(files):
    found = rows_of(lines.parsed_edges(files), "source", "target", "kind")
    assert ("svc/a/UserService.java:UserService:11", "svc/a/UserService.java:find:19", "contains") in found
    assert ("svc/a/UserService.java:find:19", "svc/a/UserService.java:load", "calls") in found
    assert ("svc/a/UserService.java:UserService:11", "BaseService", "extends") in found
    assert ("svc/a/UserService.java:UserService:11", "Closeable", "implements") in found
    assert ("svc/a/UserService.java:module", "com.app.data.UserRepository", "imports") in found
    assert ("svc/web/app.ts:module", "./x", "imports") in found


def test_annotations_and_docs(files):
    found = rows_of(lines.annotation_uses(files), "annotation", "name", "owner")
    assert ("Service", "UserService", None) in found and ("Autowired", "userRepository", "UserService") in found and ("KafkaListener", "onCreated", "UserService") in found
    assert ("svc/a/UserService.java", 11, "UserService", "Keeps users.") in rows_of(lines.doc_comments(files), "path", "line", "name", "docstring")


def test_framework_relations(files):
    found = rows_of(frameworks.annotation_relations(files), "kind", "target")
    assert {("jpa_entity", "jpa:User"), ("jpa_table", "database_table:users"), ("jpa_relationship", "jpa:User.orders"), ("cache_annotation", "cache:users"), ("subscribes_to", "topic:users.created"), ("feign_client", "service:billing"), ("value_inject", "config:${app.limit:10}"), ("injects", "bean:userRepository"), ("stereotype", "stereotype:Service")} <= found
    texts = rows_of(frameworks.text_relations(files), "kind", "target")
    assert ("publishes_to", "topic:users.indexed") in texts and ("http_request", "url:http://user-service/api/users/") in texts and ("i18n_usage", "i18n:page.title") in texts and ("api_call", "url:/api/orders/123") in texts


def test_routes(files):
    found = rows_of(frameworks.routes(files), "framework", "method", "route")
    assert ("spring", "GET", "/api/orders/{id}") in found and ("spring", "POST", "/api/orders/new") in found
    assert ("express", "GET", "/items") in found and ("flask", "ANY", "/health") in found


def test_references_of_services(files):
    assert ("user-service", "http://user-service/api/users/") in rows_of(frameworks.http_references(files), "target_service", "url")
    assert ("BillClient", "billing", "open", "GET", "/open") in rows_of(frameworks.feign_references(files), "client", "service", "method", "verb", "route")
    members = rows_of(frameworks.lombok_members(files), "class", "member")
    assert {("User", "getName"), ("User", "isActive"), ("User", "setName"), ("User", "toString")} <= members and ("User", "setActive") not in members


def test_yaml_and_properties(contents):
    found = rows_of(formats.yaml_entries(contents), "path", "key", "value")
    assert ("svc/a/application.yml", "server.port", "80") in found and ("svc/a/application.yml", "spring.cloud.gateway.routes.1.uri", "lb://billing") in found
    assert ("svc/a/application.properties", "name", "a=b") in rows_of(formats.property_entries(contents), "path", "key", "value")
    entries = formats.yaml_entries(contents).unionByName(formats.property_entries(contents)).where("path like 'svc/a/application%'")
    assert ("svc/a", "server.port", "443") in rows_of(formats.config_cascade(entries, ["prod"]), "module", "key", "value")
    assert ("svc/a", "server.port", "80") in rows_of(formats.config_cascade(entries, []), "module", "key", "value")


def test_yaml_stack():
    text = "a:\n  b: 1\n  c:\n    - x\n    - y: 2\n      z: 3\nd: |\n  text: no\ne: 'q' # c\n"
    assert flat(text) == {"a": "", "a.b": "1", "a.c": "", "a.c.0": "x", "a.c.1.y": "2", "a.c.1.z": "3", "e": "q"}


def flat(text):
    return {k: v for k, v, _ in formats.flatten_yaml(text)}


def test_formats(contents):
    assert ("com.app.UserMapper", "select", "byId", "select * from users") in rows_of(formats.mapper_statements(contents), "namespace", "verb", "id", "sql")
    assert rows_of(formats.openapi_endpoints(contents), "method", "route") == {("GET", "/a"), ("POST", "/a")}
    k8s = {r.kind: r for r in formats.kubernetes_resources(contents).collect()}
    assert k8s["Deployment"].image == "shop:1.2" and k8s["Deployment"].replicas == 3 and k8s["Deployment"].labels == {"app": "shop", "tier": "web"} and k8s["Service"].selector == {"app": "shop"}
    compose = {r.name: r for r in formats.compose_services(contents).collect()}
    assert compose["db"].image == "postgres:16" and compose["web"].depends_on == ["db"]
    assert formats.dockerfile(contents).first().ports == ["8080"]
    assert rows_of(formats.gateway_routes(contents), "id", "service") == {("users", "user-service"), ("bills", "billing")}
    assert {r.id: r.predicates for r in formats.gateway_routes(contents).collect()}["bills"] == ["Path=/bills/**"]
    assert rows_of(formats.gradle_dependencies(contents), "configuration", "notation", "is_project") == {("implementation", "a:b:1", False), ("api", ":core", True)}
    assert rows_of(formats.gradle_includes(contents), "module") == {("core",), ("web",)}
    assert ("Shop", "Feed", True, True) in rows_of(formats.proto_services(contents), "service", "rpc", "request_stream", "response_stream")
    assert ("Req", "n", "2") in rows_of(formats.proto_messages(contents), "message", "field", "number")
    assert rows_of(formats.liquibase_changes(contents), "id", "author", "change") == {("1", "ann", "createTable"), ("1", "ann", "addColumn")}
    assert ("order", "sequenceFlow", "f", "s", "u") in rows_of(formats.bpmn_elements(contents), "process", "tag", "id", "source_ref", "target_ref")
    rules = formats.drools_rules(contents)
    assert ("Big order", 10, "Order(total > 100)") in rows_of(rules, "rule", "salience", "condition") and formats.drools_search(rules, "APPLY").count() == 1
    assert rows_of(formats.locale_messages(contents), "key", "value") == {("page.title", "Hi"), ("page.sub.x", "y"), ("ok", "OK")}
    assert {("component", "UserCard"), ("event", "save"), ("slot", "foot"), ("binding", "user"), ("directive", "v-if")} <= rows_of(formats.vue_template(contents), "what", "name")
    assert rows_of(formats.sql_tables(contents), "table", "column") == {("users", "id"), ("users", "name")}
    assert ("Query", "user", "User!") in rows_of(formats.graphql_operations(contents), "type", "field", "returns")
    assert (".btn",) in rows_of(formats.css_selectors(contents), "selector") and ("p", "x") in rows_of(formats.html_elements(contents), "tag", "id")


def test_maven(contents):
    found = rows_of(formats.maven_dependencies(contents), "module", "artifact_id", "version", "scope")
    assert ("shop", "json", "2.1", "compile") in found and ("shop", "y", "9", "test") in found
    assert rows_of(formats.maven_modules(contents), "artifact_id", "version", "parent") == {("shop", "1.0", "root"), ("root", "1.0", None)}


def test_infrastructure(files):
    found = rows_of(infrastructure.infrastructure_relations(files), "source", "target", "kind")
    assert {
        ("docker:web", "docker:db", "depends_on"), ("docker:db", "image:postgres:16", "deploy_mapping"), ("k8s:Deployment:default:shop", "image:shop:1.2", "k8s_deployment"), ("k8s:Service:default:shop", "k8s:Deployment:default:shop", "k8s_service_binding"),
        ("pom:shop", "pom:json", "maven_depends_on"), ("pom:shop", "pom:core", "maven_submodule"), ("gradle:svc/build.gradle", "gradle:project:core", "gradle_depends_on"), ("svc/api.json", "openapi:GET:/a", "api_contract"),
        ("grpc:shop:Shop", "grpc:shop:Shop:Get", "grpc_call"), ("grpc:shop:Shop:Feed", "grpc:message:Req", "grpc_message"), ("gateway:bills", "service:billing", "routes_to"), ("com.app.UserMapper.byId", "mybatis:com.app.UserMapper:byId", "mybatis_mapping"),
        ("mybatis:com.app.UserMapper:byId", "mysql:table:users", "maps_to"), ("bpmn:order:s", "bpmn:order:u", "bpmn_flow"), ("drools:rules", "drools:rules:Big order", "drools_rule"), ("svc/web/Page.vue", "i18n:en:page.title", "i18n_usage"),
        ("svc/web/Page.vue", "svc/a/OrderController.java", "api_mapping"),
    } <= found


def test_inventories(files):
    from loomgraph.operators import summaries

    relations = infrastructure.infrastructure_relations(files).select("source", "target", "kind", "metadata").unionByName(frameworks.annotation_relations(files).select("source", "target", "kind", "metadata"))
    counts = {r.name: r.n_relations for r in summaries.inventory_counts(relations).collect()}
    assert {"mybatis_mappings", "gateway_routes", "k8s_services", "maven_modules", "grpc_services", "jpa_entities", "transactions", "routing_manifest", "config_bindings"} <= set(counts)
    rows = summaries.inventory(relations, "transactions").collect()
    assert rows[0].f_propagation == "Propagation.REQUIRES_NEW" and rows[0].f_readOnly == "true"
    assert summaries.inventory(relations, "cache_topologies").first().target == "cache:users" and len(summaries.INVENTORIES) == 52


def contents_of(spark, **files):
    return spark.createDataFrame([(path, "x", text) for path, text in files.items()], "path string, language string, content string")


def test_properties_of_ten_parents(spark):
    pom = lambda at, parent: (
        f"<project>{f'<parent><groupId>g</groupId><artifactId>p{parent}</artifactId></parent>' if parent is not None else ''}<groupId>g</groupId><artifactId>p{at}</artifactId>"
        f"<properties><k{at}>v{at}</k{at}></properties><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId><version>${{k9}}</version></dependency></dependencies></project>"
    )
    files = {f"s/p{i}/pom.xml": pom(i, i + 1 if i < 9 else None) for i in range(10)}
    files |= {"s/other/pom.xml": pom(9, None).replace("<groupId>g</groupId>", "<groupId>h</groupId>").replace("v9", "wrong"), "s/ring/pom.xml": pom(20, 20)}
    contents = contents_of(spark, **files)
    chain = {r.path: dict(r.properties) for r in formats.maven_chain(formats.maven_modules(contents)).collect()}
    assert chain["s/p0/pom.xml"] == {f"k{i}": f"v{i}" for i in range(10)} and chain["s/ring/pom.xml"] == {"k20": "v20"}
    found = {r.path: r.version for r in formats.maven_dependencies(contents).collect()}
    assert found["s/p0/pom.xml"] == "v9" and found["s/other/pom.xml"] == "wrong"


def test_locale_keys_of_any_depth_and_deep_compose_keys(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": {"g": "x"}}}}}}, "k": "{not json"}'
    assert rows_of(formats.locale_messages(contents_of(spark, **{"s/locales/en.json": deep})), "key", "value") == {("a.b.c.d.e.f.g", "x"), ("k", "{not json")}
    routes = "spring:\n  cloud:\n    gateway:\n      routes:\n" + "".join(f"        - id: r{i}\n          uri: lb://s{i}\n" for i in range(10_050))
    assert formats.gateway_routes(contents_of(spark, **{"s/a.yml": routes})).count() == 10_050


def test_a_word_that_many_providers_share_still_matches(spark):
    from loomgraph.operators import workspace

    found = spark.createDataFrame([("provides", f"p{i}", "http_endpoint", f"GET /orders/list{i}") for i in range(150)] + [("consumes", "c", "http_request", "/orders")], "side string, project string, kind string, name string")
    assert [(r.consumer, r.score) for r in workspace.match_consumers(found).collect()] == [("c", 15)]


def test_one_long_file_is_no_join_within_itself(spark):
    body = "class A {\n" + "".join(f"    void m{i}(int a) {{\n        n{i}(a);\n    }}\n" for i in range(3000)) + "}\n"
    files = spark.createDataFrame([("s/A.java", "java", body, 1, "h")], "path string, language string, content string, indexed_at bigint, content_hash string")
    edges = lines.parsed_edges(files)
    assert edges.where("kind = 'calls'").count() == 3000 and edges.where("kind = 'contains'").count() == 3000
