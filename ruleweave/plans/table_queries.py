"""The engine's operators applied to relational tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.functions import text as T
from ruleweave.operators import evaluate, graph, norms, resolve
from ruleweave.operators.bgp import Pattern, path
from ruleweave.operators.triples import decode, encode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _facts(rows: DataFrame, prefix: str, key: str, values: dict[str, str], links: dict[str, tuple[str, str]]) -> DataFrame:
    """Triples (s, p, o) of a table's rows: their type, values of columns, and links to keys of other tables."""
    s = F.concat(F.lit(prefix), F.col(key).cast("string"))
    cells = [F.struct(F.lit("rdf:type").alias("p"), F.lit(prefix).alias("o"))] + [F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in values.items()]
    cells += [F.struct(F.lit(p).alias("p"), F.concat(F.lit(other), F.col(c).cast("string")).alias("o")) for p, (other, c) in links.items()]
    return rows.select(s.alias("s"), F.inline(F.array(*cells))).where("o is not null")


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and nations as triples."""
    customer = _facts(read(spark, sf, "customer"), "c/", "c_custkey", {"label": "c_name"}, {"inNation": ("n/", "c_nationkey")})
    return customer.unionByName(_facts(read(spark, sf, "nation"), "n/", "n_nationkey", {"label": "n_name"}, {"inRegion": ("r/", "n_regionkey")}))


_RULES = [("r1", "purchase", True), ("r1", "error", False), ("r2", "click", True), ("r2", "view", True), ("r2", "signup", True), ("r3", "error", True), ("r3", "purchase", False)]


@query("""
WITH kinds AS (SELECT unnest(['click','purchase','error','signup','view']) AS pred), users AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL),
facts AS (SELECT u.user_id, k.pred, count(e.event_id) > 0 AS value FROM users u CROSS JOIN kinds k LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = k.pred AND e.value > 150 GROUP BY u.user_id, k.pred),
body(rid, pred, value) AS (VALUES ('r1','purchase',true),('r1','error',false),('r2','click',true),('r2','view',true),('r2','signup',true),('r3','error',true),('r3','purchase',false)),
rules(rid, n) AS (VALUES ('r1',2),('r2',3),('r3',2),('r4',0))
SELECT u.user_id, r.rid FROM users u CROSS JOIN rules r
LEFT JOIN (SELECT f.user_id, b.rid, count(*) AS m FROM facts f JOIN body b ON f.pred = b.pred AND f.value = b.value GROUP BY f.user_id, b.rid) h ON h.user_id = u.user_id AND h.rid = r.rid
WHERE coalesce(h.m, 0) = r.n
""")
def q01_rule_division(spark, sf):
    """Users whose facts (an event type seen with a value above 150, or not) satisfy all of a rule's body; r4 has none."""
    kinds = ["click", "purchase", "error", "signup", "view"]
    events = read(spark, sf, "events").where("user_id is not null")
    seen = events.groupBy("user_id").agg(*[F.coalesce(F.max((F.col("event_type") == k) & (F.col("value") > 150)), F.lit(False)).alias(k) for k in kinds])
    facts = seen.select(F.col("user_id").alias("scenario_id"), F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("pred", "value"))
    body = spark.createDataFrame(_RULES, "rid string, pred string, value boolean")
    rules = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "rid string")
    return evaluate.matched(facts, seen.select(F.col("user_id").alias("scenario_id")), rules, body).select(F.col("scenario_id").alias("user_id"), "rid")


@query("""
SELECT o_orderpriority AS type, c_name AS agent_label, o_orderkey AS norm, n_name AS regulation FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def q02_bgp_by_agent(spark, sf):
    """Orders of two priorities with their customer and the customer's nation, as a graph pattern."""
    order = _facts(read(spark, sf, "orders"), "o/", "o_orderkey", {"type": "o_orderpriority"}, {"placedBy": ("c/", "o_custkey")})
    triples = order.unionByName(_people(spark, sf))
    p = Pattern(triples).where("?o", "type", "?type").values("type", ["1-URGENT", "2-HIGH"]).where("?o", "placedBy", "?c").where("?c", "label", "?agent_label")
    p = p.optional(("?c", "inNation", "?n"), ("?n", "label", "?regulation"))
    return p.bind("norm", F.substring_index("o", "/", -1).cast("long")).select("type", "agent_label", "norm", "regulation")


@query("""
SELECT c_custkey, c_mktsegment, g.o_orderkey, g.l_linenumber FROM customer LEFT JOIN
(SELECT o_custkey, o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND o_totalprice > 200000) g ON g.o_custkey = c_custkey
""")
def q03_optional_group(spark, sf):
    """Left join with an inner-joined group: customers, and their large orders with large items."""
    item = read(spark, sf, "lineitem").where("l_quantity > 45").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    triples = _facts(read(spark, sf, "customer"), "c/", "c_custkey", {"segment": "c_mktsegment"}, {}).unionByName(_facts(read(spark, sf, "orders").where("o_totalprice > 200000"), "o/", "o_orderkey", {}, {"placedBy": ("c/", "o_custkey")}))
    triples = triples.unionByName(_facts(item, "l/", "id", {"number": "l_linenumber"}, {"partOf": ("o/", "l_orderkey")}))
    p = Pattern(triples).where("?c", "segment", "?c_mktsegment").optional(("?o", "placedBy", "?c"), ("?l", "partOf", "?o"), ("?l", "number", "?number"))
    key = lambda c, kind="long": F.substring_index(c, "/", -1).cast(kind)
    return p.rows.select(key("c").alias("c_custkey"), "c_mktsegment", key("o").alias("o_orderkey"), F.col("number").cast("int").alias("l_linenumber"))


@query("""
SELECT p_brand AS source, p_type AS article, count(DISTINCT l_suppkey) AS norm_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_type HAVING count(DISTINCT l_suppkey) > 1
""")
def q04_shared_source(spark, sf):
    """Groups of a pattern with more than one different member."""
    triples = _facts(read(spark, sf, "part"), "p/", "p_partkey", {"brand": "p_brand", "kind": "p_type"}, {})
    sold = read(spark, sf, "lineitem").select(F.concat(F.lit("p/"), "l_partkey").alias("s"), F.lit("soldBy").alias("p"), F.col("l_suppkey").cast("string").alias("o")).distinct()
    p = Pattern(triples.unionByName(sold)).where("?part", "brand", "?source").where("?part", "kind", "?article").optional(("?part", "soldBy", "?supplier"))
    return p.group("source", "article", norm_count=F.count_distinct("supplier")).filter("norm_count > 1").select("source", "article", "norm_count")


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')""")
def q05_high_priority(spark, sf):
    """Two lists of values in a pattern."""
    triples = _facts(read(spark, sf, "orders"), "o/", "o_orderkey", {"priority": "o_orderpriority", "status": "o_orderstatus"}, {})
    p = Pattern(triples).where("?o", "priority", "?o_orderpriority").values("o_orderpriority", ["1-URGENT", "2-HIGH"]).where("?o", "status", "?o_orderstatus").values("o_orderstatus", ["O", "P"])
    return p.bind("o_orderkey", F.substring_index("o", "/", -1).cast("long")).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("""
SELECT c_custkey, n_name AS regulation, r_name AS article, o_orderkey AS paragraph FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey
""")
def q06_source_anchor(spark, sf):
    """Three optional parts, two of them a chain."""
    region = _facts(read(spark, sf, "region"), "r/", "r_regionkey", {"label": "r_name"}, {})
    order = _facts(read(spark, sf, "orders").where("o_orderstatus = 'P'"), "o/", "o_orderkey", {}, {"placedBy": ("c/", "o_custkey")})
    p = Pattern(_people(spark, sf).unionByName(region).unionByName(order)).where("?c", "rdf:type", "c/").optional(("?c", "inNation", "?n"), ("?n", "label", "?regulation")).optional(("?c", "inNation", "?m"), ("?m", "inRegion", "?r"), ("?r", "label", "?article")).optional(("?o", "placedBy", "?c"))
    key = lambda c: F.substring_index(c, "/", -1).cast("long")
    return p.rows.select(key("c").alias("c_custkey"), "regulation", "article", key("o").alias("paragraph"))


@query("""SELECT 'customer/' || c_custkey AS s, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer WHERE coalesce(c_name, c_mktsegment, c_nationkey::VARCHAR) IS NOT NULL""")
def q07_triples_roundtrip(spark, sf):
    customer = read(spark, sf, "customer").withColumn("s", F.concat(F.lit("customer/"), "c_custkey"))
    return decode(encode(customer, "s", ["c_name", "c_mktsegment", "c_nationkey"]), ["c_name", "c_mktsegment", "c_nationkey"])


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS slug,
CASE WHEN trim(p_name) = '' THEN 'unnamed' ELSE regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', '_', 'g') END AS symbol,
trim(regexp_replace(regexp_replace(lower(trim(p_type)), '[_\\-.,;:/\\\\?!()]', ' ', 'g'), '\\s+', ' ', 'g')) AS canonical FROM part
""".replace("\\\\", "\\"))
def q08_slug_symbol_canonical(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.symbol(F.col("p_name")).alias("symbol"), T.canonical(F.col("p_type")).alias("canonical"))


@query("""
SELECT ckey, arg_min(p_name, p_partkey) AS winner, count(DISTINCT p_name) AS n FROM (SELECT p_partkey, p_name, trim(lower(p_name)) AS ckey FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part)) GROUP BY ckey
""")
def q09_alias_winner(spark, sf):
    """Labels in two spellings, grouped by canonical form; the first seen wins."""
    labels = read(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("label"), F.col("p_partkey").alias("ord"))
    first = labels.groupBy("label").agg(F.min("ord").alias("ord")).withColumn("types", F.array().cast("array<string>"))
    return resolve.alias_groups(first).groupBy("ckey").agg(F.first("winner").alias("winner"), F.count_distinct("label").alias("n"))


@query("""
WITH w AS (SELECT DISTINCT lower(p_brand) || ' ' || p_size AS base FROM part), l AS (SELECT base || 's' AS label FROM w UNION ALL SELECT base FROM w WHERE length(base) % 2 = 0)
SELECT label, coalesce((SELECT base FROM w WHERE base || 's' = l.label AND length(base) % 2 = 0), label) AS winner FROM l
""")
def q10_plural_merge(spark, sf):
    """Plural labels merge into the singular where that is a label too."""
    base = read(spark, sf, "part").select(F.concat_ws(" ", F.lower("p_brand"), "p_size").alias("base")).distinct()
    labels = base.select(F.concat("base", F.lit("s")).alias("label"), F.lit(1).alias("ord")).unionByName(base.where("length(base) % 2 = 0").select(F.col("base").alias("label"), F.lit(2).alias("ord")))
    return resolve.plural_groups(labels.withColumn("types", F.array().cast("array<string>")))


@query("""SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS merged_id FROM customer""")
def q11_signature_dedup(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_custkey").alias("ord"))
    return resolve.instance_ids(rows, ("c_mktsegment", "nation"), "c_custkey").select("c_custkey", "merged_id")


_SCORED = """
WITH s AS (SELECT s_suppkey AS id, s_nationkey::VARCHAR AS regulation, (s_suppkey % 7)::VARCHAR AS article, (s_suppkey % 5)::VARCHAR AS agent, (s_suppkey % 3)::VARCHAR AS action, (s_suppkey % 4)::VARCHAR AS object FROM supplier),
p AS (SELECT a.id AS a, b.id AS b, (25 * (a.article = b.article)::INT + 15 * (a.regulation = b.regulation)::INT + 15 * (a.agent = b.agent)::INT + 15 * (a.action = b.action)::INT + 15 * (a.object = b.object)::INT)::BIGINT AS score FROM s a JOIN s b ON a.id < b.id)
SELECT a, b, score FROM p WHERE score >= 55
"""


@query(_SCORED)
def q12_identity_score(spark, sf):
    s = read(spark, sf, "supplier")
    mod = lambda n: (F.col("s_suppkey") % n).cast("string")
    norms = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.lit("obligation").alias("type"), F.col("s_nationkey").cast("string").alias("regulation"), mod(7).alias("article"), mod(5).alias("agent"), mod(3).alias("action"), mod(4).alias("object"), F.lit("").alias("statement"), F.array().cast("array<string>").alias("conditions"))
    return resolve.duplicate_norms(norms, fuzzy=False).select("a", "b", "score")


@query()
def q13_identity_fuzzy(spark, sf):
    """As q12 over benchmark items, with statements compared by gestalt similarity."""
    items = read(spark, sf, "benchmark")
    mod = lambda n: (F.col("item_id") % n).cast("string")
    return resolve.duplicate_norms(items.select(F.col("item_id").alias("id"), F.col("item_id").alias("ord"), F.lit("obligation").alias("type"), mod(2).alias("article"), mod(3).alias("regulation"), mod(5).alias("agent"), F.lit("").alias("action"), F.lit("").alias("object"), F.col("text").alias("statement"), F.array().cast("array<string>").alias("conditions"))).select("a", "b", "score")


_EDGES = """edges AS (SELECT DISTINCT event_type AS src, dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND dst <> event_type)"""


def _transitions(spark, sf):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null and dst <> src").distinct().withColumn("file", F.lit("events"))


@query(f"""
WITH RECURSIVE {_EDGES}, walk AS (SELECT 'signup' AS last, ['signup'] AS nodes UNION ALL SELECT e.dst, list_append(w.nodes, e.dst) FROM walk w JOIN edges e ON e.src = w.last WHERE w.last <> 'purchase' AND NOT list_contains(w.nodes, e.dst))
SELECT array_to_string(nodes, '>') AS path, len(nodes)::INT AS n_nodes FROM walk WHERE last = 'purchase'
""")
def q14_path_enum(spark, sf):
    edges = _transitions(spark, sf).withColumn("edge_id", F.concat_ws(">", "src", "dst")).withColumn("rank", F.row_number().over(Window.partitionBy("file", "src").orderBy("dst")))
    one = lambda name: spark.createDataFrame([("events", name)], "file string, node string")
    return graph.simple_paths(edges, one("signup"), one("purchase")).select(F.array_join("nodes", ">").alias("path"), F.size("nodes").alias("n_nodes"))


@query(f"""
WITH RECURSIVE {_EDGES}, d AS (SELECT 'signup' AS node, 0 AS depth UNION SELECT e.dst, d.depth + 1 FROM d JOIN edges e ON e.src = d.node WHERE d.depth < 6)
SELECT node, min(depth)::INT AS depth FROM d GROUP BY node
""")
def q15_min_depth(spark, sf):
    return graph.min_depths(_transitions(spark, sf), spark.createDataFrame([("events", "signup")], "file string, node string")).select("node", "depth")


@query("""SELECT * FROM (SELECT o_custkey AS file, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "over", o_orderkey AS under FROM orders) WHERE "over" IS NOT NULL""")
def q16_superiority(spark, sf):
    rules = read(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("rid"), F.struct("o_orderdate", "o_orderkey").alias("n"))
    return graph.superiority(rules)


@query("""
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
both_ AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), w AS (SELECT u AS node, u AS r FROM both_ UNION SELECT b.v, w.r FROM w JOIN both_ b ON b.u = w.node)
SELECT node, min(r) AS component FROM w GROUP BY node
""")
def q17_components(spark, sf):
    nation = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    supplier = read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    return graph.components(nation.unionByName(supplier))


@query("""
WITH a AS (SELECT DISTINCT user_id AS rid, event_type AS pred, (json_extract(props, '$.k')::INT % 2 = 0) AS value FROM events WHERE value > 180),
bad AS (SELECT DISTINCT rid FROM a GROUP BY rid, pred HAVING count(DISTINCT value) > 1)
SELECT rid, pred, value FROM a WHERE rid NOT IN (SELECT rid FROM bad)
""")
def q18_contradiction(spark, sf):
    """Bodies without those that demand both truth values of a predicate."""
    from ruleweave.operators.rules import consistent

    atoms = read(spark, sf, "events").where("value > 180").select(F.col("user_id").alias("rid"), F.col("event_type").alias("pred"), (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("value"), F.col("event_id").alias("pos"))
    return consistent(atoms).select("rid", "pred", "value")


@query("""
WITH w AS (SELECT DISTINCT user_id, date_trunc('week', ts) AS week, event_type FROM events), n AS (SELECT user_id, count(DISTINCT week) AS weeks FROM w GROUP BY user_id)
SELECT user_id AS norm, event_type AS pred FROM w JOIN n USING (user_id) GROUP BY user_id, event_type, weeks HAVING count(DISTINCT week) = weeks
""")
def q19_min_conditions(spark, sf):
    """Conditions that all rules of a norm share; here the event types of every week in which a user is active."""
    from ruleweave.operators.rules import minimal_conditions

    rows = read(spark, sf, "events").select(F.col("user_id").alias("norm"), F.date_trunc("week", "ts").alias("rid"), F.col("event_type").alias("pred"), F.lit(True).alias("value"))
    return minimal_conditions(rows).select("norm", "pred")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1""")
def q20_first_wins(spark, sf):
    """First row of each key: an aggregate with partial results, not a sort of every group."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("place"))
    return graph.first_values(rows, "l_orderkey", "place", ["l_linenumber", "l_partkey"])


@query("""
SELECT user_id, arg_min(event_type, event_id) FILTER (value > 100) AS event_type, arg_min(value, event_id) FILTER (event_type = 'purchase') AS value FROM events GROUP BY user_id
""")
def q21_coalesce_first(spark, sf):
    """First non-null value of each column by key."""
    rows = read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("value") > 100, F.col("event_type")).alias("event_type"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return graph.first_values(rows, "user_id", "event_id", ["event_type", "value"])


@query("""
WITH e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'lives in' AS label FROM customer WHERE c_acctbal > 0 UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based in' FROM supplier),
n AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey < 3 UNION SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 's' || s_suppkey FROM supplier)
SELECT DISTINCT source, target, label FROM e WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)
""")
def q22_edge_union(spark, sf):
    customer, supplier, nation = (read(spark, sf, t) for t in ("customer", "supplier", "nation"))
    tag = lambda c, x: F.concat(F.lit(c), F.col(x))
    edges = customer.where("c_acctbal > 0").select(tag("c", "c_custkey").alias("source"), tag("n", "c_nationkey").alias("target"), F.lit("lives in").alias("label")).unionByName(supplier.select(tag("s", "s_suppkey").alias("source"), tag("n", "s_nationkey").alias("target"), F.lit("based in").alias("label")))
    nodes = nation.where("n_regionkey < 3").select(tag("n", "n_nationkey").alias("node")).unionByName(customer.where("c_mktsegment = 'BUILDING'").select(tag("c", "c_custkey").alias("node"))).unionByName(supplier.select(tag("s", "s_suppkey").alias("node")))
    return graph.induced(edges, nodes)


@query("""SELECT doc_id FROM documents WHERE contains(replace(replace(lower(text), '_', ' '), '-', ' '), 'the') AND contains(replace(replace(lower(text), '_', ' '), '-', ' '), 'ing') AND contains(replace(replace(lower(text), '_', ' '), '-', ' '), 'that')""")
def q23_token_search(spark, sf):
    return read(spark, sf, "documents").where(T.contains_all(F.col("text"), F.lit("The ING that"))).select("doc_id")


@query("""SELECT CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS type, count(*) AS n FROM events GROUP BY 1""")
def q24_type_counts(spark, sf):
    return norms.type_counts(read(spark, sf, "events"), {"view": "click"}, "event_type")


@query("""
SELECT event_id, CASE WHEN v IS NULL OR lower(trim(v)) IN ('false','f','no','n','0','','null','none') THEN false ELSE true END AS value FROM
(SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN NULL WHEN 3 THEN json_extract_string(props, '$.k') WHEN 4 THEN 'NONE' ELSE event_type END AS v FROM events)
""")
def q25_bool_coerce(spark, sf):
    k = F.col("event_id") % 6
    v = F.when(k == 0, "Yes").when(k == 1, " no ").when(k == 3, F.get_json_object("props", "$.k")).when(k == 4, "NONE").when(k == 5, F.col("event_type"))
    return read(spark, sf, "events").select("event_id", T.boolean(v).alias("value"))


@query("""SELECT o_orderkey, iri FROM orders JOIN (VALUES ('1-URGENT','Critical'),('2-HIGH','High'),('3-MEDIUM','Medium'),('5-LOW','Low')) v(k, iri) ON o_orderpriority = k""")
def q26_vocab_map(spark, sf):
    """Vocabulary lookup; values without an entry are dropped."""
    words = {"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}
    return read(spark, sf, "orders").select("o_orderkey", T.lookup(F.col("o_orderpriority"), words).alias("iri")).where("iri is not null")


@query("""SELECT o_orderkey, lexical, CASE WHEN regexp_full_match(lexical, '\\d{4}-\\d{2}-\\d{2}') THEN 'xsd:date' ELSE 'xsd:string' END AS datatype FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS lexical FROM orders)""".replace("\\\\", "\\"))
def q27_typed_literal(spark, sf):
    lexical = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, sf, "orders").select("o_orderkey", lexical.alias("lexical")).withColumn("datatype", T.date_or_string(F.col("lexical")))


@query("""
SELECT l_orderkey, min(l_linestatus) FILTER (l_returnflag = 'A') AS A, min(l_linestatus) FILTER (l_returnflag = 'N') AS N, min(l_linestatus) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY l_orderkey
""")
def q28_norm_pivot(spark, sf):
    """Triples back to one row for each subject."""
    flags = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_linestatus").alias("o"))
    return decode(flags, ["A", "N", "R"]).withColumnRenamed("s", "l_orderkey")


@query("""SELECT c_nationkey AS pack, sha256(string_agg(c_custkey || ':' || c_name, ',' ORDER BY c_custkey)) AS fingerprint FROM customer GROUP BY c_nationkey""")
def q29_fingerprint(spark, sf):
    from ruleweave.plans.packs import fingerprints

    rows = read(spark, sf, "customer").select(F.col("c_nationkey").alias("pack"), F.col("c_custkey").alias("path"), F.concat_ws(":", "c_custkey", "c_name").alias("content"))
    return fingerprints(rows)


@query("""SELECT DISTINCT 'supplier/' || s_suppkey AS s, 'region/' || n_regionkey AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q30_chain(spark, sf):
    """A property chain as a path over triples."""
    edge = lambda t, a, ka, p, b, kb: read(spark, sf, t).select(F.concat(F.lit(a), ka).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(b), kb).alias("o"))
    triples = edge("supplier", "supplier/", "s_suppkey", "inNation", "nation/", "s_nationkey").unionByName(edge("nation", "nation/", "n_nationkey", "inRegion", "region/", "n_regionkey"))
    return path(triples, "inNation/inRegion")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q31_order_limit(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Pattern(rows, rows).order(F.desc("o_totalprice"), "o_orderkey").slice(100).select("o_orderkey", "o_totalprice")


@query("""SELECT c.c_custkey::VARCHAR AS customer, n.n_name AS nation FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
def q32_pattern_minus(spark, sf):
    """A graph pattern with a constant, a join and a MINUS, over triples of three tables."""
    customer = encode(read(spark, sf, "customer").withColumn("s", F.col("c_custkey").cast("string")), "s", ["c_mktsegment", "c_nationkey"])
    nation = encode(read(spark, sf, "nation").withColumn("s", F.col("n_nationkey").cast("string")), "s", ["n_name"])
    orders = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("s"), F.lit("ordered").alias("p"), F.col("o_orderkey").cast("string").alias("o"))
    triples = customer.unionByName(nation).select("s", "p", "o").unionByName(orders)
    found = Pattern(triples).where("?customer", "c_mktsegment", "BUILDING").where("?customer", "c_nationkey", "?n").where("?n", "n_name", "?nation").minus(("?customer", "ordered", "?order"))
    return found.select("customer", "nation")
