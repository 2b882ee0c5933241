"""Views, stores, streams and the pattern algebra's unbound variables, on small tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ruleweave.functions import text as T
from ruleweave.operators import evaluate, graph, resolve, rules, views
from ruleweave.operators.bgp import Pattern
from ruleweave.operators.triples import abox, trigger_triples
from ruleweave.plans import norm_queries, packs
from ruleweave.plans.table_queries import QUERIES
from ruleweave.sources import diagrams, rules_xml, sinks
from ruleweave.streaming import facts as streams
from tests.test_rules_engine import TWO, duplicates


@pytest.fixture(scope="module")
def two(spark):
    rows = graph.cut(diagrams.parse(spark.createDataFrame([("two.bpmn", TWO)], "file string, xml string")))
    t = diagrams.tables(rows)
    r = rules.derive(t["nodes"], t["flows"], t["gateway_order"], t["props"])
    return rows, t, r, graph.cut(rules.rule_atoms(r["norms"], r["rules"], t["props"]))


def triples(spark, rows):
    return spark.createDataFrame([tuple(x.split()) for x in rows], "s string, p string, o string")


def test_unbound_variables_agree_with_any_value(spark):
    t = triples(spark, ["a is x", "b is x", "a likes c", "a knows c", "a knows d", "b knows d", "c is y"])
    p = Pattern(t).where("?s", "is", "x").optional(("?s", "likes", "?o"))
    got = p.where("?s", "knows", "?o").select("s", "o").collect()
    assert sorted(map(tuple, got)) == [("a", "c"), ("b", "d")]  # b's unbound o takes d; a's is c alone
    assert sorted(r.s for r in p.minus(("?s", "knows", "?o")).rows.collect()) == []
    assert sorted(r.s for r in p.exists(("?s", "knows", "?o")).rows.collect()) == ["a", "b"]
    both = Pattern(t).where("?s", "likes", "?o").union(Pattern(t).where("?s", "is", "x"))
    assert sorted(map(tuple, both.where("?s", "knows", "?o").select("s", "o").collect())) == [("a", "c"), ("a", "c"), ("a", "d"), ("b", "d")]
    assert not Pattern(t).where("?s", "likes", "x").ask()


def test_groups_order_offset_and_sub_selects(spark):
    t = triples(spark, ["a in g", "b in g", "c in h", "a size 1", "b size 2", "c size 9", "g name G", "h name H"])
    sizes = Pattern(t).where("?s", "in", "?g").where("?s", "size", "?n").group("g", total=F.sum(F.col("n").cast("int")), names=F.array_sort(F.collect_list("s")))
    assert [tuple(r) for r in sizes.filter("total > 2").order(F.desc("total")).select("g", "total").collect()] == [("h", 9), ("g", 3)]
    assert [r.g for r in sizes.order("g").slice(1, offset=1).select("g").collect()] == ["h"]
    named = Pattern(t).where("?g", "name", "?label").join(sizes.project("g", "total"))
    assert sorted(map(tuple, named.select("label", "total").collect())) == [("G", 3), ("H", 9)]


def test_norms_are_listed_evaluated_and_drawn(spark, two):
    rows, t, r, atoms = two
    listed = {x.norm_id: x for x in views.norm_listing(t["props"], views.norm_conditions(atoms, r["body"])).collect()}
    assert set(listed) == {"OBL_1", "REC_1", "Gateway_Is_it_large"} and listed["OBL_1"].agent == "Provider" and listed["Gateway_Is_it_large"].deontic_type == ""
    assert [(c.pred, c.value) for c in listed["REC_1"].conditions] == [("Is_it_large", False)] and listed["Gateway_Is_it_large"].conditions == []
    facts = spark.createDataFrame([("x", "Is_it_large", True)], "scenario_id string, pred string, value boolean")
    scenarios = facts.select("scenario_id")
    by_rules, engine = views.evaluate_pack(facts, scenarios, r["rules"], r["body"], atoms)
    xml = rules_xml.document([x.xml for x in rules_xml.export(r["rules"], r["body"], r["head"], "http://x.org/r").orderBy("rule_ord").collect()])
    parsed = lambda text: rules_xml.parse(spark.createDataFrame([("r", text)], "file string, xml string"))
    by_file, other = views.evaluate_pack(facts, scenarios, r["rules"], r["body"], atoms, parsed(xml))
    broken, last = views.evaluate_pack(facts, scenarios, r["rules"], r["body"], atoms, parsed("<oops"))
    said = [[(x.norm_id, x.deontic_type, x.agent, x.risk_level) for x in d.collect()] for d in (by_rules, by_file, broken)]
    assert (engine, other, last) == ("rules", "rule_file", "rules") and said == [[("OBL_1", "Obligation", "Agent_Provider", "High")]] * 3
    nodes, edges = views.norm_graph(views.norm_view(atoms), r["rules"], r["body"])
    assert {(e.source, e.target, e.label) for e in edges.collect()} >= {("Agent_Provider", "OBL_1", "performs"), ("cond::Is_it_large", "REC_1", "when false")}
    assert {n.id for n in nodes.collect()} == {"OBL_1", "REC_1", "Agent_Provider", "Agent_provider", "object::unnamed", "cond::Is_it_large"}


def test_semantic_graph_links_conditions_to_norms(spark, two):
    rows, t, r, atoms = two
    every = graph.cut(abox(diagrams.records(rows)).unionByName(trigger_triples(r["head"], r["body"])))
    nodes = graph.cut(views.semantic_nodes(every))
    named = atoms.where("predicate = 'deonticId'").select("rid", F.col("object").alias("norm_id"))
    edges = graph.cut(views.semantic_edges(every, nodes, r["body"], named))
    got = {(e.source, e.target, e.label) for e in edges.collect()}
    assert {("Condition_Is_it_large", "OBL_1", "when true"), ("Condition_Is_it_large", "REC_1", "when false"), ("OBL_1", "Regulation_Act", "hasLegalSource")} <= got
    assert not nodes.where("type = 'TriggerEvent'").count() and every.where("p = 'hasTrigger'").count() == 2
    hits, among = views.searched(nodes, edges, "when TRUE", ("AnnotationActivity",))
    assert {n.id for n in hits.collect()} == {"Condition_Is_it_large", "OBL_1"} and [e.label for e in among.collect()] == ["when true"]


def test_records_json_patch_override_and_values(spark, two, tmp_path):
    rows, t, _, _ = two
    records = diagrams.records(rows)
    lines = [json.loads(x.line) for x in diagrams.record_json(records).orderBy("ord").collect()]
    assert [x["bpmn_id"] for x in lines] == ["a", "b", "g"] and lines[0]["deontic_id"] == "OBL_1" and lines[2]["true_branch"] == "Yes" and "agent" not in lines[2]
    back = {(x.element_id, x.key): x.value for x in diagrams.patched(t["props"], records.withColumn("agent", F.upper("agent"))).collect()}
    assert back["a", "compliance_agent"] == "PROVIDER" and back["a", "compliance_riskLevel"] == "high" and ("g", "compliance_agent") not in back
    maps, pairs = diagrams.overrides(spark.createDataFrame([('{"agent": {"provider": "Provider"}, "_note": "x", "_confirmed_separate": [["a", "b"], ["c"]]}',)], "json string"))
    assert [tuple(x) for x in maps.collect()] == [("agent", "provider", "Provider")] and [tuple(x) for x in pairs.collect()] == [("a", "b")]
    raw = {(x.element_id, x.key): x.value for x in diagrams.overridden(t["props"], maps).collect()}
    assert raw["b", "compliance_agent"] == "Provider"
    assert {x.field: x["values"] for x in views.entity_values(t["props"]).collect()}["regulation"] == ["Act"]
    merged, _ = views.edited(maps, pairs, "merge", "agent", "provider", "X")
    assert [tuple(x) for x in merged.collect()] == [("agent", "provider", "X")] and views.edited(maps, pairs, "remove_override", "agent", "provider")[0].count() == 0
    assert {tuple(x) for x in views.edited(maps, pairs, "confirm_separate", "", "z", "y")[1].collect()} == {("a", "b"), ("y", "z")}
    (tmp_path / "two.bpmn").write_text(TWO)
    assert diagrams.scan(spark, str(tmp_path)).count() == rows.count()
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        diagrams.scan(spark, str(tmp_path / "empty"))


def test_unique_names_follow_the_order(spark):
    names = ["a", "a-2", "a", "b", "a", "a-2", "b"]
    taken = ["a", "b-2", "a-3"]
    used, want = set(taken), []
    for n in names:
        got, k = n, 2
        while got in used:
            got, k = f"{n}-{k}", k + 1
        used.add(got)
        want.append(got)
    out = packs.unique_names(spark.createDataFrame(list(enumerate(names)), "ord int, name string"), spark.createDataFrame([(x,) for x in taken], "name string"))
    assert [r.unique for r in out.orderBy("ord").collect()] == want
    files = spark.createDataFrame([("p", "x.bpmn", "1"), ("q", "x.bpmn", "2")], "pack string, path string, content string")
    added = spark.createDataFrame([("p", "x.bpmn", "3", 1), ("p", "y", "4", 2)], "pack string, path string, content string, ord int")
    assert sorted(map(tuple, packs.appended(files, added).collect())) == [("p", "x-2.bpmn", "3"), ("p", "x.bpmn", "1"), ("p", "y.bpmn", "4"), ("q", "x.bpmn", "2")]


def test_stores_and_catalogues(spark, tmp_path):
    t = spark.createDataFrame([("p", "s", "a", "o"), ("q", "s", "a", "x")], "pack string, s string, p string, o string")
    packs.save_triples(t, str(tmp_path / "store"))
    packs.save_triples(spark.createDataFrame([("p", "s", "a", "new")], t.schema), str(tmp_path / "store"))
    assert [packs.load_triples(spark, str(tmp_path / "store"), k).collect()[0].o for k in ("p", "q")] == ["new", "x"]
    catalog = spark.createDataFrame([("p", 1, 1, "old"), ("r", 2, 2, "r")], "pack string, created_at int, updated_at int, note string")
    new = spark.createDataFrame([("p", 5, 6, "a"), ("p", 5, 7, "b"), ("z", 9, 9, None)], catalog.schema)
    assert [tuple(x) for x in packs.catalog_listing(packs.upsert(catalog, new)).collect()] == [("p", 1, 7, "b"), ("r", 2, 2, "r"), ("z", 9, 9, None)]
    assert packs.catalog_row(catalog, "r").first().note == "r"
    files = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "pack string, path string")
    assert sorted(map(tuple, packs.sync_files(files, spark.createDataFrame([("p", "z")], files.schema)).collect())) == [("p", "z"), ("q", "c")]
    prints = packs.fingerprints(spark.createDataFrame([("p", "1", "x"), ("q", "1", "y")], "pack string, path string, content string"))
    assert [r.pack for r in packs.stale(prints, prints.where("pack = 'p'")).collect()] == ["q"]


def test_stream_joins_facts_of_several_batches(spark, tmp_path):
    schema = "scenario_id string, pred string, value boolean, ts timestamp"
    body = spark.createDataFrame([("r1", "p", True), ("r1", "q", False)], "rid string, pred string, value boolean")
    names, found = spark.createDataFrame([("r1",)], "rid string"), []
    folder = str(tmp_path / "in")
    batches = [[("x", "p", True, "2024-01-01 00:00:00")], [("x", "q", False, "2024-01-01 00:00:01"), ("y", "q", False, "2024-01-01 00:00:01")], [("x", "p", False, "2024-01-01 00:00:02"), ("y", "p", True, "2024-01-01 00:00:00")], [("x", "p", True, "2024-01-01 00:00:01")]]
    for rows in batches:
        spark.createDataFrame(rows, "scenario_id string, pred string, value boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = lambda rows, epoch: found.append(sorted(map(tuple, rows.collect())))
    streams.evaluate_stream(streams.latest(stream), names, body, sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = [x for x in found if x]
    assert found == [[("x", "r1")], [("y", "r1")]]


def test_catalogues_gaps_and_pairs(spark, two):
    _, t, r, _ = two
    assert [x.pred for x in rules.condition_catalog(r["body"], r["rules"]).collect()] == ["Is_it_large"]
    fields = {x.norm: x.fields for x in rules.norm_table(r["norms"], t["props"], r["rules"]).collect()}
    assert fields["OBL_1"]["agent"] == "Provider"
    got, want = (spark.createDataFrame(x, "scenario_id string, norm string") for x in ([("a", "n1"), ("a", "n2")], [("a", "n2"), ("a", "n3")]))
    assert sorted(map(tuple, evaluate.expectation_gaps(got, want).collect())) == [("a", "n1", "unexpected"), ("a", "n3", "missing")]
    warned = spark.createDataFrame([("x", "y", 1), ("p", "q", 2)], "a string, b string, n int")
    assert [x.n for x in resolve.confirmed_apart(warned, spark.createDataFrame([("q", "p")], "a string, b string")).collect()] == [1]
    assert [x.file for x in packs.summaries(r["rules"]).collect()] == ["two.bpmn"]
    one = spark.createDataFrame([("s", "p", 'say "x"', "literal", "xsd:string", None), ("s", "q", "t", "iri", None, None)], "s string, p string, o string, o_kind string, datatype string, lang string")
    assert [x.line for x in sinks.ntriples(one, "http://x").orderBy("line").collect()] == ['<http://x#s> <http://x#p> "say \\"x\\"" .', "<http://x#s> <http://x#q> <http://x#t> ."]
    assert [x.line for x in sinks.solutions_json(spark.createDataFrame([("a", None)], "x string, y string")).collect()] == ['{"x":"a"}']
    labels = spark.createDataFrame([("agent", "b"), ("agent", "a"), ("agent", "")], "field string, label string")
    assert [x.map for x in sinks.override_template(labels).collect()] == [{"a": "a", "b": "b"}]


def test_fuzzy_duplicates_of_the_benchmark_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    items = [{"id": r.item_id, "type": "o", "article": str(r.item_id % 2), "regulation": str(r.item_id % 3), "agent": str(r.item_id % 5), "action": "", "object": "", "statement": r.text, "conditions": []} for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
    assert sorted((r.a, r.b, r.score) for r in QUERIES["q13_identity_fuzzy"](spark, folder).collect()) == sorted(duplicates(items))
    assert norm_queries.part_records(spark, "/root/testdata/sf0.001").count() == 200


def test_packs_are_rebuilt_when_their_files_change(spark, tmp_path):
    files = spark.createDataFrame([("one", "two.bpmn", TWO), ("other", "two.bpmn", TWO)], "pack string, path string, content string")
    recorded = spark.createDataFrame(packs.fingerprints(files).collect(), "pack string, fingerprint string")
    store = str(tmp_path / "store")
    packs.save_triples(spark.createDataFrame([("one", "s", "deonticId", "old"), ("other", "s", "deonticId", "OBL_7")], "pack string, s string, p string, o string").selectExpr("*", "'literal' as o_kind", "'xsd:string' as datatype", "cast(null as string) as lang"), store)
    changed = files.withColumn("content", F.when(F.col("pack") == "one", F.replace("content", F.lit("OBL_1"), F.lit("OBL_2"))).otherwise(F.col("content")))
    assert packs.rebuild(changed, recorded, store) == ["one"]
    ids = lambda pack: {r.o for r in packs.load_triples(spark, store, pack).where("p = 'deonticId'").collect()}
    assert ids("one") == {"OBL_2", "REC_1"} and ids("other") == {"OBL_7"}


def test_iris_rids_and_ids_of_equal_tasks(spark):
    kinds = spark.createDataFrame([("rules", "a"), ("abox", "b"), ("tbox", "c"), ("var", "x")], "kind string, name string")
    named = kinds.select(T.iri(F.col("kind"), F.col("name"), "http://r", "http://i", "http://v#").alias("iri"))
    assert [r.iri for r in named.collect()] == ["http://r#a", "http://i#b", "http://v#c", "http://r#var_x"]
    with pytest.raises(Exception, match="no such kind"):
        kinds.select(T.iri(F.lit("odd"), F.col("name"), "r", "i", "v")).collect()
    assert spark.range(1).select(T.datatype_iri(F.lit("xsd:date")).alias("t")).first().t == "http://www.w3.org/2001/XMLSchema#date"
    rids = spark.createDataFrame([("r1", 1), ("r2", 2), ("r1", 3), ("r1", 4)], "rid string, rule_ord int")
    assert [r.name for r in rules_xml.unique_rids(rids).orderBy("rule_ord").collect()] == ["r1", "r2", "r1_2", "r1_3"]
    task = lambda file, element, seq, **kv: [(file, element, k if k.startswith("_") else f"compliance_{k}", v, seq) for k, v in kv.items()]
    rows = task("b", "x", 1, elementType="task", deonticType="obligation", agent="A b", deonticId="OBL_9") + task("a", "x", 2, elementType="task", deonticType="Obligation", agent="a-b", _bpmn_name="Do it") + task("b", "y", 3, elementType="task", deonticId="N") + task("b", "z", 4, deonticType="obligation", agent="a b", deonticId="Z")
    got = {(r.file, r.element_id): r.value for r in resolve.canonical_prop_ids(spark.createDataFrame(rows, "file string, element_id string, key string, value string, seq int")).where("key = 'compliance_deonticId'").collect()}
    assert got == {("a", "x"): "OBL_Do_it", ("b", "x"): "OBL_Do_it", ("b", "y"): "N", ("b", "z"): "Z"}
