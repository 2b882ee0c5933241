from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from ruleweave.functions import text as T
from ruleweave.operators import evaluate, graph, norms, resolve, rules
from ruleweave.operators.bgp import path
from ruleweave.operators.triples import abox
from ruleweave.plans.presets import PRESETS
from ruleweave.plans import norm_queries  # noqa: F401
from ruleweave.plans.table_queries import ORACLE_SQL, QUERIES
from ruleweave.sources import diagrams, rules_xml, sinks


def prop(**kv):
    return "<extensionElements><properties>" + "".join(f'<property name="{k if k.startswith("gw_") else "compliance_" + k}" value="{v}"/>' for k, v in kv.items()) + "</properties></extensionElements>"


def diagram(body):
    return f'<definitions xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL"><process id="p">{body}</process></definitions>'


TWO = diagram(
    '<startEvent id="s"/><endEvent id="e"/>'
    f'<exclusiveGateway id="g" name="Is it large?"><outgoing>f1</outgoing><outgoing>f2</outgoing>{prop(elementType="exclusiveGateway", gw_conditionStatement="Is it large?")}</exclusiveGateway>'
    f'<task id="a" name="Report">{prop(elementType="task", deonticType="obligation", deonticId="OBL_1", agent="Provider", riskLevel="high", regulation="Act", article="5")}</task>'
    f'<task id="b" name="Advise">{prop(elementType="task", deonticType="recommendation", deonticId="REC_1", agent="provider", regulation="Act", article="6")}</task>'
    '<sequenceFlow id="f0" sourceRef="s" targetRef="g"/><sequenceFlow id="f1" name="Yes" sourceRef="g" targetRef="a"/><sequenceFlow id="f2" name="No" sourceRef="g" targetRef="b"/>'
    '<sequenceFlow id="f3" sourceRef="a" targetRef="e"/><sequenceFlow id="f4" sourceRef="b" targetRef="e"/>'
)
LOOP = diagram('<startEvent id="S"/><task id="A"/><task id="B"/><endEvent id="E"/><sequenceFlow id="1" sourceRef="S" targetRef="A"/><sequenceFlow id="2" sourceRef="A" targetRef="E"/><sequenceFlow id="3" sourceRef="A" targetRef="B"/><sequenceFlow id="4" sourceRef="B" targetRef="A"/>')


@pytest.fixture(scope="module")
def two(spark):
    rows = graph.cut(diagrams.parse(spark.createDataFrame([("two.bpmn", TWO)], "file string, xml string")))
    t = diagrams.tables(rows)
    return rows, t, rules.derive(t["nodes"], t["flows"], t["gateway_order"], t["props"])


def test_two_branches_make_two_opposite_rules(spark, two):
    _, _, r = two
    assert sorted((x.rid, x.pred, x.value) for x in r["body"].collect()) == [("r1", "Is_it_large", True), ("r2", "Is_it_large", False)]
    assert sorted((x.rid, x.norm) for x in r["norms"].collect()) == [("r1", "OBL_1"), ("r2", "REC_1")]
    assert [(x.over, x.under) for x in r["superiority"].collect()] == [("r1", "r2")]
    facts = spark.createDataFrame([("x", "Is_it_large", True), ("y", "Is_it_large", False)], "scenario_id string, pred string, value boolean")
    got = evaluate.outcomes(evaluate.matched(facts, facts.select("scenario_id"), r["rules"], r["body"]), r["head"])
    assert sorted((x.scenario_id, x.norm) for x in got.collect()) == [("x", "OBL_1"), ("y", "REC_1")]
    texts = [x.text for x in rules.rule_text(r["rules"], r["body"], r["norms"]).orderBy("rule_ord").collect()]
    assert texts == ["r1: Is_it_large(?x, true) ⇒ Obligation(:OBL_1)", "r2: Is_it_large(?x, false) ⇒ Recommendation(:REC_1)"]


def test_rule_file_round_trip(spark, two):
    _, _, r = two
    xml = rules_xml.document([x.xml for x in rules_xml.export(r["rules"], r["body"], r["head"], "http://x.org/r").orderBy("rule_ord").collect()])
    rows = rules_xml.parse(spark.createDataFrame([("r", xml)], "file string, xml string")).collect()
    assert sorted((x.rid.split("#")[1], x.pred.split("#")[1], x.value) for x in rows if x.part == "body") == [("r1", "Is_it_large", True), ("r2", "Is_it_large", False)]
    assert {x.norm.split("#")[1] for x in rows if x.part == "head"} == {"OBL_1", "REC_1"}


def test_graph_and_presets(spark, two):
    rows, _, _ = two
    records = diagrams.records(rows)
    triples = graph.cut(abox(records))
    by = {name: preset(triples).collect() for name, preset in PRESETS.items()}
    assert [(x.deonticId, x.agentLabel) for x in by["norms-by-agent"]] == [("OBL_1", "Provider"), ("REC_1", "provider")]
    assert [x.deonticId for x in by["high-priority-norms"]] == ["OBL_1"]
    assert sinks.turtle_blocks(triples).count() == triples.select("s").distinct().count()


def test_loop_is_dropped_with_a_warning(spark):
    t = diagrams.tables(diagrams.parse(spark.createDataFrame([("l", LOOP)], "file string, xml string")))
    rows = graph.reduce_graph(t["nodes"], t["flows"]).collect()
    assert [(x.src, x.dst, list(x.tasks)) for x in rows if not x.loop] == [("S", "E", ["A"])]
    assert any(x.loop for x in rows)


def test_contradictions_and_duplicates(spark):
    rows = spark.createDataFrame([("r1", "a", True, 1), ("r1", "a", True, 2), ("r2", "a", True, 1), ("r2", "a", False, 2)], "rid string, pred string, value boolean, pos int")
    assert [(x.rid, x.pos) for x in rules.consistent(rows).collect()] == [("r1", 1)]


def test_empty_body_matches_and_missing_fact_does_not(spark):
    facts = spark.createDataFrame([("x", "p", True)], "scenario_id string, pred string, value boolean")
    body = spark.createDataFrame([("r1", "p", True), ("r1", "q", False)], "rid string, pred string, value boolean")
    names = spark.createDataFrame([("r1",), ("r0",)], "rid string")
    assert [x.rid for x in evaluate.matched(facts, facts.select("scenario_id"), names, body).collect()] == ["r0"]


def test_labels(spark):
    rows = spark.createDataFrame([("Café  au-lait!\n", "  A b--c_ ", "boxes")], "a string, b string, c string")
    assert tuple(rows.select(T.symbol(F.col("a")), T.slug(F.col("b")), T.singular(F.col("c"))).first()) == ("Café_aulait", "A_b_c", "box")


def test_resolution(spark):
    rows = [(1, "AI Act", ""), (2, "EU AI Act", ""), (3, "providers", ""), (4, "Provider", ""), (5, "deployer of systems", ""), (6, "deployer of system", "")]
    records = spark.createDataFrame(rows, "ord int, agent string, deontic_type string")
    got = {x.label: x.winner for x in resolve.resolve_field(records, "agent").collect()}
    assert got["AI Act"] == "EU AI Act" and got["providers"] == "Provider"
    assert got["deployer of systems"] == got["deployer of system"]


def test_path_closure(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "q", "d")], "s string, p string, o string")
    assert sorted(map(tuple, path(t, "p+").collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert sorted(map(tuple, path(t, "p/q").collect())) == [("b", "d")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    frame, want = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    tidy = lambda rows: sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert tidy([tuple(r[c] for c in columns) for r in frame.collect()]) == tidy(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_norm_patch_counts_and_filter(spark):
    rows = spark.createDataFrame([("A", "obligation", "x"), ("B", "Negativerecommendation", "y"), (None, None, "z")], "deontic_id string, norm_type string, agent string")
    edits = spark.createDataFrame([("B", None, "new", "?"), ("C", "permission", "c", "?"), (None, "lost", "lost", "?")], "deontic_id string, norm_type string, agent string, other string")
    out = norms.patch(rows, edits)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("A", "obligation", "x"), ("B", "Negativerecommendation", "new"), ("C", "permission", "c"), (None, None, "z")], key=str)
    counts = norms.type_counts(out, {"negativerecommendation": "recommendation_not"})
    assert {r["type"]: r["n"] for r in counts.collect()} == {"obligation": 1, "recommendation_not": 1, "permission": 1}
    assert [r["deontic_id"] for r in rows.where(norms.has_text(F.lit(" OBLIGATION X"), "norm_type", "agent")).collect()] == ["A"]
    assert norms.patch(rows.limit(0), edits.limit(0)).count() == 0


def test_rdf_xml_is_read_back(spark):
    schema = "s string, p string, o string, o_kind string, datatype string, lang string"
    data = [("n1", "rdf:type", "Norm", "iri", None, None), ("n1", "text", 'a < b & "c"\n', "literal", "xsd:string", None), ("n1", "day", "2024-01-01", "literal", "xsd:date", None), ("n2", "label", "x", "literal", None, "en")]
    blocks = sinks.rdf_xml(spark.createDataFrame(data, schema), "http://e.org/a").orderBy("s").collect()
    first, last = sinks.rdf_xml_root("http://e.org/a")
    root = ElementTree.fromstring("\n".join([first, *[r["block"] for r in blocks], last]))
    rdf, own = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://e.org/a#}"
    n1, n2 = root
    assert n1.get(f"{rdf}about") == "http://e.org/a#n1" and n1.find(f"{rdf}type").get(f"{rdf}resource") == "http://e.org/a#Norm"
    assert n1.find(f"{own}text").text == data[1][2] and n1.find(f"{own}day").get(f"{rdf}datatype") == "http://www.w3.org/2001/XMLSchema#date"
    assert n2.find(f"{own}label").get("{http://www.w3.org/XML/1998/namespace}lang") == "en"


def test_a_long_chain_is_closed(spark):
    triples = spark.createDataFrame([(f"n{k}", "p", f"n{k + 1}") for k in range(200)], "s string, p string, o string")
    assert path(triples, "p+").count() == 200 * 201 // 2


def test_a_limit_that_is_met_raises(spark):
    edges = spark.createDataFrame([("f", f"e{k}", f"n{k}", f"n{k + 1}", 0) for k in range(4)], "file string, edge_id string, src string, dst string, rank int")
    one = lambda n: spark.createDataFrame([("f", n)], "file string, node string")
    for run in (lambda n: graph.simple_paths(edges, one("n0"), one("n4"), n), lambda n: graph.min_depths(edges, one("n0"), n)):
        assert run(4).count() == run(None).count() > 0
        with pytest.raises(ValueError):
            run(3)


def test_all_rules_without_a_body_match(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BROADCAST_RULES", 2)
    facts = spark.createDataFrame([("x", "p", True), ("y", "p", False)], "scenario_id string, pred string, value boolean")
    body = spark.createDataFrame([("r0", "p", True)], "rid string, pred string, value boolean")
    names = spark.createDataFrame([(f"r{k}",) for k in range(6)], "rid string")
    got = sorted(map(tuple, evaluate.matched(facts, facts.select("scenario_id"), names, body).collect()))
    assert got == sorted([("x", "r0"), *[(s, f"r{k}") for s in "xy" for k in range(1, 6)]])


def test_normalizer_decides_warns_and_reuses_norms(spark):
    names = ["ord", "element_type", "deontic_type", "regulation", "agent", "object", "action", "deontic_id", "condition_statement", "article", "paragraph", "trigger_condition", "norm_statement", "fact_statement"]
    task = lambda k, reg, agent, obj, act, did, kind="obligation": (k, "task", kind, reg, agent, obj, act, did, "", "5", "", "", "", "")
    rows = [
        task(1, "IA act", "AI provider", "system", "report incident", "OBL_1"), task(2, "EU AI Act", "AI Provider", "systems", "report incidents", "OBL_2"),
        task(3, "eu-ai-act", "deployer", "systemz", "report incidents", "PRH_9", "prohibition"), task(4, "GDPR", "importer", "manual name", "notify", "OBL_4"),
        task(5, "nis2", "importr", "s", "log", "OBL_5"), (6, "exclusiveGateway", "", "GDPR", "", "", "", "", "Is it large", "", "", "", "", ""),
    ]
    records = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'ord' else 'string'}" for c in names))
    override = spark.createDataFrame([("object", "manual name", "widget")], "field string, label string, winner string")
    apart = spark.createDataFrame([("importr", "importer")], "a string, b string")
    out, decisions, warnings = resolve.normalize(records, override, apart)
    got = {r.ord: r for r in out.collect()}
    assert [got[k].regulation for k in (1, 2, 3, 5)] == ["EU AI Act"] * 3 + ["NIS 2"] and got[2].agent == "AI provider"
    assert got[2].object == "system" and got[3].object == "system" and got[4].object == "widget" and got[5].agent == "importer" and got[5].object == "s"
    assert got[2].action == "report incident" and got[3].action == "report incident"  # an obligation says the plural too, so the labels are compatible
    assert got[2].deontic_id == "OBL_1" and got[3].deontic_id == "PRH_9" and got[6].condition_statement == "Is it large"
    told = {(r.field, tuple(r.labels), r.winner, r.reason) for r in decisions.collect()}
    assert ("agent", ("AI provider", "AI Provider"), "AI provider", "first_seen") in told
    assert ("regulation", ("IA act", "EU AI Act", "eu-ai-act"), "EU AI Act", "alias") in told
    assert ("object", ("system", "systems"), "system", "plural_variant") in told
    assert ("agent", ("importer", "importr"), "importer", "fuzzy (first_seen)") in told and ("deontic_id", ("OBL_1", "OBL_2"), "OBL_1", "norm_signature") in told
    assert ("object", ("system", "systemz")) in {(r.field, tuple(r.labels)) for r in warnings.collect()}
    assert not any(r.field == "agent" for r in warnings.collect())


def test_similar_pairs_equal_brute_force(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    from ruleweave.functions import similarity

    rng = random.Random(3)
    base = ["report the incident to the authority", "keep the logs", "naïve Übung", "", "a"]
    texts = sorted({"".join(c for c in rng.choice(base) if rng.random() > 0.1) + rng.choice(["", "s", " now"]) for _ in range(60)})
    monkeypatch.setattr(similarity, "CHUNK", 7)
    rows = spark.createDataFrame([(g, k, t) for g in ("x", "y") for k, t in enumerate(texts) if g == "x" or k % 2], "grp string, place long, text string")
    want = {(g, i, j) for g in ("x", "y") for i in range(len(texts)) for j in range(i + 1, len(texts)) if (g == "x" or i % 2 and j % 2) and SequenceMatcher(None, texts[i], texts[j]).ratio() >= 0.82}
    got = similarity.similar_pairs(rows, 0.82).collect()
    assert {(r.grp, r.a, r.b) for r in got} == want and len(got) == len(want)


def duplicates(norms, keep=55):
    """Scores of all pairs, each by itself."""
    from difflib import SequenceMatcher

    plain = lambda x: " ".join((x or "").lower().replace("_", " ").replace("-", " ").split())
    for i, a in enumerate(norms):
        for b in norms[i + 1 :]:
            if a["type"] and a["type"] == b["type"]:
                score = sum(w for c, w in resolve.WEIGHTS.items() if plain(a[c]) and plain(a[c]) == plain(b[c]))
                x, y = plain(a["statement"]), plain(b["statement"])
                score += 30 if x and y and SequenceMatcher(None, x, y).ratio() >= 0.82 else 0
                score += 15 if a["conditions"] and a["conditions"] == b["conditions"] else 0
                if score >= keep:
                    yield a["id"], b["id"], score


def test_duplicate_norms_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    words = ["report", "keep", "the", "incident", "logs", "authority"]
    norms = [{"id": k, "ord": k, "type": rng.choice(["obligation", "fact", ""]), **{c: rng.choice(["", "A-b", "a b", "c", "d"]) for c in resolve.WEIGHTS}, "statement": rng.choice(["", " ".join(rng.choice(words) for _ in range(4)), "Report the incident"]), "conditions": rng.choice([[], ["p=true"], ["q=false"]])} for k in range(70)]
    table = spark.createDataFrame([tuple(n.values()) for n in norms], "id int, ord int, type string, article string, regulation string, agent string, action string, object string, statement string, conditions array<string>")
    got = [(r.a, r.b, r.score) for r in resolve.duplicate_norms(table).collect()]
    assert sorted(got) == sorted(duplicates(norms)) and [x[2] for x in got] == sorted((x[2] for x in got), reverse=True)


def test_names_singulars_and_clauses(spark):
    row = spark.range(1).select(
        *[T.singular(F.lit(x)).alias(f"s{k}") for k, x in enumerate(["ies", "s", "ss", "boxes", "policies", "logs"])],
        *[T.pack_slug(F.lit(x)).alias(f"p{k}") for k, x in enumerate(["EU AI_Act!", "--", "Ünit 2"])],
        *[T.file_name(F.lit(x)).alias(f"f{k}") for k, x in enumerate(["../a b/c d?.bpmn", "", "é.xml"])],
        T.graph_iri("http://x.org", F.lit("My Pack_1")).alias("iri"), T.shortened(F.lit("http://x.org/a#b"), {"http://x.org/a#": "x:"}).alias("short"), T.suffix(F.lit("http://x.org/r/r1/")).alias("tail"),
        T.clause(F.lit("obligation"), F.lit("ai_provider"), F.lit("must report"), F.lit("incident"), F.lit(""), F.lit("OBL_1")).alias("c0"),
        T.clause(F.lit("Prohibition"), F.lit(""), F.lit("comply"), F.lit("rules"), F.lit("Never do this"), F.lit("x")).alias("c1"),
        T.clause(F.lit("fact"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("FACT_large_system")).alias("c2"),
        T.clause(F.lit("other"), F.lit("a"), F.lit("b"), F.lit(""), F.lit(""), F.lit("OBL_x_y")).alias("c3"),
        T.type_label(F.lit("NegativeRecommendation")).alias("t0"), T.type_label(F.lit("")).alias("t1"),
    ).first()
    assert list(row)[:6] == ["y", "", "ss", "box", "policy", "log"] and list(row)[6:9] == ["eu-ai-act", "pack", "ünit-2"]
    assert list(row)[9:12] == ["c_d_.bpmn", "upload.bpmn", "é.xml"] and (row.iri, row.short, row.tail) == ("http://x.org/my-pack-1", "x:b", "r1")
    assert (row.c0, row.c1, row.c2, row.c3) == ("Ai provider MUST report on incident", "MUST NOT comply for rules: Never do this", "IS Large system", "X y")
    assert (row.t0, row.t1) == ("Negative recommendation", "Gateways")


def test_rule_atoms_and_json_round_trip(spark, two):
    _, t, r = two
    atoms = graph.cut(rules.rule_atoms(r["norms"], r["rules"], t["props"]))
    said = {(a.predicate, a.subject, a.object) for a in atoms.where("rid = 'r1'").collect()}
    assert {("rdf:type", "OBL_1", "Obligation"), ("hasLegalAgent", "OBL_1", "Agent_Provider"), ("hasComplianceCriticality", "OBL_1", "High"), ("fromArticle", "OBL_1", "5"), ("fromParagraph", "OBL_1", ""), ("hasLegalObject", "OBL_1", "Object_unnamed")} <= said
    assert not any(p in ("wasGeneratedByAnnotationActivity", "normStatement", "sourceURI") for p, _, _ in said)
    back = rules.from_json(rules.to_json(r["rules"], r["body"], atoms, r["head"]).select("line"))
    for name, columns in (("body", ["rid", "pred", "value", "local"]), ("atoms", ["rid", "kind", "predicate", "subject", "object", "datatype"]), ("head", ["rid", "event", "norm"]), ("rules", ["rid", "file"])):
        was = atoms if name == "atoms" else r[name]
        assert sorted(map(tuple, back[name].select(columns).collect()), key=repr) == sorted(map(tuple, was.select(columns).collect()), key=repr)
    listed = rules.rule_listing(r["rules"], r["body"], r["norms"], atoms).orderBy("rule_ord").collect()
    assert listed[0].compact == "r1: Is_it_large(?x, true) ⇒ Obligation(:OBL_1)" and 'fromArticle(:OBL_1, "5")' in listed[0].text and listed[0].is_conditional
    assert {x.event for x in r["head"].collect()} == {"TriggerEvent_Condition_Is_it_large_True_OBL_1", "TriggerEvent_Condition_Is_it_large_False_REC_1"}
