"""Views of norms, rules and graphs: listings, evaluated norms, and graphs of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions import text as T
from ruleweave.operators import evaluate
from ruleweave.operators.rules import PREFIX, minimal_conditions

# Fields of a norm by property.
NORM_FIELDS = {
    "compliance_elementType": "element_type", "compliance_deonticType": "deontic_type", "compliance_normStatement": "norm_statement", "gw_conditionStatement": "gw_condition_statement", "gw_trueBranch": "gw_true_branch",
    "gw_falseBranch": "gw_false_branch", "compliance_agent": "agent", "compliance_action": "action", "compliance_object": "object", "compliance_factStatement": "fact_statement", "compliance_bindingForce": "binding_force",
    "compliance_regulation": "regulation", "compliance_article": "article", "compliance_paragraph": "paragraph", "compliance_originalText": "original_text", "compliance_regulationURI": "regulation_uri",
    "compliance_jurisdiction": "jurisdiction", "compliance_triggerCondition": "trigger_condition", "compliance_status": "status", "compliance_effectiveDate": "effective_date", "compliance_deadline": "deadline",
    "compliance_riskLevel": "risk_level", "compliance_sanction": "sanction", "compliance_exception": "exception", "compliance_extractionMethod": "extraction_method", "compliance_confidence": "confidence",
    "compliance_legalReview": "legal_review", "compliance_annotator": "annotator", "compliance_annotationDate": "annotation_date", "compliance_lastReviewDate": "last_review_date",
}


def norm_conditions(atoms: DataFrame, body: DataFrame) -> DataFrame:
    """(norm_id, conditions): what all rules of a norm demand, as sorted (pred, value); ``atoms`` is of ``rule_atoms``."""
    named = atoms.where("predicate = 'deonticId'").select("rid", F.col("object").alias("norm")).distinct()
    every = minimal_conditions(named.join(body.select("rid", "pred", "value"), "rid", "left"))
    return every.where("pred is not null").groupBy(F.col("norm").alias("norm_id")).agg(F.array_sort(F.collect_list(F.struct("pred", "value"))).alias("conditions"))


def norm_listing(props: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """One row for each norm or gateway, by id: the trimmed fields of the first element with it, and its conditions.

    ``props`` is (file, element_id, key, value, seq). An element with a type has its id or one of type and name; one
    without is a gateway, named by its condition and branches.
    """
    keys = NORM_FIELDS | {PREFIX + "deonticId": "_id", "_bpmn_name": "_name"}
    cell = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.btrim("value"))), F.lit(""))
    rows = props.groupBy("file", "element_id").agg(F.min("seq").alias("seq"), *[cell(k).alias(c) for k, c in keys.items()])
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    kind = F.lower("deontic_type")
    branches = F.concat_ws("__", given("gw_true_branch"), given("gw_false_branch"))
    gateway = F.concat(F.lit("Gateway_"), T.symbol(F.coalesce(given("gw_condition_statement"), given("_name"), F.col("element_id"))), F.when(branches != "", F.concat(F.lit("__"), T.symbol(branches))).otherwise(""))
    norm = F.when(kind != "", F.coalesce(given("_id"), T.norm_id(kind, F.col("_name"), F.col("element_id")))).otherwise(gateway)
    rows = rows.withColumns({"norm_id": norm, "deontic_type": kind, "element_type": F.coalesce(given("element_type"), F.lit("task"))})
    columns = ["file", "element_id", *NORM_FIELDS.values()]
    first = rows.groupBy("norm_id").agg(F.min(F.struct("file", "seq", "element_id")).alias("ord"), F.min_by(F.struct(*columns), F.struct("file", "seq", "element_id")).alias("r")).select("norm_id", "ord", "r.*")
    if conditions is None:
        return first
    none = F.array().cast("array<struct<pred:string,value:boolean>>")
    return first.join(conditions, "norm_id", "left").withColumn("conditions", F.coalesce("conditions", none))


def norm_view(atoms: DataFrame) -> DataFrame:
    """One row for each rule and norm of ``rule_atoms``: the first value of what the atoms say of the norm."""
    named = atoms.where("predicate = 'deonticId'").groupBy("rid", F.col("subject"), F.col("object").alias("norm_id")).agg(F.min(F.struct("pos", "k")).alias("named"))
    at = F.struct("pos", "k")

    def first(predicate: str, kind: str) -> Column:
        return F.min_by("object", F.when((F.col("predicate") == predicate) & (F.col("kind") == kind), at))

    data = {"norm_statement": "normStatement", "action": "actionText", "_object": "objectText", "regulation": "fromRegulation", "article": "fromArticle", "paragraph": "fromParagraph", "source_uri": "sourceURI"}
    links = {"agent": "hasLegalAgent", "binding_force": "hasBindingForce", "risk_level": "hasComplianceCriticality", "_entity": "hasLegalObject"}
    said = atoms.groupBy("rid", "subject").agg(first("rdf:type", "class").alias("deontic_type"), *[first(p, "data").alias(c) for c, p in data.items()], *[first(p, "relation").alias(c) for c, p in links.items()])
    label = F.btrim(F.translate(F.replace("_entity", F.lit("Object_"), F.lit("")), "_", " "))
    rows = named.join(said, ["rid", "subject"]).withColumn("object", F.coalesce(F.nullif("_object", F.lit("")), F.nullif(label, F.lit(""))))
    return rows.select("rid", "norm_id", "named", "deontic_type", "norm_statement", "agent", "action", "object", "binding_force", "risk_level", "regulation", "article", "paragraph", "source_uri")


def evaluated_norms(matches: DataFrame, rules: DataFrame, atoms: DataFrame) -> DataFrame:
    """Norms of each scenario, as the first matched rule by ``rule_ord`` says them; ``matches`` is (scenario_id, rid).

    A rule may be named by an IRI, whose last part counts.
    """
    named = matches.select("scenario_id", F.when(F.col("rid").rlike("[#/]"), T.suffix(F.col("rid"))).otherwise(F.col("rid")).alias("rid"))
    view = norm_view(atoms).join(rules.select("rid", "rule_ord", "file"), "rid")
    fields = [c for c in view.columns if c not in ("rule_ord", "named")]
    best = named.join(view, "rid").groupBy("scenario_id", "norm_id").agg(F.min(F.struct("rule_ord", "named")).alias("at"), F.min_by(F.struct(*fields), F.struct("rule_ord", "named")).alias("r"))
    return best.select("scenario_id", "at", "r.*")


def evaluate_pack(facts: DataFrame, scenarios: DataFrame, rules: DataFrame, body: DataFrame, atoms: DataFrame, parsed: DataFrame | None = None) -> tuple[DataFrame, str]:
    """(norms, engine): by the parsed rule file where there is one that can be read, else by the rules themselves.

    ``parsed`` has the rows of ``rules_xml.parse``; it is read here once, so that a broken file is known now.
    """
    from ruleweave.operators.graph import cut

    if parsed is not None:
        try:
            rows = cut(parsed)
            own = rows.where("part = 'body'").select("rid", T.suffix(F.col("pred")).alias("pred"), "value")
            found = evaluate.matched(facts, scenarios, rows.select("rid").distinct(), own)
            return evaluated_norms(found, rules, atoms), "rule_file"
        except Exception as error:  # whatever a file does to its reader
            if not any(x in str(error) for x in ("PythonException", "ParseError", "ValueError")):
                raise
    return evaluated_norms(evaluate.matched(facts, scenarios, rules, body), rules, atoms), "rules"


def entity_values(props: DataFrame) -> DataFrame:
    """(field, values): sorted different labels of each field that mints individuals."""
    keys = {"compliance_agent": "agent", "compliance_action": "action", "compliance_object": "object", "compliance_regulation": "regulation", "compliance_deonticId": "deontic_id", "gw_conditionStatement": "condition_statement"}
    rows = props.select(T.lookup(F.col("key"), keys).alias("field"), F.btrim("value").alias("value")).where("field is not null and value <> ''")
    return rows.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("values"))


def edited(override: DataFrame, confirmed: DataFrame, action: str, field: str = "", label: str = "", winner: str = "") -> tuple[DataFrame, DataFrame]:
    """Override (field, label, winner) and confirmed pairs (a, b) after one edit: merge, confirm_separate or remove_override."""
    spark, this = override.sparkSession, (F.col("field") == field) & (F.col("label") == label)
    if action == "merge":
        return override.where(~this).unionByName(spark.createDataFrame([(field, label, winner)], "field string, label string, winner string")), confirmed
    if action == "confirm_separate":
        low, high = sorted((label, winner))
        pair = spark.createDataFrame([(low, high)], "a string, b string")
        return override, confirmed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(pair).distinct()
    if action == "remove_override":
        return override.where(~this), confirmed
    raise ValueError(f"no such edit: {action}")


NODE = "struct<id:string,label:string,type:string>"


def norm_graph(views: DataFrame, rules: DataFrame, body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type) and edges (source, target, label) of norms, agents, objects and conditions.

    Each norm is as its first rule says it (``views`` of ``norm_view``); all its edges come from that rule.
    """
    fields = [c for c in views.columns if c != "norm_id"]
    first = views.join(rules.select("rid", "rule_ord"), "rid").groupBy("norm_id").agg(F.min_by(F.struct(*fields), F.struct("rule_ord", "named")).alias("r")).select("norm_id", "r.*")
    node = lambda id_, label, kind: F.struct(id_.alias("id"), label.alias("label"), kind.alias("type"))
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    agent = F.initcap(F.translate(F.replace("agent", F.lit("Agent_"), F.lit("")), "_", " "))
    thing = F.concat(F.lit("object::"), named("object"))
    nodes = F.array(node(F.col("norm_id"), F.coalesce(named("action"), F.col("norm_id")), F.coalesce("deontic_type", F.lit("Norm"))), node(named("agent"), agent, F.lit("Agent")), node(thing, F.col("object"), F.lit("Object"))).cast(f"array<{NODE}>")
    conditions = first.select("norm_id", "rid").join(body, "rid").select("norm_id", F.concat(F.lit("cond::"), "pred").alias("id"), F.translate("pred", "_", " ").alias("label"), "value")
    out = first.select(F.inline(nodes)).where("id is not null").unionByName(conditions.select("id", "label", F.lit("Condition").alias("type")))
    edge = lambda a, b, label: F.struct(a.alias("source"), b.alias("target"), F.lit(label).alias("label"))
    links = first.select(F.inline(F.array(edge(named("agent"), F.col("norm_id"), "performs"), edge(F.col("norm_id"), thing, "acts on")))).where("source is not null and target is not null")
    when = conditions.select(F.col("id").alias("source"), F.col("norm_id").alias("target"), F.when(F.col("value"), "when true").otherwise("when false").alias("label"))
    return out.groupBy("id").agg(F.min(F.struct("type", "label")).alias("x")).select("id", "x.label", "x.type"), links.unionByName(when).distinct()


# What a node of the semantic graph shows, classes that are no nodes, and properties that are edges.
SHOWN = {
    "rdfs:label": "label", "fromRegulation": "regulation", "fromArticle": "article", "fromParagraph": "paragraph", "sourceURI": "source", "deonticId": "deontic_id", "normStatement": "norm_statement", "conditionStatement": "condition_statement",
    "conditionTrigger": "trigger_condition", "agentText": "agent", "actionText": "action", "objectText": "object", "hasOutcome": "outcome", "annotationDate": "annotation_date", "confidenceScore": "confidence",
}
HIDDEN = ("NormativeContent", "RegulativeNorm", "TriggerEvent")
EDGES = ("hasLegalAgent", "hasLegalAction", "hasLegalObject", "hasLegalSource", "hasSourceExpression", "wasGeneratedByAnnotationActivity", "wasAttributedToAnnotator", "wasAssociatedWithAnnotator", "usedLegalSource", "wasDerivedFromSource", "relatesTo", "supersededBy")


def semantic_nodes(triples: DataFrame) -> DataFrame:
    """One row for each individual with a class that is shown: its first type by name, and the least value of each property."""
    typed = F.when((F.col("p") == "rdf:type") & ~F.col("o").isin(*HIDDEN), F.col("o"))
    rows = triples.groupBy(F.col("s").alias("id")).agg(F.min(typed).alias("type"), *[F.min(F.when((F.col("p") == p) & (F.col("o") != ""), F.col("o"))).alias(c) for p, c in SHOWN.items()])
    return rows.where("type is not null").withColumn("label", F.coalesce("label", T.local_name(F.col("id"))))


def semantic_edges(triples: DataFrame, nodes: DataFrame, body: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Different edges (source, target, label) between ``nodes``: links, and from conditions to the norms of their rules.

    A property's label in the triples names its edges, else its local name. ``body`` is (rid, pred, value), ``named``
    (rid, norm_id); conditions are found by letters and digits alone.
    """
    labels = triples.where("p = 'rdfs:label'").groupBy(F.col("s").alias("p")).agg(F.min("o").alias("name"))
    links = triples.where(F.col("p").isin(*EDGES) & (F.col("o_kind") == "iri")).join(F.broadcast(labels.where(F.col("p").isin(*EDGES))), "p", "left")
    every = links.select(F.col("s").alias("source"), F.col("o").alias("target"), F.coalesce("name", T.local_name(F.col("p"))).alias("label"))
    part = lambda p, s, o: triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    fired = part("hasTrigger", "source", "event").join(part("activatesNorm", "event", "target"), "event").join(part("hasOutcome", "event", "outcome"), "event")
    every = every.unionByName(fired.select("source", "target", F.when(F.col("outcome") == "TrueOutcome", "when true").otherwise("when false").alias("label")))
    if body is not None and named is not None:
        keys = F.array(*[F.struct(F.lit(k).alias("rank"), T.condition_key(F.col(c)).alias("key")) for k, c in enumerate(("condition_statement", "label", "id"))])
        known = nodes.where("type = 'LegalCondition'").select("id", F.inline(keys)).where("key <> ''").groupBy("key").agg(F.min_by("id", F.struct("id", "rank")).alias("source"))
        norms = nodes.select(F.coalesce("deontic_id", T.local_name(F.col("id"))).alias("norm_id"), F.col("id").alias("target")).groupBy("norm_id").agg(F.min("target").alias("target"))
        rules = body.withColumn("key", T.condition_key(F.col("pred"))).join(known, "key").join(named, "rid").join(norms, "norm_id")
        every = every.unionByName(rules.select("source", "target", F.when(F.col("value"), "when true").otherwise("when false").alias("label")))
    keep = nodes.select("id")
    return every.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "label").distinct()


def searched(nodes: DataFrame, edges: DataFrame, query: str, hidden: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type) that say all words of ``query``, or end an edge whose label does, and the edges among them.

    Types in ``hidden`` are left out first.
    """
    shown = nodes.where(~F.col("type").isin(*hidden)) if hidden else nodes
    hit = shown.where(T.contains_all(F.concat_ws(" ", "id", "label", "type"), F.lit(query))).select("id")
    ends = edges.where(T.contains_all(F.col("label"), F.lit(query))).select(F.explode(F.array("source", "target")).alias("id"))
    keep = hit.unionByName(ends).distinct().join(shown.select("id"), "id", "left_semi")
    among = edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown.join(keep, "id", "left_semi"), among
