"""Rules from process diagrams: paths to bodies, heads and exports; all order is in explicit places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.functions import text as T
from ruleweave.operators import graph

PREFIX = "compliance_"


def consistent(atoms: DataFrame) -> DataFrame:
    """Atoms (rid, pred, value, pos) once each at their first place, without rules that demand both values of a predicate."""
    each = atoms.groupBy("rid", "pred").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("pos").alias("pos"))
    bad = each.where("low <> high").select("rid").distinct()
    return each.join(bad, "rid", "left_anti").select("rid", "pred", F.col("low").alias("value"), "pos")


def minimal_conditions(rows: DataFrame) -> DataFrame:
    """(norm, pred, value) that every rule of a norm has; ``rows`` is (norm, rid, pred, value)."""
    rules = rows.groupBy("norm").agg(F.count_distinct("rid").alias("n_rules"))
    shared = rows.groupBy("norm", "pred", "value").agg(F.count_distinct("rid").alias("n"))
    return shared.join(rules, "norm").where("n = n_rules").select("norm", "pred", "value")


def ordered_edges(edges: DataFrame, nodes: DataFrame, gateway_order: DataFrame, depths: DataFrame) -> DataFrame:
    """Edges with ``edge_id``, ``rank`` among the source's edges, and a branch's place and number at gateways.

    Gateways order their branches by the target's depth, then their outgoing flows; other nodes keep the reduced order.
    """
    kinds = nodes.select("file", F.col("id").alias("src"), F.col("type").alias("src_type"))
    place = gateway_order.select("file", F.col("gateway_id").alias("src"), F.col("flow_id").alias("first_flow"), F.col("pos").alias("branch_pos"))
    branches = gateway_order.groupBy("file", F.col("gateway_id").alias("src")).agg(F.count("*").cast("int").alias("branches"))
    rows = edges.where("not loop").withColumn("edge_id", F.concat_ws(">", "src", "dst", F.array_join("via_flows", "+"))).withColumn("first_flow", F.get("via_flows", F.lit(0)))
    rows = rows.join(kinds, ["file", "src"], "left").join(place, ["file", "src", "first_flow"], "left").join(branches, ["file", "src"], "left").join(depths.select("file", F.col("node").alias("dst"), "depth"), ["file", "dst"], "left")
    far = F.lit(1 << 30)
    gateway = F.col("src_type") == "exclusiveGateway"
    order = Window.partitionBy("file", "src").orderBy(F.when(gateway, F.coalesce("depth", far)).otherwise(far), F.when(gateway, F.coalesce("branch_pos", far)).otherwise(far), "ord")
    return rows.withColumn("rank", F.row_number().over(order))


def derive(nodes: DataFrame, flows: DataFrame, gateway_order: DataFrame, props: DataFrame) -> dict[str, DataFrame]:
    """Rule tables of all files: ``rules`` (rid, file, n), ``body`` (rid, pred, value, pos, local), ``norms`` (rid, norm, kind, pos,
    element), ``head`` (rid, rule_ord, pos, event, norm), ``superiority`` (file, over, under), ``warnings``.

    Every simple path from start to end is one rule; it takes a number even if it is dropped for contradiction.
    """
    reduced = graph.cut(graph.reduce_graph(nodes, flows))
    starts = nodes.where("type = 'startEvent'").select("file", F.col("id").alias("node"))
    ends = nodes.where("type = 'endEvent'").select("file", F.col("id").alias("node"))
    depths = graph.min_depths(reduced.where("not loop"), starts)
    edges = graph.cut(ordered_edges(reduced, nodes, gateway_order, depths))
    paths = graph.simple_paths(edges, starts, ends)
    number = F.row_number().over(Window.partitionBy("file").orderBy("rank"))
    # Files are numbered by the counts of their paths; there is a row for each file only.
    paths = graph.cut(paths.withColumn("n", number))
    sizes = paths.groupBy("file").agg(F.max("n").alias("m")).withColumn("offset", F.sum("m").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    paths = paths.join(sizes.select("file", F.coalesce("offset", F.lit(0)).alias("offset")), "file").withColumn("rule_ord", F.col("offset") + F.col("n")).withColumn("rid", F.concat(F.lit("r"), F.col("rule_ord")))
    steps = graph.cut(paths.select("file", "rid", "rule_ord", "n", F.posexplode("edge_ids").alias("step", "edge_id")).join(edges.select("file", "edge_id", "src", "src_type", "guard", "tasks", "branch_pos", "branches"), ["file", "edge_id"]))
    value = lambda key, alias: F.max(F.when(F.col("key") == key, F.nullif("value", F.lit("")))).alias(alias)
    by = props.groupBy("file", "element_id").agg(value("gw_conditionStatement", "statement"), value("gw_trueBranch", "true_branch"), value("gw_falseBranch", "false_branch"), value("compliance_deonticType", "kind"), value("compliance_deonticId", "deontic_id"), F.max(F.when(F.col("key") == "_bpmn_name", F.nullif("value", F.lit("")))).alias("name"))
    names = nodes.select("file", F.col("id").alias("element_id"), F.nullif("name", F.lit("")).alias("node_name"))
    gate = steps.where("src_type = 'exclusiveGateway'").withColumnRenamed("src", "element_id").join(by, ["file", "element_id"], "left").join(names, ["file", "element_id"], "left")
    truth = T.branch_truth(F.col("guard"), F.coalesce("true_branch", F.lit("Yes")), F.coalesce("false_branch", F.lit("No")), F.col("branch_pos"), F.col("branches"))
    label = F.coalesce("statement", "name", "node_name")
    local = F.concat(F.lit("Condition_"), T.slug(F.coalesce(label, F.col("element_id"))))
    atoms = graph.cut(gate.select("rid", T.symbol(label).alias("pred"), truth.alias("value"), F.col("step").alias("pos"), local.alias("local")).where("value is not null"))
    body = graph.cut(consistent(atoms).join(atoms.select("rid", "pos", "local"), ["rid", "pos"]).select("rid", "pred", "value", "pos", "local"))
    bad = atoms.select("rid").distinct().join(body.select("rid").distinct(), "rid", "left_anti")
    rules = graph.cut(paths.select("rid", "file", "n", "rule_ord").join(bad, "rid", "left_anti"))
    done = steps.select("file", "rid", "rule_ord", "step", F.posexplode("tasks").alias("k", "element_id")).join(by, ["file", "element_id"])
    # Tasks without a type are norms of no particular class; those with a type of another vocabulary are none.
    done = done.withColumn("kind", F.lower(F.btrim("kind"))).where(F.col("kind").isNull() | F.col("kind").isin(*T.NORM_CLASS))
    norm = T.symbol(F.coalesce("deontic_id", T.norm_id(F.col("kind"), F.col("name"), F.col("element_id"))))
    norms = done.join(rules.select("rid"), "rid", "left_semi").groupBy("rid", norm.alias("norm"), "kind").agg(F.min(F.struct("step", "k", "element_id")).alias("at"))
    norms = graph.cut(norms.select("rid", "norm", "kind", F.row_number().over(Window.partitionBy("rid").orderBy("at")).alias("pos"), F.col("at.element_id").alias("element")))
    # Only the last condition of a rule decides its triggers.
    last = body.groupBy("rid").agg(F.max_by(F.struct("local", "value"), "pos").alias("c"))
    head = norms.join(last, "rid").join(rules.select("rid", "rule_ord"), "rid").select("rid", "rule_ord", "pos", T.trigger_id(F.col("c.local"), F.col("c.value"), T.slug(F.col("norm"))).alias("event"), "norm")
    return {"rules": rules, "body": body, "norms": norms, "head": head, "superiority": graph.superiority(rules), "warnings": reduced.where("loop").select("file", "src", "dst", "via_flows"), "edges": edges}


def exportable(rules: DataFrame, body: DataFrame, head: DataFrame) -> DataFrame:
    """Rules with conditions and triggers."""
    return rules.join(body.select("rid").distinct(), "rid", "left_semi").join(head.select("rid").distinct(), "rid", "left_semi")


def norm_table(norms: DataFrame, props: DataFrame, files: DataFrame) -> DataFrame:
    """One row per norm: the first value of each property of its elements (pivot), by rule order."""
    rows = norms.join(files.select("rid", "file", "rule_ord"), "rid").join(props.withColumnRenamed("element_id", "element"), ["file", "element"]).where("value <> ''")
    first = rows.groupBy("norm", "kind", F.regexp_replace("key", f"^{PREFIX}", "").alias("key")).agg(F.min_by("value", F.struct("rule_ord", "pos")).alias("value"))
    return first.groupBy("norm", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))


def condition_catalog(body: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct predicates in order of first use."""
    return body.join(rules.select("rid", "rule_ord"), "rid").groupBy("pred").agg(F.min(F.struct("rule_ord", "pos")).alias("first")).orderBy("first", "pred").select("pred")


def _side(rows: DataFrame, atom, name: str, joint: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", atom.alias("t")))), lambda x: x["t"])
    return rows.groupBy("rid").agg(F.array_join(ordered, joint).alias(name))


def rule_text(rules: DataFrame, body: DataFrame, norms: DataFrame, atoms: DataFrame | None = None, multiline: bool = False) -> DataFrame:
    """(rid, rule_ord, text): ``r1: a(?x, true) ⇒ Class(:norm)``; an empty side is ``⊤``.

    With ``atoms`` (of ``norm_atoms``) the head names relations and data too; else it is compact, with classes alone.
    """
    joint = "\n    ∧ " if multiline else " ∧ "
    left = _side(body, F.concat("pred", F.lit("(?x, "), F.col("value").cast("string"), F.lit(")")), "l", joint)
    classes = norms.select("rid", F.struct(F.lit(0).alias("part"), F.col("pos"), F.lit(0).alias("k")).alias("pos"), F.concat(T.lookup(F.col("kind"), T.NORM_CLASS, F.lit("RegulativeNorm")), F.lit("(:"), "norm", F.lit(")")).alias("t"))
    if atoms is not None:
        shown = F.when(F.col("kind") == "relation", F.concat("predicate", F.lit("(:"), "subject", F.lit(", "), "object", F.lit(")"))).otherwise(F.concat("predicate", F.lit("(:"), "subject", F.lit(', "'), "object", F.lit('")')))
        rest = atoms.where("kind <> 'class'").select("rid", F.struct(F.when(F.col("kind") == "relation", 1).otherwise(2).alias("part"), F.col("pos"), F.col("k")).alias("pos"), shown.alias("t"))
        classes = classes.unionByName(rest)
    right = _side(classes, F.col("t"), "r", joint)
    top = F.lit("⊤")
    sides = [F.coalesce("l", top), F.coalesce("r", top)]
    text = F.concat(F.col("rid"), F.lit(":\n  "), sides[0], F.lit("\n  ⇒\n    "), sides[1]) if multiline else F.concat(F.col("rid"), F.lit(": "), sides[0], F.lit(" ⇒ "), sides[1])
    return rules.select("rid", "rule_ord").join(left, "rid", "left").join(right, "rid", "left").select("rid", "rule_ord", text.alias("text"))


def rule_listing(rules: DataFrame, body: DataFrame, norms: DataFrame, atoms: DataFrame) -> DataFrame:
    """(rid, file, rule_ord, is_conditional, conditions, text, compact): ``conditions`` are (pred, value) in order."""
    conditions = F.transform(F.array_sort(F.collect_list(F.struct("pos", "pred", "value"))), lambda x: F.struct(x["pred"].alias("pred"), x["value"].alias("value")))
    rows = rules.join(body.groupBy("rid").agg(conditions.alias("conditions")), "rid", "left")
    rows = rows.join(rule_text(rules, body, norms, atoms).select("rid", "text"), "rid").join(rule_text(rules, body, norms).select("rid", F.col("text").alias("compact")), "rid")
    return rows.select("rid", "file", "rule_ord", F.col("conditions").isNotNull().alias("is_conditional"), F.coalesce("conditions", F.array().cast(rows.schema["conditions"].dataType)).alias("conditions"), "text", "compact")


# Terms of the controlled vocabularies by symbol, for rules.
RULE_TERMS = {
    "bindingForce": ("hasBindingForce", {"hard_law": "HardLaw", "soft_law": "SoftLaw", "internal_policy": "InternalPolicy", "contractual": "Contractual"}),
    "riskLevel": ("hasComplianceCriticality", {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}),
    "status": ("hasNormStatus", {"active": "Active", "under_review": "UnderReview", "disputed": "Disputed", "superseded": "Superseded", "pending": "NotYetInForce"}),
    "extractionMethod": ("hasExtractionMethod", {"manual_lawyer": "ManualLawyer", "manual_analyst": "ManualAnalyst", "llm": "LLMExtraction", "pattern_matching": "PatternMatching", "rule_based": "RuleBased"}),
    "legalReview": ("hasReviewStatus", {"approved": "Approved", "pending": "PendingReview", "none": "NotReviewed"}),
}
ATOM = "struct<kind:string,predicate:string,subject:string,object:string,datatype:string>"


def norm_atoms(tasks: DataFrame) -> DataFrame:
    """All atoms (kind, predicate, subject, object, datatype, k) that the properties of a task say of its norm.

    ``tasks`` has ``element_id`` and ``fields``, a map of properties; other columns are carried along. ``kind`` is class,
    relation or data, and ``k`` the place within a kind. Blank values give no atom, but for the three anchors of a source,
    which data always names; vocabulary values without a term give none. Statements about the annotation are made only if
    an annotator, a date or a confidence is given.
    """
    field = lambda key: F.btrim(F.coalesce(F.col("fields")[key], F.lit("")))
    own = lambda key: field(PREFIX + key)
    given = lambda x: F.nullif(x, F.lit(""))
    kind = F.lower(F.coalesce(given(own("deonticType")), F.lit("unknown")))
    id_ = F.coalesce(given(own("deonticId")), T.norm_id(kind, field("_bpmn_name"), F.col("element_id")))
    minted = lambda prefix, value: F.when(value != "", F.concat(F.lit(prefix), T.symbol(value)))
    rows = tasks.withColumns({"_kind": kind, "_id": id_})
    norm, none = T.symbol(F.col("_id")), F.lit(None).cast("string")
    source, annotator = minted("Regulation_", own("regulation")), minted("Annotator_", own("annotator"))
    noted = (own("annotator") != "") | (own("annotationDate") != "") | (own("confidence") != "")
    activity = F.when(noted, F.concat(F.lit("AnnotationActivity_"), norm))
    atom = lambda kind, predicate, subject, object_, datatype=none: F.struct(F.lit(kind).alias("kind"), F.lit(predicate).alias("predicate"), subject.alias("subject"), object_.alias("object"), datatype.alias("datatype"))
    relations = [(p, norm, minted(prefix, own(key))) for p, prefix, key in (("hasLegalAgent", "Agent_", "agent"),)]
    # A norm without an action or object has the unnamed one.
    relations += [(p, norm, F.concat(F.lit(prefix), T.symbol(own(key)))) for p, prefix, key in (("hasLegalAction", "Action_", "action"), ("hasLegalObject", "Object_", "object"))]
    relations += [(p, norm, T.lookup(F.lower(T.symbol(own(key))), words)) for key, (p, words) in RULE_TERMS.items()]
    relations += [("hasLegalSource", norm, source), ("wasDerivedFromSource", norm, source), ("wasAttributedToAnnotator", norm, annotator), ("wasGeneratedByAnnotationActivity", norm, activity), ("wasAssociatedWithAnnotator", activity, annotator), ("usedLegalSource", activity, source)]
    text = F.lit("xsd:string")
    data = [("deonticId", norm, F.col("_id"), text), *[(p, norm, own(key), text) for p, key in (("fromRegulation", "regulation"), ("fromArticle", "article"), ("fromParagraph", "paragraph"))]]
    trigger = F.coalesce(given(own("triggerCondition")), own("condition"))
    data += [(p, norm, given(x), text) for p, x in (("normStatement", own("normStatement")), ("factStatement", own("factStatement")), ("conditionTrigger", trigger), ("exception", own("exception")), ("sanction", own("sanction")))]
    data += [("effectiveDate", norm, given(own("effectiveDate")), T.date_or_string(own("effectiveDate"))), ("deadline", norm, given(own("deadline")), text), ("lastReviewDate", norm, given(own("lastReviewDate")), T.date_or_string(own("lastReviewDate")))]
    data += [(p, norm, given(own(key)), text) for p, key in (("agentText", "agent"), ("actionText", "action"), ("objectText", "object"))]
    data += [("sourceURI", norm, given(own("regulationURI")), F.lit("xsd:anyURI")), ("confidenceScore", activity, given(own("confidence")), F.lit("xsd:decimal")), ("annotationDate", activity, given(own("annotationDate")), T.date_or_string(own("annotationDate")))]
    cls = atom("class", "rdf:type", norm, T.lookup(F.col("_kind"), T.NORM_CLASS, F.lit("RegulativeNorm")))
    every = F.array(cls, *[atom("relation", *x) for x in relations], *[atom("data", *x) for x in data]).cast(f"array<{ATOM}>")
    rows = rows.select(*tasks.columns, F.posexplode(every).alias("k", "_atom"))
    return rows.where("_atom.subject is not null and _atom.object is not null").select(*tasks.columns, "k", "_atom.*")


def rule_atoms(norms: DataFrame, rules: DataFrame, props: DataFrame) -> DataFrame:
    """(rid, pos, k, kind, predicate, subject, object, datatype): the atoms of each rule's norms, each once, first place kept.

    The properties of an element are gathered once, whatever the number of rules with it.
    """
    fields = props.groupBy("file", F.col("element_id")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("key", "value")))).alias("fields"))
    at = norms.join(rules.select("rid", "file"), "rid").select("rid", "file", F.col("element").alias("element_id"), "pos")
    atoms = norm_atoms(fields.join(at.select("file", "element_id").distinct(), ["file", "element_id"], "left_semi")).drop("fields")
    rows = at.join(atoms, ["file", "element_id"])
    first = rows.groupBy("rid", "kind", "predicate", "subject", "object", "datatype").agg(F.min(F.struct("pos", "k")).alias("at"))
    return first.select("rid", "at.pos", "at.k", "kind", "predicate", "subject", "object", "datatype")


RULE_JSON = "struct<rid:string,source:string,conditions:array<struct<pred:string,value:boolean,local:string>>,atoms:array<struct<kind:string,predicate:string,subject:string,object:string,datatype:string>>,triggers:array<struct<event:string,norm:string>>>"


def to_json(rules: DataFrame, body: DataFrame, atoms: DataFrame, head: DataFrame) -> DataFrame:
    """(rid, line): one JSON object for each rule, with its conditions, atoms and triggers in order."""
    def gathered(rows, order, fields, name):
        ordered = F.array_sort(F.collect_list(F.struct(*order, *fields)))
        return rows.groupBy("rid").agg(F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))

    rows = rules.select("rid", F.col("file").alias("source"))
    for part, order, fields, name in ((body, ["pos"], ["pred", "value", "local"], "conditions"), (atoms, ["pos", "k"], ["kind", "predicate", "subject", "object", "datatype"], "atoms"), (head, ["pos"], ["event", "norm"], "triggers")):
        rows = rows.join(gathered(part, order, fields, name), "rid", "left")
    return rows.select("rid", F.to_json(F.struct("rid", "source", "conditions", "atoms", "triggers")).alias("line"))


def from_json(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables ``rules``, ``body``, ``atoms`` and ``head`` of rows (line); parts that a rule lacks are empty."""
    rule = lines.select(F.from_json("line", RULE_JSON).alias("r")).select("r.*")
    part = lambda name: rule.select("rid", F.posexplode(name).alias("pos", "x")).select("rid", F.col("pos") + 1, "x.*").withColumnRenamed("(pos + 1)", "pos")
    return {"rules": rule.select("rid", F.col("source").alias("file")), "body": part("conditions"), "atoms": part("atoms"), "head": part("triggers")}
