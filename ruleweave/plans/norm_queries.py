"""Norm-graph operators over the test tables: parts as annotated tasks, with the SQL that says the same of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.operators import norms, resolve, rules, views
from ruleweave.operators.graph import cut
from ruleweave.operators.triples import abox
from ruleweave.plans.presets import PRESETS
from ruleweave.plans.table_queries import query, read
from ruleweave.sources import diagrams

KINDS = ["obligation", "prohibition", "permission", "recommendation", "recommendation_not", "fact", "other"]
FORCES = ["hard_law", "soft_law", "internal_policy", "contractual", "none"]
STATES = ["active", "under_review", "disputed", "superseded", "pending", "gone"]
RISKS = ["critical", "high", "medium", "low", "odd"]
METHODS = ["manual_lawyer", "manual_analyst", "llm", "pattern-matching", "rule-based", "guess"]
REVIEWS = ["approved", "pending", "none", "unknown"]

#: The same records in SQL; terms that the vocabularies lack are null.
_N = """n AS (
SELECT p_partkey, p_name AS label, p_brand AS agent, p_type AS object, 'handle ' || (p_size % 9) AS action, 'N-' || p_partkey AS deonticId, 'N_' || p_partkey AS iri,
['Obligation','Prohibition','Permission','Recommendation','NegativeRecommendation','ConstitutiveRule','RegulativeNorm'][p_size % 7 + 1] AS type,
'Act ' || (p_partkey % 49) AS regulation, 'Regulation_Act_' || (p_partkey % 49) AS source, nullif(p_partkey % 5, 0)::VARCHAR AS article, nullif(p_size % 3, 0)::VARCHAR AS paragraph,
['HardLaw','SoftLaw','InternalPolicy','Contractual',NULL][p_size % 5 + 1] AS force, ['Active','UnderReview','Disputed','Superseded','NotYetInForce',NULL][p_partkey % 6 + 1] AS status,
['Critical','High','Medium','Low',NULL][p_partkey % 5 + 1] AS risk, ['ManualLawyer','ManualAnalyst','LLMExtraction','PatternMatching','RuleBased',NULL][p_size % 6 + 1] AS method,
['Approved','PendingReview','NotReviewed',NULL][p_size % 4 + 1] AS review, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Ann ' || (p_partkey % 4) END AS annotator,
CASE WHEN p_partkey % 2 = 0 THEN '2024-01-0' || (1 + p_size % 9) END AS noted, CASE WHEN p_size % 4 > 0 THEN '0.' || (p_size % 4) END AS confidence, CASE WHEN p_partkey % 4 > 0 THEN '2025-02-1' || (p_size % 10) END AS reviewed
FROM part)
"""


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as the record of an annotated task."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda words, at: F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    empty = F.lit("")
    article, paragraph = F.when(key % 5 > 0, text(key % 5)).otherwise(empty), F.when(size % 3 > 0, text(size % 3)).otherwise(empty)
    given = {
        "bpmn_id": text("part", key), "bpmn_name": F.col("p_name"), "element_type": F.lit("task"), "deontic_type": pick(KINDS, size), "deontic_id": text("N-", key), "agent": F.col("p_brand"), "object": F.col("p_type"),
        "action": text("handle ", size % 9), "regulation": text("Act ", key % 49), "article": article, "paragraph": paragraph, "original_text": F.concat(F.lit("Text "), article, F.lit("."), paragraph),
        "binding_force": pick(FORCES, size), "norm_status": pick(STATES, key), "risk_level": pick(RISKS, key), "extraction_method": pick(METHODS, size), "review_status": pick(REVIEWS, size),
        "annotator": F.when(key % 3 > 0, text("Ann ", key % 4)).otherwise(empty), "annotation_date": F.when(key % 2 == 0, text("2024-01-0", size % 9 + 1)).otherwise(empty),
        "confidence": F.when(size % 4 > 0, text("0.", size % 4)).otherwise(empty), "last_review_date": F.when(key % 4 > 0, text("2025-02-1", size % 10)).otherwise(empty),
    }
    names = ["bpmn_id", "bpmn_name", "element_type", *diagrams.FIELDS.values()]
    return read(spark, sf, "part").select(*[given.get(c, empty).alias(c) for c in names], key.alias("ord"))


def part_props(spark: SparkSession, sf: str) -> DataFrame:
    """The same as rows of properties (file, element_id, key, value, seq)."""
    keys = {c: k for k, c in diagrams.FIELDS.items()}
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for c, k in keys.items()], F.struct(F.lit("_bpmn_name").alias("key"), F.col("bpmn_name").alias("value")))
    rows = part_records(spark, sf).select(F.lit("part").alias("file"), F.col("bpmn_id").alias("element_id"), F.inline(cells), F.col("ord").alias("seq"))
    return rows.where("value <> ''")


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    return cut(abox(part_records(spark, sf)))


def _preset(name: str):
    return lambda spark, sf: PRESETS[name](_triples(spark, sf))


def _add(name: str, run, sql: str | None) -> None:
    run.__name__ = name
    query(sql)(run)


_ANCHOR = "regulation, article, paragraph"
for _number, _column, _label in ((1, "agent", "agentLabel"), (2, "object", "objectLabel"), (3, "action", "actionLabel")):
    _add(f"p0{_number}_norms_by_{_column}", _preset(f"norms-by-{_column}"), f"""WITH {_N} SELECT type, {_column} AS "{_label}", deonticId AS "deonticId", label, {_ANCHOR} FROM n WHERE type <> 'RegulativeNorm'""")
_add("p04_norms_by_source_anchor", _preset("norms-by-source-anchor"), f"""WITH {_N} SELECT type, deonticId AS "deonticId", label, {_ANCHOR} FROM n WHERE type <> 'RegulativeNorm'""")
_add("p05_source_text", _preset("source-text-by-norm"), f"""WITH {_N}, t AS (SELECT DISTINCT source, 'Text ' || article || '.' || coalesce(paragraph, '') AS x FROM n WHERE article IS NOT NULL)
SELECT deonticId AS "deonticId", label, source, x AS "originalText" FROM n JOIN t USING (source)""")
_add("p06_shared_sources", _preset("shared-legal-sources"), f"""WITH {_N}, s AS (SELECT source, regulation, count(*) AS c FROM n GROUP BY ALL), a AS (SELECT DISTINCT source, article FROM n WHERE article IS NOT NULL),
p AS (SELECT DISTINCT source, paragraph FROM n WHERE article IS NOT NULL AND paragraph IS NOT NULL)
SELECT s.source, regulation AS "regulationName", article AS "articleNumber", paragraph AS "paragraphNumber", c AS "normCount" FROM s LEFT JOIN a ON a.source = s.source LEFT JOIN p ON p.source = s.source WHERE c > 1""")
_add("p07_annotation_provenance", _preset("annotation-provenance"), f"""WITH {_N} SELECT deonticId AS "deonticId", label, coalesce(annotator, 'Default annotator') AS "annotatorLabel", 'AnnotationActivity_' || iri AS activity,
coalesce(annotator, 'Default annotator') AS "activityAnnotatorLabel", noted AS "annotationDate", confidence AS "confidenceScore", method AS "extractionMethod" FROM n""")
_add("p08_review_status", _preset("norms-by-review-status"), f"""WITH {_N} SELECT deonticId AS "deonticId", label, review AS "reviewStatus", reviewed AS "lastReviewDate" FROM n WHERE review IS NOT NULL""")
_add("p09_status_and_force", _preset("status-and-binding-force"), f"""WITH {_N} SELECT deonticId AS "deonticId", label, status, force AS "bindingForce", risk AS criticality FROM n""")
_add("p10_high_priority", _preset("high-priority-norms"), f"""WITH {_N} SELECT type, deonticId AS "deonticId", label, risk AS criticality, regulation, article FROM n WHERE type <> 'RegulativeNorm' AND risk IN ('Critical', 'High')""")


@query(f"""WITH {_N}, k AS (SELECT iri AS id, type, label, regulation, article FROM n WHERE type <> 'RegulativeNorm' UNION ALL SELECT 'AnnotationActivity_' || iri, 'AnnotationActivity', 'Annotation activity for ' || deonticId, NULL, NULL FROM n
UNION ALL SELECT DISTINCT 'Agent_' || replace(agent, '#', '_'), 'LegalAgent', agent, NULL, NULL FROM n UNION ALL SELECT DISTINCT 'Object_' || object, 'LegalObject', object, NULL, NULL FROM n
UNION ALL SELECT DISTINCT 'Action_' || replace(action, ' ', '_'), 'LegalAction', action, NULL, NULL FROM n UNION ALL SELECT DISTINCT source, 'LegalSource', source, NULL, NULL FROM n
UNION ALL SELECT DISTINCT 'Annotator_' || replace(annotator, ' ', '_'), 'AnnotatorAgent', annotator, NULL, NULL FROM n WHERE annotator IS NOT NULL UNION ALL SELECT 'DefaultAnnotator', 'AnnotatorAgent', 'Default annotator', NULL, NULL)
SELECT * FROM k""")
def g06_semantic_nodes(spark, sf):
    return views.semantic_nodes(_triples(spark, sf)).select("id", "type", "label", "regulation", "article")


@query(f"""WITH {_N}, m AS (SELECT *, 'AnnotationActivity_' || iri AS activity, coalesce('Annotator_' || replace(annotator, ' ', '_'), 'DefaultAnnotator') AS who FROM n), e AS (
SELECT iri AS source, 'Agent_' || replace(agent, '#', '_') AS target, 'hasLegalAgent' AS label, type FROM m UNION ALL SELECT iri, 'Object_' || object, 'hasLegalObject', type FROM m
UNION ALL SELECT iri, 'Action_' || replace(action, ' ', '_'), 'hasLegalAction', type FROM m UNION ALL SELECT iri, source, 'hasLegalSource', type FROM m UNION ALL SELECT iri, source, 'wasDerivedFromSource', type FROM m
UNION ALL SELECT iri, who, 'wasAttributedToAnnotator', type FROM m UNION ALL SELECT iri, activity, 'wasGeneratedByAnnotationActivity', type FROM m
UNION ALL SELECT activity, who, 'wasAssociatedWithAnnotator', '' FROM m UNION ALL SELECT activity, source, 'usedLegalSource', '' FROM m)
SELECT source, target, label FROM e WHERE type <> 'RegulativeNorm'""")
def g06_semantic_edges(spark, sf):
    triples = _triples(spark, sf)
    return views.semantic_edges(triples, cut(views.semantic_nodes(triples)))


@query("""WITH k AS (SELECT 'part' || p_partkey AS e, ['Obligation','Prohibition','Permission','Recommendation','NegativeRecommendation','ConstitutiveRule','RegulativeNorm'][p_size % 7 + 1] AS class, 'N' || p_partkey AS norm, 'N-' || p_partkey AS id, * FROM part),
a AS (SELECT e, 'class' AS kind, 'rdf:type' AS predicate, norm AS subject, class AS object FROM k WHERE p_size % 7 < 6
UNION ALL SELECT e, 'relation', 'hasLegalAgent', norm, 'Agent_' || replace(p_brand, '#', '') FROM k UNION ALL SELECT e, 'relation', 'hasLegalAction', norm, 'Action_handle_' || (p_size % 9) FROM k
UNION ALL SELECT e, 'relation', 'hasComplianceCriticality', norm, ['Critical','High','Medium','Low'][p_partkey % 5 + 1] FROM k WHERE p_partkey % 5 < 4
UNION ALL SELECT e, 'relation', 'hasExtractionMethod', norm, ['ManualLawyer','ManualAnalyst','LLMExtraction'][p_size % 6 + 1] FROM k WHERE p_size % 6 < 3
UNION ALL SELECT e, 'relation', 'wasGeneratedByAnnotationActivity', norm, 'AnnotationActivity_' || norm FROM k WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0 OR p_size % 4 > 0
UNION ALL SELECT e, 'relation', 'usedLegalSource', 'AnnotationActivity_' || norm, 'Regulation_Act_' || (p_partkey % 49) FROM k WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0 OR p_size % 4 > 0
UNION ALL SELECT e, 'data', 'deonticId', norm, id FROM k UNION ALL SELECT e, 'data', 'fromParagraph', norm, coalesce(nullif(p_size % 3, 0)::VARCHAR, '') FROM k
UNION ALL SELECT e, 'data', 'lastReviewDate', norm, '2025-02-1' || (p_size % 10) FROM k WHERE p_partkey % 4 > 0 UNION ALL SELECT e, 'data', 'confidenceScore', 'AnnotationActivity_' || norm, '0.' || (p_size % 4) FROM k WHERE p_size % 4 > 0)
SELECT e AS element_id, kind, predicate, subject, object FROM a""")
def r02_norm_atoms(spark, sf):
    """Atoms of the parts' norms, of a part of the predicates; types out of the vocabulary are no norms here."""
    fields = part_props(spark, sf).groupBy("element_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
    shown = ("hasLegalAgent", "hasLegalAction", "hasComplianceCriticality", "hasExtractionMethod", "wasGeneratedByAnnotationActivity", "usedLegalSource", "deonticId", "fromParagraph", "lastReviewDate", "confidenceScore")
    atoms = rules.norm_atoms(fields)
    return atoms.where(F.col("predicate").isin(*shown) | ((F.col("predicate") == "rdf:type") & (F.col("object") != "RegulativeNorm"))).select("element_id", "kind", "predicate", "subject", "object")


@query("""WITH k AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'Gateway_' || replace(p_name, ' ', '_') || '__Yes' ELSE 'D-' || (p_partkey % 300) END AS norm_id FROM part)
SELECT norm_id, 'part' || arg_min(p_partkey, p_partkey) AS element_id, arg_min(CASE WHEN p_size % 4 = 0 THEN '' ELSE ['obligation','prohibition','permission','recommendation','recommendation_not','fact','other'][p_size % 7 + 1] END, p_partkey) AS deontic_type,
arg_min(p_brand, p_partkey) AS agent, arg_min(CASE WHEN p_size % 4 = 0 THEN 'Yes' ELSE '' END, p_partkey) AS gw_true_branch FROM k GROUP BY norm_id""")
def r15_norm_listing(spark, sf):
    """The first element of each norm; every fourth size is a gateway, and norms share 300 ids."""
    gate, key = F.col("p_size") % 4 == 0, F.col("p_partkey")
    kinds = F.get(F.array(*[F.lit(w) for w in KINDS]), (F.col("p_size") % 7).cast("int"))
    cells = {"compliance_deonticType": F.when(~gate, kinds), "compliance_deonticId": F.when(~gate, F.concat(F.lit("D-"), key % 300)), "_bpmn_name": F.col("p_name"), "compliance_agent": F.concat(F.lit(" "), "p_brand"), "gw_trueBranch": F.when(gate, "Yes")}
    rows = read(spark, sf, "part").select(F.lit("f").alias("file"), F.concat(F.lit("part"), key).alias("element_id"), key.alias("seq"), F.inline(F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in cells.items()])))
    return views.norm_listing(rows.where("value is not null")).select("norm_id", "element_id", "deontic_type", "agent", "gw_true_branch")


_EVENT_RULES = """r(rid, rule_ord, norm, action) AS (VALUES ('r1', 1, 'OBL_A', 'log it'), ('r2', 2, 'OBL_A', 'again'), ('r3', 3, 'PRH_B', 'stop')),
b(rid, pred, value) AS (VALUES ('r1', 'click', true), ('r1', 'error', true), ('r2', 'view', true), ('r3', 'purchase', true), ('r3', 'error', false)),
f AS (SELECT u.user_id, k.pred, count(e.event_id) > 0 AS value FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'error', 'view', 'purchase']) AS pred) k LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = k.pred AND e.value > 120 GROUP BY ALL),
z AS (SELECT rid, count(*) AS n FROM b GROUP BY rid), h AS (SELECT f.user_id, b.rid, count(*) AS n FROM f JOIN b ON f.pred = b.pred AND f.value = b.value GROUP BY f.user_id, b.rid), m AS (SELECT user_id, h.rid FROM h JOIN z ON z.rid = h.rid AND z.n = h.n)"""


def _event_rules(spark: SparkSession, sf: str):
    """Facts of the users, and three rules over them with the atoms of their norms."""
    kinds = ["click", "error", "view", "purchase"]
    seen = read(spark, sf, "events").groupBy("user_id").agg(*[F.coalesce(F.max((F.col("event_type") == k) & (F.col("value") > 120)), F.lit(False)).alias(k) for k in kinds])
    facts = seen.select(F.col("user_id").alias("scenario_id"), F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("pred", "value"))
    body = spark.createDataFrame([("r1", "click", True, 0), ("r1", "error", True, 1), ("r2", "view", True, 0), ("r3", "purchase", True, 0), ("r3", "error", False, 1)], "rid string, pred string, value boolean, pos int")
    listed = spark.createDataFrame([("r1", 1, "f"), ("r2", 2, "f"), ("r3", 3, "f")], "rid string, rule_ord int, file string")
    given = [("r1", "OBL_A", "log it", "obligation"), ("r2", "OBL_A", "again", "obligation"), ("r3", "PRH_B", "stop", "prohibition")]
    tasks = spark.createDataFrame([(rid, 1, rid, {"compliance_deonticId": norm, "compliance_action": action, "compliance_deonticType": kind, "compliance_agent": "user"}) for rid, norm, action, kind in given], "rid string, pos int, element_id string, fields map<string,string>")
    return facts, seen.select(F.col("user_id").alias("scenario_id")), listed, body, rules.norm_atoms(tasks)


@query(f"""WITH {_EVENT_RULES} SELECT user_id AS scenario_id, norm AS norm_id, arg_min(r.rid, rule_ord) AS rid, arg_min(action, rule_ord) AS action FROM m JOIN r ON r.rid = m.rid GROUP BY ALL""")
def r10_evaluated_norms(spark, sf):
    facts, users, listed, body, atoms = _event_rules(spark, sf)
    return views.evaluate_pack(facts, users, listed, body, atoms)[0].select("scenario_id", "norm_id", "rid", "action")


@query("""SELECT * FROM (VALUES ('Agent_user', 'OBL_A', 'performs'), ('Agent_user', 'PRH_B', 'performs'), ('OBL_A', 'object::unnamed', 'acts on'), ('PRH_B', 'object::unnamed', 'acts on'),
('cond::click', 'OBL_A', 'when true'), ('cond::error', 'OBL_A', 'when true'), ('cond::purchase', 'PRH_B', 'when true'), ('cond::error', 'PRH_B', 'when false')) v(source, target, label)""")
def g07_norm_graph(spark, sf):
    """Edges of the graph that is made from rules alone."""
    _, _, listed, body, atoms = _event_rules(spark, sf)
    return views.norm_graph(views.norm_view(atoms), listed, body)[1]


@query("""SELECT 'f' AS file, 'part' || p_partkey AS element_id, k AS key, CASE WHEN k = 'compliance_agent' AND p_partkey % 2 = 0 THEN upper(p_brand) WHEN k = 'compliance_agent' THEN p_brand ELSE p_type END AS value
FROM part, (VALUES ('compliance_agent'), ('compliance_object')) v(k)""")
def e12_patch_back(spark, sf):
    """Resolved labels put back into the elements' properties; every other record has none."""
    part = read(spark, sf, "part").withColumn("element_id", F.concat(F.lit("part"), "p_partkey"))
    cells = F.array(*[F.struct(F.lit(f"compliance_{k}").alias("key"), F.col(c).alias("value")) for k, c in (("agent", "p_brand"), ("object", "p_type"))])
    props = part.select(F.lit("f").alias("file"), "element_id", F.inline(cells))
    resolved = part.select(F.lit("f").alias("file"), F.col("element_id").alias("bpmn_id"), F.lit("").alias("regulation"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise("").alias("agent"), F.lit("").alias("object"), F.col("p_partkey").alias("ord"))
    return diagrams.patched(props, resolved)


@query("""SELECT p_partkey AS ord, p_name AS name, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || k END AS "unique" FROM
(SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) + CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey < 10) THEN 1 ELSE 0 END AS k FROM part)""")
def s09_unique_names(spark, sf):
    from ruleweave.plans.packs import unique_names

    part = read(spark, sf, "part")
    return unique_names(part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), part.where("p_partkey < 10").select(F.col("p_name").alias("name")).distinct()).select("ord", "name", "unique")


@query("""SELECT p_partkey AS norm, CASE WHEN p_size % 7 = 0 THEN p_brand || ' MUST handle on ' || p_type WHEN p_size % 7 = 5 THEN p_brand || ' IS handle on ' || p_type WHEN p_size % 7 = 2 THEN p_brand || ' MAY handle on ' || p_type
WHEN p_size % 7 = 1 THEN p_brand || ' MUST NOT handle on ' || p_type WHEN p_size % 7 = 3 THEN p_brand || ' SHOULD handle on ' || p_type WHEN p_size % 7 = 4 THEN p_brand || ' SHOULD NOT handle on ' || p_type ELSE upper(p_name[1]) || p_name[2:] END AS clause FROM part""")
def f18_clauses(spark, sf):
    from ruleweave.functions import text as T

    kind = F.get(F.array(*[F.lit(w) for w in KINDS]), (F.col("p_size") % 7).cast("int"))
    said = F.when(F.col("p_size") % 7 == 6, F.col("p_name")).otherwise("")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("norm"), T.clause(kind, F.col("p_brand"), F.lit("must handle"), F.col("p_type"), said, F.col("p_name")).alias("clause"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 's' END AS label, p_partkey FROM part)
SELECT 'Brand' AS field, label, regexp_replace(label, 's$', '') AS winner FROM p GROUP BY label""")
def e14_resolved_labels(spark, sf):
    """Brands in singular and plural; aliases, plurals and similarity leave the brands apart, since numbers differ."""
    part = read(spark, sf, "part")
    label = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "").otherwise("s"))
    records = part.select(label.alias("agent"), F.lit("").alias("deontic_type"), F.col("p_partkey").alias("ord"))
    return resolve.resolve_field(records, "agent", threshold=1.0).select(F.lit("Brand").alias("field"), "label", "winner")


@query("""SELECT norm, coalesce(e.agent, p.agent) AS agent, p.object FROM (SELECT p_partkey AS norm, p_brand AS agent, p_type AS object FROM part) p LEFT JOIN (SELECT p_partkey AS k, 'edited ' || p_name AS agent FROM part WHERE p_size % 10 = 0) e ON e.k = p.norm""")
def r18_norm_patch(spark, sf):
    part = read(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("norm"), F.col("p_brand").alias("agent"), F.col("p_type").alias("object"))
    edits = part.where("p_size % 10 = 0").select(F.col("p_partkey").alias("norm"), F.concat(F.lit("edited "), "p_name").alias("agent"))
    return norms.patch(rows, edits, key="norm")
