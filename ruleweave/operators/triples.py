"""Triple tables: encoding of records, decoding by pivot, minting of individuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions import text as T

SCHEMA = "s string, p string, o string, o_kind string, datatype string, lang string"


def encode(rows: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """One string literal triple for each non-null column."""
    cells = F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in columns])
    out = rows.select(F.col(subject).alias("s"), F.inline(cells)).where("o is not null")
    return out.select("s", "p", "o", F.lit("literal").alias("o_kind"), F.lit("xsd:string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def decode(triples: DataFrame, columns: list[str]) -> DataFrame:
    """One row per subject with the least object of each predicate."""
    return triples.groupBy("s").agg(*[F.min(F.when(F.col("p") == c, F.col("o"))).alias(c) for c in columns])


# Vocabulary terms by value; values without an entry are dropped.
VOCABULARY = {
    "binding_force": ("hasBindingForce", {"hard_law": "HardLaw", "soft_law": "SoftLaw", "internal_policy": "InternalPolicy", "contractual": "Contractual"}),
    "norm_status": ("hasNormStatus", {"active": "Active", "under_review": "UnderReview", "disputed": "Disputed", "superseded": "Superseded", "pending": "NotYetInForce"}),
    "risk_level": ("hasComplianceCriticality", {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}),
    "extraction_method": ("hasExtractionMethod", {"manual_lawyer": "ManualLawyer", "manual_analyst": "ManualAnalyst", "llm": "LLMExtraction", "pattern-matching": "PatternMatching", "rule-based": "RuleBased"}),
    "review_status": ("hasReviewStatus", {"approved": "Approved", "pending": "PendingReview", "none": "NotReviewed"}),
}
LITERALS = {"deontic_id": "deonticId", "norm_statement": "normStatement", "action": "actionText", "agent": "agentText", "object": "objectText", "fact_statement": "factStatement", "trigger_condition": "conditionTrigger", "exception": "exception", "sanction": "sanction", "regulation": "fromRegulation", "article": "fromArticle", "paragraph": "fromParagraph"}
ENTITIES = {"agent": ("Agent", "LegalAgent", "hasLegalAgent"), "action": ("Action", "LegalAction", "hasLegalAction"), "object": ("Object", "LegalObject", "hasLegalObject"), "jurisdiction": ("Jurisdiction", "AdministrativeArea", "jurisdiction")}


def individual(kind: str, label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit(f"{kind}_"), T.slug(label)))


DEFAULT_ANNOTATOR, DEFAULT_LABEL = "DefaultAnnotator", "Default annotator"
_TRIPLE = "struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string>"


def _link(s: Column, p: str, o: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))


def _value(s: Column, p: str, o: Column, datatype: Column | str = "xsd:string", lang: str | None = None) -> Column:
    kind = F.lit(datatype) if isinstance(datatype, str) else datatype
    return F.struct(s.alias("s"), F.lit(p).alias("p"), F.nullif(o, F.lit("")).alias("o"), F.lit("literal").alias("o_kind"), kind.alias("datatype"), F.lit(lang).cast("string").alias("lang"))


def _emit(rows: DataFrame, cells: list[Column]) -> DataFrame:
    """The triples of every row in one pass; those without a subject or object are left out."""
    return rows.select(F.inline(F.array(*cells).cast(f"array<{_TRIPLE}>"))).where("s is not null and o is not null")


def _first(rows: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """The first row by ``ord`` of each ``iri``."""
    return rows.groupBy(key.alias("iri")).agg(F.min_by(F.struct(*columns), "ord").alias("r")).select("iri", "r.*")


def condition_iri(label: Column, fallback: Column) -> Column:
    return F.concat(F.lit("Condition_"), T.slug(F.coalesce(F.nullif(label, F.lit("")), fallback)))


def gate_label() -> Column:
    """A gateway's statement, else its name, else its id."""
    return F.coalesce(F.nullif("condition_statement", F.lit("")), F.nullif("bpmn_name", F.lit("")), F.col("bpmn_id"))


def abox(records: DataFrame) -> DataFrame:
    """All triples of flat annotation records (with ``ord``): individuals, sources, norms, conditions, activities.

    Of records with one norm or condition IRI the first in order describes it. Each kind of subject is one aggregation of
    the records and one pass that writes all its triples.
    """
    columns = records.columns
    task, gate = records.where("element_type = 'task'"), records.where("element_type = 'exclusiveGateway'")
    given = lambda c: F.nullif(c, F.lit(""))
    id_ = F.coalesce(given("deontic_id"), F.col("bpmn_id"))
    norm = _first(task.withColumn("_id", id_), F.coalesce(given(T.slug(id_)), T.slug(F.col("bpmn_id"))), [*columns, "_id"])
    iri = F.col("iri")
    source, annotator = individual("Regulation", F.col("regulation")), F.coalesce(individual("Annotator", F.col("annotator")), F.lit(DEFAULT_ANNOTATOR))
    activity = F.concat(F.lit("AnnotationActivity_"), iri)
    cells = [_link(iri, "rdf:type", T.lookup(F.col("deontic_type"), T.NORM_CLASS, F.lit("RegulativeNorm"))), _value(iri, "rdfs:label", F.col("bpmn_name"), lang="en"), _value(iri, "deonticId", F.col("_id"))]
    cells += [_value(iri, p, F.col(c)) for c, p in LITERALS.items() if c != "deontic_id"]
    cells += [_value(iri, p, F.col(c), T.date_or_string(F.col(c))) for c, p in (("effective_date", "effectiveDate"), ("last_review_date", "lastReviewDate"))]
    cells += [_value(iri, "deadline", F.col("deadline")), _value(iri, "sourceURI", F.col("regulation_uri"), "xsd:anyURI")]
    cells += [_link(iri, p, T.lookup(F.col(c), words)) for c, (p, words) in VOCABULARY.items()]
    cells += [_link(iri, p, individual(kind, F.col(c))) for c, (kind, _, p) in ENTITIES.items()]
    cells += [_link(iri, p, source) for p in ("hasLegalSource", "wasDerivedFromSource")]
    cells += [_link(iri, "wasAttributedToAnnotator", annotator), _link(iri, "wasGeneratedByAnnotationActivity", activity)]
    cells += [_link(activity, "rdf:type", F.lit("AnnotationActivity")), _value(activity, "rdfs:label", F.concat(F.lit("Annotation activity for "), "_id"), lang="en"), _value(activity, "annotationDate", F.btrim("annotation_date"), T.date_or_string(F.btrim("annotation_date")))]
    cells += [_value(activity, "confidenceScore", F.col("confidence"), "xsd:decimal"), _link(activity, "wasAssociatedWithAnnotator", annotator), _link(activity, "usedLegalSource", source)]
    out = [_emit(norm, cells)]
    # Entities: tasks name all kinds, gateways just jurisdictions, annotators and sources.
    kinds = [(c, kind, cls, c == "jurisdiction") for c, (kind, cls, _) in ENTITIES.items()] + [("annotator", "Annotator", "AnnotatorAgent", True)]
    gates = F.col("element_type") == "exclusiveGateway"
    cells = [c for field, kind, cls, both in kinds for x in [individual(kind, F.when(~gates | F.lit(both), F.col(field)))] for c in (_link(x, "rdf:type", F.lit(cls)), _value(x, "rdfs:label", F.col(field), lang="en"))]
    both = records.where("element_type in ('task', 'exclusiveGateway')")
    out.append(_emit(both, [*cells, _link(source, "rdf:type", F.lit("LegalSource")), _value(source, "regulationName", F.col("regulation"))]))
    default = F.lit(DEFAULT_ANNOTATOR)
    out.append(_emit(records.sparkSession.range(1), [_link(default, "rdf:type", F.lit("AnnotatorAgent")), _value(default, "rdfs:label", F.lit(DEFAULT_LABEL), lang="en")]))
    every = both.where("coalesce(regulation, '') <> ''")
    uri = every.groupBy("regulation").agg(F.min_by("regulation_uri", F.when(given("regulation_uri").isNotNull(), F.col("ord"))).alias("uri"))
    out.append(_emit(uri, [_value(source, "regulationURI", F.col("uri"), "xsd:anyURI")]))
    anchored = every.where("coalesce(article, '') <> ''").groupBy("regulation", "article", "paragraph").agg(F.min_by("original_text", "ord").alias("original_text"))
    out.append(_emit(anchored, [_value(source, p, F.col(c)) for c, p in (("article", "articleNumber"), ("paragraph", "paragraphNumber"), ("original_text", "originalText"))]))
    label = gate_label()
    cond = _first(gate.withColumn("_label", label), condition_iri(label, F.col("bpmn_id")), ["_label"])
    out.append(_emit(cond, [_link(iri, "rdf:type", F.lit("LegalCondition")), _value(iri, "rdfs:label", F.col("_label"), lang="en"), _value(iri, "conditionStatement", F.col("_label"))]))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def trigger_triples(head: DataFrame, body: DataFrame) -> DataFrame:
    """Conditions' triggers with their outcomes; triggers don't assert the norm. ``body`` has the condition's name as ``local``."""
    last = body.groupBy("rid").agg(F.max_by(F.struct("local", "value"), "pos").alias("c"))
    event = F.col("event")
    cells = [_link(F.col("c.local"), "hasTrigger", event), _link(event, "rdf:type", F.lit("TriggerEvent")), _link(event, "hasOutcome", F.when(F.col("c.value"), "TrueOutcome").otherwise("FalseOutcome"))]
    return _emit(head.join(last, "rid"), cells).distinct()
