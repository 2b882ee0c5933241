"""Preset questions over the triples of a norm graph, as graph patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.bgp import Pattern

# Classes of norms, and the levels of criticality that count as high.
NORMS = ["Obligation", "Prohibition", "Permission", "Recommendation", "NegativeRecommendation", "ConstitutiveRule"]
HIGH = ["Critical", "High"]
ANCHOR = ("regulation", "article", "paragraph")


def _norms(triples: DataFrame, typed: bool = True) -> Pattern:
    """Norms with id and label, and their type among ``NORMS`` if it is asked for."""
    p = Pattern(triples).where("?norm", "deonticId", "?deonticId").where("?norm", "rdfs:label", "?label")
    return p.where("?norm", "rdf:type", "?type").values("type", NORMS) if typed else p


def _with(p: Pattern, subject: str, **names: str) -> Pattern:
    """Optional values of ``subject``, each by itself: name=property."""
    for name, prop in names.items():
        p = p.optional((subject, prop, f"?{name}"))
    return p


def _anchored(p: Pattern) -> Pattern:
    return _with(p, "?norm", regulation="fromRegulation", article="fromArticle", paragraph="fromParagraph")


def _by(prop: str, name: str):
    def run(triples: DataFrame) -> DataFrame:
        p = _norms(triples).where("?norm", prop, "?entity").where("?entity", "rdfs:label", f"?{name}")
        return _anchored(p).order(name, "type", "deonticId").select("type", name, "deonticId", "label", *ANCHOR)

    return run


def source_anchor(triples: DataFrame) -> DataFrame:
    return _anchored(_norms(triples)).order(*ANCHOR, "deonticId").select("type", "deonticId", "label", *ANCHOR)


def source_text(triples: DataFrame) -> DataFrame:
    p = _norms(triples, typed=False).where("?norm", "hasLegalSource", "?source").where("?source", "rdf:type", "LegalSource").where("?source", "originalText", "?originalText")
    return p.order("deonticId").select("deonticId", "label", "source", "originalText")


def shared_sources(triples: DataFrame) -> DataFrame:
    p = _with(Pattern(triples).where("?norm", "hasLegalSource", "?source"), "?source", regulationName="regulationName", articleNumber="articleNumber", paragraphNumber="paragraphNumber")
    p = p.group("source", "regulationName", "articleNumber", "paragraphNumber", normCount=F.count_distinct("norm")).filter("normCount > 1")
    return p.order(F.desc("normCount"), "regulationName", "articleNumber").select("source", "regulationName", "articleNumber", "paragraphNumber", "normCount")


def provenance(triples: DataFrame) -> DataFrame:
    p = _norms(triples, typed=False).where("?norm", "wasGeneratedByAnnotationActivity", "?activity")
    p = p.optional(("?norm", "wasAttributedToAnnotator", "?annotator"), ("?annotator", "rdfs:label", "?annotatorLabel"))
    p = p.optional(("?activity", "wasAssociatedWithAnnotator", "?activityAnnotator"), ("?activityAnnotator", "rdfs:label", "?activityAnnotatorLabel"))
    p = _with(_with(p, "?activity", annotationDate="annotationDate", confidenceScore="confidenceScore"), "?norm", extractionMethod="hasExtractionMethod")
    return p.order("deonticId").select("deonticId", "label", "annotatorLabel", "activity", "activityAnnotatorLabel", "annotationDate", "confidenceScore", "extractionMethod")


def review_status(triples: DataFrame) -> DataFrame:
    p = _with(_norms(triples, typed=False).where("?norm", "hasReviewStatus", "?reviewStatus"), "?norm", lastReviewDate="lastReviewDate")
    return p.order("reviewStatus", "deonticId").select("deonticId", "label", "reviewStatus", "lastReviewDate")


def status_and_force(triples: DataFrame) -> DataFrame:
    p = _with(_norms(triples, typed=False), "?norm", status="hasNormStatus", bindingForce="hasBindingForce", criticality="hasComplianceCriticality")
    return p.order("status", "bindingForce", "criticality", "deonticId").select("deonticId", "label", "status", "bindingForce", "criticality")


def high_priority(triples: DataFrame) -> DataFrame:
    p = _norms(triples).where("?norm", "hasComplianceCriticality", "?criticality").values("criticality", HIGH)
    return _with(p, "?norm", regulation="fromRegulation", article="fromArticle").order("criticality", "type", "deonticId").select("type", "deonticId", "label", "criticality", "regulation", "article")


PRESETS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "norms-by-agent": _by("hasLegalAgent", "agentLabel"), "norms-by-object": _by("hasLegalObject", "objectLabel"), "norms-by-action": _by("hasLegalAction", "actionLabel"),
    "norms-by-source-anchor": source_anchor, "source-text-by-norm": source_text, "shared-legal-sources": shared_sources, "annotation-provenance": provenance,
    "norms-by-review-status": review_status, "status-and-binding-force": status_and_force, "high-priority-norms": high_priority,
}
