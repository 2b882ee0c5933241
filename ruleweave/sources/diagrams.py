"""Process diagrams (BPMN 2.0 XML) as tables: nodes, flows, gateway order, properties, annotation records."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions.text import lookup, norm_id

# Element names of the standard.
RECORD_TASKS = ("task", "userTask", "serviceTask", "manualTask", "businessRuleTask", "sendTask", "scriptTask")
GRAPH_TASKS = ("task", "userTask", "serviceTask", "manualTask", "businessRuleTask", "sendTask")
KEPT = ("startEvent", "endEvent", "exclusiveGateway")

SCHEMA = "file string, part string, id string, type string, name string, src string, dst string, key string, value string, seq int"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _properties(element) -> dict[str, str]:
    """Name to stripped value of the first property bag; later ones of a name win."""
    for child in element:
        if _local(child.tag) == "extensionElements":
            for bag in child:
                if _local(bag.tag) == "properties":
                    return {p.get("name"): (p.get("value") or "").strip() for p in bag if p.get("name")}
    return {}


def _rows(file: str, xml: str):
    root = ET.fromstring(xml)
    process = next((e for e in root.iter() if _local(e.tag) == "process"), None)
    seq = 0
    for e in process if process is not None else ():
        tag, seq = _local(e.tag), seq + 1
        if tag in KEPT or tag in GRAPH_TASKS:
            yield file, "node", e.get("id"), tag, e.get("name") or "", None, None, None, None, seq
            bag = _properties(e)
            for k, v in (bag | {"_bpmn_name": e.get("name") or ""}).items() if bag else ():
                yield file, "prop", e.get("id"), tag, None, None, None, k, v, seq
            if tag == "exclusiveGateway":
                for pos, out in enumerate(x for x in e if _local(x.tag) == "outgoing"):
                    yield file, "order", e.get("id"), tag, None, None, None, (out.text or "").strip(), None, pos
        elif tag == "sequenceFlow" and e.get("id") and e.get("sourceRef") and e.get("targetRef"):
            yield file, "flow", e.get("id"), tag, e.get("name"), e.get("sourceRef"), e.get("targetRef"), None, None, seq
    # Records: any depth, tasks by kind and then gateways, only with properties.
    every = list(root.iter())
    place = 0
    for kind in (*RECORD_TASKS, "exclusiveGateway"):
        for e in every:
            if _local(e.tag) == kind and (bag := _properties(e)):
                place += 1
                for k, v in bag.items():
                    yield file, "record", e.get("id"), kind, e.get("name") or "", None, None, k, v, place


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of all diagrams in a folder or glob; one file is one small row, parsed in batches by executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bpmn").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "utf-8").alias("xml"))
    if files.isEmpty():
        raise FileNotFoundError(f"no diagrams in {path}")
    return parse(files)


def parse(files: DataFrame) -> DataFrame:
    """As ``scan``, from rows (file, xml)."""

    def run(batches):
        for pdf in batches:
            rows = [r for file, xml in zip(pdf["file"], pdf["xml"], strict=True) for r in _rows(file, xml)]
            yield pd.DataFrame(rows, columns=["file", "part", "id", "type", "name", "src", "dst", "key", "value", "seq"]).astype({"seq": "int32"})

    return files.select("file", "xml").mapInPandas(run, SCHEMA)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    part = lambda name: rows.where(F.col("part") == name)
    return {
        "nodes": part("node").select("file", "id", "type", "name", "seq"),
        "flows": part("flow").select("file", "id", "src", "dst", "name", "seq"),
        "gateway_order": part("order").select("file", F.col("id").alias("gateway_id"), F.col("key").alias("flow_id"), F.col("seq").alias("pos")),
        "props": part("prop").select("file", F.col("id").alias("element_id"), "key", "value", "seq"),
    }


# Record columns by property name, of tasks and of gateways.
FIELDS = {
    "compliance_deonticType": "deontic_type", "compliance_bindingForce": "binding_force", "compliance_status": "norm_status", "compliance_riskLevel": "risk_level", "compliance_extractionMethod": "extraction_method",
    "compliance_legalReview": "review_status", "compliance_deonticId": "deontic_id", "compliance_normStatement": "norm_statement", "compliance_agent": "agent", "compliance_action": "action", "compliance_object": "object",
    "compliance_factStatement": "fact_statement", "compliance_triggerCondition": "trigger_condition", "compliance_jurisdiction": "jurisdiction", "compliance_effectiveDate": "effective_date", "compliance_deadline": "deadline",
    "compliance_exception": "exception", "compliance_sanction": "sanction", "compliance_regulation": "regulation", "compliance_article": "article", "compliance_paragraph": "paragraph", "compliance_originalText": "original_text",
    "compliance_regulationURI": "regulation_uri", "compliance_confidence": "confidence", "compliance_annotator": "annotator", "compliance_annotationDate": "annotation_date", "compliance_lastReviewDate": "last_review_date",
    "gw_conditionStatement": "condition_statement", "gw_trueBranch": "true_branch", "gw_falseBranch": "false_branch",
}
GATEWAY_ONLY = ("condition_statement", "true_branch", "false_branch")
TASK_ONLY = ("deontic_type", "binding_force", "risk_level", "deontic_id", "norm_statement", "agent", "action", "object", "fact_statement", "trigger_condition", "exception", "sanction")


def wide(rows: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """One row for each group of ``keys`` with a column for each property in ``names``; missing ones are empty."""
    value = lambda key: F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(""))
    return rows.groupBy(*keys).agg(*[value(k).alias(c) for k, c in names.items()])


def records(rows: DataFrame) -> DataFrame:
    """Flat annotation records with ``ord``; missing values are empty strings.

    The element type is the annotated one, else the element's own. Tasks without an id get one from type and name; what is
    neither a task nor a gateway has no fields.
    """
    found = rows.where("part = 'record'").withColumnsRenamed({"id": "bpmn_id", "name": "bpmn_name"})
    out = wide(found, ["file", "seq", "bpmn_id", "bpmn_name", "type"], FIELDS | {"compliance_condition": "_condition", "compliance_elementType": "_element"})
    out = out.withColumn("element_type", F.coalesce(F.nullif("_element", F.lit("")), "type"))
    task, gate = F.col("element_type") == "task", F.col("element_type") == "exclusiveGateway"
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    out = out.withColumns({
        "trigger_condition": filled("trigger_condition", F.col("_condition")), "true_branch": filled("true_branch", F.lit("Yes")), "false_branch": filled("false_branch", F.lit("No")),
        "deontic_id": filled("deontic_id", norm_id(F.col("deontic_type"), F.btrim("bpmn_name"), F.col("bpmn_id"))),
    })
    kept = {c: F.when(gate if c in GATEWAY_ONLY else task if c in TASK_ONLY else task | gate, F.col(c)).otherwise("") for c in FIELDS.values()}
    return out.withColumns(kept).withColumn("ord", F.struct("file", "seq")).drop("_condition", "_element", "type", "seq")


def patched(props: DataFrame, records: DataFrame, fields: tuple[str, ...] = ("regulation", "agent", "object")) -> DataFrame:
    """Properties (file, element_id, key, value) with the resolved labels of ``records`` put in by file and element.

    A property that an element lacks is added; empty labels change nothing.
    """
    names = {c: k for k, c in FIELDS.items()}
    cells = F.array(*[F.struct(F.lit(names[c]).alias("key"), F.col(c).alias("new")) for c in fields])
    new = records.groupBy("file", F.col("bpmn_id").alias("element_id")).agg(*[F.max_by(c, "ord").alias(c) for c in fields]).select("file", "element_id", F.inline(cells)).where("new <> ''")
    known = props.select("file", "element_id").distinct()
    joined = props.join(new.join(known, ["file", "element_id"], "left_semi"), ["file", "element_id", "key"], "full_outer")
    return joined.select("file", "element_id", "key", F.coalesce("new", "value").alias("value"))


def overridden(props: DataFrame, override: DataFrame) -> DataFrame:
    """Properties with raw labels replaced by an override's (field, label, winner); empty winners change nothing."""
    keys = {"agent": "compliance_agent", "action": "compliance_action", "object": "compliance_object", "regulation": "compliance_regulation", "deontic_id": "compliance_deonticId", "condition_statement": "gw_conditionStatement"}
    rows = override.where("coalesce(winner, '') <> ''").select(lookup(F.col("field"), keys).alias("key"), F.col("label").alias("value"), F.col("winner")).where("key is not null")
    return props.join(rows, ["key", "value"], "left").select("file", "element_id", "key", F.coalesce("winner", "value").alias("value"))


def record_json(records: DataFrame) -> DataFrame:
    """(ord, line): a record as JSON, its empty fields kept; types other than task and gateway have three fields."""
    base = ["bpmn_id", "bpmn_name", "element_type"]
    task = F.to_json(F.struct(*base, *[c for c in FIELDS.values() if c not in GATEWAY_ONLY]))
    gate = F.to_json(F.struct(*base, *[c for c in FIELDS.values() if c not in TASK_ONLY]))
    line = F.when(F.col("element_type") == "task", task).when(F.col("element_type") == "exclusiveGateway", gate).otherwise(F.to_json(F.struct(*base)))
    return records.select("ord", line.alias("line"))


def overrides(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An override file's rows (field, label, winner), and its confirmed pairs (a, b); ``files`` is (json)."""
    parsed = files.select(F.from_json("json", "map<string,string>").alias("m")).select(F.explode("m").alias("field", "body"))
    maps = parsed.where(~F.startswith("field", F.lit("_"))).select("field", F.explode(F.from_json("body", "map<string,string>")).alias("label", "winner"))
    pairs = parsed.where("field = '_confirmed_separate'").select(F.explode(F.from_json("body", "array<array<string>>")).alias("pair"))
    return maps, pairs.where("size(pair) = 2").select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"))
