"""Rule files (SWRL in RDF/XML) as tables, and back."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Namespaces of the formats.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SWRL = "http://www.w3.org/2003/11/swrl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "rid string, part string, pos int, pred string, subject string, value boolean, event string, norm string"


def _items(node) -> list:
    """Members of a nested RDF list."""
    out = []
    inner = node[0] if node is not None and len(node) else None
    while inner is not None:
        first, rest = inner.find(f"{{{RDF}}}first"), inner.find(f"{{{RDF}}}rest")
        if first is None or rest is None or len(first) != 1:
            raise ValueError("malformed atom list")
        out.append(first[0])
        if rest.get(f"{{{RDF}}}resource") == f"{RDF}nil":
            return out
        inner = rest[0] if len(rest) else None
    raise ValueError("atom list without an end")


def _rule_rows(xml: str):
    for rule in ET.fromstring(xml).iter(f"{{{SWRL}}}Imp"):
        rid, subjects = rule.get(f"{{{RDF}}}about"), set()
        for pos, atom in enumerate(_items(rule.find(f"{{{SWRL}}}body"))):
            ref = lambda name, atom=atom: atom.find(f"{{{SWRL}}}{name}")
            text = (ref("argument2").text or "").strip().lower()
            if atom.tag != f"{{{SWRL}}}DatavaluedPropertyAtom" or text not in ("true", "false"):
                raise ValueError(f"{rid}: body atoms must be boolean")
            subjects.add(ref("argument1").get(f"{{{RDF}}}resource"))
            yield rid, "body", pos, ref("propertyPredicate").get(f"{{{RDF}}}resource"), ref("argument1").get(f"{{{RDF}}}resource"), text == "true", None, None
        if len(subjects) > 1:
            raise ValueError(f"{rid}: more than one subject")
        for pos, atom in enumerate(_items(rule.find(f"{{{SWRL}}}head"))):
            ref = lambda name, atom=atom: atom.find(f"{{{SWRL}}}{name}").get(f"{{{RDF}}}resource")
            if not ref("propertyPredicate").endswith("activatesNorm"):
                raise ValueError(f"{rid}: heads may only activate norms")
            yield rid, "head", pos, ref("propertyPredicate"), None, None, ref("argument1"), ref("argument2")


def parse(files: DataFrame) -> DataFrame:
    """Rows of all rules of (file, xml) rows."""

    def run(batches):
        for pdf in batches:
            rows = [r for xml in pdf["xml"] for r in _rule_rows(xml)]
            yield pd.DataFrame(rows, columns=["rid", "part", "pos", "pred", "subject", "value", "event", "norm"]).astype({"pos": "int32", "value": "object"})

    return files.select("xml").mapInPandas(run, SCHEMA)


def duplicates(rows: DataFrame) -> DataFrame:
    """Rule names that occur more than once."""
    return rows.groupBy("rid").agg(F.count(F.when((F.col("part") == "head") & (F.col("pos") == 0), 1)).alias("n")).where("n > 1")


def unique_rids(rules: DataFrame) -> DataFrame:
    """``rules`` with ``name``: the rid, for its later rows by ``rule_ord`` with _2, _3, ... behind it."""
    place = F.row_number().over(Window.partitionBy("rid").orderBy("rule_ord"))
    return rules.withColumn("name", F.when(place == 1, F.col("rid")).otherwise(F.concat_ws("_", "rid", place.cast("string"))))


def export(rules: DataFrame, body: DataFrame, head: DataFrame, base: str) -> DataFrame:
    """(rid, rule_ord, xml): one rule element for each rule with conditions and triggers; join them in order for a file."""
    iri = lambda c: F.concat(F.lit(f'rdf:resource="{base}#'), c, F.lit('"'))
    atom = lambda kind, *parts: F.concat(F.lit(f"<swrl:{kind}>"), *parts, F.lit(f"</swrl:{kind}>"))
    one = lambda name, ref: F.concat(F.lit(f"<swrl:{name} "), ref, F.lit("/>"))
    value = F.concat(F.lit(f'<swrl:argument2 rdf:datatype="{XSD}boolean">'), F.col("value").cast("string"), F.lit("</swrl:argument2>"))
    atoms = body.select("rid", "pos", atom("DatavaluedPropertyAtom", one("propertyPredicate", iri(F.col("pred"))), F.lit(f'<swrl:argument1 rdf:resource="{base}#x"/>'), value).alias("x"))
    acts = head.select("rid", "pos", atom("IndividualPropertyAtom", F.lit(f'<swrl:propertyPredicate rdf:resource="{base}#activatesNorm"/>'), one("argument1", iri(F.col("event"))), one("argument2", iri(F.col("norm")))).alias("x"))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"])
        nested = F.aggregate(F.reverse(items), F.lit(f'rdf:resource="{RDF}nil"/>'), lambda acc, x: F.concat(F.lit("><swrl:AtomList><rdf:first>"), x, F.lit("</rdf:first><rdf:rest "), F.when(F.startswith(acc, F.lit("rdf:")), acc).otherwise(F.concat(acc, F.lit("</rdf:rest>"))), F.lit("</swrl:AtomList>")))
        return rows.groupBy("rid").agg(F.concat(F.lit(f"<swrl:{name}"), nested, F.lit(f"</swrl:{name}>")).alias(name))

    both = rules.select("rid", "rule_ord").join(listed(atoms, "body"), "rid").join(listed(acts, "head"), "rid")
    return both.select("rid", "rule_ord", F.concat(F.lit(f'<swrl:Imp rdf:about="{base}#'), "rid", F.lit('">'), "body", "head", F.lit("</swrl:Imp>")).alias("xml"))


def document(rules: list[str]) -> str:
    return f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:swrl="{SWRL}">' + "".join(rules) + "</rdf:RDF>"
