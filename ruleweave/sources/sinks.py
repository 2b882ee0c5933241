"""Writers: Turtle, N-Triples, RDF/XML and result JSON, as one text line for each subject, triple or solution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.text import escaped


def _object(base: str | None) -> Column:
    iri = F.concat(F.lit(":"), "o") if base is None else F.concat(F.lit(f"<{base}#"), "o", F.lit(">"))
    iri = F.when(F.contains("o", F.lit(":")), F.col("o") if base is None else F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(iri)
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))
    typed = F.when(F.col("lang").isNotNull(), F.concat(literal, F.lit("@"), "lang")).when(F.coalesce("datatype", F.lit("xsd:string")) == "xsd:string", literal).otherwise(F.concat(literal, F.lit("^^"), "datatype"))
    return F.when(F.col("o_kind") == "iri", iri).otherwise(typed)


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """(s, block): one Turtle block for each subject, predicates and objects in order."""
    prefixed = lambda c: F.when(F.contains(c, F.lit(":")), F.col(c)).otherwise(F.concat(F.lit(":"), c))
    pairs = triples.select("s", F.concat_ws(" ", F.when(F.col("p") == "rdf:type", "a").otherwise(prefixed("p")), _object(None)).alias("x"))
    return pairs.groupBy("s").agg(F.concat(F.first(prefixed("s")), F.lit(" "), F.array_join(F.array_sort(F.collect_set("x")), " ;\n    "), F.lit(" .")).alias("block"))


def ntriples(triples: DataFrame, base: str) -> DataFrame:
    full = lambda c: F.concat(F.lit(f"<{base}#"), c, F.lit(">"))
    return triples.select(F.concat_ws(" ", full("s"), full("p"), _object(base), F.lit(".")).alias("line"))


def rdf_xml(triples: DataFrame, base: str) -> DataFrame:
    """(s, block): one description element for each subject, for a document whose default namespace is ``base#``.

    The document's root is ``rdf_xml_root(base)``.
    """
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    full = lambda c: xml(F.when(F.contains(c, F.lit(":")), c).otherwise(F.concat(F.lit(f"{base}#"), c)))
    kind = F.regexp_replace("datatype", "^xsd:", "http://www.w3.org/2001/XMLSchema#")
    attribute = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "lang", F.lit('"'))).when(F.coalesce("datatype", F.lit("xsd:string")) == "xsd:string", "").otherwise(F.concat(F.lit(' rdf:datatype="'), xml(kind), F.lit('"')))
    literal = F.concat(F.lit("<"), "p", attribute, F.lit(">"), xml(F.col("o")), F.lit("</"), "p", F.lit(">"))
    link = F.concat(F.lit("<"), "p", F.lit(' rdf:resource="'), full(F.col("o")), F.lit('"/>'))
    parts = triples.where("s is not null and p is not null and o is not null").select("s", F.when(F.col("o_kind") == "iri", link).otherwise(literal).alias("x"))
    inner = F.array_join(F.array_sort(F.collect_set("x")), "\n  ")
    return parts.groupBy("s").agg(inner.alias("x")).select("s", F.concat(F.lit('<rdf:Description rdf:about="'), full(F.col("s")), F.lit('">\n  '), "x", F.lit("\n</rdf:Description>")).alias("block"))


def rdf_xml_root(base: str, prefixes: dict[str, str] | None = None) -> tuple[str, str]:
    """Opening and closing tag around the blocks of ``rdf_xml``; ``prefixes`` names those of the predicates but rdf."""
    more = "".join(f' xmlns:{k}="{v}"' for k, v in (prefixes or {}).items())
    return f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="{base}#"{more}>', "</rdf:RDF>"


def solutions_json(rows: DataFrame) -> DataFrame:
    """One JSON object for each solution; unbound variables are absent."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("line"))


def override_template(labels: DataFrame) -> DataFrame:
    """(field, map): sorted identity map of the distinct labels of each field; ``labels`` is (field, label)."""
    return labels.where("coalesce(label, '') <> ''").groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("label", F.col("label").alias("to"))))).alias("map"))
