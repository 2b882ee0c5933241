"""Label, identifier and literal functions, all built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of identifiers by norm type.
ID_PREFIX = {"obligation": "OBL", "prohibition": "PRH", "permission": "PER", "recommendation": "REC", "recommendation_not": "REC_NOT", "fact": "FCT"}
# Classes by norm type.
NORM_CLASS = {"obligation": "Obligation", "prohibition": "Prohibition", "permission": "Permission", "recommendation": "Recommendation", "recommendation_not": "NegativeRecommendation", "fact": "ConstitutiveRule"}
# Words that name the branches of a condition.
TRUE_WORDS = ("yes", "true", "1", "sim", "ja", "oui", "approved")
FALSE_WORDS = ("no", "false", "0", "nao", "não", "nein", "non", "rejected")


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The value of ``key`` in a small constant table, else ``default`` (null)."""
    out = default if default is not None else F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def symbol(text: Column) -> Column:
    """Symbol of a label: line ends to spaces, no marks (Unicode letters and digits stay), gaps to ``_``; else ``unnamed``."""
    out = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", ""), r"(?U)\s+", "_")
    return F.when(out == "", "unnamed").otherwise(out)


def slug(text: Column) -> Column:
    """ASCII slug: other characters to ``_``, runs of ``_`` to one, none at the ends."""
    out = F.regexp_replace(F.btrim(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_]", "_")
    return F.btrim(F.regexp_replace(out, "_+", "_"), F.lit("_"))


def norm_id(kind: Column, name: Column, fallback: Column) -> Column:
    """PREFIX_slug of the name, or of ``fallback`` where that is blank."""
    label = F.when(F.coalesce(name, F.lit("")) == "", fallback).otherwise(name)
    return F.concat(lookup(kind, ID_PREFIX, F.lit("NORM")), F.lit("_"), slug(label))


def canonical(label: Column) -> Column:
    """Lower case, marks to spaces, single spaces."""
    out = F.regexp_replace(F.btrim(F.lower(label)), r"[_\-.,;:/\\?!()]", " ")
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def singular(word: Column) -> Column:
    """English singular by ending: ies to y; ses, xes, zes, ches, shes lose es; s but not ss loses s, even if nothing is left."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.when(word.rlike("ies$"), F.concat(cut(3), F.lit("y"))).when(word.rlike("(ses|xes|zes|ches|shes)$"), cut(2)).when(word.rlike("(^|[^s])s$"), cut(1)).otherwise(word)


def normalized_text(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[_-]", " "), r"\s+", " "))


def condition_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def local_name(uri: Column) -> Column:
    """After the last ``#``, else after the last ``/``."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def is_date(text: Column) -> Column:
    """By form alone; 2026-99-99 is a date."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def date_or_string(text: Column) -> Column:
    return F.when(is_date(text), "xsd:date").otherwise("xsd:string")


def boolean(text: Column) -> Column:
    """Truth of a loose value: the usual words, else true for any other text; null is false."""
    word = F.lower(F.btrim(text))
    return F.when(text.isNull() | word.isin("false", "f", "no", "n", "0", "", "null", "none"), False).otherwise(True)


def qualified(key: Column, base: str) -> Column:
    """IRIs stay; other keys are put behind ``base#``."""
    return F.when(key.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), key).otherwise(F.concat(F.lit(f"{base}#"), key))


def branch_truth(guard: Column, true_label: Column, false_label: Column, position: Column, branches: Column) -> Column:
    """Truth of a branch: its label, then common words, then its place if there are just two branches; else null."""
    g, words = F.lower(F.btrim(guard)), lambda x: F.lower(F.btrim(x))
    known = F.coalesce(g, F.lit("")) != ""
    return (
        F.when(known & (g == words(true_label)), True)
        .when(known & (g == words(false_label)), False)
        .when(known & g.isin(*TRUE_WORDS), True)
        .when(known & g.isin(*FALSE_WORDS), False)
        .when((branches == 2) & (position == 0), True)
        .when((branches == 2) & (position == 1), False)
    )


def trigger_id(condition: Column, value: Column, norm: Column) -> Column:
    return F.concat_ws("_", F.lit("TriggerEvent"), condition, F.when(value, "True").otherwise("False"), norm)


def contains_all(haystack: Column, query: Column) -> Column:
    """Every token of the query occurs in the text; both lower-cased, ``_`` and ``-`` as spaces."""
    plain = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"\bia\b", "ai"), "[_-]", " "), r"\s+", " "))
    return F.forall(F.split(plain(query), " "), lambda token: F.contains(plain(haystack), token))


def escaped(text: Column) -> Column:
    """Text of a double-quoted literal."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def suffix(uri: Column) -> Column:
    """After the last ``#``, else after the last ``/`` that isn't at the end."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(F.regexp_replace(uri, "/+$", ""), "/", -1))


def pack_slug(name: Column) -> Column:
    """Lower case, all but letters and digits (of any script) to ``-``, none at the ends; ``pack`` if nothing is left."""
    out = F.btrim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "-"), F.lit("-"))
    return F.when(out == "", "pack").otherwise(out)


def file_name(path: Column) -> Column:
    """The last part of a path, all but letters, digits and ``._-`` to ``_``; ``upload.bpmn`` if nothing is left."""
    last = F.substring_index(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "/", -1)
    out = F.regexp_replace(last, r"[^\p{L}\p{N}._-]", "_")
    return F.when(out == "", "upload.bpmn").otherwise(out)


def graph_iri(base: str, name: Column) -> Column:
    """IRI of a pack's graph: spaces and ``_`` of the lower-cased name to ``-``."""
    return F.concat(F.lit(f"{base}/"), F.translate(F.lower(name), " _", "--"))


def shortened(uri: Column, prefixes: dict[str, str]) -> Column:
    """``uri`` with the first namespace of ``prefixes`` that it begins with replaced by its prefix."""
    out = uri
    for full, short in reversed(prefixes.items()):
        out = F.when(F.startswith(uri, F.lit(full)), F.concat(F.lit(short), F.substring(uri, F.lit(len(full) + 1), F.length(uri)))).otherwise(out)
    return out


def human(text: Column) -> Column:
    """``_`` as spaces, single spaces."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "_", " "), r"\s+", " "))


def title(text: Column) -> Column:
    """Human text with its first letter in upper case."""
    out = human(text)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out)))


# Norm types by other spelling, and the word that a type's clauses are built with.
TYPE_ALIASES = {"negativerecommendation": "recommendation_not", "constitutiverule": "fact"}
TYPE_WORDS = {"obligation": "MUST", "prohibition": "MUST NOT", "permission": "MAY", "recommendation": "SHOULD", "recommendation_not": "SHOULD NOT", "fact": "IS"}


def norm_type(value: Column, fallback: str = "gateway") -> Column:
    """A norm's type in lower case, other spellings folded; ``fallback`` for none."""
    raw = F.lower(F.btrim(F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))))
    return F.coalesce(F.nullif(lookup(raw, TYPE_ALIASES, raw), F.lit("")), F.lit(fallback))


def type_label(value: Column) -> Column:
    """How a type is shown."""
    kind = norm_type(value)
    return F.when(kind == "recommendation_not", "Negative recommendation").when(kind == "gateway", "Gateways").otherwise(title(kind))


def norm_label(statement: Column, condition: Column, norm: Column) -> Column:
    """Statement of a norm, else its condition, else its id without the type's prefix; first letter in upper case."""
    given = F.coalesce(F.nullif(statement, F.lit("")), F.nullif(condition, F.lit("")))
    return title(F.coalesce(given, F.regexp_replace(F.coalesce(norm, F.lit("")), "(?i)^(OBL|PROH|PERM|REC|NEGREC|FACT|GW)_", "")))


def clause(kind: Column, agent: Column, action: Column, object_: Column, statement: Column, norm: Column) -> Column:
    """A norm as a sentence: agent, the type's word, action and object, and the statement where it says more."""
    word = lookup(norm_type(kind, ""), TYPE_WORDS, F.lit(""))
    who, what, object_ = title(agent), F.btrim(F.regexp_replace(human(action), r"(?i)^(must|shall)( not)?\s+", "")), human(object_)
    dashed = lambda x: F.regexp_replace(F.lower(F.btrim(x)), "[^a-z0-9]+", "-")
    joint = F.when(what.rlike(r"(?i)\b(comply|respect|exempt)\b"), " for ").when(what.rlike(r"(?i)\b(grant|provide|assign)\b"), " to ").otherwise(" on ")
    named = (dashed(object_) != "") & F.contains(dashed(what), dashed(object_))
    tail = F.when(object_ == "", what).when(what == "", object_).when(named, what).otherwise(F.concat(what, joint, object_))
    said = F.btrim(F.coalesce(statement, F.lit("")))
    fallback = norm_label(statement, F.lit(None), norm)
    short = F.concat_ws(" ", F.nullif(who, F.lit("")), word, F.nullif(tail, F.lit("")))
    full = F.when((said != "") & ~F.contains(F.lower(short), F.lower(said)), F.concat(short, F.lit(": "), said)).otherwise(short)
    missing = F.coalesce(F.nullif(fallback, F.lit("")), F.lit("Not provided"))
    return F.when(word == "", missing).when((who == "") & (tail == ""), F.when(fallback == "", "Not provided").otherwise(F.concat(word, F.lit(" "), fallback))).otherwise(full)


def iri(kind: Column, name: Column, rules: str, individuals: str, vocabulary: str) -> Column:
    """IRI of a reference by its kind: var, abox, tbox or rules; another kind raises an error."""
    fixed = {"rules": f"{rules}#", "abox": f"{individuals}#", "tbox": vocabulary, "var": f"{rules}#var_"}
    known = F.concat(lookup(kind, fixed), name)
    return F.when(kind.isin(*fixed), known).otherwise(F.raise_error(F.concat(F.lit("no such kind of reference: "), F.coalesce(kind, F.lit("null")))))


def datatype_iri(datatype: Column) -> Column:
    return F.when(datatype.rlike("^https?://"), datatype).otherwise(F.concat(F.lit("http://www.w3.org/2001/XMLSchema#"), F.replace(datatype, F.lit("xsd:"), F.lit(""))))
