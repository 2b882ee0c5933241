"""Packs of files: fingerprints, incremental selection, stores of triples, catalogue upserts, unique names."""

from __future__ import annotations

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(files: DataFrame) -> DataFrame:
    """(pack, fingerprint): SHA-256 of the contents in order of path. ``files`` is (pack, path, content)."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: x["content"]), ",")
    return files.groupBy("pack").agg(F.sha2(ordered, 256).alias("fingerprint"))


def stale(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Packs that are new or whose fingerprint differs from the recorded one."""
    return current.join(recorded.select("pack", "fingerprint"), ["pack", "fingerprint"], "left_anti")


def save_triples(triples: DataFrame, path: str) -> None:
    """Replace the packs of ``triples`` (with a column pack) in a store; other packs' files stay as they are.

    Rows are sorted by predicate and subject, so that a scan for one predicate skips most of a file.
    """
    rows = triples.repartition("pack").sortWithinPartitions("pack", "p", "s")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pack").parquet(path)


def load_triples(spark: SparkSession, path: str, pack: str, *more: DataFrame) -> DataFrame:
    """Triples of one pack, by partition, and those of ``more`` tables, such as a vocabulary."""
    own = spark.read.parquet(path).where(F.col("pack") == pack).drop("pack")
    for other in more:
        own = own.unionByName(other.select(own.columns))
    return own


def upsert(catalog: DataFrame, rows: DataFrame, key: str = "pack") -> DataFrame:
    """Latest whole row by key: one of ``rows`` before one of the catalogue, the latest ``updated_at`` before others.

    A row that was there before keeps its ``created_at``.
    """
    columns = [c for c in catalog.columns if c not in (key, "created_at")]
    both = catalog.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    latest = F.struct("_new", *[c for c in columns if c == "updated_at"], *[c for c in columns if c != "updated_at"])
    return both.groupBy(key).agg(F.min_by("created_at", F.struct("_new", "created_at")).alias("created_at"), F.max(latest).alias("r")).select(key, "created_at", "r.*").select(*catalog.columns)


def sync_files(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored file rows with those of the packs in ``files`` replaced as a whole."""
    return stored.join(files.select("pack").distinct(), "pack", "left_anti").unionByName(files.select(stored.columns))


def catalog_row(catalog: DataFrame, name: str, key: str = "pack") -> DataFrame:
    return catalog.where(F.col(key) == name)


def catalog_listing(catalog: DataFrame, key: str = "pack") -> DataFrame:
    return catalog.orderBy(key)


def unique_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, ord, unique): in order of ``ord``, a name that is taken, also by one before, gets the first free of -2, -3, ...

    Names that can meet (alike but for numbers behind a dash) are one group; people write them.
    """
    root = lambda: F.regexp_replace("name", "(-[0-9]+)+$", "")

    def choose(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        used, following, out = set(old["name"]), {}, []
        for row in new.sort_values("ord").itertuples():
            name, k = row.name, following.get(row.name, 2)
            if name in used:
                while f"{row.name}-{k}" in used:
                    k += 1
                name, following[row.name] = f"{row.name}-{k}", k + 1
            used.add(name)
            out.append((row.name, row.ord, name))
        return pd.DataFrame(out, columns=["name", "ord", "unique"])

    kind = names.schema["ord"].dataType.simpleString()
    both = names.select("name", "ord", root().alias("root")).groupBy("root").cogroup(taken.select("name", root().alias("root")).groupBy("root"))
    return both.applyInPandas(choose, f"name string, ord {kind}, unique string")


def appended(files: DataFrame, added: DataFrame) -> DataFrame:
    """File rows (pack, path, content) with ``added`` ones (with ``ord``) appended under names that are free in their pack."""
    stem, end = F.regexp_replace("path", r"\.[^.]*$", ""), F.regexp_extract("path", r"(\.[^.]*)$", 1)
    keyed = lambda d: d.withColumns({"_stem": F.concat_ws("/", "pack", stem), "_end": end})
    named = unique_names(keyed(added).select(F.col("_stem").alias("name"), "ord"), keyed(files).select(F.col("_stem").alias("name")))
    rows = keyed(added).join(named.select("ord", "unique"), "ord")
    path = F.concat(F.expr("substring(unique, length(pack) + 2)"), F.coalesce(F.nullif("_end", F.lit("")), F.lit(".bpmn")))
    return files.unionByName(rows.select("pack", path.alias("path"), "content"))


def summaries(rules: DataFrame) -> DataFrame:
    return rules.groupBy("file").agg(F.count("*").alias("rule_count"))


def rebuild(files: DataFrame, recorded: DataFrame, path: str) -> list[str]:
    """Rebuild the triples of packs whose files changed into the store at ``path``; returns their names.

    ``files`` is (pack, path, content) of diagrams, ``recorded`` the fingerprints of the last build. One pack is one graph
    with names of its own, so packs are built one by one.
    """
    from ruleweave.operators.resolve import normalize
    from ruleweave.operators.triples import abox
    from ruleweave.sources import diagrams

    packs = sorted(r["pack"] for r in stale(fingerprints(files), recorded).select("pack").collect())
    for pack in packs:
        rows = diagrams.parse(files.where(F.col("pack") == pack).select(F.col("path").alias("file"), F.col("content").alias("xml")))
        records, _, _ = normalize(diagrams.records(rows))
        save_triples(abox(records).withColumn("pack", F.lit(pack)), path)
    return packs
