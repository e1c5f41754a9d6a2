"""A folder of filing documents, one JSON file each: facts, tag census, companies and a load log from one pass over the files.

A file that cannot be read never stops the others. It has an ``error`` row in the log and nothing else; a document
without a usable fact is ``empty``. The documents are parsed once into one row an entry, written to the shared folder;
what is asked of them reads only its own columns of that table. A document is parsed whole by one task, as JSON is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import store

ENTRY = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
DOCUMENT = f"cik string, entityName string, facts map<string,map<string,struct<label:string,units:map<string,array<{ENTRY}>>>>>, _corrupt_record string"


@dataclass
class Landed:
    """What a scan found: ``entries``, one row for each entry of each document, and for each document or tag without one; ``concepts``, mapped tags or None for all."""

    entries: DataFrame
    concepts: DataFrame | None

    def facts(self) -> DataFrame:
        """``(cik, taxonomy, concept, unit, period_start, ..., val)`` of entries that have a value; without ``start`` an instant."""
        day = lambda c: F.expr(f"try_to_date(nullif({c}, ''), 'yyyy-MM-dd')")
        e = self._kept().where("e.val IS NOT NULL")
        return e.select("cik", "taxonomy", "concept", "unit", day("e.start").alias("period_start"), day("e.end").alias("period_end"), F.col("e.fy").alias("fy"), F.col("e.fp").alias("fp"), F.col("e.form").alias("form"),
                        day("e.filed").alias("filed"), F.col("e.accn").alias("accn"), F.col("e.frame").alias("frame"), F.col("e.val").alias("val"))

    def _kept(self) -> DataFrame:
        """Entries of documents that could be read, and of mapped tags only if a map is given."""
        e = self.entries.where("problem IS NULL")
        return e if self.concepts is None else e.join(F.broadcast(self.concepts), "concept", "left_semi")

    def census(self) -> DataFrame:
        """Entries, with or without a value, of every tag of every company, mapped or not."""
        e = self.entries.where("problem IS NULL AND e IS NOT NULL")
        return e.groupBy("cik", "taxonomy", "concept").agg(F.count(F.lit(1)).alias("n_facts"))

    def companies(self) -> DataFrame:
        """``(cik, name)``; of several documents of a company the last file by name tells."""
        d = self.entries.where("problem IS NULL").select("cik", "name", "file").distinct()
        return d.groupBy("cik").agg(F.max_by("name", F.struct("file", "name")).alias("name"))

    def log(self) -> DataFrame:
        """``(file, cik, n_facts, status, message)`` of every document: ok, empty, or error."""
        used = self._kept().where("e.val IS NOT NULL").groupBy("file", "cik").agg(F.count(F.lit(1)).alias("n"))
        docs = self.entries.select("file", "cik", "problem").distinct()
        there = docs.join(used.withColumnsRenamed({"file": "_file", "cik": "_cik"}), (F.col("file") == F.col("_file")) & F.col("cik").eqNullSafe(F.col("_cik")), "left")
        status = F.when(F.col("problem").isNotNull(), "error").when(F.col("n").isNull(), "empty").otherwise("ok")
        return there.select("file", "cik", F.coalesce("n", F.lit(0)).alias("n_facts"), status.alias("status"), F.col("problem").alias("message"))


def scan(spark: SparkSession, path: str, concept_map: DataFrame | None = None, first: int | None = None, pattern: str = "*.json") -> Landed:
    """All documents of a folder, or only the ``first`` files by name; with ``concept_map`` only mapped tags become facts."""
    read = spark.read.schema(DOCUMENT).option("mode", "PERMISSIVE").option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    docs = read.json(path)
    # the names that Spark has listed, empty files among them, as its metadata column writes them
    listed = sorted(re.sub(r"^(\w+):///", r"\1:/", f) for f in docs.inputFiles())
    if first is not None:
        listed = listed[:first]
        docs = read.json([unquote(f) for f in listed]) if listed else docs.where("false")
    names = spark.createDataFrame([(f,) for f in listed], "file string")
    docs = docs.withColumn("file", F.col("_metadata.file_path")).withColumn("cik", F.expr("try_cast(cik AS BIGINT)"))
    bad = F.when(F.col("_corrupt_record").isNotNull(), "not a filing document").when(F.col("cik").isNull(), "no company number")
    docs = docs.select("file", "cik", F.col("entityName").alias("name"), bad.alias("problem"), F.when(bad.isNull(), F.col("facts")).alias("facts"))
    e = docs.select("file", "cik", "name", "problem", F.explode_outer("facts").alias("taxonomy", "tags")).select("file", "cik", "name", "problem", "taxonomy", F.explode_outer("tags").alias("concept", "tag"))
    e = e.select("file", "cik", "name", "problem", "taxonomy", "concept", F.explode_outer("tag.units").alias("unit", "list")).select("file", "cik", "name", "problem", "taxonomy", "concept", "unit", F.explode_outer("list").alias("e"))
    parsed = spark.read.schema(e.schema).parquet(store(e, "documents"))
    silent = names.join(parsed.select("file").distinct(), "file", "left_anti").withColumn("problem", F.lit("no document"))
    return Landed(parsed.unionByName(silent, allowMissingColumns=True), None if concept_map is None else concept_map.select("concept").distinct())

