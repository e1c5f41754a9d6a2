"""Incremental secret scans: a ledger of content-addressed blobs and the rule versions they were scanned with.

DataFrame functions only. Every version of every path is addressed by the SHA-256 of its text; only
pairs of blob and rule version that the ledger lacks are scanned; findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let, running
from .storage import materialize, need, unused

LEDGER = "blob string, rule string, version int, n_code_points long, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern``: leftmost, non-overlapping Java matches. ``group`` (0: the match) must have ``least`` code points.

    ``marks``: the pattern is only tried on texts whose lower-cased form holds one of them (all, if none).
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    marks: tuple[str, ...] = ()


# The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that this scanner adds.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, ("eyj",)),
)
RULES = BASE + ADDED


def spans_of(text: Column, rule: Rule, lowered: Column) -> Column:
    """``array<struct<start,end>>`` in code points, end exclusive: matches are placed by the lengths of the gaps between them."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sized = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), part.alias("p")),
                       lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["w"]).alias("size"), F.length(m["p"]).alias("key")))

    def place(found: Column) -> Column:
        before = running(F.transform(found, lambda m: m["gap"] + m["size"]), lambda x, y: x + y)
        spans = F.zip_with(found, before, lambda m, at: F.struct((at + m["gap"]).alias("start"), (at + m["gap"] + m["size"]).alias("end"), m["key"].alias("key")))
        return F.transform(F.filter(spans, lambda x: x["key"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    placed = let(sized, place)
    wanted = F.lit(False) if rule.marks else text.rlike(rule.pattern)
    for m in rule.marks:
        wanted = wanted | lowered.contains(m)
    return F.when(wanted, placed).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, text, todo array<string>)`` -> ledger rows, one for each blob and rule named in ``todo``."""
    lowered = blobs.withColumn("lowered", F.lower("text"))
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.name), spans_of(F.col("text"), r, F.col("lowered"))).alias("spans")) for r in rules]
    rows = lowered.select("blob", F.length("text").cast("long").alias("n_code_points"), F.explode(F.array(*each)).alias("r")).where("r.spans IS NOT NULL")
    return rows.select("blob", "r.rule", "r.version", "n_code_points", "r.spans")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none where it has not been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        kinds = [f.split(" ", 1) for f in ("blob string", "rule string", "version int", "n_code_points long", "spans array<struct<start:int,end:int>>")]
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds])
    return spark.read.schema(LEDGER).parquet(ledger)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what is new in ``versions`` (path, text) and return the findings of every row.

    Returns all rows with ``path``, ``blob`` and ``findings``, an array of (rule, start, end) by start and
    then by the order of ``rules``. New ledger rows are appended to the Parquet folder ``ledger``; a run
    that was cut short leaves none and is simply run again. Null texts count as empty. Repeated rows are
    kept; the many paths of one blob meet as a skewed join key, which AQE splits.
    """
    spark = versions.sparkSession
    rows = need(versions, "path", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    known = read_ledger(spark, ledger).where(current).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    # one row stands for each blob; only the digests are grouped, the text follows its own row
    stand = rows.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.lit(r.name) for r in rules])
    todo = stand.join(known, "blob", "left").select("blob", "path", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = todo.where(F.size("todo") > 0)
    fresh = rows.alias("r").join(todo.alias("t"), F.expr("r.blob = t.blob AND r.path <=> t.path")).select("r.blob", "r.text", "t.todo")
    scan_blobs(fresh, rules).write.mode("append").parquet(ledger)
    done = spark.read.schema(LEDGER).parquet(ledger).where(current & (F.size("spans") > 0))
    # a run that was cut short may have left a row twice; one of each rule counts
    done = done.groupBy("blob").agg(*[F.first(F.when(F.col("rule") == r.name, F.col("spans")), ignorenulls=True).alias(f"of{k}") for k, r in enumerate(rules)])

    def ranked(k: int, rule: Rule) -> Column:
        spans = F.coalesce(f"of{k}", F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), F.lit(rule.name).alias("rule"), s["end"].alias("end")))

    done = done.select("blob", F.array_sort(F.concat(*[ranked(k, r) for k, r in enumerate(rules)])).alias("f"))
    empty = F.array().cast("array<struct<rule:string,start:int,end:int>>")
    found = F.transform("f", lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select("path", "blob").join(done, "blob", "left").select("path", "blob", F.coalesce(found, empty).alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_rules(findings: Column, rules: tuple[Rule, ...]) -> Column:
    return F.filter(findings, lambda x: x["rule"].isin(*[r.name for r in rules]))


#: Code points of the pieces that a text is cut in before it is redacted.
PIECE = 4096


def redact(text: Column, findings: Column, by: str = "[SECRET]") -> Column:
    """``text`` with every stretch that findings cover replaced; overlapping findings are one stretch."""

    def cut(pieces: Column, spans: Column) -> Column:
        def said(start: Column, end: Column) -> Column:
            own = lambda k: F.greatest(start - k * PIECE, F.lit(0))
            parts = F.transform(F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")),
                                lambda k: F.substring(F.element_at(pieces, k + 1), own(k) + 1, F.least(end - k * PIECE, F.lit(PIECE)) - own(k)))
            return F.when(end > start, F.array_join(parts, "")).otherwise("")

        reached = running(F.transform(spans, lambda f: f["end"]), lambda x, y: F.greatest(x, y))
        cuts = F.filter(F.zip_with(spans, reached, lambda f, at: F.struct(at.alias("at"), f["start"].alias("to"))), lambda c: c["to"] >= c["at"])
        last = F.array_max(F.transform(spans, lambda f: f["end"]))
        return F.array_join(F.concat(F.transform(cuts, lambda c: said(c["at"], c["to"])), F.array(said(last, F.length(text)))), by)

    by_start = F.array_sort(F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))
    done = let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), lambda pieces: let(by_start, lambda spans: cut(pieces, spans)))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def redact_all(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...), secrets replaced in ``text``.

    Rows of one doc_id may differ in text, repeated rows are kept, null texts stay null, and ``docs`` may have any
    other columns: what is found travels under names that it doesn't have.
    """
    path, blob, spans = (unused(docs, n) for n in ("found_path", "found_blob", "found_spans"))
    short = lambda digest: F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # noqa: E731  tells texts of one doc_id apart
    found = scan(docs.select(docs["doc_id"].alias("path"), docs["text"].alias("text")), ledger, rules).where(F.size("findings") > 0)
    found = found.groupBy(F.col("path").alias(path), short(F.col("blob")).alias(blob)).agg(F.first(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))).alias(spans))
    found = materialize(found, "found")
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[path]) & (short(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == found[blob]), "left")
    return joined.withColumn("text", F.when(F.col(spans).isNotNull(), redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))).select(*docs.columns)
