"""A source registry: entries, the events that change them, and a saved form that shows when it was changed by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import merkle
from millrace.runtime import fresh, materialize

# Fixed values.
STATUS = {"validate": "validated", "reject": "rejected", "approve": "approved"}
FIELDS = (
    "source_id string", "name string", "url string", "category string", "licence string", "licence_id string", "licence_risk double", "acquisition_date string", "acquired_by string", "raw_path string",
    "raw_sha256 string", "source_validated boolean", "validation_date string", "validated_by string", "status string", "approved_paragraphs long", "approved_tokens_est long", "approval_date string", "approved_by string", "notes string",
)
NAMES = [f.split()[0] for f in FIELDS]


def register(entries: DataFrame) -> DataFrame:
    """New records of entries, whatever columns of the record they have; of entries with the same source_id the first by all their columns.

    What an entry doesn't have is null; its status is pending. A null source_id is no entry.
    """
    held = {c.lower() for c in entries.columns}
    own = {"status": F.lit("pending"), "source_validated": F.lit(False), "approved_paragraphs": F.lit(0), "approved_tokens_est": F.lit(0)}
    cast = lambda f: (own.get(f.split()[0], F.lit(None)) if f.split()[0] not in held or f.split()[0] in own else F.col(f.split()[0])).cast(f.split()[1]).alias(f.split()[0])
    rows = entries.where("source_id is not null").select(*[cast(f) for f in FIELDS])
    return rows.groupBy("source_id").agg(F.min(F.struct(*[c for c in NAMES if c != "source_id"])).alias("r")).select("source_id", "r.*").select(*NAMES)


def updated(records: DataFrame, events: DataFrame) -> DataFrame:
    """records after events (at, source_id, action, by, day, paragraphs, tokens, note): validate, reject, approve.

    The last event, by `at`, decides the status and its own fields; the last approval
    counts the paragraphs and tokens, the last validation or rejection who validated.
    Events of unknown sources or actions change nothing.
    """
    known = events.where(F.col("action").isin(*STATUS))
    last = known.groupBy("source_id").agg(
        F.max_by("action", "at").alias("action_"), F.max_by("note", F.when(F.col("action") != "approve", F.col("at"))).alias("note_"),
        F.max(F.when(F.col("action") != "approve", F.struct("at", F.col("action") == "validate", "by", "day"))).alias("v_"),
        F.max(F.when(F.col("action") == "approve", F.struct("at", "by", "day", "paragraphs", "tokens"))).alias("a_"),
    )
    joined = records.join(last, "source_id", "left")
    status = F.when(F.col("action_").isNull(), F.col("status"))
    for action, name in STATUS.items():
        status = status.when(F.col("action_") == action, name)
    now = {
        "status": status, "notes": F.coalesce("note_", "notes"), "source_validated": F.coalesce(F.col("v_")["col2"], F.col("source_validated")), "validated_by": F.coalesce(F.col("v_.by"), F.col("validated_by")),
        "validation_date": F.coalesce(F.col("v_.day"), F.col("validation_date")), "approved_by": F.coalesce(F.col("a_.by"), F.col("approved_by")), "approval_date": F.coalesce(F.col("a_.day"), F.col("approval_date")),
        "approved_paragraphs": F.coalesce(F.col("a_.paragraphs"), F.col("approved_paragraphs")), "approved_tokens_est": F.coalesce(F.col("a_.tokens"), F.col("approved_tokens_est")),
    }
    return joined.withColumns(now).select(*NAMES)


def checksum(records: DataFrame) -> str:
    """The root of a hash tree over the records as JSON with sorted keys; the records' order says nothing."""
    rows = records.select(F.lit("").alias("part"), F.conv(F.substring(F.sha2("source_id", 256), 1, 8), 16, 10).cast("long").alias("doc_id"), F.to_json(F.struct(*sorted(NAMES))).alias("text"))
    root = merkle.roots(merkle.tree(rows)).first()
    return root["hash"] if root else ""


def save(records: DataFrame, path: str) -> str:
    """Write the records as JSON lines, and then their checksum, which it returns."""
    rows = materialize(records.select(*NAMES), "registry")
    rows.write.mode("overwrite").json(f"{path}/sources")
    found = checksum(rows)
    records.sparkSession.createDataFrame([(found,)], "checksum string").coalesce(1).write.mode("overwrite").json(f"{path}/checksum")
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """The saved records. Raises ValueError where they aren't what was saved."""
    rows = spark.read.schema(", ".join(FIELDS)).json(f"{path}/sources")
    said = spark.read.schema("checksum string").json(f"{path}/checksum").first()
    if said is None or checksum(rows) != said["checksum"]:
        raise ValueError(f"the registry at {path} was changed after it was saved")
    return rows


def listed(records: DataFrame, category: str | None = None, status: str | None = None) -> DataFrame:
    """The records of a category and status, where given."""
    for name, value in (("category", category), ("status", status)):
        if value is not None:
            records = records.where(F.col(name) == value)
    return records


def cleaned_once(spark: SparkSession, docs: DataFrame, path: str, clean) -> DataFrame:
    """(doc_id, chars_in, chars_out) of what this call cleans of docs (doc_id, text): documents that the output has already are passed over.

    clean is a function of a column. The output is appended to (doc_id, cleaned) at
    `path`; a call that was stopped is repeated and goes on with what is missing.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, cleaned string"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    done, key = spark.read.schema(schema).parquet(path), fresh("done", docs)
    new = docs.join(done.select(F.col("doc_id").alias(key)), F.col("doc_id") == F.col(key), "left_anti")
    rows = materialize(new.select("doc_id", F.length("text").alias("chars_in"), clean(F.col("text")).alias("cleaned")), "cleaned")
    rows.select("doc_id", "cleaned").write.mode("append").parquet(path)
    return rows.select("doc_id", "chars_in", F.length("cleaned").alias("chars_out"))
