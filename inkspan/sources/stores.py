"""The corpus and the site's tables as stored snapshots: sources that are validated and published whole, a folder followed by a stream, addresses kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkspan.sources.errors import BAD_ADDRESS, BAD_NAME, EMPTY
from inkspan.sources.readers import EXTENSIONS, MAX_FILE_BYTES, changed_sources, extension, extract_text, signatures
from inkspan.sources.snapshots import Snapshots

CORPUS = "source_key string, text string, source_type string, modified timestamp, length long"
ADDRESSES = "email string, consented_at timestamp, source string"
VIEWS = "path string, viewed_at timestamp"
# What an address looks like, and lengths that are kept.
LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
ADDRESS, LONGEST, SOURCE_LENGTH, PATH_LENGTH = rf"^[a-z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{LABEL}(?:\.{LABEL})+\z", 254, 80, 200


def corpus_store(spark: SparkSession, folder: str) -> Snapshots:
    return Snapshots(spark, folder, CORPUS, "source_key")


def valid_name(name: Column) -> Column:
    """A plain file name of an allowed type."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\]") & extension(name).isin(*EXTENSIONS), F.lit(False))


def add_sources(store: Snapshots, files: DataFrame) -> DataFrame:
    """Validate `files` (path, content; the path is the name to be), publish those that are new, and return source_key, status and error of each row.

    A name that is there already is never overwritten ("exists"); of two new
    files of one name the first by text is published. All accepted files appear
    in one version, or none if writing fails.
    """
    name = F.col("path")
    read = extract_text(files).select(name.alias("source_key"), "text", "status", "error")
    read = read.withColumns({"error": F.when(~valid_name(F.col("source_key")), BAD_NAME).when(F.col("status") != "success", F.col("error")).when(F.trim("text") == "", EMPTY)})
    own = read.filter("error IS NULL").select("source_key", "text", F.lit("institutional_corpus").alias("source_type"), F.lit(None).cast("timestamp").alias("modified"), F.length("text").cast("long").alias("length"))
    added = store.insert_new(own).select(F.col("source_key").alias("__new"), F.col("text").alias("__text"))
    told = read.join(added, (F.col("source_key") == F.col("__new")) & (F.col("text") == F.col("__text")), "left")
    status = F.when(F.col("error").isNotNull(), "rejected").when(F.col("__new").isNotNull(), "added").otherwise("exists")
    return told.select("source_key", status.alias("status"), "error")


def delete_sources(store: Snapshots, names: DataFrame) -> int:
    """Take the sources of `names` (source_key) out; names that aren't there change nothing. The version afterwards."""
    return store.replace(gone=names.filter(valid_name(F.col("source_key"))))


def refresh(spark: SparkSession, folder: str, store: Snapshots, stream: str | None = None, batch: int = 0) -> int:
    """Bring the store to the state of a folder: only files whose time or size differs from the stored ones are opened.

    Sources that aren't in the folder go, so a store either follows a folder or
    is added to. Unreadable files have no row and are looked at again each time.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    now = signatures(spark, folder).filter(F.col("length") <= MAX_FILE_BYTES)
    known = store.read().select(F.col("source_key").alias("path"), F.col("modified").alias("modificationTime"), "length")
    changes = changed_sources(known, now.select(name.alias("path"), "modificationTime", "length"))
    opened = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder).filter(F.col("length") <= MAX_FILE_BYTES).filter(extension(F.col("path")).isin(*EXTENSIONS))
    wanted = changes.filter("change <> 'removed'").select(F.col("path").alias("source_key"))
    opened = opened.withColumn("source_key", name).join(wanted, "source_key", "left_semi")
    texts = extract_text(opened.select("path", "content")).filter("status = 'success'").select("path", "text")
    rows = opened.select("path", "source_key", F.col("modificationTime").alias("modified"), "length").join(texts, "path").withColumn("source_type", F.lit("institutional_corpus"))
    return store.replace(rows.drop("path"), changes.select(F.col("path").alias("source_key")), stream, batch)


def follow(spark: SparkSession, folder: str, store: Snapshots, checkpoint: str, name: str = "corpus", every: str = "10 seconds") -> StreamingQuery:
    """A stream that refreshes the store from the folder at each tick; a tick that is run again after a failure changes nothing more."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    step = lambda _, batch: refresh(spark, folder, store, name, batch)
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).queryName(name).trigger(processingTime=every).start()


def address_store(spark: SparkSession, folder: str) -> Snapshots:
    return Snapshots(spark, folder, ADDRESSES, "email")


def subscribe(store: Snapshots, rows: DataFrame) -> DataFrame:
    """Keep each address of `rows` (email, consented_at, source) once, with its first consent; returns email, status and error of each row.

    Addresses are trimmed and lower-cased; one that is stored keeps its row.
    """
    email = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    told = rows.select(email.alias("email"), F.col("consented_at").cast("timestamp").alias("consented_at"), F.left(F.coalesce("source", F.lit("site_footer")), F.lit(SOURCE_LENGTH)).alias("source"))
    valid = (F.length("email") <= LONGEST) & F.col("email").rlike(ADDRESS)
    added = store.insert_new(told.filter(valid), "consented_at").select("email", F.lit(True).alias("__new"))
    status = F.when(~valid, "rejected").when(F.col("__new"), "added").otherwise("exists")
    return told.join(added, "email", "left").select("email", status.alias("status"), F.when(~valid, BAD_ADDRESS).alias("error"))


def view_store(spark: SparkSession, folder: str) -> Snapshots:
    return Snapshots(spark, folder, VIEWS, "path")


def record_views(store: Snapshots, views: DataFrame) -> int:
    return store.append(views.select(F.left(F.coalesce("path", F.lit("/")), F.lit(PATH_LENGTH)).alias("path"), F.col("viewed_at").cast("timestamp").alias("viewed_at")))


def view_summary(store: Snapshots, now: Column, days: int = 30) -> DataFrame:
    """Views of the last days (1 to 365) and of all time."""
    days = max(1, min(days, 365))
    recent = F.count(F.when(F.col("viewed_at") >= now - F.make_dt_interval(F.lit(days)), 1))
    return store.read().agg(recent.alias("page_views"), F.count("*").alias("all_time_page_views")).withColumn("days", F.lit(days).cast("long"))
