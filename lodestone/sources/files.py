"""File sources and sinks: inventories, immutable reports, graph snapshots, document tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How files of a kind begin.
MAGIC = {"pdf": b"%PDF-", "docx": b"PK\x03\x04"}


def begins_with(spark: SparkSession, files: DataFrame, magic: bytes) -> DataFrame:
    """(path, begins) of files (path): only as many bytes are read as ``magic`` has. Paths of a local or mounted disk are opened
    where the tasks run; those of other stores are read by Spark, whose file sources read a file whole."""
    local = F.col("path").startswith("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                with open(path.removeprefix("file:"), "rb", buffering=0) as f:
                    found.append(f.read(len(magic)) == magic)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.bool_())], ["path", "begins"])

    near, far = files.select("path").filter(local), files.select("path").filter(~local)
    opened = near.mapInArrow(run, "path string, begins boolean")
    rest = [r[0] for r in far.limit(1).collect()]
    if not rest:
        return opened
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(rest[0].rsplit("/", 1)[0]).select("path", (F.substring("content", 1, len(magic)) == F.lit(bytearray(magic))).alias("begins"))
    return opened.unionByName(content.join(far, "path", "left_semi"))


def file_inventory(spark: SparkSession, folder: str, extension: str, most_bytes: int = 50_000_000) -> DataFrame:
    """(path, length, status) of all files below a folder: kept, or why not. Lengths come from the listing; files of the right
    extension and length are opened for their first bytes. Spark leaves empty files out of its listing, so that they are
    never kept."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    early = F.when(~F.lower("path").endswith(f".{extension}"), "extension").when(F.col("length") > most_bytes, "too_large")
    rows = listed.withColumn("early", early)
    magic = MAGIC.get(extension)
    if magic is None:
        return rows.select("path", "length", F.coalesce("early", F.lit("kept")).alias("status"))
    looked_at = begins_with(spark, rows.filter("early is null").select("path"), magic)
    status = F.coalesce("early", F.when(F.col("begins"), "kept").otherwise("magic"))
    return rows.join(looked_at, "path", "left").select("path", "length", status.alias("status"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Normalized documents as Parquet, a folder for each workspace and source."""
    docs.write.partitionBy("workspace_id", "source_id").mode("errorifexists").parquet(path)


def read_documents(spark: SparkSession, path: str, workspace: str, source: str | None = None) -> DataFrame:
    """Documents of one workspace (and source): the filter prunes folders."""
    docs = spark.read.parquet(path).filter(F.col("workspace_id") == workspace)
    return docs if source is None else docs.filter(F.col("source_id") == source)


def write_report(observations: DataFrame, facts: dict[str, str], root: str, stamp: str, config: str) -> str:
    """An immutable report (JSON lines) with the answers' texts redacted; its name has the time, the configuration and 12
    digits of its content's hash. A report that exists is not overwritten."""
    hidden = observations.withColumn("segments", F.transform("segments", lambda s: s.withField("text", F.lit("[redacted]"))))
    rows = hidden.withColumns({k: F.lit(v) for k, v in facts.items()})
    digest = rows.agg(F.sha2(F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).cast("string"), F.lit("")), 256)).first()[0][:12]
    path = f"{root}/{stamp}-{config}-{digest}"
    rows.write.mode("errorifexists").json(path)
    return path


def read_reports(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(report, rows, broken) of all reports, newest first; those with a broken line are not to be read."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    named = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("report"), parsed["_broken"].alias("broken"))
    return named.groupBy("report").agg(F.count("*").alias("rows"), F.count("broken").alias("broken")).orderBy(F.desc("report"))


def write_graph(entities: DataFrame, relationships: DataFrame, manifest: DataFrame, root: str) -> None:
    """Vertices and edges, then the one-row manifest."""
    entities.write.mode("errorifexists").parquet(f"{root}/entities")
    relationships.write.mode("errorifexists").parquet(f"{root}/relationships")
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest")


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/entities"), spark.read.parquet(f"{root}/relationships"), spark.read.parquet(f"{root}/manifest")
