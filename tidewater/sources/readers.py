"""Readers: every format ends in the same tables, with plain columns and the date columns parsed later."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import as_text, first_non_empty, strip

FORMATS = ("json", "jsonl", "tsv", "csv", "txt")
ID_NAMES, BODY_NAMES = ("doc_id", "id", "docno"), ("full_text", "fullText", "text", "body")
CITATION_COLUMNS = ("id", "citing", "cited", "creation", "timespan", "journal_sc", "author_sc", "citing_doc_id", "cited_doc_id")


def infer_format(path: str, explicit: str | None = None) -> str:
    """The named format in lower case, else the file's suffix; anything unknown is an error."""
    name = (explicit or Path(path.removesuffix(".gz")).suffix.lstrip(".")).lower()
    if name not in FORMATS:
        raise ValueError(f"unknown format of {path}: {name!r}")
    return name


def read_records(spark: SparkSession, path: str, explicit: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Records of one file or folder. JSON may be a list, or an object that holds one under `data`; CSV and TSV need a header, and all their values are strings."""
    kind = infer_format(path, explicit)
    r = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    if kind == "json":
        df = r.option("multiLine", True).json(path)
        first = spark.read.text(path).where(F.trim("value") != "").first()
        if first is None or first.value.lstrip("\ufeff \t").startswith("["):
            return df
        if "data" not in df.columns or not isinstance(df.schema["data"].dataType, T.ArrayType) or not isinstance(df.schema["data"].dataType.elementType, T.StructType):
            raise ValueError(f"{path} holds neither a list of records nor one under `data`")
        return df.select(F.inline("data"))
    if kind == "jsonl":
        return r.json(path)
    if kind == "txt":
        return read_qrels_text(spark, path)
    return r.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("inferSchema", False).csv(path)


def _must(cond: Column, value: Column, message: str) -> Column:
    return F.when(cond, value).otherwise(F.raise_error(F.lit(message)))


def _split_lines(spark: SparkSession, path: str, n: int, names: list[str]) -> DataFrame:
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    parts = F.split(strip(F.col("value")), r"(?U)\s+")
    parts = _must(F.size(parts) == n, parts, f"a line hasn't {n} columns")
    return lines.select(parts.alias("p"), F.monotonically_increasing_id().alias("line_no")).select(*(F.col("p")[i].alias(c) for i, c in enumerate(names) if c), "line_no")


def read_qrels_text(spark: SparkSession, path: str) -> DataFrame:
    return _split_lines(spark, path, 4, ["query_id", "", "doc_id", "relevance"]).withColumn("relevance", F.col("relevance").cast("int"))


def read_run(spark: SparkSession, path: str, keep_rows: bool = True, keep_lines: bool = False) -> DataFrame:
    """A run file. keep_rows: as it stands, with rank and name; else one row per query and document, the last line's score. keep_lines: with line_no, the place in the file (of repeated documents the last)."""
    rows = _split_lines(spark, path, 6, ["query_id", "", "doc_id", "rank", "score", "run_name"])
    rows = rows.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), "run_name", "line_no")
    out = rows if keep_rows else rows.groupBy("query_id", "doc_id").agg(F.max_by("score", "line_no").alias("score"), F.max("line_no").alias("line_no"))
    return out if keep_lines else out.drop("line_no")


def read_topics_tsv(spark: SparkSession, path: str) -> DataFrame:
    """query_id TAB text without a header; blank lines are skipped, a line without a tab is an error."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    parts = F.split("value", "\t", 2)
    parts = _must(F.size(parts) == 2, parts, "a line hasn't a tab")
    return lines.select(parts[0].alias("query_id"), parts[1].alias("text"))


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CITATION_COLUMNS])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(*(as_text(F.col(c)).alias(c) for c in CITATION_COLUMNS))


def _named(df: DataFrame, names: tuple[str, ...], fields: dict[str, str], target: str) -> Column:
    have = [fields[target]] if target in fields else [n for n in names if n in df.columns]
    return first_non_empty(*(as_text(F.col(n)) for n in have)) if have else F.lit(None).cast("string")


def normalize_corpus(df: DataFrame, fields: dict[str, str] | None = None, load_full_text: bool = True, missing: str = "error") -> DataFrame:
    """(doc_id, title, abstract, full_text, snapshot_id, metadata): ids and bodies under any of their names, or as `fields` maps them.

    A record without an id is an error, or left out (missing='skip'). What no column takes goes into metadata, as text. Without load_full_text the body isn't read.
    """
    fields = fields or {}
    doc_id = _named(df, ID_NAMES, fields, "doc_id")
    if missing == "skip":
        df = df.where(doc_id.isNotNull())
    used = {*ID_NAMES, *BODY_NAMES, "title", "abstract", "snapshot_id", *fields.values()}
    rest = [c for c in df.columns if c not in used]
    meta = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    text = lambda name: F.coalesce(_named(df, (name,), fields, name), F.lit(""))
    body = F.coalesce(_named(df, BODY_NAMES, fields, "full_text"), F.lit("")) if load_full_text else F.lit("")
    return df.select(_must(doc_id.isNotNull(), doc_id, "a record has no doc_id").alias("doc_id"), text("title").alias("title"), text("abstract").alias("abstract"), body.alias("full_text"), (F.col("snapshot_id") if "snapshot_id" in df.columns else F.lit(None).cast("string")).alias("snapshot_id"), meta.alias("metadata"))


def merge_corpus(rows: DataFrame) -> DataFrame:
    """Upsert of corpus records (doc_id, title, abstract, full_text, metadata, kind, ord), in the order of ord.

    The first title and abstract that aren't empty hold; of full texts the last of kind `fulltext`, else the first of another; of each metadata key the first value.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("ord")))
    full = F.when(F.col("kind") == "fulltext", some("full_text"))
    other = F.when(F.col("kind") != "fulltext", some("full_text"))
    base = rows.groupBy("doc_id").agg(first(some("title")).alias("title"), first(some("abstract")).alias("abstract"), F.coalesce(F.max_by(full, F.when(full.isNotNull(), F.col("ord"))), first(other)).alias("full_text"))
    meta = rows.select("doc_id", "ord", F.explode("metadata").alias("k", "v")).groupBy("doc_id", "k").agg(F.min_by("v", "ord").alias("v"))
    meta = meta.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
    out = base.join(meta, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "abstract", "full_text")), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def snapshot_files(spark: SparkSession, root: str, part: str) -> DataFrame:
    """All JSON-lines records under a folder whose path holds `part`, upper and lower case alike, with their file and their place in it. Other files aren't opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    paths = [r.path for r in listed.where(F.lower("path").contains(part.lower())).orderBy("path").collect()]  # names of files
    if not paths:
        raise ValueError(f"{root} has no files of {part}")
    df = spark.read.option("mode", "FAILFAST").json(paths)
    return df.withColumns({"file_path": F.col("_metadata.file_path"), "place": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))})


def within(docs: DataFrame, after_s: int, upto_s: int) -> DataFrame:
    """Documents published in (after, upto]; undated ones are left out."""
    return docs.where((F.col("published_s") > after_s) & (F.col("published_s") <= upto_s))
