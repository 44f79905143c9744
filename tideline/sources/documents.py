"""Document sources, records, stored chunk tables and per-document sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import lexicon as lx


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def detect_format(path: Column, content: Column, magic=lx.MAGIC, extensions=lx.EXTENSIONS) -> Column:
    """The format by the first bytes, in order; containers and unknown bytes go by the extension; null if that is unknown too."""
    start = F.substring(content, 1, 8)
    by_name = F.create_map(*(F.lit(x) for kv in extensions.items() for x in kv))[extension(path)]
    out = by_name
    for head, name in reversed(magic):
        out = F.when(F.startswith(start, F.lit(head)), by_name if name is None else F.lit(name)).otherwise(out)
    return out


def read_batch(spark: SparkSession, paths: str | list[str], raises: bool = False) -> DataFrame:
    """path, content, format, success, error: one row per file; a file of unknown format is a row with an error, or fails the job."""
    return with_status(spark.read.format("binaryFile").load(paths).select("path", "content"), raises)


def with_status(files: DataFrame, raises: bool = False) -> DataFrame:
    found = files.withColumn("format", detect_format(F.col("path"), F.col("content")))
    problem = F.when(F.col("content").isNull(), F.lit("no content")).when(F.col("format").isNull(), F.concat(F.lit("unsupported extension: "), extension(F.col("path"))))
    if raises:
        problem = F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
    return found.withColumn("error", problem).withColumn("success", F.col("error").isNull())


#: Field -> default of a document record; a field is set to it only where the key is absent.
RECORD_DEFAULTS = {
    "filename": None, "society": None, "regulation": None, "version_year": None, "chapter": None, "domain": "general",
    "vessel_types": "[]", "system": None, "manufacturer": None, "model": None, "language": "zh", "custom_tags": "{}",
}


def document_record(fields: Column, defaults: dict = RECORD_DEFAULTS) -> list[Column]:
    """One column per field of a map<string,string>: absent keys take the default, a null under its key stays null."""
    return [F.when(F.map_contains_key(fields, F.lit(k)), F.element_at(fields, F.lit(k))).otherwise(F.lit(v).cast("string")).alias(k) for k, v in defaults.items()]


def upsert(stored: DataFrame, loaded: DataFrame, key: str = "chunk_id", order: str = "load_no") -> DataFrame:
    """Rows by key; of several the latest load wins. Both have the column ``order``."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return stored.unionByName(loaded).withColumn("__r", F.row_number().over(latest)).filter("__r = 1").drop("__r")


def delete_by_document(chunks: DataFrame, doomed: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and (key, n) of what was removed."""
    gone = chunks.join(doomed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_deleted"))
    return chunks.join(doomed.select(key).distinct(), key, "left_anti"), gone


def conjunction(filters: dict, drop_empty: bool = False) -> Column:
    """Equality on every column; drop_empty leaves out null and ''."""
    out = F.lit(True)
    for name, value in filters.items():
        if drop_empty and value in (None, ""):
            continue
        out = out & (F.col(name) == value)
    return out


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, menus and comments out, tags to blanks, five references decoded, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<head\b.*?</head>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))


def write_documents(docs: DataFrame, path: str, by: str = "doc_id") -> DataFrame:
    """Write payloads as JSON, one folder per document; returns the rows refused (no id or no payload)."""
    bad = F.col(by).isNull() | (F.col(by).cast("string") == "") | F.col("payload").isNull()
    docs.filter(~bad).write.partitionBy(by).mode("overwrite").json(path)
    return docs.filter(bad)


def read_documents(spark: SparkSession, path: str, by: str = "doc_id") -> DataFrame:
    """What write_documents() wrote: the id and the payload."""
    return spark.read.schema(f"payload string, {by} string").json(path)


def write_packed(docs: DataFrame, path: str, by: str = "doc_id", file_bytes: int = 128 << 20) -> DataFrame:
    """Write every row as a line of JSON, many documents to a file of about ``file_bytes``; returns the rows refused (no id).

    Under path: lines (text files, sorted by id), index (id, part, at, n_bytes: the file's number, and where in it the line
    stands) and refused. Binary columns become base64, times ISO 8601, other characters stay as they are. The number of files
    follows the bytes, not the documents.
    """
    from tideline.operators.graph import cut

    empty = F.col(by).isNull() | (F.col(by).cast("string") == "")
    docs.filter(empty).write.mode("overwrite").parquet(f"{path}/refused")
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    lines = docs.filter(~empty).select(F.col(by).alias("id"), F.to_json(F.struct(*docs.columns), times).alias("value"))
    total = lines.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    held = cut(lines.repartitionByRange(max(1, -(-total // file_bytes)), "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()))
    held.select("value").write.mode("overwrite").text(f"{path}/lines")
    at = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("part").orderBy("id", "value").rowsBetween(Window.unboundedPreceding, -1))
    held.select("id", "part", F.coalesce(at, F.lit(0)).alias("at"), F.octet_length("value").alias("n_bytes")).write.mode("overwrite").parquet(f"{path}/index")
    return docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/refused")


def read_packed(spark: SparkSession, path: str, wanted: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """value (JSON) of what write_packed() wrote; of ``wanted`` ids only the files that the index names are opened."""
    lines = spark.read.text(f"{path}/lines")
    if wanted is None:
        return lines
    index = spark.read.parquet(f"{path}/index")
    parts = index.join(wanted.select(F.col(by).alias("id")).distinct(), "id", "left_semi")
    held = {r["part"] for r in parts.select("part").distinct().collect()}  # numbers of files
    files = [f for f in lines.inputFiles() if int(f.rsplit("part-", 1)[1].split("-", 1)[0]) in held]
    if not files:
        return lines.limit(0)
    ids = parts.select("id").distinct()
    kind = ids.schema["id"].dataType
    return spark.read.text(files).withColumn("id", F.get_json_object("value", f"$.{by}").cast(kind)).join(ids, "id", "left_semi").select("value")


def table_csv(tables: DataFrame) -> DataFrame:
    """doc_id, csv: all tables of a document, in order, under '# Table n'; a table without rows becomes a marker line."""
    body = F.concat(F.lit("# Table "), F.col("table_no").cast("string"), F.lit("\n"), F.coalesce("csv", F.lit("# (failed)")))
    return tables.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", body.alias("b")))), lambda x: x["b"]), "\n").alias("csv"))
