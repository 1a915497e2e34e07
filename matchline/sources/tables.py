"""Reading the procurement tables with declared types, tenant scoping, and intake of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Declared columns of the stored tables.
SCHEMAS = {
    "vendors": "vendor_id long, name string, tax_id string, tenant_id string",
    "po": "po_id long, po_number string, vendor_id long, order_date date, currency string, status string, tenant_id string",
    "po_line": "po_line_id long, po_id long, line_number long, description string, quantity decimal(18,4), unit_price decimal(18,4), tax_rate decimal(8,4), tenant_id string",
    "grn": "grn_id long, grn_number string, po_id long, receipt_date date, tenant_id string",
    "grn_line": "grn_line_id long, grn_id long, po_id long, line_number long, received_quantity decimal(18,4), po_line_id long, tenant_id string",
    "inv": "invoice_id long, invoice_number string, vendor_id long, po_id long, invoice_date date, currency string, total_amount decimal(18,4), status string, tenant_id string",
    "inv_line": "invoice_line_id long, invoice_id long, po_id long, line_number long, quantity decimal(18,4), unit_price decimal(18,4), tax_rate decimal(8,4), po_line_id long, tenant_id string",
}
ALLOWED = {
    ".pdf": ("application/pdf",),
    ".jpg": ("image/jpeg",),
    ".jpeg": ("image/jpeg",),
    ".png": ("image/png",),
    ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
}


def typed(df: DataFrame, name: str) -> DataFrame:
    """df with the table's declared columns and types; missing columns are null, values that don't fit are an error."""
    wanted = [x.rsplit(" ", 1) for x in SCHEMAS[name].split(", ")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted))


def read_tables(spark: SparkSession, path: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """Parquet tables under path, one folder or file per name."""
    return {n: typed(spark.read.parquet(f"{path.rstrip('/')}/{n}.parquet"), n) for n in names}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Writes tables by tenant, so that S2 reads one tenant's folders only."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{path.rstrip('/')}/{name}.parquet")


def scope_tenant(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """One tenant's rows, or all."""
    return df if tenant_id is None else df.where(F.col("tenant_id") == F.lit(tenant_id))


def stamp_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Fills in the tenant where a row has none."""
    return df.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(tenant_id)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as filename, content_type (null) and content."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), "content")


def safe_filename(c: Column) -> Column:
    """The last part of a path without '..'; an empty name is 'upload'."""
    name = F.element_at(F.split(F.regexp_replace(F.trim(F.coalesce(c, F.lit("upload"))), r"[\\/]+$", ""), r"[\\/]"), -1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(name, r"\.\.", "_"), 1, 512), F.lit("")), F.lit("upload"))


def validate_intake(files: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """S3: files(filename, content_type, content) with safe_name, extension, mime and error (null: accepted).

    The first failing check counts: empty, too_large, extension, mime.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    own = files.withColumn("safe_name", safe_filename(F.col("filename")))
    own = own.withColumns({"extension": F.lower(F.regexp_extract("safe_name", r"[^.](\.[^.]+)$", 1)), "mime": F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))})
    allowed = F.create_map(*(x for e, m in ALLOWED.items() for x in (F.lit(e), F.array(*map(F.lit, m)))))
    known = F.try_element_at(allowed, F.col("extension"))
    error = F.when(size == 0, "empty").when(size > max_bytes, "too_large").when(known.isNull(), "extension").when(~F.array_contains(known, F.col("mime")), "mime")
    return own.withColumn("error", error)


def dedupe_content(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """files(document_id, tenant_id, content) with sha256 and duplicate_of: the first document with equal content.

    existing(document_id, tenant_id, sha256) comes before all files; among these the least id is first.
    """
    own = files.withColumn("sha256", F.sha2("content", 256))
    first = Window.partitionBy("tenant_id", "sha256")
    own = own.withColumn("_first", F.min("document_id").over(first))
    if existing is not None:
        old = existing.groupBy(F.col("tenant_id").alias("_t"), F.col("sha256").alias("_h")).agg(F.min("document_id").alias("_old"))
        own = own.join(old, (F.col("sha256") == F.col("_h")) & F.col("tenant_id").eqNullSafe(F.col("_t")), "left").withColumn("_first", F.coalesce("_old", "_first")).drop("_t", "_h", "_old")
    return own.withColumn("duplicate_of", F.when(F.col("_first") != F.col("document_id"), F.col("_first"))).drop("_first")
