"""Sinks: idempotent loads, JSON and CSV artifacts, contract narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.changes import upsert


def merge_table(df: DataFrame, path: str, keys: list[str], order: str) -> DataFrame:
    """Upsert into a Parquet table kept as versions: the merge is written beside the old version and the pointer moves last.

    A job that fails leaves the old version; running it again gives the same table.
    """
    spark = df.sparkSession
    try:
        old = [r.version for r in spark.read.schema("version long").json(f"{path}/_current").collect()]
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = []
    now = spark.read.parquet(f"{path}/v{old[0]}") if old else spark.createDataFrame([], df.schema)
    version = (old[0] if old else 0) + 1
    upsert(now, df, keys, order).write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").json(f"{path}/_current")
    return spark.read.parquet(f"{path}/v{version}")


def json_artifacts(df: DataFrame, path: str, by: str) -> None:
    """JSON lines in a folder for each key."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def csv_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def contract_chunks(won: DataFrame) -> DataFrame:
    """(external_id, text, tags, metadata): what is known of a contract as sentences."""
    say = lambda label, col: F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(col).cast("string")))
    text = F.concat_ws("\n", say("Entidad", "entidad"), say("Proveedor", "empresa"), say("Monto", "monto"), say("Fecha", "fecha"), say("Modalidad", "modalidad"))
    tags = F.array_compact(F.array(F.lit("contrato"), F.lower("modalidad"), F.lower("region")))
    meta = F.create_map(F.lit("ruc"), F.col("ruc"), F.lit("entidad_ruc"), F.col("entidad_ruc"), F.lit("anio"), F.col("anio").cast("string"))
    return won.select("external_id", text.alias("text"), tags.alias("tags"), meta.alias("metadata"))


def save_index(vectors: DataFrame, path: str, model: str, dim: int, chunks: DataFrame | None = None) -> None:
    """Vectors, and the chunks that they stand for, with a manifest of what made them."""
    spark = vectors.sparkSession
    if chunks is not None:
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(model, dim)], "model string, dim int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_index(spark, path: str, model: str, dim: int) -> DataFrame:
    """The vectors; an index of another model or dimension is an error."""
    found = spark.read.schema("model string, dim int").json(f"{path}/manifest").first()
    if (found.model, found.dim) != (model, dim):
        raise ValueError(f"index is of {found.model}/{found.dim}, not {model}/{dim}")
    return spark.read.parquet(f"{path}/vectors")


def load_chunks(spark, path: str) -> DataFrame:
    """The chunks of an index that were saved with it."""
    return spark.read.parquet(f"{path}/chunks")


def document_tables(tables: dict[str, DataFrame], path: str, order: str) -> dict[str, DataFrame]:
    """Idempotent loads of a document store's tables, each by its own key; the latest by ``order`` stays."""
    keys = {"documents": ["document_id"], "pages": ["document_id", "page_number"], "chunks": ["document_id", "chunk_index"], "flags": ["document_id", "flag_code", "page_number", "quote"], "embeddings": ["chunk_id"]}
    return {name: merge_table(df, f"{path}/{name}", keys[name], order) for name, df in tables.items()}


def files(rows: DataFrame, path: str) -> None:
    """A file for each row (name, body) under path, written by the executors through the file system of the path."""
    spark = rows.sparkSession
    staged = f"{path}-staged"
    rows.select(F.expr("replace(name, '/', '~')").alias("name"), "body").write.partitionBy("name").option("compression", "none").text(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(staged)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in fs.listStatus(root):
        if "=" not in folder.getPath().getName():
            continue
        for i, part in enumerate(p for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-")):
            to = hadoop.Path(f"{path}/" + folder.getPath().getName().removeprefix("name=").replace("~", "/"))
            fs.mkdirs(to.getParent())
            fs.rename(part.getPath(), to)
    fs.delete(root, True)


def spreadsheet(df: DataFrame, path: str) -> None:
    """One xlsx file with inline strings for each task's rows, headers first; written as Spark's binary rows cannot be, so by way of ``files``."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    names = df.columns
    table = df.toPandas()  # a sheet holds a bounded number of rows
    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [names, *table.itertuples(index=False)])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/book.xlsx")
    stream = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(to, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
