"""Sources: contracting releases, registers, catalogues, dossiers, deliveries.  All read through Spark, so any store works."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE = """ocid string, date string, buyer struct<id:string,name:string>,
tender struct<id:string,procurementMethod:string,procurementMethodDetails:string,title:string,description:string,value:struct<amount:double>,documents:array<struct<id:string,title:string,url:string,format:string>>,numberOfTenderers:int,tenderPeriod:struct<startDate:string>>,
awards array<struct<id:string,date:string,status:string,value:struct<amount:double>,suppliers:array<struct<id:string,name:string>>>>,
contracts array<struct<value:struct<amount:double>>>,
parties array<struct<id:string,name:string,roles:array<string>,identifier:struct<id:string,scheme:string>,additionalIdentifiers:array<struct<id:string,scheme:string,legalName:string>>,address:struct<department:string>>>"""

#: Columns of the tax register, in its order.
REGISTER = ["ruc", "razon_social", "estado", "condicion", "ubigeo", "tipo_via", "nombre_via", "codigo_zona", "tipo_zona", "numero", "interior", "lote", "departamento", "manzana", "kilometro"]


def releases(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Releases from JSON lines (gz too) or from files that hold one release, a list, or ``{"releases": [...]}``; malformed lines are dropped."""
    bare = ", ".join(RELEASE.split(",\n"))
    reader = spark.read.schema(f"{bare}, releases array<struct<{_struct(bare)}>>").option("mode", "DROPMALFORMED").option("multiLine", multi_line)
    rows = reader.json(path)
    own = [F.col(n) for n in rows.columns if n != "releases"]
    inside = rows.where("releases is not null").select(F.explode("releases").alias("r")).select("r.*")
    return rows.where("releases is null and ocid is not null").select(*own).unionByName(inside)


def _struct(ddl: str) -> str:
    """A table's DDL as struct fields: a colon after each outer name."""
    out, depth, fresh = [], 0, True
    for ch in ddl:
        if ch == " " and fresh and out and out[-1] not in ", ":
            out.append(":")
            fresh = False
            continue
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fresh = True
        out.append(ch)
    return "".join(out).replace(", ", ",")


def register(spark: SparkSession, path: str, sep: str = "|", encoding: str = "ISO-8859-1", columns: list[str] = REGISTER) -> DataFrame:
    """The tax register: fixed columns, missing fields empty; an archive is opened in the task that has it."""
    schema = ", ".join(f"{n} string" for n in columns)
    if path.endswith(".zip"):
        raw = spark.read.format("binaryFile").load(path).select("content")

        def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            with z.open(name) as f:
                                lines = []
                                for line in io.TextIOWrapper(f, encoding, newline="\n"):
                                    lines.append(line.rstrip("\r\n"))
                                    if len(lines) == 50_000:
                                        yield pd.DataFrame({"value": lines})
                                        lines = []
                                yield pd.DataFrame({"value": lines})

        parts = F.split("value", f"[{sep}]", -1)
        rows = raw.mapInPandas(unzip, "value string").where("trim(value) <> ''")
        rows = rows.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(columns)])
    else:
        rows = spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("quote", "").csv(path)
    return rows.select(*[F.coalesce(F.trim(n), F.lit("")).alias(n) for n in columns]).where("lower(ruc) <> 'ruc'")


def sniff(spark: SparkSession, path: str, candidates: str = ",;|\t") -> str:
    """The separator that the first line has most of."""
    head = spark.read.text(path).limit(1).collect()
    return max(candidates, key=head[0][0].count) if head else candidates[0]


def delimited(spark: SparkSession, path: str, required: tuple[str, ...] = (), **options) -> DataFrame:
    """CSV with a header and a sniffed separator; all columns text.  A missing required column is an error."""
    df = spark.read.options(header=True, sep=sniff(spark, path), **options).csv(path)
    df = df.toDF(*[n.lstrip("﻿").strip() for n in df.columns])
    if missing := [n for n in required if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(dataset, title, resource, format, url) from catalogue search results."""
    schema = "result struct<results:array<struct<name:string,title:string,resources:array<struct<name:string,format:string,url:string>>>>>"
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path).select(F.explode("result.results").alias("d"))
    return rows.select("d.name", "d.title", F.explode_outer("d.resources").alias("r")).select(F.col("name").alias("dataset"), "title", F.col("r.name").alias("resource"), "r.format", "r.url")


def procedures(spark: SparkSession, path: str) -> DataFrame:
    """Procedures from metadata files, one object a file."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", "metadata.json").option("recursiveFileLookup", True).schema("uuid string, nomenclatura string, numero string, codigo string, entidad string, descripcion string, objeto string, cuantia string, fecha_hora string, fecha string, monto string").json(path)


def dossiers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dossiers, flags) from folders of dossier.json and flags.json; a flag's id is its dossier, code and page."""
    read = lambda name, schema: spark.read.option("multiLine", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).schema(schema).json(path)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    d = read("dossier.json", "entity_name string, sector string, total_score int, risk_level string, total_flags int").withColumn("ocid", folder)
    f = read("flags.json", "flag_code string, severity string, score int, page_number int, quote string").withColumn("ocid", folder)
    return d, f.withColumn("flag_id", F.concat_ws("_", "ocid", "flag_code", F.concat(F.lit("p"), F.col("page_number").cast("string"))))


def spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, cells) of the first sheet of xlsx files."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
                    sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
                    rows = []
                    for i, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row")):
                        cells = []
                        for cell in row.iter(f"{ns}c"):
                            v = cell.find(f"{ns}v")
                            inline = "".join(t.text or "" for t in cell.iter(f"{ns}t"))
                            cells.append(inline if v is None else shared[int(v.text)] if cell.get("t") == "s" else v.text)
                        rows.append((name, i, cells))
                yield pd.DataFrame(rows, columns=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row int, cells array<string>")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, page_number, text) of pdf files; the parser is optional and looked for when it is needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz  # optional

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    yield pd.DataFrame([(name, i + 1, p.get_text()) for i, p in enumerate(doc)], columns=["document_id", "page_number", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "document_id string, page_number int, text string")


def jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.limit(limit) if limit else rows


def sources(spark: SparkSession, rows: list[tuple[str, str, str, str]], status: str | None = None, priority: str | None = None) -> DataFrame:
    """The registry of sources (code, kind, priority, status), filtered."""
    df = spark.createDataFrame(rows, "source_code string, source_type string, priority string, status string")
    df = df if status is None else df.where(F.col("status") == status)
    return df if priority is None else df.where(F.col("priority") == priority)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (gz too); lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def table_of(cells: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of spreadsheets (file, row, cells) under their first row's headers, trimmed; a missing cell is empty, a missing column null."""
    first = cells.where("row = 0").select("file", F.transform("cells", lambda x: F.trim(x)).alias("_heads"))
    rows = cells.where("row > 0").join(first, "file")
    value = lambda n: F.when(F.array_position("_heads", n) > 0, F.coalesce(F.trim(F.get("cells", (F.array_position("_heads", n) - 1).cast("int"))), F.lit("")))
    return rows.select(*[value(n).alias(n) for n in columns])


def delivery(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables of a delivery: processes, documents, awards."""
    return {name: delimited(spark, f"{path}/{name}") for name in ("processes", "documents", "awards")}


def listing(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """(dossier, one boolean for each of names): which files each folder has; only names are read, by the executors' listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("dossier"), F.element_at(parts, -1).alias("_file"))
    return rows.groupBy("dossier").agg(*[F.bool_or(F.col("_file") == f).alias(n) for n, f in names.items()])
