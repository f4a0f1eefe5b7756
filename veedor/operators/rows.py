"""Rows of portals and open data, case detectors, public-text checks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules


def _picked(rows: DataFrame, aliases: dict[str, list[str]]) -> dict[str, Column]:
    """Fields by any of their headers, compared by letters and digits in lower case; the first filled one counts."""
    plain = lambda h: "".join(ch for ch in h.lower() if ch.isalnum())
    known = {plain(n): n for n in rows.columns}
    pick = lambda names: F.coalesce(*[F.when(rows[f"`{known[plain(n)]}`"] != "", F.trim(rows[f"`{known[plain(n)]}`"])) for n in names if plain(n) in known], F.lit(None).cast("string"))
    return {field: pick(names) for field, names in aliases.items()}


def ruc11(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 11, digits)


def money(text: Column) -> Column:
    """A number: with both signs the comma parts thousands, else it is the decimal sign."""
    plain = F.regexp_replace(text, "S/| ", "")
    both = plain.contains(",") & plain.contains(".")
    return F.when(both, F.regexp_replace(plain, ",", "")).otherwise(F.regexp_replace(plain, ",", ".")).try_cast("double")


def day(text: Column) -> Column:
    """A date at the text's start, year or day first."""
    head = F.substring(F.trim(text), 1, 10)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(head, F.lit(f))) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")])


def open_data(rows: DataFrame, category: str, keep: list[str]) -> DataFrame:
    """Rows of one category of open data, all columns text: keys and fields by any header, record type, external id, year and risk hints."""
    f = _picked(rows, rules.OPEN_DATA)
    hay = F.lower(F.concat_ws(" ", *[rows[f"`{n}`"] for n in rows.columns if n not in keep]))
    hints = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [hay.contains(w) for w in words]), F.lit(name)) for name, words in rules.RISK_HINTS.items()]))
    date, supplier = day(f["fecha"]), ruc11(f["supplier_ruc"])
    own = F.concat_ws(":", F.lit(category), F.coalesce(f["codigo_proceso"], f["explicit"]), supplier, f["miembro_comite"])
    year = F.coalesce(F.year(date), F.substring(f["anio"], 1, 4).try_cast("int"))
    text = [n for n in ("codigo_proceso", "tipo_proceso", "objeto", "contrato", "orden_compra", "comite", "miembro_comite", "cargo_comite", "consorcio", "entity_name", "supplier_name", "region")]
    return rows.select(
        *keep, F.lit(category).alias("category"), F.lit(rules.RECORD_TYPES.get(category, category)).alias("record_type"), own.alias("external_id"), *[f[n].alias(n) for n in text],
        ruc11(f["entity_ruc"]).alias("entity_ruc"), supplier.alias("supplier_ruc"), money(f["monto"]).alias("monto"), date.alias("fecha"), year.alias("period_year"), F.array_join(hints, ",").alias("risk_hints"),
    )


def portal(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of the tender portal's export, all columns text."""
    f = _picked(rows, rules.PORTAL)
    date = day(f["fecha"])
    return rows.select(
        *keep, F.lit("contract").alias("record_type"), *[f[n].alias(n) for n in ("external_id", "entity_name", "supplier_name", "region", "modalidad", "objeto")],
        ruc11(f["entity_ruc"]).alias("entity_ruc"), ruc11(f["supplier_ruc"]).alias("supplier_ruc"), money(f["monto"]).alias("monto"), date.alias("fecha"), F.year(date).alias("period_year"),
    )


def html_rows(pages: DataFrame, html: Column, keep: list[str], since: str) -> DataFrame:
    """Table rows of at least five cells: code, buyer, subject, amount, date and bidders; rows dated before ``since`` are left out.

    The code is the first cell with a digit and a hyphen, the amount the last one with thousands, the date the first d/m/20yy.
    """
    cell_text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    trs = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("place", "tr"))
    rows = trs.withColumn("cells", F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), cell_text)).where(F.size("cells") >= 5)
    line = F.array_join("cells", " | ")
    amounts = F.regexp_extract_all(line, F.lit(r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?)"), 1)
    amount = F.when(F.size(amounts) > 0, F.regexp_replace(F.element_at(amounts, -1), ",", "").cast("double")).otherwise(0.0)
    date = F.to_date(F.try_to_timestamp(F.regexp_extract(line, r"\b([0-3]?\d/[01]?\d/20\d{2})\b", 1), F.lit("d/M/yyyy")))
    code = F.get(F.filter("cells", lambda x: x.rlike("[0-9]") & x.contains("-")), F.lit(0))
    out = rows.select(
        *keep, "place", code.alias("codigo"), F.get("cells", F.lit(0)).alias("entidad"), F.get("cells", F.lit(2)).alias("objeto"), amount.alias("monto"), date.alias("fecha"),
        F.when(F.lower(line).contains("adjudicado"), 1).otherwise(2).alias("numero_postores"),
    )
    return out.where(F.col("fecha").isNull() | (F.col("fecha") >= F.lit(since).cast("date")))


def phase1_sector(name: Column, title: Column, words: dict = rules.PHASE1_WORDS) -> Column:
    """The first-phase sector: health wins where both have a word; null where none has."""
    hay = F.regexp_replace(F.trim(F.lower(F.concat_ws(" ", name, title))), r"\s+", " ")
    has = lambda k: reduce(lambda a, b: a | b, [hay.contains(w.lower()) for w in words[k]])
    return F.when(has("salud"), "salud").when(has("ambiente"), "ambiente")


# -- detectors of cases

def single_bidder(cases: DataFrame, days: dict = rules.SECTOR_DAYS, other: int = rules.OTHER_DAYS, share: float = 0.5) -> DataFrame:
    """Cases (case_id, entidad, numero_postores, convocatoria, adjudicacion) with one bidder and a process of under half the sector's days."""
    mean = reduce(lambda out, kv: F.when(F.upper("entidad").contains(kv[0]), kv[1]).otherwise(out), reversed(list(days.items())), F.lit(other))
    took = F.greatest(F.datediff("adjudicacion", "convocatoria"), F.lit(1))
    rows = cases.select("case_id", took.alias("dias_proceso"), mean.alias("promedio_sector"), "numero_postores")
    return rows.where((F.col("numero_postores") == 1) & (F.col("dias_proceso") < share * F.col("promedio_sector"))).select("case_id", "dias_proceso", "promedio_sector")


def split_awards(won: DataFrame, days: int = 30, least: int = 2, amount: float = rules.TENDER_AMOUNT, buyer: str = "entidad_ruc") -> DataFrame:
    """Contracts of a supplier and buyer that with those of the ``days`` before are ``least`` or more and over ``amount``: a range window."""
    day_ = F.datediff("fecha", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy("ruc", buyer).orderBy("day").rangeBetween(-days, 0)
    rows = won.withColumn("day", day_).withColumns({"num_contratos": F.count("*").over(w), "monto_total": F.sum("monto").over(w)})
    return rows.where((F.col("num_contratos") >= least) & (F.col("monto_total") > amount)).select("ruc", buyer, "external_id", "num_contratos", "monto_total")


def sanctioned_officials(people: DataFrame, sanctions: DataFrame, today: str) -> DataFrame:
    """(case_id, masked): cases of which an official or signer (case_id, person_id) has a sanction (person_id, vigencia, hasta) in force."""
    state = F.upper(F.coalesce("vigencia", F.lit("")))
    live = sanctions.where(state.contains("VIGENTE") | state.contains("ACTIVA") | (F.col("hasta") >= F.lit(today).cast("date"))).select("person_id").distinct()
    masked = F.concat(F.substring("person_id", 1, 2), F.lit("***"), F.substring("person_id", -2, 2))
    return people.join(live, "person_id", "left_semi").select("case_id", masked.alias("masked")).distinct()


def public_check(text: Column, words=tuple(rules.FORBIDDEN), suggested: dict = rules.SUGGESTED) -> Column:
    """struct(ok, matches, suggestion, risk) of a public text: substrings in lower case; three or more make the risk high."""
    low = F.lower(text)
    matches = F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    neutral = reduce(lambda t, kv: F.regexp_replace(t, f"(?iu){re.escape(kv[0])}", kv[1]), suggested.items(), text)
    n = F.size(matches)
    return F.struct((n == 0).alias("ok"), matches.alias("matches"), F.when(n > 0, neutral).alias("suggestion"), F.when(n == 0, "bajo").when(n >= 3, "alto").otherwise("medio").alias("risk"))


def change_run(contracts: DataFrame, changes: DataFrame, documents: DataFrame, flags: DataFrame, sectors: list[str]) -> DataFrame:
    """(external_id, status): each contract of a run, from change to dossier.

    contracts (external_id, sector); changes (external_id, change: new or modified); documents (external_id, document_id,
    kind, usable: has a text layer, failed: could not be fetched, points) of which the best by points is taken; flags (document_id).
    """
    best = W.partitionBy("external_id").orderBy(F.desc("points"), "document_id")
    chosen = documents.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    counted = flags.groupBy("document_id").agg(F.count("*").alias("n_flags"))
    j = contracts.join(changes, "external_id", "left").join(chosen, "external_id", "left").join(counted, "document_id", "left")
    status = (
        F.when(F.col("change").isNull(), "skipped_no_change").when(~F.col("sector").isin(*sectors) | F.col("sector").isNull(), "skipped_sector")
        .when(F.col("document_id").isNull(), "no_tdr_url").when(F.col("failed"), "download_error").when(F.col("kind") != "pdf", "not_pdf_archive_pending")
        .when(~F.col("usable"), "needs_ocr").when(F.col("n_flags").isNull(), "no_flags_detected").otherwise("dossier_generated")
    )
    return j.select("external_id", "change", status.alias("status"))


def run_counters(run: DataFrame) -> DataFrame:
    """One row of counters of ``change_run``."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    found = ("download_error", "not_pdf_archive_pending", "needs_ocr", "no_flags_detected", "dossier_generated")
    return run.agg(
        F.count("*").alias("total_evaluated"), F.count_if(F.col("change") == "new").alias("new_contracts"), F.count_if(F.col("change") == "modified").alias("modified_contracts"), n("no_tdr_url", *found).alias("priority_contracts"),
        n("skipped_sector").alias("skipped_sector"), n("skipped_no_change").alias("skipped_no_change"), n(*found).alias("tdrs_url_found"), n("no_tdr_url").alias("tdrs_url_not_found"),
        n("download_error").alias("tdrs_download_failed"), n("not_pdf_archive_pending").alias("tdrs_not_pdf"), n("needs_ocr").alias("tdrs_needs_ocr"), n("dossier_generated").alias("dossiers_generated"),
    )
