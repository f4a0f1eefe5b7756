"""Contracting releases flattened to records, and records mapped to entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c


def party(parties: Column, role: str) -> Column:
    """The first party with a role."""
    return F.get(F.filter(parties, lambda p: F.array_contains(p["roles"], role)), F.lit(0))


def party_ruc(p: Column, scheme: str = "PE-RUC") -> Column:
    """A party's own identifier if it is of the scheme, else the first additional one that is."""
    more = F.get(F.filter(p["additionalIdentifiers"], lambda x: x["scheme"] == scheme), F.lit(0))
    return c.ruc(F.coalesce(F.when(p["identifier"]["scheme"] == scheme, p["identifier"]["id"]), more["id"]))


def flatten(releases: DataFrame) -> DataFrame:
    """One row an award and supplier; an award without suppliers gives one row, a release without awards one of type procedure."""
    none = F.coalesce(F.size("awards"), F.lit(0)) <= 0
    buyer, first = party(F.col("parties"), "buyer"), F.get("contracts", F.lit(0))["value"]["amount"]
    # What a release says once is worked out before its awards are rows, and only that goes with each of them.
    told = {"_entity_name": F.coalesce(F.col("buyer.name"), buyer["name"]), "_entity_ruc": party_ruc(buyer), "_first": first, "_asked": F.col("tender.value.amount"), "_region": F.upper(buyer["address"]["department"]), "_procedure": F.coalesce("tender.procurementMethodDetails", "tender.procurementMethod")}
    base = releases.select("ocid", "date", *[v.alias(k) for k, v in told.items()], F.explode_outer("awards").alias("a"), none.alias("bare"))
    rows = base.select("*", F.explode_outer("a.suppliers").alias("s"))
    supplier = c.ruc(F.col("s.id"))
    return rows.select(
        F.concat_ws(":", "ocid", F.col("a.id"), supplier).alias("external_id"), "ocid", F.when(F.col("bare"), "procedure").otherwise("contract").alias("record_type"),
        F.col("_entity_name").alias("entity_name"), F.col("_entity_ruc").alias("entity_ruc"), F.col("s.name").alias("supplier_name"), supplier.alias("supplier_ruc"),
        F.coalesce(F.col("a.value.amount"), F.col("_first"), F.when(F.col("bare"), F.col("_asked"))).alias("monto"), F.substring(F.coalesce(F.col("a.date"), F.col("date")), 1, 10).alias("fecha"),
        F.substring(F.coalesce(F.col("a.date"), F.col("date")), 1, 4).try_cast("int").alias("period_year"), F.col("_region").alias("region"), F.col("_procedure").alias("procedure_type"),
    )


def case_record(releases: DataFrame, today: str, source: str = "OCDS/OECE") -> DataFrame:
    """One flat case a release: buyer, object, amounts asked and awarded, dates, bidders.

    The first award counts, its amount before the tender's; missing texts are empty, amounts 0, dates ``today``; the
    number of bidders is the stated one unless missing or 0, else that of the award's suppliers, at least one.
    """
    award = F.get("awards", F.lit(0))
    suppliers = F.coalesce(award["suppliers"], F.array().cast("array<struct<id:string,name:string>>"))
    filled = lambda *x: F.coalesce(*[F.when(c != "", c) for c in x], F.lit(""))
    day = lambda x: F.coalesce(F.when(F.substring(x, 1, 10) != "", F.substring(x, 1, 10)), F.lit(today))
    stated = F.when(F.col("tender.numberOfTenderers") != 0, F.col("tender.numberOfTenderers"))
    return releases.select(
        F.coalesce("ocid", F.lit("")).alias("code"), filled(F.col("buyer.name")).alias("entity"), filled(F.col("buyer.id")).alias("entity_id"), filled(F.col("tender.title"), F.col("tender.description")).alias("object"),
        F.coalesce("tender.value.amount", F.lit(0)).cast("double").alias("amount"), F.coalesce(award["value"]["amount"], F.col("tender.value.amount"), F.lit(0)).cast("double").alias("awarded"),
        day(F.col("tender.tenderPeriod.startDate")).alias("called_on"), day(award["date"]).alias("awarded_on"), F.coalesce(stated, F.greatest(F.size(suppliers), F.lit(1))).cast("int").alias("n_bidders"),
        F.filter(F.transform(suppliers, lambda s: s["id"]), lambda x: x != "").alias("bidders"), F.lit(source).alias("source"),
    )


def won_sentence(supplier: Column, entity: Column, amount: Column) -> Column:
    """Who won from whom, and for how much if that is known."""
    filled = lambda x, other: F.coalesce(F.when(x != "", x), F.lit(other))
    much = F.coalesce(F.concat(F.lit(" por "), amount.cast("decimal(38,2)").cast("string")), F.lit(""))
    return F.concat(filled(supplier, "Proveedor no identificado"), F.lit(" gano contrato con "), filled(entity, "entidad no identificada"), much, F.lit("."))


def split(releases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(processes, documents, awards): three projections of releases; document ids are numbered from 0001 in their release."""
    buyer = party(F.col("parties"), "buyer")
    processes = releases.select("ocid", F.col("buyer.name").alias("entity_name"), party_ruc(buyer).alias("entity_ruc"), F.col("tender.id").alias("procedure_code"), "tender.title", c.sector(F.col("buyer.name"), other=None).alias("sector"))
    documents = releases.select("ocid", F.posexplode("tender.documents").alias("i", "d")).select(F.concat_ws("-", "ocid", F.lpad((F.col("i") + 1).cast("string"), 4, "0")).alias("document_id"), "ocid", "d.title", "d.url", c.title_type(F.col("d.title")).alias("document_type"))
    awards = releases.select("ocid", F.explode("awards").alias("a")).select("ocid", F.col("a.id").alias("award_id"), F.explode_outer("a.suppliers").alias("s"), F.col("a.value.amount").alias("amount")).select("ocid", "award_id", c.ruc(F.col("s.id")).alias("supplier_ruc"), F.col("s.name").alias("supplier_name"), "amount")
    return processes, documents, awards


def graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of contract records: buyers and suppliers, and who won from and bought from whom.

    An entity occurs once: its first name in order that is no identifier, its sources as a sorted set.
    """
    side = lambda kind, key, name: F.when(F.col(key).isNotNull(), F.struct(F.lit(kind).alias("entity_type"), F.col(key).alias("canonical_id"), F.col(name).alias("name")))
    sides = F.array_compact(F.array(side("public_entity", "entity_ruc", "entity_name"), side("company", "supplier_ruc", "supplier_name")))
    every = records.select("source_code", F.explode(sides).alias("e")).select("e.*", F.col("source_code").alias("source"))  # both sides of a record in one pass
    real = F.min(F.when(F.col("name").isNotNull() & (F.col("name") != F.col("canonical_id")), F.col("name")))
    entities = every.groupBy("entity_type", "canonical_id").agg(F.coalesce(real, F.col("canonical_id")).alias("display_name"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    both = records.where("entity_ruc is not null and supplier_ruc is not null")
    edge = lambda kind, a, b: both.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("kind"))
    return entities, edge("GANO_CONTRATO", "supplier_ruc", "entity_ruc").unionByName(edge("COMPRO_A", "entity_ruc", "supplier_ruc")).distinct()


def enrich(companies: DataFrame, register: DataFrame) -> DataFrame:
    """Register fields added to companies' metadata maps; what they had stays, and the source is noted."""
    fields = [n for n in register.columns if n != "ruc"]
    added = F.map_filter(F.create_map(*[x for n in fields for x in (F.lit(f"sunat_{n}"), F.col(n))]), lambda k, v: v.isNotNull())
    r = register.select(F.col("ruc").alias("_ruc"), added.alias("_added")).dropDuplicates(["_ruc"])
    j = companies.join(r, F.col("ruc") == F.col("_ruc"), "left")
    meta = F.when(F.col("_added").isNull(), F.col("metadata")).otherwise(F.map_concat(F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys("_added"), k)), F.col("_added")))
    sources = F.when(F.col("_added").isNull(), F.col("sources")).otherwise(F.array_sort(F.array_union("sources", F.array(F.lit("sunat")))))
    return j.withColumns({"metadata": meta, "sources": sources}).drop("_ruc", "_added")


def aliased(rows: DataFrame, aliases: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Fields by any of their headers: headers are compared without accents, case and signs; the first filled one counts."""
    import re
    import unicodedata

    plain = lambda h: re.sub(r"[^a-z0-9]+", "_", unicodedata.normalize("NFKD", h).encode("ascii", "ignore").decode().lower()).strip("_")
    known = {plain(n): n for n in reversed(rows.columns)}
    pick = lambda options: F.coalesce(*[F.nullif(F.trim(rows[f"`{known[o]}`"]), F.lit("")) for o in options if o in known], F.lit(None).cast("string"))
    return rows.select(*keep, *[pick(options).alias(field) for field, options in aliases.items()])
