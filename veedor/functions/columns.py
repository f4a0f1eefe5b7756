"""Column functions that normalise names, keys, amounts and dates.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


def fold(text: Column) -> Column:
    """Latin accents off; the base letters stay."""
    return F.translate(text, ACCENTED, PLAIN)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def ruc(text: Column) -> Column:
    """Eleven digits after all else is taken out; otherwise null."""
    d = digits(text)
    return F.when(F.length(d) == 11, d)


def ruc_or_hash(text: Column, name: Column) -> Column:
    """A valid key, else one made from the name."""
    return F.when(text.rlike("^[0-9]{11}$"), text).otherwise(F.concat(F.lit("hash_"), F.substring(F.md5(F.lower(name)), 1, 16)))


def ruc_is_sane(text: Column) -> Column:
    return F.coalesce(text.rlike("^(10|15|17|20)[0-9]{9}$"), F.lit(False))


def name_key(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.lower(name)), 1, 12))


def amount(text: Column) -> Column:
    """A number from text such as ``S/ 1,234.50`` or ``1234,5``: a lone comma with one or two digits after it is a decimal sign, other commas part thousands."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)S/\.?", ""), r"\s", "")
    return F.when(bare.rlike(r"^-?[0-9]+,[0-9]{1,2}$"), F.regexp_replace(bare, ",", ".")).otherwise(F.regexp_replace(bare, ",", "")).try_cast("double")


DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd")


def date(text: Column, formats=DATE_FORMATS) -> Column:
    """The first format that fits the first ten characters; a time after them is left out."""
    head = F.trim(F.substring_index(text, "T", 1))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(head, F.lit(f))) for f in formats])


def truthy(text: Column) -> Column:
    """Whether text claims something: not empty, and not a way to say no or nothing known."""
    t = F.lower(F.trim(fold(text)))
    return F.coalesce((t != "") & ~t.isin("no", "false", "0", "sin informacion", "ninguno", "none", "null"), F.lit(False))


def coerce(text: Column) -> Column:
    """(kind, number) of a CSV value: null, bool, int, float or str."""
    t = F.trim(text)
    number = t.try_cast("double")
    kind = F.when(t.isNull() | (t == ""), "null").when(F.lower(t).isin("true", "false"), "bool").when(t.rlike("^-?[0-9]+$"), "int").when(t.rlike(r"^-?[0-9]*\.[0-9]+$"), "float").otherwise("str")
    return F.struct(kind.alias("kind"), F.when(kind.isin("int", "float"), number).alias("number"))


def address_hash(text: Column) -> Column:
    return F.md5(text)


def is_generic_address(text: Column) -> Column:
    return F.coalesce(F.upper(text).contains("S/N"), F.lit(False))


def region_code(ubigeo: Column) -> Column:
    return F.substring(ubigeo, 1, 2)


def main_activity(activities: Column) -> Column:
    """The first ``Principal - dddd - NAME`` of an array, as a struct (code, name)."""
    main = F.get(F.filter(activities, lambda a: a.startswith("Principal")), F.lit(0))
    parts = F.split(main, " - ", 3)
    return F.struct(F.get(parts, F.lit(1)).alias("code"), F.get(parts, F.lit(2)).alias("name"))


def workers_range(history: Column, field: str = "workers") -> Column:
    """(least, most) over an array of structs."""
    values = F.transform(history, lambda x: x[field].try_cast("int"))
    return F.struct(F.array_min(values).alias("least"), F.array_max(values).alias("most"))


def mask(identifier: Column) -> Column:
    return F.concat(F.lit("***"), F.right(identifier, F.lit(3)))


def sector(name: Column, words: dict = rules.SECTOR_WORDS, other: str | None = "otros") -> Column:
    """The first sector with a word in the upper-cased name; a word may stand inside another."""
    out, upper = F.lit(other), F.upper(F.coalesce(name, F.lit("")))
    for s, keywords in reversed(list(words.items())):
        found = F.lit(False)
        for k in keywords:
            found = found | upper.contains(k)
        out = F.when(found, F.lit(s)).otherwise(out)
    return out


def sector_by_votes(name: Column, words: dict = rules.SECTOR_WORDS) -> Column:
    """salud if any of its words is in the text, else ambiente if any of its, else null; case does not matter."""
    return sector(name, words, None)


def title_type(title: Column, types: dict = rules.TITLE_TYPES) -> Column:
    t = F.regexp_replace(F.lower(F.trim(title)), r"\s+", " ")
    out = F.lit("otros")
    for kind, patterns in reversed(list(types.items())):
        out = F.when(t.rlike("|".join(patterns)), F.lit(kind)).otherwise(out)
    return out


def title_score(title: Column, points: dict = rules.TITLE_POINTS) -> Column:
    t = F.lower(F.trim(fold(title)))
    return F.greatest(F.lit(0), *[F.when(t.contains(w), p).otherwise(0) for w, p in points.items()])


def file_type(declared: Column, content_type: Column, url: Column) -> Column:
    """Declared type, else the content type's, else the path's ending."""
    of = lambda c: F.when(c.contains("pdf"), "pdf").when(c.contains("word") | c.contains("doc"), "docx").when(c.contains("zip"), "zip")
    ending = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(of(F.lower(declared)), of(F.lower(content_type)), F.when(ending != "", ending), F.lit("unknown"))


def ocid(text: Column) -> Column:
    """The first contracting id in a text, lower-cased, underscores as hyphens."""
    found = F.regexp_extract(F.translate(F.lower(text), "_", "-"), r"ocds-[a-z0-9]{6}-[a-z0-9-]*[a-z0-9]", 0)
    return F.when(found != "", found)


def bucket(score: Column, points: list[tuple[float, str]], lowest: str) -> Column:
    """The label of the highest breakpoint that the score reaches; ``lowest`` below all."""
    out = F.lit(lowest)
    for at, label in sorted(points):
        out = F.when(score >= at, F.lit(label)).otherwise(out)
    return out


#: Score scales by name.
SCALES = {
    "dossier": ([(15, "BAJO"), (30, "MEDIO"), (60, "ALTO"), (100, "CRITICO")], "SIN_SENALES"),
    "activation": ([(75, "ACTIVE")], "INACTIVE"),
}


def cluster(hint: Column, text: Column, catalog: dict = rules.CLUSTERS) -> Column:
    """A section's label from its heading, else from the text's first 200 characters."""

    def label(c: Column) -> Column:
        upper, out = F.upper(fold(c)), F.lit(None).cast("string")
        for name, keywords in reversed(list(catalog.items())):
            found = F.lit(False)
            for k in keywords:
                found = found | upper.contains(k)
            out = F.when(found, F.lit(name)).otherwise(out)
        return out

    return F.coalesce(label(hint), label(F.substring(text, 1, 200)), F.lit("Otros"))


def clean_text(text: Column) -> Column:
    """Words joined over line ends, no blanks before a line end, single blanks, at most one empty line; in this order."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def needs_ocr(text: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def banned_terms(text: Column, terms=tuple(rules.BANNED)) -> Column:
    """The stems that stand at a word's start in the folded text, in their order."""
    t = F.lower(fold(F.coalesce(text, F.lit(""))))
    return F.array_compact(F.array(*[F.when(t.rlike(rf"\b{w}"), F.lit(w)) for w in terms]))


def neutral(text: Column, words: dict = rules.NEUTRAL) -> Column:
    """Whole words with a neutral form replaced by it, longer stems first."""
    out = text
    for w in sorted(words, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?i)\b{w}\b", words[w])
    return out
