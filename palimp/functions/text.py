"""Column functions on text. Patterns carry (?U) where blanks and digits are meant in the Unicode sense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The canonical order of sections.
SECTION_ORDER = ("I", "II", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "III")
#: Accented capitals and their bare letters.
ACCENTED, BARE = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAAEEEEIIIIOOOOOUUUUCN"


def squeezed(c: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))


def masked(c: Column) -> Column:
    """Runs of digits become #."""
    return F.regexp_replace(c, r"(?U)\d+", "#")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def day(c: Column) -> Column:
    """The day as it is written in an ISO date with offset, without a shift between zones; empty for null."""
    return F.coalesce(F.substring(c, 1, 10), F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def slug(*cols: Column) -> Column:
    return F.concat_ws("-", *cols)


def anchor(kind: Column, section: Column, document: Column, main: Column) -> Column:
    """The id of a section's place on a page; only the main one is without the document's number."""
    base = F.concat(F.lit("sec-"), kind, F.lit("-"), section)
    return F.when(main, base).otherwise(F.concat(base, F.lit("-d"), document.cast("string")))


def company_number(c: Column) -> Column:
    """14 digits as 00.000.000/0000-00; shorter ones are filled with zeros, longer ones are left as they are."""
    x = F.when(F.length(c) < 14, F.lpad(c, 14, "0")).otherwise(c)
    cut = lambda a, n: F.substring(x, a, n)
    return F.when(F.length(x) == 14, F.concat(cut(1, 2), F.lit("."), cut(3, 3), F.lit("."), cut(6, 3), F.lit("/"), cut(9, 4), F.lit("-"), cut(13, 2))).otherwise(x)


def initial(c: Column) -> Column:
    """The first letter, a capital without accent; 0-9 for anything else."""
    letter = F.translate(F.upper(F.substring(F.trim(c), 1, 1)), ACCENTED, BARE)
    return F.when(letter.rlike("^[A-Z]$"), letter).otherwise("0-9")


def escaped(c: Column) -> Column:
    """Text for HTML, quotes included."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def section_rank(c: Column) -> Column:
    """Place in the canonical order; unknown sections come after all known ones."""
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), c)
    return F.when(place > 0, place).otherwise(len(SECTION_ORDER) + 1)


def in_order(sections: Column) -> Column:
    """Distinct sections in the canonical order, unknown ones by name."""
    ranked = F.array_sort(F.transform(F.array_distinct(sections), lambda s: F.struct(section_rank(s).alias("r"), s.alias("s"))))
    return F.transform(ranked, lambda x: x["s"])


def label(identification: Column, preamble: Column) -> Column:
    """A short name of a presentation: what follows the presentations heading, up to the use or composition, in 70 signs."""
    whole = F.coalesce(F.nullif(identification, F.lit("")), preamble, F.lit(""))
    mark = "APRESENTAÇÕES"
    at = F.instr(whole, mark)
    rest = F.when(at > 0, F.substr(whole, at + len(mark))).otherwise(whole)
    head = F.get(F.split(rest, r"(?U)\b(?:USO |COMPOSIÇÃO)", 2), F.lit(0))
    short = F.btrim(squeezed(head), F.lit(" :.-"))
    cut = F.substring(short, 1, 70)
    back = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(short) > 70, F.concat(F.rtrim(back, F.lit(" ,;:(-")), F.lit("…"))).otherwise(short)


def declared_sections(items: Column) -> Column:
    """Section ids named in a free text, in order, each once."""
    found = F.regexp_extract_all(items, F.lit(r"(?iU)(\b\d{1,2}\s*[.)]|\b(?:III|II|I)\s*[-–]|DIZERES LEGAIS)"), F.lit(1))
    ids = F.transform(found, lambda x: F.when(x.rlike(r"^\d"), F.regexp_extract(x, r"^(\d{1,2})", 1)).when(F.upper(x).startswith("DIZ"), F.lit("III")).otherwise(F.upper(F.regexp_extract(x, r"(?i)^(I+)", 1))))
    return F.array_distinct(ids)


def tokens(c: Column) -> Column:
    """Paragraph breaks and words, in order."""
    return F.regexp_extract_all(c, F.lit("(?U)(\n\n|\\S+)"), F.lit(1))
