"""Scalar text functions as column expressions: names, years, dates, places, labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

U, UI = "(?U)", "(?iu)"
YEAR = r"(1[89]\d{2}|20[0-2]\d)"


def _accent_tables() -> tuple[str, str, list[tuple[str, str]]]:
    source, target, several = [], [], []
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if base != c:
            if len(base) == 1:
                source.append(c)
                target.append(base)
            else:
                several.append((c, base))
    for code in (*range(0x370, 0xAC00), *range(0xF900, 0x30000)):  # other scripts: letters that are written as one letter and marks
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        base = "".join(x for x in parts if not unicodedata.category(x).startswith("M"))
        if len(base) == 1 and base != parts and base != c:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target), several


_SOURCE, _TARGET, _SEVERAL = _accent_tables()


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_accents(c: Column) -> Column:
    """Letters without accents; composed letters are mapped, combining marks removed."""
    out = F.regexp_replace(F.translate(c, _SOURCE, _TARGET), r"\p{M}+", "")
    several = out
    for one, letters in _SEVERAL:
        several = F.replace(several, F.lit(one), F.lit(letters))
    return F.when(c.rlike("[" + "".join(one for one, _ in _SEVERAL) + "]"), several).otherwise(out)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal(c: Column) -> Column:
    """Lower case without accents."""
    return strip_accents(F.lower(c))


def normalize_name(c: Column) -> Column:
    """Name for comparison: no death note, parentheses dissolved, letters and blanks only."""
    out = F.regexp_replace(normal(c), r"\(deceased[^)]*\)", "")
    out = F.regexp_replace(out, r"\(([^)]+)\)", "$1")
    return squeeze(F.regexp_replace(out, r"[^a-z\s]", ""))


def title_case(c: Column) -> Column:
    """Capital after every non-letter; ``initcap`` alone knows blanks only."""
    return F.replace(F.initcap(F.regexp_replace(c, r"([,\-.'(])", "$1\u0001 ")), F.lit("\u0001 "), F.lit(""))


def clean_person_name(c: Column) -> Column:
    """Display name: no death note, no parentheses, no accents, title case with small connectors."""
    out = F.regexp_replace(c, r"(?i)\s*\(deceased[^)]*\)", "")
    out = strip_accents(F.regexp_replace(out, r"[()]", ""))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^A-Za-z\s,\-]", " "), r"\s{2,}", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"\s+,", ","), r"^[ ,]+|[ ,]+$", "")
    out = title_case(out)
    for w in rules.NAME_CONNECTORS:
        out = F.regexp_replace(out, rf"\b{w}\b", w.lower())
    return F.coalesce(out, F.lit(""))


def clean_text(c: Column, artifacts: Sequence[str] = rules.TEXT_ARTIFACTS) -> Column:
    for p in artifacts:
        c = F.regexp_replace(c, p, "")
    return F.trim(c)


def strip_fragments(c: Column, pattern: str = rules.SCAN_FRAGMENTS) -> Column:
    """Without leftovers of the page edge, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"(?i){pattern}", " "), r"\s{2,}", " "))


def page_noise(c: Column) -> Column:
    """Whole text without page marks, link lines and running headers; at most one blank line in a row."""
    out = F.regexp_replace(c, r"(?m)^--- PAGE \d+ ---\s*$", "")
    out = F.regexp_replace(out, r"(?m)^\s*https?://\S+\s*$", "")
    out = F.regexp_replace(out, r"(?im)^\s*(the biographies\s+\d+|\d+\s+political biographies)\s*$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def join_broken_words(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def _year(c: Column) -> Column:
    return F.try_to_number(c, F.lit("9999")).cast("int")


def years(c: Column, single: str = "last") -> tuple[Column, Column]:
    """First and last year of an entry: a range of any four digits, else a single year.

    ``single='last'`` takes the last plausible year for both ends; ``'first'`` takes the
    first four-digit number and leaves the end unknown."""
    span = r"(\d{4})\s*[-–]\s*(\d{4})"
    a, b = F.nullif(F.regexp_extract(c, span, 1), F.lit("")), F.nullif(F.regexp_extract(c, span, 2), F.lit(""))
    if single == "first":
        first = F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit(""))
        return _year(F.coalesce(a, first)), _year(b)
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(rf"\b{YEAR}\b"), F.lit(1)), F.lit(-1))
    return _year(F.coalesce(a, last)), _year(F.coalesce(b, last))


def strip_years(c: Column) -> Column:
    """Entry without its years; null if nothing is left."""
    has_span = c.rlike(r"\d{4}\s*[-–]\s*\d{4}")
    out = F.when(has_span, F.regexp_replace(c, r",?\s*\d{4}\s*[-–]\s*\d{4}", "")).otherwise(F.regexp_replace(c, rf",\s*\b{YEAR}\b\s*$", ""))
    out = F.trim(F.regexp_replace(out, r",\s*$", ""))
    return F.nullif(F.trim(F.regexp_replace(out, r"\s{2,}", " ")), F.lit(""))


def repaired_years(start: Column, end: Column, least: int, most: int, century: bool = False) -> tuple[Column, Column]:
    """Years in order and within bounds: optionally an end a century too low is raised first,
    then reversed years are swapped, then a bound that lies outside takes the other year."""
    if century:
        end = F.when((end < start) & (end + 100 >= start) & (end + 100 <= most + 20), end + 100).otherwise(end)
    swap = end < start
    a, b = F.when(swap, end).otherwise(start), F.when(swap, start).otherwise(end)
    low = F.when((a < least) & (b >= least), b).otherwise(a)
    high = F.when((b > most) & (low <= most), low).otherwise(b)
    return low, high


def years_in_post(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(end - start, F.lit(0)))


MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def _dated(s: Column) -> Column:
    t = F.trim(F.regexp_replace(s, r"(?s);.*$", ""))
    t = F.trim(F.regexp_replace(t, r"(?<=\d{4})[.,]?\s+[A-Z][a-z].*$", ""))
    t = F.trim(F.regexp_replace(t, r"(?<=\d{4})[.,]?\s+\d+\s+\w.*$", ""))
    for bad, good in (("Sept", "Sep"), ("June", "Jun"), ("July", "Jul")):
        t = F.regexp_replace(t, rf"\b{bad}\b", good)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[.,]", " "), r"\s{2,}", " "))

    def read(t: Column) -> Column:
        padded = F.regexp_replace(t, r"^([A-Za-z]+) (\d{4})$", "$1 1 $2")
        day = F.when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(t, F.lit("-01-01")))).otherwise(bound(padded, lambda p: F.coalesce(F.try_to_date(p, "MMM d yyyy"), F.try_to_date(p, "MMMM d yyyy"))))
        kind = F.when(t.rlike(r"^\d{4}$"), "year_only").when(t.rlike(r"^[A-Za-z]+ \d{4}$"), "month_year")
        return F.struct(day.alias("date"), kind.alias("kind"))

    return bound(t, read)


def parse_date(c: Column) -> Column:
    """Struct of ``date``, ``precision`` (full, month_year, year_only, decade, unparseable) and ``decade`` of a date as people write it."""

    def classify(s: Column) -> Column:
        is_decade = s.rlike(r"^\d{4}s$")
        junk = s.isNull() | (s == "") | s.rlike(r"\bmp\b") | s.contains("sity of Texas") | ~s.rlike(r"\d")
        none = F.lit(None).cast("date")

        def known(d: Column) -> Column:
            precision = F.coalesce(d["kind"], F.when(d["date"].isNotNull(), F.lit("full")).otherwise(F.lit("unparseable")))
            return F.struct(d["date"].alias("date"), precision.alias("precision"), (F.floor(F.year(d["date"]) / 10).cast("int") * 10).alias("decade"))

        empty = F.struct(none.alias("date"), F.lit("unparseable").alias("precision"), F.lit(None).cast("int").alias("decade"))
        tens = F.struct(none.alias("date"), F.lit("decade").alias("precision"), _year(F.substring(s, 1, 4)).alias("decade"))
        return F.when(junk, empty).when(is_decade, tens).otherwise(bound(_dated(s), known))

    return bound(F.trim(c), classify)


def split_person(c: Column) -> dict[str, Column]:
    """``name_clean``, ``deceased``, ``death_year`` and ``death_date`` of a book-style name."""
    note = F.trim(F.regexp_extract(c, r"(?i)\(Deceased\s*([^)]*)\)", 1))
    date = F.when(note.rlike("[A-Za-z]"), parse_date(note)["date"])
    year = F.when(note.rlike(r"^\d{4}$"), _year(note)).otherwise(F.year(date))
    return {"name_clean": clean_person_name(c), "deceased": F.coalesce(c.rlike(r"(?i)\(Deceased"), F.lit(False)), "death_year": year, "death_date": date}


def cascade(c: Column, labels: Sequence[tuple[str, str]], default: str | None = None, flags: str = UI) -> Column:
    """Label of the first pattern, in order, that is found."""
    out = F.coalesce(*[F.when(c.rlike(flags + p), F.lit(label)) for label, p in labels])
    return out if default is None else F.coalesce(out, F.lit(default))


def cascade_sources(sources: Sequence[Column], labels: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """All patterns on the first source, then all on the next."""
    out = F.coalesce(*[cascade(c, labels) for c in sources])
    return out if default is None else F.coalesce(out, F.lit(default))


def longest_first(entries: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Entries by descending length of the key, ties in the given order."""
    return sorted(entries, key=lambda e: -len(e[0]))


def contained(text: Column, entries: Sequence[tuple[str, str]]) -> Column:
    """Value of the first entry, in order, whose key is a substring.  ``text`` should be bound (see :func:`_bound`)."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in entries])


def _places(t: Column) -> Column:
    named = contained(t, longest_first([(k.lower(), v) for k, v in rules.STATE_VARIANTS]))
    federal = contained(t, [(k, "Federal District") for k in rules.FEDERAL_WORDS])
    return F.coalesce(named, federal, contained(t, longest_first(list(rules.CITY_STATE.items()))))


def state_in_text(c: Column) -> Column:
    """State named in a text: state names longest first, then words of federal offices, then cities."""
    return bound(normal(c), _places)


def state_of_school(c: Column) -> Column:
    return bound(normal(c), lambda t: F.coalesce(contained(t, longest_first(list(rules.INSTITUTION_STATE.items()))), _places(t)))


def state_of_office(c: Column) -> Column:
    """State captured after governor, senator or deputy, legislature or mayor, else as named in the text."""
    states = F.create_map(*[F.lit(x) for k, v in rules.STATE_VARIANTS for x in (k.lower(), v)])
    cities = F.create_map(*[F.lit(x) for k, v in rules.CITY_STATE.items() for x in (k, v)])
    found = [F.try_element_at(states if i < 3 else cities, normal(F.trim(F.regexp_extract(c, p, 1)))) for i, p in enumerate(rules.OFFICE_STATE)]
    return F.coalesce(*found, state_in_text(c))


def tri_state(yes: Column, no: Column) -> Column:
    """True if only ``yes`` holds, False if ``no`` holds, else unknown."""
    return F.when(F.coalesce(yes, F.lit(False)) & ~F.coalesce(no, F.lit(False)), F.lit(True)).when(F.coalesce(no, F.lit(False)), F.lit(False))


def match_tokens(c: Column) -> Column:
    """Tokens of three and more letters without small words, each once."""
    t = F.split(F.trim(F.regexp_replace(normal(c), "[^a-z ]+", " ")), " +")
    return F.array_distinct(F.filter(t, lambda x: (F.length(x) >= 3) & ~x.isin(*rules.NAME_STOPWORDS)))


def title_at_start(c: Column) -> Column:
    """Office title at the start of an entry, before the first comma, ``of`` or ``from``."""
    return F.nullif(title_case(F.trim(F.regexp_extract(c, r"(?i)^\s*([a-z][a-z \-]*?)(?:\s*,|\s+(?:of|from|to)\b|\s*\d|$)", 1))), F.lit(""))


def corrupt_name(c: Column) -> Column:
    """Names that cannot be whole: no comma, no letters, leftovers of a death note or of a page edge."""
    t = F.trim(c)
    return (
        t.isNull() | (t == "") | ~t.contains(",") | t.rlike(r"^[\d(]") | t.rlike(r"\b(mp|es),") | t.rlike(r"\b19\d\d[–-]20\d\d\b") | (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) < 4)
    )


def missing_comma(c: Column) -> Column:
    """A comma after the surnames in parentheses, if the name has none."""
    return F.when(~F.regexp_replace(c, r"\([^)]*\)", "").contains(",") & c.rlike(r"^\S+\s+\([^)]*\)\s+\S"), F.regexp_replace(c, r"^(\S+\s+\([^)]*\))\s+", "$1, ")).otherwise(c)


def death_note(c: Column) -> Column:
    """A bare year in parentheses at the end is a death note."""
    return F.regexp_replace(c, r"\((\d{4})\)\s*$", "(Deceased $1)")
