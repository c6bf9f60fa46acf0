"""Repair of extracted organisations, years and ranks; labels of posts.

Every chain is an ordered list of steps on a column; a step may give null, which ends the
chain for that record.  A step is bound, so that it is computed once however often the next
step reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X

Step = Callable[[Column], Column]
_I = "(?i)"


def through(value: Column, steps: Sequence[Step]) -> Column:
    """A value through ordered steps, each computed once; every step gives null for null."""
    return reduce(X.bound, steps, value)


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _is(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(_I + pattern), F.lit(False))


def _long(c: Column, least: int) -> Column:
    return F.when(F.length(c) >= least, c)


def _ended(c: Column, signs: str = ".,; ") -> Column:
    return F.regexp_replace(c, "[" + signs.replace(" ", "\\s") + "]+$", "")


# ---- organisations ---------------------------------------------------------------------


def secretariat(org: Column) -> Column:
    """One name for every secretariat, others as they are."""
    return F.coalesce(X.cascade(org, rules.SECRETARIAT), org)


def university_in(raw: Column) -> Column:
    """A university named in full, else by its letters."""
    return F.coalesce(_ended(F.trim(_group(raw, _I + rules.UNIVERSITY))), F.trim(_group(raw, _I + rules.UNIVERSITY_SHORT)))


def _without_tail(org: Column) -> Column:
    out = F.trim(F.regexp_replace(org, r",?\s*\d{4}[\s\-–\d]*$", ""))
    return _long(F.trim(F.regexp_replace(out, r"[,\.;:\s]+$", "")), 3)


def _numbered(org: Column, raw: Column) -> Column:
    claimed = org.rlike(r"(?i)^National Preparatory School No\.")
    number = _group(raw, r"(?i)National Preparatory School\s+No\.?\s*(\d+)")
    other = _group(raw, r"(?i)Preparatory School\s+No\.?\s*(\d+)")
    plain = F.lit("National Preparatory School")
    meant = F.when(number.isNotNull(), F.concat(plain, F.lit(" No. "), number)).when(raw.rlike(r"(?i)National Preparatory School(?!\s+No)"), plain).when(other.isNotNull(), F.concat(F.lit("Preparatory School No. "), other)).otherwise(plain)
    return F.when(claimed, meant).otherwise(org)


def _number_restored(org: Column, raw: Column) -> Column:
    stem = F.trim(_group(F.trim(org), _I + rules.SCHOOL_STEM))
    pattern = F.concat(F.lit("(?i)\\Q"), stem, F.lit("\\E\\s+No\\.?\\s*(\\d+)"))
    number = F.nullif(F.call_function("regexp_extract", raw, pattern, F.lit(1)), F.lit(""))
    return F.coalesce(F.concat(stem, F.lit(" No. "), number), org)


def school_repaired(org: Column, raw: Column) -> Column:
    """A school through ten ordered repairs with the entry it was read from; a numbered school is read again where nothing is left."""
    raw = F.coalesce(raw, F.lit(""))

    def context(c: Column) -> Column:
        out = _ended(F.trim(F.regexp_replace(c, _I + rules.SCHOOL_CONTEXT, "")))
        return F.when(~out.rlike(r"(?i)^\d+(?:st|nd|rd|th)\b"), _long(out, 3))

    def campus(c: Column) -> Column:
        place = _group(raw, _I + rules.CAMPUS)
        base = F.lit("Autonomous Metropolitan University")
        return F.when(_is(c, rules.METROPOLITAN), F.when(place.isNotNull(), F.concat(base, F.lit(", "), place, F.lit(" Campus"))).otherwise(base)).otherwise(c)

    steps: list[Step] = [
        lambda c: _long(_ended(F.trim(F.regexp_replace(F.regexp_replace(c, _I + rules.SCAN_HEADER, ""), r"\s{2,}", " "))), 3),
        context,
        _without_tail,
        lambda c: _numbered(c, raw),
        lambda c: _number_restored(c, raw),
        lambda c: F.when(~F.lower(F.trim(c)).isin(*rules.PLACES), c),
        lambda c: F.when(_is(F.trim(c), rules.SCHOOL_OF), F.coalesce(university_in(raw), c)).otherwise(c),
        lambda c: F.when(_is(c, r"\bUniversity\b") & _is(c, rules.SCHOOL_BROKEN), F.coalesce(university_in(raw), c)).otherwise(c),
        campus,
        _without_tail,
    ]
    again = F.coalesce(_ended(F.trim(_group(raw, _I + rules.NUMBERED_SCHOOL)), "., "), F.trim(_group(raw, r"(?i)(\bSecondary\s+No\.?\s*\d+\b)")))
    return F.coalesce(through(org, steps), again)


def school_state(state: Column, raw: Column) -> Column:
    """Known state, else that of a town named in an entry without a foreign context."""
    towns = X.longest_first(list(rules.SCHOOL_TOWN_STATE.items()))
    found = X.bound(F.lower(raw), lambda t: X.contained(t, towns))
    return F.coalesce(state, F.when(~_is(raw, rules.FOREIGN_CONTEXT), found))


def _years_off(c: Column) -> Column:
    out = F.regexp_replace(c, r",?\s*\d{4}\s*[-–]\s*\d{4}", "")
    out = F.regexp_replace(out, rf",\s*\b{X.YEAR}\b\s*$", "")
    return F.trim(F.regexp_replace(out, r"[,\s]+$", ""))


def _is_place(c: Column) -> Column:
    names = sorted({k.lower() for k, _ in rules.STATE_VARIANTS} | {"federal district", "mexico city"} | set(rules.CITY_STATE))
    return F.coalesce(X.normal(F.trim(c)).isin(*names), F.lit(False))


def office_repaired(org: Column, answered: Column, raw: Column) -> Column:
    """The organisation of a government post: a place nobody wrote is dropped, a role word or a place is read again
    from the entry, and an empty one is read from what follows the title."""
    raw = F.coalesce(raw, F.lit(""))

    def unwritten(c: Column) -> Column:
        return F.when(~(answered.isNotNull() & _is_place(c) & ~F.contains(X.normal(raw), X.normal(c))), c)

    def role_word(c: Column) -> Column:
        pattern = F.concat(F.lit("(?is)\\bof\\s+\\Q"), F.trim(c), F.lit("\\E\\s*,\\s*(.+?)(?=,\\s*\\d{4}|\\s*$)"))
        meant = _years_off(_ended(F.trim(F.nullif(F.call_function("regexp_extract", raw, pattern, F.lit(1)), F.lit("")))))
        return F.when(F.lower(F.trim(c)).isin(*rules.ROLE_WORDS), F.when((F.length(meant) >= 4) & ~meant.rlike(r"^\d{4}$") & ~_is_place(meant), meant)).otherwise(c)

    def place(c: Column) -> Column:
        at = F.instr(X.normal(raw), X.normal(F.trim(c)))  # 0: not in the entry
        before = F.substr(raw, F.lit(1), at - 1)
        whole = _ended(F.rtrim(before), ", ")
        inner = F.when(F.instr(whole, ",") > 1, _years_off(_ended(F.trim(F.substr(whole, F.instr(whole, F.lit(",")) + 1)))))
        after = F.when(F.instr(raw, ",") > 1, _years_off(_ended(F.trim(F.substr(raw, F.instr(raw, F.lit(",")) + 1)))))
        own = F.when(F.trim(F.substr(raw, at - 2, F.lit(2))) == ",", _long(inner, 4)).otherwise(F.coalesce(_long(after, 4), c))
        return F.when(_is_place(c) & (at > 1) & _is(before, rules.INSTITUTION_WORD), own).otherwise(c)

    steps: list[Step] = [lambda c: _long(F.regexp_replace(_ended(F.trim(F.regexp_replace(c, _I + r"\d{2,}\s+mexican\s+political\s+biograph\w*\s*", ""))), r"\s{2,}", " "), 3), unwritten, role_word, place]
    return F.coalesce(through(org, steps), organization_after_title(raw))


def organization_after_title(raw: Column) -> Column:
    """What follows the title of an entry, without years and places at its end, if it reads like an organisation."""
    rest = _ended(F.trim(_years_off(F.substr(raw, F.instr(raw, F.lit(",")) + 1))))
    parts = F.filter(F.transform(F.split(rest, ","), F.trim), lambda p: p != "")
    # drop trailing places: keep up to the last part that is none
    keep = F.size(parts) - F.coalesce(F.array_position(F.transform(F.reverse(parts), lambda p: ~_is_place(p)), True), F.lit(0)) + 1
    some = F.exists(parts, lambda p: ~_is_place(p))
    found = _ended(F.trim(F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0)).cast("int")), ", ")))
    return F.when(raw.contains(",") & some, X.bound(found, lambda c: F.when((F.length(c) >= 4) & ~_is_place(c) & _is(c, rules.INSTITUTION_SIGNAL), c)))


def best_entity(entities: Column, known: str = rules.FOREIGN_SCHOOL) -> Column:
    """Of entities ``struct<text, label>`` in order: the first institution, else the first organisation, else the
    first place that is a known school; short ones and titles do not count."""
    e = F.filter(F.transform(entities, lambda x: F.struct(F.trim(x["text"]).alias("text"), x["label"].alias("label"))), lambda x: (F.length(x["text"]) >= 4) & ~F.lower(x["text"]).isin(*rules.ENTITY_STOP))
    first = lambda keep: F.try_element_at(F.filter(e, keep), F.lit(1))["text"]
    is_org = lambda x: x["label"] == "ORG"
    return F.coalesce(first(lambda x: is_org(x) & _is(x["text"], rules.ENTITY_INSTITUTION)), first(is_org), first(lambda x: (x["label"] == "GPE") & _is(x["text"], known)))


def title_or_keyword(text: Column) -> Column:
    """Title at the start of an entry, else a title given by its letters."""
    short = F.upper(_group(text, r"(?i)\b(ceo|cfo|cto|coo)\b"))
    return F.coalesce(X.title_at_start(text), short)


# ---- years and degrees ----------------------------------------------------------------


def cleaned_entry(raw: Column, pattern: str = rules.SCAN_FRAGMENTS_ALL) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, _I + pattern, " "), r"\s{2,}", " "))


def education_years(raw: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Years of an education entry, read again where cleaning changed it, where they are reversed or before 1880;
    titles of theses and years of past events do not count."""
    raw = F.coalesce(raw, F.lit(""))
    clean = cleaned_entry(raw)
    bare = F.regexp_replace(F.regexp_replace(clean, _I + rules.THESIS, ""), _I + rules.PAST_YEAR, "")
    a, b = X.years(bare)
    again = (clean != raw) | F.coalesce(end < start, F.lit(False)) | F.coalesce((start < 1880) & ~F.coalesce(end < start, F.lit(False)), F.lit(False))
    return F.when(again, a).otherwise(start), F.when(again, b).otherwise(end)


def public_years(start: Column, end: Column) -> tuple[Column, Column]:
    """An end a century too low is raised (2012 read as 1912), other reversed years are swapped."""
    low = (start >= 2000) & (end < 1950)
    swap = (end < start) & ~low
    return F.when(swap, end).otherwise(start), F.when(low, end + 100).when(swap, start).otherwise(end)


def other_years(start: Column, end: Column, least: int = 1850, most: int = 2009) -> tuple[Column, Column]:
    """The same; then a year out of bounds takes the other one, a start only if that lies within.  A raised end stays as it is."""
    low = F.coalesce((start >= 2000) & (end < 1950), F.lit(False))
    a, b = public_years(start, end)
    first = F.when(a.between(least, most) | a.isNull(), a).when(b.between(least, most), b)
    last = F.when(b.between(least, most) | b.isNull(), b).otherwise(first)
    return F.when(low, start).otherwise(first), F.when(low, end + 100).otherwise(last)


def degree_field(field: Column, text: Column) -> Column:
    """Business that is political science, and urbanism that is architecture."""
    return F.when((field == "business") & _is(text, rules.POLITICAL_FIELD), "political_sci").when((field == "other") & _is(text, rules.URBAN_FIELD), "architecture").otherwise(field)


def degree_abroad(known: Column, text: Column, org: Column) -> Column:
    """Known foreign degrees, and those of a school abroad unless one at home is named beside it."""
    both = F.concat_ws(" ", text, org)
    abroad = _is(both, rules.FOREIGN_SCHOOL)
    return F.when(F.coalesce(known, F.lit(False)), True).when(abroad & ~(F.coalesce(~known, F.lit(False)) & _is(both, rules.HOME_SCHOOL)), True).otherwise(known)


# ---- parties -----------------------------------------------------------------------------


def party_rank(text: Column, body: Column, level: Column) -> Column:
    """Rank of a party post by its text, the body it belongs to and its level."""
    t, none = text, F.lit(False)
    national = F.coalesce(level == "national", none) | F.coalesce(body.isin(*rules.NATIONAL_BODIES), none)
    state = F.coalesce(level.isin("state", "local"), none) | F.coalesce(body.isin(*rules.STATE_BODIES, *rules.LOCAL_BODIES), none)
    secretary = _is(t, rules.SECRETARY_OF)
    return (
        F.when(t.isNull(), "other")
        .when(_is(t, rules.PRESIDENT), F.when(F.coalesce(body == "CEN", none), "cen_president").when(national, "national_president").otherwise("state_president"))
        .when(_is(t, rules.SECRETARY_GENERAL), F.when(national, "secretary_general_nat").otherwise("state_secretary_general"))
        .when(_is(t, rules.IEPES_DIRECTOR), "iepes_director")
        .when(_is(t, r"\bCEN\b"), F.when(_is(t, rules.CEN_DELEGATE), "national_delegate").when(secretary, "cen_secretary").otherwise("cen_member"))
        .when(national & secretary, "cen_secretary").when(_is(t, rules.CAMPAIGN_LEADER), "campaign_leader").when(national & _is(t, r"\bdelegate\b"), "national_delegate")
        .when(state & secretary, "state_secretary").when(_is(t, rules.ADVISER_MEMBER), "adviser_member").when(_is(t, r"\bcampaign\b"), "campaign_participant")
        .when(_is(t, rules.PARTY_RECORD[0][1]), "joined").otherwise("other")
    )


def party_rank_repaired(rank: Column, kind: Column, level: Column, text: Column) -> Column:
    """Ranks that the first pass left as other, and candidates for the party's presidency."""
    other = rank == "other"
    out = F.when(other & (kind == "candidate"), "candidate").when(other & _is(text, rules.ADVISER), "adviser_member")
    out = out.when(other & F.coalesce(level == "state", F.lit(False)) & _is(F.trim(text), rules.STATE_DIRECTOR), "state_president").when(other & _is(text, rules.CAMPAIGN_COORDINATOR), "campaign_leader").otherwise(rank)
    return F.when(_is(text, rules.CEN_CANDIDATE), "cen_president").otherwise(out)


def local_towns() -> str:
    """Pattern of the towns whose name makes a party post local."""
    towns = {c for c in rules.CITY_STATE if c not in rules.NOT_LOCAL} | set(rules.MORE_LOCAL)
    return r"\b(" + "|".join(sorted(towns, key=lambda t: (-len(t), t))) + r")\b"


def party_level_repaired(level: Column, state: Column, rank: Column, text: Column) -> Column:
    """A state level without a state is unknown, with a town it is local; an unknown one is filled from rank, text and state."""
    kept = F.when((level == "state") & state.isNull(), F.lit(None)).when((level == "state") & _is(text, local_towns()), "local").otherwise(level)
    filled = F.when(rank.isin("state_president", "state_secretary", "state_secretary_general"), "state").when(_is(text, rules.NATIONAL_BODY), "national").when(_is(text, local_towns()), "local").when(state.isNotNull(), "state")
    return F.coalesce(kept, filled)


def minor_party(party: Column, org: Column, text: Column) -> Column:
    named = F.coalesce(*[F.upper(_group(c, _I + rules.MINOR_PARTY)) for c in (org, text)])
    return F.coalesce(party, named, F.when(_is(text, rules.PARTY_PP), "PP"))


# ---- labels of posts -------------------------------------------------------------------


def _weight(label: Column, table: dict[str, int], default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), label), F.lit(default))


def post_label(rank: Column, institution: Column, text: Column) -> Column:
    """``Rank, institution``; without an institution the entry itself, without an entry the rank."""
    title = F.initcap(F.replace(rank, F.lit("_"), F.lit(" ")))
    own = F.nullif(F.trim(text), F.lit(""))
    return F.coalesce(F.concat(title, F.lit(", "), institution), F.concat(F.upper(F.substring(own, 1, 1)), F.substr(own, F.lit(2))), title)


def post_weight(rank: Column) -> Column:
    return _weight(rank, rules.POST_WEIGHT, 1)


def office_label(title: Column, state: Column) -> Column:
    """``Title (state)`` of an elected office."""
    return F.concat(F.coalesce(title, F.lit("Elected office")), F.coalesce(F.concat(F.lit(" ("), F.nullif(state, F.lit("")), F.lit(")")), F.lit("")))


def office_weight(title: Column) -> Column:
    return _weight(F.coalesce(title, F.lit("Elected office")), rules.OFFICE_WEIGHT, 2)


# ---- pages -------------------------------------------------------------------------------


def pages_joined(halves: DataFrame, first: int, last: int) -> DataFrame:
    """``page, text`` of a range of pages from ``page, side, text`` halves: left before right with a blank line,
    a mark before every page, empty pages left out."""
    h = halves.where(F.col("page").between(first, last) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    joined = h.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("side") != "left").alias("o"), F.trim("text").alias("t")))), lambda x: x["t"]), "\n\n").alias("t"))
    return joined.select("page", F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("t")).alias("text"))


def without_footer(text: Column, begin: str, end: str) -> Column:
    """Without the shortest stretches, over lines too, from one pattern to another."""
    return F.regexp_replace(text, f"(?is){begin}.*?{end}", "")
