"""Cleaning steps: extraction with fall-through, repairs only where something changed, inferred fields.

Every step is one column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X

# Patterns of the cleaning steps.
ACRONYM = r"\b(CTM|SNTE|CNC|CNOP|FSTSE|CROC|CROM|STPRM|STFRM|SUTERM|COPARMEX|UOI|CTC|STIMAHCS|SUTGDF|CONASUPO|IMSS|ISSSTE|CFE|IPN|UNAM)\b"
LOCAL_UNION = r"Local\s+No\.?\s*\d+\s*,\s*((?:Union|Sindicato|Federation)[^,;]{3,60})"
BODY_NAME = r"\b((?:Union|Federation|Confederation|Confederacion|Federacion|Association|League|Liga|Chamber|College|Council|Alliance|Institute|Society|Cooperative|Syndicate|Sindicato|Committee)\s+(?:of\s+(?:the\s+)?)?[A-Za-z][A-Za-z\s\-]{2,60})"
# What an extracted name ends before, and what is no name.
TRAILING = r"\s+(?:at|in|to|from|under|as|during|until|delegate|adviser|assistant|representative|coordinator|liaison|committees?)\b.*$"
SERVICES = r"^(?:medical|health|clinical|surgical|dental|coordinated\s+medical|health\s+and\s+medical|public\s+health)\s+services?$"
DEPARTMENT = r"\b(Department\s+of\s+[A-Za-z][^,;0-9]{2,60})"
TOP_DEPARTMENT = r"^Department of (the Federal District|Agrarian Affairs|Tourism)"
# Titles of public posts, first match.
TITLE_FILL = [
    ("Senator", r"\b(?:plurinominal|alternate|party|constitutional|independent)\s+(?:federal\s+)?senator\b"),
    ("Federal Deputy", r"\b(?:plurinominal|alternate|party|constitutional|independent|federal)\s+(?:federal\s+)?deputy\b"),
    ("Deputy", r"\bdeputy\s+to\s+(?:the\s+)?constitutional\s+convention\b"),
    ("Deputy", r"\bdeputy,?\s+constitutional\s+convention\b"),
    ("Deputy", r"\bconstitutional\s+deputy\b"),
    ("Federal Deputy", r"\bfederal\s+party\s+deputy\b"),
    ("Federal Deputy", r"\balternate\s+(?:federal\s+)?deputy\b"),
    ("Local Deputy", r"\balternate\s+(?:local\s+)?deputy\b"),
    ("Local Deputy", r"\blocal\s+deputy\s+to\s+(?:state\s+legislature|the\s+legislature)\b"),
    ("Local Deputy", r"\bdeputy\s+to\s+(?:state\s+legislature|state\s+congress)\b"),
    ("Representative", r"\brepresentative\s+to\s+(?:the\s+)?assembly\b|\brepresentative\s+to\s+(?:the\s+)?federal\s+district\s+assembly\b"),
    ("Governor", r"\bgovernor[\s-]elect\b"),
    ("Governor", r"\bsubstitute\s+governor\b|\bprovisional\s+governor\b|\bacting\s+governor\b|\binterim\s+governor\b"),
    ("Alternate Mayor", r"\balternate\s+mayor\b|\bvice\s+mayor\b"),
    ("Senator", r"\balternate\s+senator\b"),
    ("Local Deputy", r"\bplurino\w*\s+local\s+deputy\b|\bplurino\w*\s+(?:state\s+)?deputy\b"),
]
# Offices, titles and bodies.
LOCAL_OFFICE = r"\b(mayor|alternate\s+mayor|vice\s+mayor|municipal\s+president|city\s+council|municipal\s+council|municipal\s+treasurer|municipal\s+secretary|syndic|regidor|ayuntamiento)\b"
CHAMBER_TITLES = ("Federal Deputy", "Senator", "Representative", "Vice President", "Member", "President", "Secretary", "Delegate", "Coordinator", "Head", "Oficial Mayor", "Director")
LOCAL_TITLES = ("Governor", "Mayor", "Local Deputy", "Alternate Mayor")
LOCAL_SECTION = r"\b(Local|Section|Seccion)\s+No\.?\s*\d+\b"
LOCAL_BODY = r"\b(ejido|municipal|city\s+of)\b"
ABROAD = r"\b(ambassador|consul\s+general|consul|embassy|consulate|charge\s+d.affaires)\b"
# Federal organisations; the Department of the Federal District is none.
FEDERAL_ORGANIZATION = r"secretariat of|bank of mexico|nacional financiera|banrural|banobras|pemex|petroleos mexicanos|cfe\b|federal electric|imss|issste|infonavit|conasupo|supreme court|chamber of deputies|senate\b|national polytechnic|national finance bank|foreign trade bank|economics cabinet|national commission|national institute"
CAPITAL_DEPARTMENT = r"department of the federal district"
OUT_OF_SCOPE = r"distant|third|fourth|removed"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_extract(c, pattern, group)), r"[.,;]+$", "")), F.lit(""))


def accepted_name(c: Column) -> Column:
    """An extracted name without years and trailing role words, null if nothing of substance is left."""
    ended = lambda x: F.regexp_replace(F.trim(x), r"[.,;]+$", "")
    out = F.regexp_replace(F.regexp_replace(ended(c), r"\s+\d{4}.*$", ""), f"(?i){TRAILING}", "")
    out = ended(F.regexp_replace(out, r"\s{2,}", " "))
    return X.bound(out, lambda x: F.when((F.length(x) >= 3) & ~x.rlike(f"(?i){SERVICES}"), x))


def first_accepted(c: Column, patterns: Sequence[str]) -> Column:
    """First pattern whose capture is accepted; a rejected capture falls through to the next."""
    return F.coalesce(*[accepted_name(F.nullif(F.regexp_extract(c, f"(?iU){p}", 1), F.lit(""))) for p in patterns])


def school_in(c: Column) -> Column:
    """School named in an entry: the first of two joined by ``and``, or the parent that follows it directly."""

    def one(org: Column) -> Column:
        first = F.trim(F.element_at(F.split(org, " and "), 1))

        def parent(x: Column) -> Column:
            at = F.instr(F.lower(c), F.lower(x))
            after = F.when(at > 0, F.substr(c, at + F.length(x), F.lit(30)))
            named = F.nullif(F.upper(F.regexp_extract(after, r"(?i)^\s*,\s*(UNAM|IPN)\b", 1)), F.lit(""))
            return F.when(F.length(x) >= 3, F.coalesce(named, x))

        return X.bound(first, parent)

    return F.coalesce(*[one(first_accepted(c, [p])) for p in rules.SCHOOL_NAMED])


def organization_in(c: Column, field: Column) -> Column:
    """Organisation named in an entry of a field: the field's own patterns, then secretariats, other organisations,
    secretaries' posts, posts that name what they are of, and courts."""
    offices = "(" + "|".join(n for n in sorted(rules.NAMED_OFFICES, key=lambda n: -len(n))) + ")"

    def of(t: Column) -> Column:
        post = F.nullif(F.regexp_extract(t, f"(?iU){rules.SECRETARY_POST}", 1), F.lit(""))
        courts = F.slice(F.regexp_extract_all(t, F.lit(f"(?i){rules.COURT}"), F.lit(0)), 1, 2)
        general = F.coalesce(
            first_accepted(t, [offices, rules.OTHER_ORGANIZATION]), accepted_name(F.concat(F.lit("Secretariat of "), F.trim(post))), first_accepted(t, [rules.POST_OF]), accepted_name(F.nullif(F.array_join(courts, ", "), F.lit(""))))
        return (
            F.when(F.coalesce(field == "birthplace", F.lit(False)), F.lit(None).cast("string"))
            .when(field == "education", school_in(t)).when(field == "party_positions", first_accepted(t, rules.PARTY_NAMED))
            .when(field == "public_positions", F.coalesce(first_accepted(t, rules.PUBLIC_NAMED), general)).when(field == "labor_positions", F.coalesce(first_accepted(t, rules.LABOR_NAMED), general)).otherwise(general)
        )

    text = F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), r"\(([A-Z]{2,8})\)", " $1 ")
    return F.when(F.length(c) >= 5, X.bound(text, of))


def labor_organization(existing: Column, text: Column) -> Column:
    """Existing organisation, else acronym, else the union of a numbered local, else a body's name."""
    return F.coalesce(F.when(F.length(existing) >= 3, existing), F.upper(_found(text, f"(?i){ACRONYM}")), _found(text, f"(?i){LOCAL_UNION}"), _found(text, f"(?i){BODY_NAME}"))


def sub_department(c: Column) -> Column:
    """Department named in a text, unless it is one of the top level."""
    d = _found(c, f"(?i){DEPARTMENT}")
    return F.when(~d.rlike(f"(?i){TOP_DEPARTMENT}"), d)


def is_federal(organization: Column, state: Column, text: Column) -> Column:
    """Federal, not federal or unknown: by the organisation, then by a state outside the capital unless the post is a secretary's."""
    return F.when(organization.rlike(f"(?i){CAPITAL_DEPARTMENT}"), False).when(organization.rlike(f"(?i){FEDERAL_ORGANIZATION}"), True).when(state.isNotNull() & (state != "Federal District"), F.coalesce(text.rlike(r"(?i)\bsecretary\s+of\b|\bsecretary,"), F.lit(False)))


def reextracted(old_text: Column, new_text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Years read again only if cleaning changed the text and it still names years."""
    a, b = X.years(new_text)
    again = ~new_text.eqNullSafe(old_text) & a.isNotNull()
    return F.when(again, a).otherwise(start), F.when(again, b).otherwise(end)


def filled_title(title: Column, text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(title, r"\s{2,}", " ")), X.cascade(text, TITLE_FILL))


def municipality(text: Column, title: Column) -> Column:
    """Town of a local office: what is left after title, years and state."""
    states = "|".join(k.lower() for k, _ in X.longest_first(rules.STATE_VARIANTS)).replace(".", r"\.")
    starts = F.startswith(F.lower(text), F.lower(title))
    rest = F.when(F.coalesce(starts, F.lit(False)), F.substr(text, F.length(title) + 1)).otherwise(F.regexp_replace(text, f"(?i)^.*?{LOCAL_OFFICE}", ""))
    rest = F.coalesce(X.strip_years(F.regexp_replace(rest, r"^[ ,]+", "")), F.lit(""))
    rest = F.trim(F.regexp_replace(rest, rf"(?i),?\s*(state\s+of\s+)?\b({states})\s*(,.*)?$", ""))
    rest = F.regexp_replace(rest, r"^(of )|[ ,]+$", "")
    ok = text.rlike(f"(?i){LOCAL_OFFICE}") & F.length(rest).between(2, 60) & ~rest.rlike(r"(?i)\b(committee|convention|council|commission)\b")
    return F.when(ok, rest)


def state_of_town(state: Column, town: Column) -> Column:
    """Known state, else the state of a town that is listed by exactly this name."""
    cities = F.create_map(*[F.lit(x) for kv in rules.CITY_STATE.items() for x in kv])
    return F.coalesce(state, F.try_element_at(cities, X.normal(town)))


def labor_is_national(known: Column, text: Column) -> Column:
    """Unknown becomes not national where the text names a numbered section, a state's branch or a local body."""
    states = "|".join(k.lower() for k, _ in X.longest_first(rules.STATE_VARIANTS)).replace(".", r"\.")
    local = text.rlike(f"(?i){LOCAL_SECTION}") | X.normal(text).rlike(rf"\bof\s+(the\s+)?(state\s+of\s+)?({states})\b") | X.normal(text).rlike(LOCAL_BODY)
    return F.coalesce(known, F.when(local, F.lit(False)))


def filled_level(level: Column, state: Column, text: Column) -> Column:
    """Party level: a state level without a state is unknown; unknown is filled from the text, then from the state."""
    kept = F.when((level == "state") & state.isNull(), F.lit(None)).otherwise(level)
    national = text.rlike(r"(?i)\b(chamber\s+of\s+deputies|senate|congress|national\s+(committee|council|assembly|convention)|central\s+committee|plurinominal)\b")
    return F.coalesce(kept, F.when(national, "national").when(state.isNotNull(), "state"))


def work_state_public(title: Column, state: Column) -> Column:
    """Where a public post was held: members of the chambers in the capital, local offices in their state."""
    t = F.coalesce(F.trim(title), F.lit(""))
    return F.when(t.isin(*LOCAL_TITLES), state).when(t.isin(*CHAMBER_TITLES) | (t == ""), F.lit("Federal District")).otherwise(state)


def work_state_govt(state: Column, federal: Column, text: Column) -> Column:
    return F.coalesce(state, F.when(F.coalesce(federal, F.lit(False)) & ~F.coalesce(text.rlike(f"(?i){ABROAD}"), F.lit(False)), F.lit("Federal District")))


def work_state_labor(national: Column, state: Column) -> Column:
    return F.coalesce(state, F.when(F.coalesce(national, F.lit(False)), F.lit("Federal District")))


def work_state_party(level: Column, state: Column) -> Column:
    return F.when(level == "national", F.coalesce(state, F.lit("Federal District"))).otherwise(state)


def consistent_record(kind: Column, text: Column) -> Column:
    """A campaign that was joined is a campaign; a resignation in protest is a post."""
    return F.when(text.rlike(r"(?i)^joined\b.{0,60}\bcampaign\b"), "campaign").when(text.rlike(r"(?i)^resigned\b.{0,60}\bprotest\b.{0,60}\bcandidate\b"), "active_position").otherwise(kind)


def in_scope(relationship: Column) -> Column:
    """Concrete kinship within reach."""
    r = F.lower(F.trim(relationship))
    return F.coalesce(~r.isin("", "nan", "none", "unknown") & ~r.rlike(OUT_OF_SCOPE), F.lit(False))


def displayed(name: Column) -> Column:
    """``Surname, Given`` as ``Given Surname``."""
    parts = F.split(name, ",", 2)
    return F.when(name.contains(","), F.trim(F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0)))))).otherwise(name)
