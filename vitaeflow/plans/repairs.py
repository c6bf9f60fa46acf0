"""Queries of the repair chains, post labels and the assembled network, and the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import fuzzy, graph, intervals, parse, relops
from ..operators import repairs as R
from ..session import ensure_checkpoint_dir
from ..sources.tables import csv, roster_sheet, table, whole_text, write_csv
from . import views as V
from .catalog import _BODY, _BOTH_CELLS, _CHIEFS, _LEVEL, _UNITS, party_level

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- organisations ---------------------------------------------------------------------


@query(f"WITH {V.PP} SELECT record_id, coalesce({V.case('organization', rules.SECRETARIAT)}, organization) AS secretariat FROM pp WHERE field_type = 'govt_positions'")
def secretariats(spark: SparkSession, d: str) -> DataFrame:
    """One name for every secretariat."""
    return V.domain(spark, d, "govt_positions", "organization").select("record_id", R.secretariat(F.col("organization")).alias("secretariat"))


@query()
def schools_repaired(spark, d):
    """Schools after the ten repairs, and their states."""
    e = V.education(spark, d, "organization", "role_text_raw", "state")
    return e.select("record_id", R.school_repaired(F.col("organization"), F.col("role_text_raw")).alias("school"), R.school_state(F.col("state"), F.col("role_text_raw")).alias("state_filled"))


_TOWNS = "(CASE " + " ".join(f"WHEN contains(lower(role_text_raw), '{k}') THEN '{v}'" for k, v in X.longest_first(list(rules.SCHOOL_TOWN_STATE.items()))) + " END)"


@query(f"WITH {V.ED} SELECT record_id, coalesce(state, CASE WHEN NOT {V.like('role_text_raw', rules.FOREIGN_CONTEXT)} THEN {_TOWNS} END) AS state_filled FROM ed")
def school_states(spark, d):
    """States of education records, filled from the towns they name."""
    return V.education(spark, d, "role_text_raw", "state").select("record_id", R.school_state(F.col("state"), F.col("role_text_raw")).alias("state_filled"))


@query()
def offices_repaired(spark, d):
    """Organisations of government posts after their repair."""
    g = V.domain(spark, d, "govt_positions", "organization", "role_text_raw")
    return g.select("record_id", R.office_repaired(F.col("organization"), F.lit(None).cast("string"), F.col("role_text_raw")).alias("office"))


@query(f"""WITH {V.PP}, x AS (SELECT record_id, nullif(trim(regexp_extract(role_text, '(?i)^\\s*([a-z][a-z \\-]*?)(?:\\s*,|\\s+(?:of|from|to)\\b|\\s*\\d|$)', 1)), '') AS t, upper(nullif(regexp_extract(role_text, '(?i)\\b(ceo|cfo|cto|coo)\\b', 1), '')) AS k FROM pp)
SELECT record_id, coalesce(lower(t), lower(k)) AS title FROM x""")
def titles_at_start(spark, d):
    """Titles of all entries, in lower case: at their start, else by their letters."""
    return V.positions(spark, d, "role_text").select("record_id", F.lower(R.title_or_keyword(F.col("role_text"))).alias("title"))


# Made-up entities of a plug-in, as SQL and as rows: the ranking rule is what is compared.
_ENTITIES = (
    (1, 1, "Sonora", "GPE"), (1, 2, "Radio Altepan", "ORG"), (1, 3, "College of Mines", "ORG"), (2, 1, "PhD", "ORG"), (2, 2, "Sorbonne", "GPE"), (2, 3, "Paris", "GPE"), (3, 1, "Union of Miners", "ORG"), (3, 2, "Cum laude", "ORG"),
    (4, 1, "UN", "ORG"), (4, 2, "Oaxaca", "GPE"), (5, 1, " School of Law ", "ORG"), (5, 2, "Academy of Arts", "ORG"),
)
_ENT_SQL = ", ".join(f"({i}, {k}, '{t}', '{n}')" for i, k, t, n in _ENTITIES)


@query(f"""WITH e AS (SELECT CAST(id AS BIGINT) AS id, k, trim(t) AS t, label FROM (VALUES {_ENT_SQL}) v(id, k, t, label)),
g AS (SELECT id, k, t, CASE WHEN label = 'ORG' AND {V.like('t', rules.ENTITY_INSTITUTION)} THEN 1 WHEN label = 'ORG' THEN 2 WHEN {V.like('t', rules.FOREIGN_SCHOOL)} THEN 3 END AS r FROM e WHERE length(t) >= 4 AND lower(t) NOT IN {rules.ENTITY_STOP})
SELECT i.id, arg_min(g.t, (g.r, g.k)) AS organization FROM (SELECT DISTINCT id FROM e) i LEFT JOIN (SELECT * FROM g WHERE r IS NOT NULL) g USING (id) GROUP BY i.id""")
def entity_choice(spark, d):
    """The organisation among the entities a plug-in found in each text."""
    rows = spark.createDataFrame(list(_ENTITIES), "id long, k int, text string, label string")
    told = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text", "label"))), lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))).alias("e"))
    return told.select("id", R.best_entity(F.col("e")).alias("organization"))


# ---- years and degrees ----------------------------------------------------------------

_CLEAN = f"trim(regexp_replace(regexp_replace(raw, '(?i){rules.SCAN_FRAGMENTS_ALL}', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"
_BARE = f"regexp_replace(regexp_replace(clean, '(?i){rules.THESIS}', '', 'g'), '(?i){rules.PAST_YEAR}', '', 'g')"


@query(f"""WITH {V.ED}, r AS (SELECT record_id, coalesce(role_text_raw, '') AS raw, year_start, year_end FROM ed), c AS (SELECT *, {_CLEAN} AS clean FROM r),
y AS (SELECT *, {_BARE} AS bare, clean <> raw OR coalesce(year_end < year_start, false) OR coalesce(year_start < 1880, false) AS again FROM c)
SELECT record_id, CASE WHEN again THEN {V.YEARS_SQL.format(c='bare', g=1)} ELSE year_start END AS y0, CASE WHEN again THEN {V.YEARS_SQL.format(c='bare', g=2)} ELSE year_end END AS y1 FROM y""")
def education_years(spark, d):
    """Years of education records, read again where they cannot be right."""
    e = V.education(spark, d, "role_text_raw", "year_start", "year_end")
    a, b = R.education_years(F.col("role_text_raw"), F.col("year_start"), F.col("year_end"))
    return e.select("record_id", a.alias("y0"), b.alias("y1"))


_LOW = "coalesce(year_start >= 2000 AND year_end < 1950, false)"
_IN = lambda c: f"({c} BETWEEN 1850 AND 2009)"


@query(f"""WITH {V.PP}, p AS (SELECT record_id, field_type, year_start, year_end, {_LOW} AS low, CASE WHEN NOT {_LOW} AND year_end < year_start THEN year_end ELSE year_start END AS a, CASE WHEN {_LOW} THEN year_end + 100 WHEN year_end < year_start THEN year_start ELSE year_end END AS b FROM pp WHERE field_type IN ('public_positions', 'other_positions')),
f AS (SELECT *, CASE WHEN a IS NULL OR {_IN('a')} THEN a WHEN {_IN('b')} THEN b END AS first FROM p)
SELECT record_id, CASE WHEN field_type = 'public_positions' OR low THEN a ELSE first END AS y0, CASE WHEN field_type = 'public_positions' OR low THEN b WHEN b IS NULL OR {_IN('b')} THEN b ELSE first END AS y1 FROM f""")
def years_by_field(spark, d):
    """Years of public and other posts, by the repair of their field."""
    x = V.positions(spark, d, "field_type", "year_start", "year_end").where(F.col("field_type").isin("public_positions", "other_positions"))
    ends = F.col("year_start"), F.col("year_end")
    public = F.col("field_type") == "public_positions"
    return x.select("record_id", *[F.when(public, p).otherwise(o).alias(n) for n, p, o in zip(("y0", "y1"), R.public_years(*ends), R.other_years(*ends))])


_OFF = lambda p: f"trim(regexp_replace(regexp_replace(role_text_raw, '(?i){p}', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"


@query(f"WITH {V.PP} SELECT record_id, CASE WHEN field_type IN ('govt_positions', 'public_positions') THEN {_OFF(rules.SCAN_FRAGMENTS_OFFICE)} ELSE {_OFF(rules.SCAN_FRAGMENTS_ALL)} END AS cleaned FROM pp")
def fragments_by_field(spark, d):
    """Role texts without leftovers of the scans, by the pattern of their field."""
    c = F.col("role_text_raw")
    office = F.col("field_type").isin("govt_positions", "public_positions")
    return V.positions(spark, d, "field_type", "role_text_raw").select("record_id", F.when(office, R.cleaned_entry(c, rules.SCAN_FRAGMENTS_OFFICE)).otherwise(R.cleaned_entry(c)).alias("cleaned"))


_BOTH = "concat_ws(' ', role_text_raw, organization)"


@query(f"""WITH {V.ED} SELECT record_id, CASE WHEN degree_field = 'business' AND {V.like('role_text_raw', rules.POLITICAL_FIELD)} THEN 'political_sci' WHEN degree_field = 'other' AND {V.like('role_text_raw', rules.URBAN_FIELD)} THEN 'architecture' ELSE degree_field END AS field,
CASE WHEN coalesce(foreign_degree, false) THEN true WHEN {V.like(_BOTH, rules.FOREIGN_SCHOOL)} AND NOT (coalesce(NOT foreign_degree, false) AND {V.like(_BOTH, rules.HOME_SCHOOL)}) THEN true ELSE foreign_degree END AS abroad FROM ed""")
def degrees_corrected(spark, d):
    """Fields of degrees and whether they are foreign, corrected by the entry."""
    e = V.education(spark, d, "role_text_raw", "organization", "degree_field", "foreign_degree")
    return e.select("record_id", R.degree_field(F.col("degree_field"), F.col("role_text_raw")).alias("field"), R.degree_abroad(F.col("foreign_degree"), F.col("role_text_raw"), F.col("organization")).alias("abroad"))


# ---- parties ---------------------------------------------------------------------------

_m = lambda p: V.like("role_text", p.replace("(?=\\s*,)", "\\s*,"))
_NAT = f"(coalesce(level = 'national', false) OR coalesce(body IN {rules.NATIONAL_BODIES}, false))"
_STA = f"(coalesce(level IN ('state', 'local'), false) OR coalesce(body IN {rules.STATE_BODIES + rules.LOCAL_BODIES}, false))"
_RANK = f"""CASE WHEN role_text IS NULL THEN 'other' WHEN {_m(rules.PRESIDENT)} THEN CASE WHEN body = 'CEN' THEN 'cen_president' WHEN {_NAT} THEN 'national_president' ELSE 'state_president' END
 WHEN {_m(rules.SECRETARY_GENERAL)} THEN CASE WHEN {_NAT} THEN 'secretary_general_nat' ELSE 'state_secretary_general' END WHEN {_m(rules.IEPES_DIRECTOR)} THEN 'iepes_director'
 WHEN {_m(chr(92) + 'bCEN' + chr(92) + 'b')} THEN CASE WHEN {_m(rules.CEN_DELEGATE)} THEN 'national_delegate' WHEN {_m(rules.SECRETARY_OF)} THEN 'cen_secretary' ELSE 'cen_member' END
 WHEN {_NAT} AND {_m(rules.SECRETARY_OF)} THEN 'cen_secretary' WHEN {_m(rules.CAMPAIGN_LEADER)} THEN 'campaign_leader' WHEN {_NAT} AND {_m(chr(92) + 'bdelegate' + chr(92) + 'b')} THEN 'national_delegate'
 WHEN {_STA} AND {_m(rules.SECRETARY_OF)} THEN 'state_secretary' WHEN {_m(rules.ADVISER_MEMBER)} THEN 'adviser_member' WHEN {_m(chr(92) + 'bcampaign' + chr(92) + 'b')} THEN 'campaign_participant' WHEN {_m(rules.PARTY_RECORD[0][1])} THEN 'joined' ELSE 'other' END"""
_RANK2 = f"""CASE WHEN {_m(rules.CEN_CANDIDATE)} THEN 'cen_president' WHEN rank = 'other' AND kind = 'candidate' THEN 'candidate' WHEN rank = 'other' AND {_m(rules.ADVISER)} THEN 'adviser_member'
 WHEN rank = 'other' AND level = 'state' AND {_m(rules.STATE_DIRECTOR)} THEN 'state_president' WHEN rank = 'other' AND {_m(rules.CAMPAIGN_COORDINATOR)} THEN 'campaign_leader' ELSE rank END"""
_LEVEL2 = f"""coalesce(CASE WHEN level = 'state' AND state IS NULL THEN NULL WHEN level = 'state' AND {_m(R.local_towns())} THEN 'local' ELSE level END,
 CASE WHEN rank2 IN ('state_president', 'state_secretary', 'state_secretary_general') THEN 'state' WHEN {_m(rules.NATIONAL_BODY)} THEN 'national' WHEN {_m(R.local_towns())} THEN 'local' WHEN state IS NOT NULL THEN 'state' END)"""
_MINOR = " ,".join(f"upper(nullif(regexp_extract({c}, '(?i){rules.MINOR_PARTY}', 1), ''))" for c in ("organization", "role_text"))


@query(f"""WITH {V.PP}, x AS (SELECT *, {_BODY} AS body, coalesce({V.case('organization', rules.PARTY)}, {V.case('role_text', rules.PARTY)}) AS party, {V.case("coalesce(role_text, '')", rules.PARTY_RECORD, 'active_position')} AS kind FROM pp WHERE field_type = 'party_positions'),
l AS (SELECT *, {_LEVEL} AS level FROM x), r AS (SELECT *, {_RANK} AS rank FROM l), s AS (SELECT *, {_RANK2} AS rank2 FROM r)
SELECT record_id, rank, rank2, {_LEVEL2} AS level2, coalesce(party, {_MINOR}, CASE WHEN {_m(rules.PARTY_PP)} THEN 'PP' END) AS party2 FROM s""")
def party_ranks(spark, d):
    """Rank of every party post, the rank and level after their repair, and the party with the minor ones."""
    x = V.domain(spark, d, "party_positions", "organization", "role_text", "state")
    both, text = [F.col("organization"), F.col("role_text")], F.col("role_text")
    x = x.withColumn("body", X.cascade_sources(both, rules.PARTY_BODY)).withColumn("party", X.cascade_sources(both, rules.PARTY)).withColumn("kind", X.cascade(F.coalesce(text, F.lit("")), rules.PARTY_RECORD, "active_position"))
    x = x.withColumn("level", party_level(F.col("body"), F.col("state"), text)).withColumn("rank", R.party_rank(text, F.col("body"), F.col("level")))
    x = x.withColumn("rank2", R.party_rank_repaired(F.col("rank"), F.col("kind"), F.col("level"), text))
    return x.select("record_id", "rank", "rank2", R.party_level_repaired(F.col("level"), F.col("state"), F.col("rank2"), text).alias("level2"), R.minor_party(F.col("party"), F.col("organization"), text).alias("party2"))


@query(f"""WITH {V.PP}, x AS (SELECT *, {_BODY} AS body FROM pp WHERE field_type = 'party_positions'), l AS (SELECT *, {_LEVEL} AS level FROM x), r AS (SELECT person_id, record_id, {_RANK} AS rank FROM l)
SELECT person_id, arg_min(rank, ({V.order_case('rank', rules.PARTY_ORDER)}, record_id)) AS best_rank FROM r GROUP BY person_id""")
def party_best(spark, d):
    """The highest party rank of every person."""
    x = V.domain(spark, d, "party_positions", "person_id", "organization", "role_text", "state")
    x = x.withColumn("body", X.cascade_sources([F.col("organization"), F.col("role_text")], rules.PARTY_BODY))
    x = x.withColumn("rank", R.party_rank(F.col("role_text"), F.col("body"), party_level(F.col("body"), F.col("state"), F.col("role_text"))))
    return x.groupBy("person_id").agg(relops.best_by_order(F.col("rank"), rules.PARTY_ORDER, F.col("record_id")).alias("best_rank"))


# ---- labels of posts -------------------------------------------------------------------

_TITLED = "list_aggregate(list_transform(string_split(replace(rank, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"
_POSTS = f"""g AS (SELECT person_id, record_id, year_start AS a, coalesce(year_end, year_start) AS b, coalesce({V.case('organization', rules.SECRETARIAT)}, organization) AS inst, nullif(trim(role_text), '') AS t, {V.case("coalesce(role_text, '')", rules.GOVT_RANK, 'other')} AS rank FROM pp WHERE field_type = 'govt_positions' AND year_start IS NOT NULL),
 posts AS (SELECT person_id, record_id, a, b, (CASE rank {' '.join(f"WHEN '{k}' THEN {v}" for k, v in rules.POST_WEIGHT.items())} ELSE 1 END) AS weight, coalesce({_TITLED} || ', ' || inst, upper(t[1]) || t[2:], {_TITLED}) AS label, 0 AS kind FROM g
 UNION ALL SELECT person_id, record_id, year_start, coalesce(year_end, year_start), (CASE coalesce(position_title, 'Elected office') {' '.join(f"WHEN '{k}' THEN {v}" for k, v in rules.OFFICE_WEIGHT.items())} ELSE 2 END), coalesce(position_title, 'Elected office') || coalesce(' (' || nullif(state, '') || ')', ''), 1 FROM pp WHERE field_type = 'public_positions' AND year_start IS NOT NULL)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    g = V.domain(spark, d, "govt_positions", "person_id", "organization", "role_text", "year_start", "year_end").where("year_start is not null")
    rank = X.cascade(F.coalesce("role_text", F.lit("")), rules.GOVT_RANK, "other")
    end = F.coalesce("year_end", "year_start").alias("b")
    g = g.withColumn("rank", rank).select("person_id", "record_id", F.col("year_start").alias("a"), end, R.post_weight(F.col("rank")).alias("weight"), R.post_label(F.col("rank"), R.secretariat(F.col("organization")), F.col("role_text")).alias("label"), F.lit(0).alias("kind"))
    p = V.domain(spark, d, "public_positions", "person_id", "position_title", "state", "year_start", "year_end").where("year_start is not null")
    p = p.select("person_id", "record_id", F.col("year_start").alias("a"), end, R.office_weight(F.col("position_title")).alias("weight"), R.office_label(F.col("position_title"), F.col("state")).alias("label"), F.lit(1).alias("kind"))
    return g.unionByName(p)


@query(f"WITH {V.PP}, {_POSTS} SELECT record_id, weight, label FROM posts")
def post_labels(spark, d):
    """Label and weight of every government and public post."""
    return _posts(spark, d).select("record_id", "weight", "label")


@query(f"""WITH {V.PP}, {_POSTS}, q AS (SELECT DISTINCT person_id, CAST(election + k AS INTEGER) AS year FROM roster, unnest(range(-6, 7)) AS u(k)),
h AS (SELECT q.person_id, q.year, p.label, row_number() OVER (PARTITION BY q.person_id, q.year ORDER BY p.weight DESC, p.kind, p.record_id) AS k FROM q JOIN posts p ON p.person_id = q.person_id AND q.year BETWEEN p.a AND p.b)
SELECT q.person_id, q.year, coalesce(h.label, '') AS label FROM q LEFT JOIN h ON h.person_id = q.person_id AND h.year = q.year AND h.k = 1""")
def post_in_year(spark, d):
    """The weightiest post, government or public, of every candidate in the years around the elections."""
    asked = table(spark, d, "roster").select("person_id", F.explode(F.sequence(F.col("election") - 6, F.col("election") + 6)).alias("year")).distinct()
    p = _posts(spark, d).withColumn("seq", F.struct("kind", "record_id"))
    return intervals.best_in_years(asked, p, "person_id", "year", "a", "b", "weight", "seq", "label").select("person_id", "year", "label")


# ---- networks ---------------------------------------------------------------------------

_POP = f"WITH {V.EDGES}, pop AS (SELECT alter_id, count(DISTINCT ego_id) AS n_egos FROM eg WHERE alter_id IS NOT NULL GROUP BY alter_id)"


@query(_POP + ", x AS (SELECT DISTINCT ego_id, alter_id, n_egos FROM eg JOIN pop USING (alter_id) WHERE n_egos >= 2) SELECT ego_id, alter_id, n_egos, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ego_id ORDER BY n_egos DESC, alter_id) AS INTEGER) AS rank FROM x) WHERE rank <= 7")
def popular_labels(spark, d):
    """Of every ego the seven alters that most egos share, at least two."""
    e = V.edges(spark, d).where("alter_id is not null").select("ego_id", "alter_id").distinct()
    pop = e.groupBy("alter_id").agg(F.countDistinct("ego_id").alias("n_egos")).where("n_egos >= 2")
    return relops.top_k(e.join(pop, "alter_id").select("ego_id", "alter_id", "n_egos"), ["ego_id"], [F.desc("n_egos"), F.asc("alter_id")], 7)


#: Persons up to which a school and a place of work count as a focus.
MOST_AT_SCHOOL, MOST_AT_WORK = 60, 60
_REVOLUTION = r"revolution|zapatist|villist|carrancist|maderist|constitutionalist|obregonist|cristero|huertist|insurgent|rebel|joined|fought|forces|brigade|division|battalion"


def _military(spark: SparkSession, d: str) -> DataFrame:
    """Dated military entries of every person."""
    bio = table(spark, d, "biographies").where("field_j is not null and person_id is not null").select("bio_row", "person_id", F.col("field_j").alias("cell"))
    e = relops.split_entries(bio, "cell").drop("cell")
    a, b = X.years(F.col("entry"))
    return e.select("person_id", "entry", a.alias("year_start"), F.coalesce(b, a).alias("year_end"))


_UNIT_WORD = "(?:brigade|battalion|regiment|division|corps|cavalry|infantry|zone)"
_ENTRY_UNITS, _ENTRY_CHIEFS = (x.replace(_BOTH_CELLS, "entry") for x in (_UNITS, _CHIEFS))
_STATES = ", ".join("('" + k.lower().replace(".", "\\.") + f"', '{v}')" for k, v in rules.STATE_VARIANTS)


def _met_sql(name: str, stage: int, kind: str, most: int) -> str:
    """Edges of one kind from dated records with a focus."""
    return f"""{name}_r AS (SELECT person_id, focus, year_start, coalesce(year_end, year_start) AS year_end, role FROM {name} WHERE focus IS NOT NULL AND year_start IS NOT NULL),
{name}_n AS (SELECT focus, count(DISTINCT person_id) AS focus_size FROM {name}_r GROUP BY focus HAVING count(DISTINCT person_id) <= {most}),
{name}_e AS (SELECT {stage} AS stage, '{kind}' AS edge_type, e.person_id AS ego_id, a.person_id AS alter_id, e.focus, n.focus_size, e.role AS ego_role, a.role AS alter_role, greatest(e.year_start, a.year_start) AS year_start, least(e.year_end, a.year_end) AS year_end
 FROM {name}_r e JOIN {name}_n n ON n.focus = e.focus JOIN {name}_r a ON a.focus = e.focus WHERE e.person_id IN (SELECT person_id FROM roster) AND e.person_id <> a.person_id AND e.year_start <= a.year_end + 1 AND a.year_start <= e.year_end + 1)"""


_NOTE_TEXT = "personal_info"
for _p in rules.TEXT_ARTIFACTS:
    _NOTE_TEXT = f"regexp_replace({_NOTE_TEXT}, '{_p}', '', 'g')"
_NAMED = " UNION ALL ".join(f"SELECT ego_id, '{k}' AS kind, unnest(regexp_extract_all(t, '(?i){p}', 1)) AS m FROM notes" for k, p in rules.MENTIONS)
_EDGES_SQL = f"""WITH {V.PP}, {V.ED},
s0 AS (SELECT * FROM ed WHERE length(organization) >= 3 AND NOT regexp_matches(organization, '(?i)\\bNo\\.?\\s*$')), ss AS (SELECT organization, count(DISTINCT person_id) AS n FROM s0 GROUP BY organization),
school AS (SELECT person_id, CASE WHEN ss.n <= {MOST_AT_SCHOOL} THEN s0.organization ELSE s0.organization || ' | ' || nullif(trim(degree_field), '') END || ' [' || coalesce(nullif(trim(degree_level), ''), 'pre/other') || '/' || CASE WHEN record_type = 'academic_role' THEN 'staff' ELSE 'student' END || ']' AS focus, year_start, year_end, role_text AS role FROM s0 JOIN ss ON ss.organization = s0.organization),
w0 AS (SELECT *, nullif(trim(organization), '') AS org, nullif(trim(state), '') AS st, {_BODY} AS body, nullif(trim(regexp_extract(role_text, '(?i)\\b(Department\\s+of\\s+[A-Za-z][^,;0-9]{{2,60}})', 1)), '') AS dep, coalesce({V.case('organization', rules.PARTY)}, {V.case('role_text', rules.PARTY)}, nullif(trim(organization), ''), 'party') AS party FROM pp WHERE field_type NOT IN ('education', 'birthplace')),
work AS (SELECT person_id, CASE WHEN field_type = 'party_positions' THEN CASE WHEN body IS NOT NULL OR st IS NOT NULL THEN party || ' – ' || coalesce(body || coalesce(' (' || st || ')', ''), st) END WHEN field_type = 'govt_positions' THEN coalesce(org || ' – ' || dep, coalesce({V.case('org', rules.SECRETARIAT)}, org)) ELSE org END AS focus, year_start, year_end, role_text AS role FROM w0),
m0 AS (SELECT person_id, trim(unnest(string_split(field_j, ';'))) AS entry FROM biographies WHERE field_j IS NOT NULL AND person_id IS NOT NULL),
m AS (SELECT person_id, entry, {V.YEARS_SQL.format(c='entry', g=1)} AS year_start, coalesce({V.YEARS_SQL.format(c='entry', g=2)}, {V.YEARS_SQL.format(c='entry', g=1)}) AS year_end FROM m0 WHERE length(entry) >= 5),
units AS (SELECT person_id, unnest(list_distinct(list_concat({_ENTRY_UNITS}, {_ENTRY_CHIEFS}))) AS focus, year_start, year_end, entry AS role FROM m),
fought AS (SELECT DISTINCT person_id, 'Revolution (' || v.state || ')' AS focus, year_start, year_end, entry AS role FROM m JOIN (VALUES {_STATES}) v(k, state) ON regexp_matches(regexp_replace({V.plain_sql('entry')}, '\\b' || v.k || '\\b\\s+{_UNIT_WORD}', chr(1), 'g'), '\\b' || v.k || '\\b') WHERE regexp_matches(entry, '(?i){_REVOLUTION}')),
notes AS (SELECT person_id AS ego_id, trim({_NOTE_TEXT}) AS t FROM biographies WHERE person_id IN (SELECT person_id FROM roster)), n0 AS ({_NAMED}),
named AS (SELECT * FROM (SELECT ego_id, kind, trim(regexp_replace(m, '(?i){rules.MENTION_TAIL}', '')) AS mention FROM n0) WHERE length(mention) >= 4),
pt AS (SELECT person_id, {V.TOKENS_SQL.format(c="person_name")} AS pt FROM (SELECT person_id, min(person_name) AS person_name FROM parsed_positions WHERE person_id IS NOT NULL GROUP BY person_id)),
q AS (SELECT DISTINCT mention, {V.TOKENS_SQL.format(c="mention")} AS qt FROM named), h AS (SELECT q.mention, pt.person_id, len(list_intersect(q.qt, pt.pt)) AS overlap, len(pt.pt) AS np FROM q JOIN pt ON len(list_intersect(q.qt, pt.pt)) >= 2),
who AS (SELECT mention, person_id FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY overlap DESC, np, person_id) AS k FROM h) WHERE k = 1),
explicit AS (SELECT 5 AS stage, kind AS edge_type, ego_id, who.person_id AS alter_id, kind AS focus, CAST(NULL AS BIGINT) AS focus_size, kind AS ego_role, left(named.mention, 80) AS alter_role, CAST(NULL AS INTEGER) AS year_start, CAST(NULL AS INTEGER) AS year_end FROM named JOIN who ON who.mention = named.mention WHERE ego_id <> who.person_id),
{_met_sql("school", 1, "co_education", MOST_AT_SCHOOL)}, {_met_sql("work", 2, "co_work", MOST_AT_WORK)}, {_met_sql("units", 3, "co_military", MOST_AT_WORK)}, {_met_sql("fought", 4, "co_revolution", MOST_AT_WORK)},
every_ AS (SELECT * FROM school_e UNION ALL SELECT * FROM work_e UNION ALL SELECT * FROM units_e UNION ALL SELECT * FROM fought_e UNION ALL SELECT * FROM explicit)
SELECT edge_type, ego_id, alter_id, focus, focus_size, ego_role, alter_role, year_start, year_end FROM (SELECT *, row_number() OVER (PARTITION BY ego_id, alter_id, edge_type, focus ORDER BY stage, year_start NULLS FIRST, year_end NULLS FIRST, alter_role NULLS FIRST, focus_size NULLS FIRST, ego_role NULLS FIRST) AS k FROM every_) WHERE k = 1"""


@query(_EDGES_SQL)
def edges_assembled(spark, d):
    """Edges of the egos from six sources, each once per ego, alter, kind and focus: schools, work, units and
    commanders, the Revolution in one state, and relations named in personal notes."""
    ego = V.egos(spark, d)
    cols = ("ego_id", "alter_id", "focus", "focus_size", "ego_role", "alter_role", "year_start", "year_end")

    def placed(records, most, kind, stage):
        return graph.co_location(records, ego, "focus", "person_id", "year_start", "year_end", "role", most).select(F.lit(stage).alias("stage"), F.lit(kind).alias("edge_type"), *cols)

    e = V.education(spark, d, "person_id", "organization", "degree_field", "degree_level", "record_type", "year_start", "year_end", "role_text").where((F.length("organization") >= 3) & ~F.col("organization").rlike(r"(?i)\bNo\.?\s*$"))
    size = e.groupBy("organization").agg(F.countDistinct("person_id").alias("at"))
    field = F.nullif(F.trim("degree_field"), F.lit(""))
    base = F.when(F.col("at") <= MOST_AT_SCHOOL, F.col("organization")).otherwise(F.concat("organization", F.lit(" | "), field))
    level = F.coalesce(F.nullif(F.trim("degree_level"), F.lit("")), F.lit("pre/other"))
    focus = F.concat(base, F.lit(" ["), level, F.lit("/"), F.when(F.col("record_type") == "academic_role", "staff").otherwise("student"), F.lit("]"))
    school = e.join(size, "organization").select("person_id", focus.alias("focus"), "year_start", "year_end", F.col("role_text").alias("role"))

    w = V.positions(spark, d, "person_id", "field_type", "organization", "state", "role_text", "year_start", "year_end").where(~F.col("field_type").isin("education", "birthplace"))
    both = [F.col("organization"), F.col("role_text")]
    org, st = F.nullif(F.trim("organization"), F.lit("")), F.nullif(F.trim("state"), F.lit(""))
    w = w.withColumn("body", X.cascade_sources(both, rules.PARTY_BODY)).withColumn("party", F.coalesce(X.cascade_sources(both, rules.PARTY), org, F.lit("party")))
    party = F.concat_ws("", "party", F.lit(" – "), F.coalesce(F.concat("body", F.coalesce(F.concat(F.lit(" ("), st, F.lit(")")), F.lit(""))), st))
    dep = F.nullif(F.trim(F.regexp_extract("role_text", r"(?i)\b(Department\s+of\s+[A-Za-z][^,;0-9]{2,60})", 1)), F.lit(""))
    govt = F.coalesce(F.concat(org, F.lit(" – "), dep), F.when(org.isNotNull(), R.secretariat(org)))
    at_work = F.when(F.col("field_type") == "party_positions", F.when(F.col("body").isNotNull() | st.isNotNull(), party)).when(F.col("field_type") == "govt_positions", govt).otherwise(org)
    work = w.select("person_id", at_work.alias("focus"), "year_start", "year_end", F.col("role_text").alias("role"))

    m = _military(spark, d)
    units = m.select("person_id", "year_start", "year_end", F.col("entry").alias("role"), F.explode(parse.units_and_commanders(F.col("entry"))).alias("focus"))
    fought = m.where(F.col("entry").rlike(f"(?i){_REVOLUTION}")).select("person_id", "year_start", "year_end", F.col("entry").alias("role"), F.explode(parse.states_named(F.col("entry"), rules.STATE_VARIANTS)).alias("s"))
    revolution = fought.select("person_id", "year_start", "year_end", "role", F.concat(F.lit("Revolution ("), "s", F.lit(")")).alias("focus"))

    notes = table(spark, d, "biographies").select(F.col("person_id").alias("ego_id"), "bio_row", X.clean_text(F.col("personal_info")).alias("t")).join(ego.select(F.col("person_id").alias("ego_id")), "ego_id", "left_semi")
    named = parse.mentions(notes, ["ego_id", "bio_row"], "t", rules.MENTIONS, rules.MENTION_TAIL).withColumn("q", F.xxhash64("mention"))
    people = table(spark, d, "parsed_positions").where("person_id is not null").groupBy("person_id").agg(F.min("person_name").alias("person_name"))
    asked = named.groupBy("q").agg(F.min("mention").alias("mention"))
    who = fuzzy.token_match(asked, people, "q", "mention", "person_id", "person_name", cover=False)
    told = named.join(who, "q").where("ego_id <> person_id")
    none = F.lit(None)
    explicit = told.select(F.lit(5).alias("stage"), F.col("kind").alias("edge_type"), "ego_id", F.col("person_id").alias("alter_id"), F.col("kind").alias("focus"), none.cast("long").alias("focus_size"), F.col("kind").alias("ego_role"), F.substring("mention", 1, 80).alias("alter_role"), none.cast("int").alias("year_start"), none.cast("int").alias("year_end"))
    every = placed(school, MOST_AT_SCHOOL, "co_education", 1)
    for rows in (placed(work, MOST_AT_WORK, "co_work", 2), placed(units, MOST_AT_WORK, "co_military", 3), placed(revolution, MOST_AT_WORK, "co_revolution", 4), explicit):
        every = every.unionByName(rows)
    return relops.keep_first(every, ["ego_id", "alter_id", "edge_type", "focus"], ["stage", "year_start", "year_end", "alter_role"]).drop("stage")


@query("WITH k AS (SELECT bio_row, personal_info AS t FROM biographies WHERE personal_info IS NOT NULL), m AS (" + " UNION ALL ".join(f"SELECT bio_row, '{k}' AS kind, {i} AS pattern, unnest(regexp_extract_all(t, '(?i){p}', 1)) AS m FROM k" for i, (k, p) in enumerate(rules.MENTIONS_OLDER))
       + f"), x AS (SELECT bio_row, kind, pattern, trim(regexp_replace(m, '(?i){rules.MENTION_TAIL_OLDER}', '')) AS mention FROM m) SELECT * FROM x WHERE length(mention) >= 4")
def mentions_older(spark, d):
    """Relations named in the personal notes, by the older set of patterns."""
    return parse.mentions(table(spark, d, "biographies"), ["bio_row"], "personal_info", rules.MENTIONS_OLDER, rules.MENTION_TAIL_OLDER)


@query("WITH p AS (SELECT DISTINCT record_id, organization FROM parsed_positions) SELECT p.record_id, coalesce(r.org_id, -1) AS org_id FROM p LEFT JOIN ref_organizations r ON r.org_name = p.organization")
def canonical_joined(spark, d):
    """Records with the id of their organisation where its name is in the reference list."""
    p = V.positions(spark, d, "organization")
    r = table(spark, d, "ref_organizations").select(F.col("org_name").alias("organization"), "org_id")
    return p.join(r, "organization", "left").select("record_id", F.coalesce("org_id", F.lit(-1).cast("long")).alias("org_id"))


# ---- rows and pages ---------------------------------------------------------------------


@query(f"WITH {V.PP} SELECT record_id FROM pp WHERE field_type = 'labor_positions' AND NOT (coalesce(person_id IN (SELECT person_id FROM roster), false) AND {V.like('role_text', '^(member|delegate)')})")
def rows_dropped(spark, d):
    """Labor records without the minor posts of the candidates: rows that meet both a person and a pattern go."""
    x = V.domain(spark, d, "labor_positions", "person_id", "role_text").join(V.egos(spark, d).withColumn("ego", F.lit(True)), "person_id", "left")
    return relops.without_rows(x, F.col("ego") & F.col("role_text").rlike("(?i)^(member|delegate)")).select("record_id")


@query("SELECT " + ", ".join(f"strip_accents({c}) AS {c}" if c != "org_id" else c for c in ("org_id", "org_name", "acronym", "kind")) + " FROM ref_organizations")
def accents_off_everywhere(spark, d):
    """The reference list with no accent in any text column."""
    return relops.string_columns(table(spark, d, "ref_organizations"), X.strip_accents)


_HALVES = "h AS (SELECT doc_id // 2 AS page, doc_id % 2 AS side, trim(text) AS t FROM documents WHERE trim(coalesce(text, '')) <> '')"


@query(f"WITH {_HALVES} SELECT page, '--- PAGE ' || page || ' ---' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY side) AS text FROM h WHERE page BETWEEN 33 AND 1067 GROUP BY page")
def pages_in_range(spark, d):
    """Pages 33 to 1067 from their halves, each document standing for one half of a page."""
    half = F.when(F.col("doc_id") % 2 == 0, "left").otherwise("right")
    h = table(spark, d, "documents").select(F.expr("doc_id div 2").alias("page"), half.alias("side"), "text")
    return R.pages_joined(h, 33, 1067)


@query("SELECT doc_id, regexp_replace(text, '(?is)library of.*?\\d{4}', '', 'g') AS slim FROM documents WHERE text IS NOT NULL")
def footers_off(spark, d):
    """Documents without the shortest stretches from a library's name to a year, over lines too."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", R.without_footer(F.col("text"), "library of", r"\d{4}").alias("slim"))


@query(f"WITH {V.PP}, {V.ED}, a AS (SELECT record_id, min(organization) AS o, min(state) AS s FROM ed GROUP BY record_id) SELECT pp.record_id, coalesce(pp.organization, a.o) AS organization, coalesce(pp.state, a.s) AS state FROM pp LEFT JOIN a USING (record_id)")
def answers_filled(spark, d):
    """Positions whose empty fields are taken from a table of answers, here the education records; kept values stay."""
    answers = V.education(spark, d, "organization", "state")
    return relops.fill_from(V.positions(spark, d, "organization", "state"), answers, "record_id", ["organization", "state"])


@query("SELECT CAST(election AS INTEGER) AS election, trim(replace(name, '✓', '')) AS name, CAST(contains(name, '✓') AS INTEGER) AS is_winner FROM roster WHERE trim(name) <> ''")
def roster_marks(spark, d):
    """The roster with its marks read as winners."""
    return roster_sheet(spark, f"{d}/roster.parquet")


@query("SELECT state_id, state_name, abbrev FROM ref_states")
def csv_round(spark, d):
    """The list of states written as CSV and read again with a fixed schema."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"
    t = table(spark, d, "ref_states").select("state_id", "state_name", "abbrev")
    write_csv(t, path)
    return csv(spark, path, t.schema)


@query()
def biographies_parsed(spark, d):
    """Biographies written as one text, with page marks and lettered fields, and split again."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/book-{uuid.uuid4().hex}"
    b = table(spark, d, "biographies").where("name is not null")
    part = lambda k, c: F.concat(F.lit(f" {k}-"), F.regexp_replace(F.coalesce(c, F.lit("")), parse.MARK, "$1 "))
    text = F.concat(F.lit("--- PAGE 7 ---\n"), F.regexp_replace("name", r"\s+", " "), F.lit("\na-"), F.coalesce("birth_date", F.lit("")), *[part(k, F.col(v)) for k, v in parse.FIELDS.items() if k != "a" and v in b.columns], F.lit("\n"))
    b.select(text.alias("value")).write.text(path)  # a file for each part of the table
    return parse.split_biographies(whole_text(spark, path)).select("bio_row", "name", "birth_date", "education", "govt_positions")
