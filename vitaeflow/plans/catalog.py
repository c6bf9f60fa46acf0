"""Queries of the relational and text operators, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions import text as X
from ..operators import clean, containment, fuzzy, graph, intervals, parse, relops
from ..sources.tables import table
from . import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- networks ------------------------------------------------------------------------

MOST_AT_FOCUS = 60
_FOCUS_SQL = f"""WITH {V.ED}, rec AS (SELECT person_id, organization || ' [' || coalesce(nullif(trim(degree_level), ''), 'pre/other') || '/' || CASE WHEN record_type = 'academic_role' THEN 'staff' ELSE 'student' END || ']' AS focus,
 year_start, coalesce(year_end, year_start) AS year_end, coalesce(nullif(trim(role_text), ''), nullif(trim(role_text_raw), '')) AS role FROM ed WHERE length(organization) >= 3 AND year_start IS NOT NULL),
 size AS (SELECT focus, count(DISTINCT person_id) AS focus_size FROM rec GROUP BY focus HAVING count(DISTINCT person_id) <= {MOST_AT_FOCUS}),
 co AS (SELECT e.person_id AS ego_id, a.person_id AS alter_id, e.focus, size.focus_size, e.role AS ego_role, a.role AS alter_role, greatest(e.year_start, a.year_start) AS year_start, least(e.year_end, a.year_end) AS year_end
 FROM rec e JOIN size USING (focus) JOIN rec a ON a.focus = e.focus WHERE e.person_id IN (SELECT person_id FROM roster) AND e.person_id <> a.person_id AND e.year_start <= a.year_end + 1 AND a.year_start <= e.year_end + 1)
"""


def _school_focus(spark: SparkSession, d: str) -> DataFrame:
    e = V.education(spark, d, "person_id", "organization", "degree_level", "record_type", "year_start", "year_end", "role_text", "role_text_raw")
    level = F.coalesce(F.nullif(F.trim("degree_level"), F.lit("")), F.lit("pre/other"))
    role = F.when(F.col("record_type") == "academic_role", "staff").otherwise("student")
    focus = F.when(F.length("organization") >= 3, F.concat("organization", F.lit(" ["), level, F.lit("/"), role, F.lit("]")))
    return e.select("person_id", focus.alias("focus"), "year_start", "year_end", F.coalesce(F.nullif(F.trim("role_text"), F.lit("")), F.nullif(F.trim("role_text_raw"), F.lit(""))).alias("role"))


def _co_located(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_location(_school_focus(spark, d), V.egos(spark, d), "focus", "person_id", "year_start", "year_end", "role", MOST_AT_FOCUS)


@query(_FOCUS_SQL + "SELECT * FROM co")
def coloc_edges(spark, d):
    """Egos and the people at the same school, level and role in overlapping years."""
    return _co_located(spark, d)


@query(_FOCUS_SQL + "SELECT ego_id, alter_id, focus, min(year_start) AS year_start, min(year_end) AS year_end, count(*) AS n FROM co GROUP BY ALL")
def coloc_pairs(spark, d):
    """One row per ego, alter and focus."""
    return _co_located(spark, d).groupBy("ego_id", "alter_id", "focus").agg(F.min("year_start").alias("year_start"), F.min("year_end").alias("year_end"), F.count("*").alias("n"))


@query(f"""WITH {V.ED}, size AS (SELECT organization, count(DISTINCT person_id) AS n FROM ed WHERE organization IS NOT NULL GROUP BY organization)
SELECT e.record_id, CASE WHEN s.n <= {MOST_AT_FOCUS} THEN e.organization WHEN trim(e.degree_field) <> '' THEN e.organization || ' | ' || e.degree_field END AS focus FROM ed e JOIN size s USING (organization)
WHERE CASE WHEN s.n <= {MOST_AT_FOCUS} THEN e.organization WHEN trim(e.degree_field) <> '' THEN e.organization || ' | ' || e.degree_field END IS NOT NULL""")
def focus_refined(spark, d):
    """Large schools are told apart by field of study; without one they are no focus."""
    e = V.education(spark, d, "person_id", "organization", "degree_field").where("organization is not null")
    size = e.groupBy("organization").agg(F.countDistinct("person_id").alias("n"))
    focus = F.when(F.col("n") <= MOST_AT_FOCUS, F.col("organization")).when(F.trim("degree_field") != "", F.concat("organization", F.lit(" | "), "degree_field"))
    return e.join(size, "organization").select("record_id", focus.alias("focus")).where("focus is not null")


# Names of the connections by field.
CONNECTIONS = {
    "govt_positions": "shared_government", "education": "shared_education", "party_positions": "shared_party", "public_positions": "shared_public_office", "labor_positions": "shared_labor", "other_positions": "shared_other",
}
_KINDS_SQL = "CASE t.field_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONNECTIONS.items()) + " END"
_WORK_SQL = f"""WITH {V.PP}, r AS (SELECT person_id, field_type, CASE WHEN length(trim(organization)) >= 3 THEN trim(organization) END AS org, state, year_start AS a, coalesce(year_end, year_start) AS b FROM pp
 WHERE field_type IN ('{"', '".join(CONNECTIONS)}') AND year_start IS NOT NULL),
 t AS (SELECT * FROM r WHERE person_id IN (SELECT person_id FROM roster)), o AS (SELECT * FROM r WHERE person_id NOT IN (SELECT person_id FROM roster WHERE person_id IS NOT NULL))
SELECT DISTINCT t.person_id AS person_a, o.person_id AS person_b, {_KINDS_SQL} AS connection_type, t.org AS detail FROM t JOIN o ON t.org = o.org AND t.field_type = o.field_type AND t.a <= o.b AND o.a <= t.b
UNION SELECT DISTINCT t.person_id, o.person_id, {_KINDS_SQL}, t.state FROM t JOIN o ON t.state = o.state AND t.field_type = o.field_type AND t.a <= o.b AND o.a <= t.b WHERE t.org IS NULL AND o.org IS NULL"""


@query(_WORK_SQL)
def coloc_org_then_state(spark, d):
    """Targets and others at one organisation at one time, or in one state where neither names an organisation."""
    r = V.positions(spark, d, "person_id", "field_type", "organization", "state", "year_start", "year_end").where(F.col("field_type").isin(*CONNECTIONS) & F.col("year_start").isNotNull())
    r = r.select("person_id", "field_type", F.when(F.length(F.trim("organization")) >= 3, F.trim("organization")).alias("org"), "state", F.col("year_start").alias("a"), F.coalesce("year_end", "year_start").alias("b"))
    ego = V.egos(spark, d)
    kinds = F.create_map(*[F.lit(x) for kv in CONNECTIONS.items() for x in kv])

    def linked(rows, key):
        rows = rows.where(F.col(key).isNotNull())
        t = rows.join(ego, "person_id", "left_semi").select(key, "field_type", F.col("person_id").alias("person_a"), "a", "b").distinct()
        o = rows.join(ego, "person_id", "left_anti").select(key, "field_type", F.col("person_id").alias("person_b"), F.col("a").alias("a2"), F.col("b").alias("b2")).distinct()
        # a focus that holds a third of all rows is met in buckets of years
        return intervals.bucketed_overlap_join(t, o, [key, "field_type"], ("a", "b"), ("a2", "b2")).select("person_a", "person_b", F.try_element_at(kinds, F.col("field_type")).alias("connection_type"), F.col(key).alias("detail"))

    return linked(r.where("org is not null"), "org").unionByName(linked(r.where("org is null"), "state")).distinct()


@query(f"""WITH {V.PP}, b AS (SELECT person_id, state, CAST(year(birth_date_clean) AS INTEGER) AS y FROM pp WHERE field_type = 'birthplace' AND state IS NOT NULL AND birth_date_clean IS NOT NULL)
SELECT DISTINCT t.person_id AS person_a, o.person_id AS person_b, t.state, abs(t.y - o.y) AS apart FROM b t JOIN b o ON t.state = o.state AND abs(t.y - o.y) <= 10
WHERE t.person_id IN (SELECT person_id FROM roster) AND o.person_id NOT IN (SELECT person_id FROM roster WHERE person_id IS NOT NULL)""")
def band_contemporaries(spark, d):
    """Egos and others born in the same state at most ten years apart."""
    b = V.domain(spark, d, "birthplace", "person_id", "state", "birth_date_clean").where("state is not null and birth_date_clean is not null").select("person_id", "state", F.year("birth_date_clean").alias("y"))
    ego = V.egos(spark, d)
    t = b.join(ego, "person_id", "left_semi").select("state", F.col("person_id").alias("person_a"), F.col("y").alias("ya"))
    o = b.join(ego, "person_id", "left_anti").select("state", F.col("person_id").alias("person_b"), F.col("y").alias("yb"))
    return intervals.band_join(t, o, ["state"], "ya", "yb", 10).select("person_a", "person_b", "state", F.abs(F.col("ya") - F.col("yb")).alias("apart")).distinct()


_PANEL_SQL = f"""WITH {V.PP}, q AS (SELECT DISTINCT person_id, election, election + k AS year FROM roster, unnest(range(-6, 7)) AS u(k)),
 r AS (SELECT person_id, record_id, year_start AS a, coalesce(year_end, year_start) AS b, coalesce(position_title, '') AS v, {V.order_case(V.case("role_text", rules.GOVT_RANK, "other"), rules.GOVT_ORDER)} AS o FROM pp WHERE field_type = 'govt_positions' AND year_start IS NOT NULL),
 h AS (SELECT q.person_id, q.year, r.v, row_number() OVER (PARTITION BY q.person_id, q.year ORDER BY r.o, r.record_id) AS k FROM (SELECT DISTINCT person_id, year FROM q) q JOIN r ON r.person_id = q.person_id AND q.year BETWEEN r.a AND r.b),
 panel AS (SELECT q.person_id, q.election, CAST(q.year AS INTEGER) AS year, CASE WHEN q.year < q.election THEN 'pre' WHEN q.year = q.election THEN 'election' ELSE 'post' END AS phase, coalesce(h.v, '') AS position FROM q LEFT JOIN h ON h.person_id = q.person_id AND h.year = q.year AND h.k = 1)
"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "roster").select("person_id", "election").distinct().withColumn("year", F.explode(F.sequence(F.col("election") - 6, F.col("election") + 6)))
    r = V.domain(spark, d, "govt_positions", "person_id", "year_start", "year_end", "position_title", "role_text")
    label = X.cascade(F.col("role_text"), rules.GOVT_RANK, "other")
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.GOVT_ORDER.items() for x in kv]), label), F.lit(99))
    r = r.select("person_id", "record_id", "year_start", "year_end", F.coalesce("position_title", F.lit("")).alias("position"), (-order).alias("score"))
    phase = F.when(F.col("year") < F.col("election"), "pre").when(F.col("year") == F.col("election"), "election").otherwise("post")
    return intervals.best_in_years(asked, r, "person_id", "year", "year_start", "year_end", "score", "record_id", "position").withColumn("phase", phase)


@query(_PANEL_SQL + "SELECT * FROM panel")
def position_in_year(spark, d):
    """Highest position of every candidate in each of the six years around the election."""
    return _panel(spark, d)


@query(_PANEL_SQL + "SELECT person_id, election, " + ", ".join(f"max(CASE WHEN year = election + {k} THEN position END) AS {'m' if k < 0 else 'p'}{abs(k)}" for k in range(-6, 7)) + " FROM panel GROUP BY person_id, election")
def position_panel_pivot(spark, d):
    """The same, one row per candidacy with a column per year."""
    at = F.col("year") - F.col("election")
    return _panel(spark, d).groupBy("person_id", "election").agg(*[F.max(F.when(at == k, F.col("position"))).alias(f"{'m' if k < 0 else 'p'}{abs(k)}") for k in range(-6, 7)])


@query(f"WITH {V.EDGES} SELECT ego_id, count(*) AS n_edges, count(DISTINCT alter_id) AS n_alters FROM eg GROUP BY ego_id")
def ego_degree(spark, d):
    """Edges and alters of every ego."""
    return graph.degrees(V.edges(spark, d))


@query(f"WITH {V.EDGES} SELECT alter_id, count(DISTINCT ego_id) AS n_egos FROM eg GROUP BY alter_id")
def alter_popularity(spark, d):
    """Egos of every alter."""
    return graph.popularity(V.edges(spark, d))


@query("SELECT DISTINCT person_id FROM roster WHERE person_id NOT IN (SELECT ego_id FROM tapado_edges WHERE ego_id IS NOT NULL AND edge_type = 'co_military')")
def zero_degree_egos(spark, d):
    """Candidates without an edge in the network of military service."""
    return V.egos(spark, d).join(table(spark, d, "tapado_edges").where("edge_type = 'co_military'").select(F.col("ego_id").alias("person_id")), "person_id", "left_anti")


@query("SELECT * EXCLUDE (rn) FROM (SELECT seq, ego_id, alter_id, edge_type, focus, year_start, year_end, row_number() OVER (PARTITION BY ego_id, alter_id, edge_type, focus, year_start, year_end ORDER BY seq) AS rn FROM tapado_edges) WHERE rn = 1")
def edges_keep_first(spark, d):
    """Repeated edges once, under their first number."""
    return relops.keep_first(table(spark, d, "tapado_edges").select("seq", *V.EDGE_KEYS), V.EDGE_KEYS, ["seq"])


@query("""WITH ids AS (SELECT ego_id AS person_id FROM tapado_edges UNION SELECT alter_id FROM tapado_edges), p AS (SELECT person_id, min(person_name) AS name FROM parsed_positions GROUP BY person_id),
r AS (SELECT person_id, string_agg(DISTINCT CAST(election AS VARCHAR), ';' ORDER BY CAST(election AS VARCHAR)) AS election_year, max(is_winner) AS is_winner FROM roster GROUP BY person_id)
SELECT ids.person_id, p.name, CASE WHEN r.election_year IS NULL THEN 0 ELSE 1 END AS is_ego, r.election_year, coalesce(r.is_winner, 0) AS is_winner FROM ids LEFT JOIN p USING (person_id) LEFT JOIN r USING (person_id) WHERE ids.person_id IS NOT NULL""")
def nodes_with_attrs(spark, d):
    """Node table of the network."""
    return graph.nodes(table(spark, d, "tapado_edges").select("ego_id", "alter_id"), table(spark, d, "parsed_positions").select("person_id", "person_name"), table(spark, d, "roster"))


_TIES_SQL = f"""WITH {V.EDGES}, ties AS (SELECT * FROM (SELECT ego_id, alter_id, alter_name, edge_type, {V.order_case("edge_type", rules.TIE_PRIORITY)} AS priority, row_number() OVER (PARTITION BY ego_id, alter_id ORDER BY {V.order_case("edge_type", rules.TIE_PRIORITY)}, seq) AS k FROM eg) WHERE k = 1)"""


@query(_TIES_SQL + " SELECT ego_id, alter_id, alter_name, edge_type, priority FROM ties")
def hub_primary_tie(spark, d):
    """The most telling tie of every ego and alter."""
    return graph.primary_ties(V.edges(spark, d), rules.TIE_PRIORITY)


_HUBS = ", hub AS (SELECT ego_id, row_number() OVER (ORDER BY n DESC, ego_id) AS k FROM (SELECT ego_id, count(DISTINCT alter_id) AS n FROM eg GROUP BY ego_id))"
_SIDES = _HUBS + """, one AS (SELECT * FROM ties WHERE ego_id = (SELECT ego_id FROM hub WHERE k = 1)), two AS (SELECT * FROM ties WHERE ego_id = (SELECT ego_id FROM hub WHERE k = 2)),
sides AS (SELECT coalesce(a.alter_id, b.alter_id) AS alter_id, coalesce(a.alter_name, b.alter_name) AS alter_name, CASE WHEN a.edge_type IS NOT NULL AND b.edge_type IS NOT NULL THEN 'shared' WHEN a.edge_type IS NOT NULL THEN 'one' ELSE 'other' END AS side,
a.edge_type AS tie_one, b.edge_type AS tie_other, least(coalesce(a.priority, b.priority), coalesce(b.priority, a.priority)) AS priority FROM one a FULL JOIN two b ON a.alter_id = b.alter_id)"""


def _sides(spark: SparkSession, d: str) -> DataFrame:
    e = V.edges(spark, d)
    first = [r[0] for r in e.groupBy("ego_id").agg(F.countDistinct("alter_id").alias("n")).orderBy(F.desc("n"), "ego_id").limit(2).collect()] + [-1, -1]
    return graph.compared_hubs(graph.primary_ties(e, rules.TIE_PRIORITY), first[0], first[1])


@query(_TIES_SQL + _SIDES + " SELECT * FROM sides")
def hub_shared_sets(spark, d):
    """Alters of the two largest egos: shared, or on one side only."""
    return _sides(spark, d)


@query(_TIES_SQL + _SIDES + " SELECT alter_id, side, CASE WHEN count(*) OVER (PARTITION BY side) > 1 THEN round(1.0 - 2.0 * (row_number() OVER (PARTITION BY side ORDER BY priority, alter_name, alter_id) - 1) / (count(*) OVER (PARTITION BY side) - 1), 6) ELSE 1.0 END AS y FROM sides")
def hub_layout(spark, d):
    """Even positions of the alters on each side."""
    return graph.stacked(_sides(spark, d), "side", [F.col("priority"), F.col("alter_name"), F.col("alter_id")]).select("alter_id", "side", "y")


@query(f"WITH {V.EDGES}, n AS (SELECT ego_id, election_year, count(DISTINCT alter_id) AS n_alters FROM eg GROUP BY ego_id, election_year), x AS (SELECT CAST(e AS INTEGER) AS election, ego_id, n_alters FROM n, unnest(string_split(election_year, ';')) AS u(e)) "
       "SELECT election, ego_id, n_alters, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY election ORDER BY n_alters DESC, ego_id) AS INTEGER) AS rank FROM x) WHERE rank <= 3")
def topk_competitors(spark, d):
    """The three best connected candidates of every election."""
    n = V.edges(spark, d).groupBy("ego_id", "election_year").agg(F.countDistinct("alter_id").alias("n_alters"))
    x = n.select(F.explode(F.split("election_year", ";")).alias("e"), "ego_id", "n_alters").select(F.expr("try_cast(e as int)").alias("election"), "ego_id", "n_alters")
    return relops.top_k(x, ["election"], [F.desc("n_alters"), F.asc("ego_id")], 3)


# ---- names -----------------------------------------------------------------------------

_PEOPLE_SQL = "p AS (SELECT person_id, min(person_name) AS person_name FROM parsed_positions WHERE person_name IS NOT NULL GROUP BY person_id)"


def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_positions").where("person_name is not null").groupBy("person_id").agg(F.min("person_name").alias("person_name"))


@query(f"""WITH {_PEOPLE_SQL}, q AS (SELECT DISTINCT name, {V.TOKENS_SQL.format(c="name")} AS qt FROM roster), pt AS (SELECT person_id, {V.TOKENS_SQL.format(c="person_name")} AS pt FROM p),
h AS (SELECT q.name, pt.person_id, len(list_intersect(q.qt, pt.pt)) AS overlap, len(q.qt) AS nq, len(pt.pt) AS np FROM q JOIN pt ON len(list_intersect(q.qt, pt.pt)) >= 2)
SELECT name, person_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY overlap DESC, np, person_id) AS k FROM h WHERE overlap >= nq - 1) WHERE k = 1""")
def fuzzy_match_top1(spark, d):
    """Roster names to persons by token overlap."""
    q = table(spark, d, "roster").select("name").distinct()
    return fuzzy.token_match(q, _people(spark, d), "name", "name", "person_id", "person_name")


_W = r"list_distinct(list_filter(string_split_regex(trim(regexp_replace(strip_accents(lower({c})), '[^a-z ]+', ' ', 'g')), ' +'), lambda x: length(x) >= 3))"


@query(f"""WITH {_PEOPLE_SQL}, q AS (SELECT DISTINCT name, {_W.format(c="name")} AS qw FROM roster), n AS (SELECT person_id, strip_accents(lower(person_name)) AS nm, {_W.format(c="person_name")} AS pw FROM p),
h AS (SELECT q.name, n.person_id, len(list_filter(q.qw, lambda w: contains(n.nm, w))) AS score, len(q.qw) AS nq FROM q JOIN n ON list_has_any(q.qw, n.pw))
SELECT name, person_id, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, person_id) AS k FROM h WHERE score >= CASE WHEN nq <= 2 THEN 1 ELSE 2 END) WHERE k = 1""")
def fuzzy_match_substring(spark, d):
    """Roster names to persons by words that are part of the name."""
    q = table(spark, d, "roster").select("name").distinct()
    return fuzzy.substring_match(q, _people(spark, d), "name", "name", "person_id", "person_name")


_OTOK = lambda c: f"list_distinct(list_filter(string_split_regex(trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda x: length(x) >= 2 AND x NOT IN {tuple(rules.ORGANIZATION_STOP)}))"
_PRE = "coalesce(" + ", ".join(f"CASE WHEN starts_with(lower(n), '{p}') THEN '{p}' END" for p in rules.ORGANIZATION_PREFIXES) + ", '')"
_SIM_SQL = f"""n AS (SELECT DISTINCT organization AS n FROM education WHERE organization IS NOT NULL), t AS (SELECT n, {_OTOK("n")} AS t, {_PRE} AS p FROM n),
u AS (SELECT n, p, t, list_filter(t, lambda w: NOT list_contains(string_split(p, ' '), w)) AS r FROM t),
x AS (SELECT a.n AS a, b.n AS b, a.p <> '' AND a.p = b.p AS same, a.t AS ta, b.t AS tb, a.r AS ra, b.r AS rb FROM u a JOIN u b ON a.n < b.n AND list_has_any(a.t, b.t)),
y AS (SELECT a, b, same, len(ra) AS la, len(rb) AS lb, round(CASE WHEN same THEN len(list_intersect(ra, rb)) / nullif(len(list_distinct(list_concat(ra, rb))), 0)::DOUBLE ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE END, 6) AS similarity FROM x),
pairs AS (SELECT a, b, similarity FROM y WHERE CASE WHEN same THEN la > 0 AND lb > 0 AND similarity >= 0.6 ELSE similarity >= 0.7 END)"""


@query(f"WITH {_SIM_SQL} SELECT * FROM pairs")
def token_block_jaccard(spark, d):
    """School names that are alike by their tokens."""
    return fuzzy.similar_names(table(spark, d, "education"), "organization")


_COMP_SQL = f"""WITH RECURSIVE {_SIM_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query(_COMP_SQL + " SELECT * FROM comp")
def org_components(spark, d):
    """Clusters of alike school names."""
    return graph.connected_components(fuzzy.similar_names(table(spark, d, "education"), "organization"))


@query(_COMP_SQL + """, o AS (SELECT organization AS name, min(record_id) AS seq FROM education WHERE organization IS NOT NULL GROUP BY organization), g AS (SELECT o.name, o.seq, coalesce(c.component, o.name) AS component FROM o LEFT JOIN comp c ON c.node = o.name),
best AS (SELECT component, name AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY length(name) DESC, seq) AS k FROM g) WHERE k = 1) SELECT g.name, best.canonical FROM g JOIN best USING (component)""")
def org_canonical(spark, d):
    """Every school name with the longest name of its cluster."""
    names = table(spark, d, "education").where("organization is not null").groupBy(F.col("organization").alias("name")).agg(F.min("record_id").alias("seq"))
    return graph.canonical_names(names, fuzzy.similar_names(names, "name"), "name", "seq")


@query(f"""WITH {_PEOPLE_SQL}, s AS (SELECT person_id, unnest({V.TOKENS_SQL.format(c="string_split(person_name, ',')[1]")}) AS t FROM p), e AS (SELECT * FROM s WHERE person_id IN (SELECT person_id FROM roster)),
m AS (SELECT least(e.person_id, s.person_id) AS x, greatest(e.person_id, s.person_id) AS y, min(e.person_id) AS ego_id, min(e.t) AS shared FROM e JOIN s ON e.t = s.t AND e.person_id <> s.person_id GROUP BY 1, 2)
SELECT ego_id, CASE WHEN ego_id = x THEN y ELSE x END AS alter_id, shared FROM m""")
def surname_pairs(spark, d):
    """People who share a surname with a candidate."""
    people = _people(spark, d)
    return fuzzy.surname_pairs(people.join(V.egos(spark, d), "person_id", "left_semi"), people, "person_id", "person_name")


_NAME = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(name)), '\\(deceased[^)]*\\)', '', 'g'), '\\(([^)]+)\\)', '\\1', 'g'), '[^a-z\\s]', '', 'g')), '\\s+', ' ', 'g')"


@query(f"SELECT bio_row, {_NAME} AS name_norm FROM biographies")
def name_normalized(spark, d):
    """Names for comparison."""
    return table(spark, d, "biographies").select("bio_row", X.normalize_name(F.col("name")).alias("name_norm"))


@query()
def accents_stripped(spark, d):
    """Texts of every script without accents."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.strip_accents(F.col("text")).alias("plain"))


_TOKS = V.TOKENS_SQL.format(c="person_name")


@query(f"SELECT person_id, array_to_string(list_sort({_TOKS}), ' ') AS tokens FROM (SELECT person_id, min(person_name) AS person_name FROM parsed_positions WHERE person_name IS NOT NULL GROUP BY person_id)")
def name_tokens(spark, d):
    """Tokens by which names are matched."""
    return _people(spark, d).select("person_id", F.array_join(F.array_sort(X.match_tokens(F.col("person_name"))), " ").alias("tokens"))


# ---- classification --------------------------------------------------------------------


def _classified(name: str, field: str, labels, default, column: str = "role_text"):
    sql = f"WITH {V.PP} SELECT record_id, {V.case(f'coalesce({column}, {chr(39) * 2})', labels, default)} AS label FROM pp WHERE field_type = '{field}'"

    def run(spark, d):
        return V.domain(spark, d, field, column).select("record_id", X.cascade(F.coalesce(column, F.lit("")), labels, default).alias("label"))

    run.__name__ = name
    query(sql)(run)


for _name, _field, _labels, _default in (
    ("classify_govt_rank", "govt_positions", rules.GOVT_RANK, "other"), ("classify_labor_rank", "labor_positions", rules.LABOR_RANK, "other"), ("classify_party_record", "party_positions", rules.PARTY_RECORD, "active_position"),
    ("classify_edu_record", "education", rules.EDU_RECORD, "other"), ("classify_degree_level", "education", rules.DEGREE_LEVEL, "undergraduate"), ("classify_degree_field", "education", rules.DEGREE_FIELD, "other"),
):
    _classified(_name, _field, _labels, _default)


@query(f"WITH {V.PP} SELECT record_id, {V.case('''coalesce(organization, '') || ' ' || coalesce(role_text, '')''', rules.SECTOR, 'other')} AS sector, CASE WHEN {V.like('''coalesce(organization, '') || ' ' || coalesce(role_text, '')''', rules.NATIONAL_ORG)} THEN true END AS is_national FROM pp WHERE field_type = 'labor_positions'")
def classify_sector(spark, d):
    """Sector and national standing of labor posts, from organisation and text together."""
    both = F.concat(F.coalesce("organization", F.lit("")), F.lit(" "), F.coalesce("role_text", F.lit("")))
    return V.domain(spark, d, "labor_positions", "organization", "role_text").select("record_id", X.cascade(both, rules.SECTOR, "other").alias("sector"), F.when(both.rlike(X.UI + rules.NATIONAL_ORG), F.lit(True)).alias("is_national"))


_BODY = f"coalesce({V.case('organization', rules.PARTY_BODY)}, {V.case('role_text', rules.PARTY_BODY)})"
_inlist = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_LEVEL = f"CASE WHEN body IN {_inlist(rules.NATIONAL_BODIES)} THEN 'national' WHEN body IN {_inlist(rules.STATE_BODIES)} THEN 'state' WHEN body IN {_inlist(rules.LOCAL_BODIES)} THEN 'local' WHEN {V.like('role_text', chr(92) + 'bnational' + chr(92) + 'b')} THEN 'national' WHEN {V.like('role_text', chr(92) + 'b(municipal|district|parish)' + chr(92) + 'b')} THEN 'local' WHEN state <> 'Federal District' THEN 'state' END"


def party_level(body, state, text):
    """Level of a party post: by its body, then by the text, then by its state."""
    return (
        F.when(body.isin(*rules.NATIONAL_BODIES), "national").when(body.isin(*rules.STATE_BODIES), "state").when(body.isin(*rules.LOCAL_BODIES), "local")
        .when(text.rlike(X.UI + r"\bnational\b"), "national").when(text.rlike(X.UI + r"\b(municipal|district|parish)\b"), "local").when(state != "Federal District", "state")
    )


@query(f"WITH {V.PP}, x AS (SELECT record_id, organization, role_text, state, coalesce({V.case('organization', rules.PARTY)}, {V.case('role_text', rules.PARTY)}) AS party, {_BODY} AS body FROM pp WHERE field_type = 'party_positions') SELECT record_id, party, body, {_LEVEL} AS level, CASE WHEN party IS NOT NULL THEN party IN ('PRI', 'PRM', 'PNR') END AS lineage FROM x")
def classify_two_source(spark, d):
    """Party, body and level of party posts: all patterns on the organisation first, then on the text."""
    x = V.domain(spark, d, "party_positions", "organization", "role_text", "state")
    sources = [F.col("organization"), F.col("role_text")]
    x = x.withColumn("party", X.cascade_sources(sources, rules.PARTY)).withColumn("body", X.cascade_sources(sources, rules.PARTY_BODY))
    return x.select("record_id", "party", "body", party_level(F.col("body"), F.col("state"), F.col("role_text")).alias("level"), F.when(F.col("party").isNotNull(), F.col("party").isin("PRI", "PRM", "PNR")).alias("lineage"))


@query(f"WITH {V.ED}, x AS (SELECT record_id, coalesce(role_text_raw, '') || ' ' || coalesce(organization, '') AS t FROM ed) SELECT record_id, CASE WHEN {V.like('t', rules.FOREIGN_SCHOOL)} AND NOT {V.like('t', rules.HOME_SCHOOL)} THEN true WHEN {V.like('t', rules.HOME_SCHOOL)} THEN false END AS is_foreign FROM x")
def tri_state_flag(spark, d):
    """Foreign degrees: yes, no or unknown."""
    t = F.concat_ws(" ", F.coalesce("role_text_raw", F.lit("")), F.coalesce("organization", F.lit("")))
    return V.education(spark, d, "role_text_raw", "organization").select("record_id", X.tri_state(t.rlike(X.UI + rules.FOREIGN_SCHOOL), t.rlike(X.UI + rules.HOME_SCHOOL)).alias("is_foreign"))


_MIL_SRC = "SELECT bio_row, CAST(generate_subscripts(string_split(field_j, ';'), 1) - 1 AS INTEGER) AS pos, trim(unnest(string_split(field_j, ';'))) AS entry FROM biographies WHERE field_j IS NOT NULL"
_MIL_SQL = f"""WITH s AS ({_MIL_SRC}), x AS (SELECT *, {V.case("entry", rules.BRANCH, "unknown")} AS b, {V.case("entry", rules.MILITARY_RANK, "unknown")} AS rank FROM s WHERE length(entry) >= 5)
SELECT bio_row, pos, CASE WHEN b = 'unknown' AND ({V.like("entry", rules.LIKELY_ARMY)} OR rank NOT IN ('unknown', 'vice_admiral')) THEN 'army' ELSE b END AS branch, rank, {", ".join(f"{V.like('entry', p)} AS {k}" for k, p in rules.MILITARY_FLAGS.items())} FROM x"""


def military_entries(spark: SparkSession, d: str) -> DataFrame:
    e = relops.split_entries(table(spark, d, "biographies").select("bio_row", "person_id", "field_j").where("field_j is not null"), "field_j").drop("field_j")
    b, rank = X.cascade(F.col("entry"), rules.BRANCH, "unknown"), X.cascade(F.col("entry"), rules.MILITARY_RANK, "unknown")
    e = e.withColumn("rank", rank).withColumn("branch", F.when((b == "unknown") & (F.col("entry").rlike(X.UI + rules.LIKELY_ARMY) | ~rank.isin("unknown", "vice_admiral")), "army").otherwise(b))
    return e.select("*", *[F.col("entry").rlike(X.UI + p).alias(k) for k, p in rules.MILITARY_FLAGS.items()])


@query(_MIL_SQL)
def classify_military(spark, d):
    """Branch, rank and flags of military entries."""
    return military_entries(spark, d).drop("person_id", "entry")


# ---- one row per person ------------------------------------------------------------------

_GOVT_SQL = f"g AS (SELECT *, {V.case('coalesce(role_text, chr(0))', rules.GOVT_RANK, 'other')} AS rank FROM pp WHERE field_type = 'govt_positions')"
_EVER = {"ever_secretary": "secretary", "ever_subsecretary": "subsecretary", "ever_director_general": "director_general", "ever_governor": "governor", "ever_ambassador": "ambassador"}


@query(f"""WITH {V.PP}, {_GOVT_SQL}, o AS (SELECT *, {V.order_case("rank", rules.GOVT_ORDER)} AS ro FROM g)
SELECT person_id, count(*) AS n_positions, min(year_start) AS first_year, max(year_end) AS last_year, {", ".join(f"max(CASE WHEN rank = '{v}' THEN 1 ELSE 0 END) AS {k}" for k, v in _EVER.items())},
arg_min(rank, (ro, record_id)) AS highest_rank, arg_min(coalesce(state, '?'), record_id) AS first_state FROM o GROUP BY person_id""")
def wide_govt(spark, d):
    """Span, dummies, best rank and first state of every person's government posts."""
    g = V.domain(spark, d, "govt_positions", "person_id", "role_text", "state", "year_start", "year_end").withColumn("rank", X.cascade(F.coalesce("role_text", F.lit("\0")), rules.GOVT_RANK, "other"))
    return g.groupBy("person_id").agg(
        F.count("*").alias("n_positions"), F.min("year_start").alias("first_year"), F.max("year_end").alias("last_year"), *[relops.ever(F.col("rank") == v).alias(k) for k, v in _EVER.items()],
        relops.best_by_order(F.col("rank"), rules.GOVT_ORDER, F.col("record_id")).alias("highest_rank"), relops.first_of_group(F.col("record_id"), F.coalesce("state", F.lit("?"))).alias("first_state"))


@query(f"""WITH {V.PP}, c AS (SELECT person_id, organization, count(*) AS n, min(record_id) AS s FROM pp WHERE field_type = 'govt_positions' AND organization IS NOT NULL GROUP BY 1, 2)
SELECT person_id, organization AS main_organization FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, s) AS k FROM c) WHERE k = 1""")
def wide_mode(spark, d):
    """Most frequent organisation of every person, the first one among equals."""
    return relops.mode_first(V.domain(spark, d, "govt_positions", "person_id", "organization"), "person_id", "organization", "record_id", "main_organization")


@query(f"""WITH {V.PP}, x AS (SELECT person_id, {V.case('''coalesce(organization, '') || ' ' || coalesce(role_text, '')''', rules.SECTOR, 'other')} AS sector, {V.case('''coalesce(role_text, '')''', rules.LABOR_RANK, 'other')} AS rank, record_id, year_start, year_end FROM pp WHERE field_type = 'labor_positions')
SELECT person_id, count(*) AS n_positions, min(year_start) AS first_year, max(year_end) AS last_year, string_agg(DISTINCT sector, '|' ORDER BY sector) AS sectors, arg_min(rank, ({V.order_case('rank', rules.LABOR_ORDER)}, record_id)) AS highest_rank FROM x GROUP BY person_id""")
def wide_labor(spark, d):
    """Sectors and best rank of every person's labor posts."""
    both = F.concat(F.coalesce("organization", F.lit("")), F.lit(" "), F.coalesce("role_text", F.lit("")))
    x = V.domain(spark, d, "labor_positions", "person_id", "organization", "role_text", "year_start", "year_end").withColumn("sector", X.cascade(both, rules.SECTOR, "other")).withColumn("rank", X.cascade(F.coalesce("role_text", F.lit("")), rules.LABOR_RANK, "other"))
    return x.groupBy("person_id").agg(F.count("*").alias("n_positions"), F.min("year_start").alias("first_year"), F.max("year_end").alias("last_year"), relops.sorted_set(F.col("sector")).alias("sectors"), relops.best_by_order(F.col("rank"), rules.LABOR_ORDER, F.col("record_id")).alias("highest_rank"))


@query(f"""WITH {V.PP}, x AS (SELECT person_id, record_id, organization, {V.case('''coalesce(role_text, '')''', rules.PARTY_RECORD, 'active_position')} AS kind FROM pp WHERE field_type = 'party_positions')
SELECT person_id, count(DISTINCT organization) AS n_parties, string_agg(DISTINCT organization, '|' ORDER BY organization) AS parties_all, count(*) AS n_positions, count(CASE WHEN kind = 'active_position' THEN 1 END) AS n_active FROM x GROUP BY person_id""")
def wide_party(spark, d):
    """Parties and active posts of every person."""
    x = V.domain(spark, d, "party_positions", "person_id", "organization", "role_text")
    kind = X.cascade(F.coalesce("role_text", F.lit("")), rules.PARTY_RECORD, "active_position")
    return x.groupBy("person_id").agg(F.countDistinct("organization").alias("n_parties"), relops.sorted_set(F.col("organization")).alias("parties_all"), F.count("*").alias("n_positions"), F.count(F.when(kind == "active_position", 1)).alias("n_active"))


_LEVELS = tuple(rules.LEVEL_ORDER)
_FIELDS = (*[k for k, _ in rules.DEGREE_FIELD], "other")
_DUMMIES = {"pre_university": "record_type = 'pre_university'", "academic_role_edu": "record_type = 'academic_role'", "has_degree": "record_type = 'degree'"}
_DUMMIES |= {x: f"record_type = 'degree' AND degree_level = '{x}'" for x in _LEVELS} | {f"field_{x}": f"record_type = 'degree' AND degree_field = '{x}'" for x in _FIELDS} | {"foreign_degree": "record_type = 'degree' AND foreign_degree"}


@query(f"""WITH {V.ED} SELECT person_id, {", ".join(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) AS {n}" for n, c in _DUMMIES.items())},
arg_min(organization, ({V.order_case("coalesce(degree_level, '')", rules.LEVEL_ORDER)}, record_id)) FILTER (WHERE organization IS NOT NULL AND record_type = 'degree') AS institution FROM ed GROUP BY person_id""")
def wide_education(spark, d):
    """Dummies of kinds, levels and fields, and the school of the highest degree of every person."""
    e = V.education(spark, d, "person_id", "degree_level", "degree_field", "foreign_degree", "organization", "record_type")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.LEVEL_ORDER.items() for x in kv]), F.coalesce("degree_level", F.lit(""))), F.lit(99))
    pick = F.min(F.when(F.col("organization").isNotNull() & (F.col("record_type") == "degree"), F.struct(rank.alias("r"), F.col("record_id").alias("s"), F.col("organization").alias("o"))))["o"]
    return e.groupBy("person_id").agg(*[relops.ever(F.expr(c)).alias(n) for n, c in _DUMMIES.items()], pick.alias("institution"))


@query(f"WITH m AS ({_MIL_SQL}) SELECT b.person_id, count(*) AS n_entries, max(CASE WHEN branch = 'army' THEN 1 ELSE 0 END) AS branch_army, CAST(sum(CAST(is_commander AS INTEGER)) AS BIGINT) AS n_commands, coalesce(arg_min(rank, ({V.order_case('rank', rules.MILITARY_ORDER)}, m.bio_row * 1000 + pos)) FILTER (WHERE rank <> 'unknown'), 'unknown') AS highest_rank FROM m JOIN biographies b USING (bio_row) GROUP BY b.person_id")
def wide_military(spark, d):
    """Branch, commands and best known rank of every person."""
    m = military_entries(spark, d)
    best = relops.best_by_order(F.col("rank"), rules.MILITARY_ORDER, F.col("bio_row") * 1000 + F.col("pos"), skip=("unknown",))
    return m.groupBy("person_id").agg(F.count("*").alias("n_entries"), relops.ever(F.col("branch") == "army").alias("branch_army"), F.sum(F.col("is_commander").cast("int")).alias("n_commands"), F.coalesce(best, F.lit("unknown")).alias("highest_rank"))


@query(f"WITH {V.PP} SELECT field_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pp WHERE field_type IS NOT NULL), 4) AS pct FROM pp WHERE field_type IS NOT NULL GROUP BY field_type")
def freq_pct(spark, d):
    """Records by field with their share."""
    return relops.frequencies(V.positions(spark, d, "field_type"), "field_type")


@query(f"WITH {V.ED}, w AS (SELECT person_id, max(CASE WHEN foreign_degree THEN 1 ELSE 0 END) AS f, max(CASE WHEN degree_level = 'phd' THEN 1 ELSE 0 END) AS p FROM ed GROUP BY person_id) SELECT round(avg(f), 6) AS share_foreign, round(avg(p), 6) AS share_phd FROM w")
def dummy_means(spark, d):
    """Share of persons with a foreign degree and with a doctorate."""
    w = V.education(spark, d, "person_id", "foreign_degree", "degree_level").groupBy("person_id").agg(relops.ever(F.col("foreign_degree")).alias("f"), relops.ever(F.col("degree_level") == "phd").alias("p"))
    return w.agg(F.round(F.avg("f"), 6).alias("share_foreign"), F.round(F.avg("p"), 6).alias("share_phd"))


@query(f"WITH {V.ED} SELECT degree_level, degree_field, count(*) AS n FROM ed GROUP BY degree_level, degree_field")
def null_groups_kept(spark, d):
    """Records by two keys; unknown values are groups of their own."""
    return V.education(spark, d, "degree_level", "degree_field").groupBy("degree_level", "degree_field").agg(F.count("*").alias("n"))


# ---- places, years, dates ---------------------------------------------------------------


@query(f"WITH {V.PP} SELECT record_id, {V.state_sql('role_text_raw')} AS state_found FROM pp")
def lookup_longest_first(spark, d):
    """State named in every role text: states, federal offices, cities."""
    return V.positions(spark, d, "role_text_raw").select("record_id", X.state_in_text(F.col("role_text_raw")).alias("state_found"))


@query(f"WITH {V.ED} SELECT record_id, coalesce({V.contained_sql(V.plain_sql('organization'), sorted(rules.INSTITUTION_STATE.items(), key=lambda e: -len(e[0])))}, {V.state_sql('organization')}) AS state_found FROM ed")
def lookup_school(spark, d):
    """State of every school."""
    return V.education(spark, d, "organization").select("record_id", X.state_of_school(F.col("organization")).alias("state_found"))


_STATE_OF = lambda c: f"(CASE {c} " + " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in rules.STATE_VARIANTS) + " END)"
_STATE_OF_CITY = lambda c: f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CITY_STATE.items()) + " END)"
_CAPTURED = [V.plain_sql(f"trim(regexp_extract(role_text_raw, '{p}', 1))") for p in rules.OFFICE_STATE]


@query(f"WITH {V.PP} SELECT record_id, coalesce({', '.join(_STATE_OF(c) for c in _CAPTURED[:3])}, {_STATE_OF_CITY(_CAPTURED[3])}, {V.state_sql('role_text_raw')}) AS state_found FROM pp WHERE field_type = 'public_positions'")
def lookup_office(spark, d):
    """State of every public office, captured after its title first."""
    return V.domain(spark, d, "public_positions", "role_text_raw").select("record_id", X.state_of_office(F.col("role_text_raw")).alias("state_found"))


_Y0, _Y1, _STRIP = (V.YEARS_SQL.format(c="role_text_raw", g=1), V.YEARS_SQL.format(c="role_text_raw", g=2), V.STRIP_SQL.format(c="role_text_raw"))


def _years_of(positions: DataFrame) -> DataFrame:
    a, b = X.years(F.col("role_text_raw"))
    return positions.select("record_id", a.alias("y0"), b.alias("y1"), X.strip_years(F.col("role_text_raw")).alias("role"))


@query(f"WITH {V.PP} SELECT record_id, {_Y0} AS y0, {_Y1} AS y1, {_STRIP} AS role FROM pp")
def year_extract(spark, d):
    """Years of every role text, and the text without them."""
    return _years_of(V.positions(spark, d, "role_text_raw"))


@query(f"WITH {V.PP} SELECT record_id, try_cast(coalesce(nullif(regexp_extract(role_text_raw, '(\\d{{4}})\\s*[-–]\\s*(\\d{{4}})', 1), ''), nullif(regexp_extract(role_text_raw, '(\\d{{4}})', 1), '')) AS INTEGER) AS y0, try_cast(nullif(regexp_extract(role_text_raw, '(\\d{{4}})\\s*[-–]\\s*(\\d{{4}})', 2), '') AS INTEGER) AS y1 FROM pp")
def year_extract_first(spark, d):
    """The variant that takes the first number and leaves a single year open."""
    a, b = X.years(F.col("role_text_raw"), "first")
    return V.positions(spark, d, "role_text_raw").select("record_id", a.alias("y0"), b.alias("y1"))


_REP = "CASE WHEN year_end < year_start THEN {x} ELSE {y} END"


@query(f"""WITH {V.PP}, s AS (SELECT record_id, {_REP.format(x='year_end', y='year_start')} AS a, {_REP.format(x='year_start', y='year_end')} AS b, year_start, year_end FROM pp), l AS (SELECT *, CASE WHEN a < 1880 AND b >= 1880 THEN b ELSE a END AS low FROM s)
SELECT record_id, low AS y0, CASE WHEN b > 2009 AND low <= 2009 THEN low ELSE b END AS y1, CASE WHEN year_start IS NOT NULL AND year_end IS NOT NULL THEN greatest(year_end - year_start, 0) END AS years_in_post FROM l""")
def year_repair(spark, d):
    """Years in order and within bounds; years in post never negative."""
    a, b = X.repaired_years(F.col("year_start"), F.col("year_end"), 1880, 2009)
    return V.positions(spark, d, "year_start", "year_end").select("record_id", a.alias("y0"), b.alias("y1"), X.years_in_post(F.col("year_start"), F.col("year_end")).alias("years_in_post"))


_DT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({c}), ';.*$', ''), '\bSept\b', 'Sep', 'g'), '\bJune\b', 'Jun', 'g'), '\bJuly\b', 'Jul', 'g'), '[.,]', ' ', 'g'), '\s+', ' ', 'g'))"
_MON = r"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(regexp_extract(t, '^([A-Za-z]+)', 1), 1, 3)))"
_FULL_DATE = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december) \d{1,2} \d{4}$"


def dates_sql(source: str, c: str) -> str:
    """Steps x, y and z over a source that read a date as people write it."""
    return rf"""x AS (SELECT *, trim({c}) AS s, {_DT.format(c=c)} AS t FROM {source}),
y AS (SELECT *, regexp_matches(s, '^\d{{4}}s$') AS dec, s IS NULL OR s = '' OR regexp_matches(s, '\bmp\b') OR NOT regexp_matches(s, '\d') AS junk, regexp_matches(t, '^\d{{4}}$') AS yo, regexp_matches(t, '^[A-Za-z]+ \d{{4}}$') AS my, regexp_matches(t, '{_FULL_DATE}') AS full_ FROM x),
z AS (SELECT *, CASE WHEN dec OR junk THEN NULL WHEN yo THEN make_date(CAST(t AS INTEGER), 1, 1) WHEN my THEN make_date(CAST(right(t, 4) AS INTEGER), CAST({_MON} AS INTEGER), 1) WHEN full_ THEN make_date(CAST(right(t, 4) AS INTEGER), CAST({_MON} AS INTEGER), CAST(regexp_extract(t, ' (\d{{1,2}}) ', 1) AS INTEGER)) END AS date FROM y)"""


@query(rf"""WITH {dates_sql("biographies", "birth_date")}
SELECT bio_row, CAST(date AS VARCHAR) AS date, CASE WHEN dec THEN 'decade' WHEN junk THEN 'unparseable' WHEN yo THEN 'year_only' WHEN my THEN 'month_year' WHEN date IS NOT NULL THEN 'full' ELSE 'unparseable' END AS precision, CAST(CASE WHEN dec THEN CAST(left(s, 4) AS INTEGER) ELSE year(date) // 10 * 10 END AS INTEGER) AS decade FROM z""")
def date_parse_precision(spark, d):
    """Birth dates as people wrote them: date, precision and decade."""
    b = table(spark, d, "biographies").select("bio_row", X.parse_date(F.col("birth_date")).alias("p"))
    return b.select("bio_row", F.col("p.date").cast("string").alias("date"), "p.precision", "p.decade")


_BARE_NAME = r"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(regexp_replace(regexp_replace(name, '(?i)\s*\(deceased[^)]*\)', '', 'g'), '[()]', '', 'g')), '[^A-Za-z\s,\-]', ' ', 'g'), '\s{2,}', ' ', 'g')), '\s+,', ',', 'g'), '^[ ,]+|[ ,]+$', '', 'g')"
_SHOWN_NAME = f"array_to_string(list_transform(regexp_extract_all({_BARE_NAME}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
for _w in rules.NAME_CONNECTORS:
    _SHOWN_NAME = f"regexp_replace({_SHOWN_NAME}, '\\b{_w}\\b', '{_w.lower()}', 'g')"
_SHOWN_NAME = f"coalesce({_SHOWN_NAME}, '')"
_NOTE = r"n AS (SELECT bio_row, name, trim(regexp_extract(name, '(?i)\(Deceased\s*([^)]*)\)', 1)) AS note FROM biographies), l AS (SELECT *, CASE WHEN regexp_matches(note, '[A-Za-z]') THEN note END AS written FROM n)"


@query(f"WITH {_NOTE}, {dates_sql('l', 'written')} SELECT bio_row, {_SHOWN_NAME} AS name_clean, coalesce(regexp_matches(name, '(?i)\\(Deceased'), false) AS deceased, CAST(CASE WHEN regexp_matches(note, '^\\d{{4}}$') THEN CAST(note AS INTEGER) ELSE year(date) END AS INTEGER) AS death_year, CAST(date AS VARCHAR) AS death_date FROM z")
def name_split(spark, d):
    """Display name, death note, year and date of death."""
    parts = X.split_person(F.col("name"))
    parts["death_date"] = parts["death_date"].cast("string")
    return table(spark, d, "biographies").select("bio_row", *[c.alias(n) for n, c in parts.items()])


# ---- splitting and repairing text ---------------------------------------------------------

_SPLIT = "SELECT bio_row, CAST(generate_subscripts(string_split({c}, ';'), 1) - 1 AS INTEGER) AS pos, trim(unnest(string_split({c}, ';'))) AS entry FROM biographies WHERE {c} IS NOT NULL"


@query(f"WITH s AS ({_SPLIT.format(c='govt_positions')}) SELECT * FROM s WHERE length(entry) >= 5")
def entry_split_explode(spark, d):
    """Entries of the government cells."""
    return relops.split_entries(table(spark, d, "biographies").select("bio_row", "govt_positions"), "govt_positions").drop("govt_positions")


MOST_ENTRIES = 36  # fixed value: the longest cell of the model
_AT = lambda i: f"nullif(trim(string_split(govt_positions, ';')[{i + 1}]), '')"


@query("SELECT bio_row, " + ", ".join(f"{_AT(i)} AS entry_{i}, {V.YEARS_SQL.format(c=_AT(i), g=1)} AS start_{i}, {V.YEARS_SQL.format(c=_AT(i), g=2)} AS end_{i}" for i in range(MOST_ENTRIES)) + " FROM biographies")
def positional_wide(spark, d):
    """The government entries side by side, each with its first and last year."""
    cells = relops.positional_wide(F.col("govt_positions"), MOST_ENTRIES)
    years = [X.years(F.col(f"entry_{i}")) for i in range(MOST_ENTRIES)]
    wide = table(spark, d, "biographies").select("bio_row", *[c.alias(f"entry_{i}") for i, c in enumerate(cells)])
    return wide.select("*", *[c.alias(f"{n}_{i}") for i, y in enumerate(years) for n, c in zip(("start", "end"), y)])


_BIO = ("public_positions", "party_positions", "govt_positions", "labor_positions", "other_positions")
_ENTRIES = " UNION ALL ".join(f"SELECT bio_row, {i} AS ordinal, '{f}' AS field_type, pos, entry FROM ({_SPLIT.format(c=f)})" for i, f in enumerate(_BIO))


@query(f"WITH s AS ({_ENTRIES}) SELECT bio_row, ordinal, field_type, pos, entry AS role_text_raw, {V.STRIP_SQL.format(c='entry')} AS role_text, {V.YEARS_SQL.format(c='entry', g=1)} AS year_start, {V.YEARS_SQL.format(c='entry', g=2)} AS year_end FROM s WHERE length(entry) >= 5")
def entries_parsed(spark, d):
    """Entries of all position cells, of several lines too, as dated records."""
    b = table(spark, d, "biographies").select("bio_row", *_BIO)
    return parse.entries_to_records(b, ["bio_row"], _BIO).drop("state")


@query("WITH k AS (SELECT bio_row, personal_info AS t FROM biographies WHERE personal_info IS NOT NULL), m AS (" + " UNION ALL ".join(f"SELECT bio_row, '{k}' AS kind, {i} AS pattern, unnest(regexp_extract_all(t, '(?i){p}', 1)) AS m FROM k" for i, (k, p) in enumerate(rules.MENTIONS))
       + f"), x AS (SELECT bio_row, kind, pattern, trim(regexp_replace(m, '(?i){rules.MENTION_TAIL}', '')) AS mention FROM m) SELECT * FROM x WHERE length(mention) >= 4")
def relation_mentions(spark, d):
    """Relations named in the personal notes."""
    return parse.mentions(table(spark, d, "biographies"), ["bio_row"], "personal_info", rules.MENTIONS, rules.MENTION_TAIL)


_BOTH_CELLS = "concat_ws(' ', field_j, coalesce(govt_positions, ''))"
_UNITS = rf"""list_transform(regexp_extract_all({_BOTH_CELLS}, '(?i)\b(\d{{1,3}}(?:st|nd|rd|th)?\s+(?:Battalion|Regiment|Division|Brigade|Cavalry|Infantry|Corps|Military Zone))\b', 1), lambda m: array_to_string(list_transform(string_split(regexp_replace(m, '(?i)(\d+)(st|nd|rd|th)?\s+', '\1 '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '))"""
_CHIEFS = rf"""list_transform(regexp_extract_all({_BOTH_CELLS}, 'under (?:General|Gen\.?|Col\.?|Colonel|Brigadier(?: General)?) ([A-Z][\pL.]+(?:\s+[A-Z][\pL.]+){{1,3}})', 1), lambda m: 'under Gen. ' || trim(m))"""


@query(f"WITH x AS (SELECT bio_row, unnest(list_distinct(list_concat({_UNITS}, {_CHIEFS}))) AS focus FROM biographies WHERE field_j IS NOT NULL) SELECT bio_row, focus FROM x")
def multi_match_explode(spark, d):
    """Military units and commanders named in a biography, one row each."""
    t = F.concat_ws(" ", "field_j", F.coalesce("govt_positions", F.lit("")))
    return table(spark, d, "biographies").where("field_j is not null").select("bio_row", F.explode(parse.units_and_commanders(t)).alias("focus"))


_VARIANTS = ", ".join("('" + k.lower().replace(".", "\\.") + f"', '{v}')" for k, v in rules.STATE_VARIANTS)


@query(f"SELECT DISTINCT b.bio_row, v.state AS state_found FROM biographies b JOIN (VALUES {_VARIANTS}) v(k, state) ON regexp_matches(strip_accents(lower(b.birthplace)), '\\b' || v.k || '\\b')")
def states_named(spark, d):
    """States named in the birthplaces; a state's name before a word for a unit would not count."""
    b = table(spark, d, "biographies").where("birthplace is not null").select("bio_row", "birthplace")
    return b.select("bio_row", F.explode(parse.states_named(F.col("birthplace"), rules.STATE_VARIANTS)).alias("state_found"))


@query("WITH f AS (SELECT person_name, min(record_id) AS s FROM parsed_positions WHERE person_name IS NOT NULL GROUP BY person_name) SELECT person_name, row_number() OVER (ORDER BY s, person_name) AS person_key FROM f")
def surrogate_ids(spark, d):
    """Person keys by first appearance of the name."""
    return relops.surrogate_ids(table(spark, d, "parsed_positions"), "person_name", "record_id", "person_key").withColumn("person_key", F.col("person_key").cast("long"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_keep_first(spark, d):
    """Equal texts once, under the smallest id."""
    return relops.keep_first(table(spark, d, "documents").where("text is not null").select("text", "doc_id"), ["text"], ["doc_id"])


_FIX = f"WITH {V.PP}, x AS (SELECT record_id, year_start, year_end, {_REP.format(x='year_end', y='year_start')} AS a, {_REP.format(x='year_start', y='year_end')} AS b, state, CASE WHEN state IS NULL THEN {V.state_sql('role_text_raw')} ELSE state END AS state_new FROM pp)"


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    x = V.positions(spark, d, "year_start", "year_end", "state", "role_text_raw")
    swap = F.col("year_end") < F.col("year_start")
    return x.select("record_id", "year_start", "year_end", F.when(swap, F.col("year_end")).otherwise(F.col("year_start")).alias("a"), F.when(swap, F.col("year_start")).otherwise(F.col("year_end")).alias("b"), "state", F.when(F.col("state").isNull(), X.state_in_text(F.col("role_text_raw"))).otherwise(F.col("state")).alias("state_new"))


@query(_FIX + " SELECT record_id, CAST(a IS DISTINCT FROM year_start OR b IS DISTINCT FROM year_end OR state_new IS DISTINCT FROM state AS INTEGER) AS modified FROM x")
def changed_flag(spark, d):
    """Whether the repair of years and state changed a record."""
    c = F.col
    return _fixed(spark, d).select("record_id", relops.changed([(c("a"), c("year_start")), (c("b"), c("year_end")), (c("state_new"), c("state"))]).alias("modified"))


@query(_FIX + " SELECT state AS old, state_new AS new, count(*) AS n FROM x WHERE state IS DISTINCT FROM state_new GROUP BY 1, 2")
def change_breakdown(spark, d):
    """What the repair of the state changed into what."""
    return relops.change_breakdown(_fixed(spark, d), "state", "state_new")


@query("SELECT seq, edge_type FROM tapado_edges WHERE edge_type IS DISTINCT FROM 'personal' UNION ALL SELECT -min(seq), 'personal' FROM tapado_edges GROUP BY ego_id")
def upsert_replace(spark, d):
    """Edges of one kind replaced by fresh ones."""
    e = table(spark, d, "tapado_edges").select("seq", "ego_id", "edge_type")
    fresh = e.groupBy("ego_id").agg((-F.min("seq")).alias("seq")).select("seq", F.lit("personal").alias("edge_type"))
    return relops.upsert(e.select("seq", "edge_type"), fresh, F.col("edge_type") == "personal")


@query("SELECT e.seq, coalesce(r.is_winner, 0) AS is_winner, coalesce(r.name, e.ego_name) AS ego_name FROM tapado_edges e JOIN (SELECT person_id, max(is_winner) AS is_winner, min(name) AS name FROM roster GROUP BY person_id) r ON e.ego_id = r.person_id WHERE r.is_winner = 1")
def override_join(spark, d):
    """Edges a review keeps, under the review's names."""
    e = table(spark, d, "tapado_edges").select("seq", F.col("ego_id").alias("person_id"), "ego_name", "is_winner")
    review = table(spark, d, "roster").groupBy("person_id").agg(F.max("is_winner").alias("won"), F.min("name").alias("label"))
    return relops.override(e, review, ["person_id"], F.col("won") == 1, {"ego_name": F.col("label"), "is_winner": F.col("won")}).select("seq", "is_winner", "ego_name")


@query("WITH v AS (SELECT DISTINCT ego_id, alter_id, 'yes' AS related FROM tapado_edges WHERE edge_type = 'family') SELECT DISTINCT e.ego_id, e.alter_id, coalesce(v.related, 'no') AS related FROM tapado_edges e LEFT JOIN v USING (ego_id, alter_id)")
def verdict_join(spark, d):
    """Verdicts by pair, ``no`` where there is none."""
    e = table(spark, d, "tapado_edges").select("ego_id", "alter_id", "edge_type")
    v = e.where("edge_type = 'family'").select("ego_id", "alter_id", F.lit("yes").alias("related"))
    return relops.with_verdicts(e.select("ego_id", "alter_id").distinct(), v, ["ego_id", "alter_id"], {"related": "no"})


@query("SELECT DISTINCT person_id FROM parsed_positions WHERE person_id IN (SELECT ego_id FROM tapado_edges UNION SELECT alter_id FROM tapado_edges)")
def semi_filter(spark, d):
    """Persons of the positions that are in the network."""
    e = table(spark, d, "tapado_edges")
    ids = e.select(F.col("ego_id").alias("person_id")).union(e.select("alter_id"))
    return table(spark, d, "parsed_positions").select("person_id").distinct().join(ids, "person_id", "left_semi")


@query("SELECT DISTINCT person_id FROM parsed_positions WHERE person_id NOT IN (SELECT ego_id FROM tapado_edges WHERE ego_id IS NOT NULL AND edge_type = 'co_military' UNION SELECT alter_id FROM tapado_edges WHERE alter_id IS NOT NULL AND edge_type = 'co_military')")
def anti_filter(spark, d):
    """Persons of the positions that are not in the network of military service."""
    e = table(spark, d, "tapado_edges").where("edge_type = 'co_military'")
    ids = e.select(F.col("ego_id").alias("person_id")).union(e.select("alter_id"))
    return table(spark, d, "parsed_positions").select("person_id").distinct().join(ids, "person_id", "left_anti")


@query("SELECT person_id, 'biography' AS source, name AS label, NULL AS field_type FROM biographies UNION ALL SELECT person_id, 'position', NULL, field_type FROM parsed_positions")
def union_allow_missing(spark, d):
    """Rows of two tables in one; what a table lacks is null."""
    b = table(spark, d, "biographies").select("person_id", F.lit("biography").alias("source"), F.col("name").alias("label"))
    p = table(spark, d, "parsed_positions").select("person_id", F.lit("position").alias("source"), "field_type")
    return b.unionByName(p, allowMissingColumns=True)


@query("SELECT bio_row, lag(sources) OVER (ORDER BY bio_row) AS sources_before FROM biographies")
def lag_repair(spark, d):
    """Sources of the row before, read across range partitions with the last row of each carried over."""
    b = table(spark, d, "biographies").select("bio_row", "sources")
    n = relops.numbered(b, ["bio_row"], "k")
    return n.join(n.select((F.col("k") + 1).alias("k"), F.col("sources").alias("sources_before")), "k", "left").select("bio_row", "sources_before")


@query("SELECT b.bio_row, count(d.doc_id) AS n_docs FROM (SELECT bio_row, person_id FROM biographies) b LEFT JOIN documents d ON d.subject_id = b.person_id GROUP BY b.bio_row")
def attribute_join(spark, d):
    """Documents about the subject of every biography; counted before the join, so a hot subject moves one row per task."""
    n = table(spark, d, "documents").where("subject_id is not null").groupBy(F.col("subject_id").alias("person_id")).agg(F.count("*").alias("n_docs"))
    return table(spark, d, "biographies").select("bio_row", "person_id").join(n, "person_id", "left").select("bio_row", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.n') AS INTEGER) AS n FROM events")
def json_reply_parse(spark, d):
    """Fields of a JSON answer; junk gives null."""
    p = F.from_json("props", "k string, n int")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), p["n"].alias("n"))


@query(f"WITH {V.PP} SELECT record_id, trim(regexp_replace(regexp_replace(role_text_raw, '(?i){rules.SCAN_FRAGMENTS}', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) AS cleaned FROM pp")
def fragments_stripped(spark, d):
    """Role texts without leftovers of the page edge."""
    return V.positions(spark, d, "role_text_raw").select("record_id", X.strip_fragments(F.col("role_text_raw")).alias("cleaned"))


@query(f"WITH {V.PP} SELECT count(*) AS n FROM pp WHERE coalesce(regexp_replace(lower(organization), '[^a-z]', '', 'g'), '') NOT IN ('', 'none')")
def degenerate_dropped(spark, d):
    """Records left without organisations that say nothing."""
    return V.positions(spark, d, "organization").where(~relops.degenerate(F.col("organization"))).agg(F.count("*").alias("n"))


_HEAD = r"trim(regexp_replace(lag(sources) OVER (ORDER BY bio_row), '^.*\d[.,;]?', ''))"


@query(rf"""WITH a AS (SELECT bio_row, name, trim(name) AS t, {_HEAD} AS head FROM biographies),
b AS (SELECT *, coalesce(t IS NULL OR t = '' OR NOT contains(t, ',') OR regexp_matches(t, '^[\d(]') OR regexp_matches(t, '\b(mp|es),') OR regexp_matches(t, '\b19\d\d[–-]20\d\d\b') OR length(regexp_replace(t, '[^A-Za-z]', '', 'g')) < 4, true) AS bad FROM a),
c AS (SELECT *, CASE WHEN bad AND coalesce(head, '') <> '' AND contains(head, ',') THEN trim(concat_ws(' ', head, name)) ELSE name END AS f FROM b),
g AS (SELECT *, CASE WHEN NOT contains(regexp_replace(f, '\([^)]*\)', '', 'g'), ',') AND regexp_matches(f, '^\S+\s+\([^)]*\)\s+\S') THEN regexp_replace(f, '^(\S+\s+\([^)]*\))\s+', '\1, ') ELSE f END AS w FROM c)
SELECT bio_row, bad AS was_corrupt, regexp_replace(w, '\((\d{{4}})\)\s*$', '(Deceased \1)') AS rebuilt FROM g""")
def names_rebuilt(spark, d):
    """Torn names rebuilt from the row before, missing commas and death notes put in."""
    b = table(spark, d, "biographies").select("bio_row", "name", "sources")
    return parse.rebuilt_names(b, "bio_row").select("bio_row", "was_corrupt", "rebuilt")


@query(f"WITH {V.PP} SELECT record_id, CASE WHEN lower(title) = '' THEN NULL ELSE title END AS title FROM (SELECT record_id, nullif(trim(position_title), '') AS title FROM pp)")
def title_pick(spark, d):
    """Titles, blanks as null."""
    return V.positions(spark, d, "position_title").select("record_id", F.nullif(F.trim("position_title"), F.lit("")).alias("title"))


# ---- cleaning ---------------------------------------------------------------------------


def _accepted(c: str) -> str:
    """The SQL form of an accepted name."""
    cut = f"regexp_replace(regexp_replace(regexp_replace(trim({c}), '[.,;]+$', ''), '\\s+\\d{{4}}.*$', ''), '(?i){clean.TRAILING}', '')"
    out = f"regexp_replace(trim(regexp_replace({cut}, '\\s{{2,}}', ' ', 'g')), '[.,;]+$', '')"
    return f"(CASE WHEN length({out}) >= 3 AND NOT regexp_matches({out}, '(?i){clean.SERVICES}') THEN {out} END)"


def _taken(patterns) -> str:
    one = lambda p: _accepted(f"nullif(regexp_extract(t, '(?i){p}', 1), '')")
    return "coalesce(" + ", ".join(map(one, patterns)) + ", NULL)"


_OFFICES = "(" + "|".join(sorted(rules.NAMED_OFFICES, key=lambda n: -len(n))) + ")"
_GENERAL = f"""coalesce({_taken([_OFFICES, rules.OTHER_ORGANIZATION])}, {_accepted(f"'Secretariat of ' || nullif(trim(regexp_extract(t, '(?i){rules.SECRETARY_POST}', 1)), '')")}, {_taken([rules.POST_OF])}, {_accepted(f"nullif(array_to_string(regexp_extract_all(t, '(?i){rules.COURT}')[1:2], ', '), '')")})"""
_FIELD_SCHOOL = lambda p: f"""list_transform([trim(string_split({_taken([p])}, ' and ')[1])], lambda x: CASE WHEN length(x) >= 3 THEN coalesce(nullif(upper(regexp_extract(substr(t, instr(lower(t), lower(x)) + length(x), 30), '(?i)^\\s*,\\s*(UNAM|IPN)\\b', 1)), ''), x) END)[1]"""


@query(f"""WITH {V.PP}, x AS (SELECT record_id, field_type, length(role_text_raw) AS n, regexp_replace(regexp_replace(role_text_raw, '\\s{{2,}}', ' ', 'g'), '\\(([A-Z]{{2,8}})\\)', ' \\1 ', 'g') AS t FROM pp)
SELECT record_id, CASE WHEN n < 5 OR field_type = 'birthplace' THEN NULL WHEN field_type = 'education' THEN coalesce({", ".join(map(_FIELD_SCHOOL, rules.SCHOOL_NAMED))}) WHEN field_type = 'party_positions' THEN {_taken(rules.PARTY_NAMED)}
WHEN field_type = 'public_positions' THEN coalesce({_taken(rules.PUBLIC_NAMED)}, {_GENERAL}) WHEN field_type = 'labor_positions' THEN coalesce({_taken(rules.LABOR_NAMED)}, {_GENERAL}) ELSE {_GENERAL} END AS organization_found FROM x""".replace("\\\\", "\\"))
def organizations_extracted(spark, d):
    """Organisations and schools named in role texts, by the ordered patterns of their field with fall-through."""
    p = V.positions(spark, d, "field_type", "role_text_raw")
    return p.select("record_id", clean.organization_in(F.col("role_text_raw"), F.col("field_type")).alias("organization_found"))


_LORG = f"""CASE WHEN length(organization) >= 3 THEN organization ELSE coalesce(upper(nullif(trim(rtrim(regexp_extract(role_text, '(?i){clean.ACRONYM}', 1), '.,;')), '')), nullif(trim(rtrim(trim(regexp_extract(role_text, '(?i){clean.LOCAL_UNION}', 1)), '.,;')), ''), nullif(trim(rtrim(trim(regexp_extract(role_text, '(?i){clean.BODY_NAME}', 1)), '.,;')), '')) END"""


@query(f"WITH {V.PP} SELECT record_id, {_LORG} AS org_filled FROM pp WHERE field_type = 'labor_positions'")
def labor_org_fill(spark, d):
    """Organisations of labor posts, filled from the text where they are missing."""
    return V.domain(spark, d, "labor_positions", "organization", "role_text").select("record_id", clean.labor_organization(F.col("organization"), F.col("role_text")).alias("org_filled"))


_STATES_RE = "|".join(k.lower() for k, _ in sorted(rules.STATE_VARIANTS, key=lambda e: -len(e[0]))).replace(".", r"\.")
_NAT = rf"CASE WHEN {V.like('role_text', rules.NATIONAL_ORG)} THEN true WHEN {V.like('role_text', clean.LOCAL_SECTION)} OR coalesce(regexp_matches({V.plain_sql('role_text')}, '\bof\s+(the\s+)?(state\s+of\s+)?({_STATES_RE})\b'), false) OR {V.like(V.plain_sql('role_text'), clean.LOCAL_BODY)} THEN false END"


@query(f"WITH {V.PP}, x AS (SELECT record_id, state, {_NAT} AS is_national FROM pp WHERE field_type = 'labor_positions') SELECT record_id, is_national, coalesce(state, CASE WHEN is_national THEN 'Federal District' END) AS work_state FROM x")
def labor_national_fill(spark, d):
    """National, local or unknown labor posts, and where they were held."""
    text = F.col("role_text")
    x = V.domain(spark, d, "labor_positions", "role_text", "state").withColumn("is_national", clean.labor_is_national(F.when(text.rlike(X.UI + rules.NATIONAL_ORG), F.lit(True)), text))
    return x.select("record_id", "is_national", clean.work_state_labor(F.col("is_national"), F.col("state")).alias("work_state"))


@query(rf"""WITH {V.PP} SELECT record_id, coalesce(trim(regexp_replace(position_title, '\s{{2,}}', ' ', 'g')), {V.case('role_text', clean.TITLE_FILL)}) AS title,
CASE WHEN coalesce(trim(position_title), '') IN {_inlist(clean.LOCAL_TITLES)} THEN state WHEN coalesce(trim(position_title), '') IN {_inlist(clean.CHAMBER_TITLES)} OR coalesce(trim(position_title), '') = '' THEN 'Federal District' ELSE state END AS work_state FROM pp WHERE field_type = 'public_positions'""")
def public_title_fill(spark, d):
    """Titles of public posts filled from the text, and where the posts were held."""
    x = V.domain(spark, d, "public_positions", "position_title", "role_text", "state")
    return x.select("record_id", clean.filled_title(F.col("position_title"), F.col("role_text")).alias("title"), clean.work_state_public(F.col("position_title"), F.col("state")).alias("work_state"))


@query(f"""WITH {V.PP}, a AS (SELECT record_id, state, role_text_raw AS t, CASE WHEN starts_with(lower(role_text_raw), lower(position_title)) THEN substr(role_text_raw, length(position_title) + 1) ELSE regexp_replace(role_text_raw, '(?i)^.*?{clean.LOCAL_OFFICE}', '') END AS r FROM pp WHERE field_type = 'public_positions'),
b AS (SELECT *, regexp_replace(r, '^[ ,]+', '') AS q FROM a), c AS (SELECT *, coalesce({V.STRIP_SQL.format(c='q')}, '') AS u FROM b),
e AS (SELECT *, trim(regexp_replace(u, '(?i),?\\s*(state\\s+of\\s+)?\\b({_STATES_RE})\\s*(,.*)?$', '')) AS v FROM c), g AS (SELECT *, regexp_replace(v, '^(of )|[ ,]+$', '', 'g') AS w FROM e),
h AS (SELECT record_id, state, CASE WHEN {V.like('t', clean.LOCAL_OFFICE)} AND length(w) BETWEEN 2 AND 60 AND NOT {V.like('w', chr(92) + 'b(committee|convention|council|commission)' + chr(92) + 'b')} THEN w END AS town FROM g)
SELECT record_id, town, coalesce(state, {_STATE_OF_CITY(V.plain_sql('town'))}) AS state_filled FROM h""")
def municipalities(spark, d):
    """Towns of local offices, and the state a town implies."""
    x = V.domain(spark, d, "public_positions", "role_text_raw", "position_title", "state").withColumn("town", clean.municipality(F.col("role_text_raw"), F.col("position_title")))
    return x.select("record_id", "town", clean.state_of_town(F.col("state"), F.col("town")).alias("state_filled"))


_FED = f"CASE WHEN {V.like('organization', clean.CAPITAL_DEPARTMENT)} THEN false WHEN {V.like('organization', clean.FEDERAL_ORGANIZATION)} THEN true WHEN state IS NOT NULL AND state <> 'Federal District' THEN {V.like('role_text_raw', chr(92) + 'bsecretary' + chr(92) + 's+of' + chr(92) + 'b|' + chr(92) + 'bsecretary,')} END"


@query(f"WITH {V.PP}, x AS (SELECT record_id, state, role_text_raw, {_FED} AS is_federal FROM pp WHERE field_type = 'govt_positions') SELECT record_id, is_federal, coalesce(state, CASE WHEN is_federal AND NOT {V.like('role_text_raw', clean.ABROAD)} THEN 'Federal District' END) AS work_state FROM x")
def govt_federal(spark, d):
    """Federal, other or unknown government posts, and where they were held."""
    x = V.domain(spark, d, "govt_positions", "organization", "role_text_raw", "state").withColumn("is_federal", clean.is_federal(F.col("organization"), F.col("state"), F.col("role_text_raw")))
    return x.select("record_id", "is_federal", clean.work_state_govt(F.col("state"), F.col("is_federal"), F.col("role_text_raw")).alias("work_state"))


@query(f"WITH {V.PP}, x AS (SELECT record_id, trim(rtrim(trim(regexp_extract(role_text_raw, '(?i){clean.DEPARTMENT}', 1)), '.,;')) AS dep FROM pp WHERE field_type = 'govt_positions') SELECT record_id, dep AS sub_department FROM x WHERE dep <> '' AND NOT regexp_matches(dep, '(?i){clean.TOP_DEPARTMENT}')")
def sub_departments(spark, d):
    """Departments named in government posts."""
    return V.domain(spark, d, "govt_positions", "role_text_raw").select("record_id", clean.sub_department(F.col("role_text_raw")).alias("sub_department")).where("sub_department is not null")


@query(f"""WITH {V.PP}, x AS (SELECT record_id, state, role_text, {_BODY} AS body, {V.case('role_text', rules.PARTY_RECORD, 'active_position')} AS kind, organization FROM pp WHERE field_type = 'party_positions'), l AS (SELECT *, {_LEVEL} AS level FROM x),
f AS (SELECT *, coalesce(CASE WHEN level = 'state' AND state IS NULL THEN NULL ELSE level END, CASE WHEN {V.like('role_text', chr(92) + 'b(chamber' + chr(92) + 's+of' + chr(92) + 's+deputies|senate|congress|national' + chr(92) + 's+(committee|council|assembly|convention)|central' + chr(92) + 's+committee|plurinominal)' + chr(92) + 'b')} THEN 'national' WHEN state IS NOT NULL THEN 'state' END) AS filled FROM l)
SELECT record_id, filled AS level, CASE WHEN filled = 'national' THEN coalesce(state, 'Federal District') ELSE state END AS work_state, CASE WHEN {V.like('role_text', '^joined' + chr(92) + 'b.{0,60}' + chr(92) + 'bcampaign' + chr(92) + 'b')} THEN 'campaign' ELSE kind END AS kind FROM f""")
def party_level_fill(spark, d):
    """Level, place and kind of party posts after repair."""
    x = V.domain(spark, d, "party_positions", "organization", "role_text", "state")
    body = X.cascade_sources([F.col("organization"), F.col("role_text")], rules.PARTY_BODY)
    x = x.withColumn("body", body).withColumn("level", clean.filled_level(party_level(F.col("body"), F.col("state"), F.col("role_text")), F.col("state"), F.col("role_text")))
    kind = X.cascade(F.col("role_text"), rules.PARTY_RECORD, "active_position")
    return x.select("record_id", "level", clean.work_state_party(F.col("level"), F.col("state")).alias("work_state"), clean.consistent_record(kind, F.col("role_text")).alias("kind"))


_NOFRAG = f"trim(regexp_replace(regexp_replace(role_text_raw, '(?i){rules.SCAN_FRAGMENTS}', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"


@query(f"""WITH {V.PP}, x AS (SELECT record_id, role_text_raw, year_start, year_end, {_NOFRAG} AS c FROM pp), y AS (SELECT *, {V.YEARS_SQL.format(c='c', g=1)} AS a, {V.YEARS_SQL.format(c='c', g=2)} AS b FROM x)
SELECT record_id, CASE WHEN c IS DISTINCT FROM role_text_raw AND a IS NOT NULL THEN a ELSE year_start END AS y0, CASE WHEN c IS DISTINCT FROM role_text_raw AND a IS NOT NULL THEN b ELSE year_end END AS y1 FROM y""")
def years_reextracted(spark, d):
    """Years read again where stripping page leftovers changed the text."""
    x = V.positions(spark, d, "role_text_raw", "year_start", "year_end").withColumn("cleaned", X.strip_fragments(F.col("role_text_raw")))
    a, b = clean.reextracted(F.col("role_text_raw"), F.col("cleaned"), F.col("year_start"), F.col("year_end"))
    return x.select("record_id", a.alias("y0"), b.alias("y1"))


@query("SELECT bio_row, CASE WHEN contains(name, ',') THEN trim(trim(substr(name, instr(name, ',') + 1)) || ' ' || trim(split_part(name, ',', 1))) ELSE name END AS shown FROM biographies")
def names_displayed(spark, d):
    """Names as they are spoken."""
    return table(spark, d, "biographies").select("bio_row", clean.displayed(F.col("name")).alias("shown"))


_PLAIN_WORDS = "' ' || trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"WITH n AS (SELECT DISTINCT trim(split_part(birthplace, ',', 1)) AS name FROM biographies WHERE birthplace IS NOT NULL) SELECT n.name, d.doc_id FROM n JOIN documents d ON contains({_PLAIN_WORDS.format(c='d.text')}, {_PLAIN_WORDS.format(c='n.name')}) WHERE trim({_PLAIN_WORDS.format(c='n.name')}) <> ''")
def places_in_documents(spark, d):
    """Birthplaces named in documents, word for word."""
    names = table(spark, d, "biographies").where("birthplace is not null").select(F.trim(F.split_part("birthplace", F.lit(","), F.lit(1))).alias("name")).distinct()
    return containment.names_in_texts(names, "name", table(spark, d, "documents"), "doc_id", "text")


_WFOCUS = f"""WITH {V.PP}, x AS (SELECT record_id, person_id, field_type, nullif(trim(organization), '') AS org, nullif(trim(state), '') AS st, coalesce({V.case('organization', rules.PARTY_BODY)}, {V.case('role_text', rules.PARTY_BODY)}) AS body FROM pp WHERE field_type NOT IN ('education', 'birthplace'))
SELECT record_id, CASE WHEN field_type <> 'party_positions' THEN org WHEN body IS NOT NULL AND st IS NOT NULL THEN coalesce(org, 'party') || ' – ' || body || ' (' || st || ')' WHEN body IS NOT NULL THEN coalesce(org, 'party') || ' – ' || body WHEN st IS NOT NULL THEN coalesce(org, 'party') || ' – ' || st END AS focus FROM x"""


@query(_WFOCUS)
def work_focus(spark, d):
    """Where people worked together: the organisation, for parties its body and state."""
    x = V.positions(spark, d, "field_type", "organization", "state", "role_text").where(~F.col("field_type").isin("education", "birthplace"))
    org, st = F.nullif(F.trim("organization"), F.lit("")), F.nullif(F.trim("state"), F.lit(""))
    body = X.cascade_sources([F.col("organization"), F.col("role_text")], rules.PARTY_BODY)
    x = x.select("record_id", "field_type", org.alias("org"), st.alias("st"), body.alias("body"))
    base = F.concat(F.coalesce("org", F.lit("party")), F.lit(" – "))
    party = F.when(F.col("body").isNotNull() & F.col("st").isNotNull(), F.concat(base, "body", F.lit(" ("), "st", F.lit(")"))).when(F.col("body").isNotNull(), F.concat(base, "body")).when(F.col("st").isNotNull(), F.concat(base, "st"))
    return x.select("record_id", F.when(F.col("field_type") != "party_positions", F.col("org")).otherwise(party).alias("focus"))


@query("SELECT DISTINCT ego_id, alter_id, edge_type FROM tapado_edges WHERE edge_type IS NOT NULL AND NOT regexp_matches(edge_type, 'distant|third|fourth|removed') AND lower(trim(edge_type)) NOT IN ('', 'nan', 'none', 'unknown')")
def kin_in_scope(spark, d):
    """Ties whose label names a relation within reach."""
    return table(spark, d, "tapado_edges").select("ego_id", "alter_id", "edge_type").where(clean.in_scope(F.col("edge_type"))).distinct()
