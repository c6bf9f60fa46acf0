"""Variant spellings of names: blocking by sound, Jaro-Winkler with nicknames, components.

1. One row per person id, then one per distinct (name, birth): ids that agree in both are
   one class and are never compared with each other.
2. Block keys: pairs of phonetic codes of the sorted name tokens with at least one surname
   in the pair, and full birth dates with the code of one token.  Records whose birth year
   is known meet only within the same year.  A record without one needs a third token, or
   the same place, to be linked, so it meets others under keys that hold the initial of a
   third token or the place as well: no block is left whole, however common its names.
   Only ids pass through the blocks; names are joined to the candidate pairs.
3. Candidate pairs are scored token by token (equal, nickname, initial, cut, Jaro-Winkler
   or one edit) and by the agreement of the births.
4. A record with a vague birth that would tie together people whose births differ keeps
   only its best side.  Accepted pairs are clustered by connected components.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from ..session import cut_lineage, parallelism
from .strings import edits, jaro_winkler, phonetic, plain

# Familiar forms of given names; a form may stand for several names.
NICKNAMES = {
    "paco": "francisco", "pancho": "francisco", "quico": "francisco", "kiko": "francisco", "curro": "francisco",
    "pepe": "jose", "chepe": "jose", "pepito": "jose", "chema": "jose", "quique": "enrique", "kike": "enrique",
    "tono": "antonio", "toni": "antonio", "memo": "guillermo", "guille": "guillermo", "poncho": "alfonso", "fonso": "alfonso",
    "chucho": "jesus", "chuy": "jesus", "lucho": "luis", "luisito": "luis", "manolo": "manuel", "manny": "manuel", "meño": "manuel",
    "polo": "leopoldo", "rafa": "rafael", "falo": "rafael", "rafita": "rafael", "beto": "alberto roberto gilberto heriberto", "tito": "alberto roberto ernesto gilberto heriberto hector",
    "nacho": "ignacio", "lalo": "eduardo", "guayo": "eduardo", "chava": "salvador", "salva": "salvador", "nando": "fernando", "fer": "fernando",
    "neto": "ernesto", "checo": "sergio", "tavo": "gustavo", "gus": "gustavo", "moncho": "ramon", "mon": "ramon", "fito": "rodolfo adolfo", "rodo": "rodolfo",
    "chente": "vicente", "milo": "emilio", "pipe": "felipe", "coque": "jorge", "koke": "jorge", "jorgito": "jorge", "charly": "carlos", "carlitos": "carlos", "calin": "carlos",
    "juanito": "juan", "juancho": "juan", "nito": "juan", "perico": "pedro", "pedrito": "pedro", "piter": "pedro", "richi": "ricardo", "rica": "ricardo", "riqui": "ricardo", "cayo": "ricardo",
    "migue": "miguel", "mike": "miguel", "miguelito": "miguel", "esteve": "esteban", "teban": "esteban", "javi": "javier", "javo": "javier", "raulito": "raul", "rulo": "raul",
    "nino": "saturnino", "sato": "saturnino", "teto": "hector", "heri": "heriberto", "alex": "alejandro", "jano": "alejandro", "ale": "alejandro", "turo": "arturo", "artu": "arturo",
    "varo": "evaristo", "eva": "evaristo", "agus": "agustin", "tin": "agustin", "tincho": "agustin", "tomasito": "tomas", "tomy": "tomas", "mayito": "mario", "fredo": "alfredo", "fello": "alfredo", "alfre": "alfredo",
    "andy": "andres", "andresito": "andres", "gume": "gumersindo", "chindo": "gumersindo", "melqui": "melquiades", "rubencho": "ruben", "benny": "ruben", "bob": "roberto", "robe": "roberto", "gil": "gilberto", "lacho": "horacio", "racho": "horacio",
    "mari": "maria", "maruca": "maria", "marucha": "maria", "cuca": "refugio", "cuquita": "refugio", "lupe": "guadalupe", "lupita": "guadalupe", "chelo": "consuelo", "chelito": "consuelo", "lola": "dolores", "lolita": "dolores",
    "tere": "teresa", "teresita": "teresa", "mago": "margarita", "marga": "margarita", "rita": "margarita", "magui": "margarita", "pera": "esperanza", "lancha": "esperanza", "espe": "esperanza", "coco": "socorro", "coquis": "socorro",
    "yola": "yolanda", "yoli": "yolanda", "tencha": "hortensia", "horte": "hortensia", "licha": "alicia", "concha": "concepcion", "meche": "mercedes", "chayo": "rosario", "betty": "beatriz", "bety": "beatriz", "bea": "beatriz",
    "rosita": "rosa", "chata": "rosa", "marthita": "martha", "mara": "martha", "gris": "griselda", "chela": "griselda graciela", "silvi": "silvia", "chiva": "silvia", "nena": "elena", "elenita": "elena", "leno": "elena", "amy": "amalia", "maya": "amalia", "nora": "leonor", "leo": "leonor leopoldo", "ofe": "ofelia", "fela": "ofelia rafaela",
}
NICKNAMES = {k: tuple(v.split()) for k, v in NICKNAMES.items()}
# Forms of address and small words of surnames.
TITLES = frozenset("dr dra lic licda ing gral prof profa arq cp c p sr sra don dona cnel tte mtro mtra gen col cap cor".split())
PARTICLES = frozenset("de la las los del dela y e".split())

_DEATH = re.compile(r"\(\s*d(?:e(?:c(?:e(?:a(?:s(?:e(?:d\b[^)]*)?)?)?)?)?)?)?\s*\)?\s*$", re.I)
_TAIL = re.compile(r"\s+d(?:ec(?:e(?:a(?:s(?:e(?:d)?)?)?)?)?)\b.*$", re.I)


@lru_cache(maxsize=1 << 14)
def split_name(raw: str, tail: bool = False) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Surnames and given names of a name as people type it, lower case and without accents.

    "Surnames, Given", "SURNAMES Given" and "Given Surname Surname" are told apart; forms
    of address, death notes (whole or cut) and parentheses fall away.  With ``tail`` a cut
    death note without its parenthesis falls away too.
    """
    s = _DEATH.sub("", raw)
    if tail:
        s = _TAIL.sub("", s)
    s = s.replace("(", " ").replace(")", " ")
    head, comma, rest = s.partition(",")

    def words(t: str) -> list[str]:
        return re.findall(r"[^\W\d_]+", t)

    def clean(ws: list[str]) -> tuple[str, ...]:
        return tuple(plain(w) for w in ws if plain(w) not in PARTICLES or (len(w) == 1 and w.isupper()))

    if comma:
        sur, giv = words(head), words(rest)
    else:
        ws = words(s)
        while ws and len(ws) > 2 and plain(ws[0]) in TITLES and len(ws[0]) > 1:
            ws = ws[1:]
        upper = [w for w in ws if len(w) > 1 and w.isupper()]
        if upper and len(upper) < len(ws) and not ws[-1].isupper():
            sur, giv = [w for w in ws if w.isupper() and len(w) > 1], [w for w in ws if not (w.isupper() and len(w) > 1)]
        else:
            body = [w for w in ws if plain(w) not in PARTICLES or (len(w) == 1 and w.isupper())]
            cut = max(1, len(body) - 2) if len(body) > 2 else 1
            giv, sur = body[:cut], body[cut:]
    return clean(sur), tuple(w for w in clean(giv) if w not in TITLES or len(w) == 1)


def canonical_given(token: str) -> tuple[str, ...]:
    return NICKNAMES.get(token, (token,))


@lru_cache(maxsize=1 << 17)
def _close(a: str, b: str) -> float:
    """Agreement of two name tokens, 0 if they are different names."""
    if a == b:
        return 1.0
    if a > b:
        a, b = b, a
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return 0.7 if long[0] == short else 0.0
    if set(canonical_given(a)) & set(canonical_given(b)):
        return 0.97
    if len(short) <= 4 and long.startswith(short):
        return 0.75
    jw = jaro_winkler(a, b)
    if len(short) >= 4 and (edits(a, b, 1) <= 1 or (len(short) >= 7 and jw >= 0.93 and edits(a, b, 2) <= 2)):
        return max(jw, 0.9)
    if len(short) == 3 and edits(a, b, 1) <= 1 and jw >= 0.85:
        return 0.85
    return 0.0


def _token(a: str, b: str, last: bool) -> float:
    x = _close(a, b)
    if not x and last and len(min(a, b, key=len)) >= 2 and (a.startswith(b) or b.startswith(a)):
        return 0.8
    return x


def name_agreement(a: tuple, b: tuple) -> tuple[float, float, int]:
    """Of two split names: agreement of surnames and of given names (0: contradiction), and how many
    tokens agree in full (not only by an initial or by absence)."""
    (sa, ga), (sb, gb) = a, b
    if not sa or not sb:
        return 0.0, 0.0, 0
    if len(sa) > len(sb):
        (sa, ga), (sb, gb) = b, a
    full, sur = 0, 1.0
    best = 0.0
    for order in ((0, 1), (1, 0)) if len(sb) > 1 and len(sa) > 1 else ((0,),):
        parts = [_close(sa[i], sb[j]) for i, j in enumerate(order)]
        score = 0.0 if not all(parts) or max(parts) < 0.8 else sum(parts) / len(parts) - (0.05 if order[0] else 0)
        if score > best:
            best, full = score, sum(p >= 0.8 for p in parts)
    sur = best * (1.0 if len(sa) == len(sb) else 0.9)
    if len(sa) == 1 and len(sb) > 1 and len(sa[0]) == 1:
        return 0.0, 0.0, 0
    if not ga or not gb:
        return sur, 0.5, full
    short, long = (ga, gb) if len(ga) <= len(gb) else (gb, ga)
    left, giv = list(range(len(long))), []
    for i, t in enumerate(short):
        options = [(_token(t, long[j], i == len(short) - 1 or j == len(long) - 1), -j) for j in left]
        if not options:
            break
        s, j = max(options)
        giv.append(s)
        if s:
            left.remove(-j)
    if not all(giv):
        return sur, 0.0, full
    full += sum(g >= 0.8 for g in giv)
    return sur, sum(giv) / len(giv) * (1.0 if len(ga) == len(gb) else 0.95), full


def birth_agreement(da, pa_, db, pb) -> float:
    """1: same full date; less for vaguer agreement, 0.2 if one is unknown; 0: they differ.

    A birth is (yyyymmdd, precision) with precision full, month_year, year_only, decade or unknown."""
    order = {"full": 4, "month_year": 3, "year_only": 2, "decade": 1}
    x, y = order.get(pa_, 0), order.get(pb, 0)
    if da is None or db is None or not x or not y:
        return 0.2
    depth = min(x, y)
    cut = {4: 1, 3: 100, 2: 10_000, 1: 100_000}[depth]
    if da // cut != db // cut:
        return 0.0
    return {4: 1.0, 3: 0.8, 2: 0.6, 1: 0.3}[depth]


def accepted(sur: float, giv: float, full: int, birth: float, same_state: int) -> float:
    """Strength of a link, 0 if the two are not taken for one person."""
    if not sur or not giv or not birth or full < 1:
        return 0.0
    need = 1.0 if birth >= 0.9 else 2.0
    if birth < 0.9 and same_state < 0:
        return 0.0
    if birth <= 0.3:
        need = 3.0 if same_state <= 0 else 2.0
    return birth + sur + giv if full >= need else 0.0


def persons(bio: DataFrame, positions: DataFrame) -> DataFrame:
    """``pid, name, birth, prec, place, tail`` of every person id of both tables.

    The name of the biography is preferred; births come from the positions, or from the
    biography where those have none.  Ids without a name in either table are left out."""
    p = positions.where("person_id is not null").groupBy("person_id").agg(
        F.min("person_name").alias("pname"), F.min("birth_date_clean").alias("bd"), F.min("birth_date_precision").alias("pr"))
    raw = F.lower(F.col("birth_date"))
    year = F.regexp_extract(raw, r"(1[789]\d\d|20\d\d)", 1)
    b = bio.where("person_id is not null").groupBy("person_id").agg(
        F.min("name").alias("bname"), F.min("birth_date").alias("birth_date"), F.min("birthplace").alias("birthplace"))
    j = p.join(b, "person_id", "full_outer")
    decade = raw.rlike(r"^\s*\d{4}s\s*$")
    birth = F.coalesce(F.date_format("bd", "yyyyMMdd").cast("long"), F.when(year != "", F.expr("try_cast(regexp_extract(lower(birth_date), '(1[789][0-9][0-9]|20[0-9][0-9])', 1) as long)") * 10_000 + 101))
    prec = F.when(F.col("bd").isNotNull(), F.col("pr")).when(decade, F.lit("decade")).when(year != "", F.lit("year_only")).otherwise(F.lit("unknown"))
    place = F.nullif(F.trim(F.element_at(F.split(F.col("birthplace"), ","), -1)), F.lit(""))
    return j.select(
        F.col("person_id").alias("pid"), F.coalesce("bname", "pname").alias("name"), birth.alias("birth"), prec.alias("prec"), place.alias("place"), F.col("bname").isNull().alias("tail")
    ).where("name is not null")


_KEYED = "key long, year int, rep long, vague boolean"


def _codes(sur: tuple, giv: tuple) -> tuple[list[str], list[tuple[str, str]]]:
    """Codes of the two surnames that agreement looks at, and codes and initials of the given names and what they stand for."""
    return [phonetic(s) if len(s) > 1 else "" for s in sur[:2]], sorted({(phonetic(c), c[0]) for g in giv if len(g) > 1 for c in canonical_given(g)})


def _keys(sur: tuple, giv: tuple, birth, prec) -> set[str]:
    """Keys under which records of one birth year meet."""
    surs, givs = _codes(sur, giv)
    surs = [s for s in surs if s]
    full = birth is not None and prec == "full"
    keys = {"|".join(sorted(surs))} if len(surs) == 2 else set()
    for s in surs:
        keys.update("|".join(sorted((s, g))) for g, _ in givs)
        keys.update("|".join((s, g[0])) for g in giv)
        if full:
            keys.add(f"{birth}|{s}")
    if full:
        keys.update(f"{birth}|{g}" for g, _ in givs)
        keys.update(f"{birth}|{g[0]}|{s[0]}" for g in giv for s in surs if s)
    return keys


def _vague_keys(sur: tuple, giv: tuple, place: str | None) -> set[str]:
    """Keys under which records without a birth year meet all others: two codes with the initial of a third token or the place."""
    surs, givs = _codes(sur, giv)
    initials = {g[0] for g in giv} | {c for _, c in givs}
    town = plain(place) if place else None
    keys = set()

    def add(a: str, b: str, thirds: set[str]) -> None:
        pair = "|".join(sorted((a, b)))
        keys.update(f"{pair}+{t}" for t in thirds)
        if town:
            keys.add(f"{pair}@{town}")

    if len(surs) == 2 and all(surs):
        add(*surs, initials)
    for i, s in enumerate(surs):
        other = {sur[1 - i][0]} if len(surs) == 2 else set()
        for g, c in givs if s else ():
            add(s, g, other | {x for x in initials if x != c or len(giv) > 1})
        if s and town:
            keys.update(f"{s}|{x}@{town}" for x in initials)
        if s and other:
            keys.update(f"{s}|{x}+{o}" for x in initials for o in other)
    return keys


def _hashed(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little", signed=True)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for rep, sur, giv, birth, prec, place in zip(*(c.to_pylist() for c in b.columns)):
            known = birth is not None and prec in ("full", "month_year", "year_only")
            name = tuple(sur.split()), tuple(giv.split())
            if known:
                rows.extend((_hashed(k), birth // 10_000, rep, False) for k in _keys(*name, birth, prec))
            rows.extend((_hashed(k), None, rep, not known) for k in _vague_keys(*name, place))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.bool_()))], names=["key", "year", "rep", "vague"])


_SPLIT = T.StructType([T.StructField(n, t) for n, t in (("pid", T.LongType()), ("sur", T.StringType()), ("giv", T.StringType()), ("birth", T.LongType()), ("prec", T.StringType()), ("place", T.StringType()))])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pid, name, birth, prec, place, tail = (c.to_pylist() for c in b.columns)
        parts = [split_name(n, t) for n, t in zip(name, tail)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array([" ".join(p[0]) for p in parts], pa.string()), pa.array([" ".join(p[1]) for p in parts], pa.string()), b.column(2).cast(pa.int64()), b.column(3).cast(pa.string()), b.column(4).cast(pa.string())],
            names=_SPLIT.names)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for ra, sa, ga, ba, pra, pla, rb, sb, gb, bb, prb, plb in zip(*(c.to_pylist() for c in b.columns)):
            birth = birth_agreement(ba, pra, bb, prb)
            if not birth:
                continue
            a, z = (tuple(sa.split()), tuple(ga.split())), (tuple(sb.split()), tuple(gb.split()))
            sur, giv, full = name_agreement(a, z)
            state = 0 if pla is None or plb is None else 1 if plain(pla) == plain(plb) else -1
            s = accepted(sur, giv, full, birth, state)
            if s:
                out.append((ra, rb, s, ba if pra == "full" else None, bb if prb == "full" else None))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["a", "b", "s", "fa", "fb"])


def name_links(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted links ``a, b`` between class representatives, and the membership ``pid, rep``."""
    split = people.select("pid", "name", "birth", "prec", "place", "tail").mapInArrow(_split, _SPLIT)
    whole = (F.col("sur") != "") & (F.col("giv") != "")
    nothing = F.lit("")
    mark = F.when(whole, F.sha2(F.concat_ws("|", "sur", "giv", F.coalesce(F.col("birth").cast("string"), nothing), F.coalesce("prec", nothing), F.coalesce("place", nothing)), 256)).otherwise(F.col("pid").cast("string"))
    marked = cut_lineage(split.withColumn("class", mark))
    firsts = marked.groupBy("class").agg(F.min("pid").alias("rep"))
    members = cut_lineage(marked.join(firsts, "class").drop("class"))
    reps = members.where("pid = rep").select("rep", "sur", "giv", "birth", "prec", "place")
    keyed = cut_lineage(reps.repartition(parallelism(people.sparkSession), "rep").mapInArrow(_explode, _KEYED))
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "vague")])
    known, loose = keyed.where("year is not null"), keyed.where("year is null")
    dated = known.select("key", "year", F.col("rep").alias("rep_a")).join(known.select("key", "year", F.col("rep").alias("rep_b")), ["key", "year"]).where("rep_a < rep_b")
    asking = loose.where("vague")
    answering = loose.join(asking.select("key").distinct(), "key", "left_semi")
    open_ = side(asking, "a").join(side(answering, "b"), "key").where("rep_a <> rep_b and (not vague_b or rep_a < rep_b)")
    met = dated.select("rep_a", "rep_b").union(open_.select("rep_a", "rep_b")).distinct()
    named = lambda s: reps.select(*[F.col(c).alias(f"{c}_{s}") for c in reps.columns])
    cols = [f"{c}_{s}" for s in "ab" for c in ("rep", "sur", "giv", "birth", "prec", "place")]
    pairs = met.join(named("a"), "rep_a").join(named("b"), "rep_b").select(*cols)
    scored = pairs.mapInArrow(_score, "a long, b long, s double, fa long, fb long")
    links = scored.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max("s").alias("s"), F.max(F.when(F.col("a") < F.col("b"), F.col("fa")).otherwise(F.col("fb"))).alias("fa"), F.max(F.when(F.col("a") < F.col("b"), F.col("fb")).otherwise(F.col("fa"))).alias("fb"))
    links = cut_lineage(links)
    # A record without a full birth may lean on one full birth only: its strongest, and none if two are as strong.
    ends = links.where("fa is null and fb is not null").select(F.col("a").alias("v"), F.col("fb").alias("f"), "s").union(
        links.where("fb is null and fa is not null").select(F.col("b").alias("v"), F.col("fa").alias("f"), "s"))
    best = ends.groupBy("v", "f").agg(F.max("s").alias("s"))
    w = Window.partitionBy("v").orderBy(F.desc("s"), F.asc("f"))
    ranked = best.withColumn("k", F.row_number().over(w)).withColumn("rival", F.lead("s").over(w)).where("k = 1")
    chosen = ranked.select("v", F.when(F.col("rival").isNull() | (F.col("rival") < F.col("s") - 1e-9), F.col("f")).otherwise(F.lit(-1)).alias("chosen"))
    near = links.join(chosen.withColumnRenamed("v", "a").withColumnRenamed("chosen", "ca"), "a", "left").join(chosen.withColumnRenamed("v", "b").withColumnRenamed("chosen", "cb"), "b", "left")
    va, vb = F.coalesce("fa", "ca"), F.coalesce("fb", "cb")
    kept = near.where(va.isNull() | vb.isNull() | ((va == vb) & (va != -1)))
    return kept.select("a", "b"), members.select("pid", "rep")


def same_person(bio: DataFrame, positions: DataFrame) -> DataFrame:
    """``pid, person`` of every id that shares its person with another id; the person is the smallest id.

    Defined results: ids without any name are no case; equal name and birth make one class
    at once; rows delivered twice change nothing; of an id with several names the first in
    the alphabet counts; of a name with very many surnames the first two are compared; empty tables give an empty result; further columns of the tables are not read."""
    links, members = name_links(persons(bio, positions))
    comp = connected_components(links)
    grouped = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("pid", F.coalesce("component", "rep").alias("person"))
    sizes = grouped.groupBy("person").agg(F.count("*").alias("n")).where("n > 1").select("person")
    return grouped.join(sizes, "person").select("pid", "person")


def same_person_pairs(bio: DataFrame, positions: DataFrame) -> DataFrame:
    """Every pair of ids of one person, the smaller first."""
    m = same_person(bio, positions)
    a, b = m.select("person", F.col("pid").alias("person_id_a")), m.select("person", F.col("pid").alias("person_id_b"))
    return a.join(b, "person").where("person_id_a < person_id_b").select("person_id_a", "person_id_b")
