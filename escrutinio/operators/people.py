"""Candidacy lists: search, pairs of the same person, selections, declared handles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.checks import fail
from escrutinio.functions.handles import cites_network, profile_handle
from escrutinio.functions.text import normalize_search, relevance
from escrutinio.operators.groups import members_by_rule

COUNTRY = "BR"  # fixed value: state code of a national candidacy
PRESIDENT = "PRESIDENTE"
NOT_ON_BALLOT = "Não foi às urnas"


def in_state(state: str | None, office: str | None = None, column: str = "sg_uf") -> Column:
    """FIL-01. Rows of a state; for president the national candidacies too."""
    if state is None:
        return F.lit(True)
    return F.col(column).isin(state, COUNTRY) if office == PRESIDENT else F.col(column) == state


def on_ballot(candidates: DataFrame) -> DataFrame:
    """FIL-02. Candidacies that ran."""
    return candidates.filter("foi_as_urnas")


def registration_status(status: Column, ran: Column) -> Column:
    """EXP-29. Status of the source; a missing one off the ballot gets a fixed label."""
    return F.when(status.isNull() & ~ran, NOT_ON_BALLOT).otherwise(status)


def base_state(state: Column) -> Column:
    """EXP-30. State whose electorate is the base of the rates; null means the country."""
    return F.when(state != COUNTRY, state)


def scope_name(state: Column) -> Column:
    """EXP-30. `nacional` for the country, `estadual` otherwise."""
    return F.when(state == COUNTRY, "nacional").otherwise("estadual")


def with_search_text(candidates: DataFrame) -> DataFrame:
    """EXP-10. Normalised columns of the searched texts, meant to be stored beside them."""
    return candidates.withColumns(
        {f"{c}_norm": normalize_search(F.col(c)) for c in ("nm_urna", "nm_civil", "sg_partido")}
    )


def tier(term: str, prefix: str = "") -> Column:
    """EXP-12 on a table with search text."""
    return relevance(
        term,
        F.col(f"{prefix}nm_urna_norm"),
        F.col(f"{prefix}nm_civil_norm"),
        F.col(f"{prefix}sg_partido_norm"),
        F.col(f"{prefix}nr_candidato"),
        F.col(f"{prefix}nr_partido"),
    )


def search(
    candidates: DataFrame,
    votes: DataFrame,
    term: str,
    limit: int,
    year: int | None = None,
    office: str | None = None,
    state: str | None = None,
    party: int | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """TOP-03. Best matches by tier, votes, newer year, name and id, with the number of matches.

    With a party number, listed ids or both, only the group they make is searched.
    Candidates are filtered and matched before the votes are joined, and the order is a top-k, so
    no approximation window is needed.
    """
    rows = on_ballot(candidates).filter(in_state(state, office))
    if year is not None:
        rows = rows.filter(F.col("ano") == year)
    if office is not None:
        rows = rows.filter(F.col("ds_cargo") == office)
    if party is not None or listed is not None:
        rows = rows.join(members_by_rule(rows, party, listed), "sq_candidato", "left_semi")
    hits = with_search_text(rows).withColumn("nivel", tier(term)).filter(F.col("nivel").isNotNull())
    keys = ["ano", "sq_candidato"]
    summed = votes.groupBy(*keys).agg(F.sum("votos").alias("votos"))
    total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        hits.select(*candidates.columns, "nivel")
        .join(summed, keys, "left")
        .withColumn("votos", F.coalesce("votos", F.lit(0).cast("bigint")))
        .orderBy("nivel", F.desc("votos"), F.desc("ano"), "nm_urna", "sq_candidato")
        .limit(limit)
        .withColumn("total", total)
    )


def suggestion_order(items: DataFrame, query: str) -> DataFrame:
    """TOP-04. Names that start with the query first, then votes, then the newer year."""
    starts = normalize_search(F.col("nm_urna")).startswith(query)
    return items.orderBy(F.desc(starts), F.desc("votos"), F.desc("ano"), "nm_urna", "sq_candidato")


PAIR_COLUMNS = ("ano", "sq_candidato", "pessoa_id", "nm_urna", "sg_uf", "ds_cargo", "nr_partido")


def people_pairs(
    candidates: DataFrame,
    year_from: int,
    year_to: int,
    term: str | None = None,
    state: str | None = None,
    office: str | None = None,
    same_office: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """JOI-07. Pairs of candidacies of one person in two years, `_de` and `_para` columns.

    Year, ballot and office filters reach both scans before the join. With a term either side may
    match and `nivel` is the better tier. `only` lists public ids in `pessoa_pub`.
    """
    rows = on_ballot(candidates).filter(F.col("pessoa_id").isNotNull())
    if office is not None:
        rows = rows.filter(F.col("ds_cargo") == office)
    if only is not None:
        rows = rows.join(only.select("pessoa_pub").distinct(), "pessoa_pub", "left_semi")
    rows = with_search_text(rows).withColumn("nivel", tier(term)) if term else rows
    extra = ["nivel"] if term else []

    def side(year: int, suffix: str) -> DataFrame:
        kept = [c for c in (*PAIR_COLUMNS, *extra) if c != "pessoa_id"]
        return rows.filter(F.col("ano") == year).select(
            "pessoa_id", *[F.col(c).alias(f"{c}_{suffix}") for c in kept]
        )

    pairs = side(year_from, "de").join(side(year_to, "para"), "pessoa_id")
    if state is not None:
        pairs = pairs.filter((F.col("sg_uf_de") == state) | (F.col("sg_uf_para") == state))
    if same_office:
        pairs = pairs.filter(F.col("ds_cargo_de") == F.col("ds_cargo_para"))
    if term:
        pairs = (
            pairs.withColumn("nivel", F.least("nivel_de", "nivel_para"))
            .filter(F.col("nivel").isNotNull())
            .drop("nivel_de", "nivel_para")
        )
    return pairs


def select_people(
    old: DataFrame, new: DataFrame, people: DataFrame | None, ids_old: DataFrame | None = None,
    ids_new: DataFrame | None = None, scope: Column | None = None,
) -> DataFrame:
    """SET-07. Candidacies of two years chosen by person and by explicit id, tagged by `lado`.

    A person must be on both sides inside the scope. An explicit id that is missing or outside the
    scope raises; it is never dropped in silence.
    """
    inside = F.lit(True) if scope is None else scope
    out = []
    if people is not None:
        a = old.filter(inside).join(people, "pessoa_id", "left_semi")
        b = new.filter(inside).join(people, "pessoa_id", "left_semi")
        out += [
            a.join(b.select("pessoa_id").distinct(), "pessoa_id", "left_semi").withColumn("lado", F.lit("de")),
            b.join(a.select("pessoa_id").distinct(), "pessoa_id", "left_semi").withColumn("lado", F.lit("para")),
        ]
    for side, ids, name in ((old, ids_old, "de"), (new, ids_new, "para")):
        if ids is None:
            continue
        marked = side.withColumn("_in", F.coalesce(inside, F.lit(False)))
        asked = ids.select("sq_candidato").distinct().join(marked, "sq_candidato", "left")
        bad = fail("select_people: candidacy outside the selection", F.col("sq_candidato"))
        out.append(
            asked.withColumn("_in", F.coalesce("_in", F.lit(False)))
            .withColumn("sq_candidato", F.when(F.col("_in"), F.col("sq_candidato")).otherwise(bad))
            .select(*old.columns, F.lit(name).alias("lado"))
        )
    if not out:
        raise ValueError("select_people: nothing selected")
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    return rows.dropDuplicates(["lado", "sq_candidato"])


def person_list(
    candidates: DataFrame, seeds: DataFrame, party: int, year_from: int, year_to: int
) -> DataFrame:
    """QRY-19. Earlier-year candidacies of the people of a later party and of the seed list.

    One per person: the one with a result first, then the smaller id.
    """
    earlier = candidates.filter(F.col("ano_eleicao") == year_from)
    later = candidates.filter((F.col("ano_eleicao") == year_to) & (F.col("nr_partido") == party))
    seeded = earlier.join(seeds.select("sq_candidato").distinct(), "sq_candidato", "left_semi")
    people = (
        later.select("pessoa_id").unionByName(seeded.select("pessoa_id"))
        .filter(F.col("pessoa_id").isNotNull()).distinct()
    )
    others = [c for c in candidates.columns if c != "pessoa_id"]
    rank = F.struct(F.col("ds_sit_tot_turno").isNull().cast("int").alias("a"), F.col("sq_candidato").alias("b"))
    return (
        earlier.join(people, "pessoa_id", "left_semi")
        .groupBy("pessoa_id")
        .agg(F.min_by(F.struct(*others), rank).alias("r"))
        .select("pessoa_id", "r.*")
        .select(*candidates.columns)
    )


# --- declared handles -----------------------------------------------------------------------------


def declared_handles(declarations: DataFrame, network: str = "instagram") -> DataFrame:
    """QRY-20. Distinct (candidacy, handle) of lowest order, with the primary flag (WIN-07, WIN-11)."""
    valid = declarations.withColumn("username", profile_handle(F.col("url_tse"))).filter(
        F.col("username").isNotNull()
    )
    others = [c for c in valid.columns if c not in ("sq_candidato", "username")]
    rank = F.struct(F.col("nr_ordem"), F.col("url_tse"))
    distinct = valid.groupBy("sq_candidato", "username").agg(
        F.min_by(F.struct(*others), rank).alias("r")
    ).select("sq_candidato", "username", "r.*")
    lowest = distinct.groupBy("sq_candidato").agg(F.min("nr_ordem").alias("_first"))
    return (
        distinct.join(lowest, "sq_candidato")
        .withColumns({"rede": F.lit(network), "principal": F.col("nr_ordem") == F.col("_first")})
        .drop("_first")
    )


def handle_counts(declarations: DataFrame, members: DataFrame) -> DataFrame:
    """QRY-20. One row: members, with and without a handle, profiles, several, rejected texts."""
    url = F.col("url_tse")
    # Dealt by candidacy first: texts are short and costly to read, and a small file is one task.
    read = declarations.select("sq_candidato", "url_tse").repartition("sq_candidato").select(
        "sq_candidato", profile_handle(url).alias("username"), cites_network(url).alias("_cited")
    )
    per = (
        read.groupBy("sq_candidato", "username")
        .agg(F.count_if(F.col("_cited") & F.col("username").isNull()).alias("_r"))
        .groupBy("sq_candidato")
        .agg(F.nullif(F.count("username"), F.lit(0)).alias("n"), F.sum("_r").alias("_r"))
    )
    known = members.select("sq_candidato").distinct().withColumn("_m", F.lit(True))
    mine, zero = F.col("_m").isNotNull(), F.lit(0).cast("bigint")
    return known.join(per, "sq_candidato", "full_outer").agg(
        F.count("_m").alias("candidatos_no_grupo"),
        F.count_if(mine & F.col("n").isNotNull()).alias("com_instagram"),
        F.count_if(mine & F.col("n").isNull()).alias("sem_instagram"),
        F.coalesce(F.sum(F.when(mine, F.col("n"))), zero).alias("perfis"),
        F.count_if(mine & (F.col("n") > 1)).alias("com_mais_de_um_perfil"),
        F.coalesce(F.sum("_r"), zero).alias("urls_instagram_rejeitadas"),
    )


def compare_handles(declared: DataFrame, site: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """JOI-14. Declared against third-party handles: rows that disagree, with their class.

    The declared rows are folded per candidacy (a primary and a few alternates) before the join.
    With `candidates` the ballot name and the state stand beside each row.
    """
    folded = declared.groupBy("sq_candidato").agg(
        F.min(F.when(F.col("principal"), F.col("username"))).alias("instagram_tse"),
        F.array_sort(F.collect_set(F.when(~F.col("principal"), F.col("username")))).alias("_alt"),
    )
    joined = folded.join(
        site.select(
            "sq_candidato", F.col("instagram").alias("instagram_site"),
            F.col("seguidores").alias("seguidores_site"), F.lit(True).alias("_no_site"),
        ),
        "sq_candidato",
        "full_outer",
    )
    on_site, on_tse = F.col("instagram_site").isNotNull(), F.col("instagram_tse").isNotNull()
    kind = (
        F.when(on_site & ~on_tse, "so_no_site")
        .when(~on_site & on_tse & F.col("_no_site").isNull(), "candidato_ausente_no_site")
        .when(~on_site & on_tse, "so_no_tse")
        .when(~on_site & ~on_tse, "nenhum")
        .when(F.col("instagram_site") == F.col("instagram_tse"), "igual")
        .when(F.array_contains("_alt", F.col("instagram_site")), "site_usa_perfil_alternativo_do_tse")
        .otherwise("perfis_diferentes")
    )
    out = (
        joined.withColumn("divergencia", kind)
        .filter(~F.col("divergencia").isin("igual", "nenhum"))
        .select(
            "sq_candidato", "divergencia", "instagram_tse",
            F.nullif(F.array_join("_alt", ","), F.lit("")).alias("instagram_tse_alternativos"),
            "instagram_site", "seguidores_site",
        )
    )
    if candidates is None:
        return out
    return out.join(candidates.select("sq_candidato", "nm_urna", "sg_uf"), "sq_candidato", "left")


def handle_report(divergences: DataFrame) -> DataFrame:
    """SNK-03. Rows of each class of divergence."""
    return divergences.groupBy("divergencia").agg(F.count(F.lit(1)).alias("n"))


def work_list(declared: DataFrame, limit: int | None = None, skip: DataFrame | None = None) -> DataFrame:
    """STR-04. Distinct accounts, those of a primary declaration first, then by smallest candidacy."""
    rows = declared if skip is None else declared.join(skip.select("username").distinct(), "username", "left_anti")
    ordered = (
        rows.groupBy("username")
        .agg(
            F.max("principal").alias("principal"),
            F.min(F.struct((~F.col("principal")).alias("p"), F.col("sq_candidato").alias("s"))).alias("_o"),
        )
        .select("username", "principal", F.col("_o.s").alias("sq_candidato"))
        .orderBy(F.desc("principal"), "sq_candidato", "username")
    )
    return ordered if limit is None else ordered.limit(limit)

