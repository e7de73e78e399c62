"""A group of candidacies as a collective candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrutinio.functions.checks import require_columns, single_value

ELIGIBLE_STATUS = "APTO"  # fixed value: registration status of an eligible candidacy


def members_filter(df: DataFrame, ids: Sequence[int] | DataFrame, column: str = "sq_candidato") -> DataFrame:
    """FIL-05. Rows of the listed entities.

    The caller chooses: ids in a Python list become an `IN` filter that reaches the Parquet scan,
    ids in a table a semi join. An empty list matches nothing.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(ids)) if len(ids) else F.lit(False))


def members_by_rule(
    candidates: DataFrame, party: int | None = None, listed: DataFrame | None = None
) -> DataFrame:
    """SET-02, JOI-06. Ids of a group: party number or listed ids, each once."""
    sides = []
    if party is not None:
        sides.append(candidates.filter(F.col("nr_partido") == party).select("sq_candidato"))
    if listed is not None:
        sides.append(listed.select("sq_candidato"))
    if not sides:
        raise ValueError("members_by_rule: a group needs a party or a list")
    out = sides[0]
    for other in sides[1:]:
        out = out.unionByName(other)
    return out.distinct()


def aggregate_group(
    votes: DataFrame,
    members: DataFrame,
    group: str,
    entity: str = "sq_candidato",
    keys: Sequence[str] = ("cd_mun_ibge",),
) -> DataFrame:
    """AGG-21. Votes of the members summed by `keys`, as the entity `grupo`.

    Mixed offices or rounds raise while the job runs. An empty member list raises at once: it is
    looked up here, as an empty result would hide it.
    """
    require_columns(votes, [entity, *keys, "votos"], "aggregate_group")
    if members.isEmpty():
        raise ValueError(f"aggregate_group: no members in {group!r}")
    ids = members.select(entity).distinct()
    mine = votes.join(ids, entity, "left_semi")
    one = single_value(mine, ["cd_cargo", "nr_turno"], "aggregate_group")
    return (
        mine.filter(one)
        .groupBy(*keys)
        .agg(F.sum("votos").alias("votos"))
        .select(F.lit(group).alias("grupo"), *keys, "votos")
    )


def aggregate_groups(
    votes: DataFrame,
    membership: DataFrame,
    entity: str = "sq_candidato",
    keys: Sequence[str] = ("cd_mun_ibge",),
) -> DataFrame:
    """AGG-21 for many groups at once: `membership` has (`grupo`, entity); an entity may be in several."""
    pairs = membership.select("grupo", entity).distinct()
    return votes.join(pairs, entity).groupBy("grupo", *keys).agg(F.sum("votos").alias("votos"))


def eligible_count(
    candidates: DataFrame,
    members: DataFrame | None = None,
    by: Sequence[str] = (),
    include_undecided: bool = False,
    entity: str = "sq_candidato",
) -> DataFrame:
    """AGG-22. Number of eligible candidacies; the undecided variant also counts rows without status."""
    status = "ds_situacao_candidatura"
    require_columns(candidates, [entity, *by, status], "eligible_count")
    rows = candidates if members is None else candidates.join(
        members.select(entity).distinct(), entity, "left_semi"
    )
    eligible: Column = F.col(status) == ELIGIBLE_STATUS
    if include_undecided:
        eligible = eligible | F.col(status).isNull()
    return rows.filter(eligible).groupBy(*by).agg(F.count(F.lit(1)).alias("n_candidatos"))
