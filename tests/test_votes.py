import pytest
from pyspark.sql import functions as F

from escrutinio.operators import groups, performance, reference, spatial
from tests.conftest import FAILURES, rows

VOTES = "sq_candidato int, cd_mun_ibge int, votos bigint"
UNITS = "cd_mun_ibge int, aptos bigint, validos bigint"
BALLOTS = (
    "sq_candidato int, cd_mun_ibge int, nr_turno int, cd_cargo int, "
    "nm_tipo_destinacao_votos string, qt_votos_nominais bigint, qt_votos_nominais_validos bigint"
)


def near(value):
    return pytest.approx(value, abs=1e-9)


def test_destinations_are_kept_apart(frame):
    df = frame(
        [
            (1, 10, 1, 6, "Válido", 5, 5), (1, 10, 1, 6, "Válido", 3, 3), (1, 10, 1, 6, "Anulado", 2, 0),
            (1, 10, 1, 6, "Anulado sub judice", 1, 0), (1, 10, 1, 6, "Válido (legenda)", 4, 0),
        ],
        BALLOTS,
    )
    assert rows(performance.votes_by_destination(df)) == [
        {"sq_candidato": 1, "cd_mun_ibge": 10, "votos_nominais_validos": 8, "votos_anulados": 3, "votos_convertidos_legenda": 4}
    ]


@pytest.mark.parametrize(
    "extra", [(1, 10, 2, 6, "Válido", 1, 1), (1, 10, 1, 7, "Válido", 1, 1), (1, 10, 1, 6, "Outro", 1, 1)]
)
def test_mixed_rounds_offices_and_labels_fail(frame, extra):
    df = frame([(1, 10, 1, 6, "Válido", 5, 5), extra], BALLOTS)
    with pytest.raises(FAILURES):
        performance.votes_by_destination(df).collect()


def test_unit_indicators_with_explicit_zeros(frame):
    v = frame([(1, 10, 30), (1, 20, 10), (2, 10, 20)], VOTES)
    e = frame([(10, 1000, 100), (20, 500, 50), (30, 100, 0)], UNITS)
    got = {(r["sq_candidato"], r["cd_mun_ibge"]): r for r in rows(performance.unit_indicators(v, e))}
    assert len(got) == 6
    a = got[1, 10]
    assert a["pct_validos"] == near(30.0) and a["penetracao"] == near(30.0)
    assert a["lq"] == near((30 / 40) / (100 / 150))
    assert a["taxa_referencia"] == near(40 / 1600) and a["esperado"] == near(25.0) and not a["n_baixo"]
    assert got[2, 20]["votos"] == 0 and got[2, 20]["lq"] == 0.0
    empty = got[1, 30]
    assert empty["pct_validos"] is None and empty["lq"] is None and empty["n_baixo"]


@pytest.mark.parametrize(
    ("votes", "units", "message"),
    [
        ([(1, 99, 5)], [(10, 10, 10)], "without electorate"),
        ([(1, 10, 11)], [(10, 20, 10)], "above the valid"),
        ([(1, 10, 1), (1, 10, 2)], [(10, 20, 10)], "repeated key"),
        ([(1, 10, 1)], [(10, 20, 10), (10, 20, 10)], "repeated key"),
    ],
)
def test_dense_table_rejects_bad_input(frame, votes, units, message):
    with pytest.raises(FAILURES, match=message):
        performance.unit_indicators(frame(votes, VOTES), frame(units, UNITS)).collect()


def test_location_quotient_has_weighted_mean_one(frame):
    v = frame([(1, i, 3 * i) for i in range(1, 9)], VOTES)
    e = frame([(i, 100 * i, 10 * i + 5) for i in range(1, 9)], UNITS)
    t = spatial.location_quotient(v.join(e, "cd_mun_ibge"))
    mean = t.agg((F.sum(F.col("lq") * F.col("validos")) / F.sum("validos")).alias("m")).first().m
    assert mean == near(1.0)


def test_concentration_dense_and_sparse_agree(frame):
    v = frame([(1, 10, 30), (1, 20, 10), (2, 10, 20)], VOTES)
    e = frame([(10, 1000, 100), (20, 500, 50), (30, 300, 40)], UNITS)
    dense = rows(spatial.concentration(performance.with_zeros(v, e)), "sq_candidato")
    sparse = rows(spatial.concentration(v.join(e, "cd_mun_ibge"), electorate=e), "sq_candidato")
    for a, b in zip(dense, sparse):
        assert a == pytest.approx(b)
    s = (0.75, 0.25, 0.0)
    x = (1000 / 1800, 500 / 1800, 300 / 1800)
    one = dense[0]
    assert one["hhi"] == near(0.625) and one["n_efetivo_municipios"] == near(1.6)
    assert one["dominancia_ames"] == near(0.75 * 0.3 + 0.25 * 0.2)
    assert one["indice_g"] == near(sum((a - b) ** 2 for a, b in zip(s, x)))


def test_concentration_without_votes_is_null(frame):
    t = frame([(1, 10, 0, 100, 10)], "sq_candidato int, cd_mun_ibge int, votos bigint, aptos bigint, validos bigint")
    r = rows(spatial.concentration(t))[0]
    assert r["hhi"] is None and r["dominancia_ames"] is None and r["indice_g"] is None


def test_largest_units(frame):
    v = frame([(1, i, i) for i in range(5)] + [(2, 1, 0)], VOTES)
    got = rows(spatial.largest_units_share(v, k=2), "sq_candidato")
    assert got[0]["pct_maiores"] == near(70.0) and got[0]["n_municipios_com_voto"] == 4
    assert got[1]["pct_maiores"] is None and got[1]["n_municipios_com_voto"] == 0
    with pytest.raises(ValueError):
        spatial.largest_units_share(v, k=0)


def test_typology_ties_go_down(frame):
    t = frame(
        [(1, 100, 0.1, 0.5), (2, 100, 0.2, 0.3), (3, 100, 0.3, 0.1), (4, 1, 0.9, 0.9)],
        "sq_candidato int, votos int, indice_g double, dominancia_ames double",
    )
    got = {r["sq_candidato"]: r for r in rows(spatial.typology(t, 500))}
    assert got[2]["tipo"] == "disperso-compartilhado" and got[2]["mediana_g"] == near(0.2)
    assert got[3]["tipo"] == "concentrado-compartilhado"
    assert got[4]["na_populacao_referencia"] is False and got[4]["tipo"] == "concentrado-dominante"
    nobody = rows(spatial.typology(t, 100_000))
    assert {r["tipo"] for r in nobody} == {None}


def test_smoothing_shrinks_to_the_mean(frame):
    t = frame([(1, 10, 100), (2, 90, 1000), (3, 0, 50), (4, 5, 0)], "u int, votos int, aptos int")
    got = {r["u"]: r for r in rows(spatial.smoothed_rates(t))}
    assert set(got) == {1, 2, 3}
    n, v = (100, 1000, 50), (10, 90, 0)
    b = sum(v) / sum(n)
    s2 = sum(ni * (vi / ni - b) ** 2 for vi, ni in zip(v, n)) / sum(n)
    a = max(s2 - b / (sum(n) / 3), 0)
    w = a / (a + b / 100)
    assert got[1]["eb_b"] == near(b) and got[1]["eb_a"] == near(a)
    assert got[1]["taxa_eb"] == near(w * 0.1 + (1 - w) * b)


def test_smoothing_without_events(frame):
    got = rows(spatial.smoothed_rates(frame([(1, 0, 10)], "u int, votos int, aptos int")))[0]
    assert got["peso"] == 0.0 and got["taxa_eb"] == 0.0


def test_party_votes(frame):
    t = frame(
        [(13, 100, 20, 880, 1000, 3)],
        "nr_partido int, qt_votos_legenda_validos bigint, qt_votos_nom_convr_leg_validos bigint, "
        "votos_nominais_validos bigint, qt_total_votos_validos_uf bigint, vagas int",
    )
    r = rows(performance.party_votes(t))[0]
    assert (r["votos_legenda_total"], r["quociente_eleitoral"], r["votacao_partido"]) == (120, 333, 1000)
    assert r["votacao_em_qe"] == near(1000 / 333) and r["quociente_partidario"] == 3


def test_group_members_and_empty_group(frame):
    v = frame([(1, 10, 5), (2, 10, 7), (3, 20, 1)], VOTES)
    members = frame([(1,), (2,), (9,)], "sq_candidato int")
    assert rows(groups.aggregate_group(v, members, "g")) == [{"grupo": "g", "cd_mun_ibge": 10, "votos": 12}]
    with pytest.raises(ValueError, match="no members"):
        groups.aggregate_group(v, members.filter("false"), "g")


def test_long_member_list_is_not_cut(spark, frame):
    v = spark.range(5000).select(F.col("id").alias("sq_candidato"))
    assert groups.members_filter(v, range(0, 5000, 2)).count() == 2500
    assert groups.members_filter(v, []).count() == 0


CANDIDATES = "cd_cargo int, sg_uf string, sq_candidato int, nr_partido int, ds_sit_tot_turno string, votos bigint"


def test_elected_order_and_exclusions(frame):
    t = frame(
        [
            (6, "SP", 1, 10, "Eleito", 50), (6, "SP", 2, 11, "ELEITO POR MÉDIA", 50), (6, "SP", 3, 14, "Eleito", 90),
            (6, "SP", 4, 10, "2º turno", 99), (6, "SP", 5, 10, None, None), (6, "SP", 6, 10, "Eleito por QP", 70),
            (6, "RJ", 7, 10, "Suplente", 5),
        ],
        CANDIDATES,
    )
    got = rows(reference.select_elected(t, n=2, exclude_ids=[6]), "sg_uf", "posicao")
    assert [(r["posicao"], r["sq_candidato"]) for r in got] == [(1, 1), (2, 2)]


@pytest.mark.parametrize(
    "bad", [(6, "SP", 2, 10, "Talvez", 1), (6, "SP", 2, 10, "Eleito", None), (6, "SP", 1, 10, "Eleito", 1)]
)
def test_elected_rejects_bad_rows(frame, bad):
    t = frame([(6, "SP", 1, 10, "Eleito", 50), bad], CANDIDATES)
    with pytest.raises(FAILURES):
        reference.select_elected(t).collect()


PROFILE = "cd_cargo int, sg_uf string, sq_candidato int, penetracao double, pct_publico double, votos bigint"


def test_relative_profile_kinds_and_minimum(frame):
    ours = frame([(6, "SP", 1, 4.0, 60.0, 10), (6, "RJ", 2, 4.0, None, 10)], PROFILE)
    ref = frame([(6, "SP", i, float(i), 10.0 * i, 5) for i in (1, 2, 3)], PROFILE)
    names = ("votos", "penetracao", "pct_publico")
    got = {(r["sg_uf"], r["indicador"]): r for r in rows(reference.relative_profile(ours, ref, names))}
    assert got["SP", "penetracao"]["indice"] == near(2.0)
    assert got["SP", "pct_publico"]["indice"] == near(40.0)
    assert got["SP", "votos"]["indice"] is None and got["SP", "votos"]["mediana_referencia"] == 5.0
    assert got["RJ", "penetracao"]["n_referencia"] == 0 and got["RJ", "penetracao"]["indice"] is None
    few = rows(reference.relative_profile(ours, ref.limit(2), ("penetracao",)), "sg_uf")
    assert few[1]["mediana_referencia"] is None and few[1]["n_referencia"] == 2
    with pytest.raises(ValueError):
        reference.relative_profile(ours, ref, ("penetracao",), by=("sg_uf",))
    with pytest.raises(ValueError):
        reference.relative_profile(ours, ref, ("inventado",))


def breaks(frame, values, **kw):
    df = frame([(float(v), False) for v in values], "valor double, n_baixo boolean")
    return [r.quebra for r in spatial.class_breaks(df, **kw).orderBy("ordem").collect()]


def test_class_breaks_round_half_up(frame):
    assert breaks(frame, range(0, 101), k=4) == [25.0, 50.0, 75.0]
    assert breaks(frame, [0, 1, 2, 3, 4, 1000.5, 1001.5, 1002.5, 1003.5, 1004.5], k=2) == [500.0]


def test_class_breaks_gain_digits_when_merged(frame):
    # Two digits would merge both thirds into 100; three give 100 and 101, and 100 is the minimum.
    assert breaks(frame, [100 + i / 100 for i in range(101)], k=3) == [101.0]
    # Two digits keep 1.0 and 1.1 apart.
    assert breaks(frame, [1 + i / 1000 for i in range(101)], k=3) == [1.1]


def test_class_breaks_need_values_and_variation(frame):
    for values in ([1, 2, 3], [5] * 20):
        with pytest.raises(FAILURES, match="class_breaks"):
            breaks(frame, values, k=4)


def test_assigned_classes_are_closed_below(frame):
    df = frame([(0.5,), (1.0,), (2.0,), (None,)], "valor double")
    b = frame([(1.0,), (2.0,)], "quebra double")
    assert [r.classe for r in spatial.with_class(df, b).collect()] == [0, 1, 2, None]


def test_symmetric_extent(frame):
    def top(*values):
        return spatial.symmetric_extent(frame([(float(v),) for v in values], "valor double")).first().extensao

    assert (top(-37, 12), top(0, 0), top(0.042)) == (40.0, 1.0, pytest.approx(0.05))


# --- spatial autocorrelation ---------------------------------------------------------------------

RING = [(i, (i + 1) % 8) for i in range(8)] + [((i + 1) % 8, i) for i in range(8)]


def test_moran_on_a_ring(frame):
    y = [1.0, 2.0, 4.0, 8.0, 8.0, 4.0, 2.0, 1.0]
    values, edges = frame(list(enumerate(y)), "id int, valor double"), frame(RING, "id int, vizinho int")
    mean = sum(y) / 8
    z = [v - mean for v in y]
    lag = [(z[i - 1] + z[(i + 1) % 8]) / 2 for i in range(8)]
    expected = sum(a * b for a, b in zip(z, lag)) / sum(a * a for a in z)
    assert spatial.moran_global(values, edges).first().moran_i == near(expected)
    local = rows(spatial.moran_local(values, edges), "id")
    m2 = sum(a * a for a in z) / 8
    assert [r["lisa"] for r in local] == [near(a * b / m2) for a, b in zip(z, lag)]
    assert local[3]["quadrante"] == "alto-alto" and local[0]["quadrante"] == "baixo-baixo"
    p = spatial.moran_global_p(values, edges, permutations=99).first()
    assert p.moran_i == near(expected) and 0.01 <= p.pseudo_p <= 0.2
    again = spatial.moran_global_p(values.repartition(3), edges.repartition(2), permutations=99).first()
    assert again.pseudo_p == p.pseudo_p
    lp = rows(spatial.moran_local_p(values, edges, permutations=49), "id")
    assert all(1 / 50 <= r["pseudo_p"] <= 1 for r in lp)


def test_no_permutations_no_inference(frame):
    values, edges = frame([(1, 1.0), (2, 2.0), (3, 5.0)], "id bigint, valor double"), frame([(1, 2), (2, 1), (2, 3), (3, 2)], "id bigint, vizinho bigint")
    p = spatial.moran_global_p(values, edges, permutations=0).first()
    assert p.moran_i is not None and p.pseudo_p is None
    assert {r["pseudo_p"] for r in rows(spatial.moran_local_p(values, edges, permutations=0))} == {None}
    with pytest.raises(ValueError):
        spatial.moran_global_p(values, edges, permutations=-1)


def test_moran_without_variance_is_null(frame):
    values, edges = frame([(i, 3.0) for i in range(8)], "id int, valor double"), frame(RING, "id int, vizinho int")
    assert spatial.moran_global(values, edges).first().moran_i is None
    assert {r["lisa"] for r in rows(spatial.moran_local(values, edges))} == {None}


@pytest.mark.parametrize(
    ("values", "edges"),
    [
        ([(1, 1.0), (2, None)], [(1, 2), (2, 1)]),
        ([(1, 1.0), (1, 2.0)], [(1, 1)]),
        ([(1, 1.0), (2, 2.0)], [(1, 2), (2, 7)]),
        ([(1, 1.0), (2, 2.0), (3, 5.0)], [(1, 2), (2, 1)]),
    ],
)
def test_moran_rejects_bad_input(frame, values, edges):
    with pytest.raises(FAILURES, match="moran"):
        spatial.moran_local(frame(values, "id int, valor double"), frame(edges, "id int, vizinho int")).collect()


def test_distinct_draws_are_uniform_subsets(spark):
    df = spark.range(3000).select(spatial._distinct_draws(F.lit(5), F.lit(3), F.col("id")).alias("d"))
    assert df.filter(F.size(F.array_distinct("d")) != 3).count() == 0
    share = df.select(F.explode("d").alias("x")).groupBy("x").count().collect()
    assert len(share) == 5 and all(abs(r["count"] / 3000 - 0.6) < 0.05 for r in share)


def test_nearly_equal_shares_keep_their_digits(frame):
    from fractions import Fraction

    electors = [10**9 + 7, 2 * 10**9 + 11, 3 * 10**9 + 1, 10**9]
    data = [(1, i, e // 10 + (3 if i == 0 else 0), e, e) for i, e in enumerate(electors)]
    got = rows(spatial.concentration(frame(data, "sq_candidato int, cd_mun_ibge int, votos bigint, aptos bigint, validos bigint")))[0]
    v, a = sum(d[2] for d in data), sum(electors)
    exact = sum((Fraction(d[2], v) - Fraction(d[3], a)) ** 2 for d in data)
    assert 0 < exact < Fraction(1, 10**16)
    assert got["indice_g"] == pytest.approx(float(exact), rel=1e-9)
    assert got["hhi"] == pytest.approx(float(sum(Fraction(d[2], v) ** 2 for d in data)), rel=1e-14)


def test_concentration_of_fractions_and_of_totals_beyond_the_exact_range(frame):
    kind = "sq_candidato int, cd_mun_ibge int, votos {0}, aptos {0}, validos {0}"
    small = [(1, 1, 5, 10, 9), (1, 2, 1, 30, 20)]
    a = rows(spatial.concentration(frame(small, kind.format("bigint"))))[0]
    b = rows(spatial.concentration(frame([(c, u, *map(float, x)) for c, u, *x in small], kind.format("double"))))[0]
    scaled = [(c, u, *(k * 10**8 for k in x)) for c, u, *x in small] + [(1, 3 + i, 2 * 10**9, 2 * 10**9, 2 * 10**9) for i in range(50)]
    big = rows(spatial.concentration(frame(scaled, kind.format("bigint"))))[0]
    assert b["indice_g"] == near(a["indice_g"]) == near((5 / 6 - 0.25) ** 2 + (1 / 6 - 0.75) ** 2)
    v, e = sum(r[2] for r in scaled), sum(r[3] for r in scaled)
    assert big["indice_g"] == pytest.approx(sum((r[2] / v - r[3] / e) ** 2 for r in scaled), rel=1e-6)


def test_low_count_query_has_every_unit_of_every_entity(spark):
    from escrutinio.catalogue import votes as catalogue

    folder = "/root/testdata/sf0.001"
    all_rows = catalogue.low_count(spark, folder)
    entities, units = catalogue.votes(spark, folder).select("sq_candidato").distinct().count(), catalogue.electorate(spark, folder).count()
    assert all_rows.count() == entities * units
    wanted = catalogue.dense_zeros(spark, folder).agg(F.sum("sem_voto")).first()[0]
    assert all_rows.filter("votos = 0").count() == wanted
