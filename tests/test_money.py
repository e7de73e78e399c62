import pytest
from pyspark.sql import functions as F

from escrutinio.operators import evolution as ev
from escrutinio.operators import finance as fi
from escrutinio.plans import accounts
from tests.conftest import FAILURES, rows

REVENUE = (
    "sq_candidato int, ds_fonte_receita string, ds_origem_receita string, "
    "ds_natureza_receita string, vr_receita double, sq_candidato_doador int"
)


def near(value):
    return pytest.approx(value, abs=1e-9)


def entries(frame):
    return frame(
        [
            (1, "Fundo Especial", "Recursos de partido político", "Financeiro", 100.0, None),
            (1, "OUTROS  RECURSOS", "Recursos próprios", "Estimável", 50.0, None),
            (1, "Outros Recursos", "Recursos de outros candidatos", "Financeiro", 30.0, 2),
            (2, "Outros Recursos", "Fundo Partidário", "Financeiro", 20.0, None),
            (2, "Outros Recursos", "Doações pela Internet", "Financeiro", 0.0, None),
        ],
        REVENUE,
    )


def test_summary_of_classified_and_raw_entries_agree(frame):
    raw = rows(fi.revenue_summary(entries(frame)), "sq_candidato")
    assert raw == rows(fi.revenue_summary(fi.classify_revenue(entries(frame))), "sq_candidato")
    one, two = raw
    assert (one["receita_total"], one["receita_financeira"], one["receita_estimavel"]) == (180.0, 130.0, 50.0)
    assert one["receita_repasses_candidatos"] == 30.0 and one["receita_sem_repasses"] == 150.0
    assert one["pct_publico"] == near(100 * 100 / 180) and one["pct_autofinanciamento"] == near(100 * 50 / 180)
    assert one["hhi_fontes"] == near((100**2 + 50**2 + 30**2) / 180**2)
    assert two["receita_fundo_partidario"] == 20.0 and two["receita_repasses_candidatos"] == 20.0


@pytest.mark.parametrize(
    "bad",
    [
        (1, "Loteria", "Recursos próprios", "Financeiro", 1.0, None),
        (1, "Outros Recursos", "Herança", "Financeiro", 1.0, None),
        (1, "Outros Recursos", None, "Financeiro", 1.0, None),
        (1, "Outros Recursos", "Recursos próprios", "Outra", 1.0, None),
        (1, "Outros Recursos", "Recursos próprios", "Financeiro", -1.0, None),
    ],
)
def test_unknown_labels_and_negative_amounts_fail(frame, bad):
    with pytest.raises(FAILURES):
        fi.revenue_summary(frame([bad], REVENUE)).collect()


def test_zero_total_has_null_shares(frame):
    df = frame([(1, "Outros Recursos", "Recursos próprios", "Financeiro", 0.0, None)], REVENUE)
    r = rows(fi.revenue_summary(df))[0]
    assert r["receita_total"] == 0.0 and r["pct_publico"] is None and r["hhi_fontes"] is None


def test_group_revenue_drops_internal_transfers(frame):
    members = frame([(1,), (2,)], "sq_candidato int")
    r = rows(fi.group_revenue(entries(frame), members))[0]
    assert (r["receita_total"], r["receita_repasses_internos"]) == (170.0, 30.0)
    assert r["receita_repasses_doador_desconhecido"] == 20.0


def test_money_sums_do_not_depend_on_partitions(spark):
    df = spark.range(20000).select((F.col("id") * 0.01 + 0.1).alias("v"))
    sums = {df.repartition(n).agg(fi.money_sum(F.col("v")).alias("s")).first().s for n in (1, 3, 7)}
    assert len(sums) == 1


def test_campaign_expense_excludes_transfers(frame):
    df = frame(
        [(1, "Doações financeiras a outros candidatos/partidos", 10.0), (1, "Pessoal", 5.0), (2, "Pessoal", 1.0)],
        "sq_candidato int, ds_origem_despesa string, v double",
    )
    assert [r["despesa"] for r in rows(fi.campaign_expense(df, "v"), "sq_candidato")] == [5.0, 1.0]
    whole = fi.campaign_expense(df, "v", include_transfers=True)
    assert [r["despesa"] for r in rows(whole, "sq_candidato")] == [15.0, 1.0]
    with pytest.raises(FAILURES):
        fi.campaign_expense(df.withColumn("ds_origem_despesa", F.lit(None).cast("string")), "v").collect()


ACCOUNTS = "sq int, despesa_contratada double, despesa_paga double, votos int, receita_total double, receita_financeira double"


def account_rows(frame):
    return frame(
        [(1, 100.0, None, 50, 120.0, 100.0), (2, 60.0, 30.0, 0, 0.0, 0.0), (3, None, None, 10, None, None), (4, 90.0, 90.0, 30, 200.0, 200.0)],
        ACCOUNTS,
    )


def test_cost_per_vote_and_paid_rule(frame):
    got = {r["sq"]: r for r in rows(fi.cost_per_vote(account_rows(frame)))}
    assert got[1]["despesa_paga"] == 0.0 and got[1]["divida"] == 100.0 and got[1]["custo_voto_contratado"] == 2.0
    assert got[2]["custo_voto_contratado"] is None
    assert got[3]["despesa_paga"] is None and got[3]["divida"] is None


def test_totals_are_sums_over_sums(frame):
    r = rows(fi.total_cost_per_vote(account_rows(frame)))[0]
    assert r["custo_voto_contratado"] == near(190 / 80) and r["mediana_custo_voto_contratado"] == near(2.5)
    assert (r["candidatos_sem_voto_excluidos"], r["candidatos_sem_contas_excluidos"]) == (1, 1)
    q = rows(fi.total_revenue_per_vote(account_rows(frame)))[0]
    assert q["receita_por_voto"] == near(320 / 80)


def test_alert_band_is_inclusive(frame):
    df = frame(
        [(1, 100.0, 70.0, None), (2, 100.0, 110.0, 1.0), (3, 100.0, 69.9, 1.0), (4, 100.0, 110.1, 1.0), (5, 0.0, 1.0, 1.0), (6, 10.0, None, None)],
        "sq int, receita_financeira double, despesa_contratada double, despesa_paga double",
    )
    got = [(r["alerta_declaracao"], r["sentido_alerta"]) for r in rows(fi.spending_alert(df), "sq")]
    assert got == [(False, None), (False, None), (True, "abaixo"), (True, "acima"), (None, None), (None, None)]


def test_distribution_counts_zero_but_not_missing(frame):
    df = frame([(0.0,), (10.0,), (20.0,), (None,)], "receita_total double")
    r = rows(fi.revenue_distribution(df))[0]
    assert (r["n_candidatos"], r["n_com_contas"], r["soma"], r["media"], r["mediana"], r["p25"], r["maximo"]) == (
        4, 3, 30.0, 10.0, 10.0, 5.0, 20.0,
    )
    nothing = rows(fi.revenue_distribution(df.filter("receita_total is null")))[0]
    assert nothing["soma"] is None and nothing["media"] is None and nothing["n_candidatos"] == 1


SERIES = [("2022-09", 0.5), ("2022-10", 1.0), ("2022-11", -0.5), ("2022-12", 2.0), ("2023-01", 0.0)]


def test_price_factor_and_index(frame):
    s = frame(SERIES, "mes string, variacao double")
    assert fi.price_factor(s, "2022-09", "2022-12").first().fator == near(1.01 * 0.995 * 1.02)
    assert fi.price_factor(s, "2022-10", "2022-10").first().fator == 1.0
    index = [r["indice"] for r in rows(fi.price_index(s), "mes")]
    assert index[0] == near(100.5) and index[-1] == near(100.5 * 1.01 * 0.995 * 1.02)
    assert fi.resolve_base_month(s, "2022-09", "2030-01").first().mes_base == "2023-01"
    assert fi.resolve_base_month(s, "2022-09", "2022-10").first().mes_base == "2022-10"


@pytest.mark.parametrize(("origin", "base"), [("2022-12", "2022-09"), ("2022-09", "2023-02"), ("2022-9", "2022-12")])
def test_price_factor_rejects(frame, origin, base):
    with pytest.raises(FAILURES):
        fi.price_factor(frame(SERIES, "mes string, variacao double"), origin, base).collect()


def test_repeated_month_fails(frame):
    with pytest.raises(FAILURES):
        fi.price_factor(frame([*SERIES, ("2022-10", 3.0)], "mes string, variacao double"), "2022-09", "2022-12").collect()


def test_compare_revenue(frame):
    s = frame(SERIES, "mes string, variacao double")
    df = frame([(100.0, 150.0, 10.0, 12.0)], "r_2022 double, r_2026 double, p_2022 double, p_2026 double")
    r = rows(fi.compare_revenue(df, ["r"], ["p"], s, "2022-09", "2022-10"))[0]
    assert r["r_2022"] == near(101.0) and r["delta_r"] == near(49.0) and r["delta_p"] == near(2.0)
    assert r["var_pct_r"] == near(100 * (150 / 101 - 1))
    with pytest.raises(ValueError):
        fi.compare_revenue(df, ["r"], ["r"], s, "2022-09", "2022-10")


def test_expense_ledger_meets_null_origins(frame):
    c = frame([(2026, 1, None, 0.0), (2026, 1, None, 4.0), (2026, 1, "A", 5.0)], "ano int, sq_candidato int, ds_origem_despesa string, vr_despesa_contratada double")
    p = frame([(2026, 1, None, 3.0), (2026, 2, "B", 1.0)], "ano int, sq_candidato int, ds_origem_despesa string, vr_pagto_despesa double")
    got = {(r["sq_candidato"], r["ds_origem_despesa"]): (r["vr_despesa_contratada"], r["vr_despesa_paga"]) for r in rows(fi.expense_ledger(c, p))}
    assert got == {(1, None): (4.0, 3.0), (1, "A"): (5.0, 0.0), (2, "B"): (0.0, 1.0)}


def test_member_with_transfers_only_has_zero_expense(frame):
    e = frame([(1, "Doações financeiras a outros candidatos/partidos", 9.0, 9.0)], "sq_candidato int, ds_origem_despesa string, vr_despesa_contratada double, vr_despesa_paga double")
    members = frame([(1,), (2,), (3,)], "sq_candidato int")
    votes = frame([(1, 3), (2, 4)], "sq_candidato int, votos bigint")
    got = {r["sq_candidato"]: r for r in rows(accounts.candidate_accounts(members, votes, entries(frame), e))}
    assert set(got) == {1, 2}
    assert got[1]["despesa_contratada"] == 0.0 and got[1]["saldo_contratado"] == 171.0


# --- evolution -----------------------------------------------------------------------------------

COUNTS = "cd_mun_ibge int, aptos bigint, validos bigint, votos bigint"


def test_evolution_sums_before_rates_and_keeps_gaps(frame):
    areas = frame([(1, 1), (2, 1), (3, 3), (4, 4)], "cd_mun_ibge int, amc int")
    old = frame([(1, 100, 80, 8), (2, 300, 100, 10), (3, 50, 40, 0)], COUNTS)
    new = frame([(1, 200, 90, 30), (2, 300, 110, 30), (4, 10, 10, 1)], COUNTS)
    got = {r["amc"]: r for r in rows(ev.evolution(old, new, areas, office=6))}
    assert got[1]["delta_penetracao"] == near(1000 * 60 / 500 - 1000 * 18 / 400)
    assert got[1]["swing_pp"] == near(100 * 60 / 200 - 100 * 18 / 180)
    assert got[1]["retencao"] == near(60 / 18) and got[1]["ganho_absoluto"] == 42
    for area in (3, 4):
        assert got[area]["delta_penetracao"] is None and got[area]["ganho_absoluto"] is None


def test_evolution_rejects_senate_and_unmapped(frame):
    areas = frame([(1, 1)], "cd_mun_ibge int, amc int")
    df = frame([(2, 1, 1, 1)], COUNTS)
    with pytest.raises(ValueError):
        ev.evolution(df, df, areas, office=5)
    with pytest.raises(FAILURES, match="without an area"):
        ev.evolution(df, df, areas, office=6).collect()
    twice = frame([(2, 1), (2, 2)], "cd_mun_ibge int, amc int")
    with pytest.raises(FAILURES, match="repeated"):
        ev.evolution(df, df, twice, office=6).collect()


def test_strongholds_and_overlap(frame):
    df = frame(
        [(1, 3.0, 2.0, False), (2, 2.5, 1.0, False), (3, 1.0, 5.0, True), (4, 0.5, 0.4, False)],
        "amc int, lq_2022 double, lq_2026 double, n_baixo boolean",
    )
    r = rows(ev.stronghold_overlap(df))[0]
    assert (r["n_redutos_2022"], r["n_redutos_2026"], r["jaccard"]) == (2, 1, 0.5)
    assert r["spearman"] == near(0.4)
    none = rows(ev.stronghold_overlap(df.filter("amc = 4")))[0]
    assert none["jaccard"] is None and none["spearman"] is None


def test_same_people(frame):
    s = "pessoa_id string, votos bigint"
    a, b = frame([("x", 10), ("y", 5)], s), frame([("x", 15), ("z", 1)], s)
    r = rows(ev.same_people(a, b))[0]
    assert (r["n_comuns"], r["n_2022"], r["n_2026"], r["votos_2022"], r["votos_2026"], r["retencao"]) == (1, 2, 2, 10, 15, 1.5)
    with pytest.raises(FAILURES, match="repeated"):
        ev.same_people(frame([("x", 1), ("x", 2)], s), b).collect()


def test_member_of_two_groups_has_one_row_each(frame):
    from escrutinio.plans.accounts import candidate_accounts

    members = frame([(1, "a"), (1, "b")], "sq_candidato bigint, grupo string")
    votes = frame([(1, 10)], "sq_candidato bigint, votos bigint")
    money = "sq_candidato bigint, ds_fonte_receita string, ds_origem_receita string, ds_natureza_receita string, vr_receita double"
    revenue = frame([], money)
    expenses = frame([(1, "X", 100.0, 50.0)], "sq_candidato bigint, ds_origem_despesa string, vr_despesa_contratada double, vr_despesa_paga double")
    out = candidate_accounts(members, votes, revenue, expenses)
    assert sorted(r.grupo for r in out.select("grupo").collect()) == ["a", "b"]
