from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from escrutinio.operators import social as so
from escrutinio.operators import statistics as st
from escrutinio.streaming import snapshots
from tests.conftest import FAILURES, rows

PROFILES = (
    "sq_candidato int, username string, status string, followers_count bigint, "
    "follows_count bigint, coletado_em timestamp_ntz"
)
POSTS = (
    "username string, media_id string, timestamp timestamp_ntz, media_type string, "
    "like_count bigint, comments_count bigint, coletado_em timestamp_ntz"
)


def day(d, h=12, month=10):
    return datetime(2026, month, d, h)


def near(value):
    return pytest.approx(value, abs=1e-9)


def readings(frame):
    return frame(
        [
            (1, "a", "ok", 100, 5, day(8)), (1, "a", "nao_encontrado", None, None, day(9)),
            (1, "a", "nao_encontrado", None, None, day(10)), (1, "b", "ok", 90, 1, day(10)),
            (2, "d", "nao_comercial", None, None, day(8)), (2, "c", "nao_comercial", None, None, day(9)),
            (3, "e", "ok", 50, 1, day(8)), (3, "f", "ok", 50, 1, day(8)),
        ],
        PROFILES,
    )


def test_analysed_account_survives_failures(frame):
    got = {r["sq_candidato"]: r for r in rows(so.analysed_account(readings(frame)))}
    one = got[1]
    assert (one["username"], one["seguidores"], one["status"], one["status_ultima_coleta"]) == ("a", 100, "ok", "nao_encontrado")
    assert one["conta_indisponivel_desde"] == day(9) and one["desatualizado"]
    assert (got[2]["username"], got[2]["seguidores"], got[2]["status"]) == ("c", None, "nao_comercial")
    assert got[3]["username"] == "e" and not got[3]["desatualizado"]


def test_series_and_summary(frame):
    p = frame(
        [(1, "a", "ok", 100, 1, day(8)), (1, "a", "x", None, None, day(9)), (1, "a", "ok", 150, 1, day(10, 0)), (1, "z", "ok", 7, 1, day(8))],
        PROFILES,
    )
    s = rows(so.follower_series(p), "username", "coletado_em")
    assert (s[0]["delta_abs"], s[1]["delta_abs"], s[1]["delta_pct"], s[1]["dias"]) == (None, 50, near(50.0), 1.5)
    m = {r["username"]: r for r in rows(so.follower_summary(p))}
    assert (m["a"]["n_snapshots"], m["a"]["delta_abs"], m["a"]["dias"]) == (2, 50, 1.5)
    assert m["z"]["delta_abs"] is None and m["z"]["seguidores_final"] == 7


def test_repeated_reading_fails(frame):
    p = frame([(1, "a", "ok", 1, 1, day(8)), (1, "a", "ok", 2, 1, day(8))], PROFILES)
    with pytest.raises(FAILURES, match="repeated reading"):
        so.latest_snapshot(p).collect()


def test_windows_use_local_days_and_old_posts_only(frame):
    p = frame([(1, "a", "ok", 200, 1, day(20)), (2, "n", "x", None, None, day(20))], PROFILES)
    posts = frame(
        [
            ("a", "1", datetime(2026, 8, 16, 2, 30), "VIDEO", 10, 2, day(20)),
            ("a", "2", datetime(2026, 8, 16, 3, 0), "IMAGE", None, 2, day(20)),
            ("a", "3", datetime(2026, 9, 1), "VIDEO", 20, 0, datetime(2026, 9, 2)),
            ("a", "3", datetime(2026, 9, 1), "VIDEO", 30, 0, day(20)),
            ("a", "4", day(19), "VIDEO", 99, 9, day(20)),
            ("n", "5", day(1), "VIDEO", 1, 1, day(20)),
        ],
        POSTS,
    )
    got = {r["janela"]: r for r in rows(so.window_metrics(p, posts))}
    assert {k: v["n_posts"] for k, v in got.items()} == {"pre_campanha": 1, "campanha": 2, "pos_eleicao": 1, "total": 4}
    c = got["campanha"]
    assert c["dias"] == 50.0 and c["n_videos"] == 1 and c["n_posts_engajamento"] == 1
    assert c["engajamento_medio"] == near(100 * 30 / 200) and c["posts_por_semana"] == near(7 * 2 / 50)
    late = got["pos_eleicao"]
    assert late["n_posts_engajamento"] == 0 and late["engajamento_mediano"] is None and late["dias"] == near(15.375)
    assert got["pre_campanha"]["pct_video"] == 100.0


def test_short_window_has_no_weekly_rate(frame):
    p = frame([(1, "a", "ok", 10, 1, day(8))], PROFILES)
    posts = frame([("a", "1", day(6), "VIDEO", 1, 1, day(8))], POSTS)
    got = {r["janela"]: r for r in rows(so.window_metrics(p, posts))}
    assert got["pos_eleicao"]["n_posts"] == 1 and got["pos_eleicao"]["posts_por_semana"] is None


def test_candidate_without_profile(frame):
    votes = frame([(1, 6, 50), (9, 6, 0)], "sq_candidato int, cd_cargo int, votos bigint")
    got = {r["sq_candidato"]: r for r in rows(so.candidate_social(readings(frame), frame([], POSTS), votes))}
    assert got[9]["status"] == "sem_rede" and not got[9]["tem_dados"] and not got[9]["desatualizado"]
    assert got[1]["seguidores_por_mil_votos"] == near(2000.0) and got[1]["votos_por_mil_seguidores"] == near(500.0)


def test_renames(frame):
    m = "username_tse string, username_atual string"
    df = frame([("old",), ("other",)], "username string")
    assert {r["username"] for r in rows(so.rename_accounts(df, frame([("old", "new"), ("x", "x")], m)))} == {"new", "other"}
    assert so.rename_accounts(df, None) is df
    for bad in ([("old", "a"), ("old", "b")], [("old", "other"), ("other", "z")]):
        with pytest.raises(FAILURES, match="rename_accounts"):
            so.rename_accounts(df, frame(bad, m)).collect()


def test_exclusions_have_one_reason(frame):
    df = frame(
        [("sem_rede", False, 1), ("nao_coletado", False, 1), ("nao_comercial", False, 1), ("ok", True, None), ("ok", True, 5)],
        "status string, tem_dados boolean, votos int",
    )
    assert {r["motivo"]: r["n"] for r in rows(so.excluded_counts(df))} == {
        "sem_instagram": 1, "nao_coletado": 1, "indisponivel": 1, "sem_votos": 1,
    }


# --- statistics ----------------------------------------------------------------------------------

PAIRS = "cd_cargo int, sq_candidato int, seguidores double, votos double"


def pairs(n=30, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(5, 1, n))
    return [(6, i, float(a), float(np.round(a * rng.lognormal(0, 1)))) for i, a in enumerate(x)]


def test_spearman_matches_ranked_pearson(frame):
    data = pairs()
    got = st.spearman(frame([*data, (6, 99, None, 1.0)], PAIRS), "seguidores", "votos", ["cd_cargo"]).first()
    pdf = pd.DataFrame(data, columns=["c", "i", "x", "y"])
    assert got.n == 30 and got.rho == near(pdf.x.rank().corr(pdf.y.rank()))


@pytest.mark.parametrize("data", [[(6, 1, 1.0, 2.0)], [(6, 1, 1.0, 2.0), (6, 2, 1.0, 3.0)]])
def test_undefined_spearman_is_null(frame, data):
    assert st.spearman(frame(data, PAIRS), "seguidores", "votos").first().rho is None


def test_bootstrap_interval_is_repeatable_and_covers_rho(frame):
    df = frame([*pairs(), (6, 99, None, 1.0), (7, 1, 1.0, 1.0)], PAIRS)
    got = {r["cd_cargo"]: r for r in rows(st.correlation(df, "seguidores", "votos", resamples=100))}
    six = got[6]
    assert (six["n"], six["n_excluidos"], six["n_bootstrap_validos"]) == (30, 1, 100)
    assert six["ic_inf"] < six["rho"] < six["ic_sup"]
    assert got[7]["rho"] is None and got[7]["ic_inf"] is None
    again = {r["cd_cargo"]: r for r in rows(st.correlation(df.repartition(7), "seguidores", "votos", resamples=100))}
    assert again[6] == pytest.approx(six)


def test_bootstrap_width_agrees_with_numpy(frame):
    data = pairs(40, 3)
    got = rows(st.correlation(frame(data, PAIRS), "seguidores", "votos", resamples=400))[0]
    pdf = pd.DataFrame(data, columns=["c", "i", "x", "y"])
    rng = np.random.default_rng(0)
    reps = []
    for _ in range(400):
        s = pdf.iloc[rng.integers(0, 40, 40)]
        reps.append(s.x.rank().corr(s.y.rank()))
    lo, hi = np.quantile(reps, [0.025, 0.975])
    assert abs(got["ic_inf"] - lo) < 0.12 and abs(got["ic_sup"] - hi) < 0.12


def test_log_residual_matches_least_squares(frame):
    data = pairs(20, 5)
    got = rows(st.log_residual(frame(data, PAIRS)), "sq_candidato")
    x, y = np.log10(1 + np.array([d[2] for d in data])), np.log10(1 + np.array([d[3] for d in data]))
    b, a = np.polyfit(x, y, 1)
    assert got[0]["inclinacao"] == pytest.approx(b) and got[0]["intercepto"] == pytest.approx(a)
    by_id = {r["sq_candidato"]: r for r in got}
    assert by_id[4]["residuo_log10"] == pytest.approx(y[4] - a - b * x[4])
    few = rows(st.log_residual(frame(data[:5], PAIRS)))
    assert {r["inclinacao"] for r in few} == {None}
    constant = rows(st.log_residual(frame([(6, i, 5.0, float(i)) for i in range(12)], PAIRS)))
    assert {r["inclinacao"] for r in constant} == {None}
    with pytest.raises(FAILURES, match="negative"):
        st.log_residual(frame([(6, 1, -1.0, 1.0)], PAIRS)).collect()


# --- ingestion -----------------------------------------------------------------------------------


def test_stream_ingests_once_and_keeps_last_post(spark, frame, tmp_path):
    src, log, ckpt = (str(tmp_path / n) for n in ("src", "log", "ckpt"))
    first = frame([("a", "1", day(1), "VIDEO", 5, 0, day(8)), ("a", "2", day(2), "VIDEO", 1, 0, day(8))], POSTS)
    first.write.parquet(src)
    for _ in range(2):
        snapshots.ingest(snapshots.open_stream(spark, src, first.schema), log, ckpt).awaitTermination()
    again = frame([("a", "1", day(1), "VIDEO", 9, 1, day(9))], POSTS)
    again.write.mode("append").parquet(src)
    snapshots.ingest(snapshots.open_stream(spark, src, first.schema), log, ckpt).awaitTermination()
    got = {r["media_id"]: r["like_count"] for r in rows(snapshots.current_posts(spark, log, first.schema))}
    assert got == {"1": 9, "2": 1}
    # A replayed batch takes the place of itself.
    run = next(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("execucao=")).removeprefix("execucao=")
    snapshots.batch_writer(log, run=run)(again, 1)
    assert snapshots.current_posts(spark, log, first.schema).count() == 2
    with pytest.raises(ValueError, match="run"):
        snapshots.batch_writer(log)(again, 1)
    snapshots.compact(snapshots.current_posts(spark, log, first.schema), str(tmp_path / "base"))
    assert snapshots.current_posts(spark, str(tmp_path / "base"), first.schema).count() == 2


def test_stream_drops_repeated_readings(spark, frame, tmp_path):
    src, log, ckpt = (str(tmp_path / n) for n in ("src", "log", "ckpt"))
    schema = "sq_candidato bigint, ano_eleicao int, rede string, username string, followers_count bigint, coletado_em timestamp"
    row = (1, 2026, "instagram", "a", 5, day(8))
    frame([row, row, (1, 2026, "instagram", "a", 6, day(9))], schema).write.parquet(src)
    stream = snapshots.open_stream(spark, src, spark.read.parquet(src).schema)
    snapshots.ingest(stream, log, ckpt, key=snapshots.PROFILE_KEY).awaitTermination()
    got = snapshots.current_profiles(spark, log, spark.read.parquet(src).schema)
    assert got.count() == 2 and spark.read.parquet(log).count() == 2


def test_late_readings_and_other_runs_are_kept(spark, frame, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    schema = "sq_candidato bigint, ano_eleicao int, rede string, username string, followers_count bigint, coletado_em timestamp"
    kind = frame([], schema).schema

    def take(days, checkpoint):
        frame([(1, 2026, "instagram", "a", d, day(d)) for d in days], schema).write.mode("append").parquet(src)
        snapshots.ingest(snapshots.open_stream(spark, src, kind), log, str(tmp_path / checkpoint), key=snapshots.PROFILE_KEY).awaitTermination()
        return {r["followers_count"] for r in rows(snapshots.current_profiles(spark, log, kind))}

    assert snapshots.current_profiles(spark, log, kind).count() == 0
    assert take([20, 21], "c1") == {20, 21}
    # A batch that was written and not committed, as by a run that failed, is not read.
    frame([(1, 2026, "instagram", "a", 99, day(25))], schema).write.parquet(f"{log}/execucao=x/lote=0/versao=y")
    assert snapshots.current_profiles(spark, log, kind).count() == 2
    assert take([5], "c1") == {5, 20, 21}
    # A new checkpoint starts at batch 0 again, in a folder of its own.
    src = str(tmp_path / "other")
    assert take([9], "c2") == {5, 9, 20, 21}


def test_cut_off_and_skip(frame):
    from pyspark.sql import functions as F

    items = frame([("a", "1", day(1), "V", 1, 1, day(9)), ("a", "2", day(5), "V", 1, 1, day(9)), ("b", "3", day(2), "V", 1, 1, day(9))], POSTS)
    known = items.filter("media_id = '1'")
    since = F.lit("2026-10-01 00:00:00").cast("timestamp_ntz")
    assert {r["media_id"] for r in rows(snapshots.newer_than_known(items, known, since))} == {"2", "3"}
    now = F.lit(str(day(9) + timedelta(days=6))).cast("timestamp_ntz")
    skip = snapshots.recently_unavailable(readings(frame), now)
    assert {r["username"] for r in rows(skip)} == {"a", "c"}


@pytest.mark.parametrize("mean", [1, 2, 7, 100, 5000])
def test_draws_are_poisson(frame, mean):
    low, high = st._draw_window(F.col("m"))
    steps = frame([(mean,)], "m bigint").select(low.alias("low"), st._draw_steps(F.col("m"), low, high).alias("s")).first()
    k = np.arange(steps.low, steps.low + len(steps.s))
    logs = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, k[-1] + 1))]))[k]
    expected = np.exp(k * np.log(mean) - mean - logs)
    assert np.allclose(np.diff([0.0, *steps.s]), expected, atol=1e-12) and steps.s[-1] == pytest.approx(1.0)


def test_equal_pairs_are_drawn_together(frame):
    data = pairs(40, 3)
    once = rows(st.correlation(frame(data, PAIRS), "seguidores", "votos", resamples=200))[0]
    many = [(c, 1000 * k + i, x, y) for c, i, x, y in data for k in range(50)]
    got = rows(st.correlation(frame(many, PAIRS), "seguidores", "votos", resamples=200))[0]
    assert got["n"] == 50 * once["n"] and got["rho"] == pytest.approx(once["rho"])
    assert (got["ic_sup"] - got["ic_inf"]) < (once["ic_sup"] - once["ic_inf"]) / 4


def test_large_groups_give_the_same(frame):
    data = [*pairs(40, 3), *[(7, 500 + i, float(i % 4), float(i % 3)) for i in range(30)]]
    a = rows(st.correlation(frame(data, PAIRS), "seguidores", "votos", resamples=50), "cd_cargo")
    b = rows(st.correlation(frame(data, PAIRS), "seguidores", "votos", resamples=50, sorted_pairs=20), "cd_cargo")
    assert [r["cd_cargo"] for r in a] == [r["cd_cargo"] for r in b]
    for r, s in zip(a, b):
        assert r == pytest.approx(s)
