"""Profile snapshots and posts: analysed account, series, windows, candidate summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrutinio.functions.checks import fail, require_columns
from escrutinio.functions.instants import as_utc, day_start_utc, days_between, local_day
from escrutinio.functions.rates import ratio
from escrutinio.operators.ordering import exact_quantiles, previous_row

# Campaign calendar, minimum days of a weekly rate, minimum age of a post.
MIN_DAYS_FOR_RATE = 7.0
MIN_POST_AGE_HOURS = 48
NO_NETWORK = "sem_rede"
NOT_COLLECTED = "nao_coletado"
UNAVAILABLE = ("nao_encontrado", "nao_comercial", "erro_transitorio")


@dataclass(frozen=True)
class Period:
    """A window of local days, both ends included; no end means up to the last good reading."""

    name: str
    start: str
    end: str | None = None


CAMPAIGN_PERIODS = (
    Period("pre_campanha", "2026-01-01", "2026-08-15"),
    Period("campanha", "2026-08-16", "2026-10-04"),
    Period("pos_eleicao", "2026-10-05"),
    Period("total", "2026-01-01"),
)

PROFILE_COLUMNS = ("sq_candidato", "username", "status", "followers_count", "coletado_em")
POST_COLUMNS = (
    "username", "media_id", "timestamp", "media_type", "like_count", "comments_count",
    "coletado_em",
)


def _readings(profiles: DataFrame, context: str) -> DataFrame:
    require_columns(profiles, PROFILE_COLUMNS, context)
    return as_utc(profiles, "coletado_em")


def latest_snapshot(profiles: DataFrame) -> DataFrame:
    """WIN-06. Last reading of each account, with or without numbers.

    `max_by` keeps one row per task before the shuffle. The same account read twice at the same
    instant raises.
    """
    rows = _readings(profiles, "latest_snapshot")
    others = [c for c in rows.columns if c != "username"]
    once = _unique_readings(rows, "latest_snapshot")
    return (
        once.groupBy("username")
        .agg(F.max_by(F.struct(*others), "coletado_em").alias("r"))
        .select("username", "r.*")
    )


def _unique_readings(rows: DataFrame, context: str) -> DataFrame:
    """Readings with one row per (account, instant); a repeated one raises."""
    others = [c for c in rows.columns if c not in ("username", "coletado_em")]
    repeated = fail(f"{context}: repeated reading", F.col("username"), F.col("coletado_em"))
    return (
        rows.groupBy("username", "coletado_em")
        .agg(F.first(F.struct(*others)).alias("r"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("username", F.when(F.col("_rows") > 1, repeated).otherwise(F.col("username")))
        .select("username", "coletado_em", "r.*")
        .select(*rows.columns)
    )


def latest_valid(profiles: DataFrame, key: Sequence[str] = ("sq_candidato", "username")) -> DataFrame:
    """WIN-06. Last reading with followers of each key; keys without one are left out."""
    rows = _readings(profiles, "latest_valid").filter(F.col("followers_count").isNotNull())
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "coletado_em").alias("r")).select(
        *key, "r.*"
    )


def rename_accounts(df: DataFrame, renames: DataFrame | None) -> DataFrame:
    """TMP-10. `username` replaced by the current name of the account.

    A repeated old name and a chain (a to b, b to c) raise.
    """
    if renames is None:
        return df
    require_columns(renames, ("username_tse", "username_atual"), "rename_accounts")
    pairs = renames.filter(F.col("username_tse") != F.col("username_atual"))
    targets = pairs.select(F.col("username_atual").alias("_k")).distinct().withColumn("_chain", F.lit(True))
    old = F.col("username_tse")
    mapping = (
        pairs.groupBy("username_tse")
        .agg(F.first("username_atual").alias("_new"), F.count(F.lit(1)).alias("_rows"))
        .join(targets, old == F.col("_k"), "left")
        .select(
            old.alias("username"),
            F.when(F.col("_rows") > 1, fail("rename_accounts: old name repeated", old))
            .when(F.col("_chain"), fail("rename_accounts: chained rename", old))
            .otherwise(F.col("_new"))
            .alias("_new"),
        )
    )
    return (
        df.join(mapping, "username", "left")
        .withColumn("username", F.coalesce("_new", "username"))
        .select(*df.columns)
    )


def analysed_account(profiles: DataFrame) -> DataFrame:
    """WIN-14. The account read for each candidate: most followers ever, ties by name.

    A failed reading never changes the account: numbers stay those of its last good reading, with
    the first failure after it. A candidate without a good reading gets the smallest name and no
    numbers. Everything is two mergeable aggregates: per account, then per candidate.
    """
    context = "analysed_account"
    rows = _readings(profiles, context)
    if "follows_count" not in rows.columns:
        rows = rows.withColumn("follows_count", F.lit(None).cast("bigint"))
    good = F.col("followers_count").isNotNull()
    when_good = F.when(good, F.col("coletado_em"))
    fine = F.struct("status", "followers_count", "follows_count")
    accounts = rows.groupBy("sq_candidato", "username").agg(
        F.max("followers_count").alias("_peak"),
        F.max(when_good).alias("ultima_coleta_ok"),
        F.max_by(fine, when_good).alias("_ok"),
        F.max_by("status", "coletado_em").alias("status_ultima_coleta"),
    )
    # Failures after the last good reading: an equi-join on the account plus an inequality.
    failures = (
        rows.join(
            accounts.filter(F.col("ultima_coleta_ok").isNotNull()).select(
                "sq_candidato", "username", F.col("ultima_coleta_ok").alias("_t")
            ),
            ["sq_candidato", "username"],
        )
        .filter(F.col("coletado_em") > F.col("_t"))
        .groupBy("sq_candidato", "username")
        .agg(F.min("coletado_em").alias("conta_indisponivel_desde"))
    )
    # Largest peak first; without numbers the peak is -1 and the smallest name wins.
    rank = F.struct((-F.coalesce(F.col("_peak"), F.lit(-1))).alias("p"), F.col("username").alias("u"))
    others = [c for c in accounts.columns if c not in ("sq_candidato", "_peak")]
    chosen = accounts.groupBy("sq_candidato").agg(
        F.min_by(F.struct(*others), rank).alias("r")
    ).select("sq_candidato", "r.*")
    return (
        chosen.join(failures, ["sq_candidato", "username"], "left")
        .select(
            "sq_candidato",
            "username",
            F.coalesce(F.col("_ok.status"), F.col("status_ultima_coleta")).alias("status"),
            "status_ultima_coleta",
            F.col("_ok.followers_count").alias("seguidores"),
            F.col("_ok.follows_count").alias("seguindo"),
            "ultima_coleta_ok",
            "conta_indisponivel_desde",
            F.col("conta_indisponivel_desde").isNotNull().alias("desatualizado"),
        )
    )


def latest_posts(posts: DataFrame) -> DataFrame:
    """WIN-07. One row per post: the newest reading, with a full tie-break."""
    require_columns(posts, POST_COLUMNS, "latest_posts")
    rows = as_utc(posts, "timestamp", "coletado_em")
    others = [c for c in rows.columns if c != "media_id"]
    order = F.struct(F.col("coletado_em"), F.coalesce("like_count", F.lit(-1)),
                     F.coalesce("comments_count", F.lit(-1)))
    return rows.groupBy("media_id").agg(F.max_by(F.struct(*others), order).alias("r")).select(
        "media_id", "r.*"
    ).select(*posts.columns)


def period_days(period: Period, end: Column) -> Column:
    """Days of a window; an open one runs to the last good reading of the account."""
    if period.end is not None:
        return (F.datediff(F.lit(period.end), F.lit(period.start)) + 1).cast("double")
    return days_between(end, day_start_utc(period.start))


def period_filter(period: Period, day: Column) -> Column:
    """FIL-06. Local day inside a window."""
    start = F.lit(period.start).cast("date")
    if period.end is None:
        return day >= start
    return day.between(start, F.lit(period.end).cast("date"))


def per_week(n: Column, days: Column) -> Column:
    """Weekly rate; null when the window is too short to tell."""
    return F.when(days >= MIN_DAYS_FOR_RATE, F.lit(7.0) * ratio(n, days))


def window_metrics(
    profiles: DataFrame, posts: DataFrame, periods: Sequence[Period] = CAMPAIGN_PERIODS
) -> DataFrame:
    """TMP-08. Posts, videos, weekly pace and engagement per account and window.

    Each post is sent once to the windows its local day belongs to (a generator, not a range
    join). Only accounts with a good reading have rows; counts are zero where nothing was posted.
    """
    accounts = latest_valid(profiles, ["username"]).select(
        "username", F.col("followers_count").alias("seguidores"), F.col("coletado_em").alias("fim")
    )
    age_ok = F.timestamp_diff("MICROSECOND", F.col("timestamp"), F.col("coletado_em")) >= (
        MIN_POST_AGE_HOURS * 3_600_000_000
    )
    interactions = F.col("like_count") + F.col("comments_count")
    engagement = F.when(age_ok, F.lit(100.0) * ratio(interactions, F.col("seguidores")))
    day = local_day(F.col("timestamp"))
    homes = F.filter(
        F.array(*[F.when(period_filter(p, day), F.lit(p.name)) for p in periods]),
        lambda x: x.isNotNull(),
    )
    placed = (
        latest_posts(posts)
        .join(accounts, "username")
        .select("username", "media_type", engagement.alias("engajamento"), F.explode(homes).alias("janela"))
    )
    keys = ["username", "janela"]
    counted = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.count_if(F.col("media_type") == "VIDEO").alias("n_videos"),
        F.count("engajamento").alias("n_posts_engajamento"),
        F.avg("engajamento").alias("engajamento_medio"),
    )
    medians = exact_quantiles(placed, keys, "engajamento", {"engajamento_mediano": 0.5})
    windows = F.array(
        *[
            F.struct(F.lit(p.name).alias("janela"), period_days(p, F.col("fim")).alias("dias"))
            for p in periods
        ]
    )
    zero = F.lit(0).cast("bigint")
    return (
        accounts.select("username", F.inline(windows))
        .join(counted, keys, "left")
        .join(medians, keys, "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("n_posts", "n_videos", "n_posts_engajamento")})
        .select(
            *keys,
            "dias",
            "n_posts",
            "n_videos",
            per_week(F.col("n_posts"), F.col("dias")).alias("posts_por_semana"),
            per_week(F.col("n_videos"), F.col("dias")).alias("videos_por_semana"),
            (F.lit(100.0) * ratio(F.col("n_videos"), F.col("n_posts"))).alias("pct_video"),
            "n_posts_engajamento",
            "engajamento_medio",
            "engajamento_mediano",
        )
    )


def candidate_social(
    profiles: DataFrame,
    posts: DataFrame,
    votes: DataFrame,
    periods: Sequence[Period] = CAMPAIGN_PERIODS,
) -> DataFrame:
    """TMP-09. One row per candidacy of `votes`: account, ratios, pace and engagement.

    The window rows of an account are turned into columns by one conditional aggregate, instead of
    one join per window. A candidate without a profile has status `sem_rede`.
    """
    require_columns(votes, ("sq_candidato", "cd_cargo", "votos"), "candidate_social")
    windows = window_metrics(profiles, posts, periods)

    def of(window: str, column: str) -> Column:
        return F.max(F.when(F.col("janela") == window, F.col(column)))

    wide = windows.groupBy("username").agg(
        of("campanha", "posts_por_semana").alias("posts_semana_campanha"),
        of("campanha", "engajamento_mediano").alias("engajamento_mediano"),
        of("campanha", "engajamento_medio").alias("engajamento_medio"),
        of("pos_eleicao", "posts_por_semana").alias("posts_semana_pos"),
        of("total", "pct_video").alias("pct_video"),
    )
    repeated = fail("candidate_social: candidacy repeated", F.col("sq_candidato"))
    spine = (
        votes.groupBy("sq_candidato")
        .agg(
            F.first("cd_cargo").alias("cd_cargo"), F.first("votos").alias("votos"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .withColumn("votos", F.when(F.col("_rows") > 1, repeated).otherwise(F.col("votos")))
        .drop("_rows")
    )
    return (
        spine.join(analysed_account(profiles), "sq_candidato", "left")
        .join(wide, "username", "left")
        .select(
            "sq_candidato",
            "cd_cargo",
            "votos",
            "username",
            F.coalesce("status", F.lit(NO_NETWORK)).alias("status"),
            F.col("seguidores").isNotNull().alias("tem_dados"),
            "status_ultima_coleta",
            "ultima_coleta_ok",
            "conta_indisponivel_desde",
            F.coalesce("desatualizado", F.lit(False)).alias("desatualizado"),
            "seguidores",
            "seguindo",
            (F.lit(1000.0) * ratio(F.col("seguidores"), F.col("votos"))).alias(
                "seguidores_por_mil_votos"
            ),
            (F.lit(1000.0) * ratio(F.col("votos"), F.col("seguidores"))).alias(
                "votos_por_mil_seguidores"
            ),
            "posts_semana_campanha",
            "posts_semana_pos",
            (
                F.lit(100.0) * ratio(F.col("posts_semana_pos"), F.col("posts_semana_campanha")) - 100
            ).alias("variacao_ritmo_pct"),
            "pct_video",
            "engajamento_mediano",
            "engajamento_medio",
        )
    )


def follower_series(profiles: DataFrame) -> DataFrame:
    """WIN-08. Followers per good reading, with the change since the one before it.

    Readings are ordered inside days of an account and carried across days: an account with most of
    the readings is cut into as many sorted pieces as it has days, and only its days are in one window.
    """
    rows = _unique_readings(_readings(profiles, "follower_series"), "follower_series").filter(
        F.col("followers_count").isNotNull()
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    day = F.timestamp_diff("DAY", epoch, F.col("coletado_em"))
    followers, before = F.col("followers_count"), F.col("followers_count_anterior")
    return previous_row(
        rows, ["username"], "coletado_em", day, ["followers_count", "coletado_em"]
    ).select(
        "sq_candidato",
        "username",
        "coletado_em",
        followers.alias("seguidores"),
        (followers - before).alias("delta_abs"),
        (F.lit(100.0) * ratio(followers, before) - 100).alias("delta_pct"),
        days_between(F.col("coletado_em"), F.col("coletado_em_anterior")).alias("dias"),
    )


def follower_summary(profiles: DataFrame) -> DataFrame:
    """WIN-09. First to last good reading of each account; a single one has null changes."""
    rows = _readings(profiles, "follower_summary").filter(F.col("followers_count").isNotNull())
    summed = rows.groupBy("username").agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.min_by("followers_count", "coletado_em").alias("seguidores_inicial"),
        F.max_by("followers_count", "coletado_em").alias("seguidores_final"),
        F.min("coletado_em").alias("_t0"),
        F.max("coletado_em").alias("_t1"),
    )
    two = F.col("n_snapshots") >= 2
    first, last = F.col("seguidores_inicial"), F.col("seguidores_final")
    return summed.select(
        "username",
        "n_snapshots",
        "seguidores_inicial",
        "seguidores_final",
        F.when(two, last - first).alias("delta_abs"),
        F.when(two, F.lit(100.0) * ratio(last, first) - 100).alias("delta_pct"),
        F.when(two, days_between(F.col("_t1"), F.col("_t0"))).alias("dias"),
    )


def shared_account_rows(declared: DataFrame, readings: DataFrame) -> DataFrame:
    """STR-06. One row per candidacy that declared an account, keyed `<candidacy>/<account>`."""
    owners = declared.select("username", "sq_candidato").distinct()
    return (
        readings.drop("sq_candidato")
        .join(owners, "username")
        .withColumn("conta", F.concat_ws("/", F.col("sq_candidato").cast("string"), F.col("username")))
    )


def collection_freshness(attempts: DataFrame, now: Column) -> DataFrame:
    """TMP-11. One row: last good collection, result of the last attempt, whole days since.

    `attempts` has `finalizada_em` and `resultado` (`ok`, `parcial` or another word).
    """
    rows = as_utc(attempts, "finalizada_em")
    good = F.col("resultado").isin("ok", "parcial")
    return rows.agg(
        F.max(F.when(good, F.col("finalizada_em"))).alias("ultima_coleta_ok"),
        F.max_by("resultado", "finalizada_em").alias("ultimo_resultado"),
    ).withColumn(
        "dias_desde", F.timestamp_diff("DAY", F.col("ultima_coleta_ok"), now).cast("bigint")
    )


def pace_by_period(
    candidates: DataFrame, windows: DataFrame, focus: int | None = None
) -> DataFrame:
    """TMP-12. Median weekly posts of the group per window, beside those of one candidate."""
    rows = (
        candidates.filter("tem_dados")
        .select("sq_candidato", "username")
        .join(windows.filter(F.col("janela") != "total"), "username")
    )
    medians = exact_quantiles(rows, ["janela"], "posts_por_semana", {"grupo": 0.5})
    mine = F.lit(None).cast("bigint") if focus is None else F.lit(focus)
    focused = rows.groupBy("janela").agg(
        F.max(F.when(F.col("sq_candidato") == mine, F.col("posts_por_semana"))).alias("candidato")
    )
    return focused.join(medians, "janela", "left").select("janela", "grupo", "candidato")


def social_totals(candidates: DataFrame) -> DataFrame:
    """AGG-37. One row: candidates, those with numbers, followers, and medians of the metrics.

    The metrics become rows, so their medians are one quantile job instead of four.
    """
    metrics = ("seguidores", "posts_semana_campanha", "pct_video", "engajamento_mediano")
    sums = candidates.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("tem_dados").alias("n_com_dados"),
        F.sum("seguidores").alias("seguidores_total"),
    )
    long = (
        candidates.filter("tem_dados")
        .select(*[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot([], list(metrics), "metrica", "valor")
    )
    medians = exact_quantiles(long, ["metrica"], "valor", {"m": 0.5}).agg(
        F.struct(
            *[F.max(F.when(F.col("metrica") == m, F.col("m"))).alias(f"mediana_{m}") for m in metrics]
        ).alias("x")
    )
    return sums.withColumn("_x", medians.scalar()).select(*sums.columns, "_x.*")


def exclusion_reason(status: Column, has_data: Column, votes: Column) -> Column:
    """AGG-37. The one reason why a candidate is left out of the statistics, or null."""
    return (
        F.when(has_data & votes.isNull(), "sem_votos")
        .when(has_data, F.lit(None).cast("string"))
        .when(status == NO_NETWORK, "sem_instagram")
        .when(status == NOT_COLLECTED, NOT_COLLECTED)
        .when(status.isin(*UNAVAILABLE), "indisponivel")
    )


def excluded_counts(candidates: DataFrame) -> DataFrame:
    """AGG-37. Candidates left out, by reason."""
    reason = exclusion_reason(F.col("status"), F.col("tem_dados"), F.col("votos"))
    return (
        candidates.withColumn("motivo", reason)
        .filter(F.col("motivo").isNotNull())
        .groupBy("motivo")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def social_rankings(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """TOP-05. Top candidates by followers, engagement and votes above the expected.

    The metrics become rows, and `row_number() <= limit` is applied per task before the shuffle.
    """
    metrics = ("seguidores", "engajamento_mediano", "razao_obs_esperado")
    long = (
        candidates.filter("tem_dados")
        .select("sq_candidato", *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(["sq_candidato"], list(metrics), "metrica", "valor")
        .filter(F.col("valor").isNotNull())
    )
    order = Window.partitionBy("metrica").orderBy(F.desc("valor"), F.asc("sq_candidato"))
    return long.withColumn("posicao", F.row_number().over(order)).filter(F.col("posicao") <= limit)
