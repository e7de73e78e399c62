"""Profile readings and posts, candidate summary, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.roles import (
    POSTS,
    PROFILES,
    SOCIAL_PERIODS,
    posts,
    profiles,
    rounded,
    table,
    with_sql,
)
from escrutinio.operators import social as so
from escrutinio.operators import statistics as st
from escrutinio.operators.statistics import BOOTSTRAP, BOOTSTRAP_SEED
from escrutinio.plans import networks, screens
from escrutinio.sources.publish import merge_last
from escrutinio.streaming import snapshots

PERIODS = tuple(so.Period(*p) for p in SOCIAL_PERIODS)


def social_votes(spark, d):
    """Votes by customer-sized candidacies: the line items of the users that have readings."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return (
        li.groupBy((F.col("l_orderkey") % 400).alias("sq_candidato"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("votos"))
        .withColumn("cd_cargo", F.when(F.col("sq_candidato") % 2 == 0, 6).otherwise(7))
    )


def latest_snapshot(spark, d):
    return so.latest_snapshot(profiles(spark, d).drop("follows_count", "media_count"))


def latest_valid(spark, d):
    return so.latest_valid(profiles(spark, d)).select("sq_candidato", "username", "followers_count", "coletado_em")


def renamed_accounts(spark, d):
    renames = (
        profiles(spark, d).filter(F.col("username").endswith("b")).select(F.col("username").alias("username_tse"))
        .distinct().withColumn("username_atual", F.regexp_replace("username_tse", "b$", "a"))
    )
    out = so.rename_accounts(profiles(spark, d), renames)
    return out.select("username", "coletado_em", "followers_count")


def analysed_account(spark, d):
    return so.analysed_account(profiles(spark, d))


def posts_deduplicated(spark, d):
    return so.latest_posts(posts(spark, d))


def snapshot_series(spark, d):
    return rounded(so.follower_series(profiles(spark, d)))


def series_summary(spark, d):
    return rounded(so.follower_summary(profiles(spark, d)))


def window_metrics(spark, d):
    return rounded(so.window_metrics(profiles(spark, d), posts(spark, d), PERIODS))


def _summary(spark, d):
    return so.candidate_social(profiles(spark, d), posts(spark, d), social_votes(spark, d), PERIODS)


def candidate_social(spark, d):
    return rounded(_summary(spark, d))


def pace_by_period(spark, d):
    c = so.analysed_account(profiles(spark, d)).withColumn("tem_dados", F.col("seguidores").isNotNull())
    return rounded(so.pace_by_period(c, so.window_metrics(profiles(spark, d), posts(spark, d), PERIODS), 7))


def social_totals(spark, d):
    return rounded(so.social_totals(_summary(spark, d)))


def excluded_counts(spark, d):
    return so.excluded_counts(_summary(spark, d))


def social_rankings(spark, d):
    s = _summary(spark, d)
    fit = st.log_residual(s).select("sq_candidato", "razao_obs_esperado")
    return rounded(so.social_rankings(s.join(fit, "sq_candidato"), 10))


def social_kpis(spark, d):
    return rounded(screens.kpi_rows(so.social_totals(_summary(spark, d)), screens.SOCIAL_KPIS))


def log_residual(spark, d):
    return rounded(st.log_residual(_pairs(spark, d)))


def expected_class(spark, d):
    fit = st.log_residual(_pairs(spark, d))
    return fit.select("sq_candidato", "cd_cargo", st.expected_class(F.col("razao_obs_esperado")).alias("classe"))


def _pairs(spark, d):
    """Followers of the analysed account against votes, some of them missing."""
    a = so.analysed_account(profiles(spark, d)).select("sq_candidato", "seguidores")
    return social_votes(spark, d).join(a, "sq_candidato", "left")


def correlation(spark, d):
    p = _pairs(spark, d)
    some = F.col("seguidores").isNotNull() & F.col("votos").isNotNull()
    sizes = p.groupBy("cd_cargo").agg(F.count_if(some).alias("n"), F.count_if(~some).alias("n_excluidos"))
    rho = st.spearman(p, "seguidores", "votos", ["cd_cargo"]).drop("n")
    out = sizes.join(rho, "cd_cargo", "left").withColumn("rho", F.when(F.col("n") >= st.MIN_PAIRS, F.col("rho")))
    return rounded(out.select("cd_cargo", "n", "n_excluidos", "rho"))


def correlation_bootstrap(spark, d):
    return rounded(st.correlation(_pairs(spark, d), "seguidores", "votos"))


def social_correlations(spark, d):
    s = _summary(spark, d)
    return rounded(networks.social_correlations(s))


def declared_accounts(spark, d):
    ev = table(spark, d, "events").select("user_id")
    users = ev.select((F.col("user_id") + 20).alias("sq_candidato")).distinct()
    return users.select(
        "sq_candidato",
        F.concat(F.lit("conta"), F.col("sq_candidato").cast("string"), F.lit("a")).alias("username"),
        F.concat(F.lit("@conta"), F.col("sq_candidato").cast("string"), F.lit("a")).alias("url_tse"),
        F.lit(1).alias("nr_ordem"), F.lit(True).alias("principal"),
    )


def social_overview(spark, d):
    out = networks.social_overview(
        declared_accounts(spark, d), profiles(spark, d), posts(spark, d), social_votes(spark, d), periods=PERIODS
    )
    return out.select("sq_candidato", "status", "classe_esperado", "votos", "seguidores")


def profiles_of_candidates(spark, d):
    p = profiles(spark, d)
    return networks.candidate_profiles(declared_accounts(spark, d), p, so.analysed_account(p))


def account_series(spark, d):
    shared = profiles(spark, d).unionByName(
        profiles(spark, d).withColumn("sq_candidato", F.col("sq_candidato") + 1000)
    )
    return rounded(networks.account_series(shared))


def collection_freshness(spark, d):
    ev = table(spark, d, "events").select("ts", "event_type")
    attempts = ev.select(
        F.col("ts").alias("finalizada_em"),
        F.when(F.col("event_type") == "error", "falha").when(F.col("event_type") == "view", "parcial").otherwise("ok").alias("resultado"),
    )
    return so.collection_freshness(attempts, F.lit("2024-02-10 12:00:00").cast("timestamp_ntz"))


def snapshot_merge(spark, d):
    p = profiles(spark, d).drop("follows_count", "media_count")
    old = p.filter(F.col("coletado_em") < "2024-01-20")
    new = p.filter(F.col("coletado_em") >= "2024-01-15").withColumn("status", F.concat(F.lit("n:"), "status"))
    return merge_last(old, new, ["sq_candidato", "username", "coletado_em"]).select(
        "sq_candidato", "username", "coletado_em", "status", "followers_count"
    )


def new_items(spark, d):
    known = posts(spark, d).filter((F.col("timestamp") < "2024-01-12") & (F.length("username") % 2 == 0))
    out = snapshots.newer_than_known(posts(spark, d), known, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return out.select("username", "media_id", F.col("timestamp").alias("publicado_em")).distinct()


def skip_unavailable(spark, d):
    return snapshots.recently_unavailable(profiles(spark, d), F.lit("2024-02-04 00:00:00").cast("timestamp_ntz"))


def shared_accounts(spark, d):
    declared = declared_accounts(spark, d).select("username", "sq_candidato").unionByName(
        declared_accounts(spark, d).select("username", (F.col("sq_candidato") + 5000).alias("sq_candidato"))
    )
    out = so.shared_account_rows(declared, profiles(spark, d))
    return out.select("conta", "username", "coletado_em", "followers_count")


QUERIES = {
    f.__name__: f
    for f in (
        latest_snapshot, latest_valid, renamed_accounts, analysed_account, posts_deduplicated,
        snapshot_series, series_summary, window_metrics, candidate_social, pace_by_period,
        social_totals, excluded_counts, social_rankings, social_kpis, log_residual, expected_class,
        correlation, correlation_bootstrap, social_correlations, social_overview,
        profiles_of_candidates, account_series, collection_freshness, snapshot_merge, new_items,
        skip_unavailable, shared_accounts,
    )
}

SOCIAL_VOTES = """
votos_redes AS (
  SELECT l_orderkey % 400 AS sq_candidato, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS votos,
         CASE WHEN l_orderkey % 400 % 2 = 0 THEN 6 ELSE 7 END AS cd_cargo
  FROM lineitem GROUP BY l_orderkey % 400)
"""
ANALYSED = (
    PROFILES
    + """, conta AS (SELECT sq_candidato, username, max(followers_count) AS pico,
    max(coletado_em) FILTER (WHERE followers_count IS NOT NULL) AS ok,
    arg_max(followers_count, coletado_em) FILTER (WHERE followers_count IS NOT NULL) AS seguidores,
    arg_max(follows_count, coletado_em) FILTER (WHERE followers_count IS NOT NULL) AS seguindo,
    arg_max(status, coletado_em) FILTER (WHERE followers_count IS NOT NULL) AS status_ok,
    arg_max(status, coletado_em) AS status_ultimo FROM perfis GROUP BY ALL),
escolha AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sq_candidato ORDER BY coalesce(pico, -1) DESC, username) AS rn FROM conta) WHERE rn = 1),
falha AS (SELECT p.sq_candidato, p.username, min(p.coletado_em) AS desde FROM perfis p JOIN conta c
  ON p.sq_candidato = c.sq_candidato AND p.username = c.username AND p.coletado_em > c.ok GROUP BY ALL),
analisada AS (SELECT e.sq_candidato, e.username, coalesce(e.status_ok, e.status_ultimo) AS status, e.status_ultimo AS status_ultima_coleta,
  e.seguidores, e.seguindo, e.ok AS ultima_coleta_ok, f.desde AS conta_indisponivel_desde, f.desde IS NOT NULL AS desatualizado
  FROM escolha e LEFT JOIN falha f ON e.sq_candidato = f.sq_candidato AND e.username = f.username)
"""
)
_DAYS = {
    name: (
        f"(DATE '{end}' - DATE '{start}' + 1)::DOUBLE"
        if end
        # Local midnight is 03:00 UTC.
        else f"date_diff('microsecond', TIMESTAMP '{start} 03:00:00', fim) / 86400000000.0::DOUBLE"
    )
    for name, start, end in SOCIAL_PERIODS
}
_IN = {
    name: (f"dia BETWEEN DATE '{start}' AND DATE '{end}'" if end else f"dia >= DATE '{start}'")
    for name, start, end in SOCIAL_PERIODS
}
WINDOWS = (
    ANALYSED
    + ","
    + POSTS
    + """, contas AS (SELECT username, arg_max(followers_count, coletado_em) AS seguidores, max(coletado_em) AS fim
  FROM perfis WHERE followers_count IS NOT NULL GROUP BY ALL),
lidos AS (SELECT p.username, media_type, CAST("timestamp" - INTERVAL 3 HOUR AS DATE) AS dia,
  100.0 * (like_count + comments_count) / nullif(seguidores, 0)::DOUBLE AS engajamento FROM posts p JOIN contas USING (username)),
grade AS ("""
    + " UNION ALL ".join(f"SELECT username, '{n}' AS janela, {_DAYS[n]} AS dias FROM contas" for n in _DAYS)
    + "), soma AS ("
    + " UNION ALL ".join(
        f"""SELECT username, '{n}' AS janela, count(*) AS n_posts, count(*) FILTER (WHERE media_type = 'VIDEO') AS n_videos,
        count(engajamento) AS ne, avg(engajamento) AS em, median(engajamento) AS ed FROM lidos WHERE {_IN[n]} GROUP BY ALL"""
        for n in _IN
    )
    + """), janelas AS (SELECT g.username, g.janela, dias, coalesce(n_posts, 0) AS n_posts, coalesce(n_videos, 0) AS n_videos,
  CASE WHEN dias >= 7 THEN 7.0 * coalesce(n_posts, 0) / dias END AS posts_por_semana,
  CASE WHEN dias >= 7 THEN 7.0 * coalesce(n_videos, 0) / dias END AS videos_por_semana,
  100.0 * n_videos / nullif(n_posts, 0)::DOUBLE AS pct_video, coalesce(ne, 0) AS n_posts_engajamento,
  em AS engajamento_medio, ed AS engajamento_mediano FROM grade g LEFT JOIN soma s ON g.username = s.username AND g.janela = s.janela)
"""
)
SUMMARY = (
    WINDOWS
    + ","
    + SOCIAL_VOTES
    + """, resumo AS (SELECT v.sq_candidato, v.cd_cargo, v.votos, a.username, coalesce(a.status, 'sem_rede') AS status,
  a.seguidores IS NOT NULL AS tem_dados, a.status_ultima_coleta, a.ultima_coleta_ok, a.conta_indisponivel_desde,
  coalesce(a.desatualizado, false) AS desatualizado, a.seguidores, a.seguindo,
  1000.0 * a.seguidores / nullif(v.votos, 0)::DOUBLE AS seguidores_por_mil_votos,
  1000.0 * v.votos / nullif(a.seguidores, 0)::DOUBLE AS votos_por_mil_seguidores,
  c.posts_por_semana AS posts_semana_campanha, p.posts_por_semana AS posts_semana_pos,
  100.0 * p.posts_por_semana / nullif(c.posts_por_semana, 0) - 100 AS variacao_ritmo_pct, t.pct_video,
  c.engajamento_mediano, c.engajamento_medio
  FROM votos_redes v LEFT JOIN analisada a ON v.sq_candidato = a.sq_candidato
  LEFT JOIN janelas c ON c.username = a.username AND c.janela = 'campanha'
  LEFT JOIN janelas p ON p.username = a.username AND p.janela = 'pos_eleicao'
  LEFT JOIN janelas t ON t.username = a.username AND t.janela = 'total')
"""
)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


FIT = """, ajuste AS (SELECT cd_cargo, CASE WHEN count(*) >= 10 THEN regr_slope(ly, lx) END AS b, avg(lx) AS mx, avg(ly) AS my
  FROM (SELECT cd_cargo, log10(1 + seguidores) AS lx, log10(1 + votos) AS ly FROM base WHERE seguidores IS NOT NULL AND votos IS NOT NULL) GROUP BY ALL),
residuo AS (SELECT sq_candidato, cd_cargo, my - b * mx AS intercepto, b AS inclinacao,
  power(10.0, my - b * mx + b * log10(1 + seguidores)) - 1 AS votos_esperados,
  log10(1 + votos) - (my - b * mx + b * log10(1 + seguidores)) AS residuo_log10,
  power(10.0, log10(1 + votos) - (my - b * mx + b * log10(1 + seguidores))) AS razao_obs_esperado FROM base JOIN ajuste USING (cd_cargo))
"""
PAIRS = ANALYSED + "," + SOCIAL_VOTES + """, base AS (SELECT v.*, a.seguidores FROM votos_redes v LEFT JOIN analisada a USING (sq_candidato))"""
SOCIAL_TOTALS = """SELECT count(*) AS n, count(*) FILTER (WHERE tem_dados) AS n_com_dados, CAST(sum(seguidores) AS BIGINT) AS seguidores_total,
  round(median(seguidores::DOUBLE) FILTER (WHERE tem_dados), 6) + 0.0 AS mediana_seguidores,
  round(median(posts_semana_campanha) FILTER (WHERE tem_dados), 6) + 0.0 AS mediana_posts_semana_campanha,
  round(median(pct_video) FILTER (WHERE tem_dados), 6) + 0.0 AS mediana_pct_video,
  round(median(engajamento_mediano) FILTER (WHERE tem_dados), 6) + 0.0 AS mediana_engajamento_mediano FROM resumo"""
SERIES = """, s AS (SELECT *, lag(followers_count) OVER w AS fa, lag(coletado_em) OVER w AS ta FROM perfis
  WHERE followers_count IS NOT NULL WINDOW w AS (PARTITION BY username ORDER BY coletado_em)),
serie AS (SELECT sq_candidato, username, coletado_em, followers_count AS seguidores, followers_count - fa AS delta_abs,
  round(100.0 * followers_count / nullif(fa, 0)::DOUBLE - 100, 6) + 0.0 AS delta_pct,
  round(date_diff('microsecond', ta, coletado_em) / 86400000000.0::DOUBLE, 6) + 0.0 AS dias FROM s),
z AS (SELECT username, count(*) AS n, arg_min(followers_count, coletado_em) AS a, arg_max(followers_count, coletado_em) AS b,
  date_diff('microsecond', min(coletado_em), max(coletado_em)) / 86400000000.0::DOUBLE AS d FROM perfis WHERE followers_count IS NOT NULL GROUP BY ALL)
"""
DECLARED = """, declaradas AS (SELECT DISTINCT user_id + 20 AS sq_candidato, 'conta' || (user_id + 20) || 'a' AS username FROM events)"""

def _bootstrap_sql(pairs: str, by: str, size: str) -> str:
    """Bootstrap of the rank correlation of `pairs` (keys, id, x, y), draw for draw."""
    u = f"('0x' || substr(md5('{BOOTSTRAP_SEED}|' || rep || '|' || id), 1, 8))::BIGINT / 4294967296.0"
    ranks = ", ".join(
        f"sum(w) OVER (PARTITION BY {by}, rep ORDER BY {c}) - (sum(w) OVER (PARTITION BY {by}, rep, {c}) - 1) / 2.0 AS r{c}"
        for c in "xy"
    )
    keys = ", ".join(f"t.{k.strip()} = q.{k.strip()}" for k in by.split(",")).replace(", ", " AND ")
    return f""", completos AS (SELECT * FROM ({pairs}) WHERE x IS NOT NULL AND y IS NOT NULL),
        tamanho AS ({size}),
        posto AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM completos),
        ponto AS (SELECT {by}, corr(rx, ry) AS rho FROM posto GROUP BY ALL),
        par_unico AS (SELECT {by}, x, y, min(id) AS id, count(*) AS m FROM completos JOIN tamanho USING ({by}) WHERE n >= 10 GROUP BY {by}, x, y),
        passos AS (SELECT m, baixo, list(c / t ORDER BY k) AS passos FROM (SELECT *, sum(p) OVER (PARTITION BY m ORDER BY k) AS c, sum(p) OVER (PARTITION BY m) AS t
          FROM (SELECT m, baixo, k, exp(sum(CASE WHEN k > baixo THEN ln(m / k::DOUBLE) ELSE 0 END) OVER (PARTITION BY m ORDER BY k)) AS p
            FROM (SELECT m, baixo, unnest(range(baixo, floor(m + 8 * sqrt(m))::BIGINT + 13)) AS k
              FROM (SELECT DISTINCT m, greatest(floor(m - 8 * sqrt(m))::BIGINT - 8, 0) AS baixo FROM par_unico)))) GROUP BY m, baixo),
        sorteio AS (SELECT {by}, rep, x, y, baixo + len(list_filter(passos, lambda c: c <= u)) AS w
          FROM (SELECT *, {u} AS u FROM par_unico JOIN passos USING (m), range(1, {BOOTSTRAP} + 1) r(rep))),
        pesos AS (SELECT {by}, rep, w, {ranks} FROM sorteio WHERE w > 0),
        media AS (SELECT {by}, rep, sum(w) AS n, sum(w * rx) / sum(w) AS mx, sum(w * ry) / sum(w) AS my FROM pesos GROUP BY ALL),
        replica AS (SELECT {by}, rep, sum(w * (rx - mx) * (ry - my)) / nullif(sqrt(sum(w * (rx - mx) ** 2) * sum(w * (ry - my) ** 2)), 0) AS rho
          FROM pesos JOIN media USING ({by}, rep) GROUP BY ALL),
        q AS (SELECT {by}, quantile_cont(rho, 0.025) AS a, quantile_cont(rho, 0.975) AS b, count(rho) AS m FROM replica GROUP BY ALL)
        SELECT {by}, n, n_excluidos, round(CASE WHEN n >= 10 THEN rho END, 6) + 0.0 AS rho, round(a, 6) + 0.0 AS ic_inf, round(b, 6) + 0.0 AS ic_sup,
        CASE WHEN rho IS NOT NULL AND n >= 10 THEN m END AS n_bootstrap_validos FROM tamanho t LEFT JOIN ponto USING ({by}) LEFT JOIN q USING ({by})"""


ORACLE = {
    "correlation_bootstrap": with_sql(
        PAIRS,
        _bootstrap_sql(
            "SELECT cd_cargo, sq_candidato AS id, seguidores::DOUBLE AS x, votos::DOUBLE AS y FROM base", "cd_cargo",
            "SELECT cd_cargo, count(*) FILTER (WHERE seguidores IS NOT NULL AND votos IS NOT NULL) AS n, "
            "count(*) FILTER (WHERE seguidores IS NULL OR votos IS NULL) AS n_excluidos FROM base GROUP BY ALL",
        ),
    ),
    "social_correlations": with_sql(
        SUMMARY + ", longo AS (" + " UNION ALL ".join(
            f"SELECT '{name}' AS par, cd_cargo, sq_candidato AS id, {x}::DOUBLE AS x, votos::DOUBLE AS y FROM resumo" for name, x in networks.PAIRS
        ) + ")",
        _bootstrap_sql(
            "SELECT * FROM longo", "par, cd_cargo",
            "SELECT par, cd_cargo, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n, "
            "count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS n_excluidos FROM longo GROUP BY ALL",
        ),
    ),
    "latest_snapshot": with_sql(
        PROFILES,
        """SELECT username, arg_max(sq_candidato, coletado_em) AS sq_candidato, arg_max(status, coletado_em) AS status,
        max(coletado_em) AS coletado_em, (SELECT followers_count FROM perfis q WHERE q.username = p.username ORDER BY coletado_em DESC LIMIT 1) AS followers_count
        FROM perfis p GROUP BY username""",
    ),
    "latest_valid": with_sql(
        PROFILES,
        """SELECT sq_candidato, username, arg_max(followers_count, coletado_em) AS followers_count, max(coletado_em) AS coletado_em
        FROM perfis WHERE followers_count IS NOT NULL GROUP BY ALL""",
    ),
    "renamed_accounts": with_sql(
        PROFILES,
        "SELECT regexp_replace(username, 'b$', 'a') AS username, coletado_em, followers_count FROM perfis",
    ),
    "analysed_account": with_sql(ANALYSED, "SELECT * FROM analisada"),
    "posts_deduplicated": with_sql(POSTS, "SELECT * FROM posts"),
    "snapshot_series": with_sql(PROFILES + SERIES, "SELECT * FROM serie"),
    "series_summary": with_sql(
        PROFILES + SERIES,
        """SELECT username, n AS n_snapshots, a AS seguidores_inicial, b AS seguidores_final, CASE WHEN n >= 2 THEN b - a END AS delta_abs,
        round(CASE WHEN n >= 2 THEN 100.0 * b / nullif(a, 0)::DOUBLE - 100 END, 6) + 0.0 AS delta_pct,
        round(CASE WHEN n >= 2 THEN d END, 6) + 0.0 AS dias FROM z""",
    ),
    "account_series": with_sql(
        PROFILES + SERIES,
        """SELECT serie.*, n AS n_snapshots, CASE WHEN n >= 2 THEN b - a END AS total_delta_abs,
        round(CASE WHEN n >= 2 THEN 100.0 * b / nullif(a, 0)::DOUBLE - 100 END, 6) + 0.0 AS total_delta_pct,
        round(CASE WHEN n >= 2 THEN d END, 6) + 0.0 AS total_dias FROM serie JOIN z USING (username)""",
    ),
    "window_metrics": with_sql(
        WINDOWS,
        f"""SELECT username, janela, n_posts, n_videos, n_posts_engajamento,
        {_r('dias', 'posts_por_semana', 'videos_por_semana', 'pct_video', 'engajamento_medio', 'engajamento_mediano')} FROM janelas""",
    ),
    "candidate_social": with_sql(
        SUMMARY,
        f"""SELECT sq_candidato, cd_cargo, votos, username, status, tem_dados, status_ultima_coleta, ultima_coleta_ok, conta_indisponivel_desde,
        desatualizado, seguidores, seguindo, {_r('seguidores_por_mil_votos', 'votos_por_mil_seguidores', 'posts_semana_campanha',
        'posts_semana_pos', 'variacao_ritmo_pct', 'pct_video', 'engajamento_mediano', 'engajamento_medio')} FROM resumo""",
    ),
    "pace_by_period": with_sql(
        WINDOWS,
        """SELECT janela, round(median(posts_por_semana), 6) + 0.0 AS grupo,
        round(max(posts_por_semana) FILTER (WHERE sq_candidato = 7), 6) + 0.0 AS candidato
        FROM analisada JOIN janelas USING (username) WHERE seguidores IS NOT NULL AND janela <> 'total' GROUP BY janela""",
    ),
    "social_totals": with_sql(SUMMARY, SOCIAL_TOTALS),
    "social_kpis": with_sql(
        SUMMARY + f", t AS ({SOCIAL_TOTALS})",
        """SELECT * FROM (""" + " UNION ALL ".join(
            f"SELECT {i} AS ordem, '{c}' AS chave, '{label}' AS rotulo, {c}::DOUBLE AS valor FROM t"
            for i, (c, label) in enumerate(screens.SOCIAL_KPIS.items())
        ) + ") WHERE valor IS NOT NULL",
    ),
    "excluded_counts": with_sql(
        SUMMARY,
        """SELECT CASE WHEN tem_dados THEN NULL WHEN status = 'sem_rede' THEN 'sem_instagram' WHEN status = 'nao_encontrado' THEN 'indisponivel' END AS motivo,
        count(*) AS n FROM resumo WHERE NOT tem_dados GROUP BY ALL""",
    ),
    "social_rankings": with_sql(
        SUMMARY + ", base AS (SELECT sq_candidato, cd_cargo, votos, seguidores FROM resumo)" + FIT,
        """, m AS (SELECT sq_candidato, tem_dados, seguidores::DOUBLE AS seguidores, engajamento_mediano, razao_obs_esperado
          FROM resumo JOIN (SELECT sq_candidato, razao_obs_esperado FROM residuo) USING (sq_candidato)),
        l AS (SELECT sq_candidato, 'seguidores' AS metrica, seguidores AS valor FROM m WHERE tem_dados UNION ALL
          SELECT sq_candidato, 'engajamento_mediano', engajamento_mediano FROM m WHERE tem_dados UNION ALL
          SELECT sq_candidato, 'razao_obs_esperado', razao_obs_esperado FROM m WHERE tem_dados),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY metrica ORDER BY valor DESC, sq_candidato) AS INTEGER) AS posicao FROM l WHERE valor IS NOT NULL)
        SELECT sq_candidato, metrica, round(valor, 6) + 0.0 AS valor, posicao FROM r WHERE posicao <= 10""",
    ),
    "log_residual": with_sql(
        PAIRS + FIT,
        f"SELECT sq_candidato, cd_cargo, {_r('intercepto', 'inclinacao', 'votos_esperados', 'residuo_log10', 'razao_obs_esperado')} FROM residuo",
    ),
    "expected_class": with_sql(
        PAIRS + FIT,
        """SELECT sq_candidato, cd_cargo, CASE WHEN razao_obs_esperado >= 1.5 THEN 'acima' WHEN razao_obs_esperado <= 1 / 1.5 THEN 'abaixo' ELSE 'neutro' END AS classe FROM residuo""",
    ),
    "correlation": with_sql(
        PAIRS,
        """, p AS (SELECT * FROM base WHERE seguidores IS NOT NULL AND votos IS NOT NULL),
        r AS (SELECT cd_cargo, rank() OVER (PARTITION BY cd_cargo ORDER BY seguidores) + (count(*) OVER (PARTITION BY cd_cargo, seguidores) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY cd_cargo ORDER BY votos) + (count(*) OVER (PARTITION BY cd_cargo, votos) - 1) / 2.0 AS ry FROM p),
        c AS (SELECT cd_cargo, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY ALL)
        SELECT cd_cargo, n, (SELECT count(*) FROM base b WHERE b.cd_cargo = c.cd_cargo) - n AS n_excluidos,
        round(CASE WHEN n >= 10 THEN rho END, 6) + 0.0 AS rho FROM c""",
    ),
    "social_overview": with_sql(
        SUMMARY + ", base AS (SELECT sq_candidato, cd_cargo, votos, seguidores FROM resumo)" + FIT + DECLARED,
        """SELECT r.sq_candidato, CASE WHEN r.username IS NULL AND r.sq_candidato IN (SELECT sq_candidato FROM declaradas) THEN 'nao_coletado' ELSE r.status END AS status,
        CASE WHEN x.razao_obs_esperado >= 1.5 THEN 'acima' WHEN x.razao_obs_esperado <= 1 / 1.5 THEN 'abaixo' ELSE 'neutro' END AS classe_esperado,
        r.votos, r.seguidores
        FROM resumo r JOIN residuo x USING (sq_candidato)""",
    ),
    "profiles_of_candidates": with_sql(
        ANALYSED + DECLARED,
        """, u AS (SELECT sq_candidato, username, arg_max(status, coletado_em) AS status, max(coletado_em) AS coletado_em FROM perfis GROUP BY ALL),
        v AS (SELECT u.*, p.followers_count, p.follows_count FROM u JOIN perfis p USING (sq_candidato, username, coletado_em))
        SELECT coalesce(d.sq_candidato, v.sq_candidato) AS sq_candidato, coalesce(d.username, v.username) AS username,
        '@' || d.username AS url_tse, CASE WHEN d.username IS NOT NULL THEN 1 END AS nr_ordem, d.username IS NOT NULL AS principal,
        EXISTS (SELECT 1 FROM analisada a WHERE a.seguidores IS NOT NULL AND a.sq_candidato = coalesce(d.sq_candidato, v.sq_candidato)
          AND a.username = coalesce(d.username, v.username)) AS analisado,
        coalesce(v.status, 'nao_coletado') AS status, v.followers_count AS seguidores, v.follows_count AS seguindo, v.coletado_em
        FROM declaradas d FULL JOIN v ON d.sq_candidato = v.sq_candidato AND d.username = v.username""",
    ),
    "collection_freshness": """SELECT max(ts) FILTER (WHERE event_type <> 'error') AS ultima_coleta_ok,
        arg_max(CASE event_type WHEN 'error' THEN 'falha' WHEN 'view' THEN 'parcial' ELSE 'ok' END, ts) AS ultimo_resultado,
        CAST(floor(date_diff('microsecond', max(ts) FILTER (WHERE event_type <> 'error'), TIMESTAMP '2024-02-10 12:00:00') / 86400000000) AS BIGINT) AS dias_desde FROM events""",
    "snapshot_merge": with_sql(
        PROFILES,
        """SELECT sq_candidato, username, coletado_em, followers_count,
        CASE WHEN coletado_em >= TIMESTAMP '2024-01-15' THEN 'n:' || status ELSE status END AS status FROM perfis""",
    ),
    "new_items": with_sql(
        POSTS,
        """, k AS (SELECT username, max("timestamp") AS t FROM posts WHERE "timestamp" < TIMESTAMP '2024-01-12' AND length(username) % 2 = 0 GROUP BY ALL)
        SELECT username, media_id, "timestamp" AS publicado_em FROM posts LEFT JOIN k USING (username)
        WHERE "timestamp" >= TIMESTAMP '2024-01-10' AND (t IS NULL OR "timestamp" > t)""",
    ),
    "skip_unavailable": with_sql(
        PROFILES,
        """SELECT username FROM (SELECT username, arg_max(status, coletado_em) AS s, max(coletado_em) AS t FROM perfis GROUP BY ALL)
        WHERE s <> 'ok' AND date_diff('second', t, TIMESTAMP '2024-02-04 00:00:00') < 7 * 86400""",
    ),
    "shared_accounts": with_sql(
        PROFILES + DECLARED,
        """, o AS (SELECT sq_candidato, username FROM declaradas UNION ALL SELECT sq_candidato + 5000, username FROM declaradas)
        SELECT o.sq_candidato || '/' || username AS conta, username, coletado_em, followers_count FROM perfis JOIN o USING (username)""",
    ),
}
