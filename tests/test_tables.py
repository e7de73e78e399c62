import json
import random

import pytest
from pyspark.sql import functions as F

from escrutinio.operators import people
from escrutinio.operators import places as pl
from escrutinio.operators import reconcile as rc
from escrutinio.plans import catalog, lists, maps
from escrutinio.sources import publish, versions
from escrutinio.sources import text_files as tf
from escrutinio.sources.contracts import CONTRACTS, Column, Contract, ContractViolation, validate
from tests.conftest import FAILURES, rows

# --- places --------------------------------------------------------------------------------------


def test_coordinates_are_cleaned_in_pairs(frame):
    df = frame(
        [("SP", -1.0, -1.0), ("ZZ", -20.0, -50.0), ("SP", -20.0, None), ("MG", 48.0, 2.0), ("SP", -20.0, -50.0), ("SP", -1.0, -50.0)],
        "sg_uf string, nr_latitude double, nr_longitude double",
    )
    got = [(r.nr_latitude, r.nr_longitude) for r in pl.clean_coordinates(df).collect()]
    assert got == [(None, None)] * 4 + [(-20.0, -50.0), (-1.0, -50.0)]


def test_place_takes_one_coherent_pair(frame):
    df = frame(
        [(1, "10", None, -20.0, None, 5), (1, "2", "A", None, None, 7), (1, "3", "B", -21.0, -51.0, 1), (1, None, "C", -22.0, -52.0, 1)],
        "k int, nr_secao string, nm_local_votacao string, nr_latitude double, nr_longitude double, qt_eleitor_secao bigint",
    )
    for shuffled in (df, df.orderBy(F.desc("qt_eleitor_secao"))):
        r = rows(pl.roll_up_places(shuffled, ["k"]))[0]
        assert (r["nm_local_votacao"], r["nr_latitude"], r["nr_longitude"], r["qt_secoes"], r["qt_eleitor_secao"]) == ("A", -21.0, -51.0, 4, 14)


def test_cells_nest(spark):
    df = spark.range(500).select((-(F.col("id") % 300) / 10.7).alias("lat"), (-30 - (F.col("id") % 41)).cast("double").alias("lon"))
    cells = pl.assign_cells(df)
    for fine, coarse in (("h3", "h3_r7"), ("h3_r7", "h3_r6")):
        assert cells.groupBy(fine).agg(F.count_distinct(coarse).alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_zone_matches_brute_force(frame, seed):
    rng = random.Random(seed)
    spot = lambda: (round(rng.uniform(-20, -19) if rng.random() < 0.8 else rng.uniform(-30, 0), 3), round(rng.uniform(-50, -49), 3))
    sites = [(u, rng.randint(1, 4), *spot(), rng.randint(1, 99)) for u in (1, 2) for _ in range(60)] + [(3, 9, None, None, 5)]
    points = [(i, rng.choice((1, 2, 3)), *spot()) for i in range(150)]
    got = {
        r.ponto: r.nr_zona
        for r in pl.nearest_zone(
            frame(points, "ponto int, cd_mun_ibge int, lat double, lon double"),
            frame(sites, "cd_mun_ibge int, nr_zona int, lat double, lon double, eleitores int"),
        ).collect()
    }
    for i, u, lat, lon in points:
        if u == 3:
            assert got[i] == 9
            continue
        at = {}
        for s in sites:
            if s[0] == u:
                best = at.get(s[2:4])
                if best is None or (s[4], -s[1]) > (best[4], -best[1]):
                    at[s[2:4]] = s
        d = {s: (lat - s[2]) ** 2 + (lon - s[3]) ** 2 for s in at.values()}
        assert got[i] == min(d, key=lambda s: (d[s], s[1]))[1]


def test_areas_and_municipalities(frame):
    raw = frame([("10", 5.0), (None, 1.0), ("4300001", 9.0), ("20", 7.0)], "CD_MUN string, AR_MUN_2022 double")
    areas = pl.clean_areas(raw)
    assert {r["cd_mun_ibge"] for r in rows(areas)} == {10, 20}
    cross = frame([(10, 1, "SP", "A"), (20, 2, "SP", "B")], "cd_mun_ibge int, cd_municipio_tse int, sg_uf string, nm_municipio_ibge string")
    merges = frame([(1, 20), (1, 10)], "conjunto int, cd_mun_ibge int")
    assert {r["cd_mun_ibge"]: r["cd_amc"] for r in rows(pl.build_municipalities(cross, areas, merges))} == {10: 10, 20: 10}
    with pytest.raises(FAILURES, match="official area"):
        pl.build_municipalities(cross, areas.filter("cd_mun_ibge = 10"), merges).collect()
    with pytest.raises(FAILURES, match="unknown municipality"):
        pl.build_municipalities(cross, areas, frame([(1, 99)], "conjunto int, cd_mun_ibge int")).collect()


# --- reconciliation ------------------------------------------------------------------------------

SIDE = "uf string, cargo int, votos bigint, legenda bigint"


def test_compare_classes_and_null_keys(frame):
    ours = frame([("SP", 1, 10, 5), ("RJ", 1, 7, 1), (None, 1, 3, 1), ("MG", 1, None, 2)], SIDE)
    source = frame([("SP", 1, 10, None), ("RJ", 1, 8, 1), (None, 1, 3, 1), ("BA", 1, 4, 0), ("MG", 1, 5, 2)], SIDE)
    got = {(r["uf"], r["medida"]): r for r in rows(rc.compare(ours, source, ["uf", "cargo"]))}
    assert ("SP", "legenda") not in got
    assert got["SP", "votos"]["situacao"] == "confere"
    assert got["RJ", "votos"]["situacao"] == "diverge" and got["RJ", "votos"]["diferenca_pct"] == pytest.approx(-12.5)
    assert got[None, "votos"]["situacao"] == "confere"
    assert got["BA", "votos"]["situacao"] == "so_fonte" and got["MG", "votos"]["situacao"] == "so_fonte"
    with pytest.raises(ValueError):
        rc.compare(ours, source.drop("legenda"), ["uf", "cargo"])
    with pytest.raises(FAILURES, match="repeated key"):
        rc.compare(ours.unionByName(ours), source, ["uf", "cargo"]).collect()


def test_entity_control_stops_on_difference(frame):
    s = frame([(1, 6, 10), (2, 6, 5)], "sq_candidato int, cd_cargo int, votos bigint")
    z = frame([(1, 6, 10), (3, 6, 0)], "sq_candidato int, cd_cargo int, qt_votos_nominais bigint")
    r = rows(rc.require_entity_control(rc.entity_control(s, z)))[0]
    assert (r["candidatos_fora_do_munzona"], r["votos_fora_do_munzona"]) == (1, 5)
    with pytest.raises(FAILURES, match="differ"):
        rc.require_entity_control(rc.entity_control(s, z.withColumn("qt_votos_nominais", F.lit(9).cast("bigint")))).collect()


def test_payment_links(frame):
    pay = frame([(1, 5), (2, 6)], "sq_prestador_contas int, v int")
    link = "sq_prestador_contas int, sq_candidato int"
    ok = rc.attach_candidacy(pay, frame([(1, 10), (1, 10), (2, 20)], link))
    assert [r["sq_candidato"] for r in rows(ok, "v")] == [10, 20]
    for bad in ([(1, 10)], [(1, 10), (1, 11), (2, 20)]):
        with pytest.raises(FAILURES, match="candidac"):
            rc.attach_candidacy(pay, frame(bad, link)).collect()


def test_reserved_ballot_code_fails(frame):
    df = frame([(97, 6)], "nr_votavel int, cd_cargo int")
    with pytest.raises(FAILURES, match="reserved code"):
        df.select(rc.ballot_kind(F.col("nr_votavel"), F.col("cd_cargo"))).collect()


def test_month_gaps(frame):
    df = frame([("2022-11",), ("2022-12",), ("2023-01",), ("2023-03",), ("2023-03",)], "mes string")
    assert [(r["mes"], r["linhas"], r["lacuna"]) for r in rows(rc.month_gaps(df))] == [("2023-03", 2, True)]


# --- files ---------------------------------------------------------------------------------------

SMALL = Contract("votos_teste", (
    Column("ano", "smallint", required=True, source="AA_ELEICAO"),
    Column("cd_mun", "int", key=1, required=True),
    Column("ds_rotulo", "string", key=2),
    Column("vr", "double", low=-100.0, high=100.0),
    Column("dt", "date"),
    Column("qt", "bigint"),
    Column("cd_mun_ibge", "int", derived=True),
))
HEADER = '"AA_ELEICAO";"CD_MUN";"DS_ROTULO";"VR";"DT";"QT"\n'


def write_files(folder, lines):
    folder.mkdir()
    (folder / "votos_2026_SP.csv").write_text(HEADER + lines, encoding="latin-1")
    (folder / "votos_2026_BRASIL.csv").write_text(HEADER + lines, encoding="latin-1")
    (folder / "votos_doador_2026_SP.csv").write_text(HEADER + lines, encoding="latin-1")
    return str(folder)


def test_official_files_are_typed_once(spark, frame, tmp_path):
    path = write_files(tmp_path / "csv", '"2026";"7";"São  João ";"-1,50";"05/10/2026";"-1"\n"2026";"8";"#NULO";"-3";"#NE";" 12 "\n')
    raw = tf.keep_state_files(tf.read_delimited(spark, path), "votos")
    typed = tf.trim_labels(tf.project_contract(raw, SMALL))
    got = rows(typed, "cd_mun")
    assert [(r["ds_rotulo"], r["vr"], str(r["dt"]), r["qt"]) for r in got] == [("São João", -1.5, "2026-10-05", None), (None, -3.0, "None", 12)]
    both = rc.control_totals_text(raw, {"qt": "QT"}, {"vr": "VR"})
    assert all(r["igual"] for r in rows(rc.compare_controls(both, rc.control_totals_table(typed, ["qt"], ["vr"]))))
    cross = frame([(7, 70)], "cd_municipio_tse int, cd_mun_ibge int")
    joined = tf.attach_unit(typed.withColumn("cd_municipio_tse", F.col("cd_mun")).withColumn("sg_uf", F.lit("SP")), cross)
    assert rows(rc.orphan_units(joined)) == [{"cd_municipio_tse": 8}]


@pytest.mark.parametrize("line", ['"2026";"x";"a";"1";"05/10/2026";"1"\n', '"2026";"1";"a";"1";"2026-10-05";"1"\n', '"2026";"1"\n'])
def test_bad_values_and_ragged_rows_fail(spark, tmp_path, line):
    raw = tf.read_delimited(spark, write_files(tmp_path / "csv", line))
    with pytest.raises(FAILURES):
        tf.project_contract(raw, SMALL).collect()


def test_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("A;B\n1;2\n")
    (folder / "b.csv").write_text("B;A\n20;10\n")
    got = rows(tf.read_delimited(spark, [str(folder / "a.csv"), str(folder / "b.csv")]), "A")
    assert got == [{"A": "1", "B": "2"}, {"A": "10", "B": "20"}]
    with pytest.raises(FAILURES):
        tf.read_delimited(spark, str(folder)).collect()


def test_missing_source_column(spark, tmp_path):
    raw = tf.read_delimited(spark, write_files(tmp_path / "csv", "")).drop("QT")
    with pytest.raises(ValueError, match="QT"):
        tf.project_contract(raw, SMALL)


def good(frame):
    return frame([(2026, 1, "a", 1.0, None, 5, 10), (2026, 2, None, 2.0, None, 6, 20)], SMALL.schema)


def test_contract_accepts_and_rejects(frame):
    df = good(frame)
    validate(df, SMALL)
    bad = {
        "missing": df.drop("qt"),
        "is int": df.withColumn("qt", F.col("qt").cast("int")),
        "nulo:ano": df.withColumn("ano", F.lit(None).cast("smallint")),
        "faixa:vr": df.withColumn("vr", F.lit(101.0)),
        "chave_repetida": df.unionByName(df),
    }
    for message, broken in bad.items():
        with pytest.raises(ContractViolation, match=message):
            validate(broken, SMALL)


def test_every_contract_is_consistent():
    assert len(CONTRACTS) == 19
    for c in CONTRACTS.values():
        names = set(c.columns)
        assert set(c.key) <= names and set(c.required) <= names and set(c.ranges) <= names and len(names) == len(c.fields)


def test_publication_is_all_or_nothing(spark, frame, tmp_path):
    root = str(tmp_path / "table")
    publish.publish_year(good(frame), SMALL, root, 2026)
    publish.publish_year(good(frame).limit(1), SMALL, root, 2022)
    read = tf.read_partitioned(spark, root)
    assert {r["ano"]: r["count"] for r in rows(read.groupBy("ano").count())} == {2026: 2, 2022: 1}
    with pytest.raises(ContractViolation):
        publish.publish_year(good(frame).unionByName(good(frame)), SMALL, root, 2026)
    expected = good(frame).select(F.lit(99).alias("qt"))
    control = lambda staged: rc.compare_controls(expected, staged.agg(F.sum("qt").alias("qt")))
    with pytest.raises(publish.ControlMismatch, match="qt"):
        publish.publish_year(good(frame), SMALL, root, 2026, [control])
    assert tf.read_partitioned(spark, root).filter("ano = 2026").count() == 2
    # What failed its checks was written, is in no manifest, and is what may be removed.
    assert len(versions.unused(spark, root)) == 2 and versions.state(spark, root)[0] == 2
    plan = read.filter("ano = 2026")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan


def test_merge_is_idempotent(frame):
    s = "k int, t int, v int"
    old, new = frame([(1, 1, 1), (2, 1, 1)], s), frame([(2, 1, 9), (3, 1, 3)], s)
    once = publish.merge_last(old, new, ["k"])
    assert {r["k"]: r["v"] for r in rows(once)} == {1: 1, 2: 9, 3: 3}
    assert rows(publish.merge_last(once, new, ["k"]), "k") == rows(once, "k")


def test_series_and_results_from_json(spark, tmp_path):
    series = tmp_path / "s.json"
    series.write_text(json.dumps([{"data": "01/10/2022", "valor": "0.59"}, {"data": "01/09/2022", "valor": "-0.29"}]))
    got = rows(tf.read_month_series(spark, str(series)), "mes")
    assert got == [{"mes": "2022-09", "variacao": -0.29}, {"mes": "2022-10", "variacao": 0.59}]
    cand = {"sqcand": "11", "n": "1234", "dvt": "Válido", "vap": "9"}
    office = {"cd": "3", "agr": [{"par": [{"n": "12", "sg": "AA", "tvtn": "9", "cand": [cand]}, {"n": "13", "sg": "BB", "tvtl": "", "cand": []}]}]}
    doc = {"cdabr": "sp", "e": {"te": "100", "c": "80"}, "v": {"vv": "70", "vnom": "70", "vb": "5", "tvn": "5"}, "carg": [office]}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps(doc))
    docs = tf.read_results(spark, str(tmp_path / "docs"))
    t = rows(tf.result_totals(docs))[0]
    assert (t["sg_uf"], t["cd_cargo"], t["aptos"], t["votos_legenda"]) == ("SP", 3, 100, None)
    assert rows(tf.result_candidates(docs))[0]["votos"] == 9
    assert {r["nr_partido"]: r["votos_legenda"] for r in rows(tf.result_parties(docs))} == {12: None, 13: None}
    (tmp_path / "docs" / "b.json").write_text(json.dumps({**doc, "carg": [office, office]}))
    with pytest.raises(FAILURES, match="one office"):
        tf.result_totals(tf.read_results(spark, str(tmp_path / "docs"))).collect()


def test_member_list(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("sq,grupo,origem\n1,a,indicado\n2,a,outro\n ,a,x\n3,b,indicado\n")
    got = rows(tf.read_list(spark, str(f), "sq", {"grupo": "a"}), "sq_candidato")
    assert got == [{"sq_candidato": 1, "indicado": True}, {"sq_candidato": 2, "indicado": False}]


# --- lists and maps ------------------------------------------------------------------------------


def test_handle_comparison_classes(frame):
    declared = frame([(1, "a", True), (1, "b", False), (2, "c", True), (3, "d", True), (5, "e", True)], "sq_candidato int, username string, principal boolean")
    site = frame([(1, "b", 9), (2, "c", 1), (3, None, None), (4, "z", 3), (6, None, None)], "sq_candidato int, instagram string, seguidores int")
    got = {r["sq_candidato"]: r["divergencia"] for r in rows(people.compare_handles(declared, site))}
    assert got == {1: "site_usa_perfil_alternativo_do_tse", 3: "so_no_tse", 4: "so_no_site", 5: "candidato_ausente_no_site"}


def test_explicit_selection_outside_scope_fails(frame):
    s = "ano int, sq_candidato int, pessoa_id string, ds_cargo string"
    old, new = frame([(2022, 1, "x", "A")], s), frame([(2026, 2, "x", "A"), (2026, 3, "y", "B")], s)
    scope = F.col("ds_cargo") == "A"
    got = people.select_people(old, new, frame([("x",), ("y",)], "pessoa_id string"), scope=scope)
    assert {(r["lado"], r["sq_candidato"]) for r in rows(got)} == {("de", 1), ("para", 2)}
    for missing in (3, 77):
        with pytest.raises(FAILURES, match="outside the selection"):
            people.select_people(old, new, None, ids_new=frame([(missing,)], "sq_candidato int"), scope=scope).collect()


def test_map_keeps_both_kinds_of_gap(frame):
    v = frame([(1, 5), (3, 7), (None, 2)], "cd_mun_ibge int, votos bigint")
    b = frame([(1, 100, 50), (2, 40, 20)], "cd_mun_ibge int, aptos bigint, validos bigint")
    got = {r["cd_mun_ibge"]: r for r in rows(maps.map_values(v, b))}
    assert got[2]["penetracao"] == 0.0 and got[3]["penetracao"] is None and got[3]["votos"] == 7
    assert rows(maps.votes_off_map(v)) == [{"votos_fora_do_mapa": 2}]


def test_national_candidacy_uses_national_base(frame):
    c = frame([(2026, 1, "Z", "BR", "PRESIDENTE", None, False), (2026, 2, "A", "SP", "PRESIDENTE", "APTO", True)],
              "ano int, sq_candidato int, nm_urna string, sg_uf string, ds_cargo string, ds_situacao_candidatura string, foi_as_urnas boolean")
    v = frame([(2026, 1, "SP", 1, 1, 30), (2026, 2, "SP", 1, 1, 10)], "ano int, sq_candidato int, sg_uf string, cd_mun_ibge int, nr_zona int, votos bigint")
    e = frame([(2026, "SP", "PRESIDENTE", 1, 1, 100, 50), (2026, "RJ", "PRESIDENTE", 2, 1, 300, 50)],
              "ano int, sg_uf string, ds_cargo string, cd_mun_ibge int, nr_zona int, aptos bigint, votos_validos bigint")
    got = {r["sq_candidato"]: r for r in rows(lists.candidate_list(c, v, e, 10))}
    assert got[1]["penetracao"] == 75.0 and got[2]["penetracao"] == 100.0
    assert got[1]["situacao"] == "Não foi às urnas" and got[1]["abrangencia"] == "nacional"


def test_catalog_reads_published_layout(spark, frame, tmp_path):
    root = str(tmp_path)
    frame([(2026, 1, "SP", 10, 3, 7, 5), (2026, 2, "SP", 10, 3, 7, 9)],
          "ano int, nr_turno int, sg_uf string, cd_mun_ibge int, nr_zona int, sq_candidato int, qt_votos_nominais_validos bigint"
          ).write.partitionBy("ano").parquet(f"{root}/votacao_candidato_munzona")
    assert rows(catalog.Catalog(spark, root).votes())[0]["votos"] == 5


def test_a_reader_between_write_and_commit_sees_the_old_year(spark, frame, tmp_path):
    root = str(tmp_path / "table")
    assert versions.read(spark, root) is None and versions.state(spark, root) == (0, {})
    publish.publish_year(good(frame).limit(1), SMALL, root, 2026)
    seen = []

    def control(staged):
        # The new rows are on disk already; a reader that comes now still gets the one old row.
        seen.append((staged.count(), tf.read_partitioned(spark, root).count()))
        return frame([("ok", True)], "controle string, igual boolean")

    open_before = tf.read_partitioned(spark, root)
    assert publish.publish_year(good(frame), SMALL, root, 2026, [control]) == 2
    assert seen == [(2, 1)] and tf.read_partitioned(spark, root).count() == 2
    # A reader that resolved its folders before the commit goes on with them, and versions stay readable.
    assert open_before.count() == 1 and versions.read(spark, root, number=1).count() == 1
    assert len(versions.unused(spark, root)) == 1 and versions.unused(spark, root, keep=2) == []


def test_an_incomplete_manifest_is_passed_over(spark, frame, tmp_path):
    root = tmp_path / "table"
    publish.publish_year(good(frame), SMALL, str(root), 2026)
    (root / versions.FOLDER / "2").write_text('{"ano=2026": "ano=2026/versao=no')
    assert versions.state(spark, str(root))[0] == 1 and tf.read_partitioned(spark, str(root)).count() == 2
    # The next writer takes the number after it and builds on the last complete state.
    assert publish.publish_year(good(frame).limit(1), SMALL, str(root), 2022) == 3
    assert tf.read_partitioned(spark, str(root)).count() == 3


def test_two_writers_do_not_lose_each_other(spark, frame, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "table")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda y: versions.commit(spark, root, {f"ano={y}": f"ano={y}/versao=x"}), range(2000, 2008)))
    assert sorted(numbers) == list(range(1, 9)) and len(versions.state(spark, root)[1]) == 8


def test_blocks_read_their_input_once(spark):
    """Ten sides read the result documents, eight the sections: neither is read anew for each."""
    from escrutinio.catalogue import audit

    for query, name in ((audit.published_blocks, "part.parquet"), (audit.rebuilt_blocks, "lineitem.parquet")):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "p_partkey" not in plan and "l_orderkey" not in plan, name


def test_tasks_of_a_shuffle_stay_small(spark):
    from escrutinio.session import apply_defaults

    conf = apply_defaults(spark).conf
    assert conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    assert conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "200"


def test_handle_counts_reads_every_text_once(frame):
    from escrutinio.operators import people

    texts = [
        (1, 1, "@ana"), (1, 2, "instagram.com/ana/"), (1, 3, "instagram.com/bia"), (2, 1, "instagram.com/p/x"),
        (3, 1, "facebook.com/c"), (5, 1, "meu instagram e lindo"), (None, 1, "@ninguem dois"), (6, 1, None), (7, 1, "@so"),
    ]
    d = frame(texts, "sq_candidato int, nr_ordem int, url_tse string")
    got = people.handle_counts(d, frame([(1,), (1,), (2,), (3,), (4,), (5,), (6,)], "sq_candidato int"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("url_decode") <= 1
    assert rows(got) == [
        {"candidatos_no_grupo": 6, "com_instagram": 1, "sem_instagram": 5, "perfis": 2, "com_mais_de_um_perfil": 1, "urls_instagram_rejeitadas": 3}
    ]


@pytest.mark.parametrize("query", ["municipality_summary", "top_units", "votes_by_state", "vote_totals"])
def test_join_of_line_items_starts_in_many_pieces(spark, query):
    """The session shuffles to 4 partitions; the large join must not, as its tasks would grow with the input."""
    import re

    from escrutinio import catalogue

    plan = catalogue.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pieces = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^()]*, (\d+)\)", plan)]
    assert pieces and min(pieces) >= 200
