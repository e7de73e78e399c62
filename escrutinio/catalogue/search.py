"""Search, person pairs, person keys, text normalisation, handles, embedded objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from escrutinio.catalogue.roles import YEAR_AFTER, YEAR_BEFORE, table, with_sql
from escrutinio.functions import identity
from escrutinio.functions.handles import profile_handle
from escrutinio.functions.text import normalize_label, normalize_search
from escrutinio.operators import people
from escrutinio.plans import comparison, references
from escrutinio.sources.text_files import embedded_candidates, embedded_objects

SALT = "sal-de-teste"


def part_candidates(spark, d):
    """Parts as searchable candidacies."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    return p.select(
        (2022 + 4 * (k % 2)).cast("int").alias("ano"),
        k.alias("sq_candidato"),
        F.initcap("p_name").alias("nm_urna"),
        F.concat_ws(" ", "p_brand", "p_name").alias("nm_civil"),
        F.col("p_type").alias("sg_partido"),
        k.alias("nr_candidato"),
        F.col("p_size").alias("nr_partido"),
        F.when(k % 3 == 0, "SENADOR").otherwise("DEPUTADO FEDERAL").alias("ds_cargo"),
        F.when(k % 4 == 0, "BR").otherwise("SP").alias("sg_uf"),
        (k % 10 != 0).alias("foi_as_urnas"),
    )


def part_votes(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    return li.select(
        (2022 + 4 * (F.col("l_partkey") % 2)).cast("int").alias("ano"),
        F.col("l_partkey").alias("sq_candidato"),
        F.col("l_quantity").cast("bigint").alias("votos"),
    )


def search_ranked(spark, d):
    out = people.search(part_candidates(spark, d), part_votes(spark, d), "gear", 40)
    return out.select("ano", "sq_candidato", "nm_urna", "nivel", "votos", "total")


def search_scoped(spark, d):
    out = people.search(
        part_candidates(spark, d), part_votes(spark, d), "brand#1", 30, year=2022, office="DEPUTADO FEDERAL", state="SP"
    )
    return out.select("ano", "sq_candidato", "nm_urna", "nivel", "votos", "total")


def search_group(spark, d):
    """Inside a group: the party of size 12 or the listed parts."""
    c = part_candidates(spark, d)
    out = people.search(c, part_votes(spark, d), "an", 40, party=12, listed=c.filter(F.col("sq_candidato") % 7 == 1))
    return out.select("ano", "sq_candidato", "nm_urna", "nivel", "votos", "total")


def side_order(spark, d):
    v = part_votes(spark, d).groupBy("ano", "sq_candidato").agg(F.sum("votos").alias("votos"))
    return references.side_order(part_candidates(spark, d).join(v, ["ano", "sq_candidato"]).select("ano", "sq_candidato", "nm_urna", "votos"))


def ran_on_ballot(spark, d):
    k = F.col("c_custkey")
    code = F.when(k % 8 != 0, (k % 7).cast("int"))
    return table(spark, d, "customer").select(k.alias("sq_candidato"), identity.ran_on_ballot(code).alias("foi_as_urnas"))


def search_number(spark, d):
    out = people.search(part_candidates(spark, d), part_votes(spark, d), "12", 50)
    return out.select("ano", "sq_candidato", "nivel", "votos", "total")


def suggestion_order(spark, d):
    v = part_votes(spark, d).groupBy("ano", "sq_candidato").agg(F.sum("votos").alias("votos"))
    items = part_candidates(spark, d).join(v, ["ano", "sq_candidato"])
    return people.suggestion_order(items, "red").limit(25).select("sq_candidato", "nm_urna", "votos", "ano")


def _registrations(spark, d):
    """One registration per customer and year, from the orders."""
    od = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    cu = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    r = od.groupBy(F.year("o_orderdate").alias("ano"), "o_custkey").agg(
        F.min("o_orderkey").alias("sq_candidato"), F.sum(F.floor("o_totalprice")).alias("votos")
    )
    joined = r.join(cu, F.col("o_custkey") == F.col("c_custkey"))
    person = F.when(F.col("c_custkey") % 17 != 0, F.sha2(F.col("c_custkey").cast("string"), 256))
    return joined.select(
        "ano", "sq_candidato", person.alias("pessoa_id"), F.col("c_name").alias("nm_urna"),
        F.col("c_name").alias("nm_civil"), F.col("c_mktsegment").alias("sg_partido"),
        F.col("sq_candidato").alias("nr_candidato"), F.col("c_nationkey").alias("nr_partido"),
        F.when((F.col("c_custkey") + F.col("ano")) % 3 == 0, "SENADOR").otherwise("DEPUTADO FEDERAL").alias("ds_cargo"),
        F.when(F.col("c_nationkey") % 2 == 0, "SP").otherwise("RJ").alias("sg_uf"),
        ((F.col("sq_candidato") % 8) != 0).alias("foi_as_urnas"), "votos",
        identity.public_id(person).alias("pessoa_pub"),
        F.when(F.col("sq_candidato") % 3 == 0, "Eleito").alias("ds_sit_tot_turno"),
    )


def people_pairs(spark, d):
    return people.people_pairs(_registrations(spark, d), YEAR_BEFORE, YEAR_AFTER, state="SP").select(
        "pessoa_id", "sq_candidato_de", "sq_candidato_para", "ds_cargo_de", "ds_cargo_para"
    )


def people_pairs_term(spark, d):
    return people.people_pairs(
        _registrations(spark, d), YEAR_BEFORE, YEAR_AFTER, term="building", office="DEPUTADO FEDERAL"
    ).select("sq_candidato_de", "sq_candidato_para", "nivel")


def people_in_both(spark, d):
    r = _registrations(spark, d)
    always = r.filter(F.col("sq_candidato") % 97 == 1).select("pessoa_pub")
    out = comparison.people_in_both(r, r, YEAR_BEFORE, YEAR_AFTER, 60, always=always)
    return out.select("sq_candidato_de", "sq_candidato_para", "votos_de", "votos_para", "mesmo_cargo", "comparavel", "total")


def common_sides(spark, d):
    """Both sides of a comparison cut to the persons on both."""
    r = _registrations(spark, d)
    sides = comparison.restrict_to_common(r.filter(F.col("ano") == YEAR_BEFORE), r.filter(F.col("ano") == YEAR_AFTER))
    tagged = [s.select(F.lit(name).alias("lado"), "sq_candidato", "pessoa_id") for s, name in zip(sides, ("de", "para"))]
    return tagged[0].unionByName(tagged[1])


def selected_people(spark, d):
    r = _registrations(spark, d)
    old, new = r.filter(F.col("ano") == YEAR_BEFORE), r.filter(F.col("ano") == YEAR_AFTER)
    chosen = r.filter(F.col("nr_partido") == 4).select("pessoa_id").distinct()
    explicit = new.filter(F.col("ds_cargo") == "SENADOR").filter(F.col("sq_candidato") % 50 == 3)
    out = people.select_people(
        old, new, chosen, ids_new=explicit, scope=F.col("ds_cargo") == "SENADOR"
    )
    return out.select("lado", "ano", "sq_candidato")


def person_list(spark, d):
    r = _registrations(spark, d).withColumnRenamed("ano", "ano_eleicao")
    seeds = r.filter((F.col("ano_eleicao") == YEAR_BEFORE) & (F.col("sq_candidato") % 40 == 5))
    out = people.person_list(r, seeds, 7, YEAR_BEFORE, YEAR_AFTER)
    return out.select("pessoa_id", "sq_candidato", "ds_sit_tot_turno")


def _documents_of_people(spark, d):
    """Customers with an eleven-digit text: half of them with right check digits."""
    cu = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    base = F.lpad((k * 7919 % 999999937).cast("string"), 9, "0")

    def digit(text, size):
        total = F.lit(0)
        for i in range(size):
            total = total + (F.ascii(F.substring(text, i + 1, 1)) - 48) * (size + 1 - i)
        return (total * 10 % 11 % 10).cast("string")

    ten = F.concat(base, digit(base, 9))
    full = F.concat(ten, digit(ten, 10))
    wrong = F.concat(base, F.lit("00"))
    taxpayer = F.when(k % 5 == 0, F.lit("-4")).when(k % 2 == 0, full).otherwise(wrong)
    masked = F.concat(F.substring(taxpayer, 1, 3), F.lit("."), F.substring(taxpayer, 4, 99))
    voter = F.when(k % 7 == 0, F.repeat(F.lit("1"), F.lit(12))).otherwise(F.lpad(k.cast("string"), 12, "9"))
    return cu.select("c_custkey", masked.alias("cpf"), voter.alias("titulo"), full.alias("cheio"))


def person_keys(spark, d):
    rows = _documents_of_people(spark, d)
    key = identity.person_key(F.col("cpf"), F.col("titulo"), SALT)
    return rows.select("c_custkey", key.alias("pessoa_id"), identity.public_id(key).alias("pessoa_pub"))


def check_digits(spark, d):
    rows = _documents_of_people(spark, d)
    digits = F.regexp_replace("cpf", r"\D", "")
    return rows.select("c_custkey", identity.taxpayer_id_is_valid(digits).alias("valido"))


def normalized_text(spark, d):
    """Whole documents in search form, by fingerprint."""
    doc = table(spark, d, "documents").select("doc_id", "text")
    clean = normalize_search(F.col("text"))
    return doc.select("doc_id", F.length(clean).cast("bigint").alias("n"), F.md5(clean.cast("binary")).alias("m"))


def normalized_labels(spark, d):
    na = table(spark, d, "nation").select("n_nationkey", "n_name")
    label = F.concat(F.lit("  Município  "), F.col("n_name"), F.lit("  nº 2º ç ã  "))
    return na.select("n_nationkey", normalize_label(label).alias("rotulo"))


def _declarations(spark, d):
    """Customers and the text each declared for its accounts."""
    cu = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    name = F.concat(F.lit("cand."), k.cast("string"))
    text = (
        F.when(k % 9 == 0, F.concat(F.lit("https://www.instagram.com/"), name, F.lit("/?igsh=x")))
        .when(k % 9 == 1, F.concat(F.lit("@"), F.upper(name)))
        .when(k % 9 == 2, F.concat(F.lit("Instagram: "), name))
        .when(k % 9 == 3, F.concat(F.lit("https://instagram.com/p/"), name))
        .when(k % 9 == 4, F.concat(F.lit("facebook.com/"), name))
        .when(k % 9 == 5, F.lit("fulano de tal instagram"))
        .when(k % 9 == 6, F.concat(F.lit("instagram.com/_u/"), name))
        .when(k % 9 == 7, F.concat(F.lit("instagram.com%2F"), name))
        .otherwise(F.concat(F.lit("instagram.com@"), name))
    )
    return cu.select(
        F.floor(k / 3).alias("sq_candidato"), (k % 3 + 1).cast("int").alias("nr_ordem"), text.alias("url_tse"), k.alias("k")
    )


def profile_handles(spark, d):
    return _declarations(spark, d).select("k", profile_handle(F.col("url_tse")).alias("username"))


def declared_handles(spark, d):
    return people.declared_handles(_declarations(spark, d)).select("sq_candidato", "username", "nr_ordem", "principal")


def handle_counts(spark, d):
    rows = _declarations(spark, d)
    return people.handle_counts(rows, rows.select("sq_candidato"))


def _site(spark, d):
    cu = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return cu.filter((k % 3 == 0) & (k % 15 != 0)).select(
        F.floor(k / 3).alias("sq_candidato"),
        F.when(k % 6 == 0, F.concat(F.lit("cand."), k.cast("string"))).when(k % 7 != 0, F.concat(F.lit("cand."), (k + 1).cast("string"))).alias("instagram"),
        (k * 3).alias("seguidores"),
    )


def handle_divergence(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").filter(F.col("c_custkey") % 3 == 0)
    names = cu.select(
        F.floor(F.col("c_custkey") / 3).alias("sq_candidato"), F.col("c_name").alias("nm_urna"),
        F.when(F.col("c_nationkey") % 2 == 0, "SP").otherwise("RJ").alias("sg_uf"),
    )
    return people.compare_handles(people.declared_handles(_declarations(spark, d)), _site(spark, d), names)


def handle_report(spark, d):
    return people.handle_report(handle_divergence(spark, d))


def work_list(spark, d):
    return people.work_list(people.declared_handles(_declarations(spark, d)), 60)


def embedded_links(spark, d):
    """Link targets and texts of every page, last text per target."""
    pages = table(spark, d, "pages").select("page_id", "html")
    out = embedded_objects(pages, r'<a href="([^"]*)">([^<]*)</a>', ("href", "texto"), "href")
    return out.select("page_id", "href", "texto")


def embedded_candidate_objects(spark, d):
    """Candidate objects written into page text from the page key, then found again."""
    pages = table(spark, d, "pages").select("page_id", "html")
    k = F.col("page_id")

    def obj(sq, handle, followers):
        return F.concat(
            F.lit('{\\"sq\\":\\"'), sq.cast("string"), F.lit('\\",\\"nome\\":\\"x\\",\\"instagram\\":'), handle,
            F.lit(',\\"seguidores\\":'), followers, F.lit("},"),
        )

    quoted = F.concat(F.lit('\\"@User'), k.cast("string"), F.lit('\\"'))
    text = F.concat(
        F.col("html"), obj(k, quoted, k.cast("string")), obj(k + 1, F.lit("null"), F.lit("null")),
        obj(k, F.lit('\\"final\\"'), F.lit("9")),
    )
    return embedded_candidates(pages.select("page_id", text.alias("html")))


QUERIES = {
    f.__name__: f
    for f in (
        search_ranked, search_scoped, search_group, side_order, ran_on_ballot, search_number, suggestion_order, people_pairs,
        people_pairs_term, people_in_both, common_sides, selected_people, person_list, person_keys, check_digits,
        normalized_text, normalized_labels, profile_handles, declared_handles, handle_counts,
        handle_divergence, handle_report, work_list, embedded_links, embedded_candidate_objects,
    )
}

PARTS = """
cand AS (SELECT CAST(2022 + 4 * (p_partkey % 2) AS INTEGER) AS ano, p_partkey AS sq_candidato, p_name AS urna, p_brand || ' ' || p_name AS civil0,
  p_type, p_size, CASE WHEN p_partkey % 3 = 0 THEN 'SENADOR' ELSE 'DEPUTADO FEDERAL' END AS ds_cargo,
  CASE WHEN p_partkey % 4 = 0 THEN 'BR' ELSE 'SP' END AS sg_uf, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS nm_urna
  FROM part WHERE p_partkey % 10 <> 0),
norma AS (SELECT *, lower(urna) AS u, lower(civil0) AS c, lower(p_type) AS s FROM cand),
vt AS (SELECT l_partkey AS sq_candidato, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS votos FROM lineitem GROUP BY ALL)
"""


def _text_tier(term: str) -> str:
    starts = " OR ".join(f"starts_with({c}, '{term}') OR contains({c}, ' {term}')" for c in "ucs")
    inside = " OR ".join(f"contains({c}, '{term}')" for c in "ucs")
    return f"""CASE WHEN u = '{term}' THEN 0 WHEN starts_with(u, '{term}') OR starts_with(c, '{term}') THEN 1
      WHEN {starts} THEN 2 WHEN {inside} THEN 3 END"""


def _search_sql(tier: str, where: str, limit: int, columns: str) -> str:
    return with_sql(
        PARTS + f", h AS (SELECT *, {tier} AS nivel FROM norma WHERE {where}), k AS (SELECT * FROM h WHERE nivel IS NOT NULL)",
        f"""SELECT {columns}, nivel, coalesce(votos, 0) AS votos, (SELECT count(*) FROM k) AS total FROM k LEFT JOIN vt USING (sq_candidato)
        ORDER BY nivel, coalesce(votos, 0) DESC, ano DESC, nm_urna, sq_candidato LIMIT {limit}""",
    )


REGISTRATIONS = """
reg AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, min(o_orderkey) AS sq_candidato, o_custkey AS k,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS votos FROM orders GROUP BY 1, 3),
pes AS (SELECT r.*, CASE WHEN k % 17 <> 0 THEN sha256(CAST(k AS VARCHAR)) END AS pessoa_id, c_name AS nm_urna, lower(c_mktsegment) AS s,
  c_nationkey AS nr_partido, CASE WHEN (k + ano) % 3 = 0 THEN 'SENADOR' ELSE 'DEPUTADO FEDERAL' END AS ds_cargo,
  CASE WHEN c_nationkey % 2 = 0 THEN 'SP' ELSE 'RJ' END AS sg_uf, sq_candidato % 8 <> 0 AS urnas FROM reg r JOIN customer ON k = c_custkey),
""" + f"""de AS (SELECT * FROM pes WHERE ano = {YEAR_BEFORE} AND urnas AND pessoa_id IS NOT NULL),
para AS (SELECT * FROM pes WHERE ano = {YEAR_AFTER} AND urnas AND pessoa_id IS NOT NULL)
"""


def _sum_digits(text: str, size: int) -> str:
    terms = " + ".join(f"(ascii(substr({text}, {i + 1}, 1)) - 48) * {size + 1 - i}" for i in range(size))
    return f"CAST(({terms}) * 10 % 11 % 10 AS VARCHAR)"


PEOPLE_KEYS = f"""
a AS (SELECT c_custkey AS k, lpad(CAST(c_custkey * 7919 % 999999937 AS VARCHAR), 9, '0') AS b FROM customer),
t AS (SELECT k, b, b || {_sum_digits('b', 9)} AS ten FROM a),
f AS (SELECT k, b, ten || {_sum_digits('ten', 10)} AS cheio FROM t),
p AS (SELECT k, CASE WHEN k % 5 = 0 THEN '-4' WHEN k % 2 = 0 THEN cheio ELSE b || '00' END AS cpf, cheio,
  CASE WHEN k % 7 = 0 THEN NULL ELSE nullif(lpad(CAST(k AS VARCHAR), 12, '9'), repeat('9', 12)) END AS titulo FROM f),
q AS (SELECT k, cpf, cpf = cheio AND length(cpf) = 11 AND cpf <> repeat(substr(cpf, 1, 1), 11) AS valido, titulo FROM p),
h AS (SELECT k, CASE WHEN valido THEN sha256('{SALT}' || cpf) WHEN titulo IS NOT NULL THEN sha256('{SALT}' || titulo) END AS pessoa_id FROM q)
"""
HANDLES = """
decl AS (SELECT c_custkey AS k, c_custkey // 3 AS sq_candidato, CAST(c_custkey % 3 + 1 AS INTEGER) AS nr_ordem,
  CASE WHEN c_custkey % 9 IN (0, 1, 2, 6, 7, 8) THEN 'cand.' || c_custkey END AS username FROM customer),
com AS (SELECT *, nr_ordem = min(nr_ordem) OVER (PARTITION BY sq_candidato) AS principal FROM decl WHERE username IS NOT NULL)
"""
DIVERGENCE = HANDLES + """, t AS (SELECT sq_candidato, min(username) FILTER (WHERE principal) AS instagram_tse,
  nullif(array_to_string(list_sort(list(username) FILTER (WHERE NOT principal)), ','), '') AS instagram_tse_alternativos FROM com GROUP BY ALL),
  site AS (SELECT c_custkey // 3 AS sq_candidato, CASE WHEN c_custkey % 6 = 0 THEN 'cand.' || c_custkey WHEN c_custkey % 7 <> 0 THEN 'cand.' || (c_custkey + 1) END AS instagram_site,
    c_custkey * 3 AS seguidores_site FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 15 <> 0),
  j AS (SELECT coalesce(t.sq_candidato, s.sq_candidato) AS sq_candidato, instagram_tse, instagram_tse_alternativos, instagram_site, seguidores_site,
    s.sq_candidato IS NULL AS fora FROM t FULL JOIN site s ON t.sq_candidato = s.sq_candidato),
  div AS (SELECT *, CASE WHEN instagram_site IS NOT NULL AND instagram_tse IS NULL THEN 'so_no_site'
    WHEN instagram_site IS NULL AND instagram_tse IS NOT NULL AND fora THEN 'candidato_ausente_no_site'
    WHEN instagram_site IS NULL AND instagram_tse IS NOT NULL THEN 'so_no_tse' WHEN instagram_site IS NULL THEN 'nenhum'
    WHEN instagram_site = instagram_tse THEN 'igual'
    WHEN list_contains(string_split(coalesce(instagram_tse_alternativos, ''), ','), instagram_site) THEN 'site_usa_perfil_alternativo_do_tse'
    ELSE 'perfis_diferentes' END AS divergencia FROM j)
"""

ORACLE = {
    "search_ranked": _search_sql(_text_tier("gear"), "true", 40, "ano, sq_candidato, nm_urna"),
    "search_scoped": _search_sql(
        _text_tier("brand#1"), "ano = 2022 AND ds_cargo = 'DEPUTADO FEDERAL' AND sg_uf = 'SP'", 30, "ano, sq_candidato, nm_urna"
    ),
    "search_group": _search_sql(_text_tier("an"), "(p_size = 12 OR sq_candidato % 7 = 1)", 40, "ano, sq_candidato, nm_urna"),
    "side_order": with_sql(
        PARTS.replace("WHERE p_partkey % 10 <> 0", ""), "SELECT ano, sq_candidato, nm_urna, votos FROM cand JOIN vt USING (sq_candidato) ORDER BY votos DESC, sq_candidato"
    ),
    "ran_on_ballot": "SELECT c_custkey AS sq_candidato, c_custkey % 8 <> 0 AS foi_as_urnas FROM customer",
    "search_number": _search_sql(
        "CASE WHEN CAST(sq_candidato AS VARCHAR) = '12' THEN 0 WHEN starts_with(CAST(sq_candidato AS VARCHAR), '12') THEN 1 WHEN p_size = 12 THEN 2 END",
        "true", 50, "ano, sq_candidato",
    ),
    "suggestion_order": with_sql(
        PARTS.replace("WHERE p_partkey % 10 <> 0", ""),
        """SELECT sq_candidato, nm_urna, votos, ano FROM norma JOIN vt USING (sq_candidato)
        ORDER BY starts_with(u, 'red') DESC, votos DESC, ano DESC, nm_urna, sq_candidato LIMIT 25""",
    ),
    "people_pairs": with_sql(
        REGISTRATIONS,
        """SELECT pessoa_id, de.sq_candidato AS sq_candidato_de, para.sq_candidato AS sq_candidato_para, de.ds_cargo AS ds_cargo_de, para.ds_cargo AS ds_cargo_para
        FROM de JOIN para USING (pessoa_id) WHERE de.sg_uf = 'SP' OR para.sg_uf = 'SP'""",
    ),
    "people_pairs_term": with_sql(
        REGISTRATIONS,
        """SELECT de.sq_candidato AS sq_candidato_de, para.sq_candidato AS sq_candidato_para, 2 AS nivel FROM de JOIN para USING (pessoa_id)
        WHERE de.ds_cargo = 'DEPUTADO FEDERAL' AND para.ds_cargo = 'DEPUTADO FEDERAL' AND de.s = 'building'""",
    ),
    "people_in_both": with_sql(
        REGISTRATIONS,
        """, j AS (SELECT pessoa_id, para.nm_urna AS n, de.sq_candidato AS a, para.sq_candidato AS b, de.votos AS votos_de, para.votos AS votos_para,
          de.ds_cargo = para.ds_cargo AS mesmo_cargo, de.ds_cargo = para.ds_cargo AND para.ds_cargo <> 'SENADOR' AS comparavel FROM de JOIN para USING (pessoa_id)),
        g AS (SELECT * FROM j ORDER BY n, b, a LIMIT 60),
        x AS (SELECT * FROM j WHERE pessoa_id IN (SELECT pessoa_id FROM pes WHERE sq_candidato % 97 = 1))
        SELECT a AS sq_candidato_de, b AS sq_candidato_para, votos_de, votos_para, mesmo_cargo, comparavel, (SELECT count(*) FROM j) AS total FROM (SELECT * FROM g UNION SELECT * FROM x)""",
    ),
    "common_sides": with_sql(
        REGISTRATIONS,
        f""", o AS (SELECT * FROM pes WHERE ano = {YEAR_BEFORE} AND pessoa_id IS NOT NULL), n AS (SELECT * FROM pes WHERE ano = {YEAR_AFTER} AND pessoa_id IS NOT NULL)
        SELECT 'de' AS lado, sq_candidato, pessoa_id FROM o WHERE pessoa_id IN (SELECT pessoa_id FROM n)
        UNION ALL SELECT 'para', sq_candidato, pessoa_id FROM n WHERE pessoa_id IN (SELECT pessoa_id FROM o)""",
    ),
    "selected_people": with_sql(
        REGISTRATIONS,
        f""", o AS (SELECT * FROM pes WHERE ano = {YEAR_BEFORE} AND ds_cargo = 'SENADOR'), n AS (SELECT * FROM pes WHERE ano = {YEAR_AFTER} AND ds_cargo = 'SENADOR'),
        c AS (SELECT DISTINCT pessoa_id FROM pes WHERE nr_partido = 4 AND pessoa_id IS NOT NULL)
        SELECT 'de' AS lado, ano, sq_candidato FROM o WHERE pessoa_id IN (FROM c) AND pessoa_id IN (SELECT pessoa_id FROM n WHERE pessoa_id IS NOT NULL)
        UNION SELECT 'para', ano, sq_candidato FROM n WHERE (pessoa_id IN (FROM c) AND pessoa_id IN (SELECT pessoa_id FROM o WHERE pessoa_id IS NOT NULL)) OR sq_candidato % 50 = 3""",
    ),
    "person_list": with_sql(
        REGISTRATIONS,
        f"""SELECT pessoa_id, sq_candidato, CASE WHEN sq_candidato % 3 = 0 THEN 'Eleito' END AS ds_sit_tot_turno FROM pes WHERE ano = {YEAR_BEFORE}
        AND pessoa_id IN (SELECT pessoa_id FROM pes WHERE (ano = {YEAR_AFTER} AND nr_partido = 7) OR (ano = {YEAR_BEFORE} AND sq_candidato % 40 = 5))""",
    ),
    "person_keys": with_sql(
        PEOPLE_KEYS, "SELECT k AS c_custkey, pessoa_id, substr(sha256('pub:' || pessoa_id), 1, 12) AS pessoa_pub FROM h"
    ),
    "check_digits": with_sql(PEOPLE_KEYS, "SELECT k AS c_custkey, valido FROM q"),
    "normalized_text": r"""WITH n AS (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, length(t) AS n, md5(t) AS m FROM n""",
    "normalized_labels": "SELECT n_nationkey, 'MUNICIPIO ' || n_name || ' NO 2O C A' AS rotulo FROM nation",
    "profile_handles": with_sql(HANDLES, "SELECT k, username FROM decl"),
    "declared_handles": with_sql(HANDLES, "SELECT sq_candidato, username, nr_ordem, principal FROM com"),
    "handle_counts": with_sql(
        HANDLES,
        """, n AS (SELECT sq_candidato, count(username) AS n FROM decl GROUP BY ALL)
        SELECT count(*) AS candidatos_no_grupo, count(*) FILTER (WHERE n > 0) AS com_instagram, count(*) FILTER (WHERE n = 0) AS sem_instagram,
        CAST(sum(n) AS BIGINT) AS perfis, count(*) FILTER (WHERE n > 1) AS com_mais_de_um_perfil,
        (SELECT count(*) FROM customer WHERE c_custkey % 9 IN (3, 5)) AS urls_instagram_rejeitadas FROM n""",
    ),
    "handle_divergence": with_sql(
        DIVERGENCE,
        """SELECT sq_candidato, divergencia, instagram_tse, instagram_tse_alternativos, instagram_site, seguidores_site,
        c_name AS nm_urna, CASE WHEN c_nationkey % 2 = 0 THEN 'SP' WHEN c_nationkey % 2 = 1 THEN 'RJ' END AS sg_uf
        FROM div LEFT JOIN customer ON c_custkey = 3 * sq_candidato WHERE divergencia NOT IN ('igual', 'nenhum')""",
    ),
    "handle_report": with_sql(
        DIVERGENCE, "SELECT divergencia, count(*) AS n FROM div WHERE divergencia NOT IN ('igual', 'nenhum') GROUP BY ALL"
    ),
    "work_list": with_sql(
        HANDLES, "SELECT username, principal, sq_candidato FROM com ORDER BY principal DESC, sq_candidato, username LIMIT 60"
    ),
    "embedded_links": r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
          unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS texto, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos FROM pages)
        SELECT page_id, href, arg_max(texto, pos) AS texto FROM m GROUP BY ALL""",
    "embedded_candidate_objects": """SELECT page_id, page_id AS sq_candidato, 'final' AS instagram, 9::BIGINT AS seguidores FROM pages
        UNION ALL SELECT page_id, page_id + 1, NULL, NULL FROM pages""",
}
