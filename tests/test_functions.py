import pytest
from pyspark.sql import functions as F

from escrutinio.functions import checks, handles, identity, instants, rates, text
from tests.conftest import FAILURES, rows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ratio_is_null_when_undefined(frame):
    df = frame([(1, 2), (1, 0), (1, None), (None, 2)], "a int, b int")
    got = [r.v for r in df.select(rates.ratio(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [0.5, None, None, None]


@pytest.mark.parametrize(
    ("valid", "seats", "quotient"), [(100, 8, 12), (108, 8, 13), (109, 8, 14), (0, 3, 0), (7, 2, 3)]
)
def test_electoral_quotient_rounds_above_half(spark, valid, seats, quotient):
    assert one(spark, rates.electoral_quotient(F.lit(valid), F.lit(seats))) == quotient


def test_electoral_quotient_needs_seats(spark):
    with pytest.raises(FAILURES, match="electoral quotient undefined"):
        one(spark, rates.electoral_quotient(F.lit(10), F.lit(0)))


def test_low_count_is_strict_and_covers_unknown(frame):
    df = frame([(19.999,), (20.0,), (None,)], "e double")
    assert [r.v for r in df.select(rates.is_low_count(F.col("e")).alias("v")).collect()] == [True, False, True]


@pytest.mark.parametrize(
    ("raw", "label"),
    [
        ("  Recursos   próprios ", "RECURSOS PROPRIOS"),
        ("2º turno", "2O TURNO"),
        ("Doações\tpela Internet", "DOACOES PELA INTERNET"),
        ("ÁÉÍÓÚ ç ñ", "AEIOU C N"),
    ],
)
def test_labels_lose_accents_and_spaces(spark, raw, label):
    assert one(spark, text.normalize_label(F.lit(raw))) == label


def test_search_text_keeps_ordinal_sign(spark):
    assert one(spark, text.normalize_search(F.lit("  César  2º "))) == "cesar 2º"


@pytest.mark.parametrize(
    ("term", "urna", "civil", "sigla", "tier"),
    [
        ("ana", "ana", "ana maria", "p", 0),
        ("ana", "ana maria", None, "p", 1),
        ("ana", "zeca", "ana z", "p", 1),
        ("maria", "ana maria", None, "p", 2),
        ("pt", "x", "y", "pt", 2),
        ("aria", "ana maria", None, "p", 3),
        ("zzz", "ana maria", None, "p", None),
    ],
)
def test_relevance_of_text(spark, term, urna, civil, sigla, tier):
    got = text.relevance(
        term, F.lit(urna), F.lit(civil).cast("string"), F.lit(sigla), F.lit(1), F.lit(2)
    )
    assert one(spark, got) == tier


@pytest.mark.parametrize(("number", "party", "tier"), [(14, 9, 0), (1450, 9, 1), (99, 14, 2), (99, 9, None)])
def test_relevance_of_digits(spark, number, party, tier):
    n = F.lit("x")
    assert one(spark, text.relevance("14", n, n, n, F.lit(number), F.lit(party))) == tier


def test_months(spark):
    assert one(spark, text.next_month(F.lit("2022-12"))) == "2023-01"
    assert one(spark, text.is_month(F.lit("2022-13"))) is False


@pytest.mark.parametrize(
    ("digits", "valid"),
    [("52998224725", True), ("52998224724", False), ("11111111111", False), ("5299822472", False), ("", False)],
)
def test_check_digits(spark, digits, valid):
    assert one(spark, identity.taxpayer_id_is_valid(F.lit(digits))) is valid


def test_person_key_prefers_taxpayer_then_voter(frame):
    df = frame(
        [("529.982.247-25", "123456789012"), ("-4", "123456789012"), ("-4", "-4"), (None, "111111111111")],
        "c string, t string",
    )
    keys = [r.k for r in df.select(identity.person_key(F.col("c"), F.col("t"), "s").alias("k")).collect()]
    assert keys[0] != keys[1] and len(keys[0]) == 64
    assert keys[2:] == [None, None]


def test_public_id_is_short_and_stable(spark):
    a = one(spark, identity.public_id(F.lit("abc")))
    assert a == one(spark, identity.public_id(F.lit("abc"))) and len(a) == 12


@pytest.mark.parametrize(
    ("declared", "handle"),
    [
        ("https://www.instagram.com/Fulano.Silva/?igsh=abc", "fulano.silva"),
        ("instagram.com/_u/fulano", "fulano"),
        ("@Fulano_1", "fulano_1"),
        ("INSTAGRAM: fulano", "fulano"),
        ("fulano - instagram", "fulano"),
        ("https://instagram@fulano", "fulano"),
        ("instagran.com/fulano.", "fulano"),
        ("https://instagram.com/p/abc", None),
        ("https://instagram.com/reel", None),
        ("https://instagram.com/", None),
        ("@fulano (tiktok)", None),
        ("fulano de tal instagram", None),
        ("fulano", None),
        ("facebook.com/fulano", None),
        ("instagram.com%2Ffulano", "fulano"),
        ("100% fulano", None),
        ("instagram.com/a/b", None),
        ("instagram.com/a/a", None),
        ("instagram.com/_u/a/b", None),
        ("instagram: @fulano / fulano", None),
        ("instagram fulano fulano", "fulano"),
        ("@fulano.", "fulano"),
        ("veja m.instagram.com/fulano aqui", "fulano"),
        ("instagram@fulano/x", "fulano"),
        ("instagram", None),
        ("www.fulano.com", None),
        ("@ab+c", None),
        ("instagram.com?x=instagram.com/fulano#z", "fulano"),
        ("", None),
    ],
)
def test_profile_handle(spark, declared, handle):
    assert one(spark, handles.profile_handle(F.lit(declared))) == handle


def test_local_day_differs_from_utc_day(spark):
    at = F.lit("2026-08-16 02:30:00").cast("timestamp_ntz")
    assert str(one(spark, instants.local_day(at))) == "2026-08-15"


def test_zoned_timestamps_become_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.range(1).select(F.lit("2026-01-01 00:00:00").cast("timestamp").alias("t"))
        got = instants.as_utc(df, "t").select(F.col("t").cast("string").alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2026-01-01 03:00:00"


def test_single_value_guard(frame):
    ok = frame([(1, 6), (1, 6)], "nr_turno int, cd_cargo int")
    assert ok.filter(checks.single_value(ok, ["nr_turno", "cd_cargo"], "t")).count() == 2
    mixed = frame([(1, 6), (2, 6)], "nr_turno int, cd_cargo int")
    with pytest.raises(FAILURES, match="one value at a time"):
        mixed.filter(checks.single_value(mixed, ["nr_turno"], "t")).collect()


def test_vocabulary_rejects_unknown_and_null(frame):
    for bad in ("X", None):
        df = frame([("A",), (bad,)], "l string")
        with pytest.raises(FAILURES, match="unknown label"):
            df.select(checks.in_vocabulary(F.col("l"), ("A",), "t")).collect()


def test_required_columns(frame):
    with pytest.raises(ValueError, match="missing columns"):
        checks.require_columns(frame([(1,)], "a int"), ["a", "b"], "t")
    assert rows(frame([(1,)], "a int")) == [{"a": 1}]


def test_normalisation_covers_the_character_set(spark):
    import unicodedata

    chars = [chr(c) for c in (*range(0xA0, 0x3000), *range(0xF900, 0x10000), *range(0x1D400, 0x1D500)) if chr(c).isprintable() and unicodedata.category(chr(c))[0] != "M"]
    texts = ["".join(chars[i : i + 50]) for i in range(0, len(chars), 50)]
    for form in ("NFD", "NFKD"):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", text.strip_accents(F.col("t"), form).alias("s")).collect():
            want = "".join(c for c in unicodedata.normalize(form, r.t) if unicodedata.category(c)[0] != "M")
            assert r.s == want


@pytest.mark.parametrize("form", ["NFD", "NFKD"])
def test_folding_of_every_character(spark, form):
    import unicodedata

    codes = [c for c in [*range(0x20, 0x600), *range(0x1E00, 0x2100), *range(0xFB00, 0xFB07)] if unicodedata.category(chr(c))[0] not in "CM"]
    df = spark.createDataFrame([(c, f"a{chr(c)}b", chr(c)) for c in codes], "k int, inside string, alone string")
    for r in df.select("k", text.strip_accents(F.col("inside"), form).alias("i"), text.strip_accents(F.col("alone"), form).alias("a")).collect():
        bare = "".join(c for c in unicodedata.normalize(form, chr(r.k)) if unicodedata.category(c)[0] != "M")
        assert (r.i, r.a) == (f"a{bare}b", bare), hex(r.k)
