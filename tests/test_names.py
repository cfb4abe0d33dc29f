import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import names as N
from kinfold.functions.similarity import jaro_winkler_most, jaro_winkler_similarity


def values(spark, f, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_clean_agrees_with_full_decomposition(spark):
    rows = ["Müller & Söhne GmbH", "ÄÖÜß", "Société Générale", "Łódź Sp. z o.o.", "Česká spořitelna, a.s.", "Ελλάδα Ά", "Київ ї й", "  ", "", None, "A-1/b_2", "Ñandú ÇA"]
    assert values(spark, N.clean, rows) == [N.clean_text(v) for v in rows]
    assert N.clean_text("Müller & Söhne GmbH") == "muellersoehnegmbh" and N.clean_text("Łódź") == "łodz"


def test_company_and_authority_names(spark):
    rows = ["Acme Holdings S.A.", "ACME Holdings SA", "Acme, Ltd.", "ТОВ Ромашка", "Товариство з обмеженою відповідальністю Ромашка", "Foo S.A.R.L.", "Bar Sp. z o.o.", None]
    assert values(spark, N.company_name, rows) == ["ACME HOLDINGS", "ACME HOLDINGS", "ACME", "РОМАШКА", "РОМАШКА", "FOO", "BAR Z O O", None]
    assert values(spark, N.authority_name, ["City of  Ghent (BE)", ""]) == ["CITY OF GHENT BE", ""]
    assert values(spark, N.query_text, ['a+b "c" (d)/e']) == ["a b c d e"]


def test_identifiers(spark):
    assert values(spark, N.canon_lei, [" 529900t8bm49aursdo55 ", "short", None, ""]) == ["529900T8BM49AURSDO55", None, None, None]
    assert values(spark, N.canon_cik, ["0000123", "123", "0", "12a", "", None, "  "]) == ["123", "123", "0", None, None, None, "0"]
    assert values(spark, N.canon_vat, ["DE 123.456-789", "de123456789", "FR40303265045", "12345678901234", "1-2-3-4", "XX1", None]) == ["DE123456789", "DE123456789", "FR40303265045", None, None, None, None]
    assert values(spark, N.canon_siret, ["732 829 320 00074", "1"]) == ["73282932000074", None]
    assert values(spark, N.is_notice_id, ["12-3-4-5", "12-3", None]) == [True, False, False]


def test_countries_and_languages(spark):
    assert values(spark, N.normalize_country, ["deu", "DE", " Germany ", "EL", "UK", "united states of america", "XXX", "", None]) == ["DEU", "DEU", "DEU", "GRC", "GBR", "USA", None, None, None]
    assert values(spark, N.safe_lang, ["EN", "pt-BR", " de ", "xx", None]) == ["en", "pt", "de", None, None]
    df = spark.createDataFrame([("PL", "POL"), (None, "POL"), ("", "BEL"), (None, None), (None, "USA")], "l string, c string")
    assert [r[0] for r in df.select(N.source_lang(F.col("l"), F.col("c"))).collect()] == ["pl", "pl", "nl", "en", "en"]


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("SOCOTEC", "SOCOTEC CONSTRUCTION", 0.87), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert abs(jaro_winkler_similarity(a, b) - want) < 1e-6


def test_sql_names(spark):
    N.register(spark)
    assert spark.sql("SELECT jaro_winkler('MARTHA', 'MARHTA') AS j, clean_name('Ünal 1') AS c").first()[1] == "uenal1"


def test_bound_of_the_similarity_is_never_below_it():
    some = random.Random(3)
    texts = ["", "a", "\ud800x", "abcdefghij" * 30, *("".join(some.choices("abcé 一", k=some.randrange(12))) for _ in range(300))]
    left, right = [some.choice(texts) for _ in range(5000)], [some.choice(texts) for _ in range(5000)]
    most = jaro_winkler_most(left, right)
    exact = [jaro_winkler_similarity(a, b) for a, b in zip(left, right)]
    assert all(m >= x - 1e-12 for m, x in zip(most, exact)) and (most < 0.92).sum() > 1000
    assert jaro_winkler_most([], []).size == 0
