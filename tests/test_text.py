import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entities


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.clean_text, {None: "", "  A-b,C  d": "a b c d", "Café n° 5!": "café n° 5", "[x]{y}`z\\": "x y z"}),
        (lambda x: T.leet(T.clean_text(x)), {"c0ffee": "coffee", "g00gle": "g00gle", "b0b0b": "b0b0b", "Phoenix": "foenix", "h1ll 5 s3a": "hlll 5 sea"}),
        (lambda x: T.strip_affixes(T.leet(T.clean_text(x))), {"Group": "", "The Golden C0ffee Pvt. Ltd.": "golden coffee", "Dr The X & Co": "the x", "École Sàrl SARL": "école sàrl"}),
        (lambda x: T.standard_country(T.clean_text(x)), {"United States of America": "us of us", "U.S.A.": "us", "England": "gb", "République": "république", "IND": "in"}),
        (T.first_digits, {"Flat 5, 10 Rue": "5", None: "", "no": "", "१२ x": "१२"}),
        (T.postal_code, {"12 rue 75002": "75002", "1234567": "", "a 123456 b": "123456"}),
        (lambda x: T.unit_code(T.clean_text(x)), {"Suite 400": "400", "Flat 5b": "", "Shop12": "12"}),
        (lambda x: T.address_core(T.standard_address(T.clean_text(x))), {"12 rue x 75002": "12 rue x 75002", "10 Main Street, Floor 3": "10 main 3", "5 allée verte": "5 allee verte", "no 5 av foch": "5 foch"}),
        (T.letter_code, {"Ashcraft": "a226", "école": "", "": "", "Tymczak": "t522", "a": "a000", "bob": "b100"}),
        (T.consonants, {"yogi": "yg", "aeiou": "", "Strasse": "str"}),
        (T.sorted_letters, {"ab": "", "zebra": "berz", "a1 b": "", "cab": "abc"}),
        (T.sorted_tokens, {"b a": "a b", "": ""}),
        (T.acronym, {"blue bottle": "bb", "": ""}),
        (lambda x: T.clean_name(T.clean_field(x)), {"Starbucks Coffee Inc.": "starbucks coffee", "Café de Paris SARL": "cafe de paris", "A Limited Liability Company": "a", None: ""}),
        (lambda x: T.clean_address(T.clean_field(x)), {"410 Terry Avenue North, Suite 2": "410 terry ave n ste 2"}),
        (T.clean_phone, {"+1 (206) 555-0199": "2065550199", "01.42": "0142", None: ""}),
        (T.all_digits, {"123 main 9a 98101": "123 98101", "": ""}),
        (T.first_two_tokens, {"a blue bottle shop": "blue bottle", "x": ""}),
        (T.standard_soundex, {"": "", "robert": "R163"}),
        (T.metaphone_key, {"physics": "FSKS", "": "", "school": "SKL", "knee wrap": "NRP", "judge": "JJ", "thumb": "0M", "xerox": "SRKS"}),
    ],
)
def test_functions(spark, f, cases):
    assert dict(zip(cases, one(spark, f, *cases), strict=True)) == cases


def test_second_engine_table(spark):
    rows = [("1", "Starbucks Coffee Inc.", "123 Main Street, Suite 400", "Seattle", "WA", "98101", "United States", "+1 (206) 555-0199"), ("2", "Café de Paris SARL", "10 Rue de la Paix", "Paris", "", "75002", "France", "01.42.68.55.00")]
    df = spark.createDataFrame(rows, "id string, name string, address string, city string, state string, zip string, country string, phone string")
    got = {r.id: r for r in entities.clean(df, "s").collect()}
    assert [got[i].clean_name for i in "12"] == ["starbucks coffee", "cafe de paris"]
    assert got["1"].clean_full_address == "123 main st ste 400 seattle wa 98101" and got["1"].street_digits_str == "123 400 98101"
    assert got["2"].clean_full_address == "10 rue de la paix paris  75002" and got["2"].clean_phone == "0142685500"
    assert got["1"].source == "s" and got["1"].name_first_tokens == "starbucks coffee"


def test_missing_columns(spark):
    r = entities.clean(spark.createDataFrame([("x", None)], "key string, name string")).first()
    assert (r.id, r.clean_name, r.clean_phone, r.clean_full_address, r.street_digits_str, r.meta_key) == ("x", "", "", "", "", "")
    e = entities.enrich(spark.createDataFrame([("x", None)], "key string, business_name string")).first()
    assert e.id == "x" and e.name_root == "" and e.soundex_first == "" and e.country_std == ""
