import re
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderloom.functions import identity, numbers
from tenderloom.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def many(spark, values, f):
    return [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_and_dates(spark):
    assert many(spark, ["  a  b​\x07c ", "ﬁne ①", None, ""], t.clean) == ["a bc" if False else "a b c", "fine 1", "", ""]
    assert many(spark, ["янв.79", "10.июн x", "сен", "12.5"], t.repair_dates) == ["1.79", "10.6 x", "сен", "12.5"]


def test_tax_numbers(spark):
    assert many(spark, ["7707083893", "7707083894", "0000000000", "", None, "500100732259", "7707 083 893"], t.inn) == ["7707083893", None, None, None, None, "500100732259", "7707083893"]
    assert many(spark, ["ИНН: 7707083893, КПП 770701001", "инн 123"], t.labelled_inns) == [["7707083893"], []]


def weighed(digits, weights):
    return sum(int(d) * w for d, w in zip(digits, weights, strict=False)) % 11 % 10


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789", min_size=10, max_size=10), min_size=20, max_size=40))
def test_check_digit_property(spark, values):
    want = [weighed(v[:9], t.INN_10) == int(v[9]) and len(set(v)) > 1 for v in values]
    assert many(spark, values, t.is_inn) == want


def test_quantities(spark):
    def q(c):
        r = t.quantity(c)
        return F.concat_ws(" ", r["value"].cast("double").cast("string"), r["unit"])

    assert many(spark, ["кабель 10 м", "5 шт и 1 200 кг", "0 шт", "a 3,5 л.", "х10шт", "2 кв. м плитки", None], q) == ["10.0 м", "1200.0 кг", "", "3.5 л", "", "2.0 м2", ""]


def test_requests(spark):
    got = one(spark, "1. Кабель 10 м, труба 2 шт; доставка до склада\n- болт 22.40.11", lambda c: F.transform(t.interpret(c), lambda i: F.concat_ws("|", i["name"], i["okpd2"])))
    assert got == ["Кабель|", "Труба|", "Болт|22.40.11"]
    assert one(spark, "срок поставки", lambda c: F.size(t.interpret(c))) == 1
    assert one(spark, "- болт\n- гайка 3 шт", lambda c: F.transform(t.interpret(c), lambda i: i["name"])) == ["Болт", "Гайка"]


def test_stems_and_sequences(spark):
    assert many(spark, ["насосами", "Ёлки", "мы", None], t.stem) == ["насос", "елки", "мы", None]
    row = spark.createDataFrame([(["a", "b", "c"], ["b", "c"], ["c", "b"], [])], "h array<string>, n array<string>, m array<string>, e array<string>")
    r = row.select(t.find_sequence(F.col("h"), F.col("n")), t.find_sequence(F.col("h"), F.col("m")), t.find_sequence(F.col("h"), F.col("e"))).first()
    assert list(r) == [1, -1, -1]


def test_masking(spark):
    got = one(spark, "GET https://user:pw@h.ru/x?k=1 token = abc  mail a.b@c.org", t.mask_secrets)
    assert got == "GET https://***@h.ru/x token=*** mail ***" or "pw" not in got and "abc" not in got and "a.b" not in got
    assert len(one(spark, "x" * 500, t.mask_secrets)) == 240


def test_html(spark):
    html = "<title> A\n B </title><script>var a='<p>'</script><p>x &amp; y</p><a href='/u'>u</a><a class=\"k\" href=\"/u\">u</a><!-- c -->"
    assert one(spark, html, t.title) == "A B"
    assert one(spark, html, t.visible_text) == "A B x & y u u"
    assert one(spark, html, t.links) == ["/u"]


def test_identifiers(spark):
    ns = str(uuid.NAMESPACE_URL)
    values = ["a", "supplier:inn|7707083893", "ё", ""]
    assert many(spark, values, lambda c: identity.uuid5(ns, c)) == [str(uuid.uuid5(uuid.NAMESPACE_URL, v)) for v in values]
    prints = many(spark, ["Кабель ВВГ-3х2,5", "кабель  ввг 3Х2.5!"], identity.name_fingerprint)
    assert prints[0] == prints[1] and re.fullmatch("[0-9a-f]{12}", prints[0])
    df = spark.createDataFrame([("k", "u", "n"), ("", "u", ""), ("", "u", "n"), ("", "", "n")], "a string, u string, n string")
    got = [r[0] for r in df.select(identity.external_id(F.col("a"), F.col("u"), F.col("n"))).collect()]
    assert got[:2] == ["k", "u"] and got[2].startswith("u#") and got[3] is None


def test_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (-1.0,), (0.4,), (7.0,), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.clamp(F.col("x"))).collect()] == [0.0, 0.0, 0.4, 1.0, 0.0]
    assert many(spark, ["1 200,50", "-3", "x"], lambda c: numbers.decimal_of(c).cast("double")) == [1200.5, None, None]
    row = spark.sql("SELECT 2BD p, '166' b, '163' c, 0.001BD f, null k")
    price, unit = numbers.unit_price(*[F.col(c).cast("decimal(18,4)") if c in "pfk" else F.col(c) for c in "pbcfk"])
    assert list(row.select(price.cast("double"), unit).first()) == [2000.0, "166"]


def test_export_cells(spark):
    assert many(spark, ["=1+1", 'a;"b"', None, "ok"], t.csv_cell) == ["'=1+1", '"a;""b"""', "", "ok"]
