import pytest
from pyspark.sql import functions as F

from attriva.functions import composition as c

CASES = [
    ("<p>Состав: 79% хлопок 21% полиэстер</p>", ["79% 21% хлопок полиэстер"]), ("<div>Материал: 90% хлопок, 10% полиэстер</div>", ["90% хлопок, 10% полиэстер"]), ("<span>82% cotton, 18% polyester</span>", ["82% cotton, 18% polyester"]),
    ("<table>\n <tr><td>Состав изделия</td><td>Хлопок 68%, Лиоцелл 31%, Эластан 1%</td></tr>\n</table>", ["68% Хлопок, 31% Лиоцелл, 1% Эластан"]), ("<p>Fabric: 95% cotton, 5% elastane</p>", ["95% cotton, 5% elastane"]),
    ("<span>Composition: 100% polyester</span>", ["100% polyester"]), ("<p>Состав - 80% хлопок / 20% полиэстер</p>", ["80% хлопок, 20% полиэстер"]), ("<tr><th>Состав</th><td>79% хлопок, 21% полиэстер</td></tr><tr><th>Сезон</th><td>Демисезон</td></tr>", ["79% хлопок, 21% полиэстер"]),
    ("Состав: 95% хлопок, 5% эластан", ["95% хлопок, 5% эластан"]), ("<p>80% хлопок, 20% полиэстер — отличный выбор</p>", ["80% хлопок, 20% полиэстер"]), ("Состав: 95%ХЛОПОК\nСостав: 95% хлопок.", ["95% ХЛОПОК"]),
    ("<p>скидка 50% на все товары!</p>", []), ("<div>-50% на вторую вещь</div>", []), ("<p>100% оригинал. Гарантия подлинности.</p>", []), ("<span>рассрочка 0% на 12 месяцев</span>", []), ("<p>кэшбэк 5% при оплате картой</p>", []),
    ("<p>размер 50, стандартная посадка</p>", []), ("<p>Модный хлопок для летнего сезона.</p>", []), ("<div>50% off on selected items</div>", []), ("", []), (None, []), ("<p>скидка 30% хлопок</p>", []), ("<p>99.9% satisfaction guaranteed</p>", []),
    ("Состав: 10% хлопок", []), ("80% хлопок" + " " + "я" * 79 + " 20% лён", ["80% хлопок"]), ("80% хлопок, 20% лён" + "я" * 81 + "70% шёлк и 30% кожа" + "я" * 90, ["80% хлопок, 20% лён", "70% шёлк и 30% кожа"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(CASES)], "k int, html string")
    got = {r.k: r.c for r in df.select("k", c.compositions(F.col("html")).alias("c")).collect()}
    assert [(CASES[k][0], got[k]) for k in range(len(CASES))] == CASES


@pytest.mark.parametrize(("word", "name"), [("cotton", "хлопок"), ("spandex", "эластан"), ("NYLON", "полиамид"), ("tencel", "лиоцелл"), ("хлопок", "хлопок"), ("unknownfiber", "unknownfiber")])
def test_names(spark, word, name):
    assert spark.range(1).select(c.material_name(F.lit(word))).first()[0] == name


def test_the_main_material(spark):
    arrays = [["79% хлопок, 21% полиэстер"], ["82% cotton, 18% polyester"], [], ["хлопок"], ["40% лён", "60% шелка"], ["50% лён, 50% шёлк"]]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "k int, a array<string>")
    assert [r[0] for r in df.orderBy("k").select(c.main_material(F.col("a"))).collect()] == ["хлопок", "хлопок", None, None, "шёлк", "лён"]
