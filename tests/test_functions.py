"""Scalar functions, by tables of cases."""

import pytest
from pyspark.sql import functions as F

from attriva.functions import fuzzy, hashing, nested, numeric
from attriva.functions import text as t
from attriva.operators import predicates as p


def ask(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


L = F.lit


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: t.for_corroboration(L("  Yes ")), "да"),
        (lambda: t.for_corroboration(L("Ёлка   зелёная")), "елка зеленая"),
        (lambda: t.for_corroboration(L("0")), "нет"),
        (lambda: t.color_stem(L("Чёрные")), "черн"),
        (lambda: t.color_stem(L("синий")), "син"),
        (lambda: t.color_stem(L("ой")), "ой"),
        (lambda: t.strong_token(L("Fully-Modular")), "полностью модульный"),
        (lambda: t.strong_token(L("black"), {"black": "чёрный"}), "черный"),
        (lambda: t.without_parens(L("OCP (защита)")), "OCP"),
        (lambda: t.without_pixels(L("2712x1220 pixels")), "2712x1220"),
        (lambda: t.without_pixels(L("54 мм")), None),
        (lambda: t.unwrap_list(L("['a', 'b']")), ["a", "b"]),
        (lambda: t.unwrap_list(L("a")), ["a"]),
        (lambda: t.split_values(L("Red; red, blue")), ["Red", "blue"]),
        (lambda: t.digits_agree(L("240 V"), L("v 240")), True),
        (lambda: t.digits_agree(L("240 V"), L("24")), False),
        (lambda: t.digits_agree(L("black"), L("24")), True),
        (lambda: t.gender_form(L("Для девочек")), "Девочки"),
        (lambda: t.gender_signal(L("Куртка мужская")), "male"),
        (lambda: t.gender_signal(L("Куртка")), None),
        (lambda: t.phrase_in(F.array(L("north"), L("face")), F.array(L("the"), L("north"), L("face"))), True),
        (lambda: t.phrase_in(F.array(L("nort")), F.array(L("north"))), False),
        (lambda: t.phrase_start(F.array(L("face")), F.array(L("the"), L("north"), L("face"))), 2),
        (lambda: t.phrase_start(F.array(L("foot")), F.array(L("the"))), None),
        (lambda: t.model_tokens(L("Bosch GSR-120 li 5")), ["gsr-120"]),
        (lambda: t.html_to_text(L("<p>a&nbsp;<b>b</b></p><script>x</script>")), "a b"),
        (lambda: t.host(L("https://www.Example.org/x")), "example.org"),
        (lambda: t.is_vague(L("Feature_3")), True),
        (lambda: t.is_vague(L("Материал")), False),
        (lambda: t.is_empty(L(None).cast("string"), F.array(L(" "))), True),
        (lambda: t.is_empty(L("a"), L(None).cast("array<string>")), False),
        (lambda: t.is_placeholder(L(" Н/Д ")), False),
        (lambda: t.is_placeholder(L(" Нет ")), True),
        (lambda: t.pairs_from_dl(L("<dl><dt>Вес</dt><dd>5 кг</dd></dl>")), [("Вес", "5 кг")]),
        (lambda: t.json_island(L('<script type="application/ld+json">{"a":1}</script>')), '{"a":1}'),
        (lambda: t.truncated(L("abcdef"), 3), "abc..."),
        (lambda: numeric.to_field_unit(L("Ширина профиля, мм"), L("5.4 см")), "54"),
        (lambda: numeric.to_field_unit(L("Ширина, мм"), L("5-7 см")), "5-7 см"),
        (lambda: numeric.to_field_unit(L("Вес, кг"), L("500 г")), "0.5"),
        (lambda: numeric.to_field_unit(L("Вес, кг"), L("5 см")), "5 см"),
        (lambda: numeric.to_field_unit(L("Вес"), L("5 г")), "5 г"),
        (lambda: numeric.trailing_unit(L("Скорость, об/мин")), "об/мин"),
        (lambda: numeric.check_digit_ok(L("4006381333931")), True),
        (lambda: numeric.check_digit_ok(L("4006381333932")), False),
        (lambda: numeric.check_digit_ok(L("73513537")), True),
        (lambda: numeric.check_digit_ok(L("12")), False),
        (lambda: numeric.barcodes(L("a 73513537 b 123456789 73513537")), ["73513537"]),
        (lambda: numeric.sizes(L("42-44")), ["42", "44"]),
        (lambda: numeric.sizes(L("S")), ["42", "44"]),
        (lambda: numeric.size_from_text(L("Платье размер 46 синее")), "46"),
        (lambda: numeric.leading_number_agrees(L("5,0 мм"), L("5.0 мм")), True),
        (lambda: numeric.majority_material(numeric.composition(L("95% хлопок, 5% эластан"))), "хлопок"),
        (lambda: numeric.majority_material(numeric.composition(L("хлопок 10%"))), None),
        (lambda: numeric.number_in_text(numeric.equivalents(L("1.25")), L("болт 1 1/4 дюйма")), True),
        (lambda: numeric.number_in_text(numeric.equivalents(L("5")), L("15 штук")), True),
        (lambda: numeric.word_confidence(L("High")), 0.9),
        (lambda: numeric.year_of(L("от 12.03.2021 г.")), 2021),
        (lambda: F.round(numeric.cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(1.0))), 4), 0.7071),
        (lambda: numeric.cosine(F.array(L(0.0)), F.array(L(1.0))), None),
        (lambda: hashing.description_hash(L("")), "empty"),
        (lambda: hashing.description_hash(L("Red <b>iPhone</b>")) == hashing.description_hash(L("iphone, red")), True),
        (lambda: hashing.product_hash(L(" Drill ")) == F.left(F.sha1(L("drill")), L(16)), True),
        (lambda: hashing.stable_uuid(bytes.fromhex("6ba7b8109dad11d180b400c04fd430c8"), L("python.org")), "886313e1-3b8a-5372-9b90-0c9aee199e5d"),
        (lambda: nested.attribute_value(nested.characteristics(L('{"Net Weight":["5","6"]}')), L("net_weight")), "5"),
        (lambda: nested.attribute_value(nested.characteristics(L("{broken")), L("a")), None),
        (lambda: nested.joined(F.array(L("a"), L(""), L("b"))), "a | b"),
        (lambda: nested.first_present(L(" "), L("x")), "x"),
        (lambda: F.round(fuzzy.score("ratio", L("abcd"), L("abce")), 1), 75.0),
        (lambda: fuzzy.score("token_set_ratio", L("nike air max"), L("air nike")), 100.0),
        (lambda: fuzzy.score("partial_ratio", L("air"), L("nike air max")), 100.0),
        (lambda: fuzzy.score("stem_affinity", L("хлопковый"), L("хлопок")), 4 / 6),
        (lambda: p.target_kind(L("Артикул"), L("text"), L(False)), "model_name"),
        (lambda: p.target_kind(L("Длина, см"), L("text"), L(False)), "dimensions"),
        (lambda: p.target_kind(L("Ссылка"), L("URL"), L(False)), "url"),
        (lambda: p.target_leaf(L("Объём памяти, ГБ"), L("numeric")), "capacity"),
        (lambda: p.target_leaf(L("Бренд"), L("text")), "brand"),
        (lambda: p.grounded(L("Бязь"), L("100% хлопок")), False),
        (lambda: p.grounded(L("да"), L("100% хлопок")), True),
        (lambda: p.is_palette(L("белый/синий"), L(None).cast("array<string>"), L(None).cast("array<bigint>")), True),
        (lambda: p.looks_blocked(L("Please solve the CAPTCHA")), True),
        (lambda: p.looks_like_markup(L("a{b}c<d>")), True),
        (lambda: p.model_conflict(L("GSR120"), L("GSR121")), True),
    ],
)
def test_case(spark, make, want):
    got = ask(spark, make())
    if isinstance(got, list) and got and not isinstance(got[0], str):
        got = [tuple(x) for x in got]
    assert got == want if not isinstance(want, float) else got == pytest.approx(want)
