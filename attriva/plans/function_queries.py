"""Queries that run text, number and payload functions, fillers, routing rules and file formats over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, hashing, nested, numeric
from ..functions import text as t
from ..operators import fillers as g
from ..operators import joins as j
from ..operators import predicates as p
from ..sources import readers, sinks
from ..sources.folder import new_folder
from . import derived as d
from .queries import query

L, C = F.lit, F.col


def _parts(spark, sf_dir):
    return d.table(spark, sf_dir, "part").withColumn("id", C("p_partkey").cast("long")).withColumn("k", C("p_partkey")).withColumn("size", C("p_size").cast("string"))


_P = "p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey AS k, CAST(p_size AS VARCHAR) AS size, p_size, p_name, p_brand, p_type, p_retailprice, string_split(p_name, ' ')[1] AS one, string_split(p_name, ' ')[-1] AS two FROM part)"


@query(f"""WITH {_P}, n AS (SELECT *, CASE k % 6 WHEN 0 THEN 'Мощность, Вт' WHEN 1 THEN 'Бренд' WHEN 2 THEN 'Материал ' || p_name WHEN 3 THEN 'Страница' WHEN 4 THEN 'Артикул' ELSE 'Поле ' || p_name END AS name, p_size % 2 = 0 AS listed FROM p)
SELECT id, CASE WHEN listed THEN 'enum' WHEN k % 6 = 0 THEN 'numeric' WHEN k % 6 = 3 THEN 'url' WHEN k % 6 = 4 THEN 'model_name' ELSE 'text' END AS kind,
CASE WHEN k % 6 = 0 AND NOT listed THEN 'physical_magnitude' WHEN k % 6 = 1 THEN 'brand' WHEN k % 6 = 2 THEN 'material' ELSE 'classification' END AS leaf, CASE WHEN k % 6 = 0 THEN 'Вт' END AS unit FROM n""")
def q_target_routing(spark, sf_dir):
    """kind, leaf and unit of a field for each part."""
    k = C("k") % 6
    name = F.when(k == 0, "Мощность, Вт").when(k == 1, "Бренд").when(k == 2, F.concat(L("Материал "), "p_name")).when(k == 3, "Страница").when(k == 4, "Артикул").otherwise(F.concat(L("Поле "), "p_name"))
    rows = _parts(spark, sf_dir).withColumn("name", name).withColumn("kind", p.target_kind(C("name"), F.when(k == 3, "URL").otherwise("text"), C("p_size") % 2 == 0))
    return rows.select("id", "kind", p.target_leaf(C("name"), C("kind")).alias("leaf"), numeric.trailing_unit(C("name")).alias("unit"))


@query(f"""WITH {_P} SELECT id, lower(p_name) || 's' AS fuzzy_form, list_sort(regexp_extract_all('no ' || size || ' of ' || k % 7, '[0-9]+')) = list_sort(regexp_extract_all((k % 7) || ' ' || (p_size + k % 2), '[0-9]+')) AS same_digits,
round(5.0 / least(length(p_name), 8), 6) AS affinity, lower(p_name) || ' ' || lower(p_type) AS echo, p_name || '|' || p_type AS parts, contains(lower(p_name), 'blue') AS banned, substring('some text before ' || p_name || ' and behind', greatest(instr('some text before ' || p_name || ' and behind', two) - 5, 1), 15) AS around,
k % 2 = 0 AS spec, lower(p_name) || ' x' AS char_name, lower(p_brand) || ' ' || p_name AS search, length(two) >= 4 AS present, k % 3 = 0 AS empty, k % 5 = 0 AS placeholder, p_retailprice <= 1050 AS cheap, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN size || ' kg' ELSE 'лён' END AS gated,
CASE WHEN length(p_name || ' and more') > 15 THEN left(p_name || ' and more', 15) || '...' ELSE p_name || ' and more' END AS cut FROM p""")
def q_text_forms(spark, sf_dir):
    """T8, T9, T11 to T13, T16, T19, T20, T22, T23, T25 to T27, F8, F9, F37."""
    rows, k = _parts(spark, sf_dir), C("k")
    text, two = F.concat(L("some text before "), "p_name", L(" and behind")), F.element_at(F.split("p_name", " "), -1)
    none = L(None).cast("array<string>")
    return rows.select(
        "id", t.for_fuzzy(F.concat(F.upper("p_name"), L("’S"))).alias("fuzzy_form"), t.digits_agree(F.concat(L("no "), "size", L(" of "), (k % 7).cast("string")), F.concat((k % 7).cast("string"), L(" "), (C("p_size") + k % 2).cast("string"))).alias("same_digits"),
        F.round(fuzzy.score("stem_affinity", C("p_name"), F.concat(F.left("p_name", L(5)), L("ZZZ"))), 6).alias("affinity"), t.title_echo(F.concat(L(" -"), F.upper("p_name"), L(" ... "), "p_type", L("!"))).alias("echo"),
        F.array_join(t.split_values(F.concat("p_name", L("; "), F.upper("p_name"), L(", "), "p_type", L(" ;"))), "|").alias("parts"), t.banned(F.concat(L("Buy "), F.upper("p_name")), ("Blue",)).alias("banned"), t.window_around(text, two, 5, 10).alias("around"),
        t.spec_snippet(F.concat("size", F.when(k % 2 == 0, " mm").otherwise(" units"))).alias("spec"), t.char_name(F.concat(L("Тип  "), "p_name", L("-x")), ("тип",)).alias("char_name"), t.search_query(C("p_name"), C("p_brand")).alias("search"),
        t.category_in_title(F.concat(two, L("s")), C("p_name")).alias("present"), t.is_empty(F.when(k % 3 == 0, "  ").otherwise(C("p_name")), none).alias("empty"), t.is_placeholder(F.when(k % 5 == 0, " Нет ").otherwise(C("p_name"))).alias("placeholder"),
        p.within_budget(C("p_retailprice"), L(1500)).alias("cheap"), t.free_text_gate(F.when(k % 3 == 0, F.concat(L("ab/"), "size")).when(k % 3 == 1, F.concat("size", L(" kg"))).otherwise("Linen"), {"linen": "лён"}).alias("gated"), t.truncated(F.concat("p_name", L(" and more")), 15).alias("cut"),
    )


@query(f"""WITH {_P}, h AS (SELECT *, sha1('0123456789abcdef' || p_name) AS s FROM p)
SELECT id, CAST(40 + 2 * (p_size % 10) AS VARCHAR) AS size_word, k % 2 = 0 AS agrees, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || CASE WHEN s[17] IN ('0', '4', '8', 'c') THEN '8' WHEN s[17] IN ('1', '5', '9', 'd') THEN '9' WHEN s[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || s[18:20] || '-' || s[21:32] AS uuid,
CASE k % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.5 END AS sure, CASE WHEN k % 2 = 0 THEN CAST(1990 + p_size % 40 AS INT) END AS year, CASE WHEN p_size % 10 = 0 THEN CAST(p_size // 10 AS VARCHAR) ELSE (p_size // 10) || '.' || (p_size % 10) END AS kilos,
round(2.0 * p_size / (p_size * p_size + 1.0), 6) AS cosine, CASE WHEN p_size >= 25 THEN 'cotton' ELSE 'wool' END AS material, CASE WHEN p_size < 3 THEN '' ELSE '44|46|48' END AS sizes FROM h""")
def q_number_forms(spark, sf_dir):
    """N2, N6, N7, N10, N11, N15, N16, N18, D1, A25."""
    rows, k, size = _parts(spark, sf_dir), C("k"), C("p_size")
    share = F.when(size >= 25, 60).otherwise(40)
    own = F.struct(F.array(L("S"), L("44-46")).alias("details"), L("S").alias("tech_size")), F.struct(F.array(L("M")).alias("details"), L("48").alias("tech_size"))
    table = F.when(size < 3, F.array(own[0]).cast("array<struct<details:array<string>,tech_size:string>>")).otherwise(F.array(*own))
    return rows.select(
        "id", numeric.size_from_text(F.concat(L("Куртка, размер "), (40 + 2 * (size % 10)).cast("string"))).alias("size_word"), numeric.leading_number_agrees(F.concat("size", L(" кг")), F.concat("size", F.when(k % 2 == 0, ",0 Кг").otherwise(" г"))).alias("agrees"),
        hashing.stable_uuid(b"0123456789abcdef", C("p_name")).alias("uuid"), numeric.word_confidence(F.when(k % 4 == 0, " High").when(k % 4 == 1, "medium").when(k % 4 == 2, "LOW").otherwise("?")).alias("sure"),
        numeric.year_of(F.concat(L("от "), F.when(k % 2 == 0, (1990 + size % 40).cast("string")).otherwise("19999"), L(" года"))).alias("year"), numeric.spec_number(L("Вес, кг"), F.concat((size * 100).cast("string"), L(" g"))).alias("kilos"),
        F.round(numeric.cosine(F.array(size.cast("double"), L(1.0)), F.array(L(1.0), size.cast("double"))), 6).alias("cosine"), numeric.majority_material(numeric.composition(F.concat(share.cast("string"), L("% Cotton, "), (100 - share).cast("string"), L("% wool")))).alias("material"),
        F.array_join(F.when(size < 3, F.array().cast("array<string>")).otherwise(numeric.card_sizes(F.array(L("INT"), L("ru")), table)), "|").alias("sizes"),
    )


@query(f"""WITH {_P} SELECT id, CASE k % 3 WHEN 0 THEN p_type ELSE p_name END AS picked, '{{"a":"' || p_name || '"}}' AS kept, p_name || ' | ' || p_type AS joined, CASE WHEN k % 2 = 0 THEN p_name ELSE p_type END AS first, p_name AS option, CASE WHEN k % 2 = 0 THEN 'cotton ' || size || '%, wool' END AS fabric FROM p""")
def q_payload_forms(spark, sf_dir):
    """Languages, kept keys, joined and first values, options of a card."""
    rows, k = _parts(spark, sf_dir), C("k")
    word = lambda lang, c: F.struct(L(lang).alias("lang"), C(c).alias("text"))
    texts = F.when(k % 3 == 0, F.array(word("en", "p_name"), word("ru", "p_type"))).when(k % 3 == 1, F.array(word("de", "p_name"), word("fr", "p_type"))).otherwise(F.array(word("fr", "p_type"), word("en", "p_name")))
    option = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    fabric = F.when(k % 2 == 0, F.array(F.struct(L("cotton").alias("name"), C("p_size").alias("percent")), F.struct(L("wool").alias("name"), L(None).cast("int").alias("percent"))))
    options = nested.option_map(F.array(option(L("Цвет"), C("p_type")), option(L(" Цвет "), F.concat(L(" "), "p_name")), option(L(""), L("x")), option(L("y"), L(None).cast("string"))), fabric)
    return rows.select(
        "id", nested.pick_language(texts).alias("picked"), F.to_json(nested.keep_keys(F.create_map(L("a"), "p_name", L("b"), "p_type", L("c"), L(None).cast("string")), ("a", "c"))).alias("kept"), nested.joined(F.array("p_name", L(""), L(None).cast("string"), "p_type", "p_brand"), 2).alias("joined"),
        nested.first_present(L(None).cast("string"), L("  "), F.when(k % 2 == 0, C("p_name")), C("p_type")).alias("first"), options["Цвет"].alias("option"), options["Состав"].alias("fabric"),
    )


@query(f"""WITH {_P} SELECT id, CAST(k % 12 AS BIGINT) AS attribute_id, CASE k % 12 WHEN 0 THEN upper(p_brand) WHEN 1 THEN 'чёрный' WHEN 2 THEN 'Куртка' WHEN 3 THEN CAST(40 + 2 * (p_size % 10) AS VARCHAR) WHEN 4 THEN p_name WHEN 5 THEN p_name WHEN 6 THEN size || '.5' WHEN 7 THEN 'Да' WHEN 8 THEN p_name WHEN 9 THEN 'Женский' WHEN 10 THEN two ELSE p_type END AS value FROM p
WHERE k % 12 IN (0, 2, 3, 4, 5, 6, 8, 10, 11) OR (k % 12 IN (1, 7, 9) AND p_size % 2 = 0)""")
def q_fillers(spark, sf_dir):
    """Each part has one empty target that one filler fills or leaves."""
    rows, k, even = _parts(spark, sf_dir), C("k") % 12, C("p_size") % 2 == 0
    two = F.element_at(F.split("p_name", " "), -1)
    wide = rows.select(
        C("id").alias("product_id"), k.cast("long").alias("attribute_id"), F.when(k == 4, "Наименование").when(k == 11, "warranty").otherwise("x").alias("target_name"), C("p_brand").alias("brand"),
        F.when(k == 0, F.array(L("other"), F.upper("p_brand"))).when(k == 1, F.array(L("чёрный"), L("белый"))).when(k == 2, F.array(L("Куртка"), L("Шорты"))).when(k == 3, F.array(*[L(str(x)) for x in range(40, 60, 2)])).when(k == 10, F.array(two, L("zzz"), L("ab"))).alias("allowed_values"),
        F.when(k == 1, F.when(even, "Кеды чёрные").otherwise("Кеды черно-белые")).when(k == 3, F.concat(L("Футболка размер "), (40 + 2 * (C("p_size") % 10)).cast("string"))).when(k == 5, F.concat(F.lower("p_brand"), L(" "), "p_name")).when(k == 9, F.when(even, "Куртка женская").otherwise("Куртка")).otherwise(C("p_name")).alias("product_name"),
        L("Куртки").alias("category_leaf"), F.when(k == 6, F.concat(L("Максимальная мощность до "), "size", L(",5 Вт; x"))).when(k == 7, F.when(even, "Имеет подсветку").otherwise("Без подсветки")).when(k == 8, F.concat(L("Комплектация: "), "p_name", L(". Ещё"))).otherwise("").alias("text"),
        F.when(k == 6, "мощность").otherwise("подсвет").alias("keyword"), L("вт").alias("unit"), L(True).alias("is_required"), L(None).cast("string").alias("value_str"),
    )
    own = lambda n: wide.where(C("attribute_id") == n)
    alias = own(11).unionByName(own(11).withColumns({"attribute_id": L(99).cast("long"), "target_name": L("Гарантия")}).join(rows.select(C("id").alias("product_id"), C("p_type").alias("_v")), "product_id").withColumn("value_str", C("_v")).drop("_v"))
    made = [g.brand_from_context(own(0)), g.color_from_name(own(1)), g.type_from_category(own(2)), g.size_from_name(own(3)), g.title_echo(own(4)), g.model_from_title(own(5)), g.number_from_text(own(6)), g.stated_boolean(own(7)), g.kit_contents(own(8)), g.gender_fallback(own(9)), g.spec_from_title(own(10)), g.cross_fill(alias, ("warranty", "гарантия"))]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.select(C("product_id").alias("id"), "attribute_id", C("value_str").alias("value"))


@query(f"""WITH {_P}, e AS (SELECT DISTINCT p_brand || '__' || p_type AS entry, p_type AS kind, p_size % 3 AS field, 'to ' || p_brand AS mapped FROM part),
s AS (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN p_brand ELSE 'unknown' END AS subject, p_type AS kind FROM p),
m AS (SELECT s.subject, s.kind, e.field, e.mapped, e.entry, CASE WHEN e.entry = s.subject || '__' || s.kind THEN 0 ELSE 1 END AS r FROM s JOIN e ON e.kind = s.kind)
SELECT subject, kind, CAST(field AS INT) AS field, mapped FROM m QUALIFY row_number() OVER (PARTITION BY subject, kind, field ORDER BY r, entry) = 1""")
def q_field_map(spark, sf_dir):
    """Fields of a subject by its own entry, else by the entries that end in its kind."""
    parts = d.table(spark, sf_dir, "part")
    fields = parts.select(F.concat_ws("__", "p_brand", "p_type").alias("entry"), (C("p_size") % 3).alias("field"), F.concat(L("to "), "p_brand").alias("mapped")).distinct()
    subjects = parts.select(F.when(C("p_partkey") % 2 == 0, C("p_brand")).otherwise("unknown").alias("subject"), C("p_type").alias("kind")).distinct()
    return j.resolve_fields(subjects, fields).select("subject", "kind", C("field").cast("int").alias("field"), "mapped")


@query(f"""WITH {_P}, o AS (SELECT *, CASE k % 4 WHEN 0 THEN '6109100010' WHEN 1 THEN upper(one) || '-' || two WHEN 2 THEN p_name ELSE 'qqqqqq' END AS target, CASE k % 4 WHEN 0 THEN '6109100000 - ' || p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || 'x' ELSE p_name END AS option FROM p)
SELECT id, CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN 200.0 * length(p_name) / (2 * length(p_name) + 1) >= 90 THEN 2 END END AS rule FROM o""")
def q_option_rules(spark, sf_dir):
    """By which of the legacy rules an option matches."""
    k, one, two = C("k") % 4, F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1)
    target = F.when(k == 0, "6109100010").when(k == 1, F.concat(F.upper(one), L("-"), two)).when(k == 2, C("p_name")).otherwise("qqqqqq")
    option = F.when(k == 0, F.concat(L("6109100000 - "), "p_name")).when(k == 2, F.concat("p_name", L("x"))).otherwise(C("p_name"))
    return _parts(spark, sf_dir).select("id", F.floor(j.match_option(target, option)).cast("int").alias("rule"))


@query("""SELECT format, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys, count(DISTINCT p_name) AS names FROM part, (VALUES ('csv.gz'), ('json.gz'), ('audit'), ('log'), ('parquet'), ('drift'), ('tree')) AS f(format) GROUP BY format""")
def q_file_formats(spark, sf_dir):
    """All parts through every file format and back."""
    parts = d.table(spark, sf_dir, "part").select(C("p_partkey").cast("long").alias("p_partkey"), "p_name", F.array("p_brand", "p_type").alias("urls"))
    at, schema = new_folder(spark, "formats"), "p_partkey long, p_name string"
    plain = parts.select("p_partkey", "p_name")
    plain.write.option("header", True).option("compression", "gzip").csv(f"{at}/csv")
    plain.write.option("compression", "gzip").json(f"{at}/json")
    sinks.audit_csv(parts, f"{at}/audit")
    sinks.json_log(plain, f"{at}/log")
    sinks.sharded_parquet(plain, f"{at}/parquet", 700)
    plain.where("p_partkey % 2 = 0").write.parquet(f"{at}/drift/a")
    plain.where("p_partkey % 2 = 1").withColumn("more", L(1)).write.parquet(f"{at}/drift/b")
    plain.groupBy((C("p_partkey") % 7).alias("file")).agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("parts")).select(F.to_json(F.struct("parts")).alias("value")).write.text(f"{at}/tree")
    read = {
        "csv.gz": readers.delimited(spark, f"{at}/csv"), "json.gz": readers.json_lines(spark, f"{at}/json", schema), "audit": readers.delimited(spark, f"{at}/audit"), "log": readers.json_lines(spark, f"{at}/log", schema),
        "parquet": spark.read.parquet(f"{at}/parquet"), "drift": readers.parquet(spark, f"{at}/drift/*", {"p_partkey": "long", "p_name": "string", "more": "int", "none": "string"}),
        "tree": readers.json_lines(spark, f"{at}/tree", "parts array<struct<p_partkey:long,p_name:string>>").select(F.explode("parts").alias("x")).select("x.*"),
    }
    out = None
    for name, rows in read.items():
        own = rows.agg(F.count(L(1)).alias("n"), F.sum(C("p_partkey").cast("long")).alias("keys"), F.countDistinct("p_name").alias("names")).select(L(name).alias("format"), "n", "keys", "names")
        out = own if out is None else out.unionByName(own)
    return out
