"""The catalogue of queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import fuzzy, hashing, nested, numeric
from ..functions import text as t
from ..operators import aggregates as a
from ..operators import fillers as g
from ..operators import joins as j
from ..operators import predicates as p
from ..operators import reports as r
from ..operators import windows as w
from ..sources import readers, sinks
from ..streaming import events as ev
from . import derived as d
from .finalize import cascade, finalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ["product_id", "attribute_id"]
ROW = ["product_id", "attribute_id", "seq"]
CAND, TARG, SEQ = d.candidates_sql(), d.targets_sql(), d.SEQ


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _picked(order: str, where: str = "") -> str:
    return f"""WITH {CAND}, ranked AS (SELECT c.*, row_number() OVER (PARTITION BY product_id, attribute_id ORDER BY {order}, {SEQ}) AS rn
FROM candidates c JOIN src USING (source) {where}) SELECT product_id, attribute_id, source, value_str, confidence FROM ranked WHERE rn = 1"""


@query(_picked("priority DESC, length(evidence) DESC"))
def q_priority_merge(spark, sf_dir):
    """A1."""
    return a.priority_merge(d.candidates(spark, sf_dir), KEYS).select(*KEYS, "source", "value_str", "confidence")


@query(_picked("confidence DESC", "WHERE confidence >= 0.85"))
def q_high_conf_merge(spark, sf_dir):
    """A4."""
    return a.high_confidence_merge(d.candidates(spark, sf_dir), KEYS).select(*KEYS, "source", "value_str", "confidence")


@query(_picked("confidence DESC, coalesce(legacy, 99)"))
def q_legacy_merge(spark, sf_dir):
    """A5."""
    return a.legacy_merge(d.candidates(spark, sf_dir), KEYS).select(*KEYS, "source", "value_str", "confidence")


_BOOST = f"""el AS (SELECT product_id, attribute_id, {SEQ}, source, unnest(CASE WHEN is_list THEN list_transform(value_arr, lambda x: lower(x)) ELSE [lower(value_str)] END) AS e FROM candidates),
votes AS (SELECT product_id, attribute_id, e FROM el GROUP BY ALL HAVING count(DISTINCT source) >= 2),
backed AS (SELECT DISTINCT product_id, attribute_id, {SEQ} FROM el JOIN votes USING (product_id, attribute_id, e)),
boosted AS (SELECT c.* REPLACE (CASE WHEN b.l_orderkey IS NOT NULL AND c.confidence < 0.97 THEN least(CAST(0.97 AS DOUBLE), c.confidence + CAST(0.10 AS DOUBLE)) ELSE c.confidence END AS confidence)
  FROM candidates c LEFT JOIN backed b USING (product_id, attribute_id, {SEQ}))"""


@query(f"WITH {CAND}, {_BOOST} SELECT product_id, attribute_id, source, count(*) AS n, round(sum(confidence), 6) AS total FROM boosted GROUP BY ALL")
def q_consensus_boost(spark, sf_dir):
    """A2."""
    out = a.consensus_boost(d.candidates(spark, sf_dir), KEYS)
    return out.groupBy(*KEYS, "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("total"))


_CALM = ["description", "vision", "ugc", "lamoda", "yandex_market"]


@query(f"""WITH {d.candidates_sql(_CALM)}, lists AS (SELECT *, row_number() OVER (PARTITION BY product_id, attribute_id ORDER BY {SEQ}) AS rn FROM candidates),
el AS (SELECT product_id, attribute_id, rn, unnest(CASE WHEN is_list THEN value_arr ELSE [value_str] END) AS v, generate_subscripts(CASE WHEN is_list THEN value_arr ELSE [value_str] END, 1) AS k FROM lists),
firsts AS (SELECT product_id, attribute_id, lower(v) AS lv, arg_min(v, rn * 10 + k) AS v, min(rn * 10 + k) AS place FROM el GROUP BY ALL),
vals AS (SELECT product_id, attribute_id, array_to_string(list(v ORDER BY place), '|') AS joined_values FROM firsts GROUP BY ALL),
top AS (SELECT product_id, attribute_id, confidence, source, row_number() OVER (PARTITION BY product_id, attribute_id ORDER BY confidence DESC, rn) AS r2 FROM lists)
SELECT product_id, attribute_id, joined_values, confidence, source FROM vals JOIN top USING (product_id, attribute_id) WHERE r2 = 1""")
def q_collection_union(spark, sf_dir):
    """Union of values in order, for sources that do not bar each other."""
    out = a.collection_union(d.candidates(spark, sf_dir, _CALM), KEYS)
    return out.select(*KEYS, F.array_join("value_arr", "|").alias("joined_values"), "confidence", "source")


@query()
def q_collection_fold(spark, sf_dir):
    """A3 with all sources: the fold protects cards; tested against a plain fold."""
    out = a.collection_union(d.candidates(spark, sf_dir), KEYS)
    return out.select(*KEYS, F.array_join("value_arr", "|").alias("joined_values"), F.array_join(F.transform("value_ids", lambda x: x.cast("string")), "|").alias("joined_ids"), "confidence", "source")


@query(f"""WITH {CAND}, n AS (SELECT *, count(*) OVER (PARTITION BY product_id, attribute_id) AS k FROM candidates)
SELECT product_id, attribute_id, source, count(*) AS n FROM n WHERE NOT (source = 'llm_knowledge' AND is_collection AND k = 1) GROUP BY ALL""")
def q_abstain_sole(spark, sf_dir):
    """F21."""
    return p.abstain_lone_guesses(d.candidates(spark, sf_dir), KEYS).groupBy(*KEYS, "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CAND}, {TARG}, c AS (SELECT c.* EXCLUDE (semantic_type), target_name, t.type, t.semantic_type, lower(value_str) AS nv FROM candidates c JOIN targets t USING (attribute_id)),
backed AS (SELECT DISTINCT product_id, attribute_id, nv FROM c WHERE source IN ('wb_card', 'ozon_card', 'lamoda', 'icecat', 'pdf_datasheet', 'description'))
SELECT product_id, attribute_id, source, value_str, count(*) AS n FROM c LEFT JOIN backed b USING (product_id, attribute_id, nv)
WHERE NOT (attribute_id IN (3, 4) AND source IN ('llm_knowledge', 'competitor_rag')) OR b.nv IS NOT NULL GROUP BY ALL""")
def q_corroboration(spark, sf_dir):
    """F15, F16, J14."""
    rows = d.candidates(spark, sf_dir).drop("semantic_type").join(F.broadcast(d.targets(spark)), "attribute_id")
    spec = p.is_objective_spec(F.col("semantic_type"), F.col("type"), F.col("target_name"))
    return p.corroborated(rows, spec, KEYS).groupBy(*KEYS, "source", "value_str").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CAND} SELECT product_id, attribute_id, source, count(*) AS n FROM candidates
WHERE NOT (attribute_id = 1 AND source IN ('vision', 'web_search', 'llm_knowledge', 'competitor_rag'))
AND NOT (attribute_id = 2 AND (source <> 'description' OR len(value_arr) >= 2)) GROUP BY ALL""")
def q_source_guards(spark, sf_dir):
    """F11, F12, F13."""
    rows = d.candidates(spark, sf_dir).drop("semantic_type").join(F.broadcast(d.targets(spark)), "attribute_id")
    return rows.transform(p.brand_guard).transform(p.color_guard).groupBy(*KEYS, "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CAND}, e AS (SELECT product_id, attribute_id, source, CASE l_returnflag WHEN 'A' THEN 'мужской' WHEN 'N' THEN 'женский' ELSE 'унисекс' END AS element,
CASE product_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS name_gender FROM (SELECT c.*, substr(value_str, 1, 1) AS l_returnflag FROM candidates c)),
s AS (SELECT product_id, attribute_id, element, bool_and(source IN ('web_search', 'llm_knowledge')) AS guessed FROM e GROUP BY ALL),
o AS (SELECT e.*, guessed, CASE element WHEN 'мужской' THEN 'male' WHEN 'женский' THEN 'female' ELSE 'unisex' END AS own FROM e JOIN s USING (product_id, attribute_id, element))
SELECT product_id, attribute_id, element, count(*) AS n FROM o WHERE NOT coalesce(own <> 'unisex' AND CASE WHEN name_gender IS NOT NULL THEN own <> name_gender ELSE guessed END, false) GROUP BY ALL""")
def q_gender_guard(spark, sf_dir):
    """F14, A29."""
    c = d.candidates(spark, sf_dir)
    flag = F.left("value_str", F.lit(1))
    e = c.select(*KEYS, "source", F.when(flag == "A", "мужской").when(flag == "N", "женский").otherwise("унисекс").alias("element"), F.when(F.col("product_id") % 3 == 0, "male").when(F.col("product_id") % 3 == 1, "female").alias("name_gender"))
    return p.gender_guard(e, ("web_search", "llm_knowledge")).groupBy(*KEYS, "element").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CAND}, {TARG}, sure AS (SELECT DISTINCT product_id, attribute_id FROM candidates JOIN src USING (source) WHERE confidence >= threshold AND coalesce(semantic_type, '') <> 'sku')
SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(t.attribute_id AS BIGINT) AS attribute_id FROM part CROSS JOIN targets t
WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.product_id = p_partkey AND s.attribute_id = t.attribute_id)""")
def q_remaining_targets(spark, sf_dir):
    """F1, F2."""
    return p.remaining_targets(d.grid(spark, sf_dir).select(*KEYS), d.candidates(spark, sf_dir), KEYS)


@query(f"""WITH {CAND}, {TARG} SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(t.attribute_id AS BIGINT) AS attribute_id FROM part CROSS JOIN targets t
WHERE NOT EXISTS (SELECT 1 FROM candidates s WHERE s.product_id = p_partkey AND s.attribute_id = t.attribute_id AND confidence >= 0.85)""")
def q_unfilled_targets(spark, sf_dir):
    """F3."""
    return p.unfilled_targets(d.grid(spark, sf_dir).select(*KEYS), d.candidates(spark, sf_dir), KEYS)


@query(f"""WITH {CAND}, s AS (SELECT c.*, 5 - priority AS stage, confidence >= threshold AND coalesce(semantic_type, '') <> 'sku' AS sure FROM candidates c JOIN src USING (source)),
f AS (SELECT product_id, attribute_id, min(stage) AS settled FROM s WHERE sure GROUP BY ALL)
SELECT product_id, attribute_id, CAST(stage AS INT) AS stage, count(*) AS n FROM s LEFT JOIN f USING (product_id, attribute_id) WHERE settled IS NULL OR stage <= settled GROUP BY ALL""")
def q_cascade_early_exit(spark, sf_dir):
    """Stages after a confident one add nothing."""
    c = d.candidates(spark, sf_dir).withColumn("stage", 5 - model.priority(F.col("source")))
    return cascade(c, KEYS, "stage").groupBy(*KEYS, "stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CAND}, o AS (SELECT source, CASE WHEN confidence >= threshold AND coalesce(semantic_type, '') <> 'sku' THEN 'skipped'
WHEN CASE WHEN judge IS NOT NULL THEN confidence >= judge ELSE l_orderkey % 2 = 0 END THEN 'validated' ELSE 'invalidated' END AS outcome FROM candidates JOIN src USING (source))
SELECT source, outcome, count(*) AS n FROM o GROUP BY ALL""")
def q_judge_outcomes(spark, sf_dir):
    """F31, F32, A28."""
    return r.judge_stats(p.judged(d.candidates(spark, sf_dir), F.col("seq.l_orderkey") % 2 == 0))


_NEAR = """v AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings),
near AS (SELECT q.id AS query_id, r.id, r.label, round(list_cosine_similarity(q.vector, r.vector), 9) AS similarity FROM v q JOIN v r ON q.id % 25 = 0 AND q.id <> r.id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near QUALIFY rank <= 10)"""


def _knn(spark, sf_dir):
    rows = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), "label")
    return j.nearest(rows.where("id % 25 = 0"), rows, 10).join(rows.select("id", "label"), "id")


@query(f"WITH {_NEAR} SELECT query_id, id, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity FROM knn")
def q_knn_topk(spark, sf_dir):
    """Every 25th vector against all."""
    return _knn(spark, sf_dir).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


_CATEGORY = "CASE WHEN id % 50 = 0 THEN 'rare ' || CAST(id % 1000 AS VARCHAR) ELSE 'group ' || CAST(label % 4 AS VARCHAR) END"


@query(f"""WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings), c AS (SELECT *, {_CATEGORY} AS category FROM v),
s AS (SELECT q.id AS query_id, r.id, round(list_cosine_similarity(q.vector, r.vector), 9) AS similarity, contains(r.category, q.category) AS inside FROM c q JOIN c r ON q.id % 25 = 0 AND q.id <> r.id),
n AS (SELECT query_id, count(*) FILTER (inside) >= 3 AS filtered FROM s GROUP BY ALL), k AS (SELECT s.*, n.filtered FROM s JOIN n USING (query_id) WHERE inside OR NOT n.filtered)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank, round(similarity, 6) AS similarity, filtered FROM k QUALIFY rank <= 10""")
def q_knn_category(spark, sf_dir):
    """Every 25th vector against its own category, or all where that is too small."""
    own = F.when(F.col("id") % 50 == 0, F.concat(F.lit("rare "), (F.col("id") % 1000).cast("string"))).otherwise(F.concat(F.lit("group "), (F.col("label") % 4).cast("string")))
    rows = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), "label").withColumn("category", own)
    return j.nearest_in_category(rows.where("id % 25 = 0"), rows, 10).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"), "filtered")


def _vote_sql(having: str, conf: str) -> str:
    return f"""WITH {_NEAR}, c AS (SELECT query_id, label, count(*) AS n_votes, min(rank) AS seq FROM knn GROUP BY ALL), n AS (SELECT query_id, count(*) AS n_voters FROM knn GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_votes DESC, seq) AS rn FROM c)
SELECT query_id, CAST(label AS INT) AS label, n_votes, n_voters, round({conf}, 6) AS confidence FROM b JOIN n USING (query_id) WHERE rn = 1 AND {having}"""


@query(_vote_sql("n_votes >= ceil(n_voters / 2.0)", "least(0.7 + 0.05 * n_votes, 0.95)").replace("r.label,", "CAST(r.label % 3 AS INT) AS label,"))
def q_vote_consensus(spark, sf_dir):
    """Labels in three classes, of which some have a quorum."""
    return a.votes(_knn(spark, sf_dir).withColumn("label", F.col("label") % 3), ["query_id"], "label", "rank").select("query_id", "label", "n_votes", "n_voters", F.round("confidence", 6).alias("confidence"))


@query(_vote_sql("n_votes >= 2", "0.6 + 0.4 * (n_votes / CAST(n_voters AS DOUBLE))"))
def q_vote_legacy(spark, sf_dir):
    """A7."""
    return a.votes(_knn(spark, sf_dir), ["query_id"], "label", "rank", "two").select("query_id", "label", "n_votes", "n_voters", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_NEAR}, u AS (SELECT query_id, label, id, rank, CASE WHEN rank <= 4 THEN 0 ELSE 1 END AS stage FROM knn),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY stage, rank) AS rn FROM u) SELECT query_id, CAST(label AS INT) AS label, id, CAST(stage AS INT) AS stage FROM f WHERE rn = 1""")
def q_neighbor_merge(spark, sf_dir):
    """Two neighbour lists, each label once."""
    rows = _knn(spark, sf_dir).select("query_id", "label", "id", "rank")
    return a.neighbour_merge(rows.where("rank <= 4"), rows.where("rank > 4"), ["query_id"], "label", "rank").select("query_id", "label", "id", "stage")


@query("""WITH h AS (SELECT CAST(page_id AS BIGINT) % 7 AS token, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages WHERE url IS NOT NULL)
SELECT token, count(DISTINCT host) AS n_hosts FROM h WHERE host <> '' GROUP BY ALL HAVING count(DISTINCT host) >= 2""")
def q_country_hosts(spark, sf_dir):
    """F23, A26, T24."""
    rows = d.table(spark, sf_dir, "pages").select((F.col("page_id").cast("long") % 7).alias("token"), "url")
    return p.country_hosts(rows, ["token"], "url")


_CODES = """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey, lpad(CAST((l_orderkey * 7919 + l_partkey * 31 + l_suppkey) % 100000000 AS VARCHAR), 8, '0') AS c8,
lpad(CAST((l_orderkey * 7919 + l_partkey * 131071) % 1000000000000 AS VARCHAR), 12, '0') AS c12, lpad(CAST((l_orderkey * 104729 + l_partkey * 131071 + l_suppkey) % 10000000000000 AS VARCHAR), 13, '0') AS c13 FROM lineitem"""


def _sql_check(c: str, n: int) -> str:
    odd, even = ("3", "1") if n in (8,) else ("1", "3")
    terms = " + ".join(f"CAST({c}[{i}] AS INT) * {odd if i % 2 else even}" for i in range(1, n))
    return f"((10 - ({terms}) % 10) % 10 = CAST({c}[{n}] AS INT))"


@query(f"WITH codes AS ({_CODES}) SELECT count(*) AS n, count(*) FILTER ({_sql_check('c8', 8)}) AS ok8, count(*) FILTER ({_sql_check('c12', 12)}) AS ok12, count(*) FILTER ({_sql_check('c13', 13)}) AS ok13 FROM codes")
def q_barcode_checksum(spark, sf_dir):
    """Check digits of made codes."""
    rows = d.table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as bigint) o", "cast(l_partkey as bigint) q", "cast(l_suppkey as bigint) s")
    code = lambda x, n: F.lpad((x % 10**n).cast("string"), n, "0")
    o, q, s = F.col("o"), F.col("q"), F.col("s")
    codes = rows.select(code(o * 7919 + q * 31 + s, 8).alias("c8"), code(o * 7919 + q * 131071, 12).alias("c12"), code(o * 104729 + q * 131071 + s, 13).alias("c13"))
    ok = lambda c: F.count_if(numeric.check_digit_ok(F.col(c)))
    return codes.agg(F.count(F.lit(1)).alias("n"), ok("c8").alias("ok8"), ok("c12").alias("ok12"), ok("c13").alias("ok13"))


@query("""WITH runs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, unnest(string_split_regex(text, '[^0-9]+')) AS run FROM documents)
SELECT doc_id, count(DISTINCT run) AS n_codes FROM runs WHERE length(run) IN (8, 12, 13) GROUP BY ALL""")
def q_barcode_extract(spark, sf_dir):
    """Runs of 8, 12 or 13 digits in texts."""
    found = d.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.size(numeric.barcodes(F.col("text"))).cast("long").alias("n_codes"))
    return found.where("n_codes > 0")


@query("""SELECT CAST(p_partkey AS BIGINT) AS product_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 10 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) || ' мм' ELSE CAST(p_size AS VARCHAR) || ' кг' END AS value FROM part""")
def q_unit_normalize(spark, sf_dir):
    """Centimetres become millimetres, equal and unlike units stay."""
    k = F.col("p_partkey") % 3
    raw = F.concat(F.col("p_size").cast("string"), F.when(k == 0, " см").when(k == 1, " мм").otherwise(" кг"))
    return d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), numeric.to_field_unit(F.lit("Ширина, мм"), raw).alias("value"))


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, contains(lower(text), CAST(doc_id % 100 AS VARCHAR)) AS grounded FROM documents""")
def q_numeric_grounding(spark, sf_dir):
    """A number in any of its forms, as a plain substring."""
    rows = d.table(spark, sf_dir, "documents")
    ways = numeric.equivalents((F.col("doc_id") % 100).cast("string"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), numeric.number_in_text(ways, F.col("text")).alias("grounded"))


@query("""WITH w AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS padded, string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ')[1] AS word FROM part)
SELECT product_id, contains(padded, ' ' || word || ' ') AS in_title FROM w""")
def q_token_phrase(spark, sf_dir):
    """T4, T5."""
    tokens, word = t.brand_tokens(F.col("p_name")), F.slice(t.brand_tokens(F.col("p_type")), 1, 1)
    return d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), t.phrase_in(word, tokens).alias("in_title"))


@query("""WITH words AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM part),
dict AS (SELECT DISTINCT ws[2] AS brand FROM words WHERE len(ws) >= 2 AND length(ws[2]) >= 3),
hits AS (SELECT product_id, brand, list_position(ws, brand) - 1 AS s FROM words JOIN dict ON list_contains(ws, brand)),
f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY s, brand) AS rn FROM hits) SELECT product_id, brand, CAST(s AS BIGINT) AS s FROM f WHERE rn = 1""")
def q_brand_in_title(spark, sf_dir):
    """Words that stand second in some title as brands."""
    parts = d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), "p_name")
    brands = parts.select(F.try_element_at(t.brand_tokens(F.col("p_name")), F.lit(2)).alias("brand")).where("length(brand) >= 3").distinct()
    out = g.brand_in_title(parts, brands, "product_id", "p_name")
    return out.select("product_id", "brand", F.col("s").cast("long").alias("s"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) || 'ый' AS word FROM documents WHERE text IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (length(word) >= 5) AS n_cut FROM w""")
def q_color_stem(spark, sf_dir):
    """An ending is cut where three letters stay."""
    words = d.table(spark, sf_dir, "documents").where("text is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    word = F.concat("w", F.lit("ый"))
    return words.agg(F.count(F.lit(1)).alias("n"), F.count_if(t.color_stem(word) == F.col("w")).alias("n_cut"))


@query("""WITH w AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS padded FROM part),
o(v) AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1] FROM part),
m AS (SELECT product_id, v FROM w JOIN o ON length(v) >= 3 AND contains(padded, ' ' || v || ' ')) SELECT product_id, min(v) AS value_str FROM m GROUP BY ALL HAVING count(*) = 1""")
def q_spec_from_title(spark, sf_dir):
    """The one allowed value in the title."""
    parts = d.table(spark, sf_dir, "part")
    options = parts.select(F.split(F.lower("p_name"), " ")[0].alias("v")).agg(F.array_sort(F.collect_set("v")).alias("allowed_values"))
    rows = parts.select(F.col("p_partkey").cast("long").alias("product_id"), F.lit(1).cast("long").alias("attribute_id"), F.col("p_name").alias("product_name")).crossJoin(F.broadcast(options))
    return g.spec_from_title(rows).select("product_id", "value_str")


@query("""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN coalesce(text, '') = '' THEN 'empty' ELSE
md5(array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(replace(replace(replace(replace(regexp_replace(lower(text), '<[^>]+>', ' ', 'g'), '"', ' inch '), '”', ' inch '), 'inch', ' inch '), 'дюйм', ' inch '), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '')), '')) END AS hash FROM conversations""")
def q_description_hash(spark, sf_dir):
    """N12."""
    return d.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), hashing.description_hash(F.col("text")).alias("hash"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS product_id, CASE WHEN o_orderkey % 3 = 0 THEN 'miss' WHEN o_orderkey % 5 = 0 THEN 'stale' ELSE 'hit' END AS state,
CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderpriority END AS cached_value FROM orders""")
def q_cache_freshness(spark, sf_dir):
    """A cache whose entries are missing, stale or fresh."""
    orders = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("product_id"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    wanted = orders.select("product_id", hashing.description_hash(F.concat_ws(" ", "o_orderstatus", "o_orderpriority")).alias("input_hash"))
    old = F.when(F.col("product_id") % 5 == 0, F.lit("changed")).otherwise(F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
    cache = orders.where("product_id % 3 <> 0").select("product_id", hashing.description_hash(old).alias("input_hash"), F.col("o_orderpriority").alias("value"))
    return j.cached_values(wanted, cache, ["product_id"]).select("product_id", "state", "cached_value")


@query("""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, sha256(role || chr(0) || text || chr(0) || 'Result' || chr(0) || '{}') AS cache_key FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL""")
def q_llm_cache_key(spark, sf_dir):
    """N13."""
    rows = d.table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    return rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), hashing.prompt_key(F.col("role"), F.col("text"), F.lit("Result"), F.lit("{}")).alias("cache_key"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS product_id, substr(sha1(lower(trim(p_name))), 1, 16) AS name_hash FROM part""")
def q_product_hash(spark, sf_dir):
    """N14."""
    return d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), hashing.product_hash(F.col("p_name")).alias("name_hash"))


@query("""SELECT CAST(page_id AS BIGINT) AS page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages""")
def q_html_to_text(spark, sf_dir):
    """T21, F35."""
    return d.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), t.html_to_text(F.col("html")).alias("body"))


def _occurs(s: str) -> str:
    return f"(length(html) - length(replace(lower(html), '{s}', ''))) / {len(s)}.0"


@query(f"""WITH m AS (SELECT page_id, html, length(html) AS n, {_occurs('<')} + {_occurs('{')} + {_occurs('}')} + 8 * ({' + '.join(_occurs(x) for x in ('function', 'var ', '</', 'px;', 'rgba(', '@media', 'script', 'stylesheet'))}) AS marks,
length(regexp_replace(html, '[^0-9]', '', 'g')) AS digits, length(html) - length(replace(html, ':', '')) AS colons FROM pages WHERE html <> '')
SELECT CAST(page_id AS BIGINT) AS page_id, marks / n > 0.06 OR (n >= 400 AND (digits = 0 OR colons < 2 OR (digits / CAST(n AS DOUBLE) < 0.004 AND colons < 4))) AS junk FROM m""")
def q_boilerplate(spark, sf_dir):
    """F33."""
    return d.table(spark, sf_dir, "pages").where("html <> ''").select(F.col("page_id").cast("long").alias("page_id"), p.looks_like_markup(F.col("html")).alias("junk"))


@query("""SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(coalesce(html, '') = '' OR regexp_matches(lower(html), 'captcha|smartcaptcha|datadome|access denied|just a moment|cf-challenge|cloudflare|проверка|подтвердите, что вы не робот|are you a robot'), true) AS blocked FROM pages""")
def q_block_pages(spark, sf_dir):
    """F34."""
    return d.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), p.looks_blocked(F.col("html")).alias("blocked"))


@query("""WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages WHERE url IS NOT NULL), c AS (SELECT host, count(*) AS n FROM h WHERE host <> '' GROUP BY ALL)
SELECT host, n, CASE host WHEN 'b.example' THEN 0 WHEN 'a.example' THEN 1 ELSE 9999 END AS pool_rank FROM c""")
def q_pool_rank(spark, sf_dir):
    """T24, W10."""
    rows = d.table(spark, sf_dir, "pages").select(t.host(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return w.by_preference(rows, "host", ["b.example", "a.example"], "host")


_DICT = """dict AS (SELECT p_brand AS brand, p_name AS entry, CAST(min(p_partkey) AS BIGINT) AS value_id FROM part GROUP BY ALL),
vals AS (SELECT DISTINCT p_brand AS brand, CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name || ' (new)' WHEN 3 THEN '[''zz'', ''' || p_name || ''']' WHEN 4 THEN p_name || ' px'
  WHEN 5 THEN 'no such' ELSE p_name END AS value FROM part)"""


@query(f"""WITH {_DICT}, n AS (SELECT brand, value, lower(value) AS l3, regexp_replace(lower(value), ' \\(new\\)$', '') AS l5, nullif(regexp_extract(value, '^\\[''zz'', ''(.*)''\\]$', 1), '') AS item, nullif(regexp_extract(value, '^(.*) px$', 1), '') AS stripped FROM vals),
h AS (SELECT n.brand, n.value, value_id, 3 AS rank FROM n JOIN dict d ON n.brand = d.brand AND l3 = lower(entry)
 UNION ALL SELECT n.brand, n.value, value_id, 4 FROM n JOIN dict d ON n.brand = d.brand AND replace(l3, '-', ' ') = replace(lower(entry), '-', ' ')
 UNION ALL SELECT n.brand, n.value, value_id, 5 FROM n JOIN dict d ON n.brand = d.brand AND l5 <> l3 AND l5 = lower(entry)
 UNION ALL SELECT n.brand, n.value, value_id, 7 FROM n JOIN dict d ON n.brand = d.brand AND lower(item) = lower(entry)
 UNION ALL SELECT n.brand, n.value, value_id, 8 FROM n JOIN dict d ON n.brand = d.brand AND lower(stripped) = lower(entry)),
f AS (SELECT *, row_number() OVER (PARTITION BY brand, value ORDER BY rank, value_id) AS rn FROM h) SELECT brand, value, value_id, CAST(rank AS INT) AS rank FROM f WHERE rn = 1""")
def q_ranked_resolve(spark, sf_dir):
    """Exact, normalised, parenthesis-free, listed and unit-free values to dictionary ids."""
    parts = d.table(spark, sf_dir, "part")
    entries = parts.groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("value")).agg(F.min("p_partkey").cast("long").alias("value_id")).withColumn("seq", F.col("value_id"))
    k = F.col("p_partkey") % 7
    value = F.when(k == 0, F.upper("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(k == 2, F.concat("p_name", F.lit(" (new)"))).when(k == 3, F.concat(F.lit("['zz', '"), "p_name", F.lit("']")))
    value = value.when(k == 4, F.concat("p_name", F.lit(" px"))).when(k == 5, "no such").otherwise(F.col("p_name"))
    values = parts.select(F.col("p_brand").alias("brand"), value.alias("value"))
    return j.resolve_values(values, entries, ["brand"], fuzzy_least=None).select("brand", "value", "value_id", "rank")


@query()
def q_fuzzy_resolve(spark, sf_dir):
    """Values with a letter dropped."""
    parts = d.table(spark, sf_dir, "part")
    entries = parts.groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("value")).agg(F.min("p_partkey").cast("long").alias("value_id")).withColumn("seq", F.col("value_id"))
    values = parts.select(F.col("p_brand").alias("brand"), F.concat(F.left("p_name", F.lit(2)), F.substring("p_name", 4, 1000)).alias("value"))
    return j.resolve_values(values, entries, ["brand"])


@query("""WITH n AS (SELECT DISTINCT p_brand AS brand, p_name AS a FROM part) SELECT x.brand, x.a, y.a AS b,
CAST(length(x.a) + length(y.a) AS BIGINT) AS total FROM n x JOIN n y ON x.brand = y.brand AND x.a < y.a""")
def q_name_pairs(spark, sf_dir):
    """Name pairs within a key, distinct before they are scored."""
    n = d.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("a")).distinct()
    return n.join(n.withColumnRenamed("a", "b"), "brand").where("a < b").select("brand", "a", "b", (F.length("a") + F.length("b")).cast("long").alias("total"))


@query()
def q_match_names(spark, sf_dir):
    """Characteristic names to target names of a card, each once."""
    parts = d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), "p_name")
    names = parts.select("product_id", F.posexplode(F.split("p_name", " ")).alias("seq", "name")).withColumn("seq", F.col("seq").cast("long"))
    targets = parts.select("product_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("id"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("n")), F.struct(F.lit(2).cast("long").alias("id"), F.lit("other").alias("n")))).alias("x"))
    return j.match_names(names, targets.select("product_id", F.col("x.id").alias("target_id"), F.col("x.n").alias("name")), ["product_id"])


_CODES = "list_distinct(list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')))"


@query(f"""WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS id, 'x' || p_partkey % 5 || ' ' || lower(p_name) || CASE WHEN p_partkey % 2 = 0 THEN ' pro' ELSE '' END AS a, lower(p_name) || ' x' || p_size % 5 || CASE WHEN p_size % 3 = 0 THEN ' z9' ELSE '' END AS b FROM part),
m AS (SELECT id, {_CODES.format('a')} AS x, {_CODES.format('b')} AS y, contains(a, ' pro') AS pro FROM t)
SELECT id, (len(list_filter(x, lambda e: NOT list_contains(y, e))) > 0 AND len(list_filter(y, lambda e: NOT list_contains(x, e))) > 0) OR (list_has_any(x, y) AND pro) AS conflict FROM m""")
def q_model_conflict(spark, sf_dir):
    """Codes and variant words of two titles."""
    k, size = F.col("p_partkey"), F.col("p_size")
    one = F.concat(F.lit("X"), (k % 5).cast("string"), F.lit(" "), "p_name", F.when(k % 2 == 0, " Pro").otherwise(""))
    two = F.concat("p_name", F.lit(" x"), (size % 5).cast("string"), F.when(size % 3 == 0, " Z9").otherwise(""))
    return d.table(spark, sf_dir, "part").select(k.cast("long").alias("id"), p.model_conflict(one, two).alias("conflict"))


@query("""WITH f AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'cache' ELSE event_type END AS source, CAST(floor(value) AS BIGINT) AS tokens FROM events),
per AS (SELECT user_id, count(*) FILTER (coalesce(source, '') <> 'cache') AS g, count(*) FILTER (coalesce(source, '') = 'cache') AS c, sum(coalesce(tokens, 0)) AS t FROM f GROUP BY ALL)
SELECT CAST(coalesce(sum(g), 0) AS BIGINT) AS generated_count, count(*) FILTER (g >= 1) AS generated_products, CAST(coalesce(sum(c), 0) AS BIGINT) AS cached_count, CAST(coalesce(sum(t), 0) AS BIGINT) AS total_tokens FROM per""")
def q_usage(spark, sf_dir):
    """A9."""
    e = d.table(spark, sf_dir, "events")
    return r.usage(e.select(F.col("user_id").alias("product_id"), F.when(F.col("event_type") == "view", "cache").otherwise(F.col("event_type")).alias("source"), F.floor("value").cast("long").alias("tokens")))


_COV = f"""WITH {CAND}, {TARG}, {d.GRID_SQL}, cov AS (SELECT product_id, count(*) FILTER (is_required) AS n_required, count(*) FILTER (NOT is_required) AS n_optional, count(*) FILTER (is_required AND filled) AS filled_required,
count(*) FILTER (NOT is_required AND filled) AS filled_optional, count(*) FILTER (has_values AND filled) AS id_total, count(*) FILTER (has_values AND filled AND resolved) AS id_resolved FROM grid GROUP BY ALL)"""


@query(f"{_COV} SELECT *, round(filled_required / CAST(n_required AS DOUBLE), 6) AS required_share, round(filled_optional / CAST(n_optional AS DOUBLE), 6) AS optional_share FROM cov")
def q_coverage(spark, sf_dir):
    """A10."""
    out = r.coverage(d.grid(spark, sf_dir))
    return out.withColumn("required_share", F.round("required_share", 6)).withColumn("optional_share", F.round("optional_share", 6))


@query(f"""{_COV} SELECT round(sum(filled_required) / sum(n_required), 6) AS required_global, round(avg(filled_required / CAST(n_required AS DOUBLE)), 6) AS required_mean, round(sum(filled_optional) / sum(n_optional), 6) AS optional_global,
round(avg(filled_optional / CAST(n_optional AS DOUBLE)), 6) AS optional_mean, round(avg(CAST(filled_required / CAST(n_required AS DOUBLE) >= 0.8 AS DOUBLE)), 6) AS should_fill, round(sum(id_resolved) / sum(id_total), 6) AS resolved_share FROM cov""")
def q_coverage_summary(spark, sf_dir):
    """A11."""
    out = r.coverage_summary(r.coverage(d.grid(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {CAND} SELECT source, count(*) AS n FROM candidates GROUP BY ALL")
def q_by_source(spark, sf_dir):
    """A12."""
    return r.by_source(d.candidates(spark, sf_dir))


@query(f"""WITH {CAND}, {TARG}, {d.GRID_SQL} SELECT CAST(attribute_id AS BIGINT) AS attribute_id, count(*) AS n, count(*) FILTER (filled) AS n_filled, round(count(*) FILTER (filled) / CAST(count(*) AS DOUBLE), 6) AS rate,
CASE WHEN count(*) FILTER (filled) / CAST(count(*) AS DOUBLE) >= 0.9 THEN 'always' WHEN count(*) FILTER (filled) = 0 THEN 'never' ELSE 'sometimes' END AS grade FROM grid GROUP BY 1""")
def q_fill_rates(spark, sf_dir):
    """A13, A22."""
    return r.fill_rates(d.grid(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"{_COV} SELECT product_id, round((0.5 * (filled_required / CAST(n_required AS DOUBLE)) + 0.5 * (filled_optional / CAST(n_optional AS DOUBLE))) * 100, 1) AS score FROM cov")
def q_score(spark, sf_dir):
    """A14."""
    return r.scores(r.coverage(d.grid(spark, sf_dir)))


@query(f"""WITH {CAND}, {TARG}, {d.GRID_SQL} SELECT product_id, CAST(attribute_id AS BIGINT) AS attribute_id, CASE WHEN confidence IS NULL AND is_required THEN 'empty (required)' WHEN confidence IS NULL THEN 'empty' ELSE 'check' END AS status,
CASE WHEN confidence >= 0.60 THEN 'yellow' ELSE 'red' END AS color, round(confidence, 2) AS confidence FROM grid WHERE confidence IS NULL OR confidence < 0.85""")
def q_checklist(spark, sf_dir):
    """A15."""
    return r.checklist(d.grid(spark, sf_dir))


@query(f"WITH {CAND}, {TARG}, {d.GRID_SQL} SELECT CAST(attribute_id AS BIGINT) AS attribute_id, count(*) FILTER (NOT filled) AS n_missing FROM grid GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def q_top_missing(spark, sf_dir):
    """A16."""
    return r.top_missing(d.grid(spark, sf_dir))


@query(f"WITH {CAND} SELECT count(*) AS n, round(avg(CAST(value_id IS NOT NULL AS DOUBLE)), 6) AS resolved_share, round(avg(CAST(value_str IN ('AF', 'NO') AS DOUBLE)), 6) AS in_dictionary_share FROM candidates")
def q_value_id_resolution(spark, sf_dir):
    """A17."""
    out = r.resolution(d.candidates(spark, sf_dir).withColumn("in_dictionary", F.col("value_str").isin("AF", "NO")))
    return out.select("n", F.round("resolved_share", 6).alias("resolved_share"), F.round("in_dictionary_share", 6).alias("in_dictionary_share"))


_DRAIN = f"""WITH {CAND}, {TARG}, {d.GRID_SQL}, card AS (SELECT product_id, bool_or(has_card) AS card_found FROM best GROUP BY ALL),
coded AS (SELECT CAST(attribute_id AS BIGINT) AS attribute_id, CASE WHEN coalesce(n_candidates, 0) = 0 AND NOT coalesce(card_found, false) THEN 'A' WHEN coalesce(n_candidates, 0) = 0 THEN 'B' WHEN has_values AND n_with_id = 0 THEN 'C' ELSE 'D' END AS drain
FROM grid LEFT JOIN card USING (product_id) WHERE NOT filled)"""


@query(f"""{_DRAIN}, c AS (SELECT attribute_id, drain, count(*) AS k FROM coded GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY attribute_id ORDER BY k DESC, drain) AS rn FROM c)
SELECT attribute_id, CAST(sum(k) AS BIGINT) AS n, max(drain) FILTER (rn = 1) AS dominant, CAST(coalesce(sum(k) FILTER (drain = 'A'), 0) AS BIGINT) AS n_a, CAST(coalesce(sum(k) FILTER (drain = 'B'), 0) AS BIGINT) AS n_b,
CAST(coalesce(sum(k) FILTER (drain = 'C'), 0) AS BIGINT) AS n_c, CAST(coalesce(sum(k) FILTER (drain = 'D'), 0) AS BIGINT) AS n_d FROM top GROUP BY ALL""")
def q_drain_codes(spark, sf_dir):
    """A23."""
    grid = d.grid(spark, sf_dir)
    card = grid.groupBy("product_id").agg(F.coalesce(F.max("has_card"), F.lit(False)).alias("card_found"))
    rows = grid.join(card, "product_id").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0))).withColumn("n_with_id", F.coalesce("n_with_id", F.lit(0))).withColumn("is_enum", F.col("has_values"))
    return r.drain_summary(r.drains(rows))


@query("""WITH m AS (SELECT l.quality AS want, CASE WHEN d.n_chars > 200 THEN 1 WHEN d.n_chars > 20 THEN 0 END AS got FROM labels l JOIN documents d USING (doc_id))
SELECT count(*) AS n_expected, count(got) AS n_filled, count(*) FILTER (coalesce(got = want, false)) AS n_right, round(100.0 * count(got) / count(*), 6) AS coverage, round(100.0 * count(*) FILTER (coalesce(got = want, false)) / count(got), 6) AS accuracy FROM m""")
def q_eval_accuracy(spark, sf_dir):
    """A length rule against labels."""
    joined = d.table(spark, sf_dir, "labels").select("doc_id", "quality").join(d.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    got = F.when(F.col("n_chars") > 200, "1").when(F.col("n_chars") > 20, "0")
    rows = joined.select(got.alias("got"), F.col("quality").cast("string").alias("want")).withColumn("matches", F.coalesce(j.value_matches(F.col("got"), F.col("want"), F.lit(0.0), F.lit(None).cast("array<string>")), F.lit(False)) & F.col("got").isNotNull())
    out = r.accuracy(rows)
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS s, o_orderpriority AS q FROM orders WHERE o_orderkey % 11 <> 0), n AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 5 = 0 THEN upper(o_orderpriority) || '!' ELSE o_orderpriority END AS q FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT id, o.s AS os, n.s AS ns, o.q AS oq, n.q AS nq FROM o FULL JOIN n USING (id))
SELECT id, 's' AS field, os AS old_value, ns AS new_value FROM j WHERE os IS DISTINCT FROM ns UNION ALL SELECT id, 'q', oq, nq FROM j WHERE oq IS DISTINCT FROM nq""")
def q_run_diff(spark, sf_dir):
    """Two versions compared."""
    o = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("q"))
    new = o.where("id % 13 <> 0").select("id", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("s")).alias("s"), F.when(F.col("id") % 5 == 0, F.concat(F.upper("q"), F.lit("!"))).otherwise(F.col("q")).alias("q"))
    return j.changes(o.where("id % 11 <> 0"), new, ["id"], ["s", "q"])


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'fixed' ELSE o_orderstatus END AS status, o_orderkey % 4 = 0 AS is_corrected FROM orders")
def q_corrections_apply(spark, sf_dir):
    """J16."""
    o = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"))
    return j.apply_corrections(o, o.where("id % 4 = 0").select("id", F.lit("fixed").alias("corrected_value")), ["id"], "status")


@query("SELECT source, CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS rank FROM documents QUALIFY rank <= 5")
def q_sample_n_per_group(spark, sf_dir):
    """A19, W3."""
    return w.top_n(d.table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("long").alias("doc_id")), ["source"], [F.col("doc_id")], 5)


@query("SELECT p_type AS category, p_brand AS attribute, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS joined_values, count(DISTINCT p_name) AS n_values FROM part WHERE p_name <> '' GROUP BY ALL")
def q_dictionary_aggregate(spark, sf_dir):
    """A18, S4."""
    rows = d.table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("attribute"), F.col("p_name").alias("value"))
    return r.dictionary(rows).select("category", "attribute", F.array_join("vals", "|").alias("joined_values"), "n_values")


@query("""WITH x AS (SELECT DISTINCT p_type AS category, p_brand AS attribute, p_name AS value FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY category, attribute ORDER BY value) AS rn, count(*) OVER (PARTITION BY category, attribute) AS n_values FROM x)
SELECT category, attribute, array_to_string(list(value ORDER BY value) FILTER (rn <= 3), '|') AS joined_values, n_values, n_values > 3 AS values_truncated FROM k GROUP BY ALL""")
def q_dictionary_truncated(spark, sf_dir):
    """A20."""
    rows = d.table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("attribute"), F.col("p_name").alias("value"))
    return r.truncated_dictionary(rows, 3).select("category", "attribute", F.array_join("vals", "|").alias("joined_values"), "n_values", "values_truncated")


@query(f"""WITH {CAND}, b AS (SELECT attribute_id, value_str AS value FROM candidates WHERE value_id IS NULL), s AS (SELECT DISTINCT attribute_id, value FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY attribute_id ORDER BY value) AS rn FROM s)
SELECT attribute_id, n_failed, samples FROM (SELECT attribute_id, count(*) AS n_failed FROM b GROUP BY ALL) JOIN (SELECT attribute_id, array_to_string(list(value ORDER BY value), '|') AS samples FROM k WHERE rn <= 3 GROUP BY ALL) USING (attribute_id)""")
def q_failed_values(spark, sf_dir):
    """A21."""
    out = r.failed_values(d.candidates(spark, sf_dir).select("attribute_id", F.col("value_str").alias("value"), "value_id"))
    return out.select("attribute_id", "n_failed", F.array_join("samples", "|").alias("samples"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, substr(p_name, 1, 300) AS name, substr(p_type, 1, 300) AS categories, '{"brand":["' || p_brand || '"],"size":["' || CAST(p_size AS VARCHAR) || '"]}' AS characteristics, 'parts' AS source FROM part""")
def q_dataset_adapter(spark, sf_dir):
    """The common payload."""
    chars = F.create_map(F.lit("brand"), F.array("p_brand"), F.lit("size"), F.array(F.col("p_size").cast("string")))
    return d.table(spark, sf_dir, "part").select(*readers.payload(F.col("p_partkey").cast("long"), F.col("p_name"), F.col("p_type"), chars, "parts"))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events""")
def q_json_characteristics(spark, sf_dir):
    """D3, D4."""
    return d.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), nested.attribute_value(nested.characteristics(F.col("props")), F.lit("K")).alias("k"))


@query("""WITH RECURSIVE tree AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), s_name FROM supplier),
walk AS (SELECT id, id AS root_id, name AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, w.root_id, w.path || '/' || t.name FROM tree t JOIN walk w ON t.parent_id = w.id) SELECT id, root_id, path FROM walk""")
def q_tree_flatten(spark, sf_dir):
    """D11, J18."""
    part = lambda table, prefix, key, parent, name: d.table(spark, sf_dir, table).select(F.concat(F.lit(prefix[0]), F.col(key)).alias("id"), (F.concat(F.lit(prefix[1]), F.col(parent)) if parent else F.lit(None).cast("string")).alias("parent_id"), F.col(name).alias("name"))
    tree = part("region", "r-", "r_regionkey", None, "r_name").unionByName(part("nation", "nr", "n_nationkey", "n_regionkey", "n_name")).unionByName(part("supplier", "sn", "s_suppkey", "s_nationkey", "s_name"))
    return j.tree_categories(tree).select("id", "root_id", F.array_join("path", "/").alias("path"))


@query("""WITH g AS (SELECT user_id, event_id, epoch(ts) AS secs, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200 THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY secs, event_id) AS group_no FROM g) SELECT CAST(user_id AS BIGINT) AS user_id, CAST(group_no AS BIGINT) AS group_no, count(*) AS n FROM n GROUP BY ALL""")
def q_gap_groups(spark, sf_dir):
    """W8."""
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return w.gap_groups(e, ["user_id"], "at", 7200, "event_id").groupBy("user_id", "group_no").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CAND}, f AS (SELECT product_id, attribute_id, value_str, l_orderkey % 2 AS side, row_number() OVER (PARTITION BY product_id, attribute_id, l_orderkey % 2 ORDER BY {SEQ}) AS rn FROM candidates),
x AS (SELECT product_id, attribute_id, value_str AS value_a FROM f WHERE rn = 1 AND side = 0), y AS (SELECT product_id, attribute_id, value_str AS value_b FROM f WHERE rn = 1 AND side = 1)
SELECT product_id, attribute_id, value_a, value_b, CASE WHEN value_a IS NULL THEN 'b' WHEN value_b IS NULL THEN 'a' ELSE 'both' END AS side, lower(value_a) = lower(value_b) AS agrees FROM x FULL JOIN y USING (product_id, attribute_id)""")
def q_two_model_reconcile(spark, sf_dir):
    """J19."""
    c = d.candidates(spark, sf_dir)
    return j.two_models(c.where("seq.l_orderkey % 2 = 0"), c.where("seq.l_orderkey % 2 = 1"), KEYS, "value_str", "seq")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_events_windows(spark, sf_dir):
    """Tumbling windows (an addition); the same code runs on a stream."""
    e = d.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.tumbling(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS window_start FROM events) SELECT window_start, count(*) AS n FROM w GROUP BY ALL""")
def q_sliding_windows(spark, sf_dir):
    """Sliding windows (an addition)."""
    e = d.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sliding(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT CAST(user_id AS BIGINT) AS user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, k""")
def q_sessions(spark, sf_dir):
    """Session windows (an addition)."""
    e = d.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sessions(e).select(F.col("user_id").cast("long").alias("user_id"), F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 4 IN (0, 1, 2) AS vague FROM orders""")
def q_vague_names(spark, sf_dir):
    """F7."""
    name = F.element_at(F.array(F.lit("NewFeature 2"), F.lit("x"), F.lit(" TODO "), F.lit("Материал")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), t.is_vague(name).alias("vague"))


@query("""WITH w AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, lower(text) AS e, list_filter(regexp_extract_all(lower(role), '[a-z0-9]+'), lambda x: length(x) >= 3) AS ws FROM conversations)
SELECT conv_id, turn, coalesce(e, '') = '' OR len(ws) = 0 OR len(list_filter(ws, lambda x: contains(e, x))) > 0 AS grounded FROM w""")
def q_grounded(spark, sf_dir):
    """the role word as a value, the text as its evidence."""
    rows = d.table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), p.grounded(F.col("role"), F.col("text")).alias("grounded"))


@query(f"""WITH {CAND}, {TARG}, c AS (SELECT c.*, has_values, is_required FROM candidates c JOIN targets t USING (attribute_id)), inside AS (SELECT *, has_values AND attribute_id <> 5 AS i, coalesce(len(value_ids), 0) AS k FROM c)
SELECT product_id, attribute_id, count(*) AS n, CAST(sum(CASE WHEN i AND is_list AND k < len(value_arr) THEN k ELSE len(value_arr) END) AS BIGINT) AS n_elements FROM inside WHERE NOT i OR CASE WHEN is_list THEN k > 0 ELSE value_id IS NOT NULL END GROUP BY ALL""")
def q_drop_unresolved(spark, sf_dir):
    """F24."""
    rows = d.candidates(spark, sf_dir).drop("semantic_type").join(F.broadcast(d.targets(spark)), "attribute_id")
    out = p.drop_unresolved(p.drop_unresolved(rows, False), True)
    return out.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("value_arr")).cast("long").alias("n_elements"))


@query(f"""WITH {CAND}, o AS (SELECT *, value_ids IS NOT NULL AND (len(value_ids) <> CASE WHEN is_list THEN len(value_arr) ELSE 1 END OR (NOT is_collection AND len(value_ids) > 1)) AS off FROM candidates)
SELECT product_id, attribute_id, count(*) AS n, count(CASE WHEN NOT off THEN value_ids END) AS n_lists, count(CASE WHEN NOT off THEN value_id END) AS n_ids FROM o GROUP BY ALL""")
def q_reconcile_ids(spark, sf_dir):
    """F25."""
    return p.reconcile_ids(d.candidates(spark, sf_dir)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count("value_ids").alias("n_lists"), F.count("value_id").alias("n_ids"))


@query(f"WITH {CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {SEQ}) AS rn FROM candidates) SELECT product_id, attribute_id, source FROM f WHERE rn = 1")
def q_first_wins(spark, sf_dir):
    """W1."""
    return w.first_by(d.candidates(spark, sf_dir).select("product_id", "attribute_id", "source", "seq"), ["product_id"], [F.col("seq")]).select("product_id", "attribute_id", "source")


@query("""WITH x AS (SELECT source, text, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY source) AS first_id FROM documents WHERE text IS NOT NULL) SELECT source, md5(text) AS text_md5, CAST(first_id AS BIGINT) AS doc_id FROM x WHERE rn = 1""")
def q_longest_title(spark, sf_dir):
    """W2."""
    out = w.longest_per_key(d.table(spark, sf_dir, "documents").where("text is not null").select("source", "text", F.col("doc_id").cast("long").alias("doc_id")), "source", "text", "doc_id")
    return out.select("source", F.md5(F.col("text").cast("binary")).alias("text_md5"), "doc_id")


@query("SELECT CAST(o_custkey AS BIGINT) AS custkey, CAST(o_orderkey AS BIGINT) AS orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 3) AS INT) AS chunk FROM orders")
def q_chunks(spark, sf_dir):
    """W7."""
    o = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("custkey"), F.col("o_orderkey").cast("long").alias("orderkey"))
    return w.chunked(o, ["custkey"], [F.col("orderkey")], 3)


@query("""WITH s AS (SELECT CAST(o_custkey AS BIGINT) AS custkey, CAST(o_orderkey AS BIGINT) AS orderkey, o_totalprice AS score, lead(o_totalprice) OVER w AS nxt, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT custkey, orderkey, score FROM s WHERE rn = 1 AND score >= 1000 AND score - coalesce(nxt, 0) >= 500""")
def q_margin(spark, sf_dir):
    """W6, J9."""
    o = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("custkey"), F.col("o_orderkey").cast("long").alias("orderkey"), F.col("o_totalprice").alias("score"))
    return w.with_margin(o, ["custkey"], "score", [F.col("orderkey")], 1000, 500)


@query("""WITH f AS (SELECT CAST(event_id AS BIGINT) AS seq, event_type AS marketplace, CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS card_id, value AS score, 'e' || CAST(event_id % 3 AS VARCHAR) AS engine FROM events)
SELECT marketplace, card_id, max(score) AS score, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines, min(seq) AS seq FROM f WHERE card_id IS NOT NULL GROUP BY ALL UNION ALL SELECT marketplace, card_id, score, engine, seq FROM f WHERE card_id IS NULL""")
def q_image_merge(spark, sf_dir):
    """U7."""
    e = d.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("long").alias("seq"), F.col("event_type").alias("marketplace"), F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("long")).alias("card_id"), F.col("value").alias("score"), F.concat(F.lit("e"), F.col("event_id") % 3).alias("engine"), F.lit("t").alias("title"))
    return a.image_merge(rows).select("marketplace", "card_id", "score", F.array_join("engines", ",").alias("engines"), "seq")


@query("""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'Z' AS s FROM orders WHERE o_orderkey % 7 <> 0) SELECT id, coalesce(o.s, n.s) AS s FROM o FULL JOIN n USING (id)""")
def q_coalesced(spark, sf_dir):
    """U5."""
    o = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), "o_orderstatus")
    return a.coalesced(o.where("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, F.col("o_orderstatus")).alias("s")), o.where("id % 7 <> 0").select("id", F.lit("Z").alias("s")), ["id"])


@query(f"""WITH {CAND} SELECT product_id, attribute_id, l_orderkey AS o, l_linenumber AS n, '[' || array_to_string(list_transform(generate_series(1, 3), lambda i: '{{"dictionary_value_id":' || coalesce(CAST(value_ids[i] AS VARCHAR), 'null') || ',"value":"' || value_arr[i] || '"}}'), ',') || ']' AS payload FROM candidates""")
def q_export_payload(spark, sf_dir):
    """D13."""
    c = d.candidates(spark, sf_dir)
    return c.select(*KEYS, F.col("seq.l_orderkey").alias("o"), F.col("seq.l_linenumber").alias("n"), F.to_json(nested.export_values(F.col("value_arr"), F.col("value_ids")), {"ignoreNullFields": "false"}).alias("payload"))


@query(f"WITH {CAND} SELECT source, attribute_id, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM candidates GROUP BY ROLLUP (source, attribute_id)")
def q_rollup(spark, sf_dir):
    """Report with subtotals (an addition)."""
    return r.rollup_report(d.candidates(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_type AS category_id FROM part) SELECT c.product_id, c.category_id, CAST(a AS BIGINT) AS attribute_id FROM c JOIN (SELECT DISTINCT p_type AS category_id FROM part WHERE p_size % 2 = 0) s USING (category_id) CROSS JOIN generate_series(1, 2) g(a)""")
def q_product_targets(spark, sf_dir):
    """J1, J2."""
    parts = d.table(spark, sf_dir, "part")
    schema = parts.where("p_size % 2 = 0").select(F.col("p_type").alias("category_id")).distinct().withColumn("attribute_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    return j.with_targets(parts.select(F.col("p_partkey").cast("long").alias("product_id"), F.col("p_type").alias("category_id")), schema)[0].select("product_id", "category_id", "attribute_id")


@query("""SELECT CAST(o_custkey AS BIGINT) AS custkey, max(CASE WHEN o_orderstatus = 'F' THEN p END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN p END) AS o FROM (SELECT o_custkey, o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS p FROM orders GROUP BY ALL) GROUP BY ALL""")
def q_wide_sheet(spark, sf_dir):
    """Pivot back to a sheet."""
    o = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("custkey"), "o_orderstatus", "o_orderpriority")
    out = sinks.wide(o, ["custkey"], "o_orderstatus", "o_orderpriority", ["F", "O"])
    return out.select("custkey", *[F.when(F.col(c) != "", F.col(c)).alias(c.lower()) for c in ("F", "O")])


@query("""WITH u AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CAST(event_id AS BIGINT) AS event_id FROM u WHERE rn = 1""")
def q_upsert(spark, sf_dir):
    """Keep the newest of two batches."""
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("event_id").cast("long").alias("event_id"))
    return sinks.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("""SELECT CAST(conv_id AS VARCHAR) AS conv_id, array_to_string(list('[' || role || '] ' || text ORDER BY turn, '[' || role || '] ' || text), chr(10) || chr(10)) AS text FROM conversations WHERE trim(text) <> '' AND role IS NOT NULL GROUP BY ALL""")
def q_page_text(spark, sf_dir):
    """S23."""
    rows = d.table(spark, sf_dir, "conversations").where("role is not null").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")
    return readers.page_text(rows, ["conv_id"], "turn", "text", "role")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Мужской' WHEN 1 THEN 'Женский' WHEN 2 THEN 'Девочки' WHEN 3 THEN 'Мальчики' END AS form FROM orders""")
def q_gender_forms(spark, sf_dir):
    """T17."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("men's", "Женщинам", "для девочек", " boys ", "дом")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), t.gender_form(word).alias("form"))


@query("""WITH p AS (SELECT event_type AS provider, CAST(floor(value) AS BIGINT) AS a, CAST(event_id % 100 AS BIGINT) AS b FROM events) SELECT provider, count(*) AS n_calls, CAST(sum(a) AS BIGINT) AS tokens_in, CAST(sum(b) AS BIGINT) AS tokens_out, round((sum(a) * 0.27 + sum(b) * 1.1) / 1000000, 9) AS cost FROM p GROUP BY ALL""")
def q_cost(spark, sf_dir):
    """A27."""
    e = d.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.floor("value").cast("long").alias("tokens_in"), (F.col("event_id") % 100).cast("long").alias("tokens_out"))
    return r.cost(e, 0.27, 1.1).withColumn("cost", F.round("cost", 9))


@query()
def q_finalize(spark, sf_dir):
    """The chain of guards, consensus, merges and drops; each step has its own SQL, the chain is tested against plain Python."""
    out = finalize(d.candidates(spark, sf_dir), F.broadcast(d.targets(spark)), KEYS)
    return out.select(*KEYS, "source", "value_str", F.array_join("value_arr", "|").alias("joined_values"), "is_list", F.round("confidence", 6).alias("confidence"))


@query()
def q_fuzzy_scores(spark, sf_dir):
    """Scores of distinct name pairs within a brand."""
    n = d.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("a")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), "brand").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", *[F.round(fuzzy.score(k, F.col("a"), F.col("b")), 4).alias(k) for k in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "weighted_ratio", "stem_affinity")])
