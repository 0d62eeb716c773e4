"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, compact_windows, context_tree, filter_audit, kmeans_tree, merkle, pii, projection_passes, quality, suffix_dedup, toxicity
from .decontaminate import contamination
from .jaccard_join import jaccard_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their near-duplicate passages of 50 words or more and the classes these make."""
    return compact_windows.passage_classes(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and their decoding."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.span_digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of 4-word shingles of 85 % or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and unigram log probability of every document."""
    docs = _table(spark, sf_dir, "documents")
    return context_tree.score(docs, context_tree.train(docs))


def op7_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    return kmeans_tree.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)[0]


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against benchmark windows of 13 words."""
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that also start earlier."""
    return suffix_dedup.digests(suffix_dedup.dedup(_table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of every document, and which tampering the proofs find."""
    return merkle.verify(_table(spark, sf_dir, "documents"))


def op12_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of a cosine of 0.95 or more."""
    return projection_passes.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five document filters, step by step, for each language."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '{pattern}')"


_OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_words(_SPACE)}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 4 THEN ws ELSE list_slice(ws, i, i + 3) END, ' ') AS g FROM w, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS comp FROM documents UNION SELECT f.b, r.comp FROM r JOIN both_ways f ON r.id = f.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.comp) AS component_id FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL"""

_OP8 = f"""WITH d AS (SELECT doc_id, coalesce({_words(_ALNUM)}, []) AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words(_ALNUM)} AS ws FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(list_slice(ws, p, p + least(13, len(ws)) - 1), ' ') AS g FROM i, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS t(p) WHERE len(ws) > 0),
m AS (SELECT DISTINCT m FROM k),
o AS (SELECT doc_id, p, m, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS g FROM d, m, unnest(generate_series(1, len(ws) - m + 1)) AS t(p) WHERE len(ws) >= m),
f AS (SELECT doc_id, p, m, item_id FROM o JOIN k USING (m, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM f) GROUP BY ALL),
x AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM f GROUP BY ALL)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id"""

_OP9 = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 299) AS part FROM b, unnest(generate_series(0, CAST(length(h) / 2 AS BIGINT) - 100, 200)) AS t(base) WHERE length(h) >= 200),
w AS (SELECT doc_id, base + p AS p, md5(substr(part, 2 * p + 1, 200)) AS g FROM blocks, unnest(generate_series(0, least(199, CAST(length(part) / 2 AS BIGINT) - 100))) AS t(p)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM w),
c AS (SELECT doc_id, p AS q, 1 AS v FROM f WHERE again UNION ALL SELECT doc_id, p + 100, -1 FROM f WHERE again),
s AS (SELECT doc_id, q, sum(sum(v)) OVER (PARTITION BY doc_id ORDER BY q) AS depth, lead(q) OVER (PARTITION BY doc_id ORDER BY q) AS nxt FROM c GROUP BY doc_id, q),
g AS (SELECT doc_id, q, nxt, CASE WHEN q = lag(nxt) OVER (PARTITION BY doc_id ORDER BY q) THEN 0 ELSE 1 END AS opens FROM s WHERE depth > 0),
z AS (SELECT doc_id, sum(opens) OVER (PARTITION BY doc_id ORDER BY q) AS k, q, nxt FROM g),
spans AS (SELECT doc_id, k, min(q) AS lo, max(nxt) AS hi FROM z GROUP BY ALL),
edges AS (SELECT doc_id, list(hi ORDER BY lo) AS his, list(lo ORDER BY lo) AS los, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY ALL)
SELECT b.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN his IS NULL THEN h ELSE array_to_string(list_transform(generate_series(0, len(his)), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE his[i] END) + 1, 2 * ((CASE WHEN i = len(his) THEN CAST(length(h) / 2 AS BIGINT) ELSE los[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE his[i] END)))), '') END)) AS kept_sha256
FROM b LEFT JOIN edges USING (doc_id)"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_OP11 = f"""WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM generate_series(0, 255) AS g(i)),
crc AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])) AS inverse FROM documents, crc_table),
leaves AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND inverse % 2 = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS altered FROM crc),
own AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM own UNION ALL SELECT tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 3, n),
sources AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS places FROM up WHERE n = 1),
over AS (SELECT 0 AS lvl, place AS idx, places AS n, subroot AS h FROM sources UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY lvl, idx // 3, n),
inner_fold AS (SELECT row_id, tree, 0 AS lvl, idx, n, altered AS h, '' AS way FROM own UNION ALL
 SELECT f.row_id, f.tree, f.lvl + 1, f.idx // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.h ELSE u.h END, '' ORDER BY u.idx)), f.way || coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx <> f.idx), '')
 FROM inner_fold f JOIN up u ON u.tree = f.tree AND u.lvl = f.lvl AND u.idx // 3 = f.idx // 3 WHERE f.n > 1 GROUP BY f.row_id, f.tree, f.lvl, f.idx, f.n, f.h, f.way),
outer_fold AS (SELECT row_id, tree, 0 AS lvl, place AS idx, places AS n, h, way FROM inner_fold JOIN sources USING (tree) WHERE n = 1 UNION ALL
 SELECT f.row_id, f.tree, f.lvl + 1, f.idx // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.h ELSE u.h END, '' ORDER BY u.idx)), f.way || coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx <> f.idx), '')
 FROM outer_fold f JOIN over u ON u.lvl = f.lvl AND u.idx // 3 = f.idx // 3 WHERE f.n > 1 GROUP BY f.row_id, f.tree, f.lvl, f.idx, f.n, f.h, f.way)
SELECT o.doc_id, o.leaf, s.subroot, r.h AS root, sha256(f.way) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM own o JOIN sources s USING (tree) JOIN outer_fold f ON f.row_id = o.row_id AND f.n = 1 CROSS JOIN (SELECT h FROM over WHERE n = 1) r"""

_OP12 = """WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v FROM x WHERE v IS NOT NULL AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
both_ways AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
n AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY ALL),
r AS (SELECT vec_id AS id, vec_id AS comp FROM x UNION SELECT f.b, r.comp FROM r JOIN both_ways f ON r.id = f.a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, min(r.comp) AS component_id, x.vec_id = min(r.comp) AS kept FROM x JOIN r ON r.id = x.vec_id LEFT JOIN n ON n.vec_id = x.vec_id GROUP BY x.vec_id, n.n"""

_OP13 = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS copied FROM t),
k AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
 + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN copied THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN k USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY ALL),
l(b, x) AS (VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM l p, l q, l r, l s, l t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31),
z AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[:step - 1]), 0) AS INT) AS gone FROM o, unnest(generate_series(1, 5)) AS g(step)),
y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (gone | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & gone = 0), 0) AS removed,
 coalesce(sum(n) FILTER (mask & own > 0 AND mask & gone > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
 coalesce(sum(good) FILTER (mask & own > 0 AND mask & gone = 0), 0) AS good_lost, coalesce(sum(bad) FILTER (mask & own > 0 AND mask & gone = 0), 0) AS toxic_lost FROM c, z GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y"""


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that it can express: the others are tested against brute-force versions in tests/llm."""
    return {"op5_jaccard_join": _OP5, "op8_decontaminate": _OP8, "op9_suffix_dedup": _OP9, "op11_merkle": _OP11, "op12_projection_passes": _OP12, "op13_filter_audit": _OP13}
