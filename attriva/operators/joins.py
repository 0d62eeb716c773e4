"""Lookups, value resolution, name matching, nearest neighbours and comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as t
from .windows import first_by, top_n

#: A dimension is broadcast only below this many rows; else the join is a shuffle.
SMALL_ROWS = 100_000


def small(dim: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it has at most ``rows`` rows, counted no further than that; else as it is."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores: few small files or partitions are few tasks, however much work their rows make later on."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def with_targets(products: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with their category's targets, and the products of categories without any."""
    return products.join(targets, "category_id"), products.join(targets.select("category_id").distinct(), "category_id", "left_anti")


def cached_values(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Cached values whose input hash is still the wanted one; stale and missing ones are null."""
    kept = cache.select(*keys, F.col("input_hash").alias("_hash"), F.col("value").alias("_value"))
    joined = wanted.join(kept, keys, "left")
    state = F.when(F.col("_hash").isNull(), "miss").when(F.col("_hash") == F.col("input_hash"), "hit").otherwise("stale")
    return joined.withColumn("state", state).withColumn("cached_value", F.when(F.col("state") == "hit", F.col("_value"))).drop("_hash", "_value")


def dictionary_values(tree: DataFrame) -> DataFrame:
    """One row for each value of categories with nested characteristics."""
    chars = tree.select("cat_id", "type_id", F.explode("characteristics").alias("c"))
    return chars.select("cat_id", "type_id", F.col("c.id").alias("attribute_id"), F.explode("c.values").alias("v")).select("cat_id", "type_id", "attribute_id", F.col("v.id").alias("value_id"), F.col("v.value").alias("value"))


def code_key(value: Column) -> Column:
    """The first eight digits of a numeric code of six digits or more, before any " - "; null: no such code."""
    digits = F.regexp_replace(F.split_part(value, F.lit(" - "), F.lit(1)), "[^0-9]", "")
    return F.when(F.length(digits) >= 6, F.left(digits, F.lit(8)))


def _tagged(*kinds: tuple[int, str, Column]) -> Column:
    """An array of (rank, key) with one text key per kind, null keys left out, the best rank of each key only by order."""
    every = F.array(*[F.when(key.isNotNull(), F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(kind), key).alias("key"))) for rank, kind, key in kinds])
    return F.array_compact(every)


def _asked_keys(item: Column, translations: dict[str, str] | None) -> Column:
    """The keys by which an asked item may meet an entry, ranks 1 to 5 of ``resolve_values``.

    Kinds: l lower-cased, c the entry's whole code, p a beginning of the entry's code, s strongly normalised, b strongly
    normalised without trailing parentheses.
    """
    bare = F.when(t.without_parens(item) != item, t.without_parens(item))
    code = F.when(item.rlike("^[0-9]{6,}$"), item)
    heads = [(2, "c", F.when(F.length(code) >= n, F.left(code, F.lit(n)))) for n in (6, 7, 8)]
    return _tagged(
        (1, "l", F.lower(t.gender_form(item))), *heads, (2, "p", F.when(F.length(code) < 8, code)), (3, "l", F.lower(item)),
        (4, "s", t.strong_token(item, translations)), (5, "l", F.lower(bare)), (5, "s", t.strong_token(bare, translations)), (5, "b", t.strong_token(bare, translations)),
    )


def _entry_keys(entry: Column, translations: dict[str, str] | None) -> Column:
    code = code_key(entry)
    heads = [("p", F.when(F.length(code) >= n, F.left(code, F.lit(n)))) for n in (6, 7)]
    kinds = [("l", F.lower(entry)), ("c", code), *heads, ("s", t.strong_token(entry, translations)), ("b", t.strong_token(t.without_parens(entry), translations)), ("x", entry)]
    return F.array_distinct(F.array_compact(F.array(*[F.when(key.isNotNull(), F.concat(F.lit(kind), key)) for kind, key in kinds])))


#: Places of an asked value's forms: the value itself is 0, items of a list follow from 1, then these.
_PIXELS, _NEAR = 1 << 20, 1 << 21


def resolve_values(
    values: DataFrame, dictionary: DataFrame, keys: list[str], value: str = "value", translations: dict[str, str] | None = None, fuzzy_least: float | None = 85.0, nearest_option: str | None = None
) -> DataFrame:
    """The dictionary id of each distinct (keys, value), by the first strategy that finds one, and its rank.

    Ranks: 1 gender form, 2 numeric code of at least six equal digits, 3 equal without case, 4 equal when strongly normalised,
    5 equal without trailing parentheses, 6 weighted fuzzy score; 7 the first item of a value that looks like a list, and 8 the
    value without a pixel word, each by ranks 1 to 6; 9 the option that an outside matcher found (column ``nearest_option`` of
    ``values``), if its digits are the value's.  Within a rank the first entry (by seq) wins.

    Every form of a value and every entry carries its keys in one array, so all ranks but 6 are one equi-join; forms that it
    leaves, and that come before the one it found, go to the fuzzy scorer, against their own key's entries.
    """
    own = [*keys, "value"]
    named = values.select(*keys, F.col(value).alias("value"), *([F.col(nearest_option).alias("_near")] if nearest_option else [])).where("value is not null").distinct()
    form = lambda place, item: F.struct(place.cast("int").alias("_place"), item.alias("_item"))
    listed = F.filter(F.transform(t.unwrap_list(F.col("value")), lambda x, k: form(k + 1, x)), lambda x: x["_item"] != F.col("value"))
    pixels = t.without_pixels(F.col("value"))
    forms = F.concat(F.array(form(F.lit(0), F.col("value"))), listed, F.array_compact(F.array(F.when(pixels.isNotNull(), form(F.lit(_PIXELS), pixels)))))
    asked = named.select(*own).distinct().select(*own, F.explode(forms).alias("_f")).select(*own, "_f._place", "_f._item").withColumn("_keys", _asked_keys(F.col("_item"), translations))
    if nearest_option is not None:
        near = named.where(F.col("_near").isNotNull() & t.digits_agree(F.col("value"), F.col("_near"))).select(*own, F.lit(_NEAR).alias("_place"), F.col("_near").alias("_item"))
        asked = asked.unionByName(near.withColumn("_keys", _tagged((9, "x", F.col("_item")))))
    entry = dictionary.select(*keys, F.col("value").alias("_entry"), "value_id", "seq").where("_entry is not null")
    left = asked.select(*own, "_place", F.explode("_keys").alias("_k")).select(*own, "_place", F.col("_k.rank").alias("_by"), F.col("_k.key").alias("_key"))
    right = entry.select(*keys, "value_id", "seq", F.explode(_entry_keys(F.col("_entry"), translations)).alias("_key"))
    order = [F.col("_place"), F.col("_by"), F.col("seq")]
    found = first_by(left.join(right, [*keys, "_key"]).select(*own, "_place", "_by", "seq", "value_id"), own, order)
    if fuzzy_least is not None:
        found = found.checkpoint() if values.sparkSession.sparkContext.getCheckpointDir() else found
        first = found.select(*own, F.col("_place").alias("_first"))
        rest = asked.drop("_keys").where(F.col("_place") < _NEAR).join(first, own, "left").where("_first is null or _place < _first")
        form = lambda df, c: df.withColumn("_a", t.strong_token(F.col(c), translations)).withColumn("_l", fuzzy.letters(F.col("_a")))
        pairs = form(rest.select(*keys, "_item").distinct(), "_item").join(form(entry, "_entry").withColumnsRenamed({"_a": "_b", "_l": "_m"}), keys)
        pairs = pairs.where(fuzzy.may_reach("weighted_ratio", F.col("_a"), F.col("_b"), F.col("_l"), F.col("_m"), fuzzy_least))
        scored = pairs.withColumn("_s", fuzzy.score("weighted_ratio", F.col("_a"), F.col("_b"))).where(F.col("_s") >= fuzzy_least)
        near_by = first_by(scored.select(*keys, "_item", "value_id", "seq", "_s"), [*keys, "_item"], [-F.col("_s"), F.col("seq")])
        closer = rest.join(near_by, [*keys, "_item"]).select(*own, "_place", F.lit(6).alias("_by"), "seq", "value_id")
        found = first_by(found.unionByName(closer), own, order)
    rank = F.when(F.col("_place") == 0, F.col("_by")).when(F.col("_place") < _PIXELS, 7).when(F.col("_place") == _PIXELS, 8).otherwise(9)
    return found.select(*own, "value_id", rank.alias("rank"))


def match_option(target: Column, option: Column, vector: Column | None = None) -> Column:
    """Score of an option for a target text by the legacy rules, 0 to 4, null: no match.

    4 numeric code, 3 equal without spaces and dashes, 2 and over: fuzzy (90, or 85 for fewer than five letters),
    1 and over: vector similarity 0.60 or more, under 1: stem affinity of 0.60 or more.
    """
    clean = F.regexp_replace(t.norm(target), "^[.,;:\"']+|[.,;:\"']+$", "")
    junk = clean.isin("", "unknown", "n/a", "not specified", "none", "null")
    bare = lambda c: F.regexp_replace(F.lower(c), "[ -]", "")
    wide = fuzzy.score("weighted_ratio", clean, F.lower(option))
    stem = fuzzy.score("stem_affinity", clean, F.lower(option))
    near = F.when(vector >= 0.60, 1 + vector / 10) if vector is not None else F.lit(None).cast("double")
    return F.when(~junk, F.coalesce(
        F.when(clean.rlike("^[0-9]{6,}$") & (F.left(clean, F.lit(8)) == code_key(option)), 4.0),
        F.when(bare(clean) == bare(option), 3.0),
        F.when(wide >= F.when(F.length(clean) < 5, 85).otherwise(90), 2 + wide / 1000),
        near,
        F.when(stem >= 0.60, stem / 2),
    ))


def match_names(names: DataFrame, targets: DataFrame, keys: list[str], least: float = 88.0) -> DataFrame:
    """Characteristic names to target names within a key; each target once, earlier and better matches first.

    Ranks: equal, equal when normalised, one holding the other, fuzzy.  Greedy per key: matches are taken by (rank, name
    order); a taken target or name bars the later ones.  A key's names are a card's, so a key's pairs are few.
    """
    left = names.select(*keys, F.col("name").alias("_name"), F.col("seq").alias("_nseq"))
    right = targets.select(*keys, F.col("name").alias("_target"), "target_id")
    both = left.join(right, keys)
    low = [F.lower(t.strip(F.col(c))) for c in ("_name", "_target")]
    normal = [t.char_name(F.col(c)) for c in ("_name", "_target")]
    holds = (F.length(normal[0]) >= 3) & (F.length(normal[1]) >= 3) & (F.contains(normal[0], normal[1]) | F.contains(normal[1], normal[0]))
    fuzz = fuzzy.score("weighted_ratio", normal[0], normal[1])
    ranked = both.withColumn("rank", F.when(low[0] == low[1], 1).when(normal[0] == normal[1], 2).when(holds, 3).when(fuzz >= least, 4)).where("rank is not null")
    grouped = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_nseq", "rank", "target_id", "_name"))).alias("m"))
    none = F.array().cast("array<struct<_nseq:bigint,rank:int,target_id:bigint,_name:string>>")
    taken = F.aggregate("m", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["target_id"] == x["target_id"]) | (y["_nseq"] == x["_nseq"])), acc).otherwise(F.concat(acc, F.array(x))))
    cast = grouped.withColumn("m", F.col("m").cast("array<struct<_nseq:bigint,rank:int,target_id:bigint,_name:string>>"))
    return cast.select(*keys, F.explode(taken).alias("x")).select(*keys, F.col("x._name").alias("name"), F.col("x.target_id").alias("target_id"), F.col("x.rank").alias("rank"))


def _joined(batches, rows: int):
    """Batches of at least ``rows`` rows, the last one perhaps fewer; a task's results are cut per batch."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, block: int = 512, category: str | None = None) -> DataFrame:
    """The k most similar rows of each query by cosine, exact; (query_id, id, similarity, rank).

    A stated query set is taken in blocks of ``block``; each block visits every row once, and each task keeps its own best k,
    so neither the rows nor all pairs move.  Rows that have a query's id and zero or null vectors take no part; similarities are
    rounded to nine places before they are ranked, ties to the smaller id.  ``category``: a column of both; a query that has
    one meets only rows whose category holds its own, without case.
    """
    spark = rows.sparkSession
    usable = rows.where(F.exists("vector", lambda x: x != 0))
    kind = (F.col(category).cast("string") if category else F.lit(None).cast("string")).alias("category")
    usable = usable.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), kind)
    asked = queries.where(F.exists("vector", lambda x: x != 0)).select(F.col("id").cast("long"), F.col("vector").cast("array<double>"), kind).orderBy("id")

    def found_by(own):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in own]), np.array([r[1] for r in own]), [r[2] for r in own]))

        def run(batches):
            ids, q, kinds = shared.value
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            for batch in _joined(batches, 4096):
                own_ids = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own_ids), -1)
                sim = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
                fits = {c: None if c is None else pc.fill_null(pc.match_substring(batch.column(2), c, ignore_case=True), False).to_numpy(zero_copy_only=False) for c in set(kinds)}
                qs, rs = [], []
                for i in range(len(ids)):
                    order = np.lexsort((own_ids, -sim[i]))
                    use = own_ids[order] != ids[i]
                    if fits[kinds[i]] is not None:
                        use &= fits[kinds[i]][order]
                    order = order[use][:k]
                    qs.append(np.full(len(order), i))
                    rs.append(order)
                qs, rs = np.concatenate(qs), np.concatenate(rs)
                yield pa.RecordBatch.from_arrays([pa.array(ids[qs]), pa.array(own_ids[rs]), pa.array(sim[qs, rs])], names=["query_id", "id", "similarity"])

        return usable.mapInArrow(run, "query_id long, id long, similarity double")

    out, got = None, []
    for r in asked.toLocalIterator():
        got.append((r[0], r[1], r[2]))
        if len(got) == block:
            out, got = found_by(got) if out is None else out.unionByName(found_by(got)), []
    if got:
        out = found_by(got) if out is None else out.unionByName(found_by(got))
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    return top_n(out, ["query_id"], [F.desc("similarity"), F.col("id")], k)


def nearest_in_category(queries: DataFrame, rows: DataFrame, k: int = 10, least: int = 3, category: str = "category") -> DataFrame:
    """The k most similar rows of a query's own category; where they are fewer than ``least``, those of all rows;
    ``filtered`` tells which."""
    inside = nearest(queries, rows, k, category=category)
    enough = inside.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("query_id")
    kept = inside.join(enough, "query_id", "left_semi").withColumn("filtered", F.col("query_id").isNotNull())
    other = queries.join(enough.withColumnRenamed("query_id", "id"), "id", "left_anti")
    return kept.unionByName(nearest(other, rows, k).withColumn("filtered", F.lit(False)))


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key and column whose value differs; values as text, missing rows as null."""
    joined = old.select(*keys, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns]).join(new.select(*keys, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns]), keys, "full")
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in columns]))
    return joined.select(*keys, items.alias("x")).select(*keys, "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def apply_corrections(rows: DataFrame, corrections: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The corrected value where there is one, and whether there was."""
    fixed = corrections.select(*keys, F.col("corrected_value").alias("_fixed"))
    joined = rows.join(fixed, keys, "left")
    return joined.withColumn("is_corrected", F.col("_fixed").isNotNull()).withColumn(column, F.coalesce("_fixed", column)).drop("_fixed")


def resolve_fields(subjects: DataFrame, field_map: DataFrame) -> DataFrame:
    """(subject, field) to mapped field: the exact subject__kind entry, else the smallest of those that end in the kind."""
    entry = field_map.withColumn("_kind", F.regexp_extract("entry", "__(.*)$", 1))
    exact = subjects.withColumn("entry", F.concat_ws("__", "subject", "kind")).join(entry.drop("_kind"), "entry").withColumn("_r", F.lit(0))
    loose = subjects.join(entry, subjects.kind == entry["_kind"]).drop("_kind").withColumn("_r", F.lit(1))
    both = exact.unionByName(loose.select(*exact.columns))
    return first_by(both.select("subject", "kind", "field", "mapped", "entry", "_r"), ["subject", "kind", "field"], [F.col("_r"), F.col("entry")]).drop("_r", "entry")


def two_models(a: DataFrame, b: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """Both models' first values by key: both, a or b; agreement compares normalised values."""
    one, two = (first_by(x.select(*keys, value, seq), keys, [F.col(seq)]).select(*keys, F.col(value).alias(n)) for x, n in ((a, "value_a"), (b, "value_b")))
    joined = one.join(two, keys, "full")
    side = F.when(F.col("value_a").isNull(), "b").when(F.col("value_b").isNull(), "a").otherwise("both")
    return joined.withColumn("side", side).withColumn("agrees", t.for_corroboration(F.col("value_a")) == t.for_corroboration(F.col("value_b")))


def value_matches(got: Column, want: Column, tolerance: Column, accepted: Column) -> Column:
    """Within tolerance; else equal, accepted, one holding the other, or equal but for two last letters."""
    x = t.norm(got)
    every = F.concat(F.array(t.norm(want)), F.transform(F.coalesce(accepted, F.array().cast("array<string>")), t.norm))
    number = F.abs(got.try_cast("double") - want.try_cast("double")) <= tolerance
    root = lambda c: F.least(F.length(x), F.length(c)) - 2
    stem = lambda c: (F.length(x) >= 4) & (F.length(c) >= 4) & (root(c) >= 3) & (F.left(x, root(c)) == F.left(c, root(c)))
    words = F.exists(every, lambda c: (x == c) | F.contains(x, c) | F.contains(c, x) | stem(c))
    return F.when(tolerance.isNotNull() & want.try_cast("double").isNotNull(), F.coalesce(number, F.lit(False))).otherwise(words)


def tree_categories(tree: DataFrame) -> DataFrame:
    """Every node of (id, parent_id, name) below a root with that root and the path from it.

    Each node's known way up is joined to that of the node where it ends, so each round doubles the levels covered; rounds
    are cut by a checkpoint where a folder for it is set.  Nodes whose ancestors are not all there are left out; a cycle is
    refused.
    """
    cut = lambda df: df.checkpoint() if tree.sparkSession.sparkContext.getCheckpointDir() else df
    way = cut(tree.select("id", F.col("parent_id").alias("up"), F.col("id").alias("root_id"), F.array("name").alias("path")))
    covered, nodes = 1, None
    while not way.where("up is not null").isEmpty():
        nodes = nodes if nodes is not None else tree.count()
        if covered > nodes:
            raise ValueError("the tree has a cycle")
        end = way.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root_id").alias("_root"), F.col("path").alias("_path"))
        joined = way.join(end, "up", "left").where("up is null or _root is not null")
        way = cut(joined.select("id", F.when(F.col("up").isNotNull(), F.col("_up")).alias("up"), F.coalesce("_root", "root_id").alias("root_id"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")))
        covered *= 2
    return way.select("id", "root_id", "path")
