"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items.

Each item is cut into windows of ``window`` words. A window can only occur in a document that holds all of its shingles, so for
containment the necessary prefix is one shingle: the rarest in the documents, the others ordered behind it by their counts.
Document words stream through one broadcast join on the shingle; the position of the shingle in its window then fixes where the
window would start, which must lie inside the document with room for the whole window, and the words there must equal the
window's. Only DataFrame functions are used, and no document text is shuffled: documents are cut into words once and written where
they were read, the words array stays in the row that the join looks at, and only verified hits leave the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.common import ascii_lower, blocks
from ebbtide.runtime import materialize

WINDOW, SHINGLE = 10, 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _keys(docs: DataFrame, size: int) -> DataFrame:
    """One row per position that starts a shingle of ``size`` words, with its hash; the words array is carried by reference."""
    at = docs.select("_key", "_print", "_words", F.posexplode("_words").alias("_pos", "_word"))
    at = at.where(F.col("_pos") + size <= F.size("_words"))
    return at.withColumn("_shingle", F.xxhash64("_word", *(F.expr(f"_words[_pos + {i}]") for i in range(1, size))))


def item_windows(items: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window words): every ``window`` consecutive words, or all words of an item that has fewer but some."""
    cut = items.select(F.col(item).cast("string").alias("_item"), words_of(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - window + 1, F.lit(1)))
    return cut.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_words", i, window))).alias("_window"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, and _print (hash of the text): a row per row of ``docs``.

    A word is hit if it lies in an occurrence of an item window. Null and empty texts have no words and no hits; an item without
    words matches nothing; a null item id adds hits but no id. Rows are told apart by key and text, so repeated rows all return
    with the same figures, and rows that share a key but not the text each get their own. Other columns are not read.
    """
    owned = materialize(item_windows(items, window))
    windows = owned.select("_window").distinct().withColumn("_id", F.md5(F.concat_ws(" ", "_window")))
    size = F.least(F.lit(shingle), F.size("_window"))
    offsets = F.sequence(F.lit(0), F.size("_window") - size)
    parts = materialize(windows.withColumn("_size", size).select("_id", "_window", "_size", F.explode(offsets).alias("_off")).withColumn(
        "_shingle", _hash_at(shingle)))
    # xxhash64 of a null is a number too, so null texts keep a print.
    given = materialize(docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_print"), words_of(F.col(text)).alias("_words")).withColumn(
        "n_words", F.size("_words").cast("long")))
    sizes = sorted(r[0] for r in parts.select("_size").distinct().collect())  # at most ``shingle`` values
    counted = [
        _keys(given, n).join(b, "_shingle").groupBy("_shingle").agg(F.count("*").alias("_df")).withColumn("_size", F.lit(n))
        for n in sizes for b in blocks(materialize(parts.where(F.col("_size") == n).select("_shingle").distinct()), "_shingle", 32)]
    hits = [given.where(F.lit(False)).select("_key", "_print", *(F.lit(None).cast(t).alias(c) for c, t in (("_start", "int"), ("_len", "int"), ("_id", "string"))))]
    if counted:
        # A window whose rarest shingle no document holds cannot occur and drops out of the inner join.
        ranked = parts.join(reduce(DataFrame.unionByName, counted), ["_shingle", "_size"])
        complete = parts.groupBy("_id").agg(F.count("*").alias("_n"))
        order = Window.partitionBy("_id").orderBy("_df", "_off")
        prefix = ranked.withColumn("_rank", F.row_number().over(order)).withColumn("_found", F.count("*").over(Window.partitionBy("_id")))
        prefix = materialize(prefix.where("_rank = 1").join(complete, "_id").where("_found = _n").drop("_rank", "_found", "_n", "_df"))
        longest = prefix.agg(F.coalesce(F.max(F.octet_length(F.concat_ws(" ", "_window"))), F.lit(0))).first()[0]
        for n in sizes:
            for b in blocks(prefix.where(F.col("_size") == n), "_shingle", 128 + 16 * window + longest):
                found = _keys(given, n).join(b.drop("_size"), "_shingle")
                start, length = F.col("_pos") - F.col("_off"), F.size("_window")
                fits = (start >= 0) & (start + length <= F.size("_words"))
                same = F.slice("_words", F.greatest(start, F.lit(0)) + 1, length) == F.col("_window")
                hits.append(found.where(fits & same).select("_key", "_print", start.alias("_start"), length.alias("_len"), "_id"))
    hits = materialize(reduce(DataFrame.unionByName, hits))
    # Words under the union of the hit spans: each span adds what reaches beyond all spans that start before it.
    before = Window.partitionBy("_key", "_print").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    span = hits.groupBy("_key", "_print", "_start").agg((F.col("_start") + F.max("_len")).alias("_end"))
    covered = span.withColumn("_seen", F.greatest("_start", F.coalesce(F.max("_end").over(before), F.lit(0)))).groupBy("_key", "_print").agg(
        F.sum(F.greatest(F.col("_end") - F.col("_seen"), F.lit(0))).alias("n_hit"))
    ids = hits.select("_key", "_print", "_id").distinct().join(
        owned.withColumn("_id", F.md5(F.concat_ws(" ", "_window"))).select("_id", "_item").distinct(), "_id")
    ids = ids.groupBy("_key", "_print").agg(F.array_sort(F.collect_set("_item")).alias("item_ids"))
    both = covered.join(ids, (covered["_key"].eqNullSafe(ids["_key"])) & (covered["_print"] == ids["_print"]), "left").select(
        covered["_key"].alias("_hit_key"), covered["_print"].alias("_hit_print"), "n_hit", "item_ids")
    out = given.select("_key", "_print", "n_words").join(both, F.col("_key").eqNullSafe(F.col("_hit_key")) & (F.col("_print") == F.col("_hit_print")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("_key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("item_ids"), "_print")


def _hash_at(shingle: int) -> Column:
    """Hash of the shingle at _off of a window: as many words as its _size says, hashed as ``_keys`` hashes them."""
    word = [F.try_element_at("_window", F.col("_off") + 1 + i) for i in range(shingle)]
    cases = F.when(F.lit(False), F.lit(0).cast("long"))
    for n in range(1, shingle + 1):
        cases = cases.when(F.col("_size") == n, F.xxhash64(*word[:n]))
    return cases
