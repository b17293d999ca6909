"""Importance resampling towards a target corpus, in DataFrame operations only.

A document's features are its words and word pairs, hashed into buckets. A bucket's gain is the logarithm of its share in
the target over its share in the documents, smoothed by one; a document's weight is the mean of its features' gains. Gumbel
noise drawn from the id makes the highest scores a sample without replacement in proportion to exp(weight / 1000).

Two scans of the texts: one counts buckets (each task sends at most ``buckets`` rows), one sums gains (each task sends one row
a document). The gain table has at most ``buckets`` rows and is broadcast. Ranks come from sorted ranges and their sizes.

Null and empty texts have no features and weight 0. Very long texts are exploded row by row. Rows that repeat an id and its
text each get their own row, with equal weight and score and ranks of their own. Equal scores go to the smaller id. Rows of
null id have a weight, no score and no rank. An empty target gains nothing but its smoothing; an empty table gives an empty
one. Other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, numbered, written

APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII other than letters and digits
BUCKETS = 10_000
SEED = 7
SHARE = 25  # of 100 documents that are long enough
LEAST_WORDS = 20


def _lowered(word: Column) -> Column:
    """A-Z lowered and nothing else. ``lower`` is fast, and right where all is ASCII or nothing changes."""
    low = F.lower(word)
    return F.when(F.octet_length(word) == F.char_length(word), low).when(low == word, word).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def feature_buckets(table: DataFrame, keys: list[Column], buckets: int = BUCKETS) -> DataFrame:
    """``keys`` as _key0, ..., ``bucket`` for each word and each pair of neighbours in column text (null once where it has none), ``first`` 1 in one row of a text, else 0."""
    names = [f"_key{i}" for i in range(len(keys))]
    words = table.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.array_remove(F.split(F.coalesce("text", F.lit("")), APART), "").alias("words"))
    pairs = words.select(*names, F.posexplode_outer(F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")).alias("after"))).alias("position", "pair"))
    pairs = pairs.select(*names, "position", _lowered(F.col("pair.words")).alias("word"), _lowered(F.col("pair.after")).alias("after"))
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    grams = F.array(bucket(F.col("word")), bucket(F.concat("word", F.lit(" "), "after")))
    each = pairs.select(*names, "position", F.posexplode(grams).alias("gram", "bucket")).where("gram = 0 OR bucket IS NOT NULL")
    return each.select(*names, F.expr("int(gram = 0 AND coalesce(position, 0) = 0)").alias("first"), "bucket")


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, at most ``buckets`` rows."""
    each = feature_buckets(docs, [F.lit(0)], buckets).unionAll(feature_buckets(target, [F.lit(1)], buckets))
    counts = written(each.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count_if(F.col("_key0") == 0).alias("s"), F.count_if(F.col("_key0") == 1).alias("t")), "buckets")
    all_s, all_t = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(all_s + buckets)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(all_t + buckets)))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features and weight of every row of ``docs``."""
    each = feature_buckets(docs, [F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit("")))], buckets)
    sums = each.join(F.broadcast(gains(docs, target, buckets)), "bucket", "left").groupBy("_key0", "_key1").agg(F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"), F.sum("first").alias("copies"))
    sums = sums.select(F.col("_key0").alias("doc_id"), F.expr("n div copies").alias("n_features"), F.expr("CASE WHEN n = 0 THEN 0L ELSE (total - pmod(total, n)) div n END").alias("weight"), "copies")
    return sums.select("doc_id", "n_features", "weight", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def importance_resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``docs``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(docs, target, buckets).withColumn("score", F.col("weight") + noise)
    enters = (F.col("score").isNotNull() & (F.col("n_features") >= max(0, 2 * least_words - 1))).alias("enters")  # n words are 2n - 1 features
    table = numbered(scored.select("*", enters), [F.desc("enters"), F.desc("score"), F.asc("doc_id")], "scores")
    drawn = share * table.where("enters").count() // 100
    return table.select("doc_id", "n_features", "weight", "score", F.when(F.col("number") < drawn, F.col("number") + 1).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs``, as they are."""
    return by_ids(docs, importance_resample(docs, target, **settings).where("rank IS NOT NULL").select("doc_id").distinct(), "left_semi")
