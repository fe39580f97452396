"""The machine-learning rules turned to data: contamination, splits, scaling, metrics, secrets in text.

All splits come from a hash of the key, so they depend neither on the order of
rows nor on partitioning and stay the same when rows are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.functions.arrays import computed_once
from fleetlint.model import SECRET_PATTERNS
from fleetlint.operators.sequence import number_rows
from fleetlint.session import materialise


def bucket(key: Column, salt: str = "", buckets: int = 100) -> Column:
    """0 to ``buckets`` - 1, from the first eight hex digits of the key's MD5."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def grams(text: Column, n: int) -> Column:
    """Distinct word n-grams of a text; words end at white space."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")

    def made(w):
        parts = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))

    # Bound as a lambda's variable, the words are split once and not once per gram.
    return F.get(F.transform(F.array(words), made), F.lit(0))


def contamination(docs: DataFrame, held_out: DataFrame, n: int = 8) -> DataFrame:
    """Per document with any n-gram: how many of its distinct n-grams the held-out texts contain.

    Documents' grams leave the scan as hashes, and only those that a held-out
    text has too: the held-out hashes are the side that is broadcast, by its
    size, or else both sides meet as numbers. One pass gives totals and hits.
    Grams as text are made once more for the documents with a hit alone, to be
    compared exactly.
    """
    known = held_out.select(F.explode(grams(F.col("text"), n)).alias("gram")).distinct().withColumn(
        "hash", F.xxhash64("gram"))
    hashes = F.transform(grams(F.col("text"), n), lambda g: F.xxhash64(g))
    own = computed_once(docs.select("doc_id", "text"), hashes, "hashes").select("doc_id", "hashes").filter("size(hashes) > 0")
    held = known.select("hash").distinct().withColumn("held", F.lit(True))
    totals = materialise(own.select("doc_id", F.explode("hashes").alias("hash")).join(held, "hash", "left").groupBy(
        "doc_id").agg(F.count(F.lit(1)).alias("total"), F.count("held").alias("hits")), "gram_totals")
    hit = totals.filter("hits > 0").select("doc_id")
    sure = docs.select("doc_id", "text").join(hit, "doc_id", "left_semi").select(
        "doc_id", F.explode(grams(F.col("text"), n)).alias("gram")).withColumn("hash", F.xxhash64("gram")).join(
        known, ["hash", "gram"], "left_semi")
    matched = sure.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"))
    return totals.join(matched, "doc_id", "left").select(
        "doc_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.col("total").cast("bigint").alias("total"))


def hash_split(rows: DataFrame, key: str, train: int = 80, valid: int = 10) -> DataFrame:
    """Add ``bucket`` and ``split``: train, valid or test."""
    at = F.col("bucket")
    return rows.withColumn("bucket", bucket(F.col(key))).withColumn(
        "split", F.when(at < train, "train").when(at < train + valid, "valid").otherwise("test"))


def stratified_split(rows: DataFrame, key: str, strata: list[str], test_percent: int = 20) -> DataFrame:
    """Add ``split``: of every stratum the first rows by hash, ``test_percent`` of them rounded down, are the test set.

    Ranks are made without one task per stratum; there is one count per stratum.
    """
    hashed = rows.withColumn("_at", F.md5(F.col(key).cast("string").cast("binary")))
    ranked = number_rows(hashed, strata, ["_at", key], "_rank")
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for c in strata:
        same = same & ranked[c].eqNullSafe(sizes[c])
    test = F.col("_rank") * 100 <= F.col("_n") * test_percent
    return ranked.join(sizes, same).select(
        *[ranked[c] for c in rows.columns], F.when(test, "test").otherwise("train").alias("split"))


def share_drift(split: DataFrame, strata: list[str]) -> DataFrame:
    """Per stratum its share of the training and of the test set in percent, and the gap."""
    counts = split.groupBy(*strata).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    sums = split.agg(
        F.count_if(F.col("split") == "train").alias("all_train"), F.count_if(F.col("split") == "test").alias("all_test"))
    train, test = sums.first() or (0, 0)  # two numbers
    def share(part, whole):
        return F.when(F.lit(whole > 0), F.col(part) * 100.0 / F.lit(max(whole, 1)))

    return counts.withColumns({"train_share": share("train", train), "test_share": share("test", test)}).withColumn(
        "drift", F.abs(F.col("train_share") - F.col("test_share")))


def standardised(rows: DataFrame, keys: list[str], group_key: str, columns: list[str], scale: int = 100) -> DataFrame:
    """Long form ``keys, split, name, z``: values less the mean over the deviation, both from training rows alone.

    Values are taken as whole hundredths, so that sums are exact whatever the
    order. The statistics have one row per column and are joined by its name.
    """
    split = hash_split(rows, group_key)
    pairs = ", ".join(f"'{c}', cast(round(`{c}` * {scale}) as bigint)" for c in columns)
    long = split.select(*keys, "split", F.expr(f"stack({len(columns)}, {pairs}) as (name, value)"))
    train = long.where("split = 'train'").groupBy("name").agg(
        F.count("value").cast("double").alias("n"), F.sum("value").cast("double").alias("s"),
        F.sum(F.col("value").cast("decimal(19,0)") * F.col("value")).cast("double").alias("ss"))
    spread = F.sqrt((F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")))
    z = (F.col("value").cast("double") - F.col("s") / F.col("n")) / F.nullif(spread, F.lit(0.0))
    return long.join(F.broadcast(train), "name").select(*keys, "split", "name", z.alias("z"))


def folds(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    return rows.withColumn("fold", bucket(F.col(key), "fold:", k))


def class_metrics(rows: DataFrame, truth: Column, predicted: Column, classes: list[int]) -> DataFrame:
    """Counts, precision, recall and F1 per class, beside the accuracy over all of them. One pass."""
    pairs = rows.select(truth.alias("t"), predicted.alias("p")).where("t IS NOT NULL AND p IS NOT NULL")
    counts = pairs.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))  # classes squared rows
    each = counts.select("t", "p", "n", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    own_t, own_p = F.col("t") == F.col("class"), F.col("p") == F.col("class")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    sums = each.groupBy("class").agg(
        total(own_t & own_p).alias("tp"), total(~own_t & own_p).alias("fp"), total(own_t & ~own_p).alias("fn"),
        total(F.col("t") == F.col("p")).alias("right"), F.sum("n").alias("n"))

    def ratio(a, b):
        return F.when(b > 0, a.cast("double") / b)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("right"), F.col("n")).alias("accuracy"))


def text_secrets(docs: DataFrame, patterns: dict[str, str] | None = None, snippet_chars: int = 80) -> DataFrame:
    """``doc_id, line_no, pattern, snippet`` for every line of a text that a pattern matches.

    The source's patterns and any of the user's. One combined search over the
    whole text drops most documents before lines are made.
    """
    named = SECRET_PATTERNS | (patterns or {})
    anything = "|".join(f"(?:{p})" for p in named.values())
    lines = docs.where(F.col("text").rlike(anything)).select(
        "doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("pos", "line"))
    hits = F.filter(
        F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in named.items()]), lambda name: name.isNotNull())
    return lines.where(F.col("line").rlike(anything)).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), F.explode(hits).alias("pattern"),
        F.substring(tx.strip(F.col("line")), 1, snippet_chars).alias("snippet"))
