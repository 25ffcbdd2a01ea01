"""Host-level quality rules.

Every document is measured by base rules. Rule failures are counted by host, each host's failure rate is
shrunk towards the rates of all hosts by a beta prior fitted to them, and hosts whose shrunk rate is too high
take their remaining documents with them. Spark functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.llm.words import SPACES, WORD, with_value, word_list
from edgelake.operators.scale import lookup_join
from edgelake.session import stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
PRIOR_STRENGTH = (1.0, 1e6)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text, first ones included.

    Windows are sorted with their places, so equal ones are neighbours: no pair of windows is compared
    twice, whatever the length of the text.
    """

    def covered(places: Column) -> Column:
        both = F.flatten(F.array(places, F.transform(places, lambda p: p + 1), F.transform(places, lambda p: p + 2)))
        return F.size(F.array_distinct(both))

    def repeated(found: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            same = F.get(found, i - 1)["window"].eqNullSafe(x["window"]) | F.get(found, i + 1)["window"].eqNullSafe(x["window"])
            return F.when(same, x["place"])

        places = F.filter(F.transform(found, place), lambda p: p.isNotNull())
        return F.when(F.size(places) == 0, 0).otherwise(with_value(places, covered))

    def windows(w: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            return F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("window"), i.alias("place"))

        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), window)

    return with_value(words, lambda w: with_value(F.sort_array(windows(w)), repeated))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures of every text and whether it fails a base rule; a null text has no words.

    Columns: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    words = F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    measured = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("_text"))
        .withColumn("_words", word_list(F.col("_text")))
        .select(
            "doc_id",
            "host",
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            with_value(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeat_words(words).cast("bigint").alias("n_repeat_words"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return measured.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Each host's failures and shrunk failure rate, and whether it is rejected.

    The beta prior has the mean of the hosts' rates; its strength comes from their variance, less the
    variance that counting alone gives. A null host is a host of its own. Columns: host, host_docs,
    host_failed, host_rate, host_rejected.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("host_failed")
    )
    hosts = stored(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("n"))
    spread = F.col("m") * (1 - F.col("m"))
    between = F.col("v") - spread * F.col("n")
    low, high = PRIOR_STRENGTH
    strength = F.when(between > 0, F.least(F.greatest(spread / between - 1, F.lit(low)), F.lit(high))).otherwise(high)
    prior = moments.select(F.struct(F.col("m"), strength.alias("k")).alias("prior"))
    shrunk = (F.col("host_failed") + F.col("_prior.m") * F.col("_prior.k")) / (F.col("host_docs") + F.col("_prior.k"))
    return (
        hosts.withColumn("_prior", prior.scalar())
        .withColumn("host_rate", shrunk)
        .withColumn("host_rejected", F.col("host_rate") > max_rate)
        .drop("_prior")
    )


def apply_host_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """Base measures and verdicts of every document: kept unless it or its host fails.

    Texts are read once; what is counted, shuffled and joined is a narrow stored table. Repeated rows stay
    repeated; null texts are empty and so fail; null hosts are one host; no rows give no rows. Other columns
    are not read.
    """
    measured = stored(base_rules(docs, id_col, text_col, host_col), "base-rules")
    key = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("")).alias("_key")
    verdicts = host_verdicts(measured, max_rate).select(key, "host_rate", "host_rejected")
    return (
        lookup_join(measured.select("*", key), verdicts, ["_key"], "left")
        .drop("_key")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )
