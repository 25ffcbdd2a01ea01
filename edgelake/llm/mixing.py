"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are dealt into blocks by hash, each source's blocks are put in a random order, and a source draws
whole blocks along that order until its target is met: whole passes first, then a part of a pass. How many
blocks each output shard takes of each source is drawn by a tree: a node's exact quotas are split between its
two halves by a multivariate-hypergeometric draw, down to single shards. A source's order is then cut by
these quotas, so shards get disjoint runs of permuted blocks: a block is taken as often as it lies in such runs.
Copies are shuffled inside their shard by a hash.
Spark functions only; what is random is a hash of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelake.llm.words import with_value, word_count
from edgelake.operators.scale import lookup_join
from edgelake.session import scratch, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARD_LEVELS = 6
BLOCK_DOCS = 256
MAX_BLOCKS = 65_536
SEED = "mix"


def hashed(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts' text: the same in any SQL engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources: shares of all words by weight, at most ``max_repeats`` times a source's size.

    ``sizes`` has one row per source (source, n_docs, source_size). Sources in code-point order, null last,
    take the weights in turn. What stops at a cap is shared again by weight: target = min(cap, weight * level),
    with the level at which targets add up to all words. Adds weight and target.
    """
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighted = sizes.withColumn("turn", turn).withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("turn", F.lit(len(weights))))
    )
    cap = F.col("source_size") * max_repeats
    order = [F.col("source_size") / F.col("weight"), F.col("turn")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        weighted.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_level", level)
        .withColumn("_level", F.min(F.when(cap / F.col("weight") >= F.col("_level"), F.struct(*order, "_level"))).over(everything)["_level"])
        .withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("_level")))
        .drop("_all", "_level")
    )


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among ``good``, by inversion at ``u`` in [0, 1).

    Terms are followed by their ratios from 12 standard deviations below the mean to 12 above; beyond them
    lies less than a double can tell.
    """
    n, k, d = total.cast("double"), good.cast("double"), draws.cast("double")
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    sd = F.when(n > 1, F.sqrt(mean * (1 - k / n) * (n - d) / (n - 1))).otherwise(0.0)
    low = F.greatest(F.lit(0.0), d + k - n, F.floor(mean - 12 * sd - 12).cast("double"))
    high = F.least(k, d, F.ceil(mean + 12 * sd + 12).cast("double"))

    def walk(p: Column) -> Column:
        def ratio(x: Column) -> Column:
            return (p["k"] - x) * (p["d"] - x) / ((x + 1) * (p["n"] - p["k"] - p["d"] + x + 1))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), p["low"].cast("bigint").alias("x"))
        steps = F.sequence(p["low"].cast("bigint"), p["high"].cast("bigint"))
        whole = F.aggregate(steps, start, lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s"), x.alias("x")))["s"]
        return with_value(whole * p["u"], lambda mark: F.least(p["high"].cast("bigint"), F.aggregate(
            steps, start,
            lambda a, x: F.struct(
                (a["w"] * ratio(x)).alias("w"),
                (a["s"] + a["w"]).alias("s"),
                F.when(a["s"] + a["w"] <= mark, x + 1).otherwise(a["x"]).alias("x"),
            ),
        )["x"]))

    return with_value(
        F.struct(n.alias("n"), k.alias("k"), d.alias("d"), low.alias("low"), high.alias("high"), u.alias("u")), walk
    )


def split_quotas(quotas: DataFrame, levels: int = SHARD_LEVELS, seed: str = SEED) -> DataFrame:
    """Quotas of sources (turn, quota) dealt over 2 ** levels shards: turn, shard, quota.

    A node of the tree is one row with its quotas, one entry per source. Of the blocks in a node half go left,
    and how many of each source is drawn source by source without replacement, so quotas add up exactly.
    """
    entry = F.struct(F.col("turn"), F.col("quota").cast("bigint").alias("quota"))
    nodes = quotas.agg(F.sort_array(F.collect_list(entry)).alias("quotas")).select(F.lit(0).alias("shard"), "quotas")
    for level in range(levels):
        def left_part(total: Column, level: int = level) -> Column:
            def draw(a: Column, q: Column) -> Column:
                u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), q["turn"]), F.lit(1 << 53)) / F.lit(float(1 << 53))
                return with_value(hypergeometric(a["total"], q["quota"], a["draws"], u), lambda x: F.struct(
                    (a["total"] - q["quota"]).alias("total"),
                    (a["draws"] - x).alias("draws"),
                    F.concat(a["left"], F.array(F.struct(q["turn"].alias("turn"), x.alias("quota")))).alias("left"),
                ))

            start = F.struct(
                total.alias("total"),
                F.floor(total / 2).alias("draws"),
                F.array().cast("array<struct<turn:int,quota:bigint>>").alias("left"),
            )
            return F.aggregate("quotas", start, draw)["left"]

        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, q: a + q["quota"])
        nodes = nodes.withColumn("_left", with_value(total, left_part))
        right = F.zip_with("quotas", "_left", lambda q, x: F.struct(q["turn"].alias("turn"), (q["quota"] - x["quota"]).alias("quota")))
        children = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("_left").alias("quotas")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quotas")),
        )
        nodes = nodes.select(F.explode(children).alias("c")).select("c.shard", "c.quotas")
    return nodes.select("shard", F.explode("quotas").alias("q")).select("q.turn", "shard", "q.quota")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    levels: int = SHARD_LEVELS,
    seed: str = SEED,
) -> DataFrame:
    """How often the mix takes each document, and into which output shards.

    Columns: doc_id, source, size (words), source_size, target, taken (words, repeats counted), copies, shards
    (one number per copy). A source's last, partly drawn block takes its documents in hash order as long as
    they fit, so what is left of a target is less than any document of that block that stays out.

    Texts are read once; all else works on a narrow stored table. Sources are a list that fits in one task (one
    row each); a source of any size is spread over its blocks. Null ids are hashed as empty text, a null source
    is a source of its own, a null or empty text has size 0, repeated rows are drawn alike in whole blocks and
    one by one in the last, and no rows give no rows. Other columns are not read.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_key")
    sized = stored(sized.select("*", key), "sized")
    sizes = sized.groupBy("_key", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    blocks_of = F.least(F.greatest(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.lit(1)), F.lit(MAX_BLOCKS)).cast("bigint")
    sources = (
        targets(sizes, weights, max_repeats)
        .withColumn("whole", F.least(whole, F.lit(max_repeats).cast("bigint")))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("n_blocks", blocks_of)
    )
    sources = stored(sources, "sources")
    dealt = lookup_join(sized, sources.select("_key", "n_blocks"), ["_key"]).withColumn(
        "block", F.pmod(hashed(seed, F.col("doc_id")), "n_blocks")
    )
    dealt = stored(dealt.drop("n_blocks"), "dealt")

    order = Window.partitionBy("_key")
    permuted = order.orderBy(hashed(seed, "block", F.col("_key"), F.col("block")), "block")
    along = permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = dealt.groupBy("_key", "block").agg(F.sum("size").alias("words"))
    blocks = lookup_join(blocks, sources.select("_key", "turn", "whole", "rest"), ["_key"])
    after = F.sum("words").over(along)
    blocks = (
        blocks.withColumns({"place": F.row_number().over(permuted) - 1, "held": F.count(F.lit(1)).over(order), "after": after})
        .withColumn("before", F.col("after") - F.col("words"))
        .withColumn("full", (F.col("whole") < max_repeats) & (F.col("after") <= F.col("rest")))
        .withColumn("part", (F.col("whole") < max_repeats) & ~F.col("full") & (F.col("before") < F.col("rest")))
    )
    blocks = stored(blocks, "blocks")

    drawn = F.col("whole") + (F.col("full") | F.col("part")).cast("bigint")
    quotas = blocks.groupBy("turn").agg(F.sum(drawn).alias("quota"))
    ends = split_quotas(quotas, levels, seed).groupBy("turn").agg(
        F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("_quotas")
    )
    running = F.aggregate(
        "_quotas",
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("ends")),
        lambda a, q: F.struct((a["sum"] + q["quota"]).alias("sum"), F.concat(a["ends"], F.array(a["sum"] + q["quota"])).alias("ends")),
    )["ends"]
    cuts = ends.select("turn", running.alias("ends"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(max_repeats)), lambda p: p * F.col("held") + F.col("place"))
    shards = F.transform(numbers, lambda j: F.size(F.filter("ends", lambda e: e <= j)))
    inside = F.filter(shards, lambda shard: shard < 1 << levels)
    blocks = lookup_join(blocks, cuts, ["turn"]).select(
        "_key", "block", "part", (F.col("rest") - F.col("before")).alias("room"), inside.alias("shards")
    )

    placed = dealt.join(blocks, ["_key", "block"])
    whole_blocks = placed.where(~F.col("part")).select(
        "doc_id", "source", "_key", "size", F.size("shards").cast("bigint").alias("copies"), "shards"
    )
    item = F.struct(hashed(seed, "doc", F.col("doc_id")).alias("h"), F.col("size"), F.col("doc_id"), F.col("source"))
    fitting = F.aggregate(
        "items",
        F.struct(F.col("room"), F.array().cast("array<boolean>").alias("taken")),
        lambda a, x: with_value(x["size"] <= a["room"], lambda fits: F.struct(
            F.when(fits, a["room"] - x["size"]).otherwise(a["room"]).alias("room"),
            F.concat(a["taken"], F.array(fits)).alias("taken"),
        )),
    )["taken"]
    parts = (
        placed.where("part")
        .groupBy("_key", "block", "room", "shards")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .withColumn("taken", fitting)
        .select("_key", "shards", F.explode(F.arrays_zip("items", "taken")).alias("x"))
        .select(
            F.col("x.items.doc_id").alias("doc_id"),
            F.col("x.items.source").alias("source"),
            "_key",
            F.col("x.items.size").alias("size"),
            F.greatest(F.size("shards") - F.when(F.col("x.taken"), 0).otherwise(1), F.lit(0)).cast("bigint").alias("copies"),
            "shards",
        )
    )
    chosen = whole_blocks.unionByName(parts)
    return lookup_join(chosen, sources.select("_key", "source_size", "target"), ["_key"], small=True).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        F.slice("shards", F.lit(1), F.col("copies").cast("int")).alias("shards"),
    )


ADDED = ("size", "target", "taken", "copies", "shards")
PART_COPIES = 100_000


def added_names(columns: list[str], added: tuple[str, ...] = ADDED) -> dict[str, str]:
    """Names of the columns that a mix adds: as they are, with ``mix_`` before them where a column has that name."""
    out = {}
    for name in added:
        free = name
        while free in columns:
            free = f"mix_{free}"
        out[name] = free
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix draws, with all their columns and size, target, taken, copies and shards.

    An added column whose name ``docs`` have is called ``mix_`` and the name. Rows without an id are drawn alike within their source, as
    often as the one that is drawn most.
    """
    def key(id_: str, source: str) -> list[Column]:
        return [
            F.col(id_).isNull().alias("_no_id"), F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("_source"),
        ]

    keys = ["_no_id", "_id", "_source"]
    with scratch(docs.sparkSession) as outlive:
        plan = mix(docs, id_col, text_col, source_col).select(*key("doc_id", "source"), F.struct("copies", "size", "target", "taken", "shards").alias("_plan"))
        drawn = outlive(plan.groupBy(*keys).agg(F.max("_plan").alias("_plan")).where("_plan.copies > 0"), "plan")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *key(id_col, source_col))
    return lookup_join(rows, drawn, keys).select(
        "_row.*", *[F.col("_plan")[name].alias(free) for name, free in added_names(docs.columns).items()]
    )


def mixed_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = SEED, part_copies: int = PART_COPIES,
) -> DataFrame:
    """The mix itself: a row per drawn copy, shuffled inside its shard, with the columns of ``mixed_documents``, copy and shard.

    The order in a shard is a hash. A shard of many copies is cut at places of that order into parts of about ``part_copies``
    rows, one to a task; a shard's parts one after another are the shuffled shard. Rows without an id are told apart by their
    texts. Names that are taken begin with ``mix_``; no rows give no rows.
    """
    mixed = mixed_documents(docs, id_col, text_col, source_col)
    names = added_names(mixed.columns, ("copy", "shard"))
    shards = F.col("_row")[added_names(docs.columns)["shards"]]
    hashed_row = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    rows = mixed.select(F.struct(*mixed.columns).alias("_row"), hashed_row.alias("_hash"))
    copies = rows.select("_row", "_hash", F.posexplode(shards).alias("_copy", "_shard"))
    parts = -(-MAX_REPEATS * docs.count() // (part_copies << SHARD_LEVELS)) or 1
    place = F.shiftrightunsigned(F.xxhash64("_hash", "_copy", "_shard"), 1)
    dealt = copies.withColumn("_place", place).withColumn("_part", F.floor(F.col("_place") / (2.0**63 / parts)))
    return (
        dealt.repartition("_shard", "_part")
        .sortWithinPartitions("_shard", "_place")
        .select("_row.*", F.col("_copy").alias(names["copy"]), F.col("_shard").alias(names["shard"]))
    )
