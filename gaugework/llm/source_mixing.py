"""Mixing sources to target weights with DataFrame functions only.

Words are packed, source by source, into blocks of a fixed length. Every slot of every output shard draws its source
with the probability of the source's target, so a shard's counts by source are multinomial. Over the whole corpus such
counts miss the targets by about their square root, so in the end the slots that a source has too many, spread evenly
over its shards, go to the sources that have too few: about a slot in 200 in a table of 100,000 slots, fewer in larger
ones. Slots of a source are numbered over all shards; slot i takes block perm(i mod n) of the source's n blocks, where
perm is another pseudorandom permutation of the indices in each pass over the source. Blocks then meet slots by index.

Edge cases: a null text has size 0 and takes 0 words; null is a source of its own, the last; repeated rows count each
for itself, those with the same doc_id and size by their other columns, and then in any order; an empty table gives an
empty result; other columns, whatever their names, are ignored by mix_sources and kept by mix_documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm.common import WORD, word_count, written

SPACE = r"[\x20\x09-\x0D]"
#: Documents of a source whose running sums one window holds; chunks of a run that the next window holds; shards of a run.
CHUNK_DOCS, RUN_CHUNKS, RUN_SHARDS = 256, 1024, 4096
#: Parts of the tickets of all sources, to find a ticket's source by an equality join.
TICKET_PARTS = 4096
BACK = (Window.unboundedPreceding, -1)


def before(size: str, by: tuple[str, ...], *order: str) -> Column:
    """The sum of a column over the rows before this one."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*BACK)), F.lit(0))


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: float, share: float) -> DataFrame:
    """One row a source: src (its rank), source, source_size, target.

    Sources stand by code point, null last, with the weights in turn. They share ``share`` of all sizes; a target
    stops at ``cap`` times the source's size and the excess is shared again by weight: the level that all the others
    reach is found with running sums over the sources in the order in which they fill up.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") % len(weights)) + 1).cast("int"))
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn(
        "src", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long") - 1
    ).withColumn("w", w.cast("double"))
    every = Window.partitionBy()
    fill = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(fill), F.lit(0.0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))
    each = each.withColumn("level", (share * F.sum("source_size").over(every) - before) / rest)
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every), F.max("ratio").over(every))
    return each.withColumn("target", F.least(cap * F.col("source_size"), level * F.col("w"))).select("src", "source", "source_size", "target")


def permuted(rows: DataFrame, i: str, n: str, keys: tuple[Column, ...], rounds: int = 10) -> DataFrame:
    """Rows with i replaced by its place in a pseudorandom permutation of 0 to n-1 that the keys choose: swap-or-not
    rounds, so any n will do. Each round is a column of its own, so that all are compiled."""
    x, partner = F.col(i), F.col("_partner")
    for r in range(rounds):
        rows = rows.withColumn("_partner", F.pmod(F.pmod(F.xxhash64(*keys, F.lit(r)), F.col(n)) - x, F.col(n)))
        swap = F.xxhash64(*keys, F.lit(r), F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        rows = rows.withColumn(i, F.when(swap, partner).otherwise(x))
    return rows.drop("_partner")


def placed(sized: DataFrame, sources: DataFrame, n_docs: int, *keys: str) -> DataFrame:
    """Documents with the place of their first word among all words of their source: sums in chunks, runs of chunks, and runs.

    keys: columns that go along and order rows of the same doc_id and size.
    """
    chunks = n_docs // CHUNK_DOCS + 1
    rows = sized.join(sources.select("src", "source"), sized["source"].eqNullSafe(sources["source"]))
    rows = rows.select("src", "doc_id", "size", *keys, F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"))
    rows = rows.withColumn("run", F.floor(F.col("chunk") / RUN_CHUNKS))
    by_chunk = rows.groupBy("src", "run", "chunk").agg(F.sum("size").alias("n"))
    by_run = by_chunk.groupBy("src", "run").agg(F.sum("n").alias("n"))
    by_run = by_run.select("src", "run", before("n", ("src",), "run").alias("run_start"))
    by_chunk = by_chunk.select("src", "run", "chunk", before("n", ("src", "run"), "chunk").alias("chunk_start"))
    starts = by_chunk.join(by_run, ["src", "run"]).select("src", "chunk", (F.col("chunk_start") + F.col("run_start")).alias("base"))
    one, order = ("src", "chunk"), ("doc_id", "size", *keys)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*one).orderBy(*order)))
    rows = rows.withColumn("start", before("size", one, *order)).join(starts, list(one))
    return rows.select("src", "chunk", "nth", "doc_id", "size", (F.col("start") + F.col("base")).alias("start"), *keys)


def by_ticket(numbers: DataFrame, owners: DataFrame, total: int) -> DataFrame:
    """Each number, below total, with the src and the first number of the owner whose range [first, first + n) has it."""
    width = -(-max(total, 1) // TICKET_PARTS)
    parts = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width))
    ranges = owners.where("n > 0").select("src", "first", "n", F.explode(parts).alias("part"))
    found = numbers.withColumn("part", F.floor(F.col("number") / width)).join(ranges, "part")
    return found.where("number >= first and number < first + n").drop("part", "n")


def drawn_counts(spark: SparkSession, plan: DataFrame, total: int, slots_per_shard: int, seed: int, parts: int) -> DataFrame:
    """src, shard, n: the multinomial draw. Every one of the total slots picks one of as many tickets, which the sources
    have by their numbers of draws. ``plan`` has src and draws."""
    ticket = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(total))
    slots = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / slots_per_shard).alias("shard"), ticket.alias("number"))
    owners = plan.select("src", F.col("draws").alias("n"), before("draws", (), "src").alias("first"))  # a row a source
    return by_ticket(slots, owners, total).groupBy("src", "shard").agg(F.count("*").alias("n"))


def settled(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """src, first, n: the slots first to first + n - 1 of a source, from the drawn counts, so that each source has exactly its draws.

    Of a source with N slots that may have T, every N / (N - T)-th slot goes to the sources that lack some.
    """
    counts = counts.withColumn("run", F.floor(F.col("shard") / RUN_SHARDS))
    by_run = counts.groupBy("src", "run").agg(F.sum("n").alias("in_run"))
    by_run = by_run.select("src", "run", "in_run", before("in_run", ("src",), "run").alias("run_start"))
    have = by_run.groupBy("src").agg(F.sum("in_run").alias("have"))
    have = plan.select("src", "draws").join(have, "src", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    have = have.withColumns({
        "over": F.greatest(F.col("have") - F.col("draws"), F.lit(0)), "lack": F.greatest(F.col("draws") - F.col("have"), F.lit(0))
    })
    have = have.withColumns({"over_first": before("over", (), "src"), "lack_first": before("lack", (), "src")})  # a row a source
    have = written(have, "mix-have")
    rows = counts.withColumn("in_turn", before("n", ("src", "run"), "shard")).join(by_run, ["src", "run"]).join(have, "src")
    rows = rows.withColumn("first", F.col("in_turn") + F.col("run_start"))
    given = lambda x: F.expr(f"cast(cast({x} as decimal(20,0)) * cast(over as decimal(18,0)) div have as bigint)")
    rows = rows.withColumns({"gone": given("first"), "gone_after": given("(first + n)")})
    kept = rows.select("src", (F.col("first") - F.col("gone")).alias("first"), (F.col("n") - F.col("gone_after") + F.col("gone")).alias("n"))
    freed = F.sequence(F.col("over_first") + F.col("gone"), F.col("over_first") + F.col("gone_after") - 1)
    spare = rows.where("gone_after > gone").select(F.explode(freed).alias("number"))
    lacking = have.select("src", F.col("lack_first").alias("first"), F.col("lack").alias("n"))
    total = have.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]
    more = by_ticket(spare, lacking, total).join(have.select("src", "have"), "src")
    more = more.select("src", (F.col("have") + F.col("number") - F.col("first")).alias("first"), F.lit(1).cast("long").alias("n"))
    return kept.where("n > 0").unionByName(more)


def drawn(
    sized: DataFrame, weights: tuple[int, ...], cap: int, share: float, block_words: int, slots_per_shard: int, seed: int, *keys: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources, the rows in their places, and each row's blocks with their words and times (null: not drawn)."""
    spark = sized.sparkSession
    n_docs = sized.count()
    sources = written(source_targets(sized, weights, cap, share), "mix-sources")
    plan = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    draws = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), cap * F.col("blocks"))
    plan = written(plan.select("src", "blocks", draws.alias("draws")), "mix-plan")
    total = plan.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / 100_000))
    counts = written(drawn_counts(spark, plan, total, slots_per_shard, seed, parts), "mix-counts")
    slots = settled(counts, plan).join(plan.select("src", "blocks"), "src").repartition(parts, "src", "first")
    slots = slots.select("src", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    slots = slots.select("src", "blocks", F.floor(F.col("slot") / F.col("blocks")).alias("pass"), (F.col("slot") % F.col("blocks")).alias("block"))
    slots = permuted(slots, "block", "blocks", (F.lit(seed), F.col("src"), F.col("pass")))
    # a written table: the join below would push its filters into the rounds, whose expressions grow fourfold with each
    times = written(slots.groupBy("src", "block").agg(F.count("*").alias("times")), "mix-times")
    rows = placed(sized, sources, n_docs, *keys)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    held = rows.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)).alias("block"))
    ends = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    words = ends - F.greatest(F.col("start"), F.col("block") * block_words)
    held = held.select("src", "chunk", "nth", "doc_id", "size", "start", *keys, "block", words.alias("words"))
    return sources, rows, held.join(times, ["src", "block"], "left")


def mix_sources(
    docs: DataFrame, weights: tuple[
        int, ...
    ] = (5, 2, 1), cap: int = 3, share: float = 1.0, block_words: int = 32, slots_per_shard: int = 4096, seed: int = 20
) -> DataFrame:
    """doc_id, size, source_size, target and taken (the words that the mix takes of this document, repeats counted).

    No block is taken more than ``cap`` times, so no document exceeds ``cap`` times its size.
    """
    sized = written(docs.select("doc_id", "source", word_count(docs["text"]).alias("size")), "mix-sized")
    sources, rows, held = drawn(sized, weights, cap, share, block_words, slots_per_shard, seed)
    taken = F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")
    taken = held.groupBy("src", "chunk", "nth", "doc_id", "size").agg(taken)
    none = rows.where("size = 0").select("src", "chunk", "nth", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).join(sources, "src").select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(
    docs: DataFrame, weights: tuple[
        int, ...
    ] = (5, 2, 1), cap: int = 3, share: float = 1.0, block_words: int = 32, slots_per_shard: int = 4096, seed: int = 20
) -> DataFrame:
    """The mix as documents with the columns of ``docs``: copy c of a document has the blocks that are drawn c times or
    more, in their order and with the white space behind their words; n_chars, if there is one, follows.

    A copy with every block is the document as it is. Rows are drawn each for itself, also where they share a doc_id.
    """
    rows = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-docs")
    others = F.to_json(F.struct(*(F.col(f"doc.`{c}`") for c in docs.columns if c != "text")))
    sized = rows.select("doc.doc_id", "doc.source", word_count(F.col("doc.text")).alias("size"), F.xxhash64("doc.text", others).alias("hash"), "row")
    _, _, held = drawn(written(sized, "mix-sized"), weights, cap, share, block_words, slots_per_shard, seed, "hash", "row")
    blocks = F.sort_array(F.collect_list(F.struct("block", F.coalesce("times", F.lit(0)).alias("times"))))
    each = held.groupBy("row").agg(blocks.alias("blocks"), F.min(F.col("start") % block_words).alias("skip"))
    each = each.select("row", "skip", F.col("blocks.times").alias("times"))
    each = each.withColumns({"least": F.array_min("times"), "most": F.array_max("times")}).where("most > 0")
    rows = rows.join(written(each, "mix-drawn"), "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "most")))
    words = F.regexp_extract_all("doc.text", F.lit(rf"(?:\A{SPACE}+)?{WORD}{SPACE}*"), F.lit(0))
    is_drawn = lambda _, i: F.get("times", F.floor((F.col("skip") + i) / block_words).cast("int")) >= F.col("copy")
    whole = F.col("copy") <= F.col("least")
    rows = rows.withColumn("text", F.when(whole, F.col("doc.text")).otherwise(F.array_join(F.filter(words, is_drawn), "")))
    own = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(whole, own["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(x.alias(c) for c, x in own.items()))
