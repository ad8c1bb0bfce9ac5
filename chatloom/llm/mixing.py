"""Mix sources to target weights along a low-discrepancy schedule.

The sources' targets are laid end to end on [0, 1). Slot n of the mix takes the
source in which the n-th van der Corput point lies, so every stretch of the mix
is close to the target weights. Each source is a line of its documents in a
shuffled order, cut into blocks of equally many words; a source's r-th slot takes
its r-th block, and after its end the line starts again, at most three times.

Only DataFrame operations: a source with a third of all words is cut into hash
buckets for its running sum and into chunks of slots for its ranks.

Defined cases: a null text has size 0 and, like an empty one, is taken 0 times; a
null source is a source of its own, last in order; repeated rows are documents of
their own; an empty table gives no rows; further columns are carried by
``mix_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.llm.common import BUCKET, buckets_of, pinned, running_total

# Fixed values of the contract: what counts as a word, the weights in order of
# the sources, and how often a source may be repeated.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3

POINT_BITS = 48
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_no, weight, source_size, target) from (source, size).

    Sorted by the size a unit of weight can draw on, the sources that reach their
    limit come first. A source is at its limit if all before it are and its share
    of what they leave is not below the limit; this is where resharing ends.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    sources = (
        sources.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("weight", weight.cast("bigint"))
        .withColumn("_limit", F.lit(MOST_PASSES) * F.col("source_size"))
    )
    by_limit = Window.orderBy(F.col("_limit") / F.col("weight"), "source_no")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    sources = sources.withColumns({"_left": left, "_weights": weights})
    open_ = F.col("_limit") / F.col("weight") > F.col("_left") / F.col("_weights")
    first = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_open = F.min(F.when(open_, F.struct(F.col("_limit") / F.col("weight"), "source_no", "_left", "_weights"))).over(first)
    sources = sources.withColumn("_open", first_open)
    shared = (F.col("_open._left") * F.col("weight")).cast("double") / F.col("_open._weights")
    capped = F.col("_open").isNull() | (
        F.struct(F.col("_limit") / F.col("weight"), "source_no")
        < F.struct(F.col("_open.col1"), F.col("_open.source_no"))
    )
    return sources.select(
        "source", "source_no", "weight", "source_size",
        F.when(capped, F.col("_limit").cast("double")).otherwise(shared).alias("target"),
    )


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """(slot, source_no, block): the sources in mixing order, and each one's blocks.

    ``sources`` has source_no and ``_words``, the words to take. Points come in a
    number that covers all words; the few blocks by which the points miss a
    source's words close the schedule, and slots beyond them are dropped.
    """
    spark = sources.sparkSession
    count = buckets_of(spark)
    order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.coalesce(F.sum("_words").over(order), F.lit(0))
    spans = (
        sources.filter("_words > 0")
        .withColumns({"_low": low, "_all": F.sum("_words").over(whole)})
        .withColumns({
            "_from": F.col("_low") / F.col("_all"),
            "_to": (F.col("_low") + F.col("_words")) / F.col("_all"),
        })
    )
    slots_needed = F.ceil(F.col("_all") / F.lit(block_words)).cast("bigint")
    # One number: how many slots the schedule has.
    found = spans.select(F.max(slots_needed)).first()[0] or 0
    bits = F.reverse(F.lpad(F.bin("id"), POINT_BITS, "0"))
    slots = spark.range(found).select(
        F.col("id").alias("slot"),
        (F.conv(bits, 2, 10).cast("double") / F.lit(float(2**POINT_BITS))).alias("_point"),
        F.floor(F.col("id") * count / F.lit(max(found, 1))).cast("int").alias(BUCKET),
    ).withColumn("_cell", F.floor(F.col("_point") * CELLS).cast("int"))
    last = F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = spans.select(
        "source_no", "_from", "_to",
        F.explode(F.sequence(F.floor(F.col("_from") * CELLS).cast("int"), last)).alias("_cell"),
    )
    placed = slots.join(cells, "_cell").filter("_point >= _from AND _point < _to")
    placed = placed.select("slot", BUCKET, "source_no")
    ranked = running_total(placed, ["source_no"], ["slot"], F.lit(1), "block").drop(BUCKET)
    given = ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("_given"))
    due = F.ceil(F.col("_words") / F.lit(block_words)).cast("bigint")
    wanted = spans.select("source_no", due.alias("_due")).join(given, "source_no", "left")
    missed = wanted.fillna(0, ["_given"]).filter("_given < _due").select(
        F.lit(found).alias("slot"), "source_no",
        F.explode(F.sequence(F.col("_given"), F.col("_due") - 1)).alias("block"),
    )
    kept = ranked.join(wanted.select("source_no", "_due"), "source_no").filter("block < _due")
    return kept.select("slot", "source_no", "block").unionByName(missed)


def mix(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
    block_words: int = 256, seed: str = "mix",
) -> DataFrame:
    """One row per document: size, its source's size and target, words taken.

    Columns: id, source, size, source_size, target, taken, and ``text_hash``, by
    which ``mix_documents`` finds the text again.
    """
    spark = docs.sparkSession
    count = buckets_of(spark)
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("-"))))
    sized = pinned(docs.select(
        F.col(id).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("text_hash"), shuffled.alias("_place"),
    ))
    # One row per source; the other plans read it several times.
    sources = pinned(targets(sized))
    sources = sources.withColumn("_words", F.floor(F.col("target") + 0.5).cast("bigint"))
    part = F.floor(F.conv(F.substring("_place", 1, 8), 16, 10).cast("double") * count / float(2**32))
    known = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("_source")
    lined = (
        sized.select("*", known, part.cast("int").alias(BUCKET))
        .join(sources.select(known, "source_no", "source_size", "target", "_words"), "_source")
        .drop("_source")
    )
    lined = pinned(running_total(lined, ["source_no"], ["_place", "_id", "text_hash"], F.col("size"), "start"))
    turns = F.ceil((F.col("_words") - F.col("start")) / F.col("source_size")).cast("int") - 1
    passes = lined.filter("size > 0 AND start < _words").select(
        "source_no", "start", "size", "_words", "source_size",
        F.explode(F.sequence(F.lit(0), turns)).alias("pass"),
    ).withColumn("_at", F.col("start") + F.col("pass") * F.col("source_size"))
    end = F.least(F.col("_at") + F.col("size"), F.col("_words"))
    pieces = passes.withColumn("_end", end).select(
        "source_no", "start", "_at", "_end",
        F.explode(F.sequence(
            F.floor(F.col("_at") / block_words), F.floor((F.col("_end") - 1) / block_words)
        )).alias("block"),
    )
    overlap = F.least("_end", (F.col("block") + 1) * block_words) - F.greatest("_at", F.col("block") * block_words)
    taken = (
        pieces.join(schedule(sources, block_words), ["source_no", "block"])
        .groupBy("source_no", "start").agg(F.sum(overlap).alias("taken"))
        .withColumn("_any", F.lit(True))
    )
    # Among documents with words, (source_no, start) is unique.
    words = lined.withColumn("_any", F.col("size") > 0)
    return words.join(taken, ["source_no", "start", "_any"], "left").select(
        F.col("_id").alias(id), "source", "text_hash", "start", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mix_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows: each document as often as it is taken.

    Whole passes repeat the row. The one document per source at which the words
    end comes with its first words only, joined by blanks.
    """
    names = docs.columns
    plan = mix(docs, id=id, text=text, source=source, **options).select(
        F.struct(id, "source").alias("_key"), F.col("text_hash").alias("_hash"), "start", "size", "taken"
    )
    null_safe = lambda key: F.to_json(key, {"ignoreNullFields": "false"})
    plan = plan.withColumn("_key", null_safe("_key"))
    rows = docs.select(
        F.struct(*names).alias("_row"),
        null_safe(F.struct(F.col(id).alias(id), F.col(source).alias("source"))).alias("_key"),
        F.xxhash64(text).alias("_hash"),
    )
    same = Window.partitionBy("_key", "_hash")
    # Rows equal in all three share a plan row each.
    plan = plan.withColumn("_copy", F.row_number().over(same.orderBy("start")))
    rows = rows.withColumn("_copy", F.row_number().over(same.orderBy("_hash")))
    joined = rows.join(plan.filter("taken > 0"), ["_key", "_hash", "_copy"])
    takes = F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))
    repeated = joined.select("_row", "size", "taken", F.explode(takes).alias("_pass"))
    left = (F.col("taken") - F.col("_pass") * F.col("size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"_row.{text}"), F.lit(WORD), F.lit(0)), 1, left), " ")
    cut = F.when(left < F.col("size"), first).otherwise(F.col(f"_row.{text}"))
    return repeated.select(*[cut.alias(n) if n == text else F.col(f"_row.{n}").alias(n) for n in names])
