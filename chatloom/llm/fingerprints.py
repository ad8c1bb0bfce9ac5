"""Document fingerprints by improved consistent weighted sampling.

A text is its words with their counts. For sample k and a word of weight w the
word's hash gives r and c from Gamma(2, 1) and b from [0, 1); with
t = floor(ln w / r + b) the word's value is ln a = ln c - r (t - b + 1), and the
sample is the (word, t) of the smallest value. Two texts agree in a sample with
the probability of their generalised Jaccard similarity, sum of minima over sum
of maxima of the counts. A sample is kept as one number, the value's leading bits
above a hash of (word, t).

Only DataFrame operations. A value depends on nothing but the word, its count and k,
so ``neighbour_fingerprints`` works it out once for all texts of a range. ``neighbour_fingerprints`` shuffles the texts once, by
ranges of the id; the row that begins a range is sent to the range before it as
well, so a document's successor is always in its own partition and the counts,
minima and comparisons need no further exchange.

Defined cases: a null text counts as empty; texts without words have no samples,
are alike (1.0) to each other and unlike (0.0) any other; rows of one id follow
each other in order of their texts' hashes and repeated rows each give a row;
null ids come first; a single row is its own successor; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.operators.scan import starts_at_or_before

SAMPLES = 64
TOGETHER = 8
# Of a word's number: counts up to 16 million are exact.
COUNT_BITS = 24
NOT_IN_WORDS = r"[^\p{L}\p{N}]+"
LOW_BITS = 24


def weighted_words(text: Column) -> Column:
    """The distinct words of a text with their counts, a number each: leading bits of
    the word's hash above the count. Null where there is no word."""
    words = F.array_remove(F.split(F.lower(text), NOT_IN_WORDS), "")
    counted = F.lit(2**COUNT_BITS - 1).cast("bigint")

    def runs(hashes: Column) -> Column:
        n = F.size(hashes)
        first = F.filter(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 1) | (F.get(hashes, i - 1) != F.get(hashes, i - 2)),
        )
        return F.get(F.transform(F.array(first), lambda starts: F.transform(starts, lambda v, j: F.get(hashes, v - 1).bitwiseOR(
            F.least((F.coalesce(F.get(starts, j + 1), n + 1) - v).cast("bigint"), counted)
        ))), F.lit(0))

    hashed = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.bitwise_not(counted)))
    # As a lambda's argument the sorted hashes are worked out once.
    return F.get(F.transform(F.array(F.sort_array(hashed)), runs), F.lit(0))


def _bits(hash: Column, shift: int, width: int) -> Column:
    """Some bits of a hash as a number from 0.5 to 2**width - 0.5."""
    return F.shiftrightunsigned(hash, shift).bitwiseAND(F.lit(2**width - 1).cast("bigint")).cast("double") + 0.5


def sample(k: int, term: Column, log_weight: Column) -> Column:
    """Sample k's value of one weighted word; a text's sample is the minimum."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    # Minus the logarithm of a product of two uniforms is Gamma(2, 1).
    r = -F.ln(_bits(one, 0, 24) * _bits(one, 24, 24) * F.lit(2.0**-48))
    c = -F.ln(_bits(two, 0, 24) * _bits(two, 24, 24) * F.lit(2.0**-48))
    b = _bits(one, 48, 16) * F.lit(2.0**-16)
    t = F.floor(log_weight / r + b)
    value = F.ln(c) - r * (t.cast("double") - b + 1.0)
    # ln a lies in (-1000, 1000): 39 bits with 2**-28 as the unit, then 24 bits of (word, t).
    high = F.floor((value + 1000.0) * F.lit(2.0**28)).cast("bigint")
    low = F.shiftrightunsigned(two, 40).bitwiseXOR(t).bitwiseAND(F.lit(2**LOW_BITS - 1).cast("bigint"))
    return F.shiftleft(high, LOW_BITS).bitwiseOR(low)


def signatures(df: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(*keys, signature): one array per row; null where a text has no words.

    ``keys`` must identify the rows. Without an existing partitioning by some of
    them, what is shuffled is one partial minimum per row and sample.
    """
    if samples % TOGETHER:
        raise ValueError(f"samples must be a multiple of {TOGETHER}")
    mask = F.lit(2**COUNT_BITS - 1).cast("bigint")
    word = F.col("_x")
    # Each group of samples hashes the word anew.
    terms = df.select(*keys, F.explode_outer(weighted_words(F.col(text))).alias("_x")).select(
        *keys, word.bitwiseAND(F.bitwise_not(mask)).alias("_h"), F.ln(word.bitwiseAND(mask).cast("double")).alias("_w"),
        F.explode(F.sequence(F.lit(0), F.lit(samples // TOGETHER - 1))).alias("_part"),
    ).withColumn("_h", F.when(F.col("_h").isNotNull(), F.xxhash64("_h", "_part")))
    least = [F.min(sample(k, F.col("_h"), F.col("_w"))).alias(f"_s{k}") for k in range(TOGETHER)]
    found = terms.groupBy(*keys, "_part").agg(*least)
    some = F.struct("_part", F.array(*[f"_s{k}" for k in range(TOGETHER)]).alias("s"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(some)), lambda x: x["s"]))
    return found.groupBy(*keys).agg(whole.alias("_all")).select(
        *keys, F.when(F.get("_all", F.lit(0)).isNotNull(), F.col("_all")).alias("signature")
    )


# What an occurrence stands for, beside the sides 0, 1 and 2 (both): a field of its row.
FIELDS = ("ahead", "id", "n", "sha0", "sha1", "sha2", "sha3")
CODES = 16


def _pair_signatures(pair: DataFrame, samples: int) -> DataFrame:
    """(range, _no, *FIELDS, signature_0, signature_1) from the words of both sides of a row.

    ``pair``: (range, _no, ``_terms`` of (word, side), ``_fields``: the values of
    FIELDS as numbers). Everything is grouped within ``range``, by which the rows are
    dealt, so nothing is exchanged. First the occurrences of a word with one count
    meet, so that its values are worked out once for all texts of a range; then they
    go back to their rows. A row's fields travel as occurrences of no word.
    """
    number = F.col("_no").cast("bigint") * CODES
    absent = F.lit(None).cast("bigint")
    words = F.transform("_terms", lambda x: F.struct(x["word"].alias("word"), (number + x["side"]).alias("who"), absent.alias("value")))
    fields = F.transform("_fields", lambda value, k: F.struct(absent.alias("word"), (number + k + 3).alias("who"), value.alias("value")))
    met = pair.select("range", F.explode(F.concat(words, fields)).alias("_x")).select("range", "_x.*").groupBy("range", "word").agg(
        F.collect_list(F.struct("who", "value")).alias("_all")
    )
    mask = F.lit(2**COUNT_BITS - 1).cast("bigint")
    word = F.col("word")
    # A few samples at a time: the code of all would be too large to be compiled.
    parts = F.when(word.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(samples // TOGETHER - 1)))
    terms = met.select("range", "word", "_all", F.explode(parts).alias("_part")).select(
        "range", "_part", "_all", F.when(word.isNotNull(), F.xxhash64(word.bitwiseAND(F.bitwise_not(mask)), "_part")).alias("_h"),
        F.ln(word.bitwiseAND(mask).cast("double")).alias("_w"),
    )
    values = [f"_v{k}" for k in range(TOGETHER)]
    valued = terms.select("range", "_part", "_all", *[sample(k, F.col("_h"), F.col("_w")).alias(v) for k, v in enumerate(values)])
    back = valued.select("range", "_part", *values, F.explode("_all").alias("_o")).select(
        "range", "_part", *values, F.floor(F.col("_o.who") / CODES).alias("_no"), (F.col("_o.who") % CODES).alias("_code"), "_o.value"
    )
    stands = lambda side: F.col("_code").isin(side, 2)
    found = back.groupBy("range", "_no", "_part").agg(
        *[F.min(F.when(stands(side), F.col(v))).alias(f"_s{side}{v}") for side in (0, 1) for v in values],
        *[F.max(F.when(F.col("_code") == k + 3, F.col("value"))).alias(name) for k, name in enumerate(FIELDS)],
    )
    some = F.struct("_part", *[F.array(*[f"_s{side}{v}" for v in values]).alias(f"s{side}") for side in (0, 1)])
    joined = found.groupBy("range", "_no").agg(
        F.sort_array(F.collect_list(some)).alias("_all"), *[F.max(name).alias(name) for name in FIELDS]
    )

    def signature(side: int) -> Column:
        whole = F.flatten(F.transform("_all", lambda x: x[f"s{side}"]))
        return F.when(F.get(whole, F.lit(0)).isNotNull(), whole)

    return joined.select("range", "_no", *FIELDS, *[signature(side).alias(f"signature_{side}") for side in (0, 1)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: estimates the generalised Jaccard similarity."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_text(signature: Column) -> Column:
    """A signature as 16 hexadecimal digits per sample; empty for none."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def _range_starts(docs: DataFrame, id: str, count: int) -> tuple[list[int], object]:
    """At most ``count`` - 1 ids at which ranges of equal size begin, and the least id."""
    shares = [k / count for k in range(1, count)] or [0.5]
    found = docs.agg(
        F.percentile_approx(id, [float(s) for s in shares], 100 * count).alias("at"),
        F.min(id).alias("least"), F.max(F.col(id).isNull()).alias("nulls"),
    ).first()
    starts = sorted(set(found["at"] or []) - ({found["least"]} if not found["nulls"] else set()))
    return starts, None if found["nulls"] else found["least"]


def neighbour_fingerprints(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", samples: int = SAMPLES,
) -> DataFrame:
    """Each text's fingerprint, its edited text's, and how alike they are.

    The edited text has its last floor(n / 2) characters replaced by the first as
    many (or all) of the next document in ascending order of an integer id; the
    last document is followed by the first.
    """
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # More ranges than partitions: hashing then deals them out evenly.
    starts, least = _range_starts(docs, id, 4 * count)
    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    limits = F.array(*[F.lit(int(s)) for s in starts]).cast("array<bigint>")
    own = F.when(F.col("_id").isNull(), 0).otherwise(
        starts_at_or_before(limits, len(starts), F.col("_id"))
    ).cast("int")
    is_start = F.coalesce(F.array_contains(limits, F.col("_id")), F.lit(False))
    is_first = F.col("_id").isNull() if least is None else F.coalesce(F.col("_id") == F.lit(int(least)), F.lit(False))
    before = F.when(is_start, F.array(F.struct((own - 1).alias("range"), F.lit(1).alias("ahead"))))
    last = F.when(is_first, F.array(F.struct(F.lit(len(starts)).alias("range"), F.lit(2).alias("ahead"))))
    none = F.array().cast("array<struct<range:int,ahead:int>>")
    places = F.concat(
        F.array(F.struct(own.alias("range"), F.lit(0).alias("ahead"))), F.coalesce(before, none), F.coalesce(last, none)
    )
    dealt = rows.select("_id", "_text", F.explode(places).alias("_p")).select(
        "_id", "_text", "_p.range", "_p.ahead"
    ).repartition(count, "range")
    order = Window.partitionBy("range").orderBy("ahead", F.col("_id").asc_nulls_first(), F.xxhash64("_text"), "_text")
    numbered = dealt.select(
        "range", "ahead", "_id", "_text",
        F.row_number().over(order).alias("_no"), F.lead("_text").over(order).alias("_next"),
    )
    # Of the rows sent ahead only the first one is a successor.
    numbered = numbered.withColumn("_used", (F.col("ahead") == 0) | F.lag("ahead").over(Window.partitionBy("range").orderBy("_no")).eqNullSafe(0))
    size = F.length("_text")
    no_words = F.array().cast("array<bigint>")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), size - half), F.substring("_next", F.lit(1), half))
    # A word with the same count in the text and the edited text is sampled once for both.
    of = lambda words, side: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(side).alias("side")))
    pair = numbered.filter("_used").withColumn("_edited", F.when(F.col("ahead") == 0, edited)).select(
        "range", "ahead", "_id", "_no", size.alias("n"), F.sha2("_edited", 256).alias("sha"),
        F.coalesce(weighted_words(F.col("_text")), no_words).alias("_own"),
        F.coalesce(weighted_words(F.col("_edited")), no_words).alias("_other"),
    )
    terms = F.concat(
        of(F.array_except("_own", "_other"), 0), of(F.array_except("_other", "_own"), 1), of(F.array_intersect("_own", "_other"), 2)
    )
    digest = [F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("bigint") for k in range(4)]
    fields = F.array(F.col("ahead").cast("bigint"), "_id", F.col("n").cast("bigint"), *digest)
    signed = _pair_signatures(pair.select("range", "_no", terms.alias("_terms"), fields.alias("_fields")), samples)
    following = Window.partitionBy("range").orderBy("_no")
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"sha{k}")), 16, "0") for k in range(4)])
    near = signed.select(
        "ahead", F.col("id").alias(id), F.col("n").alias("n_chars"), sha.alias("edited_sha256"),
        F.col("signature_0").alias("signature"), F.col("signature_1").alias("_edited"),
        F.lead("signature_0").over(following).alias("_after"),
    ).filter("ahead = 0")
    return near.select(
        id, "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("_edited"), samples).alias("near_edited"),
        likeness(F.col("signature"), F.col("_after"), samples).alias("near_next"),
    )
