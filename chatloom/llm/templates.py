"""Drop lines whose template recurs across documents.

Lines are parsed like log messages by a tree of fixed depth: by their number of
tokens, then by their leading tokens, where a token that holds a digit is a
variable field. What follows the leading tokens is cut into up to ``FIELDS``
fields, single tokens in a short line, runs of tokens in a longer one. In each
leaf the value that most texts have in a field is the field's value, none if there
is a tie; lines that agree with the leaf in three quarters of its fields share one
template, whose other fields are variable as well. Beside it a leaf holds families:
lines with the same values in the same three quarters of their fields share a
template too, so a leaf yields as many as it has, whatever else stands in it. A
line that shares none is its own template, with its digits as fields.

A template that occurs in at least ``least_texts`` different texts recurs; one of
``LONG_TOKENS`` tokens or more does so from ``least_texts_long`` texts on. The unit
is the whole line: a shared run within otherwise different lines stays. A template
stays in the document with the smallest id that has it and is dropped from all
others; a line of several templates stays where it is the first of each. Exact copies of a text count once: they are no recurring lines.

The SQL of the query has the usual values only, no families; ``families`` off does
the same.

Only DataFrame operations. Lines and fields travel as hashes; the texts are
shuffled once, by row key. Counts are partial aggregates; templates and leaves
with a large share of all lines, of which there can only be few, are joined by
broadcast.

Defined cases: null and empty texts stay as they are; lines of fewer than
``LEAST_TOKENS`` tokens are never dropped, blank ones included; null ids come
after all others; rows of one id and text share a fate; an empty table gives no
rows; a document may be left with an empty text; further columns stay.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import pinned, skewed_join
from chatloom.operators.columns import compute_once

DEPTH = 3
FIELDS = 8
FIELD = "<*>"
LEAST_TOKENS = 3
LEAST_TEXTS = 3
LONG_TOKENS = 50
LEAST_TEXTS_LONG = 2
LEAST_TOKENS_TO_GENERALISE = 7
LEAST_AGREEMENT = 0.75

NO_ID = 2**63 - 1


def masked(line: Column) -> Column:
    """Tokens joined by one blank, those with a digit replaced by the field mark."""
    # Most lines need neither step.
    blanks = line.startswith(" ") | line.endswith(" ")
    for odd in ("  ", "\t", "\r", "\x0b", "\x0c"):
        blanks = blanks | F.contains(line, F.lit(odd))
    spaced = F.when(blanks, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)
    return F.when(
        F.regexp_like(spaced, F.lit("[0-9]")), F.regexp_replace(spaced, "(?<![^ ])[^ 0-9]*[0-9][^ ]*", FIELD)
    ).otherwise(spaced)


def _tokens(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def _fields(line: Column, tokens: Column) -> Column:
    """Hashes of the fields after the leading tokens, in order."""
    rest = tokens - DEPTH
    count = F.least(F.lit(FIELDS), rest)
    end = lambda j: (F.floor(F.lit(j) * rest / count) + DEPTH).cast("int")
    first = lambda text, number: F.call_function("substring_index", text, F.lit(" "), number)
    # A negative number counts from the end.
    field = lambda j: first(first(line, end(j + 1)), end(j) - end(j + 1))
    return F.slice(F.array(*[F.hash(field(j)) for j in range(FIELDS)]), F.lit(1), count)


def _parsed(docs: DataFrame, id: str, text: str, least_texts: int, least_texts_long: int) -> DataFrame:
    """(_id, _text, pos, least, template, leaf, fields): a row per line that may recur;
    least is the number of texts from which it does; leaf and fields are null for lines
    that are too short to generalise."""
    lines = docs.select(
        F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_text"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
    )
    parsed = compute_once(lines.select("_id", "_text", "pos", "line"), m=masked(F.col("line")))
    counted = compute_once(parsed, n=_tokens(F.col("m"))).filter(F.col("n") >= LEAST_TOKENS)
    long_ = F.col("n") >= LEAST_TOKENS_TO_GENERALISE
    return counted.select(
        "_id", "_text", "pos", F.when(F.col("n") >= LONG_TOKENS, least_texts_long).otherwise(least_texts).alias("least"),
        F.xxhash64("m").alias("template"),
        F.when(long_, F.xxhash64("n", F.substring_index("m", " ", DEPTH))).alias("leaf"),
        F.when(long_, _fields(F.col("m"), F.col("n"))).alias("fields"),
    )


def _generalised(contested: DataFrame) -> DataFrame:
    """(template, leaf) of the templates that agree with their leaf's usual fields.

    ``contested``: (template, leaf, texts, fields), a row per template.
    """
    votes = contested.select("leaf", "texts", F.posexplode("fields").alias("at", "value")).groupBy("leaf", "at", "value").agg(
        F.sum("texts").alias("votes")
    )
    # The greatest and the least of the most frequent values: if they differ, the
    # field has no usual value.
    chosen = votes.groupBy("leaf", "at").agg(
        F.max(F.struct("votes", "value")).alias("top"), F.max(F.struct("votes", (-F.col("value").cast("bigint")).alias("value"))).alias("low")
    ).select("leaf", "at", F.when(F.col("top.value") == -F.col("low.value"), F.col("top.value")).alias("value"))
    usual = chosen.groupBy("leaf").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("usual")
    )
    sizes = contested.groupBy("leaf").agg(F.count(F.lit(1)).alias("_templates"))
    joined = skewed_join(contested, pinned(usual.join(sizes, "leaf")), ["leaf"], "_templates")
    same = F.size(F.filter(F.zip_with("fields", "usual", lambda a, b: a == b), lambda x: x))
    return joined.filter(same >= F.lit(LEAST_AGREEMENT) * F.size("fields")).select("template", "leaf")


def _families(examples: DataFrame) -> DataFrame:
    """(template, group) of the templates that have the same values in the same share of
    their fields as others of their leaf; a row per group of a template.

    ``examples``: (template, leaf, least, texts, fields), a row per template.
    """
    hashes = [F.xxhash64(F.lit(i), F.get("fields", F.lit(i))) for i in range(FIELDS)]
    placed = examples.select("template", "leaf", "least", "texts", F.size("fields").alias("k"), *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    keys = F.lit(None).cast("array<bigint>")
    for k in range(LEAST_TOKENS_TO_GENERALISE - DEPTH, FIELDS + 1):
        subsets = []
        for subset in combinations(range(k), ceil(LEAST_AGREEMENT * k)):
            subsets.append(F.xxhash64("leaf", F.lit(sum(1 << i for i in subset)), *[f"h{i}" for i in subset]))
        keys = F.when(F.col("k") == k, F.array(*subsets)).otherwise(keys)
    keyed = pinned(placed.select("template", "least", "texts", F.explode(keys).alias("key")))
    # Sets of the same members, which differ in the fields compared only, become one.
    sets = keyed.groupBy("key", "least").agg(
        F.count(F.lit(1)).alias("_members"), F.sum("texts").alias("texts"), F.bit_xor("template").alias("x"),
        F.sum(F.pmod("template", F.lit(2**31 - 1))).alias("s"),
    ).filter((F.col("_members") > 1) & (F.col("texts") >= F.col("least")))
    sets = pinned(sets.select("key", "_members", F.xxhash64("_members", "x", "s").alias("group")))
    return skewed_join(keyed.select("template", "key"), sets, ["key"], "_members").select("template", "group").distinct()


def recurring_lines(parsed: DataFrame, families: bool = True) -> DataFrame:
    """(_id, _text, pos) of the lines to drop."""
    enough = F.col("texts") >= F.col("least")
    by_text = parsed.groupBy("template", "leaf", "least", "_text").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("_lines"))
    # Copies of a text count once as texts, but all their lines weigh in the joins.
    counts = pinned(by_text.groupBy("template", "leaf", "least").agg(
        F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("_lines").alias("_lines")
    ))
    shared = counts.filter("leaf IS NOT NULL").groupBy("leaf", "least").agg(
        F.count(F.lit(1)).alias("templates"), F.sum("texts").alias("all_texts")
    ).filter((F.col("templates") > 1) & (F.col("all_texts") >= F.col("least")))
    contested = skewed_join(counts, pinned(shared.select("leaf", "templates")), ["leaf"], "templates").select(
        "template", "texts", "first", "_lines", F.lit(True).alias("contested"), enough.alias("enough")
    )
    wanted = contested.unionByName(
        counts.filter(enough).select("template", "texts", "first", "_lines", F.lit(False).alias("contested"), F.lit(True).alias("enough"))
    ).groupBy("template").agg(*[F.max(c).alias(c) for c in ("texts", "_lines", "contested", "enough")], F.min("first").alias("first"))
    wanted = pinned(wanted)
    # From here on only lines of templates that recur or may be generalised.
    lines = pinned(skewed_join(parsed, wanted, ["template"], "_lines"))
    examples = lines.filter("contested AND _id = first").select("template", "leaf", "least", "texts", "fields").dropDuplicates(["template"])
    examples = pinned(examples)
    grouped = _generalised(examples).withColumnRenamed("leaf", "group")
    if families:
        grouped = grouped.unionByName(_families(examples))
    merged = pinned(grouped.groupBy("template").agg(F.collect_set("group").alias("groups")))
    # A text with two lines of one template counts once, so texts are counted anew.
    narrow = lines.select("template", "least", "_id", "_text", "pos")
    sizes = merged.join(wanted.select("template", "_lines"), "template").withColumn("_lines", F.col("_lines") * F.size("groups"))
    members = skewed_join(narrow, pinned(sizes), ["template"], "_lines").select("least", "_id", "_text", F.explode("groups").alias("group"))
    groups = pinned(members.groupBy("group", "least", "_text").agg(F.min("_id").alias("first")).groupBy("group", "least").agg(
        F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")
    ).filter(enough).select("group", "first", F.col("texts").alias("_members")))
    general = skewed_join(merged.select("template", F.explode("groups").alias("group")), groups, ["group"], "_members")
    alone = wanted.filter("enough").select("template", "first")
    final = alone.unionByName(general.select("template", "first")).groupBy("template").agg(F.min("first").alias("first"))
    final = final.join(wanted.select("template", "_lines"), "template")
    return skewed_join(narrow, pinned(final), ["template"], "_lines").filter("_id > first").select("_id", "_text", "pos")


def drop_recurring_lines(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_texts: int = LEAST_TEXTS,
    least_texts_long: int = LEAST_TEXTS_LONG, families: bool = True, report: bool = False,
) -> DataFrame:
    """The documents without recurring lines; ``report`` adds n_lines and n_dropped."""
    drops = recurring_lines(pinned(_parsed(docs, id, text, least_texts, least_texts_long)), families)
    per_row = drops.groupBy("_id", "_text").agg(F.collect_set("pos").alias("_drops"))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_text"),
    )
    joined = rows.join(per_row, ["_id", "_text"], "left").withColumn("_lines", F.split(f"_row.{text}", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    cut = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    new = F.when(F.col("_drops").isNull(), F.col(f"_row.{text}")).otherwise(cut)
    columns = [new.alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in docs.columns]
    if report:
        columns += [
            F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("_drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        ]
    return joined.select(*columns)
