"""Personal data by candidate gradient boosting.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Beside
them, high-recall generators propose overlapping spans: addresses with a
spelled-out mark, any run of seven digits or more, account numbers. A candidate is
confirmed if a base span overlaps it or if it checks by itself: an address whose
marks, once written out, have the form of one; an account number whose remainder by
97 is 1; valid octets; a valid card number. What fails such a check is negative, as
the check is decisive, but for spelled-out addresses, whose form is not: these and
the numbers that no check knows are unlabelled, not negative.

Boosted trees tell which candidates are like confirmed ones by another view, which
has nothing of what confirms: the shape of a span (its length, letters, groups of
digits and what stands between them, without its plus or at sign) and its
surroundings (words that announce such data and how far off they are, what touches
it, whether a line begins or a colon stands before it, how many candidates are
near). They learn on the candidates of all documents. An isotonic
calibration of all held-out margins gives, per kind, the share of confirmed ones at a
margin. Where it reaches ``least_share`` a candidate is added, whether it checks by
itself or not; among unlabelled kinds ``least_share`` of what confirmed candidates
reach on the mean. Base spans always stay.

Only DataFrame operations: spans are arrays of the row, positions are running
sums over what lies between the matches, and the fitted trees are an expression.
Texts are not shuffled. Fitting counts candidates with equal features; numpy, in the
driver, sees sums per bin and counts per margin.

Defined cases: a null text counts as empty; positions are code points, ends
exclusive; overlapping spans of different kinds are all reported, and ``redact``
covers their union; a table without candidates, or with confirmed or unconfirmed
ones only, adds nothing; an account number may cross a base span, other candidates
may not; an empty table gives no rows; repeated rows are treated alike; further columns are ignored by
``find`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm import boosting
from chatloom.llm.common import pinned

# Fixed values of the contract: the base patterns, in the order of their kinds. A
# match can only begin where no earlier character extends it, which the look-behind
# says, or where the last match ended; possessive repeats never give back what the
# rest could not use. Both keep the matches and make the scan linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)

AT = r"[(\[{] ?(?i:at) ?[)\]}]"
# A dot with a blank on one side only ends a sentence.
DOT = r"(?: ?[(\[{] ?(?i:dot) ?[)\]}] ?| (?i:dot) | \. |\.)"
GENERATORS = {
    "address": rf"(?:\G|(?<![\p{{L}}\p{{N}}._%+-]))[\p{{L}}\p{{N}}._%+-]++ ?(?:@|{AT}) ?[\p{{L}}\p{{N}}-]++(?:{DOT}[\p{{L}}\p{{N}}-]++)++",
    "number": r"(?<![0-9])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = ("email", "ip", "card", "phone", "account")
DECISIVE = ("ip", "card", "account")
# Words that announce personal data, by what they announce.
CUES = {
    "cue_mail": r"(?i)(mail|write|writ|schreib|écri|escrib|contact|kontakt)",
    "cue_phone": r"(?i)(phone|tel[ée.: ]|call|cell|fax|mobil|ruf|appel|llam|number|nummer|numéro|número)",
    "cue_account": r"(?i)(card|visa|konto|iban|account|pay|zahl|compte|cuenta|tarjeta|carte)",
    "cue_host": r"(?i)(ip[: ]|addr|host|server|login|from)",
}
CUE = "(?i)(" + "|".join(pattern[5:-1] for pattern in CUES.values()) + ")"
ADDRESS = r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{2,24})$"
CHUNK = 256
FOLDS = 3
STEPS = 1024  # cells of a margin that calibration tells apart, per unit
FEATURES = (
    "kind", "length", "digits", "letters", "groups", "longest_group", "shortest_group", "blanks", "dashes", "dots", "slashes",
    "brackets", "free_before", "free_after", "line_start", "colon", "cue_distance", *CUES, "near",
)


def _running(steps: Column, first: Column) -> Column:
    """Exclusive running sums of an array, from ``first`` on."""
    start = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(
        steps, start,
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )


def _offsets(steps: str) -> Column:
    """Exclusive running sums of a bigint array column, in chunks so that a long
    array is not copied for each of its elements."""
    chunks = F.transform(
        F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda c: F.slice(F.col(steps), c * CHUNK + 1, F.lit(CHUNK)),
    )
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        chunks, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, part: F.struct(
            (acc["at"] + F.aggregate(part, zero, lambda a, x: a + x)).alias("at"),
            F.concat(acc["all"], _running(part, acc["at"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )


def _steps(n: str) -> Column:
    """Length of each match with what lies before it."""
    return F.transform(f"_m_{n}", lambda m, i: (F.length(F.get(f"_g_{n}", i)) + F.length(m)).cast("bigint"))


def _placed(n: str) -> Column:
    return F.transform(f"_m_{n}", lambda m, i: F.struct(
        (F.get(f"_o_{n}", i) + F.length(F.get(f"_g_{n}", i))).alias("start"),
        (F.get(f"_o_{n}", i) + F.get(f"_s_{n}", i)).alias("end"),
        m.alias("value"),
        F.right(F.get(f"_g_{n}", i), F.lit(24)).alias("before"),
        F.left(F.get(f"_g_{n}", i + 1), F.lit(2)).alias("after"),
    ))


def _with_matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per name an array of (start, end, value, before, after) of a pattern's
    leftmost matches in the column ``_t``; before and after are what surrounds it."""
    df = df.withColumns({f"_m_{n}": F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for n, p in patterns.items()})
    df = df.withColumns({
        f"_g_{n}": F.when(F.size(f"_m_{n}") > 0, F.split("_t", p, -1)).otherwise(F.array().cast("array<string>"))
        for n, p in patterns.items()
    })
    df = df.withColumns({f"_s_{n}": _steps(n) for n in patterns})
    df = df.withColumns({f"_o_{n}": _offsets(f"_s_{n}") for n in patterns})
    spans = {n: _placed(n) for n in patterns}
    return df.withColumns(spans).drop(*[f"_{c}_{n}" for n in patterns for c in "mgso"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.length(digits).between(*CARD_DIGITS) & (total % 10 == 0)


def _octets(value: Column) -> Column:
    def small(part):
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return F.forall(F.split(value, r"\."), small)


def _address(value: Column) -> Column:
    """Whether a spelled-out address has the form of one once its marks are written."""
    written = F.regexp_replace(F.regexp_replace(value, AT, "@"), DOT, ".")
    return F.regexp_like(F.replace(written, F.lit(" "), F.lit("")), F.lit(ADDRESS))


def _account(value: Column) -> Column:
    """Remainder 1 by 97: the first four characters moved to the end, A to Z as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def add(rest, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(*PHONE_DIGITS)
    return F.lit(True)


def _confirmed(no: int, kind: str) -> Column:
    return F.transform(F.filter(kind, lambda s: _valid(kind, s["value"])), lambda s: F.struct(
        F.lit(no).alias("no"), s["start"].alias("start"), s["end"].alias("end")
    ))


def _with_base(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Add ``_t`` and ``_base``: (no, start, end) of all base spans."""
    df = _with_matches(docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("_t")), BASE)
    spans = [_confirmed(no, kind) for no, kind in enumerate(BASE)]
    return df.withColumn("_base", F.concat(*spans)).drop(*BASE)


def _candidate(name: str, s: Column) -> Column:
    """(no, start, end, f): the likely kind and the features of one proposed span."""
    value, digits = s["value"], F.length(_digits(s["value"]))
    quad = F.regexp_like(value, F.lit(r"^[0-9]+(\.[0-9]+){3}$"))
    no = {"address": F.lit(0), "account": F.lit(4)}.get(
        name, F.when(quad, 1).when((digits > PHONE_DIGITS[1]) | _luhn(_digits(value)), 2).otherwise(3)
    )
    # What confirms a candidate by itself; no feature tells it.
    checks = {"address": _address(value), "account": _account(value)}.get(
        name, F.when(no == 1, _octets(value)).when(no == 2, _luhn(_digits(value))).otherwise(F.lit(False))
    )
    # The base rules' own marks are no part of the shape.
    shape = F.regexp_replace(F.regexp_replace(value, AT, " "), "[+@]", "")
    groups = F.transform(F.filter(F.split(shape, "[^0-9]+"), lambda g: g != ""), F.length)
    count = lambda pattern: F.length(F.regexp_replace(shape, pattern, "")).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    before = s["before"]
    cue_ends = F.length(F.regexp_extract(before, rf"^(?s)(.*){CUE}", 0))
    features = [
        no.cast("double"), F.length(shape).cast("double"), digits.cast("double"), count(r"[^\p{L}]"), F.size(groups).cast("double"),
        F.coalesce(F.array_max(groups), F.lit(0)).cast("double"), F.coalesce(F.array_min(groups), F.lit(0)).cast("double"),
        count("[^ ]"), count("[^-]"), count(r"[^.]"), count("[^/]"), count("[^()]"),
        flag(F.regexp_like(before, F.lit(r"(^|[^\p{L}\p{N}])$"))), flag(F.regexp_like(s["after"], F.lit(r"^($|[^\p{L}\p{N}])"))),
        flag(F.regexp_like(before, F.lit(r"(^|\n)[^\p{L}\p{N}]*$"))), flag(F.regexp_like(before, F.lit(r":[ ]*$"))),
        F.when(cue_ends > 0, F.length(before) - cue_ends).otherwise(99).cast("double"),
        *[flag(F.regexp_like(before, F.lit(pattern))) for pattern in CUES.values()],
    ]
    return F.struct(
        no.cast("int").alias("no"), s["start"].alias("start"), s["end"].alias("end"), F.array(*features).alias("f"), checks.alias("checks")
    )


def _with_candidates(df: DataFrame) -> DataFrame:
    """Add ``_cands``: (no, start, end, f, checks, base), base telling whether a base span overlaps."""
    df = _with_matches(df, GENERATORS)
    proposed = lambda name: F.transform(name, lambda s: _candidate(name, s))
    found = F.concat(*map(proposed, GENERATORS))
    df = df.withColumn("_cands", found).drop(*GENERATORS)
    # Candidates per thousand characters, as far as a row's own numbers tell.
    near = F.size("_cands") * 1000.0 / F.greatest(F.length("_t"), F.lit(1000))
    return df.withColumn("_cands", F.transform("_cands", lambda c: F.struct(
        c["no"].alias("no"), c["start"].alias("start"), c["end"].alias("end"), F.array_append(c["f"], near).alias("f"),
        c["checks"].alias("checks"), F.exists("_base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])).alias("base"),
    )))


@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    cuts: dict[int, float]  # the least margin to redact, by kind


def learn(docs: DataFrame, *, text: str = "text", least_share: float = 0.9, least_rows: int = 50) -> Model:
    """Fit on the candidates of all documents; each is held out once, with those of
    equal texts."""
    found = _with_candidates(_with_base(docs.select(text), text, [])).withColumn("_h", F.xxhash64("_t"))
    # A plain explode would add a filter that works all candidates out a second time.
    rows = pinned(boosting.counted(found.select("_h", F.explode_outer("_cands").alias("c")).filter("c IS NOT NULL").select(
        "c.f", (F.col("c.base") | F.col("c.checks")).cast("int").alias("y"), F.pmod(F.xxhash64("_h", "c"), F.lit(FOLDS)).alias("part")
    )))
    trees = boosting.fit(rows, rounds=30, folds=FOLDS)
    features = [F.col("f")[k] for k in range(len(FEATURES))]
    held = trees.column(features)
    for k, other in enumerate(trees.held):
        held = F.when(F.col("part") == k, other.column(features)).otherwise(held)
    # Counts per margin, in steps that bound them whatever the number of rows.
    step = F.floor(held * STEPS)
    cells = rows.select(F.col("f")[0].alias("no"), step.alias("at"), "n", "s").groupBy("no", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")
    ).orderBy("at", "no").collect()
    kind, margin, n, s = np.array([(r["no"], r["at"] / STEPS, r["n"], r["s"]) for r in cells], dtype=float).reshape(-1, 4).T
    cuts = {}
    for no in range(len(KINDS)):
        own = kind == no
        if n[own].sum() < least_rows or s[own].sum() in (0, n[own].sum()):  # too few, or all alike, to calibrate alone
            own = np.ones(len(n), dtype=bool)
        if not own.any():
            cuts[no] = float("inf")
            continue
        at, back = np.unique(margin[own], return_inverse=True)
        labels = np.bincount(back, s[own])
        curve = boosting.isotonic(at, labels, np.bincount(back, n[own]))
        # What a confirmed candidate reaches by this view: where the others are
        # unlabelled, the share of the confirmed among all that are personal data.
        reached = 1.0
        if KINDS[no] not in DECISIVE and labels.any():
            reached = np.average(np.interp(at, curve.at, curve.value), weights=labels)
        # Margins that tell nothing apart decide nothing.
        enough = curve.at[curve.value >= least_share * reached] if np.ptp(at) and np.ptp(curve.value) else []
        cuts[no] = float(enough[0]) if len(enough) else float("inf")
    return Model(trees, cuts)


def with_spans(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str]) -> DataFrame:
    """(*keep, base, spans): arrays of (no, start, end), in order; ``no`` counts KINDS."""
    df = _with_candidates(_with_base(docs, text, keep))

    def chosen(c):
        margin = model.trees.column([c["f"][k] for k in range(len(FEATURES))])
        cut = F.lit(float("inf"))
        for no, least in model.cuts.items():
            cut = F.when(c["no"] == no, F.lit(least)).otherwise(cut)
        free = ~c["base"] | (c["checks"] & (c["no"] == KINDS.index("account")))
        return free & (margin >= cut)

    added = F.transform(F.filter("_cands", chosen), lambda c: F.struct(
        c["no"].alias("no"), c["start"].alias("start"), c["end"].alias("end")
    ))
    return df.select(
        *keep, F.sort_array("_base").alias("base"),
        F.sort_array(F.array_distinct(F.concat("_base", added))).alias("spans"), "_t",
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["no"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def find(docs: DataFrame, model: Model | None = None, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of
    the base spans, and all spans."""
    found = with_spans(docs, model or learn(docs, text=text), text=text, keep=[id])
    of_kind = lambda no: F.filter("base", lambda s: s["no"] == no)
    counts = [F.size(of_kind(no)).cast("bigint").alias(f"n_{kind}") for no, kind in enumerate(BASE)]
    return found.select(id, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None, *, text: str = "text") -> DataFrame:
    """The documents with each stretch of personal data replaced by its kind in
    brackets; overlapping spans make one stretch, named by the first of them."""
    model = model or learn(docs, text=text)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_own"))
    found = with_spans(rows, model, text="_own", keep=["_row"])
    placed = F.sort_array(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["no"].alias("no")
    )))
    stretch = "array<struct<start:bigint,end:bigint,no:int>>"
    merged = F.aggregate(placed, F.array().cast(stretch), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.get(acc, F.size(acc) - 1)["start"].alias("start"),
            F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"),
            F.get(acc, F.size(acc) - 1)["no"].alias("no"),
        ))),
    ).otherwise(F.concat(acc, F.array(s))))
    df = found.withColumn("_cut", merged)
    kinds = F.array(*map(F.lit, KINDS))
    parts = F.transform("_cut", lambda s, i: F.concat(
        F.substring("_t", (F.coalesce(F.get("_cut", i - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (s["start"] - F.coalesce(F.get("_cut", i - 1)["end"], F.lit(0))).cast("int")),
        F.lit("["), F.upper(F.get(kinds, s["no"])), F.lit("]"),
    ))
    rest = F.substring("_t", (F.coalesce(F.get("_cut", F.size("_cut") - 1)["end"], F.lit(0)) + 1).cast("int"), F.length("_t"))
    new = F.concat(F.array_join(parts, ""), rest)
    return df.select(*[new.alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in docs.columns])
