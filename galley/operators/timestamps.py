"""Timestamps of many formats and zones to one UTC instant.

Every text is split by patterns into fields on the JVM side; a text may have two
valid readings: day or month first in a date of digits and slashes (``order``), two
zones of one abbreviation (``zone``), two centuries of a year of two digits
(``century``).  Which reading a source uses is settled by expectation-maximisation
over the mixture of the two in that source and kind: each value gives its likelihood under each valid
parse (0 where the calendar rules it out, else the density of the delay until it was
taken in), the posterior picks the reading, and what stays undecided is marked
``ambiguous`` instead of being guessed.  The density of the delays is estimated
from all values that have one reading only.  A registry entry is a prior of 1 for
its order; where a source says nothing, the usual zone and the near century have a
prior of their own.

The EM runs inside one row per source and kind (``aggregate`` over the iterations, on
counts of a fixed number of evidence classes): one pre-aggregated shuffle, no
group is gathered, and a source with a third of all rows costs no more than
any other.

Defined results: null, blank and unreadable texts, dates that do not exist,
dates without a time and unknown zones have no instant (``utc_us`` null);
second 60 and hour 24 are not real times; white space of any kind at both ends
is ignored; missing seconds are 0; digits beyond microseconds are dropped;
a two-digit year below 69 is of this century, else of the last; a time that a
clock change skips or repeats takes the offset in force before the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.session import materialize

# Names of months by number, in the languages mail programs write.
MONTHS = {
    1: "jan january januar jänner janvier enero ene gennaio gen janeiro januari",
    2: "feb february februar février fevrier févr fev febrero febbraio fevereiro februari",
    3: "mar march märz maerz mär mrz mars marzo março marco maart",
    4: "apr april avril avr abril abr aprile",
    5: "may mai mayo maggio mag maio mei",
    6: "jun june juni juin junio giugno giu junho",
    7: "jul july juli juillet juil julio luglio lug julho",
    8: "aug august août aout agosto ago augustus",
    9: "sep sept september septembre septiembre settembre set setembro",
    10: "oct october oktober okt octobre octubre ottobre ott outubro out",
    11: "nov november novembre noviembre novembro",
    12: "dec december dezember dez décembre déc diciembre dic dicembre dezembro",
}

# Offsets of zone abbreviations in minutes.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "ist": 330, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "jst": 540, "kst": 540, "sgt": 480, "hkt": 480, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "npt": 345,
}

# Another zone that the same abbreviation names, in minutes.
OTHER_MINUTES = {"ist": 120, "cst": 480, "bst": 360}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(?:([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"\s*(Z|z|(?:(?:UTC|GMT)?[+-]\d{1,2}:?\d{2})|[+-]\d{2}|[A-Za-z]{1,5}|[A-Za-z_]+/[A-Za-z_+\-0-9]+(?:/[A-Za-z_]+)?)?"
_TAIL = r"(?:\[([^\]]*)\])?\s*(?:\([^()]*\)\s*)*$"
_WORD = r"([\p{L}]{3,10})\.?"

#: name -> (pattern, groups of year, month, day, hour, minute, second, fraction, half, zone)
PATTERNS = {
    "iso": (r"^(\d{4})-(\d{1,2})-(\d{1,2})[Tt\s]\s*" + _TIME + _ZONE + _TAIL, (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt\s](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()" + _ZONE + _TAIL, (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "day_word": (r"^(?:[\p{L}]{2,10}\.?,?\s+)?(\d{1,2})\.?(?:\s+|-)(?:de\s+)?" + _WORD + r"(?:\s+|-)(?:de\s+)?(\d{4}|\d{2}),?\s+(?:at\s+|um\s+|à\s+)?" + _TIME + _ZONE + _TAIL, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    "word_day": (r"^(?:[\p{L}]{2,10}\.?,?\s+)?" + _WORD + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}),?\s+(?:at\s+)?" + _TIME + _ZONE + _TAIL, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "ctime": (r"^[\p{L}]{2,10}\.?,?\s+" + _WORD + r"\s+(\d{1,2})\s+" + _TIME + _ZONE + r"\s+(\d{4})\s*$", (9, 1, 2, 3, 4, 5, 6, 7, 8)),
    "year_slash": (r"^(\d{4})/(\d{1,2})/(\d{1,2})[Tt,\s]\s*" + _TIME + _ZONE + _TAIL, (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    "slash": (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})[Tt,\s]\s*" + _TIME + _ZONE + _TAIL, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "dots": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2}),?\s+(?:um\s+)?" + _TIME + _ZONE + _TAIL, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
}

EM_STEPS = 12
#: A reading counts as settled from this posterior on.
SETTLED = 0.9
#: Days that each class of delay spans: up to 5 days, up to 30 days, later, taken in before it was sent; unknown says nothing.
_DELAY_DAYS = {"near": 5.0, "weeks": 25.0, "late": 3650.0, "before": 3650.0, "unknown": 1.0}
#: Pseudo counts of the first and the second reading: day first or month first, the usual or the other zone, the near or the other century.
PRIORS = {"order": (0.05, 0.05), "zone": (1.6, 0.4), "century": (19.8, 0.2)}


def sender_address(sender: Column) -> Column:
    """Address of a sender text in lower case, without display name; null where there is none."""
    s = F.lower(F.regexp_replace(sender, r"(?U)^\s+|\s+$", ""))
    angle = F.regexp_extract(s, r"<\s*([^<>\s]+@[^<>\s]+)\s*>", 1)
    bare = F.regexp_extract(s, r"([^\s<>\"'(),;:]+@[^\s<>\"'(),;:]+)", 1)
    picked = F.when(angle != "", angle).otherwise(bare)
    return F.when(picked != "", picked)


def sender_domain(sender: Column) -> Column:
    """The part of the sender's address after the last ``@``, in lower case."""
    return F.substring_index(sender_address(sender), "@", -1)


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _num(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _split_fields(text: Column) -> Column:
    """ARRAY(form, y, a, b, h, mi, s, fraction, half, zone) of the first pattern that fits, else null.

    One substitution puts the groups of a pattern in the order of the fields,
    so a text is matched once and the plan stays small.
    """
    out = None
    for name in reversed(PATTERNS):
        pattern, at = PATTERNS[name]
        row = F.split(F.regexp_replace(text, pattern, "\x01".join([name, *(f"${g}" for g in at)])), "\x01", -1)
        out = F.when(text.rlike(pattern), row) if out is None else F.when(text.rlike(pattern), row).otherwise(out)
    return out


_OFFSET = r"^(?:utc|gmt)?[+-](\d{1,2}?):?(\d{2})?$"


def _with_fields(x: DataFrame) -> DataFrame:
    """Adds the typed fields of ``_a``; each is computed once, in its own projection."""
    at = lambda i: F.try_element_at("_a", F.lit(i))
    months = _map({w: n for n, words in MONTHS.items() for w in words.split()})
    y, h, half = _num(at(2)), _num(at(5)), F.lower(at(9))
    x = x.select(
        "*",
        at(1).alias("_form"),
        F.when(F.length(at(2)) == 2, F.when(y < 69, y + 2000).otherwise(y + 1900)).otherwise(y).alias("_y"),
        F.when(F.length(at(2)) == 2, F.when(y < 69, y + 1900).otherwise(y + 2000)).alias("_y2"),
        F.when(at(3).rlike(r"^\d+$"), _num(at(3))).otherwise(F.try_element_at(months, F.lower(at(3)))).alias("_p"),
        _num(at(4)).alias("_q"),
        F.when(half == "", h).when((h >= 1) & (h <= 12), h % 12 + F.when(half == "p", 12).otherwise(0)).alias("_h"),
        _num(at(6)).alias("_mi"),
        (F.coalesce(_num(at(7)), F.lit(0)).cast("long") * 1_000_000 + F.when(at(8) != "", F.rpad(F.substring(at(8), 1, 6), 6, "0").try_cast("int")).otherwise(F.lit(0))).alias("_us"),
        F.lower(F.coalesce(at(10), F.lit(""))).alias("_low"),
        F.coalesce(at(10), F.lit("")).alias("_zone"),
    )
    hh, mm = _num(F.regexp_extract("_low", _OFFSET, 1)), F.coalesce(_num(F.regexp_extract("_low", _OFFSET, 2)), F.lit(0))
    offset = F.when((mm < 60) & (hh < 19), (hh * 60 + mm) * F.when(F.locate("-", "_low") > 0, -1).otherwise(1))
    x = x.withColumn("_offset", F.when(F.col("_low").rlike(r"[+-]\d"), F.when(F.col("_low").rlike(r"/"), F.lit(None).cast("int")).otherwise(offset)).otherwise(F.try_element_at(_map(ZONE_MINUTES), F.col("_low"))))
    zone = F.when(F.col("_low") == "", F.coalesce("_tz", F.lit("UTC"))).when(F.col("_offset").isNotNull(), "UTC").when(F.locate("/", "_zone") > 0, F.col("_zone"))
    return x.withColumn("_in", zone).withColumn("_real", (F.col("_us") < 60_000_000) & (F.col("_h") < 24) & (F.col("_mi") < 60) & F.col("_in").isNotNull())


def _instant(month: str, day: str, year: str = "_y") -> Column:
    """Microseconds since 1970 UTC, null where date, time or zone is not real."""
    sec = (F.col("_us") / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(16,6)")
    local = F.unix_micros(F.try_make_timestamp(F.col(year), F.col(month), F.col(day), F.col("_h"), F.col("_mi"), sec, F.col("_in")))
    return F.when(F.col("_real"), local - F.coalesce("_offset", F.lit(0)).cast("long") * 60_000_000)


def _epoch(text: Column) -> Column:
    """Numbers alone count from 1970 in s, ms or us, told apart by their size."""
    whole = F.regexp_extract(text, r"^(-?\d{1,18})(?:\.(\d+))?$", 1)
    frac = F.regexp_extract(text, r"^(-?\d{1,18})(?:\.(\d+))?$", 2)
    n = F.when(whole != "", whole).try_cast("long")
    size = F.abs(n)
    part = F.when(frac == "", F.lit(0)).otherwise(F.rpad(F.substring(frac, 1, 6), 6, "0").try_cast("int")).cast("long")
    signed = F.when(whole.startswith("-"), -part).otherwise(part)
    return F.when(size < 100_000_000_000, n * 1_000_000 + signed).when(size < 100_000_000_000_000, n * 1_000 + F.floor(signed / 1000)).otherwise(n)


def readings(df: DataFrame, text: str, sender: str, registry: DataFrame, taken_at: str | None = None) -> DataFrame:
    """Source domain, order, form, kind of ambiguity and the instants of both readings (``_a``, ``_b``; the second null where there is one), beside the packed row.

    The input row travels as one struct, so no name of it can clash.
    """
    taken = F.unix_micros(F.col(taken_at).cast("timestamp")) if taken_at else F.lit(None).cast("long")
    reg = registry.groupBy(F.lower("domain").alias("_dom")).agg(F.min("tz").alias("_tz"), F.min(F.upper("date_order")).alias("_order"))
    x = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), strip_text(F.col(text)).alias("_text"), sender_domain(F.col(sender)).alias("_dom"), taken.alias("_taken"))
    x = x.join(reg, "_dom", "left").withColumn("_a", _split_fields(F.col("_text"))).withColumn("_epoch", _epoch(F.col("_text")))
    x = _with_fields(x)
    slash = F.coalesce(F.col("_form") == "slash", F.lit(False))
    other = F.try_element_at(_map(OTHER_MINUTES), F.col("_low"))
    kind = F.when(slash, "order").when(other.isNotNull(), "zone").when(F.col("_y2").isNotNull(), "century")
    x = x.withColumn("_kind", kind).withColumn("_plain", _instant("_p", "_q"))
    first = F.when(slash, _instant("_q", "_p")).otherwise(F.coalesce("_plain", "_epoch"))
    second = F.when(slash, F.col("_plain")).when(F.col("_kind") == "zone", F.col("_plain") + (F.col("_offset") - other).cast("long") * 60_000_000).when(F.col("_kind") == "century", _instant("_p", "_q", "_y2"))
    return x.select("_row", "_dom", "_order", "_form", "_epoch", "_kind", first.alias("_a"), second.alias("_b"), "_taken")


def strip_text(c: Column) -> Column:
    """Without white space and control characters of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x{0}-\x{1f}\x{feff}\x{200b}]+|[\s\x{0}-\x{1f}\x{feff}\x{200b}]+$", "")


def _delay_class(us: Column, taken: Column) -> Column:
    day = 86_400_000_000
    lag = taken - us
    return F.when(us.isNull(), "none").when(taken.isNull(), "unknown").when(lag < -day // 24, "before").when(lag <= 5 * day, "near").when(lag <= 30 * day, "weeks").otherwise("late")


def delay_likelihoods(read: DataFrame) -> dict[str, float]:
    """The density of each class of delay, over all values with one reading only: counts for each day the class spans; five rows."""
    known = read.where(F.col("_kind").isNull() & F.col("_a").isNotNull()).groupBy(_delay_class(F.col("_a"), F.col("_taken")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    n = {r["c"]: r["n"] for r in known.collect()}
    total = sum(n.values()) + len(_DELAY_DAYS)
    return {c: (n.get(c, 0) + 1) / total / days for c, days in _DELAY_DAYS.items()}


def _likelihood(c: Column, density: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(_map(density), c), F.lit(0.0))


def posteriors(read: DataFrame, density: dict[str, float]) -> DataFrame:
    """By EM, the share of first readings in each source and kind: _src, _kind, p_first, n_values.

    Evidence classes are pairs of (class under the first reading, class under the
    second); their number is fixed, so a source is one row of at most 36 counts.
    """
    ev = (
        read.where("_kind is not null and (_a is not null or _b is not null)")
        .groupBy(F.coalesce("_dom", F.lit("")).alias("_src"), "_kind", _delay_class(F.col("_a"), F.col("_taken")).alias("ca"), _delay_class(F.col("_b"), F.col("_taken")).alias("cb"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("_order"))
    )
    by = ev.groupBy("_src", "_kind").agg(F.min("_order").alias("_order"), F.collect_list(F.struct(F.col("n").cast("double").alias("n"), _likelihood(F.col("ca"), density).alias("la"), _likelihood(F.col("cb"), density).alias("lb"))).alias("ev"))
    total = F.aggregate("ev", F.lit(0.0), lambda a, e: a + e["n"])
    prior = lambda i: F.try_element_at(_map({k: v[i] for k, v in PRIORS.items()}), F.col("_kind"))
    # one EM step: the expected share of first readings, with the pseudo counts of the kind
    step = lambda p: (F.aggregate("ev", F.lit(0.0), lambda a, e: a + e["n"] * (p * e["la"]) / (p * e["la"] + (1.0 - p) * e["lb"] + 1e-12)) + prior(0)) / (total + prior(0) + prior(1))
    em = F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), prior(0) / (prior(0) + prior(1)), lambda p, _: step(p))
    listed = F.col("_kind") == "order"
    p = F.when(listed & (F.col("_order") == "DMY"), F.lit(1.0)).when(listed & (F.col("_order") == "MDY"), F.lit(0.0)).otherwise(em)
    return by.select("_src", "_kind", p.alias("p_first"), total.cast("long").alias("n_values"))


def normalize(df: DataFrame, text: str, sender: str, registry: DataFrame, taken_at: str | None = None) -> DataFrame:
    """Adds ``utc_us``, ``reading``, ``posterior`` and ``ambiguous`` to the rows of ``df``; columns of these names are replaced."""
    kept = [f"_row.`{c}`" for c in df.columns if c not in ("utc_us", "reading", "posterior", "ambiguous")]
    # the readings feed the densities, the EM and the choice: parsed once, kept in the shared scratch folder
    x = materialize(readings(df, text, sender, registry, taken_at), "readings")
    density = delay_likelihoods(x)
    x = x.withColumn("_src", F.coalesce("_dom", F.lit(""))).join(posteriors(x, density), ["_src", "_kind"], "left")
    p = F.col("p_first")
    la, lb = (_likelihood(_delay_class(F.col(c), F.col("_taken")), density) for c in ("_a", "_b"))
    la, lb = p * la, (1.0 - p) * lb
    # null where the prior leaves no reading that the calendar allows
    first = F.when(la + lb > 0, la / (la + lb))
    x = x.withColumn("_first", F.when(F.col("_kind").isNull(), F.lit(1.0)).otherwise(first))
    us = F.when(F.col("_first") >= 0.5, F.col("_a")).when(F.col("_first") < 0.5, F.col("_b"))
    order = F.when(F.col("_first") < 0.5, "mdy").when(F.col("_first") >= 0.5, "dmy").otherwise(F.when(F.col("_order") == "MDY", "mdy").otherwise("dmy"))
    sure = F.when(F.col("_a").eqNullSafe(F.col("_b")), 1.0).otherwise(F.greatest(F.col("_first"), 1.0 - F.col("_first")))
    out = (
        x.withColumn("utc_us", us)
        .withColumn("reading", F.when(F.col("_kind") == "order", order).otherwise(F.coalesce("_form", F.when(F.col("_epoch").isNotNull(), "epoch"))))
        .withColumn("posterior", F.when(F.col("utc_us").isNotNull(), sure))
        .withColumn("ambiguous", F.coalesce((F.col("posterior") < SETTLED), F.lit(False)))
    )
    return out.select(*kept, "utc_us", "reading", "posterior", "ambiguous")
