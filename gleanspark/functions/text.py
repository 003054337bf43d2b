"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unquote(cell: Column) -> Column:
    """Trim; take off a pair of double quotes and halve doubled ones inside."""
    t = F.trim(cell)
    return F.when(t.startswith('"') & t.endswith('"') & (F.length(t) > 1), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)


def strip_html(html: Column) -> Column:
    """Drop tags; an unclosed one to the end, and a stray ``>``, go too."""
    return F.regexp_replace(html, r"<[^>]*(>|$)|>", "")


def first_words(text: Column, n: int = 200) -> Column:
    """The first ``n`` words, separated by single blanks."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """Characters by 3.2 if over a twentieth of them look like code, else by 3.8; rounded up."""
    chars = F.length(text)
    code = F.length(F.regexp_replace(text, r"[^{}();=<>]", ""))
    return F.ceil(chars / F.when(code > F.floor(chars / 20), F.lit(3.2)).otherwise(F.lit(3.8))).cast("long")


def spaceful(text: Column) -> Column:
    """Lower-cased letters and digits; every run of others is one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def line_shape(line: Column) -> Column:
    """Runs of ASCII digits as D, letters as A, blanks as S, others as O; outer white space doesn't count."""
    t = F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\p{L}+", "\x01")
    t = F.regexp_replace(t, "[0-9]+", "\x02")
    t = F.regexp_replace(t, " +", "\x03")
    t = F.regexp_replace(t, r"[^\x01-\x03]+", "O")
    return F.translate(t, "\x01\x02\x03", "ADS")


def dominant_shape(lines: DataFrame, line: str = "value", least: int = 3) -> DataFrame:
    """One row (``shape``, ``n``): the :func:`line_shape` that most lines have, if ``least`` have it; the first of equals by its letters. Blank lines don't count."""
    shapes = lines.where(F.col(line).rlike(r"\S")).groupBy(line_shape(F.col(line)).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return shapes.where(F.col("n") >= least).orderBy(F.desc("n"), "shape").limit(1)


def ipv4(number: Column) -> Column:
    """Dotted quad of an unsigned 32-bit address."""
    n = number.cast("long")
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def humanize_lag(seconds: Column) -> Column:
    """The largest whole unit of h, m and s."""
    s = seconds.cast("long")
    return F.when((s >= 3600) & (s % 3600 == 0), F.concat((s / 3600).cast("long"), F.lit("h"))).when((s >= 60) & (s % 60 == 0), F.concat((s / 60).cast("long"), F.lit("m"))).otherwise(F.concat(s, F.lit("s")))


def lag_words(seconds: Column) -> Column:
    """``2 hours``, ``1 minute``, ``0 seconds``: whole units of the largest that fits; below zero counts as none."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))

    def unit(size: int, name: str) -> Column:
        n = F.floor(s / size).cast("long")
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))

    return F.when(s >= 3600, unit(3600, "hour")).when(s >= 60, unit(60, "minute")).otherwise(unit(1, "second"))


def anchor_label(kind: Column, stream: Column) -> Column:
    """What an incident's anchor is called: a deployment or release by its stream's name, else its event or spike."""
    low = F.lower(stream)
    release = low.contains("release") | low.contains("rollout") | low.contains("ship")
    trigger = F.when(low.contains("deploy"), F.lit("Deployment")).when(release, F.lit("Release")).otherwise(F.concat(stream, F.lit(" event")))
    return F.when(kind == "trigger", trigger).otherwise(F.concat(stream, F.lit(" spike")))


def step_verb(direction: Column) -> Column:
    return F.when(direction == "decrease", "drops").otherwise("rises")


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def number(cell: Column) -> Column:
    """A decimal number, or null. Suffixes d and f, which a cast lets through, are no numbers."""
    t = F.trim(cell)
    return F.when(t.rlike(r"(?i)^[+-]?(inf|infinity|nan)$") | ~t.rlike("[dDfF]$"), t.try_cast("double"))


def is_data_dump(text: Column) -> Column:
    """Whether two lines or more have two bars each, or more than six lines are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    barred = F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    return (F.size(barred) >= 2) | (F.size(lines) > 6)


def normal_line(text: Column) -> Column:
    """Lower-cased, without outer white space and punctuation at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"[\s!-/:-@\[-`{-~]+$", ""))


def looks_iso8601(text: Column) -> Column:
    """Whether a text starts with ``yyyy-MM-dd``, ``T`` or a blank, and ``HH:mm:ss``."""
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}")


def escape_html(text: Column) -> Column:
    """``& < > "`` and ``'`` as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def escape_json(text: Column) -> Column:
    """The text as it stands within a JSON string."""
    quoted = F.to_json(F.struct(text.alias("t")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def bytes_text(values: Column, most: int = 8192) -> Column:
    """The text of an array of byte values; null if one is no byte or there are more than ``most``."""
    pairs = F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0"))
    valid = (F.size(values) <= most) & F.forall(values, lambda v: v.between(0, 255))
    return F.when(valid, F.decode(F.unhex(F.array_join(pairs, "")), "UTF-8"))


def shorten(text: Column, most: int = 160) -> Column:
    """At most ``most`` UTF-8 bytes, cut between characters, with an ellipsis if cut."""
    raw = text.cast("binary")
    # A cut inside a character leaves up to three of its bytes: step back to one that starts a character.
    ends = F.array(*(F.lit(most - k) for k in range(4)))
    whole = F.filter(ends, lambda n: ~F.hex(F.substring(raw, n + 1, F.lit(1))).rlike("^[89AB]"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), whole[0]), "UTF-8"), F.lit("…")))
