"""Injection score and key leaks of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spaceful

BLOCK_AT = 2
# Texts that count two each wherever they stand, in either case.
SPECIAL = ["system:", "assistant:", "user:", "<|", "|>", "[INST]", "[/INST]"]
# Phrases and words with their scores; those of one entry count once.
PHRASES = [
    (["ignore previous"], 2), (["ignore all previous"], 2), (["ignored previous"], 2), (["ignoring previous"], 2),
    (["forget everything"], 2), (["forget all", "forgetting all"], 2), (["you are now"], 2), (["were now"], 2),
    (["pretend to be"], 2), (["pretending to be"], 2), (["new instructions"], 2), (["updated instructions"], 2),
    (["these are updated"], 2), (["ignore"], 1), (["ignored"], 1), (["ignoring"], 1), (["disregard"], 2),
    (["disregards"], 2), (["disregarded"], 2), (["disregarding"], 2), (["forget"], 1), (["forgetting"], 1),
    (["forgot"], 1), (["act as"], 1), (["acting as"], 1), (["pretend"], 1), (["pretending"], 1), (["system"], 1),
    (["ignorera tidigare"], 2), (["ignorera alla tidigare"], 2), (["glöm allt"], 2), (["du är nu"], 2),
    (["låtsas vara"], 2), (["agera som"], 2), (["nya instruktioner"], 2), (["uppdaterade instruktioner"], 2),
    (["strunta i"], 2), (["föregående instruktioner"], 2), (["ignorera"], 1), (["glöm"], 1),
]
# Key prefixes, least total length, and the characters that may follow up to white space.
DASHED, UNDERSCORED, UPPER, DOTTED, ANY = "[A-Za-z0-9_-]", "[A-Za-z0-9_]", "[A-Z0-9]", "[A-Za-z0-9._-]", r"[^ \t\n\f\r]"
KEYS = [
    ("sk-ant-api", 20, DASHED), ("sk-proj-", 20, DASHED), ("sk-", 20, DASHED), ("AKIA", 20, UPPER),
    ("ghp_", 40, UNDERSCORED), ("gho_", 40, UNDERSCORED), ("ghu_", 40, UNDERSCORED), ("ghs_", 40, UNDERSCORED),
    ("ghr_", 40, UNDERSCORED), ("github_pat_", 40, UNDERSCORED), ("xoxb-", 15, DASHED), ("xoxp-", 15, DASHED),
    ("xoxa-", 15, DASHED), ("SG.", 40, DOTTED), ("sk_live_", 24, UNDERSCORED), ("sk_test_", 24, UNDERSCORED),
    ("sess_", 32, UNDERSCORED), ("-----BEGIN", 10, ANY), ("AIza", 39, DASHED), ("Bearer ", 27, ANY),
]


def key_pattern() -> str:
    """One pattern, an alternative for each prefix; look-ahead, so that every position is tried."""
    parts = []
    for prefix, least, tail in KEYS:
        literal = "".join(f"\\{c}" if c in ".-" else c for c in prefix)
        parts.append(f"{literal}{tail}{{{max(0, least - len(prefix))},}}(?![^ \\t\\n\\f\\r])")
    return f"(?=({'|'.join(parts)}))"


def leaks(text: Column) -> Column:
    """The keys found, one for each position at most."""
    return F.regexp_extract_all(text, F.lit(key_pattern()), F.lit(1))


def injection_score(text: Column) -> Column:
    """Two for each special text, and the score of each phrase; each once.

    Phrases of several words also count without the blanks between; single words only as whole words.
    """
    lower, words = F.lower(text), spaceful(text)
    padded, joined = F.concat(F.lit(" "), words, F.lit(" ")), F.replace(words, F.lit(" "), F.lit(""))

    def hit(p: str) -> Column:
        if " " in p:
            return words.contains(p) | joined.contains(p.replace(" ", ""))
        return padded.contains(f" {p} ")

    score = F.lit(0)
    for s in SPECIAL:
        score = score + F.when(lower.contains(s.lower()), 2).otherwise(0)
    for phrases, worth in PHRASES:
        found = hit(phrases[0])
        for p in phrases[1:]:
            found = found | hit(p)
        score = score + F.when(found, worth).otherwise(0)
    return score


def scan_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add ``injection_score``, ``n_leaks`` and ``blocked``; a null text is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = texts.withColumn("injection_score", injection_score(t)).withColumn("n_leaks", F.size(leaks(t)))
    return out.withColumn("blocked", (F.col("injection_score") >= BLOCK_AT) | (F.col("n_leaks") > 0))


# Beginnings of texts that a chat template writes.
TEMPLATE_STARTS = ["<|im_start|>", "<|im_end|>", "<|end_header_id|>", "<|start_header_id|>", "<|eot_id|>", "[INST]", "[/INST]"]


def template_start(text: Column) -> Column:
    """Whether a text begins like a chat template's mark, in either case."""
    lower, out = F.lower(text), F.lit(False)
    for start in TEMPLATE_STARTS:
        out = out | lower.startswith(start.lower())
    return out


def scan_outbound(texts: DataFrame, needles: list[str] = (), text: str = "text") -> DataFrame:
    """Add ``n_leaks`` and ``blocked`` for texts that go out: keys, and texts of one's own that must not leave (``needles``).

    Injection phrases don't block, and a null text is empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.size(leaks(t))
    for needle in needles:
        found = found + F.contains(t, F.lit(needle)).cast("int")
    return texts.withColumn("n_leaks", found).withColumn("blocked", F.col("n_leaks") > 0)


def released(texts: DataFrame, text: str = "text", notice: str = "[withheld]") -> DataFrame:
    """``texts`` after :func:`scan_outbound` or :func:`scan_texts` with what is blocked replaced by ``notice``."""
    return texts.withColumn(text, F.when(F.col("blocked"), F.lit(notice)).otherwise(F.col(text)))
