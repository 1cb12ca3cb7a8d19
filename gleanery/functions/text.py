"""Column builders on texts: cleaning, measuring, scoring and classing. All are native expressions.

Null counts as the empty string throughout, as ``clean`` coalesces first.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery.functions.constants import AUTH, BAD_WORDS, BOT, DROP, EVIDENCE_CHARS, GOOD_WORDS, JUNK, UK_NAMES, US_NAMES, WARN_WORDS, WS


def strip(c: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def sanitize(c: Column) -> Column:
    """Without control characters, characters beyond the basic plane and noncharacters; no-break spaces become spaces."""
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{DROP}]", ""), F.lit(" "), F.lit(" "))


def clean(c: Column) -> Column:
    """Sanitised, runs of blanks one space, at most one blank line in a row, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(sanitize(c), "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def hits(low: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text in lower case holds."""
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def paragraphs(cleaned: Column) -> Column:
    return F.split(cleaned, f"\\n[{WS}]*\\n", -1)


def metrics(cleaned: Column, low: Column, paras: Column) -> dict[str, Column]:
    """chars, words (of ASCII word characters), paragraphs of eight words or more, sentences, phrase hits; given a cleaned text, the same in
    lower case and its paragraphs."""
    return {
        "chars": F.length(cleaned),
        "words": F.regexp_count(cleaned, F.lit("(?<![A-Za-z0-9_])[A-Za-z0-9_]+[A-Za-z0-9_'-]*")),
        "paragraphs": F.size(F.filter(paras, lambda p: F.regexp_count(p, F.lit(f"[{WS}]+")) >= 7)),
        "sentences": F.regexp_count(cleaned, F.lit(f"[.!?](?:[{WS}]|\\z)")),
        "junk_hits": hits(low, JUNK),
        "auth_hits": hits(low, AUTH),
        "bot_hits": hits(low, BOT),
    }


def marks(low_paras: Column) -> Column:
    """The first 260 letters and digits of each paragraph that has more than 60."""
    return F.filter(F.transform(low_paras, lambda p: F.substring(F.regexp_replace(p, "[^a-z0-9_]+", ""), 1, 260)), lambda p: F.length(p) > 60)


def duplicate_ratio(m: Column) -> Column:
    """Share of marks that stood before."""
    return F.when(F.size(m) > 0, F.floor((F.size(m) - F.size(F.array_distinct(m))) / F.size(m) * 1000 + 0.5) / 1000).otherwise(0.0)


def tenth(c: Column) -> Column:
    """Rounded to a tenth, halves up."""
    return F.floor(c * 10 + 0.5) / 10


def score(chars: Column, words: Column, paras: Column, sentences: Column, junk: Column, auth: Column, bot: Column, repeated: Column, min_chars: int = 300, penalty: bool = True) -> Column:
    raw = F.least(F.lit(45.0), chars / 120) + F.least(F.lit(25.0), words / 35) + F.least(F.lit(20.0), paras * 2.5) + F.least(F.lit(10.0), sentences / 4)
    raw = raw - F.when(chars < min_chars, 35.0).otherwise(0.0) - F.when(paras < 2, 15.0).otherwise(0.0)
    raw = raw - F.when(auth > 0, 45.0).otherwise(0.0) - F.when(bot > 0, 60.0).otherwise(0.0) - F.least(F.lit(30.0), junk * 8.0)
    raw = raw - (repeated * 20 if penalty else F.lit(0.0))
    return F.when(chars == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), tenth(raw))))


def status_number(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("int"))


def label(status: Column, chars: Column, words: Column, auth: Column, bot: Column, points: Column, min_chars: int = 300) -> Column:
    n = status_number(status)
    return (
        F.when(n == 429, "rate_limited").when(n.isin(401, 403), "auth_required").when(bot > 0, "bot_blocked").when(auth > 0, "auth_required").when(chars == 0, "failed")
        .when((chars < min_chars) | (words < 80), "partial_text").when(points >= 68, "full_text").when(points >= 42, "partial_text").otherwise("low_confidence")
    )


def confidence(points: Column, quality: Column) -> Column:
    return F.when((quality == "full_text") & (points >= 85), "high").when((quality == "full_text") | (points >= 68), "medium").when(quality.isin("partial_text", "low_confidence"), "low").otherwise("blocked_or_failed")


def judged(df, text: str, status: Column | None = None, min_chars: int = 300):
    """df with all measures of a text column: its metrics, duplicate ratio, score, label and confidence.

    What several measures share is a column of its own, which the optimizer keeps apart, so each is computed once.
    """
    out = df.withColumn("_clean", clean(F.col(text)))
    out = out.withColumns({"_low": F.lower("_clean"), "_paras": paragraphs(F.col("_clean"))})
    out = out.withColumn("_marks", marks(paragraphs(F.col("_low"))))
    out = out.withColumns(metrics(F.col("_clean"), F.col("_low"), F.col("_paras")) | {"duplicate_ratio": duplicate_ratio(F.col("_marks"))})
    names = ["chars", "words", "paragraphs", "sentences", "junk_hits", "auth_hits", "bot_hits", "duplicate_ratio"]
    out = out.withColumn("text_score", score(*(F.col(n) for n in names), min_chars=min_chars))
    out = out.withColumn("text_label", label(F.lit("200") if status is None else status, F.col("chars"), F.col("words"), F.col("auth_hits"), F.col("bot_hits"), F.col("text_score"), min_chars))
    return out.withColumn("confidence", confidence(F.col("text_score"), F.col("text_label"))).drop("_clean", "_low", "_paras", "_marks")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode's compatibility form, for which Spark has no function."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def duplicate_key(c: Column, compose: bool = True) -> Column:
    """The key under which titles are the same story; '' for blanks and words for nothing."""
    raw = strip(F.coalesce(c, F.lit("")))
    t = nfkc(raw) if compose else raw
    t = F.translate(t, "‘’“”", "''\"\"")
    t = F.trim(F.regexp_replace(F.lower(t), f"[{WS}]+", " "))
    t = F.regexp_replace(t, " *[|] *[^|]{2,80}\\z", "")
    t = F.regexp_replace(t, " +[-–—] +(?:breaking|live updates?|updated|analysis|opinion)(?![A-Za-z0-9_]).*\\z", "")
    t = F.regexp_replace(t, "(?<![A-Za-z0-9_])(?:updated|breaking)[: -]+", "")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    return F.when(F.lower(raw).isin("", "nan", "none", "null", "undefined"), "").otherwise(t)


def clip(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, a note of the full length among them."""
    note = F.concat(F.lit("\n\n[shortened; original length "), F.format_number(F.length(c), 0), F.lit(" chars]"))
    kept = F.regexp_replace(F.substring(c, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.length(note))), f"[{WS}]+\\z", "")
    return F.when(F.length(F.coalesce(c, F.lit(""))) <= limit, F.coalesce(c, F.lit(""))).otherwise(F.concat(kept, note))


def compact(c: Column, limit: int) -> Column:
    """On one line, cut with dots after ``limit`` characters."""
    one = strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", " "))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def country(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(s)
    return F.when(s == "", "Unknown").when(low.isin(US_NAMES), "United States").when(low.isin(UK_NAMES), "United Kingdom").otherwise(s)


def evidence_pack(c: Column, limit: int = EVIDENCE_CHARS) -> Column:
    """A long text's beginning, three samples of its middle and its end; a short text as it is."""
    front, back = int(limit * 0.42), int(limit * 0.3)
    length = max(400, (limit - front - back - 700) // 3)
    s = strip(F.coalesce(c, F.lit("")))
    n = F.length(s)
    middle = n - front - back
    samples = [strip(F.substring(s, F.lit(front + 1) + F.floor(F.greatest(F.lit(0), middle - length) * k / 4).cast("int"), F.least(F.lit(length), middle))) for k in (1, 2, 3)]
    packed = F.concat(
        F.lit("[BEGINNING]\n"), F.substring(s, 1, front), F.lit("\n\n[SAMPLES OF THE MIDDLE]\n"),
        F.array_join(F.filter(F.array(*samples), lambda x: x != ""), "\n\n--- SAMPLE ---\n\n"),
        F.lit("\n\n[END]\n"), F.substring(s, n - back + 1, F.lit(back)), F.lit("\n\n[NOTE: the article was longer than this pack.]"),
    )
    return F.when(n <= limit, s).otherwise(packed)


def pill(c: Column) -> Column:
    """Display class of a status; the first match holds."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("|".join(GOOD_WORDS)), "good").when(low.rlike("|".join(WARN_WORDS)), "warn").when(low.rlike("|".join(BAD_WORDS)), "bad").otherwise("info")


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / 1048576))
