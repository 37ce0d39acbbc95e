"""What an incoming item asks for, and whether it needs a closer look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as T

RULES = {"no_topic_high_score": 20, "ask_without_specifics": 15, "many_questions": 15, "deadline_unresolved": 15, "long_body": 15, "thin_body_with_attachments": 15, "image_needs_vision": 20, "delegated_unread": 15, "contradictory_direction": 10, "new_and_nontrivial": 10, "long_thread": 10, "resolved_credit": -15}
THRESHOLD = 35


def questions(body: Column) -> Column:
    """At most five lines of ten to 220 characters that end in a question mark."""
    return F.slice(F.transform(T.matches(body, r"(?m)^[^\n]{10,220}\?\s*$"), lambda q: F.regexp_replace(q, r"^\s+|\s+$", "")), 1, 5)


def first_lines(text: Column, n: int = 3, width: int = 120) -> Column:
    rows = F.filter(F.transform(T.lines(text), lambda x: F.btrim(x)), lambda x: x.rlike("[A-Za-z0-9]"))
    return F.array_join(F.transform(F.slice(rows, 1, n), lambda x: F.substring(x, 1, width)), " / ")


def markings(text: Column, pattern: str = r"(?i)\b(?:strictly confidential|confidential|internal use only|restricted|secret)\b") -> Column:
    """At most four distinct handling marks, in capitals, spaces evened out."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(T.matches(text, pattern), lambda m: F.upper(F.regexp_replace(m, r"[\s:]+", " "))))), 1, 4)


def envelope(items: DataFrame) -> DataFrame:
    """(item, title, body, participants, codes, date) with defaults: lists are never null, codes and topics are one sorted list."""
    arr = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return items.select("item", F.coalesce(F.nullif(F.btrim("title"), F.lit("")), F.lit("untitled")).alias("title"), F.substring(F.coalesce("body", F.lit("")), 1, 8000).alias("body"), arr(F.col("participants")).alias("participants"), F.array_sort(F.array_union(arr(F.col("codes")), arr(F.col("topics")))).alias("codes"), F.date_format("date", "yyyy-MM-dd").alias("date"))


def escalation(signals: DataFrame, rules: dict[str, int] | None = None) -> DataFrame:
    """Adds ambiguity (0 to 100), confidence and reasons to signals (body_len, n_topics, score, n_actions, n_questions,
    n_deadlines, deadline_state, n_attachments, n_delegating, n_parsed, n_vision, aside, is_new, group_size)."""
    g = RULES | (rules or {})
    c = F.col
    when = {
        "no_topic_high_score": (c("n_topics") == 0) & (c("score") >= 40),
        "ask_without_specifics": (c("n_actions") > 0) & (c("n_questions") == 0) & (c("n_deadlines") == 0),
        "many_questions": c("n_questions") >= 3,
        "deadline_unresolved": F.coalesce(c("deadline_state") == "unresolved", F.lit(False)),
        "long_body": c("body_len") > 3000,
        "thin_body_with_attachments": (c("body_len") < 400) & (c("n_attachments") > 0),
        "image_needs_vision": c("n_vision") > 0,
        "delegated_unread": (c("n_delegating") > 0) & (c("n_parsed") == 0),
        "contradictory_direction": (c("score") >= 50) & c("aside"),
        "new_and_nontrivial": c("is_new") & (c("score") >= 40),
        "long_thread": c("group_size") >= 4,
        "resolved_credit": (c("body_len") < 800) & (c("n_topics") > 0) & (c("score") < 40) & ~((c("n_attachments") > 0) & (c("n_parsed") == 0)),
    }
    total = sum((F.when(v, g[k]).otherwise(0) for k, v in when.items()), F.lit(0))
    amb = F.greatest(F.lit(0), F.least(F.lit(100), total))
    why = F.array_join(F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in when.items()]), lambda x: x.isNotNull()), ",")
    return signals.withColumn("ambiguity", amb.cast("int")).withColumn("confidence", (100 - amb).cast("int")).withColumn("reasons", why)
