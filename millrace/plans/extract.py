"""Extraction replies to typed, validated records."""

from __future__ import annotations

import difflib
import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import text as T

#: Plain text fields: empty counts as null.
TEXTS = [
    "description", "meeting_schedule", "location", "contact", "member_count", "fee", "age_range", "skill_level",
    "join_process", "leader", "phone", "language",
]


def validated(rows: DataFrame) -> DataFrame:
    """Fields as the catalogue keeps them: schemes, links, e-mail, tags, sources and the derived id."""
    empty = F.array().cast("array<string>")
    whole = rows.withColumns(
        {
            **{c: F.nullif(F.col(c), F.lit("")) for c in TEXTS},
            "website": T.ensure_scheme(F.col("website")),
            "social_links": T.valid_links(F.coalesce("social_links", empty)),
            "email": T.email_or_null(F.col("email")),
            "tags": T.clean_tags(F.coalesce("tags", empty)),
            "joinable": F.coalesce("joinable", F.lit(True)),
            "founding_year": F.nullif(F.col("founding_year"), F.lit(0)),
            "source_urls": T.prepend_if_absent(F.coalesce("source_urls", empty), F.col("source_url")),
        }
    )
    return whole.withColumn("community_id", F.coalesce("community_id", T.community_id(F.col("name"), F.col("city"))))


def parsed(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each item of a reply's `communities` that has a name, with the page's own columns.

    A reply that can't be read gives no rows here; `unreadable` lists those.
    """
    reply = F.from_json(F.col(raw), f"communities array<struct<{schemas.RECORD_FIELDS}>>")
    items = replies.withColumn("item", F.explode(reply.communities)).drop(raw)
    named = items.where(F.coalesce(F.col("item.name") != "", F.lit(False)))
    kept = [c for c in ("city", "topic", "locale", "extracted_at") if c in replies.columns]
    rows = named.select("item.*", *kept, F.col("url").alias("source_url"))
    absent = F.lit(None).cast("string")
    rows = rows.withColumns({"source_urls": F.array().cast("array<string>"), "community_id": absent})
    return validated(rows)


def unreadable(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies that are no object with a list, to be tried again rather than cached as empty."""
    reply = F.from_json(F.col(raw), f"communities array<struct<{schemas.RECORD_FIELDS}>>")
    return replies.where(F.coalesce(reply.communities, F.lit(None)).isNull())


def joinable(records: DataFrame) -> DataFrame:
    return records.where("joinable")


def fingerprint(prompt: Column, model: Column) -> Column:
    """What a cached extraction depends on."""
    return T.sha_prefix(F.concat(prompt, model), 12)


# Kinds of negative examples.
KINDS = ["extraction", "enrichment"]
#: What stands before the examples of a kind.
HEADINGS = {"extraction": "Not to be extracted:", "enrichment": "Not to be taken over again:"}


def relevant(negatives: DataFrame, city: str = "", topic: str = "", kind: str = "extraction") -> DataFrame:
    """Negative examples of a kind that hold for a place and a topic; blank means any."""
    fits = F.coalesce("fp_type", F.lit("extraction")) == kind
    for column, value in (("city", city), ("topic", topic)):
        if value:
            fits &= F.col(column) == value
    return negatives.where(fits)


def _bullets(order: str) -> Column:
    line = F.concat(F.lit('- "'), "name", F.lit('": '), F.coalesce("reason", F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x.line), "\n")


def effective_prompt(
    base: str, negatives: DataFrame, city: str = "", topic: str = "", kind: str = "extraction", order: str = "marked_at"
) -> DataFrame:
    """One row: the prompt with the negative examples that hold for the place and topic, in the order in which they were stored.

    A prompt holds its examples as one text, so this is for a place and topic, as `effective_prompts` is for all.
    """
    section = relevant(negatives, city, topic, kind).agg(_bullets(order).alias("lines"), F.count("*").alias("fp_count"))
    return section.select(_with_section(base, kind).alias("prompt"), "fp_count")


def _with_section(base: str, kind: str) -> Column:
    return F.when(F.col("fp_count") > 0, F.concat(F.lit(f"{base}\n\n{HEADINGS[kind]}\n"), "lines")).otherwise(base)


def effective_prompts(base: str, negatives: DataFrame, by: list[str], kind: str = "extraction", order: str = "marked_at") -> DataFrame:
    """The prompt of each place or topic that has negative examples."""
    section = relevant(negatives, kind=kind).groupBy(*by).agg(_bullets(order).alias("lines"), F.count("*").alias("fp_count"))
    return section.select(*by, _with_section(base, kind).alias("prompt"), "fp_count")


def negative_counts(negatives: DataFrame) -> DataFrame:
    """One row: negative examples of each kind."""
    return negatives.agg(*[F.count_if(F.coalesce("fp_type", F.lit("extraction")) == k).alias(k) for k in KINDS])


def line_diff(old: Column, new: Column) -> Column:
    """The line differences of two texts as HTML: added and removed lines marked, hints left out, null counts as empty."""

    @F.arrow_udf("string")
    def compare(olds: pa.Array, news: pa.Array) -> pa.Array:
        return pa.array([_diff_html(a.as_py() or "", b.as_py() or "") for a, b in zip(olds, news)], pa.string())

    return compare(old, new)


def _diff_html(old: str, new: str) -> str:
    marks = {"+ ": '<span class="diff-add">{}</span>', "- ": '<span class="diff-del">{}</span>', "  ": "{}"}
    lines = difflib.ndiff(old.splitlines(keepends=True), new.splitlines(keepends=True))
    return "".join(marks[x[:2]].format(html.escape(x[2:], quote=False)) for x in lines if x[:2] in marks)


def prompt_versions(history: DataFrame, base: str) -> DataFrame:
    """Stored prompt versions, newest first, each with its difference from the one before (the first: from the base prompt)."""
    by = Window.partitionBy("fp_type").orderBy("version")
    before = F.coalesce(F.lag("content").over(by), F.lit(base))
    shown = history.withColumn("diff_html", line_diff(before, F.col("content")))
    return shown.orderBy("fp_type", F.desc("version"))
