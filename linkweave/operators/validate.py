"""Constraint checks of the page/link tables as violation reports (V1-V4).

Each check is a filter that tags offending rows with a rule name; reports are
unioned, so one scan per table answers every rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.sources import schemas as S

# Characters a valid title must not contain, maximum title length.
TITLE_FORBIDDEN = "<>{}[]|"
TITLE_MAX_LEN = 256


def constraint_violations(pages: DataFrame, links: DataFrame) -> DataFrame:
    """V1: ``(table, row_key, rule)`` for every broken row constraint."""
    status = F.col("fetch_status")
    page_rules = [
        ("status_domain", status.isNull() | ~status.isin(*S.STATUSES)),
        ("redirect_target", (status == S.STATUS_REDIRECT) & F.col("redirect_to").isNull()),
        (
            "fetched_at_required",
            ~status.isin(S.STATUS_PENDING, S.STATUS_ERROR) & F.col("fetched_at").isNull(),
        ),
        ("title_not_null", F.col("title").isNull()),
    ]
    link_rules = [
        ("target_not_null", F.col("target_title").isNull()),
        ("target_length", F.length("target_title") > S.MAX_TARGET_LEN),
    ]

    def tag(df, table, key, rules):
        arr = F.filter(
            F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]),
            lambda x: x.isNotNull(),
        )
        return df.select(F.lit(table).alias("table_name"), key.alias("row_key"), F.explode(arr).alias("rule"))

    p = tag(pages, "pages", F.col("id").cast("string"), page_rules)
    lk = F.concat_ws("|", F.col("source_id").cast("string"), F.col("target_title"))
    return p.unionByName(tag(links, "links", lk, link_rules))


def uniqueness_violations(pages: DataFrame, links: DataFrame) -> DataFrame:
    """V2: duplicated unique keys with their multiplicity."""
    t = (
        pages.groupBy("title")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.lit("pages.title").alias("key_name"), F.col("title").alias("key_value"), "n")
    )
    lk = (
        links.groupBy("source_id", "target_title")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            F.lit("links.source_target").alias("key_name"),
            F.concat_ws("|", F.col("source_id").cast("string"), "target_title").alias("key_value"),
            "n",
        )
    )
    return t.unionByName(lk)


def fk_orphans(links: DataFrame, pages: DataFrame) -> DataFrame:
    """V3: links whose source page does not exist."""
    return links.join(pages.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def valid_title(titles: DataFrame, col: str = "title") -> DataFrame:
    """V4: ``(title, valid, reason)``: non-empty, <= 256 characters, none of ``<>{}[]|``."""
    t = F.col(col)
    forbidden = "[" + "".join("\\" + ch for ch in TITLE_FORBIDDEN) + "]"
    reason = (
        F.when(t.isNull() | (F.length(t) == 0), F.lit("empty"))
        .when(F.length(t) > TITLE_MAX_LEN, F.lit("too_long"))
        .when(t.rlike(forbidden), F.lit("forbidden_character"))
    )
    return titles.select(t.alias("title"), reason.isNull().alias("valid"), reason.alias("reason"))
