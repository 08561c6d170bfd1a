"""User lookup with the computed account list (FLT-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import range_row_numbers

#: Account ids in one row of a paged list.
PAGE_IDS = 1000


def user_lookup(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """FLT-8: every user with the sorted list of their account ids and the
    count (the reference computes the list on read).  The list is built with
    a partial aggregation per user; one user's list is one row."""
    acc = accounts.groupBy("user_id").agg(
        F.array_sort(F.collect_list("account_id")).alias("account_ids"))
    return users.join(acc, "user_id", "left").select(
        "user_id", "name", "email",
        F.coalesce(F.col("account_ids"), F.array().cast("array<string>")).alias("account_ids"))


def user_account_pages(users: DataFrame, accounts: DataFrame, page_ids: int = PAGE_IDS) -> DataFrame:
    """FLT-8 for owners of very many accounts: the sorted list in pages of
    ``page_ids`` ids, numbered from 1, with the number of the page's first id.

    Ids are numbered by a distributed ranking, so neither the sort nor an array
    grows with one owner's accounts.  A user without accounts has one empty page;
    accounts of users that are not in ``users`` are left out, as in
    ``user_lookup``."""
    owned = accounts.select("user_id", "account_id").filter("user_id IS NOT NULL")
    ranked = range_row_numbers(owned, ["user_id"], [F.col("account_id")], out="number")
    pages = ranked.withColumn("page", F.ceil(F.col("number") / page_ids).cast("bigint")) \
        .groupBy("user_id", "page").agg(F.min("number").alias("first_number"),
                                        F.array_sort(F.collect_list("account_id")).alias("account_ids"))
    return users.select("user_id", "name", "email").join(pages, "user_id", "left").select(
        "user_id", "name", "email", F.coalesce("page", F.lit(1).cast("bigint")).alias("page"), "first_number",
        F.coalesce(F.col("account_ids"), F.array().cast("array<string>")).alias("account_ids"))
