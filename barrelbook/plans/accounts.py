"""Account, post and comment ingestion with totals."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import from_epoch
from ..functions.numbers import flag
from ..functions.text import or_empty, strip_quotes
from ..operators.joins import anti_join, new_rows, semi_join
from ..operators.ranking import top_k_within


class Activity(NamedTuple):
    users: DataFrame
    posts: DataFrame
    comments: DataFrame


def found_accounts(*results: DataFrame) -> DataFrame:
    """The accounts that several searches found, each name once; NULL is no name."""
    names = [found.select("user_name") for found in results]
    return functools.reduce(DataFrame.unionByName, names).dropna().distinct()


def newest_posts(posts: DataFrame, max_posts: int | None = None) -> DataFrame:
    """The newest posts of every account, or all of them; with a limit, a hot account sends at
    most that many per task."""
    if max_posts is None:
        return posts
    ranked = top_k_within(posts, ["owner"], [F.col("date").desc(), F.col("code").asc()], max_posts, "_nth")
    return ranked.drop("_nth")


def account_activity(
    accounts: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    stored_users: DataFrame,
    stored_posts: DataFrame,
    added_at: str,
    max_posts: int | None = None,
) -> Activity:
    """What is new: accounts not stored yet, their newest posts not stored yet, the comments
    of these posts, and the totals of likes and comments per account over the new posts.

    ``accounts`` has user_name, ``posts`` owner, code, date (epoch seconds), likes_count,
    comments_count, ``comments`` post_id; further columns of the stored tables are cleaned
    if present and passed on.
    """
    moment = F.lit(added_at).cast("timestamp_ntz").alias("added_at")
    users = new_rows(accounts, stored_users, ["user_name"])
    owned = semi_join(posts, users.select(F.col("user_name").alias("owner")), "owner")
    fresh = anti_join(newest_posts(owned, max_posts), stored_posts, "code").select(*posts.columns)

    cleaned = {
        "caption": strip_quotes(or_empty(F.col("caption"))),
        "location": or_empty(F.col("location")),
        "video_url": or_empty(F.col("video_url")),
        "date": from_epoch(F.col("date")),
        **{name: flag(F.col(name)) for name in ("comments_disabled", "is_ad", "is_album", "is_video")},
    }
    new_posts = fresh.withColumns({c: e for c, e in cleaned.items() if c in fresh.columns})
    said = semi_join(comments, fresh.select(F.col("id").alias("post_id")), "post_id")
    new_comments = said.withColumn("text", strip_quotes(F.col("text")))

    totals = fresh.groupBy(F.col("owner").alias("user_name")).agg(
        F.sum("comments_count").alias("total_comments"), F.sum("likes_count").alias("total_likes")
    )
    counted = users.join(totals, "user_name", "left").fillna(0, subset=["total_comments", "total_likes"])
    flags = {c: flag(F.col(c)) for c in ("is_verified", "country_block") if c in counted.columns}
    if "fb_page" in counted.columns:
        flags["fb_page"] = or_empty(F.col("fb_page"))
    return Activity(
        counted.withColumns(flags).select(moment, "*"),
        new_posts.select(moment, "*"),
        new_comments.select(moment, "*"),
    )
