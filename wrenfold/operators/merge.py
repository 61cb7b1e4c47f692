"""Merging of an incoming record into an existing one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenfold.functions.textops import merge_verification, strip, union_tags


def merged(old: Column, new: Column, at: Column) -> Column:
    """The record struct that results: id and creation stay, text is the new one's, tags and evidence are both's.

    A blank new title, and a null scope or key, leave the old one's.
    """
    return F.struct(
        old["id"].alias("id"),
        F.when(strip(F.coalesce(new["title"], F.lit(""))) == "", old["title"]).otherwise(new["title"]).alias("title"),
        new["kind"].alias("kind"),
        new["context"].alias("context"),
        new["content"].alias("content"),
        merge_verification(old["verification"], new["verification"]).alias("verification"),
        union_tags(old["tags"], new["tags"]).alias("tags"),
        F.coalesce(new["project_scope"], old["project_scope"]).alias("project_scope"),
        old["created_at"].alias("created_at"),
        at.alias("updated_at"),
        F.coalesce(new["dedup_key"], old["dedup_key"]).alias("dedup_key"),
    )
