"""Records as Markdown, a column expression each. The templates are fixed values: what users of such stores parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenfold.functions.textops import strip


def scope_label(scope: Column) -> Column:
    return F.coalesce(scope, F.lit("global"))


def tag_list(tags: Column, none: str = "") -> Column:
    return F.when(F.size(tags) == 0, none).otherwise(F.array_join(tags, ", "))


def compact(place: Column, r: dict[str, Column]) -> Column:
    """One search result in a few lines."""
    return F.format_string(
        "%d. **%s** (`%s`) - ID: `%s`\n   - **Scope:** `%s` | **Tags:** `%s`\n   - **Context:** %s\n   - **Fix:** %s\n\n",
        place, r["title"], r["kind"], r["id"], scope_label(r["project_scope"]), tag_list(r["tags"]), F.substring(r["context"], 1, 100), F.substring(r["content"], 1, 120),
    )


def full(place: Column, r: dict[str, Column], keyword_rank: Column, similarity: Column) -> Column:
    """One search result with all its text and why it was found."""
    signals = F.concat_ws(" | ", F.concat(F.lit("BM25 #"), keyword_rank.cast("string")), F.when(similarity.isNotNull(), F.format_string("Vector Sim: %.3f", similarity)))
    body = F.format_string(
        "---\n#### %d. %s `[%s]`\n- **ID:** `%s`\n- **Scope:** `%s` | **Tags:** %s\n- **Context:**\n  > %s\n- **Resolution:**\n```\n%s\n```\n- **Verification Evidence:**\n  > %s\n",
        place, r["title"], r["kind"], r["id"], scope_label(r["project_scope"]), tag_list(r["tags"], "none"), strip(r["context"]), strip(r["content"]), strip(r["verification"]),
    )
    return F.concat(body, F.when(signals != "", F.concat(F.lit("- **Match Signals:** "), signals, F.lit("\n"))).otherwise(""), F.lit("\n"))


def entry(r: dict[str, Column]) -> Column:
    """A whole record."""
    return F.format_string(
        "# %s\n\n- **Kind:** %s\n- **Scope:** %s\n- **Tags:** %s\n\n## Context\n%s\n\n## Resolution\n%s\n\n## Verification\n%s\n",
        r["title"], r["kind"], scope_label(r["project_scope"]), F.array_join(r["tags"], ", "), r["context"], r["content"], r["verification"],
    )


def recent(r: dict[str, Column]) -> Column:
    """A record's lines in the list of the latest."""
    return F.format_string(
        "- **%s** (`%s`) [%s]\n  - Context: %s\n  - Updated: %s\n\n", r["title"], r["kind"], scope_label(r["project_scope"]), F.substring(r["context"], 1, 120), r["updated_at"].cast("string")
    )


def saved(r: dict[str, Column], deduplicated: Column, secrets: Column) -> Column:
    """What a save reports."""
    return F.concat(
        F.format_string("### Knowledge Entry Saved Successfully\n\n- **ID:** `%s`\n- **Title:** %s\n- **Kind:** `%s`\n- **Scope:** `%s`\n- **Status:** ", r["id"], r["title"], r["kind"], scope_label(r["project_scope"])),
        F.when(deduplicated, "Updated in-place (deduplicated/merged)").otherwise("Created new entry"),
        F.lit("\n- **Tags:** "), tag_list(r["tags"], "none"), F.lit("\n"),
        F.when(secrets > 0, F.format_string("- **Security:** Redacted %d credentials before persisting", secrets)).otherwise(""),
        F.format_string("\n**Resolution Summary:**\n```\n%s\n```", F.substring(r["content"], 1, 300)),
    )


def deleted(entry_id: Column, found: Column) -> Column:
    return F.when(found, F.format_string("Successfully deleted knowledge entry `%s`.", entry_id)).otherwise(F.format_string("No knowledge entry found with ID `%s`.", entry_id))


def found_line(count: Column, query: Column, ranking: Column) -> Column:
    """The heading of a list of results."""
    return F.when(count == 0, F.format_string('No knowledge entries found matching query: "%s".', query)).otherwise(
        F.format_string('### Found %d Knowledge %s for "%s" (ranking: %s)\n\n', count, F.when(count == 1, "entry").otherwise("entries"), query, ranking)
    )
