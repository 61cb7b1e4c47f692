"""Text and tag rules of knowledge records, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenfold.functions.redaction import scrub
from wrenfold.schema import EMBED_BYTES, KINDS, LIMITS, QUERY_OPTIONS


def strip(text: Column) -> Column:
    """The text without white space at both ends, Unicode's too."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def dedup_key(scope: Column, title: Column) -> Column:
    """`scope:slug`, the slug of what the title holds beside volatile tokens."""
    where = F.coalesce(F.nullif(strip(scope), F.lit("")), F.lit("global"))
    scrubbed = scrub(title)
    used = F.when(strip(scrubbed) == "", title).otherwise(scrubbed)
    slug = F.regexp_replace(F.lower(used), r"[^\p{IsAlphabetic}\p{N}]+", "-")
    return F.concat_ws(":", where, F.regexp_replace(slug, "^-|-$", ""))


def bounded(text: Column, most: int) -> Column:
    """A struct of the stripped value and why it is refused, of which one is null: `empty`, or `too long: bytes`."""
    value = strip(text)
    size = F.octet_length(value)
    reason = F.when(text.isNull() | (value == ""), "empty").when(size > most, F.concat(F.lit("too long: "), size.cast("string")))
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def clean_tags(tags: Column) -> Column:
    """A struct of the canonical tags and why they are refused: small, stripped, each once, in order."""
    stripped = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), strip), lambda t: t.isNotNull() & (t != ""))
    reason = F.when(F.size(tags) > LIMITS.tags, "too many tags").when(F.exists(stripped, lambda t: F.octet_length(t) > LIMITS.tag), "tag too long")
    return F.struct(F.when(reason.isNull(), F.array_distinct(F.transform(stripped, F.lower))).alias("value"), reason.alias("reason"))


def union_tags(old: Column, new: Column) -> Column:
    """The old tags, then the new, each in its first spelling."""
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    small = F.transform(both, F.lower)
    return _let(small, lambda lower: F.filter(both, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1))


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    """Whether each wanted tag is among the tags; A-Z and a-z are alike."""
    return F.forall(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda w: F.exists(tags, lambda t: _small(t) == _small(w))) if wanted else F.lit(True)


def _small(text: Column) -> Column:
    """The text with A-Z, and no other letter, made small."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def merge_verification(old: Column, new: Column) -> Column:
    """The old evidence, with the new below it unless blank or already there."""
    a, b = strip(old), strip(new)
    return (
        F.when((a == b) | (b == ""), old).when(a == "", new).when(F.contains(old, b), old)
        .otherwise(F.concat(a, F.lit("\n---\nAdditional verification: "), b))
    )


def embed_text(title: Column, context: Column, content: Column, verification: Column, tags: Column) -> Column:
    """What a record's vector is made from."""
    return F.concat_ws("\n", title, context, content, verification, F.concat_ws(" ", tags))


def head_bytes(text: Column, most: int = EMBED_BYTES) -> Column:
    """The longest start of at most `most` bytes that cuts no character."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most + 1)
    # bytes 0x80 to 0xBF continue a character: drop the character that crosses the end
    cut = F.regexp_replace(F.hex(raw), r"^((?:..)*)(?:[0-7C-F].)(?:[89AB].)*$", "$1")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(cut), "UTF-8"))


def kind_or(kind: Column, default: str | None = None) -> Column:
    """The kind if it is one of KINDS, else the default."""
    return F.when(kind.isin(*KINDS), kind).otherwise(F.lit(default))


def limit_of(asked: Column) -> Column:
    """A requested number of results: 5 where it is not a whole number from 0, then 1 to 50."""
    n = F.when(asked >= 0, asked)
    return F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(n, F.lit(5)))).cast("int")


def identifier_parts(token: Column) -> Column:
    """The token, then its parts at underscores, or else at changes of case; parts of one byte are dropped."""
    snake = F.filter(F.split(token, "_"), lambda p: (p != "") & (p != token))
    marked = F.regexp_replace(token, r"(?<=\p{javaLowerCase})(?=\p{javaUpperCase})|(?<=\p{javaUpperCase})(?=\p{javaUpperCase}\p{javaLowerCase})", "\u0000")
    camel = F.filter(F.split(marked, "\u0000"), lambda p: (F.octet_length(p) > 1) & (p != token))
    return F.concat(F.array(token), F.when(F.contains(token, F.lit("_")), snake).otherwise(camel))


def query_terms(query: Column) -> Column:
    """An array of structs (term, prefix): the query's tokens and their parts, each once whatever its case."""
    # each step is computed once a row: in a function of an array's items it would be once an item
    bound = _let(strip(query), lambda q: head_bytes(q, QUERY_OPTIONS.bytes))
    tokens = F.filter(F.split(bound, r"[^\p{IsAlphabetic}\p{N}_]+"), lambda t: t != "")
    parts = F.flatten(F.transform(tokens, identifier_parts))
    found = lambda p, small: F.filter(p, lambda t, i: F.array_position(small, F.lower(t)) == i + 1)
    once = _let(parts, lambda p: _let(F.transform(p, F.lower), lambda small: found(p, small)))
    return F.transform(F.slice(once, 1, QUERY_OPTIONS.terms), lambda t: F.struct(t.alias("term"), (F.length(t) >= QUERY_OPTIONS.prefix).alias("prefix")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
