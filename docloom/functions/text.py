"""Column functions for text: JSON strings, digests, blob addresses, names, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.schemas import VERSION_PATTERN


def json_string(text: Column) -> Column:
    """Text as a JSON string; null as the literal null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.char_length(listed) - 2))


def digest_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def blob_path(digest: Column) -> Column:
    """Content address: the first two digits name the folder."""
    return F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def key_id(*parts: Column) -> Column:
    """An id that depends on the natural key alone, so that running again finds the same row. Each part comes with its
    length, so no two keys are written alike; a null part makes a null id."""
    return F.sha2(F.concat(*(F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


def valid_version(name: Column) -> Column:
    return F.coalesce(name.rlike(VERSION_PATTERN), F.lit(False))


# Fixed patterns of personal data and secrets; the order matters, secrets come first.
REDACTIONS = [
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[email]"),
    ("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "[ip]"),
    ("[0-9a-f]{32,}", "[secret]"),
    ("[+][0-9]{1,2} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "[phone]"),
    ("[0-9]{13,19}", "[number]"),
]


def redacted(text: Column) -> Column:
    for pattern, name in REDACTIONS:
        text = F.regexp_replace(text, pattern, name)
    return text


def search_tokens(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("(\\p{L}+)"), F.lit(1))
