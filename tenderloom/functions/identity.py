"""Stable identifiers and content hashes, all built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions.text import collapse, fold

LONGEST_KEY = 200


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of ``name`` in a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def name_fingerprint(name: Column) -> Column:
    """Twelve digits of the SHA-1 of the folded words; case and punctuation do not matter."""
    return F.left(F.sha1(F.trim(F.regexp_replace(fold(name), "[^0-9a-zа-я]+", " ")).cast("binary")), F.lit(12))


def external_id(own: Column, url: Column, name: Column) -> Column:
    """The source's own key, else the address, with the name's fingerprint where a page lists several; else null."""
    own, url, name = (F.trim(F.coalesce(c, F.lit(""))) for c in (own, url, name))
    address = F.left(url, F.lit(LONGEST_KEY))
    return (
        F.when(own != "", F.left(own, F.lit(LONGEST_KEY)))
        .when((url != "") & (name == ""), address)
        .when(url != "", F.concat(address, F.lit("#"), name_fingerprint(name)))
    )


def content_hash(texts: Sequence[str], codes: Sequence[str], attributes: str | None = None) -> Column:
    """SHA-256 of the named fields: texts folded and collapsed, codes as they are, attributes sorted.

    Price and availability are left out by not naming them.
    """
    parts = [F.lower(collapse(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in texts]
    parts += [F.coalesce(F.col(c), F.lit("")).alias(c) for c in codes]
    if attributes:
        pairs = F.transform(F.map_entries(F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), F.lower(collapse(e["value"]))))
        parts.append(F.array_sort(pairs).alias(attributes))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def item_id(lot: Column, name: Column, code: Column, repeat: Column) -> Column:
    """24 digits of a SHA-256 and the ordinal among equal items of the lot."""
    zero = F.lit("\u0000")
    return F.concat(F.left(F.sha2(F.concat(lot, zero, name, zero, code), 256), F.lit(24)), F.lit("-"), repeat.cast("string"))
