"""Content-derived identities: SHA-256 over length-prefixed parts, digests of canonical JSON, seeds, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of stable identity; each is a prefix of its own.
KINDS = ("doc", "page", "region", "evidence", "delta", "state", "layer", "artifact", "model", "request")


def as_bytes(part: Column) -> Column:
    return part.cast("binary")


def big_endian(number: Column, size: int) -> Column:
    """An unsigned integer as ``size`` bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))


def derived_id(kind: str, *parts: Column) -> Column:
    """``kind_`` and the digest of kind, NUL, and each part behind its length in 8 bytes."""
    if kind not in KINDS:
        raise ValueError(f"no such identity: {kind}")
    framed = [F.concat(big_endian(F.octet_length(p), 8), as_bytes(p)) for p in parts]
    return F.concat(F.lit(f"{kind}_"), F.sha2(F.concat(F.lit(kind.encode() + b"\0"), *framed), 256))


def digest_of_json(*columns: Column) -> Column:
    """Digest of a compact JSON object of the columns in their order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def derived_seed(seed: Column, index: Column, identity: Column) -> Column:
    """The first 8 digest bytes of seed, index and identity as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat(big_endian(seed, 8), big_endian(index, 8), as_bytes(identity)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_id(kind: str, text: Column) -> Column:
    return text.rlike(f"^{kind}_[0-9a-f]{{64}}$")


def is_token(text: Column) -> Column:
    return text.rlike("^[a-z0-9][a-z0-9._-]{0,127}$")


def is_relative_path(text: Column) -> Column:
    """No root, drive, empty, dot or backslash component."""
    return (text != "") & ~text.rlike(r"(^/|\\|^[A-Za-z]:|(^|/)(\.|\.\.)?(/|$))")


def parsed_bytes(text: Column) -> Column:
    """A size such as ``1.5 GiB`` in bytes; null unless exact, unsigned, of 9 decimals at most."""
    pattern = r"^(\d+)(?:\.(\d{1,9}))?\s*(B|[KMGT]B|[KMGT]iB)?$"
    whole, decimals, unit = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    factor = F.lit(1).cast("decimal(20,0)")
    chain = F.when(unit.isin("", "B"), factor)
    for power, letter in enumerate("KMGT", 1):
        chain = chain.when(unit == f"{letter}B", F.lit(1000**power).cast("decimal(20,0)")).when(unit == f"{letter}iB", F.lit(1024**power).cast("decimal(20,0)"))
    billionths = F.concat(whole, F.rpad(decimals, 9, "0")).cast("decimal(30,0)") * chain
    exact = F.try_divide(billionths, F.lit(1_000_000_000).cast("decimal(20,0)"))
    return F.when(text.rlike(pattern) & (billionths % 1_000_000_000 == 0), exact.cast("decimal(20,0)"))


def shown_bytes(size: Column) -> Column:
    """The largest binary unit that divides the size."""
    chain = F.when(size == 0, "0 B")
    for power, letter in reversed(list(enumerate("KMGT", 1))):
        chain = chain.when(size % 1024**power == 0, F.concat((size / 1024**power).cast("decimal(20,0)").cast("string"), F.lit(f" {letter}iB")))
    return chain.otherwise(F.concat(size.cast("decimal(20,0)").cast("string"), F.lit(" B")))


def compatibility(major: Column, minor: Column, known_major: int, known_minor: int) -> Column:
    return F.when(major != known_major, "incompatible_major").when(minor > known_minor, "newer_minor").otherwise("compatible")
