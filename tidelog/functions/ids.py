"""Deterministic ids: SHA-256 over NUL-joined parts, its first 128 bits in Crockford's base 32."""

from __future__ import annotations

from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def stable_id(*parts):
    """26 characters: 130 bits, the first two of them zero."""
    hex_ = F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32)
    # Five bits each need 20-bit groups of five hexadecimal digits; two zero bits lead.
    bits = F.concat(F.lit("00"), *[F.lpad(F.conv(F.substring(hex_, 4 * i + 1, 4), 16, 2), 16, "0") for i in range(8)])
    return F.concat(*[F.substring(F.lit(CROCKFORD), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, 1) for i in range(26)])


def hex_id(n):
    """Moment and episode ids as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(n)), 16, "0")
