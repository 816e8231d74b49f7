"""Client networks and keyed ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4_network(ip: Column, bits: int = 24) -> Column:
    """a.b.c.0/24 (or the address itself at 32); null where it is no IPv4 address; mapped addresses count as IPv4."""
    plain = F.regexp_replace(F.lower(ip), "^::ffff:", "")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    valid = plain.rlike(rf"^{octet}(\.{octet}){{3}}$")
    if bits == 32:
        return F.when(valid, plain)
    return F.when(valid, F.concat(F.substring_index(plain, ".", 3), F.lit(".0/24")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA-256 of a string column under a short key, built from two digests."""
    if len(key) > 64:
        raise ValueError("the key is at most one block")
    padded = key.ljust(64, b"\x00")
    inner, outer = (F.lit(bytearray(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def ipv6_network(ip: Column, groups: int = 4) -> Column:
    """The first 16-bit groups of an IPv6 address (4: /64, 3: /48), zeros written out; null where it is none."""
    low = F.lower(ip)
    head, tail = F.split_part(low, F.lit("::"), F.lit(1)), F.split_part(low, F.lit("::"), F.lit(2))
    parts = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    short = F.contains(low, F.lit("::"))
    missing = F.greatest(F.lit(8) - F.size(parts(head)) - F.size(parts(tail)), F.lit(0))
    full = F.when(short, F.concat(parts(head), F.array_repeat(F.lit("0"), missing), parts(tail))).otherwise(parts(low))
    valid = low.rlike(r"^[0-9a-f:]+$") & low.rlike(r"^(?:[0-9a-f]{0,4}:){2,8}[0-9a-f]{0,4}$") & (F.size(full) == 8) & ~low.rlike("::.*::")
    cut = F.transform(F.slice(full, 1, groups), lambda g: F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0")))
    return F.when(valid, F.concat(F.array_join(cut, ":"), F.lit(f"::/{16 * groups}")))
