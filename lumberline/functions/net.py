"""IP addresses and networks as plain columns.

IPv4 addresses become a BIGINT; IPv6 addresses become 32 hexadecimal digits, so
that string order is address order. Everything stays inside code generation.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumberline.functions.binding import let

# Ranges that count as private (RFC 1918, link-local, loopback).
PRIVATE_NETWORKS = (
    "172.16.0.0/12",
    "192.168.0.0/16",
    "10.0.0.0/8",
    "169.254.0.0/16",
    "127.0.0.0/8",
)

_V4 = r"\A(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"
_V4_TAIL = r"\A(.*:)(\d{1,3}(?:\.\d{1,3}){3})\z"


def ip4_number(ip: Column) -> Column:
    """Dotted quad -> BIGINT; NULL for NULL, empty or unparsable text."""
    zero = F.lit(0).cast("bigint")
    number = F.aggregate(F.split(ip, r"\."), zero, lambda acc, octet: acc * 256 + octet.cast("bigint"))
    return F.when(ip.rlike(_V4), number)


def ip_to_long(ip: Column) -> Column:
    """The numeric helper: 0 for text that is not an IPv4 address."""
    return F.coalesce(ip4_number(ip), F.lit(0).cast("bigint"))


def ip4_text(number: Column) -> Column:
    """BIGINT -> dotted quad."""
    byte = [F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *byte)


def ip6_hex(ip: Column) -> Column:
    """IPv6 text (also ``::`` and dotted tails) -> 32 hex digits, else NULL."""
    text = F.lower(ip)

    def with_hex_tail(number: Column) -> Column:
        high, low = F.shiftright(number, 16), number.bitwiseAND(F.lit(65535))
        return F.concat(
            F.regexp_extract(text, _V4_TAIL, 1), F.lower(F.hex(high)), F.lit(":"), F.lower(F.hex(low))
        )

    dotted = let(ip4_number(F.regexp_extract(text, _V4_TAIL, 2)), with_hex_tail)
    full = F.when(text.contains("."), dotted).otherwise(text)

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def sides(halves: Column) -> Column:
        right = F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return F.struct(groups(halves[0]).alias("left"), right.alias("right"), F.size(halves).alias("n"))

    def filled(s: Column) -> Column:
        missing = F.lit(8) - F.size(s["left"]) - F.size(s["right"])
        fits = F.when(s["n"] == 1, missing == 0).otherwise((s["n"] == 2) & (missing >= 1))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(fits, F.concat(s["left"], zeros, s["right"]))

    def joined(all_groups: Column) -> Column:
        digits = F.forall(all_groups, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
        return F.when(digits, F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), ""))

    built = let(let(let(F.split(full, "::", -1), sides), filled), joined)
    return F.when(ip.contains(":"), built)


def ip6_text(digits: Column) -> Column:
    """32 hex digits -> IPv6 text in its shortest usual form (the longest run of zero groups left out)."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), r"\A0{1,3}", "")
    )

    def shortened(text: Column) -> Column:
        out = text
        for zeros in range(2, 9):  # the last match, so the longest run, counts
            pattern = rf"\A(|.*?:)0(?::0){{{zeros - 1}}}(:.*|)\z"
            head, tail = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
            short = F.concat(F.when(head == "", ":").otherwise(head), F.when(tail == "", ":").otherwise(tail))
            out = F.when(text.rlike(pattern), short).otherwise(out)
        return out

    return let(F.array_join(groups, ":"), shortened)


def address_key(ip: Column) -> Column:
    """An address of either family as text whose order is address order: ``4`` and 8 or ``6`` and 32 hex digits."""
    four = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ip4_number(ip))), 8, "0"))
    return F.when(ip.contains(":"), F.concat(F.lit("6"), ip6_hex(ip))).otherwise(four)


def masked_key(key: Column, length: Column, fill: str) -> Column:
    """An address key with all bits behind the first ``length`` set to 0 or 1 (``fill`` is ``0`` or ``f``)."""
    whole, rest = F.shiftright(length, 2), length.bitwiseAND(F.lit(3))
    digit = F.conv(F.substr(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    free = F.call_function("shiftright", F.lit(15), rest)
    cut = digit - digit.bitwiseAND(free) if fill == "0" else digit.bitwiseOR(free)
    last = F.when(rest > 0, F.lower(F.hex(cut))).otherwise(F.lit(""))
    head = F.concat(F.substr(key, F.lit(1), whole + 1), last)
    return F.when(key.startswith("4"), F.rpad(head, 9, fill)).otherwise(F.rpad(head, 33, fill))


def network_keys(network: Column) -> Column:
    """CIDR text of either family -> struct(lo, hi, len) of address keys; a lone address is its own network, else NULL."""
    base = address_key(F.substring_index(network, "/", 1))
    given = F.substring_index(network, "/", -1).try_cast("int")

    def of(base: Column) -> Column:
        most = F.when(base.startswith("4"), 32).otherwise(128)
        length = F.when(network.contains("/"), given).otherwise(most)
        bounds = F.struct(masked_key(base, length, "0").alias("lo"), masked_key(base, length, "f").alias("hi"), length.alias("len"))
        return F.when(base.isNotNull() & length.between(0, most), bounds)

    return let(base, of)


def network_bounds(network: str) -> tuple[int, int, int, int]:
    """(version, lowest, highest, prefix length) of a CIDR literal, on the driver."""
    net = ipaddress.ip_network(network, strict=False)
    return net.version, int(net.network_address), int(net.broadcast_address), net.prefixlen


def ipin(ip: Column, *networks: str) -> Column:
    """TRUE when ``ip`` lies in one of the networks; NULL, empty and bad text are FALSE."""
    bounds = [network_bounds(n) for n in networks]

    four = [(F.lit(lo), F.lit(hi)) for version, lo, hi, _ in bounds if version == 4]
    six = [(F.lit(f"{lo:032x}"), F.lit(f"{hi:032x}")) for version, lo, hi, _ in bounds if version == 6]
    found = F.lit(False)
    for ranges, known in ((four, ip4_number), (six, ip6_hex)):
        if ranges:
            found = found | F.coalesce(let(known(ip), _within(ranges)), F.lit(False))
    return found


def _within(ranges: list[tuple[Column, Column]]) -> Callable[[Column], Column]:
    def test(value: Column) -> Column:
        inside = F.lit(False)
        for lo, hi in ranges:
            inside = inside | value.between(lo, hi)
        return inside

    return test


def ipin_column(ip: Column, network: Column) -> Column:
    """``ipin`` for both families with the network given as a column."""
    within = let(network_keys(network), lambda r: address_key(ip).between(r["lo"], r["hi"]))
    return F.coalesce(within, F.lit(False))


def isprivateip(ip: Column) -> Column:
    return ipin(ip, *PRIVATE_NETWORKS)


def notprivateip(ip: Column) -> Column:
    """Not simply the negation: NULL and empty text are FALSE here as well."""
    known = ip.isNotNull() & (ip != "")
    return known & ~isprivateip(ip)


isremoteip = notprivateip


def netrange(network: Column) -> Column:
    """CIDR text of either family -> struct(lo, hi, lo_num, hi_num, lo_key, hi_key); NULL when it is not one.

    The numbers are for IPv4 only, as those of IPv6 do not fit 64 bits; the keys
    (:func:`address_key`) are for both.
    """

    def text(key: Column) -> Column:
        return F.when(key.startswith("4"), ip4_text(number(key))).otherwise(ip6_text(F.substring(key, 2, 32)))

    def number(key: Column) -> Column:
        return F.when(key.startswith("4"), F.conv(F.substring(key, 2, 8), 16, 10).cast("bigint"))

    def shown(r: Column) -> Column:
        return F.struct(
            text(r["lo"]).alias("lo"), text(r["hi"]).alias("hi"), number(r["lo"]).alias("lo_num"), number(r["hi"]).alias("hi_num"),
            r["lo"].alias("lo_key"), r["hi"].alias("hi_key"),
        )

    return let(network_keys(network), lambda r: F.when(r.isNotNull(), shown(r)))
