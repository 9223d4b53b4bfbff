"""CIDR tests of textual addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import Network

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Strict dotted quad: four parts, none above 255, no leading zeros, nothing else.
IPV4 = rf"(?d)^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"


def ipv4_number(v: Column) -> Column:
    """The address as a number, or null if the text is no strict dotted quad."""
    parts = F.split(v, r"\.")
    valid = v.rlike(IPV4)
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.coalesce(F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0))
    return F.when(valid, number)


def address_in(text: str, net: Network) -> bool:
    """Whether text is an address of the network; other families never are."""
    import ipaddress

    if not text or len(text) >= 46 or "%" in text:
        return False
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return False
    if address.version != net.version:
        return False
    shift = len(net.address) * 8 - net.prefix
    return int(address) >> shift == int.from_bytes(net.address, "big") >> shift


def in_network(v: Column, net: Network) -> Column:
    """v4 in JVM expressions; v6 texts, which few rules ask for, in Arrow batches."""
    if net.version == 4:
        mask = (0xFFFFFFFF << (32 - net.prefix)) & 0xFFFFFFFF
        number = F.when(v.rlike(IPV4), ipv4_number(v))
        return number.bitwiseAND(F.lit(mask)) == F.lit(int.from_bytes(net.address, "big") & mask)

    @F.udf(T.BooleanType(), useArrow=True)
    def in_v6(text):
        return None if text is None else address_in(text, net)

    # Only what may be a v6 text crosses over to Python.
    return in_v6(F.when(v.contains(":"), v))
