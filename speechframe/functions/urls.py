"""Classification of delivery targets. No name is resolved: the address is a column."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Translated IPv4 addresses, and the range of ordinary IPv6 addresses.
TRANSLATED = ipaddress.ip_network("64:ff9b::/96")
ORDINARY = ipaddress.ip_network("2000::/3")


def _contacted(text: str):
    """The address that would be reached: the IPv4 one inside a mapped or translated address."""
    address = ipaddress.ip_address(text)
    if address.version == 4:
        return address
    inner = address.packed[-4:]
    return ipaddress.IPv4Address(inner) if address.ipv4_mapped or address in TRANSLATED else address


def public_address(text: str) -> bool:
    """Whether an address may be contacted: reachable from anywhere and a single host."""
    try:
        address = _contacted(text)
    except ValueError:
        return False
    ordinary = address.version == 4 or address in ORDINARY
    return ordinary and address.is_global and not address.is_multicast


@F.pandas_udf(T.BooleanType())
def is_public(addresses: pd.Series) -> pd.Series:
    return addresses.map(public_address, na_action="ignore")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_problem(url: Column, *, allow_private: bool = False) -> Column:
    """First broken rule of a target URL, NULL if it is well formed."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    netloc = authority(url)
    port = F.regexp_extract(netloc, r":([^:\]]*)$", 1)
    host = F.regexp_extract(netloc, r"^(\[[^\]]*\]|[^:]*)", 1)
    schemes = ("https", "http") if allow_private else ("https",)
    bad_port = (port != "") & ~(
        port.rlike(r"^[0-9]+$") & F.coalesce(port.try_cast("bigint") <= 65535, F.lit(False))
    )
    return (
        F.when(F.coalesce(~scheme.isin(*schemes), F.lit(True)), "scheme")
        .when(F.contains(netloc, F.lit("@")), "credentials")
        .when(bad_port, "port")
        .when(host.isin("", "[]"), "host")
    )


def target_problem(url: Column, addresses: Column, *, allow_private: bool = False) -> Column:
    """As :func:`url_problem`, and the resolved addresses must exist and all be public."""
    shape = url_problem(url, allow_private=allow_private)
    if allow_private:
        return shape
    return F.coalesce(
        shape,
        F.when(F.coalesce(F.size(addresses), F.lit(0)) < 1, "unresolved"),
        F.when(~_all_public(addresses), "private"),
    )


@F.pandas_udf(T.BooleanType())
def _all_public(lists: pd.Series) -> pd.Series:
    return lists.map(lambda a: all(public_address(x) for x in a), na_action="ignore")
