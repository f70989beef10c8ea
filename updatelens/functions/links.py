"""Links and hosts as column expressions."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from updatelens import constants as K
from updatelens.functions import text as T
from updatelens.functions.text import trim_ws
from updatelens.functions.values import sha256_upper

_PARTS = r"^(https?)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _percent_encode(c: Column) -> Column:
    """Characters that may not stand in a link as the percent codes of their UTF-8 bytes."""
    return F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(_plain(ch), ch).otherwise(
                F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )


def _plain(c: Column) -> Column:
    return c.rlike(r"^[\x21-\x7E&&[^\"<>\\^`{|}]]*$")


def _part(c: Column, index: int) -> Column:
    return F.regexp_extract(c, "(?i)" + _PARTS, index)


def _split(c: Column) -> Column:
    """The parts of an absolute http(s) link as a struct; null for anything else."""
    names = ["scheme", "user", "host", "port", "path", "query", "fragment"]
    parts = F.struct(*[_part(c, i).alias(n) for i, n in enumerate(names, 1)])
    return F.when(c.rlike("(?i)" + _PARTS), parts)


def _joined(p: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, path and query as given."""
    scheme, number = F.lower(p["scheme"]), p["port"].cast("int")
    default = (
        (p["port"] == "")
        | ((scheme == "http") & (number == 80))
        | ((scheme == "https") & (number == 443))
    )
    valid = (p["port"] == "") | F.coalesce(number <= 65535, F.lit(False))
    tail = T.let(
        F.concat(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), p["query"]),
        lambda t: F.when(_plain(t), t).otherwise(_percent_encode(t)),
    )
    url = F.concat(
        scheme,
        F.lit("://"),
        F.when(p["user"] == "", F.lit("")).otherwise(F.concat(p["user"], F.lit("@"))),
        F.lower(p["host"]),
        F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string"))),
        tail,
    )
    return F.when(p.isNotNull() & valid, url)


def _canonical(c: Column, limit: int, keep_fragment: bool = False) -> Column:
    def build(p: Column) -> Column:
        url = T.let(_joined(p), lambda u: F.when(F.char_length(u) <= limit, u))
        return F.concat(url, p["fragment"]) if keep_fragment else url

    return T.let(trim_ws(c), lambda t: T.let(_split(t), build))


def canonical_url(c: Column) -> Column:
    """Canonical absolute http(s) link; null when it is none or too long."""
    return _canonical(c, K.URL_MAX)


def canonical_feed_url(c: Column) -> Column:
    """As ``canonical_url`` with the rules of a registered feed: short, no credentials, public host."""
    url = _canonical(c, K.FEED_URL_MAX)
    host = url_host(c)
    v6 = _ipv6_kind(F.when(host.contains(":"), host))
    parts = F.struct(trim_ws(c).alias("text"), url.alias("url"), host.alias("host"), v6.alias("v6"))

    def checked(x: Column) -> Column:
        fits = F.char_length(x["text"]) <= K.FEED_URL_MAX
        # The text has to be well formed before any repair: no spaces, no loose backslashes.
        formed = ~x["text"].rlike(r"[\s\\^`{|}<>\"]")
        free = _part(x["text"], 2) == ""
        return F.when(fits & formed & free & _public(x["host"], x["v6"], K.REFUSED_FEED_IPV4), x["url"])

    return T.let(parts, checked)


def url_hash(normalized: Column) -> Column:
    return sha256_upper(normalized)


@F.pandas_udf(StringType())
def _join(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or b is None else urljoin(b, r) for b, r in zip(base, ref)])


def resolve_url(base: Column, ref: Column) -> Column:
    """Link against its feed's address; null unless the result is http(s)."""
    r = trim_ws(ref)
    absolute = r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    joined = F.coalesce(F.when(absolute, r), _join(base, F.when(~absolute & (r != ""), r)))
    return _canonical(joined, K.URL_MAX, keep_fragment=True)


def url_host(c: Column) -> Column:
    host = F.lower(_part(trim_ws(c), 3))
    return F.when(host != "", host)


def ipv4_number(host: Column) -> Column:
    """A dotted IPv4 literal as a number, else null."""
    octets = F.split(F.rtrim(host), r"\.")
    value = sum(
        (F.get(octets, F.lit(i)).cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4)),
        start=F.lit(0).cast("bigint"),
    )
    octet = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.when(host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), value)


def _inside(number: Column, blocks: list[str]) -> Column:
    hit = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


@F.pandas_udf(StringType())
def _ipv6_kind(values: pd.Series) -> pd.Series:
    """``public``, ``closed``, or the embedded IPv4 literal."""

    def kind(v: str) -> str:
        try:
            address = ipaddress.IPv6Address(v.strip("[]"))
        except ValueError:
            return "closed"
        if address.ipv4_mapped is not None:
            return str(address.ipv4_mapped)
        unicast = address in ipaddress.ip_network("2000::/3")
        documentation = address in ipaddress.ip_network("2001:db8::/32")
        return "public" if unicast and not documentation else "closed"

    return values.map(kind, na_action="ignore")


def _public(host: Column, v6: Column, blocks: list[str]) -> Column:
    def decide(x: Column) -> Column:
        local = (x["name"] == "localhost") | x["name"].endswith(".localhost")
        return (
            F.when(local, F.lit(False))
            .when(x["number"].isNotNull(), ~_inside(x["number"], blocks))
            .when(x["v6"].isNotNull(), x["v6"] == "public")
            .otherwise(x["name"].isNotNull())
        )

    return T.let(
        F.struct(
            F.lower(F.regexp_replace(host, r"\.+$", "")).alias("name"),
            F.coalesce(ipv4_number(host), ipv4_number(v6)).alias("number"),
            v6.alias("v6"),
        ),
        decide,
    )


def is_public_host(host: Column, blocks: list[str] | None = None) -> Column:
    """False for local names and for address literals outside the public ranges."""
    v6 = _ipv6_kind(F.when(host.contains(":"), host))
    return _public(host, v6, K.NON_PUBLIC_IPV4 if blocks is None else blocks)
