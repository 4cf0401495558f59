"""Client attributes of an event: agent families, addresses, keyed hashes."""

from __future__ import annotations

import hashlib
import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import const_array, const_rows, contains_any, first_match, let, strip

# Needles tested in this order.
TABLET_MARKS = ("ipad", "tablet")
MOBILE_MARKS = ("mobile", "android", "iphone", "ipod", "windows phone")
BROWSERS = (
    ("edg/", "Edge"),
    ("opr/", "Opera"),
    ("opera", "Opera"),
    ("samsungbrowser", "Samsung"),
    ("firefox", "Firefox"),
    ("chrome", "Chrome"),
    ("safari", "Safari"),
    ("curl", "curl"),
    ("python-requests", "python-requests"),
    ("wget", "Wget"),
)
SYSTEMS = (
    ("windows nt 10", "Windows 10/11"),
    ("windows nt", "Windows"),
    ("android", "Android"),
    ("iphone", "iOS"),
    ("ipad", "iPadOS"),
    ("mac os x", "macOS"),
    ("cros", "ChromeOS"),
    ("linux", "Linux"),
)
# Address blocks that are not globally reachable, with their exceptions.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "3fff::/20", "fc00::/7", "fe80::/10",
)
PUBLIC_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)


def device_of(agent: Column) -> Column:
    ua = F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when(contains_any(ua, TABLET_MARKS), "tablet")
        .when(contains_any(ua, MOBILE_MARKS), "mobile")
        .otherwise("desktop")
    )


def browser_of(agent: Column) -> Column:
    ua = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(ua == "", "unknown").otherwise(first_match(ua, BROWSERS, "other"))


def system_of(agent: Column) -> Column:
    ua = F.lower(F.coalesce(agent, F.lit("")))
    return first_match(ua, SYSTEMS, "unknown")


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _is_v4(text: Column) -> Column:
    return F.regexp_like(text, F.lit(_V4))


def _v4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.try_cast("bigint"))


def _groups(text: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 text, or null when it is none."""
    dotted = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    quad = F.when(_is_v4(dotted), _v4_number(dotted))
    hexed = F.concat_ws(
        ":", F.lower(F.hex(F.shiftright(quad, 16))), F.lower(F.hex(quad.bitwiseAND(F.lit(65535))))
    )
    flat = F.when(dotted == "", text).when(
        quad.isNotNull(), F.concat(F.regexp_replace(text, r"[0-9]+(\.[0-9]+){3}$", ""), hexed)
    )

    def expand(t):
        gap = F.contains(t, F.lit("::"))
        filled = F.size(F.filter(F.split(t, ":"), lambda g: g != ""))
        zeros = F.array_join(F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - filled, F.lit(0))), ":")
        joined = F.when(
            gap, F.regexp_replace(F.regexp_replace(t, "::", F.concat(F.lit(":"), zeros, F.lit(":"))), "^:|:$", "")
        ).otherwise(t)
        valid = F.when(gap, filled <= 7).otherwise(filled == 8) & F.regexp_like(
            t, F.lit(r"(?i)^(?!.*::.*::)(?!.*:::)([0-9a-f]{1,4}|::?)*$")
        ) & ~F.regexp_like(t, F.lit("^:[^:]|[^:]:$"))
        numbers = F.transform(F.split(joined, ":"), lambda g: F.conv(g, 16, 10).try_cast("int"))
        return F.when(valid, numbers)

    return let(F.lower(flat), expand)


def _v6_text(groups: Column) -> Column:
    """Compressed text form: the first longest run of two or more zero groups becomes '::'."""
    full = F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":")
    runs = const_array([":" + "0:" * n for n in range(8, 1, -1)])

    def shorten(padded):
        def cut(run):
            at = F.position(run, padded)
            head = F.substring(padded, F.lit(1), at - 1)
            tail = F.substring(padded, at + F.length(run), F.length(padded))
            return F.coalesce(F.concat(head, F.lit("::"), tail), padded)

        text = let(F.get(F.filter(runs, lambda r: F.contains(padded, r)), F.lit(0)), cut)
        # The outer padding colons go, the two of the compressed run stay.
        return F.regexp_replace(F.regexp_replace(text, "^:(?!:)", ""), "(?<!:):$", "")

    return let(F.concat(F.lit(":"), full, F.lit(":")), shorten)


def normalise_ip(ip: Column) -> Column:
    """Mapped IPv4 to IPv4, other IPv6 to its compressed form, anything else trimmed."""
    text = strip(F.coalesce(ip, F.lit("")))

    def pick(raw):
        def from_groups(g):
            mapped = (F.array_max(F.slice(g, 1, 5)) == 0) & (g[5] == 65535)
            quad = lambda x: F.concat_ws(".", F.shiftright(x, 8), x.bitwiseAND(F.lit(255)))
            return F.when(mapped, F.concat_ws(".", quad(g[6]), quad(g[7]))).otherwise(_v6_text(g))

        v6 = F.contains(raw, F.lit(":")) & ~F.contains(raw, F.lit("%"))
        return F.when(v6, F.coalesce(let(_groups(raw), from_groups), raw)).otherwise(raw)

    return let(text, pick)


def _block_rows(blocks) -> Column:
    """Blocks as (lowest, highest) address in hex: 8 digits for IPv4, 32 for IPv6."""
    rows = []
    for block in blocks:
        net = ipaddress.ip_network(block)
        width = net.max_prefixlen // 4
        rows.append((f"{int(net[0]):0{width}x}", f"{int(net[-1]):0{width}x}"))
    return const_rows(("lo", "hi"), rows)


def is_private(address: Column) -> Column:
    """Of a normalised address: not globally reachable. False when it is no address."""

    def key(t):
        v4 = F.lower(F.lpad(F.hex(_v4_number(t)), 8, "0"))
        v6 = F.array_join(F.transform(_groups(t), lambda g: F.lower(F.lpad(F.hex(g), 4, "0"))), "")
        return F.when(_is_v4(t), v4).when(F.contains(t, F.lit(":")), v6)

    def inside(k, blocks):
        return F.exists(
            _block_rows(blocks), lambda b: (F.length(k) == F.length(b["lo"])) & k.between(b["lo"], b["hi"])
        )

    found = let(
        let(address, key),
        lambda k: inside(k, (*PRIVATE_V4, *PRIVATE_V6)) & ~inside(k, (*PUBLIC_V4, *PUBLIC_V6)),
    )
    return F.coalesce(found, F.lit(False))


def is_private_ip(ip: Column) -> Column:
    return is_private(normalise_ip(ip))


def keyed_hash(value: Column, key: str, length: int = 12) -> Column:
    """First hex digits of HMAC-SHA256, from two SHA-256 calls."""
    secret = key.encode()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in secret))
    outer = F.lit(bytes(b ^ 0x5C for b in secret))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, length)


def client_ip(trusted: list[Column], forwarded: Column, peer: Column) -> Column:
    """First non-blank trusted header, else the first public hop, else the first hop, else the peer."""
    hops = F.filter(
        F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), strip), lambda h: h != ""
    )
    public = F.filter(hops, lambda h: ~is_private_ip(h))
    some = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(
        *[some(h) for h in trusted],
        F.get(public, F.lit(0)),
        F.get(hops, F.lit(0)),
        F.coalesce(peer, F.lit("")),
    )
