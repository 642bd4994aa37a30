"""URLs: hosts, domains, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let

# Second levels under country domains, click-tracking parameters, advert links, listing hints.
SECOND_LEVELS = "ac co com edu gov net or org".split()
TRACKING = "fbclid gclid mc_cid mc_eid msclkid yclid".split()
AD_LINKS = (
    ("bing.com", "/aclick"), ("bing.com", "/ck/a"), ("duckduckgo.com", "/y.js"), ("duckduckgo.com", "/l/"), ("google.com", "/aclk"),
    ("google.com", "/url"), ("r.search.yahoo.com", "/"), ("yandex.ru", "/clck"), ("yandex.com", "/clck"),
)
LISTING = ("/s?", "/search", "/sch/", "?q=", "&q=", "/pl?", "/category/", "/tag/")
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, n)


def hostname(url: Column) -> Column:
    """Lower-case host without user, port, trailing dots and one leading www."""
    tail = r"\.*(?::\d*)?$"
    return F.lower(F.regexp_replace(part(url, 2), rf"(?i){tail}|^(?:.*@)?(?:www\.(?!{tail}))?", ""))


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, three under a country's common second level; addresses stay."""
    return let(F.struct(host.alias("host"), F.split(host, r"\.").alias("labels")), lambda x: domain_of(x["host"], x["labels"]))


def domain_of(host: Column, labels: Column) -> Column:
    n = F.size(labels)
    country = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(SECOND_LEVELS)
    keep = F.least(n, F.when(country, 3).otherwise(2))
    address = host.rlike(r"^\d+(\.\d+){3}$") | host.contains(":")
    return F.when(address, host).otherwise(F.array_join(F.slice(labels, n - keep + 1, keep), "."))


def encoded(text: Column) -> Column:
    """A part of a query, written anew: what is encoded and what need not be come out alike. What cannot be decoded is taken as it stands."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes; scheme and host in lower case, the query encoded anew."""
    url = F.trim(url)
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.split_part(p, F.lit("="), F.lit(1))))
    pairs = F.filter(pairs, lambda p: ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(TRACKING))
    value = lambda p: F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
    pairs = F.transform(pairs, lambda p: F.concat(encoded(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="), encoded(value(p))))
    path = F.regexp_replace(part(url, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.array_join(pairs, "&")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def host_in(url: Column, domains: list[str]) -> Column:
    host = hostname(url)
    return F.coalesce(F.greatest(F.lit(False), *[(host == d) | F.endswith(host, F.lit("." + d)) for d in domains], F.lit(False)), F.lit(False))


def is_ad_link(url: Column) -> Column:
    path = part(url, 3)
    return F.greatest(*[host_in(url, [d]) & F.startswith(path, F.lit(p)) for d, p in AD_LINKS])


def is_listing(url: Column) -> Column:
    return F.greatest(*[url.contains(hint) for hint in LISTING])


def url_date(url: Column) -> Column:
    """The date that a path holds as /YYYY/MM/DD/ or /YYYY/MM/ (its first day), or null."""
    full = F.regexp_extract(part(url, 3), r"/((?:19|20)\d\d)/(\d\d)(?:/(\d\d))?(?:/|$)", 0)
    bits = F.filter(F.split(full, "/"), lambda x: x != "")
    text = F.concat_ws("-", F.get(bits, F.lit(0)), F.get(bits, F.lit(1)), F.coalesce(F.get(bits, F.lit(2)), F.lit("01")))
    return F.when(full != "", F.try_to_date(text))


# Ranges of IPv4 addresses that are not on the public internet, as first and last, and prefixes of IPv6 ones.
PRIVATE = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)
PRIVATE_V6 = r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:db8:.*|100::.*)$"


def address_number(address: Column) -> Column:
    """An IPv4 address as a number; null for what is none."""
    parts = F.transform(F.split(address, r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), p).cast("long"))
    fits = lambda p: (F.size(p) == 4) & F.forall(p, lambda x: F.coalesce(x <= 255, F.lit(False)))
    return let(parts, lambda p: F.when(fits(p), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + x)))


def private_address(url: Column) -> Column:
    """The address that is a URL's host, where it is not on the public internet; null for names and public addresses."""
    numeric = lambda a: sum(int(x) << 8 * (3 - i) for i, x in enumerate(a.split(".")))

    def judged(v4: Column, v6: Column, n: Column) -> Column:
        inside = F.greatest(F.lit(False), *[n.between(numeric(a), numeric(b)) for a, b in PRIVATE])
        return F.when(n.isNotNull() & inside, v4).when((v6 != "") & v6.rlike(PRIVATE_V6), v6)

    def both(host: Column, v6: Column) -> Column:
        mapped = F.nullif(F.regexp_extract(v6, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1), F.lit(""))
        return let(F.coalesce(mapped, F.regexp_replace(host, r":\d*$", "")), lambda v4: let(address_number(v4), lambda n: judged(v4, v6, n)))

    host = F.lower(F.regexp_replace(part(url, 2), "^.*@", ""))
    return let(host, lambda h: let(F.regexp_extract(h, r"^\[([0-9a-f:.]+)\]", 1), lambda v6: both(h, v6)))
