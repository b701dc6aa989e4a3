"""Column expressions over URLs: hosts, policies, landing pages."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import contracts as k


def authority_of(url: Column) -> Column:
    """The network location, port and user included."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(authority_of(url), r"^.*@", ""), r":\d*$", "")
    return F.rtrim(F.trim(host), F.lit("."))


# What may be taken from a site, with and without its full texts.
DIRECTIVE_FULL, DIRECTIVE_ABSTRACT = " —— 可取全文/下载PDF；", " —— 仅取题录/摘要与文档编号，禁止虚构全文；"


def directive(url: Column, full_text: Column, hint: Column) -> Column:
    """A search restricted to the source's site, and what may be taken from it."""
    return F.concat(F.lit("site:"), authority_of(url), F.when(F.coalesce(full_text, F.lit(False)), DIRECTIVE_FULL).otherwise(DIRECTIVE_ABSTRACT), F.coalesce(hint, F.lit("")))


def suspect_domain(url: Column, domains: tuple[str, ...] = k.SUSPECT_DOMAINS) -> Column:
    """The first of the domains that the URL holds, else null: a CASE, no join."""
    out = F.lit(None).cast("string")
    for d in reversed(domains):
        out = F.when(url.contains(d), d).otherwise(out)
    return out


def suspect_suffix(host: Column, suffixes: tuple[str, ...] = k.SUSPECT_SUFFIXES) -> Column:
    """The first suffix that the host is or ends with, else null."""
    out = F.lit(None).cast("string")
    for s in reversed([s.strip().lower().lstrip(".") for s in suffixes]):
        if s:
            out = F.when((host == s) | host.endswith("." + s), "." + s).otherwise(out)
    return out


def blocked_host(host: Column) -> Column:
    """Names of the own machine and network."""
    return (host == "") | host.isin("localhost", "localhost.localdomain", "local", "intranet", "internal") | host.rlike(r"\.(local|intranet|internal)$")


# Networks that are not public, and addresses within them that are.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = ("::/3", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/2", "8000::/1")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` the value, which is computed once, however often `of` reads it."""
    return F.transform(F.array(value), of)[0]


def _any(nets: tuple[str, ...], holds: Callable[[ipaddress.IPv4Network | ipaddress.IPv6Network], Column]) -> Column:
    out = F.lit(False)
    for net in nets:
        out = out | holds(ipaddress.ip_network(net))
    return out


def _private_number(number: Column) -> Column:
    """Whether an IPv4 address, as a number, isn't public."""
    return _bound(number, lambda n: (lambda within: _any(PRIVATE_V4, within) & ~_any(PUBLIC_V4, within))(lambda net: n.between(int(net.network_address), int(net.broadcast_address))))


def private_v4(host: Column) -> Column:
    """Whether a host that is an IPv4 address isn't public; null for other hosts."""
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    return F.when(host.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), _private_number(number))


def numeric_host(host: Column) -> Column:
    """Whether a host that a resolver takes as an IPv4 number isn't public: up to four parts, decimal, octal or hexadecimal, of which the last fills what is left.

    Null for names. What looks like a number but is none can't be resolved, and isn't public either.
    """
    parts = F.split(host, r"\.")
    hexadecimal = lambda x: F.conv(F.nullif(F.substring(x, 3, 99), F.lit("")), 16, 10)
    octal = lambda x: F.when(x.rlike("[89]"), F.lit(None).cast("string")).otherwise(F.conv(x, 8, 10))
    value = lambda x: F.when(F.length(x) > 20, F.lit(None).cast("long")).otherwise(F.when(x.startswith("0x"), F.coalesce(hexadecimal(x), F.lit("0"))).when(x.startswith("0"), octal(x)).otherwise(x).try_cast("long"))
    values = F.transform(parts, value)
    n = F.size(parts)
    head, last = F.slice(values, F.lit(1), n - 1), F.element_at(values, -1)
    most = F.when(n == 1, (1 << 32) - 1).when(n == 2, (1 << 24) - 1).when(n == 3, (1 << 16) - 1).otherwise(255)
    fits = F.forall(head, lambda x: F.coalesce(x <= 255, F.lit(False))) & F.coalesce(last <= most, F.lit(False))
    number = F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * (most + 1) + last
    return F.when(host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+)){0,3}$"), F.when(fits, _private_number(number)).otherwise(True))


def private_ip(host: Column) -> Column:
    """whether an address, IPv4 or IPv6 (in brackets or not), isn't public; null for names.

    Of IPv6 only 2000::/3 is public, but for its networks of special use, 6to4 among them. An IPv4 address within an IPv6 one is never public. What has colons but is no
    address can't be reached, and isn't public.
    """
    return _bound(F.lower(F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), "%.*$", "")), _private_ip)


def _private_ip(bare: Column) -> Column:
    # An IPv4 tail stands for two groups, whatever they are.
    plain = F.regexp_replace(bare, r":\d+(\.\d+){3}$", ":0:0")
    sides = F.split(plain, "::", -1)
    groups = lambda x: F.filter(F.split(x, ":", -1), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    missing = F.when(F.size(sides) == 2, 8 - F.size(left) - F.size(right)).otherwise(0)
    eight = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)

    def judged(g: Column) -> Column:
        def within(net: ipaddress.IPv6Network) -> Column:
            hit, bits, first = F.lit(True), net.prefixlen, int(net.network_address)
            for i in range(-(-bits // 16)):
                kept = min(16, bits - 16 * i)
                mask = 0xFFFF ^ (0xFFFF >> kept)
                hit = hit & (F.get(g, F.lit(i)).bitwiseAND(mask) == (first >> (112 - 16 * i) & mask))
            return hit

        return _any(PRIVATE_V6, within) & ~_any(PUBLIC_V6, within)

    form = bare.rlike(r"^[0-9a-f:]*(:\d+(\.\d+){3})?$") & ~bare.rlike(":::|^:[^:]|[^:]:$") & (F.size(sides) <= 2) & (F.size(eight) == 8) & F.forall(eight, lambda x: F.length(x) <= 4)
    v6 = F.when(form, _bound(F.transform(eight, lambda x: F.conv(x, 16, 10).cast("int")), judged)).otherwise(True)
    return F.when(F.contains(bare, F.lit(":")), v6).otherwise(private_v4(bare))


def policy(url: Column, suffixes: tuple[str, ...] = k.SUSPECT_SUFFIXES, answers: Column | None = None) -> Column:
    """Why a URL must not be fetched, else null. Cheap reasons come first. Names are not resolved here: `answers` may have the addresses that a name was resolved to, of which any that isn't public counts."""
    resolved = F.lit(False) if answers is None else F.coalesce(F.exists(answers, lambda x: F.coalesce(private_ip(x), F.lit(False))), F.lit(False))
    return _bound(host_of(url), lambda host: (
        F.when(suspect_suffix(host, suffixes).isNotNull(), "suspect_suffix")
        .when(~F.lower(url).rlike("^https?://"), "scheme")
        .when(blocked_host(host), "blocked_host")
        .when(F.coalesce(private_ip(host), numeric_host(host), F.lit(False)) | resolved, "private_ip")
    ))


def hops_policy(hops: Column, suffixes: tuple[str, ...] = k.SUSPECT_SUFFIXES) -> Column:
    """F8: the first reason against any of the URLs that a fetch was redirected through, itself first; null if there is none."""
    return F.get(F.filter(F.transform(hops, lambda u: policy(u, suffixes)), lambda r: r.isNotNull()), F.lit(0))


# Landing pages and their documents: (pattern, replacement), the first that matches counts.
PDF_RULES = (
    (r"^https://www\.osti\.gov/biblio/(\d+).*$", "https://www.osti.gov/servlets/purl/$1"),
    (r"^(.*osti\.gov/servlets/purl/.*)$", "$1"),
    (r"^(https://www\.mdpi\.com/[\d\-]+/\d+/\d+/\d+)/?$", "$1/pdf"),
    (r"^((?!.*/document).*hal\.science/.*?)/*$", "$1/document"),
    (r"^(https://www\.nature\.com/articles/[^/]+)/?$", "$1.pdf"),
    (r"^(https://iopscience\.iop\.org/article/10\.1088/[^/]+)/?$", "$1/pdf"),
    (r"^https://(\w+)\.biomedcentral\.com/articles/(10\.\d+/[\w-]+).*$", "https://$1.biomedcentral.com/counter/pdf/$2.pdf"),
    (r"^(https://www\.frontiersin\.org/articles/10\.\d+/[\w.-]+).*$", "$1/pdf"),
    (r"^https://pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC\d+).*$", "https://www.ncbi.nlm.nih.gov/pmc/articles/$1/pdf/main.pdf"),
)


def pdf_url(url: Column) -> Column:
    """The document behind a landing page, else null."""
    out = F.lit(None).cast("string")
    for pattern, to in reversed(PDF_RULES):
        out = F.when(url.rlike(pattern), F.regexp_replace(url, pattern, to)).otherwise(out)
    return out
