"""URLs as Column expressions over their parts.

Escapes and dots in paths are left as they are written; a browser's URL parser would rewrite some of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Parameters that only track clicks, and the beginnings of others; the longest URL; second labels that a country sells under.
TRACKING = ["fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "igshid", "yclid", "_hsenc", "_hsmi", "_ga", "_gl", "mkt_tok"]
TRACKING_PREFIXES = ["utm_", "mc_"]
LONGEST = 2048
#: Suffixes of several labels under which names are registered, of countries and of hosting platforms; states, and labels below them, of US localities.
SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "org.nz", "net.nz",
    "co.jp", "ne.jp", "or.jp",
    "com.br", "com.mx", "org.mx", "co.za", "com.cn", "com.tw", "com.sg", "com.hk",
    "co.in", "co.kr", "com.ar", "com.co", "co.il",
    "gc.ca", "qc.ca", "on.ca", "bc.ca", "ab.ca",
    "fed.us", "dni.us", "nsn.us", "isa.us",
    "github.io", "gitlab.io", "netlify.app", "vercel.app", "pages.dev", "workers.dev",
    "herokuapp.com", "web.app", "firebaseapp.com", "azurewebsites.net", "cloudfront.net",
    "blogspot.com", "wordpress.com", "wixsite.com", "weebly.com", "square.site",
    "godaddysites.com", "myshopify.com", "webflow.io", "carrd.co", "squarespace.com",
    "sites.google.com",
]
US_STATES = "al ak az ar ca co ct de dc fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy pr vi gu as mp".split()
US_LOCALITIES = ["k12", "cc", "lib", "pvt", "tec", "gen", "mus"]
_PARTS = r"(?i)^(https?)://([^/?#@\s]+?)(?::(\d+))?(/[^?#\s]*)?(?:\?([^#\s]*))?(?:#\S*)?$"


def host(url: Column) -> Column:
    """The lower-case host of an http(s) URL; null for other texts."""
    h = F.rtrim(F.lower(F.regexp_extract(F.trim(url), _PARTS, 2)), F.lit("."))
    return F.when(h != "", h)


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment and tracking parameters; null for what cannot be fetched."""
    raw = F.trim(url)
    part = lambda i: F.regexp_extract(raw, _PARTS, i)
    scheme, name, port, path, query = F.lower(part(1)), host(raw), part(3), part(4), part(5)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(pairs, lambda p: ~(key(p).isin(*TRACKING) | key(p).startswith(TRACKING_PREFIXES[0]) | key(p).startswith(TRACKING_PREFIXES[1])))
    rest = F.when(F.size(kept) == F.size(pairs), query).otherwise(F.array_join(kept, "&"))
    out = F.concat(scheme, F.lit("://"), name, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))
    usable = raw.rlike(_PARTS) & (F.length(raw) <= LONGEST) & (F.length(out) <= LONGEST) & name.contains(".")
    return F.when(usable, out)


def _registrable(h: Column, labels: Column) -> Column:
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    last, second, third = (F.coalesce(F.get(labels, n - i), F.lit("")) for i in (1, 2, 3))
    in_state = (last == "us") & second.isin(*US_STATES)
    suffix = F.when(in_state & third.isin(*US_LOCALITIES), 3).when(in_state, 2).when((n > 3) & tail(3).isin(*SUFFIXES), 3).when((n > 2) & tail(2).isin(*SUFFIXES), 2).otherwise(1)
    address = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.contains(":")
    return let(suffix, lambda k: F.when(address | (n <= k), h).otherwise(F.array_join(F.slice(labels, n - k, k + 1), ".")))


def domain(name: Column) -> Column:
    """The registrable domain of a host: one label more than its public suffix. Addresses, single labels and bare suffixes stay as they are."""
    return let(F.regexp_replace(F.lower(name), r"\.+$", ""), lambda h: let(F.split(h, r"\."), lambda labels: _registrable(h, labels)))


def source_domain(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(host(url), F.lit("")), r"^www\.", "")


def suffixes(name: Column) -> Column:
    """A host and every domain above it, so that a list of domains is an equi-join."""
    return let(F.split(name, r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def registration_url(url: Column, page: Column, allowed: list[str]) -> Column:
    """The link if it stays on the page's domain or goes to an allowed host."""
    same = domain(host(url)) == domain(host(page))
    listed = F.exists(suffixes(host(url)), lambda s: s.isin(*allowed))
    return F.when(F.coalesce(same | listed, F.lit(False)), url)


def glob(pattern: str) -> str:
    """A regular expression for a pattern in which only * is special."""
    return "(?i)^" + ".*".join("\\Q" + part + "\\E" if part else "" for part in pattern.split("*")) + "$"


def outcome(status: Column) -> Column:
    """What a fetch with this HTTP status came to."""
    return F.when(status == 304, "not_modified").when(status == 404, "not_found").when(status == 410, "gone").when(status >= 500, "server_error").when(status >= 400, "client_error").when((status >= 200) & (status < 300), "ok").otherwise("other")
