"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The parts of a URL, whatever characters it holds: scheme, authority, path, query.
_SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(u: Column, n: int) -> Column:
    """The n-th part; "" where there is none. White space inside tags and before the URL does not count, nothing is refused."""
    plain = F.regexp_replace(F.regexp_replace(u, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    return F.regexp_extract(plain, _SPLIT, n)


def scheme(u: Column) -> Column:
    return F.lower(part(u, 1))


def authority(u: Column) -> Column:
    """Host with port and user."""
    return part(u, 2)


def path(u: Column) -> Column:
    """The path, without the parameters of its last segment."""
    return F.regexp_replace(part(u, 3), r"(?s);[^/]*$", "")


def decoded(x: Column) -> Column:
    """Escapes decoded, + as a blank; a % that begins no escape stays."""
    return F.url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))


def clean(u: Column) -> Column:
    return F.rtrim(u, F.lit("/"))


def base(u: Column) -> Column:
    """Authority, port and user included, and path."""
    return F.concat(authority(u), path(u))


def query_pairs(u: Column) -> Column:
    """array<struct(key, value)> of the query; blank values are dropped, both sides are decoded."""
    pairs = F.transform(F.split(part(u, 4), "&"), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), F.when(F.instr(p, "=") > 0, decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))


def query_values(urls: Column) -> Column:
    """map<key, sorted distinct values> over the queries of many URLs."""
    pairs = F.flatten(F.transform(urls, query_pairs))
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["key"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"])))))


def alternatives(c: Column) -> Column:
    return F.split(c, r" \|OR\| ")


def start_urls(c: Column) -> Column:
    return F.split(c, r" \|AND\| ")


def gold_in_pred(reference: Column, predicted: Column) -> Column:
    """Any reference base is part of the base predicted, and every reference key has one of its values in it."""
    references = F.transform(alternatives(reference), clean)
    pred = clean(predicted)
    bases = F.exists(references, lambda r: F.contains(base(pred), base(r)))
    pairs, had = F.flatten(F.transform(references, query_pairs)), query_pairs(pred)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    values = F.forall(keys, lambda k: F.exists(pairs, lambda p: (p["key"] == k) & F.exists(had, lambda h: (h["key"] == k) & (h["value"] == p["value"]))))
    return F.when(bases & values, 1.0).otherwise(0.0)


def prefix_match(reference: Column, predicted: Column) -> Column:
    """The base predicted starts with a reference base; queries do not count."""
    return F.when(F.exists(alternatives(reference), lambda r: F.startswith(base(clean(predicted)), base(clean(r)))), 1.0).otherwise(0.0)


def post_url(u: Column) -> Column:
    """scheme://host/f/<forum>/<id>/ of a forum post's URL; other URLs as they are."""
    steps = F.split(path(u), "/")
    post = F.concat(scheme(u), F.lit("://"), authority(u), F.lit("/f/"), F.get(steps, F.lit(2)), F.lit("/"), F.get(steps, F.lit(3)), F.lit("/"))
    return F.when((F.size(steps) >= 4) & (F.get(steps, F.lit(1)) == "f"), post).otherwise(u)


def without_all_forums(u: Column) -> Column:
    """The path without its /forums/all prefix."""
    return F.regexp_replace(F.regexp_replace(u, r"^([^/]*//[^/?#]*)/forums/all(?=$|[?#])", "$1/"), r"^([^/]*//[^/?#]*)/forums/all/", "$1/")


def authorized(urls: Column, hosts: Column) -> Column:
    """Every open tab is on an allowed host; a tab without a host, or a new tab, is allowed."""
    return F.forall(urls, lambda u: F.array_contains(F.concat(hosts, F.array(F.lit("newtab"), F.lit(""))), authority(u)))


def fill_sites(text: Column, sites: dict[str, str]) -> Column:
    """__SITE__ placeholders replaced by the sites' URLs."""
    for name, url in sites.items():
        text = F.replace(text, F.lit(f"__{name.upper()}__"), F.lit(url))
    return text


def site_url(host: Column, port: Column) -> Column:
    """A site's URL on its port."""
    return F.format_string("http://%s:%d", host, port)


def site_urls(host: Column, ports: dict[str, int]) -> Column:
    """map<site, URL> of a host's sites."""
    return F.create_map(*(x for name, port in ports.items() for x in (F.lit(name), site_url(host, F.lit(port)))))
