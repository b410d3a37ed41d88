"""URL expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithic.settings import DEFAULTS

ONION = r"[a-z2-7]{56}\.onion"


def _encoded(value: Column) -> Column:
    """Percent-encoded but for letters, digits and -_.~; a blank is a plus."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize(url: Column) -> Column:
    """The dedup key of a URL: lower case, no fragment, parameters by name and encoded anew (those that cannot be
    decoded go), no default port, no slash at the end but for the root. What does not look like a URL stays as it is."""
    low = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://([^/?]*)", 1)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(low, r"^[^?]*\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.try_url_decode(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")))
    sound = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    ordered = F.array_join(F.transform(F.array_sort(sound), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    rebuilt = F.concat(scheme, F.lit("://"), host, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(F.lit("")))
    return F.when(scheme != "", rebuilt).otherwise(url)


def host(url: Column) -> Column:
    """Host without port and user, case kept; null for garbage."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def domain(url: Column) -> Column:
    """What a banned-domain hash is taken of: the last two labels of the host, lower case, no dot at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", ""), r"[/:?#].*$", "")
    labels = F.split(F.regexp_replace(bare, r"\.+$", ""), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def is_onion(url: Column) -> Column:
    return F.coalesce(F.lower(host(url)).endswith(".onion"), F.lit(False))


def fold_dots(path: Column) -> Column:
    """A path, which starts with a slash, without . and .. segments; .. above the root is dropped."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def resolve(href: Column, base: Column) -> Column:
    """href as an absolute URL, for absolute, scheme-relative, root-relative, query, fragment and
    sibling references; the dot segments of a relative one are folded."""
    tail = F.regexp_extract(href, r"[?#].*$", 0)
    bare = F.regexp_replace(href, r"[?#].*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(plain) > F.length(root), F.regexp_replace(plain, "[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, fold_dots(bare), tail))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(plain, href))
        .when(F.coalesce(href, F.lit("")) == "", base)
        .otherwise(F.concat(root, fold_dots(F.concat(F.substr(folder, F.length(root) + 1), bare)), tail))
    )


def links(html: Column, base: Column, most: int = DEFAULTS.max_links_per_page) -> Column:
    """The first ``most`` distinct links of a page in document order: anchors' targets resolved against
    the page, and onion addresses in its text. Scripts, styles and comments hold no links."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    marks = F.regexp_extract_all(bare, F.lit(rf"(?is)<a\b[^>]*?href\s*=\s*[\"'][^\"'>]*[\"'][^>]*>|<[^>]*>|(?:https?://)?\b{ONION}\b(?:/[^\s<\"']*)?"), F.lit(0))
    targets = F.transform(
        marks,
        lambda m: F.when(m.rlike(r"(?is)^<a\b[^>]*?href\s*="), resolve(F.regexp_extract(m, r"(?is)href\s*=\s*[\"']([^\"'>]*)[\"']", 1), base))
        .when(m.startswith("<"), F.lit(None).cast("string"))
        .when(m.rlike("(?i)^https?://"), m)
        .otherwise(F.concat(F.lit("http://"), m)),
    )
    return F.slice(F.array_distinct(F.filter(targets, lambda t: t.isNotNull())), 1, most)


def looks_like_trap(url: Column) -> Column:
    """Session parameters, or a path segment that occurs more than twice."""
    session = url.rlike(r"(?i)[?&;](?:phpsessid|jsessionid|sid|sessionid|session_id)=")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return host(url).isNull() | session | F.exists(parts, lambda p: F.size(F.filter(parts, lambda q: q == p)) > 2)
