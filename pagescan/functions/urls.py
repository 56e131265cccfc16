"""URL expressions: parts, external and CDN tests, risk scores (Spark SQL text)."""

from pagescan.functions.text import contains_any, first_word, has_match, lit, lits, only, struct
from pagescan.rules import values as V

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_PORT = r"^(?:[^@]*@)*(?:\[[^\]]*\][^:]*|[^:@]*):([^@]*)$"
_NO_TEXTS = "CAST(array() AS ARRAY<STRING>)"


def _bare(url: str) -> str:
    """Tabs and line ends inside an address do not count."""
    return f"translate({url}, '\\t\\r\\n', '')"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({_bare(url)}, {lit(_SCHEME)}, 1))"


def netloc(url: str) -> str:
    """Lower-cased host with port and user info, '' where there is none."""
    return f"lower(regexp_extract({_bare(url)}, {lit(_NETLOC)}, 1))"


def query(url: str) -> str:
    return f"regexp_extract({_bare(url)}, {lit(_QUERY)}, 1)"


def port_text(url: str) -> str:
    return f"regexp_extract({netloc(url)}, {lit(_PORT)}, 1)"


def port(url: str) -> str:
    """The port; NULL where there is none or it is not one."""
    number = f"try_cast(regexp_extract({port_text(url)}, '^[0-9]+$', 0) AS INT)"
    return f"nullif(least({number}, 65536), 65536)"


def has_bad_port(url: str) -> str:
    return f"({port_text(url)} != '' AND {port(url)} IS NULL)"


def odd_port(url: str) -> str:
    return f"coalesce({port(url)} NOT IN (0, {lits(V.STANDARD_PORTS)}), false)"


def is_web(url: str) -> str:
    return f"(startswith({url}, 'http://') OR startswith({url}, 'https://'))"


def within(domain: str, other: str) -> str:
    """Is ``domain`` the other domain or one below it?"""
    return f"({domain} = {other} OR endswith({domain}, concat('.', {other})))"


def page_domain(location: str) -> str:
    """The domain links are compared with; NULL for pages that are not web pages."""
    return f"CASE WHEN {is_web(location)} THEN {netloc(location)} END"


def is_external_link(url: str, base: str = "NULL", domain: str | None = None) -> str:
    domain = domain or netloc(url)
    if base == "NULL":
        return f"({domain} != '' AND {is_web(url)})"
    return (f"({domain} != '' AND CASE WHEN coalesce({base}, '') = '' THEN {is_web(url)} "
            f"ELSE NOT {within(domain, base)} END)")


def is_trusted_cdn(url: str, domain: str | None = None) -> str:
    domain = domain or netloc(url)
    return "(" + " OR ".join(within(domain, lit(host)) for host in V.TRUSTED_CDN) + ")"


def suspicious_tld(domain: str) -> str:
    """The listed top-level domain the name ends with, NULL if none."""
    tld = f"substring_index({domain}, '.', -1)"
    return f"CASE WHEN contains({domain}, '.') AND {tld} IN ({lits(V.SUSPICIOUS_TLDS)}) THEN {tld} END"


def tld_weight(tld: str) -> str:
    heavy = [t for t, weight in V.SUSPICIOUS_TLDS.items() if weight == 3]
    return f"CASE WHEN {tld} IS NULL THEN 0 WHEN {tld} IN ({lits(heavy)}) THEN 3 ELSE 2 END"


def short_link(domain: str) -> str:
    return f"({domain} IN ({lits(V.SHORT_LINK_DOMAINS)}))"


def random_domain(domain: str) -> str:
    r"""A second-last label of eight or more characters without a digit."""
    label = rf"try_element_at(split({domain}, '\\.'), -2)"
    return f"coalesce(length({label}) >= 8 AND NOT rlike({label}, {lit(r'[\p{Nd}\p{No}]')}), false)"


def query_word(url: str) -> str:
    return first_word(f"lower({query(url)})", V.QUERY_WORDS)


def starts(url: str, prefix: str) -> str:
    return f"startswith(lower({url}), {lit(prefix)})"


def points(*scores) -> str:
    """Sum of (condition, points) pairs."""
    return "(" + " + ".join(f"IF({condition}, {score}, 0)" for condition, score in scores) + ")"


def reasons(*pairs) -> str:
    """The texts (SQL) whose condition holds, in order."""
    return only(*[f"CASE WHEN {condition} THEN {text} END" for condition, text in pairs])


def url_facts(url: str, location: str) -> str:
    """What the rules ask about one URL on one page, computed once."""
    domain = netloc(url)
    return struct(domain=domain, base=page_domain(location), tld=suspicious_tld(domain), word=query_word(url),
                  odd_port=odd_port(url), cdn=is_trusted_cdn(url))


def url_risk(url: str) -> str:
    """``struct<risk_level, reasons>`` of one URL, seen without its page."""
    kind, domain = scheme(url), netloc(url)
    short = "(" + " OR ".join(within(domain, lit(host)) for host in V.SHORT_LINK_DOMAINS) + ")"
    tld = suspicious_tld(domain)
    # The path ends before any ";parameters" of its last segment.
    path = f"regexp_replace(regexp_extract({_bare(url)}, {lit(_PATH)}, 1), ';[^/]*$', '')"
    random_name = has_match(path, V.RANDOM_SCRIPT_NAME)
    level = points((f"{kind} = 'javascript'", 5), (f"{kind} = 'data'", 4), (f"{kind} IN ('http', 'https')", 1),
                   (odd_port(url), 2), (f"({tld}) IS NOT NULL", 2), (short, 3), (random_name, 1))
    why = reasons((f"{kind} = 'javascript'", lit(V.REASON_JS_PSEUDO)), (f"{kind} = 'data'", lit(V.REASON_DATA)),
                  (odd_port(url), lit(V.REASON_PORT)),
                  (f"({tld}) IS NOT NULL", f"concat({lit(V.REASON_TLD)}, {tld})"),
                  (short, lit(V.REASON_SHORT)), (random_name, lit(V.REASON_RANDOM_PATH)))
    return struct(risk_level=f"least({level}, 10)", reasons=why)


def link_risk(url: str, u: str) -> str:
    """``struct<risk, reasons>`` of a URL found in page text; ``u`` holds its ``url_facts``."""
    domain = f"{u}.domain"
    external = f"(coalesce({u}.base, '') != '' AND {is_external_link(url, f'{u}.base', domain)})"
    tld, word = f"{u}.tld IS NOT NULL", f"{u}.word IS NOT NULL"
    score = points((external, 2), (tld, tld_weight(f"{u}.tld")), (random_domain(domain), 2),
                   (short_link(domain), 3), (f"{u}.odd_port", 2), (word, 1))
    why = reasons((external, lit(V.REASON_EXTERNAL_LINK)), (tld, f"concat({lit(V.REASON_TLD)}, {u}.tld)"),
                  (random_domain(domain), lit(V.REASON_RANDOM_DOMAIN)),
                  (short_link(domain), lit(V.REASON_SHORT)), (f"{u}.odd_port", lit(V.REASON_PORT)),
                  (word, f"concat({lit(V.REASON_QUERY)}, {u}.word)"))
    web = f"({starts(url, 'http://')} OR {starts(url, 'https://')})"
    return f"""CASE
        WHEN {starts(url, 'javascript:')} THEN {struct(risk='8', reasons=f'array({lit(V.REASON_JS_PSEUDO)})')}
        WHEN {starts(url, 'data:')} THEN {struct(risk=f'IF(length({url}) > 500, 5, 4)',
                                                 reasons=f'array({lit(V.REASON_DATA)})')}
        WHEN NOT {web} OR {u}.cdn THEN {struct(risk='0', reasons=_NO_TEXTS)}
        ELSE {struct(risk=score, reasons=why)} END"""


def is_bait_domain(domain: str) -> str:
    """A domain that is there and not meant as an example."""
    return f"({domain} != '' AND NOT {contains_any(domain, V.NEUTRAL_DOMAIN_WORDS)})"
