"""Text scalars as Column expressions."""
import html.entities
import json
import re
from functools import cache

from pyspark.sql import functions as F

from ledgerlens import policies as P


def collapse(x):
    """Any Unicode whitespace run to one space, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def blank_to_null(x):
    return F.nullif(x, F.lit(""))


def clean_text(x):
    return blank_to_null(collapse(x))


def pad10(x):
    """Zero-pad to ten characters; longer input is kept whole."""
    return F.when(F.length(x) >= 10, x).otherwise(F.lpad(x, 10, "0"))


def normalise_ticker(x):
    return F.upper(collapse(x))


def printable(x, keep_breaks=False):
    """Non-printable characters (control, format, unassigned, odd separators) to spaces;
    optionally keep CR, LF and TAB."""
    cls = r"[\p{C}\p{Z}&&[^\r\n\t ]]" if keep_breaks else r"[\p{C}\p{Z}&&[^ ]]"
    return F.regexp_replace(x, cls, " ")


def fold_quotes(x):
    return F.translate(x, "’‘“”", "''\"\"")


# a run of blanks (all that `printable` or `collapse` take for one) that is not already a single space: most blanks
# are, and a test of the ASCII range in front of the categories settles nearly every other character
_BLANKS = r"[[^!-~]&&[\p{C}\p{Z}]](?:[[^!-~]&&[\p{C}\p{Z}]]++|(?<! ))"
_BLANKS_IN_LINE = r"[[^!-~\n]&&[\p{C}\p{Z}]](?:[[^!-~\n]&&[\p{C}\p{Z}]]++|(?<! ))"


def normalise_block(x):
    """collapse(printable(x)) in one pass."""
    return F.trim(F.regexp_replace(x, _BLANKS, " "))


def normalise_lines(x):
    """The lines of a text, each as `normalise_block` gives it, in one pass over the whole text; empty ones stay."""
    whole = F.regexp_replace(F.replace(x, F.lit("\r"), F.lit("\n")), _BLANKS_IN_LINE, " ")
    return F.transform(F.split(whole, "\n"), lambda line: F.trim(line))


def heading_text(x):
    return fold_quotes(normalise_block(x))


# longest codes first so that "item 1a" is not read as "item 1"
_ITEM_PATTERN = r"(?i)^\s*item\s*(" + "|".join(sorted(P.ITEM_CODES, key=len, reverse=True)) + r")\b"


def raw_item_code(x):
    return F.regexp_extract(x, _ITEM_PATTERN, 1)


def item_code(x):
    """Item code of a heading line in upper case, NULL when the line is no heading."""
    return blank_to_null(F.upper(raw_item_code(x)))


def is_stop_phrase(x):
    return x.rlike("(?i)" + "|".join(P.STOP_PHRASES))


def is_forward_section(x):
    return x.rlike("(?i)" + "|".join(P.FORWARD_SECTION_PHRASES))


def may_mark_section(x):
    """Whether any of the three patterns above is in the text: one search, as most lines hold none."""
    return x.rlike("|".join((_ITEM_PATTERN, *P.STOP_PHRASES, *P.FORWARD_SECTION_PHRASES)))


def is_forward_looking(x, keywords=P.FORWARD_LOOKING_KEYWORDS):
    return F.lower(x).rlike("|".join(re.escape(k) for k in keywords))


def looks_like_html(x):
    """One of the tags html, body, div or table, wherever it stands."""
    return x.contains("<") & x.rlike(r"(?i)<(?:html|body|div|table)\b")


def looks_like_ownership_xml(x):
    return x.rlike(r"(?i)^\s*<\?xml|<ownershipdocument\b")


TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9']+"


def tokens(x):
    return F.transform(F.regexp_extract_all(x, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def preview(x, n=140):
    cut = F.replace(F.substring(x, 1, n), F.lit("\n"), F.lit(" "))
    return F.when(F.length(x) > n, F.concat(cut, F.lit("..."))).otherwise(cut)


def split_sentences(x):
    """Sentence boundary before a capital, digit or opening quote; else '; '."""
    parts = F.split(x, r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")
    return F.when(F.size(parts) > 1, parts).otherwise(F.split(x, r";\s+"))


def headline_and_publisher(title, source):
    """The last ' - ' separates the publisher unless the source names one."""
    t, s = blank_to_null(F.trim(title)), blank_to_null(F.trim(source))
    has = s.isNull() & t.contains(" - ")
    head = F.when(has, F.trim(F.regexp_extract(t, r"(?s)^(.*) - (.*)$", 1))).otherwise(t)
    pub = F.when(s.isNotNull(), s).when(
        has, blank_to_null(F.trim(F.regexp_extract(t, r"(?s)^(.*) - (.*)$", 2))))
    return head, pub


def canonical_url(x):
    """Lower scheme and host, no fragment, no tracking keys, sorted query."""
    u = clean_text(x)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    keep = F.filter(F.split(query, "&"), lambda p: (
        p.rlike("^[^=]+=.+") & ~F.lower(p).startswith("utm_")
        & ~F.lower(F.substring_index(p, "=", 1)).isin(*P.TRACKING_KEYS)))
    q = F.array_join(F.array_sort(keep), "&")
    url = F.concat(scheme, F.lit("://"), host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when((scheme != "") & (host != ""), url)


def url_host(x):
    return F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def article_hash(url, publisher, headline, published_at):
    stamp = F.date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(published_at, "SSSSSS")
    iso = F.concat(stamp, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
                   F.lit("+00:00"))
    loose = F.concat_ws("|", F.lower(F.trim(F.coalesce(publisher, F.lit("")))),
                        F.lower(F.trim(headline)), iso)
    host = url_host(url)
    strict = (host != "") & ~host.isin(*P.AGGREGATOR_HOSTS)
    return F.sha2(F.when(strict, F.concat(F.lit("url:"), F.lower(url))).otherwise(loose), 256)


def is_garbage(headline, summary):
    h = F.trim(headline)
    return ((F.length(h) < 8) | F.lower(h).isin(*P.GARBAGE_HEADLINES)
            | F.coalesce((F.lower(h) == F.lower(F.trim(summary))) & (F.length(h) < 20), F.lit(False)))


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@cache
def _names(semicolon: bool):
    """Named references with their semicolon, or those that need none, as one JSON map; the most frequent come first,
    as a map is searched from its start."""
    usual = ("amp", "nbsp", "lt", "gt", "quot", "rsquo", "lsquo", "rdquo", "ldquo", "mdash", "ndash", "bull")
    names = {k: v for k, v in html.entities.html5.items() if k.endswith(";") == semicolon}
    first = [k + ";" * semicolon for k in usual if k + ";" * semicolon in names]
    return json.dumps({k: names[k] for k in dict.fromkeys([*first, *names])})


@cache
def _page():
    """What the numbers 128 to 159 stand for: the Windows code page, or the control character itself."""
    return "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160))


def unescape_entities(x):
    """Named and numeric character references decoded in the JVM, from left to right, each once: the text is split at
    its references, and the decoded ones are put between the parts. What is no reference stays."""
    full, short = (F.from_json(F.lit(_names(k)), "map<string,string>") for k in (True, False))

    def let(value, then):  # named once, so that the plan holds its expression once
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def char(n):
        by_page = F.substring(F.lit(_page()), n - 127, F.lit(1))
        nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(n.between(128, 159), by_page).when(nothing, "")
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")))

    def by_number(r):
        hexed = F.lower(F.substring(r, 1, 3)) == "&#x"
        body = F.ltrim(F.rtrim(F.substring(r, F.when(hexed, 4).otherwise(3), F.length(r)), F.lit(";")), F.lit("0"))
        return let(body, lambda d: let(F.when(F.length(d) > 7, 0x110000).when(d == "", 0).when(hexed, F.conv(d, 16, 10).cast("int")).otherwise(d.try_cast("int")), char))

    def by_name(name):
        # a name that needs no semicolon may be followed by anything: the longest one counts
        parts = F.transform(F.sequence(F.lit(6), F.lit(2)), lambda k: F.concat(F.try_element_at(short, F.substring(name, F.lit(1), k)), F.substring(name, k + 1, F.length(name))))
        return F.coalesce(F.when(F.endswith(name, F.lit(";")), F.try_element_at(full, name)), F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0)), F.concat(F.lit("&"), name))

    found = F.transform(F.regexp_extract_all(x, F.lit(_REFERENCE), F.lit(0)), lambda r: F.when(F.startswith(r, F.lit("&#")), by_number(r)).otherwise(let(F.substring(r, F.lit(2), F.length(r)), by_name)))
    pieces = F.zip_with(F.split(x, _REFERENCE, -1), found, lambda gap, char: F.concat(gap, F.coalesce(char, F.lit(""))))
    return F.when(F.contains(x, F.lit("&")), F.array_join(pieces, "")).otherwise(x)


def strip_tags(x):
    return F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]+>", " ")


def html_text(x):
    return clean_text(strip_tags(unescape_entities(x)))


def tagged_number(text, sign, scale):
    """Reported figure: separators dropped, parentheses and sign negate, scaled by 10^scale."""
    raw = F.regexp_replace(text, r"[,$% \s]", "")
    neg = raw.rlike(r"^\(.*\)$")
    body = F.when(neg, F.regexp_replace(raw, r"^\((.*)\)$", "$1")).otherwise(raw)
    v = body.try_cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    factor = F.when(neg, F.lit(-1.0)).otherwise(F.lit(1.0)) * \
        F.when(F.trim(sign) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
    return v * factor * F.pow(F.lit(10.0), F.coalesce(scale.try_cast("int"), F.lit(0)))


def unit_token(x):
    """Part after the last brace or colon."""
    return F.regexp_extract(F.trim(x), r"([^}:]*)$", 1)


def storage_key(cik, form, accession):
    return F.concat_ws("/", cik, F.translate(form, "/ ", "__"), F.concat(accession, F.lit(".txt")))


ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data/"


def document_url(cik, accession, document):
    flat = F.replace(accession, F.lit("-"), F.lit(""))
    name = F.coalesce(blank_to_null(document), F.concat(flat, F.lit(".txt")))
    return F.when(accession != "", F.concat(
        F.lit(ARCHIVE_ROOT), cik.cast("bigint").cast("string"), F.lit("/"), flat, F.lit("/"), name))


def index_url(cik, accession):
    return F.concat(F.lit(ARCHIVE_ROOT), cik.cast("bigint").cast("string"), F.lit("/"),
                    F.replace(accession, F.lit("-"), F.lit("")), F.lit("/index.json"))


def role_name(officer_title, is_director):
    t = F.lower(collapse(F.coalesce(officer_title, F.lit(""))))
    return (F.when(t.contains("chief executive officer") | t.rlike(r"\bceo\b"), "CEO")
            .when(t.contains("chief financial officer") | t.rlike(r"\bcfo\b"), "CFO")
            .when(t.contains("chief technology officer") | t.rlike(r"\bcto\b"), "CTO")
            .when(t.contains("chief operating officer") | t.rlike(r"\bcoo\b"), "COO")
            .when(t.rlike(r"\bpresident\b") & ~t.rlike(r"\bvice president\b"), "President")
            .when(is_director, "Director").otherwise("Other Officer"))


def role_weight(role):
    out = F.lit(P.ROLE_WEIGHTS["Other Officer"])
    for name, w in P.ROLE_WEIGHTS.items():
        out = F.when(role == name, F.lit(w)).otherwise(out)
    return out


def transaction_type(code, acquired_disposed, is_derivative):
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    out = F.lit(None).cast("string")
    for k, v in P.TRANSACTION_TYPES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.when(is_derivative & (c != ""), "derivative_other")
                      .when(acquired_disposed == "A", "other_acquisition")
                      .when(acquired_disposed == "D", "other_disposition").otherwise("other"))


def ownership_nature(code):
    c = F.upper(F.trim(code))
    return F.when(c == "D", "direct").when(c == "I", "indirect").otherwise(blank_to_null(F.lower(c)))


def flag(x):
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "y", "yes"), F.lit(False))


def plain_number(x):
    t = F.trim(F.replace(x, F.lit(","), F.lit("")))
    v = F.when(~t.isin("", "N/A"), t).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def number_text(x):
    """Decimal text without trailing zeros."""
    t = x.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def insider_key(cik, name):
    return F.concat_ws("|", F.coalesce(cik, F.lit("")), F.lower(F.trim(name)))


UID_PARTS = ("accession_number", "insider_name", "insider_cik", "transaction_date",
             "transaction_code", "shares", "price_per_share", "security_title",
             "shares_owned_after", "is_derivative", "ownership_nature", "acquired_disposed_code")
_UID_NUMBERS = ("shares", "price_per_share", "shares_owned_after")


def transaction_uid(parts=UID_PARTS):
    """SHA-1 over the parts in a fixed order; numbers in canonical text form."""
    cols = [F.coalesce(number_text(F.col(p)) if p in _UID_NUMBERS else F.col(p).cast("string"), F.lit(""))
            for p in parts]
    return F.sha1(F.concat_ws("|", *cols))


def legacy_uid(*cols):
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def article_text(headline, summary):
    h, s = clean_text(headline), clean_text(summary)
    return (F.when(h.isNotNull() & s.isNotNull() & (s != h), F.concat(h, F.lit(". "), s))
            .otherwise(F.coalesce(h, s)))
