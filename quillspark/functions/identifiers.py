"""DOIs, file names, titles and hosts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import stripped

# A DOI in running text, what a slug may hold, and what a safe id is.
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
NOT_IN_SLUG = r"[^a-z0-9._-]+"
SAFE_ID = r"^[A-Za-z0-9._-]+$"
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")


def norm_doi(doi: Column) -> Column:
    out = F.rtrim(F.lower(stripped(doi)), F.lit("."))
    for prefix in DOI_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return stripped(out)


def slug(x: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(x), NOT_IN_SLUG, "_"), "^_+|_+$", "")
    return F.when(out == "", "ref").otherwise(out)


def pdf_name(doi: Column, key: Column) -> Column:
    """A file name per reference that a DOI finds again; the hash keeps keys with one slug apart."""
    tail = F.concat(slug(key), F.lit("-"), F.left(F.sha1(key), F.lit(8)), F.lit(".pdf"))
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(slug(norm_doi(doi)), F.lit("__"), tail)).otherwise(tail)


def is_safe_id(x: Column) -> Column:
    return x.rlike(SAFE_ID) & ~x.isin(".", "..")


def norm_title(t: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9 ]", " "), r"\s+", " "))


def document_title(metadata_title: Column, text: Column) -> Column:
    """The metadata's title if it tells something, else the first line of 20 characters or more."""
    named = stripped(F.coalesce(metadata_title, F.lit("")))
    line = F.get(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), stripped), lambda x: F.length(x) >= 20), F.lit(0))
    return F.when((F.length(named) > 10) & ~F.contains(F.lower(named), F.lit("microsoft word")), named).otherwise(line)


def first_doi(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DOI, 0), F.lit(""))


def stems(name: Column) -> Column:
    """A file name's stem and each prefix of it that ends before a double underscore; one of them equals the slug that the name starts with."""
    stem = F.regexp_replace(F.lower(name), r"\.pdf$", "")
    cuts = F.filter(F.sequence(F.lit(1), F.length(stem)), lambda i: F.substring(stem, i, F.lit(2)) == "__")
    return F.array_distinct(F.concat(F.array(stem), F.transform(cuts, lambda i: F.left(stem, i - 1))))


def url_host(base: Column) -> Column:
    """The host that a request to the address would reach: user info and port don't count, brackets around IPv6 go."""
    full = F.when(F.contains(base, F.lit("://")), base).otherwise(F.concat(F.lit("http://"), base))
    found = F.regexp_extract(full, r"^[^:/?#]+://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]@]+)(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.lower(F.regexp_replace(found, r"^\[|\]$", ""))


def is_local_host(base: Column) -> Column:
    """Loopback, private or link-local address, .local or a single label. Whatever can't be read as one of these isn't local."""
    host = url_host(F.coalesce(base, F.lit("")))
    v4 = host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    octet = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", g).try_cast("int") for g in (1, 2, 3, 4)]
    valid = (octet[0] <= 255) & (octet[1] <= 255) & (octet[2] <= 255) & (octet[3] <= 255)
    private = octet[0].isin(127, 10) | (host == "0.0.0.0") | ((octet[0] == 192) & (octet[1] == 168)) | ((octet[0] == 172) & octet[1].between(16, 31)) | ((octet[0] == 100) & octet[1].between(64, 127))
    v6 = F.contains(host, F.lit(":"))
    local6 = (host == "::1") | host.rlike(r"^(?:fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}):")
    named = (host == "localhost") | host.endswith(".local") | host.rlike(r"^[a-z0-9_-]*[a-z_-][a-z0-9_-]*$")
    return F.coalesce(F.when(host == "", False).when(v6, local6).when(v4, valid & private).otherwise(named), F.lit(False))


def is_local_model(model: Column) -> Column:
    return F.coalesce(F.lower(model).startswith("ollama/") | F.lower(model).startswith("st-"), F.lit(False))
