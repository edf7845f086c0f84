"""Parts of a url and of its host, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Public suffixes of two labels that the jobs know; any other suffix is a host's last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.tr", "co.in", "co.kr", "co.za", "com.mx", "com.ar")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.locate("://", F.coalesce(F.col(url), F.lit("")))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    """From ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """From the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def name_of(host: str) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.col(host), r"^[^@]*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(host: str) -> Column:
    """The public suffix: a known one of two labels, else the last label. Empty for an address of digits."""
    name = name_of(host)
    two = F.regexp_extract(name, r"[^.]+\.[^.]+$", 0)
    last = F.regexp_extract(name, r"[^.]*$", 0)
    return F.when(name.rlike(r"^[0-9.]*$"), F.lit("")).otherwise(F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(last))


def domain_of(host: str) -> Column:
    """The registered domain: the suffix and the label before it, or the whole name where there is none."""
    name = name_of(host)
    two, three = F.regexp_extract(name, r"[^.]+\.[^.]+$", 0), F.regexp_extract(name, r"[^.]+\.[^.]+\.[^.]+$", 0)
    found = F.when(name.rlike(r"^[0-9.]*$"), name).otherwise(F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two))
    return F.when(found == "", name).otherwise(found)
