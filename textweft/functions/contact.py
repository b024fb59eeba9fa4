"""Small expressions over names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def initials(first: Column, last: Column, email: Column) -> Column:
    """Capital first letters of both names; of the first alone; of the address; else a question mark."""
    head = lambda c: F.upper(F.substring(F.trim(c), 1, 1))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(has(first) & has(last), F.concat(head(first), head(last))).when(has(first), head(first)).when(has(email), head(email)).otherwise("?")


def normal_email(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.trim(c))


def valid_email(c: Column) -> Column:
    """Something, an at sign, something with a dot inside, no blanks; tested untrimmed."""
    return F.coalesce(c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def long_enough(c: Column, least: int = 8) -> Column:
    """At least that many characters."""
    return F.coalesce(F.length(c) >= least, F.lit(False))


def expiry(at: Column, minutes: int) -> Column:
    """So many minutes after ``at``."""
    return at + F.make_interval(mins=F.lit(minutes))


def first_given(*choices: Column) -> Column:
    """The first that is not null; empty if all are."""
    return F.coalesce(*choices, F.lit(""))


def link(template: str, ident: Column) -> Column:
    """``template`` with its %s replaced by the id as it is."""
    return F.format_string(template, ident)


def quoted(c: Column) -> Column:
    """Safe inside an address: blanks as plus signs, all but letters, digits and ``_.-~`` by their codes."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
