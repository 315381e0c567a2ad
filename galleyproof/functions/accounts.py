"""Rules for addresses, names and passwords of accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Passwords that everyone tries first, and lengths.
COMMON = ("password", "password123", "admin123", "qwerty123", "letmein", "welcome123", "12345678")
SHORTEST, LONGEST = 10, 128


def valid_email(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def valid_username(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(r"^[a-zA-Z0-9_.-]{3,40}$")


def password_fault(password: Column, username: Column) -> Column:
    """The first rule that a password breaks; null if it is good."""
    p, name = F.coalesce(password, F.lit("")), F.lower(F.trim(F.coalesce(username, F.lit(""))))
    rules = (
        (F.length(p) < SHORTEST, f"Password must be at least {SHORTEST} characters."),
        (F.length(p) > LONGEST, f"Password is too long. Use {LONGEST} characters or fewer."),
        (p.rlike(r"(?U)\s"), "Password must not contain spaces."),
        (~p.rlike("[a-z]"), "Password must include at least one lowercase letter."),
        (~p.rlike("[A-Z]"), "Password must include at least one uppercase letter."),
        (~p.rlike(r"\p{Nd}"), "Password must include at least one number."),
        (~p.rlike("[^A-Za-z0-9]"), "Password must include at least one symbol, such as !, @, #, or %."),
        ((name != "") & F.contains(F.lower(p), name), "Password must not contain your username."),
        (F.lower(p).isin(*COMMON), "Password is too common. Choose a stronger password."),
    )
    out = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        out = F.when(broken, message).otherwise(out)
    return out


def token_hash(c: Column) -> Column:
    return F.sha2(c, 256)
