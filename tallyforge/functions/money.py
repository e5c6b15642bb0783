"""Amounts, days and provider fields as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stored money and quantities.
MONEY = "decimal(28,10)"
HALF_CENT = "0.005"

# The ledger's activity kinds and the wording of its cash descriptions.
INFLOWS = ("DEPOSIT", "CREDIT", "INTEREST", "DIVIDEND", "TRANSFER_IN")
OUTFLOWS = ("WITHDRAWAL", "EXPENSE", "FEE", "TAX", "TRANSFER_OUT")
TRANSFERS = ("TRANSFER_IN", "TRANSFER_OUT")
CARD_PAYMENT = r"\b(autopay|automatic payment|payment\W+(?:received|thank))"
INTEREST = r"^(interest (paid|payment|earned)|interest)$"
CASHOUT = r"\bvenmo\s+cashout\b"
INTERNAL = (
    r"\btransfer (?:to|from|.* (?:to|from)) .*(?:account|savings|checking|spending)"
    r"|\b(?:citi|chase|amex|credit card|credit crd) .*?(?:autopay|payment)"
    r"|\bbank p2p\b"
)
# End of the fixed values.


def lenient(value: Column) -> Column:
    """A decimal; anything that is not one is 0."""
    return F.coalesce(value.cast("string").try_cast(MONEY), F.lit(0).cast(MONEY))


def strict(value: Column, what: str = "a financial amount must be finite") -> Column:
    """A decimal; the query fails on anything else, null too."""
    parsed = value.cast("string").try_cast(MONEY)
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit(what)).cast(MONEY))


def is_money(value: Column) -> Column:
    return value.cast("string").try_cast(MONEY).isNotNull()


def epoch_day(epoch: Column) -> Column:
    """UTC day of epoch seconds; null where they are missing, zero or no number."""
    seconds = epoch.cast("string").try_cast("bigint")
    return F.to_date(F.timestamp_seconds(F.when(seconds > 0, seconds)))


def day_in(instant: Column, zone: Column | str, otherwise: Column) -> Column:
    """The calendar day of an instant in a named zone, or ``otherwise`` where there is no instant."""
    return F.coalesce(F.to_date(F.from_utc_timestamp(instant, zone)), otherwise)


def day_anchor(day: Column, zone: Column | str) -> Column:
    """An instant that is on ``day`` in UTC and in the zone: noon there, or the middle of the common part.

    Null where the two days have no common part.
    """
    utc = F.to_timestamp(day)
    begin, end = F.to_utc_timestamp(utc, zone), F.to_utc_timestamp(F.to_timestamp(F.date_add(day, 1)), zone)
    noon = F.to_utc_timestamp(utc + F.expr("INTERVAL 12 HOURS"), zone)
    low, high = F.greatest(begin, utc), F.least(end, F.to_timestamp(F.date_add(day, 1)))
    middle = F.timestamp_micros(F.floor((F.unix_micros(low) + F.unix_micros(high)) / 2).cast("bigint"))
    return F.when((noon >= low) & (noon < high), noon).when(low < high, middle)


def is_currency(unit: Column) -> Column:
    """A currency code, not the address of some other unit."""
    return F.coalesce((F.trim(unit) != "") & ~F.contains(unit, F.lit("://")), F.lit(False))


def account_currency(unit: Column, balance: Column, holdings: Column) -> Column:
    """The stated unit, else the one unit of holdings whose values add up to the balance exactly, else ''."""
    units = F.array_distinct(F.transform(holdings, lambda h: h["currency"]))
    total = F.aggregate(holdings, F.lit(0).cast("decimal(38,10)"), lambda a, h: (a + lenient(h["market_value"])).cast("decimal(38,10)"))
    single = (F.size(units) == 1) & (total == lenient(balance))
    return F.when(F.trim(unit) != "", unit).when(F.coalesce(single, F.lit(False)), F.get(units, F.lit(0))).otherwise("")


def activity_amount(kind: Column, amount: Column, account_kind: Column) -> Column:
    """Signed effect on cash; null for a kind that is no cash activity."""
    value = F.coalesce(amount, F.lit(0).cast(MONEY))
    return (
        F.when((kind == "INTEREST") & (account_kind == "CREDIT_CARD"), -F.abs(value))
        .when(kind.isin(*INFLOWS), value)
        .when(kind.isin(*OUTFLOWS), -F.abs(value))
    )


def cash_kind(description: Column, amount: Column, account_kind: Column) -> Column:
    """Activity kind of a provider transaction, from its sign and wording; the first rule that applies."""
    text = F.lower(F.coalesce(description, F.lit("")))
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    signed = lambda up, down: F.when(amount >= 0, up).otherwise(down)
    card = F.when(amount < 0, "WITHDRAWAL").when(text.rlike(CARD_PAYMENT), "TRANSFER_IN").otherwise("CREDIT")
    return (
        F.when(account_kind == "CREDIT_CARD", card)
        .when(stripped.rlike(INTEREST), signed("INTEREST", "WITHDRAWAL"))
        .when((amount > 0) & text.rlike(CASHOUT), "TRANSFER_IN")
        .when(text.rlike(INTERNAL), signed("TRANSFER_IN", "TRANSFER_OUT"))
        .otherwise(signed("DEPOSIT", "WITHDRAWAL"))
    )


def is_cash_position(symbol: Column, description: Column) -> Column:
    clean = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    return (clean(symbol) == "") & (F.upper(clean(description)) == "CASH")


def source_fields(amount: Column, day: Column, description: Column, utc_day: Column) -> Column:
    """What the provider said, kept in an activity's metadata; nulls are left out."""
    return F.to_json(F.struct(amount.cast("string").alias("amount"), day.cast("string").alias("date"), description.alias("description"), utc_day.cast("string").alias("utcDate")))


def metadata(raw: Column) -> Column:
    """A metadata string as a variant; null, blank and unreadable text is an empty object."""
    return F.coalesce(F.try_parse_json(raw), F.parse_json(F.lit("{}")))


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


#: The public namespace of URLs (RFC 4122).
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
