"""One plan from a provider's payload to everything that is written, and its publication by one commit.

Sources are judged account by account: one with an error writes nothing and stops no other. The plan is a set of tables,
derived from the same inputs; ``rows`` shows them as one. ``publish`` stages them in a ``Store`` and commits ledger,
snapshots, quotes, account modes and liabilities together, or none of them.

Inputs (``World``): sources: source_id, currency, balance, balance_day, balance_utc_day, as_of; mapping: source_id, action, local_sync,
account_id, liability_id, source_scope, history_through, zone, purchase_account, per_unit; accounts: account_id,
account_kind, account_currency, is_active, mode; transactions: source_id, txn_id, pos, pending, posted_day, posted_at,
amount, description; activities as in ``merge_plan``; positions as in ``holdings.planned``; snapshots: account_id, day,
kind, cash; liabilities: id, value, day, currency. Optional: held (asset_id, held_quantity, held_basis), verified, rolled, aliases.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..operators import balances, holdings, merge_plan, validation
from ..sources import scratch, sinks
from ..sources.store import Store

CASH, CARD, SECURITIES = "CASH", "CREDIT_CARD", "SECURITIES"
BY_TRANSACTIONS, BY_HOLDINGS = "TRANSACTIONS", "HOLDINGS"
OBSERVED = "MANUAL_ENTRY"


@dataclass
class World:
    sources: DataFrame
    mapping: DataFrame
    accounts: DataFrame
    transactions: DataFrame
    activities: DataFrame
    positions: DataFrame
    snapshots: DataFrame
    liabilities: DataFrame
    held: DataFrame | None = None
    verified: DataFrame | None = None
    rolled: DataFrame | None = None
    aliases: DataFrame | None = None


@dataclass
class Plan:
    """Tables to write and what to tell: ``errors`` and ``warnings`` have source_id, key, detail."""

    activities: DataFrame
    snapshots: DataFrame
    positions: DataFrame
    quotes: DataFrame
    modes: DataFrame
    valuations: DataFrame
    expected: DataFrame
    errors: DataFrame
    warnings: DataFrame

    def rows(self, asset: str = "asset_id") -> DataFrame:
        """Everything as (step, owner, key, day, amount, detail); owner: the account, or the source of errors and warnings.

        asset: what positions and quotes have as key, ``position_id`` for the provider's number.
        """

        def some(table: DataFrame, step: str | Column, owner: str, key: str | None, day: str | None, amount: str | None, detail: str | None) -> DataFrame:
            of = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
            return table.select((F.lit(step) if isinstance(step, str) else step).alias("step"), of(owner, "string").alias("owner"), of(key, "string").alias("key"), of(day, "date").alias("day"), of(amount, money.MONEY).alias("amount"), of(detail, "string").alias("detail"))

        return reduce(
            DataFrame.unionByName,
            [
                some(self.activities, F.col("op"), "account_id", "key", "day", "amount", "kind"),
                some(self.snapshots, "snapshot", "account_id", None, "day", "cash", "kind"),
                some(self.positions, "position", "account_id", asset, "day", "quantity", "cost_from"),
                some(self.quotes, "quote", "account_id", asset, "day", "price", "currency"),
                some(self.modes, "mode", "account_id", None, None, None, "mode"),
                some(self.valuations, "valuation", "id", None, "day", "value", None),
                some(self.expected, "expected", "account_id", None, None, "total", "mode"),
                some(self.errors, "error", "source_id", "key", None, None, "detail"),
                some(self.warnings, "warning", "source_id", "key", None, None, "detail"),
            ],
        )


def _told(rows: DataFrame, detail: str | Column, key: str | Column | None = None) -> DataFrame:
    column = lambda x: F.lit(None).cast("string") if x is None else x if isinstance(x, Column) else F.lit(x)
    return rows.select("source_id", column(key).cast("string").alias("key"), column(detail).alias("detail"))


def _without(rows: DataFrame, errors: DataFrame) -> DataFrame:
    return rows.join(errors.select("source_id").distinct(), "source_id", "left_anti")


def newest_observed(snapshots: DataFrame) -> DataFrame:
    """(account_id, observed_day): the newest day that a source, not a calculation, has written."""
    return snapshots.where("kind <> 'CALCULATED'").groupBy("account_id").agg(F.max("day").alias("observed_day"))


def plan(world: World, keep: Callable[[DataFrame], DataFrame] = scratch.written) -> Plan:
    """What to write and what to tell.

    keep: is given the tables that several parts of the plan read; the default writes them to the shared folder.
    """
    states = keep(validation.account_states(world.sources, world.mapping, world.accounts.withColumnRenamed("mode", "mode_now")))
    quiet = F.col("code").isin("skipped", "inactive", "liability")
    errors = [_told(states.where(F.col("code").isNotNull() & ~quiet), F.col("code"))]
    warnings = [_told(states.where(F.coalesce(F.col("code"), F.lit("")) != "skipped").where("warning is not null"), F.col("warning"))]
    ready = states.where("code is null")
    errors.append(_told(ready.where(~F.col("account_kind").isin(CASH, CARD, SECURITIES)), "account kind is not supported"))

    valuations, liability_errors = _liabilities(states.where("code = 'liability'"), world)
    errors.append(liability_errors)
    cash = ready.where(F.col("account_kind").isin(CASH, CARD))
    activities, projected, cash_errors = _cash_activities(cash, world, keep)
    good = _without(cash, cash_errors)
    tracked = (F.col("account_kind") == CARD) | (F.col("mode_now") == BY_TRANSACTIONS)
    observed = ready.join(newest_observed(world.snapshots), "account_id", "left")
    newer = F.coalesce(F.col("observed_day") > F.col("balance_day"), F.lit(False))

    # cash that is observed, not added up
    cash_seen = observed.join(good.where(~tracked).select("source_id"), "source_id", "left_semi")
    zeros = balances.unexplained_zeros(cash_seen.select("source_id", "account_id", "purchase_account", "balance", "balance_day"), world.snapshots, world.transactions.select("source_id", "posted_day", "amount"))
    fresh = cash_seen.where(~newer)
    warnings.append(_told(cash_seen.where(newer), "kept a newer balance", F.col("observed_day")))
    kept_zero = fresh.join(zeros, "source_id")
    warnings.append(_told(kept_zero, "an empty balance without a purchase: kept the last one", F.col("kept_day")))
    cash_shown = fresh.join(zeros.select("source_id"), "source_id", "left_anti")

    # securities
    securities = observed.where(F.col("account_kind") == SECURITIES)
    warnings.append(_told(securities.where(newer), "kept newer holdings", F.col("observed_day")))
    shown, positions, security_errors = _securities(securities.where(~newer), world, keep)
    errors.append(security_errors)
    without = positions.where("average_cost is null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    warnings.append(_told(without, "positions without an acquisition cost", F.col("n")))

    day = F.col("balance_day").alias("day")
    snapshots = cash_shown.select("account_id", day, F.lit(OBSERVED).alias("kind"), F.col("balance").cast(money.MONEY).alias("cash"), "currency")
    snapshots = snapshots.unionByName(shown.select("account_id", day, F.lit(OBSERVED).alias("kind"), F.col("cash").cast(money.MONEY).alias("cash"), "currency"))
    both = cash_shown.select("account_id", "balance", "mode_now").unionByName(shown.select("account_id", "balance", "mode_now"))
    expected = projected.select("account_id", F.col("expected").cast(money.MONEY).alias("total"), F.lit(BY_TRANSACTIONS).alias("mode"))
    expected = expected.unionByName(both.select("account_id", F.col("balance").cast(money.MONEY).alias("total"), F.lit(BY_HOLDINGS).alias("mode")))
    return Plan(
        activities=activities,
        snapshots=snapshots,
        positions=positions.select("account_id", "asset_id", "position_id", "day", "quantity", F.col("average_cost").cast(money.MONEY).alias("average_cost"), "cost_from"),
        quotes=positions.select("account_id", "asset_id", "position_id", "day", F.col("price").cast(money.MONEY).alias("price"), "currency"),
        modes=both.where(F.col("mode_now") != BY_HOLDINGS).select("account_id", F.lit(BY_HOLDINGS).alias("mode")),
        valuations=valuations,
        expected=expected,
        errors=reduce(DataFrame.unionByName, [*errors, cash_errors]),
        warnings=reduce(DataFrame.unionByName, warnings),
    )


def _liabilities(owed: DataFrame, world: World) -> tuple[DataFrame, DataFrame]:
    known = world.liabilities.select(F.col("id").alias("liability_id"), F.col("currency").alias("liability_currency"))
    joined = owed.join(known, "liability_id", "left")
    problem = (
        F.when(F.col("liability_currency").isNull(), "no such liability")
        .when(F.col("balance") > 0, "a liability's balance is positive")
        .when(F.col("liability_currency") != F.col("currency"), "currency differs")
    )
    judged = joined.withColumn("problem", problem)
    observed = judged.where("problem is null").select(F.col("liability_id").alias("id"), F.abs("balance").cast(money.MONEY).alias("value"), F.col("balance_day").alias("day"))
    return sinks.valuations(world.liabilities.select("id", "value", "day"), observed), _told(judged.where("problem is not null"), F.col("problem"))


def _cash_activities(cash: DataFrame, world: World, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payloads of creates and updates, accounts with their projected balance, and errors; accounts with an error have neither."""
    own = cash.select("source_id", "account_id", "account_kind", F.col("account_currency").alias("currency"), "history_through", "zone")
    merged = keep(merge_plan.plan(world.transactions, own, world.activities, world.aliases))
    errors = [_told(merged.where(F.startswith("op", F.lit("error"))), F.col("op"), F.col("key"))]
    errors.append(_told(cash.where((F.col("account_kind") == CARD) & (F.col("mode_now") != BY_TRANSACTIONS)), "a card needs transaction tracking"))
    foreign = merge_plan.overlaps(world.activities, own, world.aliases)
    errors.append(_told(own.join(foreign, "account_id"), "activities of another origin after the cutoff"))
    strange = ~money.is_cash_position(F.col("symbol"), F.col("description")) | (F.coalesce("held_in", "currency") != F.col("currency"))
    held = world.positions.select("source_id", "symbol", "description", F.col("currency").alias("held_in"))
    errors.append(_told(held.join(own.where(F.col("account_kind") == CASH), "source_id").where(strange).select("source_id").distinct(), "a cash account with positions"))
    known = keep(reduce(DataFrame.unionByName, errors))
    good = _without(cash, known)
    changes = keep(merge_plan.payloads(merged.join(good.select("source_id"), "source_id", "left_semi")))
    after = merge_plan.applied(world.activities, changes)
    said = F.try_variant_get(money.metadata(F.col("metadata")), "$.source.utcDate", "string").try_cast("date")
    by_sum = good.where((F.col("account_kind") == CARD) | (F.col("mode_now") == BY_TRANSACTIONS))
    accounts = by_sum.select("source_id", "account_id", "account_kind", "currency", "balance", F.coalesce("balance_utc_day", "balance_day").alias("balance_day"))
    projected = keep(balances.projection(accounts, after.withColumn("utc_day", said)))
    late = _told(projected.where("problem is not null"), F.col("problem"))
    writing = _without(good, late).select("account_id").distinct()
    return changes.join(writing, "account_id", "left_semi"), projected.where("problem is null"), known.unionByName(late)


def _securities(accounts: DataFrame, world: World, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accounts to show with their cash, their positions, and errors."""
    own = accounts.select("source_id", "currency", "per_unit")
    mine = world.positions.join(accounts.select("source_id"), "source_id", "left_semi")
    planned = keep(holdings.planned(mine, own, world.held, world.verified, world.rolled).drop("asset_id"))  # names of 36 letters are made where they are read
    planned = planned.withColumn("asset_id", holdings.asset_id())
    sums = keep(holdings.reconciled(mine, accounts.select("source_id", "balance")))
    errors = _told(sums.where("not ok"), "positions do not add up to the balance").unionByName(_told(planned.where("problem is not null"), F.col("problem"), F.col("position_id")))
    shown = _without(accounts, errors).join(sums.select("source_id", F.coalesce("cash", F.lit(0).cast("decimal(28,2)")).alias("cash")), "source_id")
    positions = planned.join(shown.select("source_id", "account_id", "currency", F.col("balance_day").alias("day")), "source_id")
    return shown, positions, errors


TABLES = {"activities": ["id"], "snapshots": ["account_id", "day"], "positions": ["account_id", "asset_id", "day"], "quotes": ["asset_id", "day"], "accounts": ["account_id"], "liabilities": ["id"]}


def publish(store: Store, planned: Plan, as_of: int) -> int:
    """Write a plan and commit it; gives the version.

    as_of: the payload's time in seconds; one that is older than the last published is refused. All changes are read back from what was
    staged; a quote without a price of zero or more or without a currency is refused. Either refusal, like any failure,
    takes back everything, switched modes with it.
    """
    with store.begin() as t:
        if as_of < t.base.marks.get("as_of", as_of):
            raise ValueError("the payload is older than the last one")
        columns = lambda name: t.read(name).columns
        changes = planned.activities.withColumn("id", F.coalesce("id", "key"))
        t.upsert("activities", changes.select(*columns("activities")), verify=True)
        t.upsert("snapshots", planned.snapshots.select(*columns("snapshots")), verify=True)
        t.upsert("positions", planned.positions.select(*columns("positions")), verify=True)
        quotes = planned.quotes.select(*columns("quotes"))
        if not quotes.where("price is null or price < 0 or coalesce(currency, '') = ''").isEmpty():
            raise ValueError("quotes were refused")
        t.upsert("quotes", quotes, verify=True)
        accounts = t.read("accounts")
        switched = accounts.drop("mode").join(planned.modes, "account_id").select(*accounts.columns)
        t.upsert("accounts", switched, verify=True)
        liabilities = t.read("liabilities")
        valued = liabilities.drop("value", "day").join(planned.valuations, "id").select(*liabilities.columns)
        t.upsert("liabilities", valued, verify=True)
        t.mark("as_of", as_of)
    return t.next.version
