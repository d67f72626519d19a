"""Forecasts: the baseline from the ledger, a month-by-month projection, yearly sums and loan schedules."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from hearthbook.functions import predicates as P
from hearthbook.functions.ratio import round_half_even

# Fixed value: the months that a scenario may have.
MOST_MONTHS = 1200
# Months are projected with so many digits; a batch of so many projected rows leaves a task at once.
DIGITS, ROWS_AT_ONCE = 34, 20000
# Scenarios whose figures stay below this, and that have no more of them, are projected together.
FIGURES, ITEMS = 2**40, 1000


def baseline(rows: DataFrame, balances: DataFrame, accounts: DataFrame, start: str, end: str, months: int) -> DataFrame:
    """Per currency: cash (card balances negative), and mean monthly income and net spending over so many months."""
    kind = accounts.select("account_id", "account_type", "currency")
    signed = F.when(F.col("account_type") == "credit_card", -F.col("closing_balance_minor")).otherwise(F.col("closing_balance_minor"))
    cash = balances.join(kind, "account_id").where("account_type in ('checking', 'savings', 'credit_card')").groupBy("currency").agg(F.sum(signed).cast("bigint").alias("cash"))
    kept = rows.where(P.countable() & P.in_period(start, end))
    income = F.sum(F.when(P.metric("inflow"), F.col("amount_minor"))).cast("bigint")
    spent = F.sum(F.when(P.spending(), -F.col("amount_minor")).when(P.refund(), -F.col("amount_minor"))).cast("bigint")
    flows = kept.groupBy("currency").agg(F.coalesce(income, F.lit(0)).alias("i"), F.coalesce(spent, F.lit(0)).alias("s"))
    joined = cash.join(flows, "currency", "full_outer").na.fill(0)
    return joined.select("currency", "cash", round_half_even(F.col("i"), F.lit(months)).alias("monthly_income"), round_half_even(F.col("s"), F.lit(months)).alias("monthly_spending"))


_ONE = Decimal(1)


def _rounded(x: Decimal) -> int:
    return int(x.quantize(_ONE, ROUND_HALF_EVEN))


def _each(scenario: dict, name: str) -> list[dict]:
    held = scenario.get(name)
    return [] if held is None else list(held)


class _Holding:
    """An asset that grows by its monthly factor, or a loan that accrues a twelfth of its rate, rounded half to even."""

    def __init__(self, row: dict):
        self.loan = row["kind"] == "loan"
        rate, self.payment = Decimal(int(row["annual_rate_bp"])) / 10000, int(row.get("monthly_payment_minor") or 0)
        self.balance, self.rate = Decimal(int(row["value_minor"])), rate / 12 if self.loan else _monthly(rate)
        self.worth = _rounded(self.balance)

    def advance(self) -> int:
        """One month; what the payment takes out of cash."""
        if not self.loan:
            self.balance *= self.rate
            self.worth = _rounded(self.balance)
            return 0
        if self.balance <= 0:
            return 0
        owed = self.balance + _rounded(self.balance * self.rate)
        paid = min(Decimal(self.payment), owed)
        self.balance = owed - paid
        self.worth = int(self.balance)
        return int(paid)


@lru_cache(4096)
def _monthly(rate: Decimal) -> Decimal:
    """The monthly factor of a yearly rate."""
    with localcontext(Context(prec=DIGITS)):
        return (1 + rate) ** (Decimal(1) / 12) if rate > -1 else Decimal(0)


@lru_cache(256)
def _path(rate_bp: int, months: int) -> tuple[Decimal, ...]:
    """What a yearly rate has made of 1 after each month; scenarios of equal rates share it."""
    with localcontext(Context(prec=DIGITS)):
        factor, level, levels = _monthly(Decimal(rate_bp) / 10000), Decimal(1), []
        for _ in range(months):
            level *= factor
            levels.append(level)
    return tuple(levels)


@lru_cache(256)
def _grown(amount: int | Decimal, rate_bp: int, months: int) -> tuple[int, ...]:
    """An amount that follows ``_path``, rounded each month."""
    with localcontext(Context(prec=DIGITS)):
        return tuple(_rounded(amount * level) for level in _path(rate_bp, months))


def project_one(scenario: dict):
    """(month, income, spending, loan_payments, one_offs, cash, assets, loans, net_worth, net_worth_today) a month, in minor units.

    Prices and pay rise every month by the twelfth root of their yearly factors,
    at 34 digits.  Months count from 1; income_steps (month, amount) and one_offs
    (month, amount) apply from and in theirs, spending_changes (category,
    percent_bp) to all of a category.  Debts leave cash by their payments.  More than
    1200 months are refused.
    """
    if int(scenario["months"]) > MOST_MONTHS:
        raise ValueError(f"a scenario may have {MOST_MONTHS} months, not {scenario['months']}")
    months, inflation, growth = (int(scenario[k]) for k in ("months", "inflation_bp", "income_growth_bp"))
    with localcontext(Context(prec=DIGITS)):
        change = {c["category"]: 1 + Decimal(int(c["percent_bp"])) / 10000 for c in _each(scenario, "spending_changes")}
        categories = [_grown(Decimal(int(c["amount"])) * change.get(c["category"], 1), inflation, months) for c in _each(scenario, "spending")]
        earned, steps = int(scenario["monthly_income"]), [(s["month"], int(s["amount"])) for s in _each(scenario, "income_steps")]
        extras = [(o["month"], int(o["amount"])) for o in _each(scenario, "one_offs")]
        holdings = [_Holding(a) for a in _each(scenario, "assets")]
        cash, prices, pays = int(scenario["cash"]), _path(inflation, months), _path(growth, months)
        incomes = None if steps else _grown(earned, growth, months)
        for month in range(1, months + 1):
            income = incomes[month - 1] if incomes else _rounded((earned + sum(amount for since, amount in steps if since <= month)) * pays[month - 1])
            spending = sum(c[month - 1] for c in categories)
            extra = sum(amount for at, amount in extras if at == month) if extras else 0
            paid = sum(h.advance() for h in holdings)
            cash += income - spending - paid + extra
            assets = loans = 0
            for h in holdings:
                if h.loan:
                    loans += h.worth
                else:
                    assets += h.worth
            worth = cash + assets - loans
            yield month, income, spending, paid, extra, cash, assets, loans, worth, _rounded(worth / prices[month - 1])


@lru_cache(256)
def _held(value: int, rate_bp: int, months: int) -> tuple[Decimal, ...]:
    """An asset's value after each month, not rounded, as ``_Holding`` has it."""
    with localcontext(Context(prec=DIGITS)):
        asset, balances = _Holding({"kind": "asset", "value_minor": value, "annual_rate_bp": rate_bp}), []
        for _ in range(months):
            asset.advance()
            balances.append(asset.balance)
    return tuple(balances)


@lru_cache(256)
def _levels(rate_bp: int, months: int):
    """``_path`` in doubles."""
    import numpy as np

    return np.array([float(level) for level in _path(rate_bp, months)])


def _nearest(values):
    """Doubles rounded to whole numbers, and where that may be wrong: near a half, from FIGURES on, and what is not finite."""
    import numpy as np

    with np.errstate(invalid="ignore"):
        whole = np.rint(values)
        return whole.astype("int64"), ~(np.abs(np.abs(values - whole) - 0.5) > np.abs(values) / FIGURES)


def project_many(scenarios: list[dict], months: int) -> list:
    """What ``project_one`` gives for scenarios that all have so many months: its columns but month, a row a scenario and a column a month.

    All are projected together in doubles, which are right to 50 bits.  A value that
    lies too near a half to be rounded by them is computed at 34 digits, an asset's
    with all months before, whose digits it carries; a scenario with figures too
    large for doubles is projected by itself.
    """
    with localcontext(Context(prec=DIGITS)):
        return _together(scenarios, months)


def _together(scenarios: list[dict], months: int) -> list:
    import numpy as np

    size, alone = (len(scenarios), months), np.zeros(len(scenarios), bool)
    cash, earned, extra = np.zeros((len(scenarios), 1), "int64"), np.zeros(size, "int64"), np.zeros(size, "int64")
    spent, owned, owing = [], [], []
    for i, s in enumerate(scenarios):
        spending, assets, steps, extras = (_each(s, k) for k in ("spending", "assets", "income_steps", "one_offs"))
        figures = [int(s["cash"]), int(s["monthly_income"]), *(int(x["amount"]) for part in (spending, steps, extras) for x in part), *(int(x["value_minor"]) for x in assets), *(int(x.get("monthly_payment_minor") or 0) for x in assets)]
        if len(figures) > ITEMS or max(figures) >= FIGURES or min(figures) <= -FIGURES:
            alone[i] = True
            continue
        cash[i], earned[i] = figures[:2]
        change = {c["category"]: 1 + Decimal(int(c["percent_bp"])) / 10000 for c in _each(s, "spending_changes")}
        spent += [(i, int(s["inflation_bp"]), Decimal(int(c["amount"])) * change.get(c["category"], 1)) for c in spending]
        for x in steps:
            earned[i, max(x["month"] - 1, 0):] += int(x["amount"])
        for x in extras:
            if 1 <= x["month"] <= months:
                extra[i, x["month"] - 1] += int(x["amount"])
        for x in assets:
            held = (i, int(x["value_minor"]), int(x["annual_rate_bp"]), int(x.get("monthly_payment_minor") or 0))
            (owing if x["kind"] == "loan" else owned).append(held)

    def levels(rates):
        return np.stack([_levels(r, months) for r in rates]) if rates else np.zeros((0, months))

    def summed(at, parts):
        total = np.zeros(size, "int64")
        np.add.at(total, at, parts)
        return total

    def rounded(values, at, exact):
        """values rounded; those that doubles do not tell by exact(row, column), or where too large their scenario is left alone."""
        whole, unsure = _nearest(values)
        told = unsure & (np.abs(values) < FIGURES)
        alone[at[(unsure & ~told).any(axis=1)]] = True
        for k, m in np.argwhere(told).tolist():
            whole[k, m] = _rounded(exact(k, m))
        return whole

    each, column = np.arange(len(scenarios)), lambda rows, k, kind="int64": np.array([r[k] for r in rows], kind)
    growth, inflation = ([int(s[k]) for s in scenarios] for k in ("income_growth_bp", "inflation_bp"))
    prices = levels(inflation)
    with np.errstate(all="ignore"):
        income = rounded(earned * levels(growth), each, lambda k, m: int(earned[k, m]) * _path(growth[k], months)[m])
        at = column(spent, 0)
        spending = summed(at, rounded(column(spent, 2, "double")[:, None] * prices[at], at, lambda k, m: spent[k][2] * _path(spent[k][1], months)[m]))
        at = column(owned, 0)
        assets = summed(at, rounded(column(owned, 1)[:, None] * levels([h[2] for h in owned]), at, lambda k, m: _held(*owned[k][1:3], months)[m]))
        at, balance, rate, payment = (column(owing, k) for k in range(4))
        paid, left = np.zeros((2, len(owing), months), "int64")
        for month in range(months):
            owed = np.maximum(balance, 0)
            interest = rounded((owed * (rate / 120000))[:, None], at, lambda k, _, owed=owed: int(owed[k]) * (Decimal(int(rate[k])) / 10000 / 12))[:, 0]
            paid[:, month] = np.where(balance > 0, np.minimum(payment, owed + interest), 0)
            balance = balance + interest - paid[:, month]
            left[:, month] = balance
        paid, loans = summed(at, paid), summed(at, left)
        cash = cash + np.cumsum(income - spending - paid + extra, axis=1)
        worth = cash + assets - loans
        today = rounded(worth / prices, each, lambda k, m: int(worth[k, m]) / _path(inflation[k], months)[m])
        out = [income, spending, paid, extra, cash, assets, loans, worth, today]
    for i in np.flatnonzero(alone):
        for values, exact in zip(out, list(zip(*project_one(scenarios[i])))[1:]):
            values[i] = exact
    return out


PROJECTED = "scenario_id long, month int, income long, spending long, loan_payments long, one_offs long, cash long, assets long, loans long, net_worth long, net_worth_today long"


def spread(scenarios: DataFrame) -> DataFrame:
    """The scenarios dealt out evenly: a small file of them is many rows to come, and would be one task."""
    spark = scenarios.sparkSession
    return scenarios.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _listed(array) -> list:
    """array.to_pylist(), by whole columns: that makes an object of every value first, which took longer than the projection."""
    import pyarrow as pa

    kind = array.type
    if pa.types.is_integer(kind):
        values = array.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_struct(kind) and kind.num_fields:
        names = [kind.field(i).name for i in range(kind.num_fields)]
        values = [dict(zip(names, row)) for row in zip(*map(_listed, array.flatten()))]
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        items = iter(_listed(array.flatten()))
        values = [list(islice(items, n)) for n in _listed(array.value_lengths().fill_null(0))]
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return array.to_numpy(zero_copy_only=False).tolist()
    else:
        return array.to_pylist()
    return [v if held else None for v, held in zip(values, array.is_valid().to_numpy(zero_copy_only=False))] if array.null_count else values


def project(scenarios: DataFrame) -> DataFrame:
    """scenarios (scenario_id, cash, monthly_income, income_growth_bp, inflation_bp, months, and arrays of structs spending, assets, ...) -> a row per month."""
    import numpy as np
    import pyarrow as pa

    names, types = zip(*(c.split() for c in PROJECTED.split(", ")))
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in zip(names, types)])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                alike = {}
                for s in _listed(batch.slice(start, 512).to_struct_array()):
                    alike.setdefault(int(s["months"]), []).append(s)
                for months, group in alike.items():
                    if months > MOST_MONTHS:
                        raise ValueError(f"a scenario may have {MOST_MONTHS} months, not {months}")
                    step = max(1, ROWS_AT_ONCE // max(1, months))
                    for part in (group[k:k + step] for k in range(0, len(group) if months > 0 else 0, step)):
                        ids = pa.array([s["scenario_id"] for s in part], schema[0].type).take(pa.array(np.repeat(np.arange(len(part)), months)))
                        month = pa.array(np.tile(np.arange(1, months + 1, dtype="int32"), len(part)))
                        yield pa.RecordBatch.from_arrays([ids, month, *(pa.array(c.reshape(-1)) for c in project_many(part, months))], schema=schema)

    return spread(scenarios).mapInArrow(run, PROJECTED)


@udtf(returnType=PROJECTED.partition(", ")[2])
class ProjectTable:
    """``project`` as a table function of one scenario, a struct with the fields of ``project_one``."""

    def eval(self, scenario):
        yield from project_one(scenario.asDict(recursive=True))


def register_table_functions(spark: SparkSession) -> None:
    """Lets SQL say: select scenario_id, p.* from (select scenario_id, struct(*) as scenario from scenarios) s, lateral project(scenario) p"""
    spark.udtf.register("project", ProjectTable)


def yearly(projected: DataFrame) -> DataFrame:
    """Twelve-month chunks: sums of the flows, and the levels at each chunk's end."""
    year = F.floor((F.col("month") - 1) / 12) + 1
    last = lambda c: F.max_by(c, "month").alias(c)
    return projected.groupBy("scenario_id", year.alias("year")).agg(*(F.sum(c).alias(c) for c in ("income", "spending", "loan_payments", "one_offs")), *(last(c) for c in ("cash", "assets", "loans", "net_worth", "net_worth_today")))


def loan_schedule(loans: DataFrame, months: int) -> DataFrame:
    """loans (loan_id, balance, rate_bp, payment) -> loan_id, month, interest, balance: an integer recurrence, folded inside each loan's row."""
    due = "((x - pmod(x, 120000)) div 120000 + case when 2 * pmod(x, 120000) > 120000 then 1 when 2 * pmod(x, 120000) = 120000 and pmod((x - pmod(x, 120000)) div 120000, 2) = 1 then 1 else 0 end)"
    interest = due.replace("x", "(owed * rate_bp)")
    plan = f"""aggregate(sequence(0, {max(0, months)}), array(named_struct('month', 0, 'interest', cast(0 as bigint), 'balance', cast(balance as bigint))),
        (plan, m) -> if(m > 0 and element_at(plan, -1).balance > 0, concat(plan, transform(array(element_at(plan, -1).balance), owed ->
            named_struct('month', m, 'interest', cast({interest} as bigint), 'balance', cast(owed + {interest} - least(payment, owed + {interest}) as bigint)))), plan))"""
    return loans.select("loan_id", F.inline(F.expr(plan))).where("month > 0")
