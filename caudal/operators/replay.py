"""Authorisation replay: decide each ledger row again from the balance at that moment.

A debit passes when the balance covers it, else it is rejected; deposits always pass; a
debit that is covered but was lost in a failure stays failed and moves nothing. Each
decision depends on all before it, so an account is replayed in time order.

The ledger is cut into slices of about equal size that follow account and time, so an
account with very many rows, or very many at one moment, is spread over slices. Within a slice
rows are streamed and only the running balance is kept. Where an account goes on in a further
slice, that slice is replayed from an assumed balance. It then gives the same decisions for a
whole range of balances around it, and adds the same amount over that range. Walking an account's
slices with those ranges either finds the true starting balance of every slice, or names the
slices still to be replayed. The result is exact; every round settles at least one slice more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.rules import is_deposit
from caudal.operators.support import join_slices, join_small, materialize, sorted_slices

FAR = 2**62
START, DEPOSIT, DEBIT, LOST = 0, 1, 2, 3
STATES = ("Completada", "Rechazada", "Fallida")

_ROWS = (
    "cuenta_id long, _tramo long, fecha_hora timestamp_ntz, id long, paso int, "
    "centavos long, codigo_error string"
)
_ENTERED = (
    "cuenta_id long, _tramo long, paso int, centavos long, id long, codigo_error string, inicio long"
)
_DECIDED = "id long, cuenta_id long, decision int, centavos_saldo long, codigo_error string"
_RANGES = "cuenta_id long, _tramo long, desde long, hasta long, cambio long"
_STARTS = "cuenta_id long, _tramo long, inicio long, seguro boolean, fijo boolean"


def authorization_replay(
    tx: DataFrame, accounts: DataFrame, amount: str = "monto", parts: int | None = None
) -> DataFrame:
    """Ledger rows with their replayed state, error code and balance afterwards.

    ``accounts`` gives the opening balance (``saldo_actual``) by ``id``; an account missing
    there opens with nothing.
    """
    kind = F.col("tipo_transaccion")
    step = (
        F.when(is_deposit(kind), DEPOSIT).when(F.col("estado") == "Fallida", LOST).otherwise(DEBIT)
    )
    rows = tx.select(
        "cuenta_id", "fecha_hora", "id", step.alias("paso"), _cents(amount), "codigo_error"
    )
    # an opening stands before the movements of its account, of an account without any too
    first = accounts.select(F.col("id").alias("cuenta_id"), _cents("saldo_actual"))
    rows = sorted_slices(
        rows.unionByName(_as_start(first).select(*rows.columns)),
        ["cuenta_id", "fecha_hora", "id"], parts,
    )
    edges = rows.select("cuenta_id", "_tramo").mapInPandas(_edges, "cuenta_id long, _tramo long")
    spans = materialize(edges.groupBy("cuenta_id").agg(
        F.min("_tramo").alias("_primero"), F.max("_tramo").alias("_ultimo")
    ).filter("_primero < _ultimo"))
    # a slice has one account at most that goes on in the next, so these are few
    if spans.isEmpty():
        entered = rows.withColumn("inicio", F.lit(None).cast("long"))
    else:
        crossing = spans.join(first, "cuenta_id", "left").fillna(0, ["centavos"])
        moves = rows.filter(F.col("paso") != START)
        settled = _settle(join_small(moves, spans.select("cuenta_id"), "cuenta_id"),
                          materialize(crossing))
        later = settled.join(spans, "cuenta_id").filter("_tramo > _primero")
        entered = join_slices(rows, later.select("_tramo", "inicio"),
                              ["cuenta_id", "fecha_hora", "id"])
    decided = entered.select(*_names(_ENTERED)).mapInPandas(_decide, _DECIDED)
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("decision") + 1)
    code = F.when(F.col("decision") == 1, K.NO_FUNDS).when(
        F.col("decision") == 2, F.col("codigo_error")
    )
    balance = (F.col("centavos_saldo").cast("decimal(20,0)") / 100).cast("decimal(20,2)")
    return decided.select(
        "id", "cuenta_id", state.alias("estado"), code.alias("codigo_error"),
        balance.alias("saldo"),
    )


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last account of a slice; the others begin and end in it."""
    first = last = None
    for batch in batches:
        if len(batch):
            first = batch.iloc[:1] if first is None else first
            last = batch.iloc[-1:]
    if first is not None:
        yield pd.concat([first, last]).drop_duplicates().astype("int64")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _cents(column: str):
    return (F.col(column) * 100).cast("long").alias("centavos")


def _as_start(df: DataFrame) -> DataFrame:
    """Starting balances as rows that sort before the movements of their account or slice."""
    return df.withColumns({
        "fecha_hora": F.lit(None).cast("timestamp_ntz"),
        "id": F.lit(None).cast("long"),
        "paso": F.lit(START),
        "codigo_error": F.lit(None).cast("string"),
    })


def _sorted(rows: DataFrame) -> DataFrame:
    keys = ["cuenta_id", "_tramo"]
    return rows.repartition(*keys).sortWithinPartitions(
        *keys, F.asc_nulls_first("fecha_hora"), F.asc_nulls_first("id")
    )


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replay sorted rows; only the running balance is kept from batch to batch.

    An account without an opening begins with nothing; the first account of a slice with what it
    brings from the slice before, if it goes on there.
    """
    account, part, balance = None, None, 0
    for batch in batches:
        decisions, balances = [], []
        entries = batch["inicio"].fillna(0).astype("int64").tolist()
        rows = zip(batch["cuenta_id"].tolist(), batch["_tramo"].tolist(),
                   batch["paso"].tolist(), batch["centavos"].tolist(), entries)
        for owner, tramo, step, cents, entry in rows:
            if tramo != part:
                account, part, balance = owner, tramo, entry
            elif owner != account:
                account, balance = owner, 0
            decision = 0
            if step == START:
                balance, decision = cents, -1
            elif step == DEPOSIT:
                balance += cents
            elif balance < cents:
                decision = 1
            elif step == LOST:
                decision = 2
            else:
                balance -= cents
            decisions.append(decision)
            balances.append(balance)
        out = batch[["id", "cuenta_id", "codigo_error"]].assign(
            decision=decisions, centavos_saldo=balances
        )
        out = out[out["decision"] >= 0].astype({"id": "int64", "codigo_error": "object"})
        yield out[_names(_DECIDED)]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each slice, the range of starting balances it decides alike, and what it adds."""
    current, start, balance, down, up = None, 0, 0, FAR, FAR

    def closed() -> tuple:
        return (*current, start - down, start + up, balance - start)

    for batch in batches:
        done = []
        rows = zip(batch["cuenta_id"].tolist(), batch["_tramo"].tolist(),
                   batch["paso"].tolist(), batch["centavos"].tolist())
        for account, part, step, cents in rows:
            if (account, part) != current:
                if current is not None:
                    done.append(closed())
                current, start, balance, down, up = (account, part), 0, 0, FAR, FAR
            if step == START:
                start = balance = cents
            elif step == DEPOSIT:
                balance += cents
            elif balance < cents:
                up = min(up, cents - balance)
            else:
                down = min(down, balance - cents)
                balance -= cents if step == DEBIT else 0
        yield pd.DataFrame(done, columns=_names(_RANGES))
    if current is not None:
        yield pd.DataFrame([closed()], columns=_names(_RANGES))


def _walk(ranges: pd.DataFrame) -> pd.DataFrame:
    """Carry one account's balance over its slices: exact where a known range covers it."""
    ranges = ranges.sort_values("_tramo", kind="stable")
    account = int(ranges["cuenta_id"].iloc[0])
    balance = int(ranges["apertura"].iloc[0])
    starts = []
    columns = [ranges[c].tolist() for c in ("_tramo", "desde", "hasta", "cambio")]
    slices: dict[int, list[tuple]] = {}
    for part, low, high, change in zip(*columns):
        slices.setdefault(part, []).append((low, high, change))
    exact = True  # so far no guess, so the starting balance is the true one
    for part, known in slices.items():
        covering = [change for low, high, change in known if low <= balance < high]
        starts.append((account, part, balance, bool(covering), exact and bool(covering)))
        exact = exact and bool(covering)
        if covering:
            balance += covering[0]
        else:  # a guess for the next round: the change seen nearest to this balance
            near = min(known, key=lambda k: min(abs(k[0] - balance), abs(k[1] - balance)))
            balance = max(0, balance + near[2])
    return pd.DataFrame(starts, columns=_names(_STARTS))


def _settle(rows: DataFrame, crossing: DataFrame) -> DataFrame:
    """True starting balance of every slice of the accounts that span several.

    Slices settled from the front are put aside with their ranges, and the account goes on from
    the balance found there. That slice is replayed from its true balance next, so an account
    needs no more rounds than it has slices.
    """
    net = (
        F.when(F.col("paso") == DEPOSIT, F.col("centavos"))
        .when(F.col("paso") == DEBIT, -F.col("centavos"))
        .otherwise(0)
    )
    nothing_known = rows.groupBy("cuenta_id", "_tramo").agg(
        F.lit(1).cast("long").alias("desde"),
        F.lit(0).cast("long").alias("hasta"),
        F.sum(net).alias("cambio"),
    )
    rounds = crossing.agg(F.max(F.col("_ultimo") - F.col("_primero"))).first()[0] + 3
    opening = crossing.select("cuenta_id", F.col("centavos").alias("apertura"))
    ranges = materialize(nothing_known)
    done = None
    for _ in range(rounds):
        carried = ranges.join(opening, "cuenta_id")
        starts = materialize(carried.groupBy("cuenta_id").applyInPandas(_walk, _STARTS))
        fixed = starts.filter("fijo").select("cuenta_id", "_tramo", "inicio")
        done = fixed if done is None else done.unionByName(fixed)
        open_ = starts.filter("not fijo")
        if open_.isEmpty():
            return done
        unsure = open_.filter("not seguro").select("cuenta_id", "_tramo", "inicio")
        again = join_small(rows, unsure.select("cuenta_id", "_tramo"), ["cuenta_id", "_tramo"])
        heads = _as_start(unsure.withColumnRenamed("inicio", "centavos"))
        measured = _sorted(again.select(*_names(_ROWS)).unionByName(heads)).mapInPandas(
            _measure, _RANGES
        )
        left = ranges.join(open_.select("cuenta_id", "_tramo"), ["cuenta_id", "_tramo"])
        ranges = materialize(left.select(*_names(_RANGES)).unionByName(measured))
        opening = materialize(
            open_.groupBy("cuenta_id").agg(F.min_by("inicio", "_tramo").alias("apertura"))
        )
    raise RuntimeError("the replay did not settle")
