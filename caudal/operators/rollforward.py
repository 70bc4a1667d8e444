"""Cash roll-forward: floor, borrow below the reserve, invest a surplus, day after day.

A day turns the cash before it into the cash after it by a piecewise linear function: constant up
to the floor, then one slope each for borrowing, holding and investing. Such functions compose to
piecewise linear functions again. So the days are cut into slices of about equal size that follow
entity and date; every slice of an entity that goes on in another one is composed on its own; the
few compositions, applied one after another to the opening cash, give the cash at the start of
every slice; and the slices are rolled at the same time. A calendar of any length is split, and no
step holds an entity together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import double
from caudal.operators.support import join_slices, sorted_slices

#: A composition with more pieces is closed, and another one goes on from there.
MOST_PIECES = 512

_INPUT = ("tasa_bcv_usd_ves", "flujo_neto_usd", "total_depositos_ves", "total_depositos_usd")
_FORWARD = (
    "entidad string, fecha date, disponible_caja_ves double, encaje_legal_bcv_ves double, "
    "tasa_liquidez double, brecha_liquidez_usd double, fondeo_usd double, inversion_usd double"
)
_RUNS = (
    "entidad string, _tramo long, orden int, hasta array<double>, "
    "pendiente array<double>, base array<double>"
)
_ENTRIES = "_tramo long, apertura double"

#: Pieces of a function of the cash before, ascending: (up to, slope, base). The last one's upper
#: end is the end of the domain.
Pieces = list[tuple[float, float, float]]


@dataclass(frozen=True)
class Rules:
    """How a day treats its cash."""

    floor: float
    reserve: float
    borrow: float
    invest: float
    trigger: float

    def step(self, cash: float, rate: float, flow: float, ves: float, usd: float) -> tuple:
        """Cash, reserve, ratio, gap, borrowed and invested of one day."""
        cash = max(ves * self.floor, cash + flow * rate)
        frozen = ves * self.reserve
        ratio = cash / (ves + 1.0)
        gap = (cash - frozen) / rate
        lent = placed = None
        if gap < 0:
            lent = abs(gap) * self.borrow
            cash += lent * rate
        elif gap > usd * self.trigger:
            placed = gap * self.invest
            cash -= placed * rate
        return cash, frozen, ratio, gap, lent, placed

    def day(self, rate: float, flow: float, ves: float, usd: float) -> Pieces:
        """A day as a function of the cash before it, over all numbers."""
        least, inflow, frozen = ves * self.floor, flow * rate, ves * self.reserve
        high = frozen + usd * self.trigger * rate
        out: Pieces = []
        treated = [(frozen, 1 - self.borrow, self.borrow * frozen)]
        if high > frozen:
            treated.append((high, 1.0, 0.0))
        treated.append((float("inf"), 1 - self.invest, self.invest * frozen))
        for upto, slope, base in treated:
            if upto < least:
                continue
            if not out:
                out.append((least - inflow, 0.0, slope * least + base))
            out.append((upto - inflow, slope, slope * inflow + base))
        return out


def compose(before: Pieces, low: float, then: Pieces) -> Pieces:
    """``then`` after ``before``, whose domain begins at ``low``. Equal neighbours become one."""
    out: Pieces = []

    def put(upto: float, slope: float, base: float) -> None:
        if out and out[-1][1] == slope and out[-1][2] == base:
            out.pop()
        out.append((upto, slope, base))

    for upto, slope, base in before:
        if slope == 0 or not low < upto:
            k = next(i for i, piece in enumerate(then) if base <= piece[0])
            put(upto, 0.0, then[k][1] * base + then[k][2])
            low = upto
            continue
        ordered = range(len(then)) if slope > 0 else range(len(then) - 1, -1, -1)
        at = low
        for i in ordered:
            limit = then[i][0] if slope > 0 else (then[i - 1][0] if i else float("-inf"))
            end = min(upto, (limit - base) / slope)
            if end > at:
                put(end, slope * then[i][1], then[i][1] * base + then[i][2])
                at = end
            if at >= upto:
                break
        low = upto
    return out


def value(pieces: Pieces, cash: float) -> float:
    for upto, slope, base in pieces:
        if cash <= upto:
            return slope * cash + base
    _, slope, base = pieces[-1]
    return slope * cash + base


def cash_rollforward(
    flows: DataFrame,
    opening: float = K.OPENING_CASH,
    floor: float = K.CASH_FLOOR_SHARE,
    reserve: float = K.RESERVE_SHARE,
    borrow: float = K.BORROW_FACTOR,
    invest: float = K.INVEST_FACTOR,
    trigger: float = K.INVEST_TRIGGER,
    parts: int | None = None,
) -> DataFrame:
    """Cash of each entity from day to day: floor, borrow below the reserve, invest a surplus.

    Takes entidad, fecha, tasa_bcv_usd_ves (above zero), flujo_neto_usd, total_depositos_ves and
    total_depositos_usd, one row per entity and day. The gap and the ratio are those before the
    day's treasury operation, the cash is after it. ``parts`` is a hint of layout. The cash at the
    start of a later slice comes from a composition and can differ from a single fold's in the
    last bits of a double.
    """
    rules = Rules(floor, reserve, borrow, invest, trigger)
    numbers = [double(F.col(c)).alias(c) for c in _INPUT]
    days = sorted_slices(
        flows.select("entidad", "fecha", *numbers), ["entidad", "fecha"], parts
    )
    # no cash ever leaves this range while no factor throws it beyond what it was
    ves = F.abs("total_depositos_ves")
    moved = F.abs(F.col("flujo_neto_usd") * F.col("tasa_bcv_usd_ves")) + ves * F.lit(
        abs(floor) + (abs(borrow) + abs(invest)) * abs(reserve)
    )
    last, total = days.agg(F.max("_tramo"), F.sum(moved)).first()
    if last:
        tame = abs(1 - borrow) <= 1 and abs(1 - invest) <= 1
        reach = abs(opening) + total if tame else float("inf")
        runs = days.mapInPandas(_composer(rules, reach), _RUNS)
        starts = (
            runs.repartition("entidad").sortWithinPartitions("entidad", "_tramo", "orden")
            .mapInPandas(_entries(opening), _ENTRIES)
        )
        days = join_slices(days, starts, ["entidad", "fecha"])
    else:
        days = days.withColumn("apertura", F.lit(None).cast("double"))
    return days.mapInPandas(_roller(rules, opening), _FORWARD)


def _composer(rules: Rules, reach: float):
    """Compositions of the first and the last entity of every slice; others begin and end in it."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RUNS.split(", ")]
        entity, tramo, seen, now = None, 0, 0, []
        held: list[tuple] = []

        def close() -> None:
            held.append((entity, tramo, len(held), *(list(c) for c in zip(*now, strict=True))))

        for batch in batches:
            columns = [batch[c].tolist() for c in ("entidad", "_tramo", *_INPUT)]
            for name, tramo, *day in zip(*columns, strict=True):
                if not seen or name != entity:
                    if seen:
                        close()
                    if seen == 1:
                        yield pd.DataFrame(held, columns=names)
                    held.clear()
                    entity, seen, now = name, seen + 1, [(reach, 1.0, 0.0)]
                elif len(now) > MOST_PIECES:
                    close()
                    now = [(reach, 1.0, 0.0)]
                now = compose(now, -reach, rules.day(*day))
        if seen:
            close()
            yield pd.DataFrame(held, columns=names)

    return runs


def _entries(opening: float):
    """Cash at the start of every slice that an entity enters from an earlier one."""

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, cash, begun = None, opening, False
        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in ("entidad", "_tramo", "orden", "hasta",
                                                   "pendiente", "base")]
            for name, tramo, order, *pieces in zip(*columns, strict=True):
                if not begun or name != entity:
                    entity, cash, begun = name, opening, True
                elif order == 0:
                    out.append((tramo, cash))
                cash = value(list(zip(*pieces, strict=True)), cash)
            yield pd.DataFrame(out, columns=["_tramo", "apertura"])

    return starts


def _roller(rules: Rules, opening: float):
    """Roll sorted days; only the cash is kept from batch to batch."""

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _FORWARD.split(", ")]
        entity = slice_ = None
        cash = opening
        for batch in batches:
            out = []
            columns = [batch[c].tolist() for c in ("entidad", "_tramo", "apertura", *_INPUT)]
            for name, tramo, entry, *day in zip(*columns, strict=True):
                if tramo != slice_:  # a slice's entry is that of its first entity
                    cash = opening if entry is None or entry != entry else entry
                elif name != entity:
                    cash = opening
                entity, slice_ = name, tramo
                made = rules.step(cash, *day)
                cash = made[0]
                out.append(made)
            result = pd.DataFrame(out, columns=names[2:], index=batch.index, dtype="float64")
            yield pd.concat([batch[["entidad", "fecha"]].astype({"entidad": "object"}), result],
                            axis=1)[names]

    return roll
