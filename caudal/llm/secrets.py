"""Secret scans: fixed patterns and two character Markov models (op 7).

The patterns find labelled assignments, access keys and long hex strings. Two models of
character transitions, one of random strings and one of ordinary identifiers, are trained from
samples that the patterns label; a token of 12 or more characters that no pattern span covers is a
secret when its log-likelihood ratio is high. The bound is chosen by length from the same samples.
DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.storage import stored

#: Kinds in order: pattern, group that is measured, its least length in characters.
PATTERNS = {
    "assign": (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ with 24 or more
}
KINDS = (*PATTERNS, "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 12  # characters of the shortest token that is scored
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
SAMPLE = r"[A-Za-z0-9+/_=-]{6,}"
SIZE = len(ALPHABET) + 1
#: Upper case, lower case, digits, signs: which parts of the alphabet a token uses.
PARTS = ((1, 26), (27, 52), (53, 62), (63, 67))

TRAIN_DOCS = 10_000  # bound of the training sample
SLOTS = 1 << 30  # fineness of the hash that draws it
THRESHOLD = 30.0  # nats by which the random model must be more likely, in too small samples
BANDS = (LEAST, 16, 20)  # least lengths that have a threshold of their own
LOWEST = 10  # nats: no threshold chosen from samples is below
ENOUGH = 1_000  # ordinary tokens from which on thresholds are chosen from samples
FEW_LETTERS = 3  # a token of so few different characters is a rule or a filler, not a key
FALSE_COST = 10  # a false share counts so many times a missed share


#: A text is scanned in pieces of about so many characters, cut before a character that no pattern
#: holds, before a single space that touches neither another space nor ``:`` or ``=``, or before a
#: ``:`` that no label, quote or space precedes. No match and no token crosses such a place.
PIECE = 4096
_BORDER = (
    r"""(?=[^A-Za-z0-9+/_.=\-"'\x20:])|(?=(?<=[^\x20:=])\x20[^\x20:=])"""
    r"""|(?=(?<![\x20"'])(?<!(?i:password|passwd|secret|token|api_key|apikey)):)"""
)
_PIECES = rf"(?s).{{{PIECE},}}?(?:{_BORDER}|\z)|.+"
#: Matches of one piece are placed in runs of so many, as a run's list is copied for each of them.
RUN = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column) -> Column:
    """The text cut at places that no match crosses."""
    cut = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(cut)


def starts_of(lengths: Column) -> Column:
    """Running sums before every entry; in runs, so that no long list grows entry by entry."""
    none = F.expr("cast(array() as array<int>)")

    def walk(values: Column, first: Column) -> Column:
        return F.aggregate(
            values, F.struct(none.alias("found"), first.alias("at")),
            lambda acc, n: F.struct(
                F.concat(acc["found"], F.array(acc["at"])).alias("found"),
                (acc["at"] + n).alias("at"),
            ),
        )

    def placed(all_lengths: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_lengths) - 1) / F.lit(RUN)).cast("int"))
        runs = F.transform(numbers, lambda r: walk(
            F.slice(all_lengths, r * RUN + 1, RUN), F.lit(0)
        ))
        return bound(runs, lambda rs: bound(
            walk(F.transform(rs, lambda r: r["at"]), F.lit(0))["found"],
            lambda firsts: F.flatten(F.transform(
                rs, lambda r, k: F.transform(r["found"], lambda at: at + F.get(firsts, k))
            )),
        ))

    return bound(lengths, lambda n: F.when(F.size(n) > 0, placed(n)).otherwise(none))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points.

    Matches stand between the pieces that a split by the same pattern leaves, so their places
    follow from the lengths of both.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(
        F.slice(between, 1, F.size(whole)).alias("piece"), whole.alias("whole"),
        part.alias("part"),
    )
    empty = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    lengths = lambda z: F.transform(
        z, lambda m: F.length(m["piece"]) + F.length(m["whole"])
    )
    found = bound(zipped, lambda z: F.transform(
        F.arrays_zip(z.alias("m"), starts_of(lengths(z)).alias("at")),
        lambda x: F.struct(
            (x["at"] + F.length(x["m"]["piece"])).alias("start"),
            (x["at"] + F.length(x["m"]["piece"]) + F.length(x["m"]["whole"])).alias("end"),
            x["m"]["part"].alias("value"),
        ),
    ))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind of pattern the spans that pass its least length."""

    def long_enough(kind: str) -> Column:
        pattern, group, least = PATTERNS[kind]
        return F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)

    return {kind: long_enough(kind) for kind in PATTERNS}


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _table(values: tuple[float, ...], kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class MarkovModels:
    """Log ratio of every transition: random strings over ordinary identifiers.

    ``surprise`` is the negative logarithm of the ordinary model. With it a token is also held
    against a uniform draw from the parts of the alphabet that it uses, since labelled strings
    need not show every alphabet. ``thresholds`` are (least length, nats), ``measured`` has what
    they gave on the samples: (least length, share of random strings found, share of ordinary
    tokens taken for random).
    """

    ratios: tuple[float, ...]
    surprise: tuple[float, ...] = ()
    thresholds: tuple[tuple[int, float], ...] = ((LEAST, THRESHOLD),)
    measured: tuple[tuple[int, float, float], ...] = ()

    def score(self, codes: Column) -> Column:
        """Log-likelihood ratio of a token given as alphabet positions."""
        table = _table(self.ratios, "double")
        if not self.surprise:
            return F.aggregate(
                codes,
                F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")),
                lambda acc, c: F.struct(
                    (acc["sum"] + F.get(table, acc["last"] * SIZE + c)).alias("sum"),
                    c.alias("last"),
                ),
                lambda acc: acc["sum"],
            )
        surprise = _table(self.surprise, "double")
        part = _table(tuple(
            sum(1 << k for k, (a, b) in enumerate(PARTS) if a <= c <= b) for c in range(SIZE)
        ), "int")
        room = _table(tuple(
            math.log(max(1, sum(b - a + 1 for k, (a, b) in enumerate(PARTS) if used >> k & 1)))
            for used in range(1 << len(PARTS))
        ), "double")
        return F.aggregate(
            codes,
            F.struct(
                F.lit(0.0).alias("sum"), F.lit(0.0).alias("plain"), F.lit(0).alias("used"),
                F.lit(0).alias("n"), F.lit(0).alias("last"),
            ),
            lambda acc, c: F.struct(
                (acc["sum"] + F.get(table, acc["last"] * SIZE + c)).alias("sum"),
                (acc["plain"] + F.get(surprise, acc["last"] * SIZE + c)).alias("plain"),
                acc["used"].bitwiseOR(F.get(part, c)).alias("used"),
                (acc["n"] + 1).alias("n"), c.alias("last"),
            ),
            lambda acc: F.greatest(acc["sum"], acc["plain"] - acc["n"] * F.get(room, acc["used"])),
        )

    def threshold(self, length: Column) -> Column:
        """Nats from which on a token of this length is a secret."""
        out = F.lit(self.thresholds[0][1])
        for least, nats in self.thresholds[1:]:
            out = F.when(length >= least, F.lit(nats)).otherwise(out)
        return out


def calibrated(models: MarkovModels, chained: DataFrame) -> MarkovModels:
    """The models with thresholds chosen from labelled samples.

    ``chained`` has ``random``, ``count`` and ``c``, 0 and the alphabet positions. Begins of random
    strings are samples of shorter ones. In each band of lengths the threshold has the least sum
    of the missed share and ``FALSE_COST`` times the false share; a share of secrets among the
    ordinary tokens that is small beside 1 / ``FALSE_COST`` cannot raise it past the random
    strings. A band with few samples takes the threshold of all lengths.
    """
    codes = chained.select(
        "random", "count", F.slice("c", 2, F.size("c")).alias("codes")
    ).filter(F.size("codes") >= LEAST)
    cut = F.when(F.col("random"), F.array(*[
        F.slice("codes", 1, n) for n in range(LEAST, 33)
    ])).otherwise(F.array("codes"))
    # a begin that is no shorter than the string is the string: it counts once
    tokens = codes.withColumn("codes", F.explode(F.array_distinct(cut)))
    band = F.lit(BANDS[0])
    for least in BANDS[1:]:
        band = F.when(F.size("codes") >= least, F.lit(least)).otherwise(band)
    nats = F.least(F.lit(200), F.greatest(F.lit(0), F.floor(models.score(F.col("codes")))))
    found = tokens.groupBy("random", band.alias("band"), nats.alias("nats")).agg(
        F.sum("count").alias("n")
    ).collect()  # at most 201 scores per band and label

    def best(bands: tuple[int, ...]) -> tuple[float, float, float] | None:
        own = [r for r in found if r["band"] in bands]
        n = {k: sum(r["n"] for r in own if r["random"] is k) for k in (True, False)}
        if n[False] < ENOUGH or not n[True]:
            return None

        def share(k: bool, t: int) -> float:
            return sum(r["n"] for r in own if r["random"] is k and r["nats"] >= t) / n[k]

        return min(
            (1 - share(True, t) + FALSE_COST * share(False, t), t, share(True, t), share(False, t))
            for t in range(LOWEST, 201)
        )[1:]

    whole = best(BANDS) or (LOWEST, math.nan, math.nan)
    chosen = [(b, *(best((b,)) or whole)) for b in BANDS]
    return replace(
        models, thresholds=tuple((b, float(t)) for b, t, _, _ in chosen),
        measured=tuple((b, recall, false) for b, _, recall, false in chosen),
    )


def train(docs: DataFrame, id_col: str, text_col: str, train_docs: int = TRAIN_DOCS):
    """Fit both models on a bounded sample: about ``train_docs`` documents, by a hash of the row.

    Values inside pattern spans are samples of random strings; tokens of the texts between the
    spans are samples of ordinary identifiers. Transition counts (place 0 is the token's begin)
    are smoothed towards the frequency of the second character, and those by one. A sample
    without random strings gives a uniform random model. With ``ENOUGH`` ordinary tokens the
    thresholds are chosen from the samples; with fewer, ``THRESHOLD`` holds for the ratio alone.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    part = math.ceil(SLOTS * min(1.0, train_docs / max(1, docs.count())))
    sample = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(SLOTS)) < part)
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = base_spans(text)
    values = F.flatten(F.array(*[F.transform(s, lambda m: m["value"]) for s in spans.values()]))
    rest = text
    for pattern, _, _ in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(SAMPLE), F.lit(0))
    labelled = sample.select(
        F.explode(F.array(
            F.struct(F.lit(True).alias("random"), values.alias("tokens")),
            F.struct(F.lit(False).alias("random"), words.alias("tokens")),
        )).alias("s")
    ).select("s.random", F.explode("s.tokens").alias("token"))
    chained = stored(labelled.groupBy("random", "token").count().select(
        "random", "count", F.concat(F.array(F.lit(0)), _codes(F.col("token"))).alias("c")
    ), "samples")
    pairs = chained.select(
        "random", "count",
        F.explode(F.arrays_zip(
            F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c")).alias("b")
        )).alias("p"),
    )
    counts = pairs.groupBy("random", "p.a", "p.b").agg(F.sum("count").alias("n")).collect()
    n = {(r["random"], r["a"], r["b"]): r["n"] for r in counts}  # at most 2 * SIZE ** 2 entries
    places = range(SIZE)

    def transitions(random: bool) -> list[list[float]]:
        row = [sum(n.get((random, a, b), 0) for b in places) for a in places]
        column = [sum(n.get((random, a, b), 0) for a in places) for b in places]
        alone = [(c + 1) / (sum(column) + SIZE) for c in column]
        return [
            [(n.get((random, a, b), 0) + SIZE * alone[b]) / (row[a] + SIZE) for b in places]
            for a in places
        ]

    ordinary, strings = transitions(False), transitions(True)
    ratios = [
        round(math.log(strings[a][b] / ordinary[a][b]), 6) for a in places for b in places
    ]
    begun = sum(count for (random, a, _), count in n.items() if not random and a == 0)
    if begun < ENOUGH:
        return MarkovModels(tuple(ratios))
    surprise = [round(-math.log(p), 6) for row in ordinary for p in row]
    return calibrated(MarkovModels(tuple(ratios), tuple(surprise)), chained)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    models: MarkovModels | None = None,
    threshold: float | None = None,
    carry: tuple[str, ...] = (),
    mark: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_markov``,
    ``base_sha256``, ``spans``, and ``found`` (array<struct<start, kind_no, end, kind>>).

    Spans are whole matches, start to end (exclusive) in code points, ordered by start, then
    kind. A Markov span is a run of 12 or more of ``A-Za-z0-9+/_=-`` that no pattern span
    covers as a whole and scores ``threshold`` or more; left out, the models' threshold for its length. Tokens of
    ``FEW_LETTERS`` or fewer different characters (rules of ``-`` or ``=``) are none. A null text counts as empty: no spans, the digest of
    an empty list. Repeated rows and null ids come back as they are; an empty table gives an
    empty result; other columns than the id and ``carry`` are not kept. No shuffle after training.
    With ``mark`` the column ``masked`` holds the text (a null one as empty) with every span replaced
    by it, overlapping spans as one. A long text is scanned in pieces, so the work grows with it.
    """
    models = models or train(docs, id_col, text_col)
    kept = [F.col(f"`{c}`") for c in carry]
    read = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.struct(F.lit(0), *kept).alias("_carry"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
    )
    least = lambda t: (
        models.threshold(F.length(t["value"])) if threshold is None else F.lit(float(threshold))
    )

    def numbered(kind: str, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"),
                m["end"].alias("end"), F.lit(kind).alias("kind"),
            ),
        )

    def spans_of(piece: Column) -> Column:
        base = F.concat(*[numbered(k, c) for k, c in base_spans(piece).items()])

        def both(spans: Column) -> Column:
            random = F.filter(
                matches(piece, TOKEN),
                lambda t: ~F.exists(
                    spans, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])
                ) & (F.size(F.array_distinct(F.split(t["value"], ""))) > FEW_LETTERS)
                & (models.score(_codes(t["value"])) >= least(t)),
            )
            return F.sort_array(F.concat(spans, numbered("markov", random)))

        return bound(base, both)

    scanned = F.transform(pieces(F.col("_text")), lambda p: F.struct(
        F.length(p).alias("n"), spans_of(p).alias("spans"), p.alias("piece")
    ))

    def joined(parts: Column) -> Column:
        starts = starts_of(F.transform(parts, lambda p: p["n"]))
        moved = lambda at: lambda m: F.struct(
            (m["start"] + at).alias("start"), m["kind_no"].alias("kind_no"),
            (m["end"] + at).alias("end"), m["kind"].alias("kind"),
        )
        found = F.flatten(F.transform(
            F.arrays_zip(parts.alias("p"), starts.alias("at")),
            lambda x: F.transform(x["p"]["spans"], moved(x["at"])),
        ))
        out = [found.alias("found")]
        if mark is not None:
            out.append(F.array_join(F.transform(
                parts, lambda p: _masked_piece(p["piece"], p["spans"], mark)
            ), "").alias("masked"))
        return F.struct(*out)

    scored = read.select("_id", "_carry", bound(scanned, joined).alias("_found"))
    found = F.col("_found.found")
    count = lambda kind: F.size(F.filter(found, lambda m: m["kind"] == kind))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ","
    )
    return scored.select(
        F.col("_id").alias(id_col), *[F.col(f"_carry.`{c}`") for c in carry],
        *[count(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter(found, lambda m: m["kind"] != "markov")), 256)
        .alias("base_sha256"),
        listed(found).alias("spans"), found.alias("found"),
        *([F.col("_found.masked").alias("masked")] if mark is not None else []),
    )


def _masked_piece(text: Column, found: Column, mark: str) -> Column:
    walked = F.aggregate(
        found,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, m: F.struct(
            F.when(
                m["start"] >= acc["at"],
                F.concat(
                    acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.lit(mark)
                ),
            ).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], m["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(found) > 0, walked).otherwise(text)


def masked(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one.

    Every piece of the text takes the spans that begin in it; ``scan(mark=...)`` does so while it
    has them at hand.
    """
    def each(parts: Column) -> Column:
        zipped = F.arrays_zip(
            parts.alias("p"), starts_of(F.transform(parts, lambda p: F.length(p))).alias("at")
        )
        return F.array_join(F.transform(zipped, lambda x: _masked_piece(
            x["p"],
            F.transform(
                F.filter(found, lambda m: (m["start"] >= x["at"])
                         & (m["start"] < x["at"] + F.length(x["p"]))),
                lambda m: F.struct((m["start"] - x["at"]).alias("start"),
                                   (m["end"] - x["at"]).alias("end")),
            ),
            mark,
        )), "")

    return F.when(F.size(found) > 0, bound(pieces(text), each)).otherwise(text)
