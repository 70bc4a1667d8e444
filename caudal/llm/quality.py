"""Quality rules kept in a bitmask ledger (op 5).

Every rule is evaluated once per document. The ledger holds the measurements and one bit per
failed rule; policies are versioned masks over those bits, so a new policy, or a study of what
each rule removes, reads the ledger and not the texts. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails a document when ``fails`` is true of its measurements."""

    name: str
    fails: str


#: The order fixes the bits; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("exclamations", "100 * n_exclamations > 100 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("word_length", "word_chars > 40 * n_words or 10 * word_chars < 12 * n_words"),
)
BITS = {rule.name: 1 << k for k, rule in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]

#: Versions of the policy: the bits that reject a document.
POLICIES = {
    "base": BASE,
    "2": BASE | BITS["symbols"] | BITS["exclamations"],
    "3": sum(BITS.values()),
}
CURRENT = "3"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_exclamations",
)


def sorted_windows(words: Column, size: Column) -> Column:
    """Every window of five words with its position, equal windows next to each other."""
    return F.sort_array(
        F.transform(
            F.sequence(F.lit(0), size - WINDOW),
            lambda i: F.struct(
                F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("at")
            ),
        )
    )


def repeated_positions(ordered: Column) -> Column:
    """Positions, in order, of the windows that have an equal one."""
    same = lambda i, j: F.get(ordered, i)["w"] == F.get(ordered, j)["w"]
    marked = F.transform(
        ordered,
        lambda x, i: F.when(
            F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
            x["at"],
        ),
    )
    return F.sort_array(F.array_compact(marked))


def covered_words(at: Column) -> Column:
    """Words that lie in the windows at these positions."""
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
        ),
        lambda acc: acc["n"].cast("long"),
    )


def ledger(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, the measurements and ``fail_bits``.

    Words are runs outside ``\\x20`` and ``\\x09-\\x0D``. A null or blank text has none and fails
    ``few_words``. Repeated rows and null ids come back as they are; an empty table gives an
    empty ledger; columns other than the id and ``carry`` are not kept, so their names cannot
    clash. No shuffle.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words, n = F.col("_words"), F.size("_words")
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    kept = [F.col(f"`{c}`") for c in carry]
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(F.lit(0), *kept).alias("_carry"),
                       text.alias("_text"))
    cut = read.select(
        "_id", "_carry",
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", "[^!]+", "")).cast("long").alias("n_exclamations"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = cut.select(
        "_id", "_carry", "_words", "n_symbols", "n_exclamations",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, windows).alias("_windows"),
    )
    # Windows whose hashes all differ differ themselves. Elsewhere the windows are compared.
    alike = F.size(F.array_distinct("_windows")) < F.size("_windows")
    measured = (
        counted.withColumn("_ordered", F.when(alike, sorted_windows(words, n)))
        .withColumn("_at", repeated_positions(F.col("_ordered")))
        .withColumn("n_repeat_words", F.coalesce(covered_words(F.col("_at")), F.lit(0).cast("long")))
    )
    bits = sum(
        (F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)),
        F.lit(0),
    )
    # A filter on the bits must not be pushed below the measurements: it would evaluate the word
    # list anew for every window. Conditions on a non-deterministic column stay where they are.
    settled = F.when(F.monotonically_increasing_id() >= 0, bits.cast("long"))
    return measured.select(
        F.col("_id").alias(id_col), *[F.col(f"_carry.`{c}`") for c in carry],
        *MEASURES, settled.alias("fail_bits"),
    )


def decide(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return book.withColumns(
        {"base_failed": failed(BASE), "kept": ~failed(BASE | POLICIES[policy])}
    )


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: ``rule``, ``n_failed`` (documents that fail it) and
    ``n_alone`` (documents that only this rule rejects, kept again without it).

    Documents are first counted by their bits, at most ``2 ** rules`` groups.
    """
    mask = POLICIES[policy]
    counts = (
        book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    )
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"))
        for name, bit in BITS.items() if bit & mask
    ])
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        counts.select("bits", "count", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(fails, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0))
            .alias("n_alone"),
        )
    )
