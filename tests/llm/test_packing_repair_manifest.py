"""Packing, conversation repair and the Merkle manifest against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.llm import auction, packing
from caudal.llm.conversations import Repair, damaged
from caudal.llm.merkle import folded, leaf_digest, manifest, proof_digest
from caudal.llm.packing import Packing
from caudal.llm.positions import numbered, prefix

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
CLASHES = ("id", "part", "row", "n", "pos", "tree", "digest", "rank", "item", "key", "piece")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


# ---- positions ----------------------------------------------------------------------


def test_positions_are_dense_with_a_hot_group_and_equal_rows(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) g",
                                      "if(id % 2 = 0, null, id) v")
    got = numbered(df, "g", ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["pos"])
        assert [r["pos"] for r in rows] == list(range(len(rows)))
        assert {r["n"] for r in rows} == {len(rows)}
        values = [(r["v"] is not None, r["v"] or 0) for r in rows]
        assert values == sorted(values)


def test_prefix_sums_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr("caudal.llm.positions.FAN", 7)
    df = spark.range(400).selectExpr("id pos", "id % 5 value")
    got = {r["pos"]: r["before"] for r in prefix(df, "pos", "value", "before").collect()}
    assert got == {i: sum(k % 5 for k in range(i)) for i in range(400)}


# ---- packing ------------------------------------------------------------------------


def check_packing(rows, got, window):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE_FILE)
    want = sorted(
        tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows
    )
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append(r)
    assert set(by_seq) == set(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or (at < window and at & (at - 1) == 0)
    return want


def test_packing_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["rate", "risk", "loan.", "Ümlaut", "42"])
                      for _ in range(rng.choice([3, 40, 120, 250]))) for _ in range(120)]
    texts += [None, "", "   ", "<|endoftext|> x", "y\x1cz", "word " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "no id")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    packed = Packing(docs, BPE_FILE, window=256, classes=32)
    got = packed.pieces.collect()
    want = check_packing(rows, got, 256)
    assert int(packed.repeats.sum()) > 0
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE_FILE)
    for i, t in enumerate(texts):
        if i == 7:
            continue
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in by_doc[7]) == 2 * by_doc[7][0]["doc_tokens"]
    sequences = {r["sequence_id"]: r["ids"] for r in packed.sequences().collect()}
    for r in got:
        part = sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(map(len, sequences.values())) == sum(map(len, want))
    assert Packing(docs.filter("doc_id < 0"), BPE_FILE).pieces.count() == 0


def test_least_squares_meets_its_conditions():
    a = packing.combinations(16, 4)
    assert (np.arange(1, 17) @ a == 16).all()
    rng = np.random.default_rng(4)
    for _ in range(5):
        b = rng.random(16)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-8 and np.abs(gain[x > 0]).max() < 1e-8


@pytest.mark.parametrize("shape", ["few", "long", "short", "any"])
def test_repeats_use_no_class_twice_and_leave_enough(shape):
    rng = np.random.default_rng(5)
    counts = {
        "few": np.eye(32, dtype=int)[3], "long": np.where(np.arange(32) > 20, 1000, 0),
        "short": np.where(np.arange(32) < 3, 10_000, 0), "any": rng.integers(0, 5000, 32),
    }[shape]
    a, x = packing.repeats(counts, 8, 4)
    used = a @ x
    assert (used <= counts).all() and (x > 0).all()
    assert (counts - used) @ (np.arange(32) * 8 + 1) >= used.sum() * 7
    taken = defaultdict(list)
    for c, lo, hi, *_ in packing.slots_of(a, x):
        taken[c].append((lo, hi))
    for c, runs in taken.items():
        assert [lo for lo, _ in runs] == [0, *[hi for _, hi in runs[:-1]]]
        assert runs[-1][1] == used[c - 1]


# ---- conversations ------------------------------------------------------------------

NEXT = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit) with the rows it leaves, over all edits, row after row."""
    def added(states):
        for _ in range(4):
            for q, (c, a, o) in list(states.items()):
                role = "assistant" if q == "u" else "user"
                new = (c + 3, a + "I", (*o, (role, "")))
                if (q, role[0]) in NEXT:
                    old = states.get(role[0])
                    states[role[0]] = new if old is None or new[:2] < old[:2] else old
        return states

    states = added({"": (0, "", ())})
    for role, text, fault in rows:
        made = {}

        def put(q, new, made=made):
            if q not in made or new[:2] < made[q][:2]:
                made[q] = new

        for q, (c, a, o) in states.items():
            put(q, (c + 4, a + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            x = 3 if fault == "truncated" else 0
            if role and (q, role[0]) in NEXT:
                put(NEXT[q, role[0]], (c + x, a + "K", (*o, (role, text))))
            other = "assistant" if q == "u" else "user"
            put(other[0], (c + 3 + x, a + "R", (*o, (other, text))))
        states = added(made)
    return min((v for q, v in states.items() if q in ("", "a")), key=lambda v: v[:2])


def repaired(rows):
    by = {}
    for conv, turn, role, text in rows:
        group = by.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        group += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, group in by.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
            f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, told = set(), []
        for _, role, text in group:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not said else "duplicate" if (role, text) in seen
                     else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
            told.append((role, text, fault))
        turns = [t for t, *_ in group if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                      for a, b in zip(group, group[1:], strict=False))
        cost, audit, left = cheapest(told)
        text = "\n".join(f"{r}:{x}" for r, x in left)
        out[conv] = (gaps, *(sum(f == k for *_, f in told)
                             for k in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Hi.", "Ok", "What?", " ", "", "a\n", "Yes! ", None, "\x0b", "é!", "x" * 20_000]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    return [(rng.choice([*range(10), None]), rng.choice([None, *range(-3, 12)]),
             rng.choice(roles), rng.choice([*texts, f"t{rng.randint(0, 50)}."]))
            for _ in range(n)]


@pytest.mark.parametrize("piece_rows", [8192, 5])
def test_repair_of_odd_rows(spark, piece_rows):
    rows = odd_conversations(2, 400)
    df = clashing(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"))
    repair = Repair(damaged(df), gone_col="gone", piece_rows=piece_rows)
    assert {r[0]: tuple(r)[1:] for r in repair.report().collect()} == repaired(rows)
    texts = defaultdict(list)
    for r in sorted(repair.messages().collect(), key=lambda r: (r["piece"], r["at"])):
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = repaired(rows)
    for conv, (*_, digest) in want.items():
        assert hashlib.sha256("\n".join(texts[conv]).encode()).hexdigest() == digest
    assert Repair(damaged(df.filter("turn > 99")), gone_col="gone").report().count() == 0


def test_a_conversation_over_many_pieces(spark):
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 900)}{rng.choice('.? ')}")
            for i in range(1500)] + [(8, 1, "user", "same.")] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Repair(damaged(df), gone_col="gone", piece_rows=64).report().collect()
    assert {r[0]: tuple(r)[1:] for r in got} == repaired(rows)


def test_auction_prices_bound_and_meet_every_arc():
    rng = random.Random(7)
    for _ in range(300):
        codes = bytes(auction.code(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 2, 3]))
                      for _ in range(rng.randint(0, 50)))
        price = auction.settle(codes, auction.END_PRICES, (auction.NOTHING,))
        for node in range(4 * len(codes)):
            for _, cost, step in auction.ARCS[codes[node >> 2]][node & 3]:
                assert price[node] <= cost + price[node + step]
        rows = [(" sua"[c & 3].strip() or "x", str(i), ["", "blank", "duplicate", "truncated"][c >> 2])
                for i, c in enumerate(codes)]
        cost, audit, _ = cheapest(rows)
        letters, state = auction.trace(codes, price, auction.NOTHING)
        assert (price[0], letters + auction.END_LETTERS[state]) == (cost, audit)


def test_auction_steps_grow_with_the_rows(monkeypatch):
    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    rng = random.Random(8)
    steps = []
    for n in (500, 4000):
        codes = [auction.code(rng.choice("suuaax"), rng.choice([0, 0, 1, 2, 3]))
                 for _ in range(n)]
        Counted.reads = 0
        monkeypatch.setattr(auction, "ARCS", Counted(auction.ARCS))
        auction.settle(codes, auction.END_PRICES, (auction.NOTHING,))
        steps.append(Counted.reads / n)
    assert steps[1] < 1.5 * steps[0]


# ---- manifest -----------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes, arity):
    """Root, and for every node the (left, right) others of its runs on the way up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for j in range(len(run)):
                for o in owners[k + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha(*run))
            over.append(sum(owners[k : k + arity], []))
        nodes, owners = up, over
    return nodes[0], paths


def proved(rows, arity=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, sha(*map(field, r))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(climbed([leaf for _, leaf in groups[g]], arity))
    root, tops = climbed([t for t, _ in trees], arity)
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for (r, leaf), path in zip(groups[g], paths, strict=True):
            path = path + top
            out.append((r[0], leaf, subroot, root, sha(*[a + b for a, b in path]), len(path)))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity, levels", [(8, 3), (2, 2), (3, 1)])
def test_manifest_of_odd_rows(spark, arity, levels):
    rng = random.Random(9)
    texts = [None, "", "é" * 9, "Abc\nD", "x" * 50_000]
    rows = [(i, rng.choice(["s1", None, ""]), "en" if i % 2 else rng.choice(["de", None, "", "ü"]),
             rng.choice([i, None]), rng.choice(texts)) for i in range(0, 700, 1)]
    rows += [rows[3], (None, None, None, None, None), (9001, "s", "lone", 1, "one leaf")]
    df = clashing(spark.createDataFrame(
        rows, "doc_id long, source string, lang string, n_chars long, text string"))
    got = manifest(df, arity=arity, levels=levels).withColumns(
        {"p": proof_digest(F.col("proof")), "f": folded(F.col("leaf"), F.col("proof"))}
    ).collect()
    mine = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["p"], len(r["proof"]))
                   for r in got), key=str)
    assert mine == proved(rows, arity)
    assert all(r["f"] == r["root"] for r in got)
    assert manifest(df.filter("doc_id < 0")).count() == 0


def test_a_tampered_leaf_does_not_fold_to_the_root(spark):
    df = spark.range(600).selectExpr("id doc_id", "'s' source", "'en' lang", "id n_chars",
                                     "concat('Text ', id) text")
    other = leaf_digest(*[F.lower("text") if c == "text" else F.col(c)
                          for c in ("doc_id", "source", "lang", "n_chars", "text")])
    got = manifest(df, carry={"other": F.when(F.col("doc_id") % 3 == 0, other)})
    same = folded(F.coalesce("other", "leaf"), F.col("proof")) == F.col("root")
    assert {(r["doc_id"] % 3 == 0, r["v"]) for r in got.select("doc_id", same.alias("v")).collect()
            } == {(True, False), (False, True)}


def test_manifest_stores_every_few_levels_only(spark):
    from caudal.llm.merkle import Tree

    df = spark.range(700).selectExpr("'' tree", "id pos", "700L n", "sha2(string(id), 256) digest",
                                     "id data")
    tree = Tree(df, 8, 3)
    assert [s.selectExpr("sum(size(nodes)) n").first()["n"] for s in tree.stores] == [700, 2]


def test_the_encoder_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE_FILE)
    rng = random.Random(10)
    words = ["don't.", "it's,", "a.b.", "x..", "I.", "s's", "D;", "İ.", "É.", "a\0b", "\0", "é́",
             "ΑΣ", "中文", "3.14", "<|endoftext|>", "Loan", "RATE:", "ll!", "\x1c", "_", "😀"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(0, 30)))
             for _ in range(200)] + ["", "   "]
    monkeypatch.setattr(packing, "MEMO_CHUNKS", 10)
    encoder = packing.Encoder(BPE_FILE)
    for k in range(0, len(texts), 20):
        part = texts[k : k + 20]
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert encoder.encode(part) == want
