"""Embeddings, shards, mixing and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.llm import mixing, sharding
from caudal.llm.embedding_dedup import embedding_groups

pytest.importorskip("public_tokenizers")


# ---- embeddings ---------------------------------------------------------------------


def links_by_hand(rows, cosine):
    """rows: (id, vector, label). Links and least reachable id of every row, by index."""
    good = [i for i, (_, v, label) in enumerate(rows)
            if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = defaultdict(set)
    for i in good:
        for j in good:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v) / np.abs(v).max() for v in (a[1], b[1]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    near[i].add(j)
    out = {}
    for i in range(len(rows)):
        reach, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in reach:
                reach.add(k)
                todo += near[k]
        ids = [rows[k][0] for k in reach if rows[k][0] is not None]
        out[i] = (len(near[i]), min(ids, default=None))
    return out


def vectors(dim, n, spread, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.standard_normal(dim)
        rows.append((i, base.tolist(), i % 3))
        if i % 3 == 0:
            rows.append((1000 + i, (base + rng.standard_normal(dim) * spread).tolist(), i % 3))
        if i % 20 == 0:
            rows.append((2000 + i, base.tolist(), i % 3))
    return rows


def test_embedding_groups_on_odd_rows(spark):
    rows = vectors(32, 150, 0.02)
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 32, 1), (5003, [float("nan")] * 32, 1),
             (5004, [None] * 32, 1), (5005, [1.0] * 32, None), (5006, [1.0, 2.0], 1),
             (5007, [1.0, 2.0], 1), (5008, [1e300] * 32, 2), (5009, [1e300] * 32, 2),
             (5010, [float("inf")] * 32, 1), (None, rows[0][1], rows[0][2]), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit("clash") for c in ("row", "id", "root", "n_links", "weight")})
    expected = links_by_hand(rows, 0.93)
    want = Counter((rows[i][0], n, c, rows[i][0] is not None and rows[i][0] == c)
                   for i, (n, c) in expected.items())
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"])
                  for r in embedding_groups(df).collect())
    assert got == want
    assert embedding_groups(df.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("dim, spread", [(64, 0.2), (16, 0.25)])
def test_recall_of_links_near_the_bound(spark, dim, spread):
    rows = vectors(dim, 500, spread, seed=1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    truth = {rows[i][0]: n for i, (n, _) in links_by_hand(
        [(i, np.array(v, np.float32).astype(float).tolist(), k) for i, v, k in rows], 0.93).items()}
    got = {r["vec_id"]: r["n_links"] for r in embedding_groups(df).collect()}
    assert all(got[i] <= n for i, n in truth.items())
    assert sum(got.values()) >= 0.9 * sum(truth.values()) > 0


def test_a_bucket_larger_than_a_block(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 1e-3).tolist(), 0) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_groups(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(699, 0)}


# ---- shards -------------------------------------------------------------------------


def check_law(rows, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(1)
    texts = [f"text {i}" for i in range(300)] + [f"copy {rng.randint(0, 25)}" for _ in range(120)]
    texts += [None, None, "", "", "x" * 100_000]
    rng.shuffle(texts)
    rows = [(i if i % 50 else None, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shards(df).collect()
    assert len(got) == len(rows)
    check_law(got, 8)
    places = defaultdict(set)
    for r in got:
        if r["n_copies"] > 1:
            places[r["text_crc32"], r["size"]].add(r["shard"])
    assert places and all(len(p) == 1 for p in places.values())
    assert {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)


def test_a_group_larger_than_a_shard(spark):
    df = spark.range(2000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) text")
    got = sharding.shards(df).collect()
    check_law(got, 8)
    hot = Counter(r["shard"] for r in got if r["n_copies"] > 1)
    assert len(hot) == 3  # 667 rows in shards of 250


@pytest.mark.parametrize("rows, size", [(1200, 2), (1200, 3), (2000, 5)])
def test_no_group_that_fits_is_cut(spark, rows, size):
    groups = rows // size
    df = spark.range(rows).selectExpr("id doc_id", f"concat('t', id % {groups}) text")
    got = sharding.shards(df).collect()
    check_law(got, 8)
    places = defaultdict(set)
    for r in got:
        places[r["doc_id"] % groups].add(r["shard"])
    assert len(places) == groups and all(len(p) == 1 for p in places.values())


def test_few_groups_are_cut_beside_a_hot_one(spark):
    df = spark.range(3000).selectExpr(
        "id doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 500)) text")
    got = sharding.shards(df).collect()
    check_law(got, 8)
    places = defaultdict(set)
    for r in got:
        if r["doc_id"] % 3:
            places[r["doc_id"] % 500].add(r["shard"])
    assert sum(len(p) > 1 for p in places.values()) <= 7


def test_few_or_no_rows(spark):
    df = spark.range(3).selectExpr("id doc_id", "'same' text")
    check_law(sharding.shards(df).collect(), 8)
    assert sharding.shards(df.filter("doc_id < 0")).count() == 0


def test_exchange_keeps_the_counts():
    rng = random.Random(3)
    for _ in range(50):
        wishes = {(i, j): rng.randint(0, 9) for i in range(4) for j in range(4) if i != j}
        free = {i: rng.randint(0, 6) for i in range(4)}
        linked, fill = sharding.exchange(wishes, free)
        flow = Counter()
        for moves in (linked, fill):
            for (i, j), n in moves.items():
                flow[i] -= n
                flow[j] += n
        assert not any(flow.values())
        assert all(n <= wishes[pair] for pair, n in linked.items())
        assert all(sum(n for (i, _), n in fill.items() if i == s) <= free[s] for s in free)


# ---- mixing -------------------------------------------------------------------------


def mixed(df, targets, **options):
    dims = {d: F.col(d) for d in targets}
    return mixing.mix(df, targets, dims, **options)


def corpus(spark, n=2000):
    return spark.range(n).selectExpr(
        "id doc_id", "repeat('w ', cast(1 + id % 7 as int)) text",
        "if(id % 3 = 0, 'hot', concat('s', id % 5)) source", "if(id % 10 < 7, 'en', 'de') lang",
        "'x' weight")


def test_marginals_meet_their_targets(spark):
    targets = {"source": 0.0, "lang": {"en": 0.4, "de": 0.6}}
    rows = mixed(corpus(spark), targets).collect()
    total = sum(r["weight"] * r["n_tokens"] for r in rows)
    for dim, values in (("lang", {"en": 0.4, "de": 0.6}),
                        ("source", {s: 1 / 6 for s in ("hot", "s0", "s1", "s2", "s3", "s4")})):
        got = defaultdict(float)
        for r in rows:
            got[r[dim]] += r["weight"] * r["n_tokens"] / total
        assert got == pytest.approx(values, abs=1e-6)
    assert max(r["probability"] for r in rows) == pytest.approx(1)


def test_raking_equals_brute_force(spark):
    targets = {"source": 0.5, "lang": {"en": 0.4, "de": 0.6}}
    rows = mixed(corpus(spark), targets).collect()
    cells = defaultdict(float)
    for r in rows:
        cells[r["source"], r["lang"]] += r["n_tokens"]
    total = sum(cells.values())
    root = defaultdict(float)
    for (s, _), n in cells.items():
        root[s] += n
    norm = sum(v**0.5 for v in root.values())
    goals = [{s: v**0.5 / norm for s, v in root.items()}, {"en": 0.4, "de": 0.6}]
    weights = dict(cells)
    for _ in range(200):
        for k, goal in enumerate(goals):
            have = defaultdict(float)
            for cell, w in weights.items():
                have[cell[k]] += w
            weights = {c: w * goal[c[k]] * total / have[c[k]] for c, w in weights.items()}
    for r in rows:
        cell = r["source"], r["lang"]
        assert r["weight"] == pytest.approx(weights[cell] / cells[cell], rel=1e-6)


def test_samples_follow_their_probabilities(spark):
    df = corpus(spark, 6000)
    targets = {"source": 0.0, "lang": 1.0}
    rows = mixed(df, targets, keep=0.5).collect()
    expected = sum(r["probability"] * r["n_tokens"] for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    assert expected == pytest.approx(0.5 * total, rel=1e-3)
    assert sum(r["n_tokens"] for r in rows if r["sampled"]) == pytest.approx(expected, rel=0.05)
    again = {r["doc_id"]: r["sampled"] for r in mixed(df.repartition(5), targets, keep=0.5).collect()}
    assert again == {r["doc_id"]: r["sampled"] for r in rows}


def hot_and_rare(spark, rare):
    """A hot source, 20 plain ones, and one with ``rare`` documents, all of 10 words."""
    return spark.range(3000 + rare).selectExpr(
        "id doc_id", "repeat('w ', 10) text", "'en' lang",
        f"if(id < {rare}, 'rare', if(id % 3 = 0, 'hot', concat('s', id % 20))) source")


@pytest.mark.parametrize("rare", [1, 100])
def test_a_rare_source_does_not_thin_the_rest(spark, tmp_path, rare):
    import corpus_pipeline
    from caudal.llm.queries import MIXING_KEEP, op8_mixing

    hot_and_rare(spark, rare).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op8_mixing(spark, str(tmp_path)).collect()
    total = sum(r["n_tokens"] for r in rows)
    kept = sum(r["probability"] * r["n_tokens"] for r in rows)
    assert kept == pytest.approx(MIXING_KEEP * total, rel=1e-3)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    drawn = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in rows if r["sampled"]}


def test_a_share_is_kept_beside_a_cell_without_weight(spark):
    df = spark.range(3000).selectExpr(
        "id doc_id", "'w w' text", "'en' lang",
        "if(id % 3 = 0, 'none', if(id % 30 = 1, 'few', 'many')) source")
    targets = {"source": {"none": 0.0, "few": 0.9, "many": 0.1}, "lang": 1.0}
    rows = mixed(df, targets, keep=0.6).collect()
    kept = sum(r["probability"] for r in rows) / len(rows)
    assert kept == pytest.approx(0.6, rel=1e-3)
    assert not any(r["sampled"] for r in rows if r["source"] == "none")


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None, "en"), (2, "", "a", None), (3, "x y", None, "en"), (3, "x y", None, "en"),
            (None, "z", "a", "de"), (4, "w " * 20_000, "b", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixed(df, {"source": 0.5, "lang": 1.0}).collect()
    assert len(got) == 6 and all(0 <= r["probability"] <= 1 for r in got)
    assert len({r["sampled"] for r in got if r["doc_id"] == 3}) == 1
    assert mixed(df.filter("doc_id < 0"), {"source": 0.5, "lang": 1.0}).count() == 0


# ---- pipeline -----------------------------------------------------------------------


def test_pipeline_equals_its_operators_one_by_one(spark):
    import re

    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers
    from tests.llm.test_text_operators import (
        fingerprint, groups_by_hand, measured_by_hand, spans_by_hand,
    )

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    extra = docs.limit(1).withColumns({"doc_id": F.lit(900).cast("long"), "text": F.lit(None)})
    docs = docs.unionByName(extra).unionByName(docs.limit(2))
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["quality", "near_dedup", "secrets", "mixing", "encoding"]

    def fails(text):
        n, chars, symbols, dup, repeat = measured_by_hand(text)
        lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")])
        return (n < 10 or 100 * repeat > 20 * n or 100 * symbols > 30 * n
                or (text or "").count("!") > n or 100 * dup > 60 * lines
                or chars > 40 * n or 10 * chars < 12 * n)

    clean = stages["quality"](spark, docs, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(
        x for x in rows if not fails(x[1]))
    assert clean.columns == docs.columns

    single = stages["near_dedup"](spark, clean, sf_dir)
    prints = sorted({(d, t) for d, t in rows if not fails(t)})
    groups = groups_by_hand([(d, fingerprint(t, 4)) for d, t in prints], 4)
    kept = sorted(d for (d, _), g in zip(prints, groups, strict=True) if d == g)
    assert sorted(r["doc_id"] for r in single.collect()) == kept

    safe = {r["doc_id"]: r for r in stages["secrets"](spark, single, sf_dir).collect()}
    texts = dict(rows)
    for d, r in safe.items():
        spans = spans_by_hand(texts[d])
        assert ("[secret]" in r["text"]) >= bool(spans)
        assert r["n_chars"] == len(r["text"]) or not spans
        assert not spans_by_hand(re.sub(r"\[secret\]", " ", r["text"]))

    drawn = stages["mixing"](spark, single, sf_dir)
    assert drawn.columns == docs.columns and 0 < drawn.count() <= single.count()

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["encoding"](spark, drawn, sf_dir).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "ids", "decoded"} <= set(out.columns)


def drawn_by_hand(spark, rows, keep):
    """rows: (id, text, source, lang). Ids that raked probabilities and the hash draw keep."""
    from caudal.llm.queries import MIXING_TARGETS

    def kind(t):
        return ("table" if " | " in t else "licence" if "icense" in t
                else "contact" if "@" in t else "prose")

    cell_of = {i: (s, lang, kind(t)) for i, t, s, lang in rows}
    cells = Counter()
    for i, t, _, _ in rows:
        cells[cell_of[i]] += len(t.split())
    total = sum(cells.values())
    goals = []
    for k, target in enumerate(MIXING_TARGETS.values()):
        have = Counter()
        for c, n in cells.items():
            have[c[k]] += n
        raw = {v: target.get(v, n / total) if isinstance(target, dict) else n**target
               for v, n in have.items()}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    raked = dict(cells)
    for _ in range(300):
        for k, goal in enumerate(goals):
            have = defaultdict(float)
            for c, w in raked.items():
                have[c[k]] += w
            raked = {c: w * goal[c[k]] * total / have[c[k]] for c, w in raked.items()}
    weight = {c: raked[c] / n for c, n in cells.items()}
    low, high = 0.0, 1 / min(weight.values())
    for _ in range(100):
        mid = (low + high) / 2
        kept = sum(min(1, weight[c] * mid) * n for c, n in cells.items())
        low, high = (mid, high) if kept < keep * total else (low, mid)
    ids = spark.createDataFrame([(i,) for i in cell_of], "i long")
    draws = {r["i"]: (r["h"] % 2**64 >> 11) / 2**53
             for r in ids.select("i", F.xxhash64("i", F.lit(8)).alias("h")).collect()}
    return {i for i in cell_of if draws[i] < min(1, weight[cell_of[i]] * high)}


def test_mixing_stage_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline

    rng = random.Random(21)
    rows = [(i, " ".join(["w"] * rng.randint(5, 30) + [rng.choice(["| x", "x@y", "License", "z"])]),
             "rare" if i == 7 else "hot" if i % 3 == 0 else f"s{i % 8}", rng.choice(["en", "de"]))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"] for r in corpus_pipeline.mixing(spark, df, "").collect()}
    assert got == drawn_by_hand(spark, rows, 0.5)
    assert 0.4 * len(rows) < len(got) < 0.6 * len(rows)
