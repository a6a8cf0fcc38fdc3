"""Components, the n-gram join, vector searches, chat repair and the pipeline."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import chat
from quillon.llm.ann import inner_product_search
from quillon.llm.components import connected_components
from quillon.llm.ngram_join import SignatureTree, _bitmap, dual_traversal, ngram_jaccard_join, shingle_hashes
from quillon.llm.threshold_search import threshold_search, top_k


def find(parent, x):
    while parent.get(x, x) != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1030)] + [(7, 7)]
    parent = {}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 5)], "src long, dst long")
    got = {r["id"]: r["root"] for r in connected_components(df).collect()}
    assert got == {v: find(parent, v) for e in edges for v in e}
    assert connected_components(df.where("false")).count() == 0


def brute(rows, n, num, den):
    sets = []
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    parent = {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        k = len(x & y)
        if x and y and den * k >= num * (len(x) + len(y) - k):
            u, v = find(parent, a), find(parent, b)
            if u != v:
                parent[max(u, v)] = min(u, v)
    return {d: (len(x), find(parent, d)) for d, x in sets}


def near_copies(n_docs=90, seed=1):
    """A family of edited copies (more than a block), smaller families, and unrelated texts that
    share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=80)
    passage = rng.choices(words, k=30)
    rows = []
    for i in range(n_docs):
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        elif i % 3 == 1:
            w = rng.choices(words, k=rng.randrange(1, 120)) + passage
        else:
            w = rng.choices(words, k=rng.randrange(0, 8))
        rows.append((i, " ".join(w)))
    return rows


def test_ngram_join_equals_brute_force(spark, awkward, nothing):
    rows = near_copies() + [(1000 + r["doc_id"], r["text"]) for r in awkward.where("doc_id is not null").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(1))
    for n, num, den, block in ((4, 85, 100, 8), (5, 80, 100, 400)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(df, n, num, den, block).collect()}
        assert got == brute(rows, n, num, den)
    assert ngram_jaccard_join(nothing).count() == 0
    odd = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(awkward).collect()}
    assert odd[None] is None
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(1, near), (None, near + " more"), (None, near + " more"), (7, near + " other"), (None, "alone in here now")]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["component_id"] or 0) for r in got) == [0, 1, 1, 1, 1]
    twice = spark.createDataFrame([(5, near), (5, "quite another text than that"), (6, near + " x"), (7, "quite another text than that")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in ngram_jaccard_join(twice).collect()) == [5, 5, 5, 5]
    assert odd[6] == odd[7] == 5 and odd[9_007_199_254_740_993] == 9_007_199_254_740_993


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_dual_traversal_loses_no_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(48, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])) for _ in range(60)]
    maps = [_bitmap(s) for s in sets]
    width = min(map(len, maps))
    keep = [i for i, m in enumerate(maps) if len(m) == width]
    sizes = np.array([len(sets[i]) for i in keep])
    tree = SignatureTree(sizes, np.stack([maps[i] for i in keep]))
    every = np.ones(len(keep), dtype=bool)
    found = {(int(x), int(y)) for a, b in dual_traversal(tree, every, every, 85, 100) for x, y in zip(a, b, strict=True)}
    for x, y in itertools.combinations(range(len(keep)), 2):
        k = len(np.intersect1d(sets[keep[x]], sets[keep[y]]))
        if 100 * k >= 85 * (sizes[x] + sizes[y] - k):
            assert (x, y) in found


def test_shingles_split_at_ascii_space_only():
    assert len(shingle_hashes("a\xa0b c\x0bd e", 2)) == 3
    assert len(shingle_hashes(None, 4)) == len(shingle_hashes(" \n", 4)) == 0 and len(shingle_hashes("A b", 4)) == 1
    assert (shingle_hashes("A B c d É", 4) == shingle_hashes("a b C D É", 4)).all()


def vectors(spark, n=700, d=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[5] = x[4]
    rows = [(i, [float(v) for v in z]) for i, z in enumerate(x)]
    odd = [(n, None), (n + 1, []), (n + 2, [float("nan")] * d), (n + 3, [None] * d), (n + 4, [0.0] * d), (n + 5, [1.0] * 3), (None, [1.0] * d)]
    return x.astype(float), spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("score", F.lit(1))


def test_inner_product_search_recall_and_scores(spark):
    x, df = vectors(spark)
    got = inner_product_search(df, F.col("vec_id") % 20 == 0, k=10, cells=8).toPandas()
    hits = 0
    for q in range(0, 700, 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got["query_id"] == q].sort_values("rank")
        hits += len(set(own["vec_id"]) & set(np.lexsort((np.arange(700), -s))[:10]))
        assert np.allclose(own["score"], x[own["vec_id"]] @ x[q]) and (np.diff(own["score"]) <= 0).all()
    assert hits >= 0.9 * 350 and set(got["query_id"]) == set(range(0, 700, 20))
    few = inner_product_search(df.where("vec_id < 4"), F.col("vec_id") == 0, k=10).collect()
    assert len(few) == 3
    assert inner_product_search(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_threshold_search_is_exact(spark):
    x, df = vectors(spark)
    got = threshold_search(df, F.col("vec_id") % 50 == 0, k=7, candidate_rows=100, query_rows=3).toPandas()
    ids = np.array([*range(700), 704])
    z = np.floor(1024 * np.vstack([x, np.zeros(16)])).astype(np.int64)
    for q in range(0, 700, 50):
        s = z @ z[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:7]
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["vec_id"]) == [ids[i] for i in best] and list(own["score"]) == [s[i] for i in best]
    assert threshold_search(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_threshold_search_beyond_64_bits(spark):
    x = [[1e13, 1e13], [1e13, -1e13], [2e13, 1e13], [1e300, 1e300], [1.7e308, 0.0], [3e-4, 1.0], [1.0, 2.0]]
    df = spark.createDataFrame([*enumerate(x), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    from fractions import Fraction

    z = [[math.floor(Fraction(v) * 1024) for v in row] for row in x]
    rows = [*enumerate(z), (2, [5120, 5120])]
    asked = dict(enumerate(z)) | {2: [5120, 5120]}
    for size in (1, 100):
        got = threshold_search(df, F.lit(True), k=10, candidate_rows=size).collect()
        for q, y in asked.items():
            scores = sorted((-(a * y[0] + b * y[1]), i) for i, (a, b) in rows if i != q)
            own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["vec_id"] for r in own] == [i for _, i in scores]
            assert [r["score"] for r in own] == [min(max(-s, -(2**63 - 1)), 2**63 - 1) for s, _ in scores]


def test_outliers_get_their_neighbours(spark):
    """Five rows far from two clusters have cells of their own; the search goes on to others."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(150, 8)) * 0.01 + 1, rng.normal(size=(145, 8)) * 0.01 - 1, 50 * np.eye(8)[:5]])
    df = spark.createDataFrame([(i, [float(v) for v in z]) for i, z in enumerate(x)], "vec_id long, embedding array<double>")
    got = inner_product_search(df, F.col("vec_id") >= 290).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == dict.fromkeys(range(290, 300), 20)
    few = inner_product_search(df, F.col("vec_id") == 0, k=400).collect()
    assert len(few) == 299 and len({r["vec_id"] for r in few}) == 299


def test_recall_at_the_registered_settings(spark):
    from quillon.llm.queries import op2_inner_product_ann

    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    got = op2_inner_product_ann(spark, folder).toPandas().groupby("query_id")["vec_id"].agg(set)
    asked, hits = np.flatnonzero(ids % 20 == 0), 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hits >= 0.9 * 20 * len(asked), hits / 20 / len(asked)


def test_searches_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.9, 0.0]), (3, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search in (inner_product_search, threshold_search):
        got = sorted(tuple(r) for r in search(df, F.col("vec_id") < 3, k=3).select("query_id", "rank", "vec_id").collect())
        assert got == [(1, 1, 2), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 1), (2, 3, 3)]


def test_threshold_algorithm_stops_early():
    x = np.zeros((4000, 4))
    x[:20] = 100 - np.arange(20)[:, None]
    rows, scores = top_k(x, np.arange(4000), np.argsort(-x, axis=0, kind="stable"), np.ones(4), -1, 5)
    assert list(rows) == [0, 1, 2, 3, 4] and scores[0] == 400


def legal(roles):
    s = chat.START
    for r in roles:
        if chat.ROLES.index(r) not in chat.NEXT[s]:
            return False
        s = chat.ROLES.index(r)
    return s in chat.LAST


def brute_cost(roles):
    """Least cost over all legal sequences of turns and all ways to lay the given turns on them in
    order: a turn of another role costs 2, each further turn on a place 1, an empty place 3."""
    best = 10**9
    for system in (0, 1):
        for m in range(1, 2 * len(roles) + 2):
            legal = ["system"] * system + [("user", "assistant")[i % 2] for i in range(m)]
            for places in itertools.combinations_with_replacement(range(len(legal)), len(roles)):
                own = sum(2 * (role != legal[p]) for role, p in zip(roles, places, strict=True))
                used = len(set(places))
                best = min(best, own + (len(roles) - used) + 3 * (len(legal) - used))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*chat.ROLES, None, "tool"]), min_size=1, max_size=5))
def test_repairs_cost_the_least_of_all(roles):
    costs, _ = chat._table(roles, chat.START)
    assert min(c + chat.end_cost(s) for s, c in enumerate(costs[-1])) == brute_cost(roles)


def test_chat_repair(spark):
    talks = {1: ["user", "assistant"], 2: ["assistant", "user"], 3: ["user", "user", "assistant"], 4: ["system", "assistant"], 5: ["user", "system", "assistant"], 6: [None, "tool"], 7: ["system"], 8: ["user", "assistant", "user", "user", None, "system"]}
    rows = [(c, i, r, f"t{i}" if i != 1 else None) for c, roles in talks.items() for i, r in enumerate(roles)] + [(None, None, "user", "x"), (9, 0, "user", "same"), (9, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(9))
    whole = chat.repair_chats(df).collect()
    cut = chat.repair_chats(df, segment_turns=3).collect()
    assert len(whole) == len(cut) == len(rows)
    for got in (whole, cut):
        for c, roles in talks.items():
            own = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["turn"])
            assert own[0]["repair_cost"] == brute_cost(roles)
            text = "".join(r["rendered"] for r in own)
            shown = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end")]
            assert legal(shown) and text.count("<|end|>") == len(shown) and text.endswith("<|end|>\n")
            assert all(f"t{i}" in text for i in range(len(roles)) if i != 1)
    assert [r["out_role"] for r in whole if r["conv_id"] == 1] == ["user", "assistant"]
    assert chat.whole_chats(chat.repair_chats(df)).where("conv_id = 9").first()["text"] == "<|user|>\nsame\nsame<|end|>\n"
    assert chat.repair_chats(df.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder, at, counts = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    names = at.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, folder).write.parquet(str(tmp_path / str(i)))
        at = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(at.count())
        if i < 4:
            assert at.columns == names
    toxic = {r[0] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    left = {r[0] for r in spark.read.parquet(str(tmp_path / "0")).select("doc_id").collect()}
    assert len(toxic & left) <= 0.2 * len(toxic) and counts[0] >= 200 - 2 * len(toxic)
    assert counts[0] >= counts[1] == counts[2] >= counts[3]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "2")).collect()]
    roots = brute(rows, 5, 80, 100)
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "3")).select("doc_id").collect()} == {d for d, (_, c) in roots.items() if c == d}
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, at.collect()))


def test_inner_product_search_with_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    hot = rng.permutation(3000)[:1000]
    x[hot] = x[hot[0]]
    asked = [*map(int, hot[:10]), *range(2990, 3000)]
    df = spark.createDataFrame([(i, [float(v) for v in z]) for i, z in enumerate(x)], "vec_id long, embedding array<float>")
    got = inner_product_search(df, F.col("vec_id").isin(asked), k=20, cells=4).toPandas()
    y, hits = x.astype(float), 0
    for q in asked:
        s = np.cumsum(y * y[q], axis=1)[:, -1]
        s[q] = -np.inf
        hits += len(set(got[got["query_id"] == q]["vec_id"]) & set(np.lexsort((np.arange(3000), -s))[:20]))
    assert hits >= 0.98 * 20 * len(set(asked)), hits / 20 / len(set(asked))


def test_inner_product_search_where_codes_tell_too_little(spark):
    """Groups of 750 rows whose differences are below the codebook's steps."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(8, 32)), 750, axis=0) + 0.05 * rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(x)], "vec_id long, embedding array<double>")
    got = inner_product_search(df, F.col("vec_id") % 150 == 0, k=20, cells=2).toPandas()
    hits = 0
    for q in range(0, 6000, 150):
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        s[q] = -np.inf
        own = got[got["query_id"] == q].sort_values("rank")
        assert (own["score"].to_numpy() == s[own["vec_id"]]).all()
        hits += len(set(own["vec_id"]) & set(np.lexsort((np.arange(6000), -s))[:20]))
    assert hits >= 0.98 * 20 * 40, hits / 20 / 40


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_take_awkward_documents(spark, awkward, tmp_path, empty):
    """Nulls, empty, blank and very long texts, repeated rows, an empty table, more columns."""
    import corpus_pipeline

    folder = str(tmp_path / "in")
    docs = awkward.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").alias("n_chars"), "n", "score", "root", F.lit("x").alias("_row"))
    docs = docs.where("false") if empty else docs
    awkward.select("doc_id", (F.col("doc_id") == 10).cast("int").alias("toxic")).where("false" if empty else "doc_id <> 3").write.parquet(f"{folder}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        out[name] = made.collect()
        if name != "packing":
            assert made.columns == docs.columns
    if empty:
        assert not any(out.values())
        return
    ids = {k: sorted(str(r["doc_id"]) for r in v) for k, v in out.items()}
    every = sorted(str(r["doc_id"]) for r in docs.collect())
    assert [i for i in every if i != "10"] == [i for i in ids["toxicity"] if i != "10"]
    assert not {"1", "2", "3", "9", "9007199254740993"} & set(ids["language"])
    assert ids["line_dedup"] == every
    assert ids["near_duplicates"] == sorted([*(i for i in every if i not in ("6", "7", "11")), "11"])
    assert set(ids["packing"]) == set(every)


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, tmp_path):
    import corpus_pipeline

    a, c = " ".join(f"w{i}" for i in range(60)), "a clean text of its own that nobody repeats"
    rows = [(1, a), (2, a), (2, c), (3, c + " x y z"), (4, a), (4, a), (None, a), (None, "only here and without an id")]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted([(1, a), (2, c), (3, c + " x y z"), (None, "only here and without an id")], key=str)
