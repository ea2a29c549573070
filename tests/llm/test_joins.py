"""The Jaccard join, centroid clustering and ranked search against plain Python and SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from assayer.llm import centroids, jaccard, lexical, queries
from assayer.llm.base import load
from pyspark.sql import functions as F
from test_native import words_of


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def joined(docs):
    """doc_id, n_shingles, component_id by comparing every two sets that share a shingle."""
    sets = [shingle_set(text) for _, text in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, held in enumerate(sets):
        for s in held:
            holders[s].append(i)
    shared = Counter()
    for held in holders.values():
        for k, i in enumerate(held):
            for j in held[k + 1 :]:
                shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            root[top(j)] = top(i)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        ids[top(i)].append(doc_id)
    least = {r: min((d for d in held if d is not None), default=None) for r, held in ids.items()}
    return Counter((doc_id, len(sets[i]), least[top(i)]) for i, (doc_id, _) in enumerate(docs))


def drifting(seed=3):
    """Chains, dense groups, loose groups around shared passages, and documents on both sides of the threshold."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        words = [word() for _ in range(rnd.choice([8, 40, 90]))]
        for _ in range(rnd.choice([2, 6, 14])):
            texts.append(" ".join(words))
            words = words.copy()
            for _ in range(max(1, len(words) // 40)):
                words[rnd.randrange(len(words))] = word()
    base = [word() for _ in range(120)]
    for _ in range(60):
        other = base.copy()
        for _ in range(rnd.randrange(7)):
            other[rnd.randrange(len(other))] = word()
        texts.append(" ".join(other))
    texts += [" ".join([word() for _ in range(25)] + passage + [word() for _ in range(25)]) for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(rnd.randrange(4, 22))]) for _ in range(25)]
    texts += [word() for _ in range(5)] + ["one two", "One  TWO", "a b c d e", "a b c d e f"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i * 3, texts[k]) for i, k in enumerate(order)]


EDGES = [(None, "p q r s t u v"), (None, "P q r s t u v"), (1, None), (1, ""), (4, " \n"), (1, "p q r s t u v w"), (5, "same row"), (5, "same row"), (2, "same row")]


@pytest.mark.parametrize("limits", [None, (1_500, 20, 2)])
def test_join_matches_brute_force(spark, make_docs, monkeypatch, limits):
    docs = drifting() + EDGES
    if limits:  # regions are split, and what stays large is joined in blocks
        for name, value in zip(("REGION_SHINGLES", "REGION_MEMBERS", "SPLITS"), limits, strict=True):
            monkeypatch.setattr(jaccard, name, value)
    assert Counter(map(tuple, jaccard.near_duplicates(make_docs(docs)).collect())) == joined(docs)


def test_splits_that_do_not_pay_are_not_made(spark, make_docs, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    docs = []
    for i in range(120):
        words = base.copy()
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(40)}"
        docs.append((i, " ".join(words)))
    for name, value in (("REGION_MEMBERS", 24), ("SPLITS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    made, dealt, regions, join = [], [], jaccard._regions, jaccard._join_regions
    monkeypatch.setattr(jaccard, "_regions", lambda sets: made.append(regions(sets)) or made[0])
    monkeypatch.setattr(jaccard, "_join_regions", lambda members, sets: dealt.append(members.count()) or join(members, sets))
    assert Counter(map(tuple, jaccard.near_duplicates(make_docs(docs)).collect())) == joined(docs)
    assert sum(dealt) <= 12 * made[0].count()  # each of 16 cells of two splits held nearly all of them before


def test_join_of_the_data(spark, sf_dir):
    docs = [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = queries.op11_jaccard_join(spark, sf_dir)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    expect = joined(docs)
    assert Counter(map(tuple, found.collect())) == expect
    assert any(d != c for d, _, c in expect)


def test_join_without_broadcast(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(jaccard, "is_small", lambda df: False)
    monkeypatch.setattr(jaccard, "FEWEST_COMMON", 2)
    docs = drifting(8)[:150] + EDGES
    assert Counter(map(tuple, jaccard.near_duplicates(make_docs(docs)).collect())) == joined(docs)


def test_shingles_are_shuffled_once(spark):
    held = spark.createDataFrame([(1, 2, 5), (1, 2, 6), (2, 1, 5), (3, 1, 7)], "node long, n long, shingle long")
    counted = jaccard._counted(held)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counted.collect())) == [(1, 2, 5, 2), (2, 1, 5, 2)]


def test_repeated_rows_give_their_set_once(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(7, text), (7, text), (8, text + " more")], "doc_id long, text string")
    wanted = docs.select(F.col("doc_id").alias("node"), "doc_id", F.xxhash64("text").alias("mark")).distinct()
    assert sorted(r["node"] for r in jaccard._sets(docs, wanted).collect()) == [7, 8]


def test_regions_give_every_connection():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        base = rnd.choice(300, 60, replace=False)
        sets = [np.unique(np.where(rnd.random(60) < rnd.choice([0.02, 0.1, 0.3]), rnd.choice(5000, 60), base)).astype(np.int64) for _ in range(40)]
        pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        found = jaccard.Region(sets, [None] * 40).join()
        assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in pairs}
        label = lambda links: _labels(40, links)
        assert label(found) == label(pairs)


def _labels(n, links):
    root = list(range(n))
    for _ in range(n):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_join_of_odd_tables(spark, odd_docs, no_docs):
    rows = jaccard.near_duplicates(odd_docs).collect()
    assert len(rows) == 12 and sorted(r["n_shingles"] for r in rows if r["doc_id"] == 6) == [1, 1, 1]
    assert {r["component_id"] for r in rows if r["n_shingles"] == 0} == {None, 2, 3, 4}
    assert jaccard.near_duplicates(no_docs).count() == 0


def clustered(rows, k=16, rounds=3):
    held = [(v, [math.floor(64 * float(x)) for x in e]) for v, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"1:{'' if v is None else v}".encode()).hexdigest(), x) for v, x in held)[:k]
    middle = [x for _, x in start]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for turn in range(rounds + 1):
        near = [min(range(len(middle)), key=lambda j: (square(x, middle[j]), j)) for _, x in held]
        if turn < rounds:
            groups = defaultdict(list)
            for (_, x), j in zip(held, near, strict=True):
                groups[j].append(x)
            middle = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if groups[j] else middle[j] for j in range(len(middle))]
    return Counter((v, j, square(x, middle[j])) for (v, x), j in zip(held, near, strict=True)), middle


VECTOR = "vec_id long, embedding array<float>, label int"


def test_clusters_match_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([-2, -1, 0, 1, 2]) / 64 for _ in range(64)], 0) for i in range(150)]
    rows += [(1000 + i, [(i % 3) / 64.0] * 64, 0) for i in range(120)]  # many ties and copies
    rows += [(None, [0.5] * 64, 1), (7, [0.25] * 64, None), (7, [0.25] * 64, None), (8, None, 0), (9, [0.1] * 63, 0), (10, [None] + [0.1] * 63, 0)]
    rows += [(11, [float("nan")] + [0.1] * 63, 0), (12, [float("inf")] + [0.1] * 63, 0), (13, [], 0)]
    table = spark.createDataFrame(rows, VECTOR).selectExpr("*", "1 AS CLUSTER", "'v' AS v").repartition(5)
    found, middle = centroids.cluster_vectors(table)
    expect, centres = clustered([(v, e) for v, e, _ in rows])
    assert middle.tolist() == centres
    assert Counter(map(tuple, found.collect())) == expect
    told = centroids.clustering(table).collect()
    whole = Counter()
    for _, j, d in expect.elements():
        whole[j] += d
    assert all(r["cluster_inertia"] == whole[r["cluster"]] and r["inertia"] == sum(whole.values()) for r in told)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest() for r in told)


def test_search_spares_distances_and_keeps_ties():
    rnd = np.random.default_rng(2)
    c0 = rnd.integers(-400, 400, (16, 64))
    x = np.concatenate([c + rnd.integers(-3, 4, (200, 64)) for c in c0] + [(c0[:8] + c0[8:]) // 2])
    c1 = c0 + rnd.integers(-2, 3, c0.shape)
    cluster, upper, lower, _ = centroids.Search(c0).from_nothing(x)
    search = centroids.Search(c1, c0)
    found, *_ = search.again(x, cluster.copy(), upper, lower)
    exact = centroids.squares(x, c1)
    assert (found == exact.argmin(axis=1)).all()
    assert search.scanned < len(x) * 4


def test_clusters_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTOR)
    assert centroids.clustering(none).count() == 0
    few = spark.createDataFrame([(1, [1e30] * 64, 0), (2, [-1e30] * 64, 0)], VECTOR)
    rows = centroids.clustering(few).collect()
    assert len(rows) == 2 and {r["distance"] for r in rows} == {0}


def ranked(docs, items, k=10):
    texts = [(d, words_of(t)) for d, t in docs]
    total, length = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    holders = Counter(t for _, w in texts for t in set(w))
    terms = defaultdict(set)
    for item_id, text in items:
        if item_id is not None:
            terms[item_id] |= set(words_of(text))
    found = []
    for item_id, wanted in terms.items():
        scores = []
        for doc_id, words in texts:
            counts, score = Counter(words), 0
            for t in wanted & counts.keys():
                weight = math.floor(1000 * math.log((2 * total + 2) / (2 * holders[t] + 1)))
                m = 100 - 90 + (90 * len(words) * total) // length
                score += weight * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]):
            found.append((item_id, rank + 1, doc_id, -score))
    return Counter(found)


@pytest.mark.parametrize("small", [True, False])
def test_search_matches_brute_force(spark, make_docs, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lexical, "is_small", lambda df: False)
        monkeypatch.setattr(lexical, "broadcast_if_small", lambda df: df)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcÉ") for _ in range(rnd.choice([1, 1, 2, 3])))
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for i in range(200)]
    docs += [(3, docs[0][1]), (3, docs[0][1]), (None, docs[0][1]), (900, None), (901, ""), (902, "!?"), (903, "a " * 20_000 + "onlyhere")]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(15)]
    items += [(1, "a B c"), (None, "a b"), (50, None), (51, "nobody has this"), (52, "onlyhere ONLYHERE"), (53, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, lexical.search(make_docs(docs).repartition(3), bench).collect())) == ranked(docs, items)


def test_search_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "same row", 2), (None, None, None)], "item_id long, text string, Text int")
    rows = lexical.search(odd_docs, bench).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [6, 6, 6]
    assert lexical.search(no_docs, bench).count() == 0
    assert lexical.search(odd_docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_centroids", "op13_lexical_search"])
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    made = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    expect = made.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(expect)


def test_postings_are_dealt_by_term_and_document(spark, make_docs):
    held = lexical.postings(make_docs([(i, "the cat") for i in range(400)]), {"the"})
    spread = held.where("term IS NOT NULL").groupBy("bucket").agg(F.countDistinct("slice").alias("n")).collect()
    assert len(spread) == 1 and spread[0]["n"] == lexical.SLICES
