from itertools import combinations

import numpy as np
import pytest

from presq.llm.components import components, group_sizes
from presq.llm.lineages import clusters, described
from presq.llm.overlap import linked, similar_pairs
from presq.llm.sets import token_sets
from presq.llm.termcount import marked_terms


def records(seed=0, families=12, each=6):
    """Records that vary around family sets, with copies, a tiny one and one that holds much of everything."""
    rng = np.random.default_rng(seed)
    out = {}
    for f in range(families):
        base = [f"t{f}.{i}" for i in range(30)]
        for k in range(each):
            keep = set(np.array(base)[rng.random(30) < 0.9]) | {f"own{f}.{k}.{i}" for i in range(rng.integers(0, 6))} | {"every"}
            out[f"R{f}-{k}"] = keep
    out["Copy-a"] = set(out["R0-0"])
    out["Copy-b"] = set(out["R0-0"])
    out["tiny1"] = {"solo"}
    out["tiny2"] = {"solo"}
    out["large"] = {f"t{f}.{i}" for f in range(families) for i in range(25)}
    out["large2"] = set(list(sorted(out["large"]))[:-9])
    return out


def rows(spark, sets):
    data = [(r, t, "x") for r, ts in sets.items() for t in sorted(ts)]
    data += data[:40] + [(None, "t", "y"), ("ghost", None, None)]
    return spark.createDataFrame(data, "rec string, term string, count string")


def jaccard(a, b):
    return len(a & b), len(a | b)


@pytest.mark.parametrize("options", [{}, {"subset": 1}, {"small_part": 5}, {"hot_token": 3}, {"small_part": 5, "hot_token": 3}, {"key_rows": 4}, {"small_part": 5, "key_rows": 3}])
def test_similar_pairs(spark, options):
    sets = records()
    got = {(r.id_a, r.id_b) for r in similar_pairs(token_sets(rows(spark, sets)), "7/10", **options).collect()}
    want = set()
    for a, b in combinations(sorted(sets), 2):
        i, u = jaccard(sets[a], sets[b])
        if i * 10 >= 7 * u:
            want.add((a, b))
    assert ("Copy-a", "Copy-b") in want and ("tiny1", "tiny2") in want and ("large", "large2") in want
    assert got == want


def test_links_of_classes(spark):
    sets = records(seed=6, families=5)
    got = {r.id: (r.class_id, r.n_links) for r in linked(token_sets(rows(spark, sets))).collect()}
    near = lambda a, b: 10 * jaccard(sets[a], sets[b])[0] >= 7 * jaccard(sets[a], sets[b])[1]
    assert got == {a: (min(b for b in sets if sets[b] == sets[a]), sum(near(a, b) for b in sets if b != a)) for a in sets}
    assert linked(token_sets(spark.createDataFrame([], "rec string, term string"))).count() == 0


def test_sketch_grows_with_the_cells(spark, monkeypatch):
    import presq.llm.sets as sets

    df = token_sets(spark.createDataFrame([(f"r{i}", f"t{i % 7}") for i in range(70)] + [("r0", "alone")], "rec string, term string"))
    assert len(sets.sketch(df, 10)) == sets.LEAST_COUNTERS and len(sets.sketch(df, 10**6)) == 1 << 18
    monkeypatch.setattr(sets, "MOST_COUNTERS", 1 << 17)
    counters = sets.sketch(df, 10**9)
    assert len(counters) == 1 << 17 and sorted(counters[counters > 0]) == [1] + [sets.level(10)] * 7


def test_pairs_of_two_tables(spark):
    a = token_sets(spark.createDataFrame([("s", "x"), ("s", "y"), ("s", "z")], "rec string, term string"))
    b = token_sets(spark.createDataFrame([(k, t) for k in ("p", "q") for t in "xyz"], "rec string, term string"), kind=1)
    assert {(r.id_a, r.id_b) for r in similar_pairs(a.union(b), "1/2").collect()} == {("p", "s"), ("q", "s")}
    empty = spark.createDataFrame([], "rec string, term string")
    assert similar_pairs(token_sets(empty)).count() == 0


@pytest.mark.parametrize("options", [{}, {"hubs": 1}, {"places": 2}])
def test_clusters(spark, options):
    sets = records()
    # a shared token alone makes no cluster; the large records are near none
    found, _ = clusters(token_sets(rows(spark, sets)), "15/100", **options)
    got = {r.id: r.cluster_id for r in found.collect()}
    root = {}
    for x in sorted(sets):
        root[x] = next((root[y] for y in sorted(root) if jaccard(sets[x], sets[y])[0] * 100 >= 15 * jaccard(sets[x], sets[y])[1]), x)
    assert got == {x: min(y for y in root if root[y] == root[x]) for x in root}
    about = {r.cluster_id: r for r in described(found, 2).collect()}
    assert about["Copy-a"].size == 8 and len(about["Copy-a"].typical) == 2
    assert about["tiny1"].size == 2


def most_typical(sets, members, top):
    """By the sum of cosine similarities to all other members; ties by id."""
    sums = {x: round(sum(len(sets[x] & sets[y]) / (len(sets[x]) * len(sets[y])) ** 0.5 for y in members if y != x), 9) for x in members}
    return sorted(members, key=lambda x: (-sums[x], x))[:top]


@pytest.mark.parametrize("options", [{}, {"hubs": 1, "places": 3}])
def test_typical_members(spark, options):
    sets = records(seed=4, each=8)
    sets |= {f"Copy-{i}": set(sets["R1-3"]) for i in range(4)}
    found, _ = clusters(token_sets(rows(spark, sets)), "15/100", **options)
    found = found.persist()
    about = {r.cluster_id: r for r in described(found, 3).collect()}
    by = {}
    for r in found.collect():
        by.setdefault(r.cluster_id, []).append(r.id)
    assert {len(m) for m in by.values()} >= {8, 10, 12}
    assert {c: (r.size, list(r.typical)) for c, r in about.items()} == {c: (len(m), most_typical(sets, m, 3)) for c, m in by.items()}


def test_the_embedding_decides(spark, monkeypatch):
    """Groups drawn by chance give other clusters: nothing after k-means finds out who belongs together."""
    import presq.llm.lineages as lineages
    from pyspark.sql import functions as F

    sets = records(seed=2, families=10, each=9)
    want, report = {x: min(y for y in sets if jaccard(sets[x], sets[y])[0] * 100 >= 15 * jaccard(sets[x], sets[y])[1]) for x in sets}, []
    found, _ = clusters(token_sets(rows(spark, sets)), "15/100", affinity=False, report=report)
    assert {r.id: r.cluster_id for r in found.collect()} == want
    assert sum(r["joined"] for r in report) == report[0]["records"] - len(set(want.values()))
    chance = lambda embedding, *_: embedding.select("num", F.pmod(F.xxhash64(F.lit(99), "num"), F.lit(10)).alias("grp"))
    monkeypatch.setattr(lineages, "groups", chance)
    found, _ = clusters(token_sets(rows(spark, sets)), "15/100", affinity=False)
    assert {r.id: r.cluster_id for r in found.collect()} != want


def test_centres():
    """As many centres as there are places further apart than the radius."""
    from presq.llm.lineages import _centres

    rng = np.random.default_rng(1)
    middle = rng.random((20, 4))
    points = np.repeat(middle, 7, 0) + rng.normal(0, 1e-4, (140, 4))
    own = _centres(points, np.ones(140), 1e-2)
    assert len(set(own)) == 20 and all(len(set(own[i : i + 7])) == 1 for i in range(0, 140, 7))


def test_clusters_of_nothing(spark):
    found, _ = clusters(token_sets(spark.createDataFrame([], "rec string, term string")))
    assert found.count() == 0
    found, _ = clusters(token_sets(spark.createDataFrame([("a", "x")], "rec string, term string")))
    assert [(r.id, r.cluster_id) for r in found.collect()] == [("a", "a")]


def brute(links, known):
    low = {x: x for x in known} | {x: x for p in links for x in p}
    while True:
        new = dict(low)
        for a, b in links:
            m = min(new[a], new[b])
            new[a] = new[b] = m
        if new == low:
            return low
        low = new


def graphs():
    rng = np.random.default_rng(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 17:02}") for i in range(17)]
    star = [("hub", f"leaf{i}") for i in range(30)]
    lasso = [("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("k3", "k4"), ("k4", "k5")]
    dense = [(f"d{a}", f"d{b}") for a, b in combinations(range(8), 2)]
    mixed = [(f"m{a}", f"m{b}") for a, b in rng.integers(0, 60, (55, 2))]
    return {"chain": chain, "ring": ring, "star": star, "lasso": lasso, "dense": dense, "all": chain + ring + star + lasso + dense + mixed + [("z", "z"), ("leaf1", "hub")]}


@pytest.mark.parametrize("name", ["ring", "all"])
@pytest.mark.parametrize("core", [0, 1000])
def test_components(spark, monkeypatch, name, core):
    import presq.llm.components as c

    monkeypatch.setattr(c, "SMALL_CORE", core)
    links = graphs()[name]
    df = spark.createDataFrame([*links, (None, "x"), ("y", None)], "a string, b string")
    got = {r.id: r.group_id for r in components(df, spark.createDataFrame([("alone",), (None,)], "id string")).collect()}
    assert got == brute(links, ["alone"])


def test_small_graphs_are_reduced_too(spark, monkeypatch):
    import presq.llm.components as c

    calls = []
    for name in ("_strip", "_compress"):
        monkeypatch.setattr(c, name, lambda edges, name=name, real=getattr(c, name): calls.append(name) or real(edges))
    links = graphs()["lasso"] + [("k1", "t1"), ("k2", "t2"), ("t2", "t3")]
    got = {r.id: r.group_id for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == brute(links, [])
    assert calls.count("_strip") >= 2 and "_compress" in calls


def test_components_of_nothing(spark):
    none = components(spark.createDataFrame([], "a string, b string"))
    assert none.count() == 0
    assert group_sizes(none).count() == 0


@pytest.mark.parametrize("part_rows", [2_000_000, 20, 3])
def test_terms(spark, part_rows):
    data = [(f"t{i % 9}", f"r{i % 31}") for i in range(400)] + [("hot", f"r{i}") for i in range(31)] * 3 + [(None, "r"), ("t", None)]
    df = spark.createDataFrame(data, "term string, rec string")
    listed = spark.createDataFrame([("hot",), ("t1",), ("never",), (None,), ("hot",)], "term string")
    got = {r.term: (r.n_rows, r.n_records, r.mark) for r in marked_terms(df, listed, part_rows=part_rows).collect()}
    t1 = [r for t, r in data if t == "t1"]
    assert got == {"hot": (93, 31, "common"), "t1": (len(t1), len(set(t1)), "common" if len(set(t1)) > 15.5 else None), "never": (0, 0, "rare")}


def test_hot_terms_are_split_alone(spark, monkeypatch):
    """Only partitions above the bound are read again, and a hot term's records are spread over leaves."""
    import presq.llm.termcount as tc

    spilled, real = [], tc._spill
    monkeypatch.setattr(tc, "_spill", lambda cells, part, path: spilled.append(cells.count()) or real(cells, part, path))
    data = [("hot", f"r{i}") for i in range(300)] + [(f"t{i}", f"r{i}") for i in range(300)]
    df = spark.createDataFrame(data, "term string, rec string")
    counts, _ = tc.term_counts(df, part_rows=60)
    got = {r.term: (r.n_rows, r.n_records) for r in counts.collect()}
    assert got == {"hot": (300, 300)} | {f"t{i}": (1, 1) for i in range(300)}
    assert spilled[0] == 600 and len(spilled) > 2 and max(spilled[1:]) < 400


def test_terms_need_a_file_system(spark, monkeypatch):
    import presq.llm.termcount as tc

    monkeypatch.setattr(tc, "shared_folder", lambda spark: "s3a://bucket/x")
    with pytest.raises(ValueError):
        tc.term_counts(spark.createDataFrame([("a", "b")], "term string, rec string"))


def test_terms_of_nothing(spark):
    df = spark.createDataFrame([], "term string, rec string")
    (r,) = marked_terms(df, spark.createDataFrame([("a",)], "term string")).collect()
    assert (r.n_rows, r.n_records, r.mark) == (0, 0, "rare")


def test_bytes_that_the_walk_moves(spark):
    from pyspark.sql import functions as F

    from presq.llm.lineages import power_vectors

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    links = spark.range(20_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(5), F.floor(F.col("id") / 40)).alias("b"), F.lit(0.5).alias("w"))
    before = written()
    assert len(power_vectors(links).collect()) == 20_500
    assert written() - before < 11_000_000
