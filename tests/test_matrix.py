import numpy as np
import pytest

from presq.model import AlleleFrame
from presq.operators import algebra, distance, lookup
from presq.sources.loaders import from_memory

G = [f"GUID{i}" for i in range(1, 11)]


def col(df, name="allele"):
    return {r[name] for r in df.collect()}


def snp(*n):
    return {f"SNP{i}" for i in n}


def test_snp_count(frame):
    assert {r.guid: r.mass for r in frame.snp_count().collect()} == dict(zip(G, [6, 6, 6, 6, 6, 6, 6, 5, 5, 4], strict=True))


def test_pairwise(frame, golden):
    x = golden[0].astype(int)
    got = {(r.guid_a, r.guid_b): r.distance for r in frame.pairwise().collect()}
    jac = {(r.guid_a, r.guid_b): r.distance for r in frame.pairwise(metric="jaccard").collect()}
    assert len(got) == 45
    for i in range(10):
        for j in range(i + 1, 10):
            assert got[G[i], G[j]] == (x[i] != x[j]).sum()
            assert jac[G[i], G[j]] == 1 - (x[i] & x[j]).sum() / (x[i] | x[j]).sum()
    square = frame.square_matrix()
    assert square.count() == 100
    assert distance.condensed(square, frame.guids).count() == 45
    assert frame.pairwise(guids=["GUID1", "GUID10"]).first().distance == 6
    frame.flush_cache()
    with pytest.raises(ValueError):
        frame.pairwise(metric="invalid")


def test_neighbourhood(frame):
    near = {r.guid: r.distance for r in frame.neighbourhood("GUID1", 2).collect()}
    assert near == {"GUID2": 0, "GUID3": 2, "GUID4": 2, "GUID5": 2}
    assert frame.neighbourhood("GUID1", 0, include_self=True).count() == 2
    with pytest.raises(ValueError):
        frame.neighbourhood("nobody", 2)
    with pytest.raises(ValueError):
        frame.neighbourhood("GUID1", -1)


def test_pairs_within(frame):
    every = {(r.guid_a, r.guid_b) for r in frame.pairwise().where("distance <= 2").collect()}
    assert {(r.guid_a, r.guid_b) for r in frame.pairs_within(2).collect()} == every


@pytest.mark.parametrize(("guids", "want"), [((1, 2), (1,)), ((3, 4, 5), (2,)), ((6, 7), (3,)), ((8, 9, 10), (4,)), (range(1, 8), (6,)), (range(6, 11), (9,)), (range(1, 11), (5, 7)), ((1, 5), ())])
def test_unique(frame, guids, want):
    assert col(frame.unique([f"GUID{i}" for i in guids])) == snp(*want)


def test_core_and_accessory(frame):
    assert col(frame.core(["GUID1", "GUID2"])) == snp(1, 5, 6, 7, 8, 10)
    assert frame.accessory({"GUID1", "GUID2"}).count() == 0
    assert col(frame.core(set(G[5:]))) == snp(5, 7, 9)
    assert col(frame.accessory(G[5:])) == snp(3, 4, 6, 10)
    # a count of 3 of 10 isn't core at 0.7: the threshold is a product of doubles
    assert col(frame.core(G, 0.7)) == snp(5, 6, 7, 8, 9, 10)
    assert {r.allele: r["count"] for r in frame.accessory(G, 0.7, return_counts=True).collect()} == {"SNP1": 2, "SNP2": 3, "SNP3": 2, "SNP4": 3}
    assert frame.core(G, 1.0).count() == 10
    assert {r["count"] for r in frame.core(["GUID1", "GUID1"], return_counts=True).collect()} == {2}
    for bad in ([], ["nobody"], "GUID1"):
        with pytest.raises(ValueError):
            frame.core(bad)
    with pytest.raises(ValueError):
        frame.core(G, 1.5)


def test_carriers(frame):
    assert col(frame.allele(["SNP5", "SNP10"]), "guid") == set(G[:9])
    assert col(frame.allele({"SNP1"}), "guid") == {"GUID1", "GUID2"}
    assert frame.allele(["none"], on_unknown="ignore").count() == 10
    for bad in ([], ["none"], "SNP1"):
        with pytest.raises(ValueError):
            frame.allele(bad)


def test_names(frame):
    assert col(frame.match_allele_names("SNP1")) == snp(1, 10)
    assert col(frame.match_allele_names("SNP[1-3]$")) == snp(1, 2, 3)
    assert frame.match_allele_names("S*").count() == 10
    with pytest.raises(ValueError):
        frame.match_allele_names(3)


def test_access(frame, golden):
    coords = [(9, 9), (0, 0), (9, 9), (3, 1)]
    got = [r.value for r in frame.access(coords).orderBy("pos").collect()]
    assert got == [int(golden[0][c]) for c in coords]
    assert frame.access([]).count() == 0
    with pytest.raises(IndexError):
        frame.access([(100, 100)])
    assert sorted(col(frame.access_guid(9), "col_idx")) == [3, 4, 6, 8]
    assert frame.access_guid(99).count() == 0
    assert frame.gather_snps([9, 9]).count() == 8
    assert lookup.encode(frame, guid="GUID3") == 2
    assert lookup.decode(frame, col_idx=9) == "SNP10"
    assert frame.coordinates(["SNP1"], ["GUID1", "GUID2"]).count() == 2


def test_subset_and_merge(frame):
    sub = frame.subset_by_guid(["GUID10", "GUID1", "nobody"])
    assert sub.get_headers() == {"guids": ["GUID1", "GUID10"], "alleles": ["SNP1", "SNP4", "SNP5", "SNP6", "SNP7", "SNP8", "SNP9", "SNP10"]}
    assert sub.get_matrix().tolist() == [[1, 0, 1, 1, 1, 1, 0, 1], [0, 1, 1, 0, 1, 0, 1, 0]]
    assert frame.remove_guid("GUID1").n_guids() == 9
    both = sub.merge(frame.subset_by_guid(["GUID3"]))
    assert both.n_guids() == 3
    assert {r.value for r in algebra.merge(sub.presence, sub.presence, "sum").collect()} == {2}
    assert col(algebra.symmetric_difference(frame, "GUID9", "GUID10")) == {"SNP10"}
    assert algebra.symmetric_difference(frame, "GUID9", "GUID9").count() == 0


def test_exports(frame, golden):
    assert (frame.get_matrix() == golden[0]).all()
    assert frame.get_headers() == golden[1]
    assert frame.stats() == {"n_guids": 10, "n_alleles": 10, "matrix_size": "100 Bytes"}
    wide = frame.to_dataframe().toPandas().set_index("guid")
    assert (wide[golden[1]["alleles"]].to_numpy() == golden[0]).all()
    assert frame.to_dense().count() == 100
    assert {r.guid: r.unique for r in frame.unique_per_sample().collect()}["GUID1"] == 0
    assert {r.guid: set(r.alleles) for r in frame.to_dict().collect()}["GUID10"] == snp(4, 5, 7, 9)


@pytest.mark.parametrize("m", [1, 31, 33, 63, 64, 65, 130])
def test_random_widths(spark, m):
    x = (np.random.default_rng(m).random((7, m)) < 0.4).astype(np.uint8)
    x[2] = 0
    x[5] = 0
    f = from_memory(spark, x, {"guids": [f"g{i}" for i in range(7)], "alleles": [f"a.{i}" for i in range(m)]})
    got = {(r.guid_a, r.guid_b): r.distance for r in distance.pairwise(f).collect()}
    assert got == {(f"g{i}", f"g{j}"): int((x[i] != x[j]).sum()) for i in range(7) for j in range(i + 1, 7)}
    jac = {(r.guid_a, r.guid_b): r.distance for r in distance.pairwise(f, "jaccard").collect()}
    assert jac["g2", "g5"] == 0.0


def test_wide_matrix_is_sparse(spark):
    x = (np.random.default_rng(1).random((5, 3200)) < 0.01).astype(np.uint8)
    f = from_memory(spark, x, {"guids": list("abcde"), "alleles": [str(i) for i in range(3200)]})
    got = {(r.guid_a, r.guid_b): r.distance for r in distance.pairwise(f).collect()}
    assert got["a", "e"] == int((x[0] != x[4]).sum())
    assert len(got) == 10


def test_empty_and_invalid(spark):
    empty = AlleleFrame.from_cells(spark.createDataFrame([], "guid string, allele string"))
    assert empty.stats() == {"n_guids": 0, "n_alleles": 0, "matrix_size": "0 Bytes"}
    assert empty.pairwise().count() == 0
    with pytest.raises(ValueError):
        from_memory(spark, np.array([[2]]), {"guids": ["a"], "alleles": ["b"]})
    with pytest.raises(ValueError):
        from_memory(spark, np.ones((2, 1)), {"guids": ["a", "a"], "alleles": ["b"]})
    with pytest.raises(ValueError):
        from_memory(spark, np.ones((2, 1)), {"guids": ["a"], "alleles": ["b"]})
    assert from_memory(spark, np.array([[7]]), {"guids": ["a"], "alleles": ["b"]}, binarize=True, add_ref=True).n_guids() == 2


def test_arrivals(spark, frame):
    from presq.streaming.arrivals import arriving_neighbours

    q = spark.createDataFrame([("new", ["SNP4", "SNP5", "SNP7", None]), ("bare", [])], "query string, alleles array<string>")
    got = {(r.query, r.guid): r.distance for r in arriving_neighbours(q, frame, 4).collect()}
    assert got["new", "GUID10"] == 1
    assert got["bare", "GUID10"] == 4
    assert ("bare", "GUID1") not in got


def test_arriving_samples(spark, frame, golden, tmp_path):
    """Samples that arrive as files of a stream, each micro-batch against the matrix."""
    import json

    from presq.streaming.arrivals import arriving_neighbours

    matrix, headers = golden
    found: dict[str, dict[str, int]] = {}

    def batch(df, _):
        for r in arriving_neighbours(df, frame, 4).collect():
            found.setdefault(r.query, {})[r.guid] = r.distance

    (tmp_path / "in").mkdir()
    queries = {"same": ["SNP1", "SNP5", "SNP6", "SNP7", "SNP8", "SNP10"], "none": [], "twice": ["SNP4", "SNP4", None]}
    for name, own in queries.items():
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"query": name, "alleles": own}))
    stream = spark.readStream.schema("query string, alleles array<string>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    sets = {g: {a for a, v in zip(headers["alleles"], row, strict=True) if v} for g, row in zip(headers["guids"], matrix, strict=True)}
    want = {q: {g: len(s ^ {a for a in own if a}) for g, s in sets.items() if len(s ^ {a for a in own if a}) <= 4} for q, own in queries.items()}
    assert found == {q: w for q, w in want.items() if w}


def test_labels_and_slices(frame):

    assert frame.split_labels(["GUID3", "nobody", "GUID1"]) == (["GUID1", "GUID3"], ["nobody"])
    assert {r.guid for r in distance.below(frame.pairwise(), "GUID10", 4).collect()} == {"GUID8", "GUID9"}
    assert {r.guid for r in distance.below(frame.square_matrix(), "GUID10", 4, strict=False).collect()} == {"GUID6", "GUID7", "GUID8", "GUID9"}
    assert [r.distance for r in frame.neighbourhood("GUID10", 6, order_by="distance").collect()] == [1, 1, 4, 4, 6, 6, 6, 6, 6]
    assert {r.allele for r in frame.unique(["nobody"], on_unknown="ignore").collect()} == {"SNP5", "SNP7"}
    with pytest.raises(KeyError):
        frame.pairwise_known(["nobody"])
    with pytest.raises(ValueError):
        frame.pairwise_known(["nobody", "GUID1"])
    assert frame.pairwise_known(["nobody", "GUID1", "GUID3"]).first().distance == 2
    assert {r.allele for r in frame.match_allele_names("(?P<x>SNP)1$").collect()} == {"SNP1"}
    with pytest.raises(ValueError):
        frame.match_allele_names("SNP[")


def _wide(spark, n=60, m=3300, width=4000):
    """Two alleles that nearly all rows carry, families of near sets, light and empty rows, copies; the table of alleles
    lacks one that is carried."""
    rng = np.random.default_rng(5)
    x = np.zeros((n, m), np.uint8)
    for i in range(n):
        x[i, rng.choice(np.arange(10 + 40 * (i % 4), 50 + 40 * (i % 4)), 20, replace=False)] = 1
        x[i, rng.choice(np.arange(200, m), 8, replace=False)] = 1
    x[5:, :2] = 1
    x[50:54], x[54, :], x[55, :] = 0, x[1], x[2]
    x[51, 3], x[52, :2] = 1, 1
    cells = [(f"g{i:02}", f"a{j}") for i, j in zip(*np.nonzero(x), strict=True)]
    f = AlleleFrame(
        spark.createDataFrame(cells, "guid string, allele string"),
        spark.createDataFrame([(7 * (n - i), f"g{i:02}") for i in range(n)], "row_idx int, guid string"),
        spark.createDataFrame([(j, f"a{j}") for j in range(1, width)], "col_idx int, allele string"),
    )
    return x.astype(int), f


def _shuffled_joins(df):
    """Joins by shuffle or nested loop in df's plan, without those of the tables that were made for it."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Join" in line and "BroadcastHashJoin" not in line]


def test_wide_pairs_within_meet_in_blocks(spark, monkeypatch):
    from presq.operators import wide

    monkeypatch.setattr(wide, "NEAR_ROWS", 7)
    x, f = _wide(spark)
    every = {(f"g{j:02}", f"g{i:02}"): int((x[i] != x[j]).sum()) for i in range(len(x)) for j in range(i + 1, len(x))}
    for n in (0, 3, 30, 40):
        near = f.pairs_within(n)
        rows = near.collect()
        assert {(r.guid_a, r.guid_b): r.distance for r in rows} == {k: d for k, d in every.items() if d <= n}
        assert len(rows) == len({(r.guid_a, r.guid_b) for r in rows})
    assert not _shuffled_joins(f.pairs_within(40))


@pytest.mark.parametrize("hot", [0, 3, 70])
def test_blocks_count_alleles_in_common(monkeypatch, hot):
    import pyarrow as pa

    from presq.operators import wide

    monkeypatch.setattr(wide, "CHUNK", 30)
    monkeypatch.setattr(wide, "CHUNK_COMMON", 50)
    rng = np.random.default_rng(hot)
    x = (rng.random((23, 90)) < rng.random((23, 1))).astype(int)
    x[4] = 0

    def side(rows):
        cells = [np.flatnonzero(x[i])[::-1].tolist() for i in rows]
        t = {"_rank": list(rows), "row_idx": list(rows), "guid": [f"g{i}" for i in rows], "mass": x[list(rows)].sum(1).tolist(), "cells": cells}
        return wide._Side(pa.table(t, pa.schema([("_rank", pa.int32()), ("row_idx", pa.int32()), ("guid", pa.string()), ("mass", pa.int32()), ("cells", pa.list_(pa.int32()))])), np.arange(10, 10 + hot, dtype=np.int32))

    met = list(wide._chunks(side(range(12)), side(range(12, 23))))
    assert len(met) > 4
    assert [(a, e) for a, e, _ in met] == list(zip([0, *(e for _, e, _ in met[:-1])], [e for _, e, _ in met], strict=True))
    assert (np.concatenate([c for _, _, c in met]) == x[:12] @ x[12:].T).all()


def test_wide_pairs_meet_in_blocks(spark, monkeypatch):
    from presq.operators import wide

    monkeypatch.setattr(wide, "BLOCK_ROWS", 7)
    x, f = _wide(spark)
    got = distance.pairwise(f)
    rows = got.collect()
    assert len(rows) == 60 * 59 // 2
    assert {(r.guid_a, r.guid_b): r.distance for r in rows} == {(f"g{j:02}", f"g{i:02}"): int((x[i] != x[j]).sum()) for i in range(60) for j in range(i + 1, 60)}
    assert not _shuffled_joins(got)
    some = distance.pairwise(f, guids=["g07", "g03", "g54"]).collect()
    assert {(r.guid_a, r.guid_b): r.distance for r in some} == {(a, b): int((x[int(a[1:])] != x[int(b[1:])]).sum()) for a, b in (("g07", "g03"), ("g54", "g07"), ("g54", "g03"))}


def test_wide_jaccard_meets_in_blocks(spark, monkeypatch):
    from presq.operators import wide

    monkeypatch.setattr(wide, "BLOCK_ROWS", 11)
    x, f = _wide(spark)
    got = distance.pairwise(f, "jaccard")
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            union = int((x[i] | x[j]).sum())
            want[f"g{j:02}", f"g{i:02}"] = 1 - int((x[i] & x[j]).sum()) / union if union else 0.0
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(r.guid_a, r.guid_b): r.distance for r in rows} == want
    assert want["g53", "g50"] == 0.0
    assert not _shuffled_joins(got)
