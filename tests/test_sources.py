import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from presq.operators import ml
from presq.sources import generators, writers
from presq.sources.loaders import from_pandas, from_vcf, infer_format, load, read_fasta, vcf_to_bed

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
chr1\t10\t.\tA\tC,GT\t50\t.\t.\tGT:DP\t1/1:3\t0|2:4
chr1\t20\t.\tG\tT\t10\t.\t.\tGT\t1/1\t1/1
chr2\t5\t.\tC\tT\t99\t.\t.\tGT\t./.\t0/1
chr2\t7\t.\tG\tA\t99\t.\t.\tGT\t0/0\t1
chr2\t9\t.\tT\tA\t3\t.\t.\tGT\t0|0\t0/1
chr2\t11\t.\tAC\tA\t.\t.\t.\tGT\t0/.\t1/1
"""


def same(frame, golden):
    assert (frame.get_matrix() == golden[0]).all()
    assert frame.get_headers() == golden[1]


def test_csv(spark, golden, tmp_path):
    path = str(tmp_path / "m.csv")
    pd.DataFrame(golden[0], golden[1]["guids"], golden[1]["alleles"]).to_csv(path)
    same(load(spark, path), golden)
    (tmp_path / "bad.csv").write_text(",a\nx,2\n")
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "bad.csv"))


def test_csv_quotes_and_reference_row(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(',"a,1","b ""x"""\n"s,1",1,0\n"s 2",0,1\n')
    f = load(spark, str(path), add_ref=True)
    assert f.get_headers() == {"guids": ["s,1", "s 2", "REF"], "alleles": ["a,1", 'b "x"']}
    assert f.get_matrix().tolist() == [[1, 0], [0, 1], [0, 0]]
    writers.write_csv(f, str(tmp_path / "again.csv"))
    assert load(spark, str(tmp_path / "again.csv")).get_matrix().tolist() == [[1, 0], [0, 1], [0, 0]]
    for bad in (",a\nx,1\nx,0\n", ",a,a\nx,1,1\n", ",a\nx,1,1\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            load(spark, str(path))
    path.write_text("'x;1';1\ny;0\n")
    f = load(spark, str(path), delimiter=";", quote="'", header=False)
    assert f.get_headers() == {"guids": ["x;1", "y"], "alleles": ["allele_0"]}


def test_parquet(spark, golden, frame, tmp_path):
    path = str(tmp_path / "m.parquet")
    pd.DataFrame(golden[0], golden[1]["guids"], golden[1]["alleles"]).to_parquet(path)
    same(load(spark, path), golden)
    writers.write_parquet(frame, str(tmp_path / "long.parquet"))
    assert load(spark, str(tmp_path / "long.parquet")).presence.count() == 56


def test_npy_round_trip(spark, golden, frame, tmp_path):
    prefix = str(tmp_path / "x")
    writers.write_npy(frame, prefix)
    files = [f"{prefix}_matrix.npy", f"{prefix}_headers.json"]
    same(load(spark, files), golden)
    same(load(spark, files[::-1]), golden)
    (tmp_path / "short.json").write_text(json.dumps({"guids": ["a"], "alleles": ["b"]}))
    with pytest.raises(ValueError):
        load(spark, [files[0], str(tmp_path / "short.json")])


def test_memory_and_pandas(spark, golden):
    same(load(spark, [golden[1], golden[0]]), golden)
    same(from_pandas(spark, pd.DataFrame(golden[0], golden[1]["guids"], golden[1]["alleles"])), golden)


@pytest.mark.parametrize("bad", ["test.invalid", "x.CSV", ["test.json"], [1, 2], 5, ["a.json", "b.csv"]])
def test_formats(bad):
    with pytest.raises(ValueError):
        infer_format(bad)
    with pytest.raises(ValueError):
        infer_format("test.csv", "invalid")


def test_csv_sink(spark, frame, golden, tmp_path):
    writers.write_csv(frame, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert text[0] == "," + ",".join(golden[1]["alleles"])
    assert text[10] == "GUID10,0,0,0,1,1,0,1,0,1,0"
    wide = writers.wide_distances(frame.square_matrix(), golden[1]["guids"]).toPandas().set_index("guid_a")
    assert wide.loc["GUID1", "GUID10"] == 6
    writers.write_stats(frame, str(tmp_path / "stats"))
    writers.write_distances(frame.pairwise(), str(tmp_path / "dist"))


def test_vcf(spark, tmp_path):
    (tmp_path / "one.x.vcf").write_text(VCF)
    f = from_vcf(spark, str(tmp_path / "one.x.vcf"))
    cells = {(r.guid, r.allele) for r in f.presence.collect()}
    assert cells == {("S1", "chr1.10.C"), ("S2", "chr2.5.T"), ("S2", "chr2.7.A")}
    # a column of the reference base takes a genotype of two reference copies, at any quality; 0/1, 0|2 and 0/. make none
    assert set(f.get_headers()["alleles"]) == {"chr1.10.C", "chr2.5.T", "chr2.7.A", "chr2.7.G", "chr2.9.T"}
    merged = from_vcf(spark, str(tmp_path / "one.x.vcf"), database=f)
    assert merged.presence.count() == 3 and merged.n_alleles() == 5
    bed = vcf_to_bed(spark, str(tmp_path / "one.x.vcf"))
    rows = [(r.sample, r.chrom, r.start, r.end) for r in bed.collect()]
    assert rows.count(("one", "chr1", 9, 10)) == 2
    writers.write_bed(bed, str(tmp_path / "bed"))
    assert (tmp_path / "bed" / "sample=one").exists()
    more = bed.union(bed.withColumn("sample", F.lit("007")))
    for _ in range(2):
        writers.write_bed(more, str(tmp_path / "bed"), skip_existing=True)
    assert {r["sample"]: r["count"] for r in writers.read_bed(spark, str(tmp_path / "bed")).groupBy("sample").count().collect()} == {"one": bed.count(), "007": bed.count()}


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">ref one\nACG\nT\n")
    (r,) = read_fasta(spark, str(tmp_path / "r.fa")).collect()
    assert (r.name, r.sequence) == ("ref", "ACGT")
    from presq.model import AlleleFrame

    f = AlleleFrame.from_cells(spark.createDataFrame([("s", "A1T"), ("s", "G3C"), ("s", "C4G")], "guid string, allele string"))
    out = writers.fasta(f, r.name, r.sequence)
    assert out.first().sequence == "TCCT"
    writers.write_fasta(out, str(tmp_path / "fa"))


def test_generators(spark):
    assert {r.mass for r in generators.sparse(spark, 6, 100, 0.05).snp_count().collect()} == {5}
    c = generators.clustered(spark, 7, 200, 0.1, 3, 0.01)
    assert {r.guid: r.mass for r in c.snp_count().collect()}["sample_6"] == 0
    u = generators.uniform(spark, 5, 50)
    assert np.array_equal(u.get_matrix(), generators.uniform(spark, 5, 50).get_matrix())
    assert generators.coordinates(spark, 5, 50, 10).count() == 10


def test_ml(frame):
    assert len(ml.principal_components(frame, 3).first().components) == 3
    for on in ("distances", "cells"):
        assert ml.kmeans(frame, 3, on=on).select("cluster").distinct().count() == 3
    row = {r.guid: r.features.toArray().tolist() for r in ml.distance_rows(frame).collect()}["GUID10"]
    assert row == [6, 6, 6, 6, 6, 4, 4, 1, 1, 0]


def test_admixture(frame):
    shares, sources = ml.admixture(frame, 2)
    assert all(abs(sum(r.shares) - 1) < 1e-5 and min(r.shares) >= 0 for r in shares.collect())
    assert {r.source for r in sources.collect()} <= {0, 1} and sources.count() == 10


def test_wide_frame(spark, frame, golden):
    from presq.sources.loaders import from_wide

    m = from_wide(frame.to_dataframe())
    assert m.presence.count() == 56 and m.n_alleles() == 10
    with pytest.raises(ValueError):
        from_wide(spark.createDataFrame([("x", 2)], "guid string, a int"))
