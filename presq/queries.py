"""Queries of the matrix operators over whole tables, and the DuckDB statement of each.

Three matrices stand in for matrix files: E, a dense one (the sign of each embedding's elements), P, a sparse one (the
presence table with its label tables) and B, a narrow one (brands that customers returned in bulk).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presq.functions.text import norm
from presq.model import AlleleFrame
from presq.operators import algebra, distance, lookup, ml
from presq.plans.shared import shared_folder
from presq.plans.tables import cells, table
from presq.sources import generators, loaders, writers
from presq.streaming.arrivals import arriving_neighbours

CONTROL = "CTRL-POS-01"
TEN = [str(i) for i in range(10)]
BAG = ["1", "1", "2", "3"]
COORDS = [(0, 0), (5, 63), (0, 0), (499, 1), (7, 7), (5, 63)]


def matrix_e(spark: SparkSession, d: str) -> AlleleFrame:
    e = table(spark, d, "embeddings")
    long = e.select(F.col("vec_id").cast("string").alias("guid"), F.posexplode("embedding").alias("i", "x")).where("x > 0")
    guids = e.select(F.col("vec_id").cast("int").alias("row_idx"), F.col("vec_id").cast("string").alias("guid"))
    m = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    alleles = spark.range(m).select(F.col("id").cast("int").alias("col_idx"), F.col("id").cast("string").alias("allele"))
    return AlleleFrame(long.select("guid", F.col("i").cast("string").alias("allele")), guids, alleles)


def matrix_p(spark: SparkSession, d: str) -> AlleleFrame:
    g = table(spark, d, "guids").where("guid is not null").groupBy(norm("guid").alias("guid")).agg(F.min("row_idx").alias("row_idx"))
    a = table(spark, d, "alleles").where("allele is not null").groupBy(norm("allele").alias("allele")).agg(F.min("col_idx").alias("col_idx"))
    return AlleleFrame(cells(table(spark, d, "presence")).distinct(), g, a)


def _returned(spark: SparkSession, d: str, flag: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_partkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    long = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return long.select(F.col("o_custkey").cast("string").alias("guid"), F.col("p_brand").alias("allele")).distinct()


def matrix_b(spark: SparkSession, d: str) -> AlleleFrame:
    return AlleleFrame.from_cells(_returned(spark, d, "R"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("guid_a", "guid_b", "distance")


def _subset_cells(spark: SparkSession, d: str) -> DataFrame:
    m = matrix_e(spark, d)
    return m.subset_by_guid(["3", "1", "2", "unknown"]).presence


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return algebra.merge(_returned(spark, d, "R"), _returned(spark, d, "A"))


def _merged_sum(spark: SparkSession, d: str) -> DataFrame:
    return algebra.merge(_returned(spark, d, "R"), _returned(spark, d, "A"), "sum")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "strains").select(F.col("strain_id").alias("query"), F.transform("alleles", norm).alias("alleles"))
    return arriving_neighbours(own, matrix_p(spark, d), 60)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    s = matrix_p(spark, d).stats()
    return spark.createDataFrame([(s["n_guids"], s["n_alleles"], s["matrix_size"])], "n_guids long, n_alleles long, matrix_size string")


def _agreement(spark: SparkSession, d: str) -> DataFrame:
    m = matrix_e(spark, d)
    pairs = m.square_matrix().where("guid_a = '0' and guid_b <> '0' and distance <= 26")
    return distance.agreement(m.neighbourhood("0", 26), pairs.select(F.col("guid_b").alias("guid"), "distance"))


def _work(spark: SparkSession, name: str) -> str:
    """A new place for files in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _local_work(spark: SparkSession, name: str) -> str:
    path = "/" + _work(spark, name).removeprefix("file:").lstrip("/")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return path


def _csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _work(spark, "wide.csv")
    writers.write_csv(matrix_e(spark, d), path)
    return loaders.load(spark, path, "csv").presence


def _parquet_wide_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _work(spark, "wide.parquet")
    matrix_e(spark, d).to_dataframe().write.parquet(path)
    return loaders.load(spark, path, "parquet").presence


def _parquet_long_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _work(spark, "long.parquet")
    writers.write_parquet(matrix_p(spark, d), path)
    return loaders.load(spark, path, "parquet").presence


def _npy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    prefix = _local_work(spark, "npy")
    writers.write_npy(matrix_e(spark, d), prefix)
    return loaders.load(spark, [f"{prefix}_matrix.npy", f"{prefix}_headers.json"]).presence


def _memory_source(spark: SparkSession, d: str) -> DataFrame:
    m = matrix_e(spark, d)
    return loaders.load(spark, [m.get_headers(), m.get_matrix()]).presence


def _pandas_source(spark: SparkSession, d: str) -> DataFrame:
    return loaders.from_pandas(spark, matrix_e(spark, d).to_dataframe().toPandas().set_index("guid")).presence


def _label_order(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the matrix read from a CSV file, numbered as in the file."""
    path = _work(spark, "wide.csv")
    writers.write_csv(matrix_e(spark, d), path)
    return loaders.load(spark, path, "csv").labels


def _vcf(spark: SparkSession, d: str) -> str:
    """A merged VCF file of E: samples that have an allele call 1/1 there, others 0/0."""
    m, path = matrix_e(spark, d), _work(spark, "calls.vcf")
    guids = m.get_headers()["guids"]
    calls = m.to_dense().join(m.labels, "guid").groupBy("allele").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda c: F.when(c["value"] == 1, "1/1").otherwise("0/0")).alias("gt"))
    body = calls.select(F.concat_ws("\t", F.lit("c"), F.col("allele").cast("int") + 1, F.lit("."), F.lit("A"), F.lit("C"), F.lit("50"), F.lit("."), F.lit("."), F.lit("GT"), F.array_join("gt", "\t")).alias("value"))
    head = spark.createDataFrame([("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *guids]),)], "value string")
    head.union(body).coalesce(1).write.text(path)
    return path


def _bed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _work(spark, "bed")
    writers.write_bed(loaders.vcf_to_bed(spark, _vcf(spark, d)), path)
    return writers.read_bed(spark, path).groupBy("chrom", "start", "end", "description").agg(F.count("*").alias("copies"))


def _stats_json(spark: SparkSession, d: str) -> DataFrame:
    path = _work(spark, "stats.json")
    writers.write_stats(matrix_p(spark, d), path)
    return spark.read.schema("guid string, total long, `unique` long").json(path)


def _distances_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _work(spark, "distances.csv")
    writers.write_distances(_pairs(matrix_e(spark, d).pairwise()), path)
    return spark.read.schema("guid_a string, guid_b string, distance int").option("header", True).csv(path)


def _wide_distances(spark: SparkSession, d: str) -> DataFrame:
    return writers.wide_distances(matrix_e(spark, d).square_matrix(TEN), TEN)


def _fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of a reference of as many A as E has columns, in which each allele of a sample is a C."""
    e, path = matrix_e(spark, d), _work(spark, "fasta")
    name = lambda c: F.concat(F.lit("A"), (F.col(c).cast("int") + 1).cast("string"), F.lit("C")).alias(c)
    m = AlleleFrame(e.presence.select("guid", name("allele")), e.labels, e.alleles.select("col_idx", name("allele")))
    writers.write_fasta(writers.fasta(m, "ref", "A" * e.width()), path)
    return loaders.read_fasta(spark, path)


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """Positions of some labels, and the labels at these positions."""
    m = matrix_e(spark, d)
    at = [(g, lookup.encode(m, guid=g)) for g in TEN]
    return spark.createDataFrame([(g, i, lookup.decode(m, row_idx=i)) for g, i in at], "label string, idx int, again string")


def _split(spark: SparkSession, d: str) -> DataFrame:
    known, unknown = matrix_e(spark, d).split_labels(["nobody", *TEN, "1"])
    return spark.createDataFrame([(x, True) for x in known] + [(x, False) for x in unknown], "label string, known boolean")


def _loaded_matrices(spark: SparkSession, d: str) -> DataFrame:
    """(matrix_id, n_guids, n_alleles, n_cells) of every loaded file: its distinct labels, and the cells of P that lie in it."""
    h = table(spark, d, "headers")
    own = lambda col, name: h.select("matrix_id", F.explode(col).alias("x")).where("x is not null").select("matrix_id", norm("x").alias(name)).distinct()
    g, a = own("guids", "guid"), own("alleles", "allele")
    cell = cells(table(spark, d, "presence")).distinct()
    # a cell lies in a file if the file lists both labels: rows of one file meet by file and allele
    inside = cell.join(g, "guid").join(a, ["matrix_id", "allele"]).groupBy("matrix_id").agg(F.count("*").alias("n_cells"))
    count = lambda df, name: df.groupBy("matrix_id").agg(F.count("*").alias(name))
    out = h.select("matrix_id").distinct().join(count(g, "n_guids"), "matrix_id", "left").join(count(a, "n_alleles"), "matrix_id", "left").join(inside, "matrix_id", "left")
    return out.select("matrix_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_guids", "n_alleles", "n_cells")])


def _strain_cells(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "strains").select(F.col("strain_id").alias("guid"), F.explode("alleles").alias("a"))
    return s.where("a is not null").select("guid", norm("a").alias("allele")).distinct()


E, P, B = matrix_e, matrix_p, matrix_b
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "snp_count": lambda s, d: P(s, d).snp_count(),
    "snp_count_dense": lambda s, d: E(s, d).snp_count(),
    "pairwise_hamming": lambda s, d: _pairs(E(s, d).pairwise()),
    "pairwise_hamming_sparse": lambda s, d: _pairs(P(s, d).pairwise()),
    "pairwise_jaccard": lambda s, d: _pairs(P(s, d).pairwise(metric="jaccard")),
    "pairwise_jaccard_dense": lambda s, d: _pairs(E(s, d).pairwise(metric="jaccard")),
    "pairwise_subset": lambda s, d: _pairs(E(s, d).pairwise(guids=TEN)),
    "legacy_euclidean": lambda s, d: _pairs(E(s, d).pairwise(metric="euclidean")),
    "legacy_absolute": lambda s, d: _pairs(E(s, d).pairwise(metric="absolute")),
    "legacy_hamming_fraction": lambda s, d: _pairs(E(s, d).pairwise(metric="hamming_fraction")),
    "square_matrix": lambda s, d: E(s, d).square_matrix(),
    "condensed_of_square": lambda s, d: distance.condensed(E(s, d).square_matrix(), E(s, d).guids),
    "neighbourhood": lambda s, d: E(s, d).neighbourhood("0", 22),
    "neighbourhood_with_self": lambda s, d: E(s, d).neighbourhood("0", 24, include_self=True),
    "neighbourhood_sparse": lambda s, d: P(s, d).neighbourhood(CONTROL, 310),
    "pairs_within_epsilon": lambda s, d: E(s, d).pairs_within(16),
    "pairs_within_epsilon_sparse": lambda s, d: P(s, d).pairs_within(40),
    "agreement": _agreement,
    "core": lambda s, d: E(s, d).core(TEN, 0.3),
    "core_counts": lambda s, d: E(s, d).core(TEN, 0.7, return_counts=True),
    "core_bag": lambda s, d: E(s, d).core(BAG, 0.25, return_counts=True),
    "accessory": lambda s, d: E(s, d).accessory(TEN, 0.7),
    "accessory_counts": lambda s, d: E(s, d).accessory(TEN, 0.5, return_counts=True),
    "unique": lambda s, d: P(s, d).unique([CONTROL]),
    "common_legacy": lambda s, d: E(s, d).common(["1", "2", "nobody"]),
    "allele_carriers": lambda s, d: E(s, d).allele(["1", "2", "3"]),
    "allele_carriers_ignore": lambda s, d: E(s, d).allele(["1", "2", "none"], on_unknown="ignore"),
    "match_allele_names": lambda s, d: B(s, d).match_allele_names("Brand#[1-5]$"),
    "match_allele_names_prefix": lambda s, d: B(s, d).match_allele_names("Brand#1*"),
    "access": lambda s, d: E(s, d).access(COORDS),
    "access_guid": lambda s, d: E(s, d).access_guid(3),
    "gather_snps": lambda s, d: E(s, d).gather_snps([1, 1, 4]),
    "coordinates": lambda s, d: E(s, d).coordinates(["1", "2"]),
    "subset_by_guid": _subset_cells,
    "remove_guid": lambda s, d: E(s, d).remove_guid("0").presence,
    "zero_column_drop": lambda s, d: P(s, d).without_zero_columns().alleles.select("allele"),
    "to_dict": lambda s, d: P(s, d).to_dict(),
    "stats": _stats,
    "to_dense": lambda s, d: B(s, d).to_dense(),
    "to_dataframe": lambda s, d: B(s, d).to_dataframe(),
    "merge_matrices": _merged,
    "merge_matrices_sum": _merged_sum,
    "unique_per_sample": lambda s, d: P(s, d).unique_per_sample(),
    "alleles_by_contig": lambda s, d: P(s, d).by_contig(),
    "symmetric_difference": lambda s, d: algebra.symmetric_difference(E(s, d), "1", "2"),
    "union_alleles": lambda s, d: algebra.union_alleles(E(s, d), ["1", "2"]),
    "arriving_neighbours": _arrivals,
    "csv_round_trip": _csv_round_trip,
    "csv_label_order": _label_order,
    "parquet_wide_round_trip": _parquet_wide_round_trip,
    "parquet_long_round_trip": _parquet_long_round_trip,
    "npy_round_trip": _npy_round_trip,
    "memory_source": _memory_source,
    "pandas_source": _pandas_source,
    "vcf_round_trip": lambda s, d: loaders.from_vcf(s, _vcf(s, d)).presence,
    "vcf_columns": lambda s, d: loaders.from_vcf(s, _vcf(s, d)).alleles.select("allele"),
    "bed_round_trip": _bed_round_trip,
    "fasta_round_trip": _fasta_round_trip,
    "stats_json": _stats_json,
    "distances_csv": _distances_csv,
    "wide_distances": _wide_distances,
    "loaded_matrices": _loaded_matrices,
    "label_codes": _codes,
    "split_labels": _split,
    "neighbourhood_sorted": lambda s, d: E(s, d).neighbourhood("0", 24, order_by="distance"),
    "threshold_slice": lambda s, d: distance.below(E(s, d).pairwise(), "0", 24),
    "common_of_unknown": lambda s, d: P(s, d).common(["nobody"]),
    "unique_legacy": lambda s, d: P(s, d).unique([CONTROL, "nobody"], on_unknown="ignore"),
    "match_presence_names": lambda s, d: P(s, d).match_allele_names("[^.]+.[0-9]*7.[AC]$"),
    "to_dense_embeddings": lambda s, d: E(s, d).to_dense(),
    "merge_presence": lambda s, d: algebra.merge(P(s, d).presence, _strain_cells(s, d)),
    "merge_presence_sum": lambda s, d: algebra.merge(P(s, d).presence, _strain_cells(s, d), "sum"),
    "generated_sparse": lambda s, d: generators.sparse(s, 500, 400, 0.05).snp_count(),
    "generated_clusters": lambda s, d: generators.clustered(s, 107, 200, 0.1, 10, 0.01).snp_count().groupBy((F.col("mass") == 0).alias("empty")).count(),
    "generated_coordinates": lambda s, d: generators.coordinates(s, 5, 50, 1000).agg(F.count("*").alias("n"), (F.max("row_idx") < 5).alias("rows"), (F.max("col_idx") < 50).alias("cols")),
    "generated_uniform": lambda s, d: generators.uniform(s, 300, 200).snp_count(),
    "principal_components": lambda s, d: ml.principal_components(E(s, d)),
    "kmeans_distances": lambda s, d: ml.kmeans(E(s, d), 8),
    "admixture": lambda s, d: ml.admixture(E(s, d))[0],
    "unpivot_wide": lambda s, d: loaders.from_wide(E(s, d).to_dataframe()).presence,
}


_E = """with e as (select vec_id::int as r, vec_id::varchar as guid, embedding from embeddings),
p as (select r, guid, (i - 1)::int as c, (i - 1)::varchar as allele from (select r, guid, embedding, unnest(range(1, len(embedding) + 1)) as i from e) where embedding[i] > 0),
g as (select e.r, e.guid, count(p.c)::int as mass from e left join p on p.r = e.r group by e.r, e.guid),
"""
_P = """with p as (select distinct upper(trim(guid)) as guid, upper(trim(allele)) as allele from presence where guid is not null and allele is not null),
l as (select upper(trim(guid)) as guid, min(row_idx) as r from guids where guid is not null group by 1),
a as (select upper(trim(allele)) as allele, min(col_idx) as c from alleles where allele is not null group by 1),
g as (select l.r, l.guid, count(p.allele)::int as mass from l left join p on p.guid = l.guid group by l.r, l.guid),
"""


def _b(flag: str, name: str) -> str:
    return f"""{name} as (select distinct o_custkey::varchar as guid, p_brand as allele from lineitem join orders on l_orderkey = o_orderkey
join part on l_partkey = p_partkey where l_returnflag = '{flag}' and l_quantity > 45)"""


_D = """common as (select x.guid as ga, y.guid as gb, count(*) as c from p x join p y on x.allele = y.allele and x.guid <> y.guid group by 1, 2),
d as (select x.guid as guid_a, y.guid as guid_b, x.mass as ma, y.mass as mb, coalesce(c, 0) as c, (x.mass + y.mass - 2 * coalesce(c, 0))::int as distance
  from g x join g y on x.r < y.r left join common on ga = x.guid and gb = y.guid)
"""
_JACCARD = "select guid_a, guid_b, case when ma + mb - c = 0 then 0.0::double else 1 - c::double / (ma + mb - c) end as distance from d"
_ALL = "select guid_a, guid_b, distance from d"
_BOTH = """, sq as (select guid_a, guid_b, distance from d union all select guid_b, guid_a, distance from d union all select guid, guid, 0 from g)
"""
_TEN = "('0','1','2','3','4','5','6','7','8','9')"


def _counts(guids: str, where: str, cols: str) -> str:
    return _E + f"k as (select allele, count(*)::bigint as count from p join (select unnest([{guids}]) as guid) b using (guid) group by allele) select {cols} from k where count {where}"


_TEN_LIST = ",".join(f"'{i}'" for i in range(10))
ORACLE: dict[str, str] = {
    "snp_count": _P + "z as (select 1) select guid, mass from g",
    "snp_count_dense": _E + "z as (select 1) select guid, mass from g",
    "pairwise_hamming": _E + _D + _ALL,
    "pairwise_hamming_sparse": _P + _D + _ALL,
    "pairwise_jaccard": _P + _D + _JACCARD,
    "pairwise_jaccard_dense": _E + _D + _JACCARD,
    "pairwise_subset": _E + _D + _ALL + f" where guid_a in {_TEN} and guid_b in {_TEN}",
    "legacy_euclidean": _E + _D + "select guid_a, guid_b, sqrt(distance::double) as distance from d",
    "legacy_absolute": _E + _D + _ALL,
    "legacy_hamming_fraction": _E + _D + "select guid_a, guid_b, distance::double / 64.0::double as distance from d",
    "square_matrix": _E + _D + _BOTH + "select * from sq",
    "condensed_of_square": _E + _D + _ALL,
    "neighbourhood": _E + _D + _BOTH + "select guid_b as guid, distance from sq where guid_a = '0' and guid_b <> '0' and distance <= 22",
    "neighbourhood_with_self": _E + _D + _BOTH + "select guid_b as guid, distance from sq where guid_a = '0' and distance <= 24",
    "neighbourhood_sparse": _P + _D + _BOTH + f"select guid_b as guid, distance from sq where guid_a = '{CONTROL}' and guid_b <> '{CONTROL}' and distance <= 310",
    "pairs_within_epsilon": _E + _D + _ALL + " where distance <= 16",
    "pairs_within_epsilon_sparse": _P + _D + _ALL + " where distance <= 40",
    "agreement": _E + _D + "select count(*)::bigint as matches, 0::bigint as mismatches from d where '0' in (guid_a, guid_b) and distance <= 26",
    "core": _counts(_TEN_LIST, ">= (1 - 0.3::double) * 10", "allele"),
    "core_counts": _counts(_TEN_LIST, ">= (1 - 0.7::double) * 10", "allele, count"),
    "core_bag": _counts("'1','1','2','3'", ">= (1 - 0.25::double) * 4", "allele, count"),
    "accessory": _counts(_TEN_LIST, "< (1 - 0.7::double) * 10", "allele"),
    "accessory_counts": _counts(_TEN_LIST, "< (1 - 0.5::double) * 10", "allele, count"),
    "unique": _P + f"z as (select 1) select allele from p group by allele having min(guid) = '{CONTROL}' and max(guid) = '{CONTROL}'",
    "common_legacy": _counts("'1','2'", "= 2", "allele"),
    "allele_carriers": _E + "z as (select 1) select guid from p where allele in ('1','2','3') group by guid having count(*) = 3",
    "allele_carriers_ignore": _E + "z as (select 1) select guid from p where allele in ('1','2') group by guid having count(*) = 2",
    "match_allele_names": f"with {_b('R', 'b')} select distinct allele from b where regexp_matches(allele, '^(?:Brand#[1-5]$)')",
    "match_allele_names_prefix": f"with {_b('R', 'b')} select distinct allele from b where regexp_matches(allele, '^(?:Brand#1.*)')",
    "access": _E
    + "k as (select * from (values "
    + ", ".join(f"({i}::bigint, {r}::bigint, {c}::bigint)" for i, (r, c) in enumerate(COORDS))
    + ") t(pos, row_idx, col_idx)) select pos, row_idx, col_idx, (p.r is not null)::int as value from k left join p on p.r = row_idx and p.c = col_idx",
    "access_guid": _E + "z as (select 1) select c as col_idx from p where r = 3",
    "gather_snps": _E + "b as (select unnest([1, 1, 4]) as r) select c as col_idx from p join b using (r)",
    "coordinates": _E + "z as (select 1) select r as row_idx, unnest([1, 2])::int as col_idx from g",
    "subset_by_guid": _E + "z as (select 1) select guid, allele from p where guid in ('1','2','3')",
    "remove_guid": _E + "z as (select 1) select guid, allele from p where guid <> '0'",
    "zero_column_drop": _P + "z as (select 1) select allele from a where allele in (select allele from p)",
    "to_dict": _P + "z as (select guid, list_sort(list(allele)) as alleles from p group by guid) select l.guid, coalesce(alleles, []) as alleles from l left join z using (guid)",
    "stats": _P
    + """z as (select (select count(*) from l)::bigint as n, (select count(*) from a)::bigint as m)
select n as n_guids, m as n_alleles, case when n * m < 1048576 then printf('%.1f KiB', n * m / 1024.0) when n * m < 1073741824 then printf('%.1f MiB', n * m / 1048576.0)
  else printf('%.1f GiB', n * m / 1073741824.0) end as matrix_size from z""",
    "to_dense": f"with {_b('R', 'b')} select x.guid, y.allele, (b.guid is not null)::int as value from (select distinct guid from b) x cross join (select distinct allele from b) y left join b on b.guid = x.guid and b.allele = y.allele",
    "to_dataframe": f"""with {_b('R', 'b')}, w as (select guid, allele, 1 as v from b)
select guid, {", ".join(f"max(case when allele = 'Brand#{n}' then 1 else 0 end)::int as \"Brand#{n}\"" for n in range(1, 26))} from w group by guid""",
    "merge_matrices": f"with {_b('R', 'b')}, {_b('A', 'k')} select * from b union select * from k",
    "merge_matrices_sum": f"with {_b('R', 'b')}, {_b('A', 'k')} select guid, allele, count(*)::int as value from (select * from b union all select * from k) group by 1, 2",
    "unique_per_sample": _P + """u as (select min(guid) as guid from p group by allele having count(*) = 1), n as (select guid, count(*) as n from u group by guid)
select g.guid, mass::bigint as total, coalesce(n, 0)::bigint as "unique" from g left join n using (guid)""",
    "alleles_by_contig": _P + "z as (select 1) select split_part(allele, '.', 1) as contig, list_sort(list(allele)) as alleles from a group by 1",
    "symmetric_difference": _E + "z as (select 1) select allele from p where guid in ('1','2') group by allele having count(*) = 1",
    "union_alleles": _E + "z as (select 1) select distinct allele from p where guid in ('1','2')",
    "arriving_neighbours": _P
    + """s as (select distinct strain_id as query, upper(trim(a)) as allele from (select strain_id, unnest(alleles) as a from strains) where a is not null),
n as (select strain_id as query, count(distinct allele) as qm from strains left join s on s.query = strain_id group by 1),
k as (select query, guid, count(*) as c from s join p using (allele) group by 1, 2)
select n.query, g.guid, (qm + mass - 2 * coalesce(c, 0))::int as distance from n join g on true left join k on k.query = n.query and k.guid = g.guid
where qm + mass - 2 * coalesce(c, 0) <= 60""",
    **dict.fromkeys(
        ("csv_round_trip", "parquet_wide_round_trip", "npy_round_trip", "memory_source", "pandas_source", "unpivot_wide"),
        _E + "z as (select 1) select guid, allele from p",
    ),
    "csv_label_order": _E + "z as (select 1) select r as row_idx, guid from g",
    "parquet_long_round_trip": _P + "z as (select 1) select guid, allele from p",
    "vcf_round_trip": _E + "z as (select 1) select guid, 'c.' || (c + 1) || '.C' as allele from p",
    "vcf_columns": _E
    + "n as (select c, count(*) as n from p group by c), t as (select count(*) as t from g) select 'c.' || (c + 1) || '.C' as allele from n union all select 'c.' || (c + 1) || '.A' from n, t where n < t",
    "bed_round_trip": _E + "z as (select 1) select 'c' as chrom, c::bigint as \"start\", (c + 1)::bigint as \"end\", 'c.' || (c + 1) || '.C' as description, (2 * count(*))::bigint as copies from p group by c",
    "fasta_round_trip": "with x as (select vec_id::varchar as name, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) select name, string_agg(case when embedding[i] > 0 then 'C' else 'A' end, '' order by i) as sequence from x group by name",
    "distances_csv": _E + _D + _ALL,
    "wide_distances": _E + _D + _BOTH + "select guid_a, " + ", ".join(f"max(case when guid_b = '{i}' then distance end)::int as \"{i}\"" for i in range(10)) + f" from sq where guid_a in {_TEN} group by guid_a",
    "loaded_matrices": """with p as (select distinct upper(trim(guid)) as guid, upper(trim(allele)) as allele from presence where guid is not null and allele is not null),
hg as (select distinct matrix_id, upper(trim(x)) as guid from (select matrix_id, unnest(guids) as x from headers) where x is not null),
ha as (select distinct matrix_id, upper(trim(x)) as allele from (select matrix_id, unnest(alleles) as x from headers) where x is not null),
n as (select hg.matrix_id, count(*) as n from p join hg on hg.guid = p.guid join ha on ha.matrix_id = hg.matrix_id and ha.allele = p.allele group by 1),
cg as (select matrix_id, count(*) as n from hg group by 1), ca as (select matrix_id, count(*) as n from ha group by 1)
select h.matrix_id, coalesce(cg.n, 0)::bigint as n_guids, coalesce(ca.n, 0)::bigint as n_alleles, coalesce(n.n, 0)::bigint as n_cells
from (select distinct matrix_id from headers) h left join cg on cg.matrix_id = h.matrix_id left join ca on ca.matrix_id = h.matrix_id left join n on n.matrix_id = h.matrix_id""",
    "label_codes": _E + f"z as (select 1) select guid as label, r as idx, guid as again from g where guid in {_TEN}",
    "split_labels": _E + f"z as (select 1) select guid as label, true as known from g where guid in {_TEN} union all select 'nobody', false",
    "neighbourhood_sorted": _E + _D + _BOTH + "select guid_b as guid, distance from sq where guid_a = '0' and guid_b <> '0' and distance <= 24",
    "threshold_slice": _E + _D + _BOTH + "select guid_b as guid, distance from sq where guid_a = '0' and guid_b <> '0' and distance < 24",
    "common_of_unknown": _P + "z as (select 1) select allele from p group by allele having count(*) = (select count(*) from l)",
    "match_presence_names": _P + "z as (select 1) select allele from a where regexp_matches(allele, '^(?:[^.]+.[0-9].*7.[AC]$)')",
    "to_dense_embeddings": _E + "z as (select 1) select g.guid, k.allele, (p.guid is not null)::int as value from g cross join (select distinct c, c::varchar as allele from (select unnest(range(0, 64)) as c)) k left join p on p.guid = g.guid and p.allele = k.allele",
    "generated_sparse": "select 'sample_' || i as guid, 20::int as mass from range(500) t(i)",
    "generated_clusters": "select false as empty, 100::bigint as count union all select true, 7::bigint",
    "generated_coordinates": "select 1000::bigint as n, true as rows, true as cols",
}
_S = "s as (select distinct strain_id as guid, upper(trim(a)) as allele from (select strain_id, unnest(alleles) as a from strains) where a is not null)"
ORACLE |= {
    "stats_json": ORACLE["unique_per_sample"],
    "unique_legacy": ORACLE["unique"],
    "merge_presence": _P + _S + " select guid, allele from p union select guid, allele from s",
    "merge_presence_sum": _P + _S + " select guid, allele, count(*)::int as value from (select guid, allele from p union all select guid, allele from s) group by 1, 2",
}
