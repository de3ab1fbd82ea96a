"""The matrix: cells that are 1 as a long table, with two ordered tables of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presq.functions.bits import human_bytes
from presq.operators import algebra, distance, lookup
from presq.plans.index import with_index


def _renumbered(labels: DataFrame, idx: str) -> DataFrame:
    return with_index(labels.withColumnRenamed(idx, "_old"), "_old", idx).drop("_old")


class AlleleFrame:
    """presence(guid, allele), guids(row_idx, guid, mass) and alleles(col_idx, allele), bound lazily.

    Width is data, not schema: an allele is a value, never a column. Rows and columns without a cell live in the
    label tables alone.
    """

    def __init__(self, presence: DataFrame, guids: DataFrame, alleles: DataFrame):
        self.spark: SparkSession = presence.sparkSession
        self.presence = presence.select("guid", "allele")
        self.alleles = alleles.select("col_idx", "allele")
        counted = self.presence.groupBy("guid").agg(F.count("*").alias("n"))
        mass = F.coalesce("n", F.lit(0)).cast("int").alias("mass")
        self.labels = guids.select("row_idx", "guid")
        self.guids = self.labels.join(counted, "guid", "left").select("row_idx", "guid", mass)
        self._sizes: dict[str, int] = {}
        self._cached: dict[str, DataFrame] = {}

    @classmethod
    def from_cells(cls, cells: DataFrame, guids: DataFrame | None = None, alleles: DataFrame | None = None) -> AlleleFrame:
        """From cells(guid, allele), repeats allowed, with optional label tables(guid) and (allele); labels are numbered in order."""
        cells = cells.where(F.col("guid").isNotNull() & F.col("allele").isNotNull()).select("guid", "allele").distinct()
        g = cells.select("guid") if guids is None else cells.select("guid").union(guids.select("guid"))
        a = cells.select("allele") if alleles is None else cells.select("allele").union(alleles.select("allele"))
        return cls(cells, with_index(g.distinct(), "guid", "row_idx"), with_index(a.distinct(), "allele", "col_idx"))

    def validate(self) -> AlleleFrame:
        """Rejects repeated labels, repeated cells and cells without a label."""
        for dim, name in ((self.guids, "guid"), (self.alleles, "allele")):
            twice = dim.groupBy(name).count().where("count > 1").first()
            if twice:
                raise ValueError(f"repeated {name}: {twice[0]}")
            if self.presence.join(dim, name, "left_anti").first():
                raise ValueError(f"a cell has an unknown {name}")
        if self.presence.groupBy("guid", "allele").count().where("count > 1").first():
            raise ValueError("a cell is given twice")
        return self

    def persist(self) -> AlleleFrame:
        self.presence, self.guids, self.alleles = self.presence.persist(), self.guids.persist(), self.alleles.persist()
        self.labels = self.guids.select("row_idx", "guid")
        return self

    def create_views(self) -> AlleleFrame:
        """Temporary views presence, guids and alleles for SQL."""
        for name in ("presence", "guids", "alleles"):
            getattr(self, name).createOrReplaceTempView(name)
        return self

    def n_guids(self) -> int:
        if "g" not in self._sizes:
            self._sizes["g"] = self.labels.count()
        return self._sizes["g"]

    def n_alleles(self) -> int:
        if "a" not in self._sizes:
            self._measure_alleles()
        return self._sizes["a"]

    def width(self) -> int:
        """One more than the greatest column number."""
        if "w" not in self._sizes:
            self._measure_alleles()
        return self._sizes["w"]

    def _measure_alleles(self) -> None:
        n, top = self.alleles.agg(F.count("*"), F.max("col_idx")).first()
        self._sizes |= {"a": n, "w": (top or 0) + 1}

    def indexed(self) -> DataFrame:
        """(row_idx, col_idx) of every cell."""
        g, a = self.labels, self.alleles.select("col_idx", "allele")
        return self.presence.join(g, "guid").join(a, "allele").select("row_idx", "col_idx")

    def _check(self, values, dim: DataFrame, name: str) -> list[str]:
        asked = [str(v) for v in values]
        known = {r[0] for r in dim.where(F.col(name).isin(sorted(set(asked)))).select(name).distinct().collect()}
        if missing := sorted(set(asked) - known):
            raise ValueError(f"unknown {name}: {missing[:10]}")
        return asked

    def check_guids(self, guids) -> list[str]:
        return self._check(guids, self.labels, "guid")

    def check_alleles(self, alleles) -> list[str]:
        return self._check(alleles, self.alleles, "allele")

    def split_labels(self, values, what: str = "guid") -> tuple[list[str], list[str]]:
        """Those of values that the matrix has, in matrix order, and those that it hasn't, in the order given."""
        dim, idx = (self.labels, "row_idx") if what == "guid" else (self.alleles, "col_idx")
        asked = list(dict.fromkeys(str(v) for v in values))
        known = [r[0] for r in dim.where(F.col(what).isin(asked)).orderBy(idx).select(what).collect()]
        return known, [v for v in asked if v not in set(known)]

    def known_guids(self, guids) -> list[str]:
        """Those of guids that the matrix has."""
        return [r.guid for r in self.guids.where(F.col("guid").isin([str(g) for g in guids])).orderBy("row_idx").select("guid").collect()]

    # distances
    def pairwise(self, guids=None, metric: str = "hamming", chunk_size: int | None = None, keep: bool = False) -> DataFrame:
        """(guid_a, guid_b, distance) of every pair once; chunk_size has no effect. With keep the pairs stay until flush_cache()."""
        key = f"{metric}:{sorted(guids) if guids else ''}"
        if key in self._cached:
            return self._cached[key]
        pairs = distance.pairwise(self, metric, guids or None)
        if keep:
            self._cached[key] = pairs = pairs.persist()
        return pairs

    def pairwise_known(self, guids, metric: str = "hamming") -> DataFrame:
        """pairwise() of those of guids that the matrix has; with none of them KeyError, with one ValueError."""
        known, _ = self.split_labels(guids)
        if not known:
            raise KeyError("none of the guids is known")
        if len(known) == 1:
            raise ValueError("a pair takes two known guids")
        return self.pairwise(known, metric)

    def square_matrix(self, guids=None, metric: str = "hamming") -> DataFrame:
        g = self.guids.where(F.col("guid").isin(list(guids))) if guids else self.guids
        return distance.square(self.pairwise(guids, metric), g)

    def neighbourhood(self, guid: str, n: int, simd: bool = True, include_self: bool = False, order_by: str | None = None) -> DataFrame:
        """(guid, distance) within n of guid; simd has no effect."""
        return distance.neighbourhood(self, guid, n, include_self, order_by)

    def pairs_within(self, n: int) -> DataFrame:
        return distance.pairs_within(self, n)

    def flush_cache(self) -> None:
        for df in self._cached.values():
            df.unpersist()
        self._cached.clear()

    # set algebra
    def core(self, guids, missingness: float = 0.0, return_counts: bool = False) -> DataFrame:
        out = algebra.core(self, guids, missingness)
        return out if return_counts else out.select("allele")

    def accessory(self, guids, missingness: float = 0.0, return_counts: bool = False) -> DataFrame:
        out = algebra.accessory(self, guids, missingness)
        return out if return_counts else out.select("allele")

    def unique(self, guids, on_unknown: str = "error") -> DataFrame:
        """As algebra.unique; with ignore, unknown guids are left out, and with none left all samples are meant."""
        if on_unknown == "ignore":
            guids = self.known_guids(guids)
            if not guids:
                return algebra.carried_by_all(self)
        return algebra.unique(self, guids)

    def common(self, guids) -> DataFrame:
        """(allele) that all of the known guids carry; with none known, that all samples do."""
        known = self.known_guids(guids)
        return self.core(known) if known else algebra.carried_by_all(self)

    def allele(self, alleles, on_unknown: str = "error") -> DataFrame:
        return algebra.carriers(self, alleles, on_unknown)

    def unique_per_sample(self) -> DataFrame:
        return algebra.unique_per_sample(self)

    def by_contig(self) -> DataFrame:
        return algebra.by_contig(self)

    def merge(self, other: AlleleFrame) -> AlleleFrame:
        """Outer union of two matrices: a cell is 1 where either has it."""
        cells = algebra.merge(self.presence, other.presence)
        return AlleleFrame.from_cells(cells, self.guids.select("guid").union(other.guids.select("guid")), self.alleles.select("allele").union(other.alleles.select("allele")))

    # lookups
    def access(self, coords) -> DataFrame:
        return lookup.access(self, coords)

    def access_guid(self, row_idx: int) -> DataFrame:
        return lookup.signature(self, row_idx)

    def gather_snps(self, row_indices) -> DataFrame:
        return lookup.gather(self, row_indices)

    def match_allele_names(self, expression: str) -> DataFrame:
        return lookup.match_names(self, expression)

    def coordinates(self, alleles=None, guids=None) -> DataFrame:
        return lookup.coordinates(self, alleles, guids)

    def subset_by_guid(self, guids) -> AlleleFrame:
        """Rows of the known guids in matrix order, without columns that are zero in all of them; numbered anew."""
        g = self.guids.where(F.col("guid").isin([str(x) for x in guids]))
        p = self.presence.join(g.select("guid"), "guid", "left_semi")
        return AlleleFrame(p, _renumbered(g, "row_idx"), self.alleles).without_zero_columns()

    def remove_guid(self, guid: str) -> AlleleFrame:
        self.check_guids([guid])
        return AlleleFrame(self.presence.where(F.col("guid") != guid), _renumbered(self.guids.where(F.col("guid") != guid), "row_idx"), self.alleles)

    def without_zero_columns(self) -> AlleleFrame:
        own = self.alleles.join(self.presence.select("allele").distinct(), "allele", "left_semi")
        return AlleleFrame(self.presence, self.guids, _renumbered(own, "col_idx"))

    # counts and exports
    def snp_count(self) -> DataFrame:
        return self.guids.select("guid", "mass")

    def stats(self) -> dict:
        n, m = self.n_guids(), self.n_alleles()
        return {"n_guids": n, "n_alleles": m, "matrix_size": human_bytes(n * m)}

    def to_dict(self) -> DataFrame:
        """(guid, alleles): each sample's alleles, sorted."""
        sets = self.presence.groupBy("guid").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))
        return self.guids.join(sets, "guid", "left").select("guid", F.coalesce("alleles", F.array().cast("array<string>")).alias("alleles"))

    def to_dense(self) -> DataFrame:
        """(guid, allele, value) of every cell of the matrix, zeros included."""
        every = self.guids.select("guid").crossJoin(self.alleles.select("allele"))
        ones = self.presence.withColumn("value", F.lit(1))
        return every.join(ones, ["guid", "allele"], "left").select("guid", "allele", F.coalesce("value", F.lit(0)).cast("int").alias("value"))

    def get_headers(self) -> dict:
        guids = [r.guid for r in self.labels.orderBy("row_idx").select("guid").collect()]
        return {"guids": guids, "alleles": [r.allele for r in self.alleles.orderBy("col_idx").select("allele").collect()]}

    def get_matrix(self, max_cells: int = 200_000_000):
        """The dense uint8 array; refused above max_cells."""
        import numpy as np

        n, m = self.n_guids(), self.n_alleles()
        if n * m > max_cells:
            raise ValueError(f"{n} x {m} cells are more than max_cells; write the matrix with presq.sources.writers instead")
        out = np.zeros((n, m), np.uint8)
        ranks = [dict_of.orderBy(c).select(c).toArrow()[c].to_numpy() for dict_of, c in ((self.labels, "row_idx"), (self.alleles, "col_idx"))]
        cells = self.indexed().toArrow()
        out[np.searchsorted(ranks[0], cells["row_idx"].to_numpy()), np.searchsorted(ranks[1], cells["col_idx"].to_numpy())] = 1
        return out

    def to_dataframe(self, max_columns: int = 10_000) -> DataFrame:
        """One column per allele, in order, with the guid first; refused above max_columns."""
        if self.n_alleles() > max_columns:
            raise ValueError("too many alleles for columns; use presence or to_dense()")
        names = self.get_headers()["alleles"]
        wide = self.guids.select("guid").join(self.presence.withColumn("_one", F.lit(1)), "guid", "left")
        wide = wide.groupBy("guid").pivot("allele", names).agg(F.max("_one")).fillna(0)
        return wide.join(self.guids.select("guid", "row_idx"), "guid").orderBy("row_idx").drop("row_idx")

    # names of the matrix API that this engine stands in for
    snpCount, toDict, toDataFrame, getMatrix, getHeaders = snp_count, to_dict, to_dataframe, get_matrix, get_headers
    matchAlleleNames, subsetbyGUID, removeGUID, flushCache = match_allele_names, subset_by_guid, remove_guid, flush_cache
    accessGUID, gatherSNPs = access_guid, gather_snps
