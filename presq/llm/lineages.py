"""Problem 4: grouping records into similarity clusters.

Method: power-iteration spectral clustering, in rounds. Each record is linked to the hubs that it shares most rare
tokens with; similarities of links that reach the threshold are the sparse affinities. They are normalised by their
row sums, and several vectors of random start values are iterated with the lazy walk until they stand still: they then
are the same within a cluster and differ between clusters. k-means of the embedding gives the groups: equal places
are one weighted point, k-means over all points parts them coarsely, and k-means within each part takes as many
centres as there are points further apart than a radius, so that the number of groups comes from the data.

The embedding alone says who belongs together. The exact similarity to the group's most central member only verifies it:
a record that fails leaves its group and stands for itself. The most central members and the records on their own are
the records of the next round, with other hubs and other start values, until a round finds no affinity between any.
Similarity is taken to be transitive at the threshold, as a verified group is described by one member.

Members of the final clusters are ranked by their internal affinity: the sum of the cosine similarities of their sets,
|A and B| / sqrt(|A| |B|), to all other members, copies included. It is exact and linear in the cells, as the sums over
a cluster are taken token by token.

Links are linear in the data (no pairs within a token's records), and equal sets are one vertex. Nothing is broadcast
by hint; nothing but k-means centres, MOST_CENTRES at most, reaches the driver.
Defined cases: as for sets in general; a record similar to no other is its own cluster; empty tables give no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presq.llm.sets import classes, jaccard, reaches
from presq.plans.shared import drop_table, materialize

VECTORS = 6
#: Share of a record's own value that a step of the walk keeps: without it a star of links would swing for ever.
LAZY = 0.3
#: Steps between two looks at the vectors, and the most steps of a round; what isn't at rest then is met in the next round.
STEPS = 4
MOST_STEPS = 12
#: A value is at rest when a step moves it by no more than this.
REST = 1e-4
#: Values of the walk are whole multiples of 1 / FIXED; twice the sum of a record's weights fits into 32 bits.
FIXED = 1 << 30
#: Places of the embedding are told apart on this grid; k-means joins those within RADIUS of a centre.
GRID = 5e-3
RADIUS = 5e-2
#: Hubs kept per record, those that it shares most rare tokens with: the sparsity of the affinity matrix. Later rounds
#: have few records and keep more.
HUBS = 2
LATER_HUBS = 16
#: Places that one task clusters, and centres of a coarse k-means.
PLACES = 400
MOST_CENTRES = 1000
SEED = 7


def affinities(units: DataFrame, n: int, threshold: Fraction, hubs: int = HUBS, seed: int = SEED, ends: int = 1) -> DataFrame:
    """(a, b, w): similarities of units(num, tokens), n in all, to the hubs of their tokens, those that reach the threshold.

    A token's hub is the record first in a random order among its records, with ends = 2 the last one too; records of
    one cluster share hubs. Shared tokens count by their rarity.
    """
    cell = units.select("num", F.explode("tokens").alias("t"))
    # numbers are hashes, so their order after flipping some bits is random, and the number can be read back from its place
    flip = F.xxhash64(F.lit(seed))
    place = F.col("num").bitwiseXOR(flip)
    picked = [F.min(place).bitwiseXOR(flip), F.max(place).bitwiseXOR(flip)][:ends]
    hub = cell.groupBy("t").agg(F.count("*").alias("c"), F.array_distinct(F.array(*picked)).alias("hubs")).where("c > 1")
    hub = hub.select("t", (1 - F.col("c") / F.lit(float(n + 1))).alias("rarity"), F.explode("hubs").alias("hub"))
    shared = cell.join(hub, "t").where("num <> hub").groupBy("num", "hub").agg(F.round(F.sum("rarity"), 6).alias("s"))
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("num").orderBy(F.desc("s"), "hub"))).where(F.col("r") <= hubs)
    best = materialize(best.select(F.col("num").alias("a"), F.col("hub").alias("b")), "p4-hubs")
    ta = units.select(F.col("num").alias("a"), F.col("tokens").alias("ta"))
    tb = units.select(F.col("num").alias("b"), F.col("tokens").alias("tb"))
    near = best.join(ta, "a").join(tb, "b").where(reaches("ta", "tb", threshold)).select("a", "b", jaccard("ta", "tb").alias("w"))
    out = materialize(near, "p4-affinities")
    drop_table(best)
    return out


def _packed(values: list) -> list:
    """Columns of values from 0 to 1, two in a whole number, so that sums of weighted values stay apart."""
    fixed = [F.round(x * FIXED).cast("long") for x in values] + [F.lit(0).cast("long")] * (len(values) % 2)
    return [F.shiftleft(fixed[i], 32) + fixed[i + 1] for i in range(0, len(fixed), 2)]


def _unpacked(columns: list, n: int) -> list:
    halves = [x for c in columns for x in (F.shiftright(c, 32), c.bitwiseAND(F.lit((1 << 32) - 1)))]
    return [x / F.lit(float(FIXED)) for x in halves[:n]]


def power_vectors(links: DataFrame, vectors: int = VECTORS, seed: int = SEED) -> DataFrame:
    """(num, v, d) of every linked record: the embedding, and the sum of its affinities.

    Each step replaces a record's values by their affinity-weighted mean over its links, and a share of its own. Values
    are moved in pairs, see _packed; as the weights of a record add up to 1, no sum leaves its half.
    """
    pairs = [f"p{i}" for i in range(-(-vectors // 2))]
    both = links.select("a", "b", "w").union(links.select("b", "a", "w")).distinct()
    degree = materialize(both.groupBy("a").agg(F.sum("w").alias("d")), "p4-degree")
    step = both.join(degree, "a").select("a", "b", (F.col("w") / F.col("d") * (1 - LAZY)).alias("w"))
    matrix = materialize(step.union(degree.select("a", F.col("a").alias("b"), F.lit(LAZY).alias("w"))), "p4-matrix")
    start = [(F.pmod(F.xxhash64("a", F.lit(seed + i)), F.lit(1 << 20)) / F.lit(float(1 << 20))) for i in range(vectors)]
    state, taken, before = degree.select(F.col("a").alias("num"), *[c.alias(x) for c, x in zip(_packed(start), pairs, strict=True)]), 0, None
    while taken < MOST_STEPS:
        for k in range(STEPS):
            met = matrix.join(state.withColumnRenamed("num", "b"), "b")
            weighted = _packed([F.col("w") * x for x in _unpacked([F.col(x) for x in pairs], vectors)])
            sums = [F.sum(c).alias(x) for c, x in zip(weighted, pairs, strict=True)]
            # in the last step the record's own row tells how far it moves
            old = [F.max(F.when(F.col("a") == F.col("b"), F.col(x))).alias(f"o{x}") for x in pairs if k == STEPS - 1]
            state = met.groupBy(F.col("a").alias("num")).agg(*sums, *old)
        now, then = (_unpacked([F.col(f"{o}{x}") for x in pairs], vectors) for o in ("", "o"))
        change = F.greatest(*[F.abs(x - y) for x, y in zip(now, then, strict=True)])
        state = materialize(state.select("num", *pairs, change.alias("change")), "p4-vectors")
        taken += STEPS
        restless = state.where(F.col("change") > REST).count()
        if restless == 0 or restless == before:
            break
        before = restless
        state = state.select("num", *pairs)
    values = F.array(*_unpacked([F.col(x) for x in pairs], vectors))
    return state.join(degree.withColumnRenamed("a", "num"), "num").select("num", values.alias("v"), "d")


def _centres(points: np.ndarray, weight: np.ndarray, radius: float) -> np.ndarray:
    """k-means within one part: each point's centre. The heaviest points left start centres until all lie within radius of one."""
    n, free, starts = len(points), np.ones(len(points), bool), []
    for i in np.lexsort((np.arange(n), -weight)).tolist():
        if free[i]:
            starts.append(i)
            free &= ((points - points[i]) ** 2).sum(1) > radius * radius
    centre = points[starts]
    for _ in range(3):
        own = np.concatenate([((points[s : s + 256, None] - centre[None]) ** 2).sum(2).argmin(1) for s in range(0, n, 256)])
        total = np.bincount(own, weight, len(centre))
        for d in range(points.shape[1]):
            mean = np.bincount(own, weight * points[:, d], len(centre))
            centre[:, d] = np.where(total > 0, mean / np.maximum(total, 1), centre[:, d])
    return own


def _cluster_part(table: pa.Table) -> pa.Table:
    """(cell, grp) of the places of one part."""
    table = table.sort_by("cell").combine_chunks()
    v = table["v"].chunk(0).flatten().to_numpy().reshape(table.num_rows, -1).copy()
    own = _centres(v, table["n"].to_numpy().astype(np.float64), RADIUS)
    return pa.table({"cell": table["cell"], "grp": pa.array(table["part"][0].as_py() * (1 << 24) + own.astype(np.int64))})


def groups(embedding: DataFrame, places: int = PLACES, seed: int = SEED) -> DataFrame:
    """(num, grp) of embedding(num, v) by k-means, first between parts of the places, then within each."""
    grid = F.transform("v", lambda x: F.round(x / GRID).cast("long"))
    keyed = embedding.select("num", F.xxhash64(grid).alias("cell"), "v")
    d = len(embedding.select("v").first().v)
    mean = F.array(*[F.avg(F.col("v")[i]) for i in range(d)])
    left = materialize(keyed.groupBy("cell").agg(F.count("*").alias("n"), mean.alias("v")), "p4-places")
    parted, level = None, 0
    while True:
        n = left.count()
        if n > places and level < 10:
            data = left.withColumn("features", array_to_vector("v"))
            model = KMeans(k=min(MOST_CENTRES, -(-2 * n // places)), seed=seed + level, maxIter=5, initSteps=2).fit(data)
            got = materialize(model.transform(data).select("cell", "n", "v", F.col("prediction").cast("long").alias("part")), "p4-parts")
            big = [r.part for r in got.groupBy("part").count().where(F.col("count") > 4 * places).collect()]  # MOST_CENTRES rows at most
        else:
            got, big = left.withColumn("part", F.lit(0).cast("long")), []
        done = got.where(~F.col("part").isin(big)).withColumn("part", F.col("part") + level * MOST_CENTRES)
        parted = done if parted is None else parted.union(done)
        if not big:
            break
        left, level = got.where(F.col("part").isin(big)).drop("part"), level + 1
    clustered = materialize(parted.groupBy("part").applyInArrow(_cluster_part, "cell long, grp long"), "p4-centres")
    return materialize(keyed.join(clustered, "cell").select("num", "grp"), "p4-groups")


def verified(units: DataFrame, embedding: DataFrame, grouped: DataFrame, threshold: Fraction) -> DataFrame:
    """(num, parent): the members of each group that reach the threshold to its most central member, the parent."""
    central = grouped.join(embedding.select("num", "d"), "num").groupBy("grp").agg(F.max(F.struct("d", "num")).alias("m"), F.count("*").alias("c"))
    central = central.where("c > 1").select("grp", F.col("m.num").alias("parent"))
    # the pairs first, by number, so that both sides read one exchange of the sets
    pairs = materialize(grouped.join(central, "grp").where(F.col("num") != F.col("parent")).select("num", "parent"), "p4-pairs")
    met = pairs.join(units.select("num", "tokens"), "num").join(units.select(F.col("num").alias("parent"), F.col("tokens").alias("tp")), "parent")
    return materialize(met.where(reaches("tokens", "tp", threshold)).select("num", "parent"), "p4-verified")


def internal_affinity(labelled: DataFrame, points: DataFrame, members: DataFrame) -> DataFrame:
    """(num, affinity): the sum of a record's cosine similarities to all other members of its cluster, by labelled(num, cluster_id).

    members are the copies of equal sets, which count one by one. A cluster's sums are kept by token, so no pair is met.
    """
    copies = members.groupBy(F.xxhash64("rep").alias("num")).agg(F.count("*").alias("w"))
    own = labelled.select("num", "cluster_id").join(copies, "num", "left").join(points.select("num", "tokens"), "num")
    root = F.sqrt(F.size("tokens").cast("double"))
    cell = own.select("num", "cluster_id", root.alias("root"), (F.coalesce("w", F.lit(1)) / root).alias("m"), F.explode("tokens").alias("t"))
    profile = cell.groupBy("cluster_id", "t").agg(F.sum("m").alias("total"))
    sums = cell.join(profile, ["cluster_id", "t"]).groupBy("num").agg((F.sum("total") / F.max("root")).alias("s"))
    # its similarity to itself is 1; rounded, as the order of addition varies
    return sums.select("num", F.round(F.col("s") - 1, 9).alias("affinity"))


def clusters(sets: DataFrame, threshold: str = "15/100", hubs: int = HUBS, places: int = PLACES, affinity: bool = True, report: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, cluster_id, affinity) of sets(id, kind, tokens), and the table of sets; cluster_id is the cluster's least id.

    Without affinity that column, and the sums that it takes, is left out. report gets a dict of counts per round.
    """
    t = Fraction(threshold)
    sets = materialize(sets.where(F.size("tokens") > 0), "p4-sets")
    reps, members = classes(sets, "p4-members")
    points = materialize(reps.select(F.xxhash64("rep").alias("num"), F.col("rep").alias("id"), "tokens"), "p4-points")
    units, n, turn, parents, still = points.select("num", "tokens"), points.count(), 0, [], 0
    while n > 1 and still < 2:
        first = turn == 0
        links = affinities(units, n, t, hubs if first else max(hubs, LATER_HUBS), SEED + 100 * turn, 1 if first else 2)
        moved, linked = None, links.count()
        if linked:
            embedding = power_vectors(links, seed=SEED + 100 * turn)
            grouped = groups(embedding, places, SEED + turn)
            moved = verified(units, embedding, grouped, t)
        joined = moved.count() if moved is not None else 0
        if report is not None:
            report.append({"records": n, "links": linked, "groups": grouped.agg(F.count_distinct("grp")).first()[0] if linked else 0, "joined": joined})
        turn += 1
        if not linked:
            break
        # links between units that don't join: other hubs get one more try
        still = 0 if joined else still + 1
        if joined:
            parents.append(moved)
            units = materialize(units.join(moved.select("num"), "num", "left_anti"), "p4-units")
            n -= joined
    labels = points.select("num", F.col("id").alias("rep"), F.col("num").alias("label"))
    for moved in parents:
        step = moved.select(F.col("num").alias("label"), "parent")
        labels = labels.join(step, "label", "left").select("num", "rep", F.coalesce("parent", "label").alias("label"))
    labelled = materialize(labels, "p4-labels")
    least = labelled.groupBy("label").agg(F.min("rep").alias("cluster_id"))
    named = labelled.join(least, "label")
    extra = []
    if affinity:
        named, extra = materialize(named.select("num", "rep", "cluster_id"), "p4-named"), ["affinity"]
        named = named.join(internal_affinity(named, points, members), "num")
    twin = members.select("rep", "id")
    return named.join(twin, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "cluster_id", *extra), sets


def described(clustered: DataFrame, top: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster's size and its most typical members, by internal affinity."""
    size = clustered.groupBy("cluster_id").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("affinity"), "id"))
    some = clustered.withColumn("r", rank).where(F.col("r") <= top)
    typical = some.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t")).select("cluster_id", F.col("t.id").alias("typical"))
    return size.join(typical, "cluster_id")
