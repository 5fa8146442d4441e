"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table distances, exact cosine.

Equal vectors of a label are one row with a count. A coarse centroid names the inverted list of a vector; what is left after
taking the centroid away is cut into subspaces and each part is coded by its nearest codeword. Centroids and codewords are
fitted on a bounded sample (``SAMPLE`` vectors a list, ``MAX_SAMPLE`` in all), but every vector is indexed. A vector probes its
own list and every later list whose bisecting plane lies within ``reach`` of it, so of two linked vectors the one with the
earlier list finds the other. In a list, distances come from a table of the vector's residual parts to all codewords; a
vector passes if the distance is at most the link's plus the coded vector's own error (triangle inequality, so the codes
lose nothing), and only then its exact cosine is taken in double precision.

``reach`` is a share of the link's distance. 1 loses no link at all. The default ``4 / sqrt(dimensions)``, at most 1, allows for four
standard deviations of a displacement in a random direction; the tests measure its recall.

Lists are dealt in blocks of vectors and of probes, so no task holds a whole list; links are counted and joined to stars
inside a task, never written as pairs. All comparisons stay within one label and one number of dimensions.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing:
``n_links`` 0 and their own id as component. Repeated rows are each returned and link with each other; a null id never names a component unless
it has no other. An empty table gives no rows. Very long vectors only cost memory a block. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, python_ready
from tallyfold.llm.simhash import connected

COSINE = 0.93
LIST_ROWS, MAX_LISTS = 1024, 4096  # vectors of the largest label for each list, about
SAMPLE, LEAST_SAMPLE, MAX_SAMPLE = 16, 8192, 65536
PART, CODES = 4, 256  # dimensions of a subspace, codewords of each
BLOCK, PROBES, CHUNK = 4096, 16384, 256
SLACK = 1e-9  # of distances, above any rounding
KEY = ("label", "dim", "list")


def unit(vectors: list | np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that no square overflows."""
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    d = np.einsum("ij,ij->i", points, points)[:, None] - 2 * points @ centres.T + np.einsum("ij,ij->i", centres, centres)[None, :]
    return np.maximum(d, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(points[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, dtype=np.int64)


def k_means(points: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most k centres; they start at points spread evenly over the sample."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(np.int64)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=points[:, j], minlength=len(centres)) for j in range(points.shape[1])], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Index:
    """Coarse centroids and the codewords of each subspace, fitted on unit vectors of one number of dimensions."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, reach: float | None):
        self.coarse = k_means(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        dims = sample.shape[1]
        self.cuts = [(i, min(i + PART, dims)) for i in range(0, dims, PART)]
        self.words = [k_means(rest[:, a:b], CODES) for a, b in self.cuts]
        self.limit = math.sqrt(2 - 2 * cosine)
        self.reach = self.limit * min(1.0, 4 / math.sqrt(dims) if reach is None else reach) + SLACK

    def encode(self, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance from each vector to what its code stands for."""
        rest = units - self.coarse[own]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.cuts, self.words, strict=True)], axis=1).astype(np.uint8)
        gone = np.concatenate([rest[:, a:b] - w[codes[:, j]] for j, ((a, b), w) in enumerate(zip(self.cuts, self.words, strict=True))], axis=1)
        return codes, np.sqrt(np.einsum("ij,ij->i", gone, gone))

    def probes(self, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the own list and the later ones whose bisecting plane is within reach."""
        d = squares(units, self.coarse)
        apart = np.sqrt(squares(self.coarse, self.coarse))[own]
        beyond = d - d[np.arange(len(units)), own][:, None] <= 2 * self.reach * apart
        beyond &= np.arange(len(self.coarse))[None, :] >= own[:, None]
        beyond[np.arange(len(units)), own] = True
        return np.nonzero(beyond)

    def table_distances(self, units: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances from each vector to what the codes of list ``at`` stand for."""
        rest, out = units - self.coarse[at], np.zeros((len(units), len(codes)))
        for j, ((a, b), w) in enumerate(zip(self.cuts, self.words, strict=True)):
            out += squares(rest[:, a:b], w)[:, codes[:, j]]
        return np.sqrt(out)


def linked(units: np.ndarray, others: np.ndarray, maybe: np.ndarray, cosine: float) -> np.ndarray:
    """Exact cosines of the pairs in ``maybe``: which of them link."""
    rows, cols = np.nonzero(maybe)
    if len(rows) * 8 > maybe.size:
        return maybe & (units @ others.T >= cosine)
    sure = np.zeros_like(maybe)
    for i in range(0, len(rows), 1 << 15):
        r, c = rows[i : i + (1 << 15)], cols[i : i + (1 << 15)]
        sure[r, c] = np.einsum("ij,ij->i", units[r], others[c]) >= cosine
    return sure


def stars(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least linked row of each row and column of a link matrix, over whole components; rows and columns without links get -1."""
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    own, of_col = np.full(links.shape[0], -1), np.full(links.shape[1], -1)
    part, label, far = links[np.ix_(rows, cols)], rows.copy(), links.shape[0]
    while len(rows):
        by_col = np.where(part, label[:, None], far).min(axis=0)
        new = np.where(part, by_col[None, :], far).min(axis=1)
        if (new == label).all():
            own[rows], of_col[cols] = label, by_col
            break
        label = new
    return own, of_col


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component over the edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def search_block(part: pd.DataFrame, index: Index, cosine: float) -> pd.DataFrame:
    """Links between the probes and the vectors of one block: ``cid, links, root`` of all that link."""
    home, probe = part[part["home"]].sort_values("cid"), part[~part["home"]].sort_values("cid")
    none = pd.DataFrame({"cid": np.zeros(0, dtype=np.int64), "links": np.zeros(0, dtype=np.int64), "root": np.zeros(0, dtype=np.int64)})
    if home.empty or probe.empty:
        return none
    at, units = int(part["list"].iloc[0]), unit(home["v"])
    codes, errors = np.frombuffer(b"".join(home["code"]), dtype=np.uint8).reshape(len(home), -1), home["error"].to_numpy()
    ids, weights = home["cid"].to_numpy(), home["m"].to_numpy()
    probe_ids, probe_weights, probe_own = probe["cid"].to_numpy(), probe["m"].to_numpy(), probe["own"].to_numpy()
    nodes = np.unique(np.concatenate([ids, probe_ids]))
    counts, a, b = np.zeros(len(nodes), dtype=np.int64), [], []
    node, probe_node = np.searchsorted(nodes, ids), np.searchsorted(nodes, probe_ids)
    for i in range(0, len(probe), CHUNK):
        cut = slice(i, i + CHUNK)
        own = unit(probe["v"].iloc[cut])
        maybe = index.table_distances(own, at, codes) <= index.limit + errors[None, :] + SLACK
        maybe &= (probe_own[cut, None] != at) | (probe_ids[cut, None] < ids[None, :])
        links = linked(own, units, maybe, cosine)
        np.add.at(counts, probe_node[cut], links @ weights)
        np.add.at(counts, node, probe_weights[cut] @ links)
        of_row, of_col = stars(links)
        for own_nodes, label in ((probe_node[cut], of_row), (node, of_col)):
            a.append(own_nodes[label >= 0])
            b.append(probe_node[cut][label[label >= 0]])
    label = least_labels(len(nodes), np.concatenate(a), np.concatenate(b))
    some = counts > 0
    return pd.DataFrame({"cid": nodes[some], "links": counts[some], "root": nodes[label][some]})


def fit(distinct: DataFrame, dim: int, cosine: float, reach: float | None) -> Index:
    """The index for the vectors of ``dim`` dimensions; the sample is bounded and the lists grow with the largest label."""
    own = distinct.where(F.col("dim") == dim)
    largest = own.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    lists = min(MAX_LISTS, max(1, math.ceil(largest / LIST_ROWS)))
    size = min(MAX_SAMPLE, max(LEAST_SAMPLE, SAMPLE * lists))
    rows = own.orderBy(F.xxhash64("v"), "cid").select("v").limit(size).toPandas()["v"]
    return Index(unit(rows), lists, cosine, reach)


def place(distinct: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """A row for each vector in its own list (``home``, with code and error) and one for each list that it probes."""
    spark = distinct.sparkSession
    sent = spark.sparkContext.broadcast(indexes)
    kind = dict(distinct.dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                index, units = sent.value[dim], unit(part["v"])
                own = nearest(units, index.coarse)
                codes, errors = index.encode(units, own)
                yield part.assign(list=own, own=own, home=True, code=[c.tobytes() for c in codes], error=errors)
                rows, lists = index.probes(units, own)
                for i in range(0, len(rows), 4096):
                    r = rows[i : i + 4096]
                    yield part.iloc[r].assign(list=lists[i : i + 4096], own=own[r], home=False, code=None, error=0.0)

    schema = f"label {kind['label']}, dim int, cid long, m long, v {kind['v']}, list int, own int, home boolean, code binary, error double"
    return materialize(distinct.select("label", "dim", "cid", "m", "v").mapInPandas(assign, schema))


def dealt(placed: DataFrame) -> DataFrame:
    """``placed`` with ``block`` and ``turn``: each block of a list's vectors meets each block of its probes once."""
    blocks = lambda kind, size: F.ceil(F.count_if(kind) / F.lit(size)).cast("int")
    sizes = materialize(placed.groupBy(*KEY).agg(blocks(F.col("home"), BLOCK).alias("blocks"), blocks(~F.col("home"), PROBES).alias("turns")).where("blocks > 0 and turns > 0"))
    rows = placed.join(sizes, list(KEY))
    mine = lambda n: F.array(F.pmod(F.xxhash64("cid"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("home"), mine("blocks")).otherwise(every("blocks"))))
    return rows.withColumn("turn", F.explode(F.when(F.col("home"), every("turns")).otherwise(mine("turns")))).drop("blocks", "turns")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, reach: float | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: links of a cosine of ``cosine`` or more within a label."""
    spark = vectors.sparkSession
    python_ready(spark)
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    valid = F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(valid, F.col(label)).alias("label"), F.when(valid, x).alias("v"))
    once = rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    distinct = materialize(once.select("label", "v", F.size("v").alias("dim"), "m", "least", F.monotonically_increasing_id().alias("cid")))
    # one index for each number of dimensions, usually one in all
    indexes = {r["dim"]: fit(distinct, r["dim"], cosine, reach) for r in distinct.select("dim").distinct().collect()}
    sent = spark.sparkContext.broadcast(indexes)

    def search(part: pd.DataFrame) -> pd.DataFrame:
        return search_block(part, sent.value[int(part["dim"].iloc[0])], cosine)

    found = materialize(dealt(place(distinct, indexes)).groupBy(*KEY, "block", "turn").applyInPandas(search, "cid long, links long, root long"))
    roots = connected(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = materialize(distinct.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = materialize(named.join(least, "root").select("label", "v", "n_links", "component_id"))
    out = rows.join(classes, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
