"""Operator 1: near duplicates among embeddings by an inverted file with product quantisation.

Equal vectors are one class. Coarse centroids cut the classes into inverted lists; a class keeps, beside its list, codes
of its residual in a few subspaces and the length of what the codes leave. Every class is a query too. It probes the
lists whose border with its own list is near enough for a partner (a partner lies within sqrt(2 - 2*cosine); across a
border its offset has the standard deviation of that length over sqrt(dimensions), of which PROBE_DEVIATIONS are
granted; dimensions are those in which residuals really spread, so that clustered, flat data are probed wider). In a list, distances to codes come from tables; a class stays a candidate if by the triangle inequality it can
be near enough, which loses none. Candidates' cosines are computed from the vectors, in double precision.

A link counts where either of the two finds the other for the component, and for both by themselves for n_links; so wide
a border is granted that one finds the other and isn't found perhaps once in ten million links.

Centroids and codes are fitted on the driver, on a bounded sample (SAMPLE_PER_LIST classes for each list, SAMPLE_LEAST at
least, 65,536 at most: those of the least hashes), and there are MOST_LISTS lists at most; all classes are indexed and all
are queries. tests/llm measures recall against brute force.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do vectors of different
lengths. Rows of equal vec_id and vector are rows of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.llm.common import written
from recordspark.llm.components import components

SAMPLE_LEAST, SAMPLE_PER_LIST, LIST_SIZE, MOST_LISTS, SUBSPACES, CODES = 20_000, 16, 200, 4096, 8, 64
PROBE_DEVIATIONS = 4.0
BLOCK, QUERIES, CHUNK = 4096, 8192, 512


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])


def list_count(n: int) -> int:
    return max(1, min(MOST_LISTS, n // LIST_SIZE))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Centroids and code books; small, and of a size that is bounded."""

    def __init__(self, sample: np.ndarray, n: int):
        dims = sample.shape[1]
        self.parts = np.array_split(np.arange(dims), min(SUBSPACES, dims))
        self.centres = kmeans(sample, list_count(n))
        left = sample - self.centres[nearest(sample, self.centres)]
        self.books = [kmeans(left[:, p], CODES) for p in self.parts]
        self.between = np.sqrt(squares(self.centres, self.centres))
        # in how many dimensions what the centroids leave really spreads (participation ratio of its covariance)
        spread = np.linalg.eigvalsh(left.T @ left)
        self.dims = max(1.0, float(spread.sum() ** 2 / max((spread * spread).sum(), 1e-300)))

    def assign(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of unit vectors: list, codes, what the codes leave, lists to probe."""
        d = squares(x, self.centres)
        own = d.argmin(1)
        left = x - self.centres[own]
        codes = np.stack([squares(left[:, p], b).argmin(1) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        rebuilt = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        error = np.sqrt(((left[:, np.concatenate(self.parts)] - rebuilt) ** 2).sum(1))
        reach = radius * min(1.0, PROBE_DEVIATIONS / math.sqrt(self.dims))
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * reach * self.between[own] + 1e-12
        return own, codes, error, [np.flatnonzero(v) for v in near]

    def distances(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from queries to the vectors that the codes of a list stand for, by tables."""
        left = queries - self.centres[list_]
        out = np.zeros((len(queries), len(codes)))
        for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += squares(left[:, p], b)[:, codes[:, m]]
        return out


def units(column, kind="<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def link(index: Index, least_cosine: float, kind: str):
    radius = math.sqrt(2 - 2 * least_cosine)

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """For queries with links: how many (b null). For pairs of a spanning forest of the links: a, b."""
        if not len(queries) or not len(block):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        q, x = units(queries["v"], kind), units(block["v"], kind)
        codes = np.frombuffer(b"".join(block["codes"]), np.uint8).reshape(len(block), -1)
        bound = (radius + block["error"].to_numpy()) ** 2 + 1e-9
        q_ids, x_ids, n = queries["rep"].to_numpy(), block["rep"].to_numpy(), block["n"].to_numpy()
        # groups of the block's classes, by number; each is named by its least place in `ids`
        ids, number = np.unique(np.concatenate([q_ids, x_ids]), return_inverse=True)
        group, q_at, x_at = np.arange(len(ids)), number[: len(q)], number[len(q) :]
        counts, forest = np.zeros(len(q), np.int64), []
        for s in range(0, len(q), CHUNK):
            i, j = np.nonzero(index.distances(q[s : s + CHUNK], int(block["list"].iloc[0]), codes) <= bound)
            for t in range(0, len(i), 1 << 18):
                a, b = i[t : t + (1 << 18)] + s, j[t : t + (1 << 18)]
                fit = (np.einsum("ij,ij->i", q[a], x[b]) >= least_cosine) & (q_ids[a] != x_ids[b])
                a, b = a[fit], b[fit]
                np.add.at(counts, a, n[b])
                # what joins groups; most links are within one
                a, b = q_at[a], x_at[b]
                while len(a):
                    apart = group[a] != group[b]
                    a, b = a[apart], b[apart]
                    if not len(a):
                        break
                    first = np.unique(group[a], return_index=True)[1]  # one link of each group at a time
                    for u, v in zip(a[first].tolist(), b[first].tolist(), strict=True):
                        if (k := group[u]) != (m := group[v]):
                            group[group == max(k, m)] = min(k, m)
                            forest.append((ids[u], ids[v]))
        some = np.flatnonzero(counts)
        a, b = (np.array([p[k] for p in forest], dtype=np.int64) for k in (0, 1))
        return pd.DataFrame({"a": np.concatenate([q_ids[some], a]), "b": pd.array([None] * len(some) + b.tolist(), "Int64"), "links": np.concatenate([counts[some], np.zeros(len(a), np.int64)])})

    return run


def linked_embeddings(vectors: DataFrame, least_cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    radius = math.sqrt(2 - 2 * least_cosine)
    # float32 components are sent as such: they give the same doubles
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(fine, F.lit(False))
    rows = vectors.withColumn("v", F.when(good, F.col("v")))
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dims", F.size("v")), "classes")
    found = []
    for dims, n in sorted((r.dims, r.n) for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()):
        some = classes.where(F.col("dims") == dims)
        sample = [r.v for r in some.orderBy(F.xxhash64("v"), "rep").limit(min(65_536, max(SAMPLE_LEAST, SAMPLE_PER_LIST * list_count(n)))).select("v").collect()]
        x = np.array(sample)
        index = Index(x / np.sqrt((x * x).sum(1))[:, None], n)
        lists = len(index.centres)

        def assign(batches, index=index, dims=dims):
            for batch in batches:
                raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                own, codes, error, probes = index.assign(units([r.tobytes() for r in raw]), radius)
                raw = raw.astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))], ["rep", "n", "v", "list", "codes", "error", "probes"])

        coded = written(some.select("rep", "n", "v").mapInArrow(assign, "rep long, n long, v binary, list int, codes binary, error double, probes array<int>"), "coded")
        sizes = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        queries = coded.select("rep", "v", F.explode("probes").alias("list"))
        probed = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups"))
        grid = written(sizes.join(probed, "list"), "grid")  # a row for each list, of which there are few
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        left = queries.join(grid, "list").withColumn("g", deal("groups")).withColumn("k", each("blocks")).select(*(F.col(c).alias(c) for c in ("rep", "v", "list", "g", "k")))  # names of its own beside `right`
        right = coded.drop("probes").join(grid, "list").withColumn("k", deal("blocks")).withColumn("g", each("groups")).select("rep", "n", "v", "codes", "error", "list", "g", "k")
        parts = max(coded.sparkSession.sparkContext.defaultParallelism, lists // 8)
        keys = ("list", "g", "k")
        pairs = left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInPandas(link(index, least_cosine, kind), "a long, b long, links long")
        found.append(written(pairs, "embedding-links"))
    spark = vectors.sparkSession
    links = found[0] if found else spark.createDataFrame([], "a long, b long, links long")
    for more in found[1:]:
        links = links.union(more)
    counts = links.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    comps = components(links.where("b is not null").select("a", "b"))
    about = classes.join(counts, F.col("rep") == F.col("a"), "left").join(comps, F.col("rep") == F.col("node"), "left")
    about = written(about.select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "about-classes")
    out = rows.join(about, rows["v"] == about["_v"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
