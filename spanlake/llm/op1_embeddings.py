"""Embedding near-dedup with a pivot-permutation index.

Method.  Reference points (pivots) are vectors of a bounded sample.  A vector is described by its ``near`` nearest
pivots in order; two vectors as close as the threshold asks share most of them.  Inverted lists go from pivot to
vectors; vectors that share at least ``shared`` pivots are candidates, and their cosine is taken exactly in double
precision.  As in a prefix filter, only the first ``near - shared + 1`` pivots of a vector by one common order
(rarest pivot first) are posted: two vectors with ``shared`` pivots in common meet in one of these lists.  Links need
equal labels, so lists are kept per label.

Recall is that of sharing pivots; tests hold it against brute force (no link is below the threshold).

Scale.  Equal vectors of one label are one member with a count, however many there are.  Lists are cut into
blocks of ``BLOCK`` members; a task compares two blocks, so no list, label or hot pivot has to fit in one task, and
each pair counts in the first list that both are posted to.  A task sums its links per member and keeps one edge per
member, so a group of near copies sends rows in proportion to its members, not to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import components, save

PIVOTS = 256
NEAR, SHARED = 8, 3
BLOCK = 2000
DIMS = 32  # different vector lengths whose pivots are held at a time


def usable(vec, label):
    """Vectors that may link: labelled, no null or non-finite component, not zero."""
    v = vec.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return label.isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array | pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in (col.to_pylist() if isinstance(col, pa.Array) else col)], np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(members: DataFrame, pivots: dict[int, np.ndarray], near: int) -> DataFrame:
    """``(label, dim, rep, vec, pivots)``: the ordered nearest pivots of each member."""
    shared = members.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column(1).to_pylist())
            out: list = [None] * b.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                p = shared.value[int(dim)]
                for k in range(0, len(at), 4096):
                    own = at[k:k + 4096]
                    order = np.argsort(-(_matrix(b.column(3).take(pa.array(own))) @ p.T), axis=1, kind="stable")[:, :near]
                    for i, o in zip(own.tolist(), order.tolist()):
                        out[i] = o
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "pivots"])
    return members.mapInArrow(run, "label long, dim int, rep long, vec array<double>, copies long, pivots array<int>")


def _links(x: pd.DataFrame, y: pd.DataFrame | None, pivot: int, shared: int, threshold: float) -> pd.DataFrame:
    """Links at the threshold in this list, unless they meet in an earlier one, folded per member."""
    same = y is None
    y = x if same else y
    a, b = _matrix(x["vec"]), _matrix(y["vec"])

    def table(col):
        t = np.zeros((len(col), PIVOTS), np.float32)
        rows = np.repeat(np.arange(len(col)), [len(c) for c in col])
        t[rows, np.concatenate([np.asarray(c) for c in col])] = 1
        return t
    common = table(x["pivots"]) @ table(y["pivots"]).T
    close = np.zeros(common.shape, bool)
    i, j = np.nonzero(common >= min(shared, int(common.max()) if common.size else 0))
    for k in range(0, len(i), 1 << 18):
        m = slice(k, k + (1 << 18))
        close[i[m], j[m]] = np.einsum("ij,ij->i", a[i[m]], b[j[m]]) >= threshold
    i, j = np.nonzero(close)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    px, py = x["posted"].tolist(), y["posted"].tolist()
    sy = [set(p) for p in py]  # posted lists come in the common order
    first = [next(p for p in px[m] if p in sy[n]) == pivot for m, n in zip(i.tolist(), j.tolist())]
    i, j = i[first] if len(i) else i, j[first] if len(j) else j
    return _folded(x["rep"].to_numpy()[i], y["rep"].to_numpy()[j], x["copies"].to_numpy()[i], y["copies"].to_numpy()[j])


def _folded(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> pd.DataFrame:
    """Pairs as one row per member: the vectors it links to, and the smallest member that these pairs lead to."""
    ids, at = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    far = np.zeros(len(ids), np.int64)
    np.add.at(far, i, of_b.astype(np.int64))
    np.add.at(far, j, of_a.astype(np.int64))
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return pd.DataFrame({"rep": ids, "far": far, "root": ids[root]})
        root = new


def similar(members: DataFrame, threshold: float, near: int = NEAR, shared: int = SHARED) -> DataFrame:
    """``(rep, far, root)`` per member and task that finds links of it: members of one label link at cosine ``threshold``
    or more; ``far`` sums the copies linked, ``(rep, root)`` are edges with the components of all links."""
    spark = members.sparkSession
    # a bounded sample of pivots per dimension: those with the smallest hash; DIMS dimensions at a time
    dims = sorted(r.dim for r in members.select("dim").distinct().collect())
    first = Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep")
    told = None
    for at in range(0, max(len(dims), 1), DIMS):
        own = members.where(F.col("dim").isin(dims[at:at + DIMS]))
        rows = own.withColumn("n", F.row_number().over(first)).where(F.col("n") <= PIVOTS).select("dim", "n", "vec").collect()
        pivots: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r.n):
            pivots.setdefault(r.dim, []).append(r.vec)
        part = save(describe(own, {d: _matrix(pd.Series(v)) for d, v in pivots.items()}, near), "pivot-members")
        told = part if told is None else told.unionByName(part)
    # rarity of a pivot within its label; PIVOTS rows per label and dimension
    sizes = save(told.select("label", "dim", F.explode("pivots").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")), "pivot-sizes")
    order = sizes.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "pivot"))), lambda s: s.pivot).alias("order"))
    posted = (told.join(order, ["label", "dim"])
              .withColumn("posted", F.slice(F.filter("order", lambda p: F.array_contains("pivots", p)), 1,
                                            F.greatest(F.lit(1), F.size("pivots") - shared + 1)))
              .drop("order"))
    lists = posted.withColumn("pivot", F.explode("posted"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    lists = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a member of block k meets the blocks k.. and is met by the blocks ..k
    seats = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", "pivot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "copies", "vec", "pivots", "posted")

    def meet(df: pd.DataFrame) -> pd.DataFrame:
        pivot, x, y = int(df["pivot"].iloc[0]), int(df["x"].iloc[0]), int(df["y"].iloc[0])
        if x == y:
            return _links(df.reset_index(drop=True), None, pivot, shared, threshold)
        a, b = df[df["own"] == x].reset_index(drop=True), df[df["own"] == y].reset_index(drop=True)
        return _links(a, b, pivot, shared, threshold) if len(a) and len(b) else pd.DataFrame({"rep": [], "far": [], "root": []})

    return seats.groupBy("label", "dim", "pivot", "x", "y").applyInPandas(meet, "rep long, far long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, near: int = NEAR, shared: int = SHARED, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per input row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with null label or
    id, link with nothing; vectors of different length are never compared; rows that repeat an id are copies of
    each other when their vectors are equal; an empty table gives an empty result; other columns are not read.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
                          F.col(label_col).cast("long").alias("label"))
    ok = F.when(usable(F.col("vec"), F.col("label")) & F.col("vec_id").isNotNull(), True).otherwise(False)
    base = base.withColumn("vec", F.when(ok, F.col("vec"))).withColumn("dim", F.size("vec"))
    base = save(base.withColumn("print", F.xxhash64("label", "vec")), "pivot-rows")
    members = save(base.where("vec is not null").groupBy("label", "dim", "print", "vec").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "pivot-distinct")
    found = save(similar(members.select("label", "dim", "rep", "vec", "copies"), threshold, near, shared), "pivot-links")
    links = found.groupBy(F.col("rep").alias("a")).agg(F.sum("far").alias("far"))
    comp = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "pivot-components")
    told = save(members.join(links, members.rep == links.a, "left").join(comp, members.rep == comp.node, "left").select(
        "label", "print", "rep", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id")), "pivot-told")
    # the print only narrows the join: equal prints of one label are told apart by their vectors
    vec = members.select("label", "print", F.col("vec").alias("own"), F.col("rep")).join(told, ["label", "print", "rep"])
    out = base.join(vec.select("label", "print", "own", "n_links", "component_id"),
                    (base.label == vec.label) & (base["print"] == vec["print"]) & (base.vec == vec.own), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
