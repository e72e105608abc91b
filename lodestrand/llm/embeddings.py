"""Near duplicates of embeddings: an exact metric range join over pivot cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.graph import components
from lodestrand.llm.tables import materialize, small_batches

#: Slack on both sides of a bound that rounding could cross; the bound itself is then checked in double precision.
SLACK = 1e-4

#: Pivots nearer than this count as one: 2 - 2 cos cancels there, and a plane between them tells nothing.
CLOSE = 1e-3


@dataclass(frozen=True)
class Settings:
    """Vectors link when their cosine is at least `cosine`.

    cell_rows: vectors wanted in a cell; most_pivots bounds what is broadcast. home_rows and guest_rows bound what one
    task holds, however many vectors a cell has.
    """

    cosine: float = 0.95
    cell_rows: int = 4096
    most_pivots: int = 2048
    home_rows: int = 8192
    guest_rows: int = 32768


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, matrices by length): unit vectors of the usable rows, in double precision, and their row numbers."""
    usable, lengths = pc.is_valid(column), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    found = []
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == n) & usable.to_numpy(zero_copy_only=False))
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        m = flat.to_numpy(zero_copy_only=False).reshape(len(rows), n)
        with np.errstate(over="ignore", invalid="ignore"):
            scale = np.abs(m).max(axis=1)
            good = np.isfinite(scale) & (scale > 0) & np.isfinite(m).all(axis=1)
        m = m[good] / scale[good, None]
        found.append((rows[good], m / np.linalg.norm(m, axis=1)[:, None]))
    return found


def _pivots(rows: list, wanted: int) -> dict[int, np.ndarray]:
    """Unit vectors of the sampled rows by length, none within CLOSE of another."""
    out: dict[int, list] = {}
    for _, m in _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64()))):
        if len(m):
            out[m.shape[1]] = _spread(np.unique(m[:wanted].round(12), axis=0))
    return out


def _apart(pivots: np.ndarray) -> np.ndarray:
    """Distances between unit vectors; exact enough for the bound from about CLOSE on, where nothing cancels."""
    return np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))


def _spread(pivots: np.ndarray) -> np.ndarray:
    """The pivots, in their order, that are not within CLOSE of one kept before."""
    near, kept = _apart(pivots) <= CLOSE, np.ones(len(pivots), bool)
    for i in range(len(pivots)):
        if kept[i]:
            kept[i + 1 :] &= ~near[i, i + 1 :]
    return pivots[kept]


def _guests(m: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and for every cell whether a vector of that cell could be within reach.

    x is nearest to p. A vector y nearest to q lies on q's side of the plane between p and q, and x lies
    (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) from that plane: farther than reach, and y cannot be within reach of x.
    Pivots within CLOSE of each other exclude nothing.
    """
    far = 2 - 2 * (m @ pivots.T)
    home = far.argmin(axis=1)
    apart = _apart(pivots)[home]
    to_plane = (far - far[np.arange(len(m)), home][:, None]) / np.maximum(2 * apart, CLOSE)
    near = (to_plane <= reach + SLACK) | (apart <= CLOSE)
    near[np.arange(len(m)), home] = True
    return home, near


def _absorb(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a[i] and b[i]; the smallest member stands for a set."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _join(ids: np.ndarray, homes: np.ndarray, guest_ids: np.ndarray, guests: np.ndarray, own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each home row, links of each guest row, edges a, edges b): the edges span the same components as all
    links found. own: guests of the same cell, which meet each pair a second time and are not counted themselves."""
    nodes, place = np.unique(np.concatenate([ids, guest_ids]), return_inverse=True)
    label, links, back = np.arange(len(nodes)), np.zeros(len(ids), np.int64), np.zeros(len(guest_ids), np.int64)
    homes32, guests32 = homes.astype(np.float32), guests.astype(np.float32)
    for i in range(0, len(homes), 1024):
        for j in range(0, len(guests), 4096):
            a, b = np.nonzero(homes32[i : i + 1024] @ guests32[j : j + 4096].T >= cosine - SLACK)
            for k in range(0, len(a), 1 << 18):
                x, y = a[k : k + (1 << 18)] + i, b[k : k + (1 << 18)] + j
                keep = (np.einsum("ij,ij->i", homes[x], guests[y]) >= cosine) & (ids[x] != guest_ids[y])
                x, y = x[keep], y[keep]
                links += np.bincount(x, minlength=len(ids))
                back += np.bincount(y[~own[y]], minlength=len(guest_ids))
                label = _absorb(label, place[x], place[len(ids) + y])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return links, back, nodes[moved], nodes[label[moved]]


def range_join(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and components of all vectors whose cosine is at least settings.cosine.

    On unit vectors that is a distance of at most sqrt(2 - 2 cosine). A bounded number of vectors, the first by a hash
    of the id, are pivots. A vector is at home in the cell of its nearest pivot and a guest in its own cell and in all
    later ones that could hold a vector within that distance: a pair of two cells is compared in the later one. A cell
    compares its homes with its guests on its own. It is cut into blocks of homes and blocks of guests, by hashes of
    the id and only as many as its counts ask for, so a cell that holds a third of all vectors is many bounded tasks. A
    block returns the number of links of homes and guests and edges that span its links' components, never the pairs.

    Where vectors have no structure, as with random directions in many dimensions, the bound excludes few cells and
    the join compares nearly all pairs of blocks; that is the price of exactness. Products are made in single
    precision with a margin, and what reaches it is decided in double precision.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Vectors of different
    lengths do not link. Rows that repeat an id are one vector with the links of all its rows, not linked with itself.
    A null id links with nothing. An empty table gives an empty result. Other columns are not read.

    Returns vec_id, n_links, component_id, kept: one row per vector.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("v"))
    total = rows.count()
    wanted = max(1, min(settings.most_pivots, -(-total // settings.cell_rows)))
    finite = "forall(v, x -> x is not null and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    chosen = rows.where("_id is not null and v is not null").where(finite).orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(wanted).collect()
    pivots, reach = _pivots(chosen, wanted), float(np.sqrt(2 - 2 * settings.cosine))

    def cells(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            for at, m in _matrix(batch.column(1)):
                own = pivots.get(m.shape[1], m[:1] * 0)
                if m.shape[1] in pivots:
                    home, near = _guests(m, own, reach)
                    near &= np.arange(near.shape[1]) >= home[:, None]
                else:  # a length that no pivot has: one cell
                    home, near = np.zeros(len(m), np.int64), np.ones((len(m), 1), bool)
                yield batch.column(0).take(pa.array(at)), m, home, near

    def count(batches):
        sums: dict[tuple, np.ndarray] = {}
        for _, m, home, near in cells(batches):
            for c in range(near.shape[1]):
                got = sums.setdefault((m.shape[1], c), np.zeros(2, np.int64))
                got += [(home == c).sum(), near[:, c].sum()]
        keys = list(sums)
        kind = ["size", "cell", "homes", "guests"]
        cols = [[k[0] for k in keys], [k[1] for k in keys], [int(sums[k][0]) for k in keys], [int(sums[k][1]) for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=kind)

    counted = rows.mapInArrow(count, "size long, cell long, homes long, guests long").groupBy("size", "cell").agg(F.sum("homes").alias("h"), F.sum("guests").alias("g"))
    blocks = {(r["size"], r["cell"]): (-(-r["h"] // settings.home_rows), -(-r["g"] // settings.guest_rows)) for r in counted.collect()}

    def deal(batches):
        for ids, m, home, near in cells(batches):
            ids = ids.to_numpy()
            out: list[tuple] = []
            for c in range(near.shape[1]):
                h, g = blocks[m.shape[1], c]
                for mask, parts, copies, guest in ((home == c, h, g, False), (near[:, c], g, h, True)):
                    at = np.flatnonzero(mask)
                    here = (home[at] == c).astype(np.uint8)
                    part = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % max(parts, 1)
                    for p in np.unique(part):
                        rows_ = at[part == p]
                        for q in range(copies):
                            a, b = (q, p) if guest else (p, q)
                            out.append((m.shape[1], c, int(a), int(b), guest, ids[rows_].tobytes(), m[rows_].tobytes(), here[part == p].tobytes()))
            for k in range(0, len(out), 256):
                cols = list(zip(*out[k : k + 256], strict=True))
                kinds = (*[pa.int64()] * 4, pa.bool_(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["size", "cell", "h", "g", "guest", "ids", "rows", "here"])

    cosine = settings.cosine

    def join(key, table):
        size = key[0].as_py()
        sides = []
        for guest in (False, True):
            part = table.filter(pc.equal(table.column("guest"), guest))
            ids = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, np.int64) for b in part.column("ids").to_pylist())])
            sides += [ids, np.concatenate([np.zeros(0), *(np.frombuffer(b) for b in part.column("rows").to_pylist())]).reshape(-1, size)]
        own = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(b, np.uint8) for b in part.column("here").to_pylist())]) > 0
        links, back, a, b = _join(*sides, own, cosine)
        ids = np.concatenate([sides[0], sides[2]])
        links = np.concatenate([links, back])
        some = links > 0
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], a])),
                "b": pa.array(np.concatenate([ids[some], b])),
                "n": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
            }
        )

    dealt = rows.mapInArrow(deal, "size long, cell long, h long, g long, guest boolean, ids binary, rows binary, here binary")
    found = materialize(dealt.groupBy("size", "cell", "h", "g").applyInArrow(join, "a long, b long, n long"))
    links = found.where("n > 0").groupBy(F.col("a").alias("_id")).agg(F.sum("n").alias("n_links"))
    parts = components(found.where("a <> b")).select(F.col("node").alias("_id"), "component")
    ids = vectors.select(F.col(id_col).cast("long").alias("_id"))
    return ids.join(links, "_id", "left").join(parts, "_id", "left").select(
        F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_id").alias("component_id"),
        (F.coalesce("component", "_id").eqNullSafe(F.col("_id"))).alias("kept"),
    )


def op8_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
