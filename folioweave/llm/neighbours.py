"""Problem 4: the most similar vectors of every vector, in shards about centroids.

Equal directions are one class, represented once. The classes are spread over shards by the nearest of the
centroids, fitted on bounded samples and divided until no shard is overfull; each is indexed in one shard and asked in
its `probes` nearest ones, where those that are indexed meet it too: a pair is found if either asks in the other's
shard. A shard of usual size compares all that are asked in it with all that are indexed, by products of matrices. An
overfull one, of vectors too near each other for any centroid, builds a robust-pruned directed graph: greedy searches
from the medoid propose neighbours, relaxed distance pruning keeps diverse edges, reverse edges are pruned alike; beam
search answers its queries. All steps work on batches. Shards are of like size at any scale, and each has a task of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from ._frames import SLOTS, arrow_map, once


class Graph:
    """Directed graph over unit vectors `x` (n, d): at most `degree` edges a node after pruning.

    Nodes are inserted in batches of random order into a random graph. Reverse edges are appended while a node has
    room for half as many edges more; only a full node is pruned again.
    """

    def __init__(self, x: np.ndarray, degree: int = 20, beam: int = 32, alpha: float = 1.2, seed: int = 7, batch: int = 256):
        self.x = np.ascontiguousarray(x, np.float32)
        self.n, self.degree, self.beam, self.room = len(x), degree, beam, degree + degree // 2
        rng = np.random.default_rng(seed)
        self.start = int((self.x @ self.x.mean(0)).argmax()) if self.n else 0
        self.edge = np.full((self.n, self.room), -1, np.int32)
        if self.n > 1:
            first = rng.integers(0, self.n, (self.n, min(degree // 2, self.n - 1)))
            self.edge[:, : first.shape[1]] = np.where(first == np.arange(self.n)[:, None], -1, first)
        order = rng.permutation(self.n)
        for lo in range(0, self.n, batch):
            self._insert(order[lo : lo + batch], alpha)

    def search(self, q: np.ndarray, beam: int, width: int = 4):
        """(nodes, similarities) of the `beam` best found for each query, best first; -1 pads."""
        b = len(q)
        ids = np.full((b, beam), -1, np.int32)
        sim = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        if not self.n or not b:
            return ids, sim
        ids[:, 0], sim[:, 0], done[:, 0] = self.start, q @ self.x[self.start], False
        # when each query met each node; no node is compared twice with a query
        met = np.full(b * self.n, -1, np.int32)
        met[np.arange(b) * self.n + self.start] = 0
        live = np.arange(b)
        while live.size:
            s = np.where(done[live], -np.inf, sim[live])
            pick = np.argpartition(-s, min(width, beam - 1), axis=1)[:, :width] if beam > width else np.argsort(-s, axis=1)[:, :width]
            good = np.take_along_axis(s, pick, 1) > -np.inf
            go = good.any(1)
            live, pick, good = live[go], pick[go], good[go]
            if not live.size:
                break
            r, c = np.nonzero(good)
            at, c = live[r], pick[r, c]
            done[at, c] = True
            nxt = self.edge[ids[at, c]]
            row, nxt = np.repeat(at, self.room), nxt.ravel()
            row, nxt = row[nxt >= 0], nxt[nxt >= 0]
            key = row * self.n + nxt
            new = met[key] < 0
            row, nxt, key = row[new], nxt[new], key[new]
            turn = np.arange(key.size, dtype=np.int32)
            met[key] = turn
            new = met[key] == turn  # a node may come from several expanded ones
            row, nxt = row[new], nxt[new]
            if not row.size:
                continue
            v = np.einsum("nd,nd->n", q[row], self.x[nxt])
            first = np.searchsorted(row, live)
            n = np.searchsorted(row, live, "right") - first
            line, place = np.repeat(np.arange(live.size), n), np.arange(row.size) - np.repeat(first, n)
            new_id = np.full((live.size, int(n.max())), -1, np.int32)
            new_sim = np.full(new_id.shape, -np.inf, np.float32)
            new_id[line, place], new_sim[line, place] = nxt, v
            all_id = np.concatenate([ids[live], new_id], 1)
            all_sim = np.concatenate([sim[live], new_sim], 1)
            all_done = np.concatenate([done[live], new_id < 0], 1)
            keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_id, keep, 1)
            sim[live] = np.take_along_axis(all_sim, keep, 1)
            done[live] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def _prune(self, p: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """Diverse edges of nodes p from candidates (one row each; -1 pads, repeats allowed)."""
        cand = np.sort(cand, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == p[:, None]] = -1
        vec = self.x[cand]
        to_p = 2 - 2 * np.einsum("bcd,bd->bc", vec, self.x[p])
        to_p[cand < 0] = np.inf
        order = np.argsort(to_p, 1, kind="stable")
        cand, to_p, vec = np.take_along_axis(cand, order, 1), np.take_along_axis(to_p, order, 1), np.take_along_axis(vec, order[:, :, None], 1)
        between = 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
        alive = cand >= 0
        out = np.full((len(p), self.room), -1, np.int32)
        count = np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        for _ in range(self.degree):
            k = alive.argmax(1)
            some = alive[rows, k] & (count < self.degree)
            if not some.any():
                break
            r = rows[some]
            out[r, count[r]] = cand[r, k[r]]
            count[r] += 1
            alive[r] &= alpha * between[r, k[r]] > to_p[r]
            alive[r, k[r]] = False
        return out

    def _insert(self, p: np.ndarray, alpha: float) -> None:
        found, _ = self.search(self.x[p], self.beam)
        self.edge[p] = self._prune(p, np.concatenate([found, self.edge[p]], 1), alpha)
        # reverse edges that are not there yet
        src, dst = np.repeat(p, self.room), self.edge[p].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        new = (self.edge[dst] != src[:, None]).all(1)
        src, dst = src[new], dst[new]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        at, first, n = np.unique(dst, return_index=True, return_counts=True)
        line, place = np.repeat(np.arange(at.size), n), np.arange(dst.size) - np.repeat(first, n)
        old = self.edge[at]
        old = np.take_along_axis(old, np.argsort(old < 0, axis=1, kind="stable"), 1)
        have = (old >= 0).sum(1)
        full = have + n > self.room
        fit = ~full[line]
        old[line[fit], have[line[fit]] + place[fit]] = src[fit]
        self.edge[at[~full]] = old[~full]
        over = np.flatnonzero(full)
        into = np.full((at.size, 2 * self.degree), -1, np.int32)
        fit = full[line] & (place < into.shape[1])
        into[line[fit], place[fit]] = src[fit]
        for lo in range(0, over.size, 1024):
            part = over[lo : lo + 1024]
            self.edge[at[part]] = self._prune(at[part].astype(np.int32), np.concatenate([old[part], into[part]], 1), alpha)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of a sample of unit vectors (spherical k-means); empty ones are drawn anew."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, sample)
        norm = np.linalg.norm(s, axis=1)
        ok = (n > 0) & (norm > 1e-9)
        c[ok] = s[ok] / norm[ok, None]
        if (~ok).any():
            c[~ok] = sample[rng.choice(len(sample), int((~ok).sum()))]
    return c


def _unit(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    x = np.array([np.nan if e is None else e for e in v], np.float64)
    n = np.sqrt((x * x).sum())
    if not np.isfinite(n) or n == 0:
        return None
    return x / n


def _unit_rows(c: dict) -> dict:
    """Unit vectors with a key of their direction; unusable rows are left out."""
    out = {"id": [], "key": [], "vec": []}
    for i, v in zip(c["id"], c["v"]):
        x = _unit(v)
        if x is None:
            continue
        out["id"].append(i)
        out["key"].append(hashlib.blake2b(np.rint(x * (1 << 20)).astype(np.int32).tobytes(), digest_size=12).hexdigest())
        out["vec"].append(x.astype(np.float32))
    return out


def _first_ids(k: int):
    """Per partition the k smallest ids of each key, so that a key of a third of all rows shuffles little."""

    def run(batches):
        import heapq

        best: dict = {}

        def flush():
            rows = [(key, -i) for key, h in best.items() for i in h]
            best.clear()
            cols = list(zip(*rows)) if rows else [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["key", "id"])

        for b in batches:
            for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = best.setdefault(key, [])
                if len(h) < k:
                    if -i not in h:
                        heapq.heappush(h, -i)
                elif -i > h[0] and -i not in h:
                    heapq.heapreplace(h, -i)
            if len(best) > 200_000:
                yield flush()
        yield flush()

    return run


#: Up to so many centroids are compared with every vector; of more, those of the nearest groups are.
FLAT = 2048


class Routes:
    """The nearest shards of vectors. Many centroids are grouped about coarser ones, of which `near` are looked into."""

    def __init__(self, cent: np.ndarray, near: int = 16):
        self.cent, self.near, self.coarse = cent, near, None
        if len(cent) > FLAT:
            self.coarse = fit_centroids(cent, int(np.sqrt(len(cent))))
            group = np.concatenate([(cent[i : i + 4096] @ self.coarse.T).argmax(1) for i in range(0, len(cent), 4096)])
            self.members = [np.flatnonzero(group == g) for g in range(len(self.coarse))]

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """(len(x), k) shards, nearest first; -1 pads."""
        if self.coarse is None:
            return _best(x @ self.cent.T, k)
        groups = _best(x @ self.coarse.T, min(self.near, len(self.coarse)))
        sim = np.full((len(x), k), -np.inf, np.float32)
        out = np.full((len(x), k), -1, np.int64)
        for g in np.unique(groups):
            rows, m = np.flatnonzero((groups == g).any(1)), self.members[g]
            if m.size:
                s = np.concatenate([sim[rows], x[rows] @ self.cent[m].T], 1)
                i = np.concatenate([out[rows], np.broadcast_to(m, (rows.size, m.size))], 1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                sim[rows], out[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        return out


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    k = min(k, s.shape[1])
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _homes(sent):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.nearest(_vectors(b), 1)[:, 0].astype(np.int32)), b.column("vec")], names=["shard", "vec"])

    return run


def _sizes(reps: DataFrame, cent: np.ndarray) -> tuple[DataFrame, dict]:
    """(shard and vector of every direction, directions by shard)."""
    at = reps.select("vec").mapInArrow(_homes(reps.sparkSession.sparkContext.broadcast(Routes(cent))), "shard int, vec array<float>")
    return at, {r["shard"]: r["count"] for r in at.groupBy("shard").count().collect()}  # a row a shard


def _divide(parts: dict):
    """Finer centroids of one shard."""

    def run(t: pa.Table) -> pa.Table:
        k = t.column("shard")[0].as_py()
        x = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float32)
        c = fit_centroids(np.unique(x, axis=0), parts[k])  # in an order of its own
        return pa.table({"shard": pa.array([k] * len(c), pa.int32()), "vec": pa.array(list(c), pa.list_(pa.float32()))})

    return run


def _split_hot(reps: DataFrame, cent: np.ndarray, size: int, per_centroid: int = 64, fan: int = 32, rounds: int = 8) -> tuple[np.ndarray, dict]:
    """(centroids, directions by shard): those that more than twice `size` vectors are nearest to give way to finer ones.

    Each overfull shard is divided on an executor, on about `per_centroid` of its vectors for every new centroid, `fan`
    at most at once. Only counts and centroids come to the driver, both in proportion to the number of shards.
    """
    dim = cent.shape[1]
    for left in range(rounds, -1, -1):
        at, count = _sizes(reps, cent)
        hot = {k: min(fan, -(-n // size)) for k, n in count.items() if n > 2 * size}
        if not hot or not left:
            break
        share = {k: min(1.0, per_centroid * parts / count[k]) for k, parts in hot.items()}

        few = reps.sparkSession.createDataFrame([(int(k), float(v)) for k, v in share.items()], "shard int, share double")
        picked = at.join(F.broadcast(few), "shard").where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < F.col("share") * 1_000_000 + 1)
        got = picked.select("shard", "vec").groupBy("shard").applyInArrow(_divide(hot), "shard int, vec array<float>").toPandas()
        if len(got) <= got["shard"].nunique():
            break
        finer = np.stack(got.sort_values("shard", kind="stable").vec.to_list()).astype(np.float32).reshape(-1, dim)
        cent = np.concatenate([np.delete(cent, got["shard"].unique(), axis=0), finer])
    return cent, count


def _nearest(asked: DataFrame, reps: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of `asked`; numbers of these, vectors of their k most similar others), by comparison with all of `reps`."""
    got = asked.toPandas()
    q = np.stack(got.vec.to_list()).astype(np.float32)
    sent = reps.sparkSession.sparkContext.broadcast((q, got.key.to_numpy()))

    def run(batches):
        q, keys = sent.value
        sim, other = np.full((len(q), k), -np.inf, np.float32), np.zeros((len(q), k), np.int64)
        for b in batches:
            x, key = _vectors(b) if b.num_rows else q[:0], b.column("key").to_numpy()
            for lo in range(0, len(x), 4096):
                v, part = q @ x[lo : lo + 4096].T, key[lo : lo + 4096]
                _, i, j = np.intersect1d(keys, part, return_indices=True)
                v[i, j] = -np.inf
                for r in np.flatnonzero(v.max(1) > sim[:, -1]):
                    new = np.flatnonzero(v[r] > sim[r, -1])
                    near = np.concatenate([sim[r], v[r, new]])
                    best = np.argsort(-near, kind="stable")[:k]
                    sim[r], other[r] = near[best], np.concatenate([other[r], part[new]])[best]
        i, j = np.nonzero(sim > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(-sim[i, j].astype(np.float64)), pa.array(other[i, j])], names=["q", "far", "key"])

    near = reps.select("key", "vec").mapInArrow(run, "q long, far double, key long")
    near = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "key"))), 1, k).alias("l")).select("q", F.explode("l.key").alias("key"))
    near = reps.select("key", "vec").join(F.broadcast(near), "key").select("q", "vec").toPandas()  # k rows for each one asked
    return q, near.q.to_numpy(), np.stack(near.vec.to_list()).astype(np.float32) if len(near) else q[:0]


def _enough_probes(q: np.ndarray, who: np.ndarray, others: np.ndarray, routes: Routes, recall: float, most: int = 256) -> int:
    """The number of nearest shards in which `recall` of the pairs meet: one of a pair asks in the other's shard."""
    if not len(who):
        return 1
    mine, theirs = routes.nearest(q, most)[who], routes.nearest(others, most)
    place = lambda near, home: np.where((near == home).any(1), (near == home).argmax(1), near.shape[1] - 1)
    r = np.sort(np.minimum(place(mine, theirs[:, :1]), place(theirs, mine[:, :1])))
    return int(r[min(len(r) - 1, int(np.ceil(recall * len(r))) - 1)]) + 1


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a and b to nine digits, the same for a pair in either order and among any others."""
    out = [np.round((a[i : i + 65536].astype(np.float64) * b[i : i + 65536]).sum(1), 9) for i in range(0, len(a), 65536)]
    return np.concatenate(out) if out else np.zeros(0)


def _first(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a the k rows of largest s, of equal ones those of smaller b."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    keep = np.arange(a.size) - np.searchsorted(a, a) < k
    return a[keep], b[keep], s[keep]


#: What products of unit vectors in single precision may be off by, and more.
SLACK = np.float32(1e-5)


def _compare(x: np.ndarray, where: np.ndarray, k: int, at_once: int = 256, hold: int = 1 << 20):
    """(a, b, cosine): for the rows `where` of x their k nearest of all, for the other rows those of `where`.

    Of equal cosines the smaller rows stay.
    """
    y = np.ascontiguousarray(x[where])
    m, out, back, held = len(y), [], [], 0
    least = np.full(m, -np.inf, np.float32)  # what a row must reach to be among the nearest of each indexed one
    for rows in (where, np.setdiff1d(np.arange(len(x)), where)):
        own = rows is where
        for lo in range(0, len(rows), at_once):
            r = rows[lo : lo + at_once]
            s = x[r] @ y.T
            if own:
                s[np.arange(len(r)), np.arange(lo, lo + len(r))] = -np.inf
            low = np.full(len(r), -2, np.float32)
            if m > k + 1:
                # the k-th of the largest of separate columns is no larger than the k-th of all
                w = max(k + 1, m // 16)
                top = s[:, : m // w * w].reshape(len(r), m // w, w).max(1)
                low = np.maximum(low, np.partition(top, w - k, axis=1)[:, w - k] - SLACK)
            at = np.flatnonzero(s >= low[:, None])
            i, j = np.divmod(at, m)
            a, b, c = _first(r[i], where[j], _cosines(x[r[i]], y[j]), k)
            if own:
                first = np.searchsorted(a, r)
                n = np.searchsorted(a, r, "right") - first
                least[lo : lo + len(r)] = np.where(n == k, c[np.minimum(first + k, a.size) - 1] if a.size else -2, -2).astype(np.float32) - SLACK
                back.append((a, b, c))
                continue
            out.append((a, b, c))
            at = np.flatnonzero(s >= least)
            i, j = np.divmod(at, m)
            back.append((where[j], r[i], _cosines(x[r[i]], y[j])))
            held += at.size
            if held > hold:
                back, held = [_first(*(np.concatenate(v) for v in zip(*back)), k)], 0
    if back:
        out.append(_first(*(np.concatenate(v) for v in zip(*back)), k))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _search(x: np.ndarray, where: np.ndarray, k: int, degree: int, beam: int):
    """The same by beam search in a graph of the rows `where`, nearly."""
    g = Graph(x[where], degree=degree, beam=max(beam, 32) if where.size > 64 else 32)
    own = np.zeros(len(x), bool)
    own[where] = True
    out = []
    for lo in range(0, len(x), 256):
        found, _ = g.search(x[lo : lo + 256], beam)
        i, j = np.nonzero(found >= 0)
        a, b = lo + i, where[found[i, j]]
        a, b = a[a != b], b[a != b]
        c = _cosines(x[a], x[b])
        out.append(_first(a, b, c, k))
        new = ~own[a]
        out.append((b[new], a[new], c[new]))
    return _first(*(np.concatenate(v) for v in zip(*out)), k) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _lanes(spark, sizes: list[int], most: int = 4096) -> tuple[int, np.ndarray]:
    """(number of tasks, for each shard a value that a hash partitioning by it sends to a task of its own).

    Beyond `most` tasks the shards are dealt out by size, so that all tasks get about as much.
    """
    n = max(1, min(most, len(sizes)))
    rows = spark.range(40 * n).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("v").alias("v")).collect()
    value = [r["v"] for r in sorted(rows, key=lambda r: r["p"])]
    lane = np.zeros(len(sizes), np.int32)
    for i, k in enumerate(np.argsort(-np.array(sizes), kind="stable")):
        turn, at = divmod(i, len(value))
        lane[k] = value[at if turn % 2 == 0 else len(value) - 1 - at]
    return n, lane


def most_similar(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, shard_size: int = 4096, probes: int = 3,
    sample: int = 40_000, degree: int = 20, beam: int = 40, recall: float = 0.95, asked: int = 512, exact: int | None = None,
) -> DataFrame:
    """(key, neighbour, rank, cosine): the k most similar other vectors of every usable vector.

    Equal cosines: the smaller key first. Null, empty, zero and non-finite vectors have no neighbours, nor have
    vectors of another length than the most frequent one. Keys must be integers; a repeated key counts once.
    The first centroids are fitted on at most about `sample` vectors taken by hash, the finer ones of overfull shards on 64 of
    theirs a centroid; every vector is indexed and asked. It is asked in `probes` shards, or in as many more as it takes for
    `recall` of the true neighbours of about `asked` vectors taken by hash to meet them. No shard holds more than about twice
    `shard_size` vectors at any number of them, unless no centroid can divide them. Shards of more than `exact` indexed vectors
    (twice `shard_size`) are searched by graphs, the others compared; with 0 all are searched by graphs. Recall is measured in
    the tests and the README.
    """
    spark = rows.sparkSession
    d = once(rows, key, vector)
    kd = rows.schema[key].dataType.simpleString()
    d = d.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    unit = materialize(arrow_map(d, _unit_rows, "id long, key string, vec array<float>"), "unit")
    sizes = unit.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"{key} {kd}, neighbour {kd}, rank int, cosine double")
    dim = sizes[0]["d"]
    u = unit.where(F.size("vec") == dim)
    who = materialize(u.select("key", "id"), "members")
    ids = who.select("key", "id").mapInArrow(_first_ids(k + 1), "key string, id long")
    ids = ids.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids")).select(F.col("key").alias("direction"), F.get("ids", F.lit(0)).alias("key"), "ids")
    # from here on a direction goes by its smallest id; vectors are shuffled only where theirs may have several
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    again = F.broadcast(ids.where(F.size("ids") > 1).select(slot("direction").alias("slot")).distinct())
    u = u.withColumn("slot", slot("key"))
    alone = u.join(again, "slot", "left_anti").select(F.col("id").alias("key"), "vec")
    several = u.join(again, "slot", "left_semi").groupBy("key").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("first"))
    reps = materialize(alone.unionByName(several.select(F.col("first").alias("key"), "vec")), "directions")
    discard(unit)
    n = reps.count()
    shards = int(max(1, min(sample // 64, -(-n // shard_size))))
    share = min(1.0, sample / n)
    picked = reps.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vec").limit(sample + sample // 4).toPandas()
    cent = fit_centroids(np.stack(picked.vec.to_list()).astype(np.float32), shards) if shards > 1 else np.zeros((1, dim), np.float32)
    cent, count = _split_hot(reps, cent, shard_size)
    routes = Routes(cent)
    if len(cent) > probes:
        few = F.pmod(F.xxhash64("key", F.lit("asked")), F.lit(1_000_000)) < int(min(1.0, asked / n) * 1_000_000) + 1
        some = reps.where(few)
        if some.limit(1).count():
            probes = max(probes, _enough_probes(*_nearest(some.select("key", "vec").limit(2 * asked), reps, k), routes, recall))
    probes = min(probes, len(cent))
    exact = 2 * shard_size if exact is None else exact
    # vectors too near each other for any centroid are divided by their hash; who asks there asks in all parts
    parts = np.array([max(1, -(-count.get(i, 0) // (4 * shard_size))) for i in range(len(cent))])
    first = np.concatenate([[0], np.cumsum(parts)])
    tasks, lane = _lanes(spark, [count.get(i, 0) // parts[i] for i in range(len(cent)) for _ in range(parts[i])])
    sent = spark.sparkContext.broadcast((routes, parts, first, lane))  # in proportion to the number of shards

    def route(batches):
        routes, parts, first, lane = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            near = routes.nearest(_vectors(b), probes)
            own = np.zeros(near.shape, bool)
            own[:, 0] = True
            who, own, near = np.repeat(np.arange(b.num_rows), near.shape[1]), own.ravel(), near.ravel()
            who, own, near = who[near >= 0], own[near >= 0], near[near >= 0]
            n = parts[near]
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, own, near, n = (np.repeat(v, n) for v in (who, own, near, n))
            if (n > 1).any():
                mine = (b.column("key").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[who] % n
                own &= part == mine
            shard = (first[near] + part).astype(np.int32)
            t = b.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(lane[shard]), pa.array(shard), t.column("key"), t.column("vec"), pa.array(own)], names=["lane", "shard", "key", "vec", "own"])

    routed = reps.mapInArrow(route, "lane int, shard int, key long, vec array<float>, own boolean").repartition(tasks, "lane")

    def answer(t: pa.Table) -> pa.Table:
        x = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float32)
        keys = t.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")  # the same on any run, and smaller keys first
        x, keys = x[order], keys[order]
        where = np.flatnonzero(t.column("own").combine_chunks().to_numpy(zero_copy_only=False)[order])
        a, b, s = _compare(x, where, k) if where.size <= exact else _search(x, where, k, degree, beam)
        return pa.table({"key": pa.array(keys[a], pa.int64()), "other": pa.array(keys[b], pa.int64()), "far": pa.array(-s, pa.float64())})

    links = routed.groupBy("lane", "shard").applyInArrow(answer, "key long, other long, far double")
    # a pair may come from both shards, with the same cosine; the k nearest ids stand in the k nearest directions, of equal ones those of smaller keys
    links = links.groupBy("key").agg(F.slice(F.sort_array(F.collect_set(F.struct("far", "other"))), 1, k).alias("l")).select("key", F.explode("l").alias("s")).select("key", "s.far", "s.other")
    theirs = links.join(ids.select(F.col("key").alias("other"), "ids"), "other").select("key", "far", F.explode("ids").alias("id"))
    own = ids.select("key", F.lit(-1.0).alias("far"), F.explode("ids").alias("id"))
    best = theirs.unionByName(own).groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("l"))
    members = who.select(F.col("key").alias("direction"), F.col("id").alias("me")).join(ids.select("direction", "key"), "direction")
    each = members.join(best, "key").select("me", F.posexplode(F.slice(F.filter("l", lambda s: s["id"] != F.col("me")), 1, k)).alias("rank", "s"))
    return each.select(F.col("me").cast(kd).alias(key), F.col("s.id").cast(kd).alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.least(F.lit(1.0), -F.col("s.far")).alias("cosine"))


def similar_pairs(neighbours: DataFrame, key: str = "vec_id", least: float = 0.88) -> DataFrame:
    """(key_a, key_b) of the pairs with a cosine of at least `least`, the smaller key first, each once."""
    p = neighbours.where(F.col("cosine") >= least)
    return p.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")).distinct()
