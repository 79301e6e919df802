"""Small numpy helpers used inside grouped-map tasks.

Every caller bounds the rows that reach one task before it comes here; larger
groups take the DataFrame route in ``operators.spectral``.
"""

from __future__ import annotations

import numpy as np

DENSE_SIDE = 600  # up to this many columns the Gram matrix is held dense
DENSE_RESCUE = 3_000  # and up to this many if the iteration does not settle soon
CHUNK = 1 << 20  # entries multiplied at a time
TOLERANCE = 1e-6  # of the residuals of an embedding
PRIME = 2**31 - 1  # of the draws of k-means starts
TRIES = 10  # k-means starts
ROUNDS = 500  # of one k-means try
QUICK = 6  # restarts of an iteration before it keeps more vectors
KEPT, SPACE = 24, 96  # vectors beyond the wanted ones that it keeps then, and the most that its space has
SAME_COST = 1e-5  # tries whose costs differ by less are equally good


class Sparse:
    """Entries (row, col, value) with products that never build the full matrix."""

    def __init__(self, rows, cols, vals, shape):
        self.shape = shape
        self.by_row = self._ordered(rows, cols, vals)
        self.by_col = self._ordered(cols, rows, vals)

    @staticmethod
    def _ordered(major, minor, vals):
        order = np.lexsort((minor, major))
        return np.asarray(major)[order], np.asarray(minor)[order], np.asarray(vals, dtype=float)[order]

    @staticmethod
    def _product(ordered, x, size):
        major, minor, vals = ordered
        # column by column: gathers and sums run over contiguous numbers
        columns = np.ascontiguousarray(x.T)
        out = np.zeros((len(columns), size))
        for lo in range(0, len(vals), CHUNK):
            part = slice(lo, lo + CHUNK)
            starts = np.flatnonzero(np.r_[True, np.diff(major[part]) != 0])
            ends = major[part][starts]
            for total, column in zip(out, columns):
                total[ends] += np.add.reduceat(vals[part] * column[minor[part]], starts)
        return np.ascontiguousarray(out.T)

    def times(self, x):
        return self._product(self.by_row, x, self.shape[0])

    def t_times(self, x):
        return self._product(self.by_col, x, self.shape[1])

    def gram(self):
        """Dense columns-by-columns matrix, summed over blocks of rows."""
        major, minor, vals = self.by_row
        n_cols = self.shape[1]
        out = np.zeros((n_cols, n_cols))
        step = 2_048
        for lo in range(0, self.shape[0], step):
            a, b = np.searchsorted(major, (lo, lo + step))
            if a == b:
                continue
            block = np.zeros((min(step, self.shape[0] - lo), n_cols))
            np.add.at(block, (major[a:b] - lo, minor[a:b]), vals[a:b])
            out += block.T @ block
        return out


def top_eigenvectors(apply, size, k, seed=7, width=4, depth=8, restarts=60, tol=TOLERANCE, dense=None):
    """The k algebraically largest eigenpairs of a symmetric operator by restarted block Krylov.

    The iteration ends when the residuals are small, and raises if they stay large. Where the leading
    eigenvalues lie too close together for ``QUICK`` restarts, ``dense`` builds the matrix and it is factored whole
    if the size allows it; else ``thick_restarts`` goes on.
    """
    rescue = dense is not None and size <= DENSE_RESCUE
    rng = np.random.default_rng(seed)
    block = min(size, k + width)
    start = np.linalg.qr(rng.standard_normal((size, block)))[0]
    for _ in range(min(QUICK, restarts)):
        basis = [start]
        for _ in range(depth - 1):
            if sum(b.shape[1] for b in basis) >= size:
                break
            nxt = apply(basis[-1])
            for _ in range(2):
                for b in basis:
                    nxt = nxt - b @ (b.T @ nxt)
            q, r = np.linalg.qr(nxt)
            alive = np.abs(np.diag(r)) > 1e-12
            if not alive.any():
                break
            basis.append(q[:, alive])
        space = np.linalg.qr(np.hstack(basis))[0]
        image = apply(space)
        vals, vecs = np.linalg.eigh(space.T @ image)
        order = np.argsort(-vals)[:block]
        vals, start = vals[order], space @ vecs[:, order]
        residual = np.linalg.norm(image @ vecs[:, order[:k]] - start[:, :k] * vals[:k], axis=0)
        if (residual <= tol * max(abs(vals[0]), 1e-300)).all():
            return vals[:k], start[:, :k]
    if rescue:
        vals, vecs = np.linalg.eigh(dense())
        return vals[::-1][:k], vecs[:, ::-1][:, :k]
    return thick_restarts(apply, start, k, restarts, tol)


def thick_restarts(apply, start, k, restarts, tol=TOLERANCE):
    """The k largest eigenpairs from an orthonormal ``start`` that an iteration did not finish.

    A restart keeps ``KEPT`` vectors beyond k, not the leading few only: values beside the k-th one, many of
    which may lie close to it, then no longer hold it up. The space grows from the residuals of the wanted vectors
    that are not there yet: few, so the chain of products is long. Images are kept, so a vector is multiplied once.
    """
    space, image = start, apply(start)
    most = min(len(start), k + SPACE)
    for _ in range(restarts):
        vals, vecs = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        vals, vecs = vals[::-1][: k + KEPT], vecs[:, ::-1][:, : k + KEPT]
        space, image = space @ vecs, image @ vecs
        nxt = image - space * vals
        residual = np.linalg.norm(nxt[:, :k], axis=0)
        late = np.flatnonzero(residual > tol * max(abs(vals[0]), 1e-300))
        if not len(late):
            return vals[:k], space[:, :k]
        nxt = nxt[:, late]
        while space.shape[1] < most:
            nxt = nxt - space @ (space.T @ nxt)
            q, r = np.linalg.qr(nxt)
            q = q[:, np.abs(np.diag(r)) > 1e-12][:, : most - space.shape[1]]
            if not q.shape[1]:
                break
            q = np.linalg.qr(q - space @ (space.T @ q))[0]
            nxt = apply(q)
            space, image = np.hstack([space, q]), np.hstack([image, nxt])
    raise RuntimeError(f"no convergence: residuals {residual} after {restarts} restarts")


def left_singular(rows, cols, vals, shape, k):
    """First k left singular vectors (rows x k) and singular values."""
    k = min(k, *shape)
    entries = Sparse(rows, cols, vals, shape)
    if shape[1] <= DENSE_SIDE:
        lam, v = np.linalg.eigh(entries.gram())
        lam, v = lam[::-1][:k], v[:, ::-1][:, :k]
    else:
        lam, v = top_eigenvectors(lambda x: entries.t_times(entries.times(x)), shape[1], k, dense=entries.gram)
    sigma = np.sqrt(np.maximum(lam, 0.0))
    alive = sigma > 1e-9 * max(sigma.max(initial=0.0), 1e-300)
    u = entries.times(v)
    u[:, alive] /= sigma[alive]
    u[:, ~alive] = 0.0
    return u, sigma


def top_algebraic(rows, cols, vals, size, k):
    """Eigenvectors of the k largest signed eigenvalues of a symmetric matrix."""
    k = min(k, size)
    entries = Sparse(rows, cols, vals, (size, size))
    if size <= DENSE_SIDE:
        dense = np.zeros((size, size))
        np.add.at(dense, (np.asarray(rows), np.asarray(cols)), np.asarray(vals, dtype=float))
        lam, v = np.linalg.eigh((dense + dense.T) / 2)
        return v[:, ::-1][:, :k], lam[::-1][:k]
    # The Krylov space holds both ends of the spectrum: no shift is needed.
    lam, v = top_eigenvectors(entries.times, size, k)
    return v, lam


def unit_rows(x):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x.copy(), where=norm > 0)


def draw(node, salt, mod=np.remainder):
    """A number in (0, 1) from a node id and a salt, the same for numpy arrays and for columns with ``mod=pmod``."""
    x = mod(mod(node, PRIME) + mod(salt * 69_621, PRIME), PRIME)
    x = mod(x * x + 12_345, PRIME)
    x = mod(x * 48_271 + salt, PRIME)
    return (mod(x * x, PRIME) + 0.5) / PRIME


def salt(seed, attempt, i):
    """The salt of the i-th start of an attempt; ``attempt`` is a number or a column."""
    return attempt * 1_009 + (seed * 100_003 + i) % 1_000_000


def kmeans(x, nodes, k, seed=7, tries=TRIES, rounds=ROUNDS):
    """Lloyd's k-means on the rows of ``nodes`` (ascending ids): best of ``tries``, clusters numbered by lowest node.

    Starts are k-means++ picks by draws of the node ids: the point with the least ``-log(draw) / gap`` is one
    with odds as its squared gap. A try ends when no label changes, and an empty cluster keeps its centre.
    ``operators.cluster.kmeans_by`` takes the same steps.
    """
    done = []
    for t in range(tries):
        centres = x[[draw(nodes, salt(seed, t, 0)).argmin()]]
        while len(centres) < k:
            gap = ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1)
            race = np.full(len(x), np.inf)
            far = gap > 0
            race[far] = -np.log(draw(nodes[far], salt(seed, t, len(centres)))) / gap[far]
            centres = np.vstack([centres, x[race.argmin()]])
        labels = None
        for _ in range(rounds):
            dist = ((x[:, None, :] - centres[None]) ** 2).sum(2)
            fresh = dist.argmin(1)
            if labels is not None and (fresh == labels).all():
                break
            labels = fresh
            for c in range(k):
                if (labels == c).any():
                    centres[c] = x[labels == c].mean(0)
        else:
            raise RuntimeError(f"k-means did not converge in {rounds} rounds")
        done.append((dist.min(1).sum(), labels))
    # the first of the tries that are equally good
    limit = min(cost for cost, _ in done) * (1 + SAME_COST)
    best = next(labels for cost, labels in done if cost <= limit)
    _, first, labels = np.unique(best, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[labels]
