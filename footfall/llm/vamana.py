"""A robust-pruned directed graph over the vectors of one shard.

Nodes are put in by growing batches.  A batch searches the graph greedily; what a search
has expanded are the proposed neighbours.  Of these the nearest is kept again and again,
and others go that are nearer to it than to the node by more than ``ALPHA``, which leaves
few, diverse edges.  Every edge is also offered the other way, and a node with too many is
pruned likewise; it has room for half as many more, so that this is rare.  A search is a beam search over the graph from its first nodes, which are
drawn at random, so that searches do not start inside one dense group.

Nearness is the inner product.  For edges each vector gets one more component, which
brings all to the same length, so that the nearest by distance is the nearest by product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

DEGREE, ALPHA = 24, 1.2
BUILD_BEAM, WIDTH = 64, 4
#: Nodes where every search starts.
ENTRIES = 64
#: Nodes put in, and queries searched, at a time.
BATCH = 1024
NONE = -1


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component each, all of length 1, in single precision.

    They are brought to a largest component of 1 first, so no square overflows.
    """
    vectors = vectors / np.abs(vectors).max(initial=1e-300)
    squares = (vectors * vectors).sum(axis=1)
    longest = squares.max(initial=1e-300)
    rest = np.sqrt(np.maximum(longest - squares, 0))
    return (np.column_stack([vectors, rest]) / np.sqrt(longest)).astype(np.float32)


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.einsum("...j,...j->...", rows, queries)


def closeness(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Minus the squared distance; exact for near points, where a product is not."""
    apart = rows - queries
    return -np.einsum("...j,...j->...", apart, apart)


def beam_search(
    points: np.ndarray,
    edges: np.ndarray,
    queries: np.ndarray,
    beam: int,
    nearness: Callable[[np.ndarray, np.ndarray], np.ndarray] = products,
) -> tuple[np.ndarray, np.ndarray]:
    """(queries, beam): the nearest nodes found, nearest first, and those expanded; else -1.

    Each round expands up to ``WIDTH`` of a query's nearest nodes that are not yet.
    """
    n, room = len(queries), edges.shape[1]
    size = room * WIDTH
    entries = min(beam, ENTRIES, len(points))
    nodes = np.full((n, beam), NONE, np.int32)
    near = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    nodes[:, :entries], done[:, :entries] = np.arange(entries), False
    near[:, :entries] = nearness(points[:entries], queries[:, None])
    first = np.argsort(-near, axis=1)
    nodes, near = np.take_along_axis(nodes, first, 1), np.take_along_axis(near, first, 1)
    seen = np.zeros((n, len(points)), bool)
    seen[:, :entries] = True
    expanded, going = [], np.arange(n)
    while len(going):
        open_ = ~done[going]
        turn = np.cumsum(open_, axis=1)
        take = open_ & (turn <= WIDTH)
        row, place = np.nonzero(take)
        of = going[row]
        node = nodes[of, place]
        done[of, place] = True
        turn = turn[row, place] - 1
        now = np.full((n, WIDTH), NONE, np.int32)
        now[of, turn] = node
        expanded.append(now)
        more = np.full((n, size), -np.inf, np.float32)
        ids = np.full((n, size), NONE, np.int32)
        # one after the other, so that a node reached from two of them counts once
        for k in range(WIDTH):
            mine, whose = node[turn == k], of[turn == k]
            to = edges[mine]
            i, slot = np.nonzero((to >= 0) & ~seen[whose[:, None], to])
            to, whose = to[i, slot], whose[i]
            seen[whose, to] = True
            slot += k * room
            more[whose, slot] = nearness(points[to], queries[whose])
            ids[whose, slot] = to
        all_near = np.concatenate([near[going], more[going]], axis=1)
        all_nodes = np.concatenate([nodes[going], ids[going]], axis=1)
        all_done = np.concatenate([done[going], ids[going] < 0], axis=1)
        best = np.argsort(-all_near, axis=1)[:, :beam]
        near[going] = np.take_along_axis(all_near, best, 1)
        nodes[going] = np.take_along_axis(all_nodes, best, 1)
        done[going] = np.take_along_axis(all_done, best, 1)
        going = going[~done[going].all(axis=1)]
    return nodes, np.concatenate(expanded, axis=1) if expanded else nodes[:, :0]


def pruned(points: np.ndarray, of: np.ndarray, proposed: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each node of ``of`` among those ``proposed``."""
    proposed = np.sort(proposed, axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = NONE
    proposed[proposed == of[:, None]] = NONE
    there = points[proposed]
    there -= points[of][:, None]
    apart = np.einsum("ikj,ikj->ik", there, there)
    apart[proposed < 0] = np.inf
    order = np.argsort(apart, axis=1)
    apart, proposed = np.take_along_axis(apart, order, 1), np.take_along_axis(proposed, order, 1)
    there = np.take_along_axis(there, order[:, :, None], 1)
    between = there @ there.transpose(0, 2, 1)
    squares = np.einsum("ikj,ikj->ik", there, there)
    between = squares[:, :, None] + squares[:, None] - 2 * between
    alive, rows = np.isfinite(apart), np.arange(len(of))
    out = np.full((len(of), degree), NONE, np.int32)
    for k in range(degree):
        any_ = alive.any(axis=1)
        if not any_.any():
            break
        first = alive.argmax(axis=1)
        out[any_, k] = proposed[rows, first][any_]
        alive &= ALPHA * ALPHA * between[rows, first] > apart
        alive[rows, first] = False
    return out


def _offer(points: np.ndarray, edges: np.ndarray, of: np.ndarray, degree: int) -> None:
    """Put in the edges back to the nodes ``of`` from their neighbours."""
    room = edges.shape[1]
    to = edges[of].ravel()
    source = np.repeat(of, room)[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order].astype(np.int32)
    place = np.arange(len(to)) - np.searchsorted(to, to, "left")
    for turn in range(0, int(place.max(initial=-1)) + 1, degree):
        now = (place >= turn) & (place < turn + degree)
        nodes, row = np.unique(to[now], return_inverse=True)
        more = np.full((len(nodes), degree), NONE, np.int32)
        more[row, place[now] - turn] = source[now]
        have = np.concatenate([edges[nodes], more], axis=1)
        full = (have >= 0).sum(axis=1) > room
        edges[nodes[~full]] = -np.sort(-have[~full], axis=1)[:, :room]
        nodes, have = nodes[full], have[full]
        for at in range(0, len(nodes), BATCH):
            part = slice(at, at + BATCH)
            edges[nodes[part], :degree] = pruned(points, nodes[part], have[part], degree)
        edges[nodes, degree:] = NONE


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """An order of the vectors, drawn at random, and the neighbours of each; -1 fills up."""
    points = lifted(vectors)
    order = np.random.default_rng(len(points)).permutation(len(points))
    points = points[order]
    edges = np.full((len(points), degree + degree // 2), NONE, np.int32)
    done = 1
    while done < len(points):
        batch = np.arange(done, min(len(points), done + min(done, BATCH)))
        _, expanded = beam_search(points[:done], edges[:done], points[batch], beam, closeness)
        edges[batch, :degree] = pruned(points, batch, expanded, degree)
        _offer(points, edges, batch, degree)
        done += len(batch)
    return order, edges
