"""A small causal self-attention model over subword ids, in numpy.

A text is a line of leaves, 16 to a block. The query at a position sees its own block up to itself and the whole block
before, so windows of 32 overlap by half and every position is scored once. One attention layer feeds one hidden layer;
the next leaf is predicted in two steps, its cluster, for which the present leaf also has a direct say, and its place
in the cluster (32 x 32 leaves). Frequent ids have a leaf each, in order of frequency; all others share the leaves of
the last cluster and are told apart by their share of the leaf's count, so every id of the vocabulary has a probability.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK, FACES, WIDTH, SIDE = 16, 8, 32, 32  # positions of a block, width of keys, of the hidden layer, of the tree
LEAVES = SIDE * SIDE
COMMON = LEAVES - SIDE
BOUND = 40.0  # of attention scores, so that exp needs no shift
LIMIT = 60.0  # of logits
PASS = 512  # blocks that are scored at once, so that the tables stay in the cache
_NEVER = np.float32(-1e9)
_AWAY = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # from a query back to each position of its window
_BACK = np.clip(_AWAY, 0, 2 * BLOCK - 1)


def keep_memory() -> None:
    """From now on, this process reuses the memory of freed arrays.

    glibc hands blocks back to the system, which clears them again page by page, until a larger one has been freed.
    """
    np.empty((1 << 25) - (1 << 16), dtype=np.uint8)


class Vocabulary:
    """Leaves of the ids and log shares within a leaf, from the counts of all ids."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.leaf = np.empty(len(counts), dtype=np.int32)
        self.leaf[order[:COMMON]] = np.arange(min(COMMON, len(counts)))
        rest = order[COMMON:]
        self.leaf[rest] = COMMON + np.arange(len(rest)) % SIDE
        self.share = np.zeros(len(counts), dtype=np.float32)
        smooth = counts[rest] + 0.1
        of_leaf = np.bincount(self.leaf[rest] - COMMON, weights=smooth, minlength=SIDE)
        self.share[rest] = np.log(smooth / of_leaf[self.leaf[rest] - COMMON])
        self.frequency = np.bincount(self.leaf, weights=counts, minlength=LEAVES) + 0.5


def blocks(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`blocks_of` for separate lines."""
    flat = np.concatenate(lines) if lines else np.empty(0, np.int32)
    return blocks_of(flat, np.array([len(line) for line in lines], dtype=np.int64))


def blocks_of(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of leaves as blocks: inputs, targets (-1: none), whether a block begins a line, and each block's line.

    A line's first leaf is only an input; position i predicts leaf i + 1. No line is empty.
    """
    sizes = lengths - 1
    rows = -(-sizes // BLOCK)
    inputs = np.zeros(rows.sum() * BLOCK, dtype=np.int32)
    targets = np.full(rows.sum() * BLOCK, -1, dtype=np.int32)
    begins = np.cumsum(rows) - rows
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(begins * BLOCK, sizes) + inner
    source = np.repeat(np.cumsum(lengths) - lengths, sizes) + inner
    inputs[place], targets[place] = flat[source], flat[source + 1]
    starts = np.zeros(rows.sum(), dtype=bool)
    starts[begins[rows > 0]] = True
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), starts, np.repeat(np.arange(len(lengths)), rows)


class Model:
    """The weights, as one vector with named views, and what is needed to score with them."""

    SHAPES = {
        "embed": (LEAVES, WIDTH), "ask": (WIDTH, FACES), "key": (WIDTH, FACES), "value": (WIDTH, WIDTH), "own": (WIDTH, WIDTH),
        "bend": (WIDTH,), "far": (2 * BLOCK,), "cluster": (WIDTH, SIDE), "cluster0": (SIDE,), "pair": (LEAVES, SIDE), "member": (SIDE, WIDTH, SIDE), "member0": (SIDE, SIDE),
    }

    def __init__(self, vector: np.ndarray):
        self.vector = vector
        self.parts, at = {}, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            self.parts[name] = vector[at : at + n].reshape(shape)
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(map(math.prod, cls.SHAPES.values()))

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 5) -> "Model":
        draw = np.random.default_rng(seed)
        model = cls(np.zeros(cls.size(), dtype=np.float32))
        for name in ("embed", "ask", "key", "value", "own", "cluster", "member"):
            part = model.parts[name]
            part[:] = draw.normal(0, 0.3 if name == "embed" else part.shape[-2] ** -0.5, part.shape)
        tree = vocabulary.frequency.reshape(SIDE, SIDE)
        model.parts["cluster"] *= 0.1
        model.parts["member"] *= 0.1
        model.parts["cluster0"][:] = np.log(tree.sum(1) / tree.sum())
        model.parts["member0"][:] = np.log(tree / tree.sum(1, keepdims=True))
        return model

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries, keys, values and own parts of all leaves; queries and keys are limited in length."""
        p = self.parts
        ask, key = p["embed"] @ p["ask"], p["embed"] @ p["key"]
        for table in (ask, key):
            length = np.sqrt((table**2).sum(1, keepdims=True))
            table *= np.minimum(1, BOUND**0.5 / np.maximum(length, 1e-6))
        return ask, key, p["embed"] @ p["value"], p["embed"] @ p["own"] + p["bend"]

    def masks(self) -> np.ndarray:
        """(first block or not) x query x key: the bias by distance, or never."""
        seen = np.where(_AWAY >= 0, np.clip(self.parts["far"], -BOUND, BOUND)[_BACK], _NEVER)
        first = seen.copy()
        first[:, :BLOCK] = _NEVER
        return np.stack([seen, first]).astype(np.float32)

    def scores(self, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probability of each target leaf, 0 where there is none. Blocks of a line follow each other."""
        # All that is looked up for a leaf is one row: its tables and its direct say in the next cluster.
        table = np.concatenate([*self.tables(), self.parts["pair"] + self.parts["cluster0"]], axis=1)
        masks, out = self.masks(), np.empty(targets.shape, dtype=np.float32)
        for at in range(0, len(inputs), PASS):
            lead = min(at, 1)  # the block before the first one is its context
            some = slice(at - lead, at + PASS)
            out[at : at + PASS] = self._pass(table, masks, inputs[some], np.maximum(targets[some], 0), starts[some])[lead:]
        return np.where(targets >= 0, out, 0)

    def _pass(self, table, masks: np.ndarray, inputs: np.ndarray, goal: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rows = _windows(table, inputs)
        own = rows[:, BLOCK:]
        weights = np.matmul(own[..., _COLUMNS["ask"]], rows[..., _COLUMNS["key"]].transpose(0, 2, 1))
        weights += masks[0]
        weights[starts, :, :BLOCK] = _NEVER
        np.exp(weights, out=weights)
        hidden = np.matmul(weights, rows[..., _COLUMNS["value"]])
        hidden /= _row_sums(weights)
        hidden += own[..., _COLUMNS["own"]]
        np.maximum(hidden, 0, out=hidden)
        hidden = hidden.reshape(-1, WIDTH)
        p, goal = self.parts, goal.ravel()
        cluster, member = goal // SIDE, goal % SIDE
        outer = (hidden @ p["cluster"]).reshape(*inputs.shape, SIDE)
        outer += own[..., _COLUMNS["pair"]]
        found = _log_share(outer.reshape(-1, SIDE), cluster)
        order = np.argsort(cluster.astype(np.uint8), kind="stable")
        edges = np.searchsorted(cluster[order], np.arange(SIDE + 1)).tolist()
        grouped, inner = hidden.take(order, axis=0), np.empty((len(goal), SIDE), dtype=np.float32)
        for c in range(SIDE):
            some = slice(edges[c], edges[c + 1])
            np.matmul(grouped[some], p["member"][c], out=inner[some])
            inner[some] += p["member0"][c]
        found[order] += _log_share(inner, member[order])
        return found.reshape(inputs.shape)

    def slopes(self, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its slope, as a vector like the weights'. The first block begins a line or has none before it."""
        p, grad = self.parts, Model(np.empty_like(self.vector))
        g, kind = grad.parts, self.vector.dtype
        # The four tables of all leaves are columns of one, so each position looks up one row.
        maps = np.concatenate([p[name] for name in _TABLES], axis=1)
        table = p["embed"] @ maps
        longest = [np.einsum("ij,ij->i", x, x).max() for x in (table[:, _COLUMNS["ask"]], table[:, _COLUMNS["key"]])]
        table[:, _COLUMNS["own"]] += p["bend"]
        leaf = inputs.ravel().astype(np.intp)
        rows = _windows(table, inputs)
        q, k, v, own = rows[:, BLOCK:, _COLUMNS["ask"]], rows[:, :, _COLUMNS["key"]], rows[:, :, _COLUMNS["value"]], rows[:, BLOCK:, _COLUMNS["own"]]
        weights = np.matmul(q, k.transpose(0, 2, 1))
        if longest[0] * longest[1] > BOUND**2:  # else no product of two rows is above the bound
            np.minimum(weights, BOUND, out=weights)
        weights += self.masks()[0]
        weights[starts, :, :BLOCK] = _NEVER
        np.exp(weights, out=weights)
        weights /= _row_sums(weights)
        hidden = np.matmul(weights, v)
        hidden += own
        # The last column, of ones, meets the constant terms.
        h = np.ones((targets.size, WIDTH + 1), dtype=kind)
        np.maximum(hidden.reshape(-1, WIDTH), 0, out=h[:, :WIDTH])
        real, goal = targets.ravel() >= 0, np.maximum(targets.ravel(), 0)
        share = real.astype(kind) / max(1, int(real.sum()))
        cluster, member = goal // SIDE, goal % SIDE

        slope = np.empty((targets.size, _COLUMNS["pair"].stop), dtype=kind)
        outer = h @ np.concatenate([p["cluster"], p["cluster0"][None]])
        outer += p["pair"].take(leaf, axis=0)
        loss = _to_slopes(outer, cluster, share)
        slope[:, _COLUMNS["pair"]] = outer
        found = h.T @ outer
        g["cluster"][:], g["cluster0"][:] = found[:WIDTH], found[WIDTH]

        order = np.argsort(cluster.astype(np.uint8), kind="stable")
        edges = np.searchsorted(cluster[order], np.arange(SIDE + 1)).tolist()
        full = np.concatenate([p["member"], p["member0"][:, None]], axis=1)
        grouped, inner = h.take(order, axis=0), np.empty((targets.size, SIDE), dtype=kind)
        some = [(c, slice(edges[c], edges[c + 1])) for c in range(SIDE)]
        for c, at in some:
            np.matmul(grouped[at], full[c], out=inner[at])
        loss += _to_slopes(inner, member[order], share[order])
        back = np.empty((targets.size, WIDTH), dtype=kind)
        for c, at in some:
            found = grouped[at].T @ inner[at]
            g["member"][c], g["member0"][c] = found[:WIDTH], found[WIDTH]
            np.matmul(inner[at], p["member"][c].T, out=back[at])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        above = outer @ p["cluster"].T
        above += back.take(place, axis=0)
        above *= h[:, :WIDTH] > 0
        above = above.reshape(hidden.shape)

        d_value = np.matmul(weights.transpose(0, 2, 1), above)
        d_weights = np.matmul(above, v.transpose(0, 2, 1))
        d_weights -= np.einsum("bij,bij->bi", weights, d_weights)[:, :, None]
        d_weights *= weights
        g["bend"][:] = above.reshape(-1, WIDTH).sum(0)
        g["far"][:] = np.bincount(_BACK.ravel(), weights=d_weights.sum(0).ravel(), minlength=2 * BLOCK)
        own_slope = slope.reshape(*inputs.shape, -1)
        own_slope[:, :, _COLUMNS["ask"]] = np.matmul(d_weights, k)
        own_slope[:, :, _COLUMNS["own"]] = above
        for name, d in (("key", np.matmul(d_weights.transpose(0, 2, 1), q)), ("value", d_value)):
            # What a block's positions get as context of the block after comes on top; a line's first block has none.
            own_slope[:, :, _COLUMNS[name]] = d[:, BLOCK:]
            own_slope[:-1, :, _COLUMNS[name]] += d[1:, :BLOCK]
        summed = _summed(leaf, slope)
        g["pair"][:] = summed[:, _COLUMNS["pair"]]
        of_tables = summed[:, : maps.shape[1]]
        g["embed"][:] = of_tables @ maps.T
        found = p["embed"].T @ of_tables
        for name in _TABLES:
            g[name][:] = found[:, _COLUMNS[name]]
        return loss, grad.vector


_TABLES = ("ask", "key", "value", "own")
_COLUMNS = {}
for _name in (*_TABLES, "pair"):
    _at = max((x.stop for x in _COLUMNS.values()), default=0)
    _COLUMNS[_name] = slice(_at, _at + Model.SHAPES[_name][1])


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is kept."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], dtype=x.dtype)).reshape(*x.shape[:-1], 1)


def _to_slopes(logits: np.ndarray, goal: np.ndarray, share: np.ndarray) -> float:
    """The weighted loss of the goals after a softmax; the logits become its slope."""
    if not -LIMIT <= logits.min(initial=0) <= logits.max(initial=0) <= LIMIT:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    sums = _row_sums(logits)[:, 0]
    cells, at = logits.reshape(-1), np.arange(len(goal)) * logits.shape[1] + goal
    loss = -float(np.log(cells[at] / sums) @ share)
    logits *= (share / sums)[:, None]
    cells[at] -= share
    return loss


def _summed(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by leaf: sorted by cluster, then one product with the members' marks for each."""
    order = np.argsort((at // SIDE).astype(np.uint8), kind="stable")
    at, rows = at[order], rows.take(order, axis=0)
    edges = np.searchsorted(at // SIDE, np.arange(SIDE + 1)).tolist()
    marks = np.zeros((len(at), SIDE), dtype=rows.dtype)
    marks.reshape(-1)[np.arange(len(at)) * SIDE + at % SIDE] = 1
    table = np.empty((LEAVES, rows.shape[1]), dtype=rows.dtype)
    for c in range(SIDE):
        some = slice(edges[c], edges[c + 1])
        np.matmul(marks[some].T, rows[some], out=table[c * SIDE : (c + 1) * SIDE])
    return table


def _windows(table: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """For each block, the rows of the block before and its own: windows that overlap by half, as one view."""
    rows = np.empty((len(inputs) + 1, BLOCK, table.shape[1]), dtype=table.dtype)
    rows[0] = 0
    np.take(table, inputs, axis=0, out=rows[1:], mode="clip")  # numpy copies through a buffer unless it may clip
    block, row, cell = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (len(inputs), 2 * BLOCK, table.shape[1]), (block, row, cell), writeable=False)


def _log_share(logits: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Log of each row's share of one column after a softmax; logits are limited instead of shifted, on both sides of the fraction."""
    if not -LIMIT <= logits.min(initial=0) <= logits.max(initial=0) <= LIMIT:
        np.clip(logits, -LIMIT, LIMIT, out=logits)
    chosen = logits.reshape(-1)[np.arange(len(logits)) * logits.shape[1] + columns]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(logits.shape[1], dtype=np.float32))


class Adam:
    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.first, self.second, self.work = (np.zeros_like(model.vector) for _ in range(3))

    def __call__(self, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray, rate: float = 1.0) -> float:
        loss, slope = self.model.slopes(inputs, targets, starts)
        self.step += 1
        # In place and in this order, as each array is read and written from memory.
        work = self.work
        for mean, part in ((self.first, 0.1), (self.second, 0.01)):
            np.subtract(slope, mean, out=work)
            work *= part
            mean += work
            slope *= slope
        np.sqrt(self.second, out=work)
        work += 1e-8
        np.divide(self.first, work, out=work)
        work *= self.rate * rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)
        self.model.vector -= work
        return loss
