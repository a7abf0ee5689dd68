"""A gated recurrent language model in numpy with a class-factored softmax.

The model speaks of units: frequent words, and groups of rarer ones, inside which a
word's share is fixed by its count.  ``SIZE`` units make a class; a unit's probability
is that of its class times that of the unit in it, both by a softmax of the state.
Many documents run side by side in lanes, one after the other in each; a document's
state goes from window to window until it ends, and the next begins with none.
"""

from __future__ import annotations

import math

import numpy as np

HIDDEN, INPUT, WINDOW = 32, 24, 32
#: Units of a class.
SIZE = 64
#: Lanes at most, and tokens that each has at least, if there are so many.
LANES, LANE_TOKENS = 256, 2000
#: Rows whose probabilities are worked out at once, at most: a core's cache holds them, and BLAS need not copy such products' factors.
ROWS = 448
HALF, ONE = np.float32(0.5), np.float32(1)


def init(n_inputs: int, class_log: np.ndarray, unit_log: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights that say exactly the class and unit logs before any training.

    class_log: natural logs of the classes; unit_log: (classes, SIZE).
    """
    rng = np.random.default_rng(seed)
    normal = lambda *s, by=0.1: rng.normal(0, by, s).astype(np.float32)
    return {
        "E": normal(n_inputs, INPUT, by=0.3), "W": normal(INPUT, 3 * HIDDEN, by=0.3), "b": np.zeros(3 * HIDDEN, np.float32), "U": normal(HIDDEN, 3 * HIDDEN, by=0.2),
        "C": np.zeros((HIDDEN, len(class_log)), np.float32), "c": class_log.astype(np.float32),
        "O": np.zeros((len(unit_log), HIDDEN, SIZE), np.float32), "o": unit_log.astype(np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(like: dict[str, np.ndarray], values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = values[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


class Room:
    """Arrays by name that are used again: fresh ones of some MB cost more than what is written to them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def with_one(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights of a one and of the states, whose product with (one, state) is their sum."""
    return np.concatenate([bias[..., None, :], weights], axis=-2)


def behind_ones(E: np.ndarray) -> np.ndarray:
    """The inputs' rows with a one before each."""
    out = np.ones((len(E), 1 + INPUT), np.float32)
    out[:, 1:] = E
    return out


def forward(p: dict[str, np.ndarray], E: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: Room, keep: bool = False):
    """States (steps + 1, 1 + HIDDEN, lanes), a one before each, after each step of inputs (steps, lanes) from h (lanes, HIDDEN).

    E: the inputs' rows ``behind_ones``; fresh marks steps that begin a document.  Lanes come last, so that what a step works on lies in one
    piece.  Returns (states, what backward needs: each step's inputs (lanes, a one and INPUT), its states
    before, and if keep its recurrent share of the new part, gates r and z and new part, one below the other).
    """
    n = HIDDEN
    steps, lanes = inputs.shape
    half = np.ones(3 * n, np.float32)
    half[: 2 * n] = HALF  # a gate is 0.5 + 0.5 tanh of half its sum
    W = np.ascontiguousarray((with_one(p["W"], p["b"]) * half).T)
    U = np.concatenate([p["U"][:, 2 * n :], p["U"][:, : 2 * n] * HALF], axis=1).T.copy()
    read, turned = room("read", steps, lanes, 1 + INPUT), room("turned", steps, 1 + INPUT, lanes)
    E.take(inputs, axis=0, out=read, mode="clip")
    turned[...] = read.transpose(0, 2, 1)
    states = room("states", steps + 1, 1 + n, lanes)
    states[:, 0] = 1
    states[0, 1:] = h.T
    parts = room("parts", steps if keep else 1, 4 * n, lanes)
    u, share = np.empty((3 * n, lanes), np.float32), np.empty((n, lanes), np.float32)
    befores = []
    begins = fresh.any(axis=1).tolist()
    for t in range(steps):
        before, part, out = states[t, 1:], parts[t if keep else 0], states[t + 1, 1:]
        if begins[t]:
            before = before * ~fresh[t]
        befores.append(before)
        gates, new = part[n : 3 * n], part[3 * n :]
        np.matmul(W, turned[t], out=part[n:])
        np.matmul(U, before, out=u)
        gates += u[n:]
        np.tanh(gates, out=gates)
        gates *= HALF
        gates += HALF
        if keep:
            part[:n] = u[:n]
        np.multiply(u[:n], part[n : 2 * n], out=share)
        new += share
        np.tanh(new, out=new)
        np.subtract(before, new, out=out)
        out *= part[2 * n : 3 * n]
        out += new
    return states, (read, befores, parts)


def by_step(states: np.ndarray, room: Room) -> np.ndarray:
    """(steps, lanes, 1 + HIDDEN) of states (steps, 1 + HIDDEN, lanes)."""
    out = room("rows", states.shape[0], states.shape[2], states.shape[1])
    out[...] = states.transpose(0, 2, 1)
    return out


def run(p: dict[str, np.ndarray], inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """(states (steps + 1, lanes, HIDDEN), what backward needs) of ``forward``."""
    states, saved = forward(p, behind_ones(p["E"]), inputs, fresh, h, Room())
    return states[:, 1:].transpose(0, 2, 1), saved


def softmax_slopes(x: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """Scale times the slopes of minus each row's log probability at one place, in place of x."""
    if x.max(initial=0) > 60:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= (scale / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    x.ravel()[np.arange(0, x.size, x.shape[1]) + at] -= scale
    return x


def picked_logs(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row's log probability at one place; x is used up.  Only large values need a shift against overflow."""
    if x.max(initial=0) > 60:
        x -= x.max(axis=1, keepdims=True)
    out = x.ravel()[np.arange(0, x.size, x.shape[1]) + at]
    np.exp(x, out=x)
    return out - np.log(x @ np.ones(x.shape[1], x.dtype))


def by_class(classes: np.ndarray):
    """(rows in order of their classes, [(class, first, last)]), of ROWS rows at most each."""
    rows = np.argsort(classes.astype(np.uint16), kind="stable")
    sizes = np.bincount(classes)
    ends = np.cumsum(sizes).tolist()
    return rows, [(k, a, min(a + ROWS, ends[k])) for k in np.flatnonzero(sizes).tolist() for a in range(ends[k] - int(sizes[k]), ends[k], ROWS)]


def runs_of(parts: list[tuple[int, int, int]]):
    """Runs of parts of ROWS rows at most: (the parts, first row, last row)."""
    some: list[tuple[int, int, int]] = []
    for part in parts:
        if some and part[2] - some[0][1] > ROWS:
            yield some, some[0][1], some[-1][2]
            some = []
        some.append(part)
    if some:
        yield some, some[0][1], some[-1][2]


def log_probabilities(p: dict[str, np.ndarray], states: np.ndarray, units: np.ndarray, room: Room | None = None, O: np.ndarray | None = None) -> np.ndarray:
    """Natural log of each unit's probability: of its class, and of its place in it.  states: with a one before each, or without; O: O and o side by side."""
    if states.shape[1] == HIDDEN:
        states = np.concatenate([np.ones((len(states), 1), np.float32), states], axis=1)
    classes = units // SIZE
    rows, parts = by_class(classes)
    room = room or Room()
    states = states.take(rows, axis=0, out=room("sorted", *states.shape), mode="clip")
    classes, places = classes[rows], (units % SIZE)[rows]
    C, O = with_one(p["C"], p["c"]), with_one(p["O"], p["o"]) if O is None else O
    logs, out = np.empty(len(units)), np.empty(len(units))
    for some, first, last in runs_of(parts):
        logs[first:last] = picked_logs(np.matmul(states[first:last], C, out=room("class", last - first, C.shape[1])), classes[first:last])
        x = room("place", last - first, SIZE)
        for k, a, b in some:
            np.matmul(states[a:b], O[k], out=x[a - first : b - first])
        logs[first:last] += picked_logs(x, places[first:last])
    out[rows] = logs
    return out


class Trainer:
    """Adagrad over windows of truncated backpropagation."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.1):
        # with ones before the inputs and the biases before the weights, of which those of p are parts
        self.E, self.O = behind_ones(p["E"]), with_one(p["O"], p["o"])
        self.p = {k: v.copy() for k, v in p.items()} | {"E": self.E[:, 1:], "O": self.O[:, 1:], "o": self.O[:, 0]}
        self.rate, self.seen = rate, 0
        self.room = Room()
        self.squares = {k: np.full(v.shape, 1e-6, np.float32) for k, v in p.items()}

    def step(self, name: str, grad: np.ndarray, at=None) -> None:
        np.clip(grad, -1, 1, out=grad)
        s = self.squares[name] if at is None else self.squares[name].take(at, axis=0)
        root = np.multiply(grad, grad, out=self.room("root", *grad.shape))
        s += root
        if at is not None:
            self.squares[name][at] = s
        np.sqrt(s, out=root)
        grad *= self.rate
        grad /= root
        if at is None:
            self.p[name] -= grad
        else:
            self.p[name][at] -= grad

    def window(self, inputs, fresh, units, mask, h) -> np.ndarray:
        """One update from a window; units: what is to be foretold, mask: which steps are real.  Returns the last states."""
        p, n, room = self.p, HIDDEN, self.room
        states, (read, befores, parts) = forward(p, self.E, inputs, fresh, h, room, True)
        steps, lanes = inputs.shape
        real = np.flatnonzero(mask.ravel())
        if not len(real):
            return states[-1, 1:].T.copy()
        self.seen += len(real)
        rows = by_step(states, room)
        by_state, grads = self.outputs(rows[1:].reshape(-1, 1 + n), units.ravel(), real)
        every = room("every", steps, n, lanes)
        every[...] = by_state.reshape(steps, lanes, n).transpose(0, 2, 1)
        # back through the steps, the products of some steps at once where lanes are few
        U, W = np.concatenate([p["U"][:, 2 * n :], p["U"][:, : 2 * n]], axis=1), np.ascontiguousarray(p["W"].T)
        dU, dW, dE = np.zeros((3 * n, n), np.float32), np.zeros((3 * n, 1 + INPUT), np.float32), room("dE", steps * lanes, INPUT)
        together = max(1, min(steps, 128 // lanes))
        d, by = np.empty((4 * n, together, lanes), np.float32), np.empty((together, 4 * n, lanes), np.float32)
        some, carry = np.empty((n, lanes), np.float32), np.zeros((n, lanes), np.float32)
        begins = fresh.any(axis=1).tolist()
        for last in range(steps, 0, -together):
            first = max(0, last - together)
            # what the gradient of a state is multiplied by to be that of its share's, r's, z's and new part's sums
            part, to = parts[first:last], by[: last - first]
            new, to_new, rest = part[:, 3 * n :], to[:, 3 * n :], ONE - part[:, n : 3 * n]
            np.multiply(part[:, n : 3 * n], rest, out=to[:, n : 3 * n])
            np.multiply(new, new, out=to_new)
            np.subtract(ONE, to_new, out=to_new)
            to_new *= rest[:, n:]
            np.multiply(to_new, part[:, n : 2 * n], out=to[:, :n])
            to[:, n : 2 * n] *= to_new
            to[:, n : 2 * n] *= part[:, :n]
            to[:, 2 * n : 3 * n] *= (befores[first][None] if last - first == 1 else np.stack(befores[first:last])) - new
            for t in range(last - 1, first - 1, -1):
                dh = every[t]
                dh += carry
                np.multiply(to[t - first].reshape(4, n, lanes), dh, out=d.reshape(4, n, together, lanes)[:, :, t - first])
                np.matmul(U, d[: 3 * n, t - first], out=carry)
                carry += np.multiply(dh, parts[t, 2 * n : 3 * n], out=some)
                if begins[t]:
                    carry *= ~fresh[t]
            before = rows[first:last].reshape(-1, 1 + n)[:, 1:]
            if any(begins[first:last]):
                before = before * ~fresh[first:last].reshape(-1, 1)
            slopes = d[:, : last - first].reshape(4 * n, -1)
            dU += slopes[: 3 * n] @ before
            dW += slopes[n:] @ read[first:last].reshape(-1, 1 + INPUT)
            np.matmul(slopes[n:].T, W, out=dE[first * lanes : last * lanes])
        order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")
        held = inputs.ravel()[order]
        starts = np.flatnonzero(np.diff(held, prepend=-1))
        grads += [("W", dW[:, 1:].T, None), ("b", dW[:, 0], None), ("U", np.concatenate([dU[n:], dU[:n]]).T, None)]
        grads.append(("E", np.add.reduceat(dE.take(order, axis=0, out=room("sorted", *dE.shape), mode="clip"), starts), held[starts]))
        for name, g, at in grads:
            self.step(name, g, at)
        return states[-1, 1:].T.copy()

    def outputs(self, states, units, real):
        """Gradients of the units' classes and places in them: by each state (a row, HIDDEN), and those of C, c, O and o."""
        p, n, room = self.p, HIDDEN, self.room
        classes = units // SIZE
        rows, parts = by_class(classes[real])
        real = real[rows]
        classes, places, some = classes[real], units[real] % SIZE, states.take(real, axis=0, out=room("sorted", len(real), 1 + n), mode="clip")
        C, O, C_back, O_back = with_one(p["C"], p["c"]), self.O, p["C"].T.copy(), p["O"].transpose(0, 2, 1)
        if len(real) > 4 * ROWS:  # products with what lies in one piece are faster
            O_back = np.ascontiguousarray(O_back)
        grad, dC, dO = room("grad", len(real), n), np.zeros(C.shape, np.float32), np.zeros((len(O), 1 + n, SIZE), np.float32)
        scale = np.float32(1 / len(real))
        for run, first, last in runs_of(parts):
            x = softmax_slopes(np.matmul(some[first:last], C, out=room("class", last - first, C.shape[1])), classes[first:last], scale)
            dC += some[first:last].T @ x
            np.matmul(x, C_back, out=grad[first:last])
            x = room("place", last - first, SIZE)
            for k, a, b in run:
                np.matmul(some[a:b], O[k], out=x[a - first : b - first])
            softmax_slopes(x, places[first:last], scale)
            for k, a, b in run:
                own = x[a - first : b - first]
                grad[a:b] += own @ O_back[k]
                dO[k] += some[a:b].T @ own
        every = room("by state", len(states), n)
        if len(real) < len(states):
            every[...] = 0
        every[real] = grad
        present = np.unique(classes)
        dO, present = (dO, None) if len(present) == len(O) else (dO[present], present)
        return every, [("C", dC[1:], None), ("c", dC[0], None), ("O", dO[:, 1:], present), ("o", dO[:, 0], present)]


def lanes_of(documents: list[np.ndarray], start: int):
    """Windows over documents (arrays of units), each document in one lane, its state carried.

    Yields (inputs, fresh, units, mask, document, count): arrays (WINDOW, lanes); fresh
    marks steps that begin a document, whose input is start; document has each
    step's number; count is how many lanes go on, the first ones of those before.
    """
    sizes = np.array([len(d) for d in documents], np.int64)
    total = int(sizes.sum())
    if not total:
        return
    lanes = int(min(LANES, len(documents), max(1, total // LANE_TOKENS)))
    # longest first, each to the lane that is shortest so far, as good as: lanes are filled there and back
    order = np.argsort(-sizes, kind="stable")
    held: list[list[int]] = [[] for _ in range(lanes)]
    length = np.zeros(lanes, np.int64)
    for k in range(0, len(order), lanes):
        some = order[k : k + lanes]
        for lane, d in zip(np.argsort(length, kind="stable").tolist(), some.tolist()):
            held[lane].append(d)
            length[lane] += sizes[d]
    by = np.argsort(-length, kind="stable")
    sequence = [d for lane in by.tolist() for d in held[lane]]
    length = length[by]
    units = np.concatenate([documents[d] for d in sequence]).astype(np.int64)
    number = np.repeat(np.array(sequence, np.int32), sizes[sequence])
    first = np.zeros(total, bool)
    first[np.append(0, np.cumsum(sizes[sequence])[:-1])[sizes[sequence] > 0]] = True
    inputs = np.empty(total, np.int64)
    inputs[1:] = units[:-1]
    inputs[first] = start
    begin = np.cumsum(length) - length
    step = np.arange(WINDOW)[:, None]
    for w in range(0, int(length[0]), WINDOW):
        count = int(np.searchsorted(-length, -w, "left"))  # lanes longer than w
        place, mask = begin[:count] + (w + step), np.ones((WINDOW, count), bool)
        begins = first.take(place, mode="clip")
        if length[count - 1] < w + WINDOW:
            mask = w + step < length[:count]
            place, begins = np.where(mask, place, begin[:count]), begins & mask
        yield inputs.take(place), begins, units.take(place), mask, number.take(place), count
