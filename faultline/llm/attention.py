"""A small causal self-attention model of token ids, in numpy: forward, backward, exact log-probabilities.

One attention layer over a window of ids, with the last id's embedding passed on beside it.  The next
id is predicted in two steps, its group and then its place in the group, so that every probability is
exact and costs about two square roots of the vocabulary.  The output's biases are the logarithms of
the corpus counts: before any training the model is the counts.  A step's arrays are those of the last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Ids a prediction sees, ids by which the next window moves on, width of the embeddings.
WINDOW, STRIDE, WIDTH = 32, 24, 16
#: Windows of a training step, of its first ones (they grow by half every GROW steps), and of a scoring batch.
STEP_WINDOWS, FIRST_WINDOWS, GROW, SCORE_WINDOWS = 192, 24, 12, 192
#: Logits and attention are held within these, so that no exponential leaves its type.
LEAST, MOST = np.float32(-60), np.float32(60)
#: Numbers of an array that a model keeps from step to step.
MOST_ROOM = 1 << 22
CAUSAL, SCALE = np.tri(WINDOW, dtype=np.float32), np.float32(WIDTH**-0.5)


@cache
def _ones(size: int) -> np.ndarray:
    return np.ones(size, np.float32)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis; as a product, which is faster for short rows."""
    return x @ _ones(x.shape[-1])


@dataclass
class Vocabulary:
    """Ids that training has seen, most frequent first, then one place for all others.

    ``cuts`` make groups that each hold about the same sum of square roots of counts.
    """

    place_of: np.ndarray  # by id; ids never seen have the last place
    counts: np.ndarray  # by place, at least 1
    cuts: np.ndarray  # group g has the places cuts[g] .. cuts[g + 1] - 1
    unseen: int

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray, size: int) -> Vocabulary:
        order = np.lexsort((ids, -counts))
        ids, counts = ids[order], np.append(counts[order], 1)
        place_of = np.full(size, len(ids), dtype=np.int32)
        place_of[ids] = np.arange(len(ids), dtype=np.int32)
        mass = np.cumsum(np.sqrt(counts))
        n_groups = max(1, int(np.sqrt(len(counts)) / 3))  # frequent ids have small groups
        cuts = np.searchsorted(mass, mass[-1] * np.arange(1, n_groups) / n_groups, side="left") + 1
        return cls(place_of, counts, np.unique(np.concatenate(([0], cuts, [len(counts)]))), size - len(ids))

    def __len__(self) -> int:
        return len(self.counts)

    @property
    def group_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))


class Attention:
    """Parameters as named views of one vector, so that models can be averaged and stepped as vectors."""

    def __init__(self, vocabulary: Vocabulary, theta: np.ndarray | None = None, seed: int = 42):
        self.vocabulary = vocabulary
        n, g = len(vocabulary), len(vocabulary.cuts) - 1
        shapes = {
            "embed": (n + 1, WIDTH),  # the last one begins every text
            "place": (WINDOW, WIDTH),
            **{name: (WIDTH, WIDTH) for name in ("query", "key", "value", "out")},
            "group": (WIDTH + 1, g),  # the last row is the bias
            "member": (n, WIDTH + 1),  # the last column is the bias
        }
        sizes = {name: int(np.prod(shape)) for name, shape in shapes.items()}
        fresh = theta is None
        self.theta = np.zeros(sum(sizes.values()), dtype=np.float32) if fresh else theta
        self.views, at = {}, 0
        for name, shape in shapes.items():
            self.views[name] = (at, at + sizes[name], shape)
            at += sizes[name]
        if fresh:
            rng = np.random.default_rng(seed)
            for name, scale in (("embed", 0.3), ("place", 0.1), ("query", 0.25), ("key", 0.25), ("value", 0.25), ("out", 0.25)):
                self[name][...] = rng.normal(0, scale, shapes[name])
            share = vocabulary.counts / vocabulary.counts.sum()
            by_group = np.add.reduceat(share, vocabulary.cuts[:-1])
            self["group"][-1] = np.log(by_group)
            self["member"][:, -1] = np.log(share / by_group[vocabulary.group_of])
        self.group_of, self._rooms = vocabulary.group_of, {}

    def __getitem__(self, name: str) -> np.ndarray:
        low, high, shape = self.views[name]
        return self.theta[low:high].reshape(shape)

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array for results, the same memory in every step: fresh pages cost more than the sums in them."""
        size = math.prod(shape)
        if size > MOST_ROOM:
            return np.empty(shape, np.float32)
        if name not in self._rooms or len(self._rooms[name]) < size:
            self._rooms[name] = np.empty(size, np.float32)
        return self._rooms[name][:size].reshape(shape)

    def _attend(self, ids: np.ndarray) -> tuple:
        """Hidden states with a one beside each, a row for a place, and what backward needs.

        Attention ``a`` is not divided by its ``sums``; what it has gathered is.
        """
        n = ids.size
        x = np.take(self["embed"], ids, axis=0, out=self._room("x", *ids.shape, WIDTH), mode="clip")
        x += self["place"]
        x = x.reshape(n, WIDTH)
        mix = np.concatenate((self["query"] * SCALE, self["key"], self["value"]), axis=1)
        qkv = np.matmul(x, mix, out=self._room("qkv", n, 3 * WIDTH)).reshape(*ids.shape, 3 * WIDTH)
        q, k, v = (qkv[..., at : at + WIDTH] for at in range(0, 3 * WIDTH, WIDTH))
        a = np.matmul(q, k.transpose(0, 2, 1), out=self._room("a", *ids.shape, WINDOW))
        np.clip(a, LEAST, MOST, out=a)
        np.exp(a, out=a)
        a *= CAUSAL
        sums = _sums(a).reshape(n, 1)
        o = np.matmul(a, v, out=self._room("o", *ids.shape, WIDTH)).reshape(n, WIDTH)
        o /= sums
        h = self._room("h", n, WIDTH + 1)
        h[:, -1] = 1
        np.add(x, np.matmul(o, self["out"], out=self._room("seen", n, WIDTH)), out=h[:, :-1])
        return h, (x, mix, q, k, v, a, o, sums)

    def _predict(self, h: np.ndarray, at: np.ndarray, targets: np.ndarray, grad: Attention | None = None):
        """Natural log-probability of each target, which follows the rows ``at`` of ``h``.

        With ``grad`` also the rows, put in the order of their targets, and so of the targets' groups,
        and the gradient towards them.
        """
        cuts, member, group = self.vocabulary.cuts, self["member"], self["group"]
        order = np.argsort(targets.astype(np.uint16 if len(self.vocabulary) < 1 << 16 else np.int64), kind="stable")
        at, targets, rows = at[order], targets[order], np.arange(len(at))
        h = np.take(h, at, axis=0, out=self._room("rows", len(at), h.shape[1]), mode="clip")
        groups, sizes = self.group_of[targets], np.diff(cuts)
        logits = np.matmul(h, group, out=self._room("logits", len(h), len(sizes)))
        # The members of each row's group, row after row, in one flat array.
        ends = np.searchsorted(targets, cuts)
        starts = np.concatenate(([0], np.cumsum(np.diff(ends) * sizes)))
        inner = self._room("inner", int(starts[-1]))
        met = []
        for g in np.flatnonzero(np.diff(ends)).tolist():
            own = inner[starts[g] : starts[g + 1]].reshape(-1, sizes[g])
            met.append((h[ends[g] : ends[g + 1]], member[cuts[g] : cuts[g + 1]], own, ends[g], g))
        for some, inside, own, _, _ in met:
            np.matmul(some, inside.T, out=own)
        in_group = rows * len(sizes) + groups
        in_member = starts[groups] + (rows - ends[groups]) * sizes[groups] + (targets - cuts[groups])
        log_p, within = np.zeros(len(h), np.float32), self._room("within", len(h))
        for values, place in ((logits.reshape(-1), in_group), (inner, in_member)):
            np.clip(values, LEAST, MOST, out=values)
            log_p += values[place]
            np.exp(values, out=values)
        for some, _, own, low, _ in met:
            np.matmul(own, _ones(own.shape[1]), out=within[low : low + len(some)])
        totals = _sums(logits)
        log_p -= np.log(totals)
        log_p -= np.log(within)
        back_to = np.empty_like(log_p)
        back_to[order] = log_p
        if grad is None:
            return back_to
        # Rows are divided by their sums, times their number, where they are narrow.
        one = np.float32(1 / max(1, len(h)))
        logits.reshape(-1)[in_group] -= totals
        inner[in_member] -= within
        scale = (one / totals)[:, None]
        scaled = np.multiply(h, scale, out=self._room("scaled", *h.shape))
        np.matmul(scaled.T, logits, out=grad["group"])
        back = np.matmul(logits, group[:-1].T, out=self._room("back", len(h), WIDTH))
        back *= scale
        scale = (one / within)[:, None]
        np.multiply(h, scale, out=scaled)
        deeper, to = self._room("deeper", len(h), WIDTH + 1), grad["member"]
        for some, inside, own, low, g in met:
            high = low + len(some)
            np.matmul(own.T, scaled[low:high], out=to[cuts[g] : cuts[g + 1]])
            np.matmul(own, inside, out=deeper[low:high])
        deeper *= scale
        back += deeper[:, :-1]
        return back_to, at, back

    def log_probabilities(self, ids: np.ndarray, wanted: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Of ``targets``, at the places of the flattened windows that ``wanted`` marks."""
        h = self._attend(ids)[0]
        log_p = self._predict(h, np.flatnonzero(wanted), targets).astype(np.float64)
        other = len(self.vocabulary) - 1
        return np.where(targets == other, log_p - np.log(max(1, self.vocabulary.unseen)), log_p)

    def gradient(self, ids: np.ndarray, wanted: np.ndarray, targets: np.ndarray, grad: Attention) -> float:
        """Mean loss; the gradient is put into ``grad``."""
        grad.theta[:] = 0
        h, (x, mix, q, k, v, a, o, sums) = self._attend(ids)
        log_p, at, some = self._predict(h, np.flatnonzero(wanted), targets, grad)
        back = self._room("towards", len(x), WIDTH)
        back[...] = 0
        back[at] = some
        np.matmul(o.T, back, out=grad["out"])
        do = np.matmul(back, self["out"].T, out=self._room("do", len(x), WIDTH))
        do /= sums
        less = np.einsum("ij,ij->i", do, o)
        do = do.reshape(*ids.shape, WIDTH)
        da = np.matmul(do, v.transpose(0, 2, 1), out=self._room("da", *a.shape))
        da -= less.reshape(*ids.shape, 1)
        da *= a
        d = self._room("d", *ids.shape, 3 * WIDTH)
        for at, (left, right) in enumerate(((da, k), (da.transpose(0, 2, 1), q), (a.transpose(0, 2, 1), do))):
            np.matmul(left, right, out=d[..., at * WIDTH : (at + 1) * WIDTH])
        d = d.reshape(-1, 3 * WIDTH)
        back += np.matmul(d, mix.T, out=self._room("seen", len(x), WIDTH))
        dq, dk, dv = np.split(x.T @ d, 3, axis=1)
        grad["query"][...], grad["key"][...], grad["value"][...] = dq * SCALE, dk, dv
        grad["place"][...] = back.reshape(-1, WINDOW, WIDTH).sum(axis=0)
        named = ids.ravel().astype(np.uint16 if len(self.vocabulary) < (1 << 16) - 1 else np.int64)
        order = np.argsort(named, kind="stable")
        named = named[order].astype(np.int64)
        first = np.flatnonzero(np.diff(named, prepend=-1))
        ordered = np.take(back, order, axis=0, out=self._room("seen", len(x), WIDTH), mode="clip")
        grad["embed"][named[first]] = np.add.reduceat(ordered, first, axis=0)
        return float(-log_p.mean())


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate
        self.room = np.empty((2, size), np.float32)

    def step(self, theta: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        one, two = self.room
        self.m += np.multiply(np.subtract(grad, self.m, out=one), np.float32(0.1), out=one)
        np.multiply(grad, grad, out=one)
        self.v += np.multiply(np.subtract(one, self.v, out=one), np.float32(0.01), out=one)
        scale = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        np.sqrt(self.v, out=one)
        one += np.float32(1e-8)
        theta -= np.divide(np.multiply(self.m, np.float32(scale), out=two), one, out=two)


def learn(model: Attention, grad: Attention, adam: Adam, inputs: np.ndarray, wanted: np.ndarray, targets: np.ndarray) -> None:
    """Steps through the windows once, in few at first, so that a small text teaches something too."""
    before = np.concatenate(([0], np.cumsum(wanted.sum(axis=1))))
    low = 0
    while low < len(inputs):
        size = min(STEP_WINDOWS, int(FIRST_WINDOWS * 1.5 ** min(20, adam.t // GROW)))
        high = min(low + size, len(inputs))
        model.gradient(inputs[low:high], wanted[low:high], targets[before[low] : before[high]], grad)
        adam.step(model.theta, grad.theta)
        low = high


def windows(
    places: np.ndarray, ends: np.ndarray, begin: int, stride: int, size: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows over several texts' places, ``size`` at a time, each place predicted once.

    ``ends``: where each text, none of them empty, ends in ``places``.  Yields inputs (windows,
    WINDOW), marks of the places that predict, the targets in the order of the marks, and the text of
    each target.  A text's first window predicts all its places, the next ones their last ``stride``.
    """
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    sizes = ends - starts
    more = np.maximum(0, -(-(sizes - WINDOW) // stride))
    text = np.repeat(np.arange(len(ends)), 1 + more)
    nth = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(1 + more)[:-1])), 1 + more)
    late = np.arange(WINDOW) >= WINDOW - stride
    for low in range(0, len(text), size):
        of, n = text[low : low + size], nth[low : low + size, None]
        length = sizes[of][:, None]
        at = n * stride + np.arange(WINDOW)  # the input stands before the target of the same place
        wanted = (at < length) & (late | (n == 0))
        flat = starts[of][:, None] + np.minimum(at, length - 1)
        inputs = np.where(at == 0, begin, places[np.maximum(flat - 1, 0)])
        yield inputs, wanted, places[flat[wanted]], np.broadcast_to(of[:, None], at.shape)[wanted]
