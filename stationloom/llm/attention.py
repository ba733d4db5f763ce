"""A one-layer causal self-attention model in numpy: training by Adam, scoring by overlapping windows.

Its output is a distribution over classes: the commonest ids have a class each, all others share classes of ids that
follow similar ids, and are told apart inside by their smoothed counts. So the cost of a prediction does not depend on
the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, OVERLAP = 32, 8          # positions of a window, and how many of them only serve as context
STRIDE = WINDOW - OVERLAP
WIDTH, HIDDEN, CLASSES = 16, 32, 128
GROUPS, OTHERS = 24, 8           # classes that several ids share, and embeddings of each
AT_ONCE = 128                    # windows per batch: what fits into a core's cache
MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
FIRST, PAST = 65534, 65535       # in coded windows: the start id before a first window, places past the end of a text
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
ONES = np.ones(CLASSES, np.float32)


@dataclass
class Vocabulary:
    """How ids enter and leave the model. ``own`` lists the ids with a class of their own, the commonest first."""

    own: np.ndarray
    inputs: np.ndarray            # id -> row of the embedding
    classes: np.ndarray           # id -> class
    inside: np.ndarray            # id -> natural log of its share of the class

    @classmethod
    def learn(cls, counts: np.ndarray, texts: list[np.ndarray]) -> Vocabulary:
        """``counts`` of all ids decide which have their own class; the texts tell how to group the others."""
        classes, near = own_classes(counts), neighbours(len(counts))
        stream = Stream.of(texts, 0)
        add_neighbours(near, stream.ids, stream.lengths, classes)
        return cls.of(counts, near)

    @classmethod
    def of(cls, counts: np.ndarray, near: np.ndarray) -> Vocabulary:
        """From the counts of all ids and of what stands before them, see ``add_neighbours``."""
        classes, size = own_classes(counts), len(counts)
        rest = np.nonzero(classes == CLASSES - 1)[0]
        own = np.argsort(-counts, kind="stable")[:CLASSES - GROUPS]
        classes[rest] = CLASSES - GROUPS + _groups(near[rest])
        inputs = np.where(classes < CLASSES - GROUPS, classes, classes + GROUPS * (np.arange(size) % OTHERS))
        share = counts + 0.5
        total = np.bincount(classes, share, CLASSES)
        inside = np.log(share / total[classes])
        inside[own] = 0.0
        return cls(own, inputs.astype(np.int32), classes, inside)


def own_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each id that has one of its own; all others are in the last class."""
    own = np.argsort(-counts, kind="stable")[:CLASSES - GROUPS]
    classes = np.full(len(counts), CLASSES - 1, np.int32)
    classes[own] = np.arange(len(own))
    return classes


def neighbours(size: int) -> np.ndarray:
    """Zeros for ``add_neighbours``: a row for each id, a column for each class of one id."""
    return np.zeros((size, CLASSES - GROUPS), np.int32)


def add_neighbours(near: np.ndarray, ids: np.ndarray, lengths: np.ndarray, classes: np.ndarray) -> None:
    """Count, for every id without a class of its own, the ids with one up to four places before it in its text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    own, before, flat = CLASSES - GROUPS, classes[ids], near.reshape(-1)
    for back in range(1, 5):
        use = np.nonzero((before[back:] >= own) & (before[:-back] < own) & (text[back:] == text[:-back]))[0]
        np.add.at(flat, ids[use + back].astype(np.int64) * own + before[use], 1)


def _groups(near: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Group of each row by k-means of its counts; the last group is for ids that the texts show less than three times."""
    group = np.full(len(near), GROUPS - 1, np.int32)
    seen = np.nonzero(near.sum(axis=1) >= 12)[0]
    if len(seen) < GROUPS:
        return group
    points = np.sqrt(near[seen] / near[seen].sum(axis=1, keepdims=True)).astype(np.float32)
    centres = points[np.random.default_rng(1).choice(len(seen), GROUPS - 1, replace=False)]
    for _ in range(rounds):
        best = (points @ centres.T).argmax(axis=1)
        for k in range(GROUPS - 1):
            if (best == k).any():
                centres[k] = points[best == k].mean(axis=0)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    group[seen] = best
    return group


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, first`` of every window: the text, its first position, and the first position it scores.

    The first window of a text scores all it covers, the next ones all but their overlap: each position once.
    """
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    count[lengths == 0] = 0
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, number * STRIDE, np.where(number > 0, OVERLAP, 0)


class Room:
    """Arrays that one batch leaves to the next: getting fresh pages costs more time than the arithmetic on them."""

    def __init__(self, kind: type = np.float32) -> None:
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)


class Model:
    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"embed": weights(CLASSES + GROUPS * OTHERS, WIDTH), "place": 0.1 * weights(WINDOW, WIDTH),
                  "q": weights(WIDTH, WIDTH), "k": weights(WIDTH, WIDTH), "v": weights(WIDTH, WIDTH),
                  "o": 0.5 * weights(WIDTH, WIDTH), "up": weights(WIDTH, HIDDEN), "up0": np.zeros(HIDDEN, np.float32),
                  "down": 0.5 * weights(HIDDEN, WIDTH), "out": weights(WIDTH, CLASSES),
                  "out0": np.zeros(CLASSES, np.float32)}

    def _attend(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(ids)
        x = p["embed"][ids] + p["place"]
        flat = x.reshape(-1, WIDTH)
        q, k, v = ((flat @ p[w]).reshape(n, WINDOW, WIDTH) for w in "qkv")
        score = np.matmul(q, k.transpose(0, 2, 1))
        score *= np.float32(WIDTH ** -0.5)
        score += MASK
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=2, keepdims=True)
        mixed = np.matmul(score, v)
        return {"x": x, "q": q, "k": k, "v": v, "a": score, "m": mixed}

    def _head(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        up = h @ p["up"]
        up += p["up0"]
        np.maximum(up, 0, out=up)
        top = up @ p["down"]
        top += h
        logit = top @ p["out"]
        logit += p["out0"]
        return up, top, logit

    def log_probs(self, ids: np.ndarray, scored: np.ndarray, target: np.ndarray, room: Room | None = None,
                  weights: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Natural log-probability of ``target`` at the scored positions of a batch of windows.

        The sums of both softmaxes come from matrix products, without a search for the largest exponent; a batch where
        one is too large for that is done with the search. ``room`` keeps the arrays for the next batch, ``weights``
        come from ``_widened``.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            found = self._log_probs(ids, scored, target, room or Room(), weights or self._widened())
        return found if np.isfinite(found).all() else self.careful_log_probs(ids, scored, target)

    def careful_log_probs(self, ids: np.ndarray, scored: np.ndarray, target: np.ndarray) -> np.ndarray:
        t = self._attend(ids)
        logit = self._head(t["x"][scored] + t["m"][scored] @ self.p["o"])[2]
        logit -= logit.max(axis=1, keepdims=True)
        return logit[np.arange(len(target)), target] - np.log(np.exp(logit).sum(axis=1))

    def _log_probs(self, ids: np.ndarray, scored: np.ndarray, target: np.ndarray, room: Room,
                   p: dict[str, np.ndarray]) -> np.ndarray:
        logit = self._forward(ids, scored, room, p)["logit"]
        picked = logit[np.arange(len(target)), target]
        np.exp(logit, out=logit)
        return picked - np.log(logit @ ONES)

    def _forward(self, ids: np.ndarray, scored: np.ndarray, room: Room, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The logits at the scored positions and what led to them; ``weight`` is not divided by its sums ``z``."""
        n, wide = len(ids), WIDTH + 1
        x = np.take(p["embed"], ids, axis=0, out=room("x", n, WINDOW, wide), mode="clip")
        x += p["place"]
        flat = x.reshape(-1, wide)
        q = np.matmul(flat, p["q"], out=room("q", n * WINDOW, WIDTH)).reshape(n, WINDOW, WIDTH)
        k = np.matmul(flat, p["k"], out=room("k", n * WINDOW, WIDTH)).reshape(n, WINDOW, WIDTH)
        v = np.matmul(flat, p["v"], out=room("v", n * WINDOW, wide)).reshape(n, WINDOW, wide)
        weight = np.matmul(q, k.transpose(0, 2, 1), out=room("weight", n, WINDOW, WINDOW))
        np.exp(weight, out=weight)
        weight *= SEEN
        mixed = np.matmul(weight, v, out=room("mixed", n, WINDOW, wide)).reshape(-1, wide)
        at = np.flatnonzero(scored)
        h = np.take(flat, at, axis=0, out=room("h", len(at), wide), mode="clip")
        mixed = np.take(mixed, at, axis=0, out=room("m", len(at), wide), mode="clip")
        z = mixed[:, WIDTH:].copy()
        mixed /= z
        h += np.matmul(mixed, p["o"], out=room("o", len(at), wide))
        up = np.matmul(h, p["up"], out=room("up", len(at), HIDDEN))
        np.maximum(up, 0, out=up)
        top = np.matmul(up, p["down"], out=room("o", len(at), wide))
        top += h                        # h stays for the gradients
        logit = np.matmul(top, p["out"], out=room("logit", len(at), CLASSES))
        return {"flat": flat, "q": q, "k": k, "v": v, "weight": weight, "at": at, "z": z, "mixed": mixed, "h": h, "up": up,
                "top": top, "logit": logit}

    def _widened(self) -> dict[str, np.ndarray]:
        """The weights for inputs with a one as last entry: it carries the biases and adds up the attention."""
        p, wide = self.p, WIDTH + 1

        def framed(rows: int, columns: int, *parts: tuple[int, int, np.ndarray | float]) -> np.ndarray:
            out = np.zeros((rows, columns), p["embed"].dtype)
            for row, column, part in parts:
                size = np.shape(part) or (rows, 1)
                out[row:row + size[0], column:column + size[1]] = part
            return out

        return {"embed": framed(len(p["embed"]), wide, (0, 0, p["embed"]), (0, WIDTH, 1.0)),
                "place": framed(WINDOW, wide, (0, 0, p["place"])),
                "q": framed(wide, WIDTH, (0, 0, p["q"] * np.float32(WIDTH ** -0.5))), "k": framed(wide, WIDTH, (0, 0, p["k"])),
                "v": framed(wide, wide, (0, 0, p["v"]), (WIDTH, WIDTH, np.ones((1, 1), np.float32))),
                "o": framed(wide, wide, (0, 0, p["o"])), "up": framed(wide, HIDDEN, (0, 0, p["up"]), (WIDTH, 0, p["up0"][None])),
                "down": framed(HIDDEN, wide, (0, 0, p["down"])),
                "out": framed(wide, CLASSES, (0, 0, p["out"]), (WIDTH, 0, p["out0"][None]))}

    def gradients(self, ids: np.ndarray, scored: np.ndarray, target: np.ndarray, room: Room | None = None) -> tuple[
            float, dict[str, np.ndarray]]:
        """Mean loss of a batch and the gradients of all weights; like ``log_probs`` without a search for the largest
        exponent, which a batch gets only where one is too large."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            loss, g = self._gradients(ids, scored, target, room or Room(self.p["embed"].dtype))
        return (loss, g) if np.isfinite(loss) else self.careful_gradients(ids, scored, target)

    def _gradients(self, ids: np.ndarray, scored: np.ndarray, target: np.ndarray, room: Room) -> tuple[
            float, dict[str, np.ndarray]]:
        p, n, wide, size = self.p, len(ids), WIDTH + 1, len(target)
        t = self._forward(ids, scored, room, self._widened())
        flat, weight, at, up, mixed = t["flat"], t["weight"], t["at"], t["up"], t["mixed"]
        rows, d = np.arange(size), t["logit"]
        loss = -d[rows, target]
        np.exp(d, out=d)
        total = d @ ONES
        loss = float((loss + np.log(total)).mean())
        d *= (1.0 / (total * size)).astype(d.dtype)[:, None]
        d[rows, target] -= 1.0 / size
        out = np.matmul(d.T, t["top"]).T
        g = {"out": out[:WIDTH], "out0": out[WIDTH]}
        d_top = np.matmul(d, p["out"].T, out=room("d_top", size, WIDTH))
        g["down"] = up.T @ d_top
        d_up = np.matmul(d_top, p["down"].T, out=room("d_up", size, HIDDEN))
        d_up *= up > 0
        both = t["h"].T @ d_up
        g["up"], g["up0"] = both[:WIDTH], both[WIDTH]
        d_top += np.matmul(d_up, p["up"].T, out=room("d_h", size, WIDTH))
        g["o"] = (mixed.T @ d_top)[:WIDTH]
        # next to the gradient of what is mixed, over its sum, stands what the softmax takes off; the ones of v add it
        d_mixed = np.matmul(d_top, p["o"].T, out=room("d_h", size, WIDTH))
        some = room("some", size, wide)
        some[:, :WIDTH] = d_mixed
        np.einsum("ij,ij->i", d_mixed, mixed[:, :WIDTH], out=some[:, WIDTH])
        some[:, WIDTH] *= -1
        some /= t["z"]
        whole = room("whole", n * WINDOW, wide)
        whole[:] = 0
        whole[at] = some
        whole = whole.reshape(n, WINDOW, wide)
        d_s = np.matmul(whole, t["v"].transpose(0, 2, 1), out=room("d_s", n, WINDOW, WINDOW))
        d_s *= weight
        d_qkv = room("d_qkv", n, WINDOW, 3 * WIDTH)
        np.matmul(d_s, t["k"], out=d_qkv[:, :, :WIDTH])
        np.matmul(d_s.transpose(0, 2, 1), t["q"], out=d_qkv[:, :, WIDTH:2 * WIDTH])
        np.matmul(weight.transpose(0, 2, 1), whole[:, :, :WIDTH], out=d_qkv[:, :, 2 * WIDTH:])
        d_qkv = d_qkv.reshape(-1, 3 * WIDTH)
        scale = np.float32(WIDTH ** -0.5)
        each = flat.T @ d_qkv
        g["q"], g["k"], g["v"] = each[:WIDTH, :WIDTH] * scale, each[:WIDTH, WIDTH:2 * WIDTH], each[:WIDTH, 2 * WIDTH:]
        d_x = np.matmul(d_qkv, np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1).T, out=room("d_x", n * WINDOW, WIDTH))
        d_x[at] += d_top
        g["place"] = d_x.reshape(n, WINDOW, WIDTH).sum(axis=0)
        entry = ids.reshape(-1, 1).astype(np.int64) * WIDTH + np.arange(WIDTH)
        g["embed"] = np.bincount(entry.reshape(-1), d_x.reshape(-1), p["embed"].size).reshape(p["embed"].shape)
        return loss, {name: g[name].astype(value.dtype, copy=False) for name, value in p.items()}

    def careful_gradients(self, ids: np.ndarray, scored: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, t = self.p, self._attend(ids)
        mixed = t["m"].reshape(-1, WIDTH)
        full = t["x"] + (mixed @ p["o"]).reshape(t["x"].shape)
        h = full[scored]
        up, top, logit = self._head(h)
        logit -= logit.max(axis=1, keepdims=True)
        soft = np.exp(logit)
        soft /= soft.sum(axis=1, keepdims=True)
        rows = np.arange(len(target))
        loss = -float(np.log(soft[rows, target] + 1e-12).mean())
        d = soft
        d[rows, target] -= 1
        d /= len(target)
        g = {"out": top.T @ d, "out0": d.sum(axis=0)}
        d_top = d @ p["out"].T
        g["down"] = up.T @ d_top
        d_up = (d_top @ p["down"].T) * (up > 0)
        g["up"], g["up0"] = h.T @ d_up, d_up.sum(axis=0)
        d_full = np.zeros_like(full)
        d_full[scored] = d_top + d_up @ p["up"].T
        flat = d_full.reshape(-1, WIDTH)
        g["o"] = mixed.T @ flat
        d_mixed = (flat @ p["o"].T).reshape(t["m"].shape)
        d_a = np.matmul(d_mixed, t["v"].transpose(0, 2, 1))
        d_v = np.matmul(t["a"].transpose(0, 2, 1), d_mixed)
        d_s = t["a"] * (d_a - (d_a * t["a"]).sum(axis=2, keepdims=True)) * np.float32(WIDTH ** -0.5)
        d_q, d_k = np.matmul(d_s, t["k"]), np.matmul(d_s.transpose(0, 2, 1), t["q"])
        x = t["x"].reshape(-1, WIDTH)
        d_x = d_full.copy()
        for name, part in (("q", d_q), ("k", d_k), ("v", d_v)):
            part = part.reshape(-1, WIDTH)
            g[name] = x.T @ part
            d_x += (part @ p[name].T).reshape(d_x.shape)
        g["place"] = d_x.sum(axis=0)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], ids.reshape(-1), d_x.reshape(-1, WIDTH))
        return loss, g

    def fit(self, texts: list[np.ndarray], vocabulary: Vocabulary, start: int, steps: int = 600, batch: int = 64,
            rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over random windows; texts are id arrays that end with the end id. Returns the losses."""
        stream = Stream.of(texts, start)
        text, first, skip = windows(stream.lengths)
        if not len(text):
            return []
        self.close_empty(vocabulary)
        rng, losses = np.random.default_rng(seed), []
        weights, moments, room = *self.take(self.state()), Room()
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(text), batch)
            ids, scored, target = stream.batch(text[pick], first[pick], skip[pick], vocabulary)
            loss, grads = self.gradients(ids, scored, vocabulary.classes[target], room)
            losses.append(loss)
            self._adam(grads, weights, moments, step, steps, rate)
        return losses

    def close_empty(self, vocabulary: Vocabulary) -> None:
        """Classes without an id get no mass."""
        empty = np.bincount(vocabulary.classes, minlength=CLASSES) == 0
        self.p["out"][:, empty], self.p["out0"][empty] = 0, -1e4

    def unlearned(self, vocabulary: Vocabulary, counts: np.ndarray) -> None:
        """Where no text is there to learn from: the smoothed share of each class, whatever stands before."""
        total = np.bincount(vocabulary.classes, counts + 0.5, CLASSES)
        self.p["out"][:] = 0
        self.p["out0"][:] = np.log(np.maximum(total, 1e-30) / total.sum())

    def _adam(self, grads: dict[str, np.ndarray], weights: np.ndarray, moments: np.ndarray, step: int, steps: int,
              rate: float) -> None:
        """One step of all weights, which ``take`` has laid out as one vector."""
        speed = rate * min(1.0, step / 20, 2.0 * (1 - (step - 1) / steps) + 0.02)
        g, (m, v) = np.concatenate([grads[name].reshape(-1) for name in self.p]), moments
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        weights -= speed * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)

    def state(self) -> np.ndarray:
        """Weights and zero moments as one vector, for ``advance``."""
        weights = np.concatenate([v.reshape(-1) for v in self.p.values()])
        return np.concatenate([weights, np.zeros(2 * len(weights), np.float32)]).astype(np.float32)

    def take(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set the weights from a state vector, as views of one vector; returns this and the two moments."""
        parts, at = state.reshape(3, -1).copy(), 0
        for name, value in self.p.items():
            self.p[name], at = parts[0, at:at + value.size].reshape(value.shape), at + value.size
        return parts[0], parts[1:]

    def advance(self, state: np.ndarray, rows: np.ndarray, vocabulary: Vocabulary, start: int, done: int, stop: int,
                steps: int, batch: int = 64, rate: float = 0.02) -> np.ndarray:
        """The state after steps ``done`` to ``stop`` of ``steps`` over the windows of ``rows``, taken in turn from the first."""
        return self.advance_coded(state, coded(rows, start, vocabulary), int(vocabulary.inputs[start]), done, stop, steps, batch,
                                  rate)

    def advance_coded(self, state: np.ndarray, codes: np.ndarray, start: int, done: int, stop: int, steps: int, batch: int = 64,
                      rate: float = 0.02) -> np.ndarray:
        """``advance`` over windows from ``coded``; ``start`` is the embedding row of the start id."""
        weights, moments, room = *self.take(state), Room()
        for step in range(done + 1, stop + 1):
            turn = codes[np.arange((step - 1 - done) * batch, (step - done) * batch) % len(codes)]
            self._adam(self.gradients(*inputs_of_codes(turn, start), room)[1], weights, moments, step, steps, rate)
        return np.concatenate([weights, moments.reshape(-1)]).astype(np.float32)

    def score(self, stream: Stream, vocabulary: Vocabulary) -> np.ndarray:
        """Natural log-probability of every id of the stream, each scored once."""
        out = np.zeros(len(stream.ids))
        text, first, skip = windows(stream.lengths)
        done, room, weights = 0, Room(), self._widened()
        for at in range(0, len(text), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            ids, scored, target = stream.batch(text[part], first[part], skip[part], vocabulary)
            # windows follow their texts, so the scored positions follow the stream
            out[done:done + len(target)] = self.log_probs(
                ids, scored, vocabulary.classes[target], room, weights) + vocabulary.inside[target]
            done += len(target)
        return out


@dataclass
class Stream:
    """Texts laid end to end. Position t of a text predicts its id t from the ids before, a start id in front."""

    ids: np.ndarray
    begin: np.ndarray
    lengths: np.ndarray
    start: int

    @classmethod
    def of(cls, texts: list[np.ndarray], start: int) -> Stream:
        lengths = np.array([len(t) for t in texts], np.int64)
        return cls(np.concatenate(texts) if texts else np.zeros(0, np.int64), np.cumsum(lengths) - lengths, lengths, start)

    def batch(self, text: np.ndarray, first: np.ndarray, skip: np.ndarray, vocabulary: Vocabulary):
        """Input rows of some windows, the mask of scored positions and their target ids."""
        place = first[:, None] + np.arange(WINDOW)
        real = place < self.lengths[text][:, None]
        at = self.begin[text][:, None] + np.minimum(place, self.lengths[text][:, None] - 1)
        seen = np.where(place > 0, self.ids[np.maximum(at - 1, 0)], self.start)
        scored = real & (np.arange(WINDOW) >= skip[:, None])
        return vocabulary.inputs[seen], scored, self.ids[at[scored]]

    def rows(self, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The id before each window, the start id at the beginning of a text, and its ids; -1 past the end."""
        place = first[:, None] + np.arange(-1, WINDOW)
        at = self.begin[text][:, None] + np.clip(place, 0, self.lengths[text][:, None] - 1)
        rows = np.where(place < self.lengths[text][:, None], self.ids[at], -1)
        rows[:, 0] = np.where(first > 0, rows[:, 0], self.start)
        return rows.astype("<i4")


def inputs_of(rows: np.ndarray, start: int, vocabulary: Vocabulary):
    """What ``Stream.batch`` gives, from ``Stream.rows``; the start id stands before a first window only."""
    seen, target = rows[:, :-1], rows[:, 1:]
    scored = (target >= 0) & (np.arange(WINDOW) >= np.where(rows[:, :1] == start, 0, OVERLAP))
    return vocabulary.inputs[np.where(seen < 0, start, seen)], scored, target[scored]


def coded(rows: np.ndarray, start: int, vocabulary: Vocabulary) -> np.ndarray:
    """``Stream.rows`` with the embedding row of each id in its place, which tells its class too: two bytes an id."""
    codes = vocabulary.inputs.astype("<u2")[rows]
    codes[rows < 0] = PAST
    codes[rows[:, 0] == start, 0] = FIRST
    return codes


def inputs_of_codes(codes: np.ndarray, start: int):
    """What ``inputs_of`` gives, with the classes of the targets instead of their ids."""
    own, seen, target = CLASSES - GROUPS, codes[:, :-1], codes[:, 1:]
    scored = (target != PAST) & (np.arange(WINDOW) >= np.where(codes[:, :1] == FIRST, 0, OVERLAP))
    found = target[scored].astype(np.int64)
    return np.where(seen >= FIRST, start, seen).astype(np.int64), scored, np.where(found < own, found, own + (found - own) % GROUPS)
