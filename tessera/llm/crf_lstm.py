"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, scores, decoding.

Gates are hard sigmoids and states softsigns, clip(x / 4 + 1/2, 0, 1) and x / (1 + |x|): a few
passes of simple arithmetic, which is what makes scoring whole corpora affordable. Training works on
(time, batch, features); scoring on (features, lanes), so that every pass is over contiguous memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters of a block that decoding settles for each tag it may begin with.
BLOCK = 64
TINY = np.float32(1e-12)
#: Steps after which lanes that have ended are dropped from scoring.
STEPS = 32


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * 0.25 + 0.5, 0, 1)


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """x: time, batch, inputs. Hidden states, and what the gradient needs."""
    steps, batch, _ = x.shape
    hidden = u.shape[0]
    h, c = np.zeros((batch, hidden), x.dtype), np.zeros((batch, hidden), x.dtype)
    drive = x @ w + b
    out, trail = np.empty((steps, batch, hidden), x.dtype), []
    for t in range(steps):
        z = drive[t] + h @ u
        s = _gate(z[:, : 3 * hidden])
        i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
        g = _softsign(z[:, 3 * hidden :])
        before, h_before = c, h
        c = f * c + i * g
        tc = _softsign(c)
        h = o * tc
        out[t] = h
        trail.append((s, g, before, tc, h_before))
    return out, trail


def lstm_gradient(x: np.ndarray, w: np.ndarray, u: np.ndarray, trail: list, dout: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients for w, u, b and x."""
    hidden = u.shape[0]
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dz_all = np.empty((*x.shape[:2], w.shape[1]), x.dtype)
    du = np.zeros_like(u)
    for t in range(len(x) - 1, -1, -1):
        s, g, before, tc, h_before = trail[t]
        i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
        d = dout[t] + dh
        dc = dc + d * o * (1 - np.abs(tc)) ** 2
        gates = np.concatenate([dc * g, dc * before, d * tc], 1) * (0.25 * ((s > 0) & (s < 1)))
        dz = np.concatenate([gates, dc * i * (1 - np.abs(g)) ** 2], 1, dtype=x.dtype)
        dz_all[t] = dz
        du += h_before.T @ dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, w.shape[1])
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0), dz_all @ w.T


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tag sequences (time, batch), and its gradients."""
    steps, batch, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[0] = scores[0]
    for t in range(1, steps):
        forward[t] = scores[t] + _logsumexp(forward[t - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        backward[t] = _logsumexp(moves + (scores[t + 1] + backward[t + 1])[:, None, :], 2)
    z = _logsumexp(forward[-1], 1)
    ds = np.exp(forward + backward - z[:, None])
    after = scores[1:] + backward[1:] - z[:, None]
    dm = np.exp(forward[:-1, :, :, None] + moves + after[:, :, None, :]).sum((0, 1))
    rows = np.arange(batch)
    right = scores[np.arange(steps)[:, None], rows, tags].sum(0) + moves[tags[:-1], tags[1:]].sum(0)
    ds[np.arange(steps)[:, None], rows, tags] -= 1
    np.subtract.at(dm, (tags[:-1], tags[1:]), 1)
    return float((z - right).mean()), ds / batch, dm / batch


def uncertain(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ranges outside of which every best path has tag 0, so that each range is
    decoded on its own.

    A run of other tags gains over tag 0, transitions included, at most the sum of g over its
    places (each with the best transition to its tag) plus a constant. Where no run through a place can gain, the place has tag 0. The best
    run through each place comes from running sums. bounds: where texts begin, and the end.
    """
    into, leave = moves[1:, 1:].max(0), moves[1:, 0].max()
    top = scores[:, 1] + into[0]
    for k in range(2, scores.shape[1]):
        np.maximum(top, scores[:, k] + into[k - 1], out=top)
    top -= scores[:, 0] + moves[0, 0]
    enter, leave = (moves[0, 1:] - into).max(), leave - moves[0, 0]
    constant = float(enter + leave)
    # A run that begins or ends with its text has no transition there.
    some = bounds[:-1] < bounds[1:]
    top[bounds[:-1][some]] += max((moves[0, 0] - into).max() - enter, 0)
    top[bounds[1:][some] - 1] += max(-leave, 0)
    g = np.insert(top.astype(np.float64), bounds[:-1], -1e6)  # no run goes from text to text
    total = np.cumsum(g)
    through = np.maximum.accumulate(total[::-1])[::-1].copy()  # the best end of a run
    before = total - g
    through -= np.minimum.accumulate(before)  # its best beginning
    inside = through + constant >= -1e-3
    texts = np.arange(len(bounds) - 1)
    open_ = np.delete(inside, bounds[:-1] + texts)
    edges = np.zeros(len(open_) + 1, bool)
    edges[:-1] = open_
    edges[1:] ^= open_
    edges[bounds] |= np.append(open_, False)[bounds] | np.insert(open_, 0, False)[bounds]
    cuts = np.flatnonzero(edges)
    keep = np.flatnonzero(open_[cuts[:-1]])
    return cuts[keep], cuts[keep + 1]


def viterbi(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best tags of the texts whose scores (place, tag) lie one after another, each as a whole.

    Uncertain ranges are cut into blocks and all are passed at once. The best path through a block
    is worked out for every tag it may begin with (for a range's only block, from what comes
    before); then blocks are joined, so that the result is that of one pass over the text.
    """
    tags, size = np.zeros(len(scores), np.int64), len(moves)
    a, b = uncertain(scores, moves, bounds)
    if not len(a):
        return tags
    # What comes before a range's first place and after its last one, by tag.
    come = np.where(np.isin(a, bounds[:-1]), 0.0, moves[0][:, None])
    leave = np.where(np.isin(b, bounds[1:]), 0.0, moves[:, 0][:, None])
    whole, long = np.flatnonzero(b - a <= BLOCK), np.flatnonzero(b - a > BLOCK)
    unit = np.where(np.eye(size, dtype=bool), 0.0, -np.inf)
    parts = [(s, min(s + BLOCK, b[r])) for r in long for s in range(a[r], b[r], BLOCK)]  # each with size lanes
    start = np.concatenate([a[whole], np.repeat([s for s, _ in parts], size)]).astype(np.int64)
    length = np.concatenate([b[whole] - a[whole], np.repeat([e - s for s, e in parts], size)]).astype(np.int64)
    before = np.concatenate([come[:, whole], np.tile(unit, len(parts))], 1)
    order = np.argsort(-length, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    start, length = start[order], length[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps)).tolist()  # lanes longer than t
    passed = [scores[start].T + before[:, order]]  # by step: the best score by tag and lane
    for t in range(1, steps):
        n = active[t]
        best = np.stack([(passed[-1][:, :n] + moves[:, k, None]).max(0) for k in range(size)])
        passed.append(best + scores[start[:n] + t].T)
    final = np.empty((size, len(order)))
    for t in range(steps):
        n, after = active[t], active[t + 1] if t + 1 < steps else 0
        final[:, after:n] = passed[t][:, after:n]
    last = np.full(len(order), -1)  # the tag at the end of each lane that is on a best path
    last[at[: len(whole)]] = (final[:, at[: len(whole)]] + leave[:, whole]).argmax(0)
    lane = len(whole)
    for r in long:
        now, arrivals = come[:, r], []
        for k in range(lane, lane + -(-(b[r] - a[r]) // BLOCK) * size, size):
            paths = now[:, None] + final[:, at[k : k + size]].T  # first tag, last tag
            arrivals.append((k, paths))
            now = (paths.max(0)[:, None] + moves).max(0)
        lane += len(arrivals) * size
        tag = int((arrivals[-1][1].max(0) + leave[:, r]).argmax())
        for j in range(len(arrivals) - 1, -1, -1):
            k, paths = arrivals[j]
            first = int(paths[:, tag].argmax())
            last[at[k + first]] = tag
            if j:
                tag = int((arrivals[j - 1][1].max(0) + moves[:, first]).argmax())
    used = np.flatnonzero(last >= 0)
    now = last[used]
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            m = int(np.searchsorted(used, active[t + 1]))
            now[:m] = (passed[t][:, used[:m]] + moves[:, now[:m]]).argmax(0)
        n = int(np.searchsorted(used, active[t]))
        tags[start[used[:n]] + t] = now[:n]
    return tags


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, symbols: int, tags: int, embedding: int = 6, hidden: int = 8, seed: int = 3) -> Tagger:
        draw = np.random.default_rng(seed)

        def matrix(*shape: int) -> np.ndarray:
            return (draw.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"e": draw.normal(size=(symbols, embedding)).astype(np.float32), "o": matrix(2 * hidden, tags), "ob": np.zeros(tags, np.float32), "m": np.zeros((tags, tags), np.float32)}
        for d in "lr":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            w |= {f"w{d}": matrix(embedding, 4 * hidden), f"u{d}": matrix(hidden, 4 * hidden), f"b{d}": bias}
        return cls(w)

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Emission scores (way, lanes, time, tags) of symbols (way, lanes, time), without the
        tags' bias. Way 0 reads each lane forwards, way 1 has it reversed; their scores add up.
        Lanes are sorted, the longest first; what is beyond a lane's length means nothing."""
        w = self.weights
        hidden, width = w["ul"].shape[0], w["e"].shape[1]
        # One product a step: states, embedding, 1. The gates' slope is within the weights.
        weights = np.stack([np.concatenate([w[f"u{d}"], w[f"w{d}"], w[f"b{d}"][None]]).T for d in "lr"])
        weights[:, : 3 * hidden] *= 0.25
        weights[:, : 3 * hidden, -1] += 0.5
        weights, symbols = np.ascontiguousarray(weights, np.float32), np.ascontiguousarray(w["e"].T)
        to_tags, zero, one = w["o"].reshape(2, hidden, -1), np.float32(0), np.float32(1)
        size, lanes, times = len(w["ob"]), x.shape[1], x.shape[2]
        out = np.empty((*x.shape, size), np.float32)
        places = out.view(f"V{4 * size}")[..., 0]  # all tags of a place move together
        inputs, c = np.zeros((2, hidden + width + 1, lanes), np.float32), np.zeros((2, hidden, lanes), np.float32)
        inputs[:, -1] = 1
        for begin in range(0, times, STEPS):
            n, end = int(np.searchsorted(-lengths, -begin)), min(begin + STEPS, times)
            now, made = x[:, :n, begin:end].transpose(2, 0, 1).astype(np.int64, order="C"), np.empty((end - begin, 2, n, size), np.float32)
            inputs, c = np.ascontiguousarray(inputs[:, :, :n]), np.ascontiguousarray(c[:, :, :n])
            z, fresh = np.empty((2, 4 * hidden, n), np.float32), np.empty((2, hidden, n), np.float32)
            gates, i, f, o, g = z[:, : 3 * hidden], z[:, :hidden], z[:, hidden : 2 * hidden], z[:, 2 * hidden : 3 * hidden], z[:, 3 * hidden :]
            state, drive, turned = inputs[:, :hidden], inputs[:, hidden:-1], inputs[:, :hidden].transpose(0, 2, 1)
            for read, tagged in zip(now, made, strict=True):
                np.take(symbols, read[0], axis=1, out=drive[0], mode="clip")
                np.take(symbols, read[1], axis=1, out=drive[1], mode="clip")
                np.matmul(weights, inputs, out=z)
                np.clip(gates, zero, one, out=gates)
                np.abs(g, out=fresh)
                fresh += one
                g /= fresh
                c *= f
                i *= g
                c += i
                c += TINY  # keeps decaying cells out of the slow range of subnormal numbers
                np.abs(c, out=fresh)
                fresh += one
                np.divide(c, fresh, out=fresh)
                np.multiply(o, fresh, out=state)
                np.matmul(turned, to_tags, out=tagged)
            places[:, :n, begin:end] = made.view(places.dtype)[..., 0].transpose(1, 2, 0)
        return out

    def step(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w = self.weights
        e = w["e"][x]
        left, lt = lstm(e, w["wl"], w["ul"], w["bl"])
        right, rt = lstm(e[::-1], w["wr"], w["ur"], w["br"])
        both = np.concatenate([left, right[::-1]], 2)
        loss, ds, dm = crf_gradient(both @ w["o"] + w["ob"], w["m"], tags)
        dboth = ds @ w["o"].T
        hidden = left.shape[2]
        g = {"o": both.reshape(-1, 2 * hidden).T @ ds.reshape(-1, ds.shape[2]), "ob": ds.sum((0, 1)), "m": dm}
        g["wl"], g["ul"], g["bl"], de = lstm_gradient(e, w["wl"], w["ul"], lt, dboth[..., :hidden])
        g["wr"], g["ur"], g["br"], dr = lstm_gradient(e[::-1], w["wr"], w["ur"], rt, dboth[::-1, :, hidden:])
        g["e"] = np.zeros_like(w["e"])
        np.add.at(g["e"], x, de + dr[::-1])
        return loss, g

    def train(self, x: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.05, seed: int = 4) -> float:
        """Adam over random batches of the columns of x and tags; the last losses' mean."""
        draw, m, v = np.random.default_rng(seed), {}, {}
        losses: list[float] = []
        for k in range(1, steps + 1):
            pick = draw.integers(0, x.shape[1], batch)
            loss, g = self.step(x[:, pick], tags[:, pick])
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - (k - 1) / steps)) ** 2
            for name, d in g.items():
                d = np.clip(d, -1, 1)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                v[name] = 0.99 * v.get(name, 0) + 0.01 * d * d
                self.weights[name] = (self.weights[name] - now * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))
