"""A causal self-attention model over subword ids: its numpy half. Training and scoring over tables are in lm_scoring.

Subwords are classes: the most frequent ones stand for themselves, the others share BANDS classes of like frequency and have their own share of
theirs. A window of classes is embedded, one head of masked attention adds what came before in the window, and the next class is told in two
steps, its cluster and its place in the cluster, so that a token costs 2 * 32 exponentials instead of 1024; probabilities add up to 1
exactly. Embeddings and outputs start from a factorisation of the class bigrams of the whole corpus, clusters from the outputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes: CLUSTERS clusters of PLACES. Numbers of the model: width of vectors, window, and tokens of a window that are scored, its last ones; those
#: before are what they see at least. A text is preceded by as many end tokens.
CLUSTERS, PLACES, BANDS = 32, 32, 16
CLASSES = CLUSTERS * PLACES
WIDTH, WINDOW, STEP = 16, 40, 32
SEEN = WINDOW - STEP
#: No class: behind a text's end.
NONE = 65535
#: Windows that are scored, and that are attended, at once, and states whose clusters are told at once.
BLOCK, AT_ONCE, SMALL = 512, 32, 1024

Weights = dict[str, np.ndarray]


@dataclass
class Model:
    cls: np.ndarray  # of each subword
    within: np.ndarray  # log probability of each subword in its class
    weights: Weights


def layout(counts: np.ndarray) -> np.ndarray:
    """The class of each subword by its count: the frequent ones alone, the rest in bands of about the same mass."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    head = min(len(counts), CLASSES - BANDS)
    cls = np.empty(len(counts), np.int64)
    cls[order[:head]] = np.arange(head)
    mass = np.cumsum(counts[order[head:]] + 0.5)
    if len(mass):
        cls[order[head:]] = head + np.minimum(BANDS - 1, (mass / mass[-1] * BANDS).astype(np.int64))
    return cls


def shares(counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Log probability of each subword in its class, half a count added to each."""
    own = counts + 0.5
    return np.log(own / np.bincount(cls, weights=own, minlength=CLASSES)[cls])


def clusters(vectors: np.ndarray, size: int = PLACES) -> np.ndarray:
    """An order of the vectors in which each `size` following ones are near: halves by the direction of most spread, again and again."""

    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= size:
            return [at]
        x = vectors[at] - vectors[at].mean(0)
        spread = np.linalg.eigh(x.T @ x)[1][:, -1]
        spread = spread * np.sign(spread[np.argmax(np.abs(spread))])
        at = at[np.argsort(x @ spread, kind="stable")]
        middle = len(at) // 2 // size * size or len(at) // 2
        return halves(at[:middle]) + halves(at[middle:])

    return np.concatenate(halves(np.arange(len(vectors))))


def first_weights(bigrams: np.ndarray, strength: float = 20.0) -> tuple[Weights, np.ndarray]:
    """The weights from which training starts, a factorised bigram model, and the new number of each class (clusters are 32 following ones)."""
    rng = np.random.default_rng(1)
    seen = bigrams.sum(1)
    prior = bigrams.sum(0) + 0.5
    prior /= prior.sum()
    ratio = np.log((bigrams + strength * prior) / (seen[:, None] + strength)) - np.log(prior)
    row, column = np.sqrt((seen + 1) / (seen.sum() + CLASSES)), np.sqrt(prior)
    left, values, right = np.linalg.svd(row[:, None] * ratio * column)
    embed = left[:, :WIDTH] * np.sqrt(values[:WIDTH]) / row[:, None]
    output = (np.sqrt(values[:WIDTH])[:, None] * right[:WIDTH] / column).T
    order = clusters(output * column[:, None])
    # By cluster, and by place within the cluster, the log ratios that the embedding gives best.
    group = np.empty(CLASSES, np.int64)
    group[order] = np.arange(CLASSES) // PLACES
    summed = np.zeros((CLASSES, CLUSTERS))
    np.add.at(summed.T, group, bigrams.T)
    of_group = np.bincount(group, weights=prior, minlength=CLUSTERS)
    ratio_group = np.log((summed + strength * of_group) / (seen[:, None] + strength)) - np.log(of_group)
    fit = np.linalg.pinv(row[:, None] * embed) * row
    inside = fit @ (ratio - ratio_group[:, group])
    small = lambda *shape: rng.normal(0, 0.5 / np.sqrt(WIDTH), shape)
    weights = {
        "embed": embed[order], "place": rng.normal(0, 0.05, (WINDOW, WIDTH)), "query": small(WIDTH, WIDTH), "key": small(WIDTH, WIDTH), "value": small(WIDTH, WIDTH),
        "mix": np.zeros((WIDTH, WIDTH)), "cluster": fit @ ratio_group, "cluster_bias": np.log(of_group),
        "inside": inside.T[order], "inside_bias": np.log(prior / of_group[group])[order],
    }
    new = np.empty(CLASSES, np.int64)
    new[order] = np.arange(CLASSES)
    return {k: v.astype(np.float32) for k, v in weights.items()}, new


_PAST, _ALL = np.tril(np.ones((WINDOW, WINDOW), np.float32)), np.ones((WINDOW, 1), np.float32)


def _attend(w: Weights, x: np.ndarray):
    """Embedding, queries, keys, values, attention and what it brings, of windows of classes."""
    e = np.take(w["embed"], x, axis=0)
    e += w["place"]
    q, k, v = e @ w["query"], e @ w["key"], e @ w["value"]
    a = q @ k.transpose(0, 2, 1)
    if a.size and max(a.max(), -a.min()) > 60:
        a -= np.where(_PAST > 0, a, -np.inf).max(-1, keepdims=True)
        np.minimum(a, 0, out=a)  # what is to come is larger, and masked
    np.exp(a, out=a)
    a *= _PAST
    a /= a @ _ALL
    return e, q, k, v, a, a @ v


_ONES = np.ones((max(PLACES, CLUSTERS), 1), np.float32)


def _exp_sum(logits: np.ndarray, safe: bool) -> np.ndarray:
    """Log of the sum of exponentials of each row; logits are overwritten. safe: no exponential can overflow, nor all of a row vanish."""
    if safe:
        return np.log((np.exp(logits, out=logits) @ _ONES[: logits.shape[1]])[:, 0])
    shift = logits.max(1, keepdims=True)
    logits -= shift
    return np.log((np.exp(logits, out=logits) @ _ONES[: logits.shape[1]])[:, 0]) + shift[:, 0]


class Room:
    """Arrays for the intermediate values of a block, used again and again: new ones of this size cost more to come by than to fill."""

    def __init__(self, kind=np.float32):
        new = lambda *shape: np.empty(shape, kind)
        self.query, self.embed, self.mixed = (new(AT_ONCE, STEP, WIDTH) for _ in range(3))
        self.key, self.value = new(AT_ONCE, WINDOW, WIDTH), new(AT_ONCE, WINDOW, WIDTH + 1)
        self.attention, self.brought = new(AT_ONCE, STEP, WINDOW), new(AT_ONCE, STEP, WIDTH + 1)
        self.states, self.sorted = new(BLOCK * STEP, WIDTH), new(BLOCK * STEP, WIDTH)
        self.outer, self.inner = new(SMALL, CLUSTERS), new(BLOCK * STEP, PLACES)


def log_probabilities(w: Weights, h: np.ndarray, y: np.ndarray, room: Room) -> np.ndarray:
    """Of the classes y behind the states h, BLOCK * STEP at most."""
    longest = max(np.square(w["cluster"]).sum(0).max(), np.square(w["inside"]).sum(1).max())
    safe = bool(np.abs(h).max(initial=0) * np.sqrt(WIDTH * longest) + max(np.abs(w["cluster_bias"]).max(), np.abs(w["inside_bias"]).max()) < 60)
    own = y // PLACES
    out = np.empty(len(y), h.dtype)
    for a in range(0, len(y), SMALL):
        part = h[a : a + SMALL]
        logits = np.matmul(part, w["cluster"], out=room.outer[: len(part)])
        logits += w["cluster_bias"]
        out[a : a + SMALL] = np.take(logits.reshape(-1), np.arange(0, logits.size, CLUSTERS) + own[a : a + SMALL])
        out[a : a + SMALL] -= _exp_sum(logits, safe)
    order = np.argsort(own.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=CLUSTERS)).tolist()
    h = np.take(h, order, axis=0, out=room.sorted[: len(y)], mode="clip")
    place, inner = (y - own * PLACES)[order], np.empty(len(y), out.dtype)
    for c, (a, b) in enumerate(zip([0, *ends], ends)):
        if b > a:
            logits = np.matmul(h[a:b], w["inside"][c * PLACES : (c + 1) * PLACES].T, out=room.inner[: b - a])
            logits += w["inside_bias"][c * PLACES : (c + 1) * PLACES]
            inner[a:b] = np.take(logits.reshape(-1), np.arange(0, logits.size, PLACES) + place[a:b])
            inner[a:b] -= _exp_sum(logits, safe)
    out[order] += inner
    return out


def tables(w: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries, keys, values (with a last column of ones) and embeddings, of all classes and of all places."""
    out = [(w["embed"] @ w[k], w["place"] @ w[k]) for k in ("query", "key", "value")] + [(w["embed"], w["place"])]
    value, place = out[2]
    out[2] = np.append(value, np.ones_like(value[:, :1]), 1), np.append(place, np.zeros_like(place[:, :1]), 1)
    return out


def states(w: Weights, by: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, room: Room, out: np.ndarray) -> None:
    """Into `out`: the states at the last STEP places of windows of classes, AT_ONCE at most, one behind the other. by: tables(w)."""
    n, last = len(x), x[:, SEEN:]
    q, e = (np.take(by[i][0], last, axis=0, out=to[:n], mode="clip") for i, to in ((0, room.query), (3, room.embed)))
    k, v = (np.take(by[i][0], x, axis=0, out=to[:n], mode="clip") for i, to in ((1, room.key), (2, room.value)))
    q += by[0][1][SEEN:]
    k += by[1][1]
    v += by[2][1]
    e += by[3][1][SEEN:]
    a = np.matmul(q, k.transpose(0, 2, 1), out=room.attention[:n])
    if a.max() > 60 or a.min() < -60:
        a -= np.where(_PAST[SEEN:] > 0, a, -np.inf).max(-1, keepdims=True)
    np.exp(a, out=a)
    a *= _PAST[SEEN:]
    c = np.matmul(a, v, out=room.brought[:n])  # the last column adds up the attention
    c = np.divide(c[..., :WIDTH], c[..., WIDTH:], out=room.mixed[:n])
    np.matmul(c.reshape(-1, WIDTH), w["mix"], out=out)
    out += e.reshape(-1, WIDTH)


def _windows(lengths: np.ndarray) -> np.ndarray:
    return -(-lengths // STEP)


def score_texts(model: Model, texts: list[np.ndarray], end_id: int) -> np.ndarray:
    """Log probability (natural) of each text's subwords and its end, from its start on. Windows overlap by SEEN; each token is scored once."""
    n = np.array([len(ids) + 1 for ids in texts], np.int64)  # tokens that are scored
    gap = np.full(SEEN + 1, end_id)
    joined = np.concatenate([part for ids in texts for part in (gap, ids)] + [np.full(WINDOW + 1, end_id)]).astype(np.int64)
    classes = model.cls[joined]  # behind a text's last token stand end tokens
    begin = np.cumsum(n + SEEN) - n - SEEN
    windows = _windows(n)
    of = np.repeat(np.arange(len(texts)), windows)
    at = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * STEP
    left = (begin + n)[of] - at  # tokens that are to be scored from this window on
    out, by, room = np.zeros(len(texts)), tables(model.weights), Room()
    every = np.lib.stride_tricks.sliding_window_view(classes, WINDOW + 1)
    for a in range(0, len(at), BLOCK):
        own = slice(a, a + BLOCK)
        rows = every[at[own]]
        h = room.states[: len(rows) * STEP]
        for k in range(0, len(rows), AT_ONCE):
            states(model.weights, by, rows[k : k + AT_ONCE, :-1], room, h[k * STEP : (k + AT_ONCE) * STEP])
        p = log_probabilities(model.weights, h, rows[:, SEEN + 1 :].reshape(-1), room).reshape(len(rows), STEP)
        p[np.arange(STEP) >= left[own, None]] = 0  # behind the text's end
        np.add.at(out, of[own], p.sum(1, dtype=np.float64))
    rest = np.append(0.0, np.cumsum(model.within[joined]))
    first = begin + SEEN + 1
    return out + rest[first + n - 1] - rest[first] + model.within[end_id]


def training_windows(cls: np.ndarray, ids: np.ndarray, end_id: int) -> np.ndarray:
    """Windows of classes of a text with its start and end, as they are scored, each with the class behind its last; NONE behind the end."""
    row = cls[np.concatenate([np.full(SEEN + 1, end_id), ids, [end_id]])]
    n = _windows(len(ids) + 1)
    row = np.append(row, np.full(SEEN + 1 + n * STEP - len(row), NONE))
    return np.lib.stride_tricks.sliding_window_view(row, WINDOW + 1)[::STEP].astype("<u2")


def _softmax(logits: np.ndarray, at: np.ndarray, n: int) -> float:
    """The loss of each row's choice, summed; logits become its gradients, divided by n."""
    if logits.size and max(logits.max(), -logits.min()) > 60:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits @ _ONES[: logits.shape[1]]
    chosen = np.arange(0, logits.size, logits.shape[1]) + at
    flat = logits.reshape(-1)
    p = flat[chosen]
    flat[chosen] = p - 1
    logits *= np.float32(1 / max(1, n))
    return -float(np.log(p + 1e-30).sum())


def gradients(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over the places whose y is a class, and its gradients."""
    flat = lambda z: z.reshape(-1, WIDTH)
    e, q, k, v, a, c = _attend(w, x)
    h = c @ w["mix"]
    h += e
    # The places that count, by cluster: each cluster's are a slice then.
    at = np.flatnonzero(y.reshape(-1) != NONE)
    yf = y.reshape(-1)[at].astype(np.int64)
    own = (yf // PLACES).astype(np.uint8)
    by = np.argsort(own, kind="stable")
    at, yf, own = at[by], yf[by], own[by].astype(np.int64)
    ends = np.cumsum(np.bincount(own, minlength=CLUSTERS)).tolist()
    slices = [(slice(i, j), slice(number * PLACES, (number + 1) * PLACES)) for number, (i, j) in enumerate(zip([0, *ends], ends)) if j > i]
    hf = np.take(flat(h), at, axis=0)
    g = {name: np.zeros_like(value) for name, value in w.items()}

    d = hf @ w["cluster"]
    d += w["cluster_bias"]
    loss = _softmax(d, own, len(yf))
    g["cluster"], g["cluster_bias"] = hf.T @ d, d.sum(0)
    dhf = d @ w["cluster"].T
    for rows, group in slices:
        np.matmul(hf[rows], w["inside"][group].T, out=d[rows])
    d += np.take(w["inside_bias"].reshape(CLUSTERS, PLACES), own, axis=0)
    loss += _softmax(d, yf - own * PLACES, len(yf))
    back = np.empty_like(hf)
    for rows, group in slices:
        np.matmul(d[rows].T, hf[rows], out=g["inside"][group])
        np.matmul(d[rows], w["inside"][group], out=back[rows])
    dhf += back
    if slices:
        g["inside_bias"].reshape(CLUSTERS, PLACES)[own[[rows.start for rows, _ in slices]]] = np.add.reduceat(d, [rows.start for rows, _ in slices])
    dh = np.zeros_like(h)
    flat(dh)[at] = dhf
    g["mix"] = flat(c).T @ flat(dh)
    dc = dh @ w["mix"].T
    ds = dc @ v.transpose(0, 2, 1)
    ds -= np.einsum("nti,nti->nt", dc, c)[..., None]  # what the attention's gradients add up to
    ds *= a
    de = dh
    for name, dz in (("query", ds @ k), ("key", ds.transpose(0, 2, 1) @ q), ("value", a.transpose(0, 2, 1) @ dc)):
        g[name] = flat(e).T @ flat(dz)
        de += dz @ w[name].T
    g["place"] = de.sum(0)
    cell = x.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
    g["embed"] = np.bincount(cell.reshape(-1), weights=de.reshape(-1), minlength=CLASSES * WIDTH).reshape(CLASSES, WIDTH).astype(de.dtype)
    return loss / max(1, len(yf)), g


def train(weights: Weights, windows: np.ndarray, rate: float, batch: int = 32) -> Weights:
    """One pass of Adam over the windows, in their order; the rate rises for 20 steps and falls to a tenth."""
    np.empty(1 << 24, np.uint8)  # once this much was freed, the C library keeps the steps' arrays instead of asking the system for each
    w = {k: v.copy() for k, v in weights.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    steps = -(-len(windows) // batch)
    for t in range(1, steps + 1):
        part = windows[(t - 1) * batch : t * batch].astype(np.int64)
        x = part[:, :-1]
        x = np.where(x == NONE, 0, x)
        _, g = gradients(w, x, part[:, 1:])
        now = rate * min(1, t / 20) * (1 - 0.9 * t / steps)
        for k in w:
            mean[k] += np.float32(0.1) * (g[k] - mean[k])
            square[k] += np.float32(0.01) * (g[k] * g[k] - square[k])
            w[k] -= np.float32(now) * (mean[k] / np.float32(1 - 0.9**t)) / (np.sqrt(square[k] / np.float32(1 - 0.99**t)) + np.float32(1e-8))
    return w


def packed(weights: Weights) -> bytes:
    return b"".join(weights[k].astype("<f4").tobytes() for k in sorted(weights))


def unpacked(raw: bytes, like: Weights) -> Weights:
    values, out, at = np.frombuffer(raw, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out
