"""A small causal self-attention model over subword ids, in numpy.

One layer: embeddings, attention of some heads with a learnt weight for each distance, a residual, a two-layer map with a
residual. A head reads its part of the state with one learnt map for keys and one for values: with one head, as here, maps
for queries and for what is seen would only be factors of these two. The output is a class of ids and then an id of the class, so that a prediction costs two short softmaxes; the
logarithms of the ids' shares in the corpus are where its biases start. Gradients are written out; steps are Adam's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

Weights = dict[str, np.ndarray]

#: Context, width, heads, hidden width.
CONTEXT, WIDTH, HEADS, HIDDEN = 32, 32, 1, 32
_FAR, _MOST = np.float32(-1e9), np.float32(60)
#: Half the bytes that a process keeps between steps (glibc counts blocks up to 32 MB).
_KEPT = 24 << 20


def initial(shares: np.ndarray, classes: int, seed: int = 5, context: int = CONTEXT, width: int = WIDTH, heads: int = HEADS, hidden: int = HIDDEN) -> Weights:
    """shares: of each id, class by class (classes * ids a class). The id after the last is the start of a text. The last
    row of class, and of each class in id, is a bias."""
    rng = np.random.default_rng(seed)
    each = len(shares) // classes
    table = shares.reshape(classes, each)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    biased = lambda x, bias: np.concatenate([x, bias.astype(np.float32)], axis=-2)
    return {
        "embed": draw(len(shares) + 1, width, by=0.3),
        "pair": draw(width, 2 * width, by=width**-0.5),
        "near": np.zeros((heads, context), np.float32) - np.linspace(0, 2, context, dtype=np.float32) * np.arange(heads, dtype=np.float32)[:, None],
        "up": draw(width, hidden, by=width**-0.5), "up0": np.zeros(hidden, np.float32), "down": draw(hidden, width, by=0.3 * hidden**-0.5),
        "class": biased(draw(width, classes, by=0.1), np.log(table.sum(1))[None]),
        "id": biased(draw(classes, width, each, by=0.1), np.log(table / table.sum(1, keepdims=True))[:, None]),
    }


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()])


def _views(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k, x in like.items():
        out[k] = values[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def unflat(values: np.ndarray, like: Weights) -> Weights:
    return {k: x.astype(np.float32) for k, x in _views(values, like).items()}


@lru_cache(maxsize=4)
def _back(length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each place is behind each, where it is not ahead; and which are ahead, of all (length * length)."""
    far = (np.arange(length)[:, None] - np.arange(length)[None, :]).ravel()
    return far[far >= 0], far < 0


def _bias(near: np.ndarray, length: int) -> np.ndarray:
    """(heads, length, length): the weight of each distance back; what lies ahead is masked."""
    back, ahead = _back(length)
    out = np.full((len(near), length * length), _FAR, np.float32)
    out[:, ~ahead] = near[:, back]
    return out.reshape(-1, length, length)


def _sum_rows(x: np.ndarray, out: np.ndarray) -> None:
    np.matmul(np.ones(len(x), x.dtype), x, out=out)


def _softmax(x: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """In place; seen: a factor of each, 0 where nothing is to be seen. What an exponential takes is held between -_MOST and
    _MOST, which no score of a trained model comes near: no row's sum is zero or infinite."""
    np.clip(x, -_MOST, _MOST, out=x)
    np.exp(x, out=x)
    if seen is not None:
        x *= seen
    x /= (x @ np.ones(x.shape[-1], x.dtype))[..., None]
    return x


def _split(x: np.ndarray, n: int, length: int, heads: int) -> np.ndarray:
    return x.reshape(n, length, heads, -1).transpose(0, 2, 1, 3)


def _join(x: np.ndarray) -> np.ndarray:
    n, heads, length, each = x.shape
    return x.transpose(0, 2, 1, 3).reshape(n * length, heads * each)


def _body(w: Weights, x: np.ndarray):
    """x: (windows, length) ids. The states of all places, and what the gradient needs."""
    n, length = x.shape
    heads, width = len(w["near"]), w["embed"].shape[1]
    h = w["embed"].take(x.ravel(), axis=0)
    pair = h @ w["pair"]
    k, v = (_split(pair[:, i : i + width], n, length, heads) for i in (0, width))
    a = np.matmul(_split(h, n, length, heads), k.transpose(0, 1, 3, 2))
    a *= a.dtype.type((width // heads) ** -0.5)
    _softmax(a, np.exp(_bias(w["near"], length)))
    z = h + _join(np.matmul(a, v))
    u = z @ w["up"]
    u += w["up0"]
    np.maximum(u, 0, out=u)
    return z + u @ w["down"], (h, k, v, a, z, u)


def prepared(w: Weights, length: int = CONTEXT) -> Weights:
    """w with what _states makes of it, for many calls: how much each id looks at each other, as the exponential, and what
    it sees there, with a 1 that sums the weights; a state before attention is its id's alone."""
    heads, (n, width) = len(w["near"]), w["embed"].shape
    each = width // heads
    pair = w["embed"] @ w["pair"]
    looks, sees = [], []
    for at in (slice(k * each, (k + 1) * each) for k in range(heads)):
        scores = w["embed"][:, at] @ pair[:, at].T
        scores *= np.float32(each**-0.5)
        looks.append(np.exp(np.clip(scores, -_MOST, _MOST)).ravel())
        sees.append(np.concatenate([pair[:, width:][:, at], np.ones((n, 1), np.float32)], axis=1))
    return w | {"looks": looks, "sees": sees, "seen": np.exp(_bias(w["near"], length))}


def _states(w: Weights, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """What _body gives for the places keep; w: prepared."""
    n, length = x.shape
    x = x.astype(np.intp)
    ids, pairs = x.ravel(), (x * len(w["embed"]))[:, :, None] + x[:, None, :]
    seen, parts = w["seen"], []
    for k, (looks, sees) in enumerate(zip(w["looks"], w["sees"], strict=True)):
        a = looks.take(pairs)
        a *= seen[k]
        o = np.matmul(a, sees.take(ids, axis=0).reshape(n, length, -1)).reshape(n * length, -1).take(keep, axis=0)
        parts.append(o[:, :-1] / o[:, -1:])
    z = parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)
    z += w["embed"].take(ids.take(keep), axis=0)
    u = z @ w["up"]
    u += w["up0"]
    np.maximum(u, 0, out=u)
    z += u @ w["down"]
    return z


def _by_class(y: np.ndarray, each: int):
    """Rows in the order of their class, and where each class's rows begin and end."""
    of = (y // each).astype(np.int16)  # sorted by radix
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of))
    return order, [(c, s, e) for c, (s, e) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)) if e > s]


def _outputs(w: Weights, s: np.ndarray, at: np.ndarray, parts: list[tuple[int, int, int]]):
    """The states of the places at, class by class, with a 1 for the bias, and the scores of classes and of ids."""
    st = np.empty((len(at), s.shape[1] + 1), s.dtype)
    st[:, :-1] = s.take(at, axis=0)
    st[:, -1] = 1
    low = np.empty((len(at), w["id"].shape[2]), s.dtype)
    for c, b, e in parts:
        np.matmul(st[b:e], w["id"][c], out=low[b:e])
    return st, st @ w["class"], low


def logs(w: Weights, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of y at the places keep of the windows x, in keep's order."""
    s = _states(w, x, keep) if "looks" in w else _body(w, x)[0][keep]
    each = w["id"].shape[2]
    order, parts = _by_class(y, each)
    y = y[order]
    _, top, low = _outputs(w, s, order, parts)
    rows, out, got = np.arange(len(y)), np.empty(len(y)), 0.0
    for t, at in ((top, y // each), (low, y % each)):
        np.minimum(t, _MOST, out=t)
        got = got + t[rows, at]
        np.exp(t, out=t)
        got -= np.log(t @ np.ones(t.shape[1], t.dtype))
    out[order] = got
    return out


def gradient(w: Weights, x: np.ndarray, y: np.ndarray, keep: np.ndarray, g: Weights | None = None) -> tuple[Weights, float]:
    """The gradient of the mean loss over the places keep, and the loss. g: arrays like w's that it is put into."""
    n, length = x.shape
    heads, each, width = len(w["near"]), w["id"].shape[2], w["embed"].shape[1]
    s, (h, k, v, a, z, u) = _body(w, x)
    g = g or {name: np.empty_like(t) for name, t in w.items()}
    order, parts = _by_class(y, each)
    at, yt = keep[order], y[order]
    st, top, low = _outputs(w, s, at, parts)
    size = s.dtype.type(1 / len(yt))
    loss, rows = 0.0, np.arange(len(yt))
    for t, right in ((top, yt // each), (low, yt % each)):
        _softmax(t)
        loss -= np.log(t[rows, right]).sum(dtype=float)
        t[rows, right] -= 1
        t *= size
    np.matmul(st.T, top, out=g["class"])
    g["id"].fill(0)
    ds, ids = np.empty((len(yt), width), s.dtype), w["id"][:, :-1].transpose(0, 2, 1)
    for c, b, e in parts:
        np.matmul(st[b:e].T, low[b:e], out=g["id"][c])
        np.matmul(low[b:e], ids[c], out=ds[b:e])
    ds += top @ w["class"][:-1].T
    full = np.zeros_like(s)
    full[at] = ds
    du = full @ w["down"].T
    du *= u > 0
    np.matmul(u.T, full, out=g["down"])
    np.matmul(z.T, du, out=g["up"])
    _sum_rows(du, g["up0"])
    dz = full
    dz += du @ w["up"].T
    do = _split(dz, n, length, heads)
    pair = np.empty((len(h), 2 * width), s.dtype)
    dk, dv = (_split(pair[:, i : i + width], n, length, heads) for i in (0, width))
    da = np.matmul(do, v.transpose(0, 1, 3, 2))
    np.matmul(a.transpose(0, 1, 3, 2), do, out=dv)
    da -= np.einsum("nhij,nhij->nhi", da, a)[..., None]
    da *= a
    back, ahead = _back(length)
    for by, total in zip(g["near"], da.sum(axis=0), strict=True):
        by[:] = np.bincount(back, weights=total.ravel()[~ahead], minlength=length)
    da *= s.dtype.type((width // heads) ** -0.5)
    np.matmul(da.transpose(0, 1, 3, 2), _split(h, n, length, heads), out=dk)
    dh = dz + _join(np.matmul(da, k))
    dh += pair @ w["pair"].T
    np.matmul(h.T, pair, out=g["pair"])
    many = np.bincount(x.ravel())
    ids = np.flatnonzero(many)
    g["embed"].fill(0)
    g["embed"][ids] = np.add.reduceat(dh.take(np.argsort(x.ravel().astype(np.int16), kind="stable"), axis=0), np.cumsum(many[ids]) - many[ids], axis=0)
    return g, loss / len(yt)


def keep_freed() -> None:
    """Has this process keep the memory that a step frees for the next step: glibc gives back what lies free beyond twice the
    largest block that was ever freed, and else each step's arrays are given back and paged in again."""
    np.empty(_KEPT, np.uint8)


class Adam:
    """Steps on a copy of the weights: all of them are one array, of which w, g and the rest are views."""

    def __init__(self, w: Weights, rate: float):
        keep_freed()
        self.all, self.rate, self.t = flat(w), rate, 0
        self.slope, self.m, self.v, self.by = (np.zeros_like(self.all) for _ in range(4))
        self.w, self.g = _views(self.all, w), _views(self.slope, w)

    def step(self) -> None:
        """A step down the gradient in g, which is used up."""
        self.t += 1
        rate = np.float32(self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t))
        g, m, v, by = self.slope, self.m, self.v, self.by  # m and v: 10 and 100 times the means
        m *= np.float32(0.9)
        m += g
        g *= g
        v *= np.float32(0.99)
        v += g
        np.sqrt(v, out=by)
        by += np.float32(1e-7)
        np.divide(m, by, out=by)
        by *= rate
        self.all -= by


def fit_steps(steps: Adam, windows: np.ndarray, batch: int = 32) -> None:
    """Steps over windows: (windows, length + 1) ids, each the text before the next; -1 after a text's end."""
    for i in range(0, len(windows), batch):
        part = windows[i : i + batch]
        y = part[:, 1:].ravel()
        keep = np.flatnonzero(y >= 0)
        gradient(steps.w, np.maximum(part[:, :-1], 0), y[keep], keep, steps.g)
        steps.step()
