"""A small causal self-attention model over subword ids, in numpy: fitted by gradient descent, scored in batched windows.

Each id has a query, a key, a value, and two vectors that go straight to the hidden layer: one as the latest id, one as
the id before it. One masked attention layer over the window adds what lies further back. The softmax has two levels:
CLASSES classes of ids, then the ids of the target's class, so that it costs some tens of exponentials and not a
vocabulary. The most frequent ids are classes by themselves; the last class holds all ids beyond the frequent ones,
which share it by their corpus counts.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

#: Places in a window, places of a window that only give context (but in a text's first), vector and hidden sizes.
WINDOW, CONTEXT, WIDTH, HIDDEN = 32, 8, 16, 32
#: Classes, those of one id each, and ids of the others at most; the last is that of rare ids.
CLASSES, SINGLES, MEMBERS = 64, 24, 52
OWN_IDS = SINGLES + (CLASSES - 1 - SINGLES) * MEMBERS
#: Dimensions of the random projection of an id's neighbours, by which ids are classed.
SKETCH = 24
_TRIANGLE = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Windows, and places, that a step of the fit works on together: what fits a core's cache.
AT_ONCE, ROWS_AT_ONCE = 32, 1024
_LOG10 = np.float32(0.4342944819)


@dataclass
class Model:
    row: np.ndarray  # table row of each id; the last id is the start mark
    group: np.ndarray  # class of each id
    slot: np.ndarray  # place of each id in its class
    within: np.ndarray  # log10 of a rare id's share of its class, else 0
    table: np.ndarray  # q, k, v, latest, earlier of each row
    place_q: np.ndarray
    place_k: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray
    b3: np.ndarray

    NAMES = ("table", "place_q", "place_k", "w1", "b1", "w2", "b2", "w3", "b3")

    def weights(self) -> np.ndarray:
        """All fitted numbers in one array."""
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def with_weights(self, flat: np.ndarray) -> Model:
        new, at = {f.name: getattr(self, f.name) for f in fields(self)}, 0
        for n in self.NAMES:
            size = new[n].size
            new[n], at = flat[at : at + size].reshape(new[n].shape).astype(np.float32), at + size
        return Model(**new)


_Q, _K, _V, _LATEST, _EARLIER = (slice(a, z) for a, z in ((0, WIDTH), (WIDTH, 2 * WIDTH), (2 * WIDTH, 3 * WIDTH), (3 * WIDTH, 3 * WIDTH + HIDDEN), (3 * WIDTH + HIDDEN, 3 * WIDTH + 2 * HIDDEN)))
COLUMNS = 3 * WIDTH + 2 * HIDDEN


def windows(lengths: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: each window's first place, its text's end, and the places before which it only reads.

    Windows advance by WINDOW - context, so every place is scored in exactly one window, with context before it.
    """
    stride = WINDOW - context
    count = np.maximum(1, -(-(lengths - context) // stride))
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return begin[text] + nth * stride, (begin + lengths)[text], np.where(nth == 0, 0, context)


def inputs_of(m: Model, targets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the id before each place and of the one before that; the start mark's where a text has none."""
    mark = m.row[-1]
    latest, earlier = np.full(len(targets), mark, np.int32), np.full(len(targets), mark, np.int32)
    if len(targets):
        first = np.cumsum(lengths) - lengths
        latest[1:] = m.row[targets[:-1]]
        latest[first] = mark
        earlier[1:] = latest[:-1]
        earlier[first] = mark
    return latest, earlier


def _tables(m: Model) -> list[np.ndarray]:
    """q, k, v, latest and earlier of each row; v with a column that adds up the weights, latest with the bias."""
    tables = [np.ascontiguousarray(m.table[:, x]) for x in (_Q, _K, _V, _LATEST, _EARLIER)]
    tables[2] = np.concatenate([tables[2], np.ones((len(m.table), 1), m.table.dtype)], axis=1)
    tables[3] += m.b1
    return tables


def _scores_bound(m: Model) -> float:
    """Bound of all attention scores."""
    longest = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
    return (longest(m.table[:, _Q]) + longest(m.place_q)) * (longest(m.table[:, _K]) + longest(m.place_k))


def log10_probabilities(m: Model, targets: np.ndarray, lengths: np.ndarray, at_once: int = 128) -> np.ndarray:
    """log10 P(id | the ids before it in its window) at every place of texts laid end to end."""
    out = np.zeros(len(targets), np.float32)
    first, end, read = windows(lengths)
    latest, earlier = inputs_of(m, targets, lengths)
    offsets, ones = np.arange(WINDOW), np.ones(CLASSES, np.float32)
    tables, clip = _tables(m), _scores_bound(m) > 60
    group, slot = m.group.astype(np.uint8), m.slot
    for lead in np.unique(read).tolist():  # places that only give context ask nothing
        kind = np.flatnonzero(read == lead)
        for s in range(0, len(kind), at_once):
            own = kind[s : s + at_once]
            at = first[own, None] + offsets
            scored = np.flatnonzero(at[:, lead:] < end[own, None])
            np.minimum(at, len(targets) - 1, out=at)
            rows = latest.take(at)
            asking = np.ascontiguousarray(rows[:, lead:])
            q, k, v = tables[0].take(asking, axis=0), tables[1].take(rows, axis=0), tables[2].take(rows, axis=0)
            q += m.place_q[lead:]
            k += m.place_k
            weight = q @ k.transpose(0, 2, 1)
            if clip:
                np.clip(weight, -30, 30, out=weight)
            np.exp(weight, out=weight)
            weight *= _TRIANGLE[lead:]
            place = at[:, lead:].ravel()[scored]
            g = group.take(targets.take(place))
            order = np.argsort(g, kind="stable")  # a class is a slice from here on
            scored, place, g = scored.take(order), place.take(order), g.take(order)
            c = (weight @ v).reshape(-1, WIDTH + 1).take(scored, axis=0)
            u = (c[:, :-1] / c[:, -1:]) @ m.w1
            u += tables[3].take(asking.ravel().take(scored), axis=0)
            u += tables[4].take(earlier.take(place), axis=0)
            np.maximum(u, 0, out=u)
            found = np.empty(len(u), np.float32)
            for a in range(0, len(u), ROWS_AT_ONCE):
                z = u[a : a + ROWS_AT_ONCE] @ m.w2
                z += m.b2
                found[a : a + ROWS_AT_ONCE] = z[np.arange(len(z)), g[a : a + ROWS_AT_ONCE]]
                np.exp(z, out=z)
                found[a : a + ROWS_AT_ONCE] -= np.log(z @ ones)
            t = targets.take(place)
            cut = np.searchsorted(g, np.arange(SINGLES, CLASSES)).tolist()
            lo, hi = cut[0], cut[-1]
            if lo < hi:
                y = np.empty((hi - lo, MEMBERS), np.float32)
                for c, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if a < b:
                        np.matmul(u[a:b], m.w3[c], out=y[a - lo : b - lo])
                        y[a - lo : b - lo] += m.b3[c]
                found[lo:hi] += y[np.arange(hi - lo), slot.take(t[lo:hi])]
                np.exp(y, out=y)
                found[lo:hi] -= np.log(y @ ones[:MEMBERS])
            out[place] = found * _LOG10 + m.within.take(t)
    return out


def own_ids(counts: np.ndarray) -> np.ndarray:
    """The ids with vectors of their own, most frequent first."""
    order = np.argsort(-counts, kind="stable")
    return order[: min(OWN_IDS, int((counts > 0).sum()))]


def pairs(ids: np.ndarray, lengths: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """How often each of `own` stands before each other in texts laid end to end; last row and column: any other id."""
    n = len(own)
    place = np.full(size, n)
    place[own] = np.arange(n)
    code = place[ids]
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(lengths) - 1] = False  # a text's last id stands before none
    code = (code[:-1] * (n + 1) + code[1:])[inside[:-1]]
    return np.bincount(code, minlength=(n + 1) ** 2).reshape(n + 1, n + 1)


def projected(count: np.ndarray, own: np.ndarray, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """For each of `own`, random projections of the ids before and after it, rare ones weighing more. count: `pairs`, added up."""
    rng = np.random.default_rng(seed)
    n = len(own)
    vectors = rng.normal(0, 1, (n, SKETCH)) / np.sqrt(counts[own] + 1)[:, None]
    count = count[:n, :n].astype(float)
    return np.concatenate([count.T @ vectors, count @ vectors], axis=1)


def neighbours(texts: list[np.ndarray], own: np.ndarray, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """`projected` of some texts: adds up over texts."""
    ids, lengths = np.concatenate([np.zeros(0, np.int64), *texts]), np.array([len(t) for t in texts], np.int64)
    return projected(pairs(ids, lengths, own, len(counts)), own, counts, seed)


def start(counts: np.ndarray, around: np.ndarray, seed: int = 9) -> Model:
    """The model before training; `around`: sums of `neighbours`. Ids of one class are those that keep similar company."""
    rng = np.random.default_rng(seed)
    own = own_ids(counts)
    n = len(counts)
    group, slot, row = np.full(n, CLASSES - 1), np.zeros(n, np.int64), np.full(n, OWN_IDS)
    row[own] = np.arange(len(own))
    group[own[:SINGLES]] = np.arange(min(SINGLES, len(own)))
    rest = own[SINGLES:]
    if len(rest):
        x = around[SINGLES:] / np.maximum(counts[rest], 1)[:, None]
        x = x - x.mean(axis=0)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        k = CLASSES - 1 - SINGLES
        centre = x[rng.choice(len(x), k, replace=len(x) < k)]
        for _ in range(12):
            near = (x @ centre.T).argmax(axis=1)
            for c in range(k):
                if (near == c).any():
                    centre[c] = x[near == c].mean(axis=0)
                    centre[c] /= np.linalg.norm(centre[c]) + 1e-9
        order = np.lexsort((-counts[rest], near))
        size = -(-len(rest) // k)
        group[rest[order]] = SINGLES + np.arange(len(rest)) // size
        slot[rest[order]] = np.arange(len(rest)) % size
    mass = counts + 0.5
    rare = group == CLASSES - 1
    within = np.zeros(n)
    within[rare] = np.log10(mass[rare] / mass[rare].sum()) if rare.any() else 0
    normal = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
    b2 = np.log(np.bincount(group, mass, CLASSES) / mass.sum() + 1e-9)
    b3 = np.full((CLASSES - 1 - SINGLES, MEMBERS), -30.0)
    some = (group >= SINGLES) & ~rare
    b3[group[some] - SINGLES, slot[some]] = np.log(mass[some] / np.bincount(group, mass, CLASSES)[group[some]])
    return Model(
        np.append(row, OWN_IDS + 1), np.append(group, 0), np.append(slot, 0), np.append(within, 0).astype(np.float32),
        normal(0.1, OWN_IDS + 2, COLUMNS), normal(0.1, WINDOW, WIDTH), normal(0.1, WINDOW, WIDTH), normal(WIDTH**-0.5, WIDTH, HIDDEN), np.full(HIDDEN, 0.1, np.float32),
        normal(0.1, HIDDEN, CLASSES), b2.astype(np.float32), normal(0.1, CLASSES - 1 - SINGLES, HIDDEN, MEMBERS), b3.astype(np.float32),
    )


def _views(m: Model, flat: np.ndarray) -> dict[str, np.ndarray]:
    """The fitted arrays of a model as parts of one array, in the order of `weights`."""
    out, at = {}, 0
    for n in Model.NAMES:
        size = getattr(m, n).size
        out[n], at = flat[at : at + size].reshape(getattr(m, n).shape), at + size
    return out


def _softmax(z: np.ndarray, goal: np.ndarray, scale: float) -> float:
    """Puts the gradient of the loss by scores in their place; returns the sum of the goals' losses."""
    if len(z) and max(z.max(), -z.min()) > 60:  # exp must not leave what a float holds
        z -= z.max(axis=1, keepdims=True)
    at = np.arange(len(z))
    loss = -z[at, goal].sum(dtype=np.float64)
    np.exp(z, out=z)
    sums = z @ np.ones(z.shape[1], z.dtype)
    loss += np.log(sums).sum(dtype=np.float64)
    z *= (scale / sums)[:, None]
    z[at, goal] -= scale
    return loss


def _add_rows(out: np.ndarray, rows: np.ndarray, d: np.ndarray, long: int = 8) -> None:
    """out[rows] += d, rows not being distinct: long runs of one row by a product, short ones an occurrence at a time."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # small numbers are sorted by counting
    r, d, ones = rows[order], d.take(order, axis=0), np.ones(len(rows), d.dtype)
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.append(first, len(r)))
    longest = np.argsort(-size, kind="stable")
    first, size = first[longest], size[longest]
    ids, cut = r[first], np.searchsorted(-size, -np.arange(long + 1))  # so many runs are longer
    n = int(cut[long])
    sums = d.take(first, axis=0)
    for i, (a, k) in enumerate(zip(first[:n].tolist(), size[:n].tolist(), strict=True)):
        np.matmul(ones[:k], d[a : a + k], out=sums[i])
    for k in range(1, long):
        if cut[k] > n:
            sums[n : cut[k]] += d.take(first[n : cut[k]] + k, axis=0)
    out[ids] += sums


def gradients(m: Model, rows: np.ndarray, earlier: np.ndarray, goal: np.ndarray, flat: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (nats a place) and gradients for windows of table rows, the rows before those, and the ids to come; -1: no loss.

    Within a window, places with a loss follow each other: the row before one's own is that of the place before. `flat`:
    where the gradients are put, one array in the order of `weights`. Some windows, classes or places are taken at a time,
    so that what is done to them finds them in the cache. Between the two passes through the attention, places are in
    the order of their goals' classes, so that a class is a slice.
    """
    b, t = rows.shape
    dtype = m.table.dtype
    g = _views(m, np.zeros(sum(getattr(m, n).size for n in Model.NAMES), dtype) if flat is None else flat)
    for d in g.values():
        d[:] = 0
    ones, triangle = np.ones(b * t, dtype), _TRIANGLE[:t, :t]
    before, kept, tables = np.empty((b * t, HIDDEN), dtype), [], _tables(m)
    for s in range(0, b, AT_ONCE):
        q, k, v, h = (x.take(rows[s : s + AT_ONCE], axis=0) for x in tables[:4])
        q += m.place_q[:t]
        k += m.place_k[:t]
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= triangle
        c = (a @ v).reshape(-1, WIDTH + 1)
        sums = c[:, -1:].copy()
        c = c[:, :-1] / sums
        h += tables[4].take(earlier[s : s + AT_ONCE], axis=0)
        np.add(h.reshape(-1, HIDDEN), c @ m.w1, out=before[s * t : (s + AT_ONCE) * t])
        kept.append((q, k, v, a, c, sums))
    ids = goal.ravel()
    group = np.where(ids >= 0, m.group.take(ids), CLASSES).astype(np.uint8)
    order = np.argsort(group, kind="stable")  # small numbers are sorted by counting
    cut = np.searchsorted(group[order], np.arange(SINGLES, CLASSES + 1)).tolist()
    order, scale, loss = order[: cut[-1]], 1 / cut[-1], 0.0
    ids, group = ids[order], group[order]
    u = before.take(order, axis=0)
    np.maximum(u, 0, out=u)
    du = np.empty_like(u)
    for s in range(0, len(u), ROWS_AT_ONCE):
        own = u[s : s + ROWS_AT_ONCE]
        z = own @ m.w2
        z += m.b2
        loss += _softmax(z, group[s : s + ROWS_AT_ONCE], scale)
        g["w2"] += own.T @ z
        g["b2"] += ones[: len(z)] @ z
        np.matmul(z, m.w2.T, out=du[s : s + ROWS_AT_ONCE])
    slot, j = m.slot[ids], 0
    while j < CLASSES - 1 - SINGLES:
        lo, some = cut[j], []
        while j < CLASSES - 1 - SINGLES and (not some or cut[j + 1] - lo <= ROWS_AT_ONCE):
            some.append((j, cut[j] - lo, cut[j + 1] - lo))
            j += 1
        hi = cut[j]
        if lo == hi:
            continue
        own, y, back = u[lo:hi], np.empty((hi - lo, MEMBERS), dtype), np.empty((hi - lo, HIDDEN), dtype)
        for n, s, e in some:
            np.matmul(own[s:e], m.w3[n], out=y[s:e])
            y[s:e] += m.b3[n]
        loss += _softmax(y, slot[lo:hi], scale)
        for n, s, e in some:
            if s < e:
                np.matmul(own[s:e].T, y[s:e], out=g["w3"][n])
                np.matmul(ones[: e - s], y[s:e], out=g["b3"][n])
                np.matmul(y[s:e], m.w3[n].T, out=back[s:e])
        du[lo:hi] += back
    du *= u > 0
    dh = np.zeros((b * t, HIDDEN), dtype)
    dh[order] = du
    dh = dh.reshape(b, t, HIDDEN)
    dx = np.empty((b, t, COLUMNS), dtype)
    dx[:, :, _LATEST] = dh
    dx[:, :-1, _EARLIER], dx[:, -1, _EARLIER] = dh[:, 1:], 0
    for s, (q, k, v, a, c, sums) in zip(range(0, b, AT_ONCE), kept, strict=True):
        d, out = dh[s : s + AT_ONCE].reshape(-1, HIDDEN), dx[s : s + AT_ONCE]
        g["w1"] += c.T @ d
        g["b1"] += ones[: len(d)] @ d
        back = d @ m.w1.T
        dc = np.empty((len(d), WIDTH + 1), dtype)
        np.divide(back, sums, out=dc[:, :-1])
        np.divide(np.einsum("pw,pw->p", back, c), -sums[:, 0], out=dc[:, -1])
        dc = dc.reshape(-1, t, WIDTH + 1)
        ds = dc @ v.transpose(0, 2, 1)
        ds *= a
        np.matmul(ds, k, out=out[:, :, _Q])
        np.matmul(ds.transpose(0, 2, 1), q, out=out[:, :, _K])
        np.matmul(a.transpose(0, 2, 1), dc[:, :, :-1], out=out[:, :, _V])
    g["place_q"][:t], g["place_k"][:t] = dx[:, :, _Q].sum(axis=0), dx[:, :, _K].sum(axis=0)
    _add_rows(g["table"], rows.ravel(), dx.reshape(-1, COLUMNS))
    _add_rows(g["table"][:, _EARLIER], earlier[:, 0], dh[:, 0])
    return float(loss * scale), g


def _step(flat: np.ndarray, d: np.ndarray, one: np.ndarray, two: np.ndarray, s: int, pace: float, block: int = 1 << 14) -> None:
    """Step s of Adam on all weights in place, some at a time, so that all passes over them stay in the cache; uses `d` up.

    The running means are kept without their factors 0.1 and 0.01.
    """
    root, rate = (0.01 / (1 - 0.99 ** (s + 1))) ** 0.5, 0.1 * pace / (1 - 0.9 ** (s + 1))
    for at in range(0, len(flat), block):
        w, x, m1, m2 = (a[at : at + block] for a in (flat, d, one, two))
        m1 *= 0.9
        m1 += x
        np.multiply(x, x, out=x)
        m2 *= 0.99
        m2 += x
        np.sqrt(m2, out=x)
        x += 1e-7 / root
        np.divide(m1, x, out=x)
        x *= rate / root
        w -= x


def train(m: Model, texts: list[np.ndarray], done: float = 0.0, part: float = 1.0, batch: int = 128, rate: float = 0.012, least: int = 150, seed: int = 3) -> list[float]:
    """Adam over all windows of the texts (each closed by its end id) in random order; changes `m`, returns losses.

    Windows lie side by side, so each place of each text is learnt once, or as often as `least` steps need. `done`, `part`: which part of the whole training
    this is; steps become smaller towards its end.
    """
    texts = [t for t in texts if len(t)]
    if not texts:
        return []
    rng = np.random.default_rng(seed)
    lengths, targets = np.array([len(t) for t in texts]), np.concatenate(texts)
    latest, earlier = inputs_of(m, targets, lengths)
    first, end, _ = windows(lengths, 0)
    once = -(-len(first) // batch)
    order = np.concatenate([rng.permutation(len(first)) for _ in range(-(-least // once))])
    flat = m.weights()
    for n, part_of in _views(m, flat).items():
        setattr(m, n, part_of)  # a step on `flat` is one on the model
    one, two, d = (np.zeros_like(flat) for _ in range(3))
    losses, steps = [], -(-len(order) // batch)
    for s in range(steps):
        pick = order[s * batch : (s + 1) * batch]
        at = first[pick, None] + np.arange(WINDOW)
        inside = at < end[pick, None]
        at = np.minimum(at, len(targets) - 1)
        losses.append(gradients(m, latest[at], earlier[at], np.where(inside, targets[at], -1), d)[0])
        _step(flat, d, one, two, s, rate * min(1, (s + 1) / 20) * (1 - 0.95 * (done + part * s / steps)))
    return losses
