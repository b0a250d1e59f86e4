"""A small causal self-attention model over subword ids, in numpy.

Ids are sorted into a tree of three levels with sixteen branches each: the
frequent ones by the company they keep, a leaf for each; the others share some
leaves in proportion to their counts. The model attends over the leaves of the
tokens before and gives probabilities to the branches that lead to the next one;
they start from the counts of the whole corpus. A token costs three choices among
sixteen, not one among thousands.
"""

import ctypes
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np

BRANCH, LEVELS = 16, 3
LEAVES = BRANCH**LEVELS
#: Parts of the tree with a leaf for other ids, and leaves of such a part.
PARTS, PART = 64, 64
WIDTH, HIDDEN = 16, 32
#: Tokens of a context window; each window scores its last SCORED tokens.
WINDOW, SCORED = 16, 8
#: Windows of a step, and of the part of it whose attention is worked out at a time.
BATCH, MICRO, RATE = 1024, 64, 0.04
#: Tokens of a part of the corpus, and that a part sees in its fitting, at least.
SEEN = 1 << 23
_NEAR, _COMPANY = 8, 256
_SMOOTH = 0.1
_AT_ONCE = 1 << 15
#: Pairs of company that are counted at a time, about.
_CELLS = 1 << 22
#: Tokens, sorted by leaf, whose way through the tree is worked out at a time.
_SORTED = 1 << 11
#: Exponents within these bounds need no scaling in single precision.
_FAR = 60
_OWN = np.arange(SCORED)


@dataclass
class Codes:
    """By id: its leaf, and the log of its share of that leaf. ``mass`` is the
    corpus count of each leaf. The last id is the end of a text."""

    code: np.ndarray
    share: np.ndarray
    mass: np.ndarray

    @property
    def end(self) -> int:
        return len(self.code) - 1


def _bisect(ids: np.ndarray, x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal parts of ``ids``, halved again and again along the widest direction."""
    if parts == 1:
        return [ids]
    centred = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    order = np.argsort(centred @ vectors[:, -1], kind="stable")
    half = len(ids) // 2
    low, high = order[:half], order[half:]
    return _bisect(ids[low], x[low], parts // 2) + _bisect(ids[high], x[high], parts // 2)


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with a leaf of their own, most frequent first and the end of text
    before all; place of each id among them, -1 for others)."""
    weight = counts.astype(np.float64)
    weight[-1] = np.inf
    top = np.argsort(-weight, kind="stable")[: PARTS * (PART - 1)]
    place = np.full(len(counts), -1)
    place[top] = np.arange(len(top))
    return top, place


def company_of(counts: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """How often each frequent id stands near the most frequent ones in some
    texts (ids, with their end marks). Sums over parts of a corpus are that of
    the corpus."""
    top, place = _places(counts)
    gap = np.full(_NEAR, -1)  # keeps texts apart
    at = np.concatenate([gap, *(x for t in texts for x in (place[t], gap))])
    # row 0 of the sums is for what is not frequent, and is left out
    row = ((at + 1) * _COMPANY).astype(np.int32)
    common = np.flatnonzero((at >= 0) & (at < _COMPANY))
    found, cells = np.zeros((len(top) + 1) * _COMPANY), []
    for i in range(0, len(common), _CELLS // 8):
        places = common[i : i + _CELLS // 8]
        column = at[places].astype(np.int32)
        for step in range(1, _NEAR + 1):
            cells += [row[places - step] + column, row[places + step] + column]
            if len(cells) * len(places) >= _CELLS or step == _NEAR:
                found += np.bincount(np.concatenate(cells), minlength=len(found))
                cells = []
    return found.reshape(-1, _COMPANY)[1:]


def build_codes(counts: np.ndarray, tokens: np.ndarray) -> Codes:
    """Codes from the corpus counts of all ids (the end of text last) and
    running text."""
    return codes_from(counts, company_of(counts, [tokens]))


def codes_from(counts: np.ndarray, company: np.ndarray) -> Codes:
    """Codes from the corpus counts of all ids and the company they keep."""
    counts = counts.astype(np.float64)
    top, place = _places(counts)
    mean = company.sum(axis=1, keepdims=True) * company.sum(axis=0) / max(1.0, company.sum())
    x = np.log1p(company / (mean + 0.5))
    _, vectors = np.linalg.eigh(x.T @ x)
    vectors = x @ vectors[:, -WIDTH:]
    code = np.empty(len(counts), dtype=np.int64)
    share = np.zeros(len(counts))
    # The first of the four groups of a part is one leaf short: that is for others.
    groups = _bisect(top, vectors, PARTS * PART // BRANCH)
    for i, group in enumerate(groups):
        code[group] = i * BRANCH + np.arange(len(group))
    rest = np.flatnonzero(place < 0)
    code[rest] = rest % PARTS * PART + BRANCH - 1
    mass = np.bincount(code, counts + _SMOOTH, minlength=LEAVES)
    share[rest] = np.log((counts[rest] + _SMOOTH) / mass[code[rest]])
    return Codes(code.astype(np.int32), share.astype(np.float32), mass + 1e-6)


@cache
def one_thread() -> None:
    """Hold matrix products to the one core that a task has, once per process.
    The linear algebra library would else spread small products over all cores
    of the executor, and its threads wait by spinning."""
    folder = Path(np.__file__).resolve().parent.parent / "numpy.libs"
    for path in folder.glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def _top(x: np.ndarray) -> np.ndarray:
    """The largest of each row; rows are of a power of two of numbers."""
    while x.shape[-1] > 1:
        half = x.shape[-1] // 2
        x = np.maximum(x[..., :half], x[..., half:])
    return x


def _softmax(x: np.ndarray, own: np.ndarray | None = None) -> None:
    """In place, over the last axis. Rows need no scaling by their largest value
    where all of them keep within bounds; ``own`` are values of which each row has
    one, in place of all that may be far below."""
    rows = x.reshape(-1, x.shape[-1])
    if rows.max() > _FAR or (rows if own is None else own).min() < -_FAR:
        rows -= _top(rows)
    np.exp(rows, out=rows)
    rows /= (rows @ np.ones(rows.shape[1], dtype=rows.dtype))[:, None]


def start_weights(codes: Codes, seed: int = 11) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)

    def small(*shape):
        return (random.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    w = {
        "embed": (0.3 * random.standard_normal((LEAVES, WIDTH))).astype(np.float32),
        "query": small(WIDTH, WIDTH),
        "key": small(WIDTH, WIDTH),
        "value": small(WIDTH, WIDTH),
        "distance": np.zeros(WINDOW, dtype=np.float32),
        "mix": small(2 * WIDTH, HIDDEN),
        "mix_bias": np.zeros(HIDDEN, dtype=np.float32),
    }
    for level in range(LEVELS):
        # the last row goes with a constant input: the log of the corpus share
        mass = codes.mass.reshape(BRANCH ** (level + 1), -1).sum(axis=1).reshape(-1, BRANCH)
        share = np.log(mass / mass.sum(axis=1, keepdims=True))
        weights = 0.1 * small(len(mass), HIDDEN, BRANCH)
        w[f"level{level}"] = np.concatenate([weights, share[:, None, :]], axis=1).astype(np.float32)
    return w


def _steps(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(node, branch taken) at each level on the way to a leaf."""
    return [
        (code // BRANCH ** (LEVELS - level), code // BRANCH ** (LEVELS - 1 - level) % BRANCH)
        for level in range(LEVELS)
    ]


#: By leaf: the places of its branches among the choices of its way.
_TAKEN = np.stack([level * BRANCH + branch for level, (_, branch) in enumerate(_steps(np.arange(LEAVES)))], axis=1)
_AGO = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_EACH = np.arange(WINDOW)


def _wide(w: dict[str, np.ndarray]) -> np.ndarray:
    """The products for queries, keys and values beside each other."""
    return np.concatenate([w["query"] * np.float32(1 / np.sqrt(WIDTH)), w["key"], w["value"]], axis=1)


def _attend(
    x: np.ndarray, wide: np.ndarray, distance: np.ndarray, given: np.ndarray, end: int
) -> tuple[np.ndarray, ...]:
    """(qkv, a): queries, keys and values beside each other, and attention, of
    windows of inputs ``x``."""
    qkv = (x.reshape(-1, WIDTH) @ wide).reshape(*given.shape, 3 * WIDTH)
    a = qkv[..., :WIDTH] @ qkv[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
    a += distance
    marks = given == end
    for i in np.flatnonzero(marks[:, 1:].any(axis=1)).tolist():  # windows with parts of several texts
        text = np.cumsum(marks[i])
        a[i][text[:, None] != text] = -1e9
    _softmax(a, a[:, _EACH, _EACH])  # every row sees its own token
    return qkv, a


def _ways(w: dict[str, np.ndarray]) -> np.ndarray:
    """By node of the last level: the weights of all choices on the way there,
    beside each other."""
    last = BRANCH ** (LEVELS - 1)
    return np.concatenate([np.repeat(x, last // len(x), axis=0) for x in _levels(w)], axis=2)


def _and_one(x: np.ndarray, value: float) -> np.ndarray:
    """``x`` with one more column: 0 in the products and 1 in what is added to
    them make the constant input of the tree."""
    return np.concatenate([x, np.full_like(x[..., :1], value)], axis=-1)


def _levels(w: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [w[f"level{level}"] for level in range(LEVELS)]


def _by_way(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    """(order by leaf; for each in order the places of its branches among the
    choices of its way; blocks of about ``_SORTED`` in order, as runs first ..
    last with the same node of the last level)."""
    order = np.argsort(wanted.astype(np.uint16), kind="stable")
    leaf = wanted[order]
    taken = np.take(_TAKEN, leaf, axis=0)
    node = leaf // BRANCH
    heads = np.flatnonzero(np.diff(node, prepend=-1))
    blocks, begin = [[]], 0
    for run in zip(heads.tolist(), np.append(heads[1:], len(node)).tolist(), node[heads].tolist(), strict=True):
        if run[0] - begin >= _SORTED:
            blocks.append([])
            begin = run[0]
        blocks[-1].append(run)
    return order, taken, blocks


def _tree(
    w: dict[str, np.ndarray], z: np.ndarray, wanted: np.ndarray, out: dict[str, np.ndarray]
) -> tuple[float, np.ndarray]:
    """(loss, gradient by ``z``) of the ways to ``wanted`` from what the attention
    gives; the gradients of the weights are put in ``out``."""
    order, taken, blocks = _by_way(wanted)
    ways, mix, turned = _ways(w), _and_one(w["mix"], 0), w["mix"].T
    bias = _and_one(w["mix_bias"], 1)
    grads, dz, loss = np.zeros_like(ways), np.empty_like(z), 0.0  # dz: in order
    back = ways[:, :-1].transpose(0, 2, 1)  # the last row goes with a constant
    out["mix"], out["mix_bias"] = np.zeros_like(w["mix"]), np.zeros_like(w["mix_bias"])
    for runs in blocks if len(order) else ():
        first, last = runs[0][0], runs[-1][1]
        own, n = order[first:last], last - first
        x = np.take(z, own, axis=0)
        h = x @ mix
        h += bias
        np.maximum(h, 0, out=h)
        p, dh = np.empty((n, LEVELS * BRANCH), dtype=z.dtype), np.empty((n, HIDDEN), dtype=z.dtype)
        for i, j, m in runs:
            np.matmul(h[i - first : j - first], ways[m], out=p[i - first : j - first])
        _softmax(p.reshape(-1, BRANCH))
        flat, at = p.reshape(-1), (taken[first:last] + (np.arange(n) * LEVELS * BRANCH)[:, None]).reshape(-1)
        held = flat[at]
        loss -= np.log(held + 1e-12).sum()
        flat[at] = held - 1
        for i, j, m in runs:
            part = p[i - first : j - first]
            np.matmul(part, back[m], out=dh[i - first : j - first])
            np.matmul(h[i - first : j - first].T, part, out=grads[m])
        dh *= h[:, :-1] > 0
        out["mix"] += x.T @ dh
        out["mix_bias"] += np.ones(n, dtype=dh.dtype) @ dh
        np.matmul(dh, turned, out=dz[first:last])
    for level, x in enumerate(_levels(w)):
        part = grads[:, :, level * BRANCH : (level + 1) * BRANCH]
        out[f"level{level}"] = part.reshape(len(x), -1, *x.shape[1:]).sum(axis=1)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return float(loss), np.take(dz, place, axis=0)


def _back(
    x: np.ndarray, wide: np.ndarray, held: tuple[np.ndarray, ...], dz: np.ndarray, dwide: np.ndarray, ago: np.ndarray
) -> np.ndarray:
    """Gradient by the inputs of some windows; those of their weights are added."""
    qkv, a = held
    q, k, v = (qkv[..., i : i + WIDTH] for i in (0, WIDTH, 2 * WIDTH))
    own, dc = dz[:, :, :WIDTH], dz[:, :, WIDTH:]
    ds = dc @ v.transpose(0, 2, 1)
    ds *= a
    ds -= a * (ds.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype=ds.dtype)).reshape(*ds.shape[:2], 1)
    ago += np.ones(len(ds), dtype=ds.dtype) @ ds.reshape(len(ds), -1)
    d = np.empty_like(qkv)
    np.matmul(ds, k, out=d[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=d[..., WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dc, out=d[..., 2 * WIDTH :])
    d = d.reshape(-1, 3 * WIDTH)
    dwide += x.reshape(-1, WIDTH).T @ d
    dx = d @ wide.T
    dx += own.reshape(-1, WIDTH)
    return dx


def _summed_rows(size: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows by place."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at = at[order]
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros((size, rows.shape[1]), dtype=rows.dtype)
    out[at[heads]] = np.add.reduceat(rows[order], heads, axis=0)
    return out


def _gradients(w: dict[str, np.ndarray], tokens: np.ndarray, end: int) -> tuple[float, dict]:
    """Mean loss and gradients over windows of WINDOW + 1 codes."""
    given, wanted = tokens[:, :-1], tokens[:, 1:].reshape(-1)
    parts = [slice(i, i + MICRO) for i in range(0, len(given), MICRO)]
    wide, distance = _wide(w), np.where(_AGO >= 0, w["distance"][np.maximum(_AGO, 0)], np.float32(-1e9))
    x, held = np.take(w["embed"], given, axis=0), []
    z = np.empty((*given.shape, 2 * WIDTH), dtype=w["embed"].dtype)
    z[..., :WIDTH] = x
    for p in parts:
        qkv, a = _attend(x[p], wide, distance, given[p], end)
        np.matmul(a, qkv[..., 2 * WIDTH :], out=z[p, :, WIDTH:])
        held.append((qkv, a))
    out: dict[str, np.ndarray] = {}
    loss, dz = _tree(w, z.reshape(-1, 2 * WIDTH), wanted, out)
    dz = dz.reshape(z.shape)
    ago, dwide = np.zeros(WINDOW * WINDOW, dtype=z.dtype), np.zeros_like(wide)
    dx = np.concatenate([_back(x[p], wide, h, dz[p], dwide, ago) for p, h in zip(parts, held, strict=True)])
    out["query"], out["key"], out["value"] = np.split(dwide, 3, axis=1)
    out["query"] = out["query"] * np.float32(1 / np.sqrt(WIDTH))
    out["distance"] = np.bincount(np.maximum(_AGO, 0).reshape(-1), ago, minlength=WINDOW).astype(z.dtype)
    out["embed"] = _summed_rows(LEAVES, given.reshape(-1), dx)
    return loss / len(wanted), {name: g / np.float32(len(wanted)) for name, g in out.items()}


def blank_weights(codes: Codes) -> dict[str, np.ndarray]:
    """Weights that leave the corpus counts alone."""
    w = start_weights(codes)
    for level in range(LEVELS):
        w[f"level{level}"][:, :-1] = 0
    return w


class Fitter:
    """Steps of Adam from some weights over running codes."""

    def __init__(self, w: dict[str, np.ndarray], end: int, seed=13):
        one_thread()
        self.w, self.end = {name: x.copy() for name, x in w.items()}, end
        self.first = {name: np.zeros_like(x) for name, x in w.items()}
        self.second = {name: np.zeros_like(x) for name, x in w.items()}
        self.random, self.step = np.random.default_rng(seed), 0

    def walk(self, stream: np.ndarray, rate, passes: int = 1, turn: int = 0, turns: int = 1) -> None:
        """Fit on windows that cover the stream, ``passes`` times: each of its
        codes but the first is to be told from those before it. ``rate`` gives the
        rate after a share of the way. The way may be taken in ``turns``, by
        fitters of the same seed."""
        if len(stream) <= WINDOW:  # so short a stream is gone through again
            stream = np.resize(stream, WINDOW + 1)
        at = np.arange(0, len(stream) - WINDOW, WINDOW)
        if at[-1] + WINDOW + 1 < len(stream):
            at = np.append(at, len(stream) - WINDOW - 1)
        at = np.concatenate([self.random.permutation(at) for _ in range(passes)])
        for i in range(len(at) * turn // turns, stop := len(at) * (turn + 1) // turns, BATCH):
            windows = at[i : min(stop, i + BATCH), None] + np.arange(WINDOW + 1)
            self.adjust(stream[windows], rate(i / len(at)))

    def adjust(self, windows: np.ndarray, rate: float) -> None:
        _, grads = _gradients(self.w, windows, self.end)
        self.step += 1
        rate *= min(1.0, self.step / 50)
        for name, g in grads.items():
            first, second = self.first[name], self.second[name]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            self.w[name] -= rate * (first / (1 - 0.9**self.step)) / (np.sqrt(second / (1 - 0.99**self.step)) + 1e-6)


def rate_after(share: float) -> float:
    """Rate after a share of the whole way."""
    return RATE * (1 - 0.95 * min(1.0, share))


def passes_over(tokens: int, least: int) -> int:
    """How often a text is gone through, so that ``least`` tokens are seen."""
    return max(1, -(-least // max(1, tokens)))


def train(codes: Codes, tokens: np.ndarray, least: int = SEEN, seed: int = 13) -> dict[str, np.ndarray]:
    """Weights fitted by Adam on all of some running text (ids, each text begun
    by the end mark), until ``least`` tokens have been seen. Too little text for
    one window leaves the corpus counts alone."""
    stream = codes.code[tokens]
    if len(stream) < WINDOW + 2:
        return blank_weights(codes)
    fitter = Fitter(start_weights(codes), int(codes.code[codes.end]), seed)
    fitter.walk(stream, rate_after, passes_over(len(stream), least))
    return fitter.w


class Scorer:
    """Log probabilities of texts given as ids."""

    def __init__(self, codes: Codes, w: dict[str, np.ndarray]):
        self.codes, self.w = codes, w
        scale = np.float32(1 / np.sqrt(WIDTH))
        self.query = w["embed"] @ w["query"] * scale  # by code, made once
        self.key, self.value = w["embed"] @ w["key"], w["embed"] @ w["value"]
        self.mix = _and_one(w["mix"], 0)
        self.direct = w["embed"] @ self.mix[:WIDTH] + _and_one(w["mix_bias"], 1)
        self.ways = _ways(w)
        ago = (WINDOW - SCORED + np.arange(SCORED))[:, None] - np.arange(WINDOW)
        self.bias = np.where(ago >= 0, w["distance"][np.maximum(ago, 0)], np.float32(-1e9)).astype(np.float32)

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each text ids[first[i]:first[i + 1]] and
        its end. Every token is scored once, in the window that ends with it and
        at most SCORED - 1 others; what stands further back gives context.

        The texts are laid out in blocks of SCORED tokens, each text from a new
        block on: a window is a block, with what stands before it."""
        one_thread()
        size = np.diff(first)
        blocks = size // SCORED + 1
        begin = np.concatenate([[0], np.cumsum(blocks)])
        at = np.repeat(begin[:-1] * SCORED - first[:-1] + first[0], size) + np.arange(first[-1] - first[0])
        n = int(begin[-1]) * SCORED
        given = np.full(WINDOW - SCORED + n, self.codes.code[self.codes.end], dtype=np.int64)
        body = ids[first[0] : first[-1]]
        given[WINDOW - SCORED + 1 + at] = self.codes.code[body]  # each text is begun by the end mark
        wanted = np.full(n, self.codes.end, dtype=np.int64)
        wanted[at] = body
        live = np.zeros(n, dtype=bool)
        live[at] = True
        live[begin[:-1] * SCORED + size] = True
        out = np.zeros(n, dtype=np.float32)
        step = max(1, _AT_ONCE // SCORED)
        for i in range(0, int(begin[-1]), step):
            j = min(i + step, int(begin[-1]))
            heads = begin[np.searchsorted(begin, i) : np.searchsorted(begin, j)] - i
            part = slice(i * SCORED, j * SCORED)
            goal = np.flatnonzero(live[part])
            want = wanted[part][goal]
            logs = self._windows(given[i * SCORED : j * SCORED + WINDOW - SCORED], heads, goal, self.codes.code[want])
            out[part][goal] = logs + self.codes.share[want]
        sums = np.concatenate([[0.0], np.cumsum(out, dtype=np.float64)])
        return sums[begin[1:] * SCORED] - sums[begin[:-1] * SCORED]

    def _windows(self, code: np.ndarray, heads: np.ndarray, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Log probability of the codes ``goal`` after the places ``at`` of blocks
        of running codes, begun by what stands before; ``heads`` begin a text."""
        key, value = (
            np.lib.stride_tricks.sliding_window_view(np.take(x, code, axis=0), WINDOW, axis=0)[::SCORED]
            for x in (self.key, self.value)
        )  # by block: number by place
        code = code[WINDOW - SCORED :]
        a = np.take(self.query, code, axis=0).reshape(-1, SCORED, WIDTH) @ key
        a += self.bias
        a[heads, :, : WINDOW - SCORED] = -1e9  # there stands another text
        # every row sees its own token: where that keeps within bounds, the
        # exponentials need no scaling by the largest value of the row
        if a.max() > _FAR or a[:, _OWN, _OWN + WINDOW - SCORED].min() < -_FAR:
            a -= _top(a)
        np.exp(a, out=a)
        total = a @ np.ones(WINDOW, dtype=np.float32)
        context = a @ value.transpose(0, 2, 1)
        context /= total[:, :, None]
        context, mix = context.reshape(-1, WIDTH), self.mix[WIDTH:]
        order, taken, blocks = _by_way(goal)
        out = np.empty(len(goal), dtype=np.float32)
        for runs in blocks if len(order) else ():
            first, last = runs[0][0], runs[-1][1]
            own, n = at[order[first:last]], last - first
            h = np.take(context, own, axis=0) @ mix
            h += np.take(self.direct, code[own], axis=0)
            np.maximum(h, 0, out=h)
            logits = np.empty((n, LEVELS * BRANCH), dtype=np.float32)
            for i, j, m in runs:
                np.matmul(h[i - first : j - first], self.ways[m], out=logits[i - first : j - first])
            chosen = logits.reshape(-1)[taken[first:last] + (np.arange(n) * LEVELS * BRANCH)[:, None]]
            chosen -= _log_sum(logits.reshape(-1, BRANCH)).reshape(n, LEVELS)
            out[order[first:last]] = chosen @ np.ones(LEVELS, dtype=np.float32)
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials by row; ``x`` is used up."""
    ones, top = np.ones(x.shape[1], dtype=x.dtype), 0
    if x.max() > _FAR or x.min() < -_FAR:
        top = _top(x)
        x -= top
        top = top[:, 0]
    np.exp(x, out=x)
    return np.log(x @ ones) + top
