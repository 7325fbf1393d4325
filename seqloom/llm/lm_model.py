"""The language model of ``lm_score``: counts of subword ids inside words as a prior, causal self-attention as its correction.

A text is a sequence of words, each a sequence of byte-level BPE ids whose first begins with a space, and one end. The prior knows
an id by what stands before it in its word: by the whole word so far, its last two ids, its last id, or nothing, each interpolated
with the next shorter one (weighted by how many different ids follow, and by what the bounded table left out). Ids that start a
word have the prior of all starts. Ids belong to classes; the attention reads the last ids of the text across words and corrects the log
probabilities of the classes, which the softmax puts to sum one. An id's probability is that of its class times that of the id in
the class by the prior. With attention that says nothing the model is the prior.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np

START_CLUSTERS, REST_CLUSTERS = 16, 8
WIDTH, HIDDEN = 16, 16
#: Ids in a window, and how many of them are context only; each id is scored once, with at least ``OVERLAP`` ids before it.
SPAN, OVERLAP = 48, 16
LIVE = SPAN - OVERLAP
#: Ids with an embedding of their own (by remainder).
OWN = 2048
STEPS, BATCH, RATE = 300, 64, 0.01
#: How much each different id that follows a context counts for the shorter context.
FOLLOWERS = 3.0
#: Windows scored together, words in each of the two generations of a worker's cache.
TOGETHER, CACHE_WORDS = 128, 120_000

#: Frequent ids whose neighbourhood tells classes apart, and how far they stand.
MET, DISTANCES = 256, (1, 2, 3, 5, 8)
#: Classes: starts (clusters, then those of no cluster), the end, the rest (alike).
END_CLASS = START_CLUSTERS + 1
FIRST_REST = END_CLASS + 1
RESTS = REST_CLUSTERS + 1
CLASSES = FIRST_REST + RESTS
#: What a worker knows of an id: itself, its class, its log probability in the class, and the log probabilities of a word's end and
#: of the classes of the rest behind it. numpy gathers items of 32 bytes fastest.
RECORD = np.dtype([("id", "<u2"), ("cls", "u1"), ("pad", "u1", (5,)), ("within", "<f4"), ("after", "<f2", (1 + RESTS,))])
#: All numbers of 16 bits as floats, as looking them up is faster than numpy's conversion.
HALVES = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)


def joined(records: list[np.ndarray]) -> np.ndarray:
    """Arrays of ``RECORD`` one behind the other; numpy copies what has no fields much faster."""
    return np.concatenate([x.view(_PLAIN) for x in records]).view(RECORD)


_PLAIN = np.dtype((np.void, RECORD.itemsize))
_encoders: dict[str, object] = {}
_starts: dict[str, np.ndarray] = {}
#: Words encoded together.
JOINED = 512


def subwords(path: str):
    """The byte-level BPE of a rank file, one for each process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def starts_of(path: str) -> np.ndarray:
    """Which ids begin with a space; the end, the last, doesn't."""
    if path not in _starts:
        encoder = subwords(path)
        _starts[path] = np.array([encoder.decode_single_token_bytes(i)[:1] == b" " for i in range(encoder.n_vocab)] + [False])
    return _starts[path]


def coded(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each with a space before it, one behind the other, and the words' sizes.

    Words without whitespace of their own are encoded together: a space always goes to the piece behind it, so the ids are those of
    single words, and only a word's first id begins with a space.
    """
    one = subwords(path).encode_ordinary
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), JOINED):
        part = words[at : at + JOINED]
        joined = b" ".join(part).decode("utf-8", "replace")
        plain = joined.split()
        if len(plain) == len(part) and plain == joined.split(" "):
            ids.append(np.array(one(" " + joined), np.int64))
            sizes.append(np.diff(np.append(np.flatnonzero(starts_of(path).take(ids[-1])), len(ids[-1]))))
        else:
            single = [one(" " + w.decode("utf-8", "replace")) for w in part]
            ids.append(np.array([*chain.from_iterable(single)], np.int64))
            sizes.append(np.array([*map(len, single)], np.int64))
    return np.concatenate(ids), np.concatenate(sizes)


def encode(words: list[bytes], path: str) -> list[list[int]]:
    """Ids of each word, see ``coded``."""
    ids, sizes = coded(words, path)
    flat, ends = ids.tolist(), [0, *np.cumsum(sizes).tolist()]
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


# The prior


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Flat:
    """Words in one array of ids: length, place in the word, next id (``end`` behind the last) and the three contexts of each id.

    The words are lists of ids or what ``coded`` gives.
    """

    def __init__(self, words: list[list[int]] | tuple[np.ndarray, np.ndarray], end: int) -> None:
        if isinstance(words, tuple):
            self.ids, self.sizes = words
        else:
            self.sizes = np.fromiter(map(len, words), np.int64, len(words))
            self.ids = np.fromiter(chain.from_iterable(words), np.int64, self.sizes.sum())
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.ids)) - self.offsets[self.owner]
        self.last = self.place == self.sizes[self.owner] - 1
        self.next = np.where(self.last, end, np.append(self.ids[1:], end))
        with np.errstate(over="ignore"):
            one = (self.ids + 1).astype(np.uint64)
            before = np.where(self.place > 0, np.append([0], self.ids[:-1]) + 1 if len(self.ids) else self.ids, 0).astype(np.uint64)
            powers = np.cumprod(np.full(int(self.place.max(initial=0)) + 1, 0xD1342543DE82EF95, np.uint64))
            summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * powers[self.place])])
            prefix = summed[1:] - summed[self.offsets[self.owner]]
            self.contexts = [_mix(one), _mix(one + (before << np.uint64(20))), _mix(prefix + np.uint64(7 << 50))]
        # where a context is the same as the one before, it isn't asked again
        self.asked = [np.full(len(self.ids), True), self.place >= 1, self.place >= 2]


def event(context: np.ndarray, following: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(context + (following.astype(np.uint64) << np.uint64(40)) + following.astype(np.uint64))


def gram_counts(words: list[list[int]], n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, following id and count of what stands in words that occur ``n`` times each; the context 0 has the ids at a word's start, 1 all others."""
    flat = Flat(words, end)
    weight = n[flat.owner]
    first = flat.place == 0
    context = [np.zeros(first.sum(), np.uint64), np.ones((~first).sum() + len(words), np.uint64)]
    following = [flat.ids[first], np.concatenate([flat.ids[~first], np.full(len(words), end)])]
    counts = [weight[first], np.concatenate([weight[~first], n])]
    for c, asked in zip(flat.contexts, flat.asked, strict=True):
        context.append(c[asked])
        following.append(flat.next[asked])
        counts.append(weight[asked])
    context, following, counts = np.concatenate(context), np.concatenate(following), np.concatenate(counts)
    order = np.lexsort((following, context))
    context, following, counts = context[order], following[order], counts[order]
    new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (following[1:] != following[:-1]))) if len(context) else np.zeros(0, int)
    return context[new], following[new], np.add.reduceat(counts, new) if len(new) else counts


class Places:
    """Where numbers stand in an array of different ones: a hash table with open addresses, asked for many at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self.slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several for a slot one stays
            wait = self.table[slot] != left
            left, slot = left[wait], (slot[wait] + 1) & self.mask

    def slots(self, asked: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((asked * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each asked number, and whether it is there (else the place says nothing)."""
        if not len(self.keys):
            return np.zeros(len(asked), int), np.zeros(len(asked), bool)
        slot = self.slots(asked)
        at = self.table[slot]
        there = (self.keys[at] == asked) & (at >= 0)
        left = np.flatnonzero(~there & (at >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            found = self.table[slot]
            same = (self.keys[found] == asked[left]) & (found >= 0)
            at[left[same]], there[left[same]] = found[same], True
            more = ~same & (found >= 0)
            left, slot = left[more], slot[more]
        return at, there


class Prior:
    """Log probabilities by counts. ``starts``: which ids start a word; ``label``: the class of each id; ``texts``: number of texts.

    ``singles`` has the counts of ids at a word's start and elsewhere (the end's: of words); ``contexts`` are (context, all, different,
    following ids, their counts) of a bounded table: all and different tell what follows in the corpus, the ids only what was kept.
    """

    def __init__(self, starts: np.ndarray, label: np.ndarray, texts: int, singles: tuple[np.ndarray, np.ndarray], contexts: list[tuple]) -> None:
        self.label, self.end = label, len(label) - 1
        at_start = np.where(starts, singles[0] + 1.0, 0.0)
        at_start[self.end] = texts + 1.0
        rest = np.where(starts, 0.0, singles[1] + 1.0)  # the end counts the words that end
        by_class = np.bincount(label, weights=at_start, minlength=CLASSES)
        with np.errstate(divide="ignore", invalid="ignore"):  # ids and classes that start no word
            self.start_within = np.log(at_start / by_class[label])
            self.start_class = np.log(by_class[:FIRST_REST] / by_class[:FIRST_REST].sum())
        self.start_class[~np.isfinite(self.start_class)] = -1e4
        self.single = rest / rest.sum()
        #: Of an id that doesn't start a word, or of a word's end: 0 for the end.
        self.kind = np.where(np.arange(len(label)) == self.end, 0, label - FIRST_REST + 1).clip(0)
        self.kinds = np.bincount(self.kind[~starts], weights=self.single[~starts], minlength=1 + RESTS)
        order = np.argsort(np.array([c[0] for c in contexts], np.uint64), kind="stable")
        contexts = [contexts[i] for i in order]
        self.context = np.array([c[0] for c in contexts], np.uint64)
        sizes = np.array([len(c[3]) for c in contexts], int)
        following = np.concatenate([np.zeros(0, int), *(np.asarray(c[3], int) for c in contexts)])
        n = np.concatenate([np.zeros(0), *(np.asarray(c[4], float) for c in contexts)])
        owner = np.repeat(np.arange(len(contexts)), sizes)
        kept = np.bincount(owner, weights=n, minlength=len(contexts))
        self.back = np.array([c[1] - k + FOLLOWERS * c[2] for c, k in zip(contexts, kept, strict=True)], np.float32)
        self.total = (kept + self.back).astype(np.float32)
        self.by_kind = np.zeros((len(contexts), 1 + RESTS), np.float32)
        np.add.at(self.by_kind, (owner, self.kind[following]), n)
        keys = event(self.context[owner], following)
        order = np.argsort(keys, kind="stable")
        self.events, self.counts = keys[order], n[order].astype(np.float32)
        self.places: tuple[Places, Places] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"places": None}  # each process makes its own

    def records(self, words: list[list[int]]) -> list[bytes]:
        """``RECORD`` of each id of each word, as bytes."""
        out, offsets = self.flat_records(words)
        data, ends = out.tobytes(), (offsets * RECORD.itemsize).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def flat_records(self, words: list[list[int]] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``RECORD`` of each id of all words, and where each word begins and the last ends."""
        flat = Flat(words, self.end)
        if self.places is None:
            self.places = Places(self.context), Places(self.events)
        of_context, of_event = self.places
        kinds = np.repeat(self.kinds.astype(np.float32)[None], len(flat.ids), axis=0)
        p = self.single[flat.next]
        for context, asked in zip(flat.contexts, flat.asked, strict=True):
            own = np.flatnonzero(asked)
            at, known = of_context.find(context[own])
            own, at = own[known], at[known]
            back, total = self.back[at], self.total[at]
            where, there = of_event.find(event(context[own], flat.next[own]))
            p[own] = (np.where(there, self.counts[where], 0) + back * p[own]) / total
            mixed = kinds.take(own, axis=0)
            mixed *= back[:, None]
            mixed += self.by_kind.take(at, axis=0)
            mixed /= total[:, None]
            kinds[own] = mixed
        out = np.zeros(len(flat.ids), RECORD)
        out["id"], out["cls"] = flat.ids, self.label[flat.ids]
        inside = np.flatnonzero(~flat.last)
        out["within"] = self.start_within[flat.ids]
        out["within"][inside + 1] = np.log(p[inside] / kinds[inside, self.kind[flat.next[inside]]])
        out["after"] = np.log(np.maximum(kinds, 1e-12))
        return out, flat.offsets

    def end_record(self) -> bytes:
        out = np.zeros(1, RECORD)
        out["id"], out["cls"] = self.end, END_CLASS
        return out.tobytes()


# The attention


def most_met(counts: np.ndarray) -> np.ndarray:
    """The ids whose neighbours tell classes apart."""
    return np.argsort(-counts, kind="stable")[:MET]


class Neighbours:
    """How often each id has each of the ids ``top`` at one of ``DISTANCES`` before or behind it in a text; ``size`` ids with the end."""

    def __init__(self, top: np.ndarray, size: int) -> None:
        self.end = size - 1
        self.place = np.full(size, MET)
        self.place[top] = np.arange(len(top))
        self.cells = np.zeros(size * MET, np.int32)
        self.pairs = 0  # with any id beside

    def add(self, texts: list[np.ndarray]) -> None:
        gap = np.full(DISTANCES[-1], self.end)  # texts aren't neighbours; what the end gets isn't kept
        ids = np.concatenate([x for t in texts for x in (gap, t)] + [gap]).astype(np.int64)
        place = self.place[ids]
        at = np.flatnonzero(place < MET)
        place = place[at]
        for k in DISTANCES:
            for beside in (at - k, at + k):
                np.add.at(self.cells, ids[beside] * MET + place, np.int32(1))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.pairs += 2 * sum(int(np.maximum(sizes - k, 0).sum()) for k in DISTANCES)

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Id, place in ``top`` and count of what was met, and the number of pairs; begins anew."""
        cell = np.flatnonzero(self.cells[: self.end * MET])
        out = cell // MET, cell % MET, self.cells[cell], self.pairs
        self.cells[:] = 0
        self.pairs = 0
        return out


def classes(texts: list[np.ndarray], starts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id by its neighbours in ``texts``, see ``clusters``."""
    size = len(starts)
    counts = np.bincount(np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), minlength=size)
    met = Neighbours(most_met(counts), size)
    met.add(texts)
    around = np.zeros((size, MET), np.float32)
    own, place, n, pairs = met.taken()
    around[own, place] = n
    return clusters(around, pairs, counts, starts, rng)


def clusters(around: np.ndarray, pairs: int, counts: np.ndarray, starts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id: k-means over the frequent ids ``around`` it, apart for ids that start a word and others."""
    size = len(starts)
    label = np.where(starts, START_CLUSTERS, CLASSES - 1)
    expected = ((around.sum(axis=0, dtype=np.float64) + 1) / (pairs + 1)).astype(np.float32)
    for own, first, k in ((starts, 0, START_CLUSTERS), (~starts, FIRST_REST, REST_CLUSTERS)):
        seen = np.flatnonzero((counts >= 5) & own & (np.arange(size) < size - 1))
        if len(seen) <= k:
            continue
        x = around[seen] + np.float32(0.1)
        x /= x.sum(axis=1, keepdims=True)
        x /= expected
        np.log(x, out=x)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        centres = x[rng.choice(len(x), k, replace=False, p=counts[seen] / counts[seen].sum())]
        for _ in range(15):
            near = (x @ centres.T).argmax(axis=1)
            for c in range(k):
                if (near == c).any():
                    m = np.average(x[near == c], axis=0, weights=counts[seen][near == c])
                    centres[c] = m / (np.linalg.norm(m) + 1e-9)
        label[seen] = first + (x @ centres.T).argmax(axis=1)
    label[size - 1] = END_CLASS
    return label


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = WIDTH
    shapes = {"cls": (CLASSES + 1, d), "own": (OWN + 1, d), "pos": (SPAN, d), "q": (d, d), "kv": (d, 2 * d), "out": (d, d), "w1": (d, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, d), "top": (d, CLASSES), "bias": (CLASSES,)}
    return {k: (rng.normal(0, 0.1 if k in ("cls", "own", "pos") else 0.3 / np.sqrt(s[0]), s) * (k not in ("b1", "bias", "top"))).astype(np.float32) for k, s in shapes.items()}


#: Which places of a window each of its last ``LIVE`` sees: those up to its own.
_SEEN = np.tri(LIVE, SPAN, OVERLAP, dtype=np.float32)
#: Where the numbers of each own embedding stand.
_CELLS = np.arange((OWN + 1) * WIDTH).reshape(OWN + 1, WIDTH)
_ALL = np.ones(SPAN, np.float32)
#: Scores of attention are held within this range, so weights neither overflow nor vanish all together.
BOUND = np.float32(30)


def folded(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Queries with keys, and values with what they become: as products, they save the keys and values of all places."""
    return p["q"] @ p["kv"][:, :WIDTH].T * np.float32(WIDTH**-0.5), p["kv"][:, WIDTH:] @ p["out"]


def forward(p: dict[str, np.ndarray], x: np.ndarray, prior: np.ndarray):
    """Logits (classes, windows * LIVE) of what follows each live place, and what led to them.

    ``x`` (windows, SPAN, WIDTH) has the inputs, an id behind, and is changed; ``prior`` (windows * LIVE, classes) the log probabilities that the
    attention corrects. Weights of attention are not divided by their sum; what they gather is.
    """
    n = len(x)
    x += p["pos"]
    own = np.ascontiguousarray(x[:, OVERLAP:]).reshape(-1, WIDTH)
    ask, give = folded(p)
    q = (own @ ask).reshape(n, LIVE, WIDTH)
    a = np.matmul(q, x.transpose(0, 2, 1))
    held = None
    if a.size and max(a.max(), -a.min()) >= BOUND:
        held = np.abs(a) < BOUND
        np.clip(a, -BOUND, BOUND, out=a)
    np.exp(a, out=a)
    a *= _SEEN
    share = 1 / (a.reshape(-1, SPAN) @ _ALL.astype(a.dtype))
    m = np.matmul(a, x).reshape(-1, WIDTH)
    m *= share[:, None]
    y = own + m @ give
    h = y @ p["w1"]
    h += p["b1"]
    np.maximum(h, 0, out=h)
    z = h @ p["w2"]
    z += y
    g = np.ascontiguousarray(p["top"].T) @ z.T
    g += p["bias"][:, None]
    g += prior.T
    return g, (x, own, q, a, held, share, m, y, h, z, ask, give)


def log_share(g: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each goal class, and the probabilities of all (classes, places); overwrites ``g``."""
    g -= g.max(axis=0)
    own = g.take(goal * g.shape[1] + np.arange(g.shape[1]))
    np.exp(g, out=g)
    total = g.sum(axis=0)
    g /= total
    return own - np.log(total), g


def gradients(p: dict[str, np.ndarray], c: np.ndarray, o: np.ndarray, prior: np.ndarray, goal: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over live places, and its gradient for every parameter; c and o are classes and own numbers of the inputs."""
    x = p["own"].take(o, axis=0)
    x += p["cls"].take(c, axis=0)
    g, (x, own, q, a, held, share, m, y, h, z, ask, give) = forward(p, x, prior)
    n, goal = len(c), goal.reshape(-1)
    w = (live / max(1, live.sum())).reshape(-1).astype(np.float32)
    logp, dg = log_share(g, goal)
    loss = -float((logp * w).sum())
    dg.reshape(-1)[goal * len(goal) + np.arange(len(goal))] -= 1
    dg *= w
    ones = np.ones(len(goal), x.dtype)  # products sum columns faster
    d = {"top": (dg @ z).T, "bias": dg.sum(axis=1)}
    dz = dg.T @ np.ascontiguousarray(p["top"].T)
    d["w2"] = h.T @ dz
    dh = dz @ np.ascontiguousarray(p["w2"].T)
    dh *= h > 0
    d["w1"], d["b1"] = y.T @ dh, ones @ dh
    dy = dz
    dy += dh @ np.ascontiguousarray(p["w1"].T)
    dgive = m.T @ dy
    d["out"] = p["kv"][:, WIDTH:].T @ dgive
    dm = dy @ np.ascontiguousarray(give.T)
    dm *= share[:, None]
    off = np.einsum("ij,ij->i", dm, m)  # what the division by the sum takes off
    dm = dm.reshape(n, LIVE, WIDTH)
    ds = np.matmul(dm, x.transpose(0, 2, 1))
    ds -= off.reshape(n, LIVE, 1)
    ds *= a
    if held is not None:
        ds *= held
    dx = np.matmul(ds.transpose(0, 2, 1), q)
    dx += np.matmul(a.transpose(0, 2, 1), dm)
    dq = np.matmul(ds, x).reshape(-1, WIDTH)
    dask = own.T @ dq * np.float32(WIDTH**-0.5)
    d["q"] = dask @ p["kv"][:, :WIDTH]
    d["kv"] = np.concatenate([dask.T @ p["q"], dgive @ p["out"].T], axis=1)
    dy += dq @ np.ascontiguousarray(ask.T)
    dx[:, OVERLAP:] += dy.reshape(n, LIVE, WIDTH)
    d["pos"] = dx.sum(axis=0)
    dx = dx.reshape(-1, WIDTH)
    d["cls"] = np.eye(len(p["cls"]), dtype=dx.dtype).take(c.reshape(-1), axis=0).T @ dx
    d["own"] = np.zeros(p["own"].shape, dx.dtype)
    np.add.at(d["own"].reshape(-1), _CELLS.take(o.reshape(-1), axis=0).reshape(-1), dx.reshape(-1))
    return loss, d


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the texts (arrays of ``RECORD``): place of the first input, number of live places to the text's end, the text.

    Places count in the texts set one behind the other, each with ``OVERLAP`` + 1 places for nothing before it.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // LIVE))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = (np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]) * LIVE
    offsets = np.cumsum(sizes + OVERLAP + 1) - sizes - OVERLAP - 1
    return offsets[owner] + first, sizes[owner] - first, owner


def layout(texts: list[np.ndarray]):
    """For all ``windows`` of the texts: places of inputs, of goals, live places, and the text of each window."""
    start, left, owner = windows(texts)
    before = start[:, None] + np.arange(SPAN)
    return before, before[:, OVERLAP:] + 1, np.arange(LIVE) < left[:, None], owner


class Model:
    def __init__(self, prior: Prior, p: dict[str, np.ndarray]) -> None:
        self.prior, self.p = prior, p
        self.ready: dict[str, np.ndarray] | None = None
        self.windows = 0  # seen where the texts lie

    def spread(self, texts: list[np.ndarray]):
        """The texts as ``windows`` places them: ids with one number more for nothing, classes, log probabilities in the class, priors of classes.

        Views that have a window from each place on: of ids ``SPAN`` long, of the others ``LIVE``; that of priors begins with the kind and
        has the numbers for ``HALVES``.
        """
        none = np.zeros(OVERLAP + 1, RECORD)
        none["id"], none["cls"] = self.prior.end, END_CLASS
        none["after"][:, 1:] = -20  # a text begins with a word
        flat = joined([x for t in texts for x in (none, t)] + [np.repeat(none[:1], SPAN)])
        ids = flat["id"].astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes + OVERLAP + 1) - sizes - OVERLAP - 1
        ids[(begins[:, None] + np.arange(OVERLAP + 1)).reshape(-1)] += 1
        after = np.ascontiguousarray(flat["after"].view(np.uint16).T)
        view = np.lib.stride_tricks.sliding_window_view
        return view(ids, SPAN), view(flat["cls"].astype(np.int64), LIVE), view(np.ascontiguousarray(flat["within"]), LIVE), view(after, LIVE, axis=1)

    def classes_prior(self, after: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes (places, classes) from what is known behind ids (kinds, places); columns are contiguous."""
        out = np.empty((CLASSES, after.shape[1]), np.float32)
        np.add(after[0], self.prior.start_class.astype(np.float32)[:, None], out=out[:FIRST_REST])
        out[FIRST_REST:] = after[1:]
        return out.T

    def prepared(self) -> dict[str, np.ndarray]:
        """The parameters as ``log_classes`` uses them, made once training is over."""
        if self.ready is None:
            p, size = self.p, len(self.prior.label)
            self.ready = {
                "inputs": p["cls"][np.append(self.prior.label, CLASSES)] + p["own"][np.append(np.arange(size) % OWN, OWN)],
                "ask": folded(p)[0],
                "give": folded(p)[1],
                "top": np.ascontiguousarray(p["top"].T),
                "bias": (p["bias"] + np.append(self.prior.start_class, np.zeros(RESTS))).astype(np.float32)[:, None],
            }
        return self.ready

    def log_classes(self, ids: np.ndarray, after: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Log probability of the class of each live place: what ``forward`` gives, with the classes as rows and sums from products."""
        p, r, n = self.p, self.prepared(), len(ids)
        x = r["inputs"].take(ids, axis=0)
        x += p["pos"]
        own = np.ascontiguousarray(x[:, OVERLAP:]).reshape(-1, WIDTH)
        a = np.matmul((own @ r["ask"]).reshape(n, LIVE, WIDTH), x.transpose(0, 2, 1))
        np.clip(a, -BOUND, BOUND, out=a)
        np.exp(a, out=a)
        a *= _SEEN
        m = np.matmul(a, x).reshape(-1, WIDTH)
        m /= (a.reshape(-1, SPAN) @ _ALL)[:, None]
        own += m @ r["give"]
        h = own @ p["w1"]
        h += p["b1"]
        np.maximum(h, 0, out=h)
        own += h @ p["w2"]
        g = r["top"] @ own.T
        g += r["bias"]
        g[:FIRST_REST] += after[0]
        g[FIRST_REST:] += after[1:]
        g -= g.max(axis=0)
        goal = g.take(cls * len(cls) + np.arange(len(cls)))
        np.exp(g, out=g)
        return goal - np.log(g.sum(axis=0))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text (an array of ``RECORD`` with the end)."""
        ids, cls, within, after = self.spread(texts)
        start, left, owner = windows(texts)
        out = np.zeros(len(texts))
        for at in range(0, len(start), TOGETHER):
            begin = start[at : at + TOGETHER]
            goal = begin + OVERLAP + 1
            logp = self.log_classes(ids[begin], HALVES[after[:, goal - 1].reshape(1 + RESTS, -1)], cls[goal].reshape(-1)).reshape(-1, LIVE)
            logp += within[goal]
            logp[np.arange(LIVE) >= left[at : at + TOGETHER, None]] = 0
            out += np.bincount(owner[at : at + TOGETHER], weights=logp.sum(axis=1, dtype=np.float64), minlength=len(texts))
        return out / np.log(10)

    def fit(self, texts: list[np.ndarray], rng: np.random.Generator, steps: int | None = None, rate: float = RATE) -> int:
        """Adam over windows of the texts, ``steps`` drawn batches or else each window once; gives the number of windows seen."""
        self.ready = None
        if not texts:
            return 0
        ids, cls, _, after = self.spread(texts)
        start, left, _ = windows(texts)
        c_of, o_of = np.append(self.prior.label, CLASSES), np.append(np.arange(len(self.prior.label)) % OWN, OWN)
        order = rng.permutation(len(start))
        rounds = -(-len(start) // BATCH) if steps is None else steps
        names = sorted(self.p)
        every = np.concatenate([self.p[k].reshape(-1) for k in names])  # all parameters, which self.p shows by name
        ends = np.cumsum([self.p[k].size for k in names])[:-1]
        self.p = {k: x.reshape(self.p[k].shape) for k, x in zip(names, np.split(every, ends), strict=True)}
        m1, m2 = np.zeros_like(every), np.zeros_like(every)
        for step in range(1, rounds + 1):
            pick = order[(step - 1) * BATCH : step * BATCH] if steps is None else rng.integers(0, len(start), BATCH)
            b, goal = ids[start[pick]], start[pick] + OVERLAP + 1
            prior = self.classes_prior(HALVES[after[:, goal - 1].reshape(1 + RESTS, -1)])
            _, of = gradients(self.p, c_of.take(b), o_of.take(b), prior, cls[goal], np.arange(LIVE) < left[pick, None])
            d = np.concatenate([of[k].reshape(-1) for k in names])
            now = rate * min(1, 2 * (1 - step / (rounds + 1)))
            change = d * d
            change -= m2
            change *= 0.01
            m2 += change
            d -= m1
            d *= 0.1
            m1 += d
            np.sqrt(m2, out=change)
            change *= (1 - 0.99**step) ** -0.5
            change += 1e-8
            np.divide(m1, change, out=change)
            change *= now / (1 - 0.9**step)
            every -= change
        return len(start)
