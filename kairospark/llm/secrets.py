"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans to them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import slices, strings, utf8
from kairospark.llm.hashing import word_hashes, word_spans

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Parts of words that stand before secrets, lower case.
CUES = re.compile(rb"passw|secret|token|credential|bearer|pwd|auth|key")

Model = tuple[np.ndarray, np.ndarray]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in code points; leftmost, not overlapping within a kind, too short ones dropped."""
    out, lower = [], text.lower()
    if "pass" in lower or "secret" in lower or "token" in lower or "key" in lower:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# ---- tokens and their features -------------------------------------------------------------------------------------
# A token is a run of ASCII letters, digits, + / _ - or any byte above ASCII. Byte classes: 1 lower case, 2 a to f, 3 upper case, 4 digit, 5 above ASCII, 6 mark.
_CLASS = np.zeros(256, np.int8)
_CLASS[0x80:] = 5
for _chars, _k in (("ghijklmnopqrstuvwxyz", 1), ("abcdef", 2), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), ("0123456789", 4), ("+/_-", 6)):
    _CLASS[list(_chars.encode())] = _k
_SOLID = _CLASS > 0
_SORT = np.array([0, 1, 1, 2, 3, 4, 5], np.int8)  # for switches: the two lower-case classes are one
_VOWEL = np.zeros(256, np.int8)
_VOWEL[list(b"aeiouyAEIOUY")] = 1
_LENGTHS = np.array([3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 40, 64])
_MAKES, _CUE_STEPS = 12, 5
# Kinds of the characters beside a token; 0 is white space or an end, and the last is any other.
_BESIDE = np.full(256, 12, np.int8)
_BESIDE[[0x20, *range(0x09, 0x0E), 0]] = 0
for _k, _c in enumerate("./:@#(=\"'&,", 1):
    _BESIDE[ord(_c)] = _k
#: Flags of the run between white space that a token is in: a scheme, an @, slashes, a dot, colons, a question mark or ampersand, an equals sign, a number sign.
_FLAGS = 8
_WORDS = 128
_RUNS, _DENSE, _MARKS, _LETTER_RUNS, _DIGIT_RUNS = 7, 6, 5, 6, 6
#: Sizes of the feature groups: length, make-up, digits' share, switches between kinds of characters, vowels' share, cue before, mark before, quotes, joined to the last, make-up of the word before and after, the file's digits and cues, and pairs: length and make-up, cue and make-up, cue and length, make-up and vowels' share; the longest run of consonants, of letters and of digits, switches a character, marks inside, each with the length; the characters before and after; the flags of the surrounding run, alone, with the make-up and with the cue; the word before, hashed.
_SIZES = (
    len(_LENGTHS) + 1, _MAKES, 6, 6, 7, _CUE_STEPS, 3, 4, 3, _MAKES + 1, _MAKES + 1, 4, 3, (len(_LENGTHS) + 1) * _MAKES, _CUE_STEPS * _MAKES, _CUE_STEPS * (len(_LENGTHS) + 1), _MAKES * 7,
    _RUNS * (len(_LENGTHS) + 1), _LETTER_RUNS * (len(_LENGTHS) + 1), _DIGIT_RUNS * (len(_LENGTHS) + 1), _DENSE * (len(_LENGTHS) + 1), _MARKS * (len(_LENGTHS) + 1), _RUNS * _DENSE, 13, 13, 1 << _FLAGS, (1 << _FLAGS) * _MAKES, (1 << _FLAGS) * _CUE_STEPS, _WORDS + 1,
)
_AT = np.cumsum([0, *_SIZES])
N_FEATURES = int(_AT[-1])
#: Tokens whose features are held at once, and how far a token's features look.
_CHUNK, _NEAR = 1 << 17, 3


def _makeup(size: np.ndarray, counts: dict[int, np.ndarray], first: np.ndarray) -> np.ndarray:
    """What each token is made of, as one of _MAKES kinds."""
    low, hexa, up, dig, far, sym = (counts[k] for k in (1, 2, 3, 4, 5, 6))
    small = low + hexa
    return np.select(
        [far > 0, (sym > 0) & (dig == 0) & (up == 0), sym > 0, dig == size, (dig > 0) & (dig + hexa == size), (dig > 0) & (dig + up == size), (dig > 0) & (up > 0) & (small > 0), dig > 0, small == size, up == size, (up == 1) & (first == 3)],
        range(11),
        11,
    )


class Tokens:
    """The tokens of a string column: where each starts and ends, where each row's begin, and what whole rows have: their digits and cues."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.start, self.end, self.first = word_spans(data, offsets, _SOLID)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        lower = data.copy()
        upper = _CLASS[data] == 3
        lower[upper] += 32
        at = np.array([m.start() for m in CUES.finditer(lower.tobytes())], np.int64)
        where = np.searchsorted(self.start, at, "right") - 1
        self.cue = np.zeros(len(self.start), bool)
        self.cue[where[at < self.end[where]] if len(at) and len(self.start) else []] = True
        digits = np.concatenate([[0], np.cumsum(_CLASS[data] == 4, dtype=np.int64)])
        own = np.diff(offsets)
        share = 1000 * (digits[offsets[1:]] - digits[offsets[:-1]]) // np.maximum(1, own)
        cues = np.concatenate([[0], np.cumsum(self.cue)])
        begin, stop, _ = word_spans(data, offsets)
        flags = np.zeros(len(begin), np.int32)
        scheme = np.zeros(len(data), bool)
        scheme[:-2] = (data[:-2] == 0x3A) & (data[1:-1] == 0x2F) & (data[2:] == 0x2F)
        tests = ((scheme, 1), (data == 0x40, 1), (data == 0x2F, 2), (data == 0x2E, 1), (data == 0x3A, 2), ((data == 0x3F) | (data == 0x26), 1), (data == 0x3D, 1), (data == 0x23, 1))
        for k, (mask, least) in enumerate(tests):
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            flags |= ((sums[stop] - sums[begin]) >= least).astype(np.int32) << k
        self.flags = flags[np.searchsorted(begin, self.start, "right") - 1] if len(begin) else np.zeros(0, np.int32)
        self.files = np.stack([np.searchsorted((5, 20, 80), share, "right"), np.minimum(2, cues[self.first[1:]] - cues[self.first[:-1]])], 1)

    def features(self, a: int, b: int) -> np.ndarray:
        """One feature of each group for each of the tokens a to b: shape, neighbouring words, and the file's own."""
        low, high = max(0, a - _NEAR), min(len(self.start), b + 1)
        base = self.start[low]
        start, end, row = self.start[low:high] - base, self.end[low:high] - base, self.row[low:high]
        data = self.data[base : base + end[-1] + 1]
        kind, size = _CLASS[data], end - start

        def longest(mask: np.ndarray) -> np.ndarray:
            """The longest run of the mask in each token."""
            run = np.cumsum(mask, dtype=np.int32)
            back = np.where(mask, 0, run)
            back[start] = np.maximum(back[start], run[start] - mask[start])  # rows may follow each other without a gap
            run -= np.maximum.accumulate(back)
            return np.maximum.reduceat(run, start)

        def within(mask: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(mask) + 1, np.int32)
            np.cumsum(mask, out=sums[1:])
            return sums[to] - sums[from_]

        counts = {k: within(kind == k, start, end) for k in range(1, 7)}
        make = _makeup(size, counts, kind[start])
        length = np.searchsorted(_LENGTHS, size, "right")
        sort = _SORT[kind]
        change = np.zeros(len(data), bool)
        change[1:] = sort[1:] != sort[:-1]
        switches = np.searchsorted((1, 2, 3, 5, 8), within(change, start + 1, end), "right")
        letters = counts[1] + counts[2] + counts[3]
        vowels = within(_VOWEL[data] > 0, start, end)
        share = np.where(letters < 4, 6, np.minimum(5, 10 * vowels // np.maximum(1, letters)))
        n = len(start)
        same = [np.zeros(n, bool)] + [np.concatenate([np.zeros(min(k, n), bool), row[k:] == row[:-k]]) for k in (1, 2, 3)]
        cue = self.cue[low:high]
        back = [cue] + [np.concatenate([np.zeros(min(k, n), bool), cue[:-k]]) & same[k] for k in (1, 2, 3)]
        near_cue = np.select([cue, back[1], back[2], back[3]], [4, 1, 2, 3], 0)
        last_end = np.where(same[1], np.concatenate([[0], end[:-1]]), start)
        mark = within((data == 0x3D) | (data == 0x3A), last_end, start) > 0
        before, after = data[np.maximum(start - 1, 0)] * (start > last_end), data[np.minimum(end, len(data) - 1)]
        quote, quoted = (before == 0x22) | (before == 0x27), ((after == 0x22) | (after == 0x27)) & (end < len(data))
        joined = np.where(same[1] & (start - last_end == 1) & (before != 0x20) & (before != 0x0A), np.where(before == 0x2E, 1, 2), 0)
        left = np.where(same[1], np.concatenate([[0], make[:-1]]), _MAKES)
        right = np.where(np.concatenate([same[1][1:], [False]]), np.concatenate([make[1:], [0]]), _MAKES)
        out = [length, make, np.minimum(5, counts[4] * 10 // size), switches, share, near_cue, mark * (1 + (near_cue > 0)), quote + 2 * quoted, joined, left, right, self.files[row, 0], self.files[row, 1]]
        out += [length * _MAKES + make, near_cue * _MAKES + make, near_cue * (len(_LENGTHS) + 1) + length, make * 7 + share]
        letter = (kind >= 1) & (kind <= 3)
        steps = len(_LENGTHS) + 1
        hard = np.searchsorted((2, 3, 4, 5, 6, 8), longest(letter & (_VOWEL[data] == 0)), "right")
        dense = np.searchsorted((1, 2, 3, 4, 6), 10 * within(change & (sort != 5) & (np.concatenate([[0], sort[:-1]]) != 5), start + 1, end) // size, "right")
        for most in (hard, np.searchsorted((1, 3, 5, 8, 12), longest(letter), "right"), np.searchsorted((1, 2, 3, 5, 9), longest(kind == 4), "right"), dense, np.minimum(_MARKS - 1, counts[6])):
            out.append(most * steps + length)
        out += [hard * _DENSE + dense, _BESIDE[before * (start > last_end)], _BESIDE[np.where(end < len(data), after, 0)]]
        flags = self.flags[low:high]
        lower = np.where(kind == 3, data + 32, data).astype(np.uint8)
        word = (word_hashes(lower, start, end) % np.uint64(_WORDS)).astype(np.int64)
        out += [flags, flags * _MAKES + make, flags * _CUE_STEPS + near_cue, np.where(same[1], np.concatenate([[0], word[:-1]]), _WORDS)]
        return (np.stack(out, 1) + _AT[:-1])[a - low : b - low]


def encoded(texts: list[str]) -> Tokens:
    return Tokens(*utf8(pa.array(texts, pa.string())))


# ---- the model -----------------------------------------------------------------------------------------------------
# Labels: 0 outside, 1 begin, 2 inside. Inside never follows outside.
_BARRED = np.array([[0, 0, 1], [0, 0, 0], [0, 0, 0]], bool)


def viterbi(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of sequences that stand one after the other in emit, all decoded in step; each starts as if after an outside token."""
    out = np.zeros(len(emit), np.int8)
    if not len(lengths):
        return out
    starts, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    best, back = move[0] + emit[starts], np.zeros((len(emit), 3), np.int8)
    for k in range(1, int(lengths[0])):
        alive = int(np.searchsorted(-lengths, -k))  # those longer than k
        paths = best[:alive, :, None] + move
        back[starts[:alive] + k] = paths.argmax(1)
        best[:alive] = paths.max(1) + emit[starts[:alive] + k]
    tag = best.argmax(1)
    for k in range(int(lengths[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-lengths, -k))
        out[starts[:alive] + k] = tag[:alive]
        tag[:alive] = back[starts[:alive] + k, tag[:alive]]
    return out


def certain(emit: np.ndarray, move: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which tokens are outside on every best path, whatever stands around them. last: a row's last token.

    Of a path with another label there, that label is made outside, and a following `inside`, which may not follow it, `begin`. At most three transitions change, each by at most the spread of the free ones, and the next token's emission; a margin above all of that makes the new path better.
    """
    free = move[~_BARRED]
    following = np.maximum(0, np.append(emit[1:, 2] - emit[1:, 1], 0)) * ~last
    return emit[:, 0] - np.maximum(emit[:, 1], emit[:, 2]) > 3 * (free.max() - free.min()) + following


def decoded(t: Tokens, model: Model, prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their labels on a best path of their row; all others are outside. Every token has its features; sequences are cut where a token is certain to be outside, so the paths are those of whole rows."""
    weights, move = model
    n = len(t.start)
    kept, emits = [], []
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        more = min(n, b + 1)  # one token more, which certain() looks at
        emit = np.zeros((more - a, 3))
        for column in t.features(a, more).T:
            emit += weights[column]
        keep = ~certain(emit, move, np.append(np.diff(t.row[a:more]) > 0, more == n))[: b - a] if prune else np.ones(b - a, bool)
        kept.append(np.flatnonzero(keep) + a)
        emits.append(emit[: b - a][keep])
    at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros(0, np.int8)
    emit = np.concatenate(emits)
    edge = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(t.row[at]) > 0)])
    begin = np.flatnonzero(edge)
    lengths = np.diff(np.append(begin, len(at)))
    # A token after the last of a sequence is certain to be outside; moving there is part of the path.
    final = at[begin + lengths - 1]
    emit = emit.copy()
    emit[(begin + lengths - 1)[(final + 1 < n) & (t.row[np.minimum(final + 1, n - 1)] == t.row[final])]] += move[:, 0]
    return at, viterbi(emit, move, lengths)


def tagged(t: Tokens, model: Model, prune: bool = True) -> list[tuple[int, int, int]]:
    """(row, start, end) in bytes of the column of what the model tags as secrets."""
    (at, tags), out = decoded(t, model, prune), []
    for k in np.flatnonzero(tags == 1).tolist():
        stop = k
        while stop + 1 < len(tags) and tags[stop + 1] == 2 and at[stop + 1] == at[stop] + 1 and t.row[at[stop + 1]] == t.row[at[stop]]:
            stop += 1
        out.append((int(t.row[at[k]]), int(t.start[at[k]]), int(t.end[at[stop]])))
    return out


def field_spans(column: pa.Array, model: Model, prune: bool = True) -> dict[int, list[tuple[int, int]]]:
    """For each row of a string column with any: (start, end) in code points of what the model tags as secrets, over the whole text."""
    t = Tokens(*utf8(column))
    found: dict[int, list[tuple[int, int]]] = {}
    for row, a, b in tagged(t, model, prune):
        found.setdefault(row, []).append((a - int(t.offsets[row]), b - int(t.offsets[row])))
    for row, spans in found.items():
        own = t.data[t.offsets[row] : t.offsets[row + 1]]
        if (own >= 0x80).any():
            point = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            found[row] = [(int(point[a]), int(point[b])) for a, b in spans]
    return found


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def crf_gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of padded sequences, a token, by weights and transitions: what the labels count less what the model expects, by forward-backward."""
    n, longest = mask.shape
    flat, grad_w, grad_m = x[mask], np.zeros_like(weights), np.zeros_like(move)
    emit = np.zeros((n, longest, 3))
    emit[mask] = sum(weights[column] for column in flat.T)
    alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
    alpha[:, 0] = move[0] + emit[:, 0]
    for k in range(1, longest):
        alpha[:, k] = np.where(mask[:, k, None], _lse(alpha[:, k - 1, :, None] + move, 1) + emit[:, k], alpha[:, k - 1])
    for k in range(longest - 2, -1, -1):
        beta[:, k] = np.where(mask[:, k + 1, None], _lse(move + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2), beta[:, k + 1])
    norm = _lse(alpha[:, -1], 1)
    node = np.exp(alpha + beta - norm[:, None, None])[mask]
    node[np.arange(len(node)), y[mask]] -= 1
    for label in range(3):
        grad_w[:, label] = -np.bincount(flat.ravel(), np.repeat(node[:, label], flat.shape[1]), len(weights))
    edge = np.exp(alpha[:, :-1, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * mask[:, 1:, None, None]
    grad_m -= edge.sum((0, 1))
    grad_m[0] -= np.exp(alpha[:, 0] + beta[:, 0] - norm[:, None]).sum(0)
    before = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], 1)
    np.add.at(grad_m, (before[mask], y[mask]), 1)
    return grad_w / mask.sum(), grad_m / mask.sum()


def fit_crf(rows: list[np.ndarray], labels: list[np.ndarray], *, steps: int = 400, batch: int = 1024, rate: float = 0.1, decay: float = 1e-6, seed: int = 11) -> Model:
    """Weights (features, 3) and transitions (3, 3) by the conditional log-likelihood of sequences drawn `batch` at a time, with Adam at a falling rate. All sequences are held by the driver, so in the smallest types that hold features and labels."""
    longest = max(map(len, rows))
    x = np.zeros((len(rows), longest, len(_SIZES)), np.min_scalar_type(N_FEATURES))
    y, mask = np.zeros((len(rows), longest), np.int8), np.zeros((len(rows), longest), bool)
    for i, (r, own) in enumerate(zip(rows, labels, strict=True)):
        x[i, : len(r)], y[i, : len(r)], mask[i, : len(r)] = r, own, True
    rng = np.random.default_rng(seed)
    weights, move = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    held = [[v, np.zeros_like(v), np.zeros_like(v)] for v in (weights, move)]
    for step in range(1, steps + 1):
        own = rng.integers(len(rows), size=min(batch, len(rows)))
        grads = crf_gradient(x[own], y[own], mask[own], weights, np.where(_BARRED, -30.0, move))
        for (value, first, second), grad in zip(held, grads, strict=True):
            grad = np.where(_BARRED, 0, grad) if value is move else grad
            grad = grad - decay * value
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            value += rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights, np.where(_BARRED, -30.0, move)


# ---- training ------------------------------------------------------------------------------------------------------
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Made-up secrets' alphabets, least and greatest lengths, and whether they need a cue; the phrases that they stand in for training, with a cue and without.
_SHAPES = (
    (_DIG + "abcdef", 16, 64, False),
    (_DIG + "abcdef", 16, 28, False),
    (_UP + _DIG, 12, 32, False),
    (_UP + _LOW + _DIG, 12, 48, False),
    (_UP + _LOW + _DIG + "+/_-", 20, 60, False),
    (_LOW + _DIG, 12, 40, False),
    (_LOW, 14, 32, True),
    (_LOW, 16, 24, True),
    (_UP + _LOW, 12, 32, True),
    (_UP + _LOW + _DIG, 6, 12, True),
    (_LOW + _DIG, 6, 12, True),
)
_CUED = ('token = "{}"', "secret: {}", "password={}", "api_key = '{}'", "Authorization: Bearer {}", "auth {}", "key {} end", "key: {}", "pwd is {}", "pwd={}", "the password is {} for now", "credentials: user {}", '"client_secret": "{}"', "passwd {}", "https://api.example.org/v1/items?token={}&page=2", "postgres://admin:{}@db.internal:5432/main", "mysql://root:{}@localhost/shop", "secret for prod is {}", "my pwd here: {}", "a key called {}", "bearer follows {}", "with auth set to {}")
_BARE = ("{}", "({})", '"{}"', "id {} here", "use {}, please", "value={}")
_PREFIXES = ("ghp_", "gho_", "sk_live_", "pk_test_", "xoxb-", "xoxp-", "glpat-", "npm_", "SG.", "hf_")
# Words that names in code and addresses are made of, beside made-up ones, and words that ordinary strings stand after.
_NAME_WORDS = ("user", "get", "set", "list", "file", "name", "index", "count", "value", "data", "page", "item", "order", "account", "service", "handler", "manager", "request", "response", "http", "json", "utf8", "type", "size", "test", "config", "cache", "session", "image", "report", "daily", "load", "update", "parse", "compute", "total", "distance", "model", "view", "form", "key", "auth", "token", "default", "general", "async", "node", "string", "array", "path")
_TLDS = ("com", "org", "net", "de", "io", "co.uk", "fr")
_ENDINGS = ("py", "html", "txt", "pdf", "js", "java", "png", "json", "csv", "md", "so", "jpg")
_ORDINARY = ("{}", "see {}", "({})", "the {} of", "at {}.", "in {},", "`{}`", '"{}"', "name {} and", "for {}:", "key {} is", "the token {} of the grammar")


def _drawn(rng: np.random.Generator, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choice(list(alphabet), rng.integers(least, most + 1)))


def _word(rng: np.random.Generator) -> str:
    """A word of a list, or one that can be pronounced."""
    if rng.random() < 0.5:
        return str(rng.choice(_NAME_WORDS))
    return "".join(str(rng.choice(["", "r", "l"]) if k and rng.random() < 0.2 else "") + str(rng.choice(list("bcdfghklmnprstvw"))) + str(rng.choice(["a", "e", "i", "o", "u", "ai", "ou"])) + str(rng.choice(["", "", "n", "r", "s", "t", "ck", "ng"])) for k in range(rng.integers(1, 4)))


def _name(rng: np.random.Generator) -> str:
    """Words joined in one of five styles of code."""
    words = [_word(rng) for _ in range(rng.integers(2, 7))]
    if rng.random() < 0.3:
        words[-1] += str(rng.integers(1, 100))
    big = [w.capitalize() for w in words]
    return str([words[0] + "".join(big[1:]), "".join(big), "_".join(words), "-".join(words), "_".join(words).upper(), "__" + "_".join(words) + "__"][rng.integers(6)])


def _host(rng: np.random.Generator) -> str:
    return str(rng.choice(["", "www.", "api."])) + "-".join(_word(rng) for _ in range(rng.integers(1, 3))) + "." + str(rng.choice(_TLDS))


def ordinary(rng: np.random.Generator, words: list[str]) -> str:
    """An ordinary string that is no plain word, in a phrase: names in code, addresses, paths, numbers, dates, versions, ids and hashes that say what they are, pictures as text, part numbers, and compounds of the text's own words."""
    n = lambda least, most: str(rng.integers(least, most))
    hexa = _DIG + "abcdef"
    kind = rng.integers(18)
    if kind == 17:
        code = "".join(_drawn(rng, _UP if k % 2 == 0 else _DIG, 1, 3) for k in range(rng.integers(2, 6)))
        return str(rng.choice(["{}", "part {}", "model {},", "seat {}", "({})", "type {} of"])).format(code)
    if kind > 13:
        parts = [w for w in rng.choice(words, rng.integers(2, 5)).tolist() if w.isalpha()] if words else []
        text = "".join(parts).lower() or _word(rng)
        return str(rng.choice(_ORDINARY)).format(text.capitalize() if rng.random() < 0.3 else text)
    if kind == 0:
        text = "-".join(_drawn(rng, hexa, k, k) for k in (8, 4, 4, 4, 12))
        text = text.upper() if rng.random() < 0.3 else text
        return str(rng.choice(["{}", "id {}", "request {} failed", "uuid={}", "urn:uuid:{}", "session {}", '"{}"'])).format(text)
    if kind == 1:
        return str(rng.choice(["commit {}", "Merge {} into main", "sha256:{}", "rev {}", "checksum {}", "git show {}", "blob {}", "md5 {}"])).format(_drawn(rng, hexa, *[(7, 12), (32, 32), (40, 40)][rng.integers(3)]))
    if kind in (2, 3):
        path = "/".join(str(rng.choice([_word(rng), _name(rng), n(1, 100_000), _drawn(rng, _UP + _LOW + _DIG, 5, 11)], p=[0.45, 0.3, 0.15, 0.1])) for _ in range(rng.integers(0, 5)))
        query = str(rng.choice(["", "", "?page=" + n(1, 50), "?ref=" + _word(rng) + "&id=" + n(1, 10**8), "#" + _word(rng), "?q=" + _word(rng) + "+" + _word(rng)]))
        return str(rng.choice(["{}", "see {}", "({})", "<{}>", "open {} now", "[link]({})"])).format(str(rng.choice(["https://", "http://", "", "ftp://"])) + _host(rng) + "/" + path + str(rng.choice(["", "." + str(rng.choice(_ENDINGS))])) + query)
    if kind == 4:
        parts = [str(rng.choice([_word(rng), _name(rng)])) for _ in range(rng.integers(1, 6))]
        return str(rng.choice(["/usr/", "/home/", "./", "src/", "../", "C:/", "~/", "lib/"])) + "/".join(parts) + str(rng.choice(["", "/", "." + str(rng.choice(_ENDINGS))]))
    if kind == 5:
        return str(rng.choice(["{}", "mail {}", "<{}>", "contact: {}"])).format(str(rng.choice([".", "_", ""])).join(_word(rng) for _ in range(rng.integers(1, 3))) + str(rng.choice(["", n(1, 2000)])) + "@" + _host(rng))
    if kind == 6:
        groups = [_drawn(rng, _DIG, 2, 5) for _ in range(rng.integers(2, 5))]
        return str(rng.choice(["call {}", "tel. {}", "{}", "fax {}", "phone: {}"])).format(str(rng.choice(["", "+" + n(1, 99) + "-", "0", "+" + n(1, 99)])) + str(rng.choice(["-", "", "/", " "])).join(groups))
    if kind == 7:
        number = str(rng.choice(["", "A", "INV-", "ORD-", "#", "No. ", "EU"])) + str(rng.choice([n(1, 10**9), "2024-" + n(1, 10**6), n(1, 10**14), n(1, 999) + "-" + n(1, 10**7) + "-" + n(1, 10**7)]))
        return str(rng.choice(["order {}", "{}", "invoice {}", "case {},", "item {}", "account {}", "total {}"])).format(number)
    if kind == 8:
        day = f"{rng.integers(1950, 2040)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}"
        clock = f"{rng.integers(24):02}:{rng.integers(60):02}:{rng.integers(60):02}"
        return str(rng.choice([day, day + "T" + clock + "Z", day + "T" + clock + "." + n(100, 1000) + "+02:00", day + " " + clock, clock, day.replace("-", "/"), day.replace("-", "") + "T" + clock.replace(":", "") + "Z"]))
    if kind == 9:
        return str(rng.choice(["v{}", "version {}", "{}", "{}-rc1", _word(rng) + "-{}", _word(rng) + "=={}", _word(rng) + "{}"])).format(".".join(n(0, 30) for _ in range(rng.integers(2, 4))))
    if kind == 10:
        return str(rng.choice(["data:image/png;base64,{}", "data:font/woff2;base64,{}", 'src="data:image/gif;base64,{}"'])).format(_drawn(rng, _UP + _LOW + _DIG + "+/", 40, 200))
    if kind == 11:
        return f"{_name(rng)}({_word(rng)}" + str(rng.choice([")", ", " + _name(rng) + ")", "):"]))
    return str(rng.choice(_ORDINARY)).format(_name(rng))


def made_up(rng: np.random.Generator) -> tuple[str, str, str]:
    """A made-up secret and what stands before and after it."""
    alphabet, least, most, cued = _SHAPES[rng.integers(len(_SHAPES))]
    secret = _drawn(rng, alphabet, least, most)
    kind = rng.random()
    if kind < 0.1:
        secret = _drawn(rng, _LOW, 2, 4) + str(rng.choice(["_", "-"])) + secret
    elif kind < 0.25 and not cued:
        secret = str(rng.choice(_PREFIXES)) + secret
    elif kind < 0.32 and not cued:
        secret = ".".join(["eyJ" + _drawn(rng, _UP + _LOW + _DIG, 14, 40), "eyJ" + _drawn(rng, _UP + _LOW + _DIG + "_-", 20, 60), _drawn(rng, _UP + _LOW + _DIG + "_-", 24, 43)])
    elif kind < 0.4:
        secret, cued = _word(rng).capitalize() + str(rng.integers(10, 10_000)), True
    phrases = _CUED if cued or rng.random() < 0.5 else _BARE
    left, right = phrases[rng.integers(len(phrases))].split("{}")
    return secret, left, right


def training_rows(text: str, *, made: int = 5, plain: int = 8, usual: int = 6, reach: int = 5, seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences for training from one text: `made` made-up secrets in common phrases, put anywhere in a copy of it, each with `reach` tokens on either side and the features of the whole file; `usual` ordinary strings that look unlike prose, put into another copy, which are outside; and `plain` stretches of the text itself, half of them around cues, where the patterns' matches are the secrets. What is drawn hangs on the text alone."""
    rng = np.random.default_rng((seed, zlib.crc32(text.encode("utf-8", "surrogatepass"))))
    rows: list[np.ndarray] = []
    labels: list[np.ndarray] = []

    def known(s: str) -> list[tuple[int, int]]:
        return [ASSIGN.match(s, start).span(2) if kind == 0 else (start, end) for start, kind, end in base_spans(s)]

    def bytes_at(s: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if s.isascii():
            return spans
        at = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in s)])
        return [(int(at[a]), int(at[b])) for a, b in spans]

    def add(t: Tokens, secrets: list[tuple[int, int]], centre: int) -> None:
        a, b = max(0, centre - reach), min(len(t.start), centre + reach + 1)
        own = np.zeros(b - a, np.int64)
        for s, e in secrets:
            i, j = np.searchsorted(t.start[a:b], s), np.searchsorted(t.end[a:b], e, "right")
            own[i:j] = 2
            if i < j:
                own[i] = 1
        rows.append(t.features(a, b))
        labels.append(own)

    t, own = encoded([text]), bytes_at(text, known(text))
    if len(t.start):
        cues = np.flatnonzero(t.cue)
        near = rng.choice(cues, min(len(cues), plain // 2), replace=False) if len(cues) else []
        for centre in [*near, *rng.integers(len(t.start), size=plain - len(near))]:
            add(t, own, int(centre))
    own_words = [w.strip(".,;:!?|()") for w in text.split()]
    for n, secret in ((made, True), (usual, False)):
        # Secrets and ordinary strings go into copies of their own, so that a sequence has one of them.
        copy, spans = _sprinkled(rng, text, n, made_up if secret else lambda rng: (ordinary(rng, own_words), "", ""))
        t, placed = encoded([copy]), bytes_at(copy, spans)
        base = bytes_at(copy, known(copy))
        both = [*placed, *((s, e) for s, e in base if not any(s < y and x < e for x, y in placed))] if secret else base
        for s, e in placed:
            for centre in range(int(np.searchsorted(t.start, s)), max(int(np.searchsorted(t.start, s)) + 1, int(np.searchsorted(t.start, e))), reach + 1):
                add(t, both, centre)
    return rows, labels


def _sprinkled(rng: np.random.Generator, text: str, n: int, make: Callable[[np.random.Generator], tuple[str, str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text with n made things put between its words, and where they are."""
    words, out, spans, size = text.split(" "), [], [], 0
    places = np.sort(rng.integers(len(words) + 1, size=n)).tolist()
    for k in range(len(words) + 1):
        while places and places[0] == k:
            places.pop(0)
            thing, left, right = make(rng)
            spans.append((size + len(left), size + len(left) + len(thing)))
            out.append(left + thing + right)
            size += len(out[-1]) + 1
        if k < len(words):
            out.append(words[k])
            size += len(words[k]) + 1
    return " ".join(out), spans


def fit_secret_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 1500, made: int = 5, plain: int = 8, usual: int = 6) -> Model:
    """The field's weights, from a bounded sample: the ids of the `sample` rows with the smallest hash of their id, of each id its least text, whole. Tasks turn each into about `made` + `plain` + `usual` short sequences; only those reach the driver. Null ids are left out; without texts the field knows made-up secrets alone."""
    few = docs.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in strings(batch.column("text")):
                rows, labels = training_rows(text, made=made, plain=plain, usual=usual)
                if rows:
                    yield pa.record_batch([pa.array([r.astype(np.int16).tobytes() for r in rows], pa.binary()), pa.array([y.astype(np.int8).tobytes() for y in labels], pa.binary())], ["x", "y"])

    got = own.select("text").mapInArrow(run, "x binary, y binary").toArrow().sort_by([("x", "ascending"), ("y", "ascending")])
    rows = [np.frombuffer(x.as_buffer(), np.int16).reshape(-1, len(_SIZES)) for x in got["x"]]  # views of the table
    labels = [np.frombuffer(y.as_buffer(), np.int8) for y in got["y"]]
    if not rows:
        rows, labels = training_rows("a b c")
    model = fit_crf(rows, labels)
    del got, rows, labels
    pa.default_memory_pool().release_unused()  # the driver goes on
    return model


def added(base: list[tuple[int, int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that aren't within one of the patterns'."""
    starts = np.array([s for s, _, _ in base], np.int64)
    reach = list(accumulate((e for _, _, e in base), max))
    return [(a, 3, b) for a, b in more if (k := int(np.searchsorted(starts, a, "right"))) == 0 or reach[k - 1] < b]


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_assign, n_access, n_hex, base_sha256, and spans (all, the field's as kind crf).

    Spans of the field that lie within a pattern's match add nothing and are left out; the patterns' own always stay. Null text: as empty, so no spans. Null id: kept as null. Repeated rows: one result each. Very long texts: whole; features are made for about 131,000 tokens at once. Empty table: no rows. Other columns aren't read. One narrow pass over whole texts, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows, found = [], field_spans(batch.column("text"), model)
            for k, text in enumerate(strings(batch.column("text"))):
                base = base_spans(text)
                counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + added(base, found.get(k, [])))))
            yield pa.record_batch([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return own.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def without_secrets(docs: DataFrame, model: Model, *, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text`, the patterns' and the field's, replaced by the mark and n_chars, if there is one, counted anew.

    Texts without secrets, null and empty ones among them, and all other columns are as they were. Repeated rows: one result each. Empty table: no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts, changed, found = batch.column("text").to_pylist(), {}, field_spans(batch.column("text"), model)
            for k, text in enumerate(texts):
                if text and (base := base_spans(text)) + found.get(k, []):
                    changed[k] = redacted(text, base + added(base, found.get(k, [])), mark)
            if changed:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns["text"] = pa.array([changed.get(k, x) for k, x in enumerate(texts)], batch.schema.field("text").type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(changed[k]) if k in changed else x for k, x in enumerate(columns["n_chars"].to_pylist())], batch.schema.field("n_chars").type)
                batch = pa.record_batch(list(columns.values()), list(columns))
            yield batch

    return docs.mapInArrow(run, docs.schema)
