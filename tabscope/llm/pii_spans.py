"""Personal data in texts: fixed rules, and a character-level BiLSTM-CRF that adds to them.

Base spans are found by rules (e-mail, IP, payment card, phone), by code that takes
linear time on any text.  The tagger is a bidirectional LSTM over characters with CRF
transitions, trained in numpy from a bounded sample of windows labelled by base
spans and of copies of them whose spans are written in ways that rules miss (``[at]``, `` DOT ``, digit
groups parted by other signs), in their own surroundings and in those of other windows.  It reads
windows that overlap by half, wherever a text has a character that personal data can't do
without: a digit, ``@`` or the word "at" in any case (what :func:`_plausible` asks for, so no span is lost by it).
The emissions of overlapping windows are averaged, the middle of a window counting most, and each
unbroken stretch of windows is decoded once, by one Viterbi and one forward-backward pass over its whole length, so
spans of any length are read off one labelling.  Spans grow to the ends of the words and numbers that they cut; those that
overlap a base span, that lack what their kind must have, or that are less sure than the
threshold found on held-out windows are dropped.

Edge cases: null and empty texts have no spans; with nothing to learn from there are base
spans only; repeated rows get the same spans; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import signed, text_or_empty
from .tokens import slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Cells of STRIDE characters decoded together: bounds the arrays for any number of windows (a longer stretch goes alone).
_CELLS = 4096
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"@|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")
_DOT = re.compile(r"\.|(?<![A-Za-z])[Dd][Oo][Tt](?![A-Za-z])")
_NEAR = re.compile(r"[0-9]|" + _AT.pattern)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, non-overlapping within a kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- the tagger: labels are 0 (outside) and, for kind k, 1 + 2k (begins) and 2 + 2k (goes on) --------------------

LABELS = 1 + 2 * len(KINDS)
CHARS = 131  # ASCII, other letters, other signs, padding
_PAD = 130


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    for i in np.flatnonzero(code > 127):
        code[i] = 128 if text[i].isalpha() else 129
    return code.astype(np.uint8)


def labels_of(spans: list[tuple[str, int, int]], n: int) -> np.ndarray:
    """Labels of a text of ``n`` characters; where kinds overlap, the one listed first holds."""
    out = np.zeros(n, np.int8)
    for kind, a, b in reversed(spans):
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] = 1 + 2 * KINDS.index(kind)
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
    """Hidden states (T, N, H) of a (T, N) array of characters; with ``keep`` also what backpropagation needs."""
    t, n, size = *x.shape, wh.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out, kept = np.empty((t, n, size), np.float32), []
    for k in range(t):
        z = wx[x[k]] + h @ wh
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        g = np.tanh(z[:, 3 * size:])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[k] = h
    return out, kept


def _lstm_back(x: np.ndarray, wh: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dwh, steps = np.zeros_like(wh), np.empty((*x.shape, 4 * wh.shape[0]), wh.dtype)
    dh = dc = 0.0
    for k in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, tc = kept[k]
        dh = dout[k] + dh
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
        steps[k] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return np.eye(CHARS, dtype=wh.dtype)[x.ravel()].T @ steps.reshape(-1, steps.shape[2]), dwh


def _emissions(m: dict, x: np.ndarray, keep: bool = False):
    ahead, kept_a = _lstm(x, m["wx"], m["wh"], keep)
    back, kept_b = _lstm(x[::-1], m["vx"], m["vh"], keep)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return both @ m["wo"] + m["bo"], both, kept_a, kept_b


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _forward_backward(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for k in range(1, len(e)):
        alpha[k] = _lse(alpha[k - 1][:, :, None] + a, 1) + e[k]
    for k in range(len(e) - 2, -1, -1):
        beta[k] = _lse(a + (e[k + 1] + beta[k + 1])[:, None, :], 2)
    return alpha, beta, _lse(alpha[-1], 1)


def _gradients(m: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """CRF loss per window and its gradients; ``x``, ``y``: (T, N)."""
    e, both, kept_a, kept_b = _emissions(m, x, True)
    t, n, a = *x.shape, m["tr"]
    alpha, beta, z = _forward_backward(e, a)
    de = np.exp(alpha + beta - z[:, None])
    da = np.zeros_like(a)
    for k in range(t - 1):
        da += np.exp(alpha[k][:, :, None] + a + (e[k + 1] + beta[k + 1] - z[:, None])[:, None, :]).sum(axis=0)
    rows, cols = np.indices(y.shape)
    gold = e[rows, cols, y].sum() + a[y[:-1], y[1:]].sum()
    de[rows, cols, y] -= 1
    np.subtract.at(da, (y[:-1], y[1:]), 1)
    de /= n
    dboth = de @ m["wo"].T
    size = m["wh"].shape[0]
    gwx, gwh = _lstm_back(x, m["wh"], kept_a, dboth[:, :, :size])
    gvx, gvh = _lstm_back(x[::-1], m["vh"], kept_b, dboth[::-1][:, :, size:])
    g = {"wx": gwx, "wh": gwh, "vx": gvx, "vh": gvh, "wo": np.einsum("tnh,tnk->hk", both, de), "bo": de.sum(axis=(0, 1)), "tr": da / n}
    return float((z.sum() - gold) / n), g


def train_tagger(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 11) -> dict:
    """``x``, ``y``: (windows, WINDOW) characters and labels.  Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    m = {"wx": init(CHARS, 4 * hidden), "wh": init(hidden, 4 * hidden), "vx": init(CHARS, 4 * hidden), "vh": init(hidden, 4 * hidden),
         "wo": init(2 * hidden, LABELS), "bo": np.zeros(LABELS, np.float32), "tr": np.zeros((LABELS, LABELS), np.float32)}
    for w in ("wx", "vx"):
        m[w][:, hidden:2 * hidden] += 1  # remember at first
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // batch)):
            step += 1
            _, g = _gradients(m, x[rows].T, y[rows].T)
            for k in m:
                d = np.clip(g[k], -1, 1)
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                m[k] -= (rate * (1.05 - step / total) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return m


def viterbi(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Best labels (T, N) of emissions (T, N, LABELS)."""
    score, came = e[0], np.empty(e.shape, np.int8)
    for k in range(1, len(e)):
        paths = score[:, :, None] + tr
        came[k] = paths.argmax(axis=1)
        score = paths.max(axis=1) + e[k]
    out = np.empty(e.shape[:2], np.int8)
    out[-1] = score.argmax(axis=1)
    for k in range(len(e) - 1, 0, -1):
        out[k - 1] = came[k][np.arange(e.shape[1]), out[k]]
    return out


def certainty(e: np.ndarray, tr: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Marginal probability (T, N) that a character is of its label's kind, whether it begins or goes on."""
    p = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.exp(tr - tr.max())
    ahead, back = np.empty_like(p), np.ones_like(p)
    ahead[0] = p[0]
    for k in range(1, len(p)):
        x = (ahead[k - 1] @ a) * p[k]
        ahead[k] = x / x.sum(axis=1, keepdims=True)
    for k in range(len(p) - 2, -1, -1):
        x = (back[k + 1] * p[k + 1]) @ a.T
        back[k] = x / x.sum(axis=1, keepdims=True)
    ahead *= back
    ahead /= ahead.sum(axis=2, keepdims=True)
    kinds = np.concatenate([ahead[:, :, :1], ahead[:, :, 1::2] + ahead[:, :, 2::2]], axis=2)
    return np.take_along_axis(kinds, (best.astype(np.int64)[:, :, None] + 1) // 2, 2)[:, :, 0]


# -- windows -------------------------------------------------------------------------------------------------------

def near_windows(text: str) -> np.ndarray:
    """Starts (multiples of STRIDE, from -STRIDE) of the windows that hold a telling character."""
    cell = np.unique(np.array([m.start() // STRIDE for m in _NEAR.finditer(text)], np.int64))
    return np.union1d(cell - 1, cell) * STRIDE


def _cut(values: np.ndarray, starts: np.ndarray, fill: int) -> np.ndarray:
    padded = np.concatenate([np.full(STRIDE, fill, values.dtype), values, np.full(WINDOW, fill, values.dtype)])
    return padded[starts[:, None] + STRIDE + np.arange(WINDOW)]


def tag(m: dict, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """The tagger's spans in each text, with the mean certainty of their characters."""
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    stretches, chars, cells = [], [], 0

    def decode():
        for (i, start, _), (labels, sure) in zip(stretches, _decoded(m, np.concatenate(chars), [n for _, _, n in stretches])):
            out[i] += _spans(labels, sure, start, len(texts[i]))

    for i, t in enumerate(texts):
        starts = near_windows(t)
        if not len(starts):
            continue
        ids = char_ids(t)
        for own in np.split(starts, np.flatnonzero(np.diff(starts) != STRIDE) + 1):
            if cells and cells + len(own) > _CELLS:
                decode()
                stretches, chars, cells = [], [], 0
            low, high = max(0, own[0]), own[-1] + WINDOW
            stretches.append((i, int(own[0]), len(own)))
            chars.append(_cut(ids[low:high], own - low, _PAD))
            cells += len(own) + 1
    if cells:
        decode()
    return out


def _decoded(m: dict, chars: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and certainties of stretches of ``sizes`` windows each (``chars``: all their windows).  Stretches stand one
    after another in columns, parted by a character that is surely outside."""
    e = np.empty((len(chars), WINDOW, LABELS), np.float32)
    for k in range(0, len(chars), 512):
        e[k:k + 512] = _emissions(m, chars[k:k + 512].T)[0].transpose(1, 0, 2)
    rising = np.arange(1, STRIDE + 1, dtype=np.float32)[:, None]
    cell = np.arange(len(chars)) + np.repeat(np.arange(len(sizes)), sizes)
    total, weight = np.zeros((len(chars) + len(sizes), STRIDE, LABELS), np.float32), np.zeros((len(chars) + len(sizes), STRIDE, 1), np.float32)
    for half, w in ((0, rising), (1, rising[::-1])):
        total[cell + half] += e[:, half * STRIDE:(half + 1) * STRIDE] * w
        weight[cell + half] += w
    total /= weight
    lengths = [(n + 1) * STRIDE for n in sizes]
    height, place, column, row = max(16 * STRIDE, *lengths) + 1, [], 0, 0
    for n in lengths:
        if row + n + 1 > height:
            column, row = column + 1, 0
        place.append((column, row))
        row += n + 1
    tall = np.full((height, column + 1, LABELS), -1e4, np.float32)
    tall[:, :, 0] = 0
    flat, at = total.reshape(-1, LABELS), 0
    for n, (c, r) in zip(lengths, place):
        tall[r:r + n, c] = flat[at:at + n]
        at += n
    best = viterbi(tall, m["tr"])
    sure = certainty(tall, m["tr"], best)
    for n, (c, r) in zip(lengths, place):
        yield best[r:r + n, c], sure[r:r + n, c]


def _spans(labels: np.ndarray, certain: np.ndarray, base: int, n: int) -> Iterator[tuple[str, int, int, float]]:
    kind = np.where(labels > 0, (labels + 1) // 2, 0)
    if not kind.any():
        return
    cut = np.flatnonzero((np.diff(kind) != 0) | (labels[1:] % 2 == 1)) + 1
    for part in np.split(np.arange(len(labels)), cut):
        a, b = max(0, base + part[0]), min(n, base + part[-1] + 1)
        if kind[part[0]] and b > a:
            yield KINDS[kind[part[0]] - 1], int(a), int(b), float(certain[part].mean())


def _whole(kind: str, a: int, b: int, text: str) -> tuple[int, int]:
    """The span without signs at its ends, grown to the ends of the words or numbers that it cuts."""
    while a < b and not text[a].isalnum() and text[a] != "+":
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    if a < b:
        own = (lambda c: c in _LOCAL) if kind == "email" else (lambda c: c in "0123456789")
        while a > 0 and own(text[a]) and own(text[a - 1]):
            a -= 1
        while b < len(text) and own(text[b - 1]) and own(text[b]) and (text[b].isalnum() or text[b] == "-"):
            b += 1
    return a, b


def added_spans(m: dict, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int, float]]]:
    """The tagger's spans that are plausible and overlap neither a base span nor a surer one."""
    out = []
    for text, known, found in zip(texts, base, tag(m, texts)):
        taken, own = np.zeros(len(text) if found else 0, bool), []
        for _, a, b in known if found else ():
            taken[a:b] = True
        for kind, a, b, sure in sorted(found, key=lambda f: (-f[3], f[1:3])):
            a, b = _whole(kind, a, b, text)
            if kind == "card" and text[a:b].startswith("00") and not _plausible(kind, text[a:b]):
                kind = "phone"  # no issuer's number begins so, the international prefix does
            if b > a and not taken[a:b].any() and _plausible(kind, text[a:b]):
                taken[a:b] = True
                own.append((kind, a, b, sure))
        out.append(own)
    return out


def all_spans(m: dict | None, texts: list[str], sure: float | None = None) -> list[tuple[list, list]]:
    """For each text the base spans and all spans; ``sure``: another threshold than the model's own."""
    telling = [i for i, t in enumerate(texts) if _NEAR.search(t)]
    base, added = [[] for _ in texts], [[] for _ in texts]
    for i in telling:
        base[i] = base_spans(texts[i])
    if m is not None and telling:
        least = m["sure"] if sure is None else sure
        for i, found in zip(telling, added_spans(m, [texts[i] for i in telling], [base[i] for i in telling])):
            added[i] = [(kind, a, b) for kind, a, b, p in found if p >= least]
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return [(b, sorted(b + a, key=order)) for b, a in zip(base, added)]


def _plausible(kind: str, text: str) -> bool:
    """What a rewritten e-mail, address or number must still have."""
    digits = sum(c in "0123456789" for c in text)
    if kind == "email":
        at = _AT.search(text, 1)
        dot = at and _DOT.search(text, at.end() + 1)
        return bool(dot) and any(c.isalnum() for c in text[dot.end():])
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= digits <= 19 and luhn(re.sub(r"[^0-9]", "", text))
    return 9 <= digits <= 15


# -- training windows -------------------------------------------------------------------------------------------------

def _any_case(word: str, rng: np.random.Generator) -> str:
    return word.upper() if rng.integers(3) == 0 else word


def _joint(word: str, sign: str, rng: np.random.Generator) -> str:
    """A sign of an address spelt out or fenced in."""
    word = _any_case(word, rng) if rng.integers(4) else sign
    left, right = ["[]", "()", "{}", "<>", "  ", "  "][rng.integers(6)] if word != sign or rng.integers(2) else "  "
    gap = ["", " ", "  "][rng.integers(3)]
    return f"{gap}{left}{word}{right}{gap}"


def _word(rng: np.random.Generator, least: int, most: int) -> str:
    return "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(least, most + 1)))


def _address(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A name and the labels of a host, made up."""
    name = _word(rng, 2, 9) + ["", ".", "_", "-"][rng.integers(4)] + _word(rng, 0, 7)
    name = name.rstrip("._-") + (str(rng.integers(1000)) if rng.integers(3) == 0 else "")
    host = [_word(rng, 2, 10) + (str(rng.integers(100)) if rng.integers(5) == 0 else "") for _ in range(rng.integers(1, 3))]
    return name, [*host, _word(rng, 2, 4) if rng.integers(2) else ["com", "org", "net"][rng.integers(3)]]


def rewritten_span(kind: str, text: str, rng: np.random.Generator) -> tuple[str, str]:
    """What stands before a span that is written in another way, and that span; names and numbers are new ones
    (a card keeps its first digit, which tells its issuer)."""
    if kind == "email":
        name, host = _address(rng)
        return "", name + _joint("at", "@", rng) + (_joint("dot", ".", rng) if rng.integers(4) else ".").join(host)
    if kind == "ip":
        parts = [str(rng.integers(256)) for _ in range(4)]
        return "", (_joint("dot", ".", rng) if rng.integers(4) else [",", " . ", "-", ":"][rng.integers(4)]).join(parts)
    sign = [".", "/", "_", " . ", "  ", " - ", " / ", ":", " ", "-"][rng.integers(10)]
    digits = re.sub(r"[^0-9]", "", text)
    made = "".join(chr(48 + rng.integers(10)) for _ in digits)
    if kind == "card":
        digits = next(d for d in (digits[:1] + made[1:-1] + str(k) for k in range(10)) if luhn(d))
        return "", sign.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    ends = np.cumsum([len(p) for p in re.findall(r"[0-9]+", text)]).tolist()
    ends = [2, 5, len(digits)] if len(ends) == 1 else ends
    parts = [made[a:b] for a, b in zip([0, *ends], ends)]
    sign = sign if rng.integers(5) else ""
    lead = [("", "00"), ("tel ", ""), ("tel: ", "00"), ("", "(00) "), ("phone ", "")][rng.integers(5)]
    return lead[0], lead[1] + sign.join(parts)


def rewritten(text: str, labels: np.ndarray, rng: np.random.Generator, host: str | None = None) -> tuple[str, np.ndarray]:
    """The window with its personal data written another way; in ``host``, a text without any, if given."""
    kind = (labels + 1) // 2
    cut = np.flatnonzero((np.diff(kind) != 0) | (labels[1:] % 2 == 1)) + 1
    parts = [(int(kind[p[0]]), text[p[0]:p[-1] + 1], labels[p[0]] % 2 == 1) for p in np.split(np.arange(len(text)), cut)]
    if host is not None:
        spaces = [k for k, c in enumerate(host) if c.isspace()] or [len(host)]
        at = spaces[rng.integers(len(spaces))]
        whole = [p for p in parts if p[0]]
        parts = [(0, host[:at] + " ", False), whole[rng.integers(len(whole))], (0, host[at:], False)]
    out, new = [], []
    for k, piece, begins in parts:
        before, piece = ("", piece) if not k else rewritten_span(KINDS[k - 1], piece, rng)
        out += [before, piece]
        own = [2 * k] * len(piece)
        if own and k and begins:
            own[0] = 2 * k - 1
        new += [0] * len(before) + own
    return "".join(out), np.array(new, np.int8)


def training_windows(docs: DataFrame, most: int) -> list[tuple[str, bytes]]:
    """At most ``most`` windows, as many as there are up to a third of them without personal data: text and labels.  The
    choice is by a hash of the window and its labels, so it is the same on every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mark, some, text, labels = [], [], [], []
            for t in b.column(0).to_pylist():
                if t and _NEAR.search(t):
                    y, starts = labels_of(base_spans(t), len(t)), near_windows(t)
                    for s in starts.tolist():
                        a, e = max(0, s), s + WINDOW
                        some.append(bool(y[a:e].any()))
                        text.append(t[a:e])
                        labels.append(y[a:e].tobytes())
                        mark.append(signed(xxhash.xxh64_intdigest(t[a:e].encode("utf-8", "replace") + labels[-1], 5)))
            yield pa.RecordBatch.from_arrays([pa.array(mark, pa.int64()), pa.array(some, pa.bool_()), pa.array(text, pa.string()), pa.array(labels, pa.binary())],
                                             ["mark", "some", "text", "labels"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "mark long, some boolean, text string, labels binary").dropDuplicates(["mark"])
    with_spans = rows.where("some").orderBy("mark").limit(most - most // 3)
    without = rows.where("NOT some").orderBy("mark").limit(most // 3)
    return sorted((r["text"], bytes(r["labels"])) for r in with_spans.union(without).select("text", "labels").collect())


def fit(docs: DataFrame, max_windows: int = 1500, copies: int = 6000, precision: float = 0.98, seed: int = 3, **training) -> dict | None:
    """A tagger trained on at most ``max_windows`` windows of ``docs`` and about ``copies`` rewritten ones (at most 100 of one) of those that
    hold personal data, as many for each kind; None if none does.  A sixth of the windows is held out, and ``sure`` is the
    least threshold at which ``precision`` of the spans added there are right."""
    rng, windows = np.random.default_rng(seed), []
    found = [(t, np.frombuffer(y, np.int8)) for t, y in training_windows(docs, max_windows)]
    hosts = [t for t, y in found if not y.any()]
    some = len(found) - len(hosts)
    kinds = [np.unique((y[y > 0] - 1) // 2) for _, y in found]
    held_by = np.bincount(np.concatenate([np.zeros(0, np.int64), *kinds]).astype(np.int64), minlength=len(KINDS))
    for n, ((text, own), has) in enumerate(zip(found, kinds)):
        windows.append((n % 6 == 0, text, own))
        share = max((copies / np.count_nonzero(held_by) / held_by[k] for k in has), default=0)
        for k in range(min(100, int(np.ceil(share)))):
            windows.append((n % 6 == 0, *rewritten(text, own, rng, hosts[rng.integers(len(hosts))] if hosts and k % 2 else None)))
    x, y = [], []
    for held, t, lab in windows:
        if not held or some < 6:
            # a window of the training set stands anywhere in the text: cut at a random place, or between padding
            skip = int(rng.integers(0, max(0, len(t) - WINDOW) + 1))
            ids, lab = char_ids(t)[skip:skip + WINDOW], lab[skip:skip + WINDOW]
            lead = int(rng.integers(0, WINDOW - len(ids) + 1))
            x.append(np.full(WINDOW, _PAD, np.uint8))
            y.append(np.zeros(WINDOW, np.int64))
            x[-1][lead:lead + len(ids)] = ids
            y[-1][lead:lead + len(ids)] = lab
    if not any(v.any() for v in y):
        return None
    model = train_tagger(np.array(x), np.array(y), **training)
    return model | {"sure": _threshold(model, [(t, lab) for held, t, lab in windows if held], precision)}


def _threshold(m: dict, windows: list[tuple[str, np.ndarray]], precision: float) -> float:
    """The least certainty, 0.5 or more, from which on ``precision`` of the added spans lie on characters labelled so; 0.9 with nothing to go by."""
    texts = [t for t, _ in windows]
    seen = [(p, bool((lab[a:b] > 0).any()) and KINDS.index(kind) in (lab[a:b][lab[a:b] > 0] - 1) // 2)
            for (t, lab), found in zip(windows, added_spans(m, texts, [base_spans(t) for t in texts])) for kind, a, b, p in found]
    if not seen:
        return 0.9
    seen.sort(reverse=True)
    p, good = np.array([s[0] for s in seen]), np.cumsum([s[1] for s in seen])
    fine = np.flatnonzero(good >= precision * np.arange(1, len(p) + 1))
    return float(max(0.5, p[fine[-1]])) if len(fine) else 1.0


def find_spans(docs: DataFrame, model: dict | None, sure: float | None = None) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (kind, start, end) in code points, by kind and start."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
        for b in batches:
            for k, n in slices(b.column(1)):
                part = b.slice(k, n)
                found = all_spans(sent.value, part.column(1).to_pylist(), sure)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([rows(x) for x, _ in found], span), pa.array([rows(x) for _, x in found], span)],
                                                 ["doc_id", "base", "spans"])

    kind, spans = docs.schema["doc_id"].dataType.simpleString(), "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def span_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    found = find_spans(docs, fit(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
