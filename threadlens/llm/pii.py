"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

*Base.* Four kinds (email, ip, card, phone), each found leftmost and without overlap by a pattern and a check, in time
linear in the text.

*Tagger.* A numpy model over character classes: embedding, one LSTM in each direction, emissions for O and B/I of each
kind, and CRF transitions; trained on the driver by Adam on the CRF likelihood of labelled spans. The labelled spans are
made by a seeded generator (``examples``) of invented prose with personal data in the base's and in looser spellings,
and with digits that are none (years, versions, prices, keys, hashes). A text is cut into windows of ``WINDOW`` characters
that overlap by half. Overlapping windows are reconciled before any decision: each character takes its emissions from the
window in which it stands most centrally, and each run of overlapping windows, however long, is decoded once as a whole
(best path and posteriors). Where a span touches a run's inner end, the run is made longer and decoded again. A span then
reaches to the ends of the words it cuts, and must have a mean posterior of at least ``SURE``, satisfy its kind's check and
overlap no base span.

The check of each kind asks for an @ sign (or one spelt out in brackets) or for digits, so runs begin with the windows that
have one of these; text that no run reaches cannot yield a span.

Defined cases: null text is empty and has no spans; texts of any length are worked on whole; repeated rows and ties get
equal spans; null ids are allowed; further columns pass through ``find`` and ``redact`` unchanged (columns named like the
added ones are replaced). An empty table gives no rows. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import give_back, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
STRIDE = 48
SURE = 0.9
LABELS = 1 + 2 * len(KINDS)

# The base patterns; fixed values. The email pattern is split at its @ sign, see ``base_spans``.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.I)
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """The base spans of a text by start, then kind. The part of an email before the @ is taken from there backwards:
    no character of it is tried twice, and the leftmost match is the same."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, text: str) -> bool:
    """The check of an added span."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[\w-]+(?: ?(?:\.|[\[(] ?(?:dot|\.) ?[\])]) ?[\w-]+)+", text, re.I))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text)
        return bool(re.fullmatch(r"[0-9]+(?:[\[(]?\.[\])]?[0-9]+){3}", text)) and all(map(_byte, parts))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ .·-]{0,2}[0-9])+", text)) and 14 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[(+]?[0-9][ ()./0-9-]*[0-9]", text)) and 10 <= len(digits) <= 15 and bool(re.search(r"[ ()/-]", text))


# ---- labelled examples


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _number(r, r.choice((13, 14, 14, 14, 15)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _personal(r: random.Random, kind: str) -> str:
    """One piece of personal data, in a strict or a looser spelling."""
    name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    if kind == "email":
        host, top = "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8))) + r.choice(("", "", "8", "24")), r.choice(("com", "org", "net", "example.com", "de", "co.uk"))
        local = name + r.choice(("", ".", "_", "-", "+")) .join(("", r.choice(("", _number(r, 2), name[:3]))))
        if r.random() < 0.08:  # long ones
            more = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(r.randint(2, 8))]
            keep = r.randint(0, len(more))
            local, host = r.choice((".", "_", "-", "")).join([local, *more[:keep]]), ".".join([*more[keep:], host])
        at, dot = r.choice((("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", ".")))
        return (local.strip("._-+") or name) + at + (host + "." + top).replace(".", dot)
    if kind == "ip":
        return r.choice((".", ".", ".", "[.]", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        n, sep = _card(r), r.choice(("", "", " ", "-", ".", " - "))
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4))
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    country = r.choice(("+1 ", "+44 ", "+49-", "+33 ", "001 ", "0049 ", "", "", ""))
    return country + r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"({a}) {b} {c}", f"({a}){b}-{c}"))


def _plain(r: random.Random) -> str:
    """Digits and signs that are not personal data."""
    return r.choice((
        lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}", lambda: f"${r.randint(1, 999)},{_number(r, 3)}.{_number(r, 2)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 18, 32, 40)))), lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1950, 2030)}",
        lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}", lambda: f"{r.randint(1, 100)}%", lambda: f"({r.randint(1, 99)})", lambda: f"[{r.randint(1, 99)}]", lambda: _number(r, r.randint(1, 9)),
        lambda: _number(r, 13), lambda: f"{r.randint(100, 999)} {r.randint(100, 999)}", lambda: f"{r.randint(1, 400)}-{r.randint(401, 999)}", lambda: "@" + "".join(r.choice("abcdefghij") for _ in range(6)), lambda: " ".join(str(r.randint(0, 99)) for _ in range(r.randint(3, 9))),
        lambda: f"978-{_number(r, 1)}-{_number(r, 4)}-{_number(r, 4)}-{_number(r, 1)}", lambda: "*** $$$ &&& ###"[: r.randint(3, 15)], lambda: f"at {r.randint(1, 12)}",
    ))()


_LETTERS = ("etaoinshrdlucmfwypvbgk", "aeioudlnrstmc", "enistradhulcgmobäöüß", "esaitnrulodcpmévàèç")


def _word(r: random.Random) -> str:
    letters = r.choice(_LETTERS)
    w = "".join(r.choice(letters) for _ in range(r.randint(1, 10)))
    return (w.capitalize() if r.random() < 0.15 else w) + r.choice(("", "", "", "", "", "", ",", ".", ".\n"))


def examples(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``n`` labelled windows: character classes and labels, of shape (n, WINDOW)."""
    r = random.Random(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, label = "", []
        while len(text) < 2 * WINDOW:
            p = r.random()
            kind = r.randrange(len(KINDS)) if p < 0.14 else -1
            piece = _personal(r, KINDS[kind]) if kind >= 0 else _plain(r) if p < 0.28 else _word(r)
            label += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if kind >= 0 else [0] * len(piece)
            tail = r.choice((" ", " ", " ", " ", ". ", ", ", "\n", ") ", "; "))
            text += piece + tail
            label += [0] * len(tail)
        cut = r.randint(0, WINDOW)
        x[i], y[i] = classes(text[cut : cut + WINDOW]), label[cut : cut + WINDOW]
    return x, y


def classes(text: str) -> np.ndarray:
    """A class for each character: ASCII characters by themselves, other letters, digits, spaces and the rest as four."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where(code < 128, code, 131)
    for i in np.flatnonzero(code >= 128).tolist():
        c = text[i]
        out[i] = 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
    return out


PAD = 132
CLASSES = 133


# ---- the tagger


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Parameters: embedding; input, recurrent weights and bias for both directions; output; transitions and start."""

    def __init__(self, hidden: int = 32, width: int = 16, seed: int = 3):
        r = np.random.default_rng(seed)
        make = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "embed": make(CLASSES, width, scale=0.5), "wx": make(2, width, 4 * hidden, scale=width**-0.5), "wh": make(2, hidden, 4 * hidden, scale=hidden**-0.5),
            "b": np.zeros((2, 1, 4 * hidden), np.float32), "wo": make(2 * hidden, LABELS, scale=hidden**-0.5), "bo": np.zeros(LABELS, np.float32),
            "trans": np.zeros((LABELS, LABELS), np.float32), "start": np.zeros(LABELS, np.float32),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0  # forget gates start open

    def run(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Emissions (B, T, LABELS) of classes (B, T), and what the gradient needs."""
        p, n = self.p, self.hidden
        size, steps = x.shape
        both = np.stack([x, x[:, ::-1]])
        e = p["embed"][both]
        given = np.matmul(e.reshape(2, size * steps, -1), p["wx"]).reshape(2, size, steps, 4 * n) + p["b"][:, :, None]
        h, c = np.zeros((2, size, n), np.float32), np.zeros((2, size, n), np.float32)
        hs, cs, gates = np.zeros((steps + 1, 2, size, n), np.float32), np.zeros((steps + 1, 2, size, n), np.float32), np.zeros((steps, 2, size, 4 * n), np.float32)
        for t in range(steps):
            z = given[:, :, t] + np.matmul(h, p["wh"])
            z[..., : 3 * n] = _sigmoid(z[..., : 3 * n])
            z[..., 3 * n :] = np.tanh(z[..., 3 * n :])
            c = z[..., n : 2 * n] * c + z[..., :n] * z[..., 3 * n :]
            h = z[..., 2 * n : 3 * n] * np.tanh(c)
            hs[t + 1], cs[t + 1], gates[t] = h, c, z
        out = np.concatenate([hs[1:, 0], hs[1:, 1][::-1]], -1).transpose(1, 0, 2)
        return out @ p["wo"] + p["bo"], {"both": both, "e": e, "hs": hs, "cs": cs, "gates": gates, "out": out}

    def back(self, d: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        """Gradients of the parameters below the emissions, from those of the emissions."""
        p, n = self.p, self.hidden
        hs, cs, gates, out = kept["hs"], kept["cs"], kept["gates"], kept["out"]
        steps, size = len(gates), d.shape[0]
        g = {"wo": out.reshape(-1, 2 * n).T @ d.reshape(-1, LABELS), "bo": d.sum((0, 1))}
        down = (d @ p["wo"].T).transpose(1, 0, 2)
        down = np.stack([down[..., :n], down[::-1, :, n:]], 1)  # steps, 2, size, n
        dh, dc, dz = np.zeros((2, size, n), np.float32), np.zeros((2, size, n), np.float32), np.zeros_like(gates)
        back = p["wh"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, u = (gates[t][..., k * n : (k + 1) * n] for k in range(4))
            dh = dh + down[t]
            tc = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[t]
            z[..., :n], z[..., n : 2 * n] = dc * u * i * (1 - i), dc * cs[t] * f * (1 - f)
            z[..., 2 * n : 3 * n], z[..., 3 * n :] = dh * tc * o * (1 - o), dc * i * (1 - u * u)
            dc = dc * f
            dh = np.matmul(z, back)
        flat = dz.transpose(1, 2, 0, 3).reshape(2, size * steps, 4 * n)  # as ``e`` is laid out
        g["wh"] = np.matmul(hs[:-1].transpose(1, 2, 0, 3).reshape(2, size * steps, n).transpose(0, 2, 1), flat)
        g["wx"] = np.matmul(kept["e"].reshape(2, size * steps, -1).transpose(0, 2, 1), flat)
        g["b"] = flat.sum(1, keepdims=True)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], kept["both"].reshape(-1), np.matmul(flat, p["wx"].transpose(0, 2, 1)).reshape(-1, p["embed"].shape[1]))
        return g

    def forward_backward(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log partition, log forward, log backward) of the chain."""
        size, steps, _ = em.shape
        a, b = np.zeros_like(em), np.zeros_like(em)
        a[:, 0] = self.p["start"] + em[:, 0]
        for t in range(1, steps):
            a[:, t] = _lse(a[:, t - 1, :, None] + self.p["trans"], 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            b[:, t] = _lse(self.p["trans"] + (em[:, t + 1] + b[:, t + 1])[:, None], 2)
        return _lse(a[:, -1], 1), a, b

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a character, and its gradients."""
        em, kept = self.run(x)
        logz, a, b = self.forward_backward(em)
        size, steps, _ = em.shape
        rows, cols = np.arange(size)[:, None], np.arange(steps)[None]
        marginal = np.exp(a + b - logz[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + self.p["trans"] + (em[:, 1:] + b[:, 1:])[:, :, None] - logz[:, None, None, None]).sum((0, 1))
        gold = self.p["start"][y[:, 0]] + em[rows, cols, y].sum(1) + self.p["trans"][y[:, :-1], y[:, 1:]].sum(1)
        d = marginal
        start = marginal[:, 0].sum(0)
        d[rows, cols, y] -= 1
        np.add.at(pair, (y[:, :-1], y[:, 1:]), -1)
        np.add.at(start, y[:, 0], -1)
        scale = np.float32(1 / x.size)
        g = self.back(d.astype(np.float32) * scale, kept)
        g["trans"], g["start"] = pair.astype(np.float32) * scale, start.astype(np.float32) * scale
        return float((logz - gold).sum() * scale), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        r, m, v, losses, t = np.random.default_rng(seed), {}, {}, [], 0
        total = epochs * (len(x) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x) - batch + 1, batch):
                loss, g = self.step(x[order[i : i + batch]], y[order[i : i + batch]])
                norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
                t += 1
                lr = rate * (1 - t / (total + 1)) + 1e-4
                for k, d in g.items():
                    d = d * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * d, 0.99 * v.get(k, 0) + 0.01 * d * d
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
                losses.append(loss)
        return losses

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.run(x)[0]

    def decode(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best path, its labels' posterior probabilities) of sequences of emissions (B, T, LABELS)."""
        em = em.astype(np.float64)  # sums over long runs
        size, steps, _ = em.shape
        best, came = self.p["start"] + em[:, 0], np.zeros(em.shape, np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + self.p["trans"]
            came[:, t] = s.argmax(1)
            best = s.max(1) + em[:, t]
        path = np.zeros((size, steps), np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = came[np.arange(size), t, path[:, t]]
        logz, a, b = self.forward_backward(em)
        sure = np.exp(a + b - logz[:, None, None])[np.arange(size)[:, None], np.arange(steps)[None], path]
        return path, sure


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@lru_cache(1)
def trained(n: int = 16_000, epochs: int = 3, seed: int = 7) -> Tagger:
    """The tagger, trained on ``n`` generated windows; the same in every process."""
    tagger = Tagger()
    tagger.fit(*examples(n, seed), epochs=epochs)
    return tagger


def windows(text: str) -> list[int]:
    """Starts of the windows that can yield a span."""
    last = _last(text)
    hit = {k for m in _TRIGGER.finditer(text) for k in range(max(0, (m.start() - WINDOW) // STRIDE + 1), min(last, m.start() // STRIDE) + 1)}
    return [k * STRIDE for k in sorted(hit)]


def _last(text: str) -> int:
    """The number of the text's last window."""
    return max(0, -(-(len(text) - WINDOW) // STRIDE))


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first window, last window) in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Free:
    """Which places base spans, and spans added so far from left to right, leave free."""

    def __init__(self, base: list[Span]):
        self.starts, self.ends = [], []
        for a, b in sorted((a, b) for _, a, b in base):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)
        self.last = 0

    def take(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        if a < self.last or (i and self.ends[i - 1] > a):
            return False
        self.last = b
        return True


_BEFORE = re.compile(r"[\w.%+-]")
_AFTER = re.compile(r"\w|[.-](?=\w)")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r" ?(?:@|[\[(] ?at ?[\])])", re.I)


def grown(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """The span up to the ends of the words or numbers it cuts."""
    before, after = (_BEFORE, _AFTER) if kind == "email" else (_DIGIT, _DIGIT)
    while a > 0 and before.match(text, a - 1):
        a -= 1
    while b < len(text) and after.match(text, b):
        b += 1
    if kind == "email" and (sign := _AT.search(text, a, b)):
        # what stands before the local part is none of it
        local = sign.start()
        while local > a and before.match(text, local - 1):
            local -= 1
        a = local if local < sign.start() else a
    return a, b


def spans_of(text: str, begin: int, path: np.ndarray, sure: np.ndarray, free: _Free) -> list[Span]:
    """Spans that a decoded run from ``begin`` on adds."""
    out, size = [], min(len(path), len(text) - begin)
    path = path[:size]
    starts = np.flatnonzero(path % 2 == 1)  # B labels are odd
    if not len(starts):
        return out
    # a span goes on while the label is the I of its kind
    change = np.append(np.flatnonzero(path[1:] != path[:-1]) + 1, size)
    for i in starts.tolist():
        j = i + 1
        if j < size and path[j] == path[i] + 1:
            j = int(change[np.searchsorted(change, j, "right")])
        kind = KINDS[(path[i] - 1) // 2]
        if sure[i:j].mean() >= SURE:
            a, b = grown(text, kind, begin + i, begin + j)
            if plausible(kind, text[a:b]) and free.take(a, b):
                out.append((kind, a, b))
    return out


def stitched(em: np.ndarray) -> np.ndarray:
    """Emissions of a run of windows (n, WINDOW, LABELS) as those of its characters, each from the window where it is most
    central."""
    side = (WINDOW - STRIDE) // 2
    parts = [em[i, side if i else 0 : WINDOW if i == len(em) - 1 else side + STRIDE] for i in range(len(em))]
    return np.concatenate(parts)


def added_spans(texts: list[str], bases: list[list[Span]], tagger: Tagger, most: int = 256) -> list[list[Span]]:
    """Spans that the tagger adds to each text's base spans."""
    runs = [_joined([(s // STRIDE, s // STRIDE) for s in windows(t)]) for t in texts]
    seen: dict[tuple[int, int], np.ndarray] = {}
    done: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    todo = [(i, a, b) for i, own in enumerate(runs) for a, b in own]
    while todo:
        new = [(i, k) for i, a, b in todo for k in range(a, b + 1) if (i, k) not in seen]
        for at in range(0, len(new), most):
            part = new[at : at + most]
            x = np.full((len(part), WINDOW), PAD)
            for row, (i, k) in enumerate(part):
                piece = texts[i][k * STRIDE : k * STRIDE + WINDOW]
                x[row, : len(piece)] = classes(piece)
            seen.update(zip(part, tagger.emissions(x)))
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for run in todo:
            by_size.setdefault(run[2] - run[1], []).append(run)
        again: set[int] = set()
        for size, own in sorted(by_size.items()):
            together = max(1, most // (size + 1))
            for at in range(0, len(own), together):
                part = own[at : at + together]
                path, sure = tagger.decode(np.stack([stitched(np.stack([seen[i, k] for k in range(a, b + 1)])) for i, a, b in part]))
                for run, p, q in zip(part, path, sure):
                    (i, a, b), done[run] = run, (p, q)
                    # a span that touches an inner end may go on: twice as long a run tells
                    last = _last(texts[i])
                    longer = (max(0, a - (b - a + 1)) if p[0] else a, min(last, b + (b - a + 1)) if p[-1] else b)
                    if longer != (a, b):
                        runs[i] = [longer if r == (a, b) else r for r in runs[i]]
                        again.add(i)
        for i in again:
            runs[i] = _joined(runs[i])
        todo = [(i, a, b) for i in sorted(again) for a, b in runs[i] if (i, a, b) not in done]
    out = []
    for i, text in enumerate(texts):
        free, spans = _Free(bases[i]), []
        for a, b in runs[i]:
            spans += spans_of(text, a * STRIDE, *done[i, a, b], free)
        out.append(spans)
    return out


def _map(docs: DataFrame, columns: list[str], schema: str, make, tagger: Tagger | None) -> DataFrame:
    """``columns`` of ``docs`` and what ``make(texts, base spans, all spans)`` returns."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):  # a window's emissions take some 3 kB
                column = pc.fill_null(part.column("text"), "")
                hit = np.flatnonzero(np.asarray(pc.match_substring_regex(column, _TRIGGER.pattern, ignore_case=True)))
                texts = column.take(pa.array(hit)).to_pylist()
                found = [base_spans(t) for t in texts]
                added = added_spans(texts, found, shared.value)
                base, every = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for i, b, a in zip(hit.tolist(), found, added):
                    base[i], every[i] = b, sorted(b + a, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                names, arrays = make(part, base, every)
                yield pa.record_batch([*(part.column(c) for c in columns), *arrays], names=[*columns, *names])
        give_back()

    return docs.mapInArrow(work, schema)


def _ddl(docs: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` (text, ...) with base and spans (all): arrays of (kind, start, end)."""
    docs = docs.drop("base", "spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make(part, base, every):
        return ["base", "spans"], [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in x], kind) for x in (base, every)]

    ddl = "array<struct<kind: string, start: int, end: int>>"
    return _map(docs, docs.columns, f"{_ddl(docs, docs.columns)}, base {ddl}, spans {ddl}", make, tagger)


def digests(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone: base spans by kind, base_sha256, spans: all)."""

    def make(part, base, every):
        counts = [pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in KINDS]
        sha = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
        return [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"], [*counts, pa.array(sha), pa.array([joined(row) for row in every])]

    schema = f"{_ddl(docs, ['doc_id'])}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return _map(docs.select("doc_id", "text"), ["doc_id"], schema, make, tagger)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with its personal data masked in text; null stays null."""
    columns = [c for c in docs.columns if c != "text"]

    def make(part, base, every):
        texts = part.column("text").to_pylist()
        return ["text"], [pa.array([t if not s else masked(t, s) for t, s in zip(texts, every)], pa.string())]

    return _map(docs, columns, ", ".join(x for x in (_ddl(docs, columns), "text string") if x), make, tagger).select(*docs.columns)
