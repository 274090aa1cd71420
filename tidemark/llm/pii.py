"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The tagger is trained here in numpy (backpropagation through time, forward-backward over the CRF, Adam) from labelled spans of
seeded sentences: addresses, numbers and look-alikes that are no personal data. It reads every text whole, in windows of WINDOW
characters that overlap by 2 * MARGIN; all windows go through the network and the CRF. A character takes its tag from the window
in which it lies nearest the middle, so the tags of a whole text are one sequence, and spans come from that. A span is added if
it may be what its tag says (plausible(): an address has a sign and a dot, four numbers have three dots, a card passes Luhn, numbers have their digits), stands
apart from what is beside it, and overlaps no span of the patterns.

Gates, candidates and the cell's output are straight lines cut at both ends (the "hard" sigmoid and tanh), in training as in use,
since a true tanh takes longer than all products where numpy has no AVX-512. A text's end is its last window's end: beyond it the
network isn't run, as the backward direction's state there is known; a test holds this equal to running it over a padded window.

Viterbi's recursion runs over every window; the way back is noted only where its best score is above that of no span at all
(Tagger.outside()); a test holds this equal to noting it everywhere.

On sentences of another generator, with words, names and formats that the training has not (tests/llm/test_pii.py), the spans that
the patterns miss are found with a precision and a recall of 0.95 to 1.00 for each kind; the test holds both above 0.9.

Defined cases: a null text is an empty text. Repeated rows get equal spans. A null doc_id is a document like any other. An empty
table gives an empty table. Texts of any length are read whole, in time linear in their length. Only doc_id and text are
read, so other columns can't clash. Places are code points, the end exclusive; matches of one kind don't overlap.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
WINDOW, MARGIN = 512, 32
STRIDE = WINDOW - 2 * MARGIN
BATCH = 1024  # windows that go through the network side by side
_CHARS, _EMBED, _HIDDEN, _TAGS = 130, 12, 16, 1 + 2 * len(KINDS)
#: Gates and candidates (the last) are straight lines of these slopes and shifts, cut at these least values and at 1.
_SLOPE, _SHIFT, _LEAST = (np.repeat(np.array(x, np.float32), _HIDDEN) for x in ((1 / 6, 1 / 6, 1 / 6, 2 / 3), (0.5, 0.5, 0.5, 0), (0, 0, 0, -1)))
_trained: list[Tagger] = []
Span = tuple[int, int, int]  # start, rank of the kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"@|\bat\b", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, each kind leftmost first. A match that fails its test is dropped and not tried again."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # the local part is the run of its characters before the sign
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out)


#: Syllables and words of the training sentences.
_STARTS, _CORES, _ENDS = "b c d f g h j k l m n p q r s t v w x y z ch st tr".split(), "a e i o u y é ü ó ei ou".split(), ["", "", "", "n", "r", "s", "l", "x", "y", "nt", "ß", "ck"]
_WORDS = "the and of to in is at on for with der die und das les des que con por para una at dot mail call phone card pay write number order see table page fig no".split()
_TLDS = "com net org de fr es io edu info co.uk example.com".split()


def sentences(seed: int, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tags) of n labelled windows: words, spans of each kind and look-alikes without a label."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    one = lambda *xs: rng.choice(xs)

    def word() -> str:
        r = rng.random()
        w = rng.choice(_WORDS) if r < 0.25 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 10))) if r < 0.35 else "".join(rng.choice(_STARTS) + rng.choice(_CORES) + rng.choice(_ENDS) for _ in range(rng.choice((1, 2, 2, 3))))
        return w.upper() if rng.random() < 0.03 else w.capitalize() if rng.random() < 0.2 else w

    def name() -> str:
        w = "".join(c for c in word() if c.isascii())[: rng.choice((1, 4, 8, 12))] or "x"
        return w if rng.random() < 0.2 else w.lower()

    def email() -> str:
        local = one("", "", "", ".", "_", "-", "+").join(name() for _ in range(rng.choice((1, 2, 2, 3)))) + (digits(rng.choice((1, 2, 2, 4))) if rng.random() < 0.35 else "")
        hosts = [name() + (digits(1) if rng.random() < 0.2 else "") for _ in range(rng.choice((1, 1, 1, 2)))]
        sign = one("@", "@", " (at) ", "(at)", " [at] ", "[at]", " @ ", " at ", "{at}", " AT ", " (AT) ", "[@]", "(@)")
        dot = one(" dot ", " (dot) ", "[dot]", " DOT ", "(dot)") if "at" in sign.lower() and (sign.lower() == " at " or rng.random() < 0.3) else one("[.]", " . ", ".") if rng.random() < 0.1 else "."
        return (local if rng.random() < 0.8 else local.replace(".", dot)) + sign + dot.join([*hosts, *rng.choice(_TLDS).split(".")])

    def ip() -> str:
        sep = one(".", ".", "[.]", "[.]", " . ", "(.)", " dot ", "[dot]")
        return sep.join(str(rng.choice((rng.randrange(256), 0, 1, 10, 127, 192, 168))) for _ in range(4))

    def card() -> str:
        d = one("4", "51", "52", "55", "37", "6011", "34") + digits(14)
        d = d[: 14 if d[:2] in ("37", "34") else 15]
        d += next(c for c in "0123456789" if luhn(d + c))
        cuts = (4, 10, 15) if len(d) == 15 else (4, 8, 12, 16)
        return one("", " ", "-", ".", "/", "  ", " - ", "_").join(d[a:b] for a, b in zip((0, *cuts), cuts, strict=False))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        local = one(f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(3)}/{digits(6)}", f"0{digits(3)}-{digits(7)}", f"0{digits(4)} {digits(6)}")
        lead = one("", "", "", "+1 ", f"+{digits(2)} ", f"00{digits(2)} ", "1-", f"+{digits(2)}-", "001-")
        return lead + local

    def other() -> str:
        k = digits(rng.randint(1, 8))
        return one(
            k, k, f"{k}.{digits(2)}", f"{digits(1)},{digits(3)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{one('19', '20')}{digits(2)}-0{digits(1)}-{one('1', '2')}{digits(1)}", f"{digits(2)}/{digits(2)}/{one('19', '20')}{digits(2)}", f"{digits(2)}.{digits(2)}.{one('19', '20')}{digits(2)}",
            f"{one('19', '20')}{digits(2)}-{one('19', '20')}{digits(2)}", f"{one('19', '20')}{digits(2)}{digits(2)}{digits(2)}", "".join(rng.choices("0123456789abcdef", k=rng.choice((8, 16, 32, 40)))), "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
            f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(4)}", f"${k}", f"{digits(2)}%", f"@{name()}", f"{name()} @ {digits(2)}", f"{digits(1)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", digits(rng.randint(9, 12)), digits(rng.randint(20, 30)),
            f"#{k}", f"97{one('8', '9')}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"({digits(2)})", f"{digits(2)}x{digits(2)}x{digits(2)}", f"{name()}-{digits(3)}-{digits(3)}", f"{digits(3)} {digits(3)}", f"{digits(2)} {digits(1)} {digits(2)}", f"at {name()}.{rng.choice(_TLDS)}", f"{name()} at {name()}",
            f"https://{name()}.{rng.choice(_TLDS)}/{name()}", f"www.{name()}.{rng.choice(_TLDS)}", f"{name()}.{name()}", f"look at {name()}", f"{word()} dot {word()}", f"{word()} at the dot {word()}", f"{word()} (at {name()})", f"{name()}={k}", f"{digits(4)} {digits(4)}", f"{digits(3)}-{digits(4)}", f"{digits(2)}.{digits(2)}", f"[{k}]", "|" * rng.randint(1, 5), "###", "...", "{" + name() + "}", "<" + name() + ">",
        )

    makers = (email, ip, card, phone)
    chars, tags = np.zeros((n, size), dtype=np.int64), np.zeros((n, size), dtype=np.int64)
    for i in range(n):
        text = "etaoin shrdlu 01.23-4@"[rng.randrange(22) :][: rng.randrange(6)]  # a window may start anywhere
        tag = [0] * len(text)
        length = rng.choice((size, size, size, rng.randint(1, size)))
        while len(text) < length:
            r = rng.random()
            kind = rng.randrange(4) if r < 0.22 else -1
            s = makers[kind]() if kind >= 0 else other() if r < 0.42 else word()
            lead = one("", "", "", "(", '"', "<", ": ", "=") if r < 0.3 else ""
            tail = one(" ", " ", " ", ", ", ". ", ") ", "\n", "; ", '" ', ": ") if r < 0.42 else one(" ", " ", " ", " ", " ", ", ", ". ", ".\n", ": ", "! ")
            text += lead + s + tail
            tag += [0] * len(lead) + ([1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1) if kind >= 0 else [0] * len(s)) + [0] * len(tail)
        got = codes(text)[:length]
        chars[i, : len(got)], tags[i, : len(got)] = got, tag[:length]
    return chars, tags


def codes(text: str) -> np.ndarray:
    """Each character's number for the tagger: ASCII has its own numbers, the rest one; 0 is outside the text."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64), 128) + 1


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Bidirectional LSTM over characters with piecewise linear gates, a linear layer, and CRF transitions between tags."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": init(_CHARS, _EMBED) * 4, "out": init(2 * _HIDDEN, _TAGS), "bias": np.zeros(_TAGS, np.float32), "trans": np.zeros((_TAGS, _TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(_EMBED, 4 * _HIDDEN), f"h{d}": init(_HIDDEN, 4 * _HIDDEN), f"c{d}": np.zeros(4 * _HIDDEN, np.float32)}
            self.p[f"c{d}"][_HIDDEN : 2 * _HIDDEN] = 1  # forget gates start open
        self._ended = np.zeros((2, 1, _HIDDEN), np.float32)

    def _run(self, e: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction over e (time, batch, embedding); what backpropagation needs goes to `keep`."""
        z0 = e @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((e.shape[1], _HIDDEN), np.float32)
        out = np.empty((len(e), e.shape[1], _HIDDEN), np.float32)
        for t in range(len(e)):
            s = np.clip((z0[t] + h @ self.p[f"h{d}"]) * _SLOPE + _SHIFT, _LEAST, 1)
            i, f, o, g = (s[:, k * _HIDDEN : (k + 1) * _HIDDEN] for k in range(4))
            before, was = c, h
            c = f * c + i * g
            tc = np.clip(c / 1.5, -1, 1)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, g, before, tc, was, ((s > _LEAST) & (s < 1)) * _SLOPE))
        return out

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """(time, batch, tag) scores of chars (batch, time)."""
        e = self.p["emb"][chars.T]
        return np.concatenate([self._run(e, "f"), self._run(e[::-1], "b")[::-1]], axis=2) @ self.p["out"] + self.p["bias"]

    def _back(self, e: np.ndarray, d: str, keep: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dz = np.empty((len(e), e.shape[1], 4 * _HIDDEN), np.float32)
        dh = dc = np.zeros((e.shape[1], _HIDDEN), np.float32)
        for t in range(len(e) - 1, -1, -1):
            i, f, o, g, before, tc, was, slope = keep[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (np.abs(tc) < 1) / 1.5
            dz[t] = np.concatenate([dc * g, dc * before, dh * tc, dc * i], axis=1) * slope
            grad[f"h{d}"] += was.T @ dz[t]
            dh, dc = dz[t] @ self.p[f"h{d}"].T, dc * f
        grad[f"x{d}"] += np.tensordot(e, dz, ([0, 1], [0, 1]))
        grad[f"c{d}"] += dz.sum(axis=(0, 1))
        return dz @ self.p[f"x{d}"].T

    def step(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of a batch, and its gradients."""
        e = self.p["emb"][chars.T]
        kf, kb = [], []
        hidden = np.concatenate([self._run(e, "f", kf), self._run(e[::-1], "b", kb)[::-1]], axis=2)
        u, a = hidden @ self.p["out"] + self.p["bias"], self.p["trans"]
        n, b = u.shape[:2]
        alpha, beta = np.empty_like(u), np.zeros_like(u)
        alpha[0] = u[0]
        for t in range(1, n):
            alpha[t] = u[t] + _logsum(alpha[t - 1][:, :, None] + a, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = _logsum(a + (u[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        y = tags.T
        hot = np.eye(_TAGS, dtype=np.float32)[y]
        loss = (z - (u * hot).sum(axis=(0, 2)) - a[y[:-1], y[1:]].sum(axis=0)).mean()
        du = (np.exp(alpha + beta - z[:, None]) - hot) / b
        pairs = np.exp(alpha[:-1, :, :, None] + a + (u[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (y[:-1], y[1:]), 1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["trans"], grad["bias"] = pairs / b, du.sum(axis=(0, 1))
        grad["out"] = np.tensordot(hidden, du, ([0, 1], [0, 1]))
        dhid = du @ self.p["out"].T
        de = self._back(e, "f", kf, dhid[:, :, :_HIDDEN], grad) + self._back(e[::-1], "b", kb, dhid[::-1, :, _HIDDEN:], grad)[::-1]
        np.add.at(grad["emb"], chars.T, de)
        return float(loss), grad

    def _direction(self, d: str, at: np.ndarray, counts: np.ndarray, u: np.ndarray, ended: np.ndarray) -> np.ndarray:
        """One direction over at (time, batch), added to u (time, tag, batch). counts[t]: how many of the windows, which are
        longest first, are run at time t; in the backward direction the others come in with the state that `ended` has for
        the characters before. Returns the last states,
        which are 1.5 times the plain ones, and cells."""
        weights = np.concatenate([self.p[f"h{d}"] / 1.5, self.p[f"x{d}"], self.p[f"c{d}"][None]]) * _SLOPE
        weights[-1] += _SHIFT
        out = (self.p["out"][:_HIDDEN] if d == "f" else self.p["out"][_HIDDEN:]) / 1.5
        weights, out, emb = (np.ascontiguousarray(w.T, np.float32) for w in (weights, out, self.p["emb"]))
        x, c, m = np.zeros((_HIDDEN + _EMBED + 1, 0), np.float32), np.zeros((_HIDDEN, 0), np.float32), 0
        for t in range(len(at)) if d == "f" else range(len(at) - 1, -1, -1):
            if not counts[t]:
                continue
            if counts[t] != m:  # arrays without gaps, as these are the fastest
                before, m = (x, c), int(counts[t])
                x, c, keep = np.zeros((len(x), m), np.float32), np.zeros((_HIDDEN, m), np.float32), min(m, c.shape[1])
                x[-1], h, e = 1, x[:_HIDDEN], x[_HIDDEN:-1]  # what a constant, the state and the character bring
                if d == "b":
                    h[:], c[:] = ended[:, len(at) - 1 - t, :, None]
                h[:, :keep], c[:, :keep] = before[0][:_HIDDEN, :keep], before[1][:, :keep]
                z, s, said = (np.empty((k, m), np.float32) for k in (4 * _HIDDEN, _HIDDEN, _TAGS))
                gates, (i, f, o, g) = z[: 3 * _HIDDEN], (z[k * _HIDDEN : (k + 1) * _HIDDEN] for k in range(4))
            e[:] = emb.take(at[t, :m], axis=1)
            np.matmul(weights, x, out=z)
            gates.clip(0, 1, out=gates)
            g.clip(-1, 1, out=g)
            np.multiply(i, g, out=s)
            c *= f
            c += s
            c.clip(-1.5, 1.5, out=s)
            np.multiply(s, o, out=h)
            u[t, :, :m] += np.matmul(out, h, out=said)
        return np.stack([x[:_HIDDEN], c])

    def _after_end(self, n: int) -> np.ndarray:
        """States and cells (2, step, hidden) of the backward direction after 0 to n characters outside the text, or more."""
        while self._ended.shape[1] <= n:
            last = self._ended[:, -1:]
            step = self._direction("b", np.zeros((1, 1), dtype=np.int64), np.ones(1, dtype=np.int64), np.zeros((1, _TAGS, 1), np.float32), last)
            self._ended = np.concatenate([self._ended, step.transpose(0, 2, 1)], axis=1)
        return self._ended

    def fast_emissions(self, chars: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """What emissions() gives, as (time, tag, batch). `ends`: where the text ends in each window, longest first; little
        beyond is run, as the backward direction's state at an end is known, and the result holds as far as the ends."""
        b, n = chars.shape
        at, u = np.ascontiguousarray(chars.T).astype(np.int64), np.empty((n, _TAGS, b), np.float32)
        u[:] = self.p["bias"].astype(np.float32)[:, None]
        counts = np.full(n, b) if ends is None else np.minimum(-(-_reached(ends, n) // 16) * 16, b)
        for d in "fb":
            self._direction(d, at, counts, u, self._after_end(n))
        return u

    def outside(self, u: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """The windows of u (time, tag, batch) whose best path is all 'outside': no path scores more than that one does."""
        a, m = np.ascontiguousarray(self.p["trans"].astype(np.float32)[:, :, None]), u.shape[2]
        best, plain, s, out = u[0].copy(), u[0, 0].copy(), np.empty((_TAGS, _TAGS, m), np.float32), np.ones(m, dtype=bool)
        counts = np.full(len(u), m) if ends is None else _reached(ends, len(u))
        for t in range(1, len(u)):
            if counts[t] != m:
                out[counts[t] : m] = (best.max(axis=0) <= plain)[counts[t] :]
                m = int(counts[t])
                best, plain, s = np.ascontiguousarray(best[:, :m]), plain[:m], np.empty((_TAGS, _TAGS, m), np.float32)
                if not m:
                    break
            np.add(best[:, None, :], a, out=s)  # from, to, window
            best = s.max(axis=0)
            best += u[t, :, :m]
            plain = plain + a[0, 0] + u[t, 0, :m]
        out[:m] = best.max(axis=0) <= plain
        return out

    def searched(self, chars: np.ndarray, ends: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The rows of chars (batch, time) that are not outside() as far as their ends, longest first, and their emissions
        (time, tag, row). `every`: all rows."""
        u = self.fast_emissions(chars, ends)
        some = np.arange(len(chars)) if every else np.flatnonzero(~self.outside(u, ends))
        return some, np.ascontiguousarray(u[:, :, some])

    def best(self, ends: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The best tags (row, time) for emissions u (time, tag, row), which hold as far as the ends, longest first."""
        n, a = len(u), self.p["trans"].astype(np.float32)
        best, back, counts = u[0].copy(), np.empty(u.shape, dtype=np.int8), _reached(ends, n)
        back[:] = np.arange(_TAGS, dtype=np.int8)[:, None]  # beyond an end nothing changes
        for t in range(1, n):
            m = counts[t]
            s = best[:, None, :m] + a[:, :, None]  # from, to, row
            back[t, :, :m] = s.argmax(axis=0)
            best[:, :m] = u[t, :, :m] + s.max(axis=0)
        tags, rows = np.empty((n, len(ends)), dtype=np.int8), np.arange(len(ends))
        tags[-1] = best.argmax(axis=0)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t][tags[t], rows]
        tags[np.arange(n)[:, None] >= ends] = 0
        return tags.T

    def viterbi(self, chars: np.ndarray, every: bool = False) -> np.ndarray:
        """The best tags (batch, time) of chars (batch, time). `every`: search all windows, those that are outside() too."""
        out, ends = np.zeros(chars.shape, dtype=np.int8), np.full(len(chars), chars.shape[1])
        some, u = self.searched(chars, ends, every)
        out[some] = self.best(ends[some], u)
        return out


def _reached(ends: np.ndarray, n: int) -> np.ndarray:
    """How many windows go beyond each time below n, for ends that fall."""
    return np.searchsorted(-ends, -np.arange(n), side="left")


@functools.lru_cache(maxsize=4)
def train(seed: int = 6, steps: int = 2500, batch: int = 64, size: int = 96) -> Tagger:
    """A tagger trained with Adam on `steps` batches of labelled windows; its weights are means over the last fifth."""
    tagger = Tagger(seed)
    chars, tags = sentences(seed, 200 * batch, size)
    m, v = ({k: np.zeros_like(x) for k, x in tagger.p.items()} for _ in range(2))
    rng, last, mean = np.random.default_rng(seed), steps // 5, {k: np.zeros(x.shape) for k, x in tagger.p.items()}
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(chars), batch)
        _, grad = tagger.step(chars[rows], tags[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1, t / 20) * (1 - 0.9 * t / steps)
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            tagger.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            if t > steps - last:
                mean[k] += tagger.p[k] / last
    tagger.p = {k: x.astype(np.float32) for k, x in mean.items()}
    return tagger


def trained(spark: SparkSession) -> Tagger:
    """The tagger, trained once for each driver by a task, whose numpy has one thread as Spark sets it; some hundred kB of weights."""
    if not _trained:
        rows = spark.range(1, numPartitions=1).mapInPandas(lambda frames: (pd.DataFrame({"p": [pickle.dumps(train().p)]}) for _ in frames), "p binary")
        tagger = Tagger()
        tagger.p = pickle.loads(rows.first()[0])
        _trained.append(tagger)
    return _trained[0]


def tag_texts(tagger: Tagger, texts: list[str], every: bool = False) -> list[np.ndarray]:
    """The tags of each text, reconciled over its windows. `every`: as in Tagger.viterbi."""
    out, windows, places = [], [], []
    for k, text in enumerate(texts):
        c = codes(text).astype(np.uint8)
        out.append(np.zeros(len(c), dtype=np.int8))
        if len(c):
            # Character i takes its tag from window max(0, (i - MARGIN) // STRIDE).
            n = max(0, (len(c) - 1 - MARGIN) // STRIDE) + 1
            c = np.pad(c, (0, (n - 1) * STRIDE + WINDOW - len(c))) if len(c) < (n - 1) * STRIDE + WINDOW else c
            windows.append(np.lib.stride_tricks.sliding_window_view(c, WINDOW)[:: STRIDE][:n])
            places += [(k, s * STRIDE) for s in range(n)]
    whole = np.concatenate(windows) if windows else np.zeros((0, WINDOW), dtype=np.uint8)
    length = np.array([min(len(out[k]) - s, WINDOW) for k, s in places], dtype=np.int64)
    order = np.argsort(-length, kind="stable")  # windows of like length go together
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(whole), BATCH):
        part = order[at : at + BATCH]
        some, u = tagger.searched(whole[part], length[part], every)
        found.append((part[some], u))
        if sum(len(rows) for rows, _ in found) < BATCH and at + BATCH < len(whole):
            continue  # few windows of a batch are searched; those of several go together
        rows, u = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
        found.clear()
        for row, tags in zip(rows, tagger.best(length[rows], u), strict=True):
            k, s = places[row]
            lo = 0 if s == 0 else MARGIN  # the middle of the window; a text's start has no other window
            middle = out[k][s + lo : s + WINDOW - MARGIN]
            middle[:] = tags[lo : lo + len(middle)]
    return out


def plausible(kind: str, s: str) -> bool:
    """Whether a span may be of a kind, whatever its form."""
    if kind == "email":
        sign = _SIGN.search(s, 1)
        return bool(sign and s[0].isalnum() and _DOT.search(s, sign.end() + 1) and s[-1].isalpha() and s.isascii())
    d = _digits(s)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(int(x) <= 255 for x in parts) and len(_DOT.findall(s)) == 3
    return 12 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def tagged_spans(text: str, tags: np.ndarray) -> list[Span]:
    """Spans of one sequence of tags that are plausible and stand apart."""
    out = []
    some = np.flatnonzero(tags)
    at = 0
    while at < len(some):
        start, rank, end = int(some[at]), (int(tags[some[at]]) - 1) // 2, int(some[at]) + 1
        while end < len(tags) and tags[end] == 2 + 2 * rank:
            end += 1
        at = int(np.searchsorted(some, end))
        while start < end and not (text[start].isalnum() or text[start] in "(+"):
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        beside = (text[max(start - 1, 0) : start] + text[end : end + 1]).strip()
        if start < end and not any(c.isalnum() or c in "+-@" for c in beside) and plausible(KINDS[rank], text[start:end]):
            out.append((start, rank, end))
    return out


def apart(added: list[Span], base: list[Span]) -> list[Span]:
    """Those of `added` that overlap no span of `base`; both by start."""
    starts = [b[0] for b in base]
    ends = list(itertools.accumulate((b[2] for b in base), max))  # the furthest end so far
    return [s for s in added if not (k := bisect.bisect_left(starts, s[2])) or ends[k - 1] <= s[0]]


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans) of each text."""
    out = []
    for text, tags in zip(texts, tag_texts(tagger, texts), strict=True):
        base = base_spans(text)
        added = apart(tagged_spans(text, tags), base)
        out.append((base, sorted(base + added)))
    return out


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, in that order) for each row of `docs`."""
    tagger = tagger or trained(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = find([t.as_py() or "" for t in part.column(1)], tagger)
                lists = [[[{"start": s, "kind": KINDS[r], "end": e} for s, r, e in x[i]] for x in got] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x in lists)], names=["doc_id", "base", "spans"])

    spans = "array<struct<start:int,kind:string,end:int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(detected, f"doc_id bigint, base {spans}, spans {spans}")
