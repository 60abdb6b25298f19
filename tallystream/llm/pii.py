"""Personal data: base patterns, and a character-level BiLSTM-CRF that adds to them.

The network reads overlapping windows of characters in both directions and
scores tags (outside, begin or inside of each kind); learned transitions join
them and the best path of each window is decoded.  Every window of every text is
read.  A document's tags are reconciled globally: each character keeps the tag
of the window in whose middle it stands, and spans are read off the joined
sequence.

It is trained in numpy on labelled spans: windows of a bounded sample of the
documents, with what the base patterns find in them, and with written-out and
disguised forms set into them that no base pattern finds (:func:`planted`).  It
learns shapes; what follows from arithmetic (last digits, ranges, lengths) is
checked on each span that it adds.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.llm._arrow import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window's start to the next; windows of a block, which all have one shape.
WINDOW, STRIDE = 128, 104
BLOCK = 512
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits before the match can't start one, as their own run would have matched; so the scan is linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
Span = tuple[int, int, int]  # start, place of the kind, end


def luhn(digits: str) -> bool:
    """Whether a string of digits has a valid last digit."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def valid(kind: int, text: str) -> bool:
    """Whether a matched text passes the check of its kind."""
    if kind == 1:
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))
    if kind == 2:
        d = _digits(text)
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 9 <= len(_digits(text)) <= 15


def shaped(kind: int, text: str) -> bool:
    """Whether a matched text has the shape of its kind, whatever its digits are."""
    if kind == 1:
        return all(len(x) <= 3 for x in text.split("."))
    return kind == 0 or (12 <= len(_digits(text)) <= 19 if kind == 2 else 9 <= len(_digits(text)) <= 15)


def base_spans(text: str, check=valid) -> list[Span]:
    """All base spans in code points, by start and then kind; matches that fail ``check`` are dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, done := m.end()))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    first = _TRIGGER.search(text)
    if first:
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text, max(0, first.start() - 2)) if check(kind, m[0])]
    return sorted(out)


@lru_cache
def _classes() -> np.ndarray:
    """The symbol of each code point: itself in ASCII, 128 for other letters, 129 for anything else."""
    out = np.full(0x110000, 129, np.uint8)
    out[:128] = np.arange(128)
    out[[k for k in range(128, 0x30000) if chr(k).isalpha()]] = 128
    return out


def encode(text: str) -> np.ndarray:
    """ASCII codes; 128 for other letters, 129 for anything else."""
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Tagger:
    """A bidirectional LSTM with a CRF on top; tag 0 is outside, 1 + 2k begins kind k, 2 + 2k is inside.

    Gates are piecewise linear, in training and use.  Arrays have a window a
    column, so that each part of the gates is contiguous.
    """

    TAGS, PAD = 1 + 2 * len(KINDS), 130

    def __init__(self, hidden: int = 12, size: int = 10, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, d, k = hidden, size, self.TAGS
        self.hidden, self.size = h, d
        self.weights = {
            "embed": rng.normal(0, 0.7, (self.PAD + 1, d)),
            "gates": rng.normal(0, (d + h) ** -0.5, (2, 4 * h, d + h + 1)),
            "out": rng.normal(0, 0.3, (k, 2 * h + 1)),
            "moves": rng.normal(0, 0.1, (k, k)),
        }
        g = self.weights["gates"]
        g[:, : 3 * h] *= 0.25
        g[:, :, -1] = 0
        g[:, : 3 * h, -1] = 0.5
        g[:, h : 2 * h, -1] = 0.8  # remember at first
        self.weights["out"][:, -1] = 0
        self.weights = {name: w.astype(np.float32) for name, w in self.weights.items()}
        self.banned = np.zeros((k, k), bool)
        for kind in range(len(KINDS)):
            self.banned[:, 2 + 2 * kind] = True
            self.banned[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = False

    def moves(self) -> np.ndarray:
        """Transition scores; an inside tag only follows its own kind."""
        return np.where(self.banned, np.float32(-1e4), self.weights["moves"])

    def emissions(self, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Tag scores (T, K, B) of windows (B, T) of encoded characters, padded with ``PAD``."""
        w, h, d = self.weights, self.hidden, self.size
        kind = w["gates"].dtype
        b, steps = windows.shape
        drive = np.ascontiguousarray(w["embed"].take(windows.T, 0).transpose(0, 2, 1))
        states = np.empty((steps, 2 * h + 1, b), kind)
        states[:, -1] = 1
        inputs, c = np.zeros((2, d + h + 1, b), kind), np.zeros((2, h, b), kind)
        inputs[:, -1] = 1
        gates, squashed, part = np.empty((2, 4 * h, b), kind), np.empty((2, h, b), kind), np.empty((2, h, b), kind)
        for t in range(steps):
            inputs[0, :d], inputs[1, :d] = drive[t], drive[steps - 1 - t]
            np.matmul(w["gates"], inputs, out=gates)
            np.clip(gates[:, : 3 * h], 0, 1, out=gates[:, : 3 * h])
            np.tanh(gates[:, 3 * h :], out=gates[:, 3 * h :])
            if trace is not None:
                trace.append((inputs.copy(), c.copy(), gates.copy()))
            c *= gates[:, h : 2 * h]
            np.multiply(gates[:, :h], gates[:, 3 * h :], out=part)
            c += part
            np.tanh(c, out=squashed)
            np.multiply(gates[:, 2 * h : 3 * h], squashed, out=inputs[:, d : d + h])
            if trace is not None:
                trace[-1] += (squashed.copy(),)
            states[t, :h], states[steps - 1 - t, h : 2 * h] = inputs[0, d : d + h], inputs[1, d : d + h]
        if trace is not None:
            trace.append(states)
        return np.matmul(w["out"], states)

    def gradients(self, windows: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log-likelihood of the gold paths (B, T)."""
        w, h, d = self.weights, self.hidden, self.size
        b, steps = windows.shape
        trace: list = []
        e = self.emissions(windows, trace)
        states = trace.pop()
        moves = self.moves()
        ahead, back = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0] + (self.banned[0] * np.float32(-1e4))[:, None]
        for t in range(1, steps):
            ahead[t] = e[t] + _logsum(ahead[t - 1][:, None] + moves[:, :, None], 0)
        for t in reversed(range(steps - 1)):
            back[t] = _logsum(moves[:, :, None] + (e[t + 1] + back[t + 1])[None], 1)
        z = _logsum(ahead[-1], 0)
        delta = np.exp(ahead + back - z)
        rows = np.arange(b)
        grad = {name: np.zeros_like(x) for name, x in w.items()}
        for t in range(steps):
            delta[t, gold[:, t], rows] -= 1
            if t:
                both = np.exp(ahead[t - 1][:, None] + moves[:, :, None] + (e[t] + back[t])[None] - z)
                grad["moves"] += both.sum(2)
                np.add.at(grad["moves"], (gold[:, t - 1], gold[:, t]), -1)
        delta /= b
        grad["moves"] /= b
        grad["out"] = np.matmul(delta, states.transpose(0, 2, 1)).sum(0)
        above = np.matmul(w["out"][:, : 2 * h].T, delta)
        ds, dc = np.zeros((2, h, b), e.dtype), np.zeros((2, h, b), e.dtype)
        turned = w["gates"].transpose(0, 2, 1)
        drive = np.zeros((steps, d, b), e.dtype)
        for t in reversed(range(steps)):
            inputs, c, gates, squashed = trace[t]
            i, f, o, fresh = (gates[:, k * h : (k + 1) * h] for k in range(4))
            ds[0] += above[t, :h]
            ds[1] += above[steps - 1 - t, h:]
            dc = dc + ds * o * (1 - squashed**2)
            x = np.concatenate((dc * fresh, dc * c, ds * squashed, dc * i * (1 - fresh**2)), 1)
            x[:, : 3 * h] *= (gates[:, : 3 * h] > 0) & (gates[:, : 3 * h] < 1)
            grad["gates"] += np.matmul(x, inputs.transpose(0, 2, 1))
            below = np.matmul(turned, x)
            drive[t] += below[0, :d]
            drive[steps - 1 - t] += below[1, :d]
            ds, dc = below[:, d : d + h].copy(), dc * f
        codes = windows.T.ravel()
        for k in range(d):
            grad["embed"][:, k] = np.bincount(codes, drive[:, k].ravel(), len(w["embed"]))
        return grad

    @staticmethod
    def _may_leave(e: np.ndarray, gain: float) -> np.ndarray:
        """Whether a path of each column could score more than one that is outside throughout.

        ``gain`` is the most that a move can score more than staying outside.  A
        run of other tags begins with a kind's first tag and goes on with its
        inside tag or another kind's first; the best run that ends at each place
        is bounded with the gain at every place, and once more for its end.
        """
        over = e[:, 1:] - e[:, :1] + e.dtype.type(gain)
        best = np.full((len(KINDS), e.shape[2]), -np.inf, e.dtype)
        top = np.full(e.shape[2], -np.inf, e.dtype)
        for t in range(len(e)):
            before = np.maximum(best.max(0), 0)
            best += over[t, 1::2]
            np.maximum(best, over[t, ::2] + before, out=best)
            np.maximum(top, best.max(0), out=top)
        return top + gain >= 0

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """The best path (B, T) of each window; ties go to the lower tag.

        Where a bound shows that all of a window is outside, no path is sought.
        """
        e, moves = self.emissions(windows), self.moves()
        b, steps = windows.shape
        path = np.zeros((b, steps), np.int8)
        open_ = np.flatnonzero(self._may_leave(e, max(0.0, float(moves.max() - moves[0, 0]))))
        if not len(open_):
            return path
        e = np.ascontiguousarray(e[:, :, open_])
        best, origin = e[0] + (self.banned[0] * np.float32(-1e4))[:, None], np.zeros((steps, self.TAGS, len(open_)), np.int8)
        for t in range(1, steps):
            options = best[:, None] + moves[:, :, None]
            origin[t] = options.argmax(0)
            best = options.max(0) + e[t]
        found = np.zeros((steps, len(open_)), np.int8)
        found[-1] = best.argmax(0)
        for t in reversed(range(1, steps)):
            found[t - 1] = origin[t, found[t], np.arange(len(open_))]
        path[open_] = found.T
        return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    """Gold tags of a text; of overlapping spans the first is taken."""
    out, done = np.zeros(length, np.int8), 0
    for start, kind, end in spans:
        if start >= done:
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
            done = end
    return out


#: How an at sign, and a dot, are written out in addresses, and what stands between groups of a number's digits.
ATS = (" at ", " AT ", "[at]", "(at)", " [at] ", " (at) ", "{at}", " {at} ", " @ ")
DOTS = (" dot ", " DOT ", "[dot]", "(dot)", " [dot] ", " (dot) ", "{dot}", "[.]", "(.)", " . ")
GAPS = (".", "/", "_", " - ", "  ", " ", "‑", " . ")
_PARTS = ("an", "ber", "cla", "do", "el", "fin", "gra", "ho", "in", "jo", "ka", "lu", "mar", "ne", "ol", "pe", "qui", "ros", "sa", "tho", "ur", "vi", "wen", "ya", "zed")
_ENDS = ("com", "org", "net", "edu", "io", "de", "fr", "es", "info", "co")


def _name(rng: np.random.Generator) -> str:
    return "".join(rng.choice(_PARTS, int(rng.integers(1, 4))))


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    body = _number(rng, int(rng.choice([13, 15, 15, 15])))
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def planted(rng: np.random.Generator, kind: int) -> str:
    """An invented item of a kind, in a form that no base pattern finds."""
    if kind == 0:
        user = _name(rng) + str(rng.choice(["", ".", "_", "-"])) + (_name(rng) if rng.random() < 0.6 else str(rng.integers(0, 100)))
        at, dot = str(rng.choice(ATS)), str(rng.choice(DOTS))
        host = [_name(rng) for _ in range(int(rng.choice([1, 1, 2])))] + [str(rng.choice(_ENDS))]
        plain = at not in (" @ ",) and rng.random() < 0.2  # only the at sign is written out
        return user + at + ("." if plain else dot).join(host)
    if kind == 1:
        return str(rng.choice(DOTS)).join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        digits, gap = _card(rng), str(rng.choice(GAPS))
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return str(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{a}/{b}{c}", f"00 {_number(rng, 2)} {a} {b}{c}", f"{a}/{b}-{c}"]))


def harmless(rng: np.random.Generator) -> str:
    """Invented text with digits, signs or words as in personal data that is none."""
    n = lambda k: _number(rng, k)
    return str(rng.choice([
        f"20{n(2)}-0{1 + int(n(1)) % 9}-1{n(1)}", f"{n(2)}.0{n(1)}.20{n(2)}", f"1{n(1)}:{n(2)}:{n(2)}", f"{n(1)},{n(3)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(3)}-{n(3)}", f"{n(2)}/{n(2)}",
        n(9), n(12), f"no. {n(6)}", f"{n(4)} {n(4)}", f"at {n(2)}", f"{_name(rng)} at {_name(rng)}", f"dot {_name(rng)}", f"{_name(rng)} at the dot", f"[{n(1)}]", f"({n(4)})", f"@{_name(rng)}",
        f"{_name(rng)}.{_name(rng)}", f"{n(3)}.{n(3)}", f"{n(1)} . {n(1)}", f"{n(2)} - {n(2)}", f"0x{n(4)}", f"${n(3)}.{n(2)}", f"{n(3)}_{n(2)}", f"{_name(rng)} (at)", f"{n(5)}-{n(4)}", f"1 {n(1)} 3 {n(1)} 5 {n(1)}",
    ]))


def sample_window(rng: np.random.Generator, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and gold tags of a window of a text, with an invented item or none set between its words."""
    spots = [m.start() for m in itertools.islice(re.finditer(r"[0-9@+][^ ]*", text), 50)]
    at = spots[int(rng.integers(len(spots)))] if spots and rng.random() < 0.4 else int(rng.integers(len(text) + 1))
    start = max(0, at - int(rng.integers(8, WINDOW)))
    piece = text[start : start + WINDOW + 40]
    cuts = [m.end() for m in re.finditer(r"\s", piece)] or [0]
    chance, own = rng.random(), []
    for k in range(0 if chance < 0.25 else 1 if chance < 0.8 else 2):
        cut = cuts[int(rng.integers(len(cuts)))]
        if any(a < cut < b for a, _, b in own):
            continue
        kind = int(rng.integers(len(KINDS)))
        item = planted(rng, kind) if rng.random() < 0.65 else harmless(rng)
        kind = kind if any(item.strip()) and _plausible(kind, item) else -1
        before, after = str(rng.choice(["", "", "", "(", '"', ": "])), str(rng.choice([" ", " ", " ", ", ", ". ", ") ", "\n", "; "]))
        moved = len(before) + len(item) + len(after)
        own = [(a + moved, x, b + moved) if a >= cut else (a, x, b) for a, x, b in own]
        if kind >= 0:
            own.append((cut + len(before), kind, cut + len(before) + len(item)))
        piece = piece[:cut] + before + item + after + piece[cut:]
        cuts = [c if c <= cut else c + moved for c in cuts]
    spans = own + [s for s in base_spans(piece, shaped) if not any(s[0] < b and a < s[2] for a, _, b in own)]
    codes, tags = encode(piece), tags_of(len(piece), sorted(spans))
    off = int(rng.integers(0, max(1, len(piece) - WINDOW + 1)))
    x, y = np.full(WINDOW, Tagger.PAD, np.uint8), np.zeros(WINDOW, np.int8)
    part = codes[off : off + WINDOW]
    x[: len(part)], y[: len(part)] = part, tags[off : off + WINDOW]
    if y[0] and y[0] % 2 == 0:
        y[0] -= 1  # a span that begins before the window begins with it
    return x, y


def train(texts: list[str], windows: int = 6000, passes: int = 5, batch: int = 48, rate: float = 0.02, seed: int = 3) -> Tagger:
    """A tagger from ``windows`` windows of the texts, which are taken in turn."""
    rng = np.random.default_rng(seed)
    net = Tagger(seed=seed)
    texts = [t for t in texts if t]
    if not texts:
        return net
    made = [sample_window(rng, texts[k % len(texts)]) for k in range(windows)]
    x, y = np.array([a for a, _ in made]), np.array([b for _, b in made])
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step, total = 0, passes * -(-len(x) // batch)
    for _ in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            grad = net.gradients(x[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            for k, g in grad.items():
                g = g * np.float32(min(1.0, 5.0 / max(norm, 1e-9)))
                first[k] = np.float32(0.9) * first[k] + np.float32(0.1) * g
                second[k] = np.float32(0.99) * second[k] + np.float32(0.01) * g * g
                net.weights[k] -= np.float32(rate * (1 - step / (total + 1)) / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return net


def tagged(net: Tagger, texts: list[str], block: int = BLOCK) -> list[np.ndarray]:
    """Reconciled tags of each text: a character has the tag of the window in whose middle it stands."""
    codes = [encode(t) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    joined_codes = np.concatenate([*codes, np.full(WINDOW, Tagger.PAD, np.uint8)])
    begin = np.cumsum(lengths) - lengths
    counts = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    local = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    out, edge, place = np.zeros(int(lengths.sum()), np.int8), (WINDOW - STRIDE) // 2, np.arange(WINDOW)
    for at in range(0, len(owner), block):
        of, start = owner[at : at + block], local[at : at + block]
        left = lengths[of] - start  # characters from the window's start on
        x = np.full((block, WINDOW), Tagger.PAD, np.uint8)
        real = place < left[:, None]
        x[: len(of)][real] = joined_codes[((begin[of] + start)[:, None] + place)[real]]
        paths = net.decode(x)[: len(of)]
        hit = np.flatnonzero(paths.any(1))
        for k in hit.tolist():
            a = edge if start[k] else 0
            b = int(left[k]) if left[k] <= WINDOW else WINDOW - edge
            out[begin[of[k]] + start[k] + a : begin[of[k]] + start[k] + b] = paths[k, a:b]
    return [out[a : a + n] for a, n in zip(begin.tolist(), lengths.tolist(), strict=True)]


def spans_of(tags: np.ndarray) -> list[Span]:
    """Spans of a tag sequence; an inside tag after another kind begins a span."""
    out: list[Span] = []
    places = np.flatnonzero(tags)
    for p in places.tolist():
        kind = (int(tags[p]) - 1) // 2
        if out and out[-1][2] == p and out[-1][1] == kind and tags[p] % 2 == 0:
            out[-1] = (out[-1][0], kind, p + 1)
        else:
            out.append((p, kind, p + 1))
    return out


#: Characters by which a found span's edge moves to the border of a token, at most.
REACH = 24


def snapped(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span with its edges on token borders and without marks around; None if no border is near."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    while start > low and text[start - 1].isalnum() and text[start].isalnum():
        start -= 1
    while end < high and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    while start < end and not (text[start].isalnum() or (text[start] == "(" and ")" in text[start:end])):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    if start and text[start] != "(" and text[start - 1] == "(" and ")" in text[start:end] and "(" not in text[start : text.index(")", start)]:
        start -= 1
    inside = (start and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and end > start and text[end].isalnum())
    return None if start >= end or inside else (start, end)


def _continues(text: str, start: int, end: int) -> bool:
    """Whether digits go on beyond a mark at either edge, so that the span is a part of a longer number."""
    return bool(re.search(r"[0-9][./_:,-]$", text[max(0, start - 2) : start]) or re.match(r"[./_:,-][0-9]", text[end : end + 2]))


def find(net: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and those with what the network adds, of each text.

    An added span lies on token borders, overlaps no other span and passes its
    kind's check in plain form: an address matches the base pattern, numbers
    have the right digits and no letters.
    """
    base = [base_spans(t) for t in texts]
    out = []
    for text, known, tags in zip(texts, base, tagged(net, texts), strict=True):
        added: list[Span] = []
        starts, reach = [a for a, _, _ in known], list(itertools.accumulate((b for _, _, b in known), max))
        for start, kind, end in spans_of(tags):
            edges = snapped(text, start, end)
            if edges is None:
                continue
            start, end = edges
            before = bisect.bisect_left(starts, end)  # base spans that begin before its end
            if (before and reach[before - 1] > start) or (added and added[-1][2] > start):
                continue
            if _plausible(kind, text[start:end]) and not (kind and _continues(text, start, end)):
                added.append((start, kind, end))
        out.append((known, sorted(known + added)))
    return out


_AT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?| at | AT |\s?@\s?")
_DOT = re.compile(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?| dot | DOT | \. |\.")
_ADDRESS = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_GROUPED = re.compile(r"[0-9]+(?:[ ./_() ‑-]{1,3}[0-9]+)+")


def plain(kind: int, text: str) -> str:
    """An address with its written-out at signs and dots as signs."""
    text = _DOT.sub(".", text)
    return _AT.sub("@", text) if kind == 0 else text


def _plausible(kind: int, text: str) -> bool:
    if kind == 0:
        return bool(_ADDRESS.fullmatch(plain(0, text)))
    if kind == 1:
        return bool(_IP.fullmatch(plain(1, text))) and valid(1, plain(1, text))
    return bool(_GROUPED.fullmatch(text.lstrip("("))) and valid(kind, text)


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = 1500, max_chars: int = 20_000) -> Tagger:
    """A tagger from a bounded sample: the ``rows`` least documents by hash of their id, up to ``max_chars`` long.

    Of rows that share an id one text is taken, the least.
    """
    ids = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(doc_id).alias("mix")).distinct()
    chosen = ids.orderBy("mix", "id").limit(rows).collect()
    if not chosen:
        return train([])
    side = docs.sparkSession.createDataFrame([(r["id"], r["mix"]) for r in chosen], T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("mix", T.LongType())]))
    short = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).filter((F.char_length("t") <= max_chars) & (F.col("t") != ""))
    found = short.join(F.broadcast(side), F.col("doc") == F.col("id")).groupBy("mix", "id").agg(F.min("t").alias("t")).collect()
    return train([r["t"] for r in sorted(found, key=lambda r: (r["mix"], r["id"]))])


def scan(docs: DataFrame, net: Tagger, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, counts of base spans a kind, ``base_sha256``, ``spans`` and ``n_added``, of every row.

    The whole text is read; null counts as empty, with no spans and the digest
    of the empty string.  Repeated rows are scanned each, alike.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]

    def compute(texts):
        found = find(net, [t or "" for t in texts.to_pylist()])
        counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
        return [*counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], [joined(a) for _, a in found], [len(a) - len(b) for b, a in found]]

    return map_texts(docs, text, list(keep), fields, lambda: compute)


def redact(docs: DataFrame, net: Tagger, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``text``, with every found span replaced by its kind in brackets; null stays null."""

    def compute(texts):
        whole = texts.to_pylist()
        found = find(net, [t or "" for t in whole])
        return [[None if t is None else redacted(t, spans) for t, (_, spans) in zip(whole, found, strict=True)]]

    return map_texts(docs, text, list(keep), [T.StructField(text, T.StringType())], lambda: compute)
