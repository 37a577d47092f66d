"""Personal data by fixed patterns and a character BiLSTM with a CRF.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A
bidirectional LSTM over characters with CRF transitions, trained in numpy from
labelled spans (``labelled_spans`` writes them: plain, spaced and spelled-out
forms and secrets, among ordinary numbers and words that are none), adds spans
of the same kinds and of ``secret``.

The tagger reads the whole of every text, in windows of WINDOW characters that
overlap by OVERLAP; where two disagree, the label comes from the window whose
edge is farther away. A window's tags don't depend on what it is decoded with:
windows are run in batches of one fixed shape, and a shorter one's way back
starts at its own last character. Spans that touch a pattern's span give way to
it.

Null and empty texts have no spans; a null id stays null. Repeated rows are each
searched; an empty table gives an empty table. Only the named columns are read
(the stage passes all others on), so none can clash. Long texts take time in
proportion to their length, and a batch's memory.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_many

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WINDOW, OVERLAP = 1024, 96
#: Windows in a batch: fewer are filled up, so that every product has the same shape.
BATCH = 512
EDGE = " .,;:!|\"'\n\t"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' spans, sorted."""
    out, cursor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            cursor = m.end()
        at = text.find("@", max(at + 1, cursor))
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the tagger ----

#: Labels: 0 outside, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)
N_CHARS = 104
#: Weight of the characters' own likelihoods in the fit.
CROSS = 0.3
#: By how much a span's begin is less likely in documents than in the labelled rows, of which every fifth token is one: log odds.
PRIOR = 5.0
#: Rows that are Python objects at one time, and characters that are tagged at once, or one text if it has more.
ROWS, CHARS_AT_ONCE = 8192, 1 << 22


def encode(text: str) -> np.ndarray:
    """Printable ASCII by itself; line ends, other white space, other letters and the rest by class."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 101).astype(np.uint8)
    out[(codes == 10) | (codes == 13)] = 97
    out[codes == 9] = 98
    out[(codes >= 0xC0) & (codes < 0x250)] = 99
    out[codes >= 0x250] = 100
    return out


def labelled_spans(n: int = 1200, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, [(start, end, kind)]): personal data of each kind among words and other numbers."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = "etaoinshrdlucmfwypvbgkjqxzéèêäöüßñóíç"

    def word() -> str:
        if rng.random() < 0.1:
            return rng.choice(("at", "at", "at", "dot", "a", "the", "of", "on"))
        w = "".join(rng.choice(letters[: rng.choice((12, 26, len(letters)))]) for _ in range(rng.randint(2, 10)))
        return rng.choice((w, w, w, w.capitalize(), w.upper() if rng.random() < 0.3 else w)) + rng.choice(("", "", "", ",", ".", "!!", "%%%", " |"))

    def plain() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        d = digits(16)
        return rng.choice((d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), digits(15), digits(13), digits(19)))

    def email() -> str:
        user, host, top = plain() + rng.choice(("", "." + plain(), digits(2), "." + digits(2))), rng.choice((plain(), "mail" + digits(1) + ".example")), rng.choice(("com", "org", "net", "de", "fr", "io"))
        return rng.choice((f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} (at) {host} (dot) {top}", f"{user}[at]{host}.{top}", f"{user} @ {host}.{top}", f"{user} at {host.replace('.', ' dot ')} dot {top}"))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {a} {b} {c}", f"00{rng.randint(20, 99)} {a} {b}{c}", f"{a}.{b}.{c}"))

    def secret() -> str:
        h = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 40, 40, 64))))
        if rng.random() < 0.2:
            return "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789_-") for _ in range(rng.randint(16, 40)))
        return h.upper() if rng.random() < 0.3 else h

    makers = (email, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, phone, secret)
    others = (lambda: str(rng.randint(1, 2100)), lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: f"version {rng.randint(1, 9)}.", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 23)}:{rng.randint(10, 59)}", lambda: f"${rng.randint(1, 999)},{digits(3)}.{digits(2)}", lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}", lambda: f"@{plain()}", lambda: f"({digits(4)})", lambda: rng.choice(("at", "dot", "at a", "at " + plain())), lambda: digits(rng.randint(5, 8)))
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(6, 14)):
            x = rng.random()
            if x < 0.18:
                kind = rng.randrange(len(KINDS))
                if kind == 4:
                    text += rng.choice(('token = "', 'TOKEN = "', "api_key: ", "secret=", "", "password = '"))
                value = makers[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value + rng.choice((" ", " ", " ", ". ", ", ", "!! ", '" ', "\n", "$$$ ", " | "))
            else:
                text += (rng.choice(others)() if x < 0.28 else word()) + rng.choice((" ", " ", " ", " ", "\n"))
        out.append((text, spans))
    return out


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which stands for the hyperbolic tangent: a few vector operations instead of an exponential. Its slope is (1 - |soft(x)|) squared."""
    return x / (1 + np.abs(x))


class Tagger:
    """Weights and the passes over them; float32, one thread."""

    def __init__(self, hidden: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        g = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.w = {"xf": g(N_CHARS, 4 * h), "xb": g(N_CHARS, 4 * h), "hf": g(h, 4 * h), "hb": g(h, 4 * h), "out": g(2 * h, N_TAGS), "bias": np.zeros(N_TAGS, np.float32), "tr": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for k in ("xf", "xb"):
            self.w[k][:, h : 2 * h] += 1.0  # forget gates start open
        #: Inside follows only begin or inside of its kind.
        self.barred = np.zeros((N_TAGS, N_TAGS), np.float32)
        for k in range(len(KINDS)):
            self.barred[:, 2 + 2 * k] = -1e4
            self.barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0

    def one_way(self, ids: np.ndarray, x: str, r: str) -> tuple[np.ndarray, list]:
        """ids (time, batch): outputs (time, batch, hidden), and what the way back needs."""
        h, (steps, batch) = self.hidden, ids.shape
        state, cell, out, kept = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32), np.empty((steps, batch, h), np.float32), []
        for t in range(steps):
            z = self.w[x][ids[t]] + state @ self.w[r]
            y = soft(z)
            s = 0.5 * y[:, : 3 * h] + 0.5
            i, f, o, g = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], y[:, 3 * h :]
            before, cell = cell, f * cell + i * g
            th = soft(cell)
            kept.append((state, before, i, f, o, g, th))
            state = out[t] = o * th
        return out, kept

    def scores(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kf = self.one_way(ids, "xf", "hf")
        b, kb = self.one_way(ids[::-1], "xb", "hb")
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.w["out"] + self.w["bias"], (both, kf, kb)

    def back(self, ids: np.ndarray, grad: np.ndarray, kept: list, x: str, r: str, into: dict) -> None:
        h = self.hidden
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        all_dz = np.empty((*ids.shape, 4 * h), grad.dtype)
        for t in range(len(ids) - 1, -1, -1):
            state, before, i, f, o, g, th = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - np.abs(th)) ** 2
            slope = [0.5 * (1 - np.abs(2 * gate - 1)) ** 2 for gate in (i, f, o)]
            dz = np.concatenate([dc * g * slope[0], dc * before * slope[1], dh * th * slope[2], dc * i * (1 - np.abs(g)) ** 2], axis=1)
            all_dz[t] = dz
            into[r] += state.T @ dz
            dh, dc = dz @ self.w[r].T, dc * f
        chars = (ids.reshape(-1, 1) == np.arange(N_CHARS)).astype(grad.dtype)
        into[x] += chars.T @ all_dz.reshape(-1, 4 * h)

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of the tags under the CRF, and CROSS times that of each character's scores alone, which keeps a label's scores low where it can't begin; and the gradients."""
        emit, (both, kf, kb) = self.scores(ids)
        steps, batch = ids.shape
        tr = self.w["tr"] + self.barred
        e_tr = np.exp(tr)
        top = lambda a: a.max(axis=1, keepdims=True)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            m = top(alpha[t - 1])
            alpha[t] = np.log(np.exp(alpha[t - 1] - m) @ e_tr + 1e-30) + m + emit[t]
        for t in range(steps - 2, -1, -1):
            v = beta[t + 1] + emit[t + 1]
            m = top(v)
            beta[t] = np.log(np.exp(v - m) @ e_tr.T + 1e-30) + m
        m = top(alpha[-1])
        z = np.log(np.exp(alpha[-1] - m).sum(axis=1, keepdims=True)) + m
        d = np.exp(np.minimum(alpha + beta - z, 0))
        joint = alpha[:-1, :, :, None] + tr + (emit[1:] + beta[1:])[:, :, None, :] - z[:, :, None]
        dtr = np.exp(np.minimum(joint, 0)).sum(axis=(0, 1))
        np.add.at(dtr, (tags[:-1], tags[1:]), -1)
        at = np.arange(steps)[:, None], np.arange(batch), tags
        gold = emit[at].sum() + tr[tags[:-1], tags[1:]].sum()
        d[at] -= 1
        alone = np.exp(emit - emit.max(axis=2, keepdims=True))
        alone /= alone.sum(axis=2, keepdims=True)
        loss = float(z.sum() - gold - CROSS * np.log(alone[at] + 1e-30).sum()) / batch
        alone[at] -= 1
        d += CROSS * alone
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["tr"], grads["bias"] = dtr, d.sum(axis=(0, 1))
        grads["out"] = both.reshape(-1, both.shape[2]).T @ d.reshape(-1, N_TAGS)
        db = d @ self.w["out"].T
        h = self.hidden
        self.back(ids, db[:, :, :h], kf, "xf", "hf", grads)
        self.back(ids[::-1], db[::-1, :, h:], kb, "xb", "hb", grads)
        return loss, grads

    def fit(self, rows: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 10, batch: int = 32, width: int = 96, rate: float = 0.02, seed: int = 5) -> Tagger:
        """Windows of one width are cut from the rows, set one behind another, so that no window is padded."""
        rng = np.random.default_rng(seed)
        parts, marks = [], []
        for text, spans in rows:
            tags = np.zeros(len(text) + 1, np.int64)
            for start, end, kind in spans:
                tags[start], tags[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
            parts.append(encode(text + "\n"))
            marks.append(tags)
        ids, tags = np.concatenate(parts).astype(np.int64), np.concatenate(marks)
        xs, ys = [], []
        for at in range(0, len(ids) - width + 1, width):
            y = tags[at : at + width].copy()
            if y.any() or rng.random() < 0.5:
                # an inside without its begin, at a window's edge, starts a span there
                y[0] -= y[0] > 0 and y[0] % 2 == 0
                xs.append(ids[at : at + width])
                ys.append(y)
        xs, ys = np.array(xs), np.array(ys)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        n = 0
        for _ in range(rounds):
            order = rng.permutation(len(xs))
            for at in range(0, len(order) - batch + 1, batch):
                pick = order[at : at + batch]
                _, grads = self.step(xs[pick].T, ys[pick].T)
                n += 1
                for k, g in grads.items():
                    g = np.clip(g / batch, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.w[k] -= (rate / (1 + n / 300) * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return self

    def emitted(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores (time, tags, batch) of both ways, as ``scores`` gives them, without what training needs: a step's outputs are used at once and not kept. Both ways go on at once; a window's way back starts at its own end.

        Gates lie one behind another, so that every operation runs over whole arrays.
        Cells and outputs are held doubled, which is exact, and the weights behind them halved.
        """
        h, (steps, batch) = self.hidden, ids.shape
        gates = lambda w: w.reshape(-1, 4, h).transpose(1, 0, 2)
        tables = np.concatenate([gates(self.w["xf"]), gates(self.w["xb"])], axis=1)
        mix = np.stack([gates(self.w["hf"]), gates(self.w["hb"])], axis=1) / 2
        out = [np.ascontiguousarray(self.w["out"][k * h : (k + 1) * h].T) / 2 for k in (0, 1)]
        emit = np.empty((steps, N_TAGS, batch), np.float32)
        emit[:] = self.w["bias"][:, None]
        state, cell, th, more = (np.zeros((2, batch, h), np.float32) for _ in range(4))
        z, y, part = np.empty((4, 2, batch, h), np.float32), np.empty((4, 2, batch, h), np.float32), np.empty((N_TAGS, batch), np.float32)
        i, f, o, g = z
        at = np.empty((2, batch), np.intp)
        first = steps - int(sizes.min())
        for t in range(steps):
            at[0] = ids[t]
            np.add(ids[steps - 1 - t], N_CHARS, out=at[1], dtype=np.intp)
            for table, own in zip(tables, z, strict=True):
                table.take(at, axis=0, out=own, mode="clip")
            z += np.matmul(state, mix, out=y)
            np.abs(z, out=y)
            y += 1
            z /= y
            # a gate is soft(z) / 2 + 1 / 2
            z[:3] += 1
            cell *= f
            cell *= 0.5
            cell += np.multiply(g, i, out=more)
            if t < first:
                cell[1] *= (sizes > steps - 1 - t)[:, None]
            np.abs(cell, out=th)
            th += 2
            np.divide(cell, th, out=th)
            np.multiply(th, o, out=state)
            emit[t] += np.matmul(out[0], state[0].T, out=part)
            emit[steps - 1 - t] += np.matmul(out[1], state[1].T, out=part)
        return emit

    def decode(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each window of codes (none empty, at most BATCH of them), by Viterbi."""
        sizes = np.ones(BATCH, np.int64)
        sizes[: len(windows)] = [len(w) for w in windows]
        ids = np.zeros((BATCH, int(sizes.max())), np.uint8)
        for own, w in zip(ids, windows, strict=False):
            own[: len(w)] = w
        emit = self.emitted(np.ascontiguousarray(ids.T), sizes)
        return self.paths(emit, sizes, self.w["tr"] + self.barred)[: len(windows)]

    def viterbi(self, emit: np.ndarray, sizes: np.ndarray, tr: np.ndarray) -> list[np.ndarray]:
        """``paths`` of emit: (tags, time, batch), which stays as it is."""
        return self.paths(emit.transpose(1, 0, 2).astype(np.float32, order="C"), sizes, tr)

    def paths(self, best: np.ndarray, sizes: np.ndarray, tr: np.ndarray) -> list[np.ndarray]:
        """The best tags by scores (time, tags, batch), in whose place the best paths' scores are put. No path starts inside a span; an inside follows only its own begin or inside. Of equal ones the smaller label's counts."""
        steps, _, batch = best.shape
        heads, inner = np.array([0, *range(1, N_TAGS, 2)]), np.arange(2, N_TAGS, 2)
        best[0, 2::2] -= 1e4
        tr = tr.astype(np.float32)
        to_head = np.ascontiguousarray(tr[:, heads])[:, :, None]
        from_begin, from_inner = (tr[k, inner][:, None] for k in (inner - 1, inner))
        from_, top, begun, other = np.empty((N_TAGS, len(heads), batch), np.float32), np.empty((len(heads), batch), np.float32), *np.empty((2, len(inner), batch), np.float32)
        #: Whether the best path to "outside" comes from a span.
        left = np.empty((steps, batch), bool)
        for t in range(1, steps):
            before, now = best[t - 1], best[t]
            np.add(before[:, None], to_head, out=from_)
            np.maximum.reduce(from_, axis=0, out=top)
            np.not_equal(from_[0, 0], top[0], out=left[t])
            np.add(before[2::2], from_inner, out=other)
            np.maximum(other, np.add(before[1::2], from_begin, out=begun), out=other)
            now[0] += top[0]
            now[1::2] += top[1:]
            now[2::2] += other
        tags, tag, busy = np.zeros((steps, batch), np.uint8), np.zeros(batch, np.uint8), np.empty(batch, bool)
        last = {int(t) for t in sizes - 1}
        for t in range(steps - 1, -1, -1):
            if t + 1 < steps:
                # "outside" that comes from "outside" stays
                at = np.logical_or(tag, left[t + 1], out=busy).nonzero()[0]
                if len(at):
                    tag[at] = (best[t].take(at, axis=1) + tr.take(tag[at], axis=1)).argmax(axis=0)
            if t in last:
                ends = sizes == t + 1
                tag[ends] = best[t][:, ends].argmax(axis=0)
            tags[t] = tag
        return [own[:n].copy() for own, n in zip(tags.T.copy(), sizes, strict=True)]


@lru_cache(maxsize=2)
def trained(seed: int = 7) -> Tagger:
    tagger = Tagger().fit(labelled_spans(seed=seed))
    tagger.w["bias"][1::2] -= PRIOR
    return tagger


def windows(n: int) -> list[tuple[int, int]]:
    """Windows over n characters, each OVERLAP into the one before."""
    out, at = [], 0
    while n - at > WINDOW:
        out.append((at, at + WINDOW))
        at += WINDOW - OVERLAP
    return [*out, (at, n)] if n else []


#: An address with its sign or the sign's name in brackets, or one spelled out in words.
SPELLED = re.compile(r"[\w.+-]+\s?(?:@|[(\[]\s?at\s?[)\]])\s?[\w-]+(?:\s?(?:\.|[(\[]\s?dot\s?[)\]]|\bdot\b)\s?[\w-]+)+|[\w.+-]+ at [\w-]+(?: dot [\w-]+)+")


def plausible(kind: int, value: str) -> bool:
    """A decoded span must have what its kind can't be without."""
    digits = sum("0" <= c <= "9" for c in value)
    if kind == 0:
        return SPELLED.fullmatch(value) is not None
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", value))
    if kind == 2:
        return 12 <= digits <= 19 and not re.search(r"[^0-9 -]", value)
    if kind == 3:
        return 9 <= digits <= 15 and not re.search(r"[^0-9+(). -]", value)
    return len(value) >= 16 and digits >= 2 and not re.search(r"\s", value)


def reconciled(n: int, cuts: list[tuple[int, int]], tags: list[np.ndarray]) -> np.ndarray:
    """One tag for each of n characters: where windows overlap, that of the window whose edge is farther away, of equal ones the first."""
    if len(cuts) == 1:
        return tags[0]
    label, depth = np.zeros(n, np.uint8), np.full(n, -1, np.int64)
    for (lo, hi), own in zip(cuts, tags, strict=True):
        i = np.arange(hi - lo)
        edge = np.minimum(i if lo else n, hi - lo - i if hi < n else n)
        better = depth[lo:hi] < edge
        depth[lo:hi][better], label[lo:hi][better] = edge[better], own[better]
    return label


def spans_of(text: str, label: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the tagged spans that are plausible, without punctuation and space at their edges."""
    out: list[list[int]] = []
    for i in np.flatnonzero(label).tolist():
        kind, inside = (int(label[i]) - 1) // 2, label[i] % 2 == 0
        if out and out[-1][2] == i and inside and out[-1][1] == kind:
            out[-1][2] = i + 1
        else:
            out.append([i, kind, i + 1])
    trimmed = []
    for start, kind, end in out:
        while end > start and text[end - 1] in EDGE:
            end -= 1
        while end > start and text[start] in EDGE:
            start += 1
        if end > start and plausible(kind, text[start:end]):
            trimmed.append((start, kind, end))
    return trimmed


def learned(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text; windows of all texts are decoded together, by length."""
    codes = [encode(t) for t in texts]
    cuts = [windows(len(t)) for t in texts]
    flat = sorted(((j, i, hi - lo) for j, own in enumerate(cuts) for i, (lo, hi) in enumerate(own)), key=lambda x: x[2])
    tags: list[list] = [[None] * len(own) for own in cuts]
    for at in range(0, len(flat), BATCH):
        some = flat[at : at + BATCH]
        for (j, i, _), own in zip(some, tagger.decode([codes[j][slice(*cuts[j][i])] for j, i, _ in some]), strict=True):
            tags[j][i] = own
    return [spans_of(t, reconciled(len(t), own, got)) if any(x.any() for x in got) else [] for t, own, got in zip(texts, cuts, tags, strict=True)]


def by_size(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cuts of the list into runs of up to CHARS_AT_ONCE characters, so that few windows are filled up."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def find(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list, list]]:
    """For each text the patterns' spans and all spans; both sorted by start, then kind."""
    own = [t or "" for t in texts]
    found = [x for lo, hi in by_size(own) for x in learned(own[lo:hi], tagger)] if tagger else [[] for _ in own]
    out = []
    for text, more in zip(own, found, strict=True):
        base = patterns(text)
        more = [x for x in more if not any(x[0] < e and s < x[2] for s, _, e in base)]
        out.append((base, sorted([*base, *more])))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_spans(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a count for each pattern, digest of the patterns' spans, all spans."""
    tagger = tagger or trained()

    def rows(_, keys: list, texts: list) -> list[tuple]:
        out = []
        for key, (base, spans) in zip(keys, find(texts, tagger), strict=True):
            kinds = [k for _, k, _ in base]
            out.append((key, *(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return out

    return map_many(docs, [id_col, text_col], rows, f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", at_once=ROWS)


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Each span, or spans that overlap, become the first one's kind in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    return find_spans(load(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data masked; n_chars follows the new text."""
    tagger = trained()

    def masked(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = part.column("text").to_pylist()
                texts = [mask(t, spans) for t, (_, spans) in zip(texts, find(texts, tagger), strict=True)]
                at, field = part.schema.get_field_index("text"), part.schema.field("text")
                yield part.set_column(at, field, pa.array(texts, type=field.type))

    order = docs.columns
    out = docs.mapInArrow(masked, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*order) if "n_chars" in order else out
