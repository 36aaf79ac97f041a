"""Personal data: plain patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans.  A text is read in overlapping windows; every
window is decoded on its own, and of all windows' spans the set of non-overlapping ones with the
largest total score is kept.  Windows that hold neither an @ nor four digits are passed over: none of
the kinds can be in them.  What defines a kind is checked on each of the network's spans - digits, separators, check digit,
parts of an address - so it adds spans that the plain patterns miss (other separators, missing +, letters
outside ASCII) and never removes one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # only tried where a run of digits begins
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The form of added cards and phones: digits, single separators; brackets, and separators such as " / ".
CARD_FORM = re.compile(r"[0-9]+(?:[ ./-][0-9]+)*")
PHONE_FORM = re.compile(r"(?=[+(0-9])\+?(?:[ ./-]{0,3}(?:\([0-9]+\)|[0-9]))+")

WINDOW, STRIDE = 96, 48
Span = tuple[str, int, int]

# --- plain patterns ---------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The contract's spans: leftmost non-overlapping matches of each pattern, failing ones dropped."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _emails(text: str) -> Iterator[Span]:
    """Matches of EMAIL, tried only where a local part reaches an @, so long runs cost one pass."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        start = sign
        while start > at and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        m = EMAIL.match(text, start) if start < sign else None
        if m and m.end() > sign:
            yield ("email", m.start(), m.end())
            at = m.end()
        else:
            at = sign + 1


# --- the network ------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PAD, LETTER, CAPITAL, DIGIT, OTHER = range(5)
#: Characters with a class of their own.
SINGLE = "@.+-()_%: \n,/'\""
CLASSES = 5 + len(SINGLE)
EMBEDDING, HIDDEN = 8, 16


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _class_table()
    return table[np.minimum(codes, len(table) - 1)]


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    table = np.full(0x250 + 1, OTHER, np.int64)
    for c in range(0x250):
        ch = chr(c)
        table[c] = CAPITAL if ch.isupper() else LETTER if ch.isalpha() else DIGIT if "0" <= ch <= "9" else OTHER
    for i, ch in enumerate(SINGLE):
        table[ord(ch)] = 5 + i
    return table


class Tagger:
    """Emission scores from two LSTMs, one for each direction, and transition scores of a CRF."""

    def __init__(self, seed: int):
        g = np.random.default_rng(seed)
        k = len(LABELS)
        self.p = {
            "e": g.normal(0, 0.3, (CLASSES, EMBEDDING)),
            "w": g.normal(0, 0.25, (2, EMBEDDING, 4 * HIDDEN)),
            "u": g.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)),
            "b": np.zeros((2, 1, 4 * HIDDEN)),
            "o": g.normal(0, 0.25, (2 * HIDDEN, k)),
            "c": np.zeros(k),
            "t": np.zeros((k, k)),
        }
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (windows, time, labels) of class numbers (windows, time)."""
        n, time = x.shape
        both = np.stack([x, x[:, ::-1]])
        inputs = self.p["e"][both] @ self.p["w"][:, None] + self.p["b"][:, None]
        h, c = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
        out = np.empty((2, n, time, HIDDEN))
        steps = []
        for t in range(time):
            z = inputs[:, :, t] + h @ self.p["u"]
            gates = 1 / (1 + np.exp(-z[..., : 3 * HIDDEN]))
            i, f, o = np.split(gates, 3, axis=-1)
            new = np.tanh(z[..., 3 * HIDDEN :])
            before, was = c, h
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[:, :, t] = h
            if keep is not None:
                steps.append((i, f, o, new, before, squashed, was))
        joined = np.concatenate([out[0], out[1][:, ::-1]], axis=-1)
        if keep is not None:
            keep |= {"steps": steps, "both": both, "joined": joined}
        return joined @ self.p["o"] + self.p["c"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best label sequence of each window (Viterbi), and the emission scores."""
        scores = self.emissions(x)
        n, time, k = scores.shape
        best, back = scores[:, 0], np.empty((time, n, k), np.int64)
        for t in range(1, time):
            step = best[:, :, None] + self.p["t"]
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[:, t]
        path = np.empty((n, time), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(time - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        return path, scores

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of labelled windows and its gradients."""
        keep: dict = {}
        scores = self.emissions(x, keep)
        n, time, k = scores.shape
        t_ = self.p["t"]
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, time):
            forward[:, t] = _sum_exp(forward[:, t - 1, :, None] + t_, 1) + scores[:, t]
        for t in range(time - 2, -1, -1):
            backward[:, t] = _sum_exp((backward[:, t + 1] + scores[:, t + 1])[:, None] + t_, 2)
        total = _sum_exp(forward[:, -1], 1)
        rows = np.arange(n)[:, None], np.arange(time)[None]
        gold = scores[rows[0], rows[1], y].sum(1) + t_[y[:, :-1], y[:, 1:]].sum(1)
        d = np.exp(forward + backward - total[:, None, None])
        d[rows[0], rows[1], y] -= 1
        d /= n
        pair = forward[:, :-1, :, None] + t_ + (scores[:, 1:] + backward[:, 1:])[:, :, None] - total[:, None, None, None]
        dt = np.exp(pair).sum((0, 1))
        np.subtract.at(dt, (y[:, :-1], y[:, 1:]), 1)
        grads = {"t": dt / n, "o": np.einsum("nth,ntk->hk", keep["joined"], d), "c": d.sum((0, 1))}
        dj = d @ self.p["o"].T
        dh_out = np.stack([dj[..., :HIDDEN], dj[:, ::-1, HIDDEN:]])
        dh, dc = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
        du, dz_all = np.zeros_like(self.p["u"]), np.empty((2, n, time, 4 * HIDDEN))
        back_u = self.p["u"].transpose(0, 2, 1)
        for t in range(time - 1, -1, -1):
            i, f, o, new, before, squashed, was = keep["steps"][t]
            dh = dh + dh_out[:, :, t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=-1)
            dz_all[:, :, t] = dz
            du += was.transpose(0, 2, 1) @ dz
            dh, dc = dz @ back_u, dc * f
        embedded = self.p["e"][keep["both"]]
        grads |= {"u": du, "w": np.einsum("dnte,dntz->dez", embedded, dz_all), "b": dz_all.sum((1, 2))[:, None]}
        de = np.zeros_like(self.p["e"])
        np.add.at(de, keep["both"], np.einsum("dntz,dez->dnte", dz_all, self.p["w"]))
        return float((total - gold).mean()), grads | {"e": de}


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# --- labelled spans and training --------------------------------------------------------------


def labelled_text(g: random.Random) -> tuple[str, list[Span]]:
    """A line of invented words and numbers with the spans of its personal data."""

    def word() -> str:
        w = "".join(g.choice("aeiourstnlmdhbcgéüß") for _ in range(g.randint(1, 10)))
        return (w.capitalize() if g.random() < 0.15 else w) + g.choice(["", "", "", "", ",", "."])

    def number(n: int) -> str:
        return "".join(g.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = number(g.choice([11, 12, 14, 15, 15, 15, 18]))
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = g.choice(["", "", " ", "-", ".", "/"])
        return mark.join(body[i : i + 4] for i in range(0, len(body), 4)) if mark else body

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        form = g.choice(["+{p} ({a}) {b}-{c}", "+{p} {a} {b} {c}", "+{p}-{a}-{b}-{c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "+{p}{a}{b}{c}", "00{p} {a} {b} {c}", "+{p}.{a}.{b}.{c}"])
        return form.format(p=number(g.randint(1, 2)), a=a, b=b, c=c)

    def email() -> str:
        name = "".join(g.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(g.randint(2, 9)))
        return f"{name}{g.choice(['', '.', '_', '+'])}{number(g.randint(0, 2)) or 'x'}@mail{g.choice(['', '1', '-x'])}.{g.choice(['example.com', 'test.org', 'münze.de'])}"

    def ip() -> str:
        return g.choice([".", ".", ".", "-"]).join(str(g.randint(0, 255)) for _ in range(4))

    def plain() -> str:
        return g.choice([lambda: number(g.randint(1, 8)), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(1)}.{number(1)}.{number(1)}", lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"{number(3)},{number(3)}.{number(2)}", lambda: "@" + word(), lambda: "".join(g.choice("0123456789abcdef") for _ in range(g.randint(6, 40)))])()

    text, spans = "", []
    while len(text) < WINDOW:
        if g.random() < 0.18:
            kind, make = g.choice([("email", email), ("ip", ip), ("card", card), ("phone", phone)])
            value = make()
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += plain() if g.random() < 0.12 else word()
        text += " " if g.random() < 0.95 else "\n"
    return text, spans


def encoded(examples: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Class and label numbers of each example's first window."""
    x, y = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for row, (text, spans) in enumerate(examples):
        part = classes(text[:WINDOW])
        x[row, : len(part)] = part
        for kind, a, b in spans:
            if a < WINDOW:
                at = 1 + 2 * KINDS.index(kind)
                y[row, a : min(b, WINDOW)] = at + 1
                y[row, a] = at
    return x, y


def train(examples: list[tuple[str, list[Span]]], steps: int = 260, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Tagger:
    """A tagger fitted by Adam to labelled spans; equal input gives an equal tagger."""
    tagger, g = Tagger(seed), np.random.default_rng(seed)
    x, y = encoded(examples)
    mean, square = ({k: np.zeros_like(v) for k, v in tagger.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = g.integers(0, len(x), batch)
        _, grads = tagger.gradients(x[rows], y[rows])
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
        for k, v in grads.items():
            v = v * min(1.0, 5.0 / norm)
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v**2
            tagger.p[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return tagger


@lru_cache(maxsize=1)
def default_tagger(examples: int = 3000, seed: int = 11) -> Tagger:
    """The tagger of ``find_personal_data``: trained on ``examples`` invented labelled lines."""
    g = random.Random(seed)
    return train([labelled_text(g) for _ in range(examples)])


# --- windows, reconciliation, the operator ----------------------------------------------------


def windows(text: str) -> list[int]:
    """Starts of the windows that hold an @ or four digits."""
    marks = [m.start() for m in re.finditer(r"[0-9@]", text)]
    starts, low = [], 0
    for start in sorted({max(0, m // STRIDE + k) * STRIDE for m in marks for k in (-1, 0)}):
        while low < len(marks) and marks[low] < start:
            low += 1
        high = bisect_right(marks, start + WINDOW - 1)
        if high - low >= 4 or any(text[i] == "@" for i in marks[low:high]):
            starts.append(start)
    return starts


def reconciled(found: list[tuple[float, Span]]) -> list[Span]:
    """Of all windows' spans the non-overlapping ones with the largest total score."""
    best_of: dict[Span, float] = {}
    for score, span in found:
        best_of[span] = max(score, best_of.get(span, 0.0))
    spans = sorted(best_of, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    total, pick = [0.0], []
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, i)
        with_it = total[before] + best_of[s]
        pick.append((with_it > total[i], before))
        total.append(max(total[i], with_it))
    out, i = [], len(spans)
    while i:
        taken, before = pick[i - 1]
        if taken:
            out.append(spans[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def formed(kind: str, value: str) -> bool:
    """The exact check of an added span's form."""
    digits = digits_of(value)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\W_][\w-]*(\.[\w-]+)+", value))
    if kind == "ip":
        parts = re.split(r"[.-]", value)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if kind == "card":
        return bool(CARD_FORM.fullmatch(value)) and 12 <= len(digits) <= 19 and luhn(digits)
    # a bare run of digits is a number like any other, unless it begins as numbers dialled abroad do
    return bool(PHONE_FORM.fullmatch(value)) and 9 <= len(digits) <= 15 and (value != digits or value.startswith("00"))


def settled(kind: str, value: str) -> str | None:
    """The kind whose form an added span has: phones after 00 may be taken for cards, as both are groups of digits."""
    if formed(kind, value):
        return kind
    dialled = kind == "card" and value.startswith("00") and not value.isdigit()
    return "phone" if dialled and formed("phone", value) else None


def added_spans(texts: list[str], tagger: Tagger, block: int = 512) -> list[list[Span]]:
    """The network's spans of each text that pass the check of their form, those that fail never displace others."""
    places = [(i, start) for i, text in enumerate(texts) for start in windows(text)]
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    for low in range(0, len(places), block):
        part = places[low : low + block]
        x = np.zeros((len(part), WINDOW), np.int64)
        for row, (i, start) in enumerate(part):
            c = classes(texts[i][start : start + WINDOW])
            x[row, : len(c)] = c
        path, scores = tagger.decode(x)
        gain = np.take_along_axis(scores, path[..., None], 2)[..., 0] - scores[..., 0]
        for row in np.flatnonzero((path > 0).any(axis=1)):
            i, start = part[row]
            for kind, a, b in _runs(path[row]):
                cut = (a == 0 and start > 0) + (b == WINDOW and start + WINDOW < len(texts[i]))
                score = float(gain[row, a:b].sum()) * (0.25 if cut else 1.0)
                a, b = start + a, min(start + b, len(texts[i]))
                kind = settled(kind, texts[i][a:b])
                if score > 0 and kind and not _inside_number(texts[i], a, b):
                    found[i].append((score, (kind, a, b)))
    return [reconciled(spans) if spans else [] for spans in found]


def _inside_number(text: str, a: int, b: int) -> bool:
    """Whether a place cuts a run of digits, as a window's border does."""
    edges = text[max(a - 1, 0) : a + 1], text[b - 1 : b + 1]
    return any(len(e) == 2 and e.isascii() and e.isdigit() for e in edges)


def _runs(path: np.ndarray) -> Iterator[Span]:
    at = 0
    while at < len(path):
        label = path[at]
        if not label:
            at += 1
            continue
        kind, end = (label - 1) // 2, at + 1
        while end < len(path) and path[end] == 2 * kind + 2:
            end += 1
        yield (KINDS[kind], at, end)
        at = end


def all_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int, bool]]]:
    """Base spans of each text, then the added ones.

    An added span overlaps no base span, or it is longer and has its kind: a plain pattern that knows
    ASCII letters alone finds a part of some addresses.
    """
    out = []
    for text, more in zip(texts, added_spans(texts, tagger), strict=True):
        base = sorted(base_spans(text), key=lambda s: s[1])
        tops = list(accumulate((b for *_, b in base), max))  # the furthest end so far
        free = []
        for kind, a, b in more:
            first, last = bisect_right(tops, a), bisect_left(base, b, key=lambda s: s[1])
            met = [s for s in base[first:last] if a < s[2]]
            if all(k == kind and a <= x and y <= b and y - x < b - a for k, x, y in met):
                free.append((kind, a, b))
        out.append([(*s, True) for s in base] + [(*s, False) for s in free])
    return out


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))


def _scan(tagger: Tagger) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                spans = all_spans([t.as_py() or "" for t in part.column(1)], tagger)
                rows = [[dict(zip(("kind", "start", "stop", "base"), s, strict=True)) for s in found] for found in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _span_type())], ["doc_id", "spans"])

    return run


def find_personal_data(documents: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every row's personal data as structs (kind, start, stop, base).

    Places are code points, ``stop`` exclusive; ``base`` tells the plain patterns' spans from those
    the network adds.  Whole texts are read.  A null text is empty, null ids and repeated rows stay,
    an empty table gives an empty result, other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(tagger or default_tagger()), "doc_id long, spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>")


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span's characters replaced by the span's kind in brackets."""
    merged: list[list] = []
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact_personal_data(documents: DataFrame, tagger: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """``documents`` with every span of ``find_personal_data`` replaced by its kind; columns stay.

    A null text stays null; other columns are as they were.
    """
    model = tagger or default_tagger()
    names, at = [f"c{i}" for i in range(len(documents.columns))], documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(at).to_pylist()
                found = all_spans([t or "" for t in texts], model)
                new = pa.array([t if t is None else redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == at else part.column(i) for i in range(len(names))], names)

    plain = documents.toDF(*names)  # whatever characters the columns' names have
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
