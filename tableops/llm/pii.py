"""Personal data: patterns, and a character-level BiLSTM with a CRF for disguised forms.

Patterns give the base spans. A tagger learns from the labelled spans of a bounded sample:
as they are, in disguise (``name [at] host``, ``10[.]0[.]0[.]1``, digits in other groups), next to one
another, with other letters and digits in their places, in different contexts, as many windows of
each kind; and from windows with numbers and signs that are no personal data. It
then reads every stretch of text that could hold such a span, in overlapping windows.
Spans of different windows are reconciled over the whole text, and one is added
only if it has the structure of a value of its kind, whatever marks disguise it.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.base import lowest_by_hash, slices, staged, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|&#64;|[\[({<_] ?(?:at|dot) ?[\])}>_]|(?<![^\W_])dot(?![^\W_])", re.IGNORECASE)

#: Window of the tagger, how far neighbours overlap, and what it reads around a trigger.
WINDOW, OVERLAP, AROUND = 64, 32, 24
_TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(parts: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts.split("."))


def base_spans(text: str) -> list[Span]:
    """The spans the patterns find, by kind and place; linear in the text's length."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text) if _small(m[0])]
    found += [
        (2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)
    ]
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


#: How training disguises spans: signs for ``@`` and ``.`` of an email, for the dots of an
#: ip, between groups of a card, and how a phone begins. A parameter of ``train``.
FORMS: dict[str, tuple] = {
    "email": (
        (" [at] ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "[dot]"),
        (" (at) ", " (dot) "), ("{at}", "{dot}"), (" [@] ", "."), ("&#64;", "."), (" AT ", " DOT "),
    ),
    "ip": ("[.]", "(.)", " . ", "[dot]", " dot ", "{.}"),
    "card": (".", "  ", "/", " - ", "_", " . "),
    "phone": ("00", "+ ", "00 ", "+  "),
}

_AT = r"(?:\s*(?:[\[({<_]\s*(?:at|@)\s*[\])}>_]|&\#64;|@)\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\.|\s+dot\s+)"
_HOST = rf"[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+"
_MAIL = re.compile(rf"[a-z0-9._%+-]+{_AT}{_HOST}", re.IGNORECASE)
# a bare word "at" is one only where the dots are words too
_MAIL_WORDS = re.compile(r"[a-z0-9._%+-]+\s+at\s+[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+", re.IGNORECASE)
_QUAD = re.compile(
    r"([0-9]{1,3})(\s*[\[({]?\s*(?:\.|dot)\s*[\])}]?\s*)([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})", re.IGNORECASE
)
_GROUPS = re.compile(r"[0-9]{16,19}|[0-9]{4}([ ./_-]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?")
_CALL = re.compile(r"\(?(?:\+|00) {0,2}([1-9][0-9]*)(\)?[ ().0-9/-]+[0-9])")


def _disguised(kind: int, value: str, form) -> str:
    if kind == 0:
        local, _, domain = value.partition("@")
        return local + form[0] + domain.replace(".", form[1])
    if kind == 1:
        return value.replace(".", form)
    if kind == 2:
        digits = _digits(value)
        return form.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    end = re.match(r"\+[0-9]+", value).end()
    return form + value[1:end] + (")" if form.startswith("(") else "") + value[end:]


def structured(kind: int, value: str) -> bool:
    """Whether ``value`` as a whole is built like one of its kind, disguised by any marks.

    An email has a sign or word in marks for ``@`` (a bare ``at`` only with bare ``dot``) and two labels or
    more; an ip four numbers up to 255 with one and the same dot between; a card 16 to 19
    digits in a row or in fours, that pass Luhn; a phone an international prefix, 8 to 15 digits and a sign between them.
    """
    if kind == 0:
        return bool(_MAIL.fullmatch(value) or _MAIL_WORDS.fullmatch(value))
    if kind == 1:
        found = _QUAD.fullmatch(value)
        return bool(found) and all(int(found[i]) <= 255 for i in (1, 3, 4, 5))
    digits = _digits(value)
    if kind == 2:
        return bool(_GROUPS.fullmatch(value)) and 16 <= len(digits) <= 19 and luhn(digits)
    found = _CALL.fullmatch(value)
    if not found or not 8 <= len(found[1]) + len(_digits(found[2])) <= 15:
        return False
    return bool(re.search("[^0-9]", found[2]))


def valid(text: str, span: Span) -> bool:
    """Whether the span stands apart from words and numbers, and is built like a value of its kind."""
    kind, start, end = span
    beside = text[start - 1 : start] + text[end : end + 1]
    return not any(c.isalnum() for c in beside) and structured(kind, text[start:end])


_TOKEN = re.compile(r"\S+")
#: Words on either side of a tagged span that may belong to it, and how far they may reach.
_MORE_WORDS, _MORE_CHARS = 3, 32
_LEFT, _RIGHT = "\"'<,;:", "\"'>.,;:!?"


def settled(text: str, span: Span) -> list[Span]:
    """The valid spans that a tagged one means: itself, or runs of whole words in and next to it.

    A tagger may be off by some characters, stop a group early or take two values for one. The
    words it tagged and a few beside them are tried in all runs, less signs around them;
    of runs one in the other the longer counts. Values often come in a row, so the words next to a
    valid one are looked at, too.
    """
    kind, start, end = span
    if valid(text, span):
        beside = [_TOKEN.match(text, end + 1), _TOKEN.search(text[max(0, start - WINDOW) : start].rstrip()[::-1])]
        out = [span]
        if beside[0] and valid(text, (kind, *beside[0].span())):
            out.append((kind, *beside[0].span()))
        if beside[1] and beside[1].start() == 0:
            before = len(text[:start].rstrip())
            own = (kind, before - beside[1].end(), before)
            out += [own] if valid(text, own) else []
        return out
    words = [m.span() for m in _TOKEN.finditer(text, max(0, start - _MORE_CHARS), min(len(text), end + _MORE_CHARS))]
    first = max(0, sum(e <= start for _, e in words) - _MORE_WORDS)
    last = len(words) - max(0, sum(s >= end for s, _ in words) - _MORE_WORDS)
    words = words[first:last]
    out: list[Span] = []
    for size in range(min(len(words), 12), 0, -1):
        for i in range(len(words) - size + 1):
            a, b = words[i][0], words[i + size - 1][1]
            while a < b and text[a] in _LEFT:
                a += 1
            while b > a and text[b - 1] in _RIGHT:
                b -= 1
            apart = b <= start or a >= end  # has to touch what was tagged
            if not apart and not any(s <= a and b <= e for _, s, e in out) and valid(text, (kind, a, b)):
                out.append((kind, a, b))
    return out


# ---------------------------------------------------------------- the tagger

_ALPHABET = {c: i + 4 for i, c in enumerate(map(chr, range(32, 127)))}
_PAD, _LETTER, _BLANK, _OTHER = 0, 1, 2, 3
_SYMBOLS = 4 + 95


def _symbols(text: str) -> list[int]:
    known = _ALPHABET
    return [
        known[c] if c in known else _LETTER if c.isalpha() else _BLANK if c.isspace() else _OTHER
        for c in text
    ]


@dataclass(frozen=True)
class Tagger:
    """Weights: embedding; for either direction input, recurrent and bias; output; CRF."""

    weights: dict[str, np.ndarray]

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag path of each row of symbols, and how far it beats "outside" throughout."""
        w = self.weights
        emission, _ = _emissions(w, windows)
        steps, rows, tags = emission.shape
        score = emission[0] + w["start"]
        back = np.zeros((steps, rows, tags), dtype=np.int64)
        for t in range(1, steps):
            every = score[:, :, None] + w["moves"][None]
            back[t] = every.argmax(axis=1)
            score = every.max(axis=1) + emission[t]
        path = np.zeros((steps, rows), dtype=np.int64)
        path[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][np.arange(rows), path[t]]
        none = emission[:, :, 0].sum(axis=0) + w["start"][0] + (steps - 1) * w["moves"][0, 0]
        return path.T, score.max(axis=1) - none


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    """Hidden states over steps (steps, rows, width) and what the way back needs."""
    steps, rows, _ = x.shape
    width = wh.shape[0]
    h, c = np.zeros((rows, width), x.dtype), np.zeros((rows, width), x.dtype)
    into = x @ wx + b
    states, kept = np.zeros((steps, rows, width), x.dtype), []
    for t in range(steps):
        z = into[t] + h @ wh
        i, f, o = (_sigmoid(z[:, k * width : (k + 1) * width]) for k in range(3))
        g = np.tanh(z[:, 3 * width :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        kept.append((h, before, i, f, o, g, tc))
        h = o * tc
        states[t] = h
    return states, kept


def _lstm_back(x, wx, wh, kept, d_states):
    steps, rows, width = d_states.shape
    dh, dc = np.zeros((rows, width), x.dtype), np.zeros((rows, width), x.dtype)
    d_into = np.zeros((steps, rows, 4 * width), x.dtype)
    d_wh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, tc = kept[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1
        )
        d_into[t] = dz
        d_wh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = d_into.reshape(-1, 4 * width)
    return d_into @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, d_wh, flat.sum(axis=0)


def _emissions(w: dict[str, np.ndarray], windows: np.ndarray):
    x = w["embed"][windows.T]
    ahead, kept_a = _lstm(x, w["ax"], w["ah"], w["ab"])
    back, kept_b = _lstm(x[::-1], w["bx"], w["bh"], w["bb"])
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return both @ w["out"] + w["bias"], (x, both, kept_a, kept_b)


def _summed(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(w: dict[str, np.ndarray], windows: np.ndarray, tags: np.ndarray):
    """The mean negative log likelihood of the tag paths, and its gradient by weight."""
    emission, (x, both, kept_a, kept_b) = _emissions(w, windows)
    steps, rows, width = emission.shape
    moves, gold = w["moves"], tags.T
    alpha = np.zeros_like(emission)
    alpha[0] = emission[0] + w["start"]
    for t in range(1, steps):
        alpha[t] = _summed(alpha[t - 1][:, :, None] + moves[None], 1) + emission[t]
    whole = _summed(alpha[-1], 1)
    d_moves, d_emission = np.zeros_like(moves), np.zeros_like(emission)
    beta = np.zeros_like(emission[0])
    for t in range(steps - 1, -1, -1):
        d_emission[t] = np.exp(alpha[t] + beta - whole[:, None])
        if t:
            ahead = emission[t] + beta
            pair = alpha[t - 1][:, :, None] + moves[None] + ahead[:, None, :] - whole[:, None, None]
            d_moves += np.exp(pair).sum(axis=0)
            beta = _summed(moves[None] + ahead[:, None, :], 2)
    at = np.arange(rows)
    path = w["start"][gold[0]] + emission[0][at, gold[0]]
    for t in range(steps):
        d_emission[t][at, gold[t]] -= 1
        if t:
            path = path + moves[gold[t - 1], gold[t]] + emission[t][at, gold[t]]
            np.add.at(d_moves, (gold[t - 1], gold[t]), -1)
    d_both = d_emission @ w["out"].T
    half = both.shape[2] // 2
    xa, ax, ah, ab = _lstm_back(x, w["ax"], w["ah"], kept_a, d_both[:, :, :half])
    xb, bx, bh, bb = _lstm_back(x[::-1], w["bx"], w["bh"], kept_b, d_both[::-1, :, half:])
    d_embed = np.zeros_like(w["embed"])
    np.add.at(d_embed, windows.T, xa + xb[::-1])
    grads = {
        "embed": d_embed, "ax": ax, "ah": ah, "ab": ab, "bx": bx, "bh": bh, "bb": bb,
        "out": both.reshape(-1, 2 * half).T @ d_emission.reshape(-1, width),
        "bias": d_emission.sum(axis=(0, 1)), "moves": d_moves, "start": d_emission[0].sum(axis=0),
    }
    return float((whole - path).mean()), {k: g / rows for k, g in grads.items()}


def start_weights(embed: int = 12, hidden: int = 16, seed: int = 7, kind=np.float32) -> dict:
    rng = np.random.default_rng(seed)

    def some(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(kind)

    w = {"embed": some(_SYMBOLS, embed) * 3, "out": some(2 * hidden, _TAGS)}
    for d in "ab":
        w |= {f"{d}x": some(embed, 4 * hidden), f"{d}h": some(hidden, 4 * hidden)}
        w[f"{d}b"] = np.zeros(4 * hidden, kind)
        w[f"{d}b"][hidden : 2 * hidden] = 1  # remember at first
    return w | {
        "bias": np.zeros(_TAGS, kind), "moves": np.zeros((_TAGS, _TAGS), kind), "start": np.zeros(_TAGS, kind),
    }


def fit(
    windows: np.ndarray, tags: np.ndarray, rounds: int = 12, rows: int = 64, rate: float = 0.01, seed: int = 7
) -> Tagger:
    """A tagger from windows of symbols and their tags, by Adam with gradient clipping."""
    w, rng = start_weights(seed=seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    turn, total = 0, rounds * -(-len(windows) // rows)
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), rows):
            turn += 1
            some = order[at : at + rows]
            _, grads = gradients(w, windows[some], tags[some])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step = rate * (1 - turn / (total + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-6))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g**2
                size = np.sqrt(square[k] / (1 - 0.999**turn)) + 1e-8
                w[k] = w[k] - (step * (mean[k] / (1 - 0.9**turn)) / size).astype(w[k].dtype)
    return Tagger(w)


# ---------------------------------------------------------------- windows and spans


def labelled(text: str, spans: list[Span]) -> tuple[list[int], list[int]]:
    """Symbols and tags of one window, padded."""
    tags = [0] * WINDOW
    for kind, start, end in spans:
        for i in range(max(start, 0), min(end, WINDOW)):
            tags[i] = 1 + 2 * kind + (i > start)
    own = _symbols(text[:WINDOW])
    return own + [_PAD] * (WINDOW - len(own)), tags


_SIDE = 48


def _examples(text: str) -> Iterator[tuple[int, str, str, str]]:
    """``(kind, before, value, after)``: each base span with what stands around it; kind -1 for windows
    around other numbers and signs, whose value is empty."""
    spans = base_spans(text)
    for kind, start, end in spans:
        yield kind, text[max(0, start - _SIDE) : start], text[start:end], text[end : end + _SIDE]
    edges = sorted((s, e) for _, s, e in spans)
    taken = 0
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if at < taken:
            continue
        low = max(0, at - 20)
        i = bisect_left(edges, (low - WINDOW,))
        near = any(s < low + WINDOW and low < e for s, e in edges[i : i + 8])
        # digits as long as a card's look like one; only Luhn, which is checked later, tells
        if not near and not re.search("[0-9][ -]?(?:[0-9][ -]?){14,}", text[low : low + WINDOW]):
            yield -1, text[low : low + WINDOW], "", ""
        taken = at + WINDOW


def _varied(kind: int, value: str, rng: random.Random) -> str:
    """The value with other letters and digits in their places; of an email also other parts."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def other(part: str) -> str:
        return "".join(
            rng.choice("0123456789") if "0" <= c <= "9" else rng.choice(letters) if "a" <= c <= "z" else c
            for c in part
        )

    if kind:
        return other(value)
    local, _, domain = value.partition("@")
    word = "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    labels = domain.split(".")
    local = rng.choice((other(local), word, f"{word}.{other(word)}", f"{word}{rng.randrange(100)}"))
    labels = rng.choice((labels, labels[-2:], [word[::-1], labels[-1]], [other(word), word, labels[-1]]))
    ending = rng.choice((labels[-1], "".join(rng.choice(letters) for _ in range(rng.randint(2, 4)))))
    return f"{local}@{'.'.join([*map(other, labels[:-1]), ending])}"


def _windows_of(rows: list[tuple[int, str, str, str]], each: int, forms: dict, seed: int) -> Iterator[tuple[str, list[Span]]]:
    """``each`` windows of every kind among ``rows``, with the spans they show.

    A third as they are, the rest in disguise; half with other letters and digits; every
    sixth next to a second value of the kind. Where in its window a span stands, and what stands before
    and after it, differs.
    """
    rng = random.Random(seed)
    sides = [(b, a) for _, b, _, a in rows] or [("", "")]
    for kind, name in enumerate(KINDS):
        own = [r for r in rows if r[0] == kind and len(r[2]) <= WINDOW - 8]
        for i in range(each if own else 0):
            _, before, value, after = own[i % len(own)]
            if rng.random() < 0.5:
                value = _varied(kind, value, rng)
            if rng.random() < 0.5:
                before, after = rng.choice(sides)[0], rng.choice(sides)[1]
            if i % 3 and forms.get(name):
                value = _disguised(kind, value, rng.choice(forms[name]))
            values = [value]
            if i % 6 == 5:
                values.append(_varied(kind, value, rng) if i % 3 == 0 or kind else value)
            before = before[max(0, len(before) - rng.randrange(0, _SIDE)) :]
            if before and before[-1].isalnum():
                before += " "
            text, spans = before, []
            for v in values:
                spans.append((kind, len(text), len(text) + len(v)))
                text += v + " "
            text = text[:-1] + (after if after[:1] and not after[0].isalnum() else " " + after)
            low = max(0, min(rng.randrange(0, 24), spans[0][1] - 1)) if spans[0][1] else 0
            yield text[low : low + WINDOW], [(k, a - low, b - low) for k, a, b in spans if a - low < WINDOW]


def train(
    docs: DataFrame,
    max_spans: int = 400,
    max_clean: int = 1000,
    each: int = 700,
    forms: dict[str, tuple] | None = None,
    seed: int = 7,
    **shape,
) -> Tagger | None:
    """A tagger from at most ``max_spans`` labelled spans of each kind and ``max_clean`` windows without any.

    Which ones is decided by a hash, so that it does not depend on the
    order of rows. ``each`` windows of a kind are made of its spans, however few there are; ``forms`` are the
    disguises (``FORMS``). Spans longer than a window less eight characters don't train, but are found.
    None if no document holds a base span.
    """
    plain, _, _ = texts(docs)

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [x for t in batch["text"].to_pylist() for x in _examples(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), *[pa.string()] * 3))],
                ["kind", "before", "value", "after"],
            )

    fields = "kind int, before string, value string, after string"
    cut = staged(plain.mapInArrow(cutting, fields).distinct(), "pii-windows")
    rows = []
    for kind in range(len(KINDS)):
        own = cut.where(F.col("kind") == kind)
        rows += [tuple(r) for r in lowest_by_hash(own, max_spans, "before", "value", "after").collect()]
    if not rows:
        return None
    clean = lowest_by_hash(cut.where("kind = -1"), max_clean, "before").collect()
    made = list(_windows_of(rows, each, FORMS if forms is None else forms, seed))
    made = [labelled(*m) for m in [*made, *((r.before, []) for r in clean)]]
    return fit(np.array([m[0] for m in made]), np.array([m[1] for m in made]), **shape)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around triggers, overlapping parts joined."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out


def _windows(text: str) -> list[int]:
    """Where windows start: over every stretch, each next one ``OVERLAP`` back."""
    starts = []
    for low, high in _stretches(text):
        starts += range(low, max(low + 1, high - OVERLAP), WINDOW - OVERLAP)
    return starts


def _spans_of(path: np.ndarray) -> list[Span]:
    """Spans of a tag path; a kind that changes without a first character starts anew."""
    out: list[Span] = []
    for i in np.flatnonzero(path).tolist():
        kind, further = divmod(int(path[i]) - 1, 2)
        if further and out and out[-1][0] == kind and out[-1][2] == i:
            out[-1] = (kind, out[-1][1], i + 1)
        else:
            out.append((kind, i, i + 1))
    return out


def reconciled(text: str, offered: list[tuple[float, Span]], base: list[Span]) -> list[Span]:
    """Of the valid spans all windows offer, those that overlap no base span and no better one.

    Better is the longer one, then the one of the surer window, then the first.
    """
    meant: dict[Span, float] = {}
    for sure, span in set(offered):
        for own in settled(text, span):
            meant[own] = max(sure, meant.get(own, sure))
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    tops = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    kept: list[Span] = []
    held: list[tuple[int, int]] = []  # by place; they are apart
    for span in sorted(meant, key=lambda x: (x[1] - x[2], -meant[x], x)):
        _, start, end = span
        before = bisect_left(starts, end) - 1
        if before >= 0 and tops[before] > start:
            continue
        i = bisect_left(held, (start, end))
        if any(s < end and start < e for s, e in held[max(0, i - 1) : i + 1]):
            continue
        insort(held, (start, end))
        kept.append(span)
    return sorted(kept)


def _joined(found: list[tuple[float, Span, bool, bool]]) -> list[tuple[float, Span]]:
    """Spans of all windows of a text, those cut by an edge joined with their continuation.

    A span is ``(sure, span, cut before, cut after)``. Two of one kind that overlap or
    touch belong together if one is cut where the other goes on; both they and the whole
    run of such spans are offered.
    """
    out = [(sure, span) for sure, span, before, after in found if not before and not after]
    run: tuple[float, Span, bool, bool] | None = None
    last = run
    for sure, (kind, start, end), before, after in sorted(set(found), key=lambda x: x[1]):
        goes_on = run is not None and run[1][0] == kind and start <= run[1][2] and (run[3] or before)
        if goes_on:
            out.append((min(last[0], sure), (kind, last[1][1], max(last[1][2], end))))
            open_end = after if end > run[1][2] else run[3] and (after or end < run[1][2])
            run = min(run[0], sure), (kind, run[1][1], max(run[1][2], end)), run[2], open_end
            out.append((run[0], run[1]))
        else:
            run = sure, (kind, start, end), before, after
        last = sure, (kind, start, end), before, after
    return out


def _further(text: str, start: int, before: bool, after: bool) -> list[int]:
    """Where windows go on from one at ``start`` with a span cut before or after it.

    Before it from the start of the run of characters without a blank, with as much ahead as in training.
    """
    out = [start + WINDOW - OVERLAP] if after else []
    if before:
        low = start
        while low and not text[low - 1].isspace():
            low -= 1
        low = max(0, min(low - 16, start - OVERLAP))
        out += range(low, start, WINDOW - OVERLAP)
    return out


def added_spans(batch_texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """What the tagger finds beyond the base spans of each text.

    Windows are added for as long as a span is cut by the edge of the outermost one.
    """
    places = [(d, s) for d, t in enumerate(batch_texts) for s in _windows(t)]
    found: list[list[tuple[float, Span, bool, bool]]] = [[] for _ in batch_texts]
    done = set(places)
    while places:
        more: list[tuple[int, int]] = []
        for at in range(0, len(places), 512):
            some = places[at : at + 512]
            symbols = np.full((len(some), WINDOW), _PAD)
            for r, (d, s) in enumerate(some):
                own = _symbols(batch_texts[d][s : s + WINDOW])
                symbols[r, : len(own)] = own
            paths, sure = tagger.decode(symbols)
            for r in np.flatnonzero(paths.any(axis=1)).tolist():
                d, s = some[r]
                size = len(batch_texts[d])
                for kind, a, b in _spans_of(paths[r]):
                    if s + b > size:
                        continue
                    before, after = a == 0 and s > 0, b == WINDOW and s + b < size
                    found[d].append((float(sure[r]), (kind, s + a, s + b), before, after))
                    if before and (d, max(0, s - OVERLAP)) in done:  # a window of the stretch goes on
                        before = False
                    for start in _further(batch_texts[d], s, before, after):
                        if (d, start) not in done:
                            done.add((d, start))
                            more.append((d, start))
        places = more
    return [reconciled(t, _joined(f), b) for t, f, b in zip(batch_texts, found, base, strict=True)]


def _tagged(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, tagger: Tagger | None, *keep: str) -> DataFrame:
    """``keep`` columns of every row, the number of base spans by kind, and all spans.

    ``base_spans`` and ``spans`` list ``kind:start:end`` by kind and place, in characters.
    A null or empty text has none. Without a tagger there are only base spans.
    """
    plain, kept, fields = texts(docs, *keep)
    counts = [f"n_{k}" for k in KINDS]

    def finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = batch["text"].to_pylist()
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in own]
            more = added_spans(own, base, tagger) if tagger else [[] for _ in own]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[k] for k in kept),
                    *(pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))),
                    pa.array([_tagged(b) for b in base], pa.string()),
                    pa.array([_tagged(sorted(b + m)) for b, m in zip(base, more, strict=True)], pa.string()),
                    pa.array([len(m) for m in more], pa.int64()),
                ],
                [*kept, *counts, "base_spans", "spans", "n_added"],
            )

    schema = fields + ", ".join(f"{c} long" for c in counts)
    return plain.mapInArrow(finding, schema + ", base_spans string, spans string, n_added long").toDF(
        *keep, *counts, "base_spans", "spans", "n_added"
    )
