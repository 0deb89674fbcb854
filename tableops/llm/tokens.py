"""Token counts by rank-synchronous array merging.

A SentencePiece BPE model joins, in each pre-token, the neighbouring symbols whose
joined piece scores best, the leftmost of equals, until nothing can be joined. Here the
different pre-tokens of a batch are held as ragged arrays of symbols: one matrix for
each number of symbols left. From the longest down, each sequence that still has a pair
joins the one of lowest rank, all of a matrix at once, and is one symbol shorter, so it
moves on to the next matrix. What has no pair is done: its symbols are its tokens.

Pre-tokens are a run of spaces and the characters up to the next one: no piece goes
beyond that, which ``Merges`` checks. Runs of more than ``_ABREAST`` characters are cut
where two neighbours occur in no piece; parts that stay longer, such as long junk
without blanks, are joined one by one from a queue, in the same order.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tableops.llm.base import slices, texts
from tableops.llm.pieces import SPACE, Model

_PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Pre-tokens whose counts a worker remembers; only those of up to ``_ABREAST`` characters.
_KNOWN = 400_000
#: Characters of new pre-tokens merged at once.
_AT_ONCE = 1 << 18
_ABREAST = 64
_NEVER = np.iinfo(np.int32).max


class Merges:
    """A model's joins: which symbols may be neighbours, at what rank and into what.

    Single characters are symbols by their id; a character of no piece is the symbol
    ``len(pieces)`` and later as many tokens as it has bytes in UTF-8.
    """

    def __init__(self, model: Model):
        if {4, 5} & set(model.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece goes beyond a space")
        joined = {p: -model.scores[i] for p, i in normal.items() if len(p) > 1}
        rank_of = {score: r for r, score in enumerate(sorted(set(joined.values())))}
        self.symbol = np.full(0x110000, len(model.pieces), dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.unknown = len(model.pieces)
        pairs, inside = {}, set()
        for p, score in joined.items():
            inside.update(zip(map(ord, p), map(ord, p[1:]), strict=False))
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank_of[score], normal[p]
        ordered = [(k, *pairs[k]) for k in sorted(pairs)] + [(np.iinfo(np.int64).max, _NEVER, 0)]
        self.keys = np.array([k for k, _, _ in ordered], dtype=np.int64)
        self.ranks = np.array([r for _, r, _ in ordered], dtype=np.int32)
        self.made = np.array([i for _, _, i in ordered], dtype=np.int32)
        self.by_pair = pairs
        self.inside = np.array(sorted(x << 32 | y for x, y in inside) or [-1], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of joining each of ``a`` with its ``b``; ``_NEVER`` if they don't join."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol each of ``a`` makes with its ``b``, which do join."""
        return self.made[np.searchsorted(self.keys, a.astype(np.int64) << 32 | b)]

    def parted(self, codes: np.ndarray) -> np.ndarray:
        """Where in a run of characters no piece can go across: starts of its parts, 0 included."""
        key = codes[:-1].astype(np.int64) << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        return np.r_[0, np.flatnonzero(self.inside[at] != key) + 1]


def _abreast(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols are left of each sequence ``symbols[start : start + size]``."""
    left = sizes.copy()
    by_size = np.argsort(sizes, kind="stable")
    cuts = np.searchsorted(sizes[by_size], np.arange(sizes.max(initial=0) + 2))
    rows = np.zeros((0, 0), np.int32)
    ranks = np.zeros((0, 0), np.int32)
    owner = np.zeros(0, np.int64)
    for size in range(int(sizes.max(initial=0)), 1, -1):
        new = by_size[cuts[size] : cuts[size + 1]]
        if len(new):
            own = symbols[starts[new][:, None] + np.arange(size)]
            rank = merges.rank(own[:, :-1].ravel(), own[:, 1:].ravel()).reshape(len(new), size - 1)
            rows = np.concatenate([rows, own]) if len(owner) else own
            ranks = np.concatenate([ranks, rank]) if len(owner) else rank
            owner = np.r_[owner, new]
        if not len(owner):
            continue
        at = ranks.argmin(axis=1)  # the leftmost of the lowest
        lowest = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
        left[owner] = size
        live = lowest != _NEVER
        rows, ranks, owner, at = rows[live], ranks[live], owner[live], at[live]
        n, every = len(owner), np.arange(len(owner))
        rows[every, at] = merges.joined(rows[every, at], rows[every, at + 1])
        stay = np.ones((n, size), bool)
        stay[every, at + 1] = False
        rows = rows[stay].reshape(n, size - 1)
        stay = np.ones((n, size - 1), bool)
        stay[every, at] = False
        ranks = ranks[stay].reshape(n, size - 2)
        i = np.flatnonzero(at > 0)
        ranks[i, at[i] - 1] = merges.rank(rows[i, at[i] - 1], rows[i, at[i]])
        i = np.flatnonzero(at < size - 2)
        ranks[i, at[i]] = merges.rank(rows[i, at[i]], rows[i, at[i] + 1])
    left[owner] = np.minimum(left[owner], 1)  # joined down to one symbol
    return left


def _queued(symbols: list[int], merges: Merges) -> int:
    """How many symbols are left of one long sequence."""
    pairs = merges.by_pair
    after = [*range(1, len(symbols)), -1]
    before = list(range(-1, len(symbols) - 1))
    queue: list[tuple[int, int, int]] = []  # rank, place, key of the pair it was

    def put(i: int, j: int) -> None:
        key = symbols[i] << 32 | symbols[j]
        if key in pairs:
            heapq.heappush(queue, (pairs[key][0], i, key))

    for i in range(len(symbols) - 1):
        put(i, i + 1)
    left = len(symbols)
    while queue:
        _, i, key = heapq.heappop(queue)
        j = after[i]
        if symbols[i] < 0 or j < 0 or symbols[i] << 32 | symbols[j] != key:
            continue  # one of the two has been joined since
        symbols[i], symbols[j] = pairs[key][1], -1
        left -= 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            put(i, k)
        if before[i] >= 0:
            put(before[i], i)
    return left


def merged(pre_tokens: list[str], merges: Merges) -> np.ndarray:
    """The number of tokens of each pre-token."""
    sizes = np.array([len(p) for p in pre_tokens], dtype=np.int64)
    codes = np.frombuffer("".join(pre_tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = merges.symbol[codes]
    starts = np.cumsum(sizes) - sizes
    widths = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    extra = np.r_[0, np.cumsum(np.where(symbols == merges.unknown, widths - 1, 0))]
    tokens = extra[starts + sizes] - extra[starts]  # an unknown character's bytes beyond the first

    owner, begins = [np.flatnonzero(sizes <= _ABREAST)], [starts[sizes <= _ABREAST]]
    ends = [begins[0] + sizes[owner[0]]]
    for i in np.flatnonzero(sizes > _ABREAST).tolist():
        a, z = int(starts[i]), int(starts[i] + sizes[i])
        edges = a + np.r_[merges.parted(codes[a:z]), z - a]
        few = np.diff(edges) <= _ABREAST
        owner.append(np.full(int(few.sum()), i))
        begins.append(edges[:-1][few])
        ends.append(edges[1:][few])
        for b, e in zip(edges[:-1][~few].tolist(), edges[1:][~few].tolist(), strict=True):
            tokens[i] += _queued(symbols[b:e].tolist(), merges)
    who, first, last = (np.concatenate(x) for x in (owner, begins, ends))
    np.add.at(tokens, who, _abreast(symbols, first, last - first, merges))
    return tokens


class Counter:
    """Counts tokens of batches of texts and remembers pre-tokens between them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known: dict[str, int] = {}

    def __call__(self, batch_texts: list[str]) -> list[int]:
        split = [_PRE_TOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in batch_texts]
        if len(self.known) > _KNOWN:
            self.known.clear()
        new = list({p for own in split for p in own if p not in self.known})
        ends = np.cumsum([len(p) for p in new])
        counts, long, at = self.known, [], 0
        while at < len(new):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE)))
            counts.update(zip(new[at:to], merged(new[at:to], self.merges).tolist(), strict=True))
            long += [p for p in new[at:to] if len(p) > _ABREAST]
            at = to
        out = [sum(map(counts.__getitem__, own)) for own in split]
        for p in long:
            del counts[p]
        return out


_WORKER: dict[Model, Counter] = {}


def _counter(model: Model) -> Counter:
    if model not in _WORKER:
        _WORKER.clear()
        _WORKER[model] = Counter(Merges(model))
    return _WORKER[model]


def count(docs: DataFrame, model: Model, *keep: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``keep`` columns of every row, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    The counts are those of the library: no begin, end or added special tokens, the
    strings of special tokens are ordinary text, nothing is cut off. A null or empty
    text has no byte and no token. Rows of equal texts get equal counts; other columns may
    have any name.
    """
    plain, kept, fields = texts(docs, *keep, text=text)

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in slices(batches):
            n = pa.array(counter(batch["text"].to_pylist()), pa.int64())
            sizes = pc.binary_length(batch["text"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in kept), sizes, n, pc.greater(n, limit)],
                [*kept, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = fields + "n_bytes long, n_tokens long, over_limit boolean"
    return plain.mapInArrow(counting, schema).toDF(*keep, "n_bytes", "n_tokens", "over_limit")
