"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

A window is a string of ``length`` bytes; a byte goes if a window around it also
starts anywhere else. Sorting every suffix of a corpus would move each byte many
times, so suffixes are sampled: of the short grams in a window the one with the
smallest hash is its anchor. Equal windows have their anchors at the same offset.

1. Anchors are counted by gram. Where a gram occurs once no window around it repeats,
   and it goes no further.
2. Anchors left are counted by gram and a hash of all bytes their windows can hold (the
   context). An anchor whose context occurs twice has only repeated windows.
3. Windows of the other anchors left are open, unless one of those lies in them. They
   are decided by suffix sorts: the contexts of a gram meet, suffixes start where
   their open windows do, a merge sort compares two suffixes by the longest prefix
   whose polynomial hashes agree (binary search over prefix hashes), and neighbours
   with a whole window in common are compared byte by byte.

Counts are summed before they are shuffled, and joins that bring them back have one
row on the other side, so that adaptive execution can split a gram that much of the
corpus holds. A gram with more than ``Limits.group`` different contexts meets in no
task; its open windows are counted by their hashes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.base import slices, spread, staged

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OPEN, _TWICE = 1, 2


@dataclass(frozen=True)
class Limits:
    """``length`` of a window, of the sampled ``gram``, and contexts of a gram in one task."""

    length: int = 200
    gram: int = 64
    group: int = 2000

    @property
    def before(self) -> int:
        """How far before its anchor a window may start."""
        return self.length - self.gram


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class PrefixHashes:
    """Polynomial hashes, modulo 2**64, of any part of an array of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        powers, self.inverse = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        powers[0] = self.inverse[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.upto = np.zeros(n, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers[:-1], out=self.upto[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.upto[end] - self.upto[start]) * self.inverse[start]


def common_prefix(h: PrefixHashes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many of the ``length`` bytes from ``a`` and ``b`` on agree, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = h.of(a, a + middle) == h.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(
    data: np.ndarray, h: PrefixHashes, starts: np.ndarray, groups: np.ndarray, length: int
) -> np.ndarray:
    """The order of suffixes (their first ``length`` bytes) inside each group.

    ``groups`` is ascending. A merge sort of all groups at once: at every level each
    suffix finds its place among those of the sibling run by binary search.
    """
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    size = np.diff(np.r_[first, n])
    begin, count = np.repeat(first, size), np.repeat(size, size)
    local = np.arange(n) - begin
    run = 1
    while run < size.max():
        pair = local // (2 * run) * (2 * run)
        left = local - pair < run
        other = np.where(left, pair + run, pair)
        low = np.minimum(other, count)
        high = np.minimum(other + run, count)
        at, top = low.copy(), high.copy()
        while (busy := np.flatnonzero(at < top)).size:
            middle = (at[busy] + top[busy]) // 2
            a, b = starts[order[busy]], starts[order[begin[busy] + middle]]
            agree = common_prefix(h, a, b, length)
            end = agree >= length
            shift = np.minimum(agree, length - 1)
            less = data[b + shift] < data[a + shift]
            goes = np.where(end, ~left[busy], less)  # of equal ones the left run's come first
            at[busy] = np.where(goes, middle + 1, at[busy])
            top[busy] = np.where(goes, top[busy], middle)
        own = np.where(left, local - pair, local - pair - run)
        placed = np.empty(n, np.int64)
        placed[begin + pair + own + (at - low)] = order
        order, run = placed, 2 * run
    return order


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where each body begins and ends."""
    ends = np.cumsum([len(b) for b in bodies])
    return np.frombuffer(b"".join(bodies), np.uint8), ends - [len(b) for b in bodies], ends


def anchors(bodies: list[bytes], lim: Limits) -> tuple[np.ndarray, ...]:
    """``(windows, chosen, gram_hash, begin, end, hashes)`` of bodies put together.

    ``windows`` are the starts of all windows, ``chosen`` the anchor of each.
    """
    data, begins, ends = _joined(bodies)
    h, n = PrefixHashes(data), len(data)
    places = np.arange(max(0, n - lim.gram + 1))
    grams = _mixed(h.of(places, places + lim.gram))
    rooms = np.maximum(ends - begins - lim.length + 1, 0)
    windows = np.repeat(begins, rooms) + spread(rooms)
    # the smallest hash of before + 1 neighbours, the first of equal ones
    least = (grams & ~np.uint64(0xFFFFFFFF)) | places.astype(np.uint64)
    reach, width = 1, lim.before + 1
    while reach < width and len(least):
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        reach += step
    chosen = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return windows, chosen, grams, begins, ends, h


def _contexts(at, grams, begins, ends, h, lim: Limits):
    """Left and right reach of anchors inside their body, and a hash of context and reach."""
    body = np.searchsorted(ends, at, side="right")
    left = np.minimum(at - begins[body], lim.before)
    right = np.minimum(ends[body] - at, lim.length)
    shape = (left * (lim.length + 1) + right).astype(np.uint64)
    return body, left, right, _mixed(h.of(at - left, at + right) + shape * np.uint64(_BASE))


def _tag(uid: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A number by which one occurrence of a context is told from the others."""
    mixed = _mixed(uid.view(np.uint64) + mark.astype(np.int64).view(np.uint64) * np.uint64(_BASE))
    return _mixed(mixed + pos.view(np.uint64)).view(np.int64)


def _anchor_rows(lim: Limits):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            bodies = batch["body"].to_pylist()
            windows, chosen, grams, begins, ends, h = anchors(bodies, lim)
            at = chosen[np.r_[True, chosen[1:] != chosen[:-1]]] if len(chosen) else chosen
            body, _, _, context = _contexts(at, grams, begins, ends, h, lim)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[at].view(np.int64)),
                    pa.array(context.view(np.int64)),
                    batch["uid"].take(pa.array(body)),
                    batch["mark"].take(pa.array(body)),
                    pa.array((at - begins[body]).astype(np.int32)),
                ],
                ["gram", "context", "uid", "mark", "pos"],
            )

    return rows


def _numbered(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Kept columns, the text's bytes, and what tells texts apart: their id (or a hash) and a hash."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    uid = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(
        F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("row"),
        body.alias("body"),
        F.coalesce(uid, F.xxhash64(body)).alias("uid"),
        F.hash(body).alias("mark"),
    )


def _candidates(rows: DataFrame, lim: Limits) -> DataFrame:
    """``(uid, mark, pos, gram, state, speaks, crowded)`` of anchors whose gram repeats.

    ``state``: 2 if the context repeats, else 1. ``speaks``: the one occurrence of its
    context that has to meet other contexts of the gram (false if there are none).
    """
    plain = rows.where(F.octet_length("body") >= lim.length).select("body", "uid", "mark")
    found = plain.mapInArrow(
        _anchor_rows(lim), "gram long, context long, uid long, mark int, pos int"
    )
    # staged, so that the joins read counts from shuffles of their own, beside which
    # adaptive execution can split a gram that much of the corpus holds
    twice = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    twice = staged(twice, "repeats-grams")
    left = staged(found.join(twice, "gram"), "repeats-anchors")
    tag = F.xxhash64("uid", "mark", "pos")
    by_context = left.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(tag).alias("tag"))
    by_context = staged(by_context, "repeats-contexts")
    several = staged(
        by_context.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"),
        "repeats-several",
    )
    known = by_context.join(several, "gram", "left")
    return left.join(known, ["gram", "context"]).select(
        "uid", "mark", "pos", "gram",
        F.when(F.col("n") > 1, _TWICE).otherwise(_OPEN).alias("state"),
        (F.col("contexts").isNotNull() & (F.col("tag") == tag)).alias("speaks"),
        F.coalesce(F.col("contexts") > lim.group, F.lit(False)).alias("crowded"),
    )


def _runs(starts: np.ndarray) -> list[int]:
    """Ascending numbers as first, last, first, last, ... of their runs."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.r_[0, breaks + 1]], starts[np.r_[breaks, len(starts) - 1]]], 1).ravel().tolist()


def removal(body: bytes, runs: list[int], length: int) -> tuple[int, int, bytes]:
    """``(removed, spans, kept)``: bytes covered by windows that start in ``runs``."""
    edges = np.array(sorted(zip(runs[::2], runs[1::2], strict=True)), np.int64).reshape(-1, 2)
    kept, removed, spans, at = [], 0, 0, -1
    for low, high in edges.tolist():
        high += length
        if low > at:
            spans += 1
            kept.append(body[max(at, 0) : low])
            removed, at = removed + high - low, high
        elif high > at:
            removed, at = removed + high - at, high
    return removed, spans, b"".join(kept) + body[max(at, 0) :]


#: What one pass over the texts gives. ``sort``: 0 a finished row, 1 one with open
#: windows, 2 a context, 3 a window of a crowded gram.
_PART_FIELDS = [
    ("sort", pa.int8(), "byte"), ("uid", pa.int64(), "long"), ("mark", pa.int32(), "int"),
    ("bytes", pa.int64(), "long"), ("removed", pa.int64(), "long"), ("spans", pa.int64(), "long"),
    ("sha256", pa.string(), "string"), ("body", pa.binary(), "binary"),
    ("runs", pa.list_(pa.int64()), "array<long>"), ("gram", pa.int64(), "long"),
    ("pos", pa.int64(), "long"), ("left", pa.int32(), "int"),
    ("offsets", pa.list_(pa.int32()), "array<int>"), ("open", pa.list_(pa.int32()), "array<int>"),
    ("window", pa.int64(), "long"),
]
_PARTS_DDL = ", ".join(f"{name} {ddl}" for name, _, ddl in _PART_FIELDS)


def _part(**values) -> tuple:
    return (values.get("row"), *(values.get(name) for name, _, _ in _PART_FIELDS))


def _decided(bodies: list[bytes], found: list[list[dict]], lim: Limits):
    """For each body: starts of repeated and of open windows, and contexts to be compared.

    A context is ``(gram, pos, left, bytes, offsets, open, hashes)``: offsets of its windows
    that may have an equal, those of them that are open, and for a crowded gram the
    windows' hashes instead of a meeting.
    """
    windows, chosen, _, begins, _, h = anchors(bodies, lim)
    at = chosen[np.r_[True, chosen[1:] != chosen[:-1]]] if len(chosen) else chosen
    known = np.concatenate(
        [begin + np.array([f["pos"] for f in fs], np.int64) for begin, fs in zip(begins.tolist(), found, strict=True)]
    )
    facts = [f for fs in found for f in fs]
    kind, fact = np.zeros(len(at), np.int64), np.full(len(at), -1)
    place = np.searchsorted(at, known)
    kind[place] = [f["state"] for f in facts]
    fact[place] = np.arange(len(facts))
    sure = np.r_[0, np.cumsum(kind == _TWICE)]
    low = np.searchsorted(at, windows)
    high = np.searchsorted(at, windows + lim.before, side="right")
    repeated = sure[high] > sure[low]
    own = np.searchsorted(at, chosen)
    is_open = ~repeated & (kind[own] == _OPEN)
    speaks = np.array([f >= 0 and facts[f]["speaks"] for f in fact.tolist()], dtype=bool)
    alive = np.flatnonzero((repeated | is_open) & speaks[own])
    edges = np.flatnonzero(np.r_[True, own[alive][1:] != own[alive][:-1], True]) if len(alive) else [0]
    body_of = np.searchsorted(begins, at, side="right") - 1
    contexts: list[list[tuple]] = [[] for _ in bodies]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        some = alive[a:b]
        i = own[some[0]]
        body, f = body_of[i], facts[fact[i]]
        pos = int(at[i] - begins[body])
        left, right = min(pos, lim.before), min(len(bodies[body]) - pos, lim.length)
        offsets = at[i] - windows[some]
        hashes = h.of(windows[some], windows[some] + lim.length).view(np.int64) if f["crowded"] else None
        contexts[body].append(
            (f["gram"], pos, left, bodies[body][pos - left : pos + right], offsets, offsets[is_open[some]], hashes)
        )
    out = []
    cuts = np.searchsorted(windows, [*begins.tolist(), begins[-1] + len(bodies[-1]) + 1])
    for k, begin in enumerate(begins.tolist()):
        part = slice(cuts[k], cuts[k + 1])
        mine = windows[part] - begin
        out.append((mine[repeated[part]], mine[is_open[part]], contexts[k]))
    return out


def _parts(lim: Limits):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, fields = [], 0, []

        def packed():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)],
                [name for name, _ in fields],
            )

        for batch in slices(batches, "body"):
            fields = [("row", batch.schema.field("row").type), *((n, t) for n, t, _ in _PART_FIELDS)]
            records = batch.to_pylist()
            some = [r for r in records if r["found"]]
            decided = iter(_decided([r["body"] for r in some], [r["found"] for r in some], lim) if some else ())
            for r in records:
                body, key = r["body"], {"uid": r["uid"], "mark": r["mark"]}
                twice, opened, contexts = next(decided) if r["found"] else ((), (), ())
                runs = _runs(np.asarray(twice))
                if len(opened):
                    rows.append(_part(sort=1, row=r["row"], body=body, runs=runs, **key))
                    size += len(body)
                else:
                    removed, spans, kept = removal(body, runs, lim.length)
                    rows.append(
                        _part(
                            sort=0, row=r["row"], bytes=len(body), removed=removed, spans=spans,
                            sha256=hashlib.sha256(kept).hexdigest(), **key,
                        )
                    )
                for gram, p, left, near, offsets, own, hashes in contexts:
                    if hashes is None:
                        rows.append(
                            _part(
                                sort=2, gram=gram, pos=p, left=left, body=near,
                                offsets=offsets.tolist(), open=own.tolist(), **key,
                            )
                        )
                        size += len(near) + 8 * len(offsets)
                    else:
                        still = set(own.tolist())
                        for o, w in zip(offsets.tolist(), hashes.tolist(), strict=True):
                            flag = [o] if o in still else []
                            rows.append(_part(sort=3, gram=gram, pos=p - o, window=w, open=flag, **key))
                            size += 64
                if size > 4 << 20 or len(rows) > 20_000:
                    yield packed()
                    rows, size = [], 0
        if rows:
            yield packed()

    return parts


#: Contexts of a gram up to which each is extended along each other instead of sorted.
_FEW = 6


def _extended(data, h, begins, ends, lefts, a, b, twice, lim: Limits) -> None:
    """Marks windows that pairs of contexts share: how far both agree from their anchors on.

    The windows of an offset o lie in the common part if it reaches o bytes back and
    ``length`` - o ahead. That the bytes agree, not only their hashes, is checked.
    """
    pa_, pb = begins[a] + lefts[a], begins[b] + lefts[b]
    ahead = _reach(h, pa_, pb, np.minimum(ends[a] - pa_, ends[b] - pb), 1)
    back = _reach(h, pa_, pb, np.minimum(lefts[a], lefts[b]), -1)
    low, high = np.maximum(lim.length - ahead, 0), np.minimum(back, lim.before)
    some = np.flatnonzero(low <= high)
    for i in some.tolist():
        x, y, n = pa_[i] - back[i], pb[i] - back[i], back[i] + ahead[i]
        if np.array_equal(data[x : x + n], data[y : y + n]):
            twice[a[i], low[i] : high[i] + 1] = True
            twice[b[i], low[i] : high[i] + 1] = True


def _reach(h: PrefixHashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many bytes after (way 1) or before (-1) two places agree, by binary search."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        if way > 0:
            same = h.of(a, a + middle) == h.of(b, b + middle)
        else:
            same = h.of(a - middle, a) == h.of(b - middle, b)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _sorted_out(data, h, begins, lefts, grams, rows, index, twice, lim: Limits) -> None:
    """Marks windows of larger groups, whose suffixes are sorted by gram and offset."""
    counts = np.array([len(r["offsets"]) for r in rows])
    offsets = np.concatenate([np.asarray(r["offsets"], np.int64) for r in rows])
    who = np.repeat(index, counts)
    opened = np.concatenate([np.isin(r["offsets"], r["open"]) for r in rows])
    group = grams[who] * (lim.before + 1) + offsets
    wanted = np.isin(group, group[opened])
    group, who, offsets = (x[wanted] for x in (group, who, offsets))
    by_group = np.argsort(group, kind="stable")
    group, who, offsets = (x[by_group] for x in (group, who, offsets))
    starts = begins[who] + lefts[who] - offsets
    order = suffix_sort(data, h, starts, group, lim.length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    a, b = a[near], b[near]
    same = common_prefix(h, starts[a], starts[b], lim.length) >= lim.length
    a, b = a[same], b[same]
    steps = np.arange(lim.length)
    for at in range(0, len(a), 4096):  # equal hashes are not proof yet
        x, y = a[at : at + 4096], b[at : at + 4096]
        equal = (data[starts[x][:, None] + steps] == data[starts[y][:, None] + steps]).all(axis=1)
        for side in (x[equal], y[equal]):
            twice[who[side], offsets[side]] = True


def _compared(lim: Limits):
    """Repeated windows among contexts, which come sorted by gram."""

    def sort_of(rows: list[dict]) -> tuple[list, list, list]:
        data, begins, ends = _joined([r["body"] for r in rows])
        h = PrefixHashes(data)
        grams = np.unique([r["gram"] for r in rows], return_inverse=True)[1]
        lefts = np.array([r["left"] for r in rows])
        size = np.bincount(grams)[grams]
        twice = np.zeros((len(rows), lim.before + 1), dtype=bool)
        few = np.flatnonzero(size <= _FEW)
        for gap in range(1, int(size[few].max(initial=1))):
            a, b = few[:-gap], few[gap:]
            same = grams[a] == grams[b]
            _extended(data, h, begins, ends, lefts, a[same], b[same], twice, lim)
        many = np.flatnonzero(size > _FEW)
        if len(many):
            _sorted_out(data, h, begins, lefts, grams, [rows[i] for i in many], many, twice, lim)
        who = np.repeat(np.arange(len(rows)), [len(r["open"]) for r in rows])
        offsets = np.concatenate([np.asarray(r["open"], np.int64) for r in rows])
        out = twice[who, offsets]
        who, offsets = who[out], offsets[out]
        at = np.array([r["pos"] for r in rows], np.int64)[who] - offsets
        return [rows[i]["uid"] for i in who], [rows[i]["mark"] for i in who], at.tolist()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def result(rows):
            uid, mark, at = sort_of(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(mark, pa.int32()), pa.array(at, pa.int64())],
                ["uid", "mark", "start"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                held += whole.slice(at, 2048).to_pylist()
                last = held[-1]["gram"]  # its contexts may go on in the next batch
                done = next(i for i, r in enumerate(held) if r["gram"] == last)
                if done:
                    yield result(held[:done])
                    held = held[done:]
        if held:
            yield result(held)

    return compared


def _finished(lim: Limits):
    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            out = []
            for r in batch.to_pylist():
                starts = np.unique(np.array(r["starts"] or [], np.int64))
                removed, spans, kept = removal(r["body"], r["runs"] + _runs(starts), lim.length)
                out.append((len(r["body"]), removed, spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])],
                ["row", "bytes", "removed", "spans", "sha256"],
            )

    return finished


def remove_repeats(docs: DataFrame, *keep: str, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """``keep`` columns of every row, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Texts are UTF-8 bytes and a null one is empty. A byte is removed if it is in a string
    of ``length`` bytes that also starts anywhere else, in the same text too; texts
    shorter than that lose nothing, and of two equal long texts both lose all.
    """
    lim = limits or Limits()
    rows = _numbered(docs, text, *keep)
    found = _candidates(rows, lim)
    of_text = found.groupBy("uid", "mark").agg(
        F.collect_list(F.struct("pos", "gram", "state", "speaks", "crowded")).alias("found")
    )
    row_type = rows.schema["row"].dataType.simpleString()
    parts = staged(
        rows.join(of_text, ["uid", "mark"], "left")
        .select("row", "uid", "mark", "body", "found")
        .mapInArrow(_parts(lim), f"row {row_type}, {_PARTS_DDL}"),
        "repeats-parts",
    )
    contexts = parts.where("sort = 2").select(
        "gram", "uid", "mark", "pos", "left", "body", "offsets", "open"
    )
    met = (
        contexts.repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_compared(lim), "uid long, mark int, start long")
    )
    crowd = parts.where("sort = 3").select("gram", "window", "uid", "mark", "pos", "open")
    again = crowd.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = crowd.where(F.size("open") > 0).join(again, ["gram", "window"])
    starts = (
        met.union(counted.select("uid", "mark", F.col("pos").alias("start")))
        .groupBy("uid", "mark")
        .agg(F.collect_list("start").alias("starts"))
    )
    results = ["row", "bytes", "removed", "spans", "sha256"]
    last = (
        parts.where("sort = 1")
        .select("row", "uid", "mark", "body", "runs")
        .join(starts, ["uid", "mark"], "left")
        .mapInArrow(
            _finished(lim),
            f"row {row_type}, bytes long, removed long, spans long, sha256 string",
        )
    )
    done = parts.where("sort = 0").select(*results)
    return done.union(last).select(
        *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("bytes").alias("n_bytes"),
        F.col("removed").alias("n_removed"),
        F.col("spans").alias("n_spans"),
        F.col("sha256").alias("kept_sha256"),
    )
