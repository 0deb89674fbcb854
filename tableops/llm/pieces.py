"""SentencePiece BPE encoding by suffix-array matching, and decoding.

Text becomes chunks: a run of spaces and the characters up to the next one, cut again
where characters meet that stand side by side in no piece, such as a letter and a full stop. No
piece of the model goes beyond a chunk, so each different chunk of a batch is
encoded once. The batch's new chunks are put one after the other and indexed by a
suffix array; a binary search of every piece gives the range of its occurrences.
These are the edges of a lattice, sorted by the position where they end and relaxed
in that order.

An edge may extend the path before it if byte-pair encoding would keep the border
between its piece and the piece before. A chunk's encoding is the one path whose
borders are all kept, and every prefix has exactly one, so a position needs only its
last piece. That holds for models whose merges make pieces in the order of their
scores, which ``Model`` checks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tableops.llm.base import slices, spread, texts

SPACE = "▁"
#: The model file on the driver, unless ``spark.tableops.pieces`` names another.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks a worker remembers in each of two generations, and pairs of pieces.
_KNOWN = 150_000
#: Places for the borders that were checked; as a power of two.
_BORDERS = 20
#: Characters of new chunks that are indexed at once.
_INDEXED = 400_000
#: Characters up to which chunks are relaxed side by side.
_ABREAST = 64
#: Stands between chunks; no character has this number.
_BETWEEN = 0x110000


@dataclass(frozen=True)
class Model:
    """The pieces of a SentencePiece BPE model with byte fallback.

    ``pieces`` in the order of their ids; ``kinds`` as in the model file: 1 normal,
    2 unknown, 3 control, 5 unused, 6 byte. Scores fall with the id.
    """

    pieces: tuple[str, ...]
    kinds: tuple[int, ...]
    scores: tuple[float, ...]

    @staticmethod
    def load(path: str) -> Model:
        """Read a ``.model`` file on the driver. Only what is needed goes to the tasks."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        plain = spec.name == "identity" and spec.add_dummy_prefix and spec.escape_whitespaces
        if not plain or spec.remove_extra_whitespaces or proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models without normalization are supported")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback are supported")
        found = proto.pieces
        return Model(*(tuple(x) for x in ([p.piece for p in found], [p.type for p in found], [p.score for p in found])))


def configured(spark: SparkSession) -> Model:
    return Model.load(spark.conf.get("spark.tableops.pieces", MODEL_FILE))


class Vocabulary:
    """A model's tables for matching, border checks and decoding."""

    def __init__(self, model: Model):
        self.model = model
        n = len(model.pieces)
        self.unknown = n  # a character of no piece, later spelled in bytes
        usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 1}
        self.bytes = np.zeros(256, dtype=np.int32)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if k == 6:
                self.bytes[int(p[1:-1], 16)] = i
        if any(SPACE in p.lstrip(SPACE) for p in usable):
            raise ValueError("a piece goes beyond a space")
        self.chunk = _chunks(usable)
        by_score = sorted(usable, key=lambda p: (-model.scores[usable[p]], usable[p]))
        rank = {p: r for r, p in enumerate(p for p in by_score if len(p) > 1)}
        self.rank = np.full(n + 1, -1, dtype=np.int64)  # single characters: before all merges
        for p, r in rank.items():
            self.rank[usable[p]] = r
        self.left = np.full(n + 1, -1, dtype=np.int64)
        self.right = np.full(n + 1, -1, dtype=np.int64)
        reached = []
        for p, i in usable.items():
            if len(p) == 1:
                reached.append(p)
            elif (parts := _merged(p, rank)) is not None and all(x in usable for x in parts):
                self.left[i], self.right[i] = usable[parts[0]], usable[parts[1]]
                if max(self.rank[self.left[i]], self.rank[self.right[i]]) > self.rank[i]:
                    raise ValueError(f"merges out of order at {p!r}")
                reached.append(p)
        self.reached = sorted(reached)
        self.ids = np.array([usable[p] for p in self.reached], dtype=np.int64)
        self.longest = max(map(len, self.reached), default=1)
        self.lengths = np.array([len(p) for p in self.reached], dtype=np.int64)
        self.spelling = np.zeros((len(self.reached), self.longest), np.uint32)
        for i, p in enumerate(self.reached):
            self.spelling[i, : len(p)] = [ord(c) for c in p]
        pairs = {}
        for p, i in usable.items():
            for cut in range(1, len(p)):
                a, b = usable.get(p[:cut]), usable.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.checked: dict[int, bool] = {}
        self.bordering = np.full(1 << _BORDERS, -1, dtype=np.int64)
        self.kept = np.zeros(1 << _BORDERS, dtype=bool)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging ``a`` and ``b``, or a rank beyond all."""
        never = np.iinfo(np.int64).max
        if not len(self.pair_keys):
            return np.full(len(a), never)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.rank[self.pair_ids[at]], never)

    def border(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the text of pieces ``a`` and ``b`` gives just these two.

        Goes back in time through the symbols next to the border: of the two, the one
        made last is taken apart (of equal ones the right one, for merges go from the
        left), and a merge across the border must not have come first at any step.
        """
        keeps = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        never = np.iinfo(np.int64).max
        ends_x, ends_y = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            m = self.joined(x, y)
            crossed = (m < ends_x) & (m <= ends_y) & (m < never)
            keeps[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & (np.maximum(rx, ry) >= 0)
            undo_x = rx > ry
            ends_x = np.where(undo_x, rx, ends_x)[go]
            ends_y = np.where(undo_x, ends_y, ry)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            live = live[go]
        return keeps

    def borders(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``border``, of which each place of a table remembers its last pair."""
        key = a << 32 | b
        place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BORDERS)
        keeps = self.kept[place]
        missed = np.flatnonzero(self.bordering[place] != key)
        if len(missed):
            pairs, first, which = np.unique(key[missed], return_index=True, return_inverse=True)
            own = missed[first]
            found = self.border(a[own], b[own])
            keeps[missed] = found[which]
            # of pairs that share a place the last is kept, and so is what was found for it
            last = np.unique(place[own][::-1], return_index=True)[1]
            last = len(own) - 1 - last
            self.bordering[place[own[last]]], self.kept[place[own[last]]] = pairs[last], found[last]
        return keeps

    def bordered(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if key not in self.checked:
            if len(self.checked) > _KNOWN:
                self.checked.clear()
            self.checked[key] = bool(self.border(np.array([a]), np.array([b]))[0])
        return self.checked[key]

    @cached_property
    def spelled(self) -> list[bytes]:
        """The bytes each id stands for; control pieces stand for nothing."""
        out = []
        for p, k in zip(self.model.pieces, self.model.kinds, strict=True):
            out.append(bytes([int(p[1:-1], 16)]) if k == 6 else b"" if k == 3 else p.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _chunks(usable: Iterable[str]) -> re.Pattern:
    """What a chunk is: spaces, then characters which are all of the largest set or all outside it.

    Sets are those of characters that pieces join side by side, directly or by way of others.
    """
    into: dict[str, str] = {}

    def root(c: str) -> str:
        while into.setdefault(c, c) != c:
            into[c] = c = into[into[c]]
        return c

    for piece in usable:
        for a, b in pairwise(piece.lstrip(SPACE)):
            into[root(a)] = root(b)
    sets: dict[str, list[str]] = {}
    for c in list(into):
        sets.setdefault(root(c), []).append(c)
    largest = re.escape("".join(max(sets.values(), key=lambda cs: (len(cs), min(cs)), default=[])))
    own = f"{SPACE}*[{largest}]+|" if largest else ""
    return re.compile(f"{own}{SPACE}*[^{largest}{SPACE}]+|{SPACE}+")


def _merged(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last two symbols that byte-pair encoding joins to make ``piece``, if it does."""
    symbols = list(piece)
    while len(symbols) > 2:
        best = min(
            ((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank),
            default=None,
        )
        if best is None:
            return None
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return (symbols[0], symbols[1]) if len(symbols) == 2 else None


def _edges(chunks: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and piece of every occurrence of a piece in the chunks put together.

    Places count the characters of ``"\\n".join(chunks)``-like text with one separator
    after each chunk. Characters of no piece get an edge of their own.
    """
    # the separator is a number beyond all characters, which are numbered densely
    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    codes = np.full(int(sizes.sum()) + len(chunks), _BETWEEN, dtype=np.uint32)
    inside = np.ones(len(codes), dtype=bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    codes[inside] = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.unique(codes)
    width = 1 if len(alphabet) < 0xFF else 2 if len(alphabet) < 0xFFFF else 4
    kind = np.dtype(f">u{width}")
    top = (1 << 8 * width) - 1
    dense = (np.searchsorted(alphabet, codes) + 1).astype(kind)
    longest = vocabulary.longest
    padded = np.r_[dense, np.zeros(longest, kind)].astype(kind)
    keys = np.lib.stride_tricks.sliding_window_view(padded, longest)[: len(dense)]
    packed = np.ascontiguousarray(keys).view(np.uint8).reshape(len(dense), -1)
    spare = -packed.shape[1] % 8
    words = np.pad(packed, ((0, 0), (0, spare))).view(">u8").astype(np.uint64)
    suffixes = np.argsort(words[:, 0])
    tied = words[suffixes[1:], 0] == words[suffixes[:-1], 0]
    tied = np.flatnonzero(np.r_[False, tied] | np.r_[tied, False])
    suffixes[tied] = suffixes[tied][np.lexsort(words[suffixes[tied]].T[::-1])]
    ordered = packed[suffixes].view(f"S{packed.shape[1]}").ravel()

    spelled = vocabulary.spelling
    at = np.minimum(np.searchsorted(alphabet, spelled), len(alphabet) - 1)
    which = np.flatnonzero(((alphabet[at] == spelled) | (spelled == 0)).all(axis=1))
    beyond = np.arange(longest)[None, :] >= vocabulary.lengths[which, None]
    own = at[which] + 1
    shape = f"S{packed.shape[1]}"
    low, high = (
        np.where(beyond, fill, own).astype(kind).view(np.uint8).reshape(len(which), -1).view(shape).ravel()
        for fill in (0, top)
    )
    first = np.searchsorted(ordered, low, side="left")
    many = np.searchsorted(ordered, high, side="right") - first
    starts = suffixes[np.repeat(first, many) + spread(many)].astype(np.int32)
    lengths = np.repeat(vocabulary.lengths[which], many).astype(np.int32)
    pieces = np.repeat(vocabulary.ids[which], many).astype(np.int32)
    own = np.zeros(len(codes), dtype=bool)
    own[starts[lengths == 1]] = True
    odd = np.flatnonzero(~own & inside).astype(np.int32)
    return (
        np.r_[starts, odd],
        np.r_[lengths, np.ones(len(odd), np.int32)],
        np.r_[pieces, np.full(len(odd), vocabulary.unknown, np.int32)],
    )


def encode_chunks(chunks: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each chunk as 32-bit numbers, unknown characters in bytes."""
    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    start, length, piece = _edges(chunks, vocabulary)
    end = start + length
    beginning = np.repeat(begins, sizes + 1)
    beginning[np.repeat(sizes > _ABREAST, sizes + 1)] = -1
    beginning = beginning[start]
    depth = np.where(beginning >= 0, end - beginning, 0)  # long chunks go one by one
    # one number an edge, which is sorted itself: by depth, end and length, the longest first
    by_piece, by_length = vocabulary.unknown.bit_length(), vocabulary.longest.bit_length()
    key = (depth.astype(np.int64) << 56) | (end.astype(np.int64) << (by_piece + by_length))
    key |= ((vocabulary.longest - length).astype(np.int64) << by_piece) | piece
    key.sort()
    depth, end = key >> 56, (key & ((1 << 56) - 1)) >> (by_piece + by_length)
    piece = key & ((1 << by_piece) - 1)
    start = end - vocabulary.longest + ((key >> by_piece) & ((1 << by_length) - 1))

    total = int(begins[-1] + sizes[-1] + 2) if len(chunks) else 1
    last = np.full(total, -1, dtype=np.int64)  # the piece that ends at a position
    back = np.zeros(total, dtype=np.int64)
    last[begins] = -2
    alone = int(np.searchsorted(depth, 1))
    edges = np.searchsorted(depth, np.arange(1, _ABREAST + 2))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        ends = end[a:b]
        turn = np.arange(b - a) - np.maximum.accumulate(
            np.where(np.r_[True, ends[1:] != ends[:-1]], np.arange(b - a), 0)
        )
        by_turn = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            e = a + by_turn[lo:hi]
            before = last[start[e]]
            e, before = e[last[end[e]] == -1], before[last[end[e]] == -1]
            good = before == -2
            check = np.flatnonzero(before >= 0)
            good[check] = vocabulary.borders(before[check], piece[e[check]])
            e = e[good]
            last[end[e]], back[end[e]] = piece[e], start[e]
    for s, p, e in zip(
        start[:alone].tolist(), piece[:alone].tolist(), end[:alone].tolist(), strict=True
    ):
        before = last[s]
        if last[e] == -1 and (before == -2 or before >= 0 and vocabulary.bordered(int(before), p)):
            last[e], back[e] = p, s

    owners, ids, places = [], [], []
    active, at = np.flatnonzero(sizes > 0), (begins + sizes)[sizes > 0]
    while len(active):  # from the ends of all chunks to their beginnings
        owners.append(active)
        ids.append(last[at])
        places.append(at)
        at = back[at]
        more = at > begins[active]
        active, at = active[more], at[more]
    if not owners:
        return [b""] * len(chunks)
    owner, ids, places = (np.concatenate(x) for x in (owners, ids, places))
    order = np.argsort(places)  # chunks follow one another
    owner, ids, places = owner[order], ids[order].astype(np.int32), places[order]
    odd = np.flatnonzero(ids == vocabulary.unknown)
    if len(odd):
        raw = [
            vocabulary.bytes[list(chunks[c][p - 1].encode("utf-8", "surrogatepass"))]
            for c, p in zip(owner[odd].tolist(), (places[odd] - begins[owner[odd]]).tolist(), strict=True)
        ]
        many = np.ones(len(ids), np.int64)
        many[odd] = [len(r) for r in raw]
        owner, spelled = np.repeat(owner, many), np.repeat(ids == vocabulary.unknown, many)
        ids = np.repeat(ids, many)
        ids[spelled] = np.concatenate(raw)
    ends = 4 * np.cumsum(np.bincount(owner, minlength=len(chunks)))
    packed = ids.astype(np.int32).tobytes()
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Encodes batches of texts and remembers chunks between them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, batch_texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        parts = self.vocabulary.chunk.findall
        split = [parts(SPACE + t.replace(" ", SPACE)) if t else [] for t in batch_texts]
        if len(self.known) > _KNOWN:  # chunks that come again move on, the others go with the next turn
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = list({c for chunks in split for c in chunks if c not in known})
        if older:
            known.update((c, older[c]) for c in new if c in older)
            new = [c for c in new if c not in known]
        ends = np.cumsum([len(c) for c in new])
        at = 0
        while at < len(new):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _INDEXED)))
            known.update(zip(new[at:to], encode_chunks(new[at:to], self.vocabulary), strict=True))
            at = to
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


_WORKER: dict[Model, Encoder] = {}


def _encoder(model: Model) -> Encoder:
    if model not in _WORKER:
        _WORKER.clear()
        _WORKER[model] = Encoder(Vocabulary(model))
    return _WORKER[model]


def encode(
    docs: DataFrame, model: Model, *keep: str, text: str = "text", verify: bool = False
) -> DataFrame:
    """``keep`` columns of every row and ``ids``; a null or empty text has none.

    With ``verify`` the ids are decoded again where they were made, and ``round_trip``
    says whether that gave the text.
    """
    plain, kept, fields = texts(docs, *keep, text=text)

    def encoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in slices(batches):
            originals = batch["text"].to_pylist()
            own = encoder(originals)
            ends = np.cumsum([0, *(len(x) // 4 for x in own)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(own), np.int32))
            columns, names = [*(batch[k] for k in kept)], [*kept, "ids"]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            if verify:
                spell = encoder.vocabulary.decode
                same = [spell(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(own, originals, strict=True)]
                columns.append(pa.array(same, pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["ids", "round_trip"] if verify else ["ids"]
    schema = fields + "ids array<int>" + (", round_trip boolean" if verify else "")
    return plain.mapInArrow(encoding, schema).toDF(*keep, *names)


def decode(encoded: DataFrame, model: Model, *keep: str, ids: str = "ids") -> DataFrame:
    """``keep`` columns of every row and ``text``; null ids give empty text.

    The first space, which encoding puts before a text, is left out.
    """
    names = [f"k{i}" for i in range(len(keep))]
    plain = encoded.select(
        *[encoded[c].alias(k) for c, k in zip(keep, names, strict=True)], encoded[ids].alias("ids")
    )
    fields = "".join(f"{k} {t}, " for k, t in plain.dtypes[:-1])

    def decoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(model).vocabulary
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = [vocabulary.decode(x or []) for x in batch["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[k] for k in names), pa.array(out, pa.string())], [*names, "text"]
                )

    return plain.mapInArrow(decoding, fields + "text string").toDF(*keep, "text")
