"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A model's normal pieces form a trie of their UTF-8 bytes, kept as two arrays: node t is the child of node s by byte c when
t = base[s] + c and check[t] = s. The best segmentation has the greatest sum of piece scores. A character that no piece
covers becomes its bytes' pieces, at a score below all others. Spaces become the marker, one marker stands before the text,
and decoding turns markers back. A marker character that the text itself holds is encoded as its bytes, so that decoding
gives back every text exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajkit.llm.common import lean, row_slices, tidy

MARKER = "▁"
#: The byte that stands for the marker inside units: no UTF-8 text holds it.
MARK = 0xFF
#: How far below the lowest score a character without a piece stands.
UNKNOWN_PENALTY = 10.0
#: The largest model file that is sent to the executors.
MOST_MODEL_BYTES = 64 << 20
#: Bytes of units and tokens that a Python worker remembers, the longest unit that it does, and bytes of text that are encoded together.
REMEMBERED, MOST_REMEMBERED, SLICE_BYTES = 1 << 24, 64, 1 << 19
#: Units of more bytes are segmented by themselves, so many bytes at a time.
LONG, WINDOW = 512, 1 << 16
#: Bytes of units that the segmentation takes side by side.
PLACES = 1 << 19
#: Units of a long text that are looked up together; a text of more characters is long.
UNITS = 1 << 18


@dataclass
class Vocabulary:
    """base, check: the trie; piece: the id that ends at a node or -1; scores by id; bytes_of: each id's output; byte_id: ids of the byte pieces."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    scores: np.ndarray
    bytes_of: list[bytes]
    byte_id: np.ndarray
    unknown_score: float
    longest: int
    prefix: bool


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, piece) of a trie over keys; node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, number in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                value.append(-1)
            node = children[node][c]
        value[node] = number
    size = 2 * len(children) + 1024
    base, check, piece = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    # Where the search for a free place begins, by how many children need one: places passed once are not tried again.
    check[0], first = 0, [1] * 10
    queue = [(0, 0)]
    for node, place in queue:
        piece[place] = value[node]
        below = children[node]
        if not below:
            continue
        codes = np.fromiter(sorted(below), dtype=np.int64)
        kind = len(codes).bit_length()
        low = int(codes[0])
        at = max(1, first[kind] - low)
        while True:
            if at + 256 > len(check):
                base, check, piece = (np.concatenate([x, np.full(len(x), fill, dtype=np.int32)]) for x, fill in ((base, 0), (check, -1), (piece, -1)))
            if check[at + low] < 0 and (len(codes) == 1 or (check[at + codes] < 0).all()):
                break
            at += 1
        base[place], first[kind] = at, at + low
        check[at + codes] = place
        queue += [(below[int(c)], at + int(c)) for c in codes]
    return base, check, piece


def read_model(data: bytes) -> Vocabulary:
    """A vocabulary from the bytes of a SentencePiece model with byte fallback; raises ValueError for one without."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models that leave the text as it is can be decoded exactly")
    normal, byte, user = 1, 6, 4
    scores = np.array([p.score for p in model.pieces], dtype=np.float64)
    byte_id = np.full(256, -1, dtype=np.int32)
    bytes_of, keys = [], []
    marker, mark = MARKER.encode(), bytes([MARK])
    for i, p in enumerate(model.pieces):
        bytes_of.append(b"")
        if p.type == byte:
            value = int(p.piece[3:5], 16)
            byte_id[value], bytes_of[i] = i, bytes([value])
        elif p.type in (normal, user) and p.piece:
            body = p.piece.lstrip(MARKER)
            if MARKER in body:
                raise ValueError("a piece goes on past a word's end")
            keys.append((p.piece.encode().replace(marker, mark), i))
            bytes_of[i] = p.piece.replace(MARKER, " ").encode()
    if (byte_id < 0).any():
        raise ValueError("the model has no byte fallback")
    base, check, piece = double_array(keys)
    lowest = min(scores[i] for _, i in keys)
    return Vocabulary(base, check, piece, scores, bytes_of, byte_id, lowest - UNKNOWN_PENALTY, max(len(k) for k, _ in keys), model.normalizer_spec.add_dummy_prefix)


def _width(first: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts with each byte; the mark is one byte."""
    return np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, np.where(first < 0xF8, 4, 1)))).astype(np.int8)


def best_segmentations(units: list[bytes], v: Vocabulary) -> list[bytes]:
    """The tokens of each unit by Viterbi, as the bytes of 32-bit numbers, many units side by side; of equal sums the one whose last pieces start earliest."""
    out = [_segment_long(u, v) if len(u) > LONG else b"" for u in units]
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] <= LONG]
    ascending, start = sizes[order].tolist(), 0
    while start < len(ascending):
        # Units of like length, about PLACES places at a time.
        most = max(8, ascending[start] * 5 // 4)
        end = min(bisect_right(ascending, most), start + max(1, PLACES // most))
        some = order[start:end].tolist()
        tokens, cuts = _segment([units[i] for i in some], sizes[some], v)
        for i, a, b in zip(some, cuts, cuts[1:], strict=False):
            out[i] = tokens[a:b]
        start = end
    return out


def _segment(units: list[bytes], sizes: np.ndarray, v: Vocabulary) -> tuple[bytes, list[int]]:
    """The units' tokens one after the other, and the places in bytes where units begin and end; units aren't empty."""
    n, length = len(units), int(sizes.max())
    text = np.frombuffer(b"".join(u.ljust(length, b"\0") for u in units), dtype=np.uint8).reshape(n, length)
    text = np.ascontiguousarray(text.T)  # by place, so that a step reads neighbours
    widths = _width(text)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0.0
    came, token = np.zeros((length + 1, n), dtype=np.int32), np.full((length + 1, n), -1, dtype=np.int32)
    everyone = np.arange(n)
    for at in range(length):
        rows = everyone[(best[at] > -np.inf) & (sizes > at)]
        if not len(rows):
            continue
        here = best[at, rows]
        width = widths[at, rows]
        single = np.zeros(len(rows), dtype=bool)
        who, state = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int32)
        for k in range(at, min(length, at + v.longest)):
            step = v.base[state] + text[k, rows[who]]
            going = (v.check[np.minimum(step, len(v.check) - 1)] == state) & (step < len(v.check)) & (sizes[rows[who]] > k) & (v.base[state] > 0)
            who, state = who[going], step[going]
            if not len(who):
                break
            found = v.piece[state]
            ends = np.flatnonzero(found >= 0)
            if len(ends):
                w, number = who[ends], found[ends]
                single[w[k - at + 1 == width[w]]] = True
                r, sum_ = rows[w], here[w] + v.scores[number]
                better = sum_ > best[k + 1, r]
                r = r[better]
                best[k + 1, r], came[k + 1, r], token[k + 1, r] = sum_[better], at, number[better]
        lone = np.flatnonzero(~single)
        if len(lone):
            r, to = rows[lone], np.minimum(at + width[lone].astype(np.int64), sizes[rows[lone]])
            sum_ = here[lone] + v.unknown_score
            better = sum_ > best[to, r]
            r, to = r[better], to[better]
            best[to, r], came[to, r], token[to, r] = sum_[better], at, -1
    # Walk back from every unit's end at once.
    place, steps = sizes.copy(), []
    left = everyone
    while len(left):
        begin = came[place[left], left]
        steps.append((left, begin, place[left], token[place[left], left]))
        place[left] = begin
        left = left[begin > 0]
    unit, begin, end, number = (np.concatenate([s[i] for s in steps]) for i in range(4))
    order = np.lexsort((begin, unit))
    unit, begin, end, number = unit[order], begin[order], end[order], number[order]
    unknown = np.flatnonzero(number < 0)
    if len(unknown):
        # A character without a piece: its bytes one by one; the marker's own character came as its bytes, too.
        count = np.where(number < 0, end - begin, 1)
        which = np.repeat(np.arange(len(number)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        raw = text[begin[which] + offset, unit[which]]
        number, unit = np.where(number[which] < 0, v.byte_id[raw], number[which]), unit[which]
    return number.astype(np.int32).tobytes(), (4 * np.searchsorted(unit, np.arange(n + 1))).tolist()


def _matches(text: np.ndarray, count: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of every piece that starts at one of the first count places of text, by start: all places walk the trie at once."""
    who, state, found = np.arange(count), np.zeros(count, dtype=np.int32), []
    for k in range(v.longest):
        inside = who + k < len(text)
        who, state = who[inside], state[inside]
        if not len(who):
            break
        base = v.base[state]
        step = base + text[who + k]
        going = (step < len(v.check)) & (base > 0)
        going &= v.check[np.minimum(step, len(v.check) - 1)] == state
        who, state = who[going], step[going]
        ends = np.flatnonzero(v.piece[state] >= 0)
        found.append((who[ends], who[ends] + k + 1, v.piece[state[ends]]))
    start, end, number = (np.concatenate([np.zeros(0, dtype=np.int64), *(f[i] for f in found)]) for i in range(3))
    order = np.argsort(start, kind="stable")
    return start[order], end[order], number[order]


def _segment_long(unit: bytes, v: Vocabulary) -> bytes:
    """The tokens of one long unit, by the same rule. Pieces are found for a window of places at once; then sums go from place to place.

    Beside two numbers per byte, for the way back, only a window is held.
    """
    raw = np.frombuffer(unit, dtype=np.uint8)
    total = len(raw)
    came, token = np.zeros(total + 1, dtype=np.int64), np.full(total + 1, -1, dtype=np.int32)
    none = float("-inf")
    carried, reach = [0.0], max(v.longest, 4)
    for low in range(0, total, WINDOW):
        high = min(total, low + WINDOW)
        start, end, number = _matches(raw[low : high + v.longest], high - low, v)
        single = np.zeros(high - low, dtype=bool)
        width = np.minimum(_width(raw[low:high]).astype(np.int64), total - low - np.arange(high - low))
        single[start[end - start == width[start]]] = True
        ends, numbers, scores = end.tolist(), number.tolist(), v.scores[number].tolist()
        offsets = np.searchsorted(start, np.arange(high - low + 1)).tolist()
        widths, singles = width.tolist(), single.tolist()
        best = carried + [none] * (high - low + reach + 1 - len(carried))
        from_, by = [-1] * len(best), [-1] * len(best)
        for at in range(high - low):
            here = best[at]
            if here == none:
                continue
            for x in range(offsets[at], offsets[at + 1]):
                to, sum_ = ends[x], here + scores[x]
                if sum_ > best[to]:
                    best[to], from_[to], by[to] = sum_, at, numbers[x]
            if not singles[at]:
                to, sum_ = at + widths[at], here + v.unknown_score
                if sum_ > best[to]:
                    best[to], from_[to], by[to] = sum_, at, -1
        step = np.array(from_[: total - low + 1], dtype=np.int64)
        new = np.flatnonzero(step >= 0)
        came[low + new], token[low + new] = low + step[new], np.array(by, dtype=np.int32)[new]
        carried = best[high - low :]
    out, place = [], total
    while place:
        begin = int(came[place])
        out.append([int(token[place])] if token[place] >= 0 else v.byte_id[raw[begin:place]].tolist())
        place = begin
    return np.array([x for some in reversed(out) for x in some], dtype=np.int32).tobytes()


_UNIT = re.compile(rb"\xff*[^\xff]+|\xff+")
#: The unit that stands for the marker's own character.
_OWN = b"\xfe"


def units_of(text: str, v: Vocabulary) -> Iterator[list[bytes]]:
    """The text cut where a marker follows something else than a marker, in lists of up to UNITS; no piece reaches over such a cut.

    The marker's own character is no marker: it stands alone, and its bytes' pieces stand for it.
    """
    data = ((" " if v.prefix and text else "") + text).encode("utf-8", "surrogatepass").replace(b" ", bytes([MARK]))
    own = MARKER.encode()
    if own not in data and len(data) <= UNITS:
        yield _UNIT.findall(data)
        return
    found = (u for i, part in enumerate(data.split(own)) for u in chain([_OWN] * (i > 0), (m[0] for m in _UNIT.finditer(part))))
    while some := list(islice(found, UNITS)):
        yield some


class Encoder:
    """Encodes texts with a memory of units that it has met."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.held = v, {}, 0

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = [None] * len(texts)
        cut: dict[int, list[bytes]] = {}
        for i, text in enumerate(texts):
            if text is None:
                continue
            if len(text) > UNITS:
                out[i] = np.concatenate([np.zeros(0, dtype=np.int32), *(x for part in units_of(text, self.v) for x in self._tokens([part]))])
            else:
                cut[i] = [u for part in units_of(text, self.v) for u in part]
        for i, tokens in zip(cut, self._tokens(list(cut.values())), strict=True):
            out[i] = tokens
        return out

    def _tokens(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        met = set().union(*rows)
        new = met - self.known.keys()
        if self.held > REMEMBERED:
            self.forget()
            new = met
        new.discard(_OWN)
        ordered = list(new)
        self.known.update(zip(ordered, best_segmentations(ordered, self.v), strict=True))
        self.known[_OWN] = self.v.byte_id[list(MARKER.encode())].tobytes()
        tokens = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(tokens, units)), dtype=np.int32) for units in rows]
        for unit in ordered:
            if len(unit) > MOST_REMEMBERED:
                del self.known[unit]
            else:
                self.held += 2 * len(unit) + 200  # with what Python adds to two byte strings
        return out


class Decoder:
    """Turns tokens into text: each piece's bytes, with spaces for markers."""

    def __init__(self, v: Vocabulary):
        self.prefix = v.prefix
        self.sizes = np.array([len(b) for b in v.bytes_of])
        self.joined, self.starts = np.frombuffer(b"".join(v.bytes_of), dtype=np.uint8), np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> str:
        """The text, without the space that the first marker stands for."""
        count = self.sizes[ids]
        at = np.arange(int(count.sum())) + np.repeat(self.starts[ids] - (np.cumsum(count) - count), count)
        data = self.joined[at].tobytes()
        return (data[1:] if self.prefix and data else data).decode("utf-8", "replace")


def load_vocabulary(path: str) -> bytes:
    """A model file's bytes, read on the driver; a file over MOST_MODEL_BYTES raises ValueError."""
    with open(path, "rb") as f:
        data = f.read(MOST_MODEL_BYTES + 1)
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MOST_MODEL_BYTES} bytes")
    return data


@lru_cache(maxsize=2)
def _coder(model: bytes) -> tuple[Encoder, Decoder]:
    """A Python worker's encoder and decoder: the vocabulary serves all tasks that the worker runs."""
    v = read_model(model)
    return Encoder(v), Decoder(v)


def encode_texts(docs: DataFrame, model: bytes, *, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids of every row: the tokens of the whole text; with decode also decoded, the text that the ids stand for.

    A null text has null ids, an empty one none. Very long texts are encoded whole, word by word; repeated words are looked
    up, and words of any length, as in text without spaces, are segmented in windows. Repeated rows give equal ids, a null id stays null, an empty table stays empty; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_MODEL_BYTES
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coder(held.value)
        for batch in batches:
            for a, b in row_slices(batch.column(1), SLICE_BYTES):
                ids = encoder.encode(batch.column(1).slice(a, b - a).to_pylist())
                offsets = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
                flat = np.concatenate([np.zeros(0, dtype=np.int32), *(x for x in ids if x is not None)])
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array([x is None for x in ids]))]
                if decode:
                    columns.append(pa.array([None if x is None else decoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
            tidy()
        encoder.forget()  # the worker may go on with something else
        tidy()

    return lean(docs).select(F.col(doc_id), F.col(text)).mapInArrow(encode, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def decode_texts(tokens: DataFrame, model: bytes, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the text that ids stand for, null where ids is null; a column named like the new one is replaced."""
    held = tokens.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in tokens.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*kept).schema), f"`{text}` string"])
    column = kept.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _coder(held.value)[1]
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [None if not x.is_valid else decoder.decode(x.values.to_numpy(zero_copy_only=False)) for x in part.column(column)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, text])

    return lean(tokens).select(*kept).mapInArrow(decode, schema)
