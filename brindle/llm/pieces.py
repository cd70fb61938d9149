"""SentencePiece encoding and decoding that keeps offsets, from a public model file.

A text is normalised by longest prefixes of the model's compiled character map: at each place the longest
key that starts there is replaced by its value, else one character stays. All places are looked up at once: a round
follows one more byte in the map's double array for every place that still matches. Each byte that comes out
notes the source byte that its unit began at, so that a piece, which is a run of bytes of the normalised text, names a
span of bytes of the original.

Pieces are merged as the library does: the pair whose joined piece scores highest first, of equals the
leftmost. Where no piece of the vocabulary has a space mark after another character, no merge crosses such a
place, nor a character that is in no piece; so a text is cut there and each distinct run is merged once in a worker, as a
row of a padded matrix. Runs that hold a piece whose score isn't its own (runs of spaces), and long ones, are merged
one by one. A character without a piece falls back to its bytes: all but the last have an empty span.

Defined cases: a null text is the empty text, with no ids; repeated rows stay; very long runs are merged with a
heap, in n log n; an empty table gives no rows; other columns are ignored, whatever their names. Models of
another kind (unigram, user-defined pieces, extra spaces removed) raise.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.errors import ValidationError
from brindle.llm.bpe import Pairs, Table, groups, merged
from brindle.llm.common import bounded_batches, whole

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Runs kept between batches of a worker; characters of a run up to which pairs are searched in a list.
KEPT, SHORT = 300_000, 24
#: Upper ends of the matrices' lengths; longer runs are merged one by one.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """A compiled map of character sequences: a double array of 32-bit units, then values that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.values = np.frombuffer(blob[4 + size :], np.uint8)
        self.ends = np.flatnonzero(self.values == 0)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte of ``text`` the length of the longest key that starts there (0: none), and its value's place."""
        length, value = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        if not len(self.units):
            return length, value
        at = np.flatnonzero((text & 0xC0) != 0x80)
        node = np.full(len(at), self._offset(self.units[0]))
        for depth in range(len(text)):
            inside = at + depth < len(text)
            at, node = at[inside], node[inside]
            byte = text[at + depth].astype(np.int64)
            node ^= byte
            known = node < len(self.units)
            at, node, byte = at[known], node[known], byte[known]
            unit = self.units[node]
            same = (unit & 0x800000FF) == byte
            at, unit, node = at[same], unit[same], node[same] ^ self._offset(unit[same])
            if not len(at):
                break
            leaf = (unit >> 8) & 1 == 1
            length[at[leaf]], value[at[leaf]] = depth + 1, self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def size(self, value: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, value)] - value


class Normaliser:
    def __init__(self, table: CharacterMap, prefix: bool, escape: bool):
        self.table, self.prefix, self.escape = table, prefix, escape

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for the end, the source byte that it came from."""
        source = np.frombuffer(text.encode(), np.uint8)
        if not len(source):
            return b"", np.zeros(1, np.int32)
        begin = np.flatnonzero((source & 0xC0) != 0x80)
        size = np.diff(begin, append=len(source))
        length, value = self.table.longest(source)
        if length.any():
            begin, size = self._units(begin, size, length)
        mapped = length[begin] > 0
        pool = np.concatenate([source, self.table.values])
        start = np.where(mapped, len(source) + value[begin], begin)
        out = size.copy()
        if mapped.any():
            out[mapped] = self.table.size(value[begin[mapped]])
        before = np.cumsum(out) - out
        flat = pool[np.repeat(start - before, out) + np.arange(int(out.sum()))]
        origin = np.repeat(begin, out)
        if self.escape:
            wide = np.where(flat == 0x20, 3, 1)
            mark, origin = np.repeat(flat == 0x20, wide), np.repeat(origin, wide)
            flat = np.repeat(flat, wide)
            flat[mark] = np.tile(np.frombuffer(SPACE.encode(), np.uint8), int(mark.sum()) // 3)
        if self.prefix:
            lead = np.frombuffer((SPACE if self.escape else " ").encode(), np.uint8)
            flat, origin = np.concatenate([lead, flat]), np.concatenate([np.zeros(len(lead), np.int64), origin])
        return flat.tobytes(), np.append(origin, len(source)).astype(np.int32)

    @staticmethod
    def _units(begin: np.ndarray, size: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters, or keys in their place; characters that lie within an earlier key go."""
        taken = np.where(length[begin] > 0, length[begin], size)
        keep = np.ones(len(begin), bool)
        end = 0
        for i in np.flatnonzero(taken > size):  # keys of several characters, from the left
            if begin[i] >= end:
                end = begin[i] + taken[i]
                keep[i + 1 : np.searchsorted(begin, end)] = False
        return begin[keep], taken[keep]


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("brindle-byte", _one_byte)


class Pieces:
    def __init__(self, model: bytes):
        parts = list(_fields(model))
        rows = [dict(_fields(v)) for f, v in parts if f == 1]
        trainer, rule = (dict(_fields(next((v for f, v in parts if f == n), b""))) for n in (2, 3))
        self.kinds = np.array([r.get(3, NORMAL) for r in rows])
        names = [r[1].decode() for r in rows]
        scores = [struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows]
        if trainer.get(3, 1) != 2 or trainer.get(24) or rule.get(4, 1) or set(self.kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE} or any(dict(_fields(v)).get(2) for f, v in parts if f == 5):
            raise ValidationError("only BPE models that keep spaces and have no user-defined or unused pieces")
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.fallback = {int(names[i][3:5], 16): i for i in np.flatnonzero(self.kinds == BYTE)} if trainer.get(35) else {}
        self.normalise = Normaliser(CharacterMap(rule.get(2, b"")), bool(rule.get(3, 1)), bool(rule.get(5, 1)))
        normal = [int(i) for i in np.flatnonzero(self.kinds == NORMAL)]
        by_score = sorted(normal, key=lambda i: -scores[i])
        order = {s: r for r, s in reversed(list(enumerate(scores[i] for i in by_score)))}
        self.rank = {names[i]: order[scores[i]] for i in normal}
        # a symbol is a place in the order of scores, or for bytes and the unknown piece a number beyond
        self.symbol = {names[i]: s for s, i in enumerate(by_score)}
        self.other = {i: len(by_score) + i for i in [self.unknown, *self.fallback.values()]}
        self.id_of = np.array(by_score + list(range(len(rows))), np.int32)
        self.size = np.array([len(names[i].encode()) if k == NORMAL else 0 for i, k in enumerate(self.kinds)], np.int64)
        self.bytes = np.array([int(names[i][3:5], 16) if k == BYTE else -1 for i, k in enumerate(self.kinds)])
        known = {c for n in self.symbol for c in n}
        crosses = any(a != SPACE and b == SPACE for n in self.symbol for a, b in zip(n, n[1:]))
        within = "".join(map(re.escape, sorted(known - {SPACE}))) or "\\0"
        self.runs = re.compile(f"(?s)[{SPACE}{within}]+|[^{SPACE}{within}]" if crosses else f"(?s){SPACE}*[{within}]+|{SPACE}+|[^{SPACE}{within}]")
        joined = [i for i in normal if len(names[i]) > 1]
        seen = Counter(scores[i] for i in joined)
        alike = [names[i] for i in joined if seen[scores[i]] > 1]
        self.one_by_one = re.compile("(?s)." if known - set(self.symbol) else "|".join(map(re.escape, alike)) or "(?!)")
        self.first = np.full(0x110000, -1, np.int32)
        for c in known & set(self.symbol):
            self.first[ord(c)] = self.symbol[c]
        pairs = [(self.symbol[n[:i]], self.symbol[n[i:]], s) for n, s in self.symbol.items() for i in range(1, len(n)) if n[:i] in self.symbol and n[i:] in self.symbol]
        self.pairs = Pairs(*(np.array(x, np.int32) for x in (zip(*pairs) if pairs else ((), (), ()))))
        self.decimal = Table([b",%d" % i for i in range(len(rows))])
        said = trainer.get(44, " ⁇ ".encode())
        surface = {NORMAL: lambda n: n.replace(SPACE, " ").encode(), UNKNOWN: lambda n: said, CONTROL: lambda n: b"", BYTE: lambda n: bytes([int(n[3:5], 16)])}
        self.surface = Table([surface[k](n) for k, n in zip(self.kinds.tolist(), names)])
        self.leads = np.array([k == NORMAL and n.startswith(SPACE) for k, n in zip(self.kinds.tolist(), names)])
        self.kept: dict[str, bytes] = {}

    def merge(self, run: str) -> list[str]:
        """The pieces of ``run``: pairs are joined, best score first, of equals the leftmost."""
        rank = self.rank
        if len(run) > SHORT:
            return self._heap(run)
        parts = list(run)
        while len(parts) > 1:
            found = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            least = min(found)
            if least == 1 << 60:
                break
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _heap(self, run: str) -> list[str]:
        parts, n = list(run), len(run)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.rank.get(run[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been joined to another since
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.rank.get(joined := parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(joined)))
        return [p for p in parts if p]

    def _alone(self, run: str) -> bytes:
        """The symbols of one run, as bytes of int32."""
        out: list[int] = []
        for p in self.merge(run):
            if (s := self.symbol.get(p)) is not None:
                out.append(s)
            else:
                out += [self.other[self.fallback[b]] for b in p.encode()] if self.fallback else [self.other[self.unknown]]
        return np.array(out, "<i4").tobytes()

    def _together(self, runs: list[str]) -> list[bytes]:
        """The same of many runs."""
        out, of = [b""] * len(runs), {}
        for i, run in enumerate(runs):
            if len(run) > WIDTHS[-1] or self.first[ord(run[0])] < 0 or self.one_by_one.search(run):
                out[i] = self._alone(run)
            elif len(run) == 1:
                out[i] = self.first[ord(run)].tobytes()
            else:
                of.setdefault(next(w for w in WIDTHS if len(run) <= w), []).append(i)
        for width, at in of.items():
            for k in range(0, len(at), step := (1 << 20) // width):
                part = [runs[i] for i in at[k : k + step]]
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width) < np.array([len(r) for r in part])[:, None]] = self.first[np.frombuffer("".join(part).encode("utf-32-le"), "<u4")]
                for i, symbols in zip(at[k : k + step], merged(ids, self.pairs)):
                    out[i] = symbols
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its ids, and the first and last (exclusive) source byte of each."""
        flat = [self.normalise(t) for t in texts]
        runs = [self.runs.findall(f.decode()) for f, _ in flat]
        fresh = list({r for part in runs for r in part if r not in self.kept})
        if len(self.kept) + len(fresh) > KEPT:
            self.kept.clear()
            fresh = list({r for part in runs for r in part})
        self.kept.update(zip(fresh, self._together(fresh)))
        for part, (_, origin) in zip(runs, flat):
            ids = self.id_of[np.frombuffer(b"".join([self.kept[r] for r in part]), "<i4")]
            yield self._spans(ids, part, origin)

    def _spans(self, ids: np.ndarray, runs: list[str], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.size[ids]
        if self.fallback:
            of = self.bytes[ids]
            lead = np.flatnonzero((of >= 0) & (of & 0xC0 != 0x80))  # the last byte of a character stands for all of it
            n = np.searchsorted([0xC0, 0xE0, 0xF0], of[lead], "right") + 1
            size[lead + n - 1] = n
        elif (gaps := np.flatnonzero(ids == self.unknown)).size:
            size[gaps] = [len(c.encode()) for r in runs for c in self.merge(r) if c not in self.symbol]
            first = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))  # neighbours are one unknown piece
            ids, size = ids[first], np.add.reduceat(size, np.flatnonzero(first))
        end = np.cumsum(size)
        return ids, origin[end - size], origin[end]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become replacement characters, one each. A control id has no text
        and ends a run of bytes."""
        parts = np.split(ids, np.flatnonzero(self.kinds[ids] == CONTROL))
        texts = [self.surface.join(x).decode("utf-8", "brindle-byte") for x in parts]
        shown = ids[self.kinds[ids] != CONTROL]
        return "".join(texts)[int(len(shown) > 0 and self.normalise.prefix and self.leads[shown[0]]) :]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The model of a file; a worker keeps it for its later tasks."""
    with open(path, "rb") as f:
        return Pieces(f.read())


def _mapped(docs: DataFrame, path: str | None, schema: dict[str, tuple[str, pa.DataType]], one) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    bounded_batches(docs.sparkSession)
    slim = docs.select("doc_id", whole("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows = [one(model, *found) for part in groups(batch.column(1).to_pylist()) for found in model.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema.values()))], ["doc_id", *schema])

    return slim.mapInArrow(run, ", ".join([f"doc_id {slim.schema['doc_id'].dataType.simpleString()}", *(f"{n} {t}" for n, (t, _) in schema.items())]))


def tokenise(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, starts, ends``: every row's ids and the bytes of its text that each stands for."""
    ints = ("array<int>", pa.list_(pa.int32()))
    return _mapped(docs, path, {"ids": ints, "starts": ints, "ends": ints}, lambda model, *found: found)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256`` of every row: the ids are decoded again; spans are
    each id's first and last (exclusive) byte of the text, as little-endian 32-bit numbers."""

    def one(model: Pieces, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, str, str, str]:
        spans = np.stack([start, end], 1).astype("<i4").tobytes()
        return len(ids), *(hashlib.sha256(x).hexdigest() for x in (model.decimal.join(ids)[1:], model.decode(ids).encode(), spans))

    text = ("string", pa.string())
    return _mapped(docs, path, {"n_tokens": ("bigint", pa.int64()), "ids_sha256": text, "decoded_sha256": text, "spans_sha256": text}, one)
