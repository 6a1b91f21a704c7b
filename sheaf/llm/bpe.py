"""Byte-level BPE encoding and decoding.

Pre-tokenisation has no regular expression: code points are looked up in a class array (letter, number, other,
space), a four-state machine that follows contractions is run by an associative scan over its transition functions
(each packed into one byte, composed by a table), and token starts are read off classes and states. The slices
feed pair merging, with a cache of bounded bytes in front; cache misses of a batch are merged together, one numpy
round for the least-ranked pair of every word. Slices tile the text, so their byte offsets come along.

Defined results: a null text counts as the empty text and has no ids; texts of any length are taken whole (a piece
above ``LONG`` bytes is merged with a heap, in n log n); repeated rows encode alike; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, documents

L, N, O, S, END = 1, 2, 0, 3, 4
LONG = 192
CACHE_BYTES = 64 << 20
BATCH_CHARS = 1 << 19
_NONE = np.int32(2**31 - 1)
#: White_Space of Unicode.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: States: plain, one letter of a contraction to come, two to come, contraction just ended. A transition function is four
#: two-bit states in a byte: any char, an apostrophe before one letter, an apostrophe before two.
_PLAIN, _ONE, _TWO, _ENDED = range(4)
_STEP = np.array([
    _PLAIN | _ENDED << 2 | _ONE << 4 | _PLAIN << 6,
    _ONE | _ONE << 2 | _ONE << 4 | _ONE << 6,
    _TWO | _TWO << 2 | _TWO << 4 | _TWO << 6,
], np.uint8)


def _composition() -> np.ndarray:
    """then[f << 8 | g]: first f, then g."""
    f, g = np.divmod(np.arange(1 << 16), 256)
    out = np.zeros(1 << 16, np.uint8)
    for s in range(4):
        out |= ((g >> (2 * ((f >> (2 * s)) & 3)) & 3) << (2 * s)).astype(np.uint8)
    return out


_THEN = _composition()
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                table[i] = L
            elif c == "N":
                table[i] = N
        table[_SPACES] = S
        _classes = table
    return _classes


def scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """States after each char, from the plain state: an inclusive scan of transition functions in ``width`` steps a level."""
    n = len(functions)
    if n <= width:
        state, out = 0, np.empty(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            state = out[i] = f >> (2 * state) & 3
        return out
    rows = -(-n // width)
    grid = np.full(rows * width, _STEP[0], np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for k in range(1, width):
        grid[k] = _THEN[grid[k - 1].astype(np.uint16) << 8 | grid[k]]
    after = scan(grid[-1], width)
    before = np.concatenate(([0], after[:-1])).astype(np.uint8)
    return (grid >> (2 * before)[None, :] & 3).T.reshape(-1)[:n]


def token_starts(chars: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Indices where a token starts; every text lies between two chars of class END, which start there too."""
    before, after = classes[:-2], classes[2:]
    c, here, last, ahead = classes[1:-1], chars[1:-1], chars[:-2], chars[2:]
    quote = (here == 39) & (before != O) & (last != 32)
    functions = np.full(len(chars), _STEP[0], np.uint8)
    at = np.flatnonzero(quote) + 1
    if len(at):
        one = np.isin(chars[at + 1], (115, 116, 109, 100))
        second = chars[np.minimum(at + 2, len(chars) - 1)]
        two = np.isin(chars[at + 1], (114, 118)) & (second == 101) | (chars[at + 1] == 108) & (second == 108)
        functions[at[one]] = _STEP[1]
        functions[at[two]] = _STEP[2]
        state = scan(functions)[:-2]
    else:
        state = np.zeros(len(c), np.uint8)
    words = (c != before) & ~((before == S) & (last == 32)) & (state != _ONE) & (state != _TWO) | (state == _ENDED)
    spaces = (before != S) | (after < S)
    start = np.where(c == S, spaces, words) | (c == END)
    return np.concatenate(([0], np.flatnonzero(start) + 1, [len(chars) - 1]))


class Codec:
    """Vocabulary and merges. ``pairs``: (left id, right id) -> (rank, id); ``whole``: pieces that are one token without merging."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: dict[bytes, int]):
        self.tokens, self.whole = tokens, whole
        self.pairs = pairs
        ids = {b: i for i, b in tokens.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.decimals = {i: str(i) for i in tokens}
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.added: dict[str, bytes] = {}
        ranked = sorted((r, i) for r, i in pairs.values())
        self.id_of_rank = np.zeros(ranked[-1][0] + 1 if ranked else 1, np.int64)
        for r, i in ranked:
            self.id_of_rank[r] = i
        self.tables = []
        keys = np.fromiter((a << 17 | b for a, b in pairs), np.uint64, len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), np.int32, len(pairs))
        for bits, factor in ((19, 0x9E3779B97F4A7C15), (17, 0xC2B2AE3D27D4EB4F), (15, 0x165667B19E3779F9), (13, 0xD6E8FEB86659FD93)):
            slot = keys * np.uint64(factor) >> np.uint64(64 - bits)
            held, first = np.unique(slot, return_index=True)
            table, value = np.full(1 << bits, 2**63, np.uint64), np.full(1 << bits, _NONE, np.int32)
            table[held], value[held] = keys[first], ranks[first]
            self.tables.append((np.uint64(factor), np.uint64(64 - bits), table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
        self.left = {int(k): int(r) for k, r in zip(keys, ranks, strict=True)}

    @classmethod
    def from_ranks(cls, data: bytes) -> Codec:
        """Of a file of base64 tokens and ranks: any pair whose bytes together are a token merges, at that token's rank."""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        return cls({i: b for b, i in ranks.items()}, pairs, ranks)

    @classmethod
    def from_json(cls, data: bytes, added: bool = True) -> Codec:
        """Of a file with ``model.vocab`` and ``model.merges`` in printable stand-ins for bytes; merges rank by their place.

        The file's ``added_tokens`` are cut out of a text first and are one id each, as in the public library's default;
        without ``added`` they are text like any other. Tokens that take in white space or stand as single words only raise an error.
        """
        read = json.loads(data)
        model = read["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = model["vocab"]
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        made = cls(tokens, pairs, {})
        for t in read.get("added_tokens", []) if added else []:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") and read.get("normalizer"):
                raise ValueError(f"added token {t['content']!r} has options that are not supported")
            made.added[t["content"]] = t["id"].to_bytes(4, "little")
            made.tokens[t["id"]] = t["content"].encode()
            made.decimals[t["id"]] = str(t["id"])
        return made

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 17 | b).astype(np.uint64)
        out = np.full(len(key), _NONE, np.int32)
        for factor, shift, table, value in self.tables:
            slot = (key * factor >> shift).astype(np.int64)
            hit = table[slot] == key
            out[hit] = value[slot[hit]]
        for k, r in self.left.items():
            out[key == k] = r
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        sym = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        prev, following = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(p[0], i, sym[i], sym[i + 1], p[1]) for i in range(n - 1) if (p := self.pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = following[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            k = following[i] = following[j]
            if k >= 0:
                prev[k] = i
                if p := self.pairs.get((new, sym[k])):
                    heapq.heappush(heap, (p[0], i, new, sym[k], p[1]))
            h = prev[i]
            if h >= 0 and (p := self.pairs.get((sym[h], new))):
                heapq.heappush(heap, (p[0], h, sym[h], new, p[1]))
        return np.array([s for s in sym if s >= 0], "<u4")

    def merge(self, pieces: list[str]) -> None:
        """Encode pieces into the cache."""
        words, names = [], []
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            if (i := self.whole.get(b)) is not None:
                self.cache[p] = i.to_bytes(4, "little")
            elif len(b) > LONG:
                self.cache[p] = self._merge_long(b).tobytes()
            else:
                words.append(b)
                names.append(p)
        if not words:
            return
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            ranks = np.full(len(sym), _NONE, np.int32)
            inside = np.flatnonzero(word[:-1] == word[1:])
            ranks[inside] = self.rank(sym[inside], sym[inside + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(ranks, first)
            counts = np.diff(np.append(first, len(sym)))
            least = np.repeat(least, counts)
            alive = least != _NONE
            if not alive.all():
                done.append((word[~alive], sym[~alive]))
                sym, word, ranks, least = sym[alive], word[alive], ranks[alive], least[alive]
                if not len(sym):
                    break
            at = np.flatnonzero(ranks == least)
            place = np.arange(len(at))
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            sym[at] = self.id_of_rank[ranks[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        data = sym[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        begin = 0
        for p, end in zip(names, ends, strict=True):
            self.cache[p] = data[begin:end]
            begin = end

    def slices(self, texts: list[str]) -> Iterator[list[str]]:
        """Pre-tokens of each text."""
        joined = "\0" + "\0".join(texts) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = char_classes()[chars]
        ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
        classes[ends] = END
        starts = token_starts(chars, classes)
        bounds = np.searchsorted(starts, ends).tolist()
        at = starts.tolist()
        all_slices = [joined[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
        for a, b in zip(bounds, bounds[1:]):  # noqa: B905
            yield all_slices[a + 1 : b]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.added or not any(a in t for t in texts for a in self.added):
            yield from self._encode(texts)
            return
        cut = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")")
        parts = [cut.split(t) for t in texts]  # every second part is an added token
        found = self._encode([p for x in parts for p in x[::2]])
        for x in parts:
            yield b"".join(self.added[p] if i % 2 else next(found) for i, p in enumerate(x))

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for group in groups_of(texts):
            pieces = list(self.slices(group))
            missing = {p for x in pieces for p in x}.difference(self.cache)
            if missing:
                self.merge(list(missing))
            get = self.cache.__getitem__
            for x in pieces:
                yield b"".join(map(get, x))
            # about what an entry takes: its text, its ids, and the objects around them
            self.held += sum(2 * len(p) + len(get(p)) + 250 for p in missing)
            if self.held > CACHE_BYTES:
                self.cache.clear()
                self.held = 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each id's piece of the text begins."""
        lens = np.fromiter((len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()), np.int64, len(ids) // 4)
        return np.cumsum(lens) - lens


def groups_of(texts: list[str]) -> Iterator[list[str]]:
    """Neighbours of about ``BATCH_CHARS`` together; a longer text stays whole."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


_codecs: dict[tuple[int, str, bool], Codec] = {}


def codec(data: bytes, name: str, added: bool = True) -> Codec:
    """A worker keeps the tables of the vocabularies it has used."""
    key = (hash(data), name, added)
    if key not in _codecs:
        _codecs[key] = Codec.from_json(data, added) if name.endswith(".json") else Codec.from_ranks(data)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, offsets`` of each row: token ids and the byte of the text at which each begins."""
    bounded_batches(df.sparkSession)
    data = read_vocabulary(vocabulary)
    rows = df.select(id_col, text_col)
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        c = codec(data, vocabulary)
        for b in batches:
            found = list(c.encode([t or "" for t in b.column(1).to_pylist()]))
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([c.offsets(x) for x in found], pa.list_(pa.int64()))], [id_col, "ids", "offsets"])

    return rows.mapInArrow(run, f"{id_col} {kind}, ids array<int>, offsets array<bigint>")


def decode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id") -> DataFrame:
    """``id, bytes`` of rows with ``ids``."""
    bounded_batches(df.sparkSession)
    data = read_vocabulary(vocabulary)
    rows = df.select(id_col, "ids")
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        c = codec(data, vocabulary)
        for b in batches:
            out = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    return rows.mapInArrow(run, f"{id_col} {kind}, bytes binary")


def round_trip(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encode and decode beside each other, so that ids need not leave the worker."""
    bounded_batches(df.sparkSession)
    data = read_vocabulary(vocabulary)
    rows = df.select(id_col, text_col)
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        c = codec(data, vocabulary)
        show, token = c.decimals.__getitem__, c.tokens.__getitem__
        for b in batches:
            n, shas, back = [], [], []
            for x in c.encode([t or "" for t in b.column(1).to_pylist()]):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                shas.append(hashlib.sha256(",".join(map(show, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
