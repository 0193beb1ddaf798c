"""Hierarchical packing of documents into training sequences of several lengths.

Each task tokenises its documents and fills a pool of bounded size; a full pool is packed and let go, so nothing is shuffled and
memory does not grow with a partition. In a pool, whole windows of the longest context are cut from long documents first. What
is left of a document is routed to the smallest tier (a power of two) that holds it. Tiers are packed from the longest: each
left-over opens a window of its tier's context, and the gap is filled from the shorter tiers, longest that fits first, at last by
a piece cut from one. Windows of one tier form step groups of at most `step` tokens; the groups of a tier in a pool are
balanced: none has over one window more than another. A group is named by its first sequence.

Padding: a window is full unless the pool has run out of pieces, which happens to one window a pool at most; that one is cut
into the powers of two that its length is made of, each a sequence of its own. Hence no sequence is padded.

Rows: a null text is empty and makes one piece, the end token alone. Repeated rows and ids are packed each for itself. A very long
text is tokenised and packed alone. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernel as K
from .common import ship

#: Text that is tokenised at once; its words and places take some thirty times as much.
PIECE_BYTES = 2 << 20
_LOADED: dict[str, "WordTokenizer"] = {}


_STRIPPED, _PLAIN, _LEAD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_STRIPPED[list(b".,;:!?")] = True
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
#: First bytes of two-byte letters: U+00C0 to U+023F but for the signs of times and division and the dotted I, U+0400 to U+047F.
_LEAD[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = True
_NO_LETTER = (0xC397, 0xC3B7, 0xC4B0)
#: Below this code point, letters are folded one by one and alike everywhere.
_SIMPLE = "\u0590"


class WordTokenizer:
    """Ids of texts by a tokenizer that folds case and whose pre-tokenizer never joins across white space, nor a letter or digit
    with the punctuation that follows. Each different unit between those bounds is tokenised once and remembered while it
    recurs; `most` bounds what is remembered. Units of letters alone are tokenised joined by spaces, as each ends at one
    end-of-word id; if the ends do not number the units, or a unit is of another make, it is tokenised for itself.

    Joined units that are in normal form already go to a copy of the tokenizer without its normaliser and with a split at
    spaces for its pre-tokenizer, which is what those do to them."""

    def __init__(self, path: str, most: int = 250_000, joined: int = 4000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most, self.joined = most, joined
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1, np.uint32)  # the first place is for the end of a text
        self.start = self.size = self.uses = np.zeros(0, np.int64)

    @staticmethod
    def load(path: str) -> "WordTokenizer":
        if path not in _LOADED:
            _LOADED[path] = WordTokenizer(path)
        return _LOADED[path]

    def _forget(self) -> None:
        """Keeps what recurred, half of the most at most."""
        few = np.partition(self.uses, -(self.most // 2))[-(self.most // 2)] if len(self.uses) > self.most // 2 else 0
        keep = np.flatnonzero(self.uses > max(1, few))
        names = list(self.at)
        self.at = {names[k]: i for i, k in enumerate(keep.tolist())}
        size = self.size[keep]
        base = np.cumsum(size) - size
        self.flat = np.concatenate((self.flat[:1], self.flat[np.repeat(self.start[keep] - base, size) + np.arange(int(size.sum()))]))
        self.start, self.size, self.uses = base + 1, size, self.uses[keep] // 2

    def _joined(self, units: list[str]) -> np.ndarray:
        text = " ".join(units)
        if max(text) < _SIMPLE and "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            return np.array(self.bare.encode_batch_fast([text.lower()], add_special_tokens=False)[0].ids, np.uint32)
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another and how many each has."""
        flats, sizes = [], np.zeros(len(units), np.int64)
        letters = np.fromiter(map(str.isalpha, units), bool, len(units))
        rest = np.flatnonzero(~letters).tolist()
        order = []
        plain = np.flatnonzero(letters).tolist()
        for a in range(0, len(plain), self.joined):
            chunk = plain[a : a + self.joined]
            ids = self._joined([units[i] for i in chunk])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(chunk) or (len(ids) and last[-1] != len(ids) - 1):
                rest += chunk
                continue
            sizes[chunk] = np.diff(last, prepend=-1)
            flats.append(ids)
            order += chunk
        for a in range(0, len(rest), self.joined):
            chunk = rest[a : a + self.joined]
            each = [e.ids for e in self.tok.encode_batch_fast([units[i] for i in chunk], add_special_tokens=False)]
            sizes[chunk] = np.fromiter(map(len, each), np.int64, len(each))
            flats.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32))
            order += chunk
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        order_a = np.array(order, np.int64)
        came = np.zeros(len(units), np.int64)
        came[order_a] = np.cumsum(sizes[order_a]) - sizes[order_a]
        base = np.cumsum(sizes) - sizes
        return flat[np.repeat(came - base, sizes) + np.arange(int(sizes.sum()))], sizes

    def _known(self, units: list[str], uses: np.ndarray) -> np.ndarray:
        """Places of different units in the memory; the new ones are tokenised first."""
        if len(self.at) > self.most:
            self._forget()
        place = np.fromiter(map(self.at.get, units, itertools.repeat(-1)), np.int64, len(units))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = [units[i] for i in fresh.tolist()]
            flat, size = self._encode_units(new)
            n = len(self.at)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
            self.flat = np.concatenate((self.flat, flat))
            self.at.update(zip(new, range(n, n + len(new))))
            place[fresh] = np.arange(n, n + len(new))
        self.uses[place] += uses
        return place

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and the offsets of the texts."""
        data, rows = K.buffers(texts)
        data = K.lower(data)
        w = K.Words(data, rows)
        tail = w.end.copy()  # where the punctuation at a word's end begins
        left = np.arange(len(tail))
        while len(left):
            left = left[(tail[left] > w.start[left])]
            left = left[_STRIPPED[data[tail[left] - 1]]]
            tail[left] -= 1
        cut = np.flatnonzero((tail > w.start) & (tail < w.end))
        at = tail[cut]
        two = (at - w.start[cut] > 1) & _LEAD[data[at - 2]]
        two &= ~np.isin(data[at - 2].astype(np.int64) << 8 | data[at - 1], _NO_LETTER)
        cut = cut[_PLAIN[data[at - 1]] | two]
        first = np.arange(len(tail))
        first[1:] += np.cumsum(np.bincount(cut, minlength=len(tail)))[:-1] if len(tail) else 0
        length = np.empty(len(tail) + len(cut), np.int32)
        length[first] = w.end - w.start
        length[first[cut]] = tail[cut] - w.start[cut]
        length[first[cut] + 1] = w.end[cut] - tail[cut]
        unit_off = np.append(first, len(length))[w.off]
        if len(length):
            # the units are all that is not white space, one after another
            units = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.py_buffer(data[~K._SPACE[data]])])
            coded = pc.dictionary_encode(units)
            index = coded.indices.to_numpy(zero_copy_only=False)
            place = self._known(coded.dictionary.to_pylist(), np.bincount(index, minlength=len(coded.dictionary)))[index]
        else:
            place = np.zeros(0, np.int64)
        self.flat[0] = end
        size, at = np.insert(self.size[place], unit_off[1:], 1), np.insert(self.start[place], unit_off[1:], 0)
        total = np.concatenate(([0], np.cumsum(size)))
        doc_off = total[np.append(unit_off[:1], unit_off[1:] + np.arange(1, len(unit_off)))]
        step = np.repeat((at - total[:-1]).astype(np.int32), size)
        step += np.arange(len(step), dtype=np.int32)
        return self.flat[step], doc_off


def plan(sizes: list[int], context: int, smallest: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (length, pieces (document, start, length)) of documents of the given sizes."""
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start; sorted
    for d, n in enumerate(sizes):
        whole = n // context
        out.extend((context, [(d, k * context, context)]) for k in range(whole))
        if n % context:
            rest.append((n % context, d, whole * context))
    rest.sort()
    while rest:
        n, d, at = rest.pop()
        tier = max(smallest, 1 << (n - 1).bit_length())
        pieces, used = [(d, at, n)], n
        while used < tier and rest:
            k = bisect.bisect_left(rest, (tier - used + 1,)) - 1  # the longest that fits
            if k >= 0:
                m, d, at = rest.pop(k)
            else:
                k = 0  # none does: the shortest is cut
                m, d, at = rest.pop(k)
                left = m - (tier - used)
                m = tier - used
                bisect.insort(rest, (left, d, at + m))
            pieces.append((d, at, m))
            used += m
        if used == tier:
            out.append((tier, pieces))
        else:
            out.extend(_powers(pieces, used))
    return out


def _powers(pieces: list[tuple[int, int, int]], used: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """A window that stays open, cut into sequences of the powers of two in its length."""
    at, took = 0, 0
    for bit in reversed(range(used.bit_length())):
        need = (1 << bit) & used
        got, length = [], need
        while need:
            d, start, n = pieces[at]
            m = min(n - took, need)
            got.append((d, start + took, m))
            need, took = need - m, took + m
            if took == n:
                at, took = at + 1, 0
        if got:
            yield length, got


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, context: int, smallest: int, pool: int, step: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tok = WordTokenizer.load(path)
    number = TaskContext.get().partitionId() << 32
    ids, offs, names, held = [], [], [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal number, ids, offs, names, held
        flat = np.concatenate(ids)
        sizes = np.concatenate([np.diff(o) for o in offs])
        base = np.concatenate(([0], np.cumsum(sizes)))
        seqs = sorted(plan([int(x) for x in sizes], context, smallest), key=lambda s: -s[0])
        doc, start, length, seq, offset, group = [], [], [], [], [], []
        many = collections.Counter(size for size, _ in seqs)
        first = dict(zip(many, itertools.accumulate(many.values(), initial=number)))
        for size, pieces in seqs:
            # a step group holds windows of one tier; a tier's groups hold equally many, but for one
            groups = -(-many[size] // max(1, step // size))
            k = (number - first[size]) * groups // many[size]
            at_group = first[size] - (-k * many[size] // groups)
            used = 0
            for d, s, n in pieces:
                doc.append(d), start.append(s), length.append(n), seq.append(number), offset.append(used), group.append(at_group)
                used += n
            number += 1
        doc_a, start_a, length_a = np.array(doc), np.array(start, np.int64), np.array(length, np.int64)
        first = base[doc_a] + start_a
        raw = np.concatenate([flat[a : a + n] for a, n in zip(first.tolist(), length)]).astype("<u4", copy=False)
        blobs = K.binaries(raw.view(np.uint8), 4 * np.concatenate(([0], np.cumsum(length_a))))
        column = pa.concat_arrays(names).take(pa.array(doc_a))
        arrays = [column, pa.array(start_a), pa.array(length_a), blobs, pa.array(sizes[doc_a]), pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array(group, pa.int64())]
        table = pa.Table.from_arrays(arrays, schema=schema)
        ids, offs, names, held = [], [], [], 0
        yield from table.to_batches(max_chunksize=2000)

    for piece in K.slices(batches, "text", limit=PIECE_BYTES):
        flat, off = tok.encode(piece.column("text"), end)
        ids.append(flat), offs.append(off), names.append(piece.column("id"))
        held += len(flat)
        if held >= pool:
            yield from emit()
    if held:
        yield from emit()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2, context: int = 4096, smallest: int = 256, pool: int = 2 << 20, step: int = 1 << 19) -> DataFrame:
    """Pieces (id, start, length, ids as little-endian 32-bit binary, doc_tokens, sequence_id, offset, step_group).

    tokenizer: path of a `tokenizers` file that each executor has; context: longest window; smallest: shortest tier;
    pool: tokens packed together; step: tokens of a step group.
    """
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import LongType

    src = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    kind = src.schema["id"].dataType
    fields = [("id", to_arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("step_group", pa.int64())]
    schema = pa.schema(fields)
    longs = LongType().simpleString()
    ddl = f"id {kind.simpleString()}, start {longs}, length {longs}, ids binary, doc_tokens {longs}, sequence_id {longs}, offset {longs}, step_group {longs}"
    return src.mapInArrow(lambda b: _pack(b, tokenizer, end, context, smallest, pool, step, schema), ddl)
