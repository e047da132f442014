"""Byte-level BPE: encoding by merge ranks, and decoding.

A text is cut into the matches of the vocabulary's pattern; each match that is
no token itself starts as single bytes, and the adjacent pair whose bytes are
the token of least rank, the leftmost of them, is merged until no pair is a
token. A segment tree over the byte positions holds the least (rank, position)
of the pairs; a merge changes the pairs at two live neighbours and the merged
place, so it costs three updates of a logarithm each, and the root tells the
next pair. The trees of many matches of similar length are the rows of one
array, and every step merges one pair in each row.

Natural text repeats its words, so a worker cuts texts at white space, which
no match of the pattern crosses but for one leading space, and keeps the ids
of the chunks that it has seen in a bounded table. Texts are read in blocks
that end between chunks: what a worker holds does not grow with a text, except
for a single chunk without white space.

Defined results: a null text is the empty text, which has no ids; repeated
rows are encoded alike; extra columns stay (names that clash with those added
are an error of the caller); an empty table gives an empty result with the
same columns. Null ids decode to null. Ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .workspace import bound_batches, by_bytes, settle

#: Bytes of text that are cut into chunks at a time.
BLOCK = 4_000_000

#: Chunks of more bytes are not kept.
LONGEST = 64

# The characters of Unicode's White_Space; ASCII ones apart.
ASCII_SPACE = b"\t\n\x0b\x0c\r "
OTHER_SPACE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_NONE = np.iinfo(np.int64).max

#: Leaves of the trees that are built at a time.
TREES = 1 << 15

SPACE, LETTER, DIGIT, MARK, ODD = range(5)


class Merger:
    """Merges bytes by ranks, many matches at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to write a token as two tokens
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # pairs are found by the id on the left: its keys begin here
        self.first = np.searchsorted(self.keys, np.arange(self.size + 1) * self.size)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; ``_NONE`` for pairs that are no token."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed; pieces must not be empty."""
        ranks = self.ranks
        out = [_packed(ranks[p]) if p in ranks else b"" for p in pieces]
        left = [i for i, ids in enumerate(out) if not ids]
        groups: dict[int, list[int]] = {}
        for i in left:
            groups.setdefault((len(pieces[i]) - 1).bit_length(), []).append(i)
        for bits, members in groups.items():
            rows = max(1, TREES >> bits)
            for at in range(0, len(members), rows):
                some = members[at : at + rows]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes, a tree each. Places are numbered through all trees, ``width + 1`` a tree."""
        many, wide, two = len(pieces), width + 1, 2 * width
        sizes = np.fromiter(map(len, pieces), np.int64, many)
        place = np.arange(wide)
        live = place[None, :] < sizes[:, None]
        ids = np.full((many, wide), -1, np.int64)
        ids[live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((many, two), _NONE, np.int64)
        # the place after the last holds no id, and no place follows it
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(many, width)
        tree[:, width:] = np.where(rank == _NONE, _NONE, rank * width + place[:-1])
        for level in range(width.bit_length() - 1, 0, -1):
            a, z = 1 << (level - 1), 1 << level
            tree[:, a:z] = np.minimum(tree[:, 2 * a : 2 * z : 2], tree[:, 2 * a + 1 : 2 * z : 2])
        after = np.tile(np.minimum(place + 1, width), many)
        before = np.tile(place - 1, many)
        ids, tree, live = ids.ravel(), tree.ravel(), live.ravel()
        row = np.arange(many)
        while True:
            least = tree[row * two + 1]
            if (least == _NONE).any():
                row = row[least != _NONE]
                if not len(row):
                    break
                least = least[least != _NONE]
            here, root = least & (width - 1), row * two
            base = row * wide
            at = base + here
            right = after[at]
            gone = base + right
            beyond = after[gone]
            ids[at] = merged = least >> (width.bit_length() - 1)
            live[gone] = False
            after[at] = beyond
            before[base + beyond] = here
            follow = ids[base + beyond]
            left = before[at]
            prior = np.where(left >= 0, ids[base + np.maximum(left, 0)], -1)
            found = self._rank(np.r_[merged, prior], np.r_[follow, merged])
            self._set(tree, root, right, np.full(len(row), _NONE), width)
            self._set(tree, root, here, found[: len(row)], width)
            some = np.flatnonzero(left >= 0)
            self._set(tree, root[some], left[some], found[len(row) :][some], width)
        raw = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.reshape(many, wide).sum(1)) * 4
        return [raw[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _set(tree: np.ndarray, root: np.ndarray, place: np.ndarray, rank: np.ndarray, width: int) -> None:
        """Sets one leaf of each tree and the nodes above it. ``root``: where the trees begin."""
        at = place + width
        value = np.where(rank == _NONE, _NONE, rank * width + place)
        tree[root + at] = value
        while width > 1:
            # the other child of the node above
            value = np.minimum(value, tree[root + (at ^ 1)])
            at >>= 1
            tree[root + at] = value
            width >>= 1


def _packed(token: int) -> bytes:
    return token.to_bytes(4, "little")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; ``limit`` bounds the table of known chunks."""

    def __init__(self, path: str, pattern: str, limit: int = 200_000):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.merger = Merger(ranks)
        # white space is Unicode's, whatever the library's own class holds
        space = "\\t\\n\\x0b\\x0c\\r " + OTHER_SPACE
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{space}").replace("\\S", f"[^{space}]").replace("\\s", f"[{space}]"))
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.kind = np.full(256, MARK, np.int8)
        self.kind[list(ASCII_SPACE)] = SPACE
        self.kind[list(b"0123456789")] = DIGIT
        self.kind[[b for b in range(128) if chr(b).isalpha()]] = LETTER
        self.plain = (self.kind == LETTER) | (self.kind == DIGIT)
        # two-byte characters from U+00C0 on; all others are told by the pattern
        self.kind[0x80:] = ODD
        self.kind[0x80:0xC0] = LETTER
        self.kind[0xC3] = LETTER
        self.kind[ord("'")] = ODD
        self.others = f"[{OTHER_SPACE}]"

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed; a null text has none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.others).to_numpy(zero_copy_only=False)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].copy()
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        # neighbours that fit into a block are cut together
        start = 0
        while start < len(texts):
            if odd[start]:
                out[start] += self._odd(data[bounds[start] : bounds[start + 1]])
                start += 1
                continue
            end = start + 1
            while end < len(texts) and not odd[end] and bounds[end + 1] - bounds[start] <= BLOCK:
                end += 1
            if end == start + 1:
                out[start] += self._long(data[bounds[start] : bounds[end]])
            else:
                marks = self._chunks(data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
                for i, ids in zip(range(start, end), marks, strict=True):
                    out[i].append(ids)
            start = end
        return [b"".join(parts) for parts in out]

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a chunk starts at each byte.

        A chunk is a match of the pattern, where bytes tell it: white space that
        belongs to no word, or letters, digits or marks with the space before
        them. Words with an apostrophe, or with characters outside Latin-1's
        letters, are chunks as a whole.
        """
        kind = self.kind[data]
        # the two characters of this lead byte that are no letters
        kind[1:][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = ODD
        space = kind == SPACE
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        begins = first[:-1].copy()
        # white space begins; its last character stands apart if a word follows
        begins[1:] |= space[1:] & ~space[:-1]
        word = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
        begins[word] = True
        begins[word[data[word] != 32] + 1] = True
        # words with odd bytes stay whole, others end where the kind changes
        change = np.flatnonzero((kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1]) + 1
        edges = np.flatnonzero(begins)
        odd = np.zeros(len(edges) + 1, bool)
        odd[np.searchsorted(edges, np.flatnonzero(kind == ODD), "right")] = True
        begins[change[~odd[np.searchsorted(edges, change, "right")]]] = True
        return begins

    def _chunks(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """The ids of each text of one block."""
        starts = np.flatnonzero(self._starts(data, bounds))
        if not len(starts):
            return iter([b""] * (len(bounds) - 1))
        edges = np.r_[starts, len(data)]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        coded = whole.dictionary_encode()
        packed = self._known(coded.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(packed), "<u4")
        many = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first = np.cumsum(many) - many
        index = coded.indices.to_numpy()
        per = many[index]
        ends = np.cumsum(per)
        where = np.repeat(first[index] - (ends - per), per) + np.arange(ends[-1])
        stream = ids[where].tobytes()
        cuts = (4 * np.r_[0, ends][np.searchsorted(starts, bounds)]).tolist()
        return (stream[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True))

    def _long(self, data: np.ndarray) -> list[bytes]:
        """One text, in blocks that end where a chunk begins."""
        out, start = [], 0
        while start < len(data):
            size = BLOCK
            while True:
                end = min(len(data), start + size)
                if end == len(data):
                    break
                # a start is certain once the byte after it is seen
                begins = np.flatnonzero(self._starts(data[start:end], np.array([0]))[:-1])
                if begins[-1] > 0:
                    end = start + int(begins[-1])
                    break
                size *= 2  # one chunk fills the block
            out += self._chunks(data[start:end], np.array([0, end - start]))
            start = end
        return out

    def _odd(self, data: np.ndarray) -> list[bytes]:
        """A text with other white space, by the pattern alone, in blocks that end at a space between ASCII letters or digits."""
        out, start = [], 0
        while start < len(data):
            size = BLOCK
            while True:
                end = min(len(data), start + size)
                if end == len(data):
                    break
                plain = self.plain[data[start:end]]
                cuts = np.flatnonzero(plain[:-2] & (data[start + 1 : end - 1] == 32) & plain[2:]) + 1
                if len(cuts):
                    end = start + int(cuts[-1])
                    break
                size *= 2
            text = data[start:end].tobytes().decode()
            out += self._pieces([m.group().encode() for m in self.pattern.finditer(text)])
            start = end
        return out

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        known = self.known
        new = [c for c in chunks if c not in known]
        extra: dict[bytes, bytes] = {}
        if new:
            if len(known) + len(new) > self.limit:
                known = self.known = {c: known[c] for c in chunks if c in known}
            cut = [[c] if c.isascii() and b"'" not in c else [m.encode() for m in self.pattern.findall(c.decode())] for c in new]
            found = self._pieces([p for parts in cut for p in parts])
            at = 0
            for chunk, parts in zip(new, cut, strict=True):
                ids = found[at] if len(parts) == 1 else b"".join(found[at : at + len(parts)])
                at += len(parts)
                (known if len(chunk) <= LONGEST and len(known) < self.limit else extra)[chunk] = ids
        return [known[c] if c in known else extra[c] for c in chunks]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        different = list(dict.fromkeys(pieces))
        ids = dict(zip(different, self.merger.encode(different), strict=True))
        return [ids[p] for p in pieces]


class Decoder:
    """Bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        tokens = [ranks.get(i) for i in range(max(ranks) + 1)]
        self.missing = np.array([t is None for t in tokens], bool)
        self.data = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        self.sizes = np.array([len(t or b"") for t in tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def decode(self, packed: bytes, block: int = 500_000) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return b"".join(self._block(ids[i : i + block]) for i in range(0, len(ids), block))

    def _block(self, ids: np.ndarray) -> bytes:
        if ids.max() >= len(self.sizes) or self.missing[ids].any():
            raise ValueError("an id is no token of the vocabulary")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.first[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


_workers: dict[tuple, object] = {}


def _worker(make, *arguments):
    """One encoder or decoder a worker process, kept between tasks."""
    key = (make, *arguments)
    if key not in _workers:
        _workers[key] = make(*arguments)
    return _workers[key]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with the ids of each text (binary, little-endian unsigned 32-bit) and their number.

    ``path``: a file of base64 tokens and their ranks, readable on every
    machine; ``pattern``: the regular expression whose matches are encoded
    apart, of the kind that crosses white space by one leading space only.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        encoder = _worker(Encoder, path, pattern)
        for batch in by_bytes(batches, at):
            packed = encoder.encode(batch.column(at))
            yield _with(batch, **{ids: pa.array(packed, pa.binary()), n_tokens: pa.array([len(p) // 4 for p in packed], pa.int64())})
        settle()

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]))


def decode(tokens: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes (binary) of each row's ids."""
    bound_batches(tokens.sparkSession)
    at = tokens.columns.index(ids)

    def run(batches):
        decoder = _worker(Decoder, path)
        for batch in by_bytes(batches, at):
            found = [None if p is None else decoder.decode(p) for p in batch.column(at).to_pylist()]
            yield _with(batch, **{decoded: pa.array(found, pa.binary())})
        settle()

    return tokens.mapInArrow(run, T.StructType(tokens.schema.fields + [T.StructField(decoded, T.BinaryType())]))
