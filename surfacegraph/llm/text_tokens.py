"""Token ids of whole texts, through the tokenizers library.

Natural text repeats its words. ``ChunkEncoder`` cuts a text at ASCII white
space, which this vocabulary's own splitting never crosses, and keeps the ids
of the chunks it has seen in a bounded table, so the library encodes each
distinct word about once a worker. The ids equal those of encoding the whole
text; ``tests/llm`` compares both on random texts.
"""

from __future__ import annotations

import json
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workspace import settle

#: ASCII marks that form a token group of their own after a letter or digit.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Characters of text that are cut into chunks at a time.
GROUP = 4_000_000


def _strings(a: pa.Array) -> list[str]:
    """A large_string array without white space as a list, in one join and one split."""
    if not len(a):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(a)], pa.int64()), a)
    return pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``limit`` bounds the table of known chunks; a full table becomes the older
    one, from which chunks that occur again move back, and the one before goes.
    Vocabularies whose splitting may cross white space, or that normalise in
    another way than NFC and lower case, are encoded text by text.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm = spec["model"], spec.get("normalizer") or {}
        self.by_chunk = (
            model.get("end_of_word_suffix") == "</w>"
            and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and r"[^\s\p{L}\p{N}]+" in json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self.ends = np.zeros(self.vocab_size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text, packed; a null text has none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.by_chunk:
            return self._direct([t or "" for t in texts.to_pylist()])
        out: list[bytes] = [b""] * len(texts)
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._direct([texts[i].as_py()])[0]
        # lower-casing A-Z first is safe where it leaves no composition to make
        plain = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~plain & ~odd).tolist():
            text = texts[i].as_py()
            plain[i] = is_normalized("NFC", text) and is_normalized("NFC", text.encode().lower().decode())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for lower in (True, False):
            which = np.flatnonzero((plain == lower) & ~odd)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[which]) // GROUP)) + 1
            for group in np.split(which, cuts):
                if len(group):
                    part = texts.take(pa.array(group))
                    self._encode_group(pc.ascii_lower(part) if lower else part, group.tolist(), out)
        return out

    def _encode_group(self, texts: pa.Array, rows: list[int], out: list[bytes]) -> None:
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        packed = self._chunk_ids(coded.dictionary)
        ids = np.frombuffer(b"".join(packed), "<u4")
        many = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first = np.cumsum(many) - many
        index = coded.indices.to_numpy()
        per_chunk = many[index]
        ends = np.cumsum(per_chunk)
        where = np.repeat(first[index] - (ends - per_chunk), per_chunk) + np.arange(ends[-1] if len(ends) else 0)
        stream = ids[where].tobytes()
        marks = 4 * np.r_[0, ends][bounds]
        for i, a, z in zip(rows, marks[:-1].tolist(), marks[1:].tolist(), strict=True):
            out[i] = stream[a:z]

    def _chunk_ids(self, chunks: pa.Array) -> list[bytes]:
        """The ids of different chunks. A word with marks behind it is looked up as two words."""
        heads = pc.utf8_rtrim(chunks, characters=MARKS)
        sizes = pc.binary_length(heads).to_numpy()
        two = (sizes > 0) & (sizes < pc.binary_length(chunks).to_numpy()) & pc.match_substring_regex(heads, "[0-9A-Za-z]$").to_numpy(zero_copy_only=False)
        both = np.flatnonzero(two)
        pick = pa.array(both)
        tails = [c[len(h) :] for c, h in zip(_strings(chunks.take(pick)), _strings(heads.take(pick)), strict=True)]
        coded = pa.concat_arrays([pc.if_else(pa.array(two), heads, chunks), pa.array(tails, pa.large_string())]).dictionary_encode()
        words, index = self._word_ids(_strings(coded.dictionary)), coded.indices.to_numpy().tolist()
        packed = [words[i] for i in index[: len(chunks)]]
        for at, i in zip(both.tolist(), index[len(chunks) :], strict=True):
            packed[at] += words[i]
        return packed

    def _word_ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known = self.known
        new = [w for w in words if w not in known]
        if self.older and new:
            older = self.older
            known.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in older]
        extra = self._learn(new)
        return [known[w] if w in known else extra[w] for w in words] if extra else [known[w] for w in words]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Adds words to the table; returns the ids of those too long to keep.

        Plain words are encoded together: a token that ends a word tells where
        the next begins.
        """
        known, extra = self.known, {}
        plain = [w for w in new if w.isascii() and w.isalpha() and len(w) <= 64]
        rest = [w for w in new if not (w.isascii() and w.isalpha() and len(w) <= 64)]
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(some):
                rest += some
                continue
            packed, start = ids.tobytes(), 0
            for w, end in zip(some, cuts.tolist(), strict=True):
                known[w] = packed[start:end]
                start = end
        for at in range(0, len(rest), 4000):
            some = rest[at : at + 4000]
            for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                (known if len(w) <= 64 else extra)[w] = np.array(e.ids, "<u4").tobytes()
        return extra


_encoders: dict[str, ChunkEncoder] = {}


def release() -> None:
    """Gives the tables back; a worker that turns to another operator calls this."""
    _encoders.clear()


def encoder(path: str, limit: int = 300_000) -> ChunkEncoder:
    """One encoder a worker process, kept between tasks. ``limit``: words that it keeps, twice at most."""
    if path not in _encoders:
        settle()  # what the worker did before has left memory that no one uses
        _encoders[path] = ChunkEncoder(path)
    _encoders[path].limit = limit
    return _encoders[path]
