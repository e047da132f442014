"""Removal of repeated byte strings, wherever they occur in the corpus.

A corpus has no suffix array that one machine could hold, so equal strings
are first brought together. Each window of ``length`` bytes is assigned to its
anchor, the leftmost position in it where the hash of a short gram is least.
Equal windows have equal anchors at equal places, so only occurrences of a
repeated gram are candidates. An occurrence's segment is what the windows
assigned to it cover; an equal segment elsewhere proves all of it repeated by
counting. Segments that are alone but share their gram with others are
joined into texts of bounded size, and there the method proper decides:
from the suffix order a Burrows-Wheeler transform is made, and backward
extension, breadth first, derives the common prefixes of neighbouring suffixes
by increasing value, stopping at ``length``; neighbours that have got no value
by then share ``length`` bytes.

A gram with very many different segments (a passage in a third of all
documents, each time in other surroundings) does not go to one task. Its
windows are decided by halving: a range of windows whose span occurs twice is
repeated, one whose common core occurs once is not, others are halved. Every
step is a count and an equi-join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .hot import join_groups
from .workspace import bound_batches, settle, written

#: Bytes of documents that are hashed together.
GROUP = 400_000
#: Bytes of one text that are hashed at a time; a longer one goes in pieces that overlap by a window less one byte.
PIECE = 4_000_000
#: Bytes of segments that one Burrows-Wheeler transform takes, about.
TEXT = 100_000
#: Different segments of one gram, beyond which its windows are halved instead.
HOT = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_size(length: int) -> int:
    """Bytes of a gram: long ones repeat seldom by chance, short ones need fewer anchors."""
    return max(1, length * 3 // 5)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _tables[size] = (_powers(_ODD, size), _powers(inverse, size))
    up, down = _tables[size]
    return up[:n], down[:n]


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on."""
    n = len(raw)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _tables_for(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:], dtype=np.uint64)
    h = (sums[k:] - sums[:-k]) * up[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _ODD
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, position, gram hash, start, end) of every window's anchor, each once.

    ``raw`` holds the texts one after another; ``sizes`` has their lengths.
    The windows of an anchor follow one another; they cover start to end.
    """
    k = gram_size(length)
    span = length - k + 1
    ends = np.cumsum(sizes)
    n_windows = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if n_windows <= 0:
        return none, none, np.zeros(0, np.uint64), none, none
    h = gram_hashes(raw, k)
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    at = (best[:n_windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie within one text
    inside = np.zeros(n_windows + 1, np.int32)
    first = np.minimum(ends - sizes, n_windows)
    last = np.clip(ends - length + 1, 0, n_windows)
    good = last > first
    np.add.at(inside, first[good], 1)
    np.add.at(inside, last[good], -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return none, none, np.zeros(0, np.uint64), none, none
    at = at[windows]
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    tails = np.r_[heads[1:], len(at)] - 1
    at, starts, stops = at[heads], windows[heads], windows[tails] + length
    owner = np.searchsorted(ends, at, "right")
    begin = (ends - sizes)[owner]
    return owner, at - begin, h[at], starts - begin, stops - begin


def _groups(batches, column: int, length: int, most: int):
    """Batches' rows in groups of about GROUP bytes of text: (batch, bytes, sizes, shift). Copies no text.

    A text longer than ``most`` is cut into pieces that start at ``shift``;
    every window is in one piece.
    """
    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column(column)
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + b.num_rows + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] > 0 else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        group, long = np.cumsum(sizes) // GROUP, sizes > most
        cuts = np.flatnonzero((np.diff(group) > 0) | long[1:] | long[:-1]) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            part, lo, hi = b.slice(start, end - start), int(offsets[start]), int(offsets[end])
            if end - start > 1 or hi - lo <= most:
                yield part, raw[lo:hi], sizes[start:end], 0
                continue
            for shift in range(0, hi - lo - length + 1, most):
                piece = raw[lo + shift : min(hi, lo + shift + most + length - 1)]
                yield part, piece, np.array([len(piece)]), shift
    settle()


def _occurrences(length: int, piece: int):
    from xxhash import xxh64_intdigest

    def run(batches):
        for b, raw, sizes, shift in _groups(batches, 2, length, piece):
            owner, at, g, lo, hi = anchors(raw, sizes, length)
            begin = (np.cumsum(sizes) - sizes)[owner]
            view = memoryview(np.ascontiguousarray(raw))
            seg = np.fromiter(
                (xxh64_intdigest(view[x:z], left) for x, z, left in zip((begin + lo).tolist(), (begin + hi).tolist(), (at - lo).tolist(), strict=True)), np.uint64, len(at)
            )
            pick = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), b.column(1).take(pick), *(pa.array((v + shift).astype(np.int32)) for v in (at, lo, hi)), pa.array(g.view(np.int64)), pa.array(seg.view(np.int64))],
                names=["doc_id", "h", "at", "start", "end", "g", "seg"],
            )

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling prefixes. The last symbol must be unique.

    The first round packs as many symbols into a key as 62 bits hold.
    """
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    bits = max(1, int(rank.max()).bit_length())
    width = max(1, min(62 // bits, 8, n))
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        key[: n - i] |= rank[i:]
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


def long_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, whether each suffix shares ``length`` symbols with the one before).

    Backward extension on the Burrows-Wheeler transform, breadth first: rows r-1
    and r of one first symbol c come from consecutive rows i' < i with c in the
    transform, and have a common prefix of l + 1 symbols exactly if the least
    common prefix over (i', i] is l. So the rows with value l + 1 are those that
    have none yet and whose (i', i] has a row that got its value by step l.

    The last symbol must be unique.
    """
    n = len(text)
    order = suffix_order(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt * n + np.arange(n))  # row r's suffix is row by_symbol[r]'s, one symbol longer
    first = text[order]
    done = np.r_[True, first[1:] != first[:-1]]
    open_ = np.flatnonzero(~done)
    before, after = by_symbol[open_ - 1], by_symbol[open_]
    known = 0
    for step in range(1, length):
        seen = np.cumsum(done, dtype=np.int32)
        if seen[-1] == known:
            break
        known = seen[-1]
        got = seen[after] > seen[before]
        done[open_] |= got
        if step % 8 == 0:
            keep = ~got
            open_, before, after = open_[keep], before[keep], after[keep]
    return order, ~done


def repeated_windows(segments: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment the offsets of its windows that also start at another place.

    ``owners`` and ``starts`` say in which document and where each segment lies;
    segments of one document may overlap.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    total = int(sizes.sum()) + len(segments)
    text = np.empty(total, np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    mask = np.ones(total, bool)
    mask[ends - 1] = False
    text[mask] = np.frombuffer(b"".join(segments), np.uint8)
    text[ends - 1] = 256 + np.arange(len(segments))  # each segment ends in a symbol of its own
    order, same = long_prefixes(text, length)
    run = np.cumsum(~same) - 1
    of = np.searchsorted(ends, order, "right")
    place = owners[of] * (1 << 34) + starts[of] + (order - begins[of])
    heads = np.flatnonzero(~same)
    several = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
    hit = several[run]
    found, where = of[hit], (order - begins[of])[hit]
    by = np.lexsort((where, found))
    found, where = found[by], where[by]
    cuts = np.searchsorted(found, np.arange(len(segments) + 1))
    return [where[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _runs(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows' offsets, sorted, as joined spans."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(offsets, cut)]


SPANS = "doc_id long, h long, start int, end int"
_SPANS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _transform_group(length: int):
    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "h": [], "start": [], "end": []}
        t = table.to_pydict()
        names: dict = {}
        owners = np.array([names.setdefault(x, len(names)) for x in zip(t["doc_id"], t["h"], strict=True)], np.int64)
        starts = np.array(t["start"], np.int64)
        for i, offsets in enumerate(repeated_windows(t["bytes"], owners, starts, length)):
            for a, z in _runs(offsets, length):
                for c, v in zip(out, (t["doc_id"][i], t["h"][i], t["start"][i] + a, t["start"][i] + z), strict=True):
                    out[c].append(v)
        return pa.Table.from_pydict(out, schema=_SPANS)

    return run


def _halve(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the hot grams' repeated windows. ``rows``: g, doc_id, h, at, start, bytes, n."""
    reach = length - gram_size(length)
    size = 1
    while size <= reach:
        size *= 2
    # a window is named by its start relative to the anchor: -reach to 0
    state = rows.select(
        "g", "doc_id", "h", "at", "start", "bytes", (F.col("n") < 2).alias("open"), F.lit(-size + 1).alias("x"),
        (F.col("start") - F.col("at")).alias("lo"), (F.col("start") - F.col("at") + F.length("bytes") - length).alias("hi"),
    )
    found = None
    while True:
        state = state.where((F.col("x") <= F.col("hi")) & (F.col("x") + size - 1 >= F.col("lo")))
        whole = (F.col("x") >= F.col("lo")) & (F.col("x") + size - 1 <= F.col("hi"))
        at = F.col("x") - F.col("lo")
        core_len = max(0, length - size + 1)
        state = state.withColumn("whole", whole)
        state = state.withColumn("span", F.when(whole, F.xxhash64(F.substring("bytes", at + 1, F.lit(length + size - 1)))))
        state = state.withColumn("core", F.xxhash64(F.substring("bytes", at + size, F.lit(core_len))) if core_len else F.lit(None).cast("long"))
        state = written(state, "halving")
        spans = state.where("whole").groupBy("g", "x", "span").agg(F.count(F.lit(1)).alias("ns"), F.min(F.struct("open", "doc_id", "h", "at")).alias("first"))
        cores = state.where("core is not null").groupBy("g", "x", "core").agg(F.count(F.lit(1)).alias("nc"))
        now = written(state.join(spans, ["g", "x", "span"], "left").join(cores, ["g", "x", "core"], "left"), "halving-counts")
        twice = F.coalesce(F.col("ns") > 1, F.lit(False))
        hits = now.where(F.col("open") & twice).select("doc_id", "h", (F.col("at") + F.col("x")).cast("int").alias("start"), (F.col("at") + F.col("x") + size - 1 + length).cast("int").alias("end"))
        found = hits if found is None else found.unionByName(hits)
        if size == 1:
            return found
        # one row stands in for the rows of a repeated span; a core that occurs once ends here
        mine = F.struct("open", "doc_id", "h", "at").eqNullSafe(F.col("first"))
        alone = F.coalesce(F.col("nc") == 1, F.lit(False))
        go = now.where(~alone & (~twice | mine)).withColumn("open", F.col("open") & ~twice)
        half = size // 2
        state = go.select("g", "doc_id", "h", "at", "start", "bytes", "open", F.explode(F.array(F.col("x"), F.col("x") + half)).alias("x"), "lo", "hi")
        size = half


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = TEXT, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    A byte is removed if a string of ``length`` bytes covers it that also
    starts elsewhere, in the same text or another. Texts are UTF-8 bytes; a
    null text is empty. Repeated rows are texts of their own, so each of them
    repeats the other. Null ids keep their rows. An empty table gives an empty
    result. Only the two named columns are read.

    A document is named by its id and a 64-bit hash of its text. Whole texts
    shuffle at most twice, and only those with open segments or with spans.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))

    # one pass over the texts; grams that occur once are told apart before anything wide shuffles
    found_ = written(rows.mapInArrow(_occurrences(length, piece), "doc_id long, h long, at int, start int, end int, g long, seg long"), "gram-occurrences")
    repeated = written(found_.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    maybe, _ = bloom.split(found_, F.col("g"), repeated.select("g"), repeated.count())
    places = written(join_groups(maybe, repeated, ["g"], "n").drop("n"), "repeated-grams")

    segments = written(places.groupBy("g", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "at", "start", "end")).alias("one")), "segments")
    alike = join_groups(places, segments.where("n > 1").select("g", "seg", "n"), ["g", "seg"], "n").select("doc_id", "h", "start", "end")

    kinds = segments.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    mixed = segments.join(kinds, "g").select("g", "n", "kinds", "one.doc_id", "one.h", "one.at", "one.start", "one.end")
    wanted = written(mixed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("g", "n", "kinds", "at", "start", "end")).alias("wanted")), "wanted-segments")
    n_wanted = wanted.count()
    maybe, _ = bloom.split(rows, F.xxhash64("doc_id", "h"), wanted.select(F.xxhash64("doc_id", "h").alias("k")), n_wanted)
    found = maybe.join(wanted.withColumnsRenamed({"doc_id": "w_id", "h": "w_h"}), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))

    def fetch(batches):
        for b in batches:
            out: dict[str, list] = {"g": [], "kinds": [], "n": [], "doc_id": [], "h": [], "at": [], "start": [], "bytes": []}
            for doc, h, t, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for p in places:
                    for c, v in zip(out, (p["g"], p["kinds"], p["n"], doc, h, p["at"], p["start"], raw[p["start"] : p["end"]]), strict=True):
                        out[c].append(v)
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds_, strict=True)], names=list(out))

    cuts = written(
        found.select("doc_id", "h", "t", "wanted").mapInArrow(fetch, "g long, kinds long, n long, doc_id long, h long, at int, start int, bytes binary"), "open-segments"
    )
    facts = cuts.agg(F.sum(F.length("bytes")), F.max("kinds")).first()
    spans = alike
    if facts[0]:
        n_texts = max(1, -(-int(facts[0]) // text_bytes))
        texts = cuts.where(F.col("kinds") <= hot).withColumn("text", F.pmod(F.xxhash64("g", F.lit(5)), F.lit(n_texts)))
        by_transform = texts.groupBy("text").applyInArrow(_transform_group(length), SPANS)
        spans = spans.unionByName(by_transform)
        if facts[1] > hot:
            spans = spans.unionByName(_halve(cuts.where(F.col("kinds") > hot), length))
    spans = written(spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeated-spans")

    touched, clean = bloom.split(rows, F.xxhash64("doc_id", "h"), spans.select(F.xxhash64("doc_id", "h").alias("k")), spans.count())
    joined = touched.join(spans.withColumnsRenamed({"doc_id": "s_id", "h": "s_h"}), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")

    def strip(batches):
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for t, found_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                kept, end, n_spans = [], 0, 0
                for s in sorted((x["start"], x["end"]) for x in found_ or ()):
                    if s[0] > end or not n_spans:
                        kept.append(raw[end : s[0]])
                        n_spans += 1
                    end = max(end, s[1])
                kept.append(raw[end:])
                left = b"".join(kept)
                for c, v in zip(out, (len(raw), len(raw) - len(left), n_spans, hashlib.sha256(left).hexdigest()), strict=True):
                    out[c].append(v)
            arrays = [pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *out])

    stripped = joined.select("doc_id", "t", "spans").mapInArrow(strip, RESULT)
    whole = clean.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"))
    return stripped.unionByName(whole)
