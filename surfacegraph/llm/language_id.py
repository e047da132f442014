"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum (max pooling), and a dense layer with softmax
gives the languages. The network is trained in numpy on the driver, on a
bounded sample of labelled windows, and shipped to the executors, which apply
it to every window of every whole text. Prediction needs no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text_tokens
from .workspace import bound_batches, by_bytes

WINDOW = 128
WIDTHS = (2, 4, 6)
FILTERS = 16
EMBED = 8
#: Windows that one call of the network takes.
BATCH = 512
#: A letter is a character of Unicode category L: marks, letter-like numbers and symbols are none.
LETTER = regex.compile(r"\p{L}")
#: Languages up to which their shares are broadcast.
LABELS = 100_000
#: Score from which the network's language counts for more than a label.
SURE = 0.9
#: The largest hash of a row.
TOP = (1 << 63) - 1
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class ByteNet:
    """The network. ``langs`` are its classes, in order."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["d"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs)))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def features(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Pooled filters of the windows ``x`` (n, WINDOW) uint8."""
        p, out = self.p, []
        e = p["emb"][x]
        for w in WIDTHS:
            n, places = len(x), x.shape[1] - w + 1
            cols = np.lib.stride_tricks.as_strided(e, (n, places, w * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
            cols = np.ascontiguousarray(cols)
            z = (cols.reshape(-1, w * EMBED) @ p[f"w{w}"]).reshape(n, places, FILTERS)
            if keep is not None:
                at = z.argmax(1)
                keep[w] = (at, np.take_along_axis(cols, at.reshape(n, -1, 1), 1))
            out.append(np.maximum(z.max(1) + p[f"b{w}"], 0))
        return np.concatenate(out, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.features(x) @ self.p["d"] + self.p["b"])

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        keep: dict = {}
        f = self.features(x, keep)
        prob = softmax(f @ self.p["d"] + self.p["b"])
        prob[np.arange(len(y)), y] -= 1
        prob /= len(y)
        g = {"d": f.T @ prob, "b": prob.sum(0), "emb": np.zeros_like(self.p["emb"])}
        back = (prob @ self.p["d"].T) * (f > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            at, cols = keep[w]
            g[f"w{w}"] = np.einsum("nf,nfc->cf", d, cols)
            g[f"b{w}"] = d.sum(0)
            to = (d[:, :, None] * self.p[f"w{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            where = np.take_along_axis(x[:, None, :], at[:, :, None] + np.arange(w), 2)
            np.add.at(g["emb"], where.ravel(), to.reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 11) -> ByteNet:
        """Adam over all windows; the same data give the same network."""
        rng, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick, t = order[at : at + batch], t + 1
                step = rate * (1 - epoch / epochs)
                for k, g in self.step(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean probability) of whole texts; ``und`` without a letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        total = np.zeros((len(texts), len(self.langs)))
        rows, weights, owners, held = [], [], [], 0

        def flush():
            nonlocal rows, weights, owners, held
            if held:
                x, wt, own = np.concatenate(rows), np.concatenate(weights), np.concatenate(owners)
                for at in range(0, len(x), BATCH):
                    np.add.at(total, own[at : at + BATCH], self.probabilities(x[at : at + BATCH]) * wt[at : at + BATCH, None])
            rows, weights, owners, held = [], [], [], 0

        named = []
        for i, text in enumerate(texts):
            if not text or not LETTER.search(text):
                continue
            named.append(i)
            x, n = windows(text.encode("utf-8", "surrogatepass"))
            rows.append(x)
            weights.append(n)
            owners.append(np.full(len(x), i))
            held += len(x)
            if held >= 8 * BATCH:
                flush()
        flush()
        for i in named:
            mean = total[i] / total[i].sum()
            k = int(mean.argmax())
            out[i] = (self.langs[k], float(min(1.0, mean[k])))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zeros, and their lengths."""
    n = -(-len(raw) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), sizes


def held_out(id_col: Column, fold: int = 5) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by ``fold``; so is a row without an id."""
    return F.coalesce(F.crc32(id_col.cast("long").cast("string").cast("binary")) % fold == 0, F.lit(True))


def train(
    docs: DataFrame,
    per_language: int = 400,
    per_document: int = 5,
    most_documents: int = 40_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> ByteNet:
    """A network for every language of the labelled rows outside the held-out fold.

    Learns from ``per_language`` documents a language (all, of a rarer one),
    those with the least hashes, and ``per_document`` windows of each: a
    bounded sample. With very many languages each gives fewer documents, one
    at least, so that about ``most_documents`` are enough; no language is left
    out, however rare or common. Rows with a null id, text or language take no
    part; without any, the network has no classes and predicts ``und``.
    """
    spark = docs.sparkSession
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.where(~held_out(F.col(id_col)) & text.isNotNull() & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row a language, as the network has
    if not counts:
        return ByteNet([])
    per = max(1, min(per_language, most_documents // len(counts)))
    # twice as many and some more pass a first cut by hash, of which the least are taken
    upto = spark.createDataFrame([(r["lang"], min(TOP, TOP * (2 * per + 30) // r["count"])) for r in counts], "k_lang string, upto long")
    hashed = rows.select(key.alias("k"), F.col(lang_col).alias("lang"), text.alias("t"), F.shiftrightunsigned(F.xxhash64(key, text, F.lit(7)), 1).alias("u"))
    # a row a language: texts must not shuffle to meet it
    upto = F.broadcast(upto) if len(counts) <= LABELS else upto
    passed = hashed.join(upto, (F.col("lang") == F.col("k_lang")) & (F.col("u") <= F.col("upto")))
    cut = [
        F.substring("t", F.pmod(F.xxhash64("k", F.lit(i)), F.greatest(F.lit(1), F.length("t") - WINDOW)).cast("int") + 1, F.lit(WINDOW))
        for i in range(per_document)
    ]
    cuts = passed.select("k", "lang", "u", F.array(*cut).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "k", "cut"))
    sample = cuts.withColumn("rank", rank).where(F.col("rank") <= per).select("k", "lang", "cut").collect()
    langs = sorted({r["lang"] for r in sample})
    x, y = [], []
    for r in sorted(sample, key=lambda r: (r["k"], r["lang"], r["cut"])):
        for piece in dict.fromkeys(r["cut"]):
            raw = piece.encode("utf-8", "surrogatepass")[:WINDOW]
            x.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
            y.append(langs.index(r["lang"]))
    return ByteNet(langs).fit(np.array(x), np.array(y))


def identify(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, from its whole text.

    ``und`` with score 0 where the text is null or has no letter. Repeated
    rows and null ids keep a row each; no column but the two named is read.
    Of equal scores the language first in order counts. An empty table gives
    an empty result.
    """
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the network

    def run(batches):
        text_tokens.release()
        model = shipped.value
        for b in by_bytes(batches, 2):
            got = model.predict(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, net: ByteNet, least: float = 0.5, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows whose language the network names with a score of at least ``least``, unchanged but for ``lang_col``.

    Null texts and texts without a letter go, whatever ``least``. Rows decide by
    their text alone, so repeated rows stay or go together, and a score of
    ``least`` itself stays. An empty table stays empty.

    ``lang_col`` is a column of labels: the network's name replaces null ones,
    and those that it contradicts (:func:`named`). Without it labels stay.
    """
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)
    label = None if lang_col is None else docs.columns.index(lang_col)

    def run(batches):
        text_tokens.release()
        model = shipped.value
        for b in by_bytes(batches, at):
            texts = b.column(at).to_pylist()
            got = model.predict(texts)
            if label is not None:
                langs = [named(model, *row) for row in zip(texts, b.column(label).to_pylist(), got, strict=True)]
                b = b.set_column(label, b.schema.field(label), pa.array(langs, b.schema.field(label).type))
            yield b.filter(pa.array([g[0] != "und" and g[1] >= least for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def named(net: ByteNet, text: str | None, label: str | None, got: tuple[str, float]) -> str | None:
    """The language of a text with a label, of which the network says ``got``.

    A label stays, unless the network knows that language and yet names another
    with a score of at least ``SURE``, of a text that fills a window.
    """
    lang, score = got
    if lang == "und":
        return label
    if label is None:
        return lang
    sure = lang != label and score >= SURE and label in net.langs and len(text.encode("utf-8", "surrogatepass")) >= WINDOW
    return lang if sure else label
