"""Language identification (5): averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams (2 and 3 bytes) of lower-cased words with a mark
at both ends; each hashes to one of ``BUCKETS`` embeddings, a text is the mean
of its subwords' embeddings, and a linear layer with softmax gives the
languages. Embeddings and layer are trained together by stochastic gradient
descent in numpy on the driver, on at most ``most_rows`` labelled rows, which
reach it as bags of at most ``BUCKETS`` numbers (the documented bound; they are the rows with the smallest hashes of their ids, so
the choice does not depend on partitioning). A part of those rows is held back
to fit a temperature, which calibrates the scores, and the rejection threshold:
the score below which ``reject`` percent of the held-back rows that the model
gets right would fall. For prediction embeddings and layer are multiplied out,
so a text costs one table lookup a subword.

``lang_pred`` is always a learned language, or ``und`` with score 0 for null
texts, texts without a letter and when nothing could be learned; ``rejected``
tells scores under the threshold. Rows are judged one by one, so repeated rows
agree; other columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import U, Words, mix, pieces

BUCKETS, DIM = 1 << 15, 16
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Buckets of all subwords, text by text, and where each text begins (one more at the end)."""
    words = Words(texts, lower=True)
    n = len(words.hash)
    size = words.end - words.start
    # Each word framed by marks: 0, bytes, 0.
    at = np.concatenate([[0], np.cumsum(size + 2)])
    framed = np.zeros(int(at[-1]) + 2, dtype=np.uint64)
    where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    framed[np.repeat(at[:-1] + 1, size) + where] = words.data[np.repeat(words.start, size) + where].astype(U) + U(1)
    total = int(at[-1])
    two = framed[:total] * U(512) + framed[1 : total + 1]
    three = two * U(512) + framed[2 : total + 2]
    place = np.arange(total)
    left = np.repeat(at[1:], size + 2) - place  # symbols of the word from here on
    out = np.empty((total, 2), dtype=np.int64)
    out[:, 0] = (mix(two + U(1 << 40)) >> U(49)).astype(np.int64)
    out[:, 1] = (mix(three + U(2 << 40)) >> U(49)).astype(np.int64)
    fits = np.stack([left >= 2, left >= 3], axis=1)
    first = np.concatenate([[0], np.cumsum(fits.sum(axis=1))])[at[words.first]] if n else np.zeros(len(words.first), dtype=np.int64)
    return out[fits], first, words


class Model:
    """Languages, the table of logits by bucket, the layer's bias, temperature and rejection threshold."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        rng = np.random.default_rng(7)
        self.embedding = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.layer = np.zeros((DIM, len(langs)), dtype=np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)
        self.temperature, self.threshold = 1.0, 0.0
        self.table: np.ndarray | None = None

    def train(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 10, rate: float = 8.0, batch: int = 16, least_steps: int = 800) -> None:
        rng = np.random.default_rng(11)
        per_epoch = -(-len(bags) // batch)
        epochs = max(epochs, -(-least_steps // per_epoch))
        steps = epochs * per_epoch
        done = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                lr = np.float32(rate * (1 - done / steps))
                done += 1
                picked = order[lo : lo + batch]
                ids = np.concatenate([bags[i][0] for i in picked])
                share = np.concatenate([bags[i][1] for i in picked])
                row = np.repeat(np.arange(len(picked)), [len(bags[i][0]) for i in picked])
                mean = np.zeros((len(picked), DIM), dtype=np.float32)
                np.add.at(mean, row, self.embedding[ids] * share[:, None])
                gap = softmax(mean @ self.layer + self.bias)
                gap[np.arange(len(picked)), labels[picked]] -= 1
                gap /= len(picked)
                back = gap @ self.layer.T
                self.layer -= lr * (mean.T @ gap)
                self.bias -= lr * gap.sum(axis=0)
                np.add.at(self.embedding, ids, -lr * back[row] * share[:, None])

    def finish(self) -> None:
        self.table = np.ascontiguousarray(self.embedding @ self.layer)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(first) - 1, len(self.langs)))
        count = np.diff(first)
        some = count > 0
        if len(ids):
            for k in range(len(self.langs)):
                sums[some, k] = np.add.reduceat(self.table[ids, k].astype(np.float64), first[:-1][some])
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, reject: float) -> None:
        if not len(labels):
            return
        loss = lambda t: -np.mean(np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12))
        grid = np.exp(np.linspace(np.log(0.5), np.log(5), 60))
        self.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
        p = softmax(logits / self.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == labels]
        self.threshold = min(0.99, float(np.quantile(right, reject / 100))) if len(right) else 0.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's subwords and their shares: ``BUCKETS`` numbers at most, however long the text."""
    ids, count = np.unique(subwords(pa.array([text], pa.string()))[0], return_counts=True)
    return ids, (count / max(1, count.sum())).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], reject: float = 1.0) -> Model | None:
    """A model from bags and their languages; every fifth row calibrates. None without a labelled row that has a word."""
    rows = [r for r in rows if len(r[0])]
    langs = sorted({r[2] for r in rows})
    if not langs:
        return None
    code = {lang: k for k, lang in enumerate(langs)}
    bags, labels = [r[:2] for r in rows], np.array([code[r[2]] for r in rows])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    model = Model(langs)
    model.train([b for b, h in zip(bags, held, strict=True) if not h], labels[~held])
    model.finish()
    aside = [b for b, h in zip(bags, held, strict=True) if h]
    if aside:
        model.calibrate(np.stack([(model.table[i].astype(np.float64) * share[:, None]).sum(axis=0) + model.bias for i, share in aside]), labels[held], reject)
    model.embedding = None  # the table replaces it
    return model


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 3000) -> DataFrame:
    """``docs`` without text and language, plus ``lang_pred``, ``score`` and ``rejected``. Learns only from rows where ``learn_from`` holds."""
    spark = docs.sparkSession
    chosen = docs.where(learn_from).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).alias("i"))
    chosen = chosen.orderBy("h", "i").limit(most_rows)
    edge = chosen.agg(F.max("h").alias("h")).first()["h"]
    sample = docs.where(learn_from & (F.xxhash64(F.col(id_col).cast("string")) <= F.lit(edge))) if edge is not None else docs.where("false")

    def bags(batches):
        for batch in batches:
            found = [bag_of(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["h", "l", "ids", "shares"])

    sample = sample.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null")
    rows = sample.mapInArrow(bags, "h long, l string, ids binary, shares binary").orderBy("h", "ids", "shares", "l").limit(most_rows).collect()
    model = spark.sparkContext.broadcast(fit([(np.frombuffer(r["ids"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["shares"], dtype=np.float32), r["l"]) for r in rows]))
    rest = [c for c in docs.columns if c not in (text_col, lang_col)]
    added = ["lang_pred", "score", "rejected"]
    kept = [c for c in rest if c not in added]
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        m = model.value
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[-1]):
                texts = piece.column(piece.num_columns - 1)
                n = len(texts)
                pred, score = ["und"] * n, np.zeros(n)
                if m is not None:
                    ids, first, words = subwords(texts)
                    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[words.data])])[words.doc_bytes]
                    some = np.diff(ascii_letters) > 0
                    for i in np.flatnonzero(~some):
                        t = texts[int(i)].as_py()
                        some[i] = bool(t) and any(c.isalpha() for c in t)
                    p = softmax(m.logits(ids, first) / m.temperature)
                    best = p.argmax(axis=1)
                    score = np.where(some, p.max(axis=1), 0.0)
                    pred = [m.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                low = score < (m.threshold if m is not None else 1.0)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], [*kept, *added])

    columns = [F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate([*kept, text_col])]
    return docs.select(*columns).mapInArrow(run, schema)
