"""Language of texts by a byte convolutional network.

Filters of several widths run over the bytes of a window of fixed length, each
keeps its largest response, and a softmax layer reads these. On bytes a filter
is a table, so a response is a sum of table rows; pairs of neighbouring bytes
share one lookup. Training is plain numpy with Adam on a bounded sample of
labelled windows; prediction covers every window of every text.

With `noise` the network learns one more class, texts in none of the languages: crops with
shuffled bytes, with exchanged letters, or moved to another script. Its label is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .words import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
CERTAIN, ODDS = 0.9, 1000.0  # the noise class needs this score, and these odds when each 100 letters count as one trial
_PAD = 32
_REACH = max(WIDTHS) - 1  # padding behind a window, so that every byte starts a filter


class ByteNetwork:
    """Filters as tables (width, 256, filters), one dense layer, labels."""

    def __init__(self, labels: list[str], filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.filters = labels, filters
        self.noise = None  # which label is the noise class
        self.tables = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(filters * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.1, (filters * len(WIDTHS), len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def prepare(self) -> None:
        """Tables of byte pairs: all filters at their first two bytes, the longer ones behind them."""
        first = [t[0][:, None, :] + t[1][None, :, :] for t in self.tables]
        self._front = (np.concatenate(first, axis=2) + self.bias).reshape(65536, -1)
        w3, w4 = self.tables[1], self.tables[2]
        self._back = np.concatenate(
            [np.broadcast_to(w3[2][:, None, :], (256, 256, self.filters)),
             w4[2][:, None, :] + w4[3][None, :, :]], axis=2).reshape(65536, -1).copy()

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, all filters) for windows of WINDOW + _REACH bytes."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = self._front[pair[:, :WINDOW]]
        out[:, :, self.filters:] += self._back[pair[:, 2:WINDOW + 2]]
        return out

    def log_probabilities(self, x: np.ndarray, run: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), run):
            pooled = np.maximum(self.responses(x[at:at + run]).max(axis=1), 0)
            out[at:at + run] = _log_softmax(pooled @ self.dense + self.shift)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64,
              rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy; the gradient of a maximum goes to the place that won."""
        rng = np.random.default_rng(seed)
        parameters = [*self.tables, self.bias, self.dense, self.shift]
        mean = [np.zeros_like(p) for p in parameters]
        square = [np.zeros_like(p) for p in parameters]
        step, f = 0, self.filters
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                rows, labels = x[some], y[some]
                response = self._by_byte(rows)
                place = response.argmax(axis=1)
                top = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0]
                pooled = np.maximum(top, 0)
                error = np.exp(_log_softmax(pooled @ self.dense + self.shift))
                error[np.arange(len(some)), labels] -= 1
                error /= len(some)
                back = (error @ self.dense.T) * (top > 0)
                gradients = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[i])
                    own = slice(i * f, (i + 1) * f)
                    for k in range(w):
                        byte = np.take_along_axis(rows, place[:, own] + k, axis=1)
                        np.add.at(g[k], (byte, np.arange(f)[None, :]), back[:, own])
                    gradients.append(g)
                gradients += [back.sum(axis=0), pooled.T @ error, error.sum(axis=0)]
                step += 1
                for p, g, m, s in zip(parameters, gradients, mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-7)

    def _by_byte(self, x: np.ndarray) -> np.ndarray:
        """The responses while the tables change: summed byte by byte."""
        return np.concatenate([sum(t[k][x[:, k:k + WINDOW]] for k in range(w))
                               for w, t in zip(WIDTHS, self.tables)], axis=2) + self.bias


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the letters in each, and how many windows each text has (one at least)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    n = np.array([max(1, -(-len(r) // WINDOW)) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(r.ljust(k * WINDOW) for r, k in zip(raw, n.tolist())), np.uint8)
    x = np.full((int(n.sum()), WINDOW + _REACH), _PAD, np.uint8)
    x[:, :WINDOW] = data.reshape(-1, WINDOW)
    letters = ((x >= 97) & (x <= 122) | (x >= 128)).sum(axis=1)
    return x, letters, n


def predict_texts(model: ByteNetwork, texts: list[str]) -> tuple[list[str], list[float]]:
    """Label and score of each text: windows vote with their log probabilities, by their letters."""
    x, letters, n = windows(texts)
    weight = (letters + 1e-3)[:, None]
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    total = np.add.reduceat(model.log_probabilities(x) * weight, at, axis=0)
    p = np.exp(_log_softmax(total / np.add.reduceat(weight, at, axis=0)))
    ranked = p.copy()
    if model.noise is not None:
        own = p[:, model.noise]
        odds = np.log(np.maximum(own, 1e-9) / np.maximum(1 - own, 1e-9))
        sure = (own >= CERTAIN) & (odds * np.add.reduceat(letters, at) / 100 >= np.log(ODDS))
        ranked[~sure, model.noise] = -1
    best = ranked.argmax(axis=1)
    return [model.labels[b] for b in best], p[np.arange(len(p)), best].astype(float).tolist()


def in_no_language(crop: str, kind: int, rng: np.random.Generator) -> bytes:
    """A lower-case crop made foreign: bytes shuffled (0), a to z exchanged (1), letters moved to another script (2)."""
    if kind == 0:
        return rng.permutation(np.frombuffer(crop.encode("utf-8", "surrogatepass"), np.uint8)).tobytes()
    if kind == 1:
        names = list(range(ord("a"), ord("z") + 1))
        return crop.translate(dict(zip(names, rng.permutation(names).tolist()))).encode("utf-8", "surrogatepass")
    block = int(rng.integers(0x370, 0xD000))
    moved = {ord(c): block + int(rng.integers(0, 64)) for c in sorted(set(crop)) if c.isalpha()}
    return crop.translate(moved).encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    """Rows never learned from: crc32 of the id's text, modulo 4, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        texts_per_label: int = 1000, crops_per_text: int = 4,
        most_labels: int = 1000, noise: bool = False) -> ByteNetwork | None:
    """Train on at most `texts_per_label` texts of each label, `crops_per_text` crops of each.

    The texts are those of the smallest hashes (of id and text) among the rows with text and
    label that are not held out, so the sample is the same however the table is
    cut. Labels are counted first; only rows whose hash lies below about twice
    the wanted share of their label are ranked, so no task gets a whole label.
    Crops spread over the whole text; some are shortened, so that short texts
    are known too. With `noise` there are up to three more crops per text of the
    average label, made foreign in one of three ways. None if no row has a label; more than `most_labels` labels
    are an error, so tables of one row per label may be broadcast.
    """
    known = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(label_col).cast("string").alias("label"))
             .where(F.col("text").isNotNull() & F.col("label").isNotNull()
                    & ~held_out("id")).withColumn("order", F.xxhash64("id", "text")))
    by_hash = Window.partitionBy("label").orderBy("order")
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("all")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    if not counts:
        return None
    counts = F.broadcast(df.sparkSession.createDataFrame(counts, "label string, all long"))
    low = (F.col("order") / float(1 << 64) + 0.5) * F.col("all") < 2.0 * texts_per_label + 50
    last = (known.select("label", "order").join(counts, "label").where(low)
            .withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= texts_per_label)
            .groupBy("label").agg(F.max("order").alias("last")))
    spare = F.greatest(F.length("text") - WINDOW, F.lit(0))
    crops = F.transform(F.sequence(F.lit(0), F.lit(crops_per_text - 1)), lambda i: F.substring(
        F.col("text"), (F.floor(spare * i / F.lit(max(1, crops_per_text - 1))) + 1).cast("int"),
        F.lit(WINDOW)))
    sample = (known.join(F.broadcast(last), "label").where(F.col("order") <= F.col("last"))
              .select("label", "order", crops.alias("crops"))
              .withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= texts_per_label)
              .select("label", "crops").collect())
    sample = sorted((r["label"], r["crops"]) for r in sample)
    labels = sorted({label for label, _ in sample})
    if not labels:
        return None
    rng = np.random.default_rng(3)
    texts, y = [], []
    for label, parts in sample:
        for part in parts:
            if not has_letter(part):
                continue
            if rng.random() < 0.5:
                part = part[:int(rng.integers(8, WINDOW + 1))]
            if has_letter(part):
                part = part.lower()
                texts.append(part.encode("utf-8", "surrogatepass")[:WINDOW])
                y.append(labels.index(label))
                if noise and rng.random() < 3 / len(labels):
                    texts.append(in_no_language(part, int(rng.integers(3)), rng)[:WINDOW])
                    y.append(len(labels))
    if not texts:
        return None
    x = np.full((len(texts), WINDOW + _REACH), _PAD, np.uint8)
    for i, t in enumerate(texts):
        x[i, :len(t)] = np.frombuffer(t, np.uint8)
    model = ByteNetwork([*labels, UNKNOWN] if noise else labels)
    model.noise = len(labels) if noise else None
    model.train(x, np.array(y))
    return model


def predict(df: DataFrame, model: ByteNetwork | None, text_col: str = "text",
            label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns, and the predicted label and its score (0 to 1) of every whole text.

    A null text or one without letters is `und` with score 0; so is every text
    when there was nothing to learn from. A model with a noise class says `und` where that
    class is certain, which takes the more of a score the fewer letters there are; else the
    likeliest language. Columns named like the results are
    replaced.
    """
    rows = df.drop(label, score)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema),
                        f"`{label}` string, `{score}` double"])
    at = rows.columns.index(text_col)

    def run(batches):
        if model is not None:
            model.prepare()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for part in slices(texts, 2 << 20):
                own = [i for i in range(part.start, part.stop) if has_letter(texts[i])]
                if model is None or not own:
                    continue
                for i, name, p in zip(own, *predict_texts(model, [texts[i] for i in own])):
                    labels[i], scores[i] = name, p
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, label, score])

    return rows.mapInArrow(run, schema)
