"""Language identification with a byte convolutional network in numpy.

Bytes are embedded; filters of several widths run over them; each filter's
largest response in a window is kept, and a softmax layer reads these. The
network is trained with Adam on the driver, on windows from a bounded sample
of labelled texts, and applied to every fixed-length window of every text; a
text's prediction is the mean of its windows' probabilities, by window length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
PREDICTED = "lang_pred string, score double"


@dataclass
class ByteNet:
    """Weights. A narrower filter is a wide one whose last places are zero, so one product serves all."""

    labels: list[str]
    embed: np.ndarray  # 256 x d
    filters: np.ndarray  # (width * d) x F
    mask: np.ndarray  # like filters: 1 where a filter has a place
    bias: np.ndarray  # F
    out: np.ndarray  # F x labels
    out_bias: np.ndarray

    @property
    def width(self) -> int:
        return self.filters.shape[0] // self.embed.shape[1]

    def unfold(self, windows: np.ndarray) -> np.ndarray:
        """(rows * places) x (width * d) of byte windows."""
        rows, n = windows.shape
        places = n - self.width + 1
        e = self.embed[windows]
        return np.concatenate([e[:, j : j + places] for j in range(self.width)], axis=2).reshape(rows * places, -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        hidden = self.unfold(windows) @ self.filters
        return np.maximum(hidden.reshape(len(windows), -1, self.filters.shape[1]).max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def new_net(labels: list[str], d: int = 8, widths: tuple[int, ...] = (2, 3, 4), each: int = 12, seed: int = 5) -> ByteNet:
    rng = np.random.default_rng(seed)
    widest, count = max(widths), each * len(widths)
    mask = np.zeros((widest * d, count), np.float32)
    for i, w in enumerate(widths):
        mask[: w * d, i * each : (i + 1) * each] = 1
    draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    return ByteNet(
        labels, draw(256, d) * 0.5, draw(widest * d, count) * mask / np.sqrt(widest * d), mask,
        np.zeros(count, np.float32), draw(count, len(labels)) / np.sqrt(count), np.zeros(len(labels), np.float32),
    )


def train(texts: list[bytes], targets: np.ndarray, labels: list[str], *, window: int = 192, steps: int = 300, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Fit a network by ``steps`` batches of windows at random places of the texts."""
    net = new_net(labels, seed=seed)
    rng = np.random.default_rng(seed)
    weight = 1 / np.maximum(np.bincount(targets, minlength=len(labels)), 1)
    chance = weight[targets] / weight[targets].sum()
    names = ("embed", "filters", "bias", "out", "out_bias")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = rng.choice(len(texts), batch, p=chance)
        windows = np.zeros((batch, window), np.uint8)
        for row, i in enumerate(chosen):
            text = texts[i]
            # short windows too, so that short texts are known ground
            size = int(rng.choice((window, window // 2, window // 6)))
            at = int(rng.integers(0, max(1, len(text) - size + 1)))
            part = np.frombuffer(text[at : at + size], np.uint8)
            windows[row, : len(part)] = part
        flat = net.unfold(windows)
        hidden = (flat @ net.filters).reshape(batch, -1, net.filters.shape[1])
        best = hidden.argmax(1)
        peak = np.take_along_axis(hidden, best[:, None, :], 1)[:, 0] + net.bias
        pooled = np.maximum(peak, 0)
        z = pooled @ net.out + net.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(batch), targets[chosen]] -= 1
        z /= batch
        grads = {"out": pooled.T @ z, "out_bias": z.sum(0)}
        back = (z @ net.out.T) * (peak > 0)
        grads["bias"] = back.sum(0)
        places = hidden.shape[1]
        rows = (np.arange(batch)[:, None] * places + best).astype(np.int64)
        picked = flat[rows.ravel()].reshape(batch, -1, flat.shape[1])
        grads["filters"] = np.einsum("bfk,bf->kf", picked, back, optimize=True) * net.mask
        d = net.embed.shape[1]
        down = (back[:, :, None] * net.filters.T[None]).reshape(batch, -1, net.width, d)
        at = best[:, :, None] + np.arange(net.width)
        grads["embed"] = np.zeros_like(net.embed)
        np.add.at(grads["embed"], windows[np.arange(batch)[:, None, None], at], down)
        for n in names:
            g = grads[n].astype(np.float32)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            now = rate * (0.1 ** (step / steps))
            getattr(net, n)[...] -= now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, *, per_label: int = 300, piece: int = 2048, labels: int = 200, **options) -> ByteNet:
    """Train on about ``per_label`` labelled texts of each language.

    Only text and non-null lang of rows that aren't ``held_out`` are used; a
    row without doc_id isn't held out. A text belongs to the sample by a hash
    of it, at the rate that yields ``per_label`` texts of its language, and
    gives at most two pieces of ``piece`` characters, from its start and from
    its middle. At most ``labels`` languages are learned, most frequent first
    (ties by name). So the driver holds at most about per_label * labels * 2
    * piece characters, whatever the corpus.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).collect()
    if not counts:
        return new_net([UNKNOWN])
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.2 * per_label / r["count"])))])
    share = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    half = F.greatest(F.floor(F.length("text") / 2), F.lit(0)).cast("int")
    sample = rows.where(share < rate[F.col("lang")]).select(
        "lang", F.substring("text", 1, piece).alias("a"),
        F.when(F.length("text") > piece, F.substr("text", half + 1, F.lit(piece))).alias("b"), share.alias("s"),
    )
    got = sample.limit(2 * per_label * len(counts)).toPandas().sort_values(["lang", "s", "a"])
    names = sorted(set(got["lang"]))
    texts, targets = [], []
    for lang, own in got.groupby("lang", sort=True):
        for a, b in zip(own["a"][:per_label], own["b"][:per_label], strict=True):
            for piece_text in (a, b):
                if piece_text:
                    texts.append(piece_text.encode())
                    targets.append(names.index(lang))
    return train(texts, np.array(targets), names, **options) if texts else new_net([UNKNOWN])


def _predictor(net: ByteNet, window: int, chunk: int = 64):
    """Labels and scores of a batch of texts, window by window, ``chunk`` windows at a time."""

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        sums = np.zeros((len(texts), len(net.labels)))
        known = [t is not None and LETTER.search(t) is not None for t in texts]
        owners: list[int] = []
        pieces: list[bytes] = []

        def drain() -> None:
            block = np.zeros((len(pieces), window), np.uint8)
            for i, p in enumerate(pieces):
                block[i, : len(p)] = np.frombuffer(p, np.uint8)
            weight = np.array([len(p) for p in pieces], np.float64)
            np.add.at(sums, owners, net.probabilities(block) * weight[:, None])
            owners.clear()
            pieces.clear()

        for row, text in enumerate(texts):
            if not known[row]:
                continue
            data = text.encode()
            for at in range(0, len(data), window):
                owners.append(row)
                pieces.append(data[at : at + window])
                if len(pieces) == chunk:
                    drain()
        if pieces:
            drain()
        total = np.maximum(sums.sum(1, keepdims=True), 1e-30)
        mean = sums / total
        top = mean.argmax(1)
        return (
            [net.labels[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)],
            [float(mean[i, t]) if k else 0.0 for i, (t, k) in enumerate(zip(top, known, strict=True))],
        )

    return predict


def predict(documents: DataFrame, net: ByteNet, *, window: int = 192, text: str = "text", keep: tuple[str, ...] = ("doc_id",), carry: str | None = None) -> DataFrame:
    """The ``keep`` columns with lang_pred and score of every text; ``carry`` names one of them that is the text itself.

    lang_pred is a learned language, ``und`` with score 0 where the text is
    null or has no letter; score is the mean probability of lang_pred over the
    windows of the whole text. Only the text enters a prediction.
    """
    source = carry or "__text"
    rows = documents.select(*keep, *([] if carry else [F.col(text).cast("string").alias(source)]))
    spec = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema], PREDICTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = _predictor(net, window)
        for batch in batches:
            label, score = [], []
            texts = batch.column(source)
            for at in range(0, len(texts), 256):
                a, b = guess(texts.slice(at, 256).to_pylist())
                label += a
                score += b
            columns = [batch.column(c) for c in keep] + [pa.array(label, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, spec)


def language_id(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; see ``fit`` and ``predict``.

    Repeated rows are predicted each, rows without doc_id too; extra columns
    are ignored. An empty table gives an empty result. Without any labelled
    text every prediction is ``und``.
    """
    docs = documents.select("doc_id", "text", "lang")
    found = predict(docs, fit(docs, **options))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
