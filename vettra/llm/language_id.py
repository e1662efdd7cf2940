"""Language identification by a byte convolutional network in numpy.

A text's lower-case bytes are cut into windows of 256. Filters of widths 2, 3 and 4 slide over a window, each keeps its
largest response (max pooling), and a softmax layer turns those into one probability per language. A document's
probabilities are the mean over all of its windows.

A filter over one-hot bytes is a sum of table rows, one table per place. For prediction, tables of neighbouring places
are added up for all byte pairs, so a width-4 filter costs two look-ups.

Training reads a bounded sample: about ``per_language`` documents of each language, ``windows`` evenly spread windows of
each. Prediction reads every window of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.llm.common import arrow_map, columns, texts

LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 16
NO_LANGUAGE = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def cut(text: str) -> np.ndarray:
    """All windows of a text, the last filled up with spaces: (windows, LENGTH)."""
    raw = text.lower().encode()
    n = max(1, -(-len(raw) // LENGTH))
    return np.frombuffer(raw.ljust(n * LENGTH), "u1").reshape(n, LENGTH)


@dataclass
class Network:
    names: list[str]
    tables: dict[int, np.ndarray]  # by width: (place, byte, filter)
    bias: np.ndarray  # of the filters, all widths
    weights: np.ndarray  # (filters of all widths, languages)
    shift: np.ndarray

    def pairs(self) -> dict[int, list[np.ndarray]]:
        """By width: tables over byte pairs (first byte times 256 plus second), and over single bytes where one is left."""
        out = {}
        for width, t in self.tables.items():
            whole = [(t[k][:, None] + t[k + 1][None, :]).reshape(1 << 16, FILTERS) for k in range(0, width - 1, 2)]
            out[width] = whole + ([t[width - 1]] if width % 2 else [])
        return out

    def probabilities(self, windows: np.ndarray, pairs: dict[int, list[np.ndarray]]) -> np.ndarray:
        """(windows, languages)."""
        out = []
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64].astype("i4")
            two = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for width, parts in pairs.items():
                n = LENGTH - width + 1
                places = [(x if width % 2 and k == len(parts) - 1 else two)[:, 2 * k : 2 * k + n] for k in range(len(parts))]
                response = parts[0].take(places[0], axis=0)
                for part, place in zip(parts[1:], places[1:], strict=True):
                    response += part.take(place, axis=0)
                pooled.append(response.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            out.append(softmax(hidden @ self.weights + self.shift))
        return np.concatenate(out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.01) -> Network:
    """Fit by Adam on windows (n, LENGTH) and their languages; rare languages weigh as much as frequent ones."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    weight = (1 / np.bincount(y, minlength=len(names)))[y]
    weight = (weight / weight.mean()).astype("f4")
    rng = np.random.default_rng(7)
    many = FILTERS * len(WIDTHS)
    made = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype("f4") for w in WIDTHS}
    net = Network(names, made, np.zeros(many, "f4"), rng.normal(0, 0.2, (many, len(names))).astype("f4"), np.zeros(len(names), "f4"))
    values = [*net.tables.values(), net.bias, net.weights, net.shift]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            gradients = _gradients(net, windows[some].astype("i8"), y[some], weight[some])
            steps += 1
            for value, g, mean, square in zip(values, gradients, means, squares, strict=True):
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                value -= rate * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.99**steps)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    rows = np.arange(len(y))
    best, pooled = {}, []
    for width, table in net.tables.items():
        n = LENGTH - width + 1
        response = sum(table[k].take(x[:, k : k + n], axis=0) for k in range(width))
        best[width] = response.argmax(axis=1)
        pooled.append(np.take_along_axis(response, best[width][:, None, :], axis=1)[:, 0])
    before = np.concatenate(pooled, axis=1) + net.bias
    hidden = np.maximum(before, 0)
    miss = softmax(hidden @ net.weights + net.shift)
    miss[rows, y] -= 1
    miss *= (weight / len(y))[:, None]
    back = (miss @ net.weights.T) * (before > 0)
    out = []
    for i, (width, table) in enumerate(net.tables.items()):
        g = np.zeros_like(table)
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        for k in range(width):
            np.add.at(g[k], (x[rows[:, None], best[width] + k], np.arange(FILTERS)[None, :]), part)
        out.append(g)
    return [*out, back.sum(axis=0), hidden.T @ miss + 1e-4 * net.weights, miss.sum(axis=0)]


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, folds: int, per_language: int, windows: int) -> tuple[np.ndarray, list[str]]:
    """Training windows and their languages from documents outside fold 0; at most a few KB of each document."""
    rows = columns(docs, doc_id="bigint", text="string", lang="string")
    rows = rows.where((remainder(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return np.zeros((0, LENGTH), "u1"), []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, per_language * 1_000_000 // n + 1))])
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")])

    def run(batch):
        out = {"lang": [], "bytes": []}
        for text, lang in zip(texts(batch), batch.column("lang"), strict=True):
            if has_letter(text):
                all_ = cut(text)
                for k in sorted({(2 * i + 1) * len(all_) // (2 * windows) for i in range(windows)}):
                    out["lang"].append(lang.as_py())
                    out["bytes"].append(all_[k].tobytes())
        return out

    got = arrow_map(some, "lang string, bytes binary", run).toArrow()
    found = np.frombuffer(b"".join(x.as_py() for x in got.column("bytes")), "u1").reshape(-1, LENGTH)
    order = sorted(range(len(found)), key=lambda i: found[i].tobytes())  # the same model whatever order rows arrive in
    langs = got.column("lang").to_pylist()
    return found[order], [langs[i] for i in order]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``und`` with score 0 for null and letterless texts or no network."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred KB; grows with the number of languages only

    def run(batch):
        model = shared.value
        n = batch.num_rows
        langs, scores = [NO_LANGUAGE] * n, [0.0] * n
        pairs = model.pairs() if model is not None else {}
        held, rows, size = [], [], 0

        def flush():
            p = model.probabilities(np.concatenate(held), pairs)
            starts = np.cumsum([0, *map(len, held)])[:-1]
            mean = np.add.reduceat(p, starts, axis=0) / np.array([len(h) for h in held])[:, None]
            for row, m in zip(rows, mean, strict=True):
                langs[row], scores[row] = model.names[int(m.argmax())], float(min(1.0, m.max()))

        for row, text in enumerate(texts(batch)):
            if model is not None and has_letter(text):
                held.append(cut(text))
                rows.append(row)
                size += len(held[-1])
                if size >= 4096:
                    flush()
                    held, rows, size = [], [], 0
        if held:
            flush()
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    return arrow_map(columns(docs, doc_id="bigint", text="string"), "doc_id bigint, lang_pred string, score double", run)


def identify(docs: DataFrame, folds: int = 5, per_language: int = 400, windows: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained outside fold 0 of ``crc32(doc_id) % folds``, applied to every document.

    A null ``doc_id`` is never trained on and counts as held out. Without labelled texts all predictions are ``und``.
    Repeated rows give repeated rows.
    """
    x, y = sample(docs, folds, per_language, windows)
    net = train(x, y) if len(y) else None
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(True))
    return predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
