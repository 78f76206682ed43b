"""Language of documents by a convolutional network over bytes.

Texts are lower-cased and cut into windows of ``WINDOW`` bytes, the last one padded. A
byte has an embedding; filters of several widths slide over the window, each
filter's largest response is kept, and a softmax layer gives the languages. All
windows of a text are read; their log probabilities are added, weighted by the letters
in them. The network is trained in numpy on a bounded sample: about
``PER_LANGUAGE`` documents of each language, chosen by a hash of doc_id, and
``WINDOWS`` windows of each.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null lang
isn't learned from; without learning rows every document is ``und``; rows with
equal doc_id are predicted each; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import slices
from packetcheck.llm.quality import is_held_out

WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 600
WINDOWS = 3
EPOCHS = 12
UNKNOWN = "und"
_SEED = 7


class ByteNetwork:
    """Embedding, filters of the given widths, maximum over places, softmax."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(_SEED)
        self.languages = languages
        reach, out = max(WIDTHS), FILTERS * len(WIDTHS)
        self.reach = reach
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0
        # one matrix for all widths; a narrow filter has zeros behind its width
        self.open = np.zeros((reach * EMBEDDING, out), dtype=np.float32)
        for k, width in enumerate(WIDTHS):
            self.open[:width * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 0.3, self.open.shape) * self.open).astype(np.float32)
        self.bias = np.zeros(out, dtype=np.float32)
        self.weights = rng.normal(0, 0.2, (out, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), dtype=np.float32)

    def places(self, windows: np.ndarray) -> np.ndarray:
        """Bytes under the filters at each place, which is every byte: windows x places x reach."""
        padded = np.pad(windows, ((0, 0), (0, self.reach - 1)))
        return np.lib.stride_tricks.sliding_window_view(padded, self.reach, axis=1)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        under = self.places(windows)
        n, places, _ = under.shape
        seen = self.embedding[under].reshape(n * places, -1)
        response = (seen @ self.filters).reshape(n, places, -1)
        return under, seen, response

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """A row per window, a column per language."""
        top = self.pooled(windows)[2].max(axis=1) + self.bias
        z = np.maximum(top, 0) @ self.weights + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by name of what it is taken with respect to."""
        under, seen, response = self.pooled(windows)
        best = response.argmax(axis=1)
        top = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        z = hidden @ self.weights + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(windows)), labels] -= 1
        z /= len(windows)
        grad = {"weights": hidden.T @ z, "offset": z.sum(axis=0)}
        back = (z @ self.weights.T) * (top > 0)
        grad["bias"] = back.sum(axis=0)
        n, places = under.shape[:2]
        rows = (np.arange(n)[:, None] * places + best)
        grad["filters"] = np.einsum("nfe,nf->ef", seen[rows], back) * self.open
        onto = np.einsum("nf,ef->nfe", back, self.filters).reshape(-1, EMBEDDING)
        bytes_under = under.reshape(n * places, -1)[rows].reshape(-1)
        grad["embedding"] = np.zeros_like(self.embedding)
        np.add.at(grad["embedding"], bytes_under, onto)
        grad["embedding"][0] = 0
        return grad

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64) -> None:
        """Adam on the mean cross-entropy."""
        rng = np.random.default_rng(_SEED)
        names = ("embedding", "filters", "bias", "weights", "offset")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                grad = self.gradients(windows[pick], labels[pick])
                step += 1
                for k in names:
                    first[k] += 0.1 * (grad[k] - first[k])
                    second[k] += 0.001 * (grad[k] ** 2 - second[k])
                    moved = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                    setattr(self, k, getattr(self, k) - np.float32(rate) * moved.astype(np.float32))


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, and the text each belongs to."""
    counts = np.array([-(-len(x) // WINDOW) for x in texts], dtype=np.int64)
    padded = b"".join(x + bytes(-len(x) % WINDOW) for x in texts)
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


def _letters(windows: np.ndarray) -> np.ndarray:
    return ((windows >= 97) & (windows <= 122) | (windows >= 128)).sum(axis=1)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(lang, window) of about ``per_language`` learning rows of each language and
    ``WINDOWS`` places in each text; nothing else of the table reaches the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    # one row per language that the table names; the texts are filtered where they are
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, per_language / n)))[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "lang"), F.lit(1 << 40)) / (1 << 40)
    length = F.char_length("text")
    places = [F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(k)), F.greatest(F.lit(1), length - WINDOW + 1)) for k in range(WINDOWS)]
    pieces = F.explode(F.array(*(F.substr("text", p.cast("int") + 1, F.lit(WINDOW)) for p in places)))
    chosen = rows.where((drawn < share) & (length > 0)).select("lang", pieces.alias("piece"))
    return [(r["lang"], r["piece"]) for r in chosen.orderBy(F.xxhash64("piece"), "lang", "piece").collect()]


def learn(examples: list[tuple[str, str]]) -> ByteNetwork | None:
    """Network trained on (lang, text) pairs, a window of each; None without any."""
    languages = sorted({x for x, _ in examples})
    if not languages:
        return None
    rng = np.random.default_rng(_SEED)
    windows, labels = [], []
    for lang, text in examples:
        own = np.frombuffer(text.lower().encode()[:WINDOW], dtype=np.uint8)
        if rng.random() < 0.2:
            # short texts have to be told apart too
            own = own[:int(rng.integers(min(20, len(own)), len(own) + 1))]
        windows.append(np.pad(own, (0, WINDOW - len(own))))
        labels.append(languages.index(lang))
    network = ByteNetwork(languages)
    network.train(np.array(windows), np.array(labels))
    return network


def predict(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").fill_null("").to_pylist()
            lettered = [any(map(str.isalpha, x)) for x in texts]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if network is not None and any(lettered):
                own = np.flatnonzero(lettered)
                windows, text = cut_windows([texts[k].lower().encode() for k in own])
                total = np.zeros((len(own), len(network.languages)))
                weight = np.zeros(len(own))
                for at in range(0, len(windows), 64):
                    part = windows[at:at + 64]
                    letters = _letters(part) + 1e-3
                    np.add.at(total, text[at:at + 64], network.log_probabilities(part) * letters[:, None])
                    np.add.at(weight, text[at:at + 64], letters)
                mean = np.exp(total / weight[:, None])
                mean /= mean.sum(axis=1, keepdims=True)
                best = mean.argmax(axis=1)
                for k, b in zip(own, best):
                    langs[k] = network.languages[b]
                scores[own] = mean[np.arange(len(own)), best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """Every document's language, learned from those with a lang that aren't held out."""
    return predict(docs, learn(sample(docs)))
