"""Quality classifier: gated-attention multiple-instance learning over a document's passages.

A document is a bag of passages of 64 words. A passage's features are counts of byte-class bigrams and four
word statistics; an encoder (linear, tanh) maps them to a vector. Gated attention, tanh(V h) * sigmoid(U h)
projected to a score, weighs the passages, and the weighted sum of their vectors is scored. Labels are of
documents only; the attention learns which passages carry them.

Fitting uses at most ``fit_rows`` labelled documents, the first by a hash of the id, and of each at most
``fit_passages`` passages, evenly spaced over the whole text (a documented, bounded sample, fitted with numpy on the
driver). Few features of a passage are not zero, so the sample comes and stays packed, some 200 bytes a passage of prose
(24 MB for all of it) instead of 2600, and is unpacked a bag at a time. Scoring encodes every passage of every whole text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import HashCache

PASSAGE_WORDS = 64
#: Bytes told apart by themselves; all others go by kind.
OWN_CLASS = b".,!?%$&#*|:;-_/\\\"'()[]{}<>=+@"
_KINDS = 6  # lower, upper, digit, line break, other white space, other ASCII; then two for UTF-8
N_CLASSES = _KINDS + 2 + len(OWN_CLASS)
N_FEATURES = N_CLASSES * N_CLASSES + 4
#: Passages scored together; a document with more is scored by itself.
SCORE_PASSAGES = 4096
#: Characters encoded at once; longer texts are read in slices cut at white space.
SLICE_CHARS = 500_000


def _class_table() -> np.ndarray:
    table = np.full(256, 5, dtype=np.int32)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[10, 13]], table[[9, 11, 12, 32]] = 3, 4
    table[0x80:0xC0], table[0xC0:] = 6, 7
    for i, b in enumerate(OWN_CLASS):
        table[b] = 8 + i
    return table


_CLASS = _class_table()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CACHE = HashCache()


def _slices(text: str) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = at + SLICE_CHARS
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end].encode("utf-8", "replace")
        at = end


def passage_features(text: str | None) -> np.ndarray:
    """One row of features for each passage of a whole text; a text without words is one row of zeros."""
    found = [f for part in _slices(text or "") if len(f := _features(part))]
    return np.concatenate(found) if found else np.zeros((1, N_FEATURES), dtype=np.float32)


def _features(raw: bytes) -> np.ndarray:
    words = raw.split()
    n = len(words)
    if not n:
        return np.empty((0, N_FEATURES), dtype=np.float32)
    passages = -(-n // PASSAGE_WORDS)
    data = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    cuts = starts[::PASSAGE_WORDS].copy()
    cuts[0] = 0
    cls = _CLASS[data]
    out = np.zeros((passages, N_FEATURES), dtype=np.float32)
    pair = cls[:-1] * N_CLASSES + cls[1:]
    lengths = np.diff(np.append(cuts, len(data)))
    where = np.repeat(np.arange(passages, dtype=np.int64), lengths)[: len(pair)]
    counts = np.bincount(where * (N_CLASSES * N_CLASSES) + pair, minlength=passages * N_CLASSES * N_CLASSES)
    out[:, :-4] = np.sqrt(counts.reshape(passages, -1) / np.maximum(lengths, 1)[:, None])
    h = np.zeros(passages * PASSAGE_WORDS, dtype=np.uint64)
    h[:n] = np.fromiter(map(_CACHE.__getitem__, words), dtype=np.uint64, count=n)
    grid = h.reshape(passages, PASSAGE_WORDS)
    held = np.full(passages, PASSAGE_WORDS)
    held[-1] = n - (passages - 1) * PASSAGE_WORDS
    same = ((grid[:, 1:] == grid[:, :-1]) & (grid[:, 1:] != 0)).sum(axis=1)
    ordered = np.sort(grid, axis=1)
    kinds = ((ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] != 0)).sum(axis=1) + (ordered[:, 0] != 0)
    out[:, -4], out[:, -3] = same / held, kinds / held
    out[:, -2], out[:, -1] = np.log(lengths / held), np.log(held) / 4
    return out


def pack(bag: np.ndarray) -> tuple[bytes, bytes]:
    """A bag's features as half floats: a bit for each, set where it is not zero, and those that are not."""
    half = bag.astype(np.float16)
    return np.packbits(half != 0).tobytes(), half[half != 0].tobytes()


class PackedBags(Sequence):
    """Bags that are kept as :func:`pack` gives them; each is unpacked when it is asked for."""

    def __init__(self, packed: list[tuple[bytes, bytes]]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        bits, values = (np.frombuffer(x, dtype=t) for x, t in zip(self.packed[i], (np.uint8, np.float16), strict=True))
        n = len(bits) * 8 // N_FEATURES  # what fills the last byte is less than a passage
        bag = np.zeros((n, N_FEATURES))
        bag[np.unpackbits(bits, count=n * N_FEATURES).view(bool).reshape(n, N_FEATURES)] = values
        return bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttentionMIL:
    """Encoder, gated attention and scorer; plain numpy with its gradients written out."""

    def __init__(self, n_in: int = N_FEATURES, enc: int = 32, att: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        shape = {"W": (n_in, enc), "b": (enc,), "V": (enc, att), "U": (enc, att), "w": (att,), "c": (enc,), "d": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(n_in), np.ones(n_in)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p["W"] + self.p["b"])

    def attend(self, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return t, g, a, z

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each bag of passage features."""
        if not bags:
            return np.empty(0)
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        z = self.attend(self.encode(np.concatenate(bags)), starts, sizes)[3]
        return _sigmoid(z @ self.p["c"] + self.p["d"])

    def fit(self, bags: Sequence[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3, seed: int = 6) -> GatedAttentionMIL:
        """Adam on cross-entropy. No bags leave the model at 0.5 or so for everything."""
        if not bags:
            self.p["c"][:] = 0
            return self
        held = sum(len(b) for b in bags)
        self.mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / held
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(axis=0) for b in bags) / held) + 0.02
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients([bags[i] for i in pick], labels[pick])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k] * (k not in "bd")
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        x = (np.concatenate(bags) - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g, a, z = self.attend(h, starts, sizes)
        ds = (_sigmoid(z @ p["c"] + p["d"]) - y) / len(bags)
        dz = np.repeat(ds[:, None] * p["c"], sizes, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        gt, gg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        gh = (a[:, None] * dz + gt @ p["V"].T + gg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ gh, "b": gh.sum(axis=0), "V": h.T @ gt, "U": h.T @ gg, "w": (t * g).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 3000, fit_passages: int = 40) -> GatedAttentionMIL:
    """Fit on at most ``fit_rows`` labelled documents whose crc32(id as text) mod 4 is not 2.

    Null labels and ids are left out. Contradicting labels of one id count as the smaller. Rows of one id are one
    document; should their texts differ, one of those with the fewest passages stands for it. Without any labelled text the
    model scores everything alike.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2))
    one = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    sample = one.orderBy(F.xxhash64("id"), "id").limit(fit_rows)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = passage_features(batch.column(2)[i].as_py())
                if len(f) > fit_passages:
                    f = f[np.linspace(0, len(f) - 1, fit_passages).astype(np.int64)]
                bits, values = pack(f)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(f)]), pa.array([bits], type=pa.binary()), pa.array([values], type=pa.binary())], names=["id", "y", "n", "bits", "held"])

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")
    packed = texts.mapInArrow(bags, f"id {id_type}, y double, n long, bits binary, held binary")
    rows = packed.groupBy("id").agg(F.min(F.struct("n", "bits", "held", "y")).alias("bag")).select("id", "bag.*").collect()
    rows.sort(key=lambda r: r["id"])
    return GatedAttentionMIL().fit(PackedBags([(bytes(r["bits"]), bytes(r["held"])) for r in rows]), np.array([r["y"] for r in rows]))


def score_quality(docs: DataFrame, model: GatedAttentionMIL, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns in ``keep`` and ``score`` (0 to 1) for every row.

    Only the text is an input of the score. Null and empty texts are one empty passage. Repeated rows stay.
    """
    passed = [id_col, *keep]
    at = passed.index(text_col) if text_col in passed else len(passed)
    state = {k: v.astype(np.float32) for k, v in model.p.items()}, model.mean.astype(np.float32), model.scale.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = GatedAttentionMIL()
        own.p, own.mean, own.scale = state
        for batch in batches:
            scores, bags, held = [], [], 0
            for text in batch.column(at):
                bags.append(passage_features(text.as_py()))
                held += len(bags[-1])
                if held >= SCORE_PASSAGES:
                    scores.append(own.score(bags))
                    bags, held = [], 0
            scores.append(own.score(bags))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(np.concatenate(scores).astype(np.float64))], names=[*[f"c{i}" for i in range(len(passed))], "score"])

    fields = [docs.schema[c].dataType.simpleString() for c in passed]
    lean = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(passed)], *([] if at < len(passed) else [F.col(text_col).alias("text")]))
    scored = lean.mapInArrow(run, ", ".join([*[f"c{i} {t}" for i, t in enumerate(fields)], "score double"]))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(passed)], "score")
