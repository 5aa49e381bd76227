"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is the embedding of its hash beside the mean embedding of the hashes of its byte n-grams of 3 to 5 (with
its ends marked), so words never seen still carry their characters. Every text is read in windows of WIDTH words that
overlap by half; two gated recurrent layers read each window from either end, attention pools their states, and a
logistic output scores the window. A text's score is its highest window's, so all windows of the whole text count; long texts are
read segment by segment.

Labels are of texts, not windows. Training starts from the window of each toxic text whose words' n-grams are most
particular to toxic texts, then, every other epoch, takes the one that the network scores highest, and the highest
ones of clean texts, as harder examples. It uses a bounded sample: of either class the SAMPLE_DOCS different labelled texts that
come first by md5 of their id, of at most SAMPLE_CHARS characters. One task trains; the driver only passes the parameters on.

Nulls, ties, and so on: null and empty texts score like a text without words, by the network's output for nothing; labels that
are null teach nothing; of several labels of one id the highest counts; a null id isn't held out and teaches nothing;
without labels of both classes every score is 0; repeated rows are scored each, and teach once; an empty table gives an empty result; other columns don't matter,
whatever their names, and are kept by :func:`without_toxic`.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import sampled

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WIDTH, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 12, 1 << 14
DIM, HIDDEN = 8, 8
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 12_000
EPOCHS, BATCH, RATE = 8, 128, 0.01
THRESHOLD = 0.7
#: Share of the less telling words that training hides, and of toxic windows whose telling words it shows among clean ones.
DROPPED, TRANSPLANTED = 0.1, 0.75
#: Characters that are scored together.
CHUNK_CHARS = 1_500_000
#: Words of a segment of a long text; the last window of one is the first of the next.
SEGMENT_WORDS = WIDTH + STRIDE * 8192
#: Windows that go through the network together.
TOGETHER = 1024


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


class Vocabulary:
    """The distinct words of some texts, with the rows of their embeddings."""

    def __init__(self, texts: list[list[bytes]]):
        ids: dict[bytes, int] = {}
        self.texts = [np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in texts]
        self.words = list(ids) or [b"-"]
        self.word_rows = np.fromiter((xxhash.xxh32_intdigest(w) for w in self.words), np.int64, len(self.words)) % WORD_ROWS
        raw = np.frombuffer(b"".join([b"<%b>" % w for w in self.words]), np.uint8).astype(np.uint64)
        lengths = np.array([len(w) + 2 for w in self.words])
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        left = np.repeat(self.starts + lengths, lengths) - np.arange(len(raw))  # bytes from here to the word's end
        self.char_rows = []
        rolling = np.zeros(len(raw), np.uint64)
        for n in range(1, 6):
            shifted = np.concatenate([raw[n - 1 :], np.zeros(n - 1, np.uint64)])
            rolling = (rolling * np.uint64(0x100000001B3) + shifted + np.uint64(1)) & np.uint64(0xFFFFFFFFFFFF)
            if n >= 3:
                rows = ((rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
                self.char_rows.append(np.where(left >= n, rows, CHAR_ROWS))  # the last row stays zero
        self.char_counts = sum(np.maximum(0, lengths - n + 1) for n in (3, 4, 5)).astype(np.float32)[:, None]

    def inputs(self, p: dict) -> np.ndarray:
        chars = sum(p["chars"][rows] for rows in self.char_rows)
        chars = np.add.reduceat(chars, self.starts, axis=0) / np.sqrt(self.char_counts)
        return np.concatenate([p["words"][self.word_rows], chars], 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WIDTH) places of words, -1 beyond a short text's end, and each window's text; the last of a text ends with it."""
        out, owner = [], []
        for i, x in enumerate(self.texts):
            if len(x) <= WIDTH:
                out.append(np.concatenate([x, np.full(WIDTH - len(x), -1)])[None])
            else:
                at = np.append(np.arange(0, len(x) - WIDTH, STRIDE), len(x) - WIDTH)
                out.append(x[at[:, None] + np.arange(WIDTH)])
            owner.append(np.full(len(out[-1]), i))
        return (np.concatenate(out), np.concatenate(owner)) if out else (np.empty((0, WIDTH), np.int64), np.empty(0, np.int64))


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    new = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"words": new(WORD_ROWS, DIM, scale=0.1), "chars": new(CHAR_ROWS + 1, DIM, scale=0.1), "attend": new(2 * HIDDEN, scale=0.3), "out": new(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1, np.float32)}
    p["chars"][CHAR_ROWS] = 0
    for d in "fb":
        p |= {f"W{d}": new(2 * DIM, 3 * HIDDEN, scale=0.35), f"U{d}": new(HIDDEN, 3 * HIDDEN, scale=0.35), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def _read(p: dict, d: str, x: np.ndarray, there: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (T, B, H) of one direction over projected inputs x (T, B, 3H); there: 1 where a word is, or None for everywhere."""
    h, out = np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)) if d == "f" else reversed(range(len(x))):
        u = h @ p[f"U{d}"]
        gates = sigmoid(x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r, q = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * q)
        new = h + z * (c - h)
        if there is not None:
            new = new * there[t]
        if keep is not None:
            keep.append((t, h, z, r, q, c))
        h = out[t] = new
    return out


def forward(p: dict, projected: dict[str, np.ndarray], places: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows: places in the projected words, -1 where none is."""
    places = places.T
    there = None if (places >= 0).all() else (places >= 0).astype(np.float32)[:, :, None]
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    states = np.concatenate([_read(p, d, projected[d][places], there, kept[d]) for d in "fb"], 2)
    score = states @ p["attend"]
    if there is not None:
        score = np.where(there[:, :, 0] > 0, score, np.float32(-1e9))
    score = np.exp(score - score.max(0))
    if there is not None:
        score *= there[:, :, 0]
    weight = score / np.maximum(score.sum(0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(0)
    if keep is not None:
        keep |= {"there": there, "states": states, "weight": weight, "pooled": pooled, "steps": kept, "places": places}
    return pooled @ p["out"] + p["bias"][0]


def gradients(p: dict, vocabulary: Vocabulary, places: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss, by hand through time."""
    x = vocabulary.inputs(p)
    k: dict = {}
    logits = forward(p, {d: x @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"}, places, k)
    d_logit = ((sigmoid(logits) - labels) * weights / weights.sum()).astype(np.float32)
    g = {"bias": np.array([d_logit.sum()], np.float32), "out": k["pooled"].T @ d_logit}
    d_pooled = d_logit[:, None] * p["out"]
    d_weight = (k["states"] * d_pooled).sum(2)
    d_score = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(0))
    d_states = k["weight"][:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
    g["attend"] = np.tensordot(d_score, k["states"], ([0, 1], [0, 1]))
    d_x = np.zeros_like(x)
    flat = k["places"].ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-2))
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        d_in = np.zeros((*k["places"].shape, 3 * HIDDEN), np.float32)
        d_u, carry = np.zeros_like(p[f"U{d}"]), np.zeros((places.shape[0], HIDDEN), np.float32)
        for t, h, z, r, q, c in reversed(k["steps"][d]):
            dh = d_states[t, :, part] + carry
            if k["there"] is not None:
                dh = dh * k["there"][t]
            a_c = dh * z * (1 - c * c)
            d_gates = np.concatenate([dh * (c - h) * z * (1 - z), a_c * q * r * (1 - r), a_c * r], 1)
            d_u += h.T @ d_gates
            carry = dh * (1 - z) + d_gates @ p[f"U{d}"].T
            d_in[t] = d_gates
            d_in[t, :, 2 * HIDDEN :] = a_c
        sums = np.add.reduceat(d_in.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        rows = flat[order][first]
        sums, rows = sums[rows >= 0], rows[rows >= 0]
        g |= {f"U{d}": d_u, f"W{d}": x[rows].T @ sums, f"b{d}": sums.sum(0)}
        d_x[rows] += sums @ p[f"W{d}"].T
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], vocabulary.word_rows, d_x[:, :DIM])
    lengths = np.diff(np.append(vocabulary.starts, len(vocabulary.char_rows[0])))
    d_chars = np.repeat(d_x[:, DIM:] / np.sqrt(vocabulary.char_counts), lengths, axis=0)
    g["chars"] = np.zeros_like(p["chars"])
    for rows in vocabulary.char_rows:
        np.add.at(g["chars"], rows, d_chars)
    g["chars"][CHAR_ROWS] = 0
    return g


def _likely(vocabulary: Vocabulary, labels: np.ndarray) -> np.ndarray:
    """A weight for each word: how particular its n-grams are to toxic texts, by log odds of the texts that hold them."""
    width = CHAR_ROWS * 16
    raw = np.frombuffer(b"".join([b"<%b>" % w for w in vocabulary.words]), np.uint8).astype(np.uint64)
    lengths = np.diff(np.append(vocabulary.starts, len(raw)))
    left = np.repeat(vocabulary.starts + lengths, lengths) - np.arange(len(raw))
    key = sum(np.concatenate([raw[i:], np.zeros(i, np.uint64)]) << np.uint64(8 * i) for i in range(5))
    key = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % width
    key = np.where(left >= 5, key, 0)
    counts = np.zeros((2, width))
    for x, y in zip(vocabulary.texts, labels, strict=True):
        words = np.unique(x)
        if len(words):
            rows = np.concatenate([key[vocabulary.starts[w] : vocabulary.starts[w] + lengths[w]] for w in words])
            counts[int(y), np.unique(rows)] += 1
    share = (counts + 0.5) / (np.bincount(labels.astype(int), minlength=2)[:, None] + 1)
    odds = np.log(share[1] / share[0]) * np.sqrt(np.minimum(counts[1], 25))
    odds[0] = 0
    return np.maximum.reduceat(odds[key], vocabulary.starts)


def train(texts: list[str], labels: list[int], seed: int = 5) -> dict[str, np.ndarray] | None:
    """Parameters; None without both classes."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    vocabulary, rng = Vocabulary([words_of(t) for t in texts]), np.random.default_rng(seed)
    places, owner = vocabulary.windows()
    telling = np.append(_likely(vocabulary, y), 0.0)[places]
    likely = telling.max(1)
    whole = np.flatnonzero((y[owner] == 0) & (places[:, -1] >= 0))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, len(owner)))

    def best(score: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(score, first)
        at = np.flatnonzero(score == np.repeat(top, sizes))
        return at[np.unique(owner[at], return_index=True)[1]]

    p, moment, spread, step = start(seed), {}, {}, 0
    chosen, clean = best(likely), np.flatnonzero(y[owner] == 0)
    for epoch in range(EPOCHS):
        if epoch and epoch % 2 == 0:
            chosen = best(_logits(p, vocabulary, places) + 0.02 * likely)
        positive = chosen[y[owner[chosen]] == 1]
        hard = chosen[y[owner[chosen]] == 0]
        easy = rng.choice(clean, min(len(clean), 4 * max(len(positive), 200)), replace=False)
        rows = np.concatenate([np.repeat(positive, max(1, 1500 // len(positive))), hard, easy])
        rows = rng.permutation(rows)
        for at in range(0, len(rows), BATCH):
            own = rows[at : at + BATCH]
            shown, key = places[own], telling[own] >= 0.5 * likely[own][:, None]
            if len(whole):  # the telling words of toxic windows, mostly among words of clean ones: their neighbours mustn't be learned by heart
                moved = (y[owner[own]] == 1) & (rng.random(len(own)) < TRANSPLANTED)
                shown = np.where(moved[:, None] & ~key, places[rng.choice(whole, len(own))], shown)
            shown = np.where((rng.random(shown.shape) < DROPPED) & ~key, -1, shown)
            used = np.unique(shown)
            used = used[used >= 0]
            local = np.full(len(vocabulary.words) + 1, -1)
            local[used] = np.arange(len(used))
            local[-1] = -1
            part = Vocabulary([[vocabulary.words[i] for i in used]])
            target = y[owner[own]].astype(np.float32)
            g = gradients(p, part, local[shown], target, np.ones(len(own), np.float32))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for name, value in g.items():
                m = moment[name] = 0.9 * moment.get(name, 0) + 0.1 * value
                s = spread[name] = 0.999 * spread.get(name, 0) + 0.001 * value * value
                p[name] = (p[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return p


def _logits(p: dict, vocabulary: Vocabulary, places: np.ndarray) -> np.ndarray:
    x = vocabulary.inputs(p)
    projected = {d: x @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"}
    # short windows last: only they need masks
    order = np.argsort((places[:, -1] < 0).astype(int), kind="stable")
    out = np.empty(len(places), np.float32)
    for at in range(0, len(order), TOGETHER):
        rows = order[at : at + TOGETHER]
        out[rows] = forward(p, projected, places[rows])
    return out


def segments(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in segments whose windows together are the text's windows."""
    if not text or len(text) < SEGMENT_WORDS:
        yield words_of(text)
        return
    held: list[bytes] = []
    for m in WORDS.finditer(text.lower().encode("utf-8", "surrogatepass")):
        held.append(m[0])
        if len(held) > SEGMENT_WORDS:
            yield held[:SEGMENT_WORDS]
            held = held[SEGMENT_WORDS - WIDTH :]
    yield held


def score(p: dict | None, texts: list[str | None]) -> np.ndarray:
    """The highest score of each text's windows."""
    out = np.full(len(texts), -np.inf)
    if p is None or not texts:
        return np.zeros(len(texts))
    held: list[list[bytes]] = []
    of: list[int] = []

    def flush():
        vocabulary = Vocabulary(held)
        places, owner = vocabulary.windows()
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        np.maximum.at(out, np.array(of), np.maximum.reduceat(_logits(p, vocabulary, places), first))
        held.clear()
        of.clear()

    size = 0
    for i, text in enumerate(texts):
        for words in segments(text):
            held.append(words)
            of.append(i)
            size += len(words)
            if size >= 2 * SEGMENT_WORDS:
                flush()
                size = 0
    if held:
        flush()
    return sigmoid(out.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int) -> dict | None:
    """Parameters from labelled rows whose crc32 of the id isn't ``held`` modulo ``folds``; one task trains."""
    ident, text = F.col(id_col).alias("id"), F.col(text_col)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(ident).agg(F.max(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % folds != held))
    full = docs.where(text.isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(ident, F.md5(F.col(id_col).cast("string")).alias("key"), F.md5(text).alias("hash"), text.alias("text"))
    own = full.select("id", "key", "hash").join(known, "id").select("y", "key", "hash").distinct()
    chosen = sampled(own, "y", SAMPLE_DOCS)  # 2 * SAMPLE_DOCS rows at most
    rows = full.join(F.broadcast(chosen), ["key", "hash"]).groupBy("y", "key", "hash").agg(F.first("text").alias("text"))

    def run(batches):
        found = sorted((k, h, y, t) for b in batches for k, h, y, t in zip(*[b.column(c).to_pylist() for c in ("key", "hash", "y", "text")], strict=True))
        p = train([t for _, _, _, t in found], [y for _, _, y, _ in found])
        if p is not None:
            out = io.BytesIO()
            np.savez(out, **p)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["p"])

    made = rows.repartition(1).mapInArrow(run, "p binary").collect()
    return dict(np.load(io.BytesIO(made[0]["p"]))) if made else None


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        texts = whole.column("_text").to_pylist()
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK_CHARS or i == len(texts) - 1:
                yield whole.slice(at, i + 1 - at), score(model.value, texts[at : i + 1])
                at, size = i + 1, 0


def rate(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds, held))
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, scores in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds, held))
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def run(batches):
        for batch, scores in _scored(batches, model):
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(scores < threshold))

    out = plain.withColumn("_text", F.col(names[docs.columns.index(text_col)])).mapInArrow(run, plain.schema)
    return out.toDF(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
