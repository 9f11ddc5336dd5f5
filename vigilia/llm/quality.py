"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, over its whole text. Each passage becomes a vector of word-shape
shares (hashed last two characters), character-class shares and repetition rates; an encoder turns it into a hidden
vector h, gated attention weighs the passages of the bag,

    a = softmax(w . (tanh(V h) * sigmoid(U h))),   score = sigmoid(c . sum(a h) + d),

and everything is learned from document labels alone (numpy, Adam, fixed seed) on at most ``SAMPLE`` labelled
documents, drawn by the hash of the id. Every passage of a drawn document is learned from; documents are taken in the
order of the hash as long as they have ``PASSAGES`` passages in all at most (one that does not fit is passed over), so
what reaches the driver is bounded by these two parameters. Scoring reads every passage of every document. The learned
arrays (about 60 kB) travel with the scoring function.

Cases: null and empty texts are one all-zero passage and get a score; null labels and labels without a document are
passed over; repeated labels of an id count as their mean, rounded half up; with no label at all the score is 0.5, with one class only it
is that class's smoothed share; a null id is never held out; repeated rows are scored each and learned from once; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common

PASSAGE = 64
BUCKETS = 128
SAMPLE = 4000  # labelled documents used for learning, at most
PASSAGES = 1 << 16  # passages of them in all, at most
STATS = 8
FEATURES = BUCKETS + STATS
HIDDEN, GATE = 24, 12
CHUNK_WORDS = 1 << 18
THRESHOLD = 0.3


def remainder(id_col: str, modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


class _Words(dict):
    """word -> row of its shape table: bucket, length, upper, digits, other characters."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 5), np.float32)

    def __missing__(self, w: str) -> int:
        upper = sum(c.isupper() for c in w)
        digit = sum(c.isdigit() for c in w)
        other = sum(not c.isalnum() for c in w)
        self.rows.append((xxhash.xxh32_intdigest(w[-2:].lower().encode("utf-8", "replace")) % BUCKETS, len(w), upper, digit, other))
        i = self[w] = len(self)
        return i

    def look(self, ids: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table):], np.float32)])
        return self.table[ids]

    def trim(self) -> None:
        if len(self) > 1 << 18:
            self.clear()
            self.rows, self.table = [], np.zeros((0, 5), np.float32)


def passages(texts: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text); a text without words is one zero passage."""
    words.trim()
    lists = [t.split() for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    bags = np.maximum(1, -(-n // PASSAGE))
    total = int(bags.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not n.sum():
        return out, bags
    ids = np.concatenate([np.fromiter(map(words.__getitem__, x), np.int64, len(x)) for x in lists])
    first = np.concatenate([[0], np.cumsum(bags)[:-1]])  # passage number of each text's first passage
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(first, n) + inside // PASSAGE
    shape = words.look(ids)
    count = np.bincount(at, minlength=total).astype(np.float32)
    some = np.maximum(count, 1)
    hist = np.bincount(at * BUCKETS + shape[:, 0].astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, :BUCKETS] = hist / some[:, None]
    chars, upper, digit, other = (np.bincount(at, shape[:, k], minlength=total) for k in (1, 2, 3, 4))
    chars1 = np.maximum(chars, 1)
    kinds = np.unique(at << 32 | ids) >> 32
    again = np.zeros(total)
    same = (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])
    again += np.bincount(at[1:][same], minlength=total)
    stats = (chars / some / 10, upper / chars1, digit / chars1, other / chars1, np.bincount(kinds, minlength=total) / some,
             again / some, np.log1p(count) / 4, np.bincount(at, shape[:, 1] <= 2, minlength=total) / some)
    for k, v in enumerate(stats):
        out[:, BUCKETS + k] = v
    return out, bags


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHUNK_WORDS`` words (by length), so that a batch's arrays stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size >= CHUNK_WORDS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict, x: np.ndarray, bags: np.ndarray) -> dict:
    """Encoder, gated attention inside each bag, score of the weighted passage vector."""
    start = np.cumsum(bags) - bags
    h = np.tanh((x - m["mean"]) / m["std"] @ m["W"] + m["b"])
    p, q = np.tanh(h @ m["V"] + m["bv"]), _sigmoid(h @ m["U"] + m["bu"])
    e = (p * q) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), bags))
    a = e / np.repeat(np.add.reduceat(e, start), bags)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"start": start, "h": h, "p": p, "q": q, "a": a, "z": z, "score": _sigmoid(z @ m["c"] + m["d"])}


def _gradient(m: dict, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict:
    f = forward(m, x, bags)
    err = (f["score"] - y) / len(y)
    dz = np.repeat(err[:, None] * m["c"], bags, axis=0)
    da = (f["h"] * dz).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["start"]), bags))
    dg = de[:, None] * m["w"]
    dp, dq = dg * f["q"] * (1 - f["p"] ** 2), dg * f["p"] * f["q"] * (1 - f["q"])
    dh = f["a"][:, None] * dz + dp @ m["V"].T + dq @ m["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    xs = (x - m["mean"]) / m["std"]
    return {"W": xs.T @ dpre, "b": dpre.sum(0), "V": f["h"].T @ dp, "bv": dp.sum(0), "U": f["h"].T @ dq, "bu": dq.sum(0),
            "w": (f["p"] * f["q"]).T @ de, "c": f["z"].T @ err, "d": err.sum()}


def train(bags_x: list[np.ndarray], y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, decay: float = 1e-4,
          seed: int = 7) -> dict:
    """Model from one feature matrix per document and the documents' labels."""
    if len(set(y.tolist())) < 2:
        return {"constant": float((y.sum() + 1) / (len(y) + 2))}
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags_x).astype(np.float64)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    m = {"mean": every.mean(0), "std": np.maximum(every.std(0), 0.01), "W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN),
         "V": draw(HIDDEN, GATE), "bv": np.zeros(GATE), "U": draw(HIDDEN, GATE), "bu": np.zeros(GATE), "w": draw(GATE),
         "c": draw(HIDDEN), "d": np.zeros(())}
    names = [k for k in m if k not in ("mean", "std")]
    one, two, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i:i + batch]
            g = _gradient(m, np.concatenate([bags_x[j] for j in pick]), np.array([len(bags_x[j]) for j in pick]), y[pick])
            step += 1
            for k in names:
                grad = g[k] + decay * m[k]
                one[k] = 0.9 * one[k] + 0.1 * grad
                two[k] = 0.999 * two[k] + 0.001 * grad ** 2
                m[k] = m[k] - rate * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, passage_limit: int = PASSAGES) -> dict:
    """Model learned from the labels of ids outside the held-out fifth (crc32(id) mod 5 is not 0)."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).filter(
        F.col("label").isNotNull() & F.col("label_id").isNotNull() & (remainder("label_id") != 0))
    known = known.groupBy("label_id").agg(F.floor(F.avg("label") + 0.5).cast("int").alias("label"))
    drawn = known.withColumn("place", F.xxhash64("label_id")).orderBy("place", "label_id").limit(sample)
    rows = common.id_text(docs, id_col, text_col).join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for b in batches:
            bags = [passages([t], words)[0].astype(np.float16) for t in b["text"]]
            yield pd.DataFrame({"place": b["place"], "id": b["doc_id"].astype(str), "text_key": b["text_key"], "label": b["label"],
                                "n": [len(x) for x in bags], "bag": [x.tobytes() for x in bags]})

    bags = common.write_cut(rows.withColumn("text_key", common.text_key()).mapInPandas(
        run, "place long, id string, text_key long, label int, n int, bag binary"))
    order = bags.groupBy("place", "id", "text_key").agg(F.first("n").alias("n")).orderBy("place", "id", "text_key").limit(sample)
    taken, total = [], 0
    for r in order.collect():  # ``sample`` narrow rows at most
        if total + r.n <= passage_limit:
            taken.append((r.id, r.text_key))
            total += r.n
    taken = docs.sparkSession.createDataFrame(taken, "id string, text_key long")
    got = sorted(bags.join(F.broadcast(taken), ["id", "text_key"]).dropDuplicates(["id", "text_key"]).select("id", "label", "bag").collect())
    if not got:
        return {"constant": 0.5}
    bags = [np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES).astype(np.float64) for r in got]
    return train(bags, np.array([r.label for r in got], np.float64))


def score_texts(model: dict, texts: list[str], words: _Words) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    out = [np.zeros(0)]
    for a, b in chunks(texts):
        x, bags = passages(texts[a:b], words)
        out.append(forward(model, x, bags)["score"])
    return np.concatenate(out)


def quality_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, held_out, score, predicted) for every row."""
    src = common.id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text")).withColumn("held_out", remainder("doc_id") == 0)
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for b in batches:
            s = score_texts(model, b["text"].tolist(), words)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "held_out": b["held_out"], "score": s,
                                "predicted": (s >= THRESHOLD).astype(np.int32)})

    return src.mapInPandas(run, f"doc_id {id_type}, text_key long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose predicted quality is 0; all columns are kept, each text is judged by itself."""
    schema = docs.schema

    def run(batches: Iterator) -> Iterator:
        words = _Words()
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(score_texts(model, texts, words) >= THRESHOLD))

    return docs.mapInArrow(run, schema)
