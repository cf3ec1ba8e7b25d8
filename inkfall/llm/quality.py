"""Quality classifier: a byte-level convolutional network in numpy.

Overlapping chunks of bytes cover the whole text. Learned filters slide over each chunk; each filter's
largest response in a chunk is kept, and the largest and the mean of those over all chunks are combined
into one probability. Each place of a chunk has two symbols: its byte, and how far back the same four bytes
stood last, in powers of two, as no short filter over bytes alone can see that a word of any length repeats.
A filter is a table with a row for each symbol at each of its places, so a response is a sum of looked-up rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfall.llm.common import pick, place, plain, ship, table, written

CHUNK, STRIDE = 512, 448
#: Filters, bytes each covers, and bytes between two responses.
FILTERS, WIDTH, STEP = 16, 8, 4
#: Bytes that count as a repetition, and symbols: 256 bytes, no repetition, and a power of two of its distance each.
GRAM, SYMBOLS = 4, 256 + 1 + CHUNK.bit_length()
#: The classifier learns from so many labelled documents at most, and so many bytes of whole texts together.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 16 << 20
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 32, 0.02, 1e-4, 5
THRESHOLD = 0.3
#: Bytes that are scored together.
SCORE_BYTES = 1 << 20
#: Rows of which the texts are held as Python strings together.
SCORE_ROWS = 500


def chunks_of(text: str | bytes | None) -> np.ndarray:
    """All chunks of a text as rows of bytes; the last one is filled up with zeros, an empty text is one such chunk."""
    raw = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = 1 if len(raw) <= CHUNK else 1 + -(-(len(raw) - CHUNK) // STRIDE)
    full = np.zeros((n - 1) * STRIDE + CHUNK, dtype=np.uint8)
    full[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::STRIDE]


_DISTANCE = np.array([256 + d.bit_length() for d in range(CHUNK)], dtype=np.uint16)


def repeats(chunks: np.ndarray) -> np.ndarray:
    """Second symbols: 256 where a place's GRAM bytes have not stood in the chunk before, or fill it up, else more."""
    places = CHUNK - GRAM + 1
    gram = np.zeros((len(chunks), places), dtype=np.uint64)
    for i in range(GRAM):
        gram = (gram << np.uint64(8)) | chunks[:, i : i + places]
    key = np.sort((gram << np.uint64(16)) | np.arange(places, dtype=np.uint64), axis=1)
    at, gram = (key & np.uint64(0xFFFF)).astype(np.int64), key >> np.uint64(16)
    back = np.where((gram[:, 1:] == gram[:, :-1]) & (gram[:, 1:] > 0), at[:, 1:] - at[:, :-1], 0)
    out = np.full(chunks.shape, 256, dtype=np.uint16)
    np.put_along_axis(out, at[:, 1:], _DISTANCE[back], axis=1)
    return out


def responses(chunks: np.ndarray, again: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(chunks, places, filters) sums of looked-up rows."""
    places = (CHUNK - WIDTH) // STEP + 1
    out = np.zeros((len(chunks), places, filters.shape[2]), dtype=np.float32)
    for o in range(WIDTH):
        here = slice(o, o + (places - 1) * STEP + 1, STEP)
        out += filters[o][chunks[:, here]]
        out += filters[o][again[:, here]]
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def pooled(best: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each document, the largest and the mean of its chunks' responses; a document starts at each of starts."""
    counts = np.diff(np.append(starts, len(best)))
    return np.hstack([np.maximum.reduceat(best, starts), np.add.reduceat(best, starts) / counts[:, None]])


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> dict:
    """Filters, weights and bias by Adam on the cross-entropy; each document is given by all its chunks.

    Without documents the weights are zero, so that every score is a half and nothing is rejected.
    """
    rng = np.random.default_rng(seed)
    model = {"filters": rng.normal(0, 0.3, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32), "weights": np.zeros(2 * FILTERS, np.float32), "bias": np.zeros(1, np.float32)}
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    if not len(docs):
        return model
    model["weights"] += rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    told = [repeats(d) for d in docs]
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            chunks, again = np.concatenate([docs[i] for i in some]), np.concatenate([told[i] for i in some])
            sizes = np.array([len(docs[i]) for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(some)), sizes)
            largest = [_largest(c, r, model["filters"]) for c, r in zip(_split(chunks), _split(again), strict=True)]
            at, raw = (np.concatenate([x[i] for x in largest]) for i in (0, 1))
            best = np.maximum(raw, 0)
            x = pooled(best, starts)
            p = _sigmoid(x @ model["weights"] + model["bias"][0])
            err = ((p - labels[some]) / len(some)).astype(np.float32)
            gx = err[:, None] * model["weights"][None, :]
            is_max = best == x[owner, :FILTERS]
            ties = np.add.reduceat(is_max.astype(np.float32), starts)
            gbest = is_max * (gx[:, :FILTERS] / np.maximum(ties, 1))[owner] + (gx[:, FILTERS:] / sizes[:, None])[owner]
            gbest = np.where(raw > 0, gbest, 0.0).astype(np.float32)
            gf = np.zeros_like(model["filters"])
            rows, cols = np.broadcast_to(np.arange(len(chunks))[:, None], at.shape), np.broadcast_to(np.arange(FILTERS)[None, :], at.shape)
            for o in range(WIDTH):
                for symbols in (chunks, again):
                    np.add.at(gf[o], (symbols[rows, at * STEP + o], cols), gbest)
            grads = {"filters": gf + DECAY * model["filters"], "weights": x.T @ err + DECAY * model["weights"], "bias": np.array([err.sum()], np.float32)}
            t += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model[k] -= (RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def _largest(chunks: np.ndarray, again: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk and filter the place of the largest response, and that response."""
    out = responses(chunks, again, filters)
    at = out.argmax(axis=1)
    return at, np.take_along_axis(out, at[:, None, :], axis=1)[:, 0]


def scores(model: dict, texts: list) -> np.ndarray:
    """Probability of label 1 of each whole text."""
    out = []
    lo = 0
    while lo < len(texts):
        docs, n = [], 0
        while lo + len(docs) < len(texts) and n < SCORE_BYTES:
            docs.append(chunks_of(texts[lo + len(docs)]))
            n += len(docs[-1]) * CHUNK
        lo += len(docs)
        best = np.concatenate([_best(part, model["filters"]) for d in docs for part in _split(d)])
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
        x = pooled(best, starts)
        out.append(_sigmoid(x @ model["weights"] + model["bias"][0]))
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def _split(chunks: np.ndarray, rows: int = 256):
    return (chunks[i : i + rows] for i in range(0, len(chunks), rows))


def _best(chunks: np.ndarray, filters: np.ndarray) -> np.ndarray:
    return np.maximum(responses(chunks, repeats(chunks), filters).max(axis=1), 0)


def held_out(doc_id):
    """The documents that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Fits the network on the whole texts of labelled documents.

    They are taken in the order of a hash of their id, sample_docs at most, a text that would exceed sample_bytes of
    all together being passed over; so much reaches the driver. Labels and ids that are null are left out; an id
    with several labels counts as 1 if any is, and of rows that share an id one is taken by a hash of its text.
    Without any such row, empty tables among them, the model gives every text the score 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    told = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    # the corpus is read once: the sampled rows are a small table of their own
    rows = written(rows.join(F.broadcast(told), "doc_id").withColumn("h", F.xxhash64("text")), "sample")
    sizes = rows.groupBy("doc_id", "label").agg(F.min(F.struct("h", F.octet_length("text").alias("size"))).alias("x"))
    taken, left = [], sample_bytes
    for r in sizes.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").select("doc_id", F.col("label").cast("double"), "x.*").collect():
        if r.size <= left:
            taken.append((r.doc_id, r.h, r.label))
            left -= r.size
    if not taken:
        return fit([], np.zeros(0, dtype=np.float32))
    chosen = spark.createDataFrame(taken, f"id {dict(rows.dtypes)['doc_id']}, k long, y double")
    got = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("k")))
    got = got.groupBy("doc_id").agg(F.min(F.struct(F.col("text").cast("binary").alias("text"), F.col("y").alias("label"))).alias("x")).select("doc_id", "x.*")
    got = sorted(got.collect())  # at most sample_docs rows of at most sample_bytes
    y = np.array([1.0 if r.label else 0.0 for r in got], dtype=np.float32)
    return fit([chunks_of(bytes(r.text)) for r in got], y)


def _scored(model: dict, text: str, keep: list[str], least: float = 0.0):
    """The columns to keep and the score of the rows that reach the least score."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SCORE_ROWS):
                batch = whole.slice(lo, SCORE_ROWS)
                got = scores(model, batch.column(batch.schema.get_field_index(text)).to_pylist())
                out = pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(got)], names=[*keep, "score"])
                yield out.filter(pa.array(got >= least)) if least > 0 else out

    return run


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by its text alone.

    Null and empty texts are scored as one chunk of zeros. Repeated rows get a row each; an empty table
    gives an empty result. The model is some 140 kB, whatever the corpus.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    got = rows.mapInArrow(_scored(model, "text", ["doc_id"]), f"doc_id {kind}, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever their names.

    Null and empty texts are scored as one chunk of zeros; repeated rows are judged alike. A model of no rows rejects
    nothing, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    by_place, columns = plain(docs)
    text = place(columns, "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in by_place.schema.fields)
    got = by_place.mapInArrow(_scored(model, text, by_place.columns, THRESHOLD), f"{fields}, score double")
    return got.drop("score").toDF(*columns)


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
