"""Language of a text by string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression.

A text's features are the n-grams of one to ``LENGTHS`` characters that occur in it (present or not),
hashed into ``BUCKETS`` buckets; the blended-spectrum kernel of two texts is the number of n-grams
they share over the root of the product of how many each has.  A bounded sample of labelled
documents is the training set, some of it the landmarks.  A batch of texts is scored as
presence matrix x gram-by-landmark matrix x landmark coefficients; the last two are multiplied once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.llm.common import kept, small, valid_text
from pagescan.llm.mixing import hash60, thresholds

#: At most so many labelled documents are learned from, spread evenly over the languages, and so many are landmarks.
SAMPLE_ROWS, LANDMARKS = 1600, 256
#: Weight of the ridge penalty.
RIDGE = 0.01
LENGTHS, BUCKETS = 4, 1 << 16
_CHUNK, _BATCH = 1 << 20, 64
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def grams(text: str | None) -> tuple[np.ndarray, bool]:
    """(flags by bucket, whether there is a letter) of the whole text, a piece at a time.

    Letters are lower-cased; a run of anything else is one blank.
    """
    flags, letters, text = np.zeros(BUCKETS, bool), False, (text or "").lower()
    for start in range(0, len(text), _CHUNK):
        piece = text[max(0, start - LENGTHS + 1):start + _CHUNK]
        code = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        high = code >= 0x3000
        letter = high.copy()
        letter[~high] = _LETTER[code[~high]]
        if high.any():
            letter[high] = [chr(c).isalpha() for c in code[high].tolist()]
        letters = letters or bool(letter.any())
        code = np.where(letter, code, np.uint64(32))
        code = code[np.concatenate([[True], letter[1:] | letter[:-1]])]
        mixed = np.zeros(len(code), np.uint64)
        for n in range(min(LENGTHS, len(code))):
            mixed = mixed[:len(code) - n] * np.uint64(0x9E3779B97F4A7C15) + code[n:] + np.uint64(1)
            stirred = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            flags[stirred >> np.uint64(48)] = True
    return flags, letters


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most about ``rows`` of ``labelled(doc_id, text, lang)``, as many of each language, by hash order.

    The bound is found from histograms of the hash; equal rows count once.
    """
    marked = labelled.select("lang", valid_text().alias("text"), hash60(F.concat_ws(
        ":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))).alias("h"))
    hashes = kept(marked.select(F.col("lang").alias("source"), "h", F.lit(1).cast("long").alias("size")).distinct())
    counts = kept(hashes.groupBy("source").agg(F.count("*").alias("n")))
    languages = max(1, counts.count())
    edge = thresholds(hashes, counts.select("source", F.least("n", F.lit(max(2, rows // languages))).alias("need")))
    return marked.join(small(edge.select(F.col("source").alias("lang"), "at")), "lang").where("h <= at").dropDuplicates(
        ["lang", "h"])


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> dict:
    """The model: languages and the weight of each bucket for each language, from a bounded sample.

    The executors send presence bits, 8 KB a document, never texts.
    """
    def run(batches):
        for batch in batches:
            bits = [np.packbits(grams(t)[0]).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["lang", "h", "bits"])

    got = sample(labelled, rows).select("lang", "h", "text").mapInArrow(run, "lang STRING, h BIGINT, bits BINARY").collect()
    got.sort(key=lambda r: (r.h, r.lang))
    names = sorted({r.lang for r in got})
    if not names:
        return {"names": [], "weights": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0, np.float32)}
    x = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in got]), axis=1)
    lang = np.array([names.index(r.lang) for r in got])
    norm = np.sqrt(np.maximum(x.sum(1), 1)).astype(np.float32)
    # The first of each language in hash order, as many of each.
    place = np.zeros(len(lang), int)
    for k in range(len(names)):
        place[lang == k] = np.arange((lang == k).sum())
    marks = np.sort(np.argsort(place, kind="stable")[:landmarks])
    base = x[marks].astype(np.float32) / norm[marks, None]
    kernel = np.concatenate([x[i:i + 256].astype(np.float32) / norm[i:i + 256, None] @ base.T for i in range(0, len(x), 256)])
    value, vector = np.linalg.eigh(kernel[marks].astype(np.float64))
    good = value > 1e-8
    root = vector[:, good] / np.sqrt(value[good])
    feature = kernel @ root
    middle, wanted = feature.mean(0), np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    centred = feature - middle
    ridge = centred.T @ centred + RIDGE * len(x) * np.eye(centred.shape[1])
    slope = np.linalg.solve(ridge, centred.T @ (wanted - wanted.mean(0)))
    bias = wanted.mean(0) - middle @ slope
    return {"names": names, "weights": (base.T @ (root @ slope)).astype(np.float32), "bias": bias.astype(np.float32)}


def classify(docs: DataFrame, model: dict, keep=("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` (0 to 1) for each row of ``docs(text)``; no shuffle.

    A NULL text, one without a letter, or a model without languages gives ``und`` and 0.  Ties go to the
    first language in code-point order.  The score is the winner's regression value moved from
    [-1, 1] to [0, 1].  Bytes that are no UTF-8 count as U+FFFD, which is no letter.  ``keep`` must not name results;
    other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, weights, bias = (sent.value[k] for k in ("names", "weights", "bias"))
        for batch in batches:
            texts, best, scores = batch.column(batch.num_columns - 1), [], []
            for start in range(0, len(texts), _BATCH):
                found = [grams(t.as_py()) for t in texts[start:start + _BATCH]]
                flags = np.array([f for f, _ in found], np.float32)
                size = np.sqrt(np.maximum(flags.sum(1, keepdims=True), 1))
                value = flags @ weights / size + bias
                for row, (_, letters) in zip(value, found):
                    known = letters and len(names)
                    best.append(names[int(row.argmax())] if known else "und")
                    scores.append(float(min(1, max(0, (row.max() + 1) / 2))) if known else 0.0)
            yield pa.record_batch([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                                  names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*keep, valid_text().alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
