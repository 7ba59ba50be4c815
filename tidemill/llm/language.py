"""Language identification by hierarchical discrimination (op8).

A first linear support vector machine per family (one against the rest) predicts the language
family; within it, one-versus-one machines separate the languages by votes. Features are hashed
byte trigrams of the whole lower-cased text. Training reads only text and lang of a bounded
sample of the labelled rows; everything else covers all rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_map, table

#: Labelled rows used for fitting, in all, spread evenly over the languages; each has one at least.
SAMPLE = 3000
BUCKETS = 4096
# fixed values: languages by family; any other language is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi mr ne bn pa gu ur",
    "sinitic": "zh yue wuu",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed byte trigrams."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(KEEP).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BUCKETS, np.float32)
    key = ((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(2654435761)
    x = np.sqrt(np.bincount(key >> np.uint32(20), minlength=BUCKETS)).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 120) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss; y is -1 or 1."""
    x, y = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32), y.astype(np.float32)
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * c / len(y)
    weight, top = weight.astype(np.float32), np.float32(1 + 2 * weight.sum() * 2)  # top bounds the curvature: rows have norm sqrt(2)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - (v - 2 * (weight * slack * y) @ x) / top
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def fit(x: np.ndarray, labels: list[str]) -> dict:
    lang = np.array(labels, object)
    langs = sorted(set(labels))
    family = {code: FAMILY.get(code, code) for code in langs}
    families = sorted(set(family.values()))
    of = np.array([family[code] for code in labels], object)
    first = np.array([fit_machine(x, np.where(of == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((len(families), BUCKETS + 1), np.float32)
    inside = {}
    for f in families:
        codes = [code for code in langs if family[code] == f]
        pairs = list(itertools.combinations(range(len(codes)), 2))
        machines = []
        for i, j in pairs:
            at = (lang == codes[i]) | (lang == codes[j])
            machines.append(fit_machine(x[at], np.where(lang[at] == codes[i], 1, -1)))
        inside[f] = (codes, pairs, np.array(machines, np.float32).reshape(len(pairs), BUCKETS + 1))
    return {"families": families, "first": first, "inside": inside}


def sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    margin = x @ model["first"].T
    best = margin.argmax(axis=1)
    p = sure(margin)
    share = p[np.arange(len(x)), best] / p.sum(axis=1)
    if len(model["families"]) == 1:
        share[:] = 1.0
    out, score = np.empty(len(x), object), share.copy()
    for k, f in enumerate(model["families"]):
        at = np.flatnonzero(best == k)
        codes, pairs, machines = model["inside"][f]
        if not len(at):
            continue
        if not pairs:
            out[at] = codes[0]
            continue
        p = sure(x[at] @ machines.T)
        votes, soft = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes)))
        for m, (i, j) in enumerate(pairs):
            votes[:, i] += p[:, m] >= 0.5
            votes[:, j] += p[:, m] < 0.5
            soft[:, i] += p[:, m]
            soft[:, j] += 1 - p[:, m]
        won = (votes + soft / (len(codes) + 1)).argmax(axis=1)
        out[at] = np.array(codes, object)[won]
        score[at] *= soft[np.arange(len(at)), won] / (len(codes) - 1)
    return out.tolist(), np.clip(score, 0, 1)


def feature_batches(batches):
    for batch in batches:
        data = [features(t or "").astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(data, pa.binary())], ["lang", "x"])


def predict_batches(batches, model: dict):
    import regex

    letter = regex.compile(r"\p{L}")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and letter.search(t)] if model["families"] else []
        for a in range(0, len(at), 256):
            part = at[a:a + 256]
            got, p = predict(model, np.stack([features(texts[i]) for i in part]))
            score[part] = p
            for i, code in zip(part, got):
                lang[i] = code
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])


def learn(documents: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` rows of (text, lang), or one row of each language if there are more of them.

    The rows of a language are those of its smallest text hashes, so the choice depends neither on their order nor
    on how often a text is repeated, and every labelled language is learned.
    """
    labelled = documents.filter("lang is not null and text is not null").select("text", "lang").withColumn("hash", F.xxhash64("text"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"))  # one row per language
    per = max(1, sample // max(1, counts.count()))
    # those below the limit are some times as many as are taken, or all of a language's: few enough to be ranked
    limit = F.least(F.lit(1.0), 4 * F.lit(per + 10) / F.greatest("n", F.lit(1))) * 2.0**32
    near = labelled.join(F.broadcast(counts), "lang").filter(F.pmod("hash", F.lit(2**32)) <= limit).dropDuplicates(["lang", "hash"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(2**32)), "hash"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= per).select("lang", "text")
    got = arrow_map(chosen, "tidemill.llm.language:feature_batches", "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not got:
        return {"families": [], "first": np.zeros((0, BUCKETS + 1), np.float32), "inside": {}}
    return fit(np.stack([np.frombuffer(r["x"], "<f4") for r in got]), [r["lang"] for r in got])


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    held_out rows (crc32 of the decimal doc_id, modulo 4, is 2) are never learned from; a row with
    a null doc_id is held out. A text that is null or without a letter is `und` with score 0, as is
    every text if nothing was learned. Rows with the same doc_id each give a row; other columns
    are ignored.
    """
    rows = documents.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True)))
    model = learn(rows.filter("not held_out"), sample)
    return arrow_map(rows.select("doc_id", "held_out", "text"), "tidemill.llm.language:predict_batches", SCHEMA, model=model)


def query(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
