"""Language identification by nearest centroids over TF-IDF n-gram vectors.

Features: byte n-grams (1 to 4 bytes of the lower-cased UTF-8, digits and ASCII signs folded to a space) hashed into
`dims` counters per text, damped by 1 + log, weighted by IDF and scaled to unit length. Each language gets `centroids`
spherical k-means centroids. A text takes the language of the centroid with the largest cosine; it is rejected when that
cosine is below the language's radius, a share (`slack`) of the smallest cosine of its training texts to their centroids.

The model is fitted on a bounded sample: at most `sample` distinct labelled texts a language, chosen by a hash of the text.
Prediction covers every row and looks at nothing but the text. Whole texts are read, never prefixes.

Defined results: a null text or one without a letter is `und`, score 0, rejected; without any labelled training row
every text is `und`; rows without an id are learned from and predicted like any others; repeated rows each give their row,
and the fit learns from equal texts of a language once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
_LETTER = regex.compile(r"\p{L}")
#: Every ASCII byte that is not a letter becomes a space; A-Z are lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


@dataclass
class Model:
    dims: int
    idf: np.ndarray
    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray


def counts(text: str, dims: int) -> np.ndarray:
    """Hashed counts of the text's byte n-grams of 1 to 4 bytes."""
    folded = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())
    raw = np.frombuffer(b" " + folded + b" ", dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    out, h = np.zeros(dims, dtype=np.int64), np.zeros(len(raw), dtype=np.uint32)
    for n in range(min(4, len(raw))):
        h = (h[: len(raw) - n] * _MULTIPLIERS[0]) ^ (raw[n:] * _MULTIPLIERS[1] + np.uint32(n))
        out += np.bincount((h * _MULTIPLIERS[2]) >> shift, minlength=dims)
    return out


def vectors(texts: list[str], dims: int, idf: np.ndarray | None = None) -> np.ndarray:
    x = np.array([counts(t, dims) for t in texts], dtype=np.float32).reshape(len(texts), dims)
    np.log1p(x, out=x)
    if idf is not None:
        x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's centroid; starts from far-apart rows, so it gives the same result each time."""
    typical = x @ x.mean(axis=0)
    usable = np.flatnonzero(typical >= np.percentile(typical, 20))  # an outlier would keep a centroid to itself
    usable = usable if len(usable) >= k else np.arange(len(x))
    seeds = [int(np.argmax(typical))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(usable[np.argmin((x[usable] @ x[seeds].T).max(axis=1))]))
    c = x[seeds]
    own = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c, np.argmax(x @ c.T, axis=1)


def fit(df: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", sample: int = 600, sample_bytes: int = 4 << 20, dims: int = 4096, centroids: int = 3, slack: float = 0.6) -> Model | None:
    """Model of the rows where `train` holds and the language is known; None where there are none.

    `sample` bounds the distinct labelled texts a language (a hash of the text picks them, the last few are cut by order),
    and `sample_bytes` the bytes of them: texts are taken in that order up to there, one at least, whole. Ids play no part.
    """
    rows = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    most = [(lang, min(int(-(1 << 63) + (1 << 64) * min(1.0, 1.3 * sample / max(n, 1))), (1 << 63) - 1)) for lang, n in sizes.items()]
    limits = df.sparkSession.createDataFrame(most, f"lang {rows.schema['lang'].dataType.simpleString()}, most long")  # a row a language, of which the model holds centroids
    distinct = rows.join(F.broadcast(limits), "lang").where("h <= most").select("lang", "text", "h").dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    some = distinct.select("lang", "text", F.row_number().over(order).alias("rank"), F.sum(F.octet_length("text")).over(order).alias("bytes"))
    picked = some.where((F.col("rank") == 1) | (F.col("rank") <= sample) & (F.col("bytes") <= sample_bytes)).toPandas().sort_values(["lang", "rank"])
    x = vectors(list(picked["text"]), dims)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    langs, cs, owner, radius = sorted(set(picked["lang"])), [], [], []
    for k, lang in enumerate(langs):
        own = x[(picked["lang"] == lang).to_numpy()]
        c, at = spherical_kmeans(own, centroids)
        cs.append(c)
        owner += [k] * len(c)
        radius += [slack * float((own * c[at]).sum(axis=1).min())] * len(c)
    return Model(dims, idf, langs, np.array(owner), np.concatenate(cs), np.array(radius))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df and lang_pred, score (cosine, 0 to 1), rejected. Columns of these names in df are replaced."""
    names = ["lang_pred", "score", "rejected"]
    kept = [c for c in df.columns if c not in names]

    def classify(texts: list) -> pd.DataFrame:
        ok = [k for k, t in enumerate(texts) if t is not None and t == t and _LETTER.search(t)]
        lang, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        for s in range(0, len(ok) if model else 0, 256):
            part = ok[s : s + 256]
            cos = vectors([texts[k] for k in part], model.dims, model.idf) @ model.centroids.T
            best = np.argmax(cos, axis=1)
            top = cos[np.arange(len(part)), best]
            for k, b in zip(part, best, strict=True):
                lang[k] = model.langs[model.owner[b]]
            score[part] = np.clip(top, 0, 1)
            rejected[part] = top < model.radius[best]
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield classify(list(texts))

    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # a struct: the user's names never meet ours
    out = df.select(row.alias("row"), udf(F.col(text_col)).alias("found"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), *(F.col("found").getField(n).alias(n) for n in names))
