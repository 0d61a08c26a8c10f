"""Token counts with a whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded by the tokenizer alone; those that come back as their own
single token form the whole-token set (bounded by the vocabulary). In the tasks a text is cut into pre-tokens; a
pre-token of the set counts 1 without any merge, the others are merged. Results per piece are kept in a bounded cache.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each give their row; columns other than
id and text are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe import Counts, byte_letters


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer encodes, standing alone, as exactly their own id."""
    from tokenizers import Tokenizer

    tok, letters = Tokenizer.from_file(path), byte_letters()
    texts: dict[str, int] = {}
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            texts[bytes(letters[c] for c in token).decode("utf-8")] = i
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token by itself
    found = tok.encode_batch(list(texts), add_special_tokens=False)
    return frozenset(t for (t, i), e in zip(texts.items(), found, strict=True) if e.ids == [i])


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; no shuffle."""
    whole = whole_tokens(path)
    if not all(whole):
        raise ValueError("empty token")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(path, whole)
        for pdf in batches:
            n = [counts.count(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": n})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
