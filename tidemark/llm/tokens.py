"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: A text is encoded in pieces of about this many characters, cut before a single space between letters or digits, and
#: nowhere else: the vocabulary never joins across such a place, so the pieces' counts add up to the whole's. A text
#: without such a place is one piece, however long.
PIECE_CHARS = 20_000
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")

# Fixed value: how the vocabulary splits text before merging bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in parts whose token counts add up."""
    at = 0
    while len(text) - at > PIECE_CHARS and (cut := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a text; null and empty texts have none."""
    if not text:
        return 0
    enc = encoding(path)
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def with_token_counts(df: DataFrame, text: str, out: str = "tokens", prompt_out: str | None = None, directory: str = VOCABULARY_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the size of ``text`` in tokens.

    ``prompt_out``: also the tokens of the text's first line, where a line follows it. A null
    text has zero tokens.
    """
    path = os.path.join(directory, vocabulary)

    @F.pandas_udf("array<int>")
    def sizes(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            whole = count_tokens(t, path)
            head = (t or "").split("\n", 1)
            out.append([whole, count_tokens(head[0], path) if prompt_out and len(head) == 2 else 0])
        return pd.Series(out, dtype=object)

    sized = df.withColumn("_sizes", sizes(F.col(text)))
    columns = {out: F.element_at("_sizes", 1).cast("long")}
    if prompt_out:
        columns[prompt_out] = F.element_at("_sizes", 2).cast("long")
    return sized.withColumns(columns).drop("_sizes")
