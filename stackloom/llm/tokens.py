"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Vocabulary as tiktoken ranks; any file of that form may be given instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pattern that cuts texts before merging: the published one of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens and the columns of ``keep``: one row a document, in one narrow pass over whole texts.

    A null or empty text has no tokens. Strings that look like special tokens are
    ordinary text.
    """
    keep = keep or []
    fields = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = f"doc_id {fields[id_col]}, n_tokens bigint" + "".join(f", `{c}` {fields[c]}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(tokenizer)
        for pdf in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in pdf["__text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": sizes, **{c: pdf[c] for c in keep}})

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *keep).mapInPandas(run, schema)
