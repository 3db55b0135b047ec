"""Public tokenizers by path; each Python worker loads one once."""

from __future__ import annotations

import base64
import functools
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.shared import ship_package

TOKENIZER_DIR = os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers")


@functools.lru_cache(maxsize=4)
def _counter(path: str):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import tiktoken

    # Fixed value: the pre-tokenisation pattern published with these ranks.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens`` of whole texts; a NULL text has 0 tokens. Lone surrogates count as the
    replacement character."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(tokenizer)
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "replace").decode("utf-8") for t in pdf["__t"]]
            yield pdf[["__i"]].assign(n=count(texts)).rename(columns={"__i": "doc_id", "n": "n_tokens"})

    ship_package(df.sparkSession)
    kind = df.select(doc_id).schema[0].dataType.simpleString()
    return df.select(F.col(doc_id).alias("__i"), F.col(text).alias("__t")).mapInPandas(run, f"doc_id {kind}, n_tokens long")
