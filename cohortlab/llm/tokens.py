"""Token counts of whole texts under a public subword tokenizer."""

from __future__ import annotations

import base64
import os
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie, and which one is used.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space of this length overflows the matcher of the ranks' library; such texts go through the same vocabulary's JSON form.
LONG_BLANKS = re.compile(r"\s{10000}")


def _tokenizer(path: str):
    """One tokenizer per Python worker, kept on ``sys`` because this module travels by value with each task."""
    _loaded = sys.__dict__.setdefault("_cohortlab_tokenizers", {})
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            encode = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _loaded[path] = lambda texts: [_tokenizer(path.replace(".tiktoken", ".json"))([t])[0] if LONG_BLANKS.search(t) else len(encode(t)) for t in texts]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def with_token_counts(documents: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """Add the number of tokens of each whole text; a null or empty text has 0. ``vocabulary`` is a file of ``folder``."""
    path = os.path.join(folder, vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _tokenizer(path)
        for texts in batches:
            yield pd.Series(sizes(texts.fillna("").tolist()), dtype="int64")

    # marked non-deterministic: a filter on the count would else be pushed below and count twice
    return documents.withColumn(name, count.asNondeterministic()(F.col(text)))
