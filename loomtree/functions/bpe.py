"""Tokens of a public byte-level tokenizer's rank file, whose path is a parameter."""

from __future__ import annotations

import base64
import os
from functools import cache

from pyspark.sql import SparkSession

#: Where the rank file is looked for unless a path is given.
RANKS = os.environ.get("LOOMTREE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def shipped(spark: SparkSession, path: str = RANKS) -> str:
    """Sends the rank file along with the job, once per application; the name by which ``encoding`` finds it anywhere."""
    sent = getattr(spark.sparkContext, "_loomtree_files", None)
    if sent is None:
        sent = spark.sparkContext._loomtree_files = set()
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)
    return os.path.basename(path)


@cache
def encoding(name: str = RANKS):
    """The tokenizer of a rank file, one per Python worker: a path, or the name of a shipped file."""
    import tiktoken
    from pyspark import SparkFiles

    with open(name if os.path.isabs(name) else SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
