"""Token counts by a sentencepiece BPE model, with a shortcut for whole tokens.

Merges of this kind of model never cross from a non-space into a space mark,
provided that no vocabulary string does; that is proved when the model is
loaded. A text therefore falls into pre-tokens, each some space marks and what
follows up to the next one, that encode independently. Vocabulary strings that
the library encodes alone as one token are collected then too (the whole-token
set); pre-tokens in it count one, only the rest go through merges, once for each
distinct one in a bounded memory.

Null or empty text has no tokens. Repeated rows stay repeated.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrellis.llm.session import short_batches

SPACE = "▁"
LIMIT = 4096
#: Distinct pre-tokens remembered by a worker, and the longest remembered.
MEMORY = 400_000
LONGEST = 256
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LOADED: dict[str, "Counter"] = {}


class Counter:
    """Counts tokens as sentencepiece's encode() gives them without options."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and self.model.normalize("a  b\tﬁ ") == f"{SPACE}a{SPACE}{SPACE}b\tﬁ{SPACE}"
        marked = [p for p in pieces if p.startswith(SPACE) and len(p) > 1]
        alone = self.model.encode([p[1:] for p in marked], num_threads=1)
        self.whole = {p: 1 for p, ids in zip(marked, alone) if len(ids) == 1} | {SPACE: 1}
        self.seen: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text, num_threads=1))
        total, rest = 0, []
        whole, seen = self.whole, self.seen
        for p in _PRETOKEN.findall(SPACE + text.replace(" ", SPACE)):
            n = whole.get(p) or seen.get(p)
            if n is None:
                rest.append(p)
            else:
                total += n
        if rest:
            if len(seen) > MEMORY:
                seen.clear()
            for p, ids in zip(rest, self.model.encode([p[1:] for p in rest], num_threads=1)):
                total += len(ids)
                if len(p) <= LONGEST:
                    seen[p] = len(ids)
        return total


def counter(model_path: str):
    """A Pandas UDF from text to its number of tokens; the model (0.5 MB) goes with the task."""
    with open(model_path, "rb") as f:
        model_bytes = f.read()

    @F.pandas_udf("bigint")
    def count(text: pd.Series) -> pd.Series:
        if model_path not in _LOADED:
            _LOADED[model_path] = Counter(model_bytes)
        c = _LOADED[model_path]
        return pd.Series([c.count(t) for t in text], dtype="int64")

    return count


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""
    short_batches(docs.sparkSession)
    n = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counter(model_path)(F.col("text").cast("string")).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
