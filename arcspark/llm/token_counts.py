"""Token counts by a two-tier map-side lookup.

Tier one is a compact table, broadcast, of the pre-tokens that the tokenizer's
own merges rank as frequent, with their lengths in tokens: one string of words
and one of bytes, bounded by the vocabulary, without a pass over the corpus.
Tier two is a bounded cache in each Python worker for everything else, filled
by encoding each missing pre-token once. No pre-token is ever shuffled: the
operator is one map over the texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm import pretoken
from arcspark.llm.common import id_and_text

#: Pre-tokens that a worker's cache keeps beside the frequent ones.
WORKER_CACHE = 300_000

_state: dict = {}


def frequent_lengths(tokenizer_file: str) -> tuple[str, bytes]:
    """The vocabulary's whole words (those that end a word), a line each, and their lengths in tokens, a byte each."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file)
    words = sorted(w[:-4] for w in tok.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha())
    return "\n".join(words), bytes(len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False))


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows, and rows
    without an id, are counted each; an empty table gives no rows; other
    columns are not looked at. Texts are taken whole: a task holds the
    pre-tokens of one at a time, some 60 bytes each.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer_file))

    def count(batches):
        if tokenizer_file not in _state:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_file)
            _state[tokenizer_file] = tok, pretoken.Cache(lambda w: len(tok.encode(w, add_special_tokens=False).ids), dict(zip(frequent.value[0].split("\n"), frequent.value[1], strict=True)), WORKER_CACHE)
        tok, cache = _state[tokenizer_file]
        get = cache.take().__getitem__
        for batch in batches:
            n_tokens = []
            for text in batch.column(1).to_pylist():
                if (words := pretoken.split(text, "word_end")) is not None:
                    n_tokens.append(sum(map(get, words)))
                else:
                    n_tokens.append(len(tok.encode(text, add_special_tokens=False).ids))
            yield pa.record_batch([batch.column(0), pa.array(n_tokens, pa.int64())], ["doc_id", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))

    def with_bytes(batches):
        for batch in batches:
            for out in count([batch]):
                yield pa.record_batch([out.column(0), batch.column(2), out.column(1)], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(with_bytes, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
