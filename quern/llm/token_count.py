"""Operator 1: token counts of whole texts by a map-side two-tier lookup.

Pre-tokens are the white-space-separated words: the tokenizer drops white space and never joins across it, so a text's count is
the sum of its words' counts. Tier one is a broadcast table of word hashes and lengths (TABLE_WORDS * 9 bytes) of the most
frequent words, which a frequent-items sketch over all texts finds; only sketches are merged, never words. Words that the table
lacks, long ones among them, go through a cache in each worker, and what the cache lacks is encoded in batches. Everything runs where the text
is; no pre-token is shuffled. Which words are in the table affects the time only, never a count.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, hashed_words, steps, text_column, words

TABLE_WORDS = 1 << 14
#: Items that the frequent-items sketch tracks, of at most so many bytes each (so 4 MB); sketches are merged in MERGERS tasks, then in one.
TRACKED, TRACKED_BYTES = 1 << 15, 64
MERGERS = 256
#: Words in one worker's cache; it is emptied when full.
CACHE_WORDS = 1 << 19
LIMIT = 2048
#: A single one of these after an ASCII letter is a token of its own.
_TAIL = np.zeros(256, bool)
_TAIL[[ord(x) for x in ",."]] = True
_WORKER: dict = {}
#: Texts whose words are joined, cased and parted in ways that tokenizers differ in.
PROBES = ("The River, the RIVER", "one two  three", " Lead and trail ", "line\nline\tTab", "It's 12,345.67 (or so)!", "UPPER lower MiXeD")


def _tokenizer(spec: str):
    """The library's tokenizer, made once in a process."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if _WORKER.get("spec") != hash(spec):
        made = Tokenizer.from_str(spec)
        made.no_padding()
        made.no_truncation()
        _WORKER.update(spec=hash(spec), tokenizer=made, cache={}, tail=all(len(made.encode("a" + x, add_special_tokens=False).ids) == 2 for x in ",."))
    return _WORKER["tokenizer"]


def check_separable(tokenizer) -> None:
    """Refuses a tokenizer whose counts aren't the sums of those of the lower-cased words between white space."""
    for text in PROBES:
        if sum(_encoded_lengths(tokenizer, [w.lower() for w in text.split()])) != _encoded_lengths(tokenizer, [text])[0]:
            raise ValueError("the tokenizer must fold case and part texts at white space, which it drops")


def _encoded_lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def frequent_words(docs: DataFrame) -> list[str]:
    """The most frequent words of all texts by a mergeable sketch, lower-cased and without a comma or point at the end."""
    each = docs.select(F.explode(words(F.lower(text_column(docs)))).alias("w")).select(F.rtrim("w", F.lit(",.")).alias("w")).filter((F.col("w") != "") & (F.octet_length("w") <= TRACKED_BYTES))
    parts = each.groupBy((F.spark_partition_id() % MERGERS).alias("k")).agg(F.expr(f"approx_top_k_accumulate(w, {TRACKED})").alias("sketch"))
    merged = parts.groupBy(F.lit("all").alias("of")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))  # no words, no row
    rows = merged.select(F.expr(f"approx_top_k_estimate(sketch, {TABLE_WORDS})").alias("top")).collect()
    return [x.item for r in rows for x in r.top or [] if x.item is not None]


def build_table(spec: str, frequent: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and token counts."""
    frequent = [w for w in frequent if not set(w) & set(BLANKS) and "<|" not in w]
    raw = [w.encode() for w in frequent]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    value = hashed_words(np.frombuffer(b"".join(raw), np.uint8), at)[3]
    length = np.array(_encoded_lengths(_tokenizer(spec), frequent), np.uint8 if not frequent else np.int64)
    keep = length < 256
    order = np.argsort(value[keep], kind="stable")
    return value[keep][order], length[keep][order].astype(np.uint8)


def count_step(tokenizer, table: tuple[np.ndarray, np.ndarray], special: list[bytes], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens of each text of one step."""
    keys, lengths = table
    start, end, row, value, cut = hashed_words(data, at, tail=_TAIL if _WORKER["tail"] else None)
    n = np.zeros(len(start), np.int64)
    if len(keys):
        place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
        hit = keys[place] == value
        n[hit] = lengths[place[hit]]
    else:
        hit = np.zeros(len(start), bool)
    miss = np.flatnonzero(~hit)
    if len(miss):
        one, first, inverse = np.unique(value[miss], return_index=True, return_inverse=True)
        cache = _WORKER["cache"]
        known = [cache.get(x, -1) for x in one.tolist()]
        new = [k for k, x in enumerate(known) if x < 0]
        if new:
            raw = data.tobytes()
            texts = [raw[start[miss[first[k]]] : end[miss[first[k]]]].decode("utf-8", "replace") for k in new]
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
            for k, x in zip(new, _encoded_lengths(tokenizer, texts), strict=True):
                known[k] = cache[int(one[k])] = x
        n[miss] = np.array(known, np.int64)[inverse]
    out = np.bincount(row, weights=n + cut, minlength=len(at) - 1).astype(np.int64)
    # A special token's string counts as that token wherever it stands, and only in its exact case: whole text to the library.
    whole = data.tobytes()
    if any(s in whole for s in special):
        for r in range(len(at) - 1):
            text = whole[at[r] : at[r + 1]]
            if any(s in text for s in special):
                out[r] = _encoded_lengths(tokenizer, [text.decode("utf-8", "replace")])[0]
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    docs: doc_id, text, others ignored; one row per input row, repeated rows and null ids included. Null text is empty.
    tokenizer_path: a file of the tokenizers library, read by the driver, of a tokenizer that folds case and parts texts at white space (any
    other is refused with a ValueError). The counts are those of the library's default encoding without added special tokens, truncation or
    padding.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    special = [x["content"].encode() for x in json.loads(spec).get("added_tokens", [])]
    check_separable(_tokenizer(spec))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((spec, special, build_table(spec, frequent_words(docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, special, table = sent.value
        tokenizer = _tokenizer(spec)
        for batch in batches:
            sizes, counts = [], []
            for _, _, data, at in steps(batch.column("text")):
                sizes.append(np.diff(at))
                counts.append(count_step(tokenizer, table, special, data, at))
            n_bytes, n_tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_column(docs).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
