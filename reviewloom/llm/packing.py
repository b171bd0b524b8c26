"""Filling fixed-capacity containers: packing by lexical retrieval.

1. *Measure.* Documents are tokenised once with a public tokenizer; sizes and
   term counts are written to the shared folder. A document longer than a
   container is cut into full containers and one rest; no other is cut.
2. *Count.* Document frequencies of all terms and the mean length are taken over
   all documents. Terms are token ids, so this table has as many rows as the
   tokenizer has ids, whatever the corpus.
3. *Shard.* Items are spread by hash over shards of about SHARD items, one
   partition each, so no task has two; only the last container or two of a shard
   can stay badly filled.
4. *Pack.* Each shard has a BM25 inverted index. The largest unused item is the
   seed of a container; its unused neighbours fill the container in the order of
   their scores, as long as the remaining space is wide; the last gap is closed
   with the neighbour that leaves the least space.

Defined cases: null and empty documents have size 0 and stand in the first
container of their shard; equal documents are packed each; ties go to the
smaller document id; a document of exactly one container is not cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import fresh_path

CAPACITY = 2048
SHARD = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's ranks expect text to be cut (a fixed value of that vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
K1, B = 1.2, 0.75
WIDE = 3  # the gap is closed by size once at most this share of the container (one in WIDE) is left


def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """key, size, terms (distinct token ids), counts; written once to the shared folder."""
    state: dict[str, object] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = state.setdefault("e", encoder(tokenizer))
        for pdf in batches:
            coded = enc.encode_ordinary_batch([t if isinstance(t, str) else "" for t in pdf["_text"]], num_threads=1)
            pairs = [np.unique(np.array(c, np.int32), return_counts=True) for c in coded]
            yield pd.DataFrame({key: pdf[key], "size": [len(c) for c in coded], "terms": [p[0] for p in pairs], "counts": [p[1].astype(np.int32) for p in pairs]})

    path = fresh_path(documents.sparkSession, "measured")
    rows = documents.select(key, F.col(text).alias("_text")).mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, size int, terms array<int>, counts array<int>")
    rows.write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def frequencies(sizes: DataFrame) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(terms, their document frequencies, number of documents, mean size) over all documents."""
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    df = sizes.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()
    return df["t"].to_numpy(np.int64), df["count"].to_numpy(np.int64), int(total["n"]), float(total["mean"] or 1.0)


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray, idf: dict[int, float], mean: float):
        doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        t = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float32) if counts else np.zeros(0, np.float32)
        norm = K1 * (1 - B + B * sizes[doc] / max(mean, 1e-9))
        self.vocab, code = np.unique(t, return_inverse=True)
        weight = np.array([idf.get(int(v), 0.0) for v in self.vocab], np.float32)[code] * tf * (K1 + 1) / (tf + norm)
        order = np.argsort(code, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.vocab)))])
        self.n = len(terms)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every item for a query of distinct terms."""
        k = np.searchsorted(self.vocab, terms)
        spans = [(self.start[i], self.start[i + 1]) for i in k]
        rows = np.concatenate([np.arange(a, z) for a, z in spans]) if spans else np.zeros(0, np.int64)
        return np.bincount(self.doc[rows], self.weight[rows], minlength=self.n)


def pack_shard(sizes: np.ndarray, terms: list[np.ndarray], index: Index, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item (sizes from 1 to ``capacity``)."""
    box = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    number, at = 0, 0
    free = np.ones(len(sizes), bool)
    while True:
        while at < len(order) and not free[order[at]]:
            at += 1
        if at == len(order):
            return box
        seed = int(order[at])
        box[seed], free[seed] = number, False
        left = capacity - int(sizes[seed])
        fits = np.flatnonzero(free & (sizes <= left))
        if len(fits):
            score = index.scores(terms[seed])[fits]
            rank = np.lexsort((-sizes[fits], -score))
            fits = fits[rank]
            size = sizes[fits]
            live = np.ones(len(fits), bool)
            while True:
                ok = np.flatnonzero(live & (size <= left))
                if not len(ok):
                    break
                big = ok[size[ok] * WIDE >= left]  # not the small ones, they close the gaps of the rest
                k = int(big[0]) if left * WIDE > capacity and len(big) else int(ok[size[ok].argmax()])
                live[k] = False
                j = int(fits[k])
                box[j], free[j] = number, False
                left -= int(size[k])
        number += 1


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(key, part, tokens, container, place): every part of every document with its container and its place in it."""
    sizes = measured(documents, key, text, tokenizer)
    term, df, n, mean = frequencies(sizes)
    table = documents.sparkSession.sparkContext.broadcast((term, np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), mean))
    shards = max(1, -(-n // shard))
    kind = dict(documents.dtypes)[key]
    rest = F.when(F.col("size") <= capacity, F.col("size")).otherwise(F.col("size") % capacity)
    rows = sizes.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), key, "size", rest.alias("rest"), "terms", "counts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, idf, mean_size = table.value
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        base = int(pdf["shard"].iloc[0]) << 32
        out, number = [], 0
        for k, size in zip(pdf[key], pdf["size"]):  # full containers of documents that exceed one
            if size > capacity:
                for part in range(size // capacity):
                    out.append((k, part, capacity, base + number, 0))
                    number += 1
        items = pdf[pdf["rest"] > 0].reset_index(drop=True)
        terms = [np.asarray(x, np.int64) for x in items["terms"]]
        index = Index(terms, [np.asarray(x) for x in items["counts"]], items["size"].to_numpy(), dict(zip(t.tolist(), idf.tolist())), mean_size)
        box = pack_shard(items["rest"].to_numpy(np.int64), terms, index, capacity) + number
        place: dict[int, int] = {}
        for k, size, rest_size, b in zip(items[key], items["size"], items["rest"], box.tolist()):
            out.append((k, size // capacity if size > capacity else 0, rest_size, base + b, place.get(b, 0)))
            place[b] = place.get(b, 0) + 1
        first = out[0][3] if out else base
        used = sum(1 for o in out if o[3] == first)
        for i, k in enumerate(pdf.loc[pdf["size"] == 0, key]):
            out.append((k, 0, 0, first, used + i))
        return pd.DataFrame(out, columns=[key, "part", "tokens", "container", "place"])

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield run(pd.concat(parts, ignore_index=True))

    return rows.repartitionById(shards, "shard").mapInPandas(one, f"{key} {kind}, part int, tokens int, container long, place int")
