"""Embedders: from property lines to vectors, and the stored collections they fill."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.scratch import delete_path, read_text, write_text, written

# The models that are taken where none is named.
DEFAULT_MODEL, SMALL_MODEL = "sentence-transformers/all-mpnet-base-v2", "sentence-transformers/all-MiniLM-L6-v2"


class Embedder(Protocol):
    """Anything that turns a list of texts into vectors of one width; ``name`` tells stores apart."""

    name: str
    width: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...


class LexicalEmbedder:
    """Hashed character n-grams with logarithmic counts, at length 1. It needs no weights and no network."""

    def __init__(self, width: int = 256, sizes: tuple[int, ...] = (3, 4)):
        self.width, self.sizes = width, sizes
        self.name = f"lexical2-{width}-{'-'.join(map(str, sizes))}"

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0].tolist()

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        own = [f" {' '.join((t or '').lower().split())} ".encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"".join(own), np.uint8).astype(np.uint64)
        sizes = np.array([len(x) for x in own], np.int64)
        row, left = np.repeat(np.arange(len(own)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
        counts = np.zeros(len(own) * self.width)
        for n in self.sizes:
            h = np.full(max(0, len(data) - n + 1), n, np.uint64)
            for i in range(n):
                h = (h ^ data[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = np.flatnonzero(left[: len(h)] >= n)  # grams that end in their own text
            place = row[inside] * self.width + (h[inside] % np.uint64(self.width)).astype(np.int64)
            counts += np.bincount(place, minlength=len(counts))
        out = np.log1p(counts).reshape(len(own), self.width)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


class LetterEmbedder:
    """How often each of a-z and 0-9 occurs, whatever the case: small vectors that SQL can compute too."""

    name, width = "letters-36", 36

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        own = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        data = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
        place = np.where((data >= 97) & (data < 123), data - 97, np.where((data >= 48) & (data < 58), data - 22, -1))
        known = place >= 0
        return np.bincount(row[known] * 36 + place[known], minlength=36 * len(own)).reshape(len(own), 36).astype(float)


class TransformerEmbedder:
    """A transformer model by name, where the libraries and weights are installed.

    ``pooling``: ``mean`` averages the last hidden state over the attention mask, ``pooler`` takes
    the pooled output if the model has one. Texts are cut at ``max_tokens``.
    """

    def __init__(self, model: str = DEFAULT_MODEL, pooling: str = "mean", normalise: bool = False, max_tokens: int = 512, width: int = 768, batch: int = 32):
        self.name, self.model, self.pooling, self.normalise = f"transformer-{model}-{pooling}-{normalise}", model, pooling, normalise
        self.max_tokens, self.width, self.batch = max_tokens, width, batch

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        try:
            import torch
            from transformers import AutoModel, AutoTokenizer
        except ImportError as missing:
            raise RuntimeError("this embedder needs torch and transformers") from missing
        if not hasattr(self, "_loaded"):
            self._loaded = AutoTokenizer.from_pretrained(self.model), AutoModel.from_pretrained(self.model).eval()
        tokenizer, model = self._loaded
        parts = []
        for i in range(0, len(texts), self.batch):
            inputs = tokenizer(texts[i : i + self.batch], padding=True, truncation=True, max_length=self.max_tokens, return_tensors="pt")
            with torch.no_grad():
                out = model(**inputs)
            pooled = getattr(out, "pooler_output", None) if self.pooling == "pooler" else None
            if pooled is None:
                mask = inputs["attention_mask"].unsqueeze(-1).float()
                pooled = (out.last_hidden_state * mask).sum(1) / mask.sum(1).clamp(min=1e-9)
            parts.append(pooled.float().cpu().numpy())
        found = np.concatenate(parts) if parts else np.zeros((0, self.width))
        if self.normalise:
            found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        return found


def embedded(text: Column, embedder: Embedder) -> Column:
    """A text column as vectors, by Arrow batches; a null text is an empty one."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed_documents(texts.fillna("").tolist())), index=texts.index)

    return embed(text)


class CollectionExists(Exception):
    """The collection has vectors and was not to be filled anew."""


class VectorRuns:
    """A growing store of vectors by their texts, for one embedder, in a shared folder.

    Each addition embeds only the texts that no run holds and writes them as a run of the lowest level;
    when a level has ``fanout`` runs they are merged into one of the next, so a store of n additions
    has about fanout * log(n) runs. The manifest names the runs and is replaced at the end of each
    change: what a lost driver has left half done is in folders that it does not name, which
    ``tidy`` deletes. One application adds at a time. A null text is the empty one.
    """

    _ROWS = "key binary, text string, vector array<double>, addition bigint"

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, fanout: int = 8):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder
        known = read_text(spark, f"{self.path}/manifest.json")
        state = json.loads(known) if known else {"embedder": embedder.name, "fanout": max(2, fanout), "additions": 0, "levels": []}
        if state["embedder"] != embedder.name:
            raise ValueError(f"{path} holds vectors of {state['embedder']}, not of {embedder.name}")
        self.fanout, self.additions, self.levels = state["fanout"], state["additions"], state["levels"]

    def _save(self) -> None:
        state = {"embedder": self.embedder.name, "fanout": self.fanout, "additions": self.additions, "levels": self.levels}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(state))

    def _runs(self) -> list[str]:
        return [f"{self.path}/{run}" for level in self.levels for run in level]

    @staticmethod
    def key(text: Column) -> Column:
        return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))

    def contents(self) -> DataFrame:
        """key, text, vector and addition (which one, from 1, brought it) of every text."""
        runs = self._runs()
        return self.spark.read.schema(self._ROWS).parquet(*runs) if runs else self.spark.createDataFrame([], self._ROWS)

    def add(self, texts: DataFrame, text: str = "text") -> int:
        """Embed the texts that are new and add them as one run; returns how many these are."""
        own = texts.select(self.key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
        fresh = own.join(self.contents().select("key"), "key", "left_anti")
        run = f"run-{uuid.uuid4().hex}"
        number = F.lit(self.additions + 1).cast("bigint")
        rows = written(fresh.select("key", "text", embedded(F.col("text"), self.embedder).alias("vector"), number.alias("addition")), f"{self.path}/{run}")
        n = rows.count()
        self.additions += 1
        old: list[str] = []
        if n:
            self._put(0, run, old)
        self._save()
        for path in [*old, *([] if n else [f"{self.path}/{run}"])]:
            delete_path(self.spark, path)
        return n

    def _put(self, level: int, run: str, old: list[str]) -> None:
        """Name the run; a full level is merged into one run of the next. ``old`` gathers the folders that are to go."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, parts = f"run-{uuid.uuid4().hex}", [f"{self.path}/{r}" for r in self.levels[level]]
            written(self.spark.read.schema(self._ROWS).parquet(*parts), f"{self.path}/{merged}", small=True)
            old += parts
            self.levels[level] = []
            self._put(level + 1, merged, old)

    def vectors(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with the column vector, of the texts that the store holds (others: null)."""
        known = self.contents().select(F.col("key").alias("__key"), "vector")
        return rows.drop("vector").withColumn("__key", self.key(F.col(text))).join(known, "__key", "left").drop("__key")

    def tidy(self) -> int:
        """Delete the runs that the manifest does not name; returns how many."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
        stray = [f.getPath().toString() for f in found if f.isDirectory() and f.getPath().getName() not in {r.rsplit("/", 1)[1] for r in self._runs()}]
        for path in stray:
            delete_path(self.spark, path)
        return len(stray)


class VectorStore:
    """Collections of (id, target_ord, text, vector) as Parquet folders, one for each content and embedder.

    ``id`` tells the rows of a collection apart, which may hold several models with the same ordinals.

    A folder's name carries a hash of the texts and the embedder's name, so a changed model never
    meets old vectors. The vectors themselves come from one growing store for each embedder, so a
    collection that differs from others in a few lines has only these embedded.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def runs(self, embedder: Embedder) -> VectorRuns:
        return VectorRuns(self.spark, f"{self.root}/vectors-{hashlib.sha256(embedder.name.encode()).hexdigest()[:32]}", embedder)

    def path(self, texts: DataFrame, embedder: Embedder) -> str:
        row = [F.xxhash64(F.lit(seed), F.col("target_ord"), F.col("text").isNull(), F.col("text")).cast("decimal(20,0)") for seed in (1, 2)]
        digest = texts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(row)]).first()
        return f"{self.root}/{hashlib.sha256(f'{digest.n}:{digest.h0}:{digest.h1}:{embedder.name}'.encode()).hexdigest()[:32]}"

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def populate(self, texts: DataFrame, embedder: Embedder, force: bool = False, must_be_new: bool = False) -> DataFrame:
        """Store the texts with their vectors unless they are there; ``force`` embeds and writes them anew."""
        path = self.path(texts, embedder)
        if self._exists(path):
            if must_be_new:
                raise CollectionExists(path)
            if not force:
                return self.spark.read.parquet(path)
        rows = texts.select("target_ord", "text")
        if force:
            held = rows.withColumn("vector", embedded(F.col("text"), embedder))
        else:
            runs = self.runs(embedder)
            runs.add(rows)
            held = runs.vectors(rows)
        held.select(F.monotonically_increasing_id().alias("id"), "target_ord", "text", "vector").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def batches(rows: DataFrame, ordinal: str, size: int) -> DataFrame:
    """The number of each row's batch of ``size``, by its ordinal."""
    if size < 1:
        raise ValueError("size must be positive")
    return rows.withColumn("batch", F.floor(F.col(ordinal) / size).cast("bigint"))
