"""Words, hashes and small Spark helpers that the operators of this folder share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from marginalia.session import ensure_checkpoint_dir

# workers then need no copy of this folder on their path
cloudpickle.register_pickle_by_value(sys.modules["marginalia.llm"])

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none. ``bytes.split`` cuts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased; ``bytes.lower`` leaves all other characters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


class WordCodes(dict):
    """Hash of a word modulo ``rows``, kept for the words met last; emptied when ``most`` are held."""

    def __init__(self, rows: int, shift: int = 0, most: int = 50_000) -> None:
        super().__init__()
        self.rows, self.shift, self.most = rows, shift, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word) % self.rows + self.shift
        return code

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint16, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive words, built by doubling; empty below ``n`` words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    power, out, out_len, part, part_len = base, None, 0, h, 1
    while True:
        if n & part_len:
            if out is None:
                out, out_len = part, part_len
            else:
                # out covers out_len words, part the part_len words after them
                room = len(h) - out_len - part_len + 1
                out = out[:room] * np.uint64(pow(base, part_len, 1 << 64)) + part[out_len : out_len + room]
                out_len += part_len
        if out_len == n:
            return mix(out[: len(h) - n + 1])
        part = part[: len(h) - 2 * part_len + 1] * np.uint64(power) + part[part_len : len(h) - part_len + 1]
        part_len, power = 2 * part_len, pow(base, 2 * part_len, 1 << 64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read again: cuts the lineage like a checkpoint, column by column."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filter_texts(docs: DataFrame, test: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows whose texts pass, with all columns, whatever their names; ``test`` is made once per task and gets the texts of a batch."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def parts(rows: Iterable[tuple], size: Callable[[tuple], int], most: int) -> Iterator[list[tuple]]:
    """Lists of consecutive rows of at most ``most`` in size together; a larger row is a list of its own."""
    held, total = [], 0
    for row in rows:
        if held and total + size(row) > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += size(row)
    if held:
        yield held
