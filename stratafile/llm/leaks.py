"""Evaluation texts leaking into training text."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import small_join, spread_join, take
from ..session import arrow_map, settled, ship

#: Words that must agree in a row.
WORDS = 13
#: Bytes of the items' n-gram hashes that are broadcast at once, 8 each; more are taken in blocks. Rows that a worker gives at once.
BLOCK_BYTES, AT_ONCE = 64_000_000, 10_000

_FORMAT, _WORD, _ASCII_WORD = regex.compile(r"\p{Cf}+"), regex.compile(r"[\p{L}\p{N}]+"), regex.compile(r"[a-z0-9]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC, removal of format characters and lower-casing."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower())


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n words in a row, from hashes or numbers of the words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, power, span, out, done = (words.astype(np.uint64) + np.uint64(1)) * _FACTOR, _FACTOR, 1, None, 0
        factor = np.uint64(1)
        left = n
        while left:  # n in binary: spans of 1, 2, 4, ... words, each from two of the last
            if left & 1:
                part = h[done : done + len(words) - n + 1] * factor
                out = part if out is None else out + part
                done, factor = done + span, factor * power
            left >>= 1
            if left:
                h = h[:-span] + h[span:] * power
                power, span = power * power, 2 * span
        return out ^ (out >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered; they need no shared vocabulary. What is remembered has a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = h
        return h

    def windows(self, words: list[str], n: int) -> np.ndarray:
        return window_hashes(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)), n)


_GRAM = "h long, gram string"


def _item_grams(n: int):
    """Every window of an item's words, with its hash; a gram is its words joined by blanks, which no word holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                h = memo.windows(words, n).view(np.int64)
                for start in range(0, len(h), AT_ONCE):
                    part = h[start : start + AT_ONCE]
                    grams = [" ".join(words[i : i + n]) for i in range(start, start + len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(grams, pa.string()), pa.array([item] * len(part), pa.int64())], names=["h", "gram", "item_id"])

    return run


def item_grams(benchmark: DataFrame, words: int) -> DataFrame:
    """h, gram and item_id of the windows of all items, once each, settled."""
    items = take(benchmark, "item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    return settled(arrow_map(items, _item_grams(words), f"{_GRAM}, item_id long").distinct())


def _stretches(text: str) -> tuple[list[str], list[str], list[int]]:
    """A text's parts (white space and what is between it), its words, and the part that each word is in."""
    parts = regex.split(r"([ \t\r\n]+)", text)
    words, part_of = [], []
    for i, part in enumerate(parts):
        for w in words_of(part):
            words.append(w), part_of.append(i)
    return parts, words, part_of


def _scan(known, n: int, places: bool):
    """Windows of texts whose hash is among the known ones: of each text (key) each distinct gram, or with places every one and its first word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, memo = np.frombuffer(known.value, np.uint64), WordHashes()
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                words = _stretches(text)[1] if places else words_of(text)
                h = memo.windows(words, n)
                if not len(h):
                    continue
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                hit = np.flatnonzero(hashes[at] == h)
                if not places and len(hit):
                    hit = hit[np.unique(h[hit], return_index=True)[1]]
                for start in range(0, len(hit), AT_ONCE):
                    part = hit[start : start + AT_ONCE]
                    columns = [pa.array([key] * len(part), pa.int64()), pa.array(h[part].view(np.int64)), pa.array([" ".join(words[i : i + n]) for i in part.tolist()], pa.string())]
                    names = ["key", "h", "gram"]
                    if places:
                        columns.append(pa.array(part.astype(np.int32)))
                        names.append("place")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def hits(texts: DataFrame, grams: DataFrame, words: int, block_bytes: int, places: bool = False) -> DataFrame:
    """Windows of texts (key, text) whose hash is that of a gram: key, h, gram, and with places the place; settled. Equal hashes of other words are still among them.

    The distinct hashes go to the workers as one sorted array of 8 bytes each, if that is within block_bytes, else in as many blocks, split by hash,
    the texts being scanned once for each. So no window is shuffled before it is known to be a likely hit, and what is broadcast has a bound at any size.
    """
    spark = texts.sparkSession
    ship(spark)
    hashes = settled(grams.select("h").distinct())
    blocks = max(1, math.ceil(8 * hashes.count() / max(8, block_bytes)))
    schema = f"key long, {_GRAM}" + ", place int" * places
    out = None
    for k in range(blocks):
        own = hashes.where(F.pmod(F.col("h"), F.lit(blocks)) == k) if blocks > 1 else hashes
        known = np.sort(own.toArrow().column("h").to_numpy().view(np.uint64))
        if not len(known):
            continue
        shared = spark.sparkContext.broadcast(known.tobytes())
        found = settled(arrow_map(texts, _scan(shared, words, places), schema))
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def leaked_items(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and item_id of every document that holds at least `words` consecutive words of an item, once each.

    Words are the maximal runs of letters and digits after NFKC, removal of format characters and lower-casing, of whole texts of any length. Items with
    fewer words can't leak; NULL and empty texts neither match nor are matched, nor do items without an id; an empty table gives no rows.

    Hashes of the items' n-grams are broadcast (hits), each text's windows are hashed in one vector pass and looked up, and every hit is verified by
    joining its words to the items' n-grams; an n-gram that very many documents or items hold is spread (spread_join).
    """
    grams = item_grams(benchmark, words)
    texts = take(documents, "doc_id", "text").where(F.col("text").isNotNull()).withColumnRenamed("doc_id", "key")
    pairs = spread_join(hits(texts, grams, words, block_bytes), grams, ["h", "gram"])
    return pairs.select(F.col("key").alias("doc_id"), "item_id").distinct()


def _cut(text: str, places: list[int], n: int) -> str:
    """A text without the windows that start at these words; taken out are whole stretches between white space."""
    parts, _, part_of = _stretches(text)
    gone: set[int] = set()
    for i in places:
        gone.update(range(part_of[i], part_of[i + n - 1] + 1))
    return "".join(p for i, p in enumerate(parts) if i not in gone)


def _cleaned(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(t, places, n) if places else t for t, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def without_leaks(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and text of every document, with the passages that leaked taken out (whole stretches between white space). Other texts, NULL and empty included, stay as they are; rows with one doc_id stay apart.

    Hits are found and verified as by leaked_items. The places of a text's hits, no more than it has words, go back to its row; they are broadcast
    if they are few.
    """
    grams = item_grams(benchmark, words)
    rows = settled(take(documents, "doc_id", "text").withColumn("key", F.monotonically_increasing_id()))
    found = hits(rows.where(F.col("text").isNotNull()).select("key", "text"), grams, words, block_bytes, places=True)
    true = small_join(found, grams.select("h", "gram").distinct(), ["h", "gram"])
    places = settled(true.groupBy("key").agg(F.collect_set("place").alias("places")))
    return arrow_map(small_join(rows, places, ["key"], "left").select("doc_id", "text", "places"), _cleaned(words), "doc_id long, text string")
