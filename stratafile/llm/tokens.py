"""Encoding of the whole corpus with a public tokenizer, by reuse of content-defined chunks."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import lookup_join, take
from ..session import arrow_map, settled

#: The folder of the tokenizers' files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Characters of a chunk: at least, on average beyond that, at most.
LEAST, MEAN, MOST = 256, 1024, 4096
#: A pretoken is settled once so many characters after its end are known: none of the tokenizer's patterns looks further.
AHEAD = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_points(text: str) -> list[int]:
    """Ends of a text's chunks. A cut follows where a rolling hash of the last 16 characters falls in a fixed share of its range, so equal passages are cut alike wherever they stand."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    step, factor = 1, _MIX
    with np.errstate(over="ignore"):
        while step < 16:
            longer = h.copy()
            longer[step:] += h[:-step] * factor
            h, factor, step = longer, factor * factor, 2 * step
        h = (h ^ (h >> np.uint64(29))) * _MIX
    where = np.flatnonzero(h < np.uint64(2**64 // MEAN)) + 1
    ends, last = [], 0
    while n - last > LEAST:
        k = int(np.searchsorted(where, last + LEAST))
        cut = int(where[k]) if k < len(where) else n
        last = min(cut, last + MOST, n)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


@functools.cache
def load(name: str, folder: str = TOKENIZERS):
    """A tokenizer of the tokenizers library; strings of its special tokens are ordinary text. Once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    return t


def encode_parts(t, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: its ids, the length of each pretoken in characters, and the number of its ids."""
    out = []
    for e in t.encode_batch(texts, add_special_tokens=False):
        words = np.array(e.word_ids, np.int32)
        # a pretoken ends where the number of the next one starts
        last = np.append(np.flatnonzero(words[1:] != words[:-1]), len(words) - 1) if len(words) else np.zeros(0, np.int64)
        ends = np.array(e.offsets, np.int32).reshape(-1, 2)[last, 1]
        out.append((np.array(e.ids, np.int32), np.diff(ends, prepend=0), np.diff(last, prepend=-1).astype(np.int32)))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            at, seq, keys, chunks = [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                last = 0
                for k, end in enumerate(cut_points(text or "")):
                    chunk = text[last:end]
                    at.append(i), seq.append(k), chunks.append(chunk)
                    keys.append(hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    last = end
                if not text:
                    at.append(i), seq.append(0), chunks.append(None), keys.append(None)
            own = part.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column("row"), own.column("doc_id"), pa.array(seq, pa.int32()), pa.array(keys, pa.binary()), pa.array(chunks, pa.string())],
                names=["row", "doc_id", "seq", "key", "chunk"],
            )


def _id_type(t) -> str:
    return "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"


def _encode(name: str, folder: str):
    """Packs ids and, of a chunk's pretokens, lengths and numbers of ids; a chunk has at most MOST characters, so two bytes hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(name, folder)
        kinds = (_id_type(t), "<u2", "<u2")
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                done = encode_parts(t, part.column("chunk").to_pylist())
                packed = [pa.array([d[k].astype(kind).tobytes() for d in done], pa.binary()) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *packed], names=["key", "ids", "chars", "counts"])

    return run


def join_chunks(t, pieces: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Ids of a whole text from its chunks in order, each with its own ids, and its pretokens' lengths and numbers of ids.

    A chunk's pretokens hold in the whole text up to the last end that AHEAD characters follow. From there the
    join is encoded anew over a window that reaches beyond the chunk and grows fourfold, over as many chunks as it takes, until one of its settled
    ends is also an end in the chunk that it falls into: as no pattern looks back, both go on alike from there. All
    windows before the last are together a third of it, so the work is linear in the text, also where it has no such end at all.
    """
    out: list[np.ndarray] = []
    k, begin = 0, 0  # the chunk, and the end (in characters) from which its own pretokens hold
    while k < len(pieces):
        text, ids, chars, counts = pieces[k]
        ends, upto = np.cumsum(chars), np.cumsum(counts)
        first = 0 if begin == 0 else int(upto[np.searchsorted(ends, begin)])
        if k == len(pieces) - 1:
            out.append(ids[first:])
            break
        last = int(np.searchsorted(ends, len(text) - AHEAD, "right")) - 1
        keep = max(begin, int(ends[last]) if last >= 0 else 0)
        if keep > begin:
            out.append(ids[first : int(upto[last])])
        tail = len(text) - keep
        # the chunks that the window has taken up, where each starts in it, and all the ends in them, as they are found there
        taken, joined, starts, bounds = [text[keep:]], tail, [], []
        reach = tail + 32
        while True:
            while joined < reach and k + 1 + len(starts) < len(pieces):
                following, _, theirs, _ = pieces[k + 1 + len(starts)]
                starts.append(joined)
                bounds.append(np.cumsum(theirs, dtype=np.int64) + joined)
                taken.append(following)
                joined += len(following)
            window = "".join(taken)
            taken = [window]
            w_ids, w_chars, w_counts = encode_parts(t, [window[:reach]])[0]
            if reach >= joined and k + 1 + len(starts) == len(pieces):
                out.append(w_ids)
                return np.concatenate(out)
            w_ends = np.cumsum(w_chars, dtype=np.int64)
            settled_ends = w_ends[(w_ends >= tail) & (w_ends + AHEAD <= min(reach, joined))]
            # both rise; a start is the end of the chunk before it, so the ends after the first start are all
            theirs_ends = np.concatenate([starts[:1], *bounds])
            agreed = theirs_ends[np.minimum(np.searchsorted(theirs_ends, settled_ends), len(theirs_ends) - 1)] == settled_ends
            if agreed.any():
                e = int(settled_ends[agreed.argmax()])
                out.append(w_ids[: int(np.cumsum(w_counts)[np.searchsorted(w_ends, e)])])
                here = int(np.searchsorted(starts, e, "right")) - 1
                k, begin = k + 1 + here, e - starts[here]
                break
            reach *= 4
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _assemble(name: str, folder: str):
    """Reads rows in the order of (row, part): of each chunk its text and then its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(name, folder)
        kind = _id_type(t)
        row, doc, chunk, pieces = None, None, None, []
        docs, ids = [], []

        def close() -> None:
            docs.append(doc)
            ids.append(join_chunks(t, pieces) if pieces else np.zeros(0, np.int32))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _lists(ids)], names=["doc_id", "ids"])
            docs.clear(), ids.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "part", "doc_id", "chunk", "ids", "chars", "counts")]
            for r, part, own, text, packed, chars, counts in zip(*columns):
                if r != row:
                    if row is not None:
                        close()
                    row, pieces = r, []
                if part % 2 == 0:
                    doc, chunk = own, text
                elif packed is not None:
                    pieces.append((chunk, np.frombuffer(packed, kind).astype(np.int32), np.frombuffer(chars, "<u2"), np.frombuffer(counts, "<u2")))
            if sum(map(len, ids)) > 1_000_000 or len(docs) > 5_000:
                yield flush()
        if row is not None:
            close()
        if docs:
            yield flush()

    return run


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids (list of integers) of every row's whole text, without special tokens; an empty list for NULL and empty texts.

    Texts are cut at content-defined points; each distinct chunk of the corpus is encoded once, wherever
    and however often it stands; then the chunks of a text are put together and every join is repaired
    by encoding it anew until both sides agree, so the ids equal those of the whole text. Rows with
    the same doc_id stay apart. An empty table gives no rows.

    Chunks are written to the shared folder once, as are the codes: no loss of an executor repeats them. A chunk that
    very many texts hold is broadcast to them (lookup_join), all others meet their texts by shuffle.
    tokenizer: a byte-level BPE file of the folder, by name.
    """
    rows = take(documents, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    chunks = settled(arrow_map(rows.select("row", "doc_id", "text"), _split, "row long, doc_id long, seq int, key binary, chunk string"))
    distinct = chunks.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("chunk").alias("chunk"))
    codes = settled(arrow_map(distinct, _encode(tokenizer, folder), "key binary, ids binary, chars binary, counts binary"))
    coded = lookup_join(chunks.where(F.col("key").isNotNull()).select("row", "seq", "key"), codes, ["key"]).drop("key")
    # texts and codes come together where they are joined: a text is shuffled with its own row, not with its keys
    texts = chunks.select("row", (F.col("seq") * 2).alias("part"), "doc_id", "chunk")
    parts = texts.unionByName(coded.select("row", (F.col("seq") * 2 + 1).alias("part"), "ids", "chars", "counts"), allowMissingColumns=True)
    return arrow_map(parts.repartition("row").sortWithinPartitions("row", "part"), _assemble(tokenizer, folder), "doc_id long, ids array<int>")
