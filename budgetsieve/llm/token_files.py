"""Token ids as files: frequency-ranked codes, byte-aligned lengths, separate control bytes.

Every text is encoded once, where it is read, and its raw ids are written to the shared folder, with each
task's counts of ids behind them. The corpus-wide count of each id gives its code: the most frequent id
gets code 0, ties go to the smaller id, so that common ids take one byte. Raw ids, not texts, are then
dealt in ranges of doc_id. A block of documents is a row of three byte strings: the documents'
lengths, control bytes (four 2-bit lengths each) and the codes' bytes. Blocks are written in
ascending doc_id order; a reader looks the lengths up in a 256-row table and
gathers the codes with numpy.

Null texts count as empty: such a document holds only the end id. Repeated rows stay separate documents,
in the order of their lengths and ids; documents without a doc_id come first. Empty tables give empty ones.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.llm.common import chunked, materialise, own_cache, prepare, text_or_empty

#: Ids in one block; a longer document has a block of its own.
BLOCK_IDS = 262_144
#: Words whose ids a worker remembers and their characters, and characters of text it takes at a time.
CACHE_ENTRIES, CACHE_BYTES, BATCH_BYTES = 1_500_000, 24_000_000, 8_000_000
#: Longer words go through the whole tokenizer, so that no piece of them is remembered.
LONGEST = 64

#: Row c: the four byte lengths that control byte c stands for, first code in the lowest bits.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)

#: A document's raw ids, two or four bytes each; a task's counts of ids come in a row with n_tokens -1.
RAW = "known boolean, doc_id long, n_tokens long, ids binary"
COUNTS = np.dtype([("id", "<u4"), ("n", "<i8")])
#: The first n_unknown documents of a block have no doc_id.
BLOCKS = "part int, first_id long, n_ids long, n_unknown long, doc_ids binary, lengths binary, control binary, data binary"


def pack(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit codes."""
    codes = codes.astype("<u4", copy=False)
    more = np.zeros(len(codes) + -len(codes) % 4, np.uint8)
    width = 4 if int(codes.max(initial=0)) > 0xFFFF else 2
    for low in (0xFF, 0xFFFF, 0xFFFFFF)[: width - 1]:
        more[: len(codes)] += codes > low
    four = more.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = codes.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return control.tobytes(), raw[np.arange(width, dtype=np.uint8) <= more[: len(codes), None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n codes."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    codes = raw[at].astype(np.uint32)
    for i in range(1, int(length.max(initial=1))):
        longer = np.flatnonzero(length > i)
        codes[longer] |= raw[at[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return codes


#: ASCII marks other than the apostrophe. Letters with marks behind them are one or two pre-tokens.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters whose lower case depends on what surrounds them, or is longer.
_SPECIAL_CASE = re.compile("[\u03a3\u0130]")
#: The usual byte alphabet: visible Latin-1 characters stand for themselves, the others follow from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


class WordTokens:
    """Ids of texts by a tokenizer that never joins across white space: each distinct word once.

    Arrow splits a batch of texts and finds its distinct words, so that Python meets each of these once.
    A word gets the next row of a table of ids on first sight; a batch of texts is then an array of
    rows, and its ids are gathered from the table at once. Words of letters with marks behind them are
    two pieces, which share a table of their own.
    """

    def __init__(self, path: str, cache: int = CACHE_ENTRIES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether runs of letters (lower-cased) and of marks go to the model by themselves.
        plain = [t.id for p in ("pl" + "é".encode().decode("latin-1").translate(_BYTE_CHARS), "!.") for t in self.tokenizer.model.tokenize(p)]
        self.plain = self.tokenizer.encode("PlÉ!.", add_special_tokens=False).ids == plain
        self._forget()

    def _forget(self) -> None:
        self.rows, self.pieces = _Rows(), _Rows()
        self.words, self.parts = _Table(), _Table()
        self.held = 0

    def _piece_rows(self, pieces: pa.Array) -> np.ndarray:
        """Rows of pieces in their table; those not met before go to the model."""
        coded = pieces.dictionary_encode()
        known = len(self.pieces)
        rows = np.fromiter(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        if len(self.pieces) > known:
            model = self.tokenizer.model.tokenize
            each = [[t.id for t in model(p)] if p else [] for p in islice(self.pieces, known, None)]
            self.parts.add(*_joined(each))
        return rows[coded.indices.to_numpy()]

    def _learn(self, words: list[str]) -> None:
        """Appends the ids of words to the table: plain words by their pieces, others by the whole tokenizer."""
        column = pa.array(words, pa.large_string())
        cores = pc.utf8_rtrim(column, characters=_MARKS)
        short = pc.less_equal(pc.utf8_length(column), LONGEST)
        plain = pc.and_(pc.ascii_is_alpha(cores), short).to_numpy(zero_copy_only=False) & self.plain
        lower = pc.ascii_lower(cores)
        accented, written = [], []  # words of letters that aren't all ASCII, and how the model writes them
        if self.plain:
            candidates = np.flatnonzero(pc.and_not(short, pc.string_is_ascii(cores)).to_numpy(zero_copy_only=False))
            normal, special = unicodedata.is_normalized, _SPECIAL_CASE.search
            for k, core in zip(candidates.tolist(), cores.take(pa.array(candidates)).to_numpy(zero_copy_only=False)):
                if core.isalpha() and not special(core) and normal("NFC", core):
                    accented.append(k)
                    written.append(core.lower().encode().decode("latin-1").translate(_BYTE_CHARS))
        by_model = np.concatenate((np.flatnonzero(plain), np.array(accented, np.int64)))
        others = np.ones(len(words), bool)
        others[by_model] = False
        others = np.flatnonzero(others)
        core_rows = self._piece_rows(pa.concat_arrays([lower.filter(pa.array(plain)), pa.array(written, pa.large_string())]))
        bytes_of = pc.binary_length(column).to_numpy() - pc.binary_length(cores).to_numpy()
        tailed = np.flatnonzero(bytes_of[by_model])
        tails = [words[k][-n:] for k, n in zip(by_model[tailed].tolist(), bytes_of[by_model[tailed]].tolist())]  # marks are ASCII
        tail_rows = np.full(len(by_model), self._piece_rows(pa.array([""], pa.large_string()))[0])
        tail_rows[tailed] = self._piece_rows(pa.array(tails, pa.large_string()))
        ids, size = self.parts.gather(np.stack((core_rows, tail_rows), axis=1).reshape(-1))
        found = self.tokenizer.encode_batch([words[k] for k in others.tolist()], add_special_tokens=False)
        other_ids, other_size = _joined([e.ids for e in found])
        # the table has the words in their order, its ids lie in the order of by_model and others
        sizes = np.concatenate((size.reshape(-1, 2).sum(axis=1), other_size))
        first = np.cumsum(sizes) - sizes
        place = np.empty(len(words), np.int64)
        place[np.concatenate((by_model, others))] = np.arange(len(words))
        self.words.add(np.concatenate((ids, other_ids)), sizes[place], first[place])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts together, and how many each has."""
        if len(self.rows) > self.cache or self.held > CACHE_BYTES:
            self._forget()
        known = len(self.rows)
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        rows = np.fromiter(map(self.rows.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        if len(self.rows) > known:
            new = list(islice(self.rows, known, None))
            self.held += sum(map(len, new))
            self._learn(new)
        ids, size = self.words.gather(rows[coded.indices.to_numpy()])
        ends = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))])


class _Rows(dict):
    """Words to row numbers; a new word takes the next."""

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        return row


class _Table:
    """Rows of ids, one behind the other."""

    def __init__(self):
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray, first: np.ndarray | None = None) -> None:
        """Appends rows of these sizes, which begin at first in ids, or one behind the other."""
        first = np.cumsum(size) - size if first is None else first
        self.first = np.concatenate((self.first, len(self.ids) + first))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows together, and how many each has."""
        size = self.size[rows]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.first[rows] - (ends - size), size) + np.arange(int(size.sum()))], size


def _joined(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter(chain.from_iterable(each), np.uint32, int(size.sum())), size


_tokens: dict[str, WordTokens] = {}


def raw_ids(docs: DataFrame, vocabulary: str | None, end_id: int) -> DataFrame:
    """Each document's ids (end id included), in any order, and a row of counts from each task. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
        if path not in _tokens:
            _tokens[path] = WordTokens(path)
        own_cache("token_files", _tokens)
        most = max(_tokens[path].tokenizer.get_vocab_size(), end_id + 1)
        wide = "<u2" if most <= 1 << 16 else "<u4"
        total = np.zeros(most, np.int64)
        for rows, texts in chunked(batches, BATCH_BYTES, ("known", "doc_id")):
            ids, counts = _tokens[path].encode(texts)
            ids = np.insert(ids.astype(wide), np.cumsum(counts), end_id)
            total += np.bincount(ids, minlength=most)
            n = counts + 1
            raw, ends = ids.tobytes(), (np.cumsum(n) * ids.itemsize).tolist()
            yield pd.DataFrame({"known": rows[0], "doc_id": rows[1], "n_tokens": n, "ids": [raw[i:j] for i, j in zip([0, *ends], ends)]})
        there = np.flatnonzero(total)
        found = np.empty(len(there), COUNTS)
        found["id"], found["n"] = there, total[there]
        yield pd.DataFrame({"known": [False], "doc_id": [0], "n_tokens": [-1], "ids": [found.tobytes()]})

    picked = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInPandas(run, RAW)


def as_ids(each: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Raw ids of some documents; two or four bytes an id, as the counts tell."""
    raw = b"".join(each)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * int(counts.sum()) else "<u4")


def id_counts(raw: DataFrame) -> DataFrame:
    """id and n over all documents: the tasks' counts, summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch["ids"]:
                counts = np.frombuffer(row, COUNTS)
                yield pd.DataFrame({"id": counts["id"].astype(np.int64), "n": counts["n"]})

    return raw.where("n_tokens < 0").select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> np.ndarray:
    """Writes the blocks under path and returns the ids in the order of their codes.

    What reaches the driver is bounded by the vocabulary: one count an id. Equal doc_ids are dealt by
    their lengths and ids, and equal rows by chance, so that no doc_id fills a task.
    """
    spark = docs.sparkSession
    prepare(spark)
    raw = materialise(raw_ids(docs, vocabulary, end_id), "token-ids")
    counted = id_counts(raw).toPandas().sort_values(["n", "id"], ascending=[False, True])
    order = counted["id"].to_numpy(np.int64)
    code_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    code_of[order] = np.arange(len(order))

    def block(rows: list[tuple], part: int, first: int) -> dict:
        counts = np.array([r[2] for r in rows], "<i8")
        control, data = pack(code_of[as_ids([r[3] for r in rows], counts)])
        unknown = sum(not r[0] for r in rows)
        return {"part": part, "first_id": first, "n_ids": int(counts.sum()), "n_unknown": unknown, "doc_ids": np.array([r[1] for r in rows], "<i8").tobytes(), "lengths": counts.tobytes(), "control": control, "data": data}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in batches:
            for row in zip(batch["known"].tolist(), batch["doc_id"].tolist(), batch["n_tokens"].tolist(), batch["ids"]):
                if held and size >= BLOCK_IDS:
                    yield pd.DataFrame([block(held, part, first)])
                    held, first, size = [], first + size, 0
                held.append(row)
                size += row[2]
        if held:
            yield pd.DataFrame([block(held, part, first)])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["known", "doc_id", "n_tokens", "h", "chance"]
    rows = raw.where("n_tokens >= 0").withColumns({"h": F.xxhash64("ids"), "chance": F.rand(0)})
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("known", "doc_id", "n_tokens", "ids")
    rows.mapInPandas(run, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(order.astype("<u4").tobytes(), int(end_id))], "order binary, end_id int").coalesce(1).write.parquet(f"{path}/codes")
    return order


def read_token_files(spark, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    prepare(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    order = np.frombuffer(spark.read.parquet(f"{path}/codes").first()["order"], "<u4")

    # one row a written part: the ids before each part
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, running = {}, 0
    for row in sums:
        before[row["part"]] = running
        running += row["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<i8")
                raw = memoryview(order[unpack(row.control, row.data, int(row.n_ids))]).cast("B")
                cuts = np.concatenate(([0], np.cumsum(lengths)))
                at = (4 * cuts).tolist()
                each = [raw[i:j] for i, j in zip(at, at[1:])]
                doc_ids = pd.array(np.frombuffer(row.doc_ids, "<i8"), "Int64")
                doc_ids[: int(row.n_unknown)] = pd.NA
                out = pd.DataFrame({"doc_id": doc_ids, "start": before[row.part] + row.first_id + cuts[:-1], "n_tokens": lengths, "ids_crc32": [zlib.crc32(x) for x in each]})
                if keep_ids:
                    out["ids"] = [bytes(x) for x in each]
                yield out

    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else ""))
