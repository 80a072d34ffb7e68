"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code, decoded by table lookup.

A file set is three tables: ``dictionary`` (the id of every rank, most frequent first), ``blocks`` (whole documents
in key order, their ids as ranks) and ``parts`` (number of ids per part). Of a block's ranks, the control
bytes hold two bits each (length minus one, four ranks a byte, lowest bits first) and the data bytes hold the
one to four low bytes of each rank.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.llm.texts import by_text, per_worker
from lacuna.scratch import cut, small_table

#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16

#: Bytes of words and their ids that a worker remembers, as Python counts them; only speed depends on it.
MEMORY = 64 << 20

#: What a word in a dictionary takes besides its letters and ids.
ENTRY = 200

#: For each control byte, the lengths of its four ranks.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)

#: For each length, the bits of a four-byte word that belong to the rank.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

#: ASCII signs: between one of them and a letter or digit before it, the tokenizer always cuts.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: A word that parts others when many are encoded as one text. Words that hold it are encoded alone.
MARK = "|"

#: Words encoded as one text.
TOGETHER = 200


def normalized(text: str) -> str:
    """The text with spaces for tabs and line ends; in lower case if that is what the tokenizer would make of it.

    The tokenizer drops white space, and no token spans it. Lower case is certain for Latin-1 texts, whose letters
    have one lower form each, without anything like a special token.
    """
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


#: Lower-case Latin-1 letters alone: nothing to normalize, and one piece for the tokenizer.
PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"

#: Signs behind such a letter or digit are encoded apart.
LETTER_LAST = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"


def bare(content: str) -> str:
    """The same vocabulary and merges for words that are separated by spaces and need no other rule."""
    whole = json.loads(content)
    words = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return json.dumps(whole | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": words}})


def strings(array: pa.Array) -> list[str]:
    """As ``to_pylist``, without an Arrow object for every value."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _bytes(words: dict[str, bytes]) -> int:
    """What words and their ids take in memory."""
    return sum(map(len, words)) + sum(map(len, words.values())) + ENTRY * len(words)


class WordIds:
    """The bytes of the ids of words, which are what lies between spaces, tabs and line ends.

    The words of many texts are split and told apart by Arrow; only those not remembered are encoded, and ids are
    gathered for all of them at once. When memory is full, words that occurred only once are forgotten.
    """

    def __init__(self, content: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.bare, self.kind = Tokenizer.from_str(content), Tokenizer.from_str(bare(content)), np.dtype(kind)
        # tokens that end a word, in a vocabulary that marks them
        suffix, vocabulary = json.loads(content)["model"].get("end_of_word_suffix"), self.bare.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.size = 0

    def learn(self, words: pa.Array) -> dict[str, bytes]:
        """Ids of different words that are not remembered, and of the parts they were encoded in."""
        heads = pc.utf8_rtrim(words, characters=SIGNS)
        apart = pc.and_(pc.and_(pc.match_substring_regex(heads, LETTER_LAST), pc.not_equal(heads, words)), pc.invert(pc.match_substring(words, "<|")))
        signed, heads = strings(words.filter(apart)), strings(heads.filter(apart))
        tails = [w[len(h) :] for w, h in zip(signed, heads)]
        bases = pa.chunked_array([words.filter(pc.invert(apart)), pa.array(heads, pa.string()), pa.array(list(set(tails)), pa.string())]).combine_chunks().unique()
        found = {b: self.known[b] for b in strings(bases) if b in self.known} if self.known else {}
        new = bases.filter(pc.invert(pc.is_in(bases, value_set=pa.array(list(found), pa.string())))) if found else bases
        plain = pc.match_substring_regex(new, PLAIN) if self.ends.any() else pa.array([False] * len(new), pa.bool_())
        easy, others = strings(new.filter(plain)), strings(new.filter(pc.invert(plain)))
        runs = [easy[i : i + TOGETHER] for i in range(0, len(easy), TOGETHER)]
        for run, encoding in zip(runs, self.bare.encode_batch_fast([" ".join(run) for run in runs], add_special_tokens=False)):
            ids = np.array(encoding.ids, self.kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            self._part(found, run, ids.tobytes(), [0, *ends[:-1].tolist()], ends.tolist())
        together = [b for b in others if MARK not in b] if len(self.mark) == 1 else []
        runs = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        made = self.tokenizer.encode_batch_fast([f" {MARK} ".join([*run, ""]) for run in runs], add_special_tokens=False)
        for run, encoding in zip(runs, made):
            ids = np.array(encoding.ids, self.kind)
            ends = np.flatnonzero(ids == self.mark[0]) * ids.itemsize
            self._part(found, run, ids.tobytes(), [0, *(ends[:-1] + ids.itemsize).tolist()], ends.tolist())
        alone = [b for b in others if MARK in b or len(self.mark) != 1]
        for b, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            found[b] = np.array(e.ids, self.kind).tobytes()
        found.update(zip(signed, [found[h] + found[t] for h, t in zip(heads, tails)]))
        return found

    @staticmethod
    def _part(found, run, data, starts, ends):
        found.update(zip(run, [data[x:y] for x, y in zip(starts, ends)], strict=True))

    def _growth(self, found: dict[str, bytes]) -> int:
        """What it takes to remember these too."""
        return _bytes(found) - _bytes({w: found[w] for w in found.keys() & self.known.keys()})

    def encode(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array([normalized(t) for t in texts], pa.large_string()), " ")
        coded = split.values.cast(pa.string()).dictionary_encode() if len(split.values) else pa.array([], pa.string()).dictionary_encode()
        words = strings(coded.dictionary)
        ids = [self.known.get(w) for w in words]
        missing = [i for i, b in enumerate(ids) if b is None]
        if missing:
            found = self.learn(coded.dictionary.take(pa.array(missing)))
            size = self._growth(found)
            if self.size + size > MEMORY:
                # of what is remembered, only words met again stay
                self.known = {w: b for w, b in zip(words, ids) if b is not None}
                self.size, size = _bytes(self.known), self._growth(found)
            for i in missing:
                ids[i] = found[words[i]]
            if self.size + size <= MEMORY:
                self.known.update(found)
                self.size += size
        # the ids of all words, gathered from those of the different ones
        flat = np.frombuffer(b"".join(ids), self.kind)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        starts, at = np.cumsum(lengths) - lengths, coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[at]
        ends = np.cumsum(counts)
        whole = flat[np.repeat(starts[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.append(0, ends)[split.offsets.to_numpy()] * self.kind.itemsize
        return [whole[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def token_ids(df: DataFrame, path: str, key: str, text: str, end: int) -> DataFrame:
    """``key``, ``ids`` (little-endian, 2 or 4 bytes each as the vocabulary asks) and their width."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        content = f.read()
    width = 2 if max(Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else 4
    shipped = df.sparkSession.sparkContext.broadcast(content)  # one vocabulary file
    kind = f"<u{width}"

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = per_worker(("word-ids", path, kind, zlib.crc32(shipped.value.encode())), lambda: WordIds(shipped.value, kind))
        last = np.array([end], kind).tobytes()
        return lambda texts: {"ids": [ids + last for ids in words.encode(texts)], "width": [width] * len(texts)}

    return by_text(df, [key], text, make, "ids binary, width int")


def count_ids(tokens: DataFrame) -> DataFrame:
    """``id``, ``n``: each task counts its own documents, then the counts of an id are summed."""
    out = StructType.fromDDL("id bigint, n bigint")

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, width in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], schema=to_arrow_schema(out))

    return tokens.select("ids", "width").mapInArrow(run, out).groupBy("id").agg(F.sum("n").alias("n"))


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks: lengths by table lookup, then every rank from the word that starts at its first byte."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    words = padded[first] | padded[first + 1] << 8 | padded[first + 2] << 16 | padded[first + 3] << 24
    return words & MASKS[lengths]


def write_token_files(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1) -> None:
    """Write all texts of ``df`` as token-id files under ``path``, in ascending order of ``key``.

    Texts are tokenized once; the ids are kept as a table, counted, and sorted by key through a range
    shuffle. Null texts are empty, so they hold the end id alone. Null keys come first. Rows with equal keys
    are all written, by many tasks if there are many, ordered by their first 64 bytes of ids. Other columns are left out; an empty table gives empty files.
    """
    spark = df.sparkSession
    named = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    tokens = cut(token_ids(named, tokenizer, "key", "text", end), "ids")
    key_type = tokens.schema["key"].dataType.simpleString()
    # one row per id of the vocabulary
    counted = count_ids(tokens).orderBy(F.desc("n"), "id").select("id", "n").toPandas()
    order = counted["id"].to_numpy(np.int64)
    small_table(spark, rank=(range(len(order)), pa.int64()), id=(order.tolist(), pa.int64()), n=(counted["n"].tolist(), pa.int64())).coalesce(1).write.parquet(f"{path}/dictionary")
    ranks = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    ranks[order] = np.arange(len(order))
    shipped = spark.sparkContext.broadcast(ranks)
    out = StructType.fromDDL(f"part int, before bigint, keys array<{key_type}>, lengths array<bigint>, n bigint, control binary, data binary")

    def run(batches):
        from pyspark import TaskContext

        part, types, before, keys, ids = TaskContext.get().partitionId(), to_arrow_schema(out), 0, [], []

        def block():
            nonlocal before, keys, ids
            whole = np.concatenate(ids)
            control, data = encode_ranks(shipped.value[whole])
            row = [part], [before], [keys], [[len(i) for i in ids]], [len(whole)], [control], [data]
            before, keys, ids = before + len(whole), [], []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, types)], schema=types)

        total = 0
        for batch in batches:
            for k, i, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                keys.append(k)
                ids.append(np.frombuffer(i.as_py(), f"<u{width}"))
                total += len(ids[-1])
                if total >= BLOCK_IDS:
                    total = 0
                    yield block()
        if keys:
            yield block()

    # rows of one key are divided by their first ids, and those that begin alike by their place
    divided = F.substring("ids", 1, 64), F.col("_metadata.row_index")
    tokens.repartitionByRange("key", *divided).sortWithinPartitions("key", "ids").mapInArrow(run, out).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.groupBy("part").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian, 4 bytes each) of every document."""
    parts = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{path}/parts").collect())  # one row per write task
    starts, total = {}, 0
    for part, n in parts:
        starts[part] = total
        total += n
    words = spark.read.parquet(f"{path}/dictionary").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)  # one row per id of the vocabulary
    shipped = spark.sparkContext.broadcast((words, starts))
    blocks = spark.read.parquet(f"{path}/blocks")
    key_type = blocks.schema["keys"].dataType.elementType.simpleString()
    out = StructType.fromDDL(f"`{key}` {key_type}, start bigint, n_tokens bigint, ids binary")

    def run(batches):
        types = to_arrow_schema(out)
        words, starts = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, keys, lengths, n, control, data = (batch.column(c)[i].as_py() for c in range(7))
                ids = words[decode_ranks(control, data, n)].astype("<u4")
                first = np.cumsum(lengths) - lengths
                made = ([keys, (first + before + starts[part]).tolist(), lengths,
                         [ids[a : a + m].tobytes() for a, m in zip(first.tolist(), lengths)]])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, types)], schema=types)

    return blocks.select("part", "before", "keys", "lengths", "n", "control", "data").mapInArrow(run, out)
