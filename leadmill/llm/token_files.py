"""Token ids in Arrow files of fixed-size lists.

A data set is a folder of shards in ascending order of doc_id. A shard is an Arrow file (a stream of record batches
with a footer) of two columns: ``ids``, a fixed-size list of unsigned integers (16 bit where the vocabulary allows),
and ``mask``, a fixed-size list of booleans, true where a token of a document stands. Each row is one sequence of
``LENGTH`` tokens; a document follows the one before it and may run over several rows; the shard's last row is
padded with 0 under a false mask. Since lists have one size, token k of a shard is element k of the values buffers:
``Shard`` maps a file into memory and hands out views, without copies. A second Arrow file per shard lists doc_id,
start in the shard and n_tokens of its documents.

Shards are cut by ranges of doc_id, so documents are shuffled once and no task holds more than its batches. A
task writes files under a name of its own attempt; the manifest, a table, names those of the attempts that
counted, so a lost executor's files are never read. Null texts are empty (only the end id); repeated rows are
written each, in order of id and text hash; rows with a null doc_id come first; an empty table gives no shard.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.bpe import byte_letters
from leadmill.llm.common import Cuts, arrow_schema, texts_of

LENGTH = 2048
#: Sequences of a record batch.
BATCH = 256
#: Encoded chunks and words that a Python worker remembers, but for one text's; it forgets all when it holds more.
REMEMBERED = 1_000_000
#: Separators that Python splits at and the tokenizer does not.
_ODD = frozenset("\x1c\x1d\x1e\x1f")
#: Letters, single numbers and runs of marks, as the tokenizers that are taken here cut lower-cased text.
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall


class WordEncoder:
    """Encodes texts with a byte-level tokenizer that drops white space, word by word.

    Such a tokenizer treats the text between two white spaces (a chunk) alike wherever it stands, and parts it into
    letters, single numbers and marks. So a chunk is cut here, each word is put once through the tokenizer's own
    merges, and chunks and words are remembered. All words of the vocabulary are proved beforehand to be one token.

    That a text may be cut here is asked of the tokenizer, not assumed: of every character, once, whether it lower-cases
    and parts letters and marks as it does in the tokenizer. Texts with other characters, with special strings or not in normal
    form are encoded chunk by chunk with the whole tokenizer, and those with odd separators as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "H" if self.size <= 1 << 16 else "I"
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        if plain("a b") != plain("a") + plain("b") or plain("a\n\t b") != plain("a b"):
            raise ValueError("the tokenizer keeps white space")
        tried = ["the", "zq", "\xe9t\xe9", "?!", "'s", "7", "\u4e2d", "\U0001f600"]
        self.cuts = all(plain(w) == self._merged(w) for w in tried) and plain("It's 3.14!") == [i for w in _WORD("it's 3.14!") for i in self._merged(w)]
        self.agreed: set[str] = set()
        self.asked: set[str] = set()
        self.proved = self._prove() if self.cuts else {}
        self.known = dict(self.proved)

    def _merged(self, word: str) -> list[int]:
        """The merges of the tokenizer on the bytes of one word."""
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters))]

    def _prove(self) -> dict[str, bytes]:
        """Vocabulary strings that are one word and come out as their own single token."""
        back = byte_letters()
        proved = {}
        for string, own in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                word = bytes(back[c] for c in string.removesuffix("</w>")).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if _WORD(word) == [word] and self._merged(word) == [own]:
                proved[word] = self._pack([own])
        return proved

    def _agrees(self, c: str) -> bool:
        """Whether ``c`` is lower-cased and parts letters and marks here as in the tokenizer."""
        probe = f"a{c}!{c}a"
        folded = self.tokenizer.normalizer.normalize_str(probe) if self.tokenizer.normalizer else probe
        if c.isspace():
            return c not in _ODD and self.tokenizer.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode("a ! a", add_special_tokens=False).ids
        if folded != probe.lower() or len(folded) != len(probe):
            return False
        here, at = [], 0
        for w in _WORD(folded):
            here.append((at, at + len(w)))
            at += len(w)
        return at == len(folded) and here == [place for _, place in self.tokenizer.pre_tokenizer.pre_tokenize_str(folded)]

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _may_cut(self, text: str, letters: set[str]) -> bool:
        if not self.cuts:
            return False
        fresh = letters - self.asked
        if fresh:
            self.asked |= fresh
            self.agreed.update(c for c in fresh if self._agrees(c))
        # a sigma at the end of a word has a lower-case letter of its own in Python only
        return letters <= self.agreed and "\u03a3" not in letters and is_normalized("NFC", text) and not any(s in text for s in self.special)

    def _chunk(self, chunk: str) -> bytes:
        made = None if chunk.isalpha() else _WORD(chunk)
        if made is None or len(made) == 1:
            return self._pack(self._merged(chunk))
        known = self.known
        for word in made:
            if word not in known:
                known[word] = self._pack(self._merged(word))
        return b"".join(map(known.__getitem__, made))

    def _encode(self, text: str) -> bytes:
        letters = set(text)
        if not _ODD.isdisjoint(letters):
            return self._whole(text)
        if len(self.known) > REMEMBERED:
            self.known = dict(self.proved)
        known = self.known
        if self._may_cut(text, letters):
            chunks, make = text.lower().split(), self._chunk
        else:  # under a key that no chunk has
            chunks, make = ["\x1c" + c for c in text.split()], lambda c: self._whole(c[1:])
        for chunk in set(chunks).difference(known):
            known[chunk] = make(chunk)
        return b"".join(map(known.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native unsigned integers of ``kind``."""
        return list(map(self._encode, texts))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named as Spark names it."""
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Appends documents' ids and writes full record batches as they fill."""

    def __init__(self, folder: str, name: str, kind: str, length: int):
        self.fs, root = place(folder)
        self.fs.create_dir(root, recursive=True)
        self.type = pa.uint16() if kind == "H" else pa.uint32()
        self.length, self.width = length, array(kind).itemsize
        self.schema = pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.paths = [f"{root}/{name}.arrow", f"{root}/{name}.docs.arrow"]
        self.out = [self.fs.open_output_stream(p) for p in self.paths]
        self.data, self.docs = pa.ipc.new_file(self.out[0], self.schema), pa.ipc.new_file(self.out[1], self.index)
        self.held, self.bytes, self.rows = [], 0, []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self.rows.append((doc_id, self.n_tokens, n))
        self.n_tokens += n
        self.n_docs += 1
        self.held.append(ids)
        self.bytes += len(ids)
        if self.bytes >= BATCH * self.length * self.width:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        full = BATCH * self.length * self.width
        data = b"".join(self.held)
        at = 0
        while len(data) - at >= full or (end and at < len(data)):
            part = data[at : at + full]
            at += len(part)
            n = len(part) // self.width
            pad = -n % self.length
            values = pa.Array.from_buffers(self.type, n + pad, [None, pa.py_buffer(part + bytes(pad * self.width))])
            mask = pa.array(np.arange(n + pad) < n)
            self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(values, self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))
        self.held, self.bytes = [data[at:]], len(data) - at
        if self.rows:
            self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=self.index))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        for x in (self.data, self.docs, *self.out):
            x.close()


class Shard:
    """Random access to a shard's sequences, masks and documents. Local files are mapped, not read."""

    def __init__(self, folder: str, name: str):
        fs, root = place(folder)
        local = isinstance(fs, pafs.LocalFileSystem) or getattr(fs, "type_name", "") == "local"
        open_ = pa.memory_map if local else fs.open_input_file
        self.data = pa.ipc.open_file(open_(f"{root}/{name}.arrow"))
        self.docs = pa.ipc.open_file(open_(f"{root}/{name}.docs.arrow"))
        self.length = self.data.schema.field("ids").type.list_size
        self.batches = self.data.num_record_batches
        self._held: tuple = (-1, None)

    def batch(self, b: int) -> pa.RecordBatch:
        if self._held[0] != b:
            self._held = (b, self.data.get_batch(b))
        return self._held[1]

    def __len__(self) -> int:
        return 0 if not self.batches else (self.batches - 1) * BATCH + self.batch(self.batches - 1).num_rows

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        b, row = divmod(i, BATCH)
        held = self.batch(b)
        ids = held.column("ids").values.slice(row * self.length, self.length).to_numpy(zero_copy_only=True)
        return ids, held.column("mask").values.slice(row * self.length, self.length)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of tokens ``start`` to ``start + n``, one for each record batch that they touch."""
        size = BATCH * self.length
        while n > 0:
            b, at = divmod(start, size)
            part = self.batch(b).column("ids").values.slice(at, min(n, size - at)).to_numpy(zero_copy_only=True)
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for b in range(self.docs.num_record_batches):
            yield self.docs.get_batch(b)


MANIFEST = "shard int, folder string, name string, n_docs bigint, n_tokens bigint"


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards under ``folder`` and returns their manifest; each pass over it writes again."""
    target = arrow_schema(docs.sparkSession, MANIFEST)

    def run(batches):
        enc = encoder(tokenizer)
        end = array(enc.kind, [end_id]).tobytes()
        task = TaskContext.get()
        shard = task.partitionId()
        name, out = f"shard-{shard:06d}-{task.taskAttemptId()}", None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(folder, name, enc.kind, length)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch)), strict=True):
                out.add(doc, ids + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "folder": folder, "name": name, "n_docs": out.n_docs, "n_tokens": out.n_tokens}], schema=target)

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all shards, n_tokens and the CRC-32 of its ids."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    target = arrow_schema(manifest.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["folder"], row["name"])
                for docs in shard.documents():
                    crcs = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for part in shard.tokens(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array(docs.column("start").to_numpy() + row["base"])
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(crcs, pa.int64())], schema=target)

    return based.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes a data set to the shared folder and reads it back."""
    cuts = Cuts(docs.sparkSession, "token-files")
    manifest = cuts.write(write(docs, tokenizer, cuts.path("shards"), end_id), "manifest")
    return read(manifest)
