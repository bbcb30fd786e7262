"""BPE encoding and decoding with word ends, as the public ``word_bpe`` vocabulary file defines it.

A text is cut at the special tokens of the file, each of which is one id. The rest is composed
(NFC), lower-cased code point by code point and cut into words: contractions, runs of letters,
single digits, runs of other marks; white space goes. A word's UTF-8 bytes are the first symbols,
its last one carries the word end.

The symbols of a word form a doubly linked list. Every neighbouring pair that the vocabulary can
merge is in a priority queue under its rank and place. The lowest is taken, merged into its left
symbol, and the new pairs to both sides enter the queue; an entry whose symbols have changed
since is stale and skipped. That is ``n log n`` in the length of a word, so a run of a million
marks is no trap. Words repeat, so each task keeps the ids of up to ``KEPT_WORDS`` of them.

Decoding looks up each id's string in the vocabulary and concatenates them in order, with the
separator that the file's decoder asks for: a file without decoder separates tokens by a blank.

Classes of characters are those of the ``regex`` module, case and composition those of Python's
Unicode tables; they differ from the ``tokenizers`` library for some characters first assigned in
Unicode 16 or later.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each.
A text is one row's work, however long, in memory in proportion to it. An empty table gives no
rows. Only the named column is read; other columns may have any name.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals.llm.bounds import with_small_batches

WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Distinct words whose ids a task remembers; then it starts anew.
KEPT_WORDS = 400_000
ID_BITS, PLACE_BITS = 20, 32
ID, PLACE = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is a visible Latin-1 sign, else the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(free)) for b in range(256)]


class _Known(dict):
    """Packed ids of words, merged when first asked for."""

    def __init__(self, merged: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.merged = merged

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = array("I", self.merged(word)).tobytes()
        return ids


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file's content."""

    def __init__(self, content: str) -> None:
        file = json.loads(content)
        model, ids = file["model"], file["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: s for s, i in [*ids.items(), *self.special.items()]}
        self.separator = " " if file["decoder"] is None else ""
        symbols = byte_symbols()
        self.inner, self.last = [ids[s] for s in symbols], [ids[s + self.end] for s in symbols]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {ids[a] << ID_BITS | ids[b]: rank << ID_BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.word = regex.compile(WORD)
        self.known = _Known(self.merged)

    def merged(self, word: str) -> list[int]:
        """Ids of one word.

        A queue entry is one number: rank, merged id and place of the left symbol. It is stale
        unless the symbol there and the one after it still give that rank. A symbol that was
        merged into another is -1, as is the one after the end; no pair with it has a rank.
        """
        raw = word.encode("utf-8", "surrogatepass")
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        n, rank_of = len(symbol), self.merges.get
        symbol.append(-1)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        queue = []
        for i in range(n - 1):
            found = rank_of(symbol[i] << ID_BITS | symbol[i + 1])
            if found is not None:
                queue.append(found << PLACE_BITS | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            left, found = entry & PLACE, entry >> PLACE_BITS
            right = after[left]
            if symbol[left] < 0 or rank_of(symbol[left] << ID_BITS | symbol[right]) != found:
                continue
            symbol[left] = new = found & ID
            symbol[right] = -1
            after[left] = right = after[right]
            before[right] = left
            found = rank_of(new << ID_BITS | symbol[right])
            if found is not None:
                heappush(queue, found << PLACE_BITS | left)
            left = before[left]
            if left >= 0:
                found = rank_of(symbol[left] << ID_BITS | new)
                if found is not None:
                    heappush(queue, found << PLACE_BITS | left)
        return [s for s in symbol if s >= 0]

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            # A capital sigma is the same small letter wherever it stands.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """Ids of a text, as unsigned 32-bit numbers, little end first."""
        parts = self.cut.split(text) if self.cut else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.known.__getitem__, self.words(part))
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.separator.join(map(self.strings.__getitem__, memoryview(ids).cast("I")))


def codec(spark: SparkSession, path: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Functions ``encode``, from a text column to packed ids, and ``decode``, back to text.

    The vocabulary file, at ``path`` on the driver, is sent as it is; its size is that of the
    vocabulary, 1.7 MB here, whatever the tables hold.
    """
    with_small_batches(spark)
    with open(path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    kept: dict[str, Vocabulary] = {}

    def vocabulary() -> Vocabulary:
        if not kept:
            kept["it"] = Vocabulary(sent.value)
        return kept["it"]

    def encode(texts: pa.Array) -> pa.Array:
        one = vocabulary().encode
        return pa.array((one(t.as_py() or "") for t in texts), pa.large_binary()).cast(pa.binary())

    def decode(ids: pa.Array) -> pa.Array:
        one = vocabulary().decode
        return pa.array([one(x.as_py() or b"") for x in ids], pa.string())

    # Spark would evaluate a deterministic function once more for each column made from its result.
    return F.arrow_udf(encode, "binary").asNondeterministic(), F.arrow_udf(decode, "string")


def digests(spark: SparkSession, documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text."""
    encode, decode = codec(spark, path)
    coded = documents.select("doc_id", encode(F.col("text")).alias("ids")).select("doc_id", "ids", decode("ids").alias("decoded"))
    return coded.select(
        "doc_id",
        F.call_function("div", F.octet_length("ids"), F.lit(4)).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
