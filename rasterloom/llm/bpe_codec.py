"""Operator 10, BPE encoding and decoding with the vocabulary of a tokenizers JSON file.

Method: backtracking encoder. An Aho-Corasick automaton over the vocabulary gives the longest token at each
place of a word; the encoder takes it if the pair-compatibility table allows it after the token before, else
tries the next shorter token that is a prefix of it, and steps back when none is left; a bit per place keeps
failed places from being tried again, so the work is linear in the word. The result is exactly what applying
the merges one by one gives. Decoding gathers token texts from one buffer through a table of offsets.

Words are what the file's pre-tokenizer makes of normalised text. For text whose characters all lie where the
two regular-expression engines agree, the words are found here; any other text goes through the library's own
normaliser and pre-tokeniser. Strings of added tokens inside a text become those tokens, as is the library's
default.

Defined results: a null or empty text encodes to no ids and decodes to an empty text; repeated rows give
repeated rows; an empty table gives an empty one; columns besides doc_id and text are ignored, whatever their
names. Memory: one Arrow batch and the encodings of KEPT_WORDS short words.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import map_texts, sha256_hex, slim, table
from rasterloom.llm.merge_table import MergeTable

END = "</w>"
#: The last symbol of a word is the byte's character moved up by this much: one alphabet letter, not five.
MOVED = 0x1000
#: Words whose encodings are kept, and the longest word that is.
KEPT_WORDS = 500_000
KEPT_LENGTH = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the
    others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class BpeCodec:
    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        vocab = model["vocab"]
        if model.get("end_of_word_suffix") != END or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("only byte-level vocabularies with word ends are encoded here")
        letters = byte_letters()
        self.letter = dict(enumerate(letters))  # str.translate() of Latin-1 text
        symbol = lambda t: t[: -len(END) - 1] + chr(ord(t[-len(END) - 1]) + MOVED) if t.endswith(END) else t
        self.table = merges = MergeTable()
        self.word_of: dict[str, int] = {}
        self.ids: list[int] = []
        for token, i in sorted(vocab.items(), key=lambda x: x[1]):
            if len(s := symbol(token)) == 1:
                self.word_of[s] = merges.base()
                self.ids.append(i)
        for rank, (a, b) in enumerate(model["merges"]):
            s = symbol(a + b)
            if s in self.word_of:
                raise ValueError("two merges make one token")
            self.word_of[s] = merges.add(self.word_of[symbol(a)], self.word_of[symbol(b)], rank)
            self.ids.append(vocab[a + b])
        self.size = [0] * len(self.ids)
        automaton = ahocorasick.Automaton()
        for s, t in self.word_of.items():
            self.size[t] = len(s)
            automaton.add_word(s, t)
        automaton.make_automaton()
        self.automaton = automaton
        # the longest token that is a shorter prefix of each token
        self.shorter = [-1] * len(self.ids)
        for s, t in self.word_of.items():
            for n in range(len(s) - 1, 0, -1):
                if (p := self.word_of.get(s[:n])) is not None:
                    self.shorter[t] = p
                    break
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if not all("<|" in t for t in self.added):  # encode() looks for added tokens only where this is
            raise ValueError("added tokens without <| are not looked for here")
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        tokens = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.kept: dict[str, bytes] = {}
        # Where both regular-expression engines and both Unicode tables agree.
        self.plain = re.compile("[\t\n\x0b\x0c\r -~\xa1-įı-ſ–—‘-„•…€]*").fullmatch
        self.find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
        self.odd = re.compile("[\xaa\xb2\xb3\xb9\xba\xbc-\xbe]").search  # letters or numbers in one engine only

    def tokens_of(self, word: str) -> list[int]:
        """Vocabulary ids of one word (not empty) of the pre-tokenizer."""
        s = word.encode().decode("latin-1").translate(self.letter)
        s = s[:-1] + chr(ord(s[-1]) + MOVED)
        n, size, shorter, compatible = len(s), self.size, self.shorter, self.table.compatible
        longest = [-1] * n  # longest token that starts at each place
        for end, t in self.automaton.iter(s):
            at = end - size[t] + 1
            if longest[at] < 0 or size[t] > size[longest[at]]:
                longest[at] = t
        # iter() gives all tokens that end at a place, so that each start has had its longest by now
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            end = at + size[t]
            if open_[end] and (not out or compatible(out[-1], t)):
                out.append(t)
                at = end
                t = longest[at] if at < n else -1
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                open_[at] = 0
                t = out.pop()
                at -= size[t]
        return [self.ids[t] for t in out]

    def packed(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit integers."""
        got = self.kept.get(word)
        if got is None:
            got = np.array(self.tokens_of(word), "<u4").tobytes()
            if len(word) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[word] = got
        return got

    def words(self, text: str) -> list[str]:
        if self.plain(text) and not self.odd(text):
            return self.find(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        # a byte-level step follows the split there; undone, so that both ways give the same words
        back = {c: b for b, c in self.letter.items()}
        return [bytes(back[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        parts = self.split_added.split(text) if self.split_added and "<|" in text else [text]
        out = []
        kept, packed = self.kept.get, self.packed
        for part in parts:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out.extend([kept(w) or packed(w) for w in self.words(part)])
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Token texts with a space between, special tokens included, as a file without a decoder asks."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return ""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.buffer[at[:-1]].tobytes().decode()


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every text."""

    def row(_, text):
        ids = codec(vocabulary or default_vocabulary()).encode(text)
        return len(ids) // 4, ids

    return map_texts(docs, row, "n_tokens long, ids binary")


def decoded(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of what encoded() returns."""
    from collections.abc import Iterator

    import pyarrow as pa

    key_type = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codec(vocabulary or default_vocabulary())
            texts = [c.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(slim(run), f"doc_id {key_type}, text string")


def round_trips(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes every text and decodes its ids again, in one pass; digests of both."""

    def row(_, text):
        c = codec(vocabulary or default_vocabulary())
        ids = c.encode(text)
        return len(ids) // 4, sha256_hex(ids), sha256_hex(c.decode(ids).encode())

    return map_texts(docs, row, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digests of ids and decoding, a row for each row. A
    null or empty text has no ids and decodes to the empty text; a null doc_id is kept; other columns are left out; an empty
    table gives an empty one."""

    def row(_, text):
        c = codec(default_vocabulary())
        ids = c.encode(text)
        return len(ids) // 4, ids, sha256_hex(ids), sha256_hex(c.decode(ids).encode())

    return map_texts(docs, row, "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
