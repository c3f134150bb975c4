"""Operator 1, token counts: the exact number of tokens of every prefix of a text.

Method: prefix dynamic programming. For each position i of a chunk there is exactly one token that can end the
encoding of the first i characters: the one that is compatible with the last token of the prefix before it.
Keeping (last token, count) per prefix gives the count of every prefix in one pass, so truncation and budget
questions need no second encoding: prefix_table() stores the counts, within() answers from what is stored. Chunks (a run of spaces and the word after it) cannot merge with each
other in this vocabulary, which is checked when it is loaded, so counts of chunks add up and may be kept.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; an empty
table gives an empty one; columns besides doc_id and text are ignored, whatever their names. Memory: one Arrow
batch of texts, the counts of KEPT_CHUNKS short chunks, and one int per character of the text in hand.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, slim, table
from rasterloom.llm.merge_table import MergeTable

SPACE = "▁"
#: Chunks whose counts are kept, and the longest chunk that is.
KEPT_CHUNKS = 1_000_000
KEPT_LENGTH = 48
TOKEN_LIMIT = 4096
#: Prefixes in a row of the stored counts.
PIECE = 1 << 16

_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Kept(dict):
    """Counts by word; a missing word is counted, and kept if it is short."""

    def __init__(self, count, lead: str) -> None:
        self.count, self.lead = count, lead

    def __missing__(self, word: str) -> int:
        n = self.count(self.lead + word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[word] = n
        return n


class PrefixCounter:
    """Counts as the sentencepiece library does for a BPE model with byte fallback, identity normalisation and
    a space put before the text."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = []
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                pieces.append((sp.id_to_piece(i), sp.get_score(i)))
        if any(SPACE in p.strip(SPACE) or (p[-1] == SPACE and p.strip(SPACE)) for p, _ in pieces):
            raise ValueError("a piece goes over the end of a word; chunks can't be counted one by one")
        runs = {len(p) for p, _ in pieces if not p.strip(SPACE)}
        words = [x for x in pieces if x[0].strip(SPACE) or len(x[0]) == 1]
        least = min(s for p, s in words if len(p) > 1)
        if any(s >= least for p, s in pieces if not p.strip(SPACE) and len(p) > 1):
            raise ValueError("runs of spaces must merge after all else")
        self.runs = runs | {1}
        self.table = table = MergeTable()
        self.token: dict[str, int] = {p: table.base() for p, _ in words if len(p) == 1}
        for rank, (piece, _) in enumerate(sorted((x for x in words if len(x[0]) > 1), key=lambda x: -x[1])):
            for cut in range(1, len(piece)):
                left, right = self.token.get(piece[:cut]), self.token.get(piece[cut:])
                if left is not None and right is not None and table.replay(left, right):
                    self.token[piece] = table.add(left, right, rank)
                    break
        ends: dict[str, set[int]] = {}
        for piece in self.token:
            ends.setdefault(piece[-2:], {1}).add(len(piece))
        self.sizes = {tail: tuple(sorted(n)) for tail, n in ends.items()}  # of the pieces that end so
        self.newline_alone = "\n" not in self.token
        self.after_space = _Kept(self._word, SPACE)
        self.at_start = _Kept(self._word, "")
        self._run_counts: dict[int, int] = {0: 0}

    def _prefixes(self, chunk: str) -> tuple[array, array]:
        """(last token, count) of every prefix of a chunk with one leading space at most. A character without
        a piece stands alone, as its bytes: last token -1."""
        n = len(chunk)
        last, count = array("i", [-2]) * (n + 1), array("q", [0]) * (n + 1)
        last[0] = -1
        token, sizes, known, compatible = self.token.get, self.sizes.get, self.table.known.get, self.table.compatible
        for end in range(1, n + 1):
            for size in sizes(chunk[end - 2 : end], (1,)) if end > 1 else (1,):
                start = end - size
                if start < 0:
                    continue
                t = token(chunk[start:end])
                if t is not None:
                    before = last[start]
                    if before < 0 or (ok := known((before, t))) or ok is None and compatible(before, t):
                        last[end], count[end] = t, count[start] + 1
                        break
            else:
                last[end], count[end] = -1, count[end - 1] + len(chunk[end - 1].encode())
        return last, count

    def _word(self, chunk: str) -> int:
        return self._prefixes(chunk)[1][-1] if chunk else 0

    def _run(self, k: int) -> int:
        """Tokens of k spaces: all their merges tie, so the leftmost pair goes first."""
        if k not in self._run_counts:
            done: list[int] = []
            rest = k
            while True:
                if len(done) > 1 and done[-2] + done[-1] in self.runs:
                    done[-2:] = [done[-2] + done[-1]]
                elif done and rest and done[-1] + 1 in self.runs:
                    done[-1] += 1
                    rest -= 1
                elif rest:
                    done.append(1)
                    rest -= 1
                else:
                    break
            if len(self._run_counts) > 10_000:
                self._run_counts = {0: 0}
            self._run_counts[k] = len(done)
        return self._run_counts[k]

    def _chunk(self, chunk: str) -> int:
        """Count of any chunk. Spaces merge among each other after all else: the last space of a run goes with
        the word if the word's first token takes it."""
        k = len(chunk) - len(chunk.lstrip(SPACE))
        if k <= 1:
            return self.after_space[chunk[1:]] if k else self.at_start[chunk]
        if k == len(chunk):
            return self._run(k)
        counts = self._prefixes(chunk[k - 1 :])[1]
        return counts[-1] - 1 + self._run(k) if self._splits(chunk[k - 1 :]) else counts[-1] + self._run(k - 1)

    def _splits(self, chunk: str) -> bool:
        """Whether the encoding of a chunk with one leading space begins with the space alone."""
        last, _ = self._prefixes(chunk)
        i, pieces = len(chunk), self._lengths()
        while i > 1:
            i -= 1 if last[i] < 0 else pieces[last[i]]
        return i == 1

    @lru_cache(maxsize=1)  # noqa: B019
    def _lengths(self) -> dict[int, int]:
        return {t: len(p) for p, t in self.token.items()}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.newline_alone or SPACE in text:
            return sum(self._chunk(c) for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE)))
        lines = text.split("\n")
        total = len(lines) - 1
        after, start = self.after_space, self.at_start
        for i, line in enumerate(lines):
            words = line.split(" ")
            if "" in words:
                lead = "" if i else SPACE
                total += sum(self._chunk(c) for c in _CHUNK.findall(lead + line.replace(" ", SPACE)))
            elif i:
                total += start[words[0]] + sum(map(after.__getitem__, words[1:]))
            else:
                total += sum(map(after.__getitem__, words))
        return total

    def _chunk_prefixes(self, chunk: str) -> array:
        """The counts of the prefixes of any chunk, the empty one first."""
        k = len(chunk) - len(chunk.lstrip(SPACE))
        lead = max(0, k - 1)
        own = array("q", (self._run(j) for j in range(lead + 1)))
        last, inner = self._prefixes(chunk[lead:])
        lengths, alone = self._lengths(), array("b", [0]) * len(inner)
        for j in range(1, len(inner)):
            at = j - (1 if last[j] < 0 else lengths[last[j]])
            alone[j] = j == 1 or at > 0 and alone[at]  # the first token is the space alone
            own.append(inner[j] - 1 + self._run(k) if lead and alone[j] else inner[j] + self._run(lead))
        return own

    def prefix_counts(self, text: str) -> array:
        """counts[i] is the number of tokens of text[:i], exact for every i."""
        counts = array("q", [0])
        for m in _CHUNK.finditer(SPACE + text.replace(" ", SPACE)):
            done = counts[-1]
            counts.extend(done + n for n in self._chunk_prefixes(m.group())[1:])
        counts.pop(0)  # the space that the library puts before a text is no prefix of it
        counts[0] = 0
        return counts

    def fit(self, text: str, budget: int) -> int:
        """The largest number of characters whose prefix takes budget tokens at most. Whole chunks are passed
        by their kept counts; only the chunk that the budget ends in is looked at prefix by prefix."""
        done = at = 0  # tokens and characters (with the space before the text) of the chunks so far
        for m in _CHUNK.finditer(SPACE + text.replace(" ", SPACE)):
            n = self._chunk(m.group())
            if done + n > budget:
                inner = self._chunk_prefixes(m.group())
                at += max(i for i, k in enumerate(inner) if done + k <= budget)
                break
            done, at = done + n, m.end()
        return max(0, at - 1)

    def word(self, word: str) -> int:
        """Count of a word as batch_counts() splits them: after a space, or with the line break before it."""
        return 1 + self.at_start[word[1:]] if word[:1] == "\n" else self.after_space[word]

    def batch_counts(self, texts) -> list[int]:
        """Counts of an Arrow array of texts without nulls. Words are split and told apart in Arrow, so that each
        distinct word of the batch is looked up once."""
        import numpy as np

        if not self.newline_alone or not len(texts):
            return [self.count(t) for t in texts.to_pylist()]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat, ends = lists.flatten(), np.asarray(lists.offsets)
        ends = ends - ends[0]
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.word, words), np.int64, len(words))
        odd = np.fromiter((not w or SPACE in w for w in words), bool, len(words))  # runs of spaces
        at = np.asarray(coded.indices)
        total = np.concatenate(([0], np.cumsum(known[at])))
        odds = np.concatenate(([0], np.cumsum(odd[at])))
        counts = total[ends[1:]] - total[ends[:-1]]
        again = np.flatnonzero(odds[ends[1:]] > odds[ends[:-1]])
        for i in again:
            counts[i] = self.count(texts[int(i)].as_py())
        return counts.tolist()


@lru_cache(maxsize=2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix of limit tokens
    at most, read off the prefix counts) for each row of docs."""
    bounded_batches(docs.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            counts = c.batch_counts(texts)
            fits = pc.utf8_length(texts).to_pylist()
            for i, n in enumerate(counts):
                if n > limit:
                    fits[i] = c.fit(texts[i].as_py(), limit)
            columns = [pc.binary_length(texts).cast("int64"), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(slim(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, model_path: str | None = None, piece: int = PIECE) -> DataFrame:
    """The counts of all prefixes, stored: doc_id, text_hash, start and counts, where counts[i] is the number of tokens
    of the first start + i characters. A text has a row for each `piece` characters, so that none grows with it."""
    bounded_batches(docs.sparkSession)
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for i, text in enumerate(pc.fill_null(b.column(2), "").to_pylist()):
                counts = c.prefix_counts(text) if text else array("q", [0])
                starts = range(0, len(counts), piece)
                one = pa.array([i] * len(starts))
                columns = [pa.array(starts, pa.int64()), pa.array([counts[k : k + piece].tolist() for k in starts], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(one), b.column(1).take(one), *columns], ["doc_id", "text_hash", "start", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(slim(run), f"doc_id {kind}, text_hash long, start long, counts array<int>")


def within(prefixes: DataFrame, budget: int) -> DataFrame:
    """doc_id, text_hash and fit_chars, the longest prefix of `budget` tokens at most, from stored counts alone."""
    at = F.transform("counts", lambda n, i: F.when(n <= budget, F.col("start") + i))
    return prefixes.groupBy("doc_id", "text_hash").agg(F.max(F.array_max(at)).alias("fit_chars"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
