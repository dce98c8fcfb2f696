"""Edit-aware token counts: a segment tree of pre-tokens per document, updated where edits touch it.

A byte-level BPE first splits a text by a pattern into pre-tokens, whose token counts add up. A document's pre-tokens hang
in leaves of a segment tree whose nodes hold characters and tokens. An edit is found by descending on characters. Splitting
starts a few pre-tokens before it - the pattern looks ahead, never back - and goes on behind it until a new boundary meets an
old one; from there on nothing can differ. Only that region is encoded again, and only sums above touched leaves
change. All edits of a document are given in places of the old text.

Documents are counted where they are scanned. Counts of frequent pre-tokens are kept in a bounded table per task.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..plans.catalogue import Catalogue
from .common import table

CATALOGUE = Catalogue()
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
#: Pre-tokens before an edit that it can still change: a run of white space is at most two, and what comes before may end there.
CONTEXT = 3
MAX_KNOWN = 300_000
Edit = tuple[int, int, str]


class Counter:
    """Token counts of pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, max_known: int = MAX_KNOWN) -> None:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merges, special_tokens={})._core_bpe.encode_single_piece
        self.pattern, self.known, self.max_known = regex.compile(pattern), {}, max_known

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def __call__(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                if len(known) >= self.max_known:
                    known.clear()
                n = len(self.encode(piece.encode("utf-8")))
                if len(piece) < 64:
                    known[piece] = n
            out.append(n)
        return out


class TokenTree:
    """Pre-tokens of one document: lengths and counts in leaves, sums of both above."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter = text, counter
        pieces = counter.split(text)
        counts, lengths = counter(pieces), list(map(len, pieces))
        self.leaves = [(lengths[i:i + LEAF], counts[i:i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.pre_tokens, self.encoded = len(pieces), 0
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int, int]:
        """(leaf, number in it, start) of the pre-token that holds a character; the last one for places at the end."""
        place = min(place, max(self.chars[1] - 1, 0))
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        ends = list(accumulate(self.leaves[node - self.width][0], initial=before))
        k = max(0, min(bisect_right(ends, place) - 1, len(ends) - 2))
        return node - self.width, k, ends[k]

    def _back(self, leaf: int, k: int, start: int, steps: int) -> tuple[int, int, int]:
        while steps and (k or leaf):
            if not k:
                leaf -= 1
                k = len(self.leaves[leaf][0])
                continue
            k -= 1
            start -= self.leaves[leaf][0][k]
            steps -= 1
        return leaf, k, start

    def _boundaries(self, leaf: int, k: int, start: int) -> Iterator[tuple[int, int, int]]:
        """(place, leaf, number) of old pre-tokens from one on, and last the end of the text."""
        for i in range(leaf, len(self.leaves)):
            lengths = self.leaves[i][0]
            for j in range(k if i == leaf else 0, len(lengths)):
                yield start, i, j
                start += lengths[j]
        yield start, len(self.leaves), 0

    def edit(self, edits: list[Edit]) -> None:
        """Replaces text[start:end] for each edit; edits are in order and do not overlap."""
        pieces, at = [], 0
        for start, end, new in edits:
            pieces += [self.text[at:start], new]
            at = end
        new_text = "".join([*pieces, self.text[at:]])
        patches, i, shift, done = [], 0, 0, 0
        while i < len(edits):
            leaf, k, start = self._back(*self.find(edits[i][0]), CONTEXT)
            old = self._boundaries(leaf, k, start)
            place = next(old)
            if start < done:  # the region before reaches into this one's context
                while place[0] < done:
                    place = next(old)
                leaf, k, start = place[1], place[2], place[0]
            first, fresh, new_at = start + shift, [], start + shift
            shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
            end, i = edits[i][1], i + 1
            while True:
                while place[0] < end or place[0] + shift < new_at:
                    if place[1] == len(self.leaves):
                        break
                    place = next(old)
                # an edit that begins where this region still runs belongs to it
                if i < len(edits) and edits[i][0] <= max(place[0], new_at - shift):
                    shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                    end, i = max(end, edits[i][1]), i + 1
                    continue
                if place[0] >= end and place[0] + shift == new_at:
                    break
                match = self.counter.pattern.match(new_text, new_at)
                if match is None:
                    break
                fresh.append(match.group())
                new_at = match.end()
            done = place[0]
            patches.append(((leaf, k), (place[1], place[2]), fresh))
        self.text = new_text
        for begin, end, fresh in reversed(patches):
            self._patch(begin, end, fresh)

    def _patch(self, begin: tuple[int, int], end: tuple[int, int], fresh: list[str]) -> None:
        (a, i), (b, j) = begin, end
        counts = self.counter(fresh)
        self.encoded += len(fresh)
        touched = range(a, min(b, len(self.leaves) - 1) + 1)
        self.pre_tokens += len(fresh)
        for leaf in touched:
            lengths, tokens = self.leaves[leaf]
            low, high = (i if leaf == a else 0), (j if leaf == b else len(lengths))
            self.pre_tokens -= high - low
            new = (list(map(len, fresh)), counts) if leaf == a else ([], [])
            self.leaves[leaf] = (lengths[:low] + new[0] + lengths[high:], tokens[:low] + new[1] + tokens[high:])
            self.chars[self.width + leaf], self.tokens[self.width + leaf] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        nodes = {(self.width + leaf) // 2 for leaf in touched} - {0}
        while nodes:
            for node in nodes:
                self._sum(node)
            nodes = {node // 2 for node in nodes} - {0}


def clean_edits(edits: list[Edit | None] | None, size: int) -> list[Edit]:
    """In order, cut to the text; null edits and such that overlap an earlier one are left out; a null replacement deletes."""
    out, at = [], 0
    for start, end, new in sorted((max(0, e[0] or 0), min(size, size if e[1] is None else e[1]), e[2] or "") for e in edits or [] if e is not None):
        if start >= at and end >= start and (end > start or new):
            out.append((start, end, new))
            at = max(end, at)
    return out


def count_tokens(documents: DataFrame, edits: str | Callable[[str], list[Edit]], id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_pre_tokens, n_edits, n_tokens_edited, n_pre_tokens_edited, n_encoded_again): one row per document row.

    edits names a column of array<struct<start int, end int, replacement string>>, in characters of the old text, or is a
    function from text to such a list. Null texts are empty and have no edits; empty texts have no tokens; repeated
    rows are counted alike; null ids and other columns do not matter. Ids are passed on.
    """
    ranks = Path(vocabulary).read_bytes()
    named = isinstance(edits, str)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(edits).alias("edits")] if named else []))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            out = []
            given = [e and [x and (x["start"], x["end"], x["replacement"]) for x in e] for e in batch.column(2).to_pylist()] if named else None
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                todo = clean_edits(given[i] if named else edits(text), len(text))
                tree = TokenTree(text, counter)
                before = (tree.total, tree.pre_tokens)
                if todo:
                    tree.edit(todo)
                out.append((*before, len(todo), tree.total, tree.pre_tokens, tree.encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=OUT)

    return rows.mapInArrow(count, StructType([rows.schema["doc_id"], *StructType.fromDDL(", ".join(f"{n} long" for n in OUT[1:])).fields]))


OUT = ["doc_id", "n_tokens", "n_pre_tokens", "n_edits", "n_tokens_edited", "n_pre_tokens_edited", "n_encoded_again"]
#: Mail addresses, long hexadecimal keys, network addresses and card numbers.
PERSONAL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]*\w|\b[0-9A-Fa-f]{24,}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{13,16}\b")
TELLING, RUN = re.compile(r"[0-9@]"), re.compile(r"[\w.@+-]*")


def redactions(text: str) -> list[Edit]:
    """Edits that replace personal data and keys. Only runs of word characters and .@+- that hold a digit or an @ are looked at."""
    out, end = [], 0
    for hint in TELLING.finditer(text):
        if hint.start() < end:
            continue
        start = hint.start()
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "_.@+-"):
            start -= 1
        end = RUN.match(text, hint.start()).end()
        out += [(m.start(), m.end(), "[removed]") for m in PERSONAL.finditer(text, start, end)]
    return out


@CATALOGUE.register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), redactions)
