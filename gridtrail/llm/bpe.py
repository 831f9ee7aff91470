"""BPE encoding and decoding by speculate and verify.

Method. For the words of a batch that aren't known yet, an automaton proposes tokens by greedy longest
match over the joined words. A sequence of tokens is what exact merging gives if each token is what its
own characters merge to and no two neighbours would have merged differently across their border; that
is checked for every adjacent pair at once, by following the two tokens' merge trees along the border in
numpy. Only words that fail are merged exactly. Known words are kept in a table of bounded size, which
never changes a result.

The text pipeline of the tokenizer file is NFC, white space to a space, lower case, a pattern that
splits words, bytes to printable characters, and a mark at each word's end. Special tokens that occur in
a text are recognised, as the tokenizers library does by default.

Defined results. A null text is empty: no tokens, and an empty decoded text. Texts of any length are
encoded whole, CHUNK bytes of words at a time. Repeated rows are all returned, null ids stay, and an empty table gives no
rows; other columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, spread

#: Words kept between batches, at most, twice over: words of the last but one filling stay while they recur.
KNOWN_WORDS = 250_000
#: Symbols from which on a word is merged by itself.
LONG_WORD = 200
#: Characters of the longest word that is kept.
KNOWN_CHARS = 64
#: White space of the pattern language of the tokenizer file, and its word pattern: fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
END = "</w>"


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """A tokenizer file's vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != END or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("not a BPE with word ends")
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.word = regex.compile(WORD)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.table = {b: c for b, c in enumerate(printable_bytes())}
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(model["merges"])}
        most = max(self.names) + 1
        # the merge tree: each token's halves (itself if it is a single symbol) and its rank (-1)
        self.left, self.right, self.rank = np.arange(most), np.arange(most), np.full(most, -1)
        for (a, b), (r, t) in self.ranks.items():
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = a, b, r
        self.pairs = np.array(sorted((a << 32 | b, r) for (a, b), (r, _) in self.ranks.items()), dtype=np.int64)
        self.made_by = np.array([t for _, t in sorted(self.ranks.values())], dtype=np.int64)
        self.sound = self._sound()
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if self.sound[i]:
                self.automaton.add_word(self._marked(t), (i, len(self._marked(t))))
        self.automaton.make_automaton()
        self.known_ids: dict[str, bytes] = {}
        self.known_text: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = ({}, {})

    @staticmethod
    def _marked(token: str) -> str:
        """A token's text with one character for the word end."""
        return token.removesuffix(END) + "\0" if token.endswith(END) and token != END else token

    def symbols(self, word: str) -> list[int]:
        """Ids of a word's single symbols, the last one with the word's end."""
        chars = [self.table[b] for b in word.encode("utf-8")]
        chars[-1] += END
        return [self.ids[c] for c in chars]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, of those the leftmost; n log n."""
        ids = list(ids)
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(*found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := self.ranks.get((ids[k], ids[k + 1])))]
        heap = [(r, k, t, a, b) for r, t, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, t, a, b = heapq.heappop(heap)
            j = after[k] if not gone[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], gone[j] = t, True
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (found := self.ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [t for t, out in zip(ids, gone, strict=True) if not out]

    def merge_many(self, words: list[list[int]]) -> list[list[int]]:
        """merge() of many words at once: in each round, every word's pairs of its lowest rank.

        A pair with a new token ranks after that token, so merging all places of a pair at once, the left
        one first where they overlap, is the same as merging them one by one.
        """
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if len(w) < LONG_WORD]
        for k, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[k] = self.merge(w)
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        ids = np.fromiter((t for k in short for t in words[k]), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.array(short), sizes)
        none = np.iinfo(np.int64).max
        rank = np.full(len(ids), none)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.merge_rank(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(least < none, sizes)
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
                ids, word, rank = ids[open_], word[open_], rank[open_]
                if not len(ids):
                    break
                sizes, least = sizes[least < none], least[least < none]
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # of overlapping places every second one, from the left
            new_run = np.concatenate(([True], np.diff(at) > 1))
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made_by[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            changed = np.zeros(len(ids), dtype=bool)
            changed[at] = True
            ids, word, rank, changed = ids[keep], word[keep], rank[keep], changed[keep]
            touched = changed.copy()
            touched[:-1] |= changed[1:]
            look = np.flatnonzero(touched)
            rank[look] = none
            look = look[look < len(ids) - 1]
            look = look[word[look] == word[look + 1]]
            rank[look] = self.merge_rank(ids[look], ids[look + 1])
        word = np.concatenate([w for w, _ in done])
        ids = np.concatenate([i for _, i in done])
        order = np.argsort(word, kind="stable")
        word, ids = word[order], ids[order].tolist()
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        for k, x, y in zip(word[starts].tolist(), starts.tolist(), np.append(starts[1:], len(word)).tolist(), strict=True):
            out[k] = ids[x:y]
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, or a large number if they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs[:, 0], key), len(self.pairs) - 1)
        return np.where(self.pairs[at, 0] == key, self.pairs[at, 1], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, top: np.ndarray | None = None) -> np.ndarray:
        """Whether exact merging of a's and b's characters leaves the border between them alone.

        The state of a border as merging goes on: the part that touches it on either side, and the rank
        before which both parts exist unmerged. Going back in time, the part made last is split; the
        parts would merge across the border if their own merge comes before the next one of either side.
        top: ranks from which on merges don't matter (for the halves of a token, its own rank).
        """
        a, b = a.copy(), b.copy()
        until = np.full(len(a), np.iinfo(np.int64).max - 1) if top is None else top.copy()
        fine = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.merge_rank(x, y)
            # a tie is one pair left of the other: the left merge comes first
            x_made, y_made = self.rank[x], self.rank[y]
            bad = across < until[live]
            fine[live[bad]] = False
            single = (x_made < 0) & (y_made < 0)
            go = ~bad & ~single
            live, x, y, x_made, y_made = live[go], x[go], y[go], x_made[go], y_made[go]
            later_left = x_made > y_made
            same = x_made == y_made
            # of two merges of one rank the left one comes first, so the right one is undone first
            undo_left = later_left & ~same
            # while the left part is being made, its right half touches the border until that merge; at
            # the same rank a merge across the border lies to its right and comes later
            until[live] = np.where(undo_left, x_made, y_made + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return fine

    def _sound(self) -> np.ndarray:
        """Whether each token is what its own characters merge to."""
        out = self.rank < 0
        made = np.flatnonzero(self.rank >= 0)
        out[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            out[t] &= out[self.left[t]] and out[self.right[t]]
        return out

    def tokens(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word: proposed, verified, and merged exactly where that fails."""
        table = self.table
        texts = ["".join([table[b] for b in w.encode("utf-8")]) + "\0" for w in words]
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        stops = np.cumsum(sizes)
        hits = [(end + 1, t, n) for end, (t, n) in self.automaton.iter_long(joined)]
        if not hits:
            return self.merge_many([self.symbols(w) for w in words])
        ends, ids, lengths = np.array(hits, dtype=np.int64).T
        word = np.searchsorted(stops, ends - 1, side="right")
        covered = np.bincount(word, weights=lengths, minlength=len(words)) == sizes
        inner = word[1:] == word[:-1]
        a, b = ids[:-1][inner], ids[1:][inner]
        keys, back = np.unique(a << 32 | b, return_inverse=True)
        fits = self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back] if len(keys) else np.empty(0, bool)
        covered[word[:-1][inner][~fits]] = False
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        ids = ids.tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        failed = np.flatnonzero(~covered).tolist()
        for k, merged in zip(failed, self.merge_many([self.symbols(words[k]) for k in failed]), strict=True):
            out[k] = merged
        return out

    def words(self, text: str) -> list[str]:
        """A text's words after normalisation, without special tokens."""
        # white space, of whatever kind, is in no word, so it needn't be made a space first
        text = unicodedata.normalize("NFC", text)
        return self.word.findall(text.replace("\u03a3", "\u03c3").lower())

    def pieces(self, text: str) -> list:
        """A text's words in order; a special token is its id."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list = []
        for part in self.split.split(text):
            out += [self.special[part]] if part in self.special else self.words(part)
        return out

    def _learn(self, words: set) -> tuple[dict, dict]:
        """Make ids and decoded text (as bytes) of words known; those too long to be kept are returned."""
        if len(self.known_ids) + len(words) > KNOWN_WORDS:
            self.older = self.known_ids, self.known_text
            self.known_ids, self.known_text = {}, {}
        old_ids, old_text = self.older
        ids, text, names = self.known_ids, self.known_text, self.names
        local: tuple[dict, dict] = {}, {}
        new = []
        for w in words.difference(ids):
            if w in old_ids:
                ids[w], text[w] = old_ids[w], old_text[w]
            else:
                new.append(w)
        for w, found in zip(new, self.tokens(new) if new else [], strict=True):
            to_ids, to_text = (ids, text) if len(w) <= KNOWN_CHARS else local
            to_ids[w] = struct.pack(f"<{len(found)}I", *found)
            to_text[w] = " ".join([names[i] for i in found]).encode()
        return local

    def encode_bytes(self, texts: list) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text."""
        split = [self.pieces(t) if t else [] for t in texts]
        words: set = set().union(*split)
        special = words.intersection(self.special.values())
        local = self._learn(words - special)
        ids, text = self.known_ids, self.known_text
        local[0].update((i, struct.pack("<I", i)) for i in special)
        local[1].update((i, self.names[i].encode()) for i in special)
        ids.update(local[0])
        text.update(local[1])
        out = [(b"".join(map(ids.__getitem__, p)), b" ".join(map(text.__getitem__, p))) for p in split]
        for w in local[0]:
            del ids[w], text[w]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0][0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces: the tokenizer file names no decoder."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One per worker and file; the file must be at this path on every executor."""
    return Bpe(path)


#: Characters of the texts that are encoded together.
CHUNK = 1 << 20


def _batches(texts: list) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if held + n > CHUNK and k > start:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token_ids (array) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _batches(texts):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x, _ in bpe.encode_bytes(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    small_batches(docs.sparkSession)
    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, token_ids array<int>")


def digested(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; the ids themselves stay on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _batches(texts):
                found = bpe.encode_bytes(texts[a:b])
                columns = [batch.column("doc_id")[a:b], pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in found]), pa.array([hashlib.sha256(y).hexdigest() for _, y in found])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return spread(_texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of encoded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
