"""Toxicity of texts whose words may be disguised: noisy-channel restoring, then a learnt lexicon.

Method. Invisible characters inside words go, and letters of other scripts that look like Latin ones count
as these in words that also hold Latin ones. Spans that look disguised (digits or signs inside words, letters
three times in a row, single letters set apart by any short run of other characters, words with a sign
between two letters) are found by numpy over the bytes of a batch. Each is a lattice of letters that may
stand behind its characters; Viterbi decoding under a character trigram model picks the likeliest
letters, and the restored text is scored. A star inside a word may stand for any letter; a word parted by
another sign is also read whole, where the model finds that likelier. A word with doubled letters also counts as the lexicon entry
that it holds without the doubling, where the model finds that likelier. The character model counts the trigrams of all texts. The
lexicon (whole words, and beginnings of words, written with ``*``) and the weights of a logistic model
are learnt from a bounded sample of labelled rows; entries are judged by the different contexts they
have in toxic and other texts, so that a passage copied many times counts about once.

Defined results. Null and empty texts have the score of a text without any lexicon word. Texts of any
length are scored whole. Repeated rows are all scored; columns but id and text aren't read. With no
labelled row or only one class, all scores are the share of toxic labels (0 if there is none).
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, small_batches, spread
from .shingles import batches

#: Labelled rows that the lexicon and weights are learnt from, at most.
SAMPLE_ROWS = 20_000
#: Lexicon: least contexts in toxic texts, evidence (G squared) and odds of an entry; all that have these are kept.
LEAST_CONTEXTS, LEAST_EVIDENCE, LEAST_ODDS = 3, 18.0, 6.0
#: Slots of the filter that spares counting entries of clean texts that toxic ones lack; a power of two.
FILTER = 1 << 20
CHUNK = 1 << 20
#: Contexts that are held before they are passed on.
CONTEXTS = 50_000
#: Lengths of the beginnings of words that are entries of their own.
BEGINNINGS = (4, 5, 6)
#: Characters that may stand for letters: fixed values.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
#: Signs that may set single letters apart.
APART = " .-_*"
#: Bytes between single letters that are read as one word, at most; texts of a batch are set further apart.
MOST_GAP = 8
SEPARATOR = b"\n" * (MOST_GAP + 2)
#: Log costs of the channel: a sign for a letter, one letter for a doubled one, a star for any letter.
SIGN_COST, HALF_COST, STAR_COST = -1.0, -2.0, -3.0
#: Signs that may part a word, with a letter at either side.
PARTING = "._,:*"
#: Letters that look like a Latin one, and characters that can't be seen: fixed values.
LOOKS_LIKE = dict(zip("аеорсухіјѕԁһӏԛԝɡıοαειν", "aeopcyxijsdhlqwgioaeiv", strict=True))
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_SIZE = 28
_LETTER = _CLASS > 0
_LETTER[128:] = False
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in STANDS_FOR]] = True
#: Signs that don't count at a word's end, where they are punctuation.
_INNER = np.zeros(256, dtype=bool)
_INNER[[ord(c) for c in "!|$("]] = True
_PARTING = np.zeros(256, dtype=bool)
_PARTING[[ord(c) for c in PARTING]] = True
_APART = np.zeros(256, dtype=bool)
_APART[[ord(c) for c in APART]] = True
_WORDLIKE = _LETTER.copy()
_WORDLIKE[48:58] = True
_WORDLIKE[128:] = True
_CORE = _LETTER.copy()
_CORE[48:58] = _SIGN[48:58]
_EDGE = _APART.copy()
_EDGE[[9, 10, 13]] = True


def trigram_counts(texts: list) -> np.ndarray:
    """Counts of letter-class trigrams: 26 letters without case, other letters (27), anything else (0)."""
    total = np.zeros(_SIZE**3, dtype=np.int64)
    for a, b in batches(texts, CHUNK):
        data = np.frombuffer(b"\n\n" + b"\n\n".join(t.encode("utf-8", "surrogatepass") for t in texts[a:b] if t) + b"\n", dtype=np.uint8)
        c = _CLASS[data]
        if len(c) > 2:
            total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)
    return total


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of the third class of a trigram given the first two, from all texts."""

    def count(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, dtype=np.int64)
        for batch in batches_in:
            total += trigram_counts(batch.column(0).to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select(column(docs, text_col).cast("string").alias("text")).mapInArrow(count, "k long, n long")
    # at most 28 ** 3 rows, whatever the corpus
    rows = counted.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(_SIZE**3, 0.1)
    counts[rows.column("k").to_numpy()] += rows.column("n").to_numpy()
    counts = counts.reshape(_SIZE, _SIZE, _SIZE)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


_LIKE = "".join(LOOKS_LIKE) + "".join(k.upper() for k in LOOKS_LIKE if k.upper() > "\x7f")
_WIDE = "\uff21-\uff3a\uff41-\uff5a"
#: A look-alike beside a Latin letter, or a wide letter; words of one script alone have neither.
_MIXED = re.compile(f"[A-Za-z][{_LIKE}]|[{_LIKE}][A-Za-z]|[{_WIDE}]")
_ANY = re.compile(f"[{UNSEEN}{_LIKE}{_WIDE}]")
_ODD = re.compile(f"[{UNSEEN}]|{_MIXED.pattern}")
_WORDS = re.compile(r"\w+")
_HIDDEN = re.compile(rf"(?<=\w)[{UNSEEN}]+(?=\w)")
_TO_LATIN = str.maketrans({**LOOKS_LIKE, **{k.upper(): v.upper() for k, v in LOOKS_LIKE.items() if len(k.upper()) == 1 and k.upper() not in "I"}})
_NARROW = str.maketrans({chr(0xFEE0 + k): chr(k) for r in (range(65, 91), range(97, 123)) for k in r})


def unmasked(text: str) -> str:
    """The text without invisible characters inside words, look-alikes in words with Latin letters as these, wide letters as narrow ones."""
    if not (_ANY.search(text) and _ODD.search(text)):
        return text

    def word(m: re.Match) -> str:
        return m[0].translate(_NARROW).translate(_TO_LATIN) if _MIXED.search(m[0]) else m[0]

    return _WORDS.sub(word, _HIDDEN.sub("", text))


def spans(data: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of an array of bytes that look disguised, in order and apart."""
    letter, sign = _LETTER[data], _SIGN[data]
    if len(data) < 3:
        return []
    marks = np.zeros(len(data), dtype=bool)
    marks[:-1] |= sign[:-1] & letter[1:]
    marks[1:] |= sign[1:] & ~_INNER[data[1:]] & letter[:-1]
    low = data | 32
    marks[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    solid = letter | sign
    parting = np.zeros(len(data), dtype=bool)
    parting[1:-1] = _PARTING[data[1:-1]] & letter[:-2] & letter[2:]
    marks |= parting
    out = []
    hits = np.flatnonzero(marks)
    if len(hits):
        gaps = np.flatnonzero(~(solid | parting))
        before = np.searchsorted(gaps, hits)
        starts = np.where(before > 0, gaps[np.maximum(before - 1, 0)] + 1, 0) if len(gaps) else np.zeros(len(hits), int)
        stops = np.where(before < len(gaps), gaps[np.minimum(before, len(gaps) - 1)], len(data)) if len(gaps) else np.full(len(hits), len(data))
        out += zip(starts.tolist(), stops.tolist(), strict=True)
    apart = _APART[data]
    edge = np.concatenate(([True], _EDGE[data], [True]))
    alone = solid & edge[:-2] & edge[2:]
    if alone.any():
        at = np.flatnonzero(alone)
        # single letters two bytes apart, with the same kind of sign between
        joined = (np.diff(at) == 2) & apart[np.minimum(at[:-1] + 1, len(data) - 1)]
        cuts = np.flatnonzero(~joined)
        firsts, lasts = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(at) - 1]))
        out += [(int(at[a]), int(at[b]) + 1) for a, b in zip(firsts, lasts, strict=True) if b - a >= 2]
    # single letters, or digits for them, with any few bytes between that belong to no word
    wordlike = np.concatenate(([False], _WORDLIKE[data], [False]))
    at = np.flatnonzero(_CORE[data] & ~wordlike[:-2] & ~wordlike[2:])
    if len(at) > 2:
        inside = np.cumsum(wordlike[1:-1])
        joined = (np.diff(at) <= MOST_GAP + 1) & (inside[at[1:] - 1] == inside[at[:-1]])
        cuts = np.flatnonzero(~joined)
        firsts, lasts = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(at) - 1]))
        letters = np.concatenate(([0], np.cumsum(letter[at])))
        out += [(int(at[a]), int(at[b]) + 1) for a, b in zip(firsts, lasts, strict=True) if b - a >= 2 and letters[b + 1] - letters[a] >= 2]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(set(out)):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def decode(span: str, model: np.ndarray, star: bool = False) -> str:
    """The likeliest letters behind a span: Viterbi over the last two letter classes; star: a star is any letter."""
    chars = [c for c in span.lower() if c not in APART or (star and c == "*")]
    while chars and chars[-1] in "!|$(":
        chars.pop()
    groups: list[list] = []
    for c in chars:
        if groups and groups[-1][0] == c:
            groups[-1][1] += 1
        else:
            groups.append([c, 1])
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for c, n in groups:
        options = "abcdefghijklmnopqrstuvwxyz" if c == "*" else STANDS_FOR.get(c, c if "a" <= c <= "z" else "")
        step: dict[tuple[int, int], tuple[float, tuple]] = {}
        for letter in options or "\0":
            k = ord(letter) - 96 if letter != "\0" else 0
            cost = STAR_COST if c == "*" else SIGN_COST if c in STANDS_FOR else 0.0
            for copies in (1, 2) if n > 1 and k else (1,):
                for (x, y), (score, path) in best.items():
                    total, p, q = score + cost * copies + (HALF_COST if n == 2 and copies == 1 else 0.0), x, y
                    for _ in range(copies):
                        total += model[p, q, k]
                        p, q = q, k
                    if (p, q) not in step or step[p, q][0] < total:
                        step[p, q] = (total, (path, letter * copies if k else ""))
        best = step
    score, path = max(((s + model[x, y, 0], p) for (x, y), (s, p) in best.items()), key=lambda z: z[0])
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


_CORES = re.compile("[a-z0-9]")


def words_apart(span: str) -> list[str]:
    """The words that a span of single letters set apart may spell, without what is between; none if it is no such span.

    Signs that are in every gap only separate; others may stand for letters. Gaps with white space that are
    longer than the shortest may part words, so the span is read both parted and whole.
    """
    low = span.lower()
    gaps = _CORES.split(low)[1:-1]
    if len(gaps) < 2 or not all(gaps) or any(c >= "\x80" for c in low):
        return []
    between = set.intersection(*map(set, gaps))
    solid = [k for k, c in enumerate(low) if _CORES.match(c) or (c in STANDS_FOR and c not in between)]
    wide = [low[a + 1 : b] for a, b in zip(solid, solid[1:], strict=False)]
    least = min((len(g) for g in wide if g), default=0)
    words = [low[solid[0]]]
    for g, k in zip(wide, solid[1:], strict=True):
        if len(g) > least and any(c.isspace() for c in g):
            words.append("")
        words[-1] += low[k]
    return words if len(words) == 1 else [*words, "".join(words)]


_PARTED = re.compile(rf"[a-z]+(?:[{PARTING}][a-z]+)+", re.I)


def read(span: str, model: np.ndarray) -> str:
    """The words that a span may spell."""
    words = words_apart(span)
    if words:
        return " ".join(decode(w, model) for w in words)
    if not _PARTED.fullmatch(span):
        return decode(span, model)
    if "*" in span:
        return f"{span} {decode(span, model, star=True)}"
    parts = re.split(f"[{PARTING}]", span.lower())
    joined = "".join(parts)
    return f"{span} {joined}" if likelihood(joined, model) > sum(likelihood(p, model) for p in parts) else span


def restore(text: str | None, model: np.ndarray) -> str:
    """The text with its disguised spans decoded; others stay as they are."""
    if not text:
        return ""
    text = unmasked(text)
    raw = text.encode("utf-8", "surrogatepass")
    found = spans(np.frombuffer(raw, dtype=np.uint8))
    if not found:
        return text
    out, at = [], 0
    for a, b in found:
        span = raw[a:b].decode("latin-1")
        out += [raw[at:a], read(span, model).encode()]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _restored(texts: list, model: np.ndarray) -> Iterator[str]:
    """restore() of each text; the spans of many short texts are looked for at once."""
    for a, b in batches(texts, CHUNK):
        shown = [unmasked(t) if t else "" for t in texts[a:b]]
        raw = [t.encode("utf-8", "surrogatepass") for t in shown]
        stops = np.cumsum([len(r) + len(SEPARATOR) for r in raw])
        found = spans(np.frombuffer(SEPARATOR.join(raw) + SEPARATOR, dtype=np.uint8))
        odd = set(np.searchsorted(stops, [x for x, _ in found], side="right").tolist())
        for k, t in enumerate(shown):
            yield restore(t, model) if k in odd else t


_WORD = re.compile(r"[^\W\d_]+")
#: Words with a letter twice in a row; each is tried from its first letter only.
_RUNS = re.compile(r"(?<![^\W\d_])[^\W\d_]*?([a-z])\1[^\W\d_]*")
#: Such words whose entries are remembered.
KNOWN = 50_000


def hash64(*words: str) -> int:
    """A hash that is the same in every process."""
    return zlib.crc32(words[0].encode()) << 31 ^ zlib.crc32(words[1].encode())


def folded(text: str) -> str:
    """The text with one of each run of the same letter."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != raw[:-1]) | ~_LETTER[raw[1:]]
    return text if keep.all() else raw[keep].tobytes().decode("utf-8", "surrogatepass")


def likelihood(word: str, model: np.ndarray) -> float:
    """Log probability of a word's letters and its end under the character model."""
    total, x, y = 0.0, 0, 0
    for k in [*_CLASS[np.frombuffer(word.encode("utf-8", "surrogatepass"), dtype=np.uint8)].tolist(), 0]:
        total, x, y = total + model[x, y, k], y, k
    return total


def _found(automaton, low: str) -> dict[int, int]:
    """How often each entry of an automaton is in a text."""
    out: dict[int, int] = {}
    for end, (n, ks) in automaton.iter(low):
        if not (end >= n and low[end - n].isalpha()):
            whole = not (end + 1 < len(low) and low[end + 1].isalpha())
            for k, beginning in ks:
                if beginning != whole:
                    out[k] = out.get(k, 0) + 1
    return out


def _automaton(entries: list[tuple[str, bool]]):
    out, held = ahocorasick.Automaton(), {}
    for k, (w, beginning) in enumerate(entries):
        held.setdefault(w, []).append((k, beginning))
    for w, ks in held.items():
        out.add_word(w, (len(w), ks))
    out.make_automaton()
    return out


class Scorer:
    """A lexicon with weights: score = logistic(bias + sum of weight * log(1 + count))."""

    def __init__(self, words: list[str], weights: np.ndarray, bias: float, model: np.ndarray):
        self.words, self.weights, self.bias, self.model = words, weights, bias, model
        self.automaton, self.stretched, self.known = None, [], {}

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "stretched": [], "known": {}}

    def counts(self, text: str) -> dict[int, int]:
        """How often each lexicon word occurs as a whole word in a restored text."""
        if not self.words:
            return {}
        if self.automaton is None:
            entries = [(w.rstrip("*"), w.endswith("*")) for w in self.words]
            self.automaton = _automaton(entries), _automaton([(folded(w), b) for w, b in entries])
            self.stretched = [re.compile("".join(f"{c}{{{len(list(g))},}}" for c, g in itertools.groupby(w))) for w, _ in entries]
        low = text.lower()
        out = _found(self.automaton[0], low)
        for m in _RUNS.finditer(low):
            if m[0] not in self.known:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[m[0]] = self.doubled(m[0])
            for k in self.known[m[0]]:
                out[k] = out.get(k, 0) + 1
        return out

    def doubled(self, word: str) -> list[int]:
        """Entries that a word holds but for doubled letters, where the model finds it likelier without them."""
        out = []
        for k in _found(self.automaton[1], folded(word)):
            entry = self.words[k].rstrip("*")
            hit = self.stretched[k].match(word)
            if hit and len(hit[0]) > len(entry) and (hit.end() < len(word)) == self.words[k].endswith("*"):
                meant = entry + word[hit.end() :]
                if likelihood(meant, self.model) + HALF_COST * (len(word) - len(meant)) > likelihood(word, self.model):
                    out.append(k)
        return out

    def score(self, texts: list) -> Iterator[float]:
        for text in _restored(texts, self.model):
            z = self.bias + sum(self.weights[k] * math.log1p(n) for k, n in self.counts(text).items())
            yield 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model on the sparse features (rows, cols, values), and last its unpenalised bias: Newton steps by conjugate gradients."""
    w = np.zeros(width + 1)
    ridge = np.full(width + 1, penalty)
    ridge[-1] = 1e-6

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * v[cols], len(y)) + v[-1]

    def back(r: np.ndarray, x: np.ndarray = values) -> np.ndarray:
        return np.append(np.bincount(cols, x * r[rows], width), r.sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        d = p * (1 - p) + 1e-9
        scale = back(d, values * values) + ridge
        step, r = np.zeros(width + 1), back(y - p) - ridge * w
        z = r / scale
        along, size, least = z, r @ z, 1e-18 * (r @ z)
        for _ in range(4 * width + 40):
            if size <= least:
                break
            turned = back(d * times(along)) + ridge * along
            far = size / (along @ turned)
            step, r = step + far * along, r - far * turned
            z = r / scale
            along, size = z + (r @ z) / size * along, r @ z
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Learn from at most SAMPLE_ROWS labelled rows of docs, taken in the order of the hashed id."""
    rows = labels.select(column(labels, id_col).cast("long").alias("id"), column(labels, label_col).cast("int").alias("y")).where("id is not null and y is not null")
    rows = rows.orderBy(F.xxhash64("id"), "y").limit(SAMPLE_ROWS)
    sample = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    sample = scratch.keep(spread(sample).join(F.broadcast(rows), "id"), "sample")
    share = sample.agg(F.avg("y").alias("y")).first()["y"] or 0.0
    flat = Scorer([], np.zeros(0), math.log((share + 1e-9) / (1 - share + 1e-9)), model)
    if share in (0.0, 1.0):
        return flat

    def contexts(wanted: bytes | None):
        """Entries with their contexts; of those in slots of wanted only, where that is given."""

        def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[tuple[str, int, int]] = set()
            known: dict[str, int] = {}

            def counted(entry: str) -> int:
                if entry not in known:
                    if len(known) > CONTEXTS:
                        known.clear()
                    known[entry] = wanted[zlib.crc32(entry.encode("utf-8", "replace")) % FILTER]
                return known[entry]

            def table() -> pa.RecordBatch:
                columns = list(zip(*found, strict=True)) or [[], [], []]
                out = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["w", "c", "y"])
                found.clear()
                return out

            for batch in batches_in:
                for y, text in zip(batch.column("y").to_pylist(), _restored(batch.column("text").to_pylist(), model), strict=True):
                    seen = ["", *_WORD.findall(text.lower()), ""]
                    for before, w, after in zip(seen, seen[1:], seen[2:], strict=False):
                        for entry in (w, *(f"{w[:n]}*" for n in BEGINNINGS if n < len(w))):
                            if wanted is None or counted(entry):
                                found.add((entry, hash64(before, after), y))
                        if len(found) > CONTEXTS:
                            yield table()
            yield table()

        return run

    schema = "w string, c long, y int"
    counted = lambda rows, run, name: rows.mapInArrow(run, schema).groupBy("w").agg(F.count_distinct("c").alias(name))
    toxic = scratch.keep(counted(sample.where("y = 1"), contexts(None), "toxic").where(f"toxic >= {LEAST_CONTEXTS}"), "toxic")
    # at most FILTER rows; what else falls into their slots goes in the join
    used = toxic.select((F.crc32(F.col("w").cast("binary")) % FILTER).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    wanted = np.zeros(FILTER, dtype=np.uint8)
    wanted[used] = 1
    clean = counted(sample.where("y <> 1"), contexts(wanted.tobytes()), "clean")
    both = scratch.keep(toxic.join(clean, "w", "left").select("w", F.coalesce("clean", F.lit(0)).cast("double").alias("clean"), F.col("toxic").cast("double").alias("toxic")), "both")
    total = both.agg(F.coalesce(F.sum("clean"), F.lit(0.0)).alias("clean"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("toxic")).first()
    base = min(max(share, 1e-3), 1 - 1e-3)
    both = both.withColumn("expected", (F.col("clean") + F.col("toxic")) * base)
    rest = F.when(F.col("clean") > 0, F.expr("clean * ln(clean / (clean + toxic - expected))")).otherwise(0.0)
    both = both.withColumn("evidence", 2 * (F.expr("toxic * ln(toxic / expected)") + rest))
    odds = ((F.col("toxic") + 0.5) / (total["toxic"] + 1)) / ((F.col("clean") + 0.5) / (total["clean"] + 1))
    kept = both.where((F.col("toxic") > F.col("expected")) & (F.col("evidence") >= LEAST_EVIDENCE) & (odds >= LEAST_ODDS))
    lexicon = [w for _, w in sorted((-r["evidence"], r["w"]) for r in kept.select("evidence", "w").collect())]
    if not lexicon:
        return flat
    draft = Scorer(lexicon, np.zeros(len(lexicon)), 0.0, model)

    def features(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            found = [draft.counts(t) for t in _restored(batch.column("text").to_pylist(), model)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], ["y", "k", "n"])

    got = sample.mapInArrow(features, "y int, k array<int>, n array<int>").toArrow().to_pydict()  # SAMPLE_ROWS rows
    rows = np.repeat(np.arange(len(got["y"])), [len(k) for k in got["k"]])
    cols, counts = (np.array([v for row in got[c] for v in row], dtype=np.int64) for c in ("k", "n"))
    w = logistic(rows, cols, np.log1p(counts), np.array(got["y"], dtype=float), len(lexicon), penalty=0.3)
    return Scorer(lexicon, np.maximum(w[:-1], 0), float(w[-1]), model)


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: more likely toxic) of each row."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            scores = list(scorer.score(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return spread(source).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, scorer: Scorer, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below limit, unchanged, in the columns of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            keep = [s < limit for s in scorer.score(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


