"""BPE encoding by a minimal acyclic transducer over frequent words, and decoding.

Words are counted over all documents; the most frequent ones, with their ids as
outputs, are compiled into a minimal acyclic automaton with shared suffixes.  Its arcs
carry numbers whose sum along a word's path is the word's rank, which addresses its
ids.  The automaton is one file in the shared folder that every executor gets from Spark and
its Python workers map into memory.  A word outside it is merged exactly by the
tokenizer itself.

Words are cut where byte-level pre-tokenisation always cuts (see ``_pieces``): a word is
a run without white space with the single space before it; what is left of white space
makes pieces of its own.  Only a text that spells a special token next to unusual
white space goes to the tokenizer whole, which looks for special tokens first.

Defined cases: null text is the empty text (no ids); repeated rows are all kept; an
empty table gives an empty result; other columns are not read unless asked for.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import most_frequent, shared_file, staged, text_of

#: Words compiled into the lexicon at most: bounds the file to a few MB.
LEXICON = 50_000
_CLOSING = ".,!?;:"
_SENT: set[tuple[str, str]] = set()
#: White space of the tokenizer's pattern (Python's own adds 1C-1F), but for space and newline.
_OTHER = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = " \n" + _OTHER
_ODD = ("  ", "\n\n", " \n", "\n ", "\x00", *_OTHER)
_PIECE = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


def _pieces(text: str) -> list[str]:
    """The words of a text, each with the single space before it, and the rest of its
    white space: a run at the end is one piece; before a word its last character is one
    (or the word's space) and what stands before that another."""
    if _is_odd(text):
        return _PIECE.findall(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if text else []


def _is_odd(text: str) -> bool:
    """Whether some white space is not a single space or newline inside the text."""
    return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(map(text.__contains__, _ODD))


def _parted(word: str) -> tuple[str, str] | None:
    """A word and its closing marks, which after a letter are a piece of their own."""
    stem = word.rstrip(_CLOSING)
    return (stem, word[len(stem) :]) if len(stem) < len(word) and stem and stem[-1].isalpha() else None


class Lexicon:
    """Minimal acyclic transducer from words (bytes) to id sequences."""

    FIELDS = ("key", "target", "number", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Add the words in order; a state that gets no further arcs is replaced by an
        equal one if there is one, so equal suffixes are stored once."""
        words = sorted(entries)
        arcs: list[dict[int, int]] = [{}]
        ends = [False]
        register: dict[tuple, int] = {}
        path, last = [0], b""

        def close(keep: int) -> None:
            while len(path) - 1 > keep:
                state = path.pop()
                same = register.setdefault((ends[state], tuple(arcs[state].items())), state)
                if same != state:
                    arcs[path[-1]][last[len(path) - 1]] = same

        for word in words:
            shared = len(os.path.commonprefix([last, word]))
            close(shared)
            for byte in word[shared:]:
                arcs.append({})
                ends.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            ends[path[-1]] = True
            last = word
        close(0)
        order, number = [0], {0: 0}
        for state in order:
            for to in arcs[state].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        below: dict[int, int] = {}
        todo = [0]
        while todo:
            state = todo[-1]
            open_ = [t for t in arcs[state].values() if t not in below]
            if open_:
                todo += open_
            else:
                below[state] = ends[state] + sum(below[t] for t in arcs[state].values())
                todo.pop()
        rows = []
        for state in order:
            count = int(ends[state])
            for byte in sorted(arcs[state]):
                to = arcs[state][byte]
                rows.append((number[state] << 8 | byte, number[to], count))
                count += below[to]
        rows.sort()
        columns = list(zip(*rows)) or [(), (), ()]
        return cls(
            {
                "key": np.array(columns[0], "<u4"),
                "target": np.array(columns[1], "<u4"),
                "number": np.array(columns[2], "<u4"),
                "final": np.array([ends[s] for s in order], np.uint8),
                "offset": np.cumsum([0, *(len(entries[w]) for w in words)]).astype("<u4"),
                "ids": np.array([i for w in words for i in entries[w]], "<u4"),
            }
        )

    def packed(self) -> bytes:
        """The file's bytes: a header, then the arrays at multiples of eight bytes."""
        head = json.dumps([[f, getattr(self, f).dtype.str, len(getattr(self, f))] for f in self.FIELDS]).encode()
        out = [len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8)]
        for f in self.FIELDS:
            raw = getattr(self, f).tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    def save(self, path: str) -> None:
        with open(path, "wb") as out:
            out.write(self.packed())

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Map a saved lexicon into memory."""
        raw = np.memmap(path, np.uint8, mode="r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        at, arrays = 8 + n + -n % 8, {}
        for f, kind, count in json.loads(raw[8 : 8 + n].tobytes()):
            size = np.dtype(kind).itemsize * count
            arrays[f] = raw[at : at + size].view(kind)
            at += size + -size % 8
        return cls(arrays)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 where it isn't in the lexicon; all words step together."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.key):
            return out
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        alive = np.flatnonzero(lengths > 0)
        state = np.zeros(len(words), np.int64)
        total = np.zeros(len(words), np.int64)
        for i in range(int(lengths[0])):
            alive = alive[lengths[alive] > i]
            want = (state[alive] << 8 | raw[starts[alive] + i]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            alive, at = alive[ok], at[ok]
            state[alive] = self.target[at]
            total[alive] += self.number[at]
            done = alive[lengths[alive] == i + 1]
            done = done[self.final[state[done]] == 1]
            out[order[done]] = total[done]
            if not len(alive):
                break
        return out

    def __getitem__(self, rank: int) -> bytes:
        return self.ids[self.offset[rank] : self.offset[rank + 1]].tobytes()


def _library(tokenizer: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    library.no_truncation()
    library.no_padding()
    return library


def _merged(library, texts: list[str]) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]


class Codec:
    """Encodes and decodes whole texts; one per Python worker.

    Ids of words are kept in two generations of bounded size: what is met again moves to
    the new one.  Words outside the lexicon go to the tokenizer many to a call: one that
    begins with its space begins with an id that spells a space, and holds no other.
    """

    def __init__(self, tokenizer: str, lexicon: Lexicon | None, keep: int = 800_000):
        self.library = _library(tokenizer)
        self.lexicon, self.keep = lexicon, keep
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        with open(tokenizer, encoding="utf-8") as f:
            model = json.load(f)
        names = dict(model["model"]["vocab"])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        byte = {c: bytes([b]) for b, c in shown.items()}
        spelled = {i: b"".join(byte[c] for c in name) for name, i in names.items() if all(c in byte for c in name)}
        spelled |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        self.spelled = [spelled.get(i, b"") for i in range(max(spelled, default=0) + 1)]
        self.special = [t["content"] for t in model["added_tokens"]]
        self.opens = np.array([x[:1] == b" " for x in self.spelled])

    def _learn(self, words: list[str]) -> None:
        parts = {w: p for w in words if (p := _parted(w))}
        words = list({w for w in words if w not in parts}.union(*parts.values()).difference(self.known))
        if self.lexicon is not None:
            ranks = self.lexicon.ranks([w.encode() for w in words]).tolist()
            self.known.update((w, self.lexicon[r]) for w, r in zip(words, ranks) if r >= 0)
            words = [w for w, r in zip(words, ranks) if r < 0]
        self._ask(words)
        self.known.update((w, self.known[stem] + self.known[marks]) for w, (stem, marks) in parts.items())

    def _ask(self, words: list[str], at_once: int = 256) -> None:
        alone = [w for w in words if w[:1] != " " or w == " " or any(s in w for s in self.special)]
        words = list(set(words).difference(alone))
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.opens[ids]).tolist()
            if len(starts) == len(group):
                raw = ids.tobytes()
                self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(group, starts, [*starts[1:], len(ids)]))
            else:
                alone += group
        self.known.update(zip(alone, self._merged(alone)))

    def _merged(self, texts: list[str]) -> list[bytes]:
        return _merged(self.library, texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special) and _is_odd(t)]
        split = [_pieces(t) for t in texts]
        for i in odd:
            split[i] = []
        if 2 * len(self.known) > self.keep:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = set().union(*split).difference(known)
        if new:
            known.update((w, old[w]) for w in new.intersection(old))
            self._learn(list(new.difference(known)))
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for i, ids in zip(odd, self._merged([texts[i] for i in odd]) if odd else []):
            out[i] = ids
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _codec(tokenizer: str, lexicon: str) -> Codec:
    """The Python worker's own codec: words merged in one task serve the next ones."""
    return Codec(tokenizer, Lexicon.open(SparkFiles.get(lexicon)))


def frequent_words(docs: DataFrame, size: int = LEXICON) -> DataFrame:
    """The most frequent words of all whole texts, met twice at least, ties by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush():
            for word, (stem, marks) in [(w, p) for w in total if (p := _parted(w))]:
                n = total.pop(word)
                total[stem] += n
                total[marks] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.column("text").slice(at, 500).to_pylist():
                    total.update(_pieces(text))
                if len(total) > 300_000:
                    yield from flush()
        yield from flush()

    words = docs.select(text_of().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return most_frequent(staged(words.where("n > 1"), "word-counts"), size).select("word")


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> str:
    """Compile the lexicon of ``docs``, hand its file to all executors, return its name.

    One task compiles it, of ``size`` words at most; the driver sees the file's bytes alone.
    """

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column("word").to_pylist() if w]
        merged = _merged(_library(tokenizer), words)
        raw = Lexicon.compile({w.encode(): np.frombuffer(i, "<u4").tolist() for w, i in zip(words, merged)}).packed()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

    raw = bytes(frequent_words(docs, size).repartition(1).mapInArrow(compiled, "raw binary").first().raw)
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()[:24]}"
    context = docs.sparkSession.sparkContext
    if (context.applicationId, name) not in _SENT:  # the name fixes the content
        context.addFile(shared_file(docs.sparkSession, name, raw))
        _SENT.add((context.applicationId, name))
    return name


def encoded(docs: DataFrame, tokenizer: str, keep: list[str], size: int = LEXICON, digest: bool = False, with_ids: bool = False) -> DataFrame:
    """``keep`` and the ids of every whole text.

    Columns: ids (binary, little-endian 32-bit) and decoded (string); with ``digest``
    n_tokens, ids_sha256 and decoded_sha256 in their place, after ``ids`` if ``with_ids``.
    """
    name = build_lexicon(docs, tokenizer, size)
    kinds = {"ids": "binary", "n_tokens": "long"}
    found = [*["ids"] * (with_ids or not digest), *(["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["decoded"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = _codec(tokenizer, name)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                ids = codec.encode(piece.column("__text").to_pylist())
                texts = map(codec.decode, ids)
                packed = [pa.array(ids, pa.binary())] if with_ids or not digest else []
                if digest:
                    packed += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(t.encode()) for t in texts], pa.string())]
                else:
                    packed.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *packed], [*keep, *found])

    schema = docs.select(*keep).schema
    for column in found:
        schema = schema.add(column, kinds.get(column, "string"))
    return docs.select(*keep, text_of().alias("__text")).mapInArrow(run, schema)
