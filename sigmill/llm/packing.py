"""Packing token sequences: bounded-space online best-fit over a bitset of free space."""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

LENGTH = 4096
OPEN = 512
#: Pieces that wait to be placed; the longest of them goes first.
WINDOW = 8192
#: Bytes of ids that may wait with them.
HELD = 16 << 20
#: Bytes of text whose words are looked up together.
CHUNK = 4 << 20
#: Words of each of two generations whose ids a worker remembers; 100,000 take about 20 MB.
MEMORY = 150_000
END = 1


class Bins:
    """Open bins keyed by free space. A bitset has bit f set where a bin with free space f is open:
    its lowest bit at or above a piece's length is the best fit. Where more than `most` are open, the
    fullest closes."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.bits, self.by, self.open, self.next = 0, {}, 0, 0

    def _put(self, free: int, bin_: int) -> None:
        if free:
            self.by.setdefault(free, []).append(bin_)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        bins = self.by[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of a piece of n tokens."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.next
            self.next += 1
            if n < self.length and self.open >= self.most:  # room for it: the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
        self._put(free - n, bin_)
        return bin_, self.length - free


def _list(column: pa.Array) -> list:
    """Faster than to_pylist(); whole numbers with nulls would become floats there."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of whole texts, word by word, where the vocabulary's own rules never look across ASCII white
    space: lower-cased NFC, split into runs of letters, single digits and runs of marks. The ids of a
    text are then those of its words in turn. Two generations of known runs of letters bound the
    memory: what is used again moves to the younger one. Texts for any other vocabulary are encoded as they are."""

    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    LETTERS = r"[\p{L}]+"
    #: Letters whose lower case is one letter wherever they stand, then marks that are a piece of
    #: their own: such words are learned many at a time, without the marks.
    PLAIN = "^(?P<a>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)(?P<m>[.,!?;:|]*)$"
    #: Words looked up at a time.
    STEP = 1 << 20

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.memory = memory
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = self._splits(rules)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if not self.by_word:
            return
        rule = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = re.compile(rule.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))  # of a lower-case ASCII word
        # For lower-case letters the normaliser and the rule for pieces change nothing.
        rules |= {"normalizer": None, "added_tokens": []}
        rules["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}
        self.light = Tokenizer.from_str(json.dumps(rules))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks: dict[str, bytes] = {"": b""}

    @classmethod
    def _splits(cls, rules: dict) -> bool:
        """Whether a vocabulary's rules are those of the class: read from the file, not assumed."""
        model, normal, pre = rules["model"], rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or normal.get("normalizers") != cls.NORMAL or len(pre) != 2:
            return False
        cut, flat = pre
        rule = (cut.get("pattern") or {}).get("Regex", "") if cut["type"] == "Split" else ""
        own = rule.split("|")
        return (
            cls.LETTERS in own and r"[\p{N}]" in own and r"[^\s\p{L}\p{N}]+" in own and all(re.fullmatch("'[a-z]+", x) for x in own if "\\" not in x)
            and len([x for x in own if "\\" in x]) == 3 and cut["behavior"] == "Removed" and cut["invert"]
            and flat["type"] == "ByteLevel" and not flat["add_prefix_space"] and not flat["use_regex"] and all(x["content"].startswith("<|") for x in rules["added_tokens"])
        )

    def _each(self, new: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        return {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(new, found, strict=True)}

    def _letters(self, new: list[str]) -> dict[str, bytes]:
        """Words of lower-case letters: one text of all of them, cut after each word's end."""
        out = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.asarray(self.light.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                out.update(self._each(part))
                continue
            raw = ids.tobytes()
            out.update((w, raw[i:j]) for w, i, j in zip(part, [0, *cuts[:-1]], cuts, strict=True))
        return out

    def _recall(self, words: list[str], learn) -> list[bytes]:
        """Ids of different words, from memory; learn(list) gives those of new ones."""
        known, old = self.known, self.old
        found = list(map(known.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in gaps:
            w = words[i]
            x = old.get(w)
            if x is None:
                new.append(w)
            else:
                known[w] = x
        known.update(learn(new))
        for i in gaps:
            found[i] = known[words[i]]
        return found

    def _signs(self, marks: list[str]) -> list[bytes]:
        if len(self.marks) > 50_000:
            self.marks = {"": b""}
        self.marks.update(self._each([m for m in marks if m not in self.marks]))
        return [self.marks[m] for m in marks]

    def _odd(self, new: list[str]) -> dict[str, bytes]:
        """Words that aren't letters with marks behind."""
        mixed, rest, runs, signs = {}, [], set(), set()
        for w in new:
            if w.isascii() and w.isprintable() and "<|" not in w:
                mixed[w] = own = self.pieces.findall(w.lower())
                for x in own:
                    (runs if x.isalpha() else signs).add(x)
            else:
                rest.append(w)
        runs, signs = list(runs), list(signs)
        ids = dict(zip(runs, self._recall(runs, self._letters), strict=True)) | dict(zip(signs, self._signs(signs), strict=True))
        return {w: b"".join([ids[x] for x in own]) for w, own in mixed.items()} | self._each(rest)

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: the ids of all their pieces, each piece's number of them, and the two
        pieces of each word."""
        found = pc.extract_regex(words, self.PLAIN)
        plain = np.asarray(found.is_valid())
        odd = _list(words.filter(pa.array(~plain)))
        found = found.drop_null()
        runs, marks = pc.utf8_lower(found.field(0)).dictionary_encode(), found.field(1).dictionary_encode()
        raw = self._recall(_list(runs.dictionary), self._letters)
        at = len(raw)
        raw += self._signs(_list(marks.dictionary))
        first, second = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[plain], second[plain] = runs.indices.to_numpy(), at + marks.indices.to_numpy()
        first[~plain] = np.arange(len(raw), len(raw) + len(odd))
        raw += self._recall(odd, self._odd)
        second[~plain] = len(raw)
        raw.append(b"")
        if len(self.known) > self.memory:
            self.old, self.known = self.known, {}
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4, first, second

    def many(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null: empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.asarray(e.ids, "<u4").tobytes() for e in found]
        split = pc.ascii_split_whitespace(texts)
        words, ends = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
        parts, sizes = [], np.zeros(len(words) + 1, np.int64)
        for at in range(0, len(words), self.STEP):
            part = words.slice(at, self.STEP).dictionary_encode()
            pool, size, first, second = self._pieces(part.dictionary)
            place = part.indices.to_numpy()
            piece = np.stack([first[place], second[place]], axis=1).ravel()
            n = size[piece]
            end = np.cumsum(n)
            sizes[at + 1 : at + 1 + len(place)] = n[::2] + n[1::2]
            parts.append(pool[np.arange(end[-1]) + np.repeat((np.cumsum(size) - size)[piece] - (end - n), n)].tobytes())
        whole, cuts = b"".join(parts), (4 * np.cumsum(sizes)[ends]).tolist()
        return [whole[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


_workers: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, memory: int) -> WordIds:
    """A worker process keeps one."""
    if (path, memory) not in _workers:
        _workers.clear()
        _workers[path, memory] = WordIds(path, memory)
    return _workers[path, memory]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of CHUNK bytes of text, or of one longer text."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + CHUNK, side="right")))
        yield batch.slice(at, to - at)
        at = to


PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, open_bins: int = OPEN, window: int = WINDOW, ids: bool = True, memory: int = MEMORY) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `length` tokens.

    tokenizer: path of a vocabulary file, which every executor has. A document is the ids of its
    whole text, then id 1; a null text counts as empty and is id 1 alone. Only longer documents are
    cut, into pieces of `length`. Each task packs its own rows, in one pass and in bounded memory: the
    pieces wait in a window, the longest of which goes to the open bin that it fills best, so only a
    task's last bins stay open; pieces of one length go in the order in which they come. Repeated rows
    are packed as often as they come, further columns are ignored, an empty table gives an empty one.
    Without ids, the array is null and only its checksum is there. memory: words that a worker remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, bins = word_ids(tokenizer, memory), Bins(length, open_bins)
        base = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        held = 0

        def placed(upto: int) -> Iterator[pa.RecordBatch]:
            """Places the longest until `upto` wait."""
            waiting.sort(key=lambda p: -p[3])
            go, waiting[:] = waiting[: len(waiting) - upto], waiting[len(waiting) - upto :]
            for at in range(0, len(go), 256):
                part = go[at : at + 256]
                where = [bins.place(p[3]) for p in part]
                raw = [np.frombuffer(p[4], np.int32) if ids else None for p in part]
                cols = [pa.array([p[k] for p in part], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                cols += [pa.array(raw, pa.list_(pa.int32())), pa.array([p[5] for p in part], pa.int64())]
                cols += [pa.array([base + b for b, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PIECES.split(", ")])

        gc.disable()  # it would walk the known words again and again; nothing here is cyclic
        try:
            for batch in batches:
                for part in _chunks(batch):
                    for k, raw in zip(_list(part.column(0)), words.many(part.column(1)), strict=True):
                        raw += END.to_bytes(4, "little")
                        n = len(raw) // 4
                        for i, s in enumerate(range(0, n, length)):
                            b = raw[4 * s : 4 * (s + length)]
                            waiting.append((k, i, s, len(b) // 4, b if ids else b"", zlib.crc32(b)))
                            held += len(waiting[-1][4])
                    if len(waiting) >= 2 * window or held > HELD:
                        yield from placed(min(window, len(waiting) // 2))
                        held = sum(len(p[4]) for p in waiting)
            yield from placed(0)
        finally:
            gc.enable()
            waiting.clear()
            give_back()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
