"""Distinct pieces of text encoded once by a tokenizer library, kept in bounded tables of the worker."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

#: The steps of a tokenizer file under which ASCII words without ' fall into runs of letters, single digits and runs of other
#: marks, each encoded by itself after lower-casing (fixed values of the file format).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def _class(byte: int) -> int:
    c = chr(byte)
    if byte == 32 or 9 <= byte <= 13:
        return SPACE
    if byte < 33 or byte > 126 or c == "'":
        return ODD
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK


CLASSES = bytes(_class(b) for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters from U+00C0 to U+00FF stand as 0xC3 and a second byte, those up to U+00DE 0x20 below their lower case.
LATIN, NOT_LETTERS, LAST_UPPER = 0xC3, (0x97, 0xB7), 0x9E
#: The characters by which models over bytes know the bytes that aren't printable in Latin-1 (fixed values of the file format).
BYTE_CHARS = {b: 256 + 34 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 256 + 67}
#: Masks that keep the first k bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def cuts_at_spaces(spec: dict) -> bool:
    """Whether tokens never reach over ASCII white space: a removing split whose pattern leaves white space out.

    Composition (NFC) doesn't reach over it either, as no composed character starts with it.
    """
    steps = spec.get("pre_tokenizer") or {}
    splits = [s for s in steps.get("pretokenizers", [steps]) if s.get("type") == "Split"]
    whole = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and len(t["content"].split()) == 1 for t in spec["added_tokens"])
    return bool(splits) and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and r"[^\s" in splits[0]["pattern"].get("Regex", "") and whole


def cuts_ascii_words(spec: dict) -> bool:
    """Whether the file has just the steps named above, so that pieces of plain words can be encoded by its model alone."""
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    normal, before = normal.get("normalizers", []), before.get("pretokenizers", [])
    return (
        cuts_at_spaces(spec)
        and [n["type"] for n in normal] == NORMALIZERS
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [p["type"] for p in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"] == {"Regex": SPLIT}
        and not before[1]["add_prefix_space"]
        and not before[1]["use_regex"]
        and spec["model"].get("dropout") is None
        and all(t["content"].startswith("<|") for t in spec["added_tokens"])
    )


class PieceTable:
    """Token ids (or their number) of whole texts, each distinct piece encoded once while the table holds it.

    With a fitting file, words of ASCII and Latin-1 letters are cut into pieces
    side by side in numpy; pieces of up to 16 bytes are looked up as two 64-bit
    numbers, so exactly, in a hash table with open addressing. Other words are kept
    whole in a dictionary and encoded by the library's full steps. Beyond
    limit pieces or as many bytes of words the table starts anew, so its
    memory doesn't follow the input.
    """

    def __init__(self, path: str, *, keep_ids: bool = True, limit: int = 1 << 20, word_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.by_word, self.by_piece = cuts_at_spaces(spec), cuts_ascii_words(spec)
        self.model, self.keep_ids, self.limit, self.word_bytes = self.tokenizer.model, keep_ids, limit, word_bytes
        self.mark = self._mark()
        self.begin()

    def begin(self) -> None:
        self.bits = 16
        self.keys, self.at = np.zeros((1 << self.bits, 2), np.uint64), np.zeros(1 << self.bits, np.int32)
        self.words: dict[bytes, int] = {}
        self.held = self.held_bytes = self.used = self.stored = 0
        self.start, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.uint32)

    def _mark(self) -> tuple[str, int] | None:
        """A caseless symbol that stands as one id of its own: a word without it never has that id."""
        for symbol in "©®°±§¶†•":
            ids = self.tokenizer.encode(f"a {symbol} a", add_special_tokens=False).ids
            if len(ids) == 3 and self.tokenizer.encode(symbol, add_special_tokens=False).ids == [ids[1]]:
                return symbol, ids[1]
        return None

    def _add(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with their ids, kept one after the other."""
        first, n = self.used, len(counts)
        self.used += n
        while self.used > len(self.count):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        self.count[first : self.used] = counts
        if self.keep_ids:
            self.start[first : self.used] = self.stored + np.cumsum(counts) - counts
            while self.stored + len(ids) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros_like(self.ids))
            self.ids[self.stored : self.stored + len(ids)] = ids
            self.stored += len(ids)
        return np.arange(first, self.used)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot, last = self._slots(keys), (1 << self.bits) - 1
        while len(slot):
            free = np.flatnonzero(self.keys[slot, 0] == 0)
            _, pick = np.unique(slot[free], return_index=True)
            put = free[pick]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], numbers[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            slot, keys, numbers = (slot[rest] + 1) & last, keys[rest], numbers[rest]

    def _pieces(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of pieces by their keys; new ones are encoded by the model."""
        slot, missing = self._slots(keys), []
        held, out = self.keys.take(slot, axis=0), self.at.take(slot).astype(np.int64)
        left = np.flatnonzero((held[:, 0] != keys[:, 0]) | (held[:, 1] != keys[:, 1]))  # most stand in their first slot
        slot = slot[left]
        while len(left):
            held = self.keys[slot]
            same = (held[:, 0] == keys[left, 0]) & (held[:, 1] == keys[left, 1])
            out[left[same]] = self.at[slot[same]]
            missing.append(left[held[:, 0] == 0])
            more = ~same & (held[:, 0] != 0)
            left, slot = left[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        missing = np.concatenate(missing) if missing else left
        if len(missing):
            new, back = np.unique(keys[missing].astype("<u8").view("S16").ravel(), return_inverse=True)
            tokenize = self.model.tokenize
            got = [[t.id for t in tokenize(p.decode() if p.isascii() else p.decode("latin-1").translate(BYTE_CHARS))] for p in new.tolist()]
            counts = np.fromiter(map(len, got), np.int32, len(got))
            numbers = self._add(counts, np.fromiter((x for ids in got for x in ids), np.uint32) if self.keep_ids else counts)
            self.held += len(new)
            while self.held * 2 > 1 << self.bits:
                self._grow()
            self._insert(np.ascontiguousarray(new).view("<u8").reshape(-1, 2), numbers)
            out[missing] = numbers[back.ravel()]
        return out

    def _grow(self) -> None:
        filled = np.flatnonzero(self.keys[:, 0])
        keys, numbers = self.keys[filled], self.at[filled]
        self.bits += 1
        self.keys, self.at = np.zeros((1 << self.bits, 2), np.uint64), np.zeros(1 << self.bits, np.int32)
        self._insert(keys, numbers)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words that the library's full steps encode."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        for i in range(0, len(new), 8192):  # few at a time: encodings are far larger than their ids
            some = [w.decode() for w in new[i : i + 8192]]
            joined = [j for j, w in enumerate(some) if self.mark and self.mark[0] not in w]
            alone = sorted(set(range(len(some))) - set(joined))
            got: list[list[int]] = [[] for _ in some]
            if joined:
                symbol, mark = self.mark
                ids = [x for t in self._encode([f" {symbol} ".join([*(some[j] for j in joined[k : k + 128]), ""]) for k in range(0, len(joined), 128)]) for x in t]
                ends = np.flatnonzero(np.array(ids) == mark).tolist()
                for j, a, b in zip(joined, [-1, *ends], ends):
                    got[j] = ids[a + 1 : b]
            for j, ids in zip(alone, self._encode([some[j] for j in alone])):
                got[j] = ids
            numbers = self._add(np.fromiter(map(len, got), np.int32, len(got)), np.fromiter((x for ids in got for x in ids), np.uint32))
            self.words.update(zip(new[i : i + 8192], numbers.tolist()))
        self.held_bytes += sum(map(len, new)) + 128 * len(new)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces in order, how many for each text); texts are joined by a line break, which no piece holds."""
        if self.held > self.limit or self.held_bytes > self.word_bytes:
            self.begin()
        text = b"\n".join(texts) + b"\n"
        kind = np.frombuffer(bytearray(text.translate(CLASSES)), np.uint8)
        low = bytearray(text.translate(LOWER) + bytes(32))
        if self.by_piece and (pairs := np.flatnonzero(np.frombuffer(text, np.uint8) == LATIN)).size:
            small = np.frombuffer(low, np.uint8)
            second = small[pairs + 1]
            letters = (second != NOT_LETTERS[0]) & (second != NOT_LETTERS[1])
            kind[pairs[letters]] = kind[pairs[letters] + 1] = LETTER
            small[pairs[letters & (second <= LAST_UPPER)] + 1] += 32
        before = np.append(np.uint8(SPACE), kind[:-1])
        edge = kind != before
        if self.by_piece:
            cut = np.flatnonzero(edge | (kind == DIGIT))
        else:
            cut = np.flatnonzero((kind == SPACE) != (before == SPACE))
        begins = kind[cut] != SPACE
        start, end = cut[begins], np.append(cut[1:], len(text))[begins]
        head = before[start] == SPACE
        word = np.cumsum(head) - 1
        if self.by_piece:
            odd = np.zeros(int(word[-1]) + 1 if len(word) else 0, bool)
            odd[word[kind[start] == ODD]] = True
            odd[word[end - start > 16]] = True
            if b"<|" in text:  # may be an added token, which the library looks for first
                marks = np.frombuffer(text, np.uint8)
                at = np.flatnonzero((marks[:-1] == ord("<")) & (marks[1:] == ord("|")))
                odd[np.searchsorted(start[head], at, side="right") - 1] = True
        else:
            odd = np.ones(int(head.sum()), bool)
        slow = odd[word]
        stop = end
        if slow.any():
            tail = np.append(np.flatnonzero(head)[1:] - 1, len(start) - 1) if len(start) else head.nonzero()[0]
            last = end[tail]
            keep = ~slow | head
            start, stop, slow, word = start[keep], np.where(slow, last[word], end)[keep], slow[keep], word[keep]
        out = np.empty(len(start), np.int64)
        fast = np.flatnonzero(~slow)
        if len(fast):
            eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
            at, size = start[fast], (stop - start)[fast]
            keys = np.stack([eight[at] & FIRST[np.minimum(size, 8)], eight[at + 8] & FIRST[np.clip(size - 8, 0, 8)]], axis=1)
            out[fast] = self._pieces(keys)
        rest = np.flatnonzero(slow)
        if len(rest):
            out[rest] = self._whole([text[a:b] for a, b in zip(start[rest].tolist(), stop[rest].tolist())])
        ends = np.cumsum([len(t) + 1 for t in texts])
        return out, np.diff(np.searchsorted(start, ends), prepend=0)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if not self.by_word:
            return np.array([len(x) for x in self._encode([t.decode() for t in texts])], np.int64)
        at, n = self.numbers(texts)
        total = np.append(0, np.cumsum(self.count[at], dtype=np.int64))
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with end_id after it; how many for each)."""
        if not self.by_word:
            got = [[*x, end_id] for x in self._encode([t.decode() for t in texts])]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        at, n = self.numbers(texts)
        start, count = self.start[at], self.count[at].astype(np.int64)
        total, ends = np.append(0, np.cumsum(count)), np.cumsum(n)
        own = total[ends] - total[ends - n]
        out = np.full(int(total[-1]) + len(texts), end_id, np.uint32)
        gap = np.repeat(np.arange(len(texts)), n)  # end ids before each piece
        out[runs(total[:-1] + gap, count)] = self.ids[runs(start, count)]
        return out, own + 1


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run of n."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """A worker's one table that outlives a task: asking for another lets the former go, so earlier stages hold no memory."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
