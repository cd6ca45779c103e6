"""Token ids of whole texts, by the tokenizers library, with a cache per worker.

Added tokens of the vocabulary (such as its end mark) that stand literally in a text
are one id each, as in the library, and cut the text. Between them the splitter never
crosses white space, so the ids are those of the words one after the other. Words
repeat, so most are looked up.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Cached words per worker; the cache starts anew beyond it. It bounds memory, not results.
CACHE_WORDS = 800_000
#: Bytes of text whose words are numbered together; a longer document is taken alone. It bounds memory, not results.
STRETCH = 1 << 20
#: New words that go to the tokenizer as one text.
TOGETHER = 2_000
#: A word of Latin letters of one or two bytes, and the ASCII punctuation behind it; the splitter cuts between the two.
LATIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?|*#$%&]*)")
#: A word that ends in a Latin letter and ASCII punctuation: the splitter cuts between the two.
TAIL = re.compile(rb"(.*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([.,;:!?|*#$%&]+)", re.S)


def default_vocabulary() -> str:
    """Path of the public vocabulary; any file of the tokenizers library can stand in."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        #: The library encodes texts whole where added tokens are more than literal marks.
        self.whole = any(t.normalized or t.lstrip or t.rstrip or t.single_word or not t.special for t in added.values())
        #: Ids of added tokens. No word has a blank, so these keys differ from lower-cased words.
        self.marks = {b" " + t.content.encode(): np.array([k], "<u4").tobytes() for k, t in added.items()}
        literal = sorted((m[1:] for m in self.marks), key=len, reverse=True)
        self.literal, self.cut = literal, re.compile(b"(" + b"|".join(map(re.escape, literal)) + b")")
        # Words between marks are lower-cased, which must not turn them into marks.
        self.tokenizer.encode_special_tokens = not self.whole
        #: The empty word stands before leading white space.
        self.marks[b""] = b""
        self.cache: dict[bytes, bytes] = dict(self.marks)
        self.letters = None if self.whole else self._letters()
        names = self.tokenizer.get_vocab()
        #: Whether an id ends a word, where the vocabulary marks that.
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for name, k in names.items() if name.endswith("</w>")]] = True

    def _letters(self) -> dict[int, str] | None:
        """How the model writes bytes, if it takes Latin words byte by byte; else None.

        Bytes that print stand for themselves, the others for code points from 256 on.
        """
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in shown]
        table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}
        for word in ("a", "word", "unlikeliest", "stra\u00dfe", "\u00e9t\u00e9", "\u00c9t\u00e9", "\u00f1\u00e6\u00f8\u00fe\u00ff"):
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            if found != [t.id for t in self.tokenizer.model.tokenize(word.lower().encode().decode("latin-1").translate(table))]:
                return None
        return table

    def _fill(self, missing: set[bytes]) -> None:
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            self.cache.update(self.marks)
        cache, parts, latin, alone = self.cache, {}, set(), set()
        for w in missing:
            if self.letters and (m := LATIN.fullmatch(w)):
                body, tail = m.groups()
                latin.add(body)
                if tail:
                    parts[w] = body, tail
                    alone.add(tail)
            elif m := TAIL.fullmatch(w):
                parts[w] = m.groups()
                alone.update(parts[w])
            else:
                alone.add(w)
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for w in latin:
            if w not in cache:
                text = w.decode() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(letters)
                cache[w] = array("I", [t.id for t in tokenize(text)]).tobytes()
        alone = [w for w in alone if w not in cache]
        texts = [w.decode() for w in alone]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        for at in range(0, len(plain), TOGETHER):
            self._together([alone[k] for k in plain[at : at + TOGETHER]])
        rest = [k for k, w in enumerate(alone) if w not in cache]
        found = self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        cache.update((alone[k], np.array(e.ids, "<u4").tobytes()) for k, e in zip(rest, found))
        for w, (body, tail) in parts.items():
            cache[w] = cache[body] + cache[tail]

    def _together(self, words: list[bytes]) -> None:
        """Encode words of letters as one text and part the ids at the word ends.

        Each is one unit to the splitter. If the ends don't add up, nothing is kept.
        """
        ids = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids
        ids = np.array(ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) == len(words) and stops[-1] == 4 * len(ids):
            raw = ids.tobytes()
            self.cache.update((w, raw[a:b]) for w, a, b in zip(words, [0, *stops], stops))

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of words."""
        found = list(map(self.cache.get, words))
        if missing := [k for k, ids in enumerate(found) if ids is None]:
            self._fill({words[k] for k in missing})
            for k in missing:
                found[k] = self.cache[words[k]]
        return found

    def _marked(self, raw: bytes) -> bytes:
        """Ids of a text that holds added tokens, which are keys after a blank."""
        words: list[bytes] = []
        for k, part in enumerate(self.cut.split(raw)):
            words += [b" " + part] if k % 2 else part.lower().split()
        return b"".join(self._look_up(words))

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without added tokens."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).cast(pa.large_string())))
        numbered = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        if not len(numbered):
            return [b""] * len(texts)
        found = self._look_up(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        word = numbered.indices.to_numpy()
        own = sizes[word]
        ends = np.concatenate([[0], np.cumsum(own)])
        place = np.repeat((starts[word] - ends[:-1]).astype(np.int32), own)
        place += np.arange(ends[-1], dtype=np.int32)
        raw = ids[place].tobytes()
        at = (4 * ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _whole(self, raws: list[bytes]) -> list[bytes]:
        """Ids of texts by the library alone."""
        found = self.tokenizer.encode_batch_fast([r.decode() for r in raws], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _stretch(self, raws: list[bytes]) -> list[bytes]:
        if self.whole:
            return self._whole(raws)
        marked = [any(m in r for m in self.literal) for r in raws]
        plain = iter(self._plain([r for r, m in zip(raws, marked) if not m]))
        return [self._marked(r) if m else next(plain) for r, m in zip(raws, marked)]

    def stretches(self, texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
        """(place of the first text, ids) of one stretch of texts after the other."""
        raws: list[bytes] = []
        size = first = 0
        for k, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "replace")
            if raws and size + len(raw) > STRETCH:
                yield first, self._stretch(raws)
                raws, size, first = [], 0, k
            raws.append(raw)
            size += len(raw)
        if raws:
            yield first, self._stretch(raws)
        # Arrow keeps what it has freed; two workers share an executor's memory.
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str | None], step: int | None = None) -> list[bytes]:
        """Ids of each text as bytes, without an end id; null is empty. At most ``step`` texts are taken together."""
        step = step or max(1, len(texts))
        groups = (texts[at : at + step] for at in range(0, len(texts), step))
        return [ids for group in groups for _, part in self.stretches(group) for ids in part]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary; reused by its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


END_BYTES = np.array([END_ID], "<u4").tobytes()
