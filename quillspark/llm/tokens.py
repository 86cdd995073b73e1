"""Token ids of whole texts, word by word, with the words of a task encoded once.

A tokenizer that drops white space and never looks across it gives a text's
ids as those of its words put together.  So each worker encodes every word it
meets once, many new words in one call, and joins the kept bytes.  Other
tokenizers (told apart by probing) get whole texts.

Ids travel as little-endian unsigned 32-bit numbers in bytes objects.
"""

from __future__ import annotations

import hashlib
import re
import string
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np

#: Characters of a text that are worked on at once; a word that is longer stays whole.
WINDOW = 1 << 20
#: Words kept by a worker, and parts of words; beyond that it starts anew.
KEPT, KEPT_PARTS = 700_000, 700_000
#: Words of a line that is encoded in one call.
LINE = 500
#: Marks that are cut from a word's ends. The apostrophe stays: tokenizers join it with what follows.
MARKS = string.punctuation.replace("'", "")
#: Unicode white space; str.split() would also cut at U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def by_words(tokenizer) -> bool:
    """Whether the ids of words are the ids of the text they make."""

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    probes = [("Ab,", "c1'll"), ("x", "é."), ("7", "<"), ("'", "s"), ("n't", "-a")]
    return all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a, b in probes for gap in (" ", "\n", " \t ", "　")) and ids(" a ") == ids("a")


def kept_words(tokenizer_json: str) -> WordIds:
    """The worker's words of this tokenizer: a Python process that Spark gives another task still has them."""
    place = sys.modules.setdefault("quillspark_kept_words", types.ModuleType("quillspark_kept_words")).__dict__
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in place:
        place[key] = WordIds(tokenizer_json)
    return place[key]


class WordIds:
    """The ids of texts by one tokenizer, given as its JSON text."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.local = by_words(self.tokenizer)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if token.endswith("</w>"):
                self.ends[k] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.local &= not any(re.search(rf"[{SPACE}]", s) for s in self.special)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        """Runs of letters go in lines; a line's ids are cut where words end, if it has as many ends as words."""
        lines = [parts[a : a + LINE] for a in range(0, len(parts), LINE)]
        for line, ids in zip(lines, self._encode([" ".join(x) for x in lines])):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(line):
                raw, at = ids.tobytes(), 0
                for word, stop in zip(line, (stops * 4).tolist()):
                    self.parts[word] = raw[at:stop]
                    at = stop
            else:
                self.parts |= {word: x.tobytes() for word, x in zip(line, self._encode(line))}

    def _learn(self, new: set[str], special: bool) -> None:
        """Words of letters between marks are put together from their parts; others are encoded whole."""
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        parts, words, lower = self.parts, self.words, self.lower
        odd, cut, wanted, marks = [], [], set(), set()
        for word in new:
            if word.isalpha():
                a = c = ""
                core = word
            else:
                core = word.strip(MARKS)
                if not core.isalpha() or (special and any(s in word for s in self.special)):
                    odd.append(word)
                    continue
                a, _, c = word.partition(core)
                if a and a not in parts:
                    marks.add(a)
                if c and c not in parts:
                    marks.add(c)
            if lower and core.isascii():
                core = core.lower()
            if core not in parts:
                wanted.add(core)
            cut.append((word, a, core, c))
        self._learn_parts(list(wanted))
        for texts, into in ((list(marks), parts), (odd, words)):
            into.update((t, x.tobytes()) for t, x in zip(texts, self._encode(texts)))
        parts[""] = b""
        for word, a, core, c in cut:
            words[word] = parts[core] if not (a or c) else parts[a] + parts[core] + parts[c]

    @property
    def lower(self) -> bool:
        """Whether the tokenizer takes capitals for small letters."""
        if not hasattr(self, "_lower"):
            a, b = (self._encode([x])[0].tolist() for x in ("QUICK Az", "quick az"))
            self._lower = a == b
        return self._lower

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, the new words of all of them learned at once."""
        lists = [[w for w in re.split(f"[{SPACE}]+", t) if w] if re.search("[\x1c-\x1f]", t) else t.split() for t in texts]
        new = set().union(*lists)
        new.difference_update(self.words.keys() & new)
        if new:
            special, before = any(s in t for t in texts for s in self.special), len(self.words)
            self._learn(new, special)
            if len(self.words) < before + len(new):  # it started anew
                self._learn(set().union(*lists) - self.words.keys(), special)
        return [b"".join(map(self.words.__getitem__, x)) for x in lists]

    def encoded(self, text: str) -> Iterator[bytes]:
        """The ids of ``text``, window by window."""
        if not self.local:
            yield self._encode([text])[0].tobytes()
            return
        at = 0
        while at < len(text):
            stop = at + WINDOW
            if stop < len(text):
                gap = re.compile(f"[{SPACE}]").search(text, stop)
                stop = gap.start() if gap else len(text)
            yield self._joined([text[at:stop]])[0]
            at = stop

    def all_encoded(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """As ``encoded`` for each text, short ones together."""
        held, size = [], 0
        for text in texts:
            if not self.local or len(text) > WINDOW:
                yield from map(iter, zip(self._joined(held)))
                held, size = [], 0
                yield self.encoded(text)
                continue
            held.append(text)
            size += len(text)
            if size >= WINDOW:
                yield from map(iter, zip(self._joined(held)))
                held, size = [], 0
        yield from map(iter, zip(self._joined(held)))
