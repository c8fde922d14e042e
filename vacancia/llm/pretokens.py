"""Pre-tokens of texts, and what is known of each distinct one.

A tokenizer file names a normalizer, a pattern that cuts text into pre-tokens
and special strings that stand for themselves. Texts of common characters are
cut here by a pattern of the same meaning; any other text is cut by the
library's own normalizer and pre-tokenizer, so results agree on all texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

from tokenizers import Tokenizer

# Characters on which Python and the library agree about letters, digits, white space and case.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_FAR = re.compile("[^\0-ſ]")
_ODD = re.compile("[\0-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\xa0²³¹¼½¾İ]")
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_WORDS = re.compile(f"[{_LETTERS}]+|[0-9]|{_ENDINGS}|[^\\s{_LETTERS}0-9]+")
_SPACED = re.compile(f" ?[{_LETTERS}]+|{_ENDINGS}| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")


class Pretokenizer:
    """Cuts a text into pre-tokens: strings the model sees one by one.

    Special strings come out as they are; `special` has their ids.
    """

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            described = json.load(f)
        self.file, self.decoder = file, described["decoder"]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                       for m in described["model"]["merges"]]
        self.ids = described["model"]["vocab"]
        self.word_end = described["model"].get("end_of_word_suffix") or ""
        kinds = [n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])]
        cutters = described["pre_tokenizer"].get("pretokenizers", [described["pre_tokenizer"]])
        if kinds == ["NFC", "Replace", "Lowercase"] and cutters[0]["type"] == "Split":
            self.lower, self._pattern = True, _WORDS
        elif not kinds and cutters[0]["type"] == "ByteLevel" and not cutters[0]["add_prefix_space"]:
            self.lower, self._pattern = False, _SPACED
        else:
            raise ValueError(f"no rule for the normalizer and pre-tokenizer of {file}")
        self._specials = (re.compile("(" + "|".join(map(re.escape, sorted(
            self.special, key=len, reverse=True))) + ")") if self.special else None)

    @cached_property
    def library(self) -> Tokenizer:
        """The library's tokenizer, loaded where a text or a model needs it."""
        library = Tokenizer.from_file(self.file)
        library.no_truncation()
        library.no_padding()
        return library

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._specials is not None and "<" in text and self._specials.search(text):
            out = []
            for part in self._specials.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _FAR.search(text) or _ODD.search(text):
            if self.library.normalizer is not None:
                text = self.library.normalizer.normalize_str(text)
            # In byte letters, marked, as the text itself is not known here.
            return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self._pattern.findall(text.lower() if self.lower else text)

    def letters(self, pretoken: str) -> str:
        """The pre-token in byte letters, as the model's merges spell it."""
        if pretoken[:1] == "\0" and len(pretoken) > 1:
            return pretoken[1:]
        return "".join(map(BYTE_LETTERS.__getitem__, pretoken.encode("utf-8")))


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the
    other bytes follow from 256 on in ascending order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        if b in shown:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


BYTE_LETTERS = _byte_letters()


class Known(dict):
    """What `learn` says of each distinct pre-token, asked once while it is kept.

    A bounded memory: beyond `limit` entries only what the current texts use is
    kept, which costs time, not results.
    """

    def __init__(self, learn: Callable[[list[str]], list], limit: int = 500_000):
        super().__init__()
        self.learn, self.limit = learn, limit

    def lookup(self, texts: list[Iterable[str]]) -> list[Iterable]:
        """What is known of the pre-tokens of each text, learning what is new."""
        found = [list(map(self.get, words)) for words in texts]
        lacking = [i for i, values in enumerate(found) if None in values]
        if not lacking:
            return found
        new = {w for i in lacking for w, value in zip(texts[i], found[i]) if value is None}
        if len(self) + len(new) > self.limit:
            wanted = set().union(*texts)
            kept = {w: self[w] for w in wanted.intersection(self)}
            self.clear()
            self.update(kept)
        new = list(new)
        self.update(zip(new, self.learn(new)))
        for i in lacking:
            found[i] = list(map(self.__getitem__, texts[i]))
        return found


class Learned(dict):
    """The same for a `learn` that takes one pre-token: asked on the spot where one is missing."""

    def __init__(self, learn: Callable[[str], object], limit: int = 500_000):
        super().__init__()
        self.learn, self.limit = learn, limit

    def __missing__(self, pretoken: str):
        value = self[pretoken] = self.learn(pretoken)
        return value

    def lookup(self, texts: list[Iterable[str]]) -> Iterator[Iterable]:
        for words in texts:
            if len(self) > self.limit:
                self.clear()
            yield map(self.__getitem__, words)
