"""Vocabulary files of the tokenizers and the pieces into which texts may be cut safely.

A *safe piece* is a part of a text whose tokens don't depend on its neighbours:

- ``words``: vocabularies whose normaliser turns white space into single blanks and whose
  pre-tokeniser never crosses one; every run of non-space characters is a piece;
- ``blanks``: byte-level vocabularies where a blank belongs to the word that follows; texts are
  cut between a non-space and a single blank that a non-space follows;
- ``whole``: anything else; a text is one piece.
"""

from __future__ import annotations

import json
import os
import re
from operator import itemgetter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")  # str.split() cuts here, the \s of the vocabularies doesn't
_SPACE = re.compile("[^\\S\x1c-\x1f]+")
_BLANK = re.compile(r"(?<=\S)(?= \S)")
_FIRST, _LAST = itemgetter(0), itemgetter(-1)


def default_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_words(text: str) -> list[str]:
    """Runs of non-space characters."""
    if any(c in text for c in _ODD):
        return [p for p in _SPACE.split(text) if p]
    return text.split()


def cut_blanks(text: str) -> list[str]:
    """Pieces that, joined, are the text; all but the first begin with one blank and a non-space."""
    if not text:
        return []
    first, *rest = text.split(" ")
    if first and not first[-1].isspace() and all(rest) and not any(map(str.isspace, {*map(_FIRST, rest), *map(_LAST, rest)})) and not any(c in text for c in _ODD):
        return [first, *[" " + p for p in rest]]
    return _BLANK.split(text)


def load(path: str):
    """(library object, kind of pieces) for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path), "whole"
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    return Tokenizer.from_file(path), kind_of(spec)


def kind_of(spec: dict) -> str:
    """Which pieces are safe, read from the vocabulary's own normaliser and pre-tokeniser."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    squeezes = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    parts = pre.get("pretokenizers", [pre] if pre else [])
    drops = any(p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed" and "\\s" in str(p.get("pattern")) for p in parts)
    strips = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
    if strips:
        return "whole"
    if squeezes and drops:
        return "words"
    if not steps and len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space"):
        return "blanks"
    return "whole"


def cutter(kind: str):
    return {"words": cut_words, "blanks": cut_blanks, "whole": lambda t: [t] if t else []}[kind]


class Table:
    """A bounded table of two generations: when the young one is full it becomes the old one, and what is used again moves back."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """Keys that must be made; all others are in ``young`` afterwards."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        new = keys.difference(self.young)
        if self.old and new:
            again = new.intersection(self.old)
            self.young.update((k, self.old[k]) for k in again)
            new -= again
        return new
