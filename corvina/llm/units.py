"""Token ids of whole texts by remembered units.

A byte-level pre-tokenizer gives a word and the blank before it to the same pieces whatever surrounds
them, so a text of single-blank separated units is the concatenation of its units' ids. Each distinct
unit goes through the tokenizers library once per worker: plain words straight to its BPE model, once
whatever marks or line feeds stand beside them, all others through the whole tokenizer. Texts with any other white space arrangement at a unit's edge go
through it whole. Ids are kept as little-endian unsigned 16-bit strings (vocabularies here have fewer
than 65,536 ids).
"""

from __future__ import annotations

import array
import itertools
import operator
import os
import re

import numpy as np

from corvina.llm.token_counts import byte_symbols

#: Units remembered per worker and table.
MAX_UNITS = 800_000
#: Letters that every Unicode version has, then ASCII marks: two pieces of the pre-tokenizer at most.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?#*$%&|]*)")


_ID = operator.attrgetter("id")


def make_room(table: dict, more: int, most: int) -> bool:
    """Forget the later half of a full table: what came first is mostly what comes often."""
    if len(table) + more <= most:
        return False
    kept = dict(itertools.islice(table.items(), most // 2))
    table.clear()
    table.update(kept)
    return True


def _irregular(unit: str) -> bool:
    return not unit or unit[0].isspace() or unit[-1].isspace()


class Table(dict):
    """Ids of units that follow ``lead``; a unit that it does not know is learned on lookup."""

    def __init__(self, owner: "Units", lead: str):
        super().__init__()
        self.owner, self.lead, self.shown = owner, lead, "Ġ" if lead else ""

    def __missing__(self, unit: str) -> bytes:
        make_room(self, 2, MAX_UNITS)
        if unit.isascii() and unit.isalpha():
            ids = array.array("H", map(_ID, self.owner.model.tokenize(self.shown + unit))).tobytes()
        else:
            ids = self._marked(unit)
            if ids is None and "\n" in unit:
                ids = self._lines(unit)
            if ids is None:
                if _irregular(unit):
                    raise KeyError(unit)
                ids = self.owner.encode([self.lead + unit])[0]
        self[unit] = ids
        return ids

    def _marked(self, unit: str) -> bytes | None:
        """A word, remembered by itself, and marks; None for any other unit."""
        m = PLAIN.fullmatch(unit)
        if m is None:
            return None
        word, mark = m.groups()
        return self[word] + self.owner.marks[mark] if mark else self.owner.piece(self.lead + word)

    def _lines(self, unit: str) -> bytes | None:
        """Plain units with one line feed between each two, which is a piece of its own where a letter follows; None for any other unit."""
        top, *lines = unit.split("\n")
        if not all(map(PLAIN.fullmatch, (top, *lines))):
            return None
        return self.owner.newline.join([self[top], *map(self.owner.first.__getitem__, lines)])


class Marks(dict):
    """Ids of ASCII marks that follow a letter."""

    def __init__(self, owner: "Units"):
        super().__init__()
        self.owner = owner

    def __missing__(self, mark: str) -> bytes:
        make_room(self, 1, 10_000)
        self[mark] = ids = self.owner.piece(mark)
        return ids


class Units:
    """Ids by one tokenizer, given as the text of its file."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.first, self.later, self.marks = Table(self, ""), Table(self, " "), Marks(self)
        self.newline = self.piece("\n")

    def encode(self, texts: list[str]) -> list[bytes]:
        """By the whole tokenizer."""
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u2").tobytes() for e in got]

    def piece(self, piece: str) -> bytes:
        """One piece of the pre-tokenizer, by the model."""
        return array.array("H", map(_ID, self.model.tokenize("".join([self.symbols[b] for b in piece.encode()])))).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 16-bit integers."""
        out, get = [], self.later.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
                continue
            top, *units = text.split(" ")
            try:
                out.append(self.first[top] + b"".join(map(get, units)))
            except KeyError:
                out.append(self.encode([text])[0])
        return out


_WORKER: dict[str, Units] = {}


def worker_units(spec: str) -> Units:
    """The worker's units of a tokenizer, built once."""
    if spec not in _WORKER:
        _WORKER.clear()
        _WORKER[spec] = Units(spec)
    return _WORKER[spec]
