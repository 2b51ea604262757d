"""Token ids of many texts by a tokenizer file, each distinct word encoded once per block.

A text is cut before single spaces, where neither kind of tokenizer below looks across; the distinct
pieces of a block are encoded by the tokenizers library (plain words by its model alone), and each text
is put together from them. Texts with other white space at the cuts, or with a special token's own string, are encoded whole.
Tokenizers of other kinds encode every text whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: White space in any of the senses that tokenizers give it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words remembered between blocks by a worker; the frequent ones come early.
KNOWN_WORDS = 600_000
#: A word of unaccented or Latin-1 letters: one unit of either kind of tokenizer, with the space before it.
#: A few signs after it are another unit.
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]{1,4})?")
#: The alphabet of byte-level models: printable bytes stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SHOWN_SPACE = chr(BYTE_LEVEL[32])


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in form["added_tokens"]]
        self.added = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in added)
        pre, normal = form["pre_tokenizer"] or {}, form["normalizer"]
        self.kind = "whole"
        if added and form["model"]["type"] == "BPE":
            if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and normal is None:
                self.kind = "spaced"  # a space belongs to the word after it
            elif normal and {"Replace", "Lowercase"} <= {n["type"] for n in normal.get("normalizers", [])} and form["model"]["end_of_word_suffix"]:
                self.kind = "bare"  # white space only separates
        if self.kind != "whole":
            self.mark, self.mark_id = added[0], self.tokenizer.token_to_id(added[0])
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 64):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts[i : i + 64], add_special_tokens=False)]
        return out

    def _ids(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word of plain letters, which is one unit for the tokenizer's model."""
        word = word.lower() if self.kind == "bare" else word
        found = self.words.get(word)
        if found is None:
            shown = word.replace(" ", SHOWN_SPACE) if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL)
            found = array("I", [u.id for u in self.tokenizer.model.tokenize(shown)]).tobytes()
            if len(self.words) < KNOWN_WORDS:
                self.words[word] = found
        return found

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after the other, and the bounds of each piece among them."""
        out: list[bytes | None] = list(map(self.words.get, pieces))
        odd = []
        for i in [i for i, found in enumerate(out) if found is None]:
            piece = pieces[i]
            plain = PLAIN.fullmatch(piece)
            if plain is None:
                odd.append(i)
                continue
            word, tail = plain.groups()
            out[i] = self._word(word)
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self._ids(tail)
                out[i] += self.tails[tail]
        for k in range(0, len(odd), 10_000):
            some = odd[k : k + 10_000]
            ids = np.array(self.tokenizer.encode(self.mark + self.mark.join(pieces[i] for i in some), add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark_id).tolist() + [len(ids)]
            assert len(marks) == len(some) + 1
            for i, a, b in zip(some, marks, marks[1:]):
                out[i] = ids[a + 1 : b].tobytes()
        sizes = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a NULL counts as empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        if not len(texts):
            return []
        if self.kind == "whole":
            return self._whole(texts.to_pylist())
        apart = pc.match_substring_regex(texts, self.added)
        if self.kind == "spaced":
            apart = pc.or_(apart, pc.match_substring_regex(texts, rf"{SPACE}{SPACE}|\A{SPACE}|{SPACE}\z"))
        cut = pc.if_else(apart, "", texts)
        cut = pc.replace_substring(cut, "\n", " \n" if self.kind == "spaced" else " ")
        lists = pc.split_pattern(cut, " ")
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        if self.kind == "spaced":
            first = np.zeros(len(codes), np.int64)
            first[bounds[:-1]] = 1
            found, codes = np.unique(codes * 2 + first, return_inverse=True) if len(names) > len(codes) // 2 else _dense(codes * 2 + first, 2 * len(names))
            names = [n if f or n[:1] == "\n" else " " + n for n, f in ((names[k >> 1], k & 1) for k in found.tolist())]
        known, at = self._pieces(names)
        begins, sizes = at[codes], at[codes + 1] - at[codes]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = known[np.arange(total[-1]) + np.repeat(begins - total[:-1], sizes)]
        ends = total[bounds]
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        alone = np.flatnonzero(np.asarray(apart.to_numpy(zero_copy_only=False), bool))
        if len(alone):
            for i, found in zip(alone.tolist(), self._whole(texts.take(pa.array(alone)).to_pylist())):
                out[i] = found
        return out


def _dense(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(limit, bool)
    seen[keys] = True
    found = np.flatnonzero(seen)
    rank = np.zeros(limit, np.int64)
    rank[found] = np.arange(len(found))
    return found, rank[keys]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, once per worker process."""
    return Encoder(path)

