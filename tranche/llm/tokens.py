"""Token ids by a public byte-level BPE vocabulary, remembered by word.

The vocabulary's pre-tokeniser always cuts before a space that a non-space
character follows, so a text may be cut there and each part encoded alone; parts
repeat, and most are looked up.  A new part that is plainly a word (with a comma
or full stop, or two words around a line end) is made of its words' ids; a new word is
one pre-token and goes straight to the library's BPE model.  Any other new part takes
the whole tokenizer.  The texts of a call are cut and their parts told apart by Arrow,
so that only different parts are looked up; their ids are put in place by numpy.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary used unless a path is given.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def parts_of(text: str) -> list[str]:
    """The text cut at single spaces that a non-space follows; joined by spaces, the parts are the text."""
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:                                    # a run of spaces: no cut
            out[-1] += " " + p
    return out


#: A space that no other character but white space, or nothing, follows.
_ODD = re.compile(r" (?=\s|\Z)")


class Encoder:
    """Ids of texts as arrays of the narrowest type.

    It remembers the parts used last: up to ``bound`` of them, and those of the
    ``bound`` before that were not used since; and ``bound`` words of parts, which it
    then forgets.
    """

    _OPEN: dict[str, "Encoder"] = {}

    def __init__(self, path: str, bound: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.model._resize_cache(0)              # its memory is ours: ``known``
        self.specials = tuple(str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.bound, self.known, self.before, self.byte_names = bound, {}, {}, None
        self.words: dict[str, dict[str, bytes]] = {" ": {}, "": {}}      # ids of words after a space, and after none
        form = json.loads(self.tokenizer.to_str())
        before = form["pre_tokenizer"] or {}
        self.cut = (form["normalizer"] is None and form["model"]["type"] == "BPE" and not form["model"].get("dropout")
                    and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True))
        if self.cut:                             # how the pre-tokeniser writes each byte
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            names = {}
            for cp in (*range(256), *(0x100 + 64 * k for k in range(28)), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)):
                if not 0xD800 <= cp < 0xE000:
                    written = level.pre_tokenize_str(chr(cp))[0][0]
                    names.update(zip(chr(cp).encode(), written))
            self.byte_names = {b: names.get(b, "") for b in range(256)}
            self.lead = {"": "", " ": self.byte_names[0x20]}
            self.signs = {sign: self._pre_token(sign) for sign in ",.\n"}
            self.cut = all(self.byte_names[b] for b in (*range(0x80), *range(0x80, 0xC0), *range(0xC2, 0xF5)))

    @classmethod
    def open(cls, path: str) -> "Encoder":
        """One encoder for each worker process and vocabulary."""
        if path not in cls._OPEN:
            cls._OPEN[path] = cls(path)
        return cls._OPEN[path]

    @classmethod
    def forget(cls, path: str) -> None:
        """Leave this process's encoder, and what it remembers, to other uses of the memory."""
        cls._OPEN.pop(path, None)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pre_token(self, word: str) -> bytes:
        written = word.encode().decode("latin-1").translate(self.byte_names)
        return array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of a word (letters only) that ``lead`` precedes."""
        known = self.words[lead]
        ids = known.get(word)
        if ids is None:
            written = self.lead[lead] + word if word.isascii() else (lead + word).encode().decode("latin-1").translate(self.byte_names)
            ids = known[word] = array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()
        return ids

    def _new(self, part: str, lead: str) -> bytes:
        """Ids of a part that ``lead`` precedes."""
        if part.isalpha():
            return self._word(part, lead)
        if part[-1:] in (",", ".") and part[:-1].isalpha():
            return self._word(part[:-1], lead) + self.signs[part[-1]]
        a, line_end, b = part.partition("\n")
        if line_end and a and b and not a[-1].isspace() and not b[0].isspace():
            return self._new(a, lead) + self.signs["\n"] + self._new(b, "")
        return self._whole(lead + part)

    def __call__(self, texts) -> list[np.ndarray]:
        """Ids of each text; a special token's string in a text counts as the library counts it."""
        if len(self.known) > self.bound:
            self.known, self.before = {}, self.known
        for words in self.words.values():
            if len(words) > self.bound:
                words.clear()
        out: list = []
        easy: list[str] = []
        for t in texts:
            if self.cut and not any(s in t for s in self.specials):
                out.append(len(easy))
                easy.append(t)
            else:
                out.append(np.frombuffer(self._whole(t), self.kind))
        found = self._cut(easy)
        return [found[o] if isinstance(o, int) else o for o in out]

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of parts after a space; new ones are remembered."""
        known, before, new = self.known, self.before, self._new
        out = list(map(known.get, parts))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = parts[i]
            out[i] = known[p] = before.pop(p, None) or new(p, " ")
        return out

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that may be cut at spaces."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begins = lists.offsets.to_numpy()[:-1]
        told = lists.flatten().dictionary_encode()
        place = told.indices.to_numpy().astype(np.int64)
        names = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        later = np.ones(len(place), bool)            # parts that only begin texts are not looked up as others
        later[begins] = False
        # Nothing, or white space, after a space: those few texts are cut one by one.
        head = pc.utf8_slice_codeunits(told.dictionary, 0, 1)
        odd = pc.or_(pc.less_equal(head, " "), pc.utf8_is_space(head)).to_numpy(zero_copy_only=False)
        run = np.add.reduceat(odd[place] & later, begins).astype(bool)
        used = np.zeros(len(names), bool)
        used[place[later]] = True
        used &= ~odd
        table = [b""] * (len(names) + len(texts))
        at = np.flatnonzero(used).tolist()
        for i, ids in zip(at, self._known([names[i] for i in at])):
            table[i] = ids
        table[len(names):] = [b"" if r else self._new(names[k], "") for k, r in zip(place[begins].tolist(), run.tolist())]
        place[begins] = len(names) + np.arange(len(begins))
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(table), self.kind)
        n = sizes[place]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[place] - (ends - n), n)
        at += np.arange(len(at))
        out = np.split(ids[at], ends[begins[1:] - 1])
        for i in np.flatnonzero(run).tolist():
            first, *parts = parts_of(texts[i])
            out[i] = np.frombuffer(self._new(first, "") + b"".join(self._known(parts)), self.kind)
        return out
