"""Token ids of whole texts by a byte-level BPE file, each distinct stretch of text tokenised once.

The pre-tokeniser of such a file never joins across a single space before a character that isn't white space: the space
begins a pre-token there. Nor does it join a letter with punctuation after it, or a lone line break with either neighbour.
Cutting there therefore leaves the ids unchanged, and the stretches, mostly words, repeat a lot. An added token of the file
(<|endoftext|>) is a stretch of its own wherever its string is in a text, and gets its id, as from the library. Stretches are told
apart by their bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np

from starloom.llm.textblock import Block

#: Stretches that one worker remembers.
REMEMBERED = 400_000
#: Stretches in one call of the library.
TOGETHER = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("an added token that depends on what is around it")
        # Longest first, as at one place the longest counts.
        self.added = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added_at = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        ids, size = [], np.zeros(len(new), np.int64)
        for at in range(0, len(new), TOGETHER):  # each stretch is tokenised by itself; one call for many
            some = self.tokenizer.encode([s.decode() for s in new[at : at + TOGETHER]], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(some.ids, np.uint32))
            size[at : at + TOGETHER] = np.bincount(np.array(some.word_ids, np.int64), minlength=min(TOGETHER, len(new) - at))
        flat = np.concatenate(ids)
        first, total = len(self.known), self.used + len(flat)
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        if first + len(new) > len(self.size):
            more = np.zeros(max(first + len(new), len(self.size)), np.int64)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.pool[self.used : total] = flat
        self.size[first : first + len(new)] = size
        self.start[first : first + len(new)] = self.used + np.cumsum(size) - size
        self.used = total
        self.known.update((s, first + k) for k, s in enumerate(new))

    def specials(self, block: Block) -> list[tuple[int, int]]:
        """Starts and ends of the added tokens' strings, each within a text."""
        if self.added_at is None:
            return []
        raw, off = block.data.tobytes(), block.offsets
        if not any(s in raw for s in self.added):
            return []
        texts = zip(off.tolist(), off[1:].tolist(), strict=False)
        return [m.span() for a, b in texts for m in self.added_at.finditer(raw, a, b)]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids before each text (n + 1 entries)."""
        data, off = block.data, block.offsets
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(block.n + 1, np.int64)
        if len(self.known) > REMEMBERED:
            self.clear()
        cut = np.zeros(n + 1, bool)
        # The byte after the space surely isn't white space: printable ASCII, or a lead byte that begins no white space.
        after = data[1:]
        plain = (after > 0x20) & (after < 0x7F) | (after >= 0xC3) & (after != 0xE1) & (after != 0xE2) & (after != 0xE3)
        cut[: n - 1] = (data[:-1] == 0x20) & plain
        # Punctuation after a letter that surely is one: ASCII, or two bytes of Latin-1.
        before, letter = data[:-1], np.zeros(n, bool)
        letter[:] = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
        letter[1:] |= (before == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        mark = (after > 0x20) & (after < 0x7F) & ~letter[1:] & ~((after >= 0x30) & (after <= 0x39))
        cut[1:n] |= letter[:-1] & mark
        # After a line break that is the only white space between two printable characters.
        if n > 2:
            cut[2:n] |= (data[1:-1] == 0x0A) & (data[:-2] > 0x20) & (data[:-2] < 0x7F) & plain[1:]
        for a, b in self.specials(block):
            cut[max(a - 1, 0) : b] = False  # white space before it ends there, as before a text's end
            cut[a] = cut[b] = True
        cut[off] = True
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n)
        # Positions of texts' ends cut too, so no stretch goes over one.
        code, distinct = block.codes(start, end)
        distinct = distinct.to_pylist()
        known = self.known
        new = [s for s in distinct if s not in known]
        if new:
            self._learn(new)
        entry = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        size = self.size[entry][code]
        before = np.zeros(len(code) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        place = np.repeat((self.start[entry][code] - before[:-1]).astype(np.int32), size)  # the pool is far below 2**31
        place += np.arange(len(place), dtype=np.int32)
        return self.pool[place], before[np.searchsorted(start, off)]
