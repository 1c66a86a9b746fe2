"""Token counts by finite-state transducers.

A BPE vocabulary is compiled, lazily, into a deterministic transducer over bytes. Its states are the sets of
tokens that may still be completed, each with the token before it; a transition carries how many tokens the
prefix gained. Text is counted in chunks. Each chunk is a state map: it takes the state that the machine is in when it
enters the chunk (the kind of word that is open, the transducer's state, the byte held back) to the state on exit and the
tokens emitted on the way. Maps compose associatively, and a parallel prefix scan composes them in pairs of pairs.

Why the states are exact: a sequence is the BPE encoding of its text exactly if each pair of neighbours is the
encoding of its own text. So every prefix of a word has one last token, and the one for the next byte is the
one partial token that completes next to a compatible neighbour.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Chunks end at the first place from here on where neither a character, a special string nor a contraction is cut.
CHUNK_BYTES = 1 << 14
#: States kept by one worker before the transducer is compiled anew.
MAX_STATES = 200_000
INFINITE = float("inf")
#: ASCII white space ends words in every part of the lexer.
_EDGE = regex.compile(rb"[ \t\n\r\x0b\x0c]")
#: The one form of word pattern that is compiled: contractions, letters, single digits, other symbols.
LEXER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others
    follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTransducer:
    """Deterministic transducer for one BPE vocabulary whose tokens carry an end-of-word mark."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix, vocab, symbols = model.get("end_of_word_suffix") or "", model["vocab"], byte_symbols()
        self.rank = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[a], vocab[b]), (i, vocab[a + b] if not suffix or not a.endswith(suffix) else -1))
        #: token -> (bytes, ends a word)
        self.spelling: dict[int, tuple[bytes, bool]] = {}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            raw = bytes(symbols[c] for c in (token[: -len(suffix)] if ends else token))
            self.spelling[i] = (raw, ends)
            (self.final if ends else self.inner)[raw] = i
        #: token -> (left part, right part, rank) of the merge that makes it
        self.top: dict[int, tuple[int, int, int]] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._build_trie()
        self.reset()

    def _build_trie(self) -> None:
        """Nodes are byte strings of the vocabulary: children, token inside a word, token at a word's end.
        Tokens that their own merges don't yield never occur and are left out."""
        self.children: list[dict[int, int]] = [{}]
        self.tokens: list[list[int]] = [[-1, -1]]
        for raw, i, end in [(*x, 0) for x in self.inner.items()] + [(*x, 1) for x in self.final.items()]:
            if self.merge(raw, bool(end)) != [i]:
                continue
            node = 0
            for b in raw:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.tokens.append([-1, -1])
                node = self.children[node][b]
            self.tokens[node][end] = i

    def merge(self, raw: bytes, ends: bool) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        last = len(raw) - 1
        parts = [(self.final if ends and k == last else self.inner)[raw[k : k + 1]] for k in range(len(raw))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min(((rank[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=(0, -1))
            if at < 0:
                break
            made = rank[parts[at], parts[at + 1]][1]
            if len(parts) == 2:
                self.top[made] = (*parts, best)
            parts[at : at + 2] = [made]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that touch the left (0) or right (1) end of ``token`` while it is merged together, first the
        single byte, each with the rank of the merge that absorbs it."""
        found = self._spines[side].get(token)
        if found is None:
            part, found = token, [(token, INFINITE)]
            while (top := self.top.get(part)) is not None:
                part = top[side]
                found.append((part, top[2]))
            found.reverse()
            self._spines[side][token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left right`` is the encoding of its own text: no merge across the border comes before the
        merges that absorb the tokens beside it. Equal ranks merge from the left."""
        a, b, rank = self.spine(left, 1), self.spine(right, 0), self.rank
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = a[i], b[j]
            across = rank.get((x, y))
            if across is not None and across[0] < until_x and across[0] <= until_y:
                return False
            if until_x <= until_y:
                if until_x == INFINITE:
                    return True
                i += 1
            else:
                j += 1

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.index = {start: 0}
        #: by state: byte -> (state, tokens gained), 256 + byte -> tokens gained where that byte closes the word
        self.step: list[dict[int, tuple[int, int] | int]] = [{}]

    def _advance(self, state: int, byte: int) -> tuple[int, int]:
        live, here = [], None
        for node, before, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                live.append((child, before, count))
            token = self.tokens[child][0]
            if here is None and token >= 0 and (before < 0 or self.fits(before, token)):
                here = (token, count + 1)
        token, count = here
        key = tuple((n, b, c - count) for n, b, c in live) + ((0, token, 0),)
        target = self.enter(key)
        out = self.step[state][byte] = (target, count)
        return out

    def _finish(self, state: int, byte: int) -> int:
        for node, before, count in self.states[state]:
            child = self.children[node].get(byte)
            token = -1 if child is None else self.tokens[child][1]
            if token >= 0 and (before < 0 or self.fits(before, token)):
                self.step[state][256 + byte] = count + 1
                return count + 1
        raise ValueError("no token completes the word")

    def enter(self, key: tuple) -> int:
        """The number of the state that ``key`` stands for; keys outlive ``reset``."""
        state = self.index.get(key)
        if state is None:
            state = self.index[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return state

    def advance(self, key: tuple | None, word: bytes) -> tuple[tuple, int]:
        """State and tokens gained after the bytes of an unfinished word, from a state or from a word's start."""
        state, total = 0 if key is None else self.enter(key), 0
        for b in word:
            move = self.step[state].get(b)
            if move is None:
                move = self._advance(state, b)
            state = move[0]
            total += move[1]
        return self.states[state], total

    def closed(self, key: tuple, last: int) -> int:
        """Tokens gained by the last byte of a word."""
        state = self.enter(key)
        gained = self.step[state].get(256 + last)
        return self._finish(state, last) if gained is None else gained

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum over its transitions, the last one closing the word."""
        step, state, total = self.step, 0, 0
        for b in word[:-1]:
            move = step[state].get(b)
            if move is None:
                move = self._advance(state, b)
            state = move[0]
            total += move[1]
        gained = step[state].get(256 + word[-1])
        return total + (self._finish(state, word[-1]) if gained is None else gained)


#: What is open between two chunks: the kind of word (letters or symbols), what the transducer's state stands for, and
#: the byte held back, as it may be the word's last. Nothing open is None.
State = tuple[str, tuple, int] | None


class ChunkMap:
    """What a stretch of text does to the state it is entered in: ``at(state)`` is the state on exit and the tokens
    emitted. Evaluated for the states that occur and remembered; two maps are equal if they do the same to all of them."""

    def __init__(self, step: Callable[[State], tuple[State, int]]):
        self.step = step
        self.seen: dict[State, tuple[State, int]] = {}

    def at(self, state: State) -> tuple[State, int]:
        if state not in self.seen:
            self.seen[state] = self.step(state)
        return self.seen[state]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ChunkMap) and all(self.at(s) == other.at(s) for s in {None, *self.seen, *other.seen})

    __hash__ = None


def scan(maps: list, compose: Callable) -> list:
    """All inclusive prefixes under an associative ``compose``: pairs are composed side by side, the pairs scanned, and
    the places between filled in; the depth is logarithmic."""
    if len(maps) < 2:
        return list(maps)
    inner = scan([compose(a, b) for a, b in zip(maps[::2], maps[1::2])], compose)
    out = [maps[0]]
    for k in range(1, len(maps)):
        out.append(inner[k // 2] if k % 2 else compose(inner[k // 2 - 1], maps[k]))
    return out


@lru_cache(maxsize=1)
def seconds() -> frozenset[str]:
    """Characters that normalisation may join to the one before them, besides combining marks."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x80, 0x30000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


class TextCounter:
    """Counts whole texts: normalises and lexes units between ASCII spaces, and composes chunk maps."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.machine = BpeTransducer(spec)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.added = [t.encode() for t in added]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split != LEXER:
            raise ValueError("unknown word pattern")
        self.lexer = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.letter = regex.compile(r"\p{L}")
        self.other = regex.compile(r"[^\p{White_Space}\p{L}\p{N}]")
        self.memo = common.Memo(self._unit)
        self.words = common.Memo(lambda word: self.machine.count(word.encode()))

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text)  # one by one: without rules for a word's last letter

    def _plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.lexer.findall(self._normal(text))))

    def _unit(self, unit: bytes) -> int:
        text = unit.decode("utf-8", "replace")
        if self.special is None or not (n := len(self.special.findall(text))):
            return self._plain(text)
        return n + sum(self._plain(part) for part in self.special.split(text) if part)

    def close(self, state: State) -> int:
        """Tokens emitted when the open word ends here."""
        return 0 if state is None else self.machine.closed(state[1], state[2])

    def feed(self, state: State, data: bytes) -> tuple[State, int]:
        """The state map of bytes without ASCII white space, applied to one state."""
        text, total = data.decode("utf-8", "replace"), 0
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k:  # a special string ends the open word and is one token
                total, state = total + self.close(state) + 1, None
            part, at = self._normal(part), 0
            for m in self.lexer.finditer(part):
                word = m[0]
                contraction = word[0] == "'" and len(word) > 1 and word[1].isalpha()
                kind = "" if contraction else "letters" if self.letter.match(word) else "symbols" if self.other.match(word) else ""
                raw = word.encode()
                if state is not None and (m.start() > at or kind != state[0]):
                    total, state = total + self.close(state), None
                at = m.end()
                if not kind:  # contractions and digits are whole words
                    total += self.words[word]
                elif state is None and at < len(part):
                    total += self.words[word]
                else:
                    key, emitted = self.machine.advance(None, raw[:-1]) if state is None else self.machine.advance(state[1], bytes([state[2]]) + raw[:-1])
                    state, total = (kind, key, raw[-1]), total + emitted
            if at < len(part):  # white space beyond ASCII
                total, state = total + self.close(state), None
        return state, total

    def chunk_map(self, chunk: bytes) -> ChunkMap:
        """Up to its first space a chunk continues what is open; what comes after is the same for every state."""
        first = _EDGE.search(chunk)
        if first is None:
            return ChunkMap(lambda state: self.feed(state, chunk) if chunk else (state, 0))
        last = max(chunk.rfind(s) for s in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
        middle = sum(map(self.memo.__getitem__, chunk[first.start() : last].split()))
        exit_state, after = self.feed(None, chunk[last + 1 :])

        def step(state: State) -> tuple[State, int]:
            open_state, before = self.feed(state, chunk[: first.start()]) if first.start() else (state, 0)
            return exit_state, before + self.close(open_state) + middle + after

        return ChunkMap(step)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """Associative composition of two neighbouring chunk maps."""

        def step(state: State) -> tuple[State, int]:
            between, first = a.at(state)
            after, second = b.at(between)
            return after, first + second

        return ChunkMap(step)

    def _may_cut(self, data: bytes, at: int) -> bool:
        """Whether what follows can be normalised, lexed and searched for special strings on its own."""
        if _EDGE.match(data, at):
            return True
        if data[at] & 0xC0 == 0x80 or b"'" in data[max(0, at - 3) : at + 1]:
            return False
        if data[at] >= 0x80:
            char = data[at : at + 4].decode("utf-8", "ignore")[:1]
            if not char or unicodedata.combining(char) or char in seconds():
                return False
        return all(data.find(t, max(0, at - len(t) + 1), at + len(t) - 1) < 0 for t in self.added)

    def chunks(self, data: bytes) -> list[bytes]:
        out, start = [], 0
        while len(data) - start > CHUNK_BYTES:
            at = start + CHUNK_BYTES
            while at < len(data) and not self._may_cut(data, at):
                at += 1
            out.append(data[start:at])
            start = at
        return [*out, data[start:]]

    def count(self, data: bytes) -> int:
        if len(data) <= CHUNK_BYTES:  # one chunk, entered with nothing open
            return sum(map(self.memo.__getitem__, data.split()))
        maps = []
        for chunk in self.chunks(data):
            maps.append(self.chunk_map(chunk))
            self.trim()
        state, total = scan(maps, self.compose)[-1].at(None)
        return total + self.close(state)

    def trim(self) -> None:
        self.memo.trim()
        self.words.trim()
        if len(self.machine.states) > MAX_STATES:
            self.machine.reset()


@lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count of every whole text, one row per input row, without a shuffle.

    Null text counts as empty (0 tokens), a null id stays null, repeated rows stay repeated, an empty table gives
    an empty result; other columns are ignored. Memory is bounded by a batch, the word memo and the transducer's
    state limit, whatever the texts."""

    def count(batch: pa.RecordBatch):
        machine, ids, texts = counter(tokenizer), batch.column(0), common.as_bytes(batch.column(1))
        n = []
        for data in texts:
            n.append(machine.count(data))
            machine.trim()
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(d) for d in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return common.map_batches(common.pick(docs, doc_id=id_col, text=text_col), count, SCHEMA)
