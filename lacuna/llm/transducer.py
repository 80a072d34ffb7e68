"""Token counts from compiled finite-state transducers.

A byte-level BPE tokenizer is two machines. The first cuts a text into pre-tokens: nine states over eleven
classes of characters, each transition marked with the cuts it makes. Texts are divided into
chunks; every chunk is summarised by its map from start state to end state; the maps are composed by a
parallel prefix scan; then all chunks run at once from their true start states. The second machine
counts the tokens of a pre-token: transitions over bytes marked with the change of the token count.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame

from lacuna.llm.texts import by_text, per_worker

#: Characters of a chunk of the first machine.
CHUNK = 256

#: Pre-tokens whose counts a worker remembers; only speed depends on it.
MEMORY = 600_000

#: Compiled states a worker keeps before it starts anew; only speed depends on it.
MOST_STATES = 250_000

#: Pairs of tokens remembered; beyond that the machine starts anew.
MOST_PAIRS = 1_000_000

# Classes of characters. The letters of the contractions 's 't 'm 'd 're 've 'll are classes of their own.
LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, ONE, RV, EL, E, END = range(11)
# States: what the text read so far leaves open.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_WHITE, AT_QUOTE, AT_RV, AT_EL = range(9)
# Outputs: a cut before the character just read, a cut before the one ahead of it.
CUT, CUT_BACK = 1, 2
STATES, CLASSES = 9, 11


def cutting_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by class and state, for the pattern of byte-level BPE tokenizers:
    contractions, then runs of letters, of numbers or of others, each with one space ahead, then white space."""
    after, out = np.zeros((CLASSES, STATES), np.uint8), np.zeros((CLASSES, STATES), np.uint8)
    run = {LETTER: IN_LETTERS, ONE: IN_LETTERS, RV: IN_LETTERS, EL: IN_LETTERS, E: IN_LETTERS, NUMBER: IN_NUMBERS,
           OTHER: IN_OTHER, QUOTE: IN_OTHER, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE}
    white = (SPACE, WHITE)
    for c in range(CLASSES):
        for s in range(STATES):
            # 'r, 'v or 'l that did not become a contraction: a quote and a run of letters
            back = CUT_BACK if s in (AT_RV, AT_EL) else 0
            was = IN_LETTERS if back else s
            if c == END:
                after[c, s], out[c, s] = CLOSED, back | CUT
                continue
            to, cut = run[c], CUT
            if (s, c) in ((AT_RV, E), (AT_EL, EL)) or s == AT_QUOTE and c == ONE:
                to, cut, back = CLOSED, 0, 0
            elif s == AT_QUOTE and c in (RV, EL):
                to, cut = (AT_RV if c == RV else AT_EL), 0
            elif s == AT_QUOTE and c in (QUOTE, OTHER) or to == was:
                cut = 0
            elif was in (AFTER_SPACE, AFTER_WHITE):
                # the last white character leaves its run: a space joins what follows, others stand alone
                if c in white:
                    cut = 0
                else:
                    back = CUT_BACK
                    cut = 0 if was == AFTER_SPACE else CUT
                    if c == QUOTE and was == AFTER_WHITE:
                        to = AT_QUOTE
            elif c == QUOTE:
                to = AT_QUOTE
            after[c, s], out[c, s] = to, cut | back
    return after, out


def character_classes(tokenizer) -> np.ndarray:
    """The class of every code point.

    Categories of assigned characters do not change, so Python's table gives them. Letters and numbers that only
    a later Unicode table has are asked of the tokenizer's own pre-tokenizer, between two others of the kind.
    """
    kinds = [unicodedata.category(chr(p)) for p in range(0x110000)]
    classes = np.array([{"L": LETTER, "N": NUMBER}.get(k[0], OTHER) for k in kinds], np.uint8)
    every = "".join(chr(p) for p in range(0x110000) if kinds[p] == "Cn")
    for kind, letter, c in (("L", "a", LETTER), ("N", "1", NUMBER)):
        later = regex.findall(rf"\p{{{kind}}}", every)
        probe = "".join(f"{letter}{x}{letter}\n" for x in later)
        starts = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)}
        classes[[ord(x) for i, x in enumerate(later) if 4 * i + 1 not in starts]] = c
    classes[[ord(x) for x in regex.findall(r"\s", "".join(map(chr, range(0x10000))))]] = WHITE
    classes[ord(" ")], classes[ord("'")] = SPACE, QUOTE
    for letters, c in (("stmd", ONE), ("rv", RV), ("l", EL), ("e", E)):
        classes[[ord(x) for x in letters]] = c
    return classes


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the composition of maps 0 to i: a scan in log2(n) steps, each over all rows at once."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def cuts(classes: np.ndarray, after: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask over the characters and the end."""
    n = len(classes)
    rows = -(-max(n, 1) // CHUNK)
    padded = np.full(rows * CHUNK, END, np.int32)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(rows, CHUNK).T) * STATES  # step j of every chunk together
    flat_after, flat_out = after.ravel(), out.ravel()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for row in steps:
        maps = flat_after[row[:, None] + maps]
    state = np.zeros(rows, np.uint8)
    state[1:] = prefix_maps(maps)[:-1, CLOSED]
    marks = np.empty((CHUNK, rows), np.uint8)
    for j, row in enumerate(steps):
        at = row + state
        marks[j] = flat_out[at]
        state = flat_after[at]
    marks = marks.T.reshape(-1)[:n]
    starts = (marks & CUT) != 0
    starts[:-1] |= (marks[1:] & CUT_BACK) != 0
    return starts


class CountingMachine:
    """A deterministic transducer over the bytes of one pre-token, marked with changes of its token count.

    Every prefix has one BPE tokenization, and its last token is the one token that ends there and may follow
    the last token of the prefix it leaves. So a state keeps, for each earlier position from which a longer
    token may still grow, the place in the vocabulary tree, the last token before it, and how many
    tokens it is behind. Such states are finite in number; each is compiled when a text first needs it.
    """

    def __init__(self, vocabulary: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.tree, self.token, self.grows = {}, [None], [True]
        for word in vocabulary:
            node = 0
            for b in word:
                self.grows[node] = True
                node = self.tree.setdefault((node << 8) | b, len(self.token))
                if node == len(self.token):
                    self.token.append(None)
                    self.grows.append(False)
            self.token[node] = word
        self.restart()

    def restart(self):
        self.states = [((0, b"", 0),)]
        self.numbers, self.moves, self.allowed = {self.states[0]: 0}, {}, {}

    def merged(self, word: bytes) -> list[bytes]:
        """Plain merging, for the short strings that decide whether two tokens may stand together."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, last: bytes, token: bytes) -> bool:
        pair = (last, token)
        if pair not in self.allowed:
            self.allowed[pair] = self.merged(last + token) == ([last, token] if last else [token])
        return self.allowed[pair]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition out of a state on a byte: (next state, change of the count)."""
        grown, found = [], None
        for node, last, behind in self.states[state]:
            child = self.tree.get((node << 8) | byte)
            if child is None:
                continue
            token = self.token[child]
            if found is None and token is not None and self.may_follow(last, token):
                found = (token, behind + 1)
            if self.grows[child]:
                grown.append((child, last, behind))
        token, change = found
        key = (*((node, last, behind - change) for node, last, behind in grown), (0, token, 0))
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        self.moves[state << 8 | byte] = move = (number, change)
        return move

    def count(self, word: str) -> int:
        if len(self.states) > MOST_STATES or len(self.allowed) > MOST_PAIRS:
            self.restart()
        state = total = 0
        moves = self.moves
        for byte in word.encode("utf-8", "replace"):
            state, change = moves.get(state << 8 | byte) or self.compile(state, byte)
            total += change
        return total


class Counts(dict):
    """Pre-token to token count, run through the machine once per distinct pre-token."""

    def __init__(self, machine: CountingMachine):
        super().__init__()
        self.machine = machine

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = self.machine.count(word)
        return value


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenCounter:
    """Both machines of one tokenizer file."""

    def __init__(self, content: str, classes: np.ndarray):
        model, added = json.loads(content)["model"], json.loads(content).get("added_tokens", [])
        letters = byte_alphabet()
        special = {t["content"] for t in added}
        vocabulary = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {tuple(bytes(letters[c] for c in p) for p in pair): r for r, pair in enumerate(pairs)}
        self.special = sorted(special)
        self.classes, (self.after, self.out) = classes, cutting_machine()
        self.counts = Counts(CountingMachine(vocabulary, ranks))

    def pieces(self, text: str) -> list[str]:
        """The text between special strings, which are tokens wherever they stand."""
        parts = [text]
        for s in self.special:
            parts = [q for p in parts for q in p.split(s)]
        return parts

    def count(self, texts: list[str]) -> np.ndarray:
        owner, parts, total = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.pieces(t)
            total[i] = len(found) - 1
            parts += found
            owner += [i] * len(found)
        if not parts:
            return total
        joined = "\n".join(parts) + "\n"
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes[ends] = END
        starts = cuts(classes, self.after, self.out)
        # the mark that ends a piece is no part of a pre-token; an empty pre-token has no tokens
        at = np.flatnonzero(starts)
        stops = np.append(at[1:], len(joined))
        real = ~np.isin(at, ends, assume_unique=True)
        at, stops = at[real], stops[real]
        memory = self.counts
        each = np.fromiter((memory[joined[a:b]] for a, b in zip(at.tolist(), stops.tolist())), np.int64, len(at))
        running = np.concatenate([[0], np.cumsum(each)])
        bounds = running[np.searchsorted(at, ends)]
        np.add.at(total, owner, np.diff(bounds, prepend=0))
        return total


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library. The driver reads it and reads the classes of
    characters off it; tasks get both. Null texts are empty: no bytes, no tokens. Rows are independent, so
    repeated rows and null keys stay as they are, and other columns are left out.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        content = f.read()
    packed = zlib.compress(character_classes(Tokenizer.from_str(content)).tobytes())
    shipped = df.sparkSession.sparkContext.broadcast((content, packed))  # one vocabulary file

    def make():
        def build():
            text_, classes = shipped.value
            return TokenCounter(text_, np.frombuffer(zlib.decompress(classes), np.uint8))

        counter = per_worker(("token-counts", path, zlib.crc32(shipped.value[0].encode())), build)

        def work(texts):
            n = counter.count(texts)
            return {"n_bytes": [len(t.encode("utf-8", "replace")) for t in texts], "n_tokens": n, "over_limit": n > limit}

        return work

    return by_text(df, [key], text, make, "n_bytes bigint, n_tokens bigint, over_limit boolean")
