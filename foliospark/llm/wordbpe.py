"""Exact word-level BPE: a minimal acyclic transducer of frequent words, and exact merging of the rest.

compile_lexicon() reads a tokenizer file (BPE with an end-of-word suffix over bytes, NFC, white space
folded, lower case) and turns the words that the vocabulary holds whole into a minimal acyclic automaton.
Each edge carries how many accepted words precede it, so the sum along a path is a word's number, and the
number leads to the word's ids. The automaton is a flat file that each Python worker maps into memory.
Words outside it are merged by rank. Words are cut from a batch of texts with array operations.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata

import numpy as np

# White space of the pattern's \s, contractions of the pattern in its order.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Words that a worker remembers between batches; beyond it the memory starts anew.
REMEMBERED = 1_500_000
LONG_WORD = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return [chr(b) if b in set(kept) else chr(256 + rest.index(b)) for b in range(256)]


class Automaton:
    """Minimal acyclic automaton over sorted byte strings, built by adding words in order."""

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.final: list[bool] = [False]
        self.register: dict[tuple, int] = {}

    def build(self, words: list[bytes]) -> dict[str, np.ndarray]:
        path, last = [0], b""
        for w in words:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            self._fold(path, last, same)
            for b in w[same:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][b] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            last = w
        self._fold(path, last, 0)
        return self._flat()

    def _fold(self, path: list[int], last: bytes, keep: int) -> None:
        """Replaces the states below depth keep by equal ones that are already known."""
        while len(path) > keep + 1:
            state = path.pop()
            known = self.register.setdefault((self.final[state], tuple(sorted(self.edges[state].items()))), state)
            self.edges[path[-1]][last[len(path) - 1]] = known

    def _flat(self) -> dict[str, np.ndarray]:
        order, seen, stack = [], {0}, [0]
        while stack:
            order.append(s := stack.pop())
            for t in self.edges[s].values():
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        number, count = {s: i for i, s in enumerate(order)}, {}

        def words_from(top: int) -> int:
            todo = [top]
            while todo:
                s = todo[-1]
                if open_ := [t for t in self.edges[s].values() if t not in count]:
                    todo += open_
                else:
                    count[s] = self.final[s] + sum(count[t] for t in self.edges[s].values())
                    todo.pop()
            return count[top]

        words_from(0)
        key, to, skip = [], [], []
        for s in order:
            before = int(self.final[s])
            for b, t in sorted(self.edges[s].items()):
                key.append(number[s] << 8 | b)
                to.append(number[t])
                skip.append(before)
                before += count[t]
        final = np.array([self.final[s] for s in order], np.int32)
        return {"key": np.array(key, np.int64), "to": np.array(to, np.int32), "skip": np.array(skip, np.int32), "final": final}


def ranked(symbols: list[int], merges: dict[int, int], made: list[int]) -> list[int]:
    """Merges the adjacent pair of least rank, the leftmost of equals, until none is left.

    merges: left << 32 | right -> rank; made: the symbol that a rank makes.
    """
    if len(symbols) > LONG_WORD:
        return _ranked_long(symbols, merges, made)
    s, get, none = symbols, merges.get, len(made)
    ranks = [get(a << 32 | b, none) for a, b in zip(s, s[1:])]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        s[i] = made[best]
        del s[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(s[i] << 32 | s[i + 1], none)
        if i:
            ranks[i - 1] = get(s[i - 1] << 32 | s[i], none)
    return s


def _ranked_long(symbols: list[int], merges: dict[int, int], made: list[int]) -> list[int]:
    """The same with a heap over a linked list, in n log n."""
    s, n = list(symbols), len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(m, i, s[i], s[i + 1]) for i in range(n - 1) if (m := merges.get(s[i] << 32 | s[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i]
        if s[i] != a or j < 0 or s[j] != b:
            continue
        s[i], s[j] = made[rank], -1
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for x in (left[i], i):
            if x >= 0 and right[x] >= 0 and (m := merges.get(s[x] << 32 | s[right[x]])) is not None:
                heapq.heappush(heap, (m, x, s[x], s[right[x]]))
    return [x for x in s if x >= 0]


def newer_chars() -> tuple[list[list[int]], list[list[str]]]:
    """Code points that the tokenizers library knows and Python's tables don't: [code, class], [char, lower case]."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and c < 0x40000)
    kinds = []
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        cut = pre_tokenizers.Split(Regex(rf"[^\p{{{name}}}]+"), "removed")
        kinds += [[ord(c), kind] for part, _ in cut.pre_tokenize_str(unknown) for c in part]
    lower = normalizers.Lowercase()
    return kinds, [[c, low] for c in unknown if (low := lower.normalize_str(c)) != c]


def _rank_tables(merges: np.ndarray) -> tuple[dict[int, int], list[int]]:
    return {a << 32 | b: i for i, (a, b, _) in enumerate(merges.tolist())}, merges[:, 2].tolist()


def compile_lexicon(path: str) -> bytes:
    """The tokenizer file as one flat block: merges, token strings, specials and the transducer."""
    spec = json.load(open(path, encoding="utf-8"))
    vocab, model = spec["model"]["vocab"], spec["model"]
    suffix = model["end_of_word_suffix"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)
    symbols = byte_symbols()
    bytes_of = {c: b for b, c in enumerate(symbols)}
    inner = np.array([vocab[c] for c in symbols], np.int32)
    ending = np.array([vocab[c + suffix] for c in symbols], np.int32)
    rank, made = _rank_tables(merges)
    known = {}
    for token in vocab:
        if token.endswith(suffix) and len(token) > len(suffix):
            word = bytes(bytes_of[c] for c in token[: -len(suffix)])
            known[word] = ranked([*inner[list(word[:-1])].tolist(), int(ending[word[-1]])], rank, made)
    words = sorted(known)
    arrays = Automaton().build(words)
    arrays["ids"] = np.array([i for w in words for i in known[w]], np.int32)
    arrays["at"] = np.cumsum([0, *(len(known[w]) for w in words)]).astype(np.int32)
    arrays |= {"merges": merges, "inner": inner, "ending": ending}
    tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for t, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
        tokens[i] = t
    kinds, lower = newer_chars()
    rest = json.dumps({"tokens": tokens, "special": {t["content"]: t["id"] for t in spec["added_tokens"]}, "kinds": kinds, "lower": lower}).encode()
    head = json.dumps({k: [str(v.dtype), list(v.shape)] for k, v in arrays.items()} | {"rest": ["uint8", [len(rest)]]}).encode()
    body = b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values()) + rest
    return len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8) + body


def _mapped(block: bytes) -> dict[str, np.ndarray]:
    """The arrays of a block, mapped from a private file that is unlinked at once."""
    with tempfile.NamedTemporaryFile(prefix="lexicon-", delete=False) as f:
        f.write(block)
    whole = np.memmap(f.name, np.uint8, "r")
    os.unlink(f.name)
    n = int.from_bytes(block[:8], "little")
    at, out = 8 + n + -n % 8, {}
    for name, (kind, shape) in json.loads(block[8 : 8 + n]).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = whole[at : at + size].view(kind).reshape(shape)
        at += size + -size % 8
    return out


def char_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE] = SPACE
    return out


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of many spans of one array, from prefix sums of a polynomial."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.of = mixed(np.arange(1, 0x10001, dtype=np.uint64) * np.uint64(_BASE))

    def __call__(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(chars) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        small = chars < 0x10000
        value = self.of[np.where(small, chars, 0)]
        if not small.all():
            value = np.where(small, value, mixed((chars.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)))
        total = np.empty(n, np.uint64)
        total[0] = 0
        np.cumsum(value * self.up[: n - 1], out=total[1:])
        return mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Encoder:
    """Encodes batches of texts; keeps the ids of words that it has met."""

    def __init__(self, block: bytes) -> None:
        a = _mapped(block)
        self.key, self.to, self.skip, self.final, self.ids, self.at = (a[k] for k in ("key", "to", "skip", "final", "ids", "at"))
        rest = json.loads(a["rest"].tobytes())
        self.tokens, self.special = rest["tokens"], rest["special"]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges, self.made = _rank_tables(a["merges"])
        self.inner, self.ending = a["inner"].tolist(), a["ending"].tolist()
        self.classes, self.hash = char_classes(), SpanHash()
        for c, kind in rest["kinds"]:
            self.classes[c] = kind
        self.lower = {ord(c): low for c, low in rest["lower"]}
        self.forget()

    def forget(self) -> None:
        self.met, self.met_at = np.empty(0, np.uint64), np.empty(0, np.int32)  # hashes in order, and the number of each
        self.flat, self.n = np.empty(1 << 16, np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32), 0
        self.off, self.len = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The transducer's number of each word, -1 if it isn't held; all words step through it together."""
        if not words:
            return np.empty(0, np.int64)
        size = np.array([len(w) for w in words])
        joined, begin = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(size) - size
        state, number, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        out = np.full(len(words), -1, np.int64)
        for k in range(int(size.max()) + 1):
            done = size[alive] == k
            ended = alive[done]
            ok = self.final[state[ended]] > 0
            out[ended[ok]] = number[ended[ok]]
            alive = alive[~done]
            if not len(alive):
                break
            want = state[alive] << 8 | joined[begin[alive] + k]
            i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[i] == want
            alive, i = alive[ok], i[ok]
            state[alive], number[alive] = self.to[i], number[alive] + self.skip[i]
        return out

    def words(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word in normalised text."""
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[chars]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        begin = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        for p in np.flatnonzero((chars == 0x27) & (before != OTHER)).tolist():
            if not (p == 0 or begin[p]):
                continue
            for c in CONTRACTIONS:
                if joined.startswith(c, p + 1):
                    begin[p + 1] = False
                    if p + 1 + len(c) < len(chars) and kind[p + 1 + len(c)] != SPACE:
                        begin[p + 1 + len(c)] = True
                    break
        stops = np.append(np.flatnonzero(begin | (kind == SPACE)), len(chars))
        first = begin[stops[:-1]]
        self.chars = chars
        return stops[:-1][first], stops[1:][first]

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return text if text.isascii() or max(text) < "\u1c80" else text.translate(self.lower)

    def _learn(self, texts: list[str]) -> None:
        """Gives the next numbers to these words."""
        raw, k = [t.encode() for t in texts], len(self.met)
        while k + len(raw) > len(self.off):
            self.off, self.len = np.resize(self.off, 2 * len(self.off)), np.resize(self.len, 2 * len(self.len))
        made: list[int] = []
        for word, number in zip(raw, self.lookup(raw).tolist()):
            before = len(made)
            made += self.ids[self.at[number] : self.at[number + 1]].tolist() if number >= 0 else ranked([*(self.inner[b] for b in word[:-1]), self.ending[word[-1]]], self.merges, self.made)
            self.off[k], self.len[k] = self.n + before, len(made) - before
            k += 1
        while self.n + len(made) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.n : self.n + len(made)] = made
        self.n += len(made)

    def _numbers(self, hashes: np.ndarray, texts) -> np.ndarray:
        """The numbers of distinct hashes in order; texts(i) gives the words of those that are new."""
        at = np.searchsorted(self.met, hashes)
        old = at < len(self.met)
        old[old] = self.met[at[old]] == hashes[old]
        out = np.empty(len(hashes), np.int32)
        out[old] = self.met_at[at[old]]
        if not old.all():
            new = np.flatnonzero(~old)
            self._learn(texts(new))
            out[new] = np.arange(len(self.met), len(self.met) + len(new))
            self.met, self.met_at = np.insert(self.met, at[new], hashes[new]), np.insert(self.met_at, at[new], out[new])
        return out

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids begin (one more entry: the end)."""
        pieces: list[str] = []
        plan: list[tuple[int, int]] = []  # (first piece, special id or -1) in order, by text
        owner: list[int] = []
        for k, t in enumerate(texts):
            t = t or ""
            if self.cut and "<|" in t and self.cut.search(t):
                for part in self.cut.split(t):
                    plan.append((len(pieces), self.special.get(part, -1)))
                    pieces.append("" if part in self.special else self.normal(part))
                    owner.append(k)
            else:
                plan.append((len(pieces), -1))
                pieces.append(self.normal(t))
                owner.append(k)
        ids, at = self._pieces(pieces)
        if len(pieces) == len(texts):
            return ids, at
        out, size = [], np.zeros(len(texts), np.int64)
        for (p, special), k in zip(plan, owner):
            got = np.array([special], ids.dtype) if special >= 0 else ids[at[p] : at[p + 1]]
            out.append(got)
            size[k] += len(got)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(size)])

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(pieces)
        begin, end = self.words(joined)
        size = np.array([len(p) + 1 for p in pieces])
        if len(self.met) > REMEMBERED:
            self.forget()
        h = self.hash(self.chars, begin, end)
        for i in np.flatnonzero(end - begin > 512).tolist():  # no polynomial for words long enough to collide by design
            h[i] = int.from_bytes(hashlib.blake2b(joined[begin[i] : end[i]].encode(), digest_size=8).digest(), "little")
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        word = self._numbers(distinct, lambda new: [joined[a:b] for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())])[which]
        n = self.len[word].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.off[word] - total[:-1], n) + np.arange(total[-1])]
        starts = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(begin, starts)]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by a space, as a tokenizer without a decoder does; specials are kept."""
        t = self.tokens
        return " ".join([t[i] for i in ids.tolist()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(block: bytes) -> Encoder:
    """One encoder for each lexicon and Python worker."""
    key = hashlib.sha1(block).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(block)
    return _ENCODERS[key]
