"""Exact token ids and counts of public tokenizers, word by word.

A text is cut only where the tokenizer itself always cuts, and each distinct piece
is encoded once per worker and kept in a dictionary of bounded size (it is emptied
when full; that changes speed only).
"""

from __future__ import annotations

import os
import re

import numpy as np

KEPT = 1_200_000  # pieces a worker remembers
BLOCK = KEPT // 8  # pieces looked up at a time
JOINED = 256  # words encoded as one text
_loaded: dict[object, object] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def word_ids(path: str) -> "WordIds":
    """This worker's encoder; it and its dictionary outlive a task."""
    if ("ids", path) not in _loaded:
        _loaded["ids", path] = WordIds(path)
    return _loaded["ids", path]


def piece_counts(path: str, proven) -> "PieceCounts":
    if ("counts", path) not in _loaded:
        _loaded["counts", path] = PieceCounts(path, proven())
    return _loaded["counts", path]


class WordIds:
    """Ids by a tokenizer that drops white space and never joins across it, as little-endian uint32 bytes.

    Pieces between spaces are independent, and a letter before punctuation always ends
    a pre-token. New plain words, whose case does not matter, are encoded many at a time
    as one text and told apart by the end-of-word ids; every other piece alone.
    """

    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        self.tok = load(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tok.get_vocab(with_added_tokens=True).values()) + 1, bool)
        suffix = self.tok.model.end_of_word_suffix
        self.ends[[i for s, i in vocab.items() if suffix and s.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.known: dict[str, bytes] = {"": b""}
        self.learned = 0

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) + 2 * len(pieces) > KEPT:
            self.known = {"": b""}
        is_plain = self.PLAIN.fullmatch
        plain = [p for p in pieces if is_plain(p)] if self.joins else []
        other = [p for p in pieces if not is_plain(p)] if self.joins else list(pieces)
        words = list({p.lower() for p in plain}.difference(self.known))
        parts = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for part, enc in zip(parts, self.tok.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(enc.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(part):  # not as expected: each alone
                other += part
                continue
            raw, cuts = ids.tobytes(), [0, *((ends + 1) * 4).tolist()]
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        for p, enc in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False)):
            self.known[p] = np.array(enc.ids, "<u4").tobytes()
        self.known.update((p, self.known[w]) for p in plain if (w := p.lower()) != p)

    def encode(self, texts) -> list[bytes]:
        """Ids of an Arrow array of strings. Arrow splits the texts and numbers the distinct pieces; only those pass through Python."""
        import pyarrow.compute as pc
        for space in "\n\r\t":
            texts = pc.replace_substring(texts, pattern=space, replacement=" ")
        if self.joins:
            texts = pc.replace_substring_regex(texts, pattern="([A-Za-z])([.,;:!?])", replacement=r"\1 \2")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        distinct, codes, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()
        raw = []
        for i in range(0, len(distinct), BLOCK):
            block = distinct[i:i + BLOCK]
            if new := set(block).difference(self.known):
                self.learn(list(new))
                if len(self.known) < self.learned:  # emptied on the way: the rest again
                    self.learn(list(set(block).difference(self.known)))
                self.learned = len(self.known)
            raw += map(self.known.__getitem__, block)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def looked_up(words, texts: list[str], combine) -> list:
    """Each text's pieces looked up in ``words.known`` and combined; new pieces are learned for many texts at a time."""
    out: list = []
    group: list[list[str]] = []

    def flush():
        new = set().union(*group).difference(words.known)
        if new:
            words.learn(sorted(new))
            if len(words.known) < words.learned:  # emptied on the way: the rest again
                words.learn(sorted(set().union(*group).difference(words.known)))
            words.learned = len(words.known)
        out.extend([combine(map(words.known.__getitem__, ps)) for ps in group])
        group.clear()

    held = 0
    for t in texts:
        ps = words.pieces(t)
        if held + len(ps) > BLOCK:
            flush()
            held = 0
        if len(ps) > BLOCK:  # a long text: in blocks
            parts = []
            for i in range(0, len(ps), BLOCK):
                group.append(ps[i:i + BLOCK])
                flush()
                parts.append(out.pop())
            out.append(combine(parts))
            continue
        group.append(ps)
        held += len(ps)
    flush()
    return out


def proven_tokens(path: str) -> list[str]:
    """Vocabulary strings that the tokenizer encodes, alone, as just their own id (each one tried)."""
    tok = load(path)
    strings = sorted({s for i in range(tok.get_vocab_size(with_added_tokens=False))
                      if (s := tok.decode([i], skip_special_tokens=False)) and "�" not in s})
    return [s for s, e in zip(strings, tok.encode_batch_fast(strings, add_special_tokens=False)) if len(e.ids) == 1]


class PieceCounts:
    """Token counts by a byte-level tokenizer whose pre-tokens may begin with one space.

    A space after a visible character always begins a pre-token, so a text may be cut
    there. Pieces proven to be one token count directly; only the rest are merged:
    new words many at a time as one text, told apart by the ids that begin with the
    space, their punctuation and every other piece alone.
    """

    CUT = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿ])(?= )")
    ODD = re.compile(r"(?:^|[^!-~À-ÖØ-öø-ÿ]) ")
    PLAIN = re.compile(r"( [A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str, proven):
        self.tok = load(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.starts = np.zeros(max(self.tok.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.starts[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
        self.proven = dict.fromkeys(proven, 1) | {"": 0}
        self.known: dict[str, int] = dict(self.proven)
        self.learned = 0

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) + 2 * len(pieces) > KEPT + len(self.proven):
            self.known = dict(self.proven)
        plain = {p: m for p in pieces if (m := self.PLAIN.fullmatch(p))}
        other = [p for p in pieces if p not in plain]
        other += {m[2] for m in plain.values()}.difference(self.known, other)
        words = sorted({m[1] for m in plain.values()}.difference(self.known))
        parts = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for part, enc in zip(parts, self.tok.encode_batch_fast(["".join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(enc.ids, "<u4")
            starts = np.flatnonzero(self.starts[ids])
            if len(starts) != len(part) or starts[0]:
                other += part
                continue
            self.known.update(zip(part, np.diff(starts, append=len(ids)).tolist()))
        for i in range(0, len(other), 4096):
            some = other[i:i + 4096]
            self.known.update(zip(some, (len(e.ids) for e in self.tok.encode_batch_fast(some, add_special_tokens=False))))
        for p, m in plain.items():
            self.known[p] = self.known[m[1]] + self.known[m[2]]

    def pieces(self, text: str) -> list[str]:
        if self.ODD.search(text):
            return self.CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def count(self, texts: list[str]) -> list[int]:
        return looked_up(self, texts, sum)
