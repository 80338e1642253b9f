"""Ids of the tokenizers library, text by text.

A chunk starts before white space that follows other characters. No token of the two
vocabularies' patterns reaches over such a place, so a text's ids are those of its chunks
one after another. Where whole texts need normalising first, chunks are encoded instead, each
once, until it leaves a cache of bounded memory.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import regex

from .common import TwoGenerationCache

#: Unicode's white space, as the library's patterns have it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "'s|'t|'re|'ve|'m|'ll|'d|"
#: Splits before merges: with and without a leading space in a token.
BYTE_PATTERN = rf"{LETTERS} ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PATTERN = rf"{LETTERS}[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
CHUNK = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A space that no chunk starts with.
ODD_SPACE = regex.compile(f"[{SPACE}] ")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes
    that are printable in Latin-1 stand for themselves, the others for 256, 257, ..."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def chunks(text: str) -> list[str]:
    return CHUNK.findall(text)


def pre_tokens(chunk: str, find) -> list[str]:
    """The matches of find in a chunk; most chunks are a word, or a word and a mark."""
    word = chunk[1:] if chunk[:1] == " " else chunk
    if word.isalpha():
        return [chunk]
    if word[:-1].isalpha() and word[-1] in ".,;:!?":
        return [chunk[:-1], chunk[-1]]
    return find(chunk)


#: Of plain texts: marks, each of them neither letter, digit nor white space, and spaces.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026\u20ac"
SPACES = " \t\n\x0b\x0c\r"
#: What plain texts don't have: anything but these, ASCII letters and digits, and letters below
#: U+0180 that are lower-cased one by one.
not_plain = re.compile(f"[^{re.escape(MARKS)}{SPACES}0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]").search


def marked_words(text: str, mark: str) -> str:
    """The pre-tokens (WORD_PATTERN) of a plain text in lower case, a mark or more behind each."""
    for c in MARKS:
        text = text.replace(c, f"{mark}{c}{mark}")
    text = text.replace(mark + mark, "")  # neighbours are one pre-token
    if f"{mark}'{mark}" in text:
        for end in ("s", "t", "re", "ve", "m", "ll", "d"):
            text = text.replace(f"{mark}'{mark}{end}", f"{mark}'{end}{mark}")
    for c in "0123456789":
        text = text.replace(c, f"{mark}{c}{mark}")
    for c in SPACES:
        text = text.replace(c, mark)
    return text + mark


class ChunkedEncoder:
    """Ids of texts as bytes (little-endian unsigned 32-bit). spaced: a token may begin with a
    space, so a chunk has the white space before it; else white space is dropped.
    encode_chunks: a list of chunks to a list of their ids. encode_plain: a text to its ids, or
    None where it takes chunks."""

    def __init__(self, encode_chunks, spaced: bool, encode_plain=None, most: int = 64 << 20):
        self.spaced, self.encode_plain = spaced, encode_plain
        self.plain = TwoGenerationCache(encode_chunks, most)
        self.after_space = TwoGenerationCache(lambda words: encode_chunks([" " + w for w in words]), most)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out = [self.encode_plain(t) for t in texts] if self.encode_plain else [None] * len(texts)
        chunked = [i for i, x in enumerate(out) if x is None]
        todo, size = [], 0
        for i in chunked:
            todo.append(i)
            size += len(texts[i])
            if size >= 1_000_000 or i == chunked[-1]:
                for k, x in zip(todo, self._some([texts[k] for k in todo]), strict=True):
                    out[k] = x
                todo, size = [], 0
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if not self.spaced:
            words = [t.split(" ") for t in texts]
            self.plain.fetch(set().union(*words))
            get = self.plain.__getitem__
            return [b"".join(map(get, w)) for w in words]
        firsts, rests = [], []
        for t in texts:
            if ODD_SPACE.search(t):
                firsts.append(chunks(t))
                rests.append(())
            else:
                first, *rest = t.split(" ")
                firsts.append((first,))
                rests.append(rest)
        self.plain.fetch(set().union(*firsts))
        self.after_space.fetch(set().union(*rests))
        a, b = self.plain.__getitem__, self.after_space.__getitem__
        return [b"".join(map(a, f)) + b"".join(map(b, r)) for f, r in zip(firsts, rests, strict=True)]

    def release(self) -> None:
        self.plain.release()
        self.after_space.release()


def _le(ids) -> bytes:
    return array("I", ids).tobytes()


class WholeTextEncoder:
    """The library itself, whole texts at once."""

    def __init__(self, tok):
        self.tok = tok

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [_le(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def release(self) -> None:
        pass


class RankedTextEncoder:
    """Whole texts by tiktoken over the vocabulary's own ranks; texts with special tokens by the
    library. Nothing is kept from text to text."""

    def __init__(self, encode, has_special, whole):
        self.encode, self.has_special, self.whole = encode, has_special, whole

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.whole(t) if self.has_special(t) else _le(self.encode(t)) for t in texts]

    def release(self) -> None:
        pass


def _reached(token: str, suffix: str, rank: dict[tuple[str, str], int]) -> bool:
    """Merging the characters of a token, on its own, ends with the token."""
    ended = bool(suffix) and token.endswith(suffix)
    parts = list(token[: -len(suffix)] if ended else token)
    if ended:
        parts[-1] += suffix
    while len(parts) > 1:
        least, i = min((rank.get((a, b), NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if least == NEVER:
            return False
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


def _ranked_bytes(spec: dict, suffix: str) -> dict[bytes, int] | None:
    """Bytes of each token -> its id, in the order of ranks: single bytes, then single bytes
    with MARK for the suffix, then merges. None if the vocabulary isn't made like that.

    tiktoken merges a pair if its bytes are a token, the library if the pair is a listed merge.
    Both give the same ids where each token is reached from its characters: nothing then merges
    over the edges of what becomes a token, so its last pair is the listed one. Tokens that
    aren't reached are never results, and are left out."""
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    merged = [a + b for a, b in pairs]
    singles = [c + end for end in dict.fromkeys(("", suffix)) for c in byte_chars()]
    if len(set(merged)) != len(pairs) or not {*singles, *merged} <= vocab.keys() <= {*singles, *merged, *special}:
        return None

    def as_bytes(s: str) -> bytes:
        ended = bool(suffix) and s.endswith(suffix)
        return bytes(byte_of[c] for c in (s[: -len(suffix)] if ended else s)) + MARK * ended

    return {as_bytes(s): vocab[s] for s in [*singles, *(s for s in merged if _reached(s, suffix, rank))]}


NEVER = 1 << 60
#: Stands for the end of a word in the bytes of tokens; words that contain it go to the library.
MARK = b"\x00"


@functools.cache
def library_encoder(path: str) -> ChunkedEncoder | RankedTextEncoder | WholeTextEncoder:
    """The ids of Tokenizer.encode(text, add_special_tokens=False), without truncation.

    What has no special token is merged by the tiktoken library over the file's own vocabulary,
    which gives the same ids several times as fast; see _ranked_bytes() for when it does.
    Vocabularies of another make go through the library whole text by whole text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    special = tuple(t["content"] for t in spec["added_tokens"])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or regex.search(f"[{SPACE}]", t["content"]) for t in spec["added_tokens"]):
        return WholeTextEncoder(tok)
    spaced = spec["normalizer"] is None
    suffix = spec["model"].get("end_of_word_suffix") or ""
    ids = _ranked_bytes(spec, suffix) if spaced != bool(suffix) else None
    if ids is None:
        return WholeTextEncoder(tok)
    whole = lambda text: _le(tok.encode(text, add_special_tokens=False).ids)
    has_special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
    if spaced and list(ids.values())[256:] == sorted(list(ids.values())[256:]):
        # ranks only have to be in the order of merges, so ids can stand for them
        return RankedTextEncoder(tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary, has_special, whole)
    if spaced:
        return WholeTextEncoder(tok)
    find = regex.compile(WORD_PATTERN).findall
    mark = MARK.decode()
    encode = tiktoken.Encoding("own", pat_str=f"[^{mark}]+{mark}", mergeable_ranks={b: i for i, b in enumerate(ids)}, special_tokens={}).encode_ordinary
    id_of = np.fromiter(ids.values(), np.uint32, len(ids))
    ends_word = np.fromiter((b.endswith(MARK) and b != MARK for b in ids), bool, len(ids))
    lower = tok.normalizer.normalize_str

    # up to there, letters are lower-cased one by one and none combines with its neighbour
    simple = lambda c: c.isascii() or max(c) < "\u0180" and "\u0130" not in c and "\xa0" not in c and "\x85" not in c

    def from_marked(marked: str) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pre-tokens that end in marks, and which of them end one."""
        ranks = np.array(encode(marked), np.int64)
        return ranks, ends_word[ranks]

    def encode_chunks(new: list[str]) -> list[bytes]:
        """All pre-tokens of all chunks, each with its mark, are one text; a token that ends
        with the mark ends a pre-token."""
        out = [whole(c) if mark in c or has_special(c) else b"" for c in new]
        own = [i for i, c in enumerate(new) if c and not out[i]]
        split = [pre_tokens(c.lower() if simple(c) else lower(c).strip(" "), find) for c in map(new.__getitem__, own)]
        own, split = zip(*[(i, x) for i, x in zip(own, split, strict=True) if x and x != [""]], strict=True) if any(split) else ((), ())
        if not own:
            return out
        ranks, ended = from_marked(mark.join([p for x in split for p in x]) + mark)
        after = np.flatnonzero(ended)[np.cumsum([len(x) for x in split]) - 1] + 1
        raw, at = id_of[ranks].tobytes(), 0
        for i, end in zip(own, (4 * after).tolist(), strict=True):
            out[i], at = raw[at:end], end
        return out

    def encode_plain(text: str) -> bytes | None:
        """Ids of a text of PLAIN characters, or None."""
        if not_plain(text) or has_special(text):
            return None
        text = marked_words(text.lower(), mark)
        return id_of[from_marked(text)[0]].tobytes()

    return ChunkedEncoder(encode_chunks, spaced, encode_plain)
