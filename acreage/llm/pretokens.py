"""Pre-tokens of the public tokenizers, cut out by array operations on the code points of many texts at once."""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np

from acreage.llm import text as X

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = BLANK
    return out


@functools.cache
def letters() -> np.ndarray:
    return X.mix(np.arange(1, 0x110001, dtype=np.uint64))


@functools.cache
def tokenizer(path: str):
    """The library's tokenizer, once per worker, on the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_batch(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)] if texts else []


@functools.cache
def _word_ends(path: str) -> np.ndarray | None:
    """For vocabularies with word ends: whether an id ends a word."""
    import json

    if not json.loads(tokenizer(path).to_str())["model"].get("end_of_word_suffix"):
        return None
    vocab = tokenizer(path).get_vocab(with_added_tokens=False)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
    return out


def encode_pieces(path: str, pieces: list[str]) -> list[np.ndarray]:
    """Ids of each pre-token by the library: its model for plain ones; of the others many as one text, told apart by word ends or line feeds."""
    out: list = [None] * len(pieces)
    model, rest = tokenizer(path).model, []
    for i, piece in enumerate(pieces):
        if piece.isascii() and piece.isprintable() and " " not in piece:  # such bytes stand for themselves in a byte-level vocabulary
            out[i] = np.array([t.id for t in model.tokenize(piece)], np.uint32)
        else:
            rest.append(i)
    ends = _word_ends(path)
    feed = None if ends is not None else encode_batch(path, ["\n"])[0]
    plain = [i for i in rest if pieces[i].strip() and not any(c in pieces[i] for c in "\n\r\t\f\v")]
    for at in range(0, len(plain), 512):
        part = plain[at : at + 512]
        ids = np.array(encode_batch(path, [(" " if ends is not None else "\n").join(pieces[i] for i in part)])[0], np.uint32)
        if ends is not None:
            found = np.split(ids, np.flatnonzero(ends[ids]) + 1)[:-1]
        else:
            found = [x[1:] if j else x for j, x in enumerate(np.split(ids, np.flatnonzero(ids == feed[0])))]
        if len(found) == len(part) and (ends is not None or len(feed) == 1):
            for i, x in zip(part, found):
                out[i] = x
    left = [i for i, x in enumerate(out) if x is None]
    for i, ids in zip(left, encode_batch(path, [pieces[i] for i in left])):
        out[i] = np.array(ids, np.uint32)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _suffix(points: np.ndarray, at: np.ndarray, word: str, bounds: np.ndarray) -> np.ndarray:
    """Places after which ``word`` follows without a bound inside."""
    ok = at + len(word) < len(points)
    at = at[ok]
    good = np.ones(len(at), bool)
    for j, c in enumerate(word, 1):
        good &= (points[at + j] == ord(c)) & ~bounds[at + j]
    return at[good]


def token_starts(points: np.ndarray, segment_starts: np.ndarray, blank_joins: bool) -> np.ndarray:
    """First code point of every piece, white space included, of segments that stand one after the other.

    Pieces are runs of one class, and the endings 's 't 'm 'd 're 've 'll after an apostrophe that starts a piece.
    ``blank_joins``: a blank before a run belongs to it, and of longer white space the last character stands apart.
    Otherwise every number is a piece and white space is told apart by the caller.
    """
    n = len(points)
    kind = classes()[points]
    bounds = np.zeros(n + 1, bool)
    bounds[segment_starts] = True
    bounds[n] = True
    run = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= bounds[:n]
    starts = run.copy()
    if blank_joins:
        begin = np.flatnonzero(run)
        end = np.append(begin[1:], n)
        after_blank = (kind[begin] == BLANK) & ~bounds[end]
        edge = end[after_blank]
        starts[edge - 1] = True
        starts[edge[points[edge - 1] == 32]] = False
    else:
        starts |= kind == NUMBER
    quote = np.flatnonzero((points == 39) & run & starts)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~bounds[quote + 1]]
    for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
        hit = _suffix(points, quote, ending, bounds)
        starts[hit + 1] = False
        after = hit + len(ending) + 1
        starts[after[after < n]] = True
    return np.flatnonzero(starts)


def piece_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    up, _ = X._powers(len(points) + 1)
    sums = np.empty(len(points) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(letters()[points] * up[: len(points)], out=sums[1:])
    return X.span_hashes(sums, starts, np.append(starts[1:], len(points)))


def split_specials(text: str, specials: list[str]) -> list[str]:
    """Ordinary text and special strings in turn, ordinary at even places; the leftmost special wins."""
    if not any(s in text for s in specials):
        return [text]
    out = []
    while True:
        at = min(((text.find(s), s) for s in specials if s in text), default=None)
        if at is None:
            return [*out, text]
        out += [text[: at[0]], at[1]]
        text = text[at[0] + len(at[1]) :]
