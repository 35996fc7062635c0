"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 400_000  # words kept by a worker; more are worked out again
LONG = 64  # characters; words of more are not kept

_BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_REST = [b for b in range(256) if b not in set(_BYTES)]
#: byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
_ALPHABET = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(_REST)}

#: characters whose normal form, lower case and class are the same alone as in any text
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
_PARTS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
#: the splitting that the parts above repeat for those characters
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """``encode(text)`` gives the ids as little-endian 32-bit bytes, the same
    as the tokenizer's own ``encode(text, add_special_tokens=False)``;
    ``encode_all(column)`` gives them for every row of an Arrow column.

    For a tokenizer that drops white space before its words, ids of a text are
    those of its words one after the other.  Arrow cuts the column into chunks
    between blanks and the distinct chunks into words; the distinct words are
    encoded at once.  Where the file is of the kind whose ids are its merges in
    order (checked at load), ``tiktoken`` works the same ids out in one call;
    words of other files, long words and chunks of other characters go to
    ``tokenizers`` itself and are kept.  Any other tokenizer encodes each text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_chunk = (norm == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split"
                         and split.get("pattern", {}).get("Regex") == _KNOWN_SPLIT
                         and split.get("behavior") == "Removed" and split.get("invert") is True
                         and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip")
                                     for t in spec.get("added_tokens", [])))
        self.added = [t["content"][:2] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.words = _Words(self._word)
        self.ranked, self.last = _ranked(spec["model"]) if self.by_chunk else (None, None)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, w: str) -> bytes:
        if not w:
            return b""
        if w[0] == "\n":
            return self._whole(w[1:])
        ids = [t.id for t in self.model.tokenize(w if w.isascii() else "".join([_ALPHABET[b] for b in w.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _parted(self, chunks: pa.Array) -> pa.Array:
        """Chunks in lower case with a blank after each word; those that only the tokenizer
        itself can take stay as they are, marked by a line break before them."""
        plain = pc.match_substring_regex(chunks, _PLAIN)
        for a in self.added:
            plain = pc.and_not(plain, pc.match_substring(chunks, a))
        low = pc.utf8_lower(chunks)
        several = pc.and_not(plain, pc.utf8_is_alpha(low))
        low = pc.replace_with_mask(low, several, pc.replace_substring_regex(low.filter(several), _PARTS, r"\1 "))
        mark, nothing = (pa.scalar(c, chunks.type) for c in ("\n", ""))
        return pc.if_else(plain, low, pc.binary_join_element_wise(mark, chunks, nothing))

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def encode_all(self, column: pa.Array) -> pa.Array:
        """Ids of each row of a string column as binary; null is empty."""
        column = column.fill_null("")
        if not self.by_chunk:
            return pa.array([self._whole(text.as_py()) for text in column], pa.large_binary())
        rows = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        chunks = rows.flatten().dictionary_encode()
        parts = pc.split_pattern(self._parted(chunks.dictionary), " ")
        words = parts.flatten().dictionary_encode()
        ids = self._ids(words.dictionary).take(words.indices)
        return _joined(_joined(ids, parts).take(chunks.indices), rows)

    def _ids(self, words: pa.Array) -> pa.Array:
        """Ids of each distinct word."""
        length = pc.utf8_length(words).to_numpy()
        single = np.full(len(words), self.ranked is None) | (length == 0) | (length >= LONG)
        single |= pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        alone = words.filter(pa.array(single)).to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(list(map(self.words.__getitem__, alone)), pa.large_binary())
        if len(alone) == len(words):
            return ids
        rest = words.filter(pa.array(~single))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(rest)], rest), pa.scalar("\n", rest.type))[0].as_py()
        found = self.ranked.encode_to_numpy(text + "\n", disallowed_special=()).astype("<u4", copy=False)
        at = np.concatenate([[0], 4 * (np.flatnonzero(self.last[found]) + 1)])
        together = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(found)])
        place = np.where(single, np.cumsum(single) - 1, len(alone) + np.cumsum(~single) - 1)
        return pa.concat_arrays([ids, together]).take(pa.array(place))


def _ranked(model: dict):
    """``tiktoken`` for single words of a byte-level file with marks at the ends of words,
    and which of its ids end a word; none for other files.  A line break, which no word
    holds, stands for the mark."""
    mark, vocab = model.get("end_of_word_suffix"), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    base = {c + e for c in _ALPHABET.values() for e in ("", mark or "")}
    if (model.get("type") != "BPE" or not mark or model.get("continuing_subword_prefix") or model.get("dropout")
            or model.get("byte_fallback") or model.get("ignore_merges") or len(vocab) != len(base) + len(merges)
            or any(vocab.get(c, len(base)) >= len(base) for c in base)
            or any(vocab.get(a + b) != len(base) + i for i, (a, b) in enumerate(merges))):
        return None, None
    import tiktoken
    letters, last, ranks = {c: b for b, c in _ALPHABET.items()}, np.zeros(len(vocab), bool), {}
    for s, i in vocab.items():
        last[i] = s.endswith(mark)
        ranks[bytes(map(letters.__getitem__, s.removesuffix(mark))) + b"\n" * int(last[i])] = i
    if len(ranks) != len(vocab):
        return None, None
    return tiktoken.Encoding("words", pat_str=r"[^\n]*\n", special_tokens={}, mergeable_ranks=ranks), last


def _joined(items: pa.Array, lists: pa.Array) -> pa.Array:
    """The bytes of each list's items, one after the other; ``items`` are those of all lists."""
    _, ends, data = items.buffers()
    first = lists.offsets.to_numpy()
    at = np.frombuffer(ends, np.int64)[items.offset + first - first[0]]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), data])


class _Words(dict):
    """Ids of words.  When half of ``CACHE`` is in use, the words of the half before
    it go, but for those used since then."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, w: str) -> bytes:
        got = self.older.get(w)
        if got is None:
            got = self.work(w)
        if len(w) < LONG:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[w] = got
        return got


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- byte-level files, whole texts -------------------------------------------------
SLICE = 1 << 16  # characters; a slice is longer only where no safe place to cut comes
#: a blank after a character that is not white space: both kinds of tokenizer below start a token there
_BLANK = re.compile(r"(?<=\S) ")
_LONG_BLANKS = re.compile(r"\s{20000}")


def slices(text: str) -> list[str]:
    """``text`` cut before blanks that follow a character other than white space,
    into slices of about ``SLICE`` characters; all but the first lose their blank."""
    out, at = [], 0
    while len(text) - at > SLICE:
        cut = _BLANK.search(text, at + SLICE)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out


class ByteLevel:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, as
    ``uint32`` arrays, without the special tokens that a template would add.

    ``plain``: special tokens' strings inside texts are ordinary text; else
    they are special, as ``tokenizers`` has it by default.  Where the file is of
    the kind whose ids are its merges in order (checked at load), ``tiktoken``
    works the same ids out with less memory; other files, and runs of white
    space that its regular expression cannot take, go to ``tokenizers`` itself."""

    def __init__(self, path: str, plain: bool):
        from tokenizers import Tokenizer
        self.plain, self.tokenizer = plain, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model["vocab"]
        letters = {c: b for b, c in _ALPHABET.items()}
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        added = spec.get("added_tokens", [])
        for t in added:
            self.bytes_of.setdefault(t["id"], t["content"].encode())
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.fast = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
                     and not model.get("byte_fallback")
                     and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
                     and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added))
        self.special = {} if plain else {t["content"]: t["id"] for t in added}
        self._split = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        if self.fast:
            import tiktoken
            from public_tokenizers import PATTERN
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
                self.bytes_of[i]: i for i in vocab.values()})

    def _part(self, text: str) -> np.ndarray:
        if not self.fast or len(text) > 20_000 and _LONG_BLANKS.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranked.encode_to_numpy(text, disallowed_special=())

    def _run(self, text: str) -> list[np.ndarray]:
        """Ids of a text without special tokens."""
        first, *rest = slices(text)
        return [self._part(first), *(self._part(" " + s) for s in rest)]

    def ids(self, text: str) -> np.ndarray:
        if not self.fast:
            return self._part(text)
        if self._split is None or self._split.search(text) is None:
            parts = self._run(text)
        else:
            parts = []
            for s in self._split.split(text):
                parts += [np.array([self.special[s]], np.uint32)] if s in self.special else self._run(s) if s else []
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class Pieces:
    """Ids of a ``sentencepiece`` file.  ``by_slice``: no piece goes on over a
    blank after another character, so slices can be encoded one by one."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = {i: bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode()
                         for i, s in enumerate(names)}
        probe = "ﬁ①  a "
        self.by_slice = (not any("▁" in s.lstrip("▁") for s in names)
                         and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁"))

    def ids(self, text: str) -> np.ndarray:
        """Ids of one slice; the file's own blank goes before it."""
        return np.array(self.model.encode(text), np.uint32)


_OTHERS: dict[tuple, object] = {}


def byte_level(path: str, plain: bool) -> ByteLevel:
    """The worker's encoder for a byte-level file, made once."""
    if (path, plain) not in _OTHERS:
        _OTHERS[path, plain] = ByteLevel(path, plain)
    return _OTHERS[path, plain]


def piece_model(path: str) -> Pieces:
    """The worker's model for a ``sentencepiece`` file, made once."""
    if path not in _OTHERS:
        _OTHERS[path] = Pieces(path)
    return _OTHERS[path]
