"""Token ids of texts, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabprep.llm.common import doc_slices, worker_store, words_of

#: Words kept by each worker; beyond it words are encoded again in each slice or shard. Not a cap on what is encoded.
CACHED_WORDS = 400_000
SLICE_BYTES = 4_000_000
#: Signs that make a token of their own after a letter, in either vocabulary; no apostrophes, nothing of special tokens.
_TAIL = ".,!?;:*#$%&\"()[]{}-+=/\\@_~^`"
#: White space that makes cutting a text at its spaces unsafe for byte-level vocabularies.
_ODD_SPACE = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]")


def _strings(words: pa.Array) -> list[str]:
    """As ``to_pylist``, which makes a scalar of each string first."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _places(store: dict) -> dict:
    """Place of each of the store's words."""
    if store.get("placed") is not store["words"]:
        store["places"], store["placed"] = {w: i for i, w in enumerate(_strings(store["words"]))}, store["words"]
    return store["places"]


def _look_up(strings: list[str], store: dict, tokenizer) -> np.ndarray:
    """Place of each string in the store; words it does not have are encoded and added."""
    places = _places(store)
    place = np.fromiter(map(places.get, strings, repeat(-1)), np.int64, len(strings))
    lacking = np.flatnonzero(place < 0).tolist()
    missing = list(dict.fromkeys([strings[i] for i in lacking]))
    flat, sizes = [store["flat"]], [store["sizes"]]
    for at in range(0, len(missing), 20_000):
        new, each = _encode(pa.array(missing[at:at + 20_000], pa.large_string()), store, tokenizer)
        flat.append(new)
        sizes.append(each)
    if missing:
        places.update(zip(missing, range(len(places), len(places) + len(missing)), strict=True))
        store["words"] = store["placed"] = pa.concat_arrays([store["words"], pa.array(missing, pa.large_string())])
        store["flat"], store["sizes"] = np.concatenate(flat), np.concatenate(sizes)
    place[lacking] = [places[strings[i]] for i in lacking]
    return place


def _forget(store: dict) -> None:
    """Leave the first ``CACHED_WORDS`` words in the store; places of others are no longer valid."""
    places = _places(store)
    while len(places) > CACHED_WORDS:
        places.popitem()
    store["words"] = store["placed"] = store["words"].slice(0, CACHED_WORDS)
    store["sizes"] = store["sizes"][:CACHED_WORDS]
    store["flat"] = store["flat"][:store["sizes"].sum()]


def _encode(words: pa.Array, store: dict, tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and their number for each word. Words of letters are encoded as one text.

    Each of these has at least one id that ends a word, so with as many of these ids as words each has exactly one, its
    last. Where the numbers differ, words are encoded one by one.
    """
    keys, letters = _strings(words), np.zeros(len(words), bool)
    if store["ends"] is not None:
        letters = pc.match_substring_regex(words, "^\\p{L}+$").to_numpy(zero_copy_only=False)
    joined = " ".join([k for k, x in zip(keys, letters, strict=True) if x])
    ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
    ends = np.flatnonzero(store["ends"][ids]) + 1 if letters.any() else np.zeros(0, np.int64)
    if len(ends) != letters.sum():
        ids, ends, letters = ids[:0], ends[:0], np.zeros(len(words), bool)
    coded = tokenizer.encode_batch_fast([k for k, x in zip(keys, letters, strict=True) if not x], add_special_tokens=False)
    pieces = [array("I", code.ids).tobytes() for code in coded]
    both = np.concatenate([ids, np.frombuffer(b"".join(pieces), "<u4")])
    sizes = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4])
    order = np.argsort(np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)]))
    return _expand(order, np.arange(len(words) + 1), both, sizes)


def _word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, where every byte has such an id; None for vocabularies without them."""
    from tokenizers import pre_tokenizers

    known = tokenizer.get_vocab(with_added_tokens=False)
    if not all(byte + "</w>" in known for byte in pre_tokenizers.ByteLevel.alphabet()):
        return None
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in known.items() if token.endswith("</w>")]] = True
    return ends


def _places_of_words(words: pa.Array, store: dict, tokenizer, lower: bool) -> np.ndarray:
    """Two places for each word, of its body and its tail.

    A trailing run of signs after a letter is looked up by itself.
    """
    if lower and not pc.any(pc.match_substring(words, "<|"), min_count=0).as_py():
        words = pc.ascii_lower(words)
    bare = pc.utf8_rtrim(words, _TAIL)
    at = np.flatnonzero(pc.not_equal(pc.binary_length(bare), pc.binary_length(words)).to_numpy(zero_copy_only=False))
    bare = bare.take(pa.array(at))
    after_letter = pc.match_substring_regex(bare, "\\p{L}$")
    at = at[after_letter.to_numpy(zero_copy_only=False)]
    strings, tails = _strings(words), []
    for i, body in zip(at.tolist(), _strings(bare.filter(after_letter)), strict=True):
        tails.append(strings[i][len(body):])
        strings[i] = body
    found = _look_up([*strings, *tails, ""], store, tokenizer)
    both = np.full((len(words), 2), found[-1])
    both[:, 0] = found[:len(words)]
    both[at, 1] = found[len(words):-1]
    return both


def _ids_of_words(words: pa.Array, store: dict, tokenizer, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and their number for each word."""
    both = _places_of_words(words, store, tokenizer, lower)
    return _expand(both.ravel(), 2 * np.arange(len(words) + 1), store["flat"], store["sizes"])


def _load(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store = worker_store(path)
    if "tokenizer" not in store:
        store["tokenizer"], store["words"] = Tokenizer.from_file(path), pa.array([], pa.large_string())
        store["flat"], store["sizes"] = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        store["ends"] = _word_ends(store["tokenizer"])
    return store, store["tokenizer"]


def _expand(codes: np.ndarray, offsets: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the coded strings in turn, and their number in each range of ``offsets``."""
    starts = np.cumsum(sizes) - sizes
    each = sizes[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(total)]
    return ids, np.diff(np.concatenate([[0], ends])[offsets])


def _by_words(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """For vocabularies that drop white space: a text's ids are those of its words in turn."""
    store, tokenizer = _load(path)
    codes, offsets, words = words_of(text)
    return _expand(codes, offsets, *_ids_of_words(words, store, tokenizer, lower=True))


def _by_spaces(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """For byte-level vocabularies: a space between two words starts the next token, a line break is a token.

    Texts with other white space, or white space beside white space, are encoded whole.
    """
    store, tokenizer = _load(path)
    texts = text.to_pylist()
    odd = np.fromiter((_ODD_SPACE.search(t) is not None for t in texts), bool, len(texts))
    plain = text.filter(pa.array(~odd))
    lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    coded = lists.flatten().dictionary_encode()
    codes, units = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    line = pc.index(units, "\n").as_py()
    first = np.zeros(len(codes) + 1, bool)
    first[offsets[:-1]] = True
    is_line = codes == line
    bare = first[:-1] | is_line | np.concatenate([[False], is_line[:-1]])[: len(codes)]
    used, codes = np.unique(codes * 2 + ~bare, return_inverse=True)
    lead = pa.array(np.where(used & 1, " ", "").tolist(), pa.large_string())
    words = pc.binary_join_element_wise(lead, units.take(pa.array(used >> 1)), pa.scalar("", pa.large_string()))
    ids, lengths = _expand(codes, offsets, *_ids_of_words(words, store, tokenizer, lower=False))
    if not odd.any():
        return ids, lengths
    parts = np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []
    whole = [t for t, o in zip(texts, odd, strict=True) if o]
    coded = iter([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
    plain_parts = iter(parts)
    merged = [next(coded) if o else next(plain_parts) for o in odd]
    return np.concatenate(merged).astype(np.uint32), np.array([len(m) for m in merged], np.int64)


def encoded(text: pa.Array, path: str, byte_level: bool, end_id: int):
    """Yield (first row, ids with the end id after each text, ids of each text) for slices of bounded size.

    What a slice took is given back after it: a worker that is used again holds its words and one slice.
    """
    for at, to in doc_slices(text, SLICE_BYTES):
        ids, lengths = (_by_spaces if byte_level else _by_words)(text.slice(at, to - at), path)
        ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id)).astype("<u4")
        yield at, ids, lengths + 1
        del ids, lengths
        _forget(worker_store(path))
        pa.default_memory_pool().release_unused()


class Units:
    """Texts as numbers of units (words, or whole texts for byte-level vocabularies) until ``release``; 0 is the end id."""

    def __init__(self, path: str, byte_level: bool, end_id: int):
        self.path, self.byte_level, self.end = path, byte_level, np.array([end_id], "<u4")
        self.release()

    def code(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Units of all texts in turn, their number in each text, and the number of ids; each text has its end."""
        if self.byte_level:
            ids, lengths = _by_spaces(text, self.path)
            codes = sum(map(len, self.sizes)) + np.arange(len(text))
            self.flat.append(ids)
            self.sizes.append(lengths)
            filled, offsets = lengths > 0, np.arange(len(text) + 1)
        else:
            store, tokenizer = _load(self.path)
            words, offsets, distinct = words_of(text)
            places = _places_of_words(distinct, store, tokenizer, lower=True)[words].ravel()
            lengths, codes, offsets = store["sizes"][places], (places + 1).astype(np.int32), 2 * offsets
            filled = lengths > 0
        ends = np.concatenate([[0], np.cumsum(filled)])[offsets]
        pa.default_memory_pool().release_unused()
        return np.insert(codes[filled], ends[1:], 0), np.diff(ends) + 1, int(lengths.sum()) + len(text)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and their numbers."""
        store = {} if self.byte_level else _load(self.path)[0]
        flat, sizes = (self.flat, self.sizes) if self.byte_level else ([self.end, store["flat"]], [[1], store["sizes"]])
        return np.concatenate(flat), np.concatenate(sizes)

    def release(self) -> None:
        """Give back what texts since the last release took but for the words that a worker keeps."""
        self.flat, self.sizes = [self.end], [np.ones(1, np.int64)]
        if not self.byte_level:
            _forget(_load(self.path)[0])
