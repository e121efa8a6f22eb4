"""Whole-text token ids with a public tokenizer, at word-cache speed.

The vocabulary file is a word BPE: white space separates words and never becomes a
token, so a text's ids are its words' ids in order.  Each batch is split and
dictionary-coded in Arrow, only words not met before go through the ``tokenizers``
library, and numpy lays the cached ids out per document.  ``encode_exact`` is the plain
library call that the tests compare with.

Null and empty texts have no ids.  A control string such as ``<|endoftext|>`` inside a
text is ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per Python worker; the cache starts anew when it is full.
CACHE_WORDS = 200_000
#: Bytes of text handled at once, whatever the Arrow batch holds.
CHUNK_BYTES = 2 << 20
_TAIL = r"(\pL)([!-&(-/:-@\[-`{-~]+)([\x20\x09-\x0D])"
_WORKER: dict[str, "WordTokenizer"] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts under a vocabulary whose pre-tokenizer drops white space."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _one(self, word: str) -> bytes:
        return np.asarray(self.lib.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_exact(self, text: str | None) -> list[int]:
        """The library's own answer for one whole text."""
        return self.lib.encode(text or "", add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Cache the ids of new words.

        An ASCII lower-case letters-only word is one pre-token that no normaliser changes,
        so it goes to the library's model alone; other letters-only words go through the
        whole library together, and all else goes one by one.
        """
        model, dtype, cache, rest = self.lib.model.tokenize, self.dtype, self.cache, []
        for w in words:
            if not w.isalpha():
                cache[w] = self._one(w)
            elif w.isascii() and w.islower():
                cache[w] = np.array([x.id for x in model(w)], dtype).tobytes()
            else:
                rest.append(w)
        for i in range(0, len(rest), 512):
            part = rest[i : i + 512]
            ids = np.asarray(self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                start = 0
                for w, stop in zip(part, stops.tolist()):
                    cache[w] = ids[start:stop].tobytes()
                    start = stop
            else:  # a letter that normalises into several pre-tokens
                cache.update((w, self._one(w)) for w in part)

    def _words(self, distinct: list[str]) -> list[bytes]:
        """Ids of each distinct word."""
        cache = self.cache
        new = [w for w in distinct if w not in cache]
        if new:
            if len(cache) + len(new) > self.cache_words:
                self.cache = cache = {w: cache[w] for w in distinct if w in cache}
            self._learn(new)
        return [cache[w] for w in distinct]

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has).  Null texts have none.

        A run of ASCII punctuation between a letter and white space is a pre-token of its
        own, so it is split off first; lower-casing A-Z changes no id either.
        """
        texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, pattern=_TAIL, replacement="\\1 \\2\\3")
        lists = pc.ascii_split_whitespace(texts)
        n_words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        per_word = self._words(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(per_word), self.dtype)
        size = np.fromiter(map(len, per_word), np.int64, len(per_word)) // np.dtype(self.dtype).itemsize
        begin = np.cumsum(size) - size
        counts = size[code]
        stop = np.cumsum(counts)
        total = int(stop[-1]) if len(stop) else 0
        at = np.repeat(begin[code] - (stop - counts), counts)
        at += np.arange(total)
        ids = pool[at] if total else np.zeros(0, self.dtype)
        edges = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        return ids, np.diff(np.concatenate([[0], stop])[edges])

    def encode_batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, counts) over slices of about CHUNK_BYTES of text each."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.cumsum(sizes) // CHUNK_BYTES
        edges = np.flatnonzero(np.diff(slot, prepend=-1)) if len(sizes) else np.zeros(0, int)
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)]):
            yield lo, *self.encode_many(texts.slice(lo, hi - lo))


def worker_tokenizer(path: str) -> WordTokenizer:
    """This Python worker's tokenizer, loaded once and kept between tasks."""
    if path not in _WORKER:
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]
