"""Token ids of whole texts through the tokenizers library, with a memo for words.

The tokenizer that is used here never lets a token or a normalisation step cross ASCII
white space, so a text's ids are its chunks' ids side by side.  A worker keeps the ids of
chunks it has seen; the library encodes each new chunk.  A plain word of letters (with
closing punctuation) is encoded by the same model without the general normaliser and
splitter, which for such words do nothing but lower them; any other chunk goes through
the full tokenizer.

That holds for tokenizers of the one make that ``_chunked`` describes, which is checked when the file is
read, and by encoding a probe both ways.  With any other one whole texts go through the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Most chunks a worker remembers; later ones are encoded again.
MEMO_CHUNKS = 900_000
TOKENIZER = "word_bpe_49k.json"

# Letters that the tokenizer's steps only lower: ASCII and Latin-1 letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


_PROBE = "The cat's école, ÀÉÎ ßtraße! it'll 12,5 <|endoftext|> x_y\tz\n\n  don't;end ﬁ 你好 e\u0301."


def _kinds(part: dict | None, inner: str) -> list[str]:
    """Names of a normaliser's or splitter's steps."""
    if not part:
        return []
    return [k for p in part[inner] for k in _kinds(p, inner)] if inner in part else [part["type"]]


def _chunked(path: str) -> bool:
    """Whether the file describes a tokenizer of words: they are cleaned and lowered, split at white space first, and their last token is marked."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    clean = _kinds(told["normalizer"], "normalizers")
    split = _kinds(told["pre_tokenizer"], "pretokenizers")
    return set(clean) <= {"NFC", "Lowercase", "Replace"} and "Lowercase" in clean and split[-1:] == ["ByteLevel"] and told["model"]["type"] == "BPE" and told["model"]["end_of_word_suffix"] == "</w>"


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.memo: dict[bytes, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.by_chunk = _chunked(path)
        if not self.by_chunk:
            return
        self.word = Tokenizer(self.full.model)
        self.word.normalizer = normalizers.Lowercase()
        self.word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.word.model._resize_cache(0)  # no word comes twice
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.by_chunk = self.encode([_PROBE]) == self._ids(self.full, [_PROBE])

    def _ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words: all in one text, cut behind the ids that end a word."""
        ids = np.array(self.word.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the model doesn't mark word ends as expected")
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        plain, heads, tails, other = [], [], [], []
        for c in chunks:
            m = _PLAIN.fullmatch(c.decode("utf-8", "replace"))
            if m:
                plain.append(c)
                heads.append(m[1])
                tails.append(m[2])
            else:
                other.append(c)
        for s in {t for t in tails} - self.signs.keys():
            self.signs[s] = self._ids(self.full, [s])[0]
        new = {c: i + self.signs[t] for c, i, t in zip(plain, self._words(heads), tails, strict=True)} if plain else {}
        if other:
            new |= zip(other, self._ids(self.full, [c.decode("utf-8", "replace") for c in other]), strict=True)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            return self._ids(self.full, [t.encode("utf-8", "replace").decode() for t in texts])
        raw = [t.encode("utf-8", "replace") for t in texts]
        # ASCII capitals are lowered first to meet fewer chunks; special tokens, in "<|...|>", are told by case.
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        seen: set[bytes] = set()
        for s in split:
            seen.update(s)
        fresh = [c for c in seen if c not in self.memo]
        if len(self.memo) + len(fresh) > MEMO_CHUNKS:
            self.memo = {}
            fresh = list(seen)
        for k in range(0, len(fresh), 20_000):
            self.memo |= self._learn(fresh[k : k + 20_000])
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    assert unicodedata.is_normalized("NFC", "À")  # plain letters are composed already
    return Encoder(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def slices(texts: list[str], chars: int = 1_000_000):
    """Runs of texts of about so many characters, so that a batch of long texts stays small."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
